"""Registered queries of the extraction operators, and the same in DuckDB's SQL.

The base relations are written once, in SQL that both engines read.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as tx
from .operators import candidates as cd
from .operators import deferred as df_
from .operators import filters as fl
from .operators import instances as ins
from .operators import scoring as sc
from .operators import selection as sel
from .operators import validation as va
from .sources import adapters as ad

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

BASE = {
    "cands": """SELECT l_orderkey AS doc_id, CASE WHEN l_suppkey % 2 = 0 THEN 'amount' ELSE 'party' END AS field_id, l_linenumber AS seq,
        concat(CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) AS candidate_id, concat('$', CAST(CAST(l_quantity AS INT) AS STRING)) AS text,
        CAST((l_partkey * 7) % 90 AS INT) AS byte_start, CAST((l_partkey * 7) % 90 + CAST(l_quantity AS INT) % 30 AS INT) AS byte_end,
        CASE WHEN l_returnflag = 'N' THEN NULL ELSE l_returnflag END AS entity_type, CAST(NULL AS STRING) AS normalized_hint,
        concat(l_linestatus, ' near ', l_returnflag) AS context, l_suppkey % 3 = 0 AS structural_passed FROM {lineitem}""",
    "sets": "SELECT o_orderkey AS doc_id, f.field_id FROM {orders} CROSS JOIN (SELECT 'amount' AS field_id UNION ALL SELECT 'party' UNION ALL SELECT 'due') f",
    "keys": """SELECT l_orderkey AS doc_id, l_linenumber AS ordinal, concat('g', CAST(l_linenumber % 3 AS STRING)) AS group_id,
        CAST((l_suppkey * 11) % 90 AS INT) AS anchor_start, CAST((l_suppkey * 11) % 90 + 12 AS INT) AS anchor_end FROM {lineitem} WHERE l_linenumber <= 3""",
    "gold": """SELECT l_orderkey AS case_id, CASE WHEN l_suppkey % 2 = 0 THEN 'amount' ELSE 'party' END AS field_id, l_linenumber AS gold_index,
        CASE WHEN l_linenumber % 2 = 0 OR l_partkey % 3 = 0 THEN concat('$', CAST(CAST(l_quantity AS INT) % 5 + 1 AS STRING), CASE WHEN l_partkey % 4 = 0 THEN '7' ELSE '' END) END AS text,
        CASE WHEN l_linenumber % 2 = 1 AND l_partkey % 11 <> 0 THEN CAST((l_partkey * 7) % 90 + (l_suppkey % 4) AS INT) END AS byte_start,
        CASE WHEN l_linenumber % 2 = 1 AND l_partkey % 11 <> 0 THEN CAST((l_partkey * 7) % 90 + (l_suppkey % 4) + CAST(l_quantity AS INT) % 30 AS INT) END AS byte_end,
        CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(CAST(l_quantity AS INT) AS STRING) END AS expected_value, l_tax > 0.07 AS expected_absent FROM {lineitem}""",
    "found": """SELECT l_orderkey AS case_id, CASE WHEN l_suppkey % 2 = 0 THEN 'amount' ELSE 'party' END AS field_id, l_linenumber AS seq,
        concat('$', CAST(CAST(l_quantity AS INT) AS STRING)) AS text, concat('cost $', CAST(CAST(l_quantity AS INT) % 5 + 1 AS STRING), CASE WHEN l_linenumber < 3 THEN '7' ELSE '' END) AS context,
        CAST((l_partkey * 7) % 90 AS INT) AS byte_start, CAST((l_partkey * 7) % 90 + CAST(l_quantity AS INT) % 30 AS INT) AS byte_end, l_discount > 0.03 AS kept FROM {lineitem}""",
    "obs": """SELECT l_orderkey AS doc_id, CASE l_linenumber WHEN 1 THEN 'one' WHEN 2 THEN 'maybe' WHEN 3 THEN 'several' ELSE 'each' END AS field_id,
        CASE l_suppkey % 4 WHEN 0 THEN 'ABSTAINED' WHEN 1 THEN 'AMBIGUOUS' ELSE 'SELECTED' END AS outcome, CAST(l_partkey % 3 AS INT) AS k,
        CASE WHEN l_tax > 0.04 THEN 'given' END AS reason FROM {lineitem} WHERE l_linenumber <= 4""",
    "usage": "SELECT user_id AS run_id, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(floor(value) AS INT) END AS input_tokens, CAST(event_id % 7 AS INT) AS output_tokens FROM {events}",
    "requests": "SELECT concat('r', CAST(event_id AS STRING)) AS request_id, concat('d', CAST(user_id AS STRING)) AS document_id FROM {events} WHERE event_id % 5 <> 0",
    "results": """SELECT concat('r', CAST(event_id AS STRING)) AS request_id, CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'ok' END AS status FROM {events} WHERE event_id % 7 <> 0
        UNION ALL SELECT concat('r', CAST(event_id AS STRING)), CASE WHEN event_id % 2 = 0 THEN 'ok' ELSE 'failed' END FROM {events} WHERE event_id % 11 = 0""",
    "cells": """SELECT o_custkey AS doc_id, CAST(o_orderkey % 2 AS INT) AS ordinal, CASE o_orderkey % 3 WHEN 0 THEN 'total' WHEN 1 THEN 'tag' ELSE 'note' END AS field_id, o_orderkey AS seq, o_orderpriority AS value FROM {orders}""",
    "expected": "SELECT o_custkey AS case_id, CAST(o_orderkey % 3 AS INT) AS idx, o_orderpriority AS field_id, o_orderkey AS seq, o_orderstatus AS value FROM {orders} WHERE o_orderkey % 4 <> 0",
    "actual": "SELECT o_custkey AS case_id, CAST(o_orderkey % 4 AS INT) AS idx, o_orderpriority AS field_id, o_orderkey AS seq, CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS value FROM {orders} WHERE o_orderkey % 6 <> 0",
}


#: Order lines with a unique (order, line number): the tables' lines repeat some.
LINES = """SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey, max(l_quantity) AS l_quantity, max(l_discount) AS l_discount,
    max(l_tax) AS l_tax, max(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus FROM {lineitem} GROUP BY l_orderkey, l_linenumber"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(LINES, lineitem=_by_order(found)) if name == "lineitem" else found


#: Bytes of a table's files for each partition of its rows.
PART_BYTES = 2 << 20


def _by_order(lines: DataFrame) -> DataFrame:
    """lines spread by order alone, so that joins by order, the document, needn't move them again; in partitions by the files' size, so that a task's memory doesn't grow with the table."""
    size = int(lines._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return lines.repartition(max(lines.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES)), "l_orderkey")


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(BASE[name], **{t: table(spark, sf_dir, t) for t in re.findall(r"\{(\w+)\}", BASE[name])})


def _query(sql: str | None, name: str | None = None):
    """Registers a query; its SQL may name base relations, which go before it."""

    def put(function: Query) -> Query:
        key = name or function.__name__
        QUERIES[key] = function
        if sql:
            used = [b for b in BASE if re.search(rf"\b{b}\b", sql)]
            views = ", ".join(f"{b} AS ({re.sub(r'[{}]', '', BASE[b])})" for b in used)
            full = f"WITH {views}{', ' if views and not sql.lstrip().startswith('SELECT') else ' '}{sql}" if used else (sql if sql.lstrip().startswith("SELECT") else f"WITH {sql}")
            ORACLES[key] = re.sub(r"(FROM|JOIN) lineitem\b", lambda m: f"{m[1]} ({LINES.format(lineitem='lineitem')}) lineitem", full)
        return function

    return put


# sources


@_query("SELECT doc_id, sha256(to_json(text)::VARCHAR) AS content_hash, 'document@' || sha256(to_json(text)::VARCHAR) AS document_id, CASE WHEN text = '' THEN 0 ELSE 1 END AS segments, strlen(text)::BIGINT AS size FROM documents")
def a1_text_view(spark, sf):
    return ad.text_view(table(spark, sf, "documents")).select("doc_id", "content_hash", "document_id", F.size("segments").alias("segments"), F.octet_length("text").cast("long").alias("size"))


@_query(None)
def a3_html_view(spark, sf):
    return ad.html_view(table(spark, sf, "pages")).select("page_id", "text", F.size("segments").alias("n_segments"), ad.map_violation(F.col("segments"), F.col("text")).alias("violation"))


@_query("SELECT doc_id, strlen(text[1:(doc_id % 50)::BIGINT])::INTEGER AS offset_bytes, least(doc_id % 50, length(text))::INTEGER AS chars, text[(doc_id % 20 + 1)::BIGINT:(doc_id % 50)::BIGINT] AS piece FROM documents")
def a12_bytes_and_chars(spark, sf):
    n, low = (F.col("doc_id") % 50).cast("int"), (F.col("doc_id") % 20).cast("int")
    at, start = tx.char_to_byte(F.col("text"), n), tx.char_to_byte(F.col("text"), low)
    piece = F.when(start < at, tx.slice_bytes(F.col("text"), start, at)).otherwise("")
    return table(spark, sf, "documents").select("doc_id", at.alias("offset_bytes"), tx.byte_to_char(F.col("text"), at).alias("chars"), piece.alias("piece"))


@_query("""SELECT doc_id, (o < strlen(text) AND (ascii_byte & 192) <> 128) OR o = strlen(text) AS aligned
    FROM (SELECT doc_id, text, o, CASE WHEN o < strlen(text) THEN ('0x' || substr(hex(encode(text)), 2 * o + 1, 2))::INTEGER ELSE 0 END AS ascii_byte FROM (SELECT doc_id, text, doc_id % 100 AS o FROM documents))""")
def a10_alignment(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.is_aligned(F.col("text"), F.col("doc_id") % 100).alias("aligned"))


@_query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'candidate.text_anchor_space_mismatch' WHEN 10 + doc_id % 700 > strlen(text) THEN 'candidate.span_out_of_range' END AS code FROM documents WHERE text = regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')")
def a11_span_check(spark, sf):
    ascii_only = table(spark, sf, "documents").where(F.octet_length("text") == F.char_length("text"))
    space = F.when(F.col("doc_id") % 5 == 0, "source_bytes").otherwise("normalized_text")
    return ascii_only.select("doc_id", ad.span_violation(F.col("text"), space, F.lit(10), 10 + F.col("doc_id") % 700).alias("code"))


def _segments(*rows):
    names = ("norm_start", "norm_end", "src_start", "src_end")
    return F.array(*(F.struct(*(F.lit(v).cast("long").alias(n) for n, v in zip(names, row))) for row in rows))


@_query("SELECT l_orderkey AS doc_id, l_linenumber AS seq, (CASE WHEN o < 10 THEN 100 + o WHEN o < 30 THEN 120 ELSE 150 + o - 30 END)::BIGINT AS start, (CASE WHEN o < 10 THEN 100 + o WHEN o < 30 THEN 126 ELSE 150 + o - 30 END)::BIGINT AS \"end\" FROM (SELECT *, (l_partkey * 7) % 60 AS o FROM lineitem)")
def a8_lookup(spark, sf):
    segments = _segments((0, 10, 100, 110), (10, 30, 120, 126), (30, 60, 150, 180))
    got = ad.lookup(segments, (F.col("l_partkey") * 7) % 60)
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq"), got["start"].alias("start"), got["end"].alias("end"))


@_query("SELECT l_orderkey AS doc_id, l_linenumber AS seq, (CASE WHEN a BETWEEN 100 AND 110 AND a + 4 <= 110 THEN a - 100 WHEN a >= 150 AND a + 4 <= 180 THEN a - 120 END)::BIGINT AS start FROM (SELECT *, 95 + (l_partkey * 7) % 90 AS a FROM lineitem)")
def a9_invert(spark, sf):
    segments = _segments((0, 10, 100, 110), (30, 60, 150, 180))
    a = 95 + (F.col("l_partkey") * 7) % 90
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq"), ad.invert(segments, a, a + 4)["start"].alias("start"))


# candidates

_REGEX = """m AS (SELECT doc_id, regexp_extract_all(text, '{p}') AS f, string_split_regex(text, '{p}') AS s FROM documents WHERE regexp_matches(text, '{p}'))
    SELECT doc_id, (i - 1)::INTEGER AS seq, f[i] AS text, (list_sum(list_transform(s[1:i], lambda x: strlen(x))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda x: strlen(x))), 0))::INTEGER AS byte_start,
        (list_sum(list_transform(s[1:i], lambda x: strlen(x))) + list_sum(list_transform(f[1:i], lambda x: strlen(x))))::INTEGER AS byte_end, '{e}' AS entity_type FROM m, unnest(range(1, len(f) + 1)) AS t(i)"""


@_query(_REGEX.format(p="[0-9]+", e="CARDINAL"))
def c1_regex_native(spark, sf):
    return cd.regex_native(table(spark, sf, "documents"), "[0-9]+", "CARDINAL")


@_query(_REGEX.format(p="[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+", e="EMAIL"))
def c1_regex_general(spark, sf):
    return cd.regex_general(table(spark, sf, "documents"), cd.RegexParams(pattern=r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+", entity_type="EMAIL"))


@_query("""m AS (SELECT doc_id, regexp_extract_all(text, 'token = "([0-9a-f]+)"', 1) AS f FROM documents)
    SELECT doc_id, (i - 1)::INTEGER AS seq, f[i] AS text FROM m, unnest(range(1, len(f) + 1)) AS t(i)""")
def c4_regex_group(spark, sf):
    return cd.regex_general(table(spark, sf, "documents"), cd.RegexParams(pattern=r'token = "(?P<value>[0-9a-f]+)"', group="value")).select("doc_id", "seq", "text")


@_query("SELECT doc_id, a.seq, a.literal AS text, 0 AS byte_start, 0 AS byte_end, true AS structural_passed FROM documents, (SELECT 0 AS seq, 'invoice' AS literal UNION ALL SELECT 1, 'receipt' UNION ALL SELECT 2, 'other') a")
def c5_literal_set(spark, sf):
    return cd.literal_set(table(spark, sf, "documents"), ["invoice", "receipt", "other"])


@_query(""" m AS (SELECT doc_id, l.label, regexp_extract_all(text, '\\b' || l.phrase || '\\b') AS f FROM documents, (SELECT 'License' AS phrase, 'DOC' AS label UNION ALL SELECT 'Apache', 'ORG') l)
    SELECT doc_id, label AS entity_type, sum(len(f))::BIGINT AS n FROM m WHERE len(f) > 0 GROUP BY ALL""")
def c6_phrases(spark, sf):
    return cd.phrases(table(spark, sf, "documents"), {"License": "DOC", "Apache": "ORG"}).groupBy("doc_id", "entity_type").agg(F.count("*").alias("n"))


@_query("""SELECT doc_id, k::INTEGER AS chunk, (k * 900)::INTEGER AS char_start, text[(k * 900 + 1)::BIGINT:(k * 900 + 1000)::BIGINT] AS text
    FROM documents, unnest(range(0, greatest(ceil((length(text) - 1000) / 900.0), 0)::BIGINT + 1)) AS t(k) WHERE length(text) > 0""")
def c8_chunks(spark, sf):
    return cd.chunks(table(spark, sf, "documents"), 1000, 100)


@_query("""seg AS (SELECT l_orderkey AS doc_id, l_linenumber AS k, (l_linenumber - 1) * 20 AS a, l_linenumber * 20 AS b, (l_linenumber - 1) * 20 + CASE WHEN l_linenumber > 3 THEN 5 ELSE 0 END AS sa FROM lineitem),
    s AS (SELECT *, sa + CASE WHEN k = 2 THEN 20 ELSE 20 END AS sb FROM seg), cut AS (SELECT c.doc_id, c.seq, s.a, sa + greatest(byte_start - a, 0) AS low, sa + least(byte_end, b) - a AS high FROM cands c JOIN s ON c.doc_id = s.doc_id AND b > byte_start AND a < byte_end),
    i AS (SELECT *, CASE WHEN lag(high) OVER (PARTITION BY doc_id, seq ORDER BY a) = low THEN 0 ELSE 1 END AS fresh FROM cut), p AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, seq ORDER BY a) - 1 AS part FROM i)
    SELECT doc_id, seq, part::BIGINT AS part, min(low)::INTEGER AS src_start, max(high)::INTEGER AS src_end FROM p GROUP BY doc_id, seq, part""")
def c3_slices(spark, sf):
    n = F.col("l_linenumber")
    src = (n - 1) * 20 + F.when(n > 3, 5).otherwise(0)
    segments = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), ((n - 1) * 20).alias("norm_start"), (n * 20).alias("norm_end"), src.alias("src_start"), (src + 20).alias("src_end"))
    found = base(spark, sf, "cands").select("doc_id", "seq", F.col("byte_start").alias("norm_start"), F.col("byte_end").alias("norm_end"))
    return cd.slices(found, segments)


@_query("""SELECT doc_id, seq, sha256('["regex:v1",{"bounding_region":null,"byte_end":' || byte_end || ',"byte_start":' || byte_start || ',"page_ref":null,"source_ref":{"content_hash":null,"source_id":"' || doc_id || '"},"text_anchor_space":"normalized_text"},[],null]') AS candidate_id FROM cands""")
def c12_candidate_ids(spark, sf):
    return cd.with_ids(base(spark, sf, "cands").drop("candidate_id"), "regex:v1").select("doc_id", "seq", "candidate_id")


@_query("SELECT doc_id, field_id, byte_start::VARCHAR AS candidate_id, count(*) AS n FROM cands GROUP BY ALL HAVING count(*) > 1")
def c13_duplicate_ids(spark, sf):
    return cd.duplicate_ids(base(spark, sf, "cands").withColumn("candidate_id", F.col("byte_start").cast("string")))


@_query("""u AS (SELECT *, 0 AS s, 'first' AS src FROM cands UNION ALL SELECT * REPLACE (CASE WHEN seq % 2 = 0 THEN byte_end ELSE byte_end + 1 END AS byte_end), 1, 'second' FROM cands),
    k AS (SELECT doc_id, field_id, text, byte_start, byte_end, entity_type, min(struct_pack(s := s, q := seq)) AS first, count(DISTINCT src) AS n, min(src ORDER BY src) AS src FROM u GROUP BY ALL)
    SELECT doc_id, field_id, (row_number() OVER (PARTITION BY doc_id, field_id ORDER BY first.s, first.q) - 1)::INTEGER AS seq, text, byte_start, byte_end, CASE WHEN n = 2 THEN 'first|second' ELSE src END AS source_id FROM k""")
def c15_merge(spark, sf):
    c = base(spark, sf, "cands")
    other = c.withColumn("byte_end", F.when(F.col("seq") % 2 == 0, F.col("byte_end")).otherwise(F.col("byte_end") + 1))
    return cd.merge([c.withColumn("source_id", F.lit("first")), other.withColumn("source_id", F.lit("second"))]).select("doc_id", "field_id", "seq", "text", "byte_start", "byte_end", "source_id")


@_query("""w AS (SELECT DISTINCT doc_id, greatest(p - 40, 0) AS s, least(p + 5 + 60, n) AS e FROM (SELECT doc_id, length(text) AS n, unnest(range(0, length(text) - 5, 97)) AS p FROM documents WHERE length(text) > 5)),
    r AS (SELECT *, row_number() OVER x - 1 AS rank, sum(e - s) OVER x AS total, count(*) OVER (PARTITION BY doc_id) AS all_n FROM w WINDOW x AS (PARTITION BY doc_id ORDER BY s, e)), k AS (SELECT * FROM r WHERE rank < 12 AND total <= 700)
    SELECT doc_id, rank::INTEGER AS rank, s::INTEGER AS char_start, e::INTEGER AS char_end, all_n - count(*) OVER (PARTITION BY doc_id) AS overflow FROM k""")
def c17_context_windows(spark, sf):
    docs = table(spark, sf, "documents").where(F.length("text") > 5)
    found = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.length("text") - 6, F.lit(97))).alias("char_start")).withColumns({"char_end": F.col("char_start") + 5, "term": F.lit("t")})
    return cd.context_windows(found, 40, 60, 1500, 12, 700).drop("terms")


@_query("""x AS (SELECT doc_id, text, least(length(text) // 2, 400) AS a FROM documents), y AS (SELECT *, text[1:a] AS head, text[a + 11:] AS tail FROM x)
    SELECT doc_id, (CASE WHEN contains(head, chr(10)) THEN length(head) - length(regexp_extract(head, '[^\\n]*$')) ELSE 0 END)::INTEGER AS start,
    (CASE WHEN contains(tail, chr(10)) THEN a + 10 + instr(tail, chr(10)) - 1 ELSE length(text) END)::INTEGER AS "end" FROM y""")
def c18_snap(spark, sf):
    a = F.least(F.floor(F.length("text") / 2), F.lit(400)).cast("int")
    s = cd.snap(F.col("text"), a, a + 10)
    return table(spark, sf, "documents").select("doc_id", s["start"].alias("start"), s["end"].alias("end"))


@_query("""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    b AS (SELECT doc_id, i, t, coalesce(sum(strlen(t) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM l),
    h AS (SELECT *, len(regexp_extract_all(t, '[0-9]+')) AS n FROM b)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INTEGER AS instance, s::INTEGER AS line_start, (s + strlen(t))::INTEGER AS line_end, n::INTEGER AS candidates, t AS context FROM h WHERE n > 0""")
def c21_line_instances(spark, sf):
    docs = table(spark, sf, "documents")
    found = cd.regex_native(docs, "[0-9]+").withColumn("candidate_id", F.col("seq").cast("string"))
    return cd.line_instances(found, docs).select("doc_id", "instance", "line_start", "line_end", F.size("candidate_ids").alias("candidates"), "context")


@_query("SELECT doc_id, seq FROM cands SEMI JOIN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax > 0.05) t ON doc_id = l_orderkey AND seq = l_linenumber")
def c22_subset(spark, sf):
    chosen = table(spark, sf, "lineitem").where("l_tax > 0.05").select(F.col("l_orderkey").alias("doc_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("candidate_id"))
    return cd.subset(base(spark, sf, "cands"), chosen).select("doc_id", "seq")


# filters

_IN = "EXISTS (SELECT 1 FROM cands o WHERE o.doc_id = c.doc_id AND o.field_id = c.field_id AND o.byte_start <= c.byte_start AND o.byte_end >= c.byte_end AND (o.byte_start <> c.byte_start OR o.byte_end <> c.byte_end){more})"
_HAS = "EXISTS (SELECT 1 FROM cands o WHERE o.doc_id = c.doc_id AND o.field_id = c.field_id AND o.byte_start >= c.byte_start AND o.byte_end <= c.byte_end AND (o.byte_start <> c.byte_start OR o.byte_end <> c.byte_end))"


def _filtered(name: str, expr: fl.Expr, condition: str) -> None:
    _query(f"SELECT doc_id, field_id, seq FROM cands c WHERE {condition}", name)(lambda spark, sf: fl.apply(base(spark, sf, "cands"), expr).select("doc_id", "field_id", "seq"))


_filtered("p1_label_in", fl.LabelIn(("A",)), "coalesce(entity_type IN ('A'), false)")
_filtered("p1_label_not_in", fl.LabelNotIn(("A",)), "coalesce(entity_type NOT IN ('A'), true)")
_filtered("p2_contained_by", fl.ContainedBy(), _IN.format(more=""))
_filtered("p2_contained_by_label", fl.And((fl.ContainedBy("R"), fl.Not(fl.LabelIn(("R",))))), _IN.format(more=" AND o.entity_type = 'R'") + " AND coalesce(entity_type, '') <> 'R'")
_filtered("p3_contains", fl.Contains(), _HAS)
_filtered("p4_numeric_range", fl.NumericRange(10, 30, True, False), "text[2:]::INTEGER >= 10 AND text[2:]::INTEGER < 30")
_filtered("p5_context", fl.ContextContains(any_of=("O NEAR", "x"), all_of=("near",)), "lower(context) LIKE '%o near%'")
_filtered("p6_boolean", fl.Or((fl.And((fl.LabelIn(("A",)), fl.Not(fl.ContainedBy()))), fl.NumericRange(low=45))), f"(coalesce(entity_type = 'A', false) AND NOT {_IN.format(more='')}) OR text[2:]::INTEGER >= 45")


@_query(f"SELECT doc_id, field_id, seq, CASE WHEN coalesce(entity_type, '') <> 'A' THEN 'entity_type ' || coalesce('''' || entity_type || '''', 'None') || ' not in labels=(''A'',)' ELSE 'negated expression matched' END AS reason FROM cands c WHERE NOT (coalesce(entity_type = 'A', false) AND NOT {_IN.format(more='')})")
def p7_drops(spark, sf):
    return fl.drops(base(spark, sf, "cands"), fl.And((fl.LabelIn(("A",)), fl.Not(fl.ContainedBy())))).select("doc_id", "field_id", "seq", "reason")


@_query("SELECT p_partkey, list_filter([CASE WHEN NOT (p_brand IN ('Brand#11', 'Brand#12')) THEN 'p_brand' END, CASE WHEN NOT (p_retailprice BETWEEN 900 AND 1500) THEN 'p_retailprice' END, CASE WHEN NOT (p_size % 2 = 0) THEN 'p_size' END], lambda x: x IS NOT NULL)::VARCHAR AS failed FROM part")
def p8_structural(spark, sf):
    contract = {"p_brand": ("set", ("Brand#11", "Brand#12")), "p_retailprice": ("range", (900, 1500)), "p_size": ("predicate", "p_size % 2 = 0")}
    out = fl.structural_status(table(spark, sf, "part"), contract)
    return out.select("p_partkey", F.concat(F.lit("["), F.array_join(F.col("failures.field"), ", "), F.lit("]")).alias("failed"))


@_query("""SELECT doc_id, field_id, CASE WHEN outcome = 'ABSTAINED' AND k > 0 THEN 'abstained_with_ids' WHEN outcome = 'AMBIGUOUS' AND k = 0 THEN 'ambiguous_without_ids' END AS violation FROM obs""")
def p9_selection_contract(spark, sf):
    ids = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda x: x.cast("string"))
    ids = F.when(F.col("k") > 0, ids).otherwise(F.array().cast("array<string>"))
    return base(spark, sf, "obs").select("doc_id", "field_id", fl.selection_violation(F.col("outcome"), ids, F.array(*(F.lit(str(k)) for k in range(3)))).alias("violation"))


@_query("""a AS (SELECT doc_id, field_id, count(*) AS n FROM cands WHERE seq > 2 GROUP BY ALL)
    SELECT coalesce(s.doc_id, a.doc_id) AS doc_id, coalesce(s.field_id, a.field_id) AS field_id, CASE WHEN s.doc_id IS NULL THEN 'unknown' WHEN n IS NULL THEN 'missing' ELSE 'duplicate' END AS violation
    FROM (SELECT * FROM sets WHERE field_id <> 'party') s FULL JOIN a ON s.doc_id = a.doc_id AND s.field_id = a.field_id WHERE s.doc_id IS NULL OR n IS NULL OR n > 1""")
def p10_batch_contract(spark, sf):
    return fl.batch_violations(base(spark, sf, "sets").where("field_id <> 'party'"), base(spark, sf, "cands").where("seq > 2"))


# selection


@_query("SELECT doc_id, field_id, max(candidate_id) FILTER (WHERE structural_passed) AS candidate_id FROM cands GROUP BY ALL HAVING count(*) FILTER (WHERE structural_passed) = 1")
def d1_gate(spark, sf):
    return sel.gate(base(spark, sf, "cands"))


@_query("""g AS (SELECT doc_id, field_id, count(*) AS n, string_agg(candidate_id, ',' ORDER BY seq) AS ids FROM cands GROUP BY ALL)
    SELECT doc_id, field_id, CASE WHEN n IS NULL THEN 'NO_CANDIDATES' WHEN n = 1 THEN 'SELECTED' ELSE 'AMBIGUOUS' END AS outcome, coalesce(ids, '') AS ids, CASE WHEN n > 1 THEN 'algorithmic_multi_candidate' END AS reason FROM sets LEFT JOIN g USING (doc_id, field_id)""")
def d2_singleton(spark, sf):
    return sel.singleton(base(spark, sf, "sets"), base(spark, sf, "cands")).select("doc_id", "field_id", "outcome", F.array_join("selected_candidate_ids", ",").alias("ids"), "reason")


_RULES = [("legal", "License", "positive"), ("mail", "@mail", "positive"), ("legal", "\\btoken\\b", "negative"), ("mail", "###", "ambiguous")]


@_query("""s AS (SELECT doc_id, regexp_matches(text, 'License') AS legal, regexp_matches(text, '@mail') AS mail, regexp_matches(text, '\\btoken\\b') AS bad, contains(text, '###') AS odd FROM documents), n AS (SELECT *, (legal AND NOT bad)::INT + mail::INT AS k FROM s)
    SELECT doc_id, CASE WHEN odd OR k <> 1 THEN 'ABSTAINED' ELSE 'SELECTED' END AS outcome, CASE WHEN odd OR k <> 1 THEN '' WHEN mail THEN 'mail' ELSE 'legal' END AS literals, 'rule_based_category.' || CASE WHEN odd THEN 'ambiguous_signal' WHEN k > 1 THEN 'conflicting_positive_signals' WHEN k = 0 THEN 'no_signal' ELSE 'single_match' END AS reason FROM n""")
def d3_category(spark, sf):
    return sel.category(table(spark, sf, "documents"), ["legal", "mail"], _RULES).withColumn("literals", F.array_join("literals", ","))


@_query("SELECT doc_id, 'legal' AS literal, 'positive' AS polarity, len(regexp_extract_all(text, 'License'))::INTEGER AS n FROM documents WHERE contains(text, 'License')")
def d4_signals(spark, sf):
    return sel.category_signals(table(spark, sf, "documents"), _RULES[:1])


@_query("SELECT doc_id, field_id, seq, 'c' || lpad((row_number() OVER (PARTITION BY doc_id, field_id ORDER BY seq))::VARCHAR, 3, '0') AS prompt_id FROM cands")
def d8_prompt_ids(spark, sf):
    return sel.prompt_ids(base(spark, sf, "cands")).select("doc_id", "field_id", "seq", "prompt_id")


@_query("""u AS (SELECT *, max(byte_end) OVER (PARTITION BY doc_id, field_id ORDER BY byte_start, byte_end, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM cands),
    i AS (SELECT *, sum(CASE WHEN byte_start <= m THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, field_id ORDER BY byte_start, byte_end, seq ROWS UNBOUNDED PRECEDING) - 1 AS context_no FROM u)
    SELECT doc_id, field_id, context_no::BIGINT AS context, min(byte_start) AS start, max(byte_end) AS "end", count(*) AS n FROM i GROUP BY doc_id, field_id, context_no""")
def d10_merged_contexts(spark, sf):
    return sel.merged_contexts(base(spark, sf, "cands"))


@_query("""t AS (SELECT doc_id, field_id, CASE WHEN seq % 2 = 0 THEN context ELSE split_part(context, ' ', 1) END AS x, count(*) AS n FROM cands GROUP BY ALL)
    SELECT doc_id, field_id, x AS context, n FROM t WHERE NOT EXISTS (SELECT 1 FROM t o WHERE o.doc_id = t.doc_id AND o.field_id = t.field_id AND length(o.x) > length(t.x) AND contains(o.x, t.x))""")
def d11_interned_contexts(spark, sf):
    short = F.when(F.col("seq") % 2 == 0, F.col("context")).otherwise(F.split("context", " ")[0])
    return sel.interned_contexts(base(spark, sf, "cands").withColumn("context", F.concat(F.lit("  "), short, F.lit("\n"))))


@_query("""RECURSIVE t AS (SELECT l_orderkey AS doc_id, l_linenumber AS seq, CAST(l_quantity AS BIGINT) AS size, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM lineitem),
    f AS (SELECT doc_id, seq, size, k, 0 AS shard, size AS used FROM t WHERE k = 1 UNION ALL SELECT t.doc_id, t.seq, t.size, t.k, CASE WHEN used + t.size > 60 THEN shard + 1 ELSE shard END, CASE WHEN used + t.size > 60 THEN t.size ELSE used + t.size END FROM f JOIN t ON t.doc_id = f.doc_id AND t.k = f.k + 1)
    SELECT doc_id, seq, shard, size > 60 AS oversize FROM f""")
def d12_packed(spark, sf):
    tasks = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("seq"), F.col("l_quantity").cast("long").alias("size"))
    return sel.packed(tasks, 60).select("doc_id", "seq", "shard", "oversize")


@_query("""SELECT doc_id, k::INTEGER AS "window", (k * 645)::INTEGER AS char_start, least(k * 645 + 745, length(text))::INTEGER AS char_end FROM documents, unnest(range(0, greatest(ceil((length(text) - 745) / 645.0), 0)::BIGINT + 1)) AS t(k) WHERE length(text) > 0""")
def d14_document_windows(spark, sf):
    return sel.document_windows(table(spark, sf, "documents"), 1000, 100)


@_query("SELECT doc_id, field_id, string_agg(candidate_id, ',' ORDER BY seq) AS ids FROM cands WHERE seq % 2 = 1 GROUP BY ALL")
def d15_reduce_union(spark, sf):
    c = base(spark, sf, "cands")
    one = c.where("seq % 2 = 1").groupBy("doc_id", "field_id").agg(F.sort_array(F.collect_list("candidate_id"), asc=False).alias("selected_candidate_ids"))
    return sel.reduce_union(one.unionByName(one), c).select("doc_id", "field_id", F.array_join("selected_candidate_ids", ",").alias("ids"))


@_query("""x AS (SELECT doc_id, field_id, entity_type AS lit, CASE entity_type WHEN 'R' THEN 1 END AS p FROM cands)
    SELECT doc_id, field_id, CASE WHEN count(lit) = 0 THEN 'ABSTAINED' WHEN count(p) = 0 THEN 'UNRANKED' ELSE 'SELECTED' END AS outcome, CASE WHEN count(p) > 0 THEN 'R' END AS literal FROM x GROUP BY doc_id, field_id""")
def d16_reduce_priority(spark, sf):
    return sel.reduce_priority(base(spark, sf, "cands").withColumn("literal", F.col("entity_type")), ["R"])


@_query("""g AS (SELECT doc_id, field_id, count(*) FILTER (WHERE structural_passed) AS p FROM cands GROUP BY ALL) SELECT doc_id, field_id, CASE WHEN p = 1 THEN 'auto' WHEN p IS NULL THEN 'empty' ELSE 'soft' END AS route FROM sets LEFT JOIN g USING (doc_id, field_id)""")
def d23_presplit(spark, sf):
    return sel.presplit(base(spark, sf, "sets"), base(spark, sf, "cands"))


# validation

_CARDINALITY = [("one", "ONE"), ("maybe", "OPTIONAL"), ("several", "MANY"), ("each", "PER_INSTANCE")]
_VERDICT = """CASE WHEN outcome <> 'SELECTED' THEN 'selection/' || lower(outcome) WHEN k = 0 AND field_id IN ('one', 'each') THEN 'adaptation/empty_selection' WHEN k = 0 AND field_id = 'maybe' THEN 'selection/abstained'
    WHEN k > 1 AND field_id IN ('one', 'each') THEN 'validation/cardinality.one_expected_many_selected' WHEN k > 1 AND field_id = 'maybe' THEN 'validation/cardinality.optional_expected_many_selected' END"""


def _observations(spark, sf):
    ids = F.expr("CASE WHEN k > 0 THEN transform(sequence(1, k), x -> concat('c', x)) ELSE CAST(array() AS ARRAY<STRING>) END")
    return base(spark, sf, "obs").withColumn("selected_candidate_ids", ids), spark.createDataFrame(_CARDINALITY, "field_id string, cardinality string")


@_query(f"v AS (SELECT *, {_VERDICT} AS verdict FROM obs) SELECT doc_id, field_id, split_part(verdict, '/', 1) AS category, split_part(verdict, '/', 2) AS code, coalesce(reason, split_part(verdict, '/', 2)) AS reason, k AS candidate_count FROM v WHERE verdict IS NOT NULL")
def v1_cardinality_negatives(spark, sf):
    return va.cardinality_negatives(*_observations(spark, sf))


@_query(f"v AS (SELECT *, {_VERDICT} AS verdict FROM obs) SELECT doc_id, field_id, (i - 1)::INTEGER AS \"position\", 'c' || i AS candidate_id, 'text ' || i AS raw_value FROM v, unnest(range(1, k + 1)) AS t(i) WHERE verdict IS NULL")
def v3_proposed(spark, sf):
    o, fields = _observations(spark, sf)
    c = o.select("doc_id", "field_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i")).select("doc_id", "field_id", F.concat(F.lit("c"), "i").alias("candidate_id"), F.concat(F.lit("text "), "i").alias("text"), F.lit(0).alias("byte_start"), F.lit(1).alias("byte_end"))
    return va.proposed(o, c, fields).drop("byte_start", "byte_end")


@_query("""f AS (SELECT doc_id, text, (doc_id % 40)::INT AS a, (doc_id % 40 + doc_id % 900)::INT AS b, CASE WHEN doc_id % 9 < 4 THEN 'normalized_text' ELSE 'source_bytes' END AS space, CASE WHEN doc_id % 2 = 0 THEN 'normalized_text' ELSE 'source_bytes' END AS declared FROM documents),
    x AS (SELECT *, strlen(text) AS n, hex(encode(text)) AS h FROM f), y AS (SELECT *, a > b OR b > n AS o, (a < n AND substr(h, 2 * a + 1, 1) IN ('8', '9', 'A', 'B')) OR (b < n AND substr(h, 2 * b + 1, 1) IN ('8', '9', 'A', 'B')) AS cut FROM x)
    SELECT doc_id, CASE WHEN space <> declared AND NOT (space = 'normalized_text' AND a = 0 AND b = 0) THEN 'candidate.text_anchor_space_mismatch' WHEN space = 'normalized_text' AND (o OR cut) THEN 'candidate.utf8_alignment' WHEN space = 'source_bytes' AND o THEN 'candidate.span_out_of_range' END AS code FROM y""")
def v4_layer1(spark, sf):
    docs = table(spark, sf, "documents")
    a = F.col("doc_id") % 40
    fields = docs.select("doc_id", a.cast("int").alias("byte_start"), (a + F.col("doc_id") % 900).cast("int").alias("byte_end"), F.when(F.col("doc_id") % 9 < 4, "normalized_text").otherwise("source_bytes").alias("space"))
    declared = F.when(F.col("doc_id") % 2 == 0, "normalized_text").otherwise("source_bytes")
    return va.layer1(fields, docs.select("doc_id", "text", declared.alias("space"))).select("doc_id", "code")


_RAW = "SELECT o_orderkey AS doc_id, CASE o_orderkey % 4 WHEN 0 THEN 'int' WHEN 1 THEN 'date' WHEN 2 THEN 'bool' ELSE 'str' END AS kind, CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN o_custkey % 3 = 0 THEN ' 12 ' ELSE '20 items' END WHEN 1 THEN CASE WHEN o_custkey % 3 = 0 THEN '2020-04-13' WHEN o_custkey % 3 = 1 THEN '2020-13-01' ELSE 'April 13' END WHEN 2 THEN CASE WHEN o_custkey % 3 = 0 THEN 'Yes' WHEN o_custkey % 3 = 1 THEN 'off' ELSE 'maybe' END ELSE o_orderpriority END AS raw_value FROM {orders}"


@_query("r AS (" + _RAW.replace("{orders}", "orders") + """), n AS (SELECT *, CASE kind WHEN 'str' THEN raw_value WHEN 'int' THEN CASE WHEN trim(raw_value) = '12' THEN '12' END WHEN 'date' THEN CASE WHEN raw_value = '2020-04-13' THEN raw_value END ELSE CASE raw_value WHEN 'Yes' THEN 'true' WHEN 'off' THEN 'false' END END AS normalized_value FROM r)
    SELECT doc_id, kind, normalized_value, CASE WHEN normalized_value IS NULL THEN 'field_failure' END AS code FROM n""")
def v5_layer2(spark, sf):
    return va.layer2(spark.sql(_RAW, orders=table(spark, sf, "orders"))).select("doc_id", "kind", "normalized_value", "code")


@_query("r AS (" + _RAW.replace("{orders}", "orders") + """) SELECT doc_id, CASE WHEN kind = 'int' AND raw_value = '20 items' THEN NULL WHEN kind = 'int' THEN '12' ELSE raw_value END AS normalized_value, CASE WHEN kind = 'int' AND raw_value = '20 items' THEN 'field_failure' END AS code FROM r""")
def v6_layer2_python(spark, sf):
    rows = spark.sql(_RAW, orders=table(spark, sf, "orders")).withColumn("field_id", F.col("kind"))
    return va.layer2_python(rows, {"int": int, "date": lambda v: None}).select("doc_id", "normalized_value", "code")


@_query("""l AS (SELECT l_orderkey AS doc_id, max(CAST(l_quantity AS INT)) FILTER (WHERE l_linenumber = 1) AS a, max(CAST(l_quantity AS INT)) FILTER (WHERE l_linenumber = 2) AS b FROM lineitem GROUP BY ALL)
    SELECT doc_id, 'ordered' AS rule, 'error' AS severity FROM l WHERE NOT a <= b UNION ALL SELECT doc_id, 'small' AS rule, 'warning' AS severity FROM l WHERE NOT a < 40""")
def v8_cross_field(spark, sf):
    values = table(spark, sf, "lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_linenumber") == 1, "a").otherwise("b").alias("field_id"), F.col("l_linenumber").alias("seq"), F.col("l_quantity").cast("int").cast("string").alias("normalized_value"))
    return va.cross_field(values, {"ordered": ("CAST(a AS INT) <= CAST(b AS INT)", ["a", "b"], "error"), "small": ("CAST(a AS INT) < 40", ["a"], "warning")}).drop("implicates")


@_query("""o AS (SELECT o_orderkey AS doc_id, 'complete' AS outcome FROM orders), i AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_tax > 0.07)
    SELECT doc_id, CASE WHEN l_orderkey IS NOT NULL THEN 'partial' ELSE outcome END AS outcome FROM o LEFT JOIN i ON doc_id = l_orderkey""")
def v10_escalated(spark, sf):
    issues = table(spark, sf, "lineitem").where("l_tax > 0.06").select(F.col("l_orderkey").alias("doc_id"), F.lit("r").alias("rule"), F.when(F.col("l_tax") > 0.07, "error").otherwise("warning").alias("severity"))
    return va.escalated(table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("complete").alias("outcome")), issues).drop("errors")


@_query("SELECT doc_id, field_id, seq, CASE WHEN doc_id % 3 = 0 THEN 'second' ELSE 'first' END AS pass, CASE field_id WHEN 'party' THEN 0 ELSE 1 END AS ordinal FROM cands")
def v13_repaired(spark, sf):
    c = base(spark, sf, "cands").select("doc_id", "field_id", "seq")
    return va.repaired(c.withColumn("pass", F.lit("first")), c.withColumn("pass", F.lit("second")), c.where("doc_id % 3 = 0"), ["party", "amount"])


# instances

_FIELDS = "SELECT *, concat('g', CAST(seq % 4 AS STRING)) AS tentative_key, seq % 2 = 0 AS boundary_defining, CASE WHEN field_id = 'amount' THEN 'ONE' ELSE 'PER_INSTANCE' END AS cardinality, text AS value, array(candidate_id) AS candidate_ids FROM {cands}"
#: Candidates that fields refer to, some of which aren't there, and none of which lies where its field does.
_REFERRED = "SELECT doc_id, field_id, candidate_id, byte_start + 20 AS byte_start, byte_end + 20 AS byte_end FROM {cands} WHERE seq % 5 <> 0"
_AUTHORITY = f"""f AS ({_FIELDS.replace('{cands}', 'cands').replace('array(candidate_id)', '[candidate_id]')}), cs AS ({_REFERRED.replace('{cands}', 'cands')}), p AS (SELECT f.doc_id, field_id, seq, ordinal, 1 AS a FROM f JOIN keys k ON f.doc_id = k.doc_id AND tentative_key = group_id WHERE boundary_defining
    UNION ALL SELECT f.doc_id, field_id, seq, ordinal, 2 FROM f JOIN keys k ON f.doc_id = k.doc_id AND byte_start < anchor_end AND anchor_start < byte_end AND byte_start < byte_end
    UNION ALL SELECT doc_id, field_id, seq, ordinal, 3 FROM (SELECT f.doc_id, f.field_id, f.seq, ordinal, rank() OVER (PARTITION BY f.doc_id, f.field_id, f.seq ORDER BY greatest(anchor_start - cs.byte_end, cs.byte_start - anchor_end, 0)) AS r FROM f JOIN cs ON f.doc_id = cs.doc_id AND f.field_id = cs.field_id AND f.candidate_id = cs.candidate_id JOIN keys k ON f.doc_id = k.doc_id) WHERE r = 1
    UNION ALL SELECT f.doc_id, field_id, seq, ordinal, 4 FROM f JOIN keys k ON f.doc_id = k.doc_id AND tentative_key = group_id),
    s AS (SELECT doc_id, field_id, seq, a, count(DISTINCT ordinal) AS n, min(ordinal) AS bucket FROM p GROUP BY ALL),
    d AS (SELECT doc_id, field_id, seq, min(a) FILTER (WHERE n = 1) AS a, arg_min(bucket, a) FILTER (WHERE n = 1) AS bucket, min(a) FILTER (WHERE a > 1) AS strongest, arg_min(bucket, a) FILTER (WHERE a > 1) AS hint FROM s GROUP BY ALL),
    assigned AS (SELECT f.*, d.bucket, d.a, d.strongest, CASE WHEN d.bucket IS NULL THEN coalesce(d.hint, 0) END AS target FROM f LEFT JOIN d USING (doc_id, field_id, seq))"""
_NAMED = "CASE {c} WHEN 1 THEN 'boundary' WHEN 2 THEN 'continuity' WHEN 3 THEN 'cooccurrence' WHEN 4 THEN 'prior' END"


def _assigned(spark, sf):
    fields = spark.sql(_FIELDS, cands=base(spark, sf, "cands"))
    return ins.assign(fields, base(spark, sf, "keys"), candidates=spark.sql(_REFERRED, cands=base(spark, sf, "cands")))


@_query(f"{_AUTHORITY} SELECT doc_id, field_id, seq, coalesce(bucket, -1) AS bucket, {_NAMED.format(c='a')} AS authority, CASE WHEN a IS NULL THEN {_NAMED.format(c='strongest')} END AS ambiguous_on, coalesce(target, -1) AS target FROM assigned")
def g7_assign(spark, sf):
    return _assigned(spark, sf).select("doc_id", "field_id", "seq", F.coalesce("bucket", F.lit(-1)).alias("bucket"), "authority", "ambiguous_on", F.coalesce("target", F.lit(-1)).alias("target"))


_POLICY = f"""{_AUTHORITY}, j AS (SELECT *, CASE WHEN bucket IS NULL THEN 'ambiguous_grouping' WHEN cardinality = 'ONE' AND (SELECT count(DISTINCT x.bucket) FROM assigned x WHERE x.doc_id = assigned.doc_id AND x.field_id = assigned.field_id) > 1 THEN 'cardinality.one_multiple_instances'
    WHEN cardinality = 'PER_INSTANCE' AND count(*) OVER (PARTITION BY doc_id, field_id, bucket) > 1 THEN 'cardinality.per_instance_multi_in_instance' END AS code FROM assigned)"""


@_query(f"{_POLICY} SELECT doc_id, field_id, seq, code FROM j")
def g9_cardinality_policy(spark, sf):
    return ins.cardinality_policy(_assigned(spark, sf)).select("doc_id", "field_id", "seq", "code")


@_query(f"""{_POLICY}, b AS (SELECT doc_id, coalesce(bucket, target) AS b, coalesce(string_agg(field_id || '/' || seq || '/' || value, ',' ORDER BY field_id, seq) FILTER (WHERE code IS NULL), '') AS fields,
        coalesce(array_to_string(list_sort(list(DISTINCT field_id || ':' || code) FILTER (WHERE code IS NOT NULL)), ','), '') AS negatives FROM j GROUP BY ALL),
    spans AS (SELECT doc_id, coalesce(bucket, target) AS b, byte_start, byte_end, min(struct_pack(field_id, seq)) AS first FROM j WHERE code IS NULL GROUP BY ALL),
    n AS (SELECT doc_id, b, string_agg(byte_start || '-' || byte_end, ',' ORDER BY first) AS anchors FROM spans GROUP BY ALL)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY b) - 1)::INTEGER AS ordinal, fields, negatives, coalesce(anchors, '') AS anchors, CASE WHEN negatives = '' THEN 'complete' ELSE 'partial' END AS outcome FROM b LEFT JOIN n USING (doc_id, b)""")
def g10_compose(spark, sf):
    out = ins.compose(ins.cardinality_policy(_assigned(spark, sf)))
    fields = F.array_join(F.transform("fields", lambda x: F.concat_ws("/", x["field_id"], x["seq"], x["value"])), ",")
    anchors = F.array_join(F.transform("anchors", lambda x: F.concat_ws("-", x["start"], x["end"])), ",")
    return out.select("doc_id", "ordinal", fields.alias("fields"), F.array_join("negatives", ",").alias("negatives"), anchors.alias("anchors"), "outcome")


@_query(f"{_AUTHORITY} SELECT doc_id, bucket, {_NAMED.format(c='a')} AS authority, count(*) AS n FROM assigned WHERE bucket IS NOT NULL GROUP BY ALL")
def g11_signals(spark, sf):
    return ins.clustering_signals(_assigned(spark, sf))


@_query(f"{_AUTHORITY}, q AS (SELECT doc_id, bucket, field_id || '/' || {_NAMED.format(c='a')} AS x, min(seq) AS s FROM assigned WHERE bucket IS NOT NULL GROUP BY ALL) SELECT doc_id, bucket, string_agg(x, ',' ORDER BY s, x) AS discriminators FROM q GROUP BY doc_id, bucket")
def g12_discriminators(spark, sf):
    return ins.discriminators(_assigned(spark, sf)).withColumn("discriminators", F.array_join("discriminators", ","))


@_query("SELECT c.doc_id, c.seq, k.ordinal, (c.byte_start < anchor_end AND anchor_start < c.byte_end AND c.byte_start < c.byte_end) AS touches, greatest(anchor_start - byte_end, byte_start - anchor_end, 0)::INTEGER AS gap FROM cands c JOIN keys k ON c.doc_id = k.doc_id")
def g1_overlap_and_gap(spark, sf):
    both = base(spark, sf, "cands").join(base(spark, sf, "keys"), "doc_id")
    four = [F.col(c) for c in ("byte_start", "byte_end", "anchor_start", "anchor_end")]
    return both.select("doc_id", "seq", "ordinal", tx.overlap(*four).alias("touches"), tx.gap(*four).alias("gap"))


@_query("""a AS (SELECT doc_id, anchor_start, anchor_end, min(ordinal) AS s FROM keys GROUP BY ALL)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INTEGER AS ordinal, sha256('[' || anchor_start || ',' || anchor_end || ']') AS group_id, anchor_start, anchor_end, CASE WHEN count(*) OVER (PARTITION BY doc_id) > 2 THEN 'max_exceeded' END AS violation FROM a""")
def g14_plan_keys(spark, sf):
    return ins.plan_keys(base(spark, sf, "keys").withColumn("seq", F.col("ordinal")), 2)


@_query("""s AS (SELECT doc_id, byte_start, byte_end, min(seq) AS q FROM cands GROUP BY ALL) SELECT doc_id, 0 AS ordinal, string_agg(byte_start || '-' || byte_end, ',' ORDER BY q) AS anchors FROM s GROUP BY doc_id""")
def g8_initial_keys(spark, sf):
    shown = F.array_join(F.transform("anchors", lambda x: F.concat_ws("-", x["start"], x["end"])), ",")
    return ins.initial_keys(base(spark, sf, "cands")).withColumn("anchors", shown)


@_query("""b AS (SELECT o_custkey AS doc_id, count(*) AS n, bool_and(o_orderstatus = 'F') AS w FROM orders GROUP BY ALL) SELECT c_custkey AS doc_id, CASE WHEN n IS NULL THEN 'failed' WHEN w THEN 'complete' ELSE 'partial' END AS outcome, coalesce(n, 0) AS instances FROM customer LEFT JOIN b ON c_custkey = doc_id""")
def r2_roll_up(spark, sf):
    instances = table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "F", "complete").otherwise("partial").alias("outcome"))
    return ins.roll_up(table(spark, sf, "customer").select(F.col("c_custkey").alias("doc_id")), instances)


@_query("""SELECT doc_id, ordinal, arg_max(value, seq) FILTER (WHERE field_id = 'total') AS total, arg_max(value, seq) FILTER (WHERE field_id = 'note') AS note, coalesce(string_agg(value, ',' ORDER BY seq) FILTER (WHERE field_id = 'tag'), '') AS tag, CASE WHEN count(*) FILTER (WHERE field_id = 'total') = 0 THEN 'total' ELSE '' END AS missing FROM cells GROUP BY doc_id, ordinal""")
def r5_materialize(spark, sf):
    out = ins.materialize(base(spark, sf, "cells"), [("total", "ONE"), ("note", "OPTIONAL"), ("tag", "MANY")])
    return out.withColumns({"tag": F.array_join("tag", ","), "missing": F.array_join("missing", ",")})


@_query("""i AS (SELECT o_custkey AS doc_id, count(*) AS n FROM orders GROUP BY ALL), e AS (SELECT DISTINCT o_custkey AS doc_id FROM orders WHERE o_orderpriority = '1-URGENT') SELECT o_custkey AS doc_id, o_orderkey AS ordinal, CASE WHEN e.doc_id IS NOT NULL AND n > 1 THEN 'error' WHEN e.doc_id IS NOT NULL THEN 'partial' ELSE 'complete' END AS outcome FROM orders JOIN i ON o_custkey = i.doc_id LEFT JOIN e ON o_custkey = e.doc_id""")
def r1_attach_negatives(spark, sf):
    o = table(spark, sf, "orders").withColumn("doc_id", F.col("o_custkey"))
    instances = o.select("doc_id", F.col("o_orderkey").alias("ordinal"), F.lit("complete").alias("outcome"), F.array().cast("array<string>").alias("negatives"))
    return ins.attach_negatives(instances, o.where("o_orderpriority = '1-URGENT'").select("doc_id", F.lit("f").alias("field_id"), F.lit("c").alias("code"))).drop("negatives")


@_query("SELECT o_custkey AS doc_id, count(*) = 1 AND bool_and(o_orderstatus = 'F') AS ok FROM orders GROUP BY ALL")
def r6_extract_one(spark, sf):
    return ins.extract_one(table(spark, sf, "orders").select(F.col("o_custkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "F", "complete").otherwise("partial").alias("outcome")))


# deferred calls


@_query("""SELECT event_id, sha256('{"output_model_ref":"m","routing":{"document_id":"d' || user_id || '","field_id":"' || event_type || '",' || CASE WHEN event_id % 3 = 0 THEN '' ELSE '"shard_index":' || event_id % 3 || ',' END || '"window_index":' || event_id % 2 || '},"soft_call_identity":"select:' || event_type || '","spec_hash":"s' || event_id % 2 || '"}') AS request_id FROM events""")
def q1_request_id(spark, sf):
    calls = table(spark, sf, "events").select("event_id", F.concat(F.lit("d"), "user_id").alias("document_id"), F.col("event_type").alias("field_id"), F.expr("nullif(event_id % 3, 0)").alias("shard_index"), (F.col("event_id") % 2).alias("window_index"), F.concat(F.lit("select:"), "event_type").alias("soft_call_identity"), F.concat(F.lit("s"), F.col("event_id") % 2).alias("spec_hash"), F.lit("m").alias("output_model_ref"))
    return df_.with_request_id(calls).select("event_id", "request_id")


@_query("u AS (SELECT request_id FROM requests UNION ALL SELECT request_id FROM results) SELECT request_id, count(*) AS n FROM u GROUP BY ALL HAVING count(*) > 1")
def q3_aggregate(spark, sf):
    return df_.aggregate([base(spark, sf, "requests").select("request_id"), base(spark, sf, "results").select("request_id")])[1]


@_query("SELECT request_id, status FROM results WHERE request_id IN (SELECT request_id FROM requests)")
def q5_route(spark, sf):
    return df_.results_for(base(spark, sf, "results"), base(spark, sf, "requests"))


@_query("""r AS (SELECT request_id, count(*) AS n, count(DISTINCT status) AS k FROM results GROUP BY ALL)
    SELECT coalesce(q.request_id, r.request_id) AS request_id, CASE WHEN q.request_id IS NULL THEN 'unknown' WHEN n IS NULL THEN 'missing' WHEN k > 1 THEN 'overlapping' WHEN n > 1 THEN 'duplicate' ELSE 'ok' END AS verdict FROM requests q FULL JOIN r ON q.request_id = r.request_id""")
def q6_collect_contract(spark, sf):
    return df_.collect_contract(base(spark, sf, "requests"), base(spark, sf, "results"))


@_query("SELECT document_id, sha256(string_agg(request_id, chr(10) ORDER BY request_id)) AS fingerprint, count(*) AS n FROM requests GROUP BY ALL")
def q9_fingerprint(spark, sf):
    return df_.fingerprint(base(spark, sf, "requests"))


@_query("u AS (SELECT run_id, seq, (sum(coalesce(input_tokens, 0) + output_tokens) OVER (PARTITION BY run_id ORDER BY seq))::BIGINT AS used FROM usage) SELECT run_id, seq, used, used > 500 AS exceeded FROM u")
def q10_token_budget(spark, sf):
    return df_.token_budget(base(spark, sf, "usage"), 500).select("run_id", "seq", "used", "exceeded")


# scoring

_IOU = "CASE WHEN greatest(g.byte_end, f.byte_end) > least(g.byte_start, f.byte_start) THEN greatest(least(g.byte_end, f.byte_end) - greatest(g.byte_start, f.byte_start), 0)::DOUBLE / (greatest(g.byte_end, f.byte_end) - least(g.byte_start, f.byte_start)) ELSE 0 END"
_COMMON = "least(g.byte_end, f.byte_end) - greatest(g.byte_start, f.byte_start) > 0"
#: Written from the rules for gold evidence: the span decides first, then the text, then the context around a candidate that is part of the text.
_MATCH = """ev AS (SELECT * FROM gold WHERE text IS NOT NULL OR byte_start IS NOT NULL),
    pairs AS (SELECT g.case_id, g.field_id, gold_index, seq, kept, CASE WHEN g.byte_start IS NOT NULL AND ({span}) THEN 'span' WHEN g.text IS NULL THEN NULL WHEN contains(lower(f.text), lower(g.text)) THEN 'text' WHEN contains(lower(f.context), lower(g.text)) AND contains(lower(g.text), lower(f.text)) THEN 'context' END AS via,
        (g.byte_start IS NOT NULL AND """ + _COMMON + """) OR (g.text IS NOT NULL AND ((f.text <> '' AND contains(lower(g.text), lower(f.text))) OR (g.text <> '' AND contains(lower(f.context), lower(g.text))))) AS near
        FROM ev g JOIN found f ON g.case_id = f.case_id AND g.field_id = f.field_id),
    hits AS (SELECT case_id, field_id, gold_index, seq, kept, via FROM pairs WHERE via IS NOT NULL)"""
_SPANS = {
    "exact": "g.byte_start = f.byte_start AND g.byte_end = f.byte_end",
    "overlap": _COMMON,
    "contains": "f.byte_start >= g.byte_start AND f.byte_end <= g.byte_end",
    "contained_by": "f.byte_start <= g.byte_start AND f.byte_end >= g.byte_end",
    "iou": f"{_IOU} >= 0.5",
}
for _mode, _span in _SPANS.items():
    _query(f"{_MATCH.format(span=_span)} SELECT * FROM hits", f"e4_matches_{_mode}")(lambda spark, sf, mode=_mode: sc.matches(base(spark, sf, "gold"), base(spark, sf, "found"), mode))


@_query(f"{_MATCH.format(span=_SPANS['exact'])} SELECT * FROM hits WHERE via <> 'context'")
def e3_matches_without_context(spark, sf):
    return sc.matches(base(spark, sf, "gold"), base(spark, sf, "found"), "exact", allow_context=False)


@_query(f"{_MATCH.format(span=_SPANS['exact'])} SELECT case_id, field_id, gold_index, min(seq) AS seq FROM pairs WHERE near GROUP BY ALL")
def e5_near_misses(spark, sf):
    return sc.near_misses(base(spark, sf, "gold"), base(spark, sf, "found"))


_GOLD_FIELDS = "x AS (SELECT case_id, field_id, count(*) FILTER (WHERE text IS NOT NULL OR byte_start IS NOT NULL) AS expected, bool_or(expected_absent) AS absent FROM gold GROUP BY ALL)"


@_query(f"""{_MATCH.format(span=_SPANS['exact'])}, {_GOLD_FIELDS}, e AS (SELECT ev.case_id, ev.field_id, ev.gold_index FROM ev JOIN x USING (case_id, field_id) WHERE NOT absent),
    h AS (SELECT case_id, field_id, gold_index, count(*) AS n, count(*) FILTER (WHERE kept) AS k FROM hits GROUP BY ALL), m AS (SELECT case_id, field_id, gold_index, min(seq) AS seq FROM pairs WHERE near GROUP BY ALL)
    SELECT e.case_id, e.field_id, e.gold_index, 'candidates' AS stage, CASE WHEN m.seq IS NULL THEN 'not_generated' ELSE 'span_near_miss' END AS kind, m.seq FROM e LEFT JOIN h USING (case_id, field_id, gold_index) LEFT JOIN m USING (case_id, field_id, gold_index) WHERE h.n IS NULL
    UNION ALL SELECT e.case_id, e.field_id, e.gold_index, 'filtered_candidates', 'generated_then_filtered', hits.seq FROM e JOIN h USING (case_id, field_id, gold_index) JOIN hits USING (case_id, field_id, gold_index) WHERE h.k = 0
    UNION ALL SELECT case_id, field_id, NULL, 'comparability', 'fixture_missing_evidence', NULL FROM x WHERE NOT absent AND expected = 0""")
def e6_attributions(spark, sf):
    return sc.attributions(base(spark, sf, "gold"), base(spark, sf, "found"), "exact")


@_query(f"{_GOLD_FIELDS} SELECT * FROM x")
def e2_expected_fields(spark, sf):
    return sc.expected_fields(base(spark, sf, "gold"))


_SCORES = f"""{_MATCH.format(span=_SPANS['overlap'])}, {_GOLD_FIELDS},
    t AS (SELECT case_id, field_id, count(*) AS raw, count(*) FILTER (WHERE kept) AS kept FROM found GROUP BY ALL), h AS (SELECT case_id, field_id, count(DISTINCT gold_index) AS raw_hits, count(DISTINCT gold_index) FILTER (WHERE kept) AS kept_hits, count(DISTINCT seq) AS raw_true, count(DISTINCT seq) FILTER (WHERE kept) AS kept_true FROM hits GROUP BY ALL),
    j AS (SELECT case_id, field_id, absent, absent OR expected > 0 AS comparable, expected AS e0, coalesce(raw, 0) AS r0, coalesce(t.kept, 0) AS k0, coalesce(raw_hits, 0) AS rh, coalesce(kept_hits, 0) AS kh, coalesce(raw_true, 0) AS rt, coalesce(kept_true, 0) AS kt FROM x LEFT JOIN t USING (case_id, field_id) LEFT JOIN h USING (case_id, field_id)),
    rows_ AS (SELECT case_id, field_id, absent, comparable, CASE WHEN absent THEN 0 ELSE e0 END AS expected, CASE WHEN comparable THEN r0 ELSE 0 END AS raw, CASE WHEN comparable THEN k0 ELSE 0 END AS kept,
        CASE WHEN absent THEN 0 ELSE rh END AS raw_hits, CASE WHEN absent THEN 0 ELSE kh END AS kept_hits, CASE WHEN absent THEN 0 ELSE rt END AS raw_true, CASE WHEN absent THEN 0 ELSE kt END AS kept_true FROM j),
    gaps AS (SELECT *, CASE WHEN NOT comparable THEN 'comparability_failure' WHEN absent AND raw > 0 THEN 'unexpected_observed' WHEN NOT absent AND raw_hits < expected THEN 'missing_expected' END AS raw_gap,
        CASE WHEN NOT comparable THEN 'comparability_failure' WHEN absent AND kept > 0 THEN 'unexpected_observed' WHEN NOT absent AND kept_hits < expected THEN 'missing_expected' END AS kept_gap FROM rows_)"""


@_query(f"""{_SCORES} SELECT * EXCLUDE (comparable), raw_hits / nullif(expected, 0) AS raw_recall, kept_hits / nullif(expected, 0) AS kept_recall, raw_true / nullif(raw, 0) AS raw_precision, kept_true / nullif(kept, 0) AS kept_precision, raw - kept AS dropped,
    CASE WHEN NOT comparable THEN 'comparability_failed' WHEN raw_gap IS NOT NULL OR kept_gap IS NOT NULL THEN 'failed' ELSE 'passed' END AS status FROM gaps""")
def e1_score_candidates(spark, sf):
    return sc.score_candidates(base(spark, sf, "gold"), base(spark, sf, "found"))


_PARTS = {}
for _stage, _n in (("candidates", "raw"), ("filtered", "kept")):
    _PARTS |= {
        f"recall_at_{_stage}": (f"sum({_n}_hits)", "sum(expected)"), f"precision_at_{_stage}": (f"sum({_n}_true)", f"sum({_n})"), f"true_positive_at_{_stage}": (f"sum({_n}_hits)", "sum(expected)"),
        f"false_negative_at_{_stage}": (f"sum(expected - {_n}_hits)", "sum(expected)"), f"false_positive_at_{_stage}": (f"sum({_n} - {_n}_true)", f"sum({_n})"),
    }


@_query(f"{_SCORES} " + " UNION ALL ".join(f"SELECT '{m}' AS metric, ({a})::BIGINT AS part, ({b})::BIGINT AS whole, ({a})::DOUBLE / nullif({b}, 0) AS rate FROM rows_" for m, (a, b) in _PARTS.items()))
def e7_aggregates(spark, sf):
    return sc.aggregates(sc.score_candidates(base(spark, sf, "gold"), base(spark, sf, "found")))


@_query("SELECT o_custkey AS case_id, CASE max(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END) WHEN 1 THEN 'passed' WHEN 2 THEN 'failed' ELSE 'setup_failed' END AS status FROM orders GROUP BY ALL")
def e8_worst_status(spark, sf):
    status = F.when(F.col("o_orderstatus") == "F", "passed").when(F.col("o_orderstatus") == "O", "failed").otherwise("setup_failed")
    return sc.worst_status(table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), status.alias("status")))


@_query("""g AS (SELECT * FROM gold WHERE NOT expected_absent AND text IS NOT NULL), c AS (SELECT case_id, field_id, seq, text, kept, case_id % 5 AS m FROM found),
    o AS (SELECT case_id, field_id, CASE WHEN case_id % 4 = 0 THEN 'ABSTAINED' ELSE 'SELECTED' END AS outcome, min(seq) AS pick FROM c GROUP BY ALL),
    h AS (SELECT g.case_id, g.field_id, g.gold_index, g.expected_value, o.outcome, count(c.seq) AS n, count(c.seq) FILTER (WHERE c.seq = o.pick AND outcome = 'SELECTED') AS chosen, count(c.seq) FILTER (WHERE c.seq = o.pick AND outcome = 'SELECTED' AND c.kept) AS valid, count(c.seq) FILTER (WHERE c.seq = o.pick AND outcome = 'SELECTED' AND c.kept AND c.m <> 0) AS used
        FROM g LEFT JOIN o ON g.case_id = o.case_id AND g.field_id = o.field_id LEFT JOIN c ON g.case_id = c.case_id AND g.field_id = c.field_id AND contains(c.text, g.text) GROUP BY ALL),
    e AS (SELECT h.*, EXISTS (SELECT 1 FROM c x WHERE x.case_id = h.case_id AND x.field_id = h.field_id AND x.kept AND x.m <> 0 AND x.text[2:] = h.expected_value) AS same FROM h)
    SELECT case_id, field_id, gold_index, CASE WHEN n = 0 THEN 'candidate' WHEN chosen = 0 THEN 'selection' WHEN valid = 0 THEN 'validation' WHEN used = 0 THEN 'materialization' WHEN expected_value IS NOT NULL AND NOT same THEN 'value' ELSE 'complete' END AS stage,
        CASE WHEN n = 0 THEN 'not_generated' WHEN chosen = 0 AND outcome <> 'SELECTED' THEN 'selection_abstained' WHEN chosen = 0 THEN 'wrong_candidate_selected' WHEN valid = 0 THEN 'validation_rejected' WHEN used = 0 THEN 'materialization_missing' WHEN expected_value IS NOT NULL AND NOT same THEN 'normalization_mismatch' END AS attribution FROM e""")
def e9_funnel(spark, sf):
    c = base(spark, sf, "found").withColumn("candidate_id", F.col("seq").cast("string"))
    o = c.groupBy("case_id", "field_id").agg(F.min("seq").cast("string").alias("pick")).withColumn("outcome", F.when(F.col("case_id") % 4 == 0, "ABSTAINED").otherwise("SELECTED"))
    o = o.withColumn("selected_candidate_ids", F.when(F.col("outcome") == "SELECTED", F.array("pick")).otherwise(F.array().cast("array<string>")))
    used = c.where("kept AND case_id % 5 <> 0").withColumn("value", F.substring("text", 2, 100))
    return sc.funnel(base(spark, sf, "gold").where("text IS NOT NULL"), c, o, c.where("kept"), used)


@_query("""x AS (SELECT case_id, field_id, value FROM expected), s AS (SELECT DISTINCT case_id, field_id, value FROM actual) SELECT x.case_id, x.field_id, count(*) AS expected, count(s.case_id) AS hits FROM x LEFT JOIN s ON x.case_id = s.case_id AND x.field_id = s.field_id AND x.value = s.value GROUP BY ALL""")
def e11_value_hits(spark, sf):
    return sc.value_hits(base(spark, sf, "expected"), base(spark, sf, "actual"))


_DIFF = """e AS (SELECT case_id, idx, field_id, arg_max(value, seq) AS v FROM expected GROUP BY ALL), a AS (SELECT case_id, idx, field_id, arg_max(value, seq) AS v FROM actual GROUP BY ALL),
    d AS (SELECT coalesce(e.case_id, a.case_id) AS case_id, coalesce(e.idx, a.idx) AS idx, coalesce(e.field_id, a.field_id) AS field_id, CASE WHEN a.case_id IS NULL THEN 'missing_field' WHEN e.case_id IS NULL THEN 'unexpected_field' WHEN e.v IS DISTINCT FROM a.v THEN 'value_mismatch' END AS kind FROM e FULL JOIN a ON e.case_id = a.case_id AND e.idx = a.idx AND e.field_id = a.field_id),
    n AS (SELECT coalesce(x.case_id, y.case_id) AS case_id FROM (SELECT case_id, count(DISTINCT idx) AS n FROM expected GROUP BY ALL) x FULL JOIN (SELECT case_id, count(DISTINCT idx) AS n FROM actual GROUP BY ALL) y ON x.case_id = y.case_id WHERE x.n IS DISTINCT FROM y.n),
    diffs AS (SELECT * FROM d WHERE kind IS NOT NULL UNION ALL SELECT case_id, NULL, NULL, 'instance_count_mismatch' FROM n)"""


@_query(f"{_DIFF} SELECT case_id, coalesce(idx, -1) AS idx, field_id, kind FROM diffs")
def e13_diff_instances(spark, sf):
    return sc.diff_instances(base(spark, sf, "expected"), base(spark, sf, "actual")).withColumn("idx", F.coalesce("idx", F.lit(-1)))


@_query(f"{_DIFF}, k AS (SELECT unnest(['missing_field', 'unexpected_field', 'value_mismatch', 'instance_count_mismatch']) AS kind) SELECT kind, count(diffs.kind) AS n FROM k LEFT JOIN diffs USING (kind) GROUP BY kind")
def e15_counts_by_kind(spark, sf):
    return sc.counts_by_kind(sc.diff_instances(base(spark, sf, "expected"), base(spark, sf, "actual")))


@_query("SELECT c_custkey AS case_id, o_orderkey AS replay_id, CASE WHEN o_orderkey IS NULL THEN 'comparability_failed' ELSE 'passed' END AS status FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def e17_alignment(spark, sf):
    return sc.alignment(table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id")), table(spark, sf, "orders").select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("replay_id")))


# scalar functions

_MONEY = "SELECT l_orderkey AS doc_id, l_linenumber AS seq, CAST(l_quantity AS INT) AS q, CASE l_partkey % 7 WHEN 0 THEN concat('approximately $', CAST(CAST(l_quantity AS INT) AS STRING), '.5') WHEN 1 THEN concat('US$', CAST(CAST(l_quantity AS INT) AS STRING), 'M') WHEN 2 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), '% million') WHEN 3 THEN concat('1,0', CAST(CAST(l_quantity AS INT) % 90 + 10 AS STRING), ' and 5') WHEN 4 THEN concat('-', CAST(CAST(l_quantity AS INT) AS STRING), '%') WHEN 5 THEN concat('about $', CAST(CAST(l_quantity AS INT) AS STRING), '.25 billion net') ELSE '$5.' END AS t, l_partkey % 7 AS k FROM {lineitem}"


@_query("m AS (" + _MONEY.replace("{lineitem}", "lineitem") + ") SELECT doc_id, seq, (CASE k WHEN 0 THEN q + 0.5 WHEN 1 THEN q * 1000000 WHEN 4 THEN -q WHEN 5 THEN (q + 0.25) * 1000000000 END)::DOUBLE AS value, CASE k WHEN 0 THEN q || '.5' WHEN 1 THEN (q * 1000000)::VARCHAR WHEN 4 THEN '-' || q WHEN 5 THEN ((q::BIGINT * 100 + 25) * 10000000)::VARCHAR END AS hint FROM m")
def sf1_decimals(spark, sf):
    value = tx.decimal_value(F.col("t"))
    return spark.sql(_MONEY, lineitem=table(spark, sf, "lineitem")).select("doc_id", "seq", value.cast("double").alias("value"), tx.decimal_hint(value).alias("hint"))


@_query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS collapsed, regexp_replace(source || ' / ' || lang, '[^\\pL\\pN\\-_.]', '_', 'g') AS segment FROM documents")
def sf11_strings(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.collapse(F.col("text")).alias("collapsed"), tx.safe_segment(F.concat_ws(" / ", "source", "lang")).alias("segment"))


@_query("""l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
    SELECT doc_id, (i - 1)::INTEGER AS line, coalesce(sum(strlen(t) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INTEGER AS start, t AS text FROM l""")
def sf7_lines(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.explode(tx.lines(F.col("text"))).alias("l")).select("doc_id", "l.line", "l.start", "l.text")


# whole extractions

from typing import Annotated, Literal  # noqa: E402

from .plans.extract import extract, extract_instances, objects  # noqa: E402
from .plans.spec import Field, Regex, Rule, compile_spec  # noqa: E402
from .sources import store  # noqa: E402


class Notice:
    mail: Annotated[str | None, Field("an address", (Regex(r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+", native=True),))]
    numbers: Annotated[list[int], Field("all numbers", (Regex("[0-9]+", entity_type="CARDINAL", native=True),))]
    secret: Annotated[str, Field("a token", (Regex(r'token = "(?P<value>[0-9a-f]+)"', group="value"),))]
    topic: Annotated[Literal["legal", "mail"], Field("what it is about", rules=(Rule("legal", "License"), Rule("mail", "@mail")))]


_MAIL, _TOKEN = "[A-Za-z0-9._-]+@[A-Za-z0-9-]+[.][A-Za-z0-9.-]+", 'token = "([0-9a-f]+)"'
_NOTICE = f"""x AS (SELECT doc_id, regexp_extract_all(text, '{_MAIL}') AS m, regexp_extract_all(text, '[0-9]+') AS n, regexp_extract_all(text, '{_TOKEN}', 1) AS t, contains(text, 'License') AS legal, contains(text, '@mail') AS about FROM documents)"""


@_query(f"""{_NOTICE}, y AS (SELECT doc_id, CASE WHEN len(m) = 1 THEN m[1] END AS mail, array_to_string(list_transform(list_filter(n, lambda v: try_cast(v AS BIGINT) IS NOT NULL), lambda v: v::BIGINT::VARCHAR), ',') AS numbers, CASE WHEN len(t) = 1 THEN t[1] END AS secret, CASE WHEN legal AND NOT about THEN 'legal' WHEN about AND NOT legal THEN 'mail' END AS topic FROM x)
    SELECT doc_id, mail, numbers, secret, topic, array_to_string(list_filter([CASE WHEN secret IS NULL THEN 'secret' END, CASE WHEN topic IS NULL THEN 'topic' END], lambda v: v IS NOT NULL), ',') AS missing FROM y WHERE mail IS NOT NULL OR numbers <> '' OR secret IS NOT NULL OR topic IS NOT NULL""")
def extract_objects(spark, sf):
    spec = compile_spec(Notice)
    out = objects(extract(table(spark, sf, "documents").select("doc_id", "text"), spec), spec)
    return out.withColumns({"numbers": F.array_join("numbers", ","), "missing": F.array_join("missing", ",")})


_LINES = """l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS ordinal FROM documents WHERE text IS NOT NULL), """


def _line_keys(spark, sf):
    # lengths alone are sent by document, not the lines
    each = table(spark, sf, "documents").select("doc_id", F.posexplode(F.transform(F.split("text", "\n", -1), F.octet_length)).alias("ordinal", "n"))
    start = F.coalesce(F.sum(F.col("n") + 1).over(Window.partitionBy("doc_id").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return each.select("doc_id", "ordinal", start.alias("anchor_start"), (start + F.col("n")).alias("anchor_end"), "n").where("n > 0").drop("n")


@_query(f"""{_LINES}{_NOTICE.replace('x AS (SELECT doc_id,', "x AS (SELECT doc_id, ordinal,").replace('text', 'line').replace('FROM documents', "FROM l WHERE line <> ''")}, y AS (SELECT doc_id, ordinal, CASE WHEN len(m) = 1 THEN m[1] END AS mail, array_to_string(list_transform(list_filter(n, lambda v: try_cast(v AS BIGINT) IS NOT NULL), lambda v: v::BIGINT::VARCHAR), ',') AS numbers, CASE WHEN len(t) = 1 THEN t[1] END AS secret, CASE WHEN legal AND NOT about THEN 'legal' WHEN about AND NOT legal THEN 'mail' END AS topic FROM x)
    SELECT doc_id, ordinal, mail, numbers, secret, topic, array_to_string(list_filter([CASE WHEN secret IS NULL THEN 'secret' END, CASE WHEN topic IS NULL THEN 'topic' END], lambda v: v IS NOT NULL), ',') AS missing FROM y WHERE mail IS NOT NULL OR numbers <> '' OR secret IS NOT NULL OR topic IS NOT NULL""")
def extract_instance_objects(spark, sf):
    spec = compile_spec(Notice)
    out = objects(extract_instances(table(spark, sf, "documents").select("doc_id", "text"), spec, _line_keys(spark, sf)), spec)
    return out.withColumns({"numbers": F.array_join("numbers", ","), "missing": F.array_join("missing", ","), "ordinal": F.col("ordinal").cast("long")})



@_query(f"""{_NOTICE} SELECT doc_id, 'secret' AS field_id, CASE WHEN len(t) = 0 THEN 'no_candidates' ELSE 'ambiguous' END AS code FROM x WHERE len(t) <> 1
    UNION ALL SELECT doc_id, 'mail' AS field_id, CASE WHEN len(m) = 0 THEN 'no_candidates' ELSE 'ambiguous' END AS code FROM x WHERE len(m) <> 1
    UNION ALL SELECT doc_id, 'numbers', 'no_candidates' FROM x WHERE len(n) = 0 UNION ALL SELECT doc_id, 'numbers', 'field_failure' FROM x, unnest(n) AS u(v) WHERE try_cast(v AS BIGINT) IS NULL
    UNION ALL SELECT doc_id, 'topic', 'abstained' FROM x WHERE legal = about""")
def extract_negatives(spark, sf):
    return extract(table(spark, sf, "documents").select("doc_id", "text"), compile_spec(Notice)).negatives.select("doc_id", "field_id", "code")


@_query("""SELECT 'd' || (event_id % 50) AS producer, 'v' || (event_id % 3) AS captured, CASE WHEN event_id % 5 <> 0 THEN 'v' || (event_id % 2) END AS live FROM events WHERE event_id < 50 AND NOT ('v' || (event_id % 3) IS NOT DISTINCT FROM CASE WHEN event_id % 5 <> 0 THEN 'v' || (event_id % 2) END)""")
def s9_version_drift(spark, sf):
    e = table(spark, sf, "events").where("event_id < 50")
    name = F.concat(F.lit("d"), (F.col("event_id") % 50).cast("string")).alias("producer")
    version = lambda k: F.concat(F.lit("v"), (F.col("event_id") % k).cast("string")).alias("version")
    return store.version_drift(e.select(name, version(3)), e.where("event_id % 5 <> 0").select(name, version(2)))


@_query("""(SELECT o_custkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 3 <> 0 EXCEPT ALL SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 4 <> 0)
    UNION ALL (SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 4 <> 0 EXCEPT ALL SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 3 <> 0)""".replace("(SELECT o_custkey AS k", "SELECT k, v, 'left' AS side FROM (SELECT o_custkey AS k", 1).replace("UNION ALL (SELECT", "UNION ALL SELECT *, 'right' FROM (SELECT"))
def s10_differences(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("v"))
    return store.differences(o.where("o_orderkey % 3 <> 0").drop("o_orderkey"), o.where("o_orderkey % 4 <> 0").drop("o_orderkey"))


@_query("SELECT sha256(to_json(text)::VARCHAR) AS hash, text AS prompt FROM (SELECT DISTINCT text FROM conversations)")
def s13_prompts(spark, sf):
    return store.record_prompts(table(spark, sf, "conversations").select(F.col("text").alias("prompt")))


# prompts, and what else has a relation of its own

from pyspark.sql import Window  # noqa: E402

from .operators import prompts as pr  # noqa: E402


@_query("""p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field_id ORDER BY seq) AS k FROM cands), g AS (SELECT doc_id, field_id, string_agg('c' || lpad(k::VARCHAR, 3, '0') || ' | ' || text || ' | ' || context, chr(10) ORDER BY seq) AS l, count(*) AS presented FROM p GROUP BY ALL),
    q AS (SELECT *, 'Choose from the candidates by id, or abstain.' || chr(10) || CASE field_id WHEN 'amount' THEN 'The amount.' ELSE field_id END || chr(10) || l AS prompt FROM g)
    SELECT doc_id, field_id, prompt, presented, length(prompt)::INTEGER AS prompt_chars, sha256(to_json(prompt)::VARCHAR) AS prompt_hash FROM q""")
def d9_render(spark, sf):
    return pr.render(base(spark, sf, "cands"), {"amount": "The amount."})


@_query("""p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field_id ORDER BY seq) AS k FROM cands) SELECT doc_id, field_id, coalesce(string_agg(candidate_id, ',' ORDER BY k DESC) FILTER (WHERE k IN (1, 2)), '') AS ids, CASE WHEN count(*) < 2 THEN 'c002' ELSE '' END AS unknown FROM p GROUP BY ALL""")
def d8_translate(spark, sf):
    c = base(spark, sf, "cands")
    answers = c.select("doc_id", "field_id").distinct().withColumn("prompt_ids", F.array(F.lit("c002"), F.lit("c001")))
    return pr.translate(answers, c).select("doc_id", "field_id", F.array_join("selected_candidate_ids", ",").alias("ids"), F.array_join("unknown", ",").alias("unknown"))


@_query("SELECT doc_id, field_id, min(candidate_id ORDER BY byte_start, seq) AS candidate_id FROM (SELECT doc_id, field_id, first(candidate_id ORDER BY byte_start, seq) AS candidate_id, 0 AS byte_start, 0 AS seq FROM cands GROUP BY ALL) GROUP BY ALL")
def d17_tournament(spark, sf):
    best = Window.partitionBy("doc_id", "field_id", "shard").orderBy("byte_start", "seq")
    select = lambda df: df.withColumn("__k", F.row_number().over(best)).where("__k = 1").drop("__k")
    shards = base(spark, sf, "cands").select("doc_id", "field_id", "seq", "candidate_id", "byte_start", (F.col("seq") % 4).cast("int").alias("shard"))
    return pr.tournament(shards, select, lambda df: df.persist()).select("doc_id", "field_id", "candidate_id")


@_query("""a AS (SELECT doc_id, field_id, k, outcome FROM obs WHERE field_id <> 'one') SELECT o.doc_id, o.field_id, o.k::BIGINT AS presented, coalesce(a.k, 0) AS selected, coalesce(a.outcome = 'ABSTAINED', false) AS abstained, a.k IS NOT NULL AS answered FROM obs o LEFT JOIN a ON o.doc_id = a.doc_id AND o.field_id = a.field_id""")
def d28_diagnostics(spark, sf):
    o, _ = _observations(spark, sf)
    return pr.diagnostics(o.select("doc_id", "field_id", F.col("k").cast("long").alias("presented")), o.where("field_id <> 'one'"))


@_query("""c AS (SELECT doc_id, list(seq % 3 ORDER BY seq) AS l FROM cands GROUP BY ALL), d AS (SELECT doc_id, len(l) AS n, len(list_distinct(l)) AS u, list_contains(l, 2) AS x FROM c) SELECT doc_id, CASE WHEN u < n THEN 'duplicate' ELSE 'unknown' END AS violation FROM d WHERE u < n OR x""")
def p11_proposer_contract(spark, sf):
    c = base(spark, sf, "cands")
    chosen = c.groupBy("doc_id").agg(F.collect_list((F.col("seq") % 3).cast("int")).alias("instances"))
    return pr.proposer_violation(chosen, c.select("doc_id").distinct().crossJoin(spark.range(2).select(F.col("id").cast("int").alias("instance"))))


@_query("""x AS (SELECT doc_id, field_id, seq, candidate_id, seq % 3 = 0 AS ab FROM cands) SELECT doc_id, field_id, string_agg(candidate_id, ',' ORDER BY seq) AS ids, bool_and(ab) AS abstain, bool_or(ab) AND NOT bool_and(ab) AS mixed FROM x GROUP BY ALL""")
def d6_coalesced(spark, sf):
    answers = base(spark, sf, "cands").select("doc_id", "field_id", "seq", F.array("candidate_id", "candidate_id").alias("selected_candidate_ids"), (F.col("seq") % 3 == 0).alias("abstain"))
    return sel.coalesced(answers).select("doc_id", "field_id", F.array_join("selected_candidate_ids", ",").alias("ids"), "abstain", "mixed")


@_query("""a AS (SELECT doc_id, field_id, outcome, k + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS g FROM obs WHERE doc_id % 5 <> 0)
    SELECT o.doc_id, o.field_id, coalesce(o.k = a.g, false) AS ids_match, (o.outcome = 'ABSTAINED') = coalesce(a.outcome = 'ABSTAINED', false) AS abstain_match, coalesce(o.k = a.g, false) AND (o.outcome = 'ABSTAINED') = coalesce(a.outcome = 'ABSTAINED', false) AS passed FROM obs o LEFT JOIN a ON o.doc_id = a.doc_id AND o.field_id = a.field_id""")
def d20_score_observations(spark, sf):
    o, _ = _observations(spark, sf)
    more = F.when(F.col("doc_id") % 7 == 0, F.concat("selected_candidate_ids", F.array(F.lit("x")))).otherwise(F.col("selected_candidate_ids"))
    return sel.score_observations(o, o.where("doc_id % 5 <> 0").withColumn("selected_candidate_ids", more))


@_query("""v AS (SELECT doc_id, field_id, outcome, k FROM obs WHERE outcome <> 'ABSTAINED') SELECT doc_id, field_id, (i - 1)::INTEGER AS "position", i::INTEGER AS byte_start, (i + 5)::INTEGER AS byte_end FROM v, unnest(range(1, k + 1)) AS t(i)""")
def g16_advisory_anchors(spark, sf):
    o, _ = _observations(spark, sf)
    c = o.select("doc_id", "field_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i")).select("doc_id", "field_id", F.concat(F.lit("c"), "i").alias("candidate_id"), F.col("i").alias("byte_start"), (F.col("i") + 5).alias("byte_end"))
    return ins.advisory_anchors(o, c)


@_query("SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) - 1)::INTEGER AS ordinal, seq AS instance, text FROM cands")
def g17_plan_from_selection(spark, sf):
    c = base(spark, sf, "cands").select("doc_id", F.col("seq").alias("instance"), "text")
    chosen = c.groupBy("doc_id").agg(F.sort_array(F.collect_list("instance"), asc=False).alias("instances"))
    return ins.plan_from_selection(chosen, c)


@_query("SELECT p_type AS spec_id, p_partkey AS ordinal, (row_number() OVER (PARTITION BY p_type ORDER BY p_size DESC, p_partkey) - 1)::INTEGER AS place FROM part WHERE p_partkey % 2 = 0")
def g15_boundary_order(spark, sf):
    fields = table(spark, sf, "part").select(F.col("p_type").alias("spec_id"), F.col("p_partkey").alias("ordinal"), F.col("p_size").alias("priority"), (F.col("p_partkey") % 2 == 0).alias("boundary_defining"))
    return ins.boundary_order(fields).select("spec_id", "ordinal", "place")


def _authority(name: str, function, code: int) -> None:
    @_query(f"{_AUTHORITY} SELECT doc_id, field_id, seq, n = 1 AS decisive, n AS buckets FROM s WHERE a = {code}", name)
    def run(spark, sf):
        more = (spark.sql(_REFERRED, cands=base(spark, sf, "cands")),) if code == 3 else ()
        return function(spark.sql(_FIELDS, cands=base(spark, sf, "cands")), base(spark, sf, "keys"), *more).select("doc_id", "field_id", "seq", "decisive", "buckets")


_authority("g3_boundary", ins.by_boundary, 1)
_authority("g4_continuity", ins.by_continuity, 2)
_authority("g5_cooccurrence", ins.by_cooccurrence, 3)
_authority("g6_prior", ins.by_prior, 4)


@_query("r AS (" + _RAW.replace("{orders}", "orders") + ") SELECT doc_id, kind AS field_id, 'validation' AS category, 'field_failure' AS code, 'field_failure' AS reason, 1 AS candidate_count FROM r WHERE (kind = 'int' AND raw_value = '20 items') OR (kind = 'date' AND raw_value <> '2020-04-13') OR (kind = 'bool' AND raw_value = 'maybe')")
def v7_failures(spark, sf):
    return va.failures(va.layer2(spark.sql(_RAW, orders=table(spark, sf, "orders")).withColumn("field_id", F.col("kind"))))


@_query("SELECT case_id, field_id, count(*) AS n, count(*) FILTER (WHERE kept) AS kept, string_agg(text || '@' || byte_start || '-' || byte_end, '; ' ORDER BY seq) AS summary FROM found GROUP BY ALL")
def e16_summaries(spark, sf):
    return sc.candidate_summaries(base(spark, sf, "found"))


@_query(f"{_DIFF}, c AS (SELECT case_id FROM expected UNION SELECT case_id FROM actual), k AS (SELECT case_id, count(*) AS n FROM diffs GROUP BY ALL) SELECT c.case_id, n IS NULL AS matched, coalesce(n, 0) AS differences FROM c LEFT JOIN k ON c.case_id = k.case_id")
def e15_smoke(spark, sf):
    return sc.smoke(base(spark, sf, "expected"), base(spark, sf, "actual"))


@_query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, printf('%.2f', o_totalprice) AS price FROM orders")
def e14_json_safe(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").cast("decimal(12,2)").alias("price"))
    return sc.json_safe(o)


@_query("SELECT conv_id, turn, text AS payload, CASE WHEN turn % 2 = 0 THEN 'ok' ELSE 'failed' END AS status FROM conversations")
def s17_batch_round_trip(spark, sf):
    c = table(spark, sf, "conversations")
    ok = F.to_json(F.struct(F.concat_ws(":", "conv_id", "turn").alias("custom_id"), F.struct(F.lit(200).alias("status_code"), F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("message"))).alias("choices")).alias("body")).alias("response")))
    failed = F.to_json(F.struct(F.concat_ws(":", "conv_id", "turn").alias("custom_id"), F.struct(F.col("text").alias("message")).alias("error")))
    parsed = store.parse_batch(c.select(F.when(F.col("turn") % 2 == 0, ok).otherwise(failed).alias("value")))
    part = F.split("request_id", ":")
    return parsed.select(part[0].cast("long").alias("conv_id"), part[1].cast("long").alias("turn"), "payload", "status")


# flattening, collecting, repairing

_COMPOSED = f"""{_POLICY}, kept AS (SELECT doc_id, dense_rank() OVER (PARTITION BY doc_id ORDER BY coalesce(bucket, target)) - 1 AS ordinal, field_id, seq, value, code FROM j)"""


@_query(f"{_COMPOSED} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY ordinal, field_id, seq) - 1)::INTEGER AS position, ordinal::INTEGER AS ordinal, field_id, seq, value FROM kept WHERE code IS NULL")
def r3_flat_evidence(spark, sf):
    return ins.flat_evidence(ins.compose(ins.cardinality_policy(_assigned(spark, sf))))


@_query(f"""{_COMPOSED}, neg AS (SELECT DISTINCT doc_id, ordinal, field_id || ':' || code AS negative FROM kept WHERE code IS NOT NULL)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY ordinal, negative) - 1)::INTEGER AS position, ordinal::INTEGER AS ordinal, negative FROM neg""")
def r3_flat_negatives(spark, sf):
    return ins.flat_negatives(ins.compose(ins.cardinality_policy(_assigned(spark, sf))))


_ANSWERS = """SELECT l_orderkey AS doc_id, concat('f', CAST(l_linenumber AS STRING)) AS field_id, CASE WHEN l_linenumber % 2 = 0 THEN 'MANY' ELSE 'ONE' END AS cardinality, l_suppkey % 5 = 0 AS abstain,
    CAST(l_partkey % 3 AS INT) AS k, CASE l_suppkey % 4 WHEN 0 THEN 'c1' WHEN 1 THEN 'c9' END AS evidence_id, l_returnflag AS reason FROM {lineitem}"""


def _answers(spark, sf):
    c = spark.sql(_ANSWERS, lineitem=table(spark, sf, "lineitem"))
    return c.withColumn("selected_candidate_ids", F.when(F.col("k") > 0, F.transform(F.sequence(F.lit(1), F.col("k")), lambda x: F.concat(F.lit("c"), x))).otherwise(F.array().cast("array<string>")))


@_query("a AS (" + _ANSWERS.replace("{lineitem}", "lineitem") + """) SELECT doc_id, field_id, CASE WHEN abstain THEN 'ABSTAINED' ELSE 'SELECTED' END AS outcome, CASE WHEN abstain OR k = 0 THEN '' WHEN k = 1 THEN 'c1' ELSE 'c1,c2' END AS ids,
    CASE WHEN abstain THEN NULL WHEN evidence_id IS NULL OR (evidence_id = 'c1' AND k > 0) THEN evidence_id WHEN k = 1 THEN 'c1' END AS evidence_id, reason,
    CASE WHEN NOT abstain AND k = 0 AND cardinality <> 'MANY' THEN 'output_malformed' WHEN NOT abstain AND evidence_id IS NOT NULL AND NOT (evidence_id = 'c1' AND k > 0) AND k <> 1 THEN 'evidence_not_selected' END AS violation FROM a""")
def d7_observations(spark, sf):
    return sel.observations_from_responses(_answers(spark, sf)).withColumn("ids", F.array_join("selected_candidate_ids", ",")).drop("selected_candidate_ids")


@_query("""SELECT doc_id, field_id, CASE WHEN doc_id % 7 = 0 THEN 'field_mismatch' WHEN k = 2 AND (doc_id % 3 = 0 OR doc_id % 5 = 0) THEN 'duplicate_ids' WHEN k > 0 AND doc_id % 5 = 0 THEN 'unknown_ids' END AS violation FROM obs""")
def p12_structural(spark, sf):
    o = base(spark, sf, "obs").withColumn("set_field_id", F.when(F.col("doc_id") % 7 == 0, "other").otherwise(F.col("field_id")))
    ids = F.transform(F.sequence(F.lit(1), F.col("k")), lambda x: F.when((F.col("k") == 2) & (F.col("doc_id") % 3 == 0), "c1").when(F.col("doc_id") % 5 == 0, "zz").otherwise(F.concat(F.lit("c"), x)))
    o = o.withColumn("selected_candidate_ids", F.when(F.col("k") > 0, ids).otherwise(F.array().cast("array<string>")))
    c = o.select("doc_id", F.col("set_field_id").alias("field_id"), F.explode(F.array(F.lit("c1"), F.lit("c2"))).alias("candidate_id"))
    return sel.structural_violation(o, c).select("doc_id", "field_id", "violation")


@_query("SELECT doc_id, field_id, seq, candidate_id FROM cands WHERE seq % 2 = 0")
def c23_candidate_view(spark, sf):
    c = base(spark, sf, "cands")
    return sel.candidate_view(c, c.where("seq % 2 = 0")).select("doc_id", "field_id", "seq", "candidate_id")


@_query("""s AS (SELECT doc_id, field_id, seq, candidate_id, seq % 3 AS shard, byte_start % 4 = 0 AS picked, CASE WHEN doc_id % 2 = 0 THEN 'MANY' ELSE 'ONE' END AS cardinality FROM cands),
    g AS (SELECT doc_id, field_id, cardinality, count(DISTINCT shard) FILTER (WHERE picked) AS winners, string_agg(candidate_id, ',' ORDER BY seq) FILTER (WHERE picked) AS ids FROM s GROUP BY ALL)
    SELECT doc_id, field_id, CASE WHEN winners = 0 THEN 'ABSTAINED' WHEN cardinality = 'MANY' OR winners = 1 THEN 'SELECTED' ELSE 'ERROR' END AS outcome, CASE WHEN cardinality = 'MANY' OR winners = 1 THEN coalesce(ids, '') ELSE '' END AS ids,
        CASE WHEN winners = 0 THEN 'all shards abstained' WHEN cardinality = 'MANY' THEN 'union of sharded selections' WHEN winners > 1 THEN 'deferred_collect.reducer_required' END AS reason FROM g""")
def d26_collect_shards(spark, sf):
    c = base(spark, sf, "cands")
    picked = F.collect_list(F.when(F.col("byte_start") % 4 == 0, F.col("candidate_id")))
    shards = c.withColumn("cardinality", F.when(F.col("doc_id") % 2 == 0, "MANY").otherwise("ONE")).groupBy("doc_id", "field_id", "cardinality", (F.col("seq") % 3).alias("shard")).agg(picked.alias("selected_candidate_ids"))
    return sel.collect_shards(shards, c).withColumn("ids", F.array_join("selected_candidate_ids", ",")).drop("selected_candidate_ids")


_RESPONSES = """SELECT concat('r', CAST(event_id AS STRING)) AS request_id, CASE WHEN event_id % 3 = 0 THEN NULL WHEN event_id % 4 = 0 THEN 'no json' WHEN event_id % 4 = 1 THEN concat(chr(123), '"abstain":true,"reason":"unsure"', chr(125)) ELSE concat(chr(123), '"abstain":false,"selected_candidate_ids":["c1"],"evidence_id":"c9","reason":"fits"', chr(125)) END AS payload,
    CASE WHEN event_id % 3 = 0 THEN 'timeout' END AS error, CASE WHEN event_id % 2 = 0 THEN 'u' END AS raw_usage FROM {events} WHERE event_id % 7 <> 0"""
_CALLS = "SELECT concat('r', CAST(event_id AS STRING)) AS request_id, user_id AS doc_id, event_type AS field_id, CASE WHEN event_id % 2 = 0 THEN 'ONE' ELSE 'MANY' END AS cardinality FROM {events} WHERE event_id % 5 <> 0"
_ADAPTED = f"""c AS ({_CALLS.replace('{events}', 'events')}), p AS ({_RESPONSES.replace('{events}', 'events')}), a AS (SELECT c.*, payload, raw_usage AS usage, CASE WHEN payload IS NULL AND error IS NULL THEN 'missing' WHEN error IS NOT NULL THEN 'failed' WHEN payload = 'no json' THEN 'invalid' ELSE 'ok' END AS status FROM c LEFT JOIN p USING (request_id))"""


def _calls(spark, sf):
    events = table(spark, sf, "events")
    return spark.sql(_CALLS, events=events), spark.sql(_RESPONSES, events=events)


@_query(f"{_ADAPTED} SELECT request_id, CASE WHEN status = 'ok' THEN contains(payload, 'true') END AS abstain, usage, status FROM a")
def q8_adapt_responses(spark, sf):
    out = df_.adapt_responses(*_calls(spark, sf), "abstain boolean, selected_candidate_ids array<string>, evidence_id string, reason string")
    return out.select("request_id", "output.abstain", "usage", "status")


@_query(f"""{_ADAPTED} SELECT doc_id, field_id, CASE WHEN contains(payload, 'true') THEN 'ABSTAINED' ELSE 'SELECTED' END AS outcome, CASE WHEN contains(payload, 'true') THEN NULL ELSE 'c1' END AS evidence_id, CASE WHEN contains(payload, 'true') THEN 'unsure' ELSE 'fits' END AS reason FROM a WHERE status = 'ok'""")
def q7_collect(spark, sf):
    return df_.collect(*_calls(spark, sf))[0].select("doc_id", "field_id", "outcome", "evidence_id", "reason")


@_query(f"{_ADAPTED} SELECT request_id, status AS problem FROM a WHERE status <> 'ok' UNION ALL SELECT request_id, 'unknown' FROM p WHERE request_id NOT IN (SELECT request_id FROM c)")
def q7_problems(spark, sf):
    return df_.collect(*_calls(spark, sf))[1]


@_query("""SELECT event_id, sha256('{"output_model_ref":"m","routing":{"document_id":"d' || user_id || '","field_id":"' || event_type || '"},"soft_call_identity":"s' || event_id || '","spec_hash":"h"}') AS request_id,
    '{"output_model_ref":"m","prompt":"p' || event_id || '","request_id":"' || request_id || '","routing":{"document_id":"d' || user_id || '","field_id":"' || event_type || '"},"soft_call_identity":"s' || event_id || '","spec_hash":"h"}' AS line FROM events""")
def q2_render_submission(spark, sf):
    calls = table(spark, sf, "events").select("event_id", F.concat(F.lit("s"), "event_id").alias("soft_call_identity"), F.lit("h").alias("spec_hash"), F.lit("m").alias("output_model_ref"), F.concat(F.lit("d"), "user_id").alias("document_id"), F.col("event_type").alias("field_id"), F.concat(F.lit("p"), "event_id").alias("prompt"))
    lines = df_.render_submission(calls)
    return df_.with_request_id(calls).select("event_id", "request_id").join(lines, "request_id").select("event_id", "request_id", "line")


_ISSUES = "SELECT l_orderkey AS doc_id, l_linenumber AS seq, CASE WHEN l_tax > 0.04 THEN 'error' ELSE 'warning' END AS severity, CASE WHEN l_suppkey % 2 = 0 THEN 'a,b' ELSE 'b' END AS fields, l_returnflag AS reason FROM {lineitem}"


@_query("i AS (" + _ISSUES.replace("{lineitem}", "lineitem") + ") SELECT doc_id, f AS field_id, string_agg(reason, ',' ORDER BY seq) AS reasons FROM (SELECT *, unnest(string_split(fields, ',')) AS f FROM i WHERE severity = 'error') GROUP BY ALL")
def v12_object_feedback(spark, sf):
    issues = spark.sql(_ISSUES, lineitem=table(spark, sf, "lineitem")).withColumn("implicates", F.split("fields", ","))
    return va.object_feedback(issues).withColumn("reasons", F.array_join("reasons", ","))


_NEGATIVES = "SELECT doc_id, field_id, seq, CASE WHEN byte_start % 5 = 0 THEN 'selection' ELSE 'validation' END AS category, CASE WHEN byte_start % 3 = 0 THEN 'field_failure' ELSE 'other' END AS code, text AS reason FROM {cands}"
_FEEDBACK = "n AS (" + _NEGATIVES.replace("{cands}", "cands") + "), f AS (SELECT doc_id, field_id, string_agg(reason, ',' ORDER BY seq) AS reasons FROM n WHERE category = 'validation' AND code = 'field_failure' GROUP BY ALL)"


@_query(f"{_FEEDBACK} SELECT * FROM f")
def v11_field_feedback(spark, sf):
    return va.field_feedback(spark.sql(_NEGATIVES, cands=base(spark, sf, "cands"))).withColumn("reasons", F.array_join("reasons", ","))


@_query(f"""{_FEEDBACK}, k AS (SELECT doc_id, field_id FROM f) SELECT doc_id, field_id, seq, 'first' AS pass FROM n WHERE (doc_id, field_id) NOT IN (SELECT (doc_id, field_id) FROM k) UNION ALL SELECT doc_id, field_id, seq, 'second' FROM n WHERE (doc_id, field_id) IN (SELECT (doc_id, field_id) FROM k) AND seq % 2 = 0""")
def v11_repair_once(spark, sf):
    n = spark.sql(_NEGATIVES, cands=base(spark, sf, "cands")).withColumn("pass", F.lit("first"))
    again = n.where("seq % 2 = 0").withColumn("pass", F.lit("second"))
    _, left = va.repair_once(n, n, again, again, va.field_feedback(n), ["party", "amount"])
    return left.select("doc_id", "field_id", "seq", "pass")


@_query("SELECT doc_id, seq, 'normalized_text' AS space, byte_start::BIGINT AS byte_start, byte_end::BIGINT AS byte_end FROM cands")
def c11_match_span(spark, sf):
    span = tx.normalized_match_span(F.col("byte_start"), F.col("byte_end"))
    return base(spark, sf, "cands").select("doc_id", "seq", span["text_anchor_space"].alias("space"), span["byte_start"].alias("byte_start"), span["byte_end"].alias("byte_end"))


@_query("SELECT event_id, event_id % 3 <> 0 AS ok FROM events")
def sf10_is_json(spark, sf):
    return table(spark, sf, "events").select("event_id", tx.is_json(F.when(F.col("event_id") % 3 == 0, '{"a": [1, }').when(F.col("event_id") % 3 == 1, '{"a": [1, {"b": null}]}').otherwise("7")).alias("ok"))
