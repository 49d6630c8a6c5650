"""Candidate generation: table functions from documents to spans.

Relations: documents(doc_id, text, ...), candidates(doc_id, field_id, seq, candidate_id, text, source_id,
byte_start, byte_end, entity_type, normalized_hint, ...). Order within (doc_id, field_id) is seq.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import json_list, json_object, json_string, json_value, lines, stable_hash


def regex_native(docs: DataFrame, pattern: str, entity_type: str | None = None, text: str = "text") -> DataFrame:
    """(doc_id, seq, text, byte_start, byte_end, entity_type): whole matches of a pattern that means the same to Java; stays in the JVM."""
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    between = F.split(F.col(text), pattern, -1)
    step = lambda acc, m: F.struct(
        (acc["at"] + F.octet_length(m["between"]) + F.octet_length(m["found"])).alias("at"),
        F.concat(acc["out"], F.array(F.struct(m["found"].alias("text"), (acc["at"] + F.octet_length(m["between"])).alias("byte_start")))).alias("out"),
    )
    zipped = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("between"), found.alias("found"))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,byte_start:int>>").alias("out"))
    spans = F.aggregate(F.filter(zipped, lambda m: m["found"].isNotNull()), zero, step, lambda acc: acc["out"])
    out = docs.where(F.col(text).rlike(pattern)).select("doc_id", F.posexplode(spans).alias("seq", "m"))
    return out.select("doc_id", "seq", "m.text", "m.byte_start", (F.col("m.byte_start") + F.octet_length("m.text")).alias("byte_end"), F.lit(entity_type).alias("entity_type"))


class RegexParams:
    """A checked pattern over bytes, with an optional capture group."""

    KEYS = {"pattern", "flags", "group", "entity_type", "window"}

    def __init__(self, **params):
        if unknown := set(params) - self.KEYS:
            raise ValueError(f"unknown parameters: {sorted(unknown)}")
        self.pattern, self.flags = params.get("pattern"), params.get("flags", 0)
        self.group, self.entity_type, self.window = params.get("group", 0), params.get("entity_type"), params.get("window", 160)
        if not isinstance(self.pattern, str) or not self.pattern:
            raise ValueError("pattern must be a non-empty string")
        if isinstance(self.flags, bool) or not isinstance(self.flags, int):
            raise ValueError("flags must be an integer")
        if isinstance(self.group, bool) or not isinstance(self.group, (int, str)):
            raise ValueError("group must be a number or a name")
        if isinstance(self.window, bool) or not isinstance(self.window, int) or self.window < 0:
            raise ValueError("window must not be negative")
        try:
            self.compiled = re.compile(self.pattern.encode(), self.flags & ~re.UNICODE)
        except re.error as e:
            raise ValueError(f"pattern doesn't compile: {e}") from e

    def matches(self, data: bytes) -> Iterator[tuple[bytes, int, int]]:
        for m in self.compiled.finditer(data):
            try:
                start, end = m.span(self.group)
            except IndexError as e:
                raise ValueError(f"no such group: {self.group}") from e
            if start >= 0:  # a group that took no part has no candidate
                yield data[start:end], start, end


def regex_general(docs: DataFrame, params: RegexParams, text: str = "text") -> DataFrame:
    """The same relation as regex_native for any bytes pattern and group, by Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string())
        names = ["doc_id", "seq", "text", "byte_start", "byte_end", "entity_type"]
        whole = lambda rows: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)
        for batch in batches:
            rows = []
            for d, t in zip(*batch.columns[:2]):  # one text at a time is a Python string
                if not t.is_valid:
                    continue
                for k, (found, a, b) in enumerate(params.matches(t.as_py().encode("utf-8"))):
                    rows.append((d.as_py(), k, found.decode("utf-8", "replace"), a, b, params.entity_type))
                    if len(rows) == 10_000:
                        yield whole(rows)
                        rows = []
            if rows:
                yield whole(rows)

    schema = "doc_id long, seq int, text string, byte_start int, byte_end int, entity_type string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def literal_set(docs: DataFrame, literals: list[str]) -> DataFrame:
    """One structured candidate for each literal, at the zero-length head of each document."""
    arms = F.array(*(F.struct(F.lit(k).alias("seq"), F.lit(x).alias("literal")) for k, x in enumerate(literals)))
    arm = docs.select("doc_id", F.explode(arms).alias("a"))
    return arm.select("doc_id", "a.seq", F.col("a.literal").alias("text"), F.lit(0).alias("byte_start"), F.lit(0).alias("byte_end"), F.lit(True).alias("structural_passed"))


def phrases(docs: DataFrame, patterns: dict[str, str], text: str = "text") -> DataFrame:
    """Named-entity phrases: (phrase, label) pairs as whole words, overlapping phrases all reported; in order of place, then length."""
    each = [regex_native(docs, rf"(?<![\p{{L}}\p{{N}}_]){re.escape(p)}(?![\p{{L}}\p{{N}}_])", label, text).drop("seq") for p, label in patterns.items()]
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    order = Window.partitionBy("doc_id").orderBy("byte_start", "byte_end", "entity_type")
    return out.distinct().withColumn("seq", F.row_number().over(order) - 1)


def chunks(docs: DataFrame, size: int = 250_000, overlap: int = 2_000, text: str = "text") -> DataFrame:
    """(doc_id, chunk, char_start, text): windows with overlap; the last ends with the text."""
    if not 0 <= overlap < size:
        raise ValueError("a chunk must be longer than the overlap")
    step = size - overlap
    n = F.length(text)
    last = F.greatest(F.ceil((n - size) / F.lit(step)), F.lit(0)).cast("int")
    out = docs.where(n > 0).select("doc_id", F.col(text).alias("t"), F.explode(F.sequence(F.lit(0), last)).alias("chunk"))
    return out.select("doc_id", "chunk", (F.col("chunk") * step).alias("char_start"), F.substring("t", F.col("chunk") * step + 1, F.lit(size)).alias("text"))


def slices(matches: DataFrame, segments: DataFrame) -> DataFrame:
    """(doc_id, seq, part, src_start, src_end): the source stretches of matches(doc_id, seq, norm_start, norm_end).

    A segment that is the identity gives the part that overlaps, any other its whole image; stretches that touch are one. Part 0 is the
    primary span, the others further evidence.
    """
    s = segments.select(F.col("doc_id").alias("d"), F.col("norm_start").alias("a"), F.col("norm_end").alias("b"), "src_start", "src_end")
    both = matches.join(s, (F.col("doc_id") == F.col("d")) & (F.col("b") > F.col("norm_start")) & (F.col("a") < F.col("norm_end")))
    same = F.col("b") - F.col("a") == F.col("src_end") - F.col("src_start")
    low = F.when(same, F.col("src_start") + F.greatest(F.col("norm_start") - F.col("a"), F.lit(0))).otherwise(F.col("src_start"))
    high = F.when(same, F.col("src_start") + F.least(F.col("norm_end"), F.col("b")) - F.col("a")).otherwise(F.col("src_end"))
    cut = both.select("doc_id", "seq", "a", low.alias("low"), high.alias("high"))
    by = Window.partitionBy("doc_id", "seq").orderBy("a")
    island = F.sum(F.when(F.lag("high").over(by) == F.col("low"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("part", island - 1).groupBy("doc_id", "seq", "part").agg(F.min("low").alias("src_start"), F.max("high").alias("src_end"))


def with_ids(candidates: DataFrame, strategy_id: str, hint: str | None = None, space: str = "normalized_text") -> DataFrame:
    """candidates with candidate_id: the hash of strategy, whole span and payload, the text not being part of it.

    The span's source is (source_ref, content_hash) where candidates have these columns, else the doc_id without a hash; its space is text_anchor_space, or space; page_number is its page where
    there is one. Equal offsets in two documents have two ids.
    """
    if not strategy_id:
        raise ValueError("strategy_id must not be empty")
    kinds = dict(candidates.dtypes)
    text = lambda name, other: json_value(F.col(name), "string") if name in kinds else other
    source = json_object({"content_hash": text("content_hash", F.lit("null")), "source_id": text("source_ref", json_string(F.col("doc_id").cast("string")))})
    page = F.coalesce(json_object({"page_number": F.col("page_number").cast("string"), "page_size": F.lit("null")}), F.lit("null")) if "page_number" in kinds else F.lit("null")
    span = json_object(
        {"bounding_region": F.lit("null"), "byte_end": F.col("byte_end").cast("string"), "byte_start": F.col("byte_start").cast("string"), "page_ref": page, "source_ref": source, "text_anchor_space": text("text_anchor_space", json_string(F.lit(space)))}
    )
    payload = json_value(F.col(hint), "string") if hint else F.lit("null")
    return candidates.withColumn("candidate_id", stable_hash(json_list([json_string(F.lit(strategy_id)), span, F.lit("[]"), payload])))


def duplicate_ids(candidates: DataFrame) -> DataFrame:
    """(doc_id, field_id, candidate_id, n) of ids that aren't unique in their set."""
    return candidates.groupBy("doc_id", "field_id", "candidate_id").agg(F.count("*").alias("n")).where("n > 1")


def merge(sets: list[DataFrame]) -> DataFrame:
    """The union of several strategies' candidates of a field: of equals (text, span, hint, type) the first; source_id lists all their sources."""
    out = None
    for k, one in enumerate(sets):
        one = one.withColumn("__set", F.lit(k))
        out = one if out is None else out.unionByName(one)
    key = ["doc_id", "field_id", "text", "byte_start", "byte_end", "normalized_hint", "entity_type"]
    order = Window.partitionBy(*key).orderBy("__set", "seq")
    source = F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("__set", "seq", "source_id")).over(Window.partitionBy(*key))), lambda x: x["source_id"])), "|")
    first = out.withColumns({"__n": F.row_number().over(order), "__source": source}).where("__n = 1")
    place = Window.partitionBy("doc_id", "field_id").orderBy("__set", "seq")
    return first.withColumns({"seq": F.row_number().over(place) - 1, "source_id": F.col("__source")}).drop("__set", "__n", "__source")


def context_windows(matches: DataFrame, before: int = 450, after: int = 750, longest: int = 1500, most: int = 12, total: int = 10_000) -> DataFrame:
    """(doc_id, rank, char_start, char_end, terms, overflow): ranked windows around matches(doc_id, text, char_start, char_end, term).

    Windows reach before and after the match and are trimmed to longest around it, what one side doesn't use going to the other;
    equal windows are one; there are at most `most`, and the first that exceeds `total` characters ends them.
    """
    n = F.length("text")
    low, high = F.greatest(F.col("char_start") - before, F.lit(0)), F.least(F.col("char_end") + after, n)
    spare = F.lit(longest) - (F.col("char_end") - F.col("char_start"))
    left_want, right_want = F.col("char_start") - F.col("low"), F.col("high") - F.col("char_end")
    half = F.floor(spare / 2)
    left = F.least(left_want, F.greatest(half, spare - right_want))
    right = F.least(right_want, F.greatest(spare - left, F.lit(0)))
    fits = F.col("high") - F.col("low") <= longest
    wide = matches.withColumns({"low": low, "high": high}).select(
        "doc_id", "term", F.when(fits, F.col("low")).otherwise(F.col("char_start") - left).cast("int").alias("s"), F.when(fits, F.col("high")).otherwise(F.col("char_end") + right).cast("int").alias("e")
    )
    one = wide.groupBy("doc_id", "s", "e").agg(F.array_sort(F.collect_set("term")).alias("terms"))
    by = Window.partitionBy("doc_id").orderBy("s", "e")
    ranked = one.withColumns({"rank": F.row_number().over(by) - 1, "sum": F.sum(F.col("e") - F.col("s")).over(by.rowsBetween(Window.unboundedPreceding, 0)), "n": F.count("*").over(Window.partitionBy("doc_id"))})
    kept = ranked.where((F.col("rank") < most) & (F.col("sum") <= total))
    return kept.select("doc_id", "rank", F.col("s").alias("char_start"), F.col("e").alias("char_end"), "terms", (F.col("n") - F.count("*").over(Window.partitionBy("doc_id"))).alias("overflow"))


def snap(text: Column, start: Column, end: Column, marker: str = "\n") -> Column:
    """(start, end) moved out to the marker before and after, in characters: behind the one before, in front of the one after."""
    head = F.substring(text, F.lit(1), start.cast("int"))
    before = F.when(F.instr(head, marker) > 0, F.length(head) - F.length(F.substring_index(head, marker, -1))).otherwise(0)
    at = F.position(F.lit(marker), text, (end + 1).cast("int"))
    after = F.when(at > 0, at - 1).otherwise(F.length(text))
    return F.struct(before.alias("start"), after.alias("end"))


def line_instances(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, instance, line_start, line_end, candidate_ids, context): the candidates of each line that has any, in order."""
    line = docs.select("doc_id", F.explode(lines(F.col("text"))).alias("l")).select(F.col("doc_id").alias("d"), F.col("l.start").alias("line_start"), F.col("l.end").alias("line_end"), F.col("l.text").alias("context"))
    on = (F.col("doc_id") == F.col("d")) & (F.col("byte_start") >= F.col("line_start")) & (F.col("byte_start") <= F.col("line_end"))
    ids = F.transform(F.array_sort(F.collect_list(F.struct("byte_start", "seq", "candidate_id"))), lambda x: x["candidate_id"])
    groups = candidates.join(line, on).groupBy("doc_id", "line_start", "line_end").agg(ids.alias("candidate_ids"), F.first("context").alias("context"))
    return groups.withColumn("instance", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_start")) - 1)


def subset(candidates: DataFrame, chosen: DataFrame) -> DataFrame:
    """The candidates whose ids are in chosen(doc_id, candidate_id), in their order."""
    return candidates.join(chosen.select("doc_id", "candidate_id"), ["doc_id", "candidate_id"], "left_semi")
