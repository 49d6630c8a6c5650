"""The extraction operators: semantics that the SQL comparisons don't reach."""

import hashlib
import json
import random
import re
from decimal import Decimal
from typing import Annotated, Literal

import pytest
from pyspark.sql import functions as F

from groundspan import queries as q
from groundspan.functions import text as tx
from groundspan.operators import candidates as cd
from groundspan.operators import deferred, filters as fl
from groundspan.operators import instances as ins
from groundspan.operators import scoring as sc
from groundspan.operators import selection as sel
from groundspan.operators import validation as va
from groundspan.plans.extract import extract, extract_instances, objects, with_characters
from groundspan.plans.spec import Field, Regex, Rule, SpecError, analyze, compile_spec, dependency_order, lookup
from groundspan.sources import adapters as ad
from groundspan.sources.store import Collision, Store, batch_lines, fixture_pack, parse_batch, read_json_lines, read_replays, replay_rows, run_fingerprint, smoke_cases

SAMPLES = ["", "plain", "héllo 日本 😀", "a\nb\n\nc", 'quote " back \\ tab\t', "x" * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(SAMPLES)), "doc_id long, text string")


def test_hash_is_that_of_canonical_json(docs):
    from hashlib import sha256

    got = {r.doc_id: r for r in ad.text_view(docs).collect()}
    for i, text in enumerate(SAMPLES):
        assert got[i].content_hash == sha256(json.dumps(text, ensure_ascii=False).encode()).hexdigest()
        assert len(got[i].segments) == (text != "")


def test_offsets_of_bytes_and_characters(docs):
    rows = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.octet_length("text"))).alias("o")).where("o < 60")
    for r in rows.withColumn("a", tx.is_aligned(F.col("text"), F.col("o"))).collect():
        raw = r.text.encode()
        assert r.a == (r.o == len(raw) or raw[r.o] & 0xC0 != 0x80)
    cut = docs.where("doc_id = 2").select(tx.context_bytes(F.col("text"), F.lit(2), F.lit(3), 0, 5).alias("c")).first().c
    assert "�" in cut
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        docs.where("doc_id = 2").select(tx.slice_bytes(F.col("text"), F.lit(2), F.lit(4))).collect()


@pytest.mark.parametrize(
    ("html", "text", "segments"),
    [("<p>A&amp;B</p>", "A&B", 3), ("<p>x&#65;y</p>", "xAy", 3), ("<p>héllo 日本</p>", "héllo 日本", 1), ("", "", 0), ("<b>a</b><!-- c --><i>b</i>", "ab", 2), ("<script>if (a &amp; b)</script>", "if (a &amp; b)", 1), ("&nosuch; x", "&nosuch; x", 2), ("a &copy b", "a © b", 3)],
)
def test_html_is_linear(html, text, segments):
    shown, parts = ad.linearize(html)
    assert shown == text and len(parts) == segments
    raw, at = html.encode(), 0
    for s in parts:
        assert s["norm_start"] == at
        at = s["norm_end"]
        image = raw[s["src_start"] : s["src_end"]].decode()
        assert image == text.encode()[s["norm_start"] : s["norm_end"]].decode() or image.startswith("&")


def test_entity_has_whole_image(spark):
    page = ad.html_view(spark.createDataFrame([(1, "<p>a &amp; b</p>"), (2, None)], "doc_id long, html string"))
    rows = {r.doc_id: r for r in page.collect()}
    assert rows[2].text is None and rows[1].text == "a & b"
    found = page.where("doc_id = 1").select(F.lit(1).cast("long").alias("doc_id"), F.lit(0).alias("seq"), F.lit(1).alias("norm_start"), F.lit(4).alias("norm_end"))
    segments = page.where("doc_id = 1").select("doc_id", F.explode("segments").alias("s")).select("doc_id", "s.*")
    assert [(r.part, r.src_start, r.src_end) for r in cd.slices(found, segments).collect()] == [(0, 4, 11)]
    assert page.where("doc_id = 1").select(ad.map_violation(F.col("segments"), F.col("text")).alias("v")).first().v is None


def test_patterns_agree_with_python(spark, docs):
    pattern = r"[a-z]+|日"
    want = sorted((i, k, m.group().decode(), *m.span()) for i, t in enumerate(SAMPLES) for k, m in enumerate(re.finditer(pattern.encode(), t.encode())))
    for got in (cd.regex_native(docs, pattern), cd.regex_general(docs, cd.RegexParams(pattern=pattern))):
        assert sorted((r.doc_id, r.seq, r.text, r.byte_start, r.byte_end) for r in got.collect()) == want
    for bad in ({"pattern": ""}, {"pattern": "("}, {"pattern": "a", "flags": True}, {"pattern": "a", "window": -1}, {"pattern": "a", "other": 1}, {"pattern": "a", "group": 1.5}):
        with pytest.raises(ValueError):
            cd.RegexParams(**bad)
    optional = cd.RegexParams(pattern="(a)|b", group=1)
    assert [m[0] for m in optional.matches(b"ab")] == [b"a"]
    with pytest.raises(ValueError):
        list(cd.RegexParams(pattern="a", group=3).matches(b"a"))
    assert list(cd.RegexParams(pattern="a", group=3).matches(b"b")) == []


DECIMALS = {
    "approximately $116.18": "116.18", "$42.1M": "42100000", "$42.1 million": "42100000", "about $42.1 million aggregate": "42100000", "US$258M": "258000000", "$300.1 million": "300100000",
    "8.6073 units per $1,000": None, "about $258M and about $42.1M": None, "$5.": None, "$5.00.": None, "12%": "12", "5% million": None, "none": None, "": None, "-4": "-4", "1,234,567.50": "1234567.5",
}


def test_decimals(spark):
    rows = spark.createDataFrame([(k,) for k in DECIMALS], "t string").select("t", tx.decimal_hint(tx.decimal_value(F.col("t"))).alias("v"))
    assert {r.t: r.v for r in rows.collect()} == DECIMALS
    assert Decimal(DECIMALS["US$258M"]) == 258_000_000


def candidates(spark, rows):
    full = [(1, "f", k, f"c{k}", t, a, b, label, None, c) for k, (t, a, b, label, c) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, field_id string, seq int, candidate_id string, text string, byte_start int, byte_end int, entity_type string, normalized_hint string, context string")


def test_filters(spark):
    c = candidates(spark, [("x", 0, 15, "DATE", "Straße"), ("5", 8, 9, "CARDINAL", "b"), ("20", 30, 32, "CARDINAL", None), ("z", 30, 32, None, "")])
    kept = lambda e: [r.text for r in fl.apply(c, e).orderBy("seq").collect()]
    both = fl.And((fl.LabelIn(("CARDINAL",)), fl.Not(fl.ContainedBy("DATE"))))
    assert kept(both) == ["20"] and kept(fl.LabelNotIn(("DATE",))) == ["5", "20", "z"] and kept(fl.Contains()) == ["x"]
    assert kept(fl.ContextContains(any_of=("STRASSE",))) == ["x"] and kept(fl.ContextContains(any_of=("STRASSE",), case_sensitive=True)) == []
    assert kept(fl.NumericRange(5, 20, high_inclusive=False)) == ["5"]
    assert fl.Expr.from_json(json.loads(json.dumps(both.to_json()))) == both
    for bad in (lambda: fl.LabelIn(()), lambda: fl.NumericRange(), lambda: fl.And(()), lambda: fl.ContextContains()):
        with pytest.raises(ValueError):
            bad()


def test_cardinality_table(spark):
    rows, want = [], {}
    table = {
        ("ONE", 0): "empty_selection", ("ONE", 1): None, ("ONE", 2): "cardinality.one_expected_many_selected", ("PER_INSTANCE", 0): "empty_selection", ("PER_INSTANCE", 1): None, ("PER_INSTANCE", 2): "cardinality.one_expected_many_selected",
        ("OPTIONAL", 0): "abstained", ("OPTIONAL", 1): None, ("OPTIONAL", 2): "cardinality.optional_expected_many_selected", ("MANY", 0): None, ("MANY", 1): None, ("MANY", 2): None,
    }
    for k, ((kind, n), code) in enumerate(table.items()):
        rows.append((k, kind, "SELECTED", [f"c{i}" for i in range(n)], None))
        want[k] = code
    rows.append((99, "ONE", "AMBIGUOUS", ["c0", "c1"], "two"))
    observations = spark.createDataFrame(rows, "doc_id long, field_id string, outcome string, selected_candidate_ids array<string>, reason string")
    fields = spark.createDataFrame([(k, k) for k in ("ONE", "OPTIONAL", "MANY", "PER_INSTANCE")], "field_id string, cardinality string")
    got = {r.doc_id: r for r in va.cardinality_negatives(observations, fields).collect()}
    assert {k: v for k, v in want.items() if v} == {k: r.code for k, r in got.items() if k != 99}
    assert (got[99].category, got[99].code, got[99].reason, got[99].candidate_count) == ("selection", "ambiguous", "two", 2)


def test_authorities(spark):
    keys = spark.createDataFrame([(1, 0, "a", 0, 10), (1, 1, "b", 50, 60)], "doc_id long, ordinal int, group_id string, anchor_start int, anchor_end int")
    fields = spark.createDataFrame(
        [(1, "f", 0, 5, 7, "b", True), (1, "f", 1, 5, 7, None, False), (1, "f", 2, 20, 22, None, False), (1, "f", 3, 29, 31, None, False), (1, "f", 4, 29, 31, "b", False)],
        "doc_id long, field_id string, seq int, byte_start int, byte_end int, tentative_key string, boundary_defining boolean",
    )
    got = {r.seq: (r.bucket, r.authority, r.ambiguous_on) for r in ins.assign(fields, keys).collect()}
    assert got == {0: (1, "boundary", None), 1: (0, "continuity", None), 2: (0, "cooccurrence", None), 3: (None, None, "cooccurrence"), 4: (1, "prior", None)}
    assert {r.seq: r.authority for r in ins.assign(fields, keys, with_plan=False).collect()}[4] is None


def test_packing_and_windows(spark):
    tasks = spark.createDataFrame([(1, k, n) for k, n in enumerate([30, 40, 50, 200, 10, 90])], "doc_id long, seq int, size long")
    got = [(r.shard, r.oversize) for r in sel.packed(tasks, 100).orderBy("seq").collect()]
    assert got == [(0, False), (0, False), (1, False), (2, True), (3, False), (3, False)]
    with pytest.raises(ValueError):
        sel.document_windows(tasks, 100)


def test_scores_of_absent_and_missing(spark):
    gold = spark.createDataFrame([("a", "f", 0, "hit", None, None, None, False), ("a", "g", 0, None, None, None, None, True), ("b", "f", 0, None, 0, 4, None, False)], "case_id string, field_id string, gold_index int, text string, byte_start int, byte_end int, expected_value string, expected_absent boolean")
    found = spark.createDataFrame([("a", "f", 0, "a HIT!", "", 0, 3, True), ("a", "g", 0, "x", "", 0, 1, True), ("b", "f", 0, "y", "", 2, 6, False)], "case_id string, field_id string, seq int, text string, context string, byte_start int, byte_end int, kept boolean")
    rows = {(r.case_id, r.field_id): r for r in sc.score_candidates(gold, found, "exact").collect()}
    assert rows["a", "f"].raw_recall == 1 and rows["a", "g"].raw_recall is None and rows["a", "g"].absent and rows["b", "f"].raw_recall == 0
    assert (rows["a", "f"].status, rows["a", "g"].status, rows["a", "g"].raw_gap, rows["b", "f"].raw_gap) == ("passed", "failed", "unexpected_observed", "missing_expected")
    assert {r.kind for r in sc.attributions(gold, found, "exact").collect()} == {"span_near_miss"}
    assert sc.span_match("iou", F.lit(0), F.lit(0), F.lit(0), F.lit(0)) is not None


GOLD = "case_id string, field_id string, gold_index int, text string, byte_start int, byte_end int, expected_value string, expected_absent boolean"
FOUND = "case_id string, field_id string, seq int, text string, context string, byte_start int, byte_end int, kept boolean"


def one_field(spark, gold, found):
    """gold (text, start, end) and candidates (text, context, start, end, kept) of a field."""
    g = spark.createDataFrame([("c", "f", k, *row, None, False) for k, row in enumerate(gold)], GOLD)
    return g, spark.createDataFrame([("c", "f", k, *row) for k, row in enumerate(found)], FOUND)


@pytest.mark.parametrize(
    ("gold", "found", "mode", "via"),
    [
        (("1.25%", None, None), ("Rate 1.25% a year", "", 0, 17, True), "overlap", "text"),
        (("x", 0, 10), ("y", "", 2, 5, True), "contains", "span"),  # gold covers what was found
        (("x", 0, 10), ("y", "", 2, 5, True), "contained_by", None),
        (("x", 2, 5), ("y", "", 0, 10, True), "contained_by", "span"),
        (("x", 2, 5), ("y", "", 0, 10, True), "contains", None),
        (("x", 0, 4), ("y", "", 4, 8, True), "overlap", None),
        (("x", 0, 4), ("y", "", 0, 4, True), "exact", "span"),
        (("The Rate", 0, 4), ("the rate is", "", 20, 31, True), "overlap", "text"),  # after a span that misses
        (("STRASSE", None, None), ("straße 5", "", 0, 9, True), "overlap", "text"),
        (("2.5 per cent", None, None), ("2.5", "at 2.5 per cent", 0, 3, True), "overlap", "context"),
        (("2.5 per cent", None, None), ("7", "at 2.5 per cent", 0, 1, True), "overlap", None),  # the candidate isn't part of gold's text
        ((None, None, None), ("7", "", 0, 1, True), "overlap", None),
    ],
)
def test_how_gold_matches(spark, gold, found, mode, via):
    g, f = one_field(spark, [gold], [found])
    assert [r.via for r in sc.matches(g, f, mode).collect()] == ([via] if via else [])
    if via == "context":
        assert sc.matches(g, f, mode, allow_context=False).count() == 0


def test_why_gold_was_missed(spark):
    gold = [("alpha", None, None), ("beta gamma", None, None), ("delta", None, None), ("eps", 50, 60), ("zeta", None, None)]
    found = [("alpha!", "", 0, 6, False), ("alphas", "", 0, 6, False), ("beta", "", 8, 12, True), ("q", "near Delta", 20, 21, True), ("r", "", 55, 70, True), ("zeta", "", 80, 84, True), ("zeta", "", 90, 94, False)]
    got = {tuple(r)[2:] for r in sc.attributions(*one_field(spark, gold, found), "exact").collect()}
    assert got == {
        (0, "filtered_candidates", "generated_then_filtered", 0), (0, "filtered_candidates", "generated_then_filtered", 1), (1, "candidates", "span_near_miss", 2),
        (2, "candidates", "span_near_miss", 3), (3, "candidates", "span_near_miss", 4),
    }
    none = one_field(spark, [("omega", None, None)], [("psi", "", 0, 3, True)])
    assert [tuple(r)[2:] for r in sc.attributions(*none).collect()] == [(0, "candidates", "not_generated", None)]
    bare = one_field(spark, [(None, None, None)], [("psi", "", 0, 3, True)])
    assert [tuple(r)[2:] for r in sc.attributions(*bare).collect()] == [(None, "comparability", "fixture_missing_evidence", None)]
    assert [(r.status, r.raw, r.expected) for r in sc.score_candidates(*bare).collect()] == [("comparability_failed", 0, 0)]


def test_totals_over_fields(spark):
    g = spark.createDataFrame([("c", "f", 0, "a", None, None, None, False), ("c", "f", 1, "b", None, None, None, False), ("c", "g", 0, None, None, None, None, True)], GOLD)
    f = spark.createDataFrame([("c", "f", 0, "a", "", 0, 1, True), ("c", "f", 1, "z", "", 2, 3, True), ("c", "f", 2, "b", "", 4, 5, False), ("c", "g", 0, "a", "", 0, 1, True)], FOUND)
    got = {r.metric: (r.part, r.whole) for r in sc.aggregates(sc.score_candidates(g, f)).collect()}
    assert got == {
        "recall_at_candidates": (2, 2), "precision_at_candidates": (2, 4), "true_positive_at_candidates": (2, 2), "false_negative_at_candidates": (0, 2), "false_positive_at_candidates": (2, 4),
        "recall_at_filtered": (1, 2), "precision_at_filtered": (1, 3), "true_positive_at_filtered": (1, 2), "false_negative_at_filtered": (1, 2), "false_positive_at_filtered": (2, 3),
    }


def test_deferred_budget_is_strict(spark):
    usage = spark.createDataFrame([(1, 0, 50, None), (1, 1, None, 50), (1, 2, 1, None)], "run_id int, seq int, input_tokens int, output_tokens int")
    assert [r.exceeded for r in deferred.token_budget(usage, 100).orderBy("seq").collect()] == [False, False, True]


class Invoice:
    vendor: Annotated[str, Field("vendor id", (Regex(r"VND-\d{4}", native=True),), kind="CARDINAL")]
    total: Annotated[Decimal, Field("the total", (Regex(r"Total: (?P<v>\$[\d.]+)", group="v", entity_type="MONEY"),), keep=fl.And((fl.LabelIn(("MONEY",)), fl.NumericRange(high=1000))))]
    items: Annotated[list[int], Field("item numbers", (Regex(r"item (\d+)", group=1),))]
    due: Annotated[str | None, Field("due date", (Regex(r"due [A-Z]\w+ \d+", native=True),))]
    kind: Annotated[Literal["invoice", "receipt"], Field("what it is", rules=(Rule("invoice", "(?i)invoice"), Rule("receipt", "(?i)receipt")))]


def test_extraction_end_to_end(spark):
    docs = spark.createDataFrame(
        [(1, "Invoice VND-1001\nTotal: $220.18\nitem 3, item 4\ndue April 28"), (2, "Receipt VND-1002 VND-1003\nTotal: $5000"), (3, ""), (4, "invoice and receipt VND-1004 Total: $3 ")], "doc_id long, text string"
    )
    spec = compile_spec(Invoice, {"cheap": ("CAST(total AS DOUBLE) < 100", ["total"], "error")})
    run = extract(docs, spec)
    got = {r.doc_id: r for r in objects(run, spec).collect()}
    assert (got[1].vendor, got[1].total, got[1]["items"], got[1].due, got[1].kind, got[1].missing) == ("VND-1001", "220.1800000000", ["3", "4"], "due April 28", "invoice", [])
    assert got[2].vendor is None and got[2].kind == "receipt" and got[2].missing == ["vendor", "total"] and got[4].kind is None
    codes = {(r.doc_id, r.field_id, r.code) for r in run.negatives.collect()}
    assert {(1, None, "instance_failure"), (2, "vendor", "ambiguous"), (2, "total", "no_candidates"), (3, "vendor", "no_candidates"), (4, "kind", "abstained")} <= codes
    assert {r.doc_id: r.outcome for r in run.outcomes.collect()} == {1: "partial", 2: "partial", 3: "failed", 4: "partial"}
    place = with_characters(run.evidence, docs).where("doc_id = 1 AND field_id = 'vendor'").first()
    assert (place.char_start, place.char_end) == (8, 16)
    assert lookup(spec.version) is Invoice and compile_spec(Invoice).version == spec.version


def test_specifications_are_checked():
    assert dependency_order({"c": ("a",), "b": ("a",), "a": ()}) == ["a", "b", "c"]
    for bad in ({"a": ("a",)}, {"a": ("b",), "b": ("a",)}, {"a": ("x",)}):
        with pytest.raises(SpecError):
            dependency_order(bad)
    for annotation in (dict, int | str, Literal[1], tuple[int]):
        with pytest.raises(SpecError):
            analyze(annotation)
    make = lambda a: type("C", (), {"__annotations__": {"x": a}})
    for a in (str, Annotated[str, Field("")], Annotated[str, Field("d")], Annotated[Literal["a", "b"], Field("d")], Annotated[str, Field("d", (Regex("a"),), kind="ODD")]):
        with pytest.raises(SpecError):
            compile_spec(make(a))


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/store")
    rows = replay_rows(spark.createDataFrame([("d1", "complete"), ("d2", "failed")], "document_id string, outcome string"))
    assert store.put(rows) == 2 and store.put(rows) == 0
    with pytest.raises(Collision):
        store.put(rows.withColumn("body", F.lit("other")))
    bad = spark.createDataFrame([("x", "replay", "{"), ("y", "replay", '{"schema_version":"v9"}')], "id string, kind string, body string")
    back = {r.id: r for r in read_replays(store.objects().unionByName(bad), "document_id string, outcome string").collect()}
    assert back["x"].error == "malformed" and back["y"].error == "incompatible"
    assert {r.document_id for r in back.values() if not r.error} == {"d1", "d2"}
    store.put_manifests(spark.createDataFrame([("r2", "d", "complete", "f"), ("r1", "d", "complete", "f")], "run_id string, document_id string, outcome string, fingerprint string"))
    assert store.run_ids() == ["r1", "r2"]
    assert run_fingerprint({"b": "1", "a": "2"}) == run_fingerprint({"a": "2", "b": "1"})


def test_lines_in_and_out(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.txt").write_text("one\ntwo")
    good = '{"case_id":"a","document_path":"a.txt","expected_instances":[]}'
    (tmp_path / "good.jsonl").write_text(good + "\n\n")
    assert [(r.case_id, r.text) for r in fixture_pack(spark, str(tmp_path / "good.jsonl"), str(tmp_path / "docs")).collect()] == [("a", "one\ntwo")]
    for bad in (good + "\n" + good, good.replace("a.txt", "../a.txt"), "{not json"):
        (tmp_path / "bad.jsonl").write_text(bad)
        with pytest.raises(Exception):
            fixture_pack(spark, str(tmp_path / "bad.jsonl"), str(tmp_path / "docs")).collect()
    asked = batch_lines(spark.createDataFrame([("r1", "p")], "request_id string, prompt string"), "m").collect()
    assert json.loads(asked[0].value)["custom_id"] == "r1"
    answers = ['{"custom_id":"r1","response":{"status_code":200,"body":{"choices":[{"message":{"content":"yes"}}]}}}', '{"custom_id":"r2","error":{"message":"no"}}', " "]
    got = {r.request_id: (r.status, r.payload) for r in parse_batch(spark.createDataFrame([(a,) for a in answers], "value string")).collect()}
    assert got == {"r1": ("ok", "yes"), "r2": ("failed", "no")}
    assert read_json_lines(spark, str(tmp_path / "good.jsonl"), "case_id string").count() == 1


def test_streams(spark, tmp_path):
    from groundspan.streaming.extract import candidate_stream, write_extractions

    source = f"{tmp_path}/in"
    docs = [(1, "Invoice VND-1001 Total: $2"), (2, "nothing")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(source)
    stream = spark.readStream.schema("doc_id long, text string").parquet(source)
    write_extractions(stream, compile_spec(Invoice), f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    found = spark.read.parquet(f"{tmp_path}/out/evidence")
    assert {r.field_id for r in found.where("doc_id = 1").collect()} == {"vendor", "total", "kind"}
    assert candidate_stream(stream, compile_spec(Invoice)).isStreaming


def test_phrases_chunks_and_lines(spark):
    docs = spark.createDataFrame([(1, "Acme Corp. and Acme, not Acmeter\nAcme")], "doc_id long, text string")
    assert [(r.byte_start, r.entity_type) for r in cd.phrases(docs, {"Acme": "ORG", "Acme Corp": "ORG"}).orderBy("seq").collect()] == [(0, "ORG"), (0, "ORG"), (15, "ORG"), (33, "ORG")]
    text = "".join(random.Random(1).choices("abc \n", k=1003))
    parts = cd.chunks(spark.createDataFrame([(1, text)], "doc_id long, text string"), 100, 10).orderBy("chunk").collect()
    assert all(p.text == text[p.char_start : p.char_start + 100] for p in parts) and parts[-1].char_start + len(parts[-1].text) == len(text)
    with pytest.raises(ValueError):
        cd.chunks(docs, 10, 10)


def test_every_query_has_a_unique_name_and_columns(spark):
    assert len(q.QUERIES) == len(set(q.QUERIES)) and set(q.ORACLES) <= set(q.QUERIES)
    for name in ("p1_label_in", "e4_matches_iou", "sf1_decimals"):
        assert q.QUERIES[name](spark, "/root/testdata/sf0.001").columns


def test_reasons_say_what_failed(spark):
    rows = [(1, "f", 0, "12.50", None, "Alpha beta", "A", 0, 5), (1, "f", 1, "many", None, "gamma", None, 0, 9)]
    c = spark.createDataFrame(rows, "doc_id long, field_id string, seq int, text string, normalized_hint string, context string, entity_type string, byte_start int, byte_end int")
    why = lambda expr: [r.reason for r in fl.drops(c, expr).orderBy("seq").collect()]
    assert why(fl.LabelIn(("B", "C"))) == ["entity_type 'A' not in labels=('B', 'C')", "entity_type None not in labels=('B', 'C')"]
    assert why(fl.LabelNotIn(("A",))) == ["entity_type 'A' is excluded by labels=('A',)"]
    assert why(fl.NumericRange(low=20)) == ["value 12.5 below lower bound 20", "candidate is not numeric"]
    assert why(fl.NumericRange(high=3)) == ["value 12.5 above upper bound 3", "candidate is not numeric"]
    assert why(fl.ContextContains(any_of=("x", "y"))) == ["missing any_of=('x', 'y')"] * 2
    assert why(fl.ContextContains(all_of=("ALPHA", "x"))) == ["missing all_of=('x',)", "missing all_of=('ALPHA', 'x')"]
    assert why(fl.ContainedBy()) == ["not contained by label=None"] and why(fl.Contains("Z")) == ["does not contain label='Z'"] * 2
    assert why(fl.Not(fl.LabelIn(("A",)))) == ["negated expression matched"]
    assert why(fl.Or((fl.LabelIn(("B",)), fl.LabelIn(("C",))))) == ["no child expression matched"] * 2


def test_ids_hold_whole_spans_and_calls(spark):
    rows = spark.createDataFrame([(1, 0, 4), (2, 0, 4)], "doc_id long, byte_start int, byte_end int")
    ids = {r.candidate_id for r in cd.with_ids(rows, "s").union(cd.with_ids(rows, "s", space="source_bytes")).union(cd.with_ids(rows, "t")).collect()}
    assert len(ids) == 6
    calls = spark.createDataFrame([("i", "s", "m", "f", 1), ("i", "s2", "m", "f", 1), ("i", "s", "m2", "f", 1), ("i", "s", "m", "f", None)], "soft_call_identity string, spec_hash string, output_model_ref string, field_id string, shard_index int")
    got = [r.request_id for r in deferred.with_request_id(calls).collect()]
    body = '{"output_model_ref":"m","routing":{"field_id":"f","shard_index":1},"soft_call_identity":"i","spec_hash":"s"}'
    assert len(set(got)) == 4 and got[0] == hashlib.sha256(body.encode()).hexdigest()


def test_uncertain_literal(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a"), (3, ""), (4, "a odd"), (5, None)], "doc_id long, text string")
    rules = [("x", "a", "positive"), ("y", "b", "positive"), ("x", "odd", "ambiguous")]
    got = {r.doc_id: (r.outcome, r.literals, r.reason.split(".")[1]) for r in sel.category(docs, ["x", "y", "?"], rules, uncertain="?").collect()}
    assert got == {1: ("SELECTED", ["?"], "conflicting_positive_signals"), 2: ("SELECTED", ["x"], "single_match"), 3: ("SELECTED", ["?"], "no_signal"), 4: ("SELECTED", ["?"], "ambiguous_signal"), 5: ("SELECTED", ["?"], "no_signal")}
    assert {r.doc_id: r.literals for r in sel.category(docs, ["x", "y"], rules, many=True).collect()} == {1: ["x", "y"], 2: ["x"], 3: [], 4: [], 5: []}
    with pytest.raises(ValueError):
        sel.category(docs, ["x", "y"], rules, uncertain="?")


def test_ambiguous_fields_make_their_target_partial(spark):
    fields = spark.createDataFrame([(1, "f", 0, 0, 4, "none", False, "ONE", "v"), (1, "g", 1, 10, 30, "none", False, "ONE", "w"), (2, "f", 0, 0, 4, "none", False, "ONE", "v")], "doc_id long, field_id string, seq int, byte_start int, byte_end int, tentative_key string, boundary_defining boolean, cardinality string, value string")
    keys = spark.createDataFrame([(1, 0, "a", 0, 8), (1, 1, "b", 12, 20), (1, 2, "c", 22, 28)], "doc_id long, ordinal int, group_id string, anchor_start int, anchor_end int")
    assigned = {(r.doc_id, r.field_id): (r.bucket, r.authority, r.ambiguous_on, r.target) for r in ins.assign(fields, keys).collect()}
    assert assigned == {(1, "f"): (0, "continuity", None, None), (1, "g"): (None, None, "continuity", 1), (2, "f"): (None, None, None, 0)}
    got = {(r.doc_id, r.ordinal): (len(r.fields), r.negatives, [tuple(a) for a in r.anchors], r.outcome) for r in ins.compose(ins.cardinality_policy(ins.assign(fields, keys))).collect()}
    assert got == {(1, 0): (1, [], [(0, 4)], "complete"), (1, 1): (0, ["g:ambiguous_grouping"], [], "partial"), (2, 0): (0, ["f:ambiguous_grouping"], [], "partial")}


def test_smoke_manifests_are_checked(spark, tmp_path):
    def load(*cases):
        (tmp_path / "m.json").write_text(json.dumps({"cases": [{"case_id": c, "schema_id": k, "document_path": d, "expected_instances": [{"n": 1}]} for c, k, d in cases]}))
        return smoke_cases(spark, f"{tmp_path}/m.json", {"invoice"})

    assert {r.case_id for r in load(("a", "invoice", "docs/a.txt"), ("b", "invoice", "b..txt")).collect()} == {"a", "b"}
    for cases, why in (([("a", "invoice", "x"), ("a", "invoice", "y")], "duplicate_case_id"), ([("a", "letter", "x")], "missing_schema"), ([("a", "invoice", "../x")], "path_escape"), ([("a", "invoice", "/etc/x")], "path_escape")):
        with pytest.raises(ValueError, match=why):
            load(*cases)


def test_streamed_instances_are_in_order(spark):
    rows = spark.createDataFrame([(2, 0, []), (1, 1, ["b:x", "a:y"]), (1, 0, ["c:z"])], "doc_id long, ordinal int, negatives array<string>")
    assert [(r.doc_id, r.ordinal) for r in ins.stream(rows)] == [(1, 0), (1, 1), (2, 0)]
    assert [tuple(r) for r in ins.flat_negatives(rows).orderBy("doc_id", "position").collect()] == [(1, 0, 0, "c:z"), (1, 1, 1, "b:x"), (1, 2, 1, "a:y")]


def test_collected_answers_and_problems(spark):
    requests = spark.createDataFrame([(f"r{k}", 1, "f", "ONE") for k in range(6)], "request_id string, doc_id long, field_id string, cardinality string")
    good = '{"selected_candidate_ids": ["c1"], "evidence_id": "c1", "reason": "fits"}'
    responses = spark.createDataFrame([("r0", good, None, "u"), ("r1", None, "timeout", None), ("r2", "no json", None, None), ("r3", good, None, None), ("r3", good, None, None), ("r4", good, None, None), ("r4", None, "late", None), ("zz", good, None, None)], "request_id string, payload string, error string, raw_usage string")
    observations, problems = deferred.collect(requests, responses)
    assert [(r.outcome, r.selected_candidate_ids, r.evidence_id, r.violation) for r in observations.collect()] == [("SELECTED", ["c1"], "c1", None)]
    assert {tuple(r) for r in problems.collect() if r.problem != "missing" or r.request_id == "r5"} == {("r1", "failed"), ("r2", "invalid"), ("r3", "duplicate"), ("r4", "overlapping"), ("r5", "missing"), ("zz", "unknown")}


def test_a_second_pass_replaces_what_failed_once(spark):
    value = "doc_id long, field_id string, seq int, value string"
    negative = "doc_id long, field_id string, seq int, category string, code string, reason string"
    values = spark.createDataFrame([(1, "a", 0, "old"), (1, "b", 0, "good"), (2, "a", 0, "fine")], value)
    negatives = spark.createDataFrame([(1, "a", 0, "validation", "field_failure", "too long"), (1, "a", 1, "validation", "field_failure", "not a date"), (1, "b", 0, "selection", "abstained", "unsure")], negative)
    again = spark.createDataFrame([(1, "a", 0, "new"), (2, "a", 0, "never asked")], value)
    worse = spark.createDataFrame([(1, "a", 0, "validation", "field_failure", "still wrong")], negative)
    feedback = va.field_feedback(negatives)
    assert [(r.field_id, r.reasons) for r in feedback.collect()] == [("a", ["too long", "not a date"])]
    kept, left = va.repair_once(values, negatives, again, worse, feedback, ["a", "b"])
    assert {(r.doc_id, r.field_id, r.value) for r in kept.collect()} == {(1, "a", "new"), (1, "b", "good"), (2, "a", "fine")}
    assert {(r.field_id, r.reason) for r in left.collect()} == {("a", "still wrong"), ("b", "unsure")}


def test_instances_have_their_own_fields_and_spans(spark):
    text = "VND-0001 Total: $5\nVND-0002 Total: $7\nno vendor, héé Total: $9"
    size = [len(x.encode()) for x in text.split("\n")]
    begin = [0, size[0] + 1, size[0] + size[1] + 2]
    keys = spark.createDataFrame([(1, k, b, b + n) for k, (b, n) in enumerate(zip(begin, size))], "doc_id long, ordinal int, anchor_start int, anchor_end int")
    docs = spark.createDataFrame([(1, text), (2, "VND-0003 Total: $1")], "doc_id long, text string")
    spec = compile_spec(Invoice)
    run = extract_instances(docs, spec, keys)
    got = {(r.doc_id, r.ordinal): r.vendor for r in objects(run, spec).collect()}
    assert got == {(1, 0): "VND-0001", (1, 1): "VND-0002", (1, 2): None}
    for r in run.evidence.where("field_id = 'vendor' OR field_id = 'total'").collect():
        assert text.encode()[r.byte_start : r.byte_end].decode() == r.raw_value
    assert {(r.doc_id, r.outcome, r.instances) for r in run.outcomes.collect()} == {(1, "partial", 3), (2, "failed", 0)}
    assert ("vendor", 2) in {(r.field_id, r.ordinal) for r in run.negatives.collect()}


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name", ["g5_cooccurrence", "g7_assign", "g9_cardinality_policy", "g10_compose", "g11_signals", "g12_discriminators", "r3_flat_evidence", "r3_flat_negatives"])
def test_assignment_moves_each_relation_once(spark, no_broadcast, name):
    """Fields, keys and candidates are each sent over the network once, by document, and what is found of a field is found once."""
    plan = q.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3
    assert plan.count("Exchange") == 3


def test_nearest_with_odd_keys_and_spans(spark):
    """Several candidates of one field, ties, keys without an ordinal, fields without candidates, without ids and without keys."""
    fields = spark.createDataFrame(
        [(1, "a", 0, ["x", "y"], 0, 5, "g", True), (1, "a", 1, ["z"], 0, 0, "h", True), (1, "a", 2, None, 40, 45, None, False), (2, "a", 0, ["x"], 0, 5, "g", True)],
        "doc_id long, field_id string, seq int, candidate_ids array<string>, byte_start int, byte_end int, tentative_key string, boundary_defining boolean",
    )
    keys = spark.createDataFrame([(1, 0, "g", 10, 12), (1, 1, "g", 30, 32), (1, 2, "h", 50, 52), (1, None, "g", 0, 90)], "doc_id long, ordinal int, group_id string, anchor_start int, anchor_end int")
    candidates = spark.createDataFrame([(1, "a", "x", 5, 9), (1, "a", "y", 33, 34), (1, "a", "y", 44, 49), (1, "b", "z", 10, 11), (2, "a", "x", 5, 9)], "doc_id long, field_id string, candidate_id string, byte_start int, byte_end int")
    got = {(r.doc_id, r.seq): (r.decisive, r.bucket, r.buckets) for r in ins.by_cooccurrence(fields, keys, candidates).collect()}
    assert got == {(1, 0): (False, 0, 3)}  # all three are one byte away
    own = {(r.doc_id, r.seq): (r.decisive, r.bucket, r.buckets) for r in ins.by_cooccurrence(fields, keys).collect()}
    assert own == {(1, 0): (True, 0, 1), (1, 1): (True, 0, 1), (1, 2): (True, 2, 1)}
    out = {(r.doc_id, r.seq): (r.bucket, r.authority, r.ambiguous_on, r.target) for r in ins.assign(fields, keys, candidates=candidates).collect()}
    assert out == {(1, 0): (None, None, "cooccurrence", 0), (1, 1): (2, "boundary", None, None), (1, 2): (None, None, None, 0), (2, 0): (None, None, None, 0)}


def test_a_number_is_searched_for_once(spark):
    """Whatever the text, a search and a split; values as before: signs, groups, per cent, magnitudes, letters that fold."""
    texts = ["$1,234.50", "-$3", "US$2.5M", "5%", "5% million", "1 and 2", "none", "about 7 BN net", "x5", "5.", "3 mm", "٥", "4 K", "€10 thousand", "12k%", "6\n%", None, "9 million.", "1,23"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(tx.decimal_value(F.col("t")).cast("double").alias("v"))
    assert [r.v for r in df.collect()] == [1234.5, -3.0, 2.5e6, 5.0, None, None, None, 7e9, None, None, 3e6, 5.0, 4000.0, 10000.0, 12000.0, 6.0, None, 9.0, None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_") == 2


def test_union_of_windows_in_one_aggregate(spark):
    c = spark.createDataFrame([(1, "f", 2, "b"), (1, "f", 0, "z"), (1, "f", 1, "a"), (2, "f", 0, "b"), (3, "f", 0, None)], "doc_id long, field_id string, seq int, candidate_id string")
    answers = spark.createDataFrame([(1, "f", ["b", "z"]), (1, "f", ["z", "gone"]), (2, "f", []), (3, "f", [None]), (4, "f", ["b"])], "doc_id long, field_id string, selected_candidate_ids array<string>")
    out = sel.reduce_union(answers, c)
    assert [tuple(r) for r in out.collect()] == [(1, "f", ["z", "b"])]
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["extract_objects", "extract_instance_objects"])
def test_evidence_runs_patterns_once(spark, name):
    plan = q.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and plan.count("posexplode(aggregate(") == 2
    assert "split(text" not in "".join(x for x in plan.splitlines() if "Window" in x)


def test_evidence_is_what_observations_propose(spark, docs):
    class Mixed:
        words: Annotated[list[str], Field("words", (Regex("[a-z]+", native=True), Regex("(l+)", group=1)))]
        one: Annotated[str, Field("a word before a space", (Regex(r"([a-z]+) ", group=1),))]
        topic: Annotated[list[Literal["p", "q"]], Field("kind", rules=(Rule("p", "l"), Rule("q", "o"), Rule("q", "plain", "negative")))]
        fixed: Annotated[Literal["always"], Field("constant")]

    spec = compile_spec(Mixed)
    run = extract(docs, spec)
    names = spark.createDataFrame([(f.field_id, f.cardinality) for f in spec.fields], "field_id string, cardinality string")
    want = va.proposed(run.observations, run.candidates, names)
    rows = lambda df: sorted(map(tuple, df.select("doc_id", "field_id", "position", "candidate_id", "raw_value", "byte_start", "byte_end").collect()))
    assert rows(run.evidence) == rows(want) != []


def test_long_texts_of_matches_leave_in_parts(spark):
    out = cd.regex_general(spark.createDataFrame([(1, "a" * 25_001), (2, None), (3, "ba")], "doc_id long, text string"), cd.RegexParams(pattern="a"))
    assert [tuple(r) for r in out.groupBy("doc_id").agg(F.count("*"), F.max("seq"), F.max("byte_end")).orderBy("doc_id").collect()] == [(1, 25_001, 25_000, 25_001), (3, 1, 0, 2)]
