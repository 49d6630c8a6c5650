"""Scoring against gold data: joins of gold with what was found, and the rates over them.

gold(case_id, field_id, gold_index, text, byte_start, byte_end, expected_value, expected_absent)
found(case_id, field_id, seq, candidate_id, text, context, byte_start, byte_end, kept)
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import casefold, iou

KEY = ["case_id", "field_id"]
DIFF_KINDS = ("missing_field", "unexpected_field", "value_mismatch", "instance_count_mismatch")
STATUSES = ("passed", "failed", "comparability_failed", "setup_failed")


def span_match(mode: str, a_start: Column, a_end: Column, b_start: Column, b_end: Column, min_iou: float = 0.5) -> Column:
    """Whether gold span a and found span b match; contains: gold covers what was found."""
    there = a_start.isNotNull() & a_end.isNotNull() & b_start.isNotNull() & b_end.isNotNull()  # greatest and least pass over nulls
    common = F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start), F.lit(0))
    return there & {
        "exact": (a_start == b_start) & (a_end == b_end),
        "overlap": common > 0,
        "contains": (a_start <= b_start) & (a_end >= b_end),
        "contained_by": (b_start <= a_start) & (b_end >= a_end),
        "iou": iou(a_start, a_end, b_start, b_end) >= min_iou,
    }[mode]


def _is_evidence() -> Column:
    return F.col("text").isNotNull() | F.col("byte_start").isNotNull()


def _pairs(gold: DataFrame, found: DataFrame) -> DataFrame:
    """Each gold evidence with each candidate of its field; texts case-folded once a row, before the join."""
    g = gold.where(_is_evidence()).select(*KEY, "gold_index", casefold(F.col("text")).alias("g_text"), F.col("byte_start").alias("g_start"), F.col("byte_end").alias("g_end"))
    return g.join(found.withColumns({"f_text": casefold(F.col("text")), "f_context": casefold(F.col("context"))}), KEY)


def _yes(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _via(mode: str, min_iou: float, allow_context: bool) -> Column:
    span = span_match(mode, F.col("g_start"), F.col("g_end"), F.col("byte_start"), F.col("byte_end"), min_iou)
    context = F.contains("f_context", "g_text") & F.contains("g_text", "f_text") & F.lit(allow_context)
    return F.when(_yes(span), "span").when(_yes(F.contains("f_text", "g_text")), "text").when(_yes(context), "context")


def matches(gold: DataFrame, found: DataFrame, mode: str = "overlap", min_iou: float = 0.5, allow_context: bool = True) -> DataFrame:
    """(case_id, field_id, gold_index, seq, kept, via): span where the spans match; else text where the candidate holds gold's; else
    context where that does and the candidate is part of gold's text."""
    return _pairs(gold, found).withColumn("via", _via(mode, min_iou, allow_context)).where("via IS NOT NULL").select(*KEY, "gold_index", "seq", "kept", "via")


def _is_near() -> Column:
    span = span_match("overlap", F.col("g_start"), F.col("g_end"), F.col("byte_start"), F.col("byte_end"))
    part = (F.col("f_text") != "") & F.contains("g_text", "f_text")
    around = (F.col("g_text") != "") & F.contains("f_context", "g_text")
    return _yes(span) | _yes(part) | _yes(around)


def near_misses(gold: DataFrame, found: DataFrame) -> DataFrame:
    """(case_id, field_id, gold_index, seq): the first candidate that overlaps the gold span, or is part of gold's text, or has it in its context."""
    return _pairs(gold, found).where(_is_near()).groupBy(*KEY, "gold_index").agg(F.min("seq").alias("seq"))


def expected_fields(gold: DataFrame) -> DataFrame:
    """(case_id, field_id, expected, absent): gold evidence of all instances of a field together; absent if any says so."""
    return gold.groupBy(*KEY).agg(F.count_if(_is_evidence()).alias("expected"), F.bool_or("expected_absent").alias("absent"))


def _present(gold: DataFrame) -> DataFrame:
    """The gold of fields that aren't expected to be absent."""
    return gold.withColumn("__absent", F.bool_or("expected_absent").over(Window.partitionBy(*KEY))).where("NOT __absent").drop("__absent")


def attributions(gold: DataFrame, found: DataFrame, mode: str = "overlap", min_iou: float = 0.5, allow_context: bool = True) -> DataFrame:
    """(case_id, field_id, gold_index, stage, kind, seq): why gold was missed.

    candidates: span_near_miss with the first near candidate, or not_generated, where nothing matches; filtered_candidates:
    generated_then_filtered for each match that was dropped, where no kept one matches; comparability: fixture_missing_evidence for a field without evidence.
    """
    gold = _present(gold)
    judged = _pairs(gold, found).withColumns({"hit": _via(mode, min_iou, allow_context).isNotNull(), "near": _is_near()})
    by = judged.groupBy(*KEY, "gold_index").agg(
        F.bool_or("hit").alias("hit"), F.bool_or(F.col("hit") & F.col("kept")).alias("kept"), F.min(F.when(F.col("near"), F.col("seq"))).alias("near"), F.array_sort(F.collect_list(F.when(F.col("hit") & ~F.col("kept"), F.col("seq")))).alias("dropped")
    )
    both = gold.where(_is_evidence()).select(*KEY, "gold_index").join(by, [*KEY, "gold_index"], "left")
    of_seq = dict(found.dtypes)["seq"]
    row = lambda stage, kind, seq: F.struct(F.lit(stage).alias("stage"), kind.alias("kind"), seq.cast(of_seq).alias("seq"))
    missed = F.array(row("candidates", F.when(F.col("near").isNull(), "not_generated").otherwise("span_near_miss"), F.col("near")))
    filtered = F.transform("dropped", lambda x: row("filtered_candidates", F.lit("generated_then_filtered"), x))
    why = F.when(~_yes(F.col("hit")), missed).when(~F.col("kept"), filtered)
    none = expected_fields(gold).where("expected = 0").select(*KEY, F.lit(None).cast(dict(gold.dtypes)["gold_index"]).alias("gold_index"), row("comparability", F.lit("fixture_missing_evidence"), F.lit(None)).alias("a"))
    return both.select(*KEY, "gold_index", F.explode(why).alias("a")).unionByName(none).select(*KEY, "gold_index", "a.*")


def _rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def score_candidates(gold: DataFrame, found: DataFrame, mode: str = "overlap", min_iou: float = 0.5, allow_context: bool = True) -> DataFrame:
    """For each case and field: gold and candidates, those that hit, of all and of the kept ones, recall and precision (null where there is nothing), gaps and status.

    A field that is expected to be absent has no recall, and all its candidates are wrong; one without evidence can't be compared, and nothing of it counts.
    """
    hits = matches(gold, found, mode, min_iou, allow_context)
    count = lambda c, name: hits.groupBy(*KEY, c).agg(F.bool_or("kept").alias("kept")).groupBy(*KEY).agg(F.count("*").alias(f"raw_{name}"), F.count_if("kept").alias(f"kept_{name}"))
    totals = found.groupBy(*KEY).agg(F.count("*").alias("raw"), F.count_if("kept").alias("kept"))
    fields = expected_fields(gold).withColumn("comparable", F.col("absent") | (F.col("expected") > 0))
    out = fields.join(totals, KEY, "left").join(count("gold_index", "hits"), KEY, "left").join(count("seq", "true"), KEY, "left")
    zero = F.lit(0).cast("long")
    own = {c: F.when(F.col("comparable"), F.coalesce(c, zero)).otherwise(zero) for c in ("raw", "kept")}
    own |= {c: F.when(F.col("absent"), zero).otherwise(F.coalesce(c, zero)) for c in ("expected", "raw_hits", "kept_hits", "raw_true", "kept_true")}
    out = out.select(*KEY, "absent", "comparable", *(c.alias(k) for k, c in own.items()))
    gap = lambda n, hit: F.when(~F.col("comparable"), "comparability_failure").when(F.col("absent") & (F.col(n) > 0), "unexpected_observed").when(F.col(hit) < F.col("expected"), "missing_expected")
    out = out.withColumns(
        {"raw_recall": _rate(F.col("raw_hits"), F.col("expected")), "kept_recall": _rate(F.col("kept_hits"), F.col("expected")), "raw_precision": _rate(F.col("raw_true"), F.col("raw")), "kept_precision": _rate(F.col("kept_true"), F.col("kept"))}
        | {"raw_gap": gap("raw", "raw_hits"), "kept_gap": gap("kept", "kept_hits"), "dropped": F.col("raw") - F.col("kept")}
    )
    status = F.when(~F.col("comparable"), STATUSES[2]).when(F.col("raw_gap").isNotNull() | F.col("kept_gap").isNotNull(), STATUSES[1]).otherwise(STATUSES[0])
    return out.withColumn("status", status).drop("comparable")


def aggregates(rows: DataFrame) -> DataFrame:
    """(metric, part, whole, rate): sums over all fields of score_candidates, then the rate; null where the whole is none."""
    c = F.col
    pairs = {}
    for stage, n in (("candidates", "raw"), ("filtered", "kept")):
        hits, true = c(f"{n}_hits"), c(f"{n}_true")
        pairs |= {
            f"recall_at_{stage}": (hits, c("expected")), f"precision_at_{stage}": (true, c(n)), f"true_positive_at_{stage}": (hits, c("expected")),
            f"false_negative_at_{stage}": (c("expected") - hits, c("expected")), f"false_positive_at_{stage}": (c(n) - true, c(n)),
        }
    sums = rows.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(f"{m}_{k}") for m, pair in pairs.items() for k, x in enumerate(pair)))
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"{m}_0").alias("part"), F.col(f"{m}_1").alias("whole")) for m in pairs)))
    return sums.select(each.alias("x")).select("x.metric", "x.part", "x.whole", _rate(F.col("x.part"), F.col("x.whole")).alias("rate"))


def worst_status(rows: DataFrame) -> DataFrame:
    """(case_id, status): the worst of a case's."""
    place = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    return rows.groupBy("case_id").agg(F.max_by("status", place).alias("status"))


def funnel(gold: DataFrame, candidates: DataFrame, observations: DataFrame, validated: DataFrame, evidence: DataFrame) -> DataFrame:
    """(case_id, field_id, gold_index, stage, attribution): how far each gold value came, and why no farther.

    candidates(case_id, field_id, candidate_id, text), observations(case_id, field_id, outcome, selected_candidate_ids),
    validated(case_id, field_id, candidate_id), evidence(case_id, field_id, candidate_id, value).
    """
    g = gold.where("NOT expected_absent").select(*KEY, "gold_index", F.col("text").alias("g_text"), "expected_value")
    hit = g.join(candidates.select(*KEY, "candidate_id", "text"), KEY).where(F.contains(casefold(F.col("text")), casefold(F.col("g_text")))).groupBy(*KEY, "gold_index").agg(F.collect_set("candidate_id").alias("ids"))
    obs = observations.select(*KEY, "outcome", "selected_candidate_ids")
    sets = lambda df, name: df.groupBy(*KEY).agg(F.collect_set("candidate_id").alias(name))
    values = evidence.groupBy(*KEY).agg(F.collect_set("value").alias("values"))
    both = g.join(hit, [*KEY, "gold_index"], "left").join(obs, KEY, "left").join(sets(validated, "valid"), KEY, "left").join(sets(evidence, "used"), KEY, "left").join(values, KEY, "left")
    none = F.array().cast("array<string>")
    c = lambda name: F.coalesce(F.col(name), none)
    chosen = F.array_intersect(c("ids"), c("selected_candidate_ids"))
    steps = [
        (F.size(c("ids")) == 0, "candidate", "not_generated"),
        ((F.size(chosen) == 0) & (F.coalesce(F.col("outcome"), F.lit("ABSTAINED")) != "SELECTED"), "selection", "selection_abstained"),
        (F.size(chosen) == 0, "selection", "wrong_candidate_selected"),
        (F.size(F.array_intersect(chosen, c("valid"))) == 0, "validation", "validation_rejected"),
        (F.size(F.array_intersect(chosen, c("used"))) == 0, "materialization", "materialization_missing"),
        (F.col("expected_value").isNotNull() & ~F.array_contains(c("values"), F.col("expected_value")), "value", "normalization_mismatch"),
    ]
    pick = lambda k: reduce(lambda acc, s: F.when(s[0], s[k]).otherwise(acc), reversed(steps), F.lit("complete") if k == 1 else F.lit(None).cast("string"))
    return both.select(*KEY, "gold_index", pick(1).alias("stage"), pick(2).alias("attribution"))


def value_hits(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """(case_id, field_id, expected, hits): expected values that aren't null, and how many of them were observed."""
    seen = observed.select(*KEY, "value").distinct().withColumn("seen", F.lit(1))
    return expected.where("value IS NOT NULL").join(seen, [*KEY, "value"], "left").groupBy(*KEY).agg(F.count("*").alias("expected"), F.count("seen").alias("hits"))


def diff_instances(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(case_id, idx, field_id, kind): differences of (case_id, idx, field_id, seq, value), instances compared by place, a field by its last value."""
    last = lambda df, name: df.groupBy("case_id", "idx", "field_id").agg(F.max_by("value", "seq").alias(name), F.lit(True).alias(f"has_{name}"))
    both = last(expected, "e").join(last(actual, "a"), ["case_id", "idx", "field_id"], "full_outer")
    kind = F.when(F.col("has_a").isNull(), "missing_field").when(F.col("has_e").isNull(), "unexpected_field").when(~F.col("e").eqNullSafe(F.col("a")), "value_mismatch")
    fields = both.withColumn("kind", kind).where("kind IS NOT NULL").select("case_id", "idx", "field_id", "kind")
    n = lambda df, name: df.groupBy("case_id").agg(F.count_distinct("idx").alias(name))
    counts = n(expected, "ne").join(n(actual, "na"), "case_id", "full_outer").where("NOT ne <=> na")
    return fields.unionByName(counts.select("case_id", F.lit(None).cast(dict(fields.dtypes)["idx"]).alias("idx"), F.lit(None).cast("string").alias("field_id"), F.lit(DIFF_KINDS[3]).alias("kind")))


def counts_by_kind(diffs: DataFrame) -> DataFrame:
    """(kind, n), kinds without differences too."""
    kinds = diffs.sparkSession.createDataFrame([(k,) for k in DIFF_KINDS], "kind string")
    return kinds.join(diffs.groupBy("kind").agg(F.count("*").alias("n")), "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


def alignment(fixtures: DataFrame, replays: DataFrame) -> DataFrame:
    """(case_id, replay_id, status): fixtures and the replays of their case; comparability_failed without one."""
    return fixtures.select("case_id").join(replays.select("case_id", "replay_id"), "case_id", "left").withColumn("status", F.when(F.col("replay_id").isNull(), STATUSES[2]).otherwise(STATUSES[0]))


def candidate_summaries(found: DataFrame) -> DataFrame:
    """(case_id, field_id, n, kept, summary): each set's candidates as one line, in order."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("seq", "text", "byte_start", "byte_end"))), lambda x: F.concat(x["text"], F.lit("@"), x["byte_start"], F.lit("-"), x["byte_end"]))
    return found.groupBy(*KEY).agg(F.count("*").alias("n"), F.count_if("kept").alias("kept"), F.array_join(line, "; ").alias("summary"))


def smoke(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(case_id, matched, differences): cases of either side, and whether nothing differs."""
    cases = expected.select("case_id").union(actual.select("case_id")).distinct()
    n = diff_instances(expected, actual).groupBy("case_id").agg(F.count("*").alias("n"))
    return cases.join(n, "case_id", "left").select("case_id", F.col("n").isNull().alias("matched"), F.coalesce("n", F.lit(0)).alias("differences"))


def json_safe(df: DataFrame) -> DataFrame:
    """Decimals, dates and times as strings, dates in ISO form; other types stay."""
    plain = lambda c, t: F.col(c).cast("string").alias(c) if t.startswith(("decimal", "date", "timestamp")) else F.col(c)
    return df.select(*(plain(c, t) for c, t in df.dtypes))
