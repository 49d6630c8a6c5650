"""Selection: one observation for each document and field, with ids from its candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import collapse

SET = ["doc_id", "field_id"]
#: Characters of a window's budget that stay free.
RESERVE = 256


def _ids(order: str = "seq") -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(order, "candidate_id"))), lambda x: x["candidate_id"])


def gate(candidates: DataFrame) -> DataFrame:
    """(doc_id, field_id, candidate_id) of sets in which exactly one candidate is structured and passed."""
    passed = F.coalesce("structural_passed", F.lit(False))
    return candidates.groupBy(*SET).agg(F.count_if(passed).alias("n"), F.max(F.when(passed, F.col("candidate_id"))).alias("candidate_id")).where("n = 1").drop("n")


def singleton(sets: DataFrame, candidates: DataFrame) -> DataFrame:
    """The default: none, the only one, or ambiguous with all of them. sets(doc_id, field_id) are all that are asked for."""
    found = candidates.groupBy(*SET).agg(_ids().alias("ids"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    outcome = F.when(F.size(ids) == 0, "NO_CANDIDATES").when(F.size(ids) == 1, "SELECTED").otherwise("AMBIGUOUS")
    reason = F.when(F.size(ids) > 1, "algorithmic_multi_candidate")
    return sets.select(*SET).join(found, SET, "left").select(*SET, outcome.alias("outcome"), ids.alias("selected_candidate_ids"), reason.alias("reason"))


def presplit(sets: DataFrame, candidates: DataFrame) -> DataFrame:
    """sets with route: auto (the gate decides), empty, or soft (a selector is asked)."""
    some = candidates.select(*SET).distinct().withColumn("some", F.lit(True))
    routed = sets.select(*SET).join(gate(candidates).select(*SET, F.col("candidate_id").alias("auto")), SET, "left").join(some, SET, "left")
    return routed.select(*SET, F.when(F.col("auto").isNotNull(), "auto").when(F.col("some").isNull(), "empty").otherwise("soft").alias("route"))


def _rules(rules: list[tuple[str, str, str]], text: str) -> list[Column]:
    return [F.struct(F.lit(a).alias("literal"), F.lit(p).alias("polarity"), F.regexp_count(F.col(text), F.lit(r)).alias("n")) for a, r, p in rules]


def category_signals(docs: DataFrame, rules: list[tuple[str, str, str]], text: str = "text") -> DataFrame:
    """(doc_id, literal, polarity, n) for rules (literal, pattern, positive | negative | ambiguous) that match."""
    each = docs.select("doc_id", F.explode(F.array(*_rules(rules, text))).alias("r"))
    return each.select("doc_id", "r.literal", "r.polarity", "r.n").where("n > 0")


def category(docs: DataFrame, literals: list[str], rules: list[tuple[str, str, str]], many: bool = False, text: str = "text", uncertain: str | None = None) -> DataFrame:
    """(doc_id, outcome, literals, reason): what rules say, positive without negative.

    With ambiguous, conflicting or no signals the literal uncertain is chosen, if there is one, else none. reason says what decided.
    """
    if uncertain is not None and uncertain not in literals or {rule[0] for rule in rules} - set(literals):
        raise ValueError("rules and the uncertain literal have to name literals of the field")
    rule = F.filter(F.array(*_rules(rules, text)), lambda r: r["n"] > 0)
    says = docs.select("doc_id", rule.alias("rule"))
    named = lambda p: F.array_distinct(F.transform(F.filter("rule", lambda r: r["polarity"] == p), lambda r: r["literal"]))
    left = says.select("doc_id", *(named(p).alias(p) for p in ("positive", "negative", "ambiguous")))
    none = F.array().cast("array<string>")
    of = lambda p: F.coalesce(F.col(p), none)
    arms = F.array(*map(F.lit, literals))
    chosen = F.filter(arms, lambda x: F.array_contains(F.array_except(of("positive"), of("negative")), x))
    n = F.size(chosen)
    reason = F.when(F.size(of("ambiguous")) > 0, "ambiguous_signal").when(F.lit(many), "union").when(n == 1, "single_match").when(n > 1, "conflicting_positive_signals").otherwise("no_signal")
    sure = reason.isin("union", "single_match")
    instead = F.array(F.lit(uncertain)) if uncertain is not None else none
    return left.select(
        "doc_id", F.when(sure | F.lit(uncertain is not None), "SELECTED").otherwise("ABSTAINED").alias("outcome"), F.when(sure, chosen).otherwise(instead).alias("literals"), F.concat(F.lit("rule_based_category."), reason).alias("reason")
    )


def prompt_ids(candidates: DataFrame) -> DataFrame:
    """candidates with prompt_id: c001, c002 ... in each set, three digits at least."""
    n = F.row_number().over(Window.partitionBy(*SET).orderBy("seq"))
    return candidates.withColumn("prompt_id", F.concat(F.lit("c"), F.when(n < 1000, F.lpad(n.cast("string"), 3, "0")).otherwise(n.cast("string"))))


def merged_contexts(spans: DataFrame) -> DataFrame:
    """(doc_id, field_id, context, start, end, n): context intervals that overlap or touch as one."""
    by = Window.partitionBy(*SET).orderBy("byte_start", "byte_end", "seq")
    until = F.max("byte_end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("byte_start") <= F.col("until"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    groups = spans.withColumn("until", until).withColumn("context", island - 1).groupBy(*SET, "context")
    return groups.agg(F.min("byte_start").alias("start"), F.max("byte_end").alias("end"), F.count("*").alias("n"))


def interned_contexts(spans: DataFrame) -> DataFrame:
    """(doc_id, field_id, context, n): distinct contexts, white space collapsed, without those that another one holds."""
    texts = spans.where("context IS NOT NULL").select(*SET, collapse(F.col("context")).alias("context")).groupBy(*SET, "context").agg(F.count("*").alias("n"))
    larger = texts.select(*(F.col(c).alias(f"o_{c}") for c in SET), F.col("context").alias("other"))
    on = (F.col("doc_id") == F.col("o_doc_id")) & (F.col("field_id") == F.col("o_field_id")) & (F.length("other") > F.length("context")) & F.col("other").contains(F.col("context"))
    return texts.join(larger, on, "left_anti")


def packed(tasks: DataFrame, budget: int) -> DataFrame:
    """tasks(doc_id, seq, size) with shard: greedy packing in order; a task beyond the budget is alone and oversize.

    The fold is sequential in a document, over an array of its sizes in the JVM.
    """
    ordered = tasks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "size"))).alias("t"))
    start = F.struct(F.lit(-1).alias("shard"), F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<seq:int,shard:int>>").alias("out"))

    def step(acc, t):
        fresh = (acc["shard"] < 0) | (acc["used"] + t["size"] > budget)
        shard = F.when(fresh, acc["shard"] + 1).otherwise(acc["shard"])
        used = F.when(fresh, F.lit(0).cast("long")).otherwise(acc["used"]) + t["size"]
        return F.struct(shard.alias("shard"), used.alias("used"), F.concat(acc["out"], F.array(F.struct(t["seq"].cast("int").alias("seq"), shard.alias("shard")))).alias("out"))

    out = ordered.select("doc_id", F.explode(F.aggregate("t", start, step, lambda acc: acc["out"])).alias("s")).select("doc_id", "s.seq", "s.shard")
    return tasks.join(out, ["doc_id", "seq"]).withColumn("oversize", F.col("size") > budget)


def document_windows(docs: DataFrame, budget: int, overlap: int = 1000, text: str = "text") -> DataFrame:
    """(doc_id, window, char_start, char_end): windows of budget + 1 - RESERVE characters with overlap."""
    size = budget + 1 - RESERVE
    if size <= 0:
        raise ValueError("the budget leaves no room for a window")
    step, n = max(1, size - overlap), F.length(text)
    last = F.greatest(F.ceil((n - size) / F.lit(step)), F.lit(0)).cast("int")
    each = docs.where(n > 0).select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), last)).alias("window"))
    return each.select("doc_id", "window", (F.col("window") * step).alias("char_start"), F.least(F.col("window") * step + size, "n").alias("char_end"))


def reduce_union(answers: DataFrame, candidates: DataFrame) -> DataFrame:
    """MANY: the ids that any window selected, each once, in candidate order. Answers and candidates meet in one aggregate by set."""
    picked = answers.select(*SET, F.explode("selected_candidate_ids").alias("candidate_id"), F.lit(None).cast(candidates.schema["seq"].dataType).alias("seq"), F.lit(True).alias("picked"))
    both = candidates.select(*SET, "candidate_id", "seq", F.lit(False).alias("picked")).unionByName(picked).where("candidate_id IS NOT NULL")
    of = both.groupBy(*SET).agg(F.array_sort(F.collect_list(F.when(~F.col("picked"), F.struct("seq", "candidate_id")))).alias("all"), F.collect_set(F.when(F.col("picked"), F.col("candidate_id"))).alias("picked"))
    ids = F.array_intersect(F.transform("all", lambda x: x["candidate_id"]), "picked")
    return of.where(F.size("picked") > 0).select(*SET, ids.alias("selected_candidate_ids")).where(F.size("selected_candidate_ids") > 0)


def reduce_priority(answers: DataFrame, priority: list[str]) -> DataFrame:
    """One: of the literals that windows chose, the first in the priority list; abstained if no window chose, unranked if none is listed."""
    index = F.array_position(F.array(*map(F.lit, priority)), F.col("literal"))
    ranked = answers.withColumn("p", F.when(index > 0, index))
    best = F.min_by("literal", "p")
    some, listed = F.count("literal"), F.count("p")
    outcome = F.when(some == 0, "ABSTAINED").when(listed == 0, "UNRANKED").otherwise("SELECTED")
    return ranked.groupBy(*SET).agg(outcome.alias("outcome"), F.when(listed > 0, best).alias("literal"))


def coalesced(answers: DataFrame) -> DataFrame:
    """Duplicate answers for a MANY field as one: ids in order of first appearance; an error where some abstain and some don't."""
    by = answers.groupBy(*SET).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "selected_candidate_ids"))), lambda x: x["selected_candidate_ids"])).alias("ids"), F.bool_or("abstain").alias("some"), F.bool_and("abstain").alias("every"))
    return by.select(*SET, F.array_distinct("ids").alias("selected_candidate_ids"), F.col("every").alias("abstain"), (F.col("some") & ~F.col("every")).alias("mixed"))


def score_observations(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(doc_id, field_id, ids_match, abstain_match, passed): ordered ids and abstention of each expected observation."""
    a = actual.select(*SET, F.col("selected_candidate_ids").alias("got"), F.col("outcome").alias("got_outcome"))
    ids = F.coalesce(F.col("selected_candidate_ids").eqNullSafe(F.col("got")), F.lit(False))
    abstain = (F.col("outcome") == "ABSTAINED") == F.coalesce(F.col("got_outcome") == "ABSTAINED", F.lit(False))
    return expected.join(a, SET, "left").select(*SET, ids.alias("ids_match"), abstain.alias("abstain_match"), (ids & abstain).alias("passed"))


def observations_from_responses(responses: DataFrame) -> DataFrame:
    """responses(doc_id, field_id, cardinality, abstain, selected_candidate_ids, evidence_id, reason) as observations, with violation.

    An answer that neither abstains nor selects is malformed unless the field takes many; an evidence_id beside the selected ones is put right where one is selected, else not_selected.
    """
    n, evidence = F.size("selected_candidate_ids"), F.col("evidence_id")
    among = evidence.isNull() | F.array_contains("selected_candidate_ids", evidence)
    wrong = F.when(~F.col("abstain") & (n == 0) & (F.col("cardinality") != "MANY"), "output_malformed").when(~F.col("abstain") & ~among & (n != 1), "evidence_not_selected")
    none = F.array().cast("array<string>")
    return responses.select(
        *SET, F.when(F.col("abstain"), "ABSTAINED").otherwise("SELECTED").alias("outcome"), F.when(F.col("abstain"), none).otherwise(F.col("selected_candidate_ids")).alias("selected_candidate_ids"),
        F.when(F.col("abstain"), F.lit(None)).when(among, evidence).when(n == 1, F.get("selected_candidate_ids", F.lit(0))).alias("evidence_id"), "reason", wrong.alias("violation"),
    )


def structural_violation(observations: DataFrame, candidates: DataFrame) -> DataFrame:
    """observations(doc_id, field_id, set_field_id, selected_candidate_ids) with violation: field_mismatch, duplicate_ids, unknown_ids, in that order; null where there is none."""
    known = candidates.groupBy("doc_id", F.col("field_id").alias("set_field_id")).agg(F.collect_set("candidate_id").alias("__known"))
    ids = F.col("selected_candidate_ids")
    left = F.size(F.array_except(ids, F.coalesce("__known", F.array().cast("array<string>"))))
    why = F.when(F.col("field_id") != F.col("set_field_id"), "field_mismatch").when(F.size(ids) != F.size(F.array_distinct(ids)), "duplicate_ids").when(left > 0, "unknown_ids")
    return observations.join(known, ["doc_id", "set_field_id"], "left").withColumn("violation", why).select(*observations.columns, "violation")


def candidate_view(candidates: DataFrame, ids: DataFrame) -> DataFrame:
    """The candidates with the ids(doc_id, field_id, candidate_id), in their order and with their seq."""
    return candidates.join(ids.select(*SET, "candidate_id"), [*SET, "candidate_id"], "left_semi").select(*candidates.columns)


def collect_shards(shards: DataFrame, candidates: DataFrame) -> DataFrame:
    """shards(doc_id, field_id, cardinality, shard, selected_candidate_ids) as one answer for each field: ids in candidate order.

    All abstained: so does the field. MANY: the union. One shard with ids: its answer. Several: error reducer_required.
    """
    by = shards.groupBy(*SET, "cardinality").agg(F.count_if(F.size("selected_candidate_ids") > 0).alias("winners"))
    ids = reduce_union(shards, candidates)
    answer = by.join(ids, SET, "left")
    many, none = F.col("cardinality") == "MANY", F.array().cast("array<string>")
    outcome = F.when(F.col("winners") == 0, "ABSTAINED").when(many | (F.col("winners") == 1), "SELECTED").otherwise("ERROR")
    reason = F.when(F.col("winners") == 0, "all shards abstained").when(many, "union of sharded selections").when(F.col("winners") > 1, "deferred_collect.reducer_required")
    return answer.select(*SET, outcome.alias("outcome"), F.when(outcome == "SELECTED", F.coalesce("selected_candidate_ids", none)).otherwise(none).alias("selected_candidate_ids"), reason.alias("reason"))
