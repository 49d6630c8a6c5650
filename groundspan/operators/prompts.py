"""Prompts of bounded ids, their sizes, the reduction of sharded answers, and diagnostics of calls.

A model is an injected function over a DataFrame of requests; here are the relations before and after it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import json_string, stable_hash
from .selection import SET, prompt_ids

TEMPLATE = "Choose from the candidates by id, or abstain."


def render(candidates: DataFrame, descriptions: dict[str, str]) -> DataFrame:
    """(doc_id, field_id, prompt, prompt_chars, prompt_hash, presented): one prompt for each set, candidates in order with bounded ids."""
    about = F.create_map(*(F.lit(x) for pair in descriptions.items() for x in pair))
    line = F.concat_ws(" | ", "prompt_id", "text", F.coalesce("context", F.lit("")))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))), lambda x: x["line"]), "\n")
    by = prompt_ids(candidates).groupBy(*SET).agg(lines.alias("lines"), F.count("*").alias("presented"))
    prompt = F.concat_ws("\n", F.lit(TEMPLATE), F.coalesce(about[F.col("field_id")], F.col("field_id")), F.col("lines"))
    out = by.select(*SET, prompt.alias("prompt"), "presented")
    return out.withColumns({"prompt_chars": F.length("prompt"), "prompt_hash": stable_hash(json_string(F.col("prompt")))})


def translate(answers: DataFrame, candidates: DataFrame) -> DataFrame:
    """answers(doc_id, field_id, prompt_ids) with selected_candidate_ids in the answer's order, and unknown: ids that weren't presented."""
    ids = prompt_ids(candidates).groupBy(*SET).agg(F.map_from_entries(F.collect_list(F.struct("prompt_id", "candidate_id"))).alias("ids"))
    both = answers.join(ids, SET, "left")
    known = F.filter("prompt_ids", lambda x: F.coalesce(F.array_contains(F.map_keys("ids"), x), F.lit(False)))
    return both.select(*SET, F.transform(known, lambda x: F.col("ids")[x]).alias("selected_candidate_ids"), F.array_except("prompt_ids", known).alias("unknown"))


def tournament(shards: DataFrame, select: Callable[[DataFrame], DataFrame], checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """One winner for each set: select maps candidates(doc_id, field_id, shard, seq, candidate_id) to winners among each shard.

    Winners of several shards meet again, two shards as one, until no set has more; a round without progress fails. The
    number of rounds is the logarithm of the shards; checkpoint cuts each round's lineage.
    """
    now, before = checkpoint(select(shards)), None
    while True:
        most = now.groupBy(*SET).agg(F.count_distinct("shard").alias("n")).agg(F.max("n")).first()[0] or 0
        if most <= 1:
            return now.drop("shard")
        if before is not None and most >= before:
            raise RuntimeError("no progress")
        before = most
        rank = F.dense_rank().over(Window.partitionBy(*SET).orderBy("shard")) - 1
        now = checkpoint(select(now.withColumn("shard", F.floor(rank / 2).cast("int"))))


def diagnostics(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """(doc_id, field_id, presented, selected, abstained, answered) of each call."""
    a = answers.select(*SET, F.size("selected_candidate_ids").alias("selected"), (F.col("outcome") == "ABSTAINED").alias("abstained"))
    return requests.join(a, SET, "left").select(*SET, "presented", F.coalesce("selected", F.lit(0)).alias("selected"), F.coalesce("abstained", F.lit(False)).alias("abstained"), F.col("selected").isNotNull().alias("answered"))


def proposer_violation(chosen: DataFrame, allowed: DataFrame) -> DataFrame:
    """(doc_id, violation) of proposers' selections chosen(doc_id, instances): empty, duplicate, unknown."""
    menu = allowed.groupBy("doc_id").agg(F.collect_set("instance").alias("menu"))
    both = chosen.join(menu, "doc_id", "left")
    why = F.when(F.size("instances") == 0, "empty").when(F.size(F.array_distinct("instances")) < F.size("instances"), "duplicate").when(F.size(F.array_except("instances", F.coalesce("menu", F.array().cast("array<int>")))) > 0, "unknown")
    return both.select("doc_id", why.alias("violation")).where("violation IS NOT NULL")
