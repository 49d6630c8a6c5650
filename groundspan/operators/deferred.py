"""Deferred calls: requests and results of a batch provider, exchanged as relations keyed by request_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import json_object, json_value, stable_hash
from .selection import observations_from_responses


ROUTING = ("document_content_hash", "document_id", "field_id", "instance_id", "parent_request_id", "reducer_round", "shard_count", "shard_index", "window_count", "window_index")


def with_request_id(calls: DataFrame) -> DataFrame:
    """calls(soft_call_identity, spec_hash, output_model_ref, columns of ROUTING) with request_id: the hash of all these, parts of the routing that are null or not there left out."""
    kinds = dict(calls.dtypes)
    parts = F.concat_ws(",", *(F.when(F.col(k).isNotNull(), F.concat(F.lit(f'"{k}":'), json_value(F.col(k), kinds[k]))) for k in ROUTING if k in kinds))
    body = json_object({k: json_value(F.col(k), "string") for k in ("output_model_ref", "soft_call_identity", "spec_hash")} | {"routing": F.concat(F.lit("{"), parts, F.lit("}"))})
    return calls.withColumn("request_id", stable_hash(body))


def aggregate(submissions: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The union of submissions, and (request_id, n) of ids that aren't unique in it."""
    out = submissions[0]
    for more in submissions[1:]:
        out = out.unionByName(more)
    return out, out.groupBy("request_id").agg(F.count("*").alias("n")).where("n > 1")


def results_for(results: DataFrame, requests: DataFrame) -> DataFrame:
    """The results that answer the requests."""
    return results.join(requests.select("request_id"), "request_id", "left_semi")


def collect_contract(requests: DataFrame, results: DataFrame) -> DataFrame:
    """(request_id, verdict): ok, missing, unknown, duplicate, or overlapping where a request both succeeded and failed."""
    r = results.groupBy("request_id").agg(F.count("*").alias("n"), F.count_distinct("status").alias("kinds"))
    both = requests.select("request_id").distinct().withColumn("asked", F.lit(True)).join(r, "request_id", "full_outer")
    verdict = F.when(F.col("asked").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("kinds") > 1, "overlapping").when(F.col("n") > 1, "duplicate").otherwise("ok")
    return both.select("request_id", verdict.alias("verdict"))


def fingerprint(requests: DataFrame) -> DataFrame:
    """(document_id, fingerprint, n) over the sorted request ids."""
    ids = F.array_sort(F.collect_list("request_id"))
    return requests.groupBy("document_id").agg(F.sha2(F.encode(F.array_join(ids, "\n"), "UTF-8"), 256).alias("fingerprint"), F.count("*").alias("n"))


def token_budget(usage: DataFrame, limit: int) -> DataFrame:
    """usage(run_id, seq, input_tokens, output_tokens) with used so far and whether that exceeds the limit; null counts as none."""
    tokens = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    used = F.sum(tokens).over(Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return usage.withColumn("used", used).withColumn("exceeded", F.col("used") > limit)


def render_submission(calls: DataFrame) -> DataFrame:
    """(request_id, line): calls(soft_call_identity, spec_hash, output_model_ref, columns of ROUTING, prompt) as lines of a batch file, keys in order, nulls left out."""
    identified = with_request_id(calls)
    routing = F.struct(*(k for k in ROUTING if k in calls.columns))
    body = F.struct("output_model_ref", "prompt", "request_id", routing.alias("routing"), "soft_call_identity", "spec_hash")
    return identified.select("request_id", F.to_json(body).alias("line"))


def adapt_responses(requests: DataFrame, responses: DataFrame, schema: str) -> DataFrame:
    """requests with output (the payload by schema), usage and status: ok, failed, invalid where the payload isn't what was asked for, missing without a response.

    responses(request_id, payload, error, raw_usage). usage is there only where the provider gave some: none means unknown.
    """
    both = requests.join(responses, "request_id", "left")
    output = F.from_json("payload", schema, {"mode": "PERMISSIVE"})
    empty = F.to_json(output) == "{}"
    status = F.when(F.col("payload").isNull() & F.col("error").isNull(), "missing").when(F.col("error").isNotNull(), "failed").when(output.isNull() | empty, "invalid").otherwise("ok")
    return both.select(*requests.columns, F.when(status == "ok", output).alias("output"), F.col("raw_usage").alias("usage"), status.alias("status"))


def collect(requests: DataFrame, responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(observations, problems) of requests(request_id, doc_id, field_id, cardinality): answers adapted and checked; problems(request_id, problem) stop a submission, as in collect_contract.

    responses(request_id, payload, error, raw_usage); the payload holds abstain, selected_candidate_ids, evidence_id and reason.
    """
    verdicts = collect_contract(requests, responses.select("request_id", F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("status"))).where("verdict <> 'ok'")
    adapted = adapt_responses(requests, responses.join(verdicts.where("verdict IN ('duplicate', 'overlapping')"), "request_id", "left_anti"), "abstain boolean, selected_candidate_ids array<string>, evidence_id string, reason string")
    answers = adapted.where("status = 'ok'").select("request_id", "doc_id", "field_id", "cardinality", F.coalesce("output.abstain", F.lit(False)).alias("abstain"), F.coalesce("output.selected_candidate_ids", F.array().cast("array<string>")).alias("selected_candidate_ids"), "output.evidence_id", "output.reason")
    observations = observations_from_responses(answers)
    problems = verdicts.select("request_id", F.col("verdict").alias("problem")).unionByName(adapted.where("status IN ('failed', 'invalid')").select("request_id", F.col("status").alias("problem")))
    return observations, problems
