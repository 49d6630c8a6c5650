"""From observations to validated fields: cardinality, layers of checks, typed negatives for every absence.

negatives(doc_id, field_id, category, code, reason, candidate_count)
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import byte_length, decimal_value
from ..sources.adapters import invert, span_violation

SET = ["doc_id", "field_id"]
NEGATIVE = ["doc_id", "field_id", "category", "code", "reason", "candidate_count"]


def cardinality_code(outcome: Column, cardinality: Column, n: Column) -> Column:
    """category/code of the negative that an observation gives, null if its candidates go on."""
    one = cardinality.isin("ONE", "PER_INSTANCE")
    return (
        F.when(outcome != "SELECTED", F.concat(F.lit("selection/"), F.lower(outcome)))
        .when((n == 0) & one, "adaptation/empty_selection")
        .when((n == 0) & (cardinality == "OPTIONAL"), "selection/abstained")
        .when((n > 1) & one, "validation/cardinality.one_expected_many_selected")
        .when((n > 1) & (cardinality == "OPTIONAL"), "validation/cardinality.optional_expected_many_selected")
    )


def _judged(observations: DataFrame, fields: DataFrame) -> DataFrame:
    f = F.broadcast(fields.select(F.col("field_id"), "cardinality"))  # fields come from the specification, a class with a few attributes
    return observations.join(f, "field_id").withColumn("n", F.size("selected_candidate_ids")).withColumn("verdict", cardinality_code(F.col("outcome"), F.col("cardinality"), F.col("n")))


def cardinality_negatives(observations: DataFrame, fields: DataFrame) -> DataFrame:
    parts = F.split("verdict", "/", 2)
    code = F.get(parts, F.lit(1))
    return _judged(observations, fields).where("verdict IS NOT NULL").select(*SET, F.get(parts, F.lit(0)).alias("category"), code.alias("code"), F.coalesce("reason", code).alias("reason"), F.col("n").alias("candidate_count"))


def proposed(observations: DataFrame, candidates: DataFrame, fields: DataFrame) -> DataFrame:
    """(doc_id, field_id, position, candidate_id, raw_value, byte_start, byte_end): what selections propose, in their order."""
    ids = _judged(observations, fields).where("verdict IS NULL").select(*SET, F.posexplode("selected_candidate_ids").alias("position", "candidate_id"))
    c = candidates.select(*SET, "candidate_id", F.col("text").alias("raw_value"), "byte_start", "byte_end")
    return ids.join(c, [*SET, "candidate_id"])


def layer1(fields: DataFrame, docs: DataFrame) -> DataFrame:
    """fields(..., space, byte_start, byte_end, and evidence_spans of such structs, if there) with code: the first span's first failing check, null if none.

    docs(doc_id, text, space, segments): the space that the document's adapter declares, source_bytes if not there, and its anchor map, by default that of a plain text. A span in another
    space is a mismatch, but for the point at a document's head; a normalized one that is out of range or not aligned fails as utf8_alignment, a source one that the map can't invert as span_out_of_range.
    """
    own = {"text": F.col("text"), "__declared": F.col("space") if "space" in docs.columns else F.lit("source_bytes")}
    own["__segments"] = F.col("segments") if "segments" in docs.columns else F.array(F.struct(*(x.cast("long").alias(n) for n, x in (("norm_start", F.lit(0)), ("norm_end", byte_length(F.col("text"))), ("src_start", F.lit(0)), ("src_end", byte_length(F.col("text")))))))
    joined = fields.join(docs.select("doc_id", *(c.alias(k) for k, c in own.items())), "doc_id")

    def wrong(space: Column, start: Column, end: Column) -> Column:
        head = (space == "normalized_text") & (start == 0) & (end == 0)
        negative = (start < 0) | (end < start)
        return (
            F.when((space != F.col("__declared")) & ~head, "candidate.text_anchor_space_mismatch")
            .when((space == "normalized_text") & span_violation(F.col("text"), space, start, end).isNotNull(), "candidate.utf8_alignment")
            .when((space != "normalized_text") & (negative | invert(F.col("__segments"), start, end).isNull()), "candidate.span_out_of_range")
        )

    code = wrong(F.col("space"), F.col("byte_start"), F.col("byte_end"))
    if "evidence_spans" in fields.columns:
        code = F.coalesce(code, F.get(F.filter(F.transform("evidence_spans", lambda x: wrong(x["space"], x["byte_start"], x["byte_end"])), lambda x: x.isNotNull()), F.lit(0)))
    return joined.withColumn("code", code).select(*fields.columns, "code")


#: Native normalizers by value type: null means that the value doesn't validate.
NORMALIZERS: dict[str, Callable[[Column], Column]] = {
    "str": lambda c: c,
    "int": lambda c: F.trim(c).try_cast("long").cast("string"),
    "decimal": lambda c: F.trim(c).try_cast("decimal(38,10)").cast("string"),
    "amount": lambda c: decimal_value(c).cast("string"),
    "date": lambda c: F.when(F.trim(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.trim(c).try_cast("date").cast("string")),
    "bool": lambda c: F.when(F.lower(F.trim(c)).isin("1", "true", "t", "yes", "y", "on"), "true").when(F.lower(F.trim(c)).isin("0", "false", "f", "no", "n", "off"), "false"),
}


def layer2(fields: DataFrame, kind: str = "kind", value: str = "raw_value") -> DataFrame:
    """fields with normalized_value, by their kind; null with code field_failure where it doesn't validate."""
    out = F.lit(None).cast("string")
    for name, normalize in NORMALIZERS.items():
        out = F.when(F.col(kind) == name, normalize(F.col(value))).otherwise(out)
    return fields.withColumn("normalized_value", out).withColumn("code", F.when(F.col("normalized_value").isNull(), "field_failure"))


def layer2_python(fields: DataFrame, normalizers: dict[str, Callable[[str], Any]], value: str = "raw_value") -> DataFrame:
    """The same with a Python callable for each field_id, in Arrow batches; ValueError is a failure, no result keeps the value."""

    @F.pandas_udf("struct<normalized_value string, code string, reason string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for names, values in batches:
            rows = []
            for name, v in zip(names, values):
                try:
                    got = normalizers[name](v) if name in normalizers else v
                    rows.append((str(v if got is None else got), None, None))
                except ValueError as e:
                    rows.append((None, "field_failure", str(e)))
            yield pd.DataFrame(rows, columns=["normalized_value", "code", "reason"])

    return fields.withColumn("__r", run("field_id", value)).select("*", "__r.*").drop("__r")


def failures(checked: DataFrame, category: str = "validation") -> DataFrame:
    """The negatives of fields with a code."""
    return checked.where("code IS NOT NULL").select(*SET, F.lit(category).alias("category"), "code", F.col("code").alias("reason"), F.lit(1).alias("candidate_count"))


def cross_field(values: DataFrame, rules: dict[str, tuple[str, list[str], str]]) -> DataFrame:
    """(doc_id, rule, severity, implicates): rules that don't hold, over the last value of each field.

    values(doc_id, field_id, seq, normalized_value); rules: name to (SQL over field names, fields implicated, error | warning). A null
    result holds: a rule about an absent field says nothing.
    """
    names = sorted({f for _, fields, _ in rules.values() for f in fields})
    last = values.groupBy("doc_id").agg(*(F.max_by(F.when(F.col("field_id") == f, F.col("normalized_value")), F.when(F.col("field_id") == f, F.col("seq"))).alias(f) for f in names))
    issues = [F.when(~F.coalesce(F.expr(sql), F.lit(True)), F.struct(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), F.array(*map(F.lit, fields)).alias("implicates"))) for name, (sql, fields, severity) in rules.items()]
    each = last.select("doc_id", F.explode(F.filter(F.array(*issues), lambda x: x.isNotNull())).alias("i"))
    return each.select("doc_id", "i.*")


def escalated(instances: DataFrame, issues: DataFrame) -> DataFrame:
    """instances(doc_id, outcome) with the outcome after cross-field errors: kept, but partial; warnings change nothing."""
    errors = issues.where("severity = 'error'").groupBy("doc_id").agg(F.array_sort(F.collect_list("rule")).alias("errors"))
    return instances.join(errors, "doc_id", "left").withColumn("outcome", F.when(F.col("errors").isNotNull(), "partial").otherwise(F.col("outcome")))


def repaired(original: DataFrame, second: DataFrame, failing: DataFrame, field_order: list[str]) -> DataFrame:
    """original without the fields that failed, those of the second pass in their place, in declaration order (column ordinal)."""
    keys = failing.select(*SET).distinct()
    both = original.join(keys, SET, "left_anti").unionByName(second.join(keys, SET, "left_semi"))
    return both.withColumn("ordinal", F.array_position(F.array(*map(F.lit, field_order)), F.col("field_id")) - 1)


def field_feedback(negatives: DataFrame) -> DataFrame:
    """(doc_id, field_id, reasons): the fields to select once more, with what was wrong, in order. negatives(doc_id, field_id, seq, category, code, reason)."""
    own = negatives.where("category = 'validation' AND code = 'field_failure'")
    return own.groupBy(*SET).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "reason"))), lambda x: x["reason"]).alias("reasons"))


def object_feedback(issues: DataFrame) -> DataFrame:
    """(doc_id, field_id, reasons): fields that errors of whole objects implicate; warnings implicate none. issues(doc_id, seq, severity, implicates, reason)."""
    each = issues.where("severity = 'error'").select("doc_id", F.explode("implicates").alias("field_id"), "seq", "reason")
    return each.groupBy(*SET).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "reason"))), lambda x: x["reason"]).alias("reasons"))


def repair_once(values: DataFrame, negatives: DataFrame, again: DataFrame, again_negatives: DataFrame, feedback: DataFrame, field_order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Values and negatives after one more selection of the fields with feedback: these lose both and take those of the second pass, whatever it says; there is no third."""
    keys = feedback.select(*SET).distinct()
    left = negatives.join(keys, SET, "left_anti").unionByName(again_negatives.join(keys, SET, "left_semi"))
    return repaired(values, again, keys, field_order), left
