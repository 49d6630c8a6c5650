"""Instances: grouping keys, assignment of fields by authority, cardinality, composition, roll-up."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions.text import gap, json_list, json_string, overlap, stable_hash

#: Authorities, strongest first.
AUTHORITIES = ("boundary", "continuity", "cooccurrence", "prior")


def _single(pairs: DataFrame, authority: str) -> DataFrame:
    """Of (doc_id, field_id, seq, bucket): the fields with exactly one bucket."""
    by = pairs.distinct().groupBy("doc_id", "field_id", "seq").agg(F.count("*").alias("n"), F.min("bucket").alias("bucket"))
    return by.select("doc_id", "field_id", "seq", (F.col("n") == 1).alias("decisive"), "bucket", F.col("n").alias("buckets"), F.lit(authority).alias("authority"))


def by_boundary(fields: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys that equal the field's own tentative key, for boundary-defining fields."""
    k = keys.select("doc_id", F.col("group_id").alias("tentative_key"), F.col("ordinal").alias("bucket"))
    return _single(fields.where("boundary_defining").join(k, ["doc_id", "tentative_key"]).select("doc_id", "field_id", "seq", "bucket"), AUTHORITIES[0])


def _near(fields: DataFrame, keys: DataFrame) -> DataFrame:
    k = keys.select("doc_id", F.col("ordinal").alias("bucket"), "anchor_start", "anchor_end")
    return fields.join(k, "doc_id")


def by_continuity(fields: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys whose anchors overlap the field's span."""
    hit = overlap(F.col("byte_start"), F.col("byte_end"), F.col("anchor_start"), F.col("anchor_end"))
    return _single(_near(fields, keys).where(hit).select("doc_id", "field_id", "seq", "bucket"), AUTHORITIES[1])


def _around(fields: DataFrame, keys: DataFrame, candidates: DataFrame | None) -> DataFrame:
    """fields with what lies around them in their document: keys, an array of (bucket, group_id, anchor_start, anchor_end), and near, of each key (far, bucket): the least gap between its anchor and
    the spans of the candidates that the field refers to (candidate_ids), or without candidates its own; null where there are none.

    Keys and candidates come as one row for each document, so that all is joined by document and nothing is sent over the network again; a row of fields stays one row.
    """
    k = keys.where("ordinal IS NOT NULL").groupBy("doc_id").agg(F.collect_list(F.struct(F.col("ordinal").alias("bucket"), "group_id", "anchor_start", "anchor_end")).alias("keys"))
    both = fields.join(k, "doc_id", "left")
    if candidates is None:
        spans = F.array(F.struct("byte_start", "byte_end"))
    else:
        each = candidates.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("field_id").alias("field"), "candidate_id", "byte_start", "byte_end")).alias("referred"))
        both = both.join(each, "doc_id", "left")
        spans = F.filter("referred", lambda x: (x["field"] == F.col("field_id")) & F.array_contains("candidate_ids", x["candidate_id"]))
    # array(spans): they are found once, not for each key again
    near = F.flatten(F.transform(F.array(spans), lambda found: F.transform(F.when(F.size(found) > 0, F.col("keys")), lambda k: F.struct(_least_gap(found, k).alias("far"), k["bucket"].alias("bucket")))))
    return both.select(*fields.columns, "keys", near.alias("near"))


def _least_gap(spans: Column, key: Column) -> Column:
    return F.array_min(F.transform(spans, lambda x: gap(x["byte_start"], x["byte_end"], key["anchor_start"], key["anchor_end"])))


def _nearest() -> Column:
    """The buckets of the keys that lie nearest; null or none without any."""
    return F.flatten(F.transform(F.array(F.array_min("near")["far"]), lambda least: F.transform(F.filter("near", lambda x: x["far"] == least), lambda x: x["bucket"])))


def by_cooccurrence(fields: DataFrame, keys: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Keys whose anchors lie nearest to the spans of the candidates that a field refers to (see _around); ties decide nothing, and a field without such candidates says nothing."""
    says = lambda own: F.struct((F.size(own) == 1).alias("decisive"), F.array_min(own).alias("bucket"), F.size(own).cast("long").alias("buckets"))
    # inline, not a filter on the buckets, for which they would be found twice
    some = F.transform(F.filter(F.array(F.array_distinct(_nearest())), lambda own: F.size(own) > 0), says)
    return _around(fields, keys, candidates).select("doc_id", "field_id", "seq", F.inline(some)).select("doc_id", "field_id", "seq", "decisive", "bucket", "buckets", F.lit(AUTHORITIES[2]).alias("authority"))


def by_prior(fields: DataFrame, keys: DataFrame) -> DataFrame:
    """Keys of a plan that equal the field's own tentative key, whatever its role."""
    k = keys.select("doc_id", F.col("group_id").alias("tentative_key"), F.col("ordinal").alias("bucket"))
    return _single(fields.join(k, ["doc_id", "tentative_key"]).select("doc_id", "field_id", "seq", "bucket"), AUTHORITIES[3])


def assign(fields: DataFrame, keys: DataFrame, with_plan: bool = True, candidates: DataFrame | None = None) -> DataFrame:
    """fields with bucket and authority: of the first authority that is decisive. Where none is, ambiguous_on is the strongest beyond boundary that says anything, and target the
    least bucket that it names, or else 0: where the finding goes. Joins by document alone, see _around.
    """
    buckets = lambda found: F.transform(found, lambda k: k["bucket"])
    spans = F.filter("keys", lambda k: overlap(F.col("byte_start"), F.col("byte_end"), k["anchor_start"], k["anchor_end"]))
    same = F.filter("keys", lambda k: k["group_id"] == F.col("tentative_key"))
    by = _around(fields, keys, candidates).select(*fields.columns, buckets(spans).alias("k2"), _nearest().alias("k3"), buckets(same).alias("same"))
    own = {"k1": F.when(F.col("boundary_defining"), F.col("same")), "k2": F.col("k2"), "k3": F.col("k3"), "k4": F.when(F.lit(with_plan), F.col("same"))}
    by = by.select(*fields.columns, *(f(c).alias(f"{k}_{n}") for k, c in own.items() for n, f in (("least", F.array_min), ("most", F.array_max))))
    every = {f"k{n}": name for n, name in enumerate(AUTHORITIES, 1)}
    least = lambda k: F.col(f"{k}_least")
    one, some = (lambda k: least(k) == F.col(f"{k}_most")), (lambda k: least(k).isNotNull())
    first = lambda test, value, names: F.coalesce(*(F.when(test(k), value(k)) for k in names))
    bucket = first(one, least, every)
    partial = list(every)[1:]
    found = F.struct(
        bucket.alias("bucket"), first(one, lambda k: F.lit(every[k]), every).alias("authority"),
        F.when(bucket.isNull(), first(some, lambda k: F.lit(every[k]), partial)).alias("ambiguous_on"), F.when(bucket.isNull(), F.coalesce(first(some, least, partial), F.lit(0))).alias("target"),
    )
    # inline: a filter on the bucket, pushed down to the joins, would find all of this again
    return by.select(*fields.columns, F.inline(F.array(found)))


def cardinality_policy(assigned: DataFrame) -> DataFrame:
    """assigned(doc_id, field_id, bucket, target, cardinality, ...) with code: why a field isn't in its bucket, null if it is."""
    whole, own = Window.partitionBy("doc_id", "field_id"), Window.partitionBy("doc_id", "field_id", "bucket")
    several = F.min("bucket").over(whole) < F.max("bucket").over(whole)
    code = (
        F.when(F.col("bucket").isNull(), "ambiguous_grouping")
        .when((F.col("cardinality") == "ONE") & several, "cardinality.one_multiple_instances")
        .when((F.col("cardinality") == "PER_INSTANCE") & (F.count("*").over(own) > 1), "cardinality.per_instance_multi_in_instance")
    )
    return assigned.withColumn("code", code)


def compose(judged: DataFrame) -> DataFrame:
    """(doc_id, ordinal, fields, negatives, anchors, outcome): instances in bucket order, renumbered.

    judged has code (see cardinality_policy); ambiguous fields are negatives of their target. An instance is complete without negatives, and isn't one with neither
    fields nor negatives. anchors: the distinct spans of its fields, in their order.
    """
    by = judged.withColumn("in_bucket", F.coalesce("bucket", "target")).groupBy("doc_id", "in_bucket")
    kept = F.array_sort(F.collect_list(F.when(F.col("code").isNull(), F.struct("field_id", "seq", "value", "byte_start", "byte_end"))))
    out = by.agg(kept.alias("kept"), F.array_sort(F.collect_set(F.when(F.col("code").isNotNull(), F.concat_ws(":", "field_id", "code")))).alias("negatives"))
    fields = F.transform("kept", lambda x: F.struct(x["field_id"].alias("field_id"), x["seq"].alias("seq"), x["value"].alias("value")))
    anchors = F.array_distinct(F.transform("kept", lambda x: F.struct(x["byte_start"].alias("start"), x["byte_end"].alias("end"))))
    ordinal = F.row_number().over(Window.partitionBy("doc_id").orderBy("in_bucket")) - 1
    return out.select("doc_id", ordinal.alias("ordinal"), fields.alias("fields"), "negatives", anchors.alias("anchors"), F.when(F.size("negatives") == 0, "complete").otherwise("partial").alias("outcome"))


def clustering_signals(assigned: DataFrame) -> DataFrame:
    """(doc_id, bucket, authority, n)."""
    return assigned.where("bucket IS NOT NULL").groupBy("doc_id", "bucket", "authority").agg(F.count("*").alias("n"))


def discriminators(assigned: DataFrame) -> DataFrame:
    """(doc_id, bucket, discriminators): distinct (field, authority) in order of first appearance."""
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("seq", "field_id", "authority"))), lambda x: F.concat_ws("/", x["field_id"], x["authority"]))
    return assigned.where("bucket IS NOT NULL").groupBy("doc_id", "bucket").agg(F.array_distinct(pairs).alias("discriminators"))


def initial_keys(fields: DataFrame) -> DataFrame:
    """(doc_id, ordinal, anchors): one bucket for each document without a plan, with its distinct spans in order."""
    spans = F.transform(F.array_sort(F.collect_list(F.struct("seq", "field_id", "byte_start", "byte_end"))), lambda x: F.struct(x["byte_start"].alias("start"), x["byte_end"].alias("end")))
    return fields.groupBy("doc_id").agg(F.lit(0).alias("ordinal"), F.array_distinct(spans).alias("anchors"))


def plan_keys(anchors: DataFrame, most: int | None = None) -> DataFrame:
    """(doc_id, ordinal, group_id, anchor_start, anchor_end, violation): distinct anchors in order as keys; max_exceeded beyond most."""
    by = Window.partitionBy("doc_id", "anchor_start", "anchor_end").orderBy("seq")
    first = anchors.withColumn("k", F.row_number().over(by)).where("k = 1")
    ordinal = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq")) - 1
    group = stable_hash(json_list([F.col("anchor_start").cast("string"), F.col("anchor_end").cast("string")]))
    n = F.count("*").over(Window.partitionBy("doc_id"))
    return first.select("doc_id", ordinal.alias("ordinal"), group.alias("group_id"), "anchor_start", "anchor_end", F.when(F.lit(most is not None) & (n > F.lit(most or 0)), "max_exceeded").alias("violation"))


def plan_from_selection(chosen: DataFrame, instances: DataFrame) -> DataFrame:
    """(doc_id, ordinal, instance, ...): proposed instances in selection order. chosen(doc_id, instances: array)."""
    each = chosen.select("doc_id", F.posexplode("instances").alias("ordinal", "instance"))
    return each.join(instances, ["doc_id", "instance"])


def advisory_anchors(observations: DataFrame, candidates: DataFrame) -> DataFrame:
    """(doc_id, field_id, position, byte_start, byte_end): spans of selected and ambiguous ids, in order."""
    ids = observations.where("outcome IN ('SELECTED', 'AMBIGUOUS')").select("doc_id", "field_id", F.posexplode("selected_candidate_ids").alias("position", "candidate_id"))
    return ids.join(candidates.select("doc_id", "field_id", "candidate_id", "byte_start", "byte_end"), ["doc_id", "field_id", "candidate_id"]).drop("candidate_id")


def boundary_order(fields: DataFrame) -> DataFrame:
    """Boundary-defining fields by priority, highest first, then declaration."""
    return fields.where("boundary_defining").withColumn("place", F.row_number().over(Window.partitionBy("spec_id").orderBy(F.desc("priority"), "ordinal")) - 1)


def attach_negatives(instances: DataFrame, negatives: DataFrame) -> DataFrame:
    """Negatives from before resolution go to the document's only instance and make it partial; documents with several fail."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    extra = negatives.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.concat_ws(":", "field_id", "code"))).alias("extra"))
    both = instances.withColumn("n", n).join(extra, "doc_id", "left")
    some = F.col("extra").isNotNull()
    many = some & (F.col("n") != 1)
    out = F.when(many, F.lit("error")).when(some, "partial").otherwise(F.col("outcome"))
    return both.select("doc_id", "ordinal", out.alias("outcome"), F.when(some & ~many, F.concat("negatives", "extra")).otherwise(F.col("negatives")).alias("negatives"))


def roll_up(docs: DataFrame, instances: DataFrame) -> DataFrame:
    """(doc_id, outcome, instances): failed without instances, partial if any is, else complete."""
    by = instances.groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_and(F.col("outcome") == "complete").alias("whole"))
    return docs.select("doc_id").join(by, "doc_id", "left").select("doc_id", F.when(F.col("n").isNull(), "failed").when(F.col("whole"), "complete").otherwise("partial").alias("outcome"), F.coalesce("n", F.lit(0)).alias("instances"))


def materialize(evidence: DataFrame, fields: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, ordinal, one column for each field, missing): evidence(doc_id, ordinal, field_id, seq, value) as objects.

    fields: (name, ONE | OPTIONAL | MANY); a ONE without value is missing.
    """
    cell = {}
    for name, kind in fields:
        own = F.col("field_id") == name
        if kind == "MANY":
            cell[name] = F.transform(F.array_sort(F.collect_list(F.when(own, F.struct("seq", "value")))), lambda x: x["value"])
        else:
            cell[name] = F.max_by(F.when(own, F.col("value")), F.when(own, F.col("seq")))
    out = evidence.groupBy("doc_id", "ordinal").agg(*(c.alias(k) for k, c in cell.items()))
    missing = F.filter(F.array(*(F.when(F.col(n).isNull(), F.lit(n)) for n, k in fields if k == "ONE")) if any(k == "ONE" for _, k in fields) else F.array().cast("array<string>"), lambda x: x.isNotNull())
    return out.withColumn("missing", missing)


def extract_one(instances: DataFrame) -> DataFrame:
    """(doc_id, ok): complete with exactly one instance."""
    return instances.groupBy("doc_id").agg(((F.count("*") == 1) & F.bool_and(F.col("outcome") == "complete")).alias("ok"))


def group_id(anchors: list[Column], material: str) -> Column:
    """The hash of a group's anchors and material, as a column."""
    return stable_hash(json_list([json_list(anchors), json_string(F.lit(material))]))


def flat_evidence(instances: DataFrame) -> DataFrame:
    """(doc_id, position, ordinal, field_id, seq, value): the fields of all instances of a document, in order."""
    return _flat(instances, "fields").select("doc_id", "position", "ordinal", "x.*")


def flat_negatives(instances: DataFrame) -> DataFrame:
    """(doc_id, position, ordinal, negative): the negatives of all instances of a document, in order."""
    return _flat(instances, "negatives").select("doc_id", "position", "ordinal", F.col("x").alias("negative"))


def _flat(instances: DataFrame, column: str) -> DataFrame:
    each = instances.select("doc_id", "ordinal", F.posexplode(column).alias("k", "x"))
    return each.withColumn("position", F.row_number().over(Window.partitionBy("doc_id").orderBy("ordinal", "k")) - 1)


def stream(instances: DataFrame) -> Iterator[Row]:
    """The instances one after another, in order, when all are resolved; the driver holds a partition of them at a time."""
    return instances.orderBy("doc_id", "ordinal").toLocalIterator()
