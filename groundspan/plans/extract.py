"""Extraction of a corpus as one lazy plan: candidates, filter, selection, cardinality, validation, roll-up."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import byte_to_char, raw
from ..operators import candidates, filters, instances, selection, validation
from .spec import FieldSpec, Spec

CANDIDATE = ["doc_id", "field_id", "seq", "candidate_id", "text", "byte_start", "byte_end", "entity_type", "normalized_hint"]


PROPOSED = ["doc_id", "field_id", "position", "candidate_id", "raw_value", "byte_start", "byte_end"]


@dataclass
class Extraction:
    """Relations of a run; evidence(doc_id, field_id, position, candidate_id, raw_value, byte_start, byte_end, normalized_value)."""

    candidates: DataFrame
    observations: DataFrame
    evidence: DataFrame
    negatives: DataFrame
    outcomes: DataFrame


def field_candidates(docs: DataFrame, spec: FieldSpec) -> DataFrame:
    sets = []
    for k, s in enumerate(spec.meta.strategies):
        found = candidates.regex_native(docs, s.pattern, s.entity_type) if s.native else candidates.regex_general(docs, s.params())
        found = found.withColumns({"field_id": F.lit(spec.field_id), "normalized_hint": F.lit(None).cast("string"), "source_id": F.lit(f"{k}")})
        sets.append(candidates.with_ids(found, f"regex:{s.pattern}"))
    out = sets[0] if len(sets) == 1 else candidates.merge(sets)
    if spec.meta.keep is not None:
        out = filters.apply(out, spec.meta.keep)
    return out.select(*CANDIDATE)


def _chosen(found: DataFrame, names: DataFrame) -> DataFrame:
    """What the singleton rule proposes, as validation.proposed would say from the observations: all candidates of sets that take many, else the only one; patterns run over the texts once."""
    own = found.groupBy("doc_id", "field_id").agg(F.array_sort(F.collect_list(F.struct("seq", "candidate_id", F.col("text").alias("raw_value"), "byte_start", "byte_end"))).alias("all"))
    taken = own.join(F.broadcast(names.select("field_id", "cardinality")), "field_id").where((F.col("cardinality") == "MANY") | (F.size("all") == 1))
    return taken.select("doc_id", "field_id", F.posexplode("all").alias("position", "c")).select("doc_id", "field_id", "position", "c.*").select(*PROPOSED)


def extract(docs: DataFrame, spec: Spec) -> Extraction:
    """docs(doc_id, text), doc_id unique. Fields with literals are decided by their rules, others by the singleton rule."""
    texts = [f for f in spec.fields if not f.literals]
    found = reduce(DataFrame.unionByName, [field_candidates(docs, f) for f in texts]) if texts else None
    spark = docs.sparkSession
    names = spark.createDataFrame([(f.field_id, f.cardinality, f.value_type, f.ordinal) for f in spec.fields], "field_id string, cardinality string, kind string, ordinal int")
    parts, proposed = [], []
    if texts:
        asked = docs.select("doc_id", F.explode(F.array(*(F.lit(f.field_id) for f in texts))).alias("field_id"))
        chosen = selection.singleton(asked, found).join(F.broadcast(names.select("field_id", "cardinality")), "field_id")
        many = (F.col("cardinality") == "MANY") & (F.col("outcome") == "AMBIGUOUS")
        parts.append(chosen.withColumns({"outcome": F.when(many, "SELECTED").otherwise(F.col("outcome")), "reason": F.when(~many, F.col("reason"))}).drop("cardinality"))
        proposed.append(_chosen(found, names))
    for f in spec.fields:
        if f.literals:
            arms = candidates.literal_set(docs, list(f.literals)).withColumns({"field_id": F.lit(f.field_id), "entity_type": F.lit("CATEGORY"), "normalized_hint": F.col("text")})
            strategy = f"literal_set:{','.join(f.literals)}"
            arms = candidates.with_ids(arms, strategy, "text").select(*CANDIDATE)
            found = arms if found is None else found.unionByName(arms)
            if len(f.literals) == 1:
                says = docs.select("doc_id", F.lit("SELECTED").alias("outcome"), F.array(F.lit(f.literals[0])).alias("literals"), F.lit(None).cast("string").alias("reason"))
            else:
                says = selection.category(docs, list(f.literals), [(r.literal, r.pattern, r.polarity) for r in f.meta.rules], f.cardinality == "MANY")
            ids = arms.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("text", "candidate_id"))).alias("ids"))
            picked = says.join(ids, "doc_id").withColumn("selected_candidate_ids", F.transform("literals", lambda x: F.col("ids")[x]))
            parts.append(picked.select("doc_id", F.lit(f.field_id).alias("field_id"), "outcome", "selected_candidate_ids", "reason"))
            taken = says.where("outcome = 'SELECTED'").select("doc_id", F.lit(f.field_id).alias("field_id"), F.posexplode("literals").alias("position", "raw_value"), F.lit(0).alias("byte_start"), F.lit(0).alias("byte_end"))
            proposed.append(candidates.with_ids(taken, strategy, "raw_value").select(*PROPOSED))
    observations = reduce(DataFrame.unionByName, parts)
    checked = validation.layer2(reduce(DataFrame.unionByName, proposed).join(F.broadcast(names.select("field_id", "kind")), "field_id"))
    evidence = checked.where("code IS NULL").drop("code", "kind")
    negatives = validation.cardinality_negatives(observations, names).unionByName(validation.failures(checked))
    if spec.rules:
        issues = validation.cross_field(evidence.withColumn("seq", F.col("position")), spec.rules).where("severity = 'error'")
        crossed = issues.select("doc_id", F.lit(None).cast("string").alias("field_id"), F.lit("validation").alias("category"), F.lit("instance_failure").alias("code"), F.col("rule").alias("reason"), F.lit(None).cast("int").alias("candidate_count"))
        negatives = negatives.unionByName(crossed)
    absent = F.concat_ws("/", "category", "code")
    optional = [f.field_id for f in spec.fields if f.cardinality in ("OPTIONAL", "MANY")]
    blocking = negatives.where(~(F.coalesce(F.col("field_id").isin(*optional), F.lit(False)) & absent.isin("selection/no_candidates", "selection/abstained")) if optional else F.lit(True))
    some = evidence.select("doc_id").distinct()
    whole = some.join(blocking.select("doc_id").distinct().withColumn("bad", F.lit(True)), "doc_id", "left")
    outcomes = instances.roll_up(docs, whole.select("doc_id", F.when(F.col("bad"), "partial").otherwise("complete").alias("outcome")))
    return Extraction(found, observations, evidence, negatives, outcomes)


def extract_instances(docs: DataFrame, spec: Spec, keys: DataFrame) -> Extraction:
    """extract for each instance of a document: keys(doc_id, ordinal, anchor_start, anchor_end), as a plan or a proposer gives them, say where they are.

    A field belongs to the instance whose anchor covers it; selection, rules and validation see that instance's text alone. All relations have ordinal next to doc_id, spans are those of the
    document; outcomes has one row for each document: failed without instances, complete if all are. Within the run an instance goes by a 64-bit hash of its document and ordinal.
    """
    of = keys.select("doc_id", "ordinal", "anchor_start", "anchor_end").withColumn("instance", F.xxhash64("doc_id", "ordinal"))
    # keys come as one row for each document: its text is sent and made bytes once, not for each of its instances
    places = of.groupBy("doc_id").agg(F.collect_list(F.struct("instance", "anchor_start", "anchor_end")).alias("places"))
    whole = docs.select("doc_id", raw(F.col("text")).alias("bytes")).join(places, "doc_id").select("bytes", F.explode("places").alias("p"))
    each = whole.select(F.col("p.instance").alias("doc_id"), F.decode(F.substring("bytes", F.col("p.anchor_start").cast("int") + 1, (F.col("p.anchor_end") - F.col("p.anchor_start")).cast("int")), "UTF-8").alias("text"))
    run = extract(each, spec)
    back = of.select("instance", F.col("doc_id").alias("own_id"), "ordinal", "anchor_start")

    def apart(df: DataFrame) -> DataFrame:
        both = df.join(back, F.col("doc_id") == F.col("instance"))
        placed = {c: F.col(c) + F.col("anchor_start") for c in ("byte_start", "byte_end") if c in df.columns}
        return both.withColumns(placed | {"doc_id": F.col("own_id")}).select("doc_id", "ordinal", *(c for c in df.columns if c != "doc_id"))

    judged = apart(run.outcomes).select("doc_id", F.when(F.col("outcome") == "complete", "complete").otherwise("partial").alias("outcome"))
    return Extraction(*(apart(x) for x in (run.candidates, run.observations, run.evidence, run.negatives)), instances.roll_up(docs, judged))


def objects(extraction: Extraction, spec: Spec) -> DataFrame:
    """One row for each document, or each of its instances, with evidence, one column for each field, and what is missing."""
    several = "ordinal" in extraction.evidence.columns
    cells = extraction.evidence.select("doc_id", (F.col("ordinal") if several else F.lit(0)).alias("ordinal"), "field_id", F.col("position").alias("seq"), F.col("normalized_value").alias("value"))
    out = instances.materialize(cells, [(f.field_id, f.cardinality) for f in spec.fields])
    return out if several else out.drop("ordinal")


def with_characters(evidence: DataFrame, docs: DataFrame) -> DataFrame:
    """evidence with spans in code points too."""
    both = evidence.join(docs.select("doc_id", "text"), "doc_id")
    return both.withColumns({"char_start": byte_to_char(F.col("text"), F.col("byte_start")), "char_end": byte_to_char(F.col("text"), F.col("byte_end"))}).drop("text")
