"""Extraction from a stream of documents: each micro-batch goes through the same plan and is appended; and rolling counts of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.extract import extract, field_candidates
from ..plans.spec import Spec


def candidate_stream(docs: DataFrame, spec: Spec) -> DataFrame:
    """Candidates of all text fields of a streaming DataFrame of documents; stateless."""
    out = None
    for f in spec.fields:
        if not f.literals and f.meta.keep is None and len(f.meta.strategies) == 1:
            one = field_candidates(docs, f)
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no field of one strategy without a filter")
    return out


def write_extractions(docs: DataFrame, spec: Spec, path: str, checkpoint: str) -> StreamingQuery:
    """Appends evidence and negatives of each micro-batch; a batch that is repeated after a failure replaces its own part."""

    def put(batch: DataFrame, number: int) -> None:
        found = extract(batch, spec)
        for name, rows in (("evidence", found.evidence), ("negatives", found.negatives)):
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")

    return docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """(window, event_type, n, total) of events(ts, event_type, value), what comes too late left out."""
    by = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("total"))
