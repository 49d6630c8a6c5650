"""A content-addressed store of runs as Parquet tables, and JSON lines in and out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import json_string, safe_segment, stable_hash

REPLAY_VERSIONS = ("v1", "v2", "v3")


class Collision(ValueError):
    """The same id with other content."""


class Store:
    """Objects (id, kind, body) and manifests (run_id, ...) under one root."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        path = f"{self.root}/{name}"
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        there = where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        return self.spark.read.schema(schema).parquet(path) if there else self.spark.createDataFrame([], schema)

    def objects(self) -> DataFrame:
        return self._read("objects", "id string, kind string, body string")

    def manifests(self) -> DataFrame:
        return self._read("manifests", "run_id string, document_id string, outcome string, fingerprint string")

    def put(self, objects: DataFrame) -> int:
        """Inserts objects(id, kind, body) that aren't there; how many. The same body again changes nothing, another one is a collision."""
        fresh = objects.select("id", "kind", "body").distinct()
        old = self.objects().select("id", F.col("body").alias("old"))
        if fresh.groupBy("id").count().where("count > 1").limit(1).count() or fresh.join(old, "id").where("NOT body <=> old").limit(1).count():
            raise Collision("storage.collision")
        before = old.count()
        fresh.join(old, "id", "left_anti").write.mode("append").parquet(f"{self.root}/objects")
        return self.objects().count() - before

    def put_manifests(self, manifests: DataFrame) -> None:
        manifests.select("run_id", "document_id", "outcome", "fingerprint").write.mode("append").parquet(f"{self.root}/manifests")

    def run_ids(self) -> list[str]:
        """Sorted; of manifests alone, which stay small beside the data."""
        return [r.run_id for r in self.manifests().select("run_id").distinct().orderBy("run_id").toLocalIterator()]


def replay_rows(extractions: DataFrame, version: str = "v3") -> DataFrame:
    """(id, kind, body) of extractions(document_id, outcome, ...): bodies are JSON, ids their hashes."""
    if version not in REPLAY_VERSIONS:
        raise ValueError(f"no such version: {version}")
    body = F.to_json(F.struct(F.lit(version).alias("schema_version"), *(F.col(c) for c in sorted(extractions.columns))), {"ignoreNullFields": "false"})
    rows = extractions.select(body.alias("body"))
    return rows.select(F.sha2(F.encode("body", "UTF-8"), 256).alias("id"), F.lit("replay").alias("kind"), "body")


def read_replays(objects: DataFrame, schema: str) -> DataFrame:
    """The extractions of replay objects; error is malformed or incompatible where they can't be read."""
    parsed = objects.where("kind = 'replay'").select("id", "body", F.from_json("body", f"schema_version string, {schema}").alias("x"))
    bad = F.when(F.try_parse_json("body").isNull(), "malformed").when(~F.coalesce(F.col("x.schema_version").isin(*REPLAY_VERSIONS), F.lit(False)), "incompatible")
    return parsed.select("id", "x.*", bad.alias("error"))


def version_drift(captured: DataFrame, live: DataFrame) -> DataFrame:
    """(producer, captured, live) of producers whose version isn't what it was."""
    return captured.withColumnRenamed("version", "captured").join(live.withColumnRenamed("version", "live"), "producer", "left").where("NOT captured <=> live")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table and not of the other, with side; repeated rows count."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def run_fingerprint(parts: dict[str, str]) -> str:
    """Of source, specification, producers, policy and strategy, as canonical JSON."""
    from hashlib import sha256

    return sha256(json.dumps(parts, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def record_prompts(prompts: DataFrame) -> DataFrame:
    """(hash, prompt): each prompt once."""
    return prompts.select(stable_hash(json_string(F.col("prompt"))).alias("hash"), "prompt").distinct()


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines with line numbers' text in _corrupt_record where they don't parse; blank lines are skipped."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    return lines.select(F.from_json("value", f"{schema}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("x")).select("x.*")


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.text(path)


def fixture_pack(spark: SparkSession, lines: str, documents: str) -> DataFrame:
    """Gold cases of a JSON-lines file with their documents' texts; duplicate cases and paths that leave the folder fail."""
    cases = read_json_lines(spark, lines, "case_id string, document_path string, schema_id string, expected_instances array<struct<fields:array<struct<field_id:string,expected_value:string,expected_absent:boolean>>>>")
    guard = F.when(F.col("_corrupt_record").isNotNull(), F.raise_error(F.concat(F.lit("bad line: "), "_corrupt_record"))).when(
        F.col("document_path").rlike(r"(^/)|(^|/)\.\.(/|$)"), F.raise_error(F.concat(F.lit("path leaves the folder: "), "document_path"))
    )
    cases = cases.where(guard.isNull()).drop("_corrupt_record")
    if cases.groupBy("case_id").count().where("count > 1").limit(1).count():
        raise ValueError("duplicate case_id")
    texts = spark.read.text(documents, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("document_path"), F.col("value").alias("text"))
    return cases.join(texts, "document_path")


def batch_lines(requests: DataFrame, model: str) -> DataFrame:
    """(value): requests(request_id, prompt) as a batch provider's JSON lines."""
    body = F.struct(F.lit(model).alias("model"), F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))).alias("messages"))
    return requests.select(F.to_json(F.struct(F.col("request_id").alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body"))).alias("value"))


def parse_batch(lines: DataFrame) -> DataFrame:
    """(request_id, status, payload) of a batch provider's result lines(value)."""
    x = F.from_json("value", "custom_id string, response struct<status_code:int,body:struct<choices:array<struct<message:struct<content:string>>>>>, error struct<message:string>")
    rows = lines.where("trim(value) <> ''").select(x.alias("x"))
    ok = (F.col("x.response.status_code") == 200) & F.col("x.error").isNull()
    return rows.select(F.col("x.custom_id").alias("request_id"), F.when(ok, "ok").otherwise("failed").alias("status"), F.when(ok, F.get(F.col("x.response.body.choices"), F.lit(0))["message"]["content"]).otherwise(F.col("x.error.message")).alias("payload"))


def object_path(root: str, kind: str, name):
    """A path of safe segments, as a column."""
    return F.concat_ws("/", F.lit(root), safe_segment(F.lit(kind)), safe_segment(name))


def smoke_cases(spark: SparkSession, path: str, schemas: set[str]) -> DataFrame:
    """(case_id, schema_id, document_path, expected_instances) of a manifest {"cases": [...]}: case_ids are unique, schemas registered, and documents lie under the manifest's folder."""
    cases = spark.read.json(path, multiLine=True).select(F.explode("cases").alias("c")).select("c.*")
    n = F.count("*").over(Window.partitionBy("case_id"))
    escapes = F.col("document_path").startswith("/") | F.exists(F.split("document_path", "[/\\\\]"), lambda x: x == "..")
    wrong = F.when(n > 1, "duplicate_case_id").when(~F.col("schema_id").isin(*schemas), "missing_schema").when(F.coalesce(escapes, F.lit(True)), "path_escape")
    if bad := cases.withColumn("wrong", wrong).where("wrong IS NOT NULL").select("case_id", "wrong").limit(5).collect():
        raise ValueError(f"smoke_dataset: {[tuple(r) for r in bad]}")
    return cases
