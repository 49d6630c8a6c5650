"""Helpers shared by the corpus operators.

Texts reach Python as Arrow buffers and are handled as one flat byte array with
offsets, so that no Python string is made per row unless an operator needs one.
"""

from __future__ import annotations

import ctypes
import gc
import time
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that one numpy step works on; a longer text is one step of its own.
STEP_BYTES = 1 << 20

_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where none is set, a temporary one if all runs on this machine, as in tests; else an error."""
    sc = spark.sparkContext
    if (here := sc._jsc.sc().getCheckpointDir()).isDefined():
        return here.get()
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("spark.checkpoint.dir isn't set: it must name a folder that all executors share")
        import tempfile

        base = "file://" + tempfile.mkdtemp(prefix="groundspan-")
    sc.setCheckpointDir(base)
    return sc._jsc.sc().getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Cuts the lineage: writes df to the shared folder and reads it again; also the path, for who deletes it."""
    spark = df.sparkSession
    df.write.parquet(path := new_path(spark, name))
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, name: str) -> DataFrame:
    """stored, for a table that a result is read from, which stays."""
    return stored(df, name)[0]


def collect_garbage(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that are over: it does when the driver drops their plans."""
    for _ in range(2):  # the first drops what Python held, the second what that held
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)


def filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """For Python's own files in the shared folder."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pyarrow.fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def byte_table(of: bytes | str, inside: bool = True) -> np.ndarray:
    table = np.full(256, not inside)
    table[np.frombuffer(of if isinstance(of, bytes) else of.encode("latin-1"), np.uint8)] = inside
    return table


#: True for bytes that separate words: ASCII white space.
SPACE = byte_table(b" \t\n\r\f\v")
#: True for bytes of words in the stricter sense: ASCII letters, digits and all of UTF-8 beyond ASCII.
ALNUM = byte_table(bytes(b for b in range(256) if b >= 128 or chr(b).isalnum()))

_rng = np.random.default_rng(20240229)
_RANDOM = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_FOLDED = _RANDOM.copy()
_FOLDED[ord("A") : ord("Z") + 1] = _RANDOM[ord("a") : ord("z") + 1]


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and n + 1 offsets; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(offsets) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(batch: pa.RecordBatch, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batch with about STEP_BYTES of text each."""
    _, offsets = text_bytes(batch.column(column))
    at = 0
    while at < len(batch):
        to = int(np.searchsorted(offsets, offsets[at] + STEP_BYTES, "right")) - 1
        to = min(max(to, at + 1), len(batch))
        yield batch.slice(at, to - at)
        at = to


def spans(word: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True in word that don't cross an offset: starts, ends, number of the text."""
    if not len(word):
        return (np.zeros(0, np.int64),) * 3
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    cut = offsets[(offsets > 0) & (offsets < len(word))]
    first[cut] = word[cut]
    last[cut - 1] = word[cut - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def powers(n: int, base: int = _PRIME) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    if base not in _powers or len(_powers[base]) < n:
        out = np.full(max(n, STEP_BYTES + 1024), base, np.uint64)
        out[0] = 1
        _powers[base] = np.multiply.accumulate(out)
    return _powers[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, from one pass of prefix sums; fold: ASCII case doesn't matter."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _RANDOM)[data] * powers(len(data)), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * powers(len(data) + 1, _INVERSE)[starts] + (ends - starts).astype(np.uint64))


def chars_before(data: np.ndarray) -> np.ndarray:
    """n + 1 counts of the code points that begin before each byte."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def release() -> None:
    """Gives memory that a worker no longer uses back to the system, as workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # not this C library


def in_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: T.StructType | str) -> DataFrame:
    """mapInArrow, step by step (see steps)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                out = function(part)
                if out is not None and len(out):
                    yield out
            release()

    return df.mapInArrow(run, schema)


def plain(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and text alone, so that other columns, whatever their names, play no part."""
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_batches(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], new: T.StructType) -> DataFrame:
    """mapInArrow for a function that adds columns to what it gets; columns may have any names, as mapInArrow alone can't tell one with a dot."""
    names = df.columns
    safe = [c if c.isidentifier() else f"column {k}" for k, c in enumerate(names)]
    schema = T.StructType([T.StructField(c, f.dataType) for c, f in zip(safe, df.schema.fields)] + new.fields)
    return df.toDF(*safe).mapInArrow(function, schema).toDF(*names, *new.names)
