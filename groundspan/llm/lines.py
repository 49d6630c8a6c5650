"""5. Line deduplication by sharded minimal perfect hashes.

A line that occurs more than MAX_COUNT times in the corpus stays only where it occurs first. Documents are
written in buckets, which they don't leave; what travels is each bucket's distinct lines, as two hashes, a count and the first place.
They are spread over shards by hash, so that a frequent line is one entry for each bucket, however often it occurs. Each
shard builds a minimal perfect hash over all its distinct line hashes: bit arrays, level by level, for the keys
that collided with none, and ranks in them. The rank indexes flat arrays with the other hash as fingerprint, the
count and the first occurrence. The buckets' lines probe the arrays, and those that occur too often go back to their bucket,
where the documents' lines are looked up among them; no line is ever joined, and no worker holds more than a shard or a bucket's answers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import filesystem, mix, new_path, release, stored, unused

#: A line may occur so often; shorter lines (in characters, without white space at either end) always stay. Both are arguments too.
MAX_COUNT, MIN_CHARS = 6, 20
#: Bytes of text whose lines a shard is meant to have; distinct lines that a task gathers of a bucket before it sends them.
SHARD_BYTES, GATHER = 64 << 20, 1 << 20
#: Bits of a level's array for each of its keys.
GAMMA = 2.0
#: White space that doesn't count at either end of a line.
BLANK = " \t\r\f\x0b"

LINES = "shard int, bucket int, keys binary, prints binary, counts binary, owners binary, places binary"
OFTEN = "bucket int, keys binary, prints binary, owners binary, places binary"
_KINDS = {"keys": np.uint64, "prints": np.uint32, "counts": np.int64, "owners": np.int64, "places": np.int32}


def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(size)).astype(np.int64)


def build(keys: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """A minimal perfect hash over distinct keys: level sizes, all levels' bits, and the number of set bits before each byte."""
    sizes, levels = [], []
    while len(keys):
        size = max(8, int(len(keys) * GAMMA))
        slot = _slot(keys, len(sizes), size)
        alone = np.bincount(slot, minlength=size) == 1
        sizes.append(size)
        levels.append(alone)
        keys = keys[~alone[slot]]
    bits = np.packbits(np.concatenate(levels) if levels else np.zeros(0, bool))
    set_before = np.cumsum(np.bitwise_count(bits), dtype=np.int64)
    return sizes, bits, (set_before - np.bitwise_count(bits)).astype(np.uint32)


def index_of(keys: np.ndarray, sizes: list[int], bits: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The place of each key; -1, or some other key's place, for a key that isn't among them."""
    out, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        at = _slot(keys[left], level, size) + base
        byte, bit = bits[at >> 3], (7 - (at & 7)).astype(np.uint8)
        there = (byte >> bit) & 1 == 1
        found = at[there]
        out[left[there]] = ranks[found >> 3] + np.bitwise_count(byte[there] >> (bit[there] + np.uint8(1)).astype(np.uint16))
        left, base = left[~there], base + size
    return out


class Shard:
    """The perfect hash of a shard's distinct lines, and its arrays."""

    def __init__(self, keys: np.ndarray, prints: np.ndarray, counts: np.ndarray, owners: np.ndarray, places: np.ndarray):
        """The lines' occurrences, added up by bucket or not. Of two lines with one key the one with the least fingerprint is in."""
        order = np.lexsort((places, owners, prints, keys))
        keys, prints, counts, owners, places = (x[order] for x in (keys, prints, counts, owners, places))
        first = np.flatnonzero(np.append(True, (np.diff(keys) != 0) | (np.diff(prints) != 0))[: len(keys)])
        total = np.add.reduceat(counts, first) if len(first) else counts[:0]
        own = np.append(True, np.diff(keys[first]) != 0)[: len(first)]
        first, total = first[own], total[own]
        self.hash = build(keys[first])
        at = np.empty(len(first), np.int64)
        at[index_of(keys[first], *self.hash)] = np.arange(len(first))
        self.prints, self.counts, self.owners, self.places = prints[first][at], np.minimum(total, 2**32 - 1).astype(np.uint32)[at], owners[first][at], places[first][at]

    def often(self, keys: np.ndarray, prints: np.ndarray, max_count: int) -> tuple[np.ndarray, np.ndarray]:
        """Which lines occur more than max_count times, and their places in the arrays."""
        place = index_of(keys, *self.hash)
        at = np.flatnonzero(place >= 0)
        at = at[(self.prints[place[at]] == prints[at]) & (self.counts[place[at]] > max_count)]
        return at, place[at]


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys >> np.uint64(33)).astype(np.int64) % shards


def _flat(doc_id: pa.Array, keys: pa.Array, prints: pa.Array) -> tuple[np.ndarray, ...]:
    """Of the lines that count: which line of all it is, key, fingerprint, doc_id, place; and the number of lines of each document."""
    sizes = pc.fill_null(pc.list_value_length(keys), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat, other = keys.flatten(), prints.flatten()
    line = np.flatnonzero(flat.is_valid().to_numpy(zero_copy_only=False))
    owner = np.repeat(doc_id.fill_null(0).to_numpy(zero_copy_only=False), sizes)[line]
    place = line - np.repeat(np.cumsum(sizes) - sizes, sizes)[line]
    return line, flat.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)[line], other.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint32)[line], owner, place.astype(np.int32), sizes


def _distinct(rows: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Lines (key, print, count, owner, place) added up."""
    keys, prints, counts, owners, places = (np.concatenate(x) for x in zip(*rows))
    order = np.lexsort((places, owners, prints, keys))
    keys, prints, counts, owners, places = (x[order] for x in (keys, prints, counts, owners, places))
    first = np.flatnonzero(np.append(True, (np.diff(keys) != 0) | (np.diff(prints) != 0))[: len(keys)])
    return keys[first], prints[first], np.add.reduceat(counts, first) if len(first) else counts, owners[first], places[first]


def _line_rows(shards: int):
    """Each bucket's distinct lines, by shard."""

    def send(bucket: int, rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch | None:
        columns = _distinct(rows)
        shard = shard_of(columns[0], shards)
        order = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[order], np.arange(shards + 1))
        own = [(k, order[cuts[k] : cuts[k + 1]]) for k in range(shards) if cuts[k + 1] > cuts[k]]
        if not own:
            return None
        arrays = [pa.array([c[at].astype(t).tobytes() for _, at in own], pa.binary()) for c, t in zip(columns, _KINDS.values())]
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.int32()), pa.array([bucket] * len(own), pa.int32()), *arrays], ["shard", "bucket", *_KINDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows, size = None, [], 0
        for batch in batches:
            of = batch.column(0).to_numpy()
            for a, b in zip(edges := np.append(0, np.flatnonzero(np.diff(of)) + 1), np.append(edges[1:], len(of))):
                if len(of) and rows and (of[a] != bucket or size > GATHER):
                    yield from filter(None, [send(bucket, rows)])
                    rows, size = [], 0
                if b > a:
                    bucket = int(of[a])
                    _, key, fingerprint, owner, place, _ = _flat(*(batch.column(k).slice(a, b - a) for k in (1, 2, 3)))
                    rows.append(_distinct([(key, fingerprint, np.ones(len(key), np.int64), owner, place)]))
                    size += len(rows[-1][0])
        if rows:
            yield from filter(None, [send(bucket, rows)])
        release()

    return run


def _search_shard(max_count: int):
    def run(table: pa.Table) -> pa.Table:
        blocks = [tuple(np.frombuffer(x, t) for x, t in zip(row, _KINDS.values())) for row in zip(*(table.column(c).to_pylist() for c in _KINDS))]
        shard = Shard(*(np.concatenate(x) for x in zip(*blocks)))
        out = []
        for bucket, (keys, prints, *_) in zip(table.column("bucket").to_pylist(), blocks):
            at, place = shard.often(keys, prints, max_count)
            if len(at):
                out.append((bucket, keys[at].tobytes(), prints[at].tobytes(), shard.owners[place].tobytes(), shard.places[place].tobytes()))
        release()
        columns = list(zip(*out)) or [()] * 5
        return pa.table({"bucket": pa.array(columns[0], pa.int32())} | {c: pa.array(x, pa.binary()) for c, x in zip(("keys", "prints", "owners", "places"), columns[1:])})

    return run


class Often:
    """A bucket's lines that occur too often, in the order of their keys."""

    def __init__(self, folder: str, bucket: int):
        fs, path = filesystem(f"{folder}/bucket={bucket}")
        info = fs.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True))
        rows = [row for f in info if f.base_name.endswith(".parquet") for row in pq.read_table(f.path, filesystem=fs, partitioning=None).to_pylist()]
        columns = [np.concatenate([np.frombuffer(r[c], _KINDS[c]) for r in rows] or [np.zeros(0, _KINDS[c])]) for c in ("keys", "prints", "owners", "places")]
        _, first = np.unique(columns[0], return_index=True)  # a bucket's tasks may send a line each; the answers are alike
        self.keys, self.prints, self.owners, self.places = (c[first] for c in columns)

    def gone(self, keys: np.ndarray, prints: np.ndarray, owners: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Which lines occur too often and, at this place of this document, not for the first time."""
        if not len(self.keys):
            return np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return (self.keys[at] == keys) & (self.prints[at] == prints) & ((self.owners[at] != owners) | (self.places[at] != places))


def _probe(folder: str):
    held: dict[int, Often] = {}

    def probe(bucket: pa.Array, doc_id: pa.Array, keys: pa.Array, prints: pa.Array) -> pa.Array:
        line, key, fingerprint, owner, place, sizes = _flat(doc_id, keys, prints)
        of = np.repeat(bucket.to_numpy(zero_copy_only=False), sizes)[line]
        gone = np.zeros(int(sizes.sum()), bool)
        for k in np.unique(of).tolist():
            if k not in held:
                held.clear()
                held[k] = Often(folder, k)
            own = of == k
            gone[line[own]] = held[k].gone(key[own], fingerprint[own], owner[own], place[own])
        some = np.zeros(len(sizes), bool)
        some[np.repeat(np.arange(len(sizes)), sizes)[gone]] = True
        some &= doc_id.is_valid().to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(gone), mask=pa.array(~some))

    def typed(bucket: pa.Array, doc_id: pa.Array, keys: pa.Array, prints: pa.Array) -> pa.Array:
        return probe(bucket, doc_id, keys, prints)

    return F.arrow_udf(typed, "array<boolean>")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def _hashes(min_chars: int) -> list[Column]:
    """Two hashes of each line of text, both null for those that are too short to count."""
    bare = F.transform(_lines(F.col("text")), lambda x: F.when(F.length(_bare(x)) >= min_chars, _bare(x)))
    return [F.transform(bare, lambda x: F.when(x.isNotNull(), F.xxhash64(x))), F.transform(bare, lambda x: F.when(x.isNotNull(), F.hash(x)))]


def _kept(docs: DataFrame, max_count: int, min_chars: int) -> tuple[DataFrame, dict[str, str]]:
    """docs with further columns, whose names are returned: text without the lines to remove, as it is byte by byte if it loses none; n: its lines; removed: of these."""
    spark = docs.sparkSession
    name = {x: unused(docs, f"__{x}") for x in ("bucket", "keys", "prints", "gone", "n", "removed", "text")}
    rows, _ = stored(docs.withColumn(name["bucket"], F.spark_partition_id()), "lines-documents")
    shards = max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES))
    keys, prints = _hashes(min_chars)
    doc_id = F.col("doc_id").cast("long")
    own = rows.where("doc_id IS NOT NULL AND text IS NOT NULL").select(name["bucket"], doc_id.alias("doc_id"), keys.alias(name["keys"]), prints.alias(name["prints"]))
    often = own.mapInArrow(_line_rows(shards), LINES).groupBy("shard").applyInArrow(_search_shard(max_count), OFTEN)
    often.repartition("bucket").write.partitionBy("bucket").parquet(folder := new_path(spark, "frequent-lines"))
    hashed = rows.withColumns({name["keys"]: keys, name["prints"]: prints})
    flagged = hashed.withColumn(name["gone"], _probe(folder)(F.col(name["bucket"]), doc_id, F.col(name["keys"]), F.col(name["prints"])))
    gone, lines = F.col(name["gone"]), _lines(F.col("text"))
    left = F.array_join(F.filter(lines, lambda _, i: ~F.element_at(gone, i + 1)), "\n")
    out = {
        name["n"]: F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)),
        name["removed"]: F.when(gone.isNotNull(), F.size(F.filter(gone, lambda x: x))).otherwise(0),
        name["text"]: F.when(gone.isNotNull(), left).otherwise(F.col("text")),
    }
    return flagged.withColumns(out), name


def dedup_lines(docs: DataFrame, max_count: int = MAX_COUNT, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, text, n_lines, n_removed) for each row, the text without repeated lines.

    Lines end at line feeds; white space at either end plays no part in comparing them. A line of
    min_chars characters or more that occurs more than max_count times in all texts stays only at its first
    place: the least doc_id, then the least line number. Rows that repeat a doc_id count as further occurrences, and
    each keeps the line at that place. Rows without doc_id are neither counted nor changed; a null text stays null
    and has no lines, an empty one has one. Very long texts are read whole. Other columns, whatever their names, are ignored; an empty
    table gives no rows.
    """
    out, name = _kept(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), max_count, min_chars)
    return out.select("doc_id", F.col(name["text"]).alias("text"), F.col(name["n"]).alias("n_lines"), F.col(name["removed"]).alias("n_removed"))


def drop_repeated_lines(docs: DataFrame, max_count: int = MAX_COUNT, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs, all rows and columns, with the texts of dedup_lines; n_chars, if there, follows.

    Nulls, empty and very long texts, ties, repeated rows and empty tables as in dedup_lines; a text of repeated lines alone becomes empty. Columns of any name are kept.
    """
    out, name = _kept(docs, max_count, min_chars)
    new = {"text": F.col(name["text"])}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(name["removed"]) > 0, F.length(name["text"])).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return out.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns))


def sql() -> str:
    bare = f"trim(line, '{' '}' || chr(9) || chr(13) || chr(12) || chr(11))"
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
        each AS (SELECT rid, doc_id, i, line, {bare} AS bare FROM (SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM docs WHERE text IS NOT NULL)),
        often AS (SELECT bare, min(struct_pack(doc_id := doc_id, i := i)) AS first FROM each WHERE doc_id IS NOT NULL AND length(bare) >= {MIN_CHARS} GROUP BY bare HAVING count(*) > {MAX_COUNT}),
        flagged AS (SELECT rid, i, line, o.bare IS NOT NULL AND e.doc_id IS NOT NULL AND (first.doc_id <> e.doc_id OR first.i <> e.i) AS gone FROM each e LEFT JOIN often o USING (bare)),
        kept AS (SELECT rid, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS text, count(*) AS n, count(*) FILTER (WHERE gone) AS removed FROM flagged GROUP BY rid)
    SELECT doc_id, k.text, coalesce(n, 0)::INTEGER AS n_lines, coalesce(removed, 0)::INTEGER AS n_removed FROM docs LEFT JOIN kept k USING (rid)"""
