"""2. Suffix-array deduplication of repeated passages.

Passages of LENGTH words or more that occur twice or more, anywhere in the corpus, are found from
suffix arrays that are built column-wise. Every window of LENGTH words has an anchor, the word GRAM-gram with the
least hash in it, so equal windows have equal anchors; neighbouring windows with one anchor form a piece.
Anchors that occur once can't belong to a repeated passage. The pieces of the others are the documents of the collections: equal
ones are one, with the number of its occurrences and the first, so that a passage in very many texts is one document. They are spread
over the cluster by anchor, so that a window and all its repetitions meet in one collection, and a piece is never longer than
2 LENGTH - GRAM words: that bounds the number of rounds, each of which reads and writes the collection's files, whatever the lengths of
texts. What a collection finds goes back to the pieces' occurrences; texts are never sent.

In a collection, round j inserts the symbol j from the end of every piece at once. The suffixes inserted
so far are kept in order as columns (first symbol and place of the rest; preceding symbol, that is the collection's
Burrows-Wheeler transform; common prefix with the suffix before) in files of the shared folder, which a
round reads and writes sequentially. A new suffix's place follows from its symbol and the place of its
rest; its common prefix is one more than the least between the rests. In the end, suffixes of
LENGTH words or more that share that many with a neighbour are repeated windows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, collect_garbage, delete_path, filesystem, in_arrow, mix, new_path, plain, powers, release, span_hashes, spans, stored, text_bytes, written

LENGTH, GRAM = 50, 8
#: Rows of a file that a round handles at once; symbols that a collection is meant to have.
BLOCK, COLLECTION = 1 << 20, 1 << 20

_ANCHORS = "row long, anchor long, n int"
_PIECES = "anchor long, content long, doc_id long, starts array<int>, windows int, words binary"


def pieces(data: np.ndarray, offsets: np.ndarray):
    """Words of the texts, and their pieces: text, first window (number of its first word), windows, anchor, content."""
    starts, ends, doc = spans(~SPACE[data], offsets)
    h = span_hashes(data, starts, ends)
    n, width = len(h), LENGTH - GRAM + 1
    none = (starts, ends, *(np.zeros(0, np.int64),) * 3, *(np.zeros(0, np.uint64),) * 2)
    if n < LENGTH:
        return none
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * powers(n), out=sums[1:])
    back = powers(n + 1, pow(int(powers(2)[1]), -1, 1 << 64))
    gram = mix((sums[GRAM:] - sums[:-GRAM]) * back[: n - GRAM + 1])
    order = np.argsort(gram, kind="stable")
    rank = np.empty(len(gram), np.int64)
    rank[order] = np.arange(len(gram))  # of equal grams the leftmost counts as least
    blocks = -(-len(rank) // width)
    padded = np.full(blocks * width, len(rank), np.int64)
    padded[: len(rank)] = rank
    padded = padded.reshape(blocks, width)
    left = np.minimum.accumulate(padded, 1).ravel()
    right = np.minimum.accumulate(padded[:, ::-1], 1)[:, ::-1].ravel()
    window = np.arange(n - LENGTH + 1)
    anchor = order[np.minimum(right[window], left[window + width - 1])]
    window_ok = doc[window] == doc[window + LENGTH - 1]
    window, anchor = window[window_ok], anchor[window_ok]
    if not len(window):
        return none
    first = np.flatnonzero(np.append(True, (np.diff(anchor) != 0) | (np.diff(window) != 1)))
    count = np.diff(np.append(first, len(window)))
    begin = window[first]
    until = begin + count + LENGTH - 1
    content = mix((sums[until] - sums[begin]) * back[begin] + count.astype(np.uint64))
    return starts, ends, doc[begin], begin, count, gram[anchor[first]], content


def _anchor_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    _, _, doc, _, _, anchor, _ = pieces(*text_bytes(batch.column("text")))
    order = np.lexsort((anchor, doc))
    doc, anchor = doc[order], anchor[order]
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1]))[: len(doc)])
    count = np.diff(np.append(first, len(doc)))
    return pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(doc[first])), pa.array(anchor[first].view(np.int64)), pa.array(count.astype(np.int32))], ["row", "anchor", "n"])


def _piece_rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
    """The pieces with a shared anchor; those of a text that have the same words are one row with several starts."""
    data, offsets = text_bytes(batch.column("text"))
    starts, ends, doc, begin, count, anchor, content = pieces(data, offsets)
    shared = batch.column("anchors")
    lists = np.diff(shared.offsets.to_numpy())
    pair = mix(np.repeat(np.arange(1, len(batch) + 1, dtype=np.uint64), lists)) ^ shared.flatten().to_numpy().view(np.uint64)
    there = np.isin(mix((doc + 1).astype(np.uint64)) ^ anchor, pair)
    doc, begin, count, anchor, content = (x[there] for x in (doc, begin, count, anchor, content))
    if not len(doc):
        return None
    order = np.lexsort((begin, content, anchor, doc))
    doc, begin, count, anchor, content = (x[order] for x in (doc, begin, count, anchor, content))
    first = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])))
    text_first = np.searchsorted(starts, offsets[:-1])
    raw = data.tobytes()
    words = [raw[starts[a] : ends[a + c + LENGTH - 2]] for a, c in zip(begin[first].tolist(), count[first].tolist())]
    places = pa.ListArray.from_arrays(pa.array(np.append(first, len(doc)).astype(np.int32)), pa.array((begin - text_first[doc]).astype(np.int32)))
    return pa.RecordBatch.from_arrays(
        [pa.array(anchor[first].view(np.int64)), pa.array(content[first].view(np.int64)), batch.column("doc_id").take(pa.array(doc[first])), places, pa.array(count[first].astype(np.int32)), pa.array(words, pa.binary())],
        ["anchor", "content", "doc_id", "starts", "windows", "words"],
    )


class Minima:
    """Least values of ranges of a column of bytes."""

    WIDE = 64

    def __init__(self, values: np.ndarray):
        blocks = -(-len(values) // self.WIDE)
        padded = np.full(blocks * self.WIDE, 255, np.uint8)
        padded[: len(values)] = values
        self.rows = padded.reshape(blocks, self.WIDE)
        self.levels = [self.rows.min(1)]
        while 2 << len(self.levels) - 1 <= blocks:
            last, half = self.levels[-1], 1 << len(self.levels) - 1
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def _within(self, row: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        place = np.arange(self.WIDE)
        return np.where((place >= a[:, None]) & (place <= b[:, None]), self.rows[row], 255).min(1) if len(row) else np.zeros(0, np.uint8)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The least of a .. b, both included, for each pair."""
        row_a, row_b = a // self.WIDE, b // self.WIDE
        same = row_a == row_b
        out = np.full(len(a), 255, np.uint8)
        out[same] = self._within(row_a[same], a[same] % self.WIDE, b[same] % self.WIDE)
        far = np.flatnonzero(~same)
        if len(far):
            whole = np.full(len(far), self.WIDE - 1)
            out[far] = np.minimum(self._within(row_a[far], a[far] % self.WIDE, whole), self._within(row_b[far], 0 * whole, b[far] % self.WIDE))
            between = far[row_b[far] - row_a[far] > 1]
            span = row_b[between] - row_a[between] - 1
            level = np.frexp(span.astype(float))[1] - 1
            for k in np.unique(level):
                own = between[level == k]
                out[own] = np.minimum(out[own], np.minimum(self.levels[k][row_a[own] + 1], self.levels[k][row_b[own] - (1 << k)]))
        return out


class Files:
    """Columns in sequential files of one folder; each round reads one generation and writes the next."""

    KINDS = {"key": np.dtype(np.uint64), "bwt": np.dtype(np.int32), "lcp": np.dtype(np.uint8)}

    def __init__(self, uri: str):
        self.fs, self.path = filesystem(uri)
        self.fs.create_dir(self.path)
        self.generation = 0

    def read(self, kind: str) -> Iterator[np.ndarray]:
        size = self.KINDS[kind].itemsize
        with self.fs.open_input_stream(f"{self.path}/{kind}.{self.generation}") as file:
            while len(block := file.read(BLOCK * size)):
                yield np.frombuffer(block, self.KINDS[kind])

    def write(self, columns: Iterator[dict[str, np.ndarray]]) -> None:
        files = {k: self.fs.open_output_stream(f"{self.path}/{k}.{self.generation + 1}") for k in self.KINDS}
        for block in columns:
            for k, file in files.items():
                file.write(np.ascontiguousarray(block[k]).data)
        for k, file in files.items():
            file.close()
            if self.generation:
                self.fs.delete_file(f"{self.path}/{k}.{self.generation}")
        self.generation += 1

    def drop(self) -> None:
        self.fs.delete_dir(self.path)


_LOW = np.uint64((1 << 32) - 1)
_HIGH = np.uint64(32)


def construct(symbols: np.ndarray, ends: np.ndarray, sizes: np.ndarray, files: Files, cap: int = LENGTH) -> np.ndarray:
    """Builds the collection's columns from the texts symbols[ends - sizes : ends], symbols from 1; the place of each whole text.

    Common prefixes are counted up to cap.
    """
    n, place = len(ends), np.arange(len(ends))
    before = np.where(sizes > 0, symbols[np.maximum(ends - 1, 0)], 0).astype(np.int32)
    files.write(iter([{"key": np.arange(n, dtype=np.uint64), "bwt": before, "lcp": np.zeros(n, np.uint8)}]))
    for j in range(1, int(sizes.max()) + 1):
        active = np.flatnonzero(sizes >= j)
        fresh = symbols[ends[active] - j].astype(np.uint64) << _HIGH | place[active].astype(np.uint64)
        order = np.argsort(fresh)
        active, fresh = active[order], fresh[order]
        previous = np.where(sizes[active] > j, symbols[np.maximum(ends[active] - j - 1, 0)], 0).astype(np.int32)
        at, seen = np.zeros(len(fresh), np.int64), 0
        for block in files.read("key"):  # rows of the new suffixes, as seen from the old ones
            at += np.searchsorted(block, fresh)
            seen += len(block)
        shift = np.cumsum(np.bincount(at, minlength=n + 1))[:n]
        files.write(_merged(files, fresh, previous, at, shift, Minima(np.concatenate(list(files.read("lcp")))), cap))
        place = place + shift[place]
        place[active] = at + np.arange(len(at))
        n += len(at)
    return place


def _merged(files: Files, fresh: np.ndarray, previous: np.ndarray, at: np.ndarray, shift: np.ndarray, minima: Minima, cap: int) -> Iterator[dict[str, np.ndarray]]:
    """The next generation's blocks."""
    base, done, last_key, last_new = 0, 0, None, False
    for key, bwt, lcp in zip(*(files.read(k) for k in ("key", "bwt", "lcp"))):
        final = base + len(key) == len(shift)
        to = len(at) if final else int(np.searchsorted(at, base + len(key)))
        own = slice(done, to)
        new_rows = at[own] - base + np.arange(to - done)
        size = len(key) + to - done
        is_new = np.zeros(size, bool)
        is_new[new_rows] = True
        old_rows = np.flatnonzero(~is_new)
        keys, bwts, lcps = np.empty(size, np.uint64), np.empty(size, np.int32), np.empty(size, np.uint8)
        keys[new_rows], keys[old_rows] = fresh[own], key
        bwts[new_rows], bwts[old_rows] = previous[own], bwt
        lcps[old_rows] = lcp
        stale = is_new.copy()  # new rows and those after them
        stale[1:] |= is_new[:-1]
        stale[0] |= last_new
        rows = np.flatnonzero(stale)
        earlier = np.where(rows > 0, keys[rows - 1], np.uint64(0) if last_key is None else last_key)
        later = keys[rows]
        same = (earlier >> _HIGH == later >> _HIGH) & (later >> _HIGH > 0)
        if last_key is None and len(rows) and rows[0] == 0:
            same[0] = False
        found = np.zeros(len(rows), np.uint8)
        found[same] = np.minimum(minima((earlier[same] & _LOW).astype(np.int64) + 1, (later[same] & _LOW).astype(np.int64)).astype(np.int64) + 1, cap)
        lcps[rows] = found
        last_key, last_new = keys[-1], bool(is_new[-1])
        yield {"key": keys + shift[(keys & _LOW).astype(np.int64)].astype(np.uint64), "bwt": bwts, "lcp": lcps}
        base, done = base + len(key), to


def repeats(table: pa.Table, files: Files) -> Iterator[pa.RecordBatch]:
    """From a collection's distinct pieces: (content, kind, low, high), stretches of a piece's words.

    repeat: of windows that occur twice or more; later: the same, for occurrences other than the piece's first; first: without windows whose first occurrence is that.
    """
    data, offsets = text_bytes(table.column("words"))
    starts, ends, _ = spans(~SPACE[data], offsets)
    _, symbols = np.unique(span_hashes(data, starts, ends), return_inverse=True)
    content, times, doc, start = (table.column(c).to_numpy() for c in ("content", "times", "doc_id", "start"))
    windows = table.column("windows").to_numpy().astype(np.int64)
    sizes = windows + LENGTH - 1
    place = construct(symbols + 1, np.cumsum(sizes), sizes, files)

    # windows' rows: from a whole piece's row on, each rest is a step further
    key = np.concatenate(list(files.read("key")))
    group_of_row = np.cumsum(np.concatenate(list(files.read("lcp"))) < LENGTH)
    owner = np.repeat(np.arange(len(windows)), windows)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    group = np.empty(len(owner), np.int64)
    begin, row = np.cumsum(windows) - windows, place
    for t in range(int(windows.max())):
        own = np.flatnonzero(windows > t)
        group[begin[own] + t] = group_of_row[row[own]]
        row = (key[row] & _LOW).astype(np.int64)
    _, group = np.unique(group, return_inverse=True)
    again = np.bincount(group, times[owner])[group] >= 2
    order = np.lexsort((start[owner] + inside, doc[owner], group))
    top = order[np.append(True, np.diff(group[order]) != 0)][group]  # the window with the group's first occurrence
    is_first = (doc[owner] == doc[owner[top]]) & (start[owner] + inside == start[owner[top]] + inside[top])
    for kind, mask in (("repeat", again), ("later", again), ("first", again & ~is_first)):
        edge = np.flatnonzero(mask & ~(np.append(False, mask[:-1]) & (inside > 0)))
        stop = np.flatnonzero(mask & ~(np.append(mask[1:], False) & (inside + 1 < windows[owner])))
        yield pa.RecordBatch.from_arrays([pa.array(content[owner[edge]]), pa.array([kind] * len(edge), pa.string()), pa.array(inside[edge].astype(np.int32)), pa.array((inside[stop] + LENGTH).astype(np.int32))], ["content", "kind", "low", "high"])


def _collections(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (batches := [b for b in batches if len(b)]):
            return
        task = TaskContext.get()
        files = Files(f"{folder}/{task.partitionId()}-{task.taskAttemptId()}-{uuid.uuid4().hex}")
        try:
            yield from repeats(pa.Table.from_batches(batches), files)
        finally:
            files.drop()
            del batches
            release()

    return run


def repeated_passages(docs: DataFrame) -> DataFrame:
    """(doc_id, kind, start_word, end_word): stretches of words, counted from 0, that repeat.

    Kind repeat: the union of all windows of LENGTH words that occur twice or more, within a document
    or across them. Kind remove: the same without each window's first occurrence (least doc_id, then
    least place), so that one copy of everything stays. Words are separated by ASCII white space and compared byte by byte.
    Texts that are null or have fewer words repeat nothing, nor do rows without doc_id. Very long texts are read whole. Every row is a text of its
    own: rows that repeat doc_id and text are repeats, first together. Other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = plain(docs).where("doc_id IS NOT NULL AND text IS NOT NULL").withColumn("row", F.xxhash64("doc_id", "text"))
    anchors, anchors_path = stored(in_arrow(docs, _anchor_rows, _ANCHORS), "anchors")
    shared = anchors.groupBy("anchor").agg(F.sum("n").alias("times")).where("times > 1").select("anchor")
    of_row = anchors.join(shared, "anchor").groupBy("row").agg(F.collect_set("anchor").alias("anchors"))
    found, found_path = stored(in_arrow(docs.join(of_row, "row"), _piece_rows, _PIECES), "pieces")
    delete_path(spark, anchors_path)
    collect_garbage(spark)
    first = F.min(F.struct("doc_id", F.element_at("starts", 1).alias("start")))
    distinct = found.groupBy("anchor", "content", "windows").agg(F.sum(F.size("starts")).alias("times"), first.alias("first"), F.any_value("words").alias("words"))
    distinct, distinct_path = stored(distinct.select("anchor", "content", "windows", "times", "first.*", "words"), "distinct-pieces")
    collect_garbage(spark)
    symbols = distinct.agg(F.sum(F.col("windows") + F.lit(LENGTH - 1))).first()[0] or 0
    folder = new_path(spark, "suffixes")
    runs = distinct.repartition(max(1, -(-symbols // COLLECTION)), "anchor").mapInArrow(_collections(folder), "content long, kind string, low int, high int")
    runs, runs_path = stored(runs, "stretches-of-pieces")
    delete_path(spark, folder)
    heads = distinct.select("content", F.col("doc_id").alias("first_doc"), F.col("start").alias("first_start"))
    each = found.select("content", "doc_id", F.explode("starts").alias("start")).join(heads, "content").join(runs, "content")
    lead = (F.col("doc_id") == F.col("first_doc")) & (F.col("start") == F.col("first_start"))
    each = each.where((F.col("kind") == "repeat") | (lead == (F.col("kind") == "first")))
    stretches = each.select("doc_id", F.when(F.col("kind") == "repeat", "repeat").otherwise("remove").alias("kind"), (F.col("start") + F.col("low")).alias("start_word"), (F.col("start") + F.col("high")).alias("end_word"))
    by = Window.partitionBy("doc_id", "kind").orderBy("start_word", "end_word")
    until = F.max("end_word").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start_word") <= F.col("until"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    out = (
        stretches.distinct().withColumn("until", until).withColumn("island", island)
        .groupBy("doc_id", "kind", "island").agg(F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"))
        .drop("island")
    )
    out = written(out, "stretches")
    for path in (found_path, distinct_path, runs_path):
        delete_path(spark, path)
    return out


def sql() -> str:
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS ws FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL),
        windows AS (SELECT rid, doc_id, i::INTEGER - 1 AS a, md5(array_to_string(ws[i:i + {LENGTH - 1}], ' ')) AS h FROM docs, unnest(range(1, len(ws) - {LENGTH} + 2)) AS t(i)),
        often AS (SELECT h, min(struct_pack(doc_id := doc_id, a := a)) AS first FROM windows GROUP BY h HAVING count(*) > 1),
        hits AS (SELECT w.doc_id, w.a, first.doc_id = w.doc_id AND first.a = w.a AS is_first FROM windows w JOIN often USING (h)),
        kinds AS (SELECT DISTINCT doc_id, 'repeat' AS kind, a FROM hits UNION ALL SELECT DISTINCT doc_id, 'remove' AS kind, a FROM hits WHERE NOT is_first),
        isles AS (SELECT *, sum(CASE WHEN a <= p + {LENGTH} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, kind ORDER BY a) AS island
            FROM (SELECT *, lag(a) OVER (PARTITION BY doc_id, kind ORDER BY a) AS p FROM kinds))
    SELECT doc_id, kind, min(a)::INTEGER AS start_word, (max(a) + {LENGTH})::INTEGER AS end_word FROM isles GROUP BY doc_id, kind, island"""
