"""3. Benchmark decontamination under edit distance.

A document holds an item if some stretch of it lies within MAX_EDITS of the item's length in edit
distance, case and white space aside. Candidates come from locality-sensitive hashing: the CGK random
walk turns a window and an item into sequences whose Hamming distance follows the edit distance, and windows that agree with an
item in a sample of positions, in any of the walks' SAMPLES, are verified by exact edit distance. The number of walks follows
from RECALL: copies of the items themselves, with as many random edits as are allowed, are taken until that share is found (Items.walks).

Windows are taken where a lossless count allows a match: a stretch within k edits of an item of n bytes shares
at least n - q + 1 - k q of its q-grams, and those agree, but for the edits, in where the item begins. They begin where a shared q-gram would have the item begin, whatever is written there, as texts need not have spaces; an
edit before all shared q-grams moves that by a place or two, which counts as one or two edits more.
Items of about the same size are a class, with walks of its own length: a long item costs only its own memory.
The items are broadcast in groups of at most GROUP_BYTES, one pass over the documents for each group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain, release, steps, unused

MAX_EDITS = 0.1
GRAM = 8
#: The share of copies with the most edits allowed that hashing is to find; samples of each walk, positions in a sample; copies taken for the estimate.
RECALL, SAMPLES, SAMPLE_SIZE, COPIES, SEED = 0.97, 24, 5, 400, 5
#: Classes of which so many walks find a smaller share, as those of very long items, go without hashing: every candidate is verified.
MOST_WALKS = 32
#: Items whose sizes differ by less than this factor are of one class.
CLASS = 1.3
#: Of an item in which a q-gram occurs more often, only each q-gram's first place counts, and the shared ones need not agree in where the item begins.
REPEATED = 8
GROUP_BYTES = 8 << 20
SLOTS = 22
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

#: Bytes of the code point that begins with a byte.
_WIDE = np.ones(256, np.int64)
_WIDE[0xC0:], _WIDE[0xE0:], _WIDE[0xF0:] = 2, 3, 4

SCHEMA = "doc_id long, item_id long, edit_distance int, item_chars int"


def normal(text: str | None) -> bytes:
    """Lower case, each run of white space one space, none at the ends."""
    return " ".join(text.lower().split()).encode("utf-8", "replace") if text else b""


def edits(n: int) -> int:
    return int(n * MAX_EDITS)


def edit_distance(item: bytes, text: bytes) -> int:
    """The least edit distance between item and any stretch of text (Myers' bit-parallel recurrence), over code points."""
    a, b = item.decode("utf-8", "replace"), text.decode("utf-8", "replace")
    n = len(a)
    if not n:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full, high = (1 << n) - 1, 1 << (n - 1)
    plus, minus, score, best = full, 0, n, n
    for c in b:
        eq = masks.get(c, 0)
        x = eq | minus
        d0 = (((x & plus) + plus) ^ plus) | x
        right_plus = minus | ~(d0 | plus) & full
        right_minus = plus & d0
        if right_plus & high:
            score += 1
        elif right_minus & high:
            score -= 1
        right_plus = right_plus << 1 & full
        right_minus = right_minus << 1 & full
        plus = right_minus | ~(d0 | right_plus) & full
        minus = right_plus & d0
        if score < best:
            best = score
    return best


def grams(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as an integer."""
    if len(data) < GRAM:
        return np.zeros(0, np.uint64)
    return np.ndarray((len(data) - GRAM + 1,), "<u8", np.ascontiguousarray(data), strides=(1,))


def _slots(values: np.ndarray) -> np.ndarray:
    return ((values * _MULTIPLIER) >> np.uint64(64 - SLOTS)).astype(np.int32)


def walks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, tables: np.ndarray, count: int, sampled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """CGK walks over the bytes from each start, the byte at ends being 0 and going on for ever: what each of the sampled steps shows, and how far it has come (step x walk x start).

    tables: for each step and byte the bits by which the walks go on.
    """
    shown = np.zeros((len(sampled), count, len(starts)), np.uint8)
    place = np.zeros((len(sampled), count, len(starts)), np.int32)
    at = np.repeat(starts[None], count, 0)
    bit, plane = np.arange(count)[:, None] % 8, np.arange(count)[:, None] // 8
    following = 0
    for j in range(int(sampled[-1]) + 1):
        byte = data[np.minimum(at, ends)]
        if sampled[following] == j:
            shown[following], place[following] = byte, at - starts
            following += 1
        at += tables[plane, j, byte] >> bit & 1
    return shown, place


class Class:
    """Items of about one size: how long their walks are, and where they are sampled."""

    def __init__(self, items: np.ndarray, least: int, seed: int, count: int):
        self.items, self.steps, self.count = items, max(1, 2 * least - 1), count
        rng = np.random.default_rng((SEED, seed))
        places = (rng.random((SAMPLES, SAMPLE_SIZE)) * self.steps).astype(np.int64)
        self.salt = rng.integers(1, 1 << 62, SAMPLE_SIZE, dtype=np.uint64) | np.uint64(1)
        self.sampled, number = np.unique(places, return_inverse=True)
        self.number = number.reshape(places.shape)
        self.tables = np.stack([rng.integers(0, 256, (self.steps, 256), dtype=np.uint8) for _ in range(-(-count // 8))])

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The sampled positions of walks from each start, as one hash for each walk and sample (walk x sample x start); sizes: of the item in question, beyond which nothing shows."""
        shown, place = walks(data, starts, ends, self.tables, self.count, self.sampled)
        seen = np.where(place < sizes, shown, 0).astype(np.uint64) + np.uint64(1)
        out = np.zeros((self.count, SAMPLES, len(starts)), np.uint64)
        for k in range(SAMPLES):
            for m in range(SAMPLE_SIZE):
                out[:, k] += seen[self.number[k, m]] * self.salt[m]
        return out


def _edited(text: str, edits: int, rng: np.random.Generator) -> bytes:
    """A copy with so many random edits, a third of each kind."""
    out = list(text)
    for kind in rng.integers(0, 3, edits):
        at = int(rng.integers(0, len(out) + (kind == 1))) if out else 0
        letter = text[int(rng.integers(0, len(text)))]
        out[at : at + (kind != 1)] = [] if kind == 2 else [letter if kind == 1 or out[at] != letter else "\x01"]
    return "".join(out).encode("utf-8", "replace")


class Items:
    """A group of items: their q-grams, and the hashes of their walks; count: how many walks there are; direct: classes without."""

    def __init__(self, rows: list[tuple[int, bytes]], count: int | None = None, direct: frozenset[int] = frozenset()):
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.texts = [r[1] for r in rows]
        self.size = np.array([len(t) for t in self.texts], np.int64)
        letters = [t.decode("utf-8", "replace") for t in self.texts]
        self.chars = [len(t) for t in letters]
        # an edit takes the q-grams that overlap one code point of the item, and may add a code point of up to four bytes
        self.limit = np.array([edits(c) for c in self.chars], np.int64)
        widths = [sorted((len(c.encode("utf-8")) for c in t), reverse=True) for t in letters]
        lost = np.array([sum(w[:k]) + k * (GRAM - 1) for w, k in zip(widths, self.limit)], np.int64)
        self.need = self.size - GRAM + 1 - lost
        self.reach = self.limit * 4
        counted = np.flatnonzero(self.need > 0)
        self.banded, each = np.zeros(len(rows), bool), []
        for i in counted:
            own = grams(np.frombuffer(self.texts[i], np.uint8))
            distinct, first, times = np.unique(own, return_index=True, return_counts=True)
            self.banded[i] = times.max() <= REPEATED
            each.append((own, np.arange(len(own))) if self.banded[i] else (distinct, first))
        gram, offset = (np.concatenate(x) for x in zip(*each)) if each else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        item = np.repeat(counted, [len(x[0]) for x in each]) if each else np.zeros(0, np.int64)
        self.width = np.array([w[0] if w else 1 for w in widths], np.int64)
        order = np.argsort(gram, kind="stable")
        self.gram, self.gram_item, self.gram_place = gram[order], item[order], offset[order]
        self.known = np.zeros(1 << SLOTS, bool)
        self.known[_slots(self.gram)] = True
        # items too short for the count: one of limit + 1 pieces must occur as it is, at most limit places from where it would without edits
        self.pieces: list[tuple[int, int, bytes]] = []
        for i in np.flatnonzero(self.need <= 0):
            parts = self.limit[i] + 1
            cuts = [len(letters[i]) * k // parts for k in range(parts + 1)]
            self.pieces += [(int(i), len(letters[i][:a].encode("utf-8", "replace")), letters[i][a:b].encode("utf-8", "replace")) for a, b in zip(cuts, cuts[1:]) if b > a]
        # items of a class share a window and the least count that any of them needs
        members: list[np.ndarray] = []
        by_size = np.argsort(self.size, kind="stable")
        while len(by_size):
            own = int(np.searchsorted(self.size[by_size], CLASS * self.size[by_size[0]] + 1, "right"))
            members.append(by_size[:own])
            by_size = by_size[own:]
        self.windows = [(int(max(self.size[own] + self.reach[own])), int(min(self.need[own]))) for m in members if len(own := m[self.need[m] > 0])]
        self.of_class, self.row = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        for k, m in enumerate(members):
            self.of_class[m], self.row[m] = k, np.arange(len(m))
        self.count, self.direct = self.walks(members) if count is None else (count, direct)
        self.classes, self.hashes = {}, {}
        for k, m in enumerate(members):
            if k not in self.direct:
                self.classes[k] = Class(m, int(self.size[m[0]]), k, self.count)
                self.hashes[k] = self.classes[k].hashes(*_rows([self.texts[i] for i in m]), self.size[m])

    def walks(self, members: list[np.ndarray]) -> tuple[int, frozenset[int]]:
        """How many walks find RECALL of random copies of these items with all edits allowed, and the classes of which MOST_WALKS don't; the same at any number of documents."""
        rng = np.random.default_rng(SEED)
        which = np.flatnonzero(self.limit > 0)
        if not len(which):
            return 1, frozenset()
        which = rng.choice(which, COPIES)
        few = [rng.choice(own, 20) for k, m in enumerate(members) if len(own := m[self.limit[m] > 0]) and (self.of_class[which] == k).sum() < 20]
        which = np.sort(np.concatenate([which, *few]))
        share = lambda n, found: np.concatenate([h[:n].any(0) for h in found]).mean()
        count, hit, hopeless = 4, {}, set()
        while True:
            rng = np.random.default_rng(SEED)
            for k in np.unique(self.of_class[which]).tolist():
                if k in hopeless:
                    continue
                made, found = Class(members[k], int(self.size[members[k][0]]), k, count), []
                own = which[self.of_class[which] == k]
                own = own[: max(20, (1 << 19) // made.steps)]  # fewer of long ones
                step = max(1, (1 << 22) // made.steps)
                for at in range(0, len(own), step):
                    part = own[at : at + step]
                    copies = [_edited(self.texts[i].decode("utf-8", "replace"), int(self.limit[i]), rng) for i in part]
                    found.append((made.hashes(*_rows([self.texts[i] for i in part]), self.size[part]) == made.hashes(*_rows(copies), self.size[part])).any(1))
                hit[k] = np.concatenate(found, 1)
                if count > 4 and hit[k].any(0).mean() < 0.5:
                    hopeless.add(k)
            direct = frozenset(k for k, h in hit.items() if h.any(0).mean() < RECALL) if count == MOST_WALKS else frozenset(hopeless)
            rest = [h for k, h in hit.items() if k not in direct]
            for n in range(1, count + 1):
                if not rest or share(n, rest) >= RECALL:
                    return n, direct
            count *= 2

    def matches(self, texts: list[bytes], starts: dict[str, np.ndarray], chunk: int = 1 << 12) -> dict[tuple[int, int], int]:
        """By text and item: the least edit distance within the limit, from candidates (see below)."""
        text, item, start = starts["text"], starts["item"], starts["start"]
        if not len(text):
            return {}
        used, number = np.unique(text, return_inverse=True)
        data, begins, ends = _rows([texts[t] for t in used])
        hit = np.zeros(len(text), bool)
        for k in np.unique(self.of_class[item]):
            own = np.flatnonzero(self.of_class[item] == k)
            if k in self.direct:
                hit[own] = True
                continue
            for at in range(0, len(own), chunk):
                pairs = own[at : at + chunk]
                found = self.classes[k].hashes(data, begins[number[pairs]] + start[pairs], ends[number[pairs]], self.size[item[pairs]])
                hit[pairs] = (found == self.hashes[k][:, :, self.row[item[pairs]]]).any((0, 1))
        out: dict[tuple[int, int], int] = {}
        done: dict[tuple[int, int], int] = {}
        for t, i, s in zip(text[hit].tolist(), item[hit].tolist(), start[hit].tolist()):
            if s < done.get((t, i), -1):
                continue  # the stretch verified before goes at least as far
            reach, size = int(self.reach[i]), int(self.size[i])
            done[t, i] = s + size // 2
            distance = edit_distance(self.texts[i], texts[t][max(0, s - reach) : s + size + 2 * reach + size // 2])
            if distance <= self.limit[i]:
                out[t, i] = min(out.get((t, i), distance), distance)
        return out


def _rows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes, a 0 behind each, and where each begins and ends."""
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    until = np.cumsum(sizes)
    return np.frombuffer(b"\0".join(texts) + b"\0", np.uint8), until - sizes, until - 1


def candidates(items: Items, texts: list[bytes]) -> dict[str, np.ndarray]:
    """Where windows begin that may match an item: text, item, start in the text; in that order. Every match has one, at most as many places off as it has edits."""
    joined = b"\n".join(texts) + b"\n"
    sizes = np.array([len(t) + 1 for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    data = np.frombuffer(joined, np.uint8)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # where the evidence is, item, where the item would begin
    for item, offset, piece in items.pieces:
        at, places = joined.find(piece), []
        while at >= 0:
            places.append(at)
            at = joined.find(piece, at + 1)
        if places:
            off = np.arange(-int(items.limit[item]), int(items.limit[item]) + 1)
            place = np.repeat(np.array(places, np.int64), len(off))
            found.append((place, np.full(len(place), item), place - offset + np.tile(off, len(places))))
    if items.windows and len(data) >= GRAM:
        values = grams(data)
        hits = np.flatnonzero(items.known[_slots(values)])
        value = values[hits]
        hits = hits[np.append(items.gram, np.uint64(0))[np.searchsorted(items.gram, value)] == value]
        marked = np.zeros(len(hits), bool)
        for window, need in items.windows:
            if len(hits) >= need:
                full = np.flatnonzero(hits[need - 1 :] - hits[: len(hits) - need + 1] <= window)
                edge = np.bincount(full, minlength=len(hits) + 1) - np.bincount(full + need, minlength=len(hits) + 1)
                marked |= np.cumsum(edge)[: len(hits)] > 0
        hits = hits[marked]
        value = values[hits]
        low, high = np.searchsorted(items.gram, value), np.searchsorted(items.gram, value, "right")
        count = high - low
        which = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        item, place, begin = items.gram_item[which], np.repeat(hits, count), np.repeat(hits, count) - items.gram_place[which]
        # the q-grams that a match shares would have the item begin within as many bytes as its edits put in or take out
        text = np.searchsorted(begins, place, "right") - 1
        wide = np.maximum.reduceat(_WIDE[data], begins)[text]
        spread = np.where(items.banded[item], items.limit[item] * np.maximum(items.width[item], wide), items.size[item] + items.reach[item])
        along = np.where(items.banded[item], begin, place)
        order = np.lexsort((along, item))
        item, place, begin, along, spread = (x[order] for x in (item, place, begin, along, spread))
        need = items.need[item]
        last = np.arange(len(item)) + need - 1
        inside = last < len(item)
        last = np.where(inside, last, 0)
        good = np.flatnonzero(inside & (item[last] == item) & (along[last] - along <= spread))
        edge = np.bincount(good, minlength=len(item) + 1) - np.bincount(last[good] + 1, minlength=len(item) + 1)
        own = np.cumsum(edge)[: len(item)] > 0
        found.append((place[own], item[own], begin[own]))
    if not found:
        return {"text": np.zeros(0, np.int64), "item": np.zeros(0, np.int64), "start": np.zeros(0, np.int64)}
    place, item, begin = (np.concatenate(x).astype(np.int64) for x in zip(*found))
    text = np.searchsorted(begins, place, "right") - 1
    start = np.clip(begin - begins[text], 0, np.maximum(sizes[text] - 2, 0))
    rows = np.unique(np.stack([text, item, start]), axis=1) if len(text) else np.zeros((3, 0), np.int64)
    return dict(zip(("text", "item", "start"), rows))


def _groups(benchmark: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    group, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id IS NOT NULL AND text IS NOT NULL").distinct().orderBy("item_id", "text")
    for row in rows.toLocalIterator():
        if text := normal(row.text):
            if group and size + len(text) > GROUP_BYTES:
                yield group
                group, size = [], 0
            group.append((row.item_id, text))
            size += len(text)
    if group:
        yield group


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edit_distance, item_chars): each document and item of benchmark(item_id, text) that it holds.

    Texts and items are compared in lower case, with single spaces, whole, however long they are; an item of n characters matches a
    stretch within n / 10 edits, rounded down; exact and closer copies are found with a greater chance than RECALL. Of several stretches the least distance counts. Nulls, empty texts and items hold and are nothing. A row of docs
    without doc_id appears with a null; rows that repeat a doc_id, and items that repeat an item_id, count as one, with the least distance.
    Other columns are ignored; an empty table gives no rows. No shuffle but that of the pairs found.
    """
    spark = docs.sparkSession
    docs = plain(docs).where("text IS NOT NULL")
    found = None
    for group in _groups(benchmark):
        made = Items(group)
        shared = spark.sparkContext.broadcast((group, made.count, made.direct))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            items = Items(*shared.value)
            for batch in batches:
                release()
                for part in steps(batch):
                    ids = part.column("doc_id").to_pylist()
                    texts = [normal(t) for t in part.column("text").to_pylist()]
                    rows = [
                        (ids[t], int(items.ids[i]), int(d), items.chars[i])
                        for (t, i), d in items.matches(texts, candidates(items, texts)).items()
                    ]
                    if rows:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(x, k) for x, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "edit_distance", "item_chars"]
                        )

        one = docs.mapInArrow(run, SCHEMA)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], SCHEMA)
    return found.groupBy("doc_id", "item_id").agg(F.min_by(F.struct("edit_distance", "item_chars"), "edit_distance").alias("m")).select("doc_id", "item_id", "m.*")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, all columns, without those that hold an item. Few are expected: Spark chooses the join by the size of their ids.

    Rows whose text is null or empty stay. Rows without doc_id count as one document, as do those that repeat one: all go if one holds an item. Very
    long texts and items, ties and empty tables as in contaminated; columns of any name are kept.
    """
    gone = unused(docs, "gone")
    return docs.join(contaminated(docs, benchmark).select(F.col("doc_id").alias(gone)).distinct(), docs["doc_id"].eqNullSafe(F.col(gone)), "left_anti")
