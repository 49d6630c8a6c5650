"""10. Language-model scores with contexts of unbounded length.

The model has no order: a word is predicted from the longest context, of any number of words back to the text's beginning,
that occurs elsewhere in the corpus. All it needs of a word is the longest string of words ending there that occurs twice or
more, and how often. For if the string ending at word t - 1 has L words and N occurrences, N - 1 other places have this
context; and they go on with word t as often as the string ending at t occurs elsewhere, if that is the context with t added, and
never otherwise: a string that occurs twice does so without its last word too.

Texts are written once as parts of words. Strings of up to DIRECT words are counted by their hashes: parts send their
distinct ones to ranges of hashes and get the sums back. Only words that end a string of DIRECT words with another occurrence
go on, a third of them in ordinary text. They form runs, beyond whose beginning nothing can occur twice. The runs' prefix
sums, from which any string's hash follows, are written to files; the words, as places in these files, go to the shard of their last
DIRECT words, so that all that share a context meet. A shard sorts its suffixes: by the hash of the last DIRECT words, those that
are equal by that of twice as many, and so on, so that every context of such a length is an interval of its array. A word whose interval
holds nothing else finds its longest context by binary search between the two lengths, against one suffix for each of the
neighbouring intervals, with hashes from the files; the intervals' sizes add up to the count.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, collect_garbage, delete_path, filesystem, mix, new_path, plain, powers, release, span_hashes, spans, steps, stored, text_bytes, written

#: Strings of up to so many words are counted by their hashes, longer ones searched in the shards; a power of two.
DIRECT = 4
#: Weight of the word frequencies against the counts of a context.
SMOOTHING = 1.0
#: Words that a shard, or a range of hashes, is meant to have, and that a task gathers as one part.
SHARD_WORDS, GATHER = 1 << 21, 1 << 20
#: Bits of a hash beyond those that number the words: one string in 2 ** SPARE is taken for another.
SPARE = 20
#: Parts that share a file of answers.
TOGETHER = 4
#: Sums read at once, and blocks kept, from a file that can't be mapped.
BLOCK, BLOCKS_KEPT = 1 << 13, 1 << 10

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LENGTH = np.uint64(0xD1B54A32D192ED03)
_GROUP = np.uint64(0x8CB92BA72F3D8DD7)
#: Ranges of the hashes of strings of two words or more are numbered from here, those of single words from 0.
_OTHERS = 1 << 30

PARTS = "part long, n long, block binary"
COUNTS = "range int, part long, mark long, block binary"
ANSWERS = "part long, range int, mark long, block binary, distinct long"
ENTRIES = "shard int, part long, file string, base long, block binary"
FOUND = "part long, shard int, block binary"


def _planes(values: np.ndarray, wide: int = 4) -> list[bytes]:
    """The values' bytes, the lowest of all first; wide of them each."""
    rows = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)
    return [np.ascontiguousarray(rows[:, k]).tobytes() for k in range(wide)]


def _join(fields: list[bytes]) -> bytes:
    pressed = [zstandard.compress(f, 3) if f.strip(b"\0") else b"" if not f else struct.pack("<Q", len(f)) for f in fields]
    return struct.pack(f"<{len(pressed)}I", *map(len, pressed)) + b"".join(pressed)


def _split(block: bytes, n: int) -> list[bytes]:
    fields, at = [], 4 * n
    for size in struct.unpack_from(f"<{n}I", block):
        own = block[at : at + size]
        fields.append(b"" if not size else bytes(struct.unpack("<Q", own)[0]) if size == 8 else zstandard.decompress(own))
        at += size
    return fields


def _values(planes: list[bytes]) -> np.ndarray:
    out = np.zeros((len(planes[0]), 8), np.uint8)
    for k, plane in enumerate(planes):
        out[:, k] = np.frombuffer(plane, np.uint8)
    return out.view("<u8").ravel().astype(np.uint64, copy=False)


class Part(NamedTuple):
    """Some texts: their doc_ids, their numbers of words, the 64-bit hashes of distinct words, and each word's place among those."""

    number: int
    ids: np.ndarray
    sizes: np.ndarray
    vocabulary: np.ndarray
    local: np.ndarray

    def pack(self) -> bytes:
        often = np.argsort(-np.bincount(self.local, minlength=len(self.vocabulary)), kind="stable")  # frequent words have small numbers
        rank = np.empty(len(often), np.int64)
        rank[often] = np.arange(len(often))
        return _join([self.ids.astype(np.int64).tobytes(), *_planes(self.sizes), *_planes(np.diff(self.vocabulary, prepend=np.uint64(0)), 8), *_planes(rank), *_planes(rank[self.local])])

    @classmethod
    def unpack(cls, number: int, block: bytes) -> Part:
        fields = _split(block, 21)
        vocabulary, rank = np.cumsum(_values(fields[5:13]), dtype=np.uint64), _values(fields[13:17]).astype(np.int64)
        often = np.empty(len(rank), np.int64)
        often[rank] = np.arange(len(rank))
        return cls(number, np.frombuffer(fields[0], np.int64), _values(fields[1:5]).astype(np.int64), vocabulary, often[_values(fields[17:21]).astype(np.int64)])

    def inside(self) -> np.ndarray:
        """How many words of its text end with each word."""
        begin = np.cumsum(self.sizes) - self.sizes
        return np.arange(1, len(self.local) + 1) - np.repeat(begin, self.sizes)


def sums(words: np.ndarray) -> np.ndarray:
    """n + 1 values s with s[i + 1] = s[i] * BASE + words[i]."""
    n = len(words)
    out = np.zeros(n + 1, np.uint64)
    np.cumsum(words * powers(n + 1, _INVERSE)[1:], out=out[1:])
    return out * powers(n + 1, _BASE)


def hashes(here: np.ndarray, before: np.ndarray, k: np.ndarray | int) -> np.ndarray:
    """Of the strings of k words between two values of sums."""
    k = np.asarray(k)
    return mix(here - before * powers(int(k.max(initial=0)) + 1, _BASE)[k] + k.astype(np.uint64) * _LENGTH)


def _part_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's texts in parts of about GATHER words."""
    task = TaskContext.get()
    number, gathered, size = (task.partitionId() if task else 0) << 24, [], 0

    def row() -> pa.RecordBatch:
        ids, counts, words = (np.concatenate(x) for x in zip(*gathered))
        vocabulary, local = np.unique(words, return_inverse=True)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(words)], pa.int64()), pa.array([Part(number, ids, counts, vocabulary, local).pack()], pa.binary())], ["part", "n", "block"])

    for batch in batches:
        for step in steps(batch):
            data, offsets = text_bytes(step.column("text"))
            starts, ends, doc = spans(ALNUM[data], offsets)
            words = span_hashes(data, starts, ends, fold=True) if len(starts) else np.zeros(0, np.uint64)
            gathered.append((step.column("doc_id").to_numpy(), np.bincount(doc, minlength=len(step)), words))
            size += len(words)
            if size >= GATHER:
                yield row()
                number, gathered, size = number + 1, [], 0
                release()
    if gathered:
        yield row()
    gathered = []
    release()


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
    for batch in batches:
        for number, block in zip(batch.column("part").to_pylist(), batch.column("block").to_pylist()):
            yield Part.unpack(number, block)
    release()


def _grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each value its place among the distinct ones in order; of each distinct one, where one such is and how many there are."""
    order = np.argsort(values)
    fresh = np.append(True, np.diff(values[order]) != 0)[: len(values)]
    first = np.flatnonzero(fresh)
    place = np.empty(len(values), np.int64)
    place[order] = np.cumsum(fresh) - 1
    return place, order[first], np.diff(np.append(first, len(values)))


class Strings(NamedTuple):
    """A part's strings of some lengths: the words they end at, by length; distinct hashes, single words' before the others', how often each; each string's place among them; how many are single words."""

    ends: dict[int, np.ndarray]
    found: np.ndarray
    count: np.ndarray
    place: np.ndarray
    single: int

    def mark(self) -> int:
        return int(np.bitwise_xor.reduce(mix(self.found), initial=np.uint64(len(self.found))).astype(np.int64))

    def of_words(self, answers: np.ndarray, size: int) -> dict[int, np.ndarray]:
        """For each length, each word's number of occurrences of the string ending there; 0 where none was asked for."""
        out, at = {}, 0
        for k, ends in self.ends.items():
            out[k] = np.zeros(size, np.int64)
            out[k][ends] = answers[self.place[at : at + len(ends)]]
            at += len(ends)
        return out


def strings(s: np.ndarray, ends: dict[int, np.ndarray], bits: int) -> Strings:
    """Strings of two words or more; hashes have the given number of bits."""
    own = np.concatenate([hashes(s[t + 1], s[t + 1 - k], k) >> np.uint64(64 - bits) for k, t in ends.items()])
    place, first, count = _grouped(own)
    return Strings(ends, own[first], count, place, 0)


def _first(part: Part, s: np.ndarray, bits: int) -> Strings:
    """Strings of one and two words."""
    words, _, count = _grouped(mix(part.vocabulary + _LENGTH) >> np.uint64(64 - bits))  # of the vocabulary
    found = np.empty(len(count), np.uint64)
    found[words] = mix(part.vocabulary + _LENGTH) >> np.uint64(64 - bits)
    pairs = strings(s, {2: np.flatnonzero(part.inside() >= 2)}, bits)
    place = words[part.local]
    ends = {1: np.arange(len(part.local))} | pairs.ends
    return Strings(ends, np.append(found, pairs.found), np.append(np.bincount(place, minlength=len(found)), pairs.count), np.append(place, pairs.place + len(found)), len(found))


def _second(part: Part, s: np.ndarray, twice: np.ndarray, bits: int) -> Strings:
    """Strings of 3 .. DIRECT words that end where one of two words has another occurrence."""
    inside = part.inside()
    return strings(s, {k: np.flatnonzero(twice & (inside >= k)) for k in range(3, DIRECT + 1)}, bits)


def _twice(part: Part, s: np.ndarray, folder: str, bits: int) -> tuple[dict[int, np.ndarray], np.ndarray]:
    first = _first(part, s, bits)
    times = first.of_words(_answers(folder, part.number, first.mark(), len(first.found)), len(part.local))
    return times, times[2] > 1


def _count_rows(bits: int, ranges: int, before: str | None):
    """Each part's distinct strings, by range of hashes; before: the folder of the first answers, where these are the second questions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _each(batches):
            s = sums(part.vocabulary[part.local])
            own = _first(part, s, bits) if before is None else _second(part, s, _twice(part, s, before, bits)[1], bits)
            rows = []
            for kind, begin, found, wide in ((0, 0, own.found[: own.single], max(0, ranges - 4)), (_OTHERS, own.single, own.found[own.single :], ranges)):
                cuts = np.searchsorted(found, np.arange((1 << wide) + 1, dtype=np.uint64) << np.uint64(bits - wide))
                for k in range(1 << wide):
                    if cuts[k + 1] > cuts[k]:
                        step = np.diff(found[cuts[k] : cuts[k + 1]], prepend=np.uint64(0))
                        rows.append((kind + k, _join([*_planes(step, 8), *_planes(own.count[begin + cuts[k] : begin + cuts[k + 1]])])))
            if rows:
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([part.number] * n, pa.int64()), pa.array([own.mark()] * n, pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                    ["range", "part", "mark", "block"],
                )

    return run


def _add_up(table: pa.Table) -> pa.Table:
    """Of a range of hashes: each part's numbers of occurrences in all parts, in the order of its hashes; distinct, in one row: how many single words there are."""
    found, counts = [], []
    for block in table.column("block").to_pylist():
        fields = _split(block, 12)
        found.append(np.cumsum(_values(fields[:8]), dtype=np.uint64))
        counts.append(_values(fields[8:]).astype(np.int64))
    place, first, _ = _grouped(np.concatenate(found))
    total = np.bincount(place, np.concatenate(counts), len(first)).astype(np.int64)[place]
    blocks = [_join(_planes(own, 6)) for own in np.split(total, np.cumsum([len(f) for f in found])[:-1])]
    single = table.column("range")[0].as_py() < _OTHERS
    distinct = np.append(len(first) if single else 0, np.zeros(len(blocks) - 1, np.int64))
    return pa.table({"part": table.column("part"), "range": table.column("range"), "mark": table.column("mark"), "block": pa.array(blocks, pa.binary()), "distinct": pa.array(distinct, pa.int64())})


def _rows_of(folder: str, number: int, together: int, order: str) -> pa.Table:
    """A part's rows in a folder that is partitioned by bucket."""
    fs, path = filesystem(f"{folder}/bucket={number % together}")
    info = fs.get_file_info(pyarrow.fs.FileSelector(path, allow_not_found=True))
    tables = [pq.read_table(f.path, filesystem=fs, filters=[("part", "=", number)], partitioning=None) for f in info if f.base_name.endswith(".parquet")]
    return pa.concat_tables(tables).sort_by(order) if tables else pa.table({"block": pa.array([], pa.binary()), "mark": pa.array([], pa.int64())})


def _answers(folder: str, number: int, mark: int, size: int) -> np.ndarray:
    """How often each of a part's distinct strings occurs in all parts."""
    path, _, together = folder.rpartition("#")
    rows = _rows_of(path, number, int(together), "range")
    out = [_values(_split(block, 6)).astype(np.int64) for block in rows.column("block").to_pylist()]
    out = np.concatenate(out) if out else np.zeros(0, np.int64)
    if len(out) != size or set(rows.column("mark").to_pylist()) - {mark}:
        raise RuntimeError(f"part {number} has {size} strings, but the answers are for {len(out)} or for others")
    return out


def runs(part: Part, deep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words (in order) that end a string of DIRECT words with another occurrence: the words of all runs one after another, each one's place behind which it is in that
    text, and how long a context may be there. A run begins with the DIRECT - 1 words before its first; what goes farther occurs once."""
    fresh = np.append(True, np.diff(deep) > 1)
    of_text = np.repeat(np.arange(len(part.sizes)), part.sizes)[deep]
    fresh[1:] |= of_text[1:] != of_text[:-1]
    run = np.cumsum(fresh) - 1
    begin = deep[fresh] - (DIRECT - 1)
    until = deep[np.append(np.flatnonzero(fresh)[1:] - 1, len(deep) - 1)] + 1
    size = until - begin
    offset = np.cumsum(size) - size
    word = np.arange(size.sum()) - np.repeat(offset - begin, size)
    most = deep - begin[run] + 1
    return word, offset[run] + most, most


def _deep(part: Part, s: np.ndarray, folders: tuple[str, str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each word's occurrences, the longest string's length and number as far as DIRECT words go, the words that go on, and the order in which they do."""
    times, twice = _twice(part, s, folders[0], bits)
    second = _second(part, s, twice, bits)
    times |= second.of_words(_answers(folders[1], part.number, second.mark(), len(second.found)), len(part.local))
    length, number = np.zeros(len(part.local), np.int64), np.zeros(len(part.local), np.int64)
    for k in range(1, DIRECT + 1):
        more = times[k] > 1
        length[more], number[more] = k, times[k][more]
    deep = np.flatnonzero(times[DIRECT] > 1)
    key = hashes(s[deep + 1], s[deep + 1 - DIRECT], DIRECT) >> np.uint64(64 - bits)
    return times[1], length, number, deep, key


def _shard_of(key: np.ndarray, bits: int, shards: int) -> np.ndarray:
    return ((key >> np.uint64(max(0, bits - 32))) * np.uint64(shards) >> np.uint64(min(bits, 32))).astype(np.int64)


def _entry_rows(bits: int, shards: int, folders: tuple[str, str], files: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = filesystem(files)
        fs.create_dir(path)
        name, base = uuid.uuid4().hex, 0  # another name for each attempt: the rows say which file they mean
        with fs.open_output_stream(f"{path}/{name}") as out:
            for part in _each(batches):
                words = part.vocabulary[part.local]
                s = sums(words)
                *_, deep, key = _deep(part, s, folders, bits)
                if not len(deep):
                    continue
                word, at, most = runs(part, deep)
                own = sums(words[word])
                out.write(own.data)
                order = np.argsort(key, kind="stable")
                key, at, most = key[order], at[order], most[order]
                shard = _shard_of(key, bits, shards)
                edge = np.append(np.flatnonzero(np.append(True, np.diff(shard) > 0)), len(shard))
                blocks = [_join([*_planes(np.diff(key[a:b], prepend=np.uint64(0)), 8), *_planes(at[a:b]), *_planes(most[a:b])]) for a, b in zip(edge, edge[1:])]
                n = len(blocks)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard[edge[:-1]], pa.int32()), pa.array([part.number] * n, pa.int64()), pa.array([name] * n), pa.array([base] * n, pa.int64()), pa.array(blocks, pa.binary())],
                    ["shard", "part", "file", "base", "block"],
                )
                base += len(own)
                release()

    return run


class Sums:
    """Reads of single values from files of sums: mapped into memory where the file system allows it, else by blocks."""

    def __init__(self, folder: str, names: list[str], mapped: bool | None = None):
        self.fs, path = filesystem(folder)
        mapped = isinstance(self.fs, pyarrow.fs.LocalFileSystem) if mapped is None else mapped
        self.files = [np.memmap(f"{path}/{name}", np.uint64, "r") if mapped else f"{path}/{name}" for name in names]
        self.blocks: dict[tuple[int, int], np.ndarray] = {}

    def _blockwise(self, file: int, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), np.uint64)
        block = at // BLOCK
        with self.fs.open_input_file(self.files[file]) as source:
            for k in np.unique(block).tolist():
                if (file, k) not in self.blocks:
                    while len(self.blocks) >= BLOCKS_KEPT:
                        del self.blocks[next(iter(self.blocks))]
                    self.blocks[file, k] = np.frombuffer(source.read_at(min(BLOCK * 8, source.size() - k * BLOCK * 8), k * BLOCK * 8), np.uint64)
                own = block == k
                out[own] = self.blocks[file, k][at[own] - k * BLOCK]
        return out

    def __call__(self, file: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), np.uint64)
        order = None if (file[1:] >= file[:-1]).all() else np.argsort(file.astype(np.int64) << 40 | at)
        cuts = np.searchsorted(file if order is None else file[order], np.arange(len(self.files) + 1))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if b > a:
                own = slice(a, b) if order is None else order[a:b]
                out[own] = self.files[k][at[own]] if not isinstance(self.files[k], str) else self._blockwise(k, at[own])
        return out


def search(read, key: np.ndarray, file: np.ndarray, at: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix of a shard the longest context, of at least DIRECT and at most most words, that another has too; and how many have it, the suffix itself included.

    key: the hash of the last DIRECT words; read(file, at): sums.
    """
    here = read(file, at)
    longest, times = np.full(len(key), DIRECT, np.int64), np.ones(len(key), np.int64)
    entry, group, level = np.arange(len(key)), _grouped(key)[0], DIRECT

    def parted(of: np.ndarray, group: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The array's intervals of a greater length within those there are: number, size and a first suffix; a suffix that isn't that long is alone."""
        can = np.flatnonzero(most[of] >= length)
        name = mix(hashes(here[of[can]], read(file[of[can]], at[of[can]] - length[can]), length[can]) + group[can].astype(np.uint64) * _GROUP)
        inside, first, count = _grouped(name)
        number = np.empty(len(of), np.int64)
        number[can] = inside
        alone = np.flatnonzero(most[of] < length)
        number[alone] = np.arange(len(count), len(count) + len(alone))
        return number, np.append(count, np.ones(len(alone), np.int64)), np.append(can[first], alone)

    work: list[tuple[np.ndarray, ...]] = []
    groups = 0
    while len(entry):
        number, size, first = parted(entry, group, np.full(len(entry), 2 * level))
        one = size == 1
        needed = np.bincount(group[first], one) > 0  # an interval with a suffix that ends here
        own = needed[group[first]]
        if own.any():
            of = first[own]
            work.append((entry[of], size[own], one[own], group[of] + groups, np.full(len(of), level), np.full(len(of), 2 * level)))
            groups += int(group.max()) + 1
        more = ~one[number]
        entry, group, level = entry[more], _grouped(number[more])[0], 2 * level
    if not work:
        return longest, times
    # one suffix for each interval of the greater length: how many it stands for, whether its own context is looked for, and between which lengths
    of, weight, wanted, group, low, high = (np.concatenate(x) for x in zip(*work))
    while len(of):
        end = high - low == 1
        if end.any():
            total = np.bincount(group[end], weight[end])
            own = end & wanted
            longest[of[own]], times[of[own]] = low[own], total[group[own]]
            of, weight, wanted, group, low, high = (x[~end] for x in (of, weight, wanted, group, low, high))
            if not len(of):
                break
        middle = (low + high) // 2
        number, size, first = parted(of, group, middle)
        deeper = ((size > 1) & (np.bincount(number, wanted) > 0))[number]
        still = wanted[first] & (size == 1)
        own = (np.bincount(group[first], still) > 0)[group[first]]
        kept, total = first[own], np.bincount(number, weight).astype(np.int64)[own]
        of, weight, wanted, low, high, group = (
            np.append(of[deeper], of[kept]), np.append(weight[deeper], total), np.append(wanted[deeper], still[own]), np.append(middle[deeper], low[kept]), np.append(high[deeper], middle[kept]),
            _grouped(np.append(number[deeper], group[kept] + len(size)))[0],
        )
    return longest, times


def _search_shard(files: str):
    def run(table: pa.Table) -> pa.Table:
        by_file = np.argsort(table.column("file").to_numpy(zero_copy_only=False).astype(str), kind="stable")
        table = table.take(pa.array(by_file))
        names = sorted(set(table.column("file").to_pylist()))
        number_of = {name: k for k, name in enumerate(names)}
        keys, file, place, most = [], [], [], []
        for name, base, block in zip(*(table.column(c).to_pylist() for c in ("file", "base", "block"))):
            fields = _split(block, 16)
            keys.append(np.cumsum(_values(fields[:8]), dtype=np.uint64))
            place.append(_values(fields[8:12]).astype(np.int64) + base)
            most.append(_values(fields[12:16]).astype(np.int32))
            file.append(np.full(len(most[-1]), number_of[name], np.int32))
        cuts = np.cumsum([len(m) for m in most])[:-1]
        longest, times = search(Sums(files, names), *(np.concatenate(x) for x in (keys, file, place, most)))
        blocks = [_join([*_planes(a), *_planes(b, 6)]) for a, b in zip(np.split(longest, cuts), np.split(times, cuts))]
        del keys, file, place, most, longest, times
        release()
        return pa.table({"part": table.column("part"), "shard": table.column("shard"), "block": pa.array(blocks, pa.binary())})

    return run


def probabilities(length: np.ndarray, number: np.ndarray, first: np.ndarray, count: np.ndarray, size: float) -> np.ndarray:
    """Of each word of some texts, one after another: from the longest string that ends there and its occurrences, whether the word
    begins a text, and how often it occurs; size: words of all texts but this one, and of the vocabulary."""
    frequency = count / size
    before, others = np.append(0, length[:-1]), np.maximum(np.append(1, number[:-1]), 1) - 1
    same = np.where(length == before + 1, number - 1, 0)
    return np.where(first | (before == 0), frequency, (same + SMOOTHING * frequency) / (others + SMOOTHING))


def _score_rows(bits: int, folders: tuple[str, str], found: str, size: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, _, together = found.rpartition("#")
        for part in _each(batches):
            count, length, number, deep, key = _deep(part, sums(part.vocabulary[part.local]), folders, bits)
            order = np.argsort(key, kind="stable")
            blocks = [_split(b, 10) for b in _rows_of(path, part.number, int(together), "shard").column("block").to_pylist()] if len(deep) else []
            if sum(len(b[0]) for b in blocks) != len(deep):
                raise RuntimeError(f"part {part.number} sent {len(deep)} words to the shards, but not so many came back")
            if blocks:
                length[deep[order]] = np.concatenate([_values(b[:4]) for b in blocks])
                number[deep[order]] = np.concatenate([_values(b[4:]) for b in blocks])
            first = part.inside() == 1
            text = np.repeat(np.arange(len(part.ids)), part.sizes)
            bits_of = -np.log2(probabilities(length, number, first, count, size))
            used = np.where(first, 0, np.append(0, length[:-1])[: len(length)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.ids, pa.int64()), pa.array(part.sizes, pa.int64()), pa.array(np.bincount(text, bits_of, len(part.ids))), pa.array(np.bincount(text, used, len(part.ids)).astype(np.int64))],
                ["doc_id", "words", "bits", "context"],
            )

    return run


def _by_part(df: DataFrame, parts: int, name: str) -> str:
    """Writes rows by part; the folder, and after # the number of buckets."""
    buckets = max(1, -(-parts // TOGETHER))
    path = new_path(df.sparkSession, name)
    df.withColumn("bucket", F.pmod("part", F.lit(buckets)).cast("int")).repartition("bucket").sortWithinPartitions("bucket", "part").write.partitionBy("bucket").parquet(path)
    return f"{path}#{buckets}"


def scores(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, bits_per_word, mean_context): cross-entropy of each document under all the others and the rest of itself.

    Words are runs of letters and digits, ASCII case aside. A word's context is the longest string of words before it, back
    to the beginning of its text at most, that occurs elsewhere in the corpus, a text's end being one of the things that may follow it; mean_context is the mean
    number of words in the contexts used, 0 for a text's first word and after a word that occurs once. Texts are read whole, very
    long ones as parts of their own. A document without words, or with a null text, has null scores. Rows that repeat a doc_id
    are one document; their texts count each. Rows without doc_id are left out. Order and ties play no part. Other columns, whatever their names, are ignored; an
    empty table gives no rows.
    """
    spark = docs.sparkSession
    parts, path = stored(plain(docs).where("doc_id IS NOT NULL").mapInArrow(_part_rows, PARTS), "parts")
    n, number = parts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    shards = max(1, -(-n // SHARD_WORDS))
    bits = min(64, n.bit_length() + 1 + SPARE)
    ranges = shards.bit_length()
    first = _by_part(parts.mapInArrow(_count_rows(bits, ranges, None), COUNTS).groupBy("range").applyInArrow(_add_up, ANSWERS), number, "short-strings")
    distinct = spark.read.schema("distinct long").parquet(first.rpartition("#")[0]).agg(F.sum("distinct")).first()[0] or 0
    collect_garbage(spark)  # so that the shuffled files go
    second = _by_part(parts.mapInArrow(_count_rows(bits, ranges, first), COUNTS).groupBy("range").applyInArrow(_add_up, ANSWERS), number, "strings")
    collect_garbage(spark)
    files = new_path(spark, "sums")
    entries = parts.mapInArrow(_entry_rows(bits, shards, (first, second), files), ENTRIES)
    found = _by_part(entries.groupBy("shard").applyInArrow(_search_shard(files), FOUND), number, "contexts")
    collect_garbage(spark)
    delete_path(spark, files)
    sums_of = parts.mapInArrow(_score_rows(bits, (first, second), found, max(1, n - 1 + distinct)), "doc_id long, words long, bits double, context long")
    totals = written(sums_of.groupBy("doc_id").agg(F.sum("words").alias("n_words"), F.sum("bits").alias("bits"), F.sum("context").alias("context")), "lm-scores")
    for used in (path, first, second, found):
        delete_path(spark, used.rpartition("#")[0] or used)
    per_word = lambda c: F.when(F.col("n_words") > 0, F.col(c) / F.col("n_words"))
    return totals.select("doc_id", "n_words", per_word("bits").alias("bits_per_word"), per_word("context").alias("mean_context"))
