"""4. Byte-level BPE encoding and decoding.

A text is cut by the vocabulary's public pattern; each distinct piece is encoded once
for each worker. A piece's bytes are read as Latin-1, so that an Aho-Corasick automaton
over all tokens finds the longest token at each place in one pass. Encoding goes from left to
right with the longest token and steps back to shorter ones, or to an earlier place, where two adjacent
tokens couldn't come out of the merges; that test is memoised, and places that lead nowhere are
marked, so that each is visited once and the time is linear. The result is exactly that of
the merges. Decoding looks up each token's bytes in one array.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_batches, release, steps, text_bytes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public pattern of that vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pieces, and pairs of tokens, that a worker remembers in each of two generations; what is used again moves to the younger.
MEMORY = 1 << 17


class Encoder(dict):
    """Maps a piece of text to its token ids, as the bytes of 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.of_id = {i: token for token, i in ranks.items()}
        self.size = {i: len(token) for token, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token) - 1))
        self.automaton.make_automaton()
        self.ranks = ranks
        #: For each token the longest shorter one that begins like it, or -1.
        self.shorter = {i: next((ranks[token[:k]] for k in range(len(token) - 1, 0, -1) if token[:k] in ranks), -1) for token, i in ranks.items()}
        self.split: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            self.split[i] = halves = self._halves(token, i)
            if halves != (i, i):
                self.merged[halves] = i
        self.fits: dict[tuple[int, int], bool] = {}
        self.older: dict[str, bytes] = {}
        count = max(self.of_id) + 1
        lengths = np.zeros(count, np.int64)
        for i, token in self.of_id.items():
            lengths[i] = len(token)
        self.lengths, self.begin = lengths, np.cumsum(lengths) - lengths
        self.bytes = np.frombuffer(b"".join(self.of_id.get(i, b"") for i in range(count)), np.uint8)

    def _halves(self, token: bytes, rank: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one: merging its bytes by all lower ranks leaves two."""
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            best = min((self.ranks.get(a + b, rank), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if best[0] >= rank:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (rank, rank)

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges can leave a and b side by side: no merge across their border comes before those inside them."""
        key, limit, result = (a, b), 1 << 60, None
        while result is None:
            if self.merged.get((a, b), 1 << 60) < limit:
                result = False
            elif a > b:  # undo the later merge: that of a, or of b
                limit, a = a, self.split[a][1]
                if a == limit:
                    limit, b = b + 1, self.split[b][0]
                    result = True if b + 1 == limit else None
            else:
                limit, b = b + 1, self.split[b][0]
                if b + 1 == limit:
                    limit, a = a, self.split[a][1]
                    result = True if a == limit else None
        if len(self.fits) >= 2 * MEMORY:
            self.fits.clear()
        self.fits[key] = result
        return result

    def encode(self, piece: str) -> list[int]:
        raw = piece.encode("utf-8")
        if (whole := self.ranks.get(raw)) is not None:
            return [whole]  # a token's own bytes merge to it
        longest, size, shorter, fits = [-1] * len(raw), self.size, self.shorter, self.fits
        for end, (token, reach) in self.automaton.iter(raw.decode("latin-1")):
            longest[end - reach] = token  # of those that begin at a byte, the longest ends last
        closed: set[int] = set()
        tokens: list[int] = []
        at, token, last = 0, longest[0], -1
        while True:
            while token >= 0:
                if (at + size[token]) not in closed:
                    if last < 0:
                        break
                    fit = fits.get((last, token))
                    if fit or (fit is None and self.compatible(last, token)):
                        break
                token = shorter[token]
            if token >= 0:
                tokens.append(token)
                at += size[token]
                if at == len(raw):
                    return tokens
                last, token = token, longest[at]
            elif last < 0:
                raise ValueError("the vocabulary has no token for a byte")
            else:
                closed.add(at)
                token = tokens.pop()  # go on with its shorter ones
                at -= size[token]
                last = tokens[-1] if tokens else -1

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MEMORY:
            self.older = dict(self)
            self.clear()
        out = self.older.get(piece)
        if out is None:
            out = np.array(self.encode(piece), np.int32).tobytes()
        self[piece] = out
        return out

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all the tokens, as one array."""
        n = self.lengths[ids]
        until = np.cumsum(n)
        return self.bytes[np.arange(until[-1] if len(n) else 0) + np.repeat(self.begin[ids] - until + n, n)]


_encoders: dict[str, Encoder] = {}


def encoder(path: str = VOCABULARY, content: bytes | None = None) -> Encoder:
    """Of the vocabulary file at path, one for each process; content: what it holds, where the file itself isn't at hand."""
    if path not in _encoders:
        if content is None:
            with open(path, "rb") as file:
                content = file.read()
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}
        _encoders[path] = Encoder(ranks)
    return _encoders[path]


def _sent(df: DataFrame, path: str) -> Broadcast[bytes]:
    """The vocabulary file, about 1 MB at any size of the input: only the driver has to have it."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def encode_batch(batch: pa.RecordBatch, own: Encoder, pattern: regex.Pattern) -> list[pa.Array]:
    """Token ids, their number, and whether decoding gives the text again, for each row."""
    column = batch.column("text")
    data, offsets = text_bytes(column)
    texts = [b"".join(map(own.__getitem__, pattern.findall(text))) if text else b"" for text in column.to_pylist()]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts)) // 4
    ids = np.frombuffer(b"".join(texts), np.int32)
    back = own.decode(ids)
    ends = np.concatenate([[0], np.cumsum(own.lengths[ids])])[np.cumsum(sizes)]
    same = np.array([np.array_equal(back[a:b], data[c:d]) for a, b, c, d in zip(np.append(0, ends[:-1]), ends, offsets[:-1], offsets[1:])], bool)
    null = column.is_null().to_numpy(zero_copy_only=False)
    bounds = pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32))
    lists = pa.ListArray.from_arrays(bounds, pa.array(ids, pa.int32()), mask=pa.array(null) if null.any() else None)
    return [lists, pa.array(sizes, pa.int32(), mask=null), pa.array(same, mask=null)]


def encode(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """docs with token_ids, n_tokens and round_trip (decoding gives the same bytes).

    No shuffle. Texts are encoded whole, special tokens' strings as ordinary text. A null text has null
    results, an empty one no tokens; very long texts are encoded whole; repeated rows give repeated rows; of several tokens that the merges allow none is
    chosen, as their result is one; an empty table gives no rows; columns of docs that have the name of a result are replaced by it, others kept.
    """
    new = T.StructType().add("token_ids", T.ArrayType(T.IntegerType())).add("n_tokens", T.IntegerType()).add("round_trip", T.BooleanType())
    kept, shared = docs.drop(*new.names), _sent(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, own = regex.compile(pattern), encoder(path, shared.value)
        for batch in batches:
            for part in steps(batch):
                yield pa.RecordBatch.from_arrays([*part.columns, *encode_batch(part, own, cut)], [*part.schema.names, *new.names])
            release()

    return map_batches(kept, run, new)


def decode(tokens: DataFrame, path: str = VOCABULARY, column: str = "token_ids", out: str = "text") -> DataFrame:
    """tokens with the text of its token ids; a null list has a null text, an empty one an empty text; bytes that aren't UTF-8 become U+FFFD. A column of that name is replaced, others are kept."""
    new, shared = T.StructType().add(out, T.StringType()), _sent(tokens, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path, shared.value)
        for batch in batches:
            texts = [None if ids is None else own.decode(np.array(ids, np.int64)).tobytes().decode("utf-8", "replace") for ids in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, out])

    return map_batches(tokens.drop(out), run, new)
