"""7. Secret scan: guess costs of values in credential contexts.

A value next to a credential's name is cut into words, dates, repeats, sequences, keyboard walks and
brute-force spans, so that the product of what each takes to guess is least: a shortest path over
the places in the value. What takes few guesses is a placeholder, what takes many a secret.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import plain

#: Its letter tokens, in the order of their ids, are the ranked word list.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: log10 of the guesses from which a value counts as a secret.
THRESHOLD = 8.0
#: log10 of the guesses that each further part costs, for the way in which the parts are put together.
JOINT = 0.3
NAME = r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key|client[_-]?key)"
#: Between a credential's name and other words: a separator, or a case change as in dbPassword, DBPassword and secretKey.
JOINED = r"(?:[_-]|(?-i:(?<=[^\W_A-Z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])))"
CONTEXT = re.compile(rf"""(?i)(?<![^\W_])(?P<name>(?:[\w-]{{0,64}}{JOINED})?{NAME}(?:{JOINED}[\w-]{{0,64}})?)["']?\s*(?:=>|:=|=|:)\s*(?:"(?P<a>[^"\n]+)"|'(?P<b>[^'\n]+)'|(?P<c>[^\s"',;]+))""")

SCHEMA = "doc_id long, name string, value_start int, value_end int, guesses_log10 double, is_secret boolean"

_COMMON = "password 123456 qwerty letmein admin welcome monkey dragon master login abc123 iloveyou changeme secret default example placeholder yourpassword test guest root user none null xxxxx todo".split()
_LEET = str.maketrans("4@8310!$57", "aabeloisst")
_ROWS = ("`1234567890-=", " qwertyuiop[]\\", " asdfghjkl;'", " zxcvbnm,./")
_SHIFTED = str.maketrans('~!@#$%^&*()_+{}|:"<>?', "`1234567890-=[]\\;',./")


def _neighbours() -> dict[str, set[str]]:
    at = {c: (r, k) for r, row in enumerate(_ROWS) for k, c in enumerate(row) if c != " "}
    near = ((0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1))
    back = {v: k for k, v in at.items()}
    return {c: {back[r + a, k + b] for a, b in near if (r + a, k + b) in back} for c, (r, k) in at.items()}


_NEAR = _neighbours()
_DATE = re.compile(r"(?:19|20)\d\d(?:([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:(?:19|20)\d\d|\d\d)")
def words(content: bytes | None = None) -> dict[str, int]:
    """Words and their ranks, from 1; content: of the vocabulary file."""
    ranked = {w: k for k, w in enumerate(_COMMON, 1)}
    if content is None:
        with open(VOCABULARY, "rb") as file:
            content = file.read()
    for line in content.splitlines():
        word = base64.b64decode(line.split()[0]).strip().decode("utf-8", "replace").lower()
        if len(word) >= 3 and word.isalpha():
            ranked.setdefault(word, len(ranked) + 1)
    return ranked


def _alphabet(text: str) -> int:
    kinds = ((str.isdigit, 10), (str.islower, 26), (str.isupper, 26))
    size = sum(n for test, n in kinds if any(map(test, text)))
    return size + 33 * any(not c.isalnum() for c in text) or 100


def parts(value: str, ranked: dict[str, int], longest: int) -> Iterator[tuple[int, int, float]]:
    """(begin, end, log10 of guesses) of all words, dates, repeats, sequences and keyboard walks in value."""
    lower = value.lower()
    plain_text = lower.translate(_LEET)
    n = len(value)
    for i in range(n):
        for j in range(i + 3, min(n, i + longest) + 1):
            word, other = lower[i:j], plain_text[i:j]
            rank = ranked.get(word)
            cost = math.log10(rank) if rank else math.inf
            if other != word and (rank := ranked.get(other)):
                cost = min(cost, math.log10(rank * 2.0))
            if cost < math.inf:
                upper = sum(map(str.isupper, value[i:j]))
                yield i, j, cost + (0.3 if upper in (1, j - i) else 0.3 * upper)
        if match := _DATE.match(value, i):
            yield i, match.end(), 2.2 if match.end() - i == 4 else 4.4
    for step in (1, -1):  # sequences: neighbours in the code, as in abc or 321
        i = 0
        while i < n - 1:
            j = i + 1
            while j < n and ord(value[j]) - ord(value[j - 1]) == step and value[j].isalnum():
                j += 1
            if j - i >= 3:
                yield i, j, math.log10((4.0 if value[i] in "aA1zZ09" else 26.0) * (j - i) * (2 if step < 0 else 1))
            i = max(j - 1, i + 1)
    i = 0
    flat = lower.translate(_SHIFTED)
    while i < n - 1:
        j, turns, way = i + 1, 0, None
        while j < n and flat[j] in _NEAR.get(flat[j - 1], ()):
            here = (ord(flat[j]) - ord(flat[j - 1]), flat[j] in _ROWS[0] + _ROWS[1])
            turns, way, j = turns + (here != way), here, j + 1
        if j - i >= 4:
            yield i, j, math.log10(len(_NEAR)) + min(turns, 3) * math.log10(4.6) + math.log10(j - i)
        i = max(j - 1, i + 1)
    for i, j, size in repeats(value):
        unit = value[i : i + size]
        inner = math.log10(_alphabet(unit)) if size == 1 else guesses(unit, ranked, longest)
        yield i, j, inner + math.log10((j - i) // size)


def repeats(value: str) -> list[tuple[int, int, int]]:
    """(begin, end, size of the unit) of what repeats a unit, of any size, twice or more, in three characters or more: whole units from where each longest such stretch begins."""
    codes, out, seen = np.frombuffer(value.encode("utf-32-le", "surrogatepass"), np.uint32), [], set()
    for size in range(1, len(codes) // 2 + 1):
        same = codes[size:] == codes[:-size]
        if np.count_nonzero(same) < size:
            continue
        edge = np.flatnonzero(np.diff(np.concatenate([[0], same.astype(np.int8), [0]])))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):  # value[a : b] is equal to what stands size places on
            if b - a >= size and b - a + size >= 3 and (a, b + size) not in seen:
                seen.add((a, b + size))  # not again for multiples of the unit
                out.append((a, a + (b - a + size) // size * size, size))
    return out


def guesses(value: str, ranked: dict[str, int], longest: int) -> float:
    """log10 of the guesses that the cheapest segmentation takes; a brute-force character takes ten."""
    by_end: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost in parts(value, ranked, longest):
        by_end.setdefault(j, []).append((i, cost))
    least, brute = [0.0], [math.inf]  # up to each place: at all, and with a brute-force span last
    for j in range(1, len(value) + 1):
        joint = JOINT if j > 1 else 0.0
        brute.append(min(brute[-1], least[-1] + joint) + 1.0)
        least.append(min([brute[-1], *(least[i] + cost + (JOINT if i else 0.0) for i, cost in by_end.get(j, ()))]))
    return least[-1]


def find(text: str, ranked: dict[str, int], longest: int) -> Iterator[tuple[str, int, int, float]]:
    """(name, begin, end, log10 of guesses) of the values in credential contexts."""
    for match in CONTEXT.finditer(text):
        group = next(g for g in "abc" if match[g])
        yield match["name"], match.start(group), match.end(group), guesses(match[group], ranked, longest)


def scan(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """One row for each value next to a credential's name: where it is (in characters), its guesses, whether it's a secret.

    The JVM passes on only texts that hold a name; no shuffle. Texts are scanned whole, very long ones too. Null and empty
    texts give no rows; a null doc_id stays null; repeated rows give repeated rows; of several cheapest segmentations the cost is one; guesses that
    equal the threshold make a secret; other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    with open(path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(file.read())  # about 1 MB at any size of the input: only the driver has to have it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranked = words(shared.value)
        longest = max(map(len, ranked))
        for batch in batches:
            rows = [
                (doc, name, a, b, cost, cost >= THRESHOLD)
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
                for name, a, b, cost in find(text, ranked, longest)
            ]
            if rows:
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

    return plain(docs).where(F.col("text").rlike(f"(?i){NAME}")).mapInArrow(run, SCHEMA)
