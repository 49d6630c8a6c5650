"""1. Repetition coverage: characters inside duplicated n-grams and lines.

Every text is scanned whole. Words are runs of bytes other than ASCII white
space; word hashes come from one pass of prefix sums and n-gram hashes roll over
them. A window of n words counts as duplicated if it occurs twice or more in its
text; as a duplicated n-gram begins with a duplicated shorter one, each length
only looks at the windows whose shorter window was duplicated.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SPACE, chars_before, in_arrow, mix, plain, powers, span_hashes, spans, text_bytes

#: Share of a text's word characters that duplicated n-grams may cover, for each length n.
NGRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Share of lines, and of characters of lines, that may belong to lines occurring twice or more in the text.
LINE_LIMIT, LINE_CHAR_LIMIT = 0.30, 0.20

SCHEMA = (
    "doc_id long, n_words long, n_lines long, dup_line_frac double, dup_line_char_frac double, "
    + ", ".join(f"dup_{n}gram_char_frac double" for n in NGRAM_LIMITS)
    + ", keep boolean"
)


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return np.divide(part, whole, out=np.zeros(len(whole)), where=whole > 0)


def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
    data, offsets = text_bytes(batch.column("text"))
    n = len(batch)
    before = chars_before(data)
    of_text = mix(np.arange(1, n + 1, dtype=np.uint64))

    starts, ends, doc = spans(~SPACE[data], offsets)
    size = before[ends] - before[starts]
    total = np.bincount(doc, size, n)
    words = np.bincount(doc, minlength=n)
    values = span_hashes(data, starts, ends)
    last = np.searchsorted(doc, np.arange(n), "right")[doc] if len(doc) else doc
    alive, rolled, covered = np.arange(len(values)), None, {}
    step = powers(2)[1]
    for length in range(1, max(NGRAM_LIMITS) + 1):
        alive_now = alive + length <= last[alive]
        alive = alive[alive_now]
        rolled = values[alive] if rolled is None else rolled[alive_now] * step + values[alive + length - 1]
        if length >= min(NGRAM_LIMITS):
            again = _repeated(mix(rolled) ^ of_text[doc[alive]])
            alive, rolled = alive[again], rolled[again]
            edge = np.bincount(alive, minlength=len(values) + 1) - np.bincount(alive + length, minlength=len(values) + 1)
            inside = np.cumsum(edge)[: len(values)] > 0
            covered[length] = _share(np.bincount(doc[inside], size[inside], n), total)

    # lines: between line feeds, without white space at either end
    line_starts, line_ends, line_doc = spans(data != 10, offsets)
    first = np.searchsorted(starts, line_starts)
    final = np.searchsorted(ends, line_ends, "right") - 1
    there = final >= first
    line_doc, a, b = line_doc[there], starts[first[there]], ends[final[there]]
    lines, line_size = np.bincount(line_doc, minlength=n), before[b] - before[a]
    twice = _repeated(span_hashes(data, a, b) ^ of_text[line_doc])
    line_share = _share(np.bincount(line_doc[twice], minlength=n).astype(float), lines)
    char_share = _share(np.bincount(line_doc[twice], line_size[twice], n), np.bincount(line_doc, line_size, n))

    keep = (words > 0) & (line_share <= LINE_LIMIT) & (char_share <= LINE_CHAR_LIMIT)
    for length, limit in NGRAM_LIMITS.items():
        keep &= covered[length] <= limit
    columns = [batch.column("doc_id"), pa.array(words, pa.int64()), pa.array(lines, pa.int64()), pa.array(line_share), pa.array(char_share)]
    columns += [pa.array(covered[length]) for length in NGRAM_LIMITS] + [pa.array(keep)]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in SCHEMA.split(", ")])


def repetition(docs: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text, ...), with its repetition figures and whether it may stay.

    No shuffle. A null, empty or blank text has no words, figures of 0 and keep = false; a null doc_id
    stays null; repeated rows give repeated rows; other columns, whatever their names, are ignored; an empty table gives no rows.
    Very long texts are scanned whole; a share that equals its limit may stay. Characters are code points; those of white space count only inside lines.
    """
    return in_arrow(plain(docs), measure, SCHEMA)


def sql() -> str:
    """The same in DuckDB's SQL, with n-grams as strings."""
    grams = "\n".join(
        f""", g{n} AS (SELECT rid, i, array_to_string(ws[i:i + {n - 1}], ' ') AS gram FROM docs, unnest(range(1, len(ws) - {n} + 2)) AS t(i)),
        d{n} AS (SELECT rid, i FROM g{n} QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1),
        c{n} AS (SELECT w.rid, sum(w.size) AS size FROM w WHERE EXISTS (SELECT 1 FROM d{n} d WHERE d.rid = w.rid AND d.i BETWEEN w.i - {n - 1} AND w.i) GROUP BY w.rid)"""
        for n in NGRAM_LIMITS
    )
    share = {n: f"CASE WHEN s.size > 0 THEN coalesce(c{n}.size, 0)::DOUBLE / s.size ELSE 0.0 END" for n in NGRAM_LIMITS}
    line_share = "CASE WHEN l.n > 0 THEN l.dup::DOUBLE / l.n ELSE 0.0 END"
    char_share = "CASE WHEN l.size > 0 THEN l.dup_size::DOUBLE / l.size ELSE 0.0 END"
    return f"""
    WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
            list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '') AS ws FROM documents),
        w AS (SELECT rid, i, length(ws[i])::BIGINT AS size FROM docs, unnest(range(1, len(ws) + 1)) AS t(i)),
        s AS (SELECT rid, sum(size) AS size, count(*) AS n FROM w GROUP BY rid)
        {grams},
        ls AS (SELECT rid, trim(line, ' ' || chr(9) || chr(13) || chr(12) || chr(11)) AS line FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM docs)),
        lc AS (SELECT rid, length(line)::BIGINT AS size, count(*) OVER (PARTITION BY rid, line) > 1 AS dup FROM ls WHERE line <> ''),
        l AS (SELECT rid, count(*) AS n, count(*) FILTER (WHERE dup) AS dup, sum(size) AS size, coalesce(sum(size) FILTER (WHERE dup), 0) AS dup_size FROM lc GROUP BY rid)
    SELECT doc_id, coalesce(s.n, 0)::BIGINT AS n_words, coalesce(l.n, 0)::BIGINT AS n_lines, {line_share} AS dup_line_frac, {char_share} AS dup_line_char_frac,
        {", ".join(f"{x} AS dup_{n}gram_char_frac" for n, x in share.items())},
        coalesce(s.n, 0) > 0 AND {line_share} <= {LINE_LIMIT} AND {char_share} <= {LINE_CHAR_LIMIT} AND {" AND ".join(f"{x} <= {NGRAM_LIMITS[n]}" for n, x in share.items())} AS keep
    FROM docs LEFT JOIN s USING (rid) LEFT JOIN l USING (rid) {" ".join(f"LEFT JOIN c{n} USING (rid)" for n in NGRAM_LIMITS)}"""
