"""Documents as views: normalized text and its anchor map, an array of segments from normalized to source bytes."""

from __future__ import annotations

from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import byte_length, content_hash, is_aligned

SOURCE_ID = "document"
SEGMENT = T.StructType().add("norm_start", "long").add("norm_end", "long").add("src_start", "long").add("src_end", "long")
SEGMENTS = T.ArrayType(SEGMENT)


def text_view(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with content_hash, document_id and segments: one segment, the identity; none for an empty text. Markdown is kept as it is."""
    size = byte_length(F.col(text)).cast("long")
    zero = F.lit(0).cast("long")
    one = F.array(F.struct(zero.alias("norm_start"), size.alias("norm_end"), zero.alias("src_start"), size.alias("src_end")))
    hashed = content_hash(F.col(text))
    return docs.withColumns(
        {"content_hash": hashed, "document_id": F.concat(F.lit(SOURCE_ID + "@"), hashed), "segments": F.when(size > 0, one).otherwise(F.array().cast(SEGMENTS))}
    )


def strict_text(docs: DataFrame, content: str = "content") -> DataFrame:
    """Binary content as text; content that isn't UTF-8 fails."""
    return docs.withColumn("text", F.validate_utf8(F.col(content).cast("string")))


class _Linear(HTMLParser):
    """Collects data and references with the source bytes that each came from."""

    def __init__(self, source: str):
        super().__init__(convert_charrefs=False)
        self.source = source
        self.lines = [0]
        for line in source.split("\n"):
            self.lines.append(self.lines[-1] + len(line) + 1)
        self.parts: list[tuple[str, int, int]] = []
        self.feed(source)
        self.close()

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_data(self, data: str) -> None:
        self.parts.append((data, self._at(), self._at() + len(data)))

    def _reference(self, shown: str) -> None:
        at = self._at()
        end = at + len(shown)
        if self.source[end : end + 1] == ";":
            end, shown = end + 1, shown + ";"
        self.parts.append((unescape(shown), at, end))

    def handle_entityref(self, name: str) -> None:
        self._reference("&" + name)

    def handle_charref(self, name: str) -> None:
        self._reference("&#" + name)


def linearize(source: str) -> tuple[str, list[dict[str, int]]]:
    """The text of HTML, script and style bodies included, nothing put between blocks; and its segments."""
    prefix = [0]
    for c in source:
        prefix.append(prefix[-1] + len(c.encode("utf-8", "replace")))
    text, segments, at = [], [], 0
    for shown, start, end in _Linear(source).parts:
        size = len(shown.encode("utf-8", "replace"))
        if size:
            segments.append({"norm_start": at, "norm_end": at + size, "src_start": prefix[start], "src_end": prefix[min(end, len(source))]})
            text.append(shown)
            at += size
    return "".join(text), segments


def html_view(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with text and segments; a null page has nulls."""
    schema = T.StructType(pages.schema.fields + [T.StructField("text", T.StringType()), T.StructField("segments", SEGMENTS)])
    kind = pa.list_(pa.struct([(f.name, pa.int64()) for f in SEGMENT]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views = [(None, None) if x is None else linearize(x) for x in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([v[0] for v in views], pa.string()), pa.array([v[1] for v in views], kind)], schema.names)

    return pages.mapInArrow(run, schema)


def map_violation(segments: Column, text: Column) -> Column:
    """Why the anchor map isn't total: null if it is."""
    at = lambda k: F.get(segments, k)
    n = F.size(segments)
    increasing = F.forall(F.sequence(F.lit(0), n - 2), lambda i: F.get(segments, i)["norm_start"] < F.get(segments, i + 1)["norm_start"])
    aligned = F.forall(segments, lambda s: is_aligned(text, s["norm_start"]))
    return (
        F.when((n == 0) & (byte_length(text) > 0), "empty")
        .when((n > 0) & (at(F.lit(0))["norm_start"] != 0), "first_offset")
        .when((n > 1) & ~increasing, "not_increasing")
        .when(at(n - 1)["norm_start"] >= byte_length(text), "beyond_end")
        .when(~aligned, "not_aligned")
    )


def lookup(segments: Column, offset: Column) -> Column:
    """The source image (start, end) of a normalized offset: a point of an identity segment, else the segment's whole image."""
    s = F.element_at(F.filter(segments, lambda x: x["norm_start"] <= offset), -1)
    same = s["norm_end"] - s["norm_start"] == s["src_end"] - s["src_start"]
    start = F.when(same, s["src_start"] + offset - s["norm_start"]).otherwise(s["src_start"])
    return F.when(F.size(segments) > 0, F.struct(start.alias("start"), F.when(same, start).otherwise(s["src_end"]).alias("end")))


def invert(segments: Column, start: Column, end: Column) -> Column:
    """The normalized range of a source span that lies in one segment, the first such; null if none."""
    s = F.get(F.filter(segments, lambda x: (x["src_start"] <= start) & (x["src_end"] >= end)), F.lit(0))
    return F.when(s.isNotNull(), F.struct((s["norm_start"] + start - s["src_start"]).alias("start"), (s["norm_start"] + end - s["src_start"]).alias("end")))


def span_violation(text: Column, space: Column, start: Column, end: Column) -> Column:
    """The code of what is wrong with a normalized span; null if nothing."""
    size = byte_length(text)
    return (
        F.when(space != "normalized_text", "candidate.text_anchor_space_mismatch")
        .when((start < 0) | (end > size) | (start > end), "candidate.span_out_of_range")
        .when(~is_aligned(text, start) | ~is_aligned(text, end), "candidate.utf8_alignment")
    )
