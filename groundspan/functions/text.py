"""Bytes, characters and spans of texts. Offsets are of UTF-8 bytes, half-open, from 0."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def raw(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def byte_length(text: Column) -> Column:
    return F.octet_length(text)


def is_aligned(text: Column, offset: Column) -> Column:
    """Whether offset is where a code point begins, or the end of the text."""
    byte = F.conv(F.hex(F.substring(raw(text), offset.cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return (offset == byte_length(text)) | F.coalesce(byte.bitwiseAND(192) != 128, F.lit(False))


def slice_bytes(text: Column, start: Column, end: Column) -> Column:
    """The text of a byte span; a span that cuts a code point fails."""
    return F.decode(F.substring(raw(text), start.cast("int") + 1, (end - start).cast("int")), "UTF-8")


def context_bytes(text: Column, start: Column, end: Column, before: int = 160, after: int = 160) -> Column:
    """The bytes around a span; cut code points become U+FFFD."""
    low = F.greatest(start - before, F.lit(0))
    return F.make_valid_utf8(F.substring(raw(text), low.cast("int") + 1, (end + after - low).cast("int")).cast("string"))


def byte_to_char(text: Column, offset: Column) -> Column:
    """Code points before an aligned byte offset."""
    return F.char_length(F.decode(F.substring(raw(text), F.lit(1), offset.cast("int")), "UTF-8"))


def char_to_byte(text: Column, offset: Column) -> Column:
    return F.octet_length(F.substring(text, F.lit(1), offset.cast("int")))


def collapse(text: Column) -> Column:
    """Runs of white space become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+", " "))


def safe_segment(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}\-_.]", "_")


def json_string(text: Column) -> Column:
    """The text as a JSON string with nothing but what must be escaped escaped, lower-case hex."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code in range(32):
        short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}.get(code, f"\\u{code:04x}")
        out = F.replace(out, F.lit(chr(code)), F.lit(short))
    return F.concat(F.lit('"'), out, F.lit('"'))


def json_value(value: Column, kind: str) -> Column:
    """Canonical JSON of a scalar column."""
    shown = json_string(value) if kind == "string" else value.cast("string")
    return F.coalesce(shown, F.lit("null"))


def json_object(fields: dict[str, Column]) -> Column:
    """Canonical JSON of an object whose values are canonical JSON already: sorted keys, no spaces."""
    parts = [F.concat(F.lit(f'{"," if k else ""}"{name}":'), fields[name]) for k, name in enumerate(sorted(fields))]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def json_list(items: list[Column]) -> Column:
    parts = [F.concat(F.lit("," if k else ""), item) for k, item in enumerate(items)]
    return F.concat(F.lit("["), *parts, F.lit("]"))


def stable_hash(canonical: Column) -> Column:
    return F.sha2(raw(canonical), 256)


def content_hash(text: Column) -> Column:
    """The hash of a document: that of its JSON string."""
    return stable_hash(json_string(text))


_MAGNITUDES = {3: ("thousand", "k"), 6: ("million", "mln", "mm", "mn", "m"), 9: ("billion", "bn", "b"), 12: ("trillion", "tn", "t")}
_SIGNS = ("US$", "U.S.$", "$", "€", "£", "¥")
#: Minus, currency, digits (grouped by commas or not) with a fraction, per cent, magnitude; neither a word nor a point may touch it.
_NUMBER = "".join(
    (
        r"(?iU)(?<![\w.])(-?)(?:", "|".join(re.escape(x) for x in _SIGNS), r")?\s*((?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)(%?)",
        r"(?:\s*(", "|".join(w for words in reversed(_MAGNITUDES.values()) for w in sorted(words, key=len, reverse=True)), r"))?(?![\w.])",
    )
)
#: The same of a match alone.
_WHOLE_NUMBER = _NUMBER.replace(r"(?<![\w.])", r"\A").replace(r"(?![\w.])", r"\z")


def decimal_value(text: Column) -> Column:
    """The one number in a text, with currency, groups, per cent (not scaled) or magnitude; null if there is none, or several, or one with both."""
    # lambdas bind what was found, so that the text is searched once; the one match then splits, to its end, as it did when found
    only = F.filter(F.array(F.regexp_extract_all(text, F.lit(_NUMBER), F.lit(0))), lambda found: F.size(found) == 1)
    parts = F.transform(only, lambda found: F.split(F.regexp_replace(found[0], _WHOLE_NUMBER, "$1$2\n$3\n$4"), "\n", -1))
    return F.get(F.transform(parts, _decimal), F.lit(0))


def _decimal(parts: Column) -> Column:
    """The value of a match: number, per cent sign, magnitude."""
    word = F.lower(parts[2])
    factor = reduce(lambda acc, e: F.when(word.isin(*e[1]), F.lit(10 ** e[0])).otherwise(acc), _MAGNITUDES.items(), F.lit(1))
    number = F.replace(parts[0], F.lit(","), F.lit("")).try_cast("decimal(24,10)")
    value = (number * factor.cast("decimal(13,0)")).cast("decimal(38,10)")
    return F.when(~((parts[1] == "%") & (parts[2] != "")), value)


def decimal_hint(value: Column) -> Column:
    """A decimal as a plain string without trailing zeros."""
    shown = value.cast("string")
    return F.when(shown.contains("."), F.regexp_replace(F.regexp_replace(shown, "0+$", ""), r"\.$", "")).otherwise(shown)


def overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Half-open overlap; two equal points overlap, a point and anything else don't."""
    point = (a_start == a_end) & (b_start == b_end) & (a_start == b_start)
    return ((a_start < b_end) & (b_start < a_end) & (a_start < a_end) & (b_start < b_end)) | point


def gap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(b_start - a_end, a_start - b_end, F.lit(0))


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Intersection over the hull."""
    common = F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start), F.lit(0))
    hull = F.greatest(a_end, b_end) - F.least(a_start, b_start)
    return F.when(hull > 0, common / hull).otherwise(0.0)


def lines(text: Column) -> Column:
    """Array of (line, start, end, text): byte bounds of the lines, without line feeds."""
    parts = F.split(text, "\n", -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<line:int,start:int,end:int,text:string>>").alias("out"))
    step = lambda acc, x: F.struct(
        (acc["at"] + F.octet_length(x) + 1).alias("at"),
        F.concat(acc["out"], F.array(F.struct(F.size(acc["out"]).alias("line"), acc["at"].alias("start"), (acc["at"] + F.octet_length(x)).alias("end"), x.alias("text")))).alias("out"),
    )
    return F.aggregate(parts, start, step, lambda acc: acc["out"])


_FOLDS = {chr(k): chr(k).casefold() for k in range(128, 0x10000) if chr(k).casefold() != chr(k).lower()}


def casefold(text: Column) -> Column:
    """Full case folding; texts of ASCII alone, by far the most, take lower case only."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    folds = F.create_map(*(F.lit(x) for pair in _FOLDS.items() for x in pair))
    each = F.transform(F.split(text, ""), lambda c: F.coalesce(F.element_at(folds, c), F.lower(c)))
    return F.when(ascii_only, F.lower(text)).otherwise(F.array_join(each, ""))


def normalized_match_span(start: Column, end: Column) -> Column:
    """A match in a normalized text as a span of that space."""
    return F.struct(F.lit("normalized_text").alias("text_anchor_space"), start.cast("long").alias("byte_start"), end.cast("long").alias("byte_end"))


def is_json(text: Column) -> Column:
    """Whether a text is JSON, nested as it may be; null for a null."""
    return F.when(text.isNotNull(), F.try_parse_json(text).isNotNull())
