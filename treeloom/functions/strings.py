"""String helpers as column expressions."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def iequals(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def split(text: Column, sep: str, compress: bool = False) -> Column:
    """Parts between separators (a literal, not a pattern); compress leaves out empty parts."""
    parts = F.split(text, re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", sep))
    return F.filter(parts, lambda x: x != "") if compress else parts


def join(parts: Column, sep: str) -> Column:
    return F.array_join(parts, sep)


def replace_all(text: Column, what: str, by: str) -> Column:
    return F.replace(text, F.lit(what), F.lit(by))


def trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def is_space(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"^\s*$"))


def normalize_lines(text: Column, version: str = "1.0") -> Column:
    """Line ends as line feeds; in version 1.1, the next-line and line-separator characters too."""
    return F.regexp_replace(text, "\r\n?" if version == "1.0" else "\r[\n\x85]?|[\x85\u2028]", "\n")


def first_character(text: Column) -> Column:
    """The first character, by code points; null of an empty text."""
    return F.nullif(F.left(text, F.lit(1)), F.lit(""))


def without_last(text: Column) -> Column:
    """The text without its last character."""
    return F.left(text, F.length(text) - 1)


def append_code_point(text: Column, code: Column) -> Column:
    """The text and the character of a code point; null where there is no such character."""
    legal = code.between(0, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    wide = F.unhex(F.lpad(F.hex(F.when(legal, code).cast("long")), 8, F.lit("0")))
    return F.concat(text, F.decode(wide, "UTF-32"))


def to_hex(number: Column) -> Column:
    """A number that is not negative in lower-case hexadecimal digits."""
    return F.lower(F.hex(number))


def as_text(data: Column) -> Column:
    """Text of bytes in UTF-8; null where they are not."""
    return F.try_validate_utf8(data.cast("string"))


def _wide(data: Column, order: str) -> Column:
    """Text of bytes in UTF-16 of a byte order, null where they are not: Spark's own decoder ends the query there."""

    @F.arrow_udf("string")
    def run(raw: pa.Array) -> pa.Array:
        def one(x: bytes | None) -> str | None:
            try:
                return None if x is None else x.decode(order)
            except UnicodeDecodeError:
                return None

        return pa.array([one(x) for x in raw.to_pylist()], pa.string())

    return run(data)


def decode_by_mark(data: Column) -> Column:
    """Text of bytes by their byte order mark; UTF-8 without one. Null where the bytes are malformed."""
    little, big = F.hex(F.substring(data, 1, 2)) == "FFFE", F.hex(F.substring(data, 1, 2)) == "FEFF"
    rest = F.substring(data, 3, 2**31 - 5)
    return (
        F.when(F.hex(F.substring(data, 1, 3)) == "EFBBBF", as_text(F.substring(data, 4, 2**31 - 5)))
        .when(little, _wide(F.when(little, rest), "utf-16-le"))
        .when(big, _wide(F.when(big, rest), "utf-16-be"))
        .otherwise(as_text(data))
    )


def decode_document(data: Column) -> Column:
    """Text of a document's bytes, by byte order mark or else by the declared encoding (UTF-8, UTF-16, ISO-8859-1, US-ASCII); null where mark and declaration contradict, the encoding is another or the bytes are malformed."""
    start = F.hex(F.substring(data, 1, 3))
    plain = F.decode(data, "ISO-8859-1")
    declared = F.upper(F.regexp_extract(F.left(plain, F.lit(200)), r"^[^<]{0,3}<\?xml[^>]*encoding\s*=\s*[\"']([A-Za-z0-9._-]+)[\"']", 1))
    marked = F.startswith(start, F.lit("EFBBBF")) | F.startswith(start, F.lit("FFFE")) | F.startswith(start, F.lit("FEFF"))
    return (
        F.when(marked & declared.isin("", "UTF-8", "UTF-16"), decode_by_mark(data))
        .when(marked, F.lit(None).cast("string"))
        .when(declared.isin("", "UTF-8"), as_text(data))
        .when(declared.isin("ISO-8859-1", "LATIN1"), plain)
        .when(declared.isin("US-ASCII", "ASCII") & ~F.regexp_like(plain, F.lit("[^\\x00-\\x7F]")), plain)
    )


def is_xml_text(text: Column) -> Column:
    """Whether all characters may stand in a document."""
    return ~F.regexp_like(text, F.lit("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\uFFFE\\uFFFF]"))


def escape_xml(text: Column, attribute: bool = False) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"),) if attribute else ())):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def is_name(text: Column) -> Column:
    """An XML name: letters, digits, '_', ':', '-', '.', not beginning with the latter two or a digit."""
    return F.regexp_like(text, F.lit(r"^[:_\p{L}][-.:_\p{L}\p{M}\p{N}\x{B7}]*$"))
