"""Text functions: whitespace and line classes, normalisation, hashes, words, answer parsers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space, and the line ends (both as in Python's str).
WS = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINES = r"\r\n|[\n\r\x{b}\x{c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"
WORD = r"[\p{L}\p{Nd}]+"


def collapse(text: Column) -> Column:
    """text with each run of white space as one space, trimmed; null stays null."""
    return F.trim(F.regexp_replace(text, WS + "+", " "))


def normalise(*fields: Column, lenient: bool = True) -> Column:
    """The fields collapsed, trimmed and lower-cased, joined by LF. Lenient: a null field counts as empty; else the result is null."""
    parts = [F.lower(collapse(f)) for f in fields]
    return F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts]) if lenient else F.concat(*[x for p in parts for x in (F.lit("\n"), p)][1:])


def sha256(text: Column) -> Column:
    """SHA-256 of the UTF-8 text in hex."""
    return F.sha2(text, 256)


def canonical_lines_hash(text: Column) -> Column:
    """SHA-256 of text with CRLF and CR turned into LF."""
    return sha256(F.regexp_replace(text, "\r\n|\r", "\n"))


def words(text: Column) -> Column:
    """Maximal runs of letters or digits of the lower-cased text, in order; null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def blank(text: Column) -> Column:
    """Whether text is null or holds nothing but white space."""
    return text.isNull() | (collapse(text) == "")
