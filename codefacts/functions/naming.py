"""Names and their styles, as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def upper_snake(name: Column) -> Column:
    """HTTPPort to HTTP_PORT: a border stands before a capital after a small letter or digit, and at an acronym's end."""
    return F.upper(F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1_$2"), "([A-Z])([A-Z][a-z])", "$1_$2"))


def camel(name: Column) -> Column:
    """The first letter small."""
    head, letter, tail = (F.regexp_extract(name, "^([^\\p{L}]*)(\\p{L}?)((?s:.*))$", k) for k in (1, 2, 3))
    return F.concat(head, F.lower(letter), tail)


def pascal(name: Column) -> Column:
    """Parts between underscores begin with a capital, go on in small letters and are joined; leading underscores stay. A name
    of one part only gets its capital."""
    lead, rest = (F.regexp_extract(name, "^(_*)((?s:.*))$", k) for k in (1, 2))
    parts = F.filter(F.split(rest, "_"), lambda p: p != "")
    tail = lambda p: F.substring(p, 2, 1 << 30)
    many = F.contains(rest, F.lit("_"))
    return F.concat(lead, F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.when(many, F.lower(tail(p))).otherwise(tail(p)))), ""))


def breaks_style(name: Column, style: str) -> Column:
    """Whether the first letter has the wrong case for camelCase or PascalCase; names of one letter are exempt."""
    letter = F.regexp_extract(name, "(\\p{L})", 1)
    wrong = letter != (F.lower(letter) if style == "camelCase" else F.upper(letter))
    return F.when(F.regexp_count(name, F.lit("\\p{L}")) <= 1, F.lit(False)).otherwise(wrong)


def last_part(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def squeeze(text: Column, most: int) -> Column:
    """White space runs as one space, cut to `most` characters with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, "\\s+", " "))
    return F.when(F.char_length(flat) > most, F.concat(F.substring(flat, 1, most - 1), F.lit("…"))).otherwise(flat)


def align_up(value: Column, to: Column) -> Column:
    """value raised to a multiple of a power of two; null for other alignments and beyond the range of long."""
    value, to = value.cast("long"), to.cast("long")
    ok = (to > 0) & (to.bitwiseAND(to - 1) == 0)
    return F.when(ok, F.try_add(value, to - 1).bitwiseAND(-to))


def rule_of_comment(tail: Column) -> Column:
    """The rule that a suppression names: what stands before ` -- `, or before a dash if there is none, trimmed; null if empty."""
    before = F.when(F.contains(tail, F.lit(" -- ")), F.substring_index(tail, " -- ", 1)).otherwise(F.substring_index(tail, "—", 1))
    return F.nullif(F.trim(before), F.lit(""))


def line_ending(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\r\n")), F.lit("crlf")).otherwise(F.lit("lf"))
