"""Column functions over texts: words, windows' pieces, hashes and a seeded generator."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ECMAScript has it, inside a Java character class: a fixed value.
SPACE = r"\t-\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def ascii_words(pattern: str) -> str:
    r"""The pattern with ASCII word borders; Java's own `\b` also knows other letters, or not, by its version. A border before a letter or a group is a word's beginning, any other its end."""
    return re.sub(r"\\b(?=[A-Za-z(])", "(?<![A-Za-z0-9_])", pattern).replace(r"\b", "(?![A-Za-z0-9_])")


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once and not wherever it is named."""
    return F.transform(F.array(value), then)[0]


def trimmed(text: Column | str) -> Column:
    return F.regexp_replace(col(text), rf"^[{SPACE}]+|[{SPACE}]+$", "")


def is_blank(text: Column | str) -> Column:
    return ~F.coalesce(col(text), F.lit("")).rlike(rf"[^{SPACE}]")


def words(text: Column | str) -> Column:
    """The words between white space; none for a blank text."""
    return F.when(is_blank(text), F.array().cast("array<string>")).otherwise(F.split(trimmed(text), rf"[{SPACE}]+"))


def spaced_words(text: Column | str) -> Column:
    """Words, each with the white space before it."""
    return F.regexp_extract_all(col(text), F.lit(rf"([{SPACE}]*[^{SPACE}]+)"), F.lit(1))


def trailing_space(text: Column | str) -> Column:
    return F.regexp_extract(col(text), rf"([{SPACE}]*)$", 1)


def sha(text: Column | str) -> Column:
    return F.sha2(F.encode(col(text), "utf-8"), 256)


def iso_time(text: Column | str) -> Column:
    """The instant that an ISO text with an offset names, with or without parts of a second; null if it is none."""
    formats = ("yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    return F.coalesce(*[F.try_to_timestamp(col(text), F.lit(f)) for f in formats])


def date_of(year: Column | str, month: Column | str, day: Column | str) -> Column:
    """The date of three numbers; null where there is no such day."""
    text = F.concat_ws("-", F.lpad(col(year).cast("string"), 4, "0"), F.lpad(col(month).cast("string"), 2, "0"), F.lpad(col(day).cast("string"), 2, "0"))
    return F.when(col(year).isNotNull() & col(month).isNotNull() & col(day).isNotNull(), F.try_to_date(text, "yyyy-MM-dd"))


def lcg(state: Column) -> Column:
    """The next state of the 32-bit linear congruential generator; state / 2^32 is the draw."""
    return (state * F.lit(1664525).cast("long") + F.lit(1013904223).cast("long")).bitwiseAND(F.lit(4294967295).cast("long"))


def seed_for(kind: str, seed: int, max_words: int, ordinal: Column | str) -> Column:
    """Per-case seeds: `fixed`, `xor_case_ordinal_v1` or `legacy_notinject_v1` (ordinal is then the case's number)."""
    if kind == "fixed":
        return F.lit(seed & 0xFFFFFFFF).cast("long")
    base = F.lit((seed ^ (max_words * 65537)) & 0xFFFFFFFF).cast("long")
    number = col(ordinal).cast("long") + (1 if kind == "xor_case_ordinal_v1" else 0)
    return base.bitwiseXOR(number).bitwiseAND(F.lit(4294967295).cast("long"))
