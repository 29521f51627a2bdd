"""Tokens, counts and normal forms of a text column."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the metrics define it: ASCII's, and Unicode's spaces and line ends, and U+FEFF.
SPACE = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
WORD = r"\p{L}[\p{L}\p{N}]*(?:['’\-][\p{L}\p{N}]+)*|\p{N}+(?:[.,]\p{N}+)*"
NUMERAL = r"^\p{N}+(?:[.,]\p{N}+)*\z"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(c: Column, pattern: str) -> Column:
    return F.rlike(c, F.lit(pattern))


def replace(c: Column, pattern: str, by: str = "") -> Column:
    return F.regexp_replace(c, F.lit(pattern), F.lit(by))


def one_of(c: Column, words: list[str]) -> Column:
    return c.isin(words)


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def half_up(c: Column, places: int = 0) -> Column:
    """Rounded half away from zero, through ``floor(x * 10^places + 0.5)``."""
    scale = float(10**places)
    return F.signum(c) * F.floor(F.abs(c) * scale + F.lit(0.5)).cast("double") / F.lit(scale) + F.lit(0.0)  # no negative zero


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def trimmed(c: Column) -> Column:
    return replace(replace(c, f"^[{SPACE}]+"), f"[{SPACE}]+\\z")


def paragraphs(text: Column) -> Column:
    """Blank lines part paragraphs; trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, r"\n[ \t]*\n+", -1), trimmed), lambda p: p != "")


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def is_numeral(word: Column) -> Column:
    return matches(word, NUMERAL)


def numerals(ws: Column) -> Column:
    return F.filter(ws, is_numeral)


def normal_word(word: Column) -> Column:
    return replace(F.translate(F.lower(word), "’", "'"), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}']+\z")


def tokens(ws: Column) -> Column:
    """Normal forms of the words, in order, without empty ones."""
    return F.filter(F.transform(ws, normal_word), lambda w: w != "")


def types(ws: Column) -> Column:
    """Distinct tokens in the order of their first occurrence."""
    return F.array_distinct(tokens(ws))


def graphemes(text: Column) -> Column:
    """User-perceived characters.  Without CR, combining marks, joiners and the like every character is one: that holds
    for all characters below U+0300 and for general punctuation and currency signs."""
    return F.when(matches(text, r"^[\x00-\x0C\x0E-\x{02FF}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{20A0}-\x{20BF}]*\z"), F.length(text)).otherwise(F.regexp_count(text, F.lit(r"\X")))


def letters(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{L}"))


def alphanumerics(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]"))


def spaces(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{SPACE}]"))


def plain_number(c: Column) -> Column:
    """A number as text, without a fraction of zero; null for null."""
    return F.when(c.isNotNull(), F.regexp_replace(F.format_string("%.4f", c.cast("double")), r"\.?0+$", ""))
