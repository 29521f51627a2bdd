"""Syllables of English words by rule: as columns, and as plain functions for workers that meet a batch's words.

Both read the same patterns; the plain functions remember the words they have seen.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicons import SYLLABLE_EXCEPTIONS
from .text import let, matches, replace

_SILENT_E = r"([^aeiou])e(?=(?:ment|ness|less|ful|ly|ty)s?\z)"
_ONE_NUCLEUS = r"([tcsx])io(?=n)|([tc])ia(?=[ln])|([cst])iou|([gd])eou|([gd])iou|([tc])ie(?=nt)"
_GROUP = r"(?:[aeiouA]|(?<!^)y(?![aeiou]))+"


def bare(word: Column) -> Column:
    """The word's letters a to z, lower-cased; all that syllables are told from."""
    return replace(F.lower(word), "[^a-z]")


def _by_rule(w: Column) -> Column:
    marked = replace(replace(w, _ONE_NUCLEUS, "$1$2$3$4$5$6A"), "(i)([aou])|(e)(o)|(u)([ao])|(a)(o)", "$1$3$5$7-$2$4$6$8")
    groups = F.regexp_count(marked, F.lit(_GROUP))
    silent = matches(w, r"[^aeiou]e\z|^e\z") & (~matches(w, r"[^aeiou][lr]e\z") | matches(w, r"lle\z"))
    plural = matches(w, r"[^aeiou]es\z") & ~matches(w, r"(?:[sxz]|ch|sh|ce|ge)es\z|[^aeiou][lr]es\z")
    past = matches(w, r"[^aeiou]ed\z") & ~matches(w, r"[td]ed\z|[^aeiou][lr]ed\z")
    return let(groups, lambda n: F.greatest(F.lit(1), n - F.when((n > 1) & (silent | plural | past), 1).otherwise(0) + F.when(matches(w, r"[^aeiou]ism\z|thm\z"), 1).otherwise(0)))


def syllables_of_bare(raw: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in SYLLABLE_EXCEPTIONS.items() for x in kv])
    return F.when(raw == "", 0).otherwise(F.coalesce(F.try_element_at(known, raw), let(replace(raw, _SILENT_E, "$1"), _by_rule)))


def syllables(word: Column) -> Column:
    """Syllables of a word: 0 without a letter a to z, else at least 1."""
    return let(bare(word), syllables_of_bare)


def stems(raw: Column) -> Column:
    """What an ending -ing, -ed or -es may have been added to."""
    ending = r"^(.{2,})(ing|ed|es)\z"
    base = F.regexp_extract(raw, ending, 1)
    some = F.array(
        base,
        F.concat(base, F.lit("e")),
        F.when(matches(base, r"([^aeiou])\1\z"), replace(base, r".\z")),
        F.when(matches(base, r"i\z"), replace(base, r"i\z", "y")),
        F.when(matches(raw, r"es\z"), replace(raw, r"s\z")),
    )
    return F.when(matches(raw, ending), F.array_compact(some)).otherwise(F.array().cast("array<string>"))


def is_complex(word: Column) -> Column:
    """Three syllables or more, and not merely by an ending on a word of at most two."""

    def rule(raw: Column) -> Column:
        return let(syllables_of_bare(raw), lambda n: (n >= 3) & ~F.exists(stems(raw), lambda s: let(syllables_of_bare(s), lambda k: (k <= 2) & (n - k <= 1))))

    return let(bare(word), rule)


# --- plain functions -----------------------------------------------------------------------------------------------

_LETTERS = re.compile("[^a-z]")
_PLAIN = {k: re.compile(v.replace(r"\z", r"\Z")) for k, v in {
    "silent": _SILENT_E, "nucleus": _ONE_NUCLEUS, "broken": "(i)([aou])|(e)(o)|(u)([ao])|(a)(o)", "group": _GROUP, "e": r"[^aeiou]e\z|^e\z", "lre": r"[^aeiou][lr]e\z", "lle": r"lle\z", "es": r"[^aeiou]es\z",
    "spoken_es": r"(?:[sxz]|ch|sh|ce|ge)es\z|[^aeiou][lr]es\z", "ed": r"[^aeiou]ed\z", "spoken_ed": r"[td]ed\z|[^aeiou][lr]ed\z", "more": r"[^aeiou]ism\z|thm\z", "ending": r"^(.{2,})(ing|ed|es)\z", "double": r"([^aeiou])\1\z",
}.items()}


def _joined(m: re.Match, by: str = "") -> str:
    return "".join(g or "" for g in m.groups()) + by


@lru_cache(1 << 17)
def _bare_syllables(raw: str) -> int:
    if not raw:
        return 0
    if raw in SYLLABLE_EXCEPTIONS:
        return SYLLABLE_EXCEPTIONS[raw]
    has = lambda name: _PLAIN[name].search(w) is not None
    w = _PLAIN["silent"].sub(r"\1", raw)
    marked = _PLAIN["nucleus"].sub(lambda m: _joined(m, "A"), w)
    marked = _PLAIN["broken"].sub(lambda m: "-".join(g for g in m.groups() if g), marked)
    n = len(_PLAIN["group"].findall(marked))
    silent = has("e") and (not has("lre") or has("lle"))
    unspoken = silent or (has("es") and not has("spoken_es")) or (has("ed") and not has("spoken_ed"))
    return max(1, n - (n > 1 and unspoken) + has("more"))


def count_syllables(word: str) -> int:
    """Syllables of a word: 0 without a letter a to z, else at least 1."""
    return _bare_syllables(_LETTERS.sub("", word.lower()))


def word_stems(raw: str) -> list[str]:
    m = _PLAIN["ending"].match(raw)
    if not m:
        return []
    stem = m[1]
    return [stem, stem + "e", *[stem[:-1]] * bool(_PLAIN["double"].search(stem)), *[stem[:-1] + "y"] * stem.endswith("i"), *[raw[:-1]] * raw.endswith("es")]


@lru_cache(1 << 17)
def word_facts(word: str) -> tuple[int, bool]:
    """Syllables, and whether the word is complex."""
    raw = _LETTERS.sub("", word.lower())
    n = _bare_syllables(raw)
    return n, n >= 3 and not any(_bare_syllables(s) <= 2 and n - _bare_syllables(s) <= 1 for s in word_stems(raw))
