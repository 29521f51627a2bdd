"""Sentence boundaries.

A boundary needs white space behind a run of terminals and closers, so a paragraph is cut there into chunks; a rule over
each pair of neighbouring chunks says whether a sentence ends between them; a mark is set where it does and the joined
text is split at the marks.  Chunks keep their white space, so nothing is lost, and the work is linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lx
from .text import SPACE, let, matches, one_of, paragraphs, replace, trimmed

CLOSERS = "\"'’”)\\]}»"
OPENERS = "\"'‘“(\\[«"
CHUNK = rf"(?s).*?(?:[.!?…]+[{CLOSERS}]*(?=[{SPACE}]|\z)|\z)"
TAIL = rf"([.!?…]+)([{CLOSERS}]*)\z"
#: A noncharacter, which no text for interchange holds.
MARK = "\uffff"


def _part(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(c, pattern, group)


def _abbreviated(body: Column, raw: Column, word: Column, digit: Column) -> Column:
    low = F.lower(raw)
    return (
        F.when(one_of(low, lx.ABBREVIATIONS), True)
        .when(one_of(low, lx.BEFORE_NUMBER), digit)
        .when(one_of(low, lx.DATE_ABBREVIATIONS), digit | one_of(word, lx.DATE_WORDS))
        .when(one_of(low, lx.CAPITALIZED_ONLY), matches(raw, r"^\p{Lu}"))
        .when(one_of(low, lx.LOWERCASE_ONLY), matches(raw, r"^\p{Ll}"))
        .when(low == "al", matches(body, r"(?i)(?:\A|\P{L})et +\.*al\z"))
        .otherwise(False)
    )


def _full_stop_ends(body: Column, follows: Column) -> Column:
    """Whether a full stop behind ``body`` ends a sentence, with ``follows`` after the white space."""
    word = F.lower(_part(follows, rf"^[{OPENERS}]*(\p{{L}}*)"))
    digit = matches(follows, rf"^[{OPENERS}]*\p{{N}}")
    initial_next = matches(follows, rf"^[{OPENERS}]*\p{{Lu}}\.")
    initial = matches(body, rf"(?:\A|[{SPACE}(\"'‘“])\p{{Lu}}(?:\.\p{{Lu}})*\z")

    def rule(raw: Column) -> Column:
        name = initial & (initial_next | ((raw != "I") & ~one_of(word, lx.SENTENCE_STARTERS)))
        return (raw == "") | ~(name | _abbreviated(body, raw, word, digit))

    return let(replace(_part(body, r"([\p{L}.]*)\z"), r"^\.+"), rule)


def ends_sentence(chunk: Column, after: Column) -> Column:
    """Whether a sentence ends between two neighbouring chunks of a paragraph."""
    follows, run, closers = replace(after, f"^[{SPACE}]+"), _part(chunk, TAIL, 1), _part(chunk, TAIL, 2)

    def rule(s: Column) -> Column:
        begins, run_, closed, body = matches(s["follows"], rf"^[\p{{Lu}}\p{{N}}{OPENERS}—-]"), s["run"], s["closers"], s["body"]
        return (
            F.when(~begins, (closed == "") & matches(s["follows"], r"^\p{Ll}") & matches(run_, r"^[?!]+\z"))
            .when(~F.startswith(run_, F.lit(".")), True)
            .otherwise(_full_stop_ends(body, s["follows"]))
        )

    return let(F.struct(follows.alias("follows"), run.alias("run"), closers.alias("closers"), replace(chunk, TAIL).alias("body")), rule)


def sentences_of_paragraph(paragraph: Column) -> Column:
    chunks = F.filter(F.regexp_extract_all(paragraph, F.lit(CHUNK), F.lit(0)), lambda c: c != "")

    def marked(c: Column) -> Column:
        pairs = F.zip_with(c, F.slice(c, 2, F.greatest(F.size(c), F.lit(1))), lambda a, b: F.when(b.isNull(), a).when(ends_sentence(a, b), F.concat(a, F.lit(MARK))).otherwise(a))
        return F.array_join(pairs, "")

    return F.filter(F.transform(F.split(let(chunks, marked), MARK, -1), trimmed), lambda s: s != "")


def sentences(text: Column) -> Column:
    """Sentences of all paragraphs, in order; a paragraph's end always ends a sentence."""
    return F.flatten(F.transform(paragraphs(text), sentences_of_paragraph))
