"""Screening for terms in three ways, and the normal form that one of them works on.

What is reported are matches, never a verdict on a text.  Unicode normal forms are the one thing the JVM side lacks; they
run as an Arrow function over all rows, which hands plain ASCII on as it is.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as t
from .segment import base

MODES = ("substring", "word", "normalized")
_LETTER = r"[\p{L}\p{N}]"
_SPACED = rf"(?<![\p{{L}}\p{{N}}])(?:\p{{L}}[{t.SPACE}._\-*+]){{2,}}\p{{L}}(?![\p{{L}}\p{{N}}])"


def _java(literal: str) -> str:
    """A literal for a regular expression."""
    return re.sub(r"([.*+?^${}()|\[\]\\\-/&#~])", r"\\\1", literal)


def without_invisible(text: Column) -> Column:
    return t.replace(text, lx.INVISIBLE)


def _form(name: str):
    @F.pandas_udf("string")
    def normalised(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize(name, x))

    return normalised


def nfkc(text: Column) -> Column:
    return _form("NFKC")(text)


def folded_confusables(text: Column) -> Column:
    return F.translate(text, "".join(lx.CONFUSABLES), "".join(lx.CONFUSABLES.values()))


def without_diacritics(text: Column) -> Column:
    return t.replace(_form("NFD")(text), r"\p{M}")


def undone_leet(text: Column, symbols: str = "all") -> Column:
    """Digits become the letters they stand for; symbols too, or only those between letters or digits (``inner``)."""
    signs = {k: v for k, v in lx.LEET.items() if not k.isdigit()}
    if symbols == "inner":
        for sign, letter in signs.items():
            text = t.replace(text, rf"(?<={_LETTER}){_java(sign)}(?={_LETTER})", letter)
        return F.translate(text, "".join(k for k in lx.LEET if k.isdigit()), "".join(v for k, v in lx.LEET.items() if k.isdigit()))
    return F.translate(text, "".join(lx.LEET), "".join(lx.LEET.values()))


def joined_letters(text: Column) -> Column:
    """Letters that stand alone with single separators between them ("h e l l") become one word."""
    hits = F.regexp_extract_all(text, F.lit(_SPACED), F.lit(0))
    parts = F.split(text, _SPACED, -1)
    return F.array_join(F.zip_with(parts, hits, lambda p, h: F.concat(p, F.coalesce(t.replace(h, rf"[{t.SPACE}._\-*+]"), F.lit("")))), "")


def collapsed(text: Column) -> Column:
    return t.replace(text, r"(\p{L})\1{2,}", "$1")


def stages(df: DataFrame, column: str, *, leet: bool = True, confusables: bool = True, collapse: bool = True, symbols: str = "all") -> tuple[DataFrame, list[tuple[str, str]]]:
    """``df`` with one more column per stage of the normal form of ``column``; and (stage, column) in order."""
    steps = [("invisible", without_invisible), ("nfkc", nfkc)]
    if confusables:
        steps.append(("confusables", folded_confusables))
    steps += [("lower", F.lower), ("diacritics", without_diacritics)]
    if leet:
        steps += [("leet_inner" if symbols == "inner" else "leet", lambda c: undone_leet(c, symbols)), ("joined", joined_letters)]
    if collapse:
        steps.append(("collapsed", collapsed))
    names, last = [], column
    for name, step in steps:
        df = df.withColumn(f"_{name}", step(F.col(last)))
        last = f"_{name}"
        names.append((name, last))
    return df, names


def normalize(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """doc_id, output and steps: name, output and whether the stage changed anything."""
    rows, names = stages(base(df, id_col, text_col), "text", **options)
    before = ["text", *[c for _, c in names]]
    steps = [F.struct(F.lit(n).alias("name"), F.col(c).alias("output"), (F.col(c) != F.col(b)).alias("changed")) for (n, c), b in zip(names, before, strict=False)]
    return rows.select("doc_id", F.col(names[-1][1]).alias("output"), F.array(*steps).alias("steps"))


def tolerant_pattern(term: str) -> str:
    """A pattern for the term in which a run of k equal letters, or signs that stand for the letter, may be longer."""
    signs: dict[str, str] = {}
    for sign, letter in lx.LEET.items():
        if not sign.isdigit():
            signs[letter] = signs.get(letter, "") + sign
    out = ""
    for run in re.finditer(r"(.)\1*", term, re.DOTALL):
        c, k = run[1], len(run[0])
        if c.isalpha():
            out += (f"[{c}{''.join(map(_java, signs[c]))}]" if c in signs else c) + ("+" if k == 1 else f"{{{k},}}")
        else:
            out += _java(c) * k
    return out


def term_pattern(term: str, mode: str) -> str:
    low = term.lower()
    if mode == "substring":
        return _java(low)
    return f"(?<!{_LETTER}){tolerant_pattern(low) if mode == 'normalized' else _java(low)}(?!{_LETTER})"


def searched(df: DataFrame, mode: str, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """doc_id and text, the text that ``mode`` looks at."""
    rows = base(df, id_col, text_col).select("doc_id", "text")
    if mode != "normalized":
        return rows
    rows, names = stages(rows, "text", **({"symbols": "inner", "collapse": False} | options))
    return rows.select("doc_id", F.col(names[-1][1]).alias("text"))


def count_matches(df: DataFrame, terms: Sequence[str], mode: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, term, matches for every document and term that is not empty."""
    low = F.lower("text")
    pairs = [F.struct(F.lit(x).alias("term"), F.regexp_count(low, F.lit(term_pattern(x, mode))).alias("matches")) for x in terms if x]
    return searched(df, mode, id_col, text_col).select("doc_id", F.inline(F.array(*pairs)))


def places_column(low: Column, terms: Sequence[str], mode: str) -> Column:
    """All matches in a lower-cased text, sorted by place: index, order (of the term), length and whole_word.

    Matches are located by arithmetic over the pieces between them: of the k-th match, all pieces up to it and all
    matches before it come first.  What stands beside a match is told from the pieces, too.
    """
    kind = "array<struct<index:int,order:int,length:int,whole_word:boolean>>"

    def of_term(order: int, term: str) -> Column:
        pattern = term_pattern(term, mode)

        def places(p: Column) -> Column:
            parts, hits = p["parts"], p["hits"]
            n = F.size(hits)
            rows = F.zip_with(
                F.zip_with(F.slice(parts, 1, n), hits, lambda a, h: F.struct(a.alias("before"), h.alias("hit"))),
                F.zip_with(F.slice(parts, 2, F.greatest(n, F.lit(1))), F.slice(hits, 2, F.greatest(n, F.lit(1))), lambda a, h: F.when(a == "", h).otherwise(a)),
                lambda x, y: F.struct(x["before"].alias("before"), x["hit"].alias("hit"), y.alias("after")),
            )
            zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("last"), F.array().cast(kind).alias("out"))

            def step(acc: Column, m: Column) -> Column:
                start, length = acc["at"] + F.length(m["before"]), F.length(m["hit"])
                beside = t.matches(F.when(m["before"] == "", acc["last"]).otherwise(m["before"]), _LETTER + r"\z") | t.matches(F.coalesce(m["after"], F.lit("")), "^" + _LETTER)
                place = F.struct(start.cast("int").alias("index"), F.lit(order).alias("order"), length.cast("int").alias("length"), (~beside).alias("whole_word"))
                return F.struct((start + length).cast("int").alias("at"), m["hit"].alias("last"), F.array_append(acc["out"], place).alias("out"))

            return F.aggregate(rows, zero, step, lambda acc: acc["out"])

        return t.let(F.struct(F.regexp_extract_all(low, F.lit(pattern), F.lit(0)).alias("hits"), F.split(low, pattern, -1).alias("parts")), places)

    some = [x for x in terms if x]
    return F.array_sort(F.concat(*[of_term(i, x) for i, x in enumerate(some)])) if some else F.array().cast(kind)


def context_of(text: Column, place: Column) -> Column:
    """The match with 24 characters on either side."""
    start = F.greatest(F.lit(0), place["index"] - 24)
    return F.substr(text, start + 1, place["index"] + place["length"] + 24 - start)


def screen(df: DataFrame, terms: Sequence[str] = tuple(lx.DEMO_TERMS), mode: str = "substring", id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """doc_id, term, matched, index, whole_word, context: one row per match, indexes from 0 in the text searched."""
    rows = searched(df, mode, id_col, text_col, **options).withColumn("_low", F.lower("text"))
    rows = rows.select("doc_id", "text", F.explode(places_column(F.col("_low"), terms, mode)).alias("m"))
    m, some = F.col("m"), [x for x in terms if x] or [""]
    term = F.get(F.array(*[F.lit(x) for x in some]), m["order"])
    return rows.select("doc_id", term.alias("term"), F.substr(F.col("text"), m["index"] + 1, m["length"]).alias("matched"), m["index"].alias("index"), m["whole_word"].alias("whole_word"), context_of(F.col("text"), m).alias("context"), m["order"].alias("order"))


def modes_columns(df: DataFrame, terms: Sequence[str] = tuple(lx.DEMO_TERMS), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and a struct for each mode: total, whole, collateral and the contexts of the first ten matches inside
    other words.  Row by row, without a shuffle."""
    rows, names = stages(base(df, id_col, text_col).select("doc_id", "text"), "text", symbols="inner", collapse=False)
    rows = rows.select("doc_id", "text", F.lower("text").alias("_low"), F.col(names[-1][1]).alias("_norm")).withColumn("_normlow", F.lower("_norm"))
    seen = {"substring": ("text", "_low"), "word": ("text", "_low"), "normalized": ("_norm", "_normlow")}
    rows = rows.select("doc_id", *[F.struct(F.col(a).alias("text"), places_column(F.col(b), terms, mode).alias("m")).alias(mode) for mode, (a, b) in seen.items()])

    def summary(found: Column) -> Column:
        m, text = found["m"], found["text"]
        return t.let(F.filter(m, lambda x: ~x["whole_word"]), lambda inside: F.struct(F.size(m).cast("long").alias("total"), (F.size(m) - F.size(inside)).cast("long").alias("whole"), F.size(inside).cast("long").alias("collateral"), F.transform(F.slice(inside, 1, 10), lambda x: t.trimmed(context_of(text, x))).alias("examples")))

    rows = rows.select("doc_id", *[summary(F.col(mode)).alias(mode) for mode in MODES])
    number = lambda c: F.col(c).cast("string")
    said = F.concat(number("substring.total"), F.lit(" as substrings, "), number("substring.collateral"), F.lit(" of them inside other words; "), number("word.total"), F.lit(" as words; "), number("normalized.total"), F.lit(" as words of the normal form"))
    return rows.withColumn("summary", said)


def compare_modes(df: DataFrame, terms: Sequence[str] = tuple(lx.DEMO_TERMS), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, mode, total, whole, collateral and examples: a row per document and mode."""
    rows = modes_columns(df, terms, id_col, text_col)
    named = [F.struct(F.lit(mode).alias("mode"), *[F.col(f"{mode}.{c}").alias(c) for c in ("total", "whole", "collateral", "examples")]) for mode in MODES]
    return rows.select("doc_id", F.inline(F.array(*named)))


def parsed_terms(typed: Column) -> Column:
    """Terms of a list parted by commas or white space."""
    return F.filter(F.split(typed, f"[,{t.SPACE}]+", -1), lambda x: x != "")


def highlight(df: DataFrame, matches: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and html: the text escaped, with matches marked; of matches that overlap the first is marked."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    found = matches.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("index", "order", F.length("matched").alias("length")))).alias("_m")).withColumnRenamed("doc_id", "_id")
    rows = base(df, id_col, text_col)
    rows = rows.join(found, rows.doc_id.eqNullSafe(found["_id"]), "left").withColumn("_m", F.coalesce("_m", F.slice(F.array(F.struct(F.lit(0).alias("index"), F.lit(0).alias("order"), F.lit(0).alias("length"))), 1, 0)))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        piece = F.concat(escaped(F.substr(F.col("text"), acc["at"] + 1, m["index"] - acc["at"])), F.lit("<mark>"), escaped(F.substr(F.col("text"), m["index"] + 1, m["length"])), F.lit("</mark>"))
        return F.when(m["index"] < acc["at"], acc).otherwise(F.struct((m["index"] + m["length"]).cast("int").alias("at"), F.array_append(acc["out"], piece).alias("out")))

    html = F.aggregate("_m", zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), escaped(F.substr(F.col("text"), acc["at"] + 1, F.length("text")))))
    return rows.select("doc_id", html.alias("html"))


# --- evasions ------------------------------------------------------------------------------------------------------


def evasion_columns(term: Column) -> Column:
    """An array of (technique, text, family) for a term; those that do not change it are left out."""
    low = F.lower(term)

    def made(chars: Column) -> Column:
        swap = lambda k: F.concat(F.slice(chars, 1, k), F.array(F.element_at(chars, k + 2), F.element_at(chars, k + 1)), F.slice(chars, k + 3, F.greatest(F.size(chars), F.lit(1))))
        places = F.filter(F.sequence(F.lit(0), F.greatest(F.size(chars) - 2, F.lit(0))), lambda i: F.get(chars, i) != F.get(chars, i + 1))
        later = F.filter(places, lambda i: i >= 1)
        at = F.coalesce(F.get(later, F.lit(0)), F.get(places, F.lit(0)))
        swapped = F.when(at.isNull(), low).otherwise(F.array_join(t.let(at, swap), ""))
        second, third = F.coalesce(F.get(chars, F.lit(1)), F.lit("")), F.coalesce(F.get(chars, F.lit(2)), F.lit(""))
        filler = F.filter(F.array(F.lit("x"), F.lit("z"), F.lit("q")), lambda f: (f != second) & (f != third))[0]
        with_second = lambda by: F.array_join(F.transform(chars, lambda c, i: F.when(i == 1, by(c)).otherwise(c)), "")
        mapped = lambda table: F.translate(low, "".join(table), "".join(table.values()))
        designed = [
            ("leetspeak", mapped(lx.LEET_FOR)), ("Cyrillic homoglyphs", mapped(lx.HOMOGLYPH_FOR)), ("internal spacing", F.array_join(chars, " ")), ("punctuation infix", F.array_join(chars, ".")),
            ("zero-width joiner", F.array_join(chars, "\u200b")), ("repeated letters", with_second(lambda c: F.repeat(c, 3))), ("diacritics", mapped(lx.ACCENT_FOR)),
        ]
        independent = [("adjacent swap", swapped), ("inserted letter", with_second(lambda c: F.concat(c, filler))), ("unlisted homoglyphs", mapped(lx.UNLISTED_LOOKALIKES))]
        return F.array(*[F.struct(F.lit(n).alias("technique"), c.alias("text"), F.lit(f).alias("family")) for f, some in (("designed-for", designed), ("independent", independent)) for n, c in some])

    return F.filter(t.let(F.filter(F.split(low, ""), lambda c: c != ""), made), lambda e: e["text"] != low)


def evasions(terms: DataFrame, term_col: str = "term") -> DataFrame:
    """term, technique, text, family."""
    return terms.select(F.col(term_col).alias("term")).withColumn("_e", evasion_columns(F.col("term"))).select("term", F.inline("_e"))


def evasion_report(df: DataFrame, terms: Sequence[str] = tuple(lx.DEMO_TERMS)) -> DataFrame:
    """term, technique, text, family, and whether word and normalised matching catch it inside a sentence."""
    spark = df.sparkSession
    every = evasions(spark.createDataFrame([(x,) for x in terms], "term string"))
    rows = every.withColumn("carrier", F.concat(F.lit("you are "), F.col("text"), F.lit(" today")))
    rows, names = stages(rows, "carrier", symbols="inner", collapse=False)
    hit = lambda mode, c: F.coalesce(*[F.when(F.col("term") == x, t.matches(F.lower(c), term_pattern(x, mode))) for x in terms])
    return rows.select("term", "technique", "text", "family", hit("word", "carrier").alias("word"), hit("normalized", names[-1][1]).alias("normalized"))


def evasion_tally(report: DataFrame) -> DataFrame:
    """family, technique (null: all of the family), total, word, normalized."""
    rolled = report.rollup("family", "technique").agg(F.count("*").alias("total"), F.count_if("word").alias("word"), F.count_if("normalized").alias("normalized"))
    return rolled.filter(F.col("family").isNotNull())
