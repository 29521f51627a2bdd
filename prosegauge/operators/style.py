"""Style: passive candidates, nominalisations, hedges, adverbs, and the rhythm of sentence lengths."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as lx
from ..functions import text as t
from .lexical import counted_column, ranked_column
from .segment import HEDGES, NOMINALS, base, sentence_table, sentences_of, words_of

NOMINAL = r"(?:tion|sion|ment|ance|ence|ity|ness|ancy|ency|ism|ure|al)s?\z"
TOP = 12


def _folded(word: Column) -> Column:
    return F.translate(F.lower(word), "’", "'")


def passive_of_words(words: Column) -> Column:
    """Passive candidates among the words of one sentence: index, auxiliary, participle.

    A form of "be", then at most two words that may intervene, then a participle: irregular, or ending in -ed with more
    than three letters.  A word that may intervene is never the participle.
    """
    low = F.transform(words, _folded)

    def candidates(f: Column) -> Column:
        def at(word: Column, i: Column) -> Column:
            step = F.when(~t.one_of(F.get(f, i + 1), lx.INTERVENING), 1).when(~t.one_of(F.get(f, i + 2), lx.INTERVENING), 2).when(~t.one_of(F.get(f, i + 3), lx.INTERVENING), 3)

            def hit(j: Column) -> Column:
                after = F.get(f, j)
                participle = t.one_of(after, lx.IRREGULAR_PARTICIPLES) | (F.endswith(after, F.lit("ed")) & (F.length(after) > 3))
                return F.when(t.one_of(word, lx.BE_FORMS) & participle, F.struct(i.alias("index"), F.get(words, i).alias("auxiliary"), F.get(words, j).alias("participle")))

            return t.let(i + step, hit)

        return F.array_compact(F.transform(f, at))

    return t.let(low, candidates)


def passive_hits(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sent_idx, index, auxiliary, participle."""
    rows = sentence_table(df, id_col, text_col).withColumn("_w", t.words(F.col("sentence")))
    return rows.select("doc_id", "sent_idx", F.inline(passive_of_words(F.col("_w"))))


def passive(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sentences with a candidate, total, share_of_sentences, and as examples the first eight such sentences with
    their hits."""
    rows = base(df, id_col, text_col)
    rows = rows.withColumn("_s", sentences_of(rows))
    hits = F.transform("_s", lambda s: F.struct(s.alias("sentence"), passive_of_words(t.words(s)).alias("hits")))
    rows = rows.select("doc_id", F.size("_s").alias("_all"), F.filter(hits, lambda x: F.size(x["hits"]) > 0).alias("_p"))
    total = F.aggregate("_p", F.lit(0).cast("long"), lambda a, x: a + F.size(x["hits"]))
    return rows.select("doc_id", F.size("_p").cast("long").alias("sentences"), total.alias("total"), _percent(F.size("_p"), F.col("_all")).alias("share_of_sentences"), F.slice("_p", 1, 8).alias("examples"))


def passive_examples(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, example (from 0), sentence, index, auxiliary, participle: the examples of ``passive``, a row for each hit."""
    rows = passive(df, id_col, text_col).select("doc_id", F.posexplode("examples").alias("example", "_e"))
    return rows.select("doc_id", "example", F.col("_e.sentence").alias("sentence"), F.inline("_e.hits"))


def _percent(a: Column, b: Column) -> Column:
    return F.coalesce(t.half_up(t.ratio(a, b) * 100, 1), F.lit(0.0))


def is_nominalisation(low: Column) -> Column:
    return (F.length(low) > 5) & t.matches(low, NOMINAL) & ~t.one_of(low, lx.NOT_NOMINALISATIONS)


def is_hedge(low: Column, hedges: Sequence[str] = tuple(lx.HEDGES)) -> Column:
    return t.one_of(low, list(hedges))


def is_adverb(low: Column) -> Column:
    return (F.length(low) > 4) & F.endswith(low, F.lit("ly"))


def word_class_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", hedges: Sequence[str] = tuple(lx.HEDGES)) -> DataFrame:
    """doc_id, words, and count and percent of nominalisations, hedges and adverbs."""
    rows = base(df, id_col, text_col)
    rows = rows.select("doc_id", F.transform(words_of(rows), F.lower).alias("_w"))
    kinds = {"nominalisations": is_nominalisation, "hedges": lambda c: is_hedge(c, hedges), "adverbs": is_adverb}
    rows = rows.select("doc_id", F.size("_w").cast("long").alias("words"), *[F.size(F.filter("_w", f)).cast("long").alias(k) for k, f in kinds.items()])
    return rows.select("doc_id", "words", *[c for k in kinds for c in (F.col(k), _percent(F.col(k), F.col("words")).alias(f"{k}_percent"))])


def counted_class(words: Column, rule: Callable[[Column], Column]) -> Column:
    """(word, count) of the lower-cased words that ``rule`` holds for."""
    return counted_column(F.filter(F.transform(words, F.lower), lambda low: rule(low)))


def top_lists(df: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the arrays top_nominalisations and top_hedges of (word, count, rank)."""
    rows = base(df, id_col, text_col)
    rows = rows.withColumn("_w", words_of(rows))
    counted = lambda known, rule: F.col(known) if known in rows.columns else counted_class(F.col("_w"), rule)
    return rows.select("doc_id", ranked_column(counted(NOMINALS, is_nominalisation), k).alias("top_nominalisations"), ranked_column(counted(HEDGES, is_hedge), k).alias("top_hedges"))


def top_of_class(df: DataFrame, kind: str, k: int = TOP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, word, count, rank of the most frequent nominalisations or hedges."""
    return top_lists(df, k, id_col, text_col).select("doc_id", F.inline(f"top_{kind}"))


def sentence_lengths(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, sent_idx, sentence, length in words."""
    return sentence_table(df, id_col, text_col).withColumn("length", F.size(t.words(F.col("sentence"))))


def _deviation(values: Column) -> Column:
    """Standard deviation of an array, with n below the line, by Welford's updates in the array's order: the last place is
    then that of a database's aggregate, which bounds and roundings at a tie hang on; null for an empty array."""

    def step(a: Column, v: Column) -> Column:
        x, n = v.cast("double"), a["n"] + 1
        mean = a["mean"] + (x - a["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (a["squares"] + (x - mean) * (x - a["mean"])).alias("squares"))

    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("squares"))
    return F.aggregate(values, zero, step, lambda a: F.sqrt(t.ratio(a["squares"], a["n"])))


def rhythm(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, count, mean, median, sd, min, max, longest_index, longest_sentence, note.

    Sentences without words have no length; ``longest_index`` counts among the lengths, and ``longest_sentence`` is the
    sentence at that index among all of them, which is another one if a wordless sentence comes before.
    """
    rows = base(df, id_col, text_col)
    rows = rows.withColumn("_s", sentences_of(rows))
    rows = rows.withColumn("_l", F.filter(F.transform("_s", lambda s: F.size(t.words(s))), lambda n: n > 0))
    rows = rows.withColumns({"count": F.size("_l").cast("long"), "_o": F.array_sort("_l")})
    n, total = F.col("count"), F.aggregate("_l", F.lit(0.0), lambda a, x: a + x.cast("double"))
    rows = rows.withColumns({"_mean": t.ratio(total, n), "_sd": _deviation(F.col("_l"))})
    middle = lambda i: F.get("_o", i.cast("int")).cast("double")
    rows = rows.withColumns({"max": F.array_max("_l"), "min": F.array_min("_l"), "median": (middle(F.floor((n - 1) / 2)) + middle(F.floor(n / 2))) / 2})
    rows = rows.withColumn("longest_index", F.array_position("_l", F.col("max")) - 1)
    sd = F.col("_sd")
    note = F.when(n == 0, None).when(n < 4, "few sentences").when(sd < 4, "uniform").when(sd > 14, "varied").otherwise("normal")
    return rows.select("doc_id", "count", t.half_up(F.col("_mean"), 1).alias("mean"), "median", t.half_up(sd, 1).alias("sd"), "min", "max", "longest_index", F.get("_s", F.col("longest_index").cast("int")).alias("longest_sentence"), note.alias("note"))


def rhythm_histogram(df: DataFrame, bars: int = 14, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, bin, low, high, sentences: lengths in bins of ceil(max / bars) words, empty bins included."""
    rows = base(df, id_col, text_col)
    lengths = F.filter(F.transform(sentences_of(rows), lambda s: F.size(t.words(s))), lambda n: n > 0)
    rows = rows.select("doc_id", lengths.alias("_l")).withColumn("_size", F.greatest(F.lit(1), F.ceil(F.array_max("_l") / bars)).cast("int"))
    bins = F.transform(F.sequence(F.lit(0), F.floor(F.array_max("_l") / F.col("_size")).cast("int")), lambda b: F.struct(
        b.alias("bin"), (b * F.col("_size")).alias("low"), ((b + 1) * F.col("_size") - 1).alias("high"),
        F.size(F.filter("_l", lambda n: F.floor(n / F.col("_size")).cast("int") == b)).cast("long").alias("sentences"),
    ))
    return rows.filter(F.size("_l") > 0).select("doc_id", F.inline(bins))
