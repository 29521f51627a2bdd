"""Accuracy of the heuristics against gold data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.sentences import sentences
from ..functions.syllables import syllables
from .ranks import global_index


def syllable_errors(gold: DataFrame) -> DataFrame:
    """``gold`` (word, counts) to word, predicted, gold (the count nearest to the prediction) and error."""
    rows = gold.withColumn("predicted", syllables(F.col("word")))
    nearest = F.array_min(F.transform("counts", lambda c: F.struct(F.abs(c - F.col("predicted")).alias("d"), c.alias("c"))))["c"]
    rows = rows.withColumn("gold", nearest)
    return rows.select("word", "predicted", "gold", (F.col("predicted") - F.col("gold")).alias("error"))


def syllable_eval(gold: DataFrame) -> DataFrame:
    """One row: words, exact_percent, within_one_percent, mean_absolute, mean_signed."""
    e = F.col("error")
    percent = lambda c: t.half_up(t.ratio(F.count_if(c), F.count("*")) * 100, 2)
    return syllable_errors(gold).agg(F.count("*").alias("words"), percent(e == 0).alias("exact_percent"), percent(F.abs(e) <= 1).alias("within_one_percent"), t.half_up(F.avg(F.abs(e)), 4).alias("mean_absolute"), t.half_up(F.avg(e), 4).alias("mean_signed"))


def syllable_histogram(gold: DataFrame) -> DataFrame:
    """gold (true count), error, words."""
    return syllable_errors(gold).groupBy("gold", "error").agg(F.count("*").alias("words"))


def worst_syllables(gold: DataFrame, k: int = 20) -> DataFrame:
    """The ``k`` words with the largest errors."""
    return syllable_errors(gold).orderBy(F.desc(F.abs("error")), "word").limit(k)


def boundary_offsets(units: Column) -> Column:
    """Where each sentence but the last ends, in characters other than white space."""
    def sums(lengths: Column) -> Column:
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.array_append(acc["out"], acc["at"] + n).alias("out"))
        return F.aggregate(F.slice(lengths, 1, F.greatest(F.size(lengths) - 1, F.lit(0))), zero, step, lambda acc: acc["out"])

    return t.let(F.transform(units, lambda s: F.length(t.replace(s, f"[{t.SPACE}]+"))), sums)


def sentence_eval(gold: DataFrame) -> DataFrame:
    """``gold`` (unit_id, sentences) to one row: tp, fp, fn, precision, recall, f1, exact_units_percent.

    The unit's text is its sentences with a space between; the splitter's boundaries are held against the gold ones.
    """
    rows = gold.select(boundary_offsets(F.col("sentences")).alias("g"), boundary_offsets(sentences(F.array_join("sentences", " "))).alias("p"))
    rows = rows.select(F.size(F.array_intersect("g", "p")).alias("tp"), F.size(F.array_except("p", "g")).alias("fp"), F.size(F.array_except("g", "p")).alias("fn"))
    out = rows.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), t.half_up(t.ratio(F.count_if((F.col("fp") == 0) & (F.col("fn") == 0)), F.count("*")) * 100, 2).alias("exact_units_percent"))
    p, r = t.ratio(F.col("tp"), F.col("tp") + F.col("fp")), t.ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.select("tp", "fp", "fn", t.half_up(p * 100, 2).alias("precision"), t.half_up(r * 100, 2).alias("recall"), t.half_up(t.ratio(p * r * 2, p + r) * 100, 2).alias("f1"), "exact_units_percent")


def cross_check(ours: DataFrame, theirs: DataFrame, keys: tuple[str, ...] = ("sample", "metric")) -> DataFrame:
    """metric, samples, mean and largest absolute difference between two frames of (sample, metric, value)."""
    other = theirs.withColumnRenamed("value", "_other")
    gap = F.abs(F.col("value") - F.col("_other"))
    return ours.join(other, list(keys)).groupBy(keys[-1]).agg(F.count("*").alias("samples"), t.half_up(F.avg(gap), 2).alias("mean_difference"), t.half_up(F.max(gap), 2).alias("largest_difference"))


def every_kth(df: DataFrame, order: str, step: int) -> DataFrame:
    """Every ``step``-th row in the order of a column, the first included."""
    return global_index(df, [F.col(order)], "_i").filter(F.col("_i") % step == 0).drop("_i")
