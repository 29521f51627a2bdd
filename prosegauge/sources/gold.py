"""Gold data for the evaluations: a pronouncing dictionary and treebank paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def syllable_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """word and counts (the syllables of its pronunciations) from lines ``WORD  PH ON1 EMES``.

    Comments (``;;;`` lines and what follows `` #``) and variant marks such as ``(2)`` go; words other than a to z go.
    A phoneme with a digit is a syllable.
    """
    line = F.regexp_replace("value", " #.*", "")
    parts = F.split(F.trim(line), r"\s+")
    rows = spark.read.text(path).filter(~F.startswith("value", F.lit(";;;"))).select(F.lower(F.regexp_replace(parts[0], r"\(\d+\)$", "")).alias("word"), F.size(F.filter(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), lambda p: F.rlike(p, F.lit(r"\d")))).alias("n"))
    return rows.filter(F.rlike("word", F.lit("^[a-z]+$")) & (F.col("n") > 0)).groupBy("word").agg(F.array_sort(F.collect_set("n")).alias("counts"))


def conllu_units(spark: SparkSession, path: str) -> DataFrame:
    """unit_id and sentences of each paragraph or document of CoNLL-U files.

    ``# newpar`` and ``# newdoc`` begin a unit, ``# text = `` gives a sentence.  Lines are numbered within their file;
    a file is read whole, as units may run across any split of it.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    lines = files.select("file", F.posexplode(F.split("value", "\n")).alias("i", "line"))
    lines = lines.filter(F.rlike("line", F.lit("^# (newpar|newdoc|text =)")))
    unit = F.sum(F.rlike("line", F.lit("^# (newpar|newdoc)")).cast("int")).over(Window.partitionBy("file").orderBy("i"))
    texts = lines.withColumn("unit", unit).filter(F.startswith("line", F.lit("# text ="))).withColumn("s", F.trim(F.regexp_replace("line", "^# text = ?", "")))
    grouped = texts.groupBy("file", "unit").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("sentences"))
    return grouped.select(F.concat_ws("#", "file", F.col("unit").cast("string")).alias("unit_id"), "sentences")
