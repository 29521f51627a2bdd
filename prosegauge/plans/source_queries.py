"""Queries that write the tables in other formats to the shared folder and read them back: sources and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import segment
from ..sources import conllu_units, documents_from_files, documents_from_table, samples, syllable_dictionary
from ..sources.report import write_json
from ..storage import own_dir


def new_path(spark: SparkSession, name: str) -> str:
    return f"{own_dir(spark)}/{uuid.uuid4().hex}/{name}"


def benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``benchmark`` as a text file each, in folders of their own."""
    path = new_path(spark, "files")
    benchmark(spark, sf_dir).select(F.col("item_id"), "text").write.partitionBy("item_id").option("lineSep", "\n").text(path)
    found = documents_from_files(spark, path)
    return found.select(F.regexp_extract("doc_id", r"item_id=(\d+)", 1).cast("long").alias("item_id"), F.length("text").cast("long").alias("chars"), "text")


def text_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents_from_table(spark.read.parquet(f"{sf_dir}/conversations.parquet"), "conv_id", "text")
    return segment.counts(rows).groupBy("doc_id").agg(F.count("*").alias("turns"), F.sum("words").cast("long").alias("words"))


def sample_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark)


def json_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of ``documents``, written as JSON and read again."""
    counts = segment.counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    path = new_path(spark, "json")
    write_json(counts, path)
    return spark.read.schema(counts.schema).json(path).select("doc_id", "characters", "words", "sentences", "reading_minutes")


def dictionary_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower-cased words of ``benchmark`` as a pronouncing dictionary with a phoneme for each vowel group, a comment line
    and a second pronunciation, written and read again."""
    words = segment.word_table(benchmark(spark, sf_dir), "item_id").select(F.lower("word").alias("word")).filter(F.rlike("word", F.lit("^[a-z]+$"))).distinct()
    n = F.regexp_count("word", F.lit("[aeiouy]+"))
    line = lambda mark, k: F.concat(F.upper("word"), F.lit(f"{mark}  B"), F.repeat(F.lit(" AH0"), k))
    lines = words.select(F.explode(F.array(line("", n), F.when(F.length("word") > 7, line("(1)", n + 1)), F.when(F.length("word") > 9, F.lit(";;; a comment  AH0")))).alias("value")).filter("value is not null")
    path = new_path(spark, "dictionary")
    lines.write.text(path)
    return syllable_dictionary(spark, path).select("word", F.array_join("counts", ",").alias("counts"))


def treebank_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text of ``benchmark`` as a paragraph of a CoNLL-U file whose sentences are its sentences, written and read again."""
    rows = segment.base(benchmark(spark, sf_dir), "item_id", "text")
    sentences = F.transform(segment.sentences_of(rows), lambda s: F.concat(F.lit("# text = "), t.replace(s, r"\s+", " "), F.lit("\n1\t_\t_\n")))
    path = new_path(spark, "conllu")
    rows.select("doc_id", F.concat(F.lit("# newpar\n"), F.array_join(sentences, "\n")).alias("value")).write.partitionBy("doc_id").text(path)
    found = conllu_units(spark, path)
    return found.select(F.regexp_extract("unit_id", r"doc_id=(\d+)", 1).cast("long").alias("item_id"), F.size("sentences").cast("long").alias("sentences"), F.array_join("sentences", "|").alias("joined"))


SOURCES = {f.__name__: f for f in (text_files, text_column, sample_texts, json_sink, dictionary_source, treebank_source)}
