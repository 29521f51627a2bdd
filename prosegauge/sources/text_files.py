"""Whole text files, or a text column of any table, as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def documents_from_files(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".txt", ".md")) -> DataFrame:
    """doc_id (the file's path) and text of each file under ``path`` with one of the suffixes; one row a file."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text"))
    kept = F.lit(False)
    for s in suffixes:
        kept = kept | F.endswith(F.lower("doc_id"), F.lit(s))
    return rows.filter(kept)


def documents_from_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
