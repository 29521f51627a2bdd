"""The row-local operators on streams.

They are projections without state, so a streaming frame needs no watermark for them; what groups by document does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.segment import counts


def read_documents(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int = 16) -> DataFrame:
    """Parquet files that arrive in a folder, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The counts of each document as it arrives."""
    return counts(docs, id_col, text_col)


def windowed_totals(docs: DataFrame, time_col: str, text_col: str = "text", width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """window, documents and words of each time window; rows later than ``late`` are left out, as watermarks do."""
    from ..functions.text import text_or_empty, words

    rows = docs.withWatermark(time_col, late).select(F.window(time_col, width).alias("window"), F.size(words(text_or_empty(F.col(text_col)))).alias("n"))
    return rows.groupBy("window").agg(F.count("*").alias("documents"), F.sum("n").alias("words"))
