"""Places of rows in an order of all rows, without bringing them to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import save


def global_index(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Add ``name``: the row's place (from 0) in the order of all rows.  Only one count per partition reaches the driver."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = save(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "ranged")
    at, starts = 0, {}
    for part, count in sorted(map(tuple, dealt.groupBy("_part").count().collect())):
        starts[part], at = at, at + count
    if not starts:
        return dealt.withColumn(name, F.lit(0).cast("long")).drop("_part")
    base = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in starts.items() for x in kv]), F.col("_part").cast("long"))
    return dealt.withColumn(name, base + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1).drop("_part")
