"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ranks import global_index  # noqa: F401
from ..storage import SLICE_BYTES, bounded, own_dir, save, small_batches  # noqa: F401

pa.set_memory_pool(pa.system_memory_pool())

#: Hash cells into which each key is dealt before rows are ranked.
CELLS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct ``_row``, out of the way of an operator's own names."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


def row_columns(names: Sequence[str]) -> list[Column]:
    """Columns of ``_row`` by name."""
    return [F.col("_row").getField(c).alias(c) for c in names]


def null_key(c: Column) -> Column:
    """A string that is never null and differs for different values, null included; keeps their order, null first."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def ranked(df: DataFrame, keys: Sequence[str], h: Column, ties: Sequence[Column], name: str, counted: DataFrame | None = None) -> DataFrame:
    """Add ``name``: the row's place (from 0, gapless) among the rows of its key, in the order of hash ``h``.

    A key's rows are dealt to ``CELLS`` ranges of the hash.  Cells are counted first (with partial sums), windows over
    64 blocks of 64 counts give where each cell begins, and rows are ranked within a cell only, so a key that holds a
    third of all rows is still spread over many tasks.  Keys must not be null.  ``counted``: a narrower
    frame with the same keys and ``_h``, for the counting pass.
    """
    keys = list(keys)
    cell = lambda c: F.shiftrightunsigned(c, 52)
    rows = df.withColumn("_h", h).withColumn("_cell", cell(F.col("_h")).cast("int"))
    few = (rows if counted is None else counted.withColumn("_cell", cell(F.col("_h")).cast("int"))).select(*keys, "_cell")
    block = F.col("_cell").bitwiseAND(F.lit(-64)).alias("_block")  # 64 blocks of 64 cells
    counts = save(few.groupBy(*keys, "_cell").agg(F.count("*").alias("_n")).select("*", block), "cells")
    before = lambda by, order: F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = counts.groupBy(*keys, "_block").agg(F.sum("_n").alias("_n")).select(*keys, "_block", before(keys, "_block").alias("_base"))
    starts = counts.withColumn("_start", before([*keys, "_block"], "_cell")).join(blocks, [*keys, "_block"]).select(*keys, "_cell", (F.col("_base") + F.col("_start")).alias("_start"))
    within = Window.partitionBy(*keys, "_cell").orderBy("_h", *ties)
    out = rows.join(starts, [*keys, "_cell"]).withColumn(name, F.col("_start") + F.row_number().over(within) - 1)
    return out.drop("_h", "_cell", "_start")


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows whose ``m`` is at least the least bound that no more than ``most`` rows meet: told from a histogram of
    m, four cells to a power of two, so nothing is sorted."""
    cell = F.floor(F.log2(F.col("m").cast("double")) * 4)
    cells = sorted(((r["cell"], r["rows"], r["least"]) for r in counts.filter("m > 0").groupBy(cell.alias("cell")).agg(F.count("*").alias("rows"), F.min("m").alias("least")).collect()), reverse=True)
    bound, rows = None, 0
    for _, some, least in cells:
        if rows + some > most:
            break
        rows, bound = rows + some, least
    return counts.filter(F.col("m") >= bound) if bound is not None else counts.limit(0)


def keyed_join(rows: DataFrame, facts: DataFrame, key: str, hot: int = 1000) -> DataFrame:
    """``rows`` with the one row of ``facts`` for their ``key``.  The facts of keys that hold over 1 / ``hot`` of the rows,
    fewer than ``hot``, are broadcast; the others meet their rows in a shuffle."""
    counts = save(rows.groupBy(key).agg(F.count("*").alias("_n")), "keys")
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    large = save(counts.filter(F.col("_n") > max(1000, total / hot)).select(key), "hot")
    if large.isEmpty():
        return rows.join(facts, key)
    held = F.broadcast(save(facts.join(F.broadcast(large), key), "hot_facts"))
    return rows.join(held, key).unionByName(rows.join(F.broadcast(large), key, "left_anti").join(facts, key))


def text_slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text; a longer single text is a slice of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    a, n = 0, batch.num_rows
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        # a copy from offset 0: some Arrow kernels go wrong on a cast slice
        yield batch if b - a == n else batch.take(pa.array(np.arange(a, b)))
        a = b


def map_slices(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text_at: int = 1) -> DataFrame:
    """``mapInArrow`` with ``fn`` applied to bounded slices of each batch; string columns are 64-bit offset safe per slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for part in text_slices(batch, text_at):
                    out = fn(part)
                    if out is not None and out.num_rows:
                        yield out

    return small_batches(df).mapInArrow(run, schema)


def filter_slices(df: DataFrame, text: str, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of ``df`` for whose texts ``keep`` says so, in bounded slices."""
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for part in text_slices(batch, at):
                    out = part.filter(pa.array(keep(texts_of(part.column(at)))))
                    if out.num_rows:
                        yield out

    return small_batches(df).mapInArrow(run, df.schema)


def texts_of(column: pa.Array) -> pa.Array:
    """Null texts are empty ones."""
    return pc.fill_null(column, "")


def joined_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts of a slice, one after another, and the n + 1 places where texts begin or end."""
    column = pa.array(column, pa.large_string()) if not pa.types.is_large_string(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def sums_between(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of ``values`` in each piece that ``ends`` (n + 1 places) marks; 0 for empty pieces."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)])
    return total[ends[1:]] - total[ends[:-1]]
