"""Explicit order: dense numbers without a sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.storage import save

#: Rows of a range partition, about, and the fewest that are worth a task of their own where cores would be idle.
RANGE_ROWS = 1 << 17
FEWEST_ROWS = 1 << 13


def placed_rows(df: DataFrame, order: list[str | Column], rows_each: int) -> DataFrame:
    """df in range partitions of about rows_each rows, or fewer where that would leave cores without one, sorted and
    written, with at_part and at_row, a row's place in its partition."""
    rows = df.count()
    parts = max(1, -(-rows // rows_each), min(df.sparkSession.sparkContext.defaultParallelism, rows // FEWEST_ROWS))
    dealt = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return save(dealt.select("*", F.spark_partition_id().alias("at_part"), F.monotonically_increasing_id().alias("at_row")))


def number_in_order(df: DataFrame, order: list[str | Column], name: str, rows_each: int = RANGE_ROWS) -> DataFrame:
    """df, best a written table as it is read more than once, with `name`: 1, 2, 3 and so on in the given order.

    Spark samples splitters over all of the order, so that rows of one second, or of one host, spread over as many partitions
    as they need. Each partition is sorted and written; a row's number is its place there, and the number of rows in the
    partitions before, which are counted. Only these counts, a row per partition, meet in one window. Rows that are
    equal in all of the order keep the numbers that they got when the table was written."""
    placed = placed_rows(df, order, rows_each)
    counts = placed.groupBy("at_part").agg(F.count(F.lit(1)).alias("rows"), F.min("at_row").alias("first"))
    before = F.coalesce(F.sum("rows").over(Window.orderBy("at_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = counts.select(F.col("at_part").alias("of_part"), (before - F.col("first") + 1).alias("shift"))
    joined = placed.join(shifts, F.col("at_part") == F.col("of_part"))
    return joined.withColumn(name, (F.col("at_row") + F.col("shift")).cast("long")).drop("at_part", "at_row", "of_part", "shift")


def number_by_time(df: DataFrame, epoch: str, order: list[str | Column], name: str, rows_each: int = RANGE_ROWS) -> DataFrame:
    """number_in_order by epoch (null as 0) and then `order`."""
    return number_in_order(df, [F.coalesce(F.col(epoch), F.lit(0.0)), *order], name, rows_each)


def number_lines(lines: DataFrame) -> DataFrame:
    """lines (file, block, row) -> adds line_no from 1 within each file. `row` increases by one within a
    block, and blocks by their place in the file."""
    blocks = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("rows"), F.min("row").alias("first"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(F.col("file").alias("b_file"), F.col("block").alias("b_block"), "first", before.alias("lines_before"))
    joined = lines.join(blocks, (F.col("file") == F.col("b_file")) & (F.col("block") == F.col("b_block")))
    return joined.withColumn("line_no", F.col("lines_before") + F.col("row") - F.col("first") + 1).drop("b_file", "b_block", "first", "lines_before", "block", "row")
