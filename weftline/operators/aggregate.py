"""Aggregates that specifications describe in prose and Spark has no single function for: to be used in bindings and as operators of their own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.storage import cut_lineage


def mode(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and the value that comes most often, of several the least; nulls are no values, and a key that has only nulls gets null. Values are counted before they are compared, so no group is gathered."""
    n = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    return n.groupBy(*keys).agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.struct(-F.col("_n"), value))).alias(value))


def counted_if(df: DataFrame, keys: list[str], conditions: dict[str, Column], values: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """keys, how many rows meet each condition, and for each of values (condition, value) the sum over the rows that meet it, 0 where none does; all in one aggregation."""
    counts = [F.count_if(c).alias(n) for n, c in conditions.items()]
    sums = [F.coalesce(F.sum(F.when(c, v)), F.lit(0)).alias(n) for n, (c, v) in (values or {}).items()]
    return df.groupBy(*keys).agg(*counts, *sums)


def tiles(df: DataFrame, order: list[str], n: int, tile: str = "tile") -> DataFrame:
    """df with the number from 1 to n of the equal part that a row falls in, in an order over all rows, without a sort in one task: a range partition's rows are numbered there, and begin after
    those of the ranges before it. Rows alike in the whole order may fall either way; give an order that tells them apart."""
    cut = cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = cut.groupBy("_part").agg(F.count(F.lit(1)).alias("_m"))  # one row a partition
    so_far = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("_part", F.coalesce(F.sum("_m").over(so_far), F.lit(0)).alias("_before"), F.sum("_m").over(Window.partitionBy(F.lit(1))).alias("_all"))
    placed = cut.withColumn("_r", F.row_number().over(Window.partitionBy("_part").orderBy(*order))).join(before, "_part")
    return placed.select(*df.columns, (F.floor((F.col("_before") + F.col("_r") - 1) * n / F.col("_all")) + 1).cast("long").alias(tile))


def trailing(df: DataFrame, keys: list[str], day: str, made: dict[str, Column], days: int) -> DataFrame:
    """keys, day and each aggregate's sum over so many days up to that one: made are aggregates that add up over days, and a day's are made before days are put in order, so that a hot key is as many
    rows as it has days. Days without rows are no results."""
    per = df.groupBy(*keys, day).agg(*(c.alias(n) for n, c in made.items()))
    by = Window.partitionBy(*keys).orderBy(F.unix_date(day)).rangeBetween(1 - days, 0)
    return per.select(*keys, day, *(F.sum(n).over(by).alias(n) for n in made))


def by_position(lists: dict[str, Column], rows: DataFrame, keep: list[str], place: str = "place") -> DataFrame:
    """A row for each place (from 1) of several lists side by side, null where a list has ended."""
    zipped = F.arrays_zip(*(c.alias(n) for n, c in lists.items()))
    named = rows.select(*keep, zipped.alias("_z"))
    return named.select(*keep, F.posexplode("_z").alias("_p", "_e")).select(*keep, (F.col("_p") + 1).alias(place), *(F.col(f"_e.{n}").alias(n) for n in lists))
