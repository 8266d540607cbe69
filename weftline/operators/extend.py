"""Relational operators that specifications have no words for; extensions, for use in bindings and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.storage import cut_lineage


def cube(df: DataFrame, by: list[str], made: list[Column]) -> DataFrame:
    """Aggregates for every subset of ``by``; grouping tells which columns are summed over."""
    return df.cube(*by).agg(F.grouping_id().alias("grouping"), *made)


def rollup(df: DataFrame, by: list[str], made: list[Column]) -> DataFrame:
    """Aggregates for every prefix of ``by``."""
    return df.rollup(*by).agg(F.grouping_id().alias("grouping"), *made)


def sessions(df: DataFrame, keys: list[str], at: str, gap_seconds: int) -> DataFrame:
    """df with session: rows of a key that are no more than the gap apart, numbered from 1. Times count by the nearest second, a half by the even one, as SQL's whole epoch does."""
    by = Window.partitionBy(*keys).orderBy(at)
    second = lambda c: F.rint(F.unix_micros(c.cast("timestamp")) / 1e6).cast("long")
    apart = second(F.col(at)) - second(F.lag(at).over(by)) > gap_seconds
    started = df.withColumn("_new", F.coalesce(apart.cast("int"), F.lit(1)))
    return started.withColumn("session", F.sum("_new").over(by.rangeBetween(Window.unboundedPreceding, 0))).drop("_new")


def top(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key; Spark limits each task's groups before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


#: Points and intervals of a cell are compared in blocks of about so many each; a task gets so many such comparisons, or so many rows.
BLOCK, BLOCKS_A_TASK, ROWS_A_TASK = 4096, 4, 500_000


def range_join(left: DataFrame, right: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Rows with low <= point < high, by equal cells. An interval stands at the level whose cells, width times a power of two, are as wide as it or wider, so in two cells at most, however wide it is; a point
    stands in one cell of each level that has intervals. No row pairs are tried across cells. In a cell with many rows, each block of points meets each of intervals under a key of its own, so that such a cell
    is many tasks' work, by the hash of a row; there are as many tasks as there is to compare. Nulls, and intervals that hold nothing, match nothing."""
    level = F.greatest(F.lit(0), F.ceil(F.log2((F.col(high) - F.col(low)) / width))).cast("int")
    held = right.where(F.col(low) < F.col(high)).withColumn("_level", level)
    levels = [r[0] for r in held.select("_level").distinct().collect()]  # powers of two: a few dozen at most
    cell = lambda c: F.floor(F.col(c) / (F.lit(width) * F.pow(F.lit(2.0), F.col("_level"))))
    spread = held.withColumn("_cell", F.explode(F.sequence(cell(low), cell(high))))
    every = F.array(*map(F.lit, levels)).cast("array<int>")
    points = left.where(F.col(point).isNotNull()).withColumn("_level", F.explode(every)).withColumn("_cell", cell(point))
    at = ["_level", "_cell"]
    sizes = cut_lineage(points.groupBy(*at).agg(F.count(F.lit(1)).alias("_points")).join(spread.groupBy(*at).agg(F.count(F.lit(1)).alias("_held")), at))
    whole = sizes.agg(F.sum(F.col("_points").cast("double") * F.col("_held")), F.sum(F.col("_points") + F.col("_held"))).first()
    tasks = 1 + int((whole[0] or 0) / (BLOCKS_A_TASK * BLOCK**2) + (whole[1] or 0) / ROWS_A_TASK)
    # cells of more than a block: one in BLOCK rows at most
    many = F.broadcast(sizes.where((F.col("_points") > BLOCK) | (F.col("_held") > BLOCK)).select(*at, F.ceil(F.col("_points") / BLOCK).alias("_ps"), F.ceil(F.col("_held") / BLOCK).alias("_hs")))

    def blocks(df: DataFrame, own: str, count: str, other: str, others: str) -> DataFrame:
        one, rest = F.lit(1).cast("long"), F.lit(0).cast("long")
        cut = df.join(many, at, "left").withColumn(own, F.pmod(F.xxhash64(*df.columns), F.coalesce(count, one)))
        return cut.withColumn(other, F.explode(F.sequence(rest, F.coalesce(others, one) - 1))).drop("_ps", "_hs").repartition(tasks, *at, "_p", "_h")

    met = blocks(points, "_p", "_ps", "_h", "_hs").join(blocks(spread, "_h", "_hs", "_p", "_ps").hint("merge"), [*at, "_p", "_h"])
    return met.where((F.col(low) <= F.col(point)) & (F.col(point) < F.col(high))).drop(*at, "_p", "_h")


def heavy_join(left: DataFrame, right: DataFrame, keys: list[str], salts: int) -> DataFrame:
    """An inner join whose left keys are dealt to ``salts`` tasks each; right rows are repeated for each."""
    salt = F.pmod(F.xxhash64(*left.columns), F.lit(salts))
    spread = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return left.withColumn("_salt", salt).join(spread, [*keys, "_salt"]).drop("_salt")
