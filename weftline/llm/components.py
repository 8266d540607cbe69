"""Connected components of a graph whose edges are rows, by large-star and small-star rounds.

In a large-star round every node links its larger neighbours to the least node it knows; in a small-star round its smaller ones. Both keep the
components and soon leave a star around each least node. A round is two aggregations: the least neighbour comes from a map-side combined
minimum, and a node of very many neighbours is never gathered in one place. Each round's edges are a written table, so lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import drop_written, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """a, b with a > b in, the same out. Large: from each node v, its neighbours over v go to the least of v and its neighbours. Small:
    v and its neighbours under v go to the least of those."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(a, b) of longs to (node, root): the least node that each node of an edge reaches. Loops and repeated edges are fine; nodes
    without edges have no row."""
    tidy = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = written(tidy, "components")
    marks = None
    for _ in range(rounds):
        new = written(_star(_star(now, True).distinct(), False).distinct(), "components")
        drop_written(now)
        now = new
        row = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first()
        if tuple(row) == marks:
            break
        marks = tuple(row)
    else:
        raise RuntimeError("components did not settle")
    # Settled: each a has one b, its root. Roots have no row of their own.
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
