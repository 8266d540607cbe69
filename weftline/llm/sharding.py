"""Sharding by a hierarchical weighted hash tree.

A row's key descends region, rack and shard. At each level every child draws ln(u) / weight, u being a hash of
the key and the child's name, and the largest draw wins, so a child is chosen in proportion to its weight. A
changed weight changes only that child's own draw: rows move only into or out of subtrees whose weights change.

One more shard takes rows only into itself (law ``key``), from any count of shards:

- Of the tree's shards, the ones past the count are closed. A row that draws a closed one draws again from the top, with draws of its own for each
  attempt; a row whose TRIES attempts all found closed shards takes the best of direct draws of the open ones. A shard that opens takes the rows whose
  first open shard it now is.
- A shard past the tree has a place in the next rack, and its draw is the part of its region's draw that it brought: a region's draw is the best of what it
  had and what its new shards add, and a row that a region wins by such a part goes to the shard that brought it, through its rack. Were it drawn
  by the region's new weight alone, the region would win rows that then land on its old shards.

All is DataFrame expressions: 9 draws a row for 24 shards, and no shuffle for the placement.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.shared import written

#: Rows of a shard are numbered in this many buckets, so that no task ever holds a whole shard.
BUCKETS, CHUNK = 1024, 1 << 14
#: Descents of a row before it draws among the open shards directly, where the tree has closed ones.
TRIES = 4


@dataclass(frozen=True)
class ShardTree:
    """weights[region][rack][shard] of the tree; open: how many of its shards are there; grown: (shard, weight) of each later shard, in order."""

    weights: tuple[tuple[tuple[float, ...], ...], ...]
    open: int | None = None
    grown: tuple[tuple[int, float], ...] = ()

    @property
    def founded(self) -> int:
        return sum(len(rack) for region in self.weights for rack in region)

    @property
    def shards(self) -> int:
        return (self.founded if self.open is None else self.open) + len(self.grown)

    def grow(self, weight: float = 1.0) -> ShardTree:
        """The tree with one more shard: the next closed one, or one past the tree."""
        if self.shards < self.founded:
            return replace(self, open=self.shards + 1)
        return replace(self, grown=(*self.grown, (self.shards, weight)))


def tree_of(shards: int, founding: int = 24, racks: int = 2, per_rack: int = 4) -> ShardTree:
    """The tree that a shard count stands for: ``founding`` shards in regions of racks x per_rack, of which some are closed or after which some have grown."""
    if shards < 1:
        raise ValueError("a tree needs a shard at least")
    size = racks * per_rack
    regions = tuple(
        tuple(tuple(1.0 for _ in range(b, min(b + per_rack, a + size, founding))) for b in range(a, min(a + size, founding), per_rack))
        for a in range(0, founding, size)
    )
    tree = ShardTree(regions, open=min(shards, founding))
    for _ in range(shards - founding):
        tree = tree.grow()
    return tree


def address(shard: int, tree: ShardTree) -> tuple[int, int]:
    """The region and rack of a shard; those past the tree fill regions like its first one."""
    first = 0
    for r, region in enumerate(tree.weights):
        for k, rack in enumerate(region):
            first += len(rack)
            if shard < first:
                return r, k
    racks, per_rack = len(tree.weights[0]), len(tree.weights[0][0])
    past = shard - first
    return len(tree.weights) + past // (racks * per_rack), past // per_rack % racks


def _draw(key: Column, name: str, weight: float) -> Column:
    """ln(u) / weight; u is in (0, 1) and takes 52 bits of the md5 of name and key."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{name}/"), key)), 1, 13), 16, 10).cast("double")
    return F.log((bits + F.lit(0.5)) / F.lit(float(2**52))) / F.lit(float(weight))


def _pick(draws: list[tuple[Column, Column]]) -> Column:
    """The value of the largest draw; of equal draws, the largest value."""
    if len(draws) == 1:
        return draws[0][1]
    return F.greatest(*(F.struct(d.alias("draw"), v.alias("value")) for d, v in draws))["value"]


def _descent(key: Column, tree: ShardTree, again: str = "") -> tuple[list[tuple[Column, Column]], Column]:
    """The regions' draws, and the shard of the tree that a key descends to; the subtree below a region is only evaluated where that region won."""
    shard, tops, below = 0, [], []
    for r, region in enumerate(tree.weights):
        racks = []
        for k, rack in enumerate(region):
            leaves = [(_draw(key, f"{again}shard{shard + i}", w), F.lit(shard + i)) for i, w in enumerate(rack)]
            shard += len(rack)
            racks.append((_draw(key, f"{again}rack{r}.{k}", sum(rack)), _pick(leaves)))
        tops.append((_draw(key, f"{again}region{r}", sum(map(sum, region))), F.lit(r)))
        below.append(_pick(racks))
    best, found = _pick(tops), below[-1]
    for r in range(len(below) - 2, -1, -1):
        found = F.when(best == r, below[r]).otherwise(found)
    return tops, found


def shard_of(key: Column, tree: ShardTree) -> Column:
    """The shard of a key; a null key is a key of its own."""
    key = F.coalesce(key.cast("string"), F.lit("null"))
    tops, found = _descent(key, tree)
    if tree.shards < tree.founded:
        flat = [w for region in tree.weights for rack in region for w in rack][: tree.shards]
        tries = [found, *(_descent(key, tree, f"{t}/")[1] for t in range(1, TRIES))]
        found = _pick([(_draw(key, f"last/shard{s}", w), F.lit(s)) for s, w in enumerate(flat)])
        for shard in reversed(tries):
            found = F.when(shard < tree.shards, shard).otherwise(found)
    if not tree.grown:
        return found
    # the parts of the regions' draws that the grown shards brought; -1: the part that the tree had
    best = _pick([*((d, F.lit(-1)) for d, _ in tops), *((_draw(key, f"grown{s}", w), F.lit(s)) for s, w in tree.grown)])
    return F.when(best < 0, found).otherwise(best)


def with_slots(df: DataFrame, shard: str, order: list[str]) -> DataFrame:
    """df and slot: gapless from 0 within each shard, in BUCKETS runs of hashed rows; within a run, by ``order``.

    Rows that agree in shard and order share a bucket and are numbered as one run of equal rows: they are counted before the shuffle and
    expanded after it, so a third of all rows being the same row is one row here. df's columns are shard and order.
    """
    counted = df.groupBy(shard, *order).agg(F.count(F.lit(1)).alias("_n"))
    spread = written(counted.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(BUCKETS)).cast("int")), "shard-rows")  # used twice; the rows are read once
    in_bucket = Window.partitionBy(shard, "_b").orderBy(*(F.col(c).asc_nulls_first() for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    numbered = spread.withColumn("_from", F.coalesce(F.sum("_n").over(in_bucket), F.lit(0)))
    before = Window.partitionBy(shard).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bases = spread.groupBy(shard, "_b").agg(F.sum("_n").alias("_m")).select(shard, "_b", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_base"))
    # a row's slots in runs of CHUNK: no array grows with how often it repeats
    runs = numbered.join(bases, [shard, "_b"]).select(shard, *order, (F.col("_base") + F.col("_from")).alias("_first"), "_n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(CHUNK).cast("long"))).alias("_c"))
    last = F.least(F.col("_c") + CHUNK, F.col("_n")) - 1
    return runs.select(shard, *order, F.explode(F.sequence(F.col("_first") + F.col("_c"), F.col("_first") + last)).alias("slot"))


def place(docs: DataFrame, shards: int = 24, founding: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row's shard, slot and the shard it would have with one more shard.

    docs needs key and text; other columns, whatever their names, are not read. Null text: no bytes and the checksum of
    an empty string. Null key: one key of its own. Repeated rows: same shard, slots of their own. An empty table gives an empty table.
    """
    tree = tree_of(shards, founding)
    text = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(docs[key].alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    # The draws read the key alone; slots are numbered first, so that the draws run once a distinct row.
    placed = rows.withColumn("shard", shard_of(F.col("doc_id"), tree).cast("int"))
    return with_slots(placed, "shard", ["doc_id", "size", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot",
        shard_of(F.col("doc_id"), tree.grow()).cast("int").alias("grown_shard"),
    )
