"""Near duplicates among embeddings of a label: iterative quantisation, multi-index Hamming tables, and reranking with the original vectors.

Equal vectors of a label are one node with a count, so copies are never paired. On a bounded sample, vectors of length 1 are centred and turned to their principal axes, and rotations of
these are learned that make the signs balanced binary codes (Procrustes steps between codes and projections); several rotations from different starts give longer codes. The code is cut into
substrings, one for each Hamming table. Two vectors that share a substring meet in a bucket: every pair is found whose codes differ in fewer bits than there are tables, and others with the
probability that one substring is spared. The width of substrings grows with the logarithm of the largest label, and the number of tables is the least at which, of pairs made at
the threshold itself from sampled vectors, at most MISSED meet in none.

Buckets hold node ids. Only where two or more nodes meet are vectors joined; a bucket of many is cut into blocks of BLOCK nodes at most by expectation, and every pair of blocks is a
group of its own, so no task holds a bucket and no row is a pair: a group gives a row for each node with its number of links and a node that it is connected with. A pair that meets in several
tables is counted in the first. Links are decided by the cosine of the originals in double precision. Components come from rounds of stars over these edges.

A node's vector moves once for each table in which it meets another node, and once more for each further block of its bucket; the links of a group of n nodes that are all alike are n * n
products, since each is counted, but n rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from weftline.llm.components import components
from weftline.llm.shared import drop_written, written

#: Bytes of vectors that codes are learned on at most (16384 of 64 components), rows at most; pairs at the threshold that no table may find.
SAMPLE_BYTES, SAMPLE_ROWS, MISSED = 1 << 22, 16_384, 0.001
BITS, STEPS, TABLES, BLOCK, SEED = 64, 30, 48, 1024, 11


@dataclass
class Codes:
    """For vectors of one length: mean, planes (a column a bit) and the width of a table's substring. Tables are whole runs of bits of one rotation."""

    mean: np.ndarray
    planes: np.ndarray
    width: int
    tables: int

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """The substrings, a row per vector and a column per table."""
        bits = ((unit - self.mean) @ self.planes[:, : self.width * self.tables]) >= 0
        weights = np.int64(1) << np.arange(self.width, dtype=np.int64)
        return bits.reshape(len(unit), self.tables, self.width) @ weights


def units(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; the greatest component is taken out first, so that no square overflows or vanishes."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def learn(unit: np.ndarray, width: int, threshold: float, seed: int = SEED) -> Codes:
    """Codes for vectors like the sampled ones: of substrings as wide as wanted, narrower where TABLES tables of that width miss too many pairs at the threshold."""
    draw = np.random.default_rng(seed)
    size = unit.shape[1]
    mean = unit.mean(axis=0) if len(unit) else np.zeros(size)
    centred = unit - mean
    _, axes = np.linalg.eigh(centred.T @ centred) if len(unit) else (None, np.eye(size))
    axes = axes[:, ::-1][:, : min(size, BITS)]
    flat = centred @ axes
    width = max(1, min(width, axes.shape[1]))
    each = axes.shape[1] // width  # tables of a rotation
    planes = []
    for _ in range(-(-TABLES // each)):
        turn = np.linalg.qr(draw.normal(size=(axes.shape[1],) * 2))[0]
        for _ in range(STEPS if len(flat) > 1 else 0):
            left, _, right = np.linalg.svd(np.where(flat @ turn >= 0, 1.0, -1.0).T @ flat)
            turn = right.T @ left.T
        planes.append((axes @ turn)[:, : each * width])
    codes = Codes(mean, np.concatenate(planes, axis=1), width, TABLES)
    if len(unit):
        some = unit[draw.permutation(len(unit))[:1000]]
        met = np.zeros((2, len(some), TABLES), bool)
        for i, other in enumerate((draw.normal(size=some.shape), some[draw.permutation(len(some))] - some)):  # any direction; a direction of the data
            other = other - (other * some).sum(axis=1, keepdims=True) * some
            length = np.sqrt((other * other).sum(axis=1, keepdims=True))
            near = threshold * some + math.sqrt(1 - threshold**2) * other / np.where(length > 1e-9, length, 1.0)
            met[i] = codes.keys(some) == codes.keys(near)
        missed = 1.0 - np.logical_or.accumulate(met, axis=2).mean(axis=1).min(axis=0)  # with the first 1, 2, ... tables
        enough = np.flatnonzero(missed <= MISSED)
        if not len(enough) and width > 1:
            return learn(unit, width - 1, threshold, seed)
        codes.tables = int(enough[0]) + 1 if len(enough) else TABLES
    return codes


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and e of rows that can link: neither null, and e with a component that is not zero and none null or not finite."""
    of = vectors.schema["embedding"].dataType.elementType
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<float>" if isinstance(of, FloatType) else "array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where("vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL").where(finite & F.exists("e", lambda x: x != 0))


def _matrix(column: pa.Array, kind: str, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), size)


def _links(unit: np.ndarray, keys: np.ndarray, table: int, same: np.ndarray, count: np.ndarray, side: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For the nodes of a group: links counted here, weighted by count, and the least node that each is connected with in the group. side: the block of each, where only
    pairs across blocks are the group's. same: what must be equal besides, so that buckets whose names collide stay apart."""
    n = len(unit)
    linked = np.zeros((n, n), bool)
    total = np.zeros(n, np.int64)
    for at in range(0, n, 256):
        rows = slice(at, at + 256)
        near = unit[rows] @ unit.T >= threshold
        near &= (keys[rows, table, None] == keys[None, :, table]) & (same[rows, None] == same[None, :])
        near[np.arange(near.shape[0]), np.arange(at, at + near.shape[0])] = False
        if side is not None:
            near &= side[rows, None] != side[None, :]
        linked[rows] = near
        for earlier in range(table):
            near &= keys[rows, earlier, None] != keys[None, :, earlier]
        total[rows] = near @ count
    least = np.arange(n)
    while True:
        new = least.copy()
        for at in range(0, n, 256):
            rows = slice(at, at + 256)
            new[rows] = np.minimum(new[rows], np.where(linked[rows], least[None, :], n).min(axis=1))
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, least):
            return total, least
        least = new


def _compare(codes: dict[int, Codes], spare: tuple[int, float], kind: str, threshold: float):
    """For mapInArrow over rows sorted by bucket: node, links (of it, counted here), least (a node that it is connected with) for nodes with a link."""

    def group(rows: list[tuple]) -> Iterator[tuple[int, int, int]]:
        table, size = rows[0][1], rows[0][2]
        unit = units(np.frombuffer(b"".join(r[8] for r in rows), kind).reshape(len(rows), size))
        keys = _codes(codes, size, spare).keys(unit)
        label = np.array([r[3] for r in rows])
        side = np.array([r[4] for r in rows]) if rows[0][5] != rows[0][6] else None
        order = np.argsort([r[7] for r in rows])
        total, least = _links(unit[order], keys[order], table, label[order], np.array([r[9] for r in rows])[order], None if side is None else side[order], threshold)
        nodes = np.array([r[7] for r in rows])[order]
        for i in np.flatnonzero((total > 0) | (least != np.arange(len(nodes)))).tolist():
            yield int(nodes[i]), int(total[i]), int(nodes[least[i]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name = (row[0], row[1], row[2], row[5], row[6])
                if name != now:
                    if len(rows) > 1:
                        out += group(rows)
                    now, rows = name, []
                rows.append(row)
            if out:
                yield _rows(out)
        if len(rows) > 1 and (out := list(group(rows))):
            yield _rows(out)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["node", "links", "least"])


def _codes(codes: dict[int, Codes], size: int, spare: tuple[int, float]) -> Codes:
    """The codes for a length of vector; a length that the sample lacks gets planes that depend on its size alone."""
    if size not in codes:
        codes[size] = learn(np.zeros((0, size)), *spare)
    return codes[size]


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept, and label: one row for each row. Vectors of equal labels and length link at a cosine of threshold or more.

    n_links: other rows linked directly, copies included; component_id: the smallest vec_id reachable by links, itself included; kept: whether that is its own. A row whose label or
    vector is null, zero or not finite links with nothing and is its own component; so does one without a vec_id, whose component is null and which is not kept. Rows that
    share a vec_id are rows of their own; extra columns are not read; an empty table gives an empty one.
    """
    rows = usable(vectors)
    kind = "<f4" if isinstance(rows.schema["e"].dataType.elementType, FloatType) else "<f8"
    classes = rows.groupBy("label", "e").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    distinct = written(classes.select(F.monotonically_increasing_id().alias("node"), "label", "e", "least", "n"), "vectors-distinct")
    of = written(rows.join(distinct, ["label", "e"]).select("vec_id", "label", "node"), "vectors-of")
    largest = distinct.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    width = max(4, min(40, math.ceil(math.log2(largest + 1)) + 1))
    length = distinct.agg(F.avg(F.size("e"))).first()[0] or 1.0
    most = int(min(SAMPLE_ROWS, max(256, SAMPLE_BYTES // (4 * length))))
    sample: dict[int, list] = {}
    for r in distinct.select("e", "node").orderBy(F.xxhash64("e"), "node").limit(most).collect():
        sample.setdefault(len(r.e), []).append(r.e)
    codes = {size: learn(units(np.array(x)), width, threshold) for size, x in sample.items() if len(x) >= 2 * size or len(sample) == 1}
    spare = (width, threshold)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(x) for x in batch.column(1)], np.int64)
            exact, keys = [b""] * len(sizes), [None] * len(sizes)
            for size in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == size)
                flat = batch.column(1).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(at), size)
                found = _codes(codes, size, spare).keys(units(flat))
                for i, row, key in zip(at.tolist(), flat, found.tolist(), strict=True):
                    exact[i], keys[i] = row.tobytes(), key
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(exact, pa.binary()), pa.array(sizes, pa.int32()), batch.column(2), batch.column(3), pa.array(keys, pa.list_(pa.int64()))],
                names=["node", "exact", "size", "n", "of", "keys"],
            )

    named = distinct.select("node", "e", "n", F.xxhash64("label").alias("of"))
    coded = written(named.mapInArrow(encode, "node long, exact binary, size int, n long, of long, keys array<bigint>"), "vectors-coded")
    placed = coded.select("node", "size", "of", F.posexplode("keys").alias("place", "key"))
    bucket = ["size", "of", "place", "key"]
    shared = placed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("met")).where("met > 1")
    blocks = F.ceil(F.col("met") / block).cast("int")
    own = F.pmod(F.xxhash64("node", "place"), F.col("blocks")).cast("int")
    dealt = placed.join(shared, bucket).withColumn("blocks", blocks).withColumn("own", own)
    spread = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    ends = spread.select("node", F.xxhash64(*bucket).alias("bucket"), "place", "size", "of", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    met = ends.join(coded.select("node", "exact", "n"), "node").select("bucket", "place", "size", "of", "own", "i", "j", "node", "exact", "n")
    ordered = met.repartition("bucket", "place", "size", "i", "j").sortWithinPartitions("bucket", "place", "size", "i", "j")
    found = written(ordered.mapInArrow(_compare(codes, spare, kind, threshold), "node long, links long, least long"), "vectors-links")
    drop_written(coded)
    roots = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")))
    counted = distinct.select("node", "least", "n").join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(roots, "node", "left")
    counted = counted.select("node", "least", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    first = counted.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = of.join(counted.join(first, "root").select("node", "n_links", "component_id"), "node").select("vec_id", "label", "n_links", "component_id")
    alone = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", "embedding")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    out = alone.where(~F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine, F.lit(False)))
    rest = out.select("vec_id", "label", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
