"""SimHash fingerprints and near-duplicates by anchor-point covering.

Fingerprints that differ in at most three bits differ in at most one bit in one of their two halves of 32. For a half, the anchors are a covering
code: the Hamming code of 31 bits (every word is within one bit of exactly one codeword, covering radius 1) beside the free 32nd bit. A half is
replicated to every anchor within covering radius plus threshold, 1 + 1 = 2: a codeword's own half to 2 anchors, any other to 17. Of two halves that differ in one bit at
most, the nearest anchor of either is within 2 of both, so they meet there; pairs are compared with all 64 bits where they meet. There are 2**27 anchors a half, so
fingerprints that have nothing in common rarely meet.

Only distinct fingerprints are replicated: copies are one. At an anchor the comparison gives a spanning forest of its links, not all pairs: a group
of near copies gives as many edges as members. Components of these edges are those of all links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.components import components
from weftline.llm.shared import by_batch, drop_written, small_batches, written

#: Shingle hashes are the standard 64-bit XXH with this seed.
SEED = 42
#: Members of an anchor that are compared with all others at once, in rows of a block.
BLOCK = 2048


def fingerprint(text: str, words: int = 3) -> int:
    """Bit b is set if it is set in over half the hashes of the text's word shingles, repeats included; 0 for a text without words."""
    found = text.encode().lower().split()  # bytes: A-Z alone are lowered, and white space is the ASCII kind
    if not found:
        return 0
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)))) if len(found) >= words else [b" ".join(found)]
    return majority(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; 0 for none."""
    set_in = np.zeros(64, np.int64)
    for a in range(0, len(hashes), 8192):
        part = hashes[a : a + 8192].astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)
        set_in += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp, a signed 64-bit integer, for every whole text; null text: as an empty one."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def rows(doc_ids: list, texts: list) -> list[list]:
        found = [fingerprint(t or "", words) for t in texts]
        return [doc_ids, [x - (1 << 64) if x >> 63 else x for x in found]]

    named = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return named.mapInArrow(by_batch(rows, ["doc_id", "text"], schema), "doc_id long, fp long")


def syndrome(half: np.ndarray) -> np.ndarray:
    """Of the low 31 bits as a word of the Hamming code: 0 for a codeword, else 1 + the place of the bit that is off."""
    out = np.zeros(len(half), np.uint64)
    for place in range(31):
        out ^= (half >> np.uint64(place) & np.uint64(1)) * np.uint64(place + 1)
    return out


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) for every anchor within 2 of each 32-bit half: its nearest codeword; that with bit 32 flipped, if that is in reach; and
    the codewords two bits away: two places whose numbers' xor is the syndrome."""
    one, off = np.uint64(1), syndrome(half)
    nearest = np.where(off > 0, half ^ (one << (np.maximum(off, one) - one)), half)
    rows = np.arange(len(half))
    found_rows, found = [rows, rows], [nearest, nearest ^ np.uint64(1 << 31)]
    for place in range(1, 32):
        other = off ^ np.uint64(place)
        own = np.flatnonzero((off > 0) & (other > np.uint64(place)))
        found_rows.append(own)
        found.append(half[own] ^ (one << np.uint64(place - 1)) ^ (one << (other[own] - one)))
    return np.concatenate(found_rows), np.concatenate(found)


def _forest(values: list[np.ndarray], most: list[int]) -> Iterator[tuple[int, int]]:
    """Edges, as places, of a spanning forest of the links: from those not reached yet, the ones that link to what was reached last.

    Two places link if all their values differ in at most so many bits.
    """
    rest = np.arange(len(values[0]))
    while len(rest) > 1:
        front, rest = rest[:1], rest[1:]
        while len(front) and len(rest):
            nearest = np.full(len(rest), -1, np.int64)
            for a in range(0, len(front), BLOCK):
                for b in range(0, len(rest), BLOCK):
                    open_ = nearest[b : b + BLOCK]
                    close = _close(values, most, front[a : a + BLOCK, None], rest[None, b : b + BLOCK])
                    hit = close.any(axis=0) & (open_ < 0)
                    open_[hit] = a + close[:, hit].argmax(axis=0)
            linked = nearest >= 0
            yield from zip(rest[linked].tolist(), front[nearest[linked]].tolist(), strict=True)
            front, rest = rest[linked], rest[~linked]


def _close(values: list[np.ndarray], most: list[int], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    out = np.bitwise_count(values[0][i] ^ values[0][j]) <= most[0]
    for v, m in zip(values[1:], most[1:], strict=True):
        out &= np.bitwise_count(v[i] ^ v[j]) <= m
    return out


def links(nodes: DataFrame, views: list[str], most: int = 3, check: tuple[str, int] | None = None) -> DataFrame:
    """nodes(node, views..., check) to edges (a, b) of nodes that connect all that are linked.

    Two nodes link if in some view they differ in at most ``most`` bits (3 or fewer) and, if there is one, in the check column in at most so many. Equal views are
    fine: their nodes link.
    """
    if not 0 <= most <= 3:
        raise ValueError("two halves and anchors within 2 cover thresholds up to 3")
    bounds = [most] if check is None else [most, check[1]]
    carried = [] if check is None else [check[0]]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, *cols = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for view in range(len(views)):
                fp = cols[view].view(np.uint64)
                for side in (0, 1):
                    row, anchor = anchors(fp >> np.uint64(32 * side) & np.uint64(0xFFFFFFFF))
                    anchor |= np.uint64(2 * view + side << 32)
                    parts = [anchor.view(np.int64), node[row], cols[view][row], *(c[row] for c in cols[len(views) :])]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in parts], names=names)

    def edges(anchor: np.ndarray, node: np.ndarray, values: list[np.ndarray]) -> pa.RecordBatch | None:
        begins = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
        sizes = np.diff(np.concatenate((begins, [len(anchor)])))
        left, right = [], []
        for size in np.unique(sizes[sizes > 1]).tolist():
            runs = begins[sizes == size]
            if size <= 8:  # many small runs: all of a size at once
                for i in range(size):
                    for j in range(i + 1, size):
                        near = _close(values, bounds, runs + i, runs + j)
                        left.append(node[runs[near] + i])
                        right.append(node[runs[near] + j])
                continue
            for run in runs.tolist():
                if found := list(_forest([v[run : run + size] for v in values], bounds)):
                    left.append(node[[run + i for i, _ in found]])
                    right.append(node[[run + j for _, j in found]])
        if not left:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor; a run may span batches."""
        kept: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            cols = [np.concatenate(x) for x in zip(kept, cols, strict=True)] if kept else cols
            cut = int(np.searchsorted(cols[0], cols[0][-1]))
            if cut and (out := edges(cols[0][:cut], cols[1][:cut], [c[:cut].view(np.uint64) for c in cols[2:]])) is not None:
                yield out
            kept = [c[cut:] for c in cols]
        if kept and (out := edges(kept[0], kept[1], [c.view(np.uint64) for c in kept[2:]])) is not None:
            yield out

    names = ["anchor", "node", "fp", *carried]
    ddl = ", ".join(f"{n} long" for n in names)
    met = nodes.select("node", *views, *carried).mapInArrow(spread, ddl).repartition("anchor").sortWithinPartitions("anchor")
    return met.mapInArrow(compare, "a long, b long").where("a <> b").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, most: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id: the smallest doc_id that links reach, the row's own included.

    Reads doc_id and text. Texts without words (null or empty ones too) have fingerprint zero and are linked like any other. Repeated rows keep a row
    each. A null doc_id keeps its fingerprint; its component_id is the smallest doc_id there, null if there is none. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    marked = written(fingerprints(docs, words), "simhash")
    by_fp = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    linked = written(components(links(marked.select("fp", F.col("fp").alias("node")).distinct(), ["fp"], most)), "simhash-components")
    rooted = by_fp.join(linked.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return marked.join(named, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


#: Near copies among the pipeline's documents: sets of five-word shingles whose Jaccard similarity is 4/5 or more.
SHINGLE_WORDS, ALIKE = 5, (4, 5)
#: Candidates share a band of least hashes. A least hash is shared with the probability of the sets' similarity, whatever the edit, so that of pairs
#: 0.8 alike (1 - 0.8**5)**24 = 7e-5 share no band, and fewer of pairs that are more alike.
BANDS, BAND = 24, 5
#: Least hashes, of all, that candidates must share to be compared: pairs 0.8 alike share 96 on average, and fewer than this with a probability under 1e-5.
SHARED = 76
#: Texts of a block, by expectation: two blocks are compared in one task.
PAIRED = 1024
#: Words of 64 bits of a sieve: 2 MB of bits, some 10 MB as a broadcast table, whatever the corpus.
SIEVE = 1 << 18
_mix = np.random.default_rng(SEED)
_FACTORS, _TERMS = (_mix.integers(0, 1 << 64, (BANDS * BAND, 1), np.uint64) for _ in range(2))
_FACTORS |= np.uint64(1)


def shingle_set(text: str) -> np.ndarray:
    """The sorted distinct hashes of the text's five-word shingles; of a shorter text, of all its words; empty for a text without words."""
    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(found[i:] for i in range(SHINGLE_WORDS)))) if len(found) >= SHINGLE_WORDS else [b" ".join(found)]
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64))


def least_hashes(shingles: np.ndarray) -> np.ndarray:
    """For each of the hash functions the least value over the set, which is not empty."""
    out = np.full(BANDS * BAND, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 1024):
        out = np.minimum(out, (shingles[None, a : a + 1024] * _FACTORS + _TERMS).min(axis=1))
    return out


def _sketches(texts: DataFrame) -> DataFrame:
    """texts(node, text) to node, digest of the shingle set, n of its shingles, its fingerprint, sketch (a byte of each least hash) and the bands' keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, counts, prints, sketches, keys = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingle_set(text or "")
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                counts.append(len(found))
                prints.append(np.uint64(majority(found)).view(np.int64))
                least = least_hashes(found) if len(found) else np.zeros(0, np.uint64)
                sketches.append((least >> np.uint64(56)).astype(np.uint8).tobytes() if len(found) else b"")
                bands = least.reshape(-1, BAND)
                keys.append([xxhash.xxh64_intdigest(b.tobytes(), seed=i) - (1 << 63) for i, b in enumerate(bands)])
            cols = [batch.column(0), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(prints, pa.int64()), pa.array(sketches, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["node", "digest", "n", "fp", "sketch", "keys"])

    return texts.mapInArrow(run, "node long, digest binary, n long, fp long, sketch binary, keys array<long>")


def _likely(pairs: DataFrame) -> DataFrame:
    """pairs(a, b, na, nb, x, y) of counts and sketches to those (a, b), distinct, whose sets can be alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (2, 3))
                keep = pa.array((x == y).sum(axis=1) >= SHARED)
                yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], names=["a", "b"])

    over, under = ALIKE
    near = pairs.where(F.least("na", "nb") * under >= F.greatest("na", "nb") * over)
    return near.select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def jaccard_is_enough(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is ALIKE or more; in integers."""
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return ALIKE[1] * shared >= ALIKE[0] * (len(both) - shared)


def _sieved(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """rows without most of those whose key is not in wanted (one column): an exact join follows, which then moves few others.

    wanted becomes one bit for each hash of it, in SIEVE words of 64 bits at most, which is what is broadcast. Where wanted has as many members as there are bits, rows pass and the
    join does all the work.
    """
    member = wanted.columns[0]
    place = f"xxhash64({{0}}) & {SIEVE - 1}"
    bit = "shiftleft(1L, cast(shiftrightunsigned(xxhash64({0}), 40) & 63 AS int))"
    sieve = wanted.groupBy(F.expr(place.format(member)).alias("_word")).agg(F.expr(f"bit_or({bit.format(member)})").alias("_bits"))
    near = rows.withColumn("_word", F.expr(place.format(key))).join(F.broadcast(sieve), "_word")
    return near.where(F.expr(f"_bits & {bit.format(key)} <> 0")).select(*rows.columns)


def _repeated(texts: DataFrame) -> DataFrame | None:
    """The nodes of several rows; None if there are none."""
    found = written(texts.groupBy("node").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("node"), "near-repeated")
    return None if found.isEmpty() else found


def _sets(texts: DataFrame, wanted: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """texts(node, text) to (node, shingles), the sets of the wanted nodes, written: the only time that texts are moved. Rows that are repeated give one set."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])
    hashed = by_batch(lambda ids, found: [ids, [shingle_set(t or "").tobytes() for t in found]], ["node", "text"], schema)
    found = _sieved(texts, "node", wanted).join(wanted, "node")
    if repeated is not None:  # else no two rows can be equal, and the sets need not be moved to see that
        again = found.join(repeated, "node")
        found = found.join(repeated, "node", "left_anti").union(again.distinct())
    return written(found.mapInArrow(hashed, "node long, shingles binary"), "near-sets")


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b), written, to those whose shingle sets are alike enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [jaccard_is_enough(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in (0, 1)], names=["a", "b"])

    x, y = (_sieved(sets, "node", pairs.select(side)).toDF(side, value) for side, value in (("a", "x"), ("b", "y")))
    joined = pairs.join(x, "a").join(y, "b")
    return written(joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct(), "near-edges")


def _sharing_rare(rest: DataFrame, sets: DataFrame, about: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """rest(node, root, n), distinct, sets(node, shingles), of which only repeated nodes have several, and about(node, n, sketch) to likely pairs (a, b) of different roots, among them all whose sets
    are ALIKE but for what SHARED misses.

    Of sets with their shingles in one order, rarest first, two of n and m members that share o of them have their first common one at a place up to n - o in the
    one and m - o in the other; and ALIKE sets share 4/9 of n + m or more. So a set of n that has a shingle at place p is ALIKE only to sets of ``most`` = 9/4 (n - p) - n members or fewer. Where most < n for
    both sets of a pair neither can have the other's size, so a shingle is of use only if some set has it so early that most >= n: texts made from one form, each with words of its own
    on more than a ninth of its places, drop out here, however many they are. Shingles whose texts are all connected are left out too.

    The texts of a shingle are cut into blocks, and every pair of blocks is compared in one task, which gives pairs only where places, sizes and sketches fit.
    """
    over, under = ALIKE
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])
    lists = by_batch(lambda ids, found: [ids, [np.frombuffer(x, np.int64) for x in found]], ["node", "shingles"], schema)
    own = sets.join(rest.select("node"), "node").mapInArrow(lists, "node long, shingles array<long>")
    each = own.select("node", F.explode("shingles").alias("h"))
    each = written(each if repeated is None else each.distinct(), "near-shingles")
    counted = each.join(each.groupBy("h").agg(F.count(F.lit(1)).alias("df")), "h")
    place = F.row_number().over(Window.partitionBy("node").orderBy("df", "h")) - 1
    most = F.floor((F.col("n") - F.col("p")) * (over + under) / over) - F.col("n")
    early = counted.withColumn("p", place).join(rest, "node").where("df > 1").withColumn("most", most).where(F.col("most") * under >= F.col("n") * over)
    early = written(early.select("h", "node", "root", "n", "most"), "near-early")
    drop_written(each)
    useful = early.groupBy("h").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.max(F.col("most") - F.col("n")).alias("slack"), F.min("n").alias("low"), F.max("most").alias("top"), F.count(F.lit(1)).alias("met"))
    useful = useful.where("r <> s AND slack >= 0").select("h", "low", "top", F.ceil(F.col("met") / PAIRED).cast("int").alias("blocks"))
    met = early.join(useful, "h").where("most >= low AND n <= top").withColumn("own", F.pmod(F.xxhash64("node", "h"), F.col("blocks")).cast("int"))
    dealt = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    ends = dealt.select("h", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root", "n", "most")
    told = ends.join(about.select("node", "sketch"), "node").select("h", "i", "j", "own", "node", "root", "n", "most", "sketch")
    return told.repartition("h", "i", "j").sortWithinPartitions("h", "i", "j").mapInArrow(_paired, "a long, b long").distinct()


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h, i, j) to likely pairs within each of these groups; where i and j differ, across the two blocks alone."""
    kept: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        now = tuple(batch.column(k).to_numpy() for k in range(8)) + (np.frombuffer(b"".join(batch.column(8).to_pylist()), np.uint8).reshape(batch.num_rows, -1),)
        cols = tuple(np.concatenate(x) for x in zip(*kept, now, strict=True)) if kept else now
        h, i, j = cols[:3]
        edges = np.flatnonzero((h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        for start, stop in zip([0, *edges[:-1].tolist()], edges.tolist(), strict=False):
            yield from _group_pairs([c[start:stop] for c in cols[1:]])
        cut = int(edges[-1]) if len(edges) else 0
        kept = [tuple(c[cut:] for c in cols)]
    if kept:
        yield from _group_pairs(list(kept[0][1:]))


def _group_pairs(group: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    i, j, own, node, root, n, most, sketch = group
    over, under = ALIKE
    left = np.flatnonzero(own == i[0]) if i[0] != j[0] else np.arange(len(node))
    right = np.flatnonzero(own == j[0]) if i[0] != j[0] else left
    for at in range(0, len(left), 128):
        x = left[at : at + 128, None]
        y = right[None, :]
        fits = (n[y] <= most[x]) & (n[x] <= most[y]) & (root[x] != root[y]) & (np.minimum(n[x], n[y]) * under >= np.maximum(n[x], n[y]) * over)
        if i[0] == j[0]:
            fits &= x < y
        p, q = np.nonzero(fits)
        for k in range(0, len(p), 32768):
            a, b = left[at + p[k : k + 32768]], right[q[k : k + 32768]]
            near = (sketch[a] == sketch[b]).sum(axis=1) >= SHARED
            if near.any():
                a, b = node[a[near]], node[b[near]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs without near copies: of texts that are connected by links, the one of the smallest doc_id stays.

    Two texts link if the sets of their five-word shingles have a Jaccard similarity of 0.8 or more, computed from the sets. Candidates are those whose fingerprints of
    these shingles differ in 3 bits at most, found by anchors, which is what changes of single words leave; and, as a paragraph more or less changes more bits, bands of least hashes (see
    BANDS for what they miss). In each band every text is first compared with the one that shares most bands with others, which is the one that copies were made
    from where it is there. Where texts of a band are not connected then, those that share one of their rarest shingles are compared (see _sharing_rare), which leaves out
    no pair. A group of near copies thus costs as many comparisons as members, not all pairs; texts made from one form, which are less alike than that, drop out before they are paired.
    Rows that share a doc_id are one document and stay or go together; rows without one stay. Texts without words are copies of each other. All columns are kept.
    """
    small_batches(docs.sparkSession)
    texts = docs.where(docs["doc_id"].isNotNull()).select(docs["doc_id"].cast("long").alias("node"), docs["text"].alias("text"))
    marked = written(_sketches(texts), "near-sketches")
    # equal sets: one node, of the smallest id; the others go
    least = marked.groupBy("digest").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("copies"))
    nodes = written(marked.join(least, "digest").where("node = first").dropDuplicates(["node", "digest"]).select("node", "digest", "copies", "n", "fp", "sketch", "keys"), "near-nodes")
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    several = written(keyed.join(sizes, "key"), "near-several")
    degree = several.groupBy("node").agg(F.sum("size").alias("degree"))
    # the most met one; of several, the least id
    hubs = several.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", (-F.col("node")).alias("minus"))).alias("most")).select("key", (-F.col("most.minus")).alias("hub"))
    bands = written(several.select("key", "node").join(hubs, "key"), "near-bands")
    drop_written(several)
    about = nodes.select("node", "n", "sketch")

    def compared(pairs: DataFrame) -> DataFrame:
        """Edges among distinct pairs(a, b)."""
        known = pairs.join(about.toDF("a", "na", "x"), "a").join(about.toDF("b", "nb", "y"), "b")
        return _alike(written(_likely(known), "near-likely"), sets)

    stars = bands.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    near = written(stars.union(links(nodes.where("n > 0").select("node", "fp"), ["fp"])).distinct(), "near-candidates")
    # what can be compared at all: the members of bands, and what fingerprints link
    repeated = _repeated(texts)
    sets = _sets(texts, written(bands.select("node").union(near.select("a")).union(near.select("b")).distinct(), "near-wanted"), repeated)
    edges = compared(near)
    linked = written(components(edges), "near-components")
    rooted = bands.join(linked, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    apart = rooted.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("key")
    rest = written(rooted.join(apart, "key").select("node", "root").distinct().join(nodes.select("node", "n"), "node"), "near-rest")
    more = _alike(written(_sharing_rare(rest, sets, about, repeated).join(stars.union(stars.select("b", "a")), ["a", "b"], "left_anti"), "near-rare"), sets)
    if not more.isEmpty():
        linked = components(edges.union(more))
    copies = marked.join(nodes.where("copies > 1").select(F.col("node").alias("first"), "digest"), "digest").where("node <> first").select("node")
    gone = written(copies.union(linked.where("node <> root").select("node")).distinct(), "near-gone")
    return docs.join(gone, docs["doc_id"].cast("long") == gone["node"], "left_anti")
