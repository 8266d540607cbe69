"""Best-fit packing by exact-complement hashing.

Pieces are packed by their lengths alone, so the problem is the histogram of lengths: at most ``capacity`` counts, whatever the size of the corpus. From
the longest length down, the gap that it leaves is looked up among the sums of one, two and three available lengths; a combination that fills
the gap exactly is used as often as the counts allow, at once. Where no combination fills the gap, the longest available length that fits goes
in (best fit) and the smaller gap is looked up. The sums of one, two and three lengths are indexed by the number of ways in which they come about, kept up as
lengths run out; a sum whose first combination fails its counts is tried with the next one.

The plan says, for each length, which of its pieces (by number) go where. Pieces get their numbers from the task that wrote them and the counts
of the tasks before it, so nothing is sorted, no task sees a whole length, and the only shuffle moves a few integers a piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import units
from weftline.llm.shared import small_batches, written


class _Lengths:
    """The counts of the lengths that are left, with the index of their sums.

    ``sums[m][g]`` is the number of ways to write g as m of the lengths that are left, in any order and each as often as one likes. A length that comes or goes
    changes the ways of m by those of m - 1, moved by the length, so the index is kept up by three additions of arrays. Counts are looked at where a sum is used.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.counts, self.capacity = {k: n for k, n in counts.items() if n}, capacity
        self.sums = np.zeros((4, capacity + 1), np.int64)
        self.sums[0, 0] = 1
        for k in self.counts:
            for m in (1, 2, 3):
                self.sums[m, k:] += self.sums[m - 1, : capacity + 1 - k]

    def take(self, k: int, n: int) -> None:
        self.counts[k] -= n
        if not self.counts[k]:
            del self.counts[k]
            for m in (3, 2, 1):
                self.sums[m, k:] -= self.sums[m - 1, : self.capacity + 1 - k]

    def longest(self, most: int) -> int:
        """The longest length that is left and is not over most; 0 if there is none."""
        left = self.sums[1, most::-1]
        at = int(left.argmax())
        return most - at if left[at] else 0

    def exact(self, gap: int, parts: int) -> tuple[int, ...]:
        """As many lengths as parts that add up to gap under the counts, the longer ones as long as can be; empty if there are none."""
        return self._exact(gap, parts, gap, ())

    def _exact(self, gap: int, parts: int, most: int, used: tuple[int, ...]) -> tuple[int, ...]:
        if not self.sums[parts, gap]:
            return ()
        if parts == 1:
            return (*used, gap) if gap <= most and self.counts[gap] > used.count(gap) else ()
        # the longest part of so many is at least their mean; the others must be a sum of the index
        low, high = -(-gap // parts), min(most, gap - parts + 1)
        if low > high:
            return ()
        ways = (self.sums[1, low : high + 1] > 0) & (self.sums[parts - 1, gap - high : gap - low + 1][::-1] > 0)
        for k in (low + np.flatnonzero(ways)[::-1]).tolist():
            if self.counts[k] > used.count(k) and (found := self._exact(gap - k, parts - 1, k, (*used, k))):
                return found
        return ()


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins for counts[length] pieces of each length: (bins alike, [(length, times)] in their order)."""
    left, out = _Lengths(counts, capacity), []
    while left.counts:
        first = left.longest(capacity)
        parts, gap, alike = [first], capacity - first, 0
        left.take(first, 1)
        while gap:
            more = left.exact(gap, 1) or left.exact(gap, 2) or left.exact(gap, 3) or ((left.longest(gap),) if left.longest(gap) else ())
            if not more:
                break
            for k in more:
                left.take(k, 1)
            parts += more
            gap -= sum(more)
        times = {k: parts.count(k) for k in dict.fromkeys(parts)}
        alike = min(left.counts.get(k, 0) // n for k, n in times.items())
        if alike:
            for k, n in times.items():
                left.take(k, n * alike)
        out.append((alike + 1, list(times.items())))
    return out


class Placement:
    """A plan as sorted arrays by length: from a piece's number in its length to its bin and offset."""

    def __init__(self, bins: list[tuple[int, list[tuple[int, int]]]]):
        runs: dict[int, list[tuple[int, int, int, int]]] = {}
        first, used = 0, {}
        for alike, parts in bins:
            offset = 0
            for length, times in parts:
                number = used.get(length, 0)
                runs.setdefault(length, []).append((number, first, times, offset))
                used[length] = number + alike * times
                offset += length * times
            first += alike
        self.bins = first
        self.runs = {k: np.array(v, np.int64) for k, v in runs.items()}

    def of(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for k in np.unique(length).tolist():
            own, runs = np.flatnonzero(length == k), self.runs[k]
            run = runs[np.searchsorted(runs[:, 0], number[own], "right") - 1]
            within = number[own] - run[:, 0]
            sequence[own] = run[:, 1] + within // run[:, 2]
            offset[own] = run[:, 3] + within % run[:, 2] * k
        return sequence, offset


PIECES = pa.schema([(n, t()) for n, t in (("doc_id", pa.int64), ("piece", pa.int32), ("start", pa.int64), ("length", pa.int64), ("ids_crc32", pa.int64), ("part", pa.int64), ("local", pa.int64))])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, local long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """The pieces of all documents, written: doc_id, piece, start, length, ids_crc32, and the piece's task and its number of that length there."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, seen = units.words(tokenizer), TaskContext.get().partitionId(), {}
        for doc_ids, texts in units.batches(batches):
            ids, each = own.encode_array(texts, end_id)
            n = -(-each // capacity)  # pieces of each document
            doc = np.repeat(np.arange(len(each)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(each[doc] - start, capacity)
            data, places = memoryview(ids).cast("B"), ((np.cumsum(each) - each)[doc] + start) * 4
            sums = [zlib.crc32(data[a : a + b]) for a, b in zip(places.tolist(), (length * 4).tolist(), strict=True)]
            local = []
            for k in length.tolist():
                local.append(seen.get(k, 0))
                seen[k] = local[-1] + 1
            columns = (doc_ids.take(pa.array(doc)), piece, start, length, sums, np.full(len(doc), part), local)
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, PIECES, strict=True)], schema=PIECES)
        units.release()

    return written(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, PIECES_DDL), "packing-pieces")


PLACED = pa.schema([*list(PIECES)[:5], ("sequence_id", pa.int64()), ("offset", pa.int64())])


def place(cut: DataFrame, capacity: int) -> DataFrame:
    """The pieces with sequence_id and offset."""
    by_task = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    # At most `capacity` rows come to the driver; the plan has a few runs for each of them.
    counts = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placement = Placement(plan(counts, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    numbered = cut.join(bases, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local")).alias("number"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = placement.of(batch.column(3).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], schema=PLACED)

    return numbered.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """Every piece of every document with its sequence and its offset there.

    Reads doc_id and text. Null text: only the end id. Null or repeated doc_ids: each row is a document of its own. Documents of over ``capacity`` ids are
    cut into pieces of that many, the last one shorter; others stay whole. An empty table gives an empty table. Among pieces of equal length, which
    one goes where depends on how the table is split into tasks; the number of sequences does not.
    """
    return place(pieces(docs, tokenizer, end_id, capacity), capacity)
