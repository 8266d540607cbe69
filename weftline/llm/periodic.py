"""Periodic runs of words, by a suffix automaton with small-to-large merging of ordered end-position sets.

A run is a stretch of consecutive words with smallest period q that is at least ``times`` periods and ``least`` words long and that no neighbouring word extends.

A state of the automaton stands for the strings of words that end at the same places. From the longest states to the shortest, each state's ordered set of end positions
is merged into its suffix link's, the smaller one into the larger. Two positions that become neighbours at a distance d not over the state's length are the
ends of two overlapping or touching occurrences: a square of period d, which seeds a run and is extended to both sides. A run of period q and length L is met: its part of
length L - q occurs twice at distance q, as neighbours, in a state at least that long. So only seeds with (times - 1) * d <= length are needed, and states that are
too short for any are not merged.

Before an automaton is built, words are cut out that can be in no run: inside a run of period q each word but the last q meets itself again within q words, so a run
of period from 2**k on lies in a stretch of at least (times - 1) * 2**k words with a next occurrence under 2**(k + 1) words away, and the words just after it.
These stretches are found by array operations, and each maximal union of them gets an automaton of its own. The cut is exact; seeds are extended in the whole text.

Work is n log n steps in a text's n words (an insertion into an ordered set moves memory besides); texts are rows of their own and no row meets another.

Nulls: a null text has no words; a row without a doc_id is never rebuilt. Texts without words have no runs. Repeated rows give repeated results, an empty table none;
extra columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import small_batches

LEAST, TIMES = 6, 4
Run = tuple[int, int, int]  # start, length, period


def numbered(words: list[bytes]) -> np.ndarray:
    """Equal words as equal numbers."""
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))


def stretches(ids: np.ndarray, times: int = TIMES) -> list[tuple[int, int]]:
    """Places from, to (exclusive) outside which no word is in a run of so many periods."""
    n = len(ids)
    order = np.argsort(ids, kind="stable")
    again = ids[order[1:]] == ids[order[:-1]]
    ahead = np.full(n, n, np.int64)  # how far the next equal word is
    ahead[order[:-1][again]] = (order[1:] - order[:-1])[again]
    cover = np.zeros(n + 1, np.int64)
    low = 1
    while low * times <= n:
        near = np.flatnonzero(ahead < 2 * low)
        if len(near) >= (times - 1) * low:
            breaks = np.flatnonzero(np.diff(near) > 1)
            first, last = near[np.concatenate(([0], breaks + 1))], near[np.concatenate((breaks, [len(near) - 1]))]
            long = last - first + 1 >= (times - 1) * low
            np.add.at(cover, first[long], 1)
            np.add.at(cover, np.minimum(last[long] + 2 * low, n), -1)
        low *= 2
    inside = np.concatenate(([0], (np.cumsum(cover[:n]) > 0).astype(np.int8), [0]))
    edge = np.diff(inside)
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def automaton(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The suffix automaton's states but the first: length, suffix link and the position that a state's own prefix ends at (-1 for clones)."""
    length, link, end = [0], [-1], [-1]
    moves: list[dict[int, int]] = [{}]
    last = 0
    for i, c in enumerate(word):
        state = len(length)
        length.append(i + 1)
        link.append(0)
        end.append(i)
        moves.append({})
        at = last
        while at >= 0 and c not in moves[at]:
            moves[at][c] = state
            at = link[at]
        if at >= 0:
            to = moves[at][c]
            if length[to] == length[at] + 1:
                link[state] = to
            else:
                clone = len(length)
                length.append(length[at] + 1)
                link.append(link[to])
                end.append(-1)
                moves.append(moves[to].copy())
                while at >= 0 and moves[at].get(c) == to:
                    moves[at][c] = clone
                    at = link[at]
                link[to] = link[state] = clone
        last = state
    return length, link, end


def seeds(word: list[int], times: int = TIMES) -> Iterator[tuple[int, int, int]]:
    """End positions of neighbouring occurrences, with their length, that are at least so many periods with what lies between."""
    length, link, end = automaton(word)
    order = np.argsort(-np.array(length), kind="stable").tolist()
    places: list[list[int] | None] = [None if e < 0 else [e] for e in end]
    for state in order:
        to = link[state]
        if to <= 0 or length[to] < times - 1:  # too short for a seed of period 1
            places[state] = None
            continue
        mine, other = places[state], places[to]
        places[state] = None
        if other is None:
            places[to] = mine
            continue
        small, large = (mine, other) if len(mine) <= len(other) else (other, mine)
        if 8 * len(small) > len(large):
            large = sorted(large + small)  # two ordered lists: merged in linear time
        else:
            for x in small:
                insort(large, x)
        places[to] = large
        most = length[to] // (times - 1)
        for x in small:
            i = bisect_left(large, x)
            if i and x - large[i - 1] <= most:
                yield large[i - 1], x, length[to]
            if i + 1 < len(large) and large[i + 1] - x <= most:
                yield x, large[i + 1], length[to]


def _primitive(word: list[int], start: int, period: int) -> bool:
    """Whether a period that holds from start on over two periods at least is the smallest there: no divisor of it is one."""
    left, p = period, 2
    while left > 1:
        if p * p > left:
            p = left
        if left % p == 0:
            part = period // p
            if word[start : start + period - part] == word[start + part : start + period]:
                return False
            while left % p == 0:
                left //= p
        p += 1
    return True


def runs(words: list[bytes], least: int = LEAST, times: int = TIMES) -> list[Run]:
    """All runs of a text by start, then period."""
    n = len(words)
    if n < max(least, times):
        return []
    ids = numbered(words)
    spans = stretches(ids, times)
    if not spans:
        return []
    every = ids.tolist()
    starts: dict[int, list[int]] = {}  # of the stretches that were extended, by period
    ends: dict[int, list[int]] = {}
    for low, high in spans:
        for a, b, size in seeds(every[low:high], times):
            d, a, b = b - a, a + low, b + low
            known, until = starts.setdefault(d, []), ends.setdefault(d, [])
            i = bisect_right(known, a)
            if i and until[i - 1] > b:
                continue  # this pair lies in a stretch that is known
            s, e = a - size + 1, b + 1
            if not _primitive(every, s, d):
                continue  # its smaller period has seeds of its own
            while s and every[s - 1] == every[s - 1 + d]:
                s -= 1
            while e < n and every[e] == every[e - d]:
                e += 1
            i = bisect_left(known, s)
            known.insert(i, s)
            until.insert(i, e)
    found = [(s, e - s, d) for d, known in starts.items() for s, e in zip(known, ends[d], strict=True) if e - s >= max(least, times * d)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not found:
        return words
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()
    return [words[i] for i in kept]


def rebuilt(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words, those of every tenth id (by its CRC-32) with a periodic end."""
    n = len(words)
    h = zlib.crc32(b"%d" % doc_id) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    again = -(-(n - a) // p)
    return words[:a] + (words[a : a + p] * again)[: n - a]


def _batches(batches: Iterator[pa.RecordBatch], rebuild: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, out = batch.column(0).to_pylist(), []
        for doc_id, text in zip(ids, batch.column(1), strict=True):
            words = (text.as_py() or b"").split()  # of bytes: by ASCII white space
            if rebuild:
                words = rebuilt(words, doc_id)
            found = runs(words)
            best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
            listed = sha256(b"".join(b"%d,%d,%d\n" % r for r in found)).hexdigest()
            out.append((len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, listed, sha256(b" ".join(collapsed(words, found))).hexdigest()))
        columns = list(zip(*out, strict=True)) if out else [()] * 7
        arrays = [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.string()) for c in columns[5:])]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])


def digests(docs: DataFrame, rebuild: bool = False) -> DataFrame:
    """Per document: n_runs, the longest run (ties: smallest start, then period), and hashes of all runs and of the text without repeated periods.
    rebuild: of texts whose every tenth gets a periodic end, as rebuilt() makes it."""
    small_batches(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    ddl = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return rows.mapInArrow(lambda batches: _batches(batches, rebuild), ddl)


def collapse(docs: DataFrame) -> DataFrame:
    """docs with their texts' words joined by one space, repeated periods of runs left out; a null text stays null."""
    small_batches(docs.sparkSession)
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = []
            for text in batch.column(at).to_pylist():
                words = None if text is None else text.encode().split()
                texts.append(None if words is None else b" ".join(collapsed(words, runs(words))).decode())
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, schema)
