"""Quality rules: an isolation forest on rule statistics.

Every text gets a few rule statistics in one pass. They are rates, so that a text's length decides nothing. The forest's trees cut
the box of all labelled texts' statistics by random splits; each is grown on a subsample of the good ones, and a text whose path is short lies where good texts
are not. A split is drawn over the node's box, not over the subsample's own range, so that a rate that is zero in all good texts still
isolates the texts that have it. The threshold on the path score is calibrated on labelled rows: the lowest one that keeps nearly all good ones.

The forest and the threshold are fitted on at most SAMPLE_ROWS labelled rows, those of the smallest hash of doc_id; everything else covers every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import small_batches

#: Labelled rows that the forest and its threshold are fitted on, at most.
SAMPLE_ROWS = 8_000
TREES, SUBSAMPLE, DEPTH, SEED = 100, 256, 10, 7
#: The share of labelled good texts that the threshold keeps, at least.
KEEP_GOOD = 0.998
WINDOW = 8
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLANKS, _SYMBOLS, _MARKS = " \t\n\x0b\x0c\r", "#*$%&|<>", "!?;:~^_"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATES = ("symbol_rate", "mark_rate", "upper_rate", "digit_rate", "mean_word", "dup_line_rate", "repeat_rate", "lone_mark_rate", "echo_rate")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words that stands in the text twice or more, the first one included.

    Windows are named exactly: words get numbers, pairs of numbers get numbers, and so on by doubling; equal windows have equal numbers.
    """
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    names = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    width, top = 1, len(number)
    while width < window:
        step = min(width, window - width)
        pairs = names[: n - width - step + 1] * np.int64(top) + names[step : n - width + 1][: n - width - step + 1]
        kinds, names = np.unique(pairs, return_inverse=True)
        width, top = width + step, len(kinds)
    twice = np.bincount(names)[names] > 1
    if not twice.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: str) -> tuple[list[int], list[float]]:
    """COUNTS and RATES of one text."""
    words = text.encode().split()  # of bytes: ASCII white space
    n = len(words)
    chars = len(text) - sum(map(text.count, _BLANKS))
    symbols = sum(map(text.count, _SYMBOLS))
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(_BLANKS):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    repeat = repeated_words(words)
    letters = max(1, chars)
    upper = sum(map(text.count, _CAPITALS)) if text.isascii() else sum(map(str.isupper, text))  # of every script, over the whole text
    echo = sum(map(bytes.__eq__, words[1:], words))  # words that repeat the one before them
    lone = sum(1 for w in words if len(w) == 1 and not w.isalnum())
    rates = [
        symbols / letters, sum(map(text.count, _MARKS)) / letters, _over(upper / letters, 0.2), _over(sum(map(text.count, "0123456789")) / letters, 0.25),
        min(chars / max(1, n), 40.0) / 40.0, _over(dup / max(1, lines), 0.4), _over(repeat / max(1, n), 0.3), lone / max(1, n), echo / max(1, n),
    ]
    return [n, chars, symbols, dup, repeat], rates


def _over(rate: float, usual: float) -> float:
    """Rates that short clean texts reach with a number or a repeated line in them count as none."""
    return max(0.0, rate - usual) / (1 - usual)


def base_failed(counts: list[int]) -> bool:
    n_words, _, _, _, n_repeat = counts
    return n_words < 20 or 100 * n_repeat > 30 * n_words


@dataclass
class Forest:
    """Trees as arrays: feature (-1: leaf), split, left, right, path; and the threshold on the score."""

    trees: list[tuple[np.ndarray, ...]]
    threshold: float = np.inf

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): near 1 where random splits isolate a point at once."""
        total = np.zeros(len(x))
        for feature, split, left, right, path in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), np.maximum(f, 0)] < split[node]
                node = np.where(inner, np.where(go, left[node], right[node]), node)
            total += path[node]
        return 2.0 ** -(total / max(1, len(self.trees)) / _unsuccessful(SUBSAMPLE))


def _unsuccessful(n: float) -> float:
    """The mean path of a failed search in a binary tree of n points."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def _tree(x: np.ndarray, low: np.ndarray, high: np.ndarray, draw: np.random.Generator) -> tuple[np.ndarray, ...]:
    nodes: list[list[float]] = []

    def grow(rows: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append([-1, 0.0, 0, 0, depth + _unsuccessful(len(rows))])
        open_ = np.flatnonzero(high > low)
        if len(rows) > 1 and depth < DEPTH and len(open_):
            f = int(draw.choice(open_))
            split = draw.uniform(low[f], high[f])
            inside, outside = rows[rows[:, f] < split], rows[rows[:, f] >= split]
            up, down = low.copy(), high.copy()
            up[f] = down[f] = split
            nodes[at][:4] = [f, split, grow(inside, low, down, depth + 1), grow(outside, up, high, depth + 1)]
        return at

    grow(x, low, high, 0)
    feature, split, left, right, path = map(np.array, zip(*nodes, strict=True))
    return feature.astype(np.int64), split, left.astype(np.int64), right.astype(np.int64), path


def fit(rates: np.ndarray, good: np.ndarray) -> Forest | None:
    """The forest of the labelled rows' rates and its threshold; None if there are no good rows to learn from."""
    order = np.lexsort((*rates.T, good))  # the rows' own order decides nothing
    rates, good = rates[order], good[order].astype(bool)
    if good.sum() < 2:
        return None
    draw = np.random.default_rng(SEED)
    low, high, clean = rates.min(axis=0), rates.max(axis=0), rates[good]
    forest = Forest([_tree(clean[draw.choice(len(clean), min(SUBSAMPLE, len(clean)), replace=False)], low, high, draw) for _ in range(TREES)])
    scores = forest.scores(rates)
    kept = np.sort(scores[good])
    least = kept[min(len(kept) - 1, int(np.ceil(KEEP_GOOD * len(kept))) - 1)]
    bad = np.sort(scores[~good])
    above = bad[bad > least]
    # half-way to the bad rows that lie beyond, so that good texts a little off are kept
    forest.threshold = float((least + above[0]) / 2) if len(above) else float(max(kept[-1], least))
    return forest


def labelled_rates(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """RATES and quality of at most so many labelled documents: those of the smallest hash of doc_id."""
    small_batches(docs.sparkSession)
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    joined = texts.join(F.broadcast(chosen), "doc_id")  # rows of two numbers, as many as the limit at most
    schema = pa.schema([("quality", pa.int64()), ("base", pa.bool_()), ("rates", pa.list_(pa.float64())), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t or "") for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int64()), pa.array([base_failed(c) for c, _ in found]), pa.array([r for _, r in found], schema.field(2).type), batch.column(2)], schema=schema)

    # of rows that share a doc_id, the one of least rates: a row for each chosen id at most
    found = joined.select("text", "quality", "doc_id").mapInArrow(run, "quality long, base boolean, rates array<double>, doc_id long").where("NOT base")
    got = found.groupBy("doc_id").agg(F.min(F.struct("rates", "quality")).alias("one")).select("one.quality", "one.rates").toArrow()
    rates = np.array(got.column("rates").to_pylist(), float).reshape(-1, len(RATES))
    return rates, got.column("quality").to_numpy() == 1


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept and score of every whole text.

    Reads doc_id and text of docs, doc_id and quality of labels. Null text: no words, so the base rules reject it. Null or repeated doc_ids: a row for
    each row. Without labelled good rows there is no forest: kept is then what the base rules keep, and score is null. An empty table gives an empty table.
    """
    forest = fit(*labelled_rates(docs, labels))
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [statistics(t or "") for t in batch.column(1).to_pylist()]
            failed = np.array([base_failed(c) for c, _ in found])
            scores = forest.scores(np.array([r for _, r in found])) if forest else None
            kept = ~failed & (scores <= forest.threshold) if forest else ~failed
            counts = [pa.array(c, pa.int64()) for c in zip(*(c for c, _ in found), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array(failed), pa.array(kept), pa.array(scores, pa.float64()) if forest else pa.nulls(len(found), pa.float64())], schema=schema)

    named = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return named.mapInArrow(run, f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, kept boolean, score double")


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns; a text is judged where it is read."""
    forest, at, fields = fit(*labelled_rates(docs, labels)), docs.columns.index("text"), docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [statistics(t or "") for t in batch.column(at).to_pylist()]
            kept = ~np.array([base_failed(c) for c, _ in found])
            if forest:
                kept &= forest.scores(np.array([r for _, r in found])) <= forest.threshold
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, fields)
