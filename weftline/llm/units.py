"""Whole texts to token ids with the tokenizers library, through a cache of units.

A unit is a stretch of text that no neighbour influences: the tokenizer's result for it alone is its part of the result for the text. Texts are cut into
units, distinct units are found and looked up, and ids are gathered as arrays; Python looks only at units that are new. New units are encoded many at
once, as one text that is cut at border tokens. The cache is three arrays and a column of strings, bounded in bytes; the units used last stay.
"""

from __future__ import annotations

import ctypes
import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

#: Bytes of a worker's cache, and the longest unit that stays there.
CACHE_BYTES, CACHE_CHARS = 16 << 20, 48
#: Bytes of texts that are looked up at once, about, and new units that are encoded as one text.
BATCH_BYTES, JOINED = 2_000_000, 4096

Encoded = tuple[np.ndarray, np.ndarray]


def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(doc_ids, texts) of record batches (doc_id, text), put together to BATCH_BYTES at most, but for a longer text alone; a null text is an empty one."""
    ids, texts, held = [], [], 0

    def out() -> tuple[pa.Array, pa.Array]:
        return pa.concat_arrays(ids), pa.concat_arrays(texts)

    for batch in rows:
        column = pc.fill_null(batch.column(1).cast(pa.string()), "")
        sizes, at = pc.binary_length(column).to_numpy(zero_copy_only=False).tolist(), 0
        for row, size in enumerate(sizes):
            if held and held + size > BATCH_BYTES:
                ids.append(batch.column(0).slice(at, row - at))
                texts.append(column.slice(at, row - at))
                yield out()
                ids, texts, held, at = [], [], 0, row
            held += size
        ids.append(batch.column(0).slice(at))
        texts.append(column.slice(at))
    if sum(map(len, ids)):
        yield out()


def release() -> None:
    """Give what a task's batches took back to the system: workers wait for other tasks with what they hold."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def _gather(pool: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """pool[start : start + count] of each, one after another."""
    ends = np.cumsum(count, dtype=np.int64)
    at = np.repeat(start - ends + count, count)
    at += np.arange(len(at))
    return pool[at]


class _Units:
    """The cache: words, and for each the place and number of its ids in the pool (a count of -1: not a unit), and the turn that it was last used in."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.words, self.pool = pa.array([], pa.string()), np.zeros(0, self.kind)
        self.start, self.count, self.used, self.turn = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), 0

    def run(self, texts: list[str]) -> Encoded:
        """The ids of all texts, one after another, and how many each has."""
        found = [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        return np.concatenate([np.zeros(0, self.kind), *found]), np.array([len(x) for x in found], np.int32)

    def run_joined(self, units: list[str], before: str, after: str, border: np.ndarray, borders: int = 1) -> Encoded:
        """Like run, for units that are encoded as one text, JOINED at once, in which each has so many border tokens; should the count differ, one by one."""
        parts = [self.run([])]
        for a in range(0, len(units), JOINED):
            some = units[a : a + JOINED]
            joined = before + (after + before).join(some) + after
            ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.kind)
            at = np.flatnonzero(border[ids])
            if len(at) != borders * len(some):
                parts.append(self.run(list(map(self.alone, some))))
            elif self.begins:
                parts.append((ids, np.diff(at, append=len(ids)).astype(np.int32)))
            else:
                parts.append((ids, np.diff(at[borders - 1 :: borders] + 1, prepend=0).astype(np.int32)))
        ids, counts = zip(*parts, strict=True)
        return np.concatenate(ids), np.concatenate(counts)

    def look_up(self, distinct: pa.Array) -> Encoded:
        """Where the ids of each unit are in the pool, and how many; what is new is encoded and kept."""
        self.turn += 1
        found = pc.index_in(distinct, value_set=self.words)
        new = found.is_null()
        at = found.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        lacking = distinct.filter(new)
        if len(lacking):
            words = lacking.to_pylist()
            start, count = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int32)
            parts = [self.pool]
            for places, (ids, counts) in self.encode_new(words):
                start[places] = sum(map(len, parts)) + np.cumsum(counts, dtype=np.int64) - counts
                count[places] = counts
                parts.append(ids)
            at[at < 0] = len(self.words) + np.arange(len(words))
            self.words, self.pool = pa.concat_arrays([self.words, lacking]), np.concatenate(parts)
            self.start, self.count = np.concatenate((self.start, start)), np.concatenate((self.count, count))
            self.used = np.concatenate((self.used, np.zeros(len(words), np.int32)))
        self.used[at] = self.turn
        return self.start[at], self.count[at]

    def forget(self) -> None:
        """When the cache is over its bytes: long units go, then the ones that were used least lately, down to half of them."""
        size = self.words.nbytes + self.pool.nbytes + 16 * len(self.words)
        if size <= CACHE_BYTES:
            return
        keep = pc.utf8_length(self.words).to_numpy(zero_copy_only=False) <= CACHE_CHARS
        each = pc.binary_length(self.words).to_numpy(zero_copy_only=False) + self.pool.itemsize * np.maximum(self.count, 0) + 20
        latest = np.argsort(-self.used, kind="stable")
        keep[latest[np.cumsum(each[latest] * keep[latest]) > CACHE_BYTES // 2]] = False
        self.words = self.words.filter(pa.array(keep))
        self.count, self.used = self.count[keep], self.used[keep]
        held = np.maximum(self.count, 0)
        self.pool = _gather(self.pool, self.start[keep], held)
        self.start = np.cumsum(held, dtype=np.int64) - held

    def encode_array(self, texts: pa.Array, end_id: int | None = None) -> Encoded:
        """The ids of all texts one after another, as encode(text, add_special_tokens=False) gives them, and how many each has; with an end id behind each."""
        cut = self.split(texts)
        offsets = cut.offsets.to_numpy().astype(np.int64)
        coded = cut.flatten().dictionary_encode()
        start, count = self.look_up(coded.dictionary)
        index = coded.indices.to_numpy(zero_copy_only=False)
        start, count = start[index], count[index]
        odd = np.zeros(len(texts), bool)
        if len(count) and count.min() < 0:
            odd = np.diff(np.concatenate(([0], np.cumsum(count < 0)))[offsets]) > 0
            count[np.repeat(odd, np.diff(offsets))] = 0
        start, count = self.trim(start, count, offsets)
        ids = _gather(self.pool, start, count)
        each = np.diff(np.concatenate(([0], np.cumsum(count, dtype=np.int64)))[offsets])
        if odd.any():
            whole, counts = self.run(texts.filter(pa.array(odd)).to_pylist())
            each[odd] = counts
            mixed = np.empty(int(each.sum()), self.kind)
            from_whole = np.repeat(odd, each)
            mixed[from_whole], mixed[~from_whole] = whole, ids
            ids = mixed
        self.forget()
        if end_id is None:
            return ids.astype("<u4"), each
        out = np.empty(len(ids) + len(each), "<u4")
        body, ends = np.ones(len(out), bool), np.cumsum(each + 1) - 1
        body[ends] = False
        out[body], out[ends] = ids, end_id
        return out, each + 1

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as the bytes of little-endian unsigned 32-bit integers."""
        ids, each = self.encode_array(pa.array(texts, pa.string()))
        ends = np.cumsum(each).tolist()
        for a, b in zip([0, *ends], ends, strict=False):
            yield ids[a:b].tobytes()

    def trim(self, start: np.ndarray, count: np.ndarray, offsets: np.ndarray) -> Encoded:
        return start, count


class SpacedUnits(_Units):
    """For byte-level files, where a space belongs to the word after it: units begin at each single space and at each single line end between two other
    characters. A unit's space is not part of its key; a line end is. A text's first unit is looked up as if a line end stood before it, whose id is dropped.

    Texts with white space elsewhere (at an edge, several in a row) are encoded as a whole.
    """

    begins = True
    _edges = regex.compile(r"\A\n?+[\s\x1c-\x1f]|[\s\x1c-\x1f]\Z")
    _blank = regex.compile(r"[\s\x1c-\x1f]")

    def __init__(self, path: str):
        super().__init__(path)
        vocab = self.tokenizer.get_vocab()
        self.first, self.line = np.zeros(self.tokenizer.get_vocab_size() + 1, bool), np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.first[[i for token, i in vocab.items() if token.startswith("Ġ")]] = True  # the byte-level sign for a space
        self.line[vocab["Ċ"]] = True  # the byte-level sign for a line end

    def alone(self, unit: str) -> str:
        return unit if unit[0] == "\n" else " " + unit

    def split(self, texts: pa.Array) -> pa.ListArray:
        lines = pc.replace_substring(texts, "\n", " \n")
        return pc.split_pattern(pc.binary_join_element_wise("\n", lines, ""), " ")

    def trim(self, start: np.ndarray, count: np.ndarray, offsets: np.ndarray) -> Encoded:
        """Without the line end before each text; texts that are encoded as a whole have none."""
        first = offsets[:-1][count[offsets[:-1]] > 0]
        start[first] += 1
        count[first] -= 1
        return start, count

    def encode_new(self, words: list[str]) -> Iterator[tuple[list[int], Encoded]]:
        plain, lines, others = [], [], []
        for i, unit in enumerate(words):
            if unit.isalpha():
                plain.append(i)
            elif not unit or self._edges.search(unit):
                continue  # not a unit
            elif self._blank.search(unit, 1):
                others.append(i)
            else:
                (lines if unit[0] == "\n" else plain).append(i)
        for places, border, space in ((plain, self.first, " "), (lines, self.line, "")):
            own = [words[i] for i in places]
            yield places, self.run_joined(own, space, "", border)
        yield others, self.run([self.alone(words[i]) for i in others])


class WordUnits(_Units):
    """For files that drop white space: units are what stands between ASCII white space."""

    begins = False
    _signs = frozenset(".,;:!?")

    def __init__(self, path: str):
        super().__init__(path)
        vocab = self.tokenizer.get_vocab()
        self.last, self.mark = np.zeros(self.tokenizer.get_vocab_size() + 1, bool), np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.last[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        # stands between units whose border tokens are not known before: the rarest word that is one token
        words = ((i, t[:-4]) for t, i in vocab.items() if t.endswith("</w>") and len(t) > 9 and t[:-4].isascii() and t[:-4].isalpha())
        self.mark_word = next(w for _, w in sorted(words, reverse=True) if len(self.run([w])[0]) == 1)
        self.mark[self.run([self.mark_word])[0][0]] = True

    def alone(self, unit: str) -> str:
        return unit

    def split(self, texts: pa.Array) -> pa.ListArray:
        return pc.ascii_split_whitespace(texts)

    def encode_new(self, words: list[str]) -> Iterator[tuple[list[int], Encoded]]:
        plain, signed, mixed, others = [], [], [], []
        for i, unit in enumerate(words):
            low = unit.lower()  # of one letter (U+0130) it is a letter and a mark
            if low.isalpha():
                plain.append(i)
            elif not unit or self.mark_word in low:
                others.append(i)
            elif unit[-1] in self._signs and low[:-1].isalpha():
                signed.append(i)
            else:
                mixed.append(i)
        for places, borders in ((plain, 1), (signed, 2)):
            yield places, self.run_joined([words[i] for i in places], "", " ", self.last, borders)
        ids, counts = self.run_joined([words[i] for i in mixed], "", f" {self.mark_word} ", self.mark)
        marks = self.mark[ids]  # none where units were encoded one by one
        ends = np.cumsum(counts)
        counts = counts - np.diff(np.concatenate(([0], np.cumsum(marks)))[ends], prepend=0)
        yield mixed, (ids[~marks], counts.astype(np.int32))
        yield others, self.run([words[i] for i in others])


@functools.lru_cache(maxsize=2)
def spaced(path: str) -> SpacedUnits:
    """A worker's encoder for a byte-level file; it is kept from task to task."""
    return SpacedUnits(path)


@functools.lru_cache(maxsize=2)
def words(path: str) -> WordUnits:
    """A worker's encoder for a file with word ends; it is kept from task to task."""
    return WordUnits(path)
