"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string there is exactly one token that can stand last in its encoding. It is found from left to right: of the
tokens that end at a position, the one whose neighbour to the left (the last token of what comes before it) may stand beside it. Two tokens
may stand side by side when the merges never join across the border between them, which is decided from the tokens' own merge trees. One
pass, linear in the bytes, with no worst case for long runs; and since a position depends on nothing to its right, bytes can be appended
exactly, and after an edit only the positions until the old values return are computed anew.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from weftline.llm.shared import by_batch, small_batches

#: Entries of each of the two generations of a worker's caches, and the longest entry that is kept there, in characters.
CACHE_ENTRIES, CACHE_CHARS = 300_000, 48


class PrefixBPE:
    """ranks: token bytes to rank, which is also the token's id; every single byte that is to be encoded must be a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.length = {i: len(b) for b, i in ranks.items()}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._beside: dict[int, bool] = {}
        #: Every tail of a token: the token's id where the tail is one that merges lead to, else -1.
        self.ends = {b[k:]: -1 for b in ranks for k in range(len(b))}
        self.ends.update((b, i) for b, i in ranks.items() if self.halves(i) is not None)

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; (token, token) for a single byte; None if no merges lead to it."""
        if token not in self._halves:
            whole = self.bytes_of[token]
            parts = [whole[i : i + 1] for i in range(len(whole))]
            while len(parts) > 2:
                ranked = [(self.ranks.get(a + b, token), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False))]
                rank, i = min(ranked)
                if rank >= token:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            known = all(p in self.ranks for p in parts)
            self._halves[token] = None if not known or len(parts) > 2 else (self.ranks[parts[0]], self.ranks[parts[-1]]) if len(parts) == 2 else (token, token)
        return self._halves[token]

    def beside(self, key: int) -> bool:
        """Whether two tokens (left << 32 | right) may be neighbours: no pair along their common border merges before its parts are taken up.

        Going back in time, the younger (higher) of the two border tokens is the one that was made last; undo its merge and look
        at the pair that stood there before. A pair is a conflict if its own merge would have come before the merge that was undone.
        """
        if len(self._beside) > 2 * CACHE_ENTRIES:
            self._beside.clear()
        a, b, ok = key >> 32, key & 0xFFFFFFFF, True
        took_a = took_b = float("inf")  # the ranks of the merges that took a and b up, away from the border
        while True:
            joined = self.ranks.get(self.bytes_of[a] + self.bytes_of[b])
            if joined is not None and joined < took_a and joined <= took_b:  # of equal ranks, the one further left merges first
                ok = False
                break
            left, right = self._halves[a], self._halves[b]
            if left == (a, a) and right == (b, b):
                break
            if left != (a, a) and (right == (b, b) or a >= b):
                took_a, a = a, left[1]
            else:
                took_b, b = b, right[0]
        self._beside[key] = ok
        return ok

    def extend(self, data: bytes, last: list[int]) -> Iterator[int]:
        """Append to last, which has the last tokens of data's first prefixes, those of the prefixes that follow; gives each end.

        At each end the tokens that end there are tried from the shortest: exactly one may stand beside what comes before it.
        """
        ends, known, beside = self.ends, self._beside, self.beside
        for end in range(len(last), len(data) + 1):
            start = end - 1
            if end < 7 and (token := ends.get(data[:end], -1)) >= 0:  # a prefix that is a token is its own encoding
                last.append(token)
                yield end
                continue
            while start >= 0:
                token = ends.get(data[start:end])
                if token is None:
                    raise ValueError(f"no token ends at byte {end}")
                if token >= 0:
                    if not start:
                        break
                    key = last[start] << 32 | token
                    ok = known.get(key)
                    if beside(key) if ok is None else ok:
                        break
                start -= 1
            last.append(token)
            yield end

    def encode(self, data: bytes) -> tuple[int, ...]:
        """The ids of one piece (a match of the pattern). A piece that is a token is that token, however it came to be one."""
        whole = self.ranks.get(data)
        if whole is not None:
            return (whole,)
        return Prefixes(self, data).tokens()

    def encode_sorted(self, pieces: list[bytes]) -> Iterator[tuple[int, ...]]:
        """The ids of each of the sorted pieces; what a piece has in common with the one before it is not computed again."""
        last, before, length = [-1], b"", self.length
        for piece in pieces:
            if (whole := self.ranks.get(piece)) is not None:
                yield (whole,)
                continue
            common = min(len(piece), len(before))
            while piece[:common] != before[:common]:
                common -= 1
            del last[common + 1 :]
            for _ in self.extend(piece, last):
                pass
            before, end, at = piece, len(piece), []
            while end:
                at.append(last[end])
                end -= length[last[end]]
            yield tuple(reversed(at))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class Prefixes:
    """The last tokens of all prefixes of a byte string that can be appended to and edited."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, b"", [-1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Nothing that is there changes; the cost is that of the new bytes."""
        self.data += more
        for _ in self.bpe.extend(self.data, self.last):
            pass

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Put new in place of data[start:end]; gives how many positions were computed. From where as many positions as the longest
        token agree with those before the edit, all that follow agree too."""
        old, moved, done, same = self.last, start + len(new) - end, 0, 0
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[: start + 1]
        for at in self.bpe.extend(self.data, self.last):
            done += 1
            was = at - moved
            same = same + 1 if was > end and old[was] == self.last[at] else 0
            if same >= self.bpe.longest:
                self.last += old[was + 1 :]
                break
        return done

    def tokens(self) -> tuple[int, ...]:
        out, at = [], len(self.data)
        while at:
            out.append(self.last[at])
            at -= len(self.bpe.bytes_of[out[-1]])
        return tuple(reversed(out))


#: Between these characters a space starts a new unit: what stands in one unit never decides how another is cut.
_UNITS = regex.compile(r"(?<=\S) (?=\S)")
_EDGES = regex.compile(r"\A\s|\s\Z")


class _Known(dict):
    """Encoded texts in two generations: what is used again moves from the old one to this one; the old one goes as a whole."""

    def __init__(self):
        super().__init__()
        self.old: dict[str, tuple[int, ...]] = {}

    def lacking(self, wanted: set[str]) -> set[str]:
        """Those of wanted that must be encoded."""
        new = wanted.difference(self)
        for key in [key for key in new if key in self.old]:
            self[key] = self.old.pop(key)
            new.discard(key)
        return new

    def forget(self, passing: list[str]) -> None:
        for key in passing:
            del self[key]
        if len(self) > CACHE_ENTRIES:
            self.old = dict(self)
            self.clear()


class TextEncoder:
    """Whole texts to ids: each match of the pattern is encoded separately."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.bpe, self.matches = PrefixBPE(ranks), regex.compile(pattern).findall
        self.pieces, self.units = _Known(), _Known()  # the space before a unit is not part of its key

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text of a batch. Units that the cache lacks are cut into pieces, and pieces that it lacks are encoded, once for the batch."""
        split = [text.split(" ") for text in texts]
        new = self._new(split)
        # Most texts have single spaces, between words only. Where a unit has white space at an edge or is empty, the text is split with care.
        odd = {unit for unit in new if not unit or _EDGES.search(unit)}
        for i, units in enumerate(split):
            if not units[0] or _EDGES.search(units[0]) or (odd and not odd.isdisjoint(units)):
                split[i] = _UNITS.split(texts[i])
        if odd:
            new = self._new(split)
        firsts = [self.matches(units[0]) for units in split]
        cut = {unit: self.matches(" " + unit) for unit in new}
        lacking = self.pieces.lacking(set(chain(chain.from_iterable(firsts), chain.from_iterable(cut.values()))))
        in_order = sorted((piece.encode(), piece) for piece in lacking)
        self.pieces.update(zip((p for _, p in in_order), self.bpe.encode_sorted([b for b, _ in in_order]), strict=True))
        ids = self.pieces.__getitem__
        self.units.update((unit, ids(found[0]) if len(found) == 1 else tuple(chain.from_iterable(map(ids, found)))) for unit, found in cut.items())
        known = self.units.__getitem__
        for units, first in zip(split, firsts, strict=True):
            yield [*chain.from_iterable(map(ids, first)), *chain.from_iterable(map(known, units[1:]))]
        self.units.forget([unit for unit in new if len(unit) > CACHE_CHARS or not unit or _EDGES.search(unit)])
        self.pieces.forget([piece for piece in lacking if len(piece) > CACHE_CHARS])

    def _new(self, split: list[list[str]]) -> set[str]:
        return self.units.lacking(set().union(*(units[1:] for units in split)))


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> TextEncoder:
    """A worker's encoder for a rank file; it is kept from task to task."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return TextEncoder(ranks, pattern)


DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the bytes they decode to, for every whole text.

    Reads doc_id and text only. Null text: as an empty one (no ids, digests of the empty string). Null or repeated doc_ids are
    carried as they are, a row for each row. No shuffle: a text is encoded where it is read.
    """
    small_batches(docs.sparkSession)

    def rows(doc_ids: list, texts: list) -> Iterator[list]:
        own = encoder(path, pattern)
        names, parts = _names(path, pattern)
        counts, coded, decoded = [], [], []
        for ids in own.encode([text or "" for text in texts]):
            counts.append(len(ids))
            coded.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
            decoded.append(hashlib.sha256(b"".join(map(parts.__getitem__, ids))).hexdigest())
        return [doc_ids, counts, coded, decoded]

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(
        by_batch(rows, ["doc_id", "text"], DIGESTS), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


@functools.lru_cache(maxsize=2)
def _names(path: str, pattern: str) -> tuple[dict[int, str], dict[int, bytes]]:
    parts = encoder(path, pattern).bpe.bytes_of
    return {i: str(i) for i in parts}, parts
