"""The prefix trie of conversations, built as a Patricia tree: sort, create only branch, end and leaf points, aggregate on these, expand unary nodes by edge suffix sums.

A turn becomes a digest of 16 bytes and its number of words, a conversation an array of digests; texts are not moved further. Conversations are sorted by (array,
conv_id) over range partitions, so that even one sequence that very many conversations share is dealt to many tasks. A task reads its rows once, with a stack of the open
compressed points: two neighbours' common prefix closes the points below it and makes a branch point. What a closed point sums up of its subtree (members,
smallest member, leaves, saved tokens) goes to its parent; the unary nodes of its edge get the sums from their own place down.

The members of a node are neighbours in this order, so a node lies in one task alone unless it is on the path of the task's first or last sequence. Of the nodes on those
two paths a task gives parts: partial counts, and the sums of complete subtrees that hang directly below. Equal nodes' parts are added up, and the tree of these nodes, at most two
paths a task, is summed up once more.

Children wait for their parent's smallest member in memory while they are few; the many children of one point are written with the parent's key and joined with the points of many
children and of the two paths. Ascending ids of conversations that end at a node are hashed as they pass; where they are many, they are written as pieces of text of 64 kB, and
one task streams the pieces of a node, in order, through its hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import drop_written, written

#: Children that wait for their parent in memory, characters of ids of one node that do, and rows of a batch.
WAITING, PIECE, ROWS = 4096, 65536, 4096
#: Rows of points that may be broadcast: 6 MB.
SMALL = 100_000
WORD = r"[^\x20\x09-\x0D]+"
_NONE = sha256(b"").hexdigest()

_SCHEMA = pa.schema([
    ("kind", pa.string()), ("key", pa.binary()), ("parent_key", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("words", pa.int64()), ("ends", pa.string()), ("pieces", pa.bool_()),
])
_DDL = "kind string, key binary, parent_key binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends string, pieces boolean"


def _key(turns: list[bytes], depth: int) -> bytes:
    return sha256(b"".join(turns[:depth])).digest()[:16]


class _Point:
    """A branch, end or leaf point that is open: its depth and what is known of its subtree. ids: conversations that end here; leaves and saved: of closed subtrees."""

    __slots__ = ("children", "depth", "ended", "hash", "ids", "leaves", "least", "members", "pieces", "saved", "size", "waiting", "written")

    def __init__(self, depth: int):
        self.depth, self.members, self.least, self.children, self.leaves, self.saved = depth, 0, None, 0, 0, 0
        self.ended, self.ids, self.size, self.pieces, self.hash = False, [], 0, False, None
        self.waiting, self.written = [], False

    def add(self, members: int, least: int) -> None:
        self.members += members
        self.least = least if self.least is None or least < self.least else self.least


class _Builder:
    """One task's pass over its sorted conversations. rows: finished output rows, in the order of _SCHEMA."""

    def __init__(self, waiting: int = WAITING, piece: int = PIECE):
        self.most_waiting, self.most_text = waiting, piece
        self.rows: list[tuple] = []
        self.turns: list[bytes] = []
        self.words: list[int] = []
        self.stack = [_Point(0)]
        self.first = None  # how deep the path of the first sequence still is open

    def take(self, conv_id: int, turns: list[bytes], words: list[int]) -> None:
        if self.first is None:
            self.first = len(turns)
            self.turns, self.words = turns, words
            if turns:
                self.stack.append(_Point(len(turns)))
        elif turns != self.turns:
            shared = 0
            for a, b in zip(turns, self.turns, strict=False):
                if a != b:
                    break
                shared += 1
            self.close(shared)
            self.first = min(self.first, shared)
            self.turns, self.words = turns, words
            self.stack.append(_Point(len(turns)))  # in sorted order nothing follows that is a prefix of what was before
        top = self.stack[-1]
        top.add(1, conv_id)
        top.ended = True
        text = b"%d" % conv_id
        top.ids.append(text)
        top.size += len(text) + 1
        if top.size > self.most_text:
            self.piece(top)

    def piece(self, point: _Point) -> None:
        """Write out the ids so far; conv_id is the first of them."""
        self.rows.append(("piece", _key(self.turns, point.depth), None, int(point.ids[0]), *(None,) * 7, b",".join(point.ids).decode(), None))
        point.ids, point.size, point.pieces = [], 0, True

    def close(self, depth: int, last: bool = False) -> None:
        """Close all points below a depth (at the end: all), with a branch point at it if there is none."""
        while self.stack and (last or self.stack[-1].depth > depth):
            point = self.stack.pop()
            if not last and self.stack[-1].depth < depth:
                self.stack.append(_Point(depth))
            self.edge(point, self.stack[-1] if self.stack else None, last)

    def edge(self, point: _Point, parent: _Point | None, last: bool) -> None:
        """The nodes from a point that closes up to its parent. There is a point wherever the first path was left, so an edge lies on a path as a whole or not at all."""
        if last or point.depth <= self.first:
            self.path(point, parent.depth if parent else -1)
        else:
            self.inner(point, parent)
        if parent:
            parent.add(point.members, point.least)

    def path(self, point: _Point, above: int) -> None:
        """Parts of nodes on the first or last path: members here, and the sums of what hangs below outside these paths."""
        if point.ids:
            self.piece(point)
        if point.waiting:
            self.flush(point)
        hanging, ended = (point.children, point.leaves, point.saved), point.ended
        for depth in range(point.depth, above, -1):
            up = _key(self.turns, depth - 1) if depth else None
            self.rows.append(("part", _key(self.turns, depth), up, point.least, depth, None, point.members, *hanging, self.words[depth - 1] if depth else 0, None, ended))
            hanging, ended = (0, 0, 0), False

    def inner(self, point: _Point, parent: _Point) -> None:
        """Nodes that lie in this task alone; the unary ones get the point's sums and those of the edge from their own place down."""
        n, least = point.members, point.least
        if point.pieces and point.ids:
            self.piece(point)
        ends = None if point.pieces else sha256(b",".join(point.ids)).hexdigest()
        key = _key(self.turns, point.depth) if point.pieces or point.written else None
        if point.written:
            self.rows.append(("point", key, None, least, *(None,) * 9))
        self.rows += [self.row(k, None, least, node) for k, node in point.waiting]
        leaves, saved, children = point.leaves if point.children else 1, point.saved, point.children
        for depth in range(point.depth, parent.depth, -1):
            saved += (n - 1) * self.words[depth - 1]
            node = (least, depth, n, children, leaves, saved, ends)
            if depth == parent.depth + 1:
                parent.waiting.append((key, node))
            else:
                self.rows.append(self.row(key, None, least, node))
            children, ends, key = 1, _NONE, None
        if len(parent.waiting) >= self.most_waiting:
            self.flush(parent)
        parent.children += 1
        parent.leaves += leaves
        parent.saved += saved

    @staticmethod
    def row(key: bytes | None, parent_key: bytes | None, parent: int | None, node: tuple) -> tuple:
        conv_id, depth, n, children, leaves, saved, ends = node
        return ("node", key, parent_key, conv_id, depth, parent, n, children, leaves, saved, None, ends, ends is None)

    def flush(self, point: _Point) -> None:
        """Write the waiting children with their parent's key."""
        up = _key(self.turns, point.depth)
        self.rows += [self.row(key, up, None, node) for key, node in point.waiting]
        point.waiting, point.written = [], True


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _build(batches: Iterator[pa.RecordBatch], waiting: int, piece: int) -> Iterator[pa.RecordBatch]:
    builder = _Builder(waiting, piece)
    for batch in batches:
        for conv_id, turns, words in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            builder.take(conv_id, turns, words)
            if len(builder.rows) >= ROWS:
                yield _batch(builder.rows)
                builder.rows = []
    if builder.first is not None:
        builder.close(0, last=True)
    for i in range(0, len(builder.rows), ROWS):
        yield _batch(builder.rows[i : i + ROWS])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by key and first id to each key's hash; only the hash's state is held."""
    now, state = None, None
    for batch in batches:
        done = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if key != now:
                if now is not None:
                    done.append((now, state.hexdigest()))
                now, state = key, sha256()
            else:
                state.update(b",")
            state.update(text.encode())
        if done:
            yield pa.RecordBatch.from_pydict({"end_key": [k for k, _ in done], "hash": [h for _, h in done]})
    if now is not None:
        yield pa.RecordBatch.from_pydict({"end_key": [now], "hash": [state.hexdigest()]})


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of the tasks' first and last paths, summed up from the deepest to the root; two paths a task at most."""
    rows = [r for b in batches for r in b.to_pylist()]
    if not rows:
        return
    by_key = {r["key"]: r for r in rows}
    for r in sorted(rows, key=lambda r: -r["depth"]):
        if not r["n_children"]:
            r["n_leaves"] = 1
        r["saved_tokens"] += (r["n_convs"] - 1) * r["words"]
        up = by_key.get(r["parent_key"])
        r["parent_conv_id"] = up["conv_id"] if up else None
        if up:
            up["n_children"] += 1
            up["n_leaves"] += r["n_leaves"]
            up["saved_tokens"] += r["saved_tokens"]
    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([*(f for f in _SCHEMA if f.name not in ("kind", "parent_key", "words", "ends"))]))


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (digests of role and text), words: each conversation by turn, null first (turns alike: by digest). Null roles and texts are empty; rows without a conv_id
    belong to no conversation and are left out. One row a conversation, 24 bytes a turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    told = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    digest = F.substring(F.unhex(F.sha2(told, 256)), 1, 16)
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct("turn", digest.alias("d"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("w")).alias("x"))
    each = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("x"))
    return each.select("conv_id", F.col("x.d").alias("turns"), F.col("x.w").alias("words"))


def rebuilt(seqs: DataFrame) -> DataFrame:
    """Every conversation c with the first h turns of conversation c - c % 20 in place of its own first h, h being CRC-32 of c's decimal form modulo 4."""
    heads = seqs.where("conv_id % 20 = 0").select(F.col("conv_id").alias("base"), F.slice("turns", 1, 3).alias("head"), F.slice("words", 1, 3).alias("head_words"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(4)).cast("int")
    joined = seqs.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % 20}).join(heads, "base", "left")

    def made(head: str, own: str, kind: str):
        none = F.array().cast(f"array<{kind}>")
        return F.concat(F.slice(F.coalesce(head, none), F.lit(1), F.col("h")), F.slice(own, F.col("h") + 1, F.greatest(F.size(own) - F.col("h"), F.lit(0)))).alias(own)

    return joined.select("conv_id", made("head", "turns", "binary"), made("head_words", "words", "bigint"))


def nodes(seqs: DataFrame, waiting: int = WAITING, piece: int = PIECE, small: int = SMALL) -> DataFrame:
    """The trie of (conv_id, turns, words): a row per distinct prefix of turns, the empty one included. conv_id: smallest member; depth; parent_conv_id; n_convs; n_children;
    n_leaves; saved_tokens; ends_sha256 of the decimal ids that end there, ascending and joined by commas. Rows of the same conv_id and turns count once each. No conversations: no rows."""
    ordered = seqs.repartitionByRange("turns", "conv_id").sortWithinPartitions("turns", "conv_id")
    made = written(ordered.select("conv_id", "turns", "words").mapInArrow(lambda batches: _build(batches, waiting, piece), _DDL), "trie-nodes")
    whole = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"
    parts = made.where("kind = 'part'").groupBy("key", "parent_key", "depth", "words").agg(
        F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.bool_or("pieces").alias("pieces"),
    )
    paths = written(parts.coalesce(1).mapInArrow(_paths, f"key binary, {whole}, pieces boolean"), "trie-paths")
    points = paths.select("key", "conv_id").union(made.where("kind = 'point'").select("key", "conv_id")).select(F.col("key").alias("parent_key"), F.col("conv_id").alias("up"))
    if points.count() <= small:
        points = F.broadcast(points)
    pieces = made.where("kind = 'piece'").select("key", "conv_id", "ends")
    hashes = pieces.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_hashed, "end_key binary, hash string")
    columns = [c.split()[0] for c in whole.split(", ")]
    inner = made.where("kind = 'node'")
    known = inner.where("parent_key IS NULL AND ends IS NOT NULL").select(*columns, F.col("ends").alias("ends_sha256"))
    open_parent = inner.where("parent_key IS NOT NULL").join(points, "parent_key", "left").withColumn("parent_conv_id", F.col("up"))
    late = ["key", *columns, "ends"]
    rest = open_parent.select(*late).unionByName(inner.where("parent_key IS NULL AND ends IS NULL").select(*late))
    rest = rest.unionByName(paths.withColumn("ends", F.when(~F.col("pieces"), F.lit(_NONE))).select(*late))
    done = rest.where("ends IS NOT NULL").select(*columns, F.col("ends").alias("ends_sha256"))
    hashed = rest.where("ends IS NULL").join(hashes, F.col("key") == F.col("end_key")).select(*columns, F.col("hash").alias("ends_sha256"))
    return known.unionByName(done).unionByName(hashed)


def prefix_trie(conversations: DataFrame, rebuild: bool = False) -> DataFrame:
    """The trie of conversations as they are, or as rebuilt() makes them. Extra columns are not read."""
    seqs = written(sequences(conversations), "trie-sequences")
    made = written(rebuilt(seqs) if rebuild else seqs, "trie-rebuilt") if rebuild else seqs
    out = nodes(made)
    if rebuild:
        drop_written(seqs)
    return out
