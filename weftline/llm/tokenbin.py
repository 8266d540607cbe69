"""Token ids as binary files in Simple-8b words.

A 64-bit word is a selector (4 bits) and up to 60 values of one width (60 bits). Each word takes as many ids as fit: at every position the
longest run that some selector holds. An id of 2**60 or more is an escape: a word with selector 0 and the id's count of one, then the raw id.

File: ``WTB1`` | ids per block (u32) | ids (u64) | documents (u64) | blocks (u64) | block offsets in words (u64 each) | the documents' lengths in
ids (u32 each) | their doc_ids (i64 each) and null flags (u8 each) | words (u64 each), all little-endian. A block starts at a word of its own, so a
reader can decode any block alone, and all words of a selector are unpacked at once.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm import units
from weftline.llm.shared import fresh_dir, one_each, small_batches, written

#: Fixed values of the coding: bits a value and values a word, by selector from 1.
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
HELD = tuple(60 // w for w in WIDTHS)
BLOCK_IDS = 1 << 10
#: A file is closed when it has this many ids.
FILE_IDS = 1 << 22
_STEP = np.array([1, *HELD], np.uint8)
_BITS = np.maximum(1, np.frexp(np.arange(1 << 20))[1]).astype(np.uint8)
MAGIC, HEAD = b"WTB1", struct.Struct("<4sIQQQ")


def pack(ids: np.ndarray, block: int = BLOCK_IDS) -> tuple[np.ndarray, np.ndarray]:
    """The words of all blocks of non-negative ids, and the place of each block's first word. All blocks are coded at once, a word of each at a time."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    choice = np.zeros(n, np.uint8)  # 0: escape
    need = _BITS[ids] if int(ids.max()) < len(_BITS) else np.array([max(1, int(x).bit_length()) for x in ids.tolist()], np.uint8)
    widest = {1: need}  # the widest of the next 1, 2, 4, ... ids
    while 2 * max(widest) <= min(n, HELD[0]):
        k = max(widest)
        widest[2 * k] = np.maximum(widest[k][:-k], widest[k][k:])
    blocks = np.arange(0, n, block)
    ends = np.minimum(blocks + block, n)
    room = np.repeat(ends, ends - blocks) - np.arange(n)
    for s in range(len(WIDTHS), 0, -1):  # from the widest: later ones hold more and take over where they can
        width, held = WIDTHS[s - 1], HELD[s - 1]
        if held > min(n, block):
            break
        k = 1 << held.bit_length() - 1
        fits = np.maximum(widest[k][: n - held + 1], widest[k][held - k :][: n - held + 1]) <= width
        choice[: n - held + 1][fits & (room[: n - held + 1] >= held)] = s
    step, first = _STEP[choice], np.zeros(n, bool)
    at, last = blocks, ends
    while len(at):
        first[at] = True
        at = at + step[at]
        going = at < last
        if not going.all():
            at, last = at[going], last[going]
    starts = np.flatnonzero(first)
    chosen = choice[starts]
    escapes = chosen == 0
    places = np.arange(len(starts)) + np.concatenate(([0], np.cumsum(escapes)[:-1]))
    words = np.zeros(len(starts) + int(escapes.sum()), np.uint64)
    for s in np.unique(chosen).tolist():
        own = chosen == s
        begins = starts[own]
        if s == 0:
            words[places[own] + 1] = ids[begins]
            continue
        width, held = WIDTHS[s - 1], HELD[s - 1]
        word = np.full(len(begins), s << 60, np.uint64)
        for k in range(held):
            word |= ids[begins + k].astype(np.uint64) << np.uint64(k * width)
        words[places[own]] = word
    return words, places[np.searchsorted(starts, blocks)]


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The n ids of the words of one block or of several in a row; a word count that doesn't give n ids is an error."""
    selectors = (words >> np.uint64(60)).astype(np.uint8)
    raw = np.zeros(len(words) + 1, bool)
    for at in np.flatnonzero(selectors == 0).tolist():  # a raw id may look like an escape itself
        if not raw[at]:
            raw[at + 1] = True
    raw = raw[: len(words)]
    if (selectors > len(WIDTHS)).any() and (selectors[~raw] > len(WIDTHS)).any():
        raise ValueError("unknown selector")
    held = _STEP[np.minimum(selectors, len(WIDTHS))].astype(np.int64)
    held[raw] = 0
    ends = np.cumsum(held)
    if (int(ends[-1]) if len(ends) else 0) != n:
        raise ValueError(f"{n} ids have words for {int(ends[-1]) if len(ends) else 0}")
    out, begins = np.zeros(n, np.uint64), ends - held
    for s in np.unique(selectors[~raw]).tolist():
        own = np.flatnonzero((selectors == s) & ~raw)
        if s == 0:
            out[begins[own]] = words[own + 1]
            continue
        width, count = WIDTHS[s - 1], HELD[s - 1]
        mask, packed, to = np.uint64((1 << width) - 1), words[own], begins[own]
        for k in range(count):
            out[to + k] = (packed >> np.uint64(k * width)) & mask
    return out


def dump(doc_ids: list[int | None], lengths: list[int] | np.ndarray, ids: np.ndarray) -> bytes:
    """A file's bytes; ids are those of all documents, one after another."""
    parts, offsets, total = [], [], 0
    for a in range(0, len(ids), 256 * BLOCK_IDS):  # so many blocks that their arrays stay in a core's cache
        words, at = pack(ids[a : a + 256 * BLOCK_IDS])
        parts.append(words)
        offsets.append(at + total)
        total += len(words)
    offsets = np.concatenate(offsets) if offsets else np.zeros(0, np.int64)
    return b"".join((
        HEAD.pack(MAGIC, BLOCK_IDS, len(ids), len(doc_ids), len(offsets)), offsets.astype("<u8").tobytes(), np.array(lengths, "<u4").tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.array([d is None for d in doc_ids], "u1").tobytes(),
        *(words.astype("<u8", copy=False).tobytes() for words in parts),
    ))


def load_block(data: bytes, block: int) -> np.ndarray:
    """The ids of one block of a file, decoded alone."""
    _, size, n, _, blocks = HEAD.unpack_from(data)
    offsets = np.frombuffer(data, "<u8", blocks, HEAD.size)
    words = np.frombuffer(data, "<u8", offset=HEAD.size + 8 * blocks + 13 * HEAD.unpack_from(data)[3])
    end = int(offsets[block + 1]) if block + 1 < blocks else len(words)
    return unpack(words[int(offsets[block]) : end], min(size, n - block * size))


def load(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """A file's doc_ids, lengths and ids; checks the mark and every block's length."""
    mark, block, n, docs, blocks = HEAD.unpack_from(data)
    if mark != MAGIC:
        raise ValueError("not a token file")
    at = HEAD.size
    parts = []
    for kind, count in (("<u8", blocks), ("<u4", docs), ("<i8", docs), ("u1", docs)):
        parts.append(np.frombuffer(data, kind, count, at))
        at += parts[-1].nbytes
    offsets, lengths, doc_ids, nulls = parts
    words = np.frombuffer(data, "<u8", offset=at)
    if int(lengths.sum()) != n:
        raise ValueError("the documents' lengths don't add up to the file's ids")
    some, cuts = 256, [*offsets[::256].tolist(), len(words)]  # as many blocks at once as are coded at once
    ids = [unpack(words[a:b], min(some * block, n - k * some * block)) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    ids = np.concatenate(ids) if ids else np.zeros(0, np.uint64)
    return [None if z else d for d, z in zip(doc_ids.tolist(), nulls.tolist(), strict=True)], lengths, ids


MANIFEST = pa.schema([("part", pa.int64()), ("file", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])


def write_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """Write all documents' ids, in ascending doc_id order, to files below folder; gives the manifest: part, file, path, n_docs, n_ids.

    Parts are ranges of doc_id; a part's files follow each other. A task writes under a name of its own attempt, so a lost executor
    or a second attempt spoils nothing: only files that the written manifest names count.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, file = units.spaced(tokenizer), TaskContext.get().partitionId(), 0
        store, root = pyarrow.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)

        def close(doc_ids: list, lengths: list, ids: list) -> pa.RecordBatch:
            path, counts = f"{root}/{part:06d}-{file:04d}-{uuid.uuid4().hex[:12]}.wtb", np.concatenate(lengths)
            with store.open_output_stream(path) as out:
                out.write(dump(doc_ids, counts, np.concatenate(ids)))
            return pa.RecordBatch.from_pydict({"part": [part], "file": [file], "path": [path], "n_docs": [len(doc_ids)], "n_ids": [int(counts.sum())]}, schema=MANIFEST)

        doc_ids, lengths, ids, held = [], [], [], 0
        for some, texts in units.batches(batches):
            found, each = own.encode_array(texts, end_id)
            doc_ids += some.to_pylist()
            lengths.append(each)
            ids.append(found)
            held += len(found)
            if held >= FILE_IDS:
                yield close(doc_ids, lengths, ids)
                doc_ids, lengths, ids, held, file = [], [], [], 0, file + 1
        if doc_ids:
            yield close(doc_ids, lengths, ids)
        units.release()

    # rows that share a doc_id, or have none, are dealt by their texts' hashes too: no id is one task's
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"), F.xxhash64(docs["text"]).alias("hash"))
    ordered = rows.repartitionByRange("doc_id", "hash").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    return written(ordered.mapInArrow(run, "part long, file long, path string, n_docs long, n_ids long"), "tokenbin-manifest")


READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens and the crc32 of its ids as unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_stream(path) as f:
                    doc_ids, lengths, ids = load(f.read())
                ids, ends = ids.astype("<u4"), np.cumsum(lengths, dtype=np.int64)
                begins = ends - lengths
                sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(begins + base), pa.array(lengths.astype(np.int64)), pa.array(sums, pa.int64())], schema=READ)

    # The manifest has a row for every 4 million ids, and the window without partitions a row a part.
    so_far = lambda window, what: F.coalesce(F.sum(what).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", so_far(Window.orderBy("part"), "n").alias("of_part"))
    of_file = so_far(Window.partitionBy("part").orderBy("file"), "n_ids")
    based = manifest.withColumn("of_file", of_file).join(parts, "part").select("path", (F.col("of_part") + F.col("of_file")).alias("base"))
    spread = based.repartition(one_each(manifest), "path")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write all documents to token files in the shared folder and read them back.

    Reads doc_id and text. Null text: no ids but the end id. Null doc_ids come first and stay null; rows that share a doc_id are in the order of
    their texts' hashes, then of their texts. An empty table writes no file and gives no rows.
    """
    folder = fresh_dir(docs.sparkSession, "tokenbin")
    return read_files(write_files(docs, tokenizer, end_id, folder), folder)
