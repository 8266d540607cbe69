"""Encoding, token files, packing and rules against their libraries or brute force, with nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import base64
import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from weftline.llm import bpe, packing, rules, tokenbin, units

draw = random.Random(3)
PARTS = ["word", " ", "  ", "\n", "\t", "don't", "é", "ß", "日本", "12", "...", " ", "x" * 40, "The and", ", ", ".\n", "😀", "<|endoftext|>", "İ"]
TEXTS = [None, "", " ", "\n\n", "a", "the end", "ing" * 20_000, *("".join(draw.choice(PARTS) for _ in range(draw.randrange(40))) for _ in range(150))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", 2, "y"), (3, TEXTS[3], 1, "x"), (3, TEXTS[3], 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, start long, length string").repartition(3)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture(scope="module")
def tik():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_tiktoken(spark, docs, tik):
    path, own = tik
    got = Counter(tuple(r) for r in bpe.digests(docs, path, public_tokenizers.PATTERN).collect())
    want = Counter()
    for r in docs.collect():
        ids = own.encode_ordinary(r.text or "")
        want[(r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())] += 1
    assert got == want
    assert bpe.digests(empty(spark), path, public_tokenizers.PATTERN).count() == 0


def test_prefixes_append_and_edit(tik):
    own = bpe.encoder(tik[0], public_tokenizers.PATTERN).bpe
    live = bpe.Prefixes(own, b"something")
    live.append(b" else entirely")
    assert live.last == bpe.Prefixes(own, b"something else entirely").last
    for _ in range(100):
        a = draw.randrange(len(live.data) + 1)
        live.edit(a, min(len(live.data), a + draw.randrange(4)), bytes(draw.choice(b"aeinot ") for _ in range(draw.randrange(5))))
        assert live.last == bpe.Prefixes(own, live.data).last
    long = bpe.Prefixes(own, b"the thing " * 2000)
    assert long.edit(30, 31, b"x") < 1000  # near the edit only


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_units_are_the_tokenizers_library(name):
    path = public_tokenizers.path(name)
    own, plain = (units.spaced if name.startswith("byte") else units.words)(path), Tokenizer.from_file(path)
    texts = [t or "" for t in TEXTS]
    for _ in range(2):  # without and with a filled cache
        got = [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)]
        assert got == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_simple8b_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 59, 60, 61, 500):
        for bits in (1, 4, 15, 16, 30, 59, 60, 62):
            ids = rng.integers(0, 1 << bits, n, dtype=np.uint64)
            mixed = np.where(rng.random(n) < 0.5, ids, ids % np.uint64(3))
            words, offsets = tokenbin.pack(mixed, 64)
            assert (tokenbin.unpack(words, n) == mixed).all()
            for k, at in enumerate(offsets.tolist()):
                end = int(offsets[k + 1]) if k + 1 < len(offsets) else len(words)
                assert (tokenbin.unpack(words[at:end], min(64, n - 64 * k)) == mixed[64 * k : 64 * k + 64]).all()
    ids = rng.integers(0, 50_000, 3000)
    data = tokenbin.dump([1], [3000], ids)
    assert (tokenbin.load_block(data, 2) == ids[2048:]).all() and (tokenbin.load_block(data, 0) == ids[:1024]).all()
    data = tokenbin.dump([5, None], [2, 1], np.array([1, 2, 3]))
    ids, lengths, got = tokenbin.load(data)
    assert ids == [5, None] and lengths.tolist() == [2, 1] and got.tolist() == [1, 2, 3]
    with pytest.raises(ValueError):
        tokenbin.load(b"XXXX" + data[4:])


def test_token_files(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    got = sorted((tuple(r) for r in tokenbin.round_trip(docs, path).collect()), key=lambda r: r[1])
    start, want = 0, []
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or "")):
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert tokenbin.round_trip(empty(spark), path).count() == 0


def test_packing(spark, docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, capacity = Tokenizer.from_file(path), 64
    got = packing.pack(docs, path, 1, capacity).collect()
    want = Counter()
    for r in docs.collect():
        ids = [*plain.encode(r.text or "", add_special_tokens=False).ids, 1]
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            want[(r.doc_id, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    places: dict[int, list[tuple[int, int]]] = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= capacity
    assert packing.pack(empty(spark), path).count() == 0


def test_exact_sums_are_found_under_their_counts():
    rng = random.Random(1)
    for _ in range(200):
        capacity = rng.randint(3, 40)
        counts = {k: rng.randint(1, 3) for k in rng.sample(range(1, capacity + 1), rng.randint(1, min(capacity, 8)))}
        left = packing._Lengths(counts, capacity)
        for k in counts:
            if rng.random() < 0.3:
                left.take(k, rng.randint(1, counts[k]))
        for gap in range(1, capacity + 1):
            assert left.longest(gap) == max((k for k in left.counts if k <= gap), default=0)
            for m in (1, 2, 3):
                every = itertools.combinations_with_replacement(sorted(left.counts, reverse=True), m)
                want = max((c for c in every if sum(c) == gap and all(c.count(k) <= left.counts[k] for k in c)), default=())
                assert left.exact(gap, m) == want


def test_plans_are_near_the_bound():
    rng = np.random.default_rng(0)
    for lengths in (np.clip(rng.lognormal(5, 1, 5000).astype(int) + 1, 1, 4096), rng.integers(1, 1500, 3000), np.ones(9000, int)):
        values, counts = np.unique(lengths, return_counts=True)
        bins = packing.plan(dict(zip(values.tolist(), counts.tolist(), strict=True)), 4096)
        used = Counter()
        for alike, parts in bins:
            assert sum(k * n for k, n in parts) <= 4096
            for k, n in parts:
                used[k] += alike * n
        assert used == dict(zip(values.tolist(), counts.tolist(), strict=True))
        assert sum(a for a, _ in bins) <= -(-int(lengths.sum()) // 4096) + 1


def windows(words):
    found, covered = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7)), set()
    for i in range(len(words) - 7):
        if found[tuple(words[i : i + 8])] > 1:
            covered |= set(range(i, i + 8))
    return len(covered)


def test_rule_counts(spark, docs):
    texts = ["a b c d e f g h " * 3, "# one | two\n# one | two\n\n", "x\x0by z"]
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = Counter(tuple(r)[:8] for r in rules.judge(more, none).collect())
    want = Counter()
    for r in more.collect():
        t = r.text or ""
        words = t.encode().split()
        lines, seen, dup = t.split("\n"), set(), 0
        for line in lines:
            if line.strip(" \t\n\x0b\x0c\r"):
                dup += line in seen
                seen.add(line)
        chars = sum(len(w.decode()) for w in words)
        repeat = windows(words)
        failed = len(words) < 20 or 100 * repeat > 30 * len(words)
        want[(r.doc_id, len(words), chars, sum(t.count(c) for c in "#*$%&|<>"), dup, repeat, failed, not failed)] += 1
    assert got == want


def test_forest_keeps_good_and_rejects_junk(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioustnr") for _ in range(rng.randrange(2, 9)))
    good = [" ".join(word() for _ in range(rng.randrange(30, 200))) + "." for _ in range(300)]
    junk = [" ".join(word() + "###" for _ in range(60)) for _ in range(40)] + [" ".join(word().upper() + "!!" for _ in range(60)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(good + junk)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i < 300 else 0) for i in range(0, 380, 2)], "doc_id long, quality int")
    kept = {r.doc_id for r in rules.judge(docs, labels).where("kept").collect()}
    held_out = range(1, 380, 2)
    assert sum(i in kept for i in held_out if i < 300) >= 147
    assert sum(i in kept for i in held_out if i >= 300) <= 1
    wide = docs.withColumn("kept", F.lit("mine"))
    assert {r.doc_id for r in rules.keep(wide, labels).collect()} == kept


def test_repeated_ids_and_labels_do_not_depend_on_order(spark):
    texts = ["plain words " * 30 + str(i) for i in range(8)]
    docs = spark.createDataFrame([(i % 4, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i % 4, i % 2) for i in range(12)] + [(1, 0), (None, 1)], "doc_id long, quality int")
    found = [rules.labelled_rates(d, x, 3) for d, x in ((docs.repartition(5), labels.repartition(3)), (docs.coalesce(1), labels.coalesce(1)))]
    (a, b), (c, d) = ([sorted(map(tuple, r)), sorted(g.tolist())] for r, g in found)
    assert a == c and b == d and len(a) <= 3


def test_capitals_count_in_every_script_whatever_the_text_begins_with():
    at = rules.RATES.index("upper_rate")
    for shout in ("ПРИВЕТ МИР ", "ΓΕΙΑ ΣΟΥ ", "ÉÀÜÖÄ ÇÑ ", "LOUD TEXT "):
        alone, after = (rules.statistics(begin + shout * 200)[1][at] for begin in ("", "an ordinary first line of the text\n"))
        assert alone > 0.9 and after > 0.9
    assert rules.statistics("Обычный текст без крика. " * 50)[1][at] == 0
