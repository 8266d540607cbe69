"""Periodic runs and the prefix trie against brute force: nulls, empty and long rows, ties, repeated rows, empty tables, clashing columns, many tasks and many copies."""

import random
import zlib
from collections import defaultdict
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import periodic, trie


def brute_runs(w, least=6, times=4):
    n, out = len(w), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, times * q) and not any(w[i : i + size - p] == w[i + p : i + size] for p in range(1, q)):
                out.append((i, size, q))
            i = max(j, i) + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=60), st.integers(1, 9), st.integers(0, 40), st.integers(2, 5))
def test_runs_are_all_runs(words, period, more, times):
    words = words + [words[-(period - i % period) if len(words) >= period else -1] for i in range(more)] if words else words
    assert periodic.runs(words, 6, times) == brute_runs(words, 6, times)


def test_runs_of_long_texts_take_little():
    one = [b"x"] * 30_000
    assert periodic.runs(one) == [(0, 30_000, 1)]
    assert periodic.collapsed(one, periodic.runs(one)) == [b"x"]
    back = [b"%d" % (i % 7_000) for i in range(30_000)]
    assert periodic.runs(back) == [(0, 30_000, 7_000)]


def test_runs_by_document(spark):
    draw = random.Random(5)
    texts = [None, "", " \n", "a", "a " * 6, "a b " * 4, "\x0b".join("abc" * 5), "é  " * 9]
    texts += [" ".join(draw.choice("ab") for _ in range(draw.randrange(80))) for _ in range(60)]
    rows = [(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "a " * 9, 1, "y"), (4, texts[4], 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs int, period string").repartition(3)
    got = sorted(periodic.digests(docs, rebuild=True).collect(), key=lambda r: tuple(map(str, r)))
    want = []
    for i, t, *_ in rows:
        words = periodic.rebuilt((t or "").encode().split(), i)
        runs = brute_runs(words)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        best = sorted(runs, key=lambda r: (-r[1], r[0], r[2]))[:1]
        told = [*best[0], 1000 * best[0][1] // best[0][2]] if best else [None] * 4
        listed = sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        want.append((i, len(runs), *told, listed, sha256(b" ".join(w for k, w in enumerate(words) if k not in gone)).hexdigest()))
    assert [tuple(map(str, r)) for r in got] == sorted(tuple(map(str, r)) for r in want)
    assert periodic.digests(docs.limit(0)).count() == 0
    kept = {r.doc_id: r.text for r in periodic.collapse(docs.where("doc_id < 8")).collect()}
    assert kept[0] is None and kept[1] == "" and kept[4] == "a" and kept[5] == "a b"


def brute_trie(seqs):
    """{conv_id: [(turn, words)]} to the rows of the trie."""
    members, words = defaultdict(list), {}
    for c, turns in seqs.items():
        for d in range(len(turns) + 1):
            key = tuple(t for t, _ in turns[:d])
            members[key].append(c)
            words[key] = turns[d - 1][1] if d else 0
    children = defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for k in members:
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(members[k]) - 1) * words[k]
    return sorted(
        (min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), children[k], leaves[k], saved[k],
         sha256(",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(k)).encode()).hexdigest())
        for k, m in members.items()
    )


def as_rows(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


@pytest.mark.parametrize("seed", range(4))
def test_trie_over_many_tasks(spark, seed):
    """Small bounds, so that children are written before their parent and ids in pieces, over 1 to 13 range partitions."""
    draw = random.Random(seed)
    kinds = [(bytes([65 + i]), i) for i in range(3 + seed)]
    seqs = {c: [draw.choice(kinds) for _ in range(draw.choice([0, 1, 2, 3, 5, 9]))] for c in range(-5, 300)}
    for c in range(300, 420):  # copies of one, and long ones that share all but their end
        seqs[c] = [kinds[1]] * 4 if c % 2 else [kinds[0]] * 30 + [kinds[c % 3]]
    rows = [(c, [t for t, _ in s], [w for _, w in s]) for c, s in seqs.items()]
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str([1, 4, 7, 13][seed]))
    try:
        df = spark.createDataFrame(rows, "conv_id long, turns array<binary>, words array<bigint>").repartition(3)
        got = as_rows(trie.nodes(df, waiting=3, piece=20, small=10 * seed))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == brute_trie(seqs)


def test_trie_of_odd_rows(spark):
    rows = [
        (0, 1, "user", "a b"), (0, None, None, None), (0, 0, "user", "x"), (1, 5, "user", None), (1, 5, "user", ""), (1, 5, "bot", ""), (3, 0, "", "u:x"), (3, 0, "u:", "x"),
        (20, 0, "user", "q q"), (20, 1, "bot", "r"), (21, 0, "user", "s"), (21, 1, "bot", "t"), (21, 2, "user", "v\x0bw"), (39, 0, "user", "only"), (60, 0, None, "long " * 50_000), (None, 0, "user", "none"),
    ]
    table = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, role string, text string, depth int").repartition(4)
    plain = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            plain[c].append((turn is not None, turn or 0, role or "", text or ""))
    plain = {c: sorted(v) for c, v in plain.items()}
    got = trie.prefix_trie(table, rebuild=False)
    ordered = trie.sequences(table).collect()
    assert {r.conv_id: len(r.turns) for r in ordered} == {c: len(v) for c, v in plain.items()}
    assert got.where("depth = 0").count() == 1 and got.where("depth = 0").first().n_convs == len(plain)
    again = {}
    for c, own in plain.items():
        h = zlib.crc32(str(c).encode()) % 4
        again[c] = plain.get(c - c % 20, [])[:h] + own[h:]
    named = {c: [((r, t), len(t.encode().split())) for _, _, r, t in v] for c, v in again.items()}
    assert as_rows(trie.prefix_trie(table, rebuild=True)) == brute_trie(named)
    assert trie.prefix_trie(table.limit(0), rebuild=True).count() == 0
    assert trie.prefix_trie(table.withColumn("turn", F.lit(None).cast("long")), rebuild=True).where("depth = 0").count() == 1
