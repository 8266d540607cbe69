"""Near duplicates of embeddings against brute force: odd vectors and ids, copies, groups cut into blocks, several lengths, and the codes' misses at the threshold."""

import math

import numpy as np

from weftline.llm import embedding_dedup as ed

DDL = "vec_id long, embedding array<double>, label string, n_links string, node int"


def brute(rows, threshold=0.98):
    """n_links and component_id by place."""
    ok = [i for i, (v, e, g) in enumerate(rows) if v is not None and g is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)]
    unit = {i: ed.units(np.array([rows[i][1]]))[0] for i in ok}
    near = {i: [j for j in ok if j != i and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold] for i in ok}
    out = {}
    for i, row in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen), default=None) if row[0] is not None else None
        out[i] = (row[0], len(near.get(i, [])), least)
    return sorted(map(str, out.values()))


def found(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], DDL).repartition(4)
    got = ed.near_duplicates(df, **more).collect()
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    return sorted(str((r.vec_id, r.n_links, r.component_id)) for r in got)


def around(draw, centre, cosine, n):
    other = draw.normal(size=(n, len(centre)))
    other -= (other @ centre)[:, None] * centre
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    return cosine * centre + math.sqrt(1 - cosine**2) * other


def test_links_are_those_of_brute_force(spark):
    draw = np.random.default_rng(2)
    rows, at = [], 100
    for size in (2, 7, 32, 96):
        for label in "ab":
            centres = ed.units(draw.normal(size=(12, size)))
            for c in centres:
                for x in (*around(draw, c, 0.99, 4), *around(draw, c, 0.9, 1), 3.0 * c, c):
                    rows.append((at, (x * 10.0 ** draw.integers(-3, 4)).tolist(), label))
                    at += 1
    chain = [[math.cos(0.15 * i), math.sin(0.15 * i), 0.0] for i in range(20)]  # each links with the next only
    rows += [(at + 7 * i % 20, x, "chain") for i, x in enumerate(chain)]
    one = draw.normal(size=32).tolist()
    rows += [(i, one, "copies") for i in range(50)] + [(3, one, "copies"), (50, one, None), (51, one, "other")]
    rows += [(60, None, "a"), (61, [], "a"), (62, [0.0] * 32, "a"), (63, [None] + one[1:], "a"), (64, [math.nan] + one[1:], "a"), (65, [math.inf] + one[1:], "a")]
    rows += [(66, [1e300] * 32, "big"), (67, [1e-300] * 32, "big"), (68, [-1.0] * 32, "big"), (None, one, "copies"), (None, None, None)]
    assert found(spark, rows) == brute(rows)


def test_a_group_of_many_is_cut_into_blocks(spark):
    draw = np.random.default_rng(3)
    centre = ed.units(draw.normal(size=(1, 24)))[0]
    rows = [(i, x.tolist(), "hot") for i, x in enumerate(around(draw, centre, 0.991, 300))] + [(1000 + i, x.tolist(), "hot") for i, x in enumerate(draw.normal(size=(50, 24)))]
    cut, whole = found(spark, rows, block=40), found(spark, rows)
    assert cut == whole  # blocks lose nothing
    total = lambda told: sum(int(t.split(",")[1]) for t in told)
    assert 0.998 * total(brute(rows)) <= total(whole) <= total(brute(rows))


def test_codes_meet_at_the_threshold():
    draw = np.random.default_rng(4)
    unit = ed.units(draw.normal(size=(3000, 64)) @ draw.normal(size=(64, 64)))
    codes = ed.learn(unit, 12, 0.98)
    met = np.mean([(codes.keys(unit[i : i + 1]) == codes.keys(around(draw, unit[i], 0.98, 20))).any(axis=1).mean() for i in range(200)])
    assert met > 0.99
    bits = ((unit - codes.mean) @ codes.planes) >= 0
    assert 0.3 < bits.mean(axis=0).min() and bits.mean(axis=0).max() < 0.7  # balanced
    flat = ed.learn(np.zeros((0, 5)), 9, 0.98)
    assert flat.width == 5 and flat.keys(draw.normal(size=(3, 5))).shape == (3, flat.tables)


def test_empty_and_float_tables(spark):
    empty = spark.createDataFrame([], "vec_id int, embedding array<float>, label int")
    assert ed.near_duplicates(empty).count() == 0
    one = spark.createDataFrame([(1, [0.5, -0.0], 1), (2, [0.5, 0.0], 1), (3, [0.5, 0.25], 1)], empty.schema)
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in ed.near_duplicates(one).collect()) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
