"""Operators on vectors against brute force, with nulls, zeros, ties, repeats and clashing columns."""

import math

import numpy as np
import pytest

from proofsieve.llm import ego, rabitq

SCHEMA = "vec_id bigint, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16))
    rows = []
    for k in range(400):
        c = centres[rng.integers(12)]
        rows.append((k, (c + rng.normal(size=16) * rng.choice([0.05, 0.3, 1.0])).astype(np.float32).tolist(), int(rng.integers(3)) if k % 17 else None))
    same = rows[5][1]
    rows += [(500 + k, same, 1) for k in range(30)] + [(600, [x * 2 for x in same], 1), (601, None, 1), (602, [0.0] * 16, 1), (603, [None, *same[1:]], 1), (604, [math.nan, *same[1:]], 1), (605, [math.inf, *same[1:]], 1), (606, same[:8], 1), (607, [], 1), (None, same, 1), (620, same, None)]
    return rows


@pytest.fixture(scope="module")
def table(spark, vectors):
    return spark.createDataFrame(vectors, SCHEMA).selectExpr("*", "1 as v", "2 as rep", "3 as block", "4 as ids", "5 as weight", "6 as score", "7 as rank")


def usable(v):
    return bool(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)


def test_near_duplicates(table, vectors):
    good = [(i, np.array(v, float), n) for i, v, n in vectors if i is not None and n is not None and usable(v)]
    links = {i: set() for i, _, _ in good}
    for a, x, n in good:
        for b, y, m in good:
            if a < b and n == m and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93:
                links[a].add(b)
                links[b].add(a)
    root = {i: i for i in links}
    for _ in range(30):
        for a in links:
            root[a] = min([root[a], *(root[b] for b in links[a])])
    want = sorted(((i, len(links.get(i, ())), root.get(i, i), root.get(i, i) == i) for i, _, _ in vectors), key=str)
    assert sorted(map(tuple, ego.near_duplicates(table).collect()), key=str) == want
    assert max(w[1] for w in want) >= 30
    assert ego.near_duplicates(table.limit(0)).count() == 0


def test_ego_join_skips_nothing_that_links():
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(40, 8)), 30, axis=0) + rng.normal(size=(1200, 8)) * 0.05
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    eps = math.sqrt(2 - 2 * 0.93)
    order = np.lexsort(np.floor(x[:, :4] / eps).T[::-1])
    x = x[order]
    whole = ego.Interval(np.arange(1200), np.ones(1200, np.int64), x, x[:, :4])
    found = np.zeros(1200, int)
    for ids, n, _ in ego.ego_join(whole, whole, 0.93, eps + ego.SLACK):
        np.add.at(found, ids, n)
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    assert (found == near.sum(axis=1)).all()


def test_nearest(table, vectors):
    good = [(i, np.array(v, float)) for i, v, _ in vectors if i is not None and usable(v)]
    got = {}
    for r in rabitq.nearest(table, k=20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {i for i, _ in good if i % 20 == 0}
    hit = total = 0
    for q, x in good:
        if q % 20 == 0:
            near = sorted((-float((x * y).sum()), i) for i, y in good if i != q and len(y) == len(x))[:20]
            rows = sorted(got[q])
            assert [r[0] for r in rows] == list(range(1, len(near) + 1))
            exact = {i: -s for s, i in near}
            assert all(s == pytest.approx(exact[i], rel=1e-12) for _, i, s in rows if i in exact)
            assert rows == sorted(rows, key=lambda r: (-r[2], r[1]))
            hit += len({i for _, i, _ in rows} & set(exact))
            total += len(near)
    assert hit / total >= 0.97
    few = rabitq.nearest(table.where("vec_id in (0, 1, 2)"), k=20).collect()
    assert len(few) == 2 and rabitq.nearest(table.limit(0)).count() == 0


def test_near_duplicates_with_repeated_ids(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(2, 16))
    rows = [(5, a), (5, b), (6, a + 0.01), (20, a), (20, b), (7, rng.normal(size=16))]
    table = spark.createDataFrame([(i, v.astype(np.float32).tolist(), 1) for i, v in rows], SCHEMA)
    got = sorted(map(tuple, ego.near_duplicates(table).select("vec_id", "n_links", "component_id").collect()))
    # Each row is a vector of its own: two rows have a, two have b, and 6 is near a.
    assert got == [(5, 1, 5), (5, 2, 5), (6, 2, 5), (7, 0, 7), (20, 1, 5), (20, 2, 5)]


def test_near_duplicates_over_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(30, 12)), 20, axis=0) + rng.normal(size=(600, 12)) * rng.choice([0.02, 0.2], (600, 1))
    x = x.astype(np.float32)
    table = spark.createDataFrame([(k, v.tolist(), k % 2) for k, v in enumerate(x)], SCHEMA)
    monkeypatch.setattr(ego, "BLOCK", 8 * 12 * 25)
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    near = (y @ y.T >= 0.93) & (np.arange(600)[:, None] % 2 == np.arange(600) % 2)
    root = np.arange(600)
    for _ in range(50):
        root = np.where(near, root[None, :], 600).min(axis=1)
    want = sorted((k, int(near[k].sum()) - 1, int(root[k])) for k in range(600))
    assert sorted(map(tuple, ego.near_duplicates(table).select("vec_id", "n_links", "component_id").collect())) == want


def test_nearest_over_many_blocks(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 70)).astype(np.float32)
    monkeypatch.setattr(rabitq, "CODES", 64)
    monkeypatch.setattr(rabitq, "QUERIES", 8)
    got = {}
    for r in rabitq.nearest(spark.createDataFrame([(k, v.tolist(), 0) for k, v in enumerate(x)], SCHEMA).repartition(3)).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    y, hit = x.astype(float), 0
    assert set(got) == set(range(0, 900, 20))
    for q, rows in got.items():
        near = sorted((-float((y[q] * y[i]).sum()), i) for i in range(900) if i != q)[:20]
        rows = sorted(rows)
        assert [r[0] for r in rows] == list(range(1, 21)) and len({r[1] for r in rows}) == 20
        hit += len({i for _, i in near} & {r[1] for r in rows})
    assert hit / (20 * len(got)) >= 0.97


def test_nearest_with_repeated_ids(spark):
    rng = np.random.default_rng(9)
    a, b, c = rng.normal(size=(3, 16)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist(), 0) for i, v in [(20, a), (20, b), (5, a), (5, b), (6, c)]], SCHEMA)
    dot = lambda x, y: float((x.astype(float) * y.astype(float)).sum())
    want = []
    for q in (a, b):  # a list for each of the two rows
        near = sorted((-dot(q, v), i) for i, v in [(5, a), (5, b), (6, c)])
        want += [(20, k + 1, i, round(-s, 9)) for k, (s, i) in enumerate(near)]
    assert sorted((r[0], r[1], r[2], round(r[3], 9)) for r in rabitq.nearest(table).collect()) == sorted(want)


def test_estimates_keep_to_their_bounds():
    rng = np.random.default_rng(10)
    for dim in (13, 64, 200):
        x, q = rng.normal(size=(2000, dim)), rng.normal(size=(50, dim))
        mean, turn = x.mean(axis=0), rabitq.rotation(dim)
        value, error = rabitq.Codes.of(x, mean, turn).estimates(q, mean, turn, 2.4)
        off = value - q @ x.T
        assert (np.abs(off) <= error).mean() > 0.97 and abs(off.mean()) < 0.05 * error.mean()
