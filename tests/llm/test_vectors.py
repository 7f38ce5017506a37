import math

import numpy as np
from test_simhash import components

from tidewheel.llm import vectors as v
from tidewheel.llm.store import Workspace


def brute(x, labels, ids):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    comp = components(list(range(len(x))), lambda a, b: near[a, b])
    return near.sum(1), [ids[c] for c in comp]


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(v, "PER_LIST", 30)
    monkeypatch.setattr(v, "BLOCK", 32)
    monkeypatch.setattr(v, "MEMBERS", 40)
    monkeypatch.setattr(v, "QUERIES", 50)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 32))
    x = np.concatenate([base[rng.integers(0, 40, 400)] + rng.normal(size=(400, 32)) * rng.choice([0.0, 0.15, 0.27], (400, 1)), rng.normal(size=(150, 32))])
    x = x.astype(np.float32).astype(np.float64)
    labels, ids = rng.integers(0, 2, len(x)), np.arange(len(x))
    df = spark.createDataFrame([(int(i), [float(a) for a in r], int(k)) for i, r, k in zip(ids, x, labels)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r for r in v.near_duplicates(df, Workspace(spark, "t")).collect()}
    n, comp = brute(x, labels, ids)
    found = sum(got[i]["n_links"] for i in ids)
    assert found <= n.sum() and found >= 0.99 * n.sum()
    assert all(got[i]["n_links"] <= n[i] for i in ids)
    assert np.mean([got[i]["component_id"] == c for i, c in zip(ids, comp)]) >= 0.99


def test_edges(spark):
    a = [1.0, 0.0, 0.0]
    rows = [
        (1, a, 1), (2, a, 1), (3, [2.0, 0.0, 0.0], 1), (4, a, 2), (5, a, None), (6, None, 1), (7, [0.0, 0.0, 0.0], 1),
        (8, [1.0, None, 0.0], 1), (9, [math.nan, 1.0, 0.0], 1), (10, [math.inf, 1.0, 0.0], 1), (11, [], 1), (12, [1.0, 0.0], 1),
        (13, [-1.0, 0.0, 0.0], 1), (None, a, 1), (1, a, 1), (14, [1e30, 1e29, 0.0], 1),
    ]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, label int, rep string, cell string")
    got = v.near_duplicates(df, Workspace(spark, "t")).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: r for r in got}
    assert [by[i]["component_id"] for i in (1, 2, 3, 14)] == [1, 1, 1, 1] and by[2]["n_links"] == 4 and by[3]["n_links"] == 4
    assert all(by[i]["n_links"] == 0 and by[i]["kept"] for i in (4, 5, 6, 7, 8, 9, 10, 11, 12, 13))
    assert by[None]["n_links"] == 0 and not by[None]["kept"]
    assert v.near_duplicates(df.limit(0), Workspace(spark, "t")).count() == 0


def test_a_hot_group_is_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(v, "BLOCK", 64)
    monkeypatch.setattr(v, "MEMBERS", 128)
    monkeypatch.setattr(v, "QUERIES", 200)
    rng = np.random.default_rng(5)
    x = np.ones((700, 16)) + rng.normal(size=(700, 16)) * 0.05
    df = spark.createDataFrame([(i, [float(a) for a in r], 0) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = v.near_duplicates(df, Workspace(spark, "t")).collect()
    assert {r["n_links"] for r in got} == {699} and {r["component_id"] for r in got} == {0}


def test_no_link_is_lost_across_many_lists(spark, monkeypatch):
    monkeypatch.setattr(v, "PER_LIST", 16)
    rng = np.random.default_rng(6)
    x = (rng.normal(size=(3200, 4)) @ rng.normal(size=(4, 64))).astype(np.float32).astype(np.float64)
    ids = rng.permutation(len(x))
    assert v.train(x / np.linalg.norm(x, axis=1)[:, None], len(x)).lists == 200
    df = spark.createDataFrame([(int(i), [float(a) for a in r], 0) for i, r in zip(ids, x)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r["n_links"] for r in v.near_duplicates(df, Workspace(spark, "t")).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = dict(zip(ids.tolist(), ((u @ u.T >= 0.93).sum(1) - 1).tolist(), strict=True))
    print("links", sum(got.values()), "of", sum(want.values()))
    assert got == want


def clustered(rng, n, dim, spread, toward=None):
    """Unit vectors in groups; ``toward`` shifts half of a group along one direction of the whole set."""
    base = rng.normal(size=(n // 20, dim))
    base /= np.linalg.norm(base, axis=1)[:, None]
    x = base[rng.integers(0, len(base), n)] + rng.normal(size=(n, dim)) * spread / np.sqrt(dim)
    return x if toward is None else x + toward * rng.choice([0.0, 0.3], (n, 1))


def test_recall_of_the_measured_width(spark, monkeypatch):
    monkeypatch.setattr(v, "PER_LIST", 50)
    rng = np.random.default_rng(12)
    aim = rng.normal(size=64)
    sets = {
        "isotropic": clustered(rng, 4000, 64, 0.25),
        "tight": clustered(rng, 4000, 64, 0.08),
        "shifted": clustered(rng, 4000, 64, 0.1, aim / np.linalg.norm(aim)),
        "low": rng.normal(size=(4000, 5)) @ rng.normal(size=(5, 64)),
    }
    for name, x in sets.items():
        x = x.astype(np.float32).astype(np.float64)
        ids = rng.permutation(len(x))
        df = spark.createDataFrame([(int(i), [float(a) for a in r], 0) for i, r in zip(ids, x)], "vec_id long, embedding array<float>, label int")
        assert next(iter(v.fit(df.selectExpr("vec_id rep", "label", "embedding", "size(embedding) dim")).values())).lists >= 64
        got = {r["vec_id"]: r["n_links"] for r in v.near_duplicates(df, Workspace(spark, "t")).collect()}
        u = x / np.linalg.norm(x, axis=1)[:, None]
        want = dict(zip(ids.tolist(), ((u @ u.T >= 0.93).sum(1) - 1).tolist(), strict=True))
        print(name, "links", sum(got.values()), "of", sum(want.values()))
        assert all(got[i] <= want[i] for i in want)
        assert sum(got.values()) >= 0.99 * sum(want.values())


def test_products_of_quantisers_lose_nothing_at_the_whole_radius(spark, monkeypatch):
    monkeypatch.setattr(v, "PER_LIST", 8)
    monkeypatch.setattr(v, "CENTROIDS", 16)
    monkeypatch.setattr(v, "EVIDENCE", 10**9)
    rng = np.random.default_rng(13)
    x = clustered(rng, 1500, 24, 0.25).astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(i, [float(a) for a in r], 0) for i, r in enumerate(x)], "vec_id long, embedding array<float>, label int")
    assert len(v.train(x / np.linalg.norm(x, axis=1)[:, None], len(x)).coarse) == 2
    got = [r["n_links"] for r in v.near_duplicates(df, Workspace(spark, "t")).orderBy("vec_id").collect()]
    assert got == brute(x, np.zeros(len(x)), list(range(len(x))))[0].tolist()


def test_rare_lengths_need_no_index(spark, monkeypatch):
    monkeypatch.setattr(v, "LENGTHS", 1)
    rows = [(100 * d + i, [1.0] * (d - 1) + [1.0 + i / 10], 0) for d in range(2, 30) for i in range(3)] + [(9000 + i, [1.0, 0.0, float(i)], 0) for i in range(9)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r["n_links"] for r in v.near_duplicates(df, Workspace(spark, "t")).collect()}
    assert all(got[100 * d + i] >= 2 for d in range(4, 30) for i in range(3))
