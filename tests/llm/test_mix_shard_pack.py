import zlib

import numpy as np
import pytest
from llm_cases import TEXTS, documents, empty
from tokenizers import Tokenizer

from tidewheel.llm import mixing, packing, sharding
from tidewheel.llm.store import Workspace


def level(sizes, weights, epochs):
    """Reshare the excess until no source is above its cap."""
    caps, total = [epochs * s for s in sizes], sum(sizes)
    target, full = [0.0] * len(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in full]
        rest = total - sum(caps[i] for i in full)
        for i in range(len(sizes)):
            target[i] = caps[i] if i in full else rest * weights[i] / sum(weights[j] for j in free)
        over = {i for i in free if target[i] > caps[i] + 1e-9}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("sizes", [[100, 100, 100], [1, 1000, 5, 70, 3, 0, 2], [0, 0], [10], [1, 1, 10_000]])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size long")
    got = [r["target"] for r in mixing.source_targets(df).orderBy("source").collect()]
    assert np.allclose(got, level(sizes, [(1, 2, 3)[i % 3] for i in range(len(sizes))], 3))


def test_mix_meets_targets_and_repeats(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(0, 60)), None, None if i % 17 == 0 else f"s{int(rng.choice(5, p=[0.6, 0.2, 0.1, 0.06, 0.04]))}", None) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    run = lambda: sorted(mixing.mix(df, Workspace(spark, "t")).collect(), key=lambda r: r["doc_id"])
    got = run()
    assert got == run() and [r["size"] for r in got] == [len(r[1].split()) for r in rows]
    by = {}
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(r["source"], []).append(r)
    for rs in by.values():
        assert abs(sum(r["taken"] for r in rs) - rs[0]["target"]) <= 3
        assert rs[0]["source_size"] == sum(r["size"] for r in rs)
    assert sum(rs[0]["target"] for rs in by.values()) == pytest.approx(sum(r["size"] for r in got))


@pytest.mark.parametrize("probs", [[0.6, 0.2, 0.1, 0.06, 0.04], [0.98, 0.01, 0.004, 0.004, 0.002], [0.5, 0.5, 0, 0, 0]])
def test_mix_equals_sql(spark, tmp_path, probs):
    import duckdb

    from tidewheel.llm.registry import ORACLES, QUERIES

    rng = np.random.default_rng(3)
    rows = [(None if i % 50 == 7 else i, None if i % 31 == 0 else "w\tä\u00a0b \n" * int(rng.integers(0, 60)), None, (None, "", "é", "Z", "a")[int(rng.choice(5, p=probs))], None) for i in range(900)]
    rows += [(1000, None, None, "empty", None), (1001, "", None, "empty", 0)] + rows[:40]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = con.execute(ORACLES["op4_mixing"])
    cols = [c[0] for c in got.description]
    have = QUERIES["op4_mixing"](spark, str(tmp_path)).select(*cols).collect()
    assert sorted(map(repr, map(tuple, have))) == sorted(map(repr, got.fetchall())) and len(have) == len(rows)


def test_mix_edges(spark):
    got = mixing.mix(documents(spark), Workspace(spark, "t")).collect()
    assert len(got) == len(TEXTS) + 2 and all(r["size"] == 0 for r in got if r["doc_id"] in (3, 4, 5))
    assert mixing.mix(empty(spark), Workspace(spark, "t")).count() == 0
    df = documents(spark)
    whole = mixing.sample_mix(df, Workspace(spark, "t"))
    assert whole.columns == df.columns and {r["text"] for r in whole.collect()} <= {r["text"] for r in df.collect()}
    assert mixing.sample_mix(empty(spark), Workspace(spark, "t")).count() == 0


def jump(key, shards):
    b, j, key = -1, 0, key % 2**64
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (2**31 / ((key >> 33) + 1)))
    return b


def test_jump_hash():
    keys = np.array([0, 1, -1, 12345, 2**62, -(2**63)])
    for n in (1, 2, 24, 1000):
        assert sharding.jump_hash(keys, n).tolist() == [jump(int(k), n) for k in keys]


def test_shards(spark):
    df = spark.createDataFrame([(i, f"tėxt {i % 7}") for i in range(3000)], "doc_id long, text string").repartition(5)
    got = sharding.assign_shards(df, Workspace(spark, "t")).collect()
    assert all(r["shard"] == jump(r["doc_id"], 24) and r["grown_shard"] == jump(r["doc_id"], 25) for r in got)
    assert {r["grown_shard"] for r in got if r["grown_shard"] != r["shard"]} == {24}
    for k in range(24):
        slots = sorted(r["slot"] for r in got if r["shard"] == k)
        assert slots == list(range(len(slots)))
    assert all(r["size"] == 8 + len(f"tėxt {r['doc_id'] % 7}".encode()) and r["text_crc32"] == zlib.crc32(f"tėxt {r['doc_id'] % 7}".encode()) for r in got)


def test_shard_edges(spark):
    got = sharding.assign_shards(documents(spark), Workspace(spark, "t")).collect()
    assert len(got) == len(TEXTS) + 2
    assert {r["size"] for r in got if r["doc_id"] in (3, 4)} == {8} and {r["shard"] for r in got if r["doc_id"] is None} == {jump(0, 24)}
    assert sharding.assign_shards(empty(spark), Workspace(spark, "t")).count() == 0


def test_first_fit_is_the_plain_one():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 7, 200):
        lengths = rng.integers(1, 101, n)
        where, at, bins = packing.first_fit_decreasing(lengths, 100)
        free, want = [], {}
        for i in np.argsort(-lengths, kind="stable"):
            k = next((k for k, f in enumerate(free) if f >= lengths[i]), len(free))
            if k == len(free):
                free.append(100)
            want[i] = (k, 100 - free[k])
            free[k] -= lengths[i]
        assert bins == len(free) and [(where[i], at[i]) for i in range(n)] == [want[i] for i in range(n)]


SAMPLES = ["", "labas rytas, pasauli!", "don't  stop\n\n now 123", "<|endoftext|> a <|endoftext|>", "žąčęė 日本語 🙂", " lead", "\u00a0x \u2028y", "tail  "]


def test_ids_are_those_of_the_library():
    path = packing.default_tokenizer()
    slow, fast = Tokenizer.from_file(path), packing.load_encoder(path)
    for t in [*SAMPLES, *(t for t in TEXTS.values() if t)]:
        assert list(fast(t)) == slow.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("group", [1024, 3])
def test_packing_is_a_round_trip(spark, monkeypatch, group):
    monkeypatch.setattr(packing, "GROUP", group)
    slow = Tokenizer.from_file(packing.default_tokenizer())
    got = packing.pack(documents(spark), Workspace(spark, "t")).collect()
    assert sorted(r["offset"] for r in got if r["doc_id"] is None)[0] >= 0
    for i, t in TEXTS.items():
        ids = [*slow.encode(t or "", add_special_tokens=False).ids, 1]
        mine = sorted([r for r in got if r["doc_id"] == i], key=lambda r: r["start"])
        if i != 1:  # row 1 is repeated
            assert [r["start"] for r in mine] == [sum(x["length"] for x in mine[:k]) for k in range(len(mine))]
            assert sum(r["length"] for r in mine) == len(ids)
        for r in mine:
            piece = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert zlib.crc32(piece.tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["padded"]))
    for rows in by.values():
        rows.sort()
        used = sum(n for _, n, _ in rows)
        assert used <= 2048 and [o for o, _, _ in rows] == [sum(n for _, n, _ in rows[:k]) for k in range(len(rows))]
        assert {p for _, _, p in rows} == {used if used & (used - 1) == 0 else 2048}
    assert packing.pack(empty(spark), Workspace(spark, "t")).count() == 0
