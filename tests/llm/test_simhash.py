import random

import numpy as np
import pytest
import xxhash
from llm_cases import TEXTS, documents, empty

from tidewheel.llm import simhash as s
from tidewheel.llm.store import Workspace


def plain(text, k=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(values, near):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(values))]


@pytest.mark.parametrize("text", [None, "", "a", "A b", "a b c", "a b a b a b a b", "Ž b\x0bc d é\xa0f g"])
def test_fingerprint(text):
    assert s.fingerprint((text or "").encode()) == plain(text)


def balls(rng, hot):
    """Distinct fingerprints: noise, close chains and a dense ball."""
    out = {rng.getrandbits(64) for _ in range(150)}
    base = rng.getrandbits(64)
    for _ in range(hot):
        x = base
        for b in rng.sample(range(64), rng.choice([0, 1, 1, 2, 3, 4])):
            x ^= 1 << b
        out.add(x)
    x = rng.getrandbits(64)
    for _ in range(12):
        x ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("tau, bucket, most, hot", [(2, 32, 5, 120), (2, 3, 5, 120), (2, 32, 2, 60), (1, 3, 5, 80), (0, 32, 5, 20), (2, 1000, 1, 40)])
def test_links_connect_what_is_near(spark, tau, bucket, most, hot):
    values = balls(random.Random(tau + bucket), hot)
    df = spark.createDataFrame([(i, s._long(v)) for i, v in enumerate(values)], "rep long, fp long")
    edges = s.links(df, Workspace(spark, "t"), tau, most, bucket)
    comp = s.connected_components(edges, Workspace(spark, "t"))
    got = {r["id"]: r["component"] for r in comp.collect()}
    want = components(values, lambda a, b: (a ^ b).bit_count() <= tau)
    assert [got.get(i, i) for i in range(len(values))] == want


def test_allotment_meets_the_bound():
    rng = random.Random(5)
    for m in (1, 2, 3, 5):
        costs = [[0.0] + sorted(rng.random() for _ in range(3)) for _ in range(m)]
        _, ts = s.allot(costs, 2)
        assert sum(ts) == 2 - m + 1 and all(-1 <= t <= 2 for t in ts)


def test_correlated_bits_share_a_group():
    rng = np.random.default_rng(1)
    half = rng.integers(0, 2, (500, 32))
    bits = np.concatenate([half, half], axis=1)
    fps = np.packbits(bits.astype(np.uint8), axis=1, bitorder="little").view(np.uint64)[:, 0]
    groups = s.group_bits(s.co_counts(fps), 500, 4)
    assert sorted(b for g in groups for b in g) == list(range(64))
    assert all(b + 32 in g for g in groups for b in g if b < 32)


def test_chances_are_exact_within_octets():
    h = np.zeros(256, np.int64)
    h[[0, 1]] = 1
    assert np.allclose(s.distance_chances([h], 2), [0.5, 1, 1])


def test_edges(spark):
    got = {r["doc_id"]: r for r in s.near_duplicates(documents(spark), Workspace(spark, "t")).collect()}
    assert all(got[i]["fingerprint"] == f"{plain(t):016x}" for i, t in TEXTS.items())
    assert [got[i]["component_id"] for i in (2, 4, 5, 9, 11)] == [1, 3, 3, 8, 1]
    assert got[3]["fingerprint"] == "0" * 16 and got[None]["component_id"] is None
    assert s.near_duplicates(documents(spark), Workspace(spark, "t")).count() == len(TEXTS) + 2
    assert s.near_duplicates(empty(spark), Workspace(spark, "t")).count() == 0


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_similar_documents_equal_brute_force(spark):
    rng = random.Random(7)
    texts = []
    for _ in range(25):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([30, 120, 300]))]
        for _ in range(rng.choice([1, 3, 12])):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 2, 4, 15])):
                copy[rng.randrange(len(copy))] = "edit"
            texts.append(" ".join(copy))
    sets = [shingles(t) for t in texts]
    want = components(sets, lambda a, b: len(a & b) >= 0.8 * len(a | b))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in s.similar_documents(df, Workspace(spark, "t")).collect()}
    assert sum(got.get(i, i) == w for i, w in enumerate(want)) >= 0.99 * len(texts)


@pytest.mark.parametrize("together", [256, 4])
def test_blocks_lose_no_link(spark, together):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for i in range(30):
        copy = list(base)
        copy[rng.randrange(100)] = f"e{i}"
        texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ws = Workspace(spark, "t")
    edges = s.similar_links(df, s.sketches(df), ws, 5, 42, 0.8, together)
    assert {r["component"] for r in s.connected_components(edges, ws).collect()} == {0}


def test_drop_keeps_one_and_its_columns(spark):
    df = documents(spark)
    got = s.drop_near_duplicates(df, Workspace(spark, "t"))
    assert got.columns == df.columns
    assert sorted({r["doc_id"] or 0 for r in got.collect()}) == [0, 1, 3, 6, 7, 8, 10]
    assert s.drop_near_duplicates(empty(spark), Workspace(spark, "t")).count() == 0


def test_long_chain_is_one_component(spark):
    from tidewheel.llm.graph import connected_components

    order = list(range(300))
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame(list(zip(order, order[1:])) + [(5, 5), (None, 3), (900, 901)], "a long, b long")
    got = {r["id"]: r["component"] for r in connected_components(edges, Workspace(spark, "t")).collect()}
    assert {got[i] for i in range(300)} == {0} and got[901] == 900 and len(got) == 302


@pytest.mark.parametrize("segment", [1, 7, 64])
@pytest.mark.parametrize("width", [1, 3, 5])
def test_segments_of_a_text_lose_no_shingle(monkeypatch, segment, width):
    rng = random.Random(segment * 10 + width)
    for n in (0, 1, 2, 4, 5, 6, 40, 300):
        raw = "".join(rng.choice(["a", "Žodis", "word", ""]) + rng.choice([" ", "  ", "\t\n", "\u00a0 ", "\x1c "]) for _ in range(n)).encode()
        words = raw.lower().split()
        whole = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
        monkeypatch.setattr(s, "SEGMENT", segment)
        got = [int(x) for block in s.shingle_hashes(raw, width) for x in block]
        assert got == [xxhash.xxh64_intdigest(w, 42) for w in whole]
