import random

import pytest
from llm_cases import CLASH, TEXTS, documents, empty

from tidewheel.llm import exact_dedup as x
from tidewheel.llm.store import Workspace
from tidewheel.llm.text import squeeze


def test_chunks_combine():
    data = random.Random(1).randbytes(10_000)
    for chunk in (1, 7, 4096, 20_000):
        assert x.fingerprint(data, chunk=chunk) == int.from_bytes(data, "big") % x.MODULUS
    assert x.combine([]) == 0


def test_modulus_is_prime():
    assert all(pow(a, x.MODULUS - 1, x.MODULUS) == 1 for a in (2, 3, 5, 7, 11, 13))


@pytest.mark.parametrize("raw, want", [(b"", b""), (b" \n", b" "), (b"a", b"a"), (b"\t a \r\n b", b" a b"), (b"a \xc2\xa0b ", b"a \xc2\xa0b ")])
def test_squeeze(raw, want):
    assert squeeze(raw) == want


def brute(rows):
    norm = {i: squeeze((t or "").encode()) for i, t in rows}
    first = {}
    for i in sorted(norm):
        first.setdefault(norm[i], i)
    return {i: first[t] for i, t in norm.items()}


@pytest.mark.parametrize("modulus, split", [(x.MODULUS, 1 << 24), (x.MODULUS, 64), (3, 1 << 24), (1, 1 << 24)])
def test_equals_brute_force_even_when_fingerprints_collide(spark, modulus, split):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a b", "a  b", "c d", "d c", " a b", None, "", "x" * 300 + rng.choice("yz")])) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = x.exact_duplicates(df, Workspace(spark, "t"), modulus, split).collect()
    want = brute(rows)
    assert {r["doc_id"]: r["keep_id"] for r in got} == want
    sizes = {k: sum(v == k for v in want.values()) for k in want.values()}
    assert all(r["group_size"] == sizes[r["keep_id"]] and r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)
    assert len(got) == 60


def test_edges(spark):
    got = x.exact_duplicates(documents(spark), Workspace(spark, "t")).collect()
    assert len(got) == len(TEXTS) + 2
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert [r["keep_id"] for r in by[2] + by[11]] == [1, 1] and by[1][0]["group_size"] == 4
    assert sum(r["kept"] for r in by[1]) == 1
    assert by[4][0]["keep_id"] == 3 and by[5][0]["keep_id"] == 5 and by[7][0]["keep_id"] == 7
    assert by[None][0]["kept"] and by[None][0]["keep_id"] is None
    assert x.exact_duplicates(empty(spark), Workspace(spark, "t")).count() == 0


def test_drop_keeps_columns_and_first_rows(spark):
    df = documents(spark)
    got = x.drop_exact_duplicates(df, Workspace(spark, "t"))
    assert got.columns == df.columns and set(CLASH) < set(got.columns)
    assert sorted(r["doc_id"] or 0 for r in got.collect()) == [0, 1, 3, 5, 6, 7, 8, 9, 10]
