"""Queries read their whole input; the oracle SQL is used here without its cuts."""

from pathlib import Path

import pytest

duckdb = pytest.importorskip("duckdb")

from tidewheel.operators.agreement import key_of  # noqa: E402
from tidewheel.plans import fixtures as fx  # noqa: E402
from tidewheel.plans.registry import ORACLES, QUERIES  # noqa: E402

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")


def test_wrapped_turns_keeps_every_word(spark):
    got = {(r["conv_id"], r["turn"]): r for r in QUERIES["wrapped_turns"](spark, str(DATA)).collect()}
    rows = fx.table(spark, str(DATA), "conversations").collect()
    assert all(got[r["conv_id"], r["turn"]]["two"].split() == r["text"].split() for r in rows)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{DATA}/conversations.parquet'")
    sql = ORACLES["wrapped_turns"].replace("[1:14]", "")
    assert {(a, b): (c, d) for a, b, c, d in con.execute(sql).fetchall()} == {k: (r["two"], r["parts"]) for k, r in got.items()}


def test_common_prefix_judges_every_pair(spark):
    hyp = {(r["stream_id"], r["step"]): r["hyp"] for r in fx.hypotheses(fx.words(spark, str(DATA))).collect()}
    want = {}
    for (stream, step), a in hyp.items():
        b = hyp.get((stream, step + 1))
        if b is None:
            continue
        t = max([x[0]["start_ms"] for x in (a, b) if x], default=0)
        x, y = ([key_of(w["w"]) for w in h if w["start_ms"] >= t] for h in (a, b))
        want[stream, step] = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    got = {(r["stream_id"], r["step"]): r["n"] for r in QUERIES["common_prefix"](spark, str(DATA)).collect()}
    assert got == want
    assert any(step > 8 and n > 20 for (_, step), n in got.items())
