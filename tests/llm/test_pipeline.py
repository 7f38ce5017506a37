import random
from pathlib import Path

import pytest
from test_simhash import components, shingles

import corpus_pipeline as c
from tidewheel.llm.exact_dedup import squeeze
from tidewheel.llm.langid import has_letter
from tidewheel.llm.packing import default_tokenizer, load_encoder

DATA = Path("/root/testdata/sf0.001")


def small(rng):
    rows = []
    for i in range(120):
        words = [f"zod{rng.randrange(900)}" for _ in range(60)]
        rows.append((i, " ".join(words), "lt", f"s{i % 4}", None))
        if i % 10 == 0:
            words[3] = "keista"
            rows.append((200 + i, " ".join(words), "lt", "s1", None))
        if i % 15 == 0:
            rows.append((400 + i, rows[-1][1].replace(" ", "  "), None, None, None))
    return [*rows, (900, "123 456", None, "s1", None), (901, None, None, None, None)]


def test_stages_against_brute_force(spark):
    rows = small(random.Random(6))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    columns, texts = docs.columns, {r[0]: r[1] for r in rows}
    stages = dict(c.STAGES)
    docs = stages["language"](spark, docs, "")
    kept = {r["doc_id"] for r in docs.collect()}
    assert kept == {i for i, t in texts.items() if t and has_letter(t)} and docs.columns == columns
    docs = stages["exact"](spark, docs, "")
    first = {}
    for i in sorted(kept):
        first.setdefault(squeeze(texts[i].encode()), i)
    kept = {r["doc_id"] for r in docs.collect()}
    assert kept == set(first.values()) and docs.columns == columns
    docs = stages["near"](spark, docs, "")
    ids = sorted(kept)
    comp = components([shingles(texts[i]) for i in ids], lambda a, b: len(a & b) >= 0.8 * len(a | b))
    kept = {r["doc_id"] for r in docs.collect()}
    assert kept == {ids[k] for k in comp} and docs.columns == columns
    mixed = stages["mix"](spark, docs, "")
    taken = [r["doc_id"] for r in mixed.collect()]
    assert set(taken) <= kept and max(map(taken.count, taken)) <= 3 and mixed.columns == columns
    packed = stages["pack"](spark, mixed, "").collect()
    encode = load_encoder(default_tokenizer())
    assert sum(r["length"] for r in packed) == sum(len(encode(texts[i])) + 1 for i in taken)


@pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")
def test_run(spark):
    assert c.run(spark, str(DATA)).count() > 50


@pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")
def test_queries_run(spark):
    from tidewheel.llm.registry import QUERIES

    for f in QUERIES.values():
        assert f(spark, str(DATA)).count() > 0
