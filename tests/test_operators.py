"""Golden cases and fuzzed equivalences against plain restatements."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.config import PipelineConfig
from tidewheel.functions import clock, models, text
from tidewheel.operators import assemble, punctuate, signal, speakers, words


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first()["x"]


def test_stamps_carry_and_hours_grow(spark):
    assert one(spark, clock.stamp(F.lit(60000))) == "00:01:00.000"
    assert one(spark, clock.stamp(F.lit(359999999), True)) == "99:59:59,999"
    assert one(spark, clock.minute_stamp(F.lit(100 * 60000 + 5999))) == "[100:05]"


def test_names_append(spark):
    assert one(spark, clock.output_name(clock.stem(F.lit("a/b/rec.16k.wav")), "srt")) == "rec.16k.srt"
    assert one(spark, clock.stem(F.lit(".hidden"))) == ".hidden"


def test_agreement_key(spark):
    assert one(spark, text.agreement_key(F.lit("  „Labas!“— "))) == "labas"
    assert one(spark, text.agreement_key(F.lit("…"))) == ""


def test_python_whitespace(spark):
    odd = "a b c\x1cd  e"
    assert one(spark, text.tokens(F.lit(odd))) == odd.split()


def test_screen_lines_first_long_word(spark):
    toks = F.array(F.lit("w" * 50), F.lit("next"))
    assert one(spark, text.screen_lines(toks)) == ["w" * 50, "next"]
    assert one(spark, text.screen_lines(F.array(F.lit("w" * 42)))) == ["", "w" * 42]


def test_wrap_overflows_into_last_line(spark):
    toks = ["aaaa"] * 40
    lines = one(spark, text.wrap_two(F.array(*map(F.lit, toks))))
    assert len(lines) == 2 and len(lines[0]) <= 42 and " ".join(lines).split() == toks
    assert one(spark, text.wrap_two(F.array(F.lit("x" * 200)))) == ["x" * 200]


def test_sentence_case(spark):
    said = "labas. ąžuolas! kas? éa. 5a"
    assert one(spark, text.sentence_case(F.lit(said))) == "Labas. Ąžuolas! Kas? éa. 5a"
    assert text.sentence_case_py(said) == "Labas. Ąžuolas! Kas? éa. 5a"


def test_config_rejects_wide_overlap():
    with pytest.raises(ValueError):
        PipelineConfig(chunk=80, overlap=40)


def regions_by_scan(rms, thr, gap, pad):
    got, last = [], None
    for f in np.flatnonzero(np.array(rms) > thr):
        if last is not None and f - last - 1 < gap:
            got[-1][1] = f + 1
        else:
            got.append([f, f + 1])
        last = f
    return [(max(0, a - pad), min(len(rms), b + pad)) for a, b in got]


def test_regions_equal_a_scan(spark):
    rng = random.Random(1)
    cases = {k: [rng.choice([0.0, 0.0, 0.0, 9.0]) for _ in range(rng.randint(1, 60))] for k in range(30)} | {99: [0.0] * 20}
    rows = [(k, i, v) for k, xs in cases.items() for i, v in enumerate(xs)]
    got = signal.speech_regions(spark.createDataFrame(rows, "rec_id long, frame int, rms double"), 1.0, 5, 2).collect()
    for k, xs in cases.items():
        assert sorted((r["f0"], r["f1"]) for r in got if r["rec_id"] == k) == regions_by_scan(xs, 1.0, 5, 2)


def test_cut_takes_first_minimum_and_covers():
    rms = np.ones(100)
    ends = signal.cut_points(rms, 100, 12, 25, 29)
    assert ends[0] == 25 and ends[-1] == 100
    rms[20] = 0.0
    assert signal.cut_points(rms, 100, 12, 25, 29)[0] == 20


def test_partial_frame_is_dropped(spark):
    df = spark.createDataFrame([(1, i, 0.5) for i in range(10)], "rec_id long, i long, v double")
    assert signal.frame_rms(df, 4).count() == 2


def smooth_by_fold(spks, n, ms):
    now = list(spks)
    for i in range(1, len(now) - 1):
        if now[i - 1] is not None and now[i - 1] == now[i + 1] and n[i] < 4 and ms[i] < 1000:
            now[i] = now[i - 1]
    return now


def test_smoothing_equals_the_fold(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for rec in range(60):
        spks = [rng.choice([0, 1, None])]
        for _ in range(rng.randint(0, 14)):
            spks.append(rng.choice([x for x in (0, 1, None) if x != spks[-1]]))
        n, ms = [rng.choice([1, 2, 3, 9]) for _ in spks], [rng.choice([100, 500, 2000]) for _ in spks]
        rows += [(rec, i, s, a, 0, b) for i, (s, a, b) in enumerate(zip(spks, n, ms))]
        want[rec] = smooth_by_fold(spks, n, ms)
    table = spark.createDataFrame(rows, "rec_id long, run_no long, spk int, n_words long, start_ms long, end_ms long")
    got = speakers.absorbed_runs(table).select("rec_id", "run_no", F.coalesce("takes", "spk").alias("now")).collect()
    for rec, spks in want.items():
        assert [r["now"] for r in sorted(got, key=lambda r: r["run_no"]) if r["rec_id"] == rec] == spks


def test_attach_ties_and_missing(spark):
    w = spark.createDataFrame([(1, 0, 100, 100), (1, 1, 5000, 5100), (2, 0, 0, 10)], "rec_id long, idx long, start_ms long, end_ms long")
    seg = spark.createDataFrame([(1, 0, 0, 125, 7), (1, 1, 125, 400, 8)], "rec_id long, seg_idx long, a_ms long, b_ms long, spk int")
    got = {(r["rec_id"], r["idx"]): r["spk"] for r in speakers.attach(w, seg).collect()}
    assert got == {(1, 0): 7, (1, 1): 8, (2, 0): None}


def test_overlap_across_buckets_counts_once(spark):
    w = spark.createDataFrame([(1, 0, 59_000, 61_000)], "rec_id long, idx long, start_ms long, end_ms long")
    seg = spark.createDataFrame([(1, 0, 58_000, 60_500, 3), (1, 1, 60_400, 90_000, 4)], "rec_id long, seg_idx long, a_ms long, b_ms long, spk int")
    assert [r["spk"] for r in speakers.overlap_best(w, seg).collect()] == [3]


def word_rows(rng, n):
    rows, t = [], 0
    for i in range(n):
        t += rng.choice([60, 60, 60, 1300, 1700])
        w = "a" * rng.randint(1, 30) + rng.choice(["", "", ".", "…"])
        d = rng.choice([0, 200, 900])
        rows.append((1, i, w, t, t + d, rng.choice([0, 0, 0, 1, None])))
        t += d
    return rows


def cues_plain(rows, max_ms=6000, max_chars=84, gap=1500):
    out, cur = [], []
    for r in rows:
        joined = len(" ".join(x[2] for x in cur)) + 1 + len(r[2])
        if cur and (r[5] != cur[0][5] or r[3] - cur[-1][4] > gap or r[4] - cur[0][3] > max_ms or joined > max_chars):
            out.append(cur)
            cur = []
        cur = [*cur, r]
        if r[2][-1] in ".!?…" and len(" ".join(x[2] for x in cur)) > max_chars * 0.45:
            out.append(cur)
            cur = []
    return [" ".join(x[2] for x in c) for c in [*out, cur] if c]


@pytest.mark.parametrize("limit", [4096, 3])
def test_cues_equal_the_greedy_fold(spark, limit, monkeypatch):
    monkeypatch.setattr(assemble, "FOLD", limit)
    rows = word_rows(random.Random(3), 400)
    df = spark.createDataFrame(rows, "rec_id long, idx long, w string, start_ms long, end_ms long, spk int")
    got = [r["text"] for r in sorted(assemble.cues(df).collect(), key=lambda r: r["cue_no"])]
    assert got == cues_plain(rows)


def test_widen_never_shortens(spark):
    rows = word_rows(random.Random(4), 200)
    df = spark.createDataFrame(rows, "rec_id long, idx long, w string, start_ms long, end_ms long, spk int")
    got = {r["idx"]: r["end_ms"] for r in words.widen(df).collect()}
    for r, nxt in zip(rows, [*rows[1:], None]):
        room = max(r[4], nxt[3] if nxt else r[4])
        assert r[4] <= got[r[1]] <= max(room, r[4])


@pytest.mark.parametrize("n", [1, 199, 200, 201, 320, 321, 777])
def test_chunks_keep_every_word_once(spark, n):
    df = spark.createDataFrame([(1, [f"w{i}" for i in range(n)])], "doc_id long, toks array<string>")
    got = punctuate.restore(df, models.identity).first()
    assert got["text"].split() == [f"w{i}" for i in range(n)] and got["refused"] == 0


@pytest.mark.parametrize("tagger", [models.raising, models.splitting, lambda t: t + " more", lambda t: t.replace("w", "v", 1)])
def test_guard_refuses(spark, tagger):
    df = spark.createDataFrame([(1, ["w1,", "w2"] * 150)], "doc_id long, toks array<string>")
    got = punctuate.restore(df, tagger).first()
    assert got["refused"] == got["chunks"] and got["text"].split() == ["w1,", "w2"] * 150


def test_guard_accepts_case_and_marks(spark):
    df = spark.createDataFrame([(1, ["labas", "rytas"])], "doc_id long, toks array<string>")
    got = punctuate.restore(df, lambda t: "Labas, rytas.").first()
    assert got["text"] == "Labas, rytas." and got["refused"] == 0


def test_empty_inputs(spark):
    w = spark.createDataFrame([], "rec_id long, idx long, w string, start_ms long, end_ms long, spk int")
    assert assemble.turns(w).count() == 0 and assemble.cues(w).count() == 0 and speakers.smooth(w).count() == 0
