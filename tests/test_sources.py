"""Recordings and transcripts: round trips through files."""

import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.operators import assemble
from tidewheel.sources import audio, files


def write_wav(path, x, rate=16000, channels=1):
    with wave.open(str(path), "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(b"".join(struct.pack("<h", int(v * 32767)) for v in np.repeat(x, channels) * np.tile([1.0, 0.0][:channels], len(x))))


def test_wav_takes_first_channel_and_resamples(spark, tmp_path):
    write_wav(tmp_path / "a.wav", np.full(8000, 0.5), rate=8000, channels=2)
    got = audio.read_audio(spark, str(tmp_path)).collect()
    x = np.frombuffer(got[0]["pcm"], "<f4")
    assert got[0]["n"] == 16000 and abs(x.mean() - 0.5) < 1e-3


def test_resampling_keeps_the_band_and_nothing_above_it():
    t = np.arange(44100) / 44100
    low, high = np.sin(2 * np.pi * 1000 * t), np.sin(2 * np.pi * 12000 * t)
    got = audio.resample(low, 44100)
    want = np.sin(2 * np.pi * 1000 * np.arange(16000) / 16000)
    assert len(got) == 16000 and np.abs(got - want)[200:-200].max() < 1e-3
    assert np.abs(audio.resample(high, 44100))[200:-200].max() < 1e-3
    up = audio.resample(np.sin(2 * np.pi * 1000 * np.arange(8000) / 8000), 8000)
    assert len(up) == 16000 and np.abs(up - want)[400:-400].max() < 1e-3
    assert np.allclose(audio.resample(np.full(1000, 0.5), 48000), 0.5) and not len(audio.resample(np.zeros(0), 8000))


def test_piped_decoder(spark, tmp_path):
    (tmp_path / "a.raw").write_bytes(np.arange(5, dtype="<f4").tobytes() + b"x")
    got = audio.read_audio(spark, str(tmp_path), audio.piped(["cat"]), "*.raw").collect()
    assert [np.frombuffer(r["pcm"], "<f4").tolist() for r in got] == [[0, 1, 2, 3, 4]]
    with pytest.raises(RuntimeError, match="false failed"):
        audio.piped(["false"])(b"")


def test_block_frames(spark, tmp_path):
    write_wav(tmp_path / "a.wav", np.concatenate([np.zeros(1600), np.full(1700, 0.25)]))
    got = sorted((r["frame"], round(r["rms"], 3)) for r in audio.block_frames(audio.read_audio(spark, str(tmp_path))).collect())
    assert got == [(0, 0.0), (1, 0.0), (2, 0.25), (3, 0.25)]


def test_downmix():
    x, rate = audio.downmix(lambda b: (np.array([[1.0, 0.0], [0.0, 0.0]]), 16000))(b"")
    assert list(x) == [0.5, 0.0] and rate == 16000


def test_raw_stream_releases_all_samples():
    data = np.arange(50_000, dtype="<f4").tobytes()
    got = list(audio.release(audio.raw_chunks(data)))
    assert sum(len(x) for _, _, x in got) == 50_000 and len(got[0][2]) == 24_000
    assert sum(len(x) for _, _, x in audio.release(audio.raw_chunks(data), flush=False)) == 48_000


def test_transcripts_are_written_and_read(spark, tmp_path):
    rows = [(1, i, f"žodis{i}", i * 100, i * 100 + 50, i // 5 % 2) for i in range(20)]
    w = spark.createDataFrame(rows, "rec_id long, idx long, w string, start_ms long, end_ms long, spk int")
    turn, cue = assemble.turns(w), assemble.cues(w)
    made = assemble.transcript_json(turn, w)
    assert "žodis1" in made.first()["json"]
    files.write_named(made.select("rec_id", F.col("json").alias("content")), str(tmp_path / "json"), "json")
    back = files.read_transcripts(spark, str(tmp_path / "json" / "*"))
    assert sorted(r["start_ms"] for r in back.collect()) == [r[3] for r in rows]
    assert files.vtt_files(cue).first()["content"].startswith("WEBVTT\n\n00:00:00.000 --> ")
    assert files.srt_files(cue).first()["content"].startswith("1\n00:00:00,000 --> ")
    assert files.txt_files(turn).first()["content"].startswith("[00:00] Kalbėtojas 1: žodis0")


def test_texts(spark, tmp_path):
    (tmp_path / "t.txt").write_text("labas \n rytas")
    assert files.read_texts(spark, str(tmp_path)).first()["toks"] == ["labas", "rytas"]
