"""Recordings as sources: WAV files, decoders as plug points, resampling, raw streams."""

from __future__ import annotations

import io
import math
import subprocess
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

RATE = 16_000
SAMPLES = "path string, block int, rate int, pcm binary, n long"
#: Samples of a row: a long recording is many rows, none of them large.
BLOCK = RATE * 30


#: Zero crossings of the resampling filter on each side, and outputs made at a time.
CROSSINGS, OUTPUTS = 32, 1 << 13


def resample(x: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """Band-limited resampling: every output is a Kaiser-windowed sinc sum around its place, cut off below the lower rate's half.

    The ratio is rational, so an output's weights depend on its phase alone and
    are made once a phase.  Weights sum to one at the edges too, which keep their
    level.  Memory beside the signal is bounded by ``OUTPUTS`` times the taps.
    """
    if rate == to or not len(x):
        return x.astype(np.float32)
    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    cut = min(1.0, to / rate) * 0.95
    reach = math.ceil(CROSSINGS / cut)
    tap = np.arange(-reach, reach + 1)
    n = max(1, -(-len(x) * up // down))
    out = np.empty(n, np.float32)
    for a in range(0, n, OUTPUTS):
        place = np.arange(a, min(a + OUTPUTS, n), dtype=np.int64) * down
        phase, which = np.unique(place % up, return_inverse=True)
        off = tap[None, :] - phase[:, None] / up
        weight = np.sinc(off * cut) * np.i0(9.0 * np.sqrt(np.maximum(0.0, 1 - (off / (reach + 1)) ** 2)))
        at = place[:, None] // up + tap[None, :]
        w = np.where((at >= 0) & (at < len(x)), weight[which], 0.0)
        out[a : a + len(place)] = (w * x[np.clip(at, 0, len(x) - 1)]).sum(axis=1) / w.sum(axis=1)
    return out


def decode_wav(data: bytes) -> tuple[np.ndarray, int]:
    """First channel of a PCM WAV file as float32 in [-1, 1], and its rate."""
    with wave.open(io.BytesIO(data)) as f:
        width, channels, rate = f.getsampwidth(), f.getnchannels(), f.getframerate()
        raw = f.readframes(f.getnframes())
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype(np.float32) / 2**23
    else:
        x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / 2 ** (8 * width - 1)
    return x.reshape(-1, channels)[:, 0], rate


def downmix(decode: Callable[[bytes], tuple[np.ndarray, int]]) -> Callable[[bytes], tuple[np.ndarray, int]]:
    """A decoder of (samples, channels) arrays made mono by the mean, as other containers are read."""

    def run(data: bytes) -> tuple[np.ndarray, int]:
        x, rate = decode(data)
        return (x.mean(axis=1) if x.ndim == 2 else x), rate

    return run


def piped(command: list[str], rate: int = RATE) -> Callable[[bytes], tuple[np.ndarray, int]]:
    """A decoder that gives a file to a program and reads float32 samples of one channel at ``rate`` back; its failure is the task's."""

    def run(data: bytes) -> tuple[np.ndarray, int]:
        said = subprocess.run(command, input=data, capture_output=True, check=False)
        if said.returncode:
            raise RuntimeError(f"{command[0]} failed: {said.stderr.decode(errors='replace')[-500:]}")
        return np.frombuffer(said.stdout[: len(said.stdout) // 4 * 4], "<f4"), rate

    return run


#: For any container, where that program is installed: one channel, 16 kHz, raw float32.
ANY_CONTAINER = ["ffmpeg", "-nostdin", "-v", "error", "-i", "pipe:0", "-ac", "1", "-ar", str(RATE), "-f", "f32le", "pipe:1"]


def read_audio(spark: SparkSession, path: str, decode: Callable[[bytes], tuple[np.ndarray, int]] = decode_wav, glob: str = "*.wav") -> DataFrame:
    """Recordings under ``path`` at 16 kHz, in blocks: path, block, rate, pcm (float32), n (samples of the block)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = resample(*decode(data))
                for k, at in enumerate(range(0, max(len(x), 1), BLOCK)):
                    part = x[at : at + BLOCK]
                    yield pa.RecordBatch.from_pylist([{"path": name, "block": k, "rate": RATE, "pcm": part.astype("<f4").tobytes(), "n": len(part)}], pa.schema([("path", pa.string()), ("block", pa.int32()), ("rate", pa.int32()), ("pcm", pa.binary()), ("n", pa.int64())]))

    return files.mapInArrow(run, SAMPLES)


def block_frames(audio: DataFrame, win: int = 800) -> DataFrame:
    """path, frame, rms per ``win`` samples; blocks are whole numbers of frames, so none spans two rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, k, raw in zip(b.column("path").to_pylist(), b.column("block").to_pylist(), b.column("pcm").to_pylist(), strict=True):
                x = np.frombuffer(raw, "<f4").astype(np.float64)
                full = x[: len(x) // win * win].reshape(-1, win)
                rms = np.sqrt((full * full).mean(axis=1) + 1e-12)
                at = k * (BLOCK // win) + np.arange(len(rms))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rms), pa.string()), pa.array(at, pa.int64()), pa.array(rms)], ["path", "frame", "rms"])

    return audio.select("path", "block", "pcm").mapInArrow(run, "path string, frame long, rms double")


def raw_chunks(data: bytes, secs: float = 0.25, rate: int = RATE) -> Iterator[np.ndarray]:
    """Raw little-endian float32 samples in blocks, as a pipe would bring them."""
    step = int(secs * rate) * 4
    for at in range(0, len(data) - len(data) % 4, step):
        yield np.frombuffer(data[at : at + step][: (len(data[at : at + step]) // 4) * 4], "<f4")


def release(chunks: Iterator[np.ndarray], step_secs: float = 1.5, rate: int = RATE, flush: bool = True) -> Iterator[tuple[float, float, np.ndarray]]:
    """Count windows of at least ``step_secs``: (clock, rms, samples).

    All pending samples leave at once; ``flush`` releases what is left at the end.
    """
    pending, clock = [], 0.0
    for c in [*chunks, None]:
        if c is not None:
            pending.append(c)
        n = sum(map(len, pending))
        if n >= int(step_secs * rate) or c is None and n and flush:
            x, pending = np.concatenate(pending), []
            clock += n / rate
            yield clock, float(np.sqrt((x.astype(np.float64) ** 2).mean() + 1e-12)), x


def with_rec_id(audio: DataFrame) -> DataFrame:
    """A numeric recording id from the path."""
    return audio.withColumn("rec_id", F.xxhash64("path"))
