"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows,
the maximum of every filter goes to a softmax.  All windows of a text count:
their log-probabilities are averaged, weighted by length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import small_slices

#: Bytes of a window, and of the step from one filter position to the next.
WINDOW, STRIDE = 512, 2
#: Filter widths, filters of each, and size of a byte's embedding.
WIDTHS, FILTERS, EMBED = (2, 3, 4), 12, 8
#: Training windows per language (about), and in all at most, but FEW of each language; windows taken of one document, evenly spaced.
PER_LANG, MOST, FEW, PER_DOC = 3000, 24000, 50, 4
#: Most labels whose table is broadcast.
LABELS = 10_000
#: Windows computed at once.
AT_ONCE = 256
#: A text is rejected if its windows find no language with that probability, unless it has too few letters to tell.
LEAST, ENOUGH = 0.4, 100
UNKNOWN = "und"
#: The class of what is no language, in the networks that know one; no label is written so.
NOISE = "\U0010ffff"
#: First and last letters of scripts (fixed values: Unicode blocks) that are noise unless the training texts use them.
SCRIPTS = ((0x3B1, 0x3C9), (0x430, 0x44F), (0x561, 0x586), (0x5D0, 0x5EA), (0x628, 0x64A), (0x915, 0x939), (0xE01, 0xE2E), (0x10D0, 0x10F0), (0x3041, 0x3093), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))


@dataclass
class Network:
    """Parameters: embed (256, E), filters (4E, W*F) with zero rows beyond a filter's width, and the output layer."""

    langs: list[str]
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def windows(raw: bytes) -> list[bytes]:
    """Consecutive windows that cover the whole text; the last may be shorter."""
    return [raw[i : i + WINDOW] for i in range(0, len(raw), WINDOW)]


def matrix(parts: list[bytes]) -> np.ndarray:
    """Windows as rows of byte values, filled up with spaces."""
    return np.frombuffer(b"".join(p.ljust(WINDOW, b" ") for p in parts), np.uint8).reshape(len(parts), WINDOW)


def _columns(net: Network, x: np.ndarray) -> np.ndarray:
    """Embedded bytes under every filter position: (windows, positions, 4E)."""
    e = net.embed[x]
    width = max(WIDTHS)
    view = np.lib.stride_tricks.sliding_window_view(e.reshape(len(x), -1), width * EMBED, axis=1)
    return np.ascontiguousarray(view[:, :: EMBED * STRIDE])


def forward(net: Network, x: np.ndarray) -> np.ndarray:
    """Log-probabilities of each window's language."""
    cols = _columns(net, x)
    z = (cols.reshape(-1, cols.shape[2]) @ net.filters).reshape(len(x), -1, net.filters.shape[1])
    pooled = np.maximum(z.max(axis=1) + net.bias, 0)
    s = pooled @ net.out + net.out_bias
    s -= s.max(axis=1, keepdims=True)
    return s - np.log(np.exp(s).sum(axis=1, keepdims=True))


def train(parts: list[bytes], labels: list[str], epochs: int = 10, batch: int = 64, rate: float = 3e-3, seed: int = 9, steps: int = 300) -> Network:
    """Fit the network on labelled windows with Adam, in ``epochs`` rounds or what makes ``steps`` updates; one seed, one result."""
    langs = sorted(set(labels))
    rng = np.random.default_rng(seed)
    mask = np.concatenate([np.repeat(np.repeat(np.arange(max(WIDTHS)) < w, EMBED)[:, None], FILTERS, 1) for w in WIDTHS], axis=1)
    f = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
    net = Network(langs, f(256, EMBED) * 0.5, f(max(WIDTHS) * EMBED, mask.shape[1]) * 0.2 * mask, np.zeros(mask.shape[1], np.float32), f(mask.shape[1], len(langs)) * 0.2, np.zeros(len(langs), np.float32))
    if len(langs) < 2:
        return net
    x, y = matrix(parts), np.array([langs.index(v) for v in labels])
    share = np.bincount(y, minlength=len(langs))
    names = ["embed", "filters", "bias", "out", "out_bias"]
    m1 = {k: np.zeros_like(getattr(net, k)) for k in names}
    m2 = {k: np.zeros_like(getattr(net, k)) for k in names}
    t = 0
    for _ in range(max(epochs, -(-steps * batch // max(len(x), batch)))):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            pick = order[at : at + batch]
            xb, yb = x[pick], y[pick]
            cols = _columns(net, xb)
            z = (cols.reshape(-1, cols.shape[2]) @ net.filters).reshape(len(xb), -1, mask.shape[1])
            top = z.argmax(axis=1)
            best = np.take_along_axis(z, top[:, None, :], 1)[:, 0] + net.bias
            pooled = np.maximum(best, 0)
            s = pooled @ net.out + net.out_bias
            p = np.exp(s - s.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(yb)), yb] -= 1
            p *= (len(x) / len(langs) / share[yb])[:, None] / len(yb)
            grad = {"out": pooled.T @ p, "out_bias": p.sum(0)}
            back = (p @ net.out.T) * (best > 0)
            grad["bias"] = back.sum(0)
            # Only the position of the maximum passes a filter's gradient on.
            seen = cols[np.arange(len(xb))[:, None], top]
            grad["filters"] = np.einsum("nfk,nf->kf", seen, back) * mask
            de = (back[:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
            place = (top * STRIDE)[:, :, None] + np.arange(max(WIDTHS))
            hit = xb[np.arange(len(xb))[:, None, None], place].reshape(-1)
            grad["embed"] = np.zeros_like(net.embed)
            np.add.at(grad["embed"], hit, de)
            t += 1
            for k in names:
                m1[k] = 0.9 * m1[k] + 0.1 * grad[k]
                m2[k] = 0.999 * m2[k] + 0.001 * grad[k] ** 2
                step = rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
                setattr(net, k, (getattr(net, k) - step).astype(np.float32))
    return net


def judge(net: Network, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of every text the mean log-probabilities of its windows, and how sure its windows are: the mean of their best language's probability."""
    real = np.array([x != NOISE for x in net.langs])
    each = ((raw[k : k + WINDOW], i) for i, raw in enumerate(texts) for k in range(0, len(raw), WINDOW))
    total, weight, sure = np.zeros((len(texts), len(net.langs))), np.zeros(len(texts)), np.zeros(len(texts))
    # Windows of many texts are computed together, and cut when their turn comes.
    while pairs := list(islice(each, AT_ONCE)):
        some, own = [p for p, _ in pairs], [i for _, i in pairs]
        n = np.array([len(p) for p in some], np.float64)
        log_p = forward(net, matrix(some))
        np.add.at(total, own, log_p * n[:, None])
        np.add.at(weight, own, n)
        np.add.at(sure, own, np.exp(log_p[:, real].max(axis=1)) * n)
    return total / np.maximum(weight, 1)[:, None], sure / np.maximum(weight, 1)


def noise(parts: list[bytes], n: int, seed: int = 15) -> list[bytes]:
    """``n`` windows of no language, as long as ``parts`` are: encoded bytes, shuffled letters, random characters, letters of scripts that ``parts`` don't use."""
    rng = np.random.default_rng(seed)
    used = {ord(c) for p in parts for c in p.decode("utf-8", "ignore")}
    scripts = [np.arange(a, b + 1) for a, b in SCRIPTS if used.isdisjoint(range(a, b + 1))]

    def words(letters: np.ndarray, size: int) -> str:
        # Words of 2 to 11 letters.
        got = rng.choice(letters, size)
        cuts = np.cumsum(rng.integers(2, 12, size))
        return " ".join("".join(map(chr, w)) for w in np.split(got, cuts[cuts < size]))

    made = []
    for k in range(n):
        like = parts[int(rng.integers(len(parts)))]
        size, kind = len(like), k % 6
        if kind == 0:
            text = base64.b64encode(rng.bytes(size)).decode()
        elif kind == 1:
            text = rng.bytes(size).hex()
        elif kind == 2:
            text = "".join(rng.permutation(list(like.decode("utf-8", "ignore"))))
        elif kind == 3:
            text = words(np.arange(33, 127), size)
        elif kind == 4 or not scripts:
            text = words(np.arange(97, 123), size)
        else:
            text = words(scripts[int(rng.integers(len(scripts)))], size)
        made.append(text.encode()[:size])
    return made


def with_noise(parts: list[bytes], labels: list[str]) -> tuple[list[bytes], list[str]]:
    """Training windows with as many of no language as the languages have on average."""
    more = noise(parts, len(parts) // max(1, len(set(labels)))) if parts else []
    return parts + more, labels + [NOISE] * len(more)


def predict(net: Network, texts: list[bytes]) -> tuple[list[str], list[float]]:
    """Language of every text and its mean probability."""
    mean, _ = judge(net, texts)
    p = np.exp(mean - mean.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    best = p.argmax(axis=1)
    return [net.langs[b] for b in best], [float(x) for x in p[np.arange(len(texts)), best]]


def has_letter(text: str) -> bool:
    return has_letters(text, 1)


def has_letters(text: str, n: int) -> bool:
    """Whether a text has at least ``n`` letters; reads no further than the n-th."""
    return n <= 0 or next(islice(filter(str.isalpha, text), n - 1, None), None) is not None


def held_out(doc_id: Column) -> Column:
    """Documents that training never sees: a fifth by checksum of the id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def sample_windows(docs: DataFrame, per_lang: int = PER_LANG, most: int = MOST) -> tuple[list[bytes], list[str]]:
    """Labelled training windows, about ``per_lang`` for each language and at most ``most``, or ``FEW`` of each if that is more: texts by seeded hash of the doc_id, in each evenly spaced windows."""
    rows = docs.select("doc_id", "text", "lang").where("doc_id is not null and text is not null and lang is not null").where(~held_out(F.col("doc_id")))
    counts = [(r["lang"], r["count"]) for r in rows.groupBy("lang").count().collect()]
    if not counts:
        return [], []
    quota = max(FEW, min(per_lang, most // len(counts)))
    want = quota // PER_DOC + 1
    h = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(77)), F.lit(1 << 30))
    # One row a label, as many as the network has outputs.
    chances = docs.sparkSession.createDataFrame([(x, 1.5 * want / n * (1 << 30)) for x, n in counts], "lang string, chance double")
    # Up to that many rows of a label and a number travel to every task; beyond, the join deals texts by label.
    chances = F.broadcast(chances) if len(counts) <= LABELS else chances
    rows = rows.withColumn("lang", F.col("lang").cast("string")).join(chances, "lang")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_slices(batches, "raw"):
            ids, langs, parts = [], [], []
            for i, lang, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got = windows(raw)
                for k in range(min(PER_DOC, len(got))):
                    part = got[k * len(got) // min(PER_DOC, len(got))]
                    if has_letter(part.decode("utf-8", "ignore")):
                        ids.append(i)
                        langs.append(lang)
                        parts.append(part)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.array(parts, pa.binary())], ["h", "lang", "part"])

    found = rows.where(h < F.col("chance")).select(h.alias("h"), "lang", F.col("text").cast("binary").alias("raw")).mapInArrow(cut, "h long, lang string, part binary")
    # Each language is cut by itself: hashes of frequent ones are small, so one common cut would take the rare ones.
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "part"))
    kept = found.withColumn("nth", nth).where(F.col("nth") <= quota)
    got = kept.orderBy("h", "lang", "part").select("part", "lang").collect()
    return [bytes(r["part"]) for r in got], [r["lang"] for r in got]


def identify(docs: DataFrame, net: Network | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score.

    Learns from text and lang of documents that are not held out, and from
    nothing else; predicts from the text alone.  A null text and one without a
    letter give ``und`` with score 0, as does everything when no label is there
    to learn from.  A null doc_id is never learned from and not held out.  Very
    long texts are read window by window to the end.  Empty table: empty result;
    further columns are ignored; repeated rows get equal answers.
    """
    if net is None:
        parts, labels = sample_windows(docs)
        net = train(parts, labels) if parts else None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_slices(batches, "text"):
            texts = b.column(2).to_pylist()
            some = [i for i, t in enumerate(texts) if net is not None and t and has_letter(t)]
            langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if some:
                for i, lang, score in zip(some, *predict(net, [texts[i].encode() for i in some]), strict=True):
                    langs[i], scores[i] = lang, score
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return rows.mapInArrow(answer, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = LEAST, enough: int = ENOUGH) -> DataFrame:
    """``docs`` whose language can be told, with the columns of ``docs``.

    A text without a letter (null and empty ones too) is rejected, and so is one
    whose windows give their best language less than ``least`` on average.  The
    network also knows a class of what is no language, so encoded data, shuffled
    letters and scripts it never learned leave little to any.  Each window counts
    by itself, so a text in several languages stays.  Fewer than ``enough``
    letters say too little: such a text stays.  Without labels to learn from only
    texts without letters go.  Very long texts are read to the end; repeated rows
    fare alike; an empty table gives an empty result.
    """
    parts, labels = with_noise(*sample_windows(docs))
    net = train(parts, labels) if parts else None
    # The verdict travels with the row, so nothing is joined back.
    fields = docs.schema

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_slices(batches, "text"):
            texts = b.column("text").to_pylist()
            ok = [bool(t) and has_letter(t) for t in texts]
            at = [i for i, t in enumerate(texts) if ok[i] and net is not None and has_letters(t, enough)]
            if at:
                for i, sure in zip(at, judge(net, [texts[i].encode() for i in at])[1], strict=True):
                    ok[i] = bool(sure >= least)
            yield b.filter(pa.array(ok, pa.bool_()))

    return docs.mapInArrow(keep, fields)
