"""Packing documents into sequences: first-fit decreasing over a tournament tree.

Documents are tokenised once; a document longer than a sequence is cut into full
pieces and a rest.  Randomised groups of documents are packed independently:
pieces go by decreasing length into the first bin with room, which a tournament
tree over the bins' free space finds in logarithmic time.  Only lengths travel
to the groups, never token ids.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import Workspace

#: Documents in a randomised group, on average.
GROUP = 1024


def default_tokenizer() -> str:
    """The vocabulary file of the contract; only its path is known here."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _printable() -> dict[str, int]:
    """Inverse of the byte-level alphabet: printable bytes stand for themselves, the rest from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=1)
def _library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)
def load_encoder(path: str):
    """A function from text to ids equal to those of ``tokenizers`` for this file.

    For a byte-level BPE whose ids are its merge ranks, the same vocabulary runs
    in a faster library; texts with a special token's string, and all other
    kinds of files, go to ``tokenizers`` itself.
    """

    def plain(text: str) -> list[int]:
        return _library(path).encode_batch_fast([text], add_special_tokens=False)[0].ids

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or model.get("dropout") or model.get("ignore_merges"):
        return plain
    inverse, special = _printable(), [t["content"] for t in spec.get("added_tokens", [])]
    ranks = {bytes(inverse[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [model["vocab"].get(a + b) for a, b in merges]
    if None in ids or any(x >= y for x, y in zip(ids, ids[1:], strict=False)):
        return plain  # ids aren't in the order of the merges
    import public_tokenizers
    import tiktoken

    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: plain(text) if any(s in text for s in special) else fast.encode_ordinary(text)


def first_fit_decreasing(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of every item, and the number of bins.

    The tree's leaves are bins in order, each inner node holds the larger free
    space below it; going left whenever the left side has room finds the first
    bin that fits.
    """
    n = len(lengths)
    leaves = 1 << max(0, (max(n, 1) - 1).bit_length())
    free = [room] * (2 * leaves)
    where, at, bins = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[i]), 1
        while node < leaves:
            node *= 2
            if free[node] < need:
                node += 1
        where[i], at[i] = node - leaves, room - free[node]
        bins = max(bins, node - leaves + 1)
        free[node] -= need
        node //= 2
        while node:
            free[node] = max(free[2 * node], free[2 * node + 1])
            node //= 2
    return where, at, bins


def tokenised_pieces(docs: DataFrame, tokenizer: str, room: int, end_id: int) -> DataFrame:
    """Pieces of every document: doc_id, start, length, ids_crc32, doc_tokens, nth (place in its input partition)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, nth = load_encoder(tokenizer), 0
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "nth"]
        for b in batches:
            out: list[list] = [[] for _ in names]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.array([*encode(text.as_py()), end_id], dtype="<u4")
                for s in range(0, len(ids), room):
                    piece = ids[s : s + room]
                    for col, v in zip(out, (doc, s, len(piece), zlib.crc32(piece.tobytes()), len(ids), nth), strict=True):
                        col.append(v)
                nth += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)

    return rows.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, nth long")


def pack(docs: DataFrame, ws: Workspace, tokenizer: str | None = None, room: int = 2048, end_id: int = 1, seed: int = 23) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padded.

    ``padded`` is the sequence's length with padding: a sequence that holds a
    power of two of tokens stays as it is, any other is padded to ``room``.
    Every id lies in one piece.  A null or empty text is its end id alone.
    Repeated rows are documents like any other, and a doc_id that repeats very
    often is still spread over groups; a null doc_id stays null.  An empty table
    gives an empty result; further columns are ignored.
    """
    pieces = ws.save(tokenised_pieces(docs, tokenizer or default_tokenizer(), room, end_id), "pieces")
    n = pieces.where("start = 0").count()
    groups = max(1, round(n / GROUP))
    # The place in the input partition keeps copies of one row apart; the table is written, so a retry sees the same.
    keyed = pieces.withColumn("grp", F.pmod(F.xxhash64("doc_id", F.col("nth") % GROUP, F.lit(seed)), F.lit(groups)))

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "nth", "start", "ids_crc32")])
        lengths = table.column("length").to_numpy()
        where, at, bins = first_fit_decreasing(lengths, room)
        used = np.bincount(where, weights=lengths, minlength=bins).astype(np.int64)
        padded = np.where(used & (used - 1) == 0, used, room)
        made = [table.column("grp").to_numpy() * (1 << 32) + where, at, padded[where]]
        return pa.table([*(table.column(c) for c in cols[:5]), *map(pa.array, made)], names=cols)

    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "padded"]
    return keyed.groupBy("grp").applyInArrow(fill, ", ".join(f"{c} long" for c in cols))
