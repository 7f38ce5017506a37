"""Sharding by jump consistent hashing.

A stable key and the shard count decide the shard, with no ring table.  When one
shard is appended, a row either stays or moves into the new shard, and only the
necessary fraction moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .store import Workspace

#: Multiplier of the 64-bit linear congruential generator in the published algorithm (fixed value).
JUMP = np.uint64(2862933555777941757)


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of every 64-bit key for ``shards`` shards, vectorised."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    k = keys.astype(np.int64).view(np.uint64).copy()
    b = np.zeros(len(k), np.int64)
    j = np.zeros(len(k), np.int64)
    live = np.arange(len(k))
    while len(live):
        b[live] = j[live]
        k[live] = k[live] * JUMP + np.uint64(1)
        r = ((k[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
        j[live] = ((b[live] + 1) * (2147483648.0 / r)).astype(np.int64)
        live = live[j[live] < shards]
    return b


def assign_shards(docs: DataFrame, ws: Workspace, shards: int = 24, key: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law ``key``: the key and the shard count alone decide, so rows with one key
    share a shard; a null key counts as key 0.  ``size`` is the UTF-8 length plus
    8 (null text: 8).  ``slot`` numbers a shard's rows from 0 without gaps: it is
    the row's place in its input partition plus an offset per (shard, partition),
    so no task ever holds a shard and a hot key needs no salt.  ``grown_shard`` is
    the shard with one more.  Empty table: empty result; other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.spark_partition_id().cast("long").alias("part"),
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(shards, np.int64)
        for b in batches:
            keys = b.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            now, more = jump_hash(keys, shards), jump_hash(keys, shards + 1)
            order = np.argsort(now, kind="stable")
            count = np.bincount(now, minlength=shards)
            nth = np.empty(len(now), np.int64)
            nth[order] = np.arange(len(now)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(seen, count)
            seen += count
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(now.astype(np.int32)), pa.array(more.astype(np.int32)), pa.array(nth)], ["doc_id", "size", "text_crc32", "part", "shard", "grown_shard", "nth"])

    placed = rows.mapInArrow(place, "doc_id long, size long, text_crc32 long, part long, shard int, grown_shard int, nth long")
    placed = ws.save(placed, "placed")
    held = placed.groupBy("shard", "part").agg((F.max("nth") + 1).alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ws.save(held.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "offsets")
    return placed.join(offsets, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("nth")).alias("slot"), "grown_shard"
    )
