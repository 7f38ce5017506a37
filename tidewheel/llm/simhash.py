"""SimHash near-deduplication over a generalised pigeonhole index.

Fingerprints within ``tau`` bits agree, in at least one of m groups of bits, up
to that group's threshold, if the thresholds sum to ``tau - m + 1`` (a threshold
of -1 leaves a group out).  Bits that vary together share a group; dynamic
programming allots the thresholds by estimated candidate counts.  Signatures
within a group's threshold are probed and the pairs found are verified.

A bucket that holds more than ``BUCKET`` fingerprints would make pairs with the
square of its size.  The fingerprints that probe it are linked exactly another
way: two fingerprints are within two bits if and only if some value lies within
one bit of both, so each names its one-bit neighbours and those that meet are
tied to the first of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from .graph import connected_components
from .store import Workspace

BITS = 64
#: Largest bucket whose pairs are made; larger ones go the linear way.
BUCKET = 32
#: Bytes of a text whose words are held at once.
SEGMENT = 1 << 18
#: White space that ends a word.
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def segments(raw: bytes) -> Iterator[bytes]:
    """A text in pieces of about ``SEGMENT`` bytes that end after white space or at its end."""
    at = 0
    while at < len(raw):
        gap = _GAP.search(raw, at + SEGMENT)
        end = gap.end() if gap else len(raw)
        yield raw[at:end]
        at = end


def shingle_hashes(raw: bytes, width: int = 3, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of every word shingle of a UTF-8 text in order, a segment at a time; a shorter text is one shingle.

    Beside the text only one segment's words are held, however long the text is.
    """
    h, held, any_yet = xxhash.xxh64_intdigest, [], False
    for part in segments(raw):
        words = held + part.lower().split()
        n = len(words) - width + 1
        if n < 1:
            held = words
            continue
        buf = b" ".join(words)
        gaps = np.flatnonzero(np.frombuffer(buf, np.uint8) == 32)
        starts = np.concatenate(([0], gaps + 1))[:n].tolist()
        ends = np.concatenate((gaps, [len(buf)]))[width - 1 :].tolist()
        yield np.array([h(buf[s:e], seed) for s, e in zip(starts, ends, strict=True)], np.uint64)
        # The next segment's first shingles begin with these words.
        held, any_yet = words[n:], True
    if held and not any_yet:
        yield np.array([h(b" ".join(held), seed)], np.uint64)


def majority(blocks: Iterator[np.ndarray]) -> int:
    """A bit is 1 if set in over half of all hashes; zero without any."""
    n, total = 0, np.zeros(BITS, np.int64)
    for got in blocks:
        n += len(got)
        total += np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(raw: bytes, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of a UTF-8 text."""
    return majority(shingle_hashes(raw, width, seed))


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fp (its 64 bits as a long) of every row; a null text counts as empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("raw"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(x.as_py(), width, seed) for x in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(hashed, "doc_id long, fp long")


def _summed(df: DataFrame, count) -> np.ndarray:
    """Sum over all rows of what ``count(fps)`` makes of a batch: a vector whose length doesn't depend on the data."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            got = count(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            total = got if total is None else total + got
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total.astype(np.int64))], ["i", "n"])

    rows = df.mapInArrow(add, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max([r.i for r in rows], default=-1) + 1, np.int64)
    for r in rows:
        out[r.i] = r.n
    return out


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def co_counts(fps: np.ndarray) -> np.ndarray:
    """How often each two bits are both 1, as a flat 64 x 64 table."""
    b = _bits(fps).astype(np.float64)
    return np.rint(b.T @ b).astype(np.int64).ravel()


def group_bits(co: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m groups of bits, correlated ones together: each grows from the first free bit by the bit most correlated with it."""
    co = co.reshape(BITS, BITS) / max(n, 1)
    p = np.diag(co)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((co - np.outer(p, p)) / np.outer(sd, sd))
    free, groups = list(range(BITS)), []
    for k in range(m):
        size, own = (len(free) + m - k - 1) // (m - k), [free.pop(0)]
        while len(own) < size:
            best = max(free, key=lambda b: (corr[b, own].sum(), -b))
            free.remove(best)
            own.append(best)
        groups.append(sorted(own))
    return groups


def octets(group: list[int]) -> list[list[int]]:
    """A group's bits by eights."""
    return [group[i : i + 8] for i in range(0, len(group), 8)]


def histograms(parts: list[list[int]]):
    """A counter of the values that each part of at most 8 bits takes."""

    def count(fps: np.ndarray) -> np.ndarray:
        b = _bits(fps).astype(np.int64)
        return np.concatenate([np.bincount(b[:, p] @ (1 << np.arange(len(p))), minlength=256) for p in parts])

    return count


def distance_chances(hists: list[np.ndarray], tau: int) -> np.ndarray:
    """Estimated chance that a pair agrees in a group up to 0..tau bits: exact within octets, octets taken as independent."""
    ones = np.array([bin(x).count("1") for x in range(256)])
    out = np.array([1.0] + [0.0] * tau)
    for h in hists:
        p = h / max(h.sum(), 1)
        at = np.zeros(9)
        for d in range(256):
            at[ones[d]] += float((p * p[np.arange(256) ^ d]).sum())
        out = np.array([sum(out[i] * (at[k - i] if k - i < 9 else 0) for i in range(k + 1)) for k in range(tau + 1)])
    return np.cumsum(out)


def allot(costs: list[list[float]], tau: int) -> tuple[float, list[int]]:
    """Thresholds of least total cost that sum to tau - m + 1; ``costs[i][t + 1]`` is group i's cost at t >= -1."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best.items():
            for t in range(-1, tau + 1):
                key, cand = used + t + 1, (c + row[t + 1], [*ts, t])
                if key <= tau + 1 and (key not in nxt or cand < nxt[key]):
                    nxt[key] = cand
        best = nxt
    return best[tau + 1]


def plan(fps: DataFrame, n: int, tau: int = 2, most: int = 5) -> list[tuple[list[int], int]]:
    """The groups of bits and their thresholds: the cheapest of all group counts up to ``most``.

    A probe costs 1 and so does a candidate pair; counts cover all fingerprints.
    """
    co = _summed(fps.select("fp"), co_counts)
    if not len(co):
        return [(list(range(BITS)), tau)]
    options = [group_bits(co, n, m) for m in range(1, most + 1)]
    parts = [p for groups in options for g in groups for p in octets(g)]
    hists = _summed(fps.select("fp"), histograms(parts)).reshape(len(parts), 256)
    at, found = 0, []
    for groups in options:
        costs = []
        for g in groups:
            k = len(octets(g))
            chance = distance_chances(list(hists[at : at + k]), tau)
            at += k
            probes = np.cumsum([comb(len(g), t) for t in range(tau + 1)])
            costs.append([0.0] + [float(n * (1 + probes[t]) + n * n / 2 * chance[t]) for t in range(tau + 1)])
        cost, ts = allot(costs, tau)
        found.append((cost, [(g, t) for g, t in zip(groups, ts, strict=True) if t >= 0]))
    return min(found, key=lambda x: x[0])[1]


def _long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(groups: DataFrame, ws: Workspace, tau: int = 2, most: int = 5, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) that connect exactly the fingerprints within ``tau`` <= 2 bits.

    ``groups`` has one row per distinct fingerprint: fp and rep (its id).
    """
    if not 0 <= tau <= 2:
        raise ValueError("the way through hot buckets holds up to two bits")
    n = groups.count()
    parts = plan(groups, n, tau, most)
    masks = [(_long(sum(1 << b for b in g)), g, t) for g, t in parts]
    own = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("value")) for i, (m, _, _) in enumerate(masks)]))
    index = groups.select("rep", "fp", own.alias("s")).select("rep", "fp", "s.part", "s.value")
    counts = index.groupBy("part", "value").agg(F.count(F.lit(1)).alias("n"))
    counts = ws.save(counts.where("n > 1") if all(t == 0 for _, t in parts) else counts, "counts")
    probe = index.withColumn("flip", F.lit(0).cast("long"))
    for i, (_, g, t) in enumerate(masks):
        flips = [_long(sum(1 << b for b in bs)) for k in range(1, t + 1) for bs in combinations(g, k)]
        if flips:
            probe = probe.unionByName(groups.select("rep", "fp", F.lit(i).alias("part"), F.explode(F.array(*map(F.lit, flips))).alias("flip")).withColumn("value", F.col("fp").bitwiseAND(F.lit(masks[i][0])).bitwiseXOR(F.col("flip"))))
    tagged = ws.save(probe.join(counts, ["part", "value"]).select("rep", "fp", "part", "value", "n", (F.col("flip") == 0).alias("own")), "tagged")
    few = tagged.where(F.col("n") <= bucket)
    held = few.where("own").select(F.col("rep").alias("b"), F.col("fp").alias("fb"), "part", "value")
    near = (F.col("rep") < F.col("b")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fb"))) <= tau)
    pairs = few.join(held, ["part", "value"]).where(near).select(F.col("rep").alias("a"), "b")
    hot = tagged.where(F.col("n") > bucket).select("rep", "fp").distinct()
    return pairs.unionByName(star(hot, tau)).distinct()


def star(hot: DataFrame, tau: int) -> DataFrame:
    """Edges among fingerprints that share a one-bit neighbour (tau 2), a neighbour or self (tau 1) or nothing else (tau 0)."""
    if tau == 0:
        return hot.select(F.col("rep").alias("a"), F.col("rep").alias("b")).where("a <> b")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(_long(1 << b)) for b in range(BITS)])
    met = hot.select("rep", "fp", F.explode(flips).alias("flip")).withColumn("z", F.col("fp").bitwiseXOR(F.col("flip")))
    # At most 65 distinct fingerprints lie within one bit of a value, so the sets are small whatever the data.
    item = F.struct("rep", (F.col("flip") == 0).alias("self"))
    sets = met.groupBy("z").agg(F.collect_set(item).alias("who")).where(F.size("who") > 1)
    if tau == 2:
        who = F.array_sort(F.transform("who", lambda x: x["rep"]))
        return sets.select(F.element_at(who, 1).alias("a"), F.explode(F.slice(who, 2, BITS + 1)).alias("b"))
    mid = F.filter("who", lambda x: x["self"])
    return sets.where(F.size(mid) > 0).select(F.element_at(mid, 1)["rep"].alias("a"), F.explode(F.transform("who", lambda x: x["rep"])).alias("b")).where("a <> b")


def fingerprint_components(fps: DataFrame, ws: Workspace, tau: int = 2, bucket: int = BUCKET) -> DataFrame:
    """fp and component_id (smallest doc_id reachable) of every distinct fingerprint in ``fps`` (doc_id, fp)."""
    groups = ws.save(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "groups")
    known = groups.where("rep is not null")
    # One doc_id may stand for two texts: fingerprints are named by a number of their own.
    named = known.select("fp", F.xxhash64("fp").alias("rep"))
    comp = connected_components(links(named, ws, tau, bucket=bucket), ws)
    tied = ws.save(named.join(comp.select(F.col("id").alias("rep"), "component"), "rep").select("fp", "component"), "tied")
    least = ws.save(tied.join(known, "fp").groupBy("component").agg(F.min("rep").alias("component_id")), "least")
    linked = tied.join(least, "component").select("fp", F.col("component_id").alias("far"))
    return ws.save(groups.join(linked, "fp", "left").select("fp", F.coalesce("far", "rep").alias("component_id")), "ids")


def near_duplicates(docs: DataFrame, ws: Workspace, width: int = 3, tau: int = 2, seed: int = 42, bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id, kept.

    Fingerprints of lower-cased (A-Z) word shingles link at ``tau`` or fewer
    differing bits; component_id is the smallest doc_id reachable.  Texts with
    fewer words than a shingle are one shingle, texts without words (null, empty,
    white space) have fingerprint zero, which links like any other.  Ties in a
    bit count give 0.  ``kept`` marks rows whose doc_id is their component_id.
    Rows without doc_id get a component_id if their fingerprint has one, else
    null, and are not kept.  Repeated rows share a component.  Empty table: empty
    result; further columns are ignored.
    """
    fps = ws.save(fingerprints(docs, width, seed), "fingerprints")
    ids = fingerprint_components(fps, ws, tau, bucket)
    return fps.join(ids, "fp").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def hex16(fp: Column) -> Column:
    """16 lowercase hex digits of a 64-bit value held as a long."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# Similarity of 0.8 on five-word shingles is out of reach for whole-text fingerprints:
# such texts differ in up to 16 of 64 bits and more.  Fingerprints of sampled shingles
# find them, and the full sets of shingles decide.

#: Hash ranges a text is sampled in, and shingles of least hash taken of each.
RANGES, TAKE = 8, 3
#: Texts of one sampled fingerprint, and shingles of them, that make a block.
TOGETHER, SHINGLES = 256, 200_000


def sampled_keys(hashes: np.ndarray) -> list[int]:
    """A fingerprint of the least hashes in each range of hash values; none for an empty range.

    Texts of Jaccard similarity J agree in a range with a chance of J**TAKE at least.
    """
    h = np.unique(hashes)
    edges = np.searchsorted(h, np.arange(RANGES, dtype=np.uint64) << np.uint64(61)).tolist() + [len(h)]
    return [_long(xxhash.xxh64_intdigest(h[a : min(a + TAKE, b)].tobytes(), r)) for r, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]


def sketches(docs: DataFrame, width: int = 5, seed: int = 42) -> DataFrame:
    """doc_id, fp, number of shingles and sampled keys of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("raw"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, sizes, keys = [], [], []
            for x in b.column(1):
                blocks = list(shingle_hashes(x.as_py(), width, seed))
                sizes.append(sum(map(len, blocks)))
                fps.append(_long(majority(iter(blocks))))
                keys.append(sampled_keys(np.concatenate(blocks)) if blocks else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "fp", "size", "keys"])

    return rows.mapInArrow(hashed, "doc_id long, fp long, size long, keys array<long>")


def common(sets: list[np.ndarray], size: np.ndarray, at_once: int = 4096) -> np.ndarray:
    """Number of common values of each two sets: products of 0/1 columns, a bounded number at once."""
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), size)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    first = np.concatenate(([True], values[1:] != values[:-1]))
    shared = np.diff(np.append(np.flatnonzero(first), len(values))) > 1
    column = np.cumsum(first) - 1
    keep = shared[column]
    owner, column = owner[keep], (np.cumsum(shared) - 1)[column[keep]]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, int(shared.sum()), at_once):
        i, j = np.searchsorted(column, [a, a + at_once])
        held = np.zeros((len(sets), at_once), np.float32)
        held[owner[i:j], column[i:j] - a] = 1
        both += held @ held.T
    return both


def similar_sets(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray, cross: bool, least: float) -> list[tuple[int, int]]:
    """A spanning forest of the texts whose sets have Jaccard similarity ``least`` or more; with ``cross`` only between the two sides."""
    size = np.array([len(x) for x in sets])
    both = common(sets, size)
    near = both >= least * (size[:, None] + size[None, :] - both) - 1e-6
    if cross:
        near &= side[:, None] != side[None, :]
    np.fill_diagonal(near, False)
    root = ids.copy()
    big = np.iinfo(np.int64).max
    while True:
        new = np.minimum(root, np.where(near, root[None, :], big).min(axis=1))
        if (new == root).all():
            break
        root = new
    return [(int(a), int(b)) for a, b in zip(ids, root, strict=True) if a != b]


def similar_links(docs: DataFrame, keyed: DataFrame, ws: Workspace, width: int, seed: int, least: float, together: int = TOGETHER) -> DataFrame:
    """Edges (a, b) that connect documents of similarity ``least`` or more which share a sampled key.

    ``keyed``: doc_id, size and keys.  A key's documents are compared in blocks
    of about ``together`` and of ``SHINGLES`` shingles, every block with every
    other, and each comparison returns a forest.
    """
    each = keyed.where("doc_id is not null").select("doc_id", "size", F.explode("keys").alias("key"))
    blocks = F.greatest(F.ceil(F.col("n") / together), F.ceil(F.col("all") / SHINGLES)).cast("int")
    counts = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("all")).where("n > 1")
    counts = ws.save(counts.select("key", F.least(blocks, F.col("n").cast("int")).alias("blocks")), "key_counts")
    each = each.select("doc_id", "key")
    shared = ws.save(each.join(counts, "key"), "shared")
    members = shared.select("doc_id").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("raw")).join(members.hint("merge"), "doc_id")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = []
            for x in b.column(1):
                blocks = list(shingle_hashes(x.as_py() or b"", width, seed))
                got = np.concatenate(blocks) if blocks else np.empty(0, np.uint64)
                sets.append(np.unique((got >> np.uint64(16)).astype(np.uint32)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["doc_id", "hashes"])

    sets = ws.save(texts.mapInArrow(to_sets, "doc_id long, hashes binary"), "sets")
    own = F.pmod(F.xxhash64("doc_id", "key"), "blocks").cast("int")
    rows = shared.select("doc_id", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.join(sets, "doc_id").select("doc_id", "key", "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "hashes")

    def compare(table: pa.Table) -> pa.Table:
        side = table.column("own").to_numpy()
        cross = bool(table.column("lo")[0].as_py() != table.column("hi")[0].as_py())
        out = []
        if len(table) > 1:
            got = [np.frombuffer(x, np.uint32) for x in table.column("hashes").to_pylist()]
            out = similar_sets(table.column("doc_id").to_numpy(), got, side, cross, least)
        return pa.table([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return ws.save(rows.groupBy("key", "lo", "hi").applyInArrow(compare, "a long, b long"), "similar")


def similar_documents(docs: DataFrame, ws: Workspace, width: int = 5, least: float = 0.8, tau: int = 2, seed: int = 42) -> DataFrame:
    """doc_id and component_id of documents that are not alone in their component.

    Documents link when their fingerprints differ in ``tau`` bits or fewer, or
    when their sets of shingles have Jaccard similarity ``least`` or more and
    they share a sampled fingerprint (99.7 % of pairs at 0.8, more above).
    Words are lower-cased (A-Z); texts without words link with each other; a row
    without doc_id links with nothing.  Empty table: empty result.
    """
    drawn = ws.save(sketches(docs, width, seed), "sketches")
    ids = fingerprint_components(drawn.select("doc_id", "fp"), ws, tau)
    exact = drawn.where("doc_id is not null").select("doc_id", "fp").join(ids, "fp").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")).where("a <> b")
    edges = exact.unionByName(similar_links(docs, drawn, ws, width, seed, least))
    return connected_components(edges, ws).select(F.col("id").alias("doc_id"), F.col("component").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, ws: Workspace, width: int = 5, least: float = 0.8, tau: int = 2, seed: int = 42) -> DataFrame:
    """``docs`` with one document of each group of near copies, with the columns of ``docs``.

    The smallest doc_id of a component stays; rows without doc_id all stay.
    """
    found = similar_documents(docs, ws, width, least, tau, seed)
    gone = found.where("doc_id <> component_id").select("doc_id")
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
