"""Exact deduplication by composable polynomial fingerprints.

The fingerprint of bytes ``s`` is the number with base-256 digits ``s`` modulo a
prime, so fingerprints of chunks combine by length-shifted arithmetic:
``H(a + b) = H(a) * 256**len(b) + H(b)``.  Documents above ``split_bytes`` are
cut into chunk rows that are hashed in parallel tasks and combined afterwards;
shorter ones are hashed chunk by chunk where they lie.  Equal fingerprints only
nominate: the chunks of every nominated text meet those of its group's first one
by their number, each a row of its own, and what differs forms groups of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import Workspace
from .text import SPACE, squeeze

#: The largest prime below 10**36; far from any power of two, so that no short shift is a small factor.
MODULUS = 10**36 - 159
CHUNK = 1 << 16


def chunk_hash(data: bytes, modulus: int = MODULUS) -> int:
    """Polynomial fingerprint of one chunk."""
    return int.from_bytes(data, "big") % modulus


def combine(parts: list[tuple[int, int]], modulus: int = MODULUS) -> int:
    """Fingerprint of the concatenation of chunks given as (hash, length) in order."""
    h = 0
    for part, n in parts:
        h = (h * pow(256, n, modulus) + part) % modulus
    return h


def fingerprint(data: bytes, modulus: int = MODULUS, chunk: int = CHUNK) -> int:
    """Fingerprint of ``data``, chunk by chunk."""
    cuts = [data[i : i + chunk] for i in range(0, len(data), chunk)]
    return combine([(chunk_hash(c, modulus), len(c)) for c in cuts], modulus)


def fingerprints(docs: DataFrame, ws: Workspace, modulus: int = MODULUS, split_bytes: int = 1 << 24, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, n_bytes, fp (hex), text_sha256 of its normalised text.

    Both sides of ``split_bytes`` give the same; above it no task hashes a whole text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, lens, shas = [], [], []
            for raw in b.column(1).to_pylist():
                t = squeeze(raw)
                fps.append(f"{fingerprint(t, modulus, chunk):030x}")
                lens.append(len(t))
                shas.append(hashlib.sha256(t).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lens, pa.int64()), pa.array(fps, pa.string()), pa.array(shas, pa.string())], ["doc_id", "n_bytes", "fp", "text_sha256"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [f"{chunk_hash(x, modulus):030x}" for x in b.column(3).to_pylist()]
            size = [len(x) for x in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(size, pa.int64()), pa.array(got, pa.string())], ["row", "doc_id", "no", "n", "h"])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [sorted(((c["no"], c["h"], c["n"]) for c in cs)) for cs in b.column(2).to_pylist()]
            fps = [f"{combine([(int(h, 16), n) for _, h, n in cs], modulus):030x}" for cs in out]
            lens = [sum(n for _, _, n in cs) for cs in out]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lens, pa.int64()), pa.array(fps, pa.string()), b.column(1)], ["doc_id", "n_bytes", "fp", "text_sha256"])

    schema = "doc_id long, n_bytes long, fp string, text_sha256 string"
    one = rows.where(F.octet_length("text") <= split_bytes).select("doc_id", F.col("text").cast("binary").alias("raw"))
    # A chunk row is a thousandth of what a task can hold, whatever the document's length.
    big = rows.where(F.octet_length("text") > split_bytes).select("doc_id", F.regexp_replace("text", SPACE, " ").cast("binary").alias("raw"))
    # Written before it is used twice: a second evaluation could number the rows in another way.
    big = ws.save(big.select("doc_id", F.sha2("raw", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("row"), "raw"), "big")
    step = max(chunk, split_bytes // 16)
    pieces = cut(big.select("row", "doc_id", "raw"), step)
    parts = pieces.repartition(F.col("row"), F.col("no")).mapInArrow(hashed, "row long, doc_id long, no int, n long, h string")
    whole = parts.groupBy("row").agg(F.collect_list(F.struct("no", "h", "n")).alias("parts"))
    whole = whole.join(big.select("row", "doc_id", "text_sha256"), "row").select("doc_id", "text_sha256", "parts").mapInArrow(joined, schema)
    return one.mapInArrow(short, schema).unionByName(whole)


def cut(rows: DataFrame, step: int) -> DataFrame:
    """``rows`` with no and part, one per ``step`` bytes of raw (one for an empty raw), in place of raw; a row is made as it is read, never all of a text's."""
    last = F.greatest(F.floor((F.octet_length("raw") - 1) / step), F.lit(0)).cast("int")
    numbered = rows.select("*", F.explode(F.sequence(F.lit(0), last)).alias("no"))
    return numbered.select(*(c for c in rows.columns if c != "raw"), "no", F.substring(F.col("raw"), F.col("no") * step + 1, F.lit(step)).alias("part"))


def exact_duplicates(docs: DataFrame, ws: Workspace, modulus: int = MODULUS, split_bytes: int = 1 << 24) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space became one
    space; a null text counts as empty.  Of equal texts the smallest doc_id stays.
    A row that repeats with its doc_id counts in group_size; one of the repeats is
    kept.  A row without doc_id can't be named as the one that stays: it is kept,
    a group of its own, with null keep_id.  Two texts under one doc_id are treated
    as two documents.  An empty table gives an empty result; further columns of
    ``docs`` are ignored.
    """
    # The number tells repeats of one row apart; it is written with the row, so it stays.
    fps = ws.save(fingerprints(docs, ws, modulus, split_bytes).withColumn("nth", F.monotonically_increasing_id()), "fingerprints")
    known = fps.where("doc_id is not null")
    key = ["fp", "n_bytes"]
    groups = ws.save(known.groupBy(*key).agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.min(F.struct("doc_id", "text_sha256"))["text_sha256"].alias("first_sha")).where("group_size > 1"), "groups")
    members = ws.save(known.join(groups, key).select("doc_id", "keep_id", "text_sha256", "first_sha", "n_bytes", "fp"), "members")
    # Whole texts of nominated documents only, as chunks; each text leaves its row once.
    wanted = members.select("doc_id", "text_sha256", "keep_id", "first_sha").distinct()
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # Always by sort and merge: the list of ids grows with the input, and a plan that changes with it would not scale alike.
    texts = raw.join(wanted.hint("merge"), "doc_id").withColumn("raw", F.regexp_replace("text", SPACE, " ").cast("binary")).drop("text")
    texts = texts.where(F.sha2("raw", 256) == F.col("text_sha256"))
    chunks = ws.save(cut(texts, CHUNK), "chunks")
    todo, settled, held = members, [], chunks
    while True:
        # Held chunks carry their group; those of the first text meet all others of their number.
        mine = (F.col("doc_id") == F.col("keep_id")) & (F.col("text_sha256") == F.col("first_sha"))
        # Written, so that both sides of the join are dealt straight from tables and a hot group's partition can be split.
        firsts = ws.save(held.where(mine).select("keep_id", "first_sha", "no", F.col("part").alias("first_part")).dropDuplicates(["keep_id", "first_sha", "no"]), "firsts")
        met = held.where(~mine).join(firsts, ["keep_id", "first_sha", "no"], "left")
        wrong = ws.save(met.where(~F.col("part").eqNullSafe(F.col("first_part"))).select("doc_id", "text_sha256"), "wrong")
        ws.drop(firsts)
        odd = wrong.distinct()
        if not odd.limit(1).count():
            settled.append(todo)
            break
        # Equal fingerprints of different texts: they form groups of their own and are compared again.
        settled.append(todo.join(odd, ["doc_id", "text_sha256"], "left_anti"))
        rest = ws.save(todo.join(odd, ["doc_id", "text_sha256"]).drop("keep_id", "first_sha"), "rest")
        first = ws.save(rest.groupBy(*key).agg(F.min(F.struct("doc_id", "text_sha256")).alias("f")), "first")
        todo = ws.save(rest.join(first, key).select("*", F.col("f.doc_id").alias("keep_id"), F.col("f.text_sha256").alias("first_sha")).drop("f"), "todo")
        held = chunks.drop("keep_id", "first_sha").join(todo.select("doc_id", "text_sha256", "keep_id", "first_sha").distinct(), ["doc_id", "text_sha256"])
    classes = settled[0] if len(settled) == 1 else ws.save(_all(settled), "classes")
    classes = classes.select("doc_id", "text_sha256", "keep_id", "first_sha").distinct()
    if len(settled) == 1:
        # Every nomination held: sizes are those of the groups.
        out = known.join(groups, key, "left")
    else:
        sized = known.join(classes, ["doc_id", "text_sha256"])
        sizes = ws.save(sized.groupBy("keep_id", "first_sha").agg(F.count(F.lit(1)).alias("group_size")), "sizes")
        classes = ws.save(classes.join(sizes, ["keep_id", "first_sha"]).select("doc_id", "text_sha256", "keep_id", "group_size"), "sized")
        out = known.join(classes, ["doc_id", "text_sha256"], "left")
    out = out.select("doc_id", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), "text_sha256", "nth")
    # Of rows that repeat whole, the first by number is the one kept; few rows do.
    again = known.where("doc_id is not null").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("one")).where("n > 1")
    again = ws.save(again.select("doc_id", "text_sha256", "one"), "again")
    out = out.join(again, ["doc_id", "text_sha256"], "left")
    out = out.withColumn("kept", (F.col("doc_id") == F.col("keep_id")) & F.coalesce(F.col("one") == F.col("nth"), F.lit(True))).drop("nth", "one")
    lost = fps.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "text_sha256", F.lit(True).alias("kept"))
    return out.unionByName(lost).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def drop_exact_duplicates(docs: DataFrame, ws: Workspace) -> DataFrame:
    """``docs`` without later copies, with the columns of ``docs``, whatever they are called.

    Texts are equal as in ``exact_duplicates``; a null text counts as empty.  Rows
    without doc_id all stay.  Of a repeated row one copy stays; two texts under one
    doc_id are two documents.  Texts of any length; an empty table gives an empty
    result.
    """
    found = exact_duplicates(docs, ws)
    gone = found.where("doc_id is not null and doc_id <> keep_id").select("doc_id", "text_sha256").distinct()
    norm = F.sha2(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), SPACE, " "), 256)
    # The row travels as one struct, apart from what is added beside it.
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), norm.alias("text_sha256"))
    rest = marked.join(gone.hint("merge"), ["doc_id", "text_sha256"], "left_anti")
    many = ws.save(found.where("doc_id = keep_id and not kept").select("doc_id").distinct(), "many")
    if not many.limit(1).count():
        return rest.select("row.*")
    # Only doc_ids that occur in repeated rows are dealt by key.
    once = rest.join(many, "doc_id", "left_anti").select("row.*")
    again = rest.join(many, "doc_id").dropDuplicates(["doc_id", "text_sha256"]).select("row.*")
    return once.unionByName(again)
