"""Mixing sources to target weights by capped water-filling.

DataFrame functions only.  Every source wants its share of the total by weight;
a source stops at ``max_epochs`` times its own size and what it leaves is shared
by weight among the others until none is above.  The level is found in closed
form over the sources sorted by cap per weight.  A source's ratio of target to
size is then met by seeded sampling: whole repetitions for all its documents, one
more for those with a small seeded hash, and a fractional one for the few whose
hash lies in the bucket that the target cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .store import Workspace
from .text import WORD

#: Hash buckets per source; a sum per (source, bucket) replaces a sort of the source.
BUCKETS = 4096


def drawn(doc_id: Column, seed: int) -> Column:
    """A seeded number of 32 bits for each doc_id, as any engine with MD5 finds it; a null counts as the word ``null``."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long")


def word_count(text: Column) -> Column:
    """Number of words in the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = 3, share: float = 1.0) -> DataFrame:
    """Water-filling over a table of sources.

    Parameters
    ----------
    sizes : columns source and source_size, one row per source.  Sources are the
        few groups that a mixture names; this table, not the documents, is put
        in one order.
    weights : given to the sources by code point, null last, repeating.
    max_epochs : cap, in times of a source's size.
    share : share of all sizes to be mixed.

    Returns source, source_size, weight, target (double).
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    picks = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.select("source", "source_size", (F.row_number().over(order) - 1).alias("i"))
    rows = rows.select("source", "source_size", F.element_at(picks, (F.col("i") % len(weights) + 1).cast("int")).alias("weight"), (F.col("source_size") * max_epochs).cast("double").alias("cap"), "i")
    every = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "i")
    upto = fill.rowsBetween(Window.unboundedPreceding, -1)
    # If the sources before this one are full, the others share the rest at this level.
    rows = rows.select("*", F.sum("source_size").over(every).alias("all_size"), F.sum("weight").over(every).alias("all_w"), F.coalesce(F.sum("cap").over(upto), F.lit(0.0)).alias("full"), F.coalesce(F.sum("weight").over(upto), F.lit(0.0)).alias("full_w"))
    rows = rows.withColumn("level", (F.col("all_size") * F.lit(float(share)) - F.col("full")) / (F.col("all_w") - F.col("full_w")))
    # The first source that this level leaves below its cap fixes the level; with none all are full.
    free = F.col("level") * F.col("weight") <= F.col("cap")
    found = F.min(F.when(free, F.struct((F.col("cap") / F.col("weight")).alias("c"), "i", "level"))).over(every)["level"]
    return rows.withColumn("found", found).select("source", "source_size", "weight", F.least(F.col("cap"), F.coalesce(F.col("found") * F.col("weight"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, ws: Workspace, weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = 3, share: float = 1.0, seed: int = 17) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, taken, copies.

    ``taken`` counts the words that the mix takes of the document, repeats
    included: ``copies`` whole repetitions and, for documents in the bucket that
    a source's target cuts, a fraction of one more.  It never exceeds
    ``max_epochs`` times the size.  The seeded hash of doc_id decides, so reruns
    agree and repeated rows fare alike.  A null text has size 0; null is a source
    of its own, last in order; a source without words has target 0.  A null
    doc_id hashes like any value.  Empty table: empty result; further columns
    are ignored.
    """
    hashed = drawn(F.col("doc_id"), seed)
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    sized = ws.save(sized.withColumn("bucket", F.pmod(hashed, F.lit(BUCKETS)).cast("int")), "sizes")
    held = ws.save(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    total = held.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = ws.save(source_targets(total, weights, max_epochs, share), "targets")
    plan = ws.save(cut_buckets(held, targets), "plan")
    rows = sized.join(plan, F.col("source").eqNullSafe(F.col("p_source"))).select("doc_id", "source", "size", "source_size", "target", "whole", "cut", "part", "bucket")
    copies = F.col("whole") + F.when(F.col("bucket") < F.col("cut"), 1).otherwise(0)
    some = F.when(F.col("bucket") == F.col("cut"), F.floor(F.col("size") * F.col("part") + F.pmod(drawn(F.col("doc_id"), seed + 1), F.lit(1 << 20)) / float(1 << 20))).otherwise(F.lit(0))
    rows = rows.withColumn("copies", copies.cast("long"))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies") + F.least("size", some)).cast("long").alias("taken"), "copies")


def cut_buckets(held: DataFrame, targets: DataFrame) -> DataFrame:
    """Where each source's fractional repetition ends.

    ``held`` has words per (source, bucket).  Returns p_source, source_size,
    target, whole (repetitions of every document), cut (buckets below take one
    more) and part (share of one more in bucket ``cut``).
    """
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    t = targets.select(F.col("source").alias("p_source"), "source_size", "target", F.floor(ratio).cast("long").alias("whole"))
    t = t.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    up = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = held.select("source", "bucket", "words", F.coalesce(F.sum("words").over(up), F.lit(0)).alias("before"))
    at = sums.join(t, F.col("source").eqNullSafe(F.col("p_source"))).where("before <= rest and before + words > rest")
    at = at.groupBy("source").agg(F.min(F.struct("bucket", ((F.col("rest") - F.col("before")) / F.col("words")).alias("part"))).alias("m"))
    # Without such a bucket nothing is left to cut.
    return t.join(at.select(F.col("source").alias("a_source"), "m"), F.col("p_source").eqNullSafe(F.col("a_source")), "left").select("p_source", "source_size", "target", "whole", F.coalesce("m.bucket", F.lit(0)).alias("cut"), F.coalesce("m.part", F.lit(0.0)).alias("part"))


def sample_mix(docs: DataFrame, ws: Workspace, weights: tuple[float, ...] = (1, 2, 3), max_epochs: int = 3, share: float = 1.0, seed: int = 17) -> DataFrame:
    """The mixed documents, whole, each as often as its copies say, with the columns of ``docs``.

    A fractional repetition becomes a whole one with its fraction as seeded
    chance; texts are never cut here, however long.  The seeded hash of doc_id
    decides, so reruns agree and repeated rows fare alike; a null doc_id hashes
    like any value.  A null text has size 0, null is a source of its own, and
    documents of a source without words don't come.  Columns may have any name.
    An empty table gives an empty result.
    """
    key = drawn(F.col("doc_id"), seed)
    sized = docs.select(F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.pmod(key, F.lit(BUCKETS)).cast("int").alias("bucket"))
    held = ws.save(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    targets = ws.save(source_targets(held.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs, share), "targets")
    plan = ws.save(cut_buckets(held, targets), "plan")
    # The row travels as one struct, apart from what is added beside it.
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("source").cast("string").alias("source"), F.pmod(key, F.lit(BUCKETS)).cast("int").alias("bucket"), (F.pmod(drawn(F.col("doc_id"), seed + 1), F.lit(1 << 20)) / float(1 << 20)).alias("chance"))
    rows = row.join(plan, F.col("source").eqNullSafe(F.col("p_source")))
    more = (F.col("bucket") < F.col("cut")) | ((F.col("bucket") == F.col("cut")) & (F.col("chance") < F.col("part")))
    rows = rows.select("row", (F.col("whole") + F.when(more, 1).otherwise(0)).cast("int").alias("copies")).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
