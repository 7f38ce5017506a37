"""Inputs for the queries, derived from the tables: words, segments, frames, tokens, hypotheses.

The tables hold no audio: signals and times are synthesised by fixed rules, in
whole milliseconds, so that sums are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.text import tokens as split_words
from ..functions.vocab import hex_name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, turn, idx, w, base, spk, start_ms, end_ms from the conversations' turns."""
    each = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("rec_id"), "turn", "role", F.posexplode(split_words(F.col("text"))).alias("pos", "w"))
    by = Window.partitionBy("rec_id").orderBy("turn", "pos")
    each = each.withColumn("idx", (F.row_number().over(by) - 1).cast("long"))
    idx = F.col("idx")
    base = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    dur = F.when(idx % 5 == 4, 0).otherwise(40 * F.char_length("w"))
    gap = F.when(idx == 0, 0).when(F.col("pos") == 0, 700).when(idx % 131 == 0, 1600).when(idx % 157 == 0, 1300).otherwise(60)
    flip = (idx % 100 < 30) & (idx % 11).isin(0, 2)
    each = each.select("rec_id", "turn", "idx", "w", base.cast("int").alias("base"), dur.cast("long").alias("dur"), gap.cast("long").alias("gap"))
    spk = F.when(idx % 389 == 388, None).when(flip, (F.col("base") + 1) % 2).otherwise(F.col("base"))
    upto = Window.partitionBy("rec_id").orderBy("idx")
    end = F.sum(F.col("gap") + F.col("dur")).over(upto)
    return each.select("rec_id", "turn", "idx", "w", "base", spk.cast("int").alias("spk"), (end - F.col("dur")).alias("start_ms"), end.alias("end_ms"))


def segments(w: DataFrame) -> DataFrame:
    """rec_id, seg_idx, a_ms, b_ms, spk: one per turn but every fifth, with ragged edges."""
    got = w.groupBy("rec_id", "turn").agg(F.min("start_ms").alias("s"), F.max("end_ms").alias("e"), F.min("base").alias("spk")).where("turn % 5 <> 3")
    got = got.select("rec_id", "turn", (F.col("s") - 100 * (F.col("turn") % 3)).alias("a_ms"), (F.col("e") + 900 * ((F.col("turn") + 1) % 2)).alias("b_ms"), "spk")
    nth = F.row_number().over(Window.partitionBy("rec_id").orderBy("a_ms", "turn")) - 1
    return got.select("rec_id", nth.cast("long").alias("seg_idx"), "a_ms", "b_ms", "spk")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rec_id, frame, rms: an hour of a user's events is a frame, from the table's first hour to its last; hours without events are quiet.

    Every hour with events brings the quiet ones up to the next, so the grid is
    never joined: Spark takes an exploded table for as small as what it was
    exploded from, and would broadcast it.
    """
    hour = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000)
    ev = table(spark, sf_dir, "events").select(F.col("user_id").alias("rec_id"), hour.alias("hour"), "value")
    lo, hi = ev.agg(F.min("hour"), F.max("hour")).first()
    lo, hi = lo or 0, hi or 0
    rms = ev.groupBy("rec_id", (F.col("hour") - lo).cast("int").alias("frame")).agg(F.sqrt(F.avg(F.col("value") * F.col("value")) + 1e-12).alias("rms"))
    # Events without a time come first: they make a user, but no frame is theirs.  Nor has a null user's frame a rms: null equals nothing.
    by = Window.partitionBy("rec_id").orderBy("frame")
    first = F.when(F.row_number().over(by) == 1, 0).otherwise(F.col("frame"))
    after = F.lead("frame", 1, int(hi - lo) + 1).over(by)
    spans = rms.select("rec_id", F.col("frame").alias("at"), "rms", first.alias("a"), after.alias("b")).where("b > a")
    grid = spans.select("rec_id", "at", "rms", F.explode(F.sequence("a", F.col("b") - 1)).alias("frame"))
    own = (F.col("frame") == F.col("at")) & F.col("rec_id").isNotNull()
    return grid.select("rec_id", "frame", F.when(own, F.coalesce("rms", F.lit(1e-6))).otherwise(1e-6).alias("rms"))


def totals(fr: DataFrame) -> DataFrame:
    return fr.groupBy("rec_id").agg((F.max("frame") + 1).cast("long").alias("total"))


def tokens(w: DataFrame) -> DataFrame:
    """rec_id, block_no, pos, name, text, t_ms: words in pieces of 4 characters, a control token before every 50th."""
    n = F.ceil(F.char_length("w") / 4)
    each = w.select("rec_id", "idx", "w", "start_ms", "end_ms", F.floor(F.col("idx") / 40).cast("int").alias("block_no"), F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("k"))
    piece = F.substring(F.col("w"), F.col("k") * 4 + 1, F.lit(4))
    nth = F.row_number().over(Window.partitionBy("rec_id", "block_no").orderBy("idx", "k")) - 1
    each = each.withColumn("nth", nth.cast("long"))
    # Every seventh block begins inside a word: its first piece has no head mark.
    bare = (F.col("nth") == 0) & (F.col("block_no") % 7 == 3)
    head = (F.col("k") == 0) & ~bare
    last = F.col("k") == (F.ceil(F.char_length("w") / 4) - 1)
    t = F.when(F.col("block_no") % 2 == 1, None).when(last, F.col("end_ms")).otherwise(F.col("start_ms"))
    real = each.select("rec_id", "block_no", (F.col("nth") * 2 + 1).alias("pos"), F.concat(F.when(head, F.lit("Ġ")).otherwise(F.lit("")), piece).alias("name"), F.concat(F.when(head, F.lit(" ")).otherwise(F.lit("")), piece).alias("text"), t.alias("t_ms"))
    special = each.where("nth % 50 = 0").select("rec_id", "block_no", (F.col("nth") * 2).alias("pos"), F.concat(F.lit("<|"), F.col("nth").cast("string"), F.lit("|>")).alias("name"), F.lit("").alias("text"), F.lit(None).cast("long").alias("t_ms"))
    return real.unionByName(special)


def token_blocks(w: DataFrame) -> DataFrame:
    """rec_id, block_no, b0_ms, b1_ms of the blocks of 40 words."""
    return w.groupBy("rec_id", F.floor(F.col("idx") / 40).cast("int").alias("block_no")).agg(F.min("start_ms").alias("b0_ms"), F.max("end_ms").alias("b1_ms"))


def _pieces(w: DataFrame) -> DataFrame:
    """rec_id, block_no, nth, id, name, t_ms: words in pieces of 4 bytes, which may end inside a character.

    An id is a piece's bytes read as a number behind a one, so no two pieces share it.
    """
    code = F.hex(F.encode("w", "UTF-8"))
    each = w.select("rec_id", "idx", "start_ms", "end_ms", code.alias("code"), F.floor(F.col("idx") / 40).cast("int").alias("block_no"))
    n = F.ceil(F.length("code") / 8)
    each = each.select("*", n.alias("n"), F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("k"))
    nth = F.row_number().over(Window.partitionBy("rec_id", "block_no").orderBy("idx", "k")) - 1
    each = each.withColumn("nth", nth.cast("long"))
    head = (F.col("k") == 0) & ~((F.col("nth") == 0) & (F.col("block_no") % 7 == 3))
    code = F.concat(F.when(head, F.lit("20")).otherwise(F.lit("")), F.substring(F.col("code"), F.col("k") * 8 + 1, F.lit(8)))
    t = F.when(F.col("k") == F.col("n") - 1, F.col("end_ms")).otherwise(F.col("start_ms"))
    return each.select("rec_id", "block_no", "nth", F.conv(F.concat(F.lit("1"), code), 16, 10).cast("long").alias("id"), hex_name(code).alias("name"), t.alias("t_ms"))


def vocabulary(w: DataFrame) -> DataFrame:
    """id, name of every piece and of the control tokens."""
    special = w.select((F.col("idx") % 40).alias("k")).distinct().select((-1 - F.col("k")).alias("id"), F.concat(F.lit("<|"), F.col("k").cast("string"), F.lit("|>")).alias("name"))
    return _pieces(w).select("id", "name").distinct().unionByName(special)


def spoken_blocks(w: DataFrame) -> DataFrame:
    """rec_id, block_no, b0_ms, b1_ms, ids, times: blocks of 40 words and what a recogniser hears in them, after a control token; odd blocks have no times."""
    item = F.array_sort(F.collect_list(F.struct("nth", "id", "t_ms")))
    said = _pieces(w).groupBy("rec_id", "block_no").agg(item.alias("x"))
    special = F.array((-1 - F.col("block_no") % 40).cast("long"))
    ids = F.concat(special, F.transform("x", lambda x: x["id"]))
    times = F.when(F.col("block_no") % 2 == 0, F.concat(F.array(F.lit(0).cast("long")), F.transform("x", lambda x: x["t_ms"])))
    return token_blocks(w).join(said.select("rec_id", "block_no", ids.alias("ids"), times.alias("times")), ["rec_id", "block_no"])


def voices(w: DataFrame) -> DataFrame:
    """rec_id, nth, a_ms, b_ms, voice: the stretches of ``segments`` as a diarizer's input."""
    return segments(w).select("rec_id", F.col("seg_idx").alias("nth"), "a_ms", "b_ms", F.col("spk").alias("voice"))


def docs_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, toks of every document with words."""
    return table(spark, sf_dir, "documents").select("doc_id", split_words(F.col("text")).alias("toks")).where(F.size("toks") > 0)


def hypotheses(w: DataFrame) -> DataFrame:
    """stream_id, step, clock_ms, silent, last, hyp: growing windows of 48 words that disagree at the end of every second step."""
    n = w.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n"))
    steps = n.select("rec_id", "n", F.explode(F.sequence(F.lit(1), (F.floor(F.col("n") / 6) + 1).cast("int"))).alias("step"))
    steps = steps.select("rec_id", "step", F.greatest(F.lit(0), F.col("step") * 6 - 48).alias("lo"), F.least(F.col("step") * 6, "n").alias("hi"), (F.col("step") == F.floor(F.col("n") / 6) + 1).alias("last"))
    # A word lies in the eight steps that follow it, so each is dealt to those alone.
    near = w.select("rec_id", "idx", "w", "start_ms", "end_ms", F.explode(F.sequence(F.floor(F.col("idx") / 6).cast("int") + 1, F.floor(F.col("idx") / 6).cast("int") + 8)).alias("step"))
    met = near.join(steps, ["rec_id", "step"]).where("idx >= lo and idx < hi")
    cut = (F.col("step") % 2 == 0) & (F.col("idx") >= F.col("hi") - 2)
    said = F.when(cut, F.concat("w", F.lit("x"))).when(F.col("step") % 3 == 0, F.upper("w")).otherwise(F.concat("w", F.lit(",")))
    item = F.struct("idx", F.struct(said.alias("w"), "start_ms", "end_ms").alias("x"))
    got = met.groupBy("rec_id", "step", "last").agg(F.max("end_ms").alias("clock_ms"), F.transform(F.array_sort(F.collect_list(item)), lambda x: x["x"]).alias("hyp"))
    silent = (F.col("step") % 17 == 0) & ~F.col("last")
    return got.select(F.col("rec_id").alias("stream_id"), F.col("step").cast("long").alias("step"), "clock_ms", silent.alias("silent"), "last", F.when(silent, F.slice("hyp", 1, 0)).otherwise(F.col("hyp")).alias("hyp"))


#: Milliseconds of a chunk of the synthetic streams.
CHUNK_MS = 700


def chunks(w: DataFrame) -> DataFrame:
    """stream_id, step, ms, energy, last, said: a recording's time in chunks, seven of every forty of them quiet, with the words that start in each loud one."""
    total = w.groupBy("rec_id").agg(F.max("end_ms").alias("total"))
    grid = total.select("rec_id", "total", F.explode(F.sequence(F.lit(0), F.floor(F.col("total") / CHUNK_MS))).alias("k"))
    loud = F.col("k") % 40 < 33
    said = w.select("rec_id", F.floor(F.col("start_ms") / CHUNK_MS).alias("k"), F.struct("idx", F.struct("w", "start_ms", "end_ms").alias("x")).alias("item"))
    said = said.groupBy("rec_id", "k").agg(F.transform(F.array_sort(F.collect_list("item")), lambda x: x["x"]).alias("said"))
    got = grid.join(said, ["rec_id", "k"], "left")
    nothing = F.array().cast("array<struct<w:string,start_ms:bigint,end_ms:bigint>>")
    return got.select(F.col("rec_id").alias("stream_id"), (F.col("k") + 1).alias("step"), F.lit(CHUNK_MS).cast("long").alias("ms"), F.when(loud, F.lit(0.01)).otherwise(F.lit(1e-10)).alias("energy"), (F.col("k") == F.floor(F.col("total") / CHUNK_MS)).alias("last"), F.when(loud, F.coalesce("said", nothing)).otherwise(nothing).alias("said"))
