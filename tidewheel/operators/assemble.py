"""Words to turns and cues, and their written forms."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.clock import minute_stamp, stamp
from ..functions.text import ends_sentence, wrap_two
from .speakers import label

#: Islands longer than this are folded in Python: an array fold copies with the square of the length.
FOLD = 4096


def _islands(words: DataFrame, gap_ms: int) -> DataFrame:
    """``words`` with island: no change of speaker and no gap over ``gap_ms`` inside."""
    by = Window.partitionBy("rec_id").orderBy("idx")
    new = (F.row_number().over(by) == 1) | ~F.col("spk").eqNullSafe(F.lag("spk").over(by)) | (F.col("start_ms") - F.lag("end_ms").over(by) > gap_ms)
    return words.withColumn("_new", F.when(new, 1).otherwise(0)).withColumn("island", F.sum("_new").over(by)).drop("_new")


def _ordered(*cols: str) -> Column:
    return F.array_sort(F.collect_list(F.struct("idx", *cols)))


def turns(words: DataFrame, max_gap_ms: int = 1200, max_words: int = 110) -> DataFrame:
    """rec_id, turn_no, spk, start_ms, end_ms, n_words, words, text: session windows with a cap on words.

    The end is that of the last word.
    """
    inside = Window.partitionBy("rec_id", "island").orderBy("idx")
    part = _islands(words, max_gap_ms).withColumn("part", F.floor((F.row_number().over(inside) - 1) / max_words))
    got = part.groupBy("rec_id", "island", "part").agg(F.min("idx").alias("idx"), F.min_by("spk", "idx").alias("spk"), F.min_by("start_ms", "idx").alias("start_ms"), F.max_by("end_ms", "idx").alias("end_ms"), F.count(F.lit(1)).alias("n_words"), F.transform(_ordered("w"), lambda x: x["w"]).alias("words"))
    nth = F.row_number().over(Window.partitionBy("rec_id").orderBy("idx")) - 1
    return got.select("rec_id", nth.cast("long").alias("turn_no"), "spk", "start_ms", "end_ms", "n_words", "words", F.array_join("words", " ").alias("text"))


def turn_stats(turn_table: DataFrame, long_ms: int = 60_000) -> DataFrame:
    """rec_id, n_turns, n_speakers, longest_ms and whether a turn is suspiciously long."""
    got = turn_table.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n_turns"), F.countDistinct("spk").alias("n_speakers"), F.max(F.col("end_ms") - F.col("start_ms")).alias("longest_ms"))
    return got.withColumn("long_turn", F.col("longest_ms") > long_ms)


def cue_breaks(start: list[int], end: list[int], words: list[str], max_ms: int, max_chars: int) -> list[int]:
    """Cue number of every word of one island."""
    out, cue, size, begin = [], 0, 0, 0
    for a, b, w in zip(start, end, words, strict=True):
        if size and (b - begin > max_ms or size + 1 + len(w) > max_chars):
            cue, size = cue + 1, 0
        if size:
            size += 1 + len(w)
        else:
            begin, size = a, len(w)
        out.append(cue)
        if w.endswith((".", "!", "?", "…")) and size > max_chars * 0.45:
            cue, size = cue + 1, 0
    return out


def cues(words: DataFrame, max_ms: int = 6000, max_chars: int = 84, max_gap_ms: int = 1500, line_chars: int = 42) -> DataFrame:
    """rec_id, cue_no, spk, start_ms, end_ms, text, lines: greedy packing within islands of speaker and gap.

    The greedy fold starts anew at every island, so islands are folded apart: an
    array fold inside the JVM, or Python for the very long ones.
    """
    grouped = _islands(words, max_gap_ms).groupBy("rec_id", "island").agg(F.min_by("spk", "idx").alias("spk"), _ordered("w", "start_ms", "end_ms").alias("items"))
    short = grouped.where(F.size("items") <= FOLD).select("rec_id", "spk", F.explode(_fold(F.col("items"), max_ms, max_chars)).alias("c"))
    far = grouped.where(F.size("items") > FOLD).select("rec_id", "spk", "items")
    kind = dict(words.dtypes)

    def fold(batches):
        for b in batches:
            recs, spks, lists = [], [], []
            for rec, spk, items in zip(*(c.to_pylist() for c in b.columns), strict=True):
                nos = cue_breaks([x["start_ms"] for x in items], [x["end_ms"] for x in items], [x["w"] for x in items], max_ms, max_chars)
                groups: dict[int, list] = {}
                for no, x in zip(nos, items, strict=True):
                    groups.setdefault(no, []).append(x)
                for g in groups.values():
                    recs.append(rec)
                    spks.append(spk)
                    lists.append(g)
            yield pa.RecordBatch.from_arrays([pa.array(recs, b.column(0).type), pa.array(spks, b.column(1).type), pa.array(lists, b.column(2).type)], ["rec_id", "spk", "c"])

    item = f"struct<idx:{kind['idx']},w:string,start_ms:bigint,end_ms:bigint>"
    long_ = far.mapInArrow(fold, f"rec_id {kind['rec_id']}, spk {kind['spk']}, c array<{item}>")
    got = short.unionByName(long_)
    text = F.transform("c", lambda x: x["w"])
    nth = F.row_number().over(Window.partitionBy("rec_id").orderBy(F.col("c")[0]["idx"]))
    return got.select("rec_id", nth.cast("long").alias("cue_no"), "spk", F.col("c")[0]["start_ms"].alias("start_ms"), F.element_at("c", -1)["end_ms"].alias("end_ms"), F.array_join(text, " ").alias("text"), wrap_two(text, line_chars).alias("lines"))


def _fold(items: Column, max_ms: int, max_chars: int) -> Column:
    """Array of cues (arrays of items) of one island."""
    empty = F.slice(items, 1, 0)
    start = F.struct(F.array(empty).alias("done"), empty.alias("cur"), F.lit(0).alias("size"))

    def step(s: Column, x: Column) -> Column:
        size = F.char_length(x["w"])
        full = (s["size"] > 0) & ((x["end_ms"] - s["cur"][0]["start_ms"] > max_ms) | (s["size"] + 1 + size > max_chars))
        done = F.when(full, F.array_append(s["done"], s["cur"])).otherwise(s["done"])
        cur = F.when(full, F.array(x)).otherwise(F.array_append(s["cur"], x))
        now = F.when(full | (s["size"] == 0), size).otherwise(s["size"] + 1 + size)
        close = ends_sentence(x["w"]) & (now > max_chars * 0.45)
        return F.struct(F.when(close, F.array_append(done, cur)).otherwise(done).alias("done"), F.when(close, empty).otherwise(cur).alias("cur"), F.when(close, 0).otherwise(now).alias("size"))

    end = F.aggregate(items, start, step)
    return F.filter(F.array_append(end["done"], end["cur"]), lambda c: F.size(c) > 0)


def txt_lines(turn_table: DataFrame, names: dict[int, str] | None = None) -> DataFrame:
    """rec_id, turn_no, line: ``[mm:ss] who: text``."""
    who = label(F.col("spk"), names)
    body = F.when(who != "", F.concat(who, F.lit(": "), F.col("text"))).otherwise(F.col("text"))
    return turn_table.select("rec_id", "turn_no", F.concat_ws(" ", minute_stamp(F.col("start_ms")), body).alias("line"))


def cue_bodies(cue_table: DataFrame, names: dict[int, str] | None = None) -> DataFrame:
    """Cues with body: lines, with the speaker named only where it changes."""
    by = Window.partitionBy("rec_id").orderBy("cue_no")
    change = (F.row_number().over(by) == 1) | ~F.col("spk").eqNullSafe(F.lag("spk").over(by))
    who = F.when(change, label(F.col("spk"), names)).otherwise(F.lit(""))
    text = F.array_join("lines", "\n")
    body = F.when(who == "", text).when(F.size("lines") < 2, F.concat(who, F.lit(":\n"), text)).otherwise(F.concat(who, F.lit(": "), text))
    return cue_table.withColumn("body", body)


def srt_rows(cue_table: DataFrame, names: dict[int, str] | None = None) -> DataFrame:
    """rec_id, cue_no, block: number, times with comma, body."""
    times = F.concat_ws(" --> ", stamp(F.col("start_ms"), True), stamp(F.col("end_ms"), True))
    return cue_bodies(cue_table, names).select("rec_id", "cue_no", F.concat_ws("\n", F.col("cue_no").cast("string"), times, "body").alias("block"))


def vtt_rows(cue_table: DataFrame, names: dict[int, str] | None = None) -> DataFrame:
    """rec_id, cue_no, block: times with dot, body."""
    times = F.concat_ws(" --> ", stamp(F.col("start_ms")), stamp(F.col("end_ms")))
    return cue_bodies(cue_table, names).select("rec_id", "cue_no", F.concat_ws("\n", times, "body").alias("block"))


def transcript_json(turn_table: DataFrame, words: DataFrame) -> DataFrame:
    """rec_id and json: turns without their word lists, and words with times in seconds."""
    secs = lambda c: (F.col(c) / 1000).alias(c.removesuffix("_ms"))
    t = turn_table.groupBy("rec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn_no", F.struct("spk", secs("start_ms"), secs("end_ms"), "text").alias("t")))), lambda x: x["t"]).alias("turns"))
    w = words.groupBy("rec_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", F.struct("w", secs("start_ms"), secs("end_ms"), "spk").alias("x")))), lambda x: x["x"]).alias("words"))
    return t.join(w, "rec_id").select("rec_id", F.to_json(F.struct("turns", "words"), {"ignoreNullFields": "false"}).alias("json"))
