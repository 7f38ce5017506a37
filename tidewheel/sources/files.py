"""Texts and transcripts as sources, and all written forms as sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.clock import output_name
from ..functions.text import tokens
from ..operators.assemble import srt_rows, txt_lines, vtt_rows

TRANSCRIPT = "turns array<struct<spk:int,start:double,end:double,text:string>>, words array<struct<w:string,start:double,end:double,spk:int>>"


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (hash of the file's path), toks of every text file."""
    text = spark.read.text(path, wholetext=True).select(F.xxhash64(F.input_file_name()).alias("doc_id"), "value")
    return text.select("doc_id", tokens(F.col("value")).alias("toks"))


def parse_transcripts(rows: DataFrame) -> DataFrame:
    """rec_id, idx, w, start_ms, end_ms, spk from (rec_id, json)."""
    got = rows.select("rec_id", F.from_json("json", TRANSCRIPT).alias("t")).select("rec_id", F.posexplode("t.words").alias("idx", "x"))
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    return got.select("rec_id", F.col("idx").cast("long").alias("idx"), F.col("x.w").alias("w"), ms("x.start").alias("start_ms"), ms("x.end").alias("end_ms"), F.col("x.spk").alias("spk"))


def parse_turns(rows: DataFrame) -> DataFrame:
    """rec_id, turn_no, spk, start_ms, end_ms, text from (rec_id, json)."""
    got = rows.select("rec_id", F.from_json("json", TRANSCRIPT).alias("t")).select("rec_id", F.posexplode("t.turns").alias("turn_no", "x"))
    ms = lambda c: F.round(F.col(c) * 1000).cast("long")
    return got.select("rec_id", F.col("turn_no").cast("long").alias("turn_no"), F.col("x.spk").alias("spk"), ms("x.start").alias("start_ms"), ms("x.end").alias("end_ms"), F.col("x.text").alias("text"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Words of every JSON transcript under ``path``."""
    rows = spark.read.text(path, wholetext=True).select(F.xxhash64(F.input_file_name()).alias("rec_id"), F.col("value").alias("json"))
    return parse_transcripts(rows)


def _whole(rows: DataFrame, order: str, text: str, sep: str, head: str = "", tail: str = "") -> DataFrame:
    """One text per recording from its ordered parts."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return rows.groupBy("rec_id").agg(F.concat(F.lit(head), F.array_join(parts, sep), F.lit(tail)).alias("content"))


def txt_files(turn_table: DataFrame) -> DataFrame:
    return _whole(txt_lines(turn_table), "turn_no", "line", "\n\n")


def srt_files(cue_table: DataFrame) -> DataFrame:
    return _whole(srt_rows(cue_table), "cue_no", "block", "\n\n", tail="\n")


def vtt_files(cue_table: DataFrame) -> DataFrame:
    return _whole(vtt_rows(cue_table), "cue_no", "block", "\n\n", head="WEBVTT\n\n", tail="\n")


def write_named(files: DataFrame, path: str, ext: str) -> None:
    """(rec_id, content) as text, a folder per recording named <rec_id>.<ext>."""
    named = files.select(output_name(F.col("rec_id").cast("string"), ext).alias("name"), F.col("content").alias("value"))
    named.write.partitionBy("name").mode("overwrite").text(path)


def write_final(log: DataFrame, path: str) -> None:
    """The final text of every captions stream, one line each."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seq", "w"))), lambda x: x["w"])
    log.groupBy("stream_id").agg(F.array_join(parts, " ").alias("value")).select("value").write.mode("overwrite").text(path)
