"""All queries over the engine's own operators; their oracle SQL is in ``oracles``."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..config import PipelineConfig
from ..functions import models
from ..functions.clock import minute_stamp, output_name, stamp, stem
from ..functions.text import agreement_key, collapse, ends_sentence, nonempty_join, screen_lines, sentence_case, token_budget, tokens, wrap_two
from ..operators import agreement, assemble, punctuate, signal, speakers, words
from ..sources import files
from ..sources.shared import shared_dir
from . import fixtures as fx, transcript
from .oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]

QUERIES: dict = {}
#: Voiced frames of the event signal.
LOUD = 5.0


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def turns(spark: SparkSession, d: str) -> DataFrame:
    return assemble.turns(fx.words(spark, d)).select("rec_id", "turn_no", "spk", "start_ms", "end_ms", "n_words", "text")


@query
def turn_stats(spark: SparkSession, d: str) -> DataFrame:
    return assemble.turn_stats(assemble.turns(fx.words(spark, d)))


@query
def turn_lines_txt(spark: SparkSession, d: str) -> DataFrame:
    return assemble.txt_lines(assemble.turns(fx.words(spark, d)))


@query
def txt_transcripts(spark: SparkSession, d: str) -> DataFrame:
    return files.txt_files(assemble.turns(fx.words(spark, d)))


@query
def words_from_tokens(spark: SparkSession, d: str) -> DataFrame:
    return words.words_from_tokens(fx.tokens(fx.words(spark, d)))


@query
def recording_words(spark: SparkSession, d: str) -> DataFrame:
    """Words of blocks, timed from their block's start, as one list a recording in its own time."""
    w = fx.words(spark, d)
    blocks = fx.token_blocks(w).select("rec_id", "block_no", F.col("b0_ms").alias("f0"))
    inside = words.words_from_tokens(fx.tokens(w)).join(blocks, ["rec_id", "block_no"])
    inside = inside.select("rec_id", "block_no", "n_in_block", "w", (F.col("start_ms") - F.col("f0")).alias("start_ms"), (F.col("end_ms") - F.col("f0")).alias("end_ms"))
    return words.recording_words(signal.to_absolute(inside, blocks, "start_ms", "end_ms"))


@query
def result_quality(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth recording gave no words."""
    w = fx.words(spark, d)
    return words.result_quality(w, w.where("rec_id % 5 <> 0"))


@query
def words_from_ids(spark: SparkSession, d: str) -> DataFrame:
    """A recogniser's ids by way of a byte-level vocabulary; pieces end inside characters."""
    w = fx.words(spark, d)
    heard = models.recognise(fx.spoken_blocks(w), models.reciting)
    return words.words_from_tokens(words.name_tokens(heard, fx.vocabulary(w)))


def _transcript(spark: SparkSession, d: str, config: PipelineConfig) -> DataFrame:
    w = fx.words(spark, d)
    return transcript.transcript_words(fx.spoken_blocks(w), fx.vocabulary(w), fx.voices(w), config, models.reciting, models.pausing, models.grouping)


@query
def transcript_full(spark: SparkSession, d: str) -> DataFrame:
    """Every stage of the file path; the threshold finds the speakers."""
    return _transcript(spark, d, PipelineConfig()).select("rec_id", "idx", "w", "start_ms", "end_ms", "spk", "relabelled")


@query
def transcript_one_speaker(spark: SparkSession, d: str) -> DataFrame:
    """A known number of speakers, neither marks nor word times; turns."""
    config = PipelineConfig(speakers=1, punctuate=False, word_times=False)
    return transcript.transcript_turns(_transcript(spark, d, config), config).select("rec_id", "turn_no", "spk", "start_ms", "end_ms", "n_words", "text")


@query
def transcript_plain(spark: SparkSession, d: str) -> DataFrame:
    """No speakers: words as they were heard."""
    return _transcript(spark, d, PipelineConfig(diarize=False, punctuate=False)).select("rec_id", "idx", "w", "start_ms", "end_ms", "spk")


@query
def ungated_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The whole signal in shorter blocks."""
    fr = fx.frames(spark, d)
    return transcript.speech_blocks(fr, fx.totals(fr), PipelineConfig(gate=False, target=20), LOUD)


@query
def even_spread(spark: SparkSession, d: str) -> DataFrame:
    w = fx.words(spark, d)
    return words.even_spread(words.words_from_tokens(fx.tokens(w)), fx.token_blocks(w))


@query
def widen_words(spark: SparkSession, d: str) -> DataFrame:
    return words.widen(fx.words(spark, d)).select("rec_id", "idx", "w", "start_ms", "end_ms")


@query
def speaker_runs(spark: SparkSession, d: str) -> DataFrame:
    return speakers.run_table(fx.words(spark, d))


@query
def smooth_speakers(spark: SparkSession, d: str) -> DataFrame:
    return speakers.smooth(fx.words(spark, d)).select("rec_id", "idx", "spk", "relabelled")


@query
def smoothed_count(spark: SparkSession, d: str) -> DataFrame:
    return speakers.smooth(fx.words(spark, d)).groupBy("rec_id").agg(F.sum(F.col("relabelled").cast("long")).alias("relabelled"))


@query
def speaker_at_overlap(spark: SparkSession, d: str) -> DataFrame:
    w = fx.words(spark, d)
    return speakers.overlap_best(w, fx.segments(w)).select("rec_id", "idx", "spk")


@query
def speaker_at_nearest(spark: SparkSession, d: str) -> DataFrame:
    w = fx.words(spark, d)
    return speakers.nearest(w, fx.segments(w)).select("rec_id", "idx", "spk")


@query
def speaker_at_full(spark: SparkSession, d: str) -> DataFrame:
    w = fx.words(spark, d)
    return speakers.attach(w, fx.segments(w)).select("rec_id", "idx", "spk")


@query
def speaker_names(spark: SparkSession, d: str) -> DataFrame:
    w = fx.words(spark, d)
    return w.groupBy("rec_id", "spk").agg(F.count(F.lit(1)).alias("n")).select("rec_id", "spk", speakers.label(F.col("spk"), {1: "Vedėja"}).alias("who"), "n")


@query
def cues(spark: SparkSession, d: str) -> DataFrame:
    return assemble.cues(fx.words(spark, d)).select("rec_id", "cue_no", "spk", "start_ms", "end_ms", "text")


@query
def cue_lines(spark: SparkSession, d: str) -> DataFrame:
    return assemble.cues(fx.words(spark, d)).select("rec_id", "cue_no", F.array_join("lines", "\n").alias("lines"), F.size("lines").cast("long").alias("n_lines"))


@query
def srt_rows(spark: SparkSession, d: str) -> DataFrame:
    return assemble.srt_rows(assemble.cues(fx.words(spark, d)))


@query
def vtt_rows(spark: SparkSession, d: str) -> DataFrame:
    return assemble.vtt_rows(assemble.cues(fx.words(spark, d)))


@query
def transcript_json(spark: SparkSession, d: str) -> DataFrame:
    """Written as JSON and read back: the words and the turns must return."""
    w = fx.words(spark, d)
    json = assemble.transcript_json(assemble.turns(w), w)
    said = files.parse_transcripts(json).select("rec_id", F.lit("word").alias("kind"), F.col("idx").alias("nth"), F.col("w").alias("said"), "start_ms", "end_ms", "spk")
    told = files.parse_turns(json).select("rec_id", F.lit("turn").alias("kind"), F.col("turn_no").alias("nth"), F.col("text").alias("said"), "start_ms", "end_ms", "spk")
    return said.unionByName(told)


@query
def cues_from_json(spark: SparkSession, d: str) -> DataFrame:
    w = fx.words(spark, d)
    back = files.parse_transcripts(assemble.transcript_json(assemble.turns(w), w))
    return assemble.cues(back).select("rec_id", "cue_no", "spk", "start_ms", "end_ms", "text")


@query
def frame_rms(spark: SparkSession, d: str) -> DataFrame:
    return fx.frames(spark, d).select("rec_id", "frame", F.round("rms", 6).alias("rms"))


@query
def sample_frames(spark: SparkSession, d: str) -> DataFrame:
    """Events as samples in order of time, frames of 8."""
    ev = fx.table(spark, d, "events")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return signal.frame_rms(ev.select(F.col("user_id").alias("rec_id"), i.alias("i"), F.col("value").alias("v")), 8).select("rec_id", F.col("frame").cast("long").alias("frame"), F.round("rms", 6).alias("rms"))


@query
def signal_gain(spark: SparkSession, d: str) -> DataFrame:
    """Every third recording scaled down, every seventh to silence."""
    scale = F.when(F.col("user_id") % 7 == 0, 1e-9).when(F.col("user_id") % 3 == 0, 1e-3).otherwise(1.0)
    got = signal.signal_gain(fx.table(spark, d, "events").select(F.col("user_id").alias("rec_id"), (F.col("value") * scale).alias("v")))
    return got.select("rec_id", F.round("rms", 6).alias("rms"), F.round("peak", 9).alias("peak"), "rejected", F.round("gain", 6).alias("gain"))


def _regions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    fr = fx.frames(spark, d)
    return fr, signal.speech_regions(fr, LOUD)


@query
def speech_regions(spark: SparkSession, d: str) -> DataFrame:
    return _regions(spark, d)[1]


@query
def pause_blocks(spark: SparkSession, d: str) -> DataFrame:
    """The whole signal of every recording as one region."""
    fr = fx.frames(spark, d)
    whole = fx.totals(fr).select("rec_id", F.lit(0).cast("long").alias("region_no"), F.lit(0).cast("long").alias("f0"), F.col("total").alias("f1"))
    return signal.pause_blocks(fr, whole)


def _gated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    fr, regions = _regions(spark, d)
    return fx.totals(fr), regions.withColumnRenamed("region_no", "block_no")


@query
def gated_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Regions cut at pauses: the file path's blocks."""
    fr, regions = _regions(spark, d)
    return signal.pause_blocks(fr, regions, least=2)


@query
def skipped_ranges(spark: SparkSession, d: str) -> DataFrame:
    total, blocks = _gated(spark, d)
    return signal.skipped_ranges(blocks, total)


@query
def speech_totals(spark: SparkSession, d: str) -> DataFrame:
    total, blocks = _gated(spark, d)
    return signal.speech_totals(blocks, total)


@query
def empty_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Every third region gave words."""
    _, blocks = _gated(spark, d)
    return signal.empty_blocks(blocks, blocks.where("block_no % 3 = 0"))


@query
def progress_sample(spark: SparkSession, d: str) -> DataFrame:
    _, blocks = _gated(spark, d)
    return signal.progress_sample(blocks.select("rec_id", F.col("block_no").alias("step")))


@query
def punct_chunks(spark: SparkSession, d: str) -> DataFrame:
    got = punctuate.chunks(fx.docs_words(spark, d))
    return got.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.size("toks").cast("long").alias("n"), F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), F.col("toks")[0].alias("first_tok"))


@query
def punct_guard(spark: SparkSession, d: str) -> DataFrame:
    """A tagger that breaks words is refused, chunk by chunk."""
    got = punctuate.guarded(models.tag_chunks(punctuate.chunks(fx.docs_words(spark, d)), models.violating))
    return got.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), "refused")


@query
def punct_guard_split(spark: SparkSession, d: str) -> DataFrame:
    """A tagger that detaches a comma keeps the words and is refused by their count."""
    got = punctuate.guarded(models.tag_chunks(punctuate.chunks(fx.docs_words(spark, d)), models.splitting))
    return got.groupBy("doc_id").agg(F.sum(F.col("refused").cast("long")).alias("refused"), F.count(F.lit(1)).alias("chunks"))


@query
def restore_text(spark: SparkSession, d: str) -> DataFrame:
    return punctuate.restore(fx.docs_words(spark, d), models.identity)


@query
def positional_zip(spark: SparkSession, d: str) -> DataFrame:
    """Upper-cased words by position; every fourth recording lost a word and keeps its own."""
    w = fx.words(spark, d).select("rec_id", "idx", "w")
    toks = F.transform(F.array_sort(F.collect_list(F.struct("idx", "w"))), lambda x: F.upper(x["w"]))
    tagged = w.where("rec_id % 4 <> 1 or idx <> 0").groupBy("rec_id").agg(toks.alias("toks"))
    return words.zip_if_equal(w, tagged)


@query
def sentence_cased(spark: SparkSession, d: str) -> DataFrame:
    doc = fx.table(spark, d, "documents")
    return doc.select("doc_id", sentence_case(F.lower(collapse(F.col("text")))).alias("text"))


@query
def word_functions(spark: SparkSession, d: str) -> DataFrame:
    """Scalar functions over every distinct word."""
    w = fx.words(spark, d).select("w").distinct()
    return w.select("w", agreement_key(F.col("w")).alias("key"), ends_sentence(F.col("w")).alias("ends"), F.char_length("w").cast("long").alias("n"))


@query
def time_functions(spark: SparkSession, d: str) -> DataFrame:
    w = fx.words(spark, d)
    budget = token_budget((F.col("end_ms") - F.col("start_ms")) / 1000)
    name = F.concat(F.lit("out/rec."), F.col("rec_id").cast("string"), F.lit("k.wav"))
    return w.select("rec_id", "idx", stamp(F.col("start_ms")).alias("dot"), stamp(F.col("start_ms"), True).alias("comma"), minute_stamp(F.col("start_ms")).alias("minute"), budget.cast("long").alias("budget"), output_name(stem(name), "srt").alias("name"))


@query
def wrapped_turns(spark: SparkSession, d: str) -> DataFrame:
    conv = fx.table(spark, d, "conversations")
    return conv.select("conv_id", "turn", F.array_join(wrap_two(tokens(F.col("text"))), "\n").alias("two"), nonempty_join(F.split("text", r"\.")).alias("parts"))


@query
def screen_text(spark: SparkSession, d: str) -> DataFrame:
    conv = fx.table(spark, d, "conversations")
    return conv.select("conv_id", "turn", F.array_join(screen_lines(tokens(F.col("text"))), "\n").alias("screen"))


@query
def common_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Words on which a hypothesis and the next one, both cut to the later start, agree; a row for every pair, 0 beside a silent step."""
    h = fx.hypotheses(fx.words(spark, d)).select("stream_id", "step", F.transform("hyp", lambda x: x["w"]).alias("ws"), F.transform("hyp", lambda x: x["start_ms"]).alias("at"))
    by = Window.partitionBy("stream_id").orderBy("step")
    got = h.select("stream_id", "step", "ws", "at", F.lead("ws").over(by).alias("after"), F.lead("at").over(by).alias("after_at")).where("after is not null")
    got = got.withColumn("t", F.greatest(F.get("at", F.lit(0)), F.get("after_at", F.lit(0))))
    # Starts ascend, so the words to drop are the first ones.
    rest = lambda ws, at: F.slice(ws, F.size(F.filter(at, lambda x: x < F.col("t"))) + 1, F.greatest(F.size(ws), F.lit(1)))
    got = got.select("stream_id", "step", rest("ws", F.col("at")).alias("a"), rest("after", F.col("after_at")).alias("b"))
    return got.select("stream_id", "step", agreement.common_prefix(F.col("a"), F.col("b")).cast("long").alias("n"))


@query
def local_agreement(spark: SparkSession, d: str) -> DataFrame:
    return agreement.committed_log(fx.hypotheses(fx.words(spark, d))).select("stream_id", "seq", "w", "start_ms", "end_ms", "lag_ms", "forced")


@query
def commit_lag_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return agreement.lag_percentiles(agreement.committed_log(fx.hypotheses(fx.words(spark, d))))


def _stream(spark: SparkSession, rows: DataFrame, columns: str, run) -> DataFrame:
    """``rows`` written in files that mix streams and steps, replayed one file a micro-batch through ``run``, until nothing is left."""
    from ..streaming import captions

    captions.use_rocksdb(spark)
    folder = f"{shared_dir(spark)}/captions-{uuid.uuid4().hex}"
    # Steps are dealt at random over files: order is the operator's business.
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("stream_id", "step"), F.lit(3)))
    dealt.repartitionByRange(3, "part").drop("part").select(*(c.split()[0] for c in re.sub("<.*?>", "", columns).split(", "))).write.parquet(f"{folder}/in")
    return captions.run_available(run(captions.replay(spark, f"{folder}/in", schema=columns)), f"{folder}/out", f"{folder}/checkpoint")


@query
def stream_captions(spark: SparkSession, d: str) -> DataFrame:
    """The captions stream over the same hypotheses; its log must be the batch form's."""
    from ..streaming import captions

    got = _stream(spark, fx.hypotheses(fx.words(spark, d)), captions.HYPOTHESES, lambda rows: captions.captions(rows, window_ms=None))
    return got.where("kind = 'stable'").select("stream_id", "seq", "w", "start_ms", "end_ms", "lag_ms", "forced")


def _live(spark: SparkSession, d: str) -> DataFrame:
    """Chunks to captions: steps, silence, window, agreement, marks and screen in one stateful operator."""
    from ..streaming import captions, live

    return _stream(spark, fx.chunks(fx.words(spark, d)), captions.CHUNKS, lambda rows: captions.live_captions(rows, live.wavering, models.sentence_case_tagger, window_ms=6000))


@query
def stream_captions_full(spark: SparkSession, d: str) -> DataFrame:
    """The log of the live captions."""
    return _live(spark, d).where("kind = 'stable'").select("stream_id", "seq", "w", "start_ms", "end_ms", "lag_ms", "forced")


@query
def stream_screen(spark: SparkSession, d: str) -> DataFrame:
    """What the live captions leave behind: the text with its marks, the last screen, the steps of silence that were dropped."""
    got = _live(spark, d).where("kind in ('frozen', 'screen', 'skipped')")
    last = lambda kind: F.max_by(F.when(F.col("kind") == kind, F.col("text")), F.when(F.col("kind") == kind, F.col("step")))
    parts = F.array_sort(F.collect_list(F.when(F.col("kind") == "frozen", F.struct("step", "text"))))
    return got.groupBy("stream_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), " ").alias("text"), last("screen").alias("screen"), last("skipped").cast("long").alias("skipped"))
