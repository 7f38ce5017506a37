"""Time stamps and file names, from integer milliseconds."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def stamp(ms: Column, comma: bool = False) -> Column:
    """HH:MM:SS.mmm; a full minute carries, so seconds never read 60."""
    part = lambda n, k: (F.floor(ms / n) % k).cast("int")
    hours = F.floor(ms / 3600000).cast("int")
    return F.format_string("%02d:%02d:%02d" + (",%03d" if comma else ".%03d"), hours, part(60000, 60), part(1000, 60), (ms % 1000).cast("int"))


def minute_stamp(ms: Column) -> Column:
    """[mm:ss], truncated; minutes may pass 59."""
    return F.format_string("[%02d:%02d]", F.floor(ms / 60000).cast("int"), (F.floor(ms / 1000) % 60).cast("int"))


def output_name(base: Column, ext: str) -> Column:
    """The extension is appended: rec.16k becomes rec.16k.txt."""
    return F.concat(base, F.lit("." + ext))


def stem(path: Column) -> Column:
    """File name without directory and last extension."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
