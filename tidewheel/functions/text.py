"""Scalar functions on words and texts."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F

# The marks that don't count when words are compared.
MARKS = ".,!?;:…\"'()–—-„“«»"
#: White space as Python's split sees it.
SPACES = r"(?U)[\s\x1c-\x1f]+"
# Letters that sentence case raises.
LOWER = "abcdefghijklmnopqrstuvwxyząčęėįšųūž"
#: Up to a sentence mark and the white space behind it, however much, before the next word.
SENTENCES = r"(?s).*?[.!?]\s+(?=\S)"


def agreement_key(word: Column) -> Column:
    """Word without case and surrounding marks; empty for a mark alone."""
    return F.btrim(F.lower(F.btrim(F.regexp_replace(word, rf"^{SPACES}|{SPACES}$", ""))), F.lit(MARKS))


def tokens(text: Column) -> Column:
    """Words of a text, split at white space of any kind."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda x: x != "")


def collapse(text: Column) -> Column:
    """White space as single spaces, trimmed."""
    return F.array_join(tokens(text), " ")


def cores(text: str) -> list[str]:
    """Words as the guard compares them: no marks, no case, composed characters."""
    found = (w.strip(MARKS) for w in text.split())
    return [unicodedata.normalize("NFC", w.lower()) for w in found if w]


def same_cores(a: Column, b: Column) -> Column:
    """Whether two texts have the same ``cores``: Spark has no Unicode normalisation of its own."""

    @F.pandas_udf("boolean")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([cores(p or "") == cores(q or "") for p, q in zip(x, y, strict=True)], dtype=bool)

    return run(a, b)


def core_count(words: Column) -> Column:
    """How many words are more than marks."""
    return F.size(F.filter(words, lambda w: F.btrim(w, F.lit(MARKS)) != "")).cast("long")


def screen_step(lines: list[str], cur: str, word: str, width: int = 42, last: int = 2) -> tuple[list[str], str]:
    """``screen_lines`` word by word: the lines that are full, the last ones of them, and the open one."""
    if len(cur) + len(word) + 1 > width:
        return [*lines, cur][-last:], word
    return lines, f"{cur} {word}" if cur else word


def sentence_case(text: Column) -> Column:
    """First letter of the text and of each sentence raised; no mark is added.

    The text is cut behind each sentence mark and its white space, so each piece
    begins where a sentence does.
    """
    pieces = F.regexp_extract_all(text, F.lit(SENTENCES + r"|.+\z"), F.lit(0))
    first = lambda x: F.substring(x, 1, 1)
    raised = F.transform(pieces, lambda x: F.when(first(x).rlike(f"^[{LOWER}]"), F.concat(F.upper(first(x)), F.substring(x, 2, 2**30))).otherwise(x))
    return F.array_join(raised, "")


def ends_sentence(word: Column) -> Column:
    return F.coalesce(F.right(word, F.lit(1)).isin(".", "!", "?", "…"), F.lit(False))


def wrap_two(words: Column, width: int = 42) -> Column:
    """At most two lines: the longest start within ``width`` (one word at least), then all the rest."""
    n = F.size(words)
    start = F.struct(F.lit(0).alias("k"), F.lit(0).alias("size"), F.lit(True).alias("open"))

    def step(s: Column, w: Column) -> Column:
        size = s["size"] + F.char_length(w) + F.when(s["k"] > 0, 1).otherwise(0)
        fits = F.coalesce(s["open"] & ((s["k"] == 0) | (size <= width)), F.lit(False))
        return F.struct((s["k"] + fits.cast("int")).alias("k"), size.alias("size"), fits.alias("open"))

    # One pass with a running length; the first word that doesn't fit closes the line.
    k = F.aggregate(words, start, step)["k"]
    one = F.array(F.array_join(words, " "))
    two = F.array(F.array_join(F.slice(words, F.lit(1), k), " "), F.array_join(F.slice(words, k + 1, F.greatest(n - k, F.lit(0))), " "))
    return F.when(n == 0, F.array().cast("array<string>")).when(k >= n, one).otherwise(two)


def screen_lines(words: Column, width: int = 42, last: int = 2) -> Column:
    """Greedy lines of ``width``, the last ones; a first word of full width leaves an empty line before it."""
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("cur"))

    def step(s: Column, w: Column) -> Column:
        full = F.char_length(s["cur"]) + F.char_length(w) + 1 > width
        lines = F.when(full, F.array_append(s["lines"], s["cur"])).otherwise(s["lines"])
        # Only the tail is ever shown, so only the tail is carried.
        lines = F.when(F.size(lines) > last, F.slice(lines, -last, last)).otherwise(lines)
        return F.struct(lines.alias("lines"), F.when(full, w).when(s["cur"] == "", w).otherwise(F.concat_ws(" ", s["cur"], w)).alias("cur"))

    done = F.aggregate(words, start, step)
    lines = F.when(done["cur"] != "", F.array_append(done["lines"], done["cur"])).otherwise(done["lines"])
    return F.when(F.size(lines) > last, F.slice(lines, -last, last)).otherwise(lines)


def token_budget(secs: Column) -> Column:
    """Most tokens a decode of so many seconds may give."""
    return F.least(F.lit(400), F.floor(secs * 8).cast("int") + 16)


def nonempty_join(segments: Column) -> Column:
    """Segments of a tagger, trimmed, empty ones left out, as one text."""
    return F.array_join(F.filter(F.transform(segments, lambda x: F.trim(x)), lambda x: x != ""), " ")


def sentence_case_py(text: str) -> str:
    """``sentence_case`` for one text, as taggers use it."""
    return "".join(p[:1].upper() + p[1:] if p[:1] and p[0] in LOWER else p for p in re.findall(SENTENCES + r"|.+\Z", text))
