"""Documents for the edge cases that every operator must stand."""

#: Column names that operators use inside, to clash with.
CLASH = ("fp", "rep", "bucket", "part", "whole", "cut", "size", "key", "raw", "h", "n", "component", "shard", "slot", "row", "id", "a", "b", "host", "target", "keep_id", "text_sha256", "grp", "nth", "_sha", "_mix", "_mix_bucket", "_mix_source", "_mix_copies", "_mix_copy", "chance", "copies", "layout", "template", "cell", "dim", "one", "no", "first_sha")
LONG = "žodis word " * 40_000
TEXTS = {
    1: "the quick brown fox jumps over the lazy dog",
    2: "the  quick brown fox jumps over the lazy\tdog",
    3: None,
    4: "",
    5: " \n\t ",
    6: LONG,
    7: LONG + "x",
    8: "one",
    9: "ONE",
    10: "12345 --- 678",
    11: "the quick brown fox jumps over the lazy dog",
}


def documents(spark, texts=None, clash=True, repeat=True, lost=True):
    """Documents with nulls in every column, repeated rows and extra columns."""
    rows = [(i, t, None if i % 4 == 3 else "en", None if i % 3 == 0 else f"src{i % 3}", None if t is None else len(t)) for i, t in (texts or TEXTS).items()]
    if repeat:
        rows.append(rows[0])
    if lost:
        rows.append((None, "a row without id", "en", "src1", 16))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    if clash:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(f"own {c}") for c in CLASH})
    return df


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
