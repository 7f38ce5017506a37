import random

from llm_cases import TEXTS, documents, empty

from tidewheel.llm import langid

STEMS = {"lt": "žodis labas rytas šuo ąžuolas eina per mišką ir dainuoja", "en": "the word good morning dog oak walks through forest and sings", "de": "das wort guten morgen hund eiche geht durch den wald und singt", "fr": "le mot bonjour matin chien chêne marche dans la forêt et chante"}


def corpus(spark, n=400):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        lang = rng.choice(list(STEMS))
        rows.append((i, " ".join(rng.choice(STEMS[lang].split()) for _ in range(rng.choice([5, 40, 400]))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    df = corpus(spark)
    truth = {r["doc_id"]: r["lang"] for r in df.collect()}
    got = [r for r in langid.identify(df).collect() if r["held_out"]]
    assert len(got) > 40 and sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_training_is_repeatable_and_ignores_held_out_labels(spark):
    df = corpus(spark, 200)
    a = langid.sample_windows(df)
    flipped = df.withColumn("lang", __import__("pyspark").sql.functions.when(langid.held_out(df["doc_id"]), "xx").otherwise(df["lang"]))
    assert a == langid.sample_windows(flipped)
    assert (langid.train(*a).embed == langid.train(*a).embed).all()


def test_gradient_lowers_the_loss():
    parts, labels = [b"aaaa bbbb " * 5, b"cccc dddd " * 5] * 20, ["x", "y"] * 20
    net = langid.train(parts, labels, epochs=10)
    assert langid.predict(net, [parts[0] * 300, parts[1]])[0] == ["x", "y"]


def test_windows_cover_all_bytes():
    raw = bytes(range(256)) * 9
    assert b"".join(langid.windows(raw)) == raw and langid.windows(b"") == []


def test_edges(spark):
    got = langid.identify(documents(spark)).collect()
    assert len(got) == len(TEXTS) + 2
    by = {r["doc_id"]: r for r in got}
    assert {by[i]["lang_pred"] for i in (3, 4, 5, 10)} == {"und"} and by[3]["score"] == 0
    assert by[6]["lang_pred"] == "en" and by[None]["held_out"] is False
    assert langid.identify(empty(spark)).count() == 0
    bare = documents(spark, lost=False).withColumn("lang", __import__("pyspark").sql.functions.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(bare).collect()} == {"und"}


def test_rejects_what_has_no_letters(spark):
    df = documents(spark)
    got = langid.keep_identified(df)
    assert got.columns == df.columns
    assert sorted(r["doc_id"] or 0 for r in got.collect()) == [0, 1, 1, 2, 6, 7, 8, 9, 11]
    assert langid.keep_identified(empty(spark)).count() == 0


def test_doubt_rejects_where_letters_are_enough(spark):
    df = corpus(spark)
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    letters = {i: sum(map(str.isalpha, t)) for i, t in texts.items()}
    net = langid.train(*langid.with_noise(*langid.sample_windows(df)))
    real = [k for k, x in enumerate(net.langs) if x != langid.NOISE]
    sure = {}
    for i, t in texts.items():
        each = [(len(w), float(__import__("numpy").exp(langid.forward(net, langid.matrix([w]))[0, real].max()))) for w in langid.windows(t.encode())]
        sure[i] = sum(n * p for n, p in each) / sum(n for n, _ in each)
    least = sorted(v for i, v in sure.items() if letters[i] >= 30)[40] + 1e-6
    kept = {r["doc_id"] for r in langid.keep_identified(df, least, 30).collect()}
    assert kept == {i for i in texts if letters[i] < 30 or sure[i] >= least}
    assert 0 < len(kept) < len(texts) and any(n < 30 for n in letters.values())


def test_mixed_languages_stay():
    parts, labels = [b"aaaa bbbb " * 50, b"cccc dddd " * 50] * 20, ["x", "y"] * 20
    net = langid.train(parts, labels, epochs=60)
    both = parts[0].ljust(langid.WINDOW) + parts[1].ljust(langid.WINDOW)
    assert langid.predict(net, [both])[1][0] < 0.7 and langid.judge(net, [both])[1][0] > 0.9


def test_the_bound_falls_on_all_languages_alike(spark):
    langs = ["rare"] * 60 + [f"l{i % 7}" for i in range(2100)]
    df = spark.createDataFrame([(i, f"{x} word " * 400, x) for i, x in enumerate(langs)], "doc_id long, text string, lang string")
    _, labels = langid.sample_windows(df, 300, 600)
    assert {x: labels.count(x) for x in set(langs)} == dict.fromkeys(set(langs), 75)


def test_every_label_is_learned(spark):
    rows = [(i, f"x{i % 700} y{i % 700} " * 30, f"l{i % 700}" if i % 700 else "") for i in range(2800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    _, labels = langid.sample_windows(df, 300, 600)
    import zlib

    seen = {x for i, _, x in rows if zlib.crc32(str(i).encode()) % 5}
    assert set(labels) == seen and len(seen) > 690 and "" in labels


def naive(net, raw):
    """The network, window by window, filter by filter, with plain loops: mean log-probabilities weighted by bytes."""
    import numpy as np

    total = np.zeros(len(net.langs))
    for at in range(0, len(raw), langid.WINDOW):
        part = raw[at : at + langid.WINDOW]
        bytes_ = list(part) + [32] * (langid.WINDOW - len(part))
        pooled = []
        for f in range(net.filters.shape[1]):
            best = -np.inf
            for i in range(0, langid.WINDOW - max(langid.WIDTHS) + 1, langid.STRIDE):
                z = sum(float(net.embed[bytes_[i + k]] @ net.filters[k * langid.EMBED : (k + 1) * langid.EMBED, f]) for k in range(langid.WIDTHS[f // langid.FILTERS]))
                best = max(best, z)
            pooled.append(max(best + float(net.bias[f]), 0))
        s = np.array(pooled) @ net.out + net.out_bias
        total += (s - s.max() - np.log(np.exp(s - s.max()).sum())) * len(part)
    return total / len(raw)


def test_whole_query_equals_a_naive_network(spark):
    import numpy as np

    df = corpus(spark, 160)
    net = langid.train(*langid.sample_windows(df))
    got = {r["doc_id"]: r for r in langid.identify(df).collect()}
    for r in df.where("doc_id < 12").collect():
        mean = naive(net, r["text"].encode())
        p = np.exp(mean - mean.max())
        assert got[r["doc_id"]]["lang_pred"] == net.langs[int(mean.argmax())]
        assert abs(got[r["doc_id"]]["score"] - (p / p.sum()).max()) < 1e-4


def test_what_is_no_language_goes(spark):
    import base64

    import numpy as np

    rng = np.random.default_rng(2)
    df = corpus(spark)
    junk = [base64.b64encode(rng.bytes(900)).decode(), rng.bytes(500).hex(), "".join(map(chr, rng.choice(np.arange(0x430, 0x450), 400))), " ".join("".join(map(chr, rng.choice(np.arange(33, 127), 7))) for _ in range(90))]
    both = df.unionByName(spark.createDataFrame([(10_000 + i, t, None) for i, t in enumerate(junk)], df.schema))
    kept = {r["doc_id"] for r in langid.keep_identified(both).collect()}
    assert kept == set(range(400))
