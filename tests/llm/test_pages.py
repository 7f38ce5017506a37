import pytest
from pyspark.sql import functions as F

from tidewheel.llm import html_text as h, licenses, urls, web
from tidewheel.llm.store import Workspace

PAGE = """<!DOCTYPE html><html><head><title>t{0}</title><style>p{{}}</style><script>var a="</p>";</script></head><body>
<header class="site">Site</header><nav><a href="/{0}">Menu {0}</a></nav><div class="ad-box">buy {0}</div>
<div class="promo-strip"><span>Fixed line</span></div><div id="wrap"><div class="text">
<h1>Title &amp; {0}</h1><p>First <b>bo</b>ld &lt;{0}&gt;<br>next<p>Second   para {0}
<div class="frame"><span>Same on all pages</span></div>
<ul><li>one {0}<li>two</ul></div><form><input><button>Send</button></form>
<div class="comments">Nice {0}</div></div><aside>Side {0}</aside><footer>&copy; {0}</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("template", F.lit("clash"))


def test_wrapper_finds_the_slot_and_the_template(spark):
    rows = [(i, f"http://A.example.org/p{i}?q", PAGE.format(f"n{i}")) for i in range(12)]
    got = {r["page_id"]: r["text"] for r in h.main_text(pages(spark, rows), Workspace(spark, "t")).collect()}
    assert got[3] == "Title & n3 First bold <n3> next Second para n3 one n3 two"


def test_single_page_and_article():
    assert h.extract("<body><nav>x</nav><article><h1>A</h1><p>b&nbsp;c</article><div>rest") == "A b c"
    assert h.extract("just text") == "just text"
    assert h.extract("<nav>menu<article><p>in an open menu</p></article>") == "in an open menu"
    assert h.extract("<form><main><p>framed</p></main></form>") == "framed"


@pytest.mark.parametrize("bad", ["", "<", "<p", "<!--", "<script>x", "</p></div>", "<a href='x>y</a>", "<div>" * 5000 + "deep" + "</div>" * 10, "&#0;&bogus;&#x110000;", "<b>" * 10000])
def test_broken_html_never_fails(bad):
    assert isinstance(h.extract(bad), str)


def test_alignment_is_the_largest_mapping():
    a, b = h.parse("<ul><li>1<li>2<li>3</ul>"), h.parse("<ul><li>2<li>3</ul>")
    h.tidy(a), h.tidy(b)
    al = h.Aligner()
    [(x, y)] = al.pairs(a, b)
    assert [(p.children[0], q.children[0]) for p, q in al.pairs(x, y)] == [("2", "2"), ("3", "3")]


def test_copies_of_one_page_keep_their_text(spark):
    rows = [(i, "http://x.org/", PAGE.format("same")) for i in range(8)]
    got = {r["text"] for r in h.main_text(pages(spark, rows), Workspace(spark, "t")).collect()}
    assert len(got) == 1 and "First bold" in got.pop()


def test_page_edges(spark):
    rows = [(1, None, None), (2, "http://x.org/", ""), (3, "no scheme", "<p>a</p>"), (None, "http://x.org/", "<p>b</p>"), (3, "no scheme", "<p>a</p>"), (4, "http://x.org/l", "<p>" + "word " * 200_000)]
    got = h.main_text(pages(spark, rows), Workspace(spark, "t")).collect()
    assert len(got) == 6 and {r["page_id"]: r["text"] for r in got}[3] == "a"
    assert {r["page_id"]: r["n_chars"] for r in got}[4] == 999_999 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert h.main_text(pages(spark, rows).limit(0), Workspace(spark, "t")).count() == 0


@pytest.mark.parametrize("url, host, path", [(None, "", ""), ("x", "", ""), ("http://A.B", "a.b", ""), ("h://É.X/p?q#f", "É.x", "/p"), ("a://b://c/d", "b:", "//c/d"), ("s://h#x/y", "h", ""), ("s://h\n/p", "h\n", "/p")])
def test_host_and_path(spark, url, host, path):
    r = spark.range(1).select(web.host(F.lit(url)).alias("h"), web.path(F.lit(url)).alias("p")).first()
    assert (r["h"], r["p"]) == (host, path)


def test_rules(spark):
    cases = {"http://a.com/en/1": ("com/en/", "block"), "http://example.com/en/77": ("example.com/en/7", "allow"), "http://com/en/": ("com/en/", "block"), "http://www.example.net/de/81": ("example.net/de/8", "block"), "http://x.net/de/81": ("net/de/", "allow"), "http://notcom/en/": (None, "allow"), "http://a.org/EN/": (None, "allow")}
    rows = [(i, u, None) for i, u in enumerate(cases)]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge(pages(spark, rows), Workspace(spark, "t")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_distrust_reaches_those_who_link_to_it(spark):
    link = lambda *hs: "".join(f'<a href="http://{x}/">x</a>' for x in hs)
    rows = [(i, f"http://bad.com/en/{i}", "") for i in range(9)] + [(20, "http://farm.info/", link("bad.com")), (21, "http://good.info/", link("ok.net")), (22, "http://ok.net/de/1", link("good.info")), (23, "//x", None)]
    got = {r["page_id"]: r for r in urls.judge(pages(spark, rows), Workspace(spark, "t")).collect()}
    assert got[20]["verdict"] == "block" and got[21]["verdict"] == "allow" and got[21]["host_score"] < 0
    assert got[23]["host"] == "x" or got[23]["verdict"] == "allow"


def dense_rank(edges, seeds, damping=0.85):
    """Fixed point by a linear solve; ``edges`` (src, dst, share), ``seeds`` node to weight; nodes without links return to the seeds."""
    import numpy as np

    nodes = sorted({x for a, b, _ in edges for x in (a, b)} | set(seeds))
    at = {x: i for i, x in enumerate(nodes)}
    m, e = np.zeros((len(nodes), len(nodes))), np.zeros(len(nodes))
    for a, b, share in edges:
        m[at[b], at[a]] += share
    for x, w in seeds.items():
        e[at[x]] = w
    for i in range(len(nodes)):
        if m[:, i].sum() == 0:
            m[:, i] = e
    r = np.linalg.solve(np.eye(len(nodes)) - damping * m, (1 - damping) * e)
    return {x: r[at[x]] for x in nodes}


def test_pagerank_equals_dense(spark):
    edges = [("0", "1", 0.5), ("0", "2", 0.5), ("1", "0", 1.0), ("2", "3", 1.0)]
    cycle = [("a", "b", 1.0), ("b", "a", 1.0)]
    seeds = spark.createDataFrame([("t", "0", 1.0), ("d", "a", 1.0)], "kind string, node string, weight double")
    df = spark.createDataFrame([("t", *e) for e in edges] + [("d", *e) for e in cycle], "kind string, src string, dst string, share double")
    got = {(r["kind"], r["node"]): r["rank"] for r in urls.personalised_pagerank(df, seeds, Workspace(spark, "t")).collect()}
    want = {("t", k): v for k, v in dense_rank(edges, {"0": 1.0}).items()} | {("d", k): v for k, v in dense_rank(cycle, {"a": 1.0}).items()}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    assert round(got["d", "a"], 4) == 0.5405


def test_verdicts_of_a_real_graph_equal_brute_force(spark):
    """A spam farm, a hub, dangling hosts and a chain of trust, the whole query by dense algebra."""
    import random
    from collections import Counter

    rng = random.Random(4)
    good, farm, odd = [f"g{i}.info" for i in range(12)], [f"f{i}.biz" for i in range(10)], [f"o{i}.io" for i in range(12)]
    rows, n = [], 0
    for k in range(30):
        rows.append((f"http://bad{k % 3}.com/en/{k}", []))
        rows.append((f"http://ok{k % 3}.net/de/{k}", rng.sample(good, 3) + ["hub.info"]))
    for h_ in farm:
        rows += [(f"http://{h_}/{i}", [f"bad{i % 3}.com", rng.choice(farm)]) for i in range(rng.randrange(1, 4))]
    for h_ in good:
        rows += [(f"http://{h_}/{i}", rng.sample(good + odd, 2)) for i in range(2)]
    rows += [(f"http://hub.info/{i}", rng.sample(good + odd + farm, 8)) for i in range(6)] + [(f"http://{o}/{i}", rng.sample(odd + farm, 1) if i else []) for o in odd for i in range(2)]
    table = [(i, u, "".join(f'<p><a class=x href="https://{x.upper()}/y?z">l</a>' for x in to)) for i, (u, to) in enumerate(rows)]
    got = {r["page_id"]: r for r in urls.judge(pages(spark, table), Workspace(spark, "t")).collect()}
    host = lambda u: u.split("/")[2]
    ruled = {i: "block" if "bad" in u else "allow" if "ok" in u else None for i, (u, _) in enumerate(rows)}
    per = Counter(host(u) for u, _ in rows)
    mass = Counter()
    for verdict, sign in (("allow", -1), ("block", 1)):
        links = Counter((host(u), x) if verdict == "allow" else (x, host(u)) for u, to in rows for x in to if x != host(u))
        out = Counter()
        for (a, _), k in links.items():
            out[a] += k
        own = Counter(host(u) for i, (u, _) in enumerate(rows) if ruled[i] == verdict)
        total = sum(own.values())
        for x, r in dense_rank([(a, b, k / out[a]) for (a, b), k in links.items()], {x: k / total for x, k in own.items()}).items():
            mass[x] += sign * total * r
    for i, (u, _) in enumerate(rows):
        score = mass[host(u)] / per[host(u)]
        assert abs(got[i]["host_score"] - score) < 1e-3
        assert got[i]["verdict"] == (ruled[i] or ("block" if score > 0.5 else "allow"))
    assert len({got[i]["verdict"] for i, (u, _) in enumerate(rows) if host(u) in farm}) == 2 or any(got[i]["verdict"] == "block" for i, (u, _) in enumerate(rows) if host(u) in farm)


def test_url_edges(spark):
    rows = [(1, None, None), (None, "http://x.com/en/", None), (2, "", ""), (2, "", "")]
    got = urls.judge(pages(spark, rows), Workspace(spark, "t")).collect()
    assert len(got) == 4 and {r["verdict"] for r in got if r["page_id"] == 2} == {"allow"}
    assert urls.judge(pages(spark, rows).limit(0), Workspace(spark, "t")).count() == 0


def cosine(passage, templates, passages):
    """Brute force over dense dictionaries."""
    import math
    import re
    from collections import Counter

    tok = lambda t: Counter(re.findall(licenses.TERM, t.lower()))
    units = [set(tok(p)) for p in passages] + [set(tok(t)) for _, t in templates]
    idf = lambda w: math.log((1 + len(units)) / (1 + sum(w in u for u in units))) + 1
    vec = lambda t: {w: n * idf(w) for w, n in tok(t).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    a = vec(passage)
    return max((sum(x * b.get(w, 0) for w, x in a.items()) / norm(a) / norm(b), -i) for i, b in enumerate(vec(t) for _, t in templates))[0]


def passages_of(path, text):
    """Sentences and lines of every paragraph, and a licence file as a whole, by plain string work."""
    import re

    plain = "\n".join(re.sub(r"^[ \t]*(?:/\*+|\*+/?|//+|#+|;+|--+|%+|<!--|-->|(?:REM|rem|dnl)\b)?[ \t]*", "", x) for x in (text or "").split("\n"))
    one = lambda x: " ".join(x.split())
    out = []
    for par in re.split(r"\n\n+", plain):
        out += dict.fromkeys([*re.split(r"(?<=[.!?:]) +(?=[A-Z\"(])", one(par)), *map(one, par.split("\n"))])
    if path and path.rsplit("/", 1)[-1].upper().split(".")[0] in ("LICENSE", "LICENCE", "COPYING", "NOTICE"):
        out.append(one(plain))
    return [x for x in out if re.search(licenses.CUE, x)]


MIT_FILE = """MIT License

Copyright (c) 2021 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""


def wrapped(text, mark, width):
    import textwrap

    return "\n".join(f"{mark}{x}" for x in textwrap.wrap(text, width))


@pytest.mark.parametrize("width", [30, 50, 72])
def test_wrapped_notices_and_licence_files(spark, width):
    pick = lambda name: max((t for k, t in licenses.TEMPLATES if k == name), key=len)
    apache = "Copyright 2020 X. " + " ".join(t for k, t in licenses.TEMPLATES[3:7] if "except" not in t or "Licensed" in t)
    files = {
        "a/mpl.c": "/*\n" + wrapped("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", " * ", width) + "\n */\nint x;",
        "a/gpl.py": wrapped(next(t for k, t in licenses.TEMPLATES if k == "GPL-3.0" and "redistribute" in t), "# ", width) + "\n\nimport os",
        "a/gpl2.js": wrapped(next(t for k, t in licenses.TEMPLATES if k == "GPL-2.0" and "redistribute" in t), "// ", width),
        "a/apache.go": wrapped(apache, "// ", width) + "\n\npackage x",
        "a/bsd.h": wrapped(pick("BSD-3-Clause"), "   ", width),
        "m/LICENSE": MIT_FILE,
        "b/LICENSE.txt": "Copyright (c) 1999, X\nAll rights reserved.\n\n" + wrapped(pick("BSD-3-Clause"), "", width),
        "i/COPYING": "Copyright X\n\n" + wrapped(pick("ISC"), "", width),
        "m/src/deep/x.c": "int y;" + " word" * 30_000,
    }
    df = spark.createDataFrame(list(files.items()), "path string, text string")
    got = {r["path"]: r for r in licenses.scan(df, Workspace(spark, "t")).collect()}
    want = {"a/mpl.c": "MPL-2.0", "a/gpl.py": "GPL-3.0", "a/gpl2.js": "GPL-2.0", "a/apache.go": "Apache-2.0", "a/bsd.h": "BSD-3-Clause", "m/LICENSE": "MIT", "b/LICENSE.txt": "BSD-3-Clause", "i/COPYING": "ISC", "m/src/deep/x.c": "MIT"}
    assert {p: r["license"] for p, r in got.items()} == want
    assert got["m/src/deep/x.c"]["inherited_from"] == "m/LICENSE" and got["a/gpl.py"]["n_headers"] == 1


def test_cue_keeps_what_a_template_would_match():
    """Templates with half of their words lost: how many that are still close hold a cue."""
    import random
    import re

    rng, near, cued = random.Random(5), 0, 0
    for _, t in licenses.TEMPLATES:
        assert re.search(licenses.CUE, t), t
        words = t.split()
        for _ in range(50):
            left = " ".join(w for w in words if rng.random() < 0.5)
            if re.search(licenses.TERM, left.lower()) and cosine(left, licenses.TEMPLATES, [left]) >= licenses.LEAST:
                near, cued = near + 1, cued + bool(re.search(licenses.CUE, left))
    print("cue recall", cued, "of", near)
    assert near > 500 and cued >= 0.9 * near


def test_licences_and_inheritance(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    files = {
        "LICENSE": f"Text.\n{gpl}",
        "lib/a.py": "no words here",
        "lib/x/LICENSE.txt": mit,
        "lib/x/deep/er/b.py": "code\ncode",
        "lib/x/own.py": f"# head\n{gpl}\ncode",
        "lib/near.py": "we licensed a song to the radio yesterday",
        "open/n.md": f"{mit}\nthen prose",
        "open/COPYING": mit,
        "open/sub/p.md": "prose",
    }
    df = spark.createDataFrame([(p, t, "x", "y") for p, t in files.items()] + [(None, mit, "x", "y"), ("z/null", None, "x", "y"), ("z/null", None, "x", "y")], "path string, text string, license string, score string")
    got = licenses.scan(df, Workspace(spark, "t")).collect()
    by = {r["path"]: r for r in got}
    assert len(got) == len(files) + 3
    assert [(by[p]["license"], by[p]["inherited_from"]) for p in files] == [
        ("GPL-3.0", None), ("GPL-3.0", "LICENSE"), ("MIT", None), ("MIT", "lib/x/LICENSE.txt"), ("GPL-3.0", None), ("GPL-3.0", "LICENSE"), ("MIT", None), ("MIT", None), ("MIT", "open/COPYING"),
    ]
    assert by[None]["own_license"] is None and by[None]["license"] is None and by["z/null"]["license"] == "GPL-3.0"
    passages = [p for f, t in [*files.items(), (None, mit)] for p in passages_of(f, t)]
    assert by["lib/x/own.py"]["score"] == pytest.approx(cosine(gpl, licenses.TEMPLATES, passages), abs=1e-6)
    assert licenses.scan(df.limit(0), Workspace(spark, "t")).count() == 0


def test_documents_that_are_licences_license_their_directory(spark, tmp_path):
    """The whole query: a document is a licence file by what it says, not for a notice in it."""
    from tidewheel.llm.registry import QUERIES

    bsd, mit = (next(t for t in licenses.TEXTS if t.startswith(x)) for x in ("Redistribution", "Permission is hereby"))
    gpl = "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n\n Preamble\n\n" + "These words say what the terms are. " * 500
    rows = [
        (1, "src0", "en", "some prose"), (-2, "src0", "en", "MIT License\n\nCopyright (c) 2021 X\n\n" + wrapped(mit, "  ", 60)), (3, "src0", "en", "Prose.\nLicensed under CC BY 4.0."), (4, "src0", "en", None), (5, "src0", "de", "prose"),
        (6, "src1", "en", "prose"), (7, "src1", "en", wrapped(bsd, "", 72)), (8, None, None, "prose"), (9, None, None, gpl), (10, "src2", "en", "Released under the MIT License."), (11, "src2", "en", "prose"),
        (12, "src3", "en", mit + " code" + "".join(f" word{i}" for i in range(200))), (13, "src3", "en", "prose"),
    ]
    spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["license"], r["inherited_from"]) for r in QUERIES["op8_licenses"](spark, str(tmp_path)).collect()}
    at0, at1, at8 = "src0/en/LICENSE.-2.txt", "src1/en/LICENSE.7.txt", "_/_/LICENSE.9.txt"
    assert got == {
        1: ("MIT", at0), -2: ("MIT", None), 3: ("CC-BY-4.0", None), 4: ("MIT", at0), 5: (None, None), 6: ("BSD-2-Clause", at1), 7: ("BSD-2-Clause", None),
        8: ("GPL-3.0", at8), 9: ("GPL-3.0", None), 10: ("MIT", None), 11: (None, None), 12: ("MIT", None), 13: (None, None),
    }


def test_sibling_containers_without_article_all_stay(spark):
    page = "<html><head><title>t</title></head><body><h1>Title {0}</h1><div class=lead>Lead {0} {1}</div><div class=box>Same box</div><div class=text><p>Body {0} {2}</p><p>More {0} {2}</p></div></body></html>"
    html = [page.format(w, f"{w} " * 8, f"{w} " * 20) for w in ("alpha", "beta", "gamma", "delta")]
    df = spark.createDataFrame([(i, f"https://x.example/{i}", p) for i, p in enumerate(html)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in h.main_text(df, Workspace(spark, "t")).collect()}
    for i, w in enumerate(("alpha", "beta", "gamma", "delta")):
        assert got[i] == " ".join(f"Title {w} Lead {w} {f'{w} ' * 8}Body {w} {f'{w} ' * 20}More {w} {f'{w} ' * 20}".split())


# What names can't tell, the template does.
PLAIN = "<html><head><title>t</title></head><body><div class=qa><ul><li><a href='/{0}'>Menu {0}</a><li><a href='/'>Home</a></ul></div><div class=qb>Site name</div><div class=qc>buy {0}</div><div class=qd><h1>Title {0}</h1>{1}<div class=qe><span>Same box</span></div></div><div class=qf>(c) of {0}</div></body></html>"


def plain(w, n):
    return PLAIN.format(w, "".join(f"<p>{w} says {i} things</p>" for i in range(n)))


@pytest.mark.parametrize("n", [20, 1600])
def test_the_template_decides_where_names_say_nothing(spark, n):
    rows = [(i, f"http://plain.org/{i}", plain(w, n)) for i, w in enumerate(("alpha", "beta", "gamma", "delta"))]
    got = {r["page_id"]: r["text"] for r in h.main_text(pages(spark, rows), Workspace(spark, "t")).collect()}
    for i, w in enumerate(("alpha", "beta", "gamma", "delta")):
        assert got[i] == f"Title {w} " + " ".join(f"{w} says {k} things" for k in range(n))
        assert h.extract(rows[i][2]) != got[i] and "Same box" in h.extract(rows[i][2])


def test_every_layout_of_a_host_has_its_template(spark):
    other = "<html><body><section class=za>Another head</section><section class=zb><h2>{0}</h2><p>{0} body of the other kind, and more of {0}</section></body></html>"
    rows = [(i, f"http://two.org/{i}", plain(f"w{i}", 30)) for i in range(400)] + [(1000 + i, f"http://two.org/o{i}", other.format(f"word{i}")) for i in range(3)]
    got = {r["page_id"]: r["text"] for r in h.main_text(pages(spark, rows), Workspace(spark, "t")).collect()}
    assert [got[1000 + i] for i in range(3)] == [f"word{i} word{i} body of the other kind, and more of word{i}" for i in range(3)]
    assert all(got[i].startswith(f"Title w{i} w{i} says 0") and "Same box" not in got[i] for i in range(400))


@pytest.mark.parametrize("html, text", [
    ('<div class="content no-sidebar"><p>Real article text here.</p></div>', "Real article text here."),
    ('<article><div class="post-header"><h1>Title</h1></div><p>Body</article>', "Title Body"),
    ('<article><header><h1>Title</h1></header><p>Body</article><footer>f', "Title Body"),
    ('<a class="skip" href="#x">Skip to content</a><p>Te<span class="ad">Buy now</span>xt', "Text"),
    ("<div>" * 130 + "<nav>MENU</nav><p>text</p>", "text"),
    ("<div>" * 30_000 + "<aside>x</aside>deep" + "</div>" * 10, "deep"),
    ("<p>a <a href=x>b</a> <span class='ad'>c<p>d", "a b d"),
])
def test_names_are_read_for_what_they_say(html, text):
    assert h.extract(html) == text


def test_deep_pages_align():
    page = lambda w: "<div>" * 3000 + f"<p>text {w} and more {w}</p><div>Same</div>"
    got = h.induce([page(w) for w in ("a1", "b2", "c3")])
    assert h.extract(page("d4"), got) == "text d4 and more d4"


def largest_mapping(a, b):
    """Brute force: every order-keeping choice of pairs of children."""
    if isinstance(a, str) or isinstance(b, str):
        return (1.0 if a == b else 0.5) if isinstance(a, str) and isinstance(b, str) else 0.0
    if a.key != b.key:
        return 0.0

    def best(xs, ys):
        if not xs or not ys:
            return 0.0
        return max([best(xs[1:], ys)] + [largest_mapping(xs[0], y) + best(xs[1:], ys[j + 1 :]) for j, y in enumerate(ys)])

    return 1 + best(a.children, b.children)


def test_alignment_equals_brute_force():
    import random

    rng = random.Random(8)

    def tree(depth):
        node = h.Node(k := rng.choice("xy"), k)
        node.children = [rng.choice("pq") if depth == 0 or rng.random() < 0.4 else tree(depth - 1) for _ in range(rng.randrange(4))]
        return node

    for _ in range(300):
        a, b = tree(3), tree(3)
        al = h.Aligner()
        assert al.weight(a, b) == largest_mapping(a, b)
        if a.key == b.key:
            assert 1 + sum(al.weight(x, y) for x, y in al.pairs(a, b)) == al.weight(a, b)


def test_whole_query_without_names_equals_the_article_itself(spark):
    """Pages of the test tables with every telling name taken away: the texts must be those that the names give."""
    import re
    from collections import Counter

    raw = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url", "html").where("html is not null").collect()
    host = lambda u: u.split("://")[1].split("/")[0].split("?")[0]
    many = {k for k, n in Counter(host(r["url"]) for r in raw).items() if n >= 6}
    bare = lambda s: re.sub(r"</(?:article|nav|footer)>", "</div>", re.sub(r"<(article|nav|footer)\b", lambda m: f"<div class=q{m[1][:2]}", s)).replace('class="ad"', 'class="zz"')
    picked = [r for r in raw if host(r["url"]) in many][:800]
    got = {r["page_id"]: r["text"] for r in h.main_text(pages(spark, [(r["page_id"], r["url"], bare(r["html"])) for r in picked]), Workspace(spark, "t")).collect()}
    want = {r["page_id"]: h.extract(re.search(r"(?s)<article>.*</article>", r["html"])[0]) for r in picked if "</article>" in r["html"]}
    assert len(want) > 700 and sum(got[i] == t for i, t in want.items()) >= 0.99 * len(want)
