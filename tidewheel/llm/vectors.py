"""Embedding near-deduplication by product quantisation.

Coarse inverted lists hold each vector's residual as subspace codes.  A list is a
cell of a product of small quantisers, so the number of lists grows with the
table while the index stays small.  A query probes every list whose border lies
within a width of it; the width is measured, on the links that a fixed number of
vectors have among all rows.  A query ranks a list's members by table-lookup
inner products, keeps those whose distance to their own code leaves the
threshold possible, and verifies the rest by exact cosine in double precision.
Equal vectors are one class with a count throughout.  A vector travels once to
its own list and once to each list it probes; long lists are dealt in blocks,
and a block returns link counts and a spanning forest of its links, never the
pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .graph import connected_components
from .store import Workspace

#: Classes per coarse list, on average over the largest label.
PER_LIST = 2048
#: Most centroids of one coarse quantiser; more lists take a product of several.
CENTROIDS = 256
#: Classes the index is trained on, classes whose links set the probe width, and lengths of vectors that have an index.
SAMPLE, ASKED, LENGTHS = 16384, 512, 16
#: The width is that of the widest link measured, times this; from fewer links than that nothing is concluded.
SAFETY, EVIDENCE = 1.5, 1000
#: List members and queries that one task compares, and rows of the matrices it does so by.
MEMBERS, QUERIES, BLOCK = 4096, 8192, 512


@dataclass
class Index:
    """Coarse quantisers (start, end, centroids) of parts of a vector, whose product are the lists, and residual codebooks."""

    coarse: list[tuple[int, int, np.ndarray]]
    cuts: list[tuple[int, int]]
    books: list[np.ndarray]

    @property
    def lists(self) -> int:
        return int(np.prod([len(c) for _, _, c in self.coarse]))

    def split(self, cell: np.ndarray) -> list[np.ndarray]:
        """Centroid of each part in a list's number."""
        out = []
        for _, _, c in self.coarse:
            cell, part = np.divmod(cell, len(c))
            out.append(part)
        return out

    def join(self, parts: list) -> np.ndarray:
        cell = 0
        for (_, _, c), part in zip(reversed(self.coarse), reversed(parts), strict=True):
            cell = cell * len(c) + part
        return cell

    def centre(self, cell: np.ndarray) -> np.ndarray:
        return np.concatenate([c[part] for (_, _, c), part in zip(self.coarse, self.split(np.asarray(cell)), strict=True)], axis=-1)


def lloyd(x: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """k-means centroids; empty ones keep their place."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=k)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def train(sample: np.ndarray, n: int) -> Index:
    """An index from a bounded sample of unit vectors; ``n`` is the largest number that share the lists."""
    d, cells = sample.shape[1], max(1.0, n / PER_LIST)
    parts = min(d, max(1, int(np.ceil(np.log(cells) / np.log(CENTROIDS) - 1e-9))))
    k = int(max(1, min(round(cells ** (1 / parts)), len(sample) // 16 or 1)))
    bounds = np.linspace(0, d, parts + 1).round().astype(int)
    coarse = [(int(a), int(b), lloyd(sample[:, a:b], k)) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    ix = Index(coarse, [], [])
    rest = sample - ix.centre(homes(ix, sample)[0])
    edges = np.linspace(0, d, (d + 3) // 4 + 1).round().astype(int)
    ix.cuts = [(int(a), int(b)) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]
    ix.books = [lloyd(rest[:, a:b], min(64, len(rest)), 6) for a, b in ix.cuts]
    return ix


def whole(d: int) -> Index:
    """An index of one list that knows nothing: every member stays possible and is verified."""
    return Index([(0, d, np.zeros((1, d)))], [], [])


def homes(ix: Index, u: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Home list of unit vectors, and in each part the distance to the border of every centroid's cell."""
    own, borders = [], []
    for a, b, c in ix.coarse:
        d2 = (c * c).sum(1) - 2 * u[:, a:b] @ c.T
        home = np.argmin(d2, axis=1)
        gap = np.sqrt(np.maximum((c * c).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2 * c @ c.T, 1e-18))[home]
        border = (d2 - d2[np.arange(len(u)), home][:, None]) / (2 * gap)
        border[np.arange(len(u)), home] = 0.0
        own.append(home)
        borders.append(border)
    return ix.join(own), borders


def encode(ix: Index, u: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
    """Home list, codes, distance to the coded vector and lists to probe of unit vectors."""
    home, borders = homes(ix, u)
    rest = u - ix.centre(home)
    codes, err = np.zeros((len(u), max(1, len(ix.cuts))), np.uint8), np.zeros(len(u))
    for m, (a, b) in enumerate(ix.cuts):
        book, part = ix.books[m], rest[:, a:b]
        codes[:, m] = np.argmin((book * book).sum(1) - 2 * part @ book.T, axis=1)
        err += ((part - book[codes[:, m]]) ** 2).sum(1)
    if not ix.cuts:
        err += 4.0
    near = [[np.flatnonzero(row) for row in border <= width + 1e-9] for border in borders]
    probes = [sorted(int(ix.join(list(p))) for p in product(*row)) for row in zip(*near, strict=True)]
    return home, codes, np.sqrt(err), probes


def lossless(ix: Index, radius: float) -> float:
    """A width that no link is beyond: its ends lie on either side of a border, so one is within half its length; with several borders within all of it."""
    return radius / 2 if len(ix.coarse) == 1 else radius


def reach(ix: Index, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each pair of unit vectors the least width at which one end probes the other's list."""
    (ha, da), (hb, db) = homes(ix, a), homes(ix, b)
    row = np.arange(len(a))
    there = [d[row, part] for d, part in zip(da, ix.split(hb), strict=True)]
    back = [d[row, part] for d, part in zip(db, ix.split(ha), strict=True)]
    return np.minimum(np.max(there, axis=0), np.max(back, axis=0))


def _pack(x: np.ndarray) -> list[bytes]:
    """Rows as bytes, in single precision where that loses nothing."""
    f = x.astype(np.float32)
    return [(a if np.array_equal(a.astype(np.float64), b) else b).tobytes() for a, b in zip(f, x, strict=True)]


def _unpack(rows: list[bytes], dim: int) -> np.ndarray:
    """Unit vectors in double precision."""
    x = np.stack([np.frombuffer(r, np.float32 if len(r) == 4 * dim else np.float64).astype(np.float64) for r in rows])
    return x / np.linalg.norm(x, axis=1)[:, None]


def block_links(ix: Index, cell: int, q: np.ndarray, q_id: np.ndarray, q_n: np.ndarray, q_home: np.ndarray, v: np.ndarray, v_id: np.ndarray, v_n: np.ndarray, v_probes: list[list[int]], codes: np.ndarray, err: np.ndarray, least: float) -> list[tuple[int, int | None, int]]:
    """Links between a block of queries and one of list members: (id, null, weight) counts and (id, root, 0) forest edges."""
    guess = np.repeat((q @ ix.centre(cell))[:, None], len(v), axis=1)
    for m, (a, b) in enumerate(ix.cuts):
        guess += (q[:, a:b] @ ix.books[m].T)[:, codes[:, m]]
    # The coded vector is within ``err`` of the true one, so nothing over the threshold is lost here.
    can = guess + err[None, :] >= least - 1e-6
    # A pair that both ends find counts where the lower id asks.
    kinds, at = np.unique(q_home, return_inverse=True)
    asked = np.zeros((len(v), len(kinds)), bool)
    flat = np.fromiter((x for p in v_probes for x in p), np.int64)
    spot = np.minimum(np.searchsorted(kinds, flat), len(kinds) - 1)
    hit = kinds[spot] == flat
    asked[np.repeat(np.arange(len(v)), [len(p) for p in v_probes])[hit], spot[hit]] = True
    can &= (q_id[:, None] < v_id[None, :]) | ((q_home != cell)[:, None] & ~asked[:, at].T)
    if not can.any():
        return []
    if can.mean() > 0.1:
        links = can & (q @ v.T >= least)
    else:
        i, j = np.nonzero(can)
        links = np.zeros_like(can)
        links[i, j] = np.einsum("ij,ij->i", q[i], v[j]) >= least
    out: list[tuple[int, int | None, int]] = []
    for ids, n in ((q_id, links @ v_n), (v_id, q_n @ links)):
        out += [(int(ids[k]), None, int(n[k])) for k in np.flatnonzero(n)]
    big = np.iinfo(np.int64).max
    qi, vi = np.flatnonzero(links.any(1)), np.flatnonzero(links.any(0))
    sub, root_q, root_v = links[np.ix_(qi, vi)], q_id[qi].copy(), v_id[vi].copy()
    while len(qi):
        new_v = np.minimum(root_v, np.where(sub, root_q[:, None], big).min(0))
        new_q = np.minimum(root_q, np.where(sub, new_v[None, :], big).min(1))
        if (new_v == root_v).all() and (new_q == root_q).all():
            break
        root_q, root_v = new_q, new_v
    for ids, roots in ((q_id[qi], root_q), (v_id[vi], root_v)):
        out += [(int(a), int(r), 0) for a, r in zip(ids, roots, strict=True) if a != r]
    return out


def near_duplicates(vectors: DataFrame, ws: Workspace, least: float = 0.93) -> DataFrame:
    """One row per row of ``vectors``: vec_id, n_links, component_id, kept.

    Vectors link when their labels are equal and not null and their cosine is at
    least ``least``; vectors of unlike length never do.  A vector that is null,
    empty, zero or holds null or non-finite components, one without label and one
    without vec_id links with nothing: n_links 0, component_id its own vec_id.
    Copies of one vector link with each other, repeated rows included.  An empty
    table gives an empty result; further columns are ignored.  The index is
    fitted on at most ``SAMPLE`` rows, smallest seeded hash first, of each of the
    ``LENGTHS`` most frequent lengths of vectors; every row is indexed, those of
    other lengths in one list of their label, whose members are all verified.
    The probe width is ``SAFETY`` times that of the widest of all links of
    ``ASKED`` rows, and never more than loses no link at all.
    """
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("embedding") > 0)
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", "label")
    key = ["label", "embedding"]
    classes = rows.where(good & fine).groupBy(*key).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("cnt"))
    classes = ws.save(classes.withColumn("dim", F.size("embedding")), "classes")
    radius = float(np.sqrt(max(0.0, 2 - 2 * least)))
    index = {d: (ix, probe_width(classes, d, ix, radius, least)) for d, ix in fit(classes).items()}

    def known(d: int) -> tuple[Index, float]:
        return index[d] if d in index else (whole(d), 0.0)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rep", "cnt", "label", "dim", "raw", "cell", "codes", "err", "probes"]
        for b in batches:
            dims = b.column(3).to_numpy(zero_copy_only=False)
            for d in np.unique(dims):
                part = b.take(pa.array(np.flatnonzero(dims == d)))
                x = np.array(part.column(4).to_pylist(), np.float64)
                ix, width = known(int(d))
                home, codes, err, probes = encode(ix, x / np.linalg.norm(x, axis=1)[:, None], width)
                made = [pa.array(_pack(x), pa.binary()), pa.array(home.astype(np.int64)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err), pa.array(probes, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], *made], names)

    kind = dict(classes.dtypes)["label"]
    placed = classes.select("rep", "cnt", "label", "dim", "embedding").mapInArrow(place, f"rep long, cnt long, label {kind}, dim int, raw binary, cell long, codes binary, err double, probes array<long>")
    placed = ws.save(placed, "placed")
    at = ["label", "dim", "cell"]
    asks = placed.select("label", "dim", F.explode("probes").alias("cell"))
    sizes = placed.groupBy(*at).agg(F.count(F.lit(1)).alias("members")).join(asks.groupBy(*at).agg(F.count(F.lit(1)).alias("queries")), at)
    sizes = ws.save(sizes.select(*at, F.ceil(F.col("members") / MEMBERS).cast("int").alias("vb"), F.ceil(F.col("queries") / QUERIES).cast("int").alias("qb")), "sizes")
    own = F.xxhash64("rep", "cell")
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    held = ["rep", "cnt", *at, "raw"]
    members = placed.join(sizes, at).select(*held, F.lit(None).cast("long").alias("home"), "probes", "codes", "err", F.pmod(own, "vb").cast("int").alias("v"), spread(F.col("qb")).alias("q"), F.lit(False).alias("asks"))
    queries = placed.withColumns({"home": F.col("cell"), "cell": F.explode("probes")}).join(sizes, at)
    queries = queries.select(*held, "home", F.lit(None).cast("array<long>").alias("probes"), F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("err"), spread(F.col("vb")).alias("v"), F.pmod(own, "qb").cast("int").alias("q"), F.lit(True).alias("asks"))

    def meet(table: pa.Table) -> pa.Table:
        who = table.column("asks").to_numpy(zero_copy_only=False)
        q, v = table.filter(pa.array(who)), table.filter(pa.array(~who))
        out: list = []
        if len(q) and len(v):
            dim, cell = table.column("dim")[0].as_py(), table.column("cell")[0].as_py()
            ix = known(dim)[0]
            for t in (v.slice(i, BLOCK) for i in range(0, len(v), BLOCK)):
                codes = np.stack([np.frombuffer(c, np.uint8) for c in t.column("codes").to_pylist()])
                side = (_unpack(t.column("raw").to_pylist(), dim), t.column("rep").to_numpy(), t.column("cnt").to_numpy(), t.column("probes").to_pylist(), codes, t.column("err").to_numpy())
                for r in (q.slice(i, BLOCK) for i in range(0, len(q), BLOCK)):
                    ask = (_unpack(r.column("raw").to_pylist(), dim), r.column("rep").to_numpy(), r.column("cnt").to_numpy(), r.column("home").to_numpy())
                    out += block_links(ix, cell, *ask, *side, least)
        total: dict[int, int] = {}
        for a, b, n in out:
            if b is None:
                total[a] = total.get(a, 0) + n
        rows = [(a, b, 0) for a, b in dict.fromkeys((a, b) for a, b, _ in out if b is not None)] + [(a, None, n) for a, n in total.items()]
        cols = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "n"])

    met = members.unionByName(queries).groupBy(*at, "v", "q").applyInArrow(meet, "a long, b long, n long")
    met = ws.save(met, "met")
    comp = connected_components(met.where("b is not null"), ws)
    links = ws.save(met.groupBy("a").agg(F.sum("n").alias("links")), "links")
    result = classes.join(links, F.col("rep") == F.col("a"), "left").join(comp, F.col("rep") == F.col("id"), "left")
    result = ws.save(result.select(*key, (F.coalesce("links", F.lit(0)) + F.col("cnt") - 1).alias("links"), F.coalesce("component", "rep").alias("component")), "result")
    out = rows.where(F.col("vec_id").isNotNull()).join(result, key, "left")
    out = out.unionByName(rows.where("vec_id is null"), allowMissingColumns=True)
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def fit(classes: DataFrame) -> dict[int, Index]:
    """An index for each of the ``LENGTHS`` most frequent lengths of vectors, from at most ``SAMPLE`` classes of each."""
    each = classes.groupBy("dim", "label").count().groupBy("dim").agg(F.max("count").alias("most"), F.sum("count").alias("n"))
    out = {}
    for d, most, n in each.orderBy(F.desc("n"), "dim").limit(LENGTHS).collect():
        x = np.array([r["embedding"] for r in _some(classes, d, n, SAMPLE, 3)], np.float64)
        out[d] = train(x / np.linalg.norm(x, axis=1)[:, None], most)
    return out


def _some(classes: DataFrame, d: int, n: int, want: int, seed: int) -> list:
    """At most ``want`` of ``n`` classes: the smallest hashes are a fixed sample; a threshold keeps the sort to little more than it."""
    h = F.pmod(F.xxhash64("rep", F.lit(seed)), F.lit(1 << 30))
    few = classes.where((F.col("dim") == d) & (h <= (1 << 30) * min(1.0, 1.5 * want / n)))
    return few.orderBy(h, "rep").limit(want).select("rep", "label", "embedding").collect()


def probe_width(classes: DataFrame, d: int, ix: Index, radius: float, least: float) -> float:
    """How far from a border lists are still probed, from all links of ``ASKED`` classes.

    Those few travel to all classes, which are read once; per batch only the
    widest link and a count come back.
    """
    if ix.lists == 1:
        return 0.0
    mine = classes.where(F.col("dim") == d)
    asked = _some(classes, d, mine.count(), ASKED, 4)
    s = np.array([r["embedding"] for r in asked], np.float64)
    s /= np.linalg.norm(s, axis=1)[:, None]
    s_id = np.array([r["rep"] for r in asked])
    s_label = [r["label"] for r in asked]
    names = {x: i for i, x in enumerate(dict.fromkeys(s_label))}
    s_kind = np.array([names[x] for x in s_label])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column(2).to_pylist(), np.float64)
            u = x / np.linalg.norm(x, axis=1)[:, None]
            kind = np.array([names.get(k, -1) for k in b.column(1).to_pylist()])
            i, j = np.nonzero((u @ s.T >= least) & (kind[:, None] == s_kind) & (b.column(0).to_numpy()[:, None] != s_id))
            far = float(reach(ix, u[i], s[j]).max()) if len(i) else 0.0
            yield pa.RecordBatch.from_arrays([pa.array([far]), pa.array([len(i)], pa.int64())], ["far", "n"])

    far, n = mine.select("rep", "label", "embedding").mapInArrow(measure, "far double, n long").agg(F.max("far"), F.sum("n")).first()
    most = lossless(ix, radius)
    return most if (n or 0) < EVIDENCE else min(most, SAFETY * far + 1e-6)
