"""Oracle SQL (DuckDB) of the registered queries, written apart from the engine's plans."""

from __future__ import annotations

_WORDS = r"""
wx AS (
    SELECT conv_id AS rec_id, turn, role, unnest(l) AS w, generate_subscripts(l, 1) AS pos
    FROM (SELECT conv_id, turn, role, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') AS l FROM conversations)
),
wi AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY turn, pos) - 1 AS idx FROM wx),
wd AS (
    SELECT *, CASE role WHEN 'user' THEN 0 WHEN 'assistant' THEN 1 ELSE 2 END AS base,
           CASE WHEN idx % 5 = 4 THEN 0 ELSE 40 * length(w) END AS dur,
           CASE WHEN idx = 0 THEN 0 WHEN pos = 1 THEN 700 WHEN idx % 131 = 0 THEN 1600 WHEN idx % 157 = 0 THEN 1300 ELSE 60 END AS gap
    FROM wi
),
words AS (
    SELECT rec_id, turn, idx, w, CAST(base AS INTEGER) AS base,
           CAST(CASE WHEN idx % 389 = 388 THEN NULL WHEN idx % 100 < 30 AND idx % 11 IN (0, 2) THEN (base + 1) % 2 ELSE base END AS INTEGER) AS spk,
           CAST(sum(gap + dur) OVER o - dur AS BIGINT) AS start_ms, CAST(sum(gap + dur) OVER o AS BIGINT) AS end_ms
    FROM wd WINDOW o AS (PARTITION BY rec_id ORDER BY idx)
)"""

_SEGMENTS = """
sg AS (
    SELECT rec_id, turn, min(start_ms) - 100 * (turn % 3) AS a_ms, max(end_ms) + 900 * ((turn + 1) % 2) AS b_ms, min(base) AS spk
    FROM words WHERE turn % 5 <> 3 GROUP BY rec_id, turn
),
segments AS (SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY a_ms, turn) - 1 AS seg_idx, a_ms, b_ms, spk FROM sg)"""

def _turns(words: str) -> str:
    """Turns of any table of words."""
    return f"""
tn AS (
    SELECT *, CASE WHEN lag(idx) OVER o IS NULL OR spk IS DISTINCT FROM lag(spk) OVER o OR start_ms - lag(end_ms) OVER o > 1200 THEN 1 ELSE 0 END AS new
    FROM {words} WINDOW o AS (PARTITION BY rec_id ORDER BY idx)
),
ti AS (SELECT *, sum(new) OVER (PARTITION BY rec_id ORDER BY idx) AS island FROM tn),
tp AS (SELECT *, (row_number() OVER (PARTITION BY rec_id, island ORDER BY idx) - 1) // 110 AS part FROM ti),
tg AS (
    SELECT rec_id, min(idx) AS i0, first(spk ORDER BY idx) AS spk, first(start_ms ORDER BY idx) AS start_ms,
           last(end_ms ORDER BY idx) AS end_ms, count(*) AS n_words, string_agg(w, ' ' ORDER BY idx) AS text
    FROM tp GROUP BY rec_id, island, part
),
turns AS (
    SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY i0) - 1 AS turn_no, spk, start_ms, end_ms, n_words, text FROM tg
)"""


_TURNS = _turns("words")

#: The end of a cue depends on its start alone: the next start of every word, then the chain of starts.
_CUES = """
ca AS (
    SELECT *, length(w) AS len, sum(length(w) + 1) OVER o AS cum, w SIMILAR TO '.*[.!?…]' AS fin,
           lag(spk) OVER o IS DISTINCT FROM spk OR start_ms - lag(end_ms) OVER o > 1500 AS brk
    FROM words WINDOW o AS (PARTITION BY rec_id ORDER BY idx)
),
cb AS (SELECT *, lag(fin) OVER o AS pfin, lag(cum) OVER o AS pcum FROM ca WINDOW o AS (PARTITION BY rec_id ORDER BY idx)),
cx AS (SELECT *, idx + unnest(range(1, 44)) AS j FROM cb),
nx AS MATERIALIZED (
    SELECT a.rec_id, a.idx AS i, min(b.idx) AS j
    FROM cx a JOIN cb b ON a.rec_id = b.rec_id AND b.idx = a.j
    WHERE b.brk OR b.end_ms - a.start_ms > 6000 OR (b.cum - 1) - (a.cum - a.len - 1) > 84
       OR (b.pfin AND (b.pcum - 1) - (a.cum - a.len - 1) > 37.8)
    GROUP BY a.rec_id, a.idx
),
chain AS (
    SELECT rec_id, CAST(0 AS BIGINT) AS i FROM words WHERE idx = 0
    UNION ALL
    SELECT chain.rec_id, nx.j FROM chain JOIN nx ON nx.rec_id = chain.rec_id AND nx.i = chain.i
),
cc AS (SELECT w.*, c.i IS NOT NULL AS starts FROM words w LEFT JOIN chain c ON c.rec_id = w.rec_id AND c.i = w.idx),
cn AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY idx) AS cue_no FROM cc),
cues AS (
    SELECT rec_id, CAST(cue_no AS BIGINT) AS cue_no, first(spk ORDER BY idx) AS spk, first(start_ms ORDER BY idx) AS start_ms,
           last(end_ms ORDER BY idx) AS end_ms, string_agg(w, ' ' ORDER BY idx) AS text, list(w ORDER BY idx) AS ws
    FROM cn GROUP BY rec_id, cue_no
)"""


def _wrapped(ws: str) -> str:
    """Lines of a list of words: the longest start within 42 characters, and the rest."""
    k = f"greatest(1, len(list_filter(range(1, len({ws}) + 1), lambda k: length(array_to_string({ws}[1:k], ' ')) <= 42)))"
    return f"CASE WHEN {k} >= len({ws}) THEN array_to_string({ws}, ' ') ELSE array_to_string({ws}[1:{k}], ' ') || chr(10) || array_to_string({ws}[{k} + 1:], ' ') END"


def _stamp(ms: str, sep: str) -> str:
    return f"printf('%02d:%02d:%02d{sep}%03d', {ms} // 3600000, {ms} // 60000 % 60, {ms} // 1000 % 60, {ms} % 1000)"


def _label(spk: str) -> str:
    return f"CASE WHEN {spk} IS NULL THEN '' ELSE 'Kalbėtojas ' || CAST({spk} + 1 AS VARCHAR) END"


_BODIES = f"""
cl AS (SELECT *, {_wrapped('ws')} AS lines FROM cues),
cw AS (
    SELECT *, CASE WHEN cue_no = 1 OR spk IS DISTINCT FROM lag(spk) OVER (PARTITION BY rec_id ORDER BY cue_no) THEN {_label('spk')} ELSE '' END AS who
    FROM cl
),
bodies AS (
    SELECT *, CASE WHEN who = '' THEN lines WHEN contains(lines, chr(10)) THEN who || ': ' || lines ELSE who || ':' || chr(10) || lines END AS body
    FROM cw
)"""

_FRAMES = """
ev AS (
    SELECT user_id AS rec_id, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS hour, value FROM events
),
sp AS (SELECT min(hour) AS lo, CAST(max(hour) - min(hour) + 1 AS BIGINT) AS n FROM ev),
er AS (SELECT rec_id, hour - (SELECT lo FROM sp) AS frame, sqrt(avg(value * value) + 1e-12) AS rms FROM ev GROUP BY rec_id, hour),
frames AS (
    SELECT g.rec_id, g.frame, coalesce(er.rms, 1e-6) AS rms
    FROM (SELECT rec_id, unnest(range((SELECT n FROM sp))) AS frame FROM (SELECT DISTINCT rec_id FROM er)) g
    LEFT JOIN er ON er.rec_id = g.rec_id AND er.frame = g.frame
)"""

_REGIONS = """
vo AS (SELECT rec_id, frame, frame - lag(frame) OVER (PARTITION BY rec_id ORDER BY frame) - 1 AS gap FROM frames WHERE rms > 5),
vi AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 15 THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id ORDER BY frame) - 1 AS region_no FROM vo),
regions AS (
    SELECT rec_id, CAST(region_no AS BIGINT) AS region_no, CAST(greatest(min(frame) - 3, 0) AS BIGINT) AS f0, CAST(least(max(frame) + 4, (SELECT n FROM sp)) AS BIGINT) AS f1
    FROM vi GROUP BY rec_id, region_no
)"""


def _blocks(regions: str, target: int = 25) -> str:
    """Blocks of every region: the cut after each possible start, then the chain of starts."""
    return f"""
    rg AS (SELECT rec_id, region_no, CAST(f0 AS BIGINT) AS f0, CAST(f1 AS BIGINT) AS f1 FROM {regions}),
    st AS (SELECT rec_id, region_no, f0, f1, unnest(range(f0, f1)) AS s FROM rg),
    sx AS (SELECT *, s + unnest(range(12, 29)) AS frame FROM st WHERE f1 - s > 29),
    sc AS (
        SELECT st.rec_id, st.region_no, st.s, fr.frame,
               (fr.rms - min(fr.rms) OVER p) / greatest(max(fr.rms) OVER p - min(fr.rms) OVER p, 1e-9)
               + 0.35 * abs(fr.frame - st.s - {target}) / count(*) OVER p AS score
        FROM sx st JOIN frames fr ON fr.rec_id = st.rec_id AND fr.frame = st.frame
        WINDOW p AS (PARTITION BY st.rec_id, st.region_no, st.s)
    ),
    cut AS MATERIALIZED (SELECT rec_id, region_no, s, CAST(first(frame ORDER BY score, frame) AS BIGINT) AS e FROM sc GROUP BY ALL),
    walk AS (
        SELECT rec_id, region_no, f1, f0 AS s, f0 AS s0 FROM rg
        UNION ALL
        SELECT walk.rec_id, walk.region_no, walk.f1, cut.e, walk.s0 FROM walk JOIN cut ON cut.rec_id = walk.rec_id AND cut.region_no = walk.region_no AND cut.s = walk.s
    ),
    blocks AS (
        SELECT rec_id, s AS f0, coalesce(lead(s) OVER (PARTITION BY rec_id, region_no ORDER BY s), f1) AS f1 FROM walk
    )"""


_TOKENS = """
tk AS (
    SELECT rec_id, idx, w, start_ms, end_ms, CAST(idx // 40 AS INTEGER) AS block_no, unnest(range(0, (length(w) + 3) // 4)) AS k FROM words
),
tx AS (SELECT *, row_number() OVER (PARTITION BY rec_id, block_no ORDER BY idx, k) - 1 AS nth FROM tk),
ty AS (
    SELECT *, k = 0 AND NOT (nth = 0 AND block_no % 7 = 3) AS head, substr(w, k * 4 + 1, 4) AS piece,
           CASE WHEN block_no % 2 = 1 THEN NULL WHEN k = (length(w) + 3) // 4 - 1 THEN end_ms ELSE start_ms END AS t_ms FROM tx
),
tz AS (SELECT *, sum(CASE WHEN head OR nth = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id, block_no ORDER BY nth) AS grp FROM ty),
tw AS (
    SELECT rec_id, block_no, grp, trim(string_agg(CASE WHEN head THEN ' ' ELSE '' END || piece, '' ORDER BY nth)) AS w,
           arg_min_null(t_ms, nth) AS start_ms, arg_max_null(t_ms, nth) AS end_ms
    FROM tz GROUP BY rec_id, block_no, grp
),
token_words AS (
    SELECT rec_id, block_no, row_number() OVER (PARTITION BY rec_id, block_no ORDER BY grp) - 1 AS n_in_block, w, start_ms, end_ms FROM tw WHERE w <> ''
)"""

_IDS = """
ik AS (
    SELECT rec_id, idx, hex(encode(w)) AS code, start_ms, end_ms, CAST(idx // 40 AS INTEGER) AS block_no, unnest(range(0, (octet_length(encode(w)) + 3) // 4)) AS k FROM words
),
ix AS (SELECT *, row_number() OVER (PARTITION BY rec_id, block_no ORDER BY idx, k) - 1 AS nth FROM ik),
iy AS (
    SELECT *, k = 0 AND NOT (nth = 0 AND block_no % 7 = 3) AS head, substr(code, k * 8 + 1, 8) AS piece,
           CASE WHEN block_no % 2 = 1 THEN NULL WHEN k = length(code) // 8 - (length(code) % 8 = 0)::INT THEN end_ms ELSE start_ms END AS t_ms FROM ix
),
iz AS (SELECT *, sum(CASE WHEN head OR nth = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY rec_id, block_no ORDER BY nth) AS grp FROM iy),
id_words AS (
    SELECT rec_id, block_no, row_number() OVER (PARTITION BY rec_id, block_no ORDER BY grp) - 1 AS n_in_block,
           decode(unhex(string_agg(piece, '' ORDER BY nth))) AS w, arg_min_null(t_ms, nth) AS start_ms, arg_max_null(t_ms, nth) AS end_ms
    FROM iz GROUP BY rec_id, block_no, grp
)"""


def _heard(times: bool) -> str:
    """Words of a recording in one order; those without times share their block's."""
    bare = "start_ms IS NULL" if times else "true"
    return f"""
hb AS (SELECT rec_id, CAST(idx // 40 AS INTEGER) AS block_no, min(start_ms) AS b0, max(end_ms) AS b1 FROM words GROUP BY ALL),
hc AS (SELECT t.*, b0, b1, count(*) OVER (PARTITION BY t.rec_id, t.block_no) AS n FROM id_words t JOIN hb ON hb.rec_id = t.rec_id AND hb.block_no = t.block_no),
hd AS (
    SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY block_no, n_in_block) - 1 AS idx, w,
           CASE WHEN ({bare}) AND b1 > b0 THEN b0 + (b1 - b0) * n_in_block // n {'ELSE start_ms' if times else ''} END AS start_ms,
           CASE WHEN ({bare}) AND b1 > b0 THEN b0 + (b1 - b0) * (n_in_block + 1) // n {'ELSE end_ms' if times else ''} END AS end_ms FROM hc
),
heard AS (
    SELECT rec_id, idx, w, start_ms,
           CASE WHEN end_ms - start_ms < 80 THEN greatest(end_ms, least(start_ms + 80, greatest(coalesce(lead(start_ms) OVER (PARTITION BY rec_id ORDER BY idx), end_ms), start_ms))) ELSE end_ms END AS end_ms
    FROM hd
)"""


_DOCS = r"""
dw AS (
    SELECT doc_id, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') AS toks FROM documents
),
dn AS (SELECT doc_id, toks, len(toks) AS n, 1 + greatest(0, CAST(ceil((len(toks) - 200) / 120.0) AS BIGINT)) AS k FROM dw WHERE len(toks) > 0),
dc AS (SELECT doc_id, n, k, unnest(range(0, k)) AS chunk_no, toks FROM dn),
chunks AS (
    SELECT doc_id, chunk_no, k, toks[chunk_no * 120 + 1:chunk_no * 120 + 200] AS toks FROM dc
),
kept AS (
    SELECT doc_id, chunk_no, toks, CAST(len(toks) AS BIGINT) AS n, CAST(CASE WHEN chunk_no = 0 THEN 0 ELSE least(40, len(toks)) END AS BIGINT) AS lo,
           CAST(CASE WHEN chunk_no = k - 1 THEN len(toks) ELSE greatest(CASE WHEN chunk_no = 0 THEN 0 ELSE 40 END, len(toks) - 40) END AS BIGINT) AS hi
    FROM chunks
)"""

_MARKS = """.,!?;:…"''()–—-„“«»"""


def _key(w: str) -> str:
    return f"trim(lower(trim({w})), '{_MARKS}')"


_HYPOTHESES = """
hn AS (SELECT rec_id, count(*) AS n FROM words GROUP BY rec_id),
hs AS (SELECT rec_id, n, unnest(range(1, n // 6 + 2)) AS step FROM hn),
hx AS (
    SELECT s.rec_id AS stream_id, s.step, s.step = s.n // 6 + 1 AS last, max(w.end_ms) AS clock_ms,
           list(struct_pack(w := CASE WHEN s.step % 2 = 0 AND w.idx >= least(6 * s.step, s.n) - 2 THEN w.w || 'x'
                                      WHEN s.step % 3 = 0 THEN upper(replace(w.w, 'ß', 'ss')) ELSE w.w || ',' END,
                            start_ms := w.start_ms, end_ms := w.end_ms) ORDER BY w.idx) AS hyp
    FROM hs s JOIN words w ON w.rec_id = s.rec_id AND w.idx >= greatest(0, 6 * s.step - 48) AND w.idx < least(6 * s.step, s.n)
    GROUP BY s.rec_id, s.step, s.n
),
hypotheses AS (SELECT stream_id, step, clock_ms, last, step % 17 = 0 AND NOT last AS silent, hyp FROM hx)"""


def _with(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(parts) + "\n"


#: Left-to-right fold over the runs, which sees earlier relabels.
def _smooth(words: str) -> str:
    """Runs and their smoothing as a fold from left to right."""
    return f"""
rn AS (
    SELECT *, CASE WHEN lag(idx) OVER o IS NULL OR spk IS DISTINCT FROM lag(spk) OVER o THEN 1 ELSE 0 END AS new
    FROM {words} WINDOW o AS (PARTITION BY rec_id ORDER BY idx)
),
ri AS (SELECT *, CAST(sum(new) OVER (PARTITION BY rec_id ORDER BY idx) - 1 AS BIGINT) AS run_no FROM rn),
runs AS (
    SELECT rec_id, run_no, any_value(spk) AS spk, count(*) AS n_words, min(start_ms) AS start_ms, last(end_ms ORDER BY idx) AS end_ms
    FROM ri GROUP BY rec_id, run_no
),
rl AS (SELECT *, lead(spk) OVER (PARTITION BY rec_id ORDER BY run_no) AS right_spk FROM runs),
fold AS (
    SELECT rec_id, run_no, spk AS now, false AS taken FROM rl WHERE run_no = 0
    UNION ALL
    SELECT r.rec_id, r.run_no,
           CASE WHEN f.now = r.right_spk AND r.n_words < 4 AND r.end_ms - r.start_ms < 1000 THEN f.now ELSE r.spk END,
           coalesce(f.now = r.right_spk AND r.n_words < 4 AND r.end_ms - r.start_ms < 1000, false)
    FROM fold f JOIN rl r ON r.rec_id = f.rec_id AND r.run_no = f.run_no + 1
),
smoothed AS (SELECT ri.rec_id, ri.idx, fold.now AS spk, fold.taken AS relabelled FROM ri JOIN fold ON fold.rec_id = ri.rec_id AND fold.run_no = ri.run_no)"""


_SMOOTH = _smooth("words")


def _overlap(words: str) -> str:
    """The segment that a word overlaps most, and the nearest one."""
    return f"""
wt AS (SELECT rec_id, idx, start_ms AS t0, CASE WHEN end_ms <= start_ms THEN start_ms + 50 ELSE end_ms END AS t1 FROM {words}),
ov AS (
    SELECT rec_id, idx, spk FROM (
        SELECT wt.rec_id, wt.idx, s.spk, row_number() OVER (PARTITION BY wt.rec_id, wt.idx ORDER BY least(t1, b_ms) - greatest(t0, a_ms) DESC, s.seg_idx) AS r
        FROM wt JOIN segments s ON s.rec_id = wt.rec_id AND t0 < b_ms AND t1 > a_ms
        WHERE least(t1, b_ms) - greatest(t0, a_ms) > 0
    ) WHERE r = 1
),
nr AS (
    SELECT rec_id, idx, spk FROM (
        SELECT wt.rec_id, wt.idx, s.spk, row_number() OVER (
            PARTITION BY wt.rec_id, wt.idx
            ORDER BY CASE WHEN (t0 + t1) / 2.0 BETWEEN a_ms AND b_ms THEN 0 ELSE least(abs((t0 + t1) / 2.0 - a_ms), abs((t0 + t1) / 2.0 - b_ms)) + 0.25 END, s.seg_idx) AS r
        FROM wt JOIN segments s ON s.rec_id = wt.rec_id
    ) WHERE r = 1
)"""


_OVERLAP = _overlap("words")

#: LocalAgreement as a recursive fold over the steps of every stream.
_AGREE = f"""
ag AS (
    SELECT stream_id, CAST(0 AS BIGINT) AS step, CAST(-1 AS BIGINT) AS c_end, CAST(-1 AS BIGINT) AS c_start, CAST(0 AS BIGINT) AS clock_ms,
           hyp[1:0] AS tent, hyp[1:0] AS done, false AS forced
    FROM hypotheses WHERE step = 1
    UNION ALL
    SELECT stream_id, step, CASE WHEN len(done) > 0 THEN done[-1].end_ms ELSE c_end END, CASE WHEN len(done) > 0 THEN done[-1].start_ms ELSE c_start END,
           clock_ms, tent, done, forced
    FROM (
        SELECT stream_id, step, c_end, c_start, clock_ms, silent AS forced,
               CASE WHEN silent THEN tent ELSE new[1:n] END AS done, CASE WHEN silent THEN new[1:0] ELSE new[n + 1:] END AS tent
        FROM (
            SELECT *, coalesce(list_position(list_transform(range(1, least(len(new), len(tent)) + 1), lambda i: {_key('new[i].w')} = {_key('tent[i].w')}), false) - 1,
                               least(len(new), len(tent))) AS n
            FROM (
                SELECT h.stream_id, h.step, h.clock_ms, h.silent, ag.c_end, ag.c_start, ag.tent,
                       list_filter(h.hyp, lambda x: x.start_ms >= ag.c_end AND x.start_ms > ag.c_start) AS new
                FROM ag JOIN hypotheses h ON h.stream_id = ag.stream_id AND h.step = ag.step + 1
            )
        )
    )
),
am AS (
    SELECT stream_id, step, 0 AS fin, clock_ms, done AS ws, forced FROM ag
    UNION ALL
    SELECT stream_id, step, 1, clock_ms, tent, true FROM ag QUALIFY row_number() OVER (PARTITION BY stream_id ORDER BY step DESC) = 1
),
au AS (SELECT stream_id, step, fin, clock_ms, forced, unnest(ws) AS x, generate_subscripts(ws, 1) AS pos FROM am),
agreed AS (
    SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY step, fin, pos) - 1 AS seq, x.w AS w, x.start_ms AS start_ms, x.end_ms AS end_ms,
           greatest(0, clock_ms - x.end_ms) AS lag_ms, forced
    FROM au
)"""

#: The live captions as a recursive fold over the steps, each of three chunks of 700 ms.
_LIVE = f"""
ct AS (SELECT rec_id, max(end_ms) AS total FROM words GROUP BY rec_id),
ck AS (SELECT rec_id, total, unnest(range(total // 700 + 1)) AS k FROM ct),
cw AS (SELECT rec_id, start_ms // 700 AS k, list(struct_pack(w := w, start_ms := start_ms, end_ms := end_ms) ORDER BY idx) AS said FROM words GROUP BY ALL),
cs AS (
    SELECT ck.rec_id, k // 3 + 1 AS step, 700 * count(*) AS len, sqrt(avg(CASE WHEN k % 40 < 33 THEN 0.01::DOUBLE ELSE 1e-10::DOUBLE END) + 1e-12) < 1e-4 AS quiet,
           flatten(list(CASE WHEN k % 40 < 33 THEN coalesce(said, []) ELSE [] END ORDER BY k)) AS said
    FROM ck LEFT JOIN cw USING (rec_id, k) GROUP BY ck.rec_id, k // 3
),
lv AS (
    SELECT rec_id, CAST(0 AS BIGINT) AS step, CAST(0 AS BIGINT) AS clock, CAST(0 AS BIGINT) AS t0, CAST(0 AS BIGINT) AS skipped,
           CAST(-1 AS BIGINT) AS c_end, CAST(-1 AS BIGINT) AS c_start, said[1:0] AS buf, said[1:0] AS tent, said[1:0] AS forced, said[1:0] AS agreed
    FROM cs WHERE step = 1
    UNION ALL
    SELECT rec_id, step, clock,
           CASE WHEN gone THEN clock WHEN can AND t2 < c_end3 AND c_end3 < clock THEN c_end3 ELSE t2 END,
           skipped + CASE WHEN gone THEN 1 ELSE 0 END, c_end3, c_start3,
           CASE WHEN gone THEN buf2[1:0] WHEN can AND t2 < c_end3 AND c_end3 < clock THEN list_filter(buf2, lambda x: x.start_ms >= c_end3) ELSE buf2 END,
           CASE WHEN can THEN fresh[n + 1:] ELSE tent2 END, forced2, CASE WHEN can THEN fresh[1:n] ELSE fresh[1:0] END
    FROM (
        SELECT *, CASE WHEN can AND n > 0 THEN fresh[n].end_ms ELSE c_end2 END AS c_end3, CASE WHEN can AND n > 0 THEN fresh[n].start_ms ELSE c_start2 END AS c_start3
        FROM (
            SELECT *, coalesce(list_position(list_transform(range(1, least(len(fresh), len(tent2)) + 1), lambda i: {_key('fresh[i].w')} = {_key('tent2[i].w')}), false) - 1, least(len(fresh), len(tent2))) AS n
            FROM (
                SELECT *, NOT gone AND clock - t2 >= 1000 AS can,
                       list_filter(list_transform(buf2, lambda x, i: struct_pack(w := CASE WHEN step % 11 >= 7 THEN x.w || '~' || step WHEN step % 2 = 0 AND i = len(buf2) THEN x.w || 'x'
                           WHEN step % 3 = 0 THEN upper(replace(x.w, 'ß', 'ss')) ELSE x.w || ',' END, start_ms := x.start_ms, end_ms := x.end_ms)), lambda x: x.start_ms >= c_end2 AND x.start_ms > c_start2) AS fresh
                FROM (
                    SELECT *, forced1 || CASE WHEN over THEN tent1 ELSE tent1[1:0] END AS forced2, CASE WHEN over THEN tent1[1:0] ELSE tent1 END AS tent2,
                           CASE WHEN over AND len(tent1) > 0 THEN tent1[-1].end_ms ELSE c_end1 END AS c_end2, CASE WHEN over AND len(tent1) > 0 THEN tent1[-1].start_ms ELSE c_start1 END AS c_start2,
                           CASE WHEN over THEN clock - 3000 ELSE t0 END AS t2, list_filter(buf1, lambda x: x.start_ms >= CASE WHEN over THEN clock - 3000 ELSE t0 END) AS buf2
                    FROM (
                        SELECT *, quiet AND len(tent1) = 0 AS gone, NOT (quiet AND len(tent1) = 0) AND clock - t0 > 6000 AS over, buf || said AS buf1
                        FROM (
                            SELECT lv.rec_id, cs.step, lv.clock + len AS clock, t0, skipped, quiet, buf, said,
                                   CASE WHEN quiet AND len >= 800 THEN tent ELSE tent[1:0] END AS forced1, CASE WHEN quiet AND len >= 800 THEN tent[1:0] ELSE tent END AS tent1,
                                   CASE WHEN quiet AND len >= 800 AND len(tent) > 0 THEN tent[-1].end_ms ELSE c_end END AS c_end1,
                                   CASE WHEN quiet AND len >= 800 AND len(tent) > 0 THEN tent[-1].start_ms ELSE c_start END AS c_start1
                            FROM lv JOIN cs ON cs.rec_id = lv.rec_id AND cs.step = lv.step + 1
                        )
                    )
                )
            )
        )
    )
),
lm AS (
    SELECT rec_id, step, 0 AS part, clock, forced AS ws, true AS forced FROM lv
    UNION ALL SELECT rec_id, step, 1, clock, agreed, false FROM lv
    UNION ALL SELECT rec_id, step, 2, clock, tent, true FROM lv QUALIFY row_number() OVER (PARTITION BY rec_id ORDER BY step DESC) = 1
),
lu AS (SELECT rec_id, step, part, clock, forced, unnest(ws) AS x, generate_subscripts(ws, 1) AS pos FROM lm),
lived AS (
    SELECT rec_id AS stream_id, row_number() OVER (PARTITION BY rec_id ORDER BY step, part, pos) - 1 AS seq, x.w AS w, x.start_ms AS start_ms, x.end_ms AS end_ms,
           greatest(0, clock - x.end_ms) AS lag_ms, forced
    FROM lu
)"""

_ATTACHED = """
attached AS (
    SELECT h.rec_id, h.idx, h.w, h.start_ms, h.end_ms, CASE WHEN ov.idx IS NOT NULL THEN ov.spk ELSE nr.spk END AS spk
    FROM heard h LEFT JOIN ov ON ov.rec_id = h.rec_id AND ov.idx = h.idx LEFT JOIN nr ON nr.rec_id = h.rec_id AND nr.idx = h.idx
)"""

_C = _with(_WORDS, _CUES, recursive=True)
_B = _with(_WORDS, _CUES, _BODIES, recursive=True)
_G = _with(_FRAMES, _REGIONS)
_A = _with(_WORDS, _HYPOTHESES, _AGREE, recursive=True)
_S = _with(_WORDS, _SEGMENTS, _OVERLAP)

ORACLES: dict[str, str] = {
    "turns": _with(_WORDS, _TURNS) + "SELECT * FROM turns",
    "turn_stats": _with(_WORDS, _TURNS) + "SELECT rec_id, count(*) AS n_turns, count(DISTINCT spk) AS n_speakers, max(end_ms - start_ms) AS longest_ms, max(end_ms - start_ms) > 60000 AS long_turn FROM turns GROUP BY rec_id",
    "turn_lines_txt": _with(_WORDS, _TURNS) + f"SELECT rec_id, turn_no, printf('[%02d:%02d] ', start_ms // 60000, start_ms // 1000 % 60) || CASE WHEN spk IS NULL THEN text ELSE {_label('spk')} || ': ' || text END AS line FROM turns",
    "txt_transcripts": _with(_WORDS, _TURNS) + f"SELECT rec_id, string_agg(printf('[%02d:%02d] ', start_ms // 60000, start_ms // 1000 % 60) || CASE WHEN spk IS NULL THEN text ELSE {_label('spk')} || ': ' || text END, chr(10) || chr(10) ORDER BY turn_no) AS content FROM turns GROUP BY rec_id",
    "words_from_tokens": _with(_WORDS, _TOKENS) + "SELECT * FROM token_words",
    "recording_words": _with(_WORDS, _TOKENS) + "SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY block_no, n_in_block) - 1 AS idx, w, start_ms, end_ms FROM token_words",
    "result_quality": _with(_WORDS) + "SELECT rec_id, count(*) FILTER (rec_id % 5 <> 0) AS n_words, rec_id % 5 = 0 AS no_speech FROM words GROUP BY rec_id",
    "words_from_ids": _with(_WORDS, _IDS) + "SELECT * FROM id_words",
    "transcript_full": _with(_WORDS, _SEGMENTS, _IDS, _heard(True), _overlap("heard"), _ATTACHED, _smooth("attached"), recursive=True) + """SELECT h.rec_id, h.idx, h.w || ',' AS w, h.start_ms, h.end_ms, s.spk, s.relabelled
        FROM heard h JOIN smoothed s ON s.rec_id = h.rec_id AND s.idx = h.idx""",
    "transcript_one_speaker": _with(_WORDS, _SEGMENTS, _IDS, _heard(False), _overlap("heard"), _ATTACHED, "one AS (SELECT rec_id, idx, w, start_ms, end_ms, spk * 0 AS spk FROM attached)", _turns("one")) + "SELECT * FROM turns",
    "transcript_plain": _with(_WORDS, _IDS, _heard(True)) + "SELECT *, CAST(NULL AS INTEGER) AS spk FROM heard",
    "ungated_blocks": _with(_FRAMES, "whole AS (SELECT rec_id, 0 AS region_no, 0 AS f0, max(frame) + 1 AS f1 FROM frames GROUP BY rec_id)", _blocks("whole", 20), recursive=True) + "SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY f0) - 1 AS block_no, f0, f1 FROM blocks",
    "even_spread": _with(_WORDS, _TOKENS) + """,
        bl AS (SELECT rec_id, CAST(idx // 40 AS INTEGER) AS block_no, min(start_ms) AS b0, max(end_ms) AS b1 FROM words GROUP BY ALL),
        es AS (SELECT t.*, b0, b1, count(*) OVER (PARTITION BY t.rec_id, t.block_no) AS n FROM token_words t JOIN bl ON bl.rec_id = t.rec_id AND bl.block_no = t.block_no)
        SELECT rec_id, block_no, n_in_block, w,
               CASE WHEN start_ms IS NULL AND b1 > b0 THEN b0 + (b1 - b0) * n_in_block // n ELSE start_ms END AS start_ms,
               CASE WHEN start_ms IS NULL AND b1 > b0 THEN b0 + (b1 - b0) * (n_in_block + 1) // n ELSE end_ms END AS end_ms FROM es""",
    "widen_words": _with(_WORDS) + """SELECT rec_id, idx, w, start_ms,
        CASE WHEN end_ms - start_ms < 80 THEN greatest(end_ms, least(start_ms + 80, greatest(coalesce(lead(start_ms) OVER (PARTITION BY rec_id ORDER BY idx), end_ms), start_ms))) ELSE end_ms END AS end_ms FROM words""",
    "speaker_runs": _with(_WORDS, _SMOOTH, recursive=True) + "SELECT rec_id, run_no, spk, n_words, start_ms, end_ms FROM runs",
    "smooth_speakers": _with(_WORDS, _SMOOTH, recursive=True) + "SELECT * FROM smoothed",
    "smoothed_count": _with(_WORDS, _SMOOTH, recursive=True) + "SELECT rec_id, CAST(sum(CASE WHEN relabelled THEN 1 ELSE 0 END) AS BIGINT) AS relabelled FROM smoothed GROUP BY rec_id",
    "speaker_at_overlap": _S + "SELECT * FROM ov",
    "speaker_at_nearest": _S + "SELECT * FROM nr",
    "speaker_at_full": _S + "SELECT w.rec_id, w.idx, CASE WHEN ov.idx IS NOT NULL THEN ov.spk ELSE nr.spk END AS spk FROM words w LEFT JOIN ov ON ov.rec_id = w.rec_id AND ov.idx = w.idx LEFT JOIN nr ON nr.rec_id = w.rec_id AND nr.idx = w.idx",
    "speaker_names": _with(_WORDS) + f"SELECT rec_id, spk, CASE WHEN spk = 1 THEN 'Vedėja' ELSE {_label('spk')} END AS who, count(*) AS n FROM words GROUP BY rec_id, spk",
    "cues": _C + "SELECT rec_id, cue_no, spk, start_ms, end_ms, text FROM cues",
    "cue_lines": _B + "SELECT rec_id, cue_no, lines, CASE WHEN contains(lines, chr(10)) THEN CAST(2 AS BIGINT) ELSE CAST(1 AS BIGINT) END AS n_lines FROM bodies",
    "srt_rows": _B + f"SELECT rec_id, cue_no, CAST(cue_no AS VARCHAR) || chr(10) || {_stamp('start_ms', ',')} || ' --> ' || {_stamp('end_ms', ',')} || chr(10) || body AS block FROM bodies",
    "vtt_rows": _B + f"SELECT rec_id, cue_no, {_stamp('start_ms', '.')} || ' --> ' || {_stamp('end_ms', '.')} || chr(10) || body AS block FROM bodies",
    "transcript_json": _with(_WORDS, _TURNS) + """SELECT rec_id, 'word' AS kind, CAST(idx AS BIGINT) AS nth, w AS said, start_ms, end_ms, spk FROM words
        UNION ALL SELECT rec_id, 'turn', CAST(turn_no AS BIGINT), text, start_ms, end_ms, spk FROM turns""",
    "cues_from_json": _C + "SELECT rec_id, cue_no, spk, start_ms, end_ms, text FROM cues",
    "frame_rms": _with(_FRAMES) + "SELECT rec_id, CAST(frame AS INTEGER) AS frame, round(rms, 6) AS rms FROM frames",
    "sample_frames": """WITH s AS (SELECT user_id AS rec_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value FROM events)
        SELECT rec_id, i // 8 AS frame, round(sqrt(avg(value * value) + 1e-12), 6) AS rms FROM s GROUP BY rec_id, i // 8 HAVING count(*) = 8""",
    "signal_gain": """WITH s AS (SELECT user_id AS rec_id, value * CASE WHEN user_id % 7 = 0 THEN 1e-9 WHEN user_id % 3 = 0 THEN 1e-3 ELSE 1.0 END::DOUBLE AS v FROM events),
        g AS (SELECT rec_id, sqrt(avg(v * v)) AS rms, max(abs(v)) AS peak FROM s GROUP BY rec_id)
        SELECT rec_id, round(rms, 6) AS rms, round(peak, 9) AS peak, rms < 1e-5 AS rejected,
               round(CASE WHEN rms < 1e-5 THEN NULL WHEN rms < 0.02 THEN least(0.95::DOUBLE / peak, 20.0::DOUBLE) ELSE 1.0::DOUBLE END, 6) AS gain FROM g""",
    "speech_regions": _G + "SELECT * FROM regions",
    "pause_blocks": _with(_FRAMES, "whole AS (SELECT DISTINCT rec_id, 0 AS region_no, 0 AS f0, (SELECT n FROM sp) AS f1 FROM frames)", _blocks("whole"), recursive=True)
    + "SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY f0) - 1 AS block_no, f0, f1 FROM blocks",
    "gated_blocks": _with(_FRAMES, _REGIONS, _blocks("regions"), recursive=True) + "SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY f0) - 1 AS block_no, f0, f1 FROM blocks WHERE f1 - f0 >= 2",
    "skipped_ranges": _G + """, e AS (SELECT rec_id, f0, f1 FROM regions UNION ALL SELECT DISTINCT rec_id, (SELECT n FROM sp), (SELECT n FROM sp) FROM frames),
        g AS (SELECT rec_id, lag(f1, 1, 0) OVER (PARTITION BY rec_id ORDER BY f0, f1) AS g0, f0 AS g1 FROM e)
        SELECT rec_id, row_number() OVER (PARTITION BY rec_id ORDER BY g0) AS gap_no, g0, g1 FROM g WHERE g1 - g0 > 10 QUALIFY gap_no <= 6""",
    "speech_totals": _G + "SELECT f.rec_id, CAST(coalesce(s, 0) AS BIGINT) AS speech, CAST((SELECT n FROM sp) - coalesce(s, 0) AS BIGINT) AS skipped FROM (SELECT DISTINCT rec_id FROM frames) f LEFT JOIN (SELECT rec_id, sum(f1 - f0) AS s FROM regions GROUP BY rec_id) r ON r.rec_id = f.rec_id",
    "empty_blocks": _G + """, b AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY region_no) AS r FROM regions WHERE region_no % 3 <> 0)
        SELECT rec_id, count(*) AS n_empty, CAST(sum(f1 - f0) AS BIGINT) AS total, string_agg(CAST(f0 AS VARCHAR) || '-' || CAST(f1 AS VARCHAR), ' ' ORDER BY r) FILTER (r <= 6) AS first_ranges FROM b GROUP BY rec_id""",
    "progress_sample": _G + """, p AS (SELECT rec_id, region_no AS step, row_number() OVER (PARTITION BY rec_id ORDER BY region_no) AS nth, count(*) OVER (PARTITION BY rec_id) AS total FROM regions)
        SELECT * FROM p WHERE nth = 1 OR nth = total OR nth % greatest(1, total // 10) = 0""",
    "punct_chunks": _with(_DOCS) + "SELECT doc_id, chunk_no, n, lo, hi, toks[1] AS first_tok FROM kept",
    "punct_guard": _with(_DOCS) + "SELECT doc_id, chunk_no, lower(left(toks[1], 1)) IN ('a', 'e', 'i', 'o', 'u') AS refused FROM kept",
    "punct_guard_split": _with(_DOCS) + "SELECT doc_id, CAST(sum(CASE WHEN regexp_matches(array_to_string(toks, ' '), '[^ ],') OR (contains(array_to_string(toks, ' '), ',') AND NOT starts_with(array_to_string(toks, ' '), ',') AND NOT regexp_matches(array_to_string(toks, ' '), '^[^,]* ,')) THEN 1 ELSE 0 END) AS BIGINT) AS refused, count(*) AS chunks FROM kept GROUP BY doc_id",
    "restore_text": _with(_DOCS) + f"""SELECT d.doc_id, array_to_string(d.toks, ' ') AS text, d.k AS chunks, CAST(0 AS BIGINT) AS refused,
        CAST(len(list_filter(d.toks, lambda x: trim(x, '{_MARKS}') <> '')) AS BIGINT) AS words FROM dn d""",
    "positional_zip": _with(_WORDS) + "SELECT rec_id, idx, CASE WHEN rec_id % 4 = 1 THEN w ELSE upper(replace(w, 'ß', 'ss')) END AS w FROM words",
    "sentence_cased": r"""WITH d AS (SELECT doc_id, lower(array_to_string(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> ''), ' ')) AS t FROM documents),
        p AS (SELECT doc_id, regexp_split_to_array(regexp_replace(t, '([.!?]) ', '\1 ' || chr(1), 'g'), chr(1)) AS l FROM d)
        SELECT doc_id, array_to_string(list_transform(l, lambda x: CASE WHEN regexp_matches(x, '^[a-ząčęėįšųūž]') THEN upper(left(x, 1)) || substr(x, 2) ELSE x END), '') AS text FROM p""",
    "word_functions": _with(_WORDS) + f"SELECT DISTINCT w, {_key('w')} AS key, right(w, 1) IN ('.', '!', '?', '…') AS ends, length(w) AS n FROM words",
    "time_functions": _with(_WORDS) + f"SELECT rec_id, idx, {_stamp('start_ms', '.')} AS dot, {_stamp('start_ms', ',')} AS comma, printf('[%02d:%02d]', start_ms // 60000, start_ms // 1000 % 60) AS minute, least(400, (end_ms - start_ms) * 8 // 1000 + 16) AS budget, 'rec.' || CAST(rec_id AS VARCHAR) || 'k.srt' AS name FROM words",
    "wrapped_turns": r"WITH c AS (SELECT *, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') AS ws FROM conversations) SELECT conv_id, turn, "
    + _wrapped("ws")
    + " AS two, array_to_string(list_filter(list_transform(string_split(text, '.'), lambda x: trim(x)), lambda x: x <> ''), ' ') AS parts FROM c",
    "screen_text": r"""WITH RECURSIVE c AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(trim(text), '\s+'), lambda x: x <> '') AS ws FROM conversations),
        f AS (
            SELECT conv_id, turn, ws, 0 AS i, CAST([] AS VARCHAR[]) AS lines, '' AS cur FROM c
            UNION ALL
            SELECT conv_id, turn, ws, i + 1, CASE WHEN length(cur) + length(ws[i + 1]) + 1 > 42 THEN list_append(lines, cur) ELSE lines END,
                   CASE WHEN length(cur) + length(ws[i + 1]) + 1 > 42 OR cur = '' THEN ws[i + 1] ELSE cur || ' ' || ws[i + 1] END
            FROM f WHERE i < len(ws)
        ),
        e AS (SELECT conv_id, turn, CASE WHEN cur <> '' THEN list_append(lines, cur) ELSE lines END AS l FROM f WHERE i = len(ws))
        SELECT conv_id, turn, array_to_string(CASE WHEN len(l) > 2 THEN l[len(l) - 1:] ELSE l END, chr(10)) AS screen FROM e""",
    "common_prefix": _with(_WORDS, _HYPOTHESES)
    + f""", h AS (SELECT stream_id, step, CASE WHEN silent THEN hyp[1:0] ELSE hyp END AS hyp FROM hypotheses),
        q AS (SELECT a.stream_id, a.step, a.hyp AS x, b.hyp AS y, greatest(coalesce(a.hyp[1].start_ms, 0), coalesce(b.hyp[1].start_ms, 0)) AS t FROM h a JOIN h b ON b.stream_id = a.stream_id AND b.step = a.step + 1),
        p AS (SELECT stream_id, step, list_filter(x, lambda z: z.start_ms >= t) AS x, list_filter(y, lambda z: z.start_ms >= t) AS y FROM q)
        SELECT stream_id, step, coalesce(list_position(list_transform(range(1, least(len(x), len(y)) + 1), lambda i: {_key('x[i].w')} = {_key('y[i].w')}), false) - 1, least(len(x), len(y))) AS n FROM p""",
    "local_agreement": _A + "SELECT * FROM agreed",
    "commit_lag_percentiles": _A + "SELECT stream_id, count(*) AS n, list(lag_ms ORDER BY lag_ms)[count(*) // 2 + 1] AS p50_ms, list(lag_ms ORDER BY lag_ms)[CAST(floor(count(*) * 0.9) AS BIGINT) + 1] AS p90_ms FROM agreed GROUP BY stream_id",
    "stream_captions": _A + "SELECT * FROM agreed",
    "stream_captions_full": _with(_WORDS, _LIVE, recursive=True) + "SELECT * FROM lived",
    "stream_screen": _with(_WORDS, _LIVE, recursive=True)
    + r""", lt AS (SELECT stream_id, string_agg(w, ' ' ORDER BY seq) AS t FROM lived GROUP BY stream_id),
        lp AS (SELECT stream_id, regexp_split_to_array(regexp_replace(t, '([.!?]) ', '\1 ' || chr(1), 'g'), chr(1)) AS l FROM lt),
        lc AS (SELECT stream_id, array_to_string(list_transform(l, lambda x: CASE WHEN regexp_matches(x, '^[a-ząčęėįšųūž]') THEN upper(left(x, 1)) || substr(x, 2) ELSE x END), '') AS text FROM lp),
        lw AS (SELECT stream_id, text, string_split(text, ' ') AS ws FROM lc),
        lf AS (
            SELECT stream_id, text, ws, 0 AS i, CAST([] AS VARCHAR[]) AS lines, '' AS cur FROM lw
            UNION ALL
            SELECT stream_id, text, ws, i + 1, CASE WHEN length(cur) + length(ws[i + 1]) + 1 > 42 THEN list_append(lines, cur) ELSE lines END,
                   CASE WHEN length(cur) + length(ws[i + 1]) + 1 > 42 OR cur = '' THEN ws[i + 1] ELSE cur || ' ' || ws[i + 1] END
            FROM lf WHERE i < len(ws)
        ),
        le AS (SELECT stream_id, text, CASE WHEN cur <> '' THEN list_append(lines, cur) ELSE lines END AS l FROM lf WHERE i = len(ws)),
        ls AS (SELECT rec_id, max(skipped) AS skipped FROM lv GROUP BY rec_id)
        SELECT le.stream_id, text, array_to_string(CASE WHEN len(l) > 2 THEN l[len(l) - 1:] ELSE l END, chr(10)) AS screen, CAST(skipped AS BIGINT) AS skipped FROM le JOIN ls ON ls.rec_id = le.stream_id""",
}
