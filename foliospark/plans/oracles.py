"""DuckDB SQL for the library's queries, written apart from the operators."""

from __future__ import annotations

import re

from ..functions.distance import confusion_pairs
from ..functions.strings import ACCENTED, DIGIT_LETTERS, DIGITS, FOLDED, STOP_WORDS
from ..operators.correction import GRAPHEMES, REPLACEMENTS
from ..operators.raster import PHOTO_WORDS

_LINES = r"""
d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda w: w <> '') AS t FROM documents),
g AS (SELECT doc_id, t, unnest(range((len(t) + 7) // 8)) AS g, CASE WHEN doc_id % 3 = 0 THEN 80 ELSE 40 END AS per FROM d),
p AS (SELECT *, g // per AS page, g % per AS r, (g % per) // 40 AS c, (g % per) % 40 AS rr, (g + doc_id) % 7 AS seven FROM g),
q AS (
  SELECT *, CASE WHEN seven = 0 THEN 11 WHEN rr >= 33 AND doc_id % 2 = 0 THEN 14 ELSE 18 END AS h, 980 - 24 * rr AS top, 2 * (doc_id % 3 - 1) AS tilt,
    (CASE WHEN c = 1 THEN 530 ELSE 60 END) + (CASE WHEN seven = 1 THEN 20 ELSE 0 END) AS x0,
    (CASE WHEN per = 80 AND c = 0 THEN 470 ELSE 940 END) - 10 * ((g + doc_id) % 5) AS x1 FROM p
),
lines AS (
  SELECT doc_id, page::INT AS page_idx, r::INT AS line_no, array_to_string(list_slice(t, g * 8 + 1, g * 8 + 8), ' ') AS text,
    ((50 + (7 * g + 13 * doc_id) % 50) / 100.0::DOUBLE)::FLOAT AS confidence,
    x0 / 1000.0::DOUBLE AS tl_x, top / 1000.0::DOUBLE AS tl_y, x1 / 1000.0::DOUBLE AS tr_x, (top + tilt) / 1000.0::DOUBLE AS tr_y,
    x0 / 1000.0::DOUBLE AS bl_x, (top - h) / 1000.0::DOUBLE AS bl_y, x1 / 1000.0::DOUBLE AS br_x, (top - h + tilt) / 1000.0::DOUBLE AS br_y FROM q
),
geo AS (
  SELECT *, atan2(tr_y - tl_y, tr_x - tl_x) AS angle, sqrt((tr_x - tl_x) ** 2 + (tr_y - tl_y) ** 2) AS width,
    sqrt((tl_x - bl_x) ** 2 + (tl_y - bl_y) ** 2) AS height, (tl_y + tr_y + bl_y + br_y) / 4 AS cy FROM lines
),
skews AS (SELECT doc_id, page_idx, percentile_disc(0.5) WITHIN GROUP (ORDER BY angle DESC) AS skew FROM geo GROUP BY ALL)"""
_ROLES = r""",
medians AS (
  SELECT doc_id, page_idx, count(*) AS n, percentile_disc(0.5) WITHIN GROUP (ORDER BY height DESC) AS median,
    coalesce(max(cy) FILTER (cy > 0.05 AND cy < 0.95), max(cy)) AS hi, coalesce(min(cy) FILTER (cy > 0.05 AND cy < 0.95), min(cy)) AS lo
  FROM geo GROUP BY ALL
),
roles AS (
  SELECT geo.*, CASE WHEN n <= 4 THEN 'body' WHEN (cy >= 0.95 AND cy > hi) OR (cy <= 0.05 AND cy < lo) THEN 'marginal'
    WHEN cy < 0.22 AND height < median * 0.82::DOUBLE THEN 'footnote' ELSE 'body' END AS role
  FROM geo JOIN medians USING (doc_id, page_idx)
)"""


def _turned(x: str, y: str) -> str:
    return f"(0.5 + ({x} - 0.5) * cos(-skew) - ({y} - 0.5) * sin(-skew))"


_XS = [_turned(f"{c}_x", f"{c}_y") for c in ("tl", "tr", "bl", "br")]
_CENTER = _turned("((tl_x + tr_x + bl_x + br_x) / 4)", "((tl_y + tr_y + bl_y + br_y) / 4)")


def _bands(name: str, source: str) -> str:
    return f""",
{name}_edges AS (SELECT i AS band, i / 3.0::DOUBLE AS y_min, CASE WHEN i = 2 THEN 1.0 ELSE (i + 1) / 3.0::DOUBLE END AS y_max FROM range(3) t(i)),
{name}_in AS (SELECT s.*, band FROM {source} s JOIN {name}_edges e ON s.cy >= e.y_min AND s.cy <= e.y_max),
{name}_page AS (SELECT doc_id, page_idx, percentile_disc(0.5) WITHIN GROUP (ORDER BY angle DESC) AS page_skew FROM {source} GROUP BY ALL),
{name}_own AS (SELECT doc_id, page_idx, band, count(*) AS n, percentile_disc(0.5) WITHIN GROUP (ORDER BY angle DESC) AS own FROM {name}_in GROUP BY ALL),
{name} AS (
  SELECT doc_id, page_idx, e.band::INT AS band, y_min, y_max, CASE WHEN n >= 4 THEN own ELSE page_skew END AS skew
  FROM {name}_page CROSS JOIN {name}_edges e LEFT JOIN {name}_own o USING (doc_id, page_idx, band)
)"""


def _gutter(name: str, source: str, keys: str) -> str:
    return f""",
{name}_n AS (SELECT * FROM {source} WHERE width <= 0.8),
{name}_k AS (SELECT {keys} FROM {name}_n GROUP BY ALL HAVING count(*) >= 6),
{name}_x AS (
  SELECT {keys}, greatest(0, least(199, trunc(least({", ".join(_XS)}) * 200)::INT)) AS a, greatest(0, least(199, trunc(greatest({", ".join(_XS)}) * 200)::INT)) AS z
  FROM {name}_n
),
{name}_b AS (SELECT {keys}, unnest(range(a, z + 1)) AS bin FROM {name}_x),
{name}_h AS (SELECT {keys}, bin, count(*) AS n FROM {name}_b GROUP BY ALL),
{name}_s AS (SELECT {keys}, bin, coalesce(n, 0) AS coverage FROM (SELECT * FROM {name}_k, (SELECT unnest(range(60, 141)) AS bin)) LEFT JOIN {name}_h USING ({keys}, bin)),
{name}_t AS (SELECT {keys}, greatest(1, floor(sum(coverage) / 81.0::DOUBLE * 0.15::DOUBLE)) AS lim FROM {name}_s GROUP BY ALL),
{name}_r AS (SELECT {keys}, bin, bin - row_number() OVER (PARTITION BY {keys} ORDER BY bin) AS run FROM {name}_s JOIN {name}_t USING ({keys}) WHERE coverage <= lim),
{name}_l AS (SELECT {keys}, min(bin) AS start, count(*) AS len FROM {name}_r GROUP BY {keys}, run),
{name} AS (
  SELECT {keys}, (start + len / 2.0::DOUBLE) / 200.0::DOUBLE AS gutter FROM {name}_l
  WHERE len >= 4 QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY len DESC, start) = 1
)"""


_SIDES = (
    _ROLES
    + r""",
bodies AS (SELECT *, max((role = 'body')::INT) OVER (PARTITION BY doc_id, page_idx) AS has_body FROM roles),
body AS (SELECT * FROM bodies WHERE has_body = 0 OR role = 'body')"""
    + _bands("bb", "body")
    + """,
mid AS (SELECT doc_id, page_idx, skew FROM bb WHERE band = 1),
body_mid AS (SELECT * FROM body JOIN mid USING (doc_id, page_idx))"""
    + _gutter("gut", "body_mid", "doc_id, page_idx")
    + f""",
sides AS (
  SELECT r.*, CASE WHEN gutter IS NULL OR {_CENTER} < gutter THEN 'L' ELSE 'R' END AS side
  FROM roles r JOIN mid USING (doc_id, page_idx) LEFT JOIN gut USING (doc_id, page_idx)
)"""
)
# the fixture's lines never share a visual row within a group, so order is by top
_PARAS = (
    _SIDES
    + r""",
ext AS (
  SELECT *, greatest(tl_y, tr_y) AS top, least(bl_y, br_y) AS bottom, least(tl_x, bl_x) AS lx, greatest(tr_x, br_x) AS rx,
    median(0) OVER () AS zero FROM sides
),
med AS (SELECT doc_id, page_idx, side, role, percentile_disc(0.5) WITHIN GROUP (ORDER BY height DESC) AS mh FROM ext GROUP BY ALL),
ord AS (
  SELECT e.*, mh, row_number() OVER w - 1 AS place, lag(bottom) OVER w - top AS gap FROM ext e JOIN med USING (doc_id, page_idx, side, role)
  WINDOW w AS (PARTITION BY doc_id, page_idx, side, role ORDER BY top DESC, tl_x, line_no)
),
fold AS (
  SELECT doc_id, page_idx, side, role, line_no, place, 0::BIGINT AS para, lx AS a, rx AS z FROM ord WHERE place = 0
  UNION ALL
  SELECT o.doc_id, o.page_idx, o.side, o.role, o.line_no, o.place,
    f.para + (CASE WHEN brk THEN 1 ELSE 0 END), CASE WHEN brk THEN o.lx ELSE least(f.a, o.lx) END, CASE WHEN brk THEN o.rx ELSE greatest(f.z, o.rx) END
  FROM fold f JOIN ord o ON o.doc_id = f.doc_id AND o.page_idx = f.page_idx AND o.side = f.side AND o.role = f.role AND o.place = f.place + 1,
    LATERAL (SELECT gap > mh * 0.4::DOUBLE OR gap < -mh * 0.5::DOUBLE OR greatest(f.a, o.lx) > least(f.z, o.rx) AS brk)
)"""
)
_ORDER = (
    _PARAS
    + r""",
ranked AS (
  SELECT f.*, o.text, dense_rank() OVER (PARTITION BY f.doc_id, f.page_idx ORDER BY f.side, CASE f.role WHEN 'body' THEN 0 WHEN 'footnote' THEN 1 ELSE 2 END, f.para) - 1 AS reading_order,
    o.tl_x, o.tl_y, o.tr_x, o.tr_y, o.bl_x, o.bl_y
  FROM fold f JOIN ord o USING (doc_id, page_idx, line_no)
),
para_text AS (
  SELECT doc_id, page_idx, reading_order, role, count(*) AS n_lines,
    replace(regexp_replace(string_agg(text, chr(10) ORDER BY place), '(\pL)-\n', '\1', 'g'), chr(10), ' ') AS text
  FROM ranked GROUP BY ALL
),
page_texts AS (SELECT doc_id, page_idx, string_agg(text, ' ' ORDER BY reading_order, place) AS text FROM ranked GROUP BY ALL)"""
)
_SIZES = r""",
sizes AS (
  SELECT *, CASE WHEN doc_id % 4 = 0 THEN 1100 WHEN wide AND doc_id % 4 <> 1 THEN 1700 ELSE 1200 END AS px_w,
    CASE WHEN doc_id % 4 = 0 THEN 1080 WHEN wide AND doc_id % 4 <> 1 THEN 1200 ELSE 1700 END AS px_h, 800 + original_idx % 90 AS gutter
  FROM (
    SELECT DISTINCT doc_id, page_idx AS original_idx, (doc_id + page_idx) % 3 = 0 AS wide, CASE WHEN (doc_id + page_idx) % 3 = 0 THEN 842.0::DOUBLE ELSE 595.0::DOUBLE END AS width,
      CASE WHEN (doc_id + page_idx) % 3 = 0 THEN 595.0::DOUBLE ELSE 842.0::DOUBLE END AS height FROM lines
  )
)"""
_SPINE = """,
spine AS (
  SELECT DISTINCT doc_id, page_idx FROM lines UNION ALL SELECT doc_id, max(page_idx) + 1 FROM lines WHERE doc_id % 10 = 0 GROUP BY doc_id
)"""
_SUMMARY = """,
counted AS (
  SELECT doc_id, page_idx, count(*) AS n_lines, count(*) FILTER (f.role = 'body') AS n_body, count(*) FILTER (f.role = 'footnote') AS n_footnote,
    count(*) FILTER (f.role = 'marginal') AS n_marginal, count(DISTINCT reading_order) AS n_paragraphs, avg(confidence::DOUBLE) AS mean_confidence
  FROM ranked f JOIN lines USING (doc_id, page_idx, line_no) GROUP BY ALL
),
summary AS (
  SELECT doc_id, page_idx, coalesce(n_lines, 0) AS n_lines, coalesce(n_body, 0) AS n_body, coalesce(n_footnote, 0) AS n_footnote, coalesce(n_marginal, 0) AS n_marginal,
    coalesce(n_paragraphs, 0) AS n_paragraphs, round(coalesce(mean_confidence, 0.0), 6) AS mean_confidence FROM spine LEFT JOIN counted USING (doc_id, page_idx)
)"""
_SECOND = """,
shifted AS (
  SELECT doc_id, page_idx, line_no, confidence, {xs}, {ys}
  FROM lines, LATERAL (SELECT CASE WHEN line_no % 2 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS dx, CASE WHEN line_no % 2 = 0 THEN 0.004 ELSE 0.0 END::DOUBLE AS dy) WHERE line_no % 3 = 0
)""".format(xs=", ".join(f"{c}_x + dx AS {c}_x" for c in ("tl", "tr", "bl", "br")), ys=", ".join(f"{c}_y + dy AS {c}_y" for c in ("tl", "tr", "bl", "br")))


def _box(p: str) -> str:
    return ", ".join(
        f"{f}({', '.join(f'{p}.{c}_{k}' for c in ('tl', 'tr', 'bl', 'br'))}) AS {p}{k}{n}" for k in "xy" for f, n in (("least", 0), ("greatest", 1))
    )


_IOU = f"""LATERAL (SELECT {_box("a")}, {_box("b")}),
  LATERAL (SELECT least(ax1, bx1) - greatest(ax0, bx0) AS w, least(ay1, by1) - greatest(ay0, by0) AS h),
  LATERAL (SELECT CASE WHEN w > 0 AND h > 0 THEN w * h / ((ax1 - ax0) * (ay1 - ay0) + (bx1 - bx0) * (by1 - by0) - w * h) ELSE 0.0::DOUBLE END AS iou)"""

_CORES = r"""
toks AS (SELECT lang, unnest(string_split_regex(coalesce(text, ''), '\s+')) AS token FROM documents),
tc AS (SELECT lang, regexp_extract(token, '(?s)^([^\pL]*)(\pL(?:.*\pL)?)([^\pL]*)$', 2) AS core FROM toks),
cores AS (SELECT lang, core, count(*) AS n FROM tc WHERE core <> '' GROUP BY lang, core),
lex AS (SELECT lang, lower(core) AS word_lower, sum(n)::BIGINT AS freq FROM cores WHERE regexp_full_match(core, '\pL+') GROUP BY ALL HAVING sum(n) >= 5)"""


def _valid(word: str, alias: str) -> str:
    """That a word is valid, for rows of alias, which has lang."""
    return (
        rf"NOT (regexp_matches({word}, '\pN') AND regexp_matches({word}, '\pL')) AND CASE WHEN length({word}) = 1 THEN "
        f"({alias}.lang <> 'pl' OR contains('aiouwz', lower({word}))) AND ({alias}.lang <> 'en' OR lower({word}) IN ('a', 'i')) "
        f"ELSE ({alias}.lang, lower({word})) IN (SELECT (lang, word_lower) FROM lex) END"
    )


_OPEN = rf""",
norms AS (
  SELECT DISTINCT lang, CASE WHEN regexp_matches(core, '[\pNıﬁﬂ]') THEN translate(core, '{DIGITS}', '{DIGIT_LETTERS}') ELSE core END AS core FROM cores
),
open AS (SELECT * FROM norms WHERE length(core) >= 3 AND NOT regexp_full_match(core, '[0-9]+') AND upper(core) <> core AND NOT ({_valid("core", "norms")}))"""
_GRAPH = f""",
gl AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{s}', '{d}')" for i, (s, d) in enumerate(GRAPHEMES))}) v(ord, src, dst)),
gp AS (SELECT lang, core, ord, src, dst, string_split(lower(core), src) AS parts FROM open JOIN gl ON contains(lower(core), src)),
gk AS (SELECT *, unnest(range(1, len(parts))) AS k FROM gp),
ga AS (SELECT lang, core, ord, src, dst, length(array_to_string(list_slice(parts, 1, k), '#')) + (k - 1) * (length(src) - 1) AS pos FROM gk),
gv AS (
  SELECT lang, core, ord, pos, substr(core, 1, pos) || CASE WHEN lower(substr(core, pos + 1, 1)) <> substr(core, pos + 1, 1) AND dst[1] <> 'ß' THEN upper(dst[1]) || substr(dst, 2) ELSE dst END
    || substr(core, pos + length(src) + 1) AS candidate FROM ga
),
gr AS (SELECT lang, core, candidate, min((ord, pos)) AS o FROM gv WHERE candidate <> core AND {_valid("candidate", "gv")} GROUP BY ALL),
graph AS (SELECT lang, core, candidate, row_number() OVER (PARTITION BY lang, core ORDER BY o, candidate) AS rk FROM gr QUALIFY rk <= 20)"""
_SUBS = f""",
cp AS (SELECT * FROM (VALUES {", ".join(f"('{a}', '{b}', {c})" for a, b, c in confusion_pairs())}) v(a, b, cost)),
ch AS (SELECT lang, core, unnest(range(length(core))) AS idx FROM open),
cs AS (
  SELECT lang, core, idx, cost, CASE WHEN lower(substr(core, idx + 1, 1)) <> substr(core, idx + 1, 1) THEN upper(b) ELSE b END AS rep
  FROM ch JOIN cp ON lower(substr(core, idx + 1, 1)) = a
),
subs AS (SELECT *, row_number() OVER (PARTITION BY lang, core ORDER BY cost, idx, rep) AS i FROM cs QUALIFY i <= 25),
sv AS (SELECT lang, core, i, substr(core, 1, idx) || rep || substr(core, idx + 2) AS candidate FROM subs),
sr AS (SELECT lang, core, candidate, min(i) AS o FROM sv WHERE {_valid("candidate", "sv")} GROUP BY ALL),
single AS (SELECT lang, core, candidate, row_number() OVER (PARTITION BY lang, core ORDER BY o, candidate) AS rk FROM sr QUALIFY rk <= 30)"""
_PAIRS = f""",
pv AS (
  SELECT x.lang, x.core, x.i, y.i AS j, one.w AS w1, substr(one.w, 1, y.idx) || y.rep || substr(one.w, y.idx + 2) AS candidate
  FROM subs x JOIN subs y ON x.lang = y.lang AND x.core = y.core AND x.i < y.i AND x.idx <> y.idx,
    LATERAL (SELECT substr(x.core, 1, x.idx) || x.rep || substr(x.core, x.idx + 2) AS w) one
),
pr AS (SELECT lang, core, candidate, min((i, j)) AS o FROM pv WHERE {_valid("candidate", "pv")} GROUP BY ALL),
pair AS (SELECT lang, core, candidate, row_number() OVER (PARTITION BY lang, core ORDER BY o, candidate) AS rk FROM pr QUALIFY rk <= 30)"""
_DIA = f""",
folded AS MATERIALIZED (SELECT lang, core, lower(translate(core, '{ACCENTED}', '{FOLDED}')) AS f FROM open),
listed AS MATERIALIZED (SELECT lang, word_lower, lower(translate(word_lower, '{ACCENTED}', '{FOLDED}')) AS f FROM lex),
dia AS (SELECT o.lang, core, word_lower AS candidate FROM folded o JOIN listed l ON o.lang = l.lang AND o.f = l.f WHERE word_lower <> core)"""
_COSTS = "MAP {" + ", ".join(f"'{a}{b}': {c}" for a, b, c in confusion_pairs()) + "}"


def _edit(source: str, unit: bool = False) -> str:
    """Recursion over rows of the edit table for (a, b) pairs of source: dist(a, b, d)."""
    ca, cb = "substr(lower(a), i + 1, 1)", "substr(lower(b), j[1] + 1, 1)"
    sub = f"CASE WHEN {ca} = {cb} THEN 0 ELSE {'10' if unit else f'coalesce(costs[{ca} || {cb}], 10)'} END"
    return f""",
costing AS (SELECT {_COSTS} AS costs),
tab AS (
  SELECT a, b, 0 AS i, list_transform(range(length(b) + 1), lambda j: (j * 10)::INT) AS r FROM {source}
  UNION ALL
  SELECT a, b, i + 1, list_reduce(list_transform(range(length(b)), lambda j: [j::INT]),
    lambda o, j: list_append(o, least(o[-1] + 10, r[j[1] + 2] + 10, r[j[1] + 1] + {sub})::INT), [r[1] + 10])
  FROM tab, costing WHERE i < length(a)
),
dist AS (SELECT a, b, r[-1] AS d FROM tab WHERE i = length(a))"""


_EVERY = (
    _CORES
    + _OPEN
    + _GRAPH
    + _SUBS
    + _PAIRS
    + _DIA
    + """,
staged AS (SELECT lang, core, candidate, 0 AS st, rk FROM graph UNION ALL SELECT lang, core, candidate, 1, rk FROM single UNION ALL SELECT lang, core, candidate, 2, rk FROM pair),
firsts AS (SELECT lang, core, candidate, min((st, rk)) AS o FROM staged GROUP BY ALL),
optical AS (SELECT lang, core, candidate FROM firsts QUALIFY row_number() OVER (PARTITION BY lang, core ORDER BY o, candidate) <= 30),
every AS (SELECT * FROM optical UNION SELECT * FROM dia),
ab AS (SELECT DISTINCT core AS a, candidate AS b FROM every)"""
)
_AFFIX = r"'(?s)^([^\pL]*)(\pL(?:.*\pL)?)([^\pL]*)$'"
_TOKS = """,
split AS (SELECT doc_id, page_idx, line_no, string_split(text, ' ') AS ts FROM lines),
tokens AS (SELECT doc_id, page_idx, line_no, (i - 1)::INT AS tok_idx, ts[i] AS token FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM split))"""


def _merged() -> tuple[str, str]:
    """Each letter of the confusion table beside the least one of its class."""
    classes: list[set[str]] = []
    for a, b, _ in confusion_pairs():
        new = {a, b}.union(*(c for c in classes if c & {a, b}))
        classes = [c for c in classes if not c & new] + [new]
    return "".join(x for c in classes for x in sorted(c)), "".join(min(c) for c in classes for _ in c)


_FROM, _TO = _merged()


def _q(ctes: str, select: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE' if recursive else ''} {ctes.strip().lstrip(',')}\n{select}"


def _replaced(word: str) -> str:
    """Whole-word replacement with the capital kept."""
    table = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in REPLACEMENTS.items()) + "}"
    target, first = f"{table}[lower({word})]", f"{word}[1]"
    return (
        f"CASE WHEN {target} IS NULL THEN {word} WHEN upper({first}) = {first} AND lower({first}) <> {first} "
        f"THEN upper({target}[1]) || substr({target}, 2) ELSE {target} END"
    )


def _split(source: str, p: str = "") -> str:
    """CTEs that end in {p}parts(lang, core, parts), for the distinct cores of source."""
    return f""",
{p}todo AS (
  SELECT DISTINCT t.lang, core FROM {source} t
  WHERE length(core) BETWEEN 6 AND 24 AND NOT regexp_matches(core, '[0-9]') AND upper(core) <> core AND NOT ({_valid("core", "t")})
),
{p}begins AS (SELECT lang, core, unnest(range(length(core))) AS i FROM {p}todo),
{p}seg AS (SELECT lang, core, i, n, substr(core, i + 1, n) AS part FROM {p}begins, (SELECT unnest(range(1, 13)) AS n) WHERE i + n <= length(core)),
{p}ok AS (SELECT lang, core, list(i * 100 + n) AS ok FROM {p}seg WHERE {_valid("part", p + "seg")} GROUP BY ALL),
{p}back AS (
  SELECT lang, core, ok, length(core) AS i, []::VARCHAR[] AS done FROM {p}ok
  UNION ALL
  SELECT lang, core, ok, i - 1, list_prepend(CASE WHEN n IS NULL THEN NULL WHEN i - 1 + n = length(core) THEN substr(core, i, n) ELSE substr(core, i, n) || chr(1) || done[n] END, done)
  FROM (SELECT *, list_max(list_filter(range(1, 13), lambda n: list_contains(ok, (i - 1) * 100 + n) AND (i - 1 + n = length(core) OR done[n] IS NOT NULL))) AS n FROM {p}back WHERE i > 0)
),
{p}parts AS (
  SELECT lang, core, replace(done[1], chr(1), ' ') AS parts FROM {p}back
  WHERE i = 0 AND contains(done[1], chr(1)) AND length(core) / len(string_split(done[1], chr(1)))::DOUBLE >= 2.5
)"""


_OF_NORMS = re.compile(
    r"\b(norms|open|gl|gp|gk|ga|gv|gr|graph|cp|ch|cs|subs|sv|sr|single|pv|pr|pair|folded|listed|dia|staged|firsts|optical|every|ab|costing|tab|dist)\b"
)


def _corrections(source: str, p: str) -> str:
    """CTEs that end in {p}fix(lang, core, new), for the distinct cores of source; names within begin with p."""
    search = (_OPEN + _EVERY.removeprefix(_CORES + _OPEN) + _edit("ab")).replace("FROM cores\n", f"FROM {p}asked\n")
    return (
        f""",
{p}r1 AS (SELECT *, {_replaced("core")} AS r FROM (SELECT DISTINCT lang, core FROM {source} WHERE core <> '')),
{p}asked AS (SELECT DISTINCT lang, r AS core FROM {p}r1)"""
        + _OF_NORMS.sub(lambda x: p + x[0], search)
        + f""",
{p}best AS (
  SELECT lang, core, candidate AS best FROM {p}every JOIN {p}dist ON core = a AND candidate = b QUALIFY row_number() OVER (PARTITION BY lang, core ORDER BY d, candidate) = 1
),
{p}r2 AS (
  SELECT x.lang, x.core, CASE WHEN length(norm) < 3 OR regexp_full_match(norm, '[0-9]+') OR upper(norm) = norm THEN r ELSE coalesce(best, norm) END AS r2
  FROM (SELECT *, CASE WHEN regexp_matches(r, '[\\pNıﬁﬂ]') THEN translate(r, '{DIGITS}', '{DIGIT_LETTERS}') ELSE r END AS norm FROM {p}r1) x
  LEFT JOIN {p}best b ON x.lang = b.lang AND norm = b.core
),
{p}whole AS (SELECT DISTINCT lang, r2 AS core FROM {p}r2)"""
        + _split(f"{p}whole", p)
        + f""",
{p}r3 AS (SELECT x.lang, x.core, coalesce(parts, r2) AS r3 FROM {p}r2 x LEFT JOIN {p}parts s ON x.lang = s.lang AND r2 = s.core),
{p}fix AS (SELECT lang, core, {_replaced("r3")} AS new FROM {p}r3)"""
    )


def _protect(source: str, p: str) -> str:
    """CTEs that end in {p}name(doc_id, page_idx, core, name, exact): the protected name of each core, from pn(doc_id, page_idx, name)."""
    return (
        f""",
{p}pc AS (SELECT DISTINCT doc_id, page_idx, core FROM {source} WHERE core <> ''),
{p}pp AS (
  SELECT c.doc_id, c.page_idx, core, name FROM {p}pc c JOIN pn n ON c.doc_id = n.doc_id AND c.page_idx = n.page_idx AND abs(length(core) - length(name)) <= 1
  WHERE core = name OR levenshtein(lower(core), lower(name)) <= CASE WHEN strlen(core || name) = length(core || name) THEN 1 ELSE 4 END
    OR translate(lower(core), '{_FROM}', '{_TO}') = translate(lower(name), '{_FROM}', '{_TO}')
),
{p}pab AS (SELECT DISTINCT core AS a, name AS b FROM {p}pp)"""
        + re.sub(r"\b(costing|tab|dist|ab)\b", lambda x: f"{p}p{x[0]}", _edit("ab"))
        + f""",
{p}name AS (
  SELECT doc_id, page_idx, core, name, core = name AS exact FROM {p}pp JOIN {p}pdist ON core = a AND name = b WHERE core = name OR d = 10
  QUALIFY row_number() OVER (PARTITION BY doc_id, page_idx, core ORDER BY core <> name, name) = 1
)"""
    )


def _parted(source: str, name: str) -> str:
    """CTE name: rows of source with the parts of their token."""
    return f""",
{name} AS (SELECT *, regexp_extract(token, {_AFFIX}, 1) AS pre, regexp_extract(token, {_AFFIX}, 2) AS core, regexp_extract(token, {_AFFIX}, 3) AS suf FROM {source})"""


def _fixed(source: str, p: str, name: str, names: bool = True) -> str:
    """CTE name: rows of source (from _parted) with corrected."""
    new = "pre || coalesce(new, t.core) || suf"
    if not names:
        return f""",
{name} AS (SELECT t.*, CASE WHEN t.core = '' THEN token ELSE {new} END AS corrected FROM {source} t LEFT JOIN {p}fix f ON t.lang = f.lang AND t.core = f.core)"""
    cased = "CASE WHEN lower(t.core[1]) <> t.core[1] THEN upper(name[1]) || lower(substr(name, 2)) ELSE lower(name) END"
    return f""",
{name} AS (
  SELECT t.*, CASE WHEN t.core = '' OR exact THEN token WHEN name IS NOT NULL THEN pre || {cased} || suf ELSE {new} END AS corrected
  FROM {source} t LEFT JOIN {p}fix f ON t.lang = f.lang AND t.core = f.core
  LEFT JOIN {p}name n ON t.doc_id = n.doc_id AND t.page_idx = n.page_idx AND t.core = n.core
)"""


_CORRECTED_TOKENS = (
    _CORES + "," + _LINES + _TOKS + """,
ltok AS (SELECT tokens.*, lang FROM tokens JOIN documents USING (doc_id))""" + _parted("ltok", "ptok") + _corrections("ptok", "t_") + _fixed("ptok", "t_", "ctok", names=False)
)
# only the last line of a document can be of one token, and it is the last of its paragraph, so repairs do not follow from one another
_HYPHENS = (
    _CORES + "," + _LINES + _ORDER + f""",
brk AS MATERIALIZED (
  SELECT r.doc_id, page_idx, line_no, reading_order, place, lang, string_split(CASE WHEN place % 4 = 0 THEN r.text || '-' ELSE r.text END, ' ') AS ts
  FROM ranked r JOIN documents USING (doc_id)
),
hy AS MATERIALIZED (
  SELECT *, CASE WHEN ends_with(ts[-1], '-') THEN left(ts[-1], length(ts[-1]) - 1) || lead(ts[1]) OVER (PARTITION BY doc_id, page_idx, reading_order ORDER BY place) END AS token FROM brk
),
pn AS MATERIALIZED (
  SELECT DISTINCT doc_id, page_idx, name FROM (SELECT doc_id, page_idx, regexp_extract(unnest(ts), {_AFFIX}, 2) AS name FROM brk) WHERE regexp_full_match(name, '\\p{{Lu}}\\p{{Ll}}{{2,}}')
)""" + _parted("(SELECT * FROM hy WHERE token IS NOT NULL)", "mg") + _corrections("mg", "h_") + _protect("mg", "h_") + _fixed("mg", "h_", "mgc") + """,
cut AS (
  SELECT hy.*, CASE WHEN length(corrected) >= length(hy.ts[-1]) - 1 THEN left(corrected, length(hy.ts[-1]) - 1) || '-' END AS ending,
    CASE WHEN length(corrected) >= length(hy.ts[-1]) - 1 THEN substr(corrected, length(hy.ts[-1])) END AS rest
  FROM hy LEFT JOIN mgc USING (doc_id, page_idx, line_no)
),
begun AS (SELECT *, lag(rest) OVER (PARTITION BY doc_id, page_idx, reading_order ORDER BY place) AS beginning FROM cut),
first_set AS (SELECT * REPLACE (CASE WHEN beginning IS NULL THEN ts ELSE list_concat([beginning], ts[2:]) END AS ts) FROM begun),
repaired AS MATERIALIZED (SELECT * REPLACE (CASE WHEN ending IS NULL THEN ts ELSE list_concat(ts[:-2], [ending]) END AS ts) FROM first_set)"""
)
_PAGES = (
    _HYPHENS + """,
rtok AS (SELECT doc_id, page_idx, line_no, reading_order, place, lang, i AS tok_idx, ts[i] AS token FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM repaired))"""
    + _parted("rtok", "rp") + _corrections("rp", "r_") + _protect("rp", "r_") + _fixed("rp", "r_", "rc")
)
_WORDS = (
    _HYPHENS + """,
pieces AS (SELECT *, list_filter(ts, lambda w: w <> '') AS ws FROM brk),
wtok AS (SELECT doc_id, page_idx, line_no, lang, i AS tok_idx, ws[i] AS token FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM pieces WHERE len(ws) >= 2))"""
    + _parted("wtok", "wp") + _corrections("wp", "w_") + _protect("wp", "w_") + _fixed("wp", "w_", "wc")
)


_RASTER = r"""
sz AS (SELECT page_id, (4 + page_id % 7) AS edge, (74 + page_id % 9) AS mid FROM pages),
px AS (
  SELECT page_id, x, y, CASE WHEN x < edge OR y < 3 OR x >= 155 OR y >= 57 THEN 40 WHEN (x * 7 + y * 3) % 11 = 0 AND abs(x - mid) > 3 THEN 90 ELSE 240 END AS v
  FROM sz, (SELECT unnest(range(160)) AS x), (SELECT unnest(range(60)) AS y)
)"""


def _crop(axis: str, size: int, first: str, last: str) -> str:
    return f""",
w{axis} AS (SELECT page_id, g{axis}, (count(*) FILTER (v > 216) > 150)::INT AS white FROM grid GROUP BY ALL),
t{axis} AS (SELECT page_id, g{axis}, white + lead(white, 1, 0) OVER o + lead(white, 2, 0) OVER o AS s FROM w{axis} WINDOW o AS (PARTITION BY page_id ORDER BY g{axis})),
e{axis} AS (SELECT page_id, min(g{axis}) FILTER (s = 3) AS a, max(g{axis}) FILTER (s = 3) AS z FROM t{axis} GROUP BY page_id),
c{axis} AS (
  SELECT page_id, greatest(a / 200.0::DOUBLE * {size} - {size} * 0.01::DOUBLE, 0.0) AS "{first}", least(z / 200.0::DOUBLE * {size} + {size} * 0.01::DOUBLE, {size}.0) AS "{last}"
  FROM (SELECT page_id, CASE WHEN a < 197 THEN a ELSE 0 END AS a, coalesce(z + 2, 199) AS z FROM e{axis}) WHERE z - a > 40
)"""


_GRID = """,
grid AS (
  SELECT page_id, gx, gy, v FROM px, (SELECT unnest(range(200)) AS gx), (SELECT unnest(range(200)) AS gy) WHERE x = gx * 160 // 200 AND y = gy * 60 // 200
)"""


ORACLES: dict[str, str] = {
    "ocr_lines": _q(_LINES, "SELECT * FROM lines"),
    "line_geometry": _q(
        _LINES,
        f"""SELECT doc_id, page_idx, line_no, round(angle, 6) AS angle, round(width, 6) AS width, round(height, 6) AS height, round(cy, 6) AS cy,
  round(least({", ".join(_XS)}), 6) AS x_min, round(greatest({", ".join(_XS)}), 6) AS x_max, round({_CENTER}, 6) AS x_center FROM geo JOIN skews USING (doc_id, page_idx)""",
    ),
    "line_roles": _q(_LINES + _ROLES, "SELECT doc_id, page_idx, line_no, role FROM roles"),
    "page_summary": _q(_LINES + _ORDER + _SPINE + _SUMMARY, "SELECT * FROM summary", True),
    "page_log": _q(
        _LINES + _ORDER + _SPINE + _SUMMARY,
        """SELECT doc_id, page_idx, format('page {}: {} paragraphs (footnotes: {}, marginals: {}), mean confidence {:.2f}', page_idx + 1, n_paragraphs, n_footnote, n_marginal, round(mean_confidence::DECIMAL(18, 6), 2)::DOUBLE) AS line FROM summary""",
        True,
    ),
    "process_pages": _q(
        _LINES + _ORDER,
        """SELECT doc_id, page_idx, line_no, role, side, para, reading_order, place, round(CASE WHEN abs(skew) > radians(10) THEN 0 ELSE skew END, 6) AS text_skew
FROM ranked JOIN skews USING (doc_id, page_idx)""",
        True,
    ),
    "page_skew": _q(_LINES, "SELECT doc_id, page_idx, round(skew, 6) AS skew FROM skews"),
    "text_skew": _q(_LINES, "SELECT doc_id, page_idx, round(CASE WHEN abs(skew) > radians(10) THEN 0 ELSE skew END, 6) AS skew FROM skews"),
    "page_orientation": _q(
        _LINES
        + """,
t AS (
  SELECT doc_id, page_idx, CASE doc_id % 5 WHEN 1 THEN 0.4 WHEN 2 THEN 0.0 ELSE tr_y - tl_y END AS dy, CASE doc_id % 5 WHEN 1 THEN 0.0 WHEN 2 THEN -0.4 ELSE tr_x - tl_x END AS dx FROM lines
),
o AS (SELECT doc_id, page_idx, count(*) AS n, percentile_disc(0.5) WITHIN GROUP (ORDER BY atan2(dy, dx) DESC) AS a FROM t GROUP BY ALL)""",
        """SELECT doc_id, page_idx, n, (CASE WHEN n < 3 THEN 0 WHEN abs(a) >= 2.35 THEN 180 WHEN abs(a) > 0.78 AND a > 0 THEN 90 WHEN abs(a) > 0.78 THEN -90 ELSE 0 END)::INT AS turn FROM o""",
    ),
    "band_skew": _q(_LINES + _bands("bands", "geo"), "SELECT doc_id, page_idx, band, round(y_min, 6) AS y_min, round(y_max, 6) AS y_max, round(skew, 6) AS skew FROM bands"),
    "column_gutter": _q(_LINES + _SIDES, "SELECT doc_id, page_idx, round(gutter, 6) AS gutter FROM gut"),
    "column_assign": _q(_LINES + _SIDES, "SELECT doc_id, page_idx, line_no, side FROM sides"),
    "band_columns": _q(
        _LINES
        + _bands("bands", "geo")
        + """,
wide AS (SELECT g.*, skew FROM geo g JOIN bands b USING (doc_id, page_idx) WHERE band = 1),
inb AS (SELECT i.*, skew FROM bands_in i JOIN bands USING (doc_id, page_idx, band))"""
        + _gutter("gw", "wide", "doc_id, page_idx")
        + _gutter("gb", "inb", "doc_id, page_idx, band")
        + """,
banded AS (SELECT *, (CASE WHEN cy <= 1 / 3.0::DOUBLE THEN 0 WHEN cy <= 2 / 3.0::DOUBLE THEN 1 ELSE 2 END)::INT AS band FROM geo)""",
        f"""SELECT doc_id, page_idx, line_no, band, CASE WHEN coalesce(gb.gutter, gw.gutter) IS NULL OR {_CENTER} < coalesce(gb.gutter, gw.gutter) THEN 'L' ELSE 'R' END AS side
FROM banded JOIN bands USING (doc_id, page_idx, band) LEFT JOIN gb USING (doc_id, page_idx, band) LEFT JOIN gw USING (doc_id, page_idx)""",
    ),
    "paragraphs": _q(_LINES + _PARAS, "SELECT doc_id, page_idx, side, role, line_no, place, para FROM fold", True),
    "reading_order": _q(_LINES + _ORDER, "SELECT doc_id, page_idx, line_no, reading_order, place FROM ranked", True),
    "paragraph_text": _q(_LINES + _ORDER, "SELECT * FROM para_text", True),
    "sidecar_text": _q(
        _LINES + _ORDER,
        """SELECT doc_id, page_idx, concat_ws(chr(10) || chr(10), '--- page ' || (page_idx + 1) || ' (source page ' || (page_idx + 1) || ') ---', string_agg(text, chr(10) || chr(10) ORDER BY reading_order) FILTER (role = 'body'),
  '[footnotes]' || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) ORDER BY reading_order) FILTER (role = 'footnote')) AS text FROM para_text GROUP BY doc_id, page_idx""",
        True,
    ),
    "page_text": _q(_LINES + _ORDER, "SELECT * FROM page_texts", True),
    "searchability": _q(
        _LINES
        + _ORDER
        + _SPINE
        + """,
marked AS (SELECT doc_id, doc_id % 7 <> 0 AND regexp_matches(text, '[^\\s]') AS has, length(text) AS n FROM page_texts),
wanted AS (SELECT doc_id, count(*) AS w FROM spine GROUP BY doc_id)""",
        """SELECT doc_id, count(*) AS n_pages, count(*) FILTER (has) AS n_text_pages, coalesce(sum(n) FILTER (has), 0)::BIGINT AS n_chars,
  round(count(*) FILTER (has) / count(*)::DOUBLE, 6) AS ratio, count(*) = any_value(w) AS complete FROM marked JOIN wanted USING (doc_id) GROUP BY doc_id""",
        True,
    ),
    "merge_passes": _q(
        _LINES + _SECOND,
        f"""SELECT doc_id, page_idx, line_no, 1::INT AS pass, round(tl_x, 6) AS tl_x, round(tl_y, 6) AS tl_y FROM lines
UNION ALL SELECT doc_id, page_idx, line_no, 2::INT, round(tl_x, 6), round(tl_y, 6) FROM shifted b0 WHERE confidence >= 0.35::FLOAT AND NOT EXISTS (
  SELECT 1 FROM lines a, (SELECT b0.*) b, {_IOU} WHERE a.doc_id = b0.doc_id AND a.page_idx = b0.page_idx AND iou > 0.1)""".replace("(SELECT b0.*) b, ", "").replace("shifted b0", "shifted b").replace("b0.", "b."),
    ),
    "line_iou": _q(_LINES + _SECOND, f"SELECT a.doc_id, a.page_idx, a.line_no, round(iou, 6) AS iou FROM lines a JOIN shifted b USING (doc_id, page_idx, line_no), {_IOU}"),
    "letterbox": _q(
        _LINES + _SIZES,
        """SELECT doc_id, original_idx, round((width - iw * f) / 2, 6) AS draw_x, round((height - ih * f) / 2, 6) AS draw_y, round(iw * f, 6) AS draw_w, round(ih * f, 6) AS draw_h,
  round(s * least(595.0::DOUBLE / (CASE WHEN width > height * 1.05 THEN width / 2 ELSE width END), 842.0::DOUBLE / height), 6) AS split_scale
FROM sizes, LATERAL (SELECT 300::DOUBLE / 72 AS s), LATERAL (SELECT (1000 + doc_id % 900) / s AS iw, (1400 + original_idx * 10) / s AS ih), LATERAL (SELECT least(width / iw, height / ih) AS f)""",
    ),
    "split_pages": _q(
        _LINES
        + _SIZES
        + """,
up AS (
  SELECT *, CASE WHEN width > height * 1.05 AND px_w < px_h THEN px_h ELSE px_w END AS uw, CASE WHEN width > height * 1.05 AND px_w < px_h THEN px_w ELSE px_h END AS uh FROM sizes
),
parts AS (SELECT *, unnest(CASE WHEN width > height * 1.05 AND uw > uh * 1.05 THEN ['L', 'R'] ELSE ['P'] END) AS part FROM up)""",
        """SELECT doc_id, original_idx, part, (CASE part WHEN 'L' THEN gutter WHEN 'R' THEN uw - gutter ELSE uw END)::INT AS part_width,
  row_number() OVER (PARTITION BY doc_id ORDER BY original_idx, part) - 1 AS logical_idx FROM parts""",
    ),
    "page_canvas": _q(
        _LINES + _SIZES,
        """SELECT doc_id, original_idx, CASE WHEN wider THEN 842.0::DOUBLE ELSE 595.0::DOUBLE END AS canvas_w, CASE WHEN wider THEN 595.0::DOUBLE ELSE 842.0::DOUBLE END AS canvas_h, doc_id % 5 > 2 AS turns
FROM (SELECT *, CASE WHEN doc_id % 2 = 1 THEN height > width * 1.05 ELSE width > height * 1.05 END AS wider FROM sizes)""",
    ),
    "draw_list": _q(
        _LINES
        + _ORDER
        + """,
mp AS (
  SELECT doc_id, page_idx, line_no, reading_order, place, text, sqrt(((tl_x - bl_x) * 595) ** 2 + ((tl_y - bl_y) * 842) ** 2) AS hh, tl_x, tl_y, tr_x, tr_y, bl_x, bl_y FROM ranked
),
fs AS (SELECT doc_id, page_idx, reading_order, greatest(4.0::DOUBLE, least(72.0::DOUBLE, round(percentile_disc(0.5) WITHIN GROUP (ORDER BY hh DESC) * 2) / 2)) AS font_size FROM mp GROUP BY ALL),
ws AS (SELECT *, string_split(text, ' ') AS t FROM mp JOIN fs USING (doc_id, page_idx, reading_order)),
wr AS (
  SELECT *, unnest(CASE WHEN doc_id % 13 = 0 OR len(t) < 2 THEN [0] ELSE range(1, len(t) + 1) END) AS i FROM ws
),
fr AS (
  SELECT *, CASE WHEN i = 0 THEN 0.0::DOUBLE ELSE (length(array_to_string(t[:i], ' ')) - length(t[i])) / length(text)::DOUBLE END AS a,
    CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE length(array_to_string(t[:i], ' ')) / length(text)::DOUBLE END AS z,
    CASE WHEN i = 0 THEN text WHEN i < len(t) THEN t[i] || ' ' ELSE t[i] END AS run_text
  FROM wr
),
br AS (SELECT doc_id, page_idx, line_no, br_x, br_y FROM lines),
rn AS (
  SELECT f.*, CASE WHEN i = 0 THEN tr_x ELSE tl_x + (tr_x - tl_x) * z END * 595 - (tl_x + (tr_x - tl_x) * a) * 595 AS dx,
    CASE WHEN i = 0 THEN tr_y ELSE tl_y + (tr_y - tl_y) * z END * 842 - (tl_y + (tr_y - tl_y) * a) * 842 AS dy,
    (bl_x + (br_x - bl_x) * a) * 595 AS x, (bl_y + (br_y - bl_y) * a) * 842 AS y FROM fr f JOIN br USING (doc_id, page_idx, line_no)
)""",
        """SELECT doc_id, page_idx, reading_order, place, (i - 1)::BIGINT AS run, run_text AS text, round(x + 1e-9, 6) AS x, round(y + 1e-9, 6) AS y, round(atan2(dy, dx) + 1e-9, 6) AS angle,
  round(sqrt(dx ** 2 + dy ** 2) + 1e-9, 6) AS width, round(font_size + 1e-9, 6) AS font_size, round(sqrt(dx ** 2 + dy ** 2) / (length(run_text) * font_size * 0.5::DOUBLE) + 1e-9, 6) AS scale FROM rn""",
        True,
    ),
    "detect_language": f"""
WITH w AS (SELECT doc_id, string_split_regex(lower(text), '[^\\pL]+') AS ws FROM documents),
v AS (SELECT * FROM (VALUES {", ".join(f"('{code}', {words!r})" for code, words in STOP_WORDS.items())}) t(code, stops)),
n AS (SELECT doc_id, code, len(list_filter(ws, lambda x: list_contains(stops, x))) AS n FROM w, v),
best AS (SELECT doc_id, arg_min(code, (-n, code)) AS code, max(n) AS n FROM n GROUP BY doc_id)
SELECT doc_id, CASE WHEN n > 0 THEN code ELSE 'pl' END AS lang_found FROM best""",
    "metadata": """
SELECT doc_id, concat_ws(';', CASE WHEN doc_id % 2 = 0 AND lang IS NOT NULL THEN 'Author=' || lang END, 'Title=' || source) AS properties FROM documents""",
    "available": _q(
        _CORES,
        "SELECT l AS lang, count(word_lower) AS n_words FROM (SELECT unnest(['pl', 'en', 'de', 'fr', 'es']) AS l) LEFT JOIN lex ON lang = l GROUP BY l",
    ),
    "tokens": _q(_LINES + _TOKS, "SELECT * FROM tokens"),
    "token_affixes": _q(
        _LINES + _TOKS,
        f"SELECT *, regexp_extract(token, {_AFFIX}, 1) AS prefix, regexp_extract(token, {_AFFIX}, 2) AS core, regexp_extract(token, {_AFFIX}, 3) AS suffix FROM tokens",
    ),
    "line_words": _q(
        _LINES + _TOKS,
        """SELECT doc_id, page_idx, line_no, tok_idx AS word_idx, token AS word,
  (sum(length(token) + 1) OVER (PARTITION BY doc_id, page_idx, line_no ORDER BY tok_idx) - length(token) - 1)::INT AS start FROM tokens
QUALIFY count(*) OVER (PARTITION BY doc_id, page_idx, line_no) >= 2""",
    ),
    "digit_fix": _q(_CORES, rf"SELECT DISTINCT core, translate(core, '{DIGITS}', '{DIGIT_LETTERS}') AS fixed FROM cores WHERE regexp_matches(core, '[\pNıﬁﬂ]')"),
    "citations": _q(_LINES, r"SELECT doc_id, page_idx, line_no, regexp_extract(text, '(\p{Lu}\pL+)', 1) AS name FROM lines WHERE regexp_matches(text, '\p{Lu}\pL+')"),
    "name_index": _q(
        _LINES + _TOKS,
        rf"""SELECT core AS name, count(DISTINCT (doc_id, page_idx)) AS n_pages FROM (SELECT *, regexp_extract(token, {_AFFIX}, 2) AS core FROM tokens)
WHERE regexp_full_match(core, '\p{{Lu}}\p{{Ll}}{{2,}}') GROUP BY core""",
    ),
    "lexicon": _q(_CORES, "SELECT * FROM lex"),
    "valid_words": _q(_CORES, f"SELECT lang, core FROM cores WHERE {_valid('core', 'cores')}"),
    "edit_distance": _q(_EVERY + _edit("ab", unit=True), "SELECT a, b, (d // 10)::INT AS distance FROM dist", True),
    "weighted_edit": _q(_EVERY + _edit("ab"), "SELECT a, b, d AS tenths FROM dist", True),
    "cosine_pairs": """
WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), f AS (SELECT label, arg_min(v, vec_id) AS f FROM e GROUP BY label)
SELECT vec_id, label, round(list_cosine_similarity(v, f), 6) AS cosine FROM e JOIN f USING (label)""",
    "protected_match": _q(
        _LINES
        + _TOKS
        + rf""",
pc AS (SELECT DISTINCT doc_id, page_idx, regexp_extract(token, {_AFFIX}, 2) AS core FROM tokens WHERE regexp_matches(token, '\pL')),
pn AS (SELECT doc_id, page_idx, core AS name FROM pc WHERE regexp_full_match(core, '\p{{Lu}}\p{{Ll}}{{2,}}')),
pp AS (
  SELECT c.doc_id, c.page_idx, core, name FROM pc c JOIN pn n ON c.doc_id = n.doc_id AND c.page_idx = n.page_idx AND abs(length(core) - length(name)) <= 1
  WHERE core = name OR levenshtein(lower(core), lower(name)) <= CASE WHEN strlen(core || name) = length(core || name) THEN 1 ELSE 4 END OR translate(lower(core), '{_FROM}', '{_TO}') = translate(lower(name), '{_FROM}', '{_TO}')
),
ab AS (SELECT DISTINCT core AS a, name AS b FROM pp)"""
        + _edit("ab"),
        """SELECT doc_id, page_idx, core, name, core = name AS exact FROM pp JOIN dist ON core = a AND name = b WHERE core = name OR d = 10
QUALIFY row_number() OVER (PARTITION BY doc_id, page_idx, core ORDER BY core <> name, name) = 1""",
        True,
    ),
    "grapheme_candidates": _q(_CORES + _OPEN + _GRAPH, "SELECT lang, core, candidate FROM graph"),
    "subst_candidates": _q(_CORES + _OPEN + _SUBS, "SELECT lang, core, candidate FROM single"),
    "pair_candidates": _q(_CORES + _OPEN + _SUBS + _PAIRS, "SELECT lang, core, candidate FROM pair"),
    "diacritic_matches": _q(_CORES + _OPEN + _DIA, "SELECT * FROM dia"),
    "best_candidate": _q(
        _EVERY + _edit("ab"),
        """SELECT lang, core, candidate AS best FROM every JOIN dist ON core = a AND candidate = b
QUALIFY row_number() OVER (PARTITION BY lang, core ORDER BY d, candidate) = 1""",
        True,
    ),
    "split_merged": _q(_CORES + _split("cores"), "SELECT * FROM parts", True),
    "corrected_tokens": _q(_CORRECTED_TOKENS, "SELECT doc_id, page_idx, line_no, tok_idx, token, corrected FROM ctok", True),
    "hyphen_repair": _q(_HYPHENS, "SELECT doc_id, page_idx, reading_order, place, array_to_string(ts, ' ') AS text FROM repaired", True),
    "corrected_pages": _q(
        _PAGES
        + """,
done AS (SELECT doc_id, page_idx, reading_order, place, string_agg(corrected, ' ' ORDER BY tok_idx) AS text FROM rc GROUP BY ALL)""",
        "SELECT doc_id, page_idx, string_agg(text, ' ' ORDER BY reading_order, place) AS text FROM done GROUP BY ALL",
        True,
    ),
    "corrected_words": _q(_WORDS, "SELECT doc_id, page_idx, line_no, string_agg(corrected, ' ' ORDER BY tok_idx) AS words FROM wc GROUP BY ALL", True),
    "context_candidate": _q(
        _EVERY
        + _edit("ab")
        + ","
        + _LINES
        + _TOKS
        + f""",
near AS (SELECT lang, core, candidate FROM every JOIN dist ON core = a AND candidate = b QUALIFY d = min(d) OVER (PARTITION BY lang, core)),
ltok AS (SELECT tokens.*, lang FROM tokens JOIN documents USING (doc_id)),
use AS (
  SELECT lang, regexp_extract(token, {_AFFIX}, 2) AS core, (doc_id, page_idx, line_no, tok_idx) AS spot,
    list_concat(list(token) OVER (l ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), list(token) OVER (l ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)) AS around
  FROM ltok WINDOW l AS (PARTITION BY doc_id, page_idx, line_no ORDER BY tok_idx)
),
asked AS (SELECT *, {_replaced("core")} AS r FROM use WHERE core <> ''),
spelt AS (SELECT *, CASE WHEN regexp_matches(r, '[\\pNıﬁﬂ]') THEN translate(r, '{DIGITS}', '{DIGIT_LETTERS}') ELSE r END AS word FROM asked),
first_use AS (SELECT lang, core, unnest(around) AS beside FROM (SELECT lang, word AS core, arg_min(around, spot) AS around FROM spelt GROUP BY ALL)),
words AS (SELECT DISTINCT word_lower AS w FROM lex),
vecs AS (
  SELECT w, embedding::DOUBLE[] AS v FROM words JOIN embeddings ON vec_id = ('0x' || substr(md5(w), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings)
),
elem AS (SELECT lang, core, unnest(v) AS x, unnest(range(len(v))) AS i FROM first_use JOIN vecs ON lower(beside) = w),
means AS (SELECT lang, core, list(x ORDER BY i) AS mean FROM (SELECT lang, core, i, avg(x) AS x FROM elem GROUP BY ALL) GROUP BY ALL),
scored AS (
  SELECT near.lang, near.core, candidate, coalesce(CASE WHEN v IS NULL THEN NULL WHEN mean IS NULL THEN 0.0 ELSE -round(list_cosine_similarity(mean, v), 9) END, 9.0) AS score
  FROM near LEFT JOIN means USING (lang, core) LEFT JOIN vecs ON lower(candidate) = w
)""",
        "SELECT lang, core, arg_min(candidate, (score, candidate)) AS best FROM scored GROUP BY ALL",
        True,
    ),
    "ink_gutter": _q(
        _RASTER
        + """,
ink AS (SELECT page_id, x, sum(255 - v) AS ink FROM px GROUP BY ALL),
ma AS (SELECT page_id, x, sum(ink) OVER w // count(*) OVER w AS m FROM ink WINDOW w AS (PARTITION BY page_id ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))""",
        "SELECT page_id, x AS gutter FROM ma WHERE x BETWEEN 72 AND 88 QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY m, x) = 1",
    ),
    "crop_box": _q(
        _RASTER + _GRID + _crop("x", 160, "left", "right") + _crop("y", 60, "top", "bottom"),
        'SELECT page_id, round("left", 6) AS "left", round("right", 6) AS "right", round(top, 6) AS top, round(bottom, 6) AS bottom FROM cx JOIN cy USING (page_id)',
    ),
    "crop_decision": """
SELECT page_id, CASE WHEN cw < 0.02 AND ch < 0.02 THEN 'too little' WHEN cw > 0.5 OR ch > 0.45 THEN 'too much'
    WHEN abs((w / h) / (595.0::DOUBLE / 842.0::DOUBLE) - 1) > 0.4 THEN 'aspect' ELSE 'accepted' END AS decision,
  CASE WHEN -(page_id % 5) / 10.0::DOUBLE < -0.2::DOUBLE THEN 1.4::DOUBLE ELSE 1.0::DOUBLE END AS upscale
FROM (SELECT page_id, 595.0::DOUBLE - (page_id % 40) * 10 AS w, 842.0::DOUBLE - (page_id % 60) * 9 AS h FROM pages), LATERAL (SELECT 1 - w / 595.0::DOUBLE AS cw, 1 - h / 842.0::DOUBLE AS ch)""",
    "top_labels": f"""
WITH l AS (SELECT user_id AS page_id, event_type AS label, max(value) AS confidence FROM events GROUP BY ALL)
SELECT page_id, label, round(confidence, 6) AS confidence, row_number() OVER (PARTITION BY page_id ORDER BY confidence DESC, label) AS rank,
  confidence >= 0.35::FLOAT AND regexp_matches(lower(label), '{"|".join(PHOTO_WORDS)}') AS photo FROM l QUALIFY rank <= 10""",
}
