"""Hand-made inputs for edges that the corpus lacks, and brute-force models."""

import math
import random

import pytest
from pyspark.sql import functions as F

from foliospark.config import TUNING
from foliospark.functions import distance, strings
from foliospark.functions import geometry as geo
from foliospark.operators import correction as co
from foliospark.operators import layout, raster
from foliospark.operators import lexicon as lx
from foliospark.operators import text as tx
from foliospark.sources import lines as src

LINE = "doc_id long, page_idx int, line_no int, text string, confidence float, tl_x double, tl_y double, tr_x double, tr_y double, bl_x double, bl_y double, br_x double, br_y double"


def line(no, x0, x1, top, h=0.018, tilt=0.0, text="w", conf=0.9, doc=0, page=0):
    return (doc, page, no, text, conf, x0, top, x1, top + tilt, x0, top - h, x1, top - h + tilt)


def lines(spark, rows):
    return spark.createDataFrame(rows, LINE)


def value(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_upper_median_of_even_count(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "x double")
    assert df.agg(layout.upper_median("x")).first()[0] == 3


def test_roles(spark):
    few = [line(i, 0.1, 0.9, 0.97 - i * 0.2) for i in range(4)]
    assert {r.role for r in layout.line_roles(lines(spark, few)).collect()} == {"body"}
    page = [line(i, 0.1, 0.9, 0.8 - i * 0.1) for i in range(6)] + [line(6, 0.1, 0.9, 0.209, 0.012), line(7, 0.1, 0.9, 0.99), line(8, 0.1, 0.9, 0.04)]
    got = {r.line_no: r.role for r in layout.line_roles(lines(spark, page)).collect()}
    assert [got[i] for i in (0, 6, 7, 8)] == ["body", "footnote", "marginal", "marginal"]
    assert layout.line_roles(lines(spark, [])).count() == 0


def test_band_edges_are_inclusive_and_sparse_bands_fall_back(spark):
    on_edge = [line(0, 0.1, 0.9, 1 / 3 + 0.009)]
    assert sorted(r.band for r in layout.in_bands(lines(spark, on_edge).withColumn("tl_y", F.lit(1 / 3)).withColumn("tr_y", F.lit(1 / 3)).withColumn("bl_y", F.lit(1 / 3)).withColumn("br_y", F.lit(1 / 3)), 3).collect()) == [0, 1]
    page = [line(i, 0.1, 0.9, 0.95 - i * 0.02, tilt=0.01) for i in range(5)] + [line(5 + i, 0.1, 0.9, 0.2 - i * 0.02) for i in range(3)]
    got = {r.band: r.skew for r in layout.band_skew(lines(spark, page)).collect()}
    assert got[0] == got[1] == got[2] == pytest.approx(math.atan2(0.01, 0.8))


def test_skew_limit_and_orientation(spark):
    steep = [line(i, 0.1, 0.2, 0.9 - i * 0.1, tilt=0.1 * math.tan(math.radians(11))) for i in range(3)]
    assert layout.text_skew(lines(spark, steep)).first().skew == 0
    quarter = [(0, 0, i, "w", 0.9, 0.5, 0.5, 0.5, 0.9, 0.5, 0.5, 0.5, 0.9) for i in range(3)]
    assert layout.orientation(lines(spark, quarter)).first().turn == 90
    half = [(0, 0, i, "w", 0.9, 0.9, 0.5, 0.1, 0.51, 0.9, 0.5, 0.1, 0.5) for i in range(3)]
    assert layout.orientation(lines(spark, half)).first().turn == 180
    assert layout.orientation(lines(spark, half[:2])).first().turn == 0


def gutter_brute(rows):
    """rows: (x0, x1) without skew."""
    rows = [(a, b) for a, b in rows if b - a <= 0.8]
    if len(rows) < 6:
        return None
    cover = [0] * 200
    for a, b in rows:
        for i in range(max(0, min(199, int(a * 200))), max(0, min(199, int(b * 200))) + 1):
            cover[i] += 1
    mid = range(60, 141)
    limit = max(1, int(sum(cover[i] for i in mid) / 81 * 0.15))
    best, at, i = 0, None, 60
    while i <= 140:
        j = i
        while j <= 140 and cover[j] <= limit:
            j += 1
        if j - i > best:
            best, at = j - i, i
        i = max(j, i + 1)
    return None if best < 4 else (at + best / 2) / 200


def test_gutters_equal_brute_force(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for page in range(60):
        spans = []
        for i in range(rng.randint(4, 14)):
            a = rng.randint(20, 500) / 1000
            b = min(0.98, a + rng.randint(50, 700) / 1000)
            spans.append((a, b))
            rows.append(line(i, a, b, 0.9 - i * 0.05, page=page))
        want[page] = gutter_brute(spans)
    got = {r.page_idx: r.gutter for r in layout._gutters(lines(spark, rows).withColumn("skew", F.lit(0.0)), layout.PAGE, TUNING).collect()}
    assert got == {p: pytest.approx(g) for p, g in want.items() if g is not None}


def cluster_brute(ls):
    """Visual rows from the top, then a fold; ls: (no, x0, x1, top, h)."""
    ls = sorted(ls, key=lambda s: (-s[3], s[1], s[0]))
    rows, row = [], 0
    for i, s in enumerate(ls):
        if i:
            p = ls[i - 1]
            over = min(p[3], s[3]) - max(p[3] - p[4], s[3] - s[4])
            row += not over > 0.3 * min(p[4], s[4])
        rows.append((row, s[1], s[0], s))
    order = [r[3] for r in sorted(rows, key=lambda r: r[:3])]
    median = sorted(s[4] for s in order)[len(order) // 2]
    out, para, ext = {}, 0, None
    for i, s in enumerate(order):
        if i:
            p = order[i - 1]
            gap = (p[3] - p[4]) - s[3]
            if gap > median * 0.4 or gap < -median * 0.5 or max(ext[0], s[1]) > min(ext[1], s[2]):
                para, ext = para + 1, None
        ext = (s[1], s[2]) if ext is None else (min(ext[0], s[1]), max(ext[1], s[2]))
        out[s[0]] = para
    return out


def test_paragraphs_equal_brute_force(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for page in range(40):
        ls, top = [], 0.95
        for i in range(rng.randint(1, 15)):
            top -= rng.choice([0.0, 0.019, 0.02, 0.024, 0.05])
            a = rng.randint(1, 700) / 1000
            ls.append((i, a, a + rng.randint(50, 300) / 1000, top, rng.choice([0.018, 0.011, 0.03])))
            rows.append(line(i, ls[-1][1], ls[-1][2], top, ls[-1][4], page=page))
        want |= {(page, n): p for n, p in cluster_brute(ls).items()}
    got = layout.paragraphs(lines(spark, rows), layout.PAGE).collect()
    assert {(r.page_idx, r.line_no): r.para for r in got} == want


def test_merge_passes_thresholds(spark):
    first = lines(spark, [line(0, 0.0, 0.5, 0.9, 0.1)])
    # boxes of the same size moved sideways: an overlap of share s has IoU s / (2 - s)
    shift = lambda iou: 0.5 * (1 - 2 * iou / (1 + iou))
    second = lines(
        spark,
        [line(1, shift(0.09), 0.5 + shift(0.09), 0.9, 0.1), line(2, shift(0.11), 0.5 + shift(0.11), 0.9, 0.1), line(3, 0.0, 0.5, 0.5, 0.1, conf=0.34), line(4, 0.0, 0.5, 0.5, 0.1, conf=0.35)],
    )
    got = layout.merge_passes(first, second)
    assert sorted((r.line_no, r["pass"]) for r in got.collect()) == [(0, 1), (1, 2), (4, 2)]
    assert layout.merge_passes(first, second.limit(0)).count() == 1


def test_iou_bounds(spark):
    rng = random.Random(1)
    rows = []
    for i in range(50):
        a, b = ([rng.random() for _ in range(4)] for _ in range(2))
        rows.append(line(i, min(a[:2]), max(a[:2]), max(a[2:]), abs(a[2] - a[3])) + line(i, min(b[:2]), max(b[:2]), max(b[2:]), abs(b[2] - b[3]))[5:])
    corners = LINE.split(", ")[5:]
    df = spark.createDataFrame(rows, LINE + ", " + ", ".join(f"s_{c}" for c in corners))
    for r in df.select(geo.iou("", "s_").alias("x"), geo.iou("s_", "").alias("y"), geo.iou("", "").alias("z")).collect():
        assert 0 <= r.x <= 1 and r.x == pytest.approx(r.y) and r.z == pytest.approx(1)


@pytest.mark.parametrize("ls, want", [(["ala-", "ma"], "alama"), (["3-", "4"], "3- 4"), (["a", "x-"], "a x-"), (["a", "b"], "a b")])
def test_join_lines(spark, ls, want):
    assert value(spark, strings.join_lines(F.array(*map(F.lit, ls)))) == (want,)


def test_affixes_and_digits(spark):
    t = F.lit("„(Kant1—a),")
    assert value(spark, strings.prefix(t), strings.core(t), strings.suffix(t)) == ("„(", "Kant1—a", "),")
    assert value(spark, strings.core(F.lit("1999."))) == ("",)
    fixed = [strings.digits_to_letters(F.lit(x)) for x in ("a1b", "k0t", "a7b", "abc")]
    assert value(spark, *fixed) == ("aib", "kot", "a7b", "abc")
    assert value(spark, strings.untokens(strings.tokens(F.lit("a  b ")))) == ("a  b ",)
    assert value(spark, strings.citations(F.lit("see (Kant, 1999) and [Hegel 1807], (Moss 1900) but (kant, 1999)")))[0] == ["Kant", "Moss", "Hegel"]
    assert value(spark, strings.custom_words(F.lit("a, b;c\r\n d ,,")))[0] == ["a", "b", "c", "d"]
    assert [tuple(r) for r in value(spark, strings.word_starts(F.lit(" ab a  ab")))[0]] == [("ab", 1), ("a", 4), ("ab", 7)]
    assert value(spark, strings.words(F.lit("one")))[0] == []


def edit_brute(a, b, costs):
    a, b = a.lower(), b.lower()
    row = [10 * j for j in range(len(b) + 1)]
    for i, x in enumerate(a):
        new = [row[0] + 10]
        for j, y in enumerate(b):
            new.append(min(new[j] + 10, row[j + 1] + 10, row[j] + (0 if x == y else costs.get(x + y, 10))))
        row = new
    return row[-1]


def test_weighted_levenshtein(spark):
    rng = random.Random(4)
    costs = {a + b: c for a, b, c in distance.confusion_pairs()}
    words = ["".join(rng.choice("ilrntmoaeöü") for _ in range(rng.randint(0, 7))) for _ in range(60)]
    pairs = [(rng.choice(words), rng.choice(words)) for _ in range(150)]
    df = spark.createDataFrame(pairs, "a string, b string")
    m = distance.confusion_map(distance.confusion_pairs())
    got = df.select("a", "b", distance.weighted_levenshtein(F.col("a"), F.col("b"), m).alias("d"), distance.weighted_levenshtein(F.col("b"), F.col("a"), m).alias("e"), F.levenshtein("a", "b").alias("u")).collect()
    for r in got:
        assert r.d == r.e == edit_brute(r.a, r.b, costs) and r.d <= 10 * r.u and (r.d == 0) == (r.a == r.b)


def test_cosine_guards(spark):
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    got = value(spark, distance.cosine(a(0, 0), a(1, 1)), distance.cosine(a(1), a(1, 2)), distance.cosine(a(1, 2), a(2, 4)), distance.cosine(F.array().cast("array<double>"), F.array().cast("array<double>")))
    assert got == (0, 0, pytest.approx(1), 0)


def scaled_brute(a, n):
    """Rows of a brought to n, one value after another."""
    size = len(a)
    if n > size:
        return [a[i * size // n] for i in range(n)]
    edges = [i * size // n for i in range(n)] + [size]
    return [[sum(a[y][x] for y in range(p, q)) // (q - p) for x in range(len(a[0]))] for p, q in zip(edges, edges[1:])]


def turned(a):
    return [list(r) for r in zip(*a)]


def gutter_of_brute(a):
    scale = min(1.0, 600 / len(a[0]))
    a = turned(scaled_brute(turned(scaled_brute(a, max(1, int(len(a) * scale)))), max(1, int(len(a[0]) * scale))))
    n = len(a[0])
    ink = [sum(255 - r[x] for r in a) for x in range(n)]
    smooth = []
    for x in range(n):
        near = ink[max(0, x - max(2, n // 80)) : x + max(2, n // 80) + 1]
        smooth.append(sum(near) // len(near))
    lo, hi = int(n * 0.45), min(int(n * 0.55), n - 1)
    best = min(range(lo, hi + 1), key=lambda x: (smooth[x], x))
    return int(best / scale + 0.5)


def box_brute(a):
    h, w = len(a), len(a[0])
    g = turned(scaled_brute(turned(scaled_brute(a, 200)), 200))
    out = []
    for size, lines_ in ((w, turned(g)), (h, g)):
        white = [sum(v > 216 for v in line_) > 150 for line_ in lines_]
        first = next((x for x in range(197) if all(white[x : x + 3])), 0)
        last = next((x for x in range(199, 1, -1) if all(white[x - 2 : x + 1])), 199)
        if last - first <= 40:
            return None
        out += [max(0.0, first / 200 * size - size * 0.01), min(size, last / 200 * size + size * 0.01)]
    return out


def test_rasters_equal_brute_force(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for i, (w, h) in enumerate([(40, 30), (160, 60), (1300, 24), (210, 220), (30, 700), (7, 5)]):
        edge, ink = rng.randint(0, w // 6), rng.randint(int(w * 0.46), int(w * 0.5))
        a = [[40 if x < edge else 255 if abs(x - ink) < 2 else rng.choice([230, 250, 250, 250, 90 if i % 2 else 250]) for x in range(w)] for _ in range(h)]
        rows.append((i, w, h, [v for r in a for v in r]))
        want[i] = (gutter_of_brute(a), gutter_of_brute(turned(a)), box_brute(a))
    rows += [(90, 2, 2, [1, 2, 3]), (91, None, 2, None), (92, 0, 0, [])]
    df = spark.createDataFrame(rows, "page_id long, w int, h int, px array<int>")
    assert {r.page_id: r.gutter for r in raster.ink_gutter(df).collect()} == {i: x[0] for i, x in want.items()}
    assert {r.page_id: r.gutter for r in raster.ink_gutter(df, vertical=False).collect()} == {i: x[1] for i, x in want.items()}
    boxes = {r.page_id: [r.left, r.right, r.top, r.bottom] for r in raster.crop_box(df).collect()}
    assert boxes == {i: pytest.approx(x[2]) for i, x in want.items() if x[2]} and boxes


def test_protected_match_equals_brute_force(spark):
    rng = random.Random(8)
    costs = {a + b: c for a, b, c in distance.confusion_pairs()}
    word = lambda: "".join(rng.choice("ilrntmoaeöK") for _ in range(rng.randint(1, 6)))
    cores, names = {word() for _ in range(150)}, {word().capitalize() for _ in range(60)} | {"Kilntri", "Kltiroe"}
    cores |= {n[1:] for n in names} | set(list(names)[:5]) | {"Kiintnl", "kllintei"}
    page = "doc_id long, page_idx int, "
    got = co.protected_match(spark.createDataFrame([(0, 0, c) for c in cores] + [(0, 1, "Kant")], page + "core string"), spark.createDataFrame([(0, 0, n) for n in names], page + "name string"))
    want = {}
    for c in cores:
        near = sorted((c != n, n) for n in names if abs(len(c) - len(n)) <= 1 and (c == n or edit_brute(c, n, costs) == 10))
        # a distance of one between words that differ by two letters in length is impossible
        if near:
            want[c] = (near[0][1], not near[0][0])
    assert {r.core: (r.name, r.exact) for r in got.collect()} == want and sum(not e for _, e in want.values()) > 20


def test_split_at_the_gutter(spark):
    rows = [(0, 0, 800.0, 600.0, 900, 1400, 0, 640), (0, 1, 800.0, 600.0, 1400, 900, 0, 640), (0, 2, 800.0, 600.0, 1000, 990, 0, 500), (0, 3, 600.0, 800.0, 900, 1400, 0, 400), (0, 4, 800.0, 600.0, 1400, 900, 90, 640)]
    df = spark.createDataFrame(rows, "doc_id long, original_idx int, width double, height double, px_w int, px_h int, turn int, gutter int")
    got = [(r.original_idx, r.part, r.part_width, r.logical_idx) for r in layout.split_pages(df).orderBy("logical_idx").collect()]
    assert got == [(0, "L", 640, 0), (0, "R", 760, 1), (1, "L", 640, 2), (1, "R", 760, 3), (2, "P", 1000, 4), (3, "P", 900, 5), (4, "P", 900, 6)]


def test_language_metadata_and_log(spark):
    found = [strings.detect_language(F.lit(x)) for x in ("The end of the day", "der Hund und die Katze", "", "xyz")]
    assert value(spark, *found) == ("en", "de", "pl", "pl")
    kept = strings.metadata_keys(strings.metadata(Title=F.lit("t"), Author=F.lit(None), Pages=F.lit(3)))
    assert value(spark, kept) == ({"Title": "t"},)
    row = spark.createDataFrame([(0, 1, 5, 2, 1, 0.756)], "doc_id long, page_idx int, n_paragraphs int, n_footnote int, n_marginal int, mean_confidence double")
    assert tx.log_line(row).first().line == "page 2: 5 paragraphs (footnotes: 2, marginals: 1), mean confidence 0.76"
    assert value(spark, geo.needs_turn(F.lit(-0.003)), geo.needs_turn(F.lit(0.002)), strings.language_base(F.lit("pl-PL"))) == (True, False, "pl")


def test_empty_pages_in_the_summary(spark):
    pages = spark.createDataFrame([(0, 0), (0, 1)], "doc_id long, page_idx int")
    one = layout.process_pages(lines(spark, [line(0, 0.1, 0.9, 0.9), line(1, 0.1, 0.9, 0.5)]))
    got = {r.page_idx: tuple(r[2:]) for r in layout.page_summary(one, pages).collect()}
    assert got == {0: (2, 2, 0, 0, 2, pytest.approx(0.9)), 1: (0, 0, 0, 0, 0, 0.0)}


def test_crop_decisions(spark):
    d = lambda cw, ch: raster.crop_decision(F.lit(100.0), F.lit(100.0), F.lit(cw), F.lit(ch))
    assert value(spark, d(49.0, 90.0), d(99.0, 99.0), d(55.0, 99.0), d(90.0, 90.0)) == ("too much", "too little", "aspect", "accepted")


LEX = [("en", w, 9) for w in "ala ma kota the cat modern corn com kind ale map".split()]


def lex_of(spark):
    return spark.createDataFrame(LEX, "lang string, word_lower string, freq long")


def split_brute(core, words):
    def solve(i):
        if i == len(core):
            return []
        for n in range(min(12, len(core) - i), 0, -1):
            w = core[i : i + n].lower()
            if (w in words if n > 1 else w in "ai") and (rest := solve(i + n)) is not None:
                return [core[i : i + n], *rest]
        return None

    got = solve(0)
    return " ".join(got) if got and len(got) >= 2 and len(core) / len(got) >= 2.5 else None


def test_split_merged_equals_brute_force(spark):
    rng = random.Random(2)
    words = {w for _, w, _ in LEX}
    cores = {"alamakota", "Alamakota", "themap", "aaaaaa", "theamap", "ALAMAKOTA", "alama1kota", "modern"}
    for _ in range(80):
        cores.add("".join(rng.choice(sorted(words) + ["a", "x"]) for _ in range(rng.randint(2, 5)))[:24])
    df = spark.createDataFrame([("en", c) for c in cores], "lang string, core string")
    got = {r.core: r.parts for r in co.split_merged(df, lex_of(spark)).collect()}
    fit = [c for c in cores if 6 <= len(c) <= 24 and not any(x.isdigit() for x in c) and c.upper() != c and c.lower() not in words]
    want = {c: s for c in fit if (s := split_brute(c, words))}
    assert got == want and got["alamakota"] == "ala ma kota"


def test_candidates_and_correction(spark):
    lex = lex_of(spark)
    cores = spark.createDataFrame([("en", "modem"), ("en", "Corn"), ("en", "tbc"), ("en", "cal"), ("en", "k1nd")], "lang string, core string")
    got = {(r.core, r.candidate) for r in co.grapheme_candidates(cores, lex).collect()}
    assert ("modem", "modern") in got and ("Corn", "Com") in got
    tokens = spark.createDataFrame([(0, 0, 0, i, "en", t) for i, t in enumerate(["(k1nd)", "alamakota", "tlie", "Kanta", "Kant,", "1999.", "THE"])], "doc_id long, page_idx int, line_no int, tok_idx int, lang string, token string")
    names = spark.createDataFrame([(0, 0, "Kant")], "doc_id long, page_idx int, name string")
    out = {r.token: r.corrected for r in co.correct_tokens(tokens, lex, names).collect()}
    assert out == {"(k1nd)": "(kind)", "alamakota": "ala ma kota", "tlie": "the", "Kanta": "Kant", "Kant,": "Kant,", "1999.": "1999.", "THE": "THE"}


def test_context_breaks_ties(spark):
    found = spark.createDataFrame([("en", "cot", "cat"), ("en", "cot", "cut")], "lang string, core string, candidate string")
    vecs = spark.createDataFrame([("cat", [0.0, 1.0]), ("cut", [1.0, 0.0]), ("meat", [1.0, 0.1])], "word string, v array<double>")
    contexts = spark.createDataFrame([("en", "cot", "Meat")], "lang string, core string, word string")
    near = {r.candidate for r in co.nearest(found, distance.confusion_map([("x", "z", 1)])).collect()}
    assert near == {"cat", "cut"}
    costs = co.distance.confusion_pairs
    co.distance.confusion_pairs = lambda: [("x", "z", 1)]
    try:
        assert co.best_candidate(found, contexts, vecs).first().best == "cut"
        assert co.best_candidate(found).first().best == "cat"
    finally:
        co.distance.confusion_pairs = costs


def test_capital_of_sharp_s(spark):
    lex = spark.createDataFrame([("de", "ßge", 9), ("de", "ssge", 9)], "lang string, word_lower string, freq long")
    got = co.grapheme_candidates(spark.createDataFrame([("de", "SSge"), ("de", "ßge")], "lang string, core string"), lex)
    assert {(r.core, r.candidate) for r in got.collect()} == {("SSge", "ßge"), ("ßge", "ssge")}


def test_graphemes_are_no_patterns(spark):
    lex = spark.createDataFrame([("en", "axb", 9)], "lang string, word_lower string, freq long")
    cores = spark.createDataFrame([("en", "a.b"), ("en", "acb")], "lang string, core string")
    assert [(r.core, r.candidate) for r in co.grapheme_candidates(cores, lex, [(".", "x")]).collect()] == [("a.b", "axb")]


def test_correct_pages(spark):
    """Broken words first and as one, then tokens by their first context, names kept, words apart."""
    words = "cat cut meat wool kind modern a the".split()
    lex = spark.createDataFrame([("en", w, 9) for w in words], "lang string, word_lower string, freq long")
    vecs = spark.createDataFrame([("cat", [0.0, 1.0]), ("cut", [1.0, 0.0]), ("meat", [0.1, 1.0]), ("wool", [1.0, 0.1])], "word string, v array<double>")
    rows = [
        (0, 0, 5, 0, 0, "the mod-"),
        (0, 0, 2, 0, 1, "em wool cxt"),
        (0, 0, 1, 1, 0, "meat cxt Kind"),
        (0, 1, 0, 0, 0, "k1nd"),
    ]
    df = spark.createDataFrame([("en", *r) for r in rows], "lang string, doc_id long, page_idx int, line_no int, reading_order int, place int, text string")
    names = spark.createDataFrame([(0, 0, "Kind")], "doc_id long, page_idx int, name string")
    costs = co.distance.confusion_pairs
    co.distance.confusion_pairs = lambda: [("x", "a", 3), ("x", "u", 3), ("m", "n", 3)]
    try:
        got = {(r.page_idx, r.line_no): (r.text, r.words) for r in co.correct_pages(df, lex, names, vecs=vecs).collect()}
    finally:
        co.distance.confusion_pairs = costs
    assert got[0, 5] == ("the mod-", ["the", "mod-"]) and got[0, 2][0] == "ern wool cut"
    assert got[0, 1] == ("meat cut Kind", ["meat", "cut", "Kind"])
    assert got[1, 0] == ("kind", [])


def test_hyphen_repair(spark):
    rows = [(0, 0, "czytam ksią-"), (0, 1, "zka to"), (1, 0, "a one-"), (1, 1, "two-"), (1, 2, "three end"), (2, 0, "x-")]
    df = spark.createDataFrame(rows, "para int, place int, text string")
    fixes = co.hyphen_words(df, ["para"])
    assert {r.merged for r in fixes.collect()} == {"ksiązka", "onetwo-", "twothree"}
    out = {(r.para, r.place): r.text for r in co.hyphen_repair(df, ["para"], fixes.withColumn("fixed", F.upper("merged"))).collect()}
    assert out[0, 0] == "czytam KSIĄ-" and out[0, 1] == "ZKA to" and out[2, 0] == "x-"
    assert out[1, 0] == "a ONE-" and out[1, 2].endswith(" end")


def test_sources(spark, tmp_path):
    docs = spark.createDataFrame([(0, None, 1), (1, "", 1), (3, "a b c d e f g h i", 1), (None, "x", 1)], "doc_id long, text string, text_no int")
    got = src.laid_out(docs).collect()
    assert [(r.doc_id, r.text) for r in got if r.doc_id == 3] == [(3, "a b c d e f g h"), (3, "i")]
    (tmp_path / "w.txt").write_text("one, two;three\nfour,,")
    assert {r.word for r in src.word_list(spark, str(tmp_path / "w.txt")).collect()} == {"one", "two", "three", "four"}
    best = src.top_candidate(spark.createDataFrame([(0, 0, 0, "a", 0.5), (0, 0, 0, "b", 0.7)], "doc_id long, page_idx int, line_no int, text string, confidence double"))
    assert best.first().text == "b"


def test_sidecar_and_validation(spark, tmp_path):
    paras = spark.createDataFrame([(0, 0, 0, "body", "one"), (0, 0, 1, "body", "two"), (0, 0, 2, "footnote", "note"), (0, 0, 3, "marginal", "skip")], "doc_id long, page_idx int, reading_order int, role string, text string")
    block = tx.sidecar_text(paras)
    assert block.first().text == "--- page 1 (source page 1) ---\n\none\n\ntwo\n\n[footnotes]\n\nnote"
    tx.write_sidecar(block, str(tmp_path / "out"))
    assert "two" in spark.read.text(str(tmp_path / "out"), wholetext=True).agg(F.concat_ws("", F.collect_list("value"))).first()[0]
    moved = spark.createDataFrame([(0, 0, 4)], "doc_id long, page_idx int, original_idx int")
    assert tx.sidecar_text(paras, moved).first().text.startswith("--- page 1 (source page 5) ---")
    pages = spark.createDataFrame([(0, 0, " \u2003"), (0, 1, "ab")], "doc_id long, page_idx int, text string")
    assert tuple(tx.searchability(pages).first()) == (0, 2, 1, 2, 0.5)
    expected = spark.createDataFrame([(0, 3)], "doc_id long, n_pages long")
    assert not tx.searchability(pages, expected).first().complete


def test_protected_match_expands_no_keys_into_rows(spark):
    """Rows that the join of a page's words with its names shuffles follow the words, not the keys under which they meet."""
    page = "doc_id long, page_idx int, "
    cores = [(d, 0, f"wort{k}") for d in range(20) for k in range(50)]
    got = co.protected_match(spark.createDataFrame(cores, page + "core string"), spark.createDataFrame([(d, 0, "Wort7") for d in range(20)], page + "name string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert sorted({(r.core, r.name, r.exact) for r in got.collect()}) == sorted([("wort" + str(k), "Wort7", False) for k in range(50) if edit_brute(f"wort{k}", "Wort7", {a + b: c for a, b, c in distance.confusion_pairs()}) == 10])


def test_lines_are_shuffled_once_on_the_way_to_reading_order(spark):
    """The lines and the gutters' spans, each by page; no line is shuffled again to meet its paragraph."""
    page = [line(i, 0.1, 0.9, 0.95 - i * 0.02) for i in range(20)]
    plan = layout.reading_order(layout.line_roles(lines(spark, page)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2


def test_a_small_word_list_is_not_shuffled_to(spark):
    lex = spark.createDataFrame([("en", "tin", 9), ("en", "line", 9)], "lang string, word_lower string, freq long")
    cores = spark.createDataFrame([("en", "lin"), ("en", "iine"), ("en", "zzzz"), ("de", "lin")], "lang string, core string")
    near = lx.at_hand(lex)
    assert "SortMergeJoin" not in lx.valid(cores, near, "core")._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.core for r in co._alike(cores, near).collect()) == ["iine", "lin"]
    few = TUNING.__class__(lexicon_at_hand=1)
    assert lx.at_hand(lex, few) is lex
    want = sorted(map(tuple, co.optical_candidates(cores, lex).collect()))
    assert want == sorted(map(tuple, co.optical_candidates(cores, near).collect())) == [("en", "iine", "line"), ("en", "lin", "tin")]
