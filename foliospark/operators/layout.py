"""Page layout: skew, bands, column gutters, line roles, paragraphs and reading order.

All operators work on one page at a time, so they partition by (doc_id, page_idx); nothing is
collected or broadcast, and a page's lines are bounded by what fits on a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TUNING, Tuning
from ..functions import geometry as geo

PAGE = ["doc_id", "page_idx"]


def upper_median(column: str) -> Column:
    """The element at place count / 2 of the sorted values."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {column} DESC)")


def with_geometry(lines: DataFrame) -> DataFrame:
    return lines.withColumns({"angle": geo.rotation_angle(), "width": geo.width(), "height": geo.height(), "cy": geo.center_y()})


def line_roles(lines: DataFrame, tuning: Tuning = TUNING) -> DataFrame:
    """Adds role: marginal, footnote or body.  Pages of few lines are body throughout."""
    page = Window.partitionBy(*PAGE)
    low, high = tuning.margin_y, 1.0 - tuning.margin_y
    central = (F.col("cy") > low) & (F.col("cy") < high)
    df = with_geometry(lines).withColumns(
        {
            "n": F.count("*").over(page),
            "median": upper_median("height").over(page),
            "top": F.coalesce(F.max(F.when(central, F.col("cy"))).over(page), F.max("cy").over(page)),
            "bottom": F.coalesce(F.min(F.when(central, F.col("cy"))).over(page), F.min("cy").over(page)),
        }
    )
    cy = F.col("cy")
    marginal = ((cy >= high) & (cy > F.col("top"))) | ((cy <= low) & (cy < F.col("bottom")))
    footnote = (cy < tuning.footnote_y) & (F.col("height") < F.col("median") * tuning.footnote_height)
    role = F.when(F.col("n") < tuning.role_min_lines, "body").when(marginal, "marginal").when(footnote, "footnote").otherwise("body")
    return df.withColumn("role", role).select(*lines.columns, "role")


def page_skew(lines: DataFrame) -> DataFrame:
    """Upper median of the lines' angles for each page."""
    return with_geometry(lines).groupBy(*PAGE).agg(upper_median("angle").alias("skew"))


def text_skew(lines: DataFrame, tuning: Tuning = TUNING) -> DataFrame:
    """page_skew, but 0 beyond the limit."""
    limit = F.radians(F.lit(tuning.max_skew_degrees))
    return page_skew(lines).withColumn("skew", F.when(F.abs("skew") > limit, 0.0).otherwise(F.col("skew")))


def orientation(lines: DataFrame, tuning: Tuning = TUNING) -> DataFrame:
    """turn in degrees: 0, 90 or -90 by the sign of the median angle, or 180; pages of few lines stay."""
    g = with_geometry(lines).groupBy(*PAGE).agg(F.count("*").alias("n"), upper_median("angle").alias("angle"))
    size = F.abs("angle")
    turn = (
        F.when(F.col("n") < tuning.orientation_min_lines, 0)
        .when(size >= tuning.orientation_half, 180)
        .when(size > tuning.orientation_quarter, F.when(F.col("angle") > 0, 90).otherwise(-90))
        .otherwise(0)
    )
    return g.select(*PAGE, "n", turn.alias("turn"))


def band_edges(n: int) -> Column:
    """(band, y_min, y_max) of n equal bands, both ends inclusive."""
    step = 1.0 / n
    return F.array(*[F.struct(F.lit(i).alias("band"), F.lit(i * step).alias("y_min"), F.lit(1.0 if i == n - 1 else i * step + step).alias("y_max")) for i in range(n)])


def in_bands(lines: DataFrame, n: int) -> DataFrame:
    """A row for each band a line's centre lies in; a line on an edge lies in two."""
    df = with_geometry(lines).withColumn("b", F.explode(band_edges(n)))
    return df.where((F.col("cy") >= F.col("b.y_min")) & (F.col("cy") <= F.col("b.y_max"))).withColumn("band", F.col("b.band")).drop("b")


def band_skew(lines: DataFrame, tuning: Tuning = TUNING) -> DataFrame:
    """(page, band, y_min, y_max, skew): a band's own skew if it has lines enough, else the page's."""
    own = in_bands(lines, tuning.bands).groupBy(*PAGE, "band").agg(F.count("*").alias("n"), upper_median("angle").alias("own"))
    spine = page_skew(lines).select(*PAGE, "skew", F.explode(band_edges(tuning.bands)).alias("b")).select(*PAGE, "skew", "b.*")
    joined = spine.join(own, [*PAGE, "band"], "left")
    skew = F.when(F.col("n") >= tuning.band_min_lines, F.col("own")).otherwise(F.col("skew"))
    return joined.select(*PAGE, "band", "y_min", "y_max", skew.alias("skew"))


def band_of(cy: Column, n: int) -> Column:
    """The first band that holds cy, else the last."""
    step, out = 1.0 / n, F.lit(n - 1)
    for i in reversed(range(n)):
        out = F.when((cy >= i * step) & (cy <= (1.0 if i == n - 1 else i * step + step)), i).otherwise(out)
    return out


def _gutters(lines: DataFrame, keys: list[str], tuning: Tuning) -> DataFrame:
    """(keys, gutter) of groups of lines that carry their skew; groups without a gutter are left out."""
    spans = with_geometry(lines).where(F.col("width") <= tuning.gutter_max_width).select(*keys, _span(tuning).alias("s"))
    # as many as a group has lines
    groups = spans.groupBy(*keys).agg(F.collect_list("s").alias("spans")).where(F.size("spans") >= tuning.gutter_min_lines)
    # exploded rather than filtered, which would work the fold out twice
    return groups.select(*keys, F.explode(F.array_compact(F.array(_gutter(tuning)))).alias("gutter"))


def _span(tuning: Tuning) -> Column:
    """First and last bin of a line under its page's skew."""
    bins = tuning.gutter_bins
    low, high = geo.deskewed_range(F.col("skew"))
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.when(c < 0, F.ceil(c * bins)).otherwise(F.floor(c * bins)))).cast("int")
    return F.struct(clamp(low).alias("a"), clamp(high).alias("z"))


def _gutter(tuning: Tuning) -> Column:
    """The middle of the longest thin run of spans, null without one: coverage, its limit and the run are folds of the array."""
    bins = tuning.gutter_bins
    middle = F.sequence(F.lit(tuning.gutter_low), F.lit(tuning.gutter_high))
    coverage = F.transform(middle, lambda b: F.size(F.filter("spans", lambda s: (s["a"] <= b) & (s["z"] >= b))))
    total = F.aggregate(coverage, F.lit(0), lambda t, c: t + c)
    share = total / F.lit(float(tuning.gutter_high - tuning.gutter_low + 1)) * tuning.gutter_share
    limit = F.greatest(F.lit(1), F.floor(share)).cast("int")
    zero = F.lit(0)
    # the limit stands in the fold's state, so that it is worked out once
    init = F.struct(limit.alias("limit"), F.lit(tuning.gutter_low).alias("bin"), zero.alias("len"), zero.alias("best"), zero.alias("start"))

    def step(s: Column, c: Column) -> Column:
        length = F.when(c <= s["limit"], s["len"] + 1).otherwise(0)
        longer = length > s["best"]  # of equal runs the first stays
        start = F.when(longer, s["bin"] - length + 1).otherwise(s["start"])
        return F.struct(s["limit"].alias("limit"), (s["bin"] + 1).alias("bin"), length.alias("len"), F.greatest(length, s["best"]).alias("best"), start.alias("start"))

    done = lambda s: F.when(s["best"] >= tuning.gutter_min_run, (s["start"] + s["best"] / 2.0) / F.lit(float(bins)))
    return F.aggregate(coverage, init, step, done)


def mid_skew(lines: DataFrame, tuning: Tuning = TUNING) -> DataFrame:
    """(page, skew) of the middle band over the lines given."""
    return band_skew(lines, tuning).where(F.col("band") == tuning.bands // 2).select(*PAGE, "skew")


def _with_mid_skew(lines: DataFrame, tuning: Tuning) -> DataFrame:
    """Adds __body (lines that count: body lines, or all of a page without any) and skew, as mid_skew over those, by windows
    over the page alone."""
    page = Window.partitionBy(*PAGE)
    band = tuning.bands // 2
    low, high = band / tuning.bands, 1.0 if band == tuning.bands - 1 else band / tuning.bands + 1.0 / tuning.bands
    body = (F.col("role") == "body") | (F.max(F.when(F.col("role") == "body", 1).otherwise(0)).over(page) == 0)
    cy = geo.center_y()
    df = lines.withColumn("__body", body).withColumn("__angle", F.when(F.col("__body"), geo.rotation_angle()))
    df = df.withColumn("__mid", F.when((cy >= low) & (cy <= high), F.col("__angle")))
    skew = F.when(F.count("__mid").over(page) >= tuning.band_min_lines, upper_median("__mid").over(page)).otherwise(upper_median("__angle").over(page))
    return df.withColumn("skew", skew).drop("__angle", "__mid")


def column_gutter(lines: DataFrame, tuning: Tuning = TUNING) -> DataFrame:
    """(page, gutter) of pages with one, from body lines under the middle band's skew."""
    return _gutters(_with_mid_skew(lines, tuning).where("__body"), PAGE, tuning)


def column_assign(lines: DataFrame, tuning: Tuning = TUNING) -> DataFrame:
    """Adds side: L or R of the page's gutter under the middle band's skew; L without a gutter; and gutter."""
    df = _with_mid_skew(lines, tuning)
    narrow = F.col("__body") & (geo.width() <= tuning.gutter_max_width)
    # a page's lines and the spans of those that count meet in one row, so that none has to be shuffled to meet its gutter
    rest = [*(c for c in lines.columns if c not in PAGE), "skew"]
    pages = df.select(*PAGE, F.struct(*rest).alias("l"), F.when(narrow, _span(tuning)).alias("s")).groupBy(*PAGE).agg(F.collect_list("l").alias("ls"), F.collect_list("s").alias("spans"))
    counts = (F.size("spans") >= tuning.gutter_min_lines) & F.col("doc_id").isNotNull() & F.col("page_idx").isNotNull()
    pages = pages.select(*PAGE, "ls", F.when(counts, _gutter(tuning)).alias("gutter"))
    df = pages.select(*PAGE, "gutter", F.explode("ls").alias("l")).select(*PAGE, "l.*", "gutter")
    x = geo.deskewed_center(F.col("skew"))
    side = F.when(F.col("gutter").isNull() | (x < F.col("gutter")), "L").otherwise("R")
    return df.withColumn("side", side).select(*lines.columns, "gutter", "side")


def band_columns(lines: DataFrame, tuning: Tuning = TUNING) -> DataFrame:
    """Adds band and side, with a gutter for each band and the page's where a band has none."""
    bands = band_skew(lines, tuning).select(*PAGE, "band", "skew")
    own = _gutters(in_bands(lines, tuning.bands).join(bands, [*PAGE, "band"]), [*PAGE, "band"], tuning)
    whole = _gutters(lines.join(mid_skew(lines, tuning), PAGE), PAGE, tuning).withColumnRenamed("gutter", "page_gutter")
    df = lines.withColumn("band", band_of(geo.center_y(), tuning.bands)).join(bands, [*PAGE, "band"])
    df = df.join(own, [*PAGE, "band"], "left").join(whole, PAGE, "left")
    gutter = F.coalesce("gutter", "page_gutter")
    side = F.when(gutter.isNull() | (geo.deskewed_center(F.col("skew")) < gutter), "L").otherwise("R")
    return df.withColumn("side", side).select(*lines.columns, "band", "side")


def _extents(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "top": F.greatest("tl_y", "tr_y"),
            "bottom": F.least("bl_y", "br_y"),
            "left": F.least("tl_x", "bl_x"),
            "right": F.greatest("tr_x", "br_x"),
        }
    )


def paragraphs(lines: DataFrame, keys: list[str], tuning: Tuning = TUNING) -> DataFrame:
    """Adds place (order within the group, from 0) and para (paragraph within the group, from 0).

    Lines stand in visual rows: from the top, a line joins the row of the one before if their heights
    overlap by more than row_overlap of the lower one; rows read from the left.  (Pairwise comparison
    of lines is not transitive; rows give one order.)  A paragraph ends at a wide gap, beside its last
    line, or where a line does not touch the paragraph's extent so far; this last rule needs an
    ordered fold, done on the group's array of lines.
    """
    g = Window.partitionBy(*keys)
    down = g.orderBy(F.desc("top"), "tl_x", "line_no")
    df = _extents(with_geometry(lines))
    over = F.least("top", F.lag("top").over(down)) - F.greatest("bottom", F.lag("bottom").over(down))
    low = F.least(F.col("top") - F.col("bottom"), F.lag("top").over(down) - F.lag("bottom").over(down))
    df = df.withColumn("apart", F.when(over > tuning.row_overlap * low, 0).otherwise(1))
    df = df.withColumn("row", F.sum("apart").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    order = g.orderBy("row", "tl_x", "line_no")
    df = df.withColumn("median", upper_median("height").over(g)).withColumn("place", F.row_number().over(order) - 1)
    gap = F.lag("bottom").over(order) - F.col("top")
    broken = (gap > F.col("median") * tuning.paragraph_gap) | (gap < -F.col("median") * tuning.side_by_side)
    df = df.withColumn("broken", F.coalesce(broken, F.lit(False)))
    # whole lines go through the fold, so that none has to be shuffled to meet its paragraph
    rest = [c for c in lines.columns if c not in keys]
    line = F.struct("place", "left", "right", "broken", F.struct(*rest).alias("line"))
    folded = df.groupBy(*keys).agg(F.array_sort(F.collect_list(line)).alias("ls"))
    init = F.struct(F.lit(-1).alias("para"), F.lit(0.0).alias("a"), F.lit(0.0).alias("z"), F.array().cast("array<int>").alias("out"))

    def step(s, x):
        new = (s["para"] < 0) | x["broken"] | (F.greatest(s["a"], x["left"]) > F.least(s["z"], x["right"]))
        para = F.when(new, s["para"] + 1).otherwise(s["para"])
        return F.struct(
            para.alias("para"),
            F.when(new, x["left"]).otherwise(F.least(s["a"], x["left"])).alias("a"),
            F.when(new, x["right"]).otherwise(F.greatest(s["z"], x["right"])).alias("z"),
            F.array_append(s["out"], para).alias("out"),
        )

    paras = folded.select(*keys, "ls", F.aggregate("ls", init, step, lambda s: s["out"]).alias("paras"))
    each = paras.select(*keys, F.explode(F.arrays_zip("ls", "paras")).alias("z"))
    each = each.select(*keys, F.col("z.ls.line.*"), F.col("z.ls.place").alias("place"), F.col("z.paras").alias("para"))
    return each.select(*lines.columns, "place", "para")


GROUP = [*PAGE, "side", "role"]


def reading_order(lines: DataFrame, tuning: Tuning = TUNING) -> DataFrame:
    """Lines with roles to lines with reading_order (of their paragraph on the page) and place in it.

    Left body, footnotes and marginals come before right ones.
    """
    placed = paragraphs(column_assign(lines, tuning), GROUP, tuning)
    rank = F.when(F.col("role") == "body", 0).when(F.col("role") == "footnote", 1).otherwise(2)
    by = Window.partitionBy(*PAGE).orderBy("side", rank, "para")
    return placed.withColumn("reading_order", F.dense_rank().over(by) - 1).select(*lines.columns, "side", "para", "reading_order", "place")


def process_pages(lines: DataFrame, tuning: Tuning = TUNING) -> DataFrame:
    """Recognised lines to laid-out ones: role, side, para, reading_order, place and the page's text skew.

    The whole way of a page from its lines to reading order; all steps share one exchange by page.
    """
    skew = upper_median("__angle").over(Window.partitionBy(*PAGE))
    limit = F.radians(F.lit(tuning.max_skew_degrees))
    df = lines.withColumn("__angle", geo.rotation_angle()).withColumn("text_skew", skew).drop("__angle")
    df = df.withColumn("text_skew", F.when(F.abs("text_skew") > limit, 0.0).otherwise(F.col("text_skew")))
    return reading_order(line_roles(df, tuning), tuning)


def page_summary(lines: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Per page: lines, body, footnotes, marginals, paragraphs (where lines have a reading order) and mean confidence.

    pages: all pages; those without lines have zeros.
    """
    paras = F.count_distinct("reading_order") if "reading_order" in lines.columns else F.lit(0).cast("long")
    counts = {
        "n_lines": F.count("*"),
        "n_body": F.count_if(F.col("role") == "body"),
        "n_footnote": F.count_if(F.col("role") == "footnote"),
        "n_marginal": F.count_if(F.col("role") == "marginal"),
        "n_paragraphs": paras,
        "mean_confidence": F.avg(F.col("confidence").cast("double")),
    }
    out = lines.groupBy(*PAGE).agg(*[c.alias(name) for name, c in counts.items()])
    if pages is not None:
        out = pages.select(*PAGE).distinct().join(out, PAGE, "left")
    return out.select(*PAGE, *[F.coalesce(name, F.lit(0.0 if name == "mean_confidence" else 0)).alias(name) for name in counts])


def merge_passes(primary: DataFrame, secondary: DataFrame, tuning: Tuning = TUNING) -> DataFrame:
    """All primary lines, and confident secondary lines that overlap none of them on their page."""
    p = primary.select(*PAGE, *[F.col(f"{c}_{k}").alias(f"p_{c}_{k}") for c in geo.CORNERS for k in "xy"])
    clash = (F.col("s.doc_id") == F.col("p.doc_id")) & (F.col("s.page_idx") == F.col("p.page_idx")) & (geo.iou("s.", "p.p_") > tuning.second_pass_iou)
    extra = secondary.where(F.col("confidence") >= F.lit(tuning.second_pass_confidence).cast("float")).alias("s").join(p.alias("p"), clash, "left_anti")
    return primary.withColumn("pass", F.lit(1)).unionByName(extra.withColumn("pass", F.lit(2)))


def page_numbers(parts: DataFrame) -> DataFrame:
    """Adds logical_idx: running number of the parts of a document's physical pages."""
    w = Window.partitionBy("doc_id").orderBy("original_idx", "part")
    return parts.withColumn("logical_idx", F.row_number().over(w) - 1)


def split_pages(pages: DataFrame, tuning: Tuning = TUNING) -> DataFrame:
    """(doc_id, original_idx, width, height, px_w, px_h, turn, gutter) to parts with width in pixels: spreads give L and R, others P.

    A page is a spread if it lies landscape and so does its picture (px_w by px_h) once it is upright: a
    picture that stands while its page lies is turned by a quarter, others by turn (degrees).  A spread
    is cut at its gutter, a column of the upright picture.
    """
    landscape = F.col("width") > F.col("height") * tuning.landscape
    swapped = (landscape & (F.col("px_w") < F.col("px_h"))) | F.abs("turn").isin(90, 270)
    upright_w, upright_h = F.when(swapped, F.col("px_h")).otherwise(F.col("px_w")), F.when(swapped, F.col("px_w")).otherwise(F.col("px_h"))
    spread = landscape & (upright_w > upright_h * tuning.landscape)
    parts = F.when(spread, F.array(F.lit("L"), F.lit("R"))).otherwise(F.array(F.lit("P")))
    df = pages.withColumn("__w", upright_w).withColumn("part", F.explode(parts))
    part_width = F.when(F.col("part") == "L", F.col("gutter")).when(F.col("part") == "R", F.col("__w") - F.col("gutter")).otherwise(F.col("__w"))
    return page_numbers(df.withColumn("part_width", part_width).drop("__w"))
