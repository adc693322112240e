"""Running text from ordered lines, page text, draw lists, validation and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import strings
from .layout import PAGE, upper_median


def paragraph_text(ordered: DataFrame) -> DataFrame:
    """Lines with reading_order and place to one row per paragraph: role, n_lines and text without broken words."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda s: s["text"])
    g = ordered.groupBy(*PAGE, "reading_order", "role").agg(F.count("*").alias("n_lines"), lines.alias("lines"))
    return g.select(*PAGE, "reading_order", "role", "n_lines", strings.join_lines(F.col("lines")).alias("text"))


def page_text(ordered: DataFrame) -> DataFrame:
    """All lines of a page in reading order, joined by spaces."""
    lines = F.array_sort(F.collect_list(F.struct("reading_order", "place", "text")))
    return ordered.groupBy(*PAGE).agg(F.array_join(F.transform(lines, lambda s: s["text"]), " ").alias("text"))


def sidecar_text(paragraphs: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Page blocks: a header, body paragraphs, then footnotes under a heading; no marginals.

    The header has the page's number and that of its source page, both from 1.  pages: (page, original_idx) of the
    pages of spreads and the like; without it the two numbers are the same.
    """

    def part(role: str) -> Column:
        chosen = F.collect_list(F.when(F.col("role") == role, F.struct("reading_order", "text")))
        return F.array_join(F.transform(F.array_sort(chosen), lambda s: s["text"]), "\n\n")

    g = paragraphs.groupBy(*PAGE).agg(part("body").alias("body"), part("footnote").alias("notes"))
    source = F.col("page_idx")
    if pages is not None:
        g, source = g.join(pages.select(*PAGE, "original_idx"), PAGE, "left"), F.coalesce("original_idx", "page_idx")
    number = lambda c: (c + 1).cast("string")
    head = F.concat(F.lit("--- page "), number(F.col("page_idx")), F.lit(" (source page "), number(source), F.lit(") ---"))
    notes = F.when(F.col("notes") != "", F.concat(F.lit("[footnotes]\n\n"), F.col("notes")))
    body = F.when(F.col("body") != "", F.col("body"))
    return g.select(*PAGE, F.concat_ws("\n\n", head, body, notes).alias("text"))


def write_sidecar(pages: DataFrame, path: str) -> None:
    """Text files of page blocks; a file holds whole documents, their pages in order, and files follow document order."""
    ordered = pages.repartitionByRange("doc_id").sortWithinPartitions(*PAGE)
    ordered.select(F.concat("text", F.lit("\n")).alias("value")).write.text(path)


def font_size(height: Column, metric: Column) -> Column:
    """Of a line height: over the font's ascent and descent at one point, or the height itself without a metric."""
    return F.when(metric > 0, height / metric).otherwise(height)


def word_boxes(lines: DataFrame) -> DataFrame:
    """Adds boxes: of each word of a line its index, text and corners, as long a part of the line as it is of its characters.

    This stands in for boxes that a recogniser gives; a line of one word has none.
    """
    n = F.length("text")

    def box(w: Column, i: Column) -> Column:
        a, z = w["start"] / n, (w["start"] + F.length(w["word"])) / n
        corners = []
        for side, (left, right) in (("t", ("tl", "tr")), ("b", ("bl", "br"))):
            for end, f in (("l", a), ("r", z)):
                corners += [(F.col(f"{left}_{k}") + (F.col(f"{right}_{k}") - F.col(f"{left}_{k}")) * f).alias(f"{side}{end}_{k}") for k in "xy"]
        return F.struct(i.alias("i"), w["word"].alias("word"), *corners)

    return lines.withColumn("boxes", F.transform(strings.word_starts(F.col("text")), box))


def draw_list(ordered: DataFrame, geometry: Column, metric: float = 1.0, char_width: float = 0.5) -> DataFrame:
    """Runs of a text layer at their mapped places and angles, with one font size a paragraph.

    Lines with boxes (see word_boxes) give a run for each word, all but the last followed by a space, unless a word
    lacks its box; other lines are one run.  The size is the upper median of the paragraph's mapped line heights, in
    half points from 4 to 72.  scale stretches a run to its box: the box's width over the text's natural one, which is
    char_width of the font size for each character.  Empty texts and empty boxes are left out.
    """
    whole = F.struct(F.lit(-1).alias("i"), F.col("text").alias("word"), *[F.col(f"{c}_{k}").alias(f"{c}_{k}") for c in geo.CORNERS for k in "xy"])
    df = ordered if "boxes" in ordered.columns else ordered.withColumn("boxes", F.array().cast(f"array<struct<i:int,word:string,{','.join(f'{c}_{k}:double' for c in ('tl', 'tr', 'bl', 'br') for k in 'xy')}>>"))
    df = df.withColumn("g", geometry)
    q = geo.mapped_quad(F.col("g"))
    df = df.select("*", *[c.alias(f"m_{n}") for n, c in q.items()]).withColumn("m_height", geo.height("m_"))
    median = upper_median("m_height").over(Window.partitionBy(*PAGE, "reading_order"))
    raw = font_size(median, F.lit(metric))
    df = df.withColumn("font_size", F.greatest(F.least(F.round(raw * 2) / 2, F.lit(72.0)), F.lit(4.0)))
    complete = (F.size("boxes") > 0) & ~F.exists("boxes", lambda b: b["tl_x"].isNull())
    runs = F.when(complete, F.transform("boxes", lambda b: F.struct(b["i"].alias("i"), F.concat(b["word"], F.when(b["i"] < F.size("boxes") - 1, " ").otherwise("")).alias("word"), *[b[f"{c}_{k}"].alias(f"{c}_{k}") for c in geo.CORNERS for k in "xy"])))
    df = df.select(*PAGE, "reading_order", "place", "g", "font_size", F.explode(F.coalesce(runs, F.array(whole))).alias("r"))
    df = df.select(*PAGE, "reading_order", "place", "g", "font_size", F.col("r.i").alias("run"), F.col("r.word").alias("text"), *[F.col(f"r.{c}_{k}").alias(f"{c}_{k}") for c in geo.CORNERS for k in "xy"])
    df = df.select("*", *[c.alias(f"m_{n}") for n, c in q.items()])
    df = df.withColumns({"height": geo.height("m_"), "width": geo.width("m_"), "angle": geo.rotation_angle("m_")})
    df = df.where((F.col("text") != "") & (F.col("width") > 0) & (F.col("height") > 0))
    scale = F.col("width") / (F.length("text") * F.col("font_size") * char_width)
    return df.select(*PAGE, "reading_order", "place", "run", "text", F.col("m_bl_x").alias("x"), F.col("m_bl_y").alias("y"), "angle", "width", "font_size", scale.alias("scale"))


def searchability(pages: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Per document: pages, pages with text that is not blank, their characters and share, and whether there are as many
    pages as expected (doc_id, n_pages), if told."""
    has = strings.trim_all(F.col("text")) != ""
    g = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.count_if(has).alias("n_text_pages"), F.coalesce(F.sum(F.when(has, F.length("text"))), F.lit(0)).alias("n_chars"))
    g = g.withColumn("ratio", F.try_divide(F.col("n_text_pages").cast("double"), F.col("n_pages").cast("double")))
    if expected is None:
        return g
    wanted = expected.select("doc_id", F.col("n_pages").alias("__wanted"))
    return g.join(wanted, "doc_id", "left").withColumn("complete", F.col("n_pages").eqNullSafe(F.col("__wanted"))).drop("__wanted")


def log_line(summary: DataFrame) -> DataFrame:
    """(page, line): a page summary in words."""
    text = F.format_string("page %d: %d paragraphs (footnotes: %d, marginals: %d), mean confidence %.2f", F.col("page_idx") + 1, "n_paragraphs", "n_footnote", "n_marginal", "mean_confidence")
    return summary.select(*PAGE, text.alias("line"))


def tokens(lines: DataFrame) -> DataFrame:
    """One row per token of each line, empties kept, with its index."""
    return lines.select(*PAGE, "line_no", F.posexplode(strings.tokens(F.col("text"))).alias("tok_idx", "token"))


def token_affixes(lines: DataFrame) -> DataFrame:
    t = F.col("token")
    return tokens(lines).withColumns({"prefix": strings.prefix(t), "core": strings.core(t), "suffix": strings.suffix(t)})


def protected_words(pages: DataFrame, entities: DataFrame | None = None, custom: list[str] | None = None) -> DataFrame:
    """(page, name): names cited on the page, its entities, and custom words (a list written by hand) on every page."""
    names = strings.citations(F.col("text"))
    if custom:
        names = F.concat(names, F.array(*map(F.lit, custom)))
    out = pages.select(*PAGE, F.explode(names).alias("name"))
    if entities is not None:
        out = out.unionByName(entities.select(*PAGE, "name"))
    return out.distinct()


def name_index(names: DataFrame) -> DataFrame:
    """Distinct names longer than two characters, with how many pages hold them."""
    return names.where(F.length("name") > 2).groupBy("name").agg(F.count_distinct(*PAGE).alias("n_pages"))


def capitalised(lines: DataFrame) -> DataFrame:
    """(page, name): capitalised words longer than two characters, a stand-in for recognised entities."""
    t = token_affixes(lines).where(F.col("core").rlike(r"^\p{Lu}\p{Ll}{2,}$"))
    return t.select(*PAGE, F.col("core").alias("name")).distinct()
