"""Command line: lays out documents or OCR lines and writes text, names and a summary.

    python -m foliospark.cli INPUT OUTPUT [--lines] [--lang a,b] [--sidecar DIR] [--customwords LIST]
        [--fix-diacritics] [--split-merged-words] [--names DIR]

INPUT is a Parquet table of documents (doc_id, text) or, with --lines, of OCR lines.  Options on
rasters and rendering (--dpi, --upscale, --despeckle, --autocrop..., --nosplit, --color, --lossless)
concern images, which enter here only as tables; they are accepted and kept in the configuration.
"""

from __future__ import annotations

import argparse
import warnings
from dataclasses import dataclass, field


#: A list for one's own words; every page is compared with each.
MAX_CUSTOM_WORDS = 10_000


@dataclass(frozen=True)
class Config:
    input: str
    output: str
    lines: bool = False
    languages: list[str] = field(default_factory=lambda: ["pl-PL"])
    sidecar: str | None = None
    custom_words: str | None = None
    fix_diacritics: bool = False
    split_merged_words: bool = False
    names: str | None = None
    images: dict = field(default_factory=dict)


def parse(argv: list[str] | None = None) -> Config:
    p = argparse.ArgumentParser(prog="foliospark")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--lines", action="store_true")
    p.add_argument("--lang", default="pl-PL")
    p.add_argument("--sidecar")
    p.add_argument("--customwords")
    p.add_argument("--names")
    for flag in ("fix-diacritics", "split-merged-words"):
        p.add_argument(f"--{flag}", action="store_true")
    p.add_argument("--dpi", type=float, default=300.0)
    p.add_argument("--upscale", type=float, default=1.0)
    p.add_argument("--autocrop-padding", type=float, default=0.01)
    p.add_argument("--autocrop-threshold", type=float, default=0.85)
    for flag in ("despeckle", "nlp", "autocrop", "nosplit", "color", "lossless"):
        p.add_argument(f"--{flag}", action="store_true")
    a, _ = p.parse_known_args(argv)  # unknown flags are ignored
    images = {k: getattr(a, k) for k in ("dpi", "upscale", "autocrop_padding", "autocrop_threshold", "despeckle", "nlp", "autocrop", "nosplit", "color", "lossless")}
    return Config(a.input, a.output, a.lines, a.lang.split(","), a.sidecar, a.customwords, a.fix_diacritics, a.split_merged_words, a.names, images)


def run(spark, config: Config) -> None:
    """Writes the page summary to output; sidecar text and the name index if asked for."""
    from pyspark.sql import functions as F

    from .functions import strings
    from .operators import correction, layout, lexicon, text
    from .sources import lines as src
    from .sources import storage

    table = spark.read.parquet(config.input)
    lines = src.recognised(table if config.lines else src.laid_out(table))
    lang = strings.language_base(F.lit(config.languages[0]))
    work = f"{config.output}.work"

    def stored(df, name):
        """Later steps read a table, not the whole plan behind it, many times over."""
        df.write.mode("overwrite").parquet(f"{work}/{name}")
        return spark.read.parquet(f"{work}/{name}")

    ordered = stored(layout.process_pages(lines).withColumn("lang", lang), "ordered")
    names = None
    if config.custom_words or config.names or config.fix_diacritics or config.split_merged_words:
        custom = []
        if config.custom_words and config.custom_words.endswith(".txt"):
            words = src.word_list(spark, config.custom_words)
            if words.count() > MAX_CUSTOM_WORDS:
                raise ValueError(f"more than {MAX_CUSTOM_WORDS} custom words; give such names as an entities table")
            custom = [r.word for r in words.collect()]
        elif config.custom_words:
            custom = [w.strip() for w in config.custom_words.split(",") if w.strip()]
        names = stored(text.protected_words(text.page_text(ordered), custom=custom), "names")
    if config.fix_diacritics or config.split_merged_words:
        lex = stored(lexicon.lexicon(lexicon.corpus_cores(ordered.select("lang", "text"))), "lexicon")
        for row in lexicon.available(lex, config.languages[:1]).where("n_words = 0").collect():
            warnings.warn(f"no words of language {row.lang} to correct by")
        fixed = stored(correction.correct_pages(ordered, lex, names, config.fix_diacritics, config.split_merged_words), "corrected")
        ordered = ordered.drop("text").join(fixed.select(*layout.PAGE, "line_no", "text"), [*layout.PAGE, "line_no"])
    layout.page_summary(ordered).write.mode("overwrite").parquet(config.output)
    if config.sidecar:
        text.write_sidecar(text.sidecar_text(text.paragraph_text(ordered)), config.sidecar)
    if config.names and names is not None:
        text.name_index(names).orderBy("name").select("name").write.mode("overwrite").text(config.names)
    storage.delete(spark, work)


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    run(SparkSession.builder.appName("foliospark").getOrCreate(), parse(argv))


if __name__ == "__main__":
    main()
