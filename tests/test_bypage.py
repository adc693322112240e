"""Correction page by page against correction by tables of words."""

import random

import pytest
from pyspark.sql import functions as F

from foliospark.config import TUNING
from foliospark.operators import bypage
from foliospark.operators import correction as co
from foliospark.operators import text as tx
from foliospark.plans.queries import QUERIES

LINE = "lang string, doc_id long, page_idx int, line_no int, reading_order int, place int, text string"
ODD = ["", "-", "--", "Straße", "ΣΑΣ", "İlk", "ŒUVRE", "1999.", "k1nd", "(Kant,", "l0ve-", "ﬁne", "Ⅷ", "x𐐀y", "tlie", "Vou", "ét", "rnodern", "a", "„Haus“"]


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(3)
    letters = "ilrntmoaeöäßcéduvw"
    words = {lang: ["".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(150)] for lang in ("en", "de")}
    lex = [(lang, w, 9) for lang, ws in words.items() for w in sorted(set(ws))]

    def token(lang):
        w = rng.choice(words[lang])
        kind = rng.random()
        if kind < 0.35:  # misread
            k = rng.randrange(len(w))
            w = w[:k] + rng.choice(letters + "01") + w[k + 1 :]
        elif kind < 0.5:
            w += rng.choice(words[lang])
        elif kind < 0.58:
            return rng.choice(ODD)
        return rng.choice(["{}", "{}", "{},", "«{}»"]).format(w.capitalize() if rng.random() < 0.3 else w)

    rows = []
    for doc in range(30):
        lang = ("en", "de", None)[min(doc % 9, 2) if doc % 9 == 8 else doc % 2]
        for line in range(12):
            text = " ".join(token(lang or "en") for _ in range(rng.choice((1, 1, 4, 6)))) + rng.choice(("", "-", "-", " (Kant, 1781)"))
            rows.append((lang, doc, doc % 3, 50 - line, line // 4, line % 4, text))
    df = spark.createDataFrame(rows, LINE).localCheckpoint()
    return df, spark.createDataFrame(lex, "lang string, word_lower string, freq long").localCheckpoint()


def _lines(df):
    return sorted((r.doc_id, r.line_no, r.lang, r.text, tuple(r.words)) for r in df.collect())


@pytest.mark.parametrize("flags", [(True, True), (False, True)])
def test_by_page_equals_by_tables(spark, pages, flags):
    df, lex = pages
    names = tx.protected_words(tx.page_text(df), tx.capitalised(df)).localCheckpoint()
    want, shared = _lines(co.correct_pages(df, lex, names, *flags)), bypage.packed(lex)
    assert _lines(bypage.correct_rows(bypage.page_rows(df, names), shared, *flags)) == want
    assert _lines(bypage.correct_rows(bypage.page_rows(df, cited=True), shared, *flags, capitalised=True)) == want
    assert sum(t != s for (_, _, _, t, _), s in zip(want, [r.text for r in df.orderBy("doc_id", "line_no").collect()])) > 50
    text = bypage.corrected_text(bypage.page_rows(df, names), shared, *flags)
    assert sorted(map(tuple, text.collect())) == sorted(map(tuple, tx.page_text(co.correct_pages(df, lex, names, *flags)).collect()))


def test_word_lists_that_are_too_long_are_not_sent(pages):
    assert bypage.packed(pages[1], TUNING.__class__(lexicon_in_pages=10)) is None


@pytest.mark.parametrize("name", ["corrected_pages", "corrected_words"])
def test_corrected_queries_shuffle_documents_only(spark, name):
    """Neither lines nor tokens are shuffled, which took more room than the disk has."""
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "REPARTITION_BY_COL" in plan
