"""Word lists from the corpus, validity of words, and word vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TUNING, Tuning
from ..functions import strings


def corpus_cores(docs: DataFrame) -> DataFrame:
    """(lang, core, n): the cores of the documents' tokens with their counts.

    Equal tokens are counted first, so that patterns meet each only once.
    """
    t = docs.select("lang", F.explode(F.split(F.coalesce("text", F.lit("")), r"\s+")).alias("token"))
    t = t.groupBy("lang", "token").agg(F.count("*").alias("n"))
    return t.select("lang", strings.core(F.col("token")).alias("core"), "n").groupBy("lang", "core").agg(F.sum("n").alias("n")).where("core <> ''")


def lexicon(cores: DataFrame, tuning: Tuning = TUNING) -> DataFrame:
    """(lang, word_lower, freq): words of letters only that are frequent enough in their language."""
    letters = cores.where(F.col("core").rlike(r"^\p{L}+$"))
    g = letters.groupBy("lang", F.lower("core").alias("word_lower")).agg(F.sum("n").alias("freq"))
    return g.where(F.col("freq") >= tuning.lexicon_min_count)


def at_hand(lex: DataFrame, tuning: Tuning = TUNING) -> DataFrame:
    """The stored word list, sent to every executor whole if its words are few enough; else joined by key as any table.

    What is looked up (stretches and variants of words) is far more than the list, and so need not be shuffled.
    """
    if lex.count() > tuning.lexicon_at_hand:
        return lex
    out = F.broadcast(lex)
    out.at_hand = True
    return out


def is_at_hand(lex: DataFrame) -> bool:
    return "at_hand" in vars(lex)


def available(lex: DataFrame, languages: list[str]) -> DataFrame:
    """(lang, n_words): how many words the list has for each language asked for, by its base code; none tells that correction
    has nothing to go by."""
    asked = lex.sparkSession.createDataFrame([(x,) for x in dict.fromkeys(languages)], "code string").withColumn("lang", strings.language_base(F.col("code"))).select("lang").distinct()
    words = lex.groupBy("lang").agg(F.count("*").alias("n_words"))
    return asked.join(words, "lang", "left").select("lang", F.coalesce("n_words", F.lit(0)).alias("n_words"))


def shape_ok(word: Column, lang: Column) -> Column:
    """What can be told without a word list: no numbers among letters; words of one letter by language."""
    return ~strings.is_mixed(word) & ((F.length(word) > 1) | strings.single_letter_ok(word, lang))


def valid(words: DataFrame, lex: DataFrame, column: str) -> DataFrame:
    """The rows whose word is valid: of one letter by rule, else in the list of their language, whatever its case.

    The list holds letters only and each word once a language, so one left join decides, without a
    second reading of words.
    """
    known = lex.select(F.col("lang").alias("__lang"), F.col("word_lower").alias("__word"))
    same = (F.col("lang") == F.col("__lang")) & (F.lower(column) == F.col("__word"))
    one = F.length(column) == 1
    good = (one & shape_ok(F.col(column), F.col("lang"))) | (~one & F.col("__word").isNotNull())
    return words.join(known, same, "left").where(good).select(*words.columns)


def vectors(lex: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(word, v): each lexicon word with the embedding whose vec_id is its hash modulo their number, a stand-in for trained ones."""
    n = embeddings.count()
    words = lex.select("word_lower").distinct()
    e = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    place = F.conv(F.substring(F.md5("word_lower"), 1, 8), 16, 10).cast("long") % F.lit(n)
    return words.join(e, place == F.col("vec_id")).select(F.col("word_lower").alias("word"), "v")


def mean_vector(tokens: DataFrame, vecs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, v): element-wise mean of the vectors of each group's words; words without one are skipped.

    A group's vectors (a few context words) meet as arrays and are added up element by element.
    """
    joined = tokens.select(*keys, F.lower("word").alias("__w")).join(vecs, F.col("__w") == F.col("word"))
    g = joined.groupBy(*keys).agg(F.array_sort(F.collect_list("v")).alias("vs"))
    total = F.aggregate(F.slice("vs", F.lit(2), F.greatest(F.size("vs") - 1, F.lit(0))), F.get("vs", F.lit(0)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    return g.select(*keys, F.transform(total, lambda x: x / F.size("vs")).alias("v"))
