"""Column functions on tokens and lines of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LETTER = r"\p{IsAlphabetic}"
_AFFIX = rf"(?s)^([^{_LETTER}]*)({_LETTER}(?:.*{_LETTER})?)([^{_LETTER}]*)$"
#: Digits that OCR puts for letters; 7 stays.
DIGITS, DIGIT_LETTERS = "108356924", "iobesbgza"
#: Letters with diacritics, each before its plain letter.
_FOLDS = "äa öo üu ßs çc èe ée êe ëe àa âa áa íi îi ïi óo ôo ñn úu ûu ùu ąa ćc ęe łl ńn śs źz żz ÄA ÖO ÜU ÇC ÈE ÉE ÊE ÍI ÓO ÑN ĄA ĆC ĘE ŁL ŃN ŚS ŹZ ŻZ"
ACCENTED, FOLDED = ("".join(p[k] for p in _FOLDS.split()) for k in (0, 1))
#: Words of one letter.
SINGLE = {"pl": "aiouwz", "en": "ai"}


def tokens(text: Column) -> Column:
    """Split on single spaces, empties kept, so that untokens gives the text back."""
    return F.split(text, " ", -1)


def untokens(parts: Column) -> Column:
    return F.array_join(parts, " ")


def words(text: Column) -> Column:
    """Pieces between spaces without empties; the empty list if there are fewer than two."""
    found = F.filter(F.split(text, " ", -1), lambda w: w != "")
    return F.when(F.size(found) >= 2, found).otherwise(F.array().cast("array<string>"))


def word_starts(text: Column) -> Column:
    """(word, start) of each of words(text), located from the end of the one before, from 0."""
    init = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<word:string,start:int>>").alias("out"))

    def step(state, word):
        at = F.call_function("locate", word, text, state["at"])
        return F.struct((at + F.length(word)).alias("at"), F.array_append(state["out"], F.struct(word.alias("word"), (at - 1).alias("start"))).alias("out"))

    return F.aggregate(words(text), init, step, lambda s: s["out"])


def prefix(token: Column) -> Column:
    return F.regexp_extract(token, _AFFIX, 1)


def core(token: Column) -> Column:
    """From the first to the last letter; empty without letters."""
    return F.regexp_extract(token, _AFFIX, 2)


def suffix(token: Column) -> Column:
    return F.regexp_extract(token, _AFFIX, 3)


def fold(text: Column) -> Column:
    """Without diacritics; case stays."""
    return F.translate(text, ACCENTED, FOLDED)


def is_suspicious(text: Column) -> Column:
    """Holds a number character, a dotless i or a ligature."""
    return text.rlike(r"[\p{N}ıﬁﬂ]")


def digits_to_letters(text: Column) -> Column:
    return F.when(is_suspicious(text), F.translate(text, DIGITS, DIGIT_LETTERS)).otherwise(text)


def is_upper(text: Column) -> Column:
    return F.upper(text) == text


def is_all_digits(text: Column) -> Column:
    return text.rlike("^[0-9]+$")


def is_mixed(text: Column) -> Column:
    """Holds a number and a letter, so it is no word."""
    return text.rlike(r"\p{N}") & text.rlike(_LETTER)


def single_letter_ok(word: Column, lang: Column) -> Column:
    """Whether a word of one letter is one in its language; other languages take any."""
    ok = F.lit(True)
    for code, letters in SINGLE.items():
        ok = F.when(lang == code, F.lower(word).isin(*letters)).otherwise(ok)
    return ok


def recased(word: Column, like: Column) -> Column:
    """word with a capital first if like has one."""
    first = F.substring(like, 1, 1)
    capital = (F.upper(first) == first) & (F.lower(first) != first)
    return F.when(capital, F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, 2, 1 << 30))).otherwise(word)


def join_lines(lines: Column) -> Column:
    """Lines of a paragraph as running text; a hyphen after a letter at a line's end goes with the break."""
    return F.translate(F.regexp_replace(F.array_join(lines, "\n"), rf"(?<={_LETTER})-\n", ""), "\n", " ")


def language_base(code: Column) -> Column:
    return F.split(code, "-")[0]


def trim_all(text: Column) -> Column:
    """Without Unicode white space at either end."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def citations(text: Column) -> Column:
    """Names of `(Name, 1999)`, `(Name 1999)` and `[Name 1999]`."""
    name = r"(\p{Lu}[\p{L}'-]+)"
    return F.concat(
        F.regexp_extract_all(text, F.lit(rf"\({name},? \d{{4}}\)"), F.lit(1)),
        F.regexp_extract_all(text, F.lit(rf"\[{name},? \d{{4}}\]"), F.lit(1)),
    )


def custom_words(text: Column) -> Column:
    """Entries of a word list split at commas, semicolons and line ends, trimmed, empties dropped."""
    return F.filter(F.transform(F.split(text, "[,\n\r;]"), trim_all), lambda w: w != "")


def metadata_keys(meta: Column) -> Column:
    """The five document properties a sink keeps."""
    return F.map_filter(meta, lambda k, v: k.isin("Title", "Author", "Subject", "Keywords", "Creator"))


#: Frequent short words, by which a language is told.
STOP_WORDS = {
    "de": ["der", "die", "und", "den", "das", "ist", "mit", "ein"],
    "en": ["the", "and", "of", "to", "in", "is", "that", "for"],
    "es": ["el", "los", "y", "del", "las", "con", "por", "una"],
    "fr": ["le", "les", "et", "des", "du", "est", "dans", "une"],
    "pl": ["i", "w", "nie", "na", "z", "do", "jest", "to"],
}


def detect_language(text: Column, default: str = "pl", stop_words: dict[str, list[str]] | None = None) -> Column:
    """The language most of whose stop words occur in the text, counted each time; the first by code of equals, the default without any."""
    found = F.split(F.lower(text), r"[^\p{L}]+")

    def vote(code: str, ws: list[str]) -> Column:
        return F.struct((-F.size(F.filter(found, lambda w: w.isin(*ws)))).alias("n"), F.lit(code).alias("code"))

    votes = [vote(code, ws) for code, ws in sorted((stop_words or STOP_WORDS).items())]
    best = F.array_min(F.array(*votes))
    return F.when(best["n"] < 0, best["code"]).otherwise(F.lit(default))


def metadata(**properties: Column) -> Column:
    """Document properties as a map of strings, those without a value left out."""
    pairs = F.map_from_arrays(F.array(*map(F.lit, properties)), F.array(*[c.cast("string") for c in properties.values()]))
    return F.map_filter(pairs, lambda k, v: v.isNotNull())
