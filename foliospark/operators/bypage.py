"""Correction page by page, with the word list at hand.

The same corrections as in correction.py, for corpora whose tokens are too many to be shuffled to a table of
corrected words: a page is one row with its lines, and what becomes of a word is worked out where it stands,
once for each worker that meets it as long as it is remembered.  Nothing is shuffled and nothing is stored.
"""

from __future__ import annotations

import uuid
import zlib
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import TUNING, Tuning
from ..functions import distance, strings
from . import correction as co
from .layout import PAGE

#: Classes of characters that the expressions on strings name, each a bit of a character's entry.
_CLASSES = (r"\p{IsAlphabetic}", r"\p{Lu}", r"\p{Ll}", r"\p{N}", r"\p{N}ıﬁﬂ")
LETTER, CAPITAL, SMALL, NUMBER, SUSPICIOUS = (1 << k for k in range(len(_CLASSES)))
#: Words remembered by each memo of a worker.
_MEMO = 1 << 16


@lru_cache(1)
def _char_classes() -> bytes:
    """For each code point its classes, as Spark's regular expressions have them."""
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    found = SparkSession.active().createDataFrame([(every,)], "s string").select(*[F.regexp_replace("s", f"[^{c}]+", "").alias(f"c{k}") for k, c in enumerate(_CLASSES)]).first()
    table = bytearray(0x110000)
    for k, chars in enumerate(found):
        for c in chars:
            table[ord(c)] |= 1 << k
    return zlib.compress(bytes(table))


def packed(lex: DataFrame, tuning: Tuning = TUNING):
    """The stored word list for every worker, a broadcast of its Arrow form; None if its words are too many for that."""
    if lex.count() > tuning.lexicon_in_pages:
        return None
    words = lex.where("lang is not null").select("lang", "word_lower").toArrow()
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, words.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(words)
    return lex.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, sink.getvalue().to_pybytes(), _char_classes()))


class _Language:
    """A language's words, and what tells quickly that a core has no word near it."""

    def __init__(self, words: list[str], named: dict[int, str]):
        self.words = set(words)
        self.named = named
        self.folds: dict[str, list[str]] = {}
        self.mask = (1 << max(16, (96 * len(words)).bit_length())) - 1
        self.bits = bytearray((self.mask >> 3) + 1)
        fold = str.maketrans(strings.ACCENTED, strings.FOLDED)
        for w in words:
            f = w.translate(fold).lower()
            if f != w:
                self.folds.setdefault(f, []).append(w)
            for h in self._places(w):
                self.bits[h >> 3] |= 1 << (h & 7)

    def _places(self, low: str) -> list[int]:
        """A word by its confusion classes and one third of its letters; words two letters apart have one such key in common."""
        name, n = low.translate(self.named), len(low)
        a, b = n // 3, 2 * n // 3
        return [hash((0, low[:a], name)) & self.mask, hash((1, low[a:b], name)) & self.mask, hash((2, low[b:], name)) & self.mask]

    def maybe_alike(self, low: str) -> bool:
        bits = self.bits
        a, b, c = self._places(low)
        return bool(bits[a >> 3] >> (a & 7) & 1 or bits[b >> 3] >> (b & 7) & 1 or bits[c >> 3] >> (c & 7) & 1)


def _initcap(name: str) -> str:
    low = name.lower()
    return low[:1].title() + low[1:]


def _put(word: str, sub: tuple[int, int, str]) -> str:
    _, i, rep = sub
    return word[:i] + rep + word[i + 1 :]


def _plain(word: str, low: str) -> bool:
    """Whether the parts of word, lower-cased apart, are the parts of low."""
    return low.isascii() or (len(low) == len(word) and "Σ" not in word)


class Corrector:
    """What becomes of a word, by the rules of correction.word_corrections without contexts."""

    def __init__(self, words: pa.Table, classes: bytes, fix_diacritics: bool = True, split_words: bool = True, tuning: Tuning = TUNING):
        self.classes, self.tuning, self.table, self.langs = classes, tuning, words, {}
        self.fix_diacritics, self.split_words = fix_diacritics, split_words
        pairs = distance.confusion_pairs()
        self.costs = {(a, b): cost for a, b, cost in pairs}
        self.by: dict[str, list[tuple[int, str]]] = {}
        for a, b, cost in pairs:
            self.by.setdefault(a, []).append((cost, b))
        self.named = str.maketrans(*co._classes(pairs))
        self.digits, self.fold = str.maketrans(strings.DIGITS, strings.DIGIT_LETTERS), str.maketrans(strings.ACCENTED, strings.FOLDED)
        self.known = lru_cache(2 * _MEMO)(self._known)
        self.new = lru_cache(_MEMO)(self._new)
        self.letters = lru_cache(_MEMO)(self.valid)  # for words of one letter
        self.near = co.matcher(pairs)
        self.keys = self.near.keys.__wrapped__  # remembered with the token

    def language(self, lang: str) -> _Language:
        if lang not in self.langs:
            self.langs[lang] = _Language(self.table["word_lower"].filter(pc.equal(self.table["lang"], lang)).to_pylist(), self.named)
        return self.langs[lang]

    def has(self, c: str, kind: int) -> int:
        return self.classes[ord(c)] & kind

    def _known(self, lang: str | None, token: str) -> tuple:
        """What holds for a token on any page: its core, whether that is a capitalised word longer than two characters, the
        keys under which it meets names, and the token as corrected if no name is near."""
        classes, a, z = self.classes, 0, len(token)
        while a < z and not classes[ord(token[a])] & LETTER:
            a += 1
        while a < z and not classes[ord(token[z - 1])] & LETTER:
            z -= 1
        core = token[a:z]
        if not core:
            return "", False, (), token
        name = len(core) > 2 and classes[ord(core[0])] & CAPITAL and all(classes[ord(c)] & SMALL for c in core[1:])
        return core, bool(name), self.keys(core), token if lang is None else token[:a] + self.new(lang, core) + token[z:]

    def valid(self, word: str, lang: str) -> bool:
        if len(word) != 1:
            return word.lower() in self.language(lang).words
        mixed = self.has(word, NUMBER) and self.has(word, LETTER)
        return not mixed and (lang not in strings.SINGLE or word.lower() in strings.SINGLE[lang])

    def replaced(self, word: str) -> str:
        got = co.REPLACEMENTS.get(word.lower())
        if got is None:
            return word
        first = word[:1]
        return got[:1].upper() + got[1:] if first.upper() == first != first.lower() else got

    def graphemes(self, core: str, lang: str) -> list[str]:
        low, found = core.lower(), {}
        for src, dst in co.GRAPHEMES:
            if src not in low:
                continue
            parts = low.split(src)
            at = -len(src)
            for part in parts[:-1]:
                at += len(src) + len(part)
                first, capital = core[at : at + 1], dst[:1].upper()
                put = capital + dst[1:] if first.lower() != first and len(capital) == 1 else dst
                variant = core[:at] + put + core[at + len(src) :]
                if variant != core and variant not in found and self.valid(variant, lang):
                    found[variant] = True
        return list(found)[: self.tuning.grapheme_limit]

    def substituted(self, core: str, lang: str) -> list[str]:
        """Valid words one, then two substitutions away."""
        words, limit, low = self.language(lang).words, self.tuning.candidate_limit, core.lower()
        if _plain(core, low) and not self.language(lang).maybe_alike(low):
            return []
        subs = sorted((cost, i, rep.upper() if c.lower() != c else rep) for i, c in enumerate(core) for cost, rep in self.by.get(c.lower(), ()))[: self.tuning.substitution_limit]
        # words are looked up in lower case, and only those found are written as the core is
        plain = _plain(core, low)
        base, reps = (low, [(i, rep.lower()) for _, i, rep in subs]) if plain else (core, [(i, rep) for _, i, rep in subs])
        one, two = {}, {}
        for k, (i, rep) in enumerate(reps):
            put = base[:i] + rep + base[i + 1 :]
            if (put if plain else put.lower()) in words:
                one.setdefault(_put(core, subs[k]), k)
            for m, (j, other) in enumerate(reps[k + 1 :], k + 1):
                if i != j:
                    both = put[:j] + other + put[j + 1 :]
                    if (both if plain else both.lower()) in words:
                        two.setdefault(_put(_put(core, subs[k]), subs[m]), k)
        return [*dict.fromkeys([*list(one)[:limit], *list(two)[:limit]])]

    def candidates(self, core: str, lang: str) -> list[str]:
        optical = list(dict.fromkeys([*self.graphemes(core, lang), *self.substituted(core, lang)]))[: self.tuning.candidate_limit]
        known, f = self.language(lang), core.translate(self.fold).lower()
        same = list(known.folds.get(f, ()))
        if f in known.words and f.translate(self.fold).lower() == f:
            same.append(f)
        return list(dict.fromkeys([*optical, *(w for w in same if w != core)]))

    def spelt(self, core: str, lang: str) -> str:
        plain = core.isascii() and core.isalpha()
        norm = core if plain or not any(self.has(c, SUSPICIOUS) for c in core) else core.translate(self.digits)
        if len(norm) < 3 or norm.upper() == norm:
            return core
        if self.valid(norm, lang):
            return norm
        found = self.candidates(norm, lang)
        if len(found) < 2:
            return found[0] if found else norm
        return min((distance.weighted_tenths(norm, w, self.costs), w) for w in found)[1]

    def split(self, core: str, lang: str) -> str:
        n, low = len(core), core.lower()
        t = self.tuning
        if not t.split_min_length <= n <= t.split_max_length or (not core.isalpha() and any("0" <= c <= "9" for c in core)) or core.upper() == core or self.valid(core, lang):
            return core
        words, plain = self.language(lang).words, _plain(core, low)
        most, letters = t.split_max_segment, self.letters
        longest = [0] * n + [1]  # at each place the longest stretch from which the rest can be split; the end has the empty one
        for i in range(n - 1, -1, -1):
            for z in range(min(i + most, n), i, -1):
                if longest[z] and (letters(core[i], lang) if z == i + 1 else low[i:z] in words if plain else self.valid(core[i:z], lang)):
                    longest[i] = z - i
                    break
        parts, i = [], 0
        while longest[0] and i < n:
            parts.append(core[i : i + longest[i]])
            i += longest[i]
        return " ".join(parts) if len(parts) > 1 and n / len(parts) >= t.split_min_mean else core

    def _new(self, lang: str, core: str) -> str:
        word = self.replaced(core)
        if self.fix_diacritics:
            word = self.spelt(word, lang)
        if self.split_words:
            word = self.split(word, lang)
        return self.replaced(word)

    def page(self, lines: list[tuple], cited: list[str], capitalised: bool, wanted: tuple[str, ...], cased: dict[str, str]) -> list[dict]:
        """Text and words of each of a page's lines (lang, reading_order, place, text), which stand in that order.

        cited: the page's protected words; cased: those and capitalised words as they are written for a capital core.
        """
        known = self.known
        split = [None if text is None else text.split(" ") for _, _, _, text in lines]
        names = set(cited)
        if capitalised:
            tokens: dict[str | None, set[str]] = {}
            for (lang, *_), ts in zip(lines, split):
                tokens.setdefault(lang, set()).update(ts or ())
            names.update([k[0] for lang, found in tokens.items() for t in found if (k := known(lang, t))[1]])
        near = self.near(names)

        class Done(dict):
            """Tokens as corrected on this page, each worked out once."""

            def __init__(self, lang: str | None):
                self.lang = lang

            def __missing__(self, token: str) -> str:
                core, _, keys, got = known(self.lang, token)
                if core in names:
                    got = token
                elif core and (name := near(core, keys)) is not None:
                    a = token.index(core)
                    capital = core[0].lower() != core[0]
                    got = token[:a] + (cased.get(name) or _initcap(name) if capital else name.lower()) + token[a + len(core) :]
                self[token] = got
                return got

        memo = {lang: Done(lang) for lang in {lang for lang, *_ in lines}}
        out = [{} for _ in lines]
        if "text" in wanted:
            fixes, before = {}, {}
            for (lang, order, _, _), ts in zip(lines, split):
                last = before.get((lang, order))
                if last and last[-1].endswith("-") and ts:
                    merged = last[-1][:-1] + ts[0]
                    fixes[order, merged] = memo[lang][merged]
                before[lang, order] = ts
            rows, at = [], None
            for (_, order, _, _), ts in zip(lines, split):
                if order != at:
                    at, prev = order, None
                if prev and ts and prev[-1].endswith("-"):
                    last = prev[-1]
                    cut = len(last) - 1
                    merged = last[:cut] + ts[0]
                    fixed = fixes.get((order, merged), merged)
                    if len(fixed) >= cut:
                        prev[-1] = fixed[:cut] + "-"
                        ts = [fixed[cut:], *ts[1:]]
                prev = ts and list(ts)
                rows.append(prev)
            for o, (lang, *_), ts in zip(out, lines, rows):
                done = memo[lang]
                o["text"] = ts and " ".join([done[t] for t in ts])
        if "words" in wanted:
            for o, (lang, *_), ts in zip(out, lines, split):
                done, pieces = memo[lang], [t for t in ts or () if t]
                o["words"] = [done[t] for t in pieces] if len(pieces) > 1 else []
        return out


_HELD: dict[str, Corrector] = {}


def _held(shared, *flags) -> Corrector:
    """The worker's corrector, which one task leaves to the next."""
    at, words, classes = shared.value
    if (at, flags) not in _HELD:
        _HELD.clear()
        _HELD[at, flags] = Corrector(pa.ipc.open_stream(words).read_all(), zlib.decompress(classes), *flags)
    return _HELD[at, flags]


def page_rows(ordered: DataFrame, names: DataFrame | None = None, cited: bool = False) -> DataFrame:
    """(page, lines, names): a page's lines in reading order as one row.

    names: (page, name), protected words; cited: the names that the page cites are such as well.  Lines that lie by
    page, as layout leaves them, are not shuffled again unless names are given.
    """
    line = ["reading_order", "place", "line_no", "lang", "text"]
    none = F.array().cast("array<string>")
    if names is None:
        # as many as a page has lines
        pages = ordered.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(*line))).alias("lines")).withColumn("names", none)
    else:
        both = ordered.select(*PAGE, F.struct(*line).alias("l"), F.lit(None).cast("string").alias("name"))
        told = names.where("name is not null and doc_id is not null and page_idx is not null").select(*PAGE, F.lit(None).cast(both.schema["l"].dataType).alias("l"), "name")
        pages = both.unionByName(told).groupBy(*PAGE).agg(F.array_sort(F.collect_list("l")).alias("lines"), F.collect_set("name").alias("names"))
        pages = pages.where(F.size("lines") > 0)
    if cited:
        pages = pages.withColumn("names", F.array_union("names", strings.citations(F.array_join("lines.text", " "))))
    return pages.withColumn("cased", F.transform("names", lambda n: F.initcap(n)))


def _corrected(shared, flags: tuple, capitalised: bool, wanted: tuple[str, ...], joined: bool, schema: pa.Schema):
    def run(batches):
        it = _held(shared, *flags)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                doc, page, names, cased = (part.column(c).to_pylist() for c in ("doc_id", "page_idx", "names", "cased"))
                inner = part.column("lines").flatten()
                order, place, line_no, lang, text = (inner.field(c).to_pylist() for c in ("reading_order", "place", "line_no", "lang", "text"))
                sizes, a, out = part.column("lines").value_lengths().to_pylist(), 0, []
                for d, p, ns, cs, n in zip(doc, page, names, cased, sizes):
                    z = a + n
                    rows = it.page(list(zip(lang[a:z], order[a:z], place[a:z], text[a:z])), ns, capitalised, wanted, dict(zip(ns, cs)))
                    if joined:
                        texts = [t for r in rows if (t := r["text"]) is not None]
                        out += [(d, p, " ".join(texts))] if texts else []
                    else:
                        out += [(lang[k], d, p, order[k], place[k], line_no[k], *(r[w] for w in wanted)) for k, r in zip(range(a, z), rows) if text[k] is not None]
                    a = z
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def correct_rows(
    pages: DataFrame,
    shared,
    fix_diacritics: bool = True,
    split_words: bool = True,
    capitalised: bool = False,
    wanted: tuple[str, ...] = ("text", "words"),
    tuning: Tuning = TUNING,
) -> DataFrame:
    """What correction.correct_pages makes of page_rows, without vectors: (lang, page, reading_order, place, line_no) and what
    is wanted of text and words.

    shared: packed(lexicon); capitalised: the page's capitalised words are protected as well.
    """
    line = pages.schema["lines"].dataType.elementType
    fields = [line["lang"], *pages.select(*PAGE).schema, *(line[c] for c in ("reading_order", "place", "line_no"))]
    kinds = {"text": T.StringType(), "words": T.ArrayType(T.StringType())}
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in fields] + [T.StructField(w, kinds[w]) for w in wanted])
    return pages.mapInArrow(_corrected(shared, (fix_diacritics, split_words, tuning), capitalised, wanted, False, to_arrow_schema(schema)), schema)


def corrected_text(pages: DataFrame, shared, fix_diacritics: bool = True, split_words: bool = True, capitalised: bool = False, tuning: Tuning = TUNING) -> DataFrame:
    """(page, text): text.page_text of correct_rows, without a shuffle of lines."""
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in pages.select(*PAGE).schema] + [T.StructField("text", T.StringType())])
    return pages.mapInArrow(_corrected(shared, (fix_diacritics, split_words, tuning), capitalised, ("text",), True, to_arrow_schema(schema)), schema)
