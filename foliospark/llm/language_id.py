"""Language identification by mixture inference.

Every language has a letter trigram model of words, smoothed towards bigrams and unigrams.  A
document is a mixture: expectation-maximisation over its words' likelihoods, run until the likelihood
is within `tolerance` of its maximum, estimates the share of each language.  Nested language sets of
any size, by falling share, compete by penalised likelihood (half the log of the word count for each
further language, and a fixed price), and the shares of the winning set are the result.

Models are fitted on a bounded sample: about `sample_docs` labelled documents of each language,
chosen by a hash of the id among those whose crc32 of the id is not divisible by 5.  Inference reads
whole texts of all documents and uses nothing but the text.

Cases: null text and texts without letters give `und` with score 0; with no labelled document every
text gives `und`; null ids are never trained on and count as held out; ties go to the language first
in the alphabet; repeated rows repeat; a very long text counts by its distinct words; columns besides
doc_id, text and lang are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map

_WORDS = re.compile(r"[^\W\d_]+")
_EDGE = ord(" ")
FOLDS = 5


def held_out(doc_id):
    """True if crc32 of the id as text is divisible by FOLDS; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For every letter of ` word ` but the first space: codes of trigram (contexts in high bits), and the words' starts."""
    joined = "".join([f" {w} " for w in words])
    points = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    first = np.zeros(len(points), bool)
    starts = np.cumsum(lengths) - lengths
    first[starts] = True
    b = np.concatenate(([_EDGE], points[:-1]))
    a = np.concatenate(([_EDGE], b[:-1]))
    second = np.concatenate(([False], first[:-1]))
    a[second] = _EDGE
    keep = ~first
    code = (a << 42) | (b << 21) | points
    return code[keep], np.cumsum(lengths - 1) - (lengths - 1)


class Models:
    """Smoothed trigram models as sorted code tables with a column of log probabilities for each language."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], alpha: float = 20.0):
        self.languages = sorted(counts)
        low = (1 << 21) - 1
        self.tri = np.unique(np.concatenate([c for c, _ in counts.values()])) if counts else np.empty(0, np.int64)
        self.ctx = np.unique(self.tri >> 21)
        bi = self.tri & ((1 << 42) - 1)
        self.bi = np.unique(bi)
        uni = np.unique(self.tri & low)
        k = len(self.languages)
        self.tri_log = np.zeros((len(self.tri), k), np.float32)
        self.ctx_log = np.zeros((len(self.ctx), k), np.float32)
        self.bi_log = np.zeros((len(self.bi), k), np.float32)
        #: of a letter in no language's sample
        self.unseen = float(np.log(1e-7))
        for j, lang in enumerate(self.languages):
            codes, n = counts[lang]
            n_tri = np.zeros(len(self.tri))
            n_tri[np.searchsorted(self.tri, codes)] = n
            n_ctx = np.bincount(np.searchsorted(self.ctx, self.tri >> 21), n_tri, len(self.ctx))
            n_bi = np.bincount(np.searchsorted(self.bi, bi), n_tri, len(self.bi))
            firsts = np.unique(self.bi >> 21)
            n_first = np.bincount(np.searchsorted(firsts, self.bi >> 21), n_bi, len(firsts))
            n_uni = np.bincount(np.searchsorted(uni, self.tri & low), n_tri, len(uni))
            p_uni = (n_uni + 0.05) / (n_uni.sum() + 0.05 * len(uni))
            p_bi = (n_bi + alpha * p_uni[np.searchsorted(uni, self.bi & low)]) / (n_first[np.searchsorted(firsts, self.bi >> 21)] + alpha)
            rest = n_ctx + alpha
            p_tri = (n_tri + alpha * p_bi[np.searchsorted(self.bi, bi)]) / rest[np.searchsorted(self.ctx, self.tri >> 21)]
            self.tri_log[:, j] = np.log(p_tri)
            self.ctx_log[:, j] = np.log(alpha / rest)
            self.bi_log[:, j] = np.log(p_bi)

    @staticmethod
    def _at(table: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(table, codes), len(table) - 1)
        return at, table[at] == codes

    def word_logs(self, words: list[str]) -> np.ndarray:
        """Log likelihood of each word under each language."""
        codes, starts = _codes(words)
        at, known = self._at(self.tri, codes)
        out = self.tri_log[at]
        if not known.all():
            rest = codes[~known]
            c, c_known = self._at(self.ctx, rest >> 21)
            b, b_known = self._at(self.bi, rest & ((1 << 42) - 1))
            out[~known] = self.ctx_log[c] * c_known[:, None] + np.where(b_known[:, None], self.bi_log[b], self.unseen)
        return np.add.reduceat(out, starts, axis=0)


def _em(p: np.ndarray, count: np.ndarray, n: np.ndarray, share: np.ndarray, tolerance: float, max_steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Shares (documents by languages) after EM from given shares, whose zeros stay, and their log likelihoods less the words' own scale.

    p and count hold the documents' distinct words one document after another, n their number in each.
    The likelihood is concave, so a document's is within words * (largest factor - 1) of its maximum; a
    document leaves the loop once that is under tolerance.
    """
    share = share.astype(np.float32)
    left = np.arange(len(n))
    q, c, m, own = p, count, n, share
    for _ in range(max_steps):
        starts = np.cumsum(m) - m
        words = np.add.reduceat(c, starts, dtype=np.float64)
        each = q * (c / np.einsum("ij,ij->i", q, np.repeat(own, m, axis=0)))[:, None]
        factor = np.add.reduceat(each, starts, axis=0, dtype=np.float64) / words[:, None]
        done = words * (np.where(own > 0, factor, 0).max(axis=1) - 1) < tolerance
        share[left] = own = np.where(done[:, None], own, own * factor).astype(np.float32)
        if done.all():
            break
        if done.mean() > 0.3:  # go on with the others
            rows = np.repeat(~done, m)
            left, q, c, m, own = left[~done], q[rows], c[rows], m[~done], own[~done]
    total = np.log(np.maximum(np.einsum("ij,ij->i", p, np.repeat(share, n, axis=0)), np.float32(1e-30)))
    return share, np.add.reduceat(total * count, np.cumsum(n) - n, dtype=np.float64)


def _worth(gain: np.ndarray, price: float, words: np.ndarray) -> np.ndarray:
    """Whether a gain in log likelihood over one language may pay for two languages at least."""
    return gain > price + 0.5 * np.log(words)


def mixtures(models: Models, texts: list[str | None], price: float = 3.0, tolerance: float = 0.01, max_steps: int = 2000) -> np.ndarray:
    """Shares of each language in each text; rows of zeros for texts without letters.

    All language sets are nested by falling share under all languages, from the best single one to all.
    A document whose likelihood cannot rise enough to pay for a second language, which the slope at the
    single language or the likelihood under all of them tells, has that language alone.
    """
    k = len(models.languages)
    shares = np.zeros((len(texts), k))
    memo: dict[str, int] = {}
    ids, counts, rows, sizes = [], [], [], []
    for i, text in enumerate(texts):
        words = Counter(_WORDS.findall(text.lower())) if text else {}
        if any(c.isalpha() for w in words for c in w):
            rows.append(i)
            sizes.append(len(words))
            ids += [memo.setdefault(w, len(memo)) for w in words]
            counts += words.values()
    if not rows or not k:
        return shares
    n, count = np.array(sizes), np.array(counts, np.float32)
    starts = np.cumsum(n) - n
    words = np.add.reduceat(count, starts, dtype=np.float64)
    logs = models.word_logs(list(memo))
    # no word may rule a language out: a floor for names, code and noise
    p = np.maximum(np.exp(logs - logs.max(axis=1, keepdims=True)), np.float32(1e-6))
    single = np.add.reduceat(np.log(p)[ids] * count[:, None], starts, axis=0, dtype=np.float64)
    p = p[ids]
    best = single.argmax(axis=1)
    every = np.arange(len(rows))
    chosen = np.zeros((len(rows), k), np.float32)
    chosen[every, best] = 1
    value = single[every, best] - price
    slope = np.add.reduceat(p * (count / p[np.arange(len(p)), np.repeat(best, n)])[:, None], starts, axis=0, dtype=np.float64)
    # of a concave function: no gain is larger than the steepest slope
    open_ = np.flatnonzero(_worth(slope.max(axis=1) - words, price, words))

    def em(docs: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held = np.zeros(len(rows), bool)
        held[docs] = True
        at = np.repeat(held, n)
        return _em(p[at], count[at], n[docs], start, tolerance, max_steps)

    if len(open_):
        full, like = em(open_, np.full((len(open_), k), 1 / k))
        some = _worth(like + tolerance - single[open_, best[open_]], price, words[open_])
        open_, full = open_[some], full[some]
    if len(open_):
        full[np.arange(len(open_)), best[open_]] += 1  # sets are nested around the best single language
        order = np.argsort(-full, axis=1, kind="stable")
        for m in range(2, k + 1):
            start = np.zeros((len(open_), k))
            np.put_along_axis(start, order[:, :m], 1 / m, axis=1)
            share, like = em(open_, start)
            like = like - m * price - 0.5 * (m - 1) * np.log(words[open_])
            better = like > value[open_]
            chosen[open_[better]], value[open_[better]] = share[better], like[better]
    shares[rows] = chosen
    return shares


def fit(docs: DataFrame, sample_docs: int = 2000, max_labels: int = 1000) -> Models:
    """Models from about sample_docs documents of each language (all, if there are fewer).

    Bounds of the sample: sample_docs documents a language, and the max_labels most frequent labels.
    """
    labelled = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    labelled = labelled.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    found = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_labels)
    have = {r.lang: r.n for r in found.collect()}
    if not have:
        return Models({})
    rates = F.broadcast(docs.sparkSession.createDataFrame([(lang, min(1.0, sample_docs / n)) for lang, n in have.items()], "lang string, rate double"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    sample = labelled.join(rates, "lang").where(place < F.col("rate")).select("lang", "text")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by.setdefault(lang, []).extend(_WORDS.findall((text or "").lower()))
        out = [(lang, *np.unique(_codes(words)[0], return_counts=True)) for lang, words in by.items() if words]
        return pa.record_batch(
            [
                pa.array([lang for lang, c, _ in out for _ in range(len(c))], pa.string()),
                pa.array(np.concatenate([c for _, c, _ in out]) if out else [], pa.int64()),
                pa.array(np.concatenate([n for _, _, n in out]) if out else [], pa.int64()),
            ],
            ["lang", "code", "n"],
        )

    summed = arrow_map(sample, count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    got = summed.toArrow()  # bounded by the sample
    lang = np.array(got.column("lang").to_pylist(), object)
    code, n = (got.column(c).to_numpy() for c in ("code", "n"))
    return Models({x: (code[lang == x][o := np.argsort(code[lang == x])], n[lang == x][o]) for x in have if (lang == x).any()})


def identify(docs: DataFrame, models: Models, keep: list[str] | None = None) -> DataFrame:
    """The columns in keep (doc_id by default) with lang_pred, score and mixture (language:share, by falling share).

    The results replace columns of the same name; other columns may have any name.
    """
    keep = ["doc_id"] if keep is None else [c for c in keep if c not in ("lang_pred", "score", "mixture")]
    shared = docs.sparkSession.sparkContext.broadcast(models)  # as large as the languages' trigram tables
    source = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col("text").cast("string").alias("text"))
    added = ", lang_pred string, score double, mixture string"
    schema = T.StructType([source.schema["row"], *T._parse_datatype_string(added[2:]).fields])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        s = mixtures(m, batch.column(1).to_pylist())
        pred, score, mix = [], [], []
        for row in s:
            if row.any():
                order = np.argsort(-row, kind="stable")
                pred.append(m.languages[order[0]])
                score.append(float(min(1.0, row[order[0]])))
                mix.append(",".join(f"{m.languages[j]}:{row[j]:.3f}" for j in order if row[j] >= 0.0005))
            else:
                pred.append("und")
                score.append(0.0)
                mix.append("")
        added = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mix, pa.string())]
        return pa.record_batch([batch.column(0), *added], ["row", "lang_pred", "score", "mixture"])

    return arrow_map(source, run, schema, 1_000_000).select("row.*", "lang_pred", "score", "mixture")


def predict(docs: DataFrame, sample_docs: int = 2000) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, mixture."""
    got = identify(docs, fit(docs, sample_docs))
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "mixture")
