"""License scans by an exact set-similarity join, in DataFrame functions only.

Text blocks are windows of `block_words` words that overlap by half; templates of over half as many words
have blocks eight times as large, and so on, so any passage as long as a template lies in one block.  A
block matches a template if it holds at least `threshold` of the template's distinct words.
Words stand in one global order, rarest first by the number of blocks they are in.  The join finds
every match without comparing all pairs:

* prefix: a template of n words that must meet a = ceil(threshold n) of them meets one of its n - a + 1
  rarest, so only those are indexed, and a block looks up only its own m - a + 1 rarest;
* length: a block needs a words at least (words outside all templates cannot count and are left out);
* position: words after the meeting word in both orders must suffice to reach a.

Candidates are then verified on the whole sets.  Templates are taken in groups of at most
`group_words` distinct words, one pass over the documents each, so the words in a plan and the index
that is broadcast are bounded however many templates there are.

Base phrases are runs of consecutive words, counted at every place.

Cases: null text counts as empty; empty texts and tables give no labels and no rows; rows equal in
doc_id and text have equal results; null ids are kept; words of equal frequency rank by the alphabet; a
very long text gives as many blocks as it takes; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, staged

#: Fixed values of the contract: base phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Whole texts of public licenses.
FULL_TEXTS = (
    (
        "mit",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission
notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT
WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A
PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES
OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "bsd-2",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this
list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING,
BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR
CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR
PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR
TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE
POSSIBILITY OF SUCH DAMAGE.""",
    ),
    (
        "isc",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED
"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL
DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE
OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "apache-2",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License.""",
    ),
)
#: Characteristic sentences of public licenses and the whole texts, as (label, words).
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license"),
    ("gpl-3", "licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "licensed under the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that"),
    ("bsd", "licensed under the bsd license"),
    ("mpl-2", "subject to the terms of the mozilla public license version 2 0"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial license"),
    ("cc-by-nc", "licensed under cc by nc"),
    ("cc0", "dedicated to the public domain under creative commons zero"),
    ("all-rights-reserved", "all rights reserved"),
    *((label, " ".join(re.findall("[0-9a-z]+", text.lower()))) for label, text in FULL_TEXTS),
)


def lowered(text: Column) -> Column:
    """Lower case that leaves A-Z the only letters that become ASCII ones (not the Kelvin sign or dotted I)."""
    odd = text.contains("K") | text.contains("İ")
    return F.lower(F.when(odd, F.translate(text, "Kİ", "ßß")).otherwise(text))


def word_line(text: Column) -> Column:
    """The words with one space before, between and after them."""
    return F.regexp_replace(F.concat(F.lit(" "), lowered(text), F.lit(" ")), SEPARATORS, " ")


def spaces(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit("")))


def base_phrases(docs: DataFrame, phrases: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, key) with n_words, n_base, first_word, last_word and the distinct base labels."""
    phrases = phrases or PHRASES
    df = docs.select("doc_id", F.xxhash64("text").alias("key"), word_line(F.coalesce("text", F.lit(""))).alias("s"))
    df = df.withColumn("n_words", F.greatest(spaces(F.col("s")) - 1, F.lit(0)).cast("long"))
    counts, firsts, lasts, labels = [], [], [], []
    for i, (phrase, label) in enumerate(phrases.items()):
        part = f"p{i}"
        # what stands between the places of a phrase
        df = df.withColumn(part, F.when(F.col("s").contains(f" {phrase} "), F.split("s", f" {phrase}(?= )", -1)))
        n = F.coalesce(F.size(part) - 1, F.lit(0))
        counts.append(F.when(F.col(part).isNotNull(), n).otherwise(0))
        firsts.append(spaces(F.element_at(part, 1)).cast("long"))
        lasts.append((F.col("n_words") - spaces(F.element_at(part, -1)) + 1 - len(phrase.split())).cast("long"))
        labels.append(F.when(F.col(part).isNotNull(), F.lit(label)))
    least, most = (firsts[0], lasts[0]) if len(phrases) == 1 else (F.least(*firsts), F.greatest(*lasts))
    return df.select(
        "doc_id",
        "key",
        "n_words",
        sum(counts[1:], counts[0]).cast("long").alias("n_base"),
        least.alias("first_word"),
        most.alias("last_word"),
        F.array_sort(F.array_distinct(F.array_compact(F.array(*labels)))).alias("base"),
    )


def blocks(docs: DataFrame, vocabulary: list[str], block_words: int) -> DataFrame:
    """(doc_id, key, words): per block its distinct words that are in the vocabulary, for blocks with any.

    Blocks of block_words words start every block_words / 2 words, so whatever is no longer than half
    a block lies in one, however its lines are broken.
    """
    half = block_words // 2
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - 1 - half, F.lit(0)), F.lit(half))
    df = docs.where(F.col("text").isNotNull())
    df = df.select("doc_id", F.xxhash64("text").alias("key"), F.split(F.trim(word_line(F.col("text"))), " ").alias("w"))
    df = df.select("doc_id", "key", F.explode(F.transform(starts, lambda s: F.slice("w", s + 1, F.lit(block_words)))).alias("w"))
    known = F.array_intersect("w", F.array(*map(F.lit, vocabulary)))
    return df.select("doc_id", "key", known.alias("words")).where(F.size("words") > 0)


def similarity_join(found: DataFrame, templates, threshold: float, broadcast_words: int = 1_000_000) -> DataFrame:
    """(doc_id, key, label, containment) for every block and template that meet the threshold."""
    spark = found.sparkSession
    sets = [(i, label, sorted(set(text.split()))) for i, (label, text) in enumerate(templates)]
    # one row per vocabulary word
    seen = {r.word: r.n for r in found.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    order = sorted({w for _, _, ws in sets for w in ws}, key=lambda w: (seen.get(w, 0), w))
    rank = {w: r for r, w in enumerate(order)}
    index, whole = [], []
    for i, label, ws in sets:
        ids = sorted(rank[w] for w in ws)
        need = math.ceil(threshold * len(ids) - 1e-9)
        whole.append((i, label, ids, need))
        index += [(ids[p], i, p, len(ids), need) for p in range(len(ids) - need + 1)]
    least = min((need for *_, need in whole), default=0)
    ranks = F.create_map(*[F.lit(x) for w, r in rank.items() for x in (w, r)])
    ordered = found.where(F.size("words") >= least).select(
        "doc_id", "key", F.array_sort(F.transform("words", lambda w: ranks[w])).alias("b")
    )
    # no template can be met beyond the prefix for the smallest need
    prefix = F.slice("b", F.lit(1), F.size("b") - least + 1)
    probe = ordered.select("doc_id", "key", "b", F.posexplode(prefix).alias("j", "word"))
    entries = spark.createDataFrame(index, "word int, template int, i int, n int, need int")
    sets_df = spark.createDataFrame(whole, "template int, label string, t array<int>, need int").drop("need")
    if sum(len(t) for _, _, t, _ in whole) <= broadcast_words:
        entries, sets_df = F.broadcast(entries), F.broadcast(sets_df)
    m = F.size("b")
    candidates = probe.join(entries, "word").where(
        (m >= F.col("need")) & (F.col("j") <= m - F.col("need")) & (F.least(F.col("n") - F.col("i"), m - F.col("j")) >= F.col("need") - F.least("i", "j"))
    )
    verified = candidates.join(sets_df, "template").withColumn("o", F.size(F.array_intersect("b", "t"))).where(F.col("o") >= F.col("need"))
    return verified.select("doc_id", "key", "label", (F.col("o") / F.col("n")).alias("containment"))


def block_size(template: str, block_words: int = 64) -> int:
    """Words of the blocks in which a template is looked for; it is no longer than half of one."""
    size = block_words
    while size // 2 < len(template.split()):
        size *= 8
    return size


def groups(templates, block_words: int = 64, group_words: int = 5000) -> list[tuple[int, list]]:
    """(block size, templates) of templates with one size and at most group_words distinct words (or a single template)."""
    out: dict[int, list[list]] = {}
    for label, text in templates:
        mine = out.setdefault(block_size(text, block_words), [[]])
        if mine[-1] and len({w for _, t in [*mine[-1], (label, text)] for w in t.split()}) > group_words:
            mine.append([])
        mine[-1].append((label, text))
    return [(size, some) for size, each in (out or {block_words: [[]]}).items() for some in each]


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.9, block_words: int = 64, group_words: int = 5000) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the greatest containment of a template found, 1 where a base phrase is, else 0.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    base = base_phrases(docs)
    parts = []
    for size, some in groups(templates, block_words, group_words):
        vocabulary = sorted({w for _, text in some for w in text.split()})
        parts.append(similarity_join(staged(blocks(docs, vocabulary, size), "blocks"), some, threshold))
    found = reduce(DataFrame.unionByName, parts)
    hits = found.groupBy("doc_id", "key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    b, h = base.alias("b"), hits.alias("h")
    joined = b.join(h, F.col("b.doc_id").eqNullSafe(F.col("h.doc_id")) & (F.col("b.key") == F.col("h.key")), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce("best", F.lit(0.0)))
    return joined.select(
        "b.doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        score.alias("score"),
    )
