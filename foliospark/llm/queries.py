"""The training-data queries: opN_<name> applies operator N to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import decontamination, exact_dedup, language_id, licenses, line_dedup, lm_scoring, packing, pii, simhash, token_files
from .common import table


def op2_exact_dedup(spark, sf_dir):
    return exact_dedup.dedup(table(spark, sf_dir, "documents")).drop("n_chunks")


def op3_benchmark_decontamination(spark, sf_dir):
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_token_files(spark, sf_dir):
    path = token_files.write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, path)


def op1_language_id(spark, sf_dir):
    return language_id.predict(table(spark, sf_dir, "documents"))


def op7_license_scan(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


def op8_lm_scoring(spark, sf_dir):
    good = table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    got = lm_scoring.score(table(spark, sf_dir, "documents"), good)
    return got.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")])


def op9_line_dedup(spark, sf_dir):
    return line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_pii(spark, sf_dir):
    return pii.scan(table(spark, sf_dir, "documents"))


QUERIES = {k: f for k, f in sorted(globals().items()) if k.startswith("op") and callable(f)}

_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_PHRASES = ", ".join(f"({p.split()!r}, '{label}')" for p, label in licenses.PHRASES.items())
_TEMPLATES = ", ".join(f"({sorted(set(t.split()))!r}, '{label}', {licenses.block_size(t)})" for label, t in licenses.TEMPLATES)

ORACLES = {
    "op2_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
""",
    "op3_benchmark_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS name, {_WORDS.format("text")} AS w FROM benchmark),
win AS (SELECT name, least(len(w), 10) AS k, unnest(range(greatest(len(w) - 10, 0) + 1)) AS i, w FROM b WHERE len(w) > 0),
grams AS (SELECT DISTINCT name, k, array_to_string(list_slice(w, i + 1, i + k), ' ') AS gram FROM win),
ks AS (SELECT DISTINCT k FROM grams),
places AS (SELECT doc_id, k, w, unnest(range(greatest(len(w) - k + 1, 0))) AS i FROM d, ks),
hits AS (
  SELECT doc_id, p.i, p.k, name FROM (SELECT doc_id, i, k, array_to_string(list_slice(w, i + 1, i + k), ' ') AS gram FROM places) p
  JOIN grams g ON p.k = g.k AND p.gram = g.gram
),
cover AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT doc_id, name FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN cover USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op7_license_scan": f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
phrases AS (SELECT * FROM (VALUES {_PHRASES}) v(p, label)),
templates AS (SELECT * FROM (VALUES {_TEMPLATES}) v(t, label, size)),
spots AS (SELECT doc_id, p, label, w, unnest(range(greatest(len(w) - len(p) + 1, 0))) AS i FROM d, phrases WHERE list_has_all(w, p)),
places AS (SELECT doc_id, label, i FROM spots WHERE list_slice(w, i + 1, i + len(p)) = p),
base AS (
  SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS z, list_sort(list(DISTINCT label)) AS labels FROM places GROUP BY doc_id
),
sizes AS (SELECT DISTINCT size FROM templates),
starts AS (SELECT doc_id, w, size, unnest(range(0, greatest(len(w) - 1 - size // 2, 0) + 1, size // 2)) AS s FROM d, sizes WHERE len(w) > 0),
blocks AS (SELECT doc_id, size, list_distinct(list_slice(w, s + 1, s + size)) AS b FROM starts),
found AS (
  SELECT doc_id, label, len(list_intersect(b, t)) / len(t)::DOUBLE AS c
  FROM blocks JOIN templates USING (size) WHERE len(list_intersect(b, t)) >= ceil(0.9 * len(t))
),
more AS (SELECT doc_id, list(DISTINCT label) AS labels, max(c) AS best FROM found GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, z::BIGINT AS last_word,
  coalesce(array_to_string(base.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(more.labels, [])))), ','), '') AS labels,
  greatest(CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, coalesce(best, 0.0::DOUBLE)) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)
""",
    "op8_lm_scoring": f"""
WITH d AS (
  SELECT doc_id, list_concat({_WORDS.format("text")}, [chr(10)]) AS seq, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0) AS good FROM documents
),
places AS (SELECT *, unnest(range(1, len(seq) + 1)) AS i FROM d),
pairs AS (SELECT doc_id, good, CASE WHEN i = 1 THEN chr(10) ELSE seq[i - 1] END AS v, seq[i] AS w FROM places),
uni AS (SELECT w, count(*) AS b, count(*) FILTER (good) AS t FROM pairs GROUP BY w),
bi AS (SELECT v, w, count(*) AS b, count(*) FILTER (good) AS t FROM pairs GROUP BY v, w),
n AS (SELECT count(*) AS b, count(*) FILTER (good) AS t, count(DISTINCT w) + 1 AS size FROM pairs),
loss AS (
  SELECT bi.v, bi.w, -ln((bi.t + 200.0::DOUBLE * (x.t + 1) / (n.t + n.size)) / (y.t + 200.0::DOUBLE)) AS lt, -ln((bi.b + 200.0::DOUBLE * (x.b + 1) / (n.b + n.size)) / (y.b + 200.0::DOUBLE)) AS lb
  FROM bi JOIN uni x ON x.w = bi.w JOIN uni y ON y.w = bi.v, n
)
SELECT doc_id, count(*) AS n_tokens, round(avg(lt), 6) AS target_loss, round(avg(lb), 6) AS background_loss, round(avg(lt) - avg(lb), 6) AS score
FROM pairs JOIN loss USING (v, w) GROUP BY doc_id
""",
    "op9_line_dedup": r"""
WITH t AS (
  SELECT doc_id, text, regexp_extract(coalesce(text, ''), '^[\x20\x09-\x0D]*') AS lead,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+[\x20\x09-\x0D]*') AS ps FROM documents
),
places AS (SELECT doc_id, lead, unnest(range(len(ps))) AS k, ps FROM t),
toks AS (
  SELECT doc_id, k, ps[k + 1] AS p, regexp_extract(ps[k + 1], '^[^\x20\x09-\x0D]+') AS w,
    CASE WHEN k = 0 THEN contains(lead, chr(10)) ELSE contains(ps[k], chr(10)) OR regexp_matches(ps[k], '[.!?][\x20\x09-\x0D]+$') END AS opens FROM places
),
ws AS (SELECT doc_id, list(w ORDER BY k) AS ws FROM toks GROUP BY doc_id),
spots AS (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 29, 0))) AS i FROM ws),
win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i + 1, i + 30), ' ') AS g FROM spots),
firsts AS (SELECT g, min(doc_id) AS least FROM win GROUP BY g),
own AS (SELECT doc_id, g, min(i) AS i0 FROM win GROUP BY doc_id, g),
dead AS (SELECT win.doc_id, win.i FROM win JOIN firsts USING (g) JOIN own USING (doc_id, g) WHERE win.doc_id > least OR win.i >= i0 + 30),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 30)) AS k FROM dead),
marked AS (
  SELECT toks.*, g.k IS NOT NULL AS gone, sum(opens::INT) OVER (PARTITION BY toks.doc_id ORDER BY toks.k) AS line FROM toks LEFT JOIN gone g ON toks.doc_id = g.doc_id AND toks.k = g.k
),
lines AS (SELECT doc_id, line, bool_and(gone) AS whole FROM marked GROUP BY ALL),
lost AS (SELECT doc_id, count(*) FILTER (whole) AS n_deleted FROM lines GROUP BY doc_id),
docs AS (
  SELECT doc_id, string_agg(CASE WHEN gone THEN '' ELSE p END, '' ORDER BY k) AS rest, count(*) AS n_words, count(*) FILTER (gone) AS words_deleted, count(*) FILTER (opens) AS n_open
  FROM marked GROUP BY doc_id
)
SELECT t.doc_id, CASE WHEN text IS NOT NULL THEN lead || coalesce(rest, '') END AS text, (length(coalesce(text, '')) > 0)::BIGINT + coalesce(n_open, 0) AS n_lines,
  coalesce(n_deleted, 0) AS n_deleted, coalesce(n_words, 0) AS n_words, coalesce(words_deleted, 0) AS words_deleted
FROM t LEFT JOIN docs USING (doc_id) LEFT JOIN lost USING (doc_id)
""",
}
