"""The registered queries of the package and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from costweave.llm import (
    chat, decontam, jaccard, language, lattice, packing, pieces, pii, ranked, runs, suffixes, toxicity, wavelet,
)
from costweave.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


@query
def op1_transcript_hmm(spark, sf_dir):
    return chat.recover_roles(spark, sf_dir)


@query
def op2_e8_lattice(spark, sf_dir):
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op3_bucket_refinement(spark, sf_dir):
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op4_ordinal_severity(spark, sf_dir):
    return toxicity.grade(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_blocked_product(spark, sf_dir):
    return jaccard.join_similar(table(spark, sf_dir, "documents"), n=4, similarity=(85, 100))


@query
def op6_column_generation(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"))


@query
def op7_pii_spans(spark, sf_dir):
    return pii.detect(table(spark, sf_dir, "documents"))


@query
def op8_family_svm(spark, sf_dir):
    return language.identify(table(spark, sf_dir, "documents"))


@query
def op9_seed_alignment(spark, sf_dir):
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op10_wavelet_shards(spark, sf_dir):
    return wavelet.token_shards(spark, table(spark, sf_dir, "documents"))


@query
def op11_tandem_runs(spark, sf_dir):
    return runs.run_digests(runs.made_periodic(table(spark, sf_dir, "documents")))


@query
def op12_prefix_table(spark, sf_dir):
    return pieces.piece_digests(table(spark, sf_dir, "documents"))


@query
def op13_no_random_access(spark, sf_dir):
    return ranked.search(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


ORACLES["op2_e8_lattice"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e, len(embedding) AS size FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND vec_id IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
    AND list_bool_or(list_transform(embedding, lambda x: x <> 0))
), n AS (
  SELECT *, sqrt(list_dot_product(e, e)) AS norm FROM v
), l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b
  ON a.label = b.label AND a.size = b.size AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / a.norm / b.norm >= 0.98
), r(vec_id, c) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT l.y, r.c FROM r JOIN l ON r.vec_id = l.x
), c AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id),
k AS (SELECT x AS vec_id, count(*) AS n_links FROM l GROUP BY x)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN k USING (vec_id) JOIN c USING (vec_id)
"""

ORACLES["op5_blocked_product"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(ws) = 0 THEN []
    WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS sh
  FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b USING (sh) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (
  SELECT x, y FROM p JOIN n a ON x = a.doc_id JOIN n b ON y = b.doc_id WHERE 100 * o >= 85 * (a.n + b.n - o)
), r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT l.y, r.c FROM r JOIN l ON r.doc_id = l.x
)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN r USING (doc_id) GROUP BY d.doc_id
"""

ORACLES["op13_no_random_access"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents
), i AS (
  SELECT row_number() OVER () AS j, item_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM benchmark
), q AS (SELECT j, t, count(*) AS times FROM (SELECT j, unnest(ts) AS t FROM i) GROUP BY ALL),
c AS (SELECT count(*) FILTER (len(ts) > 0)::BIGINT AS big_n, sum(len(ts))::BIGINT AS l FROM d),
p AS (SELECT k, t, count(*) AS tf FROM (SELECT k, unnest(ts) AS t FROM d) GROUP BY ALL),
w AS (
  SELECT t, floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY t
), s AS (
  SELECT q.j, p.k, sum(q.times * w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (25 + (75 * len(d.ts) * big_n) // l))))::BIGINT AS score
  FROM q JOIN p USING (t) JOIN w USING (t) JOIN d USING (k), c GROUP BY q.j, p.k
), r AS (
  SELECT j, doc_id, score, row_number() OVER (PARTITION BY j ORDER BY score DESC, doc_id)::INTEGER AS rank
  FROM s JOIN d USING (k) WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM r JOIN i USING (j) WHERE rank <= 10
"""
