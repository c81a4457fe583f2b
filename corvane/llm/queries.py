"""The registered queries of this package, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import balls, bpe, hmm, impact, lexical, lines, mixing, neardup, packing, pii, pu, secrets, warc


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lines.quality_rules(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))
    return got.drop("content_tags")


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu.quality_classifier(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(_read(spark, sf_dir, "documents"))


def vocabulary() -> str:
    """Path of the vocabulary file that the registered queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.weak_supervision(_read(spark, sf_dir, "documents"))


def op2_warc_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(warc.write(_read(spark, sf_dir, "pages")), payload=False).drop("url")


def op4_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(_read(spark, sf_dir, "documents"), vocabulary())


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit(_read(spark, sf_dir, "documents"), vocabulary())


def op6_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_read(spark, sf_dir, "documents"))


def op7_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(_read(spark, sf_dir, "documents"))


def op9_impact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_maxscore_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balls.ball_k_means(_read(spark, sf_dir, "embeddings"))


def op13_flow_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_read(spark, sf_dir, "documents"), F.array("source"))
    return mixed.select("doc_id", "size", F.col("routes")[0]["source_size"].alias("source_size"), F.col("routes")[0]["target"].alias("target"), "taken")


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_pii_weak_supervision, op2_warc_sequential, op3_near_duplicates, op4_bpe_tree, op5_best_fit_packing, op6_secret_crf, op7_hmm_scoring, op8_quality_rules, op9_impact_topk, op10_quality_classifier,
            op11_maxscore_search, op12_ball_kmeans, op13_flow_mixing,
        )
    }


OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS h FROM p),
f AS (SELECT h, min(page_id) AS first FROM d WHERE n >= 100 GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d.h AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM d LEFT JOIN f ON d.h = f.h
"""

OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
           FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
n AS (SELECT r, doc_id, CAST(len(terms) AS BIGINT) AS n FROM d WHERE len(terms) > 0),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM n),
q AS (SELECT item_id, text AS said, term, count(*) AS times FROM (SELECT item_id, text, unnest({_TERMS}) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) SEMI JOIN q USING (term) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p CROSS JOIN g GROUP BY term, docs),
m AS (SELECT r, doc_id, 100 - 25 + ((25 * n * docs) // words) AS m FROM n CROSS JOIN g),
s AS (SELECT item_id, said, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
      FROM q JOIN p USING (term) JOIN w USING (term) JOIN m USING (r) GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY item_id, said ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 20
"""


def _lloyd_sql(rounds: int = 3) -> str:
    """Plain Lloyd rounds over all distances."""
    nearest = """a{i} AS (SELECT r, c, d FROM (SELECT v.r, k.c, list_sum(list_transform(list_zip(v.e, k.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM v CROSS JOIN c{i} k)
           QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)"""
    moved = """s{j} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT a.c, unnest(v.e) AS x, generate_subscripts(v.e, 1) AS i FROM v JOIN a{i} a USING (r)) GROUP BY c, i),
m{j} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS e FROM s{j} GROUP BY c),
c{j} AS (SELECT k.c, coalesce(m.e, k.e) AS e FROM c{i} k LEFT JOIN m{j} m USING (c))"""
    steps = [nearest.format(i=0)]
    for i in range(rounds):
        steps += [moved.format(i=i, j=i + 1), nearest.format(i=i + 1)]
    return f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT c - 1 AS c, e FROM (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) NULLS LAST, e) AS c, e FROM v) WHERE c <= 16),
{", ".join(steps)},
t AS (SELECT c, CAST(sum(d) AS BIGINT) AS inertia FROM a{rounds} GROUP BY c)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, t.inertia AS cluster_inertia, CAST((SELECT sum(inertia) FROM t) AS BIGINT) AS inertia, sha256(array_to_string(k.e, ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN t USING (c) JOIN c{rounds} k USING (c)
"""


OP12_SQL = _lloyd_sql()

OP13_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5('13|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w FROM s),
o AS (SELECT *, sum(size) OVER () - 3 * coalesce(sum(size) OVER fuller, 0) AS left_, sum(w) OVER () - coalesce(sum(w) OVER fuller, 0) AS weight
      FROM w WINDOW fuller AS (ORDER BY size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
u AS (SELECT *, 3 * size * weight < w * left_ AS is_full FROM o),
x AS (SELECT arg_max(left_, weight) AS left_, max(weight) AS weight FROM u WHERE NOT is_full),
t AS (SELECT source, size AS source_size, CASE WHEN is_full THEN CAST(3 * size AS DOUBLE) ELSE CAST(x.left_ * w AS DOUBLE) / CAST(x.weight AS DOUBLE) END AS target FROM u CROSS JOIN x),
b AS (SELECT d.*, source_size, target, CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS begin_, CAST(floor(target) AS BIGINT) AS flow
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE size * (flow // source_size) + greatest(0, least(size, flow % source_size - begin_)) END AS taken FROM b
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_sequential": OP2_SQL, "op9_impact_topk": OP9_SQL, "op11_maxscore_search": OP11_SQL, "op12_ball_kmeans": OP12_SQL, "op13_flow_mixing": OP13_SQL}
