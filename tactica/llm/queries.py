"""The registered queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactica.llm import (ann, bpe, filter_audit, heapmeans, jaccard, langid, mixing, packing, quality, token_count, urlfilter, warc,
                         winnow)
from tactica.llm.common import documents


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.roundtrip_digest(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.learn(langid.training_rows(docs.select("doc_id", "text", "lang")))
    held_out = F.coalesce(langid.fold_of("doc_id", 4) == 2, F.lit(False))
    return langid.classify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_count.count_tokens(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir))


#: The rules that the query applies.
URL_RULES = [urlfilter.parse_rule(*x) for x in (
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))]


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES)


OP6_SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
place AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fit AS (
  SELECT page_id, host, path, CASE
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN ('.' || host) LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN ('.' || host) LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule FROM place)
SELECT page_id, host, path, rule, CASE WHEN rule LIKE 'example.org/%' OR rule = 'com/de/' THEN 'block' ELSE 'allow' END AS verdict
FROM fit
"""


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.fingerprint_pairs(documents(spark, sf_dir)).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        winnow.fingerprint_text("selected").alias("fingerprint"),
        winnow.fingerprint_text("edited_selected").alias("edited_fingerprint"),
        winnow.likeness("hashes", "edited_hashes").alias("near_edited"),
        winnow.likeness("hashes", "next_hashes").alias("near_next"))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"), length=1024, end_id=0)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.learn(docs, quality.training_rows(labels))
    held_out = F.coalesce(langid.fold_of("doc_id", 5) == 0, F.lit(False))
    return quality.classify(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"), min_bytes=0)


def op11_heap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heapmeans.digest(heapmeans.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=8, rounds=10, dim=64))


def _op11_sql(k: int = 8, rounds: int = 10, dim: int = 64) -> str:
    """The same rounds in SQL: every vector against every centroid, one pair of tables a round."""
    distance = f"list_sum(list_transform(range(1, {dim + 1}), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    assign = """a{r} AS MATERIALIZED (
  SELECT rid, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance
  FROM (SELECT v.rid, c.cluster, {distance} AS d FROM vectors v, c{r} c) GROUP BY rid)"""
    update = """s{r} AS MATERIALIZED (
  SELECT cluster, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n
  FROM (SELECT a.cluster, unnest(range(1, {end})) AS i, unnest(v.x) AS x FROM a{r} a JOIN vectors v USING (rid)) GROUP BY cluster, i),
c{next} AS MATERIALIZED (
  SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
    SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{r} GROUP BY cluster) m USING (cluster))"""
    steps = []
    for r in range(rounds + 1):
        steps.append(assign.format(r=r, distance=distance))
        if r < rounds:
            steps.append(update.format(r=r, next=r + 1, end=dim + 1))
    return f"""
WITH vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE len(embedding) = {dim}
  AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
c0 AS MATERIALIZED (
  SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1)::INTEGER AS cluster, x
  FROM vectors ORDER BY sha256('3:' || vec_id) LIMIT {k}),
{", ".join(steps)}
SELECT v.vec_id, a.cluster, a.distance::BIGINT AS distance, (sum(a.distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
       (sum(a.distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN vectors v USING (rid) JOIN c{rounds} c USING (cluster)
"""


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir).select("doc_id", "source", "text"), weights=(1, 2, 3), epochs=3, seed=12)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "repeats")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


OP13_SQL = """
WITH words AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
firsts AS (SELECT text, min(doc_id) AS smallest FROM words GROUP BY text),
marks AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
flagged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    (len(w) < 100)::INT + 2 * (100 * list_unique(w) < 80 * len(w))::INT
    + 4 * (100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT
    + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(smallest < doc_id, false)::INT AS flags
  FROM words JOIN firsts USING (text) LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, flags, good, toxic, count(*) AS n FROM flagged GROUP BY ALL),
letters AS (SELECT substr('ABCDE', i::INT, 1) AS f, (1 << (i::INT - 1)) AS bit FROM range(1, 6) t(i)),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, k::INT AS step, bits[k] AS own, coalesce(list_sum(bits[:k - 1]), 0)::INT AS before FROM orders, range(1, 6) t(k)),
counted AS (
  SELECT part, filter_order, step, own,
    sum(CASE WHEN flags & own = 0 AND flags & before = 0 THEN n ELSE 0 END)::BIGINT AS kept,
    sum(CASE WHEN flags & own <> 0 AND flags & before = 0 THEN n ELSE 0 END)::BIGINT AS removed,
    sum(CASE WHEN flags & own <> 0 AND flags & before <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
    sum(CASE WHEN flags = own THEN n ELSE 0 END)::BIGINT AS unique_fails,
    sum(CASE WHEN flags & own <> 0 AND flags & before = 0 AND good = 1 THEN n ELSE 0 END)::BIGINT AS good_lost,
    sum(CASE WHEN flags & own <> 0 AND flags & before = 0 AND toxic = 1 THEN n ELSE 0 END)::BIGINT AS toxic_lost
  FROM cells, steps GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM counted
"""

QUERIES = {f.__name__: f for f in (op1_bpe_round_trip, op2_language_id, op3_nearest_neighbours, op4_token_counts, op5_jaccard_join,
                                   op6_url_rules, op7_winnowing, op8_pack, op9_quality,
                                   op10_warc, op11_heap_clusters, op12_source_mix, op13_filter_audit)}
ORACLES = {"op6_url_rules": OP6_SQL, "op11_heap_clusters": _op11_sql(), "op13_filter_audit": OP13_SQL}
