"""Registered queries on inputs that reach the less common paths of an operator:
masked and padded samples, damaged samples, dependencies, fact lists, messages, cycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tactica.operators import evaluation as ev
from tactica.operators import paths as P
from tactica.operators import stats, steps
from tactica.operators.filters import bad_sample_flags
from tactica.plans.registry import query, r6
from tactica.sources import adapters as ad

_MASKED = """
, masked AS (SELECT batch, sample, loss, predicted,
                    list_transform(labels, lambda w, i: CASE WHEN i % 3 = 0 OR batch % 5 = 0 THEN '-100' ELSE w END) AS labels
             FROM predictions)
"""


def _masked(spark, sf_dir):
    p = ad.predictions(spark, sf_dir)
    return p.withColumn("labels", F.transform("labels", lambda w, i: F.when(
        ((i + 1) % 3 == 0) | (F.col("batch") % 5 == 0), F.lit("-100")).otherwise(w)))


@query("a14_token_accuracy_masked", _MASKED + """
, per AS (SELECT batch, loss, list_sum(list_transform(range(1, len(labels) + 1),
                     lambda i: CASE WHEN labels[i] <> '-100' AND labels[i] = predicted[i] THEN 1 ELSE 0 END)) AS hits,
            len(list_filter(labels, lambda l: l <> '-100')) AS toks,
            CASE WHEN labels[1] = predicted[1] THEN 1 ELSE 0 END AS first FROM masked)
SELECT batch, count(*) AS samples, round(CASE WHEN sum(toks) = 0 THEN 0 ELSE sum(hits) / sum(toks) END, 6) AS accuracy,
       round(sum(first) / count(*), 6) AS first_token_accuracy,
       CAST(sum(hits) AS BIGINT) AS correct_tokens, CAST(sum(toks) AS BIGINT) AS label_tokens
FROM per GROUP BY batch""", ("predictions",))
def a14_token_accuracy_masked(spark, sf_dir):
    m = ev.token_accuracy_metrics(_masked(spark, sf_dir), "labels", "predicted", "loss", ["batch"], mask_value="-100")
    return m.select("batch", "samples", r6("accuracy").alias("accuracy"), r6("first_token_accuracy").alias("first_token_accuracy"),
                    "correct_tokens", "label_tokens")


@query("a15_match_classes_padded", """
, padded AS (SELECT batch, sample, labels, CASE WHEN batch % 2 = 0 OR sample % 4 = 0 THEN list_prepend('<pad>', predicted)
                                                ELSE predicted END AS predicted FROM predictions)
, flags AS (SELECT batch, bool_and(predicted[1] = '<pad>') AS all_pad FROM padded GROUP BY batch)
, cut AS (SELECT batch, sample, labels, CASE WHEN all_pad THEN predicted[2:] ELSE predicted END AS predicted FROM padded JOIN flags USING (batch))
, c AS (SELECT batch, sample,
          len(list_filter(range(1, least(len(labels), len(predicted)) + 1), lambda i: labels[i] <> predicted[i])) = 0 AS exact,
          len(list_filter(range(1, least(len(labels), len(predicted)) + 1), lambda i: labels[i] = predicted[i])) = 0 AS all_wrong,
          coalesce(labels[1] = predicted[1], false) AS first_eq FROM cut)
SELECT batch, sample, exact, first_eq AND NOT exact AS coincide, all_wrong FROM c""", ("predictions",))
def a15_match_classes_padded(spark, sf_dir):
    p = ad.predictions(spark, sf_dir)
    front = (F.col("batch") % 2 == 0) | (F.col("sample") % 4 == 0)
    p = p.withColumn("predicted", F.when(front, F.array_prepend("predicted", F.lit("<pad>"))).otherwise(F.col("predicted")))
    return ev.match_classes(p, "labels", "predicted", "batch", pad="<pad>").select("batch", "sample", "exact", "coincide", "all_wrong")


@query("f07_bad_samples_found", _MASKED + """
SELECT batch, sample, 'all_masked' AS reason FROM masked WHERE len(list_filter(labels, lambda l: l <> '-100')) = 0
UNION ALL SELECT batch, sample, 'nan_loss' FROM masked WHERE sample % 3 = 0
UNION ALL SELECT batch, sample, 'nan_inputs' FROM masked WHERE len(predicted) % 4 = 0""", ("predictions",))
def f07_bad_samples_found(spark, sf_dir):
    nan = float("nan")
    p = _masked(spark, sf_dir).withColumn("loss", F.when(F.col("sample") % 3 == 0, F.lit(nan)).otherwise(F.col("loss")))
    p = p.withColumn("inputs", F.when(F.size("predicted") % 4 == 0, F.array(F.lit(0.5), F.lit(nan))).otherwise(F.array(F.lit(0.5))))
    return bad_sample_flags(p, ["batch", "sample"], ["inputs"], labels="labels", loss="loss", mask_value="-100")


@query("x06_chunk_payload", """
, base AS (SELECT batch, sample, labels AS toks, predicted AS tgt, len(labels) AS n FROM predictions)
, starts AS (SELECT *, unnest(range(0, CAST(ceil(greatest(0, n - 63) / 57.0) AS BIGINT) + 1)) AS chunk FROM base)
, c AS (SELECT batch, sample, chunk, list_append(toks[chunk * 57 + 1: chunk * 57 + 63], '</s>') AS body,
               list_append(tgt[1:63], '</s>') AS tgt FROM starts)
SELECT batch, sample, chunk, array_to_string(body, ' ') || repeat(' <pad>', 64 - len(body)) AS input_text,
       len(body) AS attended, 64 AS width, array_to_string(tgt, ' ') || repeat(' -100', 64 - len(tgt)) AS label_text FROM c""", ("predictions",))
def x06_chunk_payload(spark, sf_dir):
    ch = ev.overlapping_chunks(ad.predictions(spark, sf_dir), "labels", 64, "<pad>", ["</s>"], target="predicted", label_pad="-100")
    return ch.select("batch", "sample", "chunk", F.array_join("input_ids", " ").alias("input_text"),
                     F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("attended"),
                     F.size("attention_mask").alias("width"), F.array_join("labels", " ").alias("label_text"))


@query("a05_extend_proof_counts_deps", """
SELECT proof_id, greatest(0, len(actions) - 1) AS num_steps, CASE WHEN proof_id % 3 = 0 THEN 0 ELSE len(actions) END AS num_deps
FROM proofs""", ("proofs",))
def a05_extend_proof_counts_deps(spark, sf_dir):
    r = ad.rich_records(spark, sf_dir).withColumn("deps", F.when(F.col("proof_id") % 3 != 0, F.col("deps")))
    return stats.extend_proof_counts(r, "proof", "deps").select("proof_id", "num_steps", "num_deps")


@query("p18_number_fact_lists", """
SELECT rank, i AS index, words[i] AS theorem
FROM (SELECT rank, string_split(theorem, ' ') AS words, unnest(range(1, len(string_split(theorem, ' ')) + 1)) AS i FROM facts)""", ("facts",))
def p18_number_fact_lists(spark, sf_dir):
    f = ad.facts(spark, sf_dir).select("rank", F.split("theorem", " ").alias("theorems"))
    return steps.number_facts(f, "rank", "theorems")


_SIXTH = """
, irr AS (SELECT src, dst FROM dag_edges e WHERE NOT EXISTS (
            SELECT 1 FROM dag_edges a JOIN dag_edges b ON b.src = a.dst WHERE a.src = e.src AND b.dst = e.dst))
, walk(x, y, z, path) AS (SELECT p_partkey, p_partkey // 6, p_partkey, [p_partkey // 6, p_partkey] FROM part WHERE p_partkey >= 6
                          UNION ALL SELECT w.x, w.y, irr.dst, list_append(w.path, irr.dst) FROM walk w JOIN irr ON irr.src = w.z WHERE w.z > w.y)
"""


@query("g12_closed_cycles", _SIXTH + """
SELECT y AS src, x AS dst, array_to_string(path, '>') AS cycle_id, i - 1 AS pos, path[i] AS key
FROM (SELECT x, y, path, unnest(range(1, len(path) + 1)) AS i FROM walk WHERE z = y)""", ("dag_edges",))
def g12_closed_cycles(spark, sf_dir):
    """An edge from a sixth of every key back to the key closes a cycle for each way down to the sixth."""
    keys = ad.table(spark, sf_dir, "part").where("p_partkey >= 6").select(F.col("p_partkey").alias("dst"))
    return P.closed_cycles(ad.dag_edges(spark, sf_dir), keys.select(F.floor(F.col("dst") / 6).alias("src"), "dst"))


_ALL_REVERSED = """
, irr AS (SELECT src, dst FROM dag_edges e WHERE NOT EXISTS (
            SELECT 1 FROM dag_edges a JOIN dag_edges b ON b.src = a.dst WHERE a.src = e.src AND b.dst = e.dst))
, walk(x, y, z, path) AS (SELECT src, dst, src, [dst, src] FROM dag_edges
                          UNION ALL SELECT w.x, w.y, irr.dst, list_append(w.path, irr.dst) FROM walk w JOIN irr ON irr.src = w.z WHERE w.z > w.y)
"""


@query("g12_closed_cycles_all", _ALL_REVERSED + """
SELECT y AS src, x AS dst, array_to_string(path, '>') AS cycle_id, i - 1 AS pos, path[i] AS key
FROM (SELECT x, y, path, unnest(range(1, len(path) + 1)) AS i FROM walk WHERE z = y)""", ("dag_edges",))
def g12_closed_cycles_all(spark, sf_dir):
    """Every edge turned round closes at least one cycle. (Edges lead to smaller keys, so the twin's walk stops below its end.)"""
    edges = ad.dag_edges(spark, sf_dir)
    return P.closed_cycles(edges, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
