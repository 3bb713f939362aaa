"""Registered queries: splits and step-count statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tactica.operators import splits, stats
from tactica.plans.registry import query, r6
from tactica.sources import adapters as ad


def _split_with_steps(spark, sf_dir):
    """Step counts first (so the text arrays never enter a shuffle), then one
    numbering pass giving proof_num and the split label together."""
    p = stats.extend_proof_counts(ad.proofs(spark, sf_dir), "actions").drop("actions")
    return splits.assign_split(p, ["logic", "theory"], ["proof_id"], rank_name="proof_num")


def _test_split(spark, sf_dir):
    return _split_with_steps(spark, sf_dir).where(F.col("split") == "test")


_SPLIT_SQL = """
, sized AS (SELECT *, count(*) OVER (PARTITION BY logic, theory) AS n FROM proofs)
, split AS (
  SELECT proof_id, logic, theory, proof_num, greatest(0, len(actions) - 1) AS num_steps,
         CASE WHEN proof_num < floor(n * CAST(0.64 AS DOUBLE)) THEN 'train'
              WHEN proof_num < floor(n * CAST(0.64 AS DOUBLE)) + floor(n * CAST(0.16 AS DOUBLE))
                THEN 'valid'
              ELSE 'test' END AS split
  FROM sized)
"""


@query("w01_dataset_split", _SPLIT_SQL + """
SELECT proof_id, logic, theory, proof_num, num_steps, split FROM split""", ("proofs",))
def w01_dataset_split(spark, sf_dir):
    """Train/valid/test label of every proof (64/16/rest per directory)."""
    return _split_with_steps(spark, sf_dir).select(
        "proof_id", "logic", "theory", "proof_num", "num_steps", "split")


@query("a05_extend_proof_counts", """
SELECT proof_id, greatest(0, len(actions) - 1) AS num_steps, 0 AS num_deps FROM proofs""",
       ("proofs",))
def a05_extend_proof_counts(spark, sf_dir):
    p = stats.extend_proof_counts(ad.proofs(spark, sf_dir), "actions")
    return p.select("proof_id", "num_steps", "num_deps")


@query("a06_avg_steps_per_logic_test", _SPLIT_SQL + """
SELECT logic, round(avg(num_steps), 6) AS avg_steps, count(*) AS n_proofs
FROM split WHERE split = 'test' GROUP BY logic""", ("proofs",))
def a06_avg_steps_per_logic_test(spark, sf_dir):
    """Minimum slice: how long are proofs, per logic, in the test split?"""
    out = stats.avg_steps_per_logic(_test_split(spark, sf_dir))
    return out.select("logic", r6("avg_steps").alias("avg_steps"), "n_proofs")


@query("a07_steps_histogram", """
SELECT len(actions) - 1 AS steps, count(*) AS frequency FROM proofs GROUP BY 1""", ("proofs",))
def a07_steps_histogram(spark, sf_dir):
    p = ad.proofs(spark, sf_dir).withColumn("num_steps", stats.count_steps(F.col("actions")))
    return stats.steps_histogram(p)


@query("a08_steps_summary", """
, h AS (SELECT greatest(0, len(actions) - 1) AS s FROM proofs)
, m AS (SELECT s FROM h GROUP BY s ORDER BY count(*) DESC, s LIMIT 1)
SELECT CAST(sum(s) AS BIGINT) AS total_steps, round(avg(s), 6) AS mean_steps,
       round(median(s), 6) AS median_steps, (SELECT s FROM m) AS mode_steps,
       max(s) AS max_steps, count(*) AS n_proofs FROM h""", ("proofs",))
def a08_steps_summary(spark, sf_dir):
    p = stats.extend_proof_counts(ad.proofs(spark, sf_dir), "actions")
    out = stats.steps_summary(p)
    return out.select("total_steps", r6("mean_steps").alias("mean_steps"),
                      r6("median_steps").alias("median_steps"), "mode_steps",
                      "max_steps", "n_proofs")


@query("a09_steps_percentages_test", _SPLIT_SQL + """
, hist AS (SELECT num_steps AS steps, count(*) AS frequency FROM split
           WHERE split = 'test' GROUP BY 1)
, tot AS (SELECT sum(frequency) AS total FROM hist)
SELECT r.steps, coalesce(h.frequency, 0) AS frequency,
       round(CASE WHEN t.total > 0 THEN coalesce(h.frequency, 0) / t.total * 100
                  ELSE 0 END, 6) AS percentage
FROM range(1, 16) r(steps) LEFT JOIN hist h ON h.steps = r.steps, tot t""", ("proofs",))
def a09_steps_percentages_test(spark, sf_dir):
    hist = stats.steps_histogram(_test_split(spark, sf_dir))
    out = stats.steps_percentages(hist, 1, 15)
    return out.select("steps", "frequency", r6("percentage").alias("percentage"))


@query("a10_cumulative_step_share", """
, hist AS (SELECT greatest(0, len(actions) - 1) AS steps, count(*) AS frequency
           FROM proofs GROUP BY 1)
, pct AS (SELECT steps, frequency,
                 frequency / sum(frequency) OVER () * 100 AS percentage FROM hist)
SELECT steps, frequency, round(percentage, 6) AS percentage,
       round(sum(percentage) OVER (ORDER BY steps ROWS UNBOUNDED PRECEDING), 6)
         AS cumulative_percentage
FROM pct QUALIFY steps <= 20""", ("proofs",))
def a10_cumulative_step_share(spark, sf_dir):
    p = stats.extend_proof_counts(ad.proofs(spark, sf_dir), "actions")
    out = stats.cumulative_step_share(stats.steps_histogram(p), cap=20)
    return out.select("steps", "frequency", r6("percentage").alias("percentage"),
                      r6("cumulative_percentage").alias("cumulative_percentage"))
