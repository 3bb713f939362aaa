"""Corpus statistics.

Every statistic is a partial + final aggregate over the whole table. Where
the reference scans a sorted list (vocabulary coverage, cumulative shares,
median, mode) the big table is first collapsed to a small histogram and the
ordered scan runs over that histogram only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# ---------------------------------------------------------------- step counts

def count_steps(actions: Column) -> Column:
    """len(proof) - 1; a record without proof gives -1."""
    return F.coalesce(F.size(actions), F.lit(0)) - F.lit(1)


def extend_proof_counts(df: DataFrame, proof: str = "actions", deps: str | None = None) -> DataFrame:
    """num_steps = max(0, len - 1), num_deps = len(deps) (0 when missing)."""
    n_deps = F.coalesce(F.size(deps), F.lit(0)) if deps else F.lit(0)
    return df.withColumns({
        "num_steps": F.greatest(F.lit(0), F.coalesce(F.size(proof), F.lit(0)) - F.lit(1)),
        "num_deps": n_deps,
    })


def avg_steps_per_logic(df: DataFrame, by: str = "logic", steps: str = "num_steps") -> DataFrame:
    """Plain mean of steps per logic (documented deviation from the
    reference's order-dependent fold, which drops a proof per logic change)."""
    return df.groupBy(by).agg(F.avg(steps).alias("avg_steps"), F.count(F.lit(1)).alias("n_proofs"))


def steps_histogram(df: DataFrame, steps: str = "num_steps") -> DataFrame:
    """Number of proofs per step count."""
    return df.groupBy(F.col(steps).alias("steps")).agg(F.count(F.lit(1)).alias("frequency"))


def steps_summary(df: DataFrame, steps: str = "num_steps") -> DataFrame:
    """Total, mean, median, mode (smallest among ties), max of step counts."""
    s = F.col(steps)
    return df.agg(F.sum(s).alias("total_steps"), F.avg(s).alias("mean_steps"),
                  F.median(s).alias("median_steps"), F.mode(s, True).alias("mode_steps"),
                  F.max(s).alias("max_steps"), F.count(F.lit(1)).alias("n_proofs"))


def steps_percentages(hist: DataFrame, lo: int = 1, hi: int = 15) -> DataFrame:
    """Share (percent) of proofs with s steps for s in [lo, hi], zeros kept.

    ``hist`` is A07's small table (one row per distinct step count); the total
    is a window over that table, so nothing large is ever in one task.
    """
    everything = Window.partitionBy()
    rng = hist.sparkSession.range(lo, hi + 1).select(F.col("id").alias("steps"))
    joined = (rng.join(hist.withColumn("_total", F.sum("frequency").over(everything)),
                       "steps", "full")
                 .withColumn("_total", F.max("_total").over(everything))
                 .where(F.col("steps").between(lo, hi)))
    freq = F.coalesce("frequency", F.lit(0))
    return joined.select(
        "steps", freq.alias("frequency"),
        F.when(F.col("_total") > 0, freq / F.col("_total") * 100)
         .otherwise(F.lit(0.0)).alias("percentage"))


def cumulative_step_share(hist: DataFrame, cap: int = 20) -> DataFrame:
    """A10: percentage and running percentage per step count, cut at ``cap``
    after accumulating. The running sum runs over the (small) histogram only."""
    w = Window.orderBy("steps").rowsBetween(Window.unboundedPreceding, 0)
    pct = (hist.withColumn("_total", F.sum("frequency").over(Window.partitionBy()))
               .withColumn("percentage", F.col("frequency") / F.col("_total") * 100)
               .withColumn("cumulative_percentage", F.sum("percentage").over(w)))
    return pct.where(F.col("steps") <= cap).select(
        "steps", "frequency", "percentage", "cumulative_percentage")


# ---------------------------------------------------------------- tokens

def token_counts(df: DataFrame, text: str) -> DataFrame:
    """Whitespace-token frequencies (explode + partial/final count; a
    frequent token is combined map-side, so hot tokens cost no skew)."""
    from tactica.functions.text import py_spaces
    # split on spaces, then drop the empty pieces as a row filter (stays in
    # generated code instead of a per-array lambda)
    # explode_outer: a plain explode makes Catalyst infer size(...) > 0 and
    # evaluate the whole split twice; null/empty pieces are dropped here
    return (df.select(F.explode_outer(F.split(py_spaces(F.col(text)), " ")).alias("token"))
              .where(F.col("token") != "")
              .groupBy("token").agg(F.count(F.lit(1)).alias("count")))


def top_tokens(counts: DataFrame, k: int) -> DataFrame:
    """Tokens by descending frequency (ties by token), first k."""
    return counts.orderBy(F.desc("count"), "token").limit(k)


def vocab_size_at_coverage(counts: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Smallest k such that the k most frequent tokens cover >= threshold
    of all tokens; 0 if never reached.

    The token table is first collapsed to (freq, n_tokens) - at most a few
    thousand rows even for huge corpora - and the ordered scan runs there;
    the crossing group is solved in integer arithmetic (threshold as an
    exact fraction), so no float accumulation error decides the answer.
    """
    from fractions import Fraction
    q = Fraction(str(threshold))
    num, den = q.numerator, q.denominator
    h = counts.groupBy(F.col("count").alias("freq")).agg(F.count(F.lit(1)).alias("n_tok"))
    w = Window.orderBy(F.desc("freq")).rowsBetween(Window.unboundedPreceding, -1)
    c = h.select(
        "freq", "n_tok",
        F.coalesce(F.sum(F.col("freq") * F.col("n_tok")).over(w), F.lit(0)).alias("cum_before"),
        F.coalesce(F.sum("n_tok").over(w), F.lit(0)).alias("tok_before"),
        F.sum(F.col("freq") * F.col("n_tok")).over(Window.partitionBy()).alias("total"))
    hit = c.where(F.lit(den) * (F.col("cum_before") + F.col("freq") * F.col("n_tok"))
                  >= F.lit(num) * F.col("total"))
    k = hit.select(F.max_by(F.col("tok_before") + F.expr(
        f"({num} * total - {den} * cum_before + {den} * freq - 1) div ({den} * freq)"), F.col("freq")).alias("k"))
    return k.select(F.coalesce("k", F.lit(0)).cast("long").alias("vocab_size"))


# ---------------------------------------------------------------- lengths

def _dist(c: str, prefix: str) -> list[Column]:
    x = F.col(c)
    return [F.coalesce(F.avg(x), F.lit(0.0)).alias(f"{prefix}_avg"),
            F.coalesce(F.max(x), F.lit(0)).alias(f"{prefix}_max"),
            F.coalesce(F.min(x), F.lit(0)).alias(f"{prefix}_min"),
            F.coalesce(F.median(x), F.lit(0.0)).alias(f"{prefix}_median"),
            F.coalesce(F.mode(x, True), F.lit(0)).alias(f"{prefix}_mode")]


def length_stats(lens: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """avg/max/min/median/mode of input and target lengths, total count;
    zeros on empty input. Mode ties resolve to the smallest value."""
    out = lens.agg(*_dist(x, "x"), *_dist(y, "y"), F.count(F.lit(1)).alias("total_datapoints"))
    return out.select(*[F.round(c, 6).alias(c) if c.endswith(("_avg", "_median")) else F.col(c)
                        for c in out.columns])


THRESHOLDS = (512, 1024, 2048, 4096, 8192)


def length_stats_with_thresholds(lens: DataFrame, x: str = "x", y: str = "y",
                                 thresholds: Sequence[int] = THRESHOLDS) -> DataFrame:
    """Token sums, means and the share of samples with x + y >= t, one pass."""
    tot = F.col(x) + F.col(y)
    aggs = [F.coalesce(F.sum(x), F.lit(0)).alias("x_total_toks"),
            F.coalesce(F.sum(y), F.lit(0)).alias("y_total_toks"),
            F.round(F.coalesce(F.avg(x), F.lit(0.0)), 6).alias("x_avg"),
            F.round(F.coalesce(F.avg(y), F.lit(0.0)), 6).alias("y_avg")]
    aggs += [F.round(F.coalesce(F.avg(F.when(tot >= t, 1).otherwise(0)), F.lit(0.0)), 6)
              .alias(f"geq_{t}") for t in thresholds]
    aggs.append(F.count(F.lit(1)).alias("total_datapoints"))
    return lens.agg(*aggs)


# ---------------------------------------------------------------- corpus layout

def group_by_logic_theory(paths: DataFrame, path: str = "path", rel: str = "rel") -> DataFrame:
    """(logic, theory, proof_num, path) for every ``proof<digits>.json``:
    logic = first part of the relative path, theory = parent directory +
    '.thy' (same-named theories in different folders merge). Other names are
    skipped. The sorted list of the reference is this long table ordered by
    (logic, theory, proof_num); ``theory_summary`` gives one row per group."""
    parts = F.split(F.col(rel), "/")
    num = F.regexp_extract(F.try_element_at(parts, F.lit(-1)), r"proof(\d+)\.json$", 1)
    return (paths.where(num != "")
                 .select(F.try_element_at(parts, F.lit(1)).alias("logic"),
                         F.concat(F.try_element_at(parts, F.lit(-2)), F.lit(".thy")).alias("theory"),
                         num.cast("long").alias("proof_num"), F.col(path)))


def theory_summary(grouped: DataFrame) -> DataFrame:
    """Per (logic, theory) the number of proofs and first/last by number."""
    return grouped.groupBy("logic", "theory").agg(
        F.count(F.lit(1)).alias("n_proofs"), F.min("proof_num").alias("first_num"),
        F.max("proof_num").alias("last_num"), F.min_by("path", "proof_num").alias("first_path"))


def distinct_terms(df: DataFrame, key: Sequence[str], terms: Column, name: str = "term") -> DataFrame:
    """Distinct terms per key (explode + distinct, no per-key collection)."""
    return df.select(*key, F.explode(terms).alias(name)).distinct()


def generic_fold(df: DataFrame, by: Sequence[str], mapped: Column, merge: str = "sum",
                 source: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """fold = per-row map (a Column) + decomposable merge aggregate
    ('sum', 'min', 'max', 'count', 'collect_set'). Rows whose map fails (null
    result for a non-null ``source``) are reported in a side table, not
    folded - like the reference's fold that skips and reports failing paths."""
    x = df.withColumn("_m", mapped)
    failed = x.where(F.col("_m").isNull() & (source.isNotNull() if source is not None else F.lit(True)))
    ok = x.where(F.col("_m").isNotNull())
    agg = {"sum": F.sum, "min": F.min, "max": F.max, "count": F.count, "collect_set": F.collect_set}[merge]
    return ok.groupBy(*by).agg(agg("_m").alias("folded")), failed.drop("_m")
