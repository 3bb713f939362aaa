"""Ordered-sequence operators over (group, pos) tables (W03-W07, W09, W13, W14; W08 is in ``patterns``).

A sequence is the rows of one group (proof, session) ordered by a dense
position. Predicates are boolean Columns. Nothing collects a group: run and
piece ids come from skew-safe row numbering (``pos - rank among rows with the
same flag`` is constant along a run), first hits are partial ``min``
aggregates joined back, and neighbourhoods are equi-joins on (group, pos + k).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactica.operators.ordering import number_rows, running_sum


def positions_where(df: DataFrame, key: Sequence[str], pos: str, pred: Column) -> DataFrame:
    """Positions satisfying ``pred`` (and per group the first one)."""
    return df.where(pred).select(*key, pos)


def first_position(df: DataFrame, key: Sequence[str], pos: str, pred: Column,
                   name: str = "first_hit") -> DataFrame:
    """W03 find_first: per group the smallest position satisfying ``pred``."""
    return df.groupBy(*key).agg(F.min(F.when(pred, F.col(pos))).alias(name))


def runs_by_predicate(df: DataFrame, key: Sequence[str], pos: str, pred: Column) -> DataFrame:
    """Maximal runs on which ``pred`` is constant: (key, flag, start, end, length).

    Gaps and islands without a window over the group: within rows of equal
    flag, ``pos - rank`` is constant exactly along a run.
    """
    x = df.withColumn("_flag", F.coalesce(pred, F.lit(False)))
    x = number_rows(x, [*key, "_flag"], [pos], "_rk")
    return (x.groupBy(*key, "_flag", (F.col(pos) - F.col("_rk")).alias("_grp"))
             .agg(F.min(pos).alias("start"), F.max(pos).alias("end"), F.count(F.lit(1)).alias("length"))
             .select(*key, F.col("_flag").alias("flag"), "start", "end", "length"))


def classify(df: DataFrame, pred: Column) -> tuple[DataFrame, DataFrame]:
    """W04 two-way partition: (rows satisfying, rows not satisfying)."""
    p = F.coalesce(pred, F.lit(False))
    return df.where(p), df.where(~p)


def neighbourhoods(df: DataFrame, key: Sequence[str], pos: str, pred: Column, radius: int,
                   cols: Sequence[str] = ()) -> DataFrame:
    """For each row satisfying ``pred``, the rows within ``radius`` on
    both sides (clipped at the ends); radius 0 gives nothing. Long form:
    (key, center, offset, pos, cols). Each center emits its 2r+1 keys, then an
    equi-join on (key, pos) - bounded fan-out, no range join."""
    if radius < 0:
        raise ValueError("negative radius")
    if radius == 0:
        return df.limit(0).select(*key, F.col(pos).alias("center"), F.lit(0).alias("offset"), pos, *cols)
    centers = df.where(pred).select(*key, F.col(pos).alias("center"),
                                    F.explode(F.sequence(F.lit(-radius), F.lit(radius))).alias("offset"))
    centers = centers.withColumn(pos, F.col("center") + F.col("offset"))
    return centers.join(df.select(*key, pos, *cols), [*key, pos])


def until_while_cuts(df: DataFrame, key: Sequence[str], pos: str, pred: Column) -> DataFrame:
    """Flags for take_until (hit kept), take_until' (hit dropped),
    drop_until (from the hit), drop_until' (after the hit), take_while and
    drop_while, from the first hit and the first miss of each group."""
    p = F.coalesce(pred, F.lit(False))
    firsts = df.groupBy(*key).agg(F.min(F.when(p, F.col(pos))).alias("_hit"),
                                  F.min(F.when(~p, F.col(pos))).alias("_miss"))
    x = df.join(firsts, list(key))
    hit, miss, q = F.col("_hit"), F.col("_miss"), F.col(pos)
    return x.withColumns({
        "take_until": hit.isNull() | (q <= hit),
        "take_until_excl": hit.isNull() | (q < hit),
        "drop_until": hit.isNotNull() & (q >= hit),
        "drop_until_excl": hit.isNotNull() & (q > hit),
        "take_while": miss.isNull() | (q < miss),
        "drop_while": miss.isNotNull() & (q >= miss),
    }).drop("_hit", "_miss")


def split_when(df: DataFrame, key: Sequence[str], pos: str, pred: Column) -> DataFrame:
    """Piece id = number of hits before the row; a hit ends its piece.
    Also ``part`` of the split at the first hit (0 = up to and including it,
    1 = after) and the trisection (before / at / after)."""
    p = F.coalesce(pred, F.lit(False))
    x = number_rows(df.withColumn("_flag", p), [*key, "_flag"], [pos], "_rk")
    x = x.withColumn("piece", F.when(F.col("_flag"), F.col("_rk")).otherwise(F.col(pos) - F.col("_rk")))
    firsts = x.groupBy(*key).agg(F.min(F.when(F.col("_flag"), F.col(pos))).alias("_hit"))
    x = x.join(firsts, list(key))
    hit, q = F.col("_hit"), F.col(pos)
    return x.withColumns({
        "part": F.when(hit.isNull() | (q <= hit), 0).otherwise(1),
        "trisect": F.when(hit.isNull() | (q < hit), "before").when(q == hit, "at").otherwise("after"),
    }).drop("_flag", "_rk", "_hit")


def running_fold(df: DataFrame, key: Sequence[str], pos: str, value: Column,
                 keep: Column | None = None, name: str = "state") -> DataFrame:
    """Every intermediate state of a sum fold (skew-safe running sum);
    with ``keep`` (a predicate on the state column ``name``) the fold stops at
    the first state failing it: ``stopped`` marks the rows handed back."""
    out = running_sum(df, key, [pos], {name: value})
    if keep is None:
        return out
    first_fail = out.groupBy(*key).agg(F.min(F.when(~keep, F.col(pos))).alias("_fail"))
    out = out.join(first_fail, list(key))
    return out.withColumn("stopped", F.col("_fail").isNotNull() & (F.col(pos) >= F.col("_fail"))) \
              .drop("_fail")


def proven_so_far(steps: DataFrame, key: Sequence[str], pos: str, is_apply: Column,
                  goal: str, closes: Column, facts: str) -> DataFrame:
    """Terms proved before each step, newest first.

    Step i adds the previous goal when steps i and i-1 are both apply steps,
    and the previous step's new facts when step i is not an apply step and
    step i-1 closed a proof. The additions are computed per row from the
    previous row (equi-join on pos - 1). Returned: (key, _at, _i, term), the
    terms that step _at adds, the newest first (_i from 0); ``proven_lists``
    makes the lists of all terms known at each step from them.
    """
    x = steps.select(*key, pos, is_apply.alias("_ap"), F.col(goal).alias("_goal"),
                     closes.alias("_cl"), F.col(facts).alias("_facts"))
    prev = x.select(*key, (F.col(pos) + 1).alias(pos), F.col("_ap").alias("_pap"),
                    F.col("_goal").alias("_pgoal"), F.col("_cl").alias("_pcl"), F.col("_facts").alias("_pfacts"))
    j = x.join(prev, [*key, pos], "left")
    adds = F.when(F.col("_ap") & F.coalesce(F.col("_pap"), F.lit(False)), F.array(F.col("_pgoal"))) \
            .when(~F.col("_ap") & F.coalesce(F.col("_pcl"), F.lit(False)), F.col("_pfacts"))
    added = j.select(*key, F.col(pos).alias("_at"), F.posexplode(adds).alias("_i", "term"))
    return added


def proven_lists(added: DataFrame, steps: DataFrame, key: Sequence[str], pos: str) -> DataFrame:
    """W13, the lists themselves: (key, pos, k, term) = the k-th newest term
    (from 0) known at step ``pos``, for every step. The terms are numbered in
    order once (skew-safe); a step knows the first m of them, with m a running
    sum over the steps, and its k-th newest is number m - 1 - k. As many rows
    as the lists hold together, which is the result."""
    terms = number_rows(added.withColumn("_back", -F.col("_i")), key, ["_at", "_back"], "_n")
    adds = added.groupBy(*key, F.col("_at").alias(pos)).agg(F.count(F.lit(1)).alias("_a"))
    counts = steps.select(*key, pos).join(adds, [*key, pos], "left").withColumn("_a", F.coalesce("_a", F.lit(0)))
    known = running_sum(counts, key, [pos], {"_m": F.col("_a")}).where("_m > 0")
    places = known.select(*key, pos, F.posexplode(F.sequence(F.col("_m") - 1, F.lit(0).cast("long"), F.lit(-1).cast("long"))).alias("k", "_n"))
    return places.join(terms.select(*key, "_n", "term"), [*key, "_n"]).select(*key, pos, "k", "term")


def trailing_run(df: DataFrame, key: Sequence[str], pos: str, in_proof: Column,
                 item: str) -> DataFrame:
    """The trailing run of in-proof rows of each group, plus the action
    right after the last finished run (its closing action)."""
    runs = runs_by_predicate(df, key, pos, in_proof)
    last = df.groupBy(*key).agg(F.max(pos).alias("_last"))
    trailing = runs.join(last, list(key)).where(F.col("flag") & (F.col("end") == F.col("_last"))) \
                   .select(*key, F.col("start").alias("trail_start"), F.col("end").alias("trail_end"))
    finished = runs.join(last, list(key)).where(F.col("flag") & (F.col("end") < F.col("_last"))) \
                   .groupBy(*key).agg(F.max_by(F.struct("start", "end"), "end").alias("_r"))
    closing = finished.select(*key, F.col("_r.start").alias("proof_start"), F.col("_r.end").alias("proof_end"),
                              (F.col("_r.end") + 1).alias(pos)) \
                      .join(df.select(*key, pos, F.col(item).alias("closing_action")), [*key, pos], "left") \
                      .drop(pos)
    return trailing.join(closing, list(key), "full")


def ordered_distinct(df: DataFrame, key: Sequence[str], pos: str, value: str) -> DataFrame:
    """Distinct values per group, first occurrence kept (its position
    gives the order) - a partial ``min`` aggregate, nothing collected."""
    return df.groupBy(*key, value).agg(F.min(pos).alias("first_pos"))


def top_distinct(df: DataFrame, group: Sequence[str], name: str, rank: str, n: int) -> DataFrame:
    """Ranked lists flattened in rank order, first occurrence per name,
    first ``n`` per group (skew-safe numbering of the distinct names)."""
    first = df.groupBy(*group, name).agg(F.min(rank).alias(rank))
    return number_rows(first, list(group), [rank], "position").where(F.col("position") < n)
