"""Registered queries: folds with functions of the user's own."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tactica.operators import folds
from tactica.plans.registry import query
from tactica.sources import adapters as ad


def _sizes(spark, sf_dir):
    return ad.proofs(spark, sf_dir).where("logic IS NOT NULL").select("logic", "proof_id", (F.size("actions") - 1).alias("num_steps"))


def _largest(state, rows):
    """The three largest different step counts; a proof without steps is an error."""
    counts = rows.column(rows.schema.get_field_index("num_steps")).to_pylist()
    if min(counts) < 1:
        raise ValueError("no step")
    return sorted({*state, *counts})[-3:]


def _largest_fold(spark, sf_dir):
    return folds.user_fold(_sizes(spark, sf_dir), ["logic"], list, _largest, lambda a, b: sorted({*a, *b})[-3:],
                           lambda s: ",".join(map(str, reversed(s))), T.StringType(), ids=["proof_id"])


_SIZES = ", sizes AS (SELECT logic, proof_id, len(actions) - 1 AS num_steps FROM proofs WHERE logic IS NOT NULL)"


@query("a22_user_fold", _SIZES + """
, ranked AS (SELECT DISTINCT logic, num_steps, dense_rank() OVER (PARTITION BY logic ORDER BY num_steps DESC) AS r FROM sizes WHERE num_steps >= 1)
SELECT logic, string_agg(num_steps::VARCHAR, ',' ORDER BY r) AS folded FROM ranked WHERE r <= 3 GROUP BY logic""", ("proofs",))
def a22_user_fold(spark, sf_dir):
    """An accumulator that no built-in aggregate has, merged in a tree."""
    return _largest_fold(spark, sf_dir)[0]


@query("a22_user_fold_failures", _SIZES + """
SELECT logic, proof_id, 'ValueError: no step' AS error FROM sizes WHERE num_steps < 1""", ("proofs",))
def a22_user_fold_failures(spark, sf_dir):
    """The rows that the fold's step refused, with the error."""
    return _largest_fold(spark, sf_dir)[1]


def _backlog(state, rows):
    """Work left over when five steps are done between two proofs: never below nothing, so the order counts."""
    for n in rows.column(rows.schema.get_field_index("num_steps")).to_pylist():
        state = max(0, state + n - 5)
    return state


@query("a22_ordered_fold", _SIZES + """
, sums AS (SELECT logic, proof_id, sum(num_steps - 5) OVER (PARTITION BY logic ORDER BY proof_id) AS s FROM sizes)
SELECT logic, (arg_max(s, proof_id) - least(0, min(s)))::BIGINT AS folded FROM sums GROUP BY logic""", ("proofs",))
def a22_ordered_fold(spark, sf_dir):
    """A fold whose order counts, its state handed from chunk to chunk."""
    return folds.ordered_fold(_sizes(spark, sf_dir), ["logic"], ["proof_id"], int, _backlog, int, T.LongType())[0]
