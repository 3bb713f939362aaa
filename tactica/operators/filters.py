"""Filters and predicates (F01-F07). Predicates are Columns, so Catalyst can
push them into scans and fuse them into whole-stage code."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Context length (tokens) per data format, seq2seq models.
T5_CTX_LENGTHS = {
    "state": 1024, "state_prems": 2048, "state_prems_kwrds": 4096,
    "state_prems_kwrds_terms": 8192, "finetune_state": 1024, "finetune_state_prems": 2048,
    "finetune_state_prems_kwrds": 4096, "finetune_state_prems_kwrds_terms": 8192,
}
# Context length (tokens) per data format, chat models.
CHAT_CTX_LENGTHS = {
    "state": 1024, "state_prems": 4096, "state_prems_kwrds": 4096,
    "state_prems_kwrds_terms": 8192,
}


def skip_long_proofs(df: DataFrame, keep: Column) -> DataFrame:
    """keep proofs satisfying ``keep`` (default rule: at most 5 steps)."""
    return df.where(keep)


def count_skipped(df: DataFrame, keep: Column, by: Sequence[str] = ()) -> DataFrame:
    """how many proofs the predicate drops (per group)."""
    return df.groupBy(*by).agg(F.sum(F.when(~keep, 1).otherwise(0)).alias("skipped"),
                               F.count(F.lit(1)).alias("total"))


def context_length_filter(df: DataFrame, data_format: str, total_tokens: Column,
                          limits: dict[str, int] = T5_CTX_LENGTHS) -> DataFrame:
    """drop samples whose input + target tokens exceed the format's limit.
    The limit is a literal (one format per job), so this is a pushed filter."""
    if data_format not in limits:
        raise ValueError(f"no context length for format {data_format!r}")
    return df.where(total_tokens <= F.lit(limits[data_format]))


def all_of(preds: Sequence[Column]) -> Column:
    """conjunction of predicates (true when empty)."""
    return functools.reduce(operator.and_, preds, F.lit(True))


def any_of(preds: Sequence[Column]) -> Column:
    """disjunction of predicates (false when empty)."""
    return functools.reduce(operator.or_, preds, F.lit(False))


def negate(pred: Column) -> Column:
    """negation."""
    return ~pred


def has_many(arr: Column) -> Column:
    """more than one element."""
    return F.size(arr) > 1


def bad_sample_flags(df: DataFrame, key: Sequence[str], float_arrays: Sequence[str] = (),
                     labels: str | None = None, loss: str | None = None,
                     mask_value=-100) -> DataFrame:
    """one row per (key, reason) for NaN inputs, fully masked labels or NaN loss."""
    reasons = []
    for c in float_arrays:
        reasons.append(F.when(F.exists(c, lambda v: F.isnan(v)), F.lit(f"nan_{c}")))
    if labels:
        reasons.append(F.when(F.forall(labels, lambda v: v == F.lit(mask_value)), F.lit("all_masked")))
    if loss:
        reasons.append(F.when(F.isnan(loss), F.lit("nan_loss")))
    flagged = df.select(*key, F.explode(F.filter(F.array(*reasons), lambda r: r.isNotNull())).alias("reason"))
    return flagged
