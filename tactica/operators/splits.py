"""Corpus ordering, train/valid/test splits, limits and sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactica.operators.ordering import number_rows

SPLITS = ("train", "valid", "test", "none")
# Split fractions of the reference (int() truncation of n * f).
TRAIN_FRACTION = 0.64
VALID_FRACTION = 0.16


def natural_order_key(df: DataFrame, dir_cols: Sequence[str], name_col: str = "name",
                      num_col: str = "proof_num", out: str = "sort_num") -> DataFrame:
    """Numeric order (2 < 10) unless some name in the directory has no number.

    ``out`` is the number when every file of the directory is numbered, else
    null for the whole directory (so the tie-breaker ``name_col`` decides).
    The per-directory flag comes from a partial aggregate joined back, never a
    window over the directory.
    """
    flags = df.groupBy(*dir_cols).agg(
        F.min(F.col(num_col).isNotNull().cast("int")).alias("_all_numbered"))
    return (df.join(flags, list(dir_cols))
              .withColumn(out, F.when(F.col("_all_numbered") == 1, F.col(num_col)))
              .drop("_all_numbered"))


def split_label(rank: Column, n: Column) -> Column:
    """W01 rule for the 0-based ``rank`` of a file in a directory of ``n``."""
    nd = n.cast("double")
    train = F.floor(nd * F.lit(TRAIN_FRACTION))
    valid = train + F.floor(nd * F.lit(VALID_FRACTION))
    return F.when(rank < train, "train").when(rank < valid, "valid").otherwise("test")


def assign_split(df: DataFrame, dir_cols: Sequence[str], order_cols: Sequence[str],
                 rank_name: str = "_rn") -> DataFrame:
    """Add ``split`` per directory: first int(0.64 n) train, next int(0.16 n)
    valid, rest test, in ``order_cols`` order. One skew-safe numbering pass
    gives both the rank and the directory size; pass ``rank_name`` to keep
    the rank as a column."""
    numbered = number_rows(df, dir_cols, order_cols, rank_name, 0, count_name="_n")
    out = numbered.withColumn("split", split_label(F.col(rank_name), F.col("_n"))).drop("_n")
    return out if rank_name != "_rn" else out.drop("_rn")


def dataset_split(df: DataFrame, split: str, dir_cols: Sequence[str],
                  order_cols: Sequence[str]) -> DataFrame:
    """Rows of one split; ``none`` keeps everything. Unknown split -> error."""
    if split not in SPLITS:
        raise ValueError(f"Split must be one of {set(SPLITS)}")
    if split == "none":
        return df
    return assign_split(df, dir_cols, order_cols).where(F.col("split") == split).drop("split")


def seeded_dir_order(df: DataFrame, dir_cols: Sequence[str], seed: int | None,
                     out: str = "dir_rank") -> DataFrame:
    """Reproducible directory order. With a seed, directories are ordered
    by a seeded hash (same seed -> same order); without one, alphabetically.
    Files inside a directory keep their own (numeric) order."""
    key: Column
    if seed is None:
        key = F.concat_ws("/", *dir_cols)
    else:
        key = F.xxhash64(*[F.col(c) for c in dir_cols], F.lit(seed))
    return df.withColumn(out, key)


def first_n(df: DataFrame, n: int, order: Sequence[str | Column]) -> DataFrame:
    """stop after ``n`` rows in traversal order (TakeOrdered, no full sort)."""
    return df.orderBy(*order).limit(n)


def random_element(df: DataFrame, by: Sequence[str], key: Sequence[str], seed: int,
                   cap: int | None = None, order: Sequence[str] | None = None) -> DataFrame:
    """One uniformly chosen row per group, reproducible for a seed.

    The row with the smallest seeded hash of ``key`` wins (``min_by`` is a
    partial aggregate, so a hot group costs one row per task, not a sort).
    With ``cap`` only the first ``cap`` rows in ``order`` compete. An empty
    group yields no row.
    """
    src = df
    if cap is not None:
        src = number_rows(df, by, order or key, "_rn", 0).where(F.col("_rn") < cap).drop("_rn")
    h = F.xxhash64(*[F.col(c) for c in key], F.lit(seed))
    cols = [c for c in src.columns if c not in by]
    return (src.groupBy(*by)
               .agg(F.min_by(F.struct(*cols), h).alias("_pick"))
               .select(*by, "_pick.*"))

