"""Order-based building blocks that stay correct and balanced under skew.

A window ``PARTITION BY g ORDER BY o`` puts every row of a group into one
task. When one logic, theory or session holds a third of the corpus, that
task holds a third of the data. The helpers below give the same answers
without ever routing a whole group through one task:

* ``number_rows`` cuts each group into equally filled buckets of its order key, numbers rows
  per (group, bucket) and adds the sizes of the earlier buckets, so no task
  holds more than one bucket of a hot group.
* ``neighbour`` replaces ``lag``/``lead`` over dense positions with an
  equi-join on the unique composite key (group, pos +/- k), which hashes a hot
  group across all partitions.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(names: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def _cut_points(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int) -> list[tuple]:
    """About ``n`` cut points of the order key: quantiles of a sample of 16 n
    rows (those with the smallest hashes). Any cut points give right answers;
    these make the buckets hold about equally many rows."""
    keys = list(dict.fromkeys(order))
    sample = df.select(*dict.fromkeys([*by, *keys])).orderBy(F.xxhash64(*by, *keys), *keys).limit(16 * n)
    rows = sorted((tuple(r[k] for k in keys) for r in sample.collect()),
                  key=lambda t: tuple((v is not None, v) for v in t))
    return sorted(set(rows[i] for i in range(16, len(rows), 16)),
                  key=lambda t: tuple((v is not None, v) for v in t))


def bucket_of(df: DataFrame, by: Sequence[str], order: Sequence[str], n: int | None = None) -> Column:
    """A number that never falls along ``order`` (ascending, nulls first) and
    splits the rows into about ``n`` (default: four per shuffle partition)
    buckets of about equal size, whatever the type and the spread of the key.
    A pure function of the row once the cut points are fetched."""
    n = n or 4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = list(dict.fromkeys(order))
    cuts = _cut_points(df, by, keys, n)
    if not cuts:
        return F.lit(0)
    types = [df.schema[k].dataType for k in keys]
    if len({c[0] for c in cuts}) == len(cuts) and cuts[0][0] is not None:
        literal, own = (lambda c: F.lit(c[0]).cast(types[0])), F.col(keys[0])
    else:  # ties in the first key: the others decide
        literal = lambda c: F.struct(*[F.lit(v).cast(t).alias(k) for v, t, k in zip(c, types, keys)])
        own = F.struct(*[F.col(k).alias(k) for k in keys])
    side = max(1, int(len(cuts) ** 0.5))
    rows = [F.array(*map(literal, cuts[i:i + side])) for i in range(0, len(cuts), side)]
    # no lambda holds a column of the row: the optimizer can overlook a column of the session's first
    # table inside one, and then pushes a filter on it to the wrong side of a join
    under = lambda c, x: F.coalesce((c <= x).cast("int"), F.lit(0))
    row = F.greatest(reduce(add, [under(c, own) for c in map(literal, cuts[::side])]), F.lit(1))
    count = F.aggregate(F.element_at(F.array(*rows), row), F.struct(own.alias("x"), F.lit(0).alias("n")),
                        lambda s, c: F.struct(s["x"].alias("x"), (s["n"] + under(c, s["x"])).alias("n")), lambda s: s["n"])
    return (row - 1) * side + count


def number_rows(df: DataFrame, by: Sequence[str], order: Sequence[str],
                name: str = "rn", base: int = 0,
                count_name: str | None = None, buckets: int | None = None) -> DataFrame:
    """Add ``name`` = position of the row inside its ``by`` group.

    Equivalent to ``row_number() over (partition by by order by order) - 1 +
    base`` for ascending, unique ``order`` keys of any type, but skew-safe:
    rows are cut into buckets of about equal size along the order key
    (``bucket_of``), numbered inside (group, bucket) by a window, and shifted
    by the sizes of the earlier buckets of the group (a running sum over a
    table of at most #groups x #buckets rows). Every step is a pure function
    of the data, so a retried task reproduces the same numbers. Optionally
    adds ``count_name`` = size of the group. Group keys must be non-null.
    """
    x = df.withColumn("_b", bucket_of(df, by, order, buckets))
    inner = Window.partitionBy(*by, "_b").orderBy(*_cols(order))
    local = x.withColumn("_lr", F.row_number().over(inner))
    sizes = x.groupBy(*by, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_off", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    if count_name:
        sizes = sizes.withColumn(count_name, F.sum("_cnt").over(Window.partitionBy(*by)))
    out = local.join(sizes.drop("_cnt"), [*by, "_b"]).withColumn(
        name, F.col("_off") + F.col("_lr") - F.lit(1) + F.lit(base))
    return out.drop("_b", "_lr", "_off")


def running_sum(df: DataFrame, by: Sequence[str], order: Sequence[str],
                sums: dict[str, Column], buckets: int | None = None, how: str = "sum") -> DataFrame:
    """Add running (inclusive) sums - or maxima with ``how='max'`` - in
    ``order`` inside each ``by`` group, skew-safe in the same way as
    ``number_rows``: a window per (group, bucket) plus the totals of the
    earlier buckets (a table of at most #groups x #buckets rows)."""
    agg = {"sum": F.sum, "max": F.max}[how]
    x = df.withColumn("_b", bucket_of(df, by, order, buckets))
    for n, c in sums.items():
        x = x.withColumn(f"_v_{n}", c)
    inner = Window.partitionBy(*by, "_b").orderBy(*_cols(order)).rowsBetween(
        Window.unboundedPreceding, 0)
    local = x.select("*", *[agg(f"_v_{n}").over(inner).alias(f"_l_{n}") for n in sums])
    tot = x.groupBy(*by, "_b").agg(*[agg(f"_v_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0) if how == "sum" else F.lit(None)
    tot = tot.select(*by, "_b", *[F.coalesce(agg(f"_t_{n}").over(before), zero).alias(f"_o_{n}")
                                  for n in sums])
    out = local.join(tot, [*by, "_b"])
    if how == "sum":
        out = out.withColumns({n: F.col(f"_o_{n}") + F.col(f"_l_{n}") for n in sums})
    else:
        out = out.withColumns({n: F.greatest(F.col(f"_o_{n}"), F.col(f"_l_{n}")) for n in sums})
    return out.drop("_b", *[f"_{p}_{n}" for n in sums for p in ("v", "l", "o")])


def exact_median(df: DataFrame, by: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Exact median per group by way of the histogram of its values: counts per
    (group, value) are partial sums, and only the histogram is cumulated
    (skew-safe); no task holds the values of a group."""
    h = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    h = running_sum(h, by, [value], {"_upto": F.col("_n")})
    total = h.groupBy(*by).agg(F.max("_upto").alias("_all"))
    lo, hi = F.floor((F.col("_all") + 1) / 2), F.floor((F.col("_all") + 2) / 2)
    at = lambda k: (F.col("_upto") - F.col("_n") < k) & (k <= F.col("_upto"))
    x = h.join(total, list(by)).where(at(lo) | at(hi))
    mid = (F.max(F.when(at(lo), F.col(value))) + F.max(F.when(at(hi), F.col(value)))) / 2
    return x.groupBy(*by).agg(mid.alias(name))


def neighbour(df: DataFrame, key: Sequence[str], pos: str, offset: int,
              cols: Sequence[str], suffix: str) -> DataFrame:
    """Attach ``cols`` of the row at ``pos + offset`` in the same ``key`` group.

    Left join on (key, pos): null when no such row, like ``lag``/``lead``.
    Positions must be dense (0..n-1), which holds for exploded arrays.
    """
    other = df.select(*key, (F.col(pos) - F.lit(offset)).alias(pos),
                      *[F.col(c).alias(c + suffix) for c in cols])
    return df.join(other, [*key, pos], "left")


def group_sizes(df: DataFrame, by: Sequence[str], name: str = "n") -> DataFrame:
    """Group sizes by partial + final aggregation (map-side combine)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
