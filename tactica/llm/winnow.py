"""Operator 7: document fingerprints by winnowing, in DataFrame functions only.

Tokens are runs of up to 16 characters other than white space, lower-cased. A
polynomial (Karp-Rabin) hash is taken of every ``K`` tokens in a row, and of
every ``W`` such hashes in a row the smallest is selected, the rightmost of
equals; its position is kept. Two texts that share ``W + K - 1`` tokens in a
row share a selected hash, with the positions of the shared passage in both.

The guarantee is one of tokens, so it needs white space: a run of more than 16
characters without any (Chinese, Japanese or Thai text, base64) is cut from
its beginning on, and a passage inside such runs is found only where it lies at
the same distance from the beginning, up to a multiple of 16.

A selected hash and its position are one long: the hash above, the position
below, counted downwards, so that the smallest long of a window is the
rightmost smallest hash. Minima over a window come from two doubling steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K, W = 3, 4
#: Matches of so many tokens between white space (of 16 characters at most) are always found.
GUARANTEE = K + W - 1
# Base and modulus of the hash (the Mersenne prime 2^31 - 1).
BASE, PRIME = 1_000_003, 2_147_483_647
_LOW = (1 << 32) - 1

#: Documents to a bucket of the order by id, and most buckets.
BUCKET_ROWS, MAX_BUCKETS = 2000, 4096


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\S{1,16}"), F.lit(0))


def add_fingerprint(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Add ``out`` array<bigint>, the selected hashes with positions (see ``hash_of`` and ``position_of``).

    Null, empty and blank texts select nothing; texts of fewer than ``K`` tokens
    have one hash of all their tokens, and texts of fewer than ``W`` hashes
    select the rightmost smallest. Time is linear in the text.
    """
    h, g, v, m2 = (f"__{out}_{x}" for x in "hgv2")
    n = F.size(h)
    m = F.greatest(n - (K - 1), F.least(n, F.lit(1)))
    more = lambda a, b: (a * BASE + F.coalesce(b, F.lit(0))) % PRIME
    # each step is a projection of its own, so that an array is made once and not inside the next step's function
    df = df.withColumn(h, F.transform(_tokens(F.coalesce(F.col(text_col), F.lit(""))), lambda t: F.xxhash64(t).bitwiseAND(PRIME) % PRIME))
    rolled = F.slice(h, F.lit(1), m)
    for j in range(1, K):
        rolled = F.zip_with(rolled, F.slice(h, F.lit(j + 1), m), more)
    df = df.withColumn(g, rolled)
    df = df.withColumn(v, F.transform(g, lambda x, i: F.shiftleft(x, 32) + (_LOW - i)))
    shifted = lambda c, by: F.slice(c, F.lit(by + 1), F.greatest(F.size(c) - by, F.lit(0)))
    least = lambda a, b: F.least(a, b)
    df = df.withColumn(m2, F.zip_with(v, shifted(v, 1), least))
    windows = F.greatest(F.size(v) - (W - 1), F.least(F.size(v), F.lit(1)))
    df = df.withColumn(out, F.array_distinct(F.slice(F.zip_with(m2, shifted(m2, 2), least), F.lit(1), windows)))
    return df.drop(h, g, v, m2)


def hashes_of(selected) -> Column:
    """The distinct selected hashes."""
    return F.array_distinct(F.transform(selected, lambda x: F.shiftright(x, 32)))


def positions_of(selected) -> Column:
    """The positions of the selected hashes, in the order of the text."""
    return F.transform(selected, lambda x: _LOW - x.bitwiseAND(_LOW))


def fingerprint_text(selected) -> Column:
    """A fingerprint as a short string: a digest of its hashes and positions."""
    return F.sha2(F.concat_ws(",", F.col(selected).cast("array<string>")), 256)


def likeness(a, b) -> Column:
    """Shared over all hashes of two fingerprints (sets of hashes); 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    all_ = F.size(a) + F.size(b) - both
    return F.when(all_ == 0, 1.0).otherwise(both / all_)


def _buckets(docs: DataFrame) -> tuple[Column, int]:
    """A function of doc_id that grows with it, with about BUCKET_ROWS documents to a value (null ids: -1)."""
    n = docs.count()
    count = min(MAX_BUCKETS, max(1, n // BUCKET_ROWS))
    cuts = []
    if count > 1:
        steps = [i / count for i in range(1, count)]
        cuts = docs.agg(F.percentile_approx("doc_id", steps, 10 * count + 10_000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    side = max(1, int(len(cuts) ** 0.5))
    rows = [cuts[i:i + side] for i in range(0, len(cuts), side)]
    if not rows:
        return F.when(F.col("doc_id").isNull(), -1).otherwise(0), count
    many = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    below = lambda xs: F.size(F.filter(xs, lambda c: c <= F.col("doc_id")))
    row = F.greatest(below(many([r[0] for r in rows])), F.lit(1))
    bucket = (row - 1) * side + below(F.element_at(F.array(*[many(r) for r in rows]), row))
    return F.when(F.col("doc_id").isNull(), -1).otherwise(bucket), count


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    The edited text has the last floor(n/2) code points replaced by the first as
    many (or all) of the next document's. Next is by ascending doc_id, after the
    last the first; of repeated ids by a hash of the text; null ids come first.
    Documents are sorted within buckets of near ids; the first of a bucket is
    also sent to the bucket before. Null texts are empty. A single document is
    its own next; an empty table gives no rows. Further columns are ignored.
    Returns doc_id, n_chars, text, edited, selected, edited_selected,
    hashes, edited_hashes, next_hashes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bucket, _ = _buckets(docs.select("doc_id"))
    docs = docs.withColumn("bucket", bucket.cast("int"))
    # at most MAX_BUCKETS + 1 rows
    firsts = sorted(((r["bucket"], r["head"]) for r in docs.groupBy("bucket").agg(F.min("doc_id").alias("head")).collect()))
    before = [firsts[i - 1][0] for i in range(len(firsts))]
    spark = docs.sparkSession
    heads = spark.createDataFrame([(h, b) for (_, h), b in zip(firsts, before)], "head long, before int")
    guests = (docs.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head")))
              .select("doc_id", "text", F.col("before").alias("bucket"), F.lit(1).alias("guest")))
    rows = docs.withColumn("guest", F.lit(0)).unionByName(guests)
    rows = add_fingerprint(rows, "text", "selected")
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    # a text and its selected hashes are shuffled once, together
    rows = (rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_selected", F.lead("selected").over(order))
            .where("guest = 0"))
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - half),
                                              F.substr("next_text", F.lit(1), half)))
    rows = add_fingerprint(rows, "edited", "edited_selected")
    for name in ("", "edited_", "next_"):
        rows = rows.withColumn(name + "hashes", hashes_of(name + "selected"))
    return rows.select(
        "doc_id", "n_chars", "text", "edited", "selected", "edited_selected", "hashes", "edited_hashes", "next_hashes")
