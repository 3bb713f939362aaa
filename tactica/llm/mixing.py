"""Operator 12: mixing sources to target weights by capped water-filling.

The water level rises for all sources in proportion to their weights; a source
that reaches its cap (a number of epochs) is clamped there, and what it leaves
over is shared again by weight among the others, until none is above its cap.
Each turn is one aggregate over the table of sources.

A source's target then is a number of whole repetitions of all its documents
and a fraction of one more. The fraction is taken in a seeded order: a document
lies at a hash of its id and text, and those before a threshold are taken once
more. The threshold is found by radix descent: sizes are summed in 1,024 equal
parts of the hash space, the part in which the target is crossed is cut
again, until one place is left. So no source is ever sorted, and no task holds
more of a source than 1,024 sums. What then is left to the target goes to the
one document beyond the threshold that fits it best.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactica.llm.common import written

#: Bits of a place in the seeded order, and of one descent.
PLACE_BITS, STEP_BITS = 60, 10
#: Groups over which the copies of one boundary document are dealt.
SALTS = 256


def word_count(text: Column) -> Column:
    """Maximal runs of characters other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def weighted(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Add ``weight``: ``weights`` in turn along the sources by code point, null last.

    The sort deals ranges of sources over partitions; their sizes, one row a
    partition, give each range its first position."""
    part = written(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()), "mix-sources")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    first = part.groupBy("range").agg(F.count("*").alias("n")).select(
        "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    at = F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("first")
    turn = F.pmod(at, F.lit(len(weights))).cast("int")
    return part.join(first, "range").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("long")).drop("range", "first")


def water_fill(sources: DataFrame, epochs: int = 3) -> DataFrame:
    """Add ``target`` to sources (source, source_size, weight): all sizes shared by weight, none above ``epochs``
    times its size.

    The level (what is left to share over the weight that shares it) never
    falls, so a source clamped once stays clamped, and two integers are the
    whole state between turns. Compared in integers; ends when a turn clamps
    no other source.
    """
    wide = lambda c: c.cast("decimal(38,0)")
    cap = F.col("source_size") * epochs
    first = sources.agg(F.sum("source_size").alias("rest"), F.sum("weight").alias("weight")).first()
    total = rest = int(first["rest"] or 0)
    weight, clamped = int(first["weight"] or 0), 0
    while True:
        above = wide(cap) * wide(F.lit(weight)) < wide(F.col("weight")) * wide(F.lit(rest))
        turn = sources.agg(F.sum(F.when(above, cap)).alias("used"), F.sum(F.when(~above, F.col("weight"))).alias("weight"),
                           F.count_if(above).alias("n")).first()
        if turn["n"] == clamped or not turn["weight"]:
            share = F.lit(float(rest)) * F.col("weight") / F.lit(float(max(weight, 1)))
            return sources.withColumn("target", F.when(above, cap.cast("double")).otherwise(share))
        rest, weight, clamped = total - int(turn["used"]), int(turn["weight"]), turn["n"]


def _thresholds(places: DataFrame, sources: DataFrame) -> DataFrame:
    """For each source: ``whole`` repetitions, ``edge`` (the place where the fraction ends), ``extra`` of the ``rows``
    documents at the edge that are taken once more, ``filler`` (the place of one more document, or -1)."""
    sources = sources.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    # the words still to take inside the part of the hash space that begins with the bits ``part``
    state = sources.select("source", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("need"), F.lit(0).cast("long").alias("part"))
    found = None
    for shift in range(PLACE_BITS - STEP_BITS, -1, -STEP_BITS):
        inside = F.shiftright("place", shift + STEP_BITS).alias("part")
        sums = (places.select("source", "size", "place", inside)
                .join(state.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")) & (inside == state["part"]))
                .select("source", "whole", "need", "size", "place", F.shiftright("place", shift).alias("step"))
                .groupBy("source", "step").agg(F.first("whole").alias("whole"), F.first("need").alias("need"), F.sum("size").alias("words"),
                                               F.count("*").alias("rows"), F.min("place").alias("low"), F.max("place").alias("high")))
        upto = Window.partitionBy("source").orderBy("step")  # at most 1,024 rows of a source
        last = F.row_number().over(Window.partitionBy("source").orderBy(F.col("step").desc())) == 1
        crossing = (sums.withColumn("after", F.sum("words").over(upto)).withColumn("last", last)
                    .withColumn("need", F.col("need") - (F.col("after") - F.col("words")))
                    .where((F.col("need") >= 0) & ((F.col("need") < F.col("words")) | F.col("last")))
                    .withColumn("n", F.row_number().over(upto)).where("n = 1"))
        crossing = written(crossing.drop("n", "after", "last"), "mix-crossing")
        done = crossing.where("low = high").select("source", "whole", F.col("low").alias("edge"), "need", "words", "rows")
        found = done if found is None else found.unionByName(done)
        state = crossing.where("low < high").select("source", "whole", "need", F.col("step").alias("part"))
        if not shift or state.isEmpty():
            break
    # the rows of a place are copies of one document (id and text): all of one size
    one = F.when(F.col("words") > 0, F.col("words") / F.col("rows"))
    extra = F.coalesce(F.least(F.floor(F.col("need") / one), F.col("rows")), F.lit(0)).cast("long")
    edges = written(found.withColumn("one", one).withColumn("extra", extra)
                    .withColumn("rest", F.col("need") - F.col("extra") * F.coalesce("one", F.lit(0.0))), "mix-edges")
    # the rest: nothing more, one more at the edge, or the document beyond it whose size is nearest, whichever comes nearest
    here = edges.select(F.col("source").alias("_source"), F.col("edge").alias("_edge"), F.col("rest").alias("_rest"))
    best = (places.join(here, F.col("source").eqNullSafe(F.col("_source")) & (F.col("place") > F.col("_edge")))
            .groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("_rest")).alias("off"), F.col("place"))).alias("best"))
            .select(F.col("source").alias("_source"), "best.off", F.col("best.place").alias("filler")))
    alone = (places.select(F.col("source").alias("_s"), F.col("place").alias("_p"))
             .join(best, F.col("_s").eqNullSafe(F.col("_source")) & (F.col("_p") == F.col("filler")))
             .groupBy("_source", "off", "filler").agg(F.count("*").alias("_n")).where("_n = 1"))
    edges = edges.join(alone, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source", "_n")
    off = F.coalesce("off", F.lit(float("inf")))
    more = F.when(F.col("extra") < F.col("rows"), F.abs(F.col("one") - F.col("rest")))
    more = F.coalesce(more, F.lit(float("inf")))
    nearest = F.least(F.col("rest"), more, off)
    edges = edges.select(
        F.col("source").alias("_source"), F.col("whole").cast("long").alias("whole"), "edge", "rows",
        (F.col("extra") + ((nearest < F.col("rest")) & (nearest == more)).cast("long")).alias("extra"),
        F.when((nearest < F.col("rest")) & (nearest < more), F.col("filler")).otherwise(-1).alias("filler"))
    return sources.select("source", "source_size", "target").join(edges, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3, seed: int = 12, prefix: str = "") -> DataFrame:
    """Add size, source_size, target, repeats (times that the mix takes the document), taken (words: repeats * size).

    ``docs`` has doc_id, text and source. A null text has size 0; rows without
    source are a source of their own, the last. A source's target is a double;
    its words taken differ from it by half of one of its documents at most
    (mostly by a few words), a document is taken ``epochs`` times at most. Documents of size 0 add no
    words; they are repeated like the others of their source. Of equal rows at
    the end of the fraction some may be taken once more than others. An empty
    table gives an empty result. Reruns agree on any partitioning: the order is
    a hash of seed, id and text. Columns of the new names (after ``prefix``)
    are replaced.
    """
    new = [prefix + n for n in ("size", "source_size", "target", "repeats", "taken")]
    own = [c for c in docs.columns if c not in new]
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "text"), 64 - PLACE_BITS)
    measured = docs.select(*own, word_count(F.col("text")).alias("__size"), place.alias("__place"))
    places = written(measured.select("source", F.col("__size").alias("size"), F.col("__place").alias("place")), "mix-places")
    sources = places.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = written(water_fill(written(weighted(sources, weights), "mix-weights"), epochs), "mix-targets")
    plan = written(_thresholds(places, sources), "mix-plan")
    # the plan has one row a source; its size is known, and Spark broadcasts it only where that is small
    at = plan.select(*[F.col(c).alias("__" + c) for c in plan.columns])
    placed = measured.join(at, F.col("source").eqNullSafe(F.col("__source")))
    before = ((F.col("__place") < F.col("__edge")) | (F.col("__place") == F.col("__filler"))
              | ((F.col("__place") == F.col("__edge")) & (F.col("__extra") == F.col("__rows"))))
    repeats = F.col("__whole") + before.cast("long")
    split = (F.col("__place") == F.col("__edge")) & (F.col("__extra") > 0) & (F.col("__extra") < F.col("__rows"))

    def finish(df: DataFrame, repeats: Column) -> DataFrame:
        values = (F.col("__size"), F.col("__source_size"), F.col("__target"), repeats, repeats * F.col("__size"))
        return df.select(*own, *[v.alias(n) for v, n in zip(values, new)])

    if plan.where("extra > 0 AND extra < rows").isEmpty():
        return finish(placed, repeats)
    # copies at an edge: dealt over salts, numbered inside them behind the sizes of the salts before
    copies = written(placed.where(split).withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))), "mix-copies")
    sizes = copies.groupBy("__source", "__salt").agg(F.count("*").alias("__n"))
    before_salt = Window.partitionBy("__source").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(F.col("__source").alias("__s"), F.col("__salt").alias("__t"), F.coalesce(F.sum("__n").over(before_salt), F.lit(0)).alias("__before"))
    number = F.row_number().over(Window.partitionBy("__source", "__salt").orderBy("__place")) + F.col("__before")
    copies = copies.join(sizes, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("__salt") == F.col("__t"))).withColumn("__number", number)
    return finish(placed.where(~split), repeats).unionByName(
        finish(copies, F.col("__whole") + (F.col("__number") <= F.col("__extra")).cast("long")))


def repeated(mixed: DataFrame, prefix: str = "") -> DataFrame:
    """The mixed corpus itself: every document as often as ``repeats`` says (0: not at all)."""
    times = F.col(prefix + "repeats").cast("int")
    return mixed.where(times > 0).withColumn(prefix + "copy", F.explode(F.sequence(F.lit(1), times)))
