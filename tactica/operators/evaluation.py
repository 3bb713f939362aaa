"""Model and prover evaluation.

Metrics are sums and counts combined partially per task and finally per
key; every ratio is a ratio of sums (``try_divide``, 0 on empty), never a
driver-side reduction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tactica.functions.text import chunk_starts, pad_to


def overlapping_chunks(df: DataFrame, tokens: str, max_length: int, pad, special: Sequence = (),
                       target: str | None = None, label_pad=-100,
                       stride_fraction: float = 0.1) -> DataFrame:
    """Token arrays -> windows of ``max_length`` overlapping by
    int(stride_fraction * max_length), special tokens appended, padded, with
    attention mask; the (truncated, padded) target goes with every chunk,
    pads replaced by ``label_pad``. One output row per chunk (explode)."""
    stride = int(max_length * stride_fraction)
    content = max_length - len(special)
    n = F.size(tokens)
    out = df.select("*", F.posexplode_outer(chunk_starts(n, content, stride)).alias("chunk", "start")) \
            .where(F.col("chunk").isNotNull())
    body = F.concat(F.slice(tokens, F.col("start") + 1, content),
                    F.array(*[F.lit(s) for s in special]) if special else F.slice(tokens, 1, 0))
    n_real = F.least(F.lit(content), n - F.col("start"))
    cols = {
        "n_real": n_real,
        "input_ids": pad_to(body, max_length, pad),
        "attention_mask": pad_to(F.array_repeat(F.lit(1), n_real + len(special)), max_length, 0),
    }
    if target:
        tgt = F.concat(F.slice(target, 1, content),
                       F.array(*[F.lit(s) for s in special]) if special else F.slice(target, 1, 0))
        cols["labels"] = pad_to(tgt, max_length, label_pad)
    return out.withColumns(cols)


def count_samples(chunks: DataFrame, batch_size: int, by: Sequence[str] = ()) -> DataFrame:
    """Samples (after chunking) and batches = ceil(samples / batch_size)."""
    return chunks.groupBy(*by).agg(F.count(F.lit(1)).alias("samples")).withColumn(
        "batches", F.ceil(F.col("samples") / F.lit(batch_size)).cast("long"))


# ------------------------------------------------------------------ A14 - A16

def token_accuracy_metrics(df: DataFrame, labels: str, predicted: str, loss: str,
                           by: Sequence[str] = ("batch",), mask_value=None) -> DataFrame:
    """Mean loss, accuracy over unmasked label positions, first-token
    accuracy (every sample in the denominator) - per ``by`` group and as ratios
    of sums so the global figure is the same aggregation without ``by``.

    A label position is masked when it equals ``mask_value`` (-100 for token
    ids); a missing prediction at a position counts as wrong.
    """
    lab, pred = F.col(labels), F.col(predicted)
    unmasked = (lambda x: x.isNotNull()) if mask_value is None else (lambda x: x != F.lit(mask_value))
    hits = F.zip_with(lab, pred, lambda l, p: F.when(unmasked(l) & (l == p), 1).otherwise(0))
    counted = F.zip_with(lab, pred, lambda l, p: F.when(unmasked(l), 1).otherwise(0))
    per = df.select(
        *by, F.col(loss).alias("_loss"),
        F.aggregate(hits, F.lit(0), lambda a, x: a + x).alias("_hits"),
        F.aggregate(counted, F.lit(0), lambda a, x: a + x).alias("_toks"),
        F.when(F.try_element_at(lab, F.lit(1)) == F.try_element_at(pred, F.lit(1)), 1).otherwise(0).alias("_first"))
    return per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg("_loss").alias("avg_loss"),
        F.coalesce(F.try_divide(F.sum("_hits"), F.sum("_toks")), F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.try_divide(F.sum("_first"), F.count(F.lit(1))), F.lit(0.0)).alias("first_token_accuracy"),
        F.sum("_hits").alias("correct_tokens"), F.sum("_toks").alias("label_tokens"))


def match_classes(df: DataFrame, labels: str, predicted: str, batch: str = "batch",
                  pad=None) -> DataFrame:
    """Per sample exact / coincide / all_wrong over the common length.

    The leading prediction column is dropped only when every sample of the
    batch starts with ``pad`` (a per-batch ``min`` joined back, not a window).
    """
    pred = F.col(predicted)
    if pad is not None:
        starts = df.groupBy(batch).agg(
            F.min(F.when(F.try_element_at(pred, F.lit(1)) == F.lit(pad), 1).otherwise(0)).alias("_all_pad"))
        df = df.join(starts, batch).withColumn(
            predicted, F.when(F.col("_all_pad") == 1, F.slice(pred, 2, 1 << 30)).otherwise(pred)
        ).drop("_all_pad")
        pred = F.col(predicted)
    lab = F.col(labels)
    m = F.least(F.size(lab), F.size(pred))
    lt, pt = F.slice(lab, 1, m), F.slice(pred, 1, m)
    eq = F.zip_with(lt, pt, lambda a, b: a == b)
    exact = F.forall(eq, lambda e: e)
    first = F.try_element_at(lab, F.lit(1)) == F.try_element_at(pred, F.lit(1))
    return df.withColumns({
        "exact": exact,
        "coincide": F.coalesce(first, F.lit(False)) & ~exact,
        "all_wrong": F.forall(eq, lambda e: ~e),
    })


def match_ratios(classes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Ratios of the classes over all samples."""
    n = F.count(F.lit(1))
    return classes.groupBy(*by).agg(
        n.alias("total_count"),
        F.sum(F.col("exact").cast("int")).alias("exacts_count"),
        F.sum(F.col("coincide").cast("int")).alias("coincide_count"),
        F.sum(F.col("all_wrong").cast("int")).alias("all_wrong_count"),
        (F.sum(F.col("exact").cast("int")) / n).alias("exact_accuracy"),
        (F.sum(F.col("coincide").cast("int")) / n).alias("coincide_accuracy"),
        (F.sum(F.col("all_wrong").cast("int")) / n).alias("all_wrong_ratio"))


def match_examples(classes: DataFrame, batch: str, order: str, per_class: int = 20) -> DataFrame:
    """Up to ``per_class`` examples per class, at most one (the first) per batch.

    First per (class, batch) is a partial ``min``; the first ``per_class``
    batches per class come from the skew-safe numbering (a class is one of
    three groups, so a plain window would put all batches of it in one task).
    """
    long = classes.select("*", F.explode(F.array(
        F.when(F.col("exact"), F.lit("exact")), F.when(F.col("coincide"), F.lit("coincide")),
        F.when(F.col("all_wrong"), F.lit("all_wrong")))).alias("class")).where(F.col("class").isNotNull())
    firsts = long.groupBy("class", batch).agg(F.min(order).alias(order))
    from tactica.operators.ordering import number_rows
    chosen = number_rows(firsts, ["class"], [batch], "_r").where(F.col("_r") < per_class).drop("_r")
    # the examples themselves: at most 3 x per_class rows look up their sample
    return chosen.join(long, ["class", batch, order])


# ------------------------------------------------------------------ attempts

def outcome_counts(df: DataFrame, by: Sequence[str], outcome: str, duration: str,
                   outcomes: Sequence[str], timed: Sequence[str] | None = None) -> DataFrame:
    """One pass of conditional counts per group plus a duration summary
    over the attempts whose outcome is in ``timed`` (default: all); the median
    is exact (``exact_median``)."""
    from tactica.operators.ordering import exact_median
    o = F.col(outcome)
    x = df.withColumn("_d", F.when(o.isin(*timed), F.col(duration)) if timed else F.col(duration))
    counts = x.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(F.when(o == k, 1)).alias(k) for k in outcomes],
        F.avg("_d").alias("avg_duration"), F.max("_d").alias("max_duration"))
    return counts.join(exact_median(x, by, "_d", "median_duration"), list(by), "left")


def mean_repeat_time(lines: DataFrame, event_text: str, line: str = "line", pos: str = "pos",
                     by: Sequence[str] = (),
                     pattern: str = r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3})",
                     fmt: str = "yyyy-MM-dd HH:mm:ss,SSS") -> DataFrame:
    """Mean seconds between consecutive log lines containing ``event_text``.

    The mean of consecutive differences telescopes to (last - first) / (n - 1)
    in file order, so it is three partial aggregates - no sort, no window;
    null with fewer than two hits.
    """
    hits = lines.where(F.col(line).contains(event_text)).withColumn(
        "_ts", F.to_timestamp_ntz(F.regexp_extract(line, pattern, 1), F.lit(fmt))).where(F.col("_ts").isNotNull())
    agg = hits.groupBy(*by).agg(F.count(F.lit(1)).alias("hits"),
                                F.max_by("_ts", pos).alias("_last"), F.min_by("_ts", pos).alias("_first"))
    # log times carry no zone: parse and subtract them zone-free (no DST shift)
    diff = F.expr("timestampdiff(MICROSECOND, _first, _last)")
    return agg.select(*by, "hits", F.when(F.col("hits") >= 2, diff / F.lit(1e6) / (F.col("hits") - 1))
                      .alias("mean_repeat_s"))


def mean_repeat_times(lines: DataFrame, events: Sequence[str], line: str = "line", pos: str = "pos",
                      name: str = "event", **log) -> DataFrame:
    """A21 for several event texts in one pass: each line counts for every text
    that it contains."""
    texts = F.array(*[F.lit(e) for e in events])
    hits = lines.withColumn(name, F.explode(F.filter(texts, lambda e: F.contains(F.col(line), e))))
    return mean_repeat_time(hits, "", line, pos, by=[name], **log)


def training_curve(df: DataFrame, run: str, batch: str, loss: str, correct: str, total: str,
                   every: int = 1000, start: int = 0) -> DataFrame:
    """Every ``every`` batches (and at the last batch) the cumulative mean
    loss and token accuracy of the run.

    Rows are pre-aggregated per (run, block of ``every`` batches) - partial
    aggregation, skew-safe - and the running sum runs over the block table.
    """
    blk = F.ceil(F.col(batch) / F.lit(every)).cast("long")
    blocks = df.groupBy(run, blk.alias("_blk")).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(loss).alias("_loss"),
        F.sum(correct).alias("_c"), F.sum(total).alias("_t"), F.max(batch).alias("_last"))
    from tactica.operators.ordering import running_sum
    cum = running_sum(blocks, [run], ["_blk"], {"steps": F.col("_n"), "_cl": F.col("_loss"),
                                                "_cc": F.col("_c"), "_ct": F.col("_t")})
    cum = cum.withColumn("batch", F.least(F.col("_blk") * every, F.col("_last")))
    return cum.where(F.col("batch") >= start).select(
        run, "batch", "steps", (F.col("_cl") / F.col("steps")).alias("avg_loss"),
        F.coalesce(F.try_divide(F.col("_cc"), F.col("_ct")), F.lit(0.0)).alias("accuracy"))


# ------------------------------------------------------------------ S12

def merge_metric_records(df: DataFrame, key: Sequence[str], kind: str = "kind", value: str = "value",
                         seq: str = "seq", float_mode: str = "sum") -> DataFrame:
    """Merge long-form metric rows into a running record.

    ints add up, floats add up (``float_mode='last'``: last value wins, as the
    reference's fall-through does), anything else is overwritten by the last
    update in ``seq`` order. Lists are kept long (``merge_metric_lists``) so no
    list is ever collected into one row. Output: number for int/float, text
    for the rest.
    """
    v = F.col(value)
    k = F.max_by(kind, seq)  # the kind of the last update, when a key changes kind
    last = F.max_by(v, F.col(seq))
    floats = F.sum(v.try_cast("double")) if float_mode == "sum" else F.max_by(v.try_cast("double"), F.col(seq))
    return df.where(F.col(kind) != "list").groupBy(*key).agg(
        k.alias(kind),
        F.when(k == "int", F.sum(v.try_cast("long")).cast("double"))
         .when(k == "float", floats).alias("number"),
        F.when(~k.isin("int", "float"), last).alias("text"),
        F.count(F.lit(1)).alias("updates"))


def merge_metric_lists(df: DataFrame, key: Sequence[str], kind: str = "kind", value: str = "value",
                       seq: str = "seq") -> DataFrame:
    """List metrics concatenate: the merged list is the rows in ``seq``
    order, numbered skew-safely."""
    from tactica.operators.ordering import number_rows
    items = df.where(F.col(kind) == "list")
    return number_rows(items, list(key), [seq], "position").select(*key, "position", value)


# ------------------------------------------------------------------ U02, T03

def dedup_attempts(df: DataFrame, goal: str, actions: str, proved: str,
                   so_far: str | None = None) -> DataFrame:
    """Distinct attempts per goal by action sequence; when some attempt is
    proved only the proved ones stay, and nothing else is dropped; when none
    is, those equal to the proof so far are dropped."""
    first = df.groupBy(goal, actions).agg(F.max(F.col(proved).cast("int")).alias("_proved"))
    gate = first.groupBy(goal).agg(F.max("_proved").alias("_any"))
    x = first.join(gate, goal).where((F.col("_any") == 0) | (F.col("_proved") == 1))
    if so_far:
        known = df.select(goal, F.col(so_far).alias(actions)).where(F.col(actions).isNotNull()).distinct() \
                  .withColumn("_known", F.lit(True))
        x = x.join(known, [goal, actions], "left").where((F.col("_any") == 1) | F.col("_known").isNull())
    return x.select(goal, actions, (F.col("_proved") == 1).alias(proved))


def fastest_suggestion(df: DataFrame, goal: str, suggestion: str, time: str, valid: str,
                       tie: str, miss: str = "No proof found") -> DataFrame:
    """Per goal the valid suggestion with the smallest time (ties by
    ``tie``), else the miss message. ``min_by`` is a partial aggregate."""
    key = F.struct(F.col(time), F.col(tie))
    best = F.min_by(F.struct(F.col(suggestion).alias("s"), F.col(time).alias("t")),
                    F.when(F.col(valid), key))
    agg = df.groupBy(goal).agg(best.alias("_b"), F.max(F.col(valid).cast("int")).alias("_any"))
    return agg.select(goal, F.when(F.col("_any") == 1, F.col("_b")["s"]).otherwise(F.lit(miss)).alias("suggestion"),
                      F.when(F.col("_any") == 1, F.col("_b")["t"]).alias("time"))
