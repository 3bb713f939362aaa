"""Registered queries: evaluation of predictions and attempts
(A14-A21, S12, U02, T03, X04, F07, ST3 batch form)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tactica.functions import text as X
from tactica.operators import evaluation as ev
from tactica.operators.filters import bad_sample_flags
from tactica.operators.ordering import number_rows
from tactica.plans.registry import ORACLES, query, r6
from tactica.sources import adapters as ad

# Outcome of an attempt in the attempts adapter, by event kind (A17):
# signup = skipped, view = unnecessary, click = successful (progress),
# purchase = finished (progress that left proof mode), error = failed.
OUTCOME_BY_KIND = {"signup": "skipped", "view": "unnecessary", "click": "successful",
                   "purchase": "finished", "error": "failed"}


def _outcome(kind):
    expr = None
    for k, v in OUTCOME_BY_KIND.items():
        expr = F.when(kind == k, v) if expr is None else expr.when(kind == k, v)
    return expr


_OUTCOME_SQL = ("CASE kind WHEN 'signup' THEN 'skipped' WHEN 'view' THEN 'unnecessary' "
                "WHEN 'click' THEN 'successful' WHEN 'purchase' THEN 'finished' "
                "WHEN 'error' THEN 'failed' END")


# ----------------------------------------------------------------- A14 - A16, A19, F07

@query("a14_token_accuracy_metrics", """
, per AS (SELECT batch, loss,
            list_sum(list_transform(range(1, len(labels) + 1),
                     lambda i: CASE WHEN labels[i] = predicted[i] THEN 1 ELSE 0 END)) AS hits,
            len(labels) AS toks,
            CASE WHEN labels[1] = predicted[1] THEN 1 ELSE 0 END AS first FROM predictions)
SELECT batch, count(*) AS samples, round(avg(loss), 6) AS avg_loss,
       round(sum(hits) / sum(toks), 6) AS accuracy, round(sum(first) / count(*), 6) AS first_token_accuracy,
       CAST(sum(hits) AS BIGINT) AS correct_tokens, CAST(sum(toks) AS BIGINT) AS label_tokens
FROM per GROUP BY batch""", ("predictions",))
def a14_token_accuracy_metrics(spark, sf_dir):
    m = ev.token_accuracy_metrics(ad.predictions(spark, sf_dir), "labels", "predicted", "loss", ["batch"])
    return m.select("batch", "samples", r6("avg_loss").alias("avg_loss"), r6("accuracy").alias("accuracy"),
                    r6("first_token_accuracy").alias("first_token_accuracy"),
                    "correct_tokens", "label_tokens")


_CLASSES = """
, cls AS (SELECT batch, sample,
            len(list_filter(range(1, least(len(labels), len(predicted)) + 1),
                lambda i: labels[i] <> predicted[i])) = 0 AS exact,
            len(list_filter(range(1, least(len(labels), len(predicted)) + 1),
                lambda i: labels[i] = predicted[i])) = 0 AS all_wrong,
            coalesce(labels[1] = predicted[1], false) AS first_eq
          FROM predictions)
, cls2 AS (SELECT batch, sample, exact, all_wrong, first_eq AND NOT exact AS coincide FROM cls)
"""


@query("a15_match_classes", _CLASSES + """
SELECT count(*) AS total_count, CAST(sum(exact::INT) AS BIGINT) AS exacts_count,
       CAST(sum(coincide::INT) AS BIGINT) AS coincide_count, CAST(sum(all_wrong::INT) AS BIGINT) AS all_wrong_count,
       round(sum(exact::INT) / count(*), 6) AS exact_accuracy,
       round(sum(coincide::INT) / count(*), 6) AS coincide_accuracy,
       round(sum(all_wrong::INT) / count(*), 6) AS all_wrong_ratio FROM cls2""", ("predictions",))
def a15_match_classes(spark, sf_dir):
    c = ev.match_classes(ad.predictions(spark, sf_dir), "labels", "predicted", "batch")
    r = ev.match_ratios(c)
    return r.select("total_count", "exacts_count", "coincide_count", "all_wrong_count",
                    *[r6(x).alias(x) for x in ("exact_accuracy", "coincide_accuracy", "all_wrong_ratio")])


@query("a16_match_examples", _CLASSES + """
, long AS (SELECT batch, sample, 'exact' AS class FROM cls2 WHERE exact
           UNION ALL SELECT batch, sample, 'coincide' FROM cls2 WHERE coincide
           UNION ALL SELECT batch, sample, 'all_wrong' FROM cls2 WHERE all_wrong)
, firsts AS (SELECT class, batch, min(sample) AS sample FROM long GROUP BY ALL)
, chosen AS (SELECT class, batch, sample FROM firsts QUALIFY row_number() OVER (PARTITION BY class ORDER BY batch) <= 20)
SELECT class, batch, sample, array_to_string(labels, ' ') AS labels, array_to_string(predicted, ' ') AS predicted
FROM chosen JOIN predictions USING (batch, sample)""", ("predictions",))
def a16_match_examples(spark, sf_dir):
    c = ev.match_classes(ad.predictions(spark, sf_dir), "labels", "predicted", "batch")
    return ev.match_examples(c, "batch", "sample", 20).select(
        "class", "batch", "sample", F.array_join("labels", " ").alias("labels"), F.array_join("predicted", " ").alias("predicted"))


@query("a19_count_samples", """
, base AS (SELECT len(labels) AS n FROM predictions)
, chunks AS (SELECT CAST(ceil(greatest(0, n - 63) / 57.0) AS BIGINT) + 1 AS k FROM base)
SELECT CAST(sum(k) AS BIGINT) AS samples, CAST(ceil(sum(k) / 8.0) AS BIGINT) AS batches FROM chunks""",
       ("predictions",))
def a19_count_samples(spark, sf_dir):
    ch = ev.overlapping_chunks(ad.predictions(spark, sf_dir), "labels", 64, "<pad>", ["</s>"])
    return ev.count_samples(ch, 8)


@query("f07_bad_sample_flags", """
SELECT batch, sample, reason FROM (
  SELECT batch, sample, 'all_masked' AS reason FROM predictions
   WHERE len(list_filter(labels, lambda l: l <> '-100')) = 0
  UNION ALL SELECT batch, sample, 'nan_loss' FROM predictions WHERE isnan(loss))""", ("predictions",))
def f07_bad_sample_flags(spark, sf_dir):
    return bad_sample_flags(ad.predictions(spark, sf_dir), ["batch", "sample"], labels="labels",
                            loss="loss", mask_value="-100")


# ----------------------------------------------------------------- A17, A18, ST3

@query("a17_prover_outcomes", f"""
, o AS (SELECT 'L' || (proof % 7) AS logic, 'T' || (proof % 49) AS theory, {_OUTCOME_SQL} AS outcome, duration FROM attempts)
SELECT logic, theory, count(*) FILTER (WHERE outcome <> 'skipped') AS attempted,
       count(*) FILTER (WHERE outcome = 'skipped') AS skipped,
       count(*) FILTER (WHERE outcome = 'unnecessary') AS unnecessary,
       count(*) FILTER (WHERE outcome IN ('successful', 'finished')) AS successful,
       count(*) FILTER (WHERE outcome = 'failed') AS failed,
       count(*) FILTER (WHERE outcome = 'finished') AS finished,
       round(avg(duration) FILTER (WHERE outcome IN ('successful', 'finished', 'failed')), 6) AS avg_duration,
       round(median(duration) FILTER (WHERE outcome IN ('successful', 'finished', 'failed')), 6) AS median_duration
FROM o GROUP BY logic, theory""", ("attempts",))
def a17_prover_outcomes(spark, sf_dir):
    """Per logic and theory; the attempts' proofs stand for theories of seven logics."""
    a = ad.attempts(spark, sf_dir).select(
        F.concat(F.lit("L"), (F.col("proof") % 7).cast("string")).alias("logic"),
        F.concat(F.lit("T"), (F.col("proof") % 49).cast("string")).alias("theory"),
        _outcome(F.col("kind")).alias("outcome"), "duration")
    kinds = ("skipped", "unnecessary", "successful", "failed", "finished")
    c = ev.outcome_counts(a, ["logic", "theory"], "outcome", "duration", kinds, timed=("successful", "finished", "failed"))
    return c.select("logic", "theory", (F.col("rows") - F.col("skipped")).alias("attempted"), "skipped", "unnecessary",
                    (F.col("successful") + F.col("finished")).alias("successful"), "failed", "finished",
                    r6(F.col("avg_duration")).alias("avg_duration"), r6(F.col("median_duration")).alias("median_duration"))


_PER_PROOF = """
, per AS (SELECT proof, count(*) FILTER (WHERE kind = 'click') AS progress,
                 count(*) FILTER (WHERE kind = 'error') AS no_progress,
                 (count(*) FILTER (WHERE kind = 'purchase')) > 0 AS finished,
                 count(*) FILTER (WHERE kind = 'view' AND duration <= 50) AS correct_by,
                 count(*) FILTER (WHERE kind = 'view' AND duration > 50) AS incorrect_by,
                 (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS elapsed_s
          FROM attempts GROUP BY proof)
"""
TIME_LIMIT_S = 30 * 24 * 3600


def _per_proof(spark, sf_dir):
    a = ad.attempts(spark, sf_dir)
    return a.groupBy("proof").agg(
        F.count(F.when(F.col("kind") == "click", 1)).alias("progress"),
        F.count(F.when(F.col("kind") == "error", 1)).alias("no_progress"),
        (F.count(F.when(F.col("kind") == "purchase", 1)) > 0).alias("finished"),
        F.count(F.when((F.col("kind") == "view") & (F.col("duration") <= 50), 1)).alias("correct_by"),
        F.count(F.when((F.col("kind") == "view") & (F.col("duration") > 50), 1)).alias("incorrect_by"),
        # wall-clock difference of zone-free timestamps: independent of the
        # session time zone (no DST shift)
        (F.expr("timestampdiff(MICROSECOND, min(ts), max(ts))") / F.lit(1e6)).alias("elapsed_s"))


@query("a18_search_outcomes", _PER_PROOF + f"""
SELECT count(*) AS total_proofs, CAST(sum(progress) AS BIGINT) AS progress,
       CAST(sum(no_progress) AS BIGINT) AS no_progress, CAST(sum(correct_by) AS BIGINT) AS correct_by,
       CAST(sum(incorrect_by) AS BIGINT) AS incorrect_by, count(*) FILTER (WHERE finished) AS finished_proofs,
       count(*) FILTER (WHERE NOT finished AND elapsed_s > {TIME_LIMIT_S}) AS timed_out_proofs,
       round(count(*) FILTER (WHERE finished) / count(*), 6) AS success_rate,
       round(avg(elapsed_s) FILTER (WHERE finished), 6) AS avg_finished_duration_s
FROM per""", ("attempts",))
def a18_search_outcomes(spark, sf_dir):
    p = _per_proof(spark, sf_dir)
    fin = F.col("finished")
    return p.agg(F.count(F.lit(1)).alias("total_proofs"), F.sum("progress").alias("progress"),
                 F.sum("no_progress").alias("no_progress"), F.sum("correct_by").alias("correct_by"),
                 F.sum("incorrect_by").alias("incorrect_by"), F.count(F.when(fin, 1)).alias("finished_proofs"),
                 F.count(F.when(~fin & (F.col("elapsed_s") > TIME_LIMIT_S), 1)).alias("timed_out_proofs"),
                 r6(F.count(F.when(fin, 1)) / F.count(F.lit(1))).alias("success_rate"),
                 r6(F.avg(F.when(fin, F.col("elapsed_s")))).alias("avg_finished_duration_s"))


@query("st3_unit_timeout_batch", _PER_PROOF + f"""
SELECT proof, round(elapsed_s, 6) AS elapsed_s, NOT finished AND elapsed_s > {TIME_LIMIT_S} AS timed_out
FROM per""", ("attempts",))
def st3_unit_timeout_batch(spark, sf_dir):
    p = _per_proof(spark, sf_dir)
    return p.select("proof", r6("elapsed_s").alias("elapsed_s"),
                    (~F.col("finished") & (F.col("elapsed_s") > TIME_LIMIT_S)).alias("timed_out"))


# ----------------------------------------------------------------- A20, A21

@query("a20_training_curve", """
, b AS (SELECT kind AS run, row_number() OVER (PARTITION BY kind ORDER BY seq) AS batch,
               duration AS loss, CASE WHEN duration > 50 THEN 1 ELSE 0 END AS correct FROM attempts)
, blk AS (SELECT run, CAST(ceil(batch / 500) AS BIGINT) AS blk, count(*) AS n, sum(loss) AS l,
                 sum(correct) AS c, max(batch) AS last FROM b GROUP BY ALL)
, cum AS (SELECT run, least(blk * 500, last) AS batch,
                 sum(n) OVER w AS steps, sum(l) OVER w AS cl, sum(c) OVER w AS cc FROM blk
          WINDOW w AS (PARTITION BY run ORDER BY blk ROWS UNBOUNDED PRECEDING))
SELECT run, batch, CAST(steps AS BIGINT) AS steps, round(cl / steps, 6) AS avg_loss,
       round(cc / steps, 6) AS accuracy FROM cum""", ("attempts",))
def a20_training_curve(spark, sf_dir):
    a = ad.attempts(spark, sf_dir).withColumn("correct", (F.col("duration") > 50).cast("int")) \
        .withColumn("one", F.lit(1))
    a = number_rows(a, ["kind"], ["seq"], "batch", base=1)
    c = ev.training_curve(a, "kind", "batch", "duration", "correct", "one", every=500)
    return c.select(F.col("kind").alias("run"), "batch", "steps", r6("avg_loss").alias("avg_loss"),
                    r6("accuracy").alias("accuracy"))


def _log_lines(spark, sf_dir):
    a = ad.attempts(spark, sf_dir)
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS"), F.lit(" - INFO - "),
                    F.col("kind"), F.lit(" "), F.col("detail"))
    return a.select(F.col("seq").alias("pos"), F.col("kind"), line.alias("line"))


@query("a21_mean_repeat_time", """
, lines AS (SELECT seq AS pos, kind, strftime(ts, '%Y-%m-%d %H:%M:%S,%g') || ' - INFO - ' || kind || ' ' || detail AS line
            FROM attempts)
, hits AS (SELECT kind, pos, strptime(regexp_extract(line, '(\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2},\\d{3})', 1),
                                      '%Y-%m-%d %H:%M:%S,%g') AS t FROM lines WHERE contains(line, kind))
SELECT kind, count(*) AS hits,
       round(CASE WHEN count(*) >= 2 THEN (epoch_us(arg_max(t, pos)) - epoch_us(arg_min(t, pos))) / 1e6 / (count(*) - 1) END, 6)
         AS mean_repeat_s
FROM hits GROUP BY kind""", ("attempts",))
def a21_mean_repeat_time(spark, sf_dir):
    kinds = ("signup", "view", "click", "purchase", "error")
    m = ev.mean_repeat_times(_log_lines(spark, sf_dir).drop("kind"), kinds, "line", "pos", name="kind")
    return m.select("kind", "hits", r6("mean_repeat_s").alias("mean_repeat_s"))


# ----------------------------------------------------------------- S12, U02, T03, X04

def _metric_rows(spark, sf_dir):
    a = ad.attempts(spark, sf_dir)
    rows = F.array(
        F.struct(F.lit("count").alias("key"), F.lit("int").alias("kind"), F.lit("1").alias("value")),
        F.struct(F.lit("duration").alias("key"), F.lit("float").alias("kind"),
                 F.col("duration").cast("string").alias("value")),
        F.struct(F.lit("last_kind").alias("key"), F.lit("other").alias("kind"), F.col("kind").alias("value")),
        F.struct(F.lit("kinds").alias("key"), F.lit("list").alias("kind"), F.col("kind").alias("value")))
    return a.select(F.col("proof").alias("run"), "seq", F.explode(rows).alias("m")).select("run", "seq", "m.*")


@query("s12_merge_metric_records", """
, m AS (SELECT proof AS run, seq, 'count' AS key, 'int' AS kind, '1' AS value FROM attempts
        UNION ALL SELECT proof, seq, 'duration', 'float', CAST(duration AS VARCHAR) FROM attempts
        UNION ALL SELECT proof, seq, 'last_kind', 'other', kind FROM attempts)
SELECT run, key, arg_max(kind, seq) AS kind,
       round(CASE WHEN arg_max(kind, seq) = 'int' THEN CAST(sum(TRY_CAST(value AS BIGINT)) AS DOUBLE)
                  WHEN arg_max(kind, seq) = 'float' THEN sum(TRY_CAST(value AS DOUBLE)) END, 6) AS number,
       CASE WHEN arg_max(kind, seq) NOT IN ('int', 'float') THEN arg_max(value, seq) END AS text,
       count(*) AS updates
FROM m GROUP BY run, key""", ("attempts",))
def s12_merge_metric_records(spark, sf_dir):
    m = ev.merge_metric_records(_metric_rows(spark, sf_dir), ["run", "key"])
    return m.select("run", "key", "kind", r6("number").alias("number"), "text", "updates")


@query("s12_merge_metric_lists", """
SELECT proof AS run, 'kinds' AS key, row_number() OVER (PARTITION BY proof ORDER BY seq) - 1 AS position,
       kind AS value FROM attempts""", ("attempts",))
def s12_merge_metric_lists(spark, sf_dir):
    return ev.merge_metric_lists(_metric_rows(spark, sf_dir), ["run", "key"]).select(
        "run", "key", "position", "value")


@query("u02_dedup_attempts", """
, base AS (SELECT proof, arg_min(detail, seq) AS so_far FROM attempts GROUP BY proof)
, d AS (SELECT proof, detail, max(CASE WHEN kind = 'purchase' THEN 1 ELSE 0 END) AS p FROM attempts GROUP BY ALL)
, gate AS (SELECT proof, max(p) AS any_p FROM d GROUP BY proof)
SELECT proof, detail, p = 1 AS proved FROM d JOIN gate USING (proof) JOIN base USING (proof)
WHERE p = 1 OR (any_p = 0 AND detail <> so_far)""",
       ("attempts",))
def u02_dedup_attempts(spark, sf_dir):
    a = ad.attempts(spark, sf_dir).withColumn("proved", F.col("kind") == "purchase")
    so_far = a.groupBy("proof").agg(F.min_by("detail", "seq").alias("so_far"))
    a = a.join(so_far, "proof")
    return ev.dedup_attempts(a, "proof", "detail", "proved", so_far="so_far")


@query("t03_fastest_suggestion", """
SELECT proof,
       CASE WHEN count(*) FILTER (WHERE kind IN ('click', 'purchase')) > 0
            THEN arg_min(detail, (duration, seq)) FILTER (WHERE kind IN ('click', 'purchase'))
            ELSE 'No proof found' END AS suggestion,
       min(duration) FILTER (WHERE kind IN ('click', 'purchase')) AS time
FROM attempts GROUP BY proof""", ("attempts",))
def t03_fastest_suggestion(spark, sf_dir):
    a = ad.attempts(spark, sf_dir).withColumn("valid", F.col("kind").isin("click", "purchase"))
    return ev.fastest_suggestion(a, "proof", "detail", "duration", "valid", "seq")


@query("x04_parse_prover_message", """
, msgs AS (SELECT seq, CASE WHEN kind = 'error' THEN kind || ': timed out'
                            WHEN kind = 'view' THEN kind || ': Try this: by (' || detail || ') (' || printf('%.2f', duration) || ' s)'
                            ELSE kind || ': Try this: by ' || detail || ' (' || printf('%.2f', duration) || ' ms)' END AS msg
           FROM attempts)
, p AS (SELECT seq, msg, split_part(msg, ':', 1) AS prover,
               substring(msg, strpos(msg, ':')) AS rest FROM msgs
        WHERE contains(msg, ' ms)') OR contains(msg, ' s)'))
, q AS (SELECT *, string_split(rest, '(')[-1] AS time_part,
               rest[1:length(rest) - length(string_split(rest, '(')[-1])] AS proof_part FROM p)
, r AS (SELECT *, CASE WHEN strpos(proof_part, 'Try this:') > 0
                       THEN substring(proof_part, strpos(proof_part, 'Try this:') + 9) ELSE proof_part END AS after,
               regexp_replace(regexp_replace(time_part, '^ +', ''), '[ )]+$', '') AS t FROM q)
SELECT seq, prover, regexp_replace(regexp_replace(after, '^ +', ''), '[(, ]+$', '') AS proof,
       CASE WHEN regexp_extract(t, '^(\\d+(\\.\\d+)?)', 1) = '' THEN 0
            ELSE CAST(ceil(CAST(regexp_extract(t, '^(\\d+(\\.\\d+)?)', 1) AS DOUBLE)
                 * CASE WHEN contains(t, 'ms') THEN 1000.0 ELSE 1000000.0 END) AS BIGINT) END AS time_us,
       msg[1:length(msg) - length(string_split(msg, '(')[-1]) - 1] AS message
FROM r""", ("attempts",))
def x04_parse_prover_message(spark, sf_dir):
    a = ad.attempts(spark, sf_dir)
    dur = F.format_string("%.2f", F.col("duration"))
    msg = (F.when(F.col("kind") == "error", F.concat(F.col("kind"), F.lit(": timed out")))
            .when(F.col("kind") == "view", F.concat(F.col("kind"), F.lit(": Try this: by ("), F.col("detail"),
                                                    F.lit(") ("), dur, F.lit(" s)")))
            .otherwise(F.concat(F.col("kind"), F.lit(": Try this: by "), F.col("detail"), F.lit(" ("), dur,
                                F.lit(" ms)"))))
    m = a.select("seq", msg.alias("msg")).where(X.has_time(F.col("msg")))
    parsed = X.parse_prover_message(F.col("msg"))
    return m.select("seq", *[c.alias(n) for n, c in parsed.items()])


@query("st2_running_eval_metrics", """
SELECT kind AS run, count(*) AS steps, round(sum(duration) / count(*), 6) AS avg_loss,
       round(sum(CASE WHEN duration > 50 THEN 1 ELSE 0 END) / count(*), 6) AS accuracy
FROM attempts GROUP BY kind""", ("attempts",))
def st2_running_eval_metrics(spark, sf_dir):
    """ST2's aggregate over the whole attempt log (the streaming query runs the
    same ``running_metrics`` with the state store keeping one row per run)."""
    from tactica.streaming.ingest import running_metrics
    a = ad.attempts(spark, sf_dir).select(
        F.col("kind").alias("run"), F.col("duration").alias("loss"),
        (F.col("duration") > 50).cast("long").alias("correct"), F.lit(1).cast("long").alias("total"))
    m = running_metrics(a, "run", "loss", "correct", "total")
    return m.select("run", "steps", r6("avg_loss").alias("avg_loss"), r6("accuracy").alias("accuracy"))


def _streamed(df, build, name):
    """``build`` of ``df`` as a file stream, run to the end of what is there; the sink's rows."""
    import uuid

    from tactica.session import ensure_checkpoint_dir
    from tactica.streaming.stateful import state_store

    spark = df.sparkSession
    root = f"{ensure_checkpoint_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/in")
    state_store(spark)
    out = build(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 4).parquet(f"{root}/in"))
    q = (out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
         .trigger(availableNow=True).outputMode("append").start())
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{root}/out")


@query("st2_metrics_every_n", ORACLES["a20_training_curve"])
def st2_metrics_every_n(spark, sf_dir):
    """ST2 as a stream over the attempt log in micro-batches of four files: the rows of A20."""
    from tactica.streaming.stateful import metrics_every

    a = ad.attempts(spark, sf_dir).select("kind", "seq", "duration", (F.col("duration") > 50).cast("long").alias("correct"))
    a = number_rows(a, ["kind"], ["seq"], "batch", base=1, count_name="n").select(
        "kind", "batch", "duration", "correct", F.lit(1).alias("one"), (F.col("batch") == F.col("n")).alias("ends"))
    out = _streamed(a, lambda s: metrics_every(s, "kind", "batch", "duration", "correct", "one", F.col("ends"), every=500), "st2")
    return out.select("run", "batch", "steps", r6("avg_loss").alias("avg_loss"), r6("accuracy").alias("accuracy"))


@query("st3_unit_timeout_stream", """
, per AS (SELECT proof, min(ts) AS first, max(ts) AS last, bool_or(kind = 'purchase') AS finished FROM attempts WHERE ts IS NOT NULL GROUP BY proof)
, clock AS (SELECT max(ts) - INTERVAL 1 DAY AS now FROM attempts)
SELECT proof, finished, CASE WHEN finished THEN last - first > INTERVAL 2 DAY ELSE true END AS timed_out
FROM per, clock WHERE finished OR first + INTERVAL 2 DAY <= now""", ("attempts",))
def st3_unit_timeout_stream(spark, sf_dir):
    """ST3 as a stream: all rows in one micro-batch, then the watermark's timers."""
    from tactica.streaming.stateful import unit_timeouts

    a = ad.attempts(spark, sf_dir).select("proof", "ts", "kind").coalesce(4)
    out = _streamed(a, lambda s: unit_timeouts(s, "proof", "ts", F.col("kind") == "purchase", limit="2 days", watermark="1 day"), "st3")
    return out.select("proof", "finished", "timed_out")
