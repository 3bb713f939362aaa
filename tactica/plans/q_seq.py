"""Registered queries: ordered-sequence operators over sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tactica.operators import patterns
from tactica.operators import sequences as S
from tactica.plans.registry import query
from tactica.sources import adapters as ad

KEY = ["session"]


def _user():
    return F.col("kind") == "user"


def _s(spark, sf_dir):
    return ad.sessions(spark, sf_dir)


@query("w03_positions_where", """
SELECT session, pos, pos = min(pos) OVER (PARTITION BY session) AS is_first
FROM sessions WHERE kind = 'user'""", ("sessions",))
def w03_positions_where(spark, sf_dir):
    s = _s(spark, sf_dir)
    hits = S.positions_where(s, KEY, "pos", _user())
    first = S.first_position(s, KEY, "pos", _user())
    return hits.join(first, KEY).select("session", "pos", (F.col("pos") == F.col("first_hit")).alias("is_first"))


@query("w04_runs_by_predicate", """
, f AS (SELECT session, pos, kind = 'user' AS flag FROM sessions)
, g AS (SELECT *, pos - row_number() OVER (PARTITION BY session, flag ORDER BY pos) AS grp FROM f)
SELECT session, flag, min(pos) AS start, max(pos) AS "end", count(*) AS length
FROM g GROUP BY session, flag, grp""", ("sessions",))
def w04_runs_by_predicate(spark, sf_dir):
    return S.runs_by_predicate(_s(spark, sf_dir), KEY, "pos", _user())


@query("w05_neighbourhoods", """
SELECT c.session, c.pos AS center, s.pos - c.pos AS "offset", s.pos, s.kind
FROM sessions c JOIN sessions s ON s.session = c.session AND s.pos BETWEEN c.pos - 1 AND c.pos + 1
WHERE c.kind = 'user'""", ("sessions",))
def w05_neighbourhoods(spark, sf_dir):
    return S.neighbourhoods(_s(spark, sf_dir), KEY, "pos", _user(), 1, ["kind"]).select(
        "session", "center", "offset", "pos", "kind")


@query("w06_until_while_cuts", """
, f AS (SELECT session, min(pos) FILTER (WHERE kind = 'user') AS hit,
               min(pos) FILTER (WHERE kind <> 'user') AS miss FROM sessions GROUP BY session)
SELECT s.session, s.pos,
       hit IS NULL OR pos <= hit AS take_until, hit IS NULL OR pos < hit AS take_until_excl,
       hit IS NOT NULL AND pos >= hit AS drop_until, hit IS NOT NULL AND pos > hit AS drop_until_excl,
       miss IS NULL OR pos < miss AS take_while, miss IS NOT NULL AND pos >= miss AS drop_while
FROM sessions s JOIN f USING (session)""", ("sessions",))
def w06_until_while_cuts(spark, sf_dir):
    return S.until_while_cuts(_s(spark, sf_dir), KEY, "pos", _user()).select(
        "session", "pos", "take_until", "take_until_excl", "drop_until", "drop_until_excl",
        "take_while", "drop_while")


@query("w07_split_when", """
, f AS (SELECT session, pos, kind = 'user' AS flag FROM sessions)
, h AS (SELECT session, min(pos) FILTER (WHERE flag) AS hit FROM f GROUP BY session)
SELECT session, pos,
       count(*) FILTER (WHERE flag) OVER (PARTITION BY session ORDER BY pos
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS piece,
       CASE WHEN hit IS NULL OR pos <= hit THEN 0 ELSE 1 END AS part,
       CASE WHEN hit IS NULL OR pos < hit THEN 'before' WHEN pos = hit THEN 'at' ELSE 'after' END AS trisect
FROM f JOIN h USING (session)""", ("sessions",))
def w07_split_when(spark, sf_dir):
    return S.split_when(_s(spark, sf_dir), KEY, "pos", _user()).select(
        "session", "pos", "piece", "part", "trisect")


@query("w08_segment_by_pattern", """
, m AS (SELECT a.session, a.pos AS s FROM sessions a JOIN sessions b
          ON b.session = a.session AND b.pos = a.pos + 1
        WHERE a.kind = 'user' AND b.kind = 'assistant')
, cov AS (SELECT session, s, s + j AS pos FROM m, range(0, 2) t(j))
, x AS (SELECT z.session, z.pos, cov.s, cov.s IS NOT NULL AS in_m FROM sessions z
        LEFT JOIN cov ON cov.session = z.session AND cov.pos = z.pos)
, y AS (SELECT *, CASE WHEN in_m THEN s
                       ELSE pos - row_number() OVER (PARTITION BY session, in_m ORDER BY pos) END AS piece FROM x)
SELECT session, min(pos) AS start, max(pos) AS "end", in_m AS is_match, count(*) AS length
FROM y GROUP BY session, in_m, piece""", ("sessions",))
def w08_segment_by_pattern(spark, sf_dir):
    return patterns.segment_by_pattern(_s(spark, sf_dir), KEY, "pos", "kind", ["user", "assistant"])


@query("w08_segment_overlapping", """
, c AS (SELECT a.session, a.pos AS s FROM sessions a
        JOIN sessions b ON b.session = a.session AND b.pos = a.pos + 1
        JOIN sessions c ON c.session = a.session AND c.pos = a.pos + 2
        WHERE a.kind = 'assistant' AND b.kind = 'user' AND c.kind = 'assistant')
, d AS (SELECT *, lag(s) OVER (PARTITION BY session ORDER BY s) AS ps FROM c)
, e AS (SELECT *, sum(CASE WHEN ps IS NULL OR s - ps >= 3 THEN 1 ELSE 0 END) OVER (PARTITION BY session ORDER BY s) AS chain FROM d)
, f AS (SELECT *, s - min(s) OVER (PARTITION BY session, chain) AS off FROM e)
, m AS (SELECT session, s FROM f WHERE off % 4 = 0)
, cov AS (SELECT session, s, s + j AS pos FROM m, range(0, 3) t(j))
, x AS (SELECT z.session, z.pos, cov.s, cov.s IS NOT NULL AS in_m FROM sessions z
        LEFT JOIN cov ON cov.session = z.session AND cov.pos = z.pos)
, y AS (SELECT *, CASE WHEN in_m THEN s
                       ELSE pos - row_number() OVER (PARTITION BY session, in_m ORDER BY pos) END AS piece FROM x)
SELECT session, min(pos) AS start, max(pos) AS "end", in_m AS is_match, count(*) AS length
FROM y GROUP BY session, in_m, piece""", ("sessions",))
def w08_segment_overlapping(spark, sf_dir):
    """A pattern that overlaps with itself: candidates of a chain lie 2 apart, so every other one is taken."""
    return patterns.segment_by_pattern(_s(spark, sf_dir), KEY, "pos", "kind", ["assistant", "user", "assistant"])


@query("w09_running_fold", """
, r AS (SELECT session, pos, sum(length(action)) OVER (PARTITION BY session ORDER BY pos
              ROWS UNBOUNDED PRECEDING) AS state FROM sessions)
, f AS (SELECT session, min(pos) FILTER (WHERE state > 2000) AS fail FROM r GROUP BY session)
SELECT session, pos, state, fail IS NOT NULL AND pos >= fail AS stopped FROM r JOIN f USING (session)""",
       ("sessions",))
def w09_running_fold(spark, sf_dir):
    out = S.running_fold(_s(spark, sf_dir), KEY, "pos", F.length("action").cast("long"),
                         keep=F.col("state") <= 2000)
    return out.select("session", "pos", "state", "stopped")


@query("w14_trailing_proof", """
, f AS (SELECT session, pos, action, kind <> 'system' AS flag FROM sessions)
, g AS (SELECT *, pos - row_number() OVER (PARTITION BY session, flag ORDER BY pos) AS grp FROM f)
, runs AS (SELECT session, flag, min(pos) AS start, max(pos) AS "end" FROM g GROUP BY session, flag, grp)
, last AS (SELECT session, max(pos) AS last FROM sessions GROUP BY session)
, trail AS (SELECT r.session, start AS trail_start, "end" AS trail_end FROM runs r JOIN last USING (session)
               WHERE flag AND "end" = last)
, fin AS (SELECT r.session, arg_max(start, "end") AS proof_start, max("end") AS proof_end
          FROM runs r JOIN last USING (session) WHERE flag AND "end" < last GROUP BY r.session)
, closing AS (SELECT fin.*, f.action AS closing_action FROM fin LEFT JOIN f
              ON f.session = fin.session AND f.pos = fin.proof_end + 1)
SELECT coalesce(t.session, c.session) AS session, trail_start, trail_end, proof_start, proof_end, closing_action
FROM trail t FULL JOIN closing c ON t.session = c.session""", ("sessions",))
def w14_trailing_proof(spark, sf_dir):
    out = S.trailing_run(_s(spark, sf_dir), KEY, "pos", F.col("kind") != "system", "action")
    return out.select("session", "trail_start", "trail_end", "proof_start", "proof_end", "closing_action")
