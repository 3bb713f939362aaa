"""Registered queries: block segmentation over sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tactica.operators import blocks as B
from tactica.operators import sequences as S
from tactica.plans.registry import query
from tactica.sources import adapters as ad

# A turn may start and end blocks of three tags, so that blocks nest, closings
# miss their tag, and some turns do both.
_EVENTS_SQL = """
WITH RECURSIVE x AS (
  SELECT conv_id AS session, turn AS pos, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn,
         list_filter([CASE WHEN role = 'user' THEN 'ASK' END, CASE WHEN length(text) % 3 = 0 THEN 'DIG' END], lambda t: t IS NOT NULL) AS starts,
         list_filter([CASE WHEN role = 'assistant' THEN 'ASK' END, CASE WHEN length(text) % 4 = 1 THEN 'DIG' END,
                      CASE WHEN role = 'system' THEN 'TOP' END], lambda t: t IS NOT NULL) AS ends
  FROM conversations)
, m AS (
  SELECT session, pos, rn, starts, ends, CAST([] AS STRUCT(tag VARCHAR, id BIGINT)[]) AS before, CAST(0 AS BIGINT) AS d,
         CASE WHEN len(starts) > 0 THEN [{'tag': starts[1], 'id': pos}] ELSE CAST([] AS STRUCT(tag VARCHAR, id BIGINT)[]) END AS stack
  FROM x WHERE rn = 1
  UNION ALL
  SELECT session, pos, rn, starts, ends, before, d,
         CASE WHEN len(starts) > 0 THEN list_append(before[1:d - 1], {'tag': starts[1], 'id': pos})
              WHEN len(ends) > 0 AND len(before) > 0 AND list_contains(ends, before[-1].tag) THEN before[1:len(before) - 1]
              ELSE before END
  FROM (SELECT x.session, x.pos, x.rn, x.starts, x.ends, m.stack AS before,
               CASE WHEN len(x.ends) > 0 AND list_contains(list_transform(m.stack, lambda t: t.tag), x.ends[1])
                    THEN list_position(list_transform(m.stack, lambda t: t.tag), x.ends[1]) ELSE len(m.stack) + 1 END AS d
        FROM m JOIN x ON x.session = m.session AND x.rn = m.rn + 1))
, opened AS (SELECT session, pos, before, CASE WHEN rn = 1 THEN 1 ELSE d END AS d, starts[1] AS tag FROM m WHERE len(starts) > 0)
, events AS (
  SELECT session, pos, len(before) - i AS sub, -1 AS delta, i AS level, before[i].id AS block_id, before[i].tag AS tag, CAST(NULL AS VARCHAR) AS error
  FROM (SELECT session, pos, before, unnest(range(d, len(before) + 1)) AS i FROM opened)
  UNION ALL SELECT session, pos, len(before) - d + 1, 1, d, pos, tag, NULL FROM opened
  UNION ALL SELECT session, pos, 0, -1, len(before), before[-1].id, before[-1].tag, NULL FROM m
    WHERE len(starts) = 0 AND len(ends) > 0 AND len(before) > 0 AND list_contains(ends, before[-1].tag)
  UNION ALL SELECT session, pos, 0, 0, len(before), before[-1].id, coalesce(before[-1].tag, 'OTHER'),
         CASE WHEN len(ends) = 0 THEN NULL WHEN len(before) = 0 THEN 'unbalanced close'
              ELSE before[-1].tag || ' closed by ' || ends[1] END FROM m
    WHERE len(starts) = 0 AND NOT (len(ends) > 0 AND len(before) > 0 AND list_contains(ends, before[-1].tag)))
"""
_BLOCKS_SQL = """
, blk AS (SELECT session, block_id, tag, level, min(pos) AS first, max(pos) AS last, count(*) AS n_events, min(delta) = -1 AS closed
          FROM events WHERE block_id IS NOT NULL GROUP BY ALL)
"""


def _events(spark, sf_dir):
    s = ad.sessions(spark, sf_dir)
    n = F.length("action")
    return s, B.segment_blocks(
        s, ["session"], "pos", [("ASK", F.col("kind") == "user"), ("DIG", n % 3 == 0)],
        [("ASK", F.col("kind") == "assistant"), ("DIG", n % 4 == 1), ("TOP", F.col("kind") == "system")])


@query("w10_block_segmentation", _EVENTS_SQL + """
SELECT session, pos, sub, delta, level, block_id, tag, error FROM events""")
def w10_block_segmentation(spark, sf_dir):
    return _events(spark, sf_dir)[1].select("session", "pos", "sub", "delta", "level", "block_id", "tag", "error")


@query("w11_top_level_blocks", _EVENTS_SQL + _BLOCKS_SQL + """
SELECT session, block_id, tag, level, first, last, n_events, closed FROM blk WHERE level = 1""")
def w11_top_level_blocks(spark, sf_dir):
    ev = _events(spark, sf_dir)[1]
    return B.top_level_blocks(ev, B.blocks(ev, ["session"], "pos"), ["session"], "pos").select(
        "session", "block_id", "tag", "level", "first", "last", "n_events", "closed")


@query("w11_outermost_of_tag", _EVENTS_SQL + _BLOCKS_SQL + """
SELECT b.session, b.block_id, b.level FROM blk b WHERE b.tag = 'DIG' AND NOT EXISTS (
  SELECT 1 FROM blk o WHERE o.session = b.session AND o.tag = 'DIG' AND o.level < b.level AND o.first < b.first
         AND (o.last > b.first OR NOT o.closed) )""")
def w11_outermost_of_tag(spark, sf_dir):
    ev = _events(spark, sf_dir)[1]
    return B.top_level_blocks(ev, B.blocks(ev, ["session"], "pos"), ["session"], "pos", "DIG").select(
        "session", "block_id", "level")


@query("w12_flatten_trace", _EVENTS_SQL + """
, last AS (SELECT session, pos, arg_max({'b': block_id, 'l': level}, sub) AS e FROM events GROUP BY ALL)
SELECT l.session, row_number() OVER (PARTITION BY l.session ORDER BY l.pos) - 1 AS n, c.text AS action, l.e.b AS block_id, l.e.l AS level
FROM last l JOIN conversations c ON c.conv_id = l.session AND c.turn = l.pos""")
def w12_flatten_trace(spark, sf_dir):
    s, ev = _events(spark, sf_dir)
    return B.flatten_trace(ev, s, ["session"], "pos", "action")


# whole texts: every word after the first is a fact
_PROVEN_SQL = """
WITH s AS (SELECT conv_id AS session, turn AS pos, role <> 'assistant' AS ap, split_part(text, ' ', 1) AS goal,
                  role = 'user' AS cl, string_split(text, ' ')[2:] AS facts FROM conversations)
, j AS (SELECT s.session, s.pos, s.ap, p.ap AS pap, p.goal AS pgoal, p.cl AS pcl, p.facts AS pfacts
        FROM s LEFT JOIN s p ON p.session = s.session AND p.pos = s.pos - 1)
, adds AS (SELECT session, pos, CASE WHEN ap AND coalesce(pap, false) THEN [pgoal]
                                     WHEN NOT ap AND coalesce(pcl, false) THEN pfacts END AS a FROM j)
, terms AS (SELECT session, pos AS at_pos, i - 1 AS i, a[i] AS term
            FROM (SELECT session, pos, a, unnest(range(1, len(a) + 1)) AS i FROM adds WHERE a IS NOT NULL))
"""


def _proven(spark, sf_dir):
    c = ad.table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("session"), F.col("turn").alias("pos"),
        (F.col("role") != "assistant").alias("ap"), F.try_element_at(F.split("text", " "), F.lit(1)).alias("goal"),
        (F.col("role") == "user").alias("cl"), F.slice(F.split("text", " "), 2, 1 << 30).alias("facts"))
    return c, S.proven_so_far(c, ["session"], "pos", F.col("ap"), "goal", F.col("cl"), "facts")


@query("w13_proven_so_far", _PROVEN_SQL + "SELECT session, at_pos, i, term FROM terms")
def w13_proven_so_far(spark, sf_dir):
    return _proven(spark, sf_dir)[1].select("session", F.col("_at").alias("at_pos"), F.col("_i").alias("i"), "term")


@query("w13_proven_lists", _PROVEN_SQL + """
SELECT s.session, s.pos, row_number() OVER (PARTITION BY s.session, s.pos ORDER BY t.at_pos DESC, t.i) - 1 AS k, t.term
FROM s JOIN terms t ON t.session = s.session AND t.at_pos <= s.pos""")
def w13_proven_lists(spark, sf_dir):
    c, added = _proven(spark, sf_dir)
    return S.proven_lists(added, c, ["session"], "pos").select("session", "pos", "k", "term")
