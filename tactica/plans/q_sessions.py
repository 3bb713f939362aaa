"""Registered queries: session catalogs and import resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from tactica.plans.registry import query
from tactica.sources import adapters as ad
from tactica.sources import sessions as SS

_PAGES = r"""
WITH pp AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host,
                   regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)?', 1) AS path,
                   regexp_extract_all(html, 'href="/([^"]*)"', 1) AS links FROM pages)
, parts AS (SELECT page_id, host, regexp_extract(host, '^([^.]+)', 1) AS label,
                   regexp_extract(path, '^/([^/]+)', 1) AS lang, regexp_extract(path, '([^/]+)$', 1) AS leaf,
                   links FROM pp)
, roots AS (SELECT page_id, lang, label,
                   'session ' || label || ' (' || lang || ') in "' || lang || '/' || leaf || '" = HOL +'
                   || chr(10) || '  theories ' || leaf || chr(10) || 'session "' || label || '-' || leaf
                   || '" = ' || label || chr(10) AS text FROM parts)
, files AS (SELECT DISTINCT host AS dir, w || '.thy' AS name, host || '/' || w || '.thy' AS path
            FROM (SELECT host, unnest(links) AS w FROM parts))
, imports AS (SELECT DISTINCT a.host AS importer_dir, a.lang || '.' || w AS import_name
              FROM parts a JOIN (SELECT page_id - 1 AS page_id, unnest(links) AS w FROM parts) b USING (page_id)
              UNION SELECT host, lang || '.' || leaf FROM parts)
"""
_RGX = SS.ROOT_RGX.replace("'", "''")
_CATALOG = f"""
, cat AS (SELECT page_id, lang, i - 1 AS pos, names[i] AS session,
                 CASE WHEN dirs[i] <> '' THEN dirs[i] END AS location
          FROM (SELECT page_id, lang, regexp_extract_all(text, '{_RGX}', 1) AS names,
                       regexp_extract_all(text, '{_RGX}', 5) AS dirs FROM roots),
               range(1, 3) t(i) WHERE i <= len(names))
"""


@query("s08_session_catalog", _PAGES + _CATALOG + "SELECT page_id, pos, session, location FROM cat")
def s08_session_catalog(spark, sf_dir):
    return SS.session_catalog(ad.root_texts(spark, sf_dir), ["page_id"]).select(
        "page_id", "pos", "session", "location")


@query("s09_session_registry", _PAGES + _CATALOG + """
, lines AS (SELECT label AS dir, CASE WHEN lang = 'en' THEN 1 ELSE 2 END AS priority, page_id AS line_no
            FROM parts)
, best AS (SELECT dir, max(priority) AS priority FROM lines GROUP BY dir)
, place AS (SELECT session, min(location) AS location FROM cat GROUP BY session)
SELECT session, location, priority AS registry FROM best JOIN place ON session = dir""")
def s09_session_registry(spark, sf_dir):
    roots = ad.root_texts(spark, sf_dir)
    cat = SS.session_catalog(roots, ["page_id"])
    lines = roots.select(F.col("label").alias("dir"),
                         F.when(F.col("lang") == "en", 1).otherwise(2).alias("priority"),
                         F.col("page_id").alias("line_no"))
    return SS.session_registry(lines, cat).select("session", "location", "registry")


@query("s10_theory_lookup", _PAGES + """
, names AS (SELECT DISTINCT CASE WHEN ends_with(regexp_extract(import_name, '([^/]+)$', 1), '.thy')
                                 THEN regexp_extract(import_name, '([^/]+)$', 1)
                                 WHEN regexp_extract(regexp_extract(import_name, '([^/]+)$', 1), '^[^.]+\\.(.+)$', 1) <> ''
                                 THEN regexp_extract(regexp_extract(import_name, '([^/]+)$', 1), '^[^.]+\\.(.+)$', 1) || '.thy'
                                 ELSE regexp_extract(import_name, '([^/]+)$', 1) || '.thy' END AS base FROM imports)
SELECT base, min(path) AS path FROM names JOIN files ON files.name = names.base GROUP BY base""")
def s10_theory_lookup(spark, sf_dir):
    imp = ad.theory_imports(spark, sf_dir).select(SS.import_base_name(F.col("import_name")).alias("base"))
    return SS.theory_lookup(ad.theory_files(spark, sf_dir), imp)


_RESOLVE = r"""
, imp AS (SELECT importer_dir, import_name,
                 CASE WHEN ends_with(regexp_extract(import_name, '([^/]+)$', 1), '.thy')
                      THEN regexp_extract(import_name, '([^/]+)$', 1)
                      WHEN regexp_extract(regexp_extract(import_name, '([^/]+)$', 1), '^[^.]+\.(.+)$', 1) <> ''
                      THEN regexp_extract(regexp_extract(import_name, '([^/]+)$', 1), '^[^.]+\.(.+)$', 1) || '.thy'
                      ELSE regexp_extract(import_name, '([^/]+)$', 1) || '.thy' END AS base FROM imports)
, loaded AS (SELECT name, path FROM files WHERE ends_with(dir, '.org'))
, cand AS (SELECT i.importer_dir, i.import_name, 1 AS rank, f.path FROM imp i JOIN files f
             ON f.dir = i.importer_dir AND f.name = i.base
           UNION ALL SELECT i.importer_dir, i.import_name, 2, l.path FROM imp i JOIN loaded l ON l.name = i.base
           UNION ALL SELECT i.importer_dir, i.import_name, 3, f.path FROM imp i JOIN files f ON f.name = i.base)
, best AS (SELECT importer_dir, import_name, min(rank) AS rank FROM cand GROUP BY ALL)
, resolved AS (SELECT b.importer_dir, b.import_name, min(c.path) AS path, b.rank FROM best b JOIN cand c
                 USING (importer_dir, import_name, rank) GROUP BY ALL)
"""


def _resolve(spark, sf_dir):
    files = ad.theory_files(spark, sf_dir)
    loaded = files.where(F.col("dir").endswith(".org"))
    return SS.resolve_imports(ad.theory_imports(spark, sf_dir), files, loaded)


@query("j02_resolve_imports", _PAGES + _RESOLVE + "SELECT importer_dir, import_name, path, rank FROM resolved")
def j02_resolve_imports(spark, sf_dir):
    return _resolve(spark, sf_dir)[0].select("importer_dir", "import_name", "path", "rank")


@query("j02_unresolved_imports", _PAGES + _RESOLVE + """
SELECT DISTINCT importer_dir, import_name FROM imports
WHERE (importer_dir, import_name) NOT IN (SELECT (importer_dir, import_name) FROM resolved)""")
def j02_unresolved_imports(spark, sf_dir):
    return _resolve(spark, sf_dir)[1]


_ML = _PAGES + _RESOLVE.split(", cand AS")[0] + r"""
, keyed AS (SELECT *, string_split(importer_dir, '/')[1] AS top,
                   CASE WHEN ends_with(import_name, '.thy') THEN import_name ELSE import_name || '.thy' END AS direct FROM imp)
, cand AS (SELECT k.importer_dir, k.import_name, 1 AS rank, l.path FROM keyed k JOIN loaded l ON l.name = k.base
           UNION ALL SELECT k.importer_dir, k.import_name, 2, f.path FROM keyed k JOIN files f ON f.name = k.base
           UNION ALL SELECT k.importer_dir, k.import_name, 3, f.path FROM keyed k JOIN files f
             ON string_split(f.dir, '/')[1] = k.top AND f.name = k.base
           UNION ALL SELECT k.importer_dir, k.import_name, 4, f.path FROM keyed k JOIN files f
             ON f.dir = k.importer_dir AND f.name = k.base
           UNION ALL SELECT k.importer_dir, k.import_name, 5, f.path FROM keyed k JOIN files f ON f.path = k.direct)
, best AS (SELECT importer_dir, import_name, min(rank) AS rank FROM cand GROUP BY ALL)
SELECT b.importer_dir, b.import_name, min(c.path) AS path, b.rank FROM best b JOIN cand c
  USING (importer_dir, import_name, rank) GROUP BY ALL
"""


@query("j02_resolve_imports_ml", _ML)
def j02_resolve_imports_ml(spark, sf_dir):
    """The prover's own order: loaded, findable, importer's session, local, direct."""
    files = ad.theory_files(spark, sf_dir)
    loaded = files.where(F.col("dir").endswith(".org"))
    found, _ = SS.resolve_imports(ad.theory_imports(spark, sf_dir), files, loaded, SS.ML_ORDER)
    return found.select("importer_dir", "import_name", "path", "rank")
