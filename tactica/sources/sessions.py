"""Session catalogs and theory import resolution.

ROOT files, ROOTS lists and theory folders are text/listing sources; all
matching is done with regular expressions and joins over whole tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the pattern of a session entry in a ROOT file (groups: 1 name,
# 3 parenthesised tag, 4 whole ``in ...`` part, 5 its directory).
ROOT_RGX = r'session\s+"?([\w+-]+)"?\s*(\(\s*([^"]+)\s*\))?\s*(in\s+"?([\w\/-]+)"?)?\s*='


def session_catalog(roots: DataFrame, key: Sequence[str], text: str = "text") -> DataFrame:
    """Every session entry of each ROOT text: (key, pos, session,
    location); location = the ``in`` directory (null when absent). The first
    entry of a text (pos 0) is what ``find_logic`` picks."""
    names = F.regexp_extract_all(F.col(text), F.lit(ROOT_RGX), F.lit(1))
    dirs = F.regexp_extract_all(F.col(text), F.lit(ROOT_RGX), F.lit(5))
    z = roots.select(*key, F.posexplode(F.arrays_zip(names.alias("n"), dirs.alias("d"))).alias("pos", "m"))
    return z.select(*key, "pos", F.col("m.n").alias("session"),
                    F.when(F.col("m.d") != "", F.col("m.d")).alias("location"))


def session_registry(lines: DataFrame, catalog: DataFrame, priority: str = "priority",
                     order: str = "line_no") -> DataFrame:
    """ROOTS lines (dir, priority, line_no) joined to the catalog on
    session = dir; on a name clash the higher ``priority`` registry wins. Both
    sides are reduced to one row per session before the join (the line of the
    best registry; the smallest location of the name, no location last), so
    the join grows with the sessions, not with lines times entries."""
    best = lines.groupBy(F.col("dir").alias("session")).agg(F.max(F.struct(priority, order)).alias("_b"))
    place = catalog.groupBy("session").agg(F.min("location").alias("location"))
    return best.join(place, "session").select("session", "location", F.col(f"_b.{priority}").alias("registry"))


def import_base_name(name: Column) -> Column:
    """J02 normalisation: ``A.B`` -> ``B.thy``; a path -> its base name;
    otherwise ``.thy`` is appended (names already ending in .thy kept)."""
    base = F.regexp_extract(name, r"([^/]+)$", 1)
    qualified = F.regexp_extract(base, r"^[^.]+\.(.+)$", 1)
    b = F.when(base.endswith(".thy"), base).when(qualified != "", F.concat(qualified, F.lit(".thy"))) \
         .otherwise(F.concat(base, F.lit(".thy")))
    return b


def theory_lookup(files: DataFrame, names: DataFrame, name: str = "base") -> DataFrame:
    """First file (smallest path) whose path ends with ``name``. The path
    from each of its places on where a name may begin (the start, or after a
    slash) is a key, so the suffix test is an equi-join."""
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)),
                       lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    by_end = files.select("path", F.explode(ends).alias(name)).groupBy(name).agg(F.min("path").alias("path"))
    return names.select(name).distinct().join(by_end, name)


# The ranks of the two lookups, in their order.
SCALA_ORDER = ("local", "loaded", "remote")
ML_ORDER = ("loaded", "findable", "session", "local", "direct")


def resolve_imports(imports: DataFrame, files: DataFrame, loaded: DataFrame,
                    order: Sequence[str] = SCALA_ORDER) -> tuple[DataFrame, DataFrame]:
    """Resolve (importer_dir, import_name) by the first rank of ``order``
    that knows the name. Returns (resolved, unresolved).

    * local: a file of that base name in the importer's own folder;
    * loaded: a loaded theory of that name;
    * remote, findable: any file of that name;
    * session: a file of that name under the importer's top folder;
    * direct: a file whose path is the import name itself, ``.thy`` added.

    Of several files the smallest path counts. Files and loaded theories are
    reduced to one path per lookup key first, so each join adds at most one
    row per import.
    """
    imp = imports.select("importer_dir", "import_name").distinct().withColumns({
        "base": import_base_name(F.col("import_name")),
        "top": F.split("importer_dir", "/")[0],
        "direct": F.when(F.col("import_name").endswith(".thy"), F.col("import_name"))
                   .otherwise(F.concat("import_name", F.lit(".thy")))})
    least = F.min("path").alias("path")
    tops = files.withColumn("top", F.split("dir", "/")[0])
    lookups = {
        "local": files.groupBy(F.col("dir").alias("importer_dir"), F.col("name").alias("base")).agg(least),
        "loaded": loaded.groupBy(F.col("name").alias("base")).agg(least),
        "remote": files.groupBy(F.col("name").alias("base")).agg(least),
        "session": tops.groupBy("top", F.col("name").alias("base")).agg(least),
        "direct": files.groupBy(F.col("path").alias("direct")).agg(least)}
    lookups["findable"] = lookups["remote"]
    x = imp
    for i, kind in enumerate(order, 1):
        found = lookups[kind].withColumnRenamed("path", f"_{i}")
        x = x.join(found, [c for c in found.columns if c != f"_{i}"], "left")
    ranks = range(1, len(order) + 1)
    rank = F.coalesce(*[F.when(F.col(f"_{i}").isNotNull(), F.lit(i)) for i in ranks])
    out = x.select("importer_dir", "import_name", F.coalesce(*[F.col(f"_{i}") for i in ranks]).alias("path"),
                   rank.alias("rank"))
    return out.where(F.col("rank").isNotNull()), out.where(F.col("rank").isNull()).select("importer_dir", "import_name")
