"""Proof-corpus sources and sinks.

A corpus is a folder tree ``<root>/<logic>/.../<theory>/proof<N>.json``.
It is read with Spark's file sources (one row per file, whole text), parsed
with a fixed schema (never inferred), and written back with Spark writers.
Bad files never abort a scan: they are kept as rows with a reason.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tactica.functions.pyjson import slices

_STEP = T.StructType([
    T.StructField("action", T.StringType()),
    T.StructField("user_state", T.StringType()),
    T.StructField("term", T.StringType()),
    T.StructField("hyps", T.ArrayType(T.StructType([T.StructField("term", T.StringType())]))),
    T.StructField("proven", T.ArrayType(T.StructType([T.StructField("proven", T.StringType())]))),
    T.StructField("variables", T.MapType(T.StringType(), T.StringType())),
    T.StructField("constants", T.MapType(T.StringType(), T.StringType())),
    T.StructField("type variables", T.MapType(T.StringType(), T.StringType())),
])
PROOF_SCHEMA = T.StructType([
    T.StructField("proof", T.ArrayType(_STEP)),
    T.StructField("apply_kwrds", T.ArrayType(T.StringType())),
    T.StructField("isar_kwrds", T.ArrayType(T.StringType())),
    T.StructField("methods", T.ArrayType(T.StringType())),
    T.StructField("deps", T.ArrayType(T.StructType([T.StructField("name", T.StringType()),
                                                    T.StructField("term", T.StringType())]))),
])
PROOF_GLOB = "proof*.json"

# Marker closing the wrapper used by ``json_text_valid``.
_END = "\u0000tactica:end-of-record"


def json_text_valid(raw: Column) -> Column:
    """True when the whole text is one JSON value (surrounding whitespace
    allowed), as Python's ``json.loads`` demands. ``try_parse_json`` alone
    accepts any text that merely starts with a value (``{"a":1}x``), so the
    text is parsed as ``[text, "<marker>"]`` and must give exactly those two
    elements: trailing content breaks the parse or the count. NaN/Infinity
    literals, which Python also accepts, are rejected."""
    wrapped = F.try_parse_json(F.concat(F.lit("["), raw, F.lit(',"' + _END.replace("\u0000", "\\u0000") + '"]')))
    items = F.try_variant_get(wrapped, "$", "array<variant>")
    last = F.try_variant_get(wrapped, "$[1]", "string")
    return F.coalesce((F.size(items) == 2) & (last == F.lit(_END)), F.lit(False))


def _root_path(root: str) -> str:
    """Path part of a root URI (scheme and authority removed), no trailing /."""
    m = re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*(/.*)$", root)
    p = m.group(1) if m else re.sub(r"^file:", "", root)
    return p.rstrip("/")


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there; any other trouble with the storage is an error."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def list_files(spark: SparkSession, root: str, glob: str = PROOF_GLOB) -> DataFrame:
    """All files under ``root`` matching ``glob`` at any depth: (path, rel).
    Listing only (binaryFile with the content column pruned away)."""
    df = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
               .option("pathGlobFilter", glob).load(root).select("path"))
    rootp = re.escape(_root_path(root))
    return df.select("path", F.regexp_extract("path", f"{rootp}/(.*)$", 1).alias("rel"))


def scan_corpus(spark: SparkSession, root: str, glob: str = PROOF_GLOB,
                schema: T.StructType = PROOF_SCHEMA) -> DataFrame:
    """One row per proof file: path, rel, logic, theory, proof_num, raw,
    ok (parses as a JSON object) and the parsed columns of ``schema``. A file
    that does not parse is an empty record (null proof), not an error."""
    raw = (spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob)
                .option("wholetext", "true").text(root)
                .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("raw")))
    return with_record(with_place(raw, root), schema).select("*", "record.*").drop("record")


def with_place(files: DataFrame, root: str) -> DataFrame:
    """S01/ST1: rel, logic, theory and proof_num from ``path`` below ``root``."""
    rel = F.regexp_extract("path", f"{re.escape(_root_path(root))}/(.*)$", 1)
    parts = F.split("rel", "/")
    num = F.regexp_extract(F.try_element_at(parts, F.lit(-1)), r"proof(\d+)\.json$", 1)
    others = [c for c in files.columns if c != "path"]
    return files.withColumn("rel", rel).select(
        "path", "rel", F.try_element_at(parts, F.lit(1)).alias("logic"),
        F.try_element_at(parts, F.lit(-2)).alias("theory"), F.when(num != "", num.cast("int")).alias("proof_num"), *others)


def with_record(df: DataFrame, schema: T.StructType = PROOF_SCHEMA, raw: str = "raw") -> DataFrame:
    """S01/ST1: ``ok`` (the whole text is one JSON object) and ``record``, its
    parsed form, null when not ok."""
    ok = json_text_valid(F.col(raw)) & F.ltrim(F.col(raw)).startswith("{")
    return df.withColumn("ok", ok).withColumn("record", F.when(F.col("ok"), F.from_json(raw, schema)))


def corpus_is_valid(spark: SparkSession, root: str) -> bool:
    """The root holds at least one ``proof*.json`` file at any depth."""
    return _exists(spark, root) and not list_files(spark, root).isEmpty()


def valid_per_logic(files: DataFrame) -> DataFrame:
    """S02 per logic: true when the logic folder holds a proof file."""
    return files.select(F.split("rel", "/")[0].alias("logic")).distinct().withColumn("valid", F.lit(True))


def find_erroneous(df: DataFrame, raw: str = "raw", check: Column | None = None) -> DataFrame:
    """Rows whose text does not parse as JSON, or on which the user
    check (a Column giving an error text or null) reports something."""
    bad_json = ~json_text_valid(F.col(raw))
    reason = F.when(bad_json, F.lit("invalid json"))
    if check is not None:
        reason = reason.otherwise(check)
    return df.withColumn("reason", reason).where(F.col("reason").isNotNull())


def quarantine(df: DataFrame, raw: str = "raw", check: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(clean, quarantined-with-reason); input is never deleted."""
    bad = find_erroneous(df, raw, check)
    clean = df.where(json_text_valid(F.col(raw))
                     & (check.isNull() if check is not None else F.lit(True)))
    return clean, bad


# A JSON string literal, up to the first quote that no backslash escapes. The
# loops never go back (possessive), so long texts need no deep match stack.
_QUOTED = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_PIECE = rf'(?s){_QUOTED}|[^"]++|"'
_FALSY = r'(?s)^\s*(\{\s*\}|\[\s*\]|""|-?0(\.0+)?([eE][+-]?\d+)?|false|null)\s*$'


def _pieces(text: Column) -> Column:
    """A text as the list of its string literals and of what lies between."""
    return F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))


def _quotes_in(literal: Column) -> Column:
    """Double quotes in the value of a string literal: its escaped ones."""
    return F.size(F.filter(F.regexp_extract_all(literal, F.lit(r'(?s)\\(u0022|.)'), F.lit(1)),
                           lambda e: e.isin('"', "u0022")))


def repair_corrupt_json(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Repair only the rows that do not parse. Raw line breaks inside
    quoted strings are escaped; if the text then parses, every string value
    with an odd number of double quotes gets one appended (``status``
    repaired, original kept in ``raw`` in place of a .bak file); otherwise, or
    when the result is empty, the row is ``failed``. Valid rows are left alone
    (``valid``). The layout of the text is kept. Built-in expressions over the
    list of literals, linear in the text; a key is a literal that a colon
    follows."""
    ok = json_text_valid(F.col(raw))
    valid = df.where(ok).withColumns({"fixed": F.col(raw), "status": F.lit("valid")})
    literal = lambda p: p.startswith('"') & (F.length(p) > 1)
    bad = df.where(~ok).withColumn("_p", F.transform(
        _pieces(F.col(raw)), lambda p: F.when(literal(p), F.replace(p, F.lit("\n"), F.lit("\\n"))).otherwise(p)))
    is_key = lambda i: F.coalesce(F.ltrim(F.get("_p", i + 1)).startswith(":"), F.lit(False))
    bad = bad.withColumn("_f", F.array_join(F.transform("_p", lambda p, i: F.when(
        literal(p) & ~is_key(i) & (_quotes_in(p) % 2 == 1),
        F.concat(F.substring(p, 1, F.length(p) - 1), F.lit('\\""'))).otherwise(p)), ""))
    good = json_text_valid(F.array_join("_p", "")) & ~F.col("_f").rlike(_FALSY)
    bad = bad.withColumns({"fixed": F.when(good, F.col("_f")),
                           "status": F.when(good, "repaired").otherwise("failed")}).drop("_p", "_f")
    return valid.unionByName(bad)


def write_proofs(df: DataFrame, out: str, existing: DataFrame | None = None,
                 fmt: str = "json") -> None:
    """Number proofs per (logic, theory) in document order and append
    them partitioned by logic/theory; keys already present are skipped, never
    overwritten (left_anti against ``existing``)."""
    from tactica.operators.ordering import number_rows
    x = df if "proof_num" in df.columns else number_rows(df, ["logic", "theory"], ["start"], "proof_num")
    if existing is not None:
        x = x.join(existing.select("logic", "theory", "proof_num"), ["logic", "theory", "proof_num"], "left_anti")
    x.write.mode("append").partitionBy("logic", "theory").format(fmt).save(out)


def copy_subset(df: DataFrame, chosen: DataFrame, out: str, key: str = "path",
                fmt: str = "parquet") -> None:
    """Add the chosen rows to ``out``, each with ``rel``, its path below
    the common root of the chosen ones, laid out by the folder of that path.
    What is already there stays."""
    rows = relative_layout(df.join(chosen.select(key), key, "left_semi"), key)
    folder = F.regexp_extract("rel", "^(.*)/[^/]*$", 1)
    rows.withColumn("folder", folder).write.mode("append").partitionBy("folder").format(fmt).save(out)


def record_done(units: DataFrame, ledger: str, key: Sequence[str]) -> None:
    """Append finished units to the ledger (a Parquet folder in shared
    storage) after their output was written; units already there are skipped,
    so a retried job records each unit once."""
    spark = units.sparkSession
    new = units.select(*key).distinct()
    if _exists(spark, ledger):
        new = new.join(spark.read.parquet(ledger).select(*key), list(key), "left_anti")
    new.write.mode("append").parquet(ledger)


def resume_todo(todo: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Units not yet recorded as done."""
    return todo.join(done.select(*key).distinct(), list(key), "left_anti")


class _Literal(str):
    """A number as it is written."""


def _parsed(text: str):
    return json.loads(text, parse_float=_Literal, parse_int=_Literal)


def _key_paths(value) -> Iterator[str]:
    todo = [("", value)]
    while todo:
        path, v = todo.pop()
        below = []
        if isinstance(v, dict):
            below = [(f"{path}.{k}" if path else k, x) for k, x in v.items()]
        elif isinstance(v, list):
            below = [(path + "[]", v[0] if v else None)]
        for p, _ in below:
            yield p
        todo += below


def _atoms(value) -> Iterator[tuple[str, str]]:
    todo = [("$", value)]
    while todo:
        path, v = todo.pop()
        if isinstance(v, dict):
            todo += [(f"{path}.{k}", x) for k, x in v.items()]
        elif isinstance(v, list):
            todo += [(f"{path}[{i}]", x) for i, x in enumerate(v)]
        else:
            yield path, str(v) if isinstance(v, _Literal) else json.dumps(v, ensure_ascii=False)


def key_paths(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Dotted key paths of every JSON text (lists contribute ``[]`` and
    only their first element is inspected), with the number of texts showing
    each path. Each text is walked once, to any depth; a batch sends its
    counts, which are summed."""
    def run(batches):
        for batch in batches:
            counts: Counter = Counter()
            for part in slices(batch.column(0)):
                for text in filter(None, part.to_pylist()):
                    counts.update(_key_paths(_parsed(text)))
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()),
                                              pa.array(list(counts.values()), pa.int64())], ["path", "n"])

    # null if not valid; as a filter it would be pushed down and make the text a second time
    valid = df.select(F.when(json_text_valid(F.col(raw)), F.col(raw)).alias(raw))
    return valid.mapInArrow(run, "path string, n long").groupBy("path").agg(F.sum("n").alias("count"))


def json_atoms(df: DataFrame, key: Sequence[str], raw: str = "raw") -> DataFrame:
    """Flatten every JSON text to (key, path, atom) rows: objects add
    ``.name``, lists add ``[i]`` (0-based, ascending), atoms are rendered as
    JSON text, numbers as they are written. Each text is walked once, to any
    depth, with no shuffle."""
    valid = df.select(*key, F.when(json_text_valid(F.col(raw)), F.col(raw)).alias("_raw"))

    def run(batches):
        for batch in (part for whole in batches for part in slices(whole)):
            rows, paths, atoms = [], [], []
            for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                for path, atom in _atoms(_parsed(text)) if text else ():
                    rows.append(i)
                    paths.append(path)
                    atoms.append(atom)
            kept = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[:-1]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(paths, pa.string()), pa.array(atoms, pa.string())],
                                             [*key, "path", "atom"])

    schema = T.StructType([*valid.schema.fields[:-1], T.StructField("path", T.StringType()),
                           T.StructField("atom", T.StringType())])
    return valid.mapInArrow(run, schema)


def proofs_to_append(df: DataFrame, existing: DataFrame) -> DataFrame:
    """S06 plan: the numbered proofs a write would append - those whose
    (logic, theory, proof_num) is not yet present (never overwritten)."""
    return df.join(existing.select("logic", "theory", "proof_num"), ["logic", "theory", "proof_num"], "left_anti")


def common_root(paths: DataFrame, path: str = "path") -> str:
    """The longest common folder prefix of the chosen paths: the common
    prefix of the smallest and the largest path (string order), cut back to a
    '/' - two values fetched from one partial aggregate."""
    lo, hi = paths.agg(F.min(path), F.max(path)).first()
    if lo is None:
        return ""
    n = 0
    while n < min(len(lo), len(hi)) and lo[n] == hi[n]:
        n += 1
    prefix = lo[:n]
    return prefix[:prefix.rfind("/") + 1]


def relative_layout(chosen: DataFrame, path: str = "path") -> DataFrame:
    """Chosen rows with ``rel`` = path below the common root."""
    root = common_root(chosen, path)
    return chosen.withColumn("rel", F.substring(F.col(path), len(root) + 1, 1 << 30))
