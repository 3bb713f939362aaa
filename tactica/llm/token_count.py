"""Operator 4: token counts by overlap resynchronisation.

Texts longer than a chunk are cut into chunks that overlap, each encoded on its
own, with offsets, in whatever task has room. Two neighbours are spliced at a
stable common boundary inside their overlap: a place right after white space or
beside an ASCII digit, which no piece of the split pattern, no special string
and no Unicode composition can span, so that the encoding of what follows does
not depend on what precedes. Both neighbours must have a token boundary there
and the same tokens from there to the last stable place of the overlap.
Documents where one splice fails are done again with a wider overlap, up to
the whole text.

Chunks of a long text are found again by the SHA-256 of the text; copies of a
long text are each cut and encoded, and their equal counts merged.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactica.llm.bpe import LATIN_LETTER, LATIN_NUMBER, SPACE, read_spec
from tactica.llm.common import WordCache, slices, written

# Fixed value: the split pattern whose pieces may be counted one by one.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_words = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN_LETTER}]+|[{LATIN_NUMBER}]|[^{SPACE}{LATIN_LETTER}{LATIN_NUMBER}]+")
#: Beyond these, composition, case or classes may differ between libraries: the whole text goes to the library.
_unsafe = re.compile(f"[^\t-\r -~\xa0-{chr(0x12F)}{chr(0x131)}-{chr(0x24F)}{chr(0x2010)}-{chr(0x2027)}"
                     f"{chr(0x2030)}-{chr(0x205E)}{chr(0x20AC)}]")


class Counter:
    """Counts and offsets as the tokenizers library gives them."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        data = json.loads(spec)
        added = [t["content"] for t in data.get("added_tokens", [])]
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        plain = not any(re.search(r"[\s0-9]", a) for a in added) and not any(
            t.get("lstrip") or t.get("rstrip") for t in data.get("added_tokens", []))
        steps = json.dumps((data.get("pre_tokenizer") or {}))
        self.by_words = plain and json.dumps(WORD_PATTERN) in steps and "Lowercase" in json.dumps(data.get("normalizer"))
        #: Stable places hold for patterns that drop white space and take digits one by one.
        self.splices = self.by_words
        self.cache = WordCache(300_000)

    def _library(self, words: list[str]):
        return [len(e) for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def count(self, text: str) -> int:
        if not self.by_words or _unsafe.search(text) or (self.special and self.special.search(text)):
            return self._library([text])[0]
        return sum(self.cache.get_many(_words.findall(text.lower()), self._library))

    def encode(self, text: str):
        """Ids and (start, end) offsets in code points."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        return e.ids, e.offsets


_counters: dict[int, Counter] = {}


def counter(spec: str) -> Counter:
    key = hash(spec)
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(spec)
    return _counters[key]


def stable_places(zone: str) -> list[int]:
    """Positions p of ``zone`` (1 at least) before which a white space stands, or beside an ASCII digit."""
    digits = "0123456789"
    return [p for p in range(1, len(zone)) if zone[p - 1] in " \t\n\r" or zone[p - 1] in digits or zone[p] in digits]


def splice(ids: list, offsets: list, shift: int, zone: str) -> tuple[int, int] | None:
    """The splice place in a zone that begins at ``shift`` of the encoded text, and a checksum of the
    tokens from there to the last stable place; None if the zone has none that tokens respect."""
    places = stable_places(zone)
    spans = [(s - shift, e - shift, t) for t, (s, e) in zip(ids, offsets) if e > shift and s < shift + len(zone)]
    inside = {p for s, e, _ in spans for p in range(s + 1, e)}
    good = [p for p in places if p not in inside]
    if not good:
        return None
    first, last = good[0], good[-1]
    seen = [x for x in spans if first <= x[0] and x[1] <= last]
    return first, zlib.crc32(repr((first, last, seen)).encode())


def count_chunk(c: Counter, text: str, number: int, last: bool, chunk: int, overlap: int):
    """Tokens that belong to a chunk and the checksums of its two splices (None: failed; -1: a text's end)."""
    ids, offsets = c.encode(text)
    left = (0, -1) if number == 0 else splice(ids, offsets, 0, text[:overlap])
    right = (0, -1) if last else splice(ids, offsets, chunk, text[chunk:chunk + overlap])
    if left is None or right is None:
        return 0, left and left[1], right and right[1]
    end = len(text) + 1 if last else chunk + right[0]
    return sum(left[0] <= s < end for s, _ in offsets), left[1], right[1]


def _chunks(long_docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    def run(batches):
        for batch, texts in slices(batches, "text"):
            keys = batch.column(0).to_pylist()
            for key, text in zip(keys, texts):
                # the last chunk is never shorter than the overlap, unless it is the only one
                n = max(1, (len(text) - overlap + chunk - 1) // chunk)
                for i in range(n):
                    piece = text[i * chunk:] if i == n - 1 else text[i * chunk:(i + 1) * chunk + overlap]
                    yield pa.RecordBatch.from_pylist(
                        [{"key": key, "number": i, "last": i == n - 1, "piece": piece}],
                        pa.schema([("key", pa.string()), ("number", pa.int64()), ("last", pa.bool_()), ("piece", pa.string())]))

    return long_docs.mapInArrow(run, "key string, number long, last boolean, piece string")


def _count_long(long_docs: DataFrame, spec, chunk: int, overlap: int) -> DataFrame:
    """key, n_tokens, ok of each distinct long text, in one round."""
    def run(batches):
        c = counter(spec.value)
        for batch, pieces in slices(batches, "piece"):
            numbers, lasts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            done = [count_chunk(c, p, n, z, chunk, overlap) for p, n, z in zip(pieces, numbers, lasts)]
            n, left, right = zip(*done)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(n, pa.int64()), pa.array(left, pa.int64()),
                 pa.array(right, pa.int64())], ["key", "number", "last", "n", "left", "right"])

    # the salt spreads the copies of a text; chunks of one document go to many tasks
    pieces = _chunks(long_docs, chunk, overlap).withColumn("salt", F.xxhash64(F.length("piece"), F.spark_partition_id()))
    # a fixed number: the chunks are few bytes but much work, so partitions must not be merged by size
    width = int(long_docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = (pieces.repartition(width, "key", "number", "salt").drop("salt").select("key", "number", "last", "piece")
               .mapInArrow(run, "key string, number long, last boolean, n long, left long, right long"))
    counted = counted.groupBy("key", "number").agg(
        F.first("n").alias("n"), F.first("left").alias("left"), F.first("right").alias("right"))
    sides = counted.select("key", "n", F.inline(F.array(
        F.struct((F.col("number") - 1).alias("boundary"), F.col("left").alias("sum")),
        F.struct(F.col("number").alias("boundary"), F.col("right").alias("sum")))))
    # n counts once for each chunk: with its left side
    met = sides.groupBy("key", "boundary").agg(
        F.coalesce((F.count("sum") == F.count("*")) & (F.min("sum") == F.max("sum")), F.lit(False)).alias("ok"),
        F.sum("n").alias("twice"))
    return met.groupBy("key").agg((F.sum("twice") / 2).cast("long").alias("n_tokens"), F.min("ok").alias("ok"))


def count_tokens(docs: DataFrame, tokenizer: str, chunk: int = 32768, overlap: int = 256) -> DataFrame:
    """``docs`` (doc_id, text) with n_tokens: the library's count of each whole text, without special
    tokens, null as empty.

    Null, empty and short texts are counted in place; texts over ``chunk`` code
    points as above. Repeated rows, ties of ids and null ids give a row each.
    Further columns are ignored.
    """
    spark = docs.sparkSession
    text = read_spec(tokenizer)
    spec = spark.sparkContext.broadcast(text)
    splices = counter(text).splices
    docs = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def short(batches):
        c = counter(spec.value)
        for batch, texts in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()),
                 pa.array([c.count(t) if t else 0 for t in texts], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    schema = f"doc_id {id_type}, n_bytes long, n_tokens long"
    if not splices:  # no place of this pattern is known to be stable: whole texts
        return docs.mapInArrow(short, schema)
    is_long = F.length("text") > chunk + overlap
    brief = docs.where(~is_long).mapInArrow(short, schema)
    keyed = docs.where(is_long).select(F.sha2("text", 256).alias("key"), "text", "doc_id")
    rest, results = keyed, []
    while True:
        done = written(_count_long(rest.select("key", "text"), spec, chunk, overlap), "token-count")
        results.append(done.where("ok").select("key", "n_tokens"))
        failed = done.where(~F.col("ok")).select("key")
        if failed.isEmpty():
            break
        overlap *= 8
        chunk = max(chunk, 2 * overlap)
        rest = rest.join(failed, "key", "left_semi")
    counts = results[0]
    for more in results[1:]:
        counts = counts.unionByName(more)
    sizes = keyed.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"))
    return brief.unionByName(sizes.join(counts, "key").select("doc_id", "n_bytes", "n_tokens"))
