"""Operator 10: WARC archives with transaction assembly.

Writing: each capture gives three records, tied by ``WARC-Concurrent-To``:
``response`` (or ``revisit`` for a payload that another capture holds),
``request`` and ``metadata``. The records leave through Spark's text writer as
gzip files, so any store that Spark can write to will do: the record separator
of the format is the line separator.

Reading: a file is a sequence of lines that end where the next record begins;
a payload that holds such a place itself is put together again by its
``Content-Length``. Transactions are assembled by joining request, response
and metadata records through their concurrent-to identifiers: one nested row
per capture, with its payload. A revisit's payload is that of the response
whose record it refers to.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tactica.llm.common import scratch_path, slices, written

VERSION = b"WARC/1.1\r\n"
END = "\r\n\r\n"
NEXT = END + VERSION.decode()
#: Up to so many groups of equal payloads (under 100 bytes each) the list is broadcast.
BROADCAST_GROUPS = 100_000

RECORDS = ("record_id string, record_type string, concurrent_to string, target_uri string, refers_to string, "
           "payload_digest string, payload_bytes long, fields map<string,string>, payload binary")


def with_originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, sha1, original, single, referred``: of equal payloads of ``min_bytes`` or more,
    ``original`` is the largest page_id; null where the payload is a page's own. ``single``: one row has that
    page_id and payload; it is ``referred`` to by the others.

    Equal payloads are counted by digest with partial sums, so a payload that
    fills a third of the table costs no more than others.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = pages.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    rows = keyed.where(F.octet_length("html") >= min_bytes).groupBy("sha1", "page_id").agg(F.count("*").alias("n"))
    groups = (rows.groupBy("sha1").agg(F.max(F.struct("page_id", "n")).alias("last"), F.sum("n").alias("n")).where("n > 1")
              .select("sha1", F.col("last.page_id").alias("original"), (F.col("last.n") == 1).alias("single")))
    few = groups.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    joined = keyed.join(F.broadcast(groups) if few else groups, "sha1", "left")
    own = F.col("page_id").eqNullSafe(F.col("original"))
    return joined.withColumns({"original": F.when(~own, F.col("original")), "referred": own & F.col("single"), "single": F.col("single")})


def _record(kind: str, record_id: str, headers: list[tuple[str, str | None]], block: str) -> str:
    lines = [f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>",
             *(f"{k}: {v}" for k, v in headers if v is not None), f"Content-Length: {len(block.encode())}"]
    return VERSION.decode() + "\r\n".join(lines) + END + block


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write ``pages`` (page_id, url, html) as WARC files under ``path``.

    Null html is an empty payload, null url gives no target header. Line ends in
    a url are percent-encoded. Repeated rows are captures of their own. A revisit
    refers to the response's record by its id, or, where several rows repeat that
    response, to the page only (the header may be left out). An empty table gives
    no record. Further columns are ignored. Files hold up to 30,000
    records; a record is never split.
    """
    def run(batches):
        part, row = TaskContext.get().partitionId(), 0
        for batch, htmls in slices(batches, "html"):
            col = lambda n: batch.column(batch.schema.get_field_index(n)).to_pylist()
            out = []
            for page, url, html, sha1, original, single, referred in zip(
                    col("page_id"), col("url"), htmls, *map(col, ("sha1", "original", "single", "referred"))):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                size = len(html.encode())
                own = f"urn:page:{'' if page is None else page}:" + (digest if referred else f"{part}-{row}")
                uri = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}{END}"
                about = [("WARC-Date", date), ("WARC-Target-URI", uri)]
                body = [*about, ("WARC-Payload-Digest", f"sha1:{digest}"),
                        ("Content-Type", "application/http;msgtype=response")]
                if original is None:
                    out.append(_record("response", own, body, http + html))
                else:
                    body += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                             ("WARC-Refers-To", f"<urn:page:{original}:{digest}>" if single else None)]
                    out.append(_record("revisit", own, body, http))
                tied = [*about, ("WARC-Concurrent-To", f"<{own}>")]
                out.append(_record("request", own + ":request",
                                   [*tied, ("Content-Type", "application/http;msgtype=request")], f"GET {uri or ''} HTTP/1.1{END}"))
                out.append(_record("metadata", own + ":metadata", [*tied, ("Content-Type", "application/warc-fields")],
                                   ("" if page is None else f"page_id: {page}\r\n") + ("" if original is None else f"revisits: {original}\r\n")))
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])

    (with_originals(pages, min_bytes).mapInArrow(run, "value string").write.option("lineSep", END)
     .option("compression", "gzip").option("maxRecordsPerFile", 30_000).text(path))


def _needed(record: bytes) -> int | None:
    """Bytes of the whole record, once its head is there."""
    at = record.find(b"\r\n\r\n")
    size = re.search(rb"(?:^|\r\n)Content-Length: (\d+)(?:\r\n|$)", record[:at]) if at >= 0 else None
    return at + 4 + int(size[1]) if size else None


def _parse(record: bytes, with_payload: bool) -> dict:
    at = record.find(b"\r\n\r\n")
    head = dict(line.split(": ", 1) for line in record[:at].decode().split("\r\n") if ": " in line)
    size = int(head["Content-Length"])
    block = record[at + 4:at + 4 + size]
    name = lambda k: head[k][1:-1] if k in head else None
    row = {"record_id": name("WARC-Record-ID"), "record_type": head["WARC-Type"], "concurrent_to": name("WARC-Concurrent-To"),
           "target_uri": head.get("WARC-Target-URI"), "refers_to": name("WARC-Refers-To"), "fields": []}
    if head["WARC-Type"] in ("response", "revisit"):
        http, _, payload = block.partition(b"\r\n\r\n")
        told = dict(line.split(": ", 1) for line in http.decode("latin-1").split("\r\n")[1:] if ": " in line)
        row["payload_digest"] = head["WARC-Payload-Digest"].removeprefix("sha1:")
        row["payload_bytes"] = int(told["Content-Length"])
        if head["WARC-Type"] == "response":
            row["payload_bytes"] = len(payload)
            got = base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if got != row["payload_digest"]:
                raise ValueError(f"{row['record_id']}: payload digest {got}, header {row['payload_digest']}")
            row["payload"] = payload if with_payload else None
    elif head.get("Content-Type") == "application/warc-fields":
        row["fields"] = [tuple(x.split(": ", 1)) for x in block.decode().split("\r\n") if ": " in x]
    return row


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """One row per record of the archives under ``path`` (schema ``RECORDS``).

    A file is read front to back by one task, a record at a time. A truncated
    file or a payload that does not have its digest fails the job.
    """
    lines = (spark.read.schema("value string").option("lineSep", NEXT).text(path)
             .select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value")))
    kinds = pa.schema([(n, pa.string()) for n in ("record_id", "record_type", "concurrent_to", "target_uri", "refers_to",
                                                  "payload_digest")] +
                      [("payload_bytes", pa.int64()), ("fields", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])

    def run(batches):
        file, pieces, held, need = None, [], 0, None  # the record at hand in pieces, its bytes so far and in all
        for batch, values in slices(batches, "value"):
            out = []
            for name, value in zip(batch.column(0).to_pylist(), values):
                if name != file:
                    if pieces:
                        raise ValueError(f"{file}: truncated")
                    file, value = name, value.removeprefix(VERSION)
                if pieces:
                    pieces.append(NEXT.encode())
                    held += len(NEXT)
                pieces.append(value)
                held += len(value)
                if need is None:  # the head ends in the first piece or where the second begins
                    pieces = [b"".join(pieces)]
                    need = _needed(pieces[0])
                if need is not None and held >= need:
                    out.append(_parse(b"".join(pieces), with_payload))
                    pieces, held, need = [], 0, None
            if out:
                yield pa.RecordBatch.from_pylist(out, kinds)
        if pieces:
            raise ValueError(f"{file}: truncated")

    return lines.mapInArrow(run, RECORDS)


def assemble(records: DataFrame) -> DataFrame:
    """One nested row per capture: ``capture_id``, ``page_id`` and the structs ``request``, ``response``
    (a response or revisit) and ``metadata``; a record that is missing is null.

    The shuffle key is the capture's identifier, at most a few records each. A
    repeated record counts once.
    """
    row = F.struct(*[c for c in records.columns])
    kind = F.col("record_type")
    out = records.groupBy(F.coalesce("concurrent_to", "record_id").alias("capture_id")).agg(
        F.first(F.when(kind == "request", row), ignorenulls=True).alias("request"),
        F.first(F.when(kind.isin("response", "revisit"), row), ignorenulls=True).alias("response"),
        F.first(F.when(kind == "metadata", row), ignorenulls=True).alias("metadata"))
    return out.withColumn("page_id", F.col("metadata.fields")["page_id"].cast("long"))


def base32(hex_digest: Column) -> Column:
    """Upper-case base 32 of a hexadecimal digest of a whole number of 5-byte groups (SHA-1 has four)."""
    groups = [F.lpad(F.conv(F.substring(hex_digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_payload_facts(captures: DataFrame) -> DataFrame:
    """Add payload_bytes, payload_digest and refers_to (a page_id) to captures.

    Size and digest of a response are taken from its nested payload; those of a
    revisit from the response that it refers to, whose record must be there, or
    where no record is named, from any response of the page with that digest.
    """
    payload = F.col("response.payload")
    told = captures.withColumns({
        "own_bytes": F.octet_length(payload).cast("long"), "own_digest": base32(F.sha1(payload)),
        "to_page": F.col("metadata.fields")["revisits"].cast("long"),
        "to": F.when(F.col("response.record_type") == "revisit", F.concat_ws(":", F.lit("urn:page"), F.col("metadata.fields")["revisits"], F.col("response.payload_digest")))})
    asked = told.where("to IS NOT NULL").select("to").distinct()
    answers = (told.where("response.record_type = 'response'")
               .select(F.concat_ws(":", F.lit("urn:page"), "page_id", "own_digest").alias("to"), "own_bytes", "own_digest")
               .join(asked, "to", "left_semi").groupBy("to").agg(F.max("own_bytes").alias("to_bytes"), F.max("own_digest").alias("to_digest")))
    few = answers.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    out = told.join(F.broadcast(answers) if few else answers, "to", "left")
    missing = F.col("to").isNotNull() & F.col("to_digest").isNull()
    lost = F.raise_error(F.concat(F.lit("no response for "), F.col("capture_id")))
    return out.select(*captures.columns, F.when(missing, lost.cast("long")).otherwise(F.coalesce("own_bytes", "to_bytes")).alias("payload_bytes"),
                      F.coalesce("own_digest", "to_digest").alias("payload_digest"), F.col("to_page").alias("refers_to"))


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages``, read the archives back, and report each capture of the nested rows, which are written too."""
    path = scratch_path(pages.sparkSession, "warc")
    write_archives(pages, path, min_bytes)
    captures = written(assemble(read_archives(pages.sparkSession, path)), "captures", compression="zstd")
    return with_payload_facts(captures).select(
        "page_id", "payload_bytes", "payload_digest", F.col("response.record_type").alias("record_type"), "refers_to")
