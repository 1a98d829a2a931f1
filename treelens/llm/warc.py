"""WARC archives with revisit resolution.

Headers (id, url, digest, length) are written once and shuffled by payload
digest: the smallest page_id of a digest is the response, the others become
revisit records that refer to it, which need no payload.  Payloads stay where
they are: a Bloom filter of the digests that repeat tells most of them apart
in place; of the rest only the responses (by a second filter) meet their
headers in a join.  Filters are sized to what is in them, up to a bound of
their broadcast, and what they let through by chance is decided by exact joins.

Archives are gzipped WARC/1.1 files written by Spark's own text writer with
the record separator CR LF CR LF, which works on any file system and commits
each file once, whichever executors are lost.  They are read back by their
Content-Length, a record at a time, and every payload is hashed and counted anew.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from dataclasses import dataclass
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import new_folder, save

#: Payloads below this many bytes are not worth a revisit record.
LEAST_BYTES = 100
#: Bytes of payload in one archive file, on average over all files, and records at most.
FILE_BYTES, RECORDS_PER_FILE = 64 << 20, 4000
#: Bits of a Bloom filter for each key (one in so many others passes by chance), and in all at least and at most (8 KB, 32 MB).
KEY_BITS, LEAST_BITS, MOST_BITS = 16, 1 << 16, 1 << 28
#: Bytes of payload read back that one frame holds, on its way to Spark.
FRAME_BYTES = 16 << 20

_CRLF = "\r\n"


@dataclass(frozen=True)
class Bloom:
    """One row ``words`` (array of long) of ``bits`` bits."""

    words: DataFrame
    bits: int


def _bits(hashed: Column, bits: int) -> tuple[Column, Column]:
    at = F.pmod(hashed, F.lit(bits))
    return F.floor(at / 64).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))


def filter_bits(keys: int) -> int:
    """The least power of two with KEY_BITS for each key, within the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (KEY_BITS * max(1, keys) - 1).bit_length()))


def bloom(keys: DataFrame) -> Bloom:
    """A filter of the hashes in column ``hashed``."""
    bits = filter_bits(keys.count())
    word, bit = _bits(F.col("hashed"), bits)
    known = keys.select(word.alias("id"), bit.alias("bit")).groupBy("id").agg(F.bit_or("bit").alias("bits"))
    every = keys.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("id"))
    filled = every.join(known, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")).alias("w"))
    return Bloom(save(filled.agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w["bits"]).alias("words")), "bloom"), bits)


def _filtered(rows: DataFrame, known: Bloom, hashed: Column, how: str) -> DataFrame:
    """``how``: left_semi for the rows whose hash may be in the filter, left_anti for those whose hash is not."""
    word, bit = _bits(hashed, known.bits)
    return rows.join(F.broadcast(known.words), F.get("words", word).bitwiseAND(bit) != 0, how)  # one row of MOST_BITS at most


def payloads(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, payload_bytes, payload_digest``; null html counts as empty."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    return rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", F.sha2(F.col("html").cast("binary"), 256))


def resolve(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """``page_id, url, html, payload_bytes, payload_digest, record_type, refers_to, refers_url, copy`` (null html in revisits).

    Payload: html in UTF-8, null counts as empty.  Of payloads of at least
    ``least_bytes`` bytes that are equal, the smallest page_id is the response
    (each row of a repeated smallest page_id is one; null page_ids revisit, or
    are responses if they have no equal); smaller payloads are all responses.
    copy numbers rows of equal page_id, url and payload from 0.
    """
    rows = payloads(pages)
    headers = save(rows.drop("html"), "headers")
    large = F.col("payload_bytes") >= least_bytes
    # map-side combine leaves one row per digest and task; only digests that repeat are kept
    first = headers.where(large).groupBy("payload_digest").agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"), F.count("*").alias("copies"))
    first = save(first.where("copies > 1").select("payload_digest", F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")), "first")

    digest = F.xxhash64("payload_digest")
    repeated = bloom(first.select(digest.alias("hashed")))
    alone = _filtered(rows.where(large), repeated, digest, "left_anti").withColumn("copy", F.lit(0))
    heads = _filtered(headers.where(large), repeated, digest, "left_semi").join(first, "payload_digest", "left")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    heads = save(heads.withColumn("revisit", revisit), "heads")
    # of the payloads that may repeat only those of responses move
    key = F.xxhash64("page_id", "payload_digest")
    responses = heads.where("not revisit").select("page_id", "payload_digest").distinct()
    bodies = _filtered(rows.where(large), bloom(responses.select(key.alias("hashed"))), key, "left_semi").withColumn("_id", F.coalesce("page_id", F.lit(0))).withColumn("_null", F.col("page_id").isNull())
    wanted = responses.select(F.coalesce("page_id", F.lit(0)).alias("_id"), F.col("page_id").isNull().alias("_null"), "payload_digest")
    # what stands alone is written above, so that a filter's chance hits are not written twice
    bodies = _filtered(bodies.join(wanted, ["_id", "_null", "payload_digest"], "left_semi").drop("_id", "_null"), repeated, digest, "left_semi")

    copy = F.row_number().over(W.partitionBy("page_id", "payload_digest", "url").orderBy(F.lit(0))) - 1
    written = alone.unionByName(rows.where(~large).withColumn("copy", copy)).unionByName(bodies.withColumn("copy", copy))
    written = written.select("*", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_url"))
    others = heads.where("revisit").withColumn("copy", copy)
    others = others.select("page_id", "url", F.lit(None).cast("string").alias("html"), "payload_bytes", "payload_digest", "copy", F.lit("revisit").alias("record_type"), F.col("first_id").alias("refers_to"), F.col("first_url").alias("refers_url"))
    return written.unionByName(others)


def _record_id(page_id: Column, url: Column, copy: Column) -> Column:
    """A stable record id: rewriting the same row gives the same one."""
    h = F.md5(F.concat_ws("\n", F.coalesce(page_id.cast("string"), F.lit("-")), F.col("payload_digest"), copy.cast("string"), F.coalesce(url, F.lit(""))))
    return F.concat(F.lit("<urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-"), F.substring(h, 13, 4), F.lit("-"), F.substring(h, 17, 4), F.lit("-"), F.substring(h, 21, 12), F.lit(">"))


def write(resolved: DataFrame, path: str, date: str | None = None, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Writes one record per row of ``resolved`` with fresh headers; revisits carry no payload.

    A null url has no WARC-Target-URI header and a null page_id no X-Page-Id
    header; line ends inside a url become spaces' percent form.  ``date``: of
    all records, now if none is given.
    """
    revisit = F.col("record_type") == "revisit"
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(_CRLF)), F.lit(""))

    def plain(url: str) -> Column:
        return F.regexp_replace(url, "[\\r\\n]", "%20")

    header = F.concat(
        F.lit(f"WARC/1.1{_CRLF}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("url"), F.col("copy"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", plain("url")),
        line("X-Page-Id", F.col("page_id").cast("string")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        line("WARC-Refers-To", F.when(revisit, _record_id(F.col("refers_to"), F.col("refers_url"), F.lit(0)))),
        line("WARC-Refers-To-Target-URI", F.when(revisit, plain("refers_url"))),
        line("X-Refers-To-Page-Id", F.when(revisit, F.col("refers_to").cast("string"))),
        line("Content-Type", F.when(~revisit, F.lit("text/html; charset=utf-8"))),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit(_CRLF),
    )
    record = F.concat(header, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    resolved.select(record.alias("value")).write.option("lineSep", _CRLF * 2).option("maxRecordsPerFile", records_per_file).option("compression", "gzip").text(path)


def parse(archive: bytes):
    """(headers by lower-cased name, block) of each record of an archive, gzipped or not, one after the other."""
    stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(archive)), 1 << 20) if archive[:2] == b"\x1f\x8b" else io.BytesIO(archive)
    at = 0
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record as number {at}")
        headers = {}
        while (x := stream.readline()) not in (b"\r\n", b""):
            name, _, value = x.decode("utf-8", "surrogatepass").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record number {at} doesn't end where its length says")
        yield headers, block
        at += 1


def _record(headers: dict, block: bytes) -> tuple:
    """A row of ``read``; digest and length of a response are those of the payload that was read."""
    page_id, refers, digest, size = headers.get("x-page-id"), headers.get("x-refers-to-page-id"), headers["warc-payload-digest"].removeprefix("sha256:"), int(headers["x-payload-length"])
    revisit = headers["warc-type"] == "revisit"
    if not revisit:
        if hashlib.sha256(block).hexdigest() != digest:
            raise ValueError(f"the payload of {headers['warc-record-id']} isn't what its digest says")
        size = len(block)
    html = None if revisit else block.decode("utf-8", "surrogatepass")
    return page_id and int(page_id), headers.get("warc-target-uri"), size, digest, headers["warc-type"], refers and int(refers), html, headers["warc-record-id"], headers.get("warc-refers-to")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives below ``path``.

    ``page_id, url, payload_bytes, payload_digest, record_type, refers_to, html, record_id, refers_to_id`` (null html in revisits).
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, html string, record_id string, refers_to_id string"
    names = [x.split()[0] for x in schema.split(", ")]

    def framed(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})

    def run(batches):
        for batch in batches:
            for content in batch["content"]:
                rows, held = [], 0
                for headers, block in parse(bytes(content)):
                    rows.append(_record(headers, block))
                    held += len(block)
                    if held > FRAME_BYTES:
                        yield framed(rows)
                        rows, held = [], 0
                yield framed(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInPandas(run, schema)


def restore(records: DataFrame) -> DataFrame:
    """Revisit records joined to their originals: every row has its html again."""
    originals = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("d"), F.col("html").alias("original")).dropDuplicates(["refers_to", "d"])
    revisits = records.where("record_type = 'revisit'").join(originals.withColumnRenamed("d", "payload_digest"), ["refers_to", "payload_digest"], "left")
    columns = [c for c in records.columns if c != "html"]
    return records.where("record_type = 'response'").unionByName(revisits.select(*columns, F.col("original").alias("html")))


def archive(pages: DataFrame, path: str | None = None, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Resolves, writes archives below ``path`` (the shared folder if none is given) and reads them back.

    Null html is an empty payload, null urls and page_ids stay null, repeated
    rows each get a record, extra columns are ignored, an empty table writes
    an archive without records.
    """
    spark = pages.sparkSession
    path = path or new_folder(spark, "warc")
    resolved = resolve(pages, least_bytes)
    mean = payloads(pages).agg(F.avg("payload_bytes")).first()[0] or 1
    write(resolved, path, records_per_file=int(max(1, min(RECORDS_PER_FILE, FILE_BYTES // max(1, mean)))))
    return read(spark, path)
