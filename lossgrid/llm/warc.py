"""Content-addressed WARC archive: exact record headers in one table, each payload once in another, records rebuilt by a join."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: RFC 4648, in its order; and the digits of base 32 as conv() writes them.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


#: Payloads stand on disk twice while they move to the store: the tables' codec is one for texts.
CODEC = "zstd"


@dataclass(frozen=True)
class Archive:
    """Paths of the two tables."""

    headers: str
    payloads: str


def sha1_base32(payload: F.Column) -> F.Column:
    """Upper-case base32 of SHA-1: 160 bits are 8 groups of 5 hex digits, each 4 base32 digits."""
    hexed = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*groups), _DIGITS, BASE32)


def _line(name: str, value: F.Column) -> F.Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))).otherwise(F.lit(""))


def write_archive(pages: DataFrame, date: str = DATE, min_bytes: int = 0) -> Archive:
    """Write a WARC record for each row of pages (page_id, url, html; other columns are left out).

    Payload: html in UTF-8, null as empty. Of records with one payload of min_bytes or more, that
    with the smallest page_id (null last; of repeated ids, one of them) is response and the
    others are revisit. Null url: no target line; its line ends are percent-encoded. Record ids hold the page_id and a
    number of the row, so repeated ids differ. The address of a payload is its SHA-256; the store holds each address once.
    Rows are read once: what is chosen from them later is chosen from a written copy, so pages may come out of any plan.
    """
    spark = pages.sparkSession
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    base = pages.select("page_id", "url", payload.alias("payload")).withColumns({
        "address": F.sha2("payload", 256), "n": F.octet_length("payload").cast("long"),
        "uid": F.monotonically_increasing_id(), "sha1": sha1_base32(F.col("payload")),
    })
    archive = Archive(common.new_path(spark, "warc-headers"), common.new_path(spark, "warc-payloads"))
    with common.passing(spark):
        base = common.save(base, "warc-rows", codec=CODEC)
        place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "uid")
        firsts = base.groupBy("address").agg(F.min(place).alias("first"))
        firsts = common.save(firsts.select("address", F.col("first.page_id").alias("first_id"), F.col("first.uid").alias("first_uid")), "warc-firsts")
        base.drop("payload").join(firsts, "address").select("page_id", "uid", "address", F.encode(_header(date, min_bytes), "UTF-8").alias("header")).write.parquet(archive.headers, compression=CODEC)
        # the row that the store takes for each address is found by its number, so hot payloads move once
        kept = base.select("uid", "address", "payload").join(firsts.select(F.col("first_uid").alias("uid")), "uid", "left_semi")
        kept.select("address", "payload").write.parquet(archive.payloads, compression=CODEC)
    return archive


def _header(date: str, min_bytes: int) -> F.Column:
    """The header block of a record, up to its payload."""
    is_first = (F.col("uid") == F.col("first_uid")) | (F.col("n") < min_bytes)
    url = F.col("url")
    for char, code in (("\r", "%0D"), ("\n", "%0A")):
        url = F.replace(url, F.lit(char), F.lit(code))
    own = lambda x, uid: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(x).cast("string"), F.lit("null")), F.lit(":"), F.col(uid).cast("string"), F.lit(">"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF * 2))
    body = F.when(is_first, F.col("n")).otherwise(0) + F.octet_length(http)
    return F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _line("WARC-Type", F.when(is_first, F.lit("response")).otherwise(F.lit("revisit"))),
        _line("WARC-Record-ID", own("page_id", "uid")),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", url),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _line("WARC-Refers-To", F.when(~is_first, own("first_id", "first_uid"))),
        _line("WARC-Profile", F.when(~is_first, F.lit(REVISIT))),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", body.cast("string")),
        F.lit(CRLF), http,
    )


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """One row a record: page_id, record (the exact bytes; a revisit ends after its headers), record_type,
    refers_to, target_uri, payload (full, for revisits too), payload_bytes and payload_digest (of the bytes read), declared_digest.

    Every stored payload is hashed again and must match its address, and every address must have one, else the read fails.
    """
    headers = spark.read.parquet(archive.headers)
    store = spark.read.parquet(archive.payloads)
    checked = F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(F.raise_error(F.lit("payload does not match its address")))
    store = store.select("address", checked.alias("payload"))
    store = store.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": sha1_base32(F.col("payload"))})
    text = F.substring_index(F.decode("header", "UTF-8"), CRLF * 2, 1)
    field = lambda name: F.nullif(F.regexp_extract(text, rf"(?m)^{name}: ([^\r\n]*)$", 1), F.lit(""))
    parsed = headers.select(
        "page_id", "address", "header", field("WARC-Type").alias("record_type"), field("WARC-Target-URI").alias("target_uri"),
        F.regexp_extract(text, r"(?m)^WARC-Refers-To: <urn:page:(-?\d+):\d+>$", 1).try_cast("long").alias("refers_to"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("declared_digest"),
    )
    out = parsed.join(store, "address", "left")
    held = F.when(F.col("payload_digest").isNotNull(), F.col("payload_digest")).otherwise(F.raise_error(F.lit("the store lacks the payload of an address")))
    whole = F.when(F.col("record_type") == "response", F.concat("header", "payload")).otherwise(F.col("header"))
    return out.withColumns({"payload_digest": held, "record": F.concat(whole, F.encode(F.lit(CRLF * 2), "UTF-8"))}).drop("header")


def export_files(records: DataFrame, folder: str) -> None:
    """Write the column record of records as .warc files, one a task, in a folder that all executors share. A task that runs
    twice leaves one file. Null records are left out; no rows leave no file."""

    def run(batches):
        import uuid

        from pyarrow import fs
        from pyspark import TaskContext

        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        name, own, out = f"{top}/part-{TaskContext.get().partitionId():06d}.warc", f"{top}/.{uuid.uuid4().hex}", None
        for pdf in batches:
            if out is None:
                out = store.open_output_stream(own)
            for record in pdf["record"]:
                out.write(record)
        if out is not None:
            out.close()
            store.move(own, name)
        yield pd.DataFrame({"done": [1]})

    records.select("record").filter("record IS NOT NULL").mapInPandas(run, "done int").agg(F.sum("done")).collect()


def parse_records(stream) -> Iterator[dict]:
    """The records of a binary stream of WARC, one at a time: headers (names in lower case), http (the block's head) and payload."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        headers = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            headers[name.strip().lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if len(block) < int(headers["content-length"]):
            raise ValueError("a WARC record is cut short")
        http, _, payload = block.partition(b"\r\n\r\n") if headers.get("content-type", "").startswith("application/http") else (b"", b"", block)
        yield {"headers": headers, "http": http, "payload": payload}


def import_files(spark: SparkSession, folder: str) -> DataFrame:
    """A row a record of the .warc and .warc.gz files in folder: file, record_id, record_type, target_uri, refers_to_id, declared_digest,
    payload (null for revisits). Files are dealt to tasks and streamed, so memory holds a record, whatever the file's size."""
    from pyarrow import fs

    store, top = fs.FileSystem.from_uri(folder)
    names = sorted(f.path for f in store.get_file_info(fs.FileSelector(top)) if f.is_file and f.path.endswith((".warc", ".warc.gz")))
    schema = "file string, record_id string, record_type string, target_uri string, refers_to_id string, declared_digest string, payload binary"

    def run(batches):
        import gzip
        import io

        files = fs.FileSystem.from_uri(folder)[0]
        for pdf in batches:
            for name in pdf["name"]:
                with files.open_input_stream(name, compression=None) as raw:
                    stream = gzip.GzipFile(fileobj=raw) if name.endswith(".gz") else io.BufferedReader(raw, 1 << 20)
                    rows, held = [], 0
                    for r in parse_records(stream):
                        h = r["headers"]
                        kind = h.get("warc-type")
                        rows.append((name.rpartition("/")[2], h.get("warc-record-id"), kind, h.get("warc-target-uri"), h.get("warc-refers-to"), h.get("warc-payload-digest"), None if kind == "revisit" else r["payload"]))
                        held += len(r["payload"])
                        if held >= common.BATCH_BYTES:
                            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
                            rows, held = [], 0
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    files = spark.createDataFrame([(n,) for n in names], "name string")
    return files.repartition(max(1, len(names)), "name").mapInPandas(run, schema)


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """A row a row of pages, read back from the archive: page_id, payload_bytes, payload_digest, record_type, refers_to. Null ids come last,
    null html is empty; repeated rows are records of their own, one of them the response; an empty table gives no rows."""
    archive = write_archive(common.read(spark, sf_dir, "pages"))
    return read_archive(spark, archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_HALF = " || ".join(
    f"substr('{BASE32}', 1 + ((CAST('0x' || substr(h, {5 * i + 1}, 5) AS BIGINT) >> {s}) & 31)::INTEGER, 1)" for i in range(8) for s in (15, 10, 5, 0)
)
SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h,
         row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST) AS k,
         first_value(page_id) OVER (PARTITION BY coalesce(html, '') ORDER BY page_id NULLS LAST) AS first_id
  FROM pages
)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {_HALF} AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN k > 1 THEN first_id END AS refers_to
FROM p
"""
