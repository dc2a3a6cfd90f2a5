"""The archive from inputs that are no plain scan, and its .warc files."""

import base64
import gzip
import hashlib

import pytest
from pyspark.sql import functions as F

from lossgrid.llm import common, warc


def digest(body: bytes) -> str:
    return base64.b32encode(hashlib.sha1(body).digest()).decode()


def test_input_out_of_shuffles(spark):
    pages = spark.range(2000, numPartitions=9).select((F.col("id") % 1000).alias("page_id"), F.lit("u").alias("url"), F.concat(F.lit("<p>"), (F.col("id") % 250).cast("string")).alias("html"))
    other = spark.range(0, 1000, 1, 7).select(F.col("id").alias("page_id"), (F.col("id") * 3).alias("more"))
    for df, n in ((pages.dropDuplicates(["page_id"]), 1000), (pages.join(other, "page_id"), 2000), (pages.repartition(13).dropDuplicates(), 1000)):
        got = warc.read_archive(spark, warc.write_archive(df)).collect()
        assert len(got) == n
        assert all(bytes(r.payload) == b"<p>%d" % (r.page_id % 250) and r.payload_digest == r.declared_digest == digest(bytes(r.payload)) for r in got)
        assert sum(r.record_type == "response" for r in got) == 250 and all(r.refers_to == (None if r.record_type == "response" else r.page_id % 250) for r in got)


def test_reader_fails_without_a_payload(spark):
    archive = warc.write_archive(spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "page_id long, url string, html string"))
    store = spark.read.parquet(archive.payloads)
    poor = common.save(store.filter("payload <> X'61'"), "warc-poor")
    with pytest.raises(Exception, match="lacks the payload"):
        warc.read_archive(spark, warc.Archive(archive.headers, poor.inputFiles()[0].rpartition("/")[0])).collect()


def test_files_round_trip(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<p>{i % 7}é\r\n\r\nWARC/1.1\r\n</p>" * (i % 3)) for i in range(60)] + [(5, None, "twice"), (5, None, "twice"), (None, "u", None)]
    archive = warc.write_archive(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    records = warc.read_archive(spark, archive)
    folder = f"file://{tmp_path}/warc"
    warc.export_files(records, folder)
    got = warc.import_files(spark, folder).collect()
    assert len(got) == len(rows) and len({r.record_id for r in got}) == len(rows)
    by = {r.record_id: r for r in got}
    whole = sorted(bytes(r.payload if r.record_type == "response" else by[r.refers_to_id].payload).decode() for r in got)
    assert whole == sorted(r[2] or "" for r in rows)
    assert all(r.record_type == "revisit" or r.declared_digest == "sha1:" + digest(bytes(r.payload)) for r in got)
    one = next((tmp_path / "warc").glob("part-*.warc"))
    (tmp_path / "zipped").mkdir()
    (tmp_path / "zipped" / "a.warc.gz").write_bytes(gzip.compress(one.read_bytes()))
    zipped = warc.import_files(spark, f"file://{tmp_path}/zipped").collect()
    assert sorted(r.record_id for r in zipped) == sorted(r.record_id for r in got if r.file == one.name)
    assert warc.import_files(spark, f"file://{tmp_path}/zipped").filter("record_type IS NULL").count() == 0
