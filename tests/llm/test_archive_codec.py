"""The archive's tables are packed by a codec for texts."""

from pathlib import Path

import pyarrow.parquet as pq

from lossgrid.llm import warc


def test_tables_are_packed(spark):
    made = warc.write_archive(spark.createDataFrame([(i, "u", "<p>text</p>" * 50) for i in range(20)], "page_id long, url string, html string"))
    for folder in (made.headers, made.payloads):
        files = list(Path(folder.removeprefix("file://")).glob("*.parquet"))
        assert files and all(pq.ParquetFile(f).metadata.row_group(0).column(0).compression == "ZSTD" for f in files if pq.ParquetFile(f).metadata.num_row_groups)
