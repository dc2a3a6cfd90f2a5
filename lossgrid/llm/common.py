"""What the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.session import on_workers
from ..sources.shared import new_path, passing, save, shared_dir

__all__ = ["fresh", "hash_fraction", "new_path", "passing", "read", "ready", "save", "shared_dir", "totals_before"]

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of df has them, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


#: Bytes of an Arrow batch on its way to a Python worker: texts may be long, so rows alone bound nothing.
BATCH_BYTES = 8 << 20


def ready(spark: SparkSession) -> None:
    """What the operators need of a session: workers that import this package, and batches bounded by bytes."""
    on_workers(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def hash_fraction(*cols) -> F.Column:
    """A uniform number in [0, 1) from the columns' text, alike in every engine that has md5."""
    hexed = F.substring(F.md5(F.concat_ws(":", *cols)), 1, 13)
    return F.conv(hexed, 16, 10).cast("long") / F.lit(float(16**13))


def totals_before(df: DataFrame, order: list, sums: dict[str, F.Column], name: str) -> DataFrame:
    """df with, for each entry of sums, the total of that column over all rows that stand before in the order, as long.

    Rows are dealt by ranges of the order, so no task sees more than its range; only one total
    a range meets in a single task. Equal rows stand in any, but fixed, order.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = save(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumns({"_pid": F.spark_partition_id(), "_pos": F.monotonically_increasing_id()}), name)
    from pyspark.sql import Window

    whole = dealt.groupBy("_pid").agg(*[F.sum(c).alias(f"_t_{k}") for k, c in sums.items()])
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select("_pid", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_t_{k}") for k in sums])
    inner = Window.partitionBy("_pid").orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumns({f"_i_{k}": F.coalesce(F.sum(c).over(inner), F.lit(0)) for k, c in sums.items()})
    # one row a range: as many as there are shuffle partitions
    out = local.join(F.broadcast(whole), "_pid")
    return out.select(*df.columns, *[(F.col(f"_i_{k}") + F.col(f"_t_{k}")).alias(k) for k in sums])


#: A table expression for DuckDB, which has no crc32: the 256 steps of its polynomial. It begins a WITH list, RECURSIVE as others may be.
CRC32 = """RECURSIVE crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY i) AS steps FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256))
),"""


def crc32_sql(text: str) -> str:
    """DuckDB's expression for crc32 of a text's UTF-8, where crc_table is joined in."""
    digits = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: CAST('0x' || b AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {digits}), lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1])), 4294967295)"
