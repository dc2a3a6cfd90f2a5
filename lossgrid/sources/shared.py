"""Tables between steps: written to the folder that all executors share, so they survive lost executors and cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where that is unset on a single machine (tests) one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not path:
        own = tempfile.mkdtemp(prefix="lossgrid-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lossgrid/{name}-{uuid.uuid4().hex[:12]}"


def file_system(spark: SparkSession, path: str):
    """The file system of a path and the path, as Hadoop has them."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


#: The passing tables of the innermost passing() of this thread, if any.
_passing: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("passing", default=None)


@contextlib.contextmanager
def passing(spark: SparkSession):
    """Tables saved inside go at its end, but those saved to stay; nothing that is read later may hang on them."""
    paths: list[str] = []
    before = _passing.set(paths)
    try:
        yield
    finally:
        _passing.reset(before)
        for path in paths:
            files, place = file_system(spark, path)
            files.delete(place, True)


def save(df: DataFrame, name: str, stays: bool = False, codec: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts lineage, survives lost executors. codec: of Parquet, else the session's."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if (paths := _passing.get()) is not None and not stays:
        paths.append(path)
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by its keys to as many tasks as spark.sql.shuffle.partitions says. For narrow rows that grow, as where each becomes several texts: a
    file's rows come in few tasks by its size on disk, which says little of what is made of them, and AQE would merge small pieces."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def keep(name: str, df: DataFrame) -> DataFrame:
    """save, as intake_run.run takes it."""
    return save(df, name)
