"""A keyed table that stays: rows in buckets of their key, and a manifest that says which files are the table now."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import file_system

#: Batches that a manifest remembers, the latest: one of these again changes nothing.
REMEMBERED = 1000


class Conflict(RuntimeError):
    """Another writer has made the version that this one was about to make."""


@dataclass(frozen=True)
class Versioned:
    """The table at path, with rows told apart by key and dealt to so many buckets.

    An upsert writes the buckets that its rows fall into anew and then puts the next manifest in place, in one rename; a reader takes the last
    manifest there is. What ends before the rename leaves the former version as it was, files that no manifest names are nothing,
    and a batch that is already in does nothing. Rows in a bucket are as many as the table's divided by buckets.
    """

    spark: SparkSession
    path: str
    key: tuple[str, ...]
    buckets: int = 64

    def manifest(self) -> dict | None:
        """The last version: version, schema, buckets (number to folder), batches; None if there is none."""
        files, folder = file_system(self.spark, f"{self.path}/manifest")
        if not files.exists(folder):
            return None
        names = [f.getPath().getName() for f in files.listStatus(folder)]
        last = max((n for n in names if n.endswith(".json")), default=None)
        if last is None:
            return None
        stream = files.open(self.spark._jvm.org.apache.hadoop.fs.Path(folder, last))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, buckets: list[int] | None = None, version: dict | None = None) -> DataFrame:
        """The rows of the last (or a given) version, of all or some buckets."""
        m = version or self.manifest()
        if m is None:
            raise LookupError(f"no table at {self.path}")
        schema = StructType.fromJson(m["schema"])
        folders = [f for b, f in m["buckets"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _bucket(self) -> F.Column:
        return F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.key]), F.lit(self.buckets)).cast("int")

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that keys of rows fall into: at most as many numbers as there are buckets."""
        return sorted(r[0] for r in rows.select(self._bucket()).distinct().collect())

    def upsert(self, new: DataFrame, batch: str) -> int:
        """Rows of new put in or over those of their key; the version that holds them. Of new's repeats of a key the greatest row stays. A null in
        a key is a value like any other."""
        m = self.manifest()
        if m and batch in m["batches"]:
            return m["version"]
        schema = StructType.fromJson(m["schema"]) if m else new.schema
        columns = schema.fieldNames()
        rest = [c for c in columns if c not in self.key]
        kinds = {f.name: f.dataType for f in schema.fields}
        given = new.select(*[F.col(c).cast(kinds[c]).alias(c) for c in columns])
        one = given.groupBy(*self.key).agg(F.max(F.struct(*rest)).alias("_r")).select(*self.key, "_r.*").select(*columns)
        rows, before = one, m["buckets"] if m else {}
        touched = self.touched(one)
        old = [b for b in touched if str(b) in before]
        if old:
            same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.key]
            match = same[0]
            for s in same[1:]:
                match = match & s
            rows = self.read(old, m).alias("o").join(one.select(*self.key).alias("n"), match, "left_anti").select(*columns).unionByName(one)
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", self._bucket()).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
        named = before | {str(b): f"{folder}/_bucket={b}" for b in touched}
        after = {"version": (m["version"] if m else 0) + 1, "schema": json.loads(schema.json()), "buckets": named, "batches": [*(m["batches"] if m else []), batch][-REMEMBERED:]}
        self._commit(after)
        return after["version"]

    def _commit(self, manifest: dict) -> None:
        files, folder = file_system(self.spark, f"{self.path}/manifest")
        files.mkdirs(folder)
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        ready, place = path(folder, f".{uuid.uuid4().hex}"), path(folder, f"{manifest['version']:012d}.json")
        out = files.create(ready, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        if files.exists(place) or not files.rename(ready, place):
            files.delete(ready, False)
            raise Conflict(f"version {manifest['version']} of {self.path} is there already")

    def vacuum(self) -> int:
        """Delete the folders that the last manifest does not name; how many. Only where no reader is at an older version."""
        m = self.manifest()
        files, folder = file_system(self.spark, f"{self.path}/data")
        if m is None or not files.exists(folder):
            return 0
        used = {f.rsplit("/", 2)[1] for f in m["buckets"].values()}
        gone = [f.getPath() for f in files.listStatus(folder) if f.getPath().getName() not in used]
        for place in gone:
            files.delete(place, True)
        return len(gone)
