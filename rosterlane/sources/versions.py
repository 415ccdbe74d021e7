"""A table in the shared folder whose rows are replaced by key: new files first, then one manifest that names them.

Rows lie in buckets by the hash of their keys. A replacement rewrites the buckets it touches as a new version and then commits a manifest, a row per bucket,
that says which version of each bucket counts; readers take the latest manifest. A run that fails before that leaves the former state, and what it has written is
overwritten by the next one. Each manifest names the writer and its batch, so a batch that is repeated after it was committed changes nothing.
Old versions stay until vacuum().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import exists, remove

_MANIFEST = "n long, bucket int, version long, writer string, batch long"


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.col(k) for k in self.keys]), F.lit(self.buckets)).cast("int")

    def _manifest(self) -> list:
        """The rows of the latest manifest: at most one more than there are buckets."""
        if not exists(self.spark, f"{self.path}/manifests"):
            return []
        every = self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifests")
        return every.join(F.broadcast(every.agg(F.max("n").alias("n"))), "n").collect()

    def _files(self, rows: list) -> DataFrame:
        paths = [f"{self.path}/data/version={r.version}/bucket={r.bucket}" for r in rows if r.bucket >= 0]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self) -> DataFrame:
        """The rows that count now."""
        return self._files(self._manifest())

    def replace(self, new: DataFrame, keys: DataFrame | None = None, writer: str = "", batch: int | None = None) -> bool:
        """new in place of the rows with its keys, or with the given keys, which may be more; False where this writer's batch is the last one committed."""
        held = self._manifest()
        if held and batch is not None and (held[0].writer, held[0].batch) == (writer, batch):
            return False
        n = 1 + (held[0].n if held else 0)
        gone = (new if keys is None else keys).select(*self.keys).distinct()
        touched = {r.b for r in gone.select(self._bucket().alias("b")).distinct().collect()} | {r.b for r in new.select(self._bucket().alias("b")).distinct().collect()}
        old = self._files([r for r in held if r.bucket in touched]).join(gone, list(self.keys), "left_anti")
        columns = self.spark.createDataFrame([], self.schema).columns
        rows = old.select(*columns).unionByName(new.select(*columns)).withColumn("bucket", self._bucket())
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/version={n}")
        written = {b for b in touched if exists(self.spark, f"{self.path}/data/version={n}/bucket={b}")}
        now = {r.bucket: r.version for r in held if r.bucket >= 0 and r.bucket not in touched} | dict.fromkeys(written, n)
        rows = [(n, b, v, writer, batch) for b, v in sorted({**now, -1: n}.items())]  # -1: a manifest of no buckets has a row too
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifests")
        return True

    def vacuum(self) -> int:
        """Removes the versions that no bucket counts any more; how many they were. Not while others read or write."""
        held = self._manifest()
        kept = {r.version for r in held if r.bucket >= 0}
        old = [v for v in range(1, (held[0].n if held else 0) + 1) if v not in kept and exists(self.spark, f"{self.path}/data/version={v}")]
        for v in old:
            remove(self.spark, f"{self.path}/data/version={v}")
        return len(old)
