"""A keyed table that a stream updates: rows lie in buckets by key, and a micro-batch reads and writes only the buckets it touches.

Every version of a bucket is a folder of its own, written before the manifest of the micro-batch names it; a reader takes the newest
named version of each bucket. A batch that failed half-way is in no manifest, and one that is played again reads the versions before
it and writes the same folders: so replays change nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKETS = 64


class BucketTable:
    """``key``: the column that names a row. ``buckets`` is fixed when the table is made."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = schema
        self.columns = spark.createDataFrame([], schema).columns

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def versions(self, before: int | None = None) -> dict[int, int]:
        """The newest version of each bucket, of those before a micro-batch: at most ``buckets`` numbers."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest")
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return {}
        m = self.spark.read.schema("bucket int, version bigint, at bigint").parquet(f"{self.path}/manifest")
        m = m if before is None else m.where(F.col("version") < before)
        return {r[0]: r[1] for r in m.groupBy("bucket").agg(F.max("version")).collect()}

    def read(self, buckets: list[int] | None = None, before: int | None = None) -> DataFrame:
        """The rows of the wanted buckets (all by default), from their folders alone."""
        now = self.versions(before)
        paths = [f"{self.path}/data/version={v}/bucket={b}" for b, v in sorted(now.items()) if buckets is None or b in buckets]
        reader = self.spark.read.schema(self.schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame, epoch: int) -> None:
        """A version of the buckets that ``rows`` make up whole; large ones are split into several files."""
        folder = f"{self.path}/data/version={epoch}"
        out = rows.select(*self.columns).withColumn("bucket", self.bucket())
        out.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        there = self.spark.read.schema(f"{self.schema}, bucket int").parquet(folder).select("bucket").distinct()
        there.withColumn("version", F.lit(epoch).cast("long")).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/at={epoch}")

    def touched_by(self, batch: DataFrame) -> list[int]:
        return sorted(r[0] for r in batch.select(self.bucket().alias("b")).distinct().collect())

    def upsert(self, batch: DataFrame, newest: list[Column], epoch: int) -> None:
        """Rows of the batch replace those of their key; of several rows of a key the first in the order ``newest`` stays."""
        from pyspark.sql.window import Window

        batch = batch.persist()
        touched = self.touched_by(batch)
        both = self.read(touched, epoch).withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
        first = F.row_number().over(Window.partitionBy(self.key).orderBy(F.desc("_new"), *newest))
        self.write(both.withColumn("_i", first).where("_i = 1").drop("_i", "_new"), epoch)
        batch.unpersist()

    def add_novel(self, batch: DataFrame, make: Callable[[DataFrame], DataFrame], epoch: int) -> None:
        """Rows whose key the table lacks are made (labelled) and added; known keys are not made again."""
        batch = batch.dropDuplicates([self.key]).persist()
        touched = self.touched_by(batch)
        known = self.read(touched, epoch)
        fresh = make(batch.join(known.select(self.key), self.key, "left_anti"))
        self.write(known.unionByName(fresh.select(known.columns)), epoch)
        batch.unpersist()


def into(rows: DataFrame, put: Callable[[DataFrame, int], None], checkpoint: str):
    """Feed what has arrived to ``put(batch, epoch)``; returns the started query."""
    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
