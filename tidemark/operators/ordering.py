"""First/best/top-N per key, ranking, paging and a distributed dense position.

``row_number() <= n`` per key is planned by Spark with a group limit in front of
the shuffle, so a key that holds a third of the rows ships at most ``n`` rows per
input task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tidemark.session import scratch_path


def _cols(keys: Sequence[Column | str] | Column | str) -> list[Column]:
    if isinstance(keys, (str, Column)):
        keys = [keys]
    return [F.col(k) if isinstance(k, str) else k for k in keys]


def top_n_per_group(df: DataFrame, keys, order, n: int, rank_col: str | None = None) -> DataFrame:
    w = Window.partitionBy(*_cols(keys)).orderBy(*_cols(order))
    name = rank_col or "_rn"
    out = df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)
    return out if rank_col else out.drop(name)


def keep_first_by_key(df: DataFrame, key, pos) -> DataFrame:
    """First row per key in input order; rows with a null or empty key are kept as they are."""
    return _keep(df, key, [F.asc(pos) if isinstance(pos, str) else pos])


def keep_best_by_key(df: DataFrame, key, score, pos) -> DataFrame:
    """Highest score per key, the first on ties."""
    return _keep(df, key, [F.desc(score) if isinstance(score, str) else score.desc(), F.asc(pos)])


def _keep(df: DataFrame, key, order) -> DataFrame:
    return top_n_per_group(df, key, order, 1)


def source_diversity_cap(df: DataFrame, keys, source: str, order, max_per_source: int, k: int,
                         rank_col: str = "rank") -> DataFrame:
    """Walk a ranking taking at most ``max_per_source`` rows per source until ``k`` are taken.

    Equivalent form: rank inside each source, drop the surplus, rank what is left.
    """
    keys = _cols(keys) if keys else []
    capped = top_n_per_group(df, [*keys, F.col(source)], order, max_per_source)
    if keys:
        return top_n_per_group(capped, keys, order, k, rank_col)
    first = capped.orderBy(*_cols(order)).limit(k)
    return rank_bounded(first, order, rank_col)


def rank_bounded(df: DataFrame, order, rank_col: str = "rank", start: int = 1) -> DataFrame:
    """Number the rows of an already limited list (a top-k), whose size does not grow with the data."""
    return df.withColumn(rank_col, F.row_number().over(Window.orderBy(*_cols(order))) + (start - 1))


def page(df: DataFrame, order, number: int, size: int) -> DataFrame:
    """Rows of one page (0-based, clamped to the last page) with the page count."""
    n_pages = df.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / size)).cast("int").alias("n_pages"))
    last = n_pages.first()[0] - 1
    at = min(max(number, 0), last)
    rows = df.orderBy(*_cols(order)).offset(at * size).limit(size)
    return rows.withColumn("page", F.lit(at + 1)).withColumn("n_pages", F.lit(last + 1))


@dataclass
class StoredOrder:
    """A sorted table in ranges (``_part``, a partition column) with each row's place in its range (``_at``), and how many rows lie
    before each range: a few numbers per range."""

    rows: DataFrame
    starts: dict[int, int]
    total: int

    def positions(self, out: str = "position", start: int = 0) -> DataFrame:
        """All rows with their place in the order."""
        before = F.element_at(F.create_map(*(F.lit(x) for kv in self.starts.items() for x in kv)), F.col("_part")) if self.starts else F.lit(0)
        return self.rows.withColumn(out, (before + F.col("_at") + start).cast("bigint")).drop("_part", "_at")

    def between(self, first: int, last: int) -> DataFrame:
        """The rows at places ``first`` (from 0) to ``last`` (not included), with ``position``; only their ranges are read."""
        ends = {p: b for p, b in zip(self.starts, [*list(self.starts.values())[1:], self.total])}
        wanted = [p for p, b in self.starts.items() if b < last and ends[p] > first]
        own = StoredOrder(self.rows.where(F.col("_part").isin(wanted)), {p: self.starts[p] for p in wanted}, self.total)
        return own.positions().where((F.col("position") >= first) & (F.col("position") < last))

    def page(self, number: int, size: int) -> DataFrame:
        """Rows of one page (0-based, clamped to the last page) with the page count."""
        last = max(1, -(-self.total // size)) - 1
        at = min(max(number, 0), last)
        rows = self.between(at * size, (at + 1) * size).drop("position")
        return rows.withColumn("page", F.lit(at + 1)).withColumn("n_pages", F.lit(last + 1))


def store_order(df: DataFrame, order, path: str | None = None, parts: int | None = None) -> StoredOrder:
    """Sort once into ranges and keep them: pages and places are then read from their ranges alone.

    ``order`` names rows apart (equal rows of a range lie in any order). No row passes through one task.
    """
    spark, order = df.sparkSession, _cols(order)
    path = path or scratch_path(spark, "order")
    cut = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    placed = cut.sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    placed.write.partitionBy("_part").parquet(path)
    rows = spark.read.schema(StructType([*df.schema.fields, StructField("_at", LongType()), StructField("_part", IntegerType())])).parquet(path)
    counts = sorted((r[0], r[1]) for r in rows.groupBy("_part").agg(F.count(F.lit(1))).collect())
    starts, total = {}, 0
    for part, n in counts:
        starts[part] = total
        total += n
    return StoredOrder(rows, starts, total)


def latest(df: DataFrame, order, n: int) -> DataFrame:
    """Newest N rows: per-task top N, merged; never a global sort."""
    return df.orderBy(*_cols(order)).limit(n)


def dense_position(df: DataFrame, pos: str, out: str = "_pos", buckets: int | None = None) -> DataFrame:
    """Dense 0-based position in the order of a unique numeric column without a single-task window.

    Fixed range cuts split the rows into balanced buckets; rows are numbered inside
    a bucket and shifted by the sizes of the buckets before it.  Only the cuts and
    the bucket sizes (one row per bucket) are small tables.
    """
    buckets = buckets or max(2, df.sparkSession.sparkContext.defaultParallelism * 2)
    cuts = df.stat.approxQuantile(pos, [i / buckets for i in range(1, buckets)], 1 / (4 * buckets))
    cuts = sorted(set(cuts))
    # a binary search over the cuts: the plan stays shallow for any number of them
    from pyspark.ml.feature import Bucketizer

    splits = [float("-inf"), *cuts, float("inf")]
    key = df.withColumn("_key", F.col(pos).cast("double"))
    with_b = Bucketizer(splits=splits, inputCol="_key", outputCol="_b", handleInvalid="keep").transform(key).withColumn("_b", F.col("_b").cast("int")).drop("_key") if cuts else df.withColumn("_b", F.lit(0))
    sizes = with_b.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    # At most `buckets` rows, so the unpartitioned window is of fixed size.
    shift = sizes.withColumn(
        "_off", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).select("_b", "_off")
    local = F.row_number().over(Window.partitionBy("_b").orderBy(pos))
    return (with_b.join(F.broadcast(shift), "_b")
            .withColumn(out, (F.col("_off") + local - 1).cast("bigint")).drop("_b", "_off"))


def next_rows(df: DataFrame, pos: str, fields: Sequence[str], ahead: int = 5, block: int = 20_000) -> DataFrame:
    """Each row with each of the next ``ahead`` rows (fields prefixed ``next_``).

    The order is cut into blocks of positions; the first ``ahead`` rows of a block
    are copied into the block before it, so every look-ahead stays inside one block.
    """
    numbered = dense_position(df, pos)
    blk, off = F.floor(F.col("_pos") / block), F.col("_pos") % block
    homes = F.when((off < ahead) & (blk > 0), F.array(blk, blk - 1)).otherwise(F.array(blk))
    placed = numbered.withColumn("_home", blk).withColumn("_blk", F.explode(homes))
    w = Window.partitionBy("_blk").orderBy("_pos")
    record = F.struct(*[F.col(f) for f in fields])
    steps = F.array(*[F.struct(F.lit(i).alias("step"), F.lead(record, i).over(w).alias("row")) for i in range(1, ahead + 1)])
    out = (placed.withColumn("_next", steps).where(F.col("_blk") == F.col("_home"))
           .withColumn("_next", F.explode("_next")).where(F.col("_next.row").isNotNull()))
    return out.select(
        *[F.col(c) for c in df.columns], F.col("_next.step").alias("step"),
        *[F.col(f"_next.row.{f}").alias(f"next_{f}") for f in fields])
