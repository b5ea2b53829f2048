"""What the operators of this folder share: words, tables of a run, connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, after A-Z have been lower-cased. Fixed by the contracts.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What lies between words.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. Plain ASCII texts take the faster built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column) -> Column:
    """The words of a text, lower-cased; none for null."""
    return pieces(ascii_lower(text), BETWEEN_WORDS)


def pieces(text: Column, between: str) -> Column:
    """The non-empty pieces of a text cut at the pattern ``between``; none for null. ``split`` takes a twentieth of the time
    that ``regexp_extract_all`` needs for the same pieces."""
    return F.coalesce(F.array_remove(F.split(text, between), ""), F.array().cast("array<string>"))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``. Only a local session may go without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/run-{uuid.uuid4().hex}"


def written(df: DataFrame, **options) -> DataFrame:
    """``df`` as a table in the shared folder: lineage is cut, lost executors cost nothing, columns stay prunable."""
    path = shared_dir(df.sparkSession)
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast if the (written) table has at most ``rows`` rows; beyond, Spark chooses another join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


# --- words and shingles as numbers, for Arrow-batched tasks -------------------------------------------------

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word of ``text``, in order: differences of a running sum over all bytes, no loop over words."""
    b = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    inside = np.concatenate(([False], _IN_WORD[b], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    return hash_runs(b, start, end) if len(start) else np.empty(0, np.uint64)


def hash_runs(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes ``start``..``end``, wherever it lies."""
    if len(_powers[0]) <= len(b):
        n = max(1 << 16, 2 * len(b))
        with np.errstate(over="ignore"):
            _powers[0] = np.concatenate(([np.uint64(1)], np.full(n, _P))).cumprod(dtype=np.uint64)
            _powers[1] = np.concatenate(([np.uint64(1)], np.full(n, _P_INV))).cumprod(dtype=np.uint64)
    run = np.concatenate(([np.uint64(0)], (_BYTE[b] * _powers[0][: len(b)]).cumsum(dtype=np.uint64)))
    return mix((run[end] - run[start]) * _powers[1][start] + (end - start).astype(np.uint64))


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """The distinct hashes of ``n`` words in a row, sorted; a shorter text is one shingle, an empty one has none."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    out = np.full(len(hashes) - n + 1, np.uint64(n))
    for k in range(n):
        out = out * np.uint64(0xD6E8FEB86659FD93) + hashes[k : len(hashes) - n + 1 + k]
    return np.unique(mix(out))


# --- connected components ----------------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component of ``edges`` (a, b). Labels fall to the smallest
    neighbour's and jump along their own labels; it ends when nothing changes. Aggregations combine before the shuffle."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("least"))
        step = labels.join(near, "node").select("node", F.least("root", "least").alias("to"), F.col("root").alias("before"))
        step = written(step)
        jump = step.select(F.col("node").alias("to"), F.col("to").alias("further"))
        new = written(step.join(jump, "to", "left").select("node", F.coalesce("further", "to").alias("root"), "before"))
        labels = new.select("node", "root")
        if new.where("root <> before").isEmpty():
            return labels


# --- features of texts, labelled rows, places -------------------------------------------------------------------

def with_numbers(docs: DataFrame, name: str, numbers_of, text_col: str = "text") -> DataFrame:
    """``docs`` with an array of doubles per row: ``numbers_of()`` runs once per task and gives the function text -> list.
    All other columns pass through as they are, whatever their types."""
    import pyarrow as pa
    from pyspark.sql import types as T

    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def add(batches):
        f = numbers_of()
        for batch in batches:
            texts = batch.column(at)
            made = pa.array([f(t.as_py() or "") for t in texts], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, name])

    return docs.mapInArrow(add, schema)


def held_out(doc_id: Column) -> Column:
    """The fold that no model may learn from. A null id is not held out, and not learnt from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled(labels: DataFrame, mark: str) -> DataFrame:
    """(doc_id, mark) of every labelled document outside the held-out fold. Of labels that disagree the largest holds; null labels
    and ids are left out."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col(mark).isNotNull() & ~held_out(F.col("doc_id")))
    return own.groupBy("doc_id").agg(F.max(mark).cast("int").alias(mark))


def numbered(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` with their place in ``order``, from 0: sorted in ranges, so no task holds all rows. A written table."""
    from pyspark.sql import Window

    s = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    s = written(s.withColumns({"part_": F.spark_partition_id(), "at_": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    before = F.sum("rows").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))
    parts = s.groupBy("part_").agg(F.count(F.lit(1)).alias("rows")).select("part_", F.coalesce(before, F.lit(0)).alias("before_"))  # a row per partition
    return s.join(F.broadcast(parts), "part_").withColumn(name, F.col("before_") + F.col("at_")).drop("part_", "at_", "before_")

