"""Block grids: exact all-pairs work inside a group without one task per group.

A group is cut into blocks by a hash of the id: of ``block_rows`` rows while they are few, of more
rows in larger groups, up to a bound, so what is copied grows with the input.  Each pair of blocks
is one unit of work, compared a tile at a time.  Units return folded results (counts, minima, sums),
never the pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


#: A group has at most this many blocks, so a row is copied at most as often however large the group; beyond ``BLOCK_ROWS`` rows a block grows no more.
MAX_BLOCKS, BLOCK_ROWS = 16, 65_536


def rows_per_block(n: Column, block_rows: int, max_blocks: int = MAX_BLOCKS, most: int = BLOCK_ROWS) -> Column:
    """How many of ``n`` rows a block holds: at least ``block_rows``, and more in groups that would have more than ``max_blocks`` blocks."""
    return F.greatest(F.lit(block_rows), F.least(F.ceil(n / max_blocks), F.lit(most)))


def assign_blocks(df: DataFrame, group: list[str], id_col: str, block_rows: int = 4_000, max_blocks: int = MAX_BLOCKS, most: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``_blk`` and ``_nblk`` (number of blocks of the row's group)."""
    count = F.count(F.lit(1))
    blocks = F.ceil(count / rows_per_block(count, block_rows, max_blocks, most))
    if group:
        sizes = df.groupBy(*group).agg(blocks.cast("int").alias("_nblk"))
        out = df.join(sizes, group)
    else:
        n = df.agg(F.greatest(blocks, F.lit(1)).cast("int").alias("n"))
        out = df.withColumn("_nblk", n.scalar())
    return out.withColumn("_blk", F.pmod(F.xxhash64(F.col(id_col)), F.col("_nblk")).cast("int"))


def block_pairs(df: DataFrame) -> DataFrame:
    """Copies each row to every block pair it belongs to; ``_lo``/``_hi`` name the pair."""
    other = F.sequence(F.lit(0), F.col("_nblk") - 1)
    return (df.withColumn("_o", F.explode(other))
            .withColumn("_lo", F.least("_blk", "_o")).withColumn("_hi", F.greatest("_blk", "_o")).drop("_o"))
