"""Large JSON files split by byte ranges: the records of an array are found without reading a file in one task.

Spark cuts a file into ranges and its text source yields the pieces between closing braces. What a range does to the state of a
parser (inside a string or not, how many braces are open) can be told without knowing the state it starts in: there are two cases.
One small row per range gives every range its start; a second pass then cuts records exactly, and the few that cross a range are
put together by a grouping.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.window import Window

_STRING = re.compile(r'"(?:[^"\\]|\\.)*"', re.S)
_REST_OF_STRING = re.compile(r'(?:[^"\\]|\\.)*"', re.S)
_QUOTE_OR_BRACE = re.compile(r'"(?:[^"\\]|\\.)*("?)|[{}]', re.S)


def _after(piece: str, in_string: bool) -> tuple[bool, int]:
    """Whether a string is open after ``piece``, and by how much it raises the number of open braces."""
    if in_string:
        end = _REST_OF_STRING.match(piece)
        if not end:
            return True, 0
        piece = piece[end.end() :]
    plain = _STRING.sub("", piece)
    quote = plain.find('"')
    if quote >= 0:
        plain = plain[:quote]
    return quote >= 0, plain.count("{") - plain.count("}")


def _pieces(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, block, value): pieces up to and without a closing brace, in order within a block."""
    t = spark.read.option("lineSep", "}").text(paths)
    m = F.col("_metadata")
    return t.select(m["file_path"].alias("file"), m["file_block_start"].alias("block"), "value")


def _effects(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per range of a task: what it does to the parser from either start."""
    seen: dict[tuple[str, int], list] = {}
    for pdf in batches:
        for file, block, value in zip(pdf["file"], pdf["block"], pdf["value"]):
            state = seen.setdefault((file, block), [False, 0, True, 0])
            for k in (0, 2):
                state[k], rise = _after(value + "}", state[k])
                state[k + 1] += rise
    yield pd.DataFrame([(*k, *v) for k, v in seen.items()], columns=["file", "block", "open_0", "rise_0", "open_1", "rise_1"])


def _starts(effects: DataFrame) -> DataFrame:
    """(file, block, in_string, depth): the state each range starts in; a fold over the ranges of a file, a few numbers each."""
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.collect_list(F.struct("open_0", "rise_0", "open_1", "rise_1")).over(order)
    zero = F.struct(F.lit(False).alias("s"), F.lit(0).cast("bigint").alias("d"))
    step = lambda a, e: F.struct(F.when(a["s"], e["open_1"]).otherwise(e["open_0"]).alias("s"), (a["d"] + F.when(a["s"], e["rise_1"]).otherwise(e["rise_0"])).alias("d"))
    at = F.aggregate(earlier, zero, step)
    return effects.select("file", "block", at.alias("at")).select("file", "block", F.col("at.s").alias("in_string"), F.col("at.d").alias("depth"))


def _cutter(level: int):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Records that lie in one range as they are; of the others the part in front, the part behind, or all of a range."""
        now, in_string, depth, held, seq = None, False, 0, [], 0
        out: list[tuple] = []

        def tail():
            if now and (depth > level or in_string):
                out.append((*now, seq, "open" if began else "through", "".join(held)))

        began = True
        for pdf in batches:
            for file, block, value, s, d in zip(pdf["file"], pdf["block"], pdf["value"], pdf["in_string"], pdf["depth"]):
                if (file, block) != now:
                    tail()
                    now, in_string, depth, held, seq = (file, block), bool(s), int(d), [], 0
                    began = depth <= level  # a record that began in an earlier range has no beginning here
                piece, at = value + "}", 0
                if in_string:
                    end = _REST_OF_STRING.match(piece)
                    if not end:
                        if depth > level:
                            held.append(piece)
                        continue
                    in_string, at = False, end.end()
                copied = 0 if depth > level else None  # from where the piece belongs to a record
                for m in _QUOTE_OR_BRACE.finditer(piece, at):
                    token = m.group()
                    if token == "{":
                        if depth == level:
                            copied = m.start()
                        depth += 1
                    elif token == "}":
                        depth -= 1
                        if depth == level:
                            held.append(piece[copied : m.end()])
                            out.append((*now, seq, "whole" if began else "end", "".join(held)))
                            held, copied, began, seq = [], None, True, seq + 1
                    elif not m.group(1):
                        in_string = True
                if copied is not None:
                    held.append(piece[copied:])
                if len(out) >= 2_000:
                    yield pd.DataFrame(out, columns=["file", "block", "seq", "kind", "record"])
                    out = []
        tail()
        yield pd.DataFrame(out, columns=["file", "block", "seq", "kind", "record"])

    return cut


def read_records(spark: SparkSession, paths: list[str], schema: T.StructType, level: int = 0) -> DataFrame:
    """One row per JSON object that has ``level`` open braces around it (0: the members of a top-level array): the columns of
    ``schema``, ``source_file``, and ``_corrupt_record`` where an object doesn't parse. Files may be of any size, on one line or many;
    what stands between objects is skipped."""
    pieces = _pieces(spark, paths)
    effects = pieces.mapInPandas(_effects, "file string, block bigint, open_0 boolean, rise_0 bigint, open_1 boolean, rise_1 bigint")
    # The last piece of a file ends without the brace that is added to it here; it is behind all records.
    placed = pieces.join(F.broadcast(_starts(effects)), ["file", "block"])  # a row per range of a file
    cut = placed.mapInPandas(_cutter(level), "file string, block bigint, seq int, kind string, record string")
    whole = cut.where("kind = 'whole'").select("file", "record")
    opened = F.max(F.when(F.col("kind") == "open", F.col("block"))).over(Window.partitionBy("file").orderBy("block", "seq"))
    # parts of records across ranges: at most two rows per range
    across = cut.where("kind <> 'whole'").withColumn("of", opened).groupBy("file", "of").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "record"))).alias("parts"))
    joined = across.select("file", F.array_join(F.transform("parts", lambda p: p["record"]), "").alias("record"))
    fields = T.StructType([*schema.fields, *([] if "_corrupt_record" in schema.names else [T.StructField("_corrupt_record", T.StringType())])])
    row = F.from_json("record", fields, {"columnNameOfCorruptRecord": "_corrupt_record", "mode": "PERMISSIVE"})
    return whole.unionByName(joined).select(F.col("file").alias("source_file"), row.alias("r")).select("source_file", "r.*")
