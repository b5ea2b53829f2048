"""Mixing sources to target weights along a time-varying curriculum.

1. **Targets.** Sources in code point order (null last) weigh 5, 2, 1, and so on again. They share all words by weight; a target
   stops at ``CAP`` times its source's size and the excess is shared again by weight, until none is above.
2. **Supply.** Inside a source documents lie in the order of a digest, so reruns agree. They are passed through up to ``CAP``
   times; the last document taken gives only its opening words, so that the words taken meet the target to the word.
3. **Schedule.** Each weight has a schedule, a weight over training time with straight lines between knots. Its integral, scaled
   to the target, is the source's cumulative token demand; inverting that at the middle of a document's stretch of supply gives
   the time at which it is due, and the demand of all sources up to then its position in tokens.
4. ``arranged`` range-sorts the documents by position: the stream that training reads, with its texts. ``op13`` counts in it.

Running totals are taken inside digest ranges (about the square root of a source's rows each) and over the ranges, so a source
with a third of all rows is many small windows. Rows that are alike in id and text are counted before the shuffle.

Null and empty texts have size 0 and take no words; null ids and sources are kept; a source without words has target 0. Repeated
rows each count, ties are such rows only. No row is dropped; extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import pieces, table, written

WEIGHTS, CAP = (5, 2, 1), 3
SPACE = r"[\x20\x09-\x0D]+"
#: Knots (time, weight) per weight class, time from 0 to 1: heavy sources fade a little, light ones come in late.
SCHEDULES = {5: ((0.0, 1.2), (0.5, 1.0), (1.0, 0.8)), 2: ((0.0, 1.0), (1.0, 1.0)), 1: ((0.0, 0.2), (0.5, 0.8), (1.0, 2.0))}


def size_of(text: Column) -> Column:
    """Words between white space."""
    return F.size(pieces(text, SPACE)).cast("long")


# --- targets -----------------------------------------------------------------------------------------------

def ranked_sources(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, n_rows, weight) of (source, size, n), numbered in ranges: no task holds all sources."""
    s = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_rows"))
    order = [F.col("source").isNull(), F.col("source")]
    s = s.repartitionByRange(*order).sortWithinPartitions(*order)
    s = written(s.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    before = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = s.groupBy("part").agg(F.count(F.lit(1)).alias("rows")).select("part", F.coalesce(before, F.lit(0)).alias("before"))  # a row per partition
    turn = ((F.col("before") + F.col("at")) % len(weights)).cast("int")
    return s.join(F.broadcast(parts), "part").select("source", "source_size", "n_rows", F.get(F.array(*map(F.lit, weights)), turn).cast("long").alias("weight"))


def targets(sources: DataFrame, cap: int = CAP) -> DataFrame:
    """``sources`` with ``target`` (words, double) and ``budget`` (the same, rounded to whole words)."""
    sources = written(sources)
    limit, w = F.col("source_size") * cap, F.col("weight")
    left, share, full = sources.agg(F.sum("source_size"), F.sum("weight"), F.lit(0)).first()
    while share:  # one round per reshare; each returns three numbers
        above = limit * share <= w * left
        capped, rest, n = sources.agg(F.sum(F.when(above, limit)), F.sum(F.when(~above, w)), F.count_if(above)).first()
        if n == full:
            break
        left, share, full = sources.agg(F.sum("source_size")).first()[0] - (capped or 0), rest or 0, n
    if not share:  # every source is at its limit
        return sources.withColumns({"target": limit.cast("double"), "budget": limit})
    above, part = limit * share <= w * left, w * left
    return sources.withColumns({"target": F.when(above, limit.cast("double")).otherwise(part.cast("double") / share),
                                "budget": F.when(above, limit).otherwise(F.floor((2 * part + share) / F.lit(2 * share).cast("decimal(20,0)")).cast("long"))})


# --- schedules ---------------------------------------------------------------------------------------------

def _stretches(knots):
    """(start, end, weight at the start, slope, integral before) of each stretch, and the whole integral; scaled by the caller."""
    out, total = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        out.append((t0, t1, w0, (w1 - w0) / (t1 - t0), total))
        total += (t1 - t0) * (w0 + w1) / 2
    return out, total


def demand(knots, t: Column) -> Column:
    """The share of a source's target that is due by time ``t``: the integral of its schedule."""
    parts, total = _stretches(knots)
    out = F.lit(1.0)
    for t0, t1, w0, slope, before in reversed(parts):
        x = t - t0
        out = F.when(t < t1, (before + x * (w0 + slope * x / 2)) / total).otherwise(out)
    return out


def due(knots, share: Column) -> Column:
    """The inverse of ``demand``: when that share of the target is due."""
    parts, total = _stretches(knots)
    out = F.lit(1.0)
    for t0, t1, w0, slope, before in reversed(parts):
        rest = F.greatest(share * total - before, F.lit(0.0))
        root = w0 + F.sqrt(F.greatest(F.lit(w0 * w0) + 2 * slope * rest, F.lit(0.0)))
        end = (before + (t1 - t0) * (w0 + slope * (t1 - t0) / 2)) / total
        out = F.when(share < end, t0 + F.when(root > 0, 2 * rest / root).otherwise(0.0)).otherwise(out)
    return out


# --- documents ---------------------------------------------------------------------------------------------

def order_key(doc_id: Column, text: Column) -> Column:
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, schedules: dict = SCHEDULES) -> DataFrame:
    """Per row of ``docs``: doc_id, source, size, source_size, target, taken, key (digest of id and text), ``start`` (the words of its
    source before it, which names rows with words apart) and ``copies``, an array of (epoch, words, time, position)."""
    rows = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), order_key(F.col("doc_id"), F.col("text")).alias("key"), F.spark_partition_id().alias("part"))
    # rows that are alike stay apart by the partition they were read in, so a group of copies is no single window row
    rows = written(rows.groupBy("source", "key", "doc_id", "size", "part").agg(F.count(F.lit(1)).alias("n")))
    sources = written(targets(ranked_sources(rows, weights), cap))
    by_class = {r[0]: float(r[1]) for r in sources.groupBy("weight").agg(F.sum("budget")).collect()}  # a row per weight
    s = sources.select(F.col("source").alias("s_"), "source_size", "target", "budget", "weight", F.ceil(F.sqrt("n_rows")).alias("ranges"))
    number = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    placed = rows.join(s, F.col("source").eqNullSafe(F.col("s_"))).withColumn("range", F.floor(number * F.col("ranges") / F.lit(1 << 32)).cast("long"))
    placed = written(placed.drop("s_", "ranges"))
    earlier = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("source", "range").agg(F.sum(F.col("size") * F.col("n")).alias("words")).select(F.col("source").alias("s_"), F.col("range").alias("r_"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", "part").rowsBetween(Window.unboundedPreceding, -1)
    run = placed.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0)))
    run = run.join(offsets, F.col("source").eqNullSafe(F.col("s_")) & (F.col("range") == F.col("r_")))
    each = run.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).withColumn("start", F.col("offset") + F.col("before") + F.col("i") * F.col("size"))

    def copy(epoch: int) -> Column:
        begin = F.col("start") + epoch * F.col("source_size")
        words = F.greatest(F.least(F.col("size"), F.col("budget") - begin), F.lit(0)).cast("long")
        share = (begin + words / 2) / F.greatest(F.col("budget"), F.lit(1))
        time = F.coalesce(*(F.when(F.col("weight") == k, due(schedules[k], share)) for k in by_class), F.lit(0.0))
        return F.struct(F.lit(epoch).alias("epoch"), words.alias("words"), time.alias("time"))

    copies = each.withColumn("copies", F.filter(F.array(*(copy(e) for e in range(cap))), lambda c: c["words"] > 0))
    position = lambda t: sum((F.lit(a) * demand(schedules[k], t) for k, a in by_class.items()), F.lit(0.0))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda acc, c: acc + c["words"])
    return copies.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "key", "start",
                         F.transform("copies", lambda c: F.struct(c["epoch"], c["words"], c["time"], position(c["time"]).alias("position"))).alias("copies"))


def arranged(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, schedules: dict = SCHEDULES, mix: DataFrame | None = None) -> DataFrame:
    """The training stream: position, doc_id, source, start, epoch, words, text, range-sorted by position. A document that gives only
    its opening words has them joined by blanks. ``mix`` is what ``mixed`` gave for ``docs``, if it is at hand."""
    m = mixed(docs, weights, cap, schedules) if mix is None else mix
    m = m.select("doc_id", "source", "size", "key", "start", F.explode("copies").alias("c")).select("*", "c.*")
    texts = docs.select(order_key(F.col("doc_id"), F.col("text")).alias("k_"), "text").groupBy("k_").agg(F.first("text").alias("text"))
    cut = F.array_join(F.slice(pieces(F.col("text"), SPACE), 1, F.col("words").cast("int")), " ")
    out = m.join(texts, F.col("key") == F.col("k_")).select("position", "doc_id", "source", "start", "epoch", "words", F.when(F.col("words") < F.col("size"), cut).otherwise(F.col("text")).alias("text"), "key")
    return out.repartitionByRange("position").sortWithinPartitions("position", "key", "epoch").drop("key")


def op13(spark, sf_dir: str) -> DataFrame:
    """Per document: its size, its source's size and target, the words the stream takes from it, and where its first copy stands there."""
    docs = table(spark, sf_dir, "documents")
    m = written(mixed(docs))
    # words are counted in the texts of the stream; what is kept of it here goes without them
    stream = written(arranged(docs, mix=m).select(F.col("source").alias("s_"), F.col("start").alias("t_"), "epoch", "position", size_of(F.col("text")).alias("words")))
    got = (stream.groupBy("s_", "t_").agg(F.sum("words").alias("taken"), F.min_by("position", "epoch").alias("first")))
    has_words = F.when(F.col("size") > 0, F.col("start"))
    out = m.drop("taken").join(got, F.col("source").eqNullSafe(F.col("s_")) & (has_words == F.col("t_")), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), F.round("first", 3).alias("first_position"))


def _sql_due(knots) -> str:
    parts, total = _stretches(knots)
    whens = []
    for t0, t1, w0, slope, before in parts:
        rest = f"greatest(share * {total!r} - {before!r}, 0.0)"
        end = (before + (t1 - t0) * (w0 + slope * (t1 - t0) / 2)) / total
        whens.append(f"WHEN share < {end!r} THEN {t0!r} + 2 * {rest} / ({w0!r} + sqrt(greatest({w0 * w0!r} + 2 * {slope!r} * {rest}, 0.0)))")
    return f"CASE {' '.join(whens)} ELSE 1.0 END"


def _sql_demand(knots) -> str:
    parts, total = _stretches(knots)
    return f"CASE {' '.join(f'WHEN t < {t1!r} THEN ({before!r} + (t - {t0!r}) * ({w0!r} + {slope!r} * (t - {t0!r}) / 2)) / {total!r}' for t0, t1, w0, slope, before in parts)} ELSE 1.0 END"


SQL = f"""
WITH d_ AS (SELECT doc_id, source, CAST(coalesce(len(list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')), 0) AS BIGINT) AS size,
  md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
s_ AS (SELECT source, CAST(sum(size) AS BIGINT) AS z, [{', '.join(map(str, WEIGHTS))}][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1 AS INTEGER)] AS w FROM d_ GROUP BY source),
-- sources in the order in which they reach their limits: k of them capped leaves room and weight to the rest
o_ AS (SELECT *, row_number() OVER (ORDER BY z / w, source NULLS LAST) AS k FROM s_),
f_ AS (SELECT *, (SELECT sum(z) FROM s_) - coalesce(sum({CAP} * z) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room, sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM o_),
k_ AS (SELECT min(k) AS k FROM f_ WHERE {CAP} * z * rest > room * w),
l_ AS (SELECT room, rest FROM f_ JOIN k_ USING (k)),
t_ AS (SELECT source, w, z, CASE WHEN k < coalesce((SELECT k FROM k_), 1000000000) THEN CAST({CAP} * z AS DOUBLE) ELSE CAST(w * (SELECT room FROM l_) AS DOUBLE) / (SELECT rest FROM l_) END AS target,
  CAST(CASE WHEN k < coalesce((SELECT k FROM k_), 1000000000) THEN {CAP} * z ELSE (2 * w * (SELECT room FROM l_) + (SELECT rest FROM l_)) // (2 * (SELECT rest FROM l_)) END AS BIGINT) AS budget FROM o_),
p_ AS (SELECT doc_id, size, z, target, budget, w, coalesce(sum(size) OVER (PARTITION BY d_.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d_ JOIN t_ ON d_.source IS NOT DISTINCT FROM t_.source),
c_ AS (SELECT *, {' + '.join(f'greatest(least(size, budget - start - {e} * z), 0)' for e in range(CAP))} AS taken, greatest(least(size, budget - start), 0) AS first_words FROM p_),
h_ AS (SELECT *, (start + first_words / 2) / greatest(budget, 1) AS share FROM c_),
j_ AS (SELECT *, CASE {' '.join(f'WHEN w = {k} THEN {_sql_due(v)}' for k, v in SCHEDULES.items())} END AS t FROM h_)
SELECT doc_id, size, z AS source_size, target, CAST(taken AS BIGINT) AS taken,
  CASE WHEN first_words > 0 THEN round({' + '.join(f'(SELECT coalesce(sum(budget), 0) FROM t_ WHERE w = {k})::DOUBLE * {_sql_demand(v)}' for k, v in SCHEDULES.items())}, 3) END AS first_position FROM j_"""
