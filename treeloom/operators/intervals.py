"""Nested intervals of ranks: what holds a point, numbers and texts along a document, by plans whose size does not depend on the data.

Every plan works in buckets of ranks and adds what lies before a bucket, so neither a long document nor a deep one meets in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.xml import spread

#: Ranks of one bucket. A segment of level k has FANOUT^k ranks; LEVELS of them cover 2^40 ranks.
BUCKET, FANOUT, LEVELS = 4096, 16, 10


def _summed(rows: DataFrame, keys: list[str], value: Column, name: str, order: list[Column]) -> DataFrame:
    """rows (with their bucket in _b) with the running sum of a value among rows of equal keys, in order of _b and then of `order`."""
    inside = Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_b").agg(F.sum(value).alias("_t")).withColumn("_before", F.coalesce(F.sum("_t").over(before), F.lit(0))).drop("_t")
    return rows.withColumn("_in", F.sum(value).over(inside)).join(spread(totals), [*keys, "_b"]).withColumn(name, F.col("_in") + F.col("_before")).drop("_in", "_before")


def numbered(rows: DataFrame, keys: list[str], rank: Column, order: list[Column], name: str) -> DataFrame:
    """rows numbered from 1 among those of equal keys in order of `order`, which sorts by `rank` first. Keys are not null."""
    return _summed(rows.withColumn("_b", F.floor(rank / BUCKET)), keys, F.lit(1).cast("long"), name, order).drop("_b")


def held(points: DataFrame, intervals: DataFrame, key: str, carry: bool = False) -> DataFrame:
    """key, at, open: how many of the intervals hold each point; with carry, `inner` is the carry of the innermost (null where none does).

    points: key, at. intervals: key, begin, end, and carry; they are nested or apart, and all begins and ends differ. A point at an interval's begin or
    end is held. The innermost one of a point that k intervals hold is the last that began as the k-th, so it is
    found without meeting the others.
    """
    none = F.lit(None).cast(intervals.schema["carry"].dataType if carry else "string")
    what = F.struct(F.col("carry") if carry else none.alias("carry"))
    nothing = F.lit(None).cast("struct<carry: " + (intervals.schema["carry"].dataType.simpleString() if carry else "string") + ">")
    event = lambda df, at, kind, delta, said: df.select(key, F.col(at).alias("at"), F.lit(kind).alias("_kind"), F.lit(delta).cast("long").alias("_delta"), said.alias("_carry"))
    opens, closes = event(intervals, "begin", 0, 1, what), event(intervals, "end", 2, -1, nothing)
    rows = event(points, "at", 1, 0, nothing).unionByName(opens).unionByName(closes).withColumn("_b", F.floor(F.col("at") / BUCKET))
    rows = _summed(rows, [key], F.col("_delta"), "open", [F.col("at"), F.col("_kind")])
    if not carry:
        return rows.filter("_kind = 1").select(key, "at", "open")
    rows = rows.filter("_kind < 2 AND open > 0")
    before = Window.partitionBy(key, "open").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.groupBy(key, "open", "_b").agg(F.max_by("_carry", F.when(F.col("_kind") == 0, F.col("at"))).alias("_last"))
    last = last.withColumn("_before", F.last("_last", True).over(before)).drop("_last")
    inside = Window.partitionBy(key, "open", "_b").orderBy("at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_in", F.last("_carry", True).over(inside)).join(spread(last), [key, "open", "_b"])
    return rows.filter("_kind = 1").select(key, "at", "open", F.coalesce("_in", "_before")["carry"].alias("inner"))


def segments(begin: Column, end: Column) -> Column:
    """array<struct<level, part>>: the fewest segments of aligned ranks that make up [begin, end], at most 2 * (FANOUT - 1) of a level, in no set order."""
    out = []
    nothing = F.array().cast("array<bigint>")
    of = lambda k: lambda i: F.struct(F.lit(k).alias("level"), i.cast("long").alias("part"))
    some = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(nothing)
    for k in range(LEVELS):
        size = FANOUT**k
        low, high = F.ceil(begin / size), F.floor((end + 1) / size)
        low_up, high_up = F.ceil(begin / (size * FANOUT)), F.floor((end + 1) / (size * FANOUT))
        edges = F.when(low_up > high_up, some(low, high)).otherwise(F.concat(some(low, low_up * FANOUT), some(high_up * FANOUT, high)))
        out.append(F.transform(F.when(low < high, edges).otherwise(nothing), of(k)))
    return F.flatten(F.array(*out))


def part_of(at: Column) -> Column:
    """array<struct<level, part>>: the segments that a rank lies in."""
    return F.array(*[F.struct(F.lit(k).alias("level"), F.floor(at / FANOUT**k).cast("long").alias("part")) for k in range(LEVELS)])


def covering(points: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """key, at, and an interval's other columns: every pair of a point and an interval around it, and no other candidates: an equi-join on segments."""
    where = [key, "level", "part"]
    p = points.select(key, "at", F.explode(part_of(F.col("at"))).alias("_s")).select(key, "at", "_s.*")
    rest = [c for c in intervals.columns if c not in (key, "begin", "end")]
    i = intervals.select(key, *rest, F.explode(segments(F.col("begin"), F.col("end"))).alias("_s")).select(key, *rest, "_s.*")
    return spread(p).join(i, where).select(key, "at", *rest)


def texts(said: DataFrame, intervals: DataFrame, key: str) -> DataFrame:
    """key, begin, text: what the rows of said (key, at, value) say inside each interval (key, begin, end), in order; intervals in which nothing is said are left out.

    The texts of every segment that an interval is made of are put together first, each once, so an interval meets a few segments and not all its texts.
    """
    where = [key, "level", "part"]
    needed = intervals.select(key, "begin", F.explode(segments(F.col("begin"), F.col("end"))).alias("_s")).select(key, "begin", "_s.*")
    used = spread(needed.select(*where).distinct())
    parts = said.select(key, "at", "value", F.explode(part_of(F.col("at"))).alias("_s")).select(key, "at", "value", "_s.*").join(used, where, "left_semi")
    in_order = lambda at, value: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(at, value))), lambda x: x[value]), "")
    parts = parts.groupBy(*where).agg(in_order("at", "value").alias("value"))
    first = reduce(lambda c, k: F.when(F.col("level") == k, F.col("part") * FANOUT**k).otherwise(c), range(1, LEVELS), F.col("part"))
    found = needed.join(spread(parts), where).withColumn("first", first)
    return found.groupBy(key, "begin").agg(in_order("first", "value").alias("text"))
