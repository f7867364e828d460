"""Exact quantiles, medians and ranks that no single task holds the values for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks that a quantile sketch may be off, as a share of all: 1 / ACCURACY.
ACCURACY = 10_000


def _at(counts: DataFrame, keys: list[str], value: str, q: float, name: str) -> DataFrame:
    """(keys, name) from counts (keys, value, n, below, total): distinct values in the
    sought range, how often each occurs, and how many values are smaller than all."""
    w = Window.partitionBy(*keys).orderBy(value)
    last = F.col("below") + F.sum("n").over(w)  # one more than the value's last rank
    place = F.lit(q) * (F.col("total") - 1)
    held = counts.withColumns({"last": last, "lower": F.floor(place), "upper": F.ceil(place), "place": place})
    pick = lambda rank: F.min(F.when(F.col("last") > F.col(rank), F.col(value)))
    found = held.groupBy(*keys).agg(pick("lower").alias("x"), pick("upper").alias("y"), *[F.first(c).alias(c) for c in ("lower", "upper", "place")])
    between = (F.col("upper") - F.col("place")) * F.col("x") + (F.col("place") - F.col("lower")) * F.col("y")
    return found.select(*keys, F.when(F.col("x") == F.col("y"), F.col("x")).otherwise(between).alias(name))


def quantile(df: DataFrame, keys: list[str], value: Column, q: float, name: str) -> DataFrame:
    """(keys, name): the interpolated quantile of value, as percentile() has it. Nulls
    do not count, NaN is the largest.

    A sketch, merged task by task, brackets the quantile; values below the bracket are
    counted, those within it are counted by value, so that ties are one row. Only
    some 1/1000 of a group's distinct values come together."""
    rows = df.select(*keys, value.alias("_v")).where("_v is not null")
    off = 5 / ACCURACY
    sketch = F.percentile_approx("_v", F.array(F.lit(max(0.0, q - off)), F.lit(min(1.0, q + off))), F.lit(ACCURACY))
    ends = rows.groupBy(*keys).agg(sketch.alias("e"), F.count(F.lit(1)).alias("total"))
    # Within few values a rank is more than the margin, so all of them are counted.
    end = lambda i: F.when(F.col("total") > 2 * ACCURACY, F.col("e")[i])
    ends = ends.select(*keys, end(0).alias("lo"), end(1).alias("hi"), "total")
    near = rows.join(ends, keys).where("hi is null or _v <= hi")
    seen = F.when(F.col("lo").isNull() | (F.col("_v") >= F.col("lo")), F.col("_v"))
    counts = near.groupBy(*keys, seen.alias("_v")).agg(F.count(F.lit(1)).alias("n"), F.first("total").alias("total"))
    below = F.coalesce(F.sum(F.when(F.col("_v").isNull(), F.col("n"))).over(Window.partitionBy(*keys)), F.lit(0))
    return _at(counts.withColumn("below", below).where("_v is not null"), keys, "_v", q, name)


def median_of_whole(df: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """(keys, name): the median of whole numbers, by counting each of them."""
    counts = df.select(*keys, value.alias("_v")).where("_v is not null").groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    return _at(counts.withColumns({"total": total, "below": F.lit(0)}), keys, "_v", 0.5, name)


def ranks(df: DataFrame, keys: list[str], value: str, idx: str, slab: int, name: str = "rank") -> DataFrame:
    """df with 1-based ranks by ascending value, ties by descending idx. value takes few
    values: they are counted per slab of idx, the counts of what comes before are added
    up, and rows are ranked among their like within a slab."""
    rows = df.withColumn("_slab", F.floor(F.col(idx) / slab))
    counts = rows.groupBy(*keys, value, "_slab").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(value, F.desc("_slab")).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(*keys, value, "_slab").orderBy(F.desc(idx)))
    return rows.withColumn("_own", own).join(starts, [*keys, value, "_slab"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_before", "_own", "_slab")
