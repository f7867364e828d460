"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order, passed through up to
repeat_cap times. A document's virtual finish time is its queue's cumulative
tokens divided by the source's target; all entries are range-sorted by that time
and the prefix that fits the token budget is taken. Targets share the budget by
weight and stop at repeat_cap times the source's size, the excess being reshared.

DataFrame operations only. Nulls: null text has no tokens; the null source is a
source of its own, last in order. Documents without tokens are never taken. Rows
equal in all columns are interchangeable. An empty table gives an empty result.
Input columns named like an output are replaced, any other name is free.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._dist import hidden, numbered, running_sum, shown, spill, temporary

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, weights: tuple[float, ...], budget: float, repeat_cap: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size): one row per
    source in and out. The fill level is the largest (budget - capped sizes) /
    (weight left) that does not pass the next source's own cap."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("w", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights)) + 1))
    s = s.withColumn("cap", F.col("source_size") * float(repeat_cap)).withColumn("r", F.col("cap") / F.col("w"))
    order = Window.orderBy("r", F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    lam = (F.lit(float(budget)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    s = s.withColumn("lam", lam)
    level = F.max(F.when(F.col("lam") <= F.col("r"), F.col("lam"))).over(Window.partitionBy(F.lit(0)))
    return s.withColumn("target", F.least(F.col("w") * level, F.col("cap"))).select("source", "source_size", "target")


def mix(
    df: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    budget_share: float = 1.5,
    repeat_cap: int = 2,
    seed: int = 0,
) -> DataFrame:
    """df has id, source, size and any other columns (kept). Adds source_size,
    target and taken (tokens of this row in the mix, repeats counted)."""
    df, names = hidden(df.drop("source_size", "target", "taken"))
    kept = df.columns
    rows = df.withColumns({"source": F.col(kept[names.index("source")]), "size": F.col(kept[names.index("size")])})
    rows = rows.withColumn("_h", F.xxhash64(F.lit(seed), *kept))
    with temporary(df.sparkSession):
        queue = numbered(rows, F.col("source").asc_nulls_last(), F.col("_h"), F.rand(seed), name="queue")
        sizes = spill(queue.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
        total = sizes.agg(F.sum("source_size")).first()[0] or 0
        budget = budget_share * total
        before = Window.orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
        start = sizes.select(F.col("source").alias("_s"), F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("_start"))
        aim = source_targets(sizes, weights, budget, repeat_cap)
        plan = spill(aim.join(start, F.col("source").eqNullSafe(F.col("_s"))).drop("_s").withColumnRenamed("source", "_s"), "plan")
        rows = running_sum(queue, "size", "_cum").join(plan, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        passes = rows.withColumn("_pass", F.explode(F.sequence(F.lit(0), F.lit(repeat_cap - 1))))
        finish = F.when(
            F.col("target") > 0, (F.col("_pass") * F.col("source_size") + F.col("_cum") - F.col("_start")) / F.col("target")
        ).otherwise(F.lit(0.0))
        entries = passes.select(
            *kept, "size", "source_size", "target", finish.alias("_finish"), F.col("_part").alias("_qp"), F.col("_pos").alias("_qi"), "_pass"
        )
        queued = numbered(entries, F.col("_finish"), F.col("_qp"), F.col("_qi"), F.col("_pass"), name="finish", keep=True)
    served = running_sum(queued, "size", "_used").withColumn(
        "_take", F.when(F.col("_used") <= F.lit(budget), F.col("size")).otherwise(F.lit(0))
    )
    out = served.groupBy("_qp", "_qi").agg(
        *[F.first(c).alias(c) for c in [*kept, "source_size", "target"]], F.sum("_take").cast("long").alias("taken")
    )
    return out.select(*shown(names), "source_size", "target", "taken")


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mixed(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), budget_share: float = 1.5, repeat_cap: int = 2, seed: int = 0) -> DataFrame:
    """docs (source, text and more), each row as often as the mix takes it."""
    rows, names = hidden(docs)
    cols = rows.columns
    source, text = (F.col(cols[names.index(c)]) for c in ("source", "text"))
    rows = rows.withColumns({"_k1": F.xxhash64(*cols), "_k2": F.xxhash64(F.lit(1), *cols)})
    slim = rows.select("_k1", "_k2", source.alias("source"), word_count(text).alias("size"))
    with temporary(docs.sparkSession):
        served = mix(slim, weights, budget_share, repeat_cap, seed).where("taken > 0")
        copies = F.sum(F.expr("taken div size")).cast("int")
        plan = spill(served.groupBy("_k1", "_k2").agg(copies.alias("_copies"), F.count(F.lit(1)).alias("_rows")), "copies", keep=True)
    if plan.where("_rows > 1").limit(1).count():  # equal rows share their copies
        rows = rows.dropDuplicates(["_k1", "_k2"])
    return rows.join(plan.select("_k1", "_k2", "_copies"), ["_k1", "_k2"]).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*shown(names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    slim = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix(slim, seed=3).select("doc_id", "size", "source_size", "target", "taken")
