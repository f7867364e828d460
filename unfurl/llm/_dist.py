"""Shared distributed building blocks: cutting lineage in the cluster's shared
folder, numbering rows by a range sort, prefix sums and connected components."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

POS_BITS = 33


def hidden(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """df with its columns named in_0, in_1 and so on, and their old names, so that
    no column of the input can clash with one of an operator's own."""
    return df.toDF(*[f"in_{i}" for i in range(len(df.columns))]), df.columns


def shown(names: list[str]) -> list[Column]:
    """The columns that hidden() renamed, with their old names."""
    return [F.col(f"in_{i}").alias(n) for i, n in enumerate(names)]


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared scratch folder (spark.checkpoint.dir); one of our own
    only where a local session names none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="unfurl-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


_scopes = threading.local()


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables spilled inside are removed at the end, but for those kept."""
    held = _scopes.__dict__.setdefault("held", [])
    held.append([])
    try:
        yield
    finally:
        for path in held.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spill(df: DataFrame, name: str = "t", keep: bool = False) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: the lineage is
    cut, and any executor can be lost afterwards without recomputation. keep lets
    the table outlive the innermost temporary() block, whose result it is."""
    path = f"{shared_dir(df.sparkSession)}/unfurl/{name}-{uuid.uuid4().hex}"
    around = _scopes.__dict__.setdefault("held", [])[: -1 if keep else None]
    if around:
        around[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, *order: Column, name: str = "num", keep: bool = False) -> DataFrame:
    """Range-sort df by order and add _part, _pos: the range and the place in it.

    Sampled range bounds differ from run to run, so the sorted rows are written
    once; equal rows may be spread over several ranges only if order says so."""
    n = shuffle_width(df.sparkSession)
    out = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    table = spill(out.withColumn("_mid", F.monotonically_increasing_id()), name, keep)
    return table.withColumns(
        {"_part": F.shiftright("_mid", POS_BITS), "_pos": F.col("_mid").bitwiseAND((1 << POS_BITS) - 1)}
    ).drop("_mid")


def offsets(table: DataFrame, total: Column, alias: str) -> DataFrame:
    """(_part, alias): what all earlier ranges add up to. One row per range, so a
    single small task orders them and the result is safe to broadcast."""
    sums = table.groupBy("_part").agg(total.alias("_sum"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(sums.select("_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias(alias)))


def row_numbers(table: DataFrame, alias: str = "_row") -> DataFrame:
    """Dense 0-based numbers over a numbered() table."""
    return table.join(offsets(table, F.count(F.lit(1)), "_off"), "_part", "left").withColumn(
        alias, F.col("_off") + F.col("_pos")
    ).drop("_off")


def running_sum(table: DataFrame, value: str, alias: str) -> DataFrame:
    """Inclusive prefix sum of value over a numbered() table, range by range."""
    inside = Window.partitionBy("_part").orderBy("_pos").rowsBetween(Window.unboundedPreceding, 0)
    return (
        table.withColumn("_in", F.sum(value).over(inside))
        .join(offsets(table, F.sum(value), "_off"), "_part", "left")
        .withColumn(alias, F.col("_in") + F.col("_off"))
        .drop("_in", "_off")
    )


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): smallest node reachable over undirected links.

    Label propagation with pointer jumping, each round written to the shared
    folder. Every join is against a table with unique keys, so a node with very
    many links is only a skewed join side, which adaptive execution splits."""
    spark = links.sparkSession
    both = spill(
        links.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .union(links.select(F.col(b), F.col(a)))
        .where("u <> v").distinct(),
        "edges",
    )
    label = spill(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("l")).select(F.col("u").alias("node"), "l"), "labels")
    while True:
        near = both.join(label, both.v == label.node).groupBy("u").agg(F.min("l").alias("m"))
        step = label.join(near, label.node == near.u, "left").select(
            "node", F.col("l").alias("old"), F.least("l", F.coalesce("m", "l")).alias("l")
        )
        root = label.select(F.col("node").alias("r"), F.col("l").alias("rl"))
        new = spill(
            step.join(root, step.l == root.r, "left").select(
                "node", "old", F.least("l", F.coalesce("rl", "l")).alias("l")
            ),
            "labels",
        )
        if new.where("l <> old").limit(1).count() == 0:
            return new.select("node", F.col("l").alias("component"))
        label = new.select("node", "l")


def join_hot(rows: DataFrame, table: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """rows left-joined with table, whose keys are unique and whose weight counts the
    rows of a key; total counts them all.

    Keys that many rows hold, at most 4 a shuffle partition, are broadcast, so that
    no task gets all rows of one; the others meet by a shuffle. Rows of a hot or a
    null key are spread over the partitions of that shuffle, where nothing fits them."""
    limit = max(64, total // (4 * shuffle_width(rows.sparkSession)))
    values = [c for c in table.columns if c not in (key, weight)]
    hot = table.where(F.col(weight) > limit).select(F.col(key).alias("hot_key"), *[F.col(c).alias(f"hot_{c}") for c in values], F.lit(True).alias("is_hot"))
    cold = table.where(F.col(weight) <= limit).select(F.col(key).alias("cold_key"), *[F.col(c).alias(f"cold_{c}") for c in values])
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left")
    away = F.col("is_hot").isNotNull() | F.col(key).isNull()
    out = out.withColumns({"away": away, "sought": F.when(away, F.xxhash64(*rows.columns).cast(rows.schema[key].dataType)).otherwise(F.col(key))})
    out = out.join(cold, (F.col("sought") == F.col("cold_key")) & ~F.col("away"), "left")
    found = [F.when(F.col("is_hot").isNotNull(), F.col(f"hot_{c}")).otherwise(F.col(f"cold_{c}")).alias(c) for c in values]
    return out.select(*rows.columns, *found)
