"""Sharding: Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..N-1 in key order by one range sort. A keyed Feistel network
on the smallest even-width binary domain holding N, walked until it lands below
N, permutes the numbers; position p goes to shard p mod S, slot p div S. Shard
sizes differ by at most one and any row's place is computable from its number.

Nulls and ties: null keys sort first, null text has no bytes; equal rows take
neighbouring numbers and are interchangeable; an empty table gives an empty
result; columns of the input named shard or slot are replaced, any other name is
free.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._dist import hidden, numbered, row_numbers, shown

ROUNDS = 6


def _mix(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(rows: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Where each row number of 0..n-1 goes; a bijection on 0..n-1."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    shift, mask = np.uint64(half), np.uint64((1 << half) - 1)
    keys = _mix(np.arange(ROUNDS, dtype=np.uint64) + np.uint64(seed) * np.uint64(ROUNDS))
    out = np.asarray(rows, dtype=np.uint64).copy()
    left = np.ones(len(out), dtype=bool)
    while left.any():
        x = out[left]
        hi, lo = x >> shift, x & mask
        for k in keys:
            hi, lo = lo, hi ^ (_mix(lo ^ k) & mask)
        out[left] = (hi << shift) | lo
        left[left] = out[left] >= np.uint64(n)
    return out.astype(np.int64)


def place(row: int, n: int, shards: int, seed: int = 0) -> tuple[int, int]:
    """Shard and slot of one row number, without looking at any other row."""
    p = int(permute(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def shard_rows(df: DataFrame, keys: list[str], shards: int, seed: int = 0) -> DataFrame:
    """df with shard int and slot long. keys order the rows; rows equal in all
    columns are interchangeable, so the tie-break by a hash of the rest of the
    row makes reruns agree."""
    df, names = hidden(df.drop("shard", "slot"))
    tie = df.withColumn("tie", F.xxhash64(*df.columns) if names else F.lit(0))
    order = [F.col(f"in_{names.index(k)}").asc_nulls_first() for k in keys] + [F.col("tie"), F.rand(seed)]
    rows = row_numbers(numbered(tie, *order, name="rows"))
    n = rows.agg(F.max("_row")).first()[0]
    n = 0 if n is None else n + 1

    @F.pandas_udf("long")
    def position(row: pd.Series) -> pd.Series:
        return pd.Series(permute(row.to_numpy(), n, seed))

    rows = rows.withColumn("_p", position("_row"))
    rows = rows.withColumns({"shard": (F.col("_p") % shards).cast("int"), "slot": F.expr(f"_p div {int(shards)}")})
    return rows.select(*shown(names), "shard", "slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    out = shard_rows(slim, ["doc_id", "text_crc32", "size"], 24, seed=24)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
