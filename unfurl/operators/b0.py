"""Field maps from unwrapped echoes, definitions of our own.

B0 [Hz] = 1000 / 2 pi * sum_e w_e phase_e / TE_e / sum_e w_e, TE in ms."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import phase as P

WEIGHTINGS = ("phase_snr", "phase_var", "average", "TEs", "mag", "simulated_mag")
#: Fixed value: decay time in ms of a magnitude that is not given.
DECAY = 20.0


def weight(kind: str, mag: Column, te: Column) -> Column:
    if kind not in WEIGHTINGS:
        raise ValueError(f"B0 phase weighting '{kind}' not defined!")
    return {
        "phase_snr": mag * te,
        "phase_var": mag * mag * te * te,
        "average": F.lit(1.0),
        "TEs": te,
        "mag": mag,
        "simulated_mag": F.exp(-te / DECAY),
    }[kind]


def b0_map(voxels: DataFrame, kind: str = "phase_snr", value: str = "unwrapped") -> DataFrame:
    """(image_id, idx, b0, snr) from voxels with te; without mag, exp(-TE/20)."""
    mag = F.col("mag") if "mag" in voxels.columns else F.exp(-F.col("te") / DECAY)
    w = weight(kind, mag, F.col("te"))
    df = voxels.select("image_id", "idx", w.alias("w"), (F.col(value) / F.col("te")).alias("f"), (mag * F.col("te")).alias("s"))
    total = F.sum("w")
    return df.groupBy("image_id", "idx").agg(
        (1000 / (2 * math.pi) * P.ieee_ratio(F.sum(F.col("w") * F.col("f")), total)).alias("b0"),
        P.ieee_ratio(F.sum(F.col("w") * F.col("s")), F.sqrt(F.sum(F.col("w") * F.col("w")))).alias("snr"),
    )
