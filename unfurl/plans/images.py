"""The pipeline over folders of images, all steps on executors.

The command line's options (arguments.py) are resolved once, from the headers'
distinct numbers of echoes and channels. Images then stay rows: phase and magnitude
meet by file name, masks and offsets come from aggregates and joins over volume
rows, unwrapping and quality run image by image, field maps voxel by voxel, and
results are written by the data source, one file an image. The driver sees headers
and options, never a value of an image.

Options that name one file (a mask, weights) do so for all images. What the command
line does for one image and this does not: it prints nothing, writes no settings,
and needs the same number of echoes in all images of a folder."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import phase as P
from ..model import to_volumes
from ..operators import _kernel as K
from ..operators import b0, grow, offset
from ..operators.slabs import dealt, runs
from ..operators.weights import flags_of
from ..session import cut
from ..sources import datasource, nifti
from . import arguments
from .app import VERSION

SIZE = ["nx", "ny", "nz"]


@dataclass(frozen=True)
class Plan:
    """What options mean for a folder's images."""

    settings: object
    options: K.Options
    echoes: tuple[int, ...]
    all_tes: tuple[float, ...] | None
    mode: str

    @property
    def many(self) -> bool:
        return len(self.echoes) > 1


def resolve(s, echoes: int, channels: int) -> Plan:
    mode = s.phase_offset_correction
    if (s.compute_B0 or channels > 1 or mode == "on") and mode not in ("bipolar", "off"):
        mode = "monopolar"
    if echoes == 1 or mode == "default off":
        mode = "off"
    chosen = arguments.echoes(s.unwrap_echoes, echoes)
    tes = arguments.echo_times(s.echo_times, echoes, chosen)
    if 1 < len(chosen) != len(tes):
        raise ValueError(f"Number of chosen echoes is {len(chosen)} ({echoes} in .nii data), but {len(tes)} TEs were specified!")
    if mode != "off" and len(tes) >= 2 and tes[0] == tes[1]:
        mode = "off"
    if len(chosen) > 1 and not s.echo_times:
        raise ValueError("multi-echo data is used, but no echo times are given. Please specify the echo times using the -t option.")
    every = None
    if mode != "off":
        every = tuple(arguments.echo_times(s.echo_times, echoes, None))
        if len(every) != echoes:
            raise ValueError(f"Phase offset determination requires all echo times! ({len(every)} given, {echoes} required)")
    weights = s.weights if s.weights != "default" else "default4" if s.magnitude is None else "default3"
    options = K.Options(
        weights=flags_of(weights) if set(weights) <= {"0", "1"} else weights, tes=tuple(tes), correct_global=s.correct_global, max_seeds=s.max_seeds,
        merge_regions=s.merge_regions, correct_regions=s.correct_regions, wrap_addition=s.wrap_addition, individual=s.individual_unwrapping,
        template=s.template, refine=s.temporal_uncertain_unwrapping,
    )
    return Plan(s, options, tuple(chosen), every, mode)


def read(spark: SparkSession, path: str, pixels: bool = True) -> DataFrame:
    """Volumes of a folder or file, with name, what is behind the folder, and image_id."""
    df = spark.read.format("nifti").option("pixels", str(pixels).lower()).load(path)
    head = path.rstrip("/")
    name = F.when(F.col("path") == head, F.lit("image.nii")).otherwise(F.regexp_replace(F.substring(F.col("path"), len(head) + 2, 1 << 30), "/", "__"))
    return df.withColumn("name", name).withColumn("image_id", F.xxhash64("name"))


def checked(bad: Column, message: str, value: Column) -> Column:
    return F.when(bad, F.raise_error(F.lit(message)).cast("array<double>")).otherwise(value)


def loaded(spark: SparkSession, s) -> DataFrame:
    """image_id, name, header, channel, echo, sizes, phase and, with magnitudes, mag."""
    df = read(spark, s.phase)
    if not s.no_phase_rescale:
        df = datasource.rescaled(df)
    v = F.col("values")
    if s.fix_ge_phase:
        plane = F.col("nx") * F.col("ny")
        v = F.transform(v, lambda x, i: P.wrap_full(x + math.pi * (F.floor(i / plane) % 2)))
    df = df.select("image_id", "name", "header", "channel", "echo", *SIZE, "dx", "dy", "dz", v.alias("phase"))
    if s.magnitude is None:
        return df
    mag = read(spark, s.magnitude).select("image_id", "channel", "echo", F.col("values").alias("m"))
    both = df.join(mag, ["image_id", "channel", "echo"], "left")
    wrong = F.col("m").isNull() | (F.size("m") != F.size("phase"))
    return both.withColumn("mag", checked(wrong, "size of magnitude and phase does not match!", F.col("m"))).drop("m")


def with_offsets(df: DataFrame, plan: Plan) -> DataFrame:
    """Channels combined after removing their offsets, where the mode says so."""
    if plan.mode == "off":
        return df.where("channel = 1")
    mm = arguments.smoothing(plan.settings.phase_offset_smoothing_sigma_mm)
    rows = df if "mag" in df.columns else df.withColumn("mag", F.lit(None).cast("array<double>"))
    done = offset.correct_images(rows, plan.all_tes, mm, plan.mode == "bipolar", by_size=True)
    first = df.where("channel = 1").select("image_id", "echo", "name", "header", *(["mag"] if "mag" in df.columns else []))
    out = first.withColumnRenamed("mag", "own").join(done.drop("offsets"), ["image_id", "echo"])
    if "mag" not in df.columns:
        return out.drop("mag")
    one = df.groupBy("image_id").agg(F.max("channel").alias("channels"))
    return out.join(one, "image_id").withColumn("mag", F.when(F.col("channels") > 1, F.col("mag")).otherwise(F.col("own"))).drop("own", "channels")


def robust(values: Column) -> Column:
    """Whether values exceed a tenth of the 0.95 quantile of the finite ones."""
    inside = F.array_sort(F.filter(values, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf"))))
    place = 0.95 * (F.size(inside) - 1)
    at = lambda k: F.get(inside, k.cast("int"))
    lo, hi = at(F.floor(place)), at(F.ceil(place))
    limit = 0.1 * F.when(lo == hi, lo).otherwise((F.ceil(place) - place) * lo + (place - F.floor(place)) * hi)
    return F.transform(values, lambda x: F.coalesce(~F.isnan(x) & (x > limit), F.lit(False)))


def quality(df: DataFrame, plan: Plan, weights: object = None, template: int = 1) -> DataFrame:
    """(image_id, quality): of each image's template echo, its partner being echo 2."""
    o, many = replace(plan.options, weights=plan.options.weights if weights is None else weights), plan.many
    has = [c for c in ("mag", "mask") if c in df.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cut in runs(batches, [0]):
            for batch in t.combine_chunks().to_batches():
                phase = grow._lists(batch, "phase")
                mag, mask = (grow._lists(batch, c, k) for c, k in (("mag", float), ("mask", bool)))
                boxes = list(zip(*[batch.column(c).to_pylist() for c in SIZE]))
                out = []
                for lo in cut[:-1].tolist():
                    at = lo + template - 1 if many else lo
                    one = replace(o, shape=boxes[lo], tes=(o.tes[template - 1], o.tes[1]) if many else o.tes)
                    out.append(K.voxel_quality(phase[at], one, mag and mag[at], mask and mask[lo], phase[lo + 1] if many else None))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cut[:-1])), grow._joined(out, np.float64)], ["image_id", "quality"])

    slim = dealt(df.select("image_id", "echo", *SIZE, "phase", *has), ["image_id"]).sortWithinPartitions("image_id", "echo")
    return slim.mapInArrow(run, "image_id long, quality array<double>")


def with_mask(spark: SparkSession, df: DataFrame, plan: Plan) -> DataFrame:
    """df with mask, the same for all echoes of an image, where there is one."""
    s = plan.settings
    kind = s.mask[0]
    if kind == "robustmask" and s.magnitude is None or kind == "nomask":
        return df
    if kind == "robustmask":
        own = df.where(F.col("echo") == min(s.template, len(plan.echoes))).select("image_id", robust(F.col("mag")).alias("mask"))
    elif "qualitymask" in kind:
        parts = s.mask if len(s.mask) > 1 else kind.split()
        limit = float(parts[1]) if len(parts) > 1 else 0.1
        own = quality(df, plan, template=s.template).select("image_id", F.transform("quality", lambda x: ~F.isnan(x) & (x > limit)).alias("mask"))
    elif kind.endswith((".nii", ".nii.gz")):
        one = read(spark, kind).where("channel = 1 and echo = 1").select(F.lit(0).alias("k"), F.col("values").alias("m"))
        wrong = F.size("m") != F.size("phase")
        inside = checked(wrong, "size of mask differs from that of the image", F.col("m"))
        return df.withColumn("k", F.lit(0)).join(one, "k").withColumn("mask", F.transform(inside, lambda x: x != 0)).drop("k", "m")
    else:
        raise ValueError(f"masking option '{kind}' is undefined")
    return df.join(own, "image_id")


def unwrap_images(spark: SparkSession, args: list[str]) -> dict[str, DataFrame]:
    """Results by name (unwrapped and, as options ask, mask, B0, B0_snr, quality): rows
    of image_id, name, header, echo, sizes and value."""
    datasource.register(spark)
    s = arguments.parse(args, VERSION)
    if s.mask_unwrapped and s.mask[0] == "nomask":
        s.mask[0] = "robustmask"
    kinds = read(spark, s.phase, pixels=False).select("echoes", "channels").distinct().limit(2).collect()
    if len(kinds) != 1:
        raise ValueError("images of a folder must have the same number of echoes and channels")
    plan = resolve(s, *kinds[0])
    # Files are read once, whatever is asked of them later.
    df = with_offsets(cut(loaded(spark, s)), plan)
    places = F.array(*[F.lit(e) for e in plan.echoes])
    df = df.where(F.col("echo").isin(list(plan.echoes))).withColumn("echo", F.array_position(places, F.col("echo")).cast("int"))
    df = df.withColumn("te", F.get(F.array(*[F.lit(float(t)) for t in plan.options.tes]), F.least("echo", F.lit(len(plan.options.tes))) - 1))
    df = with_mask(spark, df, plan)
    about = df.select("image_id", "echo", "name", "header", *SIZE, "te", *[c for c in ("mag", "mask") if c in df.columns])
    o = plan.options if plan.many else replace(plan.options, tes=None)
    done = grow.unwrap_volumes(df, o, plan.many).drop("region").join(about, ["image_id", "echo"])
    u = F.col("unwrapped")
    if s.threshold != math.inf:
        u = F.transform(u, lambda x: F.when(~F.isnan(x) & (F.abs(x) > s.threshold * P.TWO_PI), 0.0).otherwise(x))
    if s.mask_unwrapped and "mask" in done.columns:
        u = F.zip_with(u, "mask", lambda x, m: F.when(m, x).otherwise(0.0))
    done = done.withColumn("unwrapped", u)
    columns = ["image_id", "name", "header", "echo", *SIZE]
    out = {"unwrapped": done.select(*columns, F.col("unwrapped").alias("value"))}
    first = about.where("echo = 1").select(*columns)
    if "mask" in df.columns:
        out["mask"] = about.where("echo = 1").select(*columns, F.transform("mask", lambda m: m.cast("double")).alias("value"))
    if s.compute_B0:
        if not s.echo_times:
            raise ValueError("echo times are required for B0 calculation! Unwrapping has been performed")
        parts = ["unwrapped", *[c for c in ("mag",) if c in done.columns]]
        rows = done.select("image_id", "te", F.posexplode(F.arrays_zip(*parts)).alias("idx", "v")).select("image_id", "te", F.col("idx").cast("long").alias("idx"), "v.*")
        field = b0.b0_map(rows, s.B0_phase_weighting)
        for name, c in (("B0", "b0"), ("B0_snr", "snr")):
            out[name] = first.join(to_volumes(field, ["image_id"], c).withColumnRenamed(c, "value"), "image_id").select(*columns, "value")
    if s.write_quality:
        q = quality(done.drop("phase").withColumnRenamed("unwrapped", "phase"), plan)
        out["quality"] = first.join(q.withColumnRenamed("quality", "value"), "image_id").select(*columns, "value")
    return out


def unwrap_folder(spark: SparkSession, args: list[str]) -> None:
    """Writes every result of unwrap_images() to a folder of its name below -o."""
    target = arguments.parse(args, VERSION).output.rstrip("/")
    for name, rows in unwrap_images(spark, args).items():
        nifti.named_files(rows, "value").write.format("nifti").mode("overwrite").save(f"{target}/{name}")
