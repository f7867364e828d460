"""Voxel views over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import phase as P
from ..model import Shape

LINE, PLANE, CUBE = Shape(64), Shape(8, 8), Shape(4, 4, 4)
TES = [1.0, 2.0, 3.0]


def r6(x: Column) -> Column:
    """Six decimals, never -0.0, the same in any engine."""
    return F.rint(x.cast("double") * 1e6) / 1e6 + F.lit(0.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str, mag: bool = False, mask: bool = False) -> DataFrame:
    """image_id, echo, idx, phase of every vector; the magnitude is the next
    vector's, the mask leaves out every fifth voxel."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    if mag:
        nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
        e = e.join(nxt, "vec_id", "left").withColumn("other", F.coalesce("other", "embedding"))
    rows = e.select("*", F.posexplode("embedding").alias("i", "v"))
    cols = [
        F.col("vec_id").cast("long").alias("image_id"),
        F.lit(1).alias("echo"),
        F.col("i").cast("long").alias("idx"),
        P.wrap_full(12 * F.col("v").cast("double")).alias("phase"),
    ]
    if mag:
        cols.append((F.abs(F.element_at("other", F.col("i") + 1).cast("double")) + 0.01).alias("mag"))
    if mask:
        cols.append(((F.col("i") * 7 + F.col("vec_id")) % 5 != 0).alias("mask"))
    return rows.select(*cols)


def echoes(spark: SparkSession, sf_dir: str, mag: bool = False) -> DataFrame:
    """Vectors taken three at a time as echoes of one image; complete ones only.
    Has te, equal to the echo number."""
    v = vectors(spark, sf_dir, mag)
    kept = table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 3).alias("image")).agg(F.count(F.lit(1)).alias("k")).where("k = 3")
    out = v.withColumn("image", F.floor(F.col("image_id") / 3)).withColumn("echo", (F.col("image_id") % 3 + 1).cast("int"))
    out = out.join(kept.select("image"), "image", "left_semi")
    return out.drop("image_id").withColumnRenamed("image", "image_id").withColumn("te", F.col("echo").cast("double"))


#: Steps of the smooth fields along x, y and z, and the vectors' share in them. No
#: step of the field of a third echo reaches pi, so its unwrapping is unique.
SMOOTH = (0.7, -0.5, 0.6, 0.1)


def smooth(spark: SparkSession, sf_dir: str, shape: Shape, scale: float = 3.0, mag: bool = False) -> DataFrame:
    """vectors() with truth, scale times a field whose neighbours differ by less
    than pi, and its wrapped phase."""
    gx, gy, gz, share = SMOOTH
    x, y, z = shape.coordinates(F.col("idx"))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("image_id"), F.posexplode("embedding").alias("idx", "v"))
    e = e.withColumns({"idx": F.col("idx").cast("long"), "echo": F.lit(1)})
    truth = scale * (gx * x + gy * y + gz * z + share * F.col("v").cast("double"))
    df = e.withColumn("truth", truth).withColumn("phase", P.wrap_full(F.col("truth"))).drop("v")
    return df.withColumn("mag", 1.0 + (F.col("idx") % 3)) if mag else df


def smooth_echoes(spark: SparkSession, sf_dir: str, shape: Shape) -> DataFrame:
    """The smooth field of every vector at three echoes, te being 1, 2 and 3."""
    df = smooth(spark, sf_dir, shape, 1.0).withColumn("echo", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])))
    df = df.withColumn("te", F.col("echo").cast("double")).withColumn("truth", F.col("truth") * F.col("te"))
    return df.withColumn("phase", P.wrap_full(F.col("truth")))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's event values in order as a 1-D image, of two events at least."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id")
    rows = e.select(
        F.col("user_id").cast("long").alias("image_id"),
        F.lit(1).alias("echo"),
        (F.row_number().over(w.orderBy("ts", "event_id")) - 1).cast("long").alias("idx"),
        P.wrap_full(F.col("value")).alias("phase"),
        F.count(F.lit(1)).over(w).alias("n"),
    )
    return rows.where("n > 1").drop("n")


def grid(spark: SparkSession, sf_dir: str, nx: int, ny: int | None = None) -> tuple[DataFrame, Shape]:
    """One image over the part keys, with its true phase: a plane of nx columns,
    or a box of nx * ny planes. Keys are dense and a multiple of the plane."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("idx"))
    n = part.count()
    shape = Shape(nx, n // nx) if ny is None else Shape(nx, ny, n // (nx * ny))
    x, y, z = shape.coordinates(F.col("idx"))
    truth = 0.02 * x * x + 0.9 * x - 1.3 * y if ny is None else 0.1 * x * x - 2.0 * y + 2.0 * z
    df = part.select(F.lit(0).cast("long").alias("image_id"), F.lit(1).alias("echo"), F.col("idx").cast("long").alias("idx"), truth.alias("truth"))
    return df.withColumn("phase", P.wrap_full(F.col("truth"))), shape
