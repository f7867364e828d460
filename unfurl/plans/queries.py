"""Registered queries of the phase operators and their DuckDB SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import phase as P
from ..operators import b0 as B
from ..operators import blocks, grow, masks, merging, offset, post, quality, ranks, regions, stencil, weights
from ..operators.grow import Options
from . import sql as S
from .tables import CUBE, LINE, PLANE, TES, echoes, grid, r6, series, smooth, smooth_echoes, table, vectors

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _l(c: str):
    return F.col(c).cast("long").alias(c)


# Scalars -----------------------------------------------------------------------


@query("wrap_once", f"SELECT l_orderkey, l_linenumber, {S.r6(S.once('l_extendedprice / 10000e0 - 5e0'))} AS value FROM lineitem")
def _(spark, d):
    x = F.col("l_extendedprice") / 10000.0 - 5.0
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(P.wrap_once(x)).alias("value"))


@query(
    "wrap_once_single",
    "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN x < -3.141592653589793e0 THEN x + CAST(6.283185307179586e0 AS FLOAT) WHEN x > 3.141592653589793e0 THEN x - CAST(6.283185307179586e0 AS FLOAT) ELSE x END AS DOUBLE) AS value"
    " FROM (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice / 10000e0 - 5e0 AS FLOAT) AS x FROM lineitem)",
)
def _(spark, d):
    x = F.col("l_extendedprice") / 10000.0 - 5.0
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", P.wrap_once(x, single=True).cast("double").alias("value"))


@query("wrap_full", f"SELECT l_orderkey, l_linenumber, {S.r6(S.full('l_extendedprice / 1000e0'))} AS value FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(P.wrap_full(F.col("l_extendedprice") / 1000.0)).alias("value"))


@query("unwrap_to_ref", f"SELECT l_orderkey, l_linenumber, {S.r6(S.to_ref('l_quantity', 'l_extendedprice / 1000e0'))} AS value FROM lineitem")
def _(spark, d):
    v = P.unwrap_to(F.col("l_quantity"), F.col("l_extendedprice") / 1000.0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(v).alias("value"))


@query("echo_reference", f"SELECT event_id, {S.r6('value * CAST(3e0 / 7e0 AS DOUBLE)')} AS value FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", r6(P.echo_reference(F.col("value"), 3.0, 7.0)).alias("value"))


@query("quantise", f"SELECT l_orderkey, l_linenumber, CAST({S.quantise('l_tax * 20e0 - 0.2e0')} AS BIGINT) AS w FROM lineitem")
def _(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", P.quantise(F.col("l_tax") * 20.0 - 0.2).cast("long").alias("w"))


@query(
    "edge_codec",
    "SELECT l_orderkey, l_linenumber, l_orderkey * 3 + l_linenumber % 3 AS edge, CAST(l_linenumber % 3 AS BIGINT) AS dim, l_orderkey AS voxel FROM lineitem",
)
def _(spark, d):
    e = P.edge_id(F.col("l_orderkey"), F.col("l_linenumber") % 3)
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", e.alias("edge"), P.edge_dim(e).cast("long").alias("dim"), P.edge_voxel(e).alias("voxel")
    )


# Edges, measures and weights ----------------------------------------------------


@query("edges_enumerate", S.EDGES)
def _(spark, d):
    e = stencil.edges(vectors(spark, d), CUBE, ["phase"])
    return e.select("image_id", "idx", _l("dim"), r6(F.col("left_phase") - F.col("right_phase")).alias("step"))


def _measure(name: str, flag: int, mag: bool = False, phase2: bool = False) -> None:
    def f(spark, d):
        v = weights.echo_pair(echoes(spark, d), 1, 2) if phase2 else vectors(spark, d, mag)
        q = weights.qualities(v, CUBE, [k == flag for k in range(6)], (1.0, 2.0) if phase2 else None)
        return q.select("image_id", "idx", *[r6(F.col(f"q{k}")).alias(f"q{k}") for k in (1, 2, 3)])

    query(name, S.qualities([k == flag for k in range(6)], mag, phase2))(f)


_measure("w_coherence", 0)
_measure("w_gradient", 1, phase2=True)
_measure("w_linearity", 2)
_measure("w_mag_coherence", 3, mag=True)
_measure("w_mag", 4, mag=True)
_measure("w_mag_high", 5, mag=True)


@query("maxmag_q95", f"WITH {S.VOX} SELECT image_id, {S.r6('quantile_cont(mag, 0.95)')} AS maxmag FROM vox GROUP BY image_id")
def _(spark, d):
    return weights.max_magnitude(vectors(spark, d, mag=True)).select("image_id", r6(F.col("maxmag")).alias("maxmag"))


def _weights(name: str, kind, mag: bool, phase2: bool = False, mask: bool = False) -> None:
    def f(spark, d):
        v = weights.echo_pair(echoes(spark, d, mag), 1, 2) if phase2 else vectors(spark, d, mag, mask)
        return weights.edge_weights(v, CUBE, kind, (1.0, 2.0) if phase2 else None).select("image_id", "idx", _l("w1"), _l("w2"), _l("w3"))

    flags = weights.prune(weights.flags_of(kind), mag, phase2, phase2)
    query(name, S.weights(flags, mag, phase2, mask))(f)


_weights("weights_default", "default", True)
_weights("weights_default2", "default2", True)
_weights("weights_default3", "default3", True, phase2=True)
_weights("weights_default4", "default4", True, phase2=True)
_weights("weights_default6", "default6", True, phase2=True)
_weights("weights_flags", "1010", False)
_weights("weights_masked", "default", True, mask=True)


@query("weights_user", S.USER_WEIGHTS)
def _(spark, d):
    v = vectors(spark, d)
    own = v.select("image_id", "idx", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("dim")).withColumn("w", (F.col("idx") * 3 + F.col("dim")) % 256)
    return weights.edge_weights(v, CUBE, user=own).select("image_id", "idx", _l("w1"), _l("w2"), _l("w3"))


@query("second_difference", S.second_difference())
def _(spark, d):
    return weights.second_difference(vectors(spark, d), CUBE).select("image_id", "idx", r6(F.col("d")).alias("d"))


@query("weights_bestpath", S.bestpath())
def _(spark, d):
    return weights.edge_weights(vectors(spark, d), CUBE, "bestpath").select("image_id", "idx", _l("w1"), _l("w2"), _l("w3"))


@query("seed_order", S.seed_order())
def _(spark, d):
    w = weights.edge_weights(vectors(spark, d, mag=True), CUBE)
    return regions.seed_order(w).select("image_id", "idx", _l("seed_sum"), _l("rank"))


@query("seed_correction", S.SEED_CORRECTION)
def _(spark, d):
    v = weights.echo_pair(echoes(spark, d), 1, 2)
    return v.select("image_id", "idx", regions.seed_offset(F.col("phase"), F.col("phase2"), 1.0, 2.0).cast("long").alias("off1"))


# Unwrapping ---------------------------------------------------------------------


@query("unwrap_1d", S.unwrap_1d())
def _(spark, d):
    return grow.unwrap(vectors(spark, d), LINE).select("image_id", "idx", r6(F.col("unwrapped")).alias("unwrapped"), _l("region"))


@query("unwrap_1d_events", S.unwrap_1d(events=True))
def _(spark, d):
    return grow.unwrap(series(spark, d), None).select("image_id", "idx", r6(F.col("unwrapped")).alias("unwrapped"), _l("region"))


def _field(name: str, nx: int, ny: int | None) -> None:
    def f(spark, d):
        v, shape = grid(spark, d, nx, ny)
        u = grow.unwrap(v, shape)
        first = u.where("idx = 0").select((F.col("truth") - F.col("unwrapped")).alias("shift"))
        return u.crossJoin(F.broadcast(first)).select("idx", r6(F.col("unwrapped") + F.col("shift")).alias("value"))

    query(name, S.field(nx, ny))(f)


_field("unwrap_2d_field", 40, None)
_field("unwrap_3d_field", 10, 10)


def _risen(df: DataFrame, *more) -> DataFrame:
    """How far each voxel lies over its image's first one, which the field tells
    however many wraps the whole image is off."""
    first = F.first("unwrapped").over(Window.partitionBy("image_id", "echo").orderBy("idx"))
    return df.select("image_id", *more, "idx", r6(F.col("unwrapped") - first).alias("rise"))


def _spatial(name: str, shape, options: Options, mag: bool = False) -> None:
    query(name, S.rise(shape))(lambda spark, d: _risen(grow.unwrap(smooth(spark, d, shape, mag=mag), shape, options)))


_spatial("unwrap_2d_congruence", PLANE, Options())
_spatial("unwrap_3d_congruence", CUBE, Options(), mag=True)
_spatial("unwrap_bestpath", CUBE, Options(weights="bestpath"))
_spatial("merge_regions", CUBE, Options(max_seeds=20, merge_regions=True))
_spatial("wrap_addition", CUBE, Options(wrap_addition=0.5))


@query("regions_multi_seed", S.regions_multi_seed())
def _(spark, d):
    """Whatever its seeds: all voxels are reached, and inside a region steps are the field's."""
    u = grow.unwrap(smooth(spark, d, CUBE), CUBE, Options(max_seeds=20))
    w = Window.partitionBy("image_id", "region").orderBy("idx")
    off = F.col("unwrapped") - F.col("truth")
    u = u.withColumn("same", F.abs(off - F.first(off).over(w)) < 1e-6)
    return u.groupBy("image_id").agg(
        F.count(F.when(F.col("region") > 0, 1)).alias("reached"), F.count(F.when(F.col("same"), 1)).alias("as_field"), r6(F.sum(F.col("unwrapped") - F.col("phase") - P.TWO_PI * F.rint((F.col("unwrapped") - F.col("phase")) / P.TWO_PI))).alias("residue")
    )


@query("unwrap_volumes", S.unwrap_1d(region=False))
def _(spark, d):
    e = table(spark, d, "embeddings").select(
        F.col("vec_id").cast("long").alias("image_id"),
        F.lit(1).alias("echo"),
        *[F.lit(n).alias(c) for c, n in (("nx", 64), ("ny", 1), ("nz", 1))],
        F.transform("embedding", lambda v: P.wrap_full(12 * v.cast("double"))).alias("phase"),
    )
    u = grow.unwrap_volumes(e).select("image_id", F.posexplode("unwrapped").alias("idx", "unwrapped"))
    return u.select("image_id", _l("idx"), r6(F.col("unwrapped")).alias("unwrapped"))


def _multi(name: str, options: Options) -> None:
    query(name, S.rise(CUBE, echoes=True))(lambda spark, d: _risen(grow.unwrap(smooth_echoes(spark, d, CUBE), CUBE, options, multi_echo=True), _l("echo")))


_multi("unwrap_4d", Options(refine=0.0))
_multi("temporal_refine", Options(refine=0.5))
_multi("unwrap_template_2", Options(template=2))
_multi("unwrap_individual", Options(individual=True))


#: Weights of the caller's own in one dimension: the seed is the last voxel but one,
#: whose edge to the end comes first, so growth is the same for every phase. Every
#: eighth edge is so bad that new seeds are tried before it.
EVEN = np.full((64, 3), 50, np.uint8)
BARRED = np.where(np.arange(64)[:, None] % 8 == 7, 200, np.full((64, 3), 100)).astype(np.uint8)


@query("line_single", S.line_single())
def _(spark, d):
    """Bit by bit in single precision, and so are the phases."""
    v = vectors(spark, d).withColumn("phase", F.col("phase").cast("float"))
    u = grow.unwrap(v, LINE, Options(weights=EVEN, single=True))
    return u.select("image_id", "idx", F.col("unwrapped").cast("double").alias("unwrapped"))


def _line(name: str, sql: str, options: Options, multi: bool = False, region: bool = False) -> None:
    """Queries on steps that jump at random, where every option changes the result."""

    def f(spark, d):
        u = grow.unwrap(echoes(spark, d) if multi else vectors(spark, d), LINE, options, multi_echo=multi)
        more = [_l("echo")] if multi else [_l("region")] if region else []
        return u.select("image_id", *more, "idx", r6(F.col("unwrapped")).alias("unwrapped"))

    query(name, sql)(f)


_line("line_wrap_addition", S.line_wrap_addition(), Options(weights=EVEN, wrap_addition=1.0))
_line("line_seeds", S.line_seeds(), Options(weights=BARRED, max_seeds=20), region=True)
_line("line_merged", S.line_seeds(merged=True), Options(weights=BARRED, max_seeds=20, merge_regions=True), region=True)
_line("line_one_seed", S.line_seeds(one=True), Options(weights=BARRED), region=True)
_line("line_template_1", S.line_echoes("template 1"), Options(weights=EVEN, refine=0.0), multi=True)
_line("line_template_2", S.line_echoes("template 2"), Options(weights=EVEN, refine=0.0, template=2), multi=True)
_line("line_individual", S.line_echoes("individual"), Options(weights=EVEN, individual=True), multi=True)
_line("line_refined", S.line_refined(), Options(weights=EVEN, refine=0.06), multi=True)


# Regions and corrections --------------------------------------------------------


def _labelled(spark, d) -> DataFrame:
    w = weights.edge_weights(vectors(spark, d, mag=True), CUBE)
    return w.withColumn("region", (F.floor((F.col("idx") % 4) / 2) + 1 + 2 * F.floor(F.col("idx") / 32)).cast("short")).withColumn("unwrapped", F.col("phase"))


@query("region_sizes", S.region_sizes())
def _(spark, d):
    return regions.region_sizes(_labelled(spark, d)).select("image_id", _l("region"), "size")


@query("region_offsets", S.region_offsets())
def _(spark, d):
    o = regions.region_offsets(_labelled(spark, d), CUBE)
    return o.select("image_id", _l("ri"), _l("rj"), r6(F.col("offset_sum")).alias("offset_sum"), "weight_sum")


def _uneven(spark, d) -> DataFrame:
    """Eight boxes of different sizes as regions, each some wraps off."""
    x, y, z = CUBE.coordinates(F.col("idx"))
    region = 1 + (x >= 1).cast("int") + 2 * (y >= 2).cast("int") + 4 * (z >= 3).cast("int")
    w = weights.edge_weights(vectors(spark, d, mag=True), CUBE).withColumn("region", region.cast("short"))
    return w.withColumn("unwrapped", F.col("phase") + P.TWO_PI * ((F.col("region") * 5 + F.col("image_id")) % 4))


@query("merge_table", S.merge_table())
def _(spark, d):
    v = _uneven(spark, d)
    m = merging.merges(regions.region_offsets(v, CUBE), regions.region_sizes(v))
    return m.select("image_id", _l("region"), _l("merged"), _l("wraps"), "root")


@query("merge_voxels", S.merge_table(voxels=True))
def _(spark, d):
    m = merging.merge_regions(_uneven(spark, d), CUBE)
    return m.select("image_id", "idx", _l("region"), r6(F.col("unwrapped")).alias("value"))


@query("unwrap_blocks", S.rise(CUBE))
def _(spark, d):
    return _risen(blocks.unwrap_blocks(smooth(spark, d, CUBE), CUBE, block=16))


@query("unwrap_blocks_field", S.field(10, 10))
def _(spark, d):
    """One image, whose blocks are grown by different tasks."""
    v, shape = grid(spark, d, 10, 10)
    u = blocks.unwrap_blocks(v, shape, block=500)
    first = u.where("idx = 0").select((F.col("truth") - F.col("unwrapped")).alias("shift"))
    return u.crossJoin(F.broadcast(first)).select("idx", r6(F.col("unwrapped") + F.col("shift")).alias("value"))


@query("quantile_exact", f"SELECT l_returnflag, {S.r6('quantile_cont(l_extendedprice, 0.37)')} AS q, {S.r6('median(round_even(l_quantity / 3e0, 0))')} AS m FROM lineitem GROUP BY 1")
def _(spark, d):
    t = table(spark, d, "lineitem")
    q = ranks.quantile(t, ["l_returnflag"], F.col("l_extendedprice"), 0.37, "q")
    m = ranks.median_of_whole(t, ["l_returnflag"], F.rint(F.col("l_quantity") / 3.0), "m")
    return q.join(m, "l_returnflag").select("l_returnflag", r6(F.col("q")).alias("q"), r6(F.col("m")).alias("m"))


@query("correct_regions", S.correct_regions())
def _(spark, d):
    v = _labelled(spark, d).withColumn("unwrapped", F.col("phase") + P.TWO_PI * F.col("region"))
    return regions.correct_regions(v).select("image_id", "idx", r6(F.col("unwrapped")).alias("value"))


@query("global_correction", S.GLOBAL)
def _(spark, d):
    v = vectors(spark, d).withColumn("unwrapped", F.col("phase") + P.TWO_PI * (F.col("image_id") % 5))
    return post.correct_global(v).select("image_id", "idx", r6(F.col("unwrapped")).alias("value"))


def _wide(df: DataFrame) -> DataFrame:
    return df.select("image_id", "idx", *[r6(F.col(f"e{e}")).alias(f"e{e}") for e in (1, 2, 3)])


@query("temporal_unwrap", S.temporal(1))
def _(spark, d):
    return _wide(post.temporal_unwrap(post.by_echo(echoes(spark, d), 3, "phase"), TES, 1))


@query("temporal_unwrap_template_2", S.temporal(2))
def _(spark, d):
    return _wide(post.temporal_unwrap(post.by_echo(echoes(spark, d), 3, "phase"), TES, 2))


@query("multi_echo_wrap_fix", S.MULTI_ECHO)
def _(spark, d):
    return _wide(post.correct_echoes(post.by_echo(echoes(spark, d), 3, "phase"), TES))


# Quality, masks, thresholds -----------------------------------------------------


@query("voxel_quality", S.quality([True, False, True, True, False, False], mag=True))
def _(spark, d):
    return quality.voxel_quality(vectors(spark, d, mag=True), CUBE).select("image_id", "idx", r6(F.col("quality")).alias("quality"))


@query("voxel_quality_4d", S.quality([True, True, True, False, False, False], phase2=True))
def _(spark, d):
    return quality.voxel_quality_4d(echoes(spark, d), CUBE, TES).select("image_id", "idx", r6(F.col("quality")).alias("quality"))


@query("unwrapped_quality", S.quality([True, True, True, False, False, False], phase2=True, half=True))
def _(spark, d):
    q = quality.unwrapped_quality(weights.echo_pair(echoes(spark, d), 1, 2), CUBE)
    return q.select("image_id", "idx", r6(F.col("quality")).alias("quality"))


@query("boundary_edges", S.BOUNDARY)
def _(spark, d):
    v = vectors(spark, d).withColumn("visited", (F.col("idx") * 5 + F.col("image_id")) % 3 == 0)
    return regions.boundary_edges(v, CUBE).select("image_id", "idx", _l("dim"), "edge")


@query("quality_per_flag", S.quality_per_flag())
def _(spark, d):
    maps = quality.quality_per_flag(vectors(spark, d, mag=True), CUBE)
    parts = [m.select("image_id", "idx", F.lit(k).cast("long").alias("flag"), r6(F.col("quality")).alias("quality")) for k, m in maps.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("quality_skipped", S.quality_skipped())
def _(spark, d):
    return quality.interior_is_one(quality.voxel_quality(vectors(spark, d), CUBE, "01"), CUBE)


@query("threshold_wraps", f"SELECT event_id, {S.r6('CASE WHEN abs(value - 250e0) > 20e0 * 6.283185307179586e0 THEN 0e0 ELSE value - 250e0 END')} AS value FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", r6(post.threshold(F.col("value") - 250.0, 20.0)).alias("value"))


@query("mask_apply", f"WITH {S.VOX} SELECT image_id, idx, {S.r6('CASE WHEN mask THEN phase ELSE 0e0 END')} AS value FROM vox")
def _(spark, d):
    return vectors(spark, d, mask=True).select("image_id", "idx", r6(post.masked(F.col("phase"), F.col("mask"))).alias("value"))


@query("echo_select", f"WITH {S.VOX}, {S.ECHOES} SELECT image_id, CAST(echo AS BIGINT) AS echo, idx, {S.r6('phase')} AS phase FROM ech WHERE echo IN (1, 3)")
def _(spark, d):
    return post.select_echoes(echoes(spark, d), [1, 3]).select("image_id", _l("echo"), "idx", r6(F.col("phase")).alias("phase"))


@query("mask_quality", S.mask_quality())
def _(spark, d):
    q = quality.voxel_quality(vectors(spark, d, mag=True), CUBE)
    return masks.robust_mask(q.withColumn("quality", r6(F.col("quality"))), "quality", 0.4).select("image_id", "idx", "mask")


@query(
    "mask_robust",
    f"WITH {S.VOX}, q AS (SELECT image_id, 0.1e0 * quantile_cont(mag, 0.95) AS lim FROM vox GROUP BY image_id)"
    " SELECT image_id, idx, mag > lim AS mask FROM vox JOIN q USING (image_id)",
)
def _(spark, d):
    return masks.robust_mask(vectors(spark, d, mag=True)).select("image_id", "idx", "mask")


@query("mask_from_table", f"WITH {S.VOX} SELECT image_id, idx, (idx + image_id) % 3 <> 0 AS mask FROM vox")
def _(spark, d):
    v = vectors(spark, d)
    return masks.mask_from(v, v.select("image_id", "idx", ((F.col("idx") + F.col("image_id")) % 3).alias("mask"))).select("image_id", "idx", "mask")


# Field maps, offsets ------------------------------------------------------------


def _b0(kind: str) -> None:
    def f(spark, d):
        e = echoes(spark, d, mag=True)
        wide = post.temporal_unwrap(post.by_echo(e, 3, "phase"), TES, 1)
        u = wide.select("image_id", "idx", F.explode(F.array(*[F.struct(F.lit(i).alias("echo"), F.col(f"e{i}").alias("unwrapped")) for i in (1, 2, 3)])).alias("u"))
        b = B.b0_map(e.join(u.select("image_id", "idx", "u.*"), ["image_id", "idx", "echo"]), kind)
        return b.select("image_id", "idx", r6(F.col("b0")).alias("b0"), r6(F.col("snr")).alias("snr"))

    query(f"b0_map_{kind.lower()}", S.b0(kind))(f)


for _kind in B.WEIGHTINGS:
    _b0(_kind)


def _coils(spark, d) -> DataFrame:
    e = echoes(spark, d, mag=True)
    return e.withColumn("channel", (F.col("image_id") % 2 + 1).cast("int")).withColumn("image_id", F.floor(F.col("image_id") / 2))


@query("hip_phase_diff", S.HIP)
def _(spark, d):
    h = offset.phase_difference(_coils(spark, d))
    return h.select("image_id", "idx", r6(F.col("hip")).alias("hip"), r6(F.col("weight")).alias("weight"))


@query("coil_combine", S.COILS)
def _(spark, d):
    v = _coils(spark, d)
    o = v.where("echo = 1").select("image_id", "channel", "idx", (0.1 * F.col("channel") + 0.01 * F.col("idx")).alias("offset"))
    c = offset.combine_channels(v, o)
    return c.select("image_id", _l("echo"), "idx", r6(F.col("phase")).alias("phase"), r6(F.col("mag")).alias("mag"))


SIGMA = (0.8, 1.1, 0.6)


@query("smooth_slabs", S.smooth(SIGMA))
def _(spark, d):
    v = vectors(spark, d, mag=True)
    z = v.select("image_id", "idx", (F.col("mag") * F.cos("phase")).alias("re"), (F.col("mag") * F.sin("phase")).alias("im"))
    out = offset.smooth_voxels(z, CUBE, SIGMA, slab=16)
    return out.select("image_id", "idx", r6(F.col("re")).alias("re"), r6(F.col("im")).alias("im"))


@query("voxels_round_trip", "SELECT vec_id AS image_id, CAST(64 AS BIGINT) AS n, true AS equal FROM embeddings")
def _(spark, d):
    from ..model import to_volumes, to_voxels

    e = table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("image_id"), F.lit(1).alias("echo"), F.col("embedding").alias("phase"))
    back = to_volumes(to_voxels(e), ["image_id", "echo"], "phase").withColumnRenamed("phase", "again")
    return e.join(back, ["image_id", "echo"]).select("image_id", F.size("again").cast("long").alias("n"), (F.col("again") == F.col("phase")).alias("equal"))
