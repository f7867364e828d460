"""Stencils over slabs: an image is cut along its linear index (so along z), every
slab also gets the rows at its neighbours' ends that its stencil reaches (its halo),
and slabs, not images, are what tasks hold. Small images are one slab each, and a
task works on as many of them at a time as come in an Arrow batch.

One exchange by (image, echo, slab) and one sort; nothing is collected into lists.
Rows of an image must be dense in idx. A null value is NaN, a null mask false."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Shape

KEYS = ("image_id", "echo")
#: Voxels of a slab, without its halo.
SLAB = 1 << 17
Kernel = Callable[[dict[str, np.ndarray], int, Shape], dict[str, np.ndarray]]


def length(shape: Shape, reach: int, slab: int | None = None) -> int:
    """Voxels of a slab: four times the reach at least, so that halos stay small."""
    return max(slab or SLAB, 4 * reach)


def with_halos(voxels: DataFrame, shape: Shape, reach: int, slab: int | None = None) -> DataFrame:
    """voxels with _slab; rows within reach of a neighbour come again for it."""
    n = length(shape, reach, slab)
    if shape.size <= n:
        return voxels.withColumn("_slab", F.lit(0))
    own = F.floor(F.col("idx") / n).cast("int")
    inside = F.col("idx") - own * n
    before = F.when((own > 0) & (inside < reach), own - 1)
    after = F.when((inside >= n - reach) & ((own + 1) * F.lit(n) < shape.size), own + 1)
    return voxels.withColumn("_slab", F.explode(F.array_compact(F.array(before, own, after))))


def dealt(rows: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    """rows with all of a key in one task, whatever came before. By the keys themselves
    Spark leaves this exchange out where a join below has the same one, and adaptive
    execution may then turn that join into a broadcast read task by task, which tears
    groups apart: nothing says that mapInArrow needs them whole. By a hash of the keys
    the exchange is like no join's, so it stays."""
    return rows.repartition(*([tasks] if tasks else []), F.xxhash64(*[F.col(f"`{k}`") for k in keys]))


def _codes(c) -> np.ndarray:
    """A column's values, or numbers for them, so that nulls are equal to nulls."""
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    return c.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) if c.null_count else c.to_numpy(zero_copy_only=False)


def runs(batches: Iterator[pa.RecordBatch], keys: list[int]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows of whole groups, where each starts and the last ends) of a stream that is
    sorted by keys."""
    held: list[pa.RecordBatch] = []

    def changes(t) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in keys:
            c = _codes(t.column(k))
            new[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(new)

    def whole(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(parts).combine_chunks()
        return t, np.append(changes(t), t.num_rows)

    for batch in batches:
        if not batch.num_rows:
            continue
        last = int(changes(batch)[-1])
        if last == 0 and held and all(batch.column(k)[0].as_py() == held[-1].column(k)[-1].as_py() for k in keys):
            held.append(batch)
            continue
        if held or last:
            yield whole([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield whole(held)


def values_of(t: pa.Table, name: str) -> np.ndarray:
    c = t.column(name)
    if pa.types.is_boolean(c.type):
        return c.fill_null(False).to_numpy()
    if pa.types.is_integer(c.type) and not c.null_count:
        return c.to_numpy()
    return c.cast(pa.float64()).to_numpy()


def on_slabs(
    voxels: DataFrame, shape: Shape, kernel: Kernel, outputs: str, reach: int, columns: list[str], keys: tuple[str, ...] = KEYS, keep: list[str] | None = None, slab: int | None = None
) -> DataFrame:
    """voxels (or their columns in keep) with the kernel's outputs, a DDL list. The
    kernel gets the values of columns as arrays (ranges, voxels), and the first idx."""
    names = voxels.columns if keep is None else keep
    made = [x.split() for x in outputs.split(", ")]
    taken = list(dict.fromkeys([*keys, "_slab", "idx", *names, *columns]))
    rows = with_halos(voxels, shape, reach, slab).select(*[F.col(f"`{c}`") for c in taken])
    n, key_at = length(shape, reach, slab), list(range(len(keys) + 1))
    kinds = {"short": pa.int16(), "float": pa.float32(), "double": pa.float64(), "boolean": pa.bool_(), "long": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cut in runs(batches, key_at):
            idx, number = t.column("idx").to_numpy(), t.column("_slab").to_numpy()
            values = {c: values_of(t, c) for c in columns}
            first, size = idx[cut[:-1]], np.diff(cut)
            out = {}
            kinds_of_range, which = np.unique(np.stack([first, size]), axis=1, return_inverse=True)
            for g, (lo, m) in enumerate(kinds_of_range.T.tolist()):
                starts = cut[:-1][which.ravel() == g]
                at = slice(cut[0], cut[-1]) if len(starts) == len(size) else (starts[:, None] + np.arange(m)).ravel()
                got = kernel({c: x[at].reshape(-1, m) for c, x in values.items()}, lo, shape)
                for c, x in got.items():
                    out.setdefault(c, np.zeros(len(idx), x.dtype))[at] = x.ravel()
            own = np.flatnonzero(idx // n == number)
            arrays = [pa.array(out[c][own], kinds[k]) for c, k in made]
            mine = t.select(names).take(pa.array(own)) if len(own) < len(idx) else t.select(names)
            for lo in range(0, len(own), 65536):
                part = [c.slice(lo, 65536).combine_chunks() for c in mine.columns]
                part = [c.chunk(0) if isinstance(c, pa.ChunkedArray) and c.num_chunks == 1 else c for c in part]
                yield pa.RecordBatch.from_arrays([*part, *[a.slice(lo, 65536) for a in arrays]], [*names, *[c for c, _ in made]])

    schema = ", ".join([*[f"`{f}` {t}" for f, t in voxels.select(*[F.col(f"`{c}`") for c in names]).dtypes], *[f"`{c}` {t}" for c, t in made]])
    # Slabs are dealt to all tasks; rows of small images may be gathered into few.
    tasks = int(voxels.sparkSession.conf.get("spark.sql.shuffle.partitions")) if shape.size > n else None
    placed = dealt(rows, [*keys, "_slab"], tasks).sortWithinPartitions(*keys, "_slab", "idx")
    return placed.mapInArrow(run, schema)
