"""Spatial and multi-echo unwrapping: DataFrame in, DataFrame out.

Volume rows hold an image in one row per echo. Single-echo images are unwrapped
row by row where they lie (mapInArrow, no shuffle); multi-echo images are
grouped by image once. Voxel tables take one shuffle on image_id, which any
stencil on them shares. The work is sequential within an image and parallel over
images; an image's memory is some 60 bytes a voxel."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..model import Shape
from . import _kernel as K
from .slabs import dealt, runs, values_of

Options = K.Options
RESULT = "image_id long, echo int, unwrapped array<double>, region array<short>"
SINGLE = RESULT.replace("double", "float")


def _lists(batch: pa.RecordBatch, name: str, kind=float) -> list[np.ndarray | None] | None:
    """The arrays of a list column, without a Python object per value."""
    if name not in batch.schema.names:
        return None
    lists = batch.column(name)
    values = lists.values
    values = values.fill_null(False) if pa.types.is_boolean(values.type) else values
    flat, cut = values.to_numpy(zero_copy_only=False).astype(kind), lists.offsets.to_numpy()
    return [flat[lo:hi] if ok else None for lo, hi, ok in zip(cut[:-1], cut[1:], lists.is_valid().to_pylist())]


def _joined(arrays: list[np.ndarray], kind) -> pa.ListArray:
    cut = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate([np.zeros(0, kind), *arrays]).astype(kind)))


def unwrap_volumes(volumes: DataFrame, options: Options = Options(), multi_echo: bool = False) -> DataFrame:
    """RESULT rows for volumes (image_id, echo, nx, ny, nz, phase, and mag, mask,
    phase2 where they exist). With multi_echo, echo times come from options.tes
    or, if that is None, from column te; an image's echoes come together by a shuffle."""

    def solved(t: pa.RecordBatch, cut: np.ndarray) -> pa.RecordBatch:
        """Rows cut[i] to cut[i + 1] are the echoes of one image."""
        phase, mag, p2, mask = _lists(t, "phase"), _lists(t, "mag"), _lists(t, "phase2"), _lists(t, "mask", bool)
        boxes = list(zip(*[t.column(c).to_pylist() for c in ("nx", "ny", "nz")]))
        te = t.column("te").to_pylist() if "te" in t.schema.names else None
        unwrapped, regions = [], []
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
            one = lambda x: None if x is None else x[lo]
            o = replace(options, tes=options.tes or (tuple(te[lo:hi]) if multi_echo and te else None))
            mags = None if one(mag) is None else mag[lo:hi]
            u, r = K.run_image(boxes[lo], phase[lo:hi], o, mags, one(mask), one(p2))
            unwrapped += u
            regions += r
        return pa.RecordBatch.from_arrays([t.column("image_id"), t.column("echo"), _joined(unwrapped, np.float32 if options.single else np.float64), _joined(regions, np.int16)], ["image_id", "echo", "unwrapped", "region"])

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield solved(batch, np.arange(batch.num_rows + 1))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cut in runs(batches, [0]):
            for batch in t.combine_chunks().to_batches():
                yield solved(batch, cut)

    wanted = [c for c in ("image_id", "echo", "nx", "ny", "nz", "te", "phase", "mag", "mask", "phase2") if c in volumes.columns]
    slim = volumes.select(F.col("image_id").cast("long"), F.col("echo").cast("int"), *wanted[2:])
    if multi_echo:
        return dealt(slim, ["image_id"]).sortWithinPartitions("image_id", "echo").mapInArrow(together, SINGLE if options.single else RESULT)
    return slim.mapInArrow(alone, SINGLE if options.single else RESULT)


def unwrap(voxels: DataFrame, shape: Shape | None, options: Options = Options(), multi_echo: bool = False, by: tuple[str, ...] = ("image_id", "echo")) -> DataFrame:
    """voxels with unwrapped double (float in single precision) and region short. An image is one task's work,
    and many small ones come to Python together; idx orders it. Without a shape every
    group is 1-D."""
    names, keys = voxels.columns, ["image_id"] if multi_echo else list(by)
    taken = list(dict.fromkeys([*keys, *names]))
    fields = ", ".join(f"`{n}` {t}" for n, t in voxels.dtypes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cut in runs(batches, list(range(len(keys)))):
            get = lambda c, kind=float: values_of(t, c).astype(kind) if c in names else None
            phase, mag, p2, mask, te = get("phase"), get("mag"), get("phase2"), get("mask", bool), get("te")
            echo = get("echo", np.int64) if multi_echo else None
            unwrapped, regions = [], []
            for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist()):
                ends = [lo, *(lo + 1 + np.flatnonzero(echo[lo + 1 : hi] != echo[lo : hi - 1])), hi] if multi_echo else [lo, hi]
                parts = [slice(a, b) for a, b in zip(ends[:-1], ends[1:])]
                part = lambda x: None if x is None else x[parts[0]]
                o = replace(options, tes=options.tes or (None if te is None else tuple(float(te[s][0]) for s in parts)))
                box = (shape.nx, shape.ny, shape.nz) if shape else (parts[0].stop - lo, 1, 1)
                mags = None if mag is None else [mag[s] for s in parts]
                u, region = K.run_image(box, [phase[s] for s in parts], o, mags, part(mask), part(p2))
                unwrapped += u
                regions += region
            made = [np.concatenate(unwrapped).astype(np.float32 if options.single else np.float64), np.concatenate(regions).astype(np.int16)]
            for lo in range(0, t.num_rows, 65536):
                own = t.select(names).slice(lo, 65536).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([*own.columns, *[pa.array(x[lo : lo + 65536]) for x in made]], [*names, "unwrapped", "region"])

    order = [*keys, "echo", "idx"] if multi_echo else [*keys, "idx"]
    placed = dealt(voxels.select(*[F.col(f"`{c}`") for c in taken]), keys).sortWithinPartitions(*order)
    return placed.mapInArrow(rows, fields + f", unwrapped {'float' if options.single else 'double'}, region short")


def unwrap_individual(volumes: DataFrame, options: Options = Options()) -> DataFrame:
    """Every echo spatially, with its neighbour echo as second phase."""
    return unwrap_volumes(volumes, replace(options, individual=True), multi_echo=True)
