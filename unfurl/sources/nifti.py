"""NIfTI-1 files by the public header layout: parse, write, read into Spark.

Files are read through Spark's binaryFile source, so any store Spark knows works;
each file becomes one row per 3-D volume (image_id, channel, echo)."""

from __future__ import annotations

import gzip
import math
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed codes of the format.
DTYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4", 1024: "i8", 1280: "u8"}
CODES = {np.dtype(v): k for k, v in DTYPES.items()}
HEADER = 348


@dataclass
class Image:
    """data is x, y, z, echo, channel as far as there are dimensions."""

    data: np.ndarray
    pixdim: tuple[float, ...]
    header: bytes


def parse(raw: bytes, scaled: bool = True) -> Image:
    if raw[:2] == b"\x1f\x8b":
        raw = gzip.decompress(raw)
    order = "<" if struct.unpack_from("<i", raw)[0] == HEADER else ">"
    if struct.unpack_from(order + "i", raw)[0] != HEADER or raw[344:347] not in (b"n+1", b"ni1"):
        raise ValueError("not a NIfTI-1 file")
    dim = struct.unpack_from(order + "8h", raw, 40)
    code = struct.unpack_from(order + "h", raw, 70)[0]
    if code not in DTYPES:
        raise ValueError(f"NIfTI data type {code} is not supported")
    pixdim = struct.unpack_from(order + "8f", raw, 76)
    offset, slope, inter = struct.unpack_from(order + "3f", raw, 108)
    shape = tuple(max(1, d) for d in dim[1 : dim[0] + 1])
    kind = np.dtype(order + DTYPES[code])
    data = np.frombuffer(raw, kind, int(np.prod(shape)), int(offset)).reshape(shape, order="F")
    if scaled and slope not in (0.0, 1.0) or scaled and slope == 1.0 and inter:
        data = data * np.float64(slope) + np.float64(inter)
    return Image(data, pixdim, raw[:HEADER])


def encode(data: np.ndarray, header: bytes | None = None, gz: bool = False) -> bytes:
    """A single-file image; the header's geometry is kept, its type, size and
    scaling are replaced."""
    data = np.asarray(data)
    data = data.astype(np.uint8) if data.dtype == bool else data
    if data.dtype.newbyteorder("=") not in CODES:
        data = data.astype(np.float64)
    h = bytearray(header or bytes(HEADER))
    order = "<" if not header or struct.unpack_from("<i", header)[0] == HEADER else ">"
    struct.pack_into(order + "i", h, 0, HEADER)
    dim = [data.ndim, *data.shape, *[1] * (7 - data.ndim)]
    struct.pack_into(order + "8h", h, 40, *dim)
    struct.pack_into(order + "2h", h, 70, CODES[data.dtype.newbyteorder("=")], data.dtype.itemsize * 8)
    if not header:
        struct.pack_into(order + "8f", h, 76, *[1.0] * 8)
    struct.pack_into(order + "3f", h, 108, float(HEADER + 4), 1.0, 0.0)
    h[344:348] = b"n+1\0"
    body = bytes(h) + b"\0" * 4 + data.astype(data.dtype.newbyteorder(order)).tobytes(order="F")
    return gzip.compress(body) if gz else body


def read_bytes(spark: SparkSession, path: str) -> bytes:
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def write(path: str, data: np.ndarray, header: bytes | None = None) -> None:
    with open(path, "wb") as f:
        f.write(encode(data, header, path.endswith(".gz")))


def rescale_phase(data: np.ndarray) -> np.ndarray:
    """Linear map of the finite range to [-pi, pi], unless it spans 2 pi already
    (within 1 %) or nothing; a definition of our own."""
    data = data.astype(np.float64)
    finite = data[np.isfinite(data)]
    if not len(finite) or finite.min() == finite.max():
        return data
    lo, hi = finite.min(), finite.max()
    if abs(hi - lo - 2 * math.pi) < 0.02 * math.pi:
        return data
    return (data - lo) / (hi - lo) * 2 * math.pi - math.pi


def fix_slices(data: np.ndarray) -> np.ndarray:
    """Undoes a jump of pi on every second slice; a definition of our own."""
    z = np.arange(data.shape[2]) if data.ndim > 2 else np.zeros(1)
    jump = (math.pi * (z % 2)).reshape((1, 1, -1) + (1,) * max(data.ndim - 3, 0))
    out = data + (jump if data.ndim > 2 else 0)
    return out - 2 * math.pi * np.rint(out / (2 * math.pi))


ROW = "path string, channel int, echo int, nx int, ny int, nz int, dx double, dy double, dz double, values array<double>"


def read_volumes(spark: SparkSession, paths: str | list[str], phase: bool = False) -> DataFrame:
    """One row per volume of every file; phase rescales each file to [-pi, pi]."""

    def rows(batches):
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                im = parse(bytes(content))
                data = rescale_phase(im.data) if phase else im.data.astype(np.float64)
                data = data.reshape(data.shape + (1,) * (5 - data.ndim), order="F")
                nx, ny, nz, echoes, channels = data.shape
                for c in range(channels):
                    for e in range(echoes):
                        yield pd.DataFrame(
                            [(path, c + 1, e + 1, nx, ny, nz, *map(float, im.pixdim[1:4]), data[:, :, :, e, c].ravel(order="F"))],
                            columns=[x.split()[0] for x in ROW.split(", ")],
                        )

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(rows, ROW)


def write_files(volumes: DataFrame, value: str, folder: str, prefix: str = "image", gz: bool = False) -> list[str]:
    """Writes one file per image from the executors and returns the paths. folder
    is one that all executors share. A file appears under its name only when it is
    whole, so a task that runs twice leaves the same file."""

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
                part = f"{path}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(content)
                os.replace(part, path)
            yield pdf[["path"]]

    if "://" in folder and not folder.startswith("file://"):
        raise ValueError("write_files writes to a shared mount; use format nifti for other stores")
    files = to_files(volumes, value, folder.removeprefix("file://"), prefix, gz)
    return sorted(r.path for r in files.mapInPandas(save, "path string").collect())


def named_files(volumes: DataFrame, value: str, prefix: str = "image", gz: bool = False) -> DataFrame:
    """(name, content) per image, as format "nifti" writes them."""
    files = to_files(volumes, value, "", prefix, gz)
    return files.select(F.ltrim("path", F.lit("/")).alias("name"), "content")


def to_files(volumes: DataFrame, value: str, folder: str, prefix: str = "image", gz: bool = False) -> DataFrame:
    """(path, content) per image: echoes stacked in the fourth dimension. The
    caller writes content wherever it wants; an image is one row. Columns name and
    header, where there are any, say what the file is called and its geometry."""

    def image(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("echo")
        shape = tuple(int(pdf[c].iloc[0]) for c in ("nx", "ny", "nz"))
        data = np.stack([np.asarray(v).reshape(shape, order="F") for v in pdf[value]], axis=3)
        own = pdf["name"].iloc[0] if "name" in pdf.columns else f"{prefix}_{pdf['image_id'].iloc[0]}.nii" + (".gz" if gz else "")
        header = bytes(pdf["header"].iloc[0]) if "header" in pdf.columns else None
        packed = gz or own.endswith(".gz")
        return pd.DataFrame({"path": [f"{folder}/{own}"], "content": [encode(data[..., 0] if data.shape[3] == 1 else data, header, packed)]})

    more = [c for c in ("name", "header") if c in volumes.columns]
    return volumes.select("image_id", "echo", "nx", "ny", "nz", *more, F.col(value)).groupBy("image_id").applyInPandas(image, "path string, content binary")
