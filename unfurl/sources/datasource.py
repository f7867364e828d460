"""NIfTI as a Spark data source: spark.read.format("nifti") and df.write.format("nifti").

Reading gives one row per volume of every file (path, channel, echo, sizes, values).
Headers alone are read to plan; every volume is a partition of its own, and equality
and IN filters on path, channel and echo drop partitions, so the bytes of other
echoes are not read. With option pixels=false values are null and nothing but
headers is read. bytes_read says what was fetched for a row. A compressed file has
to be read up to the volume's end. Spark keeps what was pushed with the loaded frame, so
branches of one query with different filters on it need a load each, or a checkpoint.

Writing takes rows (name, content), as nifti.to_files() makes them. Tasks write into
a folder of the job beside the target; on commit the driver moves each file to its
name, and on abort removes that folder, so a failed job leaves no file and a task
that runs twice leaves one.

Paths are those of pyarrow.fs (local, hdfs, s3, gs): a Python source has no access to
the JVM's file systems. Files elsewhere are read by nifti.read_volumes(), which goes
through Spark's own binary source."""

from __future__ import annotations

import gzip
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from ..functions import phase as P
from .nifti import DTYPES, HEADER

SCHEMA = (
    "path string, channel int, echo int, nx int, ny int, nz int, dx double, dy double, dz double,"
    " echoes int, channels int, header binary, bytes_read long, values array<double>"
)
PRUNED = ("path", "channel", "echo")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri("file://" + path.removeprefix("file:") if path.startswith("file:/") and not path.startswith("file://") else path)


def listed(path: str) -> list[str]:
    """The files at a path: itself, or those in the folder that are images."""
    fs, at = opened(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [path]
    found = fs.get_file_info(pafs.FileSelector(at, recursive=True))
    head = path.rstrip("/")
    names = [f.path for f in found if f.type == pafs.FileType.File and f.path.endswith((".nii", ".nii.gz"))]
    return sorted(head + "/" + n.rstrip("/").removeprefix(at.rstrip("/") + "/") for n in names if "/_" not in n.removeprefix(at))


@dataclass
class Header:
    """What a header says, and how values lie in the file."""

    shape: tuple[int, ...]
    pixdim: tuple[float, ...]
    kind: str
    offset: int
    slope: float
    inter: float
    raw: bytes

    @classmethod
    def read(cls, path: str) -> Header:
        fs, at = opened(path)
        with fs.open_input_stream(at, compression=None) as f:
            raw = f.read(HEADER)
            if raw[:2] == b"\x1f\x8b":
                raw = gzip.GzipFile(fileobj=fs.open_input_stream(at, compression=None)).read(HEADER)
        order = "<" if len(raw) == HEADER and struct.unpack_from("<i", raw)[0] == HEADER else ">"
        if len(raw) < HEADER or struct.unpack_from(order + "i", raw)[0] != HEADER or raw[344:347] not in (b"n+1", b"ni1"):
            raise ValueError(f"not a NIfTI-1 file: {path}")
        dim, code = struct.unpack_from(order + "8h", raw, 40), struct.unpack_from(order + "h", raw, 70)[0]
        if code not in DTYPES:
            raise ValueError(f"NIfTI data type {code} is not supported: {path}")
        shape = tuple(max(1, d) for d in dim[1 : dim[0] + 1])
        offset, slope, inter = struct.unpack_from(order + "3f", raw, 108)
        return cls((*shape, 1, 1, 1, 1, 1)[:5], struct.unpack_from(order + "8f", raw, 76), order + DTYPES[code], int(offset), slope, inter, raw)

    @property
    def volume(self) -> int:
        return int(np.prod(self.shape[:3])) * np.dtype(self.kind).itemsize


@dataclass
class Volume(InputPartition):
    path: str
    channel: int
    echo: int
    header: Header

    def __init__(self, path: str, channel: int, echo: int, header: Header):
        super().__init__((path, channel, echo))
        self.path, self.channel, self.echo, self.header = path, channel, echo, header


class Reader(DataSourceReader):
    def __init__(self, paths: list[str], pixels: bool):
        self.paths, self.pixels = paths, pixels
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if isinstance(f, EqualTo | In) and len(f.attribute) == 1 else None
            if name in PRUNED:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values
            else:
                yield f

    def keeps(self, **at) -> bool:
        return all(at[k] in v for k, v in self.wanted.items() if k in at)

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in (p for given in self.paths for p in listed(given)):
            if self.keeps(path=path):
                h = Header.read(path)
                places = [(c + 1, e + 1) for c in range(h.shape[4]) for e in range(h.shape[3])]
                out += [Volume(path, c, e, h) for c, e in places if self.keeps(channel=c, echo=e)]
        return out

    def read(self, part: Volume | None) -> Iterator[tuple]:
        if part is None:  # nothing to read
            return
        h = part.header
        nx, ny, nz, echoes, channels = h.shape
        values, fetched = None, 0
        if self.pixels:
            start = h.offset + h.volume * ((part.channel - 1) * echoes + part.echo - 1)
            fs, at = opened(part.path)
            with fs.open_input_file(at) as f:
                if f.read(2) == b"\x1f\x8b":
                    f.seek(0)
                    z = gzip.GzipFile(fileobj=f)
                    z.seek(start)
                    raw, fetched = z.read(h.volume), f.tell()
                else:
                    f.seek(start)
                    raw = f.read(h.volume)
                    fetched = len(raw)
            if len(raw) < h.volume:
                raise ValueError(f"NIfTI file ends early: {part.path}")
            data = np.frombuffer(raw, h.kind).astype(np.float64)
            if h.slope not in (0.0, 1.0) or h.slope == 1.0 and h.inter:
                data = data * np.float64(h.slope) + np.float64(h.inter)
            values = data.tolist()
        yield (part.path, part.channel, part.echo, nx, ny, nz, *map(float, h.pixdim[1:4]), echoes, channels, h.raw, fetched, values)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, f"_job-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        fs, at = opened(self.path)
        task, names = f"{at}/{self.job}/{uuid.uuid4().hex}", []
        fs.create_dir(task, recursive=True)
        for row in rows:
            with fs.open_output_stream(f"{task}/{row['name']}", compression=None) as f:
                f.write(row["content"])
            names.append(f"{task}/{row['name']}")
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = opened(self.path)
        fs.create_dir(at, recursive=True)
        made = {name.rpartition("/")[2]: name for m in messages if m is not None for name in m.names}
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(at)):
                if f.type == pafs.FileType.File and f.base_name.endswith((".nii", ".nii.gz")) and f.base_name not in made:
                    fs.delete_file(f.path)
        for name, path in made.items():
            fs.move(path, f"{at}/{name}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        fs, at = opened(self.path)
        if fs.get_file_info(f"{at}/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{at}/{self.job}")


class NiftiSource(DataSource):
    """Options: path (or paths, comma-separated), pixels."""

    @classmethod
    def name(cls) -> str:
        return "nifti"

    def schema(self) -> str:
        return SCHEMA

    def _paths(self) -> list[str]:
        given = self.options.get("paths") or self.options.get("path")
        if not given:
            raise ValueError("format nifti needs a path")
        return given.split(",")

    def reader(self, schema) -> Reader:
        return Reader(self._paths(), self.options.get("pixels", "true").lower() != "false")

    def writer(self, schema, overwrite: bool) -> Writer:
        if {"name", "content"} - set(schema.fieldNames()):
            raise ValueError("format nifti writes rows (name, content)")
        return Writer(self._paths()[0], overwrite)


def register(spark: SparkSession) -> None:
    """Makes format "nifti" known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(NiftiSource)


def rescaled(volumes: DataFrame, value: str = "values") -> DataFrame:
    """volumes with each file's values mapped to [-pi, pi], unless their finite range
    spans 2 pi already (within 1 %) or nothing. Ranges are an aggregate over rows."""
    finite = F.filter(value, lambda x: ~F.isnan(x) & (F.abs(x) != float("inf")))
    ends = volumes.groupBy("path").agg(F.min(F.array_min(finite)).alias("_lo"), F.max(F.array_max(finite)).alias("_hi"))
    span = F.col("_hi") - F.col("_lo")
    as_is = F.col("_lo").isNull() | (span == 0) | (F.abs(span - P.TWO_PI) < 0.02 * P.PI)
    mapped = F.transform(value, lambda x: (x - F.col("_lo")) / F.when(span == 0, 1.0).otherwise(span) * P.TWO_PI - P.PI)
    return volumes.join(ends, "path").withColumn(value, F.when(as_is, F.col(value)).otherwise(mapped)).drop("_lo", "_hi")
