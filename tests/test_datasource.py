"""The NIfTI data source: what is read, what is pruned, and what a failure leaves."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from unfurl.sources import datasource, nifti


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng, at = np.random.default_rng(1), tmp_path_factory.mktemp("images")
    data = {"a.nii": rng.normal(size=(5, 4, 3, 3)).astype("f4"), "b.nii.gz": rng.integers(-9, 9, (2, 3, 1, 2, 2)).astype("i2"), "sub/c.nii": rng.random((6, 5))}
    (at / "sub").mkdir()
    for name, x in data.items():
        nifti.write(str(at / name), x)
    (at / "notes.txt").write_text("no image")
    return at, data


@pytest.fixture(scope="module")
def source(spark):
    datasource.register(spark)
    return spark


def test_reads_as_the_reader(source, folder):
    at, data = folder
    got = source.read.format("nifti").load(str(at)).toPandas()
    want = nifti.read_volumes(source, [f"file://{at}/{n}" for n in data]).toPandas()
    key = lambda df: {(p.removeprefix("file:").replace("//", "/"), c, e): (x, y, z, v.tolist() if hasattr(v, "tolist") else list(v)) for p, c, e, x, y, z, v in zip(df["path"], df["channel"], df["echo"], df["nx"], df["ny"], df["nz"], df["values"])}
    assert key(got) == key(want) and len(got) == 3 + 4 + 1


def test_only_wanted_bytes(source, folder):
    """Filters drop partitions; headers alone when pixels are not asked for."""
    at, data = folder
    df = source.read.format("nifti").load(f"file://{at}/a.nii")
    one = df.where("echo = 2")
    assert df.rdd.getNumPartitions() == 3 and one.rdd.getNumPartitions() == 1
    row = one.first()
    assert row["bytes_read"] == 5 * 4 * 3 * 4 and np.array_equal(row["values"], data["a.nii"][..., 1].ravel(order="F"))
    assert [r["echo"] for r in df.where(F.col("echo").isin(1, 3)).orderBy("echo").collect()] == [1, 3]
    assert df.where("echo = 2 and nx > 5").count() == 0 and df.where("echo = 9").count() == 0
    heads = source.read.format("nifti").option("pixels", "false").load(str(at)).collect()
    assert len(heads) == 8 and all(r["bytes_read"] == 0 and r["values"] is None for r in heads)


def test_rescaled(source, folder):
    at, data = folder
    got = datasource.rescaled(source.read.format("nifti").load(str(at / "a.nii"))).orderBy("echo").collect()
    want = nifti.rescale_phase(data["a.nii"])
    assert all(np.allclose(r["values"], want[..., i].ravel(order="F")) for i, r in enumerate(got))


def test_round_trip_and_overwrite(source, folder, tmp_path):
    at, data = folder
    v = source.read.format("nifti").load(str(at / "a.nii")).withColumn("image_id", F.lit(7).cast("long"))
    both = v.union(v.withColumn("image_id", F.lit(8).cast("long")))
    for mode, prefix in (("append", "x"), ("append", "y"), ("overwrite", "z")):
        nifti.named_files(both, "values", prefix).write.format("nifti").mode(mode).save(str(tmp_path / "out"))
    assert sorted(os.listdir(tmp_path / "out")) == ["z_7.nii", "z_8.nii"]
    back = source.read.format("nifti").load(str(tmp_path / "out")).where("echo = 3").collect()
    assert len(back) == 2 and all(np.allclose(r["values"], data["a.nii"][..., 2].ravel(order="F")) for r in back)


def test_failure_leaves_nothing(source, tmp_path):
    """A task that fails after others have written: no file, no folder of the job."""
    rows = source.range(6, numPartitions=3).select(F.concat(F.lit("f"), "id", F.lit(".nii")).alias("name"), F.when(F.col("id") == 5, F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.lit(b"x")).alias("content"))
    with pytest.raises(Exception, match="broken"):
        rows.write.format("nifti").mode("append").save(str(tmp_path / "out"))
    assert [f for _, _, names in os.walk(tmp_path) for f in names] == []
    with pytest.raises(Exception, match="name, content"):
        source.range(1).write.format("nifti").mode("append").save(str(tmp_path / "out"))


def test_bad_files(source, tmp_path):
    (tmp_path / "bad.nii").write_bytes(b"\0" * 400)
    with pytest.raises(Exception, match="not a NIfTI-1 file"):
        source.read.format("nifti").load(str(tmp_path / "bad.nii")).collect()
    whole = nifti.encode(np.zeros((4, 4, 4)))
    (tmp_path / "short.nii").write_bytes(whole[:-8])
    with pytest.raises(Exception, match="ends early"):
        source.read.format("nifti").load(str(tmp_path / "short.nii")).collect()
