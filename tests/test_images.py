"""Folders of images against the command line, file by file."""

import os

import numpy as np
import pytest

from unfurl.plans.app import unwrapping_main
from unfurl.plans.images import unwrap_folder
from unfurl.sources import nifti

TP = 2 * np.pi


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    d = tmp_path_factory.mktemp("study")
    for i, box in enumerate(((6, 5, 4), (4, 7, 3))):
        rng = np.random.default_rng(i)
        x, y, z = np.meshgrid(*map(np.arange, box), indexing="ij")
        te = np.array([3.0, 6.0, 9.0])
        p = te * ((0.07 * x**2 - 0.1 * y + 0.05 * z) / 3)[..., None] + 0.3 * rng.standard_normal((*box, 3))
        p = p - TP * np.rint(p / TP)
        m = np.exp(-te / 15) * (1 + 0.4 * rng.random((*box, 1)))
        head = nifti.encode(p)[: nifti.HEADER]
        for kind, data in {"me": p, "me_mag": m, "one": p[..., 0], "one_mag": m[..., 0], "coils": np.stack([p, p + 0.4], 4), "coils_mag": np.stack([m, m], 4)}.items():
            (d / kind).mkdir(exist_ok=True)
            nifti.write(str(d / kind / f"s{i}.nii"), data.astype("f4"), head)
    return d


CASES = {
    "single": ("one", ["-w", "default2"], ["unwrapped"]),
    "masked": ("one", ["-k", "robustmask", "-u", "-q"], ["unwrapped", "mask", "quality"]),
    "multi": ("me", ["-t", "[3,6,9]", "-g", "-k", "qualitymask 0.2", "--threshold", "3"], ["unwrapped", "mask"]),
    "echoes": ("me", ["-t", "[3,6,9]", "-e", "[1,3]", "-i", "-k", "nomask"], ["unwrapped"]),
    "field": ("me", ["-t", "[3,6,9]", "-B", "--template", "2", "-q"], ["unwrapped", "B0", "B0_snr", "quality"]),
    "coils": ("coils", ["-t", "[3,6,9]", "--phase-offset-smoothing-sigma-mm", "[2,2,2]"], ["unwrapped"]),
}


@pytest.mark.parametrize("case", CASES)
def test_folder_equals_command_line(spark, folders, tmp_path, case):
    kind, options, results = CASES[case]
    args = ["-p", str(folders / kind), "-m", str(folders / f"{kind}_mag"), *options, "-o", str(tmp_path / "all")]
    unwrap_folder(spark, args)
    for i in range(2):
        one = ["-p", str(folders / kind / f"s{i}.nii"), "-m", str(folders / f"{kind}_mag" / f"s{i}.nii"), *options, "-o", str(tmp_path / f"o{i}")]
        assert unwrapping_main(one, spark) == 0
        for name in results:
            got = nifti.parse((tmp_path / "all" / name / f"s{i}.nii").read_bytes())
            want = nifti.parse((tmp_path / f"o{i}" / f"{name}.nii").read_bytes())
            assert got.data.shape == want.data.shape and got.pixdim[1:4] == want.pixdim[1:4]
            assert np.allclose(got.data, want.data, atol=1e-5, equal_nan=True), name
    assert sorted(os.listdir(tmp_path / "all" / "unwrapped")) == ["s0.nii", "s1.nii"]


def test_errors(spark, folders, tmp_path):
    where = ["-o", str(tmp_path / "x")]
    with pytest.raises(ValueError, match="no echo times"):
        unwrap_folder(spark, ["-p", str(folders / "me"), *where])
    with pytest.raises(Exception, match="does not match"):
        unwrap_folder(spark, ["-p", str(folders / "one"), "-m", str(folders / "nothing_mag") if (folders / "nothing_mag").exists() else str(folders / "me_mag" / "s0.nii"), *where])
    with pytest.raises(ValueError, match="same number of echoes"):
        unwrap_folder(spark, ["-p", str(folders), *where])
    assert not (tmp_path / "x").exists()
