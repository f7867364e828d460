"""Single precision: results are of that type and as exact as it allows."""

import numpy as np
import pandas as pd
import pytest

from unfurl.model import Shape
from unfurl.operators import _kernel as K
from unfurl.operators import grow

TP = 2 * np.pi


def unwrapped(phase, box, kind):
    u, _ = K.run_image(box, [phase.astype(kind)], K.Options(single=kind == np.float32))
    assert u[0].dtype == kind
    return u[0]


@pytest.mark.parametrize("kind", [np.float32, np.float64])
def test_lines_planes_and_boxes(kind):
    """Remainders of rising fields by 2 pi of the type give the field up to a constant."""
    turn, eps = kind(2 * np.pi), np.finfo(kind).eps
    line = np.linspace(0, 2 * float(turn), 10).astype(kind)
    got = unwrapped(line % turn, (10, 1, 1), kind)
    k = np.rint((line - got)[0] / TP)
    assert np.allclose(got + k * TP, line, rtol=20 * eps, atol=20 * eps)
    side = np.linspace(0, 2 * float(turn), 7).astype(kind)
    plane = (side[:, None] + side[None, :]).astype(kind)
    got = unwrapped((plane % turn).ravel(order="F"), (7, 7, 1), kind)
    assert np.allclose(got + (plane.ravel(order="F")[0] - got[0]), plane.ravel(order="F"), rtol=50 * eps, atol=50 * eps)
    g = np.linspace(0, float(turn), 11).astype(kind)
    x, y, z = np.meshgrid(g, g, g, indexing="ij")
    for field in (0.1 * x**2 - 2 * y + 2 * z, 5 * np.sin(x) + 2 * np.cos(y) + z, 5 * np.sin(x) + 2 * np.cos(y) - 4 * np.cos(z)):
        f = field.astype(kind).ravel(order="F")
        got = unwrapped(np.fmod(f, turn), (11, 11, 11), kind)
        assert np.allclose(got + (f[0] - got[0]), f, rtol=100 * eps, atol=100 * eps)


def test_weights_wrap_by_the_rounded_turn():
    phase = np.array([3.0, -3.0, 2.9, -3.1], np.float32)
    q = K.edge_quality(phase, K.Options(weights="1", shape=(4, 1, 1)))
    step = np.float32(3.0) - np.float32(-3.0) - np.float32(TP)
    assert q[0, 0] == pytest.approx(0.1 + 0.9 * (1 - abs(step / np.float32(np.pi))), abs=1e-6)
    assert K.wrap_once(np.array([4.0], np.float32)).dtype == np.float32 and K.wrap_once(np.array([4.0], np.float32))[0] == np.float32(4) - np.float32(TP)


def test_tables(spark):
    """Types of voxel and volume tables, several echoes too."""
    p = np.linspace(0, 20, 12)
    pdf = pd.DataFrame({"image_id": 1, "echo": np.repeat([1, 2], 12), "te": np.repeat([1.0, 2.0], 12), "idx": np.tile(np.arange(12), 2), "phase": np.concatenate([p, 2 * p]) % TP})
    v = spark.createDataFrame(pdf)
    o = K.Options(single=True, refine=0.0)
    got = grow.unwrap(v, Shape(12), o, multi_echo=True)
    assert dict(got.dtypes)["unwrapped"] == "float" and got.count() == 24
    vol = spark.createDataFrame([(1, e, 12, 1, 1, float(e), (e * p % TP).tolist()) for e in (1, 2)], "image_id long, echo int, nx int, ny int, nz int, te double, phase array<double>")
    one, many = grow.unwrap_volumes(vol, o), grow.unwrap_volumes(vol, o, multi_echo=True)
    assert dict(one.dtypes)["unwrapped"] == dict(many.dtypes)["unwrapped"] == "array<float>"
    flat = {r["echo"]: r["unwrapped"] for r in many.collect()}
    want = {r["echo"]: [] for r in got.select("echo").distinct().collect()}
    for r in got.orderBy("echo", "idx").collect():
        want[r["echo"]].append(r["unwrapped"])
    assert flat == want
