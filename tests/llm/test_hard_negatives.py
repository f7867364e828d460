"""Hard negatives against a plain loop over all pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from unfurl.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int, uid string, tile int"


def brute(rows, every, k=5, low=80):
    good = []
    for n, (i, e, label) in enumerate(rows):
        if label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            good.append((n, i, [math.floor(256 * x) for x in e], label))
    out = []
    first = lambda xs: sorted(xs, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]
    for n, i, e, label in good:
        if i is None or i % every:
            continue
        scored = [(sum(x * y for x, y in zip(e, f)), j, other == label) for m, j, f, other in good if m != n]
        for ps, p, _ in first([s for s in scored if s[2]]):
            band = [s for s in scored if not s[2] and low * ps <= 100 * s[0] <= 100 * ps]
            out += [(i, p, r + 1, j, ps, s) for r, (s, j, _) in enumerate(first(band))]
    return sorted(out, key=repr)


def mined(spark, rows, every, parts=3):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, H.mine(df, anchor_every=every).collect()), key=repr)


@pytest.mark.parametrize("seed,values,tile", [(1, 1 << 20, 512), (2, 64, 4), (3, 200, 1)])
def test_random(spark, monkeypatch, seed, values, tile):
    """Ties, repeated rows, nulls and odd values, short vectors, small blocks and tiles."""
    monkeypatch.setattr(H, "BLOCK_VALUES", values)
    monkeypatch.setattr(H, "TILE", tile)
    rng = random.Random(seed)
    vec = lambda: [float(x) for x in (rng.choice([-0.25, 0.0, 0.25, 0.5, rng.random()]) for _ in range(rng.choice([12, 12, 12, 5])))]
    rows = [(rng.randrange(-50, 50), [float.fromhex(float(round(x * 64) / 64).hex()) for x in vec()], rng.randrange(3)) for _ in range(120)]
    rows += rows[:10] + [(0, rows[3][1], 1)] * 15  # copies
    rows += [(5, None, 1), (6, [1.0] * 12, None), (7, [None] * 12, 1), (8, [math.nan] * 12, 1), (9, [math.inf] + [1.0] * 11, 0), (None, rows[0][1], 1), (None, rows[1][1], 2), (12, [], 0)]
    want = brute(rows, 4)
    assert len(want) > 100 and mined(spark, rows, 4) == want


def test_nothing_to_mine(spark):
    assert mined(spark, [], 5) == []
    assert mined(spark, [(1, [1.0], 0), (2, [1.0], 1)], 5) == []
    assert mined(spark, [(5, [], 0), (6, [], 0), (7, [], 1)], 5) == [(5, 6, 1, 7, 0, 0)]
    assert mined(spark, [(5, [1.0], 0), (6, [-1.0], 0), (7, [-1.0], 1)], 5) == []  # a negative score opens no band


def test_one_vector_holds_most_rows(spark):
    rows = [(i, [0.5, 0.25, 0.125], i % 3) for i in range(300)] + [(1000 + i, [0.5, 0.25, i / 512], i % 2) for i in range(50)]
    assert mined(spark, rows, 50) == brute(rows, 50)


def test_large_components_leave_their_row_out(spark):
    rows = [(0, [1.0, 1.0], 0), (1, [1.0, 1.0], 0), (2, [1.0, 1.0], 1), (3, [3e38, 0.0], 1)]
    assert mined(spark, rows, 100) == [(0, 1, 1, 2, 2 * 65536, 2 * 65536)]


def test_bounds_keep_what_counts():
    """kth() and top() as sorting gives them."""
    import numpy as np

    q, v = np.array([0, 1, 0, 0, 1]), np.array([5.0, 1.0, 7.0, 6.0, 2.0])
    assert H.kth(q, v, 2, 3).tolist() == [6.0, 1.0, -math.inf]
    best = H.top(q, v, np.ones(5, bool), np.arange(5), 2)
    assert [(int(q[i]), float(v[i])) for i in best] == [(0, 7.0), (0, 6.0), (1, 2.0), (1, 1.0)]


def test_query_names(spark):
    df = spark.createDataFrame([(0, [1.0], 1, "a", 3), (1, [1.0], 1, "b", 4), (2, [1.0], 2, "c", 5)], "`my id` long, embedding array<double>, block long, ids string, slot int")
    got = H.mine(df, "my id", "block").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, 65536, 65536)]
    assert H.mine(df, "my id", F.lit(None)).count() == 0
