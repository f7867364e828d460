"""Images stay whole in one task when adaptive execution replaces the joins below, and
tables that several steps read are made once."""

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from unfurl.operators import merging, post
from unfurl.plans import queries as Q

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def torn(tmp_path_factory):
    """The vectors in files whose ends lie inside images of three echoes."""
    d = tmp_path_factory.mktemp("torn")
    t = pq.read_table(f"{DATA}/embeddings.parquet")
    (d / "embeddings.parquet").mkdir()
    for k in range(0, t.num_rows, 25):
        pq.write_table(t.slice(k, 25), d / "embeddings.parquet" / f"part-{k:04}.parquet")
    return str(d)


@pytest.fixture
def replaced(spark):
    """Joins are planned with exchanges and, once these have run, made broadcasts: the
    limit lies between the size estimated of the vectors' table and that of its keys."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "20KB", "spark.sql.files.openCostInBytes": "1GB", "spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in was.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.mark.parametrize("name", ["line_individual", "line_refined", "line_template_1", "line_template_2"])
def test_images_stay_whole(replaced, torn, name):
    db = duckdb.connect()
    db.sql(f"create view embeddings as from '{torn}/embeddings.parquet/*.parquet'")
    got, want = Q.QUERIES[name](replaced, torn).toPandas(), db.sql(Q.SQL[name]).df()
    cols = sorted(want.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (got, want))
    assert (a.astype(str) == b.astype(str)).all().all()


def test_echoes_are_made_once(spark):
    """No aggregate of the echoes is left to repeat, however many read them."""
    rows = [(1, i, e, 1.0 + i + 2 * e) for i in range(4) for e in (1, 2, 3)]
    wide = post.by_echo(spark.createDataFrame(rows, "image_id long, idx long, echo int, phase double"), 3, "phase")
    fixed = post.correct_echoes(wide, [1.0, 2.0, 3.0])
    assert fixed._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 0
    assert fixed.count() == 4


def test_merging_takes_images_together(spark):
    """No call of pandas for each image; the same plan as image by image, also for
    images whose regions do not touch and for sums that are not there."""
    rng = np.random.default_rng(3)
    sizes = [(i, 1, r, int(rng.integers(1, 50))) for i in range(60) for r in range(0, 5)]
    pairs = [(i, 1, a, b, float(rng.normal(0, 300)) if i % 7 else None, int(rng.integers(0, 40))) for i in range(50) for a in range(1, 5) for b in range(1, 5) if a != b]
    left = spark.createDataFrame(pairs, "image_id long, echo int, ri short, rj short, offset_sum double, weight_sum long")
    right = spark.createDataFrame(sizes, "image_id long, echo int, region short, size long")
    got = merging.merges(left, right)
    assert "CoGroup" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for i in range(60):
        own = [(a, b, float("nan") if o is None else o, w) for k, _, a, b, o, w in pairs if k == i]
        want |= {(i, r): x for r, x in merging.plan({r: n for k, _, r, n in sizes if k == i and r}, own).items()}
    found = {(r.image_id, r.region): (r.merged, r.wraps, r.root) for r in got.collect()}
    assert str(sorted(found.items())) == str(sorted(want.items()))
