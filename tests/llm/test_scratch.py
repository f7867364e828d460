"""What registered queries leave in the shared folder once their result is written."""

import os

import pytest

import __spark_entry__ as entry
from unfurl.llm._dist import shared_dir

DATA = "/root/testdata/sf0.001"
#: Tables that a lazy result reads: those of the query's own last step.
KEPT = {"op7_quality": 0, "op6_suffix_dedup": 2, "op8_near_dup": 2, "op11_minhash": 2, "pipeline": 1}
NAMES = sorted(n for n in entry.queries() if n.startswith("op") or n == "pipeline")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", NAMES)
def test_tables_are_removed(spark, tmp_path, name):
    folder = shared_dir(spark).removeprefix("file://").removeprefix("file:") + "/unfurl"
    listed = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    before = listed()
    entry.queries()[name](spark, DATA).write.parquet(f"file://{tmp_path}/out")
    left = listed() - before
    assert len(left) <= KEPT.get(name, 1), left
