"""The registered queries themselves, keys and seeds included, on the smallest tables."""

import hashlib
import os
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from unfurl.llm import mixing, registry, sharding  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "source").collect()]


def rows_of(spark, name):
    got = registry.QUERIES[name](spark, DATA).collect()
    out = {r["doc_id"]: r for r in got}
    assert len(out) == len(got)
    return out


def test_op2(spark, docs):
    got = rows_of(spark, "op2_pii")
    for d, text, _ in docs:
        want = brute.pii(text)
        kinds = [x.split(":")[0] for x in want.split(",")]
        assert [got[d][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [kinds.count(k) for k in ("email", "ip", "card", "phone")]
        assert got[d]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest() and set(want.split(",")) <= {*got[d]["spans"].split(","), ""}


def test_op3(spark, docs):
    """Queues in the order of the rows' hashes, then one order by virtual finish time."""
    got = rows_of(spark, "op3_mixing")
    t = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"))
    rows = [tuple(r) for r in t.withColumn("h", F.xxhash64(F.lit(3), "doc_id", "source", "size")).collect()]
    assert {(d, n) for d, _, n, _ in rows} == {(d, len(brute.words(x))) for d, x, _ in docs}
    names = sorted({s for _, s, _, _ in rows}, key=lambda s: (s is None, s))
    sizes = [(s, sum(n for _, x, n, _ in rows if x == s)) for s in names]
    aim = dict(zip(names, brute.targets(sizes)))
    size, entries, taken, used = dict(sizes), [], dict.fromkeys([r[0] for r in rows], 0), 0
    for s in names:
        total = 0
        for place, (d, _, n, _) in enumerate(sorted((r for r in rows if r[1] == s), key=lambda r: r[3])):
            total += n
            entries += [((k * size[s] + total) / aim[s], names.index(s), place, k, d, n) for k in range(2)]
    for *_, d, n in sorted(entries):
        used += n
        taken[d] += n if used <= 1.5 * sum(size.values()) else 0
    for d, s, n, _ in rows:
        assert (got[d]["size"], got[d]["source_size"], got[d]["taken"]) == (n, size[s], taken[d]) and got[d]["target"] == pytest.approx(aim[s])


def test_op4(spark, docs):
    got = rows_of(spark, "op4_lm_score")
    for (d, *_), (held, n, known, train, base) in zip(docs, brute.word_scores([x[:2] for x in docs])):
        r = got[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, train)
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] < 0


def test_op6(spark, docs):
    got = rows_of(spark, "op6_suffix_dedup")
    for (d, _), want in brute.repeats([x[:2] for x in docs]).items():
        r = got[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == want


def test_op7(spark, docs):
    got = rows_of(spark, "op7_quality")
    for d, text, _ in docs:
        n, chars, symbols, lines, repeats = brute.quality(text)
        r, failed = got[d], n < 10 or 100 * repeats > 20 * n
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeats)
        assert r["base_failed"] == failed and not (failed and r["kept"])


@pytest.mark.parametrize("name,share", [("op8_near_dup", 75), ("op11_minhash", 85)])
def test_near_duplicates(spark, docs, name, share):
    from test_minhash import components

    got = rows_of(spark, name)
    for (d, *_), c, n in zip(docs, *components([x[:2] for x in docs], share)):
        assert (got[d]["component_id"], got[d]["n_shingles"]) == (c, n)
        assert share == 75 or got[d]["kept"] == (c == d)


def test_op10(spark, docs):
    """Places computed from a document's number alone."""
    got = rows_of(spark, "op10_sharding")
    where = sharding.permute(np.arange(len(docs)), len(docs), 24)
    for i, (d, text, _) in enumerate(sorted(docs)):
        raw, r = (text or "").encode(), got[d]
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "rows")
        assert (r["shard"], r["slot"]) == (where[i] % 24, where[i] // 24) == sharding.place(i, len(docs), 24, 24)
