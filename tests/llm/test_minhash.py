"""MinHash near-duplicates against comparing all pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest

from unfurl.llm import minhash as M

from brute import shingles


def components(rows, share=85):
    """rows: (id, text). Smallest reachable id of each row, and sizes of the sets."""
    sets = [frozenset(shingles(t)) for _, t in rows]
    which, parent = {}, list(range(len(rows)))
    for i, s in enumerate(sets):
        if s:
            parent[i] = which.setdefault(s, i)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    one = list(which.values())
    for n, i in enumerate(one):
        for j in one[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= share * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return [min(least[find(i)], default=None) for i in range(len(rows))], [len(s) for s in sets]


def check(df, rows):
    got = sorted((tuple(r) for r in M.cluster(df).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)
    comp, size = components(rows)
    assert got == sorted(((d, n, c, d == c) for (d, _), c, n in zip(rows, comp, size)), key=repr)
    return got


def test_corpus(corpus, empty):
    df, rows = corpus
    check(df, [r[:2] for r in rows])
    assert M.cluster(empty).count() == 0 and M.cluster(empty).columns[0] == "doc_id"


def test_names(spark):
    """Other columns of any name come through, those of the result are replaced."""
    df = spark.createDataFrame([(2, "a b", 1, 2, 3, "x"), (1, "A  b", 4, 5, 6, "y")], "doc_id long, text string, set long, sid long, kept long, `in_0 b` string")
    assert sorted(map(tuple, M.cluster(df).collect())) == [(1, 4, 5, "y", 1, 1, True), (2, 1, 2, "x", 1, 1, False)]


@pytest.mark.parametrize("block,seed", [(256, 1), (4, 2)])
def test_random(spark, monkeypatch, block, seed):
    """Chains of edits around the threshold, a large group and shared passages, with
    blocks so small that groups and clusters take many."""
    monkeypatch.setattr(M, "BLOCK", block)
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(500)
    rows, passage = [], [word() for _ in range(30)]
    for base in range(12):
        words = [word() for _ in range(rng.randrange(20, 200))]
        for _ in range(rng.choice([1, 3, 10])):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            for _ in range(rng.randrange(1, 3)):
                words[rng.randrange(len(words))] = word()
    big = [word() for _ in range(150)]
    for _ in range(60):
        words = list(big)
        words[rng.randrange(150)] = word()
        rows.append((len(rows), " ".join(words)))
    for _ in range(40):
        rows.append((len(rows), " ".join(passage + [word() for _ in range(rng.randrange(4, 12))])))
    got = check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)
    assert 20 < sum(r[3] for r in got) < len(rows) - 50


def test_pigeonhole():
    """Signatures that differ in as many places as allowed still share a key."""
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = rng.integers(0, 1 << 16, M.POSITIONS).astype(np.uint16)
        b = a.copy()
        at = rng.permutation(M.POSITIONS)[: M.DISTANCE]
        b[at] ^= np.uint16(1)
        assert set(M.keys(a[None])[0].tolist()) & set(M.keys(b[None])[0].tolist())
    # One error in every chunk and a second in all but one is the worst.
    b = a.copy()
    for c in range(M.CHUNKS):
        b[c * M.WIDTH : c * M.WIDTH + (2 if c else 1)] ^= np.uint16(1)
    assert (a != b).sum() == M.DISTANCE and len(set(M.keys(a[None])[0].tolist()) & set(M.keys(b[None])[0].tolist())) == 1


def test_block_pairs():
    """Against a plain loop; closed keys and unfitting sizes open nothing."""
    rng = np.random.default_rng(9)
    for _ in range(50):
        entries = {}
        for _ in range(60):
            k, s = int(rng.integers(5)), int(rng.integers(8))
            low = int(rng.choice([7, 7, 7, 7, rng.integers(4)]))
            entries[k, s] = (low, low + int(rng.integers(2)) * int(rng.integers(3)), *sorted(rng.integers(80, 120, 2).tolist()))
        want = set()
        for (k, s), (a, b, lo, hi) in entries.items():
            for (k2, s2), (c, d, lo2, hi2) in entries.items():
                if k == k2 and s < s2 and not (a == b == c == d) and 100 * hi >= 85 * lo2 and 100 * hi2 >= 85 * lo:
                    want.add((s, s2))
        cols = [np.array(x) for x in zip(*[(k, s, *v) for (k, s), v in entries.items()])]
        assert set(map(tuple, M.block_pairs(*cols).tolist())) == want


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    both, one, two = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (850, 75, 75))
    h = np.concatenate([np.sort(np.concatenate([both, one])), np.sort(np.concatenate([both, two]))])
    s = M.signatures(h, np.array([925, 925]))
    assert abs((s[0] != s[1]).mean() - 0.15) < 0.12
    assert (M.signatures(h[:925], np.array([0, 925, 0]))[[0, 2]] == 0).all()
