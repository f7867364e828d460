"""corpus_pipeline.run() against a slow version of its stages."""

import math
import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from unfurl.llm.quality import Rules  # noqa: E402


def char_class(c):
    sets = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "\t\n\v\f\r ", ".,;:!?'\"()-", "#*$%&|<>"]
    return 6 if ord(c) > 127 else next((i for i, s in enumerate(sets) if c in s), 7)


def distance(p, q):
    a, b, total = sum(p.values()), sum(q.values()), 0
    for k in p.keys() | q.keys() if a and b else ():
        x, y = p[k] / a, q[k] / b
        total += sum(v * math.log2(2 * v / (x + y)) for v in (x, y) if v) / 2
    return math.sqrt(max(total, 0))


def good(rows):
    r, refs = Rules(), {}
    for lang in {x[2] for x in rows} | {None}:
        texts = [x[1] or "" for x in rows if lang in (None, x[2])]
        words = Counter(w for t in texts for w in brute.words(t, True))
        common = {w for w, n in words.items() if n >= r.word_share * sum(words.values())}
        refs[lang] = Counter(char_class(c) for t in texts for c in t), common, Counter(w if w in common else None for w in words.elements())
    for row in rows:
        n, chars, _, _, repeated = brute.quality(row[1])
        if n < r.min_words or 100 * repeated > r.max_repeat_percent * n:
            continue
        classes, common, words = refs[row[2]]
        far = distance(Counter(map(char_class, row[1])), classes) if len(row[1]) >= r.min_chars else 0
        own = Counter(w if w in common else None for w in brute.words(row[1], True))
        strange = distance(own, words) if n >= r.min_words_for_words else 0
        if far <= (r.short_class_distance if chars < r.short_chars else r.class_distance) and strange <= r.word_distance:
            yield row


def test_pipeline(spark, corpus, tmp_path):
    df, rows = corpus
    items = [(1, " ".join(brute.TERM.findall(rows[2][1])[3:20])), (2, "never seen anywhere")]
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = list(good(rows))
    assert 0 < len(kept) < len(rows)
    groups = {}
    for row, c in zip(kept, brute.components([(r[0], r[1]) for r in kept])[0]):
        groups.setdefault(c, []).append(row)
    single = [min(g, key=lambda r: (r[0] is not None, r[0] or 0)) for g in groups.values()]
    clean = [r for r in single if not brute.contamination(r[1], items)[1]]
    assert len(kept) > len(single) > len(clean) > 0
    docs = df
    for (name, stage), want in zip(corpus_pipeline.STAGES, (kept, single, clean)):
        docs = stage(spark, docs, str(tmp_path))
        assert Counter(tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()) == Counter(want), name
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    times = Counter((r.doc_id, r.text, r.lang, r.source) for r in out)
    assert times.keys() <= set(clean) and max(times.values()) <= 2
    size, taken = Counter(), Counter()
    for r in clean:
        size[r[3]] += len(brute.words(r[1]))
        taken[r[3]] += times[r] * len(brute.words(r[1]))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    most = max(len(brute.words(r[1])) for r in clean)
    for s, target in zip(names, brute.targets([(s, size[s]) for s in names])):
        assert abs(taken[s] - target) <= 2 * most
    shards = Counter(r.shard for r in out)
    counts = [shards[i] for i in range(corpus_pipeline.SHARDS)]
    assert max(counts) - min(counts) <= 1 and len({(r.shard, r.slot) for r in out}) == len(out)
    assert all(r.slot < shards[r.shard] for r in out)
