"""Every operator against its brute-force version on awkward small corpora."""

import hashlib
import itertools
import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from unfurl.llm import _dist, _words, chat, decontaminate, lm_score, mixing, near_dup, pii, quality, sharding, suffix_dedup, url_filters  # noqa: E402

CLASH = ["size", "sid", "n_words", "shard", "target", "start", "key", "n", "id2", "_tie", "tie", "_row", "_pos", "_part", "_p", "_mid", "_k1", "_k2", "_i"]
CLASH += ["_copies", "_rows", "_h", "_s", "_start", "_cum", "_used", "_take", "_qp", "_qi", "_pass", "_finish", "_base", "terms", "every", "rid", "hit", "k1"]
CLASH += ["k", "w", "id", "root", "least", "rep", "label", "segs", "says", "host", "in_0", "in_1", "c_0", "ends", "places", "doc", "_unf_k", "rank", "bare", "sha"]


def odd(df):
    """df with extra columns named like outputs and internals."""
    return df.withColumns({c: F.lit("extra") for c in CLASH if c not in df.columns})


def nul(x):
    return None if x is None or x != x else x


# Sharding ----------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation(n):
    p = sharding.permute(np.arange(n), n, 3)
    assert sorted(p.tolist()) == list(range(n))
    assert [sharding.place(i, n, 5, 3) for i in range(min(n, 5))] == [(int(x) % 5, int(x) // 5) for x in p[:5]]


def test_sharding(corpus, empty):
    df, rows = corpus
    slim = odd(df.select("doc_id", "text"))
    a = sharding.shard_rows(slim, ["doc_id"], 7, 1).toPandas()
    assert len(a) == len(rows) and set(a.columns) == {"doc_id", "text", *CLASH, "slot"}
    size = a.groupby("shard").slot.agg(["count", "max", "nunique"])
    assert size["count"].max() - size["count"].min() <= 1 and (size["max"] + 1 == size["count"]).all() and (size["nunique"] == size["count"]).all()
    b = sharding.shard_rows(slim.repartition(5), ["doc_id"], 7, 1).toPandas()
    key = lambda d: sorted(map(str, zip(d.doc_id, d.text, d.shard, d.slot)))
    assert key(a) == key(b)
    assert sharding.shard_rows(empty, ["doc_id"], 7).count() == 0


# Mixing --------------------------------------------------------------------------


def test_targets(spark):
    rng = random.Random(1)
    for _ in range(6):
        sizes = [(f"s{i:02d}", rng.randrange(0, 1000)) for i in range(rng.randrange(1, 9))]
        budget = 1.5 * sum(s for _, s in sizes)
        got = mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long"), (5, 2, 1), budget, 2)
        assert np.allclose([r.target for r in got.orderBy("source").collect()], brute.targets(sizes))


def test_mixing(corpus, empty):
    df, rows = corpus
    slim = df.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.lit(1).alias("target"))
    a = mixing.mix(slim, seed=2).toPandas()
    assert len(a) == len(rows) and Counter(a["size"]) == Counter(len(brute.words(r[1])) for r in rows)
    assert (a.taken <= 2 * a["size"]).all() and a.taken.sum() <= 1.5 * a["size"].sum()
    for s, g in a.groupby(a.source.fillna("~")):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 2 * g["size"].max()
        assert g.source_size.iloc[0] == g["size"].sum()
    b = mixing.mix(slim.repartition(4), seed=2).toPandas()
    assert sorted(map(str, zip(a.doc_id, a.taken))) == sorted(map(str, zip(b.doc_id, b.taken)))
    assert mixing.mix(empty.select("doc_id", "source", F.lit(0).cast("long").alias("size"))).count() == 0
    mixed = mixing.mixed(odd(df), seed=2).toPandas()
    assert set(mixed.columns) == set(odd(df).columns) and mixed.groupby("text").size().max() > 1


# URL filters ----------------------------------------------------------------------


def test_url_parts_and_rules(spark):
    urls = [
        ("http://A.Example.ORG/es/x?q#f", "a.example.org", "/es/x", "example.org/es/", "block"),
        ("https://example.org", "example.org", "", None, "allow"),
        ("http://x.org/", "x.org", "/", "org/", "allow"),
        ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://myexample.org/en/12", "myexample.org", "/en/12", "org/", "allow"),
        ("http://a.com/de/1", "a.com", "/de/1", "com/de/", "block"),
        ("http://com/fr/", "com", "/fr/", "com/fr/", "allow"),
        ("http://a.com#/fr/", "a.com", "", None, "allow"),
        ("no url", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("x://h/p://q?z", "h", "/p://q", None, "allow"),
    ]
    df = odd(spark.createDataFrame([(i, u[0]) for i, u in enumerate(urls)], "page_id long, url string").withColumn("path", F.lit("old")))
    got = {r.page_id: r for r in url_filters.judge_urls(df).collect()}
    assert len(got) == len(urls)
    for i, (_, host, path, rule, verdict) in enumerate(urls):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict)
    assert url_filters.judge_urls(df.limit(0)).count() == 0


def test_url_templates(spark):
    rows = [("h.net", f"/spam/{i}/buy-{i}", 1) for i in range(40)] + [("h.net", f"/news/{i}/read-{i}", 0) for i in range(40)]
    rows += [("h.net", "/spam/999/buy-5", None), ("h.net", "/news/999/read-5", None), ("o.net", "/spam/1/buy", None)]
    df = spark.createDataFrame(rows, "host string, path string, label int")
    tree = url_filters.build_tree(df.select("host", url_filters.segments(F.col("path"), 4).alias("segs"), "label")).collect()
    bad = {(r.host, tuple(r.segs)) for r in tree if r.rejected}
    assert all(h == "h.net" and s[0] == "spam" for h, s in bad) and ("h.net", ("spam", "*", "buy-*")) in bad
    many = spark.createDataFrame([("v.net", "/u/" + "".join(random.Random(i).choices("abcdefgh", k=9)), i % 2) for i in range(200)], "host string, path string, label int")
    t = url_filters.build_tree(many.select("host", url_filters.segments(F.col("path"), 4).alias("segs"), "label")).select("template").distinct().collect()
    assert [r.template for r in t] == ["/u/*"]


def test_url_tree_judges_unlabelled_pages(spark):
    deep = "/a/b/c/d/e"
    urls = [f"http://a.com/de/{'abcdefghijklmnopqrstuvwxyz'[i]}" for i in range(20)] + [f"http://b.com/fr/{i}" for i in range(20)]
    urls += ["http://a.com/en/x", "http://a.com" + deep + "/f", "http://a.com" + deep + "/g", "http://b.com/en/x", "http://c.net/en/x"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.url: r for r in url_filters.judge_urls(df).collect()}
    for u in urls[40:]:
        assert got[u].rule is None and (got[u].verdict == "block") == u.startswith("http://a.com/"), u
    assert got["http://a.com" + deep + "/f"].template == deep + "/f" and got["http://a.com" + deep + "/g"].template == deep + "/g"


# PII -------------------------------------------------------------------------------

TEXTS = [
    "mail a.b+c@x-y.example.com, or @no.x a@b c@d.e@f.g x@y.zfoo_bar@d.com",
    "ip 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.02.3.255 9999999999999999999999.1.1.1 1.2.3",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112 123456789012 0 0 0 0 0 0 0 0 0 0 0 0 1234  5678",
    "call +1 (456) 555-2186 now +49-30-1234567, +1 2 +123456789 ++4412345678901234567890",
    "é😀 +1 (456) 555-2186 ü a@b.co 10.0.0.1",
    "1" * 5000, "1 " * 5000, "a." * 4000, "a@" * 2000, "x@" + "y." * 3000 + "z", "+1" + " " * 3000 + "2",
    "", None, "no personal data here",
]


def test_pii_base(spark):
    df = odd(spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").withColumn("base", F.lit(1)).withColumn("terms", F.lit(1)))
    out = pii.sanitise(df).select("doc_id", pii.listed(F.col("found")).alias("found"), "sanitised", "base").toPandas().set_index("doc_id")
    assert len(out) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert out.found[i] == brute.pii(t), (i, (t or "")[:60])
    assert out.sanitised[4] == "é😀 [PHONE] ü [EMAIL] [IP]" and out.sanitised[13] == TEXTS[13] and out.sanitised[12] == ""
    assert pii.sanitise(df.limit(0)).count() == 0


def test_pii_long_texts(spark):
    texts = [" ".join(f"a{i}@x{i}.org é1" for i in range(n)) for n in (255, 256, 257, 40_000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.sanitise(df).select("doc_id", pii.listed(F.col("found")).alias("found"), "sanitised").collect():
        assert r.found == brute.pii(texts[r.doc_id]) and r.sanitised == " ".join(["[EMAIL] é1"] * (texts[r.doc_id].count("@")))


def test_pii_random(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["1", "23", ".", "-", " ", "+", "@", "a", "b.c", "x@y.z", "4111111111111111", "(", "é"]) for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.found for r in pii.sanitise(df).select("doc_id", pii.listed(F.col("found")).alias("found")).collect()}
    assert all(got[i] == brute.pii(t) for i, t in enumerate(texts))


def test_pii_disclosing_terms(spark):
    rng = random.Random(1)
    filler = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(12))
    rows = [f"{filler()} Quentin writes from boss@corp.example {filler()}" for _ in range(5)]
    rows += [f"{filler()} someone writes from u{i}@mail.example {filler()}" for i in range(60)] + [f"{filler()} Quentin alone"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert all("Quentin" not in got[i].sanitised and "[NAME]" in got[i].sanitised and "alpha" in got[i].sanitised for i in range(5))
    assert "term:" not in got[30].spans and got[65].sanitised == rows[65]


def test_pii_terms_of_whole_texts(spark):
    rng = random.Random(2)
    filler = lambda n=60: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    rows = [f"Quentin {filler()} Ortega2 at boss@corp.example {filler()} ORTEGA2 x1.2.3.4" for _ in range(5)]
    rows += [f"{filler()} someone writes from u{i}@mail.example" for i in range(60)]
    out = pii.sanitise(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).select("doc_id", "spans", "sanitised").collect()
    got = {r.doc_id: r for r in out}
    for i in range(5):
        assert got[i].sanitised.startswith("[NAME] ") and got[i].sanitised.endswith(" [NUMBER] x[IP]") and got[i].sanitised.count("[NUMBER]") == 2
        terms = [s for s in got[i].spans if s.kind == "term" and s.value.lower() in ("quentin", "ortega2")]
        assert len(terms) == 3 and all(rows[i][s.start : s.end] == s.value for s in terms)


def test_pii_counts_terms_of_all_texts(spark):
    rng = random.Random(3)
    filler = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(12))
    rows = [f"{filler()} omega from Quentin boss@corp.example {filler()}" for _ in range(5)]
    rows += [f"{filler()} writes u{i}@mail.example" for i in range(60)] + [f"{filler()} omega {filler()}" for _ in range(100)]
    df = spark.createDataFrame(list(enumerate([*rows, *rows[65:75]])), "doc_id long, text string")
    got = {r.doc_id: r.sanitised for r in pii.sanitise(df).select("doc_id", "sanitised").collect()}
    assert all(" omega " in got[i] and "Quentin" not in got[i] for i in range(5)) and got[70] == rows[70]


# LM scoring ------------------------------------------------------------------------


def test_lm_words_and_trie(spark, corpus, empty):
    df, rows = corpus
    pairs = [(r[0], r[1]) for r in rows]
    code = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8"))
    for head in (10**6, 5):
        out = lm_score.score(odd(df), code % 10 == 0, head_words=head).toPandas()
        want = Counter((nul(d), h, n, k, t) for (d, _), (h, n, k, t, _) in zip(pairs, brute.word_scores(pairs)))
        assert Counter((nul(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens) for r in out.itertuples()) == want
        for (d, _), w in zip(pairs, brute.word_scores(pairs)):
            if d is not None:
                assert np.allclose(out[out.doc_id == d].base_score, w[4])
        assert (out.score < 0).all()
    none = lm_score.score(empty, F.lit(False))
    assert none.count() == 0


def trie_counts(texts):
    grams = Counter()
    for t in texts:
        b = bytes([254] * 3) + t.encode() + bytes([255])
        for i in range(3, len(b)):
            grams[int.from_bytes(b[i - 3 : i + 1], "big")] += 1
    return grams


def slow_ppm(grams, text):
    import math

    b, total = bytes([254] * 3) + text.encode() + bytes([255]), 0.0
    tables = {k: {} for k in range(4)}
    for g, n in grams.items():
        x = g.to_bytes(4, "big")
        for k in range(4):
            node = tables[k].setdefault(x[3 - k : 3], Counter())
            node[x[3]] += n
    for i in range(3, len(b)):
        p, out, start = 1.0, set(), next(k for k in (3, 2, 1, 0) if b[i - k : i] in tables[k])
        for k in range(start, -1, -1):
            c = {x: n for x, n in tables[k].get(b[i - k : i], {}).items() if x not in out}
            if not c:
                continue
            whole = sum(c.values()) + len(c)
            if b[i] in c:
                p *= c[b[i]] / whole
                break
            p *= len(c) / whole
            out |= c.keys()
        else:
            p /= 256 - len(out)
        total += math.log10(p)
    return total


def test_ppm_against_slow_version(spark):
    train = ["the cat sat on the mat", "the dog sat on the log", "über älle"]
    grams = trie_counts(train)
    edges = spark.createDataFrame([(k, n) for k, n in grams.items()], "key long, n long")
    trie = lm_score.train_trie(edges)
    texts = ["the cat", "zzz", "", "the dog sat", "ü", "on the mat and"]
    b = next(_words.blocks(pa.array(texts)))
    assert np.allclose(trie.score(b), [slow_ppm(grams, t) for t in texts], rtol=1e-4, atol=1e-4)
    p = 10.0 ** trie.logp
    assert np.allclose(p.sum(1), 1, atol=1e-4)
    small = lm_score.train_trie(edges, max_contexts=3)
    assert len(small.keys3) <= 3 and np.isfinite(small.score(b)).all()
    assert lm_score.adaptive_score("abababababab") > lm_score.adaptive_score("abcdefghijkl") and lm_score.adaptive_score(None) < 0


def test_scores_do_not_depend_on_max_contexts(spark, corpus):
    df, rows = corpus
    code = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8"))
    some = df.where("doc_id < 12 or doc_id > 400").select("doc_id", "text").distinct()
    texts = {r.doc_id: r.text or "" for r in some.collect()}
    grams = trie_counts([t for d, t in texts.items() if zlib.crc32(str(d).encode()) % 10])
    want = {d: slow_ppm(grams, t) for d, t in texts.items() if len(t) < 5000}
    for most in (10**6, 60, 0):
        got = {r.doc_id: r.score for r in lm_score.score(some, code % 10 == 0, max_contexts=most).collect()}
        assert got.keys() == texts.keys() and all(np.isclose(got[d], w, rtol=1e-4, atol=1e-3) for d, w in want.items())


# Chat ------------------------------------------------------------------------------


def test_chat_round_trip():
    rng = random.Random(2)
    bits = ["\\", "#", "###", "<", "</turn>", "\n", " ", "a", ": ", "\\### Assistant: </turn> ok", "", "é", "\ue000"]
    for _ in range(300):
        turns = [("".join(rng.choices(bits, k=2)) if rng.random() < 0.2 else rng.choice(["user", "assistant"]), "".join(rng.choices(bits, k=6))) for _ in range(rng.randrange(6))]
        for window in (None, 2):
            out = chat.format_conversation(turns, window=window)
            assert out["formatted"] == chat.template(turns) and not out["rewritten"] and chat.parse(out["formatted"]) == turns
            assert [chat.unescape(out["formatted"][a:b]) for a, b in out["loss_spans"]] == [t for r, t in turns if r == "assistant"]


def test_chat_detects_rewriting():
    last_only = lambda turns: "".join(f"[{r}]{t if i == len(turns) - 1 else ''}\n" for i, (r, t) in enumerate(turns))
    assert chat.format_conversation([("user", "a"), ("assistant", "b"), ("user", "c")], last_only)["rewritten"] == [1, 2]


def test_chat_output_is_the_renderers():
    turns = [("user", "q"), ("assistant", "yes"), ("user", "r"), ("assistant", "no"), ("user", "s")]
    drops_old = lambda turns: "".join(f"[{r}]{t if i >= len(turns) - 4 else '-'}\n" for i, (r, t) in enumerate(turns))
    for window in (None, 2):
        out = chat.format_conversation(turns, drops_old, window)
        assert out["formatted"] == drops_old(turns) and out["rewritten"] == [4]
        assert [out["formatted"][a:b] for a, b in out["loss_spans"]] == ["yes", "no"]


def test_chat_tables(spark):
    rows = [(1, 1, "assistant", "yes"), (1, 0, "user", None), (2, None, None, "x"), (2, 0, "user", "a"), (2, 0, "user", "a"), (None, 0, "user", "q"), *chat.FIXTURE]
    df = odd(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = chat.format_conversations(df, window=2).toPandas()
    d = chat.digests(out.formatted, out.loss_spans).assign(conv_id=out.conv_id, n_turns=out.n_turns)
    d = {nul(r.conv_id): r for r in d.itertuples()}
    assert d[1].n_turns == 2 and d[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nyes\n").hexdigest()
    assert d[1].loss_chars == 3 and d[1].loss_sha256 == hashlib.sha256(b"yes").hexdigest()
    assert d[2].turns_sha256 == hashlib.sha256(b"\nx\nuser\na\nuser\na\n").hexdigest() and d[2].loss_chars == 0
    assert d[-7].loss_chars == 26 and None in d
    assert chat.format_conversations(df.limit(0)).count() == 0


# Suffixes --------------------------------------------------------------------------


def test_suffix_dedup(corpus, empty):
    df, rows = corpus
    want = brute.repeats([(r[0], r[1]) for r in rows])
    out = suffix_dedup.remove_repeats(df.select(F.col("doc_id").alias("id"), "text", F.lit(1).alias("doc")))
    got = out.toPandas()
    by_id = {}
    for (d, _), w in want.items():
        by_id.setdefault(d, w)
    assert len(got) == len(rows) and sum(w[1] for w in want.values()) > 0
    for r in got.itertuples():
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == by_id[nul(r.id)], r.id
    assert suffix_dedup.remove_repeats(empty.select(F.col("doc_id").alias("id"), "text")).count() == 0


def test_suffix_dedup_random(spark):
    rng = random.Random(9)
    parts = ["".join(rng.choices("abc é", k=rng.randrange(20, 160))) for _ in range(12)]
    rows = [(i, "".join(rng.choices(parts, k=rng.randrange(0, 6)))) for i in range(60)]
    want = brute.repeats(rows)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "id long, text string").repartition(4)).collect()
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.id, rows[r.id][1]]


def test_suffix_dedup_one_passage_in_all_texts(spark, monkeypatch):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choices("abcdefgh \0\1", k=n))
    passage = word(130)
    rows = [(i, word(rng.randrange(0, 90)) + passage[rng.randrange(20) :][: rng.randrange(80, 131)] + word(rng.randrange(90))) for i in range(150)]
    rows += [(200, "ab" * 400), (201, "b" * 99 + "ab" * 200), (202, rows[3][1]), (202, rows[3][1]), (203, passage * 4), (204, word(99))]
    page = word(900)
    rows += [(300, "".join(word(50_000) + page for _ in range(7)) + rows[5][1]), (301, word(300) + page[100:400])]
    want = brute.repeats(rows)
    df = spark.createDataFrame(rows, "id long, text string").repartition(5)
    everything = suffix_dedup.hot_grams
    for bucket, hot, kind in ((3, False, "long"), (40, True, "long"), (25, True, "string")):
        monkeypatch.setattr(suffix_dedup, "BUCKET", bucket)
        b = next(_words.blocks(pa.array([r[1] for r in rows[:60]])))
        at, _, _ = suffix_dedup.anchors(b, 100, 24)
        grams = np.unique(_words.Hasher(b.data).of(at, at + 24)) if hot else np.zeros(0, np.uint64)
        monkeypatch.setattr(suffix_dedup, "hot_grams", lambda *a: grams)
        got = suffix_dedup.remove_repeats(df.select(F.lpad(F.col("id").cast("string"), 4, "0").cast(kind).alias("id"), "text")).collect()
        text = dict(rows)
        assert len(got) == len(rows)
        for r in got:
            assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[int(r.id), text[int(r.id)]], (bucket, r.id)
    assert len(everything(df.select("text", F.col("id").alias("doc")), 100, 24)) <= suffix_dedup.HOT


def test_multikey_sort():
    for seed in range(5):
        w = np.random.default_rng(seed).integers(0, 3, (400, 4)).astype(np.uint64)
        order, group = suffix_dedup.multikey_sort(w)
        r = [tuple(x) for x in w[order].tolist()]
        assert r == sorted(r) and all((group[i] == group[i + 1]) == (r[i] == r[i + 1]) for i in range(len(r) - 1))


# Quality ---------------------------------------------------------------------------


def test_quality(corpus, empty):
    df, rows = corpus
    docs = odd(df).withColumn("kept", F.lit("old"))
    out = quality.measure(docs, quality.references(docs, quality.Rules())).toPandas()
    assert len(out) == len(rows)
    want = Counter((nul(r[0]), *brute.quality(r[1])) for r in rows)
    assert Counter((nul(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out.itertuples()) == want
    failed = (out.n_words < 10) | (100 * out.n_repeat_words > 20 * out.n_words)
    assert (out.base_failed == failed).all() and not (out.kept & failed).any()
    none = quality.measure(empty, quality.references(empty, quality.Rules()))
    assert none.count() == 0


def test_quality_tells_junk(spark):
    rng = random.Random(4)
    plain = lambda: " ".join(rng.choice(["the", "of", "and", "house", "river%d" % rng.randrange(99), "green", "Walks."]) for _ in range(120))
    rows = [(i, plain(), "en") for i in range(60)] + [(100, plain().upper(), "en"), (101, plain().replace(" ", "%%% "), "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = quality.measure(df, quality.references(df, quality.Rules())).toPandas().set_index("doc_id")
    assert out.kept[out.index < 100].all() and not out.kept[100] and not out.kept[101]
    assert np.allclose(quality.js_distance(np.array([[1.0, 0]]), np.array([[0, 1.0]])), 1) and quality.js_distance(np.array([[2.0, 2]]), np.array([[1.0, 1]]))[0] == 0


def test_quality_common_words_are_exact(spark, corpus):
    df, rows = corpus
    rules = quality.Rules()
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        many = quality.references(df.repartition(30), rules)
        kept = Counter((nul(r.doc_id), r.kept) for r in quality.measure(df, many).collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    one = quality.references(df.repartition(1), rules)
    assert kept == Counter((nul(r.doc_id), r.kept) for r in quality.measure(df, one).collect())
    joined = quality.references(df, quality.Rules(max_languages=1))
    assert joined.tail.count() == 2 and kept == Counter((nul(r.doc_id), r.kept) for r in quality.measure(df, joined).collect())
    one, many = one.head, many.head
    for lang in ("en", "fr", "de", None):
        count = Counter(w for _, t, x, _ in rows if lang in (None, x) for w in brute.words(t, True))
        common = sorted((n for n in count.values() if n >= rules.word_share * sum(count.values())), reverse=True)
        for refs in (one, many):
            assert sorted(refs[lang][2][:-1].tolist(), reverse=True) == common and refs[lang][2].sum() == sum(count.values())
        assert (one[lang][0] == many[lang][0]).all() and (one[lang][1] == many[lang][1]).all()


# Near duplicates -------------------------------------------------------------------


def test_near_duplicates(corpus, empty):
    df, rows = corpus
    comp, sizes = brute.components([(r[0], r[1]) for r in rows])
    out = near_dup.cluster(odd(df)).toPandas()
    assert len(out) == len(rows)
    want = Counter((nul(r[0]), s, c) for r, s, c in zip(rows, sizes, comp))
    assert Counter((nul(r.doc_id), r.n_shingles, nul(r.component_id)) for r in out.itertuples()) == want
    kept = near_dup.deduplicate(odd(df)).toPandas()
    worded = kept[kept.text.map(lambda t: bool(brute.words(t)))]
    # Null ids count as smallest here, so a group with one keeps that row.
    groups = {}
    for r, s in zip(rows, sizes):
        if s:
            groups.setdefault(next(c for q, c in zip(rows, comp) if q is r), []).append(r)
    want = Counter(min(((r[0] is not None, r[0] or 0) for r in g)) for g in groups.values())
    assert Counter((nul(d) is not None, nul(d) or 0) for d in worded.doc_id) == want
    assert len(kept) - len(worded) == sum(not s for s in sizes)
    assert near_dup.cluster(empty).count() == 0 and near_dup.deduplicate(empty).count() == 0


@pytest.mark.parametrize("block", [256, 3])
def test_near_duplicates_random(spark, monkeypatch, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)
    rng = random.Random(11)
    rows = []
    for f in range(6):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(20, 120))]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(9999)}"
            rows.append((len(rows), " ".join(w[: rng.randrange(len(w) * 3 // 4, len(w) + 1)])))
    comp, sizes = brute.components(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.cluster(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {i: (s, c) for i, (s, c) in enumerate(zip(sizes, comp))}


def test_components(spark):
    links = [(i, i + 1) for i in range(0, 30)] + [(100, 101), (101, 102), (50, 50)]
    got = {r.node: r.component for r in _dist.components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}


# Decontamination -------------------------------------------------------------------


def test_decontamination(spark, corpus, empty):
    df, rows = corpus
    w = brute.TERM.findall(rows[2][1])
    items = [(1, " ".join(w[3:20]).upper()), (2, "one two"), (3, "never seen anywhere"), (4, None), (5, "..."), (6, rows[203 - 200 + 52][1]), (7, "x" * 70000), (8, "the"), (2, "the of")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for limit in (10**6, 3):
        out = decontaminate.contamination(odd(df), bench) if limit > 3 else None
        m = decontaminate.matches(decontaminate.index(df.select("text"), "text"), bench, block=limit)
        if out is None:
            assert m.count() == first
            continue
        first = m.count()
        got = out.toPandas()
        want = Counter((nul(r[0]), n, h, len(i), ",".join(i)) for r in rows for n, h, i in [brute.contamination(r[1], items)])
        assert Counter((nul(r.doc_id), r.n_words, r.n_hit, r.n_items, ",".join(r.items)) for r in got.itertuples()) == want
    clean = decontaminate.decontaminate(odd(df), bench)
    assert clean.count() == sum(not brute.contamination(r[1], items)[1] for r in rows)
    assert decontaminate.contamination(empty, bench).count() == 0
    assert not decontaminate.contamination(df, bench.limit(0)).where("contaminated").count()


def test_proximity(spark):
    rng = random.Random(7)
    texts = ["five four x three two one", "one two three four five", "one two"] + [" ".join(rng.choices("one two three four five x y".split(), k=rng.randrange(30))) for _ in range(80)]
    docs = decontaminate.index(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string"), "text")
    bench = spark.createDataFrame([(1, "one two three four five"), (2, "x x one")], "item_id long, text string")
    ids = {r.rid: r.id for r in docs.collect()}
    assert {ids[r.rid] for r in decontaminate.matches(docs, bench).collect() if r.item_id == 1} >= {1}
    for slack in (0, 2):
        want = set()
        for i, t in enumerate(texts):
            w = t.split()
            for item, words in ((1, "one two three four five".split()), (2, "x x one".split())):
                size = len(words) + slack
                want |= {(i, item, a, size) for a in range(-size, len(w)) if set(words) <= set(w[max(a, 0) : max(a + size, 0)])}
        got = [(ids[r.rid], r.item_id, r.start, r.len) for r in decontaminate.matches(docs, bench, slack=slack).collect()]
        assert set(got) == want and len(want) > 10


# Shared pieces ---------------------------------------------------------------------


def test_words():
    texts = ["a bb  ccc", "", None, "é ü\tz", "x" * 3_000_000, " lead", "trail "]
    got = []
    for b in _words.blocks(pa.array(texts)):
        w = _words.words(b, b.data, _words.SPACE)
        got += [[bytes(b.data[s:e]).decode() for s, e, t in zip(w.start, w.end, w.text) if t == i] for i in range(b.n)]
    assert got == [brute.words(t) for t in texts]


def test_prefix_sums(spark):
    df = spark.createDataFrame([(i % 7, i) for i in range(50)], "k long, v long")
    t = _dist.running_sum(_dist.row_numbers(_dist.numbered(df, F.col("k"), F.col("v"))), "v", "s").toPandas().sort_values("_row")
    want = sorted((i % 7, i) for i in range(50))
    assert list(zip(t.k, t.v)) == want and t.s.tolist() == list(itertools.accumulate(v for _, v in want)) and t._row.tolist() == list(range(50))


def test_checksums_match(spark):
    df = spark.createDataFrame([("é",), ("",)], "t string").select("t", F.crc32(F.encode("t", "UTF-8")).alias("c")).collect()
    assert all(r.c == zlib.crc32(r.t.encode()) for r in df)
    assert pd.DataFrame({"a": [1]}).shape == (1, 1)


def test_join_hot(spark):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else 7 if i % 3 else i) for i in range(600)], "id long, k long")
    table = rows.where("k is not null and k <> 9").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last"))
    got = {r.id: (r.k, r.last) for r in _dist.join_hot(rows, table, "k", "n", rows.count()).collect()}
    last = {r.k: r.last for r in table.collect()}
    assert table.agg(F.max("n")).first()[0] > 64
    assert got == {r.id: (r.k, last.get(r.k)) for r in rows.collect()}


def test_chat_sentinel_is_free(spark):
    """Private-use characters in texts, with a renderer that blanks all but two turns."""

    def forgetful(turns):
        return "".join(f"<{r}>{t if i >= len(turns) - 2 else ''}</{r}>\n" for i, (r, t) in enumerate(turns))

    turns = [("u", "a"), ("a", "b"), ("u", "c"), ("a", "d")]
    text, found, rewritten = chat.spans(turns, forgetful)
    assert text == forgetful(turns) and rewritten == [2, 3]
    assert found[:2] == [(0, 0), (0, 0)] and [text[a:b] for a, b in found[2:]] == ["c", "d"]
    assert chat.sentinel([("a", "")]) == ""
    every = "".join(map(chr, [*range(0xE000, 0xF900), *range(0xF0000, 0xFFFFE), *range(0x100000, 0x10FFFE)]))
    assert chat.sentinel([("a", every + "")]) == "" * 3


def test_chat_frames_need_agreement():
    """A renderer whose frame depends on the text, or on the turn's place, is probed."""
    sized = lambda turns: "".join(f"[{len(t)}]{t};" for _, t in turns)
    placed = lambda turns: "".join(f"{i}:{t}\n" for i, (_, t) in enumerate(turns))
    turns = [("u", "abc"), ("a", "[3]"), ("u", ""), ("a", "0:x"), ("u", "abc")]
    for render in (placed, chat.template):
        text, found, rewritten = chat.spans(turns, render)
        assert text == render(turns) and not rewritten and [text[a:b] for a, b in found] == [t for _, t in turns] or render is chat.template
    assert chat.frames(turns, placed, "") is None and chat.frames(turns, chat.template, "") is not None
    assert chat.spans(turns, sized)[0] == sized(turns)


def test_chat_long_conversation(spark):
    """2,000 turns, every prefix rendered."""
    import time

    rows = [(1, i, "user" if i % 2 == 0 else "assistant", f"turn {i} # " + "x" * 190) for i in range(2000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    began = time.time()
    out = chat.format_conversations(df).first()
    assert out["n_turns"] == 2000 and chat.parse(out["formatted"]) == [(r, t) for *_, r, t in rows]
    assert time.time() - began < 25


def test_pii_copies_of_a_list(spark):
    """Copies of a long address list: entities and words of the same texts are one each,
    and every term is still found."""
    names = [f"{a}{b}name" for a in "abcdefghij" for b in "abcdefghij"]
    people = " ".join(f"{n.capitalize()} <{n}@mail.example>" for n in names)
    rows = [(i, people + f" copy {i}") for i in range(4)] + [(10 + i, "nothing but plain common words here " + "abc " * i) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.sanitise(df).collect()}
    for i in range(4):
        terms = {s["value"] for s in got[i]["spans"] if s["kind"] == "term"}
        assert {n.capitalize() for n in names} <= terms and len(got[i]["found"]) == 100
    assert all(not got[10 + i]["spans"] for i in range(60))
