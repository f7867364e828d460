"""The path-template tree against a slow one, and paths that are long or do not branch."""

import os
import random
import re
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from unfurl.llm import url_filters as U

RULES = U.RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule_of(host, path):
    fits = [(r, v) for r, v in RULES for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return max(fits, key=lambda x: len(x[0]), default=(None, None))


def segments(path):
    out = []
    for s in path.split("/"):
        if s:
            whole = re.search(r"^[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}$|^[0-9a-fA-F]{16,}$", s)
            out.append("*" if whole else re.sub("[0-9]+", "*", s))
    return tuple(out)


def slow_tree(leaves, cfg=U.Tree()):
    """{segs: (n, lab, bad)} of one host. {segs: (class, labels of the template or of its
    nearest labelled ancestor)}; a class is a template, shapes named by what they hold."""
    out = {}

    def walk(paths, depth, template, near):
        """paths: {segs: (rest, n, lab, bad)}"""
        lab, bad = sum(p[2] for p in paths.values()), sum(p[3] for p in paths.values())
        near = (lab, bad) if lab else near
        if len({p[0] for p in paths.values()}) == 1:
            for s, (rest, *_) in paths.items():
                out[s] = (template + rest, near)
            return
        kids = defaultdict(dict)
        for s, (rest, *v) in paths.items():
            if rest:
                kids[rest[0]][s] = (rest[1:], *v)
            else:
                out[s] = (template, near)
        if not kids:
            return
        stat = {k: tuple(sum(p[i] for p in c.values()) for i in (1, 2, 3)) for k, c in kids.items()}
        pl, pb = sum(x[1] for x in stat.values()), sum(x[2] for x in stat.values())
        names = {k: frozenset(p[0][0] if p[0] else None for p in c.values()) for k, c in kids.items()}
        shape = {k: "wide" if len(x) > cfg.shape_width else x for k, x in names.items()}
        fresh = [k for k in kids if stat[k][1] == 0]

        def alike(k):
            _, cl, cb = stat[k]
            rl, rb = pl - cl, pb - cb
            if not cl or not rl:
                return False
            p = pb / max(pl, 1)
            spread = (p * (1 - p) * (1 / max(cl, 1) + 1 / max(rl, 1))) ** 0.5
            return spread == 0 or abs(cb / max(cl, 1) - rb / max(rl, 1)) <= cfg.z_limit * spread

        joins = {shape[k] for k in kids if alike(k)}
        visits = sum(stat[k][0] for k in fresh)
        many = len(fresh) > cfg.max_children and len(fresh) > cfg.distinct_share * visits
        merged = defaultdict(dict)
        for k, c in kids.items():
            same = sum(shape[x] == shape[k] for x in fresh)
            if stat[k][1]:
                name = "*" if alike(k) else k
            else:
                name = "*" if shape[k] in joins else "*~" if many else ("*~", shape[k]) if same >= cfg.least_alike else k
            merged[name].update(c)
        for name, c in merged.items():
            walk(c, depth + 1, (*template, name), near)

    # The run that all share is passed first, as a single child would be.
    walk({s: (s, *v) for s, v in leaves.items()}, 0, (), (0, 0))
    return out


def slow_judge(urls, cfg=U.Tree()):
    """[(host, path, rule, verdict, class)] of each url."""
    rows = []
    for u in urls:
        host, path = parts(u)
        rule, says = rule_of(host, path)
        rows.append((host, path, rule, says, segments(path)))
    hosts = defaultdict(lambda: defaultdict(lambda: [0, 0, 0]))
    for host, _, _, says, segs in rows:
        v = hosts[host][segs]
        v[0] += 1
        v[1] += says is not None
        v[2] += says == "block"
    lab = sum(v[1] for h in hosts.values() for v in h.values())
    bad = sum(v[2] for h in hosts.values() for v in h.values())
    prior = (bad + 1) / (lab + 2) if lab else 0.5
    found = {}
    for host, leaves in hosts.items():
        tree = slow_tree(leaves, cfg)
        own = defaultdict(lambda: [0, 0])
        for s, (name, _) in tree.items():
            own[name][0] += leaves[s][1]
            own[name][1] += leaves[s][2]
        for s, (name, near) in tree.items():
            n, b = own[name] if own[name][0] else near
            found[host, s] = (name, n > 0 and (b + cfg.strength * prior) / (n + cfg.strength) >= cfg.purity_limit)
    return [(h, p, r, says or ("block" if found[h, s][1] else "allow"), (h, found[h, s][0])) for h, p, r, says, s in rows]


def same(spark, urls, cfg=U.Tree()):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    got = {r["page_id"]: r for r in U.judge_urls(df, cfg=cfg).collect()}
    want = slow_judge(urls, cfg)
    assert len(got) == len(urls)
    names = {}
    for i, (host, path, rule, verdict, name) in enumerate(want):
        r = got[i]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict), (urls[i], r)
        assert names.setdefault((host, r["template"]), name) == name  # one template, one class
    assert len(set(names.values())) == len(names)
    return want


def test_random_trees(spark):
    rng = random.Random(2)
    hosts = ["a.com", "b.com", "x.org", "example.org", "c.net"]
    urls = [None, "no url", "http://a.com", "http://a.com/"]
    for _ in range(500):
        first = rng.choice(["de", "fr", "en", "es", "w%d" % rng.randrange(30), "abcdefgh"[rng.randrange(8)]])
        deep = [rng.choice(["a", "b", "view", "edit", "x" * rng.randrange(1, 4), str(rng.randrange(99))]) for _ in range(rng.randrange(4))]
        urls.append(f"http://{rng.choice(hosts)}/" + "/".join([first, *deep]))
    want = same(spark, urls + urls[:50])
    assert sum(w[2] is None and w[3] == "block" for w in want) > 0 and len({w[4] for w in want}) > 20


@pytest.mark.parametrize("allowed", [45, 55])
def test_labelled_siblings_are_not_folded(spark, allowed):
    """Blocked pages below one segment beside allowed ones below many: all are told apart,
    whether there are more or less than max_children."""
    name = lambda i: "n" + "abcdefghij"[i // 10] + "abcdefghij"[i % 10]
    rows = [("h.net", f"/spam/{name(i)}", 1) for i in range(50)] + [("h.net", f"/{name(i)}/{name(i)}", 0) for i in range(allowed)]
    df = spark.createDataFrame(rows, "host string, path string, label int")
    tree = U.build_tree(df.select("host", U.segments(F.col("path")).alias("segs"), "label")).collect()
    assert all(r["rejected"] == (r["segs"][0] == "spam") for r in tree) and len(tree) == 50 + allowed


def test_unlabelled_pages_follow_their_like(spark):
    """Unlabelled branches join labelled ones of the same shape, others do not."""
    name = lambda i: "abcdefghijklmnopqrst"[i] * 2
    rows = [("h.net", f"/shop/{name(i)}/{x}", 1) for i in range(10) for x in ("buy", "pay")] + [("h.net", f"/shop/{name(i)}/{x}", None) for i in range(10, 14) for x in ("buy", "pay")]
    rows += [("h.net", f"/docs/{name(i)}", 0) for i in range(12)] + [("h.net", f"/shop/{name(i)}/read", None) for i in range(15, 19)]
    df = spark.createDataFrame(rows, "host string, path string, label int")
    got = {tuple(r["segs"]): r for r in U.build_tree(df.select("host", U.segments(F.col("path")).alias("segs"), "label")).collect()}
    assert got["shop", "kk", "buy"]["template"] == got["shop", "aa", "buy"]["template"] == "/shop/*/*" and got["shop", "kk", "buy"]["rejected"]
    assert len({got["shop", name(i), "read"]["template"] for i in range(15, 19)}) == 1 and got["shop", "pp", "read"]["template"] not in ("/shop/*/read", "/shop/*/*")
    assert not got["docs", "aa"]["rejected"]


def test_long_paths(spark):
    """Runs of 300 equal segments are one step; so is a very long segment."""
    run = "/".join(f"s{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300))
    urls = [f"http://a.com/{run}/x", f"http://a.com/{run}/y/{run}", f"http://b.com/{run}", "http://b.com/" + "z" * 50000, "http://c.org/" + "/" * 1000]
    began = time.time()
    same(spark, urls)
    assert time.time() - began < 30


def test_clashing_names_and_empty(spark):
    df = spark.createDataFrame([(1, "http://a.com/de/x", "h", 1, 2)], "page_id long, url string, host string, n long, rest int")
    row = U.judge_urls(df).first()
    assert (row["host"], row["n"], row["rest"], row["verdict"]) == ("a.com", 1, 2, "block")
    assert U.judge_urls(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables here")
def test_query(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url").collect()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.query(spark, "/root/testdata/sf0.001").collect()}
    assert got == {p["page_id"]: w[:4] for p, w in zip(pages, slow_judge([p["url"] for p in pages]))}
