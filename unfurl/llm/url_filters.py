"""URL filters: a path-template tree per host.

Paths are cut into segments and lexically variable ones (numbers, hashes, dates)
become `*`. Then, from the root of each host down, wherever paths branch:

- children with labels whose blocked rate cannot be told from that of their labelled
  siblings merge into `*`; those that differ keep their own branch, however many
  children there are;
- a child without labels joins `*` if it looks like one that merged (the same
  segments, or as many different ones, follow it); else all of them merge if they are
  very many for their visits, or three and more that look alike do, into branches of
  their own.

A template is rejected when its smoothed labelled purity, (blocked + strength *
prior) / (labelled + strength), reaches the limit; a template without labels takes
the purity of its nearest ancestor that has some, and is never rejected where its
host has none. Explicit rules, longest first, decide before the tree, and their
verdicts are the tree's labels.

DataFrame operations only. All statistics are aggregates over (host, template)
with partial aggregation, so a host with a third of all pages shrinks to its
distinct generalised paths before any shuffle. Null urls and urls without `://`
have an empty host and path, no rule, and the verdict of the root template. Repeated
rows each get a row and count as visits; paths may be of any length; other columns may
have any names, those of the result are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._dist import spill, temporary

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed rules of the registered query: host and path, verdict.
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)


@dataclass(frozen=True)
class Tree:
    depth: int | None = None  # segments kept apart; None for all
    max_children: int = 50
    distinct_share: float = 0.5
    shape_width: int = 16  # children with more segments after them all look alike
    least_alike: int = 3  # unlabelled children that have to look alike to merge
    z_limit: float = 3.0
    strength: float = 4.0
    purity_limit: float = 0.8


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(2147483647))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.lit(2147483647)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_of(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule, verdict) of the longest fitting rule; null where none fits. rules
    is configuration held by the driver, so it becomes one CASE expression."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: len(r[0])):
        h, _, p = rule.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def segments(path: Column, depth: int | None = None) -> Column:
    """Lexically generalised segments; with a depth, at most that many, deeper
    ones folded into a last `**`."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    digits = r"[0-9]+"
    general = F.transform(
        parts,
        lambda s: F.when(s.rlike(r"^[0-9a-fA-F]{8}-?([0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}$|^[0-9a-fA-F]{16,}$"), F.lit("*")).otherwise(
            F.regexp_replace(s, digits, "*")
        ),
    )
    if depth is None:
        return general
    return F.when(F.size(general) > depth, F.concat(F.slice(general, 1, depth), F.array(F.lit("**")))).otherwise(general)


def common(lo: Column, hi: Column) -> Column:
    """How many first items the least and the largest of some arrays, and so all of
    them, have in common."""
    least = F.least(F.size(lo), F.size(hi))
    same = F.transform(F.slice(lo, 1, least), lambda s, i: s == F.get(hi, i))
    return F.when(F.array_position(same, False) > 0, F.array_position(same, False) - 1).otherwise(least).cast("int")


def jumped(cur: DataFrame) -> DataFrame:
    """Every path moved down the run of segments that all paths of its node share.
    Paths that end there, or are their node's only ones, are done."""
    nodes = cur.groupBy("host", "template").agg(F.sum("lab").alias("nl"), F.sum("bad").alias("nb"), F.min("rest").alias("lo"), F.max("rest").alias("hi"))
    nodes = nodes.select("host", "template", "nl", "nb", common(F.col("lo"), F.col("hi")).alias("run"))
    left = F.slice("rest", F.col("run") + 1, F.greatest(F.size("rest") - F.col("run"), F.lit(0)))
    way = F.concat("template", F.when(F.col("run") > 0, F.concat(F.lit("/"), F.array_join(F.slice("rest", 1, F.col("run")), "/"))).otherwise(F.lit("")))
    return cur.join(nodes, ["host", "template"]).select(
        "host", "segs", "n", "lab", "bad", left.alias("rest"), way.alias("template"),
        F.when(F.col("nl") > 0, F.col("nl")).otherwise(F.col("near_lab")).alias("near_lab"),
        F.when(F.col("nl") > 0, F.col("nb")).otherwise(F.col("near_bad")).alias("near_bad"),
        (F.size("rest") == F.col("run")).alias("done"),
    )


def descended(here: DataFrame, cfg: Tree) -> DataFrame:
    """Every path moved to its child, or to the branch that its child merges into."""
    here = here.withColumn("seg", F.get("rest", F.lit(0)))
    node, nxt = ["host", "template"], F.coalesce(F.get("rest", F.lit(1)), F.lit("/"))
    grand = here.groupBy(*node, "seg", nxt.alias("next")).agg(F.sum("n").alias("n"), F.sum("lab").alias("lab"), F.sum("bad").alias("bad"))
    child = grand.groupBy(*node, "seg").agg(
        F.sum("n").alias("cn"), F.sum("lab").alias("cl"), F.sum("bad").alias("cb"), F.count(F.lit(1)).alias("width"), F.bit_xor(F.xxhash64("next")).alias("names")
    )
    shape = F.when(F.col("width") > cfg.shape_width, F.lit("wide")).otherwise(F.substring(F.sha2(F.concat_ws(":", "width", "names"), 256), 1, 8))
    child = child.select(*node, "seg", "cn", "cl", "cb", shape.alias("shape"))
    fresh = F.when(F.col("cl") == 0, 1)
    total = child.groupBy(*node).agg(
        F.count(fresh).alias("kids"), F.coalesce(F.sum(F.when(F.col("cl") == 0, F.col("cn"))), F.lit(0)).alias("pn"), F.sum("cl").alias("pl"), F.sum("cb").alias("pb")
    )
    both = child.join(total, node)
    rest_l, rest_b = F.col("pl") - F.col("cl"), F.col("pb") - F.col("cb")
    pooled = F.col("pb") / F.greatest(F.col("pl"), F.lit(1))
    spread = F.sqrt(pooled * (1 - pooled) * (1 / F.greatest(F.col("cl"), F.lit(1)) + 1 / F.greatest(rest_l, F.lit(1))))
    gap = F.abs(F.col("cb") / F.greatest(F.col("cl"), F.lit(1)) - rest_b / F.greatest(rest_l, F.lit(1)))
    alike = (F.col("cl") > 0) & (rest_l > 0) & ((spread == 0) | (gap <= cfg.z_limit * spread))
    both = both.withColumn("alike", alike)
    shapes = both.groupBy(*node, "shape").agg(F.max("alike").alias("joins"), F.count(fresh).alias("same"))
    many = (F.col("kids") > cfg.max_children) & (F.col("kids") > cfg.distinct_share * F.col("pn"))
    unlabelled = (
        F.when(F.col("joins"), F.lit("*")).when(many, F.lit("*~")).when(F.col("same") >= cfg.least_alike, F.concat(F.lit("*~"), "shape")).otherwise(F.col("seg"))
    )
    kept = F.when(F.col("cl") == 0, unlabelled).when(F.col("alike"), F.lit("*")).otherwise(F.col("seg"))
    moves = both.join(shapes, [*node, "shape"]).select(*node, "seg", kept.alias("kept"))
    return here.join(moves, [*node, "seg"]).select(
        "host", "segs", "n", "lab", "bad", F.slice("rest", 2, F.greatest(F.size("rest") - 1, F.lit(0))).alias("rest"),
        F.concat("template", F.lit("/"), "kept").alias("template"), "near_lab", "near_bad",
    )


def build_tree(paths: DataFrame, cfg: Tree = Tree()) -> DataFrame:
    """paths: host, segs, label (1 blocked, 0 allowed, null unlabelled), one row
    per page. Returns one row per (host, segs): template, purity, rejected.

    One table is written for each level at which paths of some host still branch;
    runs of segments that do not branch are passed in one step."""
    with temporary(paths.sparkSession):
        leaves = spill(
            paths.groupBy("host", "segs").agg(
                F.count(F.lit(1)).alias("n"), F.count("label").alias("lab"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("bad")
            ),
            "leaves",
        )
        # near_lab, near_bad: labels of the deepest labelled node on the way so far.
        none = F.lit(0).cast("long")
        cur = leaves.select("*", F.col("segs").alias("rest"), F.lit("").alias("template"), none.alias("near_lab"), none.alias("near_bad"))
        levels = []
        while True:
            levels.append(spill(jumped(cur), "level"))
            here = levels[-1].where("not done")
            if here.isEmpty():
                break
            cur = descended(here.drop("done"), cfg)
        ended = levels[0].where("done")
        for level in levels[1:]:
            ended = ended.union(level.where("done"))
        total = leaves.agg(F.sum("lab"), F.sum("bad")).first()
        prior = (total[1] + 1) / (total[0] + 2) if total[0] else 0.5
        stats = ended.groupBy("host", "template").agg(F.sum("lab").alias("own_lab"), F.sum("bad").alias("own_bad"))
        own = F.col("own_lab") > 0
        lab, bad = F.when(own, F.col("own_lab")).otherwise(F.col("near_lab")), F.when(own, F.col("own_bad")).otherwise(F.col("near_bad"))
        purity = (bad + cfg.strength * prior) / (lab + cfg.strength)
        tree = ended.join(stats, ["host", "template"]).select(
            "host", "segs", "template", purity.alias("purity"), ((lab > 0) & (purity >= cfg.purity_limit)).alias("rejected")
        )
        return spill(tree, "tree", keep=True)


def judge_urls(df: DataFrame, url: str = "url", rules=RULES, cfg: Tree = Tree()) -> DataFrame:
    """df with host, path, rule, verdict, template and purity; input columns of
    those names are replaced."""
    out = ["host", "path", "rule", "verdict", "template", "purity"]
    kept = [c for c in df.columns if c not in out]
    host, path = host_and_path(F.col(f"`{url}`"))
    rows = df.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(kept)], host.alias("host"), path.alias("path"))
    name, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "says": says, "segs": segments(F.col("path"), cfg.depth)})
    tree = build_tree(rows.select("host", "segs", F.when(F.col("says") == "block", 1).when(F.col("says") == "allow", 0).alias("label")), cfg)
    joined = rows.join(tree, ["host", "segs"], "left")
    verdict = F.coalesce("says", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow")))
    return joined.select(
        *[F.col(f"in_{i}").alias(c) for i, c in enumerate(kept)], "host", "path", "rule", verdict.alias("verdict"), "template", "purity"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge_urls(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "template", "purity")
