"""LM scoring by prediction by partial matching (PPM).

A byte-context trie of order 3 is trained on the corpus: one scan counts all
(three bytes, next byte) edges, lower orders are their sums. Escape estimation
is method C (as many escapes as distinct symbols seen), with symbol exclusion:
a shorter context is asked only about symbols the longer one has not seen. As
the pretrained trie does not change while scoring, every node's distribution
over the next byte is worked out once, so scoring is one table look-up a byte.
All order-2 nodes (65,536 at most) and at most max_contexts of the frequent
order-3 nodes are broadcast, with a bit for each other order-3 node; those are
looked up by a join on the context, so max_contexts changes no score.
adaptive_score() is the other mode: the trie starts empty and learns from the
text itself.

Beside it stands an add-0.1 word model, scored exactly: words of at least a
count that at most head_words words reach are broadcast, the others are looked
up by a join on the word's hash.

Null texts are empty: one end token. Null ids count as the empty string. Every
row gets a row; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words
from ._dist import spill, temporary

ORDER, START, END = 3, 0xFE, 0xFF  # neither byte occurs in UTF-8
MAX_CONTEXTS, HEAD_WORDS = 32_000, 300_000


def framed(b: _words.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with three START before and END after every text, places of the
    symbols to predict, text of each)."""
    sizes = np.diff(b.offsets)
    text = np.repeat(np.arange(b.n), sizes)
    out = np.full(len(b.data) + (ORDER + 1) * b.n, START, np.uint8)
    at = np.arange(len(b.data)) + (ORDER + 1) * text + ORDER
    ends = b.offsets[1:] + (ORDER + 1) * np.arange(1, b.n + 1) - 1
    out[at], out[ends] = b.data, END
    places = np.flatnonzero(out != START)
    return out, places, np.repeat(np.arange(b.n), sizes + 1)


def contexts(out: np.ndarray, at: np.ndarray) -> np.ndarray:
    o = out.astype(np.uint32)
    return (o[at - 3] << 16) | (o[at - 2] << 8) | o[at - 1]


def gather(docs: DataFrame) -> DataFrame:
    """(kind, key, n) over all training texts: 'w' word hashes, 'g' edges of the
    trie, 'd' texts. Counts are summed per batch before the shuffle."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list] = {"w": [], "g": []}
            for b in _words.blocks(batch.column(0)):
                held["w"].append(np.unique(_words.words(b, _words.lower(b.data), _words.SPACE).hash.view(np.int64), return_counts=True))
                out, at, _ = framed(b)
                held["g"].append(np.unique((contexts(out, at) << np.uint32(8)) | out[at], return_counts=True))
            yield pa.RecordBatch.from_arrays([pa.array(["d"]), pa.array([0], pa.int64()), pa.array([batch.num_rows], pa.int64())], ["kind", "key", "n"])
            for kind, parts in held.items():
                if not parts:
                    continue
                keys, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(inv, weights=np.concatenate([p[1] for p in parts]), minlength=len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([kind] * len(keys)), pa.array(keys.astype(np.int64)), pa.array(n)], ["kind", "key", "n"])

    return docs.select("text").mapInArrow(scan, "kind string, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


@dataclass
class Trie:
    """Row of each context and log10 P(next byte) of each row. Row 0 of an index
    means no such node, so the next shorter context is asked; row -1 means an
    order-3 node that is not held here (a bit in rest, 32 contexts a word)."""

    keys3: np.ndarray
    keys2: np.ndarray
    keys1: np.ndarray
    logp: np.ndarray
    rest: np.ndarray
    least: int  # how often a context must be seen to be held here

    @cached_property
    def indexes(self) -> list[np.ndarray]:
        """Row by context, order 3 first; built where it is used."""
        out, row = [], 1
        for keys, bits in ((self.keys1, 8), (self.keys2, 16), (self.keys3, 24)):
            index = np.zeros(1 << bits, np.int32)
            index[keys] = row + np.arange(len(keys))
            row += len(keys)
            out.insert(0, index)
        if len(self.rest):
            out[0][np.flatnonzero(np.unpackbits(self.rest.view(np.uint8), bitorder="little"))] = -1
        return out

    def score(self, b: _words.Block) -> np.ndarray:
        return self.look_up(b)[0]

    def look_up(self, b: _words.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score of each text but for symbols after contexts in rest, text and
        edge (context << 8 | symbol) of each of those)."""
        out, at, text = framed(b)
        ctx = contexts(out, at)
        index3, index2, index1 = self.indexes
        row = index3[ctx]
        for index, mask in ((index2, 0xFFFF), (index1, 0xFF)):
            none = np.flatnonzero(row == 0)
            row[none] = index[ctx[none] & np.uint32(mask)]
        far = row < 0
        score = np.bincount(text, weights=np.where(far, 0, self.logp[row, out[at]]), minlength=b.n)
        return score, text[far], (ctx[far].astype(np.int64) << 8) | out[at[far]]


def distributions(levels: list[np.ndarray]) -> np.ndarray:
    """log10 P per row, from counts at each order, longest first (rows, 256)."""
    rows = levels[0].shape[0]
    p, left, out = np.zeros((rows, 256)), np.ones((rows, 1)), np.zeros((rows, 256), bool)
    for c in levels:
        c = np.where(out, 0, c)
        n, d = c.sum(1, keepdims=True), (c > 0).sum(1, keepdims=True)
        p += left * c / np.maximum(n + d, 1)
        left = left * np.where(n > 0, d / np.maximum(n + d, 1), 1)
        out |= c > 0
    p += left * ~out / np.maximum((~out).sum(1, keepdims=True), 1)
    return np.log10(p / p.sum(1, keepdims=True)).astype(np.float32)


def train_trie(edges: DataFrame, max_contexts: int = MAX_CONTEXTS) -> Trie:
    """edges: key (context << 8 | symbol), n. To the driver come the edges of at
    most max_contexts order-3 nodes and of the order-2 nodes, and a bit for every
    other order-3 node (2 MB)."""
    ctx = edges.groupBy(F.shiftright("key", 8).alias("ctx")).agg(F.sum("n").alias("total"))
    sizes = ctx.groupBy(F.log2("total").cast("int").alias("b")).count().orderBy(F.desc("b")).collect()
    least, total = 0, 0
    for b, count in sizes:
        total += count
        if total > max_contexts:
            least = 2 ** (b + 1)
            break
    kept = edges.join(ctx.where(F.col("total") >= least), F.shiftright("key", 8) == F.col("ctx")).select("key", "n").toPandas()
    bits = ctx.where(F.col("total") < least).groupBy(F.shiftright("ctx", 5).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(ctx & 31 as int))")).alias("bits")
    )
    rest = np.zeros(0, np.uint32)
    if least:
        found = bits.toPandas()
        rest = np.zeros(1 << 19, np.uint32)
        rest[found["at"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    low = edges.groupBy(F.col("key").bitwiseAND(0xFFFFFF).alias("key")).agg(F.sum("n").alias("n")).toPandas()

    def matrix(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nodes, inv = np.unique(keys >> 8, return_inverse=True)
        # Single precision only while it holds every count and sum exactly.
        m = np.zeros((len(nodes), 256), np.float32 if n.sum() < 2**24 else np.float64)
        np.add.at(m, (inv, keys & 0xFF), n)
        return nodes, m

    k2, n2 = low["key"].to_numpy(np.int64), low["n"].to_numpy(np.float64)
    c2, m2 = matrix(k2, n2)
    c1, m1 = matrix(k2 & 0xFFFF, n2)
    m0 = m1.sum(0, keepdims=True)
    c3, m3 = matrix(kept["key"].to_numpy(np.int64), kept["n"].to_numpy(np.float64))
    parts = [distributions([m0])]
    of2 = {int(c): i for i, c in enumerate(c2)}
    of1 = {int(c): i for i, c in enumerate(c1)}
    for lo in range(0, len(c1), 2048):
        parts.append(distributions([m1[lo : lo + 2048], m0]))
    for lo in range(0, len(c2), 2048):
        up = [of1[int(c) & 0xFF] for c in c2[lo : lo + 2048]]
        parts.append(distributions([m2[lo : lo + 2048], m1[up], m0]))
    for lo in range(0, len(c3), 2048):
        some = c3[lo : lo + 2048]
        parts.append(distributions([m3[lo : lo + 2048], m2[[of2[int(c) & 0xFFFF] for c in some]], m1[[of1[int(c) & 0xFF] for c in some]], m0]))
    return Trie(c3, c2, c1, np.concatenate(parts), rest, least)


def far_edges(edges: DataFrame, asked: DataFrame, least: int) -> DataFrame:
    """(key, logp) of every asked edge (key: context << 8 | symbol) whose context
    was seen, but less than least times: what distributions() gives its node."""
    spark = edges.sparkSession
    low = edges.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("key")).agg(F.sum("n").alias("n")).collect()
    m1 = np.zeros((256, 256))
    for r in low:
        m1[r["key"] >> 8, r["key"] & 0xFF] = r["n"]
    m0 = m1.sum(0, keepdims=True)
    shared = spark.sparkContext.broadcast((m1, m0))

    def nodes(df: DataFrame, name: str) -> DataFrame:
        symbol, ctx = F.col("key").bitwiseAND(0xFF).cast("int"), F.shiftright("key", 8)
        return df.groupBy(ctx.alias(name)).agg(F.sum("n").alias("total"), F.collect_list(F.struct(symbol.alias("s"), F.col("n").alias("n"))).alias("e"))

    three = nodes(edges, "ctx").where(F.col("total") < least).select(
        "ctx", F.col("ctx").bitwiseAND(0xFFFF).alias("ctx2"), F.col("e.s").alias("s3"), F.col("e.n").alias("n3")
    )
    two = nodes(edges.groupBy(F.col("key").bitwiseAND(0xFFFFFF).alias("key")).agg(F.sum("n").alias("n")), "ctx2").select(
        "ctx2", F.col("e.s").alias("s2"), F.col("e.n").alias("n2")
    )
    wanted = asked.select("key").distinct().groupBy(F.shiftright("key", 8).alias("ctx")).agg(F.collect_list("key").alias("keys"))
    rows = wanted.join(three, "ctx").join(two, "ctx2").select("ctx", "keys", "s3", "n3", "s2", "n2")

    def matrix(s: pa.Array, n: pa.Array) -> np.ndarray:
        m = np.zeros((len(s), 256))
        row = np.repeat(np.arange(len(s)), np.diff(s.offsets.to_numpy()))
        m[row, s.flatten().to_numpy(zero_copy_only=False)] = n.flatten().to_numpy(zero_copy_only=False)
        return m

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m1, m0 = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                ctx, keys, s3, n3, s2, n2 = batch.slice(lo, 2048).columns
                ctx = ctx.to_numpy(zero_copy_only=False)
                logp = distributions([matrix(s3, n3), matrix(s2, n2), m1[ctx & 0xFF], m0])
                row, key = np.repeat(np.arange(len(ctx)), np.diff(keys.offsets.to_numpy())), keys.flatten().to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(logp[row, key & 0xFF].astype(np.float64))], ["key", "logp"])

    return rows.mapInArrow(scan, "key long, logp double")


def adaptive_score(text: str | None, order: int = ORDER) -> float:
    """log10 probability of a text and its end by a trie that starts empty and
    learns each byte after predicting it (method C with exclusion)."""
    seen: dict[bytes, dict[int, int]] = {}
    data, total = bytes([START]) * order + (text or "").encode() + bytes([END]), 0.0
    for i in range(order, len(data)):
        s, p, out = data[i], 1.0, set()
        for k in range(order, -1, -1):
            c = {x: n for x, n in seen.get(data[i - k : i], {}).items() if x not in out}
            if not c:
                continue
            whole = sum(c.values()) + len(c)
            if s in c:
                p *= c[s] / whole
                break
            p *= len(c) / whole
            out |= c.keys()
        else:
            p /= 256 - len(out)
        total += math.log10(p)
        for k in range(order + 1):
            node = seen.setdefault(data[i - k : i], {})
            node[s] = node.get(s, 0) + 1
    return total


def score(docs: DataFrame, held_out: Column, max_contexts: int = MAX_CONTEXTS, head_words: int = HEAD_WORDS) -> DataFrame:
    """docs (doc_id, text) with held_out, n_tokens, n_known, train_tokens,
    base_score and score, learning from the rows that are not held out."""
    with temporary(docs.sparkSession):
        return spill(_score(docs, held_out, max_contexts, head_words), "scores", keep=True)


def _score(docs: DataFrame, held_out: Column, max_contexts: int, head_words: int) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", held_out.alias("held_out"))
    counts = spill(gather(rows.where(~F.col("held_out"))), "counts")
    edges = counts.where("kind = 'g'").select("key", "n")
    trie = train_trie(edges, max_contexts)
    words = counts.where("kind = 'w'").select("key", "n")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ends = counts.where("kind = 'd'").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n, v = n + ends, v + (ends > 0)
    least, total = 1, 0
    for b, count in words.groupBy(F.log2("n").cast("int").alias("b")).count().orderBy(F.desc("b")).collect():
        total += count
        if total > head_words:
            least = 2 ** (b + 1)
            break
    frequent = words.where(F.col("n") >= least).toPandas().sort_values("key")
    shared = spark.sparkContext.broadcast((trie, frequent["key"].to_numpy(np.int64), frequent["n"].to_numpy(np.int64)))
    end_log = math.log10(ends + 0.1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, head, head_n = shared.value
        head_log = np.log10(head_n + 0.1)
        for batch in batches:
            for b in _words.blocks(batch.column(1)):
                w = _words.words(b, _words.lower(b.data), _words.SPACE)
                u, inv = np.unique(w.hash.view(np.int64), return_inverse=True)
                at = np.minimum(np.searchsorted(head, u), max(len(head) - 1, 0))
                hit = (head[at] == u) if len(head) else np.zeros(len(u), bool)
                value = np.where(hit, head_log[at], 0.0) if len(head) else np.zeros(len(u))
                base = np.bincount(w.text, weights=value[inv], minlength=b.n) + end_log
                known = np.bincount(w.text, weights=hit[inv], minlength=b.n).astype(np.int64) + int(ends > 0)
                rare = np.flatnonzero(~hit[inv])
                pair = w.text[rare].astype(np.int64) * len(u) + inv[rare]
                pair, times = np.unique(pair, return_counts=True)
                cut = np.searchsorted(pair // max(len(u), 1), np.arange(b.n + 1)).astype(np.int32)
                score, far_text, far_key = trie.look_up(b)
                edge, edge_at = np.unique(far_key, return_inverse=True)
                far, far_times = np.unique(far_text * max(len(edge), 1) + edge_at, return_counts=True)
                far_cut = np.searchsorted(far // max(len(edge), 1), np.arange(b.n + 1)).astype(np.int32)
                rows = slice(b.first, b.first + b.n)
                yield pa.RecordBatch.from_arrays(
                    [
                        *[batch.column(i)[rows] for i in (0, 2, 3)],
                        pa.array(w.count.astype(np.int64) + 1),
                        pa.array(known),
                        pa.array(base),
                        pa.array(score),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array(u[pair % max(len(u), 1)] if len(pair) else np.zeros(0, np.int64))),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array(times.astype(np.int64))),
                        pa.ListArray.from_arrays(pa.array(far_cut), pa.array(edge[far % max(len(edge), 1)] if len(far) else np.zeros(0, np.int64))),
                        pa.ListArray.from_arrays(pa.array(far_cut), pa.array(far_times.astype(np.int64))),
                    ],
                    ["doc_id", "held_out", "rid", "n_tokens", "known", "base", "score", "rare", "times", "far", "far_times"],
                )

    numbered = rows.withColumn("rid", F.monotonically_increasing_id())
    kind = dict(docs.dtypes)["doc_id"]
    scored = spill(
        numbered.mapInArrow(
            scan,
            f"doc_id {kind}, held_out boolean, rid long, n_tokens long, known long, base double, score double, rare array<long>, times array<long>, "
            "far array<long>, far_times array<long>",
        ),
        "scored",
    )
    pairs = scored.where(F.size("rare") > 0).select("rid", F.explode(F.arrays_zip("rare", "times")).alias("p"))
    pairs = pairs.select("rid", F.col("p.rare").alias("key"), F.col("p.times").alias("times"))
    looked = pairs.join(words.where(F.col("n") < least), "key", "left")
    tail = looked.groupBy("rid").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("tail"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("tail_known"),
    )
    slim = scored.drop("rare", "times", "far", "far_times").join(tail, "rid", "left")
    if trie.least:
        steps = scored.where(F.size("far") > 0).select("rid", F.explode(F.arrays_zip("far", "far_times")).alias("p"))
        steps = steps.select("rid", F.col("p.far").alias("key"), F.col("p.far_times").alias("times"))
        logs = steps.join(far_edges(edges, steps, trie.least), "key").groupBy("rid").agg(F.sum(F.col("times") * F.col("logp")).alias("steps"))
        slim = slim.join(logs, "rid", "left").withColumn("score", F.col("score") + F.coalesce("steps", F.lit(0.0))).drop("steps")
    divisor = math.log10(n + 0.1 * (v + 1))
    return slim.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail", F.lit(0.0)) - F.col("n_tokens") * F.lit(divisor)).alias("base_score"),
        "score",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    code = F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8"))
    return score(docs, code % 10 == 0)
