"""N-gram Jaccard join by a token-group matrix.

Documents are sets of word shingles. Equal sets are one member. A pair with
Jaccard similarity of at least 3/4 shares l tokens among the first
n - ceil(3n/4) + l tokens of both sets in any one global token order, so only
these prefix tokens are posted, with l a tenth of the set; only those posted
twice by sets of fitting size go on, and only members with l of them. The order
puts tokens that very many documents hold (counted in a sketch over all tokens)
last, so passages that many documents share open nothing by themselves.

Members with the same rarest shared token form a group, and so do those with the
same most common one; groups are cut into blocks of bounded size, and every block
also gets its group's pivot. Blocks are joined within, giving clusters. The matrix then holds which clusters' token unions hold
which tokens: a member queries another cluster only if sizes fit and enough of
its posted tokens are in the cluster's union, and a block of it is opened only if the member's overlap with the
block's token union reaches the bound. Smaller clusters query larger ones, so a
large cluster of near copies is not compared with itself again. Links between
clusters merge them; the result holds the component of every document, without
expanding any group into all pairs.

Sets are compared by 64-bit shingle hashes. Null and empty texts have an empty
set and link with nothing; fewer words than a shingle make one shingle; repeated
rows each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _words
from ._dist import components, hidden, join_hot, shown, shuffle_width, spill, temporary

SHINGLE, NUM, DEN = 5, 75, 100
SKETCH_BITS, CHUNK_BITS = 22, 17
#: Sets of a block; parts of the token space for each shuffle partition.
BLOCK, PARTS = 256, 4
_SHORT = np.uint64(0x51ED270B7A3C1D25)


def shingle_sets(b: _words.Block) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, text by text; how many each text has)."""
    w = _words.words(b, _words.lower(b.data), _words.SPACE)
    at, h = _words.windows(w, SHINGLE)
    text = w.text[at]
    short = np.flatnonzero((w.count > 0) & (w.count < SHINGLE))
    if len(short):
        first = np.concatenate([[0], np.cumsum(w.count)])
        own = [_words.sequence_hash([w.hash[first[i] + k : first[i] + k + 1] for k in range(w.count[i])])[0] ^ _SHORT for i in short]
        text, h = np.concatenate([text, short]), np.concatenate([h, np.array(own, np.uint64)])
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.bincount(text[new], minlength=b.n)


def set_id(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """One 64-bit id per set: a sum of mixed hashes, so equal sets are equal."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_words.mix(h * np.uint64(0xD1342543DE82EF95) + np.uint64(1)), dtype=np.uint64)])
    end = np.cumsum(n)
    return _words.mix(total[end] - total[end - n] + n.astype(np.uint64)).view(np.int64)


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal values in the first columns of a sorted stream."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            key = tuple(c[lo] for c in cols)
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield last, pa.Table.from_batches(held)


def frequent_tokens(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(counts of all tokens by hash bucket, number of tokens). Every task sends
    its counts in chunks, which are added up before they come to the driver."""
    chunks, size = 1 << (SKETCH_BITS - CHUNK_BITS), 1 << CHUNK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int32)
        for batch in batches:
            for b in _words.blocks(batch.column(0)):
                h, _ = shingle_sets(b)
                at, n = np.unique((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), return_counts=True)
                total[at] += n.astype(np.int32)
        # A byte a bucket: 255 in one task is frequent already.
        parts = [np.minimum(total[i * size : (i + 1) * size], 255).astype(np.uint8).tobytes() for i in range(chunks)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(chunks, dtype=np.int32)), pa.array(parts, pa.binary())], ["chunk", "n"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, n in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[c] = total.get(c, 0) + np.frombuffer(n.as_buffer(), np.uint8).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(total), pa.int32()), pa.array([t.tobytes() for t in total.values()], pa.binary())], ["chunk", "n"]
        )

    parts = docs.select("text").mapInArrow(count, "chunk int, n binary").repartition(chunks, "chunk").mapInArrow(add, "chunk int, n binary").collect()
    out = np.zeros(1 << SKETCH_BITS, np.int32)
    for c, n in parts:
        out[c * size : (c + 1) * size] = np.frombuffer(n, np.int32)
    return out, int(out.sum())


def token_classes(counts: np.ndarray, total: int) -> np.ndarray:
    """0 for ordinary buckets, else how many times over the limit, in powers of 2."""
    mean = total / len(counts)
    limit = mean + 6 * mean**0.5 + 16  # well over what chance puts into a bucket
    return np.where(counts <= limit, 0, 1 + np.log2(np.maximum(counts, 1) / limit).astype(np.int64)).clip(0, 100).astype(np.uint64)


def ordered(h: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Tokens as numbers whose order is the global one: class, then hash."""
    return ((classes[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)] << np.uint64(56)) | (h & np.uint64((1 << 56) - 1))).view(np.int64)


def need(n: np.ndarray) -> np.ndarray:
    return (NUM * n + DEN - 1) // DEN


def level(n: np.ndarray) -> np.ndarray:
    """How many prefix tokens a set must share with one of its size."""
    return 1 + n // 10


#: level() of the smallest set that a set of n tokens can link with.
LEAST_SHARED = f"1 + ((({NUM} * n + {DEN - 1}) div {DEN}) div 10)"


def link_block(sets: list[np.ndarray], ids: np.ndarray, guests: list[np.ndarray], guest_ids: np.ndarray) -> list[tuple[int, int]]:
    """Links among a block's sets (a spanning forest of them), or, with guests,
    from each guest to the sets it links with."""
    sizes = np.array([len(s) for s in sets])
    union, at = np.unique(np.concatenate(sets), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    found, root = [], np.arange(len(sets))
    asked = guests if guests else sets
    for i, q in enumerate(asked):
        k = np.minimum(np.searchsorted(union, q), len(union) - 1)
        k = k[union[k] == q]
        if len(k) < need(np.array(len(q))):  # the bound on the whole block
            continue
        mark = np.zeros(len(union), np.int64)
        mark[k] = 1
        both = np.add.reduceat(mark[at], starts)
        hit = np.flatnonzero(DEN * both >= NUM * (sizes + len(q) - both))
        if guests:
            found += [(int(guest_ids[i]), int(ids[j])) for j in hit if guest_ids[i] != ids[j]]
            continue
        for j in hit:
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                found.append((int(ids[i]), int(ids[j])))
    return found


def members(docs: DataFrame) -> DataFrame:
    """docs with sid (null for an empty set) and n_shingles."""
    names = {c: f"in_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    slim = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], "text")
    schema = ", ".join(f"{n} {t}" for n, t in slim.drop("text").dtypes) + ", sid long, n_shingles long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, size = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for b in _words.blocks(batch.column(len(names))):
                h, n = shingle_sets(b)
                sid.append(set_id(h, n))
                size.append(n)
            size = np.concatenate(size)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(np.concatenate(sid), mask=size == 0), pa.array(size)], [*names.values(), "sid", "n_shingles"]
            )

    return slim.mapInArrow(scan, schema).select(*[F.col(n).alias(c) for c, n in names.items()], "sid", "n_shingles")


def shared_tokens(docs: DataFrame, classes: np.ndarray) -> DataFrame:
    """(token, sid, n, at): prefix tokens that two members of fitting size have, and
    their places in the member's order."""
    spark = docs.sparkSession
    width = PARTS * shuffle_width(spark)  # each is met whole
    held = spark.sparkContext.broadcast(classes.astype(np.uint8))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes = held.value.astype(np.uint64)
        for batch in batches:
            seen: set[int] = set()
            kept: list[tuple[np.ndarray, ...]] = []
            for b in _words.blocks(batch.column(0)):
                h, n = shingle_sets(b)
                ids = set_id(h, n)
                text = np.repeat(np.arange(b.n), n)
                token = ordered(h, classes)
                order = np.lexsort((token, text))
                rank = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
                new = np.array([n[i] > 0 and not (x in seen or seen.add(x)) for i, x in enumerate(ids.tolist())], bool)
                take = (rank < (n - need(n) + level(n))[text]) & new[text]
                kept.append((token[order][take], ids[text[take]], n[text[take]], rank[take]))
            if not kept:
                continue
            token, sid, size, rank = (np.concatenate([k[i] for k in kept]) for i in range(4))
            part = token.view(np.uint64) % np.uint64(width)
            order = np.argsort(part, kind="stable")
            token, sid, size, rank = token[order], sid[order], size[order].astype(np.uint32), rank[order].astype(np.uint32)
            cut = np.searchsorted(part[order], np.arange(width + 1))
            full = np.flatnonzero(np.diff(cut))
            yield pa.RecordBatch.from_arrays(
                [pa.array(full.astype(np.int32))] + [pa.array([x[cut[i] : cut[i + 1]].tobytes() for i in full], pa.binary()) for x in (token, sid, size, rank)],
                ["part", "token", "sid", "n", "at"],
            )

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[list[np.ndarray]] = [[], [], [], []]
        for batch in batches:
            for i, kind in enumerate((np.int64, np.int64, np.uint32, np.uint32)):
                parts[i] += [np.frombuffer(x.as_buffer(), kind) for x in batch.column(i + 1)]
        if not parts[0]:
            return
        token, sid, n, at = (np.concatenate(p) for p in parts)
        order = np.lexsort((sid, n, token))
        token, sid, n, at = token[order], sid[order], n[order].astype(np.int64), at[order].astype(np.int64)
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])
        token, sid, n, at = token[new], sid[new], n[new], at[new]
        more = np.zeros(len(token), bool)
        same = (token[1:] == token[:-1]) & (DEN * n[:-1] >= NUM * n[1:])  # the nearest sizes
        more[1:] |= same
        more[:-1] |= same
        token, sid, n, at = token[more], sid[more], n[more], at[more]
        for lo in range(0, len(token), 100_000):
            s = slice(lo, lo + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(x[s]) for x in (token, sid, n, at)], ["token", "sid", "n", "at"])

    posted = docs.select("text").mapInArrow(post, "part int, token binary, sid binary, n binary, at binary").repartition(width, "part")
    return posted.mapInArrow(twice, "token long, sid long, n long, at long")


def set_rows(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, tokens binary) of the wanted members: sid, _id, _k of one row each."""
    rows = docs.select("text", F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_k"))
    w = wanted.select("sid", F.col("_id").alias("_wid"), F.col("_k").alias("_wk"))
    mine = rows.join(w.hint("shuffle_hash"), (F.col("_k") == F.col("_wk")) & F.col("_id").eqNullSafe(F.col("_wid"))).select("text", "sid")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _words.blocks(batch.column(0)):
                h, n = shingle_sets(b)
                end = np.cumsum(n)
                tokens = [h[e - k : e].tobytes() for e, k in zip(end, n)]
                yield pa.RecordBatch.from_arrays([batch.column(1)[b.first : b.first + b.n], pa.array(tokens, pa.binary())], ["sid", "tokens"])

    return mine.mapInArrow(scan, "sid long, tokens binary")


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (group, block, guest, sid, tokens) to links (a, b)."""
    for _, t in grouped(batches, 2):
        guest = t.column(2).to_numpy()
        sid = t.column(3).to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for c in t.column(4).chunks for x in c]
        own = np.flatnonzero(guest == 0)
        _, first = np.unique(sid[own], return_index=True)
        vis = np.flatnonzero(guest == 1)
        _, once = np.unique(sid[vis], return_index=True)  # repeated rows
        own, vis = own[first], vis[once]
        if len(own) == 0 or (guest.any() == 0 and len(own) < 2):
            continue
        found = link_block([sets[i] for i in own], sid[own], [sets[i] for i in vis], sid[vis])
        if found:
            a, b = np.array(found, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def run_blocks(rows: DataFrame) -> DataFrame:
    n = shuffle_width(rows.sparkSession)
    return rows.repartition(n, "grp", "blk").sortWithinPartitions("grp", "blk").mapInArrow(_link, "a long, b long")


def block_of(blocks: str):
    return F.expr(f"cast(pmod(xxhash64(sid), {blocks}) as int)")


def merge(label: DataFrame, links: DataFrame) -> DataFrame:
    """label (sid, comp) after joining the clusters that links (ca, cb) name."""
    weight = label.groupBy("comp").agg(F.count(F.lit(1)).alias("w"))
    merged = components(links, "ca", "cb").join(weight, F.col("node") == F.col("comp")).select("comp", "component", "w")
    return spill(join_hot(label, merged, "comp", "w", label.count()).select("sid", F.coalesce("component", "comp").alias("comp")), "clusters")


def across(shared: DataFrame, label: DataFrame, sets: DataFrame, least: int, whole: bool) -> DataFrame:
    """Links (ca, cb) between clusters, found by the token-group matrix.

    A member visits all blocks (with whole) or one block of each cluster of over
    least members that the matrix opens to it. One pass with least 0 and whole is
    exact; passes before it, to large clusters only, join nearly all that belongs
    to these, so that hardly any member is left to visit all their blocks."""
    rows, weight = label.count(), label.groupBy("comp").agg(F.count(F.lit(1)).alias("w"), F.count(F.lit(1)).alias("members"))
    # Tokens before a shared one that nobody shares are lost to any overlap, which
    # has to reach NUM / (NUM + DEN) of both sizes together: what a member can
    # still offer at a token, less its own part of that, is its room.
    before = F.row_number().over(Window.partitionBy("sid").orderBy("token")) - 1
    offer = F.col("n") - (F.col("at") - before)
    roomy = shared.withColumn("room", (NUM + DEN) * offer - NUM * F.col("n"))
    cells = spill(roomy.drop("at").join(join_hot(label, weight, "comp", "members", rows), "sid"), "cells")
    matrix = cells.groupBy("token", "comp").agg(F.max("w").alias("w"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("room").alias("their"))
    several = matrix.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("token")
    open_cells = matrix.where(f"w > {least}").join(several, "token").select(
        "token", F.col("comp").alias("to"), F.col("w").alias("tw"), "lo", "hi", "their"
    )
    fits = (F.col("n") * DEN >= F.col("lo") * NUM) & (F.col("hi") * DEN >= F.col("n") * NUM)
    fits = fits & (F.col("room") >= NUM * F.col("lo")) & (F.col("their") >= NUM * F.col("n"))
    larger = (F.col("tw") > F.col("w")) | ((F.col("tw") == F.col("w")) & (F.col("to") > F.col("comp")))
    met = cells.join(open_cells, "token").where(fits & larger).groupBy("sid", "to").agg(
        F.first("n").alias("n"), F.first("tw").alias("tw"), F.count(F.lit(1)).alias("in_union")
    )
    asks = spill(met.where(f"in_union >= {LEAST_SHARED}").select("sid", "to", "tw", F.ceil(F.col("tw") / BLOCK).cast("int").alias("blocks")), "asks")
    size = asks.select(F.col("to").alias("comp"), "tw", "blocks").distinct()
    homes = join_hot(label, size, "comp", "tw", rows).where("blocks is not null")
    homes = homes.select(F.col("comp").alias("grp"), block_of("blocks").alias("blk"), F.lit(0).alias("guest"), "sid")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    visits = asks.select(F.col("to").alias("grp"), (every if whole else block_of("blocks")).alias("blk"), F.lit(1).alias("guest"), "sid")
    links = run_blocks(homes.union(visits).join(sets, "sid").select("grp", "blk", "guest", "sid", "tokens"))
    a, b = label.select(F.col("sid").alias("a"), F.col("comp").alias("ca")), label.select(F.col("sid").alias("b"), F.col("comp").alias("cb"))
    return spill(links.join(a, "a").join(b, "b").select("ca", "cb").distinct(), "merges")


def cluster(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and more) without text, with n_shingles, component_id,
    the smallest doc_id reachable by links, itself included, and _k and keeper:
    the text's hash and whether the row is the one of its component that stays
    (with all rows equal to it). Input columns named like these are replaced, any
    other name is free."""
    docs, names = hidden(docs.drop("n_shingles", "component_id", "_k", "keeper"))
    rest = {f"in_{i}": n for i, n in enumerate(names) if n not in ("doc_id", "text")}
    docs = docs.select(*[F.col(f"in_{names.index(n)}").alias(n) for n in ("doc_id", "text")], *rest)
    with temporary(docs.sparkSession):
        counts, total = frequent_tokens(docs)
        classes = token_classes(counts, total)
        rows = spill(members(docs.withColumn("_k", F.xxhash64("text"))), "members", keep=True)
        shared = spill(shared_tokens(docs, classes), "shared")
        first = shared.groupBy("sid").agg(
            F.min("token").alias("rare"),
            F.max_by("token", F.struct(F.shiftright("token", 56), -F.col("token"))).alias("common"),
            F.first("n").alias("n"),
            F.count(F.lit(1)).alias("posted"),
        )
        first = first.where(f"posted >= {LEAST_SHARED}")
        reps = rows.where("sid is not null").groupBy("sid").agg(F.min(F.struct("doc_id", "_k")).alias("r"))
        wanted = spill(first.join(reps, "sid").select("sid", "rare", "common", F.col("r.doc_id").alias("_id"), F.col("r._k").alias("_k")), "wanted")
        sets = spill(set_rows(docs, wanted), "sets")
        # Groups by rarest and by most common shared token, cut into blocks.
        placed = wanted.select("sid", F.explode(F.array_distinct(F.array("rare", "common"))).alias("grp"))
        size = placed.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.min("sid").alias("pivot"))
        spots = placed.join(size, "grp").select("grp", block_of("blocks").alias("blk"), "sid").union(
            size.where("blocks > 1").select("grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("blk"), F.col("pivot").alias("sid"))
        )
        inner = spill(run_blocks(spots.join(sets, "sid").select("grp", "blk", F.lit(0).alias("guest"), "sid", "tokens")), "links")
        label = merge(wanted.select("sid", F.col("sid").alias("comp")), inner.select(F.col("a").alias("ca"), F.col("b").alias("cb")))
        for least, whole in ((BLOCK, False), (BLOCK, True), (0, True)):
            label = merge(label, across(shared, label, sets, least, whole))
        # One row per set first: rows of equal texts, and sets of one component, may be
        # a third of all.
        own = rows.where("sid is not null").groupBy("sid").agg(
            F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "_k")).alias("rep"), F.count(F.lit(1)).alias("copies")
        )
        rooted = own.join(label, "sid", "left").select("sid", F.coalesce("comp", "sid").alias("root"), "least", "rep", "copies")
        rooted = spill(rooted, "roots")
        least = rooted.groupBy("root").agg(F.min("least").alias("least"), F.min("rep").alias("rep"), F.count(F.lit(1)).alias("sets"))
        answer = join_hot(rooted.select("sid", "copies", "root"), least, "root", "sets", rooted.count())
        answer = spill(answer.drop("root"), "answers", keep=True)
        out = join_hot(rows, answer, "sid", "copies", rows.count())
    out = out.withColumn("component_id", F.coalesce("least", "doc_id"))
    stays = F.col("sid").isNull() | (F.col("rep").eqNullSafe(F.struct("doc_id", "_k")))
    return out.withColumn("keeper", stays).select("doc_id", *[F.col(c).alias(n) for c, n in rest.items()], "_k", "n_shingles", "component_id", "keeper")


def deduplicate(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, its smallest; rows with an empty set
    all stay."""
    with temporary(docs.sparkSession):
        marks = cluster(docs.select("doc_id", "text")).where("keeper and n_shingles > 0").select("doc_id", "_k")
        marks = spill(marks, "keepers", keep=True)
    one = marks.distinct().select(F.col("doc_id").alias("id"), F.col("_k").alias("w"))
    rows, names = hidden(docs)
    doc, text = (rows.columns[names.index(c)] for c in ("doc_id", "text"))
    rows = rows.withColumn("k", F.xxhash64(text))
    same = (F.col("k") == F.col("w")) & F.col(doc).eqNullSafe(F.col("id"))
    kept = rows.join(one.hint("shuffle_hash"), same).drop("id", "w")
    if marks.count() > marks.distinct().count():  # repeated rows: one stays
        kept = kept.dropDuplicates([doc, "k"])
    empty = rows.where(~F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False)))
    return kept.union(empty).select(*shown(names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return cluster(docs).select("doc_id", "n_shingles", "component_id")
