"""MinHash near-dedup by a multi-index Hamming join.

Documents are sets of word shingles; equal sets are one. A set's signature holds
132 positions of 16 bits, the minima of as many hash functions, so that each
position of two sets is equal with the probability of their Jaccard similarity.
Signatures are cut into 22 chunks of 6 positions. By the pigeonhole principle two
signatures that differ in at most 43 positions have a chunk with at most one error,
and every chunk is posted once for each place that the error may have: all pairs
within that distance meet at a key. (A pair of similarity 0.85 differs in 20
positions on average, and in more than 43 with a probability below 0.000002, one of
0.9 below 10^-11.) What meets is confirmed on the full sets.

Keys only open groups: a set goes to the smallest set it meets, groups are cut into
blocks of bounded size, and all sets of a block meet, giving clusters. Then blocks
whose sets share a key but not a cluster are compared, block with block: sets of the
cluster that both mainly hold stay where they are. A key that very many sets share
costs one entry for each block, and a large group of near copies is one cluster
before its blocks are paired. No group is expanded into all its pairs.

Sets are compared by 64-bit shingle hashes and told apart by 128 bits. Null and
empty texts have an empty set and link with nothing; fewer words than a shingle make
one shingle; repeated rows each get a row; very long texts are whole; an empty table
gives an empty result; a null id is the smallest of no component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words
from ._dist import hidden, join_hot, shuffle_width, spill, temporary
from .near_dup import block_of, grouped, merge, set_id, shingle_sets

NUM, DEN = 85, 100
CHUNKS, WIDTH, ERRORS = 22, 6, 1
POSITIONS, DISTANCE = CHUNKS * WIDTH, CHUNKS * (ERRORS + 1) - 1
#: Sets of a block; blocks whose sets visit one in one task.
BLOCK, VISITORS = 256, 8
_rng = np.random.default_rng(20240311)
_TIMES, _PLUS, _SALT = (_rng.integers(1, 1 << 63, POSITIONS, dtype=np.uint64) | np.uint64(1) for _ in range(3))
_OTHER = np.uint64(0xA0761D6478BD642F)


def signatures(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(sets, POSITIONS) of 16 bits; rows of empty sets are 0."""
    out = np.zeros((len(n), POSITIONS), np.uint16)
    there = np.flatnonzero(n)
    if len(there):
        starts = (np.cumsum(n) - n)[there]
        for k in range(POSITIONS):
            least = np.minimum.reduceat((h ^ _PLUS[k]) * _TIMES[k], starts)
            out[there, k] = (least >> np.uint64(24)).astype(np.uint16)
    return out


def keys(signs: np.ndarray) -> np.ndarray:
    """(sets, POSITIONS): the key of each chunk without each of its positions."""
    terms = _words.mix((signs.astype(np.uint64) + np.uint64(1)) * _TIMES).reshape(-1, CHUNKS, WIDTH)
    rest = terms.sum(2, dtype=np.uint64)[:, :, None] - terms
    return _words.mix(rest.reshape(-1, POSITIONS) + _SALT).view(np.int64)


def members(docs: DataFrame) -> DataFrame:
    """docs (in_ columns and text) with set, its 128-bit name, null if empty,
    n_shingles and sign instead of text."""
    names = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{n}` {t}" for n, t in docs.select(*names).dtypes) + ", set string, n_shingles long, sign binary"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _words.blocks(batch.column(len(names))):
                h, n = shingle_sets(b)
                two = np.stack([set_id(h, n), set_id(_words.mix(h ^ _OTHER), n)], axis=1)
                name = [x.tobytes().hex() for x in two]
                sign = [x.tobytes() for x in signatures(h, n)]
                own = [c.slice(b.first, b.n) for c in batch.columns[: len(names)]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(name, mask=n == 0), pa.array(n), pa.array(sign, pa.binary())], [*names, "set", "n_shingles", "sign"])

    return docs.select(*names, "text").mapInArrow(scan, schema)


def met(sets: DataFrame) -> DataFrame:
    """(sid, to): for each set that shares a key with another the smallest that it
    is known to share one with, itself included. Members of a key within one batch
    meet there; only the batch's smallest goes on, so a key that very many sets hold
    is small in the shuffle. Tasks get keys packed by part of the key space."""
    spark = sets.sparkSession
    width = shuffle_width(spark)

    def star(key: np.ndarray, sid: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
        """(each key and its smallest id), ids by key, the smallest id of each one's key."""
        order = np.lexsort((sid, key))
        key, sid = key[order], sid[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
        return (key[new], sid[new]), sid, sid[first]

    def pairs(sid: np.ndarray, to: np.ndarray) -> tuple[pa.Array, pa.Array]:
        """For each id the smallest partner, and for each partner itself."""
        one = sid != to
        sid, to = np.concatenate([sid[one], to[one]]), np.concatenate([to[one], to[one]])
        order = np.lexsort((to, sid))
        sid, to = sid[order], to[order]
        new = np.ones(len(sid), bool)
        new[1:] = sid[1:] != sid[:-1]
        return pa.array(sid[new]), pa.array(to[new])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            signs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, POSITIONS)
            (key, least), sid, to = star(keys(signs).ravel(), np.repeat(batch.column(0).to_numpy(), POSITIONS))
            a, b = pairs(sid, to)
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1], pa.int32()), pa.array([a.to_numpy().tobytes()], pa.binary()), pa.array([b.to_numpy().tobytes()], pa.binary())], ["part", "key", "sid"]
            )
            part = (_words.mix(key.view(np.uint64)) % np.uint64(width)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            key, least = key[order], least[order]
            cut = np.searchsorted(part[order], np.arange(width + 1))
            full = np.flatnonzero(np.diff(cut)).astype(np.int32)
            packed = [pa.array([x[cut[i] : cut[i + 1]].tobytes() for i in full], pa.binary()) for x in (key, least)]
            yield pa.RecordBatch.from_arrays([pa.array(full), *packed], ["part", "key", "sid"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]
        for batch in batches:
            for part, key, sid in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                x, y = (np.frombuffer(v.as_buffer(), np.int64) for v in (key, sid))
                if part < 0:
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["sid", "to"])
                else:
                    held[0].append(x)
                    held[1].append(y)
        if held[0]:
            _, sid, to = star(*map(np.concatenate, held))
            yield pa.RecordBatch.from_arrays([*pairs(sid, to)], ["sid", "to"])

    # Pairs found within a batch are dealt evenly, keys by their part.
    posted = sets.select("sid", "sign").mapInArrow(post, "part int, key binary, sid binary")
    to = F.when(F.col("part") >= 0, F.col("part")).otherwise(F.pmod(F.xxhash64("sid"), F.lit(width)).cast("int"))
    found = posted.repartition(width, to).mapInArrow(gather, "sid long, to long")
    return found.groupBy("sid").agg(F.min("to").alias("to"))


def spot_of(blk: Column) -> Column:
    """The name of a group's block; blocks that get one name are one block."""
    return F.xxhash64("grp", blk)


def tokens_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, sign, tokens binary) of the wanted sets, each read from one row that has it."""
    rows = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_k"), "text")
    w = wanted.select("sid", "sign", F.col("rep.doc_id").alias("_wid"), F.col("rep._k").alias("_wk"))
    mine = rows.join(w.hint("shuffle_hash"), (F.col("_k") == F.col("_wk")) & F.col("_id").eqNullSafe(F.col("_wid"))).select("sid", "sign", "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _words.blocks(batch.column(2)):
                h, n = shingle_sets(b)
                end = np.cumsum(n)
                tokens = [h[e - k : e].tobytes() for e, k in zip(end, n)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first, b.n), batch.column(1).slice(b.first, b.n), pa.array(tokens, pa.binary())], ["sid", "sign", "tokens"])

    return mine.mapInArrow(scan, "sid long, sign binary, tokens binary")


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are as similar as asked."""
    if len(a) > len(b):
        a, b = b, a
    if DEN * len(a) < NUM * len(b):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return DEN * both >= NUM * (len(a) + len(b) - both)


def confirm(sids: np.ndarray, comps: np.ndarray, signs: np.ndarray, sets: list[np.ndarray], guests: np.ndarray) -> list[tuple[int, int]]:
    """Links that join clusters, as pairs of these: among a block's own sets or, where
    it has guests, from guests to the block's sets. Sets of clusters that are joined
    already, also here, need not be compared."""
    names, at = np.unique(comps, return_inverse=True)
    root, found = np.arange(len(names)), []
    own = np.flatnonzero(~guests)
    for n, i in enumerate(np.flatnonzero(guests) if guests.any() else own):
        others = own if guests[i] else own[:n]
        away = (signs[others] != signs[i]).sum(1)
        near = np.flatnonzero(away <= DISTANCE)
        for j in others[near[np.argsort(away[near], kind="stable")]]:
            if root[at[i]] != root[at[j]] and linked(sets[i], sets[j]):
                root[root == root[at[j]]] = root[at[i]]
                found.append((int(comps[i]), int(comps[j])))
    return found


def run_blocks(rows: DataFrame) -> DataFrame:
    """(spot, slice, guest, sid, comp, sign, tokens) to links (ca, cb) of clusters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in grouped(batches, 2):
            guest, sid, comp = (t.column(i).to_numpy() for i in (2, 3, 4))
            _, once = np.unique(np.stack([guest, sid]), axis=1, return_index=True)  # a pivot may come twice
            if len(once) < 2:
                continue
            signs, tokens = (t.column(i).take(pa.array(once)).to_pylist() for i in (5, 6))
            signs = np.frombuffer(b"".join(signs), np.uint16).reshape(-1, POSITIONS)
            found = confirm(sid[once], comp[once], signs, [np.frombuffer(x, np.uint64) for x in tokens], guest[once] == 1)
            if found:
                a, b = np.array(found, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["ca", "cb"])

    n = shuffle_width(rows.sparkSession)
    return rows.repartition(n, "spot", "slice").sortWithinPartitions("spot", "slice").mapInArrow(run, "ca long, cb long")


def block_pairs(key: np.ndarray, spot: np.ndarray, low: np.ndarray, high: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Different blocks (a < b), as rows, that share a key and, at it, hold different
    clusters (low to high: the smallest and largest) with sets of fitting size (lo to hi)."""
    order = np.lexsort((spot, key))
    key, spot, low, high, lo, hi = (x[order] for x in (key, spot, low, high, lo, hi))
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(starts, len(key)))
    least, most = np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)
    out, held = [np.zeros((0, 2), np.int64)], 0
    open_keys = (size > 1) & (least != most)
    for s, m in zip(starts[open_keys].tolist(), size[open_keys].tolist()):
        i = np.arange(s, s + m)
        lone = (low[i] == high[i]) & (low[i] == np.median(low[i]).astype(np.int64))  # of one and the commonest cluster
        mine = i[~lone] if lone.sum() > m // 2 else i
        for c in range(0, len(mine), max(1, (1 << 18) // m)):
            x = np.repeat(mine[c : c + max(1, (1 << 18) // m)], m)
            y = np.tile(i, len(x) // m)
            fit = (spot[x] != spot[y]) & ((low[x] != low[y]) | (high[x] != high[y]) | (low[x] != high[x]))
            fit &= (DEN * hi[x] >= NUM * lo[y]) & (DEN * hi[y] >= NUM * lo[x])
            x, y = spot[x[fit]], spot[y[fit]]
            out.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
            held += len(x)
            if held > 1 << 20:
                out, held = [np.unique(np.concatenate(out), axis=0)], 0
    return np.unique(np.concatenate(out), axis=0)


def open_pairs(placed: DataFrame) -> DataFrame:
    """(a, b): blocks that have to be compared. Every batch sends one entry for each of
    its keys and blocks, packed by part of the key space."""
    width = shuffle_width(placed.sparkSession)
    kinds = (np.int64, np.int64, np.int64, np.int64, np.int32, np.int32)
    names = ["key", "spot", "low", "high", "lo", "hi"]

    def entries(key, spot, low, high, lo, hi) -> list[np.ndarray]:
        """One for each key and block."""
        order = np.lexsort((spot, key))
        key, spot, low, high, lo, hi = (x[order] for x in (key, spot, low, high, lo, hi))
        starts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (spot[1:] != spot[:-1])]))
        ends = [np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts), np.minimum.reduceat(lo, starts), np.maximum.reduceat(hi, starts)]
        return [x.astype(k) for x, k in zip([key[starts], spot[starts], *ends], kinds)]

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            signs = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint16).reshape(-1, POSITIONS)
            spot, comp, n = (np.repeat(batch.column(i).to_numpy(), POSITIONS) for i in (1, 2, 3))
            cols = entries(keys(signs).ravel(), spot, comp, comp, n, n)
            part = (_words.mix(cols[0].view(np.uint64)) % np.uint64(width)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(width + 1))
            full = np.flatnonzero(np.diff(cut)).astype(np.int32)
            packed = [pa.array([x[order][cut[i] : cut[i + 1]].tobytes() for i in full], pa.binary()) for x in cols]
            yield pa.RecordBatch.from_arrays([pa.array(full), *packed], ["part", *names])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[] for _ in names]
        for batch in batches:
            for k, kind in enumerate(kinds):
                held[k] += [np.frombuffer(x.as_buffer(), kind) for x in batch.column(k + 1)]
        if held[0]:
            a, b = block_pairs(*entries(*map(np.concatenate, held))).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    posted = placed.select("sign", "spot", "comp", "n").mapInArrow(post, "part int, " + ", ".join(f"{x} binary" for x in names))
    return posted.repartition(width, "part").mapInArrow(gather, "a long, b long").distinct()


def across(wanted: DataFrame, label: DataFrame, tokens: DataFrame) -> DataFrame:
    """Links (ca, cb) between clusters over different blocks: all there are, as sets of
    one block have met before. Of two blocks with the same main cluster only the
    others' sets visit, each way; else the first block's all visit the second."""
    placed = spill(wanted.select("sid", "sign", "n", "spot").join(label, "sid"), "placed")
    main = placed.groupBy("spot", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("spot").agg(F.max(F.struct("k", "comp")).alias("m"))
    main = main.select("spot", F.col("m.comp").alias("main"))
    pairs = open_pairs(placed).join(main.toDF("a", "ma"), "a").join(main.toDF("b", "mb"), "b")
    same = F.when(F.col("ma") == F.col("mb"), F.col("ma"))
    way = lambda host, guest: F.struct(F.col(host).alias("host"), F.col(guest).alias("visitor"), same.alias("but"))
    ways = pairs.select(F.explode(F.when(same.isNotNull(), F.array(way("a", "b"), way("b", "a"))).otherwise(F.array(way("b", "a")))).alias("w")).select("w.*")
    ways = spill(ways, "ways")
    slices = ways.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("slices"))
    ways = ways.join(slices, "host").withColumn("slice", F.pmod(F.xxhash64("visitor"), F.col("slices")).cast("int"))
    own = placed.select(F.col("spot").alias("home"), "sid", "comp")
    visits = ways.join(own, F.col("visitor") == F.col("home")).where("but is null or comp <> but").select(F.col("host").alias("spot"), "slice", F.lit(1).alias("guest"), "sid", "comp")
    homes = slices.select("host", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice")).join(own, F.col("host") == F.col("home"))
    homes = homes.select(F.col("host").alias("spot"), "slice", F.lit(0).alias("guest"), "sid", "comp")
    rows = homes.union(visits).join(tokens, "sid").select("spot", "slice", "guest", "sid", "comp", "sign", "tokens")
    return spill(run_blocks(rows).distinct(), "merges")


def cluster(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and more) without text, with n_shingles, component_id, the
    smallest doc_id reachable by links, itself included, and kept, whether it is the
    row's own. Input columns named like these are replaced, any other name is free."""
    docs, names = hidden(docs.drop("n_shingles", "component_id", "kept"))
    rest = {f"in_{i}": n for i, n in enumerate(names) if n not in ("doc_id", "text")}
    docs = docs.select(*[F.col(f"in_{names.index(n)}").alias(n) for n in ("doc_id", "text")], *rest)
    with temporary(docs.sparkSession):
        all_rows = spill(members(docs.withColumn("_k", F.xxhash64("text"))), "members", keep=True)
        rows = all_rows.drop("sign")
        own = all_rows.where("set is not null").groupBy("set").agg(
            F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "_k")).alias("rep"), F.count(F.lit(1)).alias("copies"),
            F.first("n_shingles").alias("n"), F.first("sign").alias("sign"),
        )
        sets = spill(own.withColumn("sid", F.monotonically_increasing_id()), "sets")
        # The smallest that a set met in its batch has met smaller ones itself.
        near = spill(met(sets), "met")
        further = near.select(F.col("sid").alias("to"), F.col("to").alias("top"))
        groups = spill(near.join(further, "to").select("sid", F.col("top").alias("to")), "groups")
        wanted = spill(sets.join(groups, "sid").select("sid", "sign", "n", "rep", F.col("to").alias("grp")), "wanted")
        tokens = spill(tokens_of(docs, wanted), "tokens")
        size = groups.groupBy(F.col("to").alias("grp")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.count(F.lit(1)).alias("members"))
        spots = join_hot(wanted.select("sid", "grp"), size, "grp", "members", wanted.count())
        wanted = spill(wanted.join(spots.select("sid", spot_of(block_of("blocks")).alias("spot")), "sid"), "placed")
        pivots = size.select("grp", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("blk"))
        homes = wanted.select("spot", "sid").union(pivots.select(spot_of(F.col("blk")), "grp"))
        homes = homes.select("spot", F.lit(0).alias("slice"), F.lit(0).alias("guest"), "sid", F.col("sid").alias("comp"))
        links = spill(run_blocks(homes.join(tokens, "sid").select("spot", "slice", "guest", "sid", "comp", "sign", "tokens")), "links")
        label = merge(wanted.select("sid", F.col("sid").alias("comp")), links)
        label = merge(label, across(wanted, label, tokens))
        rooted = sets.join(label, "sid", "left").select("set", "copies", "least", F.coalesce("comp", "sid").alias("root"))
        rooted = spill(rooted, "roots")
        roots = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("sets"))
        answer = spill(join_hot(rooted.select("set", "copies", "root"), roots, "root", "sets", rooted.count()).drop("root"), "answers", keep=True)
        out = join_hot(rows, answer, "set", "copies", rows.count())
    out = out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", *[F.col(c).alias(n) for c, n in rest.items()], "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return cluster(docs).select("doc_id", "n_shingles", "component_id", "kept")
