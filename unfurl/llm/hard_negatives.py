"""Hard-negative mining by orthogonal PCA rotation.

A row's vector becomes integers, floor(256 * x). All rows are kept in blocks, and
rotated by the eigenvectors of their second moments (leading first; a rotation
keeps inner products). Anchors, packed into tiles, visit every block. Of each
anchor and row the product of the leading components is taken first; what the
others can add is bounded by the product of both residual norms, plus a slack for
rounding. Rows whose bound stays below what the anchor has already found, or
outside the band that a positive opens, are discarded; for the rest more
components are added, and what survives is verified by its integer product. So
the rotation changes how much is discarded and never what is returned.

Two passes: the best rows of an anchor's own label (its positives), then for each
positive the best rows of other labels scoring between a share of it and itself.

Rows with a null label or vector or any null or non-finite component take no part,
nor do those with a component beyond +-2^18, whose products could leave a long.
Shorter vectors count as padded with zeros. A null id is no anchor and comes last
among ties. Repeated rows are rows of their own, so a copy of an anchor is one of
its positives. Labels and other columns may have any values and names; an empty
table, or one without anchors, gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._dist import shuffle_width, spill, temporary

#: Integer components of a block at most, and its rows; anchors of a tile; pairs
#: compared at a time. None of them changes a result.
BLOCK_VALUES, BLOCK_ROWS, TILE, PAIRS = 1 << 19, 1 << 15, 512, 1 << 18
LARGEST = 1 << 26
#: Share of both norms by which rounding of rotated products may be off.
SLACK = 1e-9


@dataclass(frozen=True)
class Mining:
    positives: int = 5
    negatives: int = 5
    low: int = 80  # negatives score from low to high percent of the positive
    high: int = 100
    scale: int = 256


def _components(column: pa.Array, width: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(integers by row, which rows take part)."""
    n = len(column)
    column = column.cast(pa.list_(pa.float64()))
    off = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)  # nulls are NaN
    size = np.where(np.asarray(column.is_null()), 0, np.diff(off))
    row = np.repeat(np.arange(n), size)
    at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    with np.errstate(invalid="ignore", over="ignore"):
        v = np.floor(scale * values[np.repeat(off[:-1], size) + at])
        good = np.abs(v) <= LARGEST  # NaN is not
    ok = ~np.asarray(column.is_null())
    ok[row[~good]] = False
    out = np.zeros((n, width), np.int32)
    out[row[good], at[good]] = v[good].astype(np.int32)
    return out, ok


BLOCK = "block long, anchors int, ids binary, known binary, labels binary, ints binary"


def to_blocks(vectors: DataFrame, width: int, anchor_every: int, cfg: Mining) -> DataFrame:
    """vectors: id, label, embedding. Blocks of rows as arrays, BLOCK."""
    rows = max(1, min(BLOCK_ROWS, BLOCK_VALUES // max(width, 1)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 20
        held: list[tuple[np.ndarray, ...]] = []
        made = 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, made
            if not held:
                return
            ids, known, labels, ints = (np.concatenate([h[i] for h in held]) for i in range(4))
            end = len(ids) if last else len(ids) // rows * rows
            for lo in range(0, end, rows):
                s = slice(lo, min(lo + rows, end))
                count = int((known[s] & (ids[s] % anchor_every == 0)).sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([first + made]), pa.array([count], pa.int32()), *[pa.array([x[s].tobytes()], pa.binary()) for x in (ids, known, labels, ints)]],
                    ["block", "anchors", "ids", "known", "labels", "ints"],
                )
                made += 1
            held = [tuple(x[end:] for x in (ids, known, labels, ints))] if end < len(ids) else []

        for batch in batches:
            ints, ok = _components(batch.column(2), width, cfg.scale)
            ids = batch.column(0)
            known = ~np.asarray(ids.is_null())
            ids = ids.fill_null(0).to_numpy()
            held.append((ids[ok], known[ok], batch.column(1).to_numpy()[ok], ints[ok]))
            if sum(len(h[0]) for h in held) >= rows:
                yield from flush(False)
        yield from flush(True)

    return vectors.select("id", "label", "embedding").mapInArrow(pack, BLOCK)


def rotation(blocks: DataFrame, width: int) -> np.ndarray:
    """Eigenvectors of all rows' second moments, largest eigenvalue first. Tasks
    send rows of their matrices, which are added up before they come to the driver."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for x in batch.column(0):
                v = np.frombuffer(x.as_buffer(), np.int32).reshape(-1, width).astype(float)
                total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "r"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, r in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[i] = total.get(i, 0) + np.frombuffer(r.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([r.tobytes() for r in total.values()], pa.binary())], ["i", "r"])

    n = min(width, shuffle_width(blocks.sparkSession))
    parts = blocks.select("ints").mapInArrow(moments, "i int, r binary").repartition(n, "i").mapInArrow(add, "i int, r binary").collect()
    out = np.zeros((width, width))
    for i, r in parts:
        out[i] = np.frombuffer(r)
    return np.linalg.eigh((out + out.T) / 2)[1][:, ::-1].copy()


def stages(width: int) -> list[int]:
    """Numbers of leading components after which rows are discarded."""
    return sorted({max(1, width // 8), max(1, width // 3)}) if width else []


class Rows:
    """Rows or anchors as integers, rotated, with the norms of what each stage leaves."""

    def __init__(self, ints: np.ndarray, turn: np.ndarray):
        self.ints = ints
        self.turned = ints @ turn
        squares = self.turned**2
        self.norm = np.sqrt(squares.sum(1))
        self.rest = {k: np.sqrt(squares[:, k:].sum(1)) for k in stages(turn.shape[0])}


def kth(query: np.ndarray, value: np.ndarray, k: int, n: int) -> np.ndarray:
    """For each of n queries its k-th largest value; -inf where it has fewer."""
    out = np.full(n, -np.inf)
    order = np.lexsort((-value, query))
    q = query[order]
    starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]])) if len(q) else np.zeros(0, int)
    at = starts + k - 1
    ends = np.concatenate([starts[1:], [len(q)]]) if len(q) else starts
    full = at < ends
    out[q[starts[full]]] = value[order][at[full]]
    return out


def top(query: np.ndarray, score: np.ndarray, known: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k of each query: higher scores, then smaller ids."""
    order = np.lexsort((ids, ~known, -score, query))
    q = query[order]
    new = np.concatenate([[True], q[1:] != q[:-1]]) if len(q) else np.zeros(0, bool)
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
    return order[rank < k]


def survivors(a: Rows, r: Rows, ai: np.ndarray, ri: np.ndarray, first, later) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, row, integer product) of the pairs in ai x ri that no bound discards.
    first and later get (anchors, lower, upper bounds) and say which stay: first of
    whole matrices, anchor by anchor, later of lists of pairs."""
    out: list[tuple[np.ndarray, ...]] = []
    step = max(1, PAIRS // max(len(ri), 1))
    cuts = stages(a.turned.shape[1])
    for lo in range(0, len(ai), step):
        own = ai[lo : lo + step]
        if not cuts:
            i, j = np.repeat(own, len(ri)), np.tile(ri, len(own))
        for n, k in enumerate(cuts):
            if n == 0:
                part = a.turned[own, :k] @ r.turned[ri, :k].T
                away = np.outer(a.rest[k][own], r.rest[k][ri]) + SLACK * np.outer(a.norm[own], r.norm[ri])
                x, y = np.nonzero(first(own, ri, part - away, part + away))
                i, j, got = own[x], ri[y], part[x, y]
            else:
                was = cuts[n - 1]
                got = got + np.einsum("ij,ij->i", a.turned[i, was:k], r.turned[j, was:k])
                away = a.rest[k][i] * r.rest[k][j] + SLACK * a.norm[i] * r.norm[j]
                stay = later(i, j, got - away, got + away)
                i, j, got = i[stay], j[stay], got[stay]
        score = np.einsum("ij,ij->i", a.ints[i].astype(np.int64), r.ints[j].astype(np.int64))
        out.append((i, j, score))
    return tuple(np.concatenate([o[x] for o in out]) if out else np.zeros(0, np.int64) for x in range(3))


def _floor(x: np.ndarray) -> np.ndarray:
    """x, less what rounding a threshold can have added."""
    return x - 1e-12 * np.abs(x)


def _visits(blocks: DataFrame, tiles: DataFrame, count: int, work, schema: str) -> DataFrame:
    """Every tile of anchors meets every block: the block's row comes first, its
    tiles follow one by one, so that a task holds one block and one tile.
    work(block columns, tile) yields record batches."""
    every = blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("tile"))
    empty = F.lit(None).cast("binary")
    guests = every.join(tiles, "tile").select("block", "tile", *[empty.alias(c) for c in ("ids", "known", "labels", "ints")], "anchor")
    hosts = blocks.select("block", F.lit(-1).alias("tile"), "ids", "known", "labels", "ints", F.lit(None).cast(tiles.schema["anchor"].dataType).alias("anchor"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None
        for batch in batches:
            names = batch.column(0).to_pylist()
            for n, tile in enumerate(batch.column(1).to_pylist()):
                if tile < 0:
                    at, block = names[n], [batch.column(k)[n].as_buffer() for k in range(2, 6)]
                    block = work.load(at, block)
                elif names[n] == at:
                    yield from work.meet(block, batch.column(6).slice(n, 1).flatten())

    n = shuffle_width(blocks.sparkSession)
    return hosts.union(guests).repartition(n, "block").sortWithinPartitions("block", "tile").mapInArrow(run, schema)


class _Work:
    """What a task does with a block and the tiles that visit it."""

    def __init__(self, turn: np.ndarray, cfg: Mining):
        self.turn, self.cfg, self.width = turn, cfg, turn.shape[0]

    def load(self, block: int, parts: list) -> dict:
        ids, known, labels = (np.frombuffer(p, t) for p, t in zip(parts, (np.int64, bool, np.int64)))
        rows = Rows(np.frombuffer(parts[3], np.int32).reshape(len(ids), self.width), self.turn)
        return {"uid": block * BLOCK_ROWS + np.arange(len(ids)), "ids": ids, "known": known, "labels": labels, "rows": rows}

    def anchors(self, tile: pa.StructArray) -> tuple[np.ndarray, np.ndarray, Rows]:
        ints = np.frombuffer(b"".join(x.as_buffer().to_pybytes() for x in tile.field("ints")), np.int32)
        return tile.field("uid").to_numpy(), tile.field("label").to_numpy(), Rows(ints.reshape(len(tile), self.width), self.turn)


class Positives(_Work):
    def meet(self, b: dict, tile: pa.StructArray) -> Iterator[pa.RecordBatch]:
        uid, labels, a = self.anchors(tile)
        k, n = self.cfg.positives, len(uid)
        for label in np.unique(labels):
            ri, ai = np.flatnonzero(b["labels"] == label), np.flatnonzero(labels == label)
            if not len(ri):
                continue

            def first(own, ri, lower, upper):
                lower[uid[own][:, None] == b["uid"][ri][None, :]] = upper[uid[own][:, None] == b["uid"][ri][None, :]] = -np.inf  # not itself
                if len(ri) < k:
                    return upper > -np.inf
                return (upper >= _floor(np.partition(lower, -k, axis=1)[:, -k])[:, None]) & (upper > -np.inf)

            def later(i, j, lower, upper):
                return upper >= _floor(kth(i, lower, k, n))[i]

            i, j, score = survivors(a, b["rows"], ai, ri, first, later)
            other = uid[i] != b["uid"][j]
            i, j, score = i[other], j[other], score[other]
            best = top(i, score, b["known"][j], b["ids"][j], k)
            i, j, score = i[best], j[best], score[best]
            yield pa.RecordBatch.from_arrays([pa.array(uid[i]), pa.array(score), pa.array(b["ids"][j], mask=~b["known"][j])], ["uid", "score", "id"])


class Negatives(_Work):
    def meet(self, b: dict, tile: pa.StructArray) -> Iterator[pa.RecordBatch]:
        uid, labels, a = self.anchors(tile)
        k, n, low, high = self.cfg.negatives, len(uid), self.cfg.low, self.cfg.high
        lists = tile.field("scores").to_pylist()
        slots = max(map(len, lists))
        # The scores of each anchor's positives, NaN where it has fewer or they open no band.
        p = np.array([[s if low * s <= high * s else np.nan for s in x] + [np.nan] * (slots - len(x)) for x in lists], float).reshape(n, slots)
        ends = np.sort(np.stack([p * (low / 100), p * (high / 100)]), axis=0)
        lo, hi = _floor(ends[0]), ends[1] + 1e-12 * np.abs(ends[1])
        least, most = np.fmin.reduce(lo, axis=1), np.fmax.reduce(hi, axis=1)

        def first(own, ri, lower, upper):
            return (labels[own][:, None] != b["labels"][ri][None, :]) & (upper >= least[own][:, None]) & (lower <= most[own][:, None])

        def later(i, j, lower, upper):
            stay = np.zeros(len(i), bool)
            for s in range(slots):
                sure = upper <= hi[i, s] - 2e-12 * np.abs(hi[i, s])
                limit = np.fmax(_floor(kth(i[sure], lower[sure], k, n)), lo[:, s])[i]
                stay |= (upper >= limit) & (lower <= hi[i, s])
            return stay

        i, j, score = survivors(a, b["rows"], np.flatnonzero(~np.isnan(least)), np.arange(len(b["ids"])), first, later)
        for s in range(slots):
            positive = np.array([x[s] if s < len(x) else 0 for x in lists], np.int64)[i]
            there = ~np.isnan(p[i, s]) & (labels[i] != b["labels"][j]) & (low * positive <= 100 * score) & (100 * score <= high * positive)
            x, y, z = i[there], j[there], score[there]
            best = top(x, z, b["known"][y], b["ids"][y], k)
            x, y, z = x[best], y[best], z[best]
            slot = pa.array(np.full(len(x), s + 1, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(uid[x]), slot, pa.array(z), pa.array(b["ids"][y], mask=~b["known"][y])], ["uid", "slot", "score", "id"])


def _tiles(anchors: DataFrame, count: int) -> DataFrame:
    fields = [c for c in anchors.columns if c != "id"]
    held = anchors.withColumn("tile", F.pmod(F.xxhash64("uid"), F.lit(count)).cast("int"))
    return held.groupBy("tile").agg(F.collect_list(F.struct(*fields)).alias("anchor"))


def mine(vectors: DataFrame, id: str = "vec_id", label: Column | str = "label", embedding: str = "embedding", anchor_every: int = 100, cfg: Mining = Mining()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for
    the anchors, rows whose id is divisible by anchor_every. Input columns may have
    any names; only the three named are read."""
    spark = vectors.sparkSession
    quoted = F.col(f"`{label}`") if isinstance(label, str) else label
    rows = vectors.select(F.col(f"`{id}`").cast("long").alias("id"), quoted.cast("long").alias("label"), F.col(f"`{embedding}`").alias("embedding"))
    rows = rows.where("label is not null and embedding is not null")
    order = (F.desc("score"), F.asc_nulls_last("id"))
    with temporary(spark):
        width = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
        blocks = spill(to_blocks(rows, width, anchor_every, cfg), "blocks")
        count = max(1, -(-(blocks.agg(F.sum("anchors")).first()[0] or 0) // TILE))
        turn = rotation(blocks, width) if width else np.zeros((0, 0))

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n, block in enumerate(batch.column(0).to_pylist()):
                    ids, known, labels = (np.frombuffer(batch.column(k)[n].as_buffer(), t) for k, t in ((1, np.int64), (2, bool), (3, np.int64)))
                    ints = np.frombuffer(batch.column(4)[n].as_buffer(), np.int32).reshape(len(ids), width)
                    at = np.flatnonzero(known & (ids % anchor_every == 0))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(block * BLOCK_ROWS + at), pa.array(ids[at]), pa.array(labels[at]), pa.array([ints[i].tobytes() for i in at], pa.binary())],
                        ["uid", "id", "label", "ints"],
                    )

        anchors = spill(blocks.where("anchors > 0").select("block", "ids", "known", "labels", "ints").mapInArrow(pick, "uid long, id long, label long, ints binary"), "anchors")
        found = _visits(blocks, _tiles(anchors, count), count, Positives(turn, cfg), "uid long, score long, id long")
        slot = F.row_number().over(Window.partitionBy("uid").orderBy(*order))
        best = found.withColumn("slot", slot).where(F.col("slot") <= cfg.positives)
        positives = spill(best.join(anchors.select("uid", F.col("id").alias("anchor_id")), "uid"), "positives")
        scores = positives.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("slot", "score"))).alias("s")).select("uid", F.col("s.score").alias("scores"))
        found = _visits(blocks, _tiles(anchors.join(scores, "uid"), count), count, Negatives(turn, cfg), "uid long, slot int, score long, id long")
        rank = F.row_number().over(Window.partitionBy("uid", "slot").orderBy(*order))
        best = found.withColumn("rank", rank).where(F.col("rank") <= cfg.negatives)
        named = positives.select("uid", "slot", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        out = best.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(named, ["uid", "slot"])
        out = spill(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives", keep=True)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")
    label = F.col("label").cast("long")
    return mine(vectors, label=F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
