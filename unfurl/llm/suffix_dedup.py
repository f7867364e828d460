"""Exact-substring removal over a sparse, distributed suffix array.

A byte goes if a string of `length` bytes that covers it also starts earlier (in
a text with a smaller id, or earlier in the same text). Every such string holds
one anchor: the place of the smallest hash of `gram` bytes within it, leftmost
on ties, which depends on the string's bytes alone, so equal strings have equal
anchors at equal offsets. A block is a run of string starts with one anchor and
the bytes these strings cover; about one place in forty is an anchor.

1. Blocks that are equal as a whole meet by hash: the earliest stays, the others
   go. Where a gram is found in several different blocks, these go on.
2. Their suffixes, from the anchor on, are range-partitioned by leading bytes with
   sampled splitters into buckets of bounded size, sorted by multikey quicksort,
   eight bytes at a time, and compared with their sorted neighbours; the first and
   last suffix of a bucket are compared across its boundary. That bounds how far a
   suffix agrees with any other; the same is done to the left of the anchor among
   suffixes that share the gram.
3. Strings within both bounds are the only ones that can start elsewhere too. They
   meet by a 128-bit hash, and all but the earliest mark their bytes.

What meets is first reduced within every task to the earliest of equal ones, so
a passage that a third of all texts share sends one row a task and flush. Grams
that a sample of the texts shows to be very frequent are dealt by block rather
than by gram, which changes no result: they are taken to have several blocks. A
long text is cut into overlapping pieces, so no array grows with a text.

Equality is that of two independent 64-bit hashes together. Strings never cross
texts. Rows equal in id and text are one row and get the same result; different
texts of one id come in the order of their hashes. Null ids come first; null texts
are empty. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _words
from ._dist import numbered, row_numbers, shuffle_width, spill, temporary

LENGTH, GRAM = 100, 24
#: Blocks or strings that a task holds before it sends them on.
FLUSH = 200_000
#: Parts of a partition, which are met one after the other.
SPLIT = 16
#: Suffixes in a bucket, on average.
BUCKET = 40_000
#: One text in so many is looked at for very frequent grams; at most HOT of them.
SAMPLE, HOT = 64, 10_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def anchors(b: _words.Block, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first string start, last string start), as places in the block:
    each run of string starts that share an anchor, in order."""
    none = np.zeros(0, np.int64)
    size, span = len(b.data), length - gram + 1
    if size < length:
        return none, none, none
    hashes = _words.Hasher(b.data)
    at = np.arange(size - gram + 1)
    wide = 32  # the same at every block size, so ties fall alike
    key = ((hashes.of(at, at + gram) >> np.uint64(wide)) << np.uint64(wide)) | at.astype(np.uint64)
    # Sliding minimum over span keys: prefix and suffix minima of blocks of span.
    pad = -len(key) % span
    full = np.concatenate([key, np.full(pad, np.uint64(2**64 - 1))]).reshape(-1, span)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(size - length + 1)
    anchor = (np.minimum(back[starts], ahead[starts + span - 1]) & np.uint64((1 << wide) - 1)).astype(np.int64)
    text = b.text_of(starts)
    inside = starts + length <= b.offsets[text + 1]
    starts, anchor, text = starts[inside], anchor[inside], text[inside]
    if not len(starts):
        return none, none, none
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return anchor[first], starts[first], starts[last]


def pieces(column: pa.Array, length: int) -> Iterator[tuple[_words.Block, int]]:
    """Blocks of whole texts, and long texts in pieces that share length - 1 bytes
    with the next one, with the place of the piece in its text."""
    for b in _words.blocks(column):
        if b.n > 1 or len(b.data) <= _words.BLOCK_BYTES:
            yield b, 0
            continue
        for lo in range(0, len(b.data) - length + 1, _words.BLOCK_BYTES):
            part = b.data[lo : lo + _words.BLOCK_BYTES + length - 1]
            yield _words.Block(b.first, part, np.array([0, len(part)])), lo


# Meeting by hash ---------------------------------------------------------------

#: g, key: hashes that say what is equal; doc, start: where; off: the anchor's
#: offset from the first string; n: number of strings.
KINDS = (np.uint64, np.uint64, np.int64, np.uint32, np.uint16, np.uint16)
MARKS, WANTED = (np.uint32, np.uint32), (np.uint32, np.uint16, np.uint16)
MET = "doc long, marks binary, wanted binary"
Cols = list[np.ndarray]


def pack(cols: Cols, kinds: tuple) -> bytes:
    return b"".join(c.astype(k).tobytes() for c, k in zip(cols, kinds))


def unpack(data: list[bytes], kinds: tuple) -> Cols:
    """Columns of all packed records, one after the other."""
    sizes = [np.dtype(k).itemsize for k in kinds]
    out: list[list[np.ndarray]] = [[] for _ in kinds]
    for x in data:
        n, at = len(x) // sum(sizes), 0
        for held, k, s in zip(out, kinds, sizes):
            held.append(np.frombuffer(x, k, n, at))
            at += n * s
    return [np.concatenate([np.zeros(0, k), *held]) for held, k in zip(out, kinds)]


def earliest(cols: Cols) -> tuple[Cols, np.ndarray, np.ndarray]:
    """Columns sorted by g, key, doc and start; which rows are the earliest of
    their equals, and which are later ones (neither: the same place again)."""
    g, key, doc, start = cols[:4]
    order = np.lexsort((start, doc, key, g))
    cols = [c[order] for c in cols]
    g, key, doc, start = cols[:4]
    head = np.ones(len(g), bool)
    head[1:] = (g[1:] != g[:-1]) | (key[1:] != key[:-1])
    first = np.flatnonzero(head)[np.cumsum(head) - 1] if len(g) else np.zeros(0, np.int64)
    late = (doc != doc[first]) | (start != start[first])
    return cols, head, late


def merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> Cols:
    """Byte ranges by doc, overlapping and touching ones joined."""
    if not len(doc):
        return [doc, lo, hi]
    order = np.lexsort((lo, doc))
    doc, lo, hi = doc[order], lo[order].astype(np.int64), hi[order].astype(np.int64)
    run = np.cumsum(np.append(0, doc[1:] != doc[:-1])) << 33
    far = np.maximum.accumulate(run + hi)
    new = np.append(True, (run + lo)[1:] > far[:-1])
    return [doc[new], lo[new], far[np.append(np.flatnonzero(new)[1:], len(doc)) - 1] - run[new]]


def by_doc(doc: np.ndarray, cols: Cols, kinds: tuple, name: str) -> Iterator[pa.RecordBatch]:
    """Rows of MET, one a doc, for columns sorted by doc; name is filled."""
    if not len(doc):
        return
    cut = np.append(np.flatnonzero(np.append(True, doc[1:] != doc[:-1])), len(doc))
    for lo in range(0, len(cut) - 1, 20_000):
        at = cut[lo : lo + 20_001]
        data = pa.array([pack([c[i:j] for c in cols], kinds) for i, j in zip(at[:-1], at[1:])], pa.binary())
        none = pa.nulls(len(data), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(doc[at[:-1]]), *((data, none) if name == "marks" else (none, data))], ["doc", "marks", "wanted"])


class Sender:
    """Gathers records, reduces them to the earliest of equal ones and deals them
    out to SPLIT parts of each of width partitions, the byte ranges of the others
    too."""

    def __init__(self, width: int, length: int, hot: np.ndarray):
        self.parts, self.length, self.hot, self.held, self.n = width * SPLIT, length, hot, [], 0

    def add(self, *cols: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(cols[0]), FLUSH):
            self.held.append([c[lo : lo + FLUSH] for c in cols])
            self.n += len(self.held[-1][0])
            if self.n >= FLUSH:
                yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.held:
            return
        cols, head, late = earliest([np.concatenate([h[i] for h in self.held]) for i in range(len(KINDS))])
        self.held, self.n = [], 0
        doc, lo, n = cols[2][late], cols[3][late].astype(np.int64), cols[5][late]
        marks = merged(doc, lo, lo + n - 1 + self.length)
        own = [c[head] for c in cols]
        order = np.lexsort((own[3], own[2]))  # by place, which packs better
        own = [c[order] for c in own]
        g = np.where(np.isin(own[0], self.hot), _words.mix(own[0] ^ own[1]), own[0])
        recs, ranges = self.dealt(g, own, KINDS), self.dealt(marks[0].view(np.uint64), marks, (np.int64, *MARKS))
        parts = sorted(recs.keys() | ranges.keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(parts, pa.int32()), *[pa.array([x.get(p) for p in parts], pa.binary()) for x in (recs, ranges)]], ["part", "recs", "ranges"]
        )

    def dealt(self, key: np.ndarray, cols: Cols, kinds: tuple) -> dict[int, bytes]:
        part = (key % np.uint64(self.parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        cut = np.searchsorted(part[order], np.arange(self.parts + 1))
        return {int(p): pack([c[order[cut[p] : cut[p + 1]]] for c in cols], kinds) for p in np.flatnonzero(np.diff(cut))}


def meet(sent: DataFrame, length: int, hot: np.ndarray, width: int) -> DataFrame:
    """Rows of MET from what Senders sent: byte ranges to remove, and the blocks
    whose gram is in several different ones."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, recs, ranges = None, [], []
        for batch in batches:
            for i, part in enumerate(batch.column(0).to_pylist()):
                if part != last:
                    yield from of_part(recs, ranges)
                    last, recs, ranges = part, [], []
                for held, x in ((recs, batch.column(1)[i]), (ranges, batch.column(2)[i])):
                    if x.is_valid:
                        held.append(x.as_py())
        yield from of_part(recs, ranges)

    def of_part(recs: list[bytes], ranges: list[bytes]) -> Iterator[pa.RecordBatch]:
        cols, head, late = earliest(unpack(recs, KINDS))
        known = unpack(ranges, (np.int64, *MARKS))
        lo = cols[3][late].astype(np.int64)
        doc, *marks = merged(*[np.concatenate(p) for p in zip(known, (cols[2][late], lo, lo + cols[5][late] - 1 + length))])
        yield from by_doc(doc, marks, MARKS, "marks")
        own = [c[head] for c in cols]
        g = own[0]
        same = g[1:] == g[:-1]
        several = np.isin(g, hot)
        several[1:] |= same
        several[:-1] |= same
        _, _, doc, start, off, n = (c[several] for c in own)
        order = np.lexsort((start, doc))
        yield from by_doc(doc[order], [c[order] for c in (start, off, n)], WANTED, "wanted")

    parts = sent.repartitionById(width, (F.col("part") / SPLIT).cast("int")).sortWithinPartitions("part")
    return parts.mapInArrow(scan, MET)


def blocks_sent(docs: DataFrame, length: int, gram: int, hot: np.ndarray, width: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sender(width, length, hot)
        for batch in batches:
            doc = batch.column(1).to_numpy()
            for b, base in pieces(batch.column(0), length):
                at, lo, hi = anchors(b, length, gram)
                text = b.text_of(lo)
                g = _words.Hasher(b.data).of(at, at + gram)
                key = _words.mix(_words.Hasher(b.data, second=True).of(lo, hi + length) + (at - lo).astype(np.uint64) * _GOLD)
                yield from out.add(g, key, doc[b.first + text], lo - b.offsets[text] + base, at - lo, hi - lo + 1)
        yield from out.flush()

    return docs.select("text", "doc").mapInArrow(scan, "part int, recs binary, ranges binary")


def hot_grams(docs: DataFrame, length: int, gram: int) -> np.ndarray:
    """Sorted hashes of grams with at least 1 / HOT of a sample's anchors, hence
    HOT at most; only how records are dealt depends on them."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros(0, np.uint64)]
            for b, _ in pieces(batch.column(0), length):
                at, _, _ = anchors(b, length, gram)
                found.append(_words.Hasher(b.data).of(at, at + gram))
            g, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], ["g", "n"])

    some = docs.where(F.pmod(F.xxhash64("doc", F.lit("sample")), F.lit(SAMPLE)) == 0).select("text")
    counts = some.mapInArrow(scan, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    every = counts.groupBy(F.when(F.col("n") >= 32, F.col("g")).alias("g")).agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    found = every.withColumn("total", total).where(f"g is not null and n * {HOT} >= total").select("g").collect()
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


# Sorting -----------------------------------------------------------------------


def packed(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as eight-byte big-endian words, which sort alike."""
    pad = np.zeros((len(rows), -rows.shape[1] % 8), np.uint8)
    return np.ascontiguousarray(np.hstack([rows, pad])).view(">u8").astype(np.uint64)


def multikey_sort(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): rows sorted by their words, and equal rows' group numbers
    in that order. Word by word, only rows in runs that are still equal are
    partitioned further, as multikey quicksort does character by character."""
    n = len(words)
    order, group = np.arange(n), np.zeros(n, np.int64)
    active = np.arange(n) if n > 1 else np.zeros(0, np.int64)  # places in order
    for d in range(words.shape[1]):
        if not len(active):
            break
        w = words[order[active], d]
        moved = np.lexsort((w, group[active]))
        order[active] = order[active][moved]
        w, g = w[moved], group[active]
        cut = np.ones(len(active), bool)
        cut[1:] = (w[1:] != w[:-1]) | (g[1:] != g[:-1])
        # A run's number is the place of its first row, so numbers stay ordered.
        heads = active[np.flatnonzero(cut)]
        group[active] = heads[np.cumsum(cut) - 1]
        size = np.diff(np.append(np.flatnonzero(cut), len(active)))
        active = active[np.repeat(size > 1, size)]
    return order, group


def binary_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a binary column without nulls."""
    column = column.cast(pa.large_binary())
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(rows, width) bytes, zero beyond each row's end, and the rows' lengths."""
    offsets, data = binary_buffers(column)
    size = np.diff(offsets)
    out = np.zeros((len(size), int(size.max(initial=0))), np.uint8)
    out[np.arange(out.shape[1]) < size[:, None]] = data[offsets[0] : offsets[-1]]
    return out, size


def common(rows: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of rows a and b."""
    equal = np.hstack([rows[a] == rows[b], np.zeros((len(a), 1), bool)])
    return np.minimum(equal.argmin(1), np.minimum(size[a], size[b]))


def furthest(rows: DataFrame, buckets: int, keep: str) -> DataFrame:
    """rows (key binary, doc, start and more) with far: the longest common prefix
    of the row's key with that of any other row, which is that with a sorted
    neighbour. Only rows that meet the condition keep are returned. doc and start
    make the order of rows, and so a bucket's first and last one, unique."""
    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    names = rows.columns
    at_key = names.index("key")

    def bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held).combine_chunks()
        key, size = matrix(t.column(at_key))
        # Zeros beyond the end and then the length sort as the bytes do.
        ties = np.stack([size, t.column("doc").to_numpy(), t.column("start").to_numpy()], 1).astype(np.uint64)
        order, _ = multikey_sort(np.hstack([packed(key), ties]))
        near = common(key, size, order[:-1], order[1:])
        far = np.zeros(len(order), np.int64)
        far[order[:-1]] = near
        far[order[1:]] = np.maximum(far[order[1:]], near)
        side = np.zeros(len(order), np.int32)
        side[order[0]] += 1
        side[order[-1]] += 2
        part = pa.array(np.full(len(order), TaskContext.get().partitionId(), np.int32))
        out = t.append_column("far", pa.array(far.astype(np.int32))).append_column("part", part).append_column("side", pa.array(side))
        yield from out.to_batches()

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = batch.column("far").to_numpy().astype(np.int64)
            n = batch.num_rows
            for other in ("before", "after"):
                both = pa.concat_arrays([batch.column("key").cast(pa.large_binary()), batch.column(other).fill_null(b"").cast(pa.large_binary())])
                key, size = matrix(both)
                best = np.maximum(best, common(key, size, np.arange(n), np.arange(n) + n))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(best.astype(np.int32))], [*names, "far"])

    ranged = rows.repartitionByRange(buckets, *[F.col(c) for c in ("key", *[c for c in names if c != "key"])])
    done = ranged.mapInArrow(bucket, f"{schema}, far int, part int, side int").where(f"side > 0 or {keep}")
    # Two rows of every bucket, each beside its neighbour in the next one.
    line = Window.orderBy("part", "side")
    edges = done.where("side > 0").withColumns({"before": F.lag("key").over(line), "after": F.lead("key").over(line)})
    fixed = edges.select(*names, "far", "before", "after").mapInArrow(across, f"{schema}, far int").where(keep)
    return done.where(f"side = 0 and {keep}").select(*names, "far").union(fixed)


def gathered(data: np.ndarray, at: np.ndarray, size: np.ndarray, step: int = 1) -> pa.Array:
    """Binary column of size bytes of data from each place on (step 1) or, with
    step -1, backwards from each place."""
    cut = np.concatenate([[0], np.cumsum(size)])
    k = np.arange(cut[-1]) - np.repeat(cut[:-1], size)
    return pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(cut.tobytes()), pa.py_buffer(data[np.repeat(at, size) + step * k].tobytes())])


def suffixes(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(key, back, doc, start) of the wanted blocks: bytes from the anchor to the
    block's end, bytes before it in reverse, and the block's place."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _words.blocks(batch.column(0)):
                places = [unpack([x.as_py() for x in batch.column(2)[b.first + i].values], WANTED) for i in range(b.n)]
                many = [len(p[0]) for p in places]
                start, off, n = (np.concatenate([p[i] for p in places]).astype(np.int64) for i in range(3))
                at = np.repeat(b.offsets[:-1], many) + start + off
                yield pa.RecordBatch.from_arrays(
                    [
                        gathered(b.data, at, n - 1 - off + length).cast(pa.binary()),
                        gathered(b.data, at - 1, off, -1).cast(pa.binary()),
                        pa.array(np.repeat(batch.column(1).to_numpy()[b.first : b.first + b.n], many)),
                        pa.array(start.astype(np.int32)),
                    ],
                    ["key", "back", "doc", "start"],
                )

    places = wanted.groupBy(F.col("doc").alias("wdoc")).agg(F.collect_list("wanted").alias("places")).hint("shuffle_hash")
    texts = docs.select("text", "doc").join(places, F.col("doc") == F.col("wdoc")).select("text", "doc", "places")
    return texts.mapInArrow(scan, "key binary, back binary, doc long, start int")


def strings_sent(rows: DataFrame, length: int, width: int) -> DataFrame:
    """rows: ahead, back (bytes from the anchor on and, reversed, before it), doc,
    start, lo and hi: offsets of the anchor in the strings that are sent."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sender(width, length, np.zeros(0, np.uint64))
        for whole in batches:
            for some in range(0, whole.num_rows, 2000):
                batch = whole.slice(some, 2000)
                (ao, ad), (bo, bd) = binary_buffers(batch.column(0)), binary_buffers(batch.column(1))
                off, size = np.diff(bo), np.diff(bo) + np.diff(ao)
                cut = np.concatenate([[0], np.cumsum(size)])
                row = np.repeat(np.arange(len(size)), size)
                k = np.arange(cut[-1]) - cut[row]
                front = k < off[row]
                data = np.empty(cut[-1], np.uint8)
                data[front] = bd[(bo[1:][row] - 1 - k)[front]]
                data[~front] = ad[(ao[:-1][row] + k - off[row])[~front]]
                doc, start, lo, hi = (batch.column(i).to_numpy().astype(np.int64) for i in range(2, 6))
                many = hi - lo + 1
                row = np.repeat(np.arange(len(many)), many)
                first = off[row] - lo[row] - (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many))
                at = cut[row] + first
                g, key = (_words.Hasher(data, second=s).of(at, at + length) for s in (False, True))
                yield from out.add(g, key, doc[row], start[row] + first, np.zeros(len(row)), np.ones(len(row), np.int64))
        yield from out.flush()

    return rows.select("ahead", "back", "doc", "start", "lo", "hi").mapInArrow(scan, "part int, recs binary, ranges binary")


# Texts ---------------------------------------------------------------------------


def placed(docs: DataFrame) -> DataFrame:
    """docs (id, text) with doc, a number in the order of ids: the id itself where
    ids are whole numbers and no id has two texts, else the rank of id and text."""
    rows = docs.select("id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    if dict(rows.dtypes)["id"] in ("tinyint", "smallint", "int", "bigint"):
        k = F.xxhash64("text")
        odd = rows.groupBy("id").agg(F.min(k).alias("a"), F.max(k).alias("b")).where("id is null or a <> b")
        if odd.limit(1).count() == 0:
            return rows.withColumn("doc", F.col("id").cast("long"))
    keyed = rows.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})
    ids = keyed.select("id", "k1", "k2").distinct()
    ranks = row_numbers(numbered(ids, F.col("id").asc_nulls_first(), F.col("k1"), F.col("k2"), name="ranks"), "doc")
    ranks = ranks.select(F.col("id").alias("rid"), F.col("k1").alias("r1"), F.col("k2").alias("r2"), "doc").hint("shuffle_hash")
    same = F.col("id").eqNullSafe(F.col("rid")) & (F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2"))
    return spill(keyed.join(ranks, same).select("id", "text", "doc"), "texts", keep=True)


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs: doc, text. (doc, ranges): packed byte ranges to remove."""
    # Parts are met one by one, so a few large partitions do, and write few files.
    width = max(docs.sparkSession.sparkContext.defaultParallelism, shuffle_width(docs.sparkSession) // 4)
    hot = hot_grams(docs, length, gram)
    found = spill(meet(blocks_sent(docs, length, gram, hot, width), length, hot, width), "blocks")
    wanted = found.where("wanted is not null").select("doc", "wanted")
    rows = suffixes(docs, wanted, length)
    size = sum(np.dtype(k).itemsize for k in WANTED)
    many = wanted.agg(F.sum(F.octet_length("wanted"))).first()[0] or 0
    buckets = max(1, -(-many // (size * BUCKET)))
    off, n = "length(back)", f"(length(ahead) - {length} + 1 + length(back))"
    ahead = furthest(rows, buckets, f"far >= {gram} and far + length(back) >= {length}")
    ahead = ahead.select(F.col("key").alias("ahead"), "back", "doc", "start", F.col("far").alias("reach"))
    both = furthest(
        ahead.withColumn("key", F.concat(F.substring("ahead", 1, gram), "back")), buckets, f"far >= {gram} and reach + far >= {length + gram}"
    )
    lo, hi = f"greatest({length} - reach, {off} - {n} + 1)", f"least({off}, far - {gram})"
    live = both.withColumns({"lo": F.expr(lo).cast("int"), "hi": F.expr(hi).cast("int")}).where("lo <= hi")
    strings = meet(strings_sent(live, length, width), length, np.zeros(0, np.uint64), width)
    marks = found.select("doc", "marks").union(strings.select("doc", "marks")).where("marks is not null")
    return marks.groupBy("doc").agg(F.collect_list("marks").alias("ranges"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text, ranges) to what is removed and the bytes left."""
    for batch in batches:
        for some in range(0, batch.num_rows, 500):
            ids, texts, ranges = batch.slice(some, 500).columns
            size, removed, spans, sha, kept = [], [], [], [], []
            for text, held in zip(texts, ranges):
                raw = text.as_py().encode()
                lo, hi = unpack([x.as_py() for x in held.values] if held.is_valid else [], MARKS)
                _, lo, hi = merged(np.zeros(len(lo), np.int64), lo, hi)
                cuts = [0, *np.stack([lo, hi], 1).ravel().tolist(), len(raw)]
                left = b"".join(raw[i:j] for i, j in zip(cuts[::2], cuts[1::2])) if len(lo) else raw
                size.append(len(raw))
                removed.append(len(raw) - len(left))
                spans.append(len(lo))
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left if len(lo) else None)
            cols = [pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays([ids, *cols], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs: id, text. One row per row: id, n_bytes, n_removed, n_spans,
    kept_sha256 and kept, the bytes left (null if nothing was removed)."""
    with temporary(docs.sparkSession):
        texts = placed(docs)
    with temporary(docs.sparkSession):
        gone = spill(repeats(texts, length, gram), "ranges", keep=True)
    gone = gone.select(F.col("doc").alias("gdoc"), "ranges").hint("shuffle_hash")
    rows = texts.join(gone, F.col("doc") == F.col("gdoc"), "left").select("id", "text", "ranges")
    kind = dict(texts.dtypes)["id"]
    return rows.mapInArrow(_cut, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    return remove_repeats(docs).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
