"""Benchmark decontamination over a distributed positional inverted index.

The index is partitioned by document and stored once: a row holds a document's
different terms, as 64-bit hashes in order, and each term's list of positions.
Test items are cut into windows of words. A search takes the stored lists some
hundred documents at a time, starts each window from the term that is rarest
there and intersects the other terms' offset-adjusted lists with it, rarest
first, which gives exact phrase matches; with slack, it asks whether the lists
all have a position within a span of words, which gives proximity matches.

Neither indexing nor search moves a document's words between tasks. Windows are
broadcast in blocks of a fixed number, so what is sent is bounded however large
the benchmark is; every block reads the index, not the texts. Only hits are
joined, by row number, so copies of one text meet nowhere.

Null and empty texts have no words and no hits; items without words have no
windows; repeated rows each get a row; an empty table on either side gives no
hits. Input columns named like an output are replaced, any other name is free.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words
from ._dist import hidden, shown, spill, temporary

WIDTH = 10
#: Windows searched in one pass; bounds the broadcast terms to some MB.
BLOCK_WINDOWS = 200_000
#: Postings, and candidate places, that a task looks at together.
SHARD, SLICE = 1 << 20, 1 << 20
POS_BITS = 36
HIT = "rid long, item_id long, start int, len int"


def item_windows(items: list[tuple[int, str | None]], width: int) -> list[tuple[int, list[int]]]:
    """(item_id, term hashes) of every window, as signed 64-bit numbers."""
    out = []
    for b in _words.blocks(pa.array([t for _, t in items], pa.string())):
        w = _words.words(b, _words.lower(b.data), _words.NOT_ALNUM)
        at = np.concatenate([[0], np.cumsum(w.count)])
        h = w.hash.view(np.int64).tolist()
        for i in range(b.n):
            lo, hi = int(at[i]), int(at[i + 1])
            size = min(width, hi - lo)
            out += [(items[b.first + i][0], h[k : k + size]) for k in range(lo, hi - size + 1) if size]
    return out


def _blocks(items: DataFrame, width: int, limit: int) -> Iterator[list[tuple[int, list[int]]]]:
    held: list[tuple[int, list[int]]] = []
    for row in items.select("item_id", "text").toLocalIterator():
        held += item_windows([(row[0], row[1])], width)
        while len(held) >= limit:
            yield held[:limit]
            held = held[limit:]
    if held:
        yield held


def index(docs: DataFrame, text: str) -> DataFrame:
    """The stored index: docs without its text, with rid, a row number, n_words,
    and terms, ends and places: a document's different terms (8 bytes each), the
    end of each one's list, and all lists of positions (4 bytes each)."""
    slim = docs.withColumn("rid", F.monotonically_increasing_id()).select(*[c for c in docs.columns if c != text], "rid", text)
    at = len(slim.columns) - 1
    own = ["n_words", "terms", "ends", "places"]
    schema = ", ".join(f"`{n}` {t}" for n, t in slim.dtypes[:at]) + ", n_words long, terms binary, ends binary, places binary"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in _words.blocks(batch.column(at)):
                w = _words.words(b, _words.lower(b.data), _words.NOT_ALNUM)
                first = np.concatenate([[0], np.cumsum(w.count)])
                order = np.lexsort((w.hash, w.text))
                h, t = w.hash[order], w.text[order]
                place = (order - first[t]).astype(np.uint32)
                new = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (t[1:] != t[:-1]))) if len(h) else np.zeros(0, np.int64)
                end = (np.append(new[1:], len(h)) - first[t[new]]).astype(np.uint32)
                many = np.concatenate([[0], np.cumsum(np.bincount(t[new], minlength=b.n))]).tolist()
                head, first = h[new], first.tolist()
                cols = [
                    pa.array(w.count.astype(np.int64)),
                    *[pa.array([x[c[i] : c[i + 1]].tobytes() for i in range(b.n)], pa.binary()) for x, c in ((head, many), (end, many), (place, first))],
                ]
                yield pa.RecordBatch.from_arrays([*[c[b.first : b.first + b.n] for c in batch.columns[:at]], *cols], [*batch.schema.names[:at], *own])

    return spill(slim.mapInArrow(scan, schema), "index")


class Windows:
    """A block of windows as term numbers, and the places where lists meet."""

    def __init__(self, held: list[tuple[int, list[int]]]):
        self.item = np.array([i for i, _ in held], np.int64)
        self.size = np.array([len(t) for _, t in held])
        flat = np.fromiter((t for _, ts in held for t in ts), np.int64).view(np.uint64)
        self.terms = np.unique(flat)
        self.term = np.full((len(held), int(self.size.max())), -1, np.int64)
        self.term[np.arange(self.term.shape[1]) < self.size[:, None]] = np.searchsorted(self.terms, flat)

    def candidates(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(window, place of its rarest term, its other terms' offsets, rarest
        first), some at a time; keys: all lists, as term number and position."""
        cut = np.searchsorted(keys, np.arange(len(self.terms) + 1) << POS_BITS)
        count = np.append(np.diff(cut), len(keys) + 1)[self.term]  # the last for -1
        live = np.flatnonzero(count.min(1) > 0)
        order = np.argsort(count[live], axis=1, kind="stable")
        many = count[live, order[:, 0]]
        ends = np.cumsum(many)
        for lo in range(0, int(ends[-1]) if len(ends) else 0, SLICE):
            k = np.arange(lo, min(lo + SLICE, int(ends[-1])))
            row = np.searchsorted(ends, k, side="right")
            window = live[row]
            list_at = cut[self.term[window, order[row, 0]]]
            yield window, keys[list_at + k - (ends - many)[row]] & ((1 << POS_BITS) - 1), order[row]

    def exact(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, first position) of every phrase match."""
        for window, at, order in self.candidates(keys):
            start = at - order[:, 0]
            for step in range(1, self.term.shape[1]):
                term, offset = self.term[window, order[:, step]], order[:, step]
                key = (term << POS_BITS) | (start + offset)
                k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                ok = (term < 0) | (keys[k] == key)
                window, start, order = window[ok], start[ok], order[ok]
            yield window, start

    def near(self, keys: np.ndarray, slack: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, first position) of every span of as many words as the window
        has, and slack more, that holds all its terms."""
        for window, at, order in self.candidates(keys):
            reach = self.size[window] + slack
            row = np.repeat(np.arange(len(window)), reach)
            start = at[row] - (np.arange(len(row)) - np.repeat(np.cumsum(reach) - reach, reach))
            window, order, reach = window[row], order[row], reach[row]
            for step in range(1, self.term.shape[1]):
                term = self.term[window, order[:, step]]
                k = np.minimum(np.searchsorted(keys, (term << POS_BITS) | start), len(keys) - 1)
                ok = (term < 0) | ((keys[k] >= (term << POS_BITS) | start) & (keys[k] < (term << POS_BITS) | (start + reach)))
                window, start, order, reach = window[ok], start[ok], order[ok], reach[ok]
            yield window, start


def search(stored: DataFrame, held: list[tuple[int, list[int]]], slack: int | None) -> DataFrame:
    """HIT of every match of the block's windows: exact ones, or with slack spans
    of len words that hold all words of a window in any order."""
    shared = stored.sparkSession.sparkContext.broadcast(Windows(held))
    gap = WIDTH if slack is None else 0
    gap = max(gap, max(len(t) for _, t in held)) + (slack or 0)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w: Windows = shared.value
        for batch in batches:
            n = np.cumsum(batch.column(1).to_numpy())
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(n, (n[lo - 1] if lo else 0) + SHARD, side="right")))
                yield from shard(w, batch.slice(lo, hi - lo))
                lo = hi

    def shard(w: Windows, batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rid, count = (batch.column(i).to_numpy() for i in (0, 1))
        joined = lambda i, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in batch.column(i)])
        terms, ends, places = joined(2, np.uint64), joined(3, np.uint32).astype(np.int64), joined(4, np.uint32).astype(np.int64)
        if not len(terms):
            return
        many = np.array([len(x.as_buffer()) // 8 for x in batch.column(2)])
        base = gap + np.concatenate([[0], np.cumsum(count + 2 * gap)[:-1]])  # no match reaches into another document
        own = np.repeat(np.arange(len(many)), many)
        length = np.diff(ends, prepend=0)
        length[np.cumsum(many)[many > 0] - many[many > 0]] = ends[np.cumsum(many)[many > 0] - many[many > 0]]
        number = np.minimum(np.searchsorted(w.terms, terms), len(w.terms) - 1)
        number[w.terms[number] != terms] = -1
        number, place = np.repeat(number, length), places + np.repeat(base[own], length)
        keys = np.sort(((number << POS_BITS) | place)[number >= 0])
        if not len(keys):
            return
        for window, start in w.exact(keys) if slack is None else w.near(keys, slack):
            doc = np.searchsorted(base, start + gap, side="right") - 1
            found = np.unique(np.stack([doc, w.item[window], start - base[doc], w.size[window] + (slack or 0)], 1), axis=0)
            if len(found):
                d, item, at, size = found.T
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rid[d]), pa.array(item), pa.array(at.astype(np.int32)), pa.array(size.astype(np.int32))], ["rid", "item_id", "start", "len"]
                )

    return stored.select("rid", "n_words", "terms", "ends", "places").mapInArrow(scan, HIT)


def matches(stored: DataFrame, items: DataFrame, width: int = WIDTH, slack: int | None = None, block: int = BLOCK_WINDOWS) -> DataFrame:
    """HIT of all items' windows in the indexed documents."""
    found = [search(stored, held, slack) for held in _blocks(items, width, block)]
    if not found:
        return stored.sparkSession.createDataFrame([], HIT)
    return reduce(DataFrame.union, found)


def hits(stored: DataFrame, items: DataFrame, width: int) -> DataFrame:
    """(rid, n_hit, items) of the documents with hits; items sorted as strings."""

    def covered(spans):
        """Words in the union of (start, end) spans, which come in order."""
        zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        add = lambda a, s: F.struct(
            F.greatest(a["end"], s["end"]).alias("end"), (a["n"] + F.greatest(s["end"] - F.greatest(a["end"], s["start"]), F.lit(0))).alias("n")
        )
        return F.aggregate(spans, zero, add)["n"]

    span = F.struct("start", (F.col("start") + F.col("len")).alias("end"))
    return (
        matches(stored, items.select("item_id", "text"), width)
        .groupBy("rid")
        .agg(F.sort_array(F.collect_set(span)).alias("spans"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
        .select(F.col("rid").alias("hit"), covered(F.col("spans")).alias("n_hit"), "items")
    )


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs without text, with n_words, n_hit, n_items, items (sorted as strings)
    and contaminated."""
    rows, names = hidden(docs.drop("n_words", "n_hit", "n_items", "items", "contaminated"))
    at = names.index("text")
    stored = index(rows, f"in_{at}")
    found = hits(stored, items, width)
    return (
        stored.drop("terms", "ends", "places")
        .join(found, F.col("rid") == F.col("hit"), "left")
        .withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("long"))
        .withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
        .withColumns({"n_items": F.size("items").cast("long"), "contaminated": F.col("n_hit") > 0})
        .select(*[F.col(f"in_{i}").alias(n) for i, n in enumerate(names) if i != at], "n_words", "n_hit", "n_items", "items", "contaminated")
    )


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """docs without the rows that hold a window of an item. Texts that do are
    known by two 64-bit hashes."""
    rows, names = hidden(docs)
    text = f"in_{names.index('text')}"
    keys = [F.xxhash64(F.col(text)), F.xxhash64(F.lit(1), F.col(text))]
    with temporary(docs.sparkSession):
        stored = index(rows.select(keys[0].alias("k1"), keys[1].alias("k2"), text), text)
        found = matches(stored, items.select("item_id", "text"), width).select("rid").distinct()
        dirty = stored.select("rid", "k1", "k2").join(found, "rid")
        dirty = spill(dirty.select("k1", "k2").distinct(), "contaminated", keep=True)
    return rows.withColumns({"k1": keys[0], "k2": keys[1]}).join(dirty, ["k1", "k2"], "left_anti").select(*shown(names))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = contamination(docs, items)
    return out.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )
