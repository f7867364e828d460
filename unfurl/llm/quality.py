"""Quality rules by distribution divergence.

Every document's histogram over character classes and over its language's
common words is compared with the language's reference by Jensen-Shannon
distance (base 2, so between 0 and 1); documents too short for a histogram to
mean anything pass that test. References are sums over all documents of a
language, however rare it is; the most frequent languages' are held by the driver,
the others' joined. A language's common words are those with at least word_share
of its words, by exact counts of all words over the whole table: only these come
to the driver, and how rows fall into batches and partitions changes nothing.

Beside it stand exact rules on words, symbols, repeated lines and repeated
five-word windows. Null and empty texts have no words and fail the base rule;
null and empty languages use the corpus reference; every row gets a row; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words
from ._dist import hidden, shown, spill, temporary

CLASSES, SALTS = 9, 256
_CLASS = np.full(256, 7, np.int64)  # other ASCII and control
_CLASS[[*range(97, 123)]] = 0
_CLASS[[*range(65, 91)]] = 1
_CLASS[[*range(48, 58)]] = 2
_CLASS[[*range(9, 14), 32]] = 3
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 4
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 5
_CLASS[192:] = 6  # first byte of a non-ASCII character
_CLASS[128:192] = 8  # its other bytes, not counted
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    max_repeat_percent: int = 20
    class_distance: float = 0.27
    word_distance: float = 0.40
    min_chars: int = 100
    short_chars: int = 250
    short_class_distance: float = 0.45
    min_words_for_words: int = 50
    word_share: float = 0.004
    max_languages: int = 1000  # held by the driver; a performance parameter


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row-wise Jensen-Shannon distance of histograms; 0 where one is empty."""
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = p / p.sum(-1, keepdims=True), q / q.sum(-1, keepdims=True)
        m = (a + b) / 2
        div = np.where(a > 0, a * np.log2(a / m), 0).sum(-1) / 2 + np.where(b > 0, b * np.log2(b / m), 0).sum(-1) / 2
    return np.nan_to_num(np.sqrt(np.maximum(div, 0)))


def _classes(b: _words.Block) -> np.ndarray:
    """Per text, characters of each class (the last, uncounted one set to 0)."""
    text = np.repeat(np.arange(b.n), np.diff(b.offsets))
    h = np.bincount(text * CLASSES + _CLASS[b.data], minlength=b.n * CLASSES).reshape(b.n, CLASSES)
    h[:, 8] = 0
    return h


def gather(docs: DataFrame) -> DataFrame:
    """(lang, kind, key, n) over all texts: kind 'class' counts a character class,
    'word' a word hash. Counts are summed per batch before the shuffle."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, code = np.unique(np.array(batch.column(1).to_pylist(), object).astype(str), return_inverse=True)
            classes = np.zeros((len(names), CLASSES), np.int64)
            parts: dict[int, list] = {}
            for b in _words.blocks(batch.column(0)):
                own = code[b.first : b.first + b.n]
                np.add.at(classes, own, _classes(b))
                w = _words.words(b, _words.lower(b.data), _words.SPACE)
                for k in np.unique(own):
                    parts.setdefault(int(k), []).append(np.unique(w.hash[own[w.text] == k].view(np.int64), return_counts=True))
            for k, held in parts.items():
                keys, inv = np.unique(np.concatenate([p[0] for p in held]), return_inverse=True)
                n = np.bincount(inv, weights=np.concatenate([p[1] for p in held]), minlength=len(keys)).astype(np.int64)
                for kind, key, many in (("class", np.arange(CLASSES), classes[k]), ("word", keys, n)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([names[k]] * len(key), pa.string()), pa.array([kind] * len(key), pa.string()), pa.array(key, pa.int64()), pa.array(many, pa.int64())],
                        ["lang", "kind", "key", "n"],
                    )

    return docs.select("text", "lang").mapInArrow(scan, "lang string, kind string, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))


@dataclass
class References:
    """By language: class histogram, common words sorted, and their counts with, at
    the end, that of all other words. head holds the most frequent languages and,
    under None, the whole corpus; tail is a table of all other languages, if any."""

    head: dict[str | None, tuple[np.ndarray, np.ndarray, np.ndarray]]
    tail: DataFrame | None


def reference(hist: list, total: int, common: list | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From (class, count) and (word, count) pairs."""
    classes = np.zeros(CLASSES)
    for k, n in hist:
        classes[k] = n
    found = np.array([tuple(x) for x in common or []], np.int64).reshape(-1, 2)
    keys, n = found[:, 0].copy().view(np.uint64), found[:, 1]
    order = np.argsort(keys)
    return classes, keys[order], np.append(n[order], (total or 0) - n.sum()).astype(float)


def references(docs: DataFrame, rules: Rules) -> References:
    """At most max_languages languages with 1 / word_share words each come to the
    driver, the others stay a table that measure() joins."""
    with temporary(docs.sparkSession):
        counts = spill(gather(docs.select("text", F.coalesce("lang", F.lit("")).alias("lang"))), "counts")
        pairs = F.collect_list(F.struct("key", "n"))

        def table(own: DataFrame) -> DataFrame:
            words = own.where("kind = 'word'").select("lang", "key", "n")
            sums = words.groupBy("lang").agg(F.sum("n").alias("total"))
            # A language may hold most words, so its total goes to every salt.
            limits = sums.select("lang", "total", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
            salted = words.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(limits, ["lang", "salt"])
            common = salted.where(F.col("n") >= rules.word_share * F.col("total")).groupBy("lang").agg(pairs.alias("common"))
            return own.where("kind = 'class'").groupBy("lang").agg(pairs.alias("hist")).join(sums, "lang", "left").join(common, "lang", "left")

        size = counts.where("kind = 'class' and lang <> ''").groupBy("lang").agg(F.sum("n").alias("n"))
        names = [r[0] for r in size.orderBy(F.desc("n"), "lang").limit(rules.max_languages).collect()]
        every = counts.groupBy("kind", "key").agg(F.sum("n").alias("n")).withColumn("lang", F.lit("*"))
        of = table(counts)
        head = {r["lang"]: reference(r["hist"], r["total"], r["common"]) for r in of.where(F.col("lang").isin(names)).collect()} if names else {}
        whole = table(every).first()
        head[None] = reference(whole["hist"], whole["total"], whole["common"]) if whole else reference([], 0, [])
        rest = (F.col("lang") != "") & ~F.col("lang").isin(names) if names else F.lit(False)
        return References(head, spill(of.where(rest), "languages", keep=True) if len(names) >= rules.max_languages else None)


OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, class_distance double, word_distance double"


def measure(docs: DataFrame, refs: References, rules: Rules = Rules()) -> DataFrame:
    """docs with OUT's columns, base_failed and kept; input columns of those
    names are replaced, any other name is free. docs has text and lang."""
    own = [c.split()[0] for c in OUT.split(", ")]
    slim, names = hidden(docs.drop(*own, "base_failed", "kept"))
    at_text, at_lang = names.index("text"), names.index("lang")
    schema = ", ".join([f"{n} {t}" for n, t in slim.dtypes] + [OUT])
    many, head = len(names), refs.head

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, known = batch.column(at_lang).to_pylist(), head
            if batch.num_columns > many:  # rows come with their language's reference
                first = {x: i for i, x in reversed(list(enumerate(langs)))}
                known = {x: reference(*[[tuple(p.values()) for p in v] if isinstance(v, list) else v for v in (c[i].as_py() for c in batch.columns[many:])]) for x, i in first.items()}
            parts = [_measure(b, langs[b.first : b.first + b.n], known, rules) for b in _words.blocks(batch.column(at_text))]
            cols = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(len(own))]
            kinds = [pa.int64()] * 5 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([*batch.columns[:many], *[pa.array(c, t) for c, t in zip(cols, kinds)]], [*slim_names, *own])

    slim_names, lang = slim.columns, f"in_{at_lang}"
    if refs.tail is None:
        out = slim.mapInArrow(scan, schema)
    else:
        here = F.coalesce(F.col(lang).isin([x for x in head if x is not None]) | (F.col(lang) == ""), F.lit(True))
        far = slim.where(~here).join(refs.tail.withColumnRenamed("lang", "of"), F.col(lang) == F.col("of"))
        out = slim.where(here).mapInArrow(scan, schema).union(far.select(*slim_names, "hist", "total", "common").mapInArrow(scan, schema))
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    # A number or an address shifts a short text's classes far.
    limit = F.when(F.col("word_chars") < rules.short_chars, rules.short_class_distance).otherwise(rules.class_distance)
    good = (F.col("class_distance") <= limit) & (F.col("word_distance") <= rules.word_distance)
    out = out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & good)
    return out.select(*shown(names), *own, "base_failed", "kept")


def _measure(b: _words.Block, langs: list, refs: dict[str | None, tuple], rules: Rules) -> list[np.ndarray]:
    w = _words.words(b, b.data, _words.SPACE)
    chars = (b.data & 0xC0) != 0x80
    inside = ~_words.SPACE[b.data]
    word_chars, symbols = b.sums(chars & inside), b.sums(SYMBOLS[b.data])
    # Lines: cut at line feeds and text ends.
    cut = b.data == 10
    ends = np.unique(np.concatenate([np.flatnonzero(cut), b.offsets[1:]]))
    starts = np.concatenate([[0], ends[:-1] + cut[np.minimum(ends[:-1], max(len(cut) - 1, 0))]]) if len(ends) else ends
    if len(b.data):
        starts = np.minimum(starts, ends)
        filled = np.concatenate([[0], np.cumsum(inside)])
        full = filled[ends] > filled[starts]
        starts, ends = starts[full], ends[full]
        text = b.text_of(starts)
        key = _words.mix(_words.Hasher(b.data).of(starts, ends) + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, first = np.unique(key, return_index=True)
        dup_lines = np.bincount(text, minlength=b.n) - np.bincount(text[first], minlength=b.n)
    else:
        dup_lines = np.zeros(b.n, np.int64)
    at, h = _words.windows(w, 5)
    h = _words.mix(h + w.text[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(h)
    same = np.zeros(len(h), bool)
    if len(h):
        equal = h[order][1:] == h[order][:-1]
        same[order[1:]] |= equal
        same[order[:-1]] |= equal
    edge = np.zeros(len(w.hash) + 1, np.int64)
    np.add.at(edge, at[same], 1)
    np.add.at(edge, at[same] + 5, -1)
    repeated = np.bincount(w.text, weights=np.cumsum(edge)[:-1] > 0, minlength=b.n).astype(np.int64)
    # Distances to the language references.
    classes = _classes(b).astype(float)
    low = _words.words(b, _words.lower(b.data), _words.SPACE)
    class_d, word_d = np.zeros(b.n), np.zeros(b.n)
    keys = [x if x in refs else None for x in langs]
    for lang in set(keys):
        if lang not in refs:
            continue
        hist, common, counts = refs[lang]
        own = np.array([k == lang for k in keys])
        class_d[own] = js_distance(classes[own], hist[None, :])
        if len(common):
            k = np.minimum(np.searchsorted(common, low.hash), len(common) - 1)
            k = np.where(common[k] == low.hash, k, len(common))
            table = np.bincount(low.text * (len(common) + 1) + k, minlength=b.n * (len(common) + 1)).reshape(b.n, -1)
            word_d[own] = js_distance(table[own].astype(float), counts[None, :])
    class_d[classes.sum(1) < rules.min_chars] = 0
    word_d[low.count < rules.min_words_for_words] = 0
    return [w.count, word_chars, symbols, dup_lines, repeated, class_d, word_d]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    rules = Rules()
    out = measure(docs, references(docs, rules), rules)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"
    )
