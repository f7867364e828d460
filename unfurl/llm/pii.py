"""PII: pattern detection and information-theoretic sanitisation.

Patterns find protected entities (e-mail addresses, IPv4 addresses, card and
phone numbers). Then the corpus is asked how strongly the words of a text reveal
an entity in it: over all texts, a term's disclosure of an entity is their
pointwise mutual information divided by the entity's information content, 1
meaning that the term gives the entity away entirely. In texts that hold the
entity, terms at or over the threshold, seen together in enough different texts,
are generalised (capitalised words to [NAME], words with digits to [NUMBER]) or
removed wherever they stand. Words inside a match are not terms.

DataFrame operations only. Matches come from splitting a text by the pattern,
which gives the pieces between them and hence positions in code points. The
patterns are written so that no match backtracks or is retried within a run of
characters, so very long texts cost linear time. Texts are keyed by two 64-bit
hashes and equal texts count once. Null texts are empty; every row gets a row;
an empty table gives an empty result; input columns named like an output are
replaced, any other name is free.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._dist import hidden, shown, spill, temporary

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: What matches start with, or may follow directly after the match before.
PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # A whole run of digits with single separators, if it has 12 to 19 digits.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"[\p{L}\p{N}]{3,}+"
HIT = "array<struct<start:int,end:int,value:string>>"
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"
#: Items folded together, and characters of a text's pieces.
CHUNK, PIECE = 256, 1024


@dataclass(frozen=True)
class Disclosure:
    threshold: float = 0.9
    min_texts: int = 3
    min_entity_texts: int = 3


def bound(value: Column, body) -> Column:
    """body(value), with value worked out once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def folded(items: Column, first: Column, step, kind: str) -> Column:
    """Array of what step adds, item by item: step(at, item) gives the next at and
    an array of kind to append. Items are folded some hundred at a time and the
    results joined once, as appending to one long array takes quadratic time."""
    none = F.array().cast(kind)

    def chunks(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / CHUNK).cast("int")), lambda i: F.slice(x, i * CHUNK + 1, F.lit(CHUNK)))

    def one(acc: Column, x: Column) -> Column:
        at, out = step(acc["at"], x)
        return F.struct(at.alias("at"), F.concat(acc["out"], out).alias("out"))

    def chunk(acc: Column, some: Column) -> Column:
        before = F.struct(F.element_at(acc, -1)["at"].alias("at"), none.alias("out"))
        return F.concat(acc, F.array(F.aggregate(some, before, one)))

    zero = F.array(F.struct(first.alias("at"), none.alias("out")))
    whole = lambda x: F.flatten(F.transform(F.aggregate(chunks(x), zero, chunk), lambda c: c["out"]))
    return bound(items, lambda x: F.when(F.size(x) > 0, whole(x)).otherwise(none))


def located(text: Column, pattern: str, wanted: Column | None = None) -> Column:
    """HIT of every match; only of those whose term_hash is wanted, if given."""
    pieces, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(hits)).alias("piece"), hits.alias("hit"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = (at + F.length(x["piece"])).cast("int")
        end = (start + F.length(x["hit"])).cast("int")
        out = F.array(F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("value")))
        if wanted is not None:
            out = F.when(F.array_contains(wanted, term_hash(x["hit"])), out).otherwise(F.array().cast(HIT))
        return end, out

    return folded(both, F.lit(0), step, HIT)


def between(pieces: Column, lo: Column, hi: Column) -> Column:
    """Characters lo to hi of a text cut into pieces, as counting characters from
    the text's start each time is quadratic."""
    first, last = F.floor(lo / PIECE).cast("int"), F.floor((hi - 1) / PIECE).cast("int")
    some = F.concat_ws("", F.transform(F.sequence(first, F.greatest(first, last)), lambda i: F.get(pieces, i)))
    return F.when(hi > lo, F.substring(some, (lo - first * PIECE + 1).cast("int"), (hi - lo).cast("int"))).otherwise(F.lit(""))


def replaced(text: Column, gaps: Column) -> Column:
    """text with the places that gaps (start, end, value) name replaced by value;
    gaps come in order and do not overlap."""

    def whole(g: Column, pieces: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(g, i - 1)["end"]).otherwise(F.lit(0))
        parts = F.transform(g, lambda x, i: F.concat(between(pieces, before(i), x["start"]), x["value"]))
        return F.concat(F.concat_ws("", parts), between(pieces, before(F.size(g)), F.length(text)))

    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return bound(gaps, lambda g: F.when(F.size(g) > 0, bound(cut, lambda pieces: whole(g, pieces))).otherwise(text))


def term_hash(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def terms_of(text: Column) -> Column:
    """Hashes of a text's different terms."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), term_hash))


def luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def part(i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        double = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, double).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), part), F.lit(0), lambda a, x: a + x)
    return total % 10 == 0


def valid(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike(r"^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        return luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def keyed(df: DataFrame, text: str) -> DataFrame:
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return df.withColumns({"_k1": F.xxhash64(t), "_k2": F.xxhash64(F.lit(1), t)})


def detect(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(_k1, _k2, text, found) of every different text with a match, and the text
    of every other one: found holds SPAN's fields, rank being the order of kinds,
    valid matches only, by start and kind."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    texts = keyed(df, text).select("_k1", "_k2", t.alias("text")).dropDuplicates(["_k1", "_k2"])
    raw = spill(texts.select("*", *[located(F.col("text"), p).alias(k) for k, p in PATTERNS.items()]), "matches")
    any_hit = reduce(lambda a, b: a | b, [F.size(k) > 0 for k in KINDS])

    def part(rank: int, kind: str) -> Column:
        return F.transform(
            F.filter(F.col(kind), lambda h: valid(kind, h["value"])),
            lambda h: F.struct(
                h["start"].alias("start"), F.lit(rank).alias("rank"), h["end"].alias("end"), F.lit(kind).alias("kind"), h["value"].alias("value")
            ),
        )

    found = F.array_sort(F.concat(*[part(i, k) for i, k in enumerate(KINDS)])).cast(SPAN)
    return raw.where(any_hit).select("_k1", "_k2", "text", found.alias("found")), raw.where(~any_hit).select("text")


def masked(text: Column, spans: Column) -> Column:
    """text with blanks for all characters in spans (by start)."""

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        start, end = F.greatest(at, s["start"]), F.greatest(at, s["end"])
        return end, F.array(F.struct(start.alias("start"), end.alias("end"), F.repeat(F.lit(" "), end - start).alias("value")))

    return replaced(text, folded(spans, F.lit(0), step, HIT))


def disclosing_terms(bare: DataFrame, others: DataFrame, cfg: Disclosure) -> DataFrame:
    """(_k1, _k2, terms): HIT of every place of terms that disclose an entity of
    their text. bare: _k1, _k2, found and bare, the text without its matches;
    others: the texts without matches."""
    mention = bare.select("_k1", "_k2", F.explode("found").alias("m")).select("_k1", "_k2", F.xxhash64("m.kind", F.lower("m.value")).alias("entity")).distinct()
    mention = spill(mention, "mentions")
    every = bare.select("bare").union(others.select("text"))
    n = float(max(every.count(), 1))
    # As cet <= ce, no term in over ce * (n / ce) ** (1 - threshold) texts can
    # reach the threshold, so leaving those out beforehand loses no pair.
    often = mention.groupBy("entity").agg(F.count(F.lit(1)).alias("ce")).where((F.col("ce") >= max(cfg.min_entity_texts, cfg.min_texts)) & (F.col("ce") < n))
    most = F.col("ce") * F.pow(F.lit(n) / F.col("ce"), F.lit(1 - cfg.threshold)) * (1 + 1e-9)
    units = mention.join(often, "entity")
    units = spill(units.withColumn("most", most), "units")
    reach = units.groupBy("_k1", "_k2").agg(F.max("most").alias("reach"))
    term = every.select(F.explode(terms_of(F.col("bare"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("ct")).where(F.col("ct") >= cfg.min_texts)
    held = bare.join(reach, ["_k1", "_k2"]).select("_k1", "_k2", "reach", F.explode(terms_of(F.col("bare"))).alias("term"))
    held = held.join(term, "term").where(F.col("ct") <= F.col("reach")).drop("reach")
    pairs = spill(held.join(units, ["_k1", "_k2"]).where(F.col("ct") <= F.col("most")).select("_k1", "_k2", "entity", "term", "ce", "ct"), "pairs")
    joint = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("cet"), F.max("ce").alias("ce"), F.max("ct").alias("ct"))
    shared = F.log2(F.col("cet") * F.lit(n) / (F.col("ce") * F.col("ct")))
    strong = joint.where((F.col("cet") >= cfg.min_texts) & (shared >= cfg.threshold * F.log2(F.lit(n) / F.col("ce")))).select("entity", "term")
    wanted = pairs.join(strong, ["entity", "term"]).groupBy("_k1", "_k2").agg(F.collect_set("term").alias("wanted"))
    return bare.join(wanted, ["_k1", "_k2"]).select("_k1", "_k2", located(F.col("bare"), TERM, F.col("wanted")).alias("terms"))


def sanitise(df: DataFrame, text: str = "text", cfg: Disclosure = Disclosure()) -> DataFrame:
    """df with found (base matches), spans (base and disclosing terms) and the
    sanitised text."""
    df, names = hidden(df.drop("found", "spans", "sanitised"))
    text = f"in_{names.index(text)}"
    with temporary(df.sparkSession):
        found, others = detect(df, text)
        found = spill(found, "found")
        bare = spill(found.select("_k1", "_k2", "found", masked(F.col("text"), F.col("found")).alias("bare")), "bare")
        terms = spill(disclosing_terms(bare, others, cfg), "terms")
        added = F.transform(
            F.coalesce("terms", F.array().cast(HIT)),
            lambda h: F.struct(h["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), h["end"].alias("end"), F.lit("term").alias("kind"), h["value"].alias("value")),
        )
        every = found.select("_k1", "_k2", F.col("found").alias("_base")).join(terms, ["_k1", "_k2"], "left")
        every = spill(every.select("_k1", "_k2", "_base", F.array_sort(F.concat("_base", added.cast(SPAN))).alias("spans")), "spans", keep=True)
    rows = keyed(df, text).join(every, ["_k1", "_k2"], "left")
    none = F.array().cast(SPAN)
    rows = rows.withColumns({"found": F.coalesce("_base", none), "spans": F.coalesce("spans", none)})
    rows = rows.withColumn("sanitised", rewritten(F.coalesce(F.col(text), F.lit("")), F.col("spans")))
    return rows.select(*shown(names), "found", "spans", "sanitised")


def rewritten(text: Column, spans: Column) -> Column:
    """text with every span replaced; of overlapping spans the first holds."""
    word = lambda s: F.when(s["value"].rlike("[0-9]"), F.lit("[NUMBER]")).when(s["value"].rlike(r"^\p{Lu}"), F.lit("[NAME]")).otherwise(F.lit(""))
    label = lambda s: F.when(s["kind"] == "term", word(s)).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        own = F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"), label(s).alias("value")))
        return F.greatest(at, F.when(s["start"] >= at, s["end"]).otherwise(at)), F.when(s["start"] >= at, own).otherwise(F.array().cast(HIT))

    return replaced(text, folded(spans, F.lit(0), step, HIT))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = sanitise(docs)
    counts = [count_of(F.col("found"), k).alias(f"n_{k}") for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(listed(F.col("found")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
