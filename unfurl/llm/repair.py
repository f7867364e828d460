"""Conversation structure repair by lazy weighted determinisation.

Rows in order of turn (nulls first, ties by role, then text) are edited so that the
initials of their roles read (s?(ua)+)?. Every row is kept (0), gets another role
(1) or goes (2); a user or assistant row may be put in anywhere (5), and a
truncated row that stays costs 5 more. Blank and duplicate rows have to go. Of the
cheapest edits those with the ASCII-least string of initials (Delete, Insert, Keep,
Rerole) are taken.

A row is one of nine symbols (who speaks, and how faulty). What remains to be paid
from each state of the pattern, less the least of the four, is one state of the
determinised automaton; its transitions are computed when first met and kept in a
table. Scanning rows from the last to the first through the table gives the costs;
from the first row on, arcs that are tight (cost and rest add up to what was
promised) are then followed backwards through the scan, the least letter first.

Conversations are cut into fragments of bounded rows and bytes, wherever one
lies in the global order, so that a conversation with a third of all rows is worked
on by many tasks. A fragment is a (min, +) matrix to its neighbours: one pass over
matrices alone gives the costs at its end, one over the exits of its four entries
its entry. Only the hash of a repaired conversation, which SHA-256 defines as
sequential, is fed by one task, piece by piece.

Null roles and texts are one space (so blank). Other columns are ignored, whatever
their names. Repeated rows are duplicates. A null conv_id is a conversation of its
own; an empty table gives an empty result; texts of any length are whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._dist import shuffle_width, spill, temporary

#: Rows and text characters of a fragment; neither changes a result.
ROWS, CHARS = 4096, 1 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FAR = 1 << 50
#: States of the pattern: nothing yet, after s, after u, after a. Where a role leads.
STEPS = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
#: The role that a new or rewritten row takes in each state.
NEXT = ("u", "u", "a", "u")
ENDS = (0, FAR, FAR, 0)
NAMES = {"u": "user", "a": "assistant"}
#: Symbols: 0 has to go; 1 to 4 s, u, a and others, 5 to 8 the same, truncated.
GONE, OTHER = 0, "suao"
LEGAL = {"su", "ua", "au"}


def inserted(v: list[int]) -> tuple[int, ...]:
    """Costs by state once new rows may be put in first."""
    out = list(v)
    for _ in range(3):
        for q in range(4):
            out[q] = min(out[q], INSERT + out[STEPS[NEXT[q]][q]], FAR)
    return tuple(out)


def arcs(symbol: int, q: int) -> list[tuple[str, int, int]]:
    """(letter, cost, state) of what may be done to a row in state q, in ASCII order."""
    out = [("D", DELETE, q)]
    if symbol != GONE:
        more, to = TRUNCATED if symbol > 4 else 0, STEPS.get(OTHER[(symbol - 1) % 4], (None,) * 4)[q]
        if to is not None:
            out.append(("K", KEEP + more, to))
        out.append(("R", REROLE + more, STEPS[NEXT[q]][q]))
    return out


class Automaton:
    """The determinised automaton, as far as it has been met."""

    def __init__(self) -> None:
        self.number: dict[tuple[int, ...], int] = {}
        self.costs: list[tuple[int, ...]] = []
        self.table: list[list[tuple[int, int] | None]] = []

    def state(self, costs: tuple[int, ...]) -> tuple[int, int]:
        """(state, what was taken off) for the costs of the four states of the pattern."""
        least = min(costs)
        key = tuple(min(c - least, FAR) if c < FAR else FAR for c in costs)
        if key not in self.number:
            self.number[key] = len(self.costs)
            self.costs.append(key)
            self.table.append([None] * 9)
        return self.number[key], least

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        found = self.table[state][symbol]
        if found is None:
            after = self.costs[state]
            found = self.state(inserted([min(c + after[to] for _, c, to in arcs(symbol, q)) for q in range(4)]))
            self.table[state][symbol] = found
        return found

    def scan(self, symbols: bytes, end: tuple[int, ...]) -> tuple[list[int], tuple[int, ...]]:
        """(states from the last row's far side to the first row, costs before it)."""
        state, total = self.state(end)
        path, table = [state], self.table
        for x in reversed(symbols):
            found = table[state][x] or self.step(state, x)
            state = found[0]
            total += found[1]
            path.append(state)
        return path, tuple(min(c + total, FAR) if c < FAR else FAR for c in self.costs[state])

    def trace(self, symbols: bytes, path: list[int], q: int, last: bool) -> tuple[str, int]:
        """(letters, state after them) of the least cheapest edits from state q. New
        rows are put in before the row they precede; after the last one, last says."""
        out, costs, n = [], self.costs, len(symbols)
        for i, x in enumerate(symbols):
            here, after = costs[path[n - i]], costs[path[n - i - 1]]
            off = self.table[path[n - i - 1]][x][1]
            while True:
                rest = here[q] + off
                to = STEPS[NEXT[q]][q]
                if DELETE + after[q] == rest:
                    out.append("D")
                    break
                if INSERT + here[to] + off == rest:
                    out.append("I")
                    q = to
                    continue
                letter, q = next((a, to) for a, c, to in arcs(x, q)[1:] if c + after[to] == rest)
                out.append(letter)
                break
        while last and ENDS[q]:
            out.append("I")
            q = STEPS[NEXT[q]][q]
        return "".join(out), q


END = inserted(list(ENDS))
UNITS = [tuple(0 if p == q else FAR for q in range(4)) for p in range(4)]
AUTOMATON = Automaton()


def edited(letters: str, q: int, roles: list[str], texts: list[str]) -> list[str]:
    """role:text of what edits leave of a fragment's rows entered in state q."""
    out, i = [], 0
    for x in letters:
        if x == "D":
            i += 1
            continue
        role = roles[i][:1] if x == "K" else NEXT[q]
        out.append(f"{roles[i]}:{texts[i]}" if x == "K" else f"{NAMES[role]}:{'' if x == 'I' else texts[i]}")
        q = STEPS[role][q]
        i += x != "I"
    return out


FRAGMENT = "frag long, conv_id long, turns array<long>, roles array<string>, texts array<string>, heads array<string>, faults binary"
BLANK, CUT = 1, 2


def fragments(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, head (the role and text, hashed), blank, cut, there
    to FRAGMENTs, numbered in the order of conversations and rows. A row that is not
    there leaves at least an empty fragment of its conversation."""
    spark = rows.sparkSession
    # Equal rows may fill several ranges: where they lay before orders them.
    rows = rows.withColumn("at", F.monotonically_increasing_id())
    order = [F.col(c) for c in ("conv_id", "turn", "role", "text", "at")]
    placed = rows.repartitionByRange(shuffle_width(spark), *order).sortWithinPartitions(*order).drop("at")
    names, most_rows, most_chars = ["frag", "conv_id", "turns", "roles", "texts", "heads", "faults"], ROWS, CHARS
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.string())] * 3, pa.binary()]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        held: list[tuple] = []
        conv, size, begun = None, 0, False

        def flush() -> pa.RecordBatch:
            nonlocal held, size, number
            cols = list(zip(*held)) or [()] * 5
            row = [number, conv, *[list(c) for c in cols[:4]], bytes(cols[4])]
            number, held, size = number + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)

        for batch in batches:
            for c, turn, role, text, head, fault, there in zip(*[x.to_pylist() for x in batch.columns]):
                if begun and (c != conv or len(held) >= most_rows or size >= most_chars):
                    yield flush()
                conv, begun = c, True
                if there:
                    held.append((turn, role, text, head, fault))
                    size += len(text)
        if begun:
            yield flush()

    fault = (F.col("blank").cast("int") * BLANK + F.col("cut").cast("int") * CUT).alias("fault")
    return placed.select("conv_id", "turn", "role", "text", "head", fault, "there").mapInArrow(pack, FRAGMENT)


def first_seen(frags: DataFrame) -> DataFrame:
    """(frag, first): places of rows that are the first with their role and text in
    the conversation, blank ones not counted, by fragment."""
    place = F.posexplode("heads").alias("i", "head")
    rows = frags.select("frag", "conv_id", "faults", place).where("head is not null")
    first = rows.groupBy("conv_id", "head").agg(F.min(F.struct("frag", "i")).alias("m"))
    return first.groupBy("m.frag").agg(F.collect_list("m.i").alias("first"))


SUMMARY = (
    "frag long, conv_id long, symbols binary, matrix array<long>, blank long, duplicate long, truncated long, illegal long,"
    " head string, tail string, low long, high long, turns_seen long"
)


def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments with first (SUMMARY): symbols, the matrix of costs, counts, and what
    neighbours need."""
    names = [x.split()[0] for x in SUMMARY.split(", ")]
    for batch in batches:
        rows = []
        for frag, conv, turns, roles, faults, first in zip(*[x.to_pylist() for x in batch.columns]):
            fresh, symbols, counts = set(first or ()), bytearray(), [0, 0, 0]
            for i, fault in enumerate(faults):
                if fault & BLANK or i not in fresh:
                    counts[0 if fault & BLANK else 1] += 1
                    symbols.append(GONE)
                else:
                    counts[2] += fault == CUT
                    symbols.append(1 + ("sua".find(roles[i][0]) % 4 if roles[i] else 3) + (4 if fault == CUT else 0))
            symbols = bytes(symbols)
            initials = [r[:1] for r in roles]
            illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
            known = [t for t in turns if t is not None]
            columns = [AUTOMATON.scan(symbols, u)[1] for u in UNITS]
            matrix = [columns[p][q] for q in range(4) for p in range(4)]
            ends = (initials[0], initials[-1]) if initials else (None, None)
            span = (known[0], known[-1]) if known else (None, None)
            rows.append((frag, conv, symbols, matrix, *counts, illegal, *ends, *span, len(set(known))))
        yield _batch(rows, names, SUMMARY)


_KINDS = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "boolean": pa.bool_()}


def _batch(rows: list[tuple], names: list[str], schema: str) -> pa.RecordBatch:
    kinds = [_KINDS[x.split()[1]] for x in schema.split(", ")]
    cols = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names)


def chained(df: DataFrame, columns: list[str], step: Callable, schema: str, backwards: bool = False) -> DataFrame:
    """Fragments conversation by conversation, in order or backwards, one at a time
    through step(memory, row), whose memory is None at each conversation's first."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, conv, begun = None, None, False
        for batch in batches:
            rows = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                if not begun or row[1] != conv:
                    memory, conv, begun = None, row[1], True
                memory, out = step(memory, row)
                rows.append(out)
            yield _batch(rows, names, schema)

    n = shuffle_width(df.sparkSession)
    order = [F.desc("conv_id"), F.desc("frag")] if backwards else ["conv_id", "frag"]
    return df.select("frag", "conv_id", *columns).repartition(n, "conv_id").sortWithinPartitions(*order).mapInArrow(run, schema)


def _to_end(after: tuple | None, row: tuple) -> tuple:
    """(costs before the fragment), (frag, costs after it, whether it is the last)."""
    frag, _, matrix = row
    last, after = after is None, after or END
    before = inserted([min(min(matrix[4 * q + p] + after[p] for p in range(4)), FAR) for q in range(4)])
    return before, (frag, list(after), last, before[0])


def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which the least cheapest edits leave a fragment, by entry."""
    for batch in batches:
        rows = []
        for frag, conv, symbols, after, last in zip(*[c.to_pylist() for c in batch.columns]):
            path, _ = AUTOMATON.scan(symbols, tuple(after))
            rows.append((frag, conv, [AUTOMATON.trace(symbols, path, q, last)[1] for q in range(4)]))
        yield _batch(rows, ["frag", "conv_id", "exits"], "frag long, conv_id long, exits array<long>")


def _entries(state: int | None, row: tuple) -> tuple:
    frag, _, out = row
    q = 0 if state is None else state
    return out[q], (frag, q)


PIECE = "frag long, conv_id long, audit string, repaired string, kept boolean"


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Audit and repaired text of each fragment."""
    for batch in batches:
        rows = []
        for frag, conv, symbols, after, last, q, roles, texts in zip(*[c.to_pylist() for c in batch.columns]):
            path, _ = AUTOMATON.scan(symbols, tuple(after))
            letters, _ = AUTOMATON.trace(symbols, path, q, last)
            kept = edited(letters, q, roles, texts)
            rows.append((frag, conv, letters, "\n".join(kept), bool(kept)))
        yield _batch(rows, ["frag", "conv_id", "audit", "repaired", "kept"], PIECE)


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def joined(df: DataFrame) -> DataFrame:
    """One row per conversation from the pieces and summaries of its fragments, which
    come in order; nothing but the audit is held."""
    columns = ["audit", "repaired", "kept", "blank", "duplicate", "truncated", "illegal", "head", "tail", "low", "high", "turns_seen", "cost"]
    names = [x.split()[0] for x in RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, conv = False, None
        counts, audit, low, high, seen, tail, cost, digest, any_kept = [0] * 4, [], None, None, 0, None, 0, hashlib.sha256(), False

        def done() -> tuple:
            gaps = min(high - low + 1 - seen, (1 << 63) - 1) if low is not None else 0
            return (conv, gaps, *counts, cost, "".join(audit), digest.hexdigest())

        for batch in batches:
            rows = []
            for _, c, letters, text, kept, *n, first, final, lo, hi, turns, price in zip(*[x.to_pylist() for x in batch.columns]):
                if not begun or c != conv:
                    if begun:
                        rows.append(done())
                    begun, conv = True, c
                    counts, audit, low, high, seen, tail, cost, digest, any_kept = [0] * 4, [], None, None, 0, None, price, hashlib.sha256(), False
                counts = [x + y for x, y in zip(counts, n)]
                if first is not None:
                    counts[3] += tail is not None and tail + first not in LEGAL
                    tail = final
                if lo is not None:
                    seen += turns - (high == lo)
                    low, high = lo if low is None else low, hi
                audit.append(letters)
                if kept:
                    digest.update((("\n" if any_kept else "") + text).encode())
                    any_kept = True
            yield _batch(rows, names, RESULT)
        if begun:
            yield _batch([done()], names, RESULT)

    n = shuffle_width(df.sparkSession)
    return df.select("frag", "conv_id", *columns).repartition(n, "conv_id").sortWithinPartitions("conv_id", "frag").mapInArrow(run, RESULT)


SPACES = r"\x20\x09-\x0D"


def marked(rows: DataFrame, there: Column) -> DataFrame:
    """conv_id, turn, role, text with what repair() needs to know of each row."""
    none = F.coalesce("text", F.lit(" "))
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), none.alias("text"), there.alias("there"))
    blank = ~F.col("text").rlike(f"[^{SPACES}]")
    cut = ~F.col("text").rlike(rf"[.!?][{SPACES}]*\z")
    head = F.when(~blank, F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return rows.withColumns({"blank": blank, "cut": cut, "head": head})


def repair(rows: DataFrame, there: Column | None = None) -> DataFrame:
    """rows: conv_id, turn, role, text. One row per conversation: conv_id, gaps,
    blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Rows that are
    not there count for nothing but their conversation's being in the result."""
    spark = rows.sparkSession
    with temporary(spark):
        frags = spill(fragments(marked(rows, F.lit(True) if there is None else there)), "fragments")
        seen = first_seen(frags)
        # None of these joins has more than one row a key on either side.
        slim = frags.select("frag", "conv_id", "turns", "roles", "faults").join(seen, "frag", "left").select("frag", "conv_id", "turns", "roles", "faults", "first")
        known = spill(slim.mapInArrow(summary, SUMMARY), "summaries")
        ends = spill(chained(known, ["matrix"], _to_end, "frag long, after array<long>, last boolean, cost long", backwards=True), "ends")
        left = known.join(ends, "frag").select("frag", "conv_id", "symbols", "after", "last").mapInArrow(exits, "frag long, conv_id long, exits array<long>")
        entry = spill(chained(left, ["exits"], _entries, "frag long, entry long"), "entries")
        ready = known.join(ends, "frag").join(entry, "frag")
        whole = ready.select("frag", "symbols", "after", "last", "entry").join(frags.select("frag", "conv_id", "roles", "texts"), "frag")
        made = whole.select("frag", "conv_id", "symbols", "after", "last", "entry", "roles", "texts").mapInArrow(pieces, PIECE)
        return spill(joined(made.join(known.join(ends, "frag").drop("conv_id", "symbols", "matrix"), "frag")), "repaired", keep=True)


def damaged(conversations: DataFrame) -> tuple[DataFrame, Column]:
    """conversations with faults planted by the checksum of conv_id:turn, and
    whether a row is there."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text", kind.alias("kind"))
    said = F.coalesce("text", F.lit(" "))
    said = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace(said, "[.!?]", "")).otherwise(said)
    rows = rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), said.alias("text"),
        (F.col("kind") != 0).alias("there"), F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))),
    )
    return rows, F.col("there")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(*damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))
