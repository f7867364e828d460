"""Chat formatting by incremental black-box rendering.

A renderer is any function from a list of (role, text) turns to one string.
Successive prefixes are rendered and consecutive outputs compared: what a turn
appends is its span, and a renderer whose output for a longer prefix does not
start with its output for the shorter one rewrites history, which is reported.
Where a text lies inside its span is told by what stands around a sentinel in its
place: once in a turn alone and once in the whole conversation where both agree with
the span, else in the turn's own prefix. A sentinel occurs in no text. For a renderer that declares itself a concatenation of turns, window
compares windows of turns instead of all prefixes, so that conversations of very
many turns stay linear; the registered query renders every whole prefix.

Order inside a conversation: turn (null first), then role and text, so ties have
a defined order. Null texts and roles are empty. Repeated rows are kept. Other
columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]
CONTROL = re.compile(r"([\\#<])")
ROLE_CONTROL = re.compile(r"([\\#<:\n])")
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
TURN = re.compile(r"### ([^\\:#<\n]*(?:\\.[^\\:#<\n]*)*): ([^\\#<]*(?:\\.[^\\#<]*)*) </turn>\n", re.DOTALL)
FIXTURE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def escape(text: str) -> str:
    return CONTROL.sub(r"\\\1", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def template(turns: Turns) -> str:
    """`### role: text </turn>` per turn; backslash, # and < inside texts are
    escaped by a backslash, so no text can hold a control string."""
    return "".join(f"### {ROLE_CONTROL.sub(chr(92) * 2 + r'\1', r)}: {escape(t)} </turn>\n" for r, t in turns)


def parse(formatted: str) -> Turns:
    """The turns read back from template()'s output."""
    at, turns = 0, []
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def sentinel(turns: Turns) -> str:
    """A private-use character that occurs in no role or text; where all do, a longer
    run of the first than any of them holds."""
    used = {c for turn in turns for x in turn for c in x if c >= "\ue000"}
    free = next((c for c in map(chr, [*range(0xE000, 0xF900), *range(0xF0000, 0xFFFFE), *range(0x100000, 0x10FFFE)]) if c not in used), None)
    longest = max((len(m) for turn in turns for x in turn for m in re.findall("\ue000+", x)), default=0)
    return free or "\ue000" * (longest + 1)


def frames(turns: Turns, render: Callable[[Turns], str], mark: str) -> list[tuple[str, str]] | None:
    """What stands before and after each text, if turns alone and the whole
    conversation agree on it."""
    alone = {role: tuple(render([(role, mark)]).split(mark)) for role in {r for r, _ in turns}}
    if not turns or any(len(x) != 2 for x in alone.values()):
        return None
    around = [alone[role] for role, _ in turns]
    between = [around[0][0], *[a[1] + b[0] for a, b in zip(around, around[1:])], around[-1][1]]
    return around if render([(role, mark) for role, _ in turns]).split(mark) == between else None


def spans(turns: Turns, render: Callable[[Turns], str], window: int | None = None) -> tuple[str, list[tuple[int, int]], list[int]]:
    """(output, text span of each turn, turns at which history was rewritten).

    window: how many earlier turns are rendered with each turn; None renders
    every whole prefix. The output is always that of the whole conversation: where
    the pieces of a window do not add up to it, whole prefixes are rendered. Where
    history was rewritten, each text's span is sought in the whole output, and is
    empty if the text is not shown."""
    mark = sentinel(turns)
    around = frames(turns, render, mark)
    pieces, found, rewritten, done, after = [], [], [], 0, ""
    for i in range(len(turns)):
        lo = 0 if window is None else max(0, i - window)
        before = after if lo == 0 else render(turns[lo:i]) if i > lo else ""
        after = render(turns[lo : i + 1])
        if not after.startswith(before):
            rewritten.append(i)
            common = next((k for k, (a, b) in enumerate(zip(before, after)) if a != b), min(len(before), len(after)))
            before = before[:common]
        piece = after[len(before) :]
        start, tail = map(len, around[i]) if around else (0, 0)
        if around is None or not (piece.startswith(around[i][0]) and piece.endswith(around[i][1]) and len(piece) >= start + tail):
            probe = render(turns[lo:i] + [(turns[i][0], mark)])
            head = probe.rfind(mark)
            start, tail = head - len(before), len(probe) - head - len(mark)
        found.append((done + start, done + len(piece) - tail))
        pieces.append(piece)
        done += len(piece)
    whole = after if window is None else render(turns)
    if window is not None and (rewritten or "".join(pieces) != whole):
        return spans(turns, render)
    if rewritten:
        found = []
        for i, (role, _) in enumerate(turns):
            probe = render([*turns[:i], (role, mark), *turns[i + 1 :]])
            head = probe.rfind(mark)
            found.append((head, len(whole) - (len(probe) - head - len(mark))) if head >= 0 else (0, 0))
    return whole, found, rewritten


def format_conversation(turns: Turns, render=template, window: int | None = None, roles=("assistant",)) -> dict:
    """The formatted text, its loss mask as spans, and whether the renderer
    rewrites history."""
    text, found, rewritten = spans(turns, render, window)
    mask = [s for s, (role, _) in zip(found, turns) if role in roles]
    return {"formatted": text, "loss_spans": mask, "rewritten": rewritten}


def format_conversations(df: DataFrame, render=template, window: int | None = None, roles=("assistant",)) -> DataFrame:
    """df: conv_id, turn, role, text. One row per conversation: conv_id, n_turns,
    formatted, loss_spans, rewrites_history."""

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(role=pdf["role"].fillna(""), text=pdf["text"].fillna(""))
        pdf = pdf.sort_values(["turn", "role", "text"], na_position="first", kind="stable")
        out = format_conversation(list(zip(pdf["role"], pdf["text"])), render, window, roles)
        return pd.DataFrame(
            {
                "conv_id": [None if pd.isna(key[0]) else int(key[0])],
                "n_turns": [len(pdf)],
                "formatted": [out["formatted"]],
                "loss_spans": [[list(s) for s in out["loss_spans"]]],
                "rewrites_history": [bool(out["rewritten"])],
            }
        )

    return df.select("conv_id", "turn", "role", "text").groupBy("conv_id").applyInPandas(
        one, "conv_id long, n_turns long, formatted string, loss_spans array<array<long>>, rewrites_history boolean"
    )


def digests(formatted: pd.Series, loss: pd.Series) -> pd.DataFrame:
    """What the registered query returns, read back from formatted texts."""
    rows = []
    for text, found in zip(formatted, loss):
        turns = parse(text)
        learned = "".join(unescape(text[a:b]) for a, b in found)
        rows.append(
            (
                hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(),
                len(learned),
                hashlib.sha256(learned.encode()).hexdigest(),
                len(text),
            )
        )
    return pd.DataFrame(rows, columns=["turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(FIXTURE, "conv_id long, turn long, role string, text string")
    read = F.pandas_udf(digests, "turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    out = format_conversations(conv.unionByName(extra))
    return out.withColumn("d", read("formatted", "loss_spans")).select("conv_id", "n_turns", "d.*", "rewrites_history")
