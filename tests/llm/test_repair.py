"""Conversation repair against a plain search over edits."""

import hashlib
import os
import random
import re
import zlib

import pytest

from unfurl.llm import repair as R

DATA = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, audit string, frag int"
SOLID = re.compile(r"[^\x20\x09-\x0D]")


def damage(rows):
    """{conv_id: rows (turn, role, text) in order}"""
    out = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        out.setdefault(conv, [])
        if kind == 0:
            continue
        row = (turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        out[conv] += [row] * (2 if kind == 3 else 1)
    for conv in out:
        out[conv].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    return out


def plain(rows, insert=5):
    """The contract's columns for one conversation's rows, without conv_id."""
    seen, faults = set(), []
    for _, role, text in rows:
        solid = SOLID.findall(text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    names = {"u": "user", "a": "assistant"}
    best = {0: (0, "", ()), 3: (0, "", ())}

    def more(found):
        for _ in range(3):
            for (q, r), to in step.items():
                if r in names and to in found:
                    c, audit, text = found[to]
                    x = (c + insert, "I" + audit, (f"{names[r]}:",) + text)
                    found[q] = min(found.get(q, x), x, key=lambda v: v[:2])
        return found

    best = more(best)
    for (_, role, text), fault in zip(reversed(rows), reversed(faults)):
        now = {}
        for q in range(4):
            tries = [(2 + best[q][0], "D" + best[q][1], best[q][2])] if q in best else []
            pay = 5 if fault == "truncated" else 0
            if fault not in ("blank", "duplicate"):
                for r, letter, cost, name in ((role[:1], "K", 0, role), ("u", "R", 1, "user"), ("a", "R", 1, "assistant")):
                    to = step.get((q, r))
                    if to in best:
                        tries.append((cost + pay + best[to][0], letter + best[to][1], (f"{name}:{text}",) + best[to][2]))
            now[q] = min(tries, key=lambda v: v[:2])
        best = more(now)
    cost, audit, text = best[0]
    turns = [t for t, _, _ in rows if t is not None]
    initials = [r[:1] for _, r, _ in rows]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(text).encode()).hexdigest(),
    )


def repaired(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(parts)
    got = R.repair(*R.damaged(df)).collect()
    out = {r[0]: tuple(r)[1:] for r in got}
    assert len(out) == len(got)
    return out


def talk(rng, conv, n, roles=("system", "user", "assistant", "user", "assistant", "tool", "", None, "Ursula")):
    texts = ["Yes.", "No!", "Why?  ", "cut", "cut off. then", "", " \n\t", None, "é", "Yes. ", "x" * 50 + "."]
    return [(conv, rng.choice([None, *range(n + 2)]) if rng.random() < 0.3 else i, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"t{rng.randrange(99)}.") for i in range(n)]


@pytest.mark.parametrize("size", [(4096, 1 << 20), (3, 1 << 20), (1, 1 << 20), (4096, 60)])
def test_random(spark, monkeypatch, size):
    """Whatever the fragments' size: nulls, odd roles, ties, repeated rows."""
    monkeypatch.setattr(R, "ROWS", size[0])
    monkeypatch.setattr(R, "CHARS", size[1])
    rng = random.Random(sum(size))
    rows = [x for c in range(60) for x in talk(rng, c, rng.randrange(1, 14))]
    rows += talk(rng, None, 9) + talk(rng, 100, 300, ("user", "assistant")) + rows[:40]
    want = {c: plain(r) for c, r in damage(rows).items()}
    assert repaired(spark, rows) == want
    assert sum(w[5] for w in want.values()) > 100


def test_nothing_left(spark):
    assert repaired(spark, []) == {}
    dropped = [(c, t, "user", "Hi.") for c in range(40) for t in (0,) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert dropped and repaired(spark, dropped) == {c: empty for c, *_ in dropped}


def test_least_letters(spark):
    """Ties go to the ASCII-least audit, inserts before keeps."""
    whole = lambda rows: R.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert whole([(1, 0, "user", "Hi.")])["audit"] == "D"
    assert whole([(1, 0, "user", "A."), (1, 1, "assistant", "B."), (1, 2, "assistant", "C.")])["audit"] == plain([(0, "user", "A."), (1, "assistant", "B."), (2, "assistant", "C.")])[6]
    row = whole([(1, 0, "system", "S."), (1, 1, "user", "A."), (1, 2, "assistant", "B.")])
    assert (row["audit"], row["cost"], row["repaired_sha256"]) == ("KKK", 0, hashlib.sha256(b"system:S.\nuser:A.\nassistant:B.").hexdigest())


def test_inserts(monkeypatch):
    """With cheap inserts, which the contract's costs never choose."""
    monkeypatch.setattr(R, "INSERT", 1)
    end, rng, some = R.inserted(list(R.ENDS)), random.Random(4), 0
    a = R.Automaton()
    for _ in range(400):
        rows = [(i, rng.choice(["system", "user", "assistant", "tool"]), f"t{i}" + rng.choice([".", ".", ""])) for i in range(rng.randrange(8))]
        symbols = bytes(1 + min("sua".find(r[0]) % 4, 3) + (0 if t.endswith(".") else 4) for _, r, t in rows)
        path, costs = a.scan(symbols, end)
        letters, _ = a.trace(symbols, path, 0, True)
        want = plain(rows, 1)
        assert (R.inserted(list(costs))[0], letters) == want[5:7]
        assert hashlib.sha256("\n".join(R.edited(letters, 0, [r for _, r, _ in rows], [t for *_, t in rows])).encode()).hexdigest() == want[7]
        some += "I" in letters
    assert some > 100


def test_table_is_finite():
    """Every sequence of symbols stays within few states, which repeat."""
    a, rng = R.Automaton(), random.Random(1)
    for _ in range(300):
        a.scan(bytes(rng.randrange(9) for _ in range(60)), R.END)
    before = len(a.costs)
    a.scan(bytes(rng.randrange(9) for _ in range(20000)), R.END)
    assert before < 400 and len(a.costs) - before < 5


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in R.query(spark, DATA).collect()}
    assert got == {c: plain(r) for c, r in damage(rows).items()}
