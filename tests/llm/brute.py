"""Plain, slow versions of what the operators compute."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def words(text, low=False):
    return WORD.findall((text or "").translate(LOWER) if low else (text or ""))


def shingles(text):
    w = words(text, True)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(rows):
    """rows: (id, text). Component of each row's place, as the smallest id."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    return [min(least[find(i)], default=None) for i in range(len(rows))], [len(s) for s in sets]


def repeats(rows, length=100):
    """rows: (id, text), by id and text; equal rows once. {(id, text): (bytes, removed, spans, sha)}"""
    seen, out = set(), {}
    for d, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            w = b[s : s + length]
            if w in seen:
                gone[s : s + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d, t] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def quality(text):
    w, seen, dup, hit = words(text), set(), 0, set()
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = Counter(runs)
    for i, r in enumerate(runs):
        if count[r] > 1:
            hit.update(range(i, i + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def contamination(text, items, width=10):
    w, hit, found = TERM.findall((text or "").translate(LOWER)), set(), set()
    for item, t in items:
        v = TERM.findall((t or "").translate(LOWER))
        n = min(width, len(v))
        for k in range(len(v) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[k : k + n]:
                    hit.update(range(i, i + n))
                    found.add(item)
    return len(w), len(hit), sorted(map(str, found))


def word_scores(rows):
    tokens = [words(t, True) + [None] for _, t in rows]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 10 == 0 for d, _ in rows]
    count = Counter(x for t, h in zip(tokens, held) if not h for x in t)
    n, v = sum(count.values()), len(count)
    return [
        (h, len(t), sum(count[x] > 0 for x in t), n, sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)) for t, h in zip(tokens, held)
    ]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def pii(text):
    t, d, out = text or "", lambda m: re.sub("[^0-9]", "", m[0]), []
    out += [(m.start(), 0, m.end(), "email") for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end(), "ip") for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end(), "card") for m in CARD.finditer(t) if 12 <= len(d(m)) <= 19 and luhn(d(m))]
    out += [(m.start(), 3, m.end(), "phone") for m in PHONE.finditer(t) if 9 <= len(d(m)) <= 15]
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(out))


def targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """sizes: [(source, size)] in order. Targets by resharing step by step."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    left, out, open_ = share * sum(s for _, s in sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        total = sum(w[i] for i in open_)
        over = [i for i in open_ if left * w[i] / total > cap * sizes[i][1]]
        if not over:
            for i in open_:
                out[i] = left * w[i] / total
            break
        for i in over:
            out[i] = cap * sizes[i][1]
        left -= sum(out[i] for i in over)
        open_ -= set(over)
    return out
