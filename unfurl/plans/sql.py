"""DuckDB SQL for the registered queries, written from the operators' definitions."""

from __future__ import annotations

from .tables import SMOOTH

PI, TP = "3.141592653589793e0", "6.283185307179586e0"


def r6(x: str) -> str:
    return f"(round_even(CAST({x} AS DOUBLE) * 1e6, 0) / 1e6 + 0e0)"


def once(x: str) -> str:
    return f"(CASE WHEN ({x}) < -{PI} THEN ({x}) + {TP} WHEN ({x}) > {PI} THEN ({x}) - {TP} ELSE ({x}) END)"


def full(x: str) -> str:
    return f"(({x}) - {TP} * round_even(({x}) / {TP}, 0))"


def to_ref(new: str, old: str) -> str:
    return f"(({new}) - {TP} * round_even((({new}) - ({old})) / {TP}, 0))"


def quantise(w: str) -> str:
    return f"CAST(CASE WHEN ({w}) >= 0 AND ({w}) <= 1 THEN greatest(round_even((1e0 - ({w})) * 255e0, 0), 1e0) ELSE 0e0 END AS SMALLINT)"


#: Voxels of the vectors: image_id, echo, idx, phase, mag, mask.
VOX = f"""vox AS (
  SELECT e.vec_id AS image_id, CAST(1 AS BIGINT) AS echo, u.i AS idx, {full("12 * CAST(e.embedding[u.i + 1] AS DOUBLE)")} AS phase,
    abs(CAST(coalesce(n.embedding, e.embedding)[u.i + 1] AS DOUBLE)) + 0.01e0 AS mag, (u.i * 7 + e.vec_id) % 5 <> 0 AS mask
  FROM embeddings e LEFT JOIN embeddings n ON n.vec_id = e.vec_id + 1, (SELECT unnest(range(64)) AS i) u)"""

#: Three vectors at a time as echoes: image_id, echo, idx, phase, mag, te.
ECHOES = """full_images AS (SELECT vec_id // 3 AS image FROM embeddings GROUP BY 1 HAVING count(*) = 3),
ech AS (SELECT image_id // 3 AS image_id, image_id % 3 + 1 AS echo, idx, phase, mag, CAST(image_id % 3 + 1 AS DOUBLE) AS te
  FROM vox WHERE image_id // 3 IN (SELECT image FROM full_images))"""

#: Template echo 1 with echo 2 as second phase.
PAIR = "pair AS (SELECT a.image_id, a.idx, a.phase, a.mag, b.phase AS phase2 FROM ech a JOIN ech b ON a.image_id = b.image_id AND a.idx = b.idx AND a.echo = 1 AND b.echo = 2)"

STRIDES = (1, 4, 16)
LAST = ("idx % 4 = 3", "(idx // 4) % 4 = 3", "idx // 16 = 3")


def _line(a: str, b: str, c: str) -> str:
    return f"greatest(0e0, 1e0 - abs({full(f'{a} - 2 * {b} + {c}')} / 2))"


def _product(d: int, flags, ratio: str = "(1e0 / 2e0)") -> str:
    """Quality of the edge along dimension d from the taps of that dimension."""
    step = once(f"phase - p{d}")
    small, big = f"least(m, m{d})", f"greatest(m, m{d})"
    measures = [
        f"(1e0 - abs({step} / {PI}))",
        f"greatest(0e0, 1e0 - abs({step} - {once(f'phase2 - s{d}')} * {ratio}))",
        f"(CASE WHEN h{d} IS NULL OR k{d} IS NULL THEN 0.9e0 ELSE {_line(f'h{d}', 'phase', f'p{d}')} * {_line('phase', f'p{d}', f'k{d}')} END)",
        f"(({small} / {big}) * ({small} / {big}))",
        f"(0.5e0 + 0.5e0 * least(1e0, {small} / (0.5e0 * maxmag)))",
        f"(0.5e0 + 0.5e0 * least(1e0, (0.5e0 * maxmag) / {big}))",
    ]
    out = "1e0"
    for on, q in zip(flags, measures):
        if on:
            out = f"({out} * (0.1e0 + 0.9e0 * {q}))"
    return out


def edge_ctes(flags, mag: bool = False, phase2: bool = False, mask: bool = False, half: bool = False) -> str:
    """CTEs ending in `qual`: image_id, idx, phase, q1, q2, q3 (null where there
    is no edge)."""
    src = "pair" if phase2 else "vox"
    head = f"{VOX}, {ECHOES}, {PAIR}" if phase2 else VOX
    m = ("CASE WHEN mask THEN mag ELSE 0e0 END" if mask else "mag") if mag else "0e0"
    keep = "mask" if mask else "true"
    second = ("phase2 / 2e0 AS phase2" if half else "phase2") if phase2 else "0e0 AS phase2"
    first, ratio = ("phase / 2e0 AS phase", "1e0") if half else ("phase", "(1e0 / 2e0)")
    taps = []
    for d, s in enumerate(STRIDES, 1):
        taps += [f"lead(phase, {s}) OVER w AS p{d}", f"lag(phase, {s}) OVER w AS h{d}", f"lead(phase, {2 * s}) OVER w AS k{d}",
                 f"lead(phase2, {s}) OVER w AS s{d}", f"lead(m, {s}) OVER w AS m{d}"]
    qs = [
        f"CASE WHEN {LAST[d - 1]} OR p{d} IS NULL OR NOT inside THEN NULL ELSE {_product(d, flags, ratio)} END AS q{d}" for d in (1, 2, 3)
    ]
    return f"""{head},
src AS (SELECT image_id, idx, {first}, {second}, {m} AS m, {keep} AS inside FROM {src}),
top AS (SELECT image_id, quantile_cont(m, 0.95) AS maxmag FROM src GROUP BY image_id),
taps AS (SELECT *, {", ".join(taps)} FROM src WINDOW w AS (PARTITION BY image_id ORDER BY idx)),
qual AS (SELECT image_id, idx, phase, {", ".join(qs)} FROM taps JOIN top USING (image_id))"""


def weight_ctes(flags, mag: bool = False, phase2: bool = False, mask: bool = False) -> str:
    ws = [f"CASE WHEN q{d} IS NULL THEN 0 ELSE CAST({quantise(f'q{d}')} AS BIGINT) END AS w{d}" for d in (1, 2, 3)]
    return f"{edge_ctes(flags, mag, phase2, mask)}, wts AS (SELECT image_id, idx, phase, {', '.join(ws)} FROM qual)"


DEFAULT = [True, False, True, True, False, False]  # the default preset with magnitude and one echo


def qualities(flags, mag: bool, phase2: bool) -> str:
    return f"WITH {edge_ctes(flags, mag, phase2)} SELECT image_id, idx, {', '.join(f'{r6(f"coalesce(q{d}, 0e0)")} AS q{d}' for d in (1, 2, 3))} FROM qual"


def weights(flags, mag: bool, phase2: bool, mask: bool) -> str:
    return f"WITH {weight_ctes(flags, mag, phase2, mask)} SELECT image_id, idx, w1, w2, w3 FROM wts"


EDGES = f"""WITH {VOX}, n AS (SELECT image_id, idx, phase, {", ".join(f"lead(phase, {s}) OVER w AS p{d}" for d, s in enumerate(STRIDES))}
  FROM vox WINDOW w AS (PARTITION BY image_id ORDER BY idx))
""" + " UNION ALL ".join(
    f"SELECT image_id, idx, CAST({d} AS BIGINT) AS dim, {r6(f'phase - p{d}')} AS step FROM n WHERE NOT ({LAST[d]})" for d in range(3)
)

USER_WEIGHTS = f"WITH {VOX} SELECT image_id, idx, " + ", ".join(
    f"CASE WHEN {LAST[d]} THEN 0 ELSE (idx * 3 + {d}) % 256 END AS w{d + 1}" for d in range(3)
) + " FROM vox"


def _second() -> str:
    offsets = sorted({abs(i + 4 * j + 16 * k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)} - {0})
    taps = ", ".join(f"lag(phase, {n}) OVER w AS a{n}, lead(phase, {n}) OVER w AS b{n}" for n in offsets)
    terms = " + ".join(
        f"coalesce(({once(f'a{n} - phase')} - {once(f'phase - b{n}')}) * ({once(f'a{n} - phase')} - {once(f'phase - b{n}')}), 0e0)" for n in offsets
    )
    return f"{VOX}, taps AS (SELECT image_id, idx, phase, {taps} FROM vox WINDOW w AS (PARTITION BY image_id ORDER BY idx)), dd AS (SELECT image_id, idx, sqrt(0e0 + {terms}) AS d FROM taps)"


def second_difference() -> str:
    return f"WITH {_second()} SELECT image_id, idx, {r6('d')} AS d FROM dd"


def bestpath() -> str:
    win = "WINDOW w AS (PARTITION BY image_id ORDER BY idx)"
    sums = ", ".join(f"r + lead(r, {s}) OVER w AS s{d}" for d, s in enumerate(STRIDES, 1))
    out = ", ".join(
        f"CASE WHEN {LAST[d - 1]} THEN 0 ELSE CAST(greatest(least(round_even((1e0 - coalesce(lag(s{d}) OVER w, 0e0) / 10e0) * 255e0, 0), 255e0), 1e0) AS BIGINT) END AS w{d}"
        for d in (1, 2, 3)
    )
    return f"WITH {_second()}, rr AS (SELECT image_id, idx, 1e0 / d AS r FROM dd), ss AS (SELECT image_id, idx, {sums} FROM rr {win}) SELECT image_id, idx, {out} FROM ss {win}"


def seed_order() -> str:
    total = " + ".join(f"(CASE WHEN w{d} = 0 THEN 255 ELSE w{d} END)" for d in (1, 2, 3))
    return f"""WITH {weight_ctes(DEFAULT, mag=True)}, t AS (SELECT image_id, idx, {total} AS seed_sum FROM wts)
SELECT image_id, idx, CAST(seed_sum AS BIGINT) AS seed_sum, row_number() OVER (PARTITION BY image_id ORDER BY seed_sum, idx DESC) AS rank FROM t"""


SEED_CORRECTION = f"""WITH {VOX}, {ECHOES}, {PAIR},
o AS (SELECT a, b, (a + 2) * 3 + b + 1 AS i FROM (SELECT unnest(range(-2, 3)) AS a), (SELECT unnest(range(-1, 2)) AS b)),
c AS (SELECT image_id, idx, a, i, abs((phase + {TP} * a) / 1e0 - (phase2 + {TP} * b) / 2e0) + (abs(a) + abs(b)) / 100e0 AS cost FROM pair, o),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id, idx ORDER BY cost, i) AS n FROM c)
SELECT image_id, idx, a AS off1 FROM r WHERE n = 1"""


def unwrap_1d(events: bool = False, region: bool = True) -> str:
    """In one dimension with all edges valid the tree is the chain: wraps are a
    running sum, fixed at the seed, the least weight with the largest index."""
    src = (
        f"""src AS (SELECT image_id, idx, phase FROM (SELECT user_id AS image_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
  {full("value")} AS phase, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE n > 1)"""
        if events
        else f"{VOX}, src AS (SELECT image_id, idx, phase FROM vox)"
    )
    step = once("phase - b")
    line = f"(CASE WHEN a IS NULL OR c IS NULL THEN 0.9e0 ELSE {_line('a', 'phase', 'b')} * {_line('phase', 'b', 'c')} END)"
    quality = f"((1e0 * (0.1e0 + 0.9e0 * (1e0 - abs({step} / {PI})))) * (0.1e0 + 0.9e0 * {line}))"
    return f"""WITH {src},
taps AS (SELECT image_id, idx, phase, lag(phase) OVER w AS a, lead(phase) OVER w AS b, lead(phase, 2) OVER w AS c FROM src WINDOW w AS (PARTITION BY image_id ORDER BY idx)),
wt AS (SELECT image_id, idx, phase, CASE WHEN b IS NULL THEN 255 ELSE {quantise(quality)} END AS w, coalesce(round_even((phase - a) / {TP}, 0), 0e0) AS k FROM taps),
chain AS (SELECT *, sum(k) OVER (PARTITION BY image_id ORDER BY idx) AS total FROM wt),
seed AS (SELECT image_id, total AS base, row_number() OVER (PARTITION BY image_id ORDER BY w, idx DESC) AS n FROM chain)
SELECT image_id, idx, {r6(f"phase - {TP} * (total - base)")} AS unwrapped{", CAST(1 AS BIGINT) AS region" if region else ""} FROM chain JOIN seed USING (image_id) WHERE n = 1"""


def field(nx: int, ny: int | None) -> str:
    x = f"CAST(i % {nx} AS DOUBLE)"
    if ny is None:
        truth = f"0.02e0 * {x} * {x} + 0.9e0 * {x} - 1.3e0 * (i // {nx})"
    else:
        truth = f"0.1e0 * {x} * {x} - 2e0 * ((i // {nx}) % {ny}) + 2e0 * (i // {nx * ny})"
    return f"SELECT i AS idx, {r6(truth)} AS value FROM (SELECT p_partkey AS i FROM part)"


def _smooth(shape, scale: str) -> str:
    gx, gy, gz, share = (f"{g}e0" for g in SMOOTH)
    x, y, z = f"(i % {shape.nx})", f"((i // {shape.nx}) % {shape.ny})", f"(i // {shape.nx * shape.ny})"
    return f"SELECT vec_id AS image_id, i AS idx, {scale} * ({gx} * {x} + {gy} * {y} + {gz} * {z} + {share} * CAST(embedding[i + 1] AS DOUBLE)) AS t FROM embeddings, (SELECT unnest(range(64)) AS i)"


def rise(shape, echoes: bool = False) -> str:
    """The smooth field relative to an image's first voxel."""
    value = r6("te * (t - first_value(t) OVER w)") if echoes else r6("t - first_value(t) OVER w")
    more, source = ("CAST(te AS BIGINT) AS echo, ", ", (SELECT unnest([1e0, 2e0, 3e0]) AS te)") if echoes else ("", "")
    window = "PARTITION BY image_id, te ORDER BY idx" if echoes else "PARTITION BY image_id ORDER BY idx"
    return f"SELECT image_id, {more}idx, {value} AS rise FROM ({_smooth(shape, '1e0' if echoes else '3e0')}){source} WINDOW w AS ({window})"


def regions_multi_seed() -> str:
    return "SELECT vec_id AS image_id, CAST(len(embedding) AS BIGINT) AS reached, CAST(len(embedding) AS BIGINT) AS as_field, 0e0 AS residue FROM embeddings"


def line_wrap_addition() -> str:
    """From the seed to the end, then back to the start, each voxel against the last
    one plus the last step, limited to 1."""
    return f"""WITH RECURSIVE {VOX}, l AS (SELECT image_id, list(phase ORDER BY idx) AS p FROM vox GROUP BY 1),
r AS (
  SELECT image_id, p, 62 AS idx, {full("p[63]")} AS u, {to_ref("p[64]", full("p[63]"))} AS was FROM l
  UNION ALL
  SELECT image_id, p, idx - 1, {to_ref("p[idx]", "(u + greatest(-1e0, least(1e0, u - was)))")}, u FROM r WHERE idx > 0)
SELECT image_id, CAST(idx AS BIGINT) AS idx, {r6("u")} AS unwrapped FROM r UNION ALL SELECT image_id, 63, {r6("was")} FROM r WHERE idx = 62"""


def line_single() -> str:
    """Each step in double precision, kept in single."""
    step = lambda x: f"CAST({to_ref(f'CAST({x} AS DOUBLE)', 'CAST(u AS DOUBLE)')} AS FLOAT)"
    seed = f"CAST({full('CAST(p[63] AS DOUBLE)')} AS FLOAT)"
    return f"""WITH RECURSIVE {VOX}, l AS (SELECT image_id, list(CAST(phase AS FLOAT) ORDER BY idx) AS p FROM vox GROUP BY 1),
s AS (SELECT image_id, p, {seed} AS u FROM l),
r AS (SELECT image_id, p, 62 AS idx, u FROM s UNION ALL SELECT image_id, p, idx - 1, {step("p[idx]")} FROM r WHERE idx > 0)
SELECT image_id, CAST(idx AS BIGINT) AS idx, CAST(u AS DOUBLE) AS unwrapped FROM r UNION ALL SELECT image_id, 63, CAST({step("p[64]")} AS DOUBLE) FROM s"""


def line_seeds(merged: bool = False, one: bool = False) -> str:
    """Eight voxels a region, seeded from the end on; inside, wraps are a running sum.
    Merging takes regions in pairs, as each pass settles a root and its neighbour."""
    block, seed = ("0", "62") if one else ("idx // 8", "8 * (idx // 8) + 6")
    u = f"""WITH {VOX}, c AS (SELECT image_id, idx, phase, {block} AS b, {seed} AS seed,
  coalesce(round_even((phase - lag(phase) OVER (PARTITION BY image_id, {block} ORDER BY idx)) / {TP}, 0), 0e0) AS k FROM vox),
t AS (SELECT *, sum(k) OVER (PARTITION BY image_id, b ORDER BY idx) AS total FROM c),
s AS (SELECT image_id, b, total AS base, phase - {full("phase")} AS off FROM t WHERE idx = seed),
u AS (SELECT image_id, idx, b, phase - off - {TP} * (total - base) AS u, {"1" if one else "8 - b"} AS region FROM t JOIN s USING (image_id, b))"""
    if not merged:
        return f"{u} SELECT image_id, CAST(region AS BIGINT) AS region, idx, {r6('u')} AS unwrapped FROM u"
    return f"""{u}, m AS (SELECT lo.image_id, lo.region, round_even((hi.u - lo.u) / {TP}, 0) AS k FROM u lo JOIN u hi ON hi.image_id = lo.image_id AND hi.idx = lo.idx + 1
  WHERE lo.idx % 8 = 7 AND lo.region % 2 = 0)
SELECT image_id, CAST(region - CASE WHEN coalesce(k, 0) <> 0 THEN 1 ELSE 0 END AS BIGINT) AS region, idx, {r6(f"u + {TP} * coalesce(k, 0)")} AS unwrapped FROM u LEFT JOIN m USING (image_id, region)"""


def _seed_wraps(value: str, other: str, te1: str, te2: str) -> str:
    """The wraps of a seed that fit the other echo best; the first on ties."""
    cost = f"abs(({value} + {TP} * (j // 3 - 2)) / {te1} - ({other} + {TP} * (j % 3 - 1)) / {te2}) + (abs(j // 3 - 2) + abs(j % 3 - 1)) / 100e0"
    return f"(list_min(list_transform(range(15), lambda j: {{'c': {cost}, 'j': j}})).j // 3 - 2)"


def _spatial_line() -> str:
    """Each echo's phase less its wraps from the seed (idx 62) on: x1, x2, x3."""
    steps = ", ".join(f"coalesce(round_even((e{e} - lag(e{e}) OVER v) / {TP}, 0), 0e0) AS k{e}" for e in (1, 2, 3))
    sums = ", ".join(f"sum(k{e}) OVER v AS t{e}" for e in (1, 2, 3))
    rest = ", ".join(f"e{e} - {TP} * (t{e} - z{e}) AS x{e}, s{e}" for e in (1, 2, 3))
    ends = ", ".join(f"max(t{e}) FILTER (idx = 62) AS z{e}, max(e{e}) FILTER (idx = 62) AS s{e}" for e in (1, 2, 3))
    return f"""{WIDE}, k AS (SELECT *, {steps} FROM w WINDOW v AS (PARTITION BY image_id ORDER BY idx)),
sums AS (SELECT *, {sums} FROM k WINDOW v AS (PARTITION BY image_id ORDER BY idx)), z AS (SELECT image_id, {ends} FROM sums GROUP BY 1),
x AS (SELECT image_id, idx, e1, e2, e3, {rest} FROM sums JOIN z USING (image_id))"""


def _by_echo(columns: dict[int, str], source: str) -> str:
    return " UNION ALL ".join(f"SELECT image_id, CAST({e} AS BIGINT) AS echo, idx, {r6(c)} AS unwrapped FROM {source}" for e, c in columns.items())


def line_echoes(kind: str) -> str:
    a1, a2 = _seed_wraps("s1", "s2", "1e0", "2e0"), _seed_wraps("s2", "s1", "2e0", "1e0")
    if kind == "template 1":
        steps = f", a AS (SELECT *, x1 + {TP} * {a1} AS u1 FROM x), b AS (SELECT *, {to_ref('e2', 'u1 * 2e0')} AS u2 FROM a), c AS (SELECT *, {to_ref('e3', 'u2 * (3e0 / 2e0)')} AS u3 FROM b)"
    elif kind == "template 2":
        steps = f", a AS (SELECT *, x2 + {TP} * {a2} AS u2 FROM x), c AS (SELECT *, {to_ref('e1', 'u2 * (1e0 / 2e0)')} AS u1, {to_ref('e3', 'u2 * (3e0 / 2e0)')} AS u3 FROM a)"
    else:
        after = lambda e, f: _seed_wraps(f"s{e}", f"(s{f} + {TP} * a{f})", f"{e}e0", f"{f}e0")
        steps = f", a AS (SELECT *, {a1} AS a1 FROM x), b AS (SELECT *, {after(2, 1)} AS a2 FROM a), d AS (SELECT *, {after(3, 2)} AS a3 FROM b)"
        steps += f", c AS (SELECT *, {', '.join(f'x{e} + {TP} * a{e} AS u{e}' for e in (1, 2, 3))} FROM d)"
    return f"{_spatial_line()}{steps} {_by_echo({e: f'u{e}' for e in (1, 2, 3)}, 'c')}"


def line_refined() -> str:
    """Template 1; in each other echo, voxels whose quality against the reference is
    not over 0.06 are unwrapped anew from their neighbours: runs of them from the
    right, a run at the end from the left, and none if all are like that."""

    def refined(e: int, source: str, ref: str, name: str) -> str:
        u = to_ref(f"e{e}", ref)
        step, ref_step = once("p - pn"), once("r - rn")
        line = f"(CASE WHEN pb IS NULL OR pa IS NULL THEN 0.9e0 ELSE {_line('pb', 'p', 'pn')} * {_line('p', 'pn', 'pa')} END)"
        q = f"(0.1e0 + 0.9e0 * (1e0 - abs({step} / {PI}))) * (0.1e0 + 0.9e0 * greatest(0e0, 1e0 - abs({step} - {ref_step} * 1e0))) * (0.1e0 + 0.9e0 * {line})"
        return f""", {name}a AS (SELECT *, {u} AS t FROM (SELECT *, {ref} AS ref FROM {source})),
{name}b AS (SELECT *, t / 2 AS p, ref / 2 AS r, lead(t / 2) OVER v AS pn, lead(ref / 2) OVER v AS rn, lag(t / 2) OVER v AS pb, lead(t / 2, 2) OVER v AS pa FROM {name}a WINDOW v AS (PARTITION BY image_id ORDER BY idx)),
{name}c AS (SELECT *, CASE WHEN pn IS NULL THEN 0e0 ELSE {q} END AS q FROM {name}b),
{name}d AS (SELECT *, CAST((q + coalesce(lag(q) OVER v, 0e0)) / 6 AS FLOAT) > 0.06e0 AS good FROM {name}c WINDOW v AS (PARTITION BY image_id ORDER BY idx)),
{name}e AS (SELECT image_id, list(t ORDER BY idx) AS ts, list(good OR none ORDER BY idx) AS gs, coalesce(max(idx) FILTER (good), 63) AS lg FROM
  (SELECT *, NOT bool_or(good) OVER (PARTITION BY image_id) AS none FROM {name}d) GROUP BY 1),
{name}f AS (
  SELECT image_id, ts, gs, lg, lg AS i, ts[lg + 1] AS u, [ts[lg + 1]] AS done FROM {name}e
  UNION ALL
  SELECT image_id, ts, gs, lg, i - 1, v, list_prepend(v, done) FROM (SELECT *, CASE WHEN gs[i] THEN ts[i] ELSE {to_ref('ts[i]', 'u')} END AS v FROM {name}f WHERE i > 0)),
{name}g AS (
  SELECT image_id, ts, lg AS i, ts[lg + 1] AS u, done FROM {name}f WHERE i = 0
  UNION ALL
  SELECT image_id, ts, i + 1, v, list_append(done, v) FROM (SELECT *, {to_ref('ts[i + 2]', 'u')} AS v FROM {name}g WHERE i < 63)),
{name} AS (SELECT s.*, f.done[s.idx + 1] AS u{e} FROM {source} s JOIN {name}g f ON f.image_id = s.image_id AND f.i = 63)"""

    start = _spatial_line().replace("WITH ", "WITH RECURSIVE ", 1)
    a1 = _seed_wraps("s1", "s2", "1e0", "2e0")
    return f"{start}, a AS (SELECT *, x1 + {TP} * {a1} AS u1 FROM x){refined(2, 'a', 'u1 * 2e0', 'g')}{refined(3, 'g', 'u2 * (3e0 / 2e0)', 'h')} {_by_echo({e: f'u{e}' for e in (1, 2, 3)}, 'h')}"


LABEL = "(idx % 4) // 2 + 1 + 2 * (idx // 32)"


def region_sizes() -> str:
    return f"WITH {VOX} SELECT image_id, {LABEL} AS region, count(*) AS size FROM vox GROUP BY 1, 2"


def region_offsets() -> str:
    taps = ", ".join(f"lead(phase, {s}) OVER w AS p{d}, lead(reg, {s}) OVER w AS r{d}" for d, s in enumerate(STRIDES, 1))
    parts = " UNION ALL ".join(
        f"SELECT image_id, reg AS ri, r{d} AS rj, (phase - p{d}) * wd AS o, wd AS w FROM (SELECT *, CASE WHEN w{d} = 0 THEN 0 ELSE 255 - w{d} END AS wd FROM t) WHERE NOT ({LAST[d - 1]}) AND reg <> r{d}"
        for d in (1, 2, 3)
    )
    return f"""WITH {weight_ctes(DEFAULT, mag=True)}, lab AS (SELECT *, {LABEL} AS reg FROM wts),
t AS (SELECT *, {taps} FROM lab WINDOW w AS (PARTITION BY image_id ORDER BY idx)), e AS ({parts}),
both_ways AS (SELECT * FROM e UNION ALL SELECT image_id, rj, ri, -o, w FROM e)
SELECT image_id, ri, rj, {r6("sum(o)")} AS offset_sum, CAST(sum(w) AS BIGINT) AS weight_sum FROM both_ways GROUP BY 1, 2, 3"""


UNEVEN = "1 + CAST(idx % 4 >= 1 AS INTEGER) + 2 * CAST((idx // 4) % 4 >= 2 AS INTEGER) + 4 * CAST(idx // 16 >= 3 AS INTEGER)"


def merge_table(voxels: bool = False) -> str:
    """Two recursions: one settles regions root by root and lists the pairs in the
    order they are met, the other applies them to labels and wraps."""
    taps = ", ".join(f"lead(u, {s}) OVER w AS u{d}, lead(reg, {s}) OVER w AS r{d}" for d, s in enumerate(STRIDES, 1))
    parts = " UNION ALL ".join(
        f"SELECT image_id, reg AS ri, r{d} AS rj, (u - u{d}) * wd AS o, wd AS w FROM (SELECT *, CASE WHEN w{d} = 0 THEN 0 ELSE 255 - w{d} END AS wd FROM t) WHERE NOT ({LAST[d - 1]}) AND reg <> r{d}"
        for d in (1, 2, 3)
    )
    out = (
        f"SELECT image_id, idx, CAST(label[reg] AS BIGINT) AS region, {r6(f'u + {TP} * wraps[reg]')} AS value FROM lab JOIN final USING (image_id)"
        if voxels
        else "SELECT image_id, CAST(r AS BIGINT) AS region, CAST(label[r] AS BIGINT) AS merged, CAST(wraps[r] AS BIGINT) AS wraps, list_contains(roots, r) AS root FROM final, (SELECT unnest(range(1, 9)) AS r)"
    )
    return f"""WITH RECURSIVE {weight_ctes(DEFAULT, mag=True)},
lab AS (SELECT image_id, idx, w1, w2, w3, reg, phase + {TP} * ((reg * 5 + image_id) % 4) AS u FROM (SELECT *, {UNEVEN} AS reg FROM wts JOIN (SELECT image_id, idx, phase FROM vox) USING (image_id, idx))),
t AS (SELECT *, {taps} FROM lab WINDOW w AS (PARTITION BY image_id ORDER BY idx)), e AS ({parts}),
sums AS (SELECT image_id, ri, rj, sum(o) AS o, sum(w) AS w FROM (SELECT * FROM e UNION ALL SELECT image_id, rj, ri, -o, w FROM e) GROUP BY 1, 2, 3 HAVING sum(w) > 0),
touching AS (SELECT image_id, list({{'i': ri, 'j': rj, 'k': round_even(o / w / {TP}, 0)}} ORDER BY w DESC, rj, ri) AS pairs FROM sums GROUP BY 1),
sizes AS (SELECT image_id, list(reg ORDER BY n DESC, reg) AS by_size FROM (SELECT image_id, reg, count(*) AS n FROM lab GROUP BY 1, 2) GROUP BY 1),
settle AS (
  SELECT image_id, by_size, pairs, CAST([] AS INTEGER[]) AS done, CAST([] AS INTEGER[]) AS roots, list_filter(pairs, lambda p: false) AS met FROM touching JOIN sizes USING (image_id)
  UNION ALL
  SELECT image_id, by_size, pairs, list_distinct(list_concat(now, list_transform(turn, lambda p: p.j))), list_append(roots, root), list_concat(met, turn)
  FROM (SELECT *, list_filter(pairs, lambda p: list_contains(now, p.i) AND NOT list_contains(now, p.j)) AS turn
    FROM (SELECT *, list_append(done, root) AS now FROM (SELECT *, list_filter(by_size, lambda r: NOT list_contains(done, r))[1] AS root FROM settle WHERE len(done) < 8)))),
settled AS (SELECT * FROM settle WHERE len(done) = 8),
apply AS (
  SELECT image_id, roots, met, 0 AS n, CAST(range(1, 9) AS BIGINT[]) AS label, list_transform(range(1, 9), lambda r: 0e0) AS wraps FROM settled
  UNION ALL
  SELECT image_id, roots, met, n + 1, list_transform(label, lambda x: CASE WHEN p.k <> 0 AND x = p.j THEN p.i ELSE x END),
    list_transform(range(1, 9), lambda r: wraps[r] + CASE WHEN label[r] = p.j THEN p.k ELSE 0e0 END)
  FROM (SELECT *, met[n + 1] AS p FROM apply WHERE n < len(met))),
final AS (SELECT * FROM apply WHERE n = len(met))
{out}"""


def correct_regions() -> str:
    return f"""WITH {VOX}, v AS (SELECT image_id, idx, {LABEL} AS reg, phase + {TP} * ({LABEL}) AS u FROM vox),
m AS (SELECT image_id, reg, median(round_even(u / {TP}, 0)) AS k FROM v GROUP BY 1, 2)
SELECT image_id, idx, {r6(f"u - {TP} * k")} AS value FROM v JOIN m USING (image_id, reg)"""


GLOBAL = f"""WITH {VOX}, v AS (SELECT image_id, idx, phase + {TP} * (image_id % 5) AS u FROM vox),
m AS (SELECT image_id, median(round_even(u / {TP}, 0)) AS k FROM v GROUP BY 1)
SELECT image_id, idx, {r6(f"u - {TP} * k")} AS value FROM v JOIN m USING (image_id)"""

WIDE = f"""WITH {VOX}, {ECHOES}, w AS (SELECT image_id, idx, max(phase) FILTER (echo = 1) AS e1, max(phase) FILTER (echo = 2) AS e2, max(phase) FILTER (echo = 3) AS e3
FROM ech GROUP BY 1, 2)"""


def _temporal_steps(template: int) -> str:
    if template == 1:
        return f", a AS (SELECT image_id, idx, e1, {to_ref('e2', 'e1 * (2e0 / 1e0)')} AS e2, e3 FROM w), b AS (SELECT image_id, idx, e1, e2, {to_ref('e3', 'e2 * (3e0 / 2e0)')} AS e3 FROM a)"
    return f", b AS (SELECT image_id, idx, {to_ref('e1', 'e2 * (1e0 / 2e0)')} AS e1, e2, {to_ref('e3', 'e2 * (3e0 / 2e0)')} AS e3 FROM w)"


def temporal(template: int) -> str:
    return f"{WIDE}{_temporal_steps(template)} SELECT image_id, idx, {r6('e1')} AS e1, {r6('e2')} AS e2, {r6('e3')} AS e3 FROM b"


MULTI_ECHO = f"""{WIDE},
m2 AS (SELECT image_id, median(round_even((e1 * (2e0 / 1e0) - e2) / {TP}, 0)) AS k FROM w GROUP BY 1),
a AS (SELECT image_id, idx, e1, e2 + {TP} * k AS e2, e3 FROM w JOIN m2 USING (image_id)),
m3 AS (SELECT image_id, median(round_even((e2 * (3e0 / 2e0) - e3) / {TP}, 0)) AS k FROM a GROUP BY 1)
SELECT image_id, idx, {r6("e1")} AS e1, {r6("e2")} AS e2, {r6(f"e3 + {TP} * k")} AS e3 FROM a JOIN m3 USING (image_id)"""


def _quality_cte(flags, mag: bool, phase2: bool = False, half: bool = False) -> str:
    zero = ", ".join(f"coalesce(q{d}, 0e0) AS q{d}" for d in (1, 2, 3))
    total = "q1 + q2 + q3" + "".join(f" + coalesce(lag(q{d}, {s}) OVER w, 0e0)" for d, s in enumerate(STRIDES, 1))
    return f"{edge_ctes(flags, mag, phase2, half=half)}, z AS (SELECT image_id, idx, {zero} FROM qual), qm AS (SELECT image_id, idx, CAST(({total}) / 6 AS FLOAT) AS quality FROM z WINDOW w AS (PARTITION BY image_id ORDER BY idx))"


def quality(flags, mag: bool = False, phase2: bool = False, half: bool = False) -> str:
    return f"WITH {_quality_cte(flags, mag, phase2, half)} SELECT image_id, idx, {r6('quality')} AS quality FROM qm"


def quality_per_flag() -> str:
    parts = []
    for k in range(6):
        flags = [i == k and k != 1 for i in range(6)]  # without a second echo gradient coherence is off
        parts.append(f"SELECT image_id, idx, CAST({k + 1} AS BIGINT) AS flag, quality FROM ({quality(flags, mag=True)})")
    return " UNION ALL ".join(parts)


def quality_skipped() -> str:
    inside = " AND ".join(f"NOT ({x})" for x in LAST)
    return f"WITH {_quality_cte([False] * 6, False)} SELECT image_id, bool_and(quality = 1.0) FILTER ({inside}) AS skipped FROM qm GROUP BY image_id"


def mask_quality() -> str:
    return f"WITH {_quality_cte(DEFAULT, True)} SELECT image_id, idx, {r6('quality')} > 0.4e0 AS mask FROM qm"


def b0(kind: str) -> str:
    w = {
        "phase_snr": "mag * te", "phase_var": "mag * mag * te * te", "average": "1e0", "TEs": "te", "mag": "mag", "simulated_mag": "exp(-te / 20e0)",
    }[kind]
    echoes = " UNION ALL ".join(f"SELECT image_id, idx, {e} AS echo, e{e} AS unwrapped FROM b" for e in (1, 2, 3))
    return f"""{WIDE}{_temporal_steps(1)}, u AS ({echoes}),
f AS (SELECT image_id, idx, {w} AS w, unwrapped / te AS f, mag * te AS s FROM ech JOIN u USING (image_id, idx, echo))
SELECT image_id, idx, {r6(f"1000e0 / {TP} * (sum(w * f) / sum(w))")} AS b0, {r6("sum(w * s) / sqrt(sum(w * w))")} AS snr FROM f GROUP BY 1, 2"""


COIL = "coil AS (SELECT image_id // 2 AS image_id, image_id % 2 + 1 AS channel, echo, idx, phase, mag FROM ech)"

HIP = f"""WITH {VOX}, {ECHOES}, {COIL},
s AS (SELECT a.image_id, a.idx, sum(a.mag * b.mag * cos(b.phase - a.phase)) AS re, sum(a.mag * b.mag * sin(b.phase - a.phase)) AS im
  FROM coil a JOIN coil b ON a.image_id = b.image_id AND a.channel = b.channel AND a.idx = b.idx AND a.echo = 1 AND b.echo = 2 GROUP BY 1, 2)
SELECT image_id, idx, {r6("atan2(im, re)")} AS hip, {r6("sqrt(re * re + im * im)")} AS weight FROM s"""

COILS = f"""WITH {VOX}, {ECHOES}, {COIL}, p AS (SELECT *, phase - (0.1e0 * channel + 0.01e0 * idx) AS q FROM coil),
s AS (SELECT image_id, echo, idx, sum(mag * cos(q)) AS re, sum(mag * sin(q)) AS im, sum(mag * mag) AS mm FROM p GROUP BY 1, 2, 3)
SELECT image_id, CAST(echo AS BIGINT) AS echo, idx, {r6("atan2(im, re)")} AS phase, {r6("sqrt(mm)")} AS mag FROM s"""



def smooth(sigma: tuple[float, ...]) -> str:
    """All voxels of a cube within 3 sigma, by one weight for each distance."""
    part = lambda i, s: f"(CASE WHEN abs({i}) <= ceil(3e0 * {s}e0) THEN exp(-0.5e0 * ({i} / {s}e0) * ({i} / {s}e0)) ELSE 0e0 END)"
    away = ("(b.idx % 4 - a.idx % 4)", "((b.idx // 4) % 4 - (a.idx // 4) % 4)", "(b.idx // 16 - a.idx // 16)")
    w = " * ".join(part(i, s) for i, s in zip(away, sigma))
    return f"""WITH {VOX}, p AS (SELECT a.image_id, a.idx, {w} AS w, b.mag * cos(b.phase) AS re, b.mag * sin(b.phase) AS im FROM vox a JOIN vox b USING (image_id))
SELECT image_id, idx, {r6("sum(w * re) / sum(w)")} AS re, {r6("sum(w * im) / sum(w)")} AS im FROM p GROUP BY 1, 2"""


BOUNDARY = f"""WITH {VOX}, v AS (SELECT image_id, idx, (idx * 5 + image_id) % 3 = 0 AS seen FROM vox),
t AS (SELECT image_id, idx, seen, {", ".join(f"lead(seen, {s}) OVER w AS n{d}" for d, s in enumerate(STRIDES))} FROM v WINDOW w AS (PARTITION BY image_id ORDER BY idx))
""" + " UNION ALL ".join(f"SELECT image_id, idx, CAST({d} AS BIGINT) AS dim, idx * 3 + {d} AS edge FROM t WHERE NOT ({LAST[d]}) AND seen <> n{d}" for d in range(3))
