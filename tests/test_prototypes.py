"""Trial fingerprints against plain loops over hand-made films."""

import hashlib
import random

import numpy as np

from spanloom.operators import prototypes as T

SIDE = "struct<times:array<bigint>,anchors:array<struct<t_ms:bigint,phash:string>>>"


def bits(a, b):
    return bin(int(a, 16) ^ int(b, 16)).count("1") if a and b and len(a) == len(b) == 16 else 64


def film(seed, duration):
    r = random.Random(seed)
    shots = [(t, f"{r.choice([1, 3, 7, 2**63 - 1, r.getrandbits(63)]):016x}", float(r.randrange(9))) for t in range(0, duration, 400) if r.random() < 0.8]
    return shots


FILMS = {1: 3_000_000, 2: 2_400_000, 3: 600_000, 4: 100_000, 5: 0, 6: None}
SHOTS = {k: film(k, d or 0) for k, d in FILMS.items()}


def tables(spark):
    films = spark.createDataFrame(list(FILMS.items()), "film_id int, duration_ms long")
    frames = spark.createDataFrame([(k, *x) for k, shots in SHOTS.items() for x in shots], "film_id int, t_ms long, phash string, variance double")
    return films, frames


def plain_body(d):
    cushion = max(60_000, min(300_000, int(d * 0.05)))
    return cushion, max(cushion + 1, d - cushion)


def plain_pick(shots, by):
    if by == "variance":
        return max(shots, key=lambda x: (x[2], -x[0]))
    if len(shots) == 1:
        return shots[0]
    return max(((bits(p[1], x[1]), x[1], -x[0], x) for p, x in zip(shots, shots[1:], strict=False)))[3]


def plain_digest(version, shots, lo, hi, taus):
    parts, n = [f"v{version}|span={(hi - lo) // 1000}"], 0
    for f in taus:
        t = int(lo + f * (hi - lo))
        if version in (3, 7):
            got = next((x for x in shots if x[0] >= t), None)
        else:
            start = max(lo, t - 1000)
            inside = [x for x in shots if start <= x[0] < start + 2000][:5]
            got = plain_pick(inside, "variance" if version == 5 else "change") if inside else None
        if got:
            n += 1
            parts.append(f"{int(round(round(f, 6) / 0.0005)):05d}:{got[1]}")
    return hashlib.sha256("|".join(parts).encode()).hexdigest() if n > 1 else None


def test_digests_of_the_body(spark):
    films, frames = tables(spark)
    for version in (3, 5, 6):
        got = {x.film_id: x.digest for x in T.body_digests(films, frames, None, version).collect()}
        want = {k: plain_digest(version, SHOTS[k], *plain_body(d), [(i + 0.5) / 10 for i in range(10)]) for k, d in FILMS.items() if d}
        assert got == {k: v for k, v in want.items() if v} and len(got) >= 3


def test_body_by_sound(spark):
    films, frames = tables(spark)
    r = random.Random(8)
    levels = {k: [float(r.randrange(50)) for _ in range((d or 0) // 100)] for k, d in FILMS.items()}
    rows = spark.createDataFrame([(k, i, x) for k, xs in levels.items() for i, x in enumerate(xs)], "film_id int, idx long, rms double")
    bodies = {}
    for k, d in FILMS.items():
        if not d or len(levels[k]) < 60:
            continue
        s, n = np.round(np.convolve(levels[k], np.ones(50) / 50, mode="same"), 6), len(levels[k])
        edges = (d * 0.05, d * 0.20, d * 0.80, d * 0.95) if d < 1_800_000 else (180_000, 1_080_000, d - 1_200_000, d - 300_000)
        a, b, c, e = (max(0, min(n, int(int(x) / 100))) for x in edges)
        if a >= b or c >= e:
            continue
        start = a + int(np.argmax(s[a:b]))
        c = max(c, start + 600)
        if c < e:
            bodies[k] = (start * 100, (c + int(np.argmax(s[c:e]))) * 100)
    assert {x.film_id: (x.lo, x.hi) for x in T.audio_body(rows, films).collect()} == bodies and {1, 2, 3} <= set(bodies)
    for version in (7, 8):
        got = {x.film_id: x.digest for x in T.body_digests(films, frames, rows, version).collect()}
        assert got == {k: plain_digest(version, SHOTS[k], *b, [i / 10 for i in range(11)]) for k, b in bodies.items()}


def test_anchor_pair(spark):
    films, frames = tables(spark)
    want = {}
    for k, d in FILMS.items():
        if not d:
            continue
        lo, hi = plain_body(d)
        picks = []
        for a, b in ((0.05, 0.15), (0.85, 0.95)):
            s, e = lo + int((hi - lo) * a), lo + int((hi - lo) * b)
            inside = [x for x in SHOTS[k] if s <= x[0] < max(e, s + 1000)]
            if inside:
                mean = sum(1 << i for i in range(64) if 2 * sum(int(x[1], 16) >> i & 1 for x in inside) > len(inside))
                picks.append(max(inside, key=lambda x: (bits(x[1], f"{mean:016x}"), -x[0])))
        if len(picks) == 2:
            (ta, ha, _), (tb, hb, _) = picks
            want[k] = (ta, tb, hashlib.sha256(f"v4|{ha}|{(tb - ta) // 1000}|{hb}".encode()).hexdigest())
    assert {x.film_id: (x.a_ms, x.b_ms, x.digest) for x in T.anchor_pair(films, frames).collect()} == want and len(want) >= 3


def test_anchors_from_the_end(spark):
    r = random.Random(5)
    times = {1: sorted(r.sample(range(5_000_000), 300)), 2: list(range(0, 5_000_000, 10_000)), 3: [1, 2], 4: [*range(20), 2_000_000], 5: sorted(r.sample(range(600_000), 40)), 6: []}
    durations = {1: 5_000_000, 2: 5_000_000, 3: 1000, 4: 4_000_000, 5: 600_000, 6: 900_000, 7: None}
    films = spark.createDataFrame(list(durations.items()), "film_id int, duration_ms long")
    rows = spark.createDataFrame([(k, t) for k, ts in times.items() for t in ts], "film_id int, t_ms long")
    got = {x.film_id: x for x in T.end_anchors(films, rows).collect()}
    assert {k: x.outcome for k, x in got.items()} == {1: "ok", 2: "even", 3: "keyframes", 4: "body", 5: "peaks", 6: "keyframes"}
    inside = [t for t in times[1] if 250_000 <= t <= 4_750_000]
    near, kept = sorted({min(inside, key=lambda k: (abs(k - t), k)) for t in (5_000_000 - 300_000 - i * 180_000 for i in range(25)) if t >= 0}), []
    for t in near:
        if not kept or t - kept[-1] >= 30_000:
            kept.append(t)
    assert got[1].peaks == kept and got[1].inner_span_ms == kept[-2] - kept[1]


def plain_subset(a, b):
    short, long = (a, b) if len(a) <= len(b) else (b, a)

    def count(offset):
        n = j = 0
        for t in short:
            while j < len(long) and long[j] < t + offset - 2000:
                j += 1
            if j < len(long) and abs(long[j] - t - offset) <= 2000:
                n, j = n + 1, j + 1
        return n

    tried = [x - short[0] for x in long[:50] if abs(x - short[0]) <= 600_000]
    tried += [x - short[-1] for x in long[::-1][:50] if tried and abs(x - short[-1]) <= 600_000]
    best = max(tried, key=count) if tried else 0
    return count(best) if tried else 0, best if len(a) <= len(b) else -best


def plain_hashes(a, b, forth):
    compared = close = 0
    for t, h in a:
        others = [(abs(u - t - forth), k, g) for k, (u, g) in enumerate(b) if g]
        if h and others and min(others)[0] <= 5000:
            compared += 1
            close += bits(h, min(others)[2]) <= 20
    return compared, close


def test_verdicts(spark):
    r, pairs = random.Random(7), []
    for k in range(40):
        t, a = 0, []
        for _ in range(r.choice([10, 40, 80])):
            t += r.randrange(500, 40_000)
            a.append(t)
        move = r.choice([0, 22_000, -5_000, 900_000])
        b = sorted({x + move + r.randrange(-300, 300) for x in a if r.random() < r.choice([0.5, 0.97])} | {r.randrange(t) for _ in range(r.choice([0, 5]))})
        marks = [(x, r.choice(["", None, "zz", *[f"{x:016x}"] * 9])) for x in r.sample(a, min(len(a), 25))]
        other = [(x + move, h if r.random() < 0.7 else f"{r.getrandbits(63):016x}") for x, h in marks]
        pairs.append((k, (a, sorted(marks)), (b, other)) if k % 2 else (k, (b, other), (a, sorted(marks))))
    pairs += [(100, None, pairs[1][1]), (101, (pairs[1][1][0], []), pairs[1][1]), (102, pairs[1][1], pairs[1][1])]
    df = spark.createDataFrame(pairs, f"pair_id int, a {SIDE}, b {SIDE}")
    v12, v13, v14 = ({x.pair_id: x for x in f.collect()} for f in (T.subset_verdicts(df), T.hashed_verdicts(df, False), T.hashed_verdicts(df, True)))
    said = set()
    for k, a, b in pairs:
        times = [sorted(x[0]) if x else [] for x in (a, b)]
        n = min(map(len, times))
        if n < 30:
            assert v12[k].outcome == v13[k].outcome == v14[k].outcome == "insufficient"
            continue
        matched, trim = plain_subset(*times)
        assert (v12[k].matched, v12[k].trim, v12[k].same) == (matched, trim, matched / n >= 0.70)
        if not a[1] or not b[1]:
            assert v13[k].outcome == v14[k].outcome == "insufficient"
            continue
        on_time = matched / n >= 0.55
        compared, close = plain_hashes(a[1], b[1], trim) if on_time else (0, 0)
        assert (v13[k].compared, v13[k].close, v13[k].same) == (compared, close, on_time and compared > 0 and close / compared >= 0.40)
        short, long = times if len(times[0]) <= len(times[1]) else times[::-1]
        gs, gl = np.diff(short), np.diff(long)
        agree = [int((abs(gs - gl[i : i + len(gs)]) <= 5000).sum()) for i in range(len(gl) - len(gs) + 1)]
        at = agree.index(max(agree))
        forth = (long[at] - short[0]) * (1 if len(times[0]) <= len(times[1]) else -1)
        on_time = agree[at] / len(gs) >= 0.55
        compared, close = plain_hashes(a[1], b[1], forth) if on_time else (0, 0)
        assert (v14[k].matched, v14[k].trim, v14[k].compared, v14[k].close) == (agree[at], -forth, compared, close)
        assert v14[k].same == (on_time and compared > 0 and close / compared >= 0.40)
        said |= {(12, v12[k].same), (13, v13[k].same), (14, v14[k].same), v13[k].outcome}
    assert said >= {(12, True), (12, False), (13, True), (13, False), (14, True), (14, False), "timing", "compared"}


def test_end_anchors_group_once(spark):
    """One list a film: no window sorts a task's rows again. Repeated times count once, a film without times has none, a blank time counts as a keyframe."""
    films = spark.createDataFrame([(1, 9_000_000), (2, 9_000_000), (3, 9_000_000), (4, 0)], "film_id long, duration_ms long")
    uneven = [k * 31_000 + k * k % 7 * 9_000 for k in range(280)]
    rows = [(1, t) for t in uneven + uneven[:50]] + [(2, k * 31_000) for k in range(280)] + [(2, None), (4, 1000)]
    out = T.end_anchors(films, spark.createDataFrame(rows, "film_id long, t_ms long"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan
    got = {x.film_id: x for x in out.collect()}
    assert {k: (x.outcome, x.n_keyframes) for k, x in got.items()} == {1: ("ok", len(set(uneven))), 2: ("even", 281), 3: ("keyframes", 0)}
    inside = sorted({t for t in uneven if 450_000 <= t <= 8_550_000})
    near = sorted({min(inside, key=lambda x: (abs(x - t), x)) for t in (9_000_000 - 300_000 - k * 180_000 for k in range(25))})
    kept = near[:1]
    for t in near[1:]:
        kept += [t] if t - kept[-1] >= 30_000 else []
    assert got[1].peaks == kept and got[1].n_body == len(inside)
