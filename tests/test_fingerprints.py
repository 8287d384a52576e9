"""Matching of fingerprints on generated sequences."""

import random

from pyspark.sql import functions as F

from spanloom.operators import fingerprints as P


def sequence(seed, n=150):
    r, t, out = random.Random(seed), 0, []
    for _ in range(n):
        t += r.randrange(800, 12_000)
        out.append(t)
    return out


def verdict(spark, a, b):
    rows = P.match(spark.createDataFrame([(1, a, b)], "pair_id long, a array<bigint>, b array<bigint>")).collect()
    return rows[0] if rows else None


def test_a_film_and_itself(spark):
    x = verdict(spark, sequence(42), sequence(42))
    assert x.same and x.fraction > 0.9 and x.spread == 0 and x.trim == 0


def test_a_film_without_its_start(spark):
    a = sequence(42)
    x = verdict(spark, a, [t - 22000 for t in a if t >= 22000])
    assert x.same and x.trim == 22000 and x.spread < 250
    x = verdict(spark, [t - 22000 for t in a if t >= 22000], a)
    assert x.same and x.trim == -22000


def test_different_films_and_short_ones(spark):
    assert not verdict(spark, sequence(1234), sequence(5678)).same
    assert verdict(spark, [1, 2, 3], [1, 2, 3]) is None


def test_pairs(spark):
    df = spark.createDataFrame([([1000, 2000, 3000], [500, 1100, 1900, 3050, 4000], 200), ([1000, 1010], [1005], 100)], "a array<bigint>, b array<bigint>, tol int")
    got = [[tuple(p) for p in r.p] for r in df.where("tol = 200").select(P.paired(F.col("a"), F.col("b"), F.lit(0), 200).alias("p")).collect()]
    assert got == [[(1000, 1100), (2000, 1900), (3000, 3050)]]
    got = df.where("tol = 100").select(P.paired(F.col("a"), F.col("b"), F.lit(0), 100).alias("p")).first()
    assert len(got.p) == 1


def test_pairs_follow_the_cursor(spark):
    r = random.Random(3)
    rows = []
    for _ in range(60):
        a, b = (sorted(r.sample(range(200), r.randrange(1, 20))) for _ in range(2))
        at, want = 0, []
        for s in a:
            at = max(at, sum(y < s + 3 - 10 for y in b))
            if at < len(b) and b[at] <= s + 3 + 10:
                want.append((s, b[at]))
                at += 1
        rows.append((a, b, want))
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>, want array<struct<s:bigint,l:bigint>>")
    assert df.where(P.paired(F.col("a"), F.col("b"), F.lit(3), 10) != F.col("want")).count() == 0


def test_hamming_and_spread(spark):
    df = spark.createDataFrame([("0" * 16, "0" * 16), ("0" * 16, "f" * 16), ("0" * 16, "abc"), ("0" * 16, "z" * 16)], "a string, b string")
    assert [r[0] for r in df.select(P.hamming(F.col("a"), F.col("b"))).collect()] == [0, 64, 64, 64]
    one = spark.createDataFrame([([0] * 25 + [10000] * 25,)], "a array<bigint>").select(P.spread(F.col("a")), P.median(F.col("a")), P.upper_median(F.col("a"))).first()
    assert one[0] > 1000 and one[1] == 5000 and one[2] == 10000


def test_peaks_and_spacing(spark):
    values = [0.0, 5.0, 4.9, 1.0, 5.0, 0.2, 3.0]
    df = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "film_id long, idx long, x double")
    assert sorted(r.idx for r in P.peaks(df, "x", 3, 1).collect()) == [1, 4, 6]
    t = spark.createDataFrame([(1, x) for x in (0, 5, 10, 14, 30)], "film_id long, t_ms long")
    assert sorted(r.t_ms for r in P.spaced(t, 10).collect()) == [0, 10, 30]


def test_ties_and_the_sign_of_the_trim(spark):
    a = [10_000 * k for k in range(1, 41)]  # every shift by a step ties but for the ends
    b = [t + 5_000 for t in a] + [500_000, 500_001]
    x = verdict(spark, a, b)
    assert x.offset == -5_000 and x.trim == -5_000
    shifts = [100, 300] * 20  # an even number: the upper median of long - short, with its sign turned where the first film is the shorter
    b = [t + s for t, s in zip(a, shifts, strict=True)] + [900_000]
    assert verdict(spark, a, b).trim == -300 and verdict(spark, b, a).trim == 300


def test_ladder(spark):
    rungs = [(1, 0, t) for t in range(3)] + [(1, 1, t) for t in range(10)] + [(1, 2, t) for t in range(30)] + [(2, 0, t) for t in range(2)] + [(2, 1, t) for t in range(5)] + [(2, 3, t) for t in range(5)]
    got = sorted(tuple(x) for x in P.ladder(spark.createDataFrame(rungs, "film_id int, rung int, t_ms long")).collect())
    assert got == [(1, 1, t) for t in range(10)] + [(2, 1, t) for t in range(5)]


def test_runs_alike_are_in_a_fixed_order(spark, tmp_path):
    """Lines that tie in number, supplier and duration give the same times however they come."""
    from spanloom.plans.matching import run_lengths

    rows = [(1, 5, 7, 1, float(q)) for q in (9, 3, 6)]
    got = []
    for k, part in enumerate((rows, rows[::-1])):
        spark.createDataFrame(part, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double").coalesce(1).write.parquet(str(tmp_path / f"{k}" / "lineitem.parquet"))
        got.append(sorted(tuple(r) for r in run_lengths(spark, str(tmp_path / f"{k}")).collect()))
    assert got[0] == got[1] == [(1, 1, 0, 0), (1, 2, 18, 200), (1, 3, 54, 600)]


def test_match_against_paired(spark):
    """Lists of all lengths at once: the offset, its pairs, their spread and trim are those of the plain search."""
    r, rows = random.Random(5), []
    for k in range(80):
        a, b = (sorted(r.sample(range(400), r.randrange(2, 70))) for _ in range(2))
        rows.append((k, a, b))
    rows += [(80, None, [1, 2]), (81, [1], [1, 2]), (82, [5, 9], [100_000, 200_000])]
    limits = {"tolerance": 4, "most_offset": 60, "least": 2}
    got = {x.pair_id: x for x in P.match(spark.createDataFrame(rows, "pair_id long, a array<bigint>, b array<bigint>"), **limits).collect()}

    def pairs(short, long, offset):
        at, out = 0, []
        for s in short:
            at = max(at, sum(y < s + offset - 4 for y in long))
            if at < len(long) and long[at] <= s + offset + 4:
                out.append(long[at] - s)
                at += 1
        return out

    middle = lambda v: (sorted(v)[(len(v) - 1) // 2] + sorted(v)[len(v) // 2]) / 2
    for k, a, b in rows[:80]:
        short, long, sign = (a, b, -1) if len(a) <= len(b) else (b, a, 1)
        tried = [o for o in [*(y - short[0] for y in long[:50]), *(y - short[-1] for y in long[::-1][:50])] if abs(o) <= 60]
        if not tried:
            assert k not in got
            continue
        offset = max(tried, key=lambda o: len(pairs(short, long, o)))
        moved = pairs(short, long, offset)
        want = (sign * offset, len(moved), middle([abs(x - middle(moved)) for x in moved]), sign * sorted(moved)[len(moved) // 2])
        assert (got[k].offset, got[k].matched, got[k].spread, got[k].trim) == want
    assert not set(got) & {80, 81, 82}
