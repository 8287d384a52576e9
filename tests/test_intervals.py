"""Interval algebra on hand-made and random ranges."""

import random

from pyspark.sql import functions as F

from spanloom.operators import intervals as I


def frame(spark, rows):
    return spark.createDataFrame([(1, *r) for r in rows], "film_id long, start_ms long, end_ms long")


def listed(df):
    return sorted((r.start_ms, r.end_ms) for r in df.collect())


def plan(spark, cuts, duration=10_000):
    merged = I.union(frame(spark, cuts), duration)
    return listed(merged), listed(I.complement(merged, duration))


def test_plans(spark):
    assert plan(spark, [(3000, 5000)])[1] == [(0, 3000), (5000, 10000)]
    assert plan(spark, [(0, 4000)])[1] == [(4000, 10000)]
    assert plan(spark, [(7000, 10000)])[1] == [(0, 7000)]
    assert plan(spark, [(0, 10000)])[1] == []
    for cuts in ([(2000, 5000), (4000, 7000)], [(2000, 5000), (5000, 7000)]):
        assert plan(spark, cuts)[1] == [(0, 2000), (7000, 10000)]
    assert plan(spark, [(10000, 20000), (15000, 25000), (25000, 30000), (90000, 95000)], 600_000)[0] == [(10000, 30000), (90000, 95000)]


def test_cuts_and_keeps_tile_the_film(spark):
    r = random.Random(4)
    for _ in range(5):
        cuts = [(a, a + r.randrange(1, 900)) for a in (r.randrange(-200, 10_200) for _ in range(12))]
        merged, keeps = plan(spark, cuts)
        tiles = sorted(merged + keeps)
        assert tiles[0][0] == 0 and tiles[-1][1] == 10_000 and all(a[1] == b[0] for a, b in zip(tiles, tiles[1:], strict=False))


def test_confirmed_only(spark):
    rows = spark.createDataFrame([(1, 2000, 4000, "pending"), (1, 6000, 8000, "rejected"), (1, 5000, 5500, "confirmed"), (1, 7, 7, "confirmed")], "film_id long, start_ms long, end_ms long, status string")
    assert listed(I.confirmed(rows)) == [(5000, 5500)]


def test_attribution(spark):
    rows = spark.createDataFrame([(1, 10, 20, "Violence", "confirmed"), (1, 50, 60, "Language", "confirmed"), (1, 55, 65, "Violence", "confirmed")], "film_id long, start_ms long, end_ms long, category string, status string")
    got = sorted((r.start_ms, r.category) for r in I.attribution(I.union(rows, 600), rows, 8).collect())
    assert got == [(10, "Violence"), (50, "")]


def test_subtitles(spark):
    keeps = frame(spark, [(0, 3000), (7000, 10000)])
    for entry, want in [((4000, 6000), []), ((8000, 9500), [(4000, 5500)]), ((2500, 4500), [(2500, 3000)]), ((2500, 7500), [(2500, 3000), (3000, 3500)])]:
        rows = spark.createDataFrame([(1, 0, *entry, "t")], "film_id long, ord long, start_ms long, end_ms long, text string")
        assert listed(I.retime(rows, keeps, 1000)) == want


def test_boundary_plan(spark):
    keys = spark.createDataFrame([(1, t) for t in (0, 12000, 24000, 36000)], "film_id long, t_ms long")
    got = sorted((r.start_ms, r.end_ms, r.kind) for r in I.boundary_plan(frame(spark, [(0, 10000), (21000, 60000), (37000, 38000)]), keys, 5000).collect())
    assert got == [(0, 10000, "original"), (21000, 24000, "rendered"), (24000, 60000, "original"), (37000, 38000, "rendered")]


def test_cut_at(spark):
    cuts, at = frame(spark, [(10000, 20000), (50000, 60000)]), [5000, 9000, 9900, 15000, 20000, 55000]
    positions = spark.createDataFrame([(1, p) for p in at], "film_id long, position_ms long")
    got = {r.position_ms: r.cut_end_ms for r in I.cut_at(positions, cuts, 150, 4096).collect()}
    assert got == {9900: 20000, 15000: 20000, 55000: 60000}


def test_overlap_join_reports_each_pair_once(spark):
    r = random.Random(9)
    a = [(s, s + r.randrange(1, 50)) for s in (r.randrange(300) for _ in range(40))]
    b = [(s, s + r.randrange(1, 50)) for s in (r.randrange(300) for _ in range(40))]
    got = sorted((x.start_ms, x.end_ms, x.b_start_ms, x.b_end_ms) for x in I.overlap_join(frame(spark, a), frame(spark, b), 7).collect())
    assert got == sorted((*x, *y) for x in a for y in b if x[0] < y[1] and y[0] < x[1])


def test_skip_replay(spark):
    jumps = I.skip_replay(frame(spark, [(100, 200), (205, 300), (900, 950)]), 0, 40, 10, 1000).collect()
    assert sorted((r.from_ms, r.to_ms) for r in jumps) == [(100, 200), (240, 300), (900, 950)]


def test_exploded_sides_are_not_broadcast(spark):
    """Keyframes and positions are exploded from few rows, so that Spark takes them for small."""
    films = spark.range(1, 50).select(F.col("id").alias("film_id"))
    points = films.select("film_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(600).cast("long"))).alias("t_ms"))
    ranges = films.select("film_id", F.lit(10).cast("long").alias("start_ms"), F.lit(500).cast("long").alias("end_ms"))
    for df in (I.point_join(points, ranges, "t_ms", 64), I.overlap_join(ranges, ranges, 64)):
        assert df.count() == (49 * 490 if "t_ms" in df.columns else 49)
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()
