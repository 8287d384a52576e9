"""Fusion, runs, merging and jump scores on hand-made series."""

from pyspark.sql import functions as F

from spanloom.operators import series as S
from spanloom.sources.adapters import RECIPE_SCHEMA


def recipe(spark, *rows):
    return spark.createDataFrame(rows, RECIPE_SCHEMA)


def one(name="A", thr=0.5, before=0, after=0, most=0, det=0, key="x", weight=1.0, label=None, enabled=True):
    return (name, enabled, thr, before, after, most, det, key, weight, label)


def series(spark, **by_key):
    return spark.createDataFrame([(1, k.replace("_", "."), i, float(v)) for k, vs in by_key.items() for i, v in enumerate(vs)], "film_id long, series_key string, idx long, value double")


def fused(spark, recipes, s):
    return {r.idx: round(r.fused, 6) for r in S.fuse(S.detector_series(recipes, s)).collect()}


def test_direct_series(spark):
    assert fused(spark, recipe(spark, one()), series(spark, x=[0, 0.6, 0.9, 0.3])) == {0: 0.0, 1: 0.6, 2: 0.9, 3: 0.3}


def test_labels_take_the_largest(spark):
    r = recipe(spark, one(label="a"), one(label="b"))
    assert fused(spark, r, series(spark, x_a=[0.1, 0.4, 0.2], x_b=[0, 0.6, 0])) == {0: 0.1, 1: 0.6, 2: 0.2}


def test_own_key_comes_before_labels(spark):
    r = recipe(spark, one(label="a"))
    assert fused(spark, r, series(spark, x=[0.2], x_a=[0.9])) == {0: 0.2}


def test_sum_is_clamped(spark):
    r = recipe(spark, one(det=0), one(det=1, key="y"))
    assert set(fused(spark, r, series(spark, x=[0.7, 0.7], y=[0.7, 0.7])).values()) == {1.0}


def test_disabled(spark):
    assert fused(spark, recipe(spark, one(enabled=False)), series(spark, x=[0.7])) == {}


def ranges(spark, values, **rule):
    r = recipe(spark, one(**rule))
    s = series(spark, x=values)
    out = S.runs(S.fuse(S.detector_series(r, s)), r, 100, len(values))
    return sorted((x.start_ms, x.end_ms, x.score) for x in out.collect())


def test_runs(spark):
    assert ranges(spark, [0.1, 0.6, 0.7, 0.6, 0.1]) == [(100, 400, 0.7)]
    assert ranges(spark, [0.1, 0.6, 0.6, 0.1], before=200, after=100) == [(0, 400, 0.6)]
    assert ranges(spark, [0.1, 0.2, 0.3], thr=0.9) == []
    assert ranges(spark, [0.6, 0.6, 0.6, 0.1, 0.6], most=200) == [(400, 500, 0.6)]


def test_merge_within_a_category_only(spark):
    rows = spark.createDataFrame([(1, "A", 0, 1000, 0.7), (1, "A", 800, 1500, 0.8), (1, "B", 100, 600, 0.5)], "film_id long, category string, start_ms long, end_ms long, score double")
    got = sorted((r.category, r.start_ms, r.end_ms, r.score) for r in S.merge_runs(rows, 0).collect())
    assert got == [("A", 0, 1500, 0.8), ("B", 100, 600, 0.5)]


def jumps(spark, samples):
    rows = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(samples)], "film_id long, idx long, momentary double")
    return [r.score for r in S.jump_scores(rows).collect()]


def test_jump_scores(spark):
    assert max(jumps(spark, [-40] * 20 + [-15] * 30)) > 0.5
    for flat in ([-15] * 100, [-50] * 100, [-40] * 20 + [-34] * 20):
        assert jumps(spark, flat) == []
    assert 0.95 < max(jumps(spark, [-50] * 20 + [-15] * 20)) <= 1


def test_resample_holds_the_last_value(spark):
    got = S.resample(series(spark, x=[0.1, 0.2]), 100, 50, 6).orderBy("idx").select(F.collect_list("value")).first()[0]
    assert got == [0.1, 0.1, 0.2, 0.2, 0.2, 0.2]


def test_resample_shuffles_no_grid(spark):
    """Gaps, rows before the beginning and after the end, both finer and coarser grids, against the plain rule; the grid is made after the last exchange."""
    held = {("x", 2): 0.5, ("x", 3): 0.25, ("x", 7): 0.75, ("y", -3): 0.5, ("y", -1): 0.125, ("z", 90): 1.0}
    rows = spark.createDataFrame([(1, k, i, v) for (k, i), v in held.items()], "film_id long, series_key string, idx long, value double")
    for src, dst in ((100, 50), (100, 30), (50, 100), (70, 70)):
        df = S.resample(rows, src, dst, 20)
        got = {(r.series_key, r.idx): r.value for r in df.collect()}
        last = {"x": 7, "y": -1, "z": 90}
        assert got == {(k, i): held.get((k, min(i * dst // src, last[k])), 0.0) for k in last for i in range(20)}
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan[: plan.index("Generate")] and "Join" not in plan


def test_label_columns(spark):
    matrix = spark.createDataFrame([(1, 0, [0.5, 0.25, 1.0]), (1, 1, [0.125]), (2, 0, None)], "film_id int, idx long, scores array<float>")
    classes = spark.createDataFrame([(0, "Dog"), (1, "cat"), (2, "dog")], "idx long, name string")
    wanted = spark.createDataFrame([("DOG",), ("Cat",), ("bird",), ("Cat",)], "name string")
    got = sorted(tuple(r) for r in S.label_columns(matrix, classes, wanted, "a.").collect())
    assert got == [(1, "a.Cat", 0, 0.25), (1, "a.DOG", 0, 1.0)]
