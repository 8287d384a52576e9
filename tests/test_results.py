"""Documents that may be broken, logs, reasons in order, factors by weight, and what stored rows do to later scores."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.operators import admission as M
from spanloom.operators import results as R
from spanloom.operators import trust as T
from spanloom.operators import vectors as V


def test_recipes_of_any_shape(spark):
    cat = {"name": "A", "threshold": 0.5, "detectors": [{"id": "d", "weight": 1, "params": {"labels": ["x", "y"]}}, {"id": "e"}]}
    docs = [
        ("object", json.dumps({"categories": [cat, {"name": "B", "enabled": False}]})), ("list", json.dumps([cat])), ("empty", "[]"), ("json", "{"), ("null", None), ("shape", '{"categories": 5}'), ("text", '"a"'), ("none", "{}"),
    ]
    got = R.recipes(spark.createDataFrame(docs, "name string, raw string")).collect()
    a = {("A", True, 0.5, 0, "d", "x"), ("A", True, 0.5, 0, "d", "y"), ("A", True, 0.5, 1, "e", None)}
    of = lambda n: {(r.category, r.enabled, r.threshold, r.det_ord, r.det_id, r.label) for r in got if r.name == n and r.error is None}
    assert of("object") == a | {("B", False, None, None, None, None)} and of("list") == a and of("empty") == set()
    assert {r.name: r.error for r in got if r.error} == {"json": "json", "null": "json", "shape": "shape", "text": "shape", "none": "shape"}


def test_results_keep_what_can_be_read(spark):
    sugg = {"category": "A", "startMs": 1, "endMs": 5, "score": 1, "reasons": ["r", 5, None, "s"], "contributingAuthors": [f"a{k}" for k in range(60)] + [7]}
    whole = {"schemaVersion": 3, "durationMs": 9, "fingerprint": {"type": "keyframes", "keyframeTimesMs": [1, 2.5, "x", 4] + list(range(30_000)), "peaks": [{"tMs": 1}]}, "suggestions": [sugg, {**sugg, "endMs": 1}, {**sugg, "category": ""}, {**sugg, "score": "high", "reasons": 5}, 7]}
    sound = {"fingerprint": {"type": "audio_peak_gaps", "peaks": [5, {"tMs": 3, "phash": "h"}, {"phash": 9}] + [{"tMs": k} for k in range(300)], "keyframeTimesMs": [1]}}
    docs = [("whole", json.dumps(whole)), ("sound", json.dumps(sound)), ("bad", "{"), ("odd", "[]"), ("types", json.dumps({"durationMs": "9", "suggestions": {}, "fingerprint": []}))]
    got = {r.name: r for r in R.results(spark.createDataFrame(docs, "name string, raw string")).collect()}
    w = got["whole"]
    assert (w.error, w.schema_version, w.duration_ms, w.keyframes[:3], len(w.keyframes), w.peaks) == (None, 3, 9, [1, 4, 0], 20_000, [])
    assert [(s.category, s.score, s.reasons, len(s.authors)) for s in w.suggestions] == [("A", 1.0, ["r", "s"], 50), ("A", 0.0, [], 50)]
    assert [tuple(p) for p in got["sound"].peaks[:3]] == [(3, "h"), (0, ""), (0, "")] and len(got["sound"].peaks) == 200 and got["sound"].keyframes == []
    assert got["bad"].error == "json" and [(got[n].error, got[n].duration_ms, got[n].suggestions, got[n].kind) for n in ("odd", "types")] == [(None, 0, [], "")] * 2


def test_loudness_log(spark):
    lines = ["[m] t: 0.1   TARGET:-23 LUFS    M: -20.5 S: -22.0     I: -70", "frame=1", "t: 0.2 M: nan S: -inf", "t: 0.3 M:-500 S:+1.5", "t: 0.4 S: -1 M: -2", "t: 0.5 M: 1.2.3 S: .5", "t: 0.6 M:", "", None]
    rows = [("f", k, x) for k, x in enumerate(lines)] + [("g", 9, "t: 1 M: -1 S: -2"), ("g", 2, "t: 0 M: -3 S: -4")]
    got = R.loudness_log(spark.createDataFrame(rows, "file string, seq int, line string").repartition(4)).collect()
    want = {("f", 0, -20.5, -22.0), ("f", 1, -120.0, -120.0), ("f", 2, -120.0, 1.5), ("f", 3, -120.0, 0.5), ("g", 0, -3.0, -4.0), ("g", 1, -1.0, -2.0)}
    assert {tuple(r) for r in got} == want


def test_reasons_in_order(spark):
    rows = [(1, "B", 0, 10, 0.5, ["b"], 0), (1, "A", 0, 10, 0.7, ["late"], 5), (1, "A", 0, 10, 0.6, ["first"], 1), (1, "A", 12, 15, 0.9, None, 2), (1, "A", 11, 13, 0.1, ["x", "y"], 3), (1, "A", 30, 40, 0.2, ["far"], 4), (2, "A", 5, 6, 1.0, [], 6)]
    got = R.merged_reasons(spark.createDataFrame(rows, "film_id int, category string, start_ms long, end_ms long, score double, reasons array<string>, arrival int"), 1)
    want = [(1, 0, "B", 0, 10, 0.5, "b"), (1, 1, "A", 0, 15, 0.9, "first · late · x · y"), (1, 2, "A", 30, 40, 0.2, "far"), (2, 0, "A", 5, 6, 1.0, "")]
    assert sorted((r.film_id, r.place, r.category, r.start_ms, r.end_ms, r.confidence, r.note) for r in R.pending_markers(got).collect()) == want
    assert [r.t for r in spark.createDataFrame([(0.7451,), (0.745,), (1.0,), (0.0049,)], "x double").select(R.peak_reason(F.col("x")).alias("t")).collect()] == [f"fused score peaked at {t}" for t in ("0.75", "0.75", "1.00", "0.00")]


def test_order_of_markers_is_stable(spark):
    rows = [(k % 3, k * 7 % 5, k) for k in range(60)]
    got = R.in_order(spark.createDataFrame(rows, "film_id long, start_ms long, id long"), "id").collect()
    assert [(r.film_id, r.start_ms, r.id) for r in sorted(got, key=lambda r: r.ordinal)] == sorted(rows, key=lambda r: (r[0], r[1], -r[2]))
    assert sorted(r.ordinal for r in got) == list(range(60))


def test_factor_takes_the_best_rows_weight(spark):
    scores = spark.createDataFrame([(0, "p", 0.9), (1, "p", 0.9), (2, "p", 0.5)], "t long, prompt string, score double")
    frames = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0])], "t long, vec array<float>")
    decided = spark.createDataFrame([(1, [1.0, 0.0], False), (2, [0.9, 0.1], False), (3, [0.0, 1.0], True), (4, [1.0, 0.0], False)], "row_id long, vec array<float>, accepted boolean")
    weights = spark.createDataFrame([(1, 0.5), (2, 1.0), (3, 1.7)], "row_id long, weight double")
    got = {r.t: r.score for r in V.weighted_scores(scores, frames, decided, weights, 0.35).collect()}
    assert got == {0: pytest.approx(0.9 * 0.75), 1: 1.0, 2: 0.5}


def test_stored_rows_move_later_scores(spark):
    """What admission stores is read as feedback; its authors' trust comes from decisions on them."""
    stored = [('{"peer_key":"p","fingerprint":"f","day_utc":1,"schema":1,"category":"A","decision":"reject","score":0.5,"vec":[1.0,0.0]}', "p"), ('{"schema":1,"category":"A","decision":"accept","score":0.5,"vec":[0.0,1.0]}', "q"), ("broken", "q")]
    rows = M.stored_feedback(spark.createDataFrame(stored, "stored string, peer string"))
    assert sorted((r.author, r.accepted, r.vec) for r in rows.collect()) == [("p", False, [1.0, 0.0]), ("q", True, [0.0, 1.0])]
    frames = spark.createDataFrame([(0, [1.0, 0.0])], "t long, vec array<float>")
    scores = spark.createDataFrame([(0, "x", 0.8)], "t long, prompt string, score double")
    got = []
    for n in (0, 3, 18):
        trust = T.fold(spark.createDataFrame([("p", k, True) for k in range(n)], "author string, seq long, accepted boolean"))
        got.append(V.weighted_scores(scores, frames, rows, M.feedback_weights(rows, trust), 0.35).first().score)
    assert got == [pytest.approx(0.8 * (1 - 0.5 * w)) for w in (0.1, 0.25, 1.0)]


def test_values_of_other_types_are_no_numbers_or_texts(spark):
    """Long lists of mixed values are read without the type of each being spelled out; what counts stays the same."""
    mixed = '[1,"5",-7,5.0,5e0,true,null,{"a":1},[1],"é\\n",2.5,12345678901234567890,9223372036854775807,""]'
    fp = lambda kind: f'{{"type":"{kind}","keyframeTimesMs":{mixed},"peaks":[{{"tMs":"1"}},[1],"x",{{}}]}}'
    docs = [("a", f'\t{{"fingerprint":{fp("keyframes")},"suggestions":[{{"category":"c","startMs":1,"endMs":2,"reasons":{mixed},"contributingAuthors":{mixed}}},[1],7]}}'), ("b", f'{{"fingerprint":{fp("audio_peak_gaps")}}}'), ("c", f'{{"fingerprint":[{fp("keyframes")}]}}'), ("d", '{"fingerprint":{"type":"keyframes","keyframeTimesMs":{"0":1}},"suggestions":{"0":1}}'), ("e", None), ("f", '{"a":1,"a":2}')]
    rows = R.results(spark.createDataFrame(docs, "name string, raw string"))
    assert rows._jdf.queryExecution().optimizedPlan().toString().lower().count("schemaofvariant(") <= 9  # those of single values
    got = {r.name: r for r in rows.collect()}
    assert got["a"].keyframes == [1, -7, 9223372036854775807] and [(s.reasons, s.authors) for s in got["a"].suggestions] == [(["5", "é\n", ""], ["5", "é\n", ""])]
    assert got["b"].keyframes == [] and [(p.t_ms, p.phash) for p in got["b"].peaks] == [(0, ""), (0, "")]
    assert [(got[k].error, got[k].keyframes, got[k].suggestions) for k in "cdef"] == [(None, [], []), (None, [], []), ("json", [], []), ("json", [], [])]
