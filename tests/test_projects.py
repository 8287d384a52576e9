"""Projects at their places and in their store, endorsements under caps, reports, concat lists, on hand-made rows."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as X
from spanloom.operators import packs as K
from spanloom.operators import projects as J


def test_documents_are_read_with_defaults(spark):
    raws = {
        "whole": json.dumps({"schemaVersion": 2, "sourceFile": "f", "sourceHash": "h", "durationMs": 7, "exportSettings": {"crf": 20, "copyAllAudioTracks": True, "preset": 5}, "markers": [{"id": "a", "startMs": 1, "endMs": 2, "category": "C", "note": "n", "source": "imported", "confidence": 0.5, "status": "rejected", "contributingAuthors": ["x", 3, "y"]}]}),
        "bare": "{}",
        "odd": json.dumps({"durationMs": "7", "markers": [1, {}, {"status": "??", "source": "??", "contributingAuthors": [str(k) for k in range(60)]}], "exportSettings": []}),
        "list": "[]",
        "cut": '{"markers": [',
        "null": None,
    }
    got = {x["name"]: x for x in J.read_documents(spark.createDataFrame(list(raws.items()), "name string, raw string")).collect()}
    assert {k: x.error for k, x in got.items()} == {"whole": None, "bare": None, "odd": None, "list": "shape", "cut": "json", "null": "json"}
    x = got["whole"]
    assert (x.schema_version, x.source_file, x.source_hash, x.duration_ms) == (2, "f", "h", 7)
    assert x.export.asDict() == J.EXPORT | {"crf": 20, "copyAllAudioTracks": True}
    assert [tuple(m) for m in x.markers] == [("a", 1, 2, "C", "n", "imported", 0.5, "rejected", ["x", "y"])]
    assert (got["bare"].schema_version, got["bare"].duration_ms, got["bare"].markers) == (1, 0, []) and got["bare"].export.asDict() == J.EXPORT
    assert [(m.category, m.source, m.status, m.confidence, len(m.authors)) for m in got["odd"].markers] == [("Manual", "manual", "confirmed", 1.0, 0), ("Manual", "manual", "confirmed", 1.0, 50)]
    assert got["odd"].duration_ms == 0 and got["cut"].markers is None


def documents(spark, rows):
    projects = spark.createDataFrame([(n, "h", 5) for n in rows], "name string, source_hash string, duration_ms long")
    markers = spark.createDataFrame([(n, k, s, s + 1, "C", "", "manual", 1.0, "pending") for n, starts in rows.items() for k, s in enumerate(starts)], "name string, id int, start_ms long, end_ms long, category string, note string, source string, confidence double, status string")
    return J.as_documents(projects, markers)


def test_the_first_whole_place_counts(spark):
    raw = {x["name"]: x.raw for x in documents(spark, {"a": [3, 1], "b": []}).collect()}
    assert [m["startMs"] for m in json.loads(raw["a"])["markers"]] == [1, 3] and json.loads(raw["b"])["markers"] == []
    at = {p: spark.range(1).select(J.places(F.lit(p), "/x/").alias("p")).first().p for p in "abcde"}
    docs = [(at["a"].beside, raw["a"]), (at["a"].aside, raw["b"]), (at["b"].beside, "{"), (at["b"].aside, raw["b"]), (at["c"].beside, "{"), (at["c"].aside, "[]"), (at["d"].aside, raw["a"])]
    films = spark.createDataFrame([(p,) for p in "abcde"], "path string")
    got = {x.path: (x.place, x.error, x.markers and len(x.markers)) for x in J.projects_of(films, spark.createDataFrame(docs, "place string, raw string"), "/x").collect()}
    assert got == {"a": ("beside", None, 2), "b": ("aside", None, []), "c": (None, "json", None), "d": ("aside", None, 2), "e": (None, None, None)}


def test_store_of_projects(spark, tmp_path):
    (tmp_path / "blocked").write_text("a file, so that no folder can be made")
    store = J.ProjectStore(spark, str(tmp_path / "blocked" / "no"), str(tmp_path / "second"))
    assert store.read().count() == 0
    first = documents(spark, {f"film {k}": [k] for k in range(20)}).withColumn("arrival", F.lit(1))
    assert store.put(first)[1] is True
    store.put(documents(spark, {"film 3": [1, 2, 3], "new": []}).withColumn("arrival", F.lit(2)).unionByName(first.where("name = 'film 3'")))
    got = {x["name"]: len(x.markers) for x in store.read().collect()}
    assert got == {f"film {k}": 3 if k == 3 else 1 for k in range(20)} | {"new": 0}
    some = store.read(["film 3", "missing"])
    assert [x["name"] for x in some.collect()] == ["film 3"]
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", some._jdf.queryExecution().toString())
    assert store.read([]).count() == 0


def plain_inbound(lines, authors=1000, per=50):
    held, total = {}, 0
    for line in lines:
        if len(held) >= authors or total >= authors * per:
            break
        try:
            x = json.loads(line)
            if not x.get("peer_key") or not isinstance(x.get("entries"), list):
                continue
            got = {}
            for e in x["entries"]:
                if len(got) >= per:
                    break
                if not isinstance(e, dict):
                    continue
                target, score = e.get("target", ""), e.get("score", 0.0)
                if not isinstance(target, str) or not isinstance(score, int | float):
                    raise ValueError
                if target:
                    got[target] = float(score)
        except ValueError:
            continue
        if got:
            total += len(got)
            held[x["peer_key"]] = got
    return {(a, t, s) for a, got in held.items() for t, s in got.items()}


@pytest.mark.parametrize(("n", "peers", "most"), [(300, 40, 70), (3000, 2500, 3), (1500, 20, 60)])
def test_inbound_endorsements(spark, n, peers, most):
    r, lines = random.Random(n), []
    for _ in range(n):
        entries = [r.choice([{"target": f"t{r.randrange(60)}", "score": r.randrange(9) / 4}] * 12 + [{"target": "x"}, {"target": ""}, 7, {"score": 1}]) for _ in range(r.randrange(most + 1))]
        line = json.dumps({"peer_key": f"p{r.randrange(peers)}", "entries": entries + r.choice([[]] * 9 + [[{"target": 5}]])})
        lines.append(r.choice([line] * 9 + [line[:-2], "", '{"entries": []}', '{"peer_key": "p", "entries": {}}']))
    got = J.inbound(spark.createDataFrame(list(enumerate(lines)), "ord int, value string"))
    assert {tuple(x) for x in got.collect()} == plain_inbound(lines)


def test_repository_report(spark):
    rows = [("a", False, True, True), ("a", False, False, True), ("b", False, None, False), ("b", True, False, False), (None, True, None, None), ("c", True, True, True)]
    got = {x.film_id: tuple(x)[1:] for x in K.repository_report(spark.createDataFrame(rows, "film_id string, malformed boolean, signed boolean, allowed boolean")).collect()}
    assert got == {None: (6, 3, 2, 1, 2), "a": (2, 0, 1, 0, 1), "b": (1, 0, 1, 1, 1)}


def test_concat_lists(spark):
    plan = [(1, "original", 1500, 4000), (1, "rendered", 0, 1500), (1, "original", 5000, 5000), (2, "original", 0, 10), (3, "original", 0, 10)]
    media = [(1, "it's.mkv"), (2, "/a.mkv"), (3, ""), (4, "d.mkv")]
    got = {x.film_id: (x.script, x.error) for x in X.concat_scripts(spark.createDataFrame(plan, "film_id int, kind string, start_ms long, end_ms long"), spark.createDataFrame(media, "film_id int, name string")).collect()}
    head = "ffconcat version 1.0\n"
    assert got == {1: (head + "file '0-1500.ts'\nduration 1.5\nfile 'it'\\''s.mkv'\ninpoint 1.5\noutpoint 4\nduration 2.5\n", None), 2: (None, "name"), 3: (None, "name"), 4: (head, None)}
    seconds = spark.createDataFrame([(x,) for x in (0, 10, 1000, 10_000, 1_234_567, 100_050)], "ms long").select(X.seconds(F.col("ms")).alias("s"))
    assert [x.s for x in seconds.collect()] == ["0", "0.01", "1", "10", "1234.567", "100.05"]
