"""Subtitle names, discovery, class maps, the store of decisions, leaks and hits on hand-made files."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.functions.language import CODES, NAMES, subtitle_tags
from spanloom.operators import sidecars as B


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("Movie.en.srt", ("eng", "English")),
        ("Movie.en.forced.srt", ("eng", "English (forced)")),
        ("Movie.forced.EN.sdh.srt", ("eng", "English (forced sdh)")),
        ("Movie.chi.ass", ("chi", "Chinese")),
        ("Movie.xx.srt", ("xx", "")),
        ("Movie.en.fr.srt", ("eng", "English (fr)")),
        ("Movie..de..cc.vtt", ("deu", "German (cc)")),
        ("Movie.commentary.srt", ("", "commentary")),
        ("Movie.2.srt", ("", "2")),
        ("Movie.srt", ("srt", "")),
        ("Movie 2.en.srt", ("eng", "English ( 2)")),
        ("other.en.srt", ("eng", "English (other)")),
        ("Movie.été.srt", ("été", "")),
        ("Movie", ("", "")),
    ],
)
def test_tags_of_subtitle_names(spark, name, want):
    x = spark.createDataFrame([("Movie", name)], "stem string, name string").select(subtitle_tags(F.col("stem"), F.col("name")).alias("t")).first().t
    assert (x.language, x.title) == want


def test_maps_are_whole():
    assert len(CODES) == 44 and set(CODES.values()) < set(NAMES) and set(NAMES) - set(CODES.values()) == {"chi"}


def test_subtitle_files_beside_films(spark, tmp_path):
    for folder, names in {"a": ["Film.mkv", "Film.srt", "film.en.SRT", "Film 2.de.vtt", "Film.txt", "Other.ass", "x.(y).srt"], "b": ["Film.fr.ass"]}.items():
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / n).write_text("x")
    files = B.listed(spark, str(tmp_path))
    folder = {x.folder.rsplit("/", 1)[-1]: x.folder for x in files.select("folder").distinct().collect()}
    films = spark.createDataFrame([(1, folder["a"], "Film"), (2, folder["a"], "Film 2"), (3, folder["b"], "Film"), (4, folder["b"], "None"), (5, folder["a"], None), (6, folder["a"], "x.(y)")], "film_id int, folder string, stem string")
    got = sorted((x.film_id, x.nth, x.name, x.language) for x in B.subtitle_files(films, files).collect())
    assert got == [(1, 0, "Film 2.de.vtt", "deu"), (1, 1, "Film.srt", "srt"), (1, 2, "film.en.SRT", "eng"), (2, 0, "Film 2.de.vtt", "deu"), (3, 0, "Film.fr.ass", "fra"), (6, 0, "x.(y).srt", "srt")]


def test_class_map(spark, tmp_path):
    path = tmp_path / "map.csv"
    path.write_text('index,mid,display_name\n0,/m/1,Speech\n1,/m/2,"Shout, ""loud"""\n2,/m/3,  \n-1,/m/4,Never\nx,/m/5,Never\n,/m/6,Never\n7,/m/7,first\n7,/m/8, last \n')
    assert {x.idx: x["name"] for x in B.class_map(spark, str(path)).collect()} == {0: "Speech", 1: 'Shout, "loud"', 7: "last"}
    path.write_text("index,displayName\n3,Music\n")
    assert [tuple(x) for x in B.class_map(spark, str(path)).collect()] == [(3, "Music")]
    path.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="index"):
        B.class_map(spark, str(path))


def test_store_of_decisions(spark, tmp_path):
    store = str(tmp_path / "store")
    frames = spark.createDataFrame([(1, t, [t / 8, 1.0]) for t in range(0, 100, 10)] + [(1, 55, []), (1, 56, None), (2, 10, [1.0])], "film_id int, t_ms long, vec array<float>")
    markers = spark.createDataFrame([(1, 7, 10, 30, "A", "confirmed", 0.5), (1, 8, 50, 60, "B", "rejected", 0.25), (1, 9, 0, 99, "C", "pending", 1.0), (1, 6, 40, 40, "D", "confirmed", 1.0)], "film_id int, id int, start_ms long, end_ms long, category string, status string, confidence double")
    rows = B.recorded(frames, markers, 16)
    assert sorted((x.id, x.t_ms) for x in rows.collect()) == [(7, 10), (7, 20), (8, 50)]
    assert B.stored_lines(spark, store).count() == 0 and B.forget_all(spark, store)
    for _ in range(2):  # a batch that is tried again
        B.append_lines(B.as_lines(rows), store, "1")
    B.append_lines(spark.createDataFrame([("",), ("{}",), ('{"schema":1,"category":"A","decision":"maybe","score":1,"vec":[1]}',)], "value string"), store, "2")
    lines = B.stored_lines(spark, store)
    assert lines.count() == 6
    assert {"schema": 1, "category": "B", "decision": "reject", "score": 0.25, "vec": [6.25, 1.0]} in [json.loads(x.value) for x in lines.collect() if x.value]
    assert sorted((x.category, x.decision, x.score, x.vec[0]) for x in B.read_lines(lines).collect()) == [("A", "accept", 0.5, 1.25), ("A", "accept", 0.5, 2.5), ("B", "reject", 0.25, 6.25)]
    assert B.forget_all(spark, store) and B.stored_lines(spark, store).count() == 0


def test_leaks(spark):
    frames = spark.createDataFrame([(1, 0, "a"), (1, 10, "b"), (1, 20, "a"), (1, 30, "b"), (2, 10, "a"), (2, 20, "c")], "film_id int, t_ms long, phash string")
    cuts = spark.createDataFrame([(1, 5, 25), (1, 8, 12), (2, 0, 99)], "film_id int, start_ms long, end_ms long")
    assert sorted(map(tuple, B.leaked(frames, cuts, 8).collect())) == [(1, "a"), (1, "b")]


def test_hits(spark):
    markers = [(1, 1, 100, 300), (1, 2, 200, 400), (1, 3, 200, 201), (1, 4, 900, 5000), (2, 5, 0, 10)]
    got = {x.click_id: (x.id, x.part) for x in B.hits(spark.createDataFrame([(x, 1, x) for x in range(0, 1001)], "click_id int, film_id int, x int"), spark.createDataFrame(markers, "film_id int, id int, start_ms long, end_ms long"), 0, 1000, 1001).collect()}
    for x in range(1001):
        want = (None, None)
        for _, i, a, b in sorted((m for m in markers if m[0] == 1), key=lambda m: (m[2], m[3], m[1]), reverse=True):
            a, b = min(a, 1000), min(b, 1000)
            if abs(x - a) <= 5 or abs(x - b) <= 5 or a < x < b:
                want = (i, "start" if abs(x - a) <= 5 else "end" if abs(x - b) <= 5 else "body")
                break
        assert got[x] == want, x
