"""Canonical forms, the sieve, and scans."""

import pathlib

import pytest

from spanloom.llm.licenses import _MIT_BODY, canonical, form, known, scan, sieve

FOLDER = pathlib.Path("/usr/share/common-licenses")


def found(spark, texts, entries=None):
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, license string")
    return {(x.doc_id, x.license): (x.n_text, x.n_paragraphs, x.n_lines) for x in scan(docs, entries).collect()}


def test_forms_that_are_the_same(spark):
    mit = f"The MIT Licence (MIT)\n\nCopyright (c) 2020 Some One\n\n{_MIT_BODY.lower().replace(',', ' ,')}\n"
    got = found(
        spark,
        [
            "Released under the MIT License.",
            "prose before\n  * released UNDER the \"MIT\" licence!\nprose after",
            mit,
            "© 2001 Me\nLicensed under the Apache License, v2",
            "Released under the MIT License, or not.",
            None,
            "",
            " \n\n ",
            "Licensed under Creative Commons Attribution-Non-Commercial 4.0",
            "Copyright 2021 A. B. Inc. All rights reserved. Licensed under the Apache Licence, Version 2.0.",
            "x " * 300_000 + "\nReleased under the MIT License.",
        ],
    )
    assert got == {
        (0, "MIT"): (1, 1, 1),
        (1, "MIT"): (0, 0, 1),
        (2, "MIT"): (1, 3, 3),
        (3, "Apache-2.0"): (1, 1, 1),
        (8, "CC-BY-NC-4.0"): (1, 1, 1),
        (9, "Apache-2.0"): (1, 1, 1),
        (10, "MIT"): (0, 0, 1),
    }


def test_both_engines_make_the_same_form(spark):
    texts = [t for _, t in known()] + ["Licence licences LICENCE unlicenced sublicence", "favourable favour favours", "aİb K \n (c) x. This y\n© z", "v2 ver. 2.0 version 3 v 3.0.1 v2v", "", "..."]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string").select("k", canonical("text").alias("f")).collect()
    assert {r.k: r.f for r in rows} == {k: form(t) for k, t in enumerate(texts)}
    assert form(texts[-6]) == "license licenses license unlicensed sublicense"


def test_sieve_holds_back_nothing():
    words = sieve()
    assert len(words) < 12
    for _, text in known():
        for t in (text.lower(), text.lower().replace("license", "licence"), " ".join(text.lower().split())):
            assert any(w in t for w in words)


def test_whole_licences(spark):
    if not FOLDER.exists():
        pytest.skip("no licence texts here")
    files = {"GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "Apache-2.0": "Apache-2.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    texts = [(FOLDER / f).read_text().upper().replace("LICENSE", "LICENCE") for f in files]
    got = found(spark, texts + [texts[0][:-30]])
    assert {k: v for (k, name), (v, _, _) in got.items() if name == list(files.values())[min(k, 5)]} == {k: 1 for k in range(6)}


def test_odd_tables(spark):
    assert scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    docs = spark.createDataFrame([(None, "Own words here"), (7, "own words  HERE."), (7, "Own words here")], "doc_id long, text string")
    assert sorted(map(tuple, scan(docs, [("Own", "own words here")]).collect()), key=str) == [(7, "Own", 2, 2, 2), (None, "Own", 1, 1, 1)]
