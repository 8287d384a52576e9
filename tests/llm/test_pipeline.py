"""The corpus pipeline, stage by stage, against plain versions of its stages."""

import corpus_pipeline
from spanloom.llm.common import stored
from tests.llm.test_exact_dedup import SPACE
from tests.llm.test_ngram_join import brute
from tests.llm.test_packing import check

DIR = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, seen = docs.columns, {"start": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, DIR), "stage")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
    start, language, exact, near = ({r["doc_id"]: r["text"] for r in seen[k].collect()} for k in ("start", "language", "exact", "near"))
    assert {k for k, t in start.items() if any(c.isalpha() for c in t or "")} >= set(language)
    assert len(language) >= 0.95 * len(start)
    groups = {}
    for k, t in language.items():
        groups.setdefault(t.translate(SPACE), []).append((-len(t), k))
    assert set(exact) == {min(g)[1] for g in groups.values()}
    assert set(near) == {component for _, _, component in brute(sorted(exact.items()))}
    mixture = seen["mixture"].collect()
    assert {r["doc_id"] for r in mixture} <= set(near) and len(mixture) > 0.5 * len(near)
    packed = seen["packing"].collect()
    check(packed, near)
    assert sum(r["piece"] == 0 for r in packed) == len(mixture)


def test_empty_table(spark):
    none = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, DIR)
    assert none.count() == 0
