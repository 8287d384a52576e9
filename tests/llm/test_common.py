"""Scratch tables: where they lie, when they go, and that two threads do not take each other's."""

import threading
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom import session
from spanloom.llm import common


def test_scopes_of_two_threads_are_apart(spark):
    left, entered, done = {}, threading.Barrier(2), threading.Barrier(2)

    def work(name):
        with common.scratch_scope(spark):
            entered.wait()
            df = common.stored(spark.range(3), name)
            done.wait()
            if name == "b":
                threading.Event().wait(0.5)
            left[name] = df.count()

    threads = [threading.Thread(target=work, args=(n,)) for n in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert left == {"a": 3, "b": 3}


def test_a_session_without_a_folder_gets_one_and_its_tables_go(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf, sparkContext = Conf(), spark.sparkContext

    folder = common.shared_dir(Session())
    assert folder and folder == common.shared_dir(Session()) and Path(folder).is_dir()
    monkeypatch.setattr(common, "shared_dir", lambda _: folder)
    with common.scratch_scope(spark):
        kept = common.stored(spark.range(5), "kept", keep=True)
        common.stored(spark.range(5), "gone")
    names = {p.parent.name for p in Path(folder).rglob("*.parquet")}
    assert names == {"kept"} and kept.count() == 5


@pytest.mark.parametrize("limit", [common.small_arrow_batches, session.small_arrow_batches])
def test_batches_hold_about_the_limit_unless_the_session_has_its_own(spark, limit):
    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([batch.nbytes])], names=["bytes"])

    with common.settings(spark, {common.BATCH_LIMIT: "1m"}):
        limit(spark)
        assert spark.conf.get(common.BATCH_LIMIT) == "1m"
        spark.conf.unset(common.BATCH_LIMIT)
        limit(spark)
        rows = spark.range(0, 200, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
        got = [r["bytes"] for r in rows.mapInArrow(sizes, "bytes long").collect()]
        assert sum(got) >= 20_000_000 and max(got) <= 1.5 * common.BATCH_BYTES
