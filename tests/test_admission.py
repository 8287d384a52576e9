"""Admission of untrusted rows, in batches and as streams, packs and their store, text functions."""

import hashlib
import json
import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import text as X
from spanloom.operators import admission as M
from spanloom.operators import packs as P
from spanloom.operators.vectors import quantised_digest, shape_error
from spanloom.streaming import admission as S


VEC = [0.0] * 511 + [1.0]


def row(category="Cruelty", score=0.5, vec=VEC, decision="accept", **more):
    return json.dumps({"schema": 1, "category": category, "decision": decision, "score": score, "vec": vec, **more})


def test_row_rules(spark):
    good = row()
    cases = {
        good: "ok", row("<b>"): "category", row("Сruelty"): "category", row("x" * 65): "category_length", row(""): "category", row("a\nb"): "category", row("x" * 64): "ok",
        row(score=1.5): "score", row(score=1): "ok", row(more=1): "json", "no": "json", "[]": "json", "y" * 20000: "size", good.replace("1,", "2,", 1): "schema",
        row(decision="maybe"): "json", row("<b>", decision="maybe"): "json", row(vec=[1.0, 0.0, 0.0]): "dimension", row(vec=[2.0] + VEC[1:]): "value", row(vec=[0.5] * 512): "norm",
        row(vec=VEC[:511] + [1.04]): "ok", row(vec=VEC[:511] + [1.06]): "norm", row(vec=VEC[:511] + [None]): "json", good.replace("]", ',"x"]'): "json", good.replace('"score": 0.5, ', ""): "json",
        good.replace("0.5", "NaN"): "json", good[:-1] + ', "score": 0.5}': "json", row(vec=[0.0] * 767 + [1.0]): "ok", row(score=None): "json",
    }
    df = M.parsed(spark.createDataFrame([(k,) for k in cases], "line string")).select("line", M.row_error().alias("v"))
    assert {r.line[:90] + r.line[-30:]: r.v for r in df.collect()} == {k[:90] + k[-30:]: v for k, v in cases.items()}
    assert spark.createDataFrame([(None,)], "line string").transform(M.parsed).select(M.row_error().alias("v")).first().v == "json"


def test_digest_is_of_the_rounded_vector(spark):
    v = [0.12345, -0.00005, 1.0, -1.5]
    df = spark.createDataFrame([(v,), ([0.123451, -0.00006, 1.0000001, -1.5],), ([0.1236, -0.00005, 1.0, -1.5],)], "vec array<float>").select(quantised_digest(F.col("vec")).alias("d"))
    a, b, c = (r.d for r in df.collect())
    assert a == b != c
    want = b"".join(int(np.copysign(np.floor(np.abs(np.float32(x) * np.float32(10000)) + np.float32(0.5)), x)).to_bytes(4, "little", signed=True) for x in v)
    assert a == hashlib.sha256(want).hexdigest()


SLIM = "seq long, peer string, day int, digest string, category string, known boolean, bytes long, verdict string"


def plain_outcomes(rows, limits, stored=()):
    """Each row tried in order of seq."""
    seen, counts, samples, held, proposed, out = set(), {}, {}, 0, 0, {}
    for fresh, r in [*((False, x) for x in stored), *((True, x) for x in sorted(rows))]:
        seq, peer, day, digest, category, known, size, verdict = r
        if fresh:
            if verdict != "ok":
                out[seq] = "bad_format"
            elif digest in seen:
                out[seq] = "deduped"
            elif counts.get((peer, day), 0) >= limits.peer_day_rows:
                out[seq] = "rate_limited"
            elif known:
                out[seq] = "over_cap" if held + size > limits.total_bytes else "accepted"
            else:
                had = samples.get(category, 0)
                drop = had >= limits.category_samples or (not had and len(samples) >= limits.proposed_categories) or proposed + size > limits.proposed_bytes
                out[seq] = "proposed_dropped" if drop else "proposed"
        if not fresh or out[seq] in ("accepted", "proposed"):
            seen.add(digest)
            if known:
                held += size
                counts[peer, day] = counts.get((peer, day), 0) + 1
            else:
                proposed += size
                samples[category] = samples.get(category, 0) + 1
    return out


def some_rows(r, n, first=0, digests=60):
    out = []
    for k in range(n):
        known = r.random() < 0.6
        out.append((first + k, r.choice("pqrs"), r.randrange(3), f"d{r.randrange(digests)}", r.choice(["A", "B"]) if known else f"new{r.randrange(6)}", known, r.choice([40, 50, 90]), r.choice(["ok"] * 5 + ["json"])))
    return out


def test_batch_admission_is_as_rows_in_order(spark):
    r = random.Random(4)
    chain = [(2 * k + j, f"p{k + j}", 1, f"d{k}", "A", True, 10, "ok") for k in range(40) for j in (0, 1)]
    hot = [(k, f"p{k % 3}", 1, "same" if k % 2 else f"d{k}", "A", True, 10, "ok") for k in range(300)]
    cases = [(chain, M.Limits(peer_day_rows=1)), (hot, M.Limits(peer_day_rows=4)), ([], M.Limits())]
    every = set()
    for limits in (M.Limits(peer_day_rows=2), M.Limits(2000, 9, 600, 3, 4), M.Limits(700, 5, 10_000, 10, 2), M.Limits(300, 200, 100, 100, 50), M.Limits(total_bytes=95, peer_day_rows=3)):
        cases.append((some_rows(r, 250), limits))
    for rows, limits in cases:
        got = {x.seq: x.outcome for x in M.admit(spark.createDataFrame(rows, SLIM), limits).collect()}
        assert got == plain_outcomes(rows, limits)
        every |= set(got.values())
    assert every == set(M.OUTCOMES)
    rows, limits = some_rows(r, 200), M.Limits(2000, 9, 600, 3, 4)
    first = plain_outcomes(rows, limits)
    stored = [x for x in rows if first[x[0]] in ("accepted", "proposed")]
    more = some_rows(r, 200, 1000, 90)
    got = {x.seq: x.outcome for x in M.admit(spark.createDataFrame(more, SLIM), limits, spark.createDataFrame(stored, SLIM)).collect()}
    assert got == plain_outcomes(more, limits, stored)


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def test_stream_admission_keeps_its_state(rocksdb, tmp_path):
    """Seven outcomes, a restart in the middle, and stored rows as the initial state."""
    spark, r, limits = rocksdb, random.Random(8), M.Limits(3000, 5, 900, 5, 5)
    rows = some_rows(r, 260, 0, 150)
    begin, parts = rows[:20], [rows[20:160], rows[160:]]
    first = plain_outcomes(begin, limits)
    stored = [x for x in begin if first[x[0]] in ("accepted", "proposed")]
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for part in parts:
        spark.createDataFrame(part, SLIM).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(SLIM).parquet(folder)
        S.run_available(S.admission(stream, limits, spark.createDataFrame(stored, SLIM)), out, check)
    got = {x.seq: x.outcome for x in spark.read.parquet(out).collect()}
    assert got == plain_outcomes(rows[20:], limits, stored)
    assert set(got.values()) == set(M.OUTCOMES)


def sent(k, peer, line):
    return json.dumps({"peer": peer, "day": 20250101, "seq": k, "row": line})


def unit(k):
    return [0.0] * k + [1.0] + [0.0] * (511 - k)


def test_fan_out_is_replayed_whole(spark, tmp_path):
    """A batch fails after its first store; the replay leaves no row twice. Then the checkpoint is lost; what is stored keeps its effect."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    names = spark.createDataFrame([("Mine",)], "name string")
    entry = {"target": "a" * 64, "score": 1.0}
    batch = json.dumps({"schema": 1, "kind": "endorsements", "day_utc": 20250101, "entries": [entry]}, separators=(",", ":"))
    lines = [sent(1, "a", row(vec=unit(1))), sent(2, "a", row(vec=unit(1), category="Chase")), sent(3, "a", row("Mine", vec=unit(2))), sent(4, "a", row(vec=unit(3))), sent(5, "b", row("New", vec=unit(3))), sent(6, "b", row(vec=[1.0])), sent(7, "b", batch), "no envelope", sent(8, "b", row("New", vec=unit(4))), sent(9, "b", batch.replace("1.0", "3.0"))]
    limits = M.Limits(peer_day_rows=2, category_samples=1)

    def send(part):
        spark.createDataFrame([(x,) for x in part], "value string").coalesce(1).write.mode("append").text(folder)

    def stop(store):
        raise OSError("disk full")

    send(lines[:7])
    with pytest.raises(Exception, match="disk full"):
        S.fan_out(S.tail(spark, folder), out, str(tmp_path / "check"), names, limits, stop)
    S.fan_out(S.tail(spark, folder), out, str(tmp_path / "check"), names, limits)
    send(lines[7:])
    S.fan_out(S.tail(spark, folder), out, str(tmp_path / "check"), names, limits)

    def held(store, column="seq"):
        return sorted(x[column] for x in spark.read.parquet(f"{out}/{store}").collect())

    def refused(run):
        return {x.seq: x.outcome for x in spark.read.parquet(f"{out}/refused").where(F.col("run") == run).collect()}

    runs = [x.run for x in spark.read.parquet(f"{out}/refused").select("run").distinct().collect()]
    assert len(runs) == 1
    assert held("accepted") == [1, 3] and held("proposed") == [5] and held("envelopes", "sent") == ["no envelope"]
    assert refused(runs[0]) == {2: "deduped", 4: "rate_limited", 6: "bad_format", 8: "proposed_dropped"}
    assert sorted((x.seq, x.verdict) for x in spark.read.parquet(f"{out}/endorsements").collect()) == [(7, "ok"), (9, "score")]
    S.fan_out(S.tail(spark, folder), out, str(tmp_path / "other"), names, limits)
    assert held("accepted") == [1, 3] and held("proposed") == [5]
    new = [x.run for x in spark.read.parquet(f"{out}/refused").select("run").distinct().collect() if x.run not in runs]
    assert refused(new[0]) == {1: "deduped", 2: "deduped", 3: "deduped", 4: "deduped", 5: "deduped", 6: "bad_format", 8: "proposed_dropped"}
    back = {x.seq: x for x in S.stored_rows(spark, out).collect()}
    assert set(back) == {1, 3, 5} and back[1].bytes == len(back[1].stored.encode()) + 1
    kept = json.loads(back[3].stored)
    assert kept["vec"] == unit(2) and kept["category"] == "Mine" and kept["peer_key"] == "a" and kept["fingerprint"] == back[3].digest


def test_latest_batches(rocksdb, tmp_path):
    spark, schema = rocksdb, "peer string, day int, arrival long, line string"
    folder, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    parts = [[("a", 1, 1, "x" * 39), ("a", 1, 2, "y" * 59), ("b", 1, 3, "z" * 39)], [("a", 2, 4, "w" * 9), ("a", 1, 9, "v" * 19), ("b", 1, 10, "u" * 59)], [("a", 1, 8, "late"), ("b", 1, 11, "t" * 79), (None, 1, 12, "x")]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        S.run_available(S.latest_batches(spark.readStream.schema(schema).parquet(folder), 100), out, check)
    rows = spark.read.parquet(out)
    assert {x.arrival: x.outcome for x in rows.collect()} == {1: "stored", 2: "stored", 3: "stored", 4: "over_cap", 9: "stored", 10: "stored", 8: "late", 11: "stored"}
    assert sorted((x.peer, x.day, x.arrival) for x in S.newest_stored(rows).collect()) == [("a", 1, 9), ("b", 1, 11)]


def test_output_on_change(rocksdb, tmp_path):
    spark, schema = rocksdb, "file string, arrival long, content string"
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    line = json.dumps({"target": "t", "score": 0.5})

    def send(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(folder)

    send(("f", 1, line), ("g", 1, "no json\n[]\n{}"))
    stream = spark.readStream.schema(schema).parquet(folder)
    query = S.on_change(stream, 300, 3).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(processingTime="200 milliseconds").start()

    def sent_now(n):
        end = time.time() + 40
        while time.time() < end and query.isActive:
            got = sorted((x.file, x.arrival, len(x.entries)) for x in spark.read.schema("file string, arrival long, entries array<struct<target:string,score:double>>").parquet(out).collect()) if os.path.isdir(out) else []
            if len(got) >= n:
                return got
            time.sleep(0.3)
        raise AssertionError((got, query.exception()))

    try:
        assert sent_now(1) == [("f", 1, 1)]
        send(("f", 2, line))
        time.sleep(3)
        send(("f", 3, "\n".join([line] * 9)), ("g", 3, json.dumps({"target": "u", "score": "x"})))
        assert sent_now(3) == [("f", 1, 1), ("f", 3, 3), ("g", 3, 1)]
    finally:
        query.stop()


def test_endorsement_rules(spark):
    def batch(entries=(("a" * 64, 1.0),), **other):
        return json.dumps({"schema": 1, "kind": "endorsements", "day_utc": 20250101, "entries": [{"target": t, "score": x} for t, x in entries], **other})

    cases = {
        batch(): "ok", batch(()): "ok", batch(schema=2): "schema", batch(kind="x"): "kind", batch(day_utc=20231231): "day", batch(day_utc=22000101): "ok", batch(day_utc=22000102): "day",
        batch([(f"{k:064x}", 1) for k in range(51)]): "count", batch([("A" * 64, 1)]): "target", batch([("a" * 63, 1)]): "target", batch([("a" * 64, 2.5)]): "score", batch([("a" * 64, 2)]): "ok",
        batch([("a" * 64, 1), ("b" * 64, 1), ("a" * 64, 9)]): "score", batch([("a" * 64, 1), ("a" * 64, 1), ("b", 1)]): "twice", batch(more=1): "json", batch().replace('"score"', '"scores"'): "json",
        batch().replace("}]", ',"x":1}]'): "json", batch([("a" * 64, None)]): "json", "x": "json", batch() + " " * 9000: "size", batch().replace('"schema": 1, ', ""): "json",
    }
    got = spark.createDataFrame([(k,) for k in cases], "line string").select("line", M.endorsement_error("line").alias("v")).collect()
    assert {r.line: r.v for r in got} == cases


def pack(film="87", author="a" * 64, created=5, **other):
    fp = {"version": 1, "type": "keyframes", "durationMs": 60000, "approxDurationMin": 1, "keyframeTimesMs": [0, 1000, 1000, 61000]}
    return json.dumps({"schema": 1, "film_id": film, "fingerprint": fp, "author_pubkey": author, "created_utc": created, "cuts": [{"start_ms": 1, "end_ms": 2, "category": "Chase"}], **other})


def test_pack_rules_at_their_edges(spark):
    bad = pack()
    cases = {
        bad: "ok", pack(comment=None, sig=None): "ok", pack(comment="c" * 4096): "ok", pack(comment="c" * 4097): "comment", pack("x" * 33): "film_id", pack("../etc"): "film_id", pack(""): "film_id", pack(author="g" * 64): "author",
        pack(cuts=[]): "ok", pack(cuts=[{"start_ms": 1, "end_ms": 2, "category": "c" * 65}]): "cut_category", pack(cuts=[{"start_ms": 1, "end_ms": 2, "category": "c", "score": 1.0, "kind": None, "reason": "r" * 512}]): "ok",
        pack(cuts=[{"start_ms": 1, "end_ms": 2, "category": "c", "kind": "Confirmed"}]): "json", pack(cuts=[{"start_ms": 1, "end_ms": 2}]): "json", pack(cuts=[{"start_ms": "x", "end_ms": 2, "category": "c"}]): "json", pack(cuts=[{"start_ms": -1, "end_ms": 2, "category": "c"}]): "range",
        bad.replace("61000", "61001"): "times_range", bad.replace("[0, 1000", "[-1, 1000"): "times_range", bad.replace("[0, 1000", "[2000, 1000"): "times_order", bad.replace("60000", "0"): "duration", bad.replace('"version": 1, ', ""): "json",
        bad.replace('"keyframes"', '"peaks"'): "fingerprint_kind", bad.replace("[0, 1000, 1000, 61000]", "null"): "json", bad.replace("[0, 1000, 1000, 61000]", '[0], "gapsMs": [5]'): "exclusive", bad.replace(', "keyframeTimesMs": [0, 1000, 1000, 61000]', ""): "times_empty",
        bad.replace('"schema": 1', '"schema": 2'): "schema", pack(more=1): "json", "": "json",
    }
    got = P.pack_rules(spark.createDataFrame([(k,) for k in cases] + [(None,)], "raw string")).select("raw", "verdict").collect()
    assert {r.raw: r.verdict for r in got} == cases | {None: "json"}


def test_pack_store(spark, tmp_path):
    first, second = str(tmp_path / "first"), str(tmp_path / "second")
    store = P.PackStore(spark, first, second)
    put = lambda *rows: store.put(spark.createDataFrame(list(rows), "raw string, arrival long"))
    assert store.place() is None and store.read()[0].count() == 0
    assert put((pack(created=1), 1), (pack(created=2), 2), (pack("88"), 3), (pack("88", "b" * 64), 4), ("broken", 5))[1] is False
    assert sorted((x.bucket, x.author[0], x.created_utc) for x in store.read()[0].collect()) == [("87", "a", 2), ("88", "a", 5), ("88", "b", 5)]
    good, _ = store.read(["87"])
    plan = good._jdf.queryExecution().executedPlan().toString()
    part = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "bucket" in part and "87" in part
    assert [x.bucket for x in good.collect()] == ["87"]
    # A corrupt row, and one that lies in another film's folder, come out in their own channel.
    broken = spark.createDataFrame([("c" * 64, 1, "{", "88"), ("d" * 64, 1, pack("87", "d" * 64), "88")], P.STORED)
    broken.select("author", "created_utc", "raw").coalesce(1).write.mode("append").parquet(f"{first}/{store._current(first)}/bucket=88")
    good, bad = store.read(["88"])
    assert good.count() == 2 and sorted(x.verdict for x in bad.collect()) == ["json", "misplaced"]
    put((pack("89"), 1), (pack("87", created=9), 2))
    assert sorted((x.bucket, x.created_utc) for x in store.read()[0].collect()) == [("87", 9), ("88", 5), ("88", 5), ("89", 5)]
    assert store.read()[1].count() == 2
    # A write that fails leaves the old version, and goes to the second place.
    os.makedirs(tmp_path / "blocked")
    (tmp_path / "blocked" / "file").write_text("x")
    other = P.PackStore(spark, str(tmp_path / "blocked" / "file" / "no"), second)
    where, fell = other.put(spark.createDataFrame([(pack("90"), 1)], "raw string, arrival long"))
    assert fell and where.startswith(second) and [x.bucket for x in other.read()[0].collect()] == ["90"]
    nowhere = P.PackStore(spark, str(tmp_path / "blocked" / "file" / "no"), str(tmp_path / "blocked" / "file" / "neither"))
    with pytest.raises(Exception):
        nowhere.put(spark.createDataFrame([(pack("90"), 1)], "raw string, arrival long"))
    before = store.read()[0].count()
    failing = P.PackStore(spark, first)
    failing._point = lambda *a: (_ for _ in ()).throw(OSError("full"))
    with pytest.raises(OSError, match="full"):
        failing.put(spark.createDataFrame([(pack("91"), 1)], "raw string, arrival long"))
    assert store.read()[0].count() == before


def test_newest_lines(spark):
    df = spark.createDataFrame([("f", k, "x" * n) for k, n in enumerate([5, 50, 3, 4])], "file string, seq long, line string")
    assert sorted(r.seq for r in M.newest_within(df, 20).collect()) == [2, 3]


def test_srt(spark):
    text = "﻿1\r\n00:00:01.000 --> 00:00:02,500\r\nHello\r\nthere\r\n\r\nx\r\n00:00:05,5 --> 00:00:05,50\r\ngone\r\n\r\n00:00:07,000 --> 00:00:06,000\r\nback\r\n\r\nno time\r\n"
    got = X.parse_srt(spark.createDataFrame([(1, text)], "film_id long, srt string")).collect()
    assert [(r.start_ms, r.end_ms, r.text) for r in got] == [(1000, 2500, "Hello\nthere")]


def test_names_and_keywords(spark):
    df = spark.createDataFrame([("a.b/film.one.mkv", 7), ("plain", 0)], "p string, age int").select(X.output_name(F.col("p"), F.col("age")).alias("o"))
    assert [r.o for r in df.collect()] == ["a.b/film.one CENSORED-7.mkv", "plain CENSORED"]
    seg = spark.createDataFrame([(1, 0, 250, "The Cat's here"), (1, 300, 400, "scatter")], "film_id long, start_ms long, end_ms long, text string")
    got = sorted((r.keyword, r.idx) for r in X.keyword_ticks(seg, ["cat", "cat's", "the"], 100).collect())
    assert got == [("cat", 0), ("cat", 1), ("cat's", 0), ("cat's", 1), ("the", 0), ("the", 1)]


def test_missing_values_break_rules(spark):
    rows = spark.createDataFrame([(None, None, [0.1]), (0.5, "A", None)], "score double, category string, vec array<float>")
    assert [r.v for r in rows.select(shape_error(F.col("score"), F.col("vec"), F.col("category")).alias("v")).collect()] == ["category", "dimension"]


def test_gate(spark):
    packs = spark.createDataFrame([("a", True), ("b", True), ("a", False), ("a", None)], "author string, signed boolean")
    allow = spark.createDataFrame([("a",), (None,)], "author string")
    assert sorted(r.outcome for r in M.gate(packs, allow).collect()) == ["accepted", "forbidden", "unsigned", "unsigned"]
    assert sorted(r.outcome for r in M.gate(packs, allow.limit(0)).collect()) == ["accepted", "accepted", "unsigned", "unsigned"]


def test_parts_of_a_pack_are_read_once(spark):
    """However many rules name the keys of a pack's fingerprint, its text is searched for it once."""
    from spanloom.operators import packs as K

    plan = K.pack_rules(spark.createDataFrame([("{}",)], "raw string")).select("verdict")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object(raw") == 2 and plan.count("jsonObjectKeys(") == 2
