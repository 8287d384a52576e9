"""Registered queries on untrusted rows, packs and endorsements, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import admission as M
from ..operators import packs as P
from ..session import table
from ..sources import adapters as A
from ..sources.adapters import with_

#: Caps of the query, small enough that the tables reach each of them.
LIMITS = M.Limits(total_bytes=900_000, peer_day_rows=12, proposed_bytes=150_000, proposed_categories=7, category_samples=6)
SENDS = 4
#: What is done to a line, by seq % 31; all others are as they should be.
FAULTS = {0: "size", 1: "json", 2: "json", 3: "json", 4: "json", 5: "schema", 6: "category_length", 7: "category", 8: "score", 9: "dimension", 10: "value", 11: "norm"}


def _lines(s, d):
    """Each vector, eight times over at unit length, sent SENDS times by different peers, as the rows that peers send; some are broken."""
    e = table(s, d, "embeddings").select("vec_id", "embedding", "label", F.explode(F.sequence(F.lit(0), F.lit(SENDS - 1))).alias("k"))
    e = e.withColumn("seq", (F.col("k") * 1_000_000 + F.col("vec_id")).cast("long")).withColumn("fault", F.col("seq") % 31)
    q = F.expr("transform(embedding, x -> format_string('%.4f', round(cast(x as double) * 10000 / sqrt(8.0D) * CASE fault WHEN 11 THEN 0.5D ELSE 1.0D END) / 10000.0D + 0.0D))")
    vec = F.array_join(F.expr("CASE fault WHEN 9 THEN slice(v, 1, 448) ELSE v END"), ",")
    e = e.withColumn("v", F.flatten(F.array_repeat(q, 8))).withColumn("v", F.expr("CASE fault WHEN 10 THEN concat(array('2.0'), slice(v, 2, 511)) ELSE v END"))
    category = F.expr("CASE fault WHEN 6 THEN repeat('c', 65) WHEN 7 THEN '<b>' ELSE CASE WHEN vec_id % 3 = 0 THEN concat('Proposal ', cast(vec_id % 11 as string)) WHEN vec_id % 3 = 1 THEN 'Cruelty' ELSE 'Kill / threat' END END")
    score = F.expr("CASE fault WHEN 8 THEN '1.5' ELSE concat('0.', cast(vec_id % 10 as string)) END")
    decision = F.expr("CASE fault WHEN 3 THEN 'maybe' WHEN 4 THEN 'accept\",\"more\":\"x' ELSE CASE WHEN label % 2 = 0 THEN 'reject' ELSE 'accept' END END")
    line = F.concat(F.lit('{"schema":'), F.expr("CASE fault WHEN 5 THEN '2' ELSE '1' END"), F.lit(',"category":"'), category, F.lit('","decision":"'), decision, F.lit('"'), F.when(F.col("fault") == 2, "").otherwise(F.concat(F.lit(',"score":'), score)), F.lit(',"vec":['), vec, F.lit("]}"))
    line = F.when(F.col("fault") == 0, F.repeat(F.lit("x"), F.lit(M.ROW_BYTES + 1))).when(F.col("fault") == 1, "not json").otherwise(line)
    return e.select("seq", F.concat(F.lit("p"), ((F.col("vec_id") * 7 + F.col("k") * 3) % 11).cast("string")).alias("peer"), (F.lit(20250101) + F.col("vec_id") % 2).cast("int").alias("day"), line.alias("line"))


def _judged(s, d):
    return M.judged(_lines(s, d), s.createDataFrame([], "name string"))


def verdicts(s, d):
    return _judged(s, d).select("seq", "verdict", F.sha2(F.coalesce("stored", F.lit("")), 256).alias("stored_sha256"))


def admitted(s, d):
    from ..session import written

    return M.admit(written(_judged(s, d).drop("line", "stored"), "judged"), LIMITS)


def accept_stats(s, d):
    return admitted(s, d).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def registered_counts(s, d):
    """What is registered of each peer's day and of each proposed category, with its bytes."""
    from ..session import written

    judged = written(_judged(s, d).drop("line", "stored"), "judged")
    rows = judged.join(M.admit(judged, LIMITS).where("outcome IN ('accepted', 'proposed')").select("seq", "outcome"), "seq")
    days = rows.where("outcome = 'accepted'").groupBy(F.concat_ws("/", "peer", F.col("day").cast("string")).alias("slot"))
    categories = rows.where("outcome = 'proposed'").groupBy(F.col("category").alias("slot"))
    return days.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).unionByName(categories.agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")))


#: The lines for DuckDB, and what their rules give.
_LINES = f"""sent AS (SELECT *, k * 1000000 + vec_id AS seq, (k * 1000000 + vec_id) % 31 AS fault FROM embeddings, (SELECT unnest(range({SENDS})) AS k)),
  v AS (SELECT *, list_transform(embedding, lambda x: printf('%.4f', round(CAST(x AS DOUBLE) * 10000 / sqrt(8.0::DOUBLE) * CASE fault WHEN 11 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) / 10000.0::DOUBLE + 0.0::DOUBLE)) AS q FROM sent),
  judged AS (SELECT seq, vec_id, fault, 'p' || ((vec_id * 7 + k * 3) % 11) AS peer, 20250101 + vec_id % 2 AS day, vec_id % 3 > 0 AS known,
    CASE WHEN vec_id % 3 = 0 THEN 'Proposal ' || (vec_id % 11) WHEN vec_id % 3 = 1 THEN 'Cruelty' ELSE 'Kill / threat' END AS category, CASE WHEN label % 2 = 0 THEN 'reject' ELSE 'accept' END AS decision,
    list_concat(q, q, q, q, q, q, q, q) AS q,
    CASE fault {" ".join(f"WHEN {k} THEN '{x}'" for k, x in FAULTS.items())} ELSE 'ok' END AS verdict FROM v),
  digests AS (SELECT *, sha256(unhex(array_to_string(list_transform(q, lambda x: printf('%02x%02x%02x%02x', u(x) % 256, u(x) // 256 % 256, u(x) // 65536 % 256, u(x) // 16777216)), ''))) AS digest FROM judged),
  lines AS (SELECT seq, peer, day, category, known, verdict, digest, '{{"peer_key":"' || peer || '","fingerprint":"' || digest || '","day_utc":' || day || ',"schema":1,"category":"' || category || '","decision":"' || decision || '","score":0.' || (vec_id % 10) || ',"vec":[' || array_to_string(q, ',') || ']}}' AS stored FROM digests)""".replace("u(x)", "((CAST(round(CAST(x AS FLOAT) * CAST(10000 AS FLOAT)) AS BIGINT) + 4294967296) % 4294967296)")

#: Row after row, with what is registered as lists: the rule itself, not how the operator finds it.
_FOLD = f"""valid AS MATERIALIZED (SELECT row_number() OVER (ORDER BY seq) AS i, seq, digest, peer || '/' || day AS slot, category, known, strlen(stored) + 1 AS size FROM lines WHERE verdict = 'ok'),
  fold AS (
    SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS outcome, CAST([] AS VARCHAR[]) AS digests, CAST([] AS VARCHAR[]) AS slots, CAST([] AS VARCHAR[]) AS samples, CAST(0 AS BIGINT) AS held, CAST(0 AS BIGINT) AS proposed
    UNION ALL
    SELECT i, seq, outcome, CASE WHEN outcome IN ('accepted', 'proposed') THEN list_append(digests, digest) ELSE digests END, CASE WHEN outcome = 'accepted' THEN list_append(slots, slot) ELSE slots END,
      CASE WHEN outcome = 'proposed' THEN list_append(samples, category) ELSE samples END, held + CASE WHEN outcome = 'accepted' THEN size ELSE 0 END, proposed + CASE WHEN outcome = 'proposed' THEN size ELSE 0 END
    FROM (SELECT v.*, f.digests, f.slots, f.samples, f.held, f.proposed,
      CASE WHEN list_contains(f.digests, v.digest) THEN 'deduped' WHEN len(list_filter(f.slots, lambda x: x = v.slot)) >= {LIMITS.peer_day_rows} THEN 'rate_limited'
        WHEN v.known THEN CASE WHEN f.held + v.size > {LIMITS.total_bytes} THEN 'over_cap' ELSE 'accepted' END
        WHEN len(list_filter(f.samples, lambda x: x = v.category)) >= {LIMITS.category_samples} OR (NOT list_contains(f.samples, v.category) AND len(list_distinct(f.samples)) >= {LIMITS.proposed_categories}) OR f.proposed + v.size > {LIMITS.proposed_bytes} THEN 'proposed_dropped' ELSE 'proposed' END AS outcome
      FROM fold f JOIN valid v ON v.i = f.i + 1)),
  outcomes AS (SELECT l.seq, l.peer, l.day, coalesce(f.outcome, 'bad_format') AS outcome FROM lines l LEFT JOIN (SELECT seq, outcome FROM fold) f ON f.seq = l.seq)"""

#: What is done to a film's pack, by film_id % 29.
PACK_FAULTS = {0: "size", 1: "json", 2: "schema", 3: "film_id", 4: "author", 5: "fingerprint_kind", 6: "duration", 7: "times_empty", 8: "times_order", 9: "times_range", 10: "exclusive", 12: "peaks_empty", 13: "phash", 14: "exclusive", 15: "range", 16: "cut_category", 17: "cut_score", 18: "reason", 19: "comment", 20: "json", 21: "json", 22: "cuts", 23: "peak_time", 24: "json"}


def _packs(s, d):
    """A pack a customer, its orders as cuts; some are broken."""
    m = A.markers(s, d).withColumn("fault", F.col("film_id") % 29)
    m = m.join(table(s, d, "orders").select(F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") / 400_000, 4).alias("price")), "id")
    cut = F.struct(
        F.col("start_ms"),
        F.expr("CASE fault WHEN 15 THEN start_ms ELSE end_ms END").alias("end_ms"),
        F.expr("CASE fault WHEN 16 THEN '<b>' ELSE category END").alias("category"),
        F.expr("CASE WHEN fault = 21 THEN 'maybe' WHEN id % 3 = 0 THEN 'confirmed' WHEN id % 3 = 1 THEN 'suggested' END").alias("kind"),
        F.expr("CASE WHEN fault = 17 THEN 1.5D WHEN fault > 24 THEN price ELSE 0.5D END").alias("score"),
        F.expr("CASE WHEN fault = 18 THEN repeat('é', 513) WHEN id % 5 = 0 AND fault <> 22 THEN repeat('é', 512) END").alias("reason"),
    )
    packs = m.groupBy("film_id", "fault").agg(F.array_sort(F.collect_list(cut)).alias("cuts"))
    packs = packs.withColumn("cuts", F.expr("CASE fault WHEN 22 THEN array_repeat(cuts[0], 501) ELSE cuts END"))
    times = F.expr("CASE WHEN fault IN (7, 11, 12, 13, 23) THEN cast(array() as array<bigint>) WHEN fault = 8 THEN array(0L, 2000L, 1000L) WHEN fault = 9 THEN array(0L, 61001L) ELSE array(0L, 1000L, 1000L, 61000L) END")
    peaks = F.expr("CASE WHEN fault IN (10, 11, 14) THEN array(named_struct('t_ms', 61000L, 'phash', ''), named_struct('t_ms', 5L, 'phash', '0123456789abCDEF')) WHEN fault = 13 THEN array(named_struct('t_ms', 1L, 'phash', '0123')) WHEN fault = 23 THEN array(named_struct('t_ms', -1L, 'phash', '')) ELSE cast(array() as array<struct<t_ms:bigint,phash:string>>) END")
    kind = F.expr("CASE WHEN fault = 5 THEN 'other' WHEN fault IN (11, 12, 13, 14, 23) THEN 'audio_peak_gaps' ELSE 'keyframes' END")
    fp = F.struct(F.lit(1).alias("version"), kind.alias("type"), F.expr("CASE fault WHEN 6 THEN 0L ELSE 60000L END").alias("durationMs"), F.lit(1).alias("approxDurationMin"), times.alias("keyframeTimesMs"), peaks.alias("peaks"))
    pack = F.struct(
        F.expr("CASE fault WHEN 2 THEN 2 ELSE 1 END").alias("schema"),
        F.expr("concat(CASE fault WHEN 3 THEN '../' ELSE 'film_' END, cast(film_id % 40 as string))").alias("film_id"),
        fp.alias("fingerprint"),
        F.expr("CASE fault WHEN 4 THEN 'abc' ELSE sha2(cast(film_id % 7 as string), 256) END").alias("author_pubkey"),
        (F.lit(1_700_000_000) + F.col("film_id")).alias("created_utc"),
        "cuts",
        F.expr("CASE fault WHEN 0 THEN repeat('c', 140000) WHEN 19 THEN repeat('é', 4097) ELSE repeat('é', 4096) END").alias("comment"),
    )
    raw = F.to_json(pack)
    raw = F.when(F.col("fault") == 1, F.replace(raw, F.lit('"version"'), F.lit('"more":1,"version"'))).when(F.col("fault") == 20, F.replace(raw, F.lit('"start_ms"'), F.lit('"more":1,"start_ms"'))).when(F.col("fault") == 24, F.replace(raw, F.lit('"cuts"'), F.lit('"cutz"'))).otherwise(raw)
    return packs.select("film_id", raw.alias("raw"))


def pack_errors(s, d):
    return P.pack_rules(_packs(s, d)).select("film_id", "verdict")


def fingerprint_errors(s, d):
    """Keyframes of films as fingerprints: of some the times are turned round, moved, or longer than the film."""
    t = A.keyframes(s, d).groupBy("film_id").agg(F.array_sort(F.collect_list("t_ms")).alias("times"))
    t = t.withColumn("times", F.expr("CASE film_id % 6 WHEN 0 THEN reverse(times) WHEN 1 THEN transform(times, x -> x - 5) WHEN 2 THEN concat(times, array(array_max(times) + 2002)) ELSE times END"))
    fp = F.struct(F.expr("CASE film_id % 6 WHEN 3 THEN 'audio_peak_gaps' ELSE 'keyframes' END").alias("type"), F.expr("CASE film_id % 6 WHEN 2 THEN array_max(times) - 1001 WHEN 4 THEN 0 ELSE array_max(times) + 1 END").alias("durationMs"), F.col("times").alias("keyframeTimesMs"), F.expr(f"cast(array() as array<{P.PEAK}>)").alias("peaks"), F.expr("cast(array() as array<bigint>)").alias("gapsMs"))
    return t.withColumn("fp", fp).select("film_id", F.coalesce(P.fingerprint_error(F.col("fp")), F.lit("ok")).alias("verdict"))


ENDORSEMENT_FAULTS = {0: "size", 1: "json", 2: "schema", 3: "kind", 4: "day", 5: "day", 6: "count", 7: "target", 9: "score", 10: "twice", 11: "json", 12: "json"}


def endorsement_checks(s, d):
    """The endorsements of each author as one batch of JSON; some are broken."""
    e = A.endorsements(s, d).withColumn("fault", F.col("author") % 17)
    entry = F.struct(F.expr("CASE fault WHEN 7 THEN upper(sha2(cast(target as string), 256)) ELSE sha2(cast(target as string), 256) END").alias("target"), F.expr("CASE fault WHEN 9 THEN 2.5D ELSE score END").alias("score"))
    e = e.groupBy("author", "fault").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    e = e.withColumn("entries", F.expr("CASE fault WHEN 6 THEN array_repeat(entries[0], 51) WHEN 10 THEN concat(entries, slice(entries, 1, 1)) ELSE entries END"))
    batch = F.struct(F.expr("CASE fault WHEN 2 THEN 2 ELSE 1 END").alias("schema"), F.expr("CASE fault WHEN 3 THEN 'other' ELSE 'endorsements' END").alias("kind"), F.expr("CASE fault WHEN 4 THEN 20231231 WHEN 5 THEN 22000102 WHEN 13 THEN 22000101 ELSE 20240101 END").alias("day_utc"), "entries")
    raw = F.to_json(batch)
    raw = F.when(F.col("fault") == 0, F.concat(raw, F.repeat(F.lit(" "), F.lit(M.BATCH_BYTES)))).when(F.col("fault") == 1, F.replace(raw, F.lit('"kind"'), F.lit('"kinds"'))).when(F.col("fault") == 11, F.replace(raw, F.lit('"score"'), F.lit('"more":1,"score"'))).when(F.col("fault") == 12, F.replace(raw, F.lit('"schema":1'), F.lit('"schema":"x"'))).otherwise(raw)
    return e.select("author", raw.alias("line")).select("author", M.endorsement_error("line").alias("verdict"))


def queries():
    return {
        "p9_row_verdicts": verdicts,
        "a9_admission": admitted,
        "a9_accept_stats": accept_stats,
        "a19_registered_counts": registered_counts,
        "p11_pack_errors": pack_errors,
        "p12_fingerprint_errors": fingerprint_errors,
        "p13_endorsement_checks": endorsement_checks,
    }


def _case(of: str, faults: dict[int, str], otherwise: str = "'ok'") -> str:
    return f"CASE {of} " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in faults.items()) + f" ELSE {otherwise} END"


def oracle_sql():
    priced = "max(CASE WHEN round(o_totalprice / 400000, 4) > 1 THEN 1 ELSE 0 END)"
    return {
        "p9_row_verdicts": f"WITH {_LINES} SELECT seq, verdict, sha256(CASE WHEN verdict = 'ok' THEN stored ELSE '' END) AS stored_sha256 FROM lines",
        "a9_admission": f"WITH RECURSIVE {_LINES}, {_FOLD} SELECT seq, peer, CAST(day AS INTEGER) AS day, outcome FROM outcomes",
        "a9_accept_stats": f"WITH RECURSIVE {_LINES}, {_FOLD} SELECT outcome, count(*) AS n FROM outcomes GROUP BY ALL",
        "a19_registered_counts": f"WITH RECURSIVE {_LINES}, {_FOLD} SELECT CASE WHEN f.outcome = 'accepted' THEN slot ELSE category END AS slot, count(*) AS n, CAST(sum(size) AS BIGINT) AS bytes FROM fold f JOIN valid v ON v.seq = f.seq WHERE f.outcome IN ('accepted', 'proposed') GROUP BY ALL",
        "p11_pack_errors": f"SELECT o_custkey AS film_id, {_case('o_custkey % 29', PACK_FAULTS, f'''CASE WHEN o_custkey % 29 > 24 AND {priced} > 0 THEN 'cut_score' ELSE 'ok' END''')} AS verdict FROM orders GROUP BY o_custkey",
        "p12_fingerprint_errors": with_("keyframes") + " SELECT film_id, CASE film_id % 6 WHEN 0 THEN CASE WHEN count(*) > 1 THEN 'times_order' ELSE 'ok' END WHEN 1 THEN 'times_range' WHEN 2 THEN 'times_range' WHEN 3 THEN 'peaks_empty' WHEN 4 THEN 'duration' ELSE 'ok' END AS verdict FROM keyframes GROUP BY film_id",
        "p13_endorsement_checks": with_("endorsements") + f" SELECT author, {_case('author % 17', ENDORSEMENT_FAULTS, '''CASE WHEN max(score) > 2 THEN 'score' ELSE 'ok' END''')} AS verdict FROM endorsements GROUP BY author",
    }
