"""Registered queries on documents that may be broken, merged suggestions with reasons, and weighted feedback, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import intervals as I
from ..operators import results as R
from ..operators import series as S
from ..operators import vectors as V
from ..session import table
from ..sources import adapters as A
from ..sources.adapters import DUCK, FILM_TICKS, HOUR_MS, RECIPE_SCHEMA, RECIPES, with_
from . import scoring
from .community import _DIRECT, _DOT, TRIGGER, _prompts, weighted_feedback


def _recipes(s, d):
    """Recipes as documents: the parts of a brand as categories. Some are bare lists, some broken."""
    p = table(s, d, "part").withColumn("k", F.col("p_partkey") % 5)
    det = F.struct(F.concat(F.lit("det"), (F.col("p_size") % 3).cast("string")).alias("id"), F.lit(0.5).alias("weight"), F.struct(F.expr("CASE WHEN k = 1 THEN array(p_type, p_name) WHEN k = 2 THEN cast(array() as array<string>) END").alias("labels")).alias("params"))
    cat = F.struct("p_partkey", F.struct(F.col("p_name").alias("name"), F.expr("CASE k WHEN 3 THEN false WHEN 4 THEN true END").alias("enabled"), (F.col("p_size") / 64).alias("threshold"), F.col("p_size").cast("long").alias("padBeforeMs"), F.when(F.col("k") == 0, F.array(det, det)).when(F.col("k") < 4, F.array(det)).alias("detectors")).alias("c"))
    docs = p.groupBy("p_brand").agg(F.to_json(F.transform(F.array_sort(F.collect_list(cat)), lambda x: x["c"])).alias("list"), F.min("p_partkey").alias("n"))
    raw = F.expr("CASE n % 6 WHEN 0 THEN list WHEN 1 THEN concat('{\"version\":1,\"categories\":', list, '}') WHEN 2 THEN concat('{\"categories\":', list) WHEN 3 THEN concat('{\"cats\":', list, '}') WHEN 4 THEN '{\"categories\":{\"a\":1}}' ELSE concat(' {\"categories\":', list, '} ') END")
    return R.recipes(docs.select(F.col("p_brand").alias("name"), raw.alias("raw")))


def recipe_rows(s, d):
    return _recipes(s, d).drop("max_duration_ms", "pad_after_ms", "weight", "label_ord")


def result_documents(s, d):
    """Results of films as documents, their orders as suggestions: with too many keyframes, peaks or authors, values of other types, and broken ones."""
    m = A.markers(s, d)
    sugg = F.struct("id", F.to_json(F.struct(F.expr("CASE WHEN id % 7 = 0 THEN '' ELSE category END").alias("category"), F.col("start_ms").alias("startMs"), F.expr("CASE WHEN id % 5 = 0 THEN start_ms ELSE end_ms END").alias("endMs"), F.array(F.lit("one"), F.col("id").cast("string")).alias("reasons"), F.expr("transform(sequence(1, CASE WHEN id % 3 = 0 THEN 60 ELSE 2 END), x -> concat('a', x))").alias("contributingAuthors"))).alias("json"))
    films = m.groupBy("film_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(sugg)), lambda x: F.replace(x["json"], F.lit('"one",'), F.lit('"one",5,null,'))), ",").alias("s"))
    films = films.withColumn("k", F.col("film_id") % 9)
    times = F.expr("array_join(sequence(0, CASE k WHEN 1 THEN 20050 ELSE 40 END), ',')")
    peaks = F.expr("array_join(transform(sequence(1, CASE k WHEN 3 THEN 230 ELSE 7 END), x -> concat('{\"tMs\":', x, ',\"phash\":\"h', x, '\"}')), ',')")
    fp = F.concat(F.lit('{"type":"'), F.expr("CASE WHEN k IN (2, 3) THEN 'audio_peak_gaps' WHEN k = 4 THEN 'other' ELSE 'keyframes' END"), F.lit('","durationMs":5,"keyframeTimesMs":[2.5,"x",null,'), times, F.lit('],"peaks":["x",'), peaks, F.lit("]}"))
    doc = F.concat(F.lit('{"durationMs":'), F.when(F.col("k") == 5, F.lit('"long"')).otherwise(F.col("film_id").cast("string")), F.lit(',"fingerprint":'), fp, F.lit(',"suggestions":'), F.when(F.col("k") == 6, F.lit('"none"')).otherwise(F.concat(F.lit("[7,"), "s", F.lit("]"))), F.when(F.col("k") == 7, F.lit("")).otherwise(F.lit("}")))
    read = R.results(films.select(F.col("film_id").cast("string").alias("name"), F.when(F.col("k") == 8, F.lit("[1]")).otherwise(doc).alias("raw")))
    size = lambda c: F.size(c).cast("long")
    return read.select("name", "error", "schema_version", "duration_ms", "kind", size("keyframes").alias("n_keyframes"), F.array_max("keyframes").alias("last_keyframe"), size("peaks").alias("n_peaks"), size("suggestions").alias("n_suggestions"), F.array_join(F.array_sort(F.flatten(F.transform("suggestions", lambda x: x["reasons"]))), ",").alias("reasons"), F.coalesce(F.array_max(F.transform("suggestions", lambda x: size(x["authors"]))), F.lit(0).cast("long")).alias("most_authors"))


def loudness_log(s, d):
    """Events of a user as lines of a meter's log: some without a target, some of other programs, some with values that are no numbers."""
    e = table(s, d, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("seq"), F.format_string("%.1f", F.floor(F.col("value") * 10) / 10 - 120).alias("m"), (F.col("event_id") % 11).alias("k"))
    line = F.expr("CASE k WHEN 0 THEN concat('frame= ', seq) WHEN 1 THEN concat('t: ', seq, ' M: nan S:-inf') WHEN 2 THEN concat('[meter] t: ', seq, '.5   TARGET:-23 LUFS    M: -', m, '-  S: 1.2.3     I: -70.0') WHEN 3 THEN concat('t: ', seq, ' S: ', m, ' M: 1') ELSE concat('[Parsed] t: ', seq, '   TARGET:-23 LUFS    M:', m, ' S:-130.5     I: x') END")
    return R.loudness_log(e.select("file", "seq", line.alias("line")))


def _reasoned(s, d):
    found = scoring._runs(s, d)
    order = F.create_map(*(x for k, name in enumerate(dict.fromkeys(r[0] for r in RECIPES)) for x in (F.lit(name), F.lit(k))))
    return R.merged_reasons(found.withColumn("reasons", F.array(R.peak_reason(F.col("score")))).withColumn("arrival", F.element_at(order, F.col("category")) * 1_000_000 + F.expr(f"start_ms div {HOUR_MS}")), 2 * HOUR_MS)


def merged_reasons(s, d):
    """Suggestions with the reasons of their runs, and their place in the film."""
    return _reasoned(s, d).select("film_id", "category", "start_ms", "end_ms", "score", F.array_join("reasons", "|").alias("reasons"), "place")


def marker_order(s, d):
    """All markers in order, each new one before those of its start."""
    return R.in_order(A.markers(s, d).select("film_id", "id", "start_ms"), "id")


def weighted_scores(s, d):
    """Prompt scores of all frames, moved by the most similar decisions as far as their authors are trusted."""
    return V.weighted_scores(V.prompt_scores(A.frames(s, d), _prompts(s, d)), A.frames(s, d).select("t", "vec"), A.feedback(s, d), weighted_feedback(s, d).select("row_id", "weight"), TRIGGER)


def _points(s, d):
    """Frames of films, one of each vector, with their author."""
    films = A.score_series(s, d).agg(F.max("film_id").alias("n"))
    e = table(s, d, "embeddings").join(F.broadcast(films))  # one row
    return e.select((F.col("vec_id") % (F.col("n") + 1)).alias("film_id"), (F.col("vec_id") * 37 % FILM_TICKS * HOUR_MS).cast("long").alias("t_ms"), F.col("label").cast("long").alias("author"), "vec_id")


def frames_of_suggestions(s, d):
    """Every frame that lies in a suggestion of its film, once, with the first that holds it."""
    sugg = _reasoned(s, d).select("film_id", "place", "start_ms", "end_ms")
    return I.point_join(_points(s, d), sugg, "t_ms", 24 * HOUR_MS).groupBy("film_id", "vec_id", "author", "t_ms").agg(F.min("place").alias("place"))


def suggestion_authors(s, d):
    """Of each suggestion the authors of its frames by their number, ties by first frame, the ten best."""
    sugg = _reasoned(s, d).select("film_id", "place", "start_ms", "end_ms")
    n = I.point_join(_points(s, d), sugg, "t_ms", 24 * HOUR_MS).groupBy("film_id", "place", "author").agg(F.count(F.lit(1)).alias("frames"), F.min(F.struct("t_ms", "vec_id")).alias("first"))
    nth = F.row_number().over(R.W.partitionBy("film_id", "place").orderBy(F.desc("frames"), "first"))
    return n.withColumn("nth", nth.cast("long")).where("nth <= 10").select("film_id", "place", "author", "frames", "nth")


def label_columns(s, d):
    """Vectors as rows of class scores; nations are the classes, of which the fifth ones share the name of the one before; customers' nations are wanted, and one name that no class has."""
    e = table(s, d, "embeddings").select(F.col("label").cast("long").alias("film_id"), F.col("vec_id").alias("idx"), F.col("embedding").alias("scores"))
    n = table(s, d, "nation")
    name = F.when(F.col("n_nationkey") % 5 == 4, F.concat(F.lit("Class "), (F.col("n_nationkey") - 1).cast("string"))).otherwise(F.concat(F.lit("Class "), F.col("n_nationkey").cast("string")))
    wanted = table(s, d, "customer").where("c_nationkey % 3 = 0").select(F.concat(F.lit("CLASS "), F.col("c_nationkey").cast("string")).alias("name")).distinct().unionByName(n.where("n_nationkey = 0").select(F.lit("no class").alias("name")))
    return S.label_columns(e, n.select((F.col("n_nationkey") * 3).cast("long").alias("idx"), name.alias("name")), wanted, "audio.")


def utc_days(s, d):
    """Events of each day in UTC."""
    return table(s, d, "events").groupBy(X.utc_day(F.col("ts")).alias("day_utc")).agg(F.count(F.lit(1)).alias("n"))


#: Recipes of little sensitivity: half of the films and more get no suggestion.
STRICT = [(*r[:2], 0.99, *r[3:]) for r in RECIPES]


def closest_when_strict(s, d):
    """Of films without a suggestion under strict thresholds, the categories that came nearest."""
    rules = s.createDataFrame(STRICT, RECIPE_SCHEMA)
    fused = S.fuse(S.detector_series(rules, A.score_series(s, d)))
    merged = S.merge_runs(S.runs(fused, rules, HOUR_MS, FILM_TICKS), 2 * HOUR_MS)
    return S.closest(S.diagnostics(fused, rules, merged))


def queries():
    return {
        "s1_recipe_rows": recipe_rows,
        "p3_required_labels": lambda s, d: R.required_labels(_recipes(s, d), "det1"),
        "p4_scaled_thresholds": lambda s, d: R.scaled_thresholds(_recipes(s, d), [0.1, 1.0, 2.5]),
        "s3_result_documents": result_documents,
        "s19_loudness_log": loudness_log,
        "w2_merged_reasons": merged_reasons,
        "p22_pending_markers": lambda s, d: R.pending_markers(_reasoned(s, d)),
        "o1_marker_order": marker_order,
        "g4_weighted_scores": weighted_scores,
        "j2_frames_of_suggestions": frames_of_suggestions,
        "j3_suggestion_authors": suggestion_authors,
        "o3_closest_when_strict": closest_when_strict,
        "p24_label_columns": label_columns,
        "f_utc_days": utc_days,
    }


_CATEGORY_ORDER = "CASE category " + " ".join(f"WHEN '{c}' THEN {k}" for k, c in enumerate(dict.fromkeys(r[0] for r in RECIPES))) + " END"
_REASONED = (
    scoring._HEAD
    + f""", said AS (SELECT *, {_CATEGORY_ORDER} * 1000000 + start_ms // {HOUR_MS} AS arrival, (CAST(round(score * 1000000000) AS BIGINT) + 5000000) // 10000000 AS cents FROM parts),
  firsts AS (SELECT film_id, category, min(arrival) AS first FROM said GROUP BY ALL),
  grouped AS (SELECT film_id, category, part, min(start_ms) AS start_ms, max(end_ms) AS end_ms, max(score) AS score, list('fused score peaked at ' || cents // 100 || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') ORDER BY start_ms, end_ms, arrival) AS reasons FROM said GROUP BY film_id, category, part),
  placed AS (SELECT g.*, row_number() OVER (PARTITION BY film_id ORDER BY start_ms, end_ms, first, part) - 1 AS place FROM grouped g JOIN firsts USING (film_id, category))"""
)
_POINTS = f", points AS (SELECT vec_id % ((SELECT max(film_id) FROM series) + 1) AS film_id, CAST(vec_id * 37 % {FILM_TICKS} * {HOUR_MS} AS BIGINT) AS t_ms, CAST(label AS BIGINT) AS author, vec_id FROM embeddings), held AS (SELECT p.film_id, vec_id, author, t_ms, place FROM points p JOIN placed s ON s.film_id = p.film_id AND t_ms >= start_ms AND t_ms < end_ms)"
_RESULTS = """m AS (SELECT *, film_id % 9 AS k, id % 7 > 0 AND id % 5 > 0 AS kept FROM markers),
  f AS (SELECT film_id, k, count(*) FILTER (kept) AS n, list(id) FILTER (kept) AS ids, max(CASE WHEN id % 3 = 0 THEN 50 ELSE 2 END) FILTER (kept) AS authors FROM m GROUP BY ALL)
SELECT CAST(film_id AS VARCHAR) AS name, CASE k WHEN 7 THEN 'json' END AS error, CAST(1 AS BIGINT) AS schema_version, CASE WHEN k IN (5, 7, 8) THEN 0 ELSE film_id END AS duration_ms, CASE WHEN k IN (7, 8) THEN '' WHEN k IN (2, 3) THEN 'audio_peak_gaps' WHEN k = 4 THEN 'other' ELSE 'keyframes' END AS kind,
  CAST(CASE k WHEN 1 THEN 20000 WHEN 0 THEN 41 WHEN 5 THEN 41 WHEN 6 THEN 41 ELSE 0 END AS BIGINT) AS n_keyframes, CAST(CASE k WHEN 1 THEN 19999 WHEN 0 THEN 40 WHEN 5 THEN 40 WHEN 6 THEN 40 END AS BIGINT) AS last_keyframe, CAST(CASE k WHEN 2 THEN 7 WHEN 3 THEN 200 ELSE 0 END AS BIGINT) AS n_peaks,
  CASE WHEN k IN (6, 7, 8) THEN 0 ELSE n END AS n_suggestions, CASE WHEN k IN (6, 7, 8) OR n = 0 THEN '' ELSE array_to_string(list_sort(list_concat(list_transform(ids, lambda x: 'one'), list_transform(ids, lambda x: CAST(x AS VARCHAR)))), ',') END AS reasons, CAST(CASE WHEN k IN (6, 7, 8) THEN 0 ELSE coalesce(authors, 0) END AS BIGINT) AS most_authors FROM f"""
_RECIPES = """WITH b AS (SELECT p_brand, min(p_partkey) % 6 AS shape FROM part GROUP BY p_brand),
  c AS (SELECT p.*, b.shape, p_partkey % 5 AS k, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS position FROM part p JOIN b USING (p_brand) WHERE shape IN (0, 1, 5)),
  e AS (SELECT *, unnest(CASE WHEN k = 0 THEN [0, 1] WHEN k < 4 THEN [0] ELSE [NULL] END) AS det_ord FROM c)
SELECT p_brand AS name, CAST(NULL AS VARCHAR) AS error, position, p_name AS category, k <> 3 AS enabled, p_size / 64 AS threshold, CAST(p_size AS BIGINT) AS pad_before_ms, CAST(det_ord AS BIGINT) AS det_ord, CASE WHEN det_ord IS NOT NULL THEN 'det' || (p_size % 3) END AS det_id, unnest(CASE WHEN k = 1 THEN [p_type, p_name] ELSE [NULL] END) AS label FROM e
UNION ALL SELECT p_brand, CASE shape WHEN 2 THEN 'json' ELSE 'shape' END, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM b WHERE shape IN (2, 3, 4)"""
_WEIGHTED = f""", rows_ AS (SELECT row_id, accepted, vec, CAST(author * 7 + row_id % 5 AS BIGINT) AS author FROM feedback),
  weighted AS (SELECT row_id, accepted, vec, CAST(1.0 AS DOUBLE) AS weight FROM rows_ WHERE row_id % 10 = 1 UNION ALL SELECT row_id, accepted, vec, coalesce(score, 0.1) FROM rows_ r LEFT JOIN direct d ON d.author = r.author WHERE row_id % 10 <> 1 AND coalesce(score, 0.1) >= 0.05),
  sims AS (SELECT f.t, b.accepted, b.row_id, b.weight, round({_DOT.format(a="f.vec", b="b.vec")}, 6) AS sim FROM frames f CROSS JOIN weighted b),
  best AS (SELECT t, accepted, arg_max(weight, (sim, -row_id)) AS weight, max(sim) AS sim FROM sims GROUP BY t, accepted),
  factors AS (SELECT t, round(coalesce(max(CASE WHEN sim >= {TRIGGER} THEN 1 + least(greatest(weight, 0), 1) * (CAST(1.15 AS DOUBLE) - 1) ELSE 1.0 END) FILTER (accepted), 1.0) * coalesce(max(CASE WHEN sim >= {TRIGGER} THEN 1 + least(greatest(weight, 0), 1) * (CAST(0.5 AS DOUBLE) - 1) ELSE 1.0 END) FILTER (NOT accepted), 1.0), 6) AS factor FROM best GROUP BY t),
  scores AS (SELECT f.t, 'prompt ' || b.author AS prompt, round(least(greatest(({_DOT.format(a="f.vec", b="b.vec")} - 0.15) / 0.2, 0.0), 1.0), 6) AS score FROM frames f CROSS JOIN (SELECT author, arg_min(vec, row_id) AS vec FROM feedback GROUP BY author) b)"""


def oracle_sql():
    strict = scoring._HEAD.replace(DUCK["recipes"], DUCK["recipes"].split(" AS (VALUES")[0] + " AS (VALUES " + A._values(STRICT) + ")")
    return {
        "s1_recipe_rows": _RECIPES,
        "p3_required_labels": f"WITH r AS ({_RECIPES}), u AS (SELECT name, label, position * 10 + CASE WHEN label = category THEN 1 ELSE 0 END AS ord FROM r WHERE det_id = 'det1' AND enabled AND label IS NOT NULL), m AS (SELECT name, label, min(ord) AS first FROM u GROUP BY ALL) SELECT name, label, row_number() OVER (PARTITION BY name ORDER BY first) - 1 AS place FROM m",
        "p4_scaled_thresholds": f"WITH r AS ({_RECIPES}), u AS (SELECT DISTINCT name, position, category, threshold FROM r WHERE error IS NULL) SELECT name, position, category, CAST(sensitivity AS DOUBLE) AS sensitivity, round(least(greatest(threshold * least(greatest(1 / CAST(sensitivity AS DOUBLE), 0.25), 4.0), 0.0), 1.0), 6) AS threshold FROM u CROSS JOIN (VALUES (0.1), (1.0), (2.5)) v(sensitivity)",
        "s3_result_documents": with_("markers") + ", " + _RESULTS,
        "p24_label_columns": "WITH c AS (SELECT n_nationkey * 3 AS idx, 'class ' || CASE WHEN n_nationkey % 5 = 4 THEN n_nationkey - 1 ELSE n_nationkey END AS name FROM nation), w AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_nationkey % 3 = 0), p AS (SELECT 'CLASS ' || k AS name, max(idx) AS place FROM w JOIN c ON c.name = 'class ' || k GROUP BY 1) SELECT CAST(label AS BIGINT) AS film_id, 'audio.' || name AS series_key, vec_id AS idx, CAST(embedding[place + 1] AS DOUBLE) AS value FROM embeddings CROSS JOIN p WHERE place < len(embedding)",
        "f_utc_days": "SELECT CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS day_utc, count(*) AS n FROM events GROUP BY 1",
        "s19_loudness_log": "WITH e AS (SELECT user_id AS file, event_id AS seq, round(floor(value * 10) / 10 - 120, 1) AS m, event_id % 11 AS k FROM events WHERE event_id % 11 NOT IN (0, 3)) SELECT file, row_number() OVER (PARTITION BY file ORDER BY seq) - 1 AS idx, CAST(CASE WHEN k IN (1, 2) OR m < -120 THEN -120 ELSE m END AS DOUBLE) AS momentary, CAST(-120 AS DOUBLE) AS short_term FROM e",
        "w2_merged_reasons": _REASONED + " SELECT film_id, category, start_ms, end_ms, score, array_to_string(reasons, '|') AS reasons, place FROM placed",
        "p22_pending_markers": _REASONED + " SELECT film_id, place, start_ms, end_ms, category, array_to_string(reasons, ' · ') AS note, 'suggested' AS source, 'pending' AS status, score AS confidence FROM placed",
        "o1_marker_order": with_("markers") + " SELECT film_id, id, start_ms, row_number() OVER (ORDER BY film_id, start_ms, id DESC) - 1 AS ordinal FROM markers",
        "g4_weighted_scores": _DIRECT.replace(DUCK["feedback"], DUCK["feedback"] + ", " + DUCK["frames"]) + _WEIGHTED + " SELECT s.t, s.prompt, round(least(greatest(s.score * coalesce(factor, 1.0), 0.0), 1.0), 6) AS score FROM scores s LEFT JOIN factors USING (t)",
        "j2_frames_of_suggestions": _REASONED + _POINTS + " SELECT film_id, vec_id, author, t_ms, min(place) AS place FROM held GROUP BY ALL",
        "j3_suggestion_authors": _REASONED + _POINTS + ", n AS (SELECT film_id, place, author, count(*) AS frames, min((t_ms, vec_id)) AS first FROM held GROUP BY film_id, place, author) SELECT film_id, place, author, frames, row_number() OVER (PARTITION BY film_id, place ORDER BY frames DESC, first) AS nth FROM n QUALIFY nth <= 10",
        "o3_closest_when_strict": strict + ", quiet AS (SELECT * FROM diag QUALIFY sum(suggestions) OVER (PARTITION BY film_id) = 0) SELECT film_id, row_number() OVER (PARTITION BY film_id ORDER BY round(peak - threshold, 6) DESC, category) AS nth, category, round(peak - threshold, 6) AS margin FROM quiet QUALIFY nth <= 3",
    }
