"""Registered queries of projects, repositories, endorsements that came in and concat lists, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import intervals as I
from ..operators import packs as K
from ..operators import projects as J
from ..session import table
from ..sources import adapters as A
from ..sources.adapters import with_
from . import editing as E


def projects(s, d):
    """Projects of films at their two places: of nine films four stand beside, one aside, one is cut short beside and whole aside, one is cut short at both, one is nowhere and one is a list."""
    m = A.markers(s, d).withColumn("name", F.concat(F.lit("/films/"), F.col("film_id").cast("string"), F.lit(".mkv")))
    films = m.select("film_id", F.col("name").alias("path")).distinct()
    docs = J.as_documents(films.select(F.col("path").alias("name"), F.sha1("path").alias("source_hash"), (F.col("film_id") * 1000).alias("duration_ms")), m.select("name", "id", "start_ms", "end_ms", "category", F.lit("").alias("note"), F.lit("suggested").alias("source"), "confidence", "status"))
    k = F.col("film_id") % 9
    docs = docs.join(films, docs["name"] == films["path"]).select("raw", k.alias("k"), J.places(F.col("path"), "/aside").alias("at"))
    cut = F.expr("substring(raw, 1, length(raw) - 5)")
    beside = docs.where("k NOT IN (4, 7)").select(F.col("at.beside").alias("place"), F.when(F.col("k").isin(5, 6), cut).when(F.col("k") == 8, "[]").otherwise(F.col("raw")).alias("raw"))
    aside = docs.where("k IN (4, 5, 6)").select(F.col("at.aside").alias("place"), F.when(F.col("k") == 6, cut).otherwise(F.col("raw")).alias("raw"))
    out = J.projects_of(films, beside.unionByName(aside), "/aside")
    pending = F.size(F.filter("markers", lambda x: x["status"] == "pending"))
    return out.select("path", "place", "error", "duration_ms", "source_hash", F.col("export.crf").alias("crf"), F.size("markers").cast("long").alias("n_markers"), pending.cast("long").alias("n_pending"), F.aggregate("markers", F.lit(0).cast("long"), lambda a, x: a + x["start_ms"]).alias("starts"))


def inbound(s, d):
    """Orders as lines of endorsements; some are cut short or name no peer."""
    e = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_discount").cast("double").alias("score"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("target")))).alias("x"))
    line = F.to_json(F.struct(F.when(F.col("o_orderkey") % 11 != 0, F.concat(F.lit("peer"), F.col("o_custkey").cast("string"))).alias("peer_key"), F.transform("x", lambda y: F.struct(y["target"].alias("target"), y["score"].alias("score"))).alias("entries")))
    o = table(s, d, "orders").join(e, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(F.col("o_orderkey").alias("ord"), line.alias("value"))
    return J.inbound(o.withColumn("value", F.when(F.col("ord") % 13 == 0, F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value"))))


def repository_report(s, d):
    o = table(s, d, "orders")
    return K.repository_report(o.select(F.concat(F.lit("film"), (F.col("o_custkey") % 50).cast("string")).alias("film_id"), (F.col("o_orderkey") % 7 == 0).alias("malformed"), (F.col("o_orderkey") % 9 != 0).alias("signed"), (F.col("o_custkey") % 4 != 1).alias("allowed")))


def concat_scripts(s, d):
    """Plans of films as concat lists; every seventh film has a path for a name."""
    plan = I.boundary_plan(E._keeps(s, d), E._keyframes(s, d), E.WIDTH)
    name = F.when(F.col("film_id") % 7 == 0, "a/b.mkv").otherwise(F.concat(F.lit("film '"), F.col("film_id").cast("string"), F.lit(".mkv")))
    return X.concat_scripts(plan, A.markers(s, d).select("film_id").distinct().select("film_id", name.alias("name")))


def queries():
    return {"s4_projects": projects, "s23_inbound_endorsements": inbound, "a8_repository_report": repository_report, "p_concat_scripts": concat_scripts}


def _seconds(ms: str) -> str:
    return f"regexp_replace(format('{{:d}}.{{:03d}}', ({ms}) // 1000, ({ms}) % 1000), '\\.?0+$', '')"


def oracle_sql():
    counts = "count(*) AS total, count(*) FILTER (malformed) AS malformed, count(*) FILTER (NOT malformed AND o_orderkey % 9 = 0) AS unsigned, count(*) FILTER (NOT malformed AND o_custkey % 4 = 1) AS not_allowed, count(DISTINCT film) AS films FROM o"
    return {
        "s4_projects": with_("markers")
        + """, f AS (SELECT film_id, film_id % 9 AS k, count(*) AS n, count(*) FILTER (status = 'pending') AS p, CAST(sum(start_ms) AS BIGINT) AS starts FROM markers GROUP BY ALL),
          g AS (SELECT *, k <= 5 AS whole, '/films/' || film_id || '.mkv' AS path FROM f)
          SELECT path, CASE WHEN k <= 3 THEN 'beside' WHEN k <= 5 THEN 'aside' END AS place, CASE k WHEN 6 THEN 'json' WHEN 8 THEN 'shape' END AS error, CASE WHEN whole THEN film_id * 1000 END AS duration_ms, CASE WHEN whole THEN sha1(path) END AS source_hash,
            CASE WHEN whole THEN 18 END AS crf, CASE WHEN whole THEN n END AS n_markers, CASE WHEN whole THEN p END AS n_pending, CASE WHEN whole THEN starts END AS starts FROM g""",
        "s23_inbound_endorsements": """WITH e AS (SELECT o_orderkey AS ord, o_custkey AS author, count(DISTINCT l_suppkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 11 <> 0 AND o_orderkey % 13 <> 0 GROUP BY ALL),
          f AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY author ORDER BY ord) = 1 THEN 1 ELSE 0 END AS first FROM e),
          b AS (SELECT *, sum(first) OVER w - first AS authors, sum(n) OVER w - n AS entries FROM f WINDOW w AS (ORDER BY ord ROWS UNBOUNDED PRECEDING)),
          k AS (SELECT author, max(ord) AS ord FROM b WHERE authors < 1000 AND entries < 50000 GROUP BY author)
          SELECT 'peer' || author AS author, 's' || l_suppkey AS target, CAST(arg_max(l_discount, (l_linenumber, l_discount)) AS DOUBLE) AS score FROM k JOIN lineitem ON l_orderkey = ord GROUP BY author, l_suppkey""",
        "a8_repository_report": f"WITH o AS (SELECT *, o_orderkey % 7 = 0 AS malformed, CASE WHEN o_orderkey % 7 <> 0 THEN 'film' || o_custkey % 50 END AS film FROM orders) SELECT NULL AS film_id, {counts} UNION ALL SELECT film, {counts} WHERE film IS NOT NULL GROUP BY film",
        "p_concat_scripts": E.oracle_sql()["w16_boundary_plan"].replace(" SELECT film_id, 'rendered' AS kind", ", plan AS (SELECT film_id, 'rendered' AS kind", 1)
        + f"""), media AS (SELECT DISTINCT film_id, CASE WHEN film_id % 7 = 0 THEN 'a/b.mkv' ELSE 'film ''' || film_id || '.mkv' END AS name FROM markers),
          b AS (SELECT film_id, start_ms, end_ms, CASE kind WHEN 'rendered' THEN 'file ''' || start_ms || '-' || end_ms || '.ts''' || chr(10) ELSE 'file ''' || replace(name, '''', '''\\''''') || '''' || chr(10) || 'inpoint ' || {_seconds('start_ms')} || chr(10) || 'outpoint ' || {_seconds('end_ms')} || chr(10) END || 'duration ' || {_seconds('end_ms - start_ms')} || chr(10) AS block FROM plan JOIN media USING (film_id) WHERE end_ms > start_ms),
          l AS (SELECT film_id, string_agg(block, '' ORDER BY start_ms, end_ms) AS body FROM b GROUP BY film_id)
          SELECT film_id, CASE WHEN film_id % 7 > 0 THEN 'ffconcat version 1.0' || chr(10) || coalesce(body, '') END AS script, CASE WHEN film_id % 7 = 0 THEN 'name' END AS error FROM media LEFT JOIN l USING (film_id)""",
    }
