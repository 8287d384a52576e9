"""Registered queries of files beside films, decisions, leaks and hits, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.language import CODES, NAMES
from ..operators import sidecars as B
from ..session import table
from ..sources import adapters as A
from ..sources.adapters import DAYS, with_
from .prototypes import _FRAMES, _frames

#: What follows a film's stem in the names of its files, by line number.
TAILS = [".srt", ".en.srt", ".FR.forced.ass", ".pt-br.vtt", ".eng.sdh.SSA", ".mkv", ".director.de.srt", ".xx..cc.vtt"]


def subtitle_files(s, d):
    """Parts as films in fifty folders, lines as files of odd parts; stems are beginnings of others."""
    tail = F.element_at(F.array(*(F.lit(x) for x in TAILS)), (F.col("l_linenumber") % 8 + 1).cast("int"))
    folder = lambda key: F.concat(F.lit("/films/"), (F.col(key) % 50).cast("string"))
    lines = table(s, d, "lineitem").select(folder("l_partkey").alias("folder"), F.concat(F.lit("Film "), F.col("l_partkey").cast("string"), tail).alias("name")).distinct()
    films = table(s, d, "part").select(F.col("p_partkey").alias("film_id"), folder("p_partkey").alias("folder"), F.concat(F.lit("film "), F.col("p_partkey").cast("string")).alias("stem"))
    films = films.withColumn("stem", F.when(F.col("film_id") % 2 == 0, F.initcap("stem")).otherwise(F.col("stem")))
    return B.subtitle_files(films, lines)


def recorded(s, d):
    """Frames of customers' films inside decided orders, as lines of JSON that are read again."""
    frames = table(s, d, "embeddings").select((F.col("vec_id") % 150).alias("film_id"), (F.col("vec_id") * 37 % DAYS).alias("t_ms"), F.when(F.col("vec_id") % 11 == 0, F.array().cast("array<float>")).otherwise(F.col("embedding")).alias("vec"))
    rows = B.read_lines(B.as_lines(B.recorded(frames, A.markers(s, d), 64)))
    return rows.groupBy("category", "decision").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 4).alias("score"), F.round(F.sum(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)), 4).alias("total"))


def leaked(s, d):
    """Frames of events, 36 days apart, against confirmed orders."""
    frames = _frames(s, d).select("film_id", (F.col("idx") * 36).alias("t_ms"), "phash")
    return B.leaked(frames, A.markers(s, d).where("status = 'confirmed'"), 64)


def hits(s, d):
    """Events as clicks on a band of 1,000 pixels."""
    clicks = table(s, d, "events").select(F.col("event_id").alias("click_id"), F.col("user_id").alias("film_id"), (F.col("event_id") * 37 % 1000).alias("x"))
    return B.hits(clicks, A.markers(s, d), 100, DAYS - 100, 1000)


def queries():
    return {"s21_subtitle_files": subtitle_files, "s8_recorded_feedback": recorded, "u5_leaked_hashes": leaked, "p17_hits": hits}


def _map(values: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in values.items()) + "}"


def oracle_sql():
    px = lambda c: f"CAST(round(greatest(0.0, least(1.0, ({c} - 100) / CAST({DAYS - 200} AS DOUBLE))) * 999) AS BIGINT)"
    return {
        "s21_subtitle_files": f"""WITH files AS (SELECT DISTINCT '/films/' || l_partkey % 50 AS folder, 'Film ' || l_partkey || {TAILS}[l_linenumber % 8 + 1] AS name FROM lineitem),
          films AS (SELECT p_partkey AS film_id, '/films/' || p_partkey % 50 AS folder, CASE WHEN p_partkey % 2 = 0 THEN 'Film ' ELSE 'film ' END || p_partkey AS stem FROM part),
          met AS (SELECT film_id, stem, name, row_number() OVER (PARTITION BY film_id ORDER BY name) - 1 AS nth FROM films f JOIN files s ON s.folder = f.folder AND starts_with(lower(regexp_replace(name, '\\.[^.]*$', '')), lower(stem)) WHERE lower(name) SIMILAR TO '.*\\.(srt|ass|ssa|vtt)'),
          rest AS (SELECT *, regexp_replace(CASE WHEN starts_with(name, stem) THEN name[length(stem) + 1:] ELSE name END, '^\\.', '') AS rest FROM met),
          parts AS (SELECT *, list_filter(string_split(regexp_replace(rest, '^(.+)\\.[^.]*$', '\\1'), '.'), lambda p: p <> '') AS parts FROM rest),
          found AS (SELECT *, list_filter(range(1, len(parts) + 1), lambda i: regexp_full_match(parts[i], '[a-zA-Z]{{2,3}}'))[1] AS spot FROM parts),
          coded AS (SELECT *, coalesce({_map(CODES)}[lower(parts[spot])], lower(parts[spot]), '') AS language, array_to_string(list_filter(parts, lambda p, i: spot IS NULL OR i <> spot), ' ') AS hints FROM found),
          named AS (SELECT *, coalesce({_map(NAMES)}[language], '') AS human FROM coded)
          SELECT film_id, nth, name, language, CASE WHEN human = '' THEN hints WHEN hints = '' THEN human ELSE human || ' (' || hints || ')' END AS title FROM named""",
        "s8_recorded_feedback": with_("markers")
        + f""", f AS (SELECT vec_id % 150 AS film_id, vec_id * 37 % {DAYS} AS t, embedding AS vec FROM embeddings WHERE vec_id % 11 <> 0)
          SELECT category, CASE status WHEN 'confirmed' THEN 'accept' ELSE 'reject' END AS decision, count(*) AS n, round(sum(confidence), 4) AS score, round(sum(list_sum(list_transform(vec, lambda x: CAST(x AS DOUBLE)))), 4) AS total
          FROM f JOIN markers m ON m.film_id = f.film_id AND t >= start_ms AND t < end_ms WHERE status IN ('confirmed', 'rejected') GROUP BY ALL""",
        "u5_leaked_hashes": _FRAMES
        + f", {with_('markers').removeprefix('WITH ')}"
        + """, k AS (SELECT film_id, phash, EXISTS (SELECT 1 FROM markers m WHERE m.film_id = fr.film_id AND status = 'confirmed' AND idx * 36 >= start_ms AND idx * 36 < end_ms) AS cut FROM fr)
          SELECT film_id, phash FROM k WHERE cut INTERSECT SELECT film_id, phash FROM k WHERE NOT cut""",
        "p17_hits": with_("markers")
        + f""", c AS (SELECT event_id AS click_id, user_id AS film_id, event_id * 37 % 1000 AS x FROM events), b AS (SELECT *, {px('start_ms')} AS x1, {px('end_ms')} AS x2 FROM markers),
          h AS (SELECT click_id, arg_max({{'id': id, 'part': CASE WHEN abs(x - x1) <= 5 THEN 'start' WHEN abs(x - x2) <= 5 THEN 'end' ELSE 'body' END}}, (start_ms, end_ms, id)) AS h FROM c JOIN b ON b.film_id = c.film_id AND x BETWEEN x1 - 5 AND x2 + 5 GROUP BY click_id)
          SELECT click_id, h.id AS id, h.part AS part FROM c LEFT JOIN h USING (click_id)""",
    }
