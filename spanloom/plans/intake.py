"""Registered queries on text, subtitles and the admission of rows, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import admission as M
from ..session import table
from ..sources import adapters as A
from ..sources.adapters import with_

#: Characters of head and tail that tell a content.
HEAD = 1 << 20
WORDS = ["the", "que", "and the", "en", "nicht"]


def srt_files(s, d):
    return X.write_srt(A.subtitles(s, d))


def srt_round_trip(s, d):
    """Subtitles written and read back, white space at the ends of texts apart."""
    return X.parse_srt(srt_files(s, d)).select("film_id", "start_ms", "end_ms", F.length("text").cast("long").alias("n"))


def keyword_ticks(s, d):
    return X.keyword_ticks(A.subtitles(s, d), WORDS, 1000)


def names(s, d):
    """Output names, quoted names and decoded paths of parts."""
    p = table(s, d, "part").select("p_partkey", F.concat(F.lit("/films/"), F.replace("p_brand", F.lit("#"), F.lit("'")), F.lit("."), F.col("p_size").cast("string"), F.lit(".mkv")).alias("path"), "p_size")
    p = p.withColumn("uri", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("file:///a%20b+"), F.col("p_partkey").cast("string"))).otherwise(F.col("path")))
    return p.select("p_partkey", X.output_name(F.col("path"), F.col("p_size") % 3).alias("output"), X.quoted(F.col("path")).alias("quoted"), X.uri_path(F.col("uri")).alias("decoded"))


def clocks(s, d):
    """Times as hh:mm:ss and SRT times."""
    t = A.keyframes(s, d).select("film_id", "t_ms")
    return t.select("film_id", "t_ms", X.srt_time(F.col("t_ms")).alias("srt"), F.format_string("%d:%02d:%02d", F.floor(F.col("t_ms") / 3600000), F.floor(F.col("t_ms") / 60000) % 60, F.floor(F.col("t_ms") / 1000) % 60).alias("clock"))


def content_keys(s, d):
    """Identity of contents by size, head and tail."""
    return table(s, d, "documents").select("doc_id", X.content_key(F.length("text"), F.col("text"), HEAD).alias("key"))


def truncated(s, d):
    rows = table(s, d, "conversations").select(F.col("conv_id").cast("long").alias("file"), F.col("turn").cast("long").alias("seq"), F.col("text").alias("line"))
    return M.newest_within(rows, 2000).select("file", "seq")


def allowed(s, d):
    rows = table(s, d, "customer").select(F.expr("CASE c_custkey % 4 WHEN 0 THEN concat('  ', upper(sha2(c_name, 256)), ' # note') WHEN 1 THEN '# only a note' WHEN 2 THEN 'tooshort' ELSE sha2(c_name, 256) END").alias("line"))
    return M.allow_list(rows)


def signature_gate(s, d):
    """Packs whose author is on the allow list and whose signature was found good; an empty list lets all authors through."""
    packs = table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("author"), (F.col("o_orderkey") % 9 != 0).alias("signed"))
    allow = table(s, d, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("author"))
    open_ = M.gate(packs, allow.limit(0)).select("o_orderkey", F.lit("open").alias("gate"), "outcome")
    return M.gate(packs, allow).select("o_orderkey", F.lit("list").alias("gate"), "outcome").unionByName(open_).groupBy("gate", "outcome").agg(F.count(F.lit(1)).alias("n"))


def repository_check(s, d):
    """Totals of a repository: rows, malformed, bad signatures, films and the most packs of one film."""
    m = A.markers(s, d).withColumn("bad", F.col("end_ms") - F.col("start_ms") > 38).withColumn("sig", F.col("id") % 9 != 0)
    per = m.groupBy("film_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad"), F.count_if(~F.col("sig")).alias("nosig"))
    return per.agg(F.sum("n").alias("total"), F.sum("bad").alias("malformed"), F.sum("nosig").alias("unsigned"), F.count(F.lit(1)).alias("films"), F.max("n").alias("most"))


def film_bucket(s, d):
    """Latest pack of each film and author."""
    o = table(s, d, "orders").withColumn("film", F.col("o_custkey") % 50).withColumn("author", F.col("o_custkey") % 7)
    return o.groupBy("film", "author").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("pack"), F.count(F.lit(1)).alias("versions"))


def categories(s, d):
    """Built-in and added category names, each once without case."""
    built = s.createDataFrame([("Urgent",), ("Violence",), ("Medium",)], "name string")
    added = table(s, d, "orders").select(F.substring("o_orderpriority", 3, 20).alias("name")).where(F.col("name").rlike("^[A-Za-z0-9 /.-]{1,64}$"))
    return built.unionByName(added).select(F.lower("name").alias("name")).distinct()


def csv_labels(s, d):
    """A class map joined to names in any case: the last class of equal names wins, unknown names are dropped."""
    classes = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("idx"), F.concat(F.lower("n_name"), F.expr("CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE '' END")).alias("name"))
    wanted = table(s, d, "nation").select(F.upper(F.substring("n_name", 1, 30)).alias("wanted")).unionByName(s.createDataFrame([("ATLANTIS",)], "wanted string"))
    return wanted.join(classes, F.lower("wanted") == F.col("name")).groupBy("wanted").agg(F.max("idx").alias("idx"))


def analysis_reader(s, d):
    """Analysis results read from JSON: all suggestions but those of five ticks or less."""
    m = A.markers(s, d).groupBy("film_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "id"))).alias("suggestions"))).alias("doc"))
    parsed = m.select("film_id", F.from_json("doc", "suggestions array<struct<start_ms:bigint,end_ms:bigint,id:bigint>>").alias("r"))
    kept = F.filter("r.suggestions", lambda x: x["end_ms"] - x["start_ms"] > 5)
    return parsed.select("film_id", F.size("r.suggestions").cast("long").alias("n_all"), F.size(kept).cast("long").alias("n_kept"), F.coalesce(F.array_max(F.transform(kept, lambda x: x["id"])), F.lit(-1).cast("long")).alias("largest_id"))


def edit_lists(s, d):
    """Edit lists written as JSON per film and read back to cuts."""
    m = A.markers(s, d).where("status = 'confirmed'").groupBy("film_id").agg(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "category"))).alias("cuts"))
    docs = m.select(F.to_json(F.struct("film_id", F.array(F.struct(F.lit("all").alias("id"), F.col("cuts").alias("cuts"))).alias("profiles"))).alias("doc"))
    back = docs.select(F.from_json("doc", "film_id bigint, profiles array<struct<id:string,cuts:array<struct<start_ms:bigint,end_ms:bigint,category:string>>>>").alias("e"))
    return back.select("e.film_id", F.explode("e.profiles").alias("p")).select("film_id", F.col("p.id").alias("profile"), F.explode("p.cuts").alias("c")).select("film_id", "profile", "c.start_ms", "c.end_ms", "c.category")


def queries():
    return {
        "s7_srt_write": srt_files,
        "s6_srt_round_trip": srt_round_trip,
        "j20_keyword_ticks": keyword_ticks,
        "p_output_names": names,
        "p_clock_times": clocks,
        "s4_content_keys": content_keys,
        "s11_truncated_tail": truncated,
        "s15_allow_list": allowed,
        "p14_signature_gate": signature_gate,
        "a8_repository_check": repository_check,
        "s13_film_bucket": film_bucket,
        "s16_categories": categories,
        "j18_label_index": csv_labels,
        "s3_analysis_reader": analysis_reader,
        "s5_edit_lists": edit_lists,
    }


def _clock(t: str) -> str:
    return f"format('{{:02d}}:{{:02d}}:{{:02d}},{{:03d}}', {t} // 3600000, {t} // 60000 % 60, {t} // 1000 % 60, {t} % 1000)"


def oracle_sql():
    srt = with_("subtitles") + f", n AS (SELECT *, row_number() OVER (PARTITION BY film_id ORDER BY start_ms, end_ms, ord) AS k FROM subtitles)"
    word = lambda k: f"regexp_matches(text, '(?i){k}')" if " " in k else f"regexp_matches(text, '(?i)(^|[^\\p{{L}}\\p{{N}}_]){k}($|[^\\p{{L}}\\p{{N}}_])')"
    ticks = " UNION ALL ".join(f"SELECT film_id, start_ms, end_ms, '{k}' AS keyword FROM subtitles WHERE {word(k)}" for k in WORDS)
    return {
        "s7_srt_write": srt + f" SELECT film_id, string_agg(k || chr(13) || chr(10) || {_clock('start_ms')} || ' --> ' || {_clock('end_ms')} || chr(13) || chr(10) || regexp_replace(text, '\\r?\\n', chr(13) || chr(10), 'g') || chr(13) || chr(10) || chr(13) || chr(10), '' ORDER BY k) AS srt FROM n GROUP BY film_id",
        "s6_srt_round_trip": with_("subtitles") + " SELECT film_id, start_ms, end_ms, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS n FROM subtitles WHERE end_ms > start_ms",
        "j20_keyword_ticks": with_("subtitles") + f", h AS ({ticks}) SELECT DISTINCT film_id, keyword, CAST(idx AS BIGINT) AS idx FROM (SELECT film_id, keyword, unnest(range(start_ms // 1000, end_ms // 1000)) AS idx FROM h)",
        "p_output_names": "WITH p AS (SELECT p_partkey, '/films/' || replace(p_brand, '#', '''') || '.' || p_size || '.mkv' AS path, p_size FROM part) SELECT p_partkey, path[:-5] || ' CENSORED' || CASE WHEN p_size % 3 > 0 THEN '-' || (p_size % 3) ELSE '' END || '.mkv' AS output, '''' || replace(path, '''', '''\\''''') || '''' AS quoted, CASE WHEN p_partkey % 2 = 0 THEN '/a b+' || p_partkey ELSE path END AS decoded FROM p",
        "p_clock_times": with_("keyframes") + f" SELECT film_id, t_ms, {_clock('t_ms')} AS srt, format('{{:d}}:{{:02d}}:{{:02d}}', t_ms // 3600000, t_ms // 60000 % 60, t_ms // 1000 % 60) AS clock FROM keyframes",
        "s4_content_keys": "SELECT doc_id, sha1(length(text) || text[1:1048576] || CASE WHEN length(text) > 2097152 THEN right(text, 1048576) ELSE '' END) AS key FROM documents",
        "s11_truncated_tail": "SELECT CAST(conv_id AS BIGINT) AS file, CAST(turn AS BIGINT) AS seq FROM conversations QUALIFY sum(strlen(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) <= 2000",
        "s15_allow_list": "SELECT CASE c_custkey % 4 WHEN 2 THEN 'tooshort' ELSE sha256(c_name) END AS key, c_custkey % 4 <> 2 AS valid FROM customer WHERE c_custkey % 4 <> 1",
        "p14_signature_gate": "SELECT 'list' AS gate, CASE WHEN c_custkey IS NULL THEN 'forbidden' WHEN o_orderkey % 9 = 0 THEN 'unsigned' ELSE 'accepted' END AS outcome, count(*) AS n FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 5000 GROUP BY ALL UNION ALL SELECT 'open', CASE WHEN o_orderkey % 9 = 0 THEN 'unsigned' ELSE 'accepted' END, count(*) FROM orders GROUP BY ALL",
        "a8_repository_check": with_("markers") + " SELECT count(*) AS total, count(*) FILTER (end_ms - start_ms > 38) AS malformed, count(*) FILTER (id % 9 = 0) AS unsigned, count(DISTINCT film_id) AS films, (SELECT max(n) FROM (SELECT count(*) AS n FROM markers GROUP BY film_id)) AS most FROM markers",
        "s13_film_bucket": "SELECT o_custkey % 50 AS film, o_custkey % 7 AS author, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS pack, count(*) AS versions FROM orders GROUP BY ALL",
        "s16_categories": "SELECT DISTINCT lower(name) AS name FROM (SELECT 'Urgent' AS name UNION ALL SELECT 'Violence' UNION ALL SELECT 'Medium' UNION ALL SELECT substr(o_orderpriority, 3, 20) FROM orders WHERE regexp_full_match(substr(o_orderpriority, 3, 20), '[A-Za-z0-9 /.-]{1,64}'))",
        "j18_label_index": "SELECT upper(substr(n_name, 1, 30)) AS wanted, CAST(max(n_nationkey) AS BIGINT) AS idx FROM nation GROUP BY 1",
        "s3_analysis_reader": with_("markers") + ", r AS (SELECT *, row_number() OVER (PARTITION BY film_id ORDER BY start_ms, end_ms, id) AS k FROM markers) SELECT film_id, count(*) AS n_all, count(*) FILTER (end_ms - start_ms > 5) AS n_kept, coalesce(max(id) FILTER (end_ms - start_ms > 5), -1) AS largest_id FROM r GROUP BY film_id",
        "s5_edit_lists": with_("markers") + " SELECT film_id, 'all' AS profile, start_ms, end_ms, category FROM markers WHERE status = 'confirmed'",
    }
