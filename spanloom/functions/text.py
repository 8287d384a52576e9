"""Text functions: subtitles, keywords, names, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_TIME = r"(\d{1,3}):(\d{1,2}):(\d{1,2})[,.](\d{1,3})"
TIME_LINE = _TIME + r"\s*-->\s*" + _TIME


def srt_time(ms: Column) -> Column:
    """HH:MM:SS,mmm."""
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def write_srt(entries: DataFrame) -> DataFrame:
    """film_id, srt: entries in order of their start, numbered from 1, with CR LF."""
    number = F.row_number().over(W.partitionBy("film_id").orderBy("start_ms", "end_ms", "ord"))
    block = F.concat(F.col("k").cast("string"), F.lit("\r\n"), srt_time(F.col("start_ms")), F.lit(" --> "), srt_time(F.col("end_ms")), F.lit("\r\n"), F.regexp_replace("text", "\r?\n", "\r\n"), F.lit("\r\n\r\n"))
    blocks = entries.withColumn("k", number).select("film_id", "k", block.alias("block"))
    return blocks.groupBy("film_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "block"))), lambda x: x["block"]), "").alias("srt"))


def _part(line: Column, first: int) -> Column:
    """Milliseconds of the time whose groups begin at `first`: a fraction of one or two digits is tenths or hundredths."""
    g = lambda k: F.regexp_extract(line, TIME_LINE, first + k)
    whole = g(0).cast("long") * 3600000 + g(1).cast("long") * 60000 + g(2).cast("long") * 1000
    return whole + F.rpad(g(3), 3, "0").cast("long")


def parse_srt(files: DataFrame) -> DataFrame:
    """film_id, k, start_ms, end_ms, text of the blocks of files (film_id, srt).

    Line ends and a byte order mark do not matter, numbers are not read, an empty line ends a block, and blocks that do not last are dropped."""
    plain = F.regexp_replace(F.regexp_replace("srt", "^\\ufeff", ""), "\r\n?", "\n")
    blocks = files.select("film_id", F.posexplode(F.split(plain, "\n[ \t]*\n")).alias("k", "block"))
    lines = blocks.withColumn("at", F.regexp_instr("block", F.lit(TIME_LINE))).where("at > 0")
    text = F.trim(F.regexp_replace(F.expr("substring(block, at)"), "^[^\n]*\n?", ""))
    rows = lines.select("film_id", F.col("k").cast("long").alias("k"), _part(F.col("block"), 1).alias("start_ms"), _part(F.col("block"), 5).alias("end_ms"), F.regexp_replace(text, "^\\s+|\\s+$", "").alias("text"))
    return rows.where("end_ms > start_ms")


def keyword_pattern(keyword: str) -> str:
    """A keyword as a pattern: a plain part if it has a space or apostrophe, else a whole word, in any case."""
    import re

    escaped = re.escape(keyword)
    return f"(?i){escaped}" if " " in keyword or "'" in keyword else rf"(?i)(^|[^\p{{L}}\p{{N}}_]){escaped}($|[^\p{{L}}\p{{N}}_])"


def keyword_ticks(segments: DataFrame, keywords: list[str], tick_ms: int) -> DataFrame:
    """film_id, keyword, idx: ticks that a segment with the keyword covers."""
    hits = [F.when(F.col("text").rlike(keyword_pattern(k)), F.lit(k)) for k in keywords]
    found = segments.select("film_id", "start_ms", "end_ms", F.explode(F.array_compact(F.array(*hits))).alias("keyword"))
    lo, hi = F.expr(f"start_ms div {tick_ms}"), F.expr(f"end_ms div {tick_ms}")
    return found.where(hi > lo).select("film_id", "keyword", F.explode(F.sequence(lo, hi - 1)).alias("idx")).distinct()


def output_name(path: Column, age: Column) -> Column:
    """`stem CENSORED-age.ext`, split at the last dot; no age, no suffix."""
    suffix = F.when(age > 0, F.concat(F.lit("-"), age.cast("string"))).otherwise("")
    return F.concat(F.regexp_extract(path, r"^(.*?)(\.[^.]*)?$", 1), F.lit(" CENSORED"), suffix, F.regexp_extract(path, r"^(.*?)(\.[^.]*)?$", 2))


def uri_path(uri: Column) -> Column:
    """The path of a file:// URI, percent escapes decoded; others pass."""
    return F.when(uri.startswith("file://"), F.try_url_decode(F.replace(F.substr(uri, F.lit(8)), F.lit("+"), F.lit("%2B")))).otherwise(uri)


def quoted(name: Column) -> Column:
    """A name in single quotes for a concat list."""
    return F.concat(F.lit("'"), F.replace(name, F.lit("'"), F.lit("'\\''")), F.lit("'"))


def content_key(size: Column, content: Column, head: int) -> Column:
    """SHA-1 over size, head and, where there is more, tail of a content."""
    tail = F.when(F.length(content) > 2 * head, F.right(content, F.lit(head))).otherwise("")
    return F.sha1(F.concat(size.cast("string"), F.substring(content, 1, head), tail))


def utc_day(time: Column) -> Column:
    """The day of a time in UTC as a number, such as 20240131; the session's zone must be UTC, as it is for all tables here."""
    return F.date_format(time.cast("timestamp"), "yyyyMMdd").cast("int")


def bare_name(name: Column) -> Column:
    """Whether a name may stand in a concat list: not empty and no path."""
    return F.coalesce((name != "") & ~name.contains("/") & ~name.contains("\\") & ~name.rlike("^[A-Za-z]:"), F.lit(False))


def seconds(ms: Column) -> Column:
    """Milliseconds as seconds with the decimals they need, three at most."""
    return F.regexp_replace(F.format_string("%d.%03d", F.floor(ms / 1000), ms % 1000), r"\.?0+$", "")


def concat_scripts(plan: DataFrame, media: DataFrame) -> DataFrame:
    """film_id, script, error: concat lists of plans (film_id, kind, start_ms, end_ms; times are not negative) over media (film_id, name): rendered entries name a file of their own, `<start>-<end>.ts`, others are ranges of the film's.

    Entries that don't last are left out; a film whose name is no bare name has the error `name` and no script, one without entries has only the head."""
    rendered = F.col("kind") == "rendered"
    file = F.when(rendered, F.concat(F.col("start_ms").cast("string"), F.lit("-"), F.col("end_ms").cast("string"), F.lit(".ts"))).otherwise(F.col("name"))
    line = lambda key, ms: F.concat(F.lit(f"{key} "), seconds(ms), F.lit("\n"))
    ends = F.when(rendered, "").otherwise(F.concat(line("inpoint", F.col("start_ms")), line("outpoint", F.col("end_ms"))))
    block = F.concat(F.lit("file "), quoted(file), F.lit("\n"), ends, line("duration", F.col("end_ms") - F.col("start_ms")))
    blocks = plan.where("end_ms > start_ms").join(media, "film_id").select("film_id", "start_ms", "end_ms", block.alias("block"))
    lists = blocks.groupBy("film_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "block"))), lambda x: x["block"]), "").alias("body"))
    good = bare_name(F.col("name"))
    script = F.when(good, F.concat(F.lit("ffconcat version 1.0\n"), F.coalesce("body", F.lit(""))))
    return media.join(lists, "film_id", "left").select("film_id", script.alias("script"), F.when(~good, "name").alias("error"))
