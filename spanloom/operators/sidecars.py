"""Files beside films: subtitles by name, class maps, and the store of decisions as lines of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.language import EXTENSIONS, subtitle_tags
from ..session import files_of
from .intervals import point_join

ROW = "schema int, category string, decision string, score double, vec array<double>"


def listed(spark: SparkSession, root: str) -> DataFrame:
    """folder, name, size of all files under root; no content is read."""
    path = F.col("path")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"))
    return files.select(F.regexp_extract(path, "^(.*)/[^/]*$", 1).alias("folder"), F.regexp_extract(path, "([^/]*)$", 1).alias("name"), "size")


def subtitle_files(films: DataFrame, files: DataFrame) -> DataFrame:
    """film_id, nth (from 0, by name), name, language, title of the subtitle files (folder, name) that stand beside films (film_id, folder, stem): those whose names begin with the stem, in any case.

    Each file is met by its beginnings, of which a name has no more than its letters, so that a folder with a third of all files is many keys; a file may belong to several films. Null names and stems meet nothing."""
    base = F.regexp_extract("name", rf"(?i)^(.*)\.({'|'.join(EXTENSIONS)})$", 1)
    found = files.where(F.col("name").rlike(rf"(?i)^.*\.({'|'.join(EXTENSIONS)})$")).select("folder", "name", F.lower(base).alias("base"))
    found = found.withColumn("start", F.explode(F.transform(F.sequence(F.lit(0), F.length("base")), lambda n: F.substring(F.col("base"), F.lit(1), n)))).drop("base")
    met = films.select("film_id", "folder", "stem", F.lower("stem").alias("start")).join(found, ["folder", "start"])
    nth = (F.row_number().over(W.partitionBy("film_id").orderBy("name")) - 1).cast("long")
    return met.select("film_id", "name", nth.alias("nth"), subtitle_tags(F.col("stem"), F.col("name")).alias("t")).select("film_id", "nth", "name", "t.language", "t.title")


def class_map(spark: SparkSession, path: str) -> DataFrame:
    """idx, name of a CSV file with the columns index and display_name (or displayName), by its head.

    Rows whose index is no number or negative, or whose name is blank, play no part; of rows of one index the last counts."""
    rows = spark.read.csv(path, header=True, escape='"')
    known = {c.lower(): c for c in rows.columns}
    if "index" not in known:
        raise ValueError(f"{path}: no column index")
    names = [F.nullif(F.trim(F.col(f"`{known[c]}`")), F.lit("")) for c in ("display_name", "displayname") if c in known]
    name = F.coalesce(*names, F.lit(None).cast("string"))
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("k"))
    kept = rows.select(F.expr(f"try_cast(trim(`{known['index']}`) AS long)").alias("idx"), name.alias("name"), place.alias("place")).where("idx >= 0 AND name IS NOT NULL")
    return kept.groupBy("idx").agg(F.max_by("name", "place").alias("name"))


def recorded(frames: DataFrame, markers: DataFrame, width: int) -> DataFrame:
    """film_id, id, t_ms, category, decision, score, vec: a row for each frame (film_id, t_ms, vec) inside a decided marker (film_id, id, start_ms, end_ms, category, status, confidence), confirmed ones accepted and rejected ones
    rejected. Frames without a vector and pending markers give none. width: of the buckets of time by which they meet."""
    decided = markers.where("status IN ('confirmed', 'rejected')").select("film_id", "id", "start_ms", "end_ms", "category", F.when(F.col("status") == "confirmed", "accept").otherwise("reject").alias("decision"), F.col("confidence").alias("score"))
    held = point_join(frames.where("size(vec) > 0").select("film_id", "t_ms", "vec"), decided.where("end_ms > start_ms"), "t_ms", width)
    return held.select("film_id", "id", "t_ms", "category", "decision", "score", "vec")


def as_lines(rows: DataFrame) -> DataFrame:
    """The rows as lines of JSON, in column value."""
    return rows.select(F.to_json(F.struct(F.lit(1).alias("schema"), "category", "decision", "score", F.col("vec").cast("array<double>").alias("vec"))).alias("value"))


def append_lines(lines: DataFrame, folder: str, batch: str) -> None:
    """Add lines to the store under the name of their batch; a batch that comes again takes the place of its first attempt."""
    lines.write.mode("overwrite").text(f"{folder}/batch={batch}")


def stored_lines(spark: SparkSession, folder: str) -> DataFrame:
    """All lines of the store, blank ones too; none if there is no store."""
    target, files = files_of(spark, folder)
    return spark.read.text(folder).select("value") if files.exists(target) else spark.createDataFrame([], "value string")


def read_lines(lines: DataFrame) -> DataFrame:
    """The store's rows by their columns; lines that are blank or no such rows are left out."""
    x = F.from_json("value", ROW, {"mode": "PERMISSIVE"})
    return lines.select(x.alias("x")).where("x.schema = 1 AND x.category IS NOT NULL AND x.decision IN ('accept', 'reject') AND x.score IS NOT NULL AND size(x.vec) > 0").select("x.*")


def forget_all(spark: SparkSession, folder: str) -> bool:
    """Delete the store; True if nothing is left of it."""
    target, files = files_of(spark, folder)
    return not files.exists(target) or files.delete(target, True)


def leaked(frames: DataFrame, cuts: DataFrame, width: int) -> DataFrame:
    """film_id and phash that a film's frames (film_id, t_ms, phash) have both inside its cuts (film_id, start_ms, end_ms) and outside them."""
    inside = point_join(frames.select("film_id", "t_ms", "phash"), cuts.select("film_id", "start_ms", "end_ms").where("end_ms > start_ms"), "t_ms", width).select("film_id", "t_ms", "phash").distinct()
    outside = frames.select("film_id", "t_ms", "phash").join(inside.select("film_id", "t_ms").distinct(), ["film_id", "t_ms"], "left_anti")
    return inside.select("film_id", "phash").intersect(outside.select("film_id", "phash"))


def hits(clicks: DataFrame, markers: DataFrame, view_start: int, view_end: int, width: int, grab: int = 5) -> DataFrame:
    """click_id, id, part: what clicks (click_id, film_id, x) in pixels of a band `width` wide hit of markers (film_id, id, start_ms, end_ms): start or end within `grab` pixels, or body; nulls where there is none.

    The last marker in order of start, end and id lies on top. Times are put on the band's pixels from first to last, those beyond the view on its edges."""
    px = lambda c: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col(c) - view_start) / (view_end - view_start))) * max(0, width - 1)).cast("long")
    bands = markers.select("film_id", "id", F.struct("start_ms", "end_ms", "id").alias("place"), px("start_ms").alias("x1"), px("end_ms").alias("x2"))
    bands = bands.withColumn("start_ms", F.col("x1") - grab).withColumn("end_ms", F.col("x2") + grab + 1)
    part = F.when(F.abs(F.col("x") - F.col("x1")) <= grab, "start").when(F.abs(F.col("x") - F.col("x2")) <= grab, "end").otherwise("body")
    met = point_join(clicks.select("click_id", "film_id", "x"), bands, "x", 64).groupBy("click_id").agg(F.max_by(F.struct("id", part.alias("part")), "place").alias("hit"))
    return clicks.select("click_id").join(met, "click_id", "left").select("click_id", "hit.id", "hit.part")
