"""Edit packs: rules of their JSON text, whole, and a store partitioned by film bucket.

A pack is {schema, film_id, fingerprint, author_pubkey, created_utc, cuts, comment?, sig?}; the fingerprint is of one of two kinds, times of keyframes or loud peaks with
hashes. The store is a Parquet table in versions, each partitioned by `bucket`, the film's id: a write makes a whole new version beside the current one and then names it in a pointer
file, so a reader sees either the old or the new, and a write that fails leaves the old.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import files_of
from .admission import _not

#: Fixed values of the pack format.
PACK_BYTES, CUTS, TIMES, PEAKS = 128 * 1024, 500, 20_000, 200
CATEGORY_LENGTH, REASON_LENGTH, COMMENT_LENGTH, OVERSHOOT_MS = 64, 512, 4096, 1000
FINGERPRINT_KINDS = ("keyframes", "audio_peak_gaps")
PACK_KEYS = {"schema", "film_id", "fingerprint", "author_pubkey", "created_utc", "cuts"}, {"comment", "sig"}
FINGERPRINT_KEYS = {"version", "type", "durationMs", "approxDurationMin"}, {"keyframeTimesMs", "peaks", "gapsMs", "innerSpanMs"}
PEAK_KEYS = {"t_ms", "phash"}, set()
CUT_KEYS = {"start_ms", "end_ms", "category"}, {"kind", "score", "reason"}

PEAK = "struct<t_ms:bigint,phash:string>"
FINGERPRINT = f"struct<version:bigint,type:string,durationMs:bigint,approxDurationMin:int,keyframeTimesMs:array<bigint>,peaks:array<{PEAK}>,gapsMs:array<bigint>,innerSpanMs:bigint>"
CUT = "struct<start_ms:bigint,end_ms:bigint,category:string,kind:string,score:float,reason:string>"
PACK = f"schema bigint, film_id string, fingerprint {FINGERPRINT}, author_pubkey string, created_utc bigint, cuts array<{CUT}>, comment string, sig string"


def _keys_fit(keys: Column, known: tuple[set[str], set[str]]) -> Column:
    """Whether keys are all that must be there, each once, and no others than may be."""
    must, may = (F.array(*map(F.lit, sorted(x))).cast("array<string>") for x in known)
    return F.coalesce((F.size(F.array_except(must, keys)) == 0) & (F.size(F.array_except(keys, F.concat(must, may))) == 0) & (F.size(F.array_distinct(keys)) == F.size(keys)), F.lit(False))


def _all_there(x: Column, names: set[str]) -> Column:
    out = F.lit(True)
    for name in sorted(names):
        out = out & x[name].isNotNull()
    return out


def fingerprint_error(fp: Column) -> Column:
    """The first rule that a fingerprint breaks, or null: kind, duration; then of keyframes times_empty, times_count, time by time times_range and times_order, exclusive; of peaks peaks_empty, peaks_count, peak by peak peak_time and phash, exclusive. A missing list is an empty one."""
    times, peaks, gaps = (F.coalesce(fp[n], F.array().cast(t)) for n, t in (("keyframeTimesMs", "array<bigint>"), ("peaks", f"array<{PEAK}>"), ("gapsMs", "array<bigint>")))
    last = fp["durationMs"] + OVERSHOOT_MS
    step = F.transform(times, lambda t, k: F.when(~t.between(0, last), "times_range").when(t < F.get(times, k - 1), "times_order"))
    peak = F.transform(peaks, lambda p: F.when(~p["t_ms"].between(0, last), "peak_time").when(~p["phash"].rlike("^([0-9a-fA-F]{16})?$") | p["phash"].contains("\n"), "phash"))

    def first(found: Column) -> Column:
        return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))

    frames = F.coalesce(F.when(F.size(times) == 0, "times_empty"), F.when(F.size(times) > TIMES, "times_count"), first(step), F.when((F.size(peaks) > 0) | (F.size(gaps) > 0), "exclusive"))
    sound = F.coalesce(F.when(F.size(peaks) == 0, "peaks_empty"), F.when(F.size(peaks) > PEAKS, "peaks_count"), first(peak), F.when(F.size(times) > 0, "exclusive"))
    return F.coalesce(F.when(~fp["type"].isin(*FINGERPRINT_KINDS), "fingerprint_kind"), F.when(fp["durationMs"] <= 0, "duration"), F.when(fp["type"] == FINGERPRINT_KINDS[0], frames).otherwise(sound))


def _cut_error(c: Column) -> Column:
    return (
        F.when((c["start_ms"] < 0) | (c["end_ms"] <= c["start_ms"]), "range")
        .when((F.length(c["category"]) == 0) | (F.length(c["category"]) > CATEGORY_LENGTH) | ~c["category"].rlike("^[A-Za-z0-9 /.-]*$") | c["category"].contains("\n"), "cut_category")
        .when(~c["score"].between(0, 1), "cut_score")
        .when(F.length(c["reason"]) > REASON_LENGTH, "reason")
    )


def pack_rules(packs: DataFrame, column: str = "raw") -> DataFrame:
    """packs with p, the pack of its JSON text, and verdict, the first rule it breaks or `ok`: size, json (another key at any level, a missing one, a field of another
    type, an unknown kind of cut), schema, film_id, author, those of its fingerprint, cuts (their number), cut by cut range, cut_category, cut_score and reason, then comment. Null texts are `json`."""
    text = F.col(column)
    maps = "array<map<string,string>>"
    p = packs.withColumn("p", F.from_json(text, PACK, {"allowNonNumericNumbers": "false"}))
    # each part of the text is read once, as a column of its own, however often the rules name it
    p = p.withColumn("_print", F.get_json_object(text, "$.fingerprint")).withColumn("_cuts", F.from_json(F.get_json_object(text, "$.cuts"), maps)).withColumn("_keys", F.json_object_keys(text))
    p = p.withColumn("_peaks", F.from_json(F.get_json_object("_print", "$.peaks"), maps)).withColumn("_inner", F.json_object_keys("_print"))
    x, fp, inner = F.col("p"), F.col("p.fingerprint"), F.col("_inner")
    lists = F.lit(True)
    for name in ("keyframeTimesMs", "peaks", "gapsMs"):
        has = F.array_contains(inner, name)
        lists = lists & (~has | (fp[name].isNotNull() & F.forall(fp[name], lambda v: v.isNotNull())))
    kinds = F.forall(x["cuts"], lambda c: c["kind"].isNull() | c["kind"].isin("confirmed", "suggested"))
    whole = (
        _keys_fit(F.col("_keys"), PACK_KEYS)
        & _all_there(x, PACK_KEYS[0])
        & _keys_fit(inner, FINGERPRINT_KEYS)
        & _all_there(fp, FINGERPRINT_KEYS[0])
        & lists
        & F.coalesce(F.forall("_peaks", lambda m: _keys_fit(F.map_keys(m), PEAK_KEYS)), F.lit(True))
        & F.coalesce(F.forall(fp["peaks"], lambda v: _all_there(v, PEAK_KEYS[0])), F.lit(True))
        & F.forall("_cuts", lambda m: _keys_fit(F.map_keys(m), CUT_KEYS))
        & F.forall(x["cuts"], lambda c: _all_there(c, CUT_KEYS[0]))
        & kinds
    )
    verdict = F.coalesce(
        F.when(F.octet_length(text) > PACK_BYTES, "size"),
        F.when(_not(whole), "json"),
        F.when(x["schema"] != 1, "schema"),
        F.when(~x["film_id"].rlike("^[A-Za-z0-9_-]{1,32}$") | x["film_id"].contains("\n"), "film_id"),
        F.when(~x["author_pubkey"].rlike("^[0-9a-fA-F]{64}$") | x["author_pubkey"].contains("\n"), "author"),
        fingerprint_error(fp),
        F.when(F.size(x["cuts"]) > CUTS, "cuts"),
        F.get(F.filter(F.transform(x["cuts"], _cut_error), lambda v: v.isNotNull()), F.lit(0)),
        F.when(F.length(x["comment"]) > COMMENT_LENGTH, "comment"),
        F.lit("ok"),
    )
    return p.withColumn("verdict", verdict).drop("_print", "_cuts", "_keys", "_peaks", "_inner")


STORED = "author string, created_utc long, raw string, bucket string"
POINTER = "CURRENT"


class PackStore:
    """Packs by film bucket and author, of which the last put stays, in a folder or, where that cannot be written, in a second one."""

    def __init__(self, spark: SparkSession, folder: str, fallback: str | None = None):
        self.spark, self.folder, self.fallback = spark, folder.rstrip("/"), fallback and fallback.rstrip("/")

    def _current(self, folder: str) -> str | None:
        target, files = files_of(self.spark, f"{folder}/{POINTER}")
        if not files.exists(target):
            return None
        return self.spark.read.text(f"{folder}/{POINTER}").first()[0]

    def place(self) -> str | None:
        """The folder that holds a version: the first that does."""
        return next((f for f in (self.folder, self.fallback) if f and self._current(f)), None)

    def raw(self) -> DataFrame:
        """All rows of the current version as they are stored: author, created_utc, raw, bucket."""
        place = self.place()
        if place is None:
            return self.spark.createDataFrame([], STORED)
        return self.spark.read.schema(STORED).parquet(f"{place}/{self._current(place)}")

    def read(self, films: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """Packs of some films (all, if none are named), and in a channel of their own the rows that are no longer packs of their bucket and author, with their verdict. Only the films' folders are listed and read."""
        rows = self.raw() if films is None else self.raw().where(F.col("bucket").isin(films))
        judged = pack_rules(rows)
        here = (F.col("verdict") == "ok") & (F.col("p.film_id") == F.col("bucket")) & (F.col("p.author_pubkey") == F.col("author"))
        judged = judged.withColumn("here", F.coalesce(here, F.lit(False)))
        good = judged.where("here").select("bucket", "author", "p.created_utc", "p.cuts", "p.comment", "p.fingerprint", "raw")
        bad = judged.where("NOT here").select("bucket", "author", F.when(F.col("verdict") == "ok", "misplaced").otherwise(F.col("verdict")).alias("verdict"), "raw")
        return good, bad

    def put(self, packs: DataFrame) -> tuple[str, bool]:
        """Add texts of packs (raw, arrival) that keep all rules; of one film and author the last to arrive replaces the others and the stored one. The version's folder, and whether it is in the second place.

        Buckets that get no pack are copied as they are stored, corrupt rows and all. Both places are tried; if neither can be written the error of the first is raised and what is stored stays."""
        judged = pack_rules(packs).where("verdict = 'ok'")
        new = judged.groupBy(F.col("p.film_id").alias("bucket"), F.col("p.author_pubkey").alias("author")).agg(F.max_by(F.struct(F.col("p.created_utc").alias("created_utc"), "raw"), "arrival").alias("b"))
        new = new.select("author", "b.created_utc", "b.raw", "bucket")
        kept = self.raw().join(new.select("bucket", "author"), ["bucket", "author"], "left_anti").select(*new.columns)
        return self._write(kept.unionByName(new))

    def _write(self, whole: DataFrame) -> tuple[str, bool]:
        """A new version of all rows in the first place that takes it."""
        failed = None
        for folder in filter(None, (self.folder, self.fallback)):
            version = f"v-{uuid.uuid4().hex}"
            try:
                whole.repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/{version}")
                self._point(folder, version)
            except Exception as e:  # whatever a file system or Spark says of a place that cannot be written
                failed = failed or e
                continue
            return f"{folder}/{version}", folder != self.folder
        raise failed

    def _point(self, folder: str, version: str) -> None:
        """Name the current version: the pointer is written aside and takes the old one's place by one rename."""
        aside, files = files_of(self.spark, f"{folder}/{POINTER}.{version}")
        out = files.create(aside, True)
        out.write(bytearray(version.encode()))
        out.close()
        target, _ = files_of(self.spark, f"{folder}/{POINTER}")
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(aside, target, options)


def repository_report(packs: DataFrame) -> DataFrame:
    """What a check of a repository reports of packs (film_id, malformed, signed, allowed): a row with a null film_id for all, with total, malformed, unsigned, not_allowed and films, and one for each film with its packs as total.

    Malformed packs belong to no film and are neither unsigned nor out of the list; flags that are null count as false."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = packs.select(F.when(~flag("malformed"), F.col("film_id")).alias("film_id"), flag("malformed").alias("malformed"), *((~flag("malformed") & ~flag(c)).alias(c) for c in ("signed", "allowed")))
    out = rows.rollup("film_id").agg(F.grouping("film_id").alias("all"), F.count(F.lit(1)).alias("total"), F.count_if("malformed").alias("malformed"), F.count_if("signed").alias("unsigned"), F.count_if("allowed").alias("not_allowed"), F.count_distinct("film_id").alias("films"))
    return out.where("all = 1 OR film_id IS NOT NULL").drop("all")
