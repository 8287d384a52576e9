"""Readers of documents that may be broken: recipes, analysis results, loudness logs; and merged suggestions with their reasons, in order.

A document is a row (name, raw); what cannot be read comes out by name in `error`, and never stops the others. JSON is read as a variant first, so that a value of another type than the
wanted one counts as missing and not as an error of the whole.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import small_arrow_batches
from .trust import running_sum

#: Fixed values of the result format.
MOST_KEYFRAMES, MOST_PEAKS, MOST_AUTHORS = 20_000, 200, 50
DETECTOR = "struct<id:string,weight:double,params:struct<labels:array<string>>>"
CATEGORY = f"struct<name:string,enabled:boolean,threshold:double,padBeforeMs:bigint,padAfterMs:bigint,maxDurationMs:bigint,detectors:array<{DETECTOR}>>"


def _kind(v: Column) -> Column:
    """Type of a variant's value, without what it holds; VOID for null or none."""
    return F.coalesce(F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0), F.lit("VOID"))


def _list(v: Column, path: str) -> Column:
    """The values of an array at a path, as variants; empty where it is something else, which the cast tells without a look at the values."""
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _texts(v: Column, path: str) -> Column:
    """The texts of an array at a path. Of what JSON holds only texts become binary, so that no value's type is spelled out."""
    found = F.coalesce(F.try_variant_get(v, path, "array<binary>"), F.array().cast("array<binary>"))
    return F.transform(F.filter(found, lambda x: x.isNotNull()), lambda x: x.cast("string"))


def whole_numbers(*path: str):
    """An Arrow UDF: the whole numbers of 64 bits in an array at a path of texts that were read as JSON before; empty where there is none. Lists of thousands of numbers are too long for a cast of each variant."""
    @F.arrow_udf("array<long>")
    def find(texts: pa.Array) -> pa.Array:
        read, out = json.JSONDecoder(strict=False).raw_decode, []  # what follows the document is passed over, as when it was read before
        for text in texts.to_pylist():
            at = read(text.lstrip("\ufeff \t\r\n"))[0] if text is not None else None
            for name in path:
                at = at.get(name) if isinstance(at, dict) else None
            out.append([x for x in at if type(x) is int and -(1 << 63) <= x < 1 << 63] if isinstance(at, list) else [])
        return pa.array(out, pa.list_(pa.int64()))

    return find.asNondeterministic()  # so that the optimizer does not evaluate it again


def _is_object(v: Column) -> Column:
    """Whether a variant is an object, which the cast tells without a look at the types of what it holds."""
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def _value(v: Column, path: str, kinds: tuple[str, ...], to: str, default: Column) -> Column:
    """A value at a path if it is of one of the kinds."""
    return F.coalesce(F.when(_kind(F.try_variant_get(v, path, "variant")).isin(*kinds), F.try_variant_get(v, path, to)), default)


_INTEGER, _NUMBER, _TEXT = ("BIGINT",), ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), ("STRING",)


def recipes(docs: DataFrame) -> DataFrame:
    """Rows of recipe documents: name, error, position, category, enabled, threshold, pads and longest run, det_ord, det_id, weight, label_ord, label.

    A document is {"categories": [...]} or a bare list; else it is one row with its error, `json` or `shape`. Categories are enabled unless they say false; a detector without labels has one row with a null label, a category without detectors one with nulls.
    An empty list gives no row."""
    v = F.try_parse_json("raw")
    read = docs.withColumn("v", v).withColumn("top", _kind(F.col("v")))
    inner = F.try_variant_get("v", "$.categories", "variant")
    read = read.withColumn("list", F.when(F.col("top") == "ARRAY", F.to_json("v")).when((F.col("top") == "OBJECT") & (_kind(inner) == "ARRAY"), F.to_json(inner)))
    read = read.withColumn("error", F.when(F.col("v").isNull(), "json").when(F.col("list").isNull(), "shape"))
    cats = read.select("name", "error", F.posexplode_outer(F.when(F.col("error").isNull(), F.from_json("list", f"array<{CATEGORY}>"))).alias("position", "c")).where("error IS NOT NULL OR c IS NOT NULL")
    dets = cats.select("name", "error", "position", "c", F.posexplode_outer("c.detectors").alias("det_ord", "d"))
    return dets.select(
        "name", "error", F.col("position").cast("long").alias("position"), F.col("c.name").alias("category"), F.when(F.col("c").isNotNull(), F.coalesce("c.enabled", F.lit(True))).alias("enabled"), F.col("c.threshold").alias("threshold"),
        F.col("c.padBeforeMs").alias("pad_before_ms"), F.col("c.padAfterMs").alias("pad_after_ms"), F.col("c.maxDurationMs").alias("max_duration_ms"),
        F.col("det_ord").cast("long").alias("det_ord"), F.col("d.id").alias("det_id"), F.col("d.weight").alias("weight"), F.posexplode_outer("d.params.labels").alias("label_ord", "label"),
    )


def required_labels(rows: DataFrame, det_id: str) -> DataFrame:
    """Labels that the enabled categories of each document need of a detector, with their place by first use, from 0."""
    used = rows.where((F.col("det_id") == det_id) & F.col("enabled") & F.col("label").isNotNull())
    first = used.groupBy("name", "label").agg(F.min(F.struct("position", "det_ord", "label_ord")).alias("first"))
    return first.select("name", "label", (F.row_number().over(W.partitionBy("name").orderBy("first")) - 1).cast("long").alias("place"))


def scaled_thresholds(rows: DataFrame, sensitivities: list[float]) -> DataFrame:
    """Thresholds of each document's categories under sensitivities: the multiplier, one over it, is kept in [0.25, 4], the threshold in [0, 1]."""
    rules = rows.where("category IS NOT NULL AND threshold IS NOT NULL").select("name", "position", "category", "threshold").distinct()
    each = rules.withColumn("sensitivity", F.explode(F.array(*map(F.lit, sensitivities))))
    mul = F.least(F.greatest(1 / F.col("sensitivity"), F.lit(0.25)), F.lit(4.0))
    return each.withColumn("threshold", F.round(F.least(F.greatest(F.col("threshold") * mul, F.lit(0.0)), F.lit(1.0)), 6))


def results(docs: DataFrame) -> DataFrame:
    """Analysis results (name, raw): name, error, schema_version, duration_ms, kind, keyframes, peaks, suggestions.

    Of keyframes whole numbers count, the first MOST_KEYFRAMES; of peaks objects, the first MOST_PEAKS, each only in a fingerprint of their kind; suggestions with an empty range or
    category are dropped, their reasons are texts, their authors the first MOST_AUTHORS texts. A document that is not JSON has error `json`, one that is no object gives defaults."""
    small_arrow_batches(docs.sparkSession)
    v, kind = F.col("v"), F.col("kind")
    read = docs.withColumn("v", F.try_parse_json("raw")).withColumn("kind", _value(v, "$.fingerprint.type", _TEXT, "string", F.lit("")))
    read = read.withColumn("_timed", F.when(v.isNotNull() & (kind == "keyframes"), F.col("raw"))).withColumn("_whole", whole_numbers("fingerprint", "keyframeTimesMs")("_timed"))
    peaks = F.transform(F.filter(_list(v, "$.fingerprint.peaks"), _is_object), lambda x: F.struct(_value(x, "$.tMs", _INTEGER, "bigint", F.lit(0)).alias("t_ms"), _value(x, "$.phash", _TEXT, "string", F.lit("")).alias("phash")))

    made = F.transform(
        F.filter(_list(v, "$.suggestions"), _is_object),
        lambda x: F.struct(
            _value(x, "$.category", _TEXT, "string", F.lit("")).alias("category"), _value(x, "$.startMs", _INTEGER, "bigint", F.lit(0)).alias("start_ms"), _value(x, "$.endMs", _INTEGER, "bigint", F.lit(0)).alias("end_ms"),
            _value(x, "$.score", _NUMBER, "double", F.lit(0.0)).alias("score"), _texts(x, "$.reasons").alias("reasons"), F.slice(_texts(x, "$.contributingAuthors"), 1, MOST_AUTHORS).alias("authors"),
        ),
    )
    return read.select(
        "name", F.when(v.isNull(), "json").alias("error"), _value(v, "$.schemaVersion", _INTEGER, "bigint", F.lit(1)).alias("schema_version"), _value(v, "$.durationMs", _INTEGER, "bigint", F.lit(0)).alias("duration_ms"), "kind",
        F.slice("_whole", 1, MOST_KEYFRAMES).alias("keyframes"),
        F.when(kind == "audio_peak_gaps", F.slice(peaks, 1, MOST_PEAKS)).otherwise(F.array().cast("array<struct<t_ms:bigint,phash:string>>")).alias("peaks"),
        F.filter(made, lambda s: (s["end_ms"] > s["start_ms"]) & (s["category"] != "")).alias("suggestions"),
    )


def lufs(text: Column) -> Column:
    """A loudness as the log writes it; -120 for what is no number, not a number, or lower."""
    x = text.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (x < -120), -120.0).otherwise(x)


def loudness_log(lines: DataFrame) -> DataFrame:
    """Lines (file, seq, line) of a meter's log as file, idx, momentary, short_term: its readings in order of seq; all other lines, such as those of other programs in between, are passed over.

    A reading has the fields t, perhaps TARGET, M and S in this order on one line, and may follow other text on it."""
    number = r"([-\d.+]+|nan|-inf)"
    pattern = rf"t:\s*([-\d.]+)\s+(?:TARGET:\s*[-\d.]+\s*LUFS\s+)?M:\s*{number}\s+S:\s*{number}"
    read = lines.where(F.col("line").rlike(pattern))
    nth = F.row_number().over(W.partitionBy("file").orderBy("seq")) - 1
    return read.select("file", nth.cast("long").alias("idx"), lufs(F.regexp_extract("line", pattern, 2)).alias("momentary"), lufs(F.regexp_extract("line", pattern, 3)).alias("short_term"))


def peak_reason(score: Column) -> Column:
    """What a run says of its score, rounded to two decimals, halves up."""
    hundredths = F.floor((F.round(score * 1_000_000_000).cast("long") + 5_000_000) / 10_000_000)
    return F.concat(F.lit("fused score peaked at "), F.floor(hundredths / 100).cast("string"), F.lit("."), F.lpad((hundredths % 100).cast("string"), 2, "0"))


def merged_reasons(found: DataFrame, gap_ms: int) -> DataFrame:
    """Runs (film_id, category, start_ms, end_ms, score, reasons, arrival) of one category of a film that overlap or lie at most gap_ms apart as one, with the best score and the reasons of all, in order of start, end and arrival; place is the number of a merged run
    in its film by start and end, of equals that whose category arrived first in the film, from 0."""
    w = W.partitionBy("film_id", "category").orderBy("start_ms", "end_ms", "arrival")
    reach = F.max("end_ms").over(w.rowsBetween(W.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start_ms") - reach > gap_ms), 1).otherwise(0)
    first = F.min("arrival").over(W.partitionBy("film_id", "category"))
    rows = found.withColumn("new", new).withColumn("first", first).withColumn("part", F.sum("new").over(w))
    said = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "arrival", F.coalesce("reasons", F.array().cast("array<string>")).alias("reasons")))), lambda x: x["reasons"]))
    merged = rows.groupBy("film_id", "category", "part").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.max("score").alias("score"), said.alias("reasons"), F.min("first").alias("first"))
    place = F.row_number().over(W.partitionBy("film_id").orderBy("start_ms", "end_ms", "first", "part")) - 1
    return merged.withColumn("place", place.cast("long")).drop("part", "first")


def pending_markers(suggestions: DataFrame) -> DataFrame:
    """Suggestions as markers that wait for a decision: their reasons are the note."""
    return suggestions.select("film_id", "place", "start_ms", "end_ms", "category", F.array_join("reasons", " · ").alias("note"), F.lit("suggested").alias("source"), F.lit("pending").alias("status"), F.col("score").alias("confidence"))


def in_order(markers: DataFrame, arrival: str) -> DataFrame:
    """Markers with ordinal, their place among all, from 0: by film and start, of equal starts the last to arrive first, as each new one is put before them. A sort in ranges; no task holds all markers or a film's."""
    return running_sum(markers.withColumn("_late", -F.col(arrival)).withColumn("_one", F.lit(1).cast("long")), ["film_id", "start_ms", "_late"], "_one", "ordinal").withColumn("ordinal", F.col("ordinal") - 1).drop("_late", "_one")
