"""Projects as JSON documents beside films: read with defaults, found at the first of two places, kept in a store of versions; endorsements that came in as lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .packs import PackStore
from .results import _INTEGER, _NUMBER, _TEXT, _kind, _list, _value

#: Defaults of a project's fields, and how much is read.
EXPORT = {"videoCodec": "libx264", "crf": 18, "preset": "medium", "audioCodec": "aac", "audioBitrateKbps": 192, "copyAllAudioTracks": False, "keyframeAlignedFast": False}
MARKER_AUTHORS, AUTHORS, ENTRIES = 50, 1000, 50
SOURCES, STATUSES = ("manual", "suggested", "imported"), ("confirmed", "pending", "rejected")
_FLAG = ("BOOLEAN",)
STORED = "name string, raw string, bucket string"


def places(path: Column, aside: str, suffix: str = ".project.json") -> Column:
    """struct<beside, aside>: where a film's project is looked for: beside the film, and in a folder by the first 16 digits of the SHA-256 of its path."""
    return F.struct(F.concat(path, F.lit(suffix)).alias("beside"), F.concat(F.lit(aside.rstrip("/") + "/"), F.substring(F.sha2(path, 256), 1, 16), F.lit(suffix)).alias("aside"))


def as_documents(projects: DataFrame, markers: DataFrame) -> DataFrame:
    """name, raw: projects (name, source_hash, duration_ms) with their markers (name, id, start_ms, end_ms, category, note, source, confidence, status) in order of start, end and id as JSON, with the defaults as export settings."""
    one = F.struct(F.col("id").cast("string").alias("id"), F.col("start_ms").alias("startMs"), F.col("end_ms").alias("endMs"), "category", "note", "source", "confidence", "status")
    lists = markers.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "id", one.alias("m")))), lambda x: x["m"]).alias("markers"))
    x = projects.join(lists, "name", "left")
    body = F.struct(F.lit(1).alias("schemaVersion"), F.col("name").alias("sourceFile"), F.col("source_hash").alias("sourceHash"), F.col("duration_ms").alias("durationMs"), F.coalesce("markers", F.from_json(F.lit("[]"), x.schema["markers"].dataType)).alias("markers"), F.struct(*(F.lit(v).alias(k) for k, v in EXPORT.items())).alias("exportSettings"))
    return x.select("name", F.to_json(body).alias("raw"))


def read_documents(docs: DataFrame) -> DataFrame:
    """docs (raw and others) with error (`json` or `shape`, else null), schema_version, source_file, source_hash, duration_ms, export and markers.

    Missing fields, and fields of another kind, take their defaults: a marker is manual, confirmed, of category Manual and confidence 1. Markers that are no objects are left out, of a marker's authors the first fifty that are texts are read.
    Sources and statuses that are unknown are manual and confirmed."""
    v = F.col("v")

    def marker(m: Column) -> Column:
        text = lambda path, default: _value(m, path, _TEXT, "string", F.lit(default))
        number = lambda path: _value(m, path, _INTEGER, "long", F.lit(0).cast("long"))
        authors = F.slice(F.filter(F.transform(_list(m, "$.contributingAuthors"), lambda a: F.when(_kind(a) == "STRING", F.try_variant_get(a, "$", "string"))), lambda a: a.isNotNull()), 1, MARKER_AUTHORS)
        source, status = text("$.source", "manual"), text("$.status", "confirmed")
        return F.struct(
            text("$.id", "").alias("id"), number("$.startMs").alias("start_ms"), number("$.endMs").alias("end_ms"), text("$.category", "Manual").alias("category"), text("$.note", "").alias("note"),
            F.when(source.isin(*SOURCES), source).otherwise("manual").alias("source"), _value(m, "$.confidence", _NUMBER, "double", F.lit(1.0)).alias("confidence"), F.when(status.isin(*STATUSES), status).otherwise("confirmed").alias("status"), authors.alias("authors"),
        )

    kinds = {str: (_TEXT, "string"), bool: (_FLAG, "boolean"), int: (_INTEGER, "long")}
    export = F.struct(*(_value(v, f"$.exportSettings.{k}", *kinds[type(d)], F.lit(d).cast(kinds[type(d)][1])).alias(k) for k, d in EXPORT.items()))
    read = docs.withColumn("v", F.try_parse_json("raw")).withColumn("error", F.when(v.isNull(), "json").when(_kind(v) != "OBJECT", "shape"))
    number = lambda path, default: _value(v, path, _INTEGER, "long", F.lit(default).cast("long"))
    out = {
        "schema_version": number("$.schemaVersion", 1), "source_file": _value(v, "$.sourceFile", _TEXT, "string", F.lit("")), "source_hash": _value(v, "$.sourceHash", _TEXT, "string", F.lit("")),
        "duration_ms": number("$.durationMs", 0), "export": export, "markers": F.transform(F.filter(_list(v, "$.markers"), lambda m: _kind(m) == "OBJECT"), marker),
    }
    return read.select(*docs.columns, "error", *(F.when(F.col("error").isNull(), c).alias(k) for k, c in out.items()))


def projects_of(films: DataFrame, docs: DataFrame, aside: str) -> DataFrame:
    """films (path, ...) with place (`beside`, `aside` or null), error and the project of the first of their two places that holds one without error; error is that of the place beside the film, or else that of the other, where none is whole."""
    found = read_documents(docs.select("place", "raw")).drop("raw")
    rows = films.withColumn("_at", F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(n).alias("kind"), places(F.col("path"), aside)[n].alias("at")) for k, n in enumerate(("beside", "aside"))))))
    rows = rows.join(found.withColumnRenamed("place", "_place"), F.col("_at.at") == F.col("_place"), "left")
    whole = F.col("_place").isNotNull() & F.col("error").isNull()
    fields = [c for c in found.columns if c != "place"]
    best = F.min_by(F.struct(F.when(whole, F.col("_at.kind")).alias("place"), *fields), F.struct(F.when(whole, 0).when(F.col("_place").isNotNull(), 1).otherwise(2).alias("w"), F.col("_at.k").alias("k")))
    return rows.groupBy(*films.columns).agg(best.alias("b")).select(*films.columns, "b.*")


class ProjectStore(PackStore):
    """Documents of projects by name, of which the last put stays, in 256 buckets; versions, their two places and the pointer are those of packs."""

    @staticmethod
    def bucket(name: Column) -> Column:
        return F.substring(F.sha2(name, 256), 1, 2)

    def raw(self) -> DataFrame:
        """All rows of the current version: name, raw, bucket."""
        place = self.place()
        if place is None:
            return self.spark.createDataFrame([], STORED)
        return self.spark.read.schema(STORED).parquet(f"{place}/{self._current(place)}")

    def read(self, names: list[str] | None = None) -> DataFrame:
        """Projects of some films (all, if none are named) as read_documents gives them; only these films' buckets are read."""
        rows = self.raw()
        if names is not None:
            buckets = [r[0] for r in self.spark.createDataFrame([(n,) for n in names], "name string").select(self.bucket(F.col("name"))).distinct().collect()] if names else []
            rows = rows.where(F.col("bucket").isin(buckets) & F.col("name").isin(names))
        return read_documents(rows.select("name", "raw"))

    def put(self, docs: DataFrame) -> tuple[str, bool]:
        """Add documents (name, raw, arrival); of one name the last to arrive replaces the others and the stored one. Rows without a name are refused. Returns the version's folder, and whether it is in the second place."""
        new = docs.where("name IS NOT NULL").groupBy("name").agg(F.max_by("raw", "arrival").alias("raw")).withColumn("bucket", self.bucket(F.col("name")))
        kept = self.raw().join(new.select("name"), "name", "left_anti").select("name", "raw", "bucket")
        return self._write(kept.unionByName(new))


def inbound(lines: DataFrame) -> DataFrame:
    """author, target, score of lines (ord, value) {peer_key, entries: [{target, score}]} of endorsements that came in, an author's last line in place of the earlier ones.

    Of a line the first fifty different targets are read, the last score of each; entries that are no objects or without a target are passed over, a missing score is 0; lines with a target or score of another kind, without author or
    targets are skipped. Reading ends, in the order of ord, before the line at which 1,000 authors or 50,000 entries are there: so the first 50,000 lines are all that can count, and only they are put in order."""
    v = F.col("v")

    def add(acc: Column, e: Column) -> Column:
        target, score = F.try_variant_get(e, "$.target", "variant"), F.try_variant_get(e, "$.score", "variant")
        bad = ~_kind(target).isin("STRING", "VOID") | ~_kind(score).isin(*_NUMBER, "VOID")
        name, value = F.coalesce(F.try_variant_get(e, "$.target", "string"), F.lit("")), F.coalesce(F.try_variant_get(e, "$.score", "double"), F.lit(0.0))
        rest = F.filter(acc["got"], lambda x: x["target"] != name)
        read = F.struct(F.when(bad | (name == ""), acc["got"]).otherwise(F.array_append(rest, F.struct(name.alias("target"), value.alias("score")))).alias("got"), (acc["bad"] | bad).alias("bad"))
        return F.when((F.size(acc["got"]) >= ENTRIES) | (_kind(e) != "OBJECT"), acc).otherwise(read)

    start = F.struct(F.array().cast("array<struct<target:string,score:double>>").alias("got"), F.lit(False).alias("bad"))
    read = lines.select("ord", F.try_parse_json("value").alias("v")).select("ord", _value(v, "$.peer_key", _TEXT, "string", F.lit("")).alias("author"), F.aggregate(_list(v, "$.entries"), start, add).alias("x"))
    good = read.where("author <> '' AND NOT x.bad AND size(x.got) > 0").select("ord", "author", F.col("x.got").alias("got")).orderBy("ord").limit(AUTHORS * ENTRIES)
    first = F.row_number().over(W.partitionBy("author").orderBy("ord")) == 1
    before = W.orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    kept = good.withColumn("first", first.cast("int")).withColumn("authors", F.coalesce(F.sum("first").over(before), F.lit(0))).withColumn("entries", F.coalesce(F.sum(F.size("got")).over(before), F.lit(0)))
    last = kept.where((F.col("authors") < AUTHORS) & (F.col("entries") < AUTHORS * ENTRIES)).groupBy("author").agg(F.max_by("got", "ord").alias("got"))
    return last.select("author", F.explode("got").alias("e")).select("author", "e.target", "e.score")
