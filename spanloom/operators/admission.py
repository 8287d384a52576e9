"""Admission of untrusted rows: validators with the first broken rule, allow lists, caps, repository checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written
from .vectors import quantised_digest

#: Fixed values of the row format.
KEYS = ("schema", "category", "decision", "score", "vec")
ROW_BYTES = 16 * 1024
DIMENSIONS = (512, 768, 1024)
VALUE_LIMIT, NORM_TOLERANCE = 1.5, 0.05
CATEGORY_LENGTH = 64
CATEGORY = "^[A-Za-z0-9 /.-]*$"
BUILT_IN = ("Jump scare", "Screaming", "Crying / sad", "Yelling", "Gunfire", "Hitting / impacts", "Sword fight", "Chase", "Violence (general)", "Cruelty", "Pushing", "Kill / threat")
OUTCOMES = ("accepted", "deduped", "rate_limited", "over_cap", "bad_format", "proposed", "proposed_dropped")


@dataclass(frozen=True)
class Limits:
    """Caps of the two stores that admitted rows go to."""

    total_bytes: int = 50 << 20
    peer_day_rows: int = 200
    proposed_bytes: int = 5 << 20
    proposed_categories: int = 100
    category_samples: int = 50


def parsed(lines: DataFrame, column: str = "line") -> DataFrame:
    """Rows of JSON text with their fields, and whether the text is an object of just the known keys, each once."""
    j = F.from_json(F.col(column), "schema bigint, category string, decision string, score float, vec array<float>", {"allowNonNumericNumbers": "false"})
    known = F.array(*(F.lit(k) for k in KEYS))
    keys = F.json_object_keys(column)
    return lines.withColumn("r", j).withColumn("strict", F.coalesce((F.size(keys) == len(KEYS)) & (F.size(F.array_except(keys, known)) == 0), F.lit(False)))


def row_error(max_bytes: int = ROW_BYTES, column: str = "line", dimensions: tuple[int, ...] = DIMENSIONS) -> Column:
    """The first rule that a parsed row breaks, or `ok`: size, json (another key, a missing one, a field of another type, a decision other than accept or
    reject), schema, category_length, category, score, dimension, value, norm."""
    r = F.col("r")
    complete = r["schema"].isNotNull() & r["category"].isNotNull() & r["decision"].isin("accept", "reject") & r["score"].isNotNull() & r["vec"].isNotNull()
    norm = F.sqrt(F.aggregate(r["vec"], F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).cast("float")
    return F.coalesce(
        F.when(F.octet_length(column) > max_bytes, "size"),
        F.when(_not(F.col("strict") & complete & F.forall(r["vec"], lambda x: x.isNotNull())), "json"),
        F.when(r["schema"] != 1, "schema"),
        F.when(F.length(r["category"]) > CATEGORY_LENGTH, "category_length"),
        F.when((r["category"] == "") | ~r["category"].rlike(CATEGORY) | r["category"].contains("\n"), "category"),
        F.when(_not(r["score"].between(0, 1)), "score"),
        F.when(_not(F.size(r["vec"]).isin(*dimensions)), "dimension"),
        F.when(_not(F.forall(r["vec"], lambda x: F.abs(x) <= VALUE_LIMIT)), "value"),
        F.when(F.abs(norm - 1) > NORM_TOLERANCE, "norm"),
        F.lit("ok"),
    )


def judged(lines: DataFrame, accepted: DataFrame, max_bytes: int = ROW_BYTES) -> DataFrame:
    """Lines (seq, peer, day, line) with what admission asks of them: verdict, digest of the quantised vector, category, whether it is an accepted one (built in, or
    a name of `accepted`, letter by letter), decision, the line as it would be stored, and its bytes with the line end."""
    rows = parsed(lines).withColumn("verdict", row_error(max_bytes))
    ok = F.col("verdict") == "ok"
    rows = rows.withColumn("digest", F.when(ok, quantised_digest(F.col("r.vec")))).withColumn("category", F.when(ok, F.col("r.category"))).withColumn("decision", F.when(ok, F.col("r.decision")))
    names = accepted.select(F.col("name").alias("category")).where("category IS NOT NULL").distinct().withColumn("named", F.lit(True))
    rows = rows.join(names, "category", "left").withColumn("known", F.coalesce(F.col("named") | F.col("category").isin(*BUILT_IN), F.lit(False)))
    stored = F.when(ok, F.concat(F.lit('{"peer_key":"'), "peer", F.lit('","fingerprint":"'), "digest", F.lit('","day_utc":'), F.col("day").cast("string"), F.lit(","), F.expr("substring(trim(BOTH ' \t\n\r' FROM line), 2)")))
    return rows.withColumn("stored", stored).withColumn("bytes", F.octet_length("stored").cast("long") + 1).drop("r", "strict", "named")


def _not(rule: Column) -> Column:
    """Whether a rule does not hold; a rule on a missing value does not."""
    return ~F.coalesce(rule, F.lit(False))


def newest_within(lines: DataFrame, most_bytes: int) -> DataFrame:
    """The newest whole lines of each file that fit into most_bytes, line ends included; the first that does not fit stops it."""
    w = W.partitionBy("file").orderBy(F.desc("seq")).rowsBetween(W.unboundedPreceding, 0)
    return lines.withColumn("upto", F.sum(F.octet_length("line") + 1).over(w)).where(F.col("upto") <= most_bytes).drop("upto")


def allow_list(lines: DataFrame) -> DataFrame:
    """key and whether each line is a key of 64 hex digits: comments from # on and white space do not count, empty lines are left out."""
    plain = lines.select(F.lower(F.trim(F.regexp_replace("line", "#.*$", ""))).alias("key")).where("key <> ''")
    return plain.withColumn("valid", F.col("key").rlike("^[0-9a-f]{64}$"))


def gate(packs: DataFrame, allow: DataFrame) -> DataFrame:
    """packs (author, signed, ...) with their outcome: forbidden, unsigned or accepted. An empty allow list (author) lets all authors through."""
    listed = allow.select("author").where("author IS NOT NULL").distinct().withColumn("listed", F.lit(True))
    any_ = allow.agg((F.count("author") > 0).alias("closed"))
    rows = packs.join(listed, "author", "left").join(F.broadcast(any_))  # one row
    outcome = F.when(F.col("closed") & F.col("listed").isNull(), "forbidden").when(_not(F.col("signed")), "unsigned").otherwise("accepted")
    return rows.withColumn("outcome", outcome).drop("listed", "closed")


SLIM = "seq long, peer string, day int, digest string, category string, known boolean, bytes long"


def _pass(limits: Limits, before: dict) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows in order of seq; gives those that are registered, and once, with a null seq, that a row was refused for the bytes of the first store."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        counts, samples = dict(before["counts"]), dict(before["samples"])
        held, proposed, capped = before["bytes"], before["proposed_bytes"], False
        for batch in batches:
            keep = []
            for k, r in enumerate(batch.to_pylist()):
                slot = (r["peer"], r["day"])
                if r["digest"] in seen or counts.get(slot, 0) >= limits.peer_day_rows:
                    continue
                if r["known"]:
                    if held + r["bytes"] > limits.total_bytes:
                        capped = True
                        continue
                    held += r["bytes"]
                    counts[slot] = counts.get(slot, 0) + 1
                else:
                    had = samples.get(r["category"], 0)
                    if had >= limits.category_samples or (not had and len(samples) >= limits.proposed_categories) or proposed + r["bytes"] > limits.proposed_bytes:
                        continue
                    proposed += r["bytes"]
                    samples[r["category"]] = had + 1
                seen.add(r["digest"])
                keep.append(k)
            yield batch.take(pa.array(keep, pa.int64()))
        if capped:
            yield pa.record_batch([pa.array([None], f.type) for f in batch.schema], schema=batch.schema)

    return run


def _state(stored: DataFrame | None) -> dict:
    """Counts and bytes of stored rows. The caps bound them: some ten thousand rows at most."""
    if stored is None:
        return {"counts": {}, "samples": {}, "bytes": 0, "proposed_bytes": 0}
    counts = {(r["peer"], r["day"]): r["n"] for r in stored.where("known").groupBy("peer", "day").agg(F.count(F.lit(1)).alias("n")).collect()}
    samples = {r["category"]: r["n"] for r in stored.where("NOT known").groupBy("category").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = stored.agg(F.sum(F.when(F.col("known"), F.col("bytes"))).alias("a"), F.sum(F.when(~F.col("known"), F.col("bytes"))).alias("p")).first()
    return {"counts": counts, "samples": samples, "bytes": size["a"] or 0, "proposed_bytes": size["p"] or 0}


def admit(rows: DataFrame, limits: Limits = Limits(), stored: DataFrame | None = None) -> DataFrame:  # noqa: B008
    """Judged rows (seq, peer, day, digest, category, known, bytes, verdict) with their outcome, as if each were tried in order of seq, which is unique, after the stored ones (peer, day, digest, category, known, bytes).

    A valid row is deduped if its digest is registered, rate_limited if its peer has registered its day's number of accepted rows, then accepted or, where the bytes
    would exceed their cap, over_cap; of a category that is not known it is proposed, or proposed_dropped where a cap on samples of the category, categories
    or bytes is reached. Only accepted and proposed rows register anything. Seven outcomes, of which bad_format is that of all other rows.

    What is registered only grows, so a row that was refused would be refused at any later time. Hence of rows alike in all that counts only the first can be
    registered; and none of a peer's day after as many known rows of digests not seen before as the day allows. The rest, without texts and
    vectors, is taken in order by one task, which holds what is registered; that is bounded by the caps. If it refuses a row for the bytes of the first store, the second bound does not hold
    (rows that it counted are not registered), and the pass is taken again without it. All other outcomes follow from what is registered, by joins; no group of copies or of
    one peer's rows meets in one task.

    Nulls: a null peer, day or category is a value like others; rows with a null seq are tried first."""
    valid = written(rows.where("verdict = 'ok'").select("seq", F.col("peer").cast("string").alias("peer"), F.col("day").cast("int").alias("day"), "digest", "category", "known", F.col("bytes").cast("long").alias("bytes")), "valid")
    keys = valid.groupBy("digest", "peer", "day", "category", "known", "bytes").agg(F.min("seq").alias("seq"))
    if stored is not None:
        keys = keys.join(stored.select("digest").distinct(), "digest", "left_anti")
    keys = written(keys, "candidates")
    firsts = keys.groupBy("digest").agg(F.min_by(F.struct("seq", "peer", "day", "known"), "seq").alias("f")).select("f.*").where("known")
    nth = F.row_number().over(W.partitionBy("peer", "day").orderBy("seq"))
    full = firsts.withColumn("nth", nth).where(F.col("nth") == limits.peer_day_rows).select("peer", "day", F.col("seq").alias("full"))
    near = keys.join(full, keys["peer"].eqNullSafe(full["peer"]) & keys["day"].eqNullSafe(full["day"]), "left").where("full IS NULL OR seq <= full").select(keys["*"])
    before = _state(stored)

    def registered(candidates: DataFrame, label: str) -> DataFrame:
        slim = candidates.select(*(c.split()[0] for c in SLIM.split(", ")))
        return written(slim.repartition(1).sortWithinPartitions("seq").mapInArrow(_pass(limits, before), SLIM), label)

    got = registered(near, "registered")
    if got.where("bytes IS NULL").limit(1).count():
        got = registered(keys, "registered-all")
    got = got.where("bytes IS NOT NULL")
    by_digest = got.select("digest", F.col("seq").alias("at"))
    if stored is not None:
        by_digest = by_digest.unionByName(stored.select("digest", F.lit(-(1 << 62)).cast("long").alias("at")).distinct())
    days = got.where("known").select("peer", "day", F.col("seq").alias("s"))
    if stored is not None:
        days = days.unionByName(stored.where("known").select(F.col("peer").cast("string").alias("peer"), F.col("day").cast("int").alias("day"), F.lit(-(1 << 62)).cast("long").alias("s")))
    filled = days.withColumn("nth", F.row_number().over(W.partitionBy("peer", "day").orderBy("s"))).where(F.col("nth") == limits.peer_day_rows).select(F.col("peer").alias("p"), F.col("day").alias("d"), F.col("s").alias("filled"))
    told = valid.join(by_digest, "digest", "left").join(filled, F.col("peer").eqNullSafe(F.col("p")) & F.col("day").eqNullSafe(F.col("d")), "left")
    outcome = (
        F.when(F.col("seq") == F.col("at"), F.when(F.col("known"), "accepted").otherwise("proposed"))
        .when(F.col("at") < F.col("seq"), "deduped")
        .when(F.col("filled") < F.col("seq"), "rate_limited")
        .when(F.col("known"), "over_cap")
        .otherwise("proposed_dropped")
    )
    return rows.select("seq", "peer", "day").join(told.select("seq", outcome.alias("outcome")), "seq", "left").withColumn("outcome", F.coalesce("outcome", F.lit("bad_format")))


#: Fixed values of the endorsement format.
BATCH_BYTES, BATCH_ENTRIES, FIRST_DAY, LAST_DAY, MOST_SCORE = 8 * 1024, 50, 20240101, 22000101, 2.0
BATCH_KEYS = ("schema", "kind", "day_utc", "entries")
ENTRY_KEYS = ("target", "score")


def endorsement_error(column: str) -> Column:
    """The first rule that the JSON text of an endorsement batch breaks, or `ok`: size, json, schema, kind, day, count; then entry by entry target, score, twice (a target that came before)."""
    j = F.from_json(F.col(column), "schema bigint, kind string, day_utc bigint, entries array<struct<target:string,score:float>>", {"allowNonNumericNumbers": "false"})
    parts = F.from_json(F.get_json_object(F.col(column), "$.entries"), "array<map<string,string>>")

    def just(keys: Column, known: tuple[str, ...]) -> Column:
        return F.coalesce((F.size(keys) == len(known)) & (F.size(F.array_except(keys, F.array(*map(F.lit, known)))) == 0), F.lit(False))

    whole = just(F.json_object_keys(column), BATCH_KEYS) & j["schema"].isNotNull() & j["kind"].isNotNull() & j["day_utc"].isNotNull() & j["entries"].isNotNull()
    entries = F.forall(parts, lambda e: just(F.map_keys(e), ENTRY_KEYS)) & F.forall(j["entries"], lambda e: e["target"].isNotNull() & e["score"].isNotNull())
    targets = F.transform(j["entries"], lambda e: e["target"])

    def broken(e: Column, k: Column) -> Column:
        return (
            F.when(~e["target"].rlike("^[0-9a-f]{64}$") | (F.length(e["target"]) != 64), "target")
            .when(~e["score"].between(0, MOST_SCORE), "score")
            .when(F.array_position(targets, e["target"]) <= k, "twice")
        )

    first = F.filter(F.transform(j["entries"], broken), lambda x: x.isNotNull())
    return F.coalesce(
        F.when(F.octet_length(column) > BATCH_BYTES, "size"),
        F.when(_not(whole & entries), "json"),
        F.when(j["schema"] != 1, "schema"),
        F.when(j["kind"] != "endorsements", "kind"),
        F.when(_not(j["day_utc"].between(FIRST_DAY, LAST_DAY)), "day"),
        F.when(F.size(j["entries"]) > BATCH_ENTRIES, "count"),
        F.get(first, F.lit(0)),
        F.lit("ok"),
    )


LEAST_WEIGHT, UNSEEN_WEIGHT = 0.05, 0.1


def stored_feedback(rows: DataFrame) -> DataFrame:
    """Stored rows (stored, peer) as decisions for the next analysis: row_id, author, accepted, vec. Lines that are no rows are left out; row_id is a hash of the line and its author."""
    r = F.from_json("stored", "decision string, vec array<float>")
    read = rows.select(F.xxhash64("peer", "stored").alias("row_id"), F.col("peer").alias("author"), r.alias("r")).where("r.decision IN ('accept', 'reject') AND r.vec IS NOT NULL")
    return read.select("row_id", "author", (F.col("r.decision") == "accept").alias("accepted"), F.col("r.vec").alias("vec"))


def feedback_weights(decided: DataFrame, trust: DataFrame) -> DataFrame:
    """row_id and weight of decisions: 1 for one's own (a null author), the author's trust (author, score, n) after a decision on it, UNSEEN_WEIGHT without; rows under LEAST_WEIGHT are left out."""
    known = trust.where("n > 0").select("author", "score")
    weight = F.when(F.col("author").isNull(), 1.0).otherwise(F.coalesce("score", F.lit(UNSEEN_WEIGHT)))
    return decided.join(known, "author", "left").select("row_id", weight.alias("weight")).where(F.col("weight") >= LEAST_WEIGHT)
