"""Fingerprints that are trials beside the two in use: hashes at places of a film's body as one digest (versions 3 to 8), keyframes at places counted from the end (11), and verdicts on lists of keyframes (12 to 14).

films: film_id, duration_ms. frames: film_id, t_ms, phash (16 hex digits), variance: the frames that were decoded. Films without a duration, or with one of 0 or less, have no fingerprint. Frames
meet windows by buckets of time; lists go to one row a film, whose own length bounds them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .fingerprints import even, hamming, let, majority_hash, pairs_made, smooth, spaced_list
from .intervals import point_join

#: Fixed values of the trials.
PLACES, AUDIO_PLACES, TAU_STEP, SPAN_STEP = 10, 11, 0.0005, 1000
CUSHION_LEAST, CUSHION_MOST = 60_000, 300_000
CANDIDATES, WINDOW = 5, 2000
START_PART, END_PART = (0.05, 0.15), (0.85, 0.95)
START_SKIP, END_SKIP, HORIZON, SHORT_FILM, APART = 180_000, 300_000, 900_000, 1_800_000, 60_000
TARGETS, TARGET_SKIP, TARGET_STEP, TARGET_SPACING = 25, 300_000, 180_000, 30_000
LEAST_TIMES, TIME_OFF, MOST_TRIM, PROBES = 30, 2000, 600_000, 50
SUBSET_SHARE, TIMING_SHARE, HASH_SHARE, HASH_BITS, ANCHOR_OFF, GAP_OFF = 0.70, 0.55, 0.40, 20, 5000, 5000


def body(films: DataFrame) -> DataFrame:
    """film_id, lo, hi: the film without a cushion of a twentieth at both ends, which is one minute at least and five at most."""
    cushion = F.least(F.greatest(F.expr("duration_ms div 20"), F.lit(CUSHION_LEAST)), F.lit(CUSHION_MOST)).cast("long")
    return films.where("duration_ms > 0").select("film_id", cushion.alias("lo"), F.greatest(cushion + 1, F.col("duration_ms") - cushion).alias("hi"))


def audio_body(levels: DataFrame, films: DataFrame, bin_ms: int = 100, rolling: int = 50, least: int = 60) -> DataFrame:
    """film_id, lo, hi: the body between the loudest moments near the start and near the end, a minute apart or more; films without both are left out.

    levels: film_id, idx, rms of bins of bin_ms. They are smoothed over `rolling` bins; films of fewer than `least` bins have no body. In films under half an hour the two windows are parts of the film (5 to 20 and 80
    to 95 %), in others fixed times. The earliest of equally loud bins counts."""
    before = rolling // 2
    n = F.count(F.lit(1)).over(W.partitionBy("film_id"))
    x = smooth(levels, "rms", before, rolling - 1 - before).withColumn("smooth", F.round("smooth", 6)).withColumn("n", n).where(F.col("n") >= least).join(films.where("duration_ms > 0"), "film_id")
    d, short = F.col("duration_ms"), F.col("duration_ms") < SHORT_FILM

    def at(ms: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("n"), F.floor(ms / bin_ms)))

    windows = {
        "s_lo": F.when(short, F.floor(d * 0.05)).otherwise(START_SKIP), "s_hi": F.when(short, F.floor(d * 0.20)).otherwise(START_SKIP + HORIZON),
        "e_lo": F.when(short, F.floor(d * 0.80)).otherwise(d - END_SKIP - HORIZON), "e_hi": F.when(short, F.floor(d * 0.95)).otherwise(d - END_SKIP),
    }
    for name, ms in windows.items():
        x = x.withColumn(name, at(ms))
    loudest = F.max(F.struct("smooth", (-F.col("idx")).alias("m")))
    first = x.where("idx >= s_lo AND idx < s_hi").groupBy("film_id").agg((-loudest["m"]).alias("start"))
    late = x.join(first, "film_id").where((F.col("idx") >= F.greatest("e_lo", F.col("start") + F.lit(APART // bin_ms))) & (F.col("idx") < F.col("e_hi")))
    return late.groupBy("film_id", "start").agg((-loudest["m"]).alias("end")).select("film_id", (F.col("start") * bin_ms).cast("long").alias("lo"), (F.col("end") * bin_ms).cast("long").alias("hi"))


def places(bodies: DataFrame, ends: bool) -> DataFrame:
    """film_id, lo, span, i, tau, target: ten places in the middle of tenths of the body, or eleven from one end to the other."""
    n = AUDIO_PLACES if ends else PLACES
    rows = bodies.select("film_id", "lo", (F.col("hi") - F.col("lo")).alias("span"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("i"))
    part = F.col("i").cast("double") / (n - 1) if ends else (F.col("i") + F.lit(0.5)) / n
    return rows.withColumn("tau", F.round(part, 6)).withColumn("target", F.floor(F.col("lo") + part * F.col("span")).cast("long"))


def next_frames(targets: DataFrame, frames: DataFrame) -> DataFrame:
    """targets with t_ms, their own time, and phash of the film's first frame at or after it; targets after the last frame are left out. The smallest hash of frames of one time counts."""
    shot = F.struct("t_ms", "phash")
    rows = targets.withColumn("at", F.col("target")).withColumn("shot", F.lit(None).cast("struct<t_ms:bigint,phash:string>"))
    others = frames.select("film_id", F.col("t_ms").alias("at"), shot.alias("shot"))
    both = rows.unionByName(others, allowMissingColumns=True)
    w = W.partitionBy("film_id").orderBy(F.desc("at"), F.desc_nulls_last("shot.t_ms"), F.desc("shot.phash")).rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("shot", F.last("shot", ignorenulls=True).over(w)).where("target IS NOT NULL AND shot IS NOT NULL").select("film_id", "lo", "span", "i", "tau", F.col("target").alias("t_ms"), "shot.phash")


def picked_frames(targets: DataFrame, frames: DataFrame, by: str, window: int = WINDOW) -> DataFrame:
    """targets with t_ms and phash of one of the first five frames of the window around them, which does not begin before the body.

    by variance: that of the largest, the earliest of equals. by change: the one whose hash differs most from the frame before in the window, the larger hash of equals, then the earlier; a lone frame is taken."""
    ranges = targets.withColumn("start_ms", F.greatest(F.col("lo"), F.col("target") - window // 2)).withColumn("end_ms", F.col("start_ms") + window)
    found = point_join(frames.select("film_id", "t_ms", "phash", "variance"), ranges, "t_ms", window)
    w = W.partitionBy("film_id", "i").orderBy("t_ms", "phash")
    found = found.withColumn("nth", F.row_number().over(w)).withColumn("prev", F.lag("phash").over(w)).where(F.col("nth") <= CANDIDATES)
    weight = F.col("variance") if by == "variance" else F.when(F.col("prev").isNull(), -1).otherwise(hamming(F.col("phash"), F.col("prev")))
    tie = F.lit("") if by == "variance" else F.col("phash")
    best = F.max_by(F.struct("t_ms", "phash"), F.struct(weight.alias("w"), tie.alias("h"), (-F.col("t_ms")).alias("m"))).alias("b")
    return found.groupBy("film_id", "lo", "span", "i", "tau").agg(best).select("film_id", "lo", "span", "i", "tau", "b.t_ms", "b.phash")


def digests(anchors: DataFrame, version: int) -> DataFrame:
    """film_id, version, body_span_ms, anchors (tau, t_ms, phash), extreme_gap_ms and digest of films with two anchors or more: SHA-256 of the version, the body's seconds and the anchors' places and hashes."""
    lists = anchors.groupBy("film_id", "span").agg(F.array_sort(F.collect_list(F.struct("i", "tau", "t_ms", "phash"))).alias("a")).where("size(a) >= 2")
    parts = F.transform("a", lambda x: F.concat(F.lpad(F.round(x["tau"] / TAU_STEP).cast("long").cast("string"), 5, "0"), F.lit(":"), x["phash"]))
    text = F.concat_ws("|", F.lit(f"v{version}"), F.concat(F.lit("span="), F.expr(f"span div {SPAN_STEP}").cast("string")), F.array_join(parts, "|"))
    plain = F.transform("a", lambda x: F.struct(x["tau"].alias("tau"), x["t_ms"].alias("t_ms"), x["phash"].alias("phash")))
    return lists.select("film_id", F.lit(version).alias("version"), F.col("span").alias("body_span_ms"), plain.alias("anchors"), (F.element_at("a", -1)["t_ms"] - F.get("a", F.lit(0))["t_ms"]).alias("extreme_gap_ms"), F.sha2(text, 256).alias("digest"))


def body_digests(films: DataFrame, frames: DataFrame, levels: DataFrame, version: int, window: int = WINDOW, **audio) -> DataFrame:
    """Digests of version 3 (frames at ten places), 5 (frames of largest variance), 6 (frames that differ most from the one before), 7 (frames at eleven places of the body by sound) or 8 (as 6, at those places). levels is read for 7 and 8 only."""
    heard = version in (7, 8)
    at = places(audio_body(levels, films, **audio) if heard else body(films), heard)
    return digests(next_frames(at, frames) if version in (3, 7) else picked_frames(at, frames, "variance" if version == 5 else "change", window), version)


def anchor_pair(films: DataFrame, frames: DataFrame) -> DataFrame:
    """film_id, a_ms, a_hash, b_ms, b_hash, gap_ms, digest (version 4): of the windows at 5 to 15 and 85 to 95 % of the body the frame that differs most from what most frames of the window have in common, the earliest of equals."""
    span = F.col("hi") - F.col("lo")
    ranges = [F.struct(F.lit(side).alias("side"), (F.col("lo") + F.floor(span * lo)).cast("long").alias("start_ms"), (F.col("lo") + F.floor(span * hi)).cast("long").alias("end")) for side, (lo, hi) in (("a", START_PART), ("b", END_PART))]
    windows = body(films).select("film_id", F.explode(F.array(*ranges)).alias("r")).select("film_id", "r.side", "r.start_ms", F.greatest(F.col("r.end"), F.col("r.start_ms") + 1000).alias("end_ms"))
    found = point_join(frames.select("film_id", "t_ms", "phash"), windows, "t_ms", 60_000).select(F.struct("film_id", "side").alias("film_id"), "t_ms", "phash")
    mean = majority_hash(found).withColumnRenamed("phash", "mean")
    best = F.max_by(F.struct("t_ms", "phash"), F.struct(hamming(F.col("phash"), F.col("mean")).alias("bits"), (-F.col("t_ms")).alias("m"), F.col("phash").alias("h")))
    picked = found.join(mean, "film_id").groupBy("film_id").agg(best.alias("x")).select("film_id.film_id", "film_id.side", "x")
    both = picked.groupBy("film_id").agg(*(F.max(F.when(F.col("side") == s, F.col("x"))).alias(s) for s in "ab")).where("a IS NOT NULL AND b IS NOT NULL")
    gap = F.col("b.t_ms") - F.col("a.t_ms")
    text = F.concat_ws("|", F.lit("v4"), "a.phash", F.floor(gap / SPAN_STEP).cast("string"), "b.phash")
    return both.select("film_id", F.col("a.t_ms").alias("a_ms"), F.col("a.phash").alias("a_hash"), F.col("b.t_ms").alias("b_ms"), F.col("b.phash").alias("b_hash"), gap.alias("gap_ms"), F.sha2(text, 256).alias("digest"))


def end_anchors(films: DataFrame, times: DataFrame) -> DataFrame:
    """film_id, outcome, n_keyframes, n_body, peaks, inner_span_ms of each film with a duration (version 11).

    Of the keyframes between 5 and 95 % of the film those nearest to 25 times counted from its end, the earlier of two as near, with 30 s between them. Outcomes: keyframes, body (fewer than ten of either), even (gaps whose
    deviation is under a fifth of their mean), peaks (fewer than five), ok; peaks are null but for ok. A film's times are one list, so that one grouping is all that is sorted."""
    held = films.where("duration_ms > 0").select("film_id", "duration_ms")
    lists = times.groupBy("film_id").agg(F.array_sort(F.collect_set("t_ms")).alias("a"), F.max(F.col("t_ms").isNull().cast("int")).alias("blank"))
    none, d = F.array().cast("array<bigint>"), F.col("duration_ms")
    out = held.join(lists, "film_id", "left").select("film_id", "duration_ms", F.coalesce("a", none).alias("a"), F.coalesce("blank", F.lit(0)).alias("blank"))
    out = out.withColumn("inside", F.filter("a", lambda t: (t >= F.floor(d * 0.05)) & (t <= F.floor(d * 0.95))))
    from_end = F.filter(F.transform(F.sequence(F.lit(TARGETS - 1), F.lit(0)), lambda i: d - TARGET_SKIP - i * TARGET_STEP), lambda t: t >= 0)
    nearest = lambda t: F.array_min(F.transform("inside", lambda x: F.struct(F.abs(x - t).alias("off"), x.alias("t"))))["t"]
    near = F.when(F.size("inside") > 0, F.array_sort(F.array_distinct(F.transform(from_end, nearest)))).otherwise(none)
    n, body_n = ((F.size(c)).cast("long") for c in ("a", "inside"))
    out = out.select("film_id", (n + F.col("blank")).alias("n_keyframes"), body_n.alias("n_body"), even("inside").alias("fixed"), spaced_list(near, TARGET_SPACING).alias("peaks"))
    outcome = F.when(F.col("n_keyframes") < 10, "keyframes").when(F.col("n_body") < 10, "body").when(F.col("fixed"), "even").when(F.coalesce(F.size("peaks"), F.lit(0)) < 5, "peaks").otherwise("ok")
    out = out.withColumn("outcome", outcome).withColumn("peaks", F.when(F.col("outcome") == "ok", F.col("peaks")))
    return out.select("film_id", "outcome", "n_keyframes", "n_body", "peaks", (F.get("peaks", F.size("peaks") - 2) - F.get("peaks", F.lit(1))).alias("inner_span_ms"))


def _sides(pairs: DataFrame) -> DataFrame:
    """pairs with times sorted, and short and long: the lists by length, a's as the short one of equals."""
    none = F.array().cast("array<bigint>")
    out = pairs.select("*", *(F.array_sort(F.coalesce(F.col(f"{s}.times"), none)).alias(f"_{s}") for s in "ab"))
    a_short = F.size("_a") <= F.size("_b")
    return out.select("*", a_short.alias("a_short"), F.when(a_short, F.col("_a")).otherwise(F.col("_b")).alias("short"), F.when(a_short, F.col("_b")).otherwise(F.col("_a")).alias("long"))


def _subset(short: pd.Series, long: pd.Series) -> pd.DataFrame:
    """The offset under which most of the short list is found in order in the long one; offsets as the first time's to the first PROBES, and where there are any, the last time's to the last PROBES. None within MOST_TRIM: 0, 0."""
    out = []
    for a, b in zip(short, long, strict=True):
        if a is None:
            out.append((0, 0))
            continue
        starts = [o for o in (b[:PROBES] - a[0]).tolist() if abs(o) <= MOST_TRIM]
        ends = [o for o in (b[::-1][:PROBES] - a[-1]).tolist() if abs(o) <= MOST_TRIM] if starts else []
        offsets = np.array(list(dict.fromkeys(starts + ends)), np.int64)
        made = pairs_made(a, b, offsets, TIME_OFF) if len(offsets) else np.zeros(1, np.int64)
        best = int(made.argmax())
        out.append((int(offsets[best]) if len(offsets) else 0, int(made[best])))
    return pd.DataFrame(out, columns=["offset", "matched"])


def _slid(short: pd.Series, long: pd.Series) -> pd.DataFrame:
    """The place in the long list at which most gaps of the short one agree, the first of equals, and the offset of the times there."""
    out = []
    for a, b in zip(short, long, strict=True):
        if a is None:
            out.append((0, 0, 0))
            continue
        gaps, others = np.diff(a), np.diff(b)
        agree = np.array([np.count_nonzero(np.abs(gaps - others[k : k + len(gaps)]) <= GAP_OFF) for k in range(len(others) - len(gaps) + 1)])
        k = int(agree.argmax())
        out.append((k, int(agree[k]), int(b[k] - a[0])))
    return pd.DataFrame(out, columns=["shift", "matched", "offset"])


def _aligned(by_gaps: bool, ready: Column) -> Column:
    """matched and offset of short and long where they are ready, else zeros; not deterministic for the optimizer, so that filters don't evaluate it again."""
    work, fields = (_slid, "shift long, matched long, offset long") if by_gaps else (_subset, "offset long, matched long")
    return F.pandas_udf(work, fields).asNondeterministic()(F.when(ready, F.col("short")), F.when(ready, F.col("long")))


def _hashes(offset: Column) -> Column:
    """How many anchors of a with a hash have one of b with a hash within ANCHOR_OFF of their moved time, the nearest, the first of equals; and of how many the hashes are close."""
    hashed = lambda s: F.filter(F.coalesce(F.col(f"{s}.anchors"), F.array().cast("array<struct<t_ms:bigint,phash:string>>")), lambda x: F.coalesce(x["phash"], F.lit("")) != "")

    def meet(sides: Column) -> Column:
        nearest = lambda x: F.array_min(F.transform(sides["b"], lambda y, k: F.struct(F.abs(y["t_ms"] - x["t_ms"] - offset).alias("off"), k.alias("k"), y["phash"].alias("phash"))))
        met = F.filter(F.transform(sides["a"], lambda x: F.struct(x["phash"].alias("phash"), nearest(x).alias("y"))), lambda p: p["y"]["off"] <= ANCHOR_OFF)
        return let(met, lambda m: F.struct(F.size(m).cast("long").alias("compared"), F.size(F.filter(m, lambda p: hamming(p["phash"], p["y"]["phash"]) <= HASH_BITS)).cast("long").alias("close")))

    return let(F.struct(hashed("a").alias("a"), hashed("b").alias("b")), meet)


def subset_verdicts(pairs: DataFrame) -> DataFrame:
    """pair_id, outcome, matched, fraction, trim (b's time less a's), same of pairs (pair_id, a, b) of struct<times, ...> (version 12): the shorter list must stand in the longer one, in order, after one shift.

    Fewer than 30 times on a side are insufficient; null lists count as empty."""
    ready = F.size("short") >= LEAST_TIMES
    out = _sides(pairs).withColumn("x", _aligned(False, ready))
    fraction = F.when(ready, F.round(F.col("x.matched") / F.size("short"), 6)).otherwise(0.0)
    trim = F.when(F.col("a_short"), F.col("x.offset")).otherwise(-F.col("x.offset"))
    return out.select("pair_id", F.when(ready, "compared").otherwise("insufficient").alias("outcome"), "x.matched", fraction.alias("fraction"), trim.alias("trim"), (fraction >= SUBSET_SHARE).alias("same"))


def hashed_verdicts(pairs: DataFrame, by_gaps: bool) -> DataFrame:
    """pair_id, outcome (insufficient, timing or compared), matched, fraction, compared, close, trim, same of pairs (pair_id, a, b) of struct<times, anchors array<struct<t_ms, phash>>>.

    First times are put in line: as a subset in order (version 13; trim is b's time less a's), or by_gaps, by the gaps of the shorter list slid along the longer one's (version 14, of times without cadence; trim is a's time less
    b's). Where 0.55 of them agree, anchors are met after the shift, and 0.40 of those that meet must have close hashes. Null lists count as empty, null or empty hashes are not compared, ones that are not 16 hex digits are not close."""
    some = lambda side: F.coalesce(F.size(f"{side}.anchors"), F.lit(0)) > 0
    ready = (F.size("short") >= LEAST_TIMES) & some("a") & some("b")
    n = F.size("short") - (1 if by_gaps else 0)
    timed = _sides(pairs).withColumn("x", _aligned(by_gaps, ready)).withColumn("fraction", F.when(ready, F.round(F.col("x.matched") / n, 6)).otherwise(0.0))
    timed = timed.withColumn("forth", F.when(F.col("a_short"), F.col("x.offset")).otherwise(-F.col("x.offset")))
    on_time = F.col("fraction") >= TIMING_SHARE
    timed = timed.withColumn("h", F.when(on_time, _hashes(F.col("forth"))))
    close, compared = (F.coalesce(c, F.lit(0).cast("long")) for c in ("h.close", "h.compared"))
    return timed.select(
        "pair_id", F.when(on_time, "compared").when(ready, "timing").otherwise("insufficient").alias("outcome"), "x.matched", "fraction", compared.alias("compared"), close.alias("close"),
        (-F.col("forth") if by_gaps else F.col("forth")).alias("trim"), (on_time & (compared > 0) & (close >= HASH_SHARE * compared)).alias("same"),
    )
