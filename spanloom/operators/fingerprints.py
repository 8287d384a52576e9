"""Content fingerprints: gaps, peaks, hashes and order-preserving alignment.

Folds that depend on what they kept before run as higher-order functions over one film's ordered list; the lists are bounded by the film's
length. Everything else is windows and joins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import small_arrow_batches


def gaps(times: DataFrame) -> DataFrame:
    """film_id, t_ms, gap to the time before (null for the first)."""
    return times.withColumn("gap", F.col("t_ms") - F.lag("t_ms").over(W.partitionBy("film_id").orderBy("t_ms")))


def cadence(times: DataFrame, limit: float = 0.2, least: int = 10) -> DataFrame:
    """Whether a film's gaps are even: their deviation is under `limit` of their mean."""
    g = gaps(times).groupBy("film_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.stddev_pop("gap") / F.avg("gap"), 6).alias("cv"))
    return g.select("film_id", "n", F.coalesce("cv", F.lit(0.0)).alias("cv"), ((F.col("n") >= least) & (F.coalesce("cv", F.lit(0.0)) < limit)).alias("fixed"))


def even(times: str, limit: float = 0.2, least: int = 10) -> Column:
    """The same of a sorted list of a film's different times."""
    rest = F.greatest(F.size(times) - 1, F.lit(0))
    gaps_of = F.zip_with(F.slice(times, F.lit(2), rest), F.slice(times, F.lit(1), rest), lambda x, y: (x - y).cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
    cv = lambda g: let(total(g) / F.size(g), lambda mean: F.sqrt(total(F.transform(g, lambda x: (x - mean) * (x - mean))) / F.size(g)) / mean)
    return let(gaps_of, lambda g: (F.size(times) >= least) & (F.when(F.size(g) > 0, F.round(cv(g), 6)).otherwise(0.0) < limit))


def without_cadence(times: DataFrame, unit_ms: int, often: int) -> DataFrame:
    """Times whose gap, in units, is not among those that a film has `often` times; the first stays."""
    g = gaps(times).withColumn("k", F.expr(f"gap div {unit_ms}"))
    n = F.count(F.lit(1)).over(W.partitionBy("film_id", "k"))
    return g.withColumn("n", n).where((F.col("gap").isNull()) | (F.col("n") < often)).select("film_id", "t_ms")


def anchors(times: DataFrame, k: int) -> DataFrame:
    """The k times with the largest gap before them, earlier ones first among equals; the first time has none."""
    w = W.partitionBy("film_id").orderBy(F.desc("gap"), "t_ms")
    return gaps(times).where("gap IS NOT NULL").withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k).select("film_id", "t_ms", "gap")


def rms(samples: DataFrame, size: int) -> DataFrame:
    """Root mean square of full blocks of `size` samples; the tail is dropped."""
    blocks = samples.groupBy("film_id", F.expr(f"idx div {size}").alias("block")).agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.count(F.lit(1)).alias("n"))
    return blocks.where(F.col("n") == size).drop("n")


def smooth(series: DataFrame, value: str, before: int, after: int) -> DataFrame:
    """Sliding sum over before + after + 1 samples, always divided by their number: samples beyond the ends count as 0."""
    w = W.partitionBy("film_id").orderBy("idx").rowsBetween(-before, after)
    return series.withColumn("smooth", F.sum(value).over(w) / (before + after + 1))


def peaks(series: DataFrame, value: str, k: int, spacing: int) -> DataFrame:
    """Greedy top k: the largest value, earliest first, then the next that is not within `spacing` of one taken."""
    lists = series.groupBy("film_id").agg(F.array_sort(F.collect_list(F.struct((-F.col(value)).alias("minus"), "idx"))).alias("a"))

    def take(acc: Column, x: Column) -> Column:
        near = F.exists(acc, lambda y: F.abs(y["idx"] - x["idx"]) <= spacing)
        return F.when((F.size(acc) < k) & ~near, F.array_append(acc, x)).otherwise(acc)

    taken = F.aggregate("a", F.array().cast("array<struct<minus:double,idx:bigint>>"), take)
    return lists.select("film_id", F.explode(taken).alias("p")).select("film_id", F.col("p.idx").alias("idx"), (-F.col("p.minus")).alias(value))


def spaced(times: DataFrame, spacing: int) -> DataFrame:
    """Times from left to right that are at least `spacing` after the last one kept."""
    lists = times.groupBy("film_id").agg(F.array_sort(F.collect_list("t_ms")).alias("a"))
    return lists.select("film_id", F.explode(spaced_list(F.col("a"), spacing)).alias("t_ms"))


def spaced_list(times: Column, spacing: int) -> Column:
    """Of a sorted list of times those that are at least `spacing` after the last one kept."""
    return F.aggregate(times, F.array().cast("array<bigint>"), lambda acc, t: F.when((F.size(acc) == 0) | (t - F.coalesce(F.element_at(acc, -1), F.lit(-spacing).cast("bigint")) >= spacing), F.array_append(acc, t)).otherwise(acc))


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hashes of 16 hex digits; 64 where one is not such a hash."""

    def half(h: Column, start: int) -> Column:
        return F.conv(F.substring(h, start, 8), 16, 10).cast("bigint")

    good = a.rlike("^[0-9a-fA-F]{16}$") & b.rlike("^[0-9a-fA-F]{16}$")
    return F.when(good, F.bit_count(half(a, 1).bitwiseXOR(half(b, 1))) + F.bit_count(half(a, 9).bitwiseXOR(half(b, 9)))).otherwise(64)


def block_hash(block: Column) -> Column:
    """16 hex digits of an 8 x 8 block of coefficients: of all but the first, a bit each for those over their median, in order."""
    rest = F.slice(block, 2, 63)
    bits = let(F.element_at(F.array_sort(rest), 32), lambda median: F.concat(F.lit("0"), F.array_join(F.transform(rest, lambda x: F.when(x > median, "1").otherwise("0")), "")))
    return let(bits, lambda b: F.lower(F.concat(F.lpad(F.conv(F.substring(b, 1, 32), 2, 16), 8, "0"), F.lpad(F.conv(F.substring(b, 33, 32), 2, 16), 8, "0"))))


def majority_hash(hashes: DataFrame) -> DataFrame:
    """film_id and the hash whose bits more than half of its hashes have set."""
    bits = hashes.select("film_id", F.posexplode(F.split(F.array_join(F.transform(F.array(F.lit(1), F.lit(9)), lambda s: F.lpad(F.conv(F.substring("phash", s, F.lit(8)), 16, 2), 32, "0")), ""), "")).alias("pos", "bit")).where("bit <> ''")
    counts = bits.groupBy("film_id", "pos").agg((F.count_if(F.col("bit") == "1") * 2 > F.count(F.lit(1))).alias("one"))
    joined = counts.groupBy("film_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "one"))), lambda x: F.when(x["one"], "1").otherwise("0")), "").alias("b"))
    return joined.select("film_id", F.lower(F.concat(F.lpad(F.conv(F.substring("b", 1, 32), 2, 16), 8, "0"), F.lpad(F.conv(F.substring("b", 33, 32), 2, 16), 8, "0"))).alias("phash"))


def _merged(short: Column, long: Column, offset: Column, tolerance: int) -> Column:
    """Both lists in the order of one pass: an s waits from s + offset - tolerance on, an l goes to the first s that waits and is not past its time."""
    waits = F.transform(short, lambda s: F.struct((s + offset - tolerance).alias("k"), F.lit(0).alias("kind"), s.alias("v")))
    comes = F.transform(long, lambda y: F.struct(y.alias("k"), F.lit(1).alias("kind"), y.alias("v")))
    return F.array_sort(F.concat(waits, comes))


def _pass(short: Column, long: Column, offset: Column, tolerance: int, empty: Column, add) -> Column:
    start = F.struct(F.array().cast("array<bigint>").alias("waiting"), empty.alias("got"))

    def step(acc: Column, x: Column) -> Column:
        left = F.filter(acc["waiting"], lambda s: s + offset + tolerance >= x["v"])
        taken = F.struct(F.slice(left, 2, F.greatest(F.size(left) - 1, F.lit(0))).alias("waiting"), add(acc["got"], F.get(left, F.lit(0)), x["v"]).alias("got"))
        return F.when(x["kind"] == 0, F.struct(F.array_append(acc["waiting"], x["v"]).alias("waiting"), acc["got"].alias("got"))).when(F.size(left) > 0, taken).otherwise(F.struct(left.alias("waiting"), acc["got"].alias("got")))

    return F.aggregate(_merged(short, long, offset, tolerance), start, step, lambda acc: acc["got"])


def paired(short: Column, long: Column, offset: Column, tolerance: int) -> Column:
    """Pairs (s, l) of two sorted lists, each time used once and in order: for each s the first l left within tolerance of s + offset."""
    empty = F.array().cast("array<struct<s:bigint,l:bigint>>")
    return _pass(short, long, offset, tolerance, empty, lambda got, s, y: F.array_append(got, F.struct(s.alias("s"), y.alias("l"))))


def pairs_made(short: np.ndarray, long: np.ndarray, offsets: np.ndarray, tolerance: int) -> np.ndarray:
    """How many pairs paired() makes of two sorted lists under each offset, for all offsets at once.

    free: under each offset, the place in the long list from which on times are not used."""
    early = short[:, None] + offsets[None, :] - tolerance
    ended = np.append(long, np.iinfo(np.int64).max)
    free, made = np.zeros(len(offsets), np.int64), np.zeros(len(offsets), np.int64)
    for first, start in zip(np.searchsorted(long, early), early, strict=True):
        free = np.maximum(free, first)
        hit = ended[free] <= start + 2 * tolerance
        free, made = free + hit, made + hit
    return made


def _ragged(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values of lists in one array, and where each list starts and ends in it; null lists are empty."""
    at = lists.offsets.to_numpy()
    return lists.values.to_numpy(zero_copy_only=False).astype(np.int64), at[:-1].astype(np.int64), np.where(lists.is_valid().to_numpy(zero_copy_only=False), at[1:], at[:-1]).astype(np.int64)


def _walk(short: np.ndarray, starts: np.ndarray, sizes: np.ndarray, long: np.ndarray, frees: np.ndarray, offsets: np.ndarray, tolerance: int, note=None) -> np.ndarray:
    """How many pairs paired() makes in each of many walks: of the `sizes` times of short from `starts` on with the times of long from `frees` on, whose ends hold the largest number, under an offset each. Walks step together, longest first.

    note(walks, s, l): what is called with the pairs of a step."""
    order = np.argsort(-sizes, kind="stable")
    starts, left, offset, free, made = starts[order], sizes[order], offsets[order] - tolerance, frees[order].copy(), np.zeros(len(order), np.int64)
    for k in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -k))  # the walks with more than k times
        s = short[starts[:n] + k]
        early = s + offset[:n]
        behind = np.flatnonzero(long[free[:n]] < early)
        while len(behind):
            free[behind] += 1
            behind = behind[long[free[behind]] < early[behind]]
        at = long[free[:n]]
        hit = np.flatnonzero((at <= early + 2 * tolerance) & (at != np.iinfo(np.int64).max))
        if note:
            note(order[hit], s[hit], at[hit])
        free[hit] += 1
        made[hit] += 1
    out = np.empty(len(order), np.int64)
    out[order] = made
    return out


def _middles(rows: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the values of rows 0 to n - 1, each of which has some: values by row and size, and the places of each row's lower and upper middle there."""
    order = np.lexsort((values, rows))
    sizes = np.bincount(rows, minlength=n)
    firsts = np.cumsum(sizes) - sizes
    return values[order], firsts + (sizes - 1) // 2, firsts + sizes // 2


def aligned(tolerance: int, most_offset: int, ends: int = 50):
    """An Arrow UDF (short, long): offset, matched, spread and middle. The offset is that which pairs most, of those from the first of the short list to the first of the long and from its last to the last of the long, backwards; the
    first of equals. Then how many pairs it makes, and the spread and the upper median of their distances. Null where a list is empty or no offset is allowed.

    Some hundred folds a row are too many for interpreted lambdas, and calls for each row too many for numpy: all rows of a batch and all their offsets are walked at once."""

    @F.arrow_udf("offset long, matched long, spread double, middle long")
    def pick(short: pa.Array, long: pa.Array) -> pa.Array:
        (a, a0, a1), (b, b0, b1) = _ragged(short), _ragged(long)
        some = np.flatnonzero((a1 > a0) & (b1 > b0))
        found = np.zeros(len(a0), bool)
        out = {"offset": np.zeros(len(a0), np.int64), "matched": np.zeros(len(a0), np.int64), "spread": np.zeros(len(a0)), "middle": np.zeros(len(a0), np.int64)}
        if len(some):
            # each long list is followed by the largest number, so that no walk leaves it
            places = np.arange(len(b)) + np.searchsorted(b1, np.arange(len(b)), side="right")
            ended = np.full(len(b) + len(b1), np.iinfo(np.int64).max)
            ended[places] = b
            free = b0 + np.arange(len(b0))
            probe = np.arange(ends)
            there = probe[None, :] < (b1 - b0)[some][:, None]
            heads = b[np.minimum(b0[some][:, None] + probe, len(b) - 1)] - a[a0[some]][:, None]
            tails = b[np.maximum(b1[some][:, None] - 1 - probe, 0)] - a[a1[some] - 1][:, None]
            tried, there = np.concatenate([heads, tails], axis=1), np.concatenate([there, there], axis=1)
            row, nth = np.nonzero(there & (np.abs(tried) <= most_offset))
            offsets, row = tried[row, nth], some[row]
            made = _walk(a, a0[row], (a1 - a0)[row], ended, free[row], offsets, tolerance)
            best = np.lexsort((np.arange(len(row)), -made, row))  # by row, most pairs, and order of trial
            best = best[np.flatnonzero(np.diff(row[best], prepend=-1))]
            rows, offsets = row[best], offsets[best]
            got: list[tuple[np.ndarray, np.ndarray]] = []
            _walk(a, a0[rows], (a1 - a0)[rows], ended, free[rows], offsets, tolerance, lambda walks, s, y: got.append((walks, y - s)))
            if got:
                walks, moved = (np.concatenate(x) for x in zip(*got, strict=True))
                by, low, high = _middles(walks, moved, len(rows))
                far, low_far, high_far = _middles(walks, np.abs(moved - ((by[low] + by[high]) / 2.0)[walks]), len(rows))
                found[rows] = True
                out["offset"][rows], out["matched"][rows], out["middle"][rows], out["spread"][rows] = offsets, np.bincount(walks, minlength=len(rows)), by[high], (far[low_far] + far[high_far]) / 2.0
        return pa.StructArray.from_arrays([pa.array(x) for x in out.values()], names=list(out), mask=pa.array(~found))

    return pick.asNondeterministic()  # so that the optimizer does not evaluate it again for filters


def let(value: Column, body) -> Column:
    """body(value), with value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def median(a: Column) -> Column:
    """Mean of the middle two, 0 if empty."""

    def middle(s: Column) -> Column:
        n = F.size(s)
        return F.when(n == 0, 0.0).otherwise((F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2.0)

    return let(F.array_sort(a), middle)


def upper_median(a: Column) -> Column:
    return let(F.array_sort(a), lambda s: F.get(s, F.floor(F.size(s) / 2).cast("int")))


def spread(a: Column) -> Column:
    """Median distance from the median."""
    return let(a, lambda v: let(median(v), lambda m: median(F.transform(v, lambda x: F.abs(x - m)))))


def match_verdicts(pairs: DataFrame, tolerance: int = 2000, most_offset: int = 600_000, least: int = 30, share: float = 0.55, most_spread: int = 250) -> DataFrame:
    """pairs with a verdict on whether two films (columns a, b: sorted times) are one: struct of offset, matched, fraction, spread, trim, same, of nulls where a list is null or has fewer than `least` times or no offset is allowed.

    Offsets from the ends of the shorter list to the first or last 50 of the longer are tried; the first that pairs most wins."""
    small_arrow_batches(pairs.sparkSession)
    a_short, n, x = F.size("a") <= F.size("b"), F.least(F.size("a"), F.size("b")), F.col("verdict")
    enough = pairs.withColumn("_short", F.when(n >= least, F.when(a_short, F.col("a")).otherwise(F.col("b")))).withColumn("_long", F.when(n >= least, F.when(a_short, F.col("b")).otherwise(F.col("a"))))
    tried = enough.withColumn("verdict", aligned(tolerance, most_offset)("_short", "_long"))
    signed = lambda v: F.when(a_short, -v).otherwise(v)
    fraction, spread = F.round(x["matched"] / n, 6), F.round(x["spread"], 6)
    said = F.struct(signed(x["offset"]).alias("offset"), x["matched"].alias("matched"), fraction.alias("fraction"), spread.alias("spread"), signed(x["middle"]).alias("trim"), ((fraction >= share) & (spread <= most_spread)).alias("same"))
    return tried.withColumn("verdict", said).drop("_short", "_long")


def match(pairs: DataFrame, **limits) -> DataFrame:
    """pair_id and the fields of match_verdicts for pairs (pair_id, a, b); pairs without a verdict are left out."""
    return match_verdicts(pairs.select("pair_id", "a", "b"), **limits).where("verdict.offset IS NOT NULL").select("pair_id", "verdict.*")


def close_hashes(rows: DataFrame, most: int, block: int = 4096) -> DataFrame:
    """Pairs of one film's hashes (film_id, vec_id, phash) at most `most` bits apart. The rows of a film are dealt in blocks of some `block`, each of which meets the film's rows in a task of its own; pairs farther apart never leave the join."""
    hi, lo = (F.conv(F.substring("phash", k, 8), 16, 10).cast("long") for k in (1, 9))
    sizes = rows.groupBy("film_id").agg((F.floor(F.count(F.lit(1)) / block) + 1).alias("blocks"))
    own = rows.select("film_id", "vec_id", hi.alias("hi"), lo.alias("lo")).join(sizes, "film_id")
    other = own.select("film_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.col("vec_id").alias("other_id"), F.col("hi").alias("other_hi"), F.col("lo").alias("other_lo"))
    own = own.withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks"))
    bits = F.bit_count(F.col("hi").bitwiseXOR(F.col("other_hi"))) + F.bit_count(F.col("lo").bitwiseXOR(F.col("other_lo")))
    same = (own["film_id"] == other["film_id"]) & (own["block"] == other["block"])
    return own.join(other, same & (F.col("vec_id") < F.col("other_id")) & (bits <= most)).select("vec_id", "other_id", bits.cast("long").alias("bits"))


def nearest_time(targets: DataFrame, times: DataFrame) -> DataFrame:
    """Of each target of a film the nearest time, the earlier of equals: last time at or before and first after, by window functions."""
    rows = targets.select("film_id", F.col("target").alias("t"), F.lit(1).alias("is_target")).unionByName(times.select("film_id", F.col("t_ms").alias("t"), F.lit(0).alias("is_target")))
    time = F.when(F.col("is_target") == 0, F.col("t"))
    w = W.partitionBy("film_id")
    rows = rows.withColumn("before", F.last(time, ignorenulls=True).over(w.orderBy("t", "is_target").rowsBetween(W.unboundedPreceding, 0))).withColumn("after", F.first(time, ignorenulls=True).over(w.orderBy("t", "is_target").rowsBetween(0, W.unboundedFollowing)))
    pick = F.when(F.col("after").isNull() | (F.col("t") - F.col("before") <= F.col("after") - F.col("t")), F.col("before")).otherwise(F.col("after"))
    return rows.where("is_target = 1").select("film_id", F.col("t").alias("target"), pick.alias("nearest"))


def ladder(rungs: DataFrame, least: int = 10) -> DataFrame:
    """film_id, rung, t_ms of the one rung (film_id, rung, t_ms) of each film that counts: the first with `least` times or more, else the longest, the first of equals. The numbers of rows choose it, so that no list is gathered."""
    enough = F.col("n") >= least
    sizes = rungs.groupBy("film_id", "rung").agg(F.count(F.lit(1)).alias("n"))
    best = sizes.groupBy("film_id").agg(F.min_by("rung", F.struct(F.when(enough, 0).otherwise(1).alias("short"), F.when(enough, 0).otherwise(-F.col("n")).alias("m"), "rung")).alias("rung"))
    return rungs.join(best, ["film_id", "rung"]).select("film_id", "rung", "t_ms")


def slide(pairs: DataFrame, tolerance: int) -> DataFrame:
    """The shift at which most gaps of the shorter list agree with the longer's; the first of equals. Columns short, long: gap lists."""
    shifts = F.sequence(F.lit(0), F.size("long") - F.size("short"))
    rows = pairs.where("size(short) > 0 AND size(long) >= size(short)").select("pair_id", "short", "long", F.explode(shifts).alias("shift"))
    agree = F.size(F.filter(F.zip_with("short", F.slice("long", F.col("shift") + 1, F.size("short")), lambda a, b: F.abs(a - b) <= tolerance), lambda ok: ok))
    best = rows.select("pair_id", "shift", agree.alias("n")).groupBy("pair_id").agg(F.max(F.struct("n", (-F.col("shift")).alias("m"))).alias("b"))
    return best.select("pair_id", (-F.col("b.m")).cast("long").alias("shift"), F.col("b.n").cast("long").alias("agreeing"))


def sample_times(runs: DataFrame, timescale: int) -> DataFrame:
    """Start of each run of equal sample durations, in ms: prefix sums of count x delta. Columns film_id, ord, n, delta."""
    w = W.partitionBy("film_id").orderBy("ord")
    ticks = F.sum(F.col("n") * F.col("delta")).over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("n") * F.col("delta")
    return runs.select("film_id", "ord", ticks.alias("ticks")).withColumn("start_ms", F.expr(f"(ticks * 1000) div {timescale}"))
