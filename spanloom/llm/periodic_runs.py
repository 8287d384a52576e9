"""Periodic runs of words: stretches that repeat with a period, found by Crochemore's partition refinement (operator 11).

Positions of equal words are one class. From length l to l + 1 a class splits by the classes of the positions that follow its
members. Only parts that came from a split count, and of each split all but the largest (the smaller halves): a member whose
successor lies in none of them stays where it is. So every position moves O(log n) times and the work is O(n log n) for n words.
The members of a class are linked in order of place. Neighbours of a class of length l that are l apart are a square with a
primitive root, and every such square is met so; squares of one period at adjacent places are one run.

Texts are worked on in Arrow batches of about 4 MB, all texts of a batch at once, each ended by a word of its own; the loop over
lengths ends when no part is left that may split another, at the latest with half the longest text. A task holds one batch; a
longer text is a batch of its own. Nothing is shuffled.

Words are [^\\x20\\x09-\\x0D]+, told apart by their bytes, never by hashes.

Nulls: a null text has no words, no run and two digests of nothing; a null doc_id is kept as it is and plants nothing. Empty texts are
as null ones. Repeated rows are worked on alike. An empty table gives an empty result. Extra columns play no part. Of runs of one length
the smallest start, then the smallest period is the longest run's.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .arrow_text import small_batches
from .common import small_arrow_batches

#: Least words of a run.
LEAST = 12
#: So few fresh members are taken one by one; arrays cost more than they save there.
FEW = 48


def squares(codes: np.ndarray, owner: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and periods of all squares with a primitive root and a period of at most `longest` in texts whose words are numbered by codes; owner is the text of each word.

    Each text must end in a word that is nowhere else."""
    parts = _Partition(codes, owner)
    starts, periods = [], []
    fresh = np.arange(len(codes), dtype=np.int64)
    length = 1
    while length <= longest and len(fresh):
        found = parts.neighbours(length)
        if len(found):
            starts.append(found)
            periods.append(np.full(len(found), length, np.int64))
        fresh = parts.refine_few(fresh.tolist(), length) if len(fresh) <= FEW else parts.refine(fresh, length)
        length += 1
    # No class splits any more: what is left are classes of one.
    empty = np.zeros(0, np.int64)
    return (np.concatenate(starts), np.concatenate(periods)) if starts else (empty, empty)


_NONE = np.zeros(0, np.int64)


class _Partition:
    """Classes of positions with equal factors. A class is a stretch of `order` and named by its first slot; its members are linked by place."""

    def __init__(self, codes: np.ndarray, owner: np.ndarray):
        n = len(codes)
        key = owner.astype(np.int64) * (int(codes.max(initial=0)) + 1) + codes
        self.order = np.argsort(key, kind="stable")
        key = key[self.order]
        first = np.ones(n, bool)
        first[1:] = key[1:] != key[:-1]
        heads = np.flatnonzero(first)
        sizes = np.diff(np.append(heads, n))
        self.place, self.name = np.empty(n, np.int64), np.empty(n, np.int64)
        self.place[self.order] = np.arange(n)
        self.name[self.order] = np.repeat(heads, sizes)
        self.size = np.zeros(n, np.int64)
        self.size[heads] = sizes
        self.after, self.before = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        same = np.flatnonzero(~first)
        self.after[self.order[same - 1]] = self.order[same]
        self.before[self.order[same]] = self.order[same - 1]
        self.moves = np.zeros(n, bool)
        self.limit, self.at, self.bounds, self.later = 1, None, {}, {}

    def neighbours(self, length: int) -> np.ndarray:
        """Positions whose next member is `length` on. Those with gaps of up to twice the length are looked up at once, when the length has doubled; gaps that arise later are noted."""
        if length == self.limit:
            self.limit, self.later = 2 * length, {}
            has = np.flatnonzero(self.after >= 0)
            gaps = self.after[has] - has
            near = (gaps >= length) & (gaps < self.limit)
            has, gaps = has[near], gaps[near]
            by_gap = np.argsort(gaps, kind="stable")
            self.at, gaps = has[by_gap], gaps[by_gap]
            cuts = np.append(np.flatnonzero(gaps[1:] != gaps[:-1]) + 1, len(gaps))
            begins = np.append(0, cuts[:-1]) if len(gaps) else cuts[:0]
            self.bounds = {gap: (a, b) for gap, a, b in zip(gaps[begins].tolist(), begins.tolist(), cuts.tolist(), strict=False)}
        a, b = self.bounds.pop(length, (0, 0))
        later = self.later.pop(length, None)
        if later is None and a == b:
            return _NONE
        found = self.at[a:b] if later is None else np.unique(np.append(self.at[a:b], later))
        return found[self.after[found] == found + length]

    def _note(self, at: np.ndarray, length: int) -> None:
        """Remember positions whose gap has changed and will be reached before the next doubling."""
        gaps = self.after[at] - at
        near = np.flatnonzero((gaps > length) & (gaps < self.limit))
        if not len(near):
            return
        at, gaps = at[near], gaps[near]
        by_gap = np.argsort(gaps, kind="stable")
        at, gaps = at[by_gap], gaps[by_gap]
        cuts = np.flatnonzero(gaps[1:] != gaps[:-1]) + 1
        for gap, part in zip(gaps[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts), strict=True):
            self.later.setdefault(gap, []).extend(part.tolist())

    def refine(self, fresh: np.ndarray, length: int) -> np.ndarray:
        """Split the classes of `length` by the members of the fresh ones, which come by place; give the members of those that are fresh afterwards."""
        p = fresh[fresh > 0] - 1
        p = p[self.size[self.name[p]] > 1]
        n = len(self.order)
        key = self.name[p] * n + self.name[p + 1]
        by_key = np.argsort(key, kind="stable")
        p, key = p[by_key], key[by_key]
        if not len(p):
            return p
        # Groups of one class and one successor, and the classes that have them.
        new_group = np.ones(len(p), bool)
        new_group[1:] = key[1:] != key[:-1]
        g_first = np.flatnonzero(new_group)
        g_size = np.diff(np.append(g_first, len(p)))
        g_class = self.name[p[g_first]]
        new_class = np.ones(len(g_first), bool)
        new_class[1:] = g_class[1:] != g_class[:-1]
        c_first = np.flatnonzero(new_class)
        c_of_g = np.cumsum(new_class) - 1
        c_name = g_class[c_first]
        rest = self.size[c_name] - np.add.reduceat(g_size, c_first)
        # The largest group of each class; where no other member is left it stays as the class.
        largest = np.maximum.reduceat(g_size, c_first)
        is_largest = g_size == largest[c_of_g]
        top = np.full(len(c_first), len(g_first), np.int64)
        np.minimum.at(top, c_of_g[is_largest], np.flatnonzero(is_largest))
        stays = np.zeros(len(g_first), bool)
        stays[top[rest == 0]] = True
        staying = np.where(rest == 0, largest, rest)
        g_moves = ~stays
        if not g_moves.any():
            return p[:0]
        moved = p[np.repeat(g_moves, g_size)]
        m_size = g_size[g_moves]
        m_class = c_of_g[g_moves]
        first = np.concatenate([[0], np.cumsum(m_size)[:-1]])
        self._unlink(moved, length)
        self._link(moved, first, length)
        names = self._settle(moved, m_size, first, m_class, c_name, staying)
        # Of the parts of a class all but the largest are fresh.
        whole = (rest > 0) & (largest > rest)
        skip = np.zeros(len(g_first), bool)
        skip[top[whole]] = True
        parts = [moved[np.repeat(~skip[g_moves], m_size)]]
        left = c_name[whole]
        if len(left):
            counts = self.size[left]
            slots = np.arange(int(counts.sum())) + np.repeat(left - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
            parts.append(self.order[slots])
        self.name[moved] = np.repeat(names, m_size)
        return np.sort(np.concatenate(parts))

    def refine_few(self, fresh: list[int], length: int) -> np.ndarray:
        """refine() for a few fresh members, one by one."""
        name, size, order, place = (memoryview(x) for x in (self.name, self.size, self.order, self.place))
        after, before, later, limit = memoryview(self.after), memoryview(self.before), self.later, self.limit
        classes: dict[int, dict[int, list[int]]] = {}
        for x in fresh:
            if x and size[c := name[x - 1]] > 1:
                classes.setdefault(c, {}).setdefault(name[x], []).append(x - 1)
        out: list[int] = []
        for c, by_next in classes.items():
            groups = list(by_next.values())
            if sum(map(len, groups)) == size[c]:
                groups.sort(key=len)
                groups.pop()
            noted = []
            for group in groups:
                for x in group:
                    a, b = after[x], before[x]
                    if b >= 0:
                        after[b] = a
                        noted.append(b)
                    if a >= 0:
                        before[a] = b
                    end, slot = c + size[c] - 1, place[x]
                    other = order[end]
                    order[slot], place[other] = other, slot
                    order[end], place[x] = x, end
                    size[c] -= 1
                at = c + size[c]
                size[at] = len(group)
                last = -1
                for x in group:
                    name[x], before[x] = at, last
                    if last >= 0:
                        after[last] = x
                        noted.append(last)
                    last = x
                after[last] = -1
            for x in noted:
                gap = after[x] - x
                if length < gap < limit:
                    later.setdefault(gap, []).append(x)
            if not groups:
                continue
            largest = max(groups, key=len)
            if len(largest) > size[c]:
                groups = [g for g in groups if g is not largest]
                out.extend(self.order[c : c + size[c]].tolist())
            for group in groups:
                out.extend(group)
        return np.array(sorted(out), np.int64)

    def _unlink(self, moved: np.ndarray, length: int) -> None:
        """Take members out of their lists; those that are linked to each other go as one chain."""
        self.moves[moved] = True
        before, after = self.before[moved], self.after[moved]
        heads = moved[(before < 0) | ~self.moves[before]]
        tails = moved[(after < 0) | ~self.moves[after]]
        self.moves[moved] = False
        n = len(self.order)
        heads = heads[np.argsort(self.name[heads] * n + heads)]
        tails = tails[np.argsort(self.name[tails] * n + tails)]
        left, right = self.before[heads], self.after[tails]
        self.after[left[left >= 0]] = right[left >= 0]
        self.before[right[right >= 0]] = left[right >= 0]
        self._note(left[(left >= 0) & (right >= 0)], length)

    def _link(self, moved: np.ndarray, first: np.ndarray, length: int) -> None:
        """Link the members of each group in order of place."""
        self.after[moved[:-1]] = moved[1:]
        self.before[moved[1:]] = moved[:-1]
        self.before[moved[first]] = -1
        self.after[moved[np.append(first[1:], len(moved)) - 1]] = -1
        linked = np.ones(len(moved), bool)
        linked[np.append(first[1:], len(moved)) - 1] = False
        self._note(moved[linked], length)

    def _settle(self, moved: np.ndarray, m_size: np.ndarray, first: np.ndarray, m_class: np.ndarray, c_name: np.ndarray, staying: np.ndarray) -> np.ndarray:
        """Give each group slots at the end of its class's stretch, and those who stood there the slots that become free; the groups' names."""
        begin = (c_name + staying)[m_class]
        class_first = np.ones(len(m_class), bool)
        class_first[1:] = m_class[1:] != m_class[:-1]
        offset = first - np.repeat(first[class_first], np.diff(np.append(np.flatnonzero(class_first), len(m_class))))
        names = begin + offset
        slots = np.arange(len(moved)) + np.repeat(names - first, m_size)
        self.moves[moved] = True
        there = self.order[slots]
        there = there[~self.moves[there]]
        self.moves[moved] = False
        free = self.place[moved]
        free = free[free < np.repeat(begin, m_size)]
        self.order[free], self.place[there] = there, free
        self.order[slots], self.place[moved] = moved, slots
        self.size[names] = m_size
        self.size[c_name] = staying
        return names


def runs(codes: np.ndarray, offsets: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of at least `least` words of texts whose words are numbered by codes, text by text: text, start in it, length and period, by text, start and period."""
    n_words = np.diff(offsets)
    n = len(n_words)
    # Each text is followed by a word of its own.
    shift = np.arange(n)
    owner = np.repeat(shift, n_words + 1)
    ends = offsets[1:] + shift
    words = np.full(len(codes) + n, 0, np.int64)
    inside = np.ones(len(words), bool)
    inside[ends] = False
    words[inside] = codes.astype(np.int64) + 1
    at, period = squares(words, owner, int(n_words.max(initial=0)) // 2)
    if not len(at):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, empty
    by_period = np.lexsort((at, period))
    at, period = at[by_period], period[by_period]
    new = np.ones(len(at), bool)
    new[1:] = (period[1:] != period[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    start, period, length = at[first], period[first], at[last] - at[first] + 2 * period[first]
    long = length >= least
    start, period, length = start[long], period[long], length[long]
    text = owner[start]
    start = start - offsets[text] - text
    by_text = np.lexsort((period, start, text))
    return text[by_text], start[by_text], length[by_text], period[by_text]


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Where the words of a document begin to repeat, and with which period; None for most documents."""
    if doc_id is None or n == 0:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts (null: none), one after the other, and the offsets of the texts in them."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = lists.flatten()
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0)
    owner = np.repeat(np.arange(len(counts)), counts)
    flags = full.to_numpy(zero_copy_only=False)
    counts = np.bincount(owner[flags], minlength=len(counts))
    return flat.filter(full), np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _joined(flat: pa.Array, kept: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The kept words of each text with one space between them."""
    ends = np.concatenate([[0], np.cumsum(kept)])[offsets].astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), flat.filter(pa.array(kept)).cast(pa.string())), " ")


def _longest(text: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Of each text that has runs the number of its longest one."""
    order = np.lexsort((period, start, -length, text))
    new = np.ones(len(order), bool)
    new[1:] = text[order][1:] != text[order][:-1]
    return order[new]


def _work(batch: pa.RecordBatch, plant: bool) -> pa.RecordBatch:
    flat, offsets = _words(batch.column("text"))
    ids = batch.column("doc_id").to_pylist()
    if plant:
        take = np.arange(len(flat))
        for k, doc_id in enumerate(ids):
            n = int(offsets[k + 1] - offsets[k])
            if found := planted(doc_id, n):
                a, p = found
                take[offsets[k] + a : offsets[k + 1]] = offsets[k] + a + np.arange(n - a) % p
        flat = flat.take(pa.array(take))
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, np.int64)
    text, start, length, period = runs(codes, offsets)
    # Words that repeat the first period of a run are dropped.
    edge = np.zeros(len(flat) + 1, np.int64)
    np.add.at(edge, offsets[text] + start + period, 1)
    np.add.at(edge, offsets[text] + start + length, -1)
    kept = np.cumsum(edge[:-1]) == 0
    n = len(ids)
    said = [b""] * n
    for k, *run in zip(text.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
        said[k] += b"%d,%d,%d\n" % tuple(run)
    best = _longest(text, start, length, period)
    none = np.ones(n, bool)
    none[text[best]] = False

    def of_best(values: np.ndarray) -> pa.Array:
        out = np.zeros(n, np.int64)
        out[text[best]] = values[best]
        return pa.array(out, mask=none)

    columns = [
        batch.column("doc_id"),
        pa.array(np.bincount(text, minlength=n).astype(np.int64)),
        of_best(start),
        of_best(length),
        of_best(period),
        of_best(1000 * length // np.maximum(period, 1)),
        pa.array([hashlib.sha256(x).hexdigest() for x in said]),
        pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in _joined(flat, kept, offsets)]),
    ]
    return pa.record_batch(columns, names=NAMES)


NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def run_report(docs: DataFrame, plant: bool = True) -> DataFrame:
    """Of each row of docs its number of runs, the longest one, and digests of all runs and of the words that are left without what runs repeat; plant: texts are changed by their doc_id first (see planted)."""
    small_arrow_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield _work(batch, plant)

    columns = f"doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(work, columns)


def find_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """One row a run of at least `least` words: doc_id, start, length, period, and the words of its first period."""
    small_arrow_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            flat, offsets = _words(batch.column("text"))
            codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, np.int64)
            text, start, length, period = runs(codes, offsets, least)
            roots = pa.array([" ".join(flat.slice(offsets[t] + s, p).to_pylist()) for t, s, p in zip(text, start, period, strict=True)], pa.string())
            yield pa.record_batch([batch.column("doc_id").take(pa.array(text)), pa.array(start), pa.array(length), pa.array(period), roots], names=["doc_id", "start", "length", "period", "root"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, start long, length long, period long, root string")


def collapse(docs: DataFrame) -> DataFrame:
    """docs with what runs repeat taken out of each text that has one: such a text is its kept words with one space between them; all others stay as they are, and so do all other columns."""
    small_arrow_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            column = batch.column("text")
            flat, offsets = _words(column)
            codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, np.int64)
            text, start, length, period = runs(codes, offsets)
            edge = np.zeros(len(flat) + 1, np.int64)
            np.add.at(edge, offsets[text] + start + period, 1)
            np.add.at(edge, offsets[text] + start + length, -1)
            kept = np.cumsum(edge[:-1]) == 0
            joined = _joined(flat, kept, offsets)
            has = np.zeros(batch.num_rows, bool)
            has[text] = True
            yield batch.set_column(at, "text", pc.if_else(pa.array(has), joined.cast(column.type), column))

    return docs.mapInArrow(work, docs.schema)
