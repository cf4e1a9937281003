"""Periodic runs of words by the branching-tandem test on an enhanced suffix array.

The words of many documents are sorted as suffixes at once; a word counts as another one in every
document, so nothing is ever equal across documents. Then, on arrays alone (suffix
order, its inverse, LCP; no tree is built):

1. Every LCP boundary is a place where an LCP interval of some depth divides into children. Suffixes of
   the smaller side are listed (n log n in all), and for each the inverse order tells
   whether the suffix `depth` words after or before it lies on the other side. If
   so, the two stand one depth apart and differ right after it: a square of that period that
   cannot be moved to the right.
2. Only squares of which two more periods stand before them can belong to a run of four
   periods; that is checked by ranks kept from the sorting.
3. What is left is rotated to the left for as long as words a period apart are equal, which gives the
   whole run. A square whose period is a multiple of that of a run with the same end is the
   same run again and goes.

Depths beyond a quarter of a document cannot be periods of such runs and are not sorted out.
Every document is one value of its row; memory is bounded by some hundred bytes a word of the
longest document.

Rows: null or empty text has no words and no runs; a text of one word a million times is one run; repeated rows
are searched one by one; null keys stay; an empty table gives no rows; extra columns are passed on,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

# Fixed values of the contract: a run has at least so many periods and words.
POWER, SHORTEST = 4, 6
GROUP_WORDS, PAIRS = 1 << 17, 1 << 21


def expand(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges [start, end), and the range each is from."""
    sizes = ends - starts
    owner = np.repeat(np.arange(len(starts)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[owner]


def heads(new: np.ndarray) -> np.ndarray:
    """Place of the last True up to each place."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


class SuffixArray:
    """`words`: word numbers of all documents; `owner`: the document of each word, ascending."""

    def __init__(self, words: np.ndarray, owner: np.ndarray):
        n = len(words)
        sizes = np.bincount(owner)
        self.ends = np.cumsum(sizes)[owner]
        self.starts = self.ends - sizes[owner]
        self.deepest = sizes[owner] // POWER
        key = owner * (int(words.max()) + 1) + words
        order = np.argsort(key, kind="stable")
        first = heads(np.append(True, key[order][1:] != key[order][:-1]))
        rank = np.empty(n, "i8")
        rank[order] = first
        self.levels = [rank.astype("i4")]
        span = 1
        while True:
            met = np.bincount(rank, minlength=n)
            open_ = np.flatnonzero((met[rank] > 1) & (self.deepest >= span))
            if not len(open_):
                break
            after = open_ + span
            inside = after < self.ends[open_]
            second = np.where(inside, rank[np.where(inside, after, 0)] + 1, 0)
            by = np.lexsort((second, rank[open_]))
            old, second, open_ = rank[open_][by], second[by], open_[by]
            fresh = np.append(True, old[1:] != old[:-1])
            split = fresh | np.append(True, second[1:] != second[:-1])
            rank = rank.copy()
            rank[open_] = old + heads(split) - heads(fresh)
            self.levels.append(rank.astype("i4"))
            span *= 2
        self.order = np.argsort(rank, kind="stable")
        self.inverse = np.empty(n, "i8")
        self.inverse[self.order] = np.arange(n)

    def lcp(self) -> np.ndarray:
        """Words that neighbours in suffix order share; exact up to a quarter of the document, at least a quarter beyond."""
        order, level = self.order, self.levels
        out = np.zeros(len(order) + 1, "i8")
        at = 1 + np.flatnonzero(level[0][order[1:]] == level[0][order[:-1]])
        a, b, shared = order[at - 1], order[at], np.zeros(len(at), "i8")
        for i in reversed(range(len(level))):
            x, y = a + shared, b + shared
            inside = np.flatnonzero((x < self.ends[a]) & (y < self.ends[b]))
            shared[inside[level[i][x[inside]] == level[i][y[inside]]]] += 1 << i
        out[at] = shared
        return out

    def equal(self, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether `size` words (a quarter of the document at most) from `a` and from `b` on are the same."""
        out = np.zeros(len(a), bool)
        which = np.frexp(size)[1] - 1
        for i in np.unique(which):
            at, level = np.flatnonzero(which == i), self.levels[i]
            shift = size[at] - (1 << int(i))
            out[at] = (level[a[at]] == level[b[at]]) & (level[a[at] + shift] == level[b[at] + shift])
        return out


def first_below(values: np.ndarray, starts: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The first place from each start on whose value is below the limit; some value must be. A pyramid of block
    minima is climbed until a block holds one, then descended."""
    pyramid = [values]
    while len(pyramid[-1]) > 1:
        low = pyramid[-1]
        low = np.append(low, np.iinfo("i8").max) if len(low) % 2 else low
        pyramid.append(np.minimum(low[::2], low[1::2]))
    at, found = starts.copy(), np.full(len(starts), -1)
    searching = np.arange(len(starts))
    for i, low in enumerate(pyramid):
        # Even blocks lie in the next larger one; odd ones are looked at here.
        odd = searching[(at[searching] >> i) & 1 == 1] if i + 1 < len(pyramid) else searching
        hit = low[at[odd] >> i] < limits[odd]
        found[odd[hit]] = i
        at[odd[~hit]] += 1 << i
        searching = searching[found[searching] < 0]
        if not len(searching):
            break
    for i in reversed(range(int(found.max(initial=0)))):
        below = np.flatnonzero(found > i)
        at[below] += np.where(pyramid[i][at[below] >> i] < limits[below], 0, 1 << i)
    return at


def squares(suffixes: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
    """(start, period) of the squares that cannot move to the right and have two periods more before them."""
    s, lcp = suffixes, suffixes.lcp()
    at = np.flatnonzero(lcp)
    at = at[lcp[at] <= s.deepest[s.order[at]]]
    if not len(at):
        return np.zeros(0, "i8"), np.zeros(0, "i8")
    depth, last = lcp[at], len(lcp) - 1
    right = first_below(lcp, at + 1, depth)
    left = last - first_below(lcp[::-1].copy(), last - at + 1, depth + 1)
    smaller = at - left <= right - at
    low, high = np.where(smaller, left, at), np.where(smaller, at, right)
    other_low, other_high = np.where(smaller, at, left), np.where(smaller, right, at)
    found = []
    cut = np.searchsorted(np.cumsum(high - low), np.arange(PAIRS, int((high - low).sum()) + PAIRS, PAIRS), side="right")
    for a, b in zip(np.append(0, cut[:-1]), np.append(cut[:-1], len(at)), strict=True):
        boundary, place = expand(low[a:b], high[a:b])
        boundary += a
        suffix, step = s.order[place], depth[boundary]
        for sign in (1, -1):
            partner = suffix + sign * step
            start = np.minimum(suffix, partner)
            # Three periods up to the end of the first half, and a half after it.
            ok = np.flatnonzero((start - 2 * step >= s.starts[suffix]) & (partner < s.ends[suffix]))
            where = s.inverse[partner[ok]]
            ok = ok[(where >= other_low[boundary[ok]]) & (where < other_high[boundary[ok]])]
            start, period = start[ok], step[ok]
            whole = s.equal(start - period, start, period) & s.equal(start - 2 * period, start, period)
            found.append((start[whole], period[whole]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def rotate(words: np.ndarray, start: int, period: int, least: int) -> int:
    """How far to the left words a period apart stay equal."""
    step = 64
    while start > least:
        begin = max(least, start - step)
        differs = np.flatnonzero(words[begin:start] != words[begin + period : start + period])
        if len(differs):
            return begin + int(differs[-1]) + 1
        start, step = begin, step * 2
    return start


def runs_of(words: np.ndarray, owner: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """By document (start, length, period), places counted from its first word, by start, then period."""
    suffixes, out, by_end = SuffixArray(words, owner), {}, {}
    starts, periods = squares(suffixes)
    for i in np.argsort(periods, kind="stable"):
        start, period = int(starts[i]), int(periods[i])
        end, least = start + 2 * period, int(suffixes.starts[start])
        known = by_end.setdefault(end, [])
        if any(period % p == 0 and begin <= start for begin, p in known):
            continue
        begin = rotate(words, start - 2 * period, period, least)
        known.append((begin, period))
        if end - begin >= max(SHORTEST, POWER * period):
            out.setdefault(int(owner[start]), []).append((begin - least, end - begin, period))
    return {doc: sorted(found, key=lambda r: (r[0], r[2])) for doc, found in out.items()}


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words that no run holds after its first period."""
    covered = np.zeros(len(words) + 1, "i8")
    for start, length, period in runs:
        covered[start + period] += 1
        covered[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(covered[:-1]) == 0)]


def _search(texts: list[bytes]) -> tuple[list[int], list[list], list[bytes]]:
    split = [t.split() for t in texts]
    number: dict[bytes, int] = {}
    words = np.array([number.setdefault(w, len(number)) for doc in split for w in doc], "i8")
    owner = np.repeat(np.arange(len(split)), [len(doc) for doc in split])
    found = runs_of(words, owner) if len(words) else {}
    runs = [found.get(i, []) for i in range(len(split))]
    left = [without_repeats(doc, r) if r else doc for doc, r in zip(split, runs, strict=True)]
    return [len(doc) for doc in split], runs, [b" ".join(doc) for doc in left]


def find_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds `found`, a struct of `n_words`, `runs` (array of start, length, period) and `collapsed`, the words
    that no run holds after its first period, joined by one space. Words are what stands between white space
    of ASCII. `found` replaces a column of that name."""
    kept = [c for c in docs.columns if c != "found"]
    one_run = StructType().add("start", LongType()).add("length", LongType()).add("period", LongType())
    found_type = StructType().add("n_words", LongType()).add("runs", ArrayType(one_run)).add("collapsed", StringType())
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, counts, runs, collapsed = batch.column("data"), [], [], []
            group, size = [], 0
            for i in range(len(data)):
                one = data[i].as_py() or b""
                group.append(one)
                size += len(one) // 6 + 1
                if size >= GROUP_WORDS or i + 1 == len(data):
                    for all_, new in zip((counts, runs, collapsed), _search(group), strict=True):
                        all_.extend(new)
                    group, size = [], 0
            listed = pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs], pa.list_(run_type))
            columns = [pa.array(counts, pa.int64()), listed, pa.array(collapsed, pa.string())]
            found = pa.StructArray.from_arrays(columns, names=["n_words", "runs", "collapsed"])
            yield pa.RecordBatch.from_arrays([batch.column("rest"), found], names=["rest", "found"])

    rest = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("rest")
    rows = docs.select(rest, F.col(f"`{text}`").cast("string").cast("binary").alias("data"))
    schema = StructType([rows.schema["rest"]]).add("found", found_type)
    return rows.mapInArrow(run, schema).select("rest.*", "found")
