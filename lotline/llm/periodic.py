"""Runs of words that repeat with a period, found on a harmonic grid.

For each period p the words at j * p and (j + 1) * p are compared. A run of at least REPEATS periods has
REPEATS - 1 such pairs of equal words in a row, so only where as many stand in a row is it asked how far
the text agrees with itself from there: the longest common extension (LCE) of both places, forward in
the words and backward in the reversed words. The sum of n / p places over all p is about n log n.

An LCE is a range minimum over the common prefixes of neighbours in a suffix array, by a sparse table.
The suffix array comes from prefix doubling, in which only suffixes that are still tied are sorted
again. The texts of a part of a batch share one suffix array, in which no suffix reaches into the next
text; texts without such a place are in none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from lotline.llm.common import slices, small_batches, unused

#: A run has at least so many words and so many periods.
LEAST, REPEATS = 6, 4
#: Texts of up to so many words read their grid from a table; longer ones go period by period.
TABLE = 1 << 14
#: Places of the grid whose extensions are asked for at a time.
STEP = 1 << 20
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class Grid:
    """Pairs (m - p, m) for every divisor p of m, in order of m: those below n are the grid of n words."""

    def __init__(self):
        self.upto = 0

    def pairs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.upto:
            self.upto = min(TABLE, max(1024, 2 * n))
            m = np.concatenate([np.arange(p, self.upto, p, dtype=np.int32) for p in range(1, self.upto // REPEATS + 1)])
            p = np.concatenate([np.full((self.upto - 1) // p, p, np.int32) for p in range(1, self.upto // REPEATS + 1)])
            order = np.argsort(m, kind="stable")
            self.m, self.p = m[order], p[order]
            self.counts = np.searchsorted(self.m, np.arange(self.upto + 1))
        k = self.counts[n]
        return self.m[:k], self.p[:k]

    def places(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(m, p) where the words at m - p, m, m + p, ... are equal, REPEATS in a row."""
        n = len(w)
        if n < LEAST:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if n <= TABLE:
            m, p = self.pairs(n)
            at = np.flatnonzero(w[m - p] == w[m])
            m, p = m[at].astype(np.int64), p[at].astype(np.int64)
            for k in range(1, REPEATS - 1):
                ok = m + k * p < n
                m, p = m[ok], p[ok]
                ok = w[m + k * p] == w[m]
                m, p = m[ok], p[ok]
            return m, p
        found = []
        for p in range(1, n // REPEATS + 1):
            g = w[::p]
            same = g[1:] == g[:-1]
            row = same[: len(same) - REPEATS + 2].copy()
            for k in range(1, REPEATS - 1):
                row &= same[k : len(same) - REPEATS + 2 + k]
            if row.any():
                m = (np.flatnonzero(row) + 1) * p
                found.append((m, np.full(len(m), p)))
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


class Extensions:
    """Longest common prefixes of suffixes of ``words``; a suffix ends with its text. ``text`` is the
    number of each word's text, ``end`` where that ends."""

    def __init__(self, words: np.ndarray, text: np.ndarray, end: np.ndarray):
        n = len(words)
        first = text.astype(np.int64) * (int(words.max(initial=0)) + 1) + words
        order = np.argsort(first, kind="stable")
        new = np.r_[True, np.diff(first[order]) != 0]
        starts = np.flatnonzero(new)
        rank = np.empty(n, np.int32)  # how many suffixes are smaller, as far as is known
        rank[order] = np.repeat(starts, np.diff(np.r_[starts, n]))
        came = np.where(new, 0, 127).astype(np.int8)  # the round in which a place in the order was told from the one before
        levels, tied = [], np.sort(order[np.repeat(np.diff(np.r_[starts, n]), np.diff(np.r_[starts, n])) > 1])
        step = 1
        while len(tied):
            levels.append(rank.copy())
            after = tied + step
            k1 = rank[tied].astype(np.int64)
            k2 = np.where(after < end[tied], rank[np.minimum(after, n - 1)].astype(np.int64) + 1, 0)
            key = k1 * (n + 1) + k2
            o = np.argsort(key, kind="stable")
            key, k1, who = key[o], k1[o], tied[o]
            new = np.r_[True, np.diff(key) != 0]
            group = np.maximum.accumulate(np.where(np.r_[True, np.diff(k1) != 0], np.arange(len(o)), 0))
            starts = np.flatnonzero(new)
            size = np.diff(np.r_[starts, len(o)])
            place = k1[starts] + starts - group[starts]
            split = place[place > k1[starts]]
            came[split] = len(levels)
            rank[who] = np.repeat(place, size)
            tied = who[np.repeat(size, size) > 1]
            step *= 2
        self.rank = rank
        order = np.empty(n, np.int64)
        order[rank] = np.arange(n)
        lcp = np.zeros(n, np.int64)
        for k in range(len(levels) - 1, -1, -1):
            at = np.flatnonzero(came > k)
            i, j = order[at - 1] + lcp[at], order[at] + lcp[at]
            ok = (i < end[order[at - 1]]) & (j < end[order[at]])
            at, i, j = at[ok], i[ok], j[ok]
            lcp[at[levels[k][i] == levels[k][j]]] += 1 << k
        longest = int((end - np.arange(n)).max(initial=1))
        self.table = [lcp.astype(np.int32)]
        while 2 << (len(self.table) - 1) < longest:
            t, half = self.table[-1], 1 << (len(self.table) - 1)
            self.table.append(np.minimum(t[: max(0, len(t) - half)], t[half:]))

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The common prefixes of suffixes i and j, which differ and are of the same text."""
        a, b = self.rank[i].astype(np.int64), self.rank[j].astype(np.int64)
        lo, hi = np.minimum(a, b) + 1, np.maximum(a, b) + 1
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            at, t = np.flatnonzero(level == k), self.table[k]
            out[at] = np.minimum(t[lo[at]], t[hi[at] - (1 << k)])
        return out


def runs_of(words: np.ndarray, bounds: np.ndarray, grid: Grid) -> tuple[np.ndarray, ...]:
    """Runs of the texts whose words are ``words[bounds[k]:bounds[k + 1]]``, as (text, start, length,
    period), by text, start and period."""
    places = [grid.places(words[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    some = np.array([k for k, (m, _) in enumerate(places) if len(m)], np.int64)
    if not len(some):
        return (np.zeros(0, np.int64),) * 4
    sizes = (bounds[1:] - bounds[:-1])[some]
    ends = np.cumsum(sizes)
    begins = ends - sizes
    w = np.concatenate([words[bounds[k] : bounds[k + 1]] for k in some])
    text, end = np.repeat(np.arange(len(some)), sizes), np.repeat(ends, sizes)
    m = np.concatenate([places[k][0] + b for k, b in zip(some, begins)])
    p = np.concatenate([places[k][1] for k in some])
    which = np.repeat(np.arange(len(some)), [len(places[k][0]) for k in some])
    ahead = Extensions(w, text, end)
    forward = np.concatenate([ahead.of(m[x : x + STEP] - p[x : x + STEP], m[x : x + STEP]) for x in range(0, len(m), STEP)])
    del ahead
    # word x of the reversed array is word len(w) - 1 - x: texts come in reverse order too
    behind, last = Extensions(w[::-1], (len(some) - 1 - text)[::-1], len(w) - np.repeat(begins, sizes)[::-1]), len(w) - 1
    backward = np.zeros(len(m), np.int64)
    inner = np.flatnonzero(m - p > begins[which])
    for x in range(0, len(inner), STEP):
        at = inner[x : x + STEP]
        backward[at] = behind.of(last - (m[at] - p[at] - 1), last - (m[at] - 1))
    start, length = m - p - backward, p + forward + backward
    keep = length >= np.maximum(LEAST, REPEATS * p)
    which, start, length, p = which[keep], start[keep], length[keep], p[keep]
    order = np.lexsort((p, length, start))
    which, start, length, p = which[order], start[order], length[order], p[order]
    # a stretch that shows with several periods has the least of them, which divides the others
    new = np.r_[True, (np.diff(start) != 0) | (np.diff(length) != 0)] if len(p) else np.zeros(0, bool)
    which, start, length, p = which[new], start[new], length[new], p[new]
    order = np.lexsort((p, start))
    return some[which[order]], (start - begins[which])[order], length[order], p[order]


def find_runs(docs: DataFrame, *keep: str) -> DataFrame:
    """``docs`` (keep, text): keep, n_words, runs (start, length, period; by start and period) and
    collapsed, the text's words, joined by one space, without those that a run has after its first
    period. A row per row.

    Words are what stands between ASCII blanks. A run is a stretch with least period q (words q apart are
    the same) of at least LEAST words and REPEATS * q words that no neighbouring word extends. Runs may
    overlap. A null text, an empty one and one of blanks have no words and no runs. Texts of any length
    are taken whole: what is kept of a text with a run while it is worked on are some 16 bytes a word for
    each doubling of its length. Nulls, repeated rows and values of ``keep`` come back as they are; other
    columns are not read. An empty table gives an empty result.
    """
    names = unused(docs.select(*keep), "n_words", "runs", "collapsed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = Grid()
        for batch in batches:
            for part in slices(batch, batch.column(len(keep)).to_pylist()):
                lists = pc.ascii_split_whitespace(pc.fill_null(part.column(len(keep)), ""))
                flat, bounds = lists.flatten(), np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]
                full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
                flat, bounds = flat.filter(pa.array(full)), np.r_[0, np.cumsum(full)][bounds]
                coded = pc.dictionary_encode(flat)
                words = coded.indices.to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0, np.int32)
                text, start, length, period = runs_of(words, bounds, grid)
                depth = np.zeros(len(words) + 1, np.int64)
                np.add.at(depth, bounds[text] + start + period, 1)
                np.add.at(depth, bounds[text] + start + length, -1)
                kept = np.cumsum(depth[:-1]) == 0
                words_kept = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(kept)][bounds].astype(np.int32)), flat.filter(pa.array(kept)))
                by_text = pa.array(np.searchsorted(text, np.arange(len(bounds))).astype(np.int32))
                runs = pa.ListArray.from_arrays(by_text, pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in (start, length, period)], names=["start", "length", "period"]))
                out = [pa.array(np.diff(bounds).astype(np.int64)), runs, pc.binary_join(words_kept, " ")]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *out], names=[*keep, *names])

    small_batches(docs.sparkSession)
    rows = docs.select(*keep, "text")
    kinds = StructType.fromDDL(f"n bigint, runs {RUNS}, collapsed string").fields
    return rows.mapInArrow(run, StructType([*rows.schema.fields[: len(keep)], *[StructField(n, k.dataType) for n, k in zip(names, kinds)]]))


def top_run(runs):
    """Of an array of runs, as a Column, that with the greatest length / period; of equal ones the first."""
    better = lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a)
    return F.when(F.size(runs) > 0, F.aggregate(runs, F.get(runs, 0), better))
