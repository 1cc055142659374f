"""Operator 12, periodic runs of words by the branching-tandem test on an enhanced suffix array.

The words of a text (``[^\\x20\\x09-\\x0D]+``) get ids by exact comparison.  Several texts make one row of ids in
which no id is shared between texts, so one suffix array serves them all and no repeat crosses a text.  Ranks
of the first 1, 2, 4, ... words (prefix doubling, only undecided suffixes are sorted again) give the suffix
array, its inverse and, level by level, the longest common prefixes of neighbours.

An LCP interval of depth d is a set of suffixes that share d words and then branch.  For every suffix i of
all children but the largest, ``ISA[i + d]`` and ``ISA[i - d]`` are looked up: if they lie in the interval but
in another child, a square of period d stands at i (at i - d) and cannot be shifted right.  Every run has
exactly one such last square a period; it is rotated left over equal words by the same levels, and squares with
equal ends are one run, of their smallest period.  Intervals are rows of arrays (their bounds by pointer
jumping); no tree is built.  All is O(n log n) for n words, and candidates are taken in bounded pieces.

A run is a stretch whose smallest period q fits at least twice, of ``MIN_WORDS`` words or more, that no
neighbouring word extends.  ``collapsed`` drops every word that some run contains after its first q words and
joins the others by one space.

Defined cases: a null, empty or blank text has no words, no runs and an empty collapse; a text is never cut, and
a long one is a piece of its own; repeated rows are scanned each on its own; an empty table gives an empty result;
extra columns do not matter, as texts are passed as a column.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_WORDS = 12
PIECE_WORDS = 1 << 16  # words of several texts that share one suffix array
PIECE_PAIRS = 1 << 20  # candidate suffixes looked up at once

FIELDS = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def suffix_ranks(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of ``ids``, and the ranks by the first 1, 2, 4, ... ids: equal ranks mean equal ids there."""
    n = len(ids)
    order = np.argsort(ids, kind="stable").astype(np.int32)
    first = np.r_[True, ids[order[1:]] != ids[order[:-1]]]
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    levels, h = [rank], 1
    while True:
        slots = np.flatnonzero(~(first & np.r_[first[1:], True]))  # places whose group has several suffixes
        if not len(slots):
            return order, levels
        at = order[slots]
        ahead = np.where(at + h < n, rank[np.minimum(at + h, n - 1)], -1).astype(np.int64)
        key = rank[at].astype(np.int64) * (n + 1) + ahead + 1
        by = np.argsort(key, kind="stable")
        order[slots] = at = at[by]
        key = key[by]
        begins = np.r_[True, key[1:] != key[:-1]]
        first[slots] = begins
        rank = rank.copy()
        rank[at] = slots[np.maximum.accumulate(np.where(begins, np.arange(len(slots)), 0))]
        levels.append(rank)
        h *= 2


def _shared(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
    """Number of equal ids from places ``a`` and ``b`` on (``step`` 1), or before them (``step`` -1); a < b."""
    n = len(levels[0])
    out = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        h, rank = 1 << k, levels[k]
        x, y = (a + out, b + out) if step > 0 else (a - out - h, b - out - h)
        fits = (y + h <= n) & (x >= 0)
        out += h * (fits & (rank[np.where(fits, x, 0)] == rank[np.where(fits, y, 0)]))
    return out


def _nearest(lcp: np.ndarray, step: int, strict: bool) -> np.ndarray:
    """For every place the nearest one before (``step`` -1) or after it (1) of a smaller value, or, unless
    ``strict``, of one not greater; the ends hold -1.  Pointers jump over what is known to be greater."""
    n = len(lcp)
    to = np.arange(n) + step
    live = np.flatnonzero(lcp > -1)
    while len(live):
        there = lcp[to[live]]
        live = live[(there >= lcp[live]) if strict else (there > lcp[live])]
        to[live] = to[to[live]]
    return to


def branching_squares(order: np.ndarray, levels: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """``(place, period)`` of every square that cannot be shifted right."""
    n = len(order)
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    lcp = np.full(n + 1, -1, np.int64)  # lcp[k] stands between places k-1 and k
    low, high = np.minimum(order[:-1], order[1:]).astype(np.int64), np.maximum(order[:-1], order[1:]).astype(np.int64)
    lcp[1:n] = _shared(levels, low, high, 1)
    lcp[1:n][lcp[1:n] == 0] = -1  # texts and words apart: no interval
    left, right, same = _nearest(lcp, -1, True), _nearest(lcp, 1, True), _nearest(lcp, -1, False)
    splits = np.flatnonzero(lcp > 0)
    if not len(splits):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    # an interval's splits are its places of the smallest value; each ends one child, the last one two
    key = left[splits] * np.int64(n + 1) + right[splits]
    splits = splits[np.argsort(key, kind="stable")]
    opens = lcp[same[splits]] < lcp[splits]  # the interval's first split
    begin = np.where(opens, left[splits], same[splits])
    closes = np.r_[opens[1:], True]
    begin = np.r_[begin, splits[closes]]
    end = np.r_[splits, right[splits[closes]]]
    group = np.r_[np.cumsum(opens) - 1, np.arange(closes.sum())]
    depth, lo, hi = (np.r_[a, a[closes]] for a in (lcp[splits], left[splits], right[splits]))
    by_size = np.lexsort((end - begin, group))
    largest = np.zeros(len(begin), bool)
    largest[by_size[np.r_[group[by_size][1:] != group[by_size][:-1], True]]] = True
    begin, end, depth, lo, hi = (a[~largest] for a in (begin, end, depth, lo, hi))
    places, periods = [], []
    total = np.cumsum(end - begin)
    cut = 0
    while cut < len(begin):
        done = total[cut - 1] if cut else 0
        stop = max(cut + 1, int(np.searchsorted(total, done + PIECE_PAIRS, "right")))
        size = (end - begin)[cut:stop]
        child = np.repeat(np.arange(cut, stop), size)
        i = order[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + begin[child]].astype(np.int64)
        d = depth[child]
        for j, at in ((i + d, i), (i - d, i - d)):
            ok = np.flatnonzero((j >= 0) & (j < n))
            slot, c = inverse[j[ok]], child[ok]
            ok = ok[(slot >= lo[c]) & (slot < hi[c]) & ((slot < begin[c]) | (slot >= end[c]))]
            places.append(at[ok])
            periods.append(d[ok])
        cut = stop
    return np.concatenate(places), np.concatenate(periods)


def runs_of(ids: np.ndarray, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(start, end, period)`` of all runs, by start, then period."""
    if len(ids) < 2:
        return (np.empty(0, np.int64),) * 3
    order, levels = suffix_ranks(ids)
    place, period = branching_squares(order, levels)
    end = place + 2 * period
    start = place - _shared(levels, place, place + period, -1)
    long = end - start >= min_words
    start, end, period = start[long], end[long], period[long]
    by = np.lexsort((period, end, start))
    start, end, period = start[by], end[by], period[by]
    new = np.ones(len(by), bool)  # of squares with the same ends the smallest period is the run's
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[new], end[new], period[new]
    by = np.lexsort((period, start))
    return start[by], end[by], period[by]


def _piece(words: list[list[bytes]], min_words: int):
    """Runs and collapsed text of each of several texts."""
    n = np.array([len(w) for w in words], np.int64)
    first = np.r_[0, np.cumsum(n)]
    flat = [w for ws in words for w in ws]
    coded = pa.array(flat, pa.large_binary()).dictionary_encode()
    ids = coded.indices.to_numpy().astype(np.int64) + np.repeat(np.arange(len(words)), n) * max(1, len(coded.dictionary))
    start, end, period = runs_of(ids, min_words)
    cover = np.zeros(len(flat) + 1, np.int64)
    np.add.at(cover, start + period, 1)
    np.add.at(cover, end, -1)
    gone = np.cumsum(cover[:-1]) > 0
    text = np.searchsorted(first, start, "right") - 1
    bounds = np.searchsorted(text, np.arange(len(words) + 1))
    for k, ws in enumerate(words):
        a, b = bounds[k], bounds[k + 1]
        if a == b:
            yield (), b" ".join(ws)
        else:
            found = zip((start[a:b] - first[k]).tolist(), (end - start)[a:b].tolist(), period[a:b].tolist())
            kept = np.flatnonzero(~gone[first[k]:first[k + 1]]).tolist()
            yield tuple(found), b" ".join([ws[i] for i in kept])


def scan_texts(texts: list[bytes | None], min_words: int = MIN_WORDS):
    """``(n_words, runs, collapsed)`` of every text (UTF-8); ``bytes.split`` takes the words of the contract."""
    held, size = [], 0
    for t in texts:
        words = (t or b"").split()
        if held and size + len(words) > PIECE_WORDS:
            yield from ((len(w), *r) for w, r in zip(held, _piece(held, min_words)))
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield from ((len(w), *r) for w, r in zip(held, _piece(held, min_words)))


def scan(text: Column, min_words: int = MIN_WORDS) -> Column:
    """Struct of ``FIELDS`` of a text: number of words, all runs by start, then period, and the collapsed text."""
    def run(texts: pa.Array) -> pa.Array:
        counts, runs, ends, collapsed = [], [], [0], []
        for n, found, rest in scan_texts(texts.cast(pa.large_binary()).to_pylist(), min_words):
            counts.append(n)
            runs += found
            ends.append(len(runs))
            collapsed.append(rest)
        columns = list(zip(*runs)) or [[]] * 3
        flat = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields=list(_RUN))
        return pa.StructArray.from_arrays(
            [pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat),
             pa.array(collapsed, pa.binary()).cast(pa.string())], ["n_words", "runs", "collapsed"])

    return F.arrow_udf(run, FIELDS)(text)


def looped(text: Column, key: Column) -> Column:
    """The text whose tail is made periodic for one key in ten (a planted fault): with h the crc32 of the key's
    decimal form, g = h // 10 and n words, from word a = g % n on word i becomes word a + (i - a) % p, where
    p = 1 + (n - a) // (3 + g % 8).  Other texts, and those of null keys, stay as they are."""
    h = F.crc32(key.cast("string").cast("binary"))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    g = F.floor(h / 10)
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (3 + g % 8))
    head, tail = F.slice(words, 1, a.cast("int")), F.slice(words, (a + 1).cast("int"), p.cast("int"))
    often = F.flatten(F.array_repeat(tail, (3 + g % 8).cast("int")))  # p * (3 + g % 8) > n - a
    made = F.concat(head, F.slice(often, 1, (n - a).cast("int")))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(made, " ")).otherwise(text)


def digest(scanned: Column) -> dict[str, Column]:
    """Columns of the registered query from the struct of ``scan``."""
    runs = scanned["runs"]
    best = F.element_at(F.array_sort(runs, lambda x, y: F.when(x["length"] > y["length"], -1).when(
        x["length"] < y["length"], 1).when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1).when(
        x["period"] < y["period"], -1).otherwise(1)), 1)
    best = F.when(F.size(runs) > 0, best)
    lines = F.array_join(F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size(runs) > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return {"n_runs": F.size(runs).cast("long"), "start": best["start"], "length": best["length"],
            "period": best["period"], "exponent_milli": F.floor(1000 * best["length"] / best["period"]),
            "runs_sha256": F.sha2(listed, 256), "collapsed_sha256": F.sha2(scanned["collapsed"], 256)}
