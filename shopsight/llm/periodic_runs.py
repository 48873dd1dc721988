"""Periodic runs: stretches of words that repeat with a period.

A run is a stretch of consecutive words with smallest period q, of at least
``min_length`` words and ``exponent`` periods, that no neighbouring word extends
keeping that period.  They are found in each text by an enhanced suffix array over
its words: suffix order by prefix doubling, longest common prefixes (LCP) from the
ranks of the doubling, and the LCP intervals from nearest smaller values.  In an
interval of depth d, suffixes i and i+d that both lie in it and differ after d words
are a branching square of period d.  Each suffix outside the interval's largest
child is tested against both neighbours, i+d and i-d, by its place in the suffix
order.  A square is then rotated to the left as long as it stays one; where it stops, the run
begins, and where the square ends, the run ends.  Squares of multiples of a period
give the same stretch, of which the least period is kept.  There are no tree nodes.

Texts are handled in slices of some MB inside one pass without shuffle; word numbers
are exact, and suffixes of different texts are never equal.  Memory in a task grows
with the longest single text (some 100 bytes a word), not with the table.

Defined results: a null or empty text has no words and no run; repeated rows and
shared or null ids are each treated as a row of their own; an empty table gives no
rows; a very long text is a slice of its own and is searched whole; ties between
strongest runs go to the smallest start, then period; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopsight.llm._lexicon import number_words
from shopsight.llm._text import buffer, document_columns, ranges, text_slices

#: Suffixes of smaller children tested at once.
_BLOCK = 1 << 21


@dataclass
class SuffixOrder:
    """Suffixes of all texts of a slice, text by text."""

    order: np.ndarray          # suffix at each place
    place: np.ndarray          # place of each suffix
    levels: list[np.ndarray]   # ranks by the first 1, 2, 4, ... words; equal ranks are equal words


def suffix_order(numbers: np.ndarray, first: np.ndarray) -> SuffixOrder:
    """Prefix doubling; only suffixes that still tie are sorted again."""
    n = len(numbers)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    end = first[1:][text]
    key = text * (int(numbers.max(initial=0)) + 1) + numbers
    order = np.argsort(key, kind="stable")
    rank, slots, keys = np.empty(n, np.int64), np.arange(n), key[order]
    levels, step = [], 1
    while True:
        head = np.ones(len(slots), bool)
        head[1:] = keys[1:] != keys[:-1]
        rank[order[slots]] = np.maximum.accumulate(np.where(head, slots, 0))
        levels.append(np.append(rank, -1).astype(np.int32 if n < 1 << 31 else np.int64))
        tied = ~head
        tied[:-1] |= ~head[1:]
        slots = slots[tied]
        if not len(slots):
            break
        who = order[slots]
        after = np.where(who + step < end[who], rank[np.minimum(who + step, n - 1)], -1)
        keys = rank[who] * (n + 1) + after + 1
        by = np.argsort(keys, kind="stable")
        order[slots], keys = who[by], keys[by]
        step *= 2
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    return SuffixOrder(order, place, levels)


def common_prefixes(suffixes: SuffixOrder) -> np.ndarray:
    """Words that each suffix shares with the one before it in the order."""
    order, levels = suffixes.order, suffixes.levels
    n = len(order)
    out, top = np.zeros(n, np.int64), np.zeros(n, np.int64)
    who = np.arange(1, n)
    for k, rank in enumerate(levels):
        who = who[rank[order[who - 1]] == rank[order[who]]]
        top[who] = k + 1
    for k in range(len(levels) - 1, -1, -1):
        who = np.flatnonzero(top > k)
        same = levels[k][order[who - 1] + out[who]] == levels[k][order[who] + out[who]]
        out[who[same]] += 1 << k
    return out


class Minima:
    """Nearest places with a smaller value, by minima over windows of 1, 2, 4, ..."""

    def __init__(self, values: np.ndarray, longest: int):
        self.tables = [values]
        width = 1
        while width * 2 <= min(longest, len(values)):
            last = self.tables[-1]
            self.tables.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def before(self, at: np.ndarray, value: np.ndarray, equal: bool) -> np.ndarray:
        """The last place before ``at`` whose value is smaller (or ``equal``)."""
        at = at.copy()
        for k in range(len(self.tables) - 1, -1, -1):
            left = at - (1 << k)
            least = self.tables[k][np.maximum(left, 0)]
            at = np.where((left >= 0) & ((least > value) if equal else (least >= value)), left, at)
        return at - 1

    def after(self, at: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The first place after ``at`` whose value is smaller (or past the end)."""
        at = at + 1
        for k in range(len(self.tables) - 1, -1, -1):
            table = self.tables[k]
            inside = at < len(table)
            at = np.where(inside & (table[np.minimum(at, len(table) - 1)] >= value), at + (1 << k), at)
        return at


def _smaller_children(common: np.ndarray, longest: int, fewest: int) -> tuple[np.ndarray, ...]:
    """Every child but a largest one of each LCP interval of at least ``fewest``
    suffixes: the child's first place and size, the interval's first place, its
    past-the-end place and its depth."""
    cut = np.flatnonzero(common > 0)
    if not len(cut):
        return (np.zeros(0, np.int64),) * 5
    depth, minima = common[cut], Minima(common, longest)
    past = minima.after(cut, depth)
    left = minima.before(cut, depth, False)
    big = past - left >= fewest
    cut, depth, past, left = cut[big], depth[big], past[big], left[big]
    if not len(cut):
        return (np.zeros(0, np.int64),) * 5
    begin = minima.before(cut, depth, True)
    # cuts of one interval share its first place and depth
    by = np.lexsort((cut, depth, left))
    cut, depth, past, left, begin = cut[by], depth[by], past[by], left[by], begin[by]
    last = np.ones(len(cut), bool)
    last[:-1] = (left[1:] != left[:-1]) | (depth[1:] != depth[:-1])
    interval = np.cumsum(last) - last
    owner = np.concatenate((interval, interval[last]))
    begin = np.concatenate((begin, cut[last]))
    size = np.concatenate((cut - begin[:len(cut)], past[last] - cut[last]))
    low, high, deep = left[last], past[last], depth[last]
    by = np.lexsort((size, owner))
    owner, begin, size = owner[by], begin[by], size[by]
    small = np.zeros(len(owner), bool)
    small[:-1] = owner[1:] == owner[:-1]
    owner, begin, size = owner[small], begin[small], size[small]
    return begin, size, low[owner], high[owner], deep[owner]


def find_runs(numbers: np.ndarray, first: np.ndarray, *, min_length: int = 6, exponent: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word (of the slice), length and period of every run, by first word
    and period."""
    none = np.zeros(0, np.int64)
    if len(numbers) < 2:
        return none, none, none
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    suffixes = suffix_order(numbers, first)
    order, place, levels = suffixes.order, suffixes.place, suffixes.levels
    # a run of k periods puts k suffixes into the interval of its period
    begin, size, low, high, depth = _smaller_children(common_prefixes(suffixes), int(np.diff(first).max()), max(exponent, 2))
    starts, periods = [], []
    bounds = np.cumsum(size)
    at = 0
    while at < len(begin):
        to = max(at + 1, int(np.searchsorted(bounds, (bounds[at - 1] if at else 0) + _BLOCK, "right")))
        child = np.repeat(np.arange(at, to), size[at:to])
        here = order[ranges(begin[at:to], size[at:to])]
        d = depth[child]
        for sign in (1, -1):  # the neighbour on either side
            there = here + sign * d
            fits = (there >= first[text[here]]) & (there < first[1:][text[here]])
            spot = place[np.where(fits, there, 0)]
            fits &= (spot >= low[child]) & (spot < high[child])
            square, period = np.minimum(here, there)[fits], d[fits]
            tail = square + 2 * period
            done = tail == first[1:][text[square]]
            branching = done | (numbers[np.where(done, 0, tail)] != numbers[square + period])
            starts.append(square[branching])
            periods.append(period[branching])
        at = to
    if not starts:
        return none, none, none
    start, period = np.concatenate(starts), np.concatenate(periods)
    stop, floor = start + 2 * period, first[:-1][text[start]]
    for k in range(len(levels) - 1, -1, -1):  # rotate to the left
        left = start - (1 << k)
        ok = left >= floor
        left = np.where(ok, left, start)
        start = np.where(ok & (levels[k][left] == levels[k][left + period]), left, start)
    enough = stop - start >= np.maximum(min_length, exponent * period)
    start, stop, period = start[enough], stop[enough], period[enough]
    by = np.lexsort((period, stop, start))
    start, stop, period = start[by], stop[by], period[by]
    least = np.ones(len(start), bool)
    least[1:] = (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    start, stop, period = start[least], stop[least], period[least]
    by = np.lexsort((period, start))
    return start[by], (stop - start)[by], period[by]


def periodic_runs(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, exponent: int = 4) -> DataFrame:
    """Of every document: doc_id, n_words, runs (start, length and period in words, by
    start, then period) and collapsed (the words without those that a run repeats
    after its first period, joined by one space)."""
    docs = document_columns(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text"):
            data, offsets = buffer(part.column("text"))
            numbers, first, words = number_words(data, offsets)
            start, length, period = find_runs(numbers, first, min_length=min_length, exponent=exponent)
            owner = np.searchsorted(first, start, "right") - 1
            edge = np.zeros(len(numbers) + 1, np.int64)  # starts and ends of dropped stretches
            np.add.at(edge, start + period, 1)
            np.add.at(edge, start + length, -1)
            kept = np.cumsum(edge[:-1]) == 0
            runs: list[list[dict]] = [[] for _ in range(part.num_rows)]
            for k, s, n, q in zip(owner.tolist(), start.tolist(), length.tolist(), period.tolist()):
                runs[k].append({"start": s - int(first[k]), "length": n, "period": q})
            collapsed = []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                collapsed.append(b" ".join(map(words.__getitem__, numbers[a:b][kept[a:b]].tolist())).decode())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(first)), pa.array(runs, run_type), pa.array(collapsed, pa.string())],
                                             names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.mapInArrow(search, f"doc_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def _stronger(a: Column, b: Column) -> Column:
    """Which of two runs comes first: the greater exponent by exact products, then the
    smaller start, then the smaller period."""
    left, right = a["length"] * b["period"], b["length"] * a["period"]
    return (F.when(left > right, -1).when(left < right, 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1)
            .when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0))


def run_digests(found: DataFrame) -> DataFrame:
    """Of the rows of ``periodic_runs``: the number of runs, the strongest one (nulls
    without a run), and checksums of all runs and of the collapsed text."""
    top = F.get(F.array_sort("runs", _stronger), 0)
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("_top"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
                        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", F.col("_top.start").alias("start"), F.col("_top.length").alias("length"), F.col("_top.period").alias("period"),
        F.expr("_top.length * 1000 div _top.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
