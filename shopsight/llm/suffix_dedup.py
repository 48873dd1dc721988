"""Suffix-array dedup: bytes covered by a long string that occurs elsewhere.

Windows of ``window`` bytes that can be equal meet by ``_repeats``.  There their
suffixes are sorted (prefix doubling, cut at the window's length, ties by
position) and the longest-previous-factor array is read off the order: a
suffix's longest earlier match, up to the window, is with its previous or next
smaller position in suffix order.  With the cut, a previous factor of full
length exists exactly if the neighbour before has an equal window, and a later
match exactly if the neighbour after has.

``keep_first`` removes what has an earlier match and keeps the first copy;
otherwise every copy goes.  Strings are judged on the input.

Defined results: null text is empty; equal rows are copies of each other; rows
that share an id but not a text are documents of their own (by id, then by
checksum of the text); null ids come last; ids are integers; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from shopsight.llm._repeats import Plan, repeated_spans
from shopsight.llm._text import BYTE_CODE, Spans, ranges

#: Bytes whose suffixes are sorted at once.
_SORT_BYTES = 4 << 20


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """The rank of each position's first ``length`` bytes among all (equal bytes,
    equal rank), by prefix doubling; positions past the end sort first."""
    rank = data.astype(np.int64) + 1
    have = 1
    while have < length:
        step = min(have, length - have)
        after = np.zeros_like(rank)
        after[: len(rank) - step] = rank[step:]
        both = rank * (int(rank.max(initial=0)) + 1) + after
        rank = np.unique(both, return_inverse=True)[1].astype(np.int64) + 1
        have += step
    return rank


def previous_factors(data: np.ndarray, length: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the ascending positions ``at``: whether its ``length`` bytes also
    start at an earlier one of them, and whether at a later one (the capped
    longest-previous-factor array and its mirror image, told by the neighbours in
    suffix order)."""
    rank = suffix_ranks(data, length)[at]
    order = np.argsort(rank, kind="stable")  # the suffix order, ties by position
    same = rank[order[1:]] == rank[order[:-1]]
    earlier, later = np.zeros(len(at), bool), np.zeros(len(at), bool)
    earlier[order[1:]] = same  # the previous smaller position is the neighbour
    later[order[:-1]] = same  # and so is the next larger one
    return earlier, later


def _compare(window: int, keep_first: bool):
    def run(body: np.ndarray, owner: dict[str, np.ndarray], asked: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        # pieces in the order of documents and positions, buckets together
        length = asked["count"].astype(np.int64) + window - 1
        begin = np.cumsum(length) - length
        order = np.lexsort((asked["start"], owner["text"], owner["id"], asked["bucket"]))
        at = 0
        while at < len(order):
            to = at + 1
            size = length[order[at]]
            while to < len(order) and (size < _SORT_BYTES or asked["bucket"][order[to]] == asked["bucket"][order[to - 1]]):
                size += length[order[to]]
                to += 1
            yield from _sorted(body, order[at:to], begin, length, asked, window, keep_first)
            at = to

    return run


def _sorted(body, who, begin, length, asked, window, keep_first):
    """Windows of the pieces ``who`` that repeat.  Windows without an equal hash
    cannot; the suffixes of the others are sorted."""
    text = body[ranges(begin[who], length[who])]
    first = np.cumsum(length[who]) - length[who]
    count = asked["count"][who].astype(np.int64)
    starts = ranges(first, count)
    piece = np.repeat(np.arange(len(who)), count)
    hashes = Spans(BYTE_CODE[text]).hash(starts, starts + window)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    likely = np.zeros(len(starts), bool)
    likely[order[1:]] |= same
    likely[order[:-1]] |= same
    if not likely.any():
        return
    # stretches of likely windows, with the bytes they cover, sorted as one text
    chosen = np.flatnonzero(likely)
    new = np.ones(len(chosen), bool)
    new[1:] = (chosen[1:] != chosen[:-1] + 1) | (piece[chosen[1:]] != piece[chosen[:-1]])
    head = np.flatnonzero(new)
    many = np.diff(np.concatenate((head, [len(chosen)])))
    small = text[ranges(starts[chosen[head]], many + window - 1)]
    at = ranges(np.cumsum(many + window - 1) - (many + window - 1), many)
    earlier, later = previous_factors(small, window, at)
    chosen = chosen[earlier if keep_first else earlier | later]
    if len(chosen):
        new = np.ones(len(chosen), bool)
        new[1:] = (chosen[1:] != chosen[:-1] + 1) | (piece[chosen[1:]] != piece[chosen[:-1]])
        head = np.flatnonzero(new)
        many = np.diff(np.concatenate((head, [len(chosen)])))
        own = piece[chosen[head]]
        yield who[own], starts[chosen[head]] - first[own], many


def _bytes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, offsets


def _kept(data: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    parts, at = [], 0
    for a, b in zip(starts.tolist(), ends.tolist()):
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def suffix_dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 200, keep_first: bool = True, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document;
    ``with_text``: the kept text too (bytes cut within a character are dropped)."""
    def apply(text: str, starts: np.ndarray, ends: np.ndarray) -> tuple:
        data = text.encode()
        kept = _kept(data, starts, ends)
        row = (len(data), len(data) - len(kept), len(starts), hashlib.sha256(kept).hexdigest())
        return (*row, kept.decode(errors="ignore")) if with_text else row

    plan = Plan(window, max(1, window * 8 // 25), _bytes, inside=True)
    result = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept string" * with_text
    return repeated_spans(df, plan, _compare(window, keep_first), keep_first, apply, result, id_col=id_col, text_col=text_col)
