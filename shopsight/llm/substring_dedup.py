"""Substring dedup by repeated-phrase automata.

Windows of ``window`` words that can be equal meet by ``_repeats``.  Windows that
recur in different documents are confirmed and become phrases; Aho-Corasick
automata over words (pyahocorasick), each of a bounded number of phrases, are
compiled for every shard, and the shard's pieces of all documents stream through
them to locate every occurrence.  A phrase carries the smallest document that
holds it, so an occurrence in a larger one is a repeat.

A word is written as a few symbols of a small alphabet, since the automata search
a node's edges one after another.

Defined results: null text has no words; ids are integers; null ids come after
all others; rows that share an id do not repeat each other; an empty table gives
no rows; extra columns are kept by ``dedup_passages`` and ignored otherwise.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsight.llm._repeats import Plan, repeated_spans
from shopsight.llm._text import Spans, ranges, word_codes, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Phrases of one automaton.
PHRASES = 20_000
_ALPHABET = 128


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = words(data, offsets)
    return word_codes(data, starts, ends), first


def _symbols(word: np.ndarray, digits: int) -> np.ndarray:
    """Each word number as ``digits`` symbols; every place has its own range, so
    a match cannot begin within a word."""
    out = np.empty((len(word), digits), np.int64)
    for d in range(digits):
        out[:, d] = word // _ALPHABET**d % _ALPHABET + d * _ALPHABET
    return out


def locate(stream: np.ndarray, phrases: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each phrase (rows of ``window`` word numbers) occurs in a stream of
    word numbers (-1 between pieces): first words and phrase numbers."""
    import ahocorasick
    digits = 1
    while _ALPHABET**digits <= max(int(stream.max(initial=0)), int(phrases.max(initial=0))):
        digits += 1
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for k, row in enumerate(_symbols(phrases.ravel(), digits).reshape(len(phrases), window * digits).tolist()):
        automaton.add_word(tuple(row), k)
    automaton.make_automaton()
    text = _symbols(stream, digits)
    text[stream < 0] = digits * _ALPHABET
    hits = list(automaton.iter(tuple(text.ravel().tolist())))
    if not hits:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end, phrase = np.array(hits, np.int64).T
    return end // digits - window + 1, phrase


def _compare(window: int):
    def run(body: np.ndarray, owner: dict[str, np.ndarray], asked: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        length = asked["count"].astype(np.int64) + window - 1
        begin = np.cumsum(length) - length
        count = asked["count"].astype(np.int64)
        starts = ranges(begin, count)
        piece = np.repeat(np.arange(len(count)), count)
        hashes = Spans(body).hash(starts, starts + window)
        ids = owner["id"][piece]
        order = np.lexsort((ids, hashes))
        new = np.ones(len(order), bool)
        new[1:] = hashes[order[1:]] != hashes[order[:-1]]
        head = np.flatnonzero(new)
        last = np.concatenate((head[1:], [len(order)])) - 1
        recurs = ids[order[head]] < ids[order[last]]
        head, last = head[recurs], last[recurs]
        if not len(head):
            return
        vocabulary, number = np.unique(body, return_inverse=True)
        # phrases of one bucket stand together, and their pieces too
        shown = order[head]
        by_bucket = np.argsort(asked["bucket"][piece[shown]], kind="stable")
        shown = shown[by_bucket]
        holder = np.argsort(asked["bucket"], kind="stable")
        bucket_of_piece = asked["bucket"][holder]
        for at in range(0, len(shown), PHRASES):
            some = shown[at:at + PHRASES]
            low, high = asked["bucket"][piece[some[0]]], asked["bucket"][piece[some[-1]]]
            who = holder[np.searchsorted(bucket_of_piece, low):np.searchsorted(bucket_of_piece, high, "right")]
            sizes = length[who] + 1
            stream = np.full(int(sizes.sum()), -1, np.int64)
            first = np.cumsum(sizes) - sizes
            stream[ranges(first, length[who])] = number[ranges(begin[who], length[who])]
            phrases = number[starts[some][:, None] + np.arange(window)]
            where, phrase = locate(stream, phrases, window)
            at_piece = np.searchsorted(first, where, "right") - 1
            record = who[at_piece]
            repeat = owner["id"][record] > ids[some][phrase]
            if repeat.any():
                yield record[repeat], (where - first[at_piece])[repeat], np.ones(int(repeat.sum()), np.int64)

    return run


def _plan(window: int) -> Plan:
    return Plan(window, max(1, window // 3), _codes, inside=False)


def _split(text: str, starts: np.ndarray, ends: np.ndarray) -> tuple[list[str], int]:
    found = WORD.findall(text)
    kept, at = [], 0
    for a, b in zip(starts.tolist(), ends.tolist()):
        kept += found[at:a]
        at = b
    return kept + found[at:], len(found)


def substring_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document."""
    def apply(text: str, starts: np.ndarray, ends: np.ndarray) -> tuple:
        kept, n = _split(text, starts, ends)
        return n, n - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()

    return repeated_spans(df, _plan(window), _compare(window), True, apply, "n_words bigint, n_removed bigint, kept_sha256 string", id_col=id_col, text_col=text_col)


def dedup_passages(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """The table with repeated passages taken out of the text; a text without any
    stays as it is, one that loses all its words goes."""
    def apply(text: str, starts: np.ndarray, ends: np.ndarray) -> tuple:
        if not len(starts):
            return False, text
        kept = " ".join(_split(text, starts, ends)[0])
        return not kept, kept

    others = [c for c in df.columns if c != text_col]
    carry = F.struct(*(df[c].alias(f"c{k}") for k, c in enumerate(others)), df[text_col].isNull().alias("null"))
    cut = repeated_spans(df, _plan(window), _compare(window), True, apply, "gone boolean, kept string", id_col=id_col, text_col=text_col, carry=carry)
    kept = F.when(F.col("carry.null"), F.lit(None)).otherwise(F.col("kept"))
    return cut.where("not gone").select(*(kept.alias(c) if c == text_col else F.col(f"carry.c{others.index(c)}").alias(c) for c in df.columns))
