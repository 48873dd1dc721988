"""Benchmark decontamination with a BM25 index of test items and block-max WAND.

An item has a question and an answer (``split_items`` cuts one text in two: the
last sentence is the answer; of a single sentence, the last third of its words).
Words are runs of letters and digits, in lower case.  The impact of a term on
an item is its BM25 weight over the sum of the item's weights, so that a passage
with all words of an item scores 1 and one threshold serves items of all lengths.

Every text is cut into cells of as many words as the longest item has; a passage
is two neighbouring cells, so every occurrence of an item lies in one passage.
Each passage is a query for all items above the threshold: first the largest
impacts of its terms must reach the threshold (the pivot test of WAND), then the
largest impacts of its terms on a block of items (block-max); items of the blocks
that are left get their full score.  A cell's bounds serve both its passages.
Whoever is above the threshold is verified: runs of ``gram`` equal words must
cover enough of the question and of the answer.

The index is dealt into shards of about ``shard_bytes`` of item text, by length
and hash; the statistics behind the weights cover all items.  A shard is
broadcast and all texts stream past it, so memory does not grow with the items.

Defined results: null and empty texts hold no item; items without words are not
indexed; an item without question or answer is verified by the other alone; items
with one id are found one by one, and the best counts; repeated rows give one
pair; null ids are pairs like others; an empty table gives no rows; extra columns
are kept by ``decontaminate`` and ignored otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopsight.llm._store import written
from shopsight.llm._text import Spans, buffer, document_columns, free_name, ranges, text_digest, text_slices, word_codes, words

#: Bytes between words: all ASCII characters but letters and digits.
_SPACE = np.array([b < 0x80 and not chr(b).isalnum() for b in range(256)])
#: Items of a block.
BLOCK = 16
#: Bounds that a task holds at a time.
CELLS = 1 << 20
#: Bytes of text that a task searches at a time: each byte takes some 60 bytes of arrays.
SEARCH_BYTES = 1 << 20
_K1, _B = 1.2, 0.75


def _codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = words(data, offsets, _SPACE)
    return word_codes(data, starts, ends), first


def _of(texts: list[str]) -> list[np.ndarray]:
    raw = [t.encode() for t in texts]
    codes, first = _codes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    return [codes[a:b] for a, b in zip(first[:-1], first[1:])]


@dataclass
class Index:
    """A shard of the inverted index.  ``head`` delimits each term's postings
    (``item``, ``impact``), ``block_head`` its blocks (``block``, ``block_max``)."""

    ids: list
    parts: list[tuple[np.ndarray, np.ndarray]]
    stride: int
    terms: np.ndarray
    top: np.ndarray
    head: np.ndarray
    item: np.ndarray
    impact: np.ndarray
    block_head: np.ndarray
    block: np.ndarray
    block_max: np.ndarray

    @property
    def blocks(self) -> int:
        return -(-len(self.ids) // BLOCK)


def build(ids: list, questions: list[str], answers: list[str], frequency: dict[int, int], items: int, mean: float) -> Index:
    """The shard of some items, with the statistics of all of them."""
    parts = list(zip(_of(questions), _of(answers)))
    both = [np.concatenate(p) for p in parts]
    length = np.array([len(x) for x in both])
    owner = np.repeat(np.arange(len(both)), length)
    terms, number = np.unique(np.concatenate(both), return_inverse=True)
    key, tf = np.unique(number * len(both) + owner, return_counts=True)
    term, item = key // len(both), key % len(both)
    df = np.array([frequency[int(t)] for t in terms.view(np.int64)], float)
    weight = np.log1p((items - df + 0.5) / (df + 0.5))[term] * tf * (_K1 + 1) / (tf + _K1 * (1 - _B + _B * length[item] / mean))
    impact = weight / np.bincount(item, weight, len(both))[item]
    head = np.searchsorted(term, np.arange(len(terms) + 1))
    new = np.ones(len(key), bool)
    new[1:] = (term[1:] != term[:-1]) | (item[1:] // BLOCK != item[:-1] // BLOCK)
    begin = np.flatnonzero(new)
    return Index(ids, parts, int(length.max()), terms, np.maximum.reduceat(impact, head[:-1]), head, item, impact,
                 np.searchsorted(term[begin], np.arange(len(terms) + 1)), item[begin] // BLOCK, np.maximum.reduceat(impact, begin))


def retrieve(index: Index, codes: np.ndarray, first: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All (passage, item) at or above the threshold: the passage's text, first and
    past-the-end word, the item and the score."""
    low = threshold - 1e-9
    counts = np.diff(first)
    per = -(-counts // index.stride)
    text = np.repeat(np.arange(len(counts)), per)  # of each cell
    nth = ranges(np.zeros(len(counts), np.int64), per)
    begin = first[:-1][text] + nth * index.stride
    joined = np.zeros(len(text), bool)  # with the next cell
    joined[:-1] = text[1:] == text[:-1]
    passage = joined | (nth == 0)  # a last cell is part of the passage before
    none = np.zeros(0, np.int64)
    term = np.minimum(np.searchsorted(index.terms, codes), len(index.terms) - 1)
    known = np.flatnonzero(index.terms[term] == codes)
    if not len(known):
        return none, none, none, none, none.astype(float)
    key = np.unique((np.searchsorted(begin, known, "right") - 1) * len(index.terms) + term[known])
    cell, term = key // len(index.terms), key % len(index.terms)
    bound = np.bincount(cell, index.top[term], len(text) + 1)
    live = np.flatnonzero(passage & (bound[:-1] + np.where(joined, bound[1:], 0) >= low))
    at_cell = np.searchsorted(cell, np.arange(len(text) + 1))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, CELLS // index.blocks)
    for some in np.split(live, np.searchsorted(live, np.arange(step, len(text), step))):
        if not len(some):
            continue
        # bounds of the cells of these passages on every block
        wanted = np.unique(np.concatenate((some, some[joined[some]] + 1)))
        size = at_cell[wanted + 1] - at_cell[wanted]
        of = term[ranges(at_cell[wanted], size)]
        many = index.block_head[of + 1] - index.block_head[of]
        to = ranges(index.block_head[of], many)
        where = np.repeat(np.repeat(np.arange(len(wanted)), size), many)
        table = np.bincount(where * index.blocks + index.block[to], index.block_max[to], (len(wanted) + 1) * index.blocks).reshape(-1, index.blocks)
        a = np.searchsorted(wanted, some)
        both = table[a] + np.where(joined[some][:, None], table[np.minimum(a + 1, len(wanted))], 0)
        p, block = np.nonzero(both >= low)
        if not len(p):
            continue
        # the distinct terms of the passages that have a block left, with their items there
        mine = np.unique(p)
        c = some[mine]
        size = at_cell[np.where(joined[c], c + 2, c + 1)] - at_cell[c]
        pair = np.unique(np.repeat(np.arange(len(mine)), size) * len(index.terms) + term[ranges(at_cell[c], size)])
        row, of = pair // len(index.terms), pair % len(index.terms)
        many = index.head[of + 1] - index.head[of]
        to = ranges(index.head[of], many)
        row = np.repeat(row, many)
        wish = np.searchsorted(mine, p) * index.blocks + block
        have = row * index.blocks + index.item[to] // BLOCK
        slot = np.minimum(np.searchsorted(wish, have), len(wish) - 1)
        ok = wish[slot] == have
        slot, to = slot[ok], to[ok]
        score = np.bincount(slot * BLOCK + index.item[to] % BLOCK, index.impact[to], len(wish) * BLOCK)
        hit = np.flatnonzero(score >= low)
        found.append((some[p[hit // BLOCK]], block[hit // BLOCK] * BLOCK + hit % BLOCK, score[hit]))
    if not found:
        return none, none, none, none, none.astype(float)
    at, item, score = (np.concatenate(x) for x in zip(*found))
    return text[at], begin[at], np.minimum(begin[at] + np.where(joined[at], 2, 1) * index.stride, first[1:][text[at]]), item, score


def overlap(part: np.ndarray, passage: np.ndarray, gram: int) -> float:
    """The share of a part's words that lie in runs of ``gram`` words which the
    passage has too (a shorter part: the whole of it)."""
    if not len(part):
        return 1.0
    size = min(gram, len(part))
    same = np.flatnonzero(np.isin(Spans(part).grams(size), Spans(passage).grams(size)))
    covered = np.zeros(len(part), bool)
    covered[(same[:, None] + np.arange(size)).ravel()] = True
    return float(covered.mean())


def split_items(items: DataFrame, text_col: str = "text") -> tuple[Column, Column]:
    """Question and answer of items that are one text."""
    text = F.trim(F.coalesce(items[text_col], F.lit("")))
    last = F.regexp_extract(text, r"(?s)^(.*[.?!]\s+)(\S.*)$", 2)
    tokens = F.split(text, r"\s+")
    cut = F.ceil(F.size(tokens) * 2 / 3).cast("int")
    one = last == ""
    return (F.when(one, F.array_join(F.slice(tokens, F.lit(1), cut), " ")).otherwise(F.regexp_extract(text, r"(?s)^(.*[.?!]\s+)(\S.*)$", 1)),
            F.when(one, F.array_join(F.slice(tokens, cut + 1, F.size(tokens)), " ")).otherwise(last))


def _measured(items: DataFrame, id_col: str, question: Column, answer: Column) -> DataFrame:
    """Distinct items with their number of words and distinct terms."""
    some = items.select(items[id_col].alias("item_id"), F.lower(F.coalesce(question, F.lit(""))).alias("question"), F.lower(F.coalesce(answer, F.lit(""))).alias("answer")).distinct()
    kind = some.schema["item_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, a = (_of(batch.column(c).to_pylist()) for c in ("question", "answer"))
            all_ = [np.concatenate(x) for x in zip(q, a)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(x) for x in all_], pa.int64()),
                                              pa.array([np.unique(x).view(np.int64) for x in all_], pa.list_(pa.int64()))], names=[*batch.schema.names, "n", "terms"])

    return some.mapInArrow(run, f"item_id {kind}, question string, answer string, n bigint, terms array<bigint>").where("n > 0")


def contaminated(docs: DataFrame, items: DataFrame, question: Column, answer: Column, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                 threshold: float = 0.6, covered: float = 0.6, gram: int = 5, shard_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, item_id, score, question_overlap and answer_overlap of every
    document that holds an item (its best passage)."""
    kept = written(_measured(items, item_col, question, answer))
    # longer items by powers of four, so that short ones keep short passages
    kept = kept.withColumn("long", F.greatest(F.lit(0), F.ceil(F.log(4.0, F.col("n") / 64))).cast("int"))
    total = kept.agg(F.count("*").alias("items"), F.avg("n").alias("mean")).first()
    sizes = kept.groupBy("long").agg(F.sum(F.octet_length("question") + F.octet_length("answer")).alias("bytes")).orderBy("long").collect()
    frequency = written(kept.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")))
    texts = document_columns(docs, id_col, text_col).withColumn("text", F.lower("text"))
    kinds = texts.schema["doc_id"].dataType.simpleString(), kept.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, score double, question_overlap double, answer_overlap double"
    out = docs.sparkSession.createDataFrame([], schema)

    def search(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index: Index = shared.value
            item_ids = pa.array(index.ids, type=None if any(i is not None for i in index.ids) else pa.int64())
            for part in text_slices(batches, limit=SEARCH_BYTES):
                codes, first = _codes(*buffer(part.column("text")))
                best: dict[tuple[int, int], tuple[float, float, float]] = {}
                for text, a, b, item, score in zip(*(x.tolist() for x in retrieve(index, codes, first, threshold))):
                    q, r = (overlap(x, codes[a:b], gram) for x in index.parts[item])
                    if min(q, r) >= covered:
                        best[text, item] = max(best.get((text, item), (0.0, 0.0, 0.0)), (score, q, r))
                if best:
                    text, item = (pa.array(x, pa.int64()) for x in zip(*best))
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(text), item_ids.take(item), *(pa.array(x, pa.float64()) for x in zip(*best.values()))],
                                                     names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])

        return texts.mapInArrow(run, schema)

    for size in sizes:
        n = int(size["bytes"] // shard_bytes) + 1
        for k in range(n):
            some = kept.where((F.col("long") == size["long"]) & (F.pmod(F.xxhash64("question", "answer"), F.lit(n)) == k))
            rows = some.select("item_id", "question", "answer").orderBy("item_id", "question", "answer").collect()
            if not rows:
                continue
            mine = some.select(F.explode("terms").alias("term")).distinct().join(frequency, "term").collect()
            index = build([r["item_id"] for r in rows], [r["question"] for r in rows], [r["answer"] for r in rows], {r["term"]: r["df"] for r in mine}, total["items"], total["mean"])
            out = out.union(search(docs.sparkSession.sparkContext.broadcast(index)))
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("best")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.*")


def decontaminate(docs: DataFrame, items: DataFrame, question: Column, answer: Column, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, each row by itself: texts are
    searched under their digest, which also finds the rows."""
    texts = docs.select(text_digest(docs[text_col]).alias("doc_id"), docs[text_col].alias("text"))
    name = free_name(docs, "_found")
    found = written(contaminated(texts, items, question, answer, **options).select(F.col("doc_id").alias(name)).distinct())
    return docs.join(found, F.col(name) == text_digest(docs[text_col]), "left_anti")
