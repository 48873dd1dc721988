"""Importance resampling towards a target distribution over hashed n-grams.

Each text is lower-cased (A-Z), its separators become single spaces, and overlapped
regular-expression scanning emits the spans of all runs of ``n`` consecutive words,
whose CRC-32 names a bucket.  A document's bucket counts are written to the shared
folder, so texts are scanned once.  Counts over all documents and over all target
texts give each bucket a gain (log ratio of the two distributions, each count plus
one); a document's weight is the mean gain of its features.  A Gumbel number from the
id's SHA-256 is added, and the documents with the highest sums are drawn, which is
sampling without replacement by the weights.

Counts are summed per task before they are shuffled; the gain table has ``buckets``
rows.  Ranks come from a range-split of (score, id) and prefix counts; equal rows are
counted before it, so that copies of one row do not meet in one task.

Defined results: a null or empty text has no features and weight 0; a null id counts as
empty text in the Gumbel number and comes last among ties; repeated rows each get a
row and a rank of their own; a very long text is scanned whole, in pieces that cut no
feature; an empty table gives no rows; without target texts all counts of the target
are 0; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopsight.functions.ranking import rows_before
from shopsight.llm._store import written
from shopsight.llm._text import SLICE_BYTES, buffer, document_columns, text_slices

#: Bytes as they are scanned: A-Z in lower case, and a space for each byte that is
#: neither an ASCII letter or digit nor part of another character.
_SCANNED = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
_GAP = regex.compile(rb" +")
_BLOCK = 1 << 20


def gram_pattern(n: int) -> regex.Pattern:
    """All runs of ``n`` words between boundaries, in text with single spaces."""
    return regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1))


def _pieces(text: bytes, words: int) -> Iterator[bytes]:
    """A long text in pieces; each begins with the last ``words`` words of the one
    before it, so that no run of one word more is cut or met twice."""
    at = 0
    while len(text) - at > SLICE_BYTES:
        end, back = text.find(b" ", at + SLICE_BYTES), 0
        while end >= 0:
            back = end + 1
            for _ in range(words):
                back = text.rfind(b" ", at, max(back - 1, at)) + 1
            if back > at:
                break
            end = text.find(b" ", end + 1)  # words longer than a piece
        if end < 0:
            break
        yield text[at:end]
        at = back
    yield text[at:]


def gram_buckets(raw: bytes, patterns: list[tuple[int, regex.Pattern]], buckets: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The words of a text, the buckets of its features, and how many features each has."""
    text = _GAP.sub(b" ", raw.translate(_SCANNED)).strip(b" ")
    whole, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for n, pattern in patterns:
        for piece in _pieces(text, n - 1):
            spans = map(zlib.crc32, map(operator.itemgetter(0), pattern.finditer(piece, overlapped=True)))
            while len(found := np.fromiter(islice(spans, _BLOCK), np.int64)):
                key, number = np.unique(found % buckets, return_counts=True)
                whole, counts = np.concatenate((whole, key)), np.concatenate((counts, number))
    if len(patterns) > 1 or len(text) > SLICE_BYTES:
        whole, back = np.unique(whole, return_inverse=True)
        counts = np.bincount(back, counts, len(whole)).astype(np.int64)
    return text.count(b" ") + 1 if text else 0, whole, counts


def scanned(df: DataFrame, id_col: str, text_col: str, ngrams: tuple[int, int], buckets: int) -> DataFrame:
    """doc_id, n_words, n_features, and buckets and counts of each document."""
    docs = document_columns(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = [(n, gram_pattern(n)) for n in range(ngrams[0], ngrams[1] + 1)]
        for part in text_slices(batches, "text"):
            data, offsets = buffer(part.column("text"))
            n_words, keys, numbers = zip(*(gram_buckets(data[a:b].tobytes(), patterns, buckets) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())))
            ends = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            total = np.array([int(c.sum()) for c in numbers], np.int64)
            key, number = np.concatenate(keys).astype(np.int32), np.concatenate(numbers)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(total),
                 pa.ListArray.from_arrays(ends, pa.array(key)), pa.ListArray.from_arrays(ends, pa.array(number))],
                names=["doc_id", "n_words", "n_features", "buckets", "counts"])

    return docs.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, buckets array<int>, counts array<bigint>")


def bucket_counts(found: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket over a table of ``scanned``: summed in each task, then
    over tasks; ``buckets`` numbers reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in batches:
            key, number = (part.column(c).flatten().to_numpy() for c in ("buckets", "counts"))
            np.add.at(total, key, number)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in found.select("buckets", "counts").mapInArrow(add, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of the two smoothed distributions)."""
    s, t, k = source.astype(float), target.astype(float), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + k) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def gumbel(doc_id: Column, seed: int) -> Column:
    """floor(-1000 ln(-ln u)), with u from the first 32 bits of the id's SHA-256."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weighted(found: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight: the floored mean gain of the features."""
    kind = found.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            key, number = (part.column(c).flatten().to_numpy() for c in ("buckets", "counts"))
            ends = np.concatenate(([0], np.cumsum(np.asarray(part.column("buckets").value_lengths()))))
            sums = np.concatenate(([0], np.cumsum(gains[key] * number)))
            n = part.column("n_features").to_numpy()
            weight = np.where(n > 0, (sums[ends[1:]] - sums[ends[:-1]]) // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "n_words", "n_features")), pa.array(weight)],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_features bigint, weight bigint")


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", ngrams: tuple[int, int] = (1, 2),
             buckets: int = 10_000, min_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score and rank (1, 2, ... for the drawn documents,
    else null) of every document.  Of the documents with ``min_words`` words or more,
    ``percent`` in a hundred are drawn."""
    found = written(scanned(docs, id_col, text_col, ngrams, buckets))
    aims = scanned(target.select(F.lit(0).alias("id"), target[target_text].alias("text")), "id", "text", ngrams, buckets)
    gains = bucket_gains(bucket_counts(found, buckets), bucket_counts(aims, buckets))
    scored = weighted(found, gains).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    same = ["doc_id", "n_words", "n_features", "weight", "score"]
    rows = written(scored.groupBy(*same).agg(F.count("*").alias("copies")))
    able = F.col("n_words") >= min_words
    drawn = (rows.where(able).agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0] * percent) // 100
    ranked = rows_before(rows.where(able), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight"), F.col("n_words")],
                         count_col="copies", name="before")
    ranked = ranked.unionByName(rows.where(~able).withColumn("before", F.lit(None).cast("long")))
    each = ranked.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("nth"))
    rank = F.col("before") + F.col("nth")
    return each.select("doc_id", "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))
