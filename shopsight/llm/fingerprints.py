"""Document fingerprints by content-defined chunking.

A gear hash rolls over a text's bytes; a chunk ends where the hash has a run of
zero bits.  The cut is normalised: up to the usual length more zero bits are
asked for, beyond it fewer, so lengths keep near the usual one.  Boundaries
depend on the bytes before them only, so an edit moves the chunks it touches and
the others keep their digests.  The fingerprint is the set of chunk digests with
their lengths; likeness is the share of a fingerprint's length whose digests the
other one holds (containment).

Neighbours in id order come from one range shuffle of the texts: ids are dealt
to ranges, and each range's first document is also sent to the range before it.

Defined results: null text is empty; an empty text's fingerprint is empty, like
another empty one (1.0) and unlike all else (0.0); null ids come last in
descending order; rows with the same id follow each other by text; one row alone
is its own next; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsight.llm._text import BYTE_CODE, Spans, document_columns

_GEAR = (BYTE_CODE >> np.uint64(17)).astype(np.uint32)
_WINDOW = 16


class Chunker:
    """Cuts bytes into chunks of ``least`` to ``most`` bytes, about ``usual``
    (a power of two)."""

    def __init__(self, least: int = 8, usual: int = 32, most: int = 128):
        self.least, self.usual, self.most = least, usual, most
        bits = usual.bit_length() - 1
        # the upper bits of the 16 lowest depend on the whole window
        self._strict, self._loose = (np.uint32(((1 << n) - 1) << (16 - n)) for n in (bits + 1, bits - 2))

    def cuts(self, data: np.ndarray) -> list[int]:
        """The past-the-end byte of each chunk."""
        n = len(data)
        rolled, reach = _GEAR[data], 1
        while reach < _WINDOW:
            more = rolled.copy()
            more[reach:] += rolled[:-reach] << np.uint32(reach)
            rolled, reach = more, reach * 2
        loose = np.flatnonzero((rolled & self._loose) == 0)
        strict = loose[(rolled[loose] & self._strict) == 0]
        loose, strict = (loose + 1).tolist(), (strict + 1).tolist()
        loose.append(n + self.most)
        strict.append(n + self.most)
        out, at, i, j = [], 0, 0, 0
        while n - at > self.least:
            while strict[i] < at + self.least:
                i += 1
            if strict[i] <= at + self.usual:
                at = strict[i]
            else:
                while loose[j] <= at + self.usual:
                    j += 1
                at = min(loose[j], at + self.most)
            if at >= n:
                break
            out.append(at)
        if n:
            out.append(n)
        return out

    def fingerprint(self, data: bytes) -> Fingerprint:
        codes = np.frombuffer(data, np.uint8)
        ends = np.array(self.cuts(codes), np.int64)
        starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
        digests = (Spans(BYTE_CODE[codes]).hash(starts, ends) >> np.uint64(32)).astype(np.uint32)
        digests, first = np.unique(digests, return_index=True)
        return Fingerprint(digests, (ends - starts)[first])


class Fingerprint:
    """Sorted chunk digests and the chunks' lengths."""

    def __init__(self, digests: np.ndarray, lengths: np.ndarray):
        self.digests, self.lengths = digests, lengths

    def text(self) -> str:
        both = np.zeros(len(self.digests), dtype=[("d", "<u4"), ("n", "u1")])
        both["d"], both["n"] = self.digests, self.lengths
        return base64.b64encode(both.tobytes()).decode()

    def held_by(self, other: Fingerprint) -> float:
        """The share of this fingerprint's length that the other one holds."""
        total = int(self.lengths.sum())
        if not total:
            return float(not len(other.digests))
        return float(self.lengths[np.isin(self.digests, other.digests, assume_unique=True)].sum()) / total


def _ranges(docs: DataFrame, parts: int) -> DataFrame:
    """Rows dealt to ranges of falling ids; a range's first id also goes to the
    range before it (the first range's to the last), marked _tail."""
    lowest = -(1 << 63)
    keyed = docs.withColumn("_key", F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)))
    bounds = sorted({int(x) for x in keyed.approxQuantile("_key", [k / parts for k in range(1, parts)], 0.2 / parts)}) if parts > 1 else []
    spot = F.size(F.filter(F.array(*(F.lit(b).cast("long") for b in bounds)), lambda b: b > F.col("_key"))) if bounds else F.lit(0)
    keyed = keyed.withColumn("_range", spot)
    # one row for each range
    heads = sorted((r["_range"], r["first"]) for r in keyed.groupBy("_range").agg(F.max("_key").alias("first")).collect())
    if not heads:
        return keyed.withColumn("_tail", F.lit(False))
    before = {first: heads[i - 1][0] for i, (_, first) in enumerate(heads)}
    target = F.element_at(F.create_map(*(x for k, v in before.items() for x in (F.lit(k).cast("long"), F.lit(v)))), F.col("_key"))
    own = F.struct(F.col("_range").alias("r"), F.lit(False).alias("t"))
    both = F.when(F.col("_key").isin(list(before)), F.array(own, F.struct(target.alias("r"), F.lit(True).alias("t")))).otherwise(F.array(own))
    return keyed.withColumn("_to", F.explode(both)).select("doc_id", "text", "_key", F.col("_to.r").alias("_range"), F.col("_to.t").alias("_tail"))


def fingerprints(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chunker: Chunker | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next of every document; see the module's text.  The
    edited text has its last third replaced by the start of the next document."""
    chunker = chunker or Chunker()
    docs = document_columns(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = (_ranges(docs, parts).repartition(parts, "_range")
             .sortWithinPartitions("_range", "_tail", F.desc("_key"), "text").select("doc_id", "text", "_range", "_tail"))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = None  # the row whose next one has not come yet
        size = 0
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                for doc_id, text, spot, tail in zip(*(part.column(c).to_pylist() for c in ("doc_id", "text", "_range", "_tail"))):
                    if tail and held is None:
                        continue  # a further row with the id of the range's first
                    mark = chunker.fingerprint(text.encode())
                    if held is not None:
                        was_id, was_text, was_mark = held
                        n = len(was_text)
                        edited = (was_text[:n - n // 3] + text[:n // 3]).encode()
                        new = chunker.fingerprint(edited)
                        rows.append((was_id, n, hashlib.sha256(edited).hexdigest(), was_mark.text(), new.text(), was_mark.held_by(new), was_mark.held_by(mark)))
                        size += n
                    held = None if tail else (doc_id, text, mark)
                    if size > 4 << 20:
                        yield _batch(rows, names, [id_type, *types])
                        rows, size = [], 0
        if rows:
            yield _batch(rows, names, [id_type, *types])

    return dealt.mapInArrow(run, f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)
