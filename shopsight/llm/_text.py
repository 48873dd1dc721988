"""Shared helpers: Arrow text batches as numpy buffers, word boundaries, hashes
of spans and sliding minima.  Everything here works on one bounded slice of
texts inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task.
SLICE_BYTES = 4 << 20

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: For words of letters: ASCII letters, and any byte of other characters.
NO_LETTER = np.array([b < 0x80 and not chr(b).isalpha() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20

_RNG = np.random.default_rng(20240229)
#: A random 64-bit number for each byte value (the seed fixes it).
BYTE_CODE = _RNG.integers(1, 2**63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def document_columns(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) of a table, whatever else it holds."""
    return df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer where the table has such a column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def text_digest(text: Column) -> Column:
    """The SHA-256 of a text (null: empty).  What an operator finds out about a
    text holds for every row with this digest, whatever its id."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def id_crc(doc_id: Column) -> Column:
    """crc32 of the id written as text; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def shards_of(df: DataFrame, per_partition: int = 4) -> int:
    """Work units of a block shuffle: some for each shuffle partition, so that
    they grow with the session's setting."""
    return per_partition * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most ``limit`` bytes of text; a longer text
    is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        offsets = buffer(batch.column(column))[1]
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            end = min(end, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and its offsets."""
    wide = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    n = len(column)
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, dtype=wide, count=n + 1, offset=column.offset * np.dtype(wide).itemsize).astype(np.int64)
    if at[-1] == at[0] or data is None:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, dtype=np.uint8, count=int(at[-1] - at[0]), offset=int(at[0])), at - at[0]


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and past-the-end byte of each word, and each text's first word
    (one entry more than texts).  ``space`` marks the bytes between words."""
    solid = ~space[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    cuts = offsets[:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = solid[cuts]
    before = cuts[cuts > 0] - 1
    last[before] = solid[before]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((_BASE, _INVERSE)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[k] = np.cumprod(row, dtype=np.uint64)
    return _powers[0], _powers[1]


class Spans:
    """Hashes of any spans of a sequence of 64-bit codes, by prefix sums of a
    polynomial modulo 2**64.  Long spans can be built to collide, so these group
    candidates; ``sequence_digests`` or the content tells what is equal."""

    def __init__(self, codes: np.ndarray):
        up, self._down = _power(len(codes) + 1)
        self._sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(codes * up[: len(codes)], out=self._sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        value = (self._sums[ends] - self._sums[starts]) * self._down[starts]
        return mix(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def grams(self, size: int) -> np.ndarray:
        """The hash of the span of ``size`` codes at each position that has one."""
        n = len(self._sums) - size
        if n <= 0:
            return np.zeros(0, np.uint64)
        value = (self._sums[size:] - self._sums[:n]) * self._down[:n]
        return mix(value + np.uint64(size * 0xD6E8FEB86659FD93 % (1 << 64)))


#: Words beyond so many bytes are hashed one by one.
_LONG_WORD = 256


def word_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word's bytes: eight at a time, each scrambled with
    what came before; long words by XXH3."""
    size = ends - starts
    out = mix(size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    who, at = np.flatnonzero(size <= _LONG_WORD), 0
    while len(who):
        left = (size[who] - at).astype(np.uint64)
        keep = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.minimum(left, np.uint64(8)) * np.uint64(8))
        out[who] = mix(out[who] ^ (eight[starts[who] + at] & keep))
        who, at = who[left > 8], at + 8
    for k in np.flatnonzero(size > _LONG_WORD):
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k]:ends[k]].tobytes())
    return out


def sequence_digests(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The XXH3 of the codes of each span."""
    raw, size = memoryview(np.ascontiguousarray(codes)).cast("B"), codes.itemsize
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(raw[a:b]) for a, b in zip((starts * size).tolist(), (ends * size).tolist())), np.uint64, len(starts))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    if len(values) < width:
        return values[:0]
    out, size = values, 1
    while size * 2 <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start .. start+length-1 of every pair, one after another."""
    lengths = lengths.astype(np.int64)
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts.astype(np.int64) - before, lengths)
