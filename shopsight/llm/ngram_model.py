"""Language-model scoring: interpolated modified Kneser-Ney over word n-grams.

Words are runs of bytes other than white space, A-Z in lower case; a text ends
with an end token and starts after a begin token that is never predicted.

Counting runs in Spark.  Words are counted first and numbered by falling count
within a range of their hashes.  Then n-grams of word numbers are counted, from
the highest order down, within bounded slices of texts, dealt by the hash of the
whole n-gram (so no frequent word, pair or context makes a hot task) as sorted,
compressed blocks, and summed.  A task that holds a range of hashes writes it as
a sorted array, and hands down blocks of what the next lower order needs, summed
beforehand: the contexts' totals and how many distinct words stand left of each
shorter n-gram.  N-grams behind the begin token keep their counts, as nothing
stands left of them.  Discounts follow from the counts of counts of each order.

The arrays are files in the folder that ``spark.checkpoint.dir`` names, one for
each order and hash range; workers map them into memory and look hashes up from
where their bits point, so a worker holds the pages it touches only.  Of an n-gram's hash
the range, the bucket and 40 further bits are kept.  That folder has to be a
path that driver and executors can open (a mounted file system).  A repeated task
writes the same files anew and swaps them in whole.

Defined results: null and empty texts are the end token alone; null ids count as
the remainder 0 (held out); without training texts every token has the share of
one unknown word; unknown words get the share that the lowest order leaves;
repeated rows count as often as they are there; where counts of counts do not
give discounts, 0.5, 1 and 1.5 are taken; an empty table gives no rows; extra
columns are ignored; a very long text is counted and scored whole, within one task.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopsight.llm._store import shared_dir
from shopsight.llm._text import buffer, document_columns, id_crc, lower, mix, ranges, text_slices, word_codes, words

BEGIN, END = np.uint64(0xB5297A4D3F84D5B5), np.uint64(0x68E31DA4C2B2AE35)
#: Bytes of text whose words are counted together before the shuffle; of n-grams a
#: part, as they have more columns.
COUNT_BYTES = 48 << 20
#: Training tokens of a range of n-gram hashes, where there are partitions enough.
RANGE_TOKENS = 1 << 21
#: Files that a worker has mapped at a time.
MAPPED = 512


def longer(hashes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The hashes of sequences with one more word code behind."""
    return mix(hashes * np.uint64(0x9E3779B97F4A7C15) + codes.view(np.uint64) + np.uint64(1))


def fold(*codes: np.ndarray) -> np.ndarray:
    """One 64-bit hash for a sequence of word codes (columns)."""
    out = np.zeros(len(codes[0]), np.uint64)
    for c in codes:
        out = longer(out, c)
    return out


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text as BEGIN, its words, END, and where it begins."""
    data = lower(data)
    starts, ends, first = words(data, offsets)
    counts = np.diff(first)
    begin = np.concatenate(([0], np.cumsum(counts + 2)))
    out = np.empty(begin[-1], np.uint64)
    out[ranges(begin[:-1] + 1, counts)] = word_codes(data, starts, ends)
    out[begin[:-1]], out[begin[1:] - 1] = BEGIN, END
    return out, begin


def windows(codes: np.ndarray, begin: np.ndarray, order: int) -> list[np.ndarray]:
    """For every predicted token the ``order`` codes that end there; 0 where the
    text has not begun."""
    place = np.arange(len(codes)) - np.repeat(begin[:-1], np.diff(begin))
    to = np.flatnonzero(place > 0)
    return [np.where(place[to] >= back, codes[np.maximum(to - back, 0)], np.uint64(0)) for back in range(order - 1, -1, -1)]


def _packed(keys: list[np.ndarray], width: int) -> list[np.ndarray]:
    """Columns of ``width`` bits at most, as many in one number as there is room for;
    the numbers sort as the rows do."""
    each, by = max(1, 64 // width), []
    for at in range(0, len(keys), each):
        one = keys[at]
        for c in keys[at + 1:at + each]:
            one = one << np.uint64(width) | c
        by.append(one)
    return by


def _unpacked(by: list[np.ndarray], many: int, width: int) -> list[np.ndarray]:
    """The ``many`` columns that ``_packed`` packed."""
    each, keys, mask = max(1, 64 // width), [], np.uint64((1 << width) - 1)
    for at, one in zip(range(0, many, each), by):
        keys += [one >> np.uint64(width * k) & mask for k in range(min(each, many - at) - 1, -1, -1)]
    return keys


def _runs(by: list[np.ndarray]) -> np.ndarray:
    """Where each distinct row begins among sorted rows."""
    new = np.zeros(len(by[0]), bool)
    new[:1] = True
    for one in by:
        new[1:] |= one[1:] != one[:-1]
    return np.flatnonzero(new)


def _order(by: list[np.ndarray], many: int, width: int) -> np.ndarray:
    """What sorts the rows of ``many`` columns that ``_packed`` packed.  Two numbers
    are sorted by their first 64 bits, then the rows that are alike in these by the
    others, which costs far less than sorting by one number after the other."""
    if len(by) == 1:
        return np.argsort(by[0])
    each = max(1, 64 // width)
    rest = (many - each) * width - (64 - each * width)  # bits of the second number beyond the first 64
    if len(by) > 2 or rest + len(by[0]).bit_length() > 64:
        return np.lexsort(by[::-1])
    first = by[0] << np.uint64(64 - each * width) | by[1] >> np.uint64(rest)
    order = np.argsort(first)
    first = first[order]
    new = np.concatenate((np.ones(1, bool), first[1:] != first[:-1]))[:len(first)]
    del first
    alike = np.flatnonzero(~new | ~np.append(new[1:], True))
    group = np.cumsum(new[alike], dtype=np.uint64)
    rows = order[alike]
    order[alike] = rows[np.argsort(group << np.uint64(rest) | by[1][rows] & np.uint64((1 << rest) - 1))]
    return order


def _counted(by: list[np.ndarray], many: int, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows, sorted, and how often each is there.  Sorts in place."""
    if len(by) == 1:
        by[0].sort()
    else:
        order = _order(by, many, width)
        by = [one[order] for one in by]
    begin = _runs(by)
    return [one[begin] for one in by], np.diff(np.append(begin, len(by[0])))


def _summed(keys: list[np.ndarray], values: list[np.ndarray], width: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Distinct rows of the keys, sorted, with the sums of the values."""
    by = _packed(keys, width)
    order = _order(by, len(keys), width)
    by = [one[order] for one in by]
    begin = _runs(by)
    by = [one[begin] for one in by]
    sums = [np.add.reduceat(v[order], begin, dtype=np.int64) if len(begin) else np.zeros(0, np.int64) for v in values]
    return _unpacked(by, len(keys), width), sums


def squeeze(keys: list[np.ndarray], values: list[np.ndarray]) -> bytes:
    """Sorted rows as one compressed block: a key becomes its distance to the row
    before where all keys left of it are the same; then bytes of one weight stand
    together, and those that are zero throughout are left out."""
    n, masks, planes = len(keys[0]), [], []

    def put(column: np.ndarray) -> None:
        column = np.ascontiguousarray(column, "<u8")
        raw = column.view(np.uint8).reshape(n, 8)
        bits = int(np.bitwise_or.reduce(column))
        used = [k for k in range(8) if bits >> 8 * k & 255]
        masks.append(sum(1 << k for k in used))
        planes.extend(raw[:, k].tobytes() for k in used)

    same = np.arange(n) > 0
    for c in keys:
        before = np.concatenate((np.zeros(1, np.uint64), c[:-1]))[:n]
        put(np.where(same, c - before, c))
        same &= c == before
    for v in values:
        put(v)
    raw = struct.pack("<q", n) + bytes(masks) + b"".join(planes)
    return struct.pack("<q", len(raw)) + pa.compress(raw, codec="zstd", asbytes=True)


def expand(block: bytes, keys: int, values: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The rows that ``squeeze`` packed; values in the narrowest type that holds them."""
    raw = pa.decompress(block[8:], struct.unpack_from("<q", block)[0], codec="zstd", asbytes=True)
    (n,), at, out = struct.unpack_from("<q", raw), 8 + keys + values, []
    for c, mask in enumerate(raw[8:at]):
        size = 8 if c < keys else next(k for k in (1, 2, 4, 8) if mask >> k == 0)
        column = np.zeros((n, size), np.uint8)
        for k in range(size):
            if mask >> k & 1:
                column[:, k] = np.frombuffer(raw, np.uint8, n, at)
                at += n
        out.append(column.view(f"<u{size}").ravel())
    same = np.arange(n) > 0
    for k, step in enumerate(out[:keys]):
        total = np.cumsum(step, dtype=np.uint64)
        head = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
        out[k] = total - (total - step)[head]
        same &= step == 0
    return out[:keys], out[keys:]


_BLOCK = "part int, level tinyint, block binary"


def _rows(parts: list[int], level: int, blocks: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([level] * len(parts), pa.int8()), pa.array(blocks, pa.binary())], names=["part", "level", "block"])


def _blocks(keys: list[np.ndarray], values: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """Sorted rows as one block for each range of their hash.  Takes the columns
    out of the lists, so that memory holds each once."""
    part = (fold(*keys) >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.int64)
    order = np.argsort(part, kind="stable")
    part = part[order]
    for columns in (keys, values):
        for k, c in enumerate(columns):
            columns[k] = c[order]
    del c, order
    begin = _runs([part]).tolist()
    return _rows(part[begin].tolist(), len(keys), [squeeze([k[a:b] for k in keys], [v[a:b] for v in values]) for a, b in zip(begin, [*begin[1:], len(part)])])


def _flushed(batches: Iterator[pa.RecordBatch], grams: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], width: int, bits: int) -> Iterator[pa.RecordBatch]:
    """Counts of what ``grams`` makes of texts, summed over ``COUNT_BYTES`` of them
    divided by the columns that it makes."""
    held, size, many = [], 0, 0

    def flush() -> pa.RecordBatch:
        by = [np.concatenate(c) for c in zip(*held)]
        held.clear()
        by, n = _counted(by, many, width)
        keys = _unpacked(by, many, width)
        del by
        return _blocks(keys, [n], bits)

    for part in text_slices(batches):
        data, offsets = buffer(part.column("text"))
        keys = grams(*tokens(data, offsets))
        many = len(keys)
        held.append(_packed(keys, width))
        size += len(data)
        if size * many >= COUNT_BYTES:
            yield flush()
            size = 0
    if held:
        yield flush()


#: Rows of a bucket of an array, on average.
_BUCKET = 16
#: Columns of n-gram blocks and arrays: how often it counts; as a context, the sum
#: of what follows it and how many words follow with a count of 1, 2 and more.  The
#: highest order has the first alone, as its n-grams are no contexts.
_VALUES = 5


def _numbered(values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row of values, equal ones alike, and a row for each number."""
    once, code = _distinct(values[0] if len(values) == 1 else fold(*values))
    seen = np.zeros(len(once), np.int64)
    seen[code] = np.arange(len(code))
    return code, seen


def _save(folder: str, name: str, part: int, bits: int, key: np.ndarray, values: list[np.ndarray], rank: np.ndarray | None = None) -> None:
    """One array of sorted hashes in one file.  The file's range and the bucket
    stand for the first bits of a hash; of the rest, 40 bits are kept, the first 32
    of them together (all of a word's, which ``rank`` marks).  The rows of values are numbered by how common
    they are: one byte each, and a list for the numbers from 255 on."""
    order = np.argsort(key)
    key = key[order] << np.uint64(bits)
    deep = max(0, (len(key) // _BUCKET).bit_length())
    bucket = key >> np.uint64(64 - deep) if deep else np.zeros(len(key), np.uint64)
    key = key << np.uint64(deep)
    code, seen = _numbered(values)
    many = np.bincount(code, minlength=len(seen))
    common = np.argsort(-many, kind="stable")
    place = np.empty(len(common), np.int64)
    place[common] = np.arange(len(common))
    code = place[code][order]
    rare = np.flatnonzero(code >= 255)
    sections = [np.array([deep, len(values)], np.int64), np.searchsorted(bucket, np.arange((1 << deep) + 1, dtype=np.uint64)).astype(np.uint32), (key >> np.uint64(32)).astype(np.uint32),
                (key >> np.uint64(24)).astype(np.uint8) if rank is None else key.astype(np.uint32), np.minimum(code, 255).astype(np.uint8), rare.astype(np.uint32), code[rare].astype(np.uint32),
                np.stack([v[seen][common] for v in values]), np.zeros(0, np.uint32) if rank is None else rank[order].astype(np.uint32)]
    path = Path(folder, f"{name}-{part}.npy")
    made = path.with_name(f".{uuid.uuid4().hex}.npy")
    sizes = np.array([len(key), *(s.nbytes for s in sections)], np.int64)
    np.save(made, np.concatenate([np.frombuffer(b.tobytes() + bytes(-b.nbytes % 8), np.uint8) for b in [sizes, *sections]]))
    os.replace(made, path)


class _Array:
    """An array file, mapped into memory."""

    def __init__(self, path: str, words: bool):
        raw = np.load(path, mmap_mode="r").view(np.ndarray)  # raises where it cannot be opened; views of plain arrays cost less
        kinds = [np.int64, np.uint32, np.uint32, np.uint32 if words else np.uint8, np.uint8, np.uint32, np.uint32, np.int64, np.uint32]
        self.rows, *sizes = raw[:8 * (1 + len(kinds))].view(np.int64).tolist()
        at, found = 8 * (1 + len(kinds)), []
        for kind, size in zip(kinds, sizes):
            found.append(raw[at:at + size].view(kind))
            at += size + -size % 8
        head, self._at, self._high, self._low, self._code, self._rare, self._rare_code, table, self._rank = found
        (self._deep, many), self._words = head.tolist(), words
        self.table = np.ascontiguousarray(table.reshape(many, -1).T)  # the rows of values by number
        self.terms: np.ndarray | None = None  # what a model makes of them

    def find(self, keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, and their rows.  A key's first 32 bits beyond the
        bucket's tell about where it stands in its bucket; from there all keys go
        up or down, row by row, until these bits are not passed."""
        keys = keys << np.uint64(bits)
        bucket = (keys >> np.uint64(64 - self._deep)).astype(np.int64) if self._deep else np.zeros(len(keys), np.int64)
        keys = keys << np.uint64(self._deep)
        high, low = (keys >> np.uint64(32)).astype(np.uint32), keys.astype(np.uint32) if self._words else (keys >> np.uint64(24)).astype(np.uint8)
        a, b = self._at[bucket].astype(np.int64), self._at[bucket + 1].astype(np.int64)
        at = a + ((b - a) * high >> 32)
        some = a < b
        if not some.all():
            at[~some] = 0
        here = self._high[at]
        for step, far, ahead, open_ in ((1, b, np.less, np.flatnonzero((here < high) & some)), (-1, a - 1, np.greater, np.flatnonzero((here > high) & some))):
            now, want, last = at[open_], high[open_], far[open_]
            while open_.size:
                now += step
                inside = np.flatnonzero(now != last)
                open_, now, want, last = open_[inside], now[inside], want[inside], last[inside]
                there = self._high[now]
                at[open_], here[open_] = now, there
                more = np.flatnonzero(ahead(there, want))
                open_, now, want, last = open_[more], now[more], want[more], last[more]
        alike = some & (here == high)
        ok = alike & (self._low[at] == low)
        for k in np.flatnonzero(alike & ~ok).tolist():  # rows that differ in the last bits alone stand side by side
            same = np.flatnonzero((self._high[a[k]:b[k]] == high[k]) & (self._low[a[k]:b[k]] == low[k]))
            if len(same):
                ok[k], at[k] = True, a[k] + same[0]
        return ok, at[ok]

    def codes(self, at: np.ndarray) -> np.ndarray:
        """The numbers of the rows of values at some rows."""
        code = self._code[at].astype(np.int64)
        rare = np.flatnonzero(code == 255)
        code[rare] = self._rare_code[np.searchsorted(self._rare, at[rare])]
        return code

    def values(self, at: np.ndarray) -> np.ndarray:
        """The values at some rows, a row for each."""
        return self.table.take(self.codes(at), axis=0)

    def rank(self, at: np.ndarray) -> np.ndarray:
        return self._rank[at].astype(np.uint64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int, bytes]]]]:
    """The levels and blocks of each hash range of a task, whose rows come in
    order of ``part``."""
    now, held = None, []
    for batch in batches:
        for part, level, block in zip(*(batch.column(c).to_pylist() for c in ("part", "level", "block"))):
            if held and part != now:
                yield now, held
                held = []
            now = part
            held.append((level, block))
    if held:
        yield now, held


def _merged(blocks: list[bytes], keys: int, values: int, width: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    found = [[] for _ in range(keys + values)]
    for b in blocks:
        for column, some in zip(found, sum(expand(b, keys, values), [])):
            column.append(some)
    blocks.clear()
    for k, column in enumerate(found):  # one after another, so that the parts go
        found[k] = np.concatenate(column)
        column.clear()
    return _summed(found[:keys], found[keys:], width)


def _dealt(blocks: DataFrame, tasks: int) -> DataFrame:
    return blocks.repartition(tasks, "part").sortWithinPartitions("part")


def _vocabulary(docs: DataFrame, folder: str, tasks: int, bits: int) -> list[tuple[int, int, int]]:
    """Writes the arrays of words, their numbers by falling count within a hash
    range, and their counts.  Gives the hash ranges with their words and tokens."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _flushed(batches, lambda codes, begin: [codes[codes != BEGIN]], 64, bits)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, blocks in _parts(batches):
            (word,), (n,) = _merged([b for _, b in blocks], 1, 1, 64)
            rank = np.empty(len(n), np.int64)
            rank[np.argsort(-n, kind="stable")] = np.arange(1, len(n) + 1)
            _save(folder, "token", part, bits, fold(word), [n], rank)
            yield _rows([part], 0, [np.array([len(n), n.sum()], np.int64).tobytes()])

    stats = _dealt(docs.mapInArrow(count, _BLOCK), tasks).mapInArrow(save, _BLOCK)
    return [(r["part"], *np.frombuffer(r["block"], np.int64).tolist()) for r in stats.collect()]  # one row a hash range


def _level(blocks: DataFrame, order: int, columns: int, folder: str, tasks: int, bits: int, width: int) -> DataFrame:
    """Writes the arrays of one order, with ``columns`` of values.  Gives the blocks of the next lower one, and
    of each hash range (level 0) the order, rows, sum of counts, and how many have
    counts of 1 to 4 and of 3 or more; such rows of higher orders go through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, found in _parts(batches):
            if done := [b for level, b in found if level == 0]:
                yield _rows([part] * len(done), 0, done)
            mine = [b for level, b in found if level == order]
            found.clear()
            if not mine:
                continue
            keys, values = _merged(mine, order, columns, width)
            begun = keys[0] != 0  # or its history is shorter than the order
            n = values[0]
            some = n > 0
            if order > 1:
                full = some & begun
                c = n[full]
                lower_, context = [k[some] for k in keys[1:]], [k[full] for k in keys[:-1]]
                none = np.zeros(len(lower_[0]), np.uint8)
                follow = [np.concatenate((none, x)) for x in (c, *(x.astype(np.uint8) for x in (c == 1, c == 2, c > 2)))]
                handed = [np.concatenate((np.where(begun, 1, n)[some], np.zeros(len(c), np.int64))), *follow]
                yield _blocks(*_summed([np.concatenate(k) for k in zip(lower_, context)], handed, width), bits)
                del lower_, context, follow, handed
            keys, values = [k[begun] for k in keys], [v[begun] for v in values]
            n = values[0]
            _save(folder, f"ngram{order}", part, bits, fold(*keys), values)
            few = np.bincount(np.minimum(n, 5), minlength=6)
            yield _rows([part], 0, [np.array([order, part, len(n), n.sum(), *few[1:5], few[3:].sum()], np.int64).tobytes()])

    return _dealt(blocks, tasks).mapInArrow(run, _BLOCK)


def discounts(counts: dict[int, int]) -> tuple[float, float, float]:
    """What is taken off counts of 1, 2 and more, from the counts of counts."""
    n1, n2, n3, n4 = (counts.get(k, 0) for k in (1, 2, 3, 4))
    if min(n1, n2, n3, n4) > 0:
        y = n1 / (n1 + 2 * n2)
        found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        if all(0 <= d <= k for k, d in enumerate(found, 1)):
            return found
    return 0.5, 1.0, 1.5


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each key once, and where each key stands among them."""
    found = pa.array(keys).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


@dataclass
class Arrays:
    """Arrays in a folder, one file for each hash range."""

    folder: str
    word_bits: int  # of a word's hash, for its range
    bits: int  # of an n-gram's
    sizes: dict[str, dict[int, int]]  # rows of each range's array that was written
    _maps: dict[tuple[str, int], _Array | None] = field(default_factory=dict, repr=False, kw_only=True)

    def __getstate__(self):
        return {**self.__dict__, "_maps": {}}

    def _mapped(self, name: str, part: int) -> _Array | None:
        at = name, part
        if at not in self._maps:
            while len(self._maps) >= MAPPED:
                del self._maps[next(iter(self._maps))]
            size = self.sizes[name].get(part, 0)
            found = _Array(f"{self.folder}/{name}-{part}.npy", name == "token") if size else None
            if found is not None and found.rows != size:
                raise ValueError(f"{name}-{part}.npy holds {found.rows} rows instead of {size}")
            self._maps[at] = found
        return self._maps[at]

    def _found(self, name: str, keys: np.ndarray, bits: int) -> Iterator[tuple[int, _Array, np.ndarray, np.ndarray]]:
        """For each hash range: the array, which keys it has, and where.  Keys are taken
        by their first 16 bits, so that neighbours meet in memory."""
        order = np.argsort((keys >> np.uint64(48)).astype(np.uint16) if bits <= 16 else keys, kind="stable")
        keys = keys[order]
        part = (keys >> np.uint64(64 - bits)).astype(np.int64)
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(keys)])) if len(keys) else np.zeros(1, np.int64)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            have = self._mapped(name, int(part[a]))
            if have is not None:
                ok, at = have.find(keys[a:b], bits)
                yield int(part[a]), have, order[a:b][ok], at

    def look_up(self, name: str, keys: np.ndarray) -> np.ndarray:
        """The values at each key, a row for each (0 where there is none)."""
        out = np.zeros((len(keys), _VALUES), np.int64)
        for _, have, who, at in self._found(name, keys, self.bits):
            out[who, :have.table.shape[1]] = have.values(at)
        return out

    def numbers(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each word's number (1: the begin token, 2: unknown; the least for common
        words) and how often it is in the training texts."""
        once, back = _distinct(codes)
        number, count = self._once(once)
        return number[back], count[back]

    def _once(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        number, count = np.full(len(codes), 2, np.uint64), np.zeros(len(codes), np.int64)
        for part, have, who, at in self._found("token", fold(codes), self.word_bits):
            number[who] = have.rank(at) << np.uint64(self.word_bits) | np.uint64(part)
            count[who] = have.values(at)[:, 0]
        number[codes == BEGIN] = 1
        return number, count


@dataclass
class Model(Arrays):
    """The arrays, and the few numbers that are not in them."""

    order: int
    discount: dict[int, tuple[float, float, float]]
    total: int  # training tokens
    vocabulary: int
    left: int  # sum of the lowest order's counts
    open: float  # probability that the lowest order leaves

    def taken(self, order: int, counts: np.ndarray) -> np.ndarray:
        return np.array([0.0, *self.discount[order]])[np.minimum(counts, 3)]

    def _made(self, order: int, table: np.ndarray) -> np.ndarray:
        seen = table[:, 0]
        mine = [seen - self.taken(order, seen)]
        if order < self.order:
            total, *follow = table[:, 1:].T
            some = np.maximum(total, 1)
            mine += [some, np.where(total > 0, sum(d * c for d, c in zip(self.discount[order + 1], follow)) / some, 1.0)]
        return np.stack(mine, axis=1)

    def terms(self, order: int, keys: np.ndarray) -> np.ndarray:
        """Of the n-gram at each key: its count less the discount; below the highest
        order also, as a context, the sum of what follows and the share that is
        left for lower orders (0, 1 and 1 where there is none)."""
        out = np.empty((len(keys), 3 if order < self.order else 1))
        out[:, :1], out[:, 1:] = 0, 1
        for _, have, who, at in self._found(f"ngram{order}", keys, self.bits):
            if have.terms is None:
                have.terms = self._made(order, have.table)
            out[who] = have.terms.take(have.codes(at), axis=0)
        return out

    def log10(self, codes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each predicted token: its probability's logarithm and how often it
        is in the training texts."""
        once, back = _distinct(codes)
        number, count = self._once(once)
        key = fold(number)
        mine = self.terms(1, key)  # the begin token is a context too
        to = np.delete(np.arange(len(codes)), begin[:-1])
        p = mine[:, 0].take(back[to]) / max(self.left, 1) + self.open * (1 / (self.vocabulary + 1))
        context = mine[:, 1:].take(back[to - 1], axis=0)
        key, number = key.take(back), number.take(back)
        for n in range(2, self.order + 1):
            key[1:] = longer(key[:-1], number[1:])  # of the n-gram that ends at a token; those that reach before the text are in no array
            mine = self.terms(n, key[to])
            p = mine[:, 0] / context[:, 0] + context[:, 1] * p
            if n < self.order:  # of the next order: the n-gram that ends a token earlier
                found = np.ones((len(codes), 2))
                found[to] = mine[:, 1:]
                context = found.take(to - 1, axis=0)
        return np.log10(p), count.take(back[to])


def _local(spark: SparkSession) -> str:
    place = urlparse(shared_dir(spark))
    if place.scheme not in ("", "file"):
        raise ValueError("the model's arrays are mapped into memory: spark.checkpoint.dir must be a path that driver and executors can open")
    folder = f"{unquote(place.path)}/shopsight-llm/ngram-{uuid.uuid4().hex}"
    os.makedirs(folder, exist_ok=True)
    return folder


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", order: int = 3) -> Model:
    """A model of order 2 or 3 of all texts."""
    if order not in (2, 3):
        raise ValueError("order is 2 or 3")
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    word_bits = max(1, tasks - 1).bit_length() + 1
    folder = _local(spark)
    texts = document_columns(docs, id_col, text_col).select("text")
    ranges_ = _vocabulary(texts, folder, tasks, word_bits)
    total = sum(n for *_, n in ranges_)
    bits = max(1, min(word_bits, (total // RANGE_TOKENS).bit_length()))
    words_ = Arrays(folder, word_bits, bits, {"token": {part: n for part, n, _ in ranges_}})
    width = (max((n for _, n, _ in ranges_), default=0) + 1 << word_bits).bit_length()
    rows = texts.mapInArrow(lambda batches: _flushed(batches, lambda codes, begin: windows(words_.numbers(codes)[0], begin, order), width, bits), _BLOCK)
    for n in range(order, 0, -1):
        rows = _level(rows, n, 1 if n == order else _VALUES, folder, tasks, bits, width)
    sizes, sums = dict(words_.sizes), {n: np.zeros(6, np.int64) for n in range(1, order + 1)}
    for r in rows.collect():  # one row for each order and hash range
        n, part, many, *more = np.frombuffer(r["block"], np.int64).tolist()
        sizes.setdefault(f"ngram{n}", {})[part] = many
        sums[n] += np.array(more)
    for n in sums:
        sizes.setdefault(f"ngram{n}", {})
    discount = {n: discounts(dict(enumerate(s[1:5].tolist(), 1))) for n, s in sums.items()}
    left, *few, more = sums[1].tolist()
    d = discount[1]
    open_ = (d[0] * few[0] + d[1] * few[1] + d[2] * more) / left if left else 1.0
    return Model(folder, word_bits, bits, sizes, order, discount, total, sum(n for _, n, _ in ranges_), left, open_)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score (add-0.1 unigrams),
    score (log10 of the text's probability) and perplexity of every document."""
    texts = document_columns(docs, id_col, text_col)
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            codes, begin = tokens(*buffer(part.column("text")))
            logs, count = model.log10(codes, begin)
            first = (begin - np.arange(len(begin)))[:-1]  # without the begin tokens
            n = np.diff(begin) - 1
            base = np.log10((count + 0.1) / (model.total + 0.1 * (model.vocabulary + 1)))
            total = np.add.reduceat(logs, first)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(np.add.reduceat((count > 0).astype(np.int64), first)), pa.array(np.full(len(n), model.total)),
                                              pa.array(np.add.reduceat(base, first)), pa.array(total), pa.array(10 ** (-total / n))],
                                             names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    return texts.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, perplexity double")


def held_out(doc_id: Column, folds: int = 10) -> Column:
    return F.pmod(id_crc(doc_id), F.lit(folds)) == 0


def lm_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, order: int = 3) -> DataFrame:
    """Scores of every document by a model of those that are not held out."""
    model = train(docs.where(~held_out(docs[id_col], folds)), id_col=id_col, text_col=text_col, order=order)
    scored = score(docs, model, id_col=id_col, text_col=text_col)
    return scored.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
