"""Packing: cutting-stock column generation over a histogram of piece lengths.

Every document's token ids (with an end id) are cut into full sequences and one
rest.  The exact histogram of lengths, of ``capacity`` rows at most, goes to the
driver.  Pieces of one length are bundled, so many at a time that a sequence of
them alone holds most, and bundles are rounded up to ``grain`` tokens: sixteen
pieces of any length are a whole number of grains, so short texts lose nothing to
the rounding.  Then a linear program over patterns (how many
pieces of each length share a sequence) is solved by column generation: duals
price the lengths, a knapsack by dynamic programming finds the best new pattern,
until the bound on the optimum is met.  Whole numbers of each pattern are kept
and the few pieces left over go first-fit by falling length.  Spark then ranks
the documents of each length and deals them to the patterns' places.

Defined results: null text is empty and packs its end id alone; repeated rows
and null ids are packed like any others; pieces of one length are ranked by a
hash and then by id, ties in any order; a very long text is encoded whole and has
as many pieces as it needs; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopsight.functions.sized import BROADCAST_MAX_BYTES
from shopsight.llm._store import written
from shopsight.llm._text import document_columns, text_slices
from shopsight.llm.token_counts import pieces, tokenizer_path

_GAP = re.compile(r"\s | \s|^ | $")


@functools.lru_cache(maxsize=2)
def encoder(name: str, keep: int) -> Encoder:
    return Encoder(name, keep)


class Encoder:
    """Token ids of texts, as little-endian 32-bit numbers, for a byte-level BPE
    file of the tokenizers library.  Its vocabulary is read into tiktoken, which
    merges faster; pieces between safe cuts are encoded once and kept, up to
    ``keep`` of them.  Texts that hold a special string go to the library."""

    def __init__(self, name: str, keep: int):
        import json
        import os

        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        path = tokenizer_path(name)
        self._library, self._keep, self._seen, self._first = Tokenizer.from_file(path), keep, {}, {}
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        specials = {x["content"] for x in file["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, specials))) if specials else None
        # The byte-level alphabet writes printable bytes as themselves and the others from U+0100 on.
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in file["model"]["vocab"].items() if token not in specials}
        import public_tokenizers
        self._fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def _ids(self, text: str) -> bytes:
        return np.array(self._fast(text), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self._special and self._special.search(text):
            return np.array(self._library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _GAP.search(text):
            return b"".join(map(self._ids, pieces(text, "lead")))
        first, *rest = text.split(" ")
        seen = self._seen
        try:
            return self._ids(first) + b"".join(map(seen.__getitem__, rest))
        except KeyError:
            if len(seen) > self._keep:
                seen.clear()
            for p in set(rest).difference(seen):
                seen[p] = self._ids(" " + p)
            return self._ids(first) + b"".join(map(seen.__getitem__, rest))


def cut_documents(df: DataFrame, tokenizer: str, end_id: int, capacity: int, *, id_col: str = "doc_id", text_col: str = "text",
                  keep: int = 400_000) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of each piece: full
    sequences from a document's start, and the rest."""
    docs = document_columns(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, keep).encode
        for part in text_slices(batches):
            row, start, length, crc, total = [], [], [], [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                ids = memoryview(encode(text) + end)
                for at in range(0, len(ids), 4 * capacity):
                    one = ids[at:at + 4 * capacity]
                    row.append(i)
                    start.append(at // 4)
                    length.append(len(one) // 4)
                    crc.append(zlib.crc32(one))
                    total.append(len(ids) // 4)
            columns = [part.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.mapInArrow(run, f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def _knapsack(sizes: np.ndarray, prices: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: how many of each size fit into ``room``."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        fits = int(np.searchsorted(sizes, c, "right"))
        best[c] = best[c - 1]
        if fits:
            value = best[c - sizes[:fits]] + prices[:fits]
            k = int(value.argmax())
            if value[k] > best[c] + 1e-12:
                best[c], pick[c] = value[k], k
    pattern, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            pattern[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return float(best[room]), pattern


def solve_patterns(sizes: list[int], counts: list[int], room: int, gap: float = 1e-3, rounds: int = 5_000) -> list[tuple[dict[int, int], int]]:
    """Patterns (size -> pieces) and how often each is used, so that every piece
    is placed.  The linear program stops within ``gap`` of its optimum; the
    rounding adds at most one sequence for each size."""
    order = np.argsort(sizes)
    sizes_, demand = np.asarray(sizes)[order], np.asarray(counts, float)[order]
    m = len(sizes_)
    patterns = np.diag(room // sizes_).astype(np.int64)
    inverse = np.diag(1.0 / np.diag(patterns)) if m else np.zeros((0, 0))
    used = inverse @ demand
    for _ in range(rounds):
        prices = inverse.sum(axis=0)
        value, column = _knapsack(sizes_, np.maximum(prices, 0), room)
        # Farley's bound: the optimum is at least the present value over the best pattern's price.
        if value <= 1 + gap:
            break
        step = inverse @ column
        rising = step > 1e-9
        if not rising.any():
            break
        ratio = np.full(m, np.inf)
        ratio[rising] = used[rising] / step[rising]
        out = int(ratio.argmin())
        amount = ratio[out]
        used = np.maximum(used - amount * step, 0)
        used[out] = amount
        row = inverse[out] / step[out]
        inverse -= np.outer(step, row)
        inverse[out] = row
        patterns[:, out] = column
    found: list[tuple[dict[int, int], int]] = []
    left = demand.astype(np.int64)
    for k in np.argsort(-used):
        have = patterns[:, k] > 0
        times = int(min(np.floor(used[k] + 1e-6), (left[have] // patterns[have, k]).min())) if have.any() else 0
        if times > 0:
            left -= times * patterns[:, k]
            found.append(({int(sizes_[i]): int(patterns[i, k]) for i in np.flatnonzero(have)}, times))
    while left.any():  # first fit by falling length, whole runs of equal patterns at once
        space, pattern = room, {}
        for i in np.flatnonzero(left)[::-1]:
            if n := int(min(left[i], space // sizes_[i])):
                pattern[int(i)] = n
                space -= n * int(sizes_[i])
        times = min(int(left[i]) // n for i, n in pattern.items())
        for i, n in pattern.items():
            left[i] -= times * n
        found.append(({int(sizes_[i]): n for i, n in pattern.items()}, times))
    return found


def bundle(length: int, capacity: int, grain: int) -> int:
    """How many pieces of a length go together: as many as let one sequence of
    them alone hold most, the fewest of those."""
    def held(k: int) -> int:
        return k * (capacity // grain // -(-k * length // grain))

    return max(range(1, min(grain, capacity // length) + 1), key=lambda k: (held(k), -k))


def pack(parts: DataFrame, capacity: int, *, grain: int = 16, order: tuple[str, ...] = ("doc_id", "start"), sub_rows: int = 500_000) -> DataFrame:
    """``parts`` (with a ``length`` up to ``capacity``) plus sequence_id and
    offset.  Reads ``parts`` several times: give it a written table.  Ranks come
    from counts of (length, sub-bucket); a length has a sub-bucket for each
    ``sub_rows`` of its pieces, so no length is ranked in one task.  ``capacity``
    is a multiple of ``grain``."""
    if capacity % grain:
        raise ValueError("capacity is a multiple of grain")
    spark = parts.sparkSession
    per_length = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    demand: dict[int, int] = {}  # bundles and single pieces of each class
    lengths = []
    for length, n in sorted(per_length.items()):
        k = bundle(length, capacity, grain)
        row = [length, max(1, -(-n // sub_rows)), k, n // k * k]
        for size, many in ((-(-k * length // grain), n // k), (-(-length // grain), n % k)):
            row += [size, demand.get(size, 0)]
            demand[size] = demand.get(size, 0) + many
        lengths.append(tuple(row))
    demand = {c: n for c, n in demand.items() if n}
    found = solve_patterns(list(demand), list(demand.values()), capacity // grain)
    rows, base, taken = [], 0, dict.fromkeys(demand, 0)
    for pattern, times in found:
        for c, n in pattern.items():
            rows.append((c, taken[c], taken[c] + n * times, n, base))
            taken[c] += n * times
        base += times
    # Both tables are of a size fixed by capacity and grain.
    known = spark.createDataFrame(lengths, "length long, _subs int, _k long, _bundled long, _bundle_class int, _bundle_base long, _single_class int, _single_base long")
    places = spark.createDataFrame(rows, "_class int, _from long, _to long, _each long, _base long")
    dealt = parts.join(F.broadcast(known), "length")
    dealt = dealt.withColumn("_sub", F.expr(f"pmod(xxhash64({', '.join(order)}, length), _subs)").cast("int"))
    counts = dealt.groupBy("length", "_sub").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("length", "_sub").orderBy(*order)
    rank = (F.col("_start") + F.row_number().over(within) - 1).alias("_rank")
    if 64 * sum(r[1] for r in lengths) <= BROADCAST_MAX_BYTES:  # its rows at most
        starts = F.broadcast(starts)
    ranked = dealt.join(starts, ["length", "_sub"]).select(*parts.columns, *known.columns[2:], rank)
    bundled = F.col("_rank") < F.col("_bundled")
    items = ranked.select(*parts.columns, F.when(bundled, F.col("_bundle_class")).otherwise(F.col("_single_class")).alias("_class"),
                          F.when(bundled, F.expr("_bundle_base + _rank div _k")).otherwise(F.expr("_single_base + _rank - _bundled")).alias("_item"))
    packed = (items.alias("r").join(F.broadcast(places).alias("p"), F.expr("r._class = p._class AND r._item >= p._from AND r._item < p._to"))
              .select(*(F.col(f"r.{c}") for c in parts.columns), F.expr("p._base + (r._item - p._from) div p._each").alias("sequence_id")))
    ahead = Window.partitionBy("sequence_id").orderBy(F.desc("length"), *order).rowsBetween(Window.unboundedPreceding, -1)
    return packed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)))


def pack_documents(df: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, *, id_col: str = "doc_id", text_col: str = "text", grain: int = 16) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece."""
    return pack(written(cut_documents(df, tokenizer, end_id, capacity, id_col=id_col, text_col=text_col)), capacity, grain=grain)
