"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints at ``distance`` or fewer differing bits meet in a variant that is
within half the distance of both.  For an odd distance 2h+1 the two numbers of
set bits differ in parity, so fingerprints with an odd number emit all variants
within h+1 flips and the others within h.

The shuffle on variants goes by their upper bits: a fingerprint is sent once to
every prefix that its variants have, with the flips that it has left, and the
task of a prefix makes the rest of the variants there, in blocks of bounded
size.  That moves some dozen numbers for each fingerprint and not thousands.

Equal fingerprints meet before, in one row.  All that share a variant are linked
to its nearest fingerprint only, not in pairs: whoever is within h flips of the
variant is within the distance of all others there.  Links are verified by their
bits and joined into components.

Defined results: null and empty texts, and texts without words, have fingerprint
zero and are linked like any other; repeated rows share a component; null ids
are never a component's name unless it has no other (null); extra columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopsight.llm._components import components
from shopsight.llm._store import written
from shopsight.llm._text import _SPACE, buffer, document_columns, free_name, lower, text_digest, text_slices, words

#: Variants that a task holds at a time.
BLOCK = 1 << 21


def simhash(data: np.ndarray, offsets: np.ndarray, shingle: int, seed: int) -> np.ndarray:
    """The fingerprint of each text in a buffer."""
    import xxhash
    data = lower(data)
    starts, ends, first = words(data, offsets)
    counts = np.diff(first)
    out = np.zeros(len(counts), np.uint64)
    if not len(starts):
        return out
    # the words with one blank after each
    lengths = ends - starts
    solid = ~_SPACE[data]
    tight = np.full(int(lengths.sum()) + len(lengths), 0x20, np.uint8)
    to = np.cumsum(lengths + 1) - (lengths + 1)
    place = np.ones(len(tight), bool)
    place[to + lengths] = False
    tight[place] = data[solid]
    # shingles of each text: its word windows, or all its words if fewer
    windows = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), windows)
    before = np.cumsum(windows) - windows
    head = np.arange(int(windows.sum())) - np.repeat(before, windows) + first[:-1][text]
    tail = head + np.minimum(shingle, counts[text]) - 1
    raw, digest = tight.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(raw[a:b], seed) for a, b in zip(to[head].tolist(), (to[tail] + lengths[tail]).tolist())), np.uint64, len(head))
    filled = np.flatnonzero(windows)
    sums = np.zeros((len(filled), 64), np.int64)
    cuts = before[filled]
    step = 1 << 18
    for at in range(0, len(hashes), step):  # bits of a bounded number of shingles
        bits = np.unpackbits(hashes[at:at + step].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        low, high = np.searchsorted(cuts, at, "right") - 1, np.searchsorted(cuts, at + len(bits))
        sums[low:high] += np.add.reduceat(bits, np.maximum(cuts[low:high] - at, 0), axis=0, dtype=np.int64)
    major = sums * 2 > windows[filled][:, None]
    out[filled] = np.packbits(major, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprint_documents(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, digest: bool = False) -> DataFrame:
    """doc_id and the fingerprint as a signed number, ``fp``; ``digest``: the
    text's digest too."""
    docs = document_columns(df, id_col, text_col)
    kind = docs.schema["doc_id"].dataType.simpleString()
    if digest:
        docs = docs.withColumn("digest", text_digest(docs["text"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            marks = simhash(*buffer(part.column("text")), shingle, seed)
            more = {"digest": part.column("digest")} if digest else {}
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "fp": pa.array(marks.view(np.int64)), **more})

    return docs.mapInArrow(run, f"doc_id {kind}, fp bigint" + ", digest binary" * digest)


def _masks(bits: int, flips: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for c in combinations(range(bits), flips)], np.uint64)


def _collide(fps: np.ndarray, low: np.ndarray, spent: np.ndarray, left: np.ndarray, bits: int, half: int, block: int) -> Iterator[np.ndarray]:
    """Links among fingerprints whose variants agree above ``bits``.  ``low``: the
    variants so far; ``spent``, ``left``: flips made and allowed."""
    if len(fps) < 2:
        return
    total = sum(int((left == n).sum()) * sum(comb(bits, k) for k in range(n + 1)) for n in range(int(left.max()) + 1))
    if total > block and bits > 4:
        rest = bits - 4
        parts = []
        for k in range(min(4, int(left.max())) + 1):
            may = left >= k
            for mask in _masks(4, k):
                parts.append((fps[may], low[may] ^ (mask << np.uint64(rest)), spent[may] + k, left[may] - k))
        fps, low, spent, left = (np.concatenate(x) for x in zip(*parts))
        key = (low >> np.uint64(rest)) & np.uint64(15)
        for value in range(16):
            own = key == value
            yield from _collide(fps[own], low[own], spent[own], left[own], rest, half, block)
        return
    values, owner, far = [], [], []
    for k in range(int(left.max()) + 1):
        who = np.flatnonzero(left >= k)
        masks = _masks(bits, k)
        values.append((low[who][:, None] ^ masks[None, :]).ravel())
        owner.append(np.repeat(who, len(masks)))
        far.append(np.repeat(spent[who] + k, len(masks)))
    value, owner_, far_ = (np.concatenate(x) for x in (values, owner, far))
    ordered = np.sort(value)
    shared = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(shared):
        return
    at = np.searchsorted(shared, value)
    keep = np.flatnonzero(shared[np.minimum(at, len(shared) - 1)] == value)
    at, owner_, far_ = at[keep], owner_[keep], far_[keep]
    order = np.lexsort((owner_, far_, at))
    at, owner_, far_ = at[order], owner_[order], far_[order]
    begin = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    size = np.diff(np.concatenate((begin, [len(at)])))
    centre = np.repeat(owner_[begin], size)
    near = np.repeat(far_[begin] <= half, size) & (owner_ != centre)
    if near.any():
        yield np.unique(np.stack([fps[centre[near]], fps[owner_[near]]], axis=1), axis=0)


def ball_links(marks: DataFrame, distance: int = 3, *, prefix_bits: int = 10, block: int = BLOCK) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``fp``, enough to connect all that
    are at ``distance`` or fewer bits."""
    half, odd = distance // 2, distance % 2
    low_bits = 64 - prefix_bits

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = [_masks(prefix_bits, k) for k in range(half + odd + 1)]
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 14):
                fps = batch.column("fp").slice(at, 1 << 14).to_numpy(zero_copy_only=False).view(np.uint64)
                radius = half + odd * (np.bitwise_count(fps) & 1).astype(np.int64)
                for k, some in enumerate(masks):
                    may = radius >= k
                    if not may.any():
                        continue
                    key = ((fps[may] >> np.uint64(low_bits))[:, None] ^ some[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(np.repeat(fps[may], len(some)).view(np.int64)),
                                                      pa.array(np.full(len(key), k, np.int8)), pa.array(np.repeat(radius[may] - k, len(some)).astype(np.int8))],
                                                     names=["prefix", "fp", "spent", "rest"])

    def meet(group: pa.Table) -> pa.Table:
        fps = group.column("fp").to_numpy().view(np.uint64)
        low = fps & np.uint64((1 << low_bits) - 1)
        found = [*_collide(fps, low, group.column("spent").to_numpy().astype(np.int64), group.column("rest").to_numpy().astype(np.int64), low_bits, half, block)]
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.uint64)
        pairs = pairs[np.bitwise_count(pairs[:, 0] ^ pairs[:, 1]) <= distance]
        return pa.table({"a": pairs[:, 0].copy().view(np.int64), "b": pairs[:, 1].copy().view(np.int64)})

    sent = marks.select("fp").mapInArrow(emit, "prefix int, fp bigint, spent tinyint, rest tinyint")
    return sent.groupBy("prefix").applyInArrow(meet, "a bigint, b bigint").distinct()


def _named(marked: DataFrame, distance: int, prefix_bits: int = 10) -> DataFrame:
    """The component of each fingerprint, named by a fingerprint, and the least id
    (``component_id``; null: none has one) of the component."""
    firsts = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    joined = components(ball_links(firsts, distance, prefix_bits=prefix_bits))
    named = firsts.join(joined, firsts["fp"] == joined["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    return named.join(least, "component").select("fp", "component", "component_id")


def simhash_groups(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3, seed: int = 42, prefix_bits: int = 10) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    marked = written(fingerprint_documents(df, id_col=id_col, text_col=text_col, shingle=shingle, seed=seed))
    labels = _named(marked, distance, prefix_bits).select("fp", "component_id")
    return marked.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3) -> DataFrame:
    """One row of each component: the one with the least id (null: last), then the
    least text.  Rows are told apart by id and text, never by the id alone."""
    marked = written(fingerprint_documents(df, id_col=id_col, text_col=text_col, shingle=shingle, digest=True))
    least = marked.join(_named(marked, distance), "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    least = written(least.groupBy("doc_id", "digest", "component").agg(F.count("*").alias("n")))
    rows = least.groupBy("component").agg(F.sum("n").alias("rows"))
    id_, digest, component = (free_name(df, c) for c in ("_id", "_digest", "_component"))
    kept = written(least.join(rows, "component").select(F.col("doc_id").alias(id_), F.col("digest").alias(digest), F.col("component").alias(component), "rows"))

    def among(some: DataFrame, how: str) -> DataFrame:
        return df.join(some.drop("rows"), F.col(id_).eqNullSafe(df[id_col]) & (F.col(digest) == text_digest(df[text_col])), how)

    once = among(kept.where("rows = 1"), "left_semi")
    again = among(kept.where("rows > 1"), "inner")
    again = again.groupBy(component).agg(F.min_by(F.struct(*(df[c] for c in df.columns)), F.coalesce(df[text_col], F.lit(""))).alias("_row"))
    return once.unionByName(again.select("_row.*"))
