"""Finding equal windows of a corpus without moving every window.

Texts are sequences of codes (bytes or words).  A window's bucket is the hash of
its least gram, which equal windows share; neighbouring windows with one bucket
make a piece, so a piece stands for many windows and costs one record.  Pieces
are shuffled by bucket in packed blocks.  A bucket with one piece has no repeat.
Equal pieces are settled by their digests.  What is left are buckets with
different pieces: one piece of each digest is asked for by content, and an
operator of its own method compares their windows.

Pieces are equal if both their bucket and their digest (XXH3 of the codes, each
64 bits) are; content decides all else.
Documents (an id and a text) are dealt to ``places`` by the checksum of both;
records that belong to a document travel there in packed blocks.  A document
whose repeated rows outweigh a place is dealt to several, and its records are
copied to all of them."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shopsight.llm._store import written
from shopsight.llm._text import Spans, buffer, ranges, sequence_digests, shards_of, sliding_min, text_slices

_HIGH = np.uint64(0xFFFFFFFF00000000)
_LOW = np.uint64(0xFFFFFFFF)
#: Windows in a piece at most.
_LONGEST = 4096
#: Bytes of text whose pieces are packed together.
_PACK_BYTES = 32 << 20


@dataclass(frozen=True)
class Plan:
    """``window`` codes make a window, ``gram`` codes a gram; ``codes`` turns a
    text buffer into codes and each text's first code; ``inside``: repeats within
    one document count too."""

    window: int
    gram: int
    codes: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    inside: bool
    slice_bytes: int = 2 << 20


def cut_pieces(codes: np.ndarray, first: np.ndarray, plan: Plan) -> dict[str, np.ndarray]:
    """Pieces of every text: its row, start (in codes, within the text), count of
    windows, bucket, digest, and whether its least gram occurs twice in it."""
    window, gram = plan.window, plan.gram
    counts = np.maximum(np.diff(first) - window + 1, 0)
    at = ranges(first[:-1], counts)
    if not len(at):
        empty = np.zeros(0, np.int64)
        return dict(row=empty, start=empty, count=empty, bucket=empty.view(np.uint64), digest=empty.view(np.uint64), twice=empty.astype(bool))
    spans = Spans(codes)
    grams = spans.grams(gram)
    place = np.arange(len(grams), dtype=np.uint64)
    width = window - gram + 1
    left = (sliding_min((grams & _HIGH) | place, width)[at] & _LOW).astype(np.int64)
    bucket = grams[left]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (bucket[1:] != bucket[:-1])
    begin = np.flatnonzero(new)
    run = np.arange(len(at)) - np.repeat(begin, np.diff(np.concatenate((begin, [len(at)]))))
    begin = np.flatnonzero(run % _LONGEST == 0)
    count = np.diff(np.concatenate((begin, [len(at)])))
    start = at[begin]
    twice = np.zeros(len(begin), bool)
    if plan.inside:
        right = (_LOW - (sliding_min((grams & _HIGH) | (_LOW - place), width) & _LOW)).astype(np.int64)
        twice = left[begin] != right[at[begin + count - 1]]
    row = np.searchsorted(first, start, "right") - 1
    return dict(row=row, start=start - first[row], count=count, bucket=bucket[begin], digest=sequence_digests(codes, start, start + count + window - 1), twice=twice)


#: Packed columns of pieces and of spans, with their types.
PIECE = {"bucket": np.uint64, "digest": np.uint64, "start": np.uint32, "count": np.uint16, "twice": np.uint8}
SPAN = {"start": np.uint32, "length": np.uint32}
ASKED = {"bucket": np.uint64, "start": np.uint32, "count": np.uint16, "settled": np.uint8}
#: What names a document: id, checksum of its text, checksum of both.
OWNER = {"id": np.int64, "text": np.uint32, "crc": np.uint32}


def packed_schema(key: str, kinds: dict[str, type], *more: str) -> str:
    return ", ".join([f"{key} int", *more, *(f"{c} binary" for c in [*OWNER, "each", *kinds])])


def pack(key: str, keys: np.ndarray, owner: dict[str, np.ndarray], columns: dict[str, np.ndarray], kinds: dict[str, type],
         extra: Callable[[np.ndarray], bytes] | None = None) -> pa.RecordBatch | None:
    """One row of packed columns for each key.  Records of one document, next to
    each other, name it once (``each`` counts them)."""
    order = np.argsort(keys, kind="stable")
    if not len(order):
        return None
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(keys[order])) + 1, [len(order)]))
    rows: dict[str, list] = {c: [] for c in [key, *(["body"] if extra else []), *OWNER, "each", *kinds]}
    for a, b in zip(cuts[:-1], cuts[1:]):
        who = order[a:b]
        rows[key].append(int(keys[who[0]]))
        named = np.ones(len(who), bool)
        named[1:] = (owner["id"][who[1:]] != owner["id"][who[:-1]]) | (owner["text"][who[1:]] != owner["text"][who[:-1]])
        heads = np.flatnonzero(named)
        for c, t in OWNER.items():
            rows[c].append(owner[c][who[heads]].astype(t).tobytes())
        rows["each"].append(np.diff(np.concatenate((heads, [len(who)]))).astype(np.uint32).tobytes())
        for c, t in kinds.items():
            rows[c].append(columns[c][who].astype(t).tobytes())
        if extra:
            rows["body"].append(extra(who))
    types = [pa.int32(), *[pa.binary()] * (len(rows) - 1)]
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), types)], names=list(rows))


def unpack(table: pa.Table, kinds: dict[str, type]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The records of packed rows: their owners and their columns."""
    def joined(c: str, t: type) -> np.ndarray:
        return np.frombuffer(b"".join(table.column(c).to_pylist()), t)

    each = joined("each", np.uint32)
    return {c: np.repeat(joined(c, t), each) for c, t in OWNER.items()}, {c: joined(c, t) for c, t in kinds.items()}


@dataclass(frozen=True)
class Places:
    """``many`` places; ``hot``: (id, checksum of the text, places) of documents
    that have several, at most ``many`` such."""

    many: int
    hot: list[tuple[int, int, int]]

    def of(self, owner: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Record and place of every copy of records that go to their document."""
        base = owner["crc"].astype(np.int64)
        copies = np.ones(len(base), np.int64)
        if self.hot:
            marks = np.array([_mark(np.int64(i), np.int64(t)) for i, t, _ in self.hot], np.uint64)
            order = np.argsort(marks)
            mine = _mark(owner["id"], owner["text"].astype(np.int64))
            at = order[np.minimum(np.searchsorted(marks[order], mine), len(marks) - 1)]
            copies = np.where(marks[at] == mine, np.array([n for _, _, n in self.hot], np.int64)[at], 1)
        record = np.repeat(np.arange(len(base)), copies)
        return record, (base[record] + ranges(np.zeros(len(base), np.int64), copies)) % self.many


def _mark(ids: np.ndarray, text: np.ndarray) -> np.ndarray:
    """One number for id and text; a document that shares another's only gets
    copies that no row asks for."""
    with np.errstate(over="ignore"):
        return np.asarray(ids).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.asarray(text).astype(np.uint64)


def deal(docs: DataFrame, many: int) -> tuple[DataFrame, Places]:
    """``docs`` (id, text) with ``crc`` and ``place``.  Documents that have more
    than an even place's share of bytes in several rows get several places; a row
    goes to the one of its partition."""
    docs = docs.withColumn("check", F.crc32(F.col("text").cast("binary")))
    docs = docs.withColumn("crc", F.crc32(F.concat_ws(" ", "id", "check").cast("binary")))
    weight = F.sum(F.octet_length("text") + F.lit(64)).alias("weight")
    weights = written(docs.groupBy("id", "check").agg(F.count("*").alias("rows"), weight))
    share = (weights.agg(F.sum("weight")).first()[0] or 0) / many
    hot = weights.where((F.col("rows") > 1) & (F.col("weight") > share))
    hot = hot.select("id", "check", F.least(F.lit(many), F.col("rows"), F.ceil(F.col("weight") / F.lit(share or 1.0))).cast("int").alias("copies"))
    rows = [tuple(r) for r in hot.collect()]  # no more than there are places
    base = F.col("crc")
    if rows:
        known = docs.sparkSession.createDataFrame(rows, "id bigint, check bigint, copies int")
        docs = docs.join(F.broadcast(known), ["id", "check"], "left")
        base = base + F.pmod(F.spark_partition_id(), F.coalesce("copies", F.lit(1)))
    return docs.withColumn("place", F.pmod(base, F.lit(many)).cast("int")), Places(many, rows)


def piece_blocks(docs: DataFrame, plan: Plan, shards: int) -> DataFrame:
    """Pieces of ``docs`` (id, crc, text), packed by shard of their bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            all_ = {c: np.concatenate([h[c] for h in held]) for c in held[0]}
            held.clear()
            batch = pack("shard", (all_["bucket"] % np.uint64(shards)).astype(np.int64), all_, all_, PIECE)
            if batch is not None:
                yield batch

        for part in text_slices(batches, "text", plan.slice_bytes):
            data, offsets = buffer(part.column("text"))
            raw = data.tobytes()
            check = np.array([zlib.crc32(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:])], np.uint32)
            found = cut_pieces(*plan.codes(data, offsets), plan)
            row = found.pop("row")
            ids, crc = (part.column(c).to_numpy(zero_copy_only=False) for c in ("id", "crc"))
            held.append(found | {"id": ids[row], "crc": crc[row], "text": check[row]})
            size += len(data)
            if size > _PACK_BYTES:
                yield from flush()
                size = 0
        yield from flush()

    return docs.mapInArrow(run, packed_schema("shard", PIECE))


def settle(plan: Plan, keep_first: bool, places: Places) -> Callable[[pa.Table], pa.Table]:
    """For a shard's pieces: spans that equal pieces prove repeated, and the
    pieces whose content is needed.  ``keep_first``: only what also starts in a
    smaller document (``inside``: or earlier in the same one) is repeated;
    otherwise whatever starts anywhere else is."""
    def run(table: pa.Table) -> pa.Table:
        owner, p = unpack(table, PIECE)
        order = np.lexsort((p["start"], owner["text"], owner["id"], p["digest"], p["bucket"]))
        owner = {c: v[order] for c, v in owner.items()}
        p = {c: v[order] for c, v in p.items()}
        n = len(order)
        outer = np.ones(n, bool)
        outer[1:] = p["bucket"][1:] != p["bucket"][:-1]
        inner = outer.copy()
        inner[1:] |= p["digest"][1:] != p["digest"][:-1]
        group, kind = np.cumsum(outer) - 1, np.cumsum(inner) - 1
        copies = np.bincount(kind)[kind]
        first_of_kind = np.flatnonzero(inner)[kind]
        if not keep_first:
            whole, speaks = copies > 1, inner
        elif plan.inside:
            whole, speaks = ~inner, inner
        else:
            whole = owner["id"] > owner["id"][first_of_kind]
            speaks = ~whole
        kinds_in_group = np.bincount(group[inner])[group]
        asked = speaks & ((kinds_in_group > 1) | (p["twice"] > 0))
        if not plan.inside:  # a bucket of one document has nothing to compare
            low, high = np.full(group[-1] + 1, np.iinfo(np.int64).max), np.full(group[-1] + 1, np.iinfo(np.int64).min)
            np.minimum.at(low, group[speaks], owner["id"][speaks])
            np.maximum.at(high, group[speaks], owner["id"][speaks])
            asked &= (low < high)[group]
        out = []
        for mask, name, kinds, columns in ((whole, "span", SPAN, {"start": p["start"], "length": p["count"].astype(np.uint32) + plan.window - 1}),
                                           (asked, "ask", ASKED, p | {"settled": whole.astype(np.uint8)})):
            who = np.flatnonzero(mask)
            who = who[np.lexsort((p["start"][who], owner["text"][who], owner["id"][who]))]
            record, place_ = places.of({c: v[who] for c, v in owner.items()})
            who = who[record]
            own = {c: v[who] for c, v in owner.items()}
            batch = pack("place", place_, own, {c: columns[c][who] for c in kinds}, kinds)
            if batch is not None:
                table_ = pa.Table.from_batches([batch])
                table_ = table_.append_column("kind", pa.array([name] * batch.num_rows))
                out.append(table_.select([c.name for c in _settled]) if set(_settled.names) <= set(table_.column_names) else _fill(table_))
        return pa.concat_tables(out) if out else _settled.empty_table()

    return run


_settled = pa.schema([("place", pa.int32()), ("kind", pa.string()), *((c, pa.binary()) for c in [*OWNER, "each", "bucket", "start", "length", "count", "settled"])])
SETTLED = "place int, kind string, " + ", ".join(f"{c} binary" for c in [*OWNER, "each", "bucket", "start", "length", "count", "settled"])


def _fill(table: pa.Table) -> pa.Table:
    return pa.table({f.name: table.column(f.name) if f.name in table.column_names else pa.nulls(table.num_rows, f.type) for f in _settled}, schema=_settled)


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as disjoint, sorted ones that do not touch."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > reach[:-1]
    begin = np.flatnonzero(new)
    return starts[begin], reach[np.concatenate((begin[1:], [len(starts)])) - 1]


def by_document(owner: dict[str, np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
    """The records of each document (id and checksum of its text)."""
    order = np.lexsort((owner["text"], owner["id"]))
    ids, text = owner["id"][order], owner["text"][order]
    cuts = np.concatenate(([0], np.flatnonzero((np.diff(ids) != 0) | (np.diff(text.astype(np.int64)) != 0)) + 1, [len(order)])) if len(order) else np.zeros(1, np.int64)
    return {(int(ids[a]), int(text[a])): order[a:b] for a, b in zip(cuts[:-1], cuts[1:])}


def repeated_spans(df: DataFrame, plan: Plan, compare: Callable[..., Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]], keep_first: bool,
                   apply: Callable[[str | None, np.ndarray, np.ndarray], tuple], result: str, *, id_col: str, text_col: str, carry: Column | None = None) -> DataFrame:
    """``apply(text, starts, ends)`` of every document, with the disjoint spans
    (in codes) whose windows are repeated; columns doc_id, ``result`` and, if it
    is given, ``carry`` of the document's row.

    ``compare(bodies, owner, asked)`` gets the asked pieces of whole buckets, as
    arrays of codes, and yields (record, first window, windows) repeated."""
    shards = shards_of(df, 2)
    kind = df.schema[id_col].dataType.simpleString()
    null_id = (1 << 63) - 1  # a null id comes after all others
    more = [] if carry is None else [carry.alias("carry")]
    docs = df.select(df[id_col].alias("doc_id"), F.coalesce(df[text_col], F.lit("")).alias("text"), *more)
    docs = docs.withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(null_id)))
    docs, places = deal(docs, shards)
    blocks = piece_blocks(docs.select("id", "crc", "text"), plan, shards)
    settled = written(blocks.groupBy("shard").applyInArrow(settle(plan, keep_first, places), SETTLED))
    asked = settled.where("kind = 'ask'").select("place", *OWNER, "each", *ASKED)

    def fetch(texts: pa.Table, requests: pa.Table) -> pa.Table:
        schema = pa.schema([("shard", pa.int32()), ("body", pa.binary()), *((c, pa.binary()) for c in [*OWNER, "each", *ASKED])])
        if not requests.num_rows or not texts.num_rows:
            return schema.empty_table()
        owner, a = unpack(requests, ASKED)
        groups = by_document(owner)  # a document's repeated rows answer once
        out = []
        for part in text_slices(texts.combine_chunks().to_batches(), "text", plan.slice_bytes):
            data, offsets = buffer(part.column("text"))
            codes, first = plan.codes(data, offsets)
            raw = data.tobytes()
            ids = part.column("id").to_pylist()
            who = [groups.pop((ids[k], zlib.crc32(raw[offsets[k]:offsets[k + 1]])), None) for k in range(len(ids))]
            rows = [k for k, w in enumerate(who) if w is not None]
            if not rows:
                continue
            records = np.concatenate([who[k] for k in rows])
            begin = np.concatenate([first[k] + a["start"][who[k]].astype(np.int64) for k in rows])
            length = a["count"][records].astype(np.int64) + plan.window - 1
            before = np.concatenate(([0], np.cumsum(length)))
            body = codes[ranges(begin, length)]

            def bodies(chosen: np.ndarray) -> bytes:
                return body[ranges(before[chosen], length[chosen])].tobytes()

            own = {c: v[records] for c, v in owner.items()}
            out.append(pack("shard", (a["bucket"][records] % np.uint64(shards)).astype(np.int64), own, {c: a[c][records] for c in ASKED}, ASKED, bodies))
        return pa.Table.from_batches(out, schema=schema) if out else schema.empty_table()

    fetched = docs.select("place", "id", "text").groupBy("place").cogroup(asked.groupBy("place")).applyInArrow(fetch, packed_schema("shard", ASKED, "body binary"))

    def judge(table: pa.Table) -> pa.Table:
        owner, a = unpack(table, ASKED)
        sample = plan.codes(np.zeros(0, np.uint8), np.zeros(1, np.int64))[0]
        body = np.frombuffer(b"".join(table.column("body").to_pylist()), sample.dtype)
        found = [*compare(body, owner, a)]
        out = pa.schema([("place", pa.int32()), *((c, pa.binary()) for c in [*OWNER, "each", *SPAN])])
        if not found:
            return out.empty_table()
        record, start, count = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((owner["text"][record], owner["id"][record]))
        record, start, count = record[order], start[order], count[order]
        copy, place_ = places.of({c: v[record] for c, v in owner.items()})
        record, start, count = record[copy], start[copy], count[copy]
        own = {c: v[record] for c, v in owner.items()}
        batch = pack("place", place_, own, {"start": a["start"][record] + start, "length": count + plan.window - 1}, SPAN)
        return pa.Table.from_batches([batch]) if batch is not None else out.empty_table()

    columns = ["place", *OWNER, "each", *SPAN]
    judged = fetched.groupBy("shard").applyInArrow(judge, packed_schema("place", SPAN)).select(*columns)
    spans = settled.where("kind = 'span'").select(*columns).union(judged)
    fields = [x.strip().split(" ") for x in result.split(",")]

    def finish(texts: pa.Table, spans_: pa.Table) -> pa.Table:
        owner, s = unpack(spans_, SPAN)
        groups = by_document(owner)
        rows, none = [], np.zeros(0, np.int64)
        ids, texts_ = texts.column("id").to_pylist(), texts.column("text").to_pylist()
        for i, text in zip(ids, texts_):
            who = groups.get((i, zlib.crc32(text.encode()))) if groups else None
            if who is None:
                rows.append(apply(text, none, none))
            else:
                begin = s["start"][who].astype(np.int64)
                rows.append(apply(text, *merged(begin, begin + s["length"][who])))
        kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
        out = pa.table([texts.column("doc_id"), *(pa.array(v, kinds[t]) for v, (_, t) in zip(zip(*rows) if rows else [[]] * len(fields), fields))], names=["doc_id", *(n for n, _ in fields)])
        return out.append_column("carry", texts.column("carry")) if carried else out

    schema, carried = StructType.fromDDL(f"doc_id {kind}, {result}"), bool(more)
    if carried:
        schema = schema.add(docs.schema["carry"])
    whole = docs.select("place", "id", "doc_id", "text", *(["carry"] if carried else []))
    return whole.groupBy("place").cogroup(spans.groupBy("place")).applyInArrow(finish, schema)
