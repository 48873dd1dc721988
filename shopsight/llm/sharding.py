"""Sharding along a Hilbert curve, with DataFrame functions only.

Several metadata dimensions are quantised to a few bits each, a row's cell gets
its index along the Hilbert curve, rows are sorted by that index (equal texts of
a cell next to each other, by checksum), and the order is cut into runs of equal
row counts, so that a file covers a compact box of every dimension and readers
can skip files by any of them.

The law is "rows": shard sizes differ by one row at most.  A shard count is
fixed in advance; the law says nothing about growing it, so grown_shard is null.

The global rank needs no single task: a range sort writes each row's partition
and place to the shared folder once, and the partitions' counts (one row for
each) give every partition its first rank.  Rows that share a cell are spread by
checksum and id, so a hot cell or a hot text spans many partitions.

Defined results: null metadata is a value of its own (code 0 for numbers); a
null text has size 1 and the checksum of no bytes; repeated rows keep a place
each, in any order among themselves; null ids sort first; an empty table gives
no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopsight.llm._store import written

_PLACE_BITS = 33  # monotonically_increasing_id keeps the partition above these


def _curve_tables(dims: int) -> tuple[list[int], list[int]]:
    """For each state of the curve (entry corner and direction) and each cell of
    the 2x..x2 box: the cell's digit along the curve, and the state inside it."""
    size = 1 << dims

    def gray(i: int) -> int:
        return i ^ (i >> 1)

    rank = {gray(i): i for i in range(size)}

    def turn(x: int, by: int) -> int:
        by %= dims
        return ((x << by) | (x >> (dims - by))) & (size - 1) if by else x

    def ones(i: int) -> int:
        return (~i & (i + 1)).bit_length() - 1

    digits, states = [], []
    for corner in range(size):
        for axis in range(dims):
            for cell in range(size):
                digit = rank[turn(cell ^ corner, dims - (axis + 1) % dims)]
                entry = gray(2 * ((digit - 1) // 2)) if digit else 0
                along = 0 if not digit else ones(digit - 1) if digit % 2 == 0 else ones(digit)
                digits.append(digit)
                states.append((corner ^ turn(entry, axis + 1)) * dims + (axis + along + 1) % dims)
    return digits, states


def hilbert_index(coordinates: list[Column], bits: int) -> Column:
    """The index along the Hilbert curve of a cell with ``bits``-bit coordinates."""
    dims = len(coordinates)
    digits, states = (F.array(*map(F.lit, x)) for x in _curve_tables(dims))
    levels = []
    for level in range(bits - 1, -1, -1):
        cell = F.lit(0)
        for k, c in enumerate(coordinates):
            cell = cell + F.shiftleft(F.shiftright(c.cast("int"), level).bitwiseAND(F.lit(1)), k)
        levels.append(cell)

    def step(state: Column, cell: Column) -> Column:
        at = state["s"] * F.lit(1 << dims) + cell
        return F.struct((state["h"] * F.lit(1 << dims) + F.get(digits, at)).cast("long").alias("h"), F.get(states, at).cast("int").alias("s"))

    start = F.struct(F.lit(0).cast("long").alias("h"), F.lit(0).cast("int").alias("s"))
    return F.aggregate(F.array(*levels), start, step, lambda state: state["h"])


def category_code(value: Column, bits: int) -> Column:
    """A category's cell, by hash; null is a category too."""
    return F.pmod(F.xxhash64(value.cast("string")), F.lit(1 << bits)).cast("int")


def log_code(value: Column, bits: int, top: int = 24) -> Column:
    """A size's cell on a logarithmic scale that ends at 2**top."""
    most = (1 << bits) - 1
    return F.least(F.lit(most), F.floor(F.log2(F.greatest(F.coalesce(value, F.lit(0)), F.lit(0)) + 1) * (most / top))).cast("int")


def hilbert_shards(df: DataFrame, dimensions: list[Column], bits: int, shards: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the curve index
    of every row."""
    text = F.coalesce(df[text_col], F.lit("")).cast("binary")
    rows = df.select(df[id_col].alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                     hilbert_index(dimensions, bits).alias("curve"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    keys = ["curve", "text_crc32", "size", "doc_id"]
    placed = written(rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _PLACE_BITS)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # one row for each partition of the sort
    ahead = Window.orderBy("_part")
    firsts = counts.select("_part", (F.sum("_n").over(ahead.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_first"),
                           F.sum("_n").over(ahead.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"))
    ranked = (placed.withColumn("_part", part).join(F.broadcast(firsts), "_part")
              .withColumn("_rank", F.col("_first") + F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1)))
              .withColumn("shard", F.expr(f"_rank * {shards} div _all")))
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
                         F.expr(f"_rank - (shard * _all + {shards - 1}) div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")


def write_shards(df: DataFrame, sharded: DataFrame, path: str, *, id_col: str = "doc_id") -> None:
    """Write the table's rows into one folder for each shard, sorted along the
    curve.  Ids must be distinct and not null here."""
    places = sharded.select(F.col("doc_id").alias("_id"), "shard", "slot")
    joined = df.join(places, df[id_col] == F.col("_id")).drop("_id")
    joined.repartition("shard").sortWithinPartitions("shard", "slot").drop("slot").write.partitionBy("shard").parquet(path)
