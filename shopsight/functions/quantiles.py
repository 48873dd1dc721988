"""Exact quantiles (pandas / DuckDB ``quantile_cont`` semantics) at scale.

Spark's exact ``percentile``/``median`` aggregate keeps a value->count map per
group and merges it in one task, so a large group (or a global median over
billions of distinct doubles) lands in a single task.  Here the work is split,
and the rows are read twice, whatever the number of columns and probabilities:

1. one aggregate per key gives, for each column, ``n`` and a mergeable approximate
   sketch (``percentile_approx``) at each target probability +- a margin -> a bracket
   ``[lo, hi]`` that should hold the target ranks (few values: one of everything);
2. one aggregate counts the values inside the brackets one by one and the others by
   the brackets below them, so that the place of every value inside is exact.

The counted values (about 8 of 10,000 rows a target) are then ranked: by a window
where no key and column has more than ``max_exact`` of them, else by a range-split and
prefix counts of the ranges (``ranking.rows_before``).  A target whose place holds
no value from inside was missed by the sketch; the distinct values of its key and column
are counted and ranked in the same way, whatever their number.

Hot values are harmless: rows are pre-aggregated to (value, count) before any window,
and every aggregate is partial/final with map-side combine.

Interpolation: with ``h = (n-1)q`` and ``r = floor(h)``, the result is
``v[r] + (v[r+1] - v[r]) * (h - r)`` over the sorted non-null values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopsight.functions.ranking import rows_before
from shopsight.session import ensure_checkpoint_dir

_INF = float("inf")
_BROADCAST_TARGETS = 200_000


def exact_quantiles(df: DataFrame, value_col: str, probs: Sequence[float], keys: Sequence[str] = (),
                    accuracy: int = 10000, max_exact: int = 100_000) -> DataFrame:
    """Return ``keys..., q, value`` with the exact linear-interpolated quantile
    ``q`` of ``value_col`` per key.  Nulls and NaN are ignored (pandas rule);
    keys without values produce no rows."""
    keys = list(keys)
    out = quantile_table(df, [value_col], probs, keys, accuracy, max_exact, "_column")
    return out.select(*keys, "q", "value")


def quantile_table(df: DataFrame, columns: Sequence[str], probs: Sequence[float], keys: Sequence[str] = (),
                   accuracy: int = 10000, max_exact: int = 100_000, name: str = "column") -> DataFrame:
    """Return ``keys..., column, q, value``: the quantiles of several columns in one
    solve (``name`` is the name of the column with their names)."""
    keys, probs = list(keys), sorted({float(q) for q in probs})
    ensure_checkpoint_dir(df.sparkSession)
    margin = 4.0 / accuracy
    base = df.select(*keys, *[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"_v{i}") for i, c in enumerate(columns)])
    grid = F.array(*[F.lit(min(max(q + d, 0.0), 1.0)) for q in probs for d in (-margin, margin)])
    first = base.groupBy(*keys).agg(*[x for i in range(len(columns)) for x in (
        F.count(f"_v{i}").alias(f"_n{i}"), F.percentile_approx(f"_v{i}", grid, accuracy).alias(f"_s{i}"))])

    def bracket(i: int, j: int) -> tuple[Column, Column]:
        whole, sketch = F.col(f"_n{i}") <= 2 * accuracy, F.col(f"_s{i}")
        lo = F.when(whole | F.lit(probs[j] - margin <= 0), F.lit(-_INF)).otherwise(sketch[2 * j])
        return lo, F.when(whole | F.lit(probs[j] + margin >= 1), F.lit(_INF)).otherwise(sketch[2 * j + 1])

    state = first.select(*keys, *[x for i in range(len(columns)) for x in (F.col(f"_n{i}"), *[
        b.alias(f"_{side}{i}_{j}") for j in range(len(probs)) for side, b in zip(("lo", "hi"), bracket(i, j))])]).checkpoint()
    n_keys = state.count() if keys else 1
    small = n_keys * len(columns) * len(probs) <= _BROADCAST_TARGETS
    targets = state.select(*keys, F.explode(F.array(*[
        F.struct(F.lit(i).alias("_c"), F.col(f"_n{i}").alias("_n"), F.lit(q).alias("q")) for i in range(len(columns)) for q in probs])).alias("_t"))
    targets = (targets.select(*keys, "_t.*").where("_n > 0").withColumn("_h", (F.col("_n") - 1) * F.col("q"))
               .withColumn("_r0", F.floor("_h").cast("long")).withColumn("_r1", F.least(F.col("_r0") + 1, F.col("_n") - 1))
               .select(*keys, "_c", "q", "_r0", "_r1", (F.col("_h") - F.col("_r0")).alias("_frac")))

    rows = _Rows(base, state, keys, small)
    places = F.explode(F.array(*[_place(rows, i, len(probs)) for i in range(len(columns))])).alias("_p")
    found = (rows.frame.select(*keys, places).where(F.col("_p").isNotNull()).select(*keys, "_p.*")
             .groupBy(*keys, "_c", "_z", "_v").agg(F.count("*").alias("_k")).checkpoint())
    out = _ranked(found, targets, keys, max_exact, small).checkpoint()
    missed = out.where(F.col("value").isNull()).select(*keys, "_c", "q", "_r0", "_r1", "_frac")
    if not missed.isEmpty():
        again = missed.select(*keys, "_c").distinct()
        values = F.explode(F.array(*[F.struct(F.lit(i).alias("_c"), F.lit(0).alias("_z"), F.col(f"_v{i}").alias("_v")) for i in range(len(columns))])).alias("_p")
        whole = (base.select(*keys, values).select(*keys, "_p.*").where(F.col("_v").isNotNull())
                 .join(F.broadcast(again) if small else again, [*keys, "_c"]).groupBy(*keys, "_c", "_z", "_v").agg(F.count("*").alias("_k")).checkpoint())
        out = out.where(F.col("value").isNotNull()).unionByName(_ranked(whole, missed, keys, max_exact, small)).checkpoint()
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("_c") + 1)
    return out.select(*keys, names.alias(name), "q", "value")


class _Rows:
    """The rows and, by column and target, the bounds of their brackets: literals where
    there are no keys, else columns joined by key (broadcast up to a fixed number)."""

    def __init__(self, base: DataFrame, state: DataFrame, keys: list[str], small: bool):
        self._row = None if keys else state.first()
        bounds = state.select(*keys, *[c for c in state.columns if c.startswith(("_lo", "_hi"))]) if keys else None
        self.frame = base if bounds is None else base.join(F.broadcast(bounds) if small else bounds, keys)

    def bound(self, name: str) -> Column:
        return F.col(name) if self._row is None else F.lit(self._row[name]).cast("double")


def _place(rows: _Rows, i: int, targets: int) -> Column:
    """Column ``i``'s value as (column, brackets that end below it, value or, outside
    all brackets, null); null for a gap and for a value above all brackets."""
    v = F.col(f"_v{i}")
    lo, hi = ([rows.bound(f"_{side}{i}_{j}") for j in range(targets)] for side in ("lo", "hi"))
    inside, below = F.lit(False), F.lit(0)
    for a, b in zip(lo, hi):
        inside = inside | ((v >= a) & (v <= b))
        below = below + (v > b).cast("int")
    return F.when(v <= hi[-1], F.struct(F.lit(i).alias("_c"), below.alias("_z"), F.when(inside, v).alias("_v")))


def _ranked(found: DataFrame, targets: DataFrame, keys: list[str], max_exact: int, small: bool) -> DataFrame:
    """The targets with ``value``, null where a place holds no single value."""
    by = [*keys, "_c"]
    most = found.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    order = [F.col("_z"), F.col("_v").asc_nulls_first()]
    if most <= max_exact:
        ahead = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        placed = found.withColumn("_at", F.coalesce(F.sum("_k").over(ahead), F.lit(0)))
    else:
        placed = rows_before(found, [*[F.col(c) for c in by], *order], count_col="_k", name="_at")
        start = placed.groupBy(*by).agg(F.min("_at").alias("_from"))  # one row a key and column
        placed = placed.join(F.broadcast(start) if small else start, by).withColumn("_at", F.col("_at") - F.col("_from"))
    hit0, hit1 = ((F.col("_at") <= F.col(r)) & (F.col(r) < F.col("_at") + F.col("_k")) for r in ("_r0", "_r1"))
    picked = (placed.join(F.broadcast(targets) if small else targets, by).where(hit0 | hit1).groupBy(*by, "q")
              .agg(F.max(F.when(hit0, F.col("_v"))).alias("_v0"), F.max(F.when(hit1, F.col("_v"))).alias("_v1")))
    value = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * F.col("_frac")
    return targets.join(picked, [*by, "q"], "left").select(*by, "q", "_r0", "_r1", "_frac", value.alias("value"))


def exact_median_row(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact median of each column (one small driver-side dict, one entry per column)."""
    if not columns:
        return {}
    got = {r["column"]: r["value"] for r in quantile_table(df, columns, [0.5]).collect()}
    return {c: got.get(c) for c in columns}
