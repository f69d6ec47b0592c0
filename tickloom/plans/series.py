"""Ordered-series plans that never put one key into one task.

A key may hold a third of all rows, so no operator windows over
``partitionBy(key)`` on the rows themselves. Rows are first numbered within
their key (`index_series`), then cut into chunks of a fixed number of rows:

* bounded frames run per (key, chunk) with the few neighbouring rows copied
  in (`over_chunks`);
* running aggregates run per (key, chunk) plus one carried value per chunk
  (`running`);
* exponential averages run per (key, chunk) plus a carry that is a sum over
  the preceding chunks (`ewm`).

Only tables with one row per chunk are ever ordered by key alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.functions.columns import col
from tickloom.plans.storage import once

KEYS = ("symbol",)
TS = "ts"
RN = "rn"
N_ROWS = "n_rows"
CHUNK_ROWS = 1 << 16
SLICE_HOURS = 24 * 30


def time_slice(ts: str | Column, hours: int) -> Column:
    """Number of the time slice a timestamp falls in; never decreases with time."""
    t = col(ts)
    days = F.datediff(t, F.to_date(F.lit("1970-01-01")))
    return F.floor((days * 24 + F.hour(t)) / F.lit(hours)).cast("bigint")


def index_series(
    df: DataFrame,
    keys: Sequence[str] = KEYS,
    ts: str = TS,
    slice_hours: int = SLICE_HOURS,
) -> DataFrame:
    """Add `rn` (0, 1, … per key in time order) and `n_rows` (rows of the key).

    Rows are ranked inside (key, time slice) and the counts of the earlier
    slices are added, so the largest group is one slice of one key. As (key,
    ts) is unique, a slice holds at most slice_hours / bar-interval rows;
    choose a shorter slice for tick data.
    """
    return index_by(df, keys, time_slice(ts, slice_hours), [F.col(ts)])


def index_by(df: DataFrame, keys: Sequence[str], slice_: Column, order: Sequence[Column]) -> DataFrame:
    """`index_series` for any slice number that never decreases along `order`."""
    s = once(df.drop(RN, N_ROWS)).withColumn("__slice", slice_)
    by_key = Window.partitionBy(*keys)
    offsets = (
        s.groupBy(*keys, "__slice")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(
            *keys,
            "__slice",
            (F.sum("__n").over(by_key.orderBy("__slice").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n")).alias("__off"),
            F.sum("__n").over(by_key).alias(N_ROWS),
        )
    )
    rank = F.row_number().over(Window.partitionBy(*keys, "__slice").orderBy(*order))
    return (
        s.withColumn("__k", rank)
        .join(offsets, [*keys, "__slice"])
        .withColumn(RN, F.col("__off") + F.col("__k") - 1)
        .drop("__slice", "__off", "__k")
    )


def place_chunks(df: DataFrame, back: int, ahead: int, rn: str = RN, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows with the chunk they belong to (`__home`) and, copied, each chunk that needs them (`__chunk`)."""
    size = max(chunk_rows, back, ahead)
    home = F.expr(f"`{rn}` div {size}")
    pos = F.col(rn) % size
    copies = [home]
    if back:
        copies.append(F.when(pos >= size - back, home + 1))
    if ahead:
        copies.append(F.when((pos < ahead) & (home > 0), home - 1))
    spread = F.explode(F.array_compact(F.array(*copies))) if len(copies) > 1 else home
    return df.withColumn("__home", home).withColumn("__chunk", spread)


def over_chunks(
    df: DataFrame,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    back: int = 0,
    ahead: int = 0,
    keys: Sequence[str] = KEYS,
    rn: str = RN,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Run bounded-frame window code per chunk of an indexed series.

    `build(df, w)` gets the window (chunk-partitioned, ordered by `rn`, no
    frame) and may look at most `back` rows back and `ahead` rows ahead. The
    rows a chunk needs from its neighbours are copied into it and dropped
    again afterwards. One shuffle on (keys, chunk).
    """
    placed = place_chunks(df, back, ahead, rn, chunk_rows)
    w = Window.partitionBy(*keys, "__chunk").orderBy(rn)
    out = build(placed, w)
    return out.filter(F.col("__home") == F.col("__chunk")).drop("__home", "__chunk")


_RUNNING = {
    "sum": F.sum,
    "count": F.count,
    "max": F.max,
    "min": F.min,
}


def running(
    df: DataFrame,
    specs: Mapping[str, tuple[str, str | Column]],
    keys: Sequence[str] = KEYS,
    rn: str = RN,
    chunk_rows: int = CHUNK_ROWS,
    reverse: bool = False,
) -> DataFrame:
    """Running aggregates from the start of the key (its end, if `reverse`).

    `specs` maps the new column to (kind, expression); kinds are sum, count,
    max, min and last (latest non-null value). Chunks aggregate on their own;
    one row per chunk carries the earlier chunks' result across.
    """
    chunked = once(df).withColumn("__chunk", F.expr(f"`{rn}` div {chunk_rows}"))
    for i, (_, expr) in enumerate(specs.values()):
        chunked = chunked.withColumn(f"__v{i}", col(expr))
    order = F.col(rn).desc() if reverse else F.col(rn).asc()
    chunk_order = F.col("__chunk").desc() if reverse else F.col("__chunk").asc()
    local_w = Window.partitionBy(*keys, "__chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    carry_w = Window.partitionBy(*keys).orderBy(chunk_order).rowsBetween(Window.unboundedPreceding, -1)

    totals, carries, local, final = [], [], {}, {}
    for i, (name, (kind, _)) in enumerate(specs.items()):
        v, total, carry = F.col(f"__v{i}"), f"__t{i}", f"__c{i}"
        if kind == "last":
            edge = F.min_by if reverse else F.max_by
            totals.append(edge(v, F.when(v.isNotNull(), F.col(rn))).alias(total))
            carries.append(F.last(total, ignorenulls=True).over(carry_w).alias(carry))
            local[f"__l{i}"] = F.last(v, ignorenulls=True).over(local_w)
            final[name] = F.coalesce(F.col(f"__l{i}"), F.col(carry))
            continue
        agg = _RUNNING[kind]
        totals.append(agg(v).alias(total))
        carries.append((F.sum if kind == "count" else agg)(total).over(carry_w).alias(carry))
        local[f"__l{i}"] = agg(v).over(local_w)
        here, before = F.col(f"__l{i}"), F.col(carry)
        if kind == "max":
            final[name] = F.greatest(here, before)
        elif kind == "min":
            final[name] = F.least(here, before)
        elif kind == "count":
            final[name] = here + F.coalesce(before, F.lit(0))
        else:
            final[name] = F.when(here.isNull(), before).otherwise(here + F.coalesce(before, F.lit(0)))

    carried = chunked.groupBy(*keys, "__chunk").agg(*totals).select(*keys, "__chunk", *carries)
    out = chunked.withColumns(local).join(carried, [*keys, "__chunk"], "left").withColumns(final)
    scratch = [f"__{p}{i}" for i in range(len(specs)) for p in "vlc"]
    return out.drop("__chunk", *scratch)


@dataclass(frozen=True)
class Ewm:
    """One exponential average, starting at its first value x itself.

    A value that follows the last one by g rows enters as
    y = (q^g * y + alpha * x) / (q^g + alpha) with q = 1-alpha, which is
    q * y + alpha * x where no row lacks a value. Rows without a value carry
    the average on. `seed` names the row number from which values count: a
    constant, or a column equal to it on every row of the key. `min_periods`
    counts values.
    """

    value: str | Column
    alpha: float
    min_periods: int = 1
    seed: int | str = 0

    @classmethod
    def span(cls, value: str | Column, span: int, seed: int = 0) -> Ewm:
        return cls(value, 2.0 / (span + 1), span, seed)

    @classmethod
    def wilder(cls, value: str | Column, length: int, seed: int = 0, min_periods: int | None = None) -> Ewm:
        return cls(value, 1.0 / length, length if min_periods is None else min_periods, seed)


# exp(-745) is the smallest double above zero; exp(500) leaves room to multiply.
_VANISH = 745.0
_SCALE = 500.0
_SEGMENT = 250.0


def _decay(gap: Column, alpha: float) -> Column:
    """-log of the weight that the old average keeps when a value follows after `gap` rows."""
    steps = gap * -math.log1p(-alpha)
    return F.log1p(F.lit(alpha) * F.exp(F.when(steps > _VANISH - 45, _VANISH - 45).otherwise(steps)))


def _raised(i: int, alpha: float, sign: int) -> Column:
    """exp(-L) or its inverse: single steps as a power of q, which rounds once, however many they are."""
    return F.pow(F.lit(1.0 - alpha), F.col(f"__k{i}") * sign) * F.exp(F.col(f"__w{i}") * -sign)


def _end_states(summaries: DataFrame, specs: Sequence[Ewm], keys: Sequence[str]) -> DataFrame:
    """For each chunk: the average and the number of values before it, and its first value's decay.

    A chunk maps the average before it to the one after it by a factor exp(-D)
    and a summand. The recursion over chunks is a sum of summands times powers
    of e; powers are taken within segments of the running decay, so that none
    overflows, and segments more than three back have vanished.
    """
    order = Window.partitionBy(*keys).orderBy("__chunk")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    first: dict[str, Column] = {}
    for i, s in enumerate(specs):
        last = F.last(f"__rl{i}", ignorenulls=True).over(before)
        first[f"__n{i}"] = F.coalesce(F.sum(f"__m{i}").over(before), F.lit(0))
        if s.alpha < 1:
            first[f"__d{i}"] = F.when(F.col(f"__m{i}") > 0, _decay(F.col(f"__rf{i}") - last, s.alpha))
        else:
            first[f"__c{i}"] = F.last(f"__xl{i}", ignorenulls=True).over(before)
    out = summaries.withColumns(first)
    partial = [i for i, s in enumerate(specs) if s.alpha < 1]
    if not partial:
        return out
    out = out.withColumns({f"__total{i}": F.sum(F.coalesce(F.col(f"__k{i}") * -math.log1p(-specs[i].alpha) + F.col(f"__w{i}"), F.lit(0.0)) + F.coalesce(F.col(f"__d{i}"), F.lit(0.0))).over(upto) for i in partial})
    # The first chunk with values takes its first value whole.
    share = {i: F.lit(1.0) - F.when(F.col(f"__d{i}").isNull(), F.lit(0.0)).otherwise(F.exp(-F.col(f"__d{i}"))) for i in partial}
    out = out.withColumns({f"__s{i}": F.floor(F.col(f"__total{i}") / _SEGMENT) for i in partial})
    term = {i: F.when(F.col(f"__m{i}") > 0, _raised(i, specs[i].alpha, 1) * (share[i] * F.col(f"__xf{i}") + F.col(f"__V{i}"))) for i in partial}
    out = out.withColumns({f"__t{i}": term[i] * F.exp(F.col(f"__total{i}") - F.col(f"__s{i}") * _SEGMENT) for i in partial})
    ends = {}
    for i in partial:
        own = Window.partitionBy(*keys, f"__s{i}").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, 0)
        by_segment = Window.partitionBy(*keys).orderBy(f"__s{i}")
        total = F.coalesce(F.sum(f"__t{i}").over(own), F.lit(0.0))
        for back in (1, 2):
            earlier = F.sum(f"__t{i}").over(by_segment.rangeBetween(-back, -back))
            total = total + F.coalesce(earlier, F.lit(0.0)) * math.exp(-back * _SEGMENT)
        # A term of up to e^250 from three segments back is no longer above zero after them.
        third = F.sum(f"__t{i}").over(by_segment.rangeBetween(-3, -3))
        total = total + F.coalesce(third, F.lit(0.0)) * math.exp(-2 * _SEGMENT) * F.lit(math.exp(-_SEGMENT))
        ends[f"__e{i}"] = F.when(F.col(f"__n{i}") + F.col(f"__m{i}") > 0, total * F.exp(F.col(f"__s{i}") * _SEGMENT - F.col(f"__total{i}")))
    return out.withColumns(ends).withColumns({f"__c{i}": F.lag(f"__e{i}").over(order) for i in partial})


def ewm(
    df: DataFrame,
    specs: Mapping[str, Ewm],
    keys: Sequence[str] = KEYS,
    rn: str = RN,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Exponential averages of an indexed series without a sequential pass.

    With e_j the decay at value j and L its running sum inside a chunk, the
    average is exp(-L) * (first + sum of (1 - exp(-e_j)) * x_j * exp(L_j)): plain
    running sums. L grows by at most -log(q) a row, and the chunk length keeps
    exp(L) finite. Only a chunk's first value depends on earlier chunks; one row
    per chunk carries the average across (`_end_states`).
    """
    decays = [-math.log1p(-s.alpha) for s in specs.values() if s.alpha < 1]
    size = min([chunk_rows, *(max(2, int(_SCALE / d)) for d in decays)])
    chunked = once(df).withColumn("__chunk", F.expr(f"`{rn}` div {size}"))
    w = Window.partitionBy(*keys, "__chunk").orderBy(rn)
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)

    values, places, decayed, sums, summary = {}, {}, {}, {}, []
    for i, s in enumerate(specs.values()):
        seed = F.lit(s.seed) if isinstance(s.seed, int) else F.col(s.seed)
        x, row = F.col(f"__x{i}"), F.when(F.col(f"__x{i}").isNotNull(), F.col(rn))
        values[f"__x{i}"] = F.when(F.col(rn) >= seed, col(s.value).cast("double"))
        places |= {f"__m{i}": F.count(x).over(upto)}
        summary += [F.max(f"__m{i}").alias(f"__m{i}"), F.min(row).alias(f"__rf{i}"), F.max(row).alias(f"__rl{i}")]
        if s.alpha < 1:
            places[f"__g{i}"] = F.when(x.isNotNull(), F.col(rn) - F.last(row, ignorenulls=True).over(before))
            places[f"__xf{i}"] = F.first(x, ignorenulls=True).over(upto)
            # Steps of one row are counted, not summed: no rounding piles up.
            gap = F.col(f"__g{i}")
            decayed[f"__k{i}"] = F.count(F.when(gap == 1, 1)).over(upto)
            decayed[f"__w{i}"] = F.coalesce(F.sum(F.when(gap > 1, _decay(gap, s.alpha))).over(upto), F.lit(0.0))
            share = F.when(gap == 1, s.alpha).otherwise(F.lit(1.0) - F.exp(-_decay(gap, s.alpha)))
            enters = F.when(gap.isNotNull(), share * x * _raised(i, s.alpha, -1))
            sums[f"__V{i}"] = F.coalesce(F.sum(enters).over(upto), F.lit(0.0))
            # Sums of a chunk are those of its last row.
            summary += [F.max_by(c, rn).alias(c) for c in (f"__xf{i}", f"__k{i}", f"__w{i}", f"__V{i}")]
        else:
            places[f"__xl{i}"] = F.last(x, ignorenulls=True).over(upto)
            summary.append(F.max_by(f"__xl{i}", rn).alias(f"__xl{i}"))
    rows = chunked.withColumns(values).withColumns(places)
    for columns in (decayed, sums):
        rows = rows.withColumns(columns) if columns else rows
    ends = _end_states(rows.groupBy(*keys, "__chunk").agg(*summary), list(specs.values()), keys)
    carried = [c for i, s in enumerate(specs.values()) for c in (f"__n{i}", f"__c{i}", *([f"__d{i}"] if s.alpha < 1 else []))]
    out = rows.join(ends.select(*keys, "__chunk", *carried), [*keys, "__chunk"])

    final = {}
    for i, (name, s) in enumerate(specs.items()):
        old = F.col(f"__c{i}")
        if s.alpha < 1:
            kept = F.exp(-F.col(f"__d{i}"))
            start = F.when(F.col(f"__d{i}").isNull(), F.col(f"__xf{i}")).otherwise(kept * old + (F.lit(1.0) - kept) * F.col(f"__xf{i}"))
            y = F.when(F.col(f"__m{i}") == 0, old).otherwise(_raised(i, s.alpha, 1) * (start + F.col(f"__V{i}")))
        else:
            y = F.coalesce(F.col(f"__xl{i}"), old)
        final[name] = F.when(F.col(f"__n{i}") + F.col(f"__m{i}") >= s.min_periods, y)
    out = out.withColumns(final)
    scratch = [f"__{p}{i}" for i in range(len(specs)) for p in ("x", "m", "g", "xf", "k", "w", "V", "xl", "n", "c", "d")]
    return out.drop("__chunk", *scratch)


def first_rows(
    df: DataFrame, present: Mapping[str, Column], keys: Sequence[str] = KEYS, rn: str = RN
) -> DataFrame:
    """Add, on every row of a key, the number of its first row meeting each condition."""
    stored = once(df)
    firsts = stored.groupBy(*keys).agg(*[F.min(F.when(c, F.col(rn))).alias(n) for n, c in present.items()])
    return join_on_keys(stored, firsts, keys)


SALTS = 32


def join_on_keys(
    df: DataFrame,
    per_key: DataFrame,
    keys: Sequence[str] = KEYS,
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Join one row per key onto rows where a few keys may hold most of them.

    The small side is repeated once per salt, so a hot key is spread over
    `salts` groups. Nothing is broadcast by hint: Spark does that itself when
    the small side's measured size is below its threshold.
    """
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType)]
    salt = F.pmod(F.xxhash64(*[col(c) for c in plain]), F.lit(salts)).cast("int")
    left = df.withColumn("__salt", salt)
    right = per_key.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "__salt"], how).drop("__salt")


_CELLS = 256


def quantiles(
    df: DataFrame,
    probs: Mapping[str, tuple[str, float]],
    keys: Sequence[str] = KEYS,
    accuracy: int = 1000,
) -> DataFrame:
    """Exact quantiles (linear interpolation) per key, one column per entry.

    `probs` maps the output name to (column, probability). Equal values are
    counted together before the shuffle. A mergeable sketch brackets each
    quantile and the bracket is cut into cells; cell counts tell which cell
    holds the wanted ranks, and only that cell's values are ordered. Values
    below and above the bracket are cells too, so a poor sketch costs time,
    never exactness.
    """
    pairs = list(probs.items())
    columns = sorted({c for _, (c, _) in pairs})
    values = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("double").alias("x")) for c in columns])
    long = once(df.select(*keys, *[col(c) for c in columns])).select(*keys, F.explode(values).alias("__e")).select(*keys, "__e.c", "__e.x").filter("x IS NOT NULL")
    counted = long.groupBy(*keys, "c", "x").agg(F.count(F.lit(1)).alias("n"))

    margin = 4.0 / accuracy
    grid = sorted({min(1.0, max(0.0, p + d)) for _, (_, p) in pairs for d in (-margin, margin)})
    marks = F.map_from_arrays(F.array(*[F.lit(g) for g in grid]), F.col("__marks"))
    wanted = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.lit(c).alias("c"),
                (F.lit(float(p)) * (F.col("__total") - 1)).alias("rank"),
                F.element_at(marks, F.lit(max(0.0, p - margin))).alias("lo"),
                F.element_at(marks, F.lit(min(1.0, p + margin))).alias("hi"),
            )
            for name, (c, p) in pairs
        ]
    )
    sketch = F.percentile_approx("x", F.array(*[F.lit(g) for g in grid]), F.lit(accuracy))
    targets = (
        long.groupBy(*keys, "c")
        .agg(sketch.alias("__marks"), F.count(F.lit(1)).alias("__total"))
        .select(*keys, "c", F.filter(wanted, lambda t: t["c"] == F.col("c")).alias("__t"))
    )

    lo, hi, x = F.col("t.lo"), F.col("t.hi"), F.col("x")
    cell = (
        F.when(x < lo, -1)
        .when(x > hi, _CELLS + 1)
        .when(hi > lo, F.floor(F.try_divide(x - lo, hi - lo) * _CELLS))
        .otherwise(0)
    )
    placed = (
        join_on_keys(counted, targets, [*keys, "c"])
        .withColumn("t", F.explode("__t"))
        .select(*keys, F.col("t.name").alias("name"), F.col("t.rank").alias("rank"), cell.alias("cell"), "x", "n")
    )
    by_cell = Window.partitionBy(*keys, "name").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    cells = (
        placed.groupBy(*keys, "name", "rank", "cell")
        .agg(F.sum("n").alias("__n"))
        .withColumn("__upto", F.sum("__n").over(by_cell))
        .withColumn("__before", F.col("__upto") - F.col("__n"))
        .filter((F.col("__upto") > F.floor("rank")) & (F.col("__before") <= F.ceil("rank")))
        .select(*keys, "name", "cell", "__before")
    )
    in_cell = Window.partitionBy(*keys, "name", "cell").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    picked = (
        placed.join(cells, [*keys, "name", "cell"])
        .withColumn("upto", F.sum("n").over(in_cell) + F.col("__before"))
        .groupBy(*keys, "name")
        .agg(
            F.min(F.when(F.col("upto") > F.floor("rank"), x)).alias("a"),
            F.min(F.when(F.col("upto") > F.ceil("rank"), x)).alias("b"),
            F.max(F.col("rank") - F.floor("rank")).alias("f"),
        )
    )
    value = F.col("a") + (F.col("b") - F.col("a")) * F.col("f")
    return picked.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, value)).alias(name) for name, _ in pairs])
