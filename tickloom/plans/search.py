"""Searches along a series that do not walk it row by row.

`first_exit` finds where each open position ends; `chain` picks entries one
after the other. Both cut the series into blocks or chunks and only handle
their summaries across block borders.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.plans.series import KEYS, RN
from tickloom.plans.storage import cut, once

RADIX = 32

_STATE = "struct<done:boolean,into:bigint,live:boolean,best:double,mfe:double,mae:double,rn:bigint,price:double,reason:string,last:double>"


def _children(bars: DataFrame, keys: Sequence[str], hi: str, lo: str, last: str, radix: int) -> DataFrame:
    """Lowest level: one row per block, holding its bars and those of the next block."""
    block = F.expr(f"`{RN}` div {radix}")
    homes = F.explode(F.array_compact(F.array(block, F.when(block > 0, block - 1))))
    bar = F.struct(
        F.col(RN).alias("pos"),
        F.col(hi).cast("double").alias("hi"),
        F.col(lo).cast("double").alias("lo"),
        F.lit(1.0).alias("fall"),
        F.lit(1.0).alias("rise"),
        F.col(last).cast("double").alias("last"),
    )
    return bars.select(*keys, homes.alias("node"), bar.alias("bar")).groupBy(*keys, "node").agg(
        F.sort_array(F.collect_list("bar")).alias("bars")
    )


def _summaries(nodes: DataFrame, keys: Sequence[str], radix: int, lowest: bool) -> DataFrame:
    """Next level: per block of blocks, the highs, lows and steepest moves inside each block."""
    own = F.filter("bars", lambda b: b["pos"] < (F.col("node") + 1) * radix) if lowest else F.col("bars")
    start = F.struct(
        F.lit(None).cast("double").alias("hi"),
        F.lit(None).cast("double").alias("lo"),
        F.lit(1.0).alias("fall"),
        F.lit(1.0).alias("rise"),
        F.lit(None).cast("double").alias("last"),
    )
    fold = F.aggregate(
        own,
        start,
        lambda s, b: F.struct(
            F.greatest(s["hi"], b["hi"]).alias("hi"),
            F.least(s["lo"], b["lo"]).alias("lo"),
            F.least(s["fall"], b["fall"], F.try_divide(b["lo"], s["hi"])).alias("fall"),
            F.greatest(s["rise"], b["rise"], F.try_divide(b["hi"], s["lo"])).alias("rise"),
            b["last"].alias("last"),
        ),
    )
    folded = nodes.select(*keys, "node", fold.alias("f"))
    bar = F.struct(F.col("node").alias("pos"), "f.hi", "f.lo", "f.fall", "f.rise", "f.last")
    return folded.select(*keys, F.expr(f"node div {radix}").alias("node"), bar.alias("bar")).groupBy(*keys, "node").agg(
        F.sort_array(F.collect_list("bar")).alias("bars")
    )


def _step(s: Column, b: Column, span: int, stop_first: bool) -> Column:
    """One bar (span 1) or the summary of a block of `span` bars, seen by an open position."""
    long = F.col("direction") == 1
    entry, trail = F.col("entry_price"), F.col("trail")
    gain_hi = F.try_divide(F.when(long, b["hi"] - entry).otherwise(entry - b["lo"]), entry)
    gain_lo = F.try_divide(F.when(long, b["lo"] - entry).otherwise(entry - b["hi"]), entry)
    mfe, mae = F.greatest(s["mfe"], gain_hi), F.least(s["mae"], gain_lo)
    stop = F.coalesce(F.when(long, b["lo"] <= F.col("stop")).otherwise(b["hi"] >= F.col("stop")), F.lit(False))
    target = F.coalesce(F.when(long, b["hi"] >= F.col("target")).otherwise(b["lo"] <= F.col("target")), F.lit(False))
    starts = F.coalesce(~s["live"] & (gain_hi >= F.col("activation")), F.lit(False))
    late = F.coalesce(b["pos"] >= F.col("last_rn"), F.lit(False))
    frozen = s["done"] | s["into"].isNotNull()
    extreme = F.when(long, F.greatest(s["best"], b["hi"])).otherwise(F.least(s["best"], b["lo"]))
    none_l, none_d, none_s = F.lit(None).cast("bigint"), F.lit(None).cast("double"), F.lit(None).cast("string")

    if span == 1:
        live = s["live"] | starts
        best = F.when(live, extreme)
        level_price = F.when(long, best * (1 - trail)).otherwise(best * (1 + trail))
        trailed = F.coalesce(live & F.when(long, b["lo"] <= level_price).otherwise(b["hi"] >= level_price), F.lit(False))
        checks = [(stop, F.col("stop"), "Stop Loss"), (trailed, level_price, "Trailing Stop"), (target, F.col("target"), "Take Profit")]
        checks = checks if stop_first else [checks[2], *checks[:2]]
        checks.append((late, b["last"], "Time Limit"))
        done = reduce(lambda a, c: a | c, [c for c, _, _ in checks])
        price = reduce(lambda tail, c: F.when(c[0], c[1]).otherwise(tail), reversed(checks), none_d)
        reason = reduce(lambda tail, c: F.when(c[0], F.lit(c[2])).otherwise(tail), reversed(checks), none_s)
        moved = F.struct(
            done.alias("done"), none_l.alias("into"), live.alias("live"), best.alias("best"), mfe.alias("mfe"), mae.alias("mae"),
            F.when(done, b["pos"]).alias("rn"), price.alias("price"), reason.alias("reason"), b["last"].alias("last"),
        ).cast(_STATE)
        return F.when(frozen, s).otherwise(moved)

    # A block matters if a level is touched in it, the trailing stop starts in
    # it, or a running one is met: by the block's own steepest move or by its
    # extreme against the best price so far.
    falls = F.when(long, (b["fall"] <= 1 - trail) | (b["lo"] <= s["best"] * (1 - trail))).otherwise(
        (b["rise"] >= 1 + trail) | (b["hi"] >= s["best"] * (1 + trail))
    )
    timed = F.coalesce((b["pos"] + 1) * F.lit(span) > F.col("last_rn"), F.lit(False))
    matters = stop | target | starts | F.coalesce(s["live"] & falls, F.lit(False)) | timed
    skipped = F.struct(
        F.lit(False).alias("done"), none_l.alias("into"), s["live"].alias("live"), F.when(s["live"], extreme).alias("best"),
        mfe.alias("mfe"), mae.alias("mae"), none_l.alias("rn"), none_d.alias("price"), none_s.alias("reason"), b["last"].alias("last"),
    ).cast(_STATE)
    found = s.withField("into", b["pos"])
    return F.when(frozen, s).when(matters, found.cast(_STATE)).otherwise(skipped)


def first_exit(
    entries: DataFrame,
    bars: DataFrame,
    keys: Sequence[str] = KEYS,
    hi: str = "close",
    lo: str = "close",
    last: str = "close",
    stop_first: bool = True,
    radix: int = RADIX,
) -> DataFrame:
    """Where each position ends, for any number of positions and any distance.

    `entries` holds keys, `n_rows`, `entry_rn` (first bar seen is the next
    one), direction, entry_price, stop, target, activation, trail and last_rn,
    any of the last five NULL. Adds exit_rn, exit_price, exit_reason, mfe and
    mae; positions still open after the last bar have NULL exits and carry
    that bar's price in `last_price`.

    Bars are stored in blocks, blocks in blocks of blocks. A position scans
    the bars of its own block and the next, then climbs: whole blocks that
    cannot end it are skipped by their summary, and it comes down again into
    the first one that can. Distance d costs about log(d) narrow joins; the
    loop ends when no position is left, usually after one or two rounds.
    """
    nodes = [_children(bars, keys, hi, lo, last, radix)]
    start = F.struct(
        F.lit(False).alias("done"), F.lit(None).cast("bigint").alias("into"), F.lit(False).alias("live"),
        F.lit(None).cast("double").alias("best"), F.lit(0.0).alias("mfe"), F.lit(0.0).alias("mae"),
        F.lit(None).cast("bigint").alias("rn"), F.lit(None).cast("double").alias("price"),
        F.lit(None).cast("string").alias("reason"), F.lit(None).cast("double").alias("last"),
    ).cast(_STATE)
    doubles = ("entry_price", "stop", "target", "activation", "trail")
    open_ = entries.withColumns({c: F.col(c).cast("double") for c in doubles}).withColumns(
        {"__s": start, "__level": F.lit(0), "__from": F.col("entry_rn") + 1}
    )
    open_ = open_.withColumn("node", F.expr(f"__from div {radix}"))
    ended: list[DataFrame] = []
    levels = [0]
    stored = False
    while True:
        if ended and 0 in levels and not stored:
            nodes[0], stored = cut(nodes[0]), True
        moved = []
        for level in levels:
            while len(nodes) <= level:
                nodes.append(cut(_summaries(nodes[-1], keys, radix, len(nodes) == 1)))
            span = radix ** (level + 1)
            here = open_.filter(F.col("__level") == level).join(nodes[level], [*keys, "node"], "left")
            seen = F.filter(F.coalesce("bars", F.array()), lambda b: b["pos"] >= F.col("__from"))
            here = here.withColumn("__s", F.aggregate(seen, F.col("__s"), lambda s, b: _step(s, b, radix**level, stop_first))).drop("bars")
            # Level 0 rows also cover the next block.
            covered = (F.col("node") + (2 if level == 0 else 1)) * span
            over = F.col("__s.done") | (F.col("__s.into").isNull() & (covered >= F.col("n_rows")))
            into = F.col("__s.into")
            next_pos = (F.col("node") + (2 if level == 0 else 1)).cast("bigint")
            here = here.withColumn("__over", over).withColumns(
                {
                    "__level": F.when(into.isNotNull(), level - 1).otherwise(level + 1),
                    "__from": F.when(into.isNotNull(), into * radix).otherwise(next_pos),
                    "node": F.when(into.isNotNull(), into).otherwise(F.floor(next_pos / radix)),
                    "__s": F.col("__s").withField("into", F.lit(None).cast("bigint")).cast(_STATE),
                }
            )
            moved.append(here)
        stepped = cut(reduce(DataFrame.unionByName, moved))
        ended.append(stepped.filter("__over"))
        open_ = stepped.filter("NOT __over").drop("__over")
        # At most one entry per tree level.
        levels = sorted(r[0] for r in open_.select("__level").distinct().collect())
        if not levels:
            break
    out = reduce(DataFrame.unionByName, [e.drop("__over") for e in ended])
    return out.withColumns(
        {
            "exit_rn": F.col("__s.rn"),
            "exit_price": F.col("__s.price"),
            "exit_reason": F.col("__s.reason"),
            "mfe": F.col("__s.mfe"),
            "mae": F.col("__s.mae"),
            "last_price": F.col("__s.last"),
        }
    ).drop("__s", "__level", "__from", "node")


CHAIN_ROWS = 1 << 20


def _follow(pos: np.ndarray, free: np.ndarray) -> np.ndarray:
    """For each entry: the bar from which the series is free once its chain leaves this chunk."""
    nxt = np.searchsorted(pos, free)
    out = free.copy()
    for i in range(len(pos) - 1, -1, -1):
        if nxt[i] < len(pos):
            out[i] = out[nxt[i]]
    return out


def _after(upto: np.ndarray, out: np.ndarray, state: np.ndarray) -> np.ndarray:
    """When the series is free after a chunk it reaches at `state`; unchanged beyond its last entry."""
    i = np.searchsorted(upto, state)
    return np.where(i < len(upto), out[np.minimum(i, len(upto) - 1)], state)


def _arrivals(summaries: DataFrame, keys: Sequence[str], key_schema: str) -> DataFrame:
    """For each chunk, the bar from which the series is free when it reaches the chunk.

    A group never holds more than the answers of two neighbours.
    """
    node = f"{key_schema}, __chunk bigint, upto array<bigint>, out array<bigint>"
    arrival = f"{key_schema}, __chunk bigint, __arrive bigint"

    def pair(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__chunk")
        upto, out = np.asarray(pdf["upto"].iloc[0]), np.asarray(pdf["out"].iloc[0])
        if len(pdf) == 2:
            right, after = np.asarray(pdf["upto"].iloc[1]), np.asarray(pdf["out"].iloc[1])
            later = right > upto[-1]
            out = np.concatenate([_after(right, after, out), after[later]])
            upto = np.concatenate([upto, right[later]])
            last = np.append(out[1:] != out[:-1], True)
            upto, out = upto[last], out[last]
        head = {k: [pdf[k].iloc[0]] for k in keys}
        return pd.DataFrame({**head, "__chunk": [int(pdf["__chunk"].iloc[0]) // 2], "upto": [upto], "out": [out]})

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__chunk")
        state = np.int64(pdf["__arrive"].iloc[0])
        arrive = [state]
        if len(pdf) == 2:
            arrive.append(_after(np.asarray(pdf["upto"].iloc[0]), np.asarray(pdf["out"].iloc[0]), state))
        return pdf[[*keys, "__chunk"]].assign(__arrive=[int(x) for x in arrive])

    levels = [once(summaries)]
    most = levels[0].agg(F.max("__chunk")).first()[0] or 0
    parent = F.expr("__chunk div 2")
    for _ in range(int(most).bit_length()):
        grouped = levels[-1].withColumn("__parent", parent).groupBy(*keys, "__parent")
        levels.append(cut(grouped.applyInPandas(pair, node)))
    found = levels[-1].select(*keys, "__chunk", F.lit(0).cast("bigint").alias("__arrive"))
    for level in reversed(levels[:-1]):
        above = found.withColumnRenamed("__chunk", "__parent")
        found = level.withColumn("__parent", parent).join(above, [*keys, "__parent"]).groupBy(*keys, "__parent").applyInPandas(down, arrival)
    return found


def chain(
    entries: DataFrame,
    pos: str,
    free: str,
    keys: Sequence[str] = KEYS,
    chunk_rows: int = CHAIN_ROWS,
) -> DataFrame:
    """Greedy choice: take the first entry, then the first one at or after its `free`, and so on.

    A chunk answers, for every bar at which the series may become free inside
    it, when it is free again after the chunk; runs of equal answers are
    stored once. Neighbouring chunks' answers are put together in pairs up a
    tree, the bar at which the series reaches each chunk comes down it, and
    each chunk then marks its own entries.
    """
    entries = once(entries)
    chunked = entries.withColumn("__chunk", F.expr(f"`{pos}` div {chunk_rows}"))
    key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entries.select(*keys).schema.fields)

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        p, out = pdf[pos].to_numpy(), _follow(pdf[pos].to_numpy(), pdf[free].to_numpy())
        last_of_run = np.append(out[1:] != out[:-1], True)
        head = {k: [pdf[k].iloc[0]] for k in (*keys, "__chunk")}
        return pd.DataFrame({**head, "upto": [p[last_of_run]], "out": [out[last_of_run]]})

    def mark(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values(pos)
        p, f = batch[pos].to_numpy(), batch[free].to_numpy()
        nxt = np.searchsorted(p, f)
        i, taken = int(np.searchsorted(p, batch["__arrive"].iloc[0])), []
        while i < len(p):
            taken.append(i)
            i = int(nxt[i])
        return batch.iloc[taken][[*keys, pos]]

    slim = chunked.select(*keys, "__chunk", F.col(pos).cast("bigint").alias(pos), F.col(free).cast("bigint").alias(free))
    summaries = slim.groupBy(*keys, "__chunk").applyInPandas(
        summarise, f"{key_schema}, __chunk bigint, upto array<bigint>, out array<bigint>"
    )
    arrivals = _arrivals(summaries, keys, key_schema)
    taken = (
        slim.join(arrivals, [*keys, "__chunk"])
        .groupBy(*keys, "__chunk")
        .applyInPandas(mark, f"{key_schema}, {pos} bigint")
    )
    return entries.join(taken, [*keys, pos], "left_semi")
