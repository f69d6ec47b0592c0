"""Entries of many series that compete for a bounded number of places.

Whether an entry gets in depends on who is in at that time, which depends on the entries
before it, over all series. What is carried along is small, though: the trades that are
open. So the entries are put in order of time and cut into chunks of equal number. All
chunks run at once, each from the state its predecessor left in the round before, at first
an empty one; those that are handed another state run again. An early choice seldom
matters for long, so most chunks end as they did and hand on what they handed on before.
The rounds end when no chunk is handed anything new, which is the result of one walk over
all entries, at the latest after as many rounds as there are chunks.

A chunk's rows are one task's memory; the driver holds one state of open trades per chunk.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.plans.storage import cut

CHUNK_ROWS = 1 << 17
#: Later than any time in microseconds.
NEVER = (1 << 63) - 1

_OPEN = "array<struct<gone:bigint,free:bigint,who:string,team:string>>"


def _walk(rows: pd.DataFrame, start: tuple[str | None, list[tuple]], max_open: int, max_related: int) -> tuple[list[int], str | None, list[tuple]]:
    """Numbers of the rows that get in, the last portfolio, and what is open in it at the end."""
    portfolio, open_ = start
    took = []
    columns = [rows[c].tolist() for c in ("portfolio", "who", "a", "gone", "free", "team", "peers")]
    for i, (p, who, a, gone, free, team, peers) in enumerate(zip(*columns, strict=True)):
        if p != portfolio:
            portfolio, open_ = p, []
        open_ = [o for o in open_ if o[0] > a or o[1] > a]
        held = [o for o in open_ if o[0] > a]
        if len(held) >= max_open or any(o[2] == who for o in open_):
            continue
        if team is not None and sum(o[3] == team for o in held) >= max_related:
            continue
        if peers is not None and sum(o[2] in peers for o in held) >= max_related:
            continue
        open_.append((gone, free, who, team))
        took.append(i)
    return took, portfolio, sorted(open_, key=repr)


def admit(entries: DataFrame, max_open: int, max_related: int, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(portfolio, who, a) of the entries that get in.

    `entries` has portfolio and who as strings, the time `a` in microseconds, `gone`, the time
    from which the place is free again, `free`, the time from which `who` may enter again, and
    `team` (string) and `peers` (array of who), either of them NULL. An entry gets in if fewer than
    `max_open` are in, `who` may enter, and fewer than `max_related` of its team and
    of its peers are in. Entries of equal time go in the order of `who`; (portfolio, who, a) is unique.
    """
    order = ["portfolio", "a", "who"]
    slim = cut(entries.select(*order, "gone", "free", "team", "peers"))
    n_chunks = max(1, -(-slim.count() // chunk_rows))
    placed = cut(slim.repartitionByRange(n_chunks, *order).withColumn("chunk", F.spark_partition_id()))
    held: dict[int, tuple[str | None, list[tuple]]] = {}

    def walk(rows: pd.DataFrame, held: dict) -> tuple[pd.DataFrame, int, tuple]:
        rows, chunk = _plain(rows.sort_values(order)), int(rows["chunk"].iloc[0])
        return rows, chunk, _walk(rows, held.get(chunk, (None, [])), max_open, max_related)

    def left_open(held: dict) -> DataFrame:
        def leave(rows: pd.DataFrame) -> pd.DataFrame:
            _, chunk, (_, portfolio, open_) = walk(rows, held)
            left = [dict(zip(("gone", "free", "who", "team"), o, strict=True)) for o in open_]
            return pd.DataFrame({"chunk": [chunk], "portfolio": [portfolio], "left": [left]})

        own = placed if not held else placed.where(F.col("chunk").isin(todo))
        return own.groupBy("chunk").applyInPandas(leave, f"chunk int, portfolio string, left {_OPEN}")

    def take(rows: pd.DataFrame) -> pd.DataFrame:
        rows, _, (took, *_) = walk(rows, held)
        return rows.iloc[took][order]

    todo: list[int] = []
    filled: list[int] = []
    while not filled or todo:
        left = left_open(dict(held)).collect()
        if not left:
            break
        filled = filled or sorted(r.chunk for r in left)
        following = dict(zip(filled, filled[1:], strict=False))
        todo = []
        for r in left:
            nxt = following.get(r.chunk)
            state = (r.portfolio, [tuple(o) for o in r.left])
            # A chunk that has run from an empty state has run from one of no open trades.
            if nxt is not None and state[1] != held.get(nxt, (None, []))[1]:
                held[nxt] = state
                todo.append(nxt)
    types = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    return placed.groupBy("chunk").applyInPandas(take, ", ".join(f"{c} {types[c]}" for c in order))


def _plain(rows: pd.DataFrame) -> pd.DataFrame:
    """Missing teams and peers as None."""
    return rows.assign(
        team=[None if t is None or t != t else t for t in rows["team"]],
        peers=[None if not isinstance(p, (list, np.ndarray)) else frozenset(p) for p in rows["peers"]],
    )
