"""Exact best matches by integer inner product, on a bit-sliced index.

* Attributes are quantised to floor(scale * x). A block of rows keeps every attribute as
  bitmaps over its rows, one for each bit of the value above the attribute's least one.
* A query's score is a sum of slices with the weights of the query's bits. Slices of equal
  weight are added by carry-save adders: three bitmaps become a sum and a carry, with bitmap
  arithmetic only. For a negative query attribute the complements of the slices are added.
* The best rows of a block are selected from the most significant slice of the sum downward:
  rows with the bit set stay while there are enough of them. Rows still level at the last
  slice are the boundary; their scores are equal, so the least ids are taken.

All queries meet all rows, in blocks of rows; a block's queries stream past its index. At
most k rows per query leave a block.

Vectors that are null or hold null or non-finite components take no part, nor do null ids.
Shorter vectors count as padded with zeros. Rows with the query's own id are never its
candidates, and repeated queries count once. Rows of equal score and id, which only repeated
rows can be, rank one after another. Scores beyond 64 bits are cut to the largest long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 65536
#: Blocks are searched by this many tasks, each for its share of the queries.
SHARES = 4
LIMIT = 1 << 24
LONGS = (-(1 << 63), (1 << 63) - 1)


class SlicedIndex:
    """Rows in ascending order of id, each attribute as one bitmap per bit."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        n, self.dims = self.vectors.shape
        self.words = -(-n // 64)
        self.least = self.vectors.min(axis=0)
        above = self.vectors - self.least
        self.bits = max(1, int(above.max()).bit_length()) if above.size else 1
        pad = np.zeros((self.words * 64 - n, self.dims), above.dtype)
        above = np.ascontiguousarray(np.concatenate([above, pad]).T)
        slices = [np.packbits((above >> b) & 1 == 1, axis=1, bitorder="little").view(np.uint64) for b in range(self.bits)]
        # Row d * bits + b is bit b of attribute d; complements follow.
        slices = np.stack(slices, axis=1).reshape(self.dims * self.bits, self.words)
        self.slices = np.concatenate([slices, ~slices])
        rows = np.zeros(self.words * 64, bool)
        rows[:n] = True
        self.rows = np.packbits(rows, bitorder="little").view(np.uint64)

    def _weights(self, query: np.ndarray) -> list[list[int]]:
        """The slices that count 1, 2, 4, ... in the query's sum."""
        out: list[list[int]] = [[] for _ in range(self.bits + int(np.abs(query).max(initial=0)).bit_length())]
        for d, q in enumerate(query.tolist()):
            first = d * self.bits + (self.dims * self.bits if q < 0 else 0)
            size, b = abs(q), 0
            while size:
                if size & 1:
                    for k in range(self.bits):
                        out[b + k].append(first + k)
                size >>= 1
                b += 1
        return out

    def sums(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices of every row's sum, the least significant first."""
        weights, carried, out = self._weights(query), [], []
        while len(out) < len(weights) or carried:
            own = weights[len(out)] if len(out) < len(weights) else []
            pool = np.concatenate([self.slices[own], *carried]) if carried else self.slices[own]
            carried = []
            while len(pool) > 2:
                k = len(pool) // 3
                a, b, c = pool[:k], pool[k : 2 * k], pool[2 * k : 3 * k]
                part = a ^ b
                carried.append((a & b) | (part & c))
                pool = np.concatenate([part ^ c, pool[3 * k :]])
            if len(pool) == 2:
                carried.append(pool[:1] & pool[1:])
                pool = pool[:1] ^ pool[1:]
            out.append(pool[0] if len(pool) else np.zeros(self.words, np.uint64))
        return out

    def best(self, number: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """Ids and scores of the k best rows, other than those of the query's own id."""
        level = self.rows.copy()
        a, z = np.searchsorted(self.ids, [number, number + 1]) if number < LONGS[1] else (np.searchsorted(self.ids, number), len(self.ids))
        for i in range(a, z):
            level[i // 64] &= ~(np.uint64(1) << np.uint64(i % 64))
        chosen = np.zeros(self.words, np.uint64)
        n_chosen, n_level = 0, int(np.bitwise_count(level).sum())
        for bits in reversed(self.sums(query)) if n_level > k else ():
            high = level & bits
            n_high = int(np.bitwise_count(high).sum())
            if n_chosen + n_high > k:
                level, n_level = high, n_high
                continue
            chosen, n_chosen = chosen | high, n_chosen + n_high
            level = level & ~bits
            if n_chosen == k:
                break
        rows = np.concatenate([_places(chosen), _places(level)[: k - n_chosen]])
        return [(int(self.ids[i]), int(s)) for i, s in zip(rows, self.vectors[rows] @ query, strict=True)]


def _places(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


class _Wide:
    """Blocks whose attributes are too large for slices: whole numbers of any size."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors, self.dims = ids, vectors, vectors.shape[1]

    def best(self, number: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        scores = [(sum(int(a) * int(b) for a, b in zip(v, query, strict=True)), i) for v, i in zip(self.vectors, self.ids.tolist(), strict=True) if i != number]
        return [(i, max(LONGS[0], min(LONGS[1], s))) for s, i in sorted(scores, key=lambda x: (-x[0], x[1]))[:k]]


def _matrix(rows: list[list[float]], dims: int, scale: float) -> np.ndarray:
    out = np.zeros((len(rows), dims))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    out = np.floor(scale * out)
    if np.abs(out).max(initial=0) < LIMIT:
        return out.astype(np.int64)
    return np.array([[int(x) if np.isfinite(x) else (LONGS[1] if x > 0 else LONGS[0]) for x in r] for r in out], object).reshape(len(rows), dims)


def top_matches(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is divisible by `every`."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite)
    n_blocks = max(1, -(-vectors.count() // BLOCK_ROWS))
    shares = F.sequence(F.lit(0), F.lit(SHARES - 1))
    stored = rows.select(F.pmod(F.xxhash64("id", "v"), F.lit(n_blocks)).alias("block"), F.explode(shares).alias("share"), F.lit(0).alias("asks"), "id", "v")
    asked = rows.where(F.col("id") % every == 0).dropDuplicates(["id", "v"])
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<long>")).alias("block"), F.pmod(F.xxhash64("id"), F.lit(SHARES)).cast("int").alias("share"), F.lit(1).alias("asks"), "id", "v")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, held, index = None, [], [], None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if (row["block"], row["share"]) != cell:
                    cell, ids, held, index = (row["block"], row["share"]), [], [], None
                if not row["asks"]:
                    ids.append(row["id"])
                    held.append(row["v"])
                    continue
                if not ids:
                    continue
                if index is None or len(row["v"]) > index.dims:
                    matrix = _matrix(held, max(len(row["v"]), max(map(len, held))), scale)
                    index = (_Wide if matrix.dtype == object else SlicedIndex)(np.array(ids, np.int64), matrix)
                query = _matrix([row["v"]], index.dims, scale)[0]
                use = index if query.dtype != object else _Wide(index.ids, index.vectors)
                out += [(row["id"], *x) for x in use.best(row["id"], query, k)]
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    cells = stored.unionByName(asked).repartition(n_blocks * SHARES, "block", "share").sortWithinPartitions("block", "share", "asks")
    found = cells.mapInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(spark: SparkSession, folder: str) -> DataFrame:
    return top_matches(spark.read.parquet(f"{folder}/embeddings.parquet"))


SQL = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
