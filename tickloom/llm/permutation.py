"""Approximate nearest neighbours by inner product, on a permutation index.

* Pivots are vectors of a bounded sample. A vector is represented by its `prefix` nearest pivots,
  in the order of nearness (largest inner product of directions).
* A shard of vectors posts them in pivot inverted files: for every pivot, the rows that have it in
  their prefix, and its position there. A query's files give its footrule distance to all rows of
  the shard: the sum over pivots of the difference of positions, pivots outside a prefix counting as
  the position after it. Rows are ranked by it, and those up to the distance `within`, `floor` rows
  at least, are reranked by the exact inner product.
* Shards hold whole posting lists of first pivots: rows are dealt by their nearest pivot, pivots that are
  near each other to the same shard, and a pivot of too many rows to several. A query visits the shards of
  its nearest `visits` pivots.
* `visits` and `within` are measured, so that recall doesn't depend on what the vectors are like: for `PROBES`
  queries the true neighbours are found among all rows, and both are the least numbers that reach the share
  `reach` of them. On clustered vectors that is a few pivots, on vectors without any structure most of them.

The number of pivots grows with the square root of the rows, so a shard's files stay as short as its rows
are few; pivots take `PIVOT_BYTES` at most. Only pivots, their counts and the probes' neighbours reach the driver.

Equal vectors are searched once: a vector keeps its k + 1 least ids, which is all that any result can
hold of them, and queries get their vector's results without themselves. So a vector that a third of all rows
have costs one row, and its queries only their own results.

Vectors that are null, zero or hold null or non-finite components take no part, nor do null ids. Shorter
vectors count as padded with zeros. Rows with the query's own id are never its candidates. An id that
occurs with several vectors may be found with each of them; such queries are ranked by vector. A row
repeated with the same id and vector counts once.
Other columns are not read. Equal scores rank by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.plans.storage import cut

SHARD_ROWS = 8192
PIVOT_BYTES = 16 << 20
PROBES = 128


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of a list column as rows of doubles, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    out = np.zeros((len(column), dims))
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out


def directions(vectors: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares neither overflow nor vanish.
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True, initial=np.finfo(float).tiny)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def prefixes(vectors: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """Each vector's nearest pivots in order; of equally near ones the first."""
    return np.argsort(-(directions(vectors) @ pivots.T), axis=1, kind="stable")[:, :length].astype(np.int32)


class Files:
    """Pivot inverted files over the rows of a shard."""

    def __init__(self, permutations: np.ndarray, n_pivots: int):
        self.n, self.length = permutations.shape
        posted = permutations.ravel()
        order = np.argsort(posted, kind="stable")
        self.rows = (order // self.length).astype(np.int32)
        self.positions = (order % self.length).astype(np.int32)
        self.ends = np.concatenate([[0], np.cumsum(np.bincount(posted, minlength=n_pivots))])

    def footrule(self, permutation: np.ndarray) -> np.ndarray:
        """The distance of a query's prefix to all rows."""
        # Prefixes without a common pivot are length * (length + 1) apart; each common one brings them nearer.
        distance = np.full(self.n, self.length * (self.length + 1), np.int32)
        for position, pivot in enumerate(permutation.tolist()):
            a, z = self.ends[pivot], self.ends[pivot + 1]
            own = self.positions[a:z]
            # A row occurs at most once in a file.
            distance[self.rows[a:z]] -= 2 * self.length - position - own - np.abs(own - position)
        return distance


def _distinct(vectors: DataFrame, id_column: str, vector: str) -> DataFrame:
    """key, id, v of the rows that take part."""
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))
    # Zeros of either sign are equal, and so are vectors that differ in zeros at the end.
    plain = F.transform("v", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
    used = F.aggregate(F.transform(plain, lambda x, i: F.when(x != 0, i + 1).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
    rows = rows.withColumn("v", F.slice(plain, 1, used))
    return rows.withColumn("key", F.md5(F.to_json("v").cast("binary")))


def _pivots(distinct: DataFrame, n: int, dims: int, sample: int) -> np.ndarray:
    """Directions of pivots, near ones next to each other, from the `sample` rows of least hash."""
    count = max(1, min(int(n**0.5), PIVOT_BYTES // (8 * max(dims, 1)), sample))
    rows = distinct.select("v", F.xxhash64("key").alias("h")).orderBy("h").limit(count).collect()
    out = np.zeros((len(rows), dims))
    for i, r in enumerate(rows):
        out[i, : len(r.v)] = r.v
    out = directions(out) if len(out) else out
    # A chain of nearest ones, so that neighbouring numbers are near pivots.
    chain, free = [0] if len(out) else [], np.ones(len(out), bool)
    while len(chain) < len(out):
        free[chain[-1]] = False
        chain.append(int(np.where(free, out @ out[chain[-1]], -2).argmax()))
    return out[chain]


def _merge(found: DataFrame, by: str, k: int) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class Index:
    """Stored distinct vectors with their shards, and the pivots."""

    def __init__(self, rows: DataFrame, pivots: np.ndarray, dims: int, shards: dict[int, list[int]], prefix: int):
        self.rows, self.pivots, self.dims, self.shards, self.prefix = rows, pivots, dims, shards, prefix


def build(vectors: DataFrame, k: int = 20, prefix: int = 32, sample: int = 1 << 16, shard_rows: int = SHARD_ROWS, id_column: str = "vec_id", vector: str = "embedding") -> Index:
    """Index all rows. `sample` bounds the rows that pivots are taken from."""
    rows = _distinct(vectors, id_column, vector)
    # Repeated rows count once. Of a vector's ids every partition keeps k + 1 before the shuffle.
    rows = rows.groupBy("key", "id").agg(F.first("v").alias("v"))
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("place") <= k + 1)
    folded = cut(ranked.groupBy("key").agg(F.first("v").alias("v"), F.array_sort(F.collect_list("id")).alias("ids")))
    n, dims = folded.agg(F.count("*"), F.max(F.size("v"))).first()
    dims = dims or 0
    pivots = _pivots(folded, n, dims, sample)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = prefixes(matrix(batch.column(1), dims), pivots, 1)[:, 0] if batch.num_rows else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.int32())], names=["key", "v", "ids", "pivot"])

    dealt = cut(folded.select("key", "v", "ids").mapInArrow(deal, "key string, v array<double>, ids array<long>, pivot int"))
    counts = {r.pivot: r.n for r in dealt.groupBy("pivot").agg(F.count("*").alias("n")).collect()}
    shards: dict[int, list[int]] = {}
    number, room = -1, 0
    for pivot in sorted(counts):
        parts = -(-counts[pivot] // shard_rows)
        if parts == 1 and counts[pivot] <= room:
            shards[pivot], room = [number], room - counts[pivot]
            continue
        shards[pivot] = list(range(number + 1, number + 1 + parts))
        number, room = number + parts, shard_rows - counts[pivot] if parts == 1 else 0
    return Index(dealt, pivots, dims, shards, min(prefix, max(1, len(pivots))))


def true_neighbours(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """query, id, score, prefix: exact results for few queries, given as (query, v); all rows are read."""
    asked = [(r.query, r.v) for r in queries.collect()]
    wanted = np.zeros((len(asked), index.dims))
    for i, (_, v) in enumerate(asked):
        wanted[i, : len(v)] = v
    numbers, dims, pivots, length = [q for q, _ in asked], index.dims, index.pivots, index.prefix

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not numbers:
                continue
            rows = matrix(batch.column(0), dims)
            score = wanted @ rows.T
            top = np.argpartition(-score, min(k, score.shape[1] - 1), axis=1)[:, : k + 1]
            row = np.repeat(np.arange(len(numbers)), top.shape[1])
            top = top.ravel()
            # A vector counts for each of its ids, as it does in results.
            lists = batch.column(1).to_pylist()
            n = [len(lists[i]) for i in top]
            ids = np.array([i for t in top for i in lists[t]], np.int64)
            row, top = np.repeat(row, n), np.repeat(top, n)
            keep = ids != np.array(numbers, np.int64)[row]
            row, top, ids = row[keep], top[keep], ids[keep]
            found = pa.array(prefixes(rows[top], pivots, length).tolist(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict({"query": pa.array(np.array(numbers, np.int64)[row]), "id": pa.array(ids), "score": pa.array(score[row, top]), "prefix": found})

    found = index.rows.select("v", "ids").mapInArrow(best, "query long, id long, score double, prefix array<int>")
    return _merge(found, "query", k)


def measured(index: Index, every: int, k: int, reach: float = 0.98, probes: int = PROBES) -> tuple[int, int]:
    """The least number of nearest pivots, and the least footrule distance, that hold the share `reach` of some queries' true neighbours."""
    if not len(index.pivots):
        return 0, 0
    asking = index.rows.select(F.get(F.filter("ids", lambda x: x % every == 0), F.lit(0)).alias("query"), "v", F.xxhash64("key").alias("h")).where("query IS NOT NULL")
    probe = cut(asking.orderBy("h").limit(probes).select("query", "v"))
    orders = {}
    for r in probe.collect():
        v = np.zeros((1, index.dims))
        v[0, : len(r.v)] = r.v
        orders[r.query] = prefixes(v, index.pivots, len(index.pivots))[0]
    places, distances = [], []
    for r in true_neighbours(index, probe, k).select("query", "prefix").collect():
        order = orders[r.query]
        places.append(int(np.flatnonzero(order == r.prefix[0])[0]) + 1)
        distances.append(int(Files(np.array([r.prefix], np.int32), len(order)).footrule(order[: index.prefix])[0]))
    if not places:
        return len(index.pivots), 0
    return int(np.quantile(places, reach, method="higher")), int(np.quantile(distances, reach, method="higher"))


CELL = "shard int, kind int, key string, v array<double>, ids array<long>"


def nearest(index: Index, asked: DataFrame, visits: int, within: int, k: int = 20, floor: int = 128) -> DataFrame:
    """key, best: for each vector whose key is in `asked`, the k + 1 nearest rows found, as (rank, id, score)."""
    pivots, dims, prefix, shards = index.pivots, index.dims, index.prefix, index.shards

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = prefixes(matrix(batch.column(1), dims), pivots, max(visits, 1)) if batch.num_rows else np.zeros((0, 1), np.int32)
            goals = [sorted({s for p in row for s in shards.get(p, ())}) for row in order.tolist()]
            row = np.repeat(np.arange(len(goals)), [len(g) for g in goals])
            out = batch.take(pa.array(row, pa.int64()))
            none = pa.nulls(len(row), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([s for g in goals for s in g], pa.int32()), pa.array(np.ones(len(row), np.int32)), *out.columns, none], names=["shard", "kind", "key", "v", "ids"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shards[p] for p in batch.column(3).to_pylist()]
            # Rows of a pivot with several shards are dealt by their key.
            goal = [s[int(key[:12], 16) % len(s)] for s, key in zip(own, batch.column(0).to_pylist(), strict=True)]
            kind = pa.array(np.zeros(batch.num_rows, np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(goal, pa.int32()), kind, *batch.columns[:3]], names=["shard", "kind", "key", "v", "ids"])

    rows = index.rows.select("key", "v", "ids", "pivot")
    posted = rows.mapInArrow(post, CELL)
    asking = rows.join(asked, "key", "left_semi").select("key", "v").mapInArrow(ask, CELL)
    cells = posted.unionByName(asking)
    n_shards = 1 + max((max(s) for s in shards.values()), default=0)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, held = None, [], None
        for batch in batches:
            numbers = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), batch.num_rows]
            for a, z in zip(cuts, cuts[1:], strict=False):
                if a == z:
                    continue
                if numbers[a] != shard:
                    shard, parts, held = numbers[a], [], None
                piece = batch.slice(a, z - a)
                asks = int(np.searchsorted(piece.column(1).to_numpy(), 1))
                if asks:
                    parts.append(piece.slice(0, asks))
                if asks == len(piece) or not parts:
                    continue
                if held is None:
                    table = pa.Table.from_batches(parts)
                    own = matrix(table["v"], dims)
                    held = own, Files(prefixes(own, pivots, prefix), len(pivots)), table["ids"].combine_chunks()
                    parts = [parts[0]]
                yield _answers(held, piece.slice(asks), pivots, dims, prefix, k, within, floor)

    dealt = cells.repartition(max(n_shards, 1), "shard").sortWithinPartitions("shard", "kind")
    found = dealt.mapInArrow(search, "key string, id long, score double")
    best = _merge(found, "key", k + 1).groupBy("key").agg(F.collect_list(F.struct("rank", "id", "score")).alias("best"))
    return cut(best)


def _answers(held: tuple, asked: pa.RecordBatch, pivots: np.ndarray, dims: int, prefix: int, k: int, within: int, floor: int) -> pa.RecordBatch:
    """Each query's k + 1 best ids of a shard."""
    own, files, ids = held
    vectors = matrix(asked.column(3), dims)
    permutations = prefixes(vectors, pivots, prefix)
    sizes = np.diff(ids.offsets.to_numpy())
    starts, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
    keys, out_ids, scores = [], [], []
    for key, v, permutation in zip(asked.column(2).to_pylist(), vectors, permutations, strict=True):
        distance = files.footrule(permutation)
        n = min(len(own), max(floor, k + 1, int((distance <= within).sum())))
        near = np.argpartition(distance, n - 1)[:n] if n < len(own) else np.arange(len(own))
        score = own[near] @ v
        if len(near) > k + 1:
            # Rows level with the last one stay, so that ties go by id.
            least = np.partition(score, len(score) - k - 1)[len(score) - k - 1]
            best = np.flatnonzero(score >= least)
            near, score = near[best], score[best]
        row = np.repeat(np.arange(len(near)), sizes[near])
        listed = np.concatenate([flat[starts[i] : starts[i] + sizes[i]] for i in near])
        order = np.lexsort([listed, -score[row]])[: k + 1]
        keys += [key] * len(order)
        out_ids.append(listed[order])
        scores.append(score[row][order])
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(np.concatenate(out_ids)), pa.array(np.concatenate(scores))], names=["key", "id", "score"])


def search(vectors: DataFrame, every: int = 20, k: int = 20, prefix: int = 32, reach: float = 0.98, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each row whose id is divisible by `every`."""
    index = build(vectors, k, prefix, id_column=id_column, vector=vector)
    visits, within = measured(index, every, k, reach)
    queries = _distinct(vectors, id_column, vector).where(F.col("id") % every == 0).select("key", F.col("id").alias("query_id")).distinct()
    best = nearest(index, queries.select("key").distinct(), visits, within, k)
    own = F.slice(F.filter(F.array_sort("best"), lambda x: x["id"] != F.col("query_id")), 1, k)
    found = queries.join(best, "key").select("query_id", F.posexplode(own).alias("place", "row"))
    return found.select("query_id", (F.col("place") + 1).alias("rank"), F.col("row.id").alias("vec_id"), F.col("row.score").alias("score"))


def op11_permutation_index(spark: SparkSession, folder: str) -> DataFrame:
    return search(spark.read.parquet(f"{folder}/embeddings.parquet"))
