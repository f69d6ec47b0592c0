import numpy as np
import pytest
from pyspark.sql import types as T

from tickloom.llm import topk

VECTORS = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("rank", T.StringType())])


def best(rows, k=5, every=50):
    good = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, q in dict((i, q) for i, q in good if i % every == 0).items():
        scored = sorted((-sum(a * b for a, b in zip(q, v, strict=False)), j) for j, v in good if j != i)
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block_rows", [65536, 70])
def test_best_rows_are_those_of_all_pairs(spark, monkeypatch, block_rows):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(2)
    rows = [(i, np.float32(rng.normal(0, 0.3, 8)).tolist()) for i in range(260)]
    # Ties, equal vectors, short and empty vectors, and rows that take no part.
    rows += [(300 + i, rows[3][1]) for i in range(20)] + [(400, [0.5]), (401, []), (450, [0.0] * 8), (500, None), (501, [None] * 8), (550, [float("nan")] * 8), (551, [float("inf")] * 8), (None, rows[0][1])]
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], VECTORS).repartition(3)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_matches(table).collect()) == best(rows)


def test_few_rows_and_none(spark):
    table = spark.createDataFrame([(0, [1.0, -1.0], "x"), (50, [0.5, 0.5], "x")], VECTORS)
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_matches(table).collect()) == [(0, 1, 50, 0), (50, 1, 0, 0)]
    assert topk.top_matches(table.where("vec_id < 0")).collect() == []


def test_large_components(spark):
    rows = [(0, [1e6, 1.0]), (1, [3e5, -2.0]), (2, [-1e7, 0.0]), (50, [3e38, 3e38])]
    found = {(r.query_id, r.vec_id): r.score for r in topk.top_matches(spark.createDataFrame([(i, v, "") for i, v in rows], VECTORS)).collect()}
    assert found[0, 1] == 256_000_000 * 76_800_000 + 256 * -512
    assert found[0, 2] == 256_000_000 * -2_560_000_000
    assert found[50, 0] == topk.LONGS[1]


def test_sums_of_slices():
    rng = np.random.default_rng(3)
    vectors, query = rng.integers(-300, 300, (130, 5)), rng.integers(-9, 9, 5)
    index = topk.SlicedIndex(np.arange(130), vectors)
    total = sum((np.unpackbits(s.view(np.uint8), bitorder="little")[:130].astype(np.int64) << k for k, s in enumerate(index.sums(query))), np.zeros(130, np.int64))
    shift = vectors @ query - total
    assert (shift == shift[0]).all()
