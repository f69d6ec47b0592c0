import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import permutation


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)


def by_hand(rows, every=20, k=20):
    """The exact k nearest of each query, as {(query, rank, id)} and scores."""
    rows = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    dims = max((len(v) for _, v in rows), default=0)
    unique = {(i, tuple(np.float32(x) for x in v)) for i, v in rows}
    ids = np.array([i for i, _ in unique])
    m = np.array([[*map(float, v), *[0.0] * (dims - len(v))] for _, v in unique])
    out = {}
    for q in sorted({i for i, _ in unique if i % every == 0}):
        score = m @ m[ids == q][0]
        order = [j for j in np.lexsort([ids, -score]) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def results(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        own = out.setdefault(r.query_id, [])
        own.append((r.vec_id, r.score))
        assert r["rank"] == len(own)
    return out


def recall(got, true):
    hits = sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in own}) for q, own in true.items())
    return hits / sum(len(own) for own in true.values())


def check_form(got, rows, k=20):
    """Scores are the exact products, in order, without the query."""
    vectors = {i: np.array(v, np.float32).astype(float) for i, v in rows}
    for q, own in got.items():
        assert q not in {i for i, _ in own} and len({i for i, _ in own}) == len(own)
        assert own == sorted(own, key=lambda x: (-x[1], x[0]))
        for i, s in own:
            assert s == pytest.approx(float(vectors[i] @ vectors[q]), rel=1e-12)


@pytest.mark.parametrize("kind", ["sphere", "clusters", "lengths"])
def test_recall(spark, shared, monkeypatch, kind):
    monkeypatch.setattr(permutation.build, "__defaults__", (20, 32, 1 << 16, 600, "vec_id", "embedding"))
    rng = np.random.default_rng(3)
    m = rng.normal(size=(6000, 32))
    if kind == "clusters":
        m = rng.normal(size=(40, 32))[rng.integers(0, 40, 6000)] + 0.15 * m
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    if kind == "lengths":
        m *= rng.uniform(0.7, 1.3, (6000, 1))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    got, true = results(permutation.search(table(spark, rows))), by_hand(rows)
    assert set(got) == set(true) and all(len(x) == 20 for x in got.values())
    check_form(got, rows)
    assert recall(got, true) >= 0.9


def test_clusters_need_few_visits(spark, shared):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(60, 16))[rng.integers(0, 60, 3000)] + 0.05 * rng.normal(size=(3000, 16))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m / np.linalg.norm(m, axis=1, keepdims=True))]
    index = permutation.build(table(spark, rows))
    assert permutation.measured(index, 20, 20)[0] < len(index.pivots) / 3


def test_small_tables_are_exact(spark, shared):
    rng = np.random.default_rng(5)
    rows = [(i * 5, [float(x) for x in rng.normal(size=6)]) for i in range(90)]
    got, true = results(permutation.search(table(spark, rows))), by_hand(rows)
    assert {q: [i for i, _ in own] for q, own in got.items()} == {q: [i for i, _ in own] for q, own in true.items()}


def test_odd_vectors(spark, shared):
    """Nulls, non-finite components, zeros, uneven lengths, repeats, extremes; fewer candidates than k."""
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0]), (40, [-0.0, 1.0, 0.0]), (60, None), (80, [nan, 1.0]), (100, [inf]), (120, [0.0, -0.0]), (140, []), (160, [None, 1.0]), (None, [1.0, 1.0])]
    rows += [(1, [3e38, 1e-38]), (2, [-1e-30]), (3, [1.0, 1.0]), (3, [1.0, 1.0])]
    got, true = results(permutation.search(table(spark, rows))), by_hand(rows)
    assert set(got) == {0, 20, 40}
    assert {q: [i for i, _ in own] for q, own in got.items()} == {q: [i for i, _ in own] for q, own in true.items()}


def test_copies(spark, shared):
    """A third of all rows have one vector: results go by id, and each query lacks only itself."""
    rng = np.random.default_rng(6)
    same = [float(x) for x in rng.normal(size=8)]
    rows = [(i, same) for i in range(0, 1500)] + [(1500 + i, [float(x) for x in 0.2 * rng.normal(size=8)]) for i in range(3000)]
    got, true = results(permutation.search(table(spark, rows))), by_hand(rows)
    for q in range(0, 1500, 20):
        assert [i for i, _ in got[q]] == [i for i, _ in true[q]] == [i for i in range(21) if i != q][:20]
    assert recall(got, true) >= 0.9


def test_hot_pivot_is_split(spark, shared):
    rng = np.random.default_rng(7)
    rows = [(i, [1.0, *(float(x) for x in 0.01 * rng.normal(size=3))]) for i in range(400)] + [(400 + i, [float(x) for x in rng.normal(size=4)]) for i in range(200)]
    index = permutation.build(table(spark, rows), shard_rows=50)
    sizes = {r.pivot: r["count"] for r in index.rows.groupBy("pivot").count().collect()}
    assert all(len(index.shards[p]) >= -(-n // 50) for p, n in sizes.items())


def test_empty_table(spark, shared):
    assert permutation.search(table(spark, [])).collect() == []


def test_no_query(spark, shared):
    assert permutation.search(table(spark, [(1, [1.0]), (2, [2.0])])).collect() == []


def test_clashing_names(spark, shared):
    rng = np.random.default_rng(8)
    plain = table(spark, [(i, [float(x) for x in rng.normal(size=4)]) for i in range(60)])
    names = ("id", "v", "key", "ids", "pivot", "shard", "kind", "rank", "score", "best", "query_id", "place")
    wide = plain.select("*", *(F.lit("x").alias(n) for n in names))
    assert results(permutation.search(wide)) == results(permutation.search(plain))


def test_footrule_from_files():
    rng = np.random.default_rng(9)
    length, n_pivots = 5, 12
    rows = np.array([rng.permutation(n_pivots)[:length] for _ in range(50)], np.int32)
    files = permutation.Files(rows, n_pivots)
    for own in rows[:10]:
        plain = []
        for other in rows.tolist():
            a = {p: i for i, p in enumerate(own.tolist())}
            b = {p: i for i, p in enumerate(other)}
            plain.append(sum(abs(a.get(p, length) - b.get(p, length)) for p in range(n_pivots)))
        assert files.footrule(own).tolist() == plain
