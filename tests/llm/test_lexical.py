import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import lexical

PATTERN = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return PATTERN.findall((text or "").translate(LOWER))


def by_hand(docs, items, k=20):
    """All scores of (id, text) documents for (id, text) items, by the formula."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = set()
    for item, text in set(items):
        scores = []
        for doc, c in counts:
            m = 75 + 25 * sum(c.values()) * n_docs // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if c[t])
            if score > 0 and doc is not None:
                scores.append((-score, doc))
        out |= {(item, r + 1, doc, -s) for r, (s, doc) in enumerate(sorted(scores)[:k])}
    return out


def found(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    return {tuple(r) for r in lexical.ranked(d, i, **options).collect()}


def words(seed, n, vocabulary=300):
    r = random.Random(seed)
    return " ".join(f"w{min(int(r.paretovariate(0.6)), vocabulary)}" for _ in range(n))


@pytest.mark.parametrize("block_bytes", [1, 2_000, 1 << 23])
def test_equals_all_scores(spark, shared, monkeypatch, block_bytes):
    monkeypatch.setattr(lexical.build_index, "__defaults__", ("doc_id", "text", block_bytes))
    docs = [(i, words(i, 1 + i % 60)) for i in range(500)]
    items = [(i, words(1000 + i, 12)) for i in range(12)] + [(90, docs[7][1]), (91, "absent"), (92, "w1"), (93, "w1 w1 w1 w2")]
    assert found(spark, docs, items) == by_hand(docs, items)


def test_several_parts_of_items(spark, shared, monkeypatch):
    monkeypatch.setattr(lexical, "PART_TERMS", 20)
    docs = [(i, words(i, 30)) for i in range(120)]
    items = [(i, words(1000 + i, 9)) for i in range(15)]
    assert found(spark, docs, items) == by_hand(docs, items)


def test_ties_and_copies(spark, shared):
    """Thousands of copies rank by id; repeated rows rank one after another."""
    docs = [(5000 - i, "same words here") for i in range(3000)] + [(9000 + i, words(i, 20)) for i in range(40)] + [(1, "same words here")] * 3
    items = [(1, "same here"), (2, "same"), (2, "same")]
    assert found(spark, docs, items) == by_hand(docs, items)


def test_odd_texts(spark, shared, odd):
    docs = [*enumerate(odd), (None, "word x"), (None, None), (40, "É é Word2 a_b\x7fc 東京 x" + " pad" * 400_000), (41, "x" * 3_000_000), (42, "WORD")]
    items = [(0, None), (1, ""), (2, "word"), (3, "é É 東京 x"), (None, "word"), (4, "x" * 3_000_000), (5, "pad c b")]
    assert found(spark, docs, items) == by_hand(docs, [i for i in items if i[0] is not None])


def test_empty_tables(spark, shared):
    assert found(spark, [], [(1, "a")]) == set()
    assert found(spark, [(1, "a")], []) == set()
    assert found(spark, [(1, "a"), (2, "--")], [(1, "a")]) == by_hand([(1, "a")], [(1, "a")])


def test_items_of_one_id_are_ranked_apart(spark, shared):
    docs = [(1, "red fox"), (2, "blue fox"), (3, "blue")]
    got = found(spark, docs, [(7, "red"), (7, "blue")])
    assert {(r, d) for _, r, d, _ in got} == {(1, 1), (1, 3), (2, 2)}


def test_clashing_names(spark, shared):
    docs = spark.createDataFrame([(1, "red fox"), (2, "fox")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "fox red")], "item_id long, text string")
    names = ("item", "key", "term", "block", "places", "values", "n", "rank", "score", "id", "doc", "times", "weight", "df")
    extra = [F.lit("x").alias(n) for n in names]
    got = lexical.ranked(docs.select("*", *extra), items.select("*", *extra))
    assert {tuple(r) for r in got.collect()} == by_hand([(1, "red fox"), (2, "fox")], [(1, "fox red")])


def test_terms_across_pieces(monkeypatch):
    monkeypatch.setattr(lexical, "PIECE", 7)
    for seed in range(30):
        r = random.Random(seed)
        text = "".join(r.choice("aB1é -_\n") for _ in range(60))
        assert lexical.term_counts(text.encode()) == Counter(t.encode() for t in terms(text)), text


def test_range_maxima():
    rng = np.random.default_rng(1)
    sizes = [1, 5, 0, 17, 40]
    places = np.concatenate([np.sort(rng.choice(60, n, replace=False)) for n in sizes]).astype(np.int32)
    numbers = np.repeat(np.arange(5), sizes)
    gains = rng.integers(1, 9, len(places))
    index = lexical.RangeMaxima(60, numbers, places, gains)
    lists = np.arange(5)
    for a in range(0, 60, 7):
        for z in range(a, 61, 5):
            value, at = index.maxima(index.ranges(lists, np.array([a])), index.ranges(lists, np.array([z])))
            for t in range(5):
                inside = (numbers == t) & (places >= a) & (places < z)
                assert value[0, t] == gains[inside].max(initial=0)
                if inside.any():
                    assert at[0, t] == np.flatnonzero(inside)[gains[inside].argmax()]


def test_intervals_end_without_scoring_most_documents():
    """A rare term's few documents are found without a look at the others."""
    n = 20_000
    rng = np.random.default_rng(2)
    common = np.arange(n)
    rare = np.sort(rng.choice(n, 25, replace=False))
    numbers = np.repeat([0, 1], [n, len(rare)])
    index = lexical.RangeMaxima(n, numbers, np.concatenate([common, rare]).astype(np.int32), np.concatenate([rng.integers(1, 50, n), np.full(len(rare), 900)]))
    best = lexical.Best(20)
    scored = lexical.search_block(index, np.arange(n), np.array([0, 1]), np.array([1, 7]), best)
    total = index.impacts[:n].astype(np.int64).copy()
    total[rare] += 6300
    order = np.lexsort([np.arange(n), -total])[:20]
    assert best.ids.tolist() == order.tolist() and best.scores.tolist() == total[order].tolist()
    assert scored < 400
