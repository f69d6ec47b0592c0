import random
import re
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import types as T

from tickloom.llm import components, decontaminate, near_dedup

CAPITALS = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(CAPITALS))
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()


def groups(texts, words=5, percent=80):
    sets = [shingles(t, words) for t in texts]
    root = list(range(len(texts)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in combinations(range(len(texts)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return [find(k) for k in range(len(texts))], [len(s) for s in sets]


def edited(sentences, n_sources, n_copies, seed=0):
    r = random.Random(seed)
    texts = [sentences(seed * 50 + k, r.randint(1, 120)) for k in range(n_sources)]
    for k in range(n_copies):
        words = texts[k % n_sources].split(" ")
        for _ in range(r.randint(0, max(1, len(words) // 25))):
            words[r.randrange(len(words))] = r.choice(["edit", "other", "x"])
        texts.append(" ".join(words).upper() if k % 9 == 0 else "\n".join(words))
    return texts


def found(docs, **options):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_copies(docs, **options).collect()}


@pytest.mark.parametrize(("words", "node", "slice_sets"), [(4, 4096, 1024), (5, 10, 8)])
def test_groups_are_those_of_all_pairs(docs_of, sentences, odd, monkeypatch, words, node, slice_sets):
    # Small limits make nodes branch again and groups fall into slices.
    monkeypatch.setattr(near_dedup, "NODE", node)
    monkeypatch.setattr(near_dedup, "SLICE_SETS", slice_sets)
    texts = edited(sentences, 12, 150) + odd + odd
    root, sizes = groups(texts, words)
    assert found(docs_of(texts), words=words) == {k: (n, g, k == g) for k, (n, g) in enumerate(zip(sizes, root, strict=True))}


@pytest.mark.parametrize("n", [4, 5, 6, 7, 8])
def test_a_chain_is_one_group_in_any_order(n):
    # Neighbours share 16 of 20 shingles, others at most 14 of 22.
    sets = [np.arange(2 * k, 2 * k + 18, dtype=np.uint64).tobytes() for k in range(n)]
    compare = near_dedup._compare_sets(80)
    for order in permutations(range(n)):
        rows = [{"slice": 0, "id": bytes([i]), "shingles": sets[k]} for k, i in enumerate(order)]
        assert sorted(compare((b"", 0, 0), rows)) == [(bytes([i]), b"\0") for i in range(1, n)]


def test_hubs_and_pivots_lose_no_link(docs_of, sentences, odd, monkeypatch):
    # Every group is compared with hubs first and every node with pivots; bridges tie sources that share three quarters.
    monkeypatch.setattr(near_dedup, "NODE", 4)
    monkeypatch.setattr(near_dedup, "SLICE_SETS", 8)
    monkeypatch.setattr(near_dedup, "SLICES", 0)
    monkeypatch.setattr(near_dedup, "HUBS", 3)
    texts = edited(sentences, 6, 100, seed=3) + odd
    for k in range(6):
        words = sentences(900 + k % 2, 120).split(" ")
        texts += [" ".join(words[: 120 - cut] + sentences(70 + k, cut).split(" ")) for cut in range(2, 60, 3)]
    root, sizes = groups(texts)
    assert found(docs_of(texts)) == {k: (n, g, k == g) for k, (n, g) in enumerate(zip(sizes, root, strict=True))}


def test_ten_thousand_variants_of_a_text_are_one_group(docs_of, sentences, monkeypatch):
    # All limits are those of production. The second text shares half with the first, too little for a link.
    rows = []
    monkeypatch.setattr(near_dedup, "_branch", lambda nodes, least, own=near_dedup._branch: rows.append(own(nodes, least)) or rows[0])
    base = sentences(1, 120).split(" ")
    other = base[:60] + sentences(2, 60).split(" ")
    texts = []
    for k in range(10_500):
        words = list(base if k % 21 else other)
        words[k * 7 % 120] = f"v{k}"
        texts.append(" ".join(words))
    result = found(docs_of(texts))
    assert {k: v[1] for k, v in result.items()} == {k: 1 if k % 21 else 0 for k in range(10_500)}
    # Nodes don't multiply: 16 trees give a document at most 16 rows.
    assert rows[0][0].count() <= 16 * len(texts)


def test_documents_that_no_token_parts_form_a_star(docs_of, sentences, monkeypatch):
    monkeypatch.setattr(near_dedup, "NODE", 3)
    monkeypatch.setattr(near_dedup, "LEVELS", 1)
    text = sentences(1, 60)
    texts = [text + "\n" * k for k in range(30)] + [sentences(k, 60) for k in range(2, 6)]
    root, _ = groups(texts)
    assert [v[1] for _, v in sorted(found(docs_of(texts)).items())] == root


def test_repeats_nulls_and_nothing(docs_of, sentences):
    text = sentences(3, 50)
    docs = docs_of([(5, text), (5, text), (2, text + " "), (None, text), (None, None), (9, ""), (8, None)])
    rows = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near_dedup.near_copies(docs).collect())
    assert rows == [(False, 2, 46, 2, True), (False, 5, 46, 2, False), (False, 5, 46, 2, False), (False, 8, 0, 8, True), (False, 9, 0, 9, True), (True, 0, 0, 0, False), (True, 0, 46, 2, False)]
    assert near_dedup.near_copies(docs_of([])).collect() == []
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (2, text + " "), (8, ""), (9, "")]


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(0)
    common = rng.integers(1, 2**62, 900).astype(np.uint64)
    a, b = (np.concatenate([common, rng.integers(1, 2**62, 100).astype(np.uint64)]) for _ in range(2))
    same = (near_dedup.minwise(a) == near_dedup.minwise(b)).mean()
    assert abs(same - 900 / 1100) < 0.12


def test_components_of_chains_and_hubs(spark, shared):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 301), (301, 300)]
    table = spark.createDataFrame([(b"%04d" % a, b"%04d" % b) for a, b in edges], "a binary, b binary")
    root = {int(r.id): int(r.root) for r in components.components(table).collect()}
    assert root == {**dict.fromkeys(range(1, 41), 0), **dict.fromkeys(range(101, 160), 100), 301: 300}
    assert components.components(table.where("a is null")).collect() == []


ITEMS = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])


def contained(docs, items, words=5, percent=80):
    out = []
    for d, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(CAPITALS))
        own = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}
        for i, item in items:
            w = re.findall(r"[^\x20\x09-\x0D]+", (item or "").translate(CAPITALS))
            wanted = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)}
            if wanted and 100 * len(wanted & own) >= percent * len(wanted):
                out.append((d or 0, i, len(wanted), len(wanted & own)))
    return sorted(out)


@pytest.mark.parametrize("part_bytes", [8 << 20, 2000])
def test_items_are_found_as_by_full_sets(spark, docs_of, sentences, odd, monkeypatch, part_bytes):
    monkeypatch.setattr(decontaminate, "PART_BYTES", part_bytes)
    r = random.Random(4)
    items = [(k, sentences(900 + k, r.randint(3, 70))) for k in range(40)] + [(40, None), (41, ""), (42, "only four words here")]
    docs = []
    for k in range(80):
        words = items[k % 40][1].split(" ")
        if k % 3 == 0:
            words[r.randrange(len(words))] = "edit"
        if k % 4 == 0:
            words = words[: len(words) * r.randint(6, 10) // 10]
        text = " ".join([sentences(k, r.randint(0, 400)), *words, sentences(500 + k, r.randint(0, 400))])
        docs.append((k, text.upper() if k % 7 == 0 else text))
    # The two halves of an item, far apart.
    words = items[0][1].split(" ")
    docs += [(None, items[5][1]), (200, " ".join([*words[: len(words) // 2], sentences(1, 300), *words[len(words) // 2 :]]))]
    docs += [(300 + k, t) for k, t in enumerate(odd)]
    table = spark.createDataFrame(items, ITEMS)
    want = contained(docs, items)
    got = decontaminate.contained_items(docs_of(docs), table).collect()
    assert sorted((x.doc_id or 0, x.item_id, x.n_shingles, x.n_shared) for x in got) == want
    free = decontaminate.without_items(docs_of(docs), table)
    held = {d for d, *_ in want}
    assert sorted((x.doc_id or 0, x.text) for x in free.collect() if x.text) == sorted((d or 0, t) for d, t in docs if (d or 0) not in held and t)
    assert len(want) > 20


def test_no_items_and_no_documents(spark, docs_of, sentences):
    none = spark.createDataFrame([], ITEMS)
    docs = docs_of([sentences(1, 30)])
    assert decontaminate.contained_items(docs, none).collect() == []
    assert decontaminate.without_items(docs, none).count() == 1
    assert decontaminate.contained_items(docs_of([]), spark.createDataFrame([(1, sentences(1, 30))], ITEMS)).collect() == []
