import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tickloom.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """The root of a list of digests, and each one's siblings in turn, by whole levels."""
    proofs = [[] for _ in leaves]
    members = [[i] for i in range(len(leaves))]
    level = list(leaves)
    while len(level) > 1:
        above, joined = [], []
        for i in range(0, len(level), 2):
            run, own = level[i : i + 2], members[i : i + 2]
            for k, group in enumerate(own):
                for member in group:
                    proofs[member].append((k, [d for j, d in enumerate(run) if j != k]))
            above.append(digest(*run))
            joined.append(sum(own, []))
        level, members = above, joined
    return level[0], proofs


def folded(start, proof):
    for k, siblings in proof:
        start = digest(*siblings[:k], start, *siblings[k:])
    return start


def by_hand(rows, altered):
    """rows: (doc_id, source, lang, n_chars, text); the query's rows by plain recursion."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, out = {}, []
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[lang] = own, *tree([leaf_of(r) for r in own])
    root, tops = tree([trees[x][1] for x in langs])
    for lang, top in zip(langs, tops, strict=True):
        own, subroot, proofs = trees[lang]
        for row, proof in zip(own, proofs, strict=True):
            whole = proof + top
            start = leaf_of(altered(row))
            got = folded(start, whole)
            out.append((row[0], leaf_of(row), subroot, root, digest(*(d for _, s in whole for d in s)), got, got == root))
    return out


def rows_of(seed, n):
    r = random.Random(seed)
    langs = ["en"] * 6 + ["de", "fr", None, "é", "z" * 30, ""]
    rows = []
    for i in range(n):
        text = None if r.random() < 0.1 else "".join(r.choice("ab é:-\n") for _ in range(r.randint(0, 30)))
        rows.append((i * 3, r.choice(["s", None, "1:x"]), r.choice(langs), r.choice([None, len(text or "")]), text))
    return rows


def plain(found):
    return sorted((tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(3)


def tampered(row):
    return (*row[:3], row[3] + 1, row[4]) if row[0] is not None and row[3] is not None and row[0] % 5 == 0 else row


@pytest.fixture
def short_steps(monkeypatch):
    monkeypatch.setattr(merkle, "STEP", 2)
    monkeypatch.setattr(merkle, "RANGE_ROWS", 7)


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 64, 150])
def test_several_rounds_equal_plain_recursion(spark, shared, short_steps, n):
    rows = rows_of(n, n)
    found = merkle.manifest(table(spark, rows), altered={"n_chars": F.col("n_chars") + 1}, where=F.col("doc_id") % 5 == 0)
    assert plain(found) == sorted(by_hand(rows, tampered), key=repr)
    broken = {r[0] for r in rows if r[0] % 5 == 0 and r[3] is not None}
    assert {r.doc_id for r in found.collect() if not r.verified} == broken


def test_one_round_equals_plain_recursion(spark, shared):
    rows = rows_of(3, 400)
    assert plain(merkle.manifest(table(spark, rows))) == sorted(by_hand(rows, lambda r: r), key=repr)


def test_odd_rows(spark, shared, short_steps):
    """Nulls in every column, repeated rows, a repeated id, a long text, and a key with most rows."""
    rows = [(None, None, None, None, None)] * 3 + [(7, "s", "en", 1, "x")] * 40 + [(7, "s", "en", 1, "y"), (8, "s", "en", 0, ""), (9, "s", "de", 900_000, "word " * 180_000)]
    found = merkle.manifest(table(spark, rows))
    assert plain(found) == sorted(by_hand(rows, lambda r: r), key=repr)
    assert found.where("verified").count() == len(rows)


def test_many_keys_make_a_high_upper_tree(spark, shared, short_steps):
    rows = [(i, "s", f"k{i % 37}", i, "t") for i in range(90)]
    assert plain(merkle.manifest(table(spark, rows))) == sorted(by_hand(rows, lambda r: r), key=repr)


def test_empty_table(spark, shared):
    assert merkle.manifest(table(spark, [])).collect() == []


def test_clashing_names(spark, shared):
    names = ("tree", "id", "digest", "altered", "tie", "place", "total", "block", "kind", "steps", "root", "subroot", "range", "near")
    rows = [(i, "s", "en", i, "t") for i in range(5)]
    plain_rows = table(spark, rows)
    wide = plain_rows.select("*", *(F.lit("x").alias(n) for n in names))
    assert plain(merkle.manifest(wide)) == plain(merkle.manifest(plain_rows))


def test_proof_lists_siblings_from_leaf_to_root(spark, shared):
    rows = [(i, "s", "en", i, "t") for i in range(5)]
    found = {r.doc_id: r for r in merkle.manifest(table(spark, rows)).collect()}
    leaves = [leaf_of(r) for r in rows]
    assert found[1].proof[0] == "L" + leaves[0] and found[0].proof[0] == "R" + leaves[1]
    # The fifth leaf is alone on two levels.
    assert found[4].proof[:2] == ["", ""] and len(found[4].proof) == 3
    assert all(merkle.fold(leaves[i], found[i].proof) == found[i].root for i in range(5))


def test_sweeps_run_in_label_order():
    leaves = [digest(str(i)) for i in range(11)]
    nodes = merkle.forward(leaves, 4)
    root, proofs = tree(leaves)
    assert nodes[4, 0] == root
    places = [p for p, _ in merkle.backward(nodes, 4, ["Lx"])]
    assert places == list(range(10, -1, -1))
    for place, steps in merkle.backward(nodes, 4, []):
        assert [s[1:] for s in steps if s] == [d for _, s in proofs[place] for d in s]
