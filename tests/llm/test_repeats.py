import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from tickloom.llm import blocks, substring_dedup, suffix_dedup
from tickloom.llm.bytestext import ROLLS, mix, sliding


def strings(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        mask = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                mask[i : i + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(mask)))
        out.append((len(b), sum(mask), runs, hashlib.sha256(bytes(x for x, m in zip(b, mask, strict=True) if not m)).hexdigest()))
    return out


def word_runs(texts, length):
    data = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[i : i + length]) for w in data for i in range(len(w) - length + 1))
    out = []
    for w in data:
        mask = bytearray(len(w))
        for i in range(len(w) - length + 1):
            if count[tuple(w[i : i + length])] > 1:
                mask[i : i + length] = b"\1" * length
        out.append((len(w), sum(mask), hashlib.sha256(" ".join(x for x, m in zip(w, mask, strict=True) if not m).encode()).hexdigest()))
    return out


def mixed(sentences, seed):
    """Texts with copies, edits, shared passages, repeats inside a text, and periodic text."""
    r = random.Random(seed)
    passages = [sentences(seed * 100 + k, r.randint(20, 120)) for k in range(6)]
    texts = []
    for k in range(60):
        parts = [sentences(seed * 1000 + k, r.randint(1, 150))]
        for _ in range(r.randint(0, 2)):
            parts.insert(r.randint(0, len(parts)), r.choice(passages))
        texts.append(" ".join(parts))
    for k in range(25):
        words = texts[k % 7].split(" ")
        for _ in range(k % 4):
            words[r.randrange(len(words))] = f"edit{k}"
        texts.append("\n".join(words) if k % 5 == 4 else " ".join(words))
    return [*texts, "ab" * 600, "ab" * 500 + "b", texts[3] + " " + texts[3], "x y " * 90]


@pytest.mark.parametrize("block_bytes", [1 << 22, 4000])
def test_repeated_strings_are_those_of_plain_search(docs_of, sentences, odd, block_bytes, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", block_bytes)
    texts = mixed(sentences, 5) + odd
    store = blocks.store(docs_of(texts), block_bytes=block_bytes)
    found = {bytes(r.key): (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed_spans(store, 400).collect()}
    for text, want in zip(texts, strings(texts, 400), strict=True):
        assert found[hashlib.md5((text or "").encode()).digest()] == want


@pytest.mark.parametrize("block_bytes", [1 << 22, 4000])
def test_repeated_words_are_those_of_plain_search(docs_of, sentences, odd, block_bytes):
    texts = mixed(sentences, 6) + odd
    store = blocks.store(docs_of(texts), block_bytes=block_bytes)
    found = {bytes(r.key): (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removed_words(store, 35).collect()}
    for text, want in zip(texts, word_runs(texts, 35), strict=True):
        assert found[hashlib.md5((text or "").encode()).digest()] == want


def test_one_row_per_row_and_spans_name_the_removed_bytes(docs_of, sentences):
    text = sentences(1, 200)
    docs = docs_of([(1, text), (1, text), (None, text), (2, "é" + text), (3, None)]).withColumnRenamed("source", "key")
    rows = suffix_dedup.repeated_strings(docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == [(False, 1), (False, 1), (False, 2), (False, 3), (True, 0)]
    by_id = {r.doc_id: r for r in rows}
    assert list(np.frombuffer(by_id[2].spans, "<i8")) == [2, 2 + len(text)]
    assert (by_id[1].n_removed, by_id[3].n_bytes) == (len(text), 0)
    assert len(substring_dedup.repeated_words(docs).collect()) == 5


def test_empty_table(docs_of):
    assert suffix_dedup.repeated_strings(docs_of([])).collect() == []
    assert substring_dedup.repeated_words(docs_of([])).collect() == []


def test_cover_meets_every_distance():
    assert {int(d) for d in np.subtract.outer(suffix_dedup.COVER, suffix_dedup.COVER).ravel() % suffix_dedup.PERIOD} == set(range(suffix_dedup.PERIOD))


def test_hashes_tell_substrings_apart():
    data = np.frombuffer(b"abcabcabdxabc" * 50, np.uint8)
    for roll in ROLLS:
        hashes = roll.windows(roll.prefixes(data), 0, len(data) - 4, 5)
        assert len(set(hashes.tolist())) == len({data[i : i + 5].tobytes() for i in range(len(data) - 4)})


def thue_morse(n):
    """Two words of n letters that hash alike modulo 2**64 for every odd base, once n is 1,024."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [1024, 2048, 4096, 1 << 15])
def test_hashes_tell_thue_morse_words_apart(n):
    data = np.frombuffer("".join(thue_morse(n)).encode(), np.uint8)
    for roll in ROLLS:
        one, other = roll.spans(roll.prefixes(data), np.array([0, n]), np.array([n, 2 * n]))
        assert one != other
        sequence = data.astype(np.uint64)
        one, other = roll.spans(roll.prefixes(sequence), np.array([0, n]), np.array([n, 2 * n]))
        assert one != other


def test_hash_is_the_polynomial():
    rng = np.random.default_rng(1)
    prime = (1 << 61) - 1
    for data in (rng.integers(0, 256, 300).astype(np.uint8), rng.integers(0, 1 << 64, 300, dtype=np.uint64)):
        for roll in ROLLS:
            letters = [int(x) + (data.dtype == np.uint8) for x in data]
            starts, ends = rng.integers(0, 150, 30), rng.integers(150, 301, 30)
            plain = [sum(x * pow(roll.base, i, prime) for i, x in enumerate(letters[a:z])) % prime for a, z in zip(starts, ends, strict=True)]
            assert roll.spans(roll.prefixes(data), starts, ends).tolist() == mix(np.array(plain, np.uint64)).tolist()


def test_words_that_collided_are_kept(docs_of, sentences):
    """Documents that differ in one Thue-Morse word only share no window with that word."""
    head, tail = sentences(3, 17), sentences(4, 17)
    texts = [f"{head} {w} {tail}" for w in thue_morse(2048)]
    store = blocks.store(docs_of(texts))
    found = {bytes(r.key): (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.removed_words(store, 35).collect()}
    for text, want in zip(texts, word_runs(texts, 35), strict=True):
        assert found[hashlib.md5(text.encode()).digest()] == want
    assert all(x[1] == 0 for x in found.values())
    texts = [w for n in (1024, 2048) for w in thue_morse(n)]
    found = {bytes(r.key): (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.removed_spans(blocks.store(docs_of(texts)), 400).collect()}
    for text, want in zip(texts, strings(texts, 400), strict=True):
        assert found[hashlib.md5(text.encode()).digest()] == want


def test_sliding_extremes():
    values = np.random.default_rng(0).integers(0, 99, 50)
    for width in (1, 2, 3, 18, 50):
        assert sliding(values, width, np.minimum).tolist() == [values[i : i + width].min() for i in range(51 - width)]
