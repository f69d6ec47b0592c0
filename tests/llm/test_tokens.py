import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.llm import packing, token_files
from tickloom.llm.bytestext import utf8
from tickloom.llm.tokens import Encoder, vocabulary

HARD = [
    " a", "  a  b", "a\n b", "a\xa0 b\xa0\n c", "it's  \n\n x", "\t\tq", "x " * 5 + "\n", "ΑΣ ΣΑ", "á e", "a\x1cb \x1c c", "\"'ll we'll  \n",
    "don’t", "\n\n", "\r\n x", "İstanbul", "<|endoftext|> a<|endoftext|>b", "日本 語", "l‘été.", "été…x", "a.…b", "÷.a×", "'s's", "x''s.'t", "é's", "1.a2", "ß.ß’s",
    "<|endoftext|>", " <|startoftext|>\xa0x <|endoftext|>", "<|endoftext", "|><|END", "<|EndOfText|> a", "a<|endoftext|>" * 40 + " b. c",
    # Words that hash alike modulo a power of two.
    *("".join("abab"[(bin(i).count("1") + k) & 1] for i in range(2048)) for k in (0, 1)),
]


def plain(name):
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(vocabulary(name))
    return lambda text: tool.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("name", "spaced"), [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_chunks_give_the_ids_of_whole_texts(name, spaced, odd, sentences, monkeypatch):
    monkeypatch.setattr("tickloom.llm.tokens.CACHE", 50)
    texts = [*HARD, *odd, sentences(1, 80), "a" * 3000]
    tool, whole = Encoder(vocabulary(name), spaced), plain(name)
    for _ in range(2):
        data, offsets = utf8(pa.array(texts))
        ids, ends = tool.encode(data, offsets)
        for k, text in enumerate(texts):
            assert ids[ends[k] : ends[k + 1]].tolist() == whole(text), text


def check_pieces(rows, texts, capacity):
    whole = plain("word_bpe_49k.json")
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for number, text in texts:
        ids = np.array([*whole(text), 1], "<u4")
        own = sorted(pieces[number], key=lambda r: r.start)
        assert [r.start for r in own] == np.concatenate([[0], np.cumsum([r.length for r in own])])[:-1].tolist()
        assert sum(r.length for r in own) == len(ids) == own[0].doc_tokens
        assert [r.ids_crc32 for r in own] == [zlib.crc32(ids[r.start : r.start + r.length]) for r in own]
    for own in sequences.values():
        own = sorted(own, key=lambda r: r.offset)
        assert [r.offset for r in own] == np.concatenate([[0], np.cumsum([r.length for r in own])])[:-1].tolist()
        assert sum(r.length for r in own) <= capacity
    return sequences


@pytest.mark.parametrize("group_docs", [8192, 20])
def test_packing_keeps_every_id_once_with_little_padding(docs_of, sentences, odd, group_docs):
    texts = list(enumerate([sentences(k, 1 + 17 * k % 90) for k in range(120)] + odd + [sentences(999, 700)]))
    rows = packing.pack(docs_of(texts), capacity=128, group_docs=group_docs).collect()
    sequences = check_pieces(rows, texts, 128)
    used = sum(r.length for r in rows)
    assert len(sequences) * 128 - used < (0.1 if group_docs > 20 else 0.25) * used


def test_first_fit_decreasing_is_that_of_a_plain_search():
    sizes = sorted(np.random.default_rng(1).integers(1, 100, 300).tolist(), reverse=True)
    room, want = [], []
    for size in sizes:
        k = next((k for k, left in enumerate(room) if left >= size), len(room))
        if k == len(room):
            room.append(100)
        want.append((k, 100 - room[k]))
        room[k] -= size
    assert list(zip(*packing.pack_sizes(sizes, 100), strict=True)) == want


def test_packing_of_repeats_nulls_and_nothing(docs_of):
    rows = packing.pack(docs_of([(1, "a b"), (1, "a b"), (None, "c"), (2, None)])).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.length) for r in rows) == [(False, 1, 3), (False, 1, 3), (False, 2, 1), (True, 0, 2)]
    assert packing.pack(docs_of([])).collect() == []


@pytest.mark.parametrize("block_ids", [1 << 18, 100])
def test_files_give_back_all_ids(spark, docs_of, sentences, odd, tmp_path, monkeypatch, block_ids):
    monkeypatch.setattr(token_files, "RANGE_BYTES", 9000)
    texts = [(7 * k % 101, t) for k, t in enumerate([sentences(k, 5 * k) for k in range(60)] + odd + [sentences(5, 900)])]
    token_files.write(docs_of(texts), str(tmp_path / "ids"), block_ids=block_ids)
    rows = token_files.read(spark, str(tmp_path / "ids")).collect()
    whole, start = plain("byte_bpe_50k.json"), 0
    want = []
    for number, text in sorted(texts, key=lambda x: x[0]):
        ids = np.array([*whole(text), 0], "<u4")
        want.append((number, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    assert sorted(tuple(r) for r in rows) == want


def test_files_of_repeats_nulls_and_nothing(spark, docs_of, tmp_path):
    token_files.write(docs_of([(1, "a b"), (1, "a b"), (None, "c"), (2, None)]), str(tmp_path / "a"))
    rows = token_files.read(spark, str(tmp_path / "a")).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens) for r in rows] == [(None, 0, 2), (1, 2, 3), (1, 5, 3), (2, 8, 1)]
    token_files.write(docs_of([]), str(tmp_path / "b"))
    assert token_files.read(spark, str(tmp_path / "b")).collect() == []


def test_a_damaged_block_is_noticed(spark, docs_of, sentences, tmp_path):
    token_files.write(docs_of([sentences(1, 300)]), str(tmp_path / "a"))
    blocks = spark.read.parquet(str(tmp_path / "a/blocks"))
    broken = F.concat(F.substring("words", 1, 100), F.unhex(F.lit("ff00ff00")), F.expr("substring(words, 105)"))
    blocks.withColumn("words", broken).write.parquet(str(tmp_path / "b/blocks"))
    spark.read.parquet(str(tmp_path / "a/frequencies")).write.parquet(str(tmp_path / "b/frequencies"))
    with pytest.raises(Exception, match="checksum"):
        token_files.read(spark, str(tmp_path / "b")).collect()


@pytest.mark.parametrize("counts", [[5], [1, 1], [10**9, 1, 1, 0, 3], [1] * 3000, [0, 7, 0]])
def test_coder_round_trip(counts):
    counts = np.array(counts)
    freq = token_files.frequencies(counts)
    assert freq.sum() == 1 << token_files.SCALE and ((freq > 0) == (counts > 0)).all()
    present = np.flatnonzero(counts)
    for n in (1, 63, 64, 1000, 70001):
        ids = np.random.default_rng(n).choice(present, n)
        coder, lanes = token_files.Coder(freq), token_files.lanes_for(n)
        every = max(1, -(-n // lanes // 3))
        words, states, places = coder.encode(ids, lanes, every)
        assert (coder.decode(words, states, places, n, lanes, every) == ids).all()


def test_checksums_of_joined_strings():
    for a, b in ((b"", b"x"), (b"abc", b""), (b"abc" * 99, b"\0\xff" * 77)):
        assert token_files.crc_joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
