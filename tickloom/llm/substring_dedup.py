"""Repeated word sequences, by looking up windows in an index of all documents.

* Seeds: of each window of `length` words, the least of its (length + 1) // 2-word grams.
  Equal windows have equal seeds, and neighbouring windows mostly share theirs, so seeds are
  about a tenth of the words. Seeds that occur at two places or more call for an index.
* Reference blocks: all windows over such seeds, of all documents, are indexed by
  fingerprint; each block of the index holds one range of fingerprints.
* Lookup: each window over a repeated seed is looked up on its own; what windows that occur
  again cover is removed. There are no factors and no reference positions.

Fingerprints have 64 bits inside blocks chosen by an independent hash.

Nulls and texts without words have none; documents of fewer words than `length` keep all;
repeated rows are copies of each other; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import blocks
from tickloom.llm.blocks import Block, Store, bucket_of
from tickloom.llm.bytestext import U, counted, runs_of_words, slices, sliding, word_bounds, word_hashes


class _Part:
    def __init__(self, block: Block, first: int, last: int, length: int):
        offsets = block.offsets[first : last + 1]
        self.data = block.data[offsets[0] : offsets[-1]]
        self.starts, self.ends, self.rows = word_bounds(self.data, offsets - offsets[0])
        self.length, self.gram = length, (length + 1) // 2
        counts = np.diff(self.rows)
        n = len(self.starts)
        whole = np.zeros(n + 1, np.int32)
        has = counts >= length
        np.add.at(whole, self.rows[:-1][has], 1)
        np.add.at(whole, self.rows[1:][has] - length + 1, -1)
        #: Words at which a window of one document starts.
        self.opens = np.cumsum(whole)[:n] > 0
        self.many = np.repeat(block.copies[first:last] > 1, counts)
        self.words = word_hashes(self.data, self.starts, self.ends)

    def seeds(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The seed of each window, the distinct places' seeds, and the words they start at."""
        grams = runs_of_words(self.words, self.gram)
        width = self.length - self.gram + 1
        if len(grams) < width:
            return np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64)
        least = sliding(grams, width, np.minimum)
        own = np.where(self.opens[: len(least)], least, U(0))
        edge = np.zeros(width - 1, U)
        chosen = sliding(np.concatenate([edge, own, edge]), width, np.maximum)
        at = np.flatnonzero((chosen == grams) & (grams > 0))
        return least, grams[at], at

    def windows(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        other = word_hashes(self.data, self.starts, self.ends, 1)
        return runs_of_words(self.words, self.length)[at], runs_of_words(other, self.length, 1)[at]


def _parts(block: Block, length: int):
    for first, last in slices(block.offsets):
        yield first, last, _Part(block, first, last, length)


def _code(seeds: np.ndarray, n_buckets: int) -> np.ndarray:
    return (bucket_of(seeds, n_buckets) << U(32)) | (seeds & U(0xFFFFFFFF))


def removed_words(texts: Store, length: int = 35) -> DataFrame:
    """For each distinct text: its digest and what is left; see `repeated_words`."""
    b1, b2 = blocks.buckets(texts.n_bytes / 50), blocks.buckets(texts.n_bytes / 30)

    def seeds(block: int, b: Block) -> pa.Table:
        codes, many = [np.zeros(0, U)], [np.zeros(0, bool)]
        for _, _, part in _parts(b, length):
            _, own, at = part.seeds()
            codes.append(_code(own, b1))
            many.append(part.many[at])
        codes = np.concatenate(codes)
        return blocks.ship(block, codes >> U(32), codes.astype(np.uint32), np.concatenate(many), b1)

    first = blocks.repeated(blocks.per_block(texts, seeds, blocks.SHIPPED), np.uint32, texts.n_parts).checkpoint()

    def candidates(b: Block, replies: pa.Table):
        buckets, values = blocks.answers(replies, np.uint32)
        known = (buckets.astype(U) << U(32)) | values.astype(U)
        for first_row, _, part in _parts(b, length):
            least, _, _ = part.seeds()
            at = np.flatnonzero(part.opens[: len(least)])
            at = at[np.isin(_code(least[at], b1), known)]
            yield first_row, part, at

    def windows(block: int, b: Block, replies: pa.Table) -> pa.Table:
        buckets, values, many = [np.zeros(0, U)], [np.zeros(0, U)], [np.zeros(0, bool)]
        for _, part, at in candidates(b, replies):
            place, value = part.windows(at)
            buckets.append(bucket_of(place, b2))
            values.append(value)
            many.append(part.many[at])
        return blocks.ship(block, np.concatenate(buckets), np.concatenate(values), np.concatenate(many), b2)

    second = blocks.repeated(blocks.with_answers(texts, first, windows, blocks.SHIPPED), U, texts.n_parts)
    # Seeds' answers keep their buckets, windows' answers have negative ones.
    both = first.unionByName(second.withColumn("bucket", -1 - F.col("bucket")))

    def finish(_: int, b: Block, table: pa.Table) -> pa.Table:
        of_windows = [x < 0 for x in table["bucket"].to_pylist()]
        _, values = blocks.answers(table.filter(pa.array(of_windows, pa.bool_())), U)
        rest = table.filter(pa.array([not x for x in of_windows], pa.bool_()))
        rows = []
        for first_row, part, at in candidates(b, rest):
            at = at[part.many[at] | np.isin(part.windows(at)[1], values)]
            marks = np.zeros(len(part.starts) + length + 1, np.int32)
            marks[at] += 1
            marks[at + length] -= 1
            kept = np.cumsum(marks)[: len(part.starts)] == 0
            sizes = (part.ends - part.starts)[kept] + 1
            joined = np.append(part.data, np.uint8(0x20))[counted(part.starts[kept], sizes)]
            stops = np.cumsum(sizes)
            joined[stops - 1] = 0x20
            stops = np.concatenate([[0], stops])
            before = np.concatenate([[0], np.cumsum(kept)])
            for r in range(len(part.rows) - 1):
                low, high = part.rows[r], part.rows[r + 1]
                a, z = stops[before[low]], stops[before[high]]
                rows.append((b.keys[first_row + r], int(high - low), int(high - low - (before[high] - before[low])), hashlib.sha256(joined[a : max(a, z - 1)].tobytes()).hexdigest()))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["key", "n_words", "n_removed", "kept_sha256"])

    return blocks.with_answers(texts, both, finish, "key binary, n_words long, n_removed long, kept_sha256 string")


def repeated_words(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = 35) -> DataFrame:
    """One row per document: what remains without sequences of `length` words that occur again.

    Returns the id, n_words, n_removed and kept_sha256.
    """
    results = removed_words(blocks.store(docs, text), length)
    return docs.select(F.col(id_column), blocks.digest(text).alias("key")).join(results, "key").drop("key")


def op2_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_words(spark.read.parquet(f"{folder}/documents.parquet"))
