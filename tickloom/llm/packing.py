"""Token sequences of bounded length, packed first-fit decreasing.

A document's ids are cut at multiples of the capacity; whole pieces fill sequences of their
own, the rest of each document goes into the leftmost sequence with room, longest first. The
room of a group's sequences is kept in a tournament tree, so a search costs the logarithm of
the group. Groups are random and independent: a piece's group follows from a hash of its
document, and groups hold about `group_docs` documents, whatever the table's size.

Sequence ids are group * 2**32 + number in the group. A null or empty text has only the end
id. Repeated rows are documents of their own; a null id stays null. Ties in length go by
id, then start. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.bytestext import U, lean, mix, slices, utf8
from tickloom.llm.tokens import encoder, vocabulary

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Tournament:
    """Leaves are sequences; a node knows the most room below it."""

    def __init__(self, n: int, capacity: int):
        self.half = 1 << max(0, (n - 1).bit_length())
        self.room = [capacity] * (2 * self.half)

    def place(self, size: int) -> int:
        """Put a piece into the leftmost sequence with room."""
        room, k = self.room, 1
        while k < self.half:
            k *= 2
            if room[k] < size:
                k += 1
        left, leaf = room[k] - size, k - self.half
        room[k] = left
        while k > 1:
            other, k = room[k ^ 1], k >> 1
            left = left if left > other else other
            if room[k] == left:
                break
            room[k] = left
        return leaf


def pack_sizes(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Sequence and offset of each size, given in descending order."""
    tree, used, bins, offsets = Tournament(max(1, len(sizes)), capacity), [0] * len(sizes), [], []
    for size in sizes:
        k = tree.place(size)
        bins.append(k)
        offsets.append(used[k])
        used[k] += size
    return bins, offsets


def pack(docs: DataFrame, capacity: int = 2048, path: str | None = None, end_id: int = 1, group_docs: int = 8192, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: its document, place there, checksum, sequence and place in it."""
    path = path or vocabulary("word_bpe_49k.json")
    groups = max(1, -(-docs.count() // group_docs))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, False)
        for batch in batches:
            doc_ids = batch.column(0)
            data, offsets = utf8(batch.column(1))
            rows, starts, lengths, sums, totals = [], [], [], [], []
            for first, last in slices(offsets):
                ids, ends = tool.encode(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                for r in range(last - first):
                    own = np.append(ids[ends[r] : ends[r + 1]], end_id).astype("<u4")
                    for start in range(0, len(own), capacity):
                        piece = own[start : start + capacity]
                        rows.append(first + r)
                        starts.append(start)
                        lengths.append(len(piece))
                        sums.append(zlib.crc32(piece))
                        totals.append(len(own))
            rows, sums = np.array(rows, np.int64), np.array(sums, np.int64)
            numbers = doc_ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[rows] if len(rows) else rows
            salt = mix(numbers.astype(U) * U(0x9E3779B97F4A7C15) ^ np.array(totals, U) ^ (sums.astype(U) << U(20)))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": doc_ids.take(pa.array(rows)),
                    "start": pa.array(starts, pa.int64()),
                    "length": pa.array(lengths, pa.int64()),
                    "ids_crc32": pa.array(sums),
                    "doc_tokens": pa.array(totals, pa.int64()),
                    "batch_group": pa.array((salt % U(groups)).astype(np.int64)),
                }
            )

    def fill(key: tuple, table: pa.Table) -> pa.Table:
        table = table.drop(["batch_group"]).sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        sizes = table["length"].to_pylist()
        whole = sum(s == capacity for s in sizes)
        bins, offsets = pack_sizes(sizes[whole:], capacity)
        number = np.concatenate([np.arange(whole), np.array(bins, np.int64) + whole]).astype(np.int64)
        table = table.append_column("sequence_id", pa.array(number + (key[0].as_py() << 32)))
        return table.append_column("offset", pa.array([0] * whole + offsets, pa.int64()))

    cut = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string")).mapInArrow(lean(pieces), f"{PIECES}, batch_group long")
    return cut.groupBy("batch_group").applyInArrow(fill, f"{PIECES}, sequence_id long, offset long")


def op4_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(spark.read.parquet(f"{folder}/documents.parquet"))
