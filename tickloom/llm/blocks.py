"""A text table as blocks of distinct texts, and the exchange of fingerprints between them.

Blocks are dealt by the digest of the text, so copies meet in one block and stay once,
with their number. A scan task keeps one copy per Arrow batch before the shuffle, so a
group of copies that holds a third of all rows costs one row per batch. Payloads are
compressed Arrow tables: less disk than rows. The store is a checkpoint whose
partitioning Spark knows, so later passes join answers to it without moving texts.

Fingerprints travel as one array per (block, bucket), each value at most once a block:
a passage in every document costs a bucket one entry per block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.bytestext import give_back, lean, utf8

U = np.uint64
BLOCK_BYTES = 4 << 20
BUCKET_ENTRIES = 4 << 20


def pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(payload: bytes) -> pa.Table:
    return pa.ipc.open_stream(payload).read_all()


def checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's checkpoint folder; one of its own only for local runs where none is named."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    from tickloom.plans.storage import shared_dir

    context.setCheckpointDir(shared_dir(spark))


@dataclass
class Store:
    """Columns block int, payload binary; `n_parts` hash partitions by block."""

    table: DataFrame
    n_parts: int
    n_bytes: int


def digest(text: str = "text") -> F.Column:
    """The key of a text in `store`; a null is an empty text."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def store(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> Store:
    spark = docs.sparkSession
    checkpoint_dir(spark)
    texts = docs.select(F.col(text).cast("string").alias("text"))
    n_bytes = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-n_bytes // block_bytes))
    # Fewer partitions than Spark's own number would be dealt anew in every pass.
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_blocks // 2))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0).cast(pa.large_binary())
            found: dict[bytes, list[int]] = {}
            for i, value in enumerate(column):
                seen = found.setdefault(hashlib.md5(value.as_buffer() if value.is_valid else b"").digest(), [i, 0])
                seen[1] += 1
            if not found:
                continue
            keys, first = list(found), [x[0] for x in found.values()]
            block = np.array([int.from_bytes(k[:8], "little") % n_blocks for k in keys], np.int32)
            whole = pa.table({"key": pa.array(keys, pa.binary()), "copies": pa.array([x[1] for x in found.values()], pa.int64()), "text": column.fill_null(b"").take(pa.array(first))})
            order = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.diff(block[order])) + 1
            for rows in np.split(order, cuts):
                yield pa.RecordBatch.from_pydict({"block": pa.array([block[rows[0]]], pa.int32()), "payload": pa.array([pack(whole.take(pa.array(rows)))], pa.binary())})

    # Planned without adaptive execution, a checkpoint keeps its hash partitioning.
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dealt = texts.mapInArrow(lean(deal), "block int, payload binary").repartition(n_parts, "block").checkpoint()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    return Store(dealt, n_parts, n_bytes)


@dataclass
class Block:
    """Distinct texts of one block: digests, copies, bytes, offsets."""

    keys: list[bytes]
    copies: np.ndarray
    data: np.ndarray
    offsets: np.ndarray


def read_block(table: pa.Table) -> Block:
    keys: dict[bytes, int] = {}
    copies: list[int] = []
    columns = []
    for payload in table["payload"]:
        part = unpack(payload.as_py())
        fresh = []
        for i, (key, n) in enumerate(zip(part["key"].to_pylist(), part["copies"].to_pylist(), strict=True)):
            if key in keys:
                copies[keys[key]] += n
            else:
                keys[key] = len(copies)
                copies.append(n)
                fresh.append(i)
        columns += part["text"].take(pa.array(fresh, pa.int64())).chunks
    data, offsets = utf8(pa.chunked_array(columns, pa.large_binary()))
    return Block(list(keys), np.array(copies, np.int64), data, offsets)


def buckets(n_entries: float) -> int:
    return max(1, -(-int(n_entries) // BUCKET_ENTRIES))


def bucket_of(codes: np.ndarray, n_buckets: int) -> np.ndarray:
    return ((codes >> U(32)) * U(n_buckets)) >> U(32)


def split(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """The columns' entries of each bucket, buckets ascending."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    ends = [*np.flatnonzero(np.diff(bucket[order])) + 1, len(order)]
    first = 0
    for last in ends:
        rows = order[first:last]
        yield int(bucket[rows[0]]), [c[rows] for c in columns]
        first = last


def distinct(values: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each value once, and whether it came more than once or was marked as many."""
    order = np.argsort(values, kind="stable")
    sorted_values = values[order]
    starts = np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(values) else np.zeros(0, np.int64)
    counts = np.diff(np.append(starts, len(values)))
    marked = np.logical_or.reduceat(many[order], starts) if len(starts) else np.zeros(0, bool)
    return sorted_values[starts], marked | (counts > 1)


SHIPPED = "bucket int, block int, n_many long, payload binary"
ANSWERED = "block int, bucket int, payload binary"


def ship(block: int, bucket: np.ndarray, values: np.ndarray, many: np.ndarray, n_buckets: int) -> pa.Table:
    """One row per bucket: its distinct values, the ones known to be repeated first."""
    rows = []
    for k, (own, flags) in split(bucket, values, many):
        own, flags = distinct(own, flags)
        rows.append((k, block, int(flags.sum()), np.concatenate([own[flags], own[~flags]]).tobytes()))
    columns = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "block", "n_many", "payload"])


def repeated(shipped: DataFrame, kind: type, n_parts: int) -> DataFrame:
    """For each block and bucket, those of its values that occur more than once anywhere."""

    def find(table: pa.Table) -> pa.Table:
        arrays = [np.frombuffer(p, kind) for p in table["payload"].to_pylist()]
        many = [np.arange(len(a)) < n for a, n in zip(arrays, table["n_many"].to_pylist(), strict=True)]
        values, flags = distinct(np.concatenate(arrays), np.concatenate(many))
        values = values[flags]
        out = []
        for block, bucket, own in zip(table["block"].to_pylist(), table["bucket"].to_pylist(), arrays, strict=True):
            hits = own[np.isin(own, values, assume_unique=True)]
            if len(hits):
                out.append((block, bucket, hits.tobytes()))
        columns = list(zip(*out, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["block", "bucket", "payload"])

    return shipped.groupBy("bucket").applyInArrow(find, ANSWERED)


def answers(table: pa.Table, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of the answers to a block."""
    arrays = [np.frombuffer(p, kind) for p in table["payload"].to_pylist()]
    if not arrays:
        return np.zeros(0, np.int64), np.zeros(0, kind)
    return np.repeat(np.array(table["bucket"].to_pylist(), np.int64), [len(a) for a in arrays]), np.concatenate(arrays)


def per_block(texts: Store, fn: Callable[[int, Block], pa.Table], schema: str) -> DataFrame:
    def alone(key: tuple, t: pa.Table) -> pa.Table:
        out = fn(key[0].as_py(), read_block(t))
        give_back()
        return out

    return texts.table.groupBy("block").applyInArrow(alone, schema)


def with_answers(texts: Store, replies: DataFrame, fn: Callable[[int, Block, pa.Table], pa.Table], schema: str) -> DataFrame:
    """fn for every block, with the replies to it."""

    def both(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out = fn(key[0].as_py(), read_block(left), right)
        give_back()
        return out

    return texts.table.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(both, schema)
