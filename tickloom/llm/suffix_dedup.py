"""Repeated byte strings, found by a difference-cover sample of suffixes.

Suffixes are not ordered: whether windows of `length` bytes are equal, which is all that the
result needs, is told by fingerprints.

* Sample: positions whose remainder by 91 lies in a difference cover of ten remainders.
  Two equal windows of `length` bytes have a sampled position at equal distance, within 91
  bytes, from which at least length - 90 bytes agree.
* Names: sampled suffixes are named by their first length - 90 bytes. Only samples whose
  name occurs again go on.
* Second names: samples of equal name are named again, by all bytes that the windows
  reaching them span. Where this longer name occurs again, all those windows do.
* Windows: those that reach a sample whose longer name is its own are looked up by
  fingerprint, together with one representative of each longer name.

Names are 64-bit fingerprints inside buckets chosen by an independent hash.

Nulls and empty texts have no bytes; texts shorter than `length` keep everything; repeated
rows are copies of each other; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import blocks
from tickloom.llm.blocks import Block, Store, bucket_of
from tickloom.llm.bytestext import ROLLS, U, counted, mix, slices

PERIOD = 91
# A perfect difference set modulo 91.
COVER = np.array([0, 1, 3, 9, 27, 49, 56, 61, 77, 81])


def _samples(offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sampled positions in texts that have a window, and the row of each."""
    sizes = np.diff(offsets)
    periods = np.where(sizes >= length, -(-sizes // PERIOD), 0)
    row = np.repeat(np.arange(len(sizes)), periods)
    at = (counted(np.zeros(len(sizes), np.int64), periods) * PERIOD)[:, None] + COVER[None, :]
    row = np.repeat(row, len(COVER))
    at = at.ravel()
    keep = at + (length - PERIOD + 1) <= sizes[row]
    return at[keep] + offsets[row[keep]], row[keep]


class _Part:
    """A slice of a block with its samples and their hashes."""

    def __init__(self, block: Block, first: int, last: int, length: int):
        offsets = block.offsets[first : last + 1]
        self.shift = offsets[0]
        self.data = block.data[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.many = block.copies[first:last] > 1
        self.sums = [r.prefixes(self.data) for r in ROLLS]
        self.at, self.row = _samples(self.offsets, length)
        inner = length - PERIOD + 1
        self.length = length
        self.name = [r.spans(s, self.at, self.at + inner) for r, s in zip(ROLLS, self.sums, strict=True)]

    def reach(self, at: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last window that starts at most PERIOD - 1 bytes before each sample."""
        return np.maximum(self.offsets[row], at - PERIOD + 1), np.minimum(at, self.offsets[row + 1] - self.length)

    def context(self, at: np.ndarray, row: np.ndarray) -> np.ndarray:
        first, last = self.reach(at, row)
        whole = ROLLS[1].spans(self.sums[1], first, last + self.length)
        return mix(whole ^ mix(((at - first) * 1024 + (at - last)).astype(U)))

    def windows(self, which: int, at: np.ndarray) -> np.ndarray:
        return ROLLS[which].spans(self.sums[which], at, at + self.length)


def _parts(block: Block, length: int):
    for first, last in slices(block.offsets):
        yield first, last, _Part(block, first, last, length)


def _code(part: _Part, n_buckets: int) -> np.ndarray:
    """Bucket and 32-bit rest of a sample's name as one number."""
    return (bucket_of(part.name[0], n_buckets) << U(32)) | (part.name[0] & U(0xFFFFFFFF))


def _named(part: _Part, names: np.ndarray, n_buckets: int) -> np.ndarray:
    """Samples whose name occurs again."""
    return np.flatnonzero(np.isin(_code(part, n_buckets), names))


PAIRS = "bucket int, block int, n long, payload binary"
STATES = "block int, n long, payload binary"


def removed_spans(texts: Store, length: int = 400) -> DataFrame:
    """For each distinct text: its digest, sizes and what is left; see `repeated_strings`."""
    n_samples = texts.n_bytes * len(COVER) / PERIOD
    b1, b2, b3 = blocks.buckets(n_samples), blocks.buckets(n_samples / 2), blocks.buckets(texts.n_bytes / 8)

    def names(block: int, b: Block) -> pa.Table:
        codes, many = [np.zeros(0, U)], [np.zeros(0, bool)]
        for _, _, part in _parts(b, length):
            codes.append(_code(part, b1))
            many.append(part.many[part.row])
        codes = np.concatenate(codes)
        return blocks.ship(block, codes >> U(32), codes.astype(np.uint32), np.concatenate(many), b1)

    first = blocks.repeated(blocks.per_block(texts, names, blocks.SHIPPED), np.uint32, texts.n_parts)
    first = first.checkpoint()

    def known(replies: pa.Table) -> np.ndarray:
        buckets, values = blocks.answers(replies, np.uint32)
        return np.sort((buckets.astype(U) << U(32)) | values.astype(U))

    def contexts(block: int, b: Block, replies: pa.Table) -> pa.Table:
        found, own = known(replies), []
        for _, _, part in _parts(b, length):
            s = _named(part, found, b1)
            own.append((part.name[1][s], part.context(part.at[s], part.row[s]), part.many[part.row[s]]))
        name, context, many = (np.concatenate(x) for x in zip(*own, strict=True)) if own else (np.zeros(0, U), np.zeros(0, U), np.zeros(0, bool))
        rows = []
        pair = np.rec.fromarrays([name, context], names="name,context")
        for k, (own, flags) in blocks.split(bucket_of(name, b2), pair, many):
            own, flags = blocks.distinct(own, flags)
            rows.append((k, block, int(flags.sum()), np.concatenate([own[flags], own[~flags]]).tobytes()))
        return _table(rows, (pa.int32(), pa.int32(), pa.int64(), pa.binary()), ("bucket", "block", "n", "payload"))

    def states(table: pa.Table) -> pa.Table:
        """For each block, the pairs (name, context) whose windows it must send, and those that occur again."""
        arrays = [np.frombuffer(p, U).reshape(-1, 2) for p in table["payload"].to_pylist()]
        many = np.concatenate([np.arange(len(a)) < n for a, n in zip(arrays, table["n"].to_pylist(), strict=True)])
        block = np.repeat(np.array(table["block"].to_pylist(), np.int64), [len(a) for a in arrays])
        both = np.concatenate(arrays)
        order = np.lexsort([block, both[:, 1], both[:, 0]])
        both, many, block = both[order], many[order], block[order]
        new_name = np.concatenate([[True], both[1:, 0] != both[:-1, 0]])
        new_pair = new_name | np.concatenate([[True], both[1:, 1] != both[:-1, 1]])
        starts = np.flatnonzero(new_pair)
        which = np.cumsum(new_pair) - 1
        again = (np.diff(np.append(starts, len(both))) > 1) | np.logical_or.reduceat(many, starts)
        name = np.cumsum(new_name) - 1
        lone = np.zeros(name[-1] + 1, bool)
        lone[name[starts[~again]]] = True
        size = np.bincount(name[starts], minlength=len(lone))
        # A lone pair needs windows only where another pair has its name.
        send = new_pair & (lone & (size > 1))[name]
        again = again[which]
        rows = []
        for k, (p, s, a) in blocks.split(block, both, send, again):
            flags = s.astype(np.int64) + 2 * a
            keep = flags > 0
            if keep.any():
                rows.append((k, int(keep.sum()), p[keep].tobytes() + flags[keep].astype(np.uint8).tobytes()))
        return _table(rows, (pa.int32(), pa.int64(), pa.binary()), ("block", "n", "payload"))

    second = blocks.with_answers(texts, first, contexts, PAIRS).groupBy("bucket").applyInArrow(states, STATES)
    # Both kinds of replies a block needs from here on, told apart by the bucket.
    replies = first.select("block", "bucket", F.lit(0).cast("long").alias("n"), "payload").unionByName(
        second.select("block", F.lit(-1).alias("bucket"), "n", "payload")
    )
    replies = replies.checkpoint()

    def resolve(b: Block, table: pa.Table):
        """For each part: windows known to occur again, and those in doubt or sent for others."""
        lone = [x is not None and x >= 0 for x in table["bucket"].to_pylist()]
        found = known(table.filter(pa.array(lone, pa.bool_())))
        pairs, flags = [np.zeros((0, 2), U)], [np.zeros(0, np.uint8)]
        for n, payload in zip(*(table.filter(pa.array([not x for x in lone], pa.bool_()))[c].to_pylist() for c in ("n", "payload")), strict=True):
            pairs.append(np.frombuffer(payload, U, 2 * n).reshape(-1, 2))
            flags.append(np.frombuffer(payload, np.uint8, n, 16 * n))
        pairs, flags = np.concatenate(pairs), np.concatenate(flags)
        key = mix(pairs[:, 0]) ^ pairs[:, 1]
        order = np.argsort(key)
        key, flags = key[order], flags[order]
        for first_row, last_row, part in _parts(b, length):
            s = _named(part, found, b1)
            at, row = part.at[s], part.row[s]
            own = mix(part.name[1][s]) ^ part.context(at, row)
            place = np.minimum(np.searchsorted(key, own), max(len(key) - 1, 0))
            hit = (key[place] == own) if len(key) else np.zeros(len(own), bool)
            state = np.where(hit, flags[place] if len(key) else 0, 0)
            low, high = part.reach(at, row)
            n = len(part.data) + 1
            again, sent = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
            for marks, bit in ((again, 2), (sent, 1)):
                m = (state & bit) > 0
                np.add.at(marks, low[m], 1)
                np.add.at(marks, high[m] + 1, -1)
            again, sent = np.cumsum(again)[:n] > 0, np.cumsum(sent)[:n] > 0
            for r in np.flatnonzero(part.many & (np.diff(part.offsets) >= length)):
                again[part.offsets[r] : part.offsets[r + 1] - length + 1] = True
            yield first_row, last_row, part, again, sent

    def windows(block: int, b: Block, table: pa.Table) -> pa.Table:
        buckets, values, many = [np.zeros(0, U)], [np.zeros(0, U)], [np.zeros(0, bool)]
        for _, _, part, again, sent in resolve(b, table):
            at = np.flatnonzero(sent)
            buckets.append(bucket_of(part.windows(0, at), b3))
            values.append(part.windows(1, at))
            many.append(again[at])
        return blocks.ship(block, np.concatenate(buckets), np.concatenate(values), np.concatenate(many), b3)

    third = blocks.repeated(blocks.with_answers(texts, replies, windows, blocks.SHIPPED), U, texts.n_parts)
    final = replies.unionByName(third.select("block", (-2 - F.col("bucket")).alias("bucket"), F.lit(0).cast("long").alias("n"), "payload"))

    def finish(_: int, b: Block, table: pa.Table) -> pa.Table:
        of_windows = pa.array([x < -1 for x in table["bucket"].to_pylist()], pa.bool_())
        _, values = blocks.answers(table.filter(of_windows), U)
        values = np.sort(values)
        rest = table.filter(pa.array([not x for x in of_windows.to_pylist()], pa.bool_()))
        rows = []
        for first_row, _, part, again, sent in resolve(b, rest):
            doubt = np.flatnonzero(sent & ~again)
            again[doubt[np.isin(part.windows(1, doubt), values)]] = True
            marks = np.zeros(len(again) + length + 1, np.int32)
            at = np.flatnonzero(again)
            marks[at] += 1
            marks[at + length] -= 1
            covered = np.cumsum(marks)[: len(part.data)] > 0
            for r in range(len(part.offsets) - 1):
                low, high = part.offsets[r], part.offsets[r + 1]
                mask, text = covered[low:high], part.data[low:high]
                edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
                spans = edges.astype("<i8").tobytes()
                rows.append((b.keys[first_row + r], int(high - low), int(mask.sum()), len(edges) // 2, hashlib.sha256(text[~mask].tobytes()).hexdigest(), spans))
        return _table(rows, (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), ("key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"))

    return blocks.with_answers(texts, final, finish, "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans binary")


def _table(rows: list[tuple], types: tuple, names: tuple) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[] for _ in types]
    return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=list(names))


def repeated_strings(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = 400) -> DataFrame:
    """One row per document: what remains without strings of `length` bytes that occur again.

    Returns the id, n_bytes, n_removed, n_spans, kept_sha256 and `spans`, the removed byte
    ranges as little-endian 64-bit starts and ends in turn.
    """
    texts = blocks.store(docs, text)
    results = removed_spans(texts, length)
    return docs.select(F.col(id_column), blocks.digest(text).alias("key")).join(results, "key").drop("key")


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = repeated_strings(docs).withColumn("n_kept", F.col("n_bytes") - F.col("n_removed"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept")
