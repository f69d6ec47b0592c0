"""Token ids in files: static range coding with one shared frequency table.

* Documents are ranged by id; a task encodes its range in order and cuts the ids into blocks
  of at most `block_ids`, which belong to whole documents unless one is longer than a block.
* One table of frequencies, scaled to 2**20, is counted over all ids and shared by all blocks.
* A block is coded by interleaved 64-bit states, one per lane; id k of a block belongs to
  lane k % lanes, so that all lanes advance together. Words of 32 bits flow out in lane order.
* A block's row holds its first id's place in the whole stream, its documents, the words, the
  states at its beginning and at checkpoints, and the crc32 of its ids, so blocks, and parts
  of them between checkpoints, decode alone and in parallel.

Files are Parquet in the shared folder, one row per block; the frequencies are a file of
their own beside the blocks.

A null or empty text has only the end id. Repeated rows are documents of their own, in the
order of id, then text; null ids come first. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.blocks import checkpoint_dir
from tickloom.llm.bytestext import U, slices, utf8
from tickloom.llm.tokens import encoder, vocabulary
from tickloom.plans.storage import scratch_path

SCALE = 20
LOWEST = U(1 << 31)
RANGE_BYTES = 8 << 20


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to sum to 2**SCALE, at least 1 for every id that occurs."""
    total, target = int(counts.sum()), 1 << SCALE
    if not total:
        return np.zeros(len(counts), np.int64)
    scaled = np.maximum((counts * (target / total)).astype(np.int64), (counts > 0).astype(np.int64))
    excess = int(scaled.sum()) - target
    order = np.argsort(-scaled, kind="stable")[: int((counts > 0).sum())]
    while excess:
        if excess < 0:
            scaled[order[0]] -= excess
            break
        # Every id keeps one; the largest give first.
        give = np.minimum(scaled[order] - 1, np.maximum(1, scaled[order] * excess // target))
        ends = np.cumsum(give)
        give = np.where(ends <= excess, give, np.maximum(0, give - (ends - excess)))
        scaled[order] -= give
        excess -= int(give.sum())
    return scaled


class Coder:
    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(U)
        self.low = (np.cumsum(freq) - freq).astype(U)
        self.limit = self.freq << U(63 - SCALE)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.int32), freq)

    def encode(self, ids: np.ndarray, lanes: int, every: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, states at step 0 and at each checkpoint, and the words read before each."""
        steps = -(-len(ids) // lanes)
        state = np.full(lanes, LOWEST, U)
        words, marks = [], []
        n_words = 0
        for step in range(steps - 1, -1, -1):
            own = ids[step * lanes : (step + 1) * lanes]
            x = state[: len(own)]
            full = x >= self.limit[own]
            if full.any():
                words.append((x[full] & U(0xFFFFFFFF)).astype("<u4"))
                n_words += len(words[-1])
                x = np.where(full, x >> U(32), x)
            freq = self.freq[own]
            high = x // freq
            state[: len(own)] = (high << U(SCALE)) + (x - high * freq) + self.low[own]
            if step % every == 0:
                marks.append((state.copy(), n_words))
        marks.reverse()
        stream = np.concatenate(words[::-1]) if words else np.zeros(0, "<u4")
        states = np.concatenate([m[0] for m in marks]) if marks else np.zeros(0, U)
        return stream, states, np.array([n_words - m[1] for m in marks], np.int64)

    def decode(self, words: np.ndarray, states: np.ndarray, places: np.ndarray, n: int, lanes: int, every: int) -> np.ndarray:
        """All ids of a block; each stretch between checkpoints needs only its own states and words."""
        out = np.zeros(n, np.int32)
        for k, place in enumerate(places.tolist()):
            self._stretch(out, words, states[k * lanes : (k + 1) * lanes].copy(), place, k * every, min((k + 1) * every, -(-n // lanes)), lanes)
        return out

    def _stretch(self, out: np.ndarray, words: np.ndarray, state: np.ndarray, place: int, first: int, last: int, lanes: int) -> None:
        for step in range(first, last):
            at = step * lanes
            m = min(lanes, len(out) - at)
            x = state[:m]
            slot = x & U((1 << SCALE) - 1)
            symbol = self.symbol[slot]
            out[at : at + m] = symbol
            x = self.freq[symbol] * (x >> U(SCALE)) + slot - self.low[symbol]
            short = np.flatnonzero(x < LOWEST)
            if len(short):
                x[short] = (x[short] << U(32)) | words[place : place + len(short)].astype(U)
                place += len(short)
            state[:m] = x


PARTS = "part int, doc long, block int, doc_id long, start long, n_tokens long, ids_crc32 long, cut boolean"


def lanes_for(n: int) -> int:
    return 1 << min(10, max(0, (n // 64).bit_length()))


CODED = "part int, block int, first_doc long, n_ids long, doc_ids binary, doc_valid binary, doc_sizes binary, came boolean, goes boolean, ids binary, counts binary"
BLOCKS = "part int, block int, first_doc long, start long, n_ids long, lanes int, every int, doc_ids binary, doc_valid binary, doc_sizes binary, came boolean, goes boolean, states binary, places binary, words binary, crc32 long"


def _schema(columns: str) -> pa.Schema:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    return pa.schema([(c.split()[0], types[c.split()[1]]) for c in columns.split(", ")])


def _range(first_part: Iterator[pa.RecordBatch], path: str, end_id: int, block_ids: int) -> Iterator[pa.RecordBatch]:
    """Blocks of ids of the task's documents, deflated, and one row with the counts of ids."""
    part, tool = TaskContext.get().partitionId(), encoder(path, True)
    counts = np.zeros(tool.size, np.int64)
    kind = "<u2" if tool.size <= 1 << 16 else "<u4"
    names = [c.split()[0] for c in CODED.split(", ")]
    schema = _schema(CODED)
    block, n_docs, came = 0, 0, False
    pending: list[tuple[int | None, np.ndarray]] = []
    held = 0

    def close(goes: bool = False) -> pa.RecordBatch:
        nonlocal block, n_docs, pending, held, came
        ids = np.concatenate([x for _, x in pending]).astype(kind)
        row = {
            "part": part, "block": block, "first_doc": n_docs, "n_ids": len(ids),
            "doc_ids": np.array([0 if d is None else d for d, _ in pending], "<i8").tobytes(), "doc_valid": bytes(d is not None for d, _ in pending),
            "doc_sizes": np.array([len(x) for _, x in pending], "<i8").tobytes(),
            "came": came, "goes": goes, "ids": pa.compress(ids.tobytes(), "zstd", asbytes=True), "counts": None,
        }
        block, n_docs, pending, held, came = block + 1, n_docs + len(pending) - goes, [], 0, goes
        return pa.RecordBatch.from_pylist([row], schema)

    for batch in first_part:
        numbers = batch.column(0).to_pylist()
        data, offsets = utf8(batch.column(1))
        for first, last in slices(offsets):
            ids, ends = tool.encode(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            counts += np.bincount(ids, minlength=len(counts))
            counts[end_id] += last - first
            for r in range(last - first):
                own = np.append(ids[ends[r] : ends[r + 1]], np.int32(end_id))
                if held and held + len(own) > block_ids:
                    yield close()
                # A document longer than a block goes on in the next one, under the same number.
                while len(own) > block_ids:
                    pending, held = [(numbers[first + r], own[:block_ids])], block_ids
                    yield close(goes=True)
                    own = own[block_ids:]
                pending.append((numbers[first + r], own))
                held += len(own)
    if pending:
        yield close()
    row = dict.fromkeys(names) | {"part": part, "block": -1, "n_ids": int(counts.sum()), "counts": pa.compress(counts.tobytes(), "zstd", asbytes=True)}
    yield pa.RecordBatch.from_pylist([row], schema)


def _counts(payload: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(payload, size * 8, "zstd", asbytes=True), np.int64)


def write(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 0, block_ids: int = 1 << 18, id_column: str = "doc_id", text: str = "text") -> None:
    """Write the ids of all documents, in ascending order of id, below a folder that all executors share."""
    spark = docs.sparkSession
    checkpoint_dir(spark)
    path = path or vocabulary("byte_bpe_50k.json")
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(1, -(-n_bytes // RANGE_BYTES))
    keyed = docs.withColumn("tie", F.xxhash64("text"))
    ranged = keyed.repartitionByRange(n_parts, "id", "tie").sortWithinPartitions("id", "tie").select("id", "text")
    coded = ranged.mapInArrow(lambda batches: _range(batches, path, end_id, block_ids), CODED).checkpoint()
    size = encoder(path, True).size

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([_counts(x, size) for x in table["counts"].to_pylist()], axis=0)
        return pa.table({"counts": pa.array([total.tobytes()], pa.binary())})

    # One array per 64th of the ranges; each has as many entries as the vocabulary.
    sums = coded.where("block = -1").select((F.col("part") % 64).alias("g"), "counts").groupBy("g").applyInArrow(add, "counts binary").collect()
    counts = np.sum([np.frombuffer(r.counts, np.int64) for r in sums], axis=0) if sums else np.zeros(size, np.int64)
    freq = frequencies(counts)
    starts, total = {}, 0
    for r in coded.where("block = -1").select("part", "n_ids").sort("part").collect():
        starts[r.part], total = total, total + r.n_ids
    schema = _schema(BLOCKS)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, at, kind = Coder(freq), {}, "<u2" if size <= 1 << 16 else "<u4"
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] < 0:
                    continue
                n = row["n_ids"]
                raw = pa.decompress(row["ids"], n * np.dtype(kind).itemsize, "zstd", asbytes=True)
                ids = np.frombuffer(raw, kind).astype(np.int64)
                lanes = lanes_for(n)
                every = max(1, -(-n // lanes // 2))
                words, states, places = coder.encode(ids, lanes, every)
                out = {k: row[k] for k in ("part", "block", "first_doc", "n_ids", "doc_ids", "doc_valid", "doc_sizes", "came", "goes")}
                # Blocks of a range stand in order, so their starts add up as they come.
                start = at.get(row["part"], starts[row["part"]])
                at[row["part"]] = start + n
                out |= {"start": start, "lanes": lanes, "every": every, "states": states.tobytes(), "places": places.tobytes(), "words": words.tobytes(), "crc32": zlib.crc32(ids.astype("<u4"))}
                yield pa.RecordBatch.from_pylist([out], schema)

    coded.mapInArrow(encode, BLOCKS).write.parquet(f"{folder}/blocks", compression="none")
    present = np.flatnonzero(freq)
    spark.createDataFrame(pa.table({"id": pa.array(present), "frequency": pa.array(freq[present])})).coalesce(1).write.parquet(f"{folder}/frequencies")


def crc_joined(first: int, second: int, length: int) -> int:
    """The crc32 of two byte strings in a row, from theirs and the second's length."""
    # A string of zero bytes acts on a checksum as a linear map of bits; square it as often as needed.
    def times(m: list[int], v: int) -> int:
        out = 0
        for row in m:
            if v & 1:
                out ^= row
            v >>= 1
        return out

    # One zero bit.
    power = [0xEDB88320] + [1 << k for k in range(31)]
    for _ in range(3):
        power = [times(power, row) for row in power]
    while length:
        if length & 1:
            first = times(power, first)
        power = [times(power, row) for row in power]
        length >>= 1
    return first ^ second


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: id, start, n_tokens and ids_crc32, from the files alone."""
    table = spark.read.parquet(f"{folder}/frequencies").toPandas()  # at most as many rows as the vocabulary
    freq = np.zeros(int(table.id.max()) + 1 if len(table) else 1, np.int64)
    freq[table.id.to_numpy(np.int64)] = table.frequency.to_numpy()
    schema = _schema(PARTS)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(freq)
        for batch in batches:
            for row in batch.to_pylist():
                ids = coder.decode(np.frombuffer(row["words"], "<u4"), np.frombuffer(row["states"], U), np.frombuffer(row["places"], np.int64), row["n_ids"], row["lanes"], row["every"])
                ids = ids.astype("<u4")
                if zlib.crc32(ids) != row["crc32"]:
                    raise ValueError(f"block {row['block']} of range {row['part']} does not match its checksum")
                sizes = np.frombuffer(row["doc_sizes"], "<i8")
                ends = np.cumsum(sizes)
                m = len(sizes)
                cut = np.zeros(m, bool)
                cut[0], cut[-1] = row["came"], row["goes"] or (m == 1 and row["came"])
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array(np.full(m, row["part"], np.int32)),
                        "doc": pa.array(np.arange(m) + row["first_doc"]),
                        "block": pa.array(np.full(m, row["block"], np.int32)),
                        "doc_id": pa.array(np.frombuffer(row["doc_ids"], "<i8"), mask=np.frombuffer(row["doc_valid"], np.uint8) == 0),
                        "start": pa.array(row["start"] + ends - sizes),
                        "n_tokens": pa.array(sizes),
                        "ids_crc32": pa.array([zlib.crc32(ids[z - n : z]) for z, n in zip(ends.tolist(), sizes.tolist(), strict=True)], pa.int64()),
                        "cut": pa.array(cut),
                    },
                    schema,
                )

    def join(table: pa.Table) -> pa.Table:
        rows = table.sort_by("block").to_pylist()
        crc = rows[0]["ids_crc32"]
        for r in rows[1:]:
            crc = crc_joined(crc, r["ids_crc32"], 4 * r["n_tokens"])
        return pa.Table.from_pylist([rows[0] | {"n_tokens": sum(r["n_tokens"] for r in rows), "ids_crc32": crc}], table.schema)

    blocks = spark.read.parquet(f"{folder}/blocks")
    whole = blocks.mapInArrow(decode, PARTS).where("not cut")
    # Only blocks that a long document shares are read again, to put its parts together.
    shared = blocks.where("came or goes").mapInArrow(decode, PARTS).where("cut")
    joined = shared.groupBy("part", "doc").applyInArrow(join, PARTS)
    return whole.unionByName(joined).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    out = scratch_path(spark, "ids")
    write(spark.read.parquet(f"{folder}/documents.parquet"), out)
    return read(spark, out)
