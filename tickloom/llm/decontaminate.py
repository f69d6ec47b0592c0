"""Test items inside documents, by size-partitioned MinHash containment search.

* Items are partitioned by the number of their shingles, in powers of two. A partition's
  signature has as many minwise tokens as its smallest item has shingles, TOKENS at most.
* Each minwise token of an item is a random one of its shingles, so a document that holds a
  share c of the item holds the token with probability c, however long the document is. At
  c = 0.8 all of 12 tokens miss with probability 4e-9; smaller items are indexed whole.
* A document that holds a token is a candidate. It is verified by exact containment: the
  share of the item's distinct shingles that are among the document's.

The index is broadcast in parts of at most `PART_BYTES` of item texts; each part is searched
in one narrow pass over the documents, so more items mean more passes, not larger tasks.

Words are runs of bytes other than ASCII white space, A-Z lower-cased. Null, empty and short
texts have no shingles: such documents hold nothing, such items are found nowhere. Repeated
rows are reported once each. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.bytestext import LOWER, U, lean, mix, runs_of_words, slices, utf8, word_bounds, word_hashes

TOKENS = 12
PART_BYTES = 8 << 20
FOUND = "doc_id long, item_id long, n_shingles long, n_shared long"


def _grams(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes, the row of each, and whether its words are all in that row."""
    starts, ends, rows = word_bounds(data, offsets)
    grams = runs_of_words(word_hashes(data, starts, ends), words)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(rows))[: len(grams)]
    whole = np.arange(len(grams)) + words <= rows[row + 1]
    return grams, row, whole


def _minwise(own: np.ndarray) -> list[int]:
    """An item's distinct minwise tokens, as many as its size partition has."""
    n_tokens = min(TOKENS, 1 << (len(own).bit_length() - 1))
    chosen, seed = [], 0
    while len(chosen) < n_tokens:
        seed += 1
        token = own[np.argmin(mix(own ^ U(seed * 0x9E3779B97F4A7C15 % (1 << 64))))]
        if token not in chosen:
            chosen.append(token)
    return chosen


class Index:
    def __init__(self, ids: list[int], texts: list[str], words: int):
        self.words, self.ids, self.sets = words, [], []
        tokens, owners = [], []
        data, offsets = utf8(pa.array(texts, pa.string()))
        grams, row, whole = _grams(LOWER[data], offsets, words)
        for k, number in enumerate(ids):
            own = np.unique(grams[(row == k) & whole])
            if not len(own):
                continue
            chosen = _minwise(own)
            tokens += chosen
            owners += [len(self.ids)] * len(chosen)
            self.ids.append(number)
            self.sets.append(own)
        order = np.argsort(np.array(tokens, U), kind="stable")
        self.tokens, self.owners = np.array(tokens, U)[order], np.array(owners, np.int64)[order]
        #: Whether any token ends in these bits: rules out most shingles at once.
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.tokens & U((1 << 20) - 1)).astype(np.int64)] = True

    def search(self, data: np.ndarray, offsets: np.ndarray, percent: int) -> Iterator[tuple[int, int, int, int]]:
        """Row, item id, and the item's shingles and how many of them the row has."""
        grams, row, whole = _grams(LOWER[data], offsets, self.words)
        at = np.flatnonzero(self.sieve[(grams & U((1 << 20) - 1)).astype(np.int64)] & whole)
        low, high = np.searchsorted(self.tokens, grams[at]), np.searchsorted(self.tokens, grams[at], "right")
        pairs = {(int(row[i]), int(k)) for i, a, z in zip(at, low, high, strict=True) for k in self.owners[a:z]}
        held, own = -1, None
        for r, k in sorted(pairs):
            if r != held:
                first, last = np.searchsorted(row, [r, r + 1])
                held, own = r, grams[first:last][whole[first:last]]
            n = len(self.sets[k])
            shared = int(np.isin(self.sets[k], own).sum())
            if 100 * shared >= percent * n:
                yield r, self.ids[k], n, shared


def _parts(items: DataFrame, item_id: str, item_text: str, words: int) -> Iterator[Index]:
    """Indexes of parts of the items, each of about half of PART_BYTES; one where there are no items."""
    items = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")).where("text is not null")
    n_bytes = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_parts = max(1, -(-2 * n_bytes // PART_BYTES))
    for k in range(n_parts):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n_parts)) == k).collect()
        yield Index([r.id for r in part], [r.text for r in part], words)


def _search(column: pa.Array, index: Index, percent: int) -> list[tuple[int, int | None, int, int]]:
    data, offsets = utf8(column)
    rows = []
    for first, last in slices(offsets):
        own = data[offsets[first] : offsets[last]]
        rows += [(first + r, *x) for r, *x in index.search(own, offsets[first : last + 1] - offsets[first], percent)]
    return rows


def contained_items(docs: DataFrame, items: DataFrame, words: int = 5, percent: int = 80, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per document and item that it holds: the ids, n_shingles, n_shared, containment."""
    table = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def pairs(index: Index) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                columns = list(zip(*_search(batch.column(1), index, percent), strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(columns[0], pa.int64())), *(pa.array(c, pa.int64()) for c in columns[1:])],
                    names=["doc_id", "item_id", "n_shingles", "n_shared"],
                )

        return table.mapInArrow(lean(search), FOUND)

    found = None
    for index in _parts(items, item_id, item_text, words):
        found = pairs(index) if found is None else found.unionByName(pairs(index))
    return found.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def without_items(docs: DataFrame, items: DataFrame, words: int = 5, percent: int = 80, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The documents that hold no item; nothing is shuffled."""

    def free(table: DataFrame, index: Index) -> DataFrame:
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = {r for r, *_ in _search(batch.column(at).cast(pa.string()), index, percent)}
                yield batch.take(pa.array([r for r in range(batch.num_rows) if r not in held], pa.int64()))

        return table.mapInArrow(lean(keep), table.schema)

    at = docs.columns.index(text)
    for index in _parts(items, item_id, item_text, words):
        docs = free(docs, index)
    return docs


def op10_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return contained_items(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))


_SHINGLES = """
SELECT DISTINCT id, list_aggregate(w[i : i + 4], 'string_agg', ' ') AS g FROM (
  SELECT id, w, unnest(range(1, len(w) - 3)) AS i FROM (
    SELECT {id} AS id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
    FROM {table}))"""

SQL = f"""
WITH d AS ({_SHINGLES.format(id="doc_id", table="documents")}),
b AS ({_SHINGLES.format(id="item_id", table="benchmark")}),
n AS (SELECT id, count(*) AS n FROM b GROUP BY id),
s AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared FROM b JOIN d USING (g) GROUP BY 1, 2)
SELECT doc_id, item_id, n AS n_shingles, n_shared, n_shared / n AS containment
FROM s JOIN n ON n.id = s.item_id WHERE 100 * n_shared >= 80 * n"""
