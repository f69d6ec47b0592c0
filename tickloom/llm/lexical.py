"""Ranked lexical search with range-maximum tables over posting lists.

* Documents are indexed in blocks: one row per block and term with the documents' places and
  term frequencies, places ascending by document id, and one row with ids and lengths.
* For a block, every posting list of a searched term gets a sparse table: the place of the
  largest impact among 2**k consecutive postings, for every k and start. Two overlapping spans
  answer any range maximum.
* An item is searched best interval first. An interval of documents is bounded by the sum, over
  the item's terms, of the range maximum times the term's weight. The interval of the highest
  bound is split at the document of its greatest single impact: that document is scored exactly,
  and the intervals on its two sides get bounds of their own. `BEAM` intervals are taken at a time,
  so that range maxima are answered in arrays; intervals of at most `LEAF` documents are scored
  whole. An interval ends when its bound is below the score that the item's k-th best document has
  by then, or equal to it with larger ids only. Best documents are carried from block to block of a task.

A term is a run of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. Its weight
is floor(1000 * ln((2 N + 2) / (2 df + 1))); a document's score is the sum of
weight * ((10**9 tf) div (1000 tf + 12 m)) over the item's terms with repeats, with
m = 75 + (25 n N) div L. All counts cover all documents.

Items are searched in parts of at most `PART_TERMS` of their distinct terms; a part is broadcast,
and its results are stored before the next one starts. Postings of terms that no item has stay where they
are stored. A block's postings are bounded by its text, however frequent a term is.

Null and empty texts have no terms: such documents aren't counted, such items find nothing. Texts
are cut into words piece by piece, whatever their length. Documents without an id count in all
statistics but aren't returned. Repeated documents are documents of their own and rank one after
another; an item repeated with the same text is searched once, items that share an id but not
the text are ranked apart. Equal scores rank by document id. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.llm.bytestext import counted
from tickloom.plans.storage import cut

BLOCK_BYTES = 8 << 20
TASK_BYTES = 64 << 20
PART_TERMS = 1 << 18
BEAM = 32
LEAF = 32
PIECE = 1 << 20

_TERM_BYTES = {*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)}
_FOLD = bytes((b + 32 if 0x41 <= b < 0x5B else b) if b in _TERM_BYTES else 0x20 for b in range(256))


def term_counts(text: bytes) -> Counter:
    """How often each term occurs."""
    found: Counter = Counter()
    first = 0
    while first < len(text):
        piece = text[first : first + PIECE].translate(_FOLD)
        if first + PIECE < len(text):
            # A word that the cut may have split goes to the next piece, unless it fills this one.
            last = piece.rfind(b" ") + 1
            while not last:
                piece += text[first + len(piece) : first + 2 * len(piece)].translate(_FOLD)
                last = len(piece) if first + len(piece) >= len(text) else piece.rfind(b" ") + 1
            piece = piece[:last]
        found.update(piece.split())
        first += len(piece)
    return found


POSTINGS = "block long, term binary, n long, places binary, values binary"


def _block(number: int, ids: list[int | None], found: list[Counter]) -> pa.RecordBatch:
    """Rows of a block: ids and lengths with a null term, then a row per term."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    vocabulary: dict[bytes, int] = {}
    terms, sizes, counts = [], [], []
    for i in order:
        own = found[i]
        terms.append(np.fromiter((vocabulary.setdefault(t, len(vocabulary)) for t in own), np.int64, len(own)))
        counts.append(np.fromiter(own.values(), np.int64, len(own)))
        sizes.append(len(own))
    # Documents without an id come last; their places take part in no search.
    named = np.array([ids[i] for i in order if ids[i] is not None], np.int64)
    lengths = np.array([c.sum() for c in counts], np.int64)
    term, tf = np.concatenate(terms), np.concatenate(counts)
    place = np.repeat(np.arange(len(order), dtype=np.int32), sizes)
    by_term = np.argsort(term, kind="stable")
    places, values = place[by_term], tf[by_term].astype(np.int32)
    n = np.bincount(term, minlength=len(vocabulary))
    ends = np.cumsum(n)
    starts = ends - n
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.full(len(n) + 1, number)),
            pa.array([None, *vocabulary], pa.binary()),
            pa.array(np.concatenate([[lengths.sum()], n])),
            pa.array([named.tobytes(), *(places[a:z].tobytes() for a, z in zip(starts, ends, strict=True))], pa.binary()),
            pa.array([lengths.tobytes(), *(values[a:z].tobytes() for a, z in zip(starts, ends, strict=True))], pa.binary()),
        ],
        names=["block", "term", "n", "places", "values"],
    )


def build_index(docs: DataFrame, id_column: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """A stored table of posting lists by block and term; see POSTINGS."""
    table = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).cast("string").cast("binary").alias("text"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, ids, found, size = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                if not value.is_valid:
                    continue
                own = term_counts(value.as_py())
                if not own:
                    continue
                ids.append(key.as_py())
                found.append(own)
                size += len(value.as_buffer())
                if size >= block_bytes:
                    yield _block(number, ids, found)
                    number, ids, found, size = number + 1, [], [], 0
        if ids:
            yield _block(number, ids, found)

    return cut(table.mapInArrow(index, POSTINGS))


def item_terms(items: DataFrame, id_column: str = "item_id", text: str = "text") -> DataFrame:
    """item, key, term, times: each item's terms; `key` tells items of one id apart."""
    table = items.select(F.col(id_column).cast("long").alias("item"), F.col(text).cast("string").cast("binary").alias("text"))
    table = table.where(F.col("item").isNotNull() & F.col("text").isNotNull()).withColumn("key", F.md5("text")).dropDuplicates(["item", "key"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = term_counts(text)
                yield pa.RecordBatch.from_pydict(
                    {"item": pa.array([item] * len(own), pa.int64()), "key": pa.array([key] * len(own), pa.string()), "term": pa.array(list(own), pa.binary()), "times": pa.array(list(own.values()), pa.int64())}
                )

    return table.select("item", "text", "key").mapInArrow(split, "item long, key string, term binary, times long")


class RangeMaxima:
    """Posting lists one after another, with a sparse table of the places of maxima."""

    def __init__(self, n_docs: int, terms: np.ndarray, places: np.ndarray, impacts: np.ndarray):
        """Postings in order of (term, place); terms are numbers of the block's lists."""
        self.n_docs, self.places, self.impacts = n_docs, places, impacts
        self.keys = terms * np.int64(n_docs + 1) + places
        longest = int(np.bincount(terms).max(initial=0))
        levels = [np.arange(len(places), dtype=np.int32)]
        while 2 << (len(levels) - 1) <= longest:
            step = 1 << (len(levels) - 1)
            a, b = levels[-1][:-step], levels[-1][step:]
            # Spans over the end of a list are never asked for. Of equal impacts the first counts.
            level = levels[-1].copy()
            level[: len(a)] = np.where(impacts[a] >= impacts[b], a, b)
            levels.append(level)
        self.levels = np.stack(levels)
        self.log = np.zeros(longest + 1, np.int64)
        for k in range(1, len(levels)):
            self.log[1 << k :] = k

    def ranges(self, terms: np.ndarray, places: np.ndarray) -> np.ndarray:
        """For each place and term, the first posting at or after the place."""
        return np.searchsorted(self.keys, places[:, None] + terms[None, :] * np.int64(self.n_docs + 1))

    def maxima(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest impact among postings low..high-1, 0 if there are none, and its posting."""
        size = high - low
        some = size > 0
        level = self.log[np.where(some, size, 1)]
        a = self.levels[level, np.where(some, low, 0)]
        b = self.levels[level, np.where(some, high - (1 << level), 0)]
        best = np.where(self.impacts[a] >= self.impacts[b], a, b)
        return np.where(some, self.impacts[best], 0), best

    def scores(self, low: np.ndarray, high: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of all documents with a posting in ranges of terms, by interval."""
        size = (high - low).ravel()
        at = counted(low.ravel(), size)
        gain = self.impacts[at] * np.repeat(np.broadcast_to(weights, low.shape).ravel(), size)
        places = self.places[at]
        found, which = np.unique(places, return_inverse=True)
        total = np.zeros(len(found), np.int64)
        np.add.at(total, which, gain)
        return found.astype(np.int64), total


class Best:
    """An item's k best (score, id), kept across blocks."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        keep = scores > 0
        if len(self.scores) == self.k:
            keep &= scores >= self.scores[-1]
        if not keep.any():
            return
        scores, ids = np.concatenate([self.scores, scores[keep]]), np.concatenate([self.ids, ids[keep]])
        order = np.lexsort([ids, -scores])[: self.k]
        self.scores, self.ids = scores[order], ids[order]

    def may_enter(self, bounds: np.ndarray, least_ids: np.ndarray) -> np.ndarray:
        if len(self.scores) < self.k:
            return bounds > 0
        return (bounds > self.scores[-1]) | ((bounds == self.scores[-1]) & (least_ids <= self.ids[-1]))


def search_block(index: RangeMaxima, ids: np.ndarray, terms: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """Put the block's best documents for an item into `best`; returns how many were scored singly."""
    n_single = 0
    # Intervals: first place, place after the last, bound, place to split at.
    first, last = np.zeros(1, np.int64), np.array([len(ids)], np.int64)

    def bounded(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
        low, high = index.ranges(terms, first), index.ranges(terms, last)
        value, posting = index.maxima(low, high)
        value *= weights
        top = posting[np.arange(len(first)), value.argmax(axis=1)]
        bound = value.sum(axis=1)
        small = last - first <= LEAF
        small &= best.may_enter(bound, ids[first])
        if small.any():
            places, scores = index.scores(low[small], high[small], weights)
            best.add(scores, ids[places])
        keep = (last - first > LEAF) & best.may_enter(bound, ids[first])
        return first[keep], last[keep], bound[keep], index.places[top[keep]].astype(np.int64)

    intervals = bounded(first, last) if len(ids) else (first[:0], last[:0], first[:0], first[:0])
    while len(intervals[0]):
        first, last, bound, middle = intervals
        open_ = best.may_enter(bound, ids[first])
        if not open_.all():
            first, last, bound, middle = (x[open_] for x in intervals)
        if not len(first):
            break
        if len(first) > BEAM:
            split = np.argpartition(-bound, BEAM)
            now, rest = split[:BEAM], split[BEAM:]
        else:
            now, rest = np.arange(len(first)), np.zeros(0, np.int64)
        d = middle[now]
        n_single += len(d)
        low = index.ranges(terms, d)
        best.add(*_single(index, low, index.ranges(terms, d + 1), weights, d, ids))
        a, z = np.concatenate([first[now], d + 1]), np.concatenate([d, last[now]])
        some = a < z
        new = bounded(a[some], z[some])
        intervals = tuple(np.concatenate([old[rest], x]) for old, x in zip((first, last, bound, middle), new, strict=True))
    return n_single


def _single(index: RangeMaxima, low: np.ndarray, high: np.ndarray, weights: np.ndarray, places: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of single documents."""
    hit = high > low
    gain = np.where(hit, index.impacts[np.where(hit, low, 0)], 0) * weights
    return gain.sum(axis=1), ids[places]


def impacts(tf: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """The part of a score that a posting gives to each unit of weight."""
    m = 75 + (25 * lengths * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Items:
    """Searched items, as term numbers and weights."""

    def __init__(self, rows: list, k: int):
        self.k = k
        self.numbers: dict[bytes, int] = {}
        self.items: dict[tuple[int, str], tuple[list[int], list[int]]] = {}
        for item, key, term, weight in rows:
            terms, weights = self.items.setdefault((item, key), ([], []))
            terms.append(self.numbers.setdefault(term, len(self.numbers)))
            weights.append(weight)

    def search(self, rows: Iterator[tuple[int, list[tuple]]], n_docs: int, n_terms: int) -> Iterator[tuple[int, str, int, int]]:
        """The best documents of the blocks for each item."""
        found = {i: Best(self.k) for i in self.items}
        arrays = {i: (np.array(t, np.int64), np.array(w, np.int64)) for i, (t, w) in self.items.items()}
        for _, lists in rows:
            head = next(x for x in lists if x[0] is None)
            ids, lengths = np.frombuffer(head[1], np.int64), np.frombuffer(head[2], np.int64)
            own = [x for x in lists if x[0] is not None]
            if not own or not len(ids):
                continue
            places = [np.frombuffer(p, np.int32) for _, p, _ in own]
            tf = np.concatenate([np.frombuffer(v, np.int32) for *_, v in own]).astype(np.int64)
            sizes = [len(p) for p in places]
            places = np.concatenate(places)
            terms = np.repeat(np.arange(len(own)), sizes)
            # Places beyond the ids belong to documents without one.
            named = places < len(ids)
            index = RangeMaxima(len(lengths), terms[named], places[named], impacts(tf, lengths[places], n_docs, n_terms)[named])
            if not len(index.places):
                continue
            local = np.full(len(self.numbers), -1)
            local[[self.numbers[t] for t, *_ in own]] = np.arange(len(own))
            for i, (numbers, weights) in arrays.items():
                here = local[numbers]
                held = here >= 0
                if held.any():
                    search_block(index, ids, here[held], weights[held], found[i])
        for (item, key), best in found.items():
            for score, number in zip(best.scores.tolist(), best.ids.tolist(), strict=True):
                yield item, key, number, score


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    held, rows = None, []
    for batch in batches:
        for block, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block != held:
                if rows:
                    yield held, rows
                held, rows = block, []
            rows.append(tuple(row))
    if rows:
        yield held, rows


def search(index: DataFrame, terms: DataFrame, k: int = 20) -> DataFrame:
    """item, rank, doc, score from a stored index and the rows of `item_terms`."""
    spark = index.sparkSession
    terms = cut(terms)
    total = index.where("term IS NULL").agg(F.sum(F.octet_length("values") / 8).cast("long"), F.sum("n")).first()
    n_docs, n_terms = total[0] or 0, total[1] or 0
    wanted = terms.select("term").distinct()
    df = index.where("term IS NOT NULL").select("term", "n").join(wanted, "term").groupBy("term").agg(F.sum("n").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))) * F.col("times")
    weighted = cut(terms.join(df, "term").select("item", "key", "term", weight.alias("weight")).where("weight > 0"))
    sizes = weighted.agg(F.count("*")).first()[0]
    n_parts = max(1, -(-sizes // PART_TERMS))
    volume = index.agg(F.sum(F.octet_length("places"))).first()[0] or 0
    n_tasks = max(spark.sparkContext.defaultParallelism, -(-volume // TASK_BYTES))
    part = F.pmod(F.xxhash64("item", "key"), F.lit(n_parts))
    results = []
    for number in range(n_parts):
        own = weighted.where(part == number)
        # Plain tuples: workers need no import to read them.
        items = spark.sparkContext.broadcast([(r.item, r.key, bytes(r.term), r.weight) for r in own.collect()])

        def run(batches: Iterator[pa.RecordBatch], items=items) -> Iterator[pa.RecordBatch]:
            rows = list(Items(items.value, k).search(_blocks(batches), n_docs, n_terms))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["item", "key", "doc", "score"])

        lists = index.select("block", "term", "places", "values")
        heads = lists.where("term IS NULL")
        lists = heads.unionByName(lists.join(own.select("term").distinct(), "term").select(*lists.columns))
        lists = lists.repartition(n_tasks, "block").sortWithinPartitions("block")
        found = lists.mapInArrow(run, "item long, key string, doc long, score long")
        order = Window.partitionBy("item", "key").orderBy(F.desc("score"), "doc")
        found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        # A part's items are freed before the next part's are collected.
        results.append(found if n_parts == 1 else cut(found))
        if n_parts > 1:
            items.destroy()
    found = results[0]
    for other in results[1:]:
        found = found.unionByName(other)
    return found.select("item", "key", "rank", "doc", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, id_column: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents for each item."""
    found = search(build_index(docs, id_column, text), item_terms(items, item_id, item_text), k)
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))


_TERMS = """
SELECT {id} AS id, {key} AS key, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM {table}"""

SQL = f"""
WITH t AS ({_TERMS.format(id="doc_id", key="row_number() OVER ()", table="documents")}),
p AS (SELECT id, key, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT key, sum(tf)::BIGINT AS n FROM p GROUP BY key),
c AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM d),
w AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY term, n_docs),
b AS (SELECT id, term, count(*) AS times FROM ({_TERMS.format(id="item_id", key="0", table="(SELECT DISTINCT item_id, text FROM benchmark)")}) GROUP BY id, term),
s AS (SELECT b.id AS item_id, p.id AS doc_id, p.key, sum(b.times * w.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM b JOIN w USING (term) JOIN p USING (term) JOIN d ON d.key = p.key, c WHERE p.id IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20"""
