"""Language of texts by the nearest of several centroids per language.

* Features: byte n-grams of 1 to `GRAMS` bytes over letters, with everything else as one
  blank, ASCII and Latin-1 capitals lower-cased, hashed into `WIDTH` columns; weight
  (1 + log tf) * idf, scaled to length one. Texts are read whole.
* Document frequencies cover all training documents.
* Centroids: spherical k-means per language over a sample of training documents, bounded by
  `sample` per language in expectation and chosen by a hash of the row; the only bound on
  what the classifier sees. Each centroid keeps the least similarity of its own sample.
* Prediction: the language of the centroid of greatest cosine. A text is rejected where
  that cosine is below `slack` times the centroid's least similarity, and where it has no
  letters. The default `slack` is so low that hardly any text with letters is rejected.

Training documents have a language and an id whose CRC-32, as text, leaves another remainder
than `fold` by `folds`; null ids are never learned from and never held out. Null texts
and texts without letters are `und` with score 0 and rejected. If nothing was learned, all
texts are `und` with score 0, and those with letters are not rejected.
Ties go to the language that sorts first. Repeated rows get the same answer each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.bytestext import U, lean, mix, slices, utf8

WIDTH = 1 << 13
GRAMS = 4
UNKNOWN = "und"
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 256)
for _c in range(26):
    _FOLD[[65 + _c, 97 + _c]] = 97 + _c


def letters(data: np.ndarray) -> np.ndarray:
    """Bytes with capitals folded and all but letters blank; multi-byte marks count as letters."""
    out = _FOLD[data]
    if len(data) > 1:
        capital = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][capital] += 0x20
    return out


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def columns_of(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature columns of one text and how often each occurs."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    blank = text == 0x20
    # Runs of blanks count once, and a text begins and ends with one.
    kept = text[~(blank & np.concatenate([[True], blank[:-1]]))]
    kept = np.concatenate([[0x20], kept, [0x20]]).astype(np.uint32)
    counts = np.zeros(WIDTH, np.int64)
    code = kept.copy()
    for k in range(1, GRAMS + 1):
        counts += np.bincount((code * np.uint32(0x9E3779B1) + np.uint32(k * 0x7F4A7C15 % (1 << 32))) >> np.uint32(32 - 13), minlength=WIDTH)
        if k < GRAMS:
            code = (code[:-1] << np.uint32(8)) ^ kept[k:]
    at = np.flatnonzero(counts)
    return at, counts[at]


def _texts(batch_column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    data, offsets = utf8(batch_column)
    for first, last in slices(offsets):
        own = letters(data[offsets[first] : offsets[last]])
        for r in range(first, last):
            yield r, own[offsets[r] - offsets[first] : offsets[r + 1] - offsets[first]]


def weights(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = (1 + np.log(counts)) * idf[at]
    size = np.sqrt((out * out).sum())
    return (out / size if size else out).astype(np.float32)


def spherical_kmeans(rows: np.ndarray, k: int, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids, and the least cosine of each one's rows. Starts from spread-out rows."""
    chosen = [0]
    nearest = rows @ rows[0]
    while len(chosen) < min(k, len(rows)):
        chosen.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, rows @ rows[chosen[-1]])
    centers = rows[chosen]
    for _ in range(rounds):
        own = np.argmax(rows @ centers.T, axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, rows)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        # A centroid without rows stays where it is.
        centers = np.where(size > 0, sums / np.where(size > 0, size, 1), centers)
    cosines = rows @ centers.T
    own = np.argmax(cosines, axis=1)
    least = np.array([cosines[own == c, c].min() if (own == c).any() else 1.0 for c in range(len(centers))])
    return centers, least


@dataclass
class Model:
    languages: list[str]
    centers: np.ndarray
    least: np.ndarray
    idf: np.ndarray

    def predict(self, at: np.ndarray, counts: np.ndarray) -> tuple[int, float]:
        """Centroid and cosine."""
        cosines = self.centers[:, at] @ weights(at, counts, self.idf)
        best = int(np.argmax(cosines))
        return best, float(min(1.0, max(0.0, cosines[best])))


def held_out(id_column: str, folds: int, fold: int):
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % folds == fold


def train(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 4, fold: int = 2, centroids: int = 4, sample: int = 1000) -> Model | None:
    learned = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang"))
    learned = learned.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out("id", folds, fold))
    rates = {r.lang: sample / r.n for r in learned.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not rates:
        return None

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sample's features, and one row with the document frequencies of the task's rows."""
        frequency = np.zeros(WIDTH + 1, np.int64)
        for batch in batches:
            rows = []
            lang_of, lot = batch.column(1).to_pylist(), mix(batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64).astype(U))
            for r, own in _texts(batch.column(0)):
                at, counts = columns_of(own)
                frequency[at] += 1
                frequency[WIDTH] += 1
                if lot[r] / 2.0**64 < rates[lang_of[r]]:
                    rows.append((lang_of[r], at.astype("<i4").tobytes(), counts.astype("<i8").tobytes()))
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(("lang", "places", "counts"), map(list, zip(*rows, strict=True)), strict=True)))
        yield pa.RecordBatch.from_pydict({"lang": pa.array([None], pa.string()), "places": pa.array([b""], pa.binary()), "counts": [frequency.astype("<i8").tobytes()]})

    lot = F.xxhash64("id", "text")
    gathered = learned.select("text", "lang", lot.alias("lot")).mapInArrow(lean(gather), "lang string, places binary, counts binary").checkpoint()

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.frombuffer(x, "<i8") for x in table["counts"].to_pylist()], axis=0)
        return pa.table({"counts": [total.tobytes()]})

    # At most 64 rows of WIDTH numbers reach the driver.
    parts = gathered.where("lang is null").select(F.pmod(F.xxhash64("counts"), F.lit(64)).alias("g"), "counts").groupBy("g").applyInArrow(add, "counts binary").collect()
    total = np.sum([np.frombuffer(r.counts, "<i8") for r in parts], axis=0)
    idf = np.log((1 + total[WIDTH]) / (1 + total[:WIDTH])) + 1

    def cluster(table: pa.Table) -> pa.Table:
        # A fixed order: the same sample always gives the same centroids.
        table = table.sort_by([("places", "ascending"), ("counts", "ascending")])
        rows = np.zeros((len(table), WIDTH), np.float32)
        for i, (p, c) in enumerate(zip(table["places"].to_pylist(), table["counts"].to_pylist(), strict=True)):
            at = np.frombuffer(p, "<i4")
            rows[i, at] = weights(at, np.frombuffer(c, "<i8"), idf)
        centers, least = spherical_kmeans(rows[np.abs(rows).sum(axis=1) > 0], centroids) if rows.any() else (np.zeros((0, WIDTH), np.float32), np.zeros(0))
        return pa.table({"lang": pa.array([table["lang"][0].as_py()] * len(centers), pa.string()), "center": pa.array([x.astype("<f4").tobytes() for x in centers], pa.binary()), "least": pa.array(least.astype(float), pa.float64())})

    # `centroids` rows of WIDTH numbers per language.
    found = gathered.where("lang is not null").groupBy("lang").applyInArrow(cluster, "lang string, center binary, least double").collect()
    if not found:
        return None
    found = sorted(found, key=lambda r: (r.lang, r.center))
    return Model([r.lang for r in found], np.stack([np.frombuffer(r.center, "<f4") for r in found]), np.array([r.least for r in found]), idf)


def identify(docs: DataFrame, model: Model | None, text: str = "text", slack: float = 0.1, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (default: all) with lang_pred, score and rejected; columns of these names are replaced."""
    added = ("lang_pred", "score", "rejected")
    kept = [c for c in (docs.columns if keep is None else keep) if c not in added]
    # The text goes to the workers once, as what it is among the kept columns or as one more.
    table = docs.select(*[F.col(f"`{c}`") for c in kept])
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields]
    if text not in kept:
        table = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`"))
    at = table.columns.index(text)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            names, scores, rejected = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
            column = batch.column(at).cast(pa.string())
            for r, own in _texts(column):
                # Marks beyond ASCII may be signs; only then is the text itself searched.
                if not (own != 0x20).any() or not (((own >= 97) & (own <= 122)).any() or has_letter(column[r].as_py())):
                    continue
                if model is None:
                    rejected[r] = False
                    continue
                best, scores[r] = model.predict(*columns_of(own))
                names[r] = model.languages[best]
                rejected[r] = scores[r] < slack * model.least[best]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(names, pa.string()), pa.array(scores), pa.array(rejected)], names=[*kept, *added])

    return table.mapInArrow(lean(predict), ", ".join([*kinds, "lang_pred string, score double, rejected boolean"]))


def op9_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = docs.select("doc_id", "text", F.coalesce(held_out("doc_id", 4, 2), F.lit(False)).alias("held_out"))
    model = train(docs)
    return identify(rows, model, keep=["doc_id", "held_out"])
