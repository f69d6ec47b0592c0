"""Near copies by a chosen-path similarity join over shingle sets.

* Sets: the distinct `words`-word shingles of a text, A-Z lower-cased; a text with fewer
  words has its whole sequence as one shingle, one without words has none.
* Trees: in each of `trees` independent trees a document follows its minwise tokens under
  `DEPTH` hash functions to a node. Two documents of similarity 0.8 part in all of 16 trees
  with probability (1 - 0.8**3)**16, about 1 in 100,000.
* Small nodes are compared exhaustively by `FUNCTIONS` minwise sketches. Pairs whose estimate
  reaches the threshold less 0.15 (four standard deviations) tie documents into groups.
* Recursion: in a node of more than `NODE` documents `PIVOTS` of them are compared with all.
  Those within `RING` equal places of a pivot are one group with it. Two sketches that tie
  differ in a bounded number of places, so by the triangle inequality a document that many
  places above the ring has all its ties in the group, and leaves the node; if nothing is
  outside a pivot's ring, the whole node does. No tie is lost by that. Where more than `NODE`
  documents are left, they branch on four further tokens in `REPEATS` independent ways.
* Confirmation: full sets meet once per group, and pairs in it are compared exactly, so
  a link that some tree has missed inside a group is found as well. Groups too large for
  a task are cut into slices, and each pair of slices is compared. In groups of more than
  `SLICES` slices `HUBS` documents are compared with all first: pairs that these links connect,
  and documents that are closer to a hub than anything unconnected can allow, need no more.

Only documents that share a node travel as sketches, and only documents in a group as sets.
Copies of a text are one document throughout. Links leave a task as stars, never as pairs.

Null texts count as empty. Documents without shingles are linked with nothing, not even with
each other. Repeated rows are copies. A null id is never a component's id, and its row is not
kept. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm import blocks
from tickloom.llm.blocks import Block, bucket_of
from tickloom.llm.bytestext import LOWER, U, lean, mix, runs_of_words, slices, word_bounds, word_hashes
from tickloom.llm.components import components

FUNCTIONS = 128
DEPTH = 3
NODE = 4096
PIVOTS = 8
RING = FUNCTIONS // 5
REPEATS = 8
LEVELS = 6
SLICE_SETS = 1024
SLICE_SHINGLES = 2_000_000
SLICES = 4
HUBS = 16
_FACTORS = mix(np.arange(1, FUNCTIONS + 1, dtype=U)) | U(1)


def shingle_sets(block: Block, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row and sorted shingle hashes of each text that has words."""
    for first, last in slices(block.offsets):
        offsets = block.offsets[first : last + 1]
        data = LOWER[block.data[offsets[0] : offsets[-1]]]
        starts, ends, rows = word_bounds(data, offsets - offsets[0])
        hashes = word_hashes(data, starts, ends)
        grams = runs_of_words(hashes, words)
        for r in range(last - first):
            low, high = rows[r], rows[r + 1]
            if high - low >= words:
                yield first + r, np.unique(grams[low : high - words + 1])
            elif high > low:
                # One shingle; its hash depends on the number of words.
                yield first + r, mix(runs_of_words(hashes[low:high], high - low) + U(high - low))


def minwise(shingles: np.ndarray) -> np.ndarray:
    out = np.empty(FUNCTIONS, U)
    step = max(1, (1 << 19) // len(shingles))
    for k in range(0, FUNCTIONS, step):
        out[k : k + step] = (shingles[None, :] * _FACTORS[k : k + step, None]).min(axis=1)
    return mix(out)


def _nodes(least: np.ndarray, trees: int) -> np.ndarray:
    own = np.arange(trees, dtype=U) * U(0x9E3779B97F4A7C15)
    for k in range(DEPTH):
        own = mix(own ^ least[k * trees : (k + 1) * trees])
    return own


def _id(block: int, key: bytes) -> bytes:
    return block.to_bytes(4, "big") + key


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least connected number for each of n numbers."""
    label = np.arange(n)
    while len(left):
        # Labels are roots here. A root that gets a lesser one takes its whole tree along.
        a, b = label[left], label[right]
        least = np.minimum(a, b)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        while (label[label] != label).any():
            label = label[label]
        keep = label[left] != label[right]
        left, right = left[keep], right[keep]
    return label


EDGES = "a binary, b binary"


def _edges(rows: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"a": pa.array([r[0] for r in rows], pa.binary()), "b": pa.array([r[1] for r in rows], pa.binary())})


def _by_group(batches: Iterator[pa.RecordBatch], n_keys: int, fn: Callable[[tuple, list[dict]], list[tuple]], record: Callable = _edges) -> Iterator[pa.RecordBatch]:
    """fn for each run of rows with the same first columns; rows come sorted by them."""
    held: list[dict] = []
    held_key: tuple = ()
    for batch in batches:
        names = batch.schema.names[:n_keys]
        out: list[tuple[bytes, bytes]] = []
        for row in batch.to_pylist():
            key = tuple(row[k] for k in names)
            if key != held_key and held:
                out += fn(held_key, held) if len(held) > 1 else []
                held = []
            held_key = key
            held.append(row)
        if out:
            yield record(out)
    if len(held) > 1:
        yield record(fn(held_key, held))


def _compare_sketches(least: int) -> Callable:
    def compare(_: tuple, rows: list[dict]) -> list[tuple[bytes, bytes]]:
        sketches = np.frombuffer(b"".join(r["sketch"] for r in rows), np.uint8).reshape(len(rows), FUNCTIONS)
        left, right = [], []
        step = max(1, (1 << 24) // (FUNCTIONS * len(rows)))
        for first in range(0, len(rows), step):
            same = (sketches[first : first + step, None, :] == sketches[None, :, :]).sum(axis=2, dtype=np.int16)
            i, j = np.nonzero(same >= least)
            left.append(i[i + first < j] + first)
            right.append(j[i + first < j])
        label = roots(len(rows), np.concatenate(left), np.concatenate(right))
        return [(rows[i]["id"], rows[k]["id"]) for i, k in enumerate(label.tolist()) if i != k]

    return compare


def _common(rows: list[dict], sizes: np.ndarray, n_left: int, from_right: int) -> np.ndarray:
    """Shingles that each of the first rows shares with each of the last ones."""
    # Only shingles that two documents share count; each gets a column.
    values = np.frombuffer(b"".join(r["shingles"] for r in rows), U)
    _, column, counts = np.unique(values, return_inverse=True, return_counts=True)
    shared = counts > 1
    column = np.where(shared, np.cumsum(shared) - 1, -1)[column]
    owner = np.repeat(np.arange(len(rows)), sizes)[column >= 0]
    column = column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((n_left, len(rows) - from_right), np.float32)
    width = 2048
    for low in range(0, int(shared.sum()), width):
        a, z = np.searchsorted(column, [low, low + width])
        hits = np.zeros((len(rows), width), np.float32)
        hits[owner[a:z], column[a:z] - low] = 1
        common += hits[:n_left] @ hits[from_right:].T
    return common


def _compare_sets(percent: int) -> Callable:
    def compare(key: tuple, rows: list[dict]) -> list[tuple[bytes, bytes]]:
        _, first_slice, last_slice = key
        rows = sorted(rows, key=lambda r: (r["slice"], r["id"]))
        sizes = np.array([len(r["shingles"]) // 8 for r in rows])
        n_left = len(rows) if first_slice == last_slice else sum(r["slice"] == first_slice for r in rows)
        from_right = 0 if first_slice == last_slice else n_left
        common = _common(rows, sizes, n_left, from_right)
        union = sizes[:n_left, None] + sizes[None, from_right:] - common
        i, j = np.nonzero(100 * common >= percent * union)
        label = roots(len(rows), i, j + from_right)
        return [(rows[i]["id"], rows[k]["id"]) for i, k in enumerate(label.tolist()) if i != k]

    return compare


MEASURED = "root binary, hub binary, id binary, far double, linked boolean"


def _measures(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * 5
    kinds = (pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["root", "hub", "id", "far", "linked"])


def _measure_sets(percent: int) -> Callable:
    """The distance of each document of a slice from each hub, which have slice -1."""

    def measure(key: tuple, rows: list[dict]) -> list[tuple]:
        rows = sorted(rows, key=lambda r: (r["slice"], r["id"]))
        sizes = np.array([len(r["shingles"]) // 8 for r in rows])
        n = sum(r["slice"] < 0 for r in rows)
        common = _common(rows, sizes, n, n).astype(float)
        union = sizes[:n, None] + sizes[None, n:] - common
        far, linked = (1 - common / union).tolist(), (100 * common >= percent * union).tolist()
        return [(key[0], rows[h]["id"], rows[n + k]["id"], far[h][k], linked[h][k]) for h in range(n) for k in range(len(rows) - n)]

    return measure


ROUND = "node long, id binary, sketch binary, hub binary, agree array<int>"


def _meet_pivots(least: int) -> Callable:
    """Equal places with each pivot and the first pivot within its ring; sketches only of documents that stay.

    Pivots that one document ties follow as rows without `agree`.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            nodes, ids, sketches, pivots = (batch.column(k).to_pylist() for k in ("node", "id", "sketch", "pivots"))
            own = np.frombuffer(b"".join(sketches), np.uint8).reshape(n, 1, FUNCTIONS)
            theirs = np.frombuffer(b"".join(p["sketch"] for row in pivots for p in row), np.uint8).reshape(n, PIVOTS, FUNCTIONS)
            agree = np.empty((n, PIVOTS), np.int32)
            for first in range(0, n, 4096):
                agree[first : first + 4096] = (own[first : first + 4096] == theirs[first : first + 4096]).sum(axis=2, dtype=np.int32)
            ring = agree >= RING
            stays = agree.max(axis=1) < RING + FUNCTIONS - least
            first_of = ring.argmax(axis=1)
            hubs = [pivots[r][first_of[r]]["id"] if ring[r, first_of[r]] else None for r in range(n)]
            ties = {(nodes[r], pivots[r][k]["id"], hubs[r]) for r, k in zip(*map(np.ndarray.tolist, np.nonzero(ring)), strict=True) if k != first_of[r]}
            sketches = [x if stay else None for x, stay in zip(sketches, stays.tolist(), strict=True)]
            ties = sorted(t for t in ties if t[1] != t[2])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(nodes + [t[0] for t in ties], pa.int64()),
                    pa.array(ids + [t[1] for t in ties], pa.binary()),
                    pa.array(sketches + [None] * len(ties), pa.binary()),
                    pa.array(hubs + [t[2] for t in ties], pa.binary()),
                    pa.array(agree.tolist() + [None] * len(ties), pa.list_(pa.int32())),
                ],
                names=["node", "id", "sketch", "hub", "agree"],
            )

    return meet


def _branch(nodes: DataFrame, least: int) -> tuple[DataFrame, DataFrame | None]:
    """Nodes of at most NODE documents; and stars of documents around pivots of larger ones."""
    stars = None

    def with_stars(more: DataFrame) -> DataFrame:
        return more if stars is None else stars.unionByName(more)

    for level in range(LEVELS + 1):
        large = nodes.groupBy("node").count().where(F.col("count") > NODE).select("node").checkpoint()
        if large.isEmpty():
            return nodes, stars
        inside, nodes = nodes.join(large, "node", "left_semi"), nodes.join(large, "node", "left_anti")
        if level == LEVELS:
            hubs = inside.groupBy("node").agg(F.min("id").alias("b"))
            return nodes.checkpoint(), with_stars(inside.join(hubs, "node").select(F.col("id").alias("a"), "b"))
        # The pivots of a node are the same in every tree that holds them.
        pivots = [F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), "id", "sketch")) for k in range(PIVOTS)]
        pivots = inside.groupBy("node").agg(F.array(*pivots).alias("pivots"))
        met = inside.join(pivots, "node").mapInArrow(lean(_meet_pivots(least)), ROUND).checkpoint()
        stars = with_stars(met.where("hub <> id").select(F.col("id").alias("a"), F.col("hub").alias("b")))
        nearest = F.greatest(*[F.min(F.col("agree")[k]) for k in range(PIVOTS)])
        left = met.groupBy("node").agg(nearest.alias("nearest"), F.count("sketch").alias("n")).where(F.col("nearest") < RING)
        rest = met.where("sketch is not null").select("node", "id", "sketch").join(left.select("node", "n"), "node")
        ways = [f"xxhash64(node, {level * REPEATS + r}, substring(sketch, cast(pmod(xxhash64(node, {level * REPEATS + r}), {FUNCTIONS - 3}) as int) + 1, 4))" for r in range(REPEATS)]
        ways = F.when(F.col("n") > NODE, F.expr(f"array({', '.join(ways)})")).otherwise(F.array("node"))
        nodes = nodes.unionByName(rest.select(F.explode(ways).alias("node"), "id", "sketch")).checkpoint()
    return nodes, stars


def _slices(n, shingles):
    return F.greatest(F.ceil(n / SLICE_SETS), F.ceil(shingles / SLICE_SHINGLES))


def _around_hubs(large: DataFrame, n_parts: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Exact links of groups with their hubs; and what is left: `root`, `id`, n_shingles, shingles and the `part` that links connect it to."""
    ids = F.explode(F.array(*[F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), "id"))["id"] for k in range(HUBS)])).alias("id")
    hubs = large.groupBy("root", "slices").agg(ids).distinct().join(large.select("id", "shingles"), "id")
    hubs = hubs.select("root", F.lit(-1).cast("long").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("j"), F.lit(-1).cast("long").alias("slice"), "id", "shingles")
    slice_of = F.pmod(F.xxhash64("id"), F.col("slices"))
    docs = large.select("root", F.lit(-1).cast("long").alias("i"), slice_of.alias("j"), slice_of.alias("slice"), "id", "shingles")
    ordered = hubs.unionByName(docs).repartition(n_parts, "root", "i", "j").sortWithinPartitions("root", "i", "j")
    measured = ordered.mapInArrow(lean(lambda batches: _by_group(batches, 3, _measure_sets(percent), _measures)), MEASURED).checkpoint()
    links = measured.where("linked").select(F.col("id").alias("a"), F.col("hub").alias("b")).where("a <> b")
    found = components(links)
    parts = large.select("id").join(found, "id", "left").select("id", F.coalesce("root", "id").alias("part")).checkpoint()
    of_hubs = parts.join(measured.select(F.col("hub").alias("id")).distinct(), "id").select(F.col("id").alias("hub"), F.col("part").alias("hub_part"))
    told = measured.select("hub", "id", "far").join(parts, "id").join(of_hubs, "hub")
    # A link spans at most 1 - percent / 100: what is closer to a hub than all of other parts less that has none to them.
    gaps = told.where("part <> hub_part").groupBy("hub").agg(F.min("far").alias("gap"))
    done = told.where("part = hub_part").join(gaps, "hub", "left").where(F.col("gap").isNull() | (F.col("far") + (1 - percent / 100) + 1e-9 < F.col("gap")))
    left = large.join(done.select("id").distinct(), "id", "left_anti").join(parts, "id")
    return links, left.select("root", "id", "n_shingles", "shingles", "part")


def classes(docs: DataFrame, text: str = "text", words: int = 5, percent: int = 80, trees: int = 16) -> DataFrame:
    """For each distinct text: `key`, its digest, n_shingles, and `root`, equal for texts that links connect."""
    texts = blocks.store(docs, text)
    n_texts = max(1.0, texts.n_bytes / 1000)
    b1 = blocks.buckets(n_texts * trees)
    n_parts = texts.n_parts

    def code(nodes: np.ndarray) -> np.ndarray:
        return (bucket_of(nodes, b1) << U(32)) | (nodes & U(0xFFFFFFFF))

    def propose(block: int, b: Block) -> pa.Table:
        codes = [np.zeros(0, U)]
        for _, shingles in shingle_sets(b, words):
            codes.append(code(_nodes(minwise(shingles), trees)))
        codes = np.concatenate(codes)
        return blocks.ship(block, codes >> U(32), codes.astype(np.uint32), np.zeros(len(codes), bool), b1)

    shared = blocks.repeated(blocks.per_block(texts, propose, blocks.SHIPPED), np.uint32, n_parts)

    def members(block: int, b: Block, replies: pa.Table) -> pa.Table:
        buckets, values = blocks.answers(replies, np.uint32)
        known = np.sort((buckets.astype(U) << U(32)) | values.astype(U))
        nodes, ids, sketches = [], [], []
        for row, shingles in shingle_sets(b, words) if len(known) else ():
            least = minwise(shingles)
            own = _nodes(least, trees)
            own = own[np.isin(code(own), known)]
            sketch = (least & U(255)).astype(np.uint8).tobytes()
            for node in own.astype(np.int64).tolist():
                nodes.append(node)
                ids.append(_id(block, b.keys[row]))
                sketches.append(sketch)
        return pa.table({"node": pa.array(nodes, pa.int64()), "id": pa.array(ids, pa.binary()), "sketch": pa.array(sketches, pa.binary())})

    least = int(FUNCTIONS * (percent / 100 - 0.15))
    nodes, stars = _branch(blocks.with_answers(texts, shared, members, "node long, id binary, sketch binary").checkpoint(), least)
    ordered = nodes.repartition(n_parts, "node").sortWithinPartitions("node")
    proposed = ordered.mapInArrow(lean(lambda batches: _by_group(batches, 1, _compare_sketches(least))), EDGES)
    groups = components(proposed if stars is None else proposed.unionByName(stars))
    groups = groups.unionByName(groups.select(F.col("root").alias("id"), "root").distinct())
    told = groups.select(F.expr("cast(conv(hex(substring(id, 1, 4)), 16, 10) as int)").alias("block"), "id", "root")

    def confirm(block: int, b: Block, replies: pa.Table) -> pa.Table:
        root = dict(zip(replies["id"].to_pylist(), replies["root"].to_pylist(), strict=True))
        rows: dict[int, tuple] = {}
        for row, shingles in shingle_sets(b, words):
            mine = _id(block, b.keys[row])
            rows[row] = (mine, len(shingles), root.get(mine), shingles.tobytes() if mine in root else None)
        out = [rows.get(i, (_id(block, k), 0, None, None)) for i, k in enumerate(b.keys)]
        columns = list(zip(*out, strict=True)) or [[]] * 4
        kinds = (pa.binary(), pa.int64(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "n_shingles", "root", "shingles"])

    sets = blocks.with_answers(texts, told, confirm, "id binary, n_shingles long, root binary, shingles binary").checkpoint()
    grouped = sets.where("root is not null")
    sizes = grouped.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    sizes = sizes.where("n > 1").select("root", _slices(F.col("n"), F.col("s")).alias("slices")).checkpoint()

    def cells(rows: DataFrame) -> DataFrame:
        """Links of each pair of slices, whose numbers are `slice` and 0 to `others` - 1."""
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)))
        rows = rows.select("root", F.least("slice", "other").alias("i"), F.greatest("slice", "other").alias("j"), "slice", "id", "shingles")
        ordered = rows.repartition(n_parts, "root", "i", "j").sortWithinPartitions("root", "i", "j")
        return ordered.mapInArrow(lean(lambda batches: _by_group(batches, 3, _compare_sets(percent))), EDGES)

    dealt = grouped.join(sizes.where(F.col("slices") <= SLICES), "root").withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")))
    links = cells(dealt.withColumn("others", F.col("slices")))
    above = sizes.where(F.col("slices") > SLICES)
    if not above.isEmpty():
        around, left = _around_hubs(grouped.join(above, "root"), n_parts, percent)
        left = left.checkpoint()
        # Within the largest part of a group nothing is left to compare; its slices come after the others'.
        kinds = left.groupBy("root", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
        most = kinds.groupBy("root").agg(F.max(F.struct("n", "s", "part")).alias("m"), F.sum("n").alias("n"), F.sum("s").alias("s"))
        n_others, s_others = F.col("n") - F.col("m.n"), F.col("s") - F.col("m.s")
        most = most.where(n_others > 0).select("root", F.col("m.part").alias("main"), _slices(n_others, s_others).alias("r"), _slices(F.col("m.n"), F.col("m.s")).alias("k"))
        rows = left.join(most, "root").withColumn("inner", F.col("part") == F.col("main"))
        own = F.when(F.col("inner"), F.col("r") + F.pmod(F.xxhash64("id"), F.col("k"))).otherwise(F.pmod(F.xxhash64("id"), F.col("r")))
        rows = rows.withColumn("slice", own).withColumn("others", F.when(F.col("inner"), F.col("r")).otherwise(F.col("r") + F.col("k")))
        links = links.unionByName(around).unionByName(cells(rows))
    linked = components(links)

    labels = sets.select("id", "n_shingles").join(linked, "id", "left")
    return labels.select(F.expr("substring(id, 5)").alias("key"), "n_shingles", F.coalesce("root", "id").alias("root"))


def near_copies(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, trees: int = 16) -> DataFrame:
    """One row per document: the id, n_shingles, component_id and kept."""
    labels = classes(docs, text, words, percent, trees)
    rows = docs.select(F.col(id_column).alias("doc_id"), blocks.digest(text).alias("key")).join(labels, "key").drop("key").checkpoint()
    firsts = rows.where("n_shingles > 0").groupBy("root").agg(F.min("doc_id").alias("first"))
    own = F.when(F.col("n_shingles") > 0, F.col("first")).otherwise(F.col("doc_id"))
    rows = rows.join(firsts, "root", "left").select("doc_id", "n_shingles", own.alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80, trees: int = 16) -> DataFrame:
    """The documents, of each group of near copies the one with the least id.

    Rows with neither words nor links all stay, but of rows alike in id and text one does.
    """
    labels = classes(docs, text, words, percent, trees)
    rows = docs.select(F.col(id_column).alias("__id"), blocks.digest(text).alias("key")).join(labels, "key")
    # Rows without shingles are groups of their own.
    group = F.when(F.col("n_shingles") > 0, F.struct("root", F.lit(None).cast(docs.schema[id_column].dataType).alias("own")))
    group = group.otherwise(F.struct("root", F.col("__id").alias("own")))
    first = F.min(F.struct(F.col("__id").isNull().alias("without"), F.col("__id").alias("id"), F.col("key").alias("key")))
    firsts = rows.groupBy(group.alias("g")).agg(first.alias("f")).select(F.col("f.id").alias("__id"), F.col("f.key").alias("__key"))
    own = docs.withColumn("__digest", blocks.digest(text))
    found = own.join(firsts, own[id_column].eqNullSafe(firsts["__id"]) & (own["__digest"] == firsts["__key"]), "left_semi")
    return found.dropDuplicates([id_column, "__digest"]).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_copies(spark.read.parquet(f"{folder}/documents.parquet"), words=4)
