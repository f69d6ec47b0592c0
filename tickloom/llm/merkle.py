"""A Merkle manifest of a table, with a proof for every row, by time-forward processing.

* A row's digest is SHA-256 of its fields, each as its UTF-8 byte count, a colon and the value,
  or `-` for a null. Digests enter other digests as lowercase hex text.
* One tree per key value: rows ascend by the order column, every two consecutive nodes become
  one, the last one of a level alone if need be. The keys' roots, nulls first and then bytewise,
  form the last tree in the same way.
* A node is labelled by (tree, level, place). Children send their digests forward to the label of
  their parent. The queue that delivers these messages in the order of labels is external: between
  tasks it is a shuffle sorted by label, which Spark spills, and inside a task, which owns
  2**STEP neighbouring nodes and the STEP levels above them, it is a heap of at most as many messages.
* The reversed sweep starts at the root: a node that knows the siblings from itself up to the
  root sends them on to its children, each with the other child put in front. The heap and the
  shuffles run by descending label. What reaches a row is its proof.

A tree of n rows takes log(n) / STEP rounds of either sweep. Places come from a sort by ranges
of (key, order, digest), with sizes of ranges added up, so a key with most of the rows is cut like
any other. Texts are read once; everything later carries digests only.

Null keys are a tree of their own. Null order values come first. Rows alike in the order column
are ordered by digest; rows alike in all fields are leaves of their own with places next to each
other. Empty texts and texts of any length are values like others. An empty table has no rows
in the result. Columns that are not among the fields are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from hashlib import sha256
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tickloom.plans.storage import cut

STEP = 14
RANGE_ROWS = 1 << 17
DOCUMENT = ("doc_id", "source", "lang", "n_chars", "text")


def _hash(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def row_digest(fields: Sequence[Column]) -> Column:
    def written(field: Column) -> Column:
        value = field.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(written, fields)).cast("binary"), 256)


def _height(total: int) -> int:
    """Levels above `total` nodes that one task climbs."""
    return min(STEP, (total - 1).bit_length())


def forward(digests: Sequence[str], height: int) -> dict[tuple[int, int], str]:
    """Digests of all nodes above neighbouring ones, by (level, place)."""
    nodes = {(0, i): d for i, d in enumerate(digests)}
    queue = [(1, i >> 1, i, d) for i, d in enumerate(digests)] if height else []
    heapify(queue)
    while queue:
        level, place, _, digest = heappop(queue)
        arrived = [digest]
        while queue and queue[0][:2] == (level, place):
            arrived.append(heappop(queue)[3])
        nodes[level, place] = digest = _hash(*arrived)
        if level < height:
            heappush(queue, (level + 1, place >> 1, place, digest))
    return nodes


def backward(nodes: Mapping[tuple[int, int], str], height: int, above: Sequence[str]) -> Iterator[tuple[int, list[str]]]:
    """Each lowest node's place and its steps up to the root, the highest place first.

    A step is L or R, the side of the sibling, and the sibling's digest; a lone node's step is empty.
    """
    # Suffixes are linked, so nodes share those of their parents.
    last = None
    for step in reversed(above):
        last = (step, last)
    queue = [(-height, 0, last)]
    while queue:
        level, place, suffix = heappop(queue)
        level, place = -level, -place
        if not level:
            steps = []
            while suffix is not None:
                steps.append(suffix[0])
                suffix = suffix[1]
            yield place, steps
            continue
        left, right = (level - 1, 2 * place), (level - 1, 2 * place + 1)
        if right in nodes:
            heappush(queue, (1 - level, -right[1], ("L" + nodes[left], suffix)))
            heappush(queue, (1 - level, -left[1], ("R" + nodes[right], suffix)))
        else:
            heappush(queue, (1 - level, -left[1], ("", suffix)))


def fold(digest: str, steps: Sequence[str]) -> str:
    """The root that a digest and its proof give."""
    for step in steps:
        digest = _hash(step[1:], digest) if step[:1] == "L" else _hash(digest, step[1:])
    return digest


def proof_digest(steps: Sequence[str]) -> str:
    return _hash(*(step[1:] for step in steps))


def _groups(batches: Iterator[pa.RecordBatch], by: int) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of consecutive groups that share the first `by` columns."""
    held, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row.values())[:by]
            if key != held:
                if rows:
                    yield held, rows
                held, rows = key, []
            rows.append(row)
    if rows:
        yield held, rows


def _places(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """Number the rows of each tree from 0 in `order`, and add the tree's size.

    `rows` is a stored table with a column `tree`.
    """
    n_ranges = max(1, -(-rows.count() // RANGE_ROWS))
    schema = T.StructType([*rows.schema.fields, T.StructField("range", T.IntegerType()), T.StructField("near", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, n = None, 0
        for batch in batches:
            near = []
            for own in batch.column("tree").to_pylist():
                n = n + 1 if own == tree else 0
                tree = own
                near.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near, pa.int64())], names=[*batch.schema.names, "near"])

    ranged = rows.repartitionByRange(n_ranges, "tree", *order).sortWithinPartitions("tree", *order)
    numbered = cut(ranged.withColumn("range", F.spark_partition_id()).mapInArrow(number, schema))
    sizes = numbered.groupBy("tree", "range").agg((F.max("near") + 1).alias("size"))
    tree = Window.partitionBy("tree")
    sizes = sizes.select("tree", "range", (F.sum("size").over(tree.orderBy("range")) - F.col("size")).alias("before"), F.sum("size").over(tree).alias("total"))
    return numbered.join(sizes, ["tree", "range"]).withColumn("place", F.col("before") + F.col("near")).drop("range", "near", "before")


def _delivered(messages: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Deal messages by label, sort them in each task, and sweep."""
    return messages.repartition("tree", "block").sortWithinPartitions("tree", "block", "kind", "place").mapInArrow(run, schema)


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.shiftright("place", STEP))


def _climb(nodes: DataFrame) -> DataFrame:
    """The nodes STEP levels up: tree, place, total, digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (tree, block), rows in _groups(batches, 2):
            total = rows[0]["total"]
            height = _height(total)
            digest = forward([r["digest"] for r in rows], height)[height, 0]
            yield pa.RecordBatch.from_pydict({"tree": [tree], "place": [block], "total": [-(-total // (1 << STEP))], "digest": [digest]})

    messages = _blocks(nodes).select("tree", "block", F.lit(1).alias("kind"), "place", "total", "digest")
    return cut(_delivered(messages, run, "tree string, place long, total long, digest string"))


SUFFIXES = "tree string, place long, steps array<string>, subroot string, root string"


def _descend(nodes: DataFrame, suffixes: DataFrame, extra: Sequence[str], finish: Callable, schema: str) -> DataFrame:
    """Deliver the suffixes of nodes STEP levels up to the nodes under them.

    finish(node row, steps, subroot, root) gives the row that goes on.
    """
    parents = suffixes.select("tree", F.col("place").alias("block"), F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("place"), "steps", "subroot", "root")
    members = _blocks(nodes).select("tree", "block", F.lit(1).alias("kind"), "place", "total", "digest", *extra)
    messages = parents.unionByName(members, allowMissingColumns=True)

    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, (parent, *rows) in _groups(batches, 2):
            height = _height(rows[0]["total"])
            nodes = forward([r["digest"] for r in rows], height)
            out = [finish(rows[place], steps, parent["subroot"], parent["root"]) for place, steps in backward(nodes, height, parent["steps"])]
            for first in range(0, len(out), 4096):
                yield pa.RecordBatch.from_pylist(out[first : first + 4096], arrow)

    return _delivered(messages, run, schema)


def _sent(row: dict, steps: list[str], subroot: str, root: str) -> dict:
    return {"tree": row["tree"], "place": row["place"], "steps": steps, "subroot": subroot, "root": root}


def _rounds(leaves: DataFrame) -> list[DataFrame]:
    """The nodes at every STEP-th level, up to one node a tree."""
    most = leaves.agg(F.max("total")).first()[0] or 0
    levels = [leaves]
    while most > 1:
        levels.append(_climb(levels[-1]))
        most = -(-most // (1 << STEP))
    return levels


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = DOCUMENT,
    key: str = "lang",
    order: str = "doc_id",
    altered: Mapping[str, Column] | None = None,
    where: Column | None = None,
) -> DataFrame:
    """One row per row of `docs`: its order value, leaf, subroot, root, proof and folded_root.

    `proof` lists the siblings up to the root as side and digest. With `altered`, rows for which
    `where` holds are folded from the digest of fields with these values in their place, against
    their original proofs; `folded_root` then differs from `root`.
    """
    where = F.lit(False) if where is None else F.coalesce(where, F.lit(False))
    columns = {f: F.col(f) for f in fields}
    other = row_digest(list((columns | dict(altered or {})).values()))
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("tree"),
        F.col(order).alias("id"),
        row_digest(list(columns.values())).alias("digest"),
        F.when(where, other).alias("altered"),
        # Rows alike in all else may lie in several ranges.
        F.monotonically_increasing_id().alias("tie"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    leaves = cut(_places(cut(rows), ["id", "digest", "tie"]).drop("tie"))
    levels = _rounds(leaves)
    tops = levels[-1].select(F.lit("").alias("tree"), F.col("tree").alias("id"), "digest")
    tops = cut(_places(cut(tops), ["id"]))
    upper = _rounds(tops)

    suffixes = upper[-1].select("tree", "place", F.array().cast("array<string>").alias("steps"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(upper[1:-1]):
        suffixes = _descend(nodes, suffixes, [], _sent, SUFFIXES)

    def top(row: dict, steps: list[str], _: str, root: str) -> dict:
        return {"tree": row["id"], "place": 0, "steps": steps, "subroot": row["digest"], "root": root}

    suffixes = _descend(upper[0], suffixes, ["id"], top, SUFFIXES)
    for nodes in reversed(levels[1:-1]):
        suffixes = _descend(nodes, suffixes, [], _sent, SUFFIXES)

    def leaf(row: dict, steps: list[str], subroot: str, root: str) -> dict:
        folded = fold(row["altered"] or row["digest"], steps)
        return {"id": row["id"], "leaf": row["digest"], "subroot": subroot, "root": root, "proof": steps, "proof_sha256": proof_digest(steps), "folded_root": folded, "verified": folded == root}

    schema = f"id {kind}, leaf string, subroot string, root string, proof array<string>, proof_sha256 string, folded_root string, verified boolean"
    return _descend(levels[0], suffixes, ["id", "altered"], leaf, schema).withColumnRenamed("id", order)


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = manifest(docs, altered={"n_chars": F.col("n_chars") + 1}, where=chosen)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _sql_tree(name: str, leaves: str) -> str:
    """Recursive SQL for the nodes of trees given as (tree, place, total, digest)."""
    return f"""
{name} AS (
  SELECT tree, 0 AS level, place, total, digest FROM {leaves}
  UNION ALL
  SELECT a.tree, a.level + 1, a.place // 2, (a.total + 1) // 2, sha256(a.digest || coalesce(b.digest, ''))
  FROM {name} a LEFT JOIN {name} b ON b.tree = a.tree AND b.place = a.place + 1
  WHERE a.total > 1 AND a.place % 2 = 0)"""


def _sql_digest(fields: Sequence[str]) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({f}::VARCHAR)::VARCHAR || ':' || {f}::VARCHAR, '-')" for f in fields) + ")"


# CRC-32 of decimal digits, one bit at a time; 3988292384 is the reversed polynomial.
_SQL_CRC = """list_reduce([4294967295] || list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
    lambda c, b: list_reduce([xor(c, b)] || range(8), lambda r, i: xor(r >> 1, (r & 1) * 3988292384)))"""

SQL = f"""
WITH RECURSIVE d AS (
  SELECT coalesce('=' || lang, '') AS tree, doc_id, {_sql_digest(DOCUMENT)} AS digest,
    {_sql_digest([f if f != "n_chars" else "(n_chars + 1)" for f in DOCUMENT])} AS other,
    xor({_SQL_CRC}, 4294967295) % 7 = 0 AS altered FROM documents),
l AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, digest) - 1 AS place, count(*) OVER (PARTITION BY tree) AS total FROM d),
{_sql_tree("n", "l")},
s AS (SELECT 'all' AS tree, tree AS lang, digest, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS total FROM n WHERE total = 1),
{_sql_tree("u", "s")},
r AS (SELECT digest AS root FROM u WHERE total = 1),
steps AS (
  SELECT l.tree, l.place, n.level, n.place & 1 AS side, b.digest AS sibling
  FROM l JOIN n ON n.tree = l.tree AND n.place = l.place >> n.level AND n.total > 1
  LEFT JOIN n b ON b.tree = n.tree AND b.level = n.level AND b.place = xor(n.place, 1)
  UNION ALL
  SELECT l.tree, l.place, 1000 + u.level, u.place & 1, b.digest
  FROM l JOIN s ON s.lang = l.tree JOIN u ON u.place = s.place >> u.level AND u.total > 1
  LEFT JOIN u b ON b.level = u.level AND b.place = xor(u.place, 1)),
p AS (SELECT tree, place, list({{'side': side, 'sibling': coalesce(sibling, '')}} ORDER BY level) AS path FROM steps GROUP BY ALL),
f AS (
  SELECT l.tree, l.place, 1 AS i, coalesce(p.path, []) AS path, CASE WHEN altered THEN other ELSE digest END AS h FROM l LEFT JOIN p USING (tree, place)
  UNION ALL
  SELECT tree, place, i + 1, path, sha256(CASE WHEN path[i].side = 1 THEN path[i].sibling || h ELSE h || path[i].sibling END) FROM f WHERE i <= len(path))
SELECT l.doc_id, l.digest AS leaf, s.digest AS subroot, r.root,
  sha256(coalesce(list_aggregate([x.sibling FOR x IN f.path], 'string_agg', ''), '')) AS proof_sha256, f.h AS folded_root, f.h = r.root AS verified
FROM l JOIN f ON f.tree = l.tree AND f.place = l.place AND f.i = len(f.path) + 1 JOIN s ON s.lang = l.tree CROSS JOIN r"""
