"""Where plans keep intermediate tables so that a lost executor costs no rerun."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SETTING = "spark.checkpoint.dir"
_local_dir: str | None = None
#: Tables written by `cut`, to be deleted by `clear_stored`.
_stored: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a temporary one only in local mode."""
    global _local_dir
    named = spark.conf.get(SETTING, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {SETTING} to a folder every executor can reach")
    if _local_dir is None:
        _local_dir = tempfile.mkdtemp(prefix="tickloom-")
    return _local_dir


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and go on from it.

    The result is computed once; later stages read only the columns and rows
    they need, and a lost executor costs no more than rereading files.
    """
    path = scratch_path(df.sparkSession, "stored")
    _stored.append(path)
    # Parquet has no column without a type.
    untyped = {f.name: F.lit(None).cast("string") for f in df.schema.fields if isinstance(f.dataType, T.NullType)}
    ready = df.withColumns(untyped) if untyped else df
    ready.write.parquet(path)
    return df.sparkSession.read.schema(ready.schema).parquet(path)


# Plan nodes whose work should not be done twice: shuffles, and rows that pass through Python.
_COSTLY = frozenset(
    "Join Aggregate Window Sort Distinct Deduplicate Repartition RepartitionByExpression RebalancePartitions Generate Expand CoGroup MapInPandas MapInArrow "
    "FlatMapGroupsInPandas FlatMapGroupsInArrow FlatMapCoGroupsInPandas FlatMapCoGroupsInArrow ArrowEvalPython BatchEvalPython WindowInPandas AsOfJoin".split()
)


def costly(df: DataFrame) -> bool:
    """Whether the plan has a node beyond scans, projections, filters and unions."""
    left = [df._jdf.queryExecution().optimizedPlan()]
    while left:
        node = left.pop()
        if node.nodeName() in _COSTLY:
            return True
        children = node.children()
        left += [children.apply(i) for i in range(children.size())]
    return False


def once(df: DataFrame) -> DataFrame:
    """Store a DataFrame that is about to be read more than once.

    Plans below read their input twice, for the rows and for the carried
    values. Stacked plans would then redo the work at the bottom many times,
    so anything beyond a plain scan or a stored table is stored first.
    """
    return cut(df) if costly(df) else df


def clear_stored(spark: SparkSession) -> int:
    """Delete the tables this application has stored so far; their number.

    Call it when results are written or fetched: frames that still read a
    stored table fail afterwards. It runs by itself when the interpreter ends
    with the session alive.
    """
    jvm, n = spark._jvm, 0
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _stored:
        path = jvm.org.apache.hadoop.fs.Path(_stored.pop())
        n += path.getFileSystem(conf).delete(path, True)
    return n


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        clear_stored(spark)


atexit.register(_at_exit)
