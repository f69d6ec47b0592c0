"""Writers for ledgers, curves, scores and summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    run_id: str | None = None,
    mode: str = "append",
) -> None:
    """Write one result table, by run and any further partition columns.

    CSV has no arrays, maps or intervals: arrays are joined by commas, maps go
    to JSON and intervals to text.
    """
    if run_id is not None:
        df = df.withColumn("run_id", F.lit(run_id))
        partition_by = ["run_id", *partition_by]
    if fmt == "csv":
        df = df.select(*[_flat(f) for f in df.schema.fields])
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def _flat(field: T.StructField):
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.ArrayType):
        return F.array_join(c.cast("array<string>"), ",").alias(field.name)
    if isinstance(field.dataType, (T.MapType, T.StructType)):
        return F.to_json(c).alias(field.name)
    if isinstance(field.dataType, T.DayTimeIntervalType):
        return c.cast("string").alias(field.name)
    return c
