"""Numbers in the order of a whole table, without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vaultframe.session import scratch_path


def number_rows(rows: DataFrame, order: list[str], name: str, by: str | None = None) -> DataFrame:
    """Adds ``name``: the row's place, from 1, in ``order`` (a total order) within each value of ``by``.

    The rows are written in sorted ranges; each range is numbered for itself and
    begins after the counts of the ranges before it. Only those counts, one row a
    range and value, come together.
    """
    spark = rows.sparkSession
    keys = [by] if by else []
    path = scratch_path(spark, "ranges")
    rows.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()).write.parquet(path)
    stored = spark.read.schema(spark.read.parquet(path).schema).parquet(path)
    counts = stored.groupBy(*keys, "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*(F.col(k) for k in keys) or [F.lit(0)]).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    same = F.col("_range") == F.col("_r")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    place = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(*order))
    numbered = stored.withColumn("_place", place).join(offsets, same)
    return numbered.select(*rows.columns, (F.col("_place") + F.col("_offset")).cast("bigint").alias(name))
