"""Streams into the store, and dedupe of streams."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vaultframe.session import read_text, write_text
from vaultframe.sources.vault import Selection, Vault


def journal_stream(files: DataFrame, vault: Vault, checkpoint: str, date_of=None, trigger: dict | None = None) -> StreamingQuery:
    """Adds each micro-batch of (dt_path, dt_date, dt_size, dt_attr, content) as one version; paths that a batch doesn't have stay as they are.

    A batch that is delivered again after a failure is left out: the number of
    the last batch is kept beside the store. ``date_of``: date of a batch by its
    number; by default the present.
    """
    mark = f"{checkpoint.rstrip('/')}/last-batch.json"

    def add(batch: DataFrame, number: int) -> None:
        if number <= json.loads(read_text(vault.spark, mark) or "-1"):
            return
        rest = vault.snapshot().join(batch.select("dt_path"), "dt_path", "left_anti").select("dt_path", "dt_date", "dt_size", "dt_attr", F.lit(None).cast("binary").alias("content"))
        vault.add(batch.select("dt_path", "dt_date", "dt_size", "dt_attr", "content").unionByName(rest), date_of(number) if date_of else None, Selection())
        write_text(vault.spark, mark, json.dumps(number))

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def dedupe_within(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """First row of each key; a key is forgotten once the watermark has passed it, so the state is bounded by the delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def dedupe_against(stream: DataFrame, key: str, table: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends to a table the rows whose key it doesn't have, once each. Exact over all time, without state: each batch is an anti-join with the table, and its own directory, so that a batch done again replaces itself."""

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.filter(F.col(key).isNotNull()).dropDuplicates([key])
        log = json.loads(read_text(spark, f"{table}/batches.json") or "[]")
        if number in log:
            return
        if log:
            known = spark.read.parquet(*(f"{table}/batch={n}" for n in log)).select(key)
            fresh = fresh.join(known, key, "left_anti")
        fresh.write.mode("overwrite").parquet(f"{table}/batch={number}")
        write_text(spark, f"{table}/batches.json", json.dumps([*log, number]))

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def deduped(spark, table: str) -> DataFrame:
    """The rows that :func:`dedupe_against` has taken so far."""
    log = json.loads(read_text(spark, f"{table}/batches.json") or "[]")
    return spark.read.parquet(*(f"{table}/batch={n}" for n in log))


def arrivals(stream: DataFrame, time: str, window: str, late: str, *by: str) -> DataFrame:
    """Rows and bytes (ht_usize) in windows of event time, late rows up to a delay included."""
    known = F.greatest(F.coalesce("ht_usize", F.lit(0)), F.lit(0)).cast("bigint")
    return stream.withWatermark(time, late).groupBy(F.window(time, window), *by).agg(F.count("*").alias("n"), F.sum(known).alias("bytes"))
