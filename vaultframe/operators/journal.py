"""Versions of an archive: as-of cuts, snapshots, listings of all versions, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vaultframe.functions.dates import LAST_VERSION


#: Columns of an entry; others are dropped, whatever their names.
ENTRY = ("entry_id", "archive_id", "version_id", "seq_no", "dt_path", "dt_date", "dt_size", "dt_attr", "dt_ptr", "loaded_at")


def last_loaded(entries: DataFrame) -> DataFrame:
    """Of each record (version_id, seq_no) the row loaded last; rows with a null path are none."""
    entries = entries.select(*(c for c in ENTRY if c in entries.columns))
    latest = Window.partitionBy("version_id", "seq_no").orderBy(F.desc_nulls_last("loaded_at"), F.desc_nulls_last("entry_id"))
    return entries.filter("dt_path is not null").withColumn("_n", F.row_number().over(latest)).filter("_n = 1").drop("_n")


def as_of(versions: DataFrame, until: int | None = None) -> DataFrame:
    """The versions of each archive up to a cut.

    Versions are taken in order of version_no up to the first that was never
    committed (size -1) or lies beyond ``until``: a version number, a date, or a
    negative number that leaves so many of the archive's versions out. All after
    the cut are gone, also such as have an earlier date. Null dates never cut.
    """
    by = Window.partitionBy("archive_id")
    ordered = by.orderBy("version_no")
    place = F.row_number().over(ordered)
    beyond: Column = F.col("ver_csize") < 0
    rows = versions.withColumn("_place", place)
    rows = rows.withColumn("_good", F.min(F.when(F.col("ver_csize") < 0, F.col("_place"))).over(by))
    if until is not None and until < 0:
        held = F.coalesce(F.col("_good") - 1, F.max("_place").over(by))
        beyond = beyond | (F.col("_place") > held + until)
    elif until is not None and until <= LAST_VERSION:
        beyond = beyond | (F.col("_place") > until)
    elif until is not None:
        beyond = beyond | F.coalesce(F.col("ver_date") > until, F.lit(False))
    cut = F.min(F.when(beyond, F.col("_place"))).over(by)
    return rows.withColumn("_cut", cut).filter("_cut is null or _place < _cut").drop("_place", "_cut", "_good")


def snapshot(entries: DataFrame, versions: DataFrame, until: int | None = None, keep_deleted: bool = False) -> DataFrame:
    """The last record of each path in the versions up to a cut; deleted paths are left out."""
    cut = as_of(versions, until).select("version_id", "version_no")
    rows = last_loaded(entries).join(cut, "version_id")
    newest = Window.partitionBy("archive_id", "dt_path").orderBy(F.desc("version_no"), F.desc("seq_no"))
    rows = rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
    return rows if keep_deleted else rows.filter("dt_date is null or dt_date <> 0")


def all_versions(entries: DataFrame, versions: DataFrame, until: int | None = None, width: int = 4) -> DataFrame:
    """Every record under its version: ``NNNN/path``, with a row ``NNNN/`` for each version. Numbers longer than ``width`` stay whole."""
    cut = as_of(versions, until).select("version_id", "version_no", "ver_date")
    number = F.col("version_no").cast("string")
    prefix = F.when(F.length(number) < width, F.lpad(number, width, "0")).otherwise(number)
    rows = last_loaded(entries).join(cut, "version_id")
    newest = Window.partitionBy("archive_id", "version_no", "dt_path").orderBy(F.desc("seq_no"))
    rows = rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1")
    files = rows.select("archive_id", F.concat(prefix, F.lit("/"), "dt_path").alias("dt_path"), "dt_date", "dt_size", "dt_attr")
    null = F.lit(None).cast("bigint")
    return files.unionByName(cut.join(versions.select("version_id", "archive_id"), "version_id").select("archive_id", F.concat(prefix, F.lit("/")).alias("dt_path"), F.col("ver_date").alias("dt_date"), null.alias("dt_size"), null.alias("dt_attr")))


def version_stats(entries: DataFrame, versions: DataFrame) -> DataFrame:
    """Updates, deletes, bytes (to the next version's offset) and range of fragments of each committed version. Updates and deletes are counted from the entries; the last version's end is open (null)."""
    counted = last_loaded(entries).groupBy("version_id").agg(F.count(F.when(F.coalesce(F.col("dt_date") != 0, F.lit(True)), 1)).alias("updates"), F.count(F.when(F.col("dt_date") == 0, 1)).alias("deletes"))
    along = Window.partitionBy("archive_id").orderBy("version_no")
    rows = as_of(versions).select("archive_id", "version_id", "version_no", "ver_date", (F.lead("ver_offset").over(along) - F.col("ver_offset")).alias("csize"), F.col("ver_first_fragment").alias("first_fragment"), (F.lead("ver_first_fragment").over(along) - 1).alias("last_fragment"))
    return rows.join(counted, "version_id", "left").fillna(0, ["updates", "deletes"])


def commit_dates(versions: DataFrame) -> DataFrame:
    """The date that each version would be given so that dates rise: its own, or one second after the last one's where that isn't later."""
    from vaultframe.functions.dates import decimal_date, to_timestamp

    w = Window.partitionBy("archive_id").orderBy("version_no")
    seconds = F.unix_timestamp(to_timestamp(F.col("ver_date")))
    # With d the dates and i the order, the rising sequence is i + max over the earlier ones of (d - i).
    place = F.row_number().over(w)
    rows = versions.withColumn("_i", place).withColumn("_s", seconds)
    fixed = F.max(F.col("_s") - F.col("_i")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + F.col("_i")
    return rows.select("archive_id", "version_no", "ver_date", decimal_date(F.timestamp_seconds(fixed)).alias("commit_date"))


def last_dates(versions: DataFrame) -> DataFrame:
    """(archive_id, last_date): the latest date that any committed version of an archive was begun or finished at; the next one must be later."""
    return versions.filter("ver_csize <> -1").groupBy("archive_id").agg(F.max(F.greatest("ver_date", "ver_lastdate")).alias("last_date"))
