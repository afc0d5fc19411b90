"""History of changing attributes, kept as checkpoints and patches.

A path's records are cut into epochs of ``every`` version numbers. At the
beginning of each epoch in which a path has records, a checkpoint holds its
full state; within the epoch each record is a patch of the attributes it
names. Periods come from folding an epoch's patches forward from its
checkpoint. A checkpoint is itself the fold of the composed patches of the
epochs before it, so no task ever sees more than one epoch of a path or one
row per epoch, however many records a path has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vaultframe.session import scratch_path, write_bucketed

ATTRIBUTES = ("dt_date", "dt_size", "dt_attr")
#: Versions an epoch. Archives have some two dozen versions, so that most paths have several epochs.
EVERY = 8


def committed_records(entries: DataFrame, versions: DataFrame) -> DataFrame:
    """The journal's valid records of committed versions, one a path and version.

    Of a record (version_id, seq_no) the last loaded row counts (loaded_at,
    then entry_id; a null comes first), of a path's records in one version the
    one with the largest seq_no. Rows with a null path, version_id or
    version_no are no records. Unrecorded values (-1, for attr also 0) become
    null. Columns: archive_id, dt_path, version_no, is_delete and ATTRIBUTES.
    """
    rows = entries.select("archive_id", "version_id", "seq_no", "dt_path", *ATTRIBUTES, "loaded_at", "entry_id").filter(F.col("dt_path").isNotNull())
    latest = Window.partitionBy("version_id", "seq_no").orderBy(F.desc_nulls_last("loaded_at"), F.desc_nulls_last("entry_id"), *(F.desc_nulls_last(c) for c in ATTRIBUTES))
    committed = versions.filter((F.col("ver_csize") != -1) & F.col("version_no").isNotNull()).select("version_id", "version_no").distinct()
    records = rows.withColumn("_n", F.row_number().over(latest)).filter("_n = 1").join(committed, "version_id")
    return records.select(
        "archive_id",
        "dt_path",
        "version_no",
        "seq_no",
        F.coalesce(F.col("dt_date") == 0, F.lit(False)).alias("is_delete"),
        F.when(~F.col("dt_date").isin(0, -1), F.col("dt_date")).alias("dt_date"),
        F.when(F.col("dt_size") != -1, F.col("dt_size")).alias("dt_size"),
        F.when(F.col("dt_attr") != 0, F.col("dt_attr")).alias("dt_attr"),
    )


def _setting(name: str) -> Column:
    """What a patch does to an attribute: null leaves it, a struct sets its value, perhaps to unknown."""
    return F.when(F.col("is_delete"), F.struct(F.lit(None).cast("bigint").alias("v"))).when(F.col(name).isNotNull(), F.struct(F.col(name).alias("v")))


class CheckpointHistory:
    """Checkpoint and patch tables of a keyed history.

    ``patches``: key columns, epoch, version_no, is_delete and the attributes
    (null: unchanged). ``checkpoints``: key columns, epoch, was_alive and the
    attributes as they stood before the epoch's first patch.
    """

    def __init__(self, patches: DataFrame, checkpoints: DataFrame, keys: Sequence[str], every: int):
        self.patches, self.checkpoints, self.keys, self.every = patches, checkpoints, list(keys), every

    @classmethod
    def build(cls, records: DataFrame, keys: Sequence[str] = ("archive_id", "dt_path"), every: int = EVERY, folder: str | None = None) -> CheckpointHistory:
        """From records of (keys, version_no, seq_no, is_delete, ATTRIBUTES); of a key's records in one version the largest seq_no counts.

        With a folder both tables are stored there in buckets of (keys, epoch), so
        that the records are worked through once and nothing that follows
        exchanges the patches again.
        """
        keys = list(keys)
        epoch = F.floor(F.col("version_no") / every).cast("bigint")
        parted = records.withColumn("epoch", epoch).repartition(*keys, "epoch")
        top = Window.partitionBy(*keys, "epoch", "version_no").orderBy(F.desc_nulls_last("seq_no"))
        patches = parted.withColumn("_n", F.row_number().over(top)).filter("_n = 1").drop("_n", "seq_no")
        store = lambda rows: rows
        if folder is not None:
            buckets = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            store = lambda rows: write_bucketed(rows, folder, buckets, *keys, "epoch")
        patches = store(patches)
        by_version = Window.partitionBy(*keys, "epoch").orderBy("version_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        last_row = Window.partitionBy(*keys, "epoch").orderBy(F.desc("version_no"))
        composed = (
            patches.select(
                *keys,
                "epoch",
                (~F.col("is_delete")).alias("alive"),
                F.row_number().over(last_row).alias("_n"),
                *(F.last(_setting(c), True).over(by_version).alias(c) for c in ATTRIBUTES),
            )
            .filter("_n = 1")
            .drop("_n")
        )
        before = Window.partitionBy(*keys).orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
        checkpoints = composed.select(  # one row an epoch of a key
            *keys,
            "epoch",
            F.coalesce(F.last("alive").over(before), F.lit(False)).alias("was_alive"),
            *(F.last(c, True).over(before)["v"].alias(c) for c in ATTRIBUTES),
        )
        return cls(patches, store(checkpoints), keys, every)

    def states(self) -> DataFrame:
        """Every patch with the full state after it: ``s_`` columns, and ``p_`` columns for the state before."""
        held = self.checkpoints.select(*self.keys, "epoch", "was_alive", *(F.col(c).alias(f"c_{c}") for c in ATTRIBUTES))
        rows = self.patches.join(held, [*self.keys, "epoch"], "left")
        w = Window.partitionBy(*self.keys, "epoch").orderBy("version_no")
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        earlier = w.rowsBetween(Window.unboundedPreceding, -1)

        def folded(c: str, frame) -> Column:
            set_here = F.last(_setting(c), True).over(frame)
            return F.when(set_here.isNotNull(), set_here["v"]).otherwise(F.col(f"c_{c}"))

        return rows.select(
            *self.keys,
            "epoch",
            "version_no",
            "is_delete",
            F.coalesce(F.lag(~F.col("is_delete")).over(w), F.col("was_alive"), F.lit(False)).alias("p_alive"),
            *(folded(c, upto).alias(f"s_{c}") for c in ATTRIBUTES),
            *(folded(c, earlier).alias(f"p_{c}") for c in ATTRIBUTES),
        )

    def periods(self) -> DataFrame:
        """Validity rows: keys, valid_from, valid_to (0: still holds) and the attributes as they held."""
        keys = self.keys
        differs = F.lit(False)
        for c in ATTRIBUTES:
            differs = differs | ~F.col(f"s_{c}").eqNullSafe(F.col(f"p_{c}"))
        marks = self.states().filter(F.when(F.col("is_delete"), F.col("p_alive")).otherwise(~F.col("p_alive") | differs))
        in_epoch = Window.partitionBy(*keys, "epoch").orderBy("version_no")
        marks = marks.select(*keys, "epoch", "version_no", "is_delete", *(F.col(f"s_{c}").alias(c) for c in ATTRIBUTES)).withColumn("_to", F.lead("version_no").over(in_epoch))
        following = marks.groupBy(*keys, "epoch").agg(F.min("version_no").alias("_first"))
        following = following.select(*keys, "epoch", F.lead("_first").over(Window.partitionBy(*keys).orderBy("epoch")).alias("_next"))
        rows = marks.filter(~F.col("is_delete")).join(following, [*keys, "epoch"], "left")
        return rows.select(*keys, F.col("version_no").alias("valid_from"), F.coalesce("_to", "_next", F.lit(0)).cast("int").alias("valid_to"), *ATTRIBUTES)

    def as_of(self, version_no: int) -> DataFrame:
        """Live keys and their attributes after the given version, from each key's nearest checkpoint."""
        reached = self.patches.filter(F.col("version_no") <= version_no)
        near = reached.groupBy(*self.keys).agg(F.max("epoch").alias("epoch"))
        at = CheckpointHistory(reached.join(near, [*self.keys, "epoch"], "left_semi"), self.checkpoints, self.keys, self.every)
        latest = Window.partitionBy(*self.keys).orderBy(F.desc("version_no"))
        rows = at.states().withColumn("_n", F.row_number().over(latest)).filter("_n = 1 and not is_delete")
        return rows.select(*self.keys, *(F.col(f"s_{c}").alias(c) for c in ATTRIBUTES))

    def write(self, path: str) -> None:
        """Store both tables as Parquet, sorted by key, below ``path``."""
        for name in ("patches", "checkpoints"):
            getattr(self, name).sortWithinPartitions(*self.keys).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def read(cls, spark, path: str, keys: Sequence[str] = ("archive_id", "dt_path"), every: int = EVERY) -> CheckpointHistory:
        return cls(spark.read.parquet(f"{path}/patches"), spark.read.parquet(f"{path}/checkpoints"), keys, every)


def attribute_periods(entries: DataFrame, versions: DataFrame, every: int = EVERY) -> DataFrame:
    """Periods in which each path's attributes held; see :func:`committed_records` for what counts.

    A delete ends the running period and forgets all values; an unrecorded
    value keeps the running period's. Empty tables give no periods; extra
    columns are ignored.
    """
    folder = scratch_path(entries.sparkSession, "attribute-history")
    return CheckpointHistory.build(committed_records(entries, versions), every=every, folder=folder).periods()
