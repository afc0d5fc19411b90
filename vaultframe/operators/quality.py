"""What is wrong in an archive's tables: each rule that they should keep, with the number of rows that break it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vaultframe.functions.dates import to_timestamp


def _counted(rows: DataFrame, **rules) -> DataFrame:
    """(problem, n) from conditions over one table, in one pass."""
    sums = rows.agg(*(F.count(F.when(c, 1)).alias(name) for name, c in rules.items()))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(name).alias("problem"), F.col(name).alias("n")) for name in rules))).alias("x")).select("x.*")


def archive_problems(versions: DataFrame, blocks: DataFrame, fragments: DataFrame, entries: DataFrame) -> DataFrame:
    """(problem, n) for every rule, also for those that nothing breaks.

    Versions: never committed; a date that isn't later than that of the version
    before. Blocks: no stored size; begins before the end of the block before it in
    its version; other fragments than announced. Fragments: no key; unknown size; a
    key that another fragment has too. Entries: a null path; a date that is none; an
    unknown attribute tag; no list of fragments though not a delete; a pointer to no
    fragment.
    """
    along = Window.partitionBy("archive_id").orderBy("version_no")
    of_versions = _counted(
        versions.select("ver_csize", "ver_date", F.lag("ver_date").over(along).alias("before")),
        version_uncommitted=F.col("ver_csize") < 0,
        version_date_not_later=F.col("ver_date") <= F.col("before"),
    )
    in_version = Window.partitionBy("version_id").orderBy("blk_start", "block_id")
    present = fragments.filter("block_id is not null").groupBy("block_id").agg(F.count("*").alias("present"))
    placed = blocks.select("block_id", "blk_bsize", "blk_start", "blk_frags", F.lag(F.col("blk_start") + F.col("blk_frags")).over(in_version).alias("after")).join(present, "block_id", "left")
    of_blocks = _counted(
        placed,
        block_without_size=F.col("blk_bsize").isNull(),
        block_overlaps=F.col("blk_start") < F.col("after"),
        block_fragments_differ=F.coalesce("present", F.lit(0)) != F.coalesce("blk_frags", F.lit(0)),
    )
    no_key = F.col("ht_sha1").isNull() | (F.col("ht_sha1") == F.lit(b"\0" * 20))
    of_fragments = _counted(fragments, fragment_without_key=no_key, fragment_size_unknown=F.coalesce("ht_usize", F.lit(-1)) < 0)
    again = fragments.filter(~no_key).groupBy("ht_sha1").agg((F.count("*") - 1).alias("n"))
    twice = again.agg(F.lit("fragment_key_again").alias("problem"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    delete = F.coalesce(F.col("dt_date") == 0, F.lit(False))
    of_entries = _counted(
        entries,
        entry_without_path=F.col("dt_path").isNull(),
        entry_date_wrong=(F.col("dt_date") > 0) & to_timestamp(F.col("dt_date")).isNull(),
        entry_tag_unknown=(F.col("dt_attr") != 0) & ~F.col("dt_attr").bitwiseAND(255).isin(ord("u"), ord("w")),
        entry_without_list=F.col("dt_ptr").isNull() & ~delete,
    )
    uses = entries.select(F.explode("dt_ptr").alias("frag_id")).groupBy("frag_id").agg(F.count("*").alias("n"))
    lost = uses.join(fragments.select("frag_id"), "frag_id", "left_anti").agg(F.lit("pointer_to_nothing").alias("problem"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    out = of_versions
    for rows in (of_blocks, of_fragments, twice, of_entries, lost):
        out = out.unionByName(rows)
    return out
