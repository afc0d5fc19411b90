"""Sizes, rollups, storage statistics, running sums and runs of numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pointers(files: DataFrame, *keep: str) -> DataFrame:
    """One row a pointer: the kept columns, pos and frag_id."""
    return files.select(*keep, F.posexplode("dt_ptr").alias("pos", "frag_id"))


def file_sizes(files: DataFrame, fragments: DataFrame, key: str = "entry_id") -> DataFrame:
    """(key, content_size): the sum of the sizes that dt_ptr names; -1 if any is unknown; pointers to no row add 0, as does no list."""
    sizes = fragments.filter("frag_id is not null").select("frag_id", F.coalesce("ht_usize", F.lit(-1)).alias("u"))
    found = pointers(files, key).join(sizes, "frag_id").groupBy(key).agg(F.min("u").alias("low"), F.sum(F.col("u").cast("bigint")).alias("sum"))
    size = F.when(F.col("low") < 0, F.lit(-1)).otherwise(F.coalesce("sum", F.lit(0)))
    return files.select(key).join(found, key, "left").select(key, size.cast("bigint").alias("content_size"))


def ancestors(path: Column) -> Column:
    """All directories above a path, each ending in a slash, itself left out."""
    parts = F.split(path, "/")
    depth = F.size(parts) - F.when(path.endswith("/"), 2).otherwise(1)
    return F.when(depth > 0, F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/"))))


def directory_sizes(files: DataFrame, key: str = "archive_id") -> DataFrame:
    """(key, dt_path, total_size, n_files) of each directory that has a row: the sizes of the files below it, unknown ones as 0. The sizes are added up before they are shuffled."""
    known = F.coalesce(F.greatest("dt_size", F.lit(0)), F.lit(0))
    below = files.filter(~F.col("dt_path").endswith("/")).select(key, known.alias("size"), F.explode(ancestors(F.col("dt_path"))).alias("dt_path"))
    sums = below.groupBy(key, "dt_path").agg(F.sum("size").alias("total_size"), F.count("*").alias("n_files"))
    dirs = files.filter(F.col("dt_path").endswith("/")).select(key, "dt_path").distinct()
    return dirs.join(sums, [key, "dt_path"], "left").fillna(0, ["total_size", "n_files"])


def dedupe_stats(files: DataFrame, fragments: DataFrame, key: str = "archive_id") -> DataFrame:
    """(key, n_files, refs, n_frags, all_size, dedupe_size, unknown) over live files: references, distinct fragments, and their bytes before and after dedupe."""
    uses = pointers(files, key).groupBy(key, "frag_id").agg(F.count("*").alias("n")).join(fragments.select("frag_id", F.coalesce("ht_usize", F.lit(-1)).alias("u")), "frag_id")
    known = F.when(F.col("u") >= 0, F.col("u").cast("bigint")).otherwise(0)
    sums = uses.groupBy(key).agg(F.sum("n").alias("refs"), F.count("*").alias("n_frags"), F.sum(known * F.col("n")).alias("all_size"), F.sum(known).alias("dedupe_size"), F.count(F.when(F.col("u") < 0, 1)).alias("unknown"))
    return files.groupBy(key).agg(F.count("*").alias("n_files")).join(sums, key, "left").fillna(0)


def shown_bytes(files: DataFrame, *by: str) -> DataFrame:
    """Bytes of the listed files, directories left out."""
    return files.filter(~F.col("dt_path").endswith("/") & (F.col("dt_path") != "")).groupBy(*by).agg(F.sum(F.coalesce("dt_size", F.lit(0))).alias("shown_bytes"), F.count("*").alias("shown_files"))


def running(value: str, by: list[str], order: list[str]) -> Column:
    """Sum of ``value`` over the rows before this one."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(F.coalesce(value, F.lit(0)).cast("bigint")).over(w), F.lit(0))


def block_offsets(blocks: DataFrame) -> DataFrame:
    """Where each block's data begins within its version, by the stored sizes of those before it; an unknown size adds 0."""
    return blocks.select("block_id", "version_id", running("blk_bsize", ["version_id"], ["blk_start", "block_id"]).alias("data_offset"))


def fragment_offsets(fragments: DataFrame) -> DataFrame:
    """Where each fragment begins within its block; unknown sizes add 0."""
    known = fragments.filter("block_id is not null").withColumn("u", F.greatest(F.coalesce("ht_usize", F.lit(0)), F.lit(0)))
    return known.select("frag_id", "block_id", running("u", ["block_id"], ["pos_in_block", "frag_id"]).alias("offset_in_block"))


def file_offsets(files: DataFrame, fragments: DataFrame, key: str = "entry_id") -> DataFrame:
    """Where each fragment begins within its file; unknown sizes and pointers to no row add 0."""
    sizes = fragments.select("frag_id", F.greatest(F.coalesce("ht_usize", F.lit(0)), F.lit(0)).alias("u"))
    rows = pointers(files, key).join(sizes, "frag_id", "left")
    return rows.select(key, "pos", "frag_id", running("u", [key], ["pos"]).alias("offset_in_file"))


def block_check(blocks: DataFrame, fragments: DataFrame) -> DataFrame:
    """Each block's announced and present fragments, and its size as announced and as counted: 8 bytes and 4 more than its bytes for each fragment."""
    counted = fragments.filter("block_id is not null").groupBy("block_id").agg(F.count("*").alias("frags_present"), (F.sum(F.greatest(F.coalesce("ht_usize", F.lit(0)), F.lit(0)).cast("bigint") + 4) + 8).alias("usize_counted"))
    return blocks.select("block_id", "blk_frags", "blk_usize").join(counted, "block_id", "left").fillna(0, ["frags_present"])


def id_runs(ids: DataFrame, by: list[str], value: str) -> DataFrame:
    """Runs of successive distinct numbers: by, first_id, last_id, n."""
    distinct = ids.select(*by, F.col(value).alias("v")).distinct()
    island = F.col("v") - F.row_number().over(Window.partitionBy(*by).orderBy("v"))
    return distinct.withColumn("_g", island).groupBy(*by, "_g").agg(F.min("v").alias("first_id"), F.max("v").alias("last_id"), F.count("*").alias("n")).drop("_g")


def pointer_text(ptr: Column) -> Column:
    """A list of numbers as text: those within a run of three or more are one hyphen between its ends."""
    n = F.size(ptr)
    at = lambda i: F.get(ptr, i)
    inner = lambda i: (i > 0) & (i < n - 1) & (at(i) == at(i - 1) + 1) & (at(i) == at(i + 1) - 1)
    piece = lambda i: F.when(inner(i), F.when(inner(i - 1), "").otherwise("-")).otherwise(F.concat(F.when((i > 0) & ~F.coalesce(inner(i - 1), F.lit(False)), " ").otherwise(""), at(i).cast("string")))
    text = F.array_join(F.transform(F.sequence(F.lit(0), n - 1), piece), "")
    return F.when(n > 0, text).otherwise("")


def reading_plan(files: DataFrame, fragments: DataFrame) -> DataFrame:
    """Blocks that the files need, and how much of each: block_id, frags_needed (up to the last needed one) and frags_used."""
    used = pointers(files).select("frag_id").distinct().join(fragments.filter("block_id is not null").select("frag_id", "block_id", "pos_in_block"), "frag_id")
    return used.groupBy("block_id").agg((F.max("pos_in_block") + 1).cast("bigint").alias("frags_needed"), F.count("*").alias("frags_used"))


def kept_blocks(blocks: DataFrame, files: DataFrame, fragments: DataFrame) -> DataFrame:
    """The blocks that a repacked archive of these files holds."""
    return blocks.join(reading_plan(files, fragments).select("block_id"), "block_id", "left_semi")


def failed_files(files: DataFrame, fragments: DataFrame, bad_blocks: DataFrame, key: str = "entry_id") -> DataFrame:
    """Files that can't be restored whole, with the fragments that can and all they have."""
    place = fragments.select("frag_id", "block_id")
    rows = pointers(files, key).join(place, "frag_id", "left").join(bad_blocks.select("block_id", F.lit(True).alias("bad")), "block_id", "left")
    good = F.col("block_id").isNotNull() & F.col("bad").isNull()
    return rows.groupBy(key).agg(F.count(F.when(good, 1)).alias("restored"), F.count("*").alias("total")).filter("restored < total")


def stream_files(segments: DataFrame) -> DataFrame:
    """Files of a stream of segments: one with a name begins a file of its origin, those without continue it. (origin, file_no, seg_name, first_seg, segments, bytes); segments before the first name are file 0.

    Each origin's stream is one sequence, but only its files' beginnings are numbered
    in one: a segment finds its file by the count of beginnings before it within its
    stretch of ids, and that of the stretches before.
    """
    stretch = 1 << 16
    begins = (F.coalesce(F.col("seg_name"), F.lit("")) != "").cast("bigint")
    rows = segments.withColumn("_s", F.floor(F.col("seg_id") / stretch)).withColumn("_b", begins)
    per = rows.groupBy("origin", "_s").agg(F.sum("_b").alias("_n"))
    per = per.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("origin").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.sum("_b").over(Window.partitionBy("origin", "_s").orderBy("seg_id"))
    rows = rows.withColumn("_w", within).alias("r").join(per.alias("p"), F.expr("r.origin <=> p.origin and r._s <=> p._s"))
    rows = rows.select("r.origin", "r.seg_id", "r.seg_name", "r.ht_usize", "_b", (F.col("_w") + F.col("_before")).alias("file_no"))
    return rows.groupBy("origin", "file_no").agg(F.max(F.when(F.col("_b") == 1, F.col("seg_name"))).alias("seg_name"), F.min("seg_id").alias("first_seg"), F.count("*").alias("segments"), F.sum(F.greatest(F.coalesce("ht_usize", F.lit(0)), F.lit(0)).cast("bigint")).alias("bytes"))


def comment_values(comment):
    """(date, attr) that a segment's comment has: 14 digits, then perhaps a blank, the tag ``u`` or ``w`` and a number; null where it hasn't."""
    parts = lambda k: F.nullif(F.regexp_extract(comment, r"^\s*(\d{1,18})(?:\s+([uw])(\d{1,9}))?", k), F.lit(""))
    return parts(1).cast("bigint"), F.ascii(parts(2)) + parts(3).cast("bigint") * 256


def stream_entries(segments: DataFrame) -> DataFrame:
    """The files of :func:`stream_files` as entries: (origin, file_no, dt_path, dt_date, dt_size, dt_attr), date and attr from the comment of the segment that begins each."""
    date, attr = comment_values(F.col("seg_comment"))
    first = segments.select(F.col("seg_id").alias("first_seg"), date.alias("dt_date"), attr.alias("dt_attr"))
    files = stream_files(segments).filter("seg_name is not null").join(first, "first_seg")
    return files.select("origin", "file_no", F.col("seg_name").alias("dt_path"), "dt_date", F.col("bytes").alias("dt_size"), "dt_attr")
