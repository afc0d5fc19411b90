"""Comparing two sets of files, and listings by size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VALUES = ("dt_date", "dt_size", "dt_attr")


def same_by_metadata(a: str = "a_", b: str = "b_") -> Column:
    """Date and size are equal (null is a value), and so is attr unless either is unrecorded (0 or null)."""
    attr = F.coalesce(F.col(f"{a}dt_attr") == 0, F.lit(True)) | F.coalesce(F.col(f"{b}dt_attr") == 0, F.lit(True)) | (F.col(f"{a}dt_attr") == F.col(f"{b}dt_attr"))
    return F.col(f"{a}dt_date").eqNullSafe(F.col(f"{b}dt_date")) & F.col(f"{a}dt_size").eqNullSafe(F.col(f"{b}dt_size")) & attr


def matched(internal: DataFrame, external: DataFrame, keys=("archive_id", "dt_path")) -> DataFrame:
    """Full outer join of two file sets: keys, ``a_`` and ``b_`` values, has_a, has_b."""
    side = lambda df, p: df.select(*keys, *(F.col(c).alias(f"{p}{c}") for c in VALUES), F.lit(True).alias(f"has_{p[0]}"))
    return side(internal, "a_").join(side(external, "b_"), list(keys), "full_outer").fillna(False, ["has_a", "has_b"])


def compare(internal: DataFrame, external: DataFrame, keys=("archive_id", "dt_path"), hide: str = "") -> DataFrame:
    """Marked rows: ``=`` same, ``#`` different (a row for each side: ``#`` inside, ``+`` outside), ``-`` only inside, ``+`` only outside.

    Marks in ``hide`` are left out, and with any given also the same ones.
    """
    both = matched(internal, external, keys)
    mark = F.when(~F.col("has_a"), "+").when(~F.col("has_b"), "-").when(same_by_metadata(), "=").otherwise("#")
    row = lambda m, p: F.struct(m.alias("mark"), *(F.col(f"{p}{c}").alias(c) for c in VALUES))
    marked = both.withColumn("m", mark)
    one = F.when(F.col("m") == "+", row(F.lit("+"), "b_")).otherwise(row(F.col("m"), "a_"))
    two = F.when(F.col("m") == "#", row(F.lit("+"), "b_"))
    rows = marked.select(*keys, F.explode(F.filter(F.array(one, two), lambda x: x.isNotNull())).alias("r")).select(*keys, "r.*")
    hidden = set(hide) | ({"="} if hide else set())
    return rows.filter(~F.col("mark").isin(*hidden)) if hidden else rows


def report(rows: DataFrame, attributes: bool = True, fragments: bool = False) -> DataFrame:
    """One line of text a row of a listing: mark, date, size in 12 places (an unknown one as -1), perhaps attributes, path, and perhaps the list of fragments."""
    from vaultframe.functions.dates import attr_text, date_text
    from vaultframe.operators.rollup import pointer_text

    parts = [F.col("mark"), date_text(F.col("dt_date")), F.lpad(F.coalesce("dt_size", F.lit(-1)).cast("string"), 12, " ")]
    parts += [F.coalesce(attr_text(F.col("dt_attr")), F.lit(" " * 5))] if attributes else []
    parts += [F.col("dt_path")] + ([F.coalesce(pointer_text(F.col("dt_ptr")), F.lit(""))] if fragments else [])
    return rows.select("dt_path", F.concat_ws(" ", *parts).alias("line"))


def mark_counts(marked: DataFrame, *by: str) -> DataFrame:
    """How often each mark occurs; the outer side of a different file counts as outer too."""
    names = {"=": "same", "#": "different", "+": "external", "-": "internal"}
    return marked.groupBy(*by).agg(*(F.count(F.when(F.col("mark") == m, 1)).alias(n) for m, n in names.items()))


def needs_reading(internal: DataFrame, external: DataFrame, force: bool = False, keys=("archive_id", "dt_path")) -> DataFrame:
    """External files whose content must be read: new ones and those of other date or size; no directories."""
    both = matched(internal, external, keys).filter(F.col("has_b") & ~F.col("dt_path").endswith("/"))
    changed = ~F.col("has_a") | ~F.col("a_dt_date").eqNullSafe(F.col("b_dt_date")) | ~F.col("a_dt_size").eqNullSafe(F.col("b_dt_size"))
    return both.filter(F.lit(force) | changed).select(*keys, *(F.col(f"b_{c}").alias(c) for c in VALUES))


def needs_entry(internal: DataFrame, external: DataFrame, keys=("archive_id", "dt_path")) -> DataFrame:
    """External files for which an entry is written: new ones, and those of other date, size or attr (an unrecorded inner attr never differs)."""
    both = matched(internal, external, keys).filter("has_b")
    attr = F.coalesce((F.col("a_dt_attr") != 0) & ~F.col("a_dt_attr").eqNullSafe(F.col("b_dt_attr")), F.lit(False))
    changed = ~F.col("has_a") | ~F.col("a_dt_date").eqNullSafe(F.col("b_dt_date")) | ~F.col("a_dt_size").eqNullSafe(F.col("b_dt_size")) | attr
    return both.filter(changed).select(*keys, *(F.col(f"b_{c}").alias(c) for c in VALUES))


def needs_delete(internal: DataFrame, external: DataFrame, keys=("archive_id", "dt_path")) -> DataFrame:
    """Live inner files that aren't there outside."""
    return internal.join(external.select(*keys), list(keys), "left_anti")


def restore_actions(stored: DataFrame, present: DataFrame, force: bool = False, keys=("archive_id", "dt_path")) -> DataFrame:
    """What restoring does with each stored file: ``=`` is there and the same, ``?`` exists and is kept, ``#`` is overwritten, ``>`` is written."""
    both = matched(stored, present, keys).filter("has_a")
    action = F.when(~F.col("has_b"), ">").when(same_by_metadata(), "=").otherwise("#" if force else "?")
    return both.select(*keys, action.alias("action"))


def size_order() -> list[Column]:
    """Size falling, then list of fragments, mark, path."""
    return [F.desc_nulls_last("dt_size"), F.asc_nulls_first("dt_ptr"), F.asc("mark"), F.asc("dt_path")]


def largest(rows: DataFrame, n: int, *extra: Column) -> DataFrame:
    """The first n rows in :func:`size_order`, with ``^`` for a live file that has the same non-empty list as the row before. Only n rows are ever gathered."""
    top = rows.orderBy(*size_order(), *extra).limit(n)
    w = Window.orderBy(*size_order(), *extra)  # over n rows
    twin = (F.size("dt_ptr") > 0) & (F.lag("dt_ptr").over(w) == F.col("dt_ptr")) & F.coalesce(F.col("dt_date") != 0, F.lit(True)) & ~F.col("dt_path").endswith("/") & (F.col("dt_path") != "")
    return top.withColumn("mark", F.when(F.coalesce(twin, F.lit(False)), "^").otherwise(F.col("mark")))


def twins(rows: DataFrame) -> DataFrame:
    """Files whose list of fragments another file of the archive has too, with the number that share it; without sorting them all."""
    same = rows.filter("size(dt_ptr) > 0").groupBy("archive_id", "dt_ptr").agg(F.count("*").alias("copies")).filter("copies > 1")
    return rows.join(same, ["archive_id", "dt_ptr"]).select("archive_id", "dt_path", "copies")
