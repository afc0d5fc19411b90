"""Files outside: directory trees as DataFrames, sets of numbered parts, and writing files back."""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Iterator, Sequence
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultframe.functions.dates import decimal_date
from vaultframe.functions.paths import pattern_regex
from vaultframe.session import scratch_path

LISTING = "dt_path string, dt_date bigint, dt_size bigint, dt_attr bigint"


def read_tree(spark: SparkSession, path: str) -> DataFrame:
    """Files below a folder of any file system Spark reads: dt_path, dt_date, dt_size, dt_attr (unrecorded) and content, which is read only where it is used. Spark's binary source leaves empty files out; :func:`scan_local` has them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("dt_path"), decimal_date(F.col("modificationTime")).alias("dt_date"), F.col("length").alias("dt_size"), F.lit(0).cast("bigint").alias("dt_attr"), "content")


def walk(root: str, exclude: Sequence[str] = ()) -> Iterator[tuple[str, int, int, int]]:
    """(path, date, size, attr) of regular files and directories (with ``/`` at the end) below a local folder, links and special files left out, excluded directories not entered."""
    tests = [re.compile(pattern_regex(p).replace(r"\z", r"\Z"), re.DOTALL) for p in exclude]
    todo = [root.rstrip("/") or "/"]
    while todo:
        path = todo.pop()
        try:
            info = os.lstat(path)
        except OSError:
            continue
        folder = stat.S_ISDIR(info.st_mode)
        name = path + "/" if folder else path
        raw = name.encode("utf-8", "surrogateescape").decode("iso-8859-1")
        if not (folder or stat.S_ISREG(info.st_mode)) or any(t.match(raw) for t in tests):
            continue
        date = int(datetime.fromtimestamp(int(info.st_mtime), UTC).strftime("%Y%m%d%H%M%S"))
        yield name, date, 0 if folder else info.st_size, ord("u") + (info.st_mode << 8)
        if folder:
            try:
                todo += [os.path.join(path, x) for x in os.listdir(path)]
            except OSError:
                continue


def scan_local(spark: SparkSession, roots: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Listing with modes of folders that all executors mount; each task walks some roots, so give subfolders of a large tree."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for (root,) in zip(batch.column(0).to_pylist()):
                found = walk(root, exclude)
                while part := [x for _, x in zip(range(10_000), found)]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), (pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["dt_path", "dt_date", "dt_size", "dt_attr"])

    return spark.createDataFrame([(r,) for r in roots], "root string").repartition(max(len(roots), 1)).mapInArrow(run, LISTING)


def with_content(listing: DataFrame) -> DataFrame:
    """Adds the content of listed local files; null for directories and what can't be read. Filter the listing first."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                row, path = batch.slice(k, 1), batch.column("dt_path")[k].as_py()
                data = None
                if path and not path.endswith("/"):
                    try:
                        with open(path, "rb") as f:
                            data = f.read()
                    except OSError:
                        pass
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([data], pa.binary())], [*row.schema.names, "content"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listing.schema)
    return listing.mapInArrow(run, f"{kinds}, content binary")


def write_files(files: DataFrame, root: str, dry_run: bool = False) -> DataFrame:
    """Writes (dt_path, dt_date, dt_attr, content) below a folder that all executors mount; gives (dt_path, problem), null where it went well.

    Paths that end in ``/`` are folders; others are made as needed. Blocks of zeros
    become holes, dates and modes are set. Files are all written when this
    returns; dates and modes of folders are set after that, the deepest first,
    so that a file doesn't touch them again and a folder that can't be written
    to can still be filled. Rows without content are passed over, as are paths that
    lead out of the folder. ``dry_run`` checks and writes nothing.
    """
    top = os.path.abspath(root)

    def place(path):
        target = os.path.abspath(os.path.join(root, (path or "").lstrip("/")))
        return target if path and os.path.commonpath([top, target]) == top else None

    def mark(target, date, attr):
        if date and date > 0:
            at = datetime.strptime(f"{date:014d}", "%Y%m%d%H%M%S").replace(tzinfo=UTC).timestamp()
            os.utime(target, (at, at))
        if attr and attr & 255 == ord("u"):
            os.chmod(target, attr >> 8 & 0o7777)

    def write(path, date, attr, data):
        target = place(path)
        if target is None:
            return "the path leads out of the folder"
        if dry_run:
            return None
        if path.endswith("/"):
            os.makedirs(target, exist_ok=True)
            return None
        if data is None:
            return "no content"
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(target, "wb") as f:
            for k in range(0, len(data), 1 << 16):
                piece = data[k : k + (1 << 16)]
                if any(piece):
                    f.seek(k)
                    f.write(piece)
            f.truncate(len(data))
        mark(target, date, attr)

    def finish(path, date, attr):
        if not dry_run and (target := place(path)) is not None:
            mark(target, date, attr)

    def each(columns, work):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                problems = []
                for row in zip(*(batch.column(c).to_pylist() for c in columns)):
                    try:
                        problems.append(work(*row))
                    except (OSError, ValueError) as e:
                        problems.append(str(e))
                yield pa.RecordBatch.from_arrays([batch.column("dt_path"), pa.array(problems, pa.string())], ["dt_path", "problem"])

        return run

    spark, kind = files.sparkSession, "dt_path string, problem string"
    done = scratch_path(spark, "written")
    named = files.filter("dt_path is not null")
    named.select("dt_path", "dt_date", "dt_attr", "content").mapInArrow(each(("dt_path", "dt_date", "dt_attr", "content"), write), kind).write.parquet(done)
    written = spark.read.schema(kind).parquet(done)
    parts = F.size(F.split(F.regexp_replace("dt_path", "/+$", ""), "/+"))
    folders = named.filter(F.col("dt_path").endswith("/")).select("dt_path", "dt_date", "dt_attr", parts.alias("deep"))
    late = scratch_path(spark, "finished")
    # One job a depth; a path has some dozens of parts at most.
    depths = sorted((r["deep"] for r in folders.select("deep").distinct().collect()), reverse=True)
    for deep in depths:
        rows = folders.filter(F.col("deep") == deep).drop("deep").mapInArrow(each(("dt_path", "dt_date", "dt_attr"), finish), kind)
        rows.filter("problem is not null").write.mode("append").parquet(late)
    if not depths:
        return written
    late = spark.read.schema(kind).parquet(late).groupBy("dt_path").agg(F.first("problem").alias("late"))
    return written.join(late, "dt_path", "left").select("dt_path", F.coalesce("problem", "late").alias("problem"))


def part_name(pattern: str, part: int) -> str:
    """Name of a part: ``*`` is its number, a ``?`` one digit of it, from the right."""
    digits, out = part, []
    for c in reversed(pattern):
        if c == "?":
            out.append(str(digits % 10))
            digits //= 10
        else:
            out.append(str(part)[::-1] if c == "*" else c)
    return "".join(out)[::-1]


def part_paths(spark: SparkSession, pattern: str) -> list[str]:
    """The parts 1, 2, ... that exist, up to the first that doesn't; the pattern itself where it names one table."""
    if not re.search(r"[*?]", pattern):
        return [pattern]
    jvm, out = spark.sparkContext._jvm, []
    while True:
        path = jvm.org.apache.hadoop.fs.Path(part_name(pattern, len(out) + 1))
        if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path) or path.toString() in out:
            return out
        out.append(path.toString())


def read_parts(spark: SparkSession, pattern: str) -> DataFrame:
    """All parts of a table as one, with ``part``, the number of each row's part."""
    out = None
    for k, p in enumerate(part_paths(spark, pattern), 1):
        rows = spark.read.parquet(p).withColumn("part", F.lit(k))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise FileNotFoundError(pattern)
    return out
