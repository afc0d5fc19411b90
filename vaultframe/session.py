"""Session defaults and the shared folder in which lineage is cut."""

from __future__ import annotations

import hashlib
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hands this package to the executors, once an application, so that their Python workers find it wherever they start."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    handle, name = tempfile.mkstemp(prefix="vaultframe-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(name)
    _SHIPPED.add(context.applicationId)


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the library's defaults, for tests and the bench."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in {**_DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one on a local master. A cluster without the setting is an error, as no folder of one machine would do."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if folder is None:
        folder = context.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir isn't set: it names the folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="vaultframe-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


_SCRATCH: dict[str, list[str]] = {}
_TABLES: dict[str, list[str]] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for a table that cuts lineage."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what this application has put below the shared folder, and its tables in the catalogue, when no result that reads them is needed any more."""
    for name in _TABLES.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    for path in _SCRATCH.pop(spark.sparkContext.applicationId, []):
        target, fs = _file(spark, path)
        fs.delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_table(spark, sf_dir: str, name: str):
    """The rows of a table as a stream, be it one file or a folder of files, with its partitions.

    A stream takes a plain path as a folder, and a file that is named by a pattern
    as it is; only the table itself is listed, not what lies beside it.
    """
    path, fs = _file(spark, f"{sf_dir}/{name}.parquet")
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    return reader.parquet(f"{sf_dir}/{name}.parquet" if fs.getFileStatus(path).isDirectory() else f"{sf_dir}/{{{name}}}.parquet")


def write_bucketed(rows, folder: str, buckets: int, *key: str):
    """Writes a table below a folder in buckets of a key, one sorted file each, and reads it back: joins and windows on the key then need no exchange."""
    name = f"vaultframe_{uuid.uuid4().hex}"
    rows.repartition(buckets, *key).write.bucketBy(buckets, *key).sortBy(*key).option("path", f"{folder}/{name}").saveAsTable(name)
    _TABLES.setdefault(rows.sparkSession.sparkContext.applicationId, []).append(name)
    return rows.sparkSession.table(name)


def spread(frame):
    """The rows over at least as many partitions as there are cores, for work that costs far more than a shuffle.

    Only a frame with fewer splits than cores is exchanged, as where a table is one
    small file; a large table has splits enough and stays as it is.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    splits = frame._jdf.queryExecution().toRdd().getNumPartitions()
    return frame if splits >= cores else frame.repartition(cores)


def _file(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read_whole(spark: SparkSession, path) -> str | None:
    """The text of one numbered file, None if it isn't whole."""
    stream = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(path)
    try:
        digest, _, body = bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).partition(b"\n")
    finally:
        stream.close()
    return body.decode() if hashlib.sha256(body).hexdigest().encode() == digest else None


def _numbered(spark: SparkSession, path: str) -> list[tuple[int, object]]:
    """(number, path) of the files of a small text, the latest first."""
    target, fs = _file(spark, path)
    found = fs.listStatus(target.getParent()) if fs.exists(target.getParent()) else []
    mine = ((re.fullmatch(re.escape(target.getName()) + r"\.(\d{9})", f.getPath().getName()), f.getPath()) for f in found)
    return sorted(((int(m[1]), p) for m, p in mine if m), key=lambda x: -x[0])


#: Earlier texts that are kept beside the latest.
KEPT = 2


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Commits a small text in one step, as the next of the numbered files ``path.NNNNNNNNN``.

    It is written under a temporary name and renamed to a number that no file
    has, with its checksum in the first line; the largest number of a whole file
    is the text that counts. So at any moment either the text before or the new
    one is read. Two writers can't take one number: the second is refused.
    """
    number = max((n for n, _ in _numbered(spark, path)), default=0) + 1
    part, fs = _file(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(part, False)
    out.write(bytearray(hashlib.sha256(text.encode()).hexdigest().encode() + b"\n" + text.encode()))
    out.close()
    target = _file(spark, f"{path}.{number:09d}")[0]
    if fs.exists(target) or not fs.rename(part, target):
        raise OSError(f"{path} was committed by another writer")
    for _, old in _numbered(spark, path)[KEPT + 1 :]:
        fs.delete(old, False)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text committed last, None where there is none; a file that isn't whole counts as not there."""
    return next((x for _, p in _numbered(spark, path) if (x := _read_whole(spark, p)) is not None), None)
