import os
import random

import pytest
from pyspark.sql import functions as F

from vaultframe.functions.codecs import header, pack_bytes, scan_packed
from vaultframe.plans.store_queries import stream_dedupe
from vaultframe.session import scratch_path
from vaultframe.sources import files
from vaultframe.sources.vault import Vault
from vaultframe.streaming.journal import arrivals, dedupe_against, dedupe_within, deduped, journal_stream


@pytest.fixture
def tree(tmp_path):
    for p, c in {"a/x.txt": b"hello", "a/zero": b"", "b/y.bin": bytes(100_000) + b"end", "skip/no": b"1"}.items():
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_bytes(c)
    os.chmod(tmp_path / "a/x.txt", 0o640)
    os.symlink(tmp_path / "a/x.txt", tmp_path / "link")
    return tmp_path


def test_tree_to_vault_and_back(spark, tree, tmp_path_factory):
    listing = files.scan_local(spark, [f"{tree}/a", f"{tree}/b", f"{tree}/skip", f"{tree}/none"], ["*/skip"])
    names = {r["dt_path"]: r for r in listing.collect()}
    assert set(names) == {f"{tree}/{p}" for p in ("a/", "a/x.txt", "a/zero", "b/", "b/y.bin")}
    assert names[f"{tree}/a/x.txt"]["dt_attr"] == ord("u") + (0o100640 << 8)
    vault = Vault(spark, scratch_path(spark, "vault"))
    vault.add(files.with_content(listing))
    out = tmp_path_factory.mktemp("out")
    assert files.write_files(vault.extract(), str(out), dry_run=True).filter("problem is not null").count() == 0 and not list(out.iterdir())
    os.chmod(tree / "a", 0o750)
    problems = files.write_files(vault.extract(), str(out))
    assert problems.filter("problem is not null").count() == 0
    for p in ("a/x.txt", "a/zero", "b/y.bin"):
        assert (out / str(tree).lstrip("/") / p).read_bytes() == (tree / p).read_bytes()
    assert os.stat(out / str(tree).lstrip("/") / "a/x.txt").st_mode & 0o777 == 0o640
    bad = spark.createDataFrame([("../out", 1, 1, bytearray(b"x"))], "dt_path string, dt_date bigint, dt_attr bigint, content binary")
    assert files.write_files(bad, str(out)).first()["problem"]


def test_whole_trees_are_written_back(spark, tmp_path_factory):
    """Folders, empty ones too, come back with their dates and modes, which what is written into them doesn't change; one that nobody may write to is filled first."""
    src, out = tmp_path_factory.mktemp("src"), tmp_path_factory.mktemp("out")
    for d in ("d/e/f", "d/empty", "locked/in"):
        (src / d).mkdir(parents=True)
    for k, p in enumerate(("d/x", "d/e/y", "d/e/f/z", "locked/in/w", "top")):
        (src / p).write_bytes(bytes([k]) * (k * 1000))
    marks = {"d/": 0o750, "d/e/": 0o711, "d/e/f/": 0o700, "d/empty/": 0o755, "locked/in/": 0o555, "locked/": 0o555, "top": 0o600}
    for k, (p, mode) in enumerate(marks.items()):
        os.utime(src / p, (10**9 + k, 10**9 + k))
        os.chmod(src / p, mode)
    vault = Vault(spark, scratch_path(spark, "vault"), fragment=0)
    vault.add(files.with_content(files.scan_local(spark, [str(src)])))
    problems = files.write_files(vault.extract(), str(out))
    assert problems.count() == 12 and problems.filter("problem is not null").count() == 0
    made = out / str(src).lstrip("/")
    names = lambda top: sorted(str(p.relative_to(top)) + "/" * p.is_dir() for p in top.rglob("*"))
    assert names(made) == names(src)
    for p in names(src):
        a, b = (src / p).stat(), (made / p).stat()
        assert (a.st_mode, int(a.st_mtime)) == (b.st_mode, int(b.st_mtime)), p
        assert p.endswith("/") or (src / p).read_bytes() == (made / p).read_bytes()


def test_read_tree(spark, tree):
    got = {r["dt_path"].rsplit("/", 1)[1]: bytes(r["content"]) for r in files.read_tree(spark, f"file://{tree}/a").collect()}
    assert got == {"x.txt": b"hello"}


def test_parts(spark, tmp_path):
    assert [files.part_name(x, 12) for x in ("p*", "p???", "p?", "p")] == ["p12", "p012", "p2", "p"]
    for k in (1, 2, 4):
        spark.range(k).write.parquet(str(tmp_path / f"part00{k}"))
    got = files.read_parts(spark, str(tmp_path / "part???"))
    assert sorted(tuple(r) for r in got.collect()) == [(0, 1), (0, 2), (1, 2)]
    with pytest.raises(FileNotFoundError):
        files.read_parts(spark, str(tmp_path / "none*"))


def test_scan_of_a_damaged_stream(spark):
    packed = [pack_bytes(bytes([k]) * 100 * k, "zstd") for k in range(1, 4)]
    stream = b"junk" + packed[0] + b"\x8eVF1\x1a\xff" + packed[1] + packed[2][:20]
    frame = spark.createDataFrame([(7, bytearray(stream)), (8, None), (9, bytearray(b""))], "k int, data binary")
    got = scan_packed(frame, "k", "data").collect()
    assert [(r["k"], r["offset"], r["usize"]) for r in got] == [(7, 4, 100), (7, 4 + len(packed[0]) + 6, 200)]
    assert bytes(got[0]["sha1"]) == header(packed[0])["sha1"]


@pytest.fixture
def source(spark, tmp_path):
    """A stream of two files of rows, one file a batch."""
    rnd = random.Random(1)
    path = str(tmp_path / "in")
    rows = [[(f"k{rnd.randrange(60)}", k, b * 1000 + k) for k in range(100)] for b in range(2)]
    for part in rows:
        spark.createDataFrame(part, "key string, n int, s int").withColumn("ts", F.timestamp_seconds("s")).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("key string, n int, s int, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    return stream, [r for part in rows for r in part]


def test_dedupe_against_table(spark, source):
    stream, rows = source
    table = scratch_path(spark, "seen")
    for _ in range(2):
        dedupe_against(stream, "key", table, table + "-checkpoint").awaitTermination()
    got = [r["key"] for r in deduped(spark, table).collect()]
    assert sorted(got) == sorted({r[0] for r in rows})


@pytest.mark.parametrize("form", ["file", "folder", "partitions"])
def test_dedupe_of_a_table_in_any_form(spark, tmp_path, form):
    """The table may be one file, a folder of files or of partitions; other tables, in any form, lie beside it."""
    keys = [None if k % 13 == 0 else f"k{k % 70}" if k % 10 else "k1" for k in range(500)]
    segments = spark.createDataFrame([(k, key, k % 3) for k, key in enumerate(keys)], "seg_id bigint, ht_sha1 string, origin int")
    path = tmp_path / "segments.parquet"
    writer = segments.repartition(1 if form == "file" else 6).write
    (writer.partitionBy("origin") if form == "partitions" else writer).parquet(str(tmp_path / "written" if form == "file" else path))
    if form == "file":
        next((tmp_path / "written").glob("part-*")).rename(path)
    other = spark.createDataFrame([(1, "other", 1)], "seg_id bigint, ht_sha1 string, origin int")
    other.write.partitionBy("origin").parquet(str(tmp_path / "entries.parquet"))
    other.write.parquet(str(tmp_path / "blocks.parquet"))
    got = stream_dedupe(spark, str(tmp_path))
    assert got.columns == ["ht_sha1"] and sorted(r[0] for r in got.collect()) == sorted({k for k in keys if k is not None})


def test_windows_and_bounded_state(spark, source):
    stream, rows = source
    for name, df, mode in (("w", arrivals(stream.withColumn("ht_usize", F.col("n")), "ts", "1 minute", "1 hour"), "complete"), ("d", dedupe_within(stream, ["key"], "ts", "2 hours"), "append")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    assert spark.sql("select sum(n) from w").first()[0] == len(rows)
    assert spark.sql("select count(*) from d").first()[0] == len({r[0] for r in rows})


def test_journal_stream(spark, source):
    stream, rows = source
    vault = Vault(spark, scratch_path(spark, "vault"))
    content = F.encode(F.col("n").cast("string"), "UTF-8")
    files_ = stream.select(F.col("key").alias("dt_path"), (F.lit(20200101000000) + F.col("s")).alias("dt_date"), F.octet_length(content).cast("bigint").alias("dt_size"), F.lit(0).cast("bigint").alias("dt_attr"), content.alias("content"))
    journal_stream(files_, vault, vault.path + "-checkpoint", lambda n: 20210101000000 + n).awaitTermination()
    last = {}
    for key, n, s in rows:
        if s >= last.get(key, (0, -1))[1]:
            last[key] = (n, s)
    got = {r["dt_path"]: bytes(r["content"]).decode() for r in vault.extract().collect()}
    assert len(vault.versions()) == 2 and set(got) == set(last)
    assert got == {k: str(n) for k, (n, _) in last.items()}
