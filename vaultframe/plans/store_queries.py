"""Queries that go through the store, the codecs and the streaming sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from vaultframe.functions import codecs, machine
from vaultframe.session import scratch_path, spread, stream_table, table
from vaultframe.sources.vault import Selection, Vault
from vaultframe.streaming.journal import dedupe_against, deduped

QUERIES, SQL = {}, {}
#: Methods that every document passes: zstd, LZ77 packed and in bytes, Burrows-Wheeler, and LZ77 after call targets.
CODECS = ("zstd", "x0,1,4,0,1,15", "x0,2,12,0,7,21,1", "x0,3", "x0,5,4,0,3,20")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _files(spark, sf_dir, lang=None):
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    content = F.col("text").cast("binary")
    path = F.concat(F.coalesce(F.trim(F.lower("lang")), F.lit("none")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select(path.alias("dt_path"), (F.lit(20200101000000) + F.col("doc_id") % 60).alias("dt_date"), F.octet_length(content).cast("bigint").alias("dt_size"), F.lit(ord("u") + (0o100644 << 8)).cast("bigint").alias("dt_attr"), content.alias("content"))


def _vault(spark, sf_dir):
    vault = Vault(spark, scratch_path(spark, "vault"), fragment=0, block_size=1 << 22)
    files = _files(spark, sf_dir)
    vault.add(files, 20210101000000)
    vault.add(files.filter(~F.col("dt_path").startswith("de/")), 20210201000000)
    return vault


_PATH = "coalesce(trim(lower(lang)), 'none') || '/' || CAST(doc_id AS VARCHAR) || '.txt'"


@query(f"SELECT {_PATH} AS dt_path, octet_length(encode(text)) AS dt_size, sha1(text) AS sha1 FROM documents WHERE text IS NOT NULL")
def vault_asof_roundtrip(spark, sf_dir):
    return _vault(spark, sf_dir).extract(until=1).select("dt_path", "dt_size", F.sha1("content").alias("sha1"))


@query(f"SELECT {_PATH} AS dt_path, sha1(text) AS sha1 FROM documents WHERE text IS NOT NULL AND (starts_with({_PATH}, 'fr/') OR starts_with({_PATH}, 'en/')) AND NOT regexp_full_match({_PATH}, '.*1\\.txt')")
def vault_selected(spark, sf_dir):
    return _vault(spark, sf_dir).extract(select=Selection(files=["fr", "en"], exclude=["*1.txt"])).select("dt_path", F.sha1("content").alias("sha1"))


@query(f"SELECT CASE WHEN starts_with({_PATH}, 'de/') THEN '-' ELSE '=' END AS mark, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def vault_list_marks(spark, sf_dir):
    vault = _vault(spark, sf_dir)
    outside = _files(spark, sf_dir).filter(~F.col("dt_path").startswith("de/"))
    return vault.list(outside, until=1).groupBy("mark").agg(F.count("*").alias("n"))


def _fixed_vault(spark, sf_dir):
    """One version in pieces of 1 KiB, which SQL can cut too."""
    vault = Vault(spark, scratch_path(spark, "vault"), fixed=1024, block_size=1 << 22)
    vault.add(_files(spark, sf_dir), 20210101000000)
    return vault


_CUT = f"""WITH files AS (SELECT {_PATH} AS path, octet_length(encode(text)) AS size, hex(encode(text)) AS t FROM documents WHERE text IS NOT NULL),
cut AS (SELECT path, size, t, unnest(range(greatest(CAST(ceil(size / 1024.0) AS BIGINT), 1))) AS pos FROM files),
pieces AS (SELECT *, sha1(unhex(t[pos * 2048 + 1 : (pos + 1) * 2048])) AS s, least(size - pos * 1024, 1024) AS n, row_number() OVER (ORDER BY -(size >> 14), path, pos) AS r FROM cut),
frags AS (SELECT s, min(r) AS r, max(n) AS n FROM pieces GROUP BY 1)"""


@query(f"""{_CUT}, placed AS (SELECT coalesce(sum(n + 4) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 4194304 + 1 AS block_id FROM frags)
SELECT CAST(block_id AS BIGINT) AS block_id, count(*) AS frags, count(*) AS frags_ok, CAST(NULL AS VARCHAR) AS problem FROM placed GROUP BY 1""")
def vault_verify(spark, sf_dir):
    return _fixed_vault(spark, sf_dir).verify()


@query(f"""{_CUT} SELECT (SELECT count(*) FROM files) AS n_files, (SELECT count(*) FROM pieces) AS refs, (SELECT count(*) FROM frags) AS n_frags,
(SELECT CAST(sum(n) AS BIGINT) FROM pieces) AS all_size, (SELECT CAST(sum(n) AS BIGINT) FROM frags) AS dedupe_size, CAST(0 AS BIGINT) AS unknown""")
def vault_stats(spark, sf_dir):
    return _fixed_vault(spark, sf_dir).stats().drop("packed_bytes")


@query(f"SELECT {_PATH} AS dt_path FROM documents WHERE text IS NOT NULL AND text <> '' AND doc_id % 3 = 0")
def vault_changed_content(spark, sf_dir):
    """Every third file has other content of the same size, date and attributes: only the stored hashes tell."""
    vault, files = _fixed_vault(spark, sf_dir), _files(spark, sf_dir)
    third = F.regexp_extract("dt_path", r"(\d+)\.txt$", 1).cast("bigint") % 3 == 0
    other = files.withColumn("content", F.when(third, F.concat(F.lit(b"\x01"), F.expr("substring(content, 2)"))).otherwise(F.col("content"))).filter("dt_size > 0")
    return vault.list(other, force=True).filter("mark = '#'").select("dt_path")


@query("SELECT doc_id, sha1(text) AS sha1 FROM documents WHERE text IS NOT NULL")
def codec_roundtrip(spark, sf_dir):
    """Every document through one codec after the other, each packing what the one before unpacked; an error of any shows in the checksum."""
    rows = spread(table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.col("text").cast("binary").alias("data")))
    for method in CODECS:
        rows = codecs.unpack_column(codecs.pack_column(rows, "data", method), "data").select("doc_id", "data")
    return rows.select("doc_id", F.sha1("data").alias("sha1"))


@query("SELECT frag_id, CAST(octet_length(ht_sha1) AS BIGINT) * 2 AS n, lower(hex(ht_sha1)) AS doubled FROM fragments WHERE ht_sha1 IS NOT NULL".replace("lower(hex(ht_sha1)) AS doubled", "lower(regexp_replace(hex(ht_sha1), '(..)', '\\1\\1', 'g')) AS doubled"))
def program_over_keys(spark, sf_dir):
    """A small user program, which puts out every byte twice."""
    rows = spread(table(spark, sf_dir, "fragments").filter("ht_sha1 is not null").select("frag_id", "ht_sha1"))
    out = machine.run_program(rows, "ht_sha1", "a> 255 ifnot out out endif")
    return out.select("frag_id", F.octet_length("ht_sha1").cast("bigint").alias("n"), F.lower(F.hex("ht_sha1")).alias("doubled"))


@query("SELECT DISTINCT ht_sha1 FROM segments WHERE ht_sha1 IS NOT NULL")
def stream_dedupe(spark, sf_dir):
    stream = stream_table(spark, sf_dir, "segments").select("seg_id", "ht_sha1")
    target = scratch_path(spark, "stream-dedupe")
    dedupe_against(stream, "ht_sha1", target, target + "-checkpoint").awaitTermination()
    return deduped(spark, target).select("ht_sha1")
