"""Queries on content: pieces, hashes, dedupe, blocks and methods, over the documents as files."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vaultframe.operators import chunk, numbering, packing
from vaultframe.session import spread, table

QUERIES, SQL = {}, {}
_PIECES = """pieces AS (SELECT doc_id, i AS pos, i * 1024 AS off, t[i * 1024 + 1 : (i + 1) * 1024] AS p FROM (
  SELECT doc_id, hex(encode(text)) AS t, unnest(range(greatest(CAST(ceil(octet_length(encode(text)) / 1024.0) AS BIGINT), 1))) AS i FROM documents WHERE text IS NOT NULL))"""
_PIECES = _PIECES.replace("t[i * 1024 + 1 : (i + 1) * 1024]", "unhex(t[i * 2048 + 1 : (i + 1) * 2048])")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter("text is not null")


def _fixed(spark, sf_dir):
    return chunk.chunk_fixed(_docs(spark, sf_dir), "doc_id", "text", 1024)


@query(f"WITH {_PIECES} SELECT doc_id, CAST(pos AS INTEGER) AS pos, CAST(off AS BIGINT) AS off, CAST(octet_length(p) AS BIGINT) AS len, sha1(p) AS sha1 FROM pieces")
def chunk_fixed_1k(spark, sf_dir):
    return _fixed(spark, sf_dir)


@query(f"WITH {_PIECES}, d AS (SELECT sha1(p) AS s, max(octet_length(p)) AS n, count(*) AS c FROM pieces GROUP BY 1) SELECT CAST(sum(c) AS BIGINT) AS refs, count(*) AS frags, CAST(sum(n * c) AS BIGINT) AS all_bytes, CAST(sum(n) AS BIGINT) AS dedupe_bytes FROM d")
def piece_dedupe_stats(spark, sf_dir):
    per = _fixed(spark, sf_dir).groupBy("sha1").agg(F.max("len").alias("n"), F.count("*").alias("c"))
    return per.agg(F.sum("c").alias("refs"), F.count("*").alias("frags"), F.sum(F.col("n") * F.col("c")).alias("all_bytes"), F.sum("n").alias("dedupe_bytes"))


@query("""WITH l AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL), d AS (SELECT sha1(line) AS s, max(octet_length(encode(line))) AS n, count(*) AS c FROM l GROUP BY 1)
SELECT CAST(sum(c) AS BIGINT) AS refs, count(*) AS frags, CAST(sum(n * c) AS BIGINT) AS all_bytes, CAST(sum(n) AS BIGINT) AS dedupe_bytes FROM d""")
def line_dedupe_stats(spark, sf_dir):
    lines = _docs(spark, sf_dir).select(F.explode(F.split("text", "\n")).alias("line"))
    per = lines.groupBy(F.sha1("line").alias("s")).agg(F.max(F.octet_length("line")).cast("bigint").alias("n"), F.count("*").alias("c"))
    return per.agg(F.sum("c").alias("refs"), F.count("*").alias("frags"), F.sum(F.col("n") * F.col("c")).alias("all_bytes"), F.sum("n").alias("dedupe_bytes"))


_IDS = f"""WITH {_PIECES}, f AS (SELECT sha1(p) AS sha1, min(doc_id * 1000000 + pos) AS o, CAST(max(octet_length(p)) AS BIGINT) AS len FROM pieces GROUP BY 1),
ids AS (SELECT sha1, len, row_number() OVER (ORDER BY o, sha1) AS frag_id FROM f)"""


def _ids(spark, sf_dir):
    chunks = _fixed(spark, sf_dir).select("doc_id", "pos", F.unhex("sha1").alias("ht_sha1"), F.col("len").alias("ht_usize"))
    none = chunks.select("ht_sha1", "ht_usize").limit(0)
    return chunks, packing.assign_ids(packing.new_fragments(chunks, none, ["doc_id", "pos"]), ["doc_id", "pos"])


@query(f"{_IDS} SELECT frag_id, sha1, len FROM ids")
def frag_ids_dense(spark, sf_dir):
    return _ids(spark, sf_dir)[1].select("frag_id", F.lower(F.hex("ht_sha1")).alias("sha1"), F.col("ht_usize").alias("len"))


@query(f"{_IDS} SELECT doc_id, string_agg(CAST(frag_id AS VARCHAR), ' ' ORDER BY pos) AS ptr FROM pieces JOIN ids ON sha1(p) = ids.sha1 GROUP BY doc_id")
def doc_ptr_arrays(spark, sf_dir):
    chunks, ids = _ids(spark, sf_dir)
    rows = chunks.join(ids.select("ht_sha1", "frag_id"), "ht_sha1").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "frag_id"))).alias("s"))
    return rows.select("doc_id", F.array_join(F.transform("s", lambda x: x["frag_id"].cast("string")), " ").alias("ptr"))


@query(f"""{_IDS}, placed AS (SELECT *, coalesce(sum(len + 4) OVER (ORDER BY frag_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM ids), b AS (SELECT *, a // 65536 AS block_no FROM placed)
SELECT frag_id, CAST(block_no AS BIGINT) AS block_no, CAST(coalesce(sum(len) OVER (PARTITION BY block_no ORDER BY frag_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS block_offset FROM b""")
def greedy_blocks(spark, sf_dir):
    return packing.pack_blocks(_ids(spark, sf_dir)[1], 65_536).select("frag_id", "block_no", "block_offset")


@query("""SELECT DISTINCT ht_sha1 FROM (SELECT ht_sha1, ht_usize FROM fragments WHERE frag_id IN (SELECT unnest(dt_ptr) FROM batch_files WHERE batch_no >= 1)) n
WHERE ht_sha1 IS NOT NULL AND ht_sha1 NOT IN (SELECT ht_sha1 FROM fragments WHERE ht_usize >= 0 AND ht_sha1 IS NOT NULL AND hex(ht_sha1) <> repeat('0', 40) AND frag_id IN (SELECT unnest(dt_ptr) FROM batch_files WHERE batch_no < 1))""")
def new_fragments_vs_base(spark, sf_dir):
    files, frags = table(spark, sf_dir, "batch_files"), table(spark, sf_dir, "fragments")
    of = lambda test: frags.join(files.filter(test).select(F.explode("dt_ptr").alias("frag_id")).distinct(), "frag_id", "left_semi")
    return packing.new_fragments(of("batch_no >= 1").filter("ht_sha1 is not null"), of("batch_no < 1"), ["frag_id"]).select("ht_sha1")


@query("SELECT doc_id, sha1(text) AS sha1, sha256(text) AS sha256, octet_length(encode(text)) AS bytes FROM documents WHERE text IS NOT NULL")
def checksums(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("bytes"))


@query("SELECT sha1(text) AS sha1, count(*) AS copies, min(doc_id) AS class_id FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def exact_dup_groups(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy(F.sha1("text").alias("sha1")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("class_id")).filter("copies > 1")


@query("SELECT c AS byte, count(*) AS n FROM (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS c FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def byte_histogram(spark, sf_dir):
    pairs = F.expr("regexp_extract_all(hex(cast(text as binary)), '..', 0)")
    return spread(_docs(spark, sf_dir).select("text")).select(F.explode(pairs).alias("byte")).groupBy("byte").agg(F.count("*").alias("n"))


@query("SELECT CAST(seg_id - prev AS BIGINT) AS gap, count(*) AS n FROM (SELECT seg_id, lag(seg_id) OVER (PARTITION BY origin, ht_usize ORDER BY seg_id) AS prev FROM segments) WHERE prev IS NOT NULL GROUP BY 1")
def gap_histogram(spark, sf_dir):
    rows = table(spark, sf_dir, "segments").withColumn("o", F.struct("origin", "ht_usize"))
    return packing.gap_histogram(rows, [], "o", "seg_id")


@query("SELECT doc_id, sha1(text) AS sha1 FROM documents WHERE text IS NOT NULL")
def cdc_roundtrip(spark, sf_dir):
    docs = spread(_docs(spark, sf_dir).select("doc_id", "text"))
    pieces = chunk.chunk_content(docs, "doc_id", "text", 0).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "off", "len"))).alias("s"))
    whole = F.aggregate("s", F.unhex(F.lit("")), lambda a, x: F.concat(a, F.substring(F.col("text").cast("binary"), x["off"].cast("int") + 1, x["len"].cast("int"))))
    return docs.join(pieces, "doc_id").select("doc_id", F.sha1(whole).alias("sha1"))


@query()
def cdc_fragments(spark, sf_dir):
    return chunk.chunk_content(spread(_docs(spark, sf_dir).select("doc_id", "text")), "doc_id", "text", 0)


@query()
def block_methods(spark, sf_dir):
    pieces = chunk.chunk_content(spread(_docs(spark, sf_dir).select("doc_id", "text")), "doc_id", "text", 0, tables=True).withColumn("block_no", F.floor(F.col("doc_id") / 256))
    hints = packing.block_hints(packing.shared_redundancy(pieces, ["doc_id", "pos"], chunk.size_limits(0)[0]))
    klass = packing.size_class(F.col("bytes"))
    return hints.select("*", *(packing.choose_method(k, F.col("redundancy"), F.col("kind"), klass).alias(f"method_{k}") for k in range(6)))


def _method_sql() -> str:
    case = """CASE level WHEN 0 THEN '0' || b || ',0'
WHEN 1 THEN 'x' || b || CASE WHEN t < 40 THEN ',0' ELSE ',' || (1 + e) || ',' || CASE WHEN t < 80 THEN '4,0,1,15' WHEN t < 128 THEN '4,0,2,16' WHEN t < 256 THEN '4,0,2,' || h WHEN t < 960 THEN '5,0,3,' || h ELSE '6,0,3,' || h END END
WHEN 2 THEN 'x' || b || CASE WHEN t < 32 THEN ',0' WHEN t < 64 THEN ',' || (1 + e) || ',4,0,3,' || h ELSE ',' || (1 + e) || ',4,0,7,' || s || ',1' END
WHEN 3 THEN 'x' || b || CASE WHEN t < 20 THEN ',0' WHEN t < 48 THEN ',' || (1 + e) || ',4,0,3,' || h WHEN t >= 640 OR t % 2 = 1 THEN ',' || (3 + e) || 'ci1' ELSE ',' || (2 + e) || ',12,0,7,' || s || ',1c0,0,511i2' END
WHEN 4 THEN 'x' || b || CASE WHEN t < 12 THEN ',0' WHEN t < 24 THEN ',' || (1 + e) || ',4,0,3,' || h WHEN t < 48 THEN ',' || (2 + e) || ',5,0,7,' || s || '1c0,0,511' WHEN t < 900 THEN ',' || e || 'ci1,1,1,1,2a' || CASE WHEN t % 2 = 1 THEN 'w' ELSE '' END || 'm' ELSE ',' || (3 + e) || 'ci1' END
ELSE 'x' || b || ',' || e || CASE WHEN t % 2 = 1 THEN 'w2c0,1010,255i1' ELSE 'w1i1' END || 'c256ci1,1,1,1,1,1,2a' || 'c0,2,0,255i1c0,3,0,0,255i1c0,4,0,0,0,255i1mm16ts19t0' END"""
    return f"""SELECT level, redundancy, kind, klass, {case} AS method FROM (SELECT level, r AS redundancy, k AS kind, b AS klass, r * 4 + k AS t, (k & 2) * 2 AS e, 19 + b + (b <= 6)::INT AS h, 21 + b AS s, b
FROM range(6) a(level), range(256) c(r), range(4) d(k), range(0, 12, 5) g(b))"""


@query(_method_sql())
def method_choice(spark, sf_dir):
    grid = spark.range(256 * 12).select((F.col("id") % 256).alias("redundancy"), F.floor(F.col("id") / 256).alias("j")).select("redundancy", (F.col("j") % 4).alias("kind"), (F.floor(F.col("j") / 4) * 5).alias("klass"))
    out = None
    for level in range(6):
        rows = grid.select(F.lit(level).cast("bigint").alias("level"), "redundancy", "kind", "klass", packing.choose_method(level, F.col("redundancy"), F.col("kind"), F.col("klass")).alias("method"))
        out = rows if out is None else out.unionByName(rows)
    return out
