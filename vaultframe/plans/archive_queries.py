"""Queries on the archive tables: versions, snapshots, comparisons, rollups, statistics."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from vaultframe.functions import dates, paths
from vaultframe.operators import compare, journal, rollup
from vaultframe.operators.numbering import number_rows
from vaultframe.operators.quality import archive_problems as problems
from vaultframe.session import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _tables(spark, sf_dir, *names):
    return [table(spark, sf_dir, n) for n in names]


#: DuckDB: valid rows of records, and the versions of each archive up to the first uncommitted one or the first that ``beyond`` holds for.
def _cut(beyond: str = "false") -> str:
    return f"""vv AS (SELECT *, row_number() OVER (PARTITION BY archive_id ORDER BY version_no) AS place FROM versions),
good AS (SELECT archive_id, coalesce(min(place) FILTER (WHERE ver_csize < 0) - 1, max(place)) AS held FROM vv GROUP BY archive_id),
cut AS (SELECT vv.* FROM vv JOIN (SELECT vv.archive_id, coalesce(min(place) FILTER (WHERE ver_csize < 0 OR {beyond}), 1000000000) AS c FROM vv JOIN good USING (archive_id) GROUP BY vv.archive_id) x ON vv.archive_id = x.archive_id AND vv.place < x.c),
recs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY version_id, seq_no ORDER BY loaded_at DESC, entry_id DESC) AS rn FROM entries WHERE dt_path IS NOT NULL) WHERE rn = 1)"""


def _snap(beyond: str = "false", live: bool = True, name: str = "snap") -> str:
    return f"""{_cut(beyond)},
{name} AS (SELECT * FROM (SELECT r.*, c.version_no, row_number() OVER (PARTITION BY r.archive_id, r.dt_path ORDER BY c.version_no DESC, r.seq_no DESC) AS k
  FROM recs r JOIN cut c USING (version_id)) WHERE k = 1{" AND (dt_date IS NULL OR dt_date <> 0)" if live else ""})"""


def _both(a: str, b: str) -> str:
    """Two snapshots under the names a and b."""
    return f"{_snap(a, name='a')}, {_snap(b, name='b').replace('vv AS', 'vv2 AS').replace('FROM vv ', 'FROM vv2 ').replace('good', 'good2').replace('cut', 'cut2').replace('recs', 'recs2').replace('vv.', 'vv2.').replace('JOIN vv', 'JOIN vv2')}"


_COLS = ["archive_id", "dt_path", "dt_date", "dt_size", "dt_attr"]
_VALID = "archive_id, dt_path, dt_date, dt_size, dt_attr"


def _snapshot(spark, sf_dir, until=None, **kw):
    return journal.snapshot(*_tables(spark, sf_dir, "entries", "versions"), until, **kw)


@query(f"WITH {_snap()} SELECT {_VALID} FROM snap")
def snapshot_latest(spark, sf_dir):
    return _snapshot(spark, sf_dir).select(*_COLS)


@query(f"WITH {_snap('place > 3')} SELECT {_VALID} FROM snap")
def snapshot_asof_version(spark, sf_dir):
    return _snapshot(spark, sf_dir, dates.parse_until("3")).select(*_COLS)


@query(f"WITH {_snap('ver_date > 20220630235959')} SELECT {_VALID} FROM snap")
def snapshot_asof_date(spark, sf_dir):
    return _snapshot(spark, sf_dir, dates.parse_until("2022-06-30")).select(*_COLS)


@query(f"WITH {_snap('place > held - 2')} SELECT {_VALID} FROM snap")
def snapshot_negative_until(spark, sf_dir):
    return _snapshot(spark, sf_dir, -2).select(*_COLS)


@query(f"WITH {_snap(live=False)} SELECT archive_id, dt_path, version_no FROM snap WHERE dt_date = 0")
def deleted_paths(spark, sf_dir):
    return _snapshot(spark, sf_dir, keep_deleted=True).filter("dt_date = 0").select("archive_id", "dt_path", "version_no")


@query(f"""WITH {_cut()},
f AS (SELECT * FROM (SELECT r.*, c.version_no, row_number() OVER (PARTITION BY r.archive_id, c.version_no, r.dt_path ORDER BY r.seq_no DESC) AS k FROM recs r JOIN cut c USING (version_id)) WHERE k = 1)
SELECT archive_id, lpad(CAST(version_no AS VARCHAR), CAST(greatest(4, length(CAST(version_no AS VARCHAR))) AS INTEGER), '0') || '/' || dt_path AS dt_path, dt_date, dt_size, dt_attr FROM f
UNION ALL SELECT archive_id, lpad(CAST(version_no AS VARCHAR), CAST(greatest(4, length(CAST(version_no AS VARCHAR))) AS INTEGER), '0') || '/', ver_date, NULL, NULL FROM cut""")
def all_versions_listing(spark, sf_dir):
    return journal.all_versions(*_tables(spark, sf_dir, "entries", "versions"))


@query(f"""WITH {_cut()},
n AS (SELECT version_id, count(*) FILTER (WHERE dt_date IS NULL OR dt_date <> 0) AS u, count(*) FILTER (WHERE dt_date = 0) AS d FROM recs GROUP BY version_id)
SELECT archive_id, version_id, version_no, ver_date, lead(ver_offset) OVER w - ver_offset AS csize, ver_first_fragment AS first_fragment, lead(ver_first_fragment) OVER w - 1 AS last_fragment,
  coalesce(u, 0) AS updates, coalesce(d, 0) AS deletes FROM cut LEFT JOIN n USING (version_id) WINDOW w AS (PARTITION BY archive_id ORDER BY version_no)""")
def version_stats(spark, sf_dir):
    return journal.version_stats(*_tables(spark, sf_dir, "entries", "versions"))


@query(f"""WITH {_cut()},
n AS (SELECT archive_id, count(*) AS updates, count(DISTINCT dt_path) AS paths FROM recs JOIN cut USING (version_id, archive_id) GROUP BY 1)
SELECT c.archive_id, count(*) AS versions, CAST(max(ver_date) AS BIGINT) AS last_date, CAST(sum(ver_csize) AS BIGINT) AS csize, coalesce(any_value(updates), 0) AS updates, coalesce(any_value(paths), 0) AS paths
FROM cut c LEFT JOIN n ON n.archive_id = c.archive_id GROUP BY c.archive_id""")
def archive_summary(spark, sf_dir):
    entries, versions = _tables(spark, sf_dir, "entries", "versions")
    cut = journal.as_of(versions)
    seen = journal.last_loaded(entries).join(cut.select("version_id"), "version_id").groupBy("archive_id").agg(F.count("*").alias("updates"), F.countDistinct("dt_path").alias("paths"))
    own = cut.groupBy("archive_id").agg(F.count("*").alias("versions"), F.max("ver_date").alias("last_date"), F.sum("ver_csize").alias("csize"))
    return own.join(seen, "archive_id", "left").fillna(0, ["updates", "paths"])


@query("""WITH RECURSIVE o AS (SELECT archive_id, version_no, ver_date, epoch(strptime(CAST(ver_date AS VARCHAR), '%Y%m%d%H%M%S')) AS s, row_number() OVER (PARTITION BY archive_id ORDER BY version_no) AS i FROM versions),
r AS (SELECT *, s AS t FROM o WHERE i = 1 UNION ALL SELECT o.*, greatest(o.s, r.t + 1) FROM r JOIN o ON o.archive_id = r.archive_id AND o.i = r.i + 1)
SELECT archive_id, version_no, ver_date, CAST(strftime(to_timestamp(t)::TIMESTAMP, '%Y%m%d%H%M%S') AS BIGINT) AS commit_date FROM r""")
def commit_dates(spark, sf_dir):
    return journal.commit_dates(table(spark, sf_dir, "versions"))


def _marked(a: str, b: str) -> str:
    return f"""WITH {_both(a, b)},
j AS (SELECT coalesce(a.archive_id, b.archive_id) AS archive_id, coalesce(a.dt_path, b.dt_path) AS dt_path, a.dt_date AS ad, a.dt_size AS az, a.dt_attr AS aa, b.dt_date AS bd, b.dt_size AS bz, b.dt_attr AS ba,
  CASE WHEN a.entry_id IS NULL THEN '+' WHEN b.entry_id IS NULL THEN '-' WHEN a.dt_date IS NOT DISTINCT FROM b.dt_date AND a.dt_size IS NOT DISTINCT FROM b.dt_size
    AND (coalesce(a.dt_attr, 0) = 0 OR coalesce(b.dt_attr, 0) = 0 OR a.dt_attr = b.dt_attr) THEN '=' ELSE '#' END AS m
  FROM a FULL JOIN b ON a.archive_id = b.archive_id AND a.dt_path = b.dt_path),
marked AS (SELECT archive_id, dt_path, m AS mark, CASE WHEN m = '+' THEN bd ELSE ad END AS dt_date, CASE WHEN m = '+' THEN bz ELSE az END AS dt_size, CASE WHEN m = '+' THEN ba ELSE aa END AS dt_attr FROM j
  UNION ALL SELECT archive_id, dt_path, '+', bd, bz, ba FROM j WHERE m = '#')"""


_MARKED = _marked("place > 2", "place > 4")


def _two(spark, sf_dir):
    return _snapshot(spark, sf_dir, 2), _snapshot(spark, sf_dir, 4)


def _late(spark, sf_dir):
    """Eight versions before the end and the latest, so that the whole journal goes in."""
    return _snapshot(spark, sf_dir, -8), _snapshot(spark, sf_dir)


@query(f"{_MARKED} SELECT * FROM marked")
def diff_marks(spark, sf_dir, sides=_two):
    return compare.compare(*sides(spark, sf_dir))


@query(f"{_MARKED} SELECT archive_id, count(*) FILTER (WHERE mark = '=') AS same, count(*) FILTER (WHERE mark = '#') AS different, count(*) FILTER (WHERE mark = '+') AS external, count(*) FILTER (WHERE mark = '-') AS internal FROM marked GROUP BY archive_id")
def diff_counts(spark, sf_dir, sides=_two):
    return compare.mark_counts(compare.compare(*sides(spark, sf_dir)), "archive_id")


@query(f"{_MARKED} SELECT * FROM marked WHERE mark NOT IN ('=', '#')")
def diff_hide_marks(spark, sf_dir, sides=_two):
    return compare.compare(*sides(spark, sf_dir), hide="#")


@query(f"{_MARKED} SELECT archive_id, dt_path FROM marked WHERE mark = '-'")
def deletes_between(spark, sf_dir, sides=_two):
    return compare.needs_delete(*sides(spark, sf_dir)).select("archive_id", "dt_path")


@query(f"{_MARKED} SELECT archive_id, dt_path FROM marked WHERE mark = '='")
def common_unchanged(spark, sf_dir, sides=_two):
    both = compare.matched(*sides(spark, sf_dir))
    return both.filter(F.col("has_a") & F.col("has_b") & compare.same_by_metadata()).select("archive_id", "dt_path")


@query(f"{_MARKED} SELECT archive_id, dt_path, bd AS dt_date, bz AS dt_size, ba AS dt_attr FROM j WHERE m <> '-' AND NOT ends_with(dt_path, '/') AND (m = '+' OR ad IS DISTINCT FROM bd OR az IS DISTINCT FROM bz)")
def add_reads(spark, sf_dir, sides=_two):
    return compare.needs_reading(*sides(spark, sf_dir))


@query(f"{_MARKED} SELECT archive_id, dt_path, bd AS dt_date, bz AS dt_size, ba AS dt_attr FROM j WHERE m <> '-' AND (m = '+' OR ad IS DISTINCT FROM bd OR az IS DISTINCT FROM bz OR coalesce(aa <> 0 AND aa IS DISTINCT FROM ba, false))")
def add_writes(spark, sf_dir, sides=_two):
    return compare.needs_entry(*sides(spark, sf_dir))


@query(f"{_MARKED} SELECT archive_id, dt_path, CASE WHEN m = '-' THEN '>' WHEN m = '=' THEN '=' ELSE '?' END AS action FROM j WHERE m <> '+'")
def restore_actions(spark, sf_dir, sides=_two):
    return compare.restore_actions(*sides(spark, sf_dir))


for _f in (diff_marks, diff_counts, diff_hide_marks, deletes_between, common_unchanged, add_reads, add_writes, restore_actions):
    QUERIES[f"{_f.__name__}_late"] = partial(_f, sides=_late)
    SQL[f"{_f.__name__}_late"] = SQL[_f.__name__].replace(_MARKED, _marked("place > held - 8", "false"))


@query(r"""SELECT entry_id, dt_path FROM entries WHERE regexp_full_match(dt_path, '(?s)vol./.*(/.*)?') AND regexp_full_match(dt_path, '(?s).*/.*\.(html|jpg)(/.*)?') AND NOT regexp_full_match(dt_path, '(?s)vol1/Archive(/.*)?') AND NOT starts_with(dt_path, 'vol2/')""")
def select_only_not(spark, sf_dir):
    keep = paths.selected(F.col("dt_path"), ["vol?/*"], ["*/*.html", "*/*.jpg"], ["vol1/Archive", "vol2/"])
    return table(spark, sf_dir, "entries").filter(keep).select("entry_id", "dt_path")


@query("""SELECT entry_id, CASE WHEN starts_with(dt_path, 'vol1/') THEN 'one/' || substr(dt_path, 6) WHEN starts_with(dt_path, 'vol') THEN 'other' || substr(dt_path, 4) ELSE dt_path END AS new_path,
'new/root/' || regexp_replace(dt_path, '^/', '') AS under, regexp_extract(dt_path, '^(.*[/\\\\])?', 0, 's') AS dir FROM entries WHERE dt_path IS NOT NULL""")
def rename_prefix(spark, sf_dir):
    p = F.col("dt_path")
    return table(spark, sf_dir, "entries").filter("dt_path is not null").select("entry_id", paths.renamed(p, ["vol1/", "vol"], ["one/", "other"]).alias("new_path"), paths.renamed(p, (), ["new/root/"]).alias("under"), paths.dirname(p).alias("dir"))


@query("""SELECT entry_id, CASE WHEN dt_date > 0 THEN strftime(strptime(CAST(dt_date AS VARCHAR), '%Y%m%d%H%M%S'), '%Y-%m-%d %H:%M:%S') ELSE repeat(' ', 19) END AS date_text,
CASE WHEN dt_attr & 255 = 117 THEN substr('0pc3d5b7 9lBsDEF', CAST(((dt_attr >> 20) & 15) + 1 AS BIGINT), 1) || CAST((dt_attr >> 17) & 7 AS VARCHAR) || CAST((dt_attr >> 14) & 7 AS VARCHAR) || CAST((dt_attr >> 11) & 7 AS VARCHAR) || CAST((dt_attr >> 8) & 7 AS VARCHAR)
  WHEN dt_attr & 255 = 119 THEN rpad(x, greatest(5, CAST(length(x) AS INTEGER)), ' ') ELSE repeat(' ', 5) END AS attr_text
FROM (SELECT *, list_aggregate([CASE WHEN (dt_attr >> CAST(i + 8 AS INTEGER)) & 1 = 1 THEN substr('RHS DAdFTprCoIEivs89012345678901', i + 1, 1) ELSE '' END FOR i IN range(32)], 'string_agg', '') AS x FROM entries)""")
def listing_text(spark, sf_dir):
    return table(spark, sf_dir, "entries").select("entry_id", dates.date_text(F.col("dt_date")).alias("date_text"), dates.attr_text(F.col("dt_attr")).alias("attr_text"))


@query("""SELECT segments.seg_id, CAST(strftime(written_at, '%Y%m%d%H%M%S') AS BIGINT) AS written_date, epoch_us(strptime(strftime(written_at, '%Y%m%d%H%M%S'), '%Y%m%d%H%M%S')) // 1000000 AS unix_s FROM segments WHERE written_at IS NOT NULL""")
def decimal_dates(spark, sf_dir):
    rows = table(spark, sf_dir, "segments").filter("written_at is not null").select("seg_id", dates.decimal_date(F.col("written_at")).alias("written_date"))
    return rows.select("seg_id", "written_date", F.unix_timestamp(dates.to_timestamp(F.col("written_date"))).alias("unix_s"))


@query("""WITH p AS (SELECT entry_id, unnest(dt_ptr) AS frag_id FROM entries), s AS (SELECT p.entry_id, min(coalesce(ht_usize, -1)) AS lo, sum(coalesce(ht_usize, -1)) AS t FROM p JOIN fragments USING (frag_id) GROUP BY 1)
SELECT entry_id, CAST(CASE WHEN lo < 0 THEN -1 ELSE coalesce(t, 0) END AS BIGINT) AS content_size FROM entries LEFT JOIN s USING (entry_id)""")
def file_sizes(spark, sf_dir):
    return rollup.file_sizes(*_tables(spark, sf_dir, "entries", "fragments"))


@query(f"""WITH {_snap()},
f AS (SELECT archive_id, dt_path, greatest(coalesce(dt_size, 0), 0) AS z, str_split(dt_path, '/') AS parts FROM snap WHERE NOT ends_with(dt_path, '/')),
up AS (SELECT archive_id, z, unnest(list_transform(range(1, len(parts)), lambda i: list_aggregate(parts[1:i], 'string_agg', '/') || '/')) AS dt_path FROM f)
SELECT d.archive_id, d.dt_path, CAST(coalesce(sum(z), 0) AS BIGINT) AS total_size, count(z) AS n_files FROM (SELECT DISTINCT archive_id, dt_path FROM snap WHERE ends_with(dt_path, '/')) d LEFT JOIN up USING (archive_id, dt_path) GROUP BY ALL""")
def directory_rollup(spark, sf_dir):
    return rollup.directory_sizes(_snapshot(spark, sf_dir))


@query(f"""WITH {_snap()},
u AS (SELECT archive_id, frag_id, count(*) AS n FROM (SELECT archive_id, unnest(dt_ptr) AS frag_id FROM snap) GROUP BY ALL),
s AS (SELECT u.archive_id, sum(n) AS refs, count(*) AS n_frags, sum(CASE WHEN ht_usize >= 0 THEN ht_usize * n ELSE 0 END) AS all_size, sum(CASE WHEN ht_usize >= 0 THEN ht_usize ELSE 0 END) AS dedupe_size, count(*) FILTER (WHERE coalesce(ht_usize, -1) < 0) AS unknown FROM u JOIN fragments USING (frag_id) GROUP BY 1)
SELECT a.archive_id, a.n_files, CAST(coalesce(refs, 0) AS BIGINT) AS refs, coalesce(n_frags, 0) AS n_frags, CAST(coalesce(all_size, 0) AS BIGINT) AS all_size, CAST(coalesce(dedupe_size, 0) AS BIGINT) AS dedupe_size, coalesce(unknown, 0) AS unknown
FROM (SELECT archive_id, count(*) AS n_files FROM snap GROUP BY 1) a LEFT JOIN s USING (archive_id)""")
def dedupe_stats(spark, sf_dir):
    return rollup.dedupe_stats(_snapshot(spark, sf_dir), table(spark, sf_dir, "fragments"))


@query(f"WITH {_snap()} SELECT archive_id, CAST(sum(coalesce(dt_size, 0)) AS BIGINT) AS shown_bytes, count(*) AS shown_files FROM snap WHERE NOT ends_with(dt_path, '/') AND dt_path <> '' GROUP BY 1")
def shown_bytes(spark, sf_dir):
    return rollup.shown_bytes(_snapshot(spark, sf_dir), "archive_id")


@query(f"""WITH {_snap()},
t AS (SELECT archive_id, dt_path, dt_size, dt_date, coalesce(array_to_string(dt_ptr, ' '), '') AS ptr, dt_ptr, '-' AS mark FROM snap ORDER BY dt_size DESC NULLS LAST, dt_ptr NULLS FIRST, dt_path, archive_id LIMIT 50)
SELECT archive_id, dt_path, dt_size, CASE WHEN len(dt_ptr) > 0 AND lag(dt_ptr) OVER (ORDER BY dt_size DESC NULLS LAST, dt_ptr NULLS FIRST, dt_path, archive_id) = dt_ptr AND NOT ends_with(dt_path, '/') THEN '^' ELSE '-' END AS mark FROM t""")
def top_n_largest(spark, sf_dir):
    return compare.largest(_snapshot(spark, sf_dir).withColumn("mark", F.lit("-")), 50, F.col("archive_id")).select("archive_id", "dt_path", "dt_size", "mark")


@query(f"""WITH {_snap()}, g AS (SELECT archive_id, dt_ptr, count(*) AS copies FROM snap WHERE len(dt_ptr) > 0 GROUP BY ALL HAVING count(*) > 1)
SELECT s.archive_id, s.dt_path, g.copies FROM snap s JOIN g ON s.archive_id = g.archive_id AND s.dt_ptr = g.dt_ptr""")
def duplicate_files(spark, sf_dir):
    return compare.twins(_snapshot(spark, sf_dir))


@query("""SELECT file_id, batch_no, ext, CAST(size_bucket AS BIGINT) AS size_bucket, row_number() OVER (PARTITION BY batch_no ORDER BY ext, size_bucket, dt_path, file_id) AS place FROM (
SELECT DISTINCT file_id, batch_no, dt_path, translate(substr(regexp_extract(dt_path, '\\.([^./]*)$', 1), 1, 5), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS ext, 16777215 - least(greatest(coalesce(dt_size, 0), 0) >> 14, 16777215) AS size_bucket FROM batch_files WHERE dt_path IS NOT NULL)""".replace("\\\\", "\\"))
def ingest_order(spark, sf_dir):
    bucket = F.lit((1 << 24) - 1) - F.least(F.shiftright(F.greatest(F.coalesce("dt_size", F.lit(0)), F.lit(0)), 14), F.lit((1 << 24) - 1))
    rows = table(spark, sf_dir, "batch_files").filter("dt_path is not null").select("file_id", "batch_no", "dt_path", paths.extension_key(F.col("dt_path")).alias("ext"), bucket.cast("bigint").alias("size_bucket")).distinct()
    return number_rows(rows, ["ext", "size_bucket", "dt_path", "file_id"], "place", by="batch_no").drop("dt_path")


@query("SELECT block_id, version_id, CAST(coalesce(sum(coalesce(blk_bsize, 0)) OVER (PARTITION BY version_id ORDER BY blk_start, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS data_offset FROM blocks")
def block_offsets(spark, sf_dir):
    return rollup.block_offsets(table(spark, sf_dir, "blocks"))


@query("SELECT frag_id, block_id, CAST(coalesce(sum(greatest(coalesce(ht_usize, 0), 0)) OVER (PARTITION BY block_id ORDER BY pos_in_block, frag_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_in_block FROM fragments WHERE block_id IS NOT NULL")
def fragment_offsets(spark, sf_dir):
    return rollup.fragment_offsets(table(spark, sf_dir, "fragments"))


@query("""WITH p AS (SELECT entry_id, unnest(dt_ptr) AS frag_id, generate_subscripts(dt_ptr, 1) - 1 AS pos FROM entries)
SELECT entry_id, CAST(pos AS INTEGER) AS pos, p.frag_id, CAST(coalesce(sum(greatest(coalesce(ht_usize, 0), 0)) OVER (PARTITION BY entry_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_in_file FROM p LEFT JOIN fragments USING (frag_id)""")
def file_offsets(spark, sf_dir):
    return rollup.file_offsets(*_tables(spark, sf_dir, "entries", "fragments"))


@query("""SELECT b.block_id, blk_frags, blk_usize, count(f.frag_id) AS frags_present, CAST(sum(CASE WHEN f.frag_id IS NOT NULL THEN greatest(coalesce(ht_usize, 0), 0) + 4 END) + 8 AS BIGINT) AS usize_counted
FROM blocks b LEFT JOIN fragments f ON f.block_id = b.block_id GROUP BY ALL""")
def block_check(spark, sf_dir):
    return rollup.block_check(*_tables(spark, sf_dir, "blocks", "fragments"))


@query("""WITH f AS (SELECT DISTINCT frag_id, block_id FROM fragments WHERE block_id IS NOT NULL), g AS (SELECT *, frag_id - row_number() OVER (PARTITION BY block_id ORDER BY frag_id) AS k FROM f)
SELECT block_id, min(frag_id) AS first_id, max(frag_id) AS last_id, count(*) AS n FROM g GROUP BY block_id, k""")
def fragment_runs(spark, sf_dir):
    return rollup.id_runs(table(spark, sf_dir, "fragments").filter("block_id is not null"), ["block_id"], "frag_id")


@query("""WITH p AS (SELECT entry_id, dt_ptr, unnest(range(1, len(dt_ptr) + 1)) AS i FROM entries WHERE len(dt_ptr) > 0),
q AS (SELECT entry_id, i, dt_ptr[i] AS v, coalesce(i > 1 AND i < len(dt_ptr) AND dt_ptr[i] = dt_ptr[i - 1] + 1 AND dt_ptr[i] = dt_ptr[i + 1] - 1, false) AS mid FROM p),
r AS (SELECT *, coalesce(lag(mid) OVER (PARTITION BY entry_id ORDER BY i), false) AS pmid FROM q)
SELECT entry_id, string_agg(CASE WHEN mid THEN CASE WHEN pmid THEN '' ELSE '-' END ELSE CASE WHEN pmid OR i = 1 THEN '' ELSE ' ' END || CAST(v AS VARCHAR) END, '' ORDER BY i) AS ptr_text FROM r GROUP BY 1""")
def pointer_text(spark, sf_dir):
    return table(spark, sf_dir, "entries").filter("size(dt_ptr) > 0").select("entry_id", rollup.pointer_text(F.col("dt_ptr")).alias("ptr_text"))


@query(f"""WITH {_snap()}, u AS (SELECT DISTINCT unnest(dt_ptr) AS frag_id FROM snap)
SELECT block_id, CAST(max(pos_in_block) + 1 AS BIGINT) AS frags_needed, count(*) AS frags_used FROM u JOIN fragments USING (frag_id) WHERE block_id IS NOT NULL GROUP BY 1""")
def needed_blocks(spark, sf_dir):
    return rollup.reading_plan(_snapshot(spark, sf_dir), table(spark, sf_dir, "fragments"))


@query(f"""WITH {_snap()}, u AS (SELECT DISTINCT block_id FROM fragments WHERE frag_id IN (SELECT unnest(dt_ptr) FROM snap))
SELECT archive_id, count(*) AS blocks, CAST(sum(coalesce(blk_bsize, 0)) AS BIGINT) AS bytes FROM blocks WHERE block_id IN (SELECT block_id FROM u WHERE block_id IS NOT NULL) GROUP BY 1""")
def repack_blocks(spark, sf_dir):
    kept = rollup.kept_blocks(table(spark, sf_dir, "blocks"), _snapshot(spark, sf_dir), table(spark, sf_dir, "fragments"))
    return kept.groupBy("archive_id").agg(F.count("*").alias("blocks"), F.sum(F.coalesce("blk_bsize", F.lit(0))).alias("bytes"))


@query("""WITH bad AS (SELECT block_id FROM blocks WHERE blk_bsize IS NULL), p AS (SELECT entry_id, unnest(dt_ptr) AS frag_id FROM entries),
x AS (SELECT entry_id, count(*) FILTER (WHERE f.block_id IS NOT NULL AND b.block_id IS NULL) AS restored, count(*) AS total FROM p LEFT JOIN fragments f USING (frag_id) LEFT JOIN bad b ON b.block_id = f.block_id GROUP BY 1)
SELECT * FROM x WHERE restored < total""")
def restore_failures(spark, sf_dir):
    return rollup.failed_files(*_tables(spark, sf_dir, "entries", "fragments"), table(spark, sf_dir, "blocks").filter("blk_bsize is null"))


@query("""WITH s AS (SELECT *, sum((coalesce(seg_name, '') <> '')::INT) OVER (PARTITION BY origin ORDER BY seg_id) AS file_no FROM segments)
SELECT origin, CAST(file_no AS BIGINT) AS file_no, max(seg_name) FILTER (WHERE seg_name <> '') AS seg_name, min(seg_id) AS first_seg, count(*) AS segments, CAST(sum(greatest(coalesce(ht_usize, 0), 0)) AS BIGINT) AS bytes FROM s GROUP BY ALL""")
def stream_files(spark, sf_dir):
    return rollup.stream_files(table(spark, sf_dir, "segments"))


@query("""WITH v AS (SELECT *, lag(ver_date) OVER (PARTITION BY archive_id ORDER BY version_no) AS b FROM versions),
bl AS (SELECT *, lag(blk_start + blk_frags) OVER (PARTITION BY version_id ORDER BY blk_start, block_id) AS a FROM blocks),
pr AS (SELECT block_id, count(*) AS p FROM fragments WHERE block_id IS NOT NULL GROUP BY 1),
fr AS (SELECT *, ht_sha1 IS NULL OR hex(ht_sha1) = repeat('0', 40) AS nokey FROM fragments)
SELECT 'version_uncommitted' AS problem, count(*) AS n FROM versions WHERE ver_csize < 0
UNION ALL SELECT 'version_date_not_later', count(*) FROM v WHERE ver_date <= b
UNION ALL SELECT 'block_without_size', count(*) FROM blocks WHERE blk_bsize IS NULL
UNION ALL SELECT 'block_overlaps', count(*) FROM bl WHERE blk_start < a
UNION ALL SELECT 'block_fragments_differ', count(*) FROM blocks LEFT JOIN pr USING (block_id) WHERE coalesce(p, 0) <> coalesce(blk_frags, 0)
UNION ALL SELECT 'fragment_without_key', count(*) FROM fr WHERE nokey
UNION ALL SELECT 'fragment_size_unknown', count(*) FROM fragments WHERE coalesce(ht_usize, -1) < 0
UNION ALL SELECT 'fragment_key_again', count(*) - count(DISTINCT ht_sha1) FROM fr WHERE NOT nokey
UNION ALL SELECT 'entry_without_path', count(*) FROM entries WHERE dt_path IS NULL
UNION ALL SELECT 'entry_date_wrong', count(*) FROM entries WHERE dt_date > 0 AND try_strptime(lpad(CAST(dt_date AS VARCHAR), 14, '0'), '%Y%m%d%H%M%S') IS NULL
UNION ALL SELECT 'entry_tag_unknown', count(*) FROM entries WHERE dt_attr <> 0 AND (dt_attr & 255) NOT IN (117, 119)
UNION ALL SELECT 'entry_without_list', count(*) FROM entries WHERE dt_ptr IS NULL AND NOT coalesce(dt_date = 0, false)
UNION ALL SELECT 'pointer_to_nothing', count(*) FROM (SELECT unnest(dt_ptr) AS frag_id FROM entries) LEFT JOIN fragments f USING (frag_id) WHERE f.ht_usize IS NULL AND f.ht_sha1 IS NULL AND frag_id NOT IN (SELECT frag_id FROM fragments)""")
def archive_problems(spark, sf_dir):
    return problems(*_tables(spark, sf_dir, "versions", "blocks", "fragments", "entries"))


@query("SELECT archive_id, max(greatest(ver_date, ver_lastdate)) AS last_date FROM versions WHERE ver_csize <> -1 GROUP BY 1")
def last_dates(spark, sf_dir):
    return journal.last_dates(table(spark, sf_dir, "versions"))


@query("""WITH n AS (SELECT origin, seg_id, seg_name, seg_comment, greatest(coalesce(ht_usize, 0), 0) AS u, sum((coalesce(seg_name, '') <> '')::INT) OVER (PARTITION BY origin ORDER BY seg_id) AS file_no FROM segments),
f AS (SELECT origin, file_no, min(seg_id) AS seg_id, sum(u) AS bytes FROM n WHERE file_no > 0 GROUP BY 1, 2)
SELECT f.origin, CAST(f.file_no AS BIGINT) AS file_no, n.seg_name AS dt_path, TRY_CAST(nullif(regexp_extract(seg_comment, '^\\s*(\\d{1,18})', 1), '') AS BIGINT) AS dt_date, CAST(bytes AS BIGINT) AS dt_size,
ascii(nullif(regexp_extract(seg_comment, '^\\s*\\d{1,18}\\s+([uw])\\d{1,9}', 1), '')) + TRY_CAST(nullif(regexp_extract(seg_comment, '^\\s*\\d{1,18}\\s+[uw](\\d{1,9})', 1), '') AS BIGINT) * 256 AS dt_attr
FROM f JOIN n ON n.seg_id = f.seg_id""")
def stream_entries(spark, sf_dir):
    return rollup.stream_entries(table(spark, sf_dir, "segments"))


@query("""WITH f AS (SELECT DISTINCT file_id, dt_path, dt_ptr FROM batch_files WHERE len(dt_ptr) > 0), c AS (SELECT frag_id, min(frag_id) OVER (PARTITION BY ht_sha1) AS one FROM fragments WHERE ht_sha1 IS NOT NULL),
p AS (SELECT file_id, dt_path, generate_subscripts(dt_ptr, 1) AS pos, unnest(dt_ptr) AS frag_id FROM f), l AS (SELECT file_id, dt_path, list(one ORDER BY pos) AS ptr FROM p JOIN c USING (frag_id) GROUP BY 1, 2),
g AS (SELECT ptr, count(*) AS copies FROM l GROUP BY 1 HAVING count(*) > 1) SELECT 0 AS archive_id, l.dt_path, g.copies FROM l JOIN g USING (ptr)""")
def duplicate_staged(spark, sf_dir):
    """Staged files of which another one has the same content, fragment by fragment, under whatever ids."""
    one = table(spark, sf_dir, "fragments").filter("ht_sha1 is not null")
    one = one.join(one.groupBy("ht_sha1").agg(F.min("frag_id").alias("one")), "ht_sha1").select("frag_id", "one")
    uses = table(spark, sf_dir, "batch_files").select("file_id", "dt_path", "dt_ptr").distinct().select("file_id", "dt_path", F.posexplode("dt_ptr").alias("pos", "frag_id"))
    files = uses.join(one, "frag_id").groupBy("file_id", "dt_path").agg(F.sort_array(F.collect_list(F.struct("pos", "one"))).alias("s"))
    return compare.twins(files.select(F.lit(0).alias("archive_id"), "dt_path", F.col("s.one").alias("dt_ptr")))
