"""Queries on the change-data operators of the core, with their SQL."""

from __future__ import annotations

from vaultframe.operators.history import CheckpointHistory, attribute_periods, committed_records
from vaultframe.operators.incremental import incremental_takes
from vaultframe.operators.snapshots import snapshot_changes
from vaultframe.session import table


def p3_found(spark, sf_dir):
    return attribute_periods(table(spark, sf_dir, "entries"), table(spark, sf_dir, "versions")).select("archive_id", "dt_path", "valid_from", "valid_to")


def p3_as_of(spark, sf_dir):
    records = committed_records(table(spark, sf_dir, "entries"), table(spark, sf_dir, "versions"))
    return CheckpointHistory.build(records).as_of(5)


def p3_as_of_late(spark, sf_dir):
    """Near the end of the archives, where the state comes from checkpoints."""
    records = committed_records(table(spark, sf_dir, "entries"), table(spark, sf_dir, "versions"))
    return CheckpointHistory.build(records).as_of(30)


def p4_found(spark, sf_dir):
    return snapshot_changes(table(spark, sf_dir, "snapshots"), table(spark, sf_dir, "deliveries")).select("root_id", "snap_no", "dt_path", "mark")


def p6_found(spark, sf_dir):
    return incremental_takes(table(spark, sf_dir, "entries"), table(spark, sf_dir, "runs"))


def ledger_each_run(spark, sf_dir):
    """Every run is a pass of its own, so that each border between runs goes through the ledger."""
    return incremental_takes(table(spark, sf_dir, "entries"), table(spark, sf_dir, "runs"), runs_per_pass=1)


_RECORDS = """
recs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY version_id, seq_no ORDER BY loaded_at DESC, entry_id DESC) AS rn FROM entries WHERE dt_path IS NOT NULL) WHERE rn = 1),
one AS (SELECT * FROM (
  SELECT r.archive_id, r.dt_path, v.version_no, coalesce(r.dt_date = 0, false) AS del,
         nullif(nullif(r.dt_date, -1), 0) AS d, nullif(r.dt_size, -1) AS s, nullif(r.dt_attr, 0) AS a,
         row_number() OVER (PARTITION BY r.archive_id, r.dt_path, v.version_no ORDER BY r.seq_no DESC) AS k
  FROM recs r JOIN (SELECT DISTINCT version_id, version_no FROM versions WHERE ver_csize <> -1) v USING (version_id)) WHERE k = 1),
lives AS (SELECT *, count(*) FILTER (WHERE del) OVER w AS life FROM one WINDOW w AS (PARTITION BY archive_id, dt_path ORDER BY version_no ROWS UNBOUNDED PRECEDING)),
st AS (SELECT archive_id, dt_path, version_no, del, life,
         CASE WHEN NOT del THEN last_value(d IGNORE NULLS) OVER w END AS d,
         CASE WHEN NOT del THEN last_value(s IGNORE NULLS) OVER w END AS s,
         CASE WHEN NOT del THEN last_value(a IGNORE NULLS) OVER w END AS a
       FROM (SELECT * REPLACE (CASE WHEN del THEN NULL ELSE d END AS d, CASE WHEN del THEN NULL ELSE s END AS s, CASE WHEN del THEN NULL ELSE a END AS a) FROM lives)
       WINDOW w AS (PARTITION BY archive_id, dt_path, life ORDER BY version_no ROWS UNBOUNDED PRECEDING))"""

SQL = {
    "p3_found": f"""WITH {_RECORDS},
marks AS (SELECT *, lag(del) OVER w AS pdel, lag(version_no) OVER w AS pv, lag(d) OVER w AS pd, lag(s) OVER w AS ps, lag(a) OVER w AS pa FROM st WINDOW w AS (PARTITION BY archive_id, dt_path ORDER BY version_no)),
edges AS (SELECT * FROM marks WHERE CASE WHEN del THEN pv IS NOT NULL AND NOT pdel ELSE pv IS NULL OR pdel OR d IS DISTINCT FROM pd OR s IS DISTINCT FROM ps OR a IS DISTINCT FROM pa END),
ends AS (SELECT *, lead(version_no) OVER (PARTITION BY archive_id, dt_path ORDER BY version_no) AS nxt FROM edges)
SELECT archive_id, dt_path, CAST(version_no AS INTEGER) AS valid_from, CAST(coalesce(nxt, 0) AS INTEGER) AS valid_to FROM ends WHERE NOT del""",
    "p3_as_of": f"""WITH {_RECORDS}
SELECT archive_id, dt_path, d AS dt_date, s AS dt_size, a AS dt_attr FROM (
  SELECT *, row_number() OVER (PARTITION BY archive_id, dt_path ORDER BY version_no DESC) AS n FROM st WHERE version_no <= 5) WHERE n = 1 AND NOT del""",
    "p4_found": """WITH good AS (SELECT delivery_id, root_id, snap_no FROM (SELECT *, row_number() OVER (PARTITION BY root_id, snap_no ORDER BY delivered_at DESC, delivery_id DESC) AS n FROM deliveries WHERE delivery_status = 'complete') WHERE n = 1),
near AS (SELECT *, lag(delivery_id) OVER (PARTITION BY root_id ORDER BY snap_no) AS before_id FROM good),
l AS (SELECT delivery_id, dt_path, nullif(dt_date, -1) AS d, nullif(dt_size, -1) AS s FROM (SELECT *, row_number() OVER (PARTITION BY delivery_id, dt_path ORDER BY row_no DESC) AS n FROM snapshots WHERE dt_path IS NOT NULL) WHERE n = 1),
now AS (SELECT n.root_id, n.snap_no, n.before_id, l.dt_path, l.d, l.s FROM near n JOIN l USING (delivery_id) WHERE n.before_id IS NOT NULL),
was AS (SELECT n.root_id, n.snap_no, l.dt_path, l.d, l.s FROM near n JOIN l ON l.delivery_id = n.before_id)
SELECT root_id, snap_no, dt_path, CASE WHEN a.o IS NULL THEN '+' WHEN b.o IS NULL THEN '-' ELSE '#' END AS mark
FROM (SELECT *, 1 AS o FROM now) b FULL JOIN (SELECT *, 1 AS o FROM was) a USING (root_id, snap_no, dt_path)
WHERE a.o IS NULL OR b.o IS NULL OR coalesce(a.d <> b.d, false) OR coalesce(a.s <> b.s, false)""",
    "p6_found": """WITH ok AS (SELECT run_no, min(started_at) AS began FROM runs WHERE run_status = 'ok' GROUP BY run_no),
given AS (SELECT e.*, o.run_no, o.began FROM entries e ASOF JOIN ok o ON e.loaded_at <= o.began),
heads AS (SELECT *, CASE WHEN dt_date = -1 THEN NULL ELSE dt_date END AS d FROM given QUALIFY row_number() OVER (PARTITION BY version_id, seq_no, run_no ORDER BY loaded_at DESC, entry_id DESC) = 1),
seq AS (SELECT *, row_number() OVER w AS k, lag(d) OVER w AS pd FROM heads WINDOW w AS (PARTITION BY version_id, seq_no ORDER BY began))
SELECT CAST(run_no AS INTEGER) AS run_no, entry_id FROM seq WHERE k = 1 OR d IS DISTINCT FROM pd""",
}

SQL["p3_as_of_late"] = SQL["p3_as_of"].replace("version_no <= 5", "version_no <= 30")

SQL["ledger_each_run"] = SQL["p6_found"]

QUERIES = {f.__name__: f for f in (p3_found, p3_as_of, p3_as_of_late, p4_found, p6_found, ledger_each_run)}
