"""History, snapshot changes and incremental runs against brute force, with dirty and empty input."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vaultframe.operators.history import CheckpointHistory, attribute_periods, committed_records
from vaultframe.operators.incremental import ProcessedLedger, incremental_takes, successful_runs
from vaultframe.operators import snapshots
from vaultframe.operators.snapshots import snapshot_changes
from vaultframe.session import scratch_path

T0 = datetime(2021, 1, 1)
ENTRIES = "entry_id bigint, archive_id int, version_id bigint, seq_no int, dt_path string, dt_date bigint, dt_size bigint, dt_attr bigint, loaded_at timestamp, prev_snap string"
VERSIONS = "version_id bigint, archive_id int, version_no int, ver_csize bigint, was_alive string"


def some_entries(seed, n=400):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        date = rnd.choice([0, -1, None, 20200101000000, 20200102000000, 20200103000000])
        out.append((i, 1, rnd.randrange(12), rnd.randrange(6), rnd.choice(["a", "b", "c/", None, "a"]), date, rnd.choice([-1, None, 5, 6]), rnd.choice([0, None, 7]), T0 + timedelta(hours=rnd.randrange(200)), "x"))
    return out


def versions(n=12):
    return [(v, 1, v + 1, -1 if v == 4 else 10, "y") for v in range(n)]


def brute_periods(entries, vers):
    valid = {}
    for e in entries:
        if e[4] is None:
            continue
        key = (e[2], e[3])
        if key not in valid or (e[8], e[0]) > (valid[key][8], valid[key][0]):
            valid[key] = e
    number = {v[0]: v[2] for v in vers if v[3] != -1}
    heads = {}
    for e in valid.values():
        if e[2] in number:
            key = (e[1], e[4], number[e[2]])
            if key not in heads or e[3] > heads[key][3]:
                heads[key] = e
    out, run = [], {}
    for (a, p, v), e in sorted(heads.items(), key=lambda x: x[0]):
        if e[5] == 0:
            if (a, p) in run:
                out.append((a, p, run.pop((a, p))[0], v))
            continue
        new = tuple(x if x not in drop else None for x, drop in ((e[5], (-1,)), (e[6], (-1,)), (e[7], (0,))))
        if (a, p) not in run:
            run[a, p] = (v, new)
            continue
        begin, old = run[a, p]
        state = tuple(n if n is not None else o for n, o in zip(new, old))
        if state != old:
            out.append((a, p, begin, v))
            run[a, p] = (v, state)
    return sorted(out + [(a, p, b, 0) for (a, p), (b, _) in run.items()], key=repr)


@pytest.mark.parametrize("seed,every", [(1, 1), (2, 3), (3, 32)])
def test_periods(spark, rows, seed, every):
    entries, vers = some_entries(seed), versions()
    e, v = spark.createDataFrame(entries + entries[:9], ENTRIES), spark.createDataFrame(vers, VERSIONS)
    got = attribute_periods(e, v, every).select("archive_id", "dt_path", "valid_from", "valid_to")
    assert rows(got) == brute_periods(entries, vers)


def test_history_round_trip_and_as_of(spark, rows):
    e, v = spark.createDataFrame(some_entries(5), ENTRIES), spark.createDataFrame(versions(), VERSIONS)
    history = CheckpointHistory.build(committed_records(e, v), every=4)
    path = scratch_path(spark, "history-test")
    history.write(path)
    stored = CheckpointHistory.read(spark, path, every=4)
    assert rows(stored.periods()) == rows(history.periods())
    for at in (0, 3, 7, 12):
        held = history.periods().filter((F.col("valid_from") <= at) & ((F.col("valid_to") == 0) | (F.col("valid_to") > at))).drop("valid_from", "valid_to")
        assert rows(stored.as_of(at)) == rows(held)


def test_default_stride_reaches_checkpoints(spark, rows):
    rnd = random.Random(6)
    entries, vers = [(e[0], 1, rnd.randrange(33), *e[3:]) for e in some_entries(6)], versions(33)
    e, v = spark.createDataFrame(entries, ENTRIES), spark.createDataFrame(vers, VERSIONS)
    history = CheckpointHistory.build(committed_records(e, v))
    assert rows(history.periods().select("archive_id", "dt_path", "valid_from", "valid_to")) == brute_periods(entries, vers)
    assert history.checkpoints.filter("was_alive or dt_size is not null").select("epoch").distinct().count() >= 3
    held = history.periods().filter("valid_from <= 30 and (valid_to = 0 or valid_to > 30)").drop("valid_from", "valid_to")
    assert rows(history.as_of(30)) == rows(held)


def test_periods_of_nothing(spark):
    e, v = spark.createDataFrame([], ENTRIES), spark.createDataFrame([], VERSIONS)
    assert attribute_periods(e, v).count() == 0


SNAPS = "delivery_id bigint, root_id int, snap_no int, row_no int, dt_path string, dt_date bigint, dt_size bigint, mark string"
DELIVERIES = "delivery_id bigint, root_id int, snap_no int, delivered_at timestamp, delivery_status string, dt_date string"


def some_snapshots(seed):
    rnd = random.Random(seed)
    deliveries, snaps = [], []
    for d in range(14):
        root, snap = rnd.choice([1, 1, 1, 2]), rnd.randrange(1, 7)
        deliveries.append((d, root, snap, T0 + timedelta(days=rnd.randrange(9), seconds=d), rnd.choice(["complete", "complete", "aborted", None]), "z"))
        for k in range(rnd.randrange(0, 25)):
            snaps.append((d, root, snap, k, rnd.choice(["a", "b", "c", "", None, "d"]), rnd.choice([1, 2, -1, None]), rnd.choice([5, 6, None]), "m"))
    return snaps, deliveries


def brute_changes(snaps, deliveries):
    good = {}
    for d in deliveries:
        if d[4] == "complete" and ((d[1], d[2]) not in good or (d[3], d[0]) > (good[d[1], d[2]][3], good[d[1], d[2]][0])):
            good[d[1], d[2]] = d
    listing = {}
    for (root, snap), d in good.items():
        listing[root, snap] = {s[4]: tuple(None if x == -1 else x for x in s[5:7]) for s in sorted((s for s in snaps if s[0] == d[0] and s[4] is not None), key=lambda s: s[3])}
    expected = []
    for root, snap in listing:
        if before := [n for r, n in listing if r == root and n < snap]:
            old, new = listing[root, max(before)], listing[root, snap]
            for p in old.keys() | new.keys():
                differs = p in old and p in new and any(x is not None and y is not None and x != y for x, y in zip(old[p], new[p]))
                mark = "+" if p not in old else "-" if p not in new else "#" if differs else None
                expected += [(root, snap, p, mark)] if mark else []
    return sorted(expected, key=repr)


@pytest.mark.parametrize("seed,lines", [(4, 1 << 16), (5, 2), (6, 1)])
def test_snapshot_changes(spark, rows, seed, lines, monkeypatch):
    monkeypatch.setattr(snapshots, "RANGE_LINES", lines)
    snaps, deliveries = some_snapshots(seed)
    got = snapshot_changes(spark.createDataFrame(snaps + snaps[:5], SNAPS), spark.createDataFrame(deliveries, DELIVERIES))
    expected = brute_changes(snaps, deliveries)
    assert rows(got.select("root_id", "snap_no", "dt_path", "mark")) == expected and expected


@pytest.mark.parametrize("seed", [7, 8, 9])
def test_snapshots_are_kept(spark, rows, seed, monkeypatch):
    """Deliveries in any order over several intakes, some in place of others; only lines of new deliveries are given."""
    monkeypatch.setattr(snapshots, "RANGE_LINES", 4)
    rnd = random.Random(seed)
    snaps, deliveries = some_snapshots(seed)
    rnd.shuffle(deliveries)
    store, given = snapshots.SnapshotStore(spark, scratch_path(spark, "snapshot-test")), []
    for k in (4, 9, 9, 14):
        new = [d[0] for d in deliveries[len(given) : k]]
        given = deliveries[:k]
        store.accept(spark.createDataFrame([s for s in snaps if s[0] in new], SNAPS), spark.createDataFrame(given, DELIVERIES))
        there = {d[0] for d in given}
        assert rows(store.changes().select("root_id", "snap_no", "dt_path", "mark")) == brute_changes([s for s in snaps if s[0] in there], given)


def test_paths_of_one_hash_are_told_apart():
    import pyarrow as pa

    def listing(lines):
        x = snapshots._Listing({})
        x.parts = [pa.RecordBatch.from_arrays([pa.array([h for h, *_ in lines]), pa.array([p for _, p, *_ in lines]), pa.array([d for *_, d in lines]), pa.array([1] * len(lines))], ["h", "dt_path", "dt_date", "dt_size"])]
        return x.close()

    old = listing([(1, "a", 1), (1, "b", 1), (2, "c", 1), (3, "d", 1), (3, "d", 9), (5, "z", 1)])
    new = listing([(1, "b", 2), (1, "x", 1), (2, "y", 1), (3, "d", 1), (4, "e", 1), (5, "z", 1), (5, "zz", 1)])
    new.row.update({"root_id": 1, "range": 0, "snap_no": 2, "delivery_id": 5, "prev_id": 4})
    got = sorted((m, p) for b in snapshots._changes(old, new) for m, p in zip(b.column("mark").to_pylist(), b.column("dt_path").to_pylist()))
    assert got == [("#", "b"), ("+", "e"), ("+", "x"), ("+", "y"), ("+", "zz"), ("-", "a"), ("-", "c")]


def test_snapshot_tie_is_defined(spark, rows):
    d = spark.createDataFrame([(1, 1, 1, T0, "complete", ""), (2, 1, 2, T0, "complete", "")], DELIVERIES)
    lines = [(1, 1, 1, 1, "a", 1, 1, ""), (1, 1, 1, 1, "a", 2, 2, ""), (2, 1, 2, 1, "a", 3, 3, "")]
    assert rows(snapshot_changes(spark.createDataFrame(lines, SNAPS), d)) == rows(snapshot_changes(spark.createDataFrame(lines[::-1], SNAPS), d))
    assert snapshot_changes(spark.createDataFrame([], SNAPS), d).count() == 0


RUNS = "run_no int, attempt_no int, started_at timestamp, finished_at timestamp, run_status string"


def some_runs():
    out = []
    for r in range(1, 9):
        out.append((r, 1, T0 + timedelta(hours=25 * r), None, "failed" if r % 3 == 0 else "ok"))
        if r == 6:
            out.append((r, 2, T0 + timedelta(hours=25 * r + 3), None, "ok"))
    return out + out[:2]


def brute_takes(entries, runs):
    ok = sorted({(r[2], r[0]) for r in runs if r[4] == "ok"})
    by = {}
    for e in entries:
        if run := next(((t, n) for t, n in ok if t >= e[8]), None):
            by.setdefault((e[2], e[3]), {}).setdefault(run, []).append(e)
    out = []
    for groups in by.values():
        last = "none"
        for run in sorted(groups):
            e = max(groups[run], key=lambda e: (e[8], e[0]))
            date = None if e[5] == -1 else e[5]
            out += [(run[1], e[0])] if last != date else []
            last = date
    return sorted(out, key=repr)


@pytest.mark.parametrize("each", [1, 3, 32])
def test_incremental_takes(spark, rows, each):
    entries, runs = some_entries(8), some_runs()
    got = incremental_takes(spark.createDataFrame(entries, ENTRIES), spark.createDataFrame(runs, RUNS), each)
    assert rows(got) == brute_takes(entries, runs)


def test_ledger_survives_failure_and_late_rows(spark, rows):
    entries, runs = some_entries(9), some_runs()
    due = successful_runs(spark.createDataFrame(runs, RUNS))
    ledger = ProcessedLedger(spark, scratch_path(spark, "ledger-test"), grace_hours=500)
    hidden = [e for e in entries if e[0] % 10 == 0]
    ledger.process(spark.createDataFrame([e for e in entries if e not in hidden], ENTRIES), due[:2])
    before = rows(ledger.taken())

    broken = spark.createDataFrame(entries, ENTRIES).withColumn("entry_id", F.when(F.col("entry_id") > 300, F.raise_error(F.lit("lost")).cast("bigint")).otherwise(F.col("entry_id")))
    with pytest.raises(Exception):  # noqa: B017
        ledger.process(broken, due[2:])
    assert rows(ledger.taken()) == before

    ledger.process(spark.createDataFrame(entries, ENTRIES), due[2:])
    taken = rows(ledger.taken())
    ledger.process(spark.createDataFrame(entries, ENTRIES), due)
    assert rows(ledger.taken()) == taken
    ids = [e for _, e in taken]
    assert len(ids) == len(set(ids))
    seen = spark.read.parquet(*(f"{ledger.path}/seen/{p['dir']}" for p in ledger._log()))
    last = T0 + timedelta(hours=200)
    assert sorted(r["entry_id"] for r in seen.select("entry_id").collect()) == sorted(e[0] for e in entries if e[8] <= last)


def test_late_rows_of_old_transactions(spark, rows):
    """With the default grace: rows that show up long after their loading time, of transactions quiet for days, unknown so far, or begun long ago and still open."""
    due = successful_runs(spark.createDataFrame(some_runs(), RUNS))
    row = lambda i, v, seq, hour, date=1: (i, 1, v, seq, "p", date, 1, 1, T0 + timedelta(hours=hour), "x")
    steady = [row(1, 1, 1, 1), row(2, 1, 2, 8), row(3, 2, 1, 2), row(4, 2, 2, 90), row(5, 3, 1, 140), row(6, 3, 2, 190)]
    second = [row(7, 1, 1, 5, 2), row(8, 4, 1, 3), row(9, 2, 3, 4), row(10, None, 1, 6)]
    third = [row(11, 1, 3, 7), row(12, 4, 1, 2, 5), row(13, 5, None, 1)]
    ledger = ProcessedLedger(spark, scratch_path(spark, "ledger-late"))
    ids = lambda: sorted((e, r) for r, e in rows(ledger.taken()))
    frame = lambda entries: spark.createDataFrame(entries, ENTRIES)
    ledger.process(frame(steady), due[:3])
    assert [e for e, _ in ids()] == [1, 2, 3, 4]
    ledger.process(frame(steady + second), due[3:5])
    assert [e for e, _ in ids()] == [1, 2, 3, 4, 5, 7, 8, 9, 10]
    ledger.process(frame(steady + second + third + second[:1]), due[5:])
    assert [e for e, _ in ids()] == list(range(1, 14))
    late = {e: r for e, r in ids() if e >= 7}
    assert {late[e] for e in (7, 8, 9, 10)} == {due[3][0]} and {late[e] for e in (11, 12, 13)} == {due[5][0]}


@pytest.mark.parametrize("seed", [21, 22])
def test_growing_source_with_failures(spark, rows, seed):
    """A pass a run over a source that grows; every second pass fails once, before its commit. Nothing is lost or taken twice, and states are merged on the way."""
    rnd = random.Random(seed)
    due = successful_runs(spark.createDataFrame(some_runs(), RUNS)) * 1
    due = [(r + 100 * k, at + k) for r, at in due for k in range(2)]
    entries = some_entries(seed, 150)
    shows = {e[0]: rnd.randrange(len(due)) for e in entries}
    folder, failed = scratch_path(spark, "ledger-grows"), 0
    for k, run in enumerate(due):
        there = spark.createDataFrame([e for e in entries if shows[e[0]] <= k], ENTRIES)
        if k % 2:
            broken = there.withColumn("dt_date", F.when(F.col("entry_id") >= 0, F.raise_error(F.lit("lost")).cast("bigint")))
            log = ProcessedLedger(spark, folder)._log()
            try:
                ProcessedLedger(spark, folder).process(broken, [run])
            except Exception:  # noqa: BLE001
                assert ProcessedLedger(spark, folder)._log() == log
                failed += 1
        ProcessedLedger(spark, folder).process(there, [run])
    ledger = ProcessedLedger(spark, folder)
    assert failed >= 4 and any(p.get("newest") for p in ledger._log())
    seen = spark.read.parquet(*(f"{folder}/seen/{p['dir']}" for p in ledger._log()))
    assert sorted(r["entry_id"] for r in seen.select("entry_id").collect()) == sorted(e[0] for e in entries if e[8] <= T0 + timedelta(microseconds=due[-1][1] - int(T0.timestamp() * 10**6)))
    ids = [e for _, e in rows(ledger.taken())]
    assert len(ids) == len(set(ids))


def test_incremental_of_nothing(spark):
    runs = spark.createDataFrame(some_runs(), RUNS)
    assert incremental_takes(spark.createDataFrame([], ENTRIES), runs).count() == 0
    assert incremental_takes(spark.createDataFrame(some_entries(1), ENTRIES), runs.filter("run_no > 99")).count() == 0
