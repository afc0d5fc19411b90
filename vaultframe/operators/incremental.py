"""Processing only new or changed records, with a ledger of what was processed."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vaultframe.session import read_text, scratch_path, write_text

RECORD = ("version_id", "seq_no")
#: Passes whose states are read one by one; then they are merged into one table with the newest state of each record.
APART = 8


def successful_runs(runs: DataFrame) -> list[tuple[int, int]]:
    """(run_no, started_at in microseconds) of the ``ok`` attempts, by start. The log of runs is one line per attempt; only its ok lines reach the driver."""
    ok = runs.filter((F.col("run_status") == "ok") & F.col("started_at").isNotNull() & F.col("run_no").isNotNull())
    rows = ok.groupBy("run_no").agg(F.min(F.unix_micros(F.col("started_at").cast("timestamp"))).alias("at")).collect()
    return sorted(((r["run_no"], r["at"]) for r in rows), key=lambda x: (x[1], x[0]))


def _run_of(loaded: Column, runs: list[tuple[int, int]]) -> Column:
    """First run that started at or after ``loaded``, by a search tree of comparisons."""
    if len(runs) == 1:
        return F.lit(runs[0][0])
    half = len(runs) // 2
    return F.when(loaded <= runs[half - 1][1], _run_of(loaded, runs[:half])).otherwise(_run_of(loaded, runs[half:]))


def _newest(states: DataFrame) -> DataFrame:
    """The last loaded state of each record, then that of the largest entry_id."""
    rest = ("entry_id", "loaded_us", "dt_date", "run_no")
    last = F.max_by(F.struct(*rest), F.struct("loaded_us", F.coalesce("entry_id", F.lit(-(1 << 63)).cast("bigint"))))
    return states.groupBy(*RECORD).agg(last.alias("s")).select(*RECORD, *(F.col(f"s.{c}").alias(c) for c in rest))


class ProcessedLedger:
    """Ledger of processed rows in a folder that all executors share.

    A pass handles one or more successful runs that are due. It counts the
    source's rows a transaction (version_id) and compares that with the table
    ``transactions`` of the pass before, one row a version_id. A transaction is
    open if its rows aren't those counted then, however old they are, or if it
    had a row loaded within ``grace_hours`` before the last run. The pass
    rereads the open transactions from the first loading time of the oldest,
    removes by an anti-join the (record, row) pairs that the ledger already
    has, and takes of the rest the records that are new or whose date changed.
    Each pass writes ``transactions``, ``seen`` (all its rows) and ``states`` (a
    record's last row in each run, with whether it was taken), after APART
    passes also ``newest`` (each record's newest state so far, which the next
    ones read in place of all earlier states), then commits by one file that no
    pass replaces; a pass that fails before that leaves nothing that is read,
    and is simply done again.
    """

    def __init__(self, spark: SparkSession, path: str, grace_hours: int = 24):
        self.spark, self.path, self.grace = spark, path.rstrip("/"), grace_hours * 3600 * 10**6
        self._kinds: dict[str, str] = {}

    def _log(self) -> list[dict]:
        return json.loads(read_text(self.spark, f"{self.path}/commits.json") or "[]")

    def _read(self, name: str, passes: list[dict]) -> DataFrame | None:
        if not passes:
            return None
        kinds = passes[-1].get("kinds") or self._kinds
        state = (*RECORD, "entry_id", "loaded_us", "dt_date", "run_no")
        columns = {"transactions": ("version_id", "lo", "hi", "n", "mark"), "seen": state, "newest": state, "states": (*state, "taken")}[name]
        return self.spark.read.schema(", ".join(f"{c} {kinds[c]}" for c in columns)).parquet(*(f"{self.path}/{name}/{p['dir']}" for p in passes))

    def process(self, source: DataFrame, runs: list[tuple[int, int]]) -> None:
        """One pass for the given runs, in order of their start; those already committed are left out.

        A row belongs to the first of the runs that started at or after its
        loaded_at; a row that only shows up now though an earlier run would
        have been its own belongs to the first run of the pass. Rows loaded
        after the last run, or at a null time, wait.
        """
        log = self._log()
        done = {r for p in log for r in p["runs"]}
        runs = [r for r in runs if r[0] not in done]
        if not runs:
            return
        name = f"pass-{len(log):06d}"
        own = {c: source.schema[c].dataType.simpleString() for c in (*RECORD, "entry_id", "dt_date")}
        self._kinds = {**own, **dict.fromkeys(("loaded_us", "lo", "hi", "n", "mark"), "bigint"), "run_no": "int", "taken": "boolean"}
        moment = lambda us: F.timestamp_micros(F.lit(us)).cast(source.schema["loaded_at"].dataType)
        rows = source.select(*RECORD, "entry_id", "loaded_at", "dt_date").filter(F.col("loaded_at") <= moment(runs[-1][1])).withColumn("loaded_us", F.unix_micros(F.col("loaded_at").cast("timestamp")))
        # Counted before the rows are read: what comes between the two is found by the next pass.
        counts = (F.min("loaded_us").alias("lo"), F.max("loaded_us").alias("hi"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("seq_no", "entry_id", "loaded_us")).alias("mark"))
        rows.groupBy("version_id").agg(*counts).write.mode("overwrite").parquet(f"{self.path}/transactions/{name}")
        if log:
            still = self._open(name, log[-1])
            low = still.agg(F.min("lo")).first()[0]
            low = runs[-1][1] if low is None else low
            of_open = lambda frame: frame.join(still.select(F.col("version_id").alias("o_version_id")), F.col("version_id").eqNullSafe(F.col("o_version_id")), "left_semi")
            rows = of_open(rows.filter(F.col("loaded_at") >= moment(low)))
            seen = self._read("seen", [p for p in log if p["until"] >= low])
            if seen is not None:
                seen = of_open(seen.filter(F.col("loaded_us") >= low)).select(*(F.col(c).alias(f"l_{c}") for c in (*RECORD, "entry_id", "loaded_us")))
                same = [F.col(c).eqNullSafe(F.col(f"l_{c}")) for c in (*RECORD, "entry_id", "loaded_us")]
                rows = rows.join(seen, same, "left_anti")
        rows = rows.select(*RECORD, "entry_id", "loaded_us", F.when(F.col("dt_date") != -1, F.col("dt_date")).alias("dt_date"), _run_of(F.col("loaded_us"), runs).cast("int").alias("run_no"))
        rows.write.mode("overwrite").parquet(f"{self.path}/seen/{name}")
        rows = self._read("seen", [{"dir": name}])

        last = Window.partitionBy(*RECORD, "run_no").orderBy(F.desc("loaded_us"), F.desc_nulls_last("entry_id"), F.desc_nulls_last("dt_date"))
        heads = rows.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n").withColumn("_old", F.lit(False))
        order = {r: k for k, (r, _) in enumerate(runs)}
        heads = heads.withColumn("_k", F.create_map(*(F.lit(x) for kv in order.items() for x in kv))[F.col("run_no")])
        earlier = self._earlier(log)
        if earlier is not None:
            keys = heads.select(*(F.col(c).alias(f"k_{c}") for c in RECORD)).distinct()
            known = _newest(earlier.join(keys, [F.col(c).eqNullSafe(F.col(f"k_{c}")) for c in RECORD], "left_semi"))
            heads = heads.unionByName(known.withColumns({"_old": F.lit(True), "_k": F.lit(-1)}))
        w = Window.partitionBy(*RECORD).orderBy("_k")
        first = F.row_number().over(w) == 1
        taken = first | ~F.col("dt_date").eqNullSafe(F.lag("dt_date").over(w))
        heads.withColumn("taken", taken).filter(~F.col("_old")).drop("_old", "_k").write.mode("overwrite").parquet(f"{self.path}/states/{name}")

        log.append({"dir": name, "runs": [r for r, _ in runs], "until": runs[-1][1], "counted": True, "kinds": self._kinds})
        if len(self._apart(log)) >= APART:
            _newest(self._earlier(log)).write.mode("overwrite").parquet(f"{self.path}/newest/{name}")
            log[-1]["newest"] = True
        write_text(self.spark, f"{self.path}/commits.json", json.dumps(log))

    def _apart(self, log: list[dict]) -> list[dict]:
        """The passes since the last that wrote ``newest``."""
        return log[max((k + 1 for k, p in enumerate(log) if p.get("newest")), default=0) :]

    def _earlier(self, log: list[dict]) -> DataFrame | None:
        """States among which is the newest of each record: those merged last, and those of the passes since."""
        columns = (*RECORD, "entry_id", "loaded_us", "dt_date", "run_no")
        since = self._apart(log)
        merged = log[: len(log) - len(since)][-1:]
        parts = [x.select(*columns) for x in (self._read("newest", merged), self._read("states", since)) if x is not None]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]) if parts else None

    def _open(self, name: str, last: dict) -> DataFrame:
        """(version_id, lo) of the transactions counted in pass ``name`` that are open since the pass ``last``, with their first loading time; all of them if that one has no counts."""
        now = self._read("transactions", [{"dir": name}])
        if not last.get("counted"):
            return now.select("version_id", "lo")
        then = self._read("transactions", [last]).select(*(F.col(c).alias(f"t_{c}") for c in ("version_id", "hi", "n", "mark")))
        both = now.join(then, F.col("version_id").eqNullSafe(F.col("t_version_id")), "left")
        as_before = (F.col("n") == F.col("t_n")) & (F.col("mark") == F.col("t_mark")) & (F.col("t_hi") <= last["until"] - self.grace)
        return both.filter(~F.coalesce(as_before, F.lit(False))).select("version_id", "lo")

    def taken(self) -> DataFrame:
        """(run_no, entry_id) of all records taken so far."""
        log = self._log()
        if not log:
            return self.spark.createDataFrame([], "run_no int, entry_id bigint")
        return self._read("states", log).filter("taken").select(F.col("run_no").cast("int").alias("run_no"), "entry_id")


def incremental_takes(entries: DataFrame, runs: DataFrame, runs_per_pass: int = 32, ledger_path: str | None = None) -> DataFrame:
    """Replays the log of runs through a ledger, ``runs_per_pass`` due runs at a time; gives (run_no, entry_id).

    A run takes, of each record's rows that belong to it, the last loaded one
    (loaded_at, then entry_id) if no row of the record belongs to an earlier run
    or if its dt_date differs from that of the record's last loaded row in
    earlier runs (-1 and null are the same). Null record columns are values like
    any other; no successful run or no entries give no rows.
    """
    spark = entries.sparkSession
    ledger = ProcessedLedger(spark, ledger_path or scratch_path(spark, "ledger"))
    due = successful_runs(runs)
    for k in range(0, len(due), runs_per_pass):
        ledger.process(entries, due[k : k + runs_per_pass])
    return ledger.taken()
