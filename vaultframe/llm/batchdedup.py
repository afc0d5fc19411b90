"""New batches against all history: multi-key sorted-neighbourhood runs.

A file's content is its set of distinct fragments, each with its size as weight.
Two contents with at least ``percent`` of their united bytes in common share a
fragment near the beginning of a common order of all fragments: so each content
is entered once for every fragment that it has before less than ``percent`` of its
bytes remain. The entries of a batch become a run: ranges of the key, sorted within.
New entries are merged with the ranges of the runs that they fall into, and meet
only their window, the neighbours of equal key of which enough bytes remain for the
pair to be a case. The exact comparison of the two sets follows.

The order puts fragments last that many contents have, in levels by their number, so
that these open windows only for contents that consist of such fragments. When a
batch raises a fragment's level, the contents that have an entry under it are entered
anew. For the others nothing changes: the fragment lies behind all their entries
already, and moves further back. A fragment is raised when its number has grown
fourfold, so a content is entered anew a few times at most.

Files of one content are one class, entered once and kept as members. All tables are
in one folder with a manifest, which a later session opens.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vaultframe.session import read_text, scratch_path, write_text

#: Contents with at least so many per cent of their united bytes in common are a case.
PERCENT = 60
#: A fragment that more contents have is common; its level is raised each time their number has grown by this factor.
COMMON, GROWTH = 64, 4
#: Entries of a common fragment are parted by the size of their content, in steps of this ratio.
STEP = 1.25
#: Runs of a table are merged when there are more: the late ones, up to the first that is larger than all after it.
MOST_RUNS = 8
#: Rows that a range of a run is meant for, and the most bits of the key that choose it.
RANGE_ROWS, RANGE_BITS = 1 << 20, 16

_ZERO = b"\0" * 20


def weighted_fragments(files: DataFrame, fragments: DataFrame) -> DataFrame:
    """(file_id, batch_no, k, w): the distinct fragments behind each file's dt_ptr, by a 64-bit hash of their sha1 and size, with their bytes.

    Null or all-zero sha1, unknown (null, negative) sizes, pointers to no row and
    null ids are left out, and fragments of 0 bytes, which weigh nothing. A sha1
    with two sizes counts as two fragments. A repeated row adds nothing; a file in
    several batches belongs to the first, with the fragments of all its rows.
    """
    known = fragments.filter((F.col("ht_usize") > 0) & F.col("ht_sha1").isNotNull() & (F.col("ht_sha1") != F.lit(_ZERO)))
    known = known.select("frag_id", F.xxhash64("ht_sha1", F.col("ht_usize").cast("bigint")).alias("k"), F.col("ht_usize").cast("bigint").alias("w"))
    pointers = files.filter("file_id is not null and batch_no is not null").select("file_id", "batch_no", F.explode(F.array_distinct("dt_ptr")).alias("frag_id"))
    rows = pointers.join(known, "frag_id").repartition("file_id").groupBy("file_id", "k", "w").agg(F.min("batch_no").alias("batch_no"))
    return rows.withColumn("batch_no", F.min("batch_no").over(Window.partitionBy("file_id")))


class Runs:
    """The runs of one table in the folder of a history. ``key``: a hashed column; its upper bits are the range, a folder of its own with one sorted file."""

    def __init__(self, history: History, name: str, key: str, schema: str):
        self.history, self.name, self.key, self.schema = history, name, key, schema

    @property
    def listed(self) -> list[dict]:
        return self.history.state["runs"].setdefault(self.name, [])

    @property
    def ranged(self) -> bool:
        """Whether a run has more than one range, so that some can be passed over."""
        return any(r["bits"] for r in self.listed)

    def _range(self, bits: int) -> Column:
        return F.shiftrightunsigned(self.key, 64 - bits).cast("int") if bits else F.lit(0)

    def write(self, rows: DataFrame, number: str, most: int) -> DataFrame:
        """Writes rows, at most ``most``, as a run that counts once the history is committed."""
        bits = min(max(math.ceil(math.log2(max(most, 1) / RANGE_ROWS)), 0), RANGE_BITS)
        folder = f"{self.name}/{number}"
        ranged = rows.withColumn("range", self._range(bits)).repartition(1 << bits, "range").sortWithinPartitions("range", self.key)
        ranged.write.mode("overwrite").partitionBy("range").parquet(f"{self.history.path}/{folder}")
        ranges = self.history.ranges_in(folder) if bits else [0]
        self.listed.append({"dir": folder, "bits": bits, "rows": most, "ranges": ranges})
        return self.last()

    def last(self) -> DataFrame:
        return self._open([f"{self.listed[-1]['dir']}"])

    def _open(self, folders: list[str]) -> DataFrame:
        """The files of folders of runs or of ranges, in one scan."""
        if not folders:
            return self.history.spark.createDataFrame([], self.schema)
        reader = self.history.spark.read.schema(self.schema).option("recursiveFileLookup", "true")
        return reader.parquet(*(f"{self.history.path}/{f}" for f in folders))

    def read(self, keys: DataFrame | None = None, listed: list[dict] | None = None) -> DataFrame:
        """All runs, or those given, of each the ranges that the keys fall into; at most 2^RANGE_BITS numbers of ranges reach the driver."""
        listed = self.listed if listed is None else listed
        bits = max((r["bits"] for r in listed), default=0)
        if keys is None or not bits:
            return self._open([r["dir"] for r in listed])
        touched = {r[0] for r in keys.select(self._range(bits)).distinct().collect()}
        self.history.reads[self.name] = [len(touched), 1 << bits]
        folders = []
        for run in listed:
            mine = {r >> (bits - run["bits"]) for r in touched}
            folders += [f"{run['dir']}/range={r}" for r in sorted(mine & set(run["ranges"]))] if len(mine) < len(run["ranges"]) else [run["dir"]]
        return self._open(folders)

    def compact(self, number: str, merge=lambda rows: rows) -> list[str]:
        """Merges late runs if there are too many; gives the folders that are no longer used."""
        if len(self.listed) <= MOST_RUNS:
            return []
        sizes = [r["rows"] for r in self.listed]
        begin = next((k for k in range(len(sizes)) if sizes[k] <= sum(sizes[k + 1 :])), len(sizes) - 2)
        late = self.listed[begin:]
        rows = self._open([run["dir"] for run in late])
        del self.listed[begin:]
        self.write(merge(rows), f"{number}-merged", sum(r["rows"] for r in late))
        return [r["dir"] for r in late]


class History:
    """What was accepted so far, at ``path``; a new session opens it there and goes on. One writer at a time.

    ``members``: the files of each class; ``sets``: a class's fragments,
    a row each; ``counts``: how many classes have a fragment; ``entries``: the runs;
    ``cases``: pairs of classes, both ways round. A batch is committed by one file
    after all its tables; what a failed batch left is written over.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, percent: int = PERCENT):
        self.spark = spark
        self.path = (path or scratch_path(spark, "history")).rstrip("/")
        self.percent = percent
        self.state = self._committed()
        self.percent = self.state["percent"]
        self.reads: dict[str, list[int]] = {}
        self.members = Runs(self, "members", "c", "c bigint, total bigint, file_id bigint, batch_no int")
        self.sets = Runs(self, "sets", "c", "c bigint, total bigint, k bigint, w bigint")
        self.counts = Runs(self, "counts", "k", "k bigint, n bigint, before bigint")
        self.entries = Runs(self, "entries", "k", "k bigint, step int, rest bigint, c bigint, total bigint, fresh boolean")
        self.cases = Runs(self, "cases", "c", "c bigint, d bigint")

    def _committed(self) -> dict:
        return json.loads(read_text(self.spark, f"{self.path}/manifest.json") or "null") or {"percent": self.percent, "batches": [], "runs": {}}

    def _folder(self, name: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def ranges_in(self, name: str) -> list[int]:
        """Numbers of the ranges that a run has rows in."""
        target, fs = self._folder(name)
        names = (f.getPath().getName() for f in fs.listStatus(target))
        return sorted(int(n[6:]) for n in names if n.startswith("range="))

    @property
    def batches(self) -> list[int]:
        return [b["batch_no"] for b in self.state["batches"]]

    @staticmethod
    def _level(n: Column) -> Column:
        return F.when(n <= COMMON, 0).otherwise(1 + F.floor(F.log(n / COMMON) / math.log(GROWTH))).cast("int")

    @staticmethod
    def _step(total: Column) -> Column:
        return (1 + F.floor(F.log(F.greatest(total, F.lit(1.0))) / math.log(STEP))).cast("int")

    def _entered(self, sets: DataFrame, levels: DataFrame) -> DataFrame:
        """Entries of whole sets (c, total, k, w, fresh): a row for each fragment from which on at least ``percent`` of the bytes remain; ``step`` parts those of common fragments by the total, 0 for others."""
        rows = sets.join(levels, "k", "left").withColumn("level", F.coalesce("level", F.lit(0)))
        # What lies before is summed up row by row; a frame to the end would be summed up anew for each row.
        before = Window.partitionBy("c").orderBy("level", F.desc("w"), "k").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.withColumn("rest", F.col("total") - F.coalesce(F.sum("w").over(before), F.lit(0))).filter(100 * F.col("rest") >= self.percent * F.col("total"))
        step = F.when(F.col("level") == 0, 0).otherwise(self._step(F.col("total")))
        return rows.select("k", step.alias("step"), "rest", "c", "total", "fresh")

    def _probes(self, entries: DataFrame) -> DataFrame:
        """New entries, with one for each step in which partners can be: a pair has ``percent`` of its united bytes in common, which both rests must hold, so a partner's total lies between that share of its own and what its rest allows."""
        p, total, rest = self.percent, F.col("total"), F.col("rest")
        first = self._step(total * (p / 100 * (1 - 1e-9)))
        last = self._step(F.least(total * (100 / p), rest * ((100 + p) / p) - total) * (1 + 1e-9))
        steps = F.when(F.col("step") == 0, F.array(F.lit(0))).when(last >= first, F.sequence(first, last))
        return entries.filter("fresh").select("k", "rest", "c", "total", F.explode(steps).alias("step"))

    def _verified(self, candidates: DataFrame, sets: DataFrame) -> DataFrame:
        """Of pairs (c, d, total, dtotal) those whose sets have enough in common, fragment by fragment."""
        ours = candidates.join(sets.select("c", "k", "w"), "c")
        theirs = sets.select(F.col("c").alias("d"), "k")
        common = ours.join(theirs, ["d", "k"]).groupBy("c", "d", "total", "dtotal").agg(F.sum("w").alias("common"))
        return common.filter(100 * F.col("common") >= self.percent * (F.col("total") + F.col("dtotal") - F.col("common"))).select("c", "d")

    def accept(self, batch: DataFrame, batch_no: int, most: int | None = None) -> None:
        """Takes in a batch (file_id, k, w), a row for each fragment of a file; ``most``: their number, where it is known. Of its classes those not known are entered, and compared with the windows of all runs."""
        self.state = self._committed()
        if batch_no in self.batches:
            return
        number, enough = f"{len(self.batches):06d}", self.percent
        self.reads = {}
        rows = batch.select("file_id", "k", "w").repartition("file_id")
        most = batch.count() if most is None else most
        # Three sums that don't depend on an order, so that no set is gathered in one cell.
        marks = (F.bit_xor(F.xxhash64("k")), F.bit_xor(F.xxhash64("k", F.lit(1))), F.count("*"))
        files = rows.groupBy("file_id").agg(F.sum("w").alias("total"), *(m.alias(f"m{i}") for i, m in enumerate(marks)))
        earlier, held = self.members.listed[:], bool(self.sets.listed)
        files = self.members.write(files.select(F.xxhash64("m0", "m1", "m2", "total").alias("c"), "total", "file_id", F.lit(batch_no).alias("batch_no")), number, most)
        known = self.members.read(files, earlier)
        one = files.groupBy("c").agg(F.min_by("total", "file_id").alias("total"), F.min("file_id").alias("file_id"))
        new = one.join(known.select("c"), "c", "left_anti")
        fresh = self.sets.write(rows.join(new, "file_id").select("c", "total", "k", "w"), number, most)

        # The run of counts also holds how many classes had the fragment before it.
        before = self.counts.read(fresh).groupBy("k").agg(F.sum("n").alias("before"))
        mine = fresh.groupBy("k").agg(F.count("*").alias("n")).join(before, "k", "left")
        mine = self.counts.write(mine.select("k", "n", F.coalesce("before", F.lit(0)).alias("before")), number, most)
        levels = mine.select("k", self._level(F.col("n") + F.col("before")).alias("level"), self._level(F.col("before")).alias("was"), "before").filter("level > 0")
        sets = fresh.withColumn("fresh", F.lit(True))
        raised = levels.filter("level > was and before > 0").select("k")
        again = 0
        if held and raised.count():
            # Classes that have an entry under a fragment that was raised; they hold it in at most COMMON or GROWTH times as many entries as when it was raised last.
            of = self.entries.read(raised).join(raised, "k", "left_semi").select("c").distinct()
            of.write.mode("overwrite").parquet(f"{self.path}/again/{number}")
            of = self.spark.read.schema("c bigint").parquet(f"{self.path}/again/{number}")
            old = self.sets.read(of).join(of, "c", "left_semi").withColumn("fresh", F.lit(False))
            old.write.mode("overwrite").parquet(f"{self.path}/old/{number}")
            old = self.spark.read.schema("c bigint, total bigint, k bigint, w bigint, fresh boolean").parquet(f"{self.path}/old/{number}")
            again = old.count()
            ks = old.select("k").distinct()
            all_counts = self.counts.read(ks).join(ks, "k", "left_semi").groupBy("k").agg(F.sum("n").alias("n"))
            levels = levels.select("k", "level").unionByName(all_counts.select("k", self._level(F.col("n")).alias("level")).filter("level > 0")).distinct()
            sets = sets.unionByName(old)
        entered = self.entries.write(self._entered(sets, levels.select("k", "level")), number, most + again)

        probes = self._probes(entered)
        other = self.entries.read(fresh).select("k", "step", F.col("rest").alias("drest"), F.col("c").alias("d"), F.col("total").alias("dtotal"))
        near = (100 + enough) * F.least("rest", "drest") >= enough * (F.col("total") + F.col("dtotal"))
        found = probes.join(other, ["k", "step"]).filter(near & (F.col("c") != F.col("d")))
        # Of two new classes each finds the other, so one way round is enough.
        lower = F.col("c") < F.col("d")
        ends = [F.when(lower, F.col(a)).otherwise(F.col(b)).alias(n) for n, a, b in (("c", "c", "d"), ("d", "d", "c"), ("total", "total", "dtotal"), ("dtotal", "dtotal", "total"))]
        candidates, ends = found.select(*ends).distinct(), None
        if self.sets.ranged:
            candidates.write.mode("overwrite").parquet(f"{self.path}/candidates/{number}")
            candidates = self.spark.read.schema("c bigint, d bigint, total bigint, dtotal bigint").parquet(f"{self.path}/candidates/{number}")
            ends = candidates.select("c").unionByName(candidates.select(F.col("d").alias("c")))
        pairs = self._verified(candidates, self.sets.read(ends))
        pairs = pairs.select(F.explode(F.array(F.struct("c", "d"), F.struct(F.col("d").alias("c"), F.col("c").alias("d")))).alias("p")).select("p.c", "p.d")
        self.cases.write(pairs, number, most)
        self._commit(batch_no, number, {"rows": most, "entered_again": again, "ranges_read": dict(self.reads)})

    def _commit(self, batch_no: int, number: str, figures: dict) -> None:
        summed = lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n")).withColumn("before", F.lit(0).cast("bigint"))
        unused = [f"{t}/{number}" for t in ("again", "old", "candidates")]
        for table in (self.members, self.sets, self.counts, self.entries, self.cases):
            unused += table.compact(number, summed) if table is self.counts else table.compact(number)
        self.state["batches"].append({"batch_no": batch_no, **figures})
        write_text(self.spark, f"{self.path}/manifest.json", json.dumps(self.state))
        for folder in unused:
            target, fs = self._folder(folder)
            fs.delete(target, True)

    def pairs(self, batches: list[int]) -> DataFrame:
        """(file_a, file_b): the cases of the given batches against what came before each file, with all members of the classes; as large as its result."""
        alike = self.cases.read().unionByName(self.members.read().select("c", F.col("c").alias("d")).distinct())
        members = self.members.read()
        mine = members.filter(F.col("batch_no").isin(batches)).select("c", F.col("file_id").alias("x"), F.col("batch_no").alias("x_batch"))
        theirs = members.select(F.col("c").alias("d"), F.col("file_id").alias("y"), F.col("batch_no").alias("y_batch"))
        pairs = mine.join(alike, "c").join(theirs, "d").filter("y_batch < x_batch or (y_batch = x_batch and y < x)")
        return pairs.select(F.least("x", "y").alias("file_a"), F.greatest("x", "y").alias("file_b"))

    def links(self) -> DataFrame:
        """(file_id, class_id, n_links): every file with the smallest file_id of its class, and the number of other classes that are cases with it."""
        links = self.cases.read().groupBy("c").agg(F.count("*").alias("n_links"))
        first = self.members.read().groupBy("c").agg(F.min("file_id").alias("class_id"))
        classes = first.join(links, "c", "left").select("c", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
        return self.members.read().join(classes, "c").select("file_id", "class_id", "n_links")

    def class_pairs(self) -> DataFrame:
        """(class_a, class_b): the cases between classes, each named by its smallest file_id; :meth:`links` has the members."""
        first = self.members.read().groupBy("c").agg(F.min("file_id").alias("f"))
        rows = self.cases.read().join(first.select("c", F.col("f").alias("class_a")), "c").join(first.select(F.col("c").alias("d"), F.col("f").alias("class_b")), "d")
        return rows.filter("class_a < class_b").select("class_a", "class_b")


def accepted(files: DataFrame, fragments: DataFrame, percent: int = PERCENT, path: str | None = None) -> tuple[History, list[int]]:
    """A history that has taken all batches in order of batch_no, 0 and lower ones first as what was accepted before; and the numbers of the later ones.

    Batches that the history has already aren't taken again. The fragments behind
    all files are looked up once.
    """
    spark = files.sparkSession
    at = scratch_path(spark, "file-fragments")
    history = History(spark, path, percent)
    done = [n for n in history.batches if n > 0]
    if history.batches:
        files = files.filter((F.col("batch_no") > 0) & ~F.col("batch_no").isin(done))
    weighted_fragments(files, fragments).write.partitionBy("batch_no").parquet(at)
    weighted = spark.read.schema("file_id bigint, k bigint, w bigint, batch_no int").parquet(at)
    sizes = {r["batch_no"]: r["count"] for r in weighted.groupBy("batch_no").count().collect()}
    if any(n <= 0 for n in sizes):
        history.accept(weighted.filter("batch_no <= 0"), 0, sum(c for n, c in sizes.items() if n <= 0))
    later = sorted(n for n in sizes if n > 0)
    for n in later:
        history.accept(weighted.filter(F.col("batch_no") == n), n, sizes[n])
    return history, sorted({*done, *later})


def repeated_files(files: DataFrame, fragments: DataFrame, percent: int = PERCENT, path: str | None = None) -> DataFrame:
    """(file_a, file_b), file_a < file_b: cases of each batch >= 1 against all before it and within itself. Empty tables give no pairs."""
    history, later = accepted(files, fragments, percent, path)
    return history.pairs(later) if later else files.sparkSession.createDataFrame([], "file_a bigint, file_b bigint")
