"""What changed between consecutive full listings, by merging sorted ranges of kept snapshots."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vaultframe.session import read_text, scratch_path, write_text

#: Lines of the largest listing that a range is meant for when a store is made, and the most bits of the hashed path that choose it.
RANGE_LINES, RANGE_BITS = 1 << 16, 20
#: Listings whose numbers are broadcast to their lines; more are joined by an exchange.
BROADCAST_LISTINGS = 500_000

_CHAIN = "delivery_id bigint, root_id int, snap_no int, prev_id bigint, fresh boolean"
#: What is exchanged: cell: root and range; place: twice the snap_no, one more for a line. The first row of a listing in a cell has the listing's numbers: h: its delivery, row_no: snap_no, dt_date: the delivery that it is to be compared with, dt_size: whether it is new.
_ROW = ("cell", "place", "h", "dt_path", "row_no", "dt_date", "dt_size")
_MADE = "root_id int, range int, snap_no int, delivery_id bigint, prev_id bigint, dt_path string, mark string, old_date bigint, new_date bigint, old_size bigint, new_size bigint"
#: Of several lines for a path the first in this order counts.
_BEST = ("row_no", "dt_date", "dt_size")


def valid_deliveries(deliveries: DataFrame) -> DataFrame:
    """The delivery that counts for each (root_id, snap_no), with ``prev_id``, that of the next smaller snap_no of its root.

    Complete deliveries only; of several the one with the latest delivered_at,
    then the largest delivery_id. Rows with a null root, number or id don't count.
    """
    whole = deliveries.filter((F.col("delivery_status") == "complete") & F.col("root_id").isNotNull() & F.col("snap_no").isNotNull() & F.col("delivery_id").isNotNull())
    latest = Window.partitionBy("root_id", "snap_no").orderBy(F.desc_nulls_last("delivered_at"), F.desc("delivery_id"))
    one = whole.withColumn("_n", F.row_number().over(latest)).filter("_n = 1")
    along = Window.partitionBy("root_id").orderBy("snap_no")
    return one.select("delivery_id", F.col("root_id").cast("int").alias("root_id"), F.col("snap_no").cast("int").alias("snap_no"), F.lag("delivery_id").over(along).alias("prev_id"))


def _combined(lines: DataFrame) -> DataFrame:
    """The lines without those of which their own Arrow batch has a better one for the path, so that a path listed very often is exchanged once a batch."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            if rows.num_rows and rows.group_by(["delivery_id", "dt_path"]).aggregate([]).num_rows < rows.num_rows:
                rows = rows.take(pc.sort_indices(rows, sort_keys=[("delivery_id", "ascending"), ("dt_path", "ascending"), *((c, "descending") for c in _BEST)])).combine_chunks()
                again = np.ones(rows.num_rows, bool)
                again[0] = False
                for c in ("delivery_id", "dt_path"):
                    again[1:] &= pc.equal(rows.column(c)[1:], rows.column(c)[:-1]).to_numpy()
                rows = rows.filter(pa.array(~again))
            yield from rows.to_batches()

    return lines.mapInArrow(run, lines.schema)


class _Listing:
    """One listing of a root in one range, sorted by (h, path); gathered batch by batch."""

    def __init__(self, row: dict):
        self.row, self.parts = row, []

    def close(self) -> _Listing:
        """The lines as arrays; of several lines for a path the first."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        kinds = pa.schema([("h", pa.int64()), ("dt_path", pa.string()), ("dt_date", pa.int64()), ("dt_size", pa.int64())])
        lines = pa.Table.from_batches(self.parts, kinds if not self.parts else None).combine_chunks()
        h, path = lines.column("h").to_numpy(), lines.column("dt_path").combine_chunks()
        near = np.flatnonzero(h[1:] == h[:-1])
        near = near[:0] if not len(near) else near[pc.equal(path.take(pa.array(near + 1)), path.take(pa.array(near))).to_numpy(zero_copy_only=False)]
        if len(near):
            keep = np.ones(len(h), bool)
            keep[near + 1] = False
            lines = lines.filter(pa.array(keep)).combine_chunks()
        self.h, self.cols = lines.column("h").to_numpy(), {c: lines.column(c).combine_chunks() for c in ("dt_path", "dt_date", "dt_size")}
        return self

    def take(self, column: str, at):
        import pyarrow as pa

        return self.cols[column].take(pa.array(at, pa.int64()))


def _side_by_side(old: _Listing, new: _Listing):
    """Places of the same path in two sorted listings, by one pass over both: the sort of two sorted runs that are put one after the other only merges them."""
    import numpy as np
    import pyarrow.compute as pc

    n = len(old.h)
    if not n or not len(new.h):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    key = np.concatenate((old.h, new.h))
    order = np.argsort(key, kind="stable")
    key = key[order]
    begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((begin, [len(key)])))
    pairs = begin[(size == 2) & (order[begin] < n) & (order[np.minimum(begin + 1, len(key) - 1)] >= n)]
    i, j = order[pairs], order[pairs + 1] - n
    same = pc.equal(old.take("dt_path", i), new.take("dt_path", j)).to_numpy(zero_copy_only=False)
    i, j = i[same], j[same]
    # Different paths of one hash within a listing: those of a hash are compared with each other.
    for g in np.flatnonzero(size > 2).tolist():
        at = order[begin[g] : begin[g] + size[g]]
        ours = dict(zip(old.take("dt_path", at[at < n]).to_pylist(), at[at < n].tolist()))
        theirs = dict(zip(new.take("dt_path", at[at >= n] - n).to_pylist(), (at[at >= n] - n).tolist()))
        both = [p for p in ours if p in theirs]
        i, j = np.append(i, np.array([ours[p] for p in both], np.int64)), np.append(j, np.array([theirs[p] for p in both], np.int64))
    return i, j


def _changes(old: _Listing, new: _Listing):
    """Typed changes from one listing to the next."""
    import numpy as np
    import pyarrow.compute as pc

    i, j = _side_by_side(old, new)
    differs = np.zeros(len(i), bool)
    for c in ("dt_date", "dt_size") if len(i) else ():
        differs |= pc.fill_null(pc.not_equal(old.take(c, i), new.take(c, j)), False).to_numpy(zero_copy_only=False)
    gone, come = np.setdiff1d(np.arange(len(old.h)), i), np.setdiff1d(np.arange(len(new.h)), j)
    for mark, a, b in (("-", gone, None), ("+", None, come), ("#", i[differs], j[differs])):
        if len(a if a is not None else b):
            yield _made("change", new.row, mark, (old, a), (new, b))


def _made(kind: str, row: dict, mark: str | None, old, new):
    """A batch of the merge's output from the lines at some places of an old and a new listing."""
    import pyarrow as pa

    (here, at) = new if new[1] is not None else old
    size = len(at)
    value = lambda side, c: pa.nulls(size, pa.int64()) if side[1] is None else side[0].take(c, side[1])
    fixed = [pa.array([row[c]] * size, t) for c, t in (("root_id", pa.int32()), ("range", pa.int32()), ("snap_no", pa.int32()), ("delivery_id", pa.int64()), ("prev_id", pa.int64()))]
    cols = [*fixed, here.take("dt_path", at), pa.array([mark] * size, pa.string()), value(old, "dt_date"), value(new, "dt_date"), value(old, "dt_size"), value(new, "dt_size"), pa.array([kind] * size, pa.string())]
    return pa.RecordBatch.from_arrays(cols, [*(x.split()[0] for x in _MADE.split(", ")), "kind"])


def _merged(bits: int):
    """The merge of one partition of sorted rows: changes, and the new listings as they are to be kept. Two listings of a cell are held at a time."""

    def end(listing, before):
        import numpy as np

        listing.close()
        row = listing.row
        if row["prev_id"] is not None:
            yield from _changes(before, listing)
        if row["fresh"] and len(listing.h):
            yield _made("kept", row, None, (None, None), (listing, np.arange(len(listing.h))))

    def run(batches):
        import numpy as np

        last, open_ = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "place"))
            edges = np.flatnonzero(np.concatenate(([True], (cell[1:] != cell[:-1]) | (place[1:] != place[:-1]), [True])))
            for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
                if place[lo] % 2:
                    open_.parts.append(batch.slice(lo, hi - lo).select(["h", "dt_path", "dt_date", "dt_size"]))
                    continue
                if open_ is not None:
                    yield from end(open_, last)
                last = open_
                at = int(cell[lo])
                numbers = (batch.column(c)[lo].as_py() for c in ("h", "row_no", "dt_date", "dt_size"))
                open_ = _Listing({"root_id": at >> bits, "range": at & (1 << bits) - 1, **dict(zip(("delivery_id", "snap_no", "prev_id", "fresh"), numbers))})
        if open_ is not None:
            yield from end(open_, last)

    return run


class SnapshotStore:
    """Snapshots kept in ranges of the hashed path, sorted within, in a folder that all executors share.

    An intake exchanges the lines of new listings once, by root and range, together
    with the kept ranges of the listings next to them, merges each with the one
    before it, and keeps it. A delivery that comes late, between two kept ones, or
    that takes the place of another is merged with its neighbours in the same way;
    changes between listings that are no longer neighbours don't count any more. An
    intake is committed by one file, after its tables. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _head(self) -> dict:
        return json.loads(read_text(self.spark, f"{self.path}/intakes.json") or '{"intakes": 0}')

    def _chain(self, numbers) -> DataFrame:
        return self.spark.read.schema(_CHAIN).parquet(*(f"{self.path}/chain/{k:06d}" for k in numbers))

    def _made(self, kind: str, numbers) -> DataFrame:
        return self.spark.read.schema(f"{_MADE}, kind string").option("basePath", f"{self.path}/merged").parquet(*(f"{self.path}/merged/intake={k}" for k in numbers)).filter(F.col("kind") == kind)

    def accept(self, snapshots: DataFrame, deliveries: DataFrame) -> None:
        """Takes in the listings of valid deliveries that aren't kept yet. ``deliveries``: the whole log; ``snapshots``: at least the lines of the new ones.

        Of several lines for a path the one with the largest row_no counts, of equal
        ones that of the largest date, then size; nulls come last. Lines with a null
        path don't count. -1 becomes null.
        """
        head = self._head()
        number = head["intakes"]
        if "bits" not in head:
            largest = snapshots.groupBy("delivery_id").count().agg(F.max("count")).first()[0] or 1
            head["bits"] = min(max(math.ceil(math.log2(largest / RANGE_LINES)), 0), RANGE_BITS)
        valid = valid_deliveries(deliveries)
        if number:
            before = self._chain(range(number))
            known = before.filter("fresh").select("delivery_id").distinct().withColumn("fresh", F.lit(False))
            valid = valid.join(known, "delivery_id", "left").withColumn("fresh", F.coalesce("fresh", F.lit(True)))
        else:
            valid = valid.withColumn("fresh", F.lit(True))
        valid.select(*(x.split()[0] for x in _CHAIN.split(", "))).write.mode("overwrite").parquet(f"{self.path}/chain/{number:06d}")
        chain = self._chain([number])
        pairs = chain.filter("prev_id is not null").select("delivery_id", "prev_id", "snap_no")
        if number:
            pairs = pairs.join(before.select("delivery_id", "prev_id").distinct(), ["delivery_id", "prev_id"], "left_anti")
        # What is to be merged now, one row a listing: what is new, what it is compared with, and what was compared with another one so far.
        todo = chain.drop("prev_id").join(pairs.select("delivery_id", "prev_id"), "delivery_id", "left")
        former = pairs.select(F.col("prev_id").alias("delivery_id"), F.lit(True).alias("former"))
        todo = todo.join(former, "delivery_id", "left").filter("fresh or former or prev_id is not null").drop("former")

        bits = head["bits"]
        date, size = (F.when(F.col(c) != -1, F.col(c)).cast("bigint").alias(c) for c in ("dt_date", "dt_size"))
        lines = snapshots.filter(F.col("dt_path").isNotNull()).select("delivery_id", "dt_path", F.col("row_no").cast("int").alias("row_no"), date, size)
        numbered = todo.select("delivery_id", "fresh", (F.col("root_id").cast("bigint") * (1 << bits)).alias("cell"), (F.col("snap_no").cast("bigint") * 2).alias("place"))
        if chain.count() <= BROADCAST_LISTINGS:
            numbered = F.broadcast(numbered)
        h = F.xxhash64("dt_path")
        of_range = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0)

        def placed(rows):
            return rows.withColumn("h", h).select((F.col("cell") + of_range).alias("cell"), (F.col("place") + 1).alias("place"), *_ROW[2:])

        rows = placed(_combined(lines.join(numbered.filter("fresh"), "delivery_id").drop("fresh")))
        if number:
            kept = self._made("kept", range(number)).select("delivery_id", "dt_path", F.lit(0).alias("row_no"), F.col("new_date").alias("dt_date"), F.col("new_size").alias("dt_size"))
            rows = rows.unionByName(placed(kept.join(numbered.filter("not fresh"), "delivery_id")))
        cells = F.explode(F.sequence(F.lit(0), F.lit((1 << bits) - 1))).alias("range")
        heads = todo.select("*", cells).select((F.col("root_id").cast("bigint") * (1 << bits) + F.col("range")).alias("cell"), (F.col("snap_no").cast("bigint") * 2).alias("place"), F.col("delivery_id").alias("h"), F.lit(None).cast("string").alias("dt_path"), F.col("snap_no").alias("row_no"), F.col("prev_id").alias("dt_date"), F.col("fresh").cast("bigint").alias("dt_size"))
        ordered = rows.unionByName(heads).repartition("cell").sortWithinPartitions("cell", "place", "h", "dt_path", *(F.desc(c) for c in _BEST))
        merged = ordered.mapInArrow(_merged(bits), f"{_MADE}, kind string")
        merged.write.mode("overwrite").partitionBy("kind").parquet(f"{self.path}/merged/intake={number}")
        write_text(self.spark, f"{self.path}/intakes.json", json.dumps({**head, "intakes": number + 1}))

    def changes(self) -> DataFrame:
        """(root_id, snap_no, dt_path, mark, old_date, new_date, old_size, new_size) between all neighbouring listings as they are now."""
        n = self._head()["intakes"]
        rows = self._made("change", range(n))
        if n > 1:
            rows = rows.join(self._chain([n - 1]).select("delivery_id", "prev_id"), ["delivery_id", "prev_id"], "left_semi")
        return rows.select("root_id", "snap_no", "dt_path", "mark", "old_date", "new_date", "old_size", "new_size")


def snapshot_changes(snapshots: DataFrame, deliveries: DataFrame, path: str | None = None) -> DataFrame:
    """Typed changes of each listing against the one before it in its root, from a store that takes what isn't kept yet.

    A path only in the later one was added (``+``), one only in the earlier one
    removed (``-``), one in both whose date or size is recorded on both sides and
    different changed (``#``). The first listing of a root has no rows. A root with
    most of the lines is split by its ranges.
    """
    spark = snapshots.sparkSession
    store = SnapshotStore(spark, path or scratch_path(spark, "snapshots"))
    store.accept(snapshots, deliveries)
    return store.changes()
