"""A versioned, deduplicating store of files in Parquet tables, with time travel.

Below one folder: ``fragments``, ``blocks`` and ``entries``, each with a directory
for every version, and ``commits.json``, the list of committed versions, as the latest of some
numbered files (see :func:`vaultframe.session.write_text`). It is written last, so a
version that failed before that is invisible, and its directories are overwritten by
the next one. One writer at a time.

Columns: files (dt_path, dt_date, dt_size, dt_attr, content); entries (dt_path,
dt_date, dt_size, dt_attr, dt_ptr; dt_date 0 is a delete); fragments (frag_id, ht_sha1,
ht_usize, block_id, pos_in_block, block_offset); blocks (block_id, frags, usize,
bsize, method, payload).
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vaultframe.functions import codecs, crypto, paths
from vaultframe.functions.dates import LAST_VERSION
from vaultframe.operators import chunk, compare, packing, rollup
from vaultframe.session import read_text, scratch_path, write_text

ENTRIES = "dt_path string, dt_date bigint, dt_size bigint, dt_attr bigint, dt_ptr array<bigint>, version_no int"
FRAGMENTS = "frag_id bigint, ht_sha1 binary, ht_usize bigint, block_id bigint, pos_in_block int, block_offset bigint, version_no int"
BLOCKS = "block_id bigint, frags bigint, usize bigint, bsize bigint, method string, payload binary, version_no int"
KEYS = ("dt_path",)
LEVELS = ("0", "1", "2", "3", "4", "5")


def slices(blobs: DataFrame, parts: DataFrame, key: str, blob: str, off: str, length: str, into: str) -> DataFrame:
    """The rows of ``parts``, each with its slice of the blob of its key; null where the blob is null or missing.

    The parts of a blob are brought together as one list, so that a blob is read
    once and never copied for each of its parts.
    """
    kept = [f for f in parts.schema if f.name != key]
    lists = parts.groupBy(key).agg(F.collect_list(F.struct(*(f.name for f in kept))).alias("_parts"))
    rows = lists.join(blobs.select(key, F.col(blob).alias("_blob")), key, "left").select(key, "_blob", "_parts")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                data, part = batch.column(1)[k].as_py(), batch.column(2)[k].values
                begin, size = part.field(off).to_pylist(), part.field(length).to_pylist()
                cut = pa.array([None if data is None else data[b : b + n] for b, n in zip(begin, size)], pa.binary())
                owner = batch.column(0).take(pa.array([k] * len(part), pa.int64()))
                yield pa.RecordBatch.from_arrays([owner, *(part.field(f.name) for f in kept), cut], [key, *(f.name for f in kept), into])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(run, f"`{key}` {parts.schema[key].dataType.simpleString()}, {kinds}, `{into}` binary")


def joined(pieces: DataFrame) -> DataFrame:
    """(dt_path, whole, good): the pieces of each file in order of pos as one content, and how many of them are right."""
    lists = pieces.groupBy("dt_path").agg(F.sort_array(F.collect_list(F.struct("pos", "p", "ok"))).alias("s"))
    rows = lists.select("dt_path", F.col("s.p").alias("p"), F.size(F.filter("s", lambda x: x["ok"])).alias("good"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                whole = [b"".join(x or b"" for x in row) for row in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(whole, pa.binary()), part.column(2)], ["dt_path", "whole", "good"])

    return rows.mapInArrow(run, "dt_path string, whole binary, good int")


class VaultError(RuntimeError):
    """A rule of the store would be broken."""


@dataclass
class Selection:
    """Which paths an operation is about; see :func:`vaultframe.functions.paths.selected`."""

    files: Sequence[str] = ()
    only: Sequence[str] = ()
    exclude: Sequence[str] = ()
    rename_to: Sequence[str] = ()

    def of(self, frame: DataFrame, renamed: bool = False) -> DataFrame:
        return frame.filter(paths.selected(F.col("dt_path"), self.files, self.only, self.exclude, self.rename_to, renamed))


class Vault:
    """Store at ``path``; with a password its payloads are encrypted.

    ``method``: of all blocks, or a level 0 to 5 by which each block gets its own from
    what its pieces are like. ``block_size``: bytes of fragments in a block, by default
    16 MiB, at levels from 2 on 64 MiB. ``fixed``: pieces of so many bytes instead of
    content-defined ones, which need no look at the content; a level then takes
    all for data that nothing is known of.
    """

    def __init__(self, spark: SparkSession, path: str, password: str | None = None, fragment: int = 6, method: str = "zstd", block_size: int | None = None, fixed: int | None = None):
        if not 0 <= fragment <= 16:
            raise VaultError("the size of fragments is 0 to 16")
        if method not in LEVELS:
            codecs.parse_method(method)
        if block_size is None:
            block_size = 1 << 26 if method in LEVELS[2:] else 1 << 24
        self.spark, self.path = spark, path.rstrip("/")
        self.fragment, self.method, self.block_size, self.fixed = fragment, method, block_size, fixed
        head = json.loads(read_text(spark, f"{self.path}/head.json") or "null")
        if head is None:
            head = {"salt": crypto.new_salt().hex() if password is not None else None}
            if password is not None:
                head["check"] = crypto.ctr_slice(b"vault", crypto.stretch_key(password, bytes.fromhex(head["salt"])), bytes.fromhex(head["salt"])).hex()
            write_text(spark, f"{self.path}/head.json", json.dumps(head))
        self.key = None
        if head["salt"] is not None:
            salt = bytes.fromhex(head["salt"])
            self.key = crypto.stretch_key(password or "", salt)
            if crypto.ctr_slice(bytes.fromhex(head["check"]), self.key, salt) != b"vault":
                raise VaultError("the password is another")

    def versions(self) -> list[dict]:
        """Committed versions: version_no, date, updates, deletes, frags, bsize, last_frag, last_block, tables."""
        return json.loads(read_text(self.spark, f"{self.path}/commits.json") or "[]")

    def cut(self, until: int | None = None) -> list[dict]:
        """Versions up to a number, a date, or so many before the last: those before the first that lies beyond."""
        log = self.versions()
        if until is None:
            return log
        if until < 0:
            return log[: max(len(log) + until, 0)]
        out = []
        for v in log:
            if (v["version_no"] > until) if until <= LAST_VERSION else (v["date"] > until):
                break
            out.append(v)
        return out

    def _read(self, name: str, schema: str, log: list[dict]) -> DataFrame:
        dirs = [f"{self.path}/{name}/version_no={v['version_no']}" for v in log if name in v["tables"]]
        if not dirs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*dirs)

    def entries(self, until: int | None = None) -> DataFrame:
        return self._read("entries", ENTRIES, self.cut(until))

    def fragments(self, until: int | None = None) -> DataFrame:
        return self._read("fragments", FRAGMENTS, self.cut(until))

    def blocks(self, until: int | None = None) -> DataFrame:
        return self._read("blocks", BLOCKS, self.cut(until))

    def snapshot(self, until: int | None = None, select: Selection = Selection(), deleted: bool = False) -> DataFrame:
        """The last entry of each path; deleted ones only where asked for."""
        newest = Window.partitionBy("dt_path").orderBy(F.desc("version_no"))
        rows = select.of(self.entries(until)).withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
        return rows if deleted else rows.filter("dt_date is null or dt_date <> 0")

    def all_versions(self, until: int | None = None, width: int = 4, select: Selection = Selection()) -> DataFrame:
        """Every entry as ``NNNN/path``; deleted ones with a blank date."""
        n = F.col("version_no").cast("string")
        prefix = F.when(F.length(n) < width, F.lpad(n, width, "0")).otherwise(n)
        return select.of(self.entries(until)).withColumn("dt_path", F.concat(prefix, F.lit("/"), "dt_path"))

    def list(self, files: DataFrame | None = None, until: int | None = None, select: Selection = Selection(), force: bool = False, hide: str = "") -> DataFrame:
        """The snapshot, or its comparison with ``files``: by date, size and attr, or with ``force`` by content, for which the stored hashes are enough."""
        inside = self.snapshot(until, select)
        if files is None:
            return inside.select(F.lit("-").alias("mark"), *KEYS, *compare.VALUES)
        outside = self._renamed(select.of(files, False), select)
        if force:
            same = self._same_content(inside, outside, until)
            known = outside.join(same, "dt_path", "left_semi").select("dt_path")
            values = inside.join(known, "dt_path", "left_semi").select("dt_path", *compare.VALUES)
            outside = outside.join(known, "dt_path", "left_anti").select("dt_path", *compare.VALUES).unionByName(values)
            inside = inside.join(known, "dt_path", "left_semi").select("dt_path", *compare.VALUES).unionByName(inside.join(known, "dt_path", "left_anti").select("dt_path", F.lit(-2).cast("bigint").alias("dt_date"), "dt_size", "dt_attr"))
        return compare.compare(inside, outside, KEYS, hide)

    def _renamed(self, files: DataFrame, select: Selection) -> DataFrame:
        return files.withColumn("dt_path", paths.renamed(F.col("dt_path"), select.files, select.rename_to)) if select.rename_to else files

    def add(self, files: DataFrame, date: int | None = None, select: Selection = Selection(), force: bool = False, until: int | None = None, attributes: bool = True, keep_unreadable: Sequence[str] = (), index: Vault | None = None) -> dict:
        """Appends a version in which the selected paths are as in ``files``; gives its figures, with added and removed.

        Files of unchanged date and size aren't read unless ``force``. Stored paths
        that are selected but not in ``files`` are deleted, but for those named as
        unreadable. ``until`` drops the later versions first. ``index``: a copy without
        payloads that gets the version too. Nothing is written if nothing changed. Paths are unique; null paths are left out, of repeated
        ones the row of the latest date counts.
        """
        if until is not None:
            self.rollback(until)
        log = self.versions()
        number = (log[-1]["version_no"] if log else 0) + 1
        now = date or int(datetime.now(UTC).strftime("%Y%m%d%H%M%S"))
        if log and now <= log[-1]["date"]:
            last = datetime.strptime(str(log[-1]["date"]), "%Y%m%d%H%M%S").replace(tzinfo=UTC) + timedelta(seconds=1)
            now = int(last.strftime("%Y%m%d%H%M%S"))
        one = Window.partitionBy("dt_path").orderBy(F.desc_nulls_last("dt_date"), F.desc_nulls_last("dt_size"))
        outside = self._renamed(select.of(files.filter("dt_path is not null")), select).withColumn("_n", F.row_number().over(one)).filter("_n = 1").drop("_n")
        if not attributes:
            outside = outside.withColumn("dt_attr", F.lit(0).cast("bigint"))
        stored = Selection(select.files, select.only, select.exclude, select.rename_to)
        inside = stored.of(self.snapshot(), True) if not (select.rename_to and not select.files) else self.snapshot()
        work = scratch_path(self.spark, "vault-add")

        read = compare.needs_reading(inside, outside, force, KEYS).select("dt_path")
        changed = outside.join(read, "dt_path", "left_semi")
        if self.fixed:
            pieces = chunk.chunk_fixed(changed, "dt_path", "content", self.fixed).withColumn("sha1", F.unhex("sha1"))
            pieces = pieces.withColumns({"redundancy": F.shiftright("len", 2), "is_text": F.lit(False), "is_code": F.lit(False)})
        else:
            pieces = chunk.chunk_content(changed, "dt_path", "content", self.fragment)
        rank = outside.select("dt_path", paths.extension_key(F.col("dt_path")).alias("ext"), (-F.shiftright(F.coalesce("dt_size", F.lit(0)), 14)).alias("bucket"))
        pieces.join(rank, "dt_path").withColumnRenamed("sha1", "ht_sha1").withColumnRenamed("len", "ht_usize").write.parquet(f"{work}/pieces")
        pieces = self.spark.read.parquet(f"{work}/pieces")

        order = ["ext", "bucket", "dt_path", "pos"]
        last_frag, last_block = (log[-1]["last_frag"], log[-1]["last_block"]) if log else (0, 0)
        # The one look at the fragments of all versions: each distinct piece with the id that it has there, if any. A store has a key once.
        known = self.fragments().filter(F.col("ht_sha1") != F.lit(b"\0" * 20)).select("ht_sha1", F.col("frag_id").alias("known_id"))
        first = pieces.groupBy("ht_sha1").agg(F.min(F.struct(*order, "ht_usize")).alias("f")).join(known, "ht_sha1", "left")
        first.select("ht_sha1", "known_id", "f.*").write.parquet(f"{work}/first")
        first = self.spark.read.parquet(f"{work}/first")
        fresh = packing.assign_ids(first.filter("known_id is null").drop("known_id"), order, last_frag)
        fresh = packing.pack_blocks(fresh, self.block_size)
        place = F.row_number().over(Window.partitionBy("block_no").orderBy("frag_id")) - 1
        fresh = fresh.select("frag_id", "ht_sha1", "ht_usize", (F.col("block_no") + last_block + 1).alias("block_id"), place.cast("int").alias("pos_in_block"), "block_offset", "dt_path", "pos")
        target = f"version_no={number}"
        fresh.select("frag_id", "ht_sha1", "ht_usize", "block_id", "pos_in_block", "block_offset").write.mode("overwrite").parquet(f"{self.path}/fragments/{target}")
        mine = self.spark.read.parquet(f"{self.path}/fragments/{target}")
        figures = mine.agg(F.count("*").alias("n"), F.max("frag_id").alias("f"), F.max("block_id").alias("b")).first()

        where = fresh.select("dt_path", "pos", "block_id", "frag_id").join(pieces.select("dt_path", "pos", "off", "ht_usize", "redundancy", "is_text", "is_code"), ["dt_path", "pos"])
        bytes_ = slices(outside, where, "dt_path", "content", "off", "ht_usize", "p").select("block_id", "frag_id", "ht_usize", "p")
        self._write_blocks(bytes_, self._methods(where), f"{self.path}/blocks/{target}")
        read_bytes, new_bytes = (x.agg(F.coalesce(F.sum("ht_usize"), F.lit(0))).first()[0] for x in (pieces, mine))
        packed = self.spark.read.parquet(f"{self.path}/blocks/{target}").agg(F.sum("bsize").alias("s")).first()["s"] or 0

        known = first.filter("known_id is not null").select("ht_sha1", F.col("known_id").alias("frag_id")).unionByName(mine.select("ht_sha1", "frag_id"))
        lists = pieces.join(known, "ht_sha1").groupBy("dt_path").agg(F.sort_array(F.collect_list(F.struct("pos", "frag_id"))).alias("s")).select("dt_path", F.col("s.frag_id").alias("new_ptr"))
        old = inside.select("dt_path", F.col("dt_ptr").alias("old_ptr"), F.lit(True).alias("there"))
        both = outside.drop("content").join(lists, "dt_path", "left").join(old, "dt_path", "left")
        differs = compare.needs_entry(inside, outside, KEYS).select("dt_path", F.lit(True).alias("differs"))
        both = both.join(differs, "dt_path", "left").filter(F.col("differs") | (F.col("new_ptr").isNotNull() & ~F.col("new_ptr").eqNullSafe(F.col("old_ptr"))))
        updates = both.select("dt_path", "dt_date", "dt_size", "dt_attr", F.coalesce("new_ptr", "old_ptr").alias("dt_ptr"))
        gone = compare.needs_delete(inside, outside, KEYS)
        if keep_unreadable:
            gone = gone.filter(~F.col("dt_path").isin(*keep_unreadable))
        deletes = gone.select("dt_path", F.lit(0).cast("bigint").alias("dt_date"), F.lit(0).cast("bigint").alias("dt_size"), F.lit(0).cast("bigint").alias("dt_attr"), F.array().cast("array<bigint>").alias("dt_ptr"))
        updates.unionByName(deletes).write.mode("overwrite").parquet(f"{self.path}/entries/{target}")
        counts = self.spark.read.parquet(f"{self.path}/entries/{target}").agg(F.count(F.when(F.col("dt_date") == 0, 1)).alias("d"), F.count("*").alias("n")).first()
        result = {"version_no": number, "date": now, "updates": counts["n"] - counts["d"], "deletes": counts["d"], "frags": figures["n"], "bsize": packed, "read_bytes": read_bytes, "new_bytes": new_bytes, "last_frag": figures["f"] or last_frag, "last_block": figures["b"] or last_block, "tables": ["entries", *(["fragments", "blocks"] if figures["n"] else [])]}
        if counts["n"]:
            write_text(self.spark, f"{self.path}/commits.json", json.dumps([*log, result]))
            if index is not None:
                if index.versions() != log:
                    raise VaultError("the index is of other versions")
                self._copy_tables(index, [result], payload=False)
                write_text(self.spark, f"{index.path}/commits.json", json.dumps([*log, result]))
        return result

    def _methods(self, pieces: DataFrame) -> DataFrame:
        """(block_id, method) of blocks by their pieces; ``{p}`` in a method stands for the periods of the content."""
        if self.method not in LEVELS:
            return pieces.select("block_id", F.lit(self.method).alias("method")).distinct()
        hints = packing.block_hints(pieces.withColumnRenamed("ht_usize", "len"), "block_id")
        method = packing.choose_method(int(self.method), F.col("redundancy"), F.col("kind"), packing.size_class(F.col("bytes")), F.lit("{p}"))
        return hints.select("block_id", method.alias("method"))

    def _write_blocks(self, rows: DataFrame, methods: DataFrame, path: str) -> None:
        """Rows of (block_id, frag_id, ht_usize, p) as packed blocks. A block is gathered by the task that packs it; its size is bounded by block_size and one fragment."""
        key = self.key
        rows = rows.join(methods, "block_id")

        def pack(key_, table):
            import pyarrow as pa

            t = table.sort_by("frag_id")
            content, method = b"".join(t.column("p").to_pylist()), t.column("method")[0].as_py()
            if "{p}" in method:
                method = method.replace("{p}", packing.periodic_models(content))
            return pa.table({"block_id": [key_[0].as_py()], "frags": [t.num_rows], "usize": [len(content)], "method": [method], "payload": pa.array([codecs.pack_bytes(content, method)], pa.binary())})

        blocks = rows.groupBy("block_id").applyInArrow(pack, "block_id bigint, frags bigint, usize bigint, method string, payload binary")
        if key is not None:
            blocks = blocks.withColumn("payload", crypto.encrypt(F.col("payload"), key))
        blocks.withColumn("bsize", F.octet_length("payload").cast("bigint")).select("block_id", "frags", "usize", "bsize", "method", "payload").write.mode("overwrite").parquet(path)

    def _unpacked(self, blocks: DataFrame) -> DataFrame:
        """(block_id, payload, unpack_error): content of blocks; null where one is damaged."""
        rows = blocks.select("block_id", "payload")
        if self.key is not None:
            rows = rows.withColumn("payload", crypto.decrypt(F.col("payload"), self.key))
        out = codecs.unpack_column(rows, "payload")
        return out.withColumn("unpack_error", F.when(F.col("payload").isNull(), F.coalesce("unpack_error", F.lit("the block can't be decrypted"))))

    def _pieces(self, files: DataFrame, until: int | None) -> DataFrame:
        """(dt_path, pos, frag_id, p, ok): content of the fragments that files need, checked against their SHA-1; only blocks that are needed are read."""
        uses = files.select("dt_path", F.posexplode("dt_ptr").alias("pos", "frag_id"))
        frags = self.fragments(until).join(uses.select("frag_id").distinct(), "frag_id", "left_semi")
        needed = self.blocks(until).join(frags.select("block_id").distinct(), "block_id", "left_semi")
        cut = slices(self._unpacked(needed), frags.select("block_id", "frag_id", "ht_sha1", "block_offset", "ht_usize"), "block_id", "payload", "block_offset", "ht_usize", "p")
        cut = cut.withColumn("ok", F.coalesce(F.unhex(F.sha1("p")) == F.col("ht_sha1"), F.lit(False)))
        return uses.join(cut.select("frag_id", "p", "ok"), "frag_id", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))

    def extract(self, until: int | None = None, select: Selection = Selection(), present: DataFrame | None = None, force: bool = False) -> DataFrame:
        """Selected files with their content, renamed: dt_path, dt_date, dt_size, dt_attr, content, frags_ok, frags_total, action.

        A file whose fragments aren't all there has a null content. With ``present``
        files that exist are kept (``?``), same ones skipped (``=``), or overwritten
        (``#``, with ``force``); those kept and skipped have no content.
        """
        files = self.snapshot(until, select)
        target = paths.renamed(F.col("dt_path"), select.files, select.rename_to)
        files = files.withColumn("target", target)
        action = F.lit(">")
        if present is not None:
            acts = compare.restore_actions(files.select(F.col("target").alias("dt_path"), *compare.VALUES), present, force, KEYS)
            files = files.join(acts.select(F.col("dt_path").alias("target"), "action"), "target")
            action = F.col("action")
        write = files.filter(action.isin(">", "#"))
        rows = files.join(joined(self._pieces(write, until)), "dt_path", "left")
        total = F.coalesce(F.size("dt_ptr"), F.lit(0))
        total = F.when(total < 0, 0).otherwise(total)
        content = F.when(action.isin(">", "#"), F.when(total == 0, F.unhex(F.lit(""))).when(F.col("good") == total, F.col("whole")))
        return rows.select(F.col("target").alias("dt_path"), *compare.VALUES, content.alias("content"), F.when(total == 0, 0).otherwise(F.col("good")).alias("frags_ok"), total.alias("frags_total"), action.alias("action"))

    def _same_content(self, inside: DataFrame, outside: DataFrame, until: int | None) -> DataFrame:
        """(dt_path) of the outside files whose content is the stored one: cut like the stored fragments, its pieces have their SHA-1s. No block is read.

        A file with a fragment that is missing, or whose size or SHA-1 isn't known, can't be compared and isn't the same.
        """
        uses = inside.join(outside.select("dt_path"), "dt_path", "left_semi").select("dt_path", F.posexplode_outer("dt_ptr").alias("pos", "frag_id"))
        known = self.fragments(until).filter((F.col("ht_usize") >= 0) & F.col("ht_sha1").isNotNull() & (F.col("ht_sha1") != F.lit(b"\0" * 20)))
        rows = uses.join(known.select("frag_id", "ht_sha1", "ht_usize"), "frag_id", "left")
        upto = Window.partitionBy("dt_path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
        parts = rows.withColumn("off", F.coalesce(F.sum("ht_usize").over(upto), F.lit(0)))
        whole = parts.groupBy("dt_path").agg(F.coalesce(F.sum("ht_usize"), F.lit(0)).alias("size"), F.count(F.when(F.col("frag_id").isNotNull() & F.col("ht_sha1").isNull(), 1)).alias("unknown"))
        content = outside.select("dt_path", F.coalesce("content", F.lit(b"")).alias("content"))
        fits = whole.join(content.select("dt_path", F.octet_length("content").alias("n")), "dt_path").filter("unknown = 0 and size = n").select("dt_path")
        cut = slices(content, parts.filter("frag_id is not null").join(fits, "dt_path", "left_semi").select("dt_path", "off", "ht_usize", "ht_sha1"), "dt_path", "content", "off", "ht_usize", "p")
        wrong = cut.filter(~F.coalesce(F.unhex(F.sha1("p")) == F.col("ht_sha1"), F.lit(False))).select("dt_path").distinct()
        return fits.join(wrong, "dt_path", "left_anti")

    def verify(self, until: int | None = None) -> DataFrame:
        """(block_id, frags, frags_ok, problem): every block unpacked and every fragment checked."""
        blocks = self._unpacked(self.blocks(until))
        cut = slices(blocks, self.fragments(until).select("block_id", "ht_sha1", "block_offset", "ht_usize"), "block_id", "payload", "block_offset", "ht_usize", "p")
        ok = F.coalesce(F.unhex(F.sha1("p")) == F.col("ht_sha1"), F.lit(False))
        checked = cut.groupBy("block_id").agg(F.count("*").alias("frags"), F.count(F.when(ok, 1)).alias("frags_ok"), F.count("p").alias("cut"))
        problem = F.when(F.col("cut") == 0, "the block can't be unpacked").when(F.col("frags_ok") < F.col("frags"), "checksums differ")
        return checked.select("block_id", "frags", "frags_ok", problem.alias("problem"))

    def failures(self, until: int | None = None) -> DataFrame:
        """(dt_path, restored, total) of live files that can't be restored whole."""
        bad = self.verify(until).filter("frags_ok < frags").select("block_id")
        return rollup.failed_files(self.snapshot(until), self.fragments(until), bad, "dt_path")

    def rollback(self, until: int) -> None:
        """Forgets the versions beyond ``until``; their directories are overwritten by later ones."""
        write_text(self.spark, f"{self.path}/commits.json", json.dumps(self.cut(until)))

    def stats(self, until: int | None = None) -> DataFrame:
        """One row: n_files, refs, n_frags, all_size, dedupe_size, unknown, and packed bytes."""
        files = self.snapshot(until).withColumn("k", F.lit(1))
        packed = sum(v["bsize"] for v in self.cut(until))
        return rollup.dedupe_stats(files, self.fragments(until), "k").drop("k").withColumn("packed_bytes", F.lit(packed).cast("bigint"))

    def most_memory(self, until: int | None = None) -> int:
        """Bytes that unpacking may take in one task, by the block that needs most; 0 for an empty store."""

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                needs = [codecs.codec_memory(m, n) for m, n in zip(*(batch.column(c).to_pylist() for c in range(2)))]
                yield pa.RecordBatch.from_arrays([pa.array(needs, pa.int64())], ["bytes"])

        return self.blocks(until).select("method", "usize").mapInArrow(run, "bytes bigint").agg(F.max("bytes").alias("m")).first()["m"] or 0

    def index_to(self, path: str) -> Vault:
        """A copy without payloads: everything can be listed and compared, nothing restored."""
        return self._copy(path, None, None, payload=False)

    def repack_to(self, path: str, select: Selection = Selection(), until: int | None = None, password: str | None = None) -> Vault:
        """A store of one version that holds the selected files and only the blocks they need, perhaps under another password."""
        return self._copy(path, select, until, password=password)

    def repack_all_to(self, path: str, password: str | None = None) -> Vault:
        """A copy of all versions, perhaps under another password."""
        return self._copy(path, None, None, password=password)

    def _rekeyed(self, blocks: DataFrame, to: Vault) -> DataFrame:
        if self.key is not None:
            blocks = blocks.withColumn("payload", crypto.decrypt(F.col("payload"), self.key))
        if to.key is not None:
            blocks = blocks.withColumn("payload", crypto.encrypt(F.col("payload"), to.key))
        return blocks

    def _copy_tables(self, to: Vault, log: list[dict], payload: bool = True) -> None:
        for v in log:
            for name, schema in (("entries", ENTRIES), ("fragments", FRAGMENTS), ("blocks", BLOCKS)):
                if name in v["tables"]:
                    rows = self._read(name, schema, [v]).drop("version_no")
                    if name == "blocks":
                        rows = self._rekeyed(rows, to) if payload else rows.withColumn("payload", F.lit(None).cast("binary"))
                    rows.write.mode("overwrite").parquet(f"{to.path}/{name}/version_no={v['version_no']}")

    def _copy(self, path: str, select: Selection | None, until: int | None, payload: bool = True, password: str | None = None) -> Vault:
        if json.loads(read_text(self.spark, f"{path}/commits.json") or "[]"):
            raise VaultError(f"{path} exists")
        to = Vault(self.spark, path, password, self.fragment, self.method, self.block_size, self.fixed)
        log = self.cut(until)
        if not log:
            return to
        if select is None:
            self._copy_tables(to, log, payload)
            write_text(self.spark, f"{to.path}/commits.json", json.dumps(log))
            return to
        files = self.snapshot(until, select)
        used = files.select(F.explode("dt_ptr").alias("frag_id")).distinct()
        all_frags = self.fragments(until)
        kept = all_frags.join(used, "frag_id", "left_semi").select("block_id").distinct()
        blocks, frags = self.blocks(until).join(kept, "block_id", "left_semi"), all_frags.join(kept, "block_id", "left_semi")
        blocks = self._rekeyed(blocks, to)
        blocks = blocks.withColumn("bsize", F.octet_length("payload").cast("bigint"))
        files.drop("version_no").write.parquet(f"{to.path}/entries/version_no=1")
        frags.drop("version_no").write.parquet(f"{to.path}/fragments/version_no=1")
        blocks.drop("version_no").write.parquet(f"{to.path}/blocks/version_no=1")
        sums = to.spark.read.parquet(f"{to.path}/blocks/version_no=1").agg(F.sum("bsize").alias("s"), F.sum("frags").alias("n")).first()
        one = {"version_no": 1, "date": log[-1]["date"], "updates": files.count(), "deletes": 0, "frags": sums["n"] or 0, "bsize": sums["s"] or 0, "last_frag": log[-1]["last_frag"], "last_block": log[-1]["last_block"], "tables": ["entries", "fragments", "blocks"]}
        write_text(self.spark, f"{to.path}/commits.json", json.dumps([one]))
        return to
