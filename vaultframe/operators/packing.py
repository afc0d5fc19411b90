"""Dedupe of fragments, packing them into blocks, and the choice of a method for each block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vaultframe.operators import chunk
from vaultframe.operators.numbering import number_rows


def new_fragments(chunks: DataFrame, known: DataFrame, order: list[str]) -> DataFrame:
    """The fragments of ``chunks`` that aren't known, once each, by their first occurrence in ``order``: ht_sha1, ht_usize and the order columns.

    Null and all-zero keys and unknown sizes of known fragments don't count as known.
    """
    usable = known.filter((F.col("ht_usize") >= 0) & F.col("ht_sha1").isNotNull() & (F.col("ht_sha1") != F.lit(b"\0" * 20))).select("ht_sha1")
    first = chunks.groupBy("ht_sha1").agg(F.min(F.struct(*order, "ht_usize")).alias("f"))
    return first.join(usable, "ht_sha1", "left_anti").select("ht_sha1", "f.*")


def assign_ids(fragments: DataFrame, order: list[str], base: int = 0) -> DataFrame:
    """Dense ids from base + 1 in order of first occurrence."""
    return number_rows(fragments, [*order, "ht_sha1"], "frag_id").withColumn("frag_id", F.col("frag_id") + base)


def pack_blocks(fragments: DataFrame, block_size: int) -> DataFrame:
    """Adds block_no and block_offset: fragments in order of frag_id fill blocks by their running size, each with the 4 bytes that its size takes.

    A block is the fragments whose beginning falls into one stretch of
    ``block_size`` bytes, so it may exceed that by less than a fragment. The sums
    are taken over stretches of 65,536 ids first, then over the stretches.
    """
    stretch = F.floor(F.col("frag_id") / 65_536)
    cost = F.col("ht_usize").cast("bigint") + 4
    rows = fragments.withColumn("_s", stretch).withColumn("_c", cost)
    sums = rows.groupBy("_s").agg(F.sum("_c").alias("_t"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_t").over(Window.partitionBy(F.lit(0)).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("_s").orderBy("frag_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_w", F.coalesce(F.sum("_c").over(inside), F.lit(0))).join(sums.select("_s", "_before"), "_s")
    rows = rows.withColumn("_at", F.col("_w") + F.col("_before")).withColumn("block_no", F.floor(F.col("_at") / block_size).cast("bigint"))
    per_block = Window.partitionBy("block_no").orderBy("frag_id").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.col("ht_usize").cast("bigint")).over(per_block), F.lit(0))
    return rows.withColumn("block_offset", offset).drop("_s", "_c", "_w", "_before", "_at")


def shared_redundancy(pieces: DataFrame, order: list[str], least: int, by: str = "block_no") -> DataFrame:
    """(by, len, is_text, is_code, redundancy): pieces with the redundancy that they have after those before them in their block.

    Each piece is compared with the tables of the last four of at least ``least``
    bytes before it in ``order``. A block's pieces are worked through in one task.
    """

    def run(group):
        import numpy as np
        import pyarrow as pa

        group = group.sort_by([(c, "ascending") for c in order])
        sizes, own = (group.column(c).to_numpy() for c in ("len", "redundancy"))
        tables = np.frombuffer(b"".join(group.column("table").to_pylist()), np.uint8).reshape(-1, 256)
        large = sizes >= least
        kept = np.concatenate((np.zeros((4, 256), np.uint8), tables[large]))
        before = np.cumsum(large) - large
        made = [group.column(c) for c in (by, "len", "is_text", "is_code")]
        out = np.zeros(len(sizes), np.int64)
        for k in range(0, len(sizes), 1024):
            part = slice(k, k + 1024)
            out[part] = chunk.redundancies(sizes[part], own[part], tables[part], kept[before[part, None] + np.arange(4)])
        return pa.table([*made, pa.array(out)], [by, "len", "is_text", "is_code", "redundancy"])

    rows = pieces.select(by, *order, "len", "is_text", "is_code", "redundancy", "table")
    return rows.groupBy(by).applyInArrow(run, f"`{by}` {pieces.schema[by].dataType.simpleString()}, len bigint, is_text boolean, is_code boolean, redundancy bigint")


def block_hints(pieces: DataFrame, by: str = "block_no") -> DataFrame:
    """Redundancy 0..255 and kind (1 text, 2 code) of each block from its pieces' redundancy, is_text and is_code."""
    sums = pieces.groupBy(by).agg(F.count("*").alias("n"), F.sum("redundancy").alias("saved"), F.sum("len").alias("bytes"), F.sum(F.when(F.col("is_code"), 4).otherwise(0)).alias("code"), F.sum(F.when(F.col("is_text"), 2).otherwise(0)).alias("text"))
    kind = F.when(F.col("code") > F.col("n"), 2).otherwise(0) + F.when(F.col("text") > F.col("n"), 1).otherwise(0)
    return sums.select(by, F.col("n").alias("frags"), F.col("bytes"), F.floor(F.col("saved") / (F.floor(F.col("bytes") / 256) + 1)).cast("bigint").alias("redundancy"), kind.cast("int").alias("kind"))


#: Fixed: the methods of each level, as (most type, method) in order; the type is 4 times the redundancy plus the kind.
#: {b}: size class of the block, {e}: 4 for code, {h} and {s}: sizes of the hash and of the suffix array.
LEVELS = {
    1: [(39, "x{b},0"), (79, "x{b},{1}4,0,1,15"), (127, "x{b},{1}4,0,2,16"), (255, "x{b},{1}4,0,2,{h}"), (959, "x{b},{1}5,0,3,{h}"), (None, "x{b},{1}6,0,3,{h}")],
    2: [(31, "x{b},0"), (63, "x{b},{1}4,0,3,{h}"), (None, "x{b},{1}4,0,7,{s},1")],
    3: [(19, "x{b},0"), (47, "x{b},{1}4,0,3,{h}"), ("text", "x{b},{3}ci1"), (639, "x{b},{2}12,0,7,{s},1c0,0,511i2"), (None, "x{b},{3}ci1")],
    4: [(11, "x{b},0"), (23, "x{b},{1}4,0,3,{h}"), (47, "x{b},{2}5,0,7,{s}1c0,0,511"), (899, "x{b},{e}ci1,1,1,1,2a{w}m"), (None, "x{b},{3}ci1")],
    5: [(None, "x{b},{e}{x}c256ci1,1,1,1,1,1,2a{p}c0,2,0,255i1c0,3,0,0,255i1c0,4,0,0,0,255i1mm16ts19t0")],
}


def size_class(bytes_: Column) -> Column:
    """Smallest k with 2^(k+20) >= bytes + 4096."""
    return F.greatest(F.ceil(F.log2(bytes_ + F.lit(4096))) - 20, F.lit(0)).cast("int")


def choose_method(level: int, redundancy: Column, kind: Column, klass: Column, periods: Column | None = None) -> Column:
    """Method of a block by level (0..9), redundancy (0..255), kind and size class; ``periods``: the periodic models of level 5."""
    b = klass.cast("string")
    if level == 0:
        return F.concat(F.lit("0"), b, F.lit(",0"))
    type_ = redundancy * 4 + kind
    code = kind.bitwiseAND(2) * 2
    parts = {
        "b": b,
        "e": code.cast("string"),
        "h": (klass + 19 + F.when(klass <= 6, 1).otherwise(0)).cast("string"),
        "s": (klass + 21).cast("string"),
        "w": F.when(kind.bitwiseAND(1) == 1, "w").otherwise(""),
        "x": F.when(kind.bitwiseAND(1) == 1, "w2c0,1010,255i1").otherwise("w1i1"),
        "p": periods if periods is not None else F.lit(""),
        **{str(k): F.concat((code + k).cast("string"), F.lit("," if k < 3 else "")) for k in (1, 2, 3)},
    }

    def text(template: str) -> Column:
        import re

        return F.concat(*(parts[t[1:-1]] if t.startswith("{") else F.lit(t) for t in re.findall(r"\{\w\}|[^{]+", template)))

    out = None
    for most, template in LEVELS[min(level, 5)]:
        test = F.lit(True) if most is None else (kind.bitwiseAND(1) == 1) if most == "text" else type_ <= most
        out = F.when(test, text(template)) if out is None else out.when(test, text(template))
    return out


def gap_histogram(items: DataFrame, by: list[str], value: str, place: str) -> DataFrame:
    """(by, gap, n): how often the same value comes again after ``gap`` places."""
    w = Window.partitionBy(*by, value).orderBy(place)
    return items.withColumn("gap", (F.col(place) - F.lag(place).over(w)).cast("bigint")).filter("gap is not null").groupBy(*by, "gap").agg(F.count("*").alias("n"))


#: A gap is a period if it lies in this range and so large a share of the bytes come again after it.
PERIODS, PERIOD_SHARE = (5, 4095), 0.1


def periods_of(content: bytes, most: int = 2) -> list[int]:
    """The periods of a content: the commonest gaps between a byte and its last occurrence, those that a share of all bytes has."""
    import numpy as np

    data = np.frombuffer(content, np.uint8)
    order = np.argsort(data, kind="stable")
    gaps = np.diff(order)[np.diff(data[order]) == 0]
    counts = np.bincount(gaps[gaps <= PERIODS[1]], minlength=PERIODS[1] + 1)[PERIODS[0] :]
    common = np.flatnonzero(counts > PERIOD_SHARE * len(data))
    return (common[np.argsort(-counts[common], kind="stable")][:most] + PERIODS[0]).tolist()


def periodic_models(content: bytes) -> str:
    """The part of a level 5 method that models a content's periods."""
    return "".join(f"c0,0,{999 + p},255i1" + (f"c0,{p}i1" if p <= 255 else "") for p in periods_of(content))
