"""Has this key been seen before? Quotient filters over an incoming stream.

A key's fingerprint is parted into a range (which task), a quotient (which slot)
and a remainder (what the slot stores). A filter keeps its remainders in the
order of the fingerprints, shifted along where a quotient has several, with three
bits of run metadata a slot: is the slot's quotient in use, does the slot continue
the run of the slot before, is its remainder shifted. The fingerprints are all in
there, so two filters are merged like sorted runs.

Filters are stored, one a range. An intake sorts its rows by fingerprint, looks
them up in the stored filters, merges the new fingerprints with those, and stores
the result. A row is flagged if its fingerprint was there before. Only rows flagged
by a stored filter are held against the exact keys of earlier intakes, and of those
keys only the ones with a flagged fingerprint.
"""

from __future__ import annotations

import binascii
import json
import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaultframe.session import read_text, scratch_path, write_text

#: Remainder bits beyond the bits that part the expected keys, and the keys that a range is meant to hold.
REMAINDER_BITS, RANGE_KEYS = 10, 1 << 19
#: Intakes that a whole table is parted into, by seg_id; keys that a task of the decoder remembers, so that it hands on a frequent key a few times only.
INTAKES, REMEMBERED = 4, 100_000

_LABEL = re.compile(r"^(?:(?:urn:)?sha-?1\s*[:=\-]\s*|0x)", re.IGNORECASE)
_APART = re.compile(r"[\s:\-_.]+")
_BASE32, _BASE64 = re.compile(r"[A-Za-z2-7]{32}"), re.compile(r"[A-Za-z0-9+/]{27}=?")


def decode_key(text: str | None) -> bytes | None:
    """The 20 bytes that a spelling of a SHA-1 denotes, None where it doesn't denote exactly 20 bytes or all are zero.

    Hexadecimal, base32 or base64, with or without a label (``sha1:``, ``SHA1:``,
    ``sha1-``, ``urn:sha1:``, ``0x``), surrounding blanks, and separators or blanks
    between hexadecimal digits.
    """
    if text is None:
        return None
    body = _LABEL.sub("", text.strip()).strip()
    key, digits = None, _APART.sub("", body)
    try:
        if len(digits) == 40:
            key = bytes.fromhex(digits)
        elif _BASE32.fullmatch(body):
            import base64

            key = base64.b32decode(body.upper())
        elif _BASE64.fullmatch(body):
            key = binascii.a2b_base64(body.rstrip("=") + "=")
    except ValueError:
        return None
    return key if key is not None and len(key) == 20 and any(key) else None


def decode_many(texts: list[str | None]) -> list[bytes | None]:
    """Many keys at once: plain hexadecimal ones together, others one by one."""
    plain = [k for k, t in enumerate(texts) if t is not None and len(t) == 40]
    out: list[bytes | None] = [None] * len(texts)
    try:
        raw = bytes.fromhex("".join(texts[k] for k in plain))
        if len(raw) != 20 * len(plain):
            raise ValueError
        for j, k in enumerate(plain):
            key = raw[20 * j : 20 * j + 20]
            out[k] = key if any(key) else None
        rest = (k for k, t in enumerate(texts) if t is not None and len(t) != 40)
    except ValueError:
        rest = range(len(texts))
    for k in rest:
        out[k] = decode_key(texts[k])
    return out


def fingerprints(keys, bits: int):
    """Fingerprints of ``bits`` bits of an array of 20-byte keys (n x 20, uint8); all bytes count."""
    import numpy as np

    words = np.ascontiguousarray(keys).view("<u4").astype(np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(len(words), 0x9E3779B97F4A7C15, np.uint64)
        for k in range(5):
            h ^= words[:, k]
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(32)
    return h >> np.uint64(64 - bits)


class QuotientFilter:
    """A filter of distinct fingerprints of ``bits`` bits, of which the last ``remainder_bits`` are stored."""

    def __init__(self, prints, bits: int, remainder_bits: int):
        """From sorted distinct fingerprints."""
        import numpy as np

        self.bits, self.remainder_bits, self.n = bits, remainder_bits, len(prints)
        quotient = (prints >> np.uint64(remainder_bits)).astype(np.int64)
        slot = np.maximum.accumulate(quotient - np.arange(self.n)) + np.arange(self.n) if self.n else quotient
        self.slots = max(1 << max(bits - remainder_bits, 0), int(slot[-1]) + 1 if self.n else 1)
        occupied, shifted, continued = (np.zeros(-(-self.slots // 64) * 64, bool) for _ in range(3))
        occupied[quotient] = True
        shifted[slot] = slot != quotient
        continued[slot[1:]] = quotient[1:] == quotient[:-1]
        # A slot is empty exactly if all three bits are clear.
        self.occupied, self.continued, self.shifted = (np.packbits(x, bitorder="little").view("<u8") for x in (occupied, continued, shifted))
        self.remainders = np.zeros(self.slots, self._kind(remainder_bits))
        self.remainders[slot] = prints & np.uint64((1 << remainder_bits) - 1)

    @staticmethod
    def _kind(remainder_bits: int) -> str:
        return "<u2" if remainder_bits <= 16 else "<u4" if remainder_bits <= 32 else "<u8"

    @classmethod
    def sized(cls, prints, bits: int) -> QuotientFilter:
        """With slots for the fingerprints at three quarters of its room."""
        quotient_bits = min(bits, max(1, math.ceil(math.log2(max(len(prints), 1) / 0.75))))
        return cls(prints, bits, bits - quotient_bits)

    def dump(self) -> bytes:
        head = b"".join(x.to_bytes(8, "little") for x in (self.bits, self.remainder_bits, self.n, self.slots))
        return head + b"".join(x.tobytes() for x in (self.occupied, self.continued, self.shifted, self.remainders))

    @classmethod
    def load(cls, data: bytes) -> QuotientFilter:
        import numpy as np

        out = cls.__new__(cls)
        out.bits, out.remainder_bits, out.n, out.slots = (int.from_bytes(data[k : k + 8], "little") for k in (0, 8, 16, 24))
        words = -(-out.slots // 64)
        out.occupied, out.continued, out.shifted = (np.frombuffer(data, "<u8", words, 32 + 8 * words * k) for k in range(3))
        out.remainders = np.frombuffer(data, cls._kind(out.remainder_bits), out.slots, 32 + 24 * words)
        return out

    def prints(self):
        """The sorted fingerprints, from run metadata and remainders; for merging."""
        import numpy as np

        occupied, continued, shifted = (np.unpackbits(x.view(np.uint8), bitorder="little").astype(bool) for x in (self.occupied, self.continued, self.shifted))
        slot = np.flatnonzero(occupied | continued | shifted)
        run = np.cumsum(~continued[slot]) - 1
        quotient = np.flatnonzero(occupied)[run] if len(slot) else slot
        return quotient.astype(np.uint64) << np.uint64(self.remainder_bits) | self.remainders[slot].astype(np.uint64)

    def contains(self, prints):
        """Which of the fingerprints the filter has, by their runs alone.

        A quotient in use has the run whose number is the count of such quotients
        before it; runs begin at slots that hold something and continue nothing.
        Both are found by counts of bits a word of 64, so nothing is unpacked.
        """
        import numpy as np

        prints = np.asarray(prints, np.uint64)
        found = np.zeros(len(prints), bool)
        if not self.n or not len(prints):
            return found
        one = np.uint64(1)
        quotient, remainder = prints >> np.uint64(self.remainder_bits), prints & np.uint64((1 << self.remainder_bits) - 1)
        word, bit = (quotient >> np.uint64(6)).astype(np.int64), quotient & np.uint64(63)
        live = np.flatnonzero(self.occupied[word] >> bit & one)
        word, bit, remainder = word[live], bit[live], remainder[live]
        upto = np.cumsum(np.bitwise_count(self.occupied), dtype=np.int64)
        run = np.where(word > 0, upto[word - 1], 0) + np.bitwise_count(self.occupied[word] & ((one << bit) - one))
        starts = (self.occupied | self.continued | self.shifted) & ~self.continued
        counts = np.bitwise_count(starts)
        upto = np.cumsum(counts, dtype=np.int64)
        word = np.searchsorted(upto, run, "right")
        inside, left, at = starts[word], run - (upto[word] - counts[word]), word * 64
        for width in (32, 16, 8, 4, 2, 1):
            low = inside & np.uint64((1 << width) - 1)
            n = np.bitwise_count(low)
            above = left >= n
            left, at = left - n * above, at + width * above
            inside = np.where(above, inside >> np.uint64(width), low)
        while len(live):
            stored = self.remainders[at].astype(np.uint64)
            found[live[stored == remainder]] = True
            at = at + 1
            more = (stored < remainder) & (at < self.slots)
            live, remainder, at = live[more], remainder[more], at[more]
            more = (self.continued[at >> 6] >> (at & 63).astype(np.uint64) & one).astype(bool)
            live, remainder, at = live[more], remainder[more], at[more]
        return found

    def merged(self, prints) -> QuotientFilter:
        """One filter with its fingerprints and others that it doesn't have, by merging two sorted runs; more slots where they need them."""
        import numpy as np

        return self.sized(np.sort(np.concatenate((self.prints(), np.asarray(prints, np.uint64))), kind="stable"), self.bits)

    @property
    def nbytes(self) -> int:
        return self.remainders.nbytes + sum(x.nbytes for x in (self.occupied, self.continued, self.shifted))


def fingerprint_bits(keys: int, remainder_bits: int = REMAINDER_BITS) -> tuple[int, int]:
    """Bits of a fingerprint, and how many of them choose the range, for an expected number of keys."""
    ranges = max(8, math.ceil(math.log2(max(keys, 1) / RANGE_KEYS)))
    return min(62, max(ranges + 1, math.ceil(math.log2(max(keys, 2))) + remainder_bits)), ranges


#: What an intake writes, by kind: a range's filter, a row that repeats a key of its own intake, a row to be checked, a key that is new, a row whose fingerprint alone was there, and a range's counts.
KINDS = ("filter", "seen", "candidate", "key", "wrong", "sum")
_ROWS = "range int, print bigint, seq bigint, key binary, stage int"
_OUT = "range int, print bigint, seq bigint, key binary, n bigint, derived double"


def keyed_rows(segments: DataFrame, bits: int, range_bits: int) -> DataFrame:
    """(range, print, seq, key, stage) of the rows that have a key; stage 2, or 1 for a row that is settled.

    Settled is a row whose key a row of a smaller seg_id has that was met in the
    same task; it goes on without its key. So a key that a large part of the rows
    has is handed on a few times a task, not once a row.
    """
    within = bits - range_bits

    def run(batches):
        import numpy as np
        import pyarrow as pa

        met: dict[bytes, int] = {}
        for batch in batches:
            keys = decode_many(batch.column(1).to_pylist())
            order = batch.column(0).to_numpy(zero_copy_only=False)
            good = np.flatnonzero(np.fromiter((k is not None for k in keys), bool, len(keys)))
            good = good[np.argsort(order[good], kind="stable")]
            mine, seq = [keys[i] for i in good], order[good].tolist()
            if len(met) > REMEMBERED:
                met.clear()
            settled = np.zeros(len(mine), bool)
            for j, (k, n) in enumerate(zip(mine, seq)):
                first = met.get(k)
                if first is None or n < first:
                    met[k] = n
                elif n > first:
                    settled[j] = True
            full = np.zeros(len(mine), np.uint64)
            if not settled.all():
                full[~settled] = fingerprints(np.frombuffer(b"".join(k for k, x in zip(mine, settled) if not x), np.uint8).reshape(-1, 20), bits)
            seqs = order[good].astype(np.int64)
            ranges = np.where(settled, seqs % (1 << range_bits), (full >> np.uint64(within)).astype(np.int64)).astype(np.int32)
            prints = (full & np.uint64((1 << within) - 1)).astype(np.int64)
            raw = pa.array([None if x else k for k, x in zip(mine, settled)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(ranges), pa.array(prints), pa.array(seqs), raw, pa.array(np.where(settled, 1, 2).astype(np.int32))], ["range", "print", "seq", "key", "stage"])

    return segments.filter("seg_id is not null and ht_sha1 is not null").select("seg_id", "ht_sha1").mapInArrow(run, _ROWS)


class _Range:
    """One range of an intake on its way through a task: its stored filter, what is new, and the group of equal fingerprints that the last Arrow batch ended in."""

    def __init__(self, within: int, stored: bytes | None):
        self.within, self.filter = within, QuotientFilter.load(stored) if stored is not None else None
        self.new, self.group, self.firsts, self.rows = [], -1, {}, 0

    def take(self, prints, seqs, keys):
        """For rows sorted by fingerprint and seq: was the fingerprint in the stored filter, was it flagged, does the row repeat a key of the intake, is it the first with its key?"""
        import numpy as np

        n = len(prints)
        begins = np.concatenate(([True], prints[1:] != prints[:-1]))
        begin = np.flatnonzero(begins)
        stored = self.filter.contains(prints[begin]) if self.filter is not None else np.zeros(len(begin), bool)
        group = np.cumsum(begins) - 1
        joined = prints[0] == self.group
        same = (keys == keys[begin[group]]).all(1)
        flagged, first = ~begins, begins.copy()
        repeats = ~begins & same & (seqs > seqs[begin[group]])
        mixed = set(group[~same].tolist()) | ({0} if joined else set())
        for g in sorted(mixed):
            lo, hi = begin[g], begin[g + 1] if g + 1 < len(begin) else n
            firsts = self.firsts if g == 0 and joined else {}
            for k in range(lo, hi):
                key = keys[k].tobytes()
                flagged[k] = bool(firsts)
                first[k] = key not in firsts
                repeats[k] = seqs[k] > firsts.setdefault(key, seqs[k])
        fresh = begin[~stored] if not joined else begin[1:][~stored[1:]]
        self.new.append(prints[fresh].astype(np.uint64))
        lo = begin[-1]
        if not (joined and lo == 0):
            self.firsts = {}
            for k in range(lo, n):
                self.firsts.setdefault(keys[k].tobytes(), seqs[k])
        self.group, self.rows = prints[-1], self.rows + n
        return stored[group], flagged | stored[group], repeats, first

    def closed(self):
        """The filter with what is new, and the expected number of false flags: the i-th new key met n + i of the 2^within possible fingerprints."""
        import numpy as np

        new = np.concatenate(self.new) if self.new else np.empty(0, np.uint64)
        before, m = (self.filter.n if self.filter is not None else 0), len(new)
        merged = self.filter.merged(new) if self.filter is not None else QuotientFilter.sized(new, self.within)
        return merged, (m * before + m * (m - 1) / 2) / 2.0**self.within


class SeenStore:
    """Filters of all keys taken in so far, in a folder that all executors share; a new session goes on with them.

    ``expected``: the number of keys the store is meant for, which sets the bits
    of a fingerprint when it is made. More keys than that still work, with more
    false flags, which are counted and checked. Each intake is one job, committed
    by one file after it; what an intake left that failed is written over.
    """

    def __init__(self, spark: SparkSession, path: str, expected: int = 1 << 20, remainder_bits: int = REMAINDER_BITS):
        self.spark, self.path = spark, path.rstrip("/")
        bits, range_bits = fingerprint_bits(expected, remainder_bits)
        head = self._head() or {"bits": bits, "range_bits": range_bits, "intakes": 0}
        self.bits, self.range_bits = head["bits"], head["range_bits"]

    def _head(self) -> dict | None:
        return json.loads(read_text(self.spark, f"{self.path}/intakes.json") or "null")

    @property
    def intakes(self) -> int:
        return (self._head() or {"intakes": 0})["intakes"]

    def _read(self, kind: str, numbers) -> DataFrame:
        """Rows of one kind of some intakes, with the number of each."""
        out = self.spark.createDataFrame([], f"{_OUT}, intake int")
        for n in numbers:
            rows = self.spark.read.schema(f"{_OUT}, kind string").parquet(f"{self.path}/intake-{n:06d}").filter(F.col("kind") == kind)
            out = out.unionByName(rows.drop("kind").withColumn("intake", F.lit(n)))
        return out

    def take(self, segments: DataFrame) -> int:
        """Takes in rows of (seg_id, ht_sha1), all of them after what was taken before; gives the number of the intake.

        The stored filters and the rows are exchanged by range. A task holds one
        range at a time: its filter, and the fingerprints that are new.
        """
        within, number = self.bits - self.range_bits, self.intakes
        rows = keyed_rows(segments, self.bits, self.range_bits)
        if number:
            held = self._read("filter", [number - 1])
            rows = rows.unionByName(held.select("range", F.lit(-1).cast("bigint").alias("print"), F.lit(0).cast("bigint").alias("seq"), "key", F.lit(0).alias("stage")))

        def run(batches):
            import numpy as np
            import pyarrow as pa

            names = ["range", "print", "seq", "key", "n", "derived", "kind"]

            def out(kind, r, prints=None, seqs=None, keys=None, n=None, derived=None):
                size = max((len(x) for x in (prints, seqs, keys, n, derived) if x is not None), default=0)
                cols = [pa.array(np.full(size, r, np.int32))]
                for x, t in ((prints, pa.int64()), (seqs, pa.int64()), (keys, pa.binary()), (n, pa.int64()), (derived, pa.float64())):
                    cols.append(pa.nulls(size, t) if x is None else pa.array(x, t) if not isinstance(x, pa.Array) else x)
                return pa.RecordBatch.from_arrays([*cols, pa.array([kind] * size, pa.string())], names)

            def close(r, state):
                merged, derived = state.closed()
                yield out("filter", r, keys=[merged.dump()])
                yield out("sum", r, n=[state.rows], derived=[derived])

            at, state = None, None
            for batch in batches:
                ranges, stages = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("range", "stage"))
                if not len(ranges):
                    continue
                edges = np.flatnonzero(np.concatenate(([True], (ranges[1:] != ranges[:-1]) | (stages[1:] != stages[:-1]), [True])))
                for lo, hi in zip(edges[:-1], edges[1:]):
                    r, part = int(ranges[lo]), batch.slice(lo, hi - lo)
                    if r != at:
                        if state is not None:
                            yield from close(at, state)
                        at, state = r, _Range(within, None)
                    if stages[lo] == 0:
                        state = _Range(within, part.column("key")[0].as_py())
                    elif stages[lo] == 1:
                        state.rows += hi - lo
                        yield out("seen", r, seqs=part.column("seq"))
                    else:
                        prints, seqs = (part.column(c).to_numpy(zero_copy_only=False) for c in ("print", "seq"))
                        raw = part.column("key")
                        begin = int(np.frombuffer(raw.buffers()[1], np.int32, 1, 4 * raw.offset)[0])
                        keys = np.frombuffer(raw.buffers()[2], np.uint8, 20 * len(prints), begin).reshape(-1, 20)
                        stored, flagged, repeats, first = state.take(prints, seqs, keys)
                        for kind, which in (("seen", repeats), ("candidate", stored & ~repeats), ("key", first & ~stored), ("wrong", flagged & ~stored & ~repeats)):
                            if which.any():
                                chosen = pa.array(which)
                                held = kind in ("candidate", "key")
                                yield out(kind, r, prints[which] if held else None, part.column("seq").filter(chosen), raw.filter(chosen) if held else None)
            if state is not None:
                yield from close(at, state)

        sorted_rows = rows.repartition("range").sortWithinPartitions("range", "stage", "print", "seq")
        made = sorted_rows.mapInArrow(run, f"{_OUT}, kind string")
        made.write.mode("overwrite").partitionBy("kind").parquet(f"{self.path}/intake-{number:06d}")
        write_text(self.spark, f"{self.path}/intakes.json", json.dumps({"bits": self.bits, "range_bits": self.range_bits, "intakes": number + 1}))
        return number

    def compared(self, numbers) -> tuple[DataFrame, DataFrame]:
        """The candidates of the given intakes, and the exact keys of earlier intakes that they are held against: only those with the fingerprint of a candidate. Keys of candidates are among them, as they may have been flagged wrongly."""
        candidates = self._read("candidate", numbers)
        held = range(max(numbers, default=0))
        earlier = self._read("key", held).unionByName(self._read("candidate", held)).select("range", "print", "key", "intake")
        prints = candidates.select("range", "print").distinct()
        return candidates, earlier.join(prints, ["range", "print"], "left_semi")

    def confirmed(self, numbers) -> DataFrame:
        """(seq, intake) of the candidates of the given intakes whose exact key an earlier intake has."""
        candidates, earlier = self.compared(numbers)
        first = earlier.groupBy("key").agg(F.min("intake").alias("first"))
        return candidates.join(first, "key").filter("first < intake").select("seq", "intake")

    def seen(self, numbers) -> DataFrame:
        """(seq, intake) of the rows of the given intakes whose key occurred before."""
        return self._read("seen", numbers).select("seq", "intake").unionByName(self.confirmed(numbers))


def seed_segments(seeds: DataFrame) -> DataFrame:
    """Seed keys of 20 bytes as segments with negative ids."""
    known = seeds.filter("octet_length(ht_sha1) = 20")
    return known.select((-1 - F.monotonically_increasing_id()).alias("seg_id"), F.hex("ht_sha1").alias("ht_sha1"))


def take_all(segments: DataFrame, seeds: DataFrame | None = None, remainder_bits: int = REMAINDER_BITS, intakes: int = INTAKES, path: str | None = None) -> tuple[SeenStore, list[int]]:
    """A store that has taken the seeds, then the segments in ``intakes`` stretches of seg_id; and the numbers of the latter."""
    spark = segments.sparkSession
    expected = segments.count() + (seeds.count() if seeds is not None else 0)
    store = SeenStore(spark, path or scratch_path(spark, "seen-filters"), expected, remainder_bits)
    if seeds is not None:
        store.take(seed_segments(seeds))
    ends = segments.agg(F.min("seg_id").alias("lo"), F.max("seg_id").alias("hi")).first()
    numbers = []
    if ends["lo"] is not None:
        cuts = [ends["lo"] + (ends["hi"] + 1 - ends["lo"]) * k // intakes for k in range(intakes + 1)]
        numbers = [store.take(segments.filter((F.col("seg_id") >= lo) & (F.col("seg_id") < hi))) for lo, hi in zip(cuts[:-1], cuts[1:]) if lo < hi]
    return store, numbers


def seen_segments(segments: DataFrame, seeds: DataFrame | None = None, remainder_bits: int = REMAINDER_BITS, intakes: int = INTAKES) -> DataFrame:
    """(seg_id) of the rows whose key is a seed's or that of a segment with a smaller seg_id.

    Null, damaged and all-zero keys are none; rows with a null seg_id are left
    out, and repeated rows of one seg_id don't count against each other. Found by
    the stored filters; what they flag is checked, see :class:`SeenStore`.
    """
    store, numbers = take_all(segments, seeds, remainder_bits, intakes)
    return store.seen(numbers).select(F.col("seq").alias("seg_id"))


def filter_errors(segments: DataFrame, seeds: DataFrame | None = None, remainder_bits: int = REMAINDER_BITS, intakes: int = INTAKES) -> DataFrame:
    """Measured and derived errors of the filters, one row.

    A new key is flagged if another key's fingerprint equals its own. With f
    fingerprints in the range then, of 2^b possible ones, that has probability
    f / 2^b; ``derived_errors`` is the sum over the new keys. ``seen`` is counted
    by the exact keys, independent of the filters: ``wrong`` are rows flagged that
    aren't seen, ``missed`` those seen that aren't flagged, 0 if the filters work.
    """
    store, numbers = take_all(segments, seeds, remainder_bits, intakes)
    rows = keyed_rows(segments, store.bits, store.range_bits)
    if seeds is not None:
        rows = rows.unionByName(keyed_rows(seed_segments(seeds), store.bits, store.range_bits))
    first = rows.filter("stage = 2").groupBy("key").agg(F.min("seq").alias("first"))
    fresh = rows.filter("stage = 2").join(first, "key").select("seq", (F.col("seq") > F.col("first")).alias("exact"))
    exact = fresh.unionByName(rows.filter("stage = 1").select("seq", F.lit(True).alias("exact"))).filter("seq >= 0").groupBy("seq").agg(F.max("exact").alias("exact"), F.count("*").alias("n"))
    flagged = store._read("seen", numbers)
    for kind in ("candidate", "wrong"):
        flagged = flagged.unionByName(store._read(kind, numbers))
    flagged = flagged.groupBy("seq").agg(F.lit(True).alias("flagged"))
    both = exact.join(flagged, "seq", "left").withColumn("flagged", F.coalesce("flagged", F.lit(False)))
    count = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0)).cast("bigint")
    out = both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("keys"), *(F.coalesce(count(t), F.lit(0)).alias(c) for c, t in (("seen", F.col("exact")), ("wrong", F.col("flagged") & ~F.col("exact")), ("missed", ~F.col("flagged") & F.col("exact")))))
    derived = store._read("sum", numbers).agg(F.coalesce(F.sum("derived"), F.lit(0.0)).alias("derived_errors")).first()[0]
    keys = F.greatest(F.col("keys"), F.lit(1))
    return out.select("*", F.lit(derived).alias("derived_errors"), F.lit(store.bits).alias("fingerprint_bits"), ((F.col("wrong") + F.col("missed")) / keys).alias("measured_rate"), (F.lit(derived) / keys).alias("derived_rate"))
