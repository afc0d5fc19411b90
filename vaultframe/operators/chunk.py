"""Content-defined and fixed pieces of binary content, and what kind of data they hold.

A boundary follows from a rolling hash that restarts with each fragment and
multiplies by one constant where the byte is the one that last followed the same
byte, by another where it isn't. It falls where the hash is low once the fragment
has its least size, or where it has its greatest. Contents are hashed side by
side: step t handles byte t of every content of a slice at once, as numpy lanes, in
strips of bounded length; what is left of the last few goes on byte by byte.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed: multipliers of the rolling hash for a predicted and for another byte.
HIT, MISS = 314_159_265, 271_828_182
#: Contents hashed side by side, the least number for which that pays, and the bytes of each that are laid out at a time, whatever their lengths.
LANES, FEW, STRIP = 512, 12, 1 << 14


@dataclass
class Fragment:
    begin: int
    end: int
    hits: int
    table: bytes  # the byte that last followed each byte


def size_limits(f: int) -> tuple[int, int]:
    """Least and greatest size of a fragment whose mean is 1024 * 2^f bytes."""
    return 64 << f, 8128 << f


def fragments_of(contents: list[bytes], f: int = 6) -> list[list[Fragment]]:
    """Fragments of each content. An empty one has one of 0 bytes, and so does one whose last boundary is at its very end, after the others."""
    import numpy as np

    least, most = size_limits(f)
    low = np.uint32(1 << (22 - f)) if f <= 22 else np.uint32(0)
    out: list[list[Fragment]] = [[] for _ in contents]
    order = sorted(range(len(contents)), key=lambda k: len(contents[k]))
    for k in range(0, len(order), LANES):
        mine = order[k : k + LANES]
        lengths = np.array([len(contents[i]) for i in mine])
        n, longest = len(mine), int(lengths.max(initial=0))
        table = np.zeros((n, 256), np.uint8)
        h, last, hits, begin = np.zeros(n, np.uint32), np.zeros(n, np.intp), np.zeros(n, np.int64), np.zeros(n, np.int64)
        first, t = 0, 0
        while t < longest:
            if t % STRIP == 0:
                strip = np.zeros((min(STRIP, longest - t), n), np.uint8)
                for j in range(int(np.searchsorted(lengths, t, "right")), n):
                    piece = np.frombuffer(contents[mine[j]], np.uint8, min(STRIP, int(lengths[j]) - t), t)
                    strip[: len(piece), j] = piece
            while lengths[first] <= t:
                first += 1
            if n - first < FEW:
                break
            c = strip[t % STRIP, first:]
            lane = np.arange(first, n)
            hit = table[lane, last[first:]] == c
            h[first:] = (h[first:] + c + np.uint32(1)) * np.where(hit, np.uint32(HIT), np.uint32(MISS))
            hits[first:] += hit
            table[lane, last[first:]] = c
            last[first:] = c
            size = t + 1 - begin[first:]
            for j in first + np.flatnonzero((size >= most) | ((h[first:] < low) & (size >= least))):
                out[mine[j]].append(Fragment(int(begin[j]), t + 1, int(hits[j]), table[j].tobytes()))
                table[j] = 0
                h[j] = last[j] = hits[j] = 0
                begin[j] = t + 1
            t += 1
        else:
            first = n
        for j in range(n):
            if j < first or lengths[j] <= t:
                out[mine[j]].append(Fragment(int(begin[j]), int(lengths[j]), int(hits[j]), table[j].tobytes()))
            else:
                out[mine[j]] += _continued(contents[mine[j]], t, f, int(begin[j]), int(h[j]), int(last[j]), int(hits[j]), bytearray(table[j].tobytes()))
    return out


def _continued(content: bytes, at: int, f: int, start: int, h: int, last: int, hits: int, table: bytearray) -> list[Fragment]:
    """The rest of a content from byte ``at`` on, when too few lanes are left."""
    least, most = size_limits(f)
    low = 1 << (22 - f) if f <= 22 else 0
    out = []
    for at in range(at, len(content)):
        c = content[at]
        if table[last] == c:
            h = (h + c + 1) * HIT & 0xFFFFFFFF
            hits += 1
        else:
            h = (h + c + 1) * MISS & 0xFFFFFFFF
            table[last] = c
        last = c
        size = at + 1 - start
        if size >= most or (h < low and size >= least):
            out.append(Fragment(start, at + 1, hits, bytes(table)))
            h, last, hits, table, start = 0, 0, 0, bytearray(256), at + 1
    out.append(Fragment(start, len(content), hits, bytes(table)))
    return out


_ALNUM = frozenset(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz.,")
_CONTROL = frozenset([*range(9), 11, 12, *range(14, 32), *range(240, 256)])


def is_text(table: bytes) -> bool:
    """Letters, digits, points and commas are followed by blanks, and there is little that isn't text: control bytes, lead bytes without what must follow them."""
    score = 0
    for i, follows in enumerate(table):
        score += follows == 32 and i in _ALNUM
        score -= bool(follows) and (i in _CONTROL or (192 <= i < 240 and not 128 <= follows < 192))
    return score >= 3


def is_code(table: bytes) -> bool:
    """A byte that is common in x86 code follows at least five different ones."""
    return table.count(139) >= 5


#: Fixed: what the k-th byte that follows a further one costs of a piece's size, in 1/32768.
FOLLOWER_COST = [32768 // (204 * k) for k in range(1, 256)]


def redundancies(sizes, hits, tables, recent=None):
    """Bytes that could be saved of many pieces, each at most its size: the most of bytes predicted, unevenness of what follows what, share of bytes that nothing follows, and likeness to four recent tables.

    Numpy arrays of sizes and hits, of tables (n, 256), and of recent tables (n, 4, 256), where a table of zeros stands for none.
    """
    import numpy as np

    cost = np.array(FOLLOWER_COST, np.int64)
    out = np.zeros(len(sizes), np.int64)
    for at in range(0, len(sizes), 1024):
        size, t = np.asarray(sizes[at : at + 1024], np.int64), tables[at : at + 1024]
        n = len(size)
        rows = np.arange(n)[:, None]
        counts = np.bincount((rows * 256 + t).ravel(), minlength=n * 256).reshape(n, 256)
        # How many bytes follow more than k others, for each k.
        more = np.bincount((rows * 257 + counts).ravel(), minlength=n * 257).reshape(n, 257)[:, ::-1].cumsum(1)[:, ::-1][:, 1:256]
        left = size - (more * (size[:, None] * cost >> 15)).sum(1)
        never = np.minimum(counts[:, 0], 255) * size // 256
        alike = 4 * counts[:, 0] if recent is None else (recent[at : at + 1024] == t[:, None, :]).sum((1, 2))
        best = np.maximum.reduce([np.asarray(hits[at : at + 1024], np.int64), left * left // np.maximum(size, 1), never, alike * size // 1024])
        out[at : at + n] = np.minimum(size, best)
    return out


def chunk_content(files: DataFrame, key: str, content: str, f: int = 6, tables: bool = False) -> DataFrame:
    """(key, pos, off, len, sha1, hits, is_text, is_code, redundancy): fragments of each content; a null content has none.

    The redundancy is that of a piece by itself; for what it has in common with
    those before it, ``tables`` adds a column ``table``.
    """

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        names = [key, "pos", "off", "len", "sha1", "hits", "is_text", "is_code", "table"]
        for batch in (whole.slice(k, LANES) for whole in batches for k in range(0, max(whole.num_rows, 1), LANES)):
            keys, data = batch.column(0), batch.column(1).to_pylist()
            some = [k for k, d in enumerate(data) if d is not None]
            at, cols = [], [[] for _ in names[1:]]
            for k, pieces in zip(some, fragments_of([data[k] for k in some], f)):
                for pos, x in enumerate(pieces):
                    at.append(k)
                    for c, v in zip(cols, (pos, x.begin, x.end - x.begin, hashlib.sha1(data[k][x.begin : x.end]).digest(), x.hits, is_text(x.table), is_code(x.table), x.table)):
                        c.append(v)
            saved = redundancies(cols[2], cols[4], np.frombuffer(b"".join(cols[-1]), np.uint8).reshape(-1, 256))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())
            made = [keys.take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds))]
            made.insert(-1, pa.array(saved))
            yield pa.RecordBatch.from_arrays(made if tables else made[:-1], [*names[:-1], "redundancy", *(names[-1:] if tables else [])])

    kind = files.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, pos int, off bigint, len bigint, sha1 binary, hits bigint, is_text boolean, is_code boolean, redundancy bigint{', table binary' if tables else ''}"
    return files.select(key, F.col(content).cast("binary")).mapInArrow(run, schema)


def chunk_fixed(files: DataFrame, key: str, content: str, nbytes: int) -> DataFrame:
    """(key, pos, off, len, sha1): pieces of ``nbytes`` bytes; an empty content has one of 0 bytes, a null one none."""
    data = files.select(key, F.col(content).cast("binary").alias("_d")).filter("_d is not null")
    last = F.greatest(F.ceil(F.octet_length("_d") / nbytes) - 1, F.lit(0)).cast("int")
    rows = data.select(key, "_d", F.explode(F.sequence(F.lit(0), last)).alias("pos"))
    piece = F.substring(F.col("_d"), F.col("pos") * nbytes + 1, F.lit(nbytes))
    return rows.select(key, "pos", (F.col("pos") * nbytes).cast("bigint").alias("off"), piece.alias("_p")).select(key, "pos", "off", F.octet_length("_p").cast("bigint").alias("len"), F.sha1("_p").alias("sha1"))
