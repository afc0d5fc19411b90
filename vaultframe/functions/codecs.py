"""Methods of compression: a transform and a model, described by a string that travels with the data.

``store``; ``zstd`` or ``zstd:LEVEL``; or ``xB,T,...`` with B the size class, T the
transform (1 LZ77 packed, 2 LZ77 in bytes, 3 Burrows-Wheeler, 4 added for call
targets first), its numbers, and model commands: ``cN...`` direct contexts, ``iN...``
a chain of indirect ones, ``a`` match, ``w`` words, ``m`` mixer, ``t`` average of two,
``s`` refinement.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from vaultframe.functions import mixing_model as mm
from vaultframe.functions import transforms as tr


#: Beginning of a packed content, by which it is found in a stream.
MAGIC = b"\x8eVF1\x1a"


@dataclass
class CodecSpec:
    kind: str
    level: int = 3
    size_class: int = 0
    transform: int = 0
    code: bool = False
    numbers: list[int] = field(default_factory=list)
    models: list[tuple[str, list[int]]] = field(default_factory=list)

    @property
    def least_match(self) -> int:
        return max(self.numbers[0], 1) if self.numbers and self.numbers[0] else 4


def parse_method(method: str) -> CodecSpec:
    """ValueError for what is no method."""
    if method in ("store", "") or re.fullmatch(r"0\d*(,0)?", method):
        return CodecSpec("store")
    if m := re.fullmatch(r"zstd(?::(\d+))?", method):
        return CodecSpec("zstd", int(m[1] or 3))
    m = re.fullmatch(r"x(\d+)(?:,(\d+(?:,\d+)*))?((?:[a-z]\d*(?:,\d+)*)*)", method)
    if not m:
        raise ValueError(f"{method!r} is no method")
    numbers = [int(x) for x in (m[2] or "0").split(",")]
    if numbers[0] > 7:
        raise ValueError(f"{method!r}: no such transform")
    models = [(x[0], [int(n) for n in re.findall(r"\d+", x[1])]) for x in re.findall(r"([a-z])((?:\d+)?(?:,\d+)*)", m[3])]
    if bad := [c for c, _ in models if c not in "ciamtsw"]:
        raise ValueError(f"{method!r}: no such model {bad[0]!r}")
    return CodecSpec("x", 0, int(m[1]), numbers[0] % 4, numbers[0] >= 4, numbers[1:], models)


def build_model(spec: CodecSpec):
    """Components of a method, each with its context; numbers that only set the size of a table don't count.

    ``c``: count (0 indirect, to 255 direct, 256 and more a constant; thousands are
    sizes), offset (to 255 the place in periods of so many bytes, from 1000 the
    distance to the last byte offset - 1000), masks of the bytes before, the last
    first: from 256 with the state of the LZ77 code, more than 1000 for so many
    bytes that don't count. ``i``: orders that are added to the context before it.
    ``w``: number of words, first letter, letters, mask of a letter's bits. ``m`` and
    ``t``: bits of the context and rate; ``s``: bits, first count, most / 4.
    """
    out: list = []
    at = lambda n, k, default: n[k] if len(n) > k else default
    for c, n in spec.models:
        if c == "c":
            masks: list[int] = []
            for x in n[2:]:
                masks += [0] * (x - 1000) if x > 1000 else [x]
            count = at(n, 0, 0) % 1000
            out.append((mm.Const(128) if count > 255 else mm.CM(4 * count) if count else mm.ICM(), ("masks", at(n, 1, 0), tuple(masks))))
        elif c == "i":
            base, top = (out[-1][1] if out else 0), 0
            if isinstance(base, tuple) and base[0] == "order":
                base, top = base[2], base[1]
            for step in n or [1]:
                top += step % 10
                out.append((mm.ISSE(len(out) - 1), ("order", top, base)) if out else (mm.ICM(), ("order", top, 0)))
        elif c == "a":
            out.append((mm.Match(), 0))
        elif c == "w":
            for k in range(1, max(at(n, 0, 1), 1) + 1):
                context = ("words", k, at(n, 1, 65), at(n, 2, 26), at(n, 3, 223))
                out.append((mm.ISSE(len(out) - 1) if k > 1 else mm.ICM(), context))
        elif c == "m":
            out.append((mm.Mix(range(len(out)), at(n, 1, 24) / 1200), ("bits", at(n, 0, 8)))) if out else None
        elif c == "t" and len(out) > 1:
            out.append((mm.Mix2(len(out) - 2, len(out) - 1, at(n, 1, 24) / 1200), ("bits", at(n, 0, 8))))
        elif c == "s" and out:
            out.append((mm.SSE(len(out) - 1, at(n, 1, 32), 4 * at(n, 2, 255)), ("bits", at(n, 0, 8))))
    return out


def codec_memory(method: str, size: int) -> int:
    """Bytes that packing or unpacking ``size`` bytes may take, for sizing tasks: the tables of each component and of the transform."""
    spec = parse_method(method)
    if spec.kind != "x":
        return 3 * size + (1 << 23)
    return 2 * size + (40 * size if spec.transform == 3 else 100 * size if spec.transform else 0) + 8 * 120 * size * len(spec.models)


def pack_bytes(content: bytes, method: str) -> bytes:
    """Self-describing form: method, size and SHA-1 of the content, then its code."""
    spec = parse_method(method)
    if spec.kind == "zstd":
        import zstandard

        body = zstandard.ZstdCompressor(level=spec.level).compress(content)
    elif spec.kind == "store":
        body = content
    else:
        body = tr.call_targets(content) if spec.code else content
        if spec.transform == 1:
            body = tr.lz_packed(body, spec.least_match)
        elif spec.transform == 2:
            body = tr.lz_bytes(body, spec.least_match)
        elif spec.transform == 3:
            body = tr.bwt(body)
        if spec.models:
            body = len(body).to_bytes(8, "little") + mm.encode_bits(body, build_model(spec))
    name = method.encode()
    return MAGIC + bytes([len(name)]) + name + len(content).to_bytes(8, "little") + len(body).to_bytes(8, "little") + hashlib.sha1(content).digest() + body


def header(packed: bytes, at: int = 0) -> dict:
    """Method, size, sha1, and begin and end of the body of the packed content at a place; nothing is unpacked. ValueError if there is none."""
    try:
        if packed[at : at + 5] != MAGIC:
            raise ValueError
        body = at + 6 + packed[at + 5] + 36
        method = packed[at + 6 : body - 36].decode("ascii")
        parse_method(method)
        size, length = (int.from_bytes(packed[body - k : body - k + 8], "little") for k in (36, 28))
        if body + length > len(packed):
            raise ValueError
    except (ValueError, IndexError, UnicodeDecodeError) as e:
        raise ValueError("no packed content here") from e
    return {"method": method, "size": size, "sha1": packed[body - 20 : body], "begin": body, "end": body + length}


def method_of(packed: bytes) -> str:
    return header(packed)["method"]


def unpack_prefix(packed: bytes, limit: int) -> bytes:
    """The first ``limit`` bytes of the content, without more work than they need where the method goes from front to back; no checksum is tested."""
    head = header(packed)
    spec, body, limit = parse_method(head["method"]), packed[head["begin"] : head["end"]], min(limit, head["size"])
    if spec.kind == "store":
        return body[:limit]
    if spec.kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().stream_reader(body).read(limit)
    if spec.kind == "x" and not spec.code and spec.transform in (0, 1):
        if spec.models:
            coded = int.from_bytes(body[:8], "little")
            if spec.transform == 0:
                return mm.decode_bits(body[8:], min(coded, limit), build_model(spec))
            body = mm.decode_bits(body[8:], coded, build_model(spec))
        return tr.unlz_packed(body, limit)[:limit] if spec.transform else body[:limit]
    return unpack_bytes(packed)[:limit]


def unpack_bytes(packed: bytes) -> bytes:
    """The content; ValueError if the code is damaged or the checksum differs."""
    head = header(packed)
    spec, size, digest, body = parse_method(head["method"]), head["size"], head["sha1"], packed[head["begin"] : head["end"]]
    try:
        if spec.kind == "zstd":
            import zstandard

            body = zstandard.ZstdDecompressor().decompress(body, max_output_size=size)
        elif spec.kind == "x":
            if spec.models:
                body = mm.decode_bits(body[8:], int.from_bytes(body[:8], "little"), build_model(spec))
            if spec.transform == 1:
                body = tr.unlz_packed(body, size)
            elif spec.transform == 2:
                body = tr.unlz_bytes(body, spec.least_match)
            elif spec.transform == 3:
                body = tr.unbwt(body)
            body = tr.call_targets(body, -1) if spec.code else body
    except Exception as e:  # noqa: BLE001
        raise ValueError(f"damaged code: {e}") from e
    if len(body) != size or hashlib.sha1(body).digest() != digest:
        raise ValueError("the checksum differs")
    return body


def _mapped(frame: DataFrame, column: str, schema: str, work) -> DataFrame:
    """Replaces a binary column by what ``work`` makes of each value and its row's other columns; a few rows at a time."""
    names = [c for c in frame.columns if c != column]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                made = work(part.column(column).to_pylist(), part)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *made.values()], [*names, *made])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name != column)
    return frame.mapInArrow(run, f"{kept}{', ' if kept else ''}{schema}")


def pack_column(frame: DataFrame, column: str, method: str | None = None, method_col: str | None = None) -> DataFrame:
    """Packs a binary column with one method, or with that of another column; null stays null."""

    def work(values, part):
        import pyarrow as pa

        methods = part.column(method_col).to_pylist() if method_col else [method] * len(values)
        return {column: pa.array([None if v is None else pack_bytes(v, m or "store") for v, m in zip(values, methods)], pa.binary())}

    return _mapped(frame, column, f"`{column}` binary", work)


def unpack_column(frame: DataFrame, column: str, error_col: str = "unpack_error") -> DataFrame:
    """Unpacks a binary column; a damaged value becomes null, with the reason in ``error_col``, and the others are not touched by it."""

    def work(values, part):
        import pyarrow as pa

        out, errors = [], []
        for v in values:
            try:
                out.append(None if v is None else unpack_bytes(v))
                errors.append(None)
            except (ValueError, IndexError) as e:
                out.append(None)
                errors.append(str(e)[:200])
        return {column: pa.array(out, pa.binary()), error_col: pa.array(errors, pa.string())}

    return _mapped(frame, column, f"`{column}` binary, `{error_col}` string", work)


def scan_packed(frame: DataFrame, key: str, column: str) -> DataFrame:
    """(key, offset, packed_bytes, method, usize, sha1): the packed contents in a stream of bytes, such as an archive written one after the other. What lies between them, damaged or foreign, is passed over up to the next beginning."""

    def run(batches):
        import pyarrow as pa

        names = [key, "offset", "packed_bytes", "method", "usize", "sha1"]
        for batch in batches:
            at, cols = [], [[] for _ in names[1:]]
            for k, data in enumerate(batch.column(1).to_pylist()):
                place = (data or b"").find(MAGIC)
                while place >= 0:
                    try:
                        head = header(data, place)
                    except ValueError:
                        place = data.find(MAGIC, place + 1)
                        continue
                    at.append(k)
                    for c, v in zip(cols, (place, head["end"] - place, head["method"], head["size"], head["sha1"])):
                        c.append(v)
                    place = data.find(MAGIC, head["end"])
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds))], names)

    kind = frame.schema[key].dataType.simpleString()
    return frame.select(key, column).mapInArrow(run, f"`{key}` {kind}, offset bigint, packed_bytes bigint, method string, usize bigint, sha1 binary")
