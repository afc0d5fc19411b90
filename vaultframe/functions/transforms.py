"""Reversible transforms of binary content: x86 call targets, LZ77 in two codes, Burrows-Wheeler."""

from __future__ import annotations


def call_targets(data: bytes, sign: int = 1) -> bytes:
    """Relative addresses of x86 calls and jumps (E8 or E9, three bytes, then 00 or FF) become absolute by adding their place, or relative again with sign -1."""
    out = bytearray(data)
    places = range(len(out) - 5, -1, -1) if sign > 0 else range(len(out) - 4)
    for i in places:
        if out[i] in (0xE8, 0xE9) and out[i + 4] in (0, 0xFF):
            out[i + 1 : i + 4] = (int.from_bytes(out[i + 1 : i + 4], "little") + sign * i & 0xFFFFFF).to_bytes(3, "little")
    return bytes(out)


def suffix_array(data: bytes):
    """Order of the suffixes, by doubling the length of the prefixes that are ranked."""
    import numpy as np

    n = len(data)
    rank = np.frombuffer(data, np.uint8).astype(np.int64) + 1
    width, order = 1, np.argsort(rank, kind="stable")
    while n:
        after = np.zeros(n, np.int64)
        after[: max(n - width, 0)] = rank[width:] if width < n else 0
        key = rank * (n + 258) + after
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate(([1], key[order][1:] != key[order][:-1])))
        if new[order[-1]] == n:
            break
        rank, width = new, width * 2
    return order


def bwt(data: bytes) -> bytes:
    """The byte before each suffix in their order, the empty one first; 255 where the text begins, and that place in the last four bytes."""
    import numpy as np

    order = np.concatenate(([len(data)], suffix_array(data)))
    text = np.frombuffer(data, np.uint8)
    out = np.full(len(order), 255, np.uint8)
    inside = order > 0
    out[inside] = text[order[inside] - 1]
    return out.tobytes() + int(np.flatnonzero(~inside)[0]).to_bytes(4, "little")


def unbwt(coded: bytes) -> bytes:
    import numpy as np

    last, start = np.frombuffer(coded[:-4], np.uint8), int.from_bytes(coded[-4:], "little")
    n = len(last)
    key = last.astype(np.int64) + 1
    key[start] = 0
    follow = np.argsort(key, kind="stable")
    out, at = np.empty(n, np.uint8), start
    steps = follow.tolist()
    for i in range(n - 1):
        at = steps[at]
        out[i] = last[at]
    return out[: n - 1].tobytes()


def matches(data: bytes, least: int, tries: int = 8, most: int = 1 << 16):
    """Greedy parse: (literal bytes from, to, match length, offset), with up to ``tries`` earlier places of the next bytes compared; the last has length 0."""
    width, seen, i, literal, n = max(least, 4), {}, 0, 0, len(data)
    while i + width <= n:
        key = data[i : i + width]
        best, where = 0, 0
        for j in reversed(seen.get(key, ())):
            k = width
            while i + k < n and k < most and data[j + k] == data[i + k]:
                k += 1
            if k > best:
                best, where = k, j
        step = best or 1
        if best:
            yield literal, i, best, i - where
            literal = i + best
        for p in range(i, min(i + step, n - width + 1), 1 if step < 64 else 8):
            places = seen.setdefault(data[p : p + width], [])
            places.append(p)
            if len(places) > tries:
                del places[0]
        i += step
    yield literal, n, 0, 0


class _Bits:
    def __init__(self, data: bytes = b""):
        self.value, self.n, self.at = int.from_bytes(data, "little"), 0, 0
        self.parts: list[tuple[int, int]] = []

    def put(self, x: int, n: int) -> None:
        self.parts.append((x & ((1 << n) - 1), n))

    def done(self) -> bytes:
        out, acc, n = bytearray(), 0, 0
        for x, k in self.parts:
            acc |= x << n
            n += k
            while n >= 8:
                out.append(acc & 255)
                acc >>= 8
                n -= 8
        if n:
            out.append(acc)
        return bytes(out)


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.pos, self.acc, self.n = data, 0, 0, 0

    def get(self, k: int) -> int:
        while self.n < k:
            self.acc |= (self.data[self.pos] if self.pos < len(self.data) else 0) << self.n
            self.pos += 1
            self.n += 8
        x = self.acc & ((1 << k) - 1)
        self.acc >>= k
        self.n -= k
        return x

    def left(self) -> bool:
        return self.pos < len(self.data) or self.acc != 0


def _gamma(bits: _Bits, x: int, low: int = 0) -> None:
    """Bits of x below the highest, down to bit ``low``, each after a 1; then a 0."""
    for k in range(x.bit_length() - 2, low - 1, -1):
        bits.put(1, 1)
        bits.put(x >> k, 1)
    bits.put(0, 1)


def _ungamma(r: _Reader) -> int:
    x = 1
    while r.get(1):
        x = x << 1 | r.get(1)
    return x


def lz_packed(data: bytes, least: int = 4, tries: int = 8) -> bytes:
    """LZ77 with codes of variable length, packed from the low bit: ``00``, length, literals; or two and three bits with the number of offset bits, length/4, length%4, offset."""
    bits = _Bits()
    for begin, end, length, offset in matches(data, max(least, 4), tries):
        if end > begin:
            bits.put(0, 2)
            _gamma(bits, end - begin)
            for c in data[begin:end]:
                bits.put(c, 8)
        if length:
            width = offset.bit_length() - 1
            bits.put(width + 8 >> 3, 2)
            bits.put(width & 7, 3)
            _gamma(bits, length, 2)
            bits.put(length, 2)
            bits.put(offset, width)
    return bits.done()


def unlz_packed(coded: bytes, size: int) -> bytes:
    r, out = _Reader(coded), bytearray()
    while len(out) < size:
        kind = r.get(2)
        if kind == 0:
            out += bytes(r.get(8) for _ in range(_ungamma(r)))
        else:
            width = kind * 8 + r.get(3) - 8
            length = _ungamma(r) << 2
            length |= r.get(2)
            _copy(out, length, 1 << width | r.get(width))
    return bytes(out)


def _copy(out: bytearray, length: int, offset: int) -> None:
    if not 0 < offset <= len(out):
        raise ValueError("a match begins before the data")
    begin = len(out) - offset
    while length > 0:
        piece = out[begin : begin + min(length, offset)]
        out += piece
        length -= len(piece)


def lz_bytes(data: bytes, least: int = 4, tries: int = 8) -> bytes:
    """LZ77 in whole bytes: a count of 1..64 literals; or a match's length from ``least`` on with 2 to 4 bytes of offset less one, high byte first."""
    out = bytearray()
    for begin, end, length, offset in matches(data, least, tries):
        for k in range(begin, end, 64):
            piece = data[k : min(k + 64, end)]
            out.append(len(piece) - 1)
            out += piece
        width = max(2, ((offset - 1).bit_length() + 7) // 8)
        while length:
            part = min(length, least + 63)
            if 0 < length - part < least:
                part = length - least
            out.append((width - 1) * 64 + part - least)
            out += (offset - 1).to_bytes(width, "big")
            length -= part
    return bytes(out)


def unlz_bytes(coded: bytes, least: int = 4) -> bytes:
    out, i = bytearray(), 0
    while i < len(coded):
        kind, low = divmod(coded[i], 64)
        i += 1
        if kind == 0:
            out += coded[i : i + low + 1]
            i += low + 1
        else:
            _copy(out, low + least, int.from_bytes(coded[i : i + kind + 1], "big") + 1)
            i += kind + 1
    return bytes(out)
