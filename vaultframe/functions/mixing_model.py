"""Context mixing: predictors of the next bit, and a binary arithmetic coder.

A model is a list of components; each predicts the next bit in the logistic domain
from its own context and, for some, from earlier components. The last one's
prediction is coded. The kinds: CONST, CM, ICM, MATCH, AVG, MIX2, MIX, ISSE, SSE.
Everything is slow, byte by byte in Python, and meant for small cold blocks.
"""

from __future__ import annotations

import math

_SQUASH = [min(max(1 / (1 + math.exp(-x / 256)), 1 / 4096), 4095 / 4096) for x in range(-2048, 2048)]


def squash(x: float) -> float:
    return _SQUASH[min(max(int(x * 256), -2048), 2047) + 2048]


def stretch(p: float) -> float:
    return math.log(p / (1 - p))


class Component:
    """Predicts with ``predict(context, inputs)``; learns with ``update(bit)``."""

    def predict(self, ctx, x):
        raise NotImplementedError

    def update(self, bit):
        pass


class Const(Component):
    def __init__(self, c):
        self.p = (c - 128) / 16

    def predict(self, ctx, x):
        return self.p


class CM(Component):
    """Context to prediction; the rate falls with the context's count down to 1/limit."""

    def __init__(self, limit=1023):
        self.t, self.limit = {}, limit

    def predict(self, ctx, x):
        self.at = ctx
        self.cell = self.t.get(ctx) or (0.5, 1.5)
        return stretch(self.cell[0])

    def update(self, bit):
        p, n = self.cell
        p += (bit - p) / n
        self.t[self.at] = (min(max(p, 1 / 4096), 4095 / 4096), min(n + 1, self.limit))


class History(Component):
    """Context to a short history of bits: how many zeros and ones, at most a few, and the last bit."""

    def __init__(self):
        self.h = {}

    def look(self, ctx):
        self.at = ctx
        self.state = self.h.get(ctx, (0, 0, 0))
        return self.state

    def note(self, bit):
        zeros, ones, _ = self.state
        if bit:
            ones, zeros = min(ones + 1, 40), min(zeros, 2 + (zeros > 5))
        else:
            zeros, ones = min(zeros + 1, 40), min(ones, 2 + (ones > 5))
        self.h[self.at] = (zeros, ones, bit)


class ICM(History):
    """Context to history, history to prediction."""

    def __init__(self):
        super().__init__()
        self.p = {}

    def predict(self, ctx, x):
        zeros, ones, _ = s = self.look(ctx)
        self.cur = self.p.get(s, (ones + 0.4) / (zeros + ones + 0.8))
        return stretch(min(max(self.cur, 1 / 4096), 4095 / 4096))

    def update(self, bit):
        self.p[self.state] = self.cur + (bit - self.cur) / 64
        self.note(bit)


class Match(Component):
    """Predicts the bit that followed the last occurrence of the context, the more surely the longer the match."""

    def __init__(self, order=6):
        self.order, self.last, self.buf, self.ptr, self.len, self.bits = order, {}, bytearray(), 0, 0, 0

    def predict(self, ctx, x):
        self.bit = None
        if self.len:
            self.bit = self.buf[self.ptr] >> (7 - self.bits) & 1
            return (1 if self.bit else -1) * min(self.len, 32) / 6
        return 0.0

    def update(self, bit):
        if self.bit is not None and self.bit != bit:
            self.len = 0
        self.bits = (self.bits + 1) & 7

    def byte(self, c):
        self.buf.append(c)
        if self.len:
            self.len, self.ptr = self.len + 1, self.ptr + 1
        key = bytes(self.buf[-self.order :])
        if not self.len and len(self.buf) >= self.order:
            self.ptr = self.last.get(key, 0)
            while self.ptr and self.len < 32 and self.ptr > self.len and self.buf[self.ptr - 1 - self.len] == self.buf[-1 - self.len]:
                self.len += 1
        self.last[key] = len(self.buf)


class Avg(Component):
    def __init__(self, j, k, weight):
        self.j, self.k, self.w = j, k, weight / 256

    def predict(self, ctx, x):
        return x[self.j] * self.w + x[self.k] * (1 - self.w)


class Mix(Component):
    """Weighted sum of inputs, with weights by context that follow the error."""

    def __init__(self, inputs, rate=0.02, start=None):
        self.inputs, self.rate, self.start, self.w = list(inputs), rate, 1 / len(inputs) if start is None else start, {}

    def predict(self, ctx, x):
        self.x = [x[j] for j in self.inputs]
        self.weights = self.w.setdefault(ctx, [self.start] * len(self.x))
        self.out = min(max(sum(a * b for a, b in zip(self.weights, self.x)), -8), 8)
        return self.out

    def update(self, bit):
        e = (bit - squash(self.out)) * self.rate
        w = self.weights
        for k, v in enumerate(self.x):
            w[k] += e * v


class Mix2(Component):
    """Two inputs, with weights that sum to 1."""

    def __init__(self, j, k, rate=0.02):
        self.j, self.k, self.rate, self.w = j, k, rate, {}

    def predict(self, ctx, x):
        self.at, self.a, self.b, self.cur = ctx, x[self.j], x[self.k], self.w.get(ctx, 0.5)
        self.out = self.cur * self.a + (1 - self.cur) * self.b
        return self.out

    def update(self, bit):
        self.w[self.at] = min(max(self.cur + (bit - squash(self.out)) * (self.a - self.b) * self.rate, 0), 1)


class ISSE(History):
    """An input and a constant, mixed with weights that the context's history selects."""

    def __init__(self, j):
        super().__init__()
        self.j, self.w = j, {}

    def predict(self, ctx, x):
        zeros, ones, _ = s = self.look(ctx)
        self.cur, self.x = self.w.get(s) or (1.0, stretch((ones + 0.4) / (zeros + ones + 0.8)) / 4), x[self.j]
        self.out = min(max(self.cur[0] * self.x + self.cur[1], -8), 8)
        return self.out

    def update(self, bit):
        e = (bit - squash(self.out)) * 0.02
        self.w[self.state] = (self.cur[0] + e * self.x, self.cur[1] + e)
        self.note(bit)


class SSE(Component):
    """An input's prediction refined by context, between the two nearest of 33 steps."""

    def __init__(self, j, start=8, limit=255):
        self.j, self.start, self.limit, self.t = j, start, limit, {}

    def predict(self, ctx, x):
        pos = (min(max(x[self.j], -7.99), 7.99) + 8) * 2
        low = int(pos)
        frac = pos - low
        self.cells = []
        out = 0.0
        for k, w in ((low, 1 - frac), (low + 1, frac)):
            p, n = self.t.get((ctx, k)) or (squash(k / 2 - 8), self.start)
            out += p * w
            self.cells.append(((ctx, k), p, n, w))
        return stretch(min(max(out, 1 / 4096), 4095 / 4096))

    def update(self, bit):
        key, p, n, _ = max(self.cells, key=lambda c: c[3])
        self.t[key] = (p + (bit - p) / (n + 1.5), min(n + 1, self.limit))


class Predictor:
    """Runs a model over a sequence of bits, high bit of each byte first.

    ``model``: a list of (component, context). A context is a number of bytes before;
    ("masks", offset, masks), ("order", n, base) for n bytes together with another
    context, ("words", k, first letter, letters, mask) for the last k words, or
    ("bits", n) for the last n bits, those of the byte so far included. All but the
    last stand together with the bits of the byte so far.
    """

    def __init__(self, model):
        self.parts = [c for c, _ in model]
        self.orders = [o for _, o in model]
        self.past, self.c0, self.last = bytearray(), 1, [0] * 256
        #: Words so far by their letters, the latest first; state of a byte-aligned LZ77 code: bytes left of literals or an offset.
        self.words = {o[2:]: [0] for o in self.orders if isinstance(o, tuple) and o[0] == "words"}
        self.left, self.state = 0, 0
        self._contexts()

    def _context(self, o):
        past = self.past
        if not isinstance(o, tuple):
            return bytes(past[-o:]) if o else b""
        if o[0] == "order":
            return bytes(past[-o[1] :]) if o[1] else b"", self._context(o[2])
        if o[0] == "words":
            return tuple(self.words[o[2:]][: o[1]])
        if o[0] == "bits":
            return (past[-1] >> (16 - min(o[1], 16)) if past else 0) if o[1] > 8 else 0
        place = 0
        if 0 < o[1] < 256:
            place = len(past) % o[1]
        elif o[1] >= 1000:
            place = min(len(past) - self.last[(o[1] - 1000) & 255], 255)
        return place, tuple((past[-1 - k] if k < len(past) else 0) & m & 255 for k, m in enumerate(o[2]) if m & 255), self.state if any(m > 255 for m in o[2]) else None

    def _contexts(self):
        self.ctx = [(self._context(o), isinstance(o, tuple) and o[0] == "bits" and o[1] == 0) for o in self.orders]

    def p(self) -> float:
        x, c0 = [], self.c0
        for part, (c, alone) in zip(self.parts, self.ctx):
            x.append(part.predict((c, 0 if alone else c0), x))
        return squash(x[-1])

    def update(self, bit: int) -> None:
        for part in self.parts:
            part.update(bit)
        self.c0 = self.c0 << 1 | bit
        if self.c0 >= 256:
            c = self.c0 & 255
            self.past.append(c)
            self.last[c] = len(self.past)
            for (first, letters, mask), words in self.words.items():
                if first <= c & mask < first + letters or c >= 128:
                    words[0] = (words[0] + c + 1) * 773 & 0xFFFFFFFF
                elif words[0]:
                    words.insert(0, 0)
                    del words[8:]
            if self.left:
                self.left -= 1
                self.state = self.state if self.left else 0
            else:
                self.state = 1 if c < 64 else 2
                self.left = c + 1 if c < 64 else (c >> 6) + 1
            for part in self.parts:
                if isinstance(part, Match):
                    part.byte(c)
            self.c0 = 1
            self._contexts()


def encode_bits(data: bytes, model) -> bytes:
    """Arithmetic code of all bits of ``data``."""
    pred, low, high, out = Predictor(model), 0, 0xFFFFFFFF, bytearray()
    for c in data:
        for k in range(7, -1, -1):
            bit = c >> k & 1
            mid = low + int((high - low) * pred.p())
            low, high = (low, mid) if bit else (mid + 1, high)
            pred.update(bit)
            while not (low ^ high) >> 24:
                out.append(high >> 24)
                low, high = low << 8 & 0xFFFFFFFF, high << 8 & 0xFFFFFFFF | 255
    return bytes(out) + high.to_bytes(4, "big")


def decode_bits(coded: bytes, size: int, model) -> bytes:
    pred, low, high, out = Predictor(model), 0, 0xFFFFFFFF, bytearray()
    code, at = int.from_bytes(coded[:4], "big"), 4
    for _ in range(size):
        c = 1
        while c < 256:
            mid = low + int((high - low) * pred.p())
            bit = int(code <= mid)
            low, high = (low, mid) if bit else (mid + 1, high)
            pred.update(bit)
            c = c << 1 | bit
            while not (low ^ high) >> 24:
                low, high = low << 8 & 0xFFFFFFFF, high << 8 & 0xFFFFFFFF | 255
                code = code << 8 & 0xFFFFFFFF | (coded[at] if at < len(coded) else 0)
                at += 1
        out.append(c & 255)
    return bytes(out)
