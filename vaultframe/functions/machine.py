"""User programs over bytes: a small register machine, safe to run on data of others.

Registers A, B, C, D and R0..R255 and the words of H hold 32 bits, M holds bytes; B and
C point into M, D into H. A program runs once for each byte of its input, with the byte
in A, and once more at the end with 2^32 - 1; memory lasts between the calls. ``out``
appends A to the output.

Source is words apart by blanks, with nested comments in parentheses, in any case:
``x=0 x++ x-- x! x<>a x=y x= N`` for a, b, c, d, *b, *c, *d; ``a+= a-= a*= a/= a%= a&= a&~
a|= a^= a<<= a>>= a== a< a>`` with a register or a number; ``x=r N r=a N hash hashd out
halt error``; ``if ifnot else endif do while until forever``; ``$N`` and ``$N+M`` for the
program's arguments. Instructions are compiled to Python closures, jumps to indices.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

U32 = 0xFFFFFFFF
_PLACES = ("a", "b", "c", "d", "*b", "*c", "*d")
_BINARY: dict[str, Callable[[int, int], int]] = {
    "+=": lambda a, x: a + x,
    "-=": lambda a, x: a - x,
    "*=": lambda a, x: a * x,
    "/=": lambda a, x: a // x if x else 0,
    "%=": lambda a, x: a % x if x else 0,
    "&=": lambda a, x: a & x,
    "&~": lambda a, x: a & ~x,
    "|=": lambda a, x: a | x,
    "^=": lambda a, x: a ^ x,
    "<<=": lambda a, x: a << (x & 31),
    ">>=": lambda a, x: a >> (x & 31),
}
_TESTS: dict[str, Callable[[int, int], bool]] = {"==": lambda a, x: a == x, "<": lambda a, x: a < x, ">": lambda a, x: a > x}


class ProgramError(ValueError):
    """What is wrong with a source, with its line, or with a run."""


def _words(source: str) -> Iterator[tuple[str, int]]:
    depth = 0
    for line, text in enumerate(source.lower().splitlines(), 1):
        for word in re.findall(r"[()]|[^\s()]+", text):
            depth += (word == "(") - (word == ")")
            if depth < 0:
                raise ProgramError(f"line {line}: no comment is open")
            if not depth and word != ")":
                yield word, line
    if depth:
        raise ProgramError("a comment isn't closed")


class Machine:
    """A compiled program and its state. ``h_bits`` and ``m_bits``: sizes of H and M; ``steps``: instructions that one call may take."""

    def __init__(self, source: str, h_bits: int = 8, m_bits: int = 8, args: tuple[int, ...] = (), steps: int = 10_000_000):
        self.args, self.steps = args, steps
        self.code: list[Callable[[], int | None]] = []
        self.h_mask, self.m_mask = (1 << h_bits) - 1, (1 << m_bits) - 1
        self.reset()
        self._compile(list(_words(source)))

    def reset(self) -> None:
        self.reg: dict[str, int] = {"a": 0, "b": 0, "c": 0, "d": 0}
        self.r, self.f, self.out = [0] * 256, False, bytearray()
        self.h, self.m = [0] * (self.h_mask + 1), bytearray(self.m_mask + 1)

    def _get(self, place: str) -> int:
        if place in self.reg:
            return self.reg[place]
        return self.h[self.reg["d"] & self.h_mask] if place == "*d" else self.m[self.reg[place[1]] & self.m_mask]

    def _set(self, place: str, x: int) -> None:
        if place in self.reg:
            self.reg[place] = x & U32
        elif place == "*d":
            self.h[self.reg["d"] & self.h_mask] = x & U32
        else:
            self.m[self.reg[place[1]] & self.m_mask] = x & 255

    def _number(self, word: str, line: int) -> int:
        if m := re.fullmatch(r"\$([1-9])(?:\+(\d+))?", word):
            return (self.args[int(m[1]) - 1] if int(m[1]) <= len(self.args) else 0) + int(m[2] or 0)
        if not re.fullmatch(r"-?\d+", word):
            raise ProgramError(f"line {line}: {word!r} where a number belongs")
        return int(word)

    def _compile(self, words: list[tuple[str, int]]) -> None:
        code, open_, at = self.code, [], 0

        def number(line):
            nonlocal at
            at += 1
            if at >= len(words):
                raise ProgramError(f"line {line}: the program ends where a number belongs")
            return self._number(*words[at])

        def jump(test, line):
            code.append(None)
            return (len(code) - 1, test, line)

        def land(mark, target):
            k, test, _ = mark
            code[k] = lambda: target if test() else None

        def close(kind, line):
            if not open_ or open_[-1][0] not in kind:
                raise ProgramError(f"line {line}: nothing is open here")
            return open_.pop()

        true, false = (lambda: self.f), (lambda: not self.f)
        while at < len(words):
            word, line = words[at]
            if word in ("if", "ifl"):
                open_.append(("if", jump(false, line)))
            elif word in ("ifnot", "ifnotl"):
                open_.append(("if", jump(true, line)))
            elif word in ("else", "elsel"):
                mark = close(("if",), line)[1]
                open_.append(("else", jump(lambda: True, line)))
                land(mark, len(code))
            elif word == "endif":
                land(close(("if", "else"), line)[1], len(code))
            elif word == "do":
                open_.append(("do", len(code)))
            elif word in ("while", "until", "forever"):
                back = close(("do",), line)[1]
                land(jump({"while": true, "until": false, "forever": lambda: True}[word], line), back)
            elif word == "end":
                at = len(words)
            else:
                code.append(self._instruction(word, line, number))
            at += 1
        if open_:
            raise ProgramError("a loop or condition isn't closed")

    def _instruction(self, word: str, line: int, number) -> Callable[[], int | None]:
        get, put = self._get, self._set
        end = U32 + 1  # past every program
        if word == "halt":
            return lambda: end
        if word == "out":
            return lambda: self.out.append(self.reg["a"] & 255)
        if word == "hash":
            return lambda: put("a", (get("a") + get("*b") + 512) * 773)
        if word == "hashd":
            return lambda: put("*d", (get("*d") + get("a") + 512) * 773)
        if word == "error":

            def fail():
                raise ProgramError("the program ran into its error instruction")

            return fail
        if m := re.fullmatch(r"(\*?[abcd])(\+\+|--|!|<>a|=0|=r|=)(\*?[abcd])?", word):
            x, op, y = m.groups()
            if op == "=" and y:
                return lambda: put(x, get(y))
            if not y and op == "++":
                return lambda: put(x, get(x) + 1)
            if not y and op == "--":
                return lambda: put(x, get(x) - 1)
            if not y and op == "!":
                return lambda: put(x, ~get(x))
            if not y and op == "=0":
                return lambda: put(x, 0)
            if not y and op == "<>a" and x != "a":

                def swap():
                    old = get("a")
                    put("a", get(x))
                    put(x, old)

                return swap
            if not y and op == "=r" and x in self.reg:
                n = number(line) & 255
                return lambda: put(x, self.r[n])
            if not y and op == "=":
                n = number(line)
                return lambda: put(x, n)
        if word == "r=a":
            n = number(line) & 255

            def keep():
                self.r[n] = self.reg["a"]

            return keep
        if m := re.fullmatch(r"a([-+*/%&|^<>=~]+)(\*?[abcd])?", word):
            op, y = m.groups()
            value = (lambda: get(y)) if y else (lambda n=number(line): n)
            if op in _BINARY:
                return lambda: put("a", _BINARY[op](get("a"), value()))
            if op in _TESTS:

                def test():
                    self.f = _TESTS[op](get("a"), value())

                return test
        raise ProgramError(f"line {line}: {word!r} is no instruction")

    def call(self, a: int) -> None:
        """Runs the program once."""
        self.reg["a"], at, code, left = a & U32, 0, self.code, self.steps
        while at < len(code):
            target = code[at]()
            at = at + 1 if target is None else target
            left -= 1
            if left < 0:
                raise ProgramError(f"more than {self.steps} steps")

    def process(self, data: bytes) -> bytes:
        """Output for one segment of input, with the call at its end."""
        self.out = bytearray()
        for c in data:
            self.call(c)
        self.call(U32)
        return bytes(self.out)


def run_program(frame: DataFrame, column: str, source: str, h_bits: int = 8, m_bits: int = 16, args: tuple[int, ...] = (), steps: int = 10_000_000) -> DataFrame:
    """Replaces a binary column by the program's output, each value with fresh memory; null stays null. A wrong source is an error at once, a failing run makes its value null."""
    Machine(source, h_bits, m_bits, args)
    names = [c for c in frame.columns if c != column]

    def run(batches):
        import pyarrow as pa

        machine = Machine(source, h_bits, m_bits, args, steps)
        for batch in batches:
            out = []
            for v in batch.column(column).to_pylist():
                machine.reset()
                try:
                    out.append(None if v is None else machine.process(v))
                except ProgramError:
                    out.append(None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(out, pa.binary())], [*names, column])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in frame.schema if f.name != column)
    return frame.mapInArrow(run, f"{kept}`{column}` binary")
