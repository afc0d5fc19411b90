import hashlib
import random

import pytest
from pyspark.sql import functions as F

from vaultframe.functions import crypto, dates, paths
from vaultframe.functions.machine import Machine, ProgramError, run_program

TABLE = [
    ("dir", "dir", True), ("dir", "dir/", True), ("dir", "dir/x", True), ("dir", "dirx", False), ("dir/", "dir/x", True), ("dir/", "dir", False), ("dir/", "dirx", False),
    ("", "", True), ("", "/abs", True), ("", "x", False), ("*", "", True), ("*", "a/b\nc", True), ("a?c", "a/c", True), ("a?c", "ac", False), ("a*c", "a/b/c", True), ("a*c", "a/b/c/d", True),
    ("a.c", "abc", False), ("*.txt", "x.txt", True), ("*.txt", "x.txt\n", False), ("(a|b)", "a", False), ("é?", "éx", True), ("?", "é", False), ("??", "é", True), ("a/*", "a/", True), ("a/*", "a", False), ("a//", "a//b", True),
]


def test_patterns(spark):
    for pattern, path, expected in TABLE:
        got = spark.range(1).select(paths.matches(F.lit(path), pattern).alias("m")).first()["m"]
        assert got is expected, (pattern, path)


def test_selection_and_prefix_reaches_the_scan(spark, tmp_path):
    frame = spark.createDataFrame([(p,) for p in ("a/x.c", "a/y.h", "b/x.c", "c", None)], "p string")
    keep = lambda **k: [r["p"] for r in frame.filter(paths.selected(F.col("p"), **k)).collect()]
    assert keep() == ["a/x.c", "a/y.h", "b/x.c", "c", None]
    assert keep(files=["a", "c"]) == ["a/x.c", "a/y.h", "c"]
    assert keep(only=["*.c"], exclude=["b"]) == ["a/x.c"]
    assert keep(files=["a"], rename_to=["b"], renamed=True) == ["b/x.c"]
    frame.write.parquet(str(tmp_path / "p"))
    plan = spark.read.parquet(str(tmp_path / "p")).filter(paths.matches(F.col("p"), "a/*.c"))._jdf.queryExecution().toString()
    assert "StringStartsWith(p,a)" in plan


def test_renames(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(paths.append_path(F.lit("a/"), F.lit("/b"))) == "a/b" and one(paths.append_path(F.lit("a//"), F.lit("b"))) == "a//b" and one(paths.append_path(F.lit(""), F.lit("b"))) == "/b"
    assert one(paths.renamed(F.lit("dirx/y"), ["dir"], ["new"])) == "newx/y" and one(paths.renamed(F.lit("q"), ["dir"], ["new"])) == "q"
    assert one(paths.renamed(F.lit("/q"), (), ["r"])) == "r/q" and one(paths.renamed(F.lit("q"))) == "q"
    assert [one(paths.dirname(F.lit(x))) for x in ("a/b/c", "c", "a\\b", "a/")] == ["a/b/", "", "a\\", "a/"]
    assert [one(paths.extension_key(F.lit(x))) for x in ("a.TXT", "a.b/c", "x.tar.GZIPPED", ".")] == ["txt", "", "gzipp", ""]


@pytest.mark.parametrize("words,expected", [
    (["0"], 0), (["3"], 3), (["-1"], -1), (["2014/4/3"], 20140403235959), (["20140430"], 20140430235959), (["2014/04/30", "11:30"], 20140430113059), (["2014-04-30", "9"], 20140430095959), (["20140430113015"], 20140430113015), (["9999999"], 9999999),
])
def test_until(words, expected):
    assert dates.parse_until(*words) == expected


@pytest.mark.parametrize("words", [["99999999"], ["18991231"], ["-0"]])
def test_no_until(words):
    with pytest.raises(ValueError):
        dates.parse_until(*words)


def test_dates_and_attributes(spark):
    rows = spark.createDataFrame([(20240229235958, ord("u") + (0o100644 << 8)), (0, ord("w") + (0b100001 << 8)), (-1, 0), (None, None), (20231341000000, ord("u") + (0o040755 << 8))], "d bigint, a bigint")
    got = rows.select(dates.date_text(F.col("d")), dates.attr_text(F.col("a")), dates.decimal_date(dates.to_timestamp(F.col("d")))).collect()
    blank = " " * 19
    assert [tuple(r) for r in got] == [("2024-02-29 23:59:58", " 0644", 20240229235958), (blank, "RA   ", None), (blank, " " * 5, None), (blank, " " * 5, None), ("2023-13-41 00:00:00", "d0755", None)]


def test_published_vectors():
    assert hashlib.sha1(b"abc").hexdigest() == "a9993e364706816aba3e25717850c26c9cd0d89d"
    import numpy as np

    block = np.frombuffer(bytes.fromhex("00112233445566778899aabbccddeeff"), np.uint8).reshape(1, 16)
    for n, expected in ((16, "69c4e0d86a7b0430d8cdb78070b4c55a"), (24, "dda97ca4864cdfe06eaf70a0ec0d7191"), (32, "8ea2b7ca516745bfeafc49904b496089")):
        assert crypto.aes_blocks(block, bytes(range(n))).tobytes().hex() == expected
    assert hashlib.scrypt(b"password", salt=b"NaCl", n=1024, r=8, p=16, dklen=64).hex().startswith("fdbabe1c9d347200")
    assert crypto.pbkdf2(b"passwd", b"salt", 1, 64).hex().startswith("55ac046e56e3089f")


def test_slices_of_a_stream():
    data, key, salt = random.Random(1).randbytes(1000), bytes(32), bytes(range(32))
    whole = crypto.ctr_slice(data, key, salt)
    for a, b in ((0, 1000), (5, 6), (16, 48), (17, 999), (3, 3)):
        assert crypto.ctr_slice(whole[a:b], key, salt, a) == data[a:b]
    salt = crypto.new_salt()
    assert salt[0] not in b"z7" and crypto.index_salt(crypto.index_salt(salt)) == salt != crypto.index_salt(salt)
    assert crypto.stretch_key("a", salt) == crypto.stretch_key(b"a", salt) != crypto.stretch_key("b", salt)


def test_cells(spark):
    key = bytes(range(32))
    frame = spark.createDataFrame([(bytearray(b"secret"),), (None,)], "c binary").withColumn("e", crypto.encrypt(F.col("c"), key))
    assert [r[0] and bytes(r[0]) for r in frame.select(crypto.decrypt(F.col("e"), key)).collect()] == [b"secret", None]
    assert [r[0] for r in frame.select(crypto.decrypt(F.col("e"), bytes(32))).collect()] == [None, None]


def test_no_plan_shows_the_key(spark):
    import base64
    import contextlib
    import io

    key = bytes(range(65, 97))
    frame = spark.range(5).select(F.col("id").cast("string").cast("binary").alias("c")).withColumn("e", crypto.encrypt(F.col("c"), key))
    frame = frame.withColumn("d", crypto.decrypt(F.col("e"), key))
    assert frame.filter("d = c").count() == 5
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        for mode in ("simple", "extended", "codegen", "cost", "formatted"):
            frame.explain(mode=mode)
    frame.collect()
    text = text.getvalue() + frame._jdf.queryExecution().toString()
    assert "aes_encrypt" in text.lower() or "AesEncrypt" in text
    for spelling in (key.hex(), key.decode(), base64.b64encode(key).decode(), str(list(key))[1:-1]):
        assert spelling.lower() not in text.lower()


def run(source, data=b"", **kw):
    m = Machine(source, **kw)
    return m, m.process(data)


@pytest.mark.parametrize("body,expected", [
    ("a= 7 a+= 5", 12), ("a= 7 a-= 9", 2**32 - 2), ("a= 200 a*= 200", 40000), ("a= 7 a/= 2", 3), ("a= 7 a/= 0", 0), ("a= 7 a%= 4", 3), ("a= 7 a%= 0", 0), ("a= 7 a&= 5", 5), ("a= 7 a&~ 5", 2), ("a= 8 a|= 5", 13), ("a= 7 a^= 5", 2),
    ("a= 1 a<<= 33", 2), ("a= 4 a>>= 33", 2), ("a=0 a!", 2**32 - 1), ("a=0 a--", 2**32 - 1), ("a= 3 a++", 4), ("b= 9 a=b", 9), ("a= 5 r=a 3 a=0 a=r 3", 5), ("a= 6 b<>a b++ a=b", 7), ("a= 9 *d=a a=0 a=*d", 9), ("a= 255 a+= 2 *b=a a=*b", 1), ("a= 1 hash", 513 * 773 % 2**32), ("a= 2 hashd a=*d", 514 * 773 % 2**32), ("a= $1+4", 14), ("a= 3 halt a= 4", 3),
    ("a= 3 a== 3 if a= 8 endif", 8), ("a= 3 a> 3 if a= 8 else a= 9 endif", 9), ("a= 3 a< 4 ifnot a= 8 endif", 3), ("a=0 do a++ a== 9 until", 9), ("a=0 do a++ a< 5 while", 5), ("b=0 do b++ a=b a== 6 if halt endif forever", 6), ("( a (nested) note ) A= 4", 4),
])
def test_instructions(body, expected):
    assert run(body, args=(10,))[0].reg["a"] == expected


@pytest.mark.parametrize("source", ["a=", "frob", "if", "endif", "do", "until", "( a", ")", "a<>a", "a= x"])
def test_bad_source(source):
    with pytest.raises(ProgramError):
        Machine(source)


def test_limits():
    with pytest.raises(ProgramError):
        run("do forever", steps=1000)
    with pytest.raises(ProgramError):
        run("error")


def test_program_over_a_column(spark):
    twice = "a> 255 ifnot out out endif"
    frame = spark.createDataFrame([(1, bytearray(b"ab")), (2, None), (3, bytearray(b""))], "id int, data binary")
    got = {r["id"]: r["data"] and bytes(r["data"]) for r in run_program(frame, "data", twice).collect()}
    assert got[1] == b"aabb" and got[2] is None and not got[3]
    with pytest.raises(ProgramError):
        run_program(frame, "data", "nonsense")
