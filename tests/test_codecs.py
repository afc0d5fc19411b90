import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from vaultframe.functions import transforms as tr
from vaultframe.functions.codecs import codec_memory, method_of, pack_bytes, pack_column, parse_method, unpack_bytes, unpack_column, unpack_prefix
from vaultframe.operators.packing import periodic_models, periods_of

rnd = random.Random(1)
TEXT = b"The house will divide. Order! Order! The ayes have it, the ayes have it. " * 12
CONTENTS = [b"", b"a", bytes(500), rnd.randbytes(400), TEXT, b"abcdabcdabce" * 30, b"\xe8\x01\x02\x03\x00" * 9, b"xx\xe9\xff\xff\xff\xff", b"\xe8\xe8\xe8\xe8\x00\x00\xff\xff" * 5]
METHODS = ["store", "zstd", "zstd:19", "00,0", "x0,0", "x0,1,4,0,1,15", "x0,2,12,0,7,21,1", "x0,3", "x0,5,4,0,3,20", "x0,7", "x0,3ci1", "x0,2,12,0,7,21,1c0,0,511i2", "x0,0ci1,1,1,1,2awm", "x0,0w2c0,1010,255i1c256ci1,1,1,1,1,1,2ac0,2,0,255i1mm16ts19t0"]


@pytest.mark.parametrize("method", METHODS)
def test_round_trip(method):
    for content in CONTENTS:
        packed = pack_bytes(content, method)
        assert unpack_bytes(packed) == content
        assert method_of(packed) == method
        assert all(unpack_prefix(packed, n) == content[:n] for n in (0, 1, 7, 10_000))
    assert codec_memory(method, 1000) > 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"abc", b"\xe8", b"\x00", b"\xff" * 3, b"word "]), max_size=60).map(b"".join))
def test_transforms(data):
    assert tr.unbwt(tr.bwt(data)) == data
    assert tr.call_targets(tr.call_targets(data), -1) == data
    assert tr.unlz_packed(tr.lz_packed(data), len(data)) == data
    assert tr.unlz_bytes(tr.lz_bytes(data, 3), 3) == data
    assert tr.suffix_array(data).tolist() == sorted(range(len(data)), key=lambda i: data[i:])


def test_text_shrinks():
    sizes = {m: len(pack_bytes(TEXT, m)) for m in METHODS}
    assert sizes["x0,1,4,0,1,15"] < len(TEXT) / 4 and sizes["x0,0ci1,1,1,1,2awm"] < len(TEXT) / 4 and sizes["x0,3ci1"] < len(TEXT) / 4


@pytest.mark.parametrize("method", ["y", "x", "x0,9", "x0,0q", "zstd:x"])
def test_no_such_method(method):
    with pytest.raises(ValueError):
        parse_method(method)


def test_periods():
    data = b"".join(bytes([rnd.randrange(256), 7, 9, 200 + k % 3, 1, 2, 3, 4, 5, 6]) for k in range(4000))
    assert periods_of(data)[:1] == [10]
    assert periodic_models(data).startswith("c0,0,1009,255i1c0,10i1")
    assert periods_of(rnd.randbytes(5000)) == [] and periods_of(b"") == []


def test_contexts_of_a_method_are_its_own():
    """Methods that differ in masks, offsets or words build different models, and each is the better one for what it describes."""
    from vaultframe.functions.codecs import build_model

    contexts = lambda m: [c for _, c in build_model(parse_method(m))]
    specs = ["x0,0c0,0,255,0,255", "x0,0c0,0,255,255", "x0,0c0,0,15,15", "x0,0c0,7", "x0,0c0,1010,255", "x0,0c0,0,511,255", "x0,0w2", "x0,0w2,48,10", "x0,0ci1,2"]
    assert len({str(contexts(m)) for m in specs}) == len(specs)
    assert contexts("x0,0c0,0,255,1003,255") == contexts("x0,0c0,0,255,0,0,0,255")
    noise = random.Random(5)
    period = b"".join(bytes([noise.randrange(256), 7, 9, 200, noise.randrange(256), 3, 4]) for _ in range(90))
    size = lambda data, m: len(pack_bytes(data, m))
    assert size(period, "x0,0c0,7") < size(period, "x0,0c0,5")
    skip = bytearray(noise.choices(b"abcdefgh", k=600))
    for k in range(2, 600):
        skip[k] = (skip[k - 2] * 5 + 3) % 256 if k % 2 == 0 else skip[k]
    assert size(bytes(skip), "x0,0c0,0,0,255") < size(bytes(skip), "x0,0c0,0,255")
    for m in [*specs, "x0,0c0,0,255m0,40", "x0,0ci1t9s16,8,20", "x0,0c4,0,255c1000c2m12t0,60"]:
        assert unpack_bytes(pack_bytes(TEXT[:200], m)) == TEXT[:200]


def test_columns_survive_damage(spark):
    frame = spark.createDataFrame([(k, bytearray(c), "x0,1" if k % 2 else "zstd", "e") for k, c in enumerate(CONTENTS)] + [(99, None, None, "e")], "id int, data binary, method string, note string")
    packed = pack_column(frame, "data", method_col="method").collect()
    damaged = [(r["id"], r["method"], r["note"], bytearray(bytes(r["data"])[:-2] + b"\x00\x01") if r["id"] == 4 else r["data"]) for r in packed]
    back = {r["id"]: r for r in unpack_column(spark.createDataFrame(damaged, "id int, method string, note string, data binary"), "data").collect()}
    assert back[4]["data"] is None and back[4]["unpack_error"]
    assert all(bytes(back[k]["data"]) == c for k, c in enumerate(CONTENTS) if k != 4)
    assert back[99]["data"] is None and back[99]["unpack_error"] is None
    assert pack_column(frame.limit(0), "data", "zstd").count() == 0


def test_every_document_passes_every_codec(spark, rows, tmp_path, monkeypatch):
    import hashlib

    from vaultframe.functions import codecs
    from vaultframe.plans.store_queries import codec_roundtrip

    long = random.Random(4)
    words = ["".join(long.choices("etaoin é", k=long.randrange(2, 9))) for _ in range(400)]
    texts = ["", "a", "b" * 70_000, TEXT.decode() * 40, " ".join(long.choice(words) for _ in range(20_000)), None]
    texts.append(texts[4][:50_000] + "x" * 300 + texts[4][:50_000])
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    passed, pack = {}, codecs.pack_column

    def counted(frame, column, method=None, method_col=None):
        passed[method] = frame.count()
        return pack(frame, column, method, method_col)

    monkeypatch.setattr(codecs, "pack_column", counted)
    got = rows(codec_roundtrip(spark, str(tmp_path)))
    assert got == sorted(((k, hashlib.sha1(t.encode()).hexdigest()) for k, t in enumerate(texts) if t is not None), key=repr)
    specs = [parse_method(m or "store") for m in passed]
    assert {s.kind for s in specs} == {"zstd", "x"} and {s.transform for s in specs if s.kind == "x"} == {1, 2, 3} and any(s.code for s in specs)
    assert set(passed.values()) == {6}
