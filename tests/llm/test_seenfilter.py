import base64
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from vaultframe.llm.seenfilter import QuotientFilter, SeenStore, decode_key, decode_many, filter_errors, fingerprints, seed_segments, seen_segments, take_all

SEGMENTS = "seg_id bigint, ht_sha1 string, ht_usize int, key string, flagged string"
SEEDS = "key_no int, ht_sha1 binary, seq bigint"


def sha(x):
    return hashlib.sha1(str(x).encode()).digest()


def spellings(raw):
    h = raw.hex()
    b32, b64 = base64.b32encode(raw).decode(), base64.b64encode(raw).decode()
    yield from (h, h.upper(), f" {h}\t", f"sha1:{h}", f"SHA1:{h}", f"sha1-{h}", f"0x{h}", f"urn:sha1:{b32}", b32, b32.lower(), b64, f"sha1-{b64}", b64.rstrip("="))
    yield from (":".join(h[i : i + 2] for i in range(0, 40, 2)), "-".join(h[i : i + 4] for i in range(0, 40, 4)), " ".join(h[i : i + 8].upper() for i in range(0, 40, 8)))


def test_spellings_denote_the_key():
    for k in range(200):
        for text in spellings(sha(k)):
            assert decode_key(text) == sha(k), text
    bad = ["", "unknown", sha(1).hex()[:-1], sha(1).hex()[:-2], sha(1).hex() + "0", "0" * 40, "g" + sha(1).hex()[1:], None, base64.b32encode(bytes(20)).decode()]
    assert [decode_key(x) for x in bad] == [None] * len(bad)
    many = [*bad, *spellings(sha(5))]
    assert decode_many(many) == [decode_key(x) for x in many]
    assert decode_many([sha(1).hex(), None]) == [sha(1), None]


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 2**12 - 1)), st.sets(st.integers(0, 2**12 - 1)), st.integers(1, 11))
def test_filter_holds_its_fingerprints(a, b, remainder):
    make = lambda s: QuotientFilter(np.array(sorted(s), np.uint64), 12, remainder)
    x, y = make(a), make(b)
    assert x.prints().tolist() == sorted(a)
    assert x.merged(np.array(sorted(b - a), np.uint64)).prints().tolist() == sorted(a | b)
    assert QuotientFilter.load(x.dump()).prints().tolist() == sorted(a) and y.n == len(b)
    every = np.arange(2**12, dtype=np.uint64)
    assert x.contains(every).tolist() == [k in a for k in range(2**12)]


def test_a_large_filter_is_small_and_complete():
    rnd = np.random.default_rng(1)
    prints = np.unique(rnd.integers(0, 1 << 30, 200_000).astype(np.uint64))
    x = QuotientFilter.sized(prints, 30)
    assert x.contains(prints).all() and x.nbytes < 8 * len(prints)
    others = np.setdiff1d(rnd.integers(0, 1 << 30, 50_000).astype(np.uint64), prints)
    assert not x.contains(others).any()
    assert QuotientFilter.load(x.dump()).contains(prints).all()


def test_every_byte_of_a_key_counts():
    keys = np.zeros((21, 20), np.uint8)
    keys[np.arange(20), np.arange(20)] = 1
    assert len(set(fingerprints(keys, 40).tolist())) == 21


def brute(segments, seeds):
    known, out = {k for _, k, _ in seeds if k is not None and len(k) == 20 and any(k)}, []
    for s in sorted((s for s in segments if s[0] is not None), key=lambda s: s[0]):
        key = decode_key(s[1])
        if key is not None:
            out += [(s[0],)] if key in known else []
            known.add(key)
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def stream():
    rnd = random.Random(7)
    segments = []
    for k in range(3000):
        raw = sha("hot" if rnd.random() < 0.3 else rnd.randrange(1500))
        text = rnd.choice([None, "", "0" * 40, raw.hex()[1:], raw.hex(), *spellings(raw)])
        segments.append((k, text, rnd.choice([None, -1, 5]), "", ""))
    rnd.shuffle(segments)
    seeds = [(k, sha(k), 0) for k in range(30)] + [(98, None, 0), (99, bytes(20), 0), (97, b"short", 0)]
    return segments, seeds


@pytest.mark.parametrize("remainder", [1, 10])
def test_seen_segments(spark, rows, stream, remainder):
    segments, seeds = stream
    got = seen_segments(spark.createDataFrame(segments, SEGMENTS).repartition(5), spark.createDataFrame(seeds, SEEDS), remainder)
    assert rows(got) == brute(segments, seeds)


def test_errors_measured_and_derived(spark, stream):
    segments, seeds = stream
    r = filter_errors(spark.createDataFrame(segments, SEGMENTS), spark.createDataFrame(seeds, SEEDS), 3).first()
    assert r["seen"] == len(brute(segments, seeds)) and r["missed"] == 0
    assert 0 < r["wrong"] and abs(r["wrong"] - r["derived_errors"]) < 5 * r["derived_errors"] ** 0.5


def test_lost_fingerprints_are_missed(spark, stream, monkeypatch):
    from vaultframe.llm import seenfilter

    segments, seeds = stream
    read = seenfilter.SeenStore._read
    lossy = lambda self, kind, numbers: read(self, kind, numbers).filter(F.col("seq").isNull() | (F.col("seq") % 5 != 0))
    monkeypatch.setattr(seenfilter.SeenStore, "_read", lossy)
    r = filter_errors(spark.createDataFrame(segments, SEGMENTS), spark.createDataFrame(seeds, SEEDS), 10).first()
    assert r["seen"] == len(brute(segments, seeds)) and r["missed"] > 0
    assert r["measured_rate"] == pytest.approx((r["wrong"] + r["missed"]) / r["keys"])


def test_only_flagged_fingerprints_reach_the_exact_step(spark, stream):
    segments, seeds = stream
    store, numbers = take_all(spark.createDataFrame(segments, SEGMENTS), spark.createDataFrame(seeds, SEEDS), remainder_bits=3)
    candidates, earlier = store.compared(numbers)
    flagged = {(r["range"], r["print"]) for r in candidates.collect()}
    looked_at = earlier.collect()
    every = store._read("key", range(max(numbers))).count()
    assert {(r["range"], r["print"]) for r in looked_at} <= flagged and 0 < len({bytes(r["key"]) for r in looked_at}) < every
    # What the filters say alone decides who is looked at: a fingerprint that an earlier intake has.
    had = {}
    for r in store._read("key", range(max(numbers) + 1)).unionByName(store._read("candidate", range(max(numbers) + 1))).collect():
        had[r["range"], r["print"]] = min(r["intake"], had.get((r["range"], r["print"]), 99))
    assert all(had[r["range"], r["print"]] < r["intake"] for r in candidates.collect())


def test_a_later_session_goes_on(spark, rows, stream, tmp_path):
    segments, seeds = stream
    path = f"file://{tmp_path}/store"
    frame = spark.createDataFrame(segments, SEGMENTS)
    first = SeenStore(spark, path, 4000)
    first.take(seed_segments(spark.createDataFrame(seeds, SEEDS)))
    first.take(frame.filter("seg_id < 1000"))
    with pytest.raises(Exception):  # noqa: B017
        first.take(frame.filter("seg_id >= 1000").withColumn("ht_sha1", F.when(F.col("seg_id") > 2000, F.raise_error(F.lit("lost"))).otherwise(F.col("ht_sha1"))))
    later = SeenStore(spark, path, 10)
    assert (later.bits, later.intakes) == (first.bits, 2)
    number = later.take(frame.filter("seg_id >= 1000"))
    got = sorted(r["seq"] for r in later.seen([number]).collect())
    assert got == [x for (x,) in brute(segments, seeds) if x >= 1000]


@pytest.mark.parametrize("intakes", [1, 3, 9])
def test_any_number_of_intakes(spark, rows, stream, intakes):
    segments, seeds = stream
    got = seen_segments(spark.createDataFrame(segments, SEGMENTS).repartition(3), spark.createDataFrame(seeds, SEEDS), 1, intakes)
    assert rows(got) == brute(segments, seeds)


def test_nothing_and_repeated_rows(spark, rows):
    none = spark.createDataFrame([], SEGMENTS)
    assert seen_segments(none).count() == 0
    assert filter_errors(none).first()["keys"] == 0
    twice = spark.createDataFrame([(1, sha(1).hex(), 1, "", "")] * 2 + [(2, sha(1).hex(), 1, "", "")] + [(None, sha(1).hex(), 1, "", "")], SEGMENTS)
    assert rows(seen_segments(twice)) == [(2,)]
