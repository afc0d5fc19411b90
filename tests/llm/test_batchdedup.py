import hashlib
import random

import pytest

from vaultframe.llm import batchdedup
from vaultframe.llm.batchdedup import History, accepted, repeated_files

FILES = "file_id bigint, batch_no int, dt_path string, dt_ptr array<bigint>, k string, c string"
FRAGMENTS = "frag_id bigint, ht_sha1 binary, ht_usize int, total string, w string"


def sha(x):
    return hashlib.sha1(str(x).encode()).digest()


def brute(files, fragments):
    known = {f[0]: (f[1], f[2]) for f in fragments if f[1] is not None and any(f[1]) and f[2] is not None and f[2] >= 0}
    sets, batch = {}, {}
    for f in files:
        if f[0] is not None and f[1] is not None:
            sets.setdefault(f[0], {}).update(dict(known[p] for p in f[3] or [] if p in known))
            batch[f[0]] = min(f[1], batch.get(f[0], f[1]))
    out = []
    for a in sets:
        for b in sets:
            if a < b and batch[b] >= 1:
                union = sets[a] | sets[b]
                whole = sum(union.values())
                if whole and 100 * sum(union[k] for k in sets[a].keys() & sets[b].keys()) >= 60 * whole:
                    out.append((a, b))
    return sorted(out, key=repr)


def make(seed, n=160, hot=False):
    rnd = random.Random(seed)
    fragments = [(k, rnd.choice([None, bytes(20)]) if k % 29 == 0 else sha(k % 97), rnd.choice([None, -1]) if k % 31 == 0 else 1 + (k % 97) ** 2, "", "") for k in range(200)]
    fragments.append((900, sha("hot"), 4000, "", ""))
    files, bases = [], [[rnd.randrange(230) for _ in range(rnd.randrange(1, 9))] for _ in range(25)]
    for f in range(n):
        ptr = [p for p in rnd.choice(bases) if rnd.random() < 0.85] + [rnd.randrange(230) for _ in range(rnd.randrange(2))]
        rnd.shuffle(ptr)
        if hot and rnd.random() < 0.4:
            ptr += [900] * rnd.randrange(1, 3)
        files.append((f, f * 6 // n, "p", rnd.choice([ptr, ptr, ptr, ptr, None, []]), "", ""))
    return files + files[5:9] + [(None, 2, "p", [1], "", "")], fragments


@pytest.mark.parametrize("seed,hot", [(1, False), (2, True)])
def test_all_cases_are_found(spark, rows, seed, hot, monkeypatch):
    if hot:
        monkeypatch.setattr(batchdedup, "COMMON", 3)
        monkeypatch.setattr(batchdedup, "RANGE_ROWS", 40)
    files, fragments = make(seed, hot=hot)
    got = repeated_files(spark.createDataFrame(files, FILES), spark.createDataFrame(fragments, FRAGMENTS))
    expected = brute(files, fragments)
    assert rows(got) == expected and len(expected) > 100


def test_a_fragment_that_all_have(spark, rows, monkeypatch):
    monkeypatch.setattr(batchdedup, "COMMON", 5)
    rnd = random.Random(6)
    fragments = [(0, sha("all"), 6000, "", "")] + [(k, sha(k), rnd.choice([100, 1000, 2000, 4000, 4001, 9000]), "", "") for k in range(1, 200)]
    files = [(f, f // 50, "p", [0, f % 199 + 1, *([rnd.randrange(1, 200)] if f % 3 == 0 else [])], "", "") for f in range(200)]
    got = repeated_files(spark.createDataFrame(files, FILES), spark.createDataFrame(fragments, FRAGMENTS))
    expected = brute(files, fragments)
    assert rows(got) == expected and len(expected) > 1000


def test_copies_of_one_content(spark):
    files = [(f, f // 40, "p", [1, 2], "", "") for f in range(120)] + [(200, 3, "p", [1], "", "")]
    fragments = [(1, sha(1), 70, "", ""), (2, sha(2), 30, "", "")]
    got = repeated_files(spark.createDataFrame(files, FILES), spark.createDataFrame(fragments, FRAGMENTS))
    assert got.count() == 40 * 80 + 80 * 79 // 2 + 120


def test_a_fragment_that_becomes_common_later(spark, rows, monkeypatch):
    """Its earlier contents are entered anew; one that is heavy opens windows at first, and lies behind the entries later."""
    monkeypatch.setattr(batchdedup, "COMMON", 4)
    rnd = random.Random(11)
    fragments = [(0, sha("late"), 5000, "", ""), (500, sha("other"), 4000, "", "")] + [(k, sha(k), rnd.choice([900, 1500, 3000]), "", "") for k in range(1, 120)]
    files = []
    for f in range(150):
        base = rnd.sample(range(1, 120), 3)
        files.append((f, f // 30, "p", [*([0] if f % 25 == 0 or f >= 60 else []), *([500] if f >= 90 else []), *base[: rnd.randrange(0, 4)]], "", ""))
    history, later = accepted(spark.createDataFrame(files, FILES), spark.createDataFrame(fragments, FRAGMENTS))
    expected = brute(files, fragments)
    assert rows(history.pairs(later)) == expected and len(expected) > 100
    assert sum(b["entered_again"] for b in history.state["batches"]) > 0


def test_a_later_session_goes_on(spark, rows, monkeypatch, tmp_path):
    monkeypatch.setattr(batchdedup, "RANGE_ROWS", 20)
    monkeypatch.setattr(batchdedup, "MOST_RUNS", 2)
    files, fragments = make(3)
    files = [f for f in files if f[0] is not None]
    frags, path = spark.createDataFrame(fragments, FRAGMENTS), f"file://{tmp_path}/history"
    first, later = accepted(spark.createDataFrame([f for f in files if f[1] < 3], FILES), frags, path=path)
    state = first.state
    broken = spark.createDataFrame([(1, 5, 3)], "file_id bigint, k bigint, w bigint").selectExpr("file_id", "cast(raise_error('lost') as bigint) as k", "w")
    with pytest.raises(Exception):  # noqa: B017
        first.accept(broken, 3)
    assert History(spark, path).state == state
    second, later = accepted(spark.createDataFrame(files, FILES), frags, path=path)
    assert second.batches == [0, 1, 2, 3, 4, 5] and later == [1, 2, 3, 4, 5]
    assert rows(second.pairs(later)) == brute(files, fragments)
    pairs = {(a, b) for a, b in rows(second.class_pairs())}
    links = {f: (c, n) for f, c, n in rows(second.links())}
    assert all(links[a][0] == a and links[b][0] == b for a, b in pairs)
    assert all(n == sum(c in p for p in pairs) for c, n in links.values())
    assert any(n < every for n, every in second.state["batches"][-1]["ranges_read"].values())


def test_a_file_of_very_many_fragments(spark, rows):
    """Rows grow with the fragments, not with their square."""
    n = 20_000
    fragments = spark.range(1, 2 * n).selectExpr("id as frag_id", "unhex(sha1(cast(id as string))) as ht_sha1", "10 as ht_usize", "'' as total", "'' as w")
    files = spark.createDataFrame([(f, f, "p", [*range(1 + f * n // 10, 1 + f * n // 10 + n)], "", "") for f in range(3)], FILES)
    history, later = accepted(files, fragments)
    assert rows(history.pairs(later)) == [(0, 1), (0, 2), (1, 2)]
    assert history.entries.read().count() <= 3 * (n * 2 // 5 + 1)


def test_nothing(spark):
    files, fragments = make(1)
    none = spark.createDataFrame([], FILES)
    some = spark.createDataFrame(fragments, FRAGMENTS)
    assert repeated_files(none, some).count() == 0
    assert repeated_files(spark.createDataFrame([f for f in files if f[1] == 0], FILES), some).count() == 0
    assert repeated_files(spark.createDataFrame(files, FILES), some.limit(0)).count() == 0
