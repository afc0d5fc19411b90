import random

import numpy as np
import pytest

from vaultframe.llm.splitting import greedy_cuts, split_entries, split_parts

ENTRIES = "entry_id bigint, dt_ptr array<bigint>, pos string, size string"
FRAGMENTS = "frag_id bigint, ht_usize int, entry_id bigint, pos int"


def brute(sizes, limit, overlap):
    total, borders, out, at = sum(sizes), list(np.cumsum(sizes)), [], overlap
    if total <= limit:
        return [(0, total, True)] if total else []
    while not out or out[-1][1] < total:
        begin = at - overlap
        legal = [b for b in borders if at < b <= begin + limit]
        at = int(max(legal)) if legal else begin + limit
        out.append((begin, at, bool(legal)))
    return out


@pytest.mark.parametrize("seed", range(20))
def test_greedy_cuts(seed):
    rnd = random.Random(seed)
    for _ in range(60):
        limit = rnd.randint(2, 40)
        overlap = rnd.randint(0, limit - 1)
        items = [[rnd.choice([0, 1, 2, 3, 8, rnd.randint(0, 100)]) for _ in range(rnd.randint(1, 12))] for _ in range(rnd.randint(1, 5))]
        item, size = np.repeat(np.arange(len(items)), [len(x) for x in items]), np.array([y for x in items for y in x], np.int64)
        own, number, begin, end, border = greedy_cuts(item, size, limit, overlap)
        for i, sizes in enumerate(items):
            mine = own == i
            expected = brute(sizes, limit, overlap)
            assert list(zip(begin[mine].tolist(), end[mine].tolist(), border[mine].tolist())) == expected
            assert number[mine].tolist() == list(range(1, len(expected) + 1))


def test_long_chain_of_cuts():
    own, number, _, end, _ = greedy_cuts(np.zeros(100_000, np.int64), np.ones(100_000, np.int64), 10, 3)
    assert len(own) == len(brute([1] * 100_000, 10, 3)[:0]) + -(-(100_000 - 10) // 7) + 1 and end[-1] == 100_000


def test_entries(spark, rows):
    rnd = random.Random(2)
    sizes = {k: rnd.choice([None, -1, 0, 3, 7, 20]) for k in range(40)}
    entries = [(k, rnd.choice([None, [], [rnd.choice([*range(45), None]) for _ in range(rnd.randrange(30))]]), "", "") for k in range(120)] + [(500, [1, 1, 1] * 400, "", "")]
    got = {}
    for r in split_entries(spark.createDataFrame(entries + entries[:5], ENTRIES), spark.createDataFrame([(k, v, 0, 0) for k, v in sizes.items()], FRAGMENTS), 25, 4).collect():
        got.setdefault(r["entry_id"], []).append((r["piece_begin"], r["piece_end"], r["at_border"]))
    for k, ptr, *_ in entries:
        expected = brute([max(sizes.get(p) or 0, 0) for p in ptr or []], 25, 4)
        assert sorted(got.get(k, [])) == expected


def test_many_batches_hold_one_item(spark):
    parts = spark.range(40_000).selectExpr("1L as id", "id as pos", "5 as size").union(spark.range(3).selectExpr("id + 2", "0L", "1"))
    got = split_parts(parts, "id", 1000, 10)
    assert [tuple(r) for r in got.filter("id = 1").selectExpr("count(*)", "max(piece_end)", "max(piece_end - piece_begin)").collect()] == [(-(-(200_000 - 1000) // 990) + 1, 200_000, 1000)]
    assert got.filter("id > 1").count() == 3


def test_nothing_and_bad_parameters(spark):
    entries, fragments = spark.createDataFrame([], ENTRIES), spark.createDataFrame([], FRAGMENTS)
    assert split_entries(entries, fragments).count() == 0
    with pytest.raises(ValueError):
        split_entries(entries, fragments, 10, 10)
