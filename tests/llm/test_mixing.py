import random

import pytest

from vaultframe.llm.mixing import Mix, water_fill

DOCS = "doc_id bigint, text string, source string, place string, whole string"
TARGETS = "source_name string, target_share double, max_repeats int, source string"


def test_water_fill():
    assert water_fill({"a": 100, "b": 100}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 1}, 100) == {"a": 50, "b": 50}
    assert water_fill({"a": 10, "b": 1000}, {"a": 0.5, "b": 0.5}, {"a": 2, "b": 1}, 100) == {"a": 20, "b": 80}
    got = water_fill({"a": 10, "b": 30, "c": 1000}, {"a": 0.5, "b": 0.3, "c": 0.2, "d": 0.0, "e": 0.1}, {"a": 1, "b": 1, "c": 9, "d": 3, "e": 4}, 200)
    assert got == {"a": 10, "b": 30, "c": 160, "d": 0, "e": 0}
    assert water_fill({}, {"a": 1.0}, {"a": 3}, 50) == {"a": 0}
    assert sum(water_fill({"a": 10}, {"a": 1.0}, {"a": 3}, 500).values()) == 30


@pytest.fixture(scope="module")
def documents(spark):
    rnd = random.Random(5)
    names = ["plenary"] * 10 + ["PLENARY", " up house", "up_house", "Up House", "small", None, "unnamed"]
    data = [(k, rnd.choice([None, "", *(" ".join(["word"] * n) for n in range(1, 40))]), rnd.choice(names), "", "") for k in range(3000)]
    return spark.createDataFrame(data, DOCS)


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame([("Plenary", 0.5, 1, ""), ("up house", 0.3, 3, ""), ("small", 0.2, 2, ""), ("absent", 0.0, 4, ""), (None, 0.1, 1, "")], TARGETS)


@pytest.mark.parametrize("total", [None, 3000, 10**9])
def test_shares(documents, targets, total):
    mix = Mix(documents, targets, total)
    figures = {r["source"]: r.asDict() for r in mix.shares().collect()}
    used = [r.asDict() for r in mix.documents().collect()]
    assert len({r["doc_id"] for r in used}) == len(used)
    for name, r in figures.items():
        mine = [u for u in used if u["source"] == name]
        assert sum(u["n_tokens"] * u["copies"] for u in mine) == r["used_tokens"]
        assert max([0, *(u["copies"] for u in mine)]) == r["most_copies"] <= r["max_repeats"]
        assert abs(r["used_tokens"] - r["planned_tokens"]) <= 40
        copies = {u["copies"] for u in mine}
        assert not copies or max(copies) - min(copies) <= 1
    assert abs(sum(r["actual_share"] for r in figures.values()) - 1) < 1e-9
    assert set(figures) == {"plenary", "up_house", "small", "absent"}


def test_mix_is_repeatable_and_whole(documents, targets, rows):
    first = rows(Mix(documents, targets).documents())
    assert first == rows(Mix(documents.repartition(7), targets).documents())
    assert first != rows(Mix(documents, targets, seed=8).documents())


def test_nothing(spark, documents, targets):
    assert Mix(documents.limit(0), targets).documents().count() == 0
    assert Mix(documents, targets.limit(0)).documents().count() == 0
    assert Mix(documents.limit(0), targets).shares().count() == 4
