import random

import pytest
from pyspark.sql import functions as F

from vaultframe.session import scratch_path
from vaultframe.sources.vault import Selection, Vault, VaultError

FILES = "dt_path string, dt_date bigint, dt_size bigint, dt_attr bigint, content binary, note string"
rnd = random.Random(2)
BASE = {f"d/{k}.txt": rnd.randbytes(rnd.choice([0, 10, 700, 5000])) for k in range(12)} | {"e/long.bin": rnd.randbytes(30_000), "twin.txt": b""}
BASE["twin.txt"] = BASE["e/long.bin"]


def frame(spark, files, date=20200101000000, attr=ord("u") + (0o100644 << 8)):
    return spark.createDataFrame([(p, date, len(c), attr, bytearray(c), "n") for p, c in files.items()] or [(None, 1, 1, 1, None, "n")], FILES)


def contents(df):
    return {r["dt_path"]: None if r["content"] is None else bytes(r["content"]) for r in df.collect()}


@pytest.fixture(scope="module")
def story(spark):
    """A vault of three versions and what each held."""
    vault = Vault(spark, scratch_path(spark, "vault"), fragment=0, block_size=1 << 14)
    states = [BASE]
    first = vault.add(frame(spark, BASE).union(frame(spark, {"d/1.txt": BASE["d/1.txt"]}).limit(1)), 20210101000000)
    second = dict(BASE)
    second["e/long.bin"] = b"front" + BASE["e/long.bin"]
    del second["d/3.txt"]
    second["new"] = b"something new " * 50
    states.append(second)
    changed = {p: c for p, c in second.items() if c != BASE.get(p)}
    two = vault.add(frame(spark, {p: c for p, c in second.items() if p not in changed}).union(frame(spark, changed, 20200202000000)), 20210201000000)
    third = {p: c for p, c in second.items() if not p.startswith("d/")}
    states.append(third)
    last = frame(spark, {p: c for p, c in third.items() if p not in changed}).union(frame(spark, changed, 20200202000000))
    vault.add(last, 20200101000000)
    return vault, states, first, two, last


def test_figures(story):
    vault, _, first, two, _ = story
    assert first["updates"] == len(BASE) and first["deletes"] == 0
    assert two["updates"] == 2 and two["deletes"] == 1 and 0 < two["frags"] < 12  # the long file shares all but a few fragments
    dates = [v["date"] for v in vault.versions()]
    assert dates == [20210101000000, 20210201000000, 20210201000001]


def test_every_version_comes_back(story):
    vault, states, *_ = story
    for k, state in enumerate(states, 1):
        assert contents(vault.extract(until=k)) == state
    assert contents(vault.extract(until=-1)) == states[1] and contents(vault.extract(until=20210115000000)) == states[0]
    assert contents(vault.extract(until=0)) == {}
    assert sorted(r["dt_path"] for r in vault.all_versions().filter("dt_date = 0").collect())[:1] == ["0002/d/3.txt"]


def test_again_nothing_is_added(spark, story):
    vault, _, _, _, last = story
    before = vault.versions()
    result = vault.add(last, 20220101000000)
    assert (result["updates"], result["deletes"], result["frags"]) == (0, 0, 0) and vault.versions() == before
    assert vault.add(last, 20220101000000, force=True)["updates"] == 0 and vault.versions() == before


def test_list_and_compare(spark, story, rows):
    vault, states, *_ = story
    marks = lambda df: sorted((r["mark"], r["dt_path"]) for r in df.collect())
    outside = frame(spark, {**states[2], "more": b"1"} | {"twin.txt": b"other"})
    got = marks(vault.list(outside, hide="="))
    assert ("+", "more") in got and ("#", "twin.txt") in got and ("+", "twin.txt") in got
    by_content = marks(vault.list(frame(spark, {**states[2], "more": b"1"}, 20230101000000), force=True))
    assert by_content == sorted([("=", p) for p in states[2]] + [("+", "more")])
    assert {r["dt_path"] for r in vault.list(until=1, select=Selection(files=["d"], exclude=["*/1*"])).collect()} == {p for p in BASE if p.startswith("d/") and not p.startswith("d/1")}


def test_extract_actions(spark, story):
    vault, states, *_ = story
    present = frame(spark, {"x/twin.txt": BASE["twin.txt"], "x/new": b"?"}).drop("content")
    select = Selection(rename_to=["x"])
    got = {r["dt_path"]: (r["action"], r["content"] is not None) for r in vault.extract(select=select, present=present).collect()}
    assert got == {"x/twin.txt": ("=", False), "x/new": ("?", False), "x/e/long.bin": (">", True)}
    assert {r["action"] for r in vault.extract(select=select, present=present, force=True).collect()} == {"=", "#", ">"}


def test_index_and_repack(spark, story, rows):
    vault, states, *_ = story
    index = vault.index_to(scratch_path(spark, "index"))
    assert rows(index.list()) == rows(vault.list()) and index.blocks().filter("payload is not null").count() == 0
    small = vault.repack_to(scratch_path(spark, "repack"), Selection(files=["e"]))
    assert contents(small.extract()) == {"e/long.bin": states[2]["e/long.bin"]}
    assert small.fragments().count() <= vault.fragments().count() and small.verify().filter("frags <> frags_ok").count() == 0
    with pytest.raises(VaultError):
        vault.repack_to(small.path)
    stats = vault.stats().first()
    assert stats["n_files"] == 3 and stats["dedupe_size"] < stats["all_size"]


def test_rollback_and_failed_version(spark, story):
    vault = Vault(spark, scratch_path(spark, "vault"), fragment=0)
    vault.add(frame(spark, {"a": b"1"}), 20210101000000)
    vault.add(frame(spark, {"a": b"22"}), 20210102000000)
    broken = frame(spark, {"a": b"333"}).withColumn("content", F.when(F.lit(True), F.raise_error(F.lit("lost")).cast("binary")))
    with pytest.raises(Exception):  # noqa: B017
        vault.add(broken, 20210103000000)
    assert contents(vault.extract()) == {"a": b"22"}
    vault.add(frame(spark, {"a": b"4444", "b": b""}), 20210104000000)
    assert contents(vault.extract()) == {"a": b"4444", "b": b""}
    vault.add(frame(spark, {"c": b"5"}), 20210105000000, until=1)
    assert contents(vault.extract()) == {"c": b"5"} and contents(vault.extract(until=1)) == {"a": b"1"} and len(vault.versions()) == 2


def test_deletes_stay_within_the_selection(spark):
    vault = Vault(spark, scratch_path(spark, "vault"))
    vault.add(frame(spark, {"a/1": b"1", "a/2": b"2", "b/1": b"3"}), 20210101000000)
    vault.add(frame(spark, {"a/1": b"1"}), 20210102000000, Selection(files=["a"]), keep_unreadable=())
    assert set(contents(vault.extract())) == {"a/1", "b/1"}
    vault.add(frame(spark, {}), 20210103000000, keep_unreadable=["b/1"])
    assert set(contents(vault.extract())) == {"b/1"}


def test_damage_and_password(spark):
    path = scratch_path(spark, "vault")
    vault = Vault(spark, path, "secret", fragment=0, block_size=4000)
    vault.add(frame(spark, BASE), 20210101000000)
    assert contents(Vault(spark, path, "secret").extract()) == BASE
    with pytest.raises(VaultError):
        Vault(spark, path, "guess")
    target = f"{path}/blocks/version_no=1"
    bad = spark.read.parquet(target).withColumn("payload", F.when(F.col("block_id") == 1, F.unhex(F.lit("00" * 40))).otherwise(F.col("payload"))).collect()
    spark.createDataFrame(bad, "block_id bigint, frags bigint, usize bigint, bsize bigint, method string, payload binary").write.mode("overwrite").parquet(target)
    assert [r["block_id"] for r in vault.verify().filter("frags_ok < frags").collect()] == [1]
    failed = {r["dt_path"] for r in vault.failures().collect()}
    got = contents(vault.extract())
    assert failed and {p for p, c in got.items() if c is None} == failed
    assert all(got[p] == c for p, c in BASE.items() if p not in failed)


def test_fixed_pieces(spark):
    vault = Vault(spark, scratch_path(spark, "vault"), fixed=1000, method="store")
    vault.add(frame(spark, BASE), 20210101000000)
    assert contents(vault.extract()) == BASE
    assert vault.fragments().agg(F.max("ht_usize")).first()[0] == 1000


def test_index_beside_and_another_password(spark, rows):
    vault = Vault(spark, scratch_path(spark, "vault"), "one", fragment=0)
    index = Vault(spark, scratch_path(spark, "index"))
    vault.add(frame(spark, BASE), 20210101000000, index=index)
    vault.add(frame(spark, {"a": b"1"}), 20210102000000, index=index)
    assert rows(index.list()) == rows(vault.list()) and rows(index.list(until=1)) == rows(vault.list(until=1))
    assert index.blocks().filter("payload is not null").count() == 0
    with pytest.raises(VaultError):
        vault.add(frame(spark, {"a": b"2"}, 20220101000000), 20210103000000, index=Vault(spark, scratch_path(spark, "index")))
    copy = vault.repack_all_to(scratch_path(spark, "copy"), "two")
    assert contents(Vault(spark, copy.path, "two").extract(until=1)) == BASE


@pytest.mark.parametrize("level", ["0", "1", "2", "3", "4", "5"])
def test_levels(spark, level):
    """Each block gets a method of its level by its pieces, and all comes back."""
    import random

    from vaultframe.functions.codecs import parse_method

    rnd = random.Random(int(level))
    n = 300 if level in "45" else 3000
    text = " ".join(rnd.choice(["house", "order", "the", "will", "ayes", "1."]) for _ in range(n // 4)).encode()
    contents = {"a.txt": text, "b.bin": rnd.randbytes(n), "c.same": b"abc" * (n // 3), "d.empty": b"", "e.txt": text + b"more"}
    frame = spark.createDataFrame([(p, 20200101000000, len(c), 0, bytearray(c)) for p, c in contents.items()], "dt_path string, dt_date bigint, dt_size bigint, dt_attr bigint, content binary")
    vault = Vault(spark, scratch_path(spark, "levels"), fragment=0, method=level, block_size=n)
    made = vault.add(frame, 20210101000000)
    assert made["read_bytes"] == sum(map(len, contents.values())) >= made["new_bytes"]
    assert {r["dt_path"]: bytes(r["content"]) for r in vault.extract().collect()} == contents
    methods = {r["method"] for r in vault.blocks().select("method").collect()}
    assert all(parse_method(m) for m in methods) and not any("{" in m for m in methods)
    assert level != "1" or len(methods) > 1
    assert vault.verify().filter("frags_ok < frags").count() == 0
