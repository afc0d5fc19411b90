"""Archive operators on dirty, empty and clashing input."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vaultframe.operators import chunk, compare, journal, numbering, packing, rollup

T0 = datetime(2021, 1, 1)
E = "entry_id bigint, archive_id int, version_id bigint, seq_no int, dt_path string, dt_date bigint, dt_size bigint, dt_attr bigint, dt_ptr array<bigint>, loaded_at timestamp, mark string, version_no int"
V = "version_id bigint, archive_id int, version_no int, ver_date bigint, ver_csize bigint, ver_offset bigint, ver_first_fragment bigint, dt_path string"
FR = "frag_id bigint, ht_sha1 binary, ht_usize int, block_id bigint, pos_in_block int, dt_path string, pos int"


def entry(i, v, seq, path, date=1, size=5, attr=7, ptr=(1,), hour=0):
    return (i, 1, v, seq, path, date, size, attr, None if ptr is None else list(ptr), T0 + timedelta(hours=hour), "m", 99)


@pytest.fixture(scope="module")
def archive(spark):
    versions = [(10, 1, 1, 20210101000000, 100, 0, 1, ""), (20, 1, 2, 20210301000000, 100, 100, 5, ""), (30, 1, 3, 20210201000000, 100, 200, 5, ""), (40, 1, 4, 20210401000000, -1, 300, 9, ""), (50, 1, 5, 20210501000000, 10, 400, 9, "")]
    entries = [entry(1, 10, 1, "a"), entry(2, 10, 2, "d/"), entry(3, 10, 3, "d/x", size=10), entry(4, 10, 3, "d/x", size=11, hour=1), entry(5, 20, 1, "a", date=0, ptr=()), entry(6, 20, 2, "d/x", size=20), entry(7, 30, 1, "b", ptr=None), entry(8, 30, 2, None), entry(9, 40, 1, "late"), entry(10, 50, 1, "later"), entry(11, 30, 3, "b", size=None)]
    return spark.createDataFrame(entries, E), spark.createDataFrame(versions, V)


def test_cut_is_a_prefix(archive):
    numbers = lambda until: sorted(r["version_no"] for r in journal.as_of(archive[1], until).collect())
    assert numbers(None) == [1, 2, 3]
    assert numbers(20210215000000) == [1]  # version 3 has an earlier date, but comes after the cut
    assert numbers(2) == [1, 2] and numbers(0) == [] and numbers(-1) == [1, 2] and numbers(-9) == []


def test_snapshots(archive):
    got = lambda until=None, **k: {r["dt_path"]: r["dt_size"] for r in journal.snapshot(*archive, until, **k).collect()}
    assert got() == {"d/": 5, "d/x": 20, "b": None}
    assert got(1) == {"a": 5, "d/": 5, "d/x": 11}
    assert set(got(keep_deleted=True)) == {"a", "d/", "d/x", "b"}
    assert {r["dt_path"] for r in journal.all_versions(*archive, 1, width=2).collect()} == {"01/", "01/a", "01/d/", "01/d/x"}
    stats = {r["version_no"]: (r["updates"], r["deletes"], r["csize"]) for r in journal.version_stats(*archive).collect()}
    assert stats == {1: (3, 0, 100), 2: (1, 1, 100), 3: (2, 0, None)}
    assert [r["commit_date"] for r in journal.commit_dates(archive[1]).orderBy("version_no").collect()][:3] == [20210101000000, 20210301000000, 20210301000001]


def test_nothing(spark, archive):
    entries, versions = spark.createDataFrame([], E), spark.createDataFrame([], V)
    fragments = spark.createDataFrame([], FR)
    assert journal.snapshot(entries, versions).count() == journal.version_stats(entries, versions).count() == journal.all_versions(entries, versions).count() == 0
    assert compare.compare(entries, entries).count() == 0 and compare.mark_counts(compare.compare(entries, entries)).first()["same"] == 0
    assert rollup.file_sizes(entries, fragments).count() == rollup.directory_sizes(entries).count() == rollup.dedupe_stats(entries, fragments).count() == 0
    assert numbering.number_rows(fragments, ["frag_id"], "n").count() == 0
    assert packing.pack_blocks(fragments.select("frag_id", "ht_usize"), 100).count() == 0
    assert chunk.chunk_content(spark.createDataFrame([], "k int, c binary"), "k", "c").count() == 0


def test_marks(spark):
    inner = spark.createDataFrame([entry(1, 1, 1, "same"), entry(2, 1, 2, "attr", attr=9), entry(3, 1, 3, "size"), entry(4, 1, 4, "noattr", attr=0), entry(5, 1, 5, "gone"), entry(6, 1, 6, "null", date=None)], E)
    outer = spark.createDataFrame([entry(1, 1, 1, "same"), entry(2, 1, 2, "attr"), entry(3, 1, 3, "size", size=6), entry(4, 1, 4, "noattr"), entry(5, 1, 5, "new"), entry(6, 1, 6, "null", date=None)], E)
    marks = sorted((r["mark"], r["dt_path"]) for r in compare.compare(inner, outer).collect())
    assert marks == [("#", "attr"), ("#", "size"), ("+", "attr"), ("+", "new"), ("+", "size"), ("-", "gone"), ("=", "noattr"), ("=", "null"), ("=", "same")]
    assert compare.mark_counts(compare.compare(inner, outer)).first().asDict() == {"same": 3, "different": 2, "external": 3, "internal": 1}
    assert {r["mark"] for r in compare.compare(inner, outer, hide="-").collect()} == {"#", "+"}
    assert sorted(r["dt_path"] for r in compare.needs_reading(inner, outer).collect()) == ["new", "size"]
    assert sorted(r["dt_path"] for r in compare.needs_entry(inner, outer).collect()) == ["attr", "new", "size"]
    assert [r["dt_path"] for r in compare.needs_delete(inner, outer).collect()] == ["gone"]


def test_largest_and_twins(spark):
    rows = spark.createDataFrame([entry(1, 1, 1, "p", size=9, ptr=(1, 2)), entry(2, 1, 2, "q", size=9, ptr=(1, 2)), entry(3, 1, 3, "r", size=9, ptr=(1,)), entry(4, 1, 4, "s", size=50, ptr=()), entry(5, 1, 5, "t", size=50, ptr=()), entry(6, 1, 6, "u/", size=9, ptr=(1, 2))], E)
    got = [(r["dt_path"], r["mark"]) for r in compare.largest(rows, 6).collect()]
    assert got == [("s", "m"), ("t", "m"), ("r", "m"), ("p", "m"), ("q", "^"), ("u/", "m")]
    assert sorted((r["dt_path"], r["copies"]) for r in compare.twins(rows).collect()) == [("p", 3), ("q", 3), ("u/", 3)]


def test_sizes(spark):
    fragments = spark.createDataFrame([(1, None, 5, 1, 0, "", 0), (2, None, 7, 1, 1, "", 0), (3, None, None, None, None, "", 0), (4, None, -1, 1, 2, "", 0)], FR)
    files = spark.createDataFrame([entry(1, 1, 1, "a", ptr=(1, 2, 1)), entry(2, 1, 2, "b", ptr=(1, 3)), entry(3, 1, 3, "c", ptr=(77,)), entry(4, 1, 4, "d", ptr=None), entry(5, 1, 5, "e", ptr=())], E)
    assert {r["entry_id"]: r["content_size"] for r in rollup.file_sizes(files, fragments).collect()} == {1: 17, 2: -1, 3: 0, 4: 0, 5: 0}
    stats = rollup.dedupe_stats(files, fragments).first()
    assert (stats["n_files"], stats["refs"], stats["n_frags"], stats["all_size"], stats["dedupe_size"], stats["unknown"]) == (5, 5, 3, 22, 12, 1)
    assert {(r["pos"], r["offset_in_file"]) for r in rollup.file_offsets(files.filter("entry_id = 1"), fragments).collect()} == {(0, 0), (1, 5), (2, 12)}


def test_directories(spark):
    files = spark.createDataFrame([entry(k, 1, k, p, size=s) for k, (p, s) in enumerate([("a/", 0), ("a/b/", 0), ("a/b/x", 5), ("a/y", 7), ("a/b/c/z", 1), ("q", 100), ("e/", None), ("a/n", None), ("a/m", -1)])], E)
    got = {r["dt_path"]: (r["total_size"], r["n_files"]) for r in rollup.directory_sizes(files).collect()}
    assert got == {"a/": (13, 5), "a/b/": (6, 2), "e/": (0, 0)}


@pytest.mark.parametrize("ptr,text", [([5, 6], "5 6"), ([5, 6, 7], "5-7"), ([1, 2, 3, 4, 9, 11, 12, 13], "1-4 9 11-13"), ([4], "4"), ([3, 2, 1], "3 2 1"), ([], "")])
def test_pointer_text(spark, ptr, text):
    assert spark.createDataFrame([(ptr,)], "p array<bigint>").select(rollup.pointer_text(F.col("p")).alias("t")).first()["t"] == text


def test_stream_files(spark):
    segments = [(1, "o", "", 5), (2, "o", "f", 1), (3, "o", None, 2), (70_000, "o", "", 4), (140_000, "o", "g", -1), (5, None, "h", 3)]
    got = sorted((tuple(r) for r in rollup.stream_files(spark.createDataFrame(segments, "seg_id bigint, origin string, seg_name string, ht_usize int")).collect()), key=repr)
    assert got == sorted([("o", 0, None, 1, 1, 5), ("o", 1, "f", 2, 3, 7), ("o", 2, "g", 140_000, 1, 0), (None, 1, "h", 5, 1, 3)], key=repr)


def test_numbers_blocks_and_runs(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"), (F.col("id") % 3).alias("g"))
    got = [(r["v"], r["n"]) for r in numbering.number_rows(rows, ["v"], "n").orderBy("v").collect()]
    assert [n for _, n in got] == list(range(1, 5001))
    by = numbering.number_rows(rows, ["v"], "n", by="g").groupBy("g").agg(F.max("n").alias("m"), F.countDistinct("n").alias("d"), F.count("*").alias("c")).collect()
    assert all(r["m"] == r["d"] == r["c"] for r in by)
    frags = spark.range(1, 200_001).select(F.col("id").alias("frag_id"), (F.col("id") % 50).alias("ht_usize"))
    packed = packing.pack_blocks(frags, 10_000)
    sizes = packed.groupBy("block_no").agg(F.sum(F.col("ht_usize") + 4).alias("s"), F.min("block_offset").alias("o"), F.min("frag_id").alias("a"), F.max("frag_id").alias("b")).orderBy("block_no").collect()
    assert all(r["s"] < 10_060 and r["o"] == 0 for r in sizes) and all(x["b"] + 1 == y["a"] for x, y in zip(sizes, sizes[1:]))
    runs = rollup.id_runs(spark.createDataFrame([(1, x) for x in (1, 2, 3, 3, 7)], "k int, v bigint"), ["k"], "v")
    assert sorted(tuple(r) for r in runs.collect()) == [(1, 1, 3, 3), (1, 7, 7, 1)]


def plain_fragments(data, f):
    """A byte at a time: the hash and the table of what last followed each byte begin anew with every fragment."""
    cuts, start, h, last, follows = [], 0, 0, 0, [0] * 256
    for i, c in enumerate(data):
        h = (h + c + 1) * (314159265 if follows[last] == c else 271828182) % 2**32
        follows[last], last = c, c
        if i + 1 - start == 8128 << f or (i + 1 - start >= 64 << f and h < 2 ** (22 - f)):
            cuts.append((start, i + 1))
            start, h, last, follows = i + 1, 0, 0, [0] * 256
    return [*cuts, (start, len(data))]


@pytest.mark.parametrize("f,strip", [(0, 1 << 14), (0, 100), (2, 333)])
def test_same_pieces_as_a_plain_chunker(f, strip, monkeypatch):
    import random

    monkeypatch.setattr(chunk, "STRIP", strip)
    rnd = random.Random(f + strip)
    text = lambda n: " ".join(rnd.choice(["house", "order", "the", "will", "ayes", "1.", "it"]) for _ in range(n)).encode()
    contents = [b"", b"x", b"a" * 30_000, bytes(20_000), rnd.randbytes(40_000), text(8000)]
    contents += [rnd.choice([rnd.randbytes, text, bytes])(rnd.randrange(1, 3000)) for _ in range(60)]
    rnd.shuffle(contents)
    got = [[(x.begin, x.end) for x in pieces] for pieces in chunk.fragments_of(contents, f)]
    assert got == [plain_fragments(c, f) for c in contents]


def test_one_long_content_takes_no_room_for_all():
    import tracemalloc

    contents = [b"short" * 20] * 511 + [bytes(3_000_000)]
    tracemalloc.start()
    chunk.fragments_of(contents, 6)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40_000_000


def test_chunks_are_local(spark):
    import random

    data = random.Random(4).randbytes(60_000)
    cut = lambda d: {d[x.begin : x.end] for x in chunk.fragments_of([d], 0)[0]}
    assert len(cut(b"inserted" + data) - cut(data)) <= 3
    least, most = chunk.size_limits(0)
    pieces = chunk.fragments_of([data], 0)[0]
    assert all(least <= x.end - x.begin <= most for x in pieces[:-1]) and b"".join(data[x.begin : x.end] for x in pieces) == data
    assert [(x.begin, x.end) for x in chunk.fragments_of([b""], 0)[0]] == [(0, 0)]
    at_end = data[: pieces[0].end]
    assert [(x.begin, x.end) for x in chunk.fragments_of([at_end], 0)[0]] == [(0, len(at_end)), (len(at_end), len(at_end))]


def test_kinds_of_data():
    import random

    rnd = random.Random(1)
    text = " ".join(rnd.choice(["house", "order", "the", "will", "divide", "1.", "a,", "so", "we"]) for _ in range(2000)).encode()
    table = lambda d: chunk.fragments_of([d], 6)[0][0]
    t, r, code = table(text), table(rnd.randbytes(9000)), table(b"".join(bytes([rnd.randrange(256), 139]) for _ in range(3000)))
    assert chunk.is_text(t.table) and not chunk.is_text(r.table)
    assert chunk.is_code(code.table) and not chunk.is_code(t.table)
    import numpy as np

    tables = np.frombuffer(t.table + r.table + bytes(256), np.uint8).reshape(3, 256)
    of_text, of_noise, of_nothing = chunk.redundancies([len(text), 9000, 0], [t.hits, r.hits, 0], tables).tolist()
    assert of_text > len(text) // 4 > of_noise and of_nothing == 0


def brute_blocks(docs):
    """frags, bytes and redundancy of each block of 256 documents, and its method of level 1, a byte at a time."""
    out = {}
    for doc_id, text in sorted(d for d in docs if d[1] is not None):
        frags, total, saved, recent, texts = out.get(doc_id // 256, (0, 0, 0, [bytes(256)] * 4, 0))
        data = text.encode()
        for x in chunk.fragments_of([data], 0)[0]:
            piece, table, last, hits = data[x.begin : x.end], bytearray(256), 0, 0
            for c in piece:
                hits += table[last] == c
                table[last], last = c, c
            size, left, count = len(piece), len(piece), [0] * 256
            for b in table:
                if count[b] < 255:
                    left -= size * (32768 // ((count[b] + 1) * 204)) >> 15
                    count[b] += 1
            alike = sum(r[i] == table[i] for r in recent for i in range(256))
            saved += min(size, max(hits, left * left // size if size else 0, count[0] * size // 256, alike * size // 1024))
            frags, total, texts = frags + 1, total + size, texts + 2 * chunk.is_text(bytes(table))
            if size >= 64:
                recent = [*recent[1:], bytes(table)]
        out[doc_id // 256] = (frags, total, saved, recent, texts)
    rows = []
    for block, (frags, total, saved, _, texts) in out.items():
        redundancy, kind = saved // (total // 256 + 1), int(texts > frags)
        type_ = redundancy * 4 + kind
        method = "x0" + (",0" if type_ < 40 else ",1,4,0,1,15" if type_ < 80 else ",1,4,0,2,16" if type_ < 128 else ",1,4,0,2,20" if type_ < 256 else ",1,5,0,3,20" if type_ < 960 else ",1,6,0,3,20")
        rows.append((block, frags, total, redundancy, kind, method))
    return sorted(rows)


def test_block_methods(spark, rows, tmp_path):
    import random

    from vaultframe.plans.content_queries import block_methods

    rnd = random.Random(3)
    words = ["house", "order", "the", "will", "divide", "1.", "a,", "so", "we", "ayes", "have", "it"]
    make = [lambda n: " ".join(rnd.choice(words) for _ in range(n)), lambda n: "".join(chr(rnd.randrange(1, 1200)) for _ in range(n)), lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n)), lambda n: "\0" * n]
    docs = [(256 * b + k, rnd.choice([make[b], make[b], make[rnd.randrange(4)]])(rnd.choice([0, 1, 9, 60, 700]))) for b in range(4) for k in range(25)]
    docs += [(255, None), (9 * 256, ""), (10 * 256, make[1](9)), (10 * 256 + 9, make[0](3000))]
    rnd.shuffle(docs)
    spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = block_methods(spark, str(tmp_path)).select("block_no", "frags", "bytes", "redundancy", "kind", "method_1")
    assert rows(got) == sorted(brute_blocks(docs), key=repr)
    assert len({r[-1] for r in brute_blocks(docs)}) > 1


def test_report(spark):
    rows = spark.createDataFrame([entry(1, 1, 1, "a", date=20240229235958, size=12, attr=ord("u") + (0o040755 << 8), ptr=(1, 2, 3)), entry(2, 1, 2, "b", date=0, size=None, attr=None, ptr=None)], E)
    lines = [r["line"] for r in compare.report(rows, fragments=True).orderBy("dt_path").collect()]
    assert lines == ["m 2024-02-29 23:59:58           12 d0755 a 1-3", "m " + " " * 19 + "           -1 " + " " * 5 + " b "]
    assert compare.report(rows, attributes=False).orderBy("dt_path").first()["line"] == "m 2024-02-29 23:59:58           12 a"
