import random

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from vaultframe.llm.bpe import PATTERN, TrieEncoder, count_tokens, encode_texts, encoder

DOCS = "doc_id bigint, text string, ids string, n_tokens string"


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=encoder().ranks, special_tokens={})


def ids(text):
    values, counts = encoder().encode_many([text])
    assert counts.tolist() == [len(values)] == encoder().count_many([text]).tolist()
    return values.tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_same_as_plain_merges(text):
    reference = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=encoder().ranks, special_tokens={})
    assert ids(text) == reference.encode_ordinary(text)


@pytest.mark.parametrize("text", ["", " ", "<|endoftext|>", "a" * 3000, " " * 700, "\n \t " * 90, "don't we'll", "= " * 400 + "x", "日本語のテキスト", "👩‍🌾" * 40])
def test_special_texts(plain, text):
    assert ids(text) == plain.encode_ordinary(text)


def test_parts_and_forgetting(plain, monkeypatch):
    """Long texts in several parts, many texts in one part, and a memory that is cleared on the way give the same ids."""
    from vaultframe.llm import bpe

    monkeypatch.setattr(bpe, "LONG", 50)
    monkeypatch.setattr(bpe, "AT_ONCE", 7)
    monkeypatch.setattr(bpe, "REMEMBERED", 20)
    rnd = random.Random(4)
    texts = [rnd.choice([None, "", "".join(rnd.choice("ab c9é.\n") for _ in range(rnd.randrange(200)))]) for _ in range(80)]
    expected = [plain.encode_ordinary(t or "") for t in texts]
    enc = TrieEncoder(encoder().ranks)
    values, counts = enc.encode_many(texts)
    assert values.tolist() == [i for x in expected for i in x] and counts.tolist() == list(map(len, expected))
    assert enc.count_many(texts).tolist() == counts.tolist()


def test_prefixes_are_walked_once():
    enc = TrieEncoder(encoder().ranks)
    words = [" inter", " international", " internationally", " interest", "x"]
    assert {w: list(v) for w, v in enc.walk(words).items()} == {w: enc.merge(w.encode()) for w in words}


def test_queries_on_dirty_rows(spark, rows, plain):
    rnd = random.Random(3)
    texts = [None, "", "Hear, hear!", "x" * 20000, *("".join(rnd.choice("ab é\nЖ9.") for _ in range(rnd.randrange(200))) for _ in range(1500))]
    frame = spark.createDataFrame([(k, t, "x", "y") for k, t in enumerate(texts)] + [(None, "a b", "", ""), (0, None, "", "")], DOCS)
    got = dict(encode_texts(frame).filter("doc_id is not null").collect())
    assert got == {k: plain.encode_ordinary(t or "") for k, t in enumerate(texts)}
    assert encode_texts(frame).count() == len(texts) + 2
    assert dict(count_tokens(frame).filter("doc_id is not null").collect()) == {k: len(v) for k, v in got.items()}
    assert encode_texts(frame.limit(0)).count() == 0
