import unicodedata

from vaultframe.llm.textform import LOOK_ALIKES, character_map, consistent_texts, look_alike_pairs, pieces

DOCS = "doc_id bigint, text string, form string, form_key string, n string"
SAME = [
    "Sérénité, 12 % (oui)\n\tfin",
    "Sérénité, 12 % (oui)\n\tfin",
    "Sérénité， １２ ％ (oui)\n\tfin",
    "﻿Sé​ré­nité, 12　% (оuі)\n\tfin",
    "Ѕérénité, 12 % (ｏｕｉ)\n\tfin",
]
OTHER = ["Serenite, 12 % (oui)\n\tfin", "sérénité, 12 % (oui)\n\tfin", "Sérénité, 13 % (oui)\n\tfin", "Sérénité, 12 % (oui)\n fin", "Sérénité, 12  % (oui)\n\tfin", "Sérénité, 12 % (oui) \tfin"]


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "", "", "") for k, t in enumerate(texts)], DOCS)


def brute(text):
    """Letter by letter over the canonical decomposition."""
    out = []
    for c in unicodedata.normalize("NFD", text):
        kind, _, rest = unicodedata.decomposition(c).partition(" ")
        c = chr(int(rest, 16)) if kind in ("<wide>", "<narrow>") else c
        if unicodedata.category(c) == "Cf" or 0xFE00 <= ord(c) <= 0xFE0F or c in "\u115f\u1160\u3164":
            continue
        out.append(" " if unicodedata.category(c) == "Zs" else LOOK_ALIKES.get(c, c))
    return unicodedata.normalize("NFC", "".join(out))


def test_form_is_that_of_brute_force(spark):
    texts = [*SAME, *OTHER, "½ ⅓ ™ №5 ﬁ ²", "Ή όλη η Ελλάδα", "ёлка и Йод", "ｶﾞ", "Å ;", "", " ", "​", "e​́", *(c for c in character_map()), *pieces()]
    got = dict(consistent_texts(frame(spark, texts)).collect())
    assert got == {k: brute(t) for k, t in enumerate(texts)}
    again = dict(consistent_texts(frame(spark, [got[k] for k in range(len(texts))])).collect())
    assert again == got


def test_pairs(spark, rows):
    texts = [*SAME, *OTHER, SAME[0], None, None, "", "​", " ", " "]
    expected = sorted((a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if texts[a] is not None and texts[b] is not None and texts[a] != texts[b] and brute(texts[a]) == brute(texts[b]))
    got = look_alike_pairs(frame(spark, texts))
    assert rows(got) == sorted(expected, key=repr)
    assert rows(look_alike_pairs(frame(spark, texts).union(frame(spark, texts[:3])))) == sorted(expected, key=repr)
    assert look_alike_pairs(frame(spark, []).limit(0)).count() == 0


def test_a_text_that_a_third_has(spark):
    texts = ["Order! Order!"] * 300 + ["Order! Order!"] * 2 + [f"text {k}" for k in range(300)]
    assert look_alike_pairs(frame(spark, texts)).count() == 600


def test_long_text(spark):
    long = "а word " * 60_000
    got = consistent_texts(frame(spark, [long])).first()["form"]
    assert got == "a word " * 60_000
