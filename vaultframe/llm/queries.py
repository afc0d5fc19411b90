"""Queries on the operators for training data, with their SQL where there is one."""

from __future__ import annotations

from vaultframe.llm.batchdedup import accepted, repeated_files
from vaultframe.llm.bpe import encode_texts
from vaultframe.llm.mixing import Mix
from vaultframe.llm.seenfilter import filter_errors, seen_segments
from vaultframe.llm.splitting import split_entries
from vaultframe.llm.textform import consistent_texts, form_sql, look_alike_pairs
from vaultframe.session import table


def p1_found(spark, sf_dir):
    return repeated_files(table(spark, sf_dir, "batch_files"), table(spark, sf_dir, "fragments"))


def p1_links(spark, sf_dir):
    """One row a file: its class, and the number of other classes that are cases with it."""
    return accepted(table(spark, sf_dir, "batch_files"), table(spark, sf_dir, "fragments"))[0].links()


def p1_class_pairs(spark, sf_dir):
    """Pairs of classes; p1_links has their members."""
    return accepted(table(spark, sf_dir, "batch_files"), table(spark, sf_dir, "fragments"))[0].class_pairs()


def p2_found(spark, sf_dir):
    return seen_segments(table(spark, sf_dir, "segments"), table(spark, sf_dir, "seed_keys"))


def p2_errors(spark, sf_dir):
    """Keys, those seen before by the exact list, and those of them that the filters missed."""
    return filter_errors(table(spark, sf_dir, "segments"), table(spark, sf_dir, "seed_keys")).select("keys", "seen", "missed")


def p2_rates(spark, sf_dir):
    """The rates of wrong answers, measured and derived, of filters with remainders so short that there are some."""
    return filter_errors(table(spark, sf_dir, "segments"), table(spark, sf_dir, "seed_keys"), remainder_bits=4)


def p5_found(spark, sf_dir):
    pieces = split_entries(table(spark, sf_dir, "entries"), table(spark, sf_dir, "fragments"))
    return pieces.filter("piece_no = 2").select("entry_id")


def p5_pieces(spark, sf_dir):
    return split_entries(table(spark, sf_dir, "entries"), table(spark, sf_dir, "fragments"))


def p7_ids(spark, sf_dir):
    return encode_texts(table(spark, sf_dir, "documents"))


def p8_mix(spark, sf_dir):
    return Mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).documents()


def p8_shares(spark, sf_dir):
    return Mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")).shares()


def p9_found(spark, sf_dir):
    return look_alike_pairs(table(spark, sf_dir, "documents"))


def p9_texts(spark, sf_dir):
    return consistent_texts(table(spark, sf_dir, "documents"))


_BASE32_GROUP = "printf('%010X', CAST(list_sum(list_transform(range(8), lambda j: (strpos('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', substr(upper(b), CAST({g} + j + 1 AS BIGINT), 1)) - 1) * (CAST(1 AS BIGINT) << CAST(5 * (7 - j) AS INTEGER)))) AS BIGINT))"

_CONTENT = """WITH known AS (SELECT frag_id, ht_sha1, ht_usize FROM fragments WHERE ht_usize > 0 AND ht_sha1 IS NOT NULL AND hex(ht_sha1) <> repeat('0', 40)),
el AS (SELECT DISTINCT p.file_id, p.batch_no, k.ht_sha1, k.ht_usize AS w FROM (SELECT file_id, batch_no, unnest(dt_ptr) AS frag_id FROM batch_files) p JOIN known k USING (frag_id)),
tot AS (SELECT file_id, batch_no, sum(w) AS t FROM el GROUP BY ALL)"""
_CLASSES = f"""{_CONTENT},
s AS (SELECT file_id, min(file_id) OVER (PARTITION BY content) AS class_id FROM (SELECT file_id, string_agg(hex(ht_sha1), ' ' ORDER BY ht_sha1) AS content FROM el GROUP BY 1)),
com AS (SELECT a.file_id AS a, b.file_id AS b, sum(a.w) AS c FROM el a JOIN el b ON a.ht_sha1 = b.ht_sha1 AND a.file_id < b.file_id WHERE a.file_id IN (SELECT class_id FROM s) AND b.file_id IN (SELECT class_id FROM s) GROUP BY ALL),
alike AS (SELECT a, b FROM com JOIN tot x ON x.file_id = a JOIN tot y ON y.file_id = b WHERE c >= 0.6 * (x.t + y.t - c))"""

_KEYED = f"""WITH bare AS (SELECT seg_id, trim(regexp_replace(trim(ht_sha1, chr(9) || chr(10) || chr(13) || ' '), '^((urn:)?sha-?1\\s*[:=\\-]\\s*|0x)', '', 'i')) AS b FROM segments),
forms AS (SELECT seg_id, b, regexp_replace(b, '[\\s:\\-_.]+', '', 'g') AS d FROM bare),
keyed AS (SELECT seg_id, CASE
    WHEN regexp_full_match(d, '[0-9A-Fa-f]{{40}}') THEN upper(d)
    WHEN regexp_full_match(b, '[A-Za-z2-7]{{32}}') THEN {" || ".join(_BASE32_GROUP.format(g=8 * g) for g in range(4))}
    WHEN regexp_full_match(b, '[A-Za-z0-9+/]{{27}}=?') THEN hex(from_base64(rtrim(b, '=') || '=')) END AS key FROM forms
  UNION ALL SELECT -1, hex(ht_sha1) FROM seed_keys WHERE octet_length(ht_sha1) = 20)"""

SQL = {
    "p1_found": f"""{_CONTENT},
com AS (SELECT a.file_id AS file_a, b.file_id AS file_b, sum(a.w) AS c FROM el a JOIN el b ON a.ht_sha1 = b.ht_sha1 AND a.file_id < b.file_id WHERE b.batch_no >= 1 GROUP BY ALL)
SELECT file_a, file_b FROM com JOIN tot x ON x.file_id = file_a JOIN tot y ON y.file_id = file_b WHERE c >= 0.6 * (x.t + y.t - c)""",
    "p1_links": f"""{_CLASSES}
SELECT s.file_id, s.class_id, coalesce(n, 0) AS n_links FROM s LEFT JOIN (SELECT class_id, count(*) AS n FROM (SELECT a AS class_id FROM alike UNION ALL SELECT b FROM alike) GROUP BY 1) USING (class_id)""",
    "p1_class_pairs": f"""{_CLASSES}
SELECT a AS class_a, b AS class_b FROM alike""",
    "p2_found": f"""{_KEYED}
SELECT seg_id FROM (SELECT seg_id, min(seg_id) OVER (PARTITION BY key) AS first_id FROM keyed WHERE key IS NOT NULL AND key <> repeat('0', 40)) WHERE seg_id > first_id AND seg_id >= 0""",
    "p2_errors": f"""{_KEYED}
SELECT count(*) AS keys, count(*) FILTER (WHERE seg_id > first_id) AS seen, CAST(0 AS BIGINT) AS missed FROM (SELECT seg_id, min(seg_id) OVER (PARTITION BY key) AS first_id FROM keyed WHERE key IS NOT NULL AND key <> repeat('0', 40)) WHERE seg_id >= 0""",
    "p5_found": """SELECT e.entry_id FROM (SELECT entry_id, unnest(dt_ptr) AS frag_id FROM entries) e JOIN fragments f USING (frag_id)
WHERE f.ht_usize > 0 GROUP BY e.entry_id HAVING sum(f.ht_usize) > 524288""",
    "p9_found": f"""WITH k AS (SELECT doc_id, text, {form_sql("text")} AS form FROM documents WHERE text IS NOT NULL)
SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM k a JOIN k b ON a.form = b.form AND a.doc_id < b.doc_id WHERE a.text <> b.text""",
    "p9_texts": f"""SELECT doc_id, {form_sql("text")} AS form FROM documents""",
}

QUERIES = {f.__name__: f for f in (p1_found, p1_links, p1_class_pairs, p2_found, p2_errors, p2_rates, p5_found, p5_pieces, p7_ids, p8_mix, p8_shares, p9_found, p9_texts)}
