"""One consistent form for texts that look the same, by SQL of DuckDB inside Arrow partitions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaultframe.session import scratch_path

#: Fixed: letters of other alphabets and the letter of the same shape that stands for them.
LOOK_ALIKES = {
    # Cyrillic
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W",
    # Greek
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    # between Cyrillic and Greek
    "Г": "Γ", "П": "Π", "Ф": "Φ",
    # Latin
    "ɡ": "g",
}

#: Fixed: characters that show nothing, as a class of a regular expression.
INVISIBLE = (
    r"[\x{00}-\x{08}\x{0E}-\x{1F}\x{7F}-\x{84}\x{86}-\x{9F}\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}"
    r"\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{E0000}-\x{E0FFF}]"
)


def character_map() -> dict[str, str]:
    """One character for one: forms of other width, kinds of space, and look-alikes with or without accents."""
    to: dict[str, str] = {}
    for c in map(chr, (*range(0xA0, 0x3001), *range(0xFF01, 0xFFEF))):
        kind, _, rest = unicodedata.decomposition(c).partition(" ")
        if unicodedata.category(c) == "Zs":
            to[c] = " "
        elif kind in ("<wide>", "<narrow>") and " " not in rest:
            to[c] = chr(int(rest, 16))
        else:
            base, *marks = unicodedata.normalize("NFD", c)
            whole = unicodedata.normalize("NFC", "".join((LOOK_ALIKES.get(base, base), *marks)))
            if base in LOOK_ALIKES and len(whole) == 1:
                to[c] = whole
    return to


def pieces() -> dict[str, str]:
    """Accented look-alikes that have no single character once their letter is replaced."""
    to: dict[str, str] = {}
    for c in map(chr, range(0xA0, 0x2000)):
        base, *marks = unicodedata.normalize("NFD", c)
        if base in LOOK_ALIKES and marks and c not in _MAP:
            to[c] = "".join((LOOK_ALIKES[base], *marks))
    return to


_MAP = character_map()
_PIECES = pieces()


def form_sql(column: str) -> str:
    """DuckDB expression for the consistent form of a text.

    Canonical composition first, so that singletons are gone; then invisible
    characters are dropped and the rest is translated one for one; a last
    composition joins accents to the letters that the translation brought.
    Accented look-alikes without a composed counterpart are taken apart only
    where one occurs.
    """
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    text = f"regexp_replace(nfc_normalize({column}), {quote(INVISIBLE)}, '', 'g')"
    apart = text
    for c, to in _PIECES.items():
        apart = f"replace({apart}, {quote(c)}, {quote(to)})"
    text = f"CASE WHEN regexp_matches({column}, {quote('[' + ''.join(_PIECES) + ']')}) THEN {apart} ELSE {text} END"
    return f"nfc_normalize(translate({text}, {quote(''.join(_MAP))}, {quote(''.join(_MAP.values()))}))"


def _in_duckdb(frame: DataFrame, query: str, schema: str) -> DataFrame:
    """Runs a query over ``part``, the rows of one slice of a partition, inside the worker."""

    def run(batches):
        import duckdb
        import pyarrow as pa

        con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                con.register("part", pa.Table.from_batches([batch.slice(k, 1024)]))
                yield from con.sql(query).to_arrow_table().to_batches()
                con.unregister("part")
        con.close()

    return frame.mapInArrow(run, schema)


def consistent_texts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, form): each text in the consistent form, null for a null text. All other characters stay as they are: letters, case, accents, digits, words, line breaks and tabs."""
    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return _in_duckdb(rows, f"SELECT id, {form_sql('t')} AS form FROM part", f"id {kind}, form string").withColumnRenamed("id", id_col)


def form_keys(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, form_key, text_key): SHA-256 of the consistent form and of the text as stored, for rows with a text."""
    kind = documents.schema[id_col].dataType.simpleString()
    rows = documents.filter(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    query = f"SELECT id, unhex(sha256({form_sql('t')})) AS form_key, unhex(sha256(t)) AS text_key FROM part"
    return _in_duckdb(rows, query, f"id {kind}, form_key binary, text_key binary").withColumnRenamed("id", id_col)


def look_alike_pairs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: texts that aren't equal as stored but have one form.

    The pairing goes over the variants of a form, not over its documents: a
    variant is a stored text, however often it occurs, and each pair of
    variants stands for at least one pair of the result, so no step is larger
    than the result. Null texts and ids give no pair; an empty text pairs with
    one that consists of invisible characters only; repeated rows give one pair.
    """
    path = scratch_path(documents.sparkSession, "form-keys")
    form_keys(documents, id_col, text_col).withColumnRenamed(id_col, "doc").distinct().write.parquet(path)
    keys = documents.sparkSession.read.parquet(path)
    variants = keys.groupBy("form_key", "text_key").agg(F.count("*").alias("n"))
    several = variants.groupBy("form_key").agg(F.count("*").alias("k")).filter("k > 1").select("form_key")
    variants = variants.join(several, "form_key", "left_semi")
    a, b = (variants.select("form_key", F.col("text_key").alias(k)) for k in ("ka", "kb"))
    pairs = a.join(b, "form_key").filter("ka < kb").select("ka", "kb")
    members = keys.join(several, "form_key", "left_semi").select("doc", "text_key")
    pairs = pairs.join(members.select(F.col("text_key").alias("ka"), F.col("doc").alias("x")), "ka").select("kb", "x")
    pairs = pairs.join(members.select(F.col("text_key").alias("kb"), F.col("doc").alias("y")), "kb")
    return pairs.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).filter("doc_a < doc_b")
