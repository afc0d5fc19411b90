"""Path predicates and renames as column expressions.

A pattern's ``?`` stands for any one byte and ``*`` for any bytes, both also for
``/``. A pattern matches a path, and everything below it; one that ends in ``/``
matches whatever begins with it. Paths of other than ASCII are compared byte by
byte. A null path matches nothing.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def pattern_regex(pattern: str) -> str:
    """Regular expression of a pattern, over the pattern's bytes read as ISO-8859-1."""
    raw = pattern.encode().decode("iso-8859-1")
    body = "".join({"*": ".*", "?": "."}.get(c) or re.sub(r"([^\w/])", r"\\\1", c, flags=re.ASCII) for c in raw)
    return rf"(?s)\A{body}" if raw.endswith("/") else rf"(?s)\A{body}(?:/.*)?\z"


def literal_prefix(pattern: str) -> str:
    """What every path that matches begins with."""
    return re.split(r"[*?]", pattern, maxsplit=1)[0].rstrip("/")


def matches(path: Column, pattern: str) -> Column:
    """Whether a path matches. The literal prefix is a predicate of its own, since only that reaches a Parquet scan."""
    test = F.decode(F.encode(path, "UTF-8"), "ISO-8859-1").rlike(pattern_regex(pattern))
    prefix = literal_prefix(pattern)
    return (path.startswith(prefix) & test) if prefix else test


def selected(path: Column, files: Sequence[str] = (), only: Sequence[str] = (), exclude: Sequence[str] = (), rename_to: Sequence[str] = (), renamed: bool = False) -> Column:
    """A path counts if one of ``files`` matches (or there are none), one of ``only`` (or there are none), and none of ``exclude``. With ``renamed`` the i-th new name takes the i-th file's place."""
    wanted = [rename_to[i] if renamed and i < len(rename_to) else f for i, f in enumerate(files)]
    keep = F.lit(True)
    for group in (wanted, only):
        if group:
            some = F.lit(False)
            for p in group:
                some = some | matches(path, p)
            keep = keep & some
    for p in exclude:
        keep = keep & ~matches(path, p)
    return keep


def append_path(a: Column, b: Column) -> Column:
    """a/b with one slash between."""
    return F.concat(F.regexp_replace(a, r"/\z", ""), F.lit("/"), F.regexp_replace(b, r"\A/", ""))


def renamed(path: Column, files: Sequence[str] = (), to: Sequence[str] = ()) -> Column:
    """Without ``files`` the first new name goes before the path; else the first file that is a plain prefix is replaced by its new name."""
    if not files:
        return append_path(F.lit(to[0]), path) if to else path
    out = None
    for f, t in zip(files, to):
        new = F.concat(F.lit(t), F.substring(path, F.lit(len(f) + 1), F.length(path)))
        out = F.when(path.startswith(f), new) if out is None else out.when(path.startswith(f), new)
    return path if out is None else out.otherwise(path)


def dirname(path: Column) -> Column:
    """Up to the last slash of either kind, with it."""
    return F.regexp_extract(path, r"(?s)\A(.*[/\\])?", 0)


def is_dir(path: Column) -> Column:
    return path.endswith("/")


def extension_key(path: Column) -> Column:
    """First five lower-cased ASCII characters of what follows the last dot of the name, empty if there is none."""
    ext = F.regexp_extract(path, r"(?s)\.([^./]*)\z", 1)
    return F.translate(F.substring(ext, 1, 5), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
