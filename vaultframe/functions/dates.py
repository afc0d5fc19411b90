"""Decimal dates (YYYYMMDDHHMMSS, UT), version arguments and attributes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A number up to this is a version, a larger one a date.
LAST_VERSION = 9_999_999


def parse_until(*words: str) -> int:
    """A version number (negative: so many before the last) or a date of 14 digits.

    Other characters part groups of digits; a group of one digit gets a zero before
    it; hour, minute and second default to 23, 59 and 59. ValueError for a date
    outside 1900-01-01 .. 2999-12-31.
    """
    if words[0].startswith("-"):
        if (n := int(words[0])) >= 0:
            raise ValueError(f"{words[0]} is no version")
        return n
    groups = [g for w in words for g in re.findall(r"[0-9]+", w)]
    digits = "".join(g.zfill(2) if len(g) == 1 and (k or len(groups) > 1) else g for k, g in enumerate(groups)) if len(groups) > 1 else "".join(groups)
    value = int(digits or 0)
    for low, high, default in ((19_000_000, 29_991_231, 23), (1_900_000_000, 2_999_123_123, 59), (190_000_000_000, 299_912_312_359, 59)):
        if low <= value <= high:
            value = value * 100 + default
    if value > LAST_VERSION and not 19_000_101_000_000 <= value <= 29_991_231_235_959:
        raise ValueError(f"{value} is no date of 1900 to 2999")
    return value


def decimal_date(ts: Column) -> Column:
    """14-digit date of a timestamp in the session's time zone (UTC)."""
    return F.date_format(ts, "yyyyMMddHHmmss").cast("bigint")


def to_timestamp(date: Column) -> Column:
    """Timestamp of a 14-digit date; null for 0, -1, null and what is no date."""
    return F.try_to_timestamp(F.when(date > 0, F.lpad(date.cast("string"), 14, "0")), F.lit("yyyyMMddHHmmss"))


def date_text(date: Column) -> Column:
    """``YYYY-MM-DD HH:MM:SS``, 19 blanks for a deleted or unknown (also null) date."""
    d = F.lpad(date.cast("string"), 14, "0")
    cut = lambda a, n: F.substring(d, a, n)
    text = F.concat(cut(1, 4), F.lit("-"), cut(5, 2), F.lit("-"), cut(7, 2), F.lit(" "), cut(9, 2), F.lit(":"), cut(11, 2), F.lit(":"), cut(13, 2))
    return F.when(date > 0, text).otherwise(F.lit(" " * 19))


#: Fixed: letters of the types of files by the upper four bits of a Unix mode, and of the other system's attribute bits.
TYPE_LETTERS = "0pc3d5b7 9lBsDEF"
FLAG_LETTERS = "RHS DAdFTprCoIEivs89012345678901"


def attr_text(attr: Column) -> Column:
    """``u``: a letter for the type and four octal digits of the mode; ``w``: the letters of the flags set, at least five wide; else five blanks."""
    tag = attr.bitwiseAND(255)
    mode = F.shiftright(attr, 8)
    kind = F.substring(F.lit(TYPE_LETTERS), F.shiftright(mode, 12).bitwiseAND(15).cast("int") + 1, F.lit(1))
    unix = F.concat(kind, F.lpad(F.conv(mode.bitwiseAND(4095).cast("string"), 10, 8), 4, "0"))
    flags = F.concat(*(F.when(F.shiftright(mode, i).bitwiseAND(1) == 1, c).otherwise("") for i, c in enumerate(FLAG_LETTERS)))
    windows = F.when(F.length(flags) < 5, F.rpad(flags, 5, " ")).otherwise(flags)
    return F.when(tag == ord("u"), unix).when(tag == ord("w"), windows).otherwise(F.lit(" " * 5))
