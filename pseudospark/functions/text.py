"""Predicates over raw cell text."""

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from pseudospark.schemas import MISSING_PLACEHOLDERS

# All Unicode white space; Spark's trim() strips only U+0020.
SPACE = r"[\s\p{Z}\x{85}]"

_FIRST_VISIBLE, _AFTER_VISIBLE = 0x21, 0x7F  # ASCII characters that are no white space


def _starts_plain(value: Column, special: set[str]) -> Column:
    """True if the first character is visible ASCII and none of ``special``.

    A few byte comparisons, which settle nearly every real value without a regular expression.
    """
    ranges = []
    start = _FIRST_VISIBLE
    for code in [*sorted(ord(c) for c in special), _AFTER_VISIBLE]:
        if start < code:
            ranges.append((value >= F.lit(chr(start))) & (value < F.lit(chr(code))))
        start = code + 1
    return reduce(lambda a, b: a | b, ranges)


def is_blank(value: Column) -> Column:
    """True for null, empty and all-white-space text. Stops at the first visible character."""
    blank = ~value.rlike(r"[^\s\p{Z}\x{85}]")
    return F.when(value.isNull(), True).when(_starts_plain(value, set()), False).otherwise(blank)


def is_missing(value: Column, placeholders=MISSING_PLACEHOLDERS) -> Column:
    """True for blank text and for a placeholder in any letter case, white space around it ignored."""
    # A placeholder with white space around it can never equal a trimmed cell.
    usable = [p for p in placeholders if p and p == p.strip()]
    if not usable:
        return is_blank(value)
    ascii_only = all(p.isascii() for p in usable)
    words = "|".join(_quoted(p) for p in usable)
    flags = "(?i)" if ascii_only else "(?iu)"
    # Anchored, so a long text fails at its first character that fits no placeholder.
    matches = value.rlike(rf"{flags}\A{SPACE}*(?:{words})?{SPACE}*\z")
    result = F.when(value.isNull(), True)
    if ascii_only:
        initials = {c for p in usable for c in (p[0].upper(), p[0].lower())}
        result = result.when(_starts_plain(value, initials), False)
    return result.otherwise(matches)


def _quoted(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}#&~-])", r"\\\1", text)


#: Of at least so many characters, a run of upper-case hex digits travels as bytes.
_HEX_RUN = r"(?:[0-9A-F]{2}){8,}"


def packed(text: Column) -> Column:
    """A text for a shuffle: its first long run of hex digits as bytes, which takes half the room, and what stands around."""
    run = F.regexp_extract(text, _HEX_RUN, 0)
    at = F.instr(text, run)
    after = F.substring(text, at + F.length(run), F.length(text))
    return F.struct(F.substring(text, F.lit(1), at - 1).alias("before"), F.unhex(run).alias("run"), after.alias("after"))


def unpacked(column: Column) -> Column:
    """The text that ``packed`` took apart."""
    return F.concat(column["before"], F.hex(column["run"]), column["after"])
