"""Text expressions shared by the filters, the sheets and the cut addresses."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# (?U): the blanks Unicode knows, not only the ASCII ones Spark's trim removes.
_EDGE_BLANKS = r"(?U)^\s+|\s+$"


def strip(col: Column) -> Column:
    """Remove every leading and trailing blank, tabs and no-break spaces included."""
    return F.regexp_replace(col, _EDGE_BLANKS, "")


def fold(col: Column) -> Column:
    """Case-insensitive form of a text."""
    return F.replace(F.lower(col), F.lit("ß"), F.lit("ss"))


def fold_literal(text: str) -> str:
    return text.lower().replace("ß", "ss")


def _ascii_table() -> tuple[dict[str, str], dict[str, str]]:
    """Letters and signs whose compatibility form holds ASCII characters."""
    single, several = {}, {}
    for code in range(0xA0, sys.maxunicode + 1):
        if 0xAC00 <= code < 0xF900:  # syllables, surrogates and private use have none
            continue
        char = chr(code)
        plain = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            single[char] = plain
        elif plain:
            several[char] = plain
    return single, several


_SINGLE, _SEVERAL = _ascii_table()


def to_ascii(col: Column) -> Column:
    """Drop accents; characters without an ASCII form disappear."""
    out = F.translate(col, "".join(_SINGLE), "".join(_SINGLE.values()))
    # ligatures, enclosed numbers and the like are rare: only texts that hold any are taken apart
    known = F.str_to_map(F.lit("\x1e".join(f"{a}\x1f{b}" for a, b in _SEVERAL.items())), F.lit("\x1e"), F.lit("\x1f"))
    apart = F.array_join(F.transform(
        F.split(out, ""), lambda c: F.when(c < "\x80", c).otherwise(F.coalesce(known[c], F.lit("")))), "")
    return F.when(out.rlike(r"[^\x00-\x7F]"), apart).otherwise(out)


def slug(*parts: Column) -> Column:
    """Deterministic file name of the parts joined by ``-``."""
    plain = to_ascii(F.lower(F.concat_ws("-", *parts)))
    return F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9-]+", "-"), r"^-+|-+$", "")
