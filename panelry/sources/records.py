"""Text records inside a plan: lines of an edition parsed and written by schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelry import fixed
from panelry.errors import MissingColumns
from panelry.frames import name, quote
from panelry.functions import types

BAD_LINE = "linha_ruim"


def _options(sep: str) -> dict[str, str]:
    return {"sep": sep, "quote": '"', "escape": '"'}


def parse_records(
    lines: DataFrame,
    header: str | Sequence[str],
    line: str = "value",
    columns: Sequence[str] | None = None,
    sep: str = fixed.SEPARATOR,
    bad: str = BAD_LINE,
) -> DataFrame:
    """Lines of one edition to its columns, as text; the lines may come from any frame.

    ``header`` is the edition's first line or its names in file order.  The other columns of
    ``lines`` stay.  Tokens that mean "no value" are null, requested columns that do not exist
    are left out, and a line whose number of fields is not the header's keeps its text in
    ``bad`` (null for all others): its fields that were there are given, the missing ones null.
    """
    names = header.split(sep) if isinstance(header, str) else list(header)
    kept = [c for c in (columns if columns is not None else names) if c in names]
    if not kept:
        raise MissingColumns("none of the requested columns exists in the header")
    schema = ", ".join(f"{quote(c)} STRING" for c in [*names, bad])
    fields = F.from_csv(
        name(line), schema, _options(sep) | {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}
    )
    others = [c for c in lines.columns if c != line]
    # A generator of one row, so that a line is parsed once however many columns are asked for.
    parsed = lines.select(*map(name, others), F.explode(F.array(fields)).alias("__r"))
    return parsed.select(
        *map(name, others),
        *[types.blank_to_null(F.col("__r")[c]).alias(c) for c in kept],
        F.col("__r")[bad].alias(bad),
    )


def to_record(columns: Sequence[str | Column], sep: str = fixed.SEPARATOR) -> Column:
    """One line of text from columns; separators, quotes and line breaks are quoted."""
    cells = [name(c) if isinstance(c, str) else c for c in columns]
    return F.to_csv(F.struct(*cells), _options(sep))
