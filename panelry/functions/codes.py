"""Codes to labels.  Bounded maps become literals: no shuffle, no row growth."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelry import fixed
from panelry.errors import MissingColumns

REGION_OF_STATE = {uf: region for uf, (_, _, region) in fixed.STATES.items()}
CODE_OF_STATE = {uf: code for uf, (code, _, _) in fixed.STATES.items()}
STATE_OF_CODE = {code: uf for uf, (code, _, _) in fixed.STATES.items()}


def map_value(col: Column, table: Mapping) -> Column:
    """Literal map lookup; a key outside the map gives null."""
    if all(isinstance(key, int) for key in table):
        col = col.try_cast("int")
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[col]


def label(
    df: DataFrame,
    columns: str | list[str] | None = None,
    labels: Mapping[str, Mapping] = fixed.CODE_LABELS,
) -> DataFrame:
    """Add ``DS_<X>`` beside every coded ``TP_<X>``; the code stays."""
    wanted = [columns] if isinstance(columns, str) else columns
    if wanted is None:
        wanted = [c for c in labels if c in df.columns]
    for column in wanted:
        if column not in df.columns:
            raise MissingColumns(f"column not in the frame: {column}")
        if column not in labels:
            raise MissingColumns(f"no code labels for: {column}")
    return df.withColumns(
        {label_column(c): map_value(F.col(c), labels[c]) for c in wanted}
    )


def label_column(column: str) -> str:
    return "DS_" + column.removeprefix("TP_")


def add_region(
    df: DataFrame,
    uf_column: str = fixed.UF,
    dimension: DataFrame | None = None,
    key: str | None = None,
    region: str = "NO_REGIAO",
) -> DataFrame:
    """Add the region of each state.

    Without ``dimension`` the fixed 27-state map is used.  A dimension table
    ``(key, region)`` is joined on the left instead, unhinted: the optimizer
    broadcasts it only if it is small.
    """
    if uf_column not in df.columns:
        raise MissingColumns(f"column not in the frame: {uf_column}")
    if dimension is None:
        return df.withColumn("NO_REGIAO", map_value(F.col(uf_column), REGION_OF_STATE))
    key = key or uf_column
    table = dimension.select(
        F.col(key).alias("__uf"), F.col(region).alias("NO_REGIAO")
    ).filter(F.col("__uf").isNotNull())
    return df.join(table, df[uf_column] == table["__uf"], "left").drop("__uf")
