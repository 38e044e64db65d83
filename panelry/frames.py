"""Small helpers every module needs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelry.errors import MissingColumns

_ARROW = {
    "string": pa.string(),
    "int": pa.int32(),
    "bigint": pa.int64(),
    "double": pa.float64(),
    "boolean": pa.bool_(),
}


def local_frame(spark: SparkSession, schema: dict[str, str], rows: Iterable[Sequence]) -> DataFrame:
    """Driver metadata (headers, plans) as a frame whose size the optimizer knows."""
    rows = list(rows)
    columns = [
        pa.array([row[i] for row in rows], type=_ARROW[kind])
        for i, kind in enumerate(schema.values())
    ]
    return spark.createDataFrame(pa.table(columns, names=list(schema)))


def as_list(names: str | Sequence[str]) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def require(df: DataFrame, columns: Iterable[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumns(f"columns not in the frame: {', '.join(missing)}")


def quote(column: str) -> str:
    """A column name as SQL text, dots included.

    Selections of hundreds of columns are written as text: one call to the JVM
    each, where column objects would take several per column.
    """
    return "`" + column.replace("`", "``") + "`"


def name(column: str) -> Column:
    """Column by its exact name, dots included."""
    return F.col(quote(column))


def with_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose grouping keys are all known; a null key forms no group."""
    for key in keys:
        df = df.filter(name(key).isNotNull())
    return df


def explode_cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row ``(posicao, valor)`` per cell, every value as text.

    An exploded array keeps the generated code small for hundreds of columns,
    where an unpivot expands into one projection per column.
    """
    cells = ", ".join(f"CAST({quote(c)} AS STRING)" for c in columns)
    return df.selectExpr(f"posexplode(array({cells})) AS (posicao, valor)")
