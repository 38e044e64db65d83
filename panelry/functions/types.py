"""Types told by names, types told by values, and their promotion."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelry import fixed
from panelry.frames import quote

# A number as the text editions write it.  A bare cast to double would also
# take '12D', '10f' or '0x1p3', which are codes, not numbers.
NUMBER = r"(?i)^\s*[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)\s*$"

# Smallest double that no longer fits a 64-bit integer.
_TWO_63 = float(2**63)


_TOKENS = ", ".join(f"'{token}'" for token in fixed.NA_TOKENS)
_LATTICE = "array(" + ", ".join(f"'{t}'" for t in fixed.LATTICE) + ")"


def text_map(table: dict[str, str]) -> Column:
    """A small map of plain texts as a literal."""
    return F.expr("map(" + ", ".join(f"'{x}'" for pair in table.items() for x in pair) + ")")


def blank_to_null(col: Column) -> Column:
    """Null for the tokens that mean "no value"."""
    return F.when(~col.isin(*fixed.NA_TOKENS), col)


def number(col: Column) -> Column:
    """The double a text holds, null when it is not a number."""
    return F.when(col.rlike(NUMBER), F.trim(col).try_cast("double"))


def has_leading_zero(col: Column) -> Column:
    """``00009`` is an identifier, ``0`` and ``0.5`` are numbers."""
    return col.startswith("0") & (F.length(col) > 1) & ~col.startswith("0.")


def fits_bigint(text: Column, value: Column) -> Column:
    """Whether a number fits 64 bits; near the limit the digits decide, not the double."""
    return F.when(F.abs(value) < _TWO_63, True).otherwise(text.try_cast("bigint").isNotNull())


def integer_type(low: Column, high: Column) -> Column:
    """Narrowest integer type that holds the range."""
    out = F.lit("Int64")
    for name, bits in (("Int32", 31), ("Int16", 15), ("Int8", 7)):
        fits = (low >= -(2.0**bits)) & (high <= 2.0**bits - 1)
        out = F.when(fits, name).otherwise(out)
    return out


def width(name: Column) -> Column:
    """Position of a type name in the lattice; an unknown name ranks widest."""
    position = F.array_position(F.expr(_LATTICE), name)
    return F.when(position > 0, position).otherwise(len(fixed.LATTICE) + 1)


def type_width(name: str) -> int:
    lattice = fixed.LATTICE
    return lattice.index(name) + 1 if name in lattice else len(lattice) + 1


def promote(name: Column) -> Column:
    """Aggregate: the narrowest type that holds all the observed ones."""
    observed = F.when(name != fixed.EMPTY, F.struct(width(name).alias("rank"), name.alias("name")))
    return F.coalesce(F.max(observed)["name"], F.lit(fixed.EMPTY))


def promote_names(names: Iterable[str | None]) -> str:
    """The same promotion for the few types of a schema, on the driver."""
    observed = [name for name in names if name and name != fixed.EMPTY]
    return max(observed, key=lambda name: (type_width(name), name), default=fixed.EMPTY)


def kind(column: Column) -> Column:
    """What the name prefix says a variable is."""
    return F.coalesce(text_map(fixed.KIND_BY_PREFIX)[F.substring(column, 1, 3)], F.lit(""))


def kind_of(column: str) -> str:
    return fixed.KIND_BY_PREFIX.get(column[:3], "")


def prefix_type(column: Column) -> Column:
    """The type the name prefix declares, ``""`` when it declares none."""
    declared = text_map(fixed.TYPE_BY_PREFIX)[F.substring(column, 1, 3)]
    return F.when(column.isin(*fixed.TEXT_CODES), "string").otherwise(
        F.coalesce(declared, F.lit(""))
    )


def prefix_type_of(column: str) -> str:
    if column in fixed.TEXT_CODES:
        return "string"
    return fixed.TYPE_BY_PREFIX.get(column[:3], "")


def lattice_type(data_type: T.DataType) -> str:
    """Lattice name of a Spark column type."""
    names = {
        T.ByteType: "Int8",
        T.ShortType: "Int16",
        T.IntegerType: "Int32",
        T.LongType: "Int64",
        T.FloatType: "Float64",
        T.DoubleType: "Float64",
        T.DecimalType: "Float64",
        T.BooleanType: "Int8",
        T.NullType: fixed.EMPTY,
    }
    return names.get(type(data_type), "string")


def blank_to_null_text(sql: str) -> str:
    """:func:`blank_to_null` as SQL text, for selections of many columns."""
    return f"CASE WHEN {sql} NOT IN ({_TOKENS}) THEN {sql} END"


def cast_columns(df: DataFrame, plan: Mapping[str, str]) -> DataFrame:
    """Cast the planned columns to lattice types; the others stay as they are.

    A text value that does not fit its type stops the job.  A plain cast would
    null it (ANSI off) or cut ``1.5`` to ``1``.
    """
    cleaned, converted, checked = [], [], []
    for i, field in enumerate(df.schema):
        column, target = quote(field.name), plan.get(field.name)
        text = isinstance(field.dataType, T.StringType)
        if target is None or not text or target == "string":
            kind = None if target is None else fixed.SPARK_TYPE[target]
            cast = column if kind is None else f"CAST({column} AS {kind})"
            cleaned.append(f"{cast} AS {column}")
            converted.append(column)
            checked.append(column)
            continue
        kind = fixed.SPARK_TYPE[target]
        cleaned.append(f"{blank_to_null_text(column)} AS {column}")
        number = f"CASE WHEN {column} RLIKE r'{NUMBER}' THEN try_cast({column} AS DOUBLE) END"
        if target != "Float64":
            whole = f"{number} % 1 = 0"
            number = (
                f"try_cast(coalesce(try_cast({column} AS BIGINT), "
                f"CASE WHEN {whole} THEN try_cast({number} AS BIGINT) END) AS {kind})"
            )
        converted += [column, f"{number} AS __{i}"]
        refused = f"raise_error(concat('value does not fit {target}: ', {column}))"
        checked.append(
            f"CASE WHEN {column} IS NULL OR __{i} IS NOT NULL THEN __{i} "
            f"ELSE CAST({refused} AS {kind}) END AS {column}"
        )
    return df.selectExpr(*cleaned).selectExpr(*converted).selectExpr(*checked)
