"""Editions into one panel, entity tables into one edition, keyed updates."""

from __future__ import annotations

import logging
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelry import fixed
from panelry.errors import MissingColumns
from panelry.frames import as_list, name, quote, require
from panelry.functions import types

log = logging.getLogger(__name__)


def load_edition(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    uf: str | Sequence[str] | None = None,
    active_only: bool = True,
    strict: bool = False,
) -> DataFrame:
    """One edition: requested columns that exist, active units, chosen states.

    Columns an edition lacks are dropped and logged.  The active filter needs
    its column among the requested ones; ``strict`` makes both cases an error.
    """
    requested = (
        list(columns) if columns is not None else [*fixed.BASIC_COLUMNS, *fixed.COUNT_COLUMNS]
    )
    kept = [c for c in requested if c in df.columns]
    dropped = [c for c in requested if c not in df.columns]
    if not kept:
        raise MissingColumns("none of the requested columns exists in the edition")
    if dropped:
        if strict:
            raise MissingColumns(f"columns not in the edition: {', '.join(dropped)}")
        log.warning("columns not in the edition, left out: %s", ", ".join(dropped))
    out = df.select(*map(quote, kept))
    if active_only and fixed.STATUS in kept:
        out = out.filter(_equals_code(out, fixed.STATUS, fixed.ACTIVE))
    elif active_only and strict:
        raise MissingColumns(f"the active filter needs {fixed.STATUS} among the columns")
    if uf is not None:
        if fixed.UF not in kept:
            raise MissingColumns(f"the state filter needs {fixed.UF} among the columns")
        out = out.filter(F.col(fixed.UF).isin(*as_list(uf)))
    return out


def _equals_code(df: DataFrame, column: str, code: int) -> Column:
    text = dict(df.dtypes)[column] == "string"
    return name(column) == (F.lit(str(code)) if text else F.lit(code))


def stack_editions(
    editions: Mapping[int, DataFrame],
    dictionary: DataFrame | Mapping[str, str] | None = None,
    year: str = fixed.YEAR,
) -> DataFrame:
    """Editions one under the other, every column in the one type that holds all.

    Types come from the dictionary where it has the column, otherwise from the
    schemas, promoted where they differ.  A union without this typing would read an alphanumeric code as
    the integer of another year and fail at run time.  Decimals beside integers or other decimals
    stay exact; beside a double they become double, which holds 15 to 17 digits.  The result is one
    flat union: columns in first-seen order, null where an edition lacks one.
    """
    if not editions:
        raise ValueError("give at least one edition")
    frames = [df for _, df in sorted(editions.items())]
    plan = dict(dictionary) if isinstance(dictionary, Mapping) else {}
    if isinstance(dictionary, DataFrame):
        from panelry.operators.dictionary import series_schema

        plan = series_schema(dictionary)
    order = list(dict.fromkeys(c for df in frames for c in df.columns))
    kept: dict[str, T.DataType] = {}
    for column in order:
        if column in plan:
            continue
        found = [df.schema[column].dataType for df in frames if column in df.columns]
        wide = _one_family(found)
        if wide is not None:
            kept[column] = wide
        else:
            plan[column] = types.promote_names(map(types.lattice_type, found))
    if year in order:
        # The year key has one type in every panel.
        plan[year] = "Int32"
    return reduce(DataFrame.unionAll, [_typed(df, order, plan, kept) for df in frames])


def _one_family(found: Sequence[T.DataType]) -> T.DataType | None:
    """The type that holds all values where the types are alike: one type, exact
    numbers with a decimal among them, or dates and timestamps."""
    if len(set(found)) == 1:
        return found[0]
    digits = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}
    if any(isinstance(t, T.DecimalType) for t in found):
        exact = [
            (t.precision - t.scale, t.scale) if isinstance(t, T.DecimalType) else (digits.get(type(t)), 0)
            for t in found
        ]
        if any(whole is None for whole, _ in exact):
            return None
        whole, scale = (max(part) for part in zip(*exact, strict=True))
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.StringType()
    if all(isinstance(t, (T.DateType, T.TimestampType)) for t in found):
        return T.TimestampType()
    return None


def _typed(
    df: DataFrame,
    order: Sequence[str],
    plan: Mapping[str, str],
    kept: Mapping[str, T.DataType],
) -> DataFrame:
    targets = {c: t if t != fixed.EMPTY else "string" for c, t in plan.items()}
    cast = types.cast_columns(df, targets)

    def column(c: str) -> str:
        if c in df.columns and c in kept and df.schema[c].dataType != kept[c]:
            return f"CAST({quote(c)} AS {kept[c].simpleString()}) AS {quote(c)}"
        if c in df.columns:
            return quote(c)
        absent = kept[c].simpleString() if c in kept else fixed.SPARK_TYPE[targets[c]]
        return f"CAST(NULL AS {absent}) AS {quote(c)}"

    return cast.selectExpr(*map(column, order))


def load_panel(
    editions: Mapping[int, DataFrame],
    columns: Sequence[str] | None = None,
    dictionary: DataFrame | Mapping[str, str] | None = None,
    **options,
) -> DataFrame:
    """:func:`load_edition` on every edition, stacked."""
    loaded = {year: load_edition(df, columns, **options) for year, df in editions.items()}
    return stack_editions(loaded, dictionary)


def enrich_edition(
    base: DataFrame, tables: Sequence[DataFrame], key: str | Sequence[str] = fixed.UNIT
) -> DataFrame:
    """Add the columns ``base`` lacks from tables with one row per key.

    Left joins: a unit without a row keeps null, never zero.  A repeated key
    stops the job instead of multiplying rows.  The check shuffles the keys
    alone and stays out of the join, whose two sides remain plain shuffles: so
    AQE can split a key that holds many rows of ``base``.
    """
    keys = as_list(key)
    require(base, keys)
    out = base
    for table in tables:
        require(table, keys)
        added = [c for c in table.columns if c not in out.columns]
        if not added:
            continue
        rows = table.select(*map(quote, [*keys, *added]))
        for k in keys:
            rows = rows.filter(name(k).isNotNull())
        repeated = (
            rows.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("__n"))
            .agg(F.count_if(F.col("__n") > 1))
            .scalar()
        )
        refused = F.raise_error(F.lit(f"repeated key in an entity table: {', '.join(keys)}"))
        rows = rows.filter(F.when(repeated == 0, True).otherwise(refused.cast("boolean")))
        out = out.join(rows, keys, "left")
    return out.select(*map(quote, dict.fromkeys([*base.columns, *out.columns])))


def upsert_by_key(
    existing: DataFrame,
    updates: DataFrame,
    keys: str | Sequence[str],
    newest: str | None = None,
) -> DataFrame:
    """Rows of ``existing`` whose key is not updated, plus the updates.

    Of updates that share a key one counts: the last by ``newest``, and among
    its ties, or without it, the largest row in the order of the columns.
    Null keys are equal to each other.
    """
    keys = as_list(keys)
    row = F.struct(*map(quote, updates.columns))
    order = row if newest is None else F.struct(name(newest), row)
    updates = updates.groupBy(*keys).agg(F.max_by(row, order).alias("__row")).select("__row.*")
    touched = updates.select(*[name(k).alias(f"__{k}") for k in keys]).distinct()
    same = reduce(
        Column.__and__, [existing[k].eqNullSafe(touched[f"__{k}"]) for k in keys]
    )
    kept = existing.join(touched, same, "left_anti")
    return kept.unionByName(updates, allowMissingColumns=True)
