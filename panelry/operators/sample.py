"""Filtered samples of a text edition, to look at without opening all of it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from panelry.errors import MissingColumns, NoRows
from panelry.frames import explode_cells, name, quote, require
from panelry.functions import types
from panelry.functions.text import fold, fold_literal, strip


def where_equals(df: DataFrame, values: Mapping[str, str]) -> DataFrame:
    """Rows whose columns equal the texts, edge blanks and case aside."""
    require(df, values)
    for column, value in values.items():
        df = df.filter(fold(strip(name(column).cast("string"))) == fold_literal(value))
    return df


def where_contains(df: DataFrame, texts: Mapping[str, str]) -> DataFrame:
    """Rows whose columns contain the literal texts, case aside; null never does."""
    require(df, texts)
    for column, text in texts.items():
        df = df.filter(fold(name(column).cast("string")).contains(fold_literal(text)))
    return df


def project(
    df: DataFrame, columns: Sequence[str] | None, filtered: Sequence[str] = ()
) -> list[str]:
    """Requested and filtered columns in file order; an unknown filter column is an error."""
    unknown = [c for c in filtered if c not in df.columns]
    if unknown:
        raise MissingColumns(f"filter columns not in the source: {', '.join(unknown)}")
    if not columns:
        return list(df.columns)
    wanted = {c.strip().upper() for c in columns} | {c.strip() for c in columns} | set(filtered)
    kept = [c for c in df.columns if c in wanted]
    if not kept:
        raise MissingColumns("none of the requested columns exists in the source")
    return kept


def file_position() -> Column:
    """File order of rows read from files: file, block, row."""
    return F.struct(
        F.col("_metadata.file_path"),
        F.col("_metadata.file_block_start"),
        F.monotonically_increasing_id(),
    )


def sample_head(
    df: DataFrame,
    n: int = 100,
    columns: Sequence[str] | None = None,
    equals: Mapping[str, str] | None = None,
    contains: Mapping[str, str] | None = None,
    order_by: str | Column | Sequence[str | Column] | None = None,
    check: bool = True,
) -> DataFrame:
    """First ``n`` matching rows.

    Without ``order_by`` the scan stops at the first partitions that give
    enough rows, in file order for one file.  With it, each task keeps its own
    ``n`` first rows.  ``check`` looks for a first match, unordered, and counts
    the scanned rows for the error when there is none.
    """
    equals, contains = dict(equals or {}), dict(contains or {})
    kept = project(df, columns, [*equals, *contains])
    matching = where_contains(where_equals(df, equals), contains)
    if check and matching.isEmpty():
        raise NoRows(f"no row matches the filters ({df.count()} rows scanned)")
    if order_by is not None:
        order = [order_by] if isinstance(order_by, (str, Column)) else list(order_by)
        matching = matching.orderBy(*order)
    return matching.limit(n).select(*map(quote, kept))


@dataclass(frozen=True)
class Sample:
    """The first matching rows in file order, where they came from and what it took to find them."""

    rows: DataFrame
    files: list[str]
    scanned: int


def sample_scan(
    df: DataFrame,
    n: int = 100,
    columns: Sequence[str] | None = None,
    equals: Mapping[str, str] | None = None,
    contains: Mapping[str, str] | None = None,
) -> Sample:
    """First ``n`` matching rows of files, in file order, with the number of rows scanned for them.

    Files are taken by name, a first one alone and then twice as many at a time, until there are
    enough rows: a common sample ends within the first file, where the scan stops at the task
    that completes it.  The rows scanned are counted in the same scan.  What reaches the driver
    is the sample alone.
    """
    equals, contains = dict(equals or {}), dict(contains or {})
    kept = project(df, columns, [*equals, *contains])
    files = sorted(df.inputFiles())
    if not files:
        raise ValueError("the frame is not read from files")
    spark, rows, used, scanned, taken = df.sparkSession, [], [], 0, 1
    while files and len(rows) < n:
        part, files = files[:taken], files[taken:]
        counted = Observation()
        # a path without a host is written with one slash or with three
        paths = [x for path in part for x in {path, path.replace(":///", ":/", 1)}]
        scan = df.filter(F.col("_metadata.file_path").isin(*paths)).withColumn("__at", file_position())
        scan = scan.observe(counted, F.count(F.lit(1)).alias("rows"))
        matching = where_contains(where_equals(scan, equals), contains)
        if taken > 1 or len(part) > 1:
            matching = matching.orderBy("__at")
        found = matching.limit(n - len(rows)).select(*map(quote, kept)).collect()
        rows += found
        used += part
        scanned += counted.get.get("rows", 0)
        taken *= 2
    if not rows:
        raise NoRows(f"no row matches the filters ({scanned} rows scanned)")
    schema = df.select(*map(quote, kept)).schema
    return Sample(spark.createDataFrame(rows, schema), used, scanned)


def numbers_where_lossless(df: DataFrame) -> DataFrame:
    """Turn text columns into numbers where no value loses anything.

    Columns with leading zeros stay text (identifiers), a decimal comma counts
    as a point, and one value that is no number keeps the column as it is.
    """
    text_columns = [c for c, kind in df.dtypes if kind == "string"]
    if not text_columns:
        return df
    value = F.col("valor")
    plain, number = F.col("ponto"), F.col("numero")
    tests = (
        explode_cells(df, text_columns)
        .filter(value.isNotNull())
        .withColumn("ponto", F.replace(value, F.lit(","), F.lit(".")))
        .withColumn("numero", types.number(plain))
        .groupBy("posicao")
        .agg(
            (
                F.bool_or(F.length(value) > 1) & F.bool_or(value.rlike("^0[^.,]"))
            ).alias("zeros"),
            F.bool_and(number.isNotNull()).alias("numerico"),
            F.bool_and(plain.try_cast("bigint").isNotNull()).alias("inteiro"),
            # Whole numbers past 2^53 would be rounded by a double.
            F.bool_and((F.abs(number) < 2.0**53) | (number % 1 != 0)).alias("exato"),
        )
        .collect()
    )
    target = {}
    for row in tests:
        if row.numerico and not row.zeros:
            if row.inteiro:
                target[text_columns[row.posicao]] = "bigint"
            elif row.exato:
                target[text_columns[row.posicao]] = "double"

    def converted(column: str) -> str:
        if column not in target:
            return quote(column)
        plain = f"trim(replace({quote(column)}, ',', '.'))"
        return f"try_cast({plain} AS {target[column]}) AS {quote(column)}"

    return df.selectExpr(*map(converted, df.columns))
