"""Edition files: discovery, text scan, typing, columnar copies."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelry import fixed
from panelry.errors import MissingColumns
from panelry.frames import quote
from panelry.functions import types
from panelry.operators.profile import observed_types


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, length)`` of every file below a folder; contents are not read."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select("path", "length")
    )


def discover_editions(listing: DataFrame) -> DataFrame:
    """The entity table of each year in a listing: its largest matching file.

    The year is the one that ends a folder name, else the one in the file name.
    """
    file = F.element_at(F.split("path", "/"), -1)
    pattern = "(?i)^(" + "|".join(fixed.EDITION_FILE_PATTERNS) + ")$"
    folder_years = F.regexp_extract_all("path", F.lit(r"(\d{4})/"), F.lit(1))
    folder_year = F.when(F.size(folder_years) > 0, F.element_at(folder_years, -1))
    file_year = F.nullif(F.regexp_extract(file, r"_(\d{4})", 1), F.lit(""))
    largest = Window.partitionBy("ano").orderBy(F.desc("length"), "path")
    return (
        listing.filter(file.rlike(pattern))
        .withColumn("ano", F.coalesce(folder_year, file_year).cast("int"))
        .filter(F.col("ano").isNotNull())
        .withColumn("__n", F.row_number().over(largest))
        .filter(F.col("__n") == 1)
        .select("ano", "path", "length")
    )


def read_edition_text(
    spark: SparkSession,
    path: str,
    columns: Sequence[str] | None = None,
    sep: str = fixed.SEPARATOR,
    encoding: str = fixed.ENCODING,
    multiline: bool = False,
) -> DataFrame:
    """One edition as text: requested columns that exist, no-value tokens null.

    Editions are read one by one and selected by name: a schema or several
    paths in one call would bind columns by position.  ``multiline`` allows
    line breaks inside quotes and makes a file unsplittable.
    """
    df = spark.read.csv(
        path, sep=sep, header=True, encoding=encoding, escape='"', multiLine=multiline
    )
    kept = [c for c in (columns if columns is not None else df.columns) if c in df.columns]
    if not kept:
        raise MissingColumns(f"none of the requested columns exists in {path}")
    return df.selectExpr(*[f"{types.blank_to_null_text(quote(c))} AS {quote(c)}" for c in kept])


def apply_prefix_types(
    text: DataFrame,
    profile: DataFrame | None = None,
    keep_leading_zeros: bool = True,
) -> tuple[DataFrame, list[str]]:
    """Type an edition by its name prefixes, widened where the values ask for more.

    Returns the frame and the columns that stay text although their prefix
    declares numbers.  A profile replaces the scan that checks the values.
    """
    declared = {c: types.prefix_type_of(c) for c in text.columns}
    if profile is not None:
        rows = profile.select("coluna", "dtype_dados").collect()
        observed = {row.coluna: row.dtype_dados for row in rows}
        plan = {
            c: observed[c] if observed.get(c, fixed.EMPTY) != fixed.EMPTY else declared[c]
            for c in text.columns
        }
    else:
        numeric = [c for c, kind in declared.items() if kind not in ("", "string")]
        observed = observed_types(text, numeric, keep_leading_zeros)
        plan = {
            c: types.promote_names([declared[c], observed[c]]) if c in observed else declared[c]
            for c in text.columns
        }
    if fixed.YEAR in plan:
        plan[fixed.YEAR] = "Int32"
    textual = sorted(
        c for c in text.columns if declared[c] not in ("", "string") and plan[c] == "string"
    )
    if textual:
        warnings.warn(f"columns kept as text, not all numbers: {', '.join(textual)}", stacklevel=2)
    return types.cast_columns(text, {c: kind or "string" for c, kind in plan.items()}), textual


def edition_path(root: str, year: int) -> str:
    return f"{root.rstrip('/')}/{fixed.YEAR}={int(year)}"


def edition_exists(spark: SparkSession, root: str, year: int) -> bool:
    """Whether a columnar copy is there; what an aborted write leaves is no table."""
    try:
        spark.read.parquet(edition_path(root, year))
    except AnalysisException:
        return False
    return True


def write_editions(panel: DataFrame, root: str) -> None:
    """Columnar copy of a panel by year; years it holds replace those there, others stay.

    Every year is written in files of its own, so a later read of some years opens no others.
    """
    (
        panel.withColumn(fixed.YEAR, F.col(fixed.YEAR).cast("int"))
        .write.partitionBy(fixed.YEAR)
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(root.rstrip("/"))
    )


def read_editions(
    spark: SparkSession,
    root: str,
    years: Sequence[int] | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Years of the copy; only their folders and only the requested columns are read.

    A year the copy does not hold is an error.
    """
    copy = spark.read.option("mergeSchema", True).parquet(root.rstrip("/"))
    if years is not None:
        wanted = sorted({int(y) for y in years})
        # a partition column alone: its values come from the folders, no file is opened
        held = {r[0] for r in copy.select(fixed.YEAR).distinct().collect()}
        if set(wanted) - held:
            raise FileNotFoundError(f"no columnar copy of {sorted(set(wanted) - held)}")
        copy = copy.filter(F.col(fixed.YEAR).isin(*wanted))
    if columns is not None:
        kept = [c for c in columns if c in copy.columns]
        if not kept:
            raise MissingColumns("none of the requested columns exists in the copy")
        copy = copy.select(*map(quote, kept))
    return copy


def write_edition(df: DataFrame, root: str, year: int, overwrite: bool = False) -> str:
    """Columnar copy of one edition, a partition folder of ``root``.

    A complete copy is kept unless ``overwrite``.
    """
    target = edition_path(root, year)
    if overwrite or not edition_exists(df.sparkSession, root, year):
        df.drop(fixed.YEAR).write.mode("overwrite").parquet(target)
    return target


def read_edition(spark: SparkSession, root: str, year: int) -> DataFrame:
    """The columnar copy of one edition, with its own schema."""
    return spark.read.parquet(edition_path(root, year)).withColumn(
        fixed.YEAR, F.lit(int(year)).cast("int")
    )


def open_edition(
    spark: SparkSession,
    root: str,
    year: int,
    csv_path: str | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The columnar copy, or the text file where only that has a requested column."""
    copy = read_edition(spark, root, year) if edition_exists(spark, root, year) else None
    if copy is not None:
        missing = [c for c in columns or [] if c not in copy.columns]
        if not missing or csv_path is None:
            return copy
        header = read_edition_text(spark, csv_path).columns
        if not set(missing) & set(header):
            return copy
    if csv_path is None:
        raise FileNotFoundError(f"no columnar copy of {year} and no text file given")
    text = read_edition_text(spark, csv_path)
    if columns is not None:
        kept = [c for c in columns if c in text.columns]
        if not kept:
            raise MissingColumns(f"none of the requested columns exists in {year}")
        text = text.select(*map(quote, kept))
    return apply_prefix_types(text)[0]


def open_editions(spark: SparkSession, found: DataFrame) -> Mapping[int, DataFrame]:
    """Text scans of discovered editions; one row per year reaches the driver."""
    return {row.ano: read_edition_text(spark, row.path) for row in found.orderBy("ano").collect()}
