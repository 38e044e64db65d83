"""Which columns each edition has.

A catalogue is a long table ``(ano, coluna, posicao)``; the operators below are
one aggregation by column each, with one conditional aggregate per compared
year, so they never collect a column's years into a list.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelry.frames import local_frame


def edition_catalog(editions: Mapping[int, DataFrame], contains: str | None = None) -> DataFrame:
    """Columns of each edition in file order, from the schemas alone."""
    if not editions:
        raise ValueError("give at least one edition")
    spark = next(iter(editions.values())).sparkSession
    rows = [
        (int(year), column, position)
        for year, df in sorted(editions.items())
        for position, column in enumerate(df.columns)
    ]
    catalog = local_frame(spark, {"ano": "int", "coluna": "string", "posicao": "int"}, rows)
    if contains:
        catalog = catalog.filter(F.upper("coluna").contains(contains.upper()))
    return catalog


def _years(catalog: DataFrame, years: Sequence[int] | None) -> list[int]:
    if years is None:
        years = [row.ano for row in catalog.select("ano").distinct().collect()]
    if not years:
        raise ValueError("give at least one year")
    return sorted(set(years))


def _flag(year: int) -> str:
    return f"__{year}"


def _by_column(catalog: DataFrame, years: Sequence[int]) -> DataFrame:
    """One row per column: a flag per year and the file order of its newest year.

    Only numbers are aggregated, which keeps the hash aggregation; the position
    in each year also tells whether the column is there.
    """
    position = F.coalesce("posicao", F.lit(0))
    grouped = (
        catalog.filter(F.col("ano").isin(*years))
        .groupBy("coluna")
        .agg(
            F.max("ano").alias("__newest"),
            *[
                F.max(F.when(F.col("ano") == year, position)).alias(f"__p{year}")
                for year in years
            ],
        )
    )
    return grouped.select(
        "coluna",
        "__newest",
        F.coalesce(*[f"__p{year}" for year in reversed(years)]).alias("__position"),
        *[F.col(f"__p{year}").isNotNull().alias(_flag(year)) for year in years],
    )


def file_order() -> list[Column]:
    """The newest edition's file order first, retired columns after it."""
    return [F.desc("__newest"), F.asc("__position"), F.asc("coluna")]


def presence_matrix(catalog: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """One row per column, one boolean per year."""
    years = _years(catalog, years)
    flags = [F.col(_flag(year)).alias(str(year)) for year in years]
    return _by_column(catalog, years).orderBy(*file_order()).select("coluna", *flags)


def columns_per_edition(catalog: DataFrame) -> DataFrame:
    """How many columns each edition has."""
    return (
        catalog.groupBy("ano").agg(F.count("coluna").alias("variaveis")).orderBy("ano")
    )


def common_columns(catalog: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """The columns every compared year has."""
    years = _years(catalog, years)
    everywhere = F.lit(True)
    for year in years:
        everywhere = everywhere & F.col(_flag(year))
    return _by_column(catalog, years).filter(everywhere).orderBy(*file_order()).select("coluna")


def summarize_presence(catalog: DataFrame, years: Sequence[int]) -> DataFrame:
    """:func:`presence_summary` unordered, with the file order columns kept."""
    years = sorted(set(years))
    table = _by_column(catalog, years)
    compared = F.array(*[F.lit(int(year)) for year in years])
    flags = F.array(*[F.when(F.col(_flag(year)), F.lit(int(year))) for year in years])
    present = F.array_compact(flags)
    out = table.select("coluna", "__newest", "__position", present.alias("__present")).withColumns(
        {
            "n_anos": F.size("__present"),
            "comum": F.size("__present") == len(years),
            "primeiro_ano": F.element_at("__present", 1),
            "ultimo_ano": F.element_at("__present", -1),
        }
    )
    # A hole is a compared year inside the span where the column is missing;
    # years that were not compared say nothing.
    span = F.filter(compared, lambda y: y.between(F.col("primeiro_ano"), F.col("ultimo_ano")))
    absent = F.array_except(compared, F.col("__present"))
    return out.withColumns(
        {
            "continua": F.col("n_anos") == F.size(span),
            "anos_presentes": F.array_join(F.col("__present").cast("array<string>"), ", "),
            "anos_ausentes": F.array_join(absent.cast("array<string>"), ", "),
        }
    ).drop("__present")


def presence_summary(catalog: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """In which of the compared years each column appears, and with holes or not."""
    years = _years(catalog, years)
    return (
        summarize_presence(catalog, years).orderBy(*file_order()).drop("__newest", "__position")
    )


def audit_gaps(summary: DataFrame) -> DataFrame:
    """Columns that vanish in a year in the middle."""
    return summary.filter(~F.col("continua"))


def audit_missing_only_in(summary: DataFrame, year: int) -> DataFrame:
    """Columns that only one given year lacks."""
    return summary.filter(F.col("anos_ausentes") == str(year))
