"""What every column holds, told by its values and not by its name.

One scan: every task folds its cells to a bounded number of rows per column (see ``cells``), one
shuffle merges them.  The distinct count is capped, so the smallest distinct values of each task,
one more than the cap, are all that the count and the examples can depend on: the result is exact.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelry import fixed
from panelry.errors import MissingColumns
from panelry.frames import local_frame, quote
from panelry.functions import types
from panelry.operators.cells import column_partials

PROFILE_COLUMNS = (
    "ano", "coluna", "natureza", "dtype_dados", "dtype_prefixo", "conflito", "n_linhas",
    "pct_nulo", "n_distintos", "contagem_exata", "minimo", "maximo", "largura_max",
    "zeros_a_esquerda", "exemplos",
)

def profile(df: DataFrame, columns: Sequence[str] | None = None, ano: int = 0) -> DataFrame:
    """Profile of one edition, one row per column."""
    return profile_editions({ano: df}, columns)


def profile_editions(
    editions: Mapping[int, DataFrame], columns: Sequence[str] | None = None
) -> DataFrame:
    """Profile of several editions: the cells of all of them in one aggregation."""
    scanned = {}
    for year, df in sorted(editions.items()):
        wanted = [c for c in (columns if columns is not None else df.columns) if c in df.columns]
        if not wanted:
            raise MissingColumns(f"none of the requested columns exists in {year}")
        scanned[int(year)] = df.select(*map(quote, wanted))
    partials = reduce(
        DataFrame.unionByName, [column_partials(df, year) for year, df in scanned.items()]
    )
    return _describe(_catalog(scanned), _merged(partials)).select(*PROFILE_COLUMNS)


def _catalog(editions: Mapping[int, DataFrame]) -> DataFrame:
    return local_frame(
        next(iter(editions.values())).sparkSession,
        {"ano": "int", "coluna": "string", "posicao": "int"},
        [(y, c, i) for y, df in editions.items() for i, c in enumerate(df.columns)],
    )


def _merged(partials: DataFrame) -> DataFrame:
    """One row of measures per column, one per key kept and one per example; numbers only, so it hashes."""
    return partials.groupBy("ano", "posicao", "chave", "texto").agg(*_measures())


def _measures() -> list[Column]:
    return [
        F.sum("n").alias("n"),
        F.sum("preenchidos").alias("preenchidos"),
        F.max("largura").alias("largura"),
        F.bool_and("numerico").alias("numerico"),
        F.bool_and("inteiro").alias("inteiro"),
        F.bool_and("cabe").alias("cabe"),
        F.bool_or("zeros").alias("zeros"),
        F.min("minimo").alias("minimo"),
        F.max("maximo").alias("maximo"),
    ]


def _stats(merged: DataFrame) -> DataFrame:
    return merged.groupBy("ano", "posicao").agg(
        *_measures(), F.count("chave").alias("distintos")
    ).withColumnRenamed("n", "n_linhas")


def _describe(catalog: DataFrame, merged: DataFrame) -> DataFrame:
    by_column = ["ano", "posicao"]
    # The rank filter turns into a limit per partition before the shuffle.  The rows keep every
    # measure so that this branch reads the same shuffle as the counts.
    first = Window.partitionBy(*by_column).orderBy(F.asc_nulls_last("texto"))
    kept = merged.withColumn("ordem", F.row_number().over(first)).filter(F.col("ordem") <= fixed.EXAMPLES)
    rows = F.sort_array(F.collect_list(F.struct("texto", *[
        c for c in merged.columns if c not in ("ano", "posicao", "texto")
    ])))
    examples = kept.groupBy(*by_column).agg(rows.alias("menores")).select(
        *by_column, F.array_compact(F.col("menores.texto")).alias("menores")
    )
    return _report(catalog.join(_stats(merged), by_column, "left").join(examples, by_column, "left"))


def _report(columns: DataFrame) -> DataFrame:
    rows = F.coalesce("n_linhas", F.lit(0))
    filled = F.coalesce("preenchidos", F.lit(0))
    numeric = F.coalesce("numerico", F.lit(True))
    zeros = numeric & F.coalesce("zeros", F.lit(False))
    # The type the values would have if leading zeros meant nothing.
    plain = (
        F.when(filled == 0, fixed.EMPTY)
        .when(~numeric, "string")
        .when(~F.col("inteiro"), "Float64")
        .when(~F.col("cabe"), "string")
        .otherwise(types.integer_type(F.col("minimo"), F.col("maximo")))
    )
    out = columns.select(
        "ano",
        "coluna",
        "posicao",
        types.kind(F.col("coluna")).alias("natureza"),
        plain.alias("dtype_numerico"),
        F.when(zeros & (filled > 0), "string").otherwise(plain).alias("dtype_dados"),
        types.prefix_type(F.col("coluna")).alias("dtype_prefixo"),
        rows.alias("n_linhas"),
        F.when(rows == 0, 1.0).otherwise((rows - filled) / rows).alias("pct_nulo"),
        F.least(F.coalesce("distintos", F.lit(0)), F.lit(fixed.DISTINCT_CAP)).alias("n_distintos"),
        (F.coalesce("distintos", F.lit(0)) <= fixed.DISTINCT_CAP).alias("contagem_exata"),
        F.when(numeric, F.col("minimo")).alias("minimo"),
        F.when(numeric, F.col("maximo")).alias("maximo"),
        F.coalesce("largura", F.lit(0)).alias("largura_max"),
        zeros.alias("zeros_a_esquerda"),
        F.coalesce(F.array_join("menores", ", "), F.lit("")).alias("exemplos"),
    )
    # Only a prefix that would lose values conflicts; one wider than needed does not.
    conflict = (
        (F.col("dtype_prefixo") != "")
        & (F.col("dtype_dados") != fixed.EMPTY)
        & (types.width(F.col("dtype_dados")) > types.width(F.col("dtype_prefixo")))
    )
    return out.withColumn("conflito", conflict).orderBy("ano", "posicao")


def types_by_year(profiles: DataFrame, years: Sequence[int] | None = None) -> DataFrame:
    """Observed type of each column, one column per year."""
    if years is None:
        years = sorted(row.ano for row in profiles.select("ano").distinct().collect())
    return (
        profiles.groupBy("coluna")
        .agg(*[
            F.max(F.when(F.col("ano") == year, F.col("dtype_dados"))).alias(str(year))
            for year in years
        ])
        .orderBy("coluna")
    )


def promoted_types(profiles: DataFrame) -> DataFrame:
    """The one type per column that holds every edition."""
    return (
        profiles.groupBy("coluna")
        .agg(types.promote(F.col("dtype_dados")).alias("dtype_serie"))
        .orderBy("coluna")
    )


def observed_types(
    df: DataFrame, columns: Sequence[str], keep_leading_zeros: bool = True
) -> dict[str, str]:
    """Narrowest type of each column; the plan it returns is one entry per column.

    Leading zeros make an identifier of a code, not of a count or a flag.  A
    type needs no distinct values, so this is one small row per column and task.
    """
    wanted = [c for c in columns if c in df.columns]
    if not wanted:
        return {}
    measured = _stats(_merged(column_partials(df.select(*map(quote, wanted)), 0, keys=0, examples=0)))
    measured = measured.withColumn("menores", F.array().cast("array<string>"))
    described = _report(_catalog({0: df.select(*map(quote, wanted))}).join(
        measured, ["ano", "posicao"], "left"))
    rows = described.select("coluna", "dtype_dados", "dtype_numerico").collect()
    return {
        row.coluna: row.dtype_dados
        if keep_leading_zeros and row.coluna.startswith("CO_")
        else row.dtype_numerico
        for row in rows
    }


def audit_conflicts(profiles: DataFrame) -> DataFrame:
    """Columns whose name prefix would lose values."""
    return profiles.filter("conflito")


def audit_wide_prefixes(profiles: DataFrame) -> DataFrame:
    """Columns whose prefix type is not the one the values ask for."""
    return profiles.filter(
        (F.col("dtype_prefixo") != "") & (F.col("dtype_dados") != F.col("dtype_prefixo"))
    )
