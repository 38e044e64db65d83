"""Data dictionary: presence, profile, promoted type and description per column."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelry import fixed
from panelry.functions import types
from panelry.functions.text import strip
from panelry.operators.catalog import edition_catalog, summarize_presence
from panelry.operators.profile import profile_editions

DESCRIPTION_FIELDS = ("descricao", "tipo_inep", "tamanho_inep", "categorias")

DICTIONARY_COLUMNS = (
    "coluna", "descricao", "natureza", "categorias", "dtype_serie", "tipo_estavel",
    "tipos_por_ano", "dtype_prefixo", "conflito_prefixo", "tipo_inep", "tamanho_inep", "comum",
    "n_anos", "continua", "primeiro_ano", "ultimo_ano", "anos_presentes", "anos_ausentes",
    "pct_nulo_max", "n_distintos", "contagem_exata", "minimo", "maximo", "largura_max",
    "zeros_a_esquerda", "exemplos",
)


# -- description sheets -----------------------------------------------------


def pick_dictionary_files(listing: DataFrame) -> DataFrame:
    """Largest description workbook per year in a listing ``(ano, path, length)``."""
    file = F.element_at(F.split("path", "/"), -1)
    newest = Window.partitionBy("ano").orderBy(F.desc("length"), "path")
    return (
        listing.filter(
            F.lower(file).contains("dicion")
            & F.lower(file).endswith(".xlsx")
            & ~file.startswith("~$")
        )
        .withColumn("__n", F.row_number().over(newest))
        .filter(F.col("__n") == 1)
        .drop("__n")
    )


def pick_sheets(sheets: DataFrame) -> DataFrame:
    """The sheet of the entity table per year, from ``(ano, posicao, sheet)``."""
    text = F.lower("sheet")
    rank = F.lit(len(fixed.SHEET_PREFERENCE))
    for position, word in reversed(list(enumerate(fixed.SHEET_PREFERENCE))):
        rank = F.when(text.contains(word), position).otherwise(rank)
    excluded = text.contains(fixed.SHEET_EXCLUDED)
    rank = F.when(excluded, len(fixed.SHEET_PREFERENCE)).otherwise(rank)
    return sheets.groupBy("ano").agg(
        F.min_by("sheet", F.struct(rank, F.col("posicao"))).alias("sheet")
    )


def normalize_dictionary(grid: DataFrame) -> DataFrame:
    """Clean rows of the description sheets ``(ano, sheet, row_idx, cells)``.

    The header is the first row with a cell that starts like the name label;
    each field is read at the last cell that starts like its label.  Sheets
    without a header give no row: see :func:`sheets_without_header`.
    """
    cells = grid.select(
        "ano",
        "sheet",
        "row_idx",
        F.transform("cells", lambda c: F.coalesce(strip(c), F.lit(""))).alias("cells"),
    )

    def last_cell(start: str) -> Column:
        return F.array_max(
            F.transform("cells", lambda c, i: F.when(F.lower(c).startswith(start), i))
        )

    positions = [
        last_cell(start).alias(f"__{field}") for field, start in fixed.SHEET_LABELS.items()
    ]
    headers = (
        cells.select("ano", "sheet", "row_idx", *positions)
        .filter(F.col("__coluna").isNotNull())
        .groupBy("ano", "sheet")
        .agg(F.min_by(F.struct("*"), "row_idx").alias("h"))
        .select("ano", "sheet", F.col("h.row_idx").alias("__header"), *[
            F.col(f"h.__{field}").alias(f"__{field}") for field in fixed.SHEET_LABELS
        ])
    )
    rows = cells.join(headers, ["ano", "sheet"]).filter(F.col("row_idx") > F.col("__header"))

    def cell(field: str) -> Column:
        raw = F.coalesce(F.get("cells", F.col(f"__{field}")), F.lit(""))
        lines = F.transform(F.split(raw, "\n"), strip)
        return F.array_join(F.filter(lines, lambda line: line != ""), " | ")

    named = rows.withColumn("coluna", F.get("cells", F.col("__coluna"))).filter(
        F.col("coluna").rlike("^[A-Z][A-Z0-9_]*$")
    )
    # The first row of a repeated name counts; as an aggregate it combines map
    # side, so no sheet is sorted whole.
    fields = F.struct(*[cell(field).alias(field) for field in DESCRIPTION_FIELDS])
    return (
        named.groupBy("ano", "sheet", "coluna")
        .agg(F.min("row_idx").alias("row_idx"), F.min_by(fields, "row_idx").alias("f"))
        .select("ano", "sheet", "row_idx", "coluna", *[f"f.{x}" for x in DESCRIPTION_FIELDS])
    )


def sheets_without_header(grid: DataFrame) -> DataFrame:
    """Sheets in which no row names the variables."""
    start = fixed.SHEET_LABELS["coluna"]
    header = F.exists("cells", lambda c: F.lower(strip(c)).startswith(start))
    return (
        grid.groupBy("ano", "sheet")
        .agg(F.coalesce(F.bool_or(header), F.lit(False)).alias("__header"))
        .filter(~F.col("__header"))
        .drop("__header")
    )


def latest_descriptions(descriptions: DataFrame) -> DataFrame:
    """One description per column: the newest year's, its first row on ties."""
    fields = F.struct(*[F.col(x) for x in DESCRIPTION_FIELDS])
    newest = F.struct(F.col("ano"), -F.col("row_idx"))
    return (
        descriptions.groupBy("coluna")
        .agg(F.max_by(fields, newest).alias("f"))
        .select("coluna", *[f"f.{x}" for x in DESCRIPTION_FIELDS])
    )


def describe_variable(descriptions: DataFrame, variable: str) -> str:
    """Official description of one variable, ``""`` when there is none."""
    rows = (
        latest_descriptions(descriptions.filter(F.col("coluna") == variable))
        .select("descricao")
        .take(1)
    )
    return (rows[0].descricao or "") if rows else ""


# -- the dictionary ---------------------------------------------------------


def summarize_profiles(profiles: DataFrame) -> DataFrame:
    """Profiles of several editions rolled up to one row per column."""
    observed = F.when(F.col("dtype_dados") != fixed.EMPTY, F.col("dtype_dados"))
    by_year = F.array_sort(F.collect_list(F.struct("ano", "dtype_dados")))
    texts = F.transform(
        by_year, lambda x: F.concat_ws(":", x["ano"].cast("string"), x["dtype_dados"])
    )
    out = profiles.groupBy("coluna").agg(
        F.min_by("natureza", "ano").alias("natureza"),
        F.min_by("dtype_prefixo", "ano").alias("dtype_prefixo"),
        F.bool_or("conflito").alias("conflito_prefixo"),
        F.max("pct_nulo").alias("pct_nulo_max"),
        F.max("n_distintos").alias("n_distintos"),
        F.bool_and("contagem_exata").alias("contagem_exata"),
        F.min("minimo").alias("minimo"),
        F.max("maximo").alias("maximo"),
        F.max("largura_max").alias("largura_max"),
        F.bool_or("zeros_a_esquerda").alias("zeros_a_esquerda"),
        F.max_by("exemplos", "ano").alias("exemplos"),
        types.promote(F.col("dtype_dados")).alias("dtype_serie"),
        F.coalesce(F.min(observed) == F.max(observed), F.lit(True)).alias("tipo_estavel"),
        F.array_join(texts, ", ").alias("tipos_por_ano"),
        F.min("ano").alias("__first"),
    )
    return out.withColumn(
        "tipos_por_ano", F.when(F.col("tipo_estavel"), "").otherwise(F.col("tipos_por_ano"))
    )


def data_dictionary(
    editions: Mapping[int, DataFrame],
    common_only: bool = True,
    descriptions: DataFrame | None = None,
) -> DataFrame:
    """One row per column: what it is and whether it serves a series.

    Everything after the profile has one row per column name.
    """
    years = sorted(editions)
    common = set.intersection(*[set(editions[y].columns) for y in years])
    if common_only and not common:
        raise ValueError(f"no column is common to all of the years {years}")
    catalog = edition_catalog(editions)
    target = sorted(common) if common_only else None
    profiles = profile_editions(editions, target)
    positions = catalog.select("coluna", F.col("ano").alias("__first"), F.col("posicao"))
    out = (
        summarize_profiles(profiles)
        .join(positions, ["coluna", "__first"], "left")
        .join(summarize_presence(catalog, years), "coluna", "left")
    )
    if descriptions is not None:
        out = out.join(latest_descriptions(descriptions), "coluna", "left").fillna(
            "", list(DESCRIPTION_FIELDS)
        )
    order = (
        [F.asc("__position")] if common_only else [F.asc("__first"), F.asc("posicao")]
    )
    shown = [c for c in DICTIONARY_COLUMNS if c in out.columns]
    return out.orderBy(*order, "coluna").select(*shown)


def series_schema(dictionary: DataFrame) -> dict[str, str]:
    """Cast plan ``column -> type``; one entry per column name, columns without values left out."""
    rows = dictionary.select("coluna", "dtype_serie").collect()
    return {row.coluna: row.dtype_serie for row in rows if row.dtype_serie != fixed.EMPTY}


def cast_to_series(df: DataFrame, dictionary: DataFrame | Mapping[str, str]) -> DataFrame:
    """Apply the cast plan to one edition."""
    plan = series_schema(dictionary) if isinstance(dictionary, DataFrame) else dictionary
    return types.cast_columns(df, plan)


def audit_unstable(dictionary: DataFrame) -> DataFrame:
    """Columns whose editions disagree on the type."""
    return dictionary.filter(~F.col("tipo_estavel"))


def audit_with_domain(dictionary: DataFrame) -> DataFrame:
    """Columns whose description lists their categories."""
    return dictionary.filter(F.col("categorias") != "")


def most_empty(dictionary: DataFrame, n: int = 10) -> DataFrame:
    """The columns with the largest share of nulls in any edition."""
    return dictionary.orderBy(F.desc("pct_nulo_max"), "coluna").limit(n)
