"""Group-by reports.  Measures are combined map side; only groups are shuffled."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelry import fixed
from panelry.errors import MissingColumns
from panelry.frames import as_list, name, require, with_keys
from panelry.functions.codes import add_region, label, label_column


def count_by(df: DataFrame, by: str | Sequence[str], share: bool = False) -> DataFrame:
    """Rows per group, optionally with each group's share of all grouped rows."""
    keys = as_list(by)
    counts = with_keys(df, keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("escolas"))
    if share:
        # A scalar subquery over the same counts, which reuses their shuffle; a
        # window over () would move every group to one task.
        total = counts.agg(F.sum("escolas")).scalar()
        counts = counts.withColumn("pct", F.col("escolas") / total)
    return counts.orderBy(F.desc("escolas"), *keys)


def sum_by(
    df: DataFrame,
    by: str | Sequence[str],
    columns: Sequence[str] | None = None,
    prefix: str = "QT_MAT_",
) -> DataFrame:
    """Sums per group; a group without any value stays null."""
    keys = as_list(by)
    summed = list(columns) if columns is not None else [c for c in df.columns if c.startswith(prefix)]
    if not summed:
        raise MissingColumns(f"no {prefix}* column in the frame")
    require(df, summed)
    return (
        with_keys(df, keys)
        .groupBy(*keys)
        .agg(*[F.sum(name(c)).alias(c) for c in summed])
        .orderBy(*keys)
    )


def _indicators(df: DataFrame, indicators: Sequence[str] | None) -> list[str]:
    chosen = (
        list(indicators)
        if indicators is not None
        else [c for c in df.columns if c.startswith("IN_")]
    )
    if not chosen:
        raise MissingColumns("no IN_* column in the frame")
    require(df, chosen)
    return chosen


def _mean(column: str) -> Column:
    return F.avg(name(column).cast("double")).alias(column)


def rate(df: DataFrame, indicators: Sequence[str] | None = None) -> DataFrame:
    """Mean of each 0/1 indicator where it applies, one row per indicator."""
    chosen = _indicators(df, indicators)
    return (
        df.agg(*map(_mean, chosen))
        .unpivot([], [name(c) for c in chosen], "indicador", "taxa")
        .orderBy(F.desc_nulls_last("taxa"), "indicador")
    )


def rate_by(
    df: DataFrame, by: str | Sequence[str], indicators: Sequence[str] | None = None
) -> DataFrame:
    """Mean of each 0/1 indicator per group, one column per indicator."""
    keys = as_list(by)
    chosen = _indicators(df, indicators)
    return with_keys(df, keys).groupBy(*keys).agg(*map(_mean, chosen)).orderBy(*keys)


def overview_by_uf(
    df: DataFrame,
    uf: str = fixed.UF,
    enrolments: str = fixed.ENROLMENTS,
    teachers: str = fixed.TEACHERS,
    regions: DataFrame | None = None,
) -> DataFrame:
    """One row per state: units, enrolments, teachers, region, enrolments per unit.

    ``regions`` is a dimension ``(uf, NO_REGIAO)`` replacing the fixed state
    map; it is joined after the aggregation, to one row per state.
    """
    require(df, [uf])
    measures = [F.count(F.lit(1)).alias("escolas")]
    for column, alias in ((enrolments, "matriculas"), (teachers, "docentes")):
        if column in df.columns:
            # This report shows 0, not null, where nothing was counted.
            measures.append(F.coalesce(F.sum(name(column)), F.lit(0)).alias(alias))
    out = with_keys(df, [uf]).groupBy(uf).agg(*measures)
    out = add_region(out, uf, regions).withColumnRenamed("NO_REGIAO", "regiao")
    if "matriculas" in out.columns:
        out = out.withColumn("matriculas_por_escola", F.col("matriculas") / F.col("escolas"))
    return out.orderBy(F.desc("escolas"), uf)


def distribution(
    df: DataFrame,
    code: str = "TP_DEPENDENCIA",
    by: str | None = None,
    labels: Mapping[str, Mapping] = fixed.CODE_LABELS,
    observed: Sequence[str] | None = None,
) -> DataFrame:
    """Share of each label, overall or within each group.

    The columns of the grouped form are the labels that occur.  Finding them
    takes a scan of its own; pass ``observed`` to name them instead.
    """
    labelled = label(df, code, labels)
    column = label_column(code)
    if by is None:
        return count_by(labelled, column, share=True)
    require(df, [by])
    known = with_keys(labelled, [by, column])
    if observed is None:
        observed = [row[0] for row in known.select(column).distinct().collect()]
    observed = sorted(observed)
    rows = F.count(F.lit(1))
    return (
        known.groupBy(by)
        .agg(*[(F.count_if(F.col(column) == text) / rows).alias(text) for text in observed])
        .orderBy(by)
    )


def time_series(
    df: DataFrame, metric: str = fixed.ENROLMENTS, by: str | None = None, year: str = fixed.YEAR
) -> DataFrame:
    """Yearly sum of a metric, optionally split; a year without values stays null."""
    require(df, [year, metric])
    keys = [year] + ([by] if by else [])
    return (
        with_keys(df, keys).groupBy(*keys).agg(F.sum(name(metric)).alias(metric)).orderBy(*keys)
    )


def top_areas(
    df: DataFrame,
    n: int = 20,
    metric: str = fixed.ENROLMENTS,
    keys: Sequence[str] = fixed.MUNICIPALITY_KEYS,
) -> DataFrame:
    """The ``n`` areas with the largest summed metric."""
    present = [key for key in keys if key in df.columns]
    if not present:
        raise MissingColumns(f"none of the area columns is in the frame: {', '.join(keys)}")
    return (
        with_keys(df, present)
        .groupBy(*present)
        .agg(
            F.count(F.lit(1)).alias("escolas"),
            F.coalesce(F.sum(name(metric)), F.lit(0)).alias("total"),
        )
        .orderBy(F.desc("total"), *present)
        .limit(n)
    )
