"""Area-by-year measures, their join to polygons, and their colour classes."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelry import fixed
from panelry.errors import InvalidQuery
from panelry.frames import name, require
from panelry.functions import types
from panelry.functions.codes import map_value

SUM, RATE, CATEGORY = "soma", "taxa", "categoria"

# The kinds of variable a map can show and how each is aggregated.
MODE_BY_KIND = {
    "contagem": SUM,
    "indicador (0/1)": RATE,
    "categórica codificada": CATEGORY,
}


@dataclass(frozen=True)
class Cut:
    """Spatial cut: the grouping column, an optional row filter, the name column."""

    column: str
    filter_column: str | None = None
    filter_value: int | None = None
    name_column: str | None = None
    level: str | None = None
    scope: str = "paises"
    code: str = "BR"
    mesh: str = ""

    @staticmethod
    def of(level: str, scope: str = "paises", code: int | str = "BR") -> Cut:
        """Cut of a named level within a scope."""
        if level not in fixed.LEVELS:
            raise InvalidQuery(
                f"unknown intrarregiao {level}; known: {', '.join(sorted(fixed.LEVELS))}"
            )
        column = fixed.LEVELS[level]
        filtered = fixed.SCOPE_FILTER.get(scope)
        return Cut(
            column,
            filtered,
            int(code) if filtered else None,
            fixed.AREA_NAME.get(column),
            level,
            scope,
            str(code),
        )


MAPPABLE = "use QT_* (sum), IN_* (share) or TP_* (share of one category)"


def category_missing(variable: str) -> str:
    known = fixed.CODE_LABELS.get(variable, {})
    options = ", ".join(f"{k}={v}" for k, v in known.items()) or "see the dictionary"
    return f"{variable} is a category: choose one code. Options: {options}"


# -- which variables and years -----------------------------------------------


def aggregation_for(variable: str) -> str:
    """How a variable is aggregated, told by its kind."""
    mode = MODE_BY_KIND.get(types.kind_of(variable))
    if mode is None:
        raise InvalidQuery(
            f"{variable} ({types.kind_of(variable) or 'unknown kind'}) cannot be mapped; {MAPPABLE}"
        )
    return mode


def aggregation_of(variable: Column) -> Column:
    """The same for a catalogue column; null where it cannot be mapped."""
    table = F.create_map(*[F.lit(x) for pair in MODE_BY_KIND.items() for x in pair])
    return table[types.kind(variable)]


def year_fitness(catalog: DataFrame, variable: str, group_column: str) -> DataFrame:
    """Per edition: whether it has both columns, and which ones it lacks."""
    needed = list(dict.fromkeys([variable, group_column]))
    found = [F.bool_or(F.col("coluna") == column) for column in needed]
    missing = [
        F.when(~has, F.lit(column)) for has, column in zip(found, needed, strict=True)
    ]
    return (
        catalog.groupBy("ano")
        .agg(F.array_compact(F.array(*missing)).alias("faltam"))
        .select("ano", (F.size("faltam") == 0).alias("serve"), "faltam")
        .orderBy("ano")
    )


def usable_years(
    catalog: DataFrame, variable: str, group_column: str, years: Sequence[int] | None = None
) -> list[int]:
    """Years that serve: all the requested ones, or the newest when none is requested."""
    fitness = {row.ano: row for row in year_fitness(catalog, variable, group_column).collect()}
    if not fitness:
        raise InvalidQuery("the catalogue has no edition")
    compared = sorted(set(years)) if years else sorted(fitness)
    serving = [y for y in compared if y in fitness and fitness[y].serve]
    refused = [
        f"{y}: lacks {', '.join(fitness[y].faltam) if y in fitness else 'the edition'}"
        for y in compared
        if y not in serving
    ]
    if not serving:
        raise InvalidQuery(f"no year serves {variable} by {group_column}: {'; '.join(refused)}")
    if years and refused:
        raise InvalidQuery(
            f"years that do not serve: {'; '.join(refused)}. "
            f"Years that would: {', '.join(map(str, serving))}"
        )
    return serving if years else serving[-1:]


# -- the aggregation ---------------------------------------------------------


@dataclass(frozen=True)
class Measure:
    """A measure in two steps: per area and name, then per area.

    Sums and counts are all the first step keeps, so it combines map side in a
    hash aggregation.  Taking the smallest name there would not: an aggregate
    of texts sorts every row first.
    """

    total: Column
    filled: Column
    mode: str

    def combined(self, total: str, filled: str) -> Column:
        value = F.sum(total)
        if self.mode == SUM:
            return value
        return F.try_divide(value, F.sum(filled).cast("double")) * 100


def measure(
    df: DataFrame, variable: str, category: int | None = None, where: Column | None = None
) -> Measure:
    """How a variable is aggregated; nulls never count in a denominator."""
    mode = aggregation_for(variable)
    require(df, [variable])
    text = isinstance(df.schema[variable].dataType, T.StringType)
    value = name(variable) if where is None else F.when(where, name(variable))
    if mode == CATEGORY:
        if category is None:
            raise InvalidQuery(category_missing(variable))
        hit = (value == (F.lit(str(category)) if text else F.lit(category))).cast("double")
        return Measure(F.sum(hit), F.count(hit), mode)
    if text:
        raise InvalidQuery(f"{variable} holds text and cannot be summed or averaged")
    number = value if mode == SUM else value.cast("double")
    return Measure(F.sum(number), F.count(number), mode)


def area_code(column: str) -> Column:
    return name(column).cast("bigint").cast("string")


def panel_rows(
    panel: DataFrame,
    years: Sequence[int] | None,
    active_only: bool = True,
    year: str = fixed.YEAR,
) -> DataFrame:
    """Rows a map counts: active units of the requested years."""
    require(panel, [year])
    rows = panel.filter(name(year).isNotNull())
    if years:
        rows = rows.filter(name(year).isin(*[int(y) for y in years]))
    if active_only and fixed.STATUS in panel.columns:
        text = isinstance(panel.schema[fixed.STATUS].dataType, T.StringType)
        rows = rows.filter(
            name(fixed.STATUS) == (F.lit(str(fixed.ACTIVE)) if text else F.lit(fixed.ACTIVE))
        )
    return rows


def area_aggregate(
    panel: DataFrame,
    variable: str,
    cut: Cut,
    years: Sequence[int] | None = None,
    category: int | None = None,
    active_only: bool = True,
    year: str = fixed.YEAR,
    check: bool = True,
) -> DataFrame:
    """``(ano, codarea, nome, valor, escolas)``, one row per area and year.

    ``check`` stops at the first row found; no row at all is an error.
    """
    value = measure(panel, variable, category)
    require(panel, [cut.column])
    rows = panel_rows(panel, years, active_only, year)
    if cut.filter_column and cut.filter_value is not None:
        rows = rows.filter(name(cut.filter_column) == cut.filter_value)
    if check and rows.isEmpty():
        raise InvalidQuery(f"no unit in {cut.scope}/{cut.code} in the requested years")
    titled = cut.name_column is not None and cut.name_column in panel.columns
    title = name(cut.name_column) if titled else area_code(cut.column)
    by_name = (
        rows.filter(name(cut.column).isNotNull())
        .groupBy(
            name(year).alias("ano"), name(cut.column).alias("__area"), title.alias("__name")
        )
        .agg(
            value.total.alias("__total"),
            value.filled.alias("__filled"),
            F.count(F.lit(1)).alias("__rows"),
        )
    )
    return (
        by_name.groupBy("ano", "__area")
        .agg(
            F.min("__name").alias("nome"),
            value.combined("__total", "__filled").alias("valor"),
            F.sum("__rows").alias("escolas"),
        )
        .select("ano", area_code("__area").alias("codarea"), "nome", "valor", "escolas")
    )


def dominant_category(
    panel: DataFrame,
    variable: str,
    cut: Cut,
    years: Sequence[int] | None = None,
    active_only: bool = True,
    year: str = fixed.YEAR,
) -> DataFrame:
    """The most frequent code of a category per area and year.

    ``(ano, codarea, nome, categoria, rotulo, escolas, com_codigo, pct, margem)``: the units that
    have it, the units with any code, their share in percent and its lead over the second code
    in points.  Ties go to the smaller code; areas whose units have no code give no row.
    """
    if aggregation_for(variable) != CATEGORY:
        raise InvalidQuery(f"{variable} is no category")
    require(panel, [variable, cut.column])
    rows = panel_rows(panel, years, active_only, year)
    if cut.filter_column and cut.filter_value is not None:
        rows = rows.filter(name(cut.filter_column) == cut.filter_value)
    titled = cut.name_column is not None and cut.name_column in panel.columns
    title = name(cut.name_column) if titled else area_code(cut.column)
    keys = ["ano", "__area"]
    counts = (
        rows.filter(name(cut.column).isNotNull() & name(variable).isNotNull())
        .groupBy(
            name(year).alias("ano"), name(cut.column).alias("__area"), name(variable).alias("categoria"),
            title.alias("__name"),
        )
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    # areas have as many rows as codes here; names of one area are taken together
    by_code = counts.groupBy(*keys, "categoria").agg(F.sum("__n").alias("escolas"), F.min("__name").alias("nome"))
    whole = Window.partitionBy(*keys)
    ranked = by_code.withColumns({
        "__rank": F.row_number().over(whole.orderBy(F.desc("escolas"), "categoria")),
        "com_codigo": F.sum("escolas").over(whole),
        "nome": F.min("nome").over(whole),
        "__second": F.lead("escolas", 1, 0).over(whole.orderBy(F.desc("escolas"), "categoria")),
    })
    share = F.lit(100.0) / F.col("com_codigo")
    labels = fixed.CODE_LABELS.get(variable)
    label_ = map_value(F.col("categoria"), labels) if labels else F.lit(None).cast("string")
    return ranked.filter(F.col("__rank") == 1).select(
        "ano", area_code("__area").alias("codarea"), "nome", "categoria",
        F.coalesce(label_, F.col("categoria").cast("string")).alias("rotulo"), "escolas", "com_codigo",
        (F.col("escolas") * share).alias("pct"), ((F.col("escolas") - F.col("__second")) * share).alias("margem"),
    )


# -- polygons ----------------------------------------------------------------


def areas_with_series(areas: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per area: its name and its values and counts as maps by year."""

    def by_year(column: Column) -> Column:
        # One entry per year of an area, so the list cannot grow with the rows.
        pairs = F.collect_list(F.struct(F.col("ano").cast("string"), column))
        return F.map_from_entries(F.array_sort(pairs))

    return areas.groupBy(*by, "codarea").agg(
        F.min_by("nome", "ano").alias("nome"),
        by_year(F.round("valor", 2)).alias("valores"),
        by_year(F.col("escolas").cast("bigint")).alias("escolas"),
    )


def join_mesh(
    mesh: DataFrame, areas: DataFrame, by: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Polygons with their data, and the coverage of the join.

    Every polygon survives.  ``by`` separates several maps in one pair of
    frames (mesh and areas carry the same map columns).  The joins are
    unhinted: areas are unique per code, and the optimizer broadcasts them when
    they are few.
    """
    keys = [*by, "codarea"]
    mesh = mesh.withColumn("codarea", F.coalesce("codarea", F.lit("")))
    series = areas_with_series(areas, by)
    empty_values = F.create_map().cast("map<string,double>")
    empty_counts = F.create_map().cast("map<string,bigint>")
    features = mesh.join(series, keys, "left").select(
        *keys,
        F.coalesce("nome", "codarea").alias("nome"),
        F.coalesce("valores", empty_values).alias("valores"),
        F.coalesce("escolas", empty_counts).alias("escolas"),
        *[c for c in mesh.columns if c not in keys],
    )
    return features, mesh_coverage(mesh, areas, by)


def mesh_coverage(mesh: DataFrame, areas: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Polygons, polygons with data, and data codes without a polygon.

    Polygons are counted per code before the join, so a code repeated in a
    mesh is one row there.
    """
    keys = [*by, "codarea"]
    polygons = mesh.groupBy(*by, F.coalesce("codarea", F.lit("")).alias("codarea")).agg(
        F.count(F.lit(1)).alias("__polygons")
    )
    codes = areas.select(*keys).distinct().withColumn("__data", F.lit(True))
    both = polygons.join(codes, keys, "full_outer")
    has_data, has_polygon = F.col("__data").isNotNull(), F.col("__polygons").isNotNull()
    polygon_count = F.coalesce("__polygons", F.lit(0))
    orphan = has_data & ~has_polygon
    totals = both.groupBy(*by).agg(
        F.coalesce(F.sum(polygon_count), F.lit(0)).alias("areas_na_malha"),
        F.coalesce(F.sum(F.when(has_data, polygon_count)), F.lit(0)).alias("areas_com_dado"),
        F.count_if(orphan).alias("n_codigos_sem_poligono"),
    )
    orphans = both.filter(orphan).select(*keys)
    if by:
        # The rank filter limits each map's codes before the shuffle.
        first = Window.partitionBy(*by).orderBy("codarea")
        listed = (
            orphans.withColumn("__n", F.row_number().over(first))
            .filter(F.col("__n") <= fixed.LISTED_CODES)
            .drop("__n")
        )
    else:
        listed = orphans.orderBy("codarea").limit(fixed.LISTED_CODES)
    rows = totals.unionByName(listed, allowMissingColumns=True)
    return rows.groupBy(*by).agg(
        F.max("areas_na_malha").alias("areas_na_malha"),
        F.max("areas_com_dado").alias("areas_com_dado"),
        F.sort_array(F.collect_list("codarea")).alias("codigos_sem_poligono"),
        F.max("n_codigos_sem_poligono").alias("n_codigos_sem_poligono"),
    )


def coverage_warnings(coverage: DataFrame) -> DataFrame:
    """What a reader of the map must know, as an array of texts."""
    empty = F.col("areas_na_malha") - F.col("areas_com_dado")
    orphans = F.col("n_codigos_sem_poligono")
    texts = F.array(
        F.when(empty > 0, F.concat(empty.cast("string"), F.lit(" polygon(s) without data"))),
        F.when(
            orphans > 0, F.concat(orphans.cast("string"), F.lit(" area code(s) without polygon"))
        ),
    )
    return coverage.withColumn("avisos", F.array_compact(texts))


# -- colour classes ----------------------------------------------------------


def quantile_breaks(
    df: DataFrame, value: str = "valor", by: str = "ano", k: int = fixed.COLOUR_CLASSES
) -> DataFrame:
    """``(by, cortes)``: the sorted values at positions ``floor(i*n/k)``, exactly.

    A group may hold most of the rows, so no group is sorted in one task.
    Equal values are counted together and dealt by range of group and value.
    The parts of a group are disjoint stretches of its values, so prefix sums
    of their sizes tell which parts hold a break, and only those are ranked.
    A stretch is known by its ends, not by its partition: how the ranges are
    drawn affects the work alone, never the result.
    """
    require(df, [value, by])
    counts = (
        df.filter(name(value).isNotNull() & name(by).isNotNull())
        .groupBy(name(by).alias("__g"), name(value).alias("__v"))
        .agg(F.count(F.lit(1)).alias("__c"))
        # Always true: it keeps the count in every use, so all share one shuffle.
        .filter(F.col("__c") > 0)
    )
    stretches = (
        counts.repartitionByRange("__g", "__v")
        .groupBy("__g", F.spark_partition_id().alias("__part"))
        .agg(
            F.min("__v").alias("low"), F.max("__v").alias("high"), F.sum("__c").alias("size")
        )
    )
    before = Window.partitionBy("__g").orderBy("low").rowsBetween(
        Window.unboundedPreceding, -1
    )
    placed = stretches.withColumns({
        "start": F.coalesce(F.sum("size").over(before), F.lit(0)),
        "__n": F.sum("size").over(Window.partitionBy("__g")),
    })
    positions = [F.floor(F.lit(i) * F.col("__n") / k) for i in range(1, k)]

    def any_break(start: Column, end: Column) -> Column:
        return reduce(or_, [(at >= start) & (at < end) for at in positions])

    # At most one stretch per break and group.
    wanted = placed.filter(any_break(F.col("start"), F.col("start") + F.col("size"))).drop("size", "__part")
    held = counts.join(wanted, "__g").filter(F.col("__v").between(F.col("low"), F.col("high")))
    upto = Window.partitionBy("__g", "low").orderBy("__v").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    end = F.col("__end")
    ranked = held.withColumn("__end", F.col("start") + F.sum("__c").over(upto))
    hits = F.array_compact(F.array(*[
        F.when((at >= end - F.col("__c")) & (at < end), F.lit(i)) for i, at in enumerate(positions, 1)
    ]))
    found = ranked.filter(any_break(end - F.col("__c"), end)).select("__g", "__v", F.explode(hits).alias("__i"))
    pairs = F.array_sort(F.collect_list(F.struct(F.col("__i").alias("i"), F.col("__v").alias("v"))))
    return (
        found.groupBy("__g")
        .agg(pairs.alias("__p"))
        .select(F.col("__g").alias(by), F.col("__p.v").alias("cortes"))
    )


def quantile_classes(
    df: DataFrame, value: str = "valor", by: str = "ano", k: int = fixed.COLOUR_CLASSES
) -> DataFrame:
    """Add ``cortes`` and ``classe`` (0..k-1); a null value has no class."""
    if k < 2 or not math.isfinite(k):
        raise ValueError("at least two classes are needed")
    breaks = quantile_breaks(df, value, by, k)
    below = F.size(F.filter("cortes", lambda b: b <= name(value)))
    return df.join(breaks, by, "left").withColumn(
        "classe", F.when(name(value).isNotNull(), below)
    )


def class_ranges(breaks: DataFrame, by: str = "ano") -> DataFrame:
    """Legend: lower and upper limit of each class; the last one is open."""
    lower = F.concat(F.array(F.lit(0.0)), "cortes")
    limits = F.arrays_zip(lower.alias("de"), F.col("cortes").alias("ate"))
    return breaks.select(by, F.posexplode(limits).alias("classe", "limites")).select(
        by, "classe", "limites.de", "limites.ate"
    )
