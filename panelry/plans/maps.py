"""Maps end to end: from saved queries to polygons with data.

Everything that can be refused is refused from the headers, before any scan.
All maps of a list come from one scan of the panel: the levels are grouping
sets of one aggregation, and row filters are conditions inside its measures.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelry import fixed
from panelry.errors import InvalidQuery
from panelry.frames import local_frame, name, require
from panelry.functions.codes import map_value
from panelry.functions.text import slug as slug_of
from panelry.functions.types import kind as kind_column
from panelry.functions.types import kind_of
from panelry.operators.areas import (
    CATEGORY,
    MAPPABLE,
    Cut,
    aggregation_for,
    aggregation_of,
    area_aggregate,
    area_code,
    category_missing,
    coverage_warnings,
    join_mesh,
    measure,
    panel_rows,
    usable_years,
)
from panelry.operators.cuts import cut_of, parse_cuts
from panelry.operators.dictionary import describe_variable
from panelry.sources.tables import write_area_table, write_geojson_features

# Maps of one shared aggregation, whose plan grows with them; longer lists take several.
MAPS_PER_SCAN = 100


@dataclass(frozen=True)
class MapSpec:
    """One map whose variable, cut and years were found to serve."""

    variable: str
    cut: Cut
    years: tuple[int, ...]
    category: int | None = None
    slug: str = ""


def resolved_maps(catalog: DataFrame, queries: DataFrame, line: str = "linha") -> DataFrame:
    """Saved queries with all that makes a map of them, or why none can be made; a row per query.

    Adds to the columns of :func:`parse_cuts`: ``agregacao``, ``categoria``, ``usados`` (the years
    the map shows), ``slug`` and ``erro``.  One relational job whatever the number of queries: the
    headers become one row per column with its years, and each query meets two of them.
    """
    lines = parse_cuts(queries, line)
    editions = F.coalesce(
        catalog.agg(F.array_sort(F.collect_set(F.col("ano").cast("int")))).scalar(),
        F.array().cast("array<int>"),
    )
    # one entry per edition, so the set cannot grow with the columns
    present = catalog.groupBy("coluna").agg(F.array_sort(F.collect_set(F.col("ano").cast("int"))).alias("__years"))
    of_variable = present.select(F.col("coluna").alias("__variable"), F.col("__years").alias("__of_variable"))
    of_group = present.select(F.col("coluna").alias("__group"), F.col("__years").alias("__of_group"))
    found = (
        lines.join(of_variable, F.col("variavel") == F.col("__variable"), "left")
        .join(of_group, F.col("coluna") == F.col("__group"), "left")
        .drop("__variable", "__group")
        .withColumns({
            "__editions": editions,
            "agregacao": aggregation_of(F.col("variavel")),
            "__category": F.try_element_at("opcoes", F.lit("CATEGORIA")),
        })
    )
    none = F.array().cast("array<int>")
    asked = F.size("anos") > 0
    compared = F.when(asked, F.array_distinct("anos")).otherwise(F.col("__editions"))
    has_variable = F.coalesce("__of_variable", none)
    has_group = F.coalesce("__of_group", none)

    def serves(y):
        return F.array_contains(has_variable, y) & F.array_contains(has_group, y)

    def refusal(y):
        lacking = F.array_distinct(F.array_compact(F.array(
            F.when(~F.array_contains(has_variable, y), F.col("variavel")),
            F.when(~F.array_contains(has_group, y), F.col("coluna")),
        )))
        edition = F.array_contains("__editions", y)
        return F.concat(y.cast("string"), F.lit(": lacks "),
                        F.when(edition, F.array_join(lacking, ", ")).otherwise("the edition"))

    found = found.withColumn("__serving", F.filter(compared, serves)).withColumn(
        "__refused", F.array_join(F.transform(F.filter(compared, lambda y: ~serves(y)), refusal), "; ")
    )
    category = F.col("__category").try_cast("int")
    kind = F.coalesce(F.nullif(kind_column(F.col("variavel")), F.lit("")), F.lit("unknown kind"))
    serving = F.array_join(F.col("__serving").cast("array<string>"), ", ")
    error = (
        F.when(F.col("erro").isNotNull(), F.col("erro"))
        .when(F.col("agregacao").isNull(), F.concat(F.col("variavel"), F.lit(" ("), kind, F.lit(") cannot be mapped; " + MAPPABLE)))
        .when(F.size("__editions") == 0, "the catalogue has no edition")
        .when(F.size("__serving") == 0, F.concat(
            F.lit("no year serves "), "variavel", F.lit(" by "), "coluna", F.lit(": "), "__refused"))
        .when(asked & (F.col("__refused") != ""), F.concat(
            F.lit("years that do not serve: "), "__refused", F.lit(". Years that would: "), serving))
        .when((F.col("agregacao") == CATEGORY) & F.coalesce(F.col("__category") == "", F.lit(True)), F.concat(
            "variavel", F.lit(" is a category: choose one code. Options: "), options_of(F.col("variavel"))))
        .when((F.col("__category") != "") & category.isNull(), F.concat(
            F.lit("CATEGORIA is no code: "), "__category"))
    )
    used = F.when(asked, F.col("__serving")).otherwise(F.slice("__serving", -1, 1))
    found = found.withColumn("erro", error).withColumns({
        "categoria": F.when(F.col("erro").isNull(), category),
        "usados": F.when(F.col("erro").isNull(), used),
    }).drop("__of_variable", "__of_group", "__editions", "__category", "__serving", "__refused")
    return with_slug(found)


def options_of(variable) -> Column:
    """The codes a category has, as a reader may choose them."""
    known = {k: ", ".join(f"{c}={t}" for c, t in codes.items()) for k, codes in fixed.CODE_LABELS.items()}
    return F.coalesce(map_value(variable, known), F.lit("see the dictionary"))


def with_slug(found: DataFrame) -> DataFrame:
    """Name every map after its variable, cut and years: a rebuild replaces, never piles up.

    Only where different maps of the list would share that name it also tells what parts them:
    the category, all the years, the mesh.
    """
    years = F.array_join(F.col("usados").cast("array<string>"), "-")
    ends = F.array_distinct(F.array(F.element_at("usados", 1), F.element_at("usados", -1)))
    span = F.array_join(ends.cast("array<string>"), "-")
    cut = F.concat_ws("-", F.coalesce("intrarregiao", F.lit("total")), "codigo")
    parts = {
        "__category": F.coalesce(F.concat(F.lit("c"), F.col("categoria").cast("string")), F.lit("")),
        "__years": years,
        "__mesh": F.substring(F.sha2(F.col("malha").cast("binary"), 256), 1, 8),
    }
    named = found.withColumns({
        "__base": F.when(F.col("erro").isNull(), slug_of(F.col("variavel"), cut, span)),
        **{c: F.when(F.col("erro").isNull(), value) for c, value in parts.items()},
    })
    # two aggregates per part in hash form; the list itself is neither sorted nor windowed
    maps = named.filter(F.col("__base").isNotNull()).select("__base", *parts).distinct()
    differ = maps.groupBy(F.col("__base").alias("__name")).agg(*[
        (F.count_distinct(c) > 1).alias(f"{c}_differs") for c in parts
    ])
    joined = named.join(differ, F.col("__base") == F.col("__name"), "left")
    more = [F.when(F.col(f"{c}_differs") & (F.col(c) != ""), F.col(c)) for c in parts]
    return joined.withColumn("slug", F.when(F.col("__base").isNotNull(), F.concat_ws("-", "__base", *more))).drop(
        "__base", "__name", *parts, *[f"{c}_differs" for c in parts]
    )


def spec_of(row) -> MapSpec:
    return MapSpec(row.variavel, cut_of(row), tuple(row.usados), row.categoria, row.slug)


def resolve(
    catalog: DataFrame,
    variable: str,
    cut: Cut,
    years: Sequence[int] | None = None,
    category: int | None = None,
) -> MapSpec:
    """Check one map against the headers."""
    variable = variable.upper()
    mode = aggregation_for(variable)
    serving = tuple(usable_years(catalog, variable, cut.column, years))
    if mode == CATEGORY and category is None:
        raise InvalidQuery(category_missing(variable))
    spec = MapSpec(variable, cut, serving, category)
    return with_slugs(catalog, [spec])[0]


def resolve_all(catalog: DataFrame, queries: DataFrame, line: str = "linha") -> list[MapSpec]:
    """Check a list of saved queries; any that cannot be answered is an error.

    One job; what reaches the driver is a row per map, which the plan of the maps is made of.
    """
    numbered = queries.withColumn("__n", F.monotonically_increasing_id())
    rows = sorted(resolved_maps(catalog, numbered, line).collect(), key=lambda row: row["__n"])
    wrong = [f"{row[line]!r}: {row.erro}" for row in rows if row.erro]
    if wrong:
        raise InvalidQuery("; ".join(wrong))
    return check_distinct([spec_of(row) for row in rows])


def check_distinct(specs: Sequence[MapSpec]) -> list[MapSpec]:
    """Each map once; different maps of one name, and so one folder, are refused."""
    by_slug: dict[str, set[MapSpec]] = {}
    for spec in specs:
        by_slug.setdefault(spec.slug, set()).add(spec)
    same = [slug for slug, found in by_slug.items() if len(found) > 1]
    if same:
        raise InvalidQuery(f"different maps of one name: {', '.join(sorted(same))}")
    return [found.pop() for found in by_slug.values()]


def with_slugs(frame: DataFrame, specs: Sequence[MapSpec]) -> list[MapSpec]:
    """Name maps made one by one, without looking at others."""
    parts = [
        (
            i,
            spec.variable,
            f"{spec.cut.level or 'total'}-{spec.cut.code}",
            "-".join(map(str, sorted({spec.years[0], spec.years[-1]}))),
        )
        for i, spec in enumerate(specs)
    ]
    schema = {"i": "int", "variavel": "string", "recorte": "string", "faixa": "string"}
    named = local_frame(frame.sparkSession, schema, parts).select(
        "i", slug_of(F.col("variavel"), F.col("recorte"), F.col("faixa")).alias("slug")
    )
    slugs = {row.i: row.slug for row in named.collect()}
    return [
        MapSpec(s.variable, s.cut, s.years, s.category, slugs[i]) for i, s in enumerate(specs)
    ]


def check_scopes(panel: DataFrame, specs: Sequence[MapSpec], year: str = fixed.YEAR) -> None:
    """Refuse maps whose scope holds no unit in their years: one narrow scan for all of them."""
    scopes = sorted({(s.cut.filter_column or "", s.cut.filter_value or 0, s.years, s.cut.scope, s.cut.code) for s in specs})
    columns = sorted({c for c, *_ in scopes if c})
    require(panel, columns)
    rows = panel_rows(panel, sorted({y for s in specs for y in s.years}), year=year).select(name(year), *map(name, columns))
    # one row per year and scope column value, so each scope is looked up in few rows
    held = None
    for column in ["", *columns]:
        value = name(column).cast("bigint") if column else F.lit(0).cast("bigint")
        part = rows.select(F.lit(column).alias("c"), value.alias("v"), name(year).cast("int").alias("y")).distinct()
        held = part if held is None else held.unionByName(part)
    wanted = local_frame(
        panel.sparkSession, {"i": "int", "c": "string", "v": "bigint", "y": "int"},
        [(i, c, v, y) for i, (c, v, years, *_) in enumerate(scopes) for y in years],
    )
    served = {r.i for r in wanted.join(held, ["c", "v", "y"], "left_semi").select("i").distinct().collect()}
    empty = [f"{scope}/{code} in {', '.join(map(str, years))}"
             for i, (_, _, years, scope, code) in enumerate(scopes) if i not in served]
    if empty:
        raise InvalidQuery(f"no unit in {'; '.join(empty)}")


def map_meta(spec: MapSpec, cut: Cut, descriptions: DataFrame | None = None) -> dict:
    """What a map shows, for its readers."""
    return {
        "slug": spec.slug,
        "variavel": spec.variable,
        "natureza": kind_of(spec.variable),
        "agregacao": aggregation_for(spec.variable),
        "categoria": spec.category,
        "anos": list(spec.years),
        "grao": cut.level or cut.scope,
        "fonte_malha": cut.mesh,
        "descricao": describe_variable(descriptions, spec.variable)
        if descriptions is not None
        else "",
    }


def build_map(
    panel: DataFrame,
    catalog: DataFrame,
    mesh: DataFrame,
    variable: str,
    cut: Cut,
    years: Sequence[int] | None = None,
    category: int | None = None,
    descriptions: DataFrame | None = None,
) -> dict:
    """One map: its polygons with data, coverage, area table and description."""
    spec = resolve(catalog, variable, cut, years, category)
    areas = area_aggregate(panel, spec.variable, cut, spec.years, category)
    features, coverage = join_mesh(mesh, areas)
    meta = map_meta(spec, cut, descriptions)
    return {"features": features, "coverage": coverage, "areas": areas, "meta": meta}


def write_map(
    panel: DataFrame,
    catalog: DataFrame,
    mesh: DataFrame,
    variable: str,
    cut: Cut,
    out: str,
    years: Sequence[int] | None = None,
    category: int | None = None,
    descriptions: DataFrame | None = None,
) -> dict:
    """Build one map below ``out`` and publish it; returns its description with ``avisos``.

    The panel is scanned once, for the area table; polygons, text table and coverage are read
    from that.  All of it goes to a folder of its own, and one row appended to the map's manifest
    publishes it: readers see the whole map before or the whole map after, also when a job fails
    halfway.
    """
    spark = panel.sparkSession
    spec = resolve(catalog, variable, cut, years, category)
    areas = area_aggregate(panel, spec.variable, cut, spec.years, category, check=False)
    home = f"{out.rstrip('/')}/{spec.slug}"
    folder = f"{home}/{uuid.uuid4().hex}"
    areas.write.parquet(f"{folder}/areas")
    areas = spark.read.parquet(f"{folder}/areas")
    if areas.isEmpty():
        raise InvalidQuery(f"no unit in {cut.scope}/{cut.code} in the requested years")
    features, coverage = join_mesh(mesh, areas)
    write_geojson_features(features, f"{folder}/geojson")
    write_area_table(areas, f"{folder}/csv")
    size = spark.read.text(f"{folder}/geojson").agg(F.coalesce(F.sum(F.octet_length("value") + 1), F.lit(0))).scalar()
    told = coverage_warnings(coverage).withColumn("bytes", size).first()
    warned = list(told.avisos)
    if told.bytes > fixed.MAP_BYTES:
        warned.append(f"the map has {told.bytes / 2**20:.1f} MiB: take qualidade=minima or a smaller cut")
    meta = map_meta(spec, cut, descriptions) | {
        "cobertura": {c: told[c] for c in coverage.columns},
        "avisos": warned,
        "gerado_em": date.today().isoformat(),
    }
    row = (folder, int(time.time() * 1000), json.dumps(meta, ensure_ascii=False))
    kinds = {"pasta": "string", "publicado": "bigint", "meta": "string"}
    local_frame(spark, kinds, [row]).write.mode("append").json(f"{home}/manifest")
    return meta


def read_map(spark: SparkSession, out: str, slug: str) -> dict:
    """The map published last: its meta, area table and feature lines."""
    manifest = spark.read.schema("pasta string, publicado bigint, meta string").json(f"{out.rstrip('/')}/{slug}/manifest")
    row = manifest.orderBy(F.desc("publicado"), "pasta").first()
    return {
        "meta": json.loads(row.meta),
        "areas": spark.read.parquet(f"{row.pasta}/areas"),
        "features": spark.read.text(f"{row.pasta}/geojson"),
    }


def area_tables(panel: DataFrame, specs: Sequence[MapSpec], year: str = fixed.YEAR) -> DataFrame:
    """``(slug, ano, codarea, nome, valor, escolas)`` of every map, in one scan."""
    specs = check_distinct(specs)
    if len(specs) > MAPS_PER_SCAN:
        parts = [specs[i : i + MAPS_PER_SCAN] for i in range(0, len(specs), MAPS_PER_SCAN)]
        return reduce(DataFrame.unionByName, [area_tables(panel, part, year) for part in parts])
    levels = sorted({spec.cut.column for spec in specs})
    require(panel, levels)
    rows = panel_rows(panel, sorted({y for s in specs for y in s.years}), year=year)

    def condition(cut: Cut):
        if cut.filter_column is None or cut.filter_value is None:
            return None
        return F.coalesce(name(cut.filter_column) == cut.filter_value, F.lit(False))

    measures, counts = {}, {}
    for spec in specs:
        scope = (spec.cut.filter_column, spec.cut.filter_value)
        where = condition(spec.cut)
        measures.setdefault(
            (spec.variable, spec.category, scope),
            measure(rows, spec.variable, spec.category, where),
        )
        counts.setdefault(scope, F.count(F.lit(1)) if where is None else F.count_if(where))
    value_at = {key: f"m{i}" for i, key in enumerate(measures)}
    count_at = {key: f"n{i}" for i, key in enumerate(counts)}

    # One grouping set per level: year, area and the area's name.  The keys are
    # copies, because the measures may read the same columns.
    n = len(levels)
    names = [fixed.AREA_NAME.get(c) for c in levels]
    keyed = rows.select(
        "*",
        name(year).alias("__year"),
        *[name(c).alias(f"__level{i}") for i, c in enumerate(levels)],
        *[
            (name(t) if t in panel.columns else area_code(c)).alias(f"__name{i}")
            for i, (c, t) in enumerate(zip(levels, names, strict=True))
        ],
    )
    keys = ["__year", *[f"__level{i}" for i in range(n)], *[f"__name{i}" for i in range(n)]]
    sets = [[F.col(k) for k in ("__year", f"__level{i}", f"__name{i}")] for i in range(n)]
    by_name = keyed.groupingSets(sets, *keys).agg(
        F.grouping_id().alias("__set"),
        *[m.total.alias(f"{value_at[k]}t") for k, m in measures.items()],
        *[m.filled.alias(f"{value_at[k]}f") for k, m in measures.items()],
        *[c.alias(count_at[k]) for k, c in counts.items()],
    )

    # The grouping id has one bit per key, set where the key is rolled up.
    def set_of(level: int) -> int:
        grouped = {0, 1 + level, 1 + n + level}
        return sum(1 << (2 * n - j) for j in range(2 * n + 1) if j not in grouped)

    code, title = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i in range(n):
        at = F.col("__set") == set_of(i)
        code = F.when(at, area_code(f"__level{i}")).otherwise(code)
        title = F.when(at, F.col(f"__name{i}")).otherwise(title)
    areas = (
        by_name.select(
            F.col("__year").alias("ano"),
            "__set",
            code.alias("codarea"),
            title.alias("__name"),
            *[f"{v}{part}" for v in value_at.values() for part in "tf"],
            *count_at.values(),
        )
        .filter(F.col("codarea").isNotNull())
        .groupBy("ano", "__set", "codarea")
        .agg(
            *[
                m.combined(f"{value_at[k]}t", f"{value_at[k]}f").cast("double").alias(value_at[k])
                for k, m in measures.items()
            ],
            *[F.sum(c).alias(c) for c in count_at.values()],
            # The name an area has among the rows of each scope.
            *[
                F.min(F.when(F.col(c) > 0, F.col("__name"))).alias(f"{c}t")
                for c in count_at.values()
            ],
        )
    )

    def entry(spec: MapSpec):
        scope = (spec.cut.filter_column, spec.cut.filter_value)
        count = count_at[scope]
        serves = F.col("ano").isin(*spec.years)
        return F.struct(
            F.lit(spec.slug).alias("slug"),
            F.col(f"{count}t").alias("nome"),
            F.col(value_at[(spec.variable, spec.category, scope)]).alias("valor"),
            F.when(serves, F.col(count)).otherwise(0).cast("bigint").alias("escolas"),
        )

    entries = None
    for i, level in enumerate(levels):
        at = F.col("__set") == set_of(i)
        maps = F.array(*[entry(s) for s in specs if s.cut.column == level])
        entries = F.when(at, maps) if entries is None else entries.when(at, maps)
    return (
        areas.select("ano", "codarea", F.inline(entries))
        .filter(F.col("escolas") > 0)
        .select("slug", "ano", "codarea", "nome", "valor", "escolas")
    )


def meshes_of(meshes: DataFrame, specs: Sequence[MapSpec]) -> DataFrame:
    """The polygons of every map, from ``(malha, codarea, geometry)``."""
    pairs = local_frame(
        meshes.sparkSession,
        {"slug": "string", "malha": "string"},
        sorted({(s.slug, s.cut.mesh) for s in specs}),
    )
    return meshes.join(pairs, "malha").drop("malha")


def build_all_maps(
    panel: DataFrame, catalog: DataFrame, queries: DataFrame, meshes: DataFrame, check: bool = True
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every map of a query list: polygons with data, coverage, area tables.

    ``check`` looks for a unit in the scope of every map before anything is built.
    """
    specs = resolve_all(catalog, queries)
    if check:
        check_scopes(panel, specs)
    areas = area_tables(panel, specs)
    features, coverage = join_mesh(meshes_of(meshes, specs), areas, ["slug"])
    return features, coverage, areas


def write_all_maps(
    panel: DataFrame, catalog: DataFrame, queries: DataFrame, meshes: DataFrame, out: str
) -> list[str]:
    """Rebuild all maps below ``out``, one folder per map.

    The area tables are written once and read back, so polygons, coverage and
    text tables come from one snapshot and the panel is scanned once.
    """
    specs = resolve_all(catalog, queries)
    check_scopes(panel, specs)
    root = out.rstrip("/")
    area_tables(panel, specs).write.mode("overwrite").parquet(f"{root}/areas")
    areas = panel.sparkSession.read.parquet(f"{root}/areas")
    features, coverage = join_mesh(meshes_of(meshes, specs), areas, ["slug"])
    write_geojson_features(features, f"{root}/geojson")
    write_area_table(areas, f"{root}/csv")
    coverage.write.mode("overwrite").json(f"{root}/coverage")
    return [spec.slug for spec in specs]
