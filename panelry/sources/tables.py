"""Dictionary tables, samples, meshes and map files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelry import fixed
from panelry.frames import name
from panelry.operators.dictionary import DICTIONARY_COLUMNS

_TYPES = {
    "tipo_estavel": "boolean", "conflito_prefixo": "boolean", "comum": "boolean",
    "continua": "boolean", "contagem_exata": "boolean", "zeros_a_esquerda": "boolean",
    "n_anos": "int", "primeiro_ano": "int", "ultimo_ano": "int", "largura_max": "int",
    "n_distintos": "bigint", "pct_nulo_max": "double", "minimo": "double", "maximo": "double",
}


def write_dictionary(dictionary: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Dictionary as comma-separated UTF-8 text; one row per column name, so one file."""
    dictionary.coalesce(1).write.mode(mode).csv(path, header=True, escape='"')


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """Dictionary written before; only the empty text is null, so ``NA`` survives."""
    raw = spark.read.csv(path, header=True, escape='"')
    return raw.select(*[
        F.nullif(name(c), F.lit("")).cast(_TYPES.get(c, "string")).alias(c)
        for c in DICTIONARY_COLUMNS
        if c in raw.columns
    ])


def write_sample(df: DataFrame, path: str, mode: str = "overwrite", most: int = 1_048_575) -> None:
    """A sample as one text file, in the order of its rows.

    One file is one task: a frame of more than ``most`` rows (what a sheet holds) is no sample
    and is refused.
    """
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a sample has at most {most} rows; limit the frame first")
    df.coalesce(1).write.mode(mode).csv(path, sep=fixed.SEPARATOR, header=True, escape='"')


_MESH = (
    "type string, features array<struct<type string, "
    "properties struct<codarea string>, geometry string>>"
)


def read_mesh(spark: SparkSession, path: str) -> DataFrame:
    """Polygons of a GeoJSON collection as ``(posicao, codarea, geometry)``.

    The geometry stays raw text: it is carried, never computed on.
    """
    raw = spark.read.schema(_MESH).option("multiLine", True).json(path)
    return _polygons(raw, F.struct("type", "features"), [])


def parse_meshes(collections: DataFrame, text: str = "conteudo") -> DataFrame:
    """Polygons of GeoJSON collections held as texts, as ``(..., posicao, codarea, geometry)``.

    The other columns of ``collections`` stay and tell the meshes apart.  A text that is no
    collection stops the job.  The geometry stays raw text.
    """
    others = [c for c in collections.columns if c != text]
    return _polygons(collections, F.from_json(name(text), _MESH), others)


def _polygons(df: DataFrame, mesh: Column, others: list[str]) -> DataFrame:
    kind = "array<struct<type string, properties struct<codarea string>, geometry string>>"
    read = df.select(*map(name, others), F.explode(F.array(mesh)).alias("__m"))
    refused = F.raise_error(F.lit("the mesh is not a FeatureCollection")).cast(kind)
    features = F.when(F.col("__m.type") == "FeatureCollection", F.col("__m.features")).otherwise(refused)
    return read.select(*map(name, others), F.posexplode(features).alias("posicao", "f")).select(
        *map(name, others),
        "posicao",
        F.coalesce("f.properties.codarea", F.lit("")).alias("codarea"),
        F.col("f.geometry").alias("geometry"),
    )


def geojson_features(features: DataFrame) -> DataFrame:
    """One GeoJSON Feature per row, data inside, nulls kept."""
    properties = F.to_json(
        F.struct("codarea", "nome", "valores", "escolas"), {"ignoreNullFields": "false"}
    )
    others = [c for c in features.columns if c not in (
        "codarea", "nome", "valores", "escolas", "geometry", "posicao")]
    return features.select(
        *others,
        F.concat(
            F.lit('{"type":"Feature","properties":'),
            properties,
            F.lit(',"geometry":'),
            F.coalesce("geometry", F.lit("null")),
            F.lit("}"),
        ).alias("value"),
    )


def write_geojson_features(features: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Features, one per line; a map column (``slug``) becomes the folder."""
    lines = geojson_features(features)
    by = [c for c in ("slug",) if c in lines.columns]
    lines.select(*by, "value").write.mode(mode).partitionBy(*by).text(path)


def write_area_table(areas: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The table behind the maps, as text."""
    by = [c for c in ("slug",) if c in areas.columns]
    areas.write.mode(mode).partitionBy(*by).csv(path, header=True)
