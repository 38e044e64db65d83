"""

``queries()`` runs an operator over whole tables, ``oracle_sql()`` computes the
same answer in plain SQL.  Census roles are given to the tables' columns here:
yearly slices of ``orders`` are the editions, nations and customers the areas.
"""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
import warnings
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
# Python workers of sessions started later find the packages too
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])

import panelry as p  # noqa: E402
from panelry import fixed  # noqa: E402
from panelry.operators.areas import aggregation_of  # noqa: E402

SMOKE = "/root/testdata/sf0.001"
YEARS = range(1995, 2002)
MESH = f"https://{fixed.MESH_HOST}/api/v3/malhas"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# -- editions: yearly slices of orders whose columns drift ---------------------

PRIORITY = {1: "URGENT", 2: "HIGH", 3: "MEDIUM", 4: "NOT SPECIFIED", 5: "LOW"}


def edition_columns(year: int) -> list[tuple[str, str]]:
    """Columns of one edition in file order, as expressions of Spark and ANSI SQL."""
    client = "CAST(o_custkey AS STRING)"
    columns = [
        ("NU_ANO_CENSO", "CAST(year(o_orderdate) AS STRING)"),
        ("CO_ENTIDADE", "CAST(o_orderkey AS STRING)"),
        ("CO_CLIENTE", client if year < 1998 else f"concat('0MI', {client})"),
        ("SG_STATUS", "o_orderstatus"),
        ("TP_PRIORIDADE", "substr(o_orderpriority, 1, 1)"),
        ("DT_PEDIDO", "CAST(o_orderdate AS STRING)"),
    ]
    if year <= 1999:
        columns.append(("QT_VALOR", "CAST(o_totalprice AS STRING)"))
    if year != 1996:
        columns.append((
            "IN_URGENTE",
            "CASE WHEN o_orderpriority = '1-URGENT' THEN '1' "
            "WHEN o_orderpriority = '5-LOW' THEN 'NA' ELSE '0' END",
        ))
    return columns if year < 2000 else columns[::-1]


def slice_of(orders: DataFrame, year: int) -> DataFrame:
    # A range on the column itself reaches the scan; year(column) would not.
    day = F.col("o_orderdate")
    return orders.filter((day >= f"{year}-01-01") & (day < f"{year + 1}-01-01"))


def editions(spark: SparkSession, folder: str) -> dict[int, DataFrame]:
    orders = table(spark, folder, "orders")
    return {
        year: slice_of(orders, year).select(
            *[F.expr(text).alias(column) for column, text in edition_columns(year)]
        )
        for year in YEARS
    }


def client_catalog(spark: SparkSession, folder: str) -> DataFrame:
    """Which clients appear in which year: a catalogue that grows with the data."""
    return (
        table(spark, folder, "orders")
        .groupBy(F.year("o_orderdate").alias("ano"), "o_custkey")
        .agg(F.min("o_orderkey").alias("posicao"))
        .select("ano", F.concat(F.lit("CO_"), F.col("o_custkey")).alias("coluna"), "posicao")
    )


def documents_with_labels(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    labelled = p.enrich_edition(documents, [table(spark, folder, "labels")], "doc_id")
    return labelled.withColumnsRenamed({"quality": "IN_QUALITY", "toxic": "IN_TOXIC"})


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as units with their areas: nation as state, customer as town."""
    customers = table(spark, folder, "customer").join(
        table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return (
        table(spark, folder, "orders")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.year("o_orderdate").alias("NU_ANO_CENSO"),
            F.col("o_orderkey").alias("CO_ENTIDADE"),
            F.col("c_nationkey").alias("CO_UF"),
            F.col("n_name").alias("NO_UF"),
            F.col("n_name").alias("SG_UF"),
            F.col("n_regionkey").alias("CO_REGIAO"),
            F.col("o_custkey").alias("CO_MUNICIPIO"),
            F.col("c_name").alias("NO_MUNICIPIO"),
            F.round(F.col("o_totalprice") * 100).cast("bigint").alias("QT_VALOR"),
            F.expr("CASE WHEN o_orderpriority = '5-LOW' THEN NULL "
                   "WHEN o_orderpriority < '3' THEN 1 ELSE 0 END").alias("IN_ALTA"),
            F.substring("o_orderpriority", 1, 1).cast("tinyint").alias("TP_PRIORIDADE"),
            F.when(F.col("o_orderstatus") == "P", 2).otherwise(1).cast("tinyint")
            .alias("TP_SITUACAO_FUNCIONAMENTO"),
        )
    )


def long_features(features: DataFrame, *keys: str) -> DataFrame:
    """Polygons with their maps as rows, one per area and year."""
    return features.select(
        *keys, "codarea", "nome", "escolas", F.explode_outer("valores").alias("ano", "valor")
    ).select(
        *keys,
        "codarea",
        "nome",
        F.col("ano").cast("int").alias("ano"),
        F.round("valor", 2).alias("valor"),
        F.coalesce(F.try_element_at("escolas", "ano"), F.lit(0)).alias("escolas"),
    )


# -- reports -------------------------------------------------------------------


def count_by_share(spark, folder):
    counts = p.count_by(table(spark, folder, "orders"), "o_orderpriority", share=True)
    return counts.withColumn("pct", F.round("pct", 6))


def count_by(spark, folder):
    return p.count_by(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"])


def sum_by(spark, folder):
    money = [F.col(c).cast("decimal(18,2)").alias(f"QT_MAT_{c[2:5].upper()}")
             for c in ("l_quantity", "l_extendedprice", "l_discount")]
    rows = table(spark, folder, "lineitem").select("l_returnflag", "l_linestatus", *money)
    sums = p.sum_by(rows, ["l_returnflag", "l_linestatus"])
    return sums.select("l_returnflag", "l_linestatus", *[
        F.col(c).cast("double").alias(c.lower()) for c in sums.columns[2:]
    ])


def rate_national(spark, folder):
    return p.rate(documents_with_labels(spark, folder)).withColumn("taxa", F.round("taxa", 6))


def rate_by(spark, folder):
    rates = p.rate_by(documents_with_labels(spark, folder), "lang")
    return rates.select("lang", *[
        F.round(c, 6).alias(c.lower()) for c in ("IN_QUALITY", "IN_TOXIC")
    ])


def overview_by_uf(spark, folder):
    customers = table(spark, folder, "customer").select(
        F.col("c_nationkey").alias("SG_UF"),
        F.col("c_acctbal").cast("decimal(18,2)").alias("QT_MAT_BAS"),
        F.col("c_custkey").alias("QT_DOC_BAS"),
    )
    regions = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    ).select(F.col("n_nationkey").alias("SG_UF"), F.col("r_name").alias("NO_REGIAO"))
    return p.overview_by_uf(customers, regions=regions).select(
        F.col("SG_UF").alias("uf"),
        "regiao",
        "escolas",
        F.col("matriculas").cast("double").alias("matriculas"),
        "docentes",
        F.round(F.col("matriculas_por_escola").cast("double"), 4).alias("matriculas_por_escola"),
    )


def orders_with_codes(spark, folder):
    return table(spark, folder, "orders").select(
        F.year("o_orderdate").alias("ano"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("TP_PRIORIDADE"),
    )


def distribution_by(spark, folder):
    labels = {"TP_PRIORIDADE": {k: v for k, v in PRIORITY.items() if k != 5}}
    table_ = p.distribution(
        orders_with_codes(spark, folder), "TP_PRIORIDADE", "ano", labels,
        list(labels["TP_PRIORIDADE"].values()),
    )
    return table_.select("ano", *[
        F.round(F.col(c), 6).alias(c.lower().replace(" ", "_")) for c in table_.columns[1:]
    ])


def distribution_overall(spark, folder):
    out = p.distribution(
        orders_with_codes(spark, folder), "TP_PRIORIDADE", labels={"TP_PRIORIDADE": PRIORITY}
    )
    return out.select(
        F.col("DS_PRIORIDADE").alias("rotulo"), "escolas", F.round("pct", 6).alias("pct")
    )


def time_series_by(spark, folder):
    series = p.time_series(panel(spark, folder), "QT_VALOR", "CO_REGIAO")
    return series.select(
        F.col("NU_ANO_CENSO").alias("ano"), F.col("CO_REGIAO").alias("regiao"),
        F.col("QT_VALOR").alias("valor"),
    )


def top_areas(spark, folder):
    rows = panel(spark, folder).select(
        "CO_MUNICIPIO", "NO_MUNICIPIO", F.col("NO_UF").alias("SG_UF"), "QT_VALOR"
    )
    return p.top_areas(rows, 15, "QT_VALOR").select(
        F.col("SG_UF").alias("uf"), F.col("CO_MUNICIPIO").alias("codigo"),
        F.col("NO_MUNICIPIO").alias("nome"), "escolas", "total",
    )


def label_codes(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        F.substring("o_orderpriority", 1, 1).cast("int").alias("TP_DEPENDENCIA"),
    )
    return p.label(orders).select(
        "o_orderkey",
        F.col("TP_DEPENDENCIA").alias("codigo"),
        F.col("DS_DEPENDENCIA").alias("rotulo"),
    )


def add_region(spark, folder):
    dimension = table(spark, folder, "nation").join(
        table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    return p.add_region(customers, "c_nationkey", dimension, "n_nationkey", "r_name").select(
        "c_custkey", F.col("NO_REGIAO").alias("regiao")
    )


def enrich_edition(spark, folder):
    return documents_with_labels(spark, folder).select(
        "doc_id", "lang", F.col("IN_QUALITY").alias("quality"), F.col("IN_TOXIC").alias("toxic")
    )


# -- catalogue -----------------------------------------------------------------


def presence_matrix(spark, folder):
    matrix = p.presence_matrix(client_catalog(spark, folder), list(YEARS))
    return matrix.select("coluna", *[F.col(str(y)).alias(f"a{y}") for y in YEARS])


def presence_summary(spark, folder):
    return p.presence_summary(client_catalog(spark, folder), list(YEARS))


def common_columns(spark, folder):
    return p.common_columns(client_catalog(spark, folder), list(YEARS))


def columns_per_edition(spark, folder):
    return p.columns_per_edition(client_catalog(spark, folder))


def audit_gaps(spark, folder):
    return p.audit_gaps(presence_summary(spark, folder)).select("coluna", "anos_ausentes")


def audit_missing_only_in(spark, folder):
    return p.audit_missing_only_in(presence_summary(spark, folder), 2001).select("coluna", "n_anos")


def year_fitness(spark, folder):
    return p.year_fitness(client_catalog(spark, folder), "CO_1", "CO_2").select(
        "ano", "serve", F.array_join("faltam", ", ").alias("faltam")
    )


# -- profile and dictionary ----------------------------------------------------


def shown_profile(profiles: DataFrame) -> DataFrame:
    return profiles.withColumn("pct_nulo", F.round("pct_nulo", 6)).withColumns({
        c: F.col(c).cast("bigint") for c in ("n_linhas", "n_distintos", "largura_max")
    })


def profile_orders(spark, folder):
    return shown_profile(p.profile(table(spark, folder, "orders"), ano=2023))


def profile_customer(spark, folder):
    return shown_profile(p.profile(table(spark, folder, "customer"), ano=2023))


def profile_lineitem(spark, folder):
    return shown_profile(p.profile(table(spark, folder, "lineitem"), ano=2023))


def profile_documents(spark, folder):
    return shown_profile(p.profile(table(spark, folder, "documents"), ano=2023))


def profile_editions(spark, folder):
    return shown_profile(p.profile_editions(editions(spark, folder)))


def types_by_year(spark, folder):
    out = p.types_by_year(p.profile_editions(editions(spark, folder)), list(YEARS))
    return out.select("coluna", *[F.col(str(y)).alias(f"t{y}") for y in YEARS])


def promote_types(spark, folder):
    return p.promoted_types(p.profile_editions(editions(spark, folder)))


def audit_conflicts(spark, folder):
    return p.audit_conflicts(p.profile_editions(editions(spark, folder))).select(
        "ano", "coluna", "dtype_dados", "dtype_prefixo"
    )


def audit_wide_prefixes(spark, folder):
    return p.audit_wide_prefixes(p.profile_editions(editions(spark, folder))).select(
        "ano", "coluna", "dtype_dados", "dtype_prefixo"
    )


def order_descriptions(spark, folder):
    """Descriptions of clients per year, several per year, newest ones to be chosen."""
    return table(spark, folder, "orders").select(
        F.concat(F.lit("CO_"), F.col("o_custkey")).alias("coluna"),
        F.year("o_orderdate").alias("ano"),
        F.col("o_orderkey").cast("int").alias("row_idx"),
        F.col("o_orderpriority").alias("descricao"),
        F.col("o_orderstatus").alias("tipo_inep"),
        F.col("o_orderkey").cast("string").alias("tamanho_inep"),
        F.lit("").alias("categorias"),
    )


def latest_descriptions(spark, folder):
    return p.latest_descriptions(order_descriptions(spark, folder))


def normalize_dictionary(spark, folder):
    """One sheet per brand, its header displaced by a title and a blank row."""
    parts = table(spark, folder, "part").withColumn("ano", F.lit(2023))
    rows = parts.select(
        "ano",
        F.col("p_brand").alias("sheet"),
        (F.col("p_partkey") + 3).cast("int").alias("row_idx"),
        F.array(
            F.col("p_partkey").cast("string"),
            F.concat(F.lit(" "), F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))), F.lit("\t")),
            F.col("p_name"),
            F.col("p_type"),
            F.col("p_size").cast("string"),
            F.concat(F.col("p_size"), F.lit(" - x\n\n "), F.col("p_type")),
        ).alias("cells"),
    )
    titles = [
        (0, ["Dicionário"]),
        (1, []),
        (2, ["N", "Nome da Variável", "Descrição da Variável", "Tipo", "Tam.(1)", "Categoria"]),
    ]
    heads = parts.select("ano", F.col("p_brand").alias("sheet")).distinct().select(
        "ano",
        "sheet",
        F.inline(F.array(*[
            F.struct(F.lit(i).alias("row_idx"),
                     F.array(*map(F.lit, cells)).cast("array<string>").alias("cells"))
            for i, cells in titles
        ])),
    )
    return p.normalize_dictionary(heads.unionByName(rows))


def dictionary(spark, folder):
    out = p.data_dictionary(editions(spark, folder), common_only=False)
    return out.withColumn("pct_nulo_max", F.round("pct_nulo_max", 6)).withColumns({
        c: F.col(c).cast("bigint") for c in ("n_distintos", "largura_max", "n_anos")
    })


def series_schema(spark, folder):
    common = p.data_dictionary(editions(spark, folder))
    plan = p.series_schema(common)
    rows = editions(spark, folder)
    typed = p.stack_editions({y: df.select(*sorted(plan)) for y, df in rows.items()}, plan)
    return typed.groupBy("NU_ANO_CENSO").agg(
        F.count(F.lit(1)).alias("linhas"),
        F.sum(F.col("TP_PRIORIDADE").cast("bigint")).alias("prioridades"),
        F.max("CO_CLIENTE").alias("cliente"),
        F.max("CO_ENTIDADE").cast("bigint").alias("entidade"),
    )


def audit_unstable(spark, folder):
    return p.audit_unstable(p.data_dictionary(editions(spark, folder), common_only=False)).select(
        "coluna", "tipos_por_ano", "dtype_serie"
    )


def most_empty(spark, folder):
    out = p.most_empty(p.data_dictionary(editions(spark, folder), common_only=False), 3)
    return out.select("coluna", F.round("pct_nulo_max", 6).alias("pct_nulo_max"))


def prefix_types(spark, folder):
    """Every edition typed by its names and values, side by side."""
    out = None
    for text in editions(spark, folder).values():
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            typed, _ = p.apply_prefix_types(text)
        shown = typed.select(
            F.col("NU_ANO_CENSO").alias("ano"),
            F.col("CO_ENTIDADE").alias("entidade"),
            F.col("CO_CLIENTE").cast("string").alias("cliente"),
            F.col("TP_PRIORIDADE").cast("int").alias("prioridade"),
            *[F.col(c).cast("int").alias("urgente") for c in typed.columns if c == "IN_URGENTE"],
            *[F.round(c, 2).alias("valor") for c in typed.columns if c == "QT_VALOR"],
        )
        out = shown if out is None else out.unionByName(shown, allowMissingColumns=True)
    return out


def stack_editions(spark, folder):
    """Integer codes in some years, alphanumeric ones in others, one column missing."""
    orders = table(spark, folder, "orders")

    def edition(year: int) -> DataFrame:
        code = F.col("o_custkey") if year < 1998 else F.concat(F.lit("0MI"), F.col("o_custkey"))
        columns = [
            F.lit(year).alias("NU_ANO_CENSO"), F.col("o_orderkey").alias("CO_ENTIDADE"),
            code.alias("CO_CLIENTE"),
        ]
        if year < 2000:
            columns.append(F.col("o_totalprice").alias("QT_VALOR"))
        return slice_of(orders, year).select(*columns)

    return p.stack_editions({year: edition(year) for year in YEARS}).select(
        F.col("NU_ANO_CENSO").alias("ano"), F.col("CO_ENTIDADE").alias("entidade"),
        F.col("CO_CLIENTE").alias("cliente"), F.col("QT_VALOR").alias("valor"),
    )


def load_edition(spark, folder):
    rows = p.load_edition(
        panel(spark, folder), ["CO_ENTIDADE", "SG_UF", "QT_VALOR", "TP_SITUACAO_FUNCIONAMENTO"],
        uf=["NATION_3", "NATION_7"],
    )
    return rows.select(
        F.col("CO_ENTIDADE").alias("entidade"), F.col("SG_UF").alias("uf"),
        F.col("QT_VALOR").alias("valor"),
    )


def upsert_by_key(spark, folder):
    """Customers updated by the suppliers of the same number."""
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("chave"), F.col("c_name").alias("nome"),
        F.col("c_acctbal").alias("saldo"),
    )
    suppliers = table(spark, folder, "supplier").select(
        (F.col("s_suppkey") * 2).alias("chave"), F.col("s_name").alias("nome"),
        F.col("s_acctbal").alias("saldo"),
    )
    return p.upsert_by_key(customers, suppliers, "chave", newest="nome")


def discover_editions(spark, folder):
    """A listing with one file per order, of several entities per year."""
    listing = table(spark, folder, "orders").select(
        F.expr(
            "concat('/interim/pacote_', year(o_orderdate), '/dados/', "
            "CASE o_orderstatus WHEN 'P' THEN concat('microdados_ed_basica_', "
            "year(o_orderdate), '.csv') WHEN 'O' THEN concat('Tabela_Gestor_Escolar_', "
            "year(o_orderdate), '_v2.csv') ELSE concat('tabela_escola_', year(o_orderdate), "
            "'_V2.csv') END)"
        ).alias("path"),
        F.col("o_orderkey").alias("length"),
    )
    return p.discover_editions(listing)


# -- samples -------------------------------------------------------------------


def sample_head(spark, folder):
    parts = table(spark, folder, "part")
    return p.sample_head(
        parts, 25, ["p_partkey", "p_name"], equals={"p_type": "economy"},
        contains={"p_name": "RED"}, order_by="p_partkey",
    )


def where_equals(spark, folder):
    rows = table(spark, folder, "customer").withColumn(
        "c_mktsegment", F.concat(F.lit("\t "), F.initcap("c_mktsegment"), F.lit(" "))
    )
    return p.where_equals(rows, {"c_mktsegment": "building"}).select("c_custkey", "c_name")


def where_contains(spark, folder):
    return p.where_contains(table(spark, folder, "documents"), {"text": "ING THE"}).select(
        "doc_id", "n_chars"
    )


def numbers_where_lossless(spark, folder):
    text = table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("inteiro"),
        F.replace(F.col("o_totalprice").cast("string"), F.lit("."), F.lit(",")).alias("decimal"),
        F.lpad(F.col("o_custkey").cast("string"), 9, "0").alias("codigo"),
        F.col("o_orderpriority").alias("texto"),
    )
    return p.numbers_where_lossless(text)


# -- sources and sinks -----------------------------------------------------------


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the session's executors share."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.conf.get("spark.master").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="panelry-")
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


RECORD_COLUMNS = ["CO_ENTIDADE", "NO_TEXTO", "TP_PRIORIDADE", "QT_VALOR"]


def order_lines(spark, folder):
    """Orders as lines of an edition: no-value tokens in turn, quoted signs, lines cut short."""
    orders = table(spark, folder, "orders")
    tokens = F.array(*map(F.lit, fixed.NA_TOKENS))
    token = F.get(tokens, F.pmod(F.col("o_custkey"), F.lit(len(fixed.NA_TOKENS))).cast("int"))
    texts = [
        F.col("o_orderkey").cast("string"),
        F.concat(F.lit('a;"'), F.col("o_orderpriority"), F.lit('" é')),
        F.when(F.col("o_orderpriority") == "5-LOW", token).otherwise(F.substring("o_orderpriority", 1, 1)),
        F.col("o_custkey").cast("string"),
    ]
    whole = p.to_record([c.alias(f"c{i}") for i, c in enumerate(texts)])
    short = p.to_record([c.alias(f"c{i}") for i, c in enumerate(texts[:3])])
    return orders.select(
        F.year("o_orderdate").alias("ano"), F.when(F.col("o_orderstatus") == "P", short).otherwise(whole).alias("value")
    )


def text_scan(spark, folder):
    return p.parse_records(order_lines(spark, folder), ";".join(RECORD_COLUMNS)).select(
        "ano", F.col("CO_ENTIDADE").alias("entidade"), F.col("NO_TEXTO").alias("texto"),
        F.col("TP_PRIORIDADE").alias("prioridade"), F.col("QT_VALOR").alias("valor"),
        F.col("linha_ruim").isNotNull().alias("ruim"),
    )


def mesh_scan(spark, folder):
    """A collection per brand of parts, as one text each, and one per region of nations."""
    def collections(rows, mesh, code):
        shape = F.expr("array(array(array(0, n), array(n, 1), array(0, n)))")
        feature = F.to_json(F.struct(
            F.lit("Feature").alias("type"), F.struct(F.col("n").cast("string").alias("codarea")).alias("properties"),
            F.struct(F.lit("Polygon").alias("type"), shape.alias("coordinates")).alias("geometry")))
        features = rows.select(F.col(mesh).cast("string").alias("malha"), F.col(code).cast("bigint").alias("n"))
        listed = features.groupBy("malha").agg(F.array_sort(F.collect_list(F.struct("n", feature.alias("f")))).alias("l"))
        text = F.array_join(F.col("l.f"), ",")
        return listed.select("malha", F.concat(
            F.lit('{"type":"FeatureCollection","features":['), text, F.lit("]}")).alias("conteudo"))

    nations = collections(table(spark, folder, "nation"), "n_regionkey", "n_nationkey")
    parts = collections(table(spark, folder, "part"), "p_brand", "p_partkey")
    return p.parse_meshes(nations.unionByName(parts))


def sample_file(spark, folder):
    """The first matching parts in file order, written as a sample and read back."""
    parts = table(spark, folder, "part")
    found = p.sample_scan(parts, 25, ["p_partkey", "p_name", "p_type"], {"p_type": "economy"}, {"p_name": "RED"})
    path = scratch(spark, "sample")
    p.write_sample(found.rows, path)
    return p.read_edition_text(spark, path, encoding="UTF-8").withColumn("linha", F.monotonically_increasing_id())


def dictionary_file(spark, folder):
    """The dictionary written as text and read back with its types."""
    path = scratch(spark, "dictionary")
    p.write_dictionary(p.data_dictionary(editions(spark, folder), common_only=False), path)
    out = p.read_dictionary(spark, path)
    return out.withColumns({c: F.col(c).cast("bigint") for c in ("n_distintos", "largura_max", "n_anos")}).select(
        "coluna", "dtype_serie", "tipo_estavel", "comum", "n_anos", "n_distintos", "largura_max",
        F.round("minimo", 2).alias("minimo"), F.round("maximo", 2).alias("maximo"), "anos_presentes", "zeros_a_esquerda",
    )


def editions_copy(spark, folder):
    """A copy by year, one year of it replaced, two years read back."""
    rows = panel(spark, folder).select("NU_ANO_CENSO", "CO_ENTIDADE", "CO_UF", "QT_VALOR")
    path = scratch(spark, "editions")
    p.write_editions(rows, path)
    p.write_editions(rows.filter(F.col("NU_ANO_CENSO") == 1998).withColumn("QT_VALOR", -F.col("QT_VALOR")), path)
    return p.read_editions(spark, path, [1997, 1998], ["CO_ENTIDADE", "QT_VALOR", "NU_ANO_CENSO"]).select(
        F.col("NU_ANO_CENSO").alias("ano"), F.col("CO_ENTIDADE").alias("entidade"), F.col("QT_VALOR").alias("valor"))


def geojson_features(spark, folder):
    """Polygons written as GeoJSON lines, read back and taken apart as any reader would."""
    features, _ = p.join_mesh(client_mesh(spark, folder), client_areas(spark, folder))
    path = scratch(spark, "geojson")
    p.write_geojson_features(features, path)
    schema = ("type string, properties struct<codarea string, nome string, valores map<string, double>, "
              "escolas map<string, bigint>>, geometry string")
    read = spark.read.text(path).select(F.from_json("value", schema).alias("f"))
    shown = read.filter(F.col("f.type") == "Feature").select(
        "f.properties.codarea", "f.properties.nome", F.col("f.geometry").alias("forma"), "f.properties.escolas",
        F.explode_outer("f.properties.valores").alias("ano", "valor"))
    return shown.select("codarea", "nome", "forma", F.col("ano").cast("int").alias("ano"), "valor",
                        F.coalesce(F.try_element_at("escolas", "ano"), F.lit(0)).alias("escolas"))


def dominant_category(spark, folder):
    out = p.dominant_category(panel(spark, folder), "TP_PRIORIDADE", p.Cut.of("municipio"))
    return out.withColumns({c: F.round(c, 6) for c in ("pct", "margem")}).withColumn("categoria", F.col("categoria").cast("int"))


def audit_with_domain(spark, folder):
    """The dictionary beside descriptions of each year, those with listed categories."""
    rows = table(spark, folder, "orders").groupBy(F.year("o_orderdate").alias("ano")).agg(F.max("o_orderkey").alias("k"))
    texts = rows.select("ano", F.col("k").cast("int").alias("row_idx"), F.explode(F.array(*map(F.lit, [
        "IN_URGENTE", "TP_PRIORIDADE", "CO_CLIENTE", "NO_NADA"]))).alias("coluna"), "k").select(
        "coluna", "ano", "row_idx", F.concat(F.lit("d "), "coluna", F.lit(" "), "k").alias("descricao"),
        F.lit("Num").alias("tipo_inep"), F.col("k").cast("string").alias("tamanho_inep"),
        F.when(F.col("coluna").startswith("CO_"), "").otherwise(F.concat(F.lit("1 - x | 2 - "), "ano")).alias("categorias"))
    described = p.data_dictionary(editions(spark, folder), common_only=False, descriptions=texts)
    return p.audit_with_domain(described).select("coluna", "descricao", "tipo_inep", "tamanho_inep", "categorias", "dtype_serie")


def stack_decimals(spark, folder):
    """Decimal columns of growing width; the stack holds them all exactly."""
    orders = table(spark, folder, "orders")

    def edition(year: int) -> DataFrame:
        kind = "decimal(9,2)" if year < 1997 else "decimal(12,2)" if year < 1999 else "decimal(18,4)"
        return slice_of(orders, year).select(
            F.lit(year).alias("NU_ANO_CENSO"), F.col("o_orderkey").alias("CO_ENTIDADE"),
            F.col("o_totalprice").cast(kind).alias("QT_VALOR"))

    stacked = p.stack_editions({year: edition(year) for year in YEARS})
    return stacked.select(
        F.col("NU_ANO_CENSO").alias("ano"), F.col("CO_ENTIDADE").alias("entidade"),
        F.col("QT_VALOR").cast("string").alias("valor"), F.lit(dict(stacked.dtypes)["QT_VALOR"]).alias("tipo"))


def upsert_repeated(spark, folder):
    """Updates that repeat their keys: one row per key stays, the newest."""
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("chave"), F.col("c_name").alias("nome"), F.lit(0).cast("bigint").alias("versao"))
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("chave"), F.col("o_orderpriority").alias("nome"), F.col("o_orderkey").alias("versao"))
    return p.upsert_by_key(customers, orders, "chave", newest="versao")


# -- areas and maps ------------------------------------------------------------


def area_sum(spark, folder):
    """All the towns of one state."""
    cut = p.Cut.of("municipio", "estados", 11)
    return p.area_aggregate(panel(spark, folder), "QT_VALOR", cut)


def area_rate(spark, folder):
    rows = p.area_aggregate(panel(spark, folder), "IN_ALTA", p.Cut.of("uf"))
    return rows.withColumn("valor", F.round("valor", 6))


def area_category(spark, folder):
    rows = p.area_aggregate(
        panel(spark, folder), "TP_PRIORIDADE", p.Cut.of("uf"), [1996, 1999], category=2
    )
    return rows.withColumn("valor", F.round("valor", 6))


def client_areas(spark, folder):
    """Every client as an area, with its yearly sum."""
    return p.area_aggregate(panel(spark, folder), "QT_VALOR", p.Cut.of("municipio"), check=False)


def client_mesh(spark, folder):
    """Polygons of the clients outside one segment, and of suppliers nobody ordered as."""
    clients = table(spark, folder, "customer").filter(F.col("c_mktsegment") != "BUILDING")
    others = table(spark, folder, "supplier")
    shape = '{"type":"Point","coordinates":[0,%s]}'
    return clients.select(
        F.col("c_custkey").cast("string").alias("codarea"),
        F.format_string(shape, F.col("c_nationkey").cast("string")).alias("geometry"),
    ).unionAll(others.select(
        F.concat(F.lit("S"), F.col("s_suppkey")),
        F.format_string(shape, F.col("s_nationkey").cast("string")),
    ))


def mesh_join(spark, folder):
    features, _ = p.join_mesh(client_mesh(spark, folder), client_areas(spark, folder))
    return long_features(features)


def mesh_coverage(spark, folder):
    coverage = p.mesh_coverage(client_mesh(spark, folder), client_areas(spark, folder))
    return coverage.withColumn("codigos_sem_poligono", F.array_join("codigos_sem_poligono", ", "))


def quantile_breaks(spark, folder):
    breaks = p.quantile_breaks(client_areas(spark, folder))
    return breaks.select("ano", F.posexplode("cortes").alias("i", "corte"))


def quantile_classes(spark, folder):
    classes = p.quantile_classes(client_areas(spark, folder))
    return classes.select("ano", "codarea", "valor", "classe")


def class_ranges(spark, folder):
    areas = client_areas(spark, folder).withColumn("valor", F.col("valor").cast("double"))
    return p.class_ranges(p.quantile_breaks(areas))


def query_lines(spark, folder):
    """Saved queries: one per customer, and page addresses that are no meshes."""
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"),
        F.concat(
            F.lit(f"qt_x '{MESH}/estados/"), F.col("c_nationkey"),
            F.lit("?intrarregiao=Municipio&qualidade=minima' 2023 2019 \"TITULO=Um "),
            F.col("c_mktsegment"), F.lit('" CATEGORIA='), F.col("c_custkey"),
        ).alias("linha"),
    )
    pages = table(spark, folder, "pages").select(
        (-F.col("page_id") - 1).alias("id"), F.concat(F.lit("IN_Y "), F.col("url")).alias("linha")
    )
    return customers.unionByName(pages)


def parse_cuts(spark, folder):
    cuts = p.parse_cuts(query_lines(spark, folder))
    return cuts.select(
        "id", "variavel", F.array_join(F.col("anos").cast("array<string>"), " ").alias("anos"),
        F.try_element_at("opcoes", F.lit("CATEGORIA")).alias("categoria"),
        F.try_element_at("opcoes", F.lit("TITULO")).alias("titulo"),
        "escopo", "codigo", "intrarregiao", "coluna", "coluna_filtro", "valor_filtro",
        F.col("erro").isNull().alias("valida"),
    )


def quoted_lines(spark, folder):
    """Lines with quotes in quotes, escapes, and some that never close."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"),
        F.expr(r"""concat('qt_', c_custkey, ' "http://h/a b"', CASE c_mktsegment
            WHEN 'BUILDING' THEN ' "TITULO=Um '
            WHEN 'MACHINERY' THEN ' TITULO=x \\'
            WHEN 'HOUSEHOLD' THEN ' TITULO=Um # "dois'
            ELSE concat(' 2001 1999 TITULO=a\\ b\'c "d"\'"e \\"', c_mktsegment, '\\" \\x" nota=', c_custkey) END)""").alias("linha"),
    )


def parse_lines(spark, folder):
    lines = p.parse_lines(quoted_lines(spark, folder))
    return lines.select(
        "id", "variavel", "url", F.array_join(F.col("anos").cast("array<string>"), " ").alias("anos"),
        F.try_element_at("opcoes", F.lit("TITULO")).alias("titulo"),
        F.try_element_at("opcoes", F.lit("NOTA")).alias("nota"), "erro",
    )


SEGMENT_PREFIX = {"BUILDING": "QT_", "AUTOMOBILE": "QT_", "MACHINERY": "TP_", "HOUSEHOLD": "TP_"}


def resolved_maps(spark, folder):
    """A saved query per client, and two for some, against headers that grow with the orders."""
    prefix = "CASE c_mktsegment " + " ".join(
        f"WHEN '{k}' THEN '{v}'" for k, v in SEGMENT_PREFIX.items()) + " ELSE 'NO_' END"
    customers = table(spark, folder, "customer")
    orders = table(spark, folder, "orders").select("o_custkey", F.year("o_orderdate").alias("ano"))
    headers = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        "ano", F.expr(f"concat({prefix}, c_custkey)").alias("coluna")
    ).distinct()
    areas = orders.select("ano").distinct().select(
        "ano", F.explode(F.expr("CASE WHEN ano = 1998 THEN array('CO_MUNICIPIO') ELSE array('CO_UF', 'CO_MUNICIPIO') END"))
        .alias("coluna"))
    ends = (
        f"CASE c_mktsegment WHEN 'BUILDING' THEN array('{MESH}/paises/BR?intrarregiao=UF') "
        f"WHEN 'AUTOMOBILE' THEN array('\\'{MESH}/estados/11?intrarregiao=municipio&qualidade=minima\\' 1997 1996') "
        f"WHEN 'MACHINERY' THEN array('{MESH}/paises/BR?intrarregiao=UF 1996') "
        f"WHEN 'HOUSEHOLD' THEN array('{MESH}/paises/BR?intrarregiao=municipio CATEGORIA=2', "
        f"'{MESH}/paises/BR?intrarregiao=municipio CATEGORIA=3') "
        f"ELSE array('{MESH}/paises/BR?intrarregiao=UF') END"
    )
    lines = customers.select(F.col("c_custkey").alias("id"), F.expr(prefix).alias("p"), F.explode(F.expr(ends)).alias("fim"))
    lines = lines.select("id", F.concat("p", "id", F.lit(" "), "fim").alias("linha"))
    return p.resolved_maps(headers.unionByName(areas), lines).select(
        "id", "variavel", "agregacao", "categoria",
        F.array_join(F.col("usados").cast("array<string>"), " ").alias("anos"), "slug", "erro",
    )


def slugs(spark, folder):
    parts = table(spark, folder, "part")
    return parts.select("p_partkey", p.slug("p_brand", "p_name", F.lit("Ação ạ ḁ ﬁ Ａ①")).alias("slug"))


def aggregation_for(spark, folder):
    """Which catalogue columns can be mapped, over a catalogue of every client."""
    prefixes = {"BUILDING": "QT_", "MACHINERY": "IN_", "HOUSEHOLD": "TP_"}
    prefix = F.lit("NO_")
    for segment, text in prefixes.items():
        prefix = F.when(F.col("c_mktsegment") == segment, text).otherwise(prefix)
    columns = table(spark, folder, "customer").select(
        "c_custkey", F.concat(prefix, F.col("c_custkey")).alias("coluna")
    )
    return columns.select("c_custkey", aggregation_of(F.col("coluna")).alias("agregacao"))


UF_MESH = f"{MESH}/paises/BR?intrarregiao=UF&formato=x"
TOWN_MESH = f"{MESH}/estados/11?intrarregiao=municipio&formato=x"
MAPS = [
    f"QT_VALOR '{UF_MESH}' 1996 1999",
    f"IN_ALTA '{UF_MESH}'",
    f"TP_PRIORIDADE '{UF_MESH}' 1998 CATEGORIA=2",
    f"QT_VALOR '{TOWN_MESH}' 1996 2000",
]


def map_inputs(spark, folder):
    rows = panel(spark, folder)
    catalog = p.edition_catalog({year: rows for year in YEARS})
    lines = spark.createDataFrame([(line,) for line in MAPS], "linha string")
    nations = table(spark, folder, "nation").filter(F.col("n_regionkey") != 2)
    meshes = nations.select(
        F.lit(UF_MESH).alias("malha"), F.col("n_nationkey").cast("string").alias("codarea"),
        F.lit("null").alias("geometry"),
    ).unionAll(table(spark, folder, "customer").select(
        F.lit(TOWN_MESH), F.col("c_custkey").cast("string"), F.lit("null")
    ))
    return rows, catalog, lines, meshes


def build_all_maps(spark, folder):
    features, _, _ = p.build_all_maps(*map_inputs(spark, folder))
    return long_features(features, "slug")


def all_maps_coverage(spark, folder):
    _, coverage, _ = p.build_all_maps(*map_inputs(spark, folder))
    return coverage.withColumn("codigos_sem_poligono", F.array_join("codigos_sem_poligono", ", "))


def build_map(spark, folder):
    rows, catalog, _, meshes = map_inputs(spark, folder)
    mesh = meshes.filter(F.col("malha") == UF_MESH).drop("malha")
    result = p.build_map(rows, catalog, mesh, "TP_PRIORIDADE", p.Cut.of("uf"), [1997, 2001], 3)
    return long_features(result["features"])


QUERIES = (
    count_by_share, count_by, sum_by, rate_national, rate_by, overview_by_uf, distribution_by,
    distribution_overall, time_series_by, top_areas, label_codes, add_region, enrich_edition,
    presence_matrix, presence_summary, common_columns, columns_per_edition, audit_gaps,
    audit_missing_only_in, year_fitness, profile_orders, profile_customer, profile_lineitem,
    profile_documents, profile_editions, types_by_year, promote_types, audit_conflicts, audit_wide_prefixes,
    latest_descriptions, normalize_dictionary, dictionary, series_schema, audit_unstable,
    most_empty, prefix_types, stack_editions, load_edition, upsert_by_key, discover_editions,
    sample_head, where_equals, where_contains, numbers_where_lossless, area_sum, area_rate,
    area_category, mesh_join, mesh_coverage, quantile_breaks, quantile_classes, class_ranges,
    text_scan, mesh_scan, sample_file, dictionary_file, editions_copy, geojson_features, dominant_category,
    audit_with_domain, stack_decimals, upsert_repeated, parse_cuts, parse_lines, resolved_maps, slugs, aggregation_for, build_map, build_all_maps, all_maps_coverage,
)


def entry(spark: SparkSession) -> DataFrame:
    return overview_by_uf(spark, SMOKE)


try:
    from panelry.llm import queries as llm_queries
    from panelry.llm import statements as llm_statements
except ImportError:
    llm_queries = llm_statements = None


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    more = llm_queries.queries() if llm_queries else {}
    return {query.__name__: query for query in QUERIES} | more


def oracle_sql() -> dict[str, str]:
    from oracles import oracle_sql as statements

    return statements() | (llm_statements.oracle_sql() if llm_statements else {})
