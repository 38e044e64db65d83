import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def units(spark):
    rows = [
        (2015, 101, "PE", 2611606, "Recife", 2, 1, 610, 41, 1, 1),
        (2015, 102, "PE", 2611606, "Recife", 3, 1, 75, 6, 0, 1),
        (2015, 103, "PE", 2604106, "Caruaru", 3, 2, 140, 9, None, 1),
        (2015, 104, "PE", 2604106, "Caruaru", 4, 1, 210, 14, 1, 0),
        (2015, 105, "RS", 4314902, "Porto Alegre", 2, 1, 1300, 88, 1, 1),
        (2015, 106, "RS", 4314902, "Porto Alegre", 4, 1, 330, 27, 0, None),
        (2015, 107, "GO", 5208707, "Goiânia", 4, 1, 95, 11, None, None),
    ]
    return spark.createDataFrame(
        rows,
        "NU_ANO_CENSO int, CO_ENTIDADE bigint, SG_UF string, CO_MUNICIPIO bigint, "
        "NO_MUNICIPIO string, TP_DEPENDENCIA tinyint, TP_LOCALIZACAO tinyint, QT_MAT_BAS int, "
        "QT_DOC_BAS int, IN_INTERNET tinyint, IN_BIBLIOTECA tinyint",
    )


# One column goes, one comes, one code turns to letters, one count outgrows its type.
_ALWAYS = "CO_ENTIDADE;NU_ANO_CENSO;IN_BIBLIOTECA;CO_ORGAO_REGIONAL;TP_DEPENDENCIA"
HEADERS = {
    2014: _ALWAYS + ";QT_MAT_BAS",
    2015: "QT_MAT_BAS;" + _ALWAYS,
    2016: "NO_ENTIDADE;" + _ALWAYS,
}
ROWS = {
    2014: ["52000231;2014;1;7;4;310", "52000202;2014;0;9;2;45", "52000303;2014;1;64;3;2999"],
    2015: ["70001;52000231;2015;1;5;3", "150;52000404;2015;;6;3", "88;52000303;2015;0;7;2"],
    2016: ["LICEU SÃO JOÃO;52000231;2016;0;07X;4", "COLÉGIO ÉDEN;52000505;2016;1;08Y;1"],
}


@pytest.fixture(scope="session")
def edition_root(tmp_path_factory):
    root = tmp_path_factory.mktemp("interim")
    for year, header in HEADERS.items():
        folder = root / f"microdados_{year}" / "dados"
        folder.mkdir(parents=True)
        text = "\n".join([header, *ROWS[year]]) + "\n"
        (folder / f"microdados_ed_basica_{year}.csv").write_text(text, encoding="latin-1")
    return root


@pytest.fixture(scope="session")
def editions(spark, edition_root):
    from panelry import discover_editions, list_files, open_editions

    return open_editions(spark, discover_editions(list_files(spark, str(edition_root))))


def rows_by(df, key):
    return {row[key]: row.asDict() for row in df.collect()}


@pytest.fixture(scope="session")
def by():
    return rows_by
