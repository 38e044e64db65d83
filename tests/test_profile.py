import random

import pytest
from pyspark.sql import functions as F

import panelry as p
from panelry import fixed
from panelry.functions import types


def text(spark, header, *rows):
    return spark.createDataFrame(rows, ", ".join(f"{c} string" for c in header.split(",")))


def test_catalogue_and_presence(editions):
    catalog = p.edition_catalog(editions)
    matrix = {r.coluna: (r["2014"], r["2015"], r["2016"]) for r in p.presence_matrix(catalog).collect()}
    assert matrix["QT_MAT_BAS"] == (True, True, False)
    assert matrix["NO_ENTIDADE"] == (False, False, True)
    order = [r.coluna for r in p.presence_matrix(catalog).collect()]
    assert order == [*editions[2016].columns, "QT_MAT_BAS"]
    assert [tuple(r) for r in p.columns_per_edition(catalog).collect()] == [
        (2014, 6), (2015, 6), (2016, 6),
    ]
    common = [r.coluna for r in p.common_columns(catalog).collect()]
    assert common == [c for c in editions[2016].columns if c != "NO_ENTIDADE"]
    assert "QT_MAT_BAS" in {r.coluna for r in p.common_columns(catalog, [2014, 2015]).collect()}
    with pytest.raises(ValueError):
        p.presence_matrix(catalog, [])
    found = p.edition_catalog(editions, contains="mat").collect()
    assert {r.coluna for r in found} == {"QT_MAT_BAS"}


def test_hole_is_not_a_short_series(spark, by):
    one = text(spark, "CO_ENTIDADE,IN_X", ("1", "1"))
    two = one.select("CO_ENTIDADE")
    summary = by(p.presence_summary(p.edition_catalog({2014: one, 2015: two, 2016: one})), "coluna")
    hole = summary["IN_X"]
    assert (hole["n_anos"], hole["comum"], hole["continua"], hole["anos_ausentes"]) == (
        2, False, False, "2015",
    )
    assert summary["CO_ENTIDADE"]["continua"]
    # A year that is not compared is not a hole.
    short = p.presence_summary(p.edition_catalog({2014: one, 2016: one}))
    assert all(r.continua for r in short.collect())
    assert [r.coluna for r in p.audit_gaps(p.presence_summary(
        p.edition_catalog({2014: one, 2015: two, 2016: one}))).collect()] == ["IN_X"]


def test_narrowest_types(editions, by):
    first = by(p.profile(editions[2014], ano=2014), "coluna")
    assert first["TP_DEPENDENCIA"]["dtype_dados"] == "Int8"
    assert first["QT_MAT_BAS"]["dtype_dados"] == "Int16"
    assert first["CO_ENTIDADE"]["dtype_dados"] == "Int32"
    last = by(p.profile(editions[2016], ano=2016), "coluna")
    assert last["CO_ORGAO_REGIONAL"]["dtype_dados"] == "string"
    assert last["NO_ENTIDADE"]["exemplos"] == "COLÉGIO ÉDEN, LICEU SÃO JOÃO"


def test_profile_fields(spark, by):
    df = text(
        spark,
        "CO_UF,CO_NOVO,CO_ZERO,QT_NADA,IN_X,TP_Y,QT_BIG,NO_N,QT_E",
        ("31", "07X", "00017", None, "300", "1.5", "9223372036854775807", "12D", "1e3"),
        ("35", "08Y", "00023", "NA", "1", "2", "9223372036854775808", "é", " 7 "),
        ("35", "null", "7", "", "", "0.5", "3", "inf", "-2"),
    )
    got = by(p.profile(df, ano=2016), "coluna")
    assert list(got) == df.columns
    assert got["CO_UF"] == {
        "ano": 2016, "coluna": "CO_UF", "natureza": "código", "dtype_dados": "Int8",
        "dtype_prefixo": "Int64", "conflito": False, "n_linhas": 3, "pct_nulo": 0.0,
        "n_distintos": 2, "contagem_exata": True, "minimo": 31.0, "maximo": 35.0,
        "largura_max": 2, "zeros_a_esquerda": False, "exemplos": "31, 35",
    }
    assert got["CO_NOVO"]["conflito"] and got["CO_NOVO"]["pct_nulo"] == pytest.approx(1 / 3)
    assert got["CO_NOVO"]["minimo"] is None and not got["CO_NOVO"]["zeros_a_esquerda"]
    assert got["CO_ZERO"]["dtype_dados"] == "string" and got["CO_ZERO"]["zeros_a_esquerda"]
    assert got["QT_NADA"]["dtype_dados"] == fixed.EMPTY and got["QT_NADA"]["pct_nulo"] == 1.0
    assert not got["QT_NADA"]["conflito"]
    assert got["IN_X"]["dtype_dados"] == "Int16" and got["IN_X"]["conflito"]
    assert got["TP_Y"]["dtype_dados"] == "Float64" and not got["TP_Y"]["zeros_a_esquerda"]
    assert got["QT_BIG"]["dtype_dados"] == "string"
    assert got["NO_N"]["dtype_dados"] == "string" and got["NO_N"]["largura_max"] == 3
    assert got["QT_E"]["dtype_dados"] == "Int16" and got["QT_E"]["maximo"] == 1000.0
    assert [r.coluna for r in p.audit_wide_prefixes(p.profile(df)).collect()][0] == "CO_UF"


def test_empty_edition(spark, by):
    got = by(p.profile(text(spark, "CO_A,NO_B", ("1", "x")).limit(0)), "coluna")
    assert got["CO_A"]["dtype_dados"] == fixed.EMPTY
    assert (got["CO_A"]["n_linhas"], got["CO_A"]["pct_nulo"], got["CO_A"]["exemplos"]) == (0, 1.0, "")


def brute_force(values):
    """The specification, value by value."""
    known = [v for v in values if v not in fixed.NA_TOKENS and v is not None]
    distinct = sorted(set(known))
    import re

    numeric = all(re.match(types.NUMBER, v) for v in distinct)
    numbers = [float(v) for v in distinct] if numeric else []
    return {
        "n_linhas": len(values),
        "pct_nulo": (len(values) - len(known)) / len(values),
        "n_distintos": min(len(distinct), 200),
        "contagem_exata": len(distinct) <= 200,
        "minimo": min(numbers) if numbers else None,
        "maximo": max(numbers) if numbers else None,
        "largura_max": max(map(len, distinct), default=0),
        "exemplos": ", ".join(distinct[:5]),
        "zeros_a_esquerda": numeric
        and any(len(v) > 1 and v[0] == "0" and v[1] != "." for v in distinct),
    }


@pytest.mark.parametrize("partitions", [1, 7])
def test_folded_columns_match_brute_force(spark, by, partitions):
    """Many distinct values, a hot value, falling values, a late text."""
    rng = random.Random(7)
    n = 6_000
    columns = {
        "QT_DESC": [str(n - i + 10_000) for i in range(n)],
        "QT_HOT": ["5" if rng.random() < 0.4 else str(rng.randrange(10**6)) for _ in range(n)],
        "NO_TEXT": [f"{rng.choice('zyxab')}{rng.randrange(3000)}" for _ in range(n)],
        "CO_LATE": [str(i) if i < n - 1 else "07X" for i in range(n)],
        "QT_FEW": [rng.choice(["1", "2.5", "NA", ""]) for _ in range(n)],
        "CO_EDGE": [str(1000 + i % 200) for i in range(n)],
        "CO_OVER": [str(1000 + i % 201) for i in range(n)],
        "CO_ZERO": [str(i) if i != n - 1 else "007" for i in range(n)],
    }
    df = spark.createDataFrame(
        list(zip(*columns.values(), strict=True)), ", ".join(f"{c} string" for c in columns)
    ).repartition(partitions)
    got = by(p.profile(df), "coluna")
    for column, values in columns.items():
        expected = brute_force(values)
        assert {k: got[column][k] for k in expected} == expected, column
    assert got["CO_LATE"]["dtype_dados"] == "string"
    assert got["QT_FEW"]["dtype_dados"] == "Float64"
    assert got["CO_OVER"]["contagem_exata"] is False and got["CO_EDGE"]["contagem_exata"] is True


def test_profile_scans_its_source_once(spark, tmp_path):
    spark.range(5000).select(
        F.col("id").cast("string").alias("CO_A"), F.lit("x").alias("NO_B")
    ).write.parquet(str(tmp_path / "e"))
    df = p.profile(spark.read.parquet(str(tmp_path / "e")))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("== Initial Plan ==")]
    assert final.count("FileScan") == 1 and "ReusedExchange" in final
    assert "WindowGroupLimit" in final


def test_long_cells_stay_off_the_driver(spark, by):
    """20 000 texts of 80 KB, more than a driver takes at once; beginnings alike past the cut."""
    df = spark.range(0, 20_000, 1, 16).select(
        F.concat(F.repeat(F.lit("x"), 80_000), F.lpad(F.col("id").cast("string"), 5, "0")).alias("NO_A"),
        F.concat(F.lpad(F.col("id").cast("string"), 5, "0"), F.repeat(F.lit("y"), 100)).alias("NO_B"),
    )
    got = by(p.profile(df, ["NO_B"]), "coluna")["NO_B"]
    assert (got["n_distintos"], got["contagem_exata"], got["largura_max"]) == (200, False, 105)
    assert got["exemplos"].startswith("00000y") and got["n_linhas"] == 20_000
    long = by(p.profile(df.withColumn("NO_A", F.concat("NO_B", "NO_A")), ["NO_A"]), "coluna")["NO_A"]
    assert (long["n_distintos"], long["largura_max"], long["dtype_dados"]) == (200, 80_110, "string")


def test_column_constant_in_its_first_rows(spark, by):
    df = spark.range(0, 30_000, 1, 3).select(
        F.when(F.col("id") < 20_000, 7).otherwise(F.col("id")).cast("string").alias("CO_A"))
    got = by(p.profile(df), "coluna")["CO_A"]
    assert (got["n_distintos"], got["contagem_exata"], got["n_linhas"]) == (200, False, 30_000)
    assert (got["minimo"], got["maximo"], got["exemplos"]) == (
        7.0, 29_999.0, "20000, 20001, 20002, 20003, 20004")


def test_types_by_year_and_promotion(editions, by):
    profiles = p.profile_editions(editions)
    table = by(p.types_by_year(profiles), "coluna")
    assert table["CO_ORGAO_REGIONAL"] == {
        "coluna": "CO_ORGAO_REGIONAL", "2014": "Int8", "2015": "Int8", "2016": "string",
    }
    assert table["QT_MAT_BAS"]["2016"] is None
    promoted = {r.coluna: r.dtype_serie for r in p.promoted_types(profiles).collect()}
    assert promoted["QT_MAT_BAS"] == "Int32" and promoted["CO_ORGAO_REGIONAL"] == "string"


@pytest.mark.parametrize(
    ("names", "expected"),
    [
        (["Int8", "Int8"], "Int8"),
        (["Int8", "Int32"], "Int32"),
        (["Int32", "Float64"], "Float64"),
        (["Int64", "string"], "string"),
        (["vazio", "Int8"], "Int8"),
        (["vazio", "vazio"], "vazio"),
        ([None, "Int16"], "Int16"),
        (["Int8", "other"], "other"),
    ],
)
def test_promotion(spark, names, expected):
    df = spark.createDataFrame([(n,) for n in names], "t string")
    assert df.agg(types.promote(F.col("t")).alias("t")).first().t == expected
    assert types.promote_names(names) == expected


def test_kind_and_prefix(spark):
    df = spark.createDataFrame(
        [("IN_A",), ("CO_ORGAO_REGIONAL",), ("DT_X",), ("id",)], "c string"
    )
    rows = df.select(types.kind(F.col("c")), types.prefix_type(F.col("c"))).collect()
    assert [tuple(r) for r in rows] == [
        ("indicador (0/1)", "Int8"), ("código", "string"), ("data", ""), ("", ""),
    ]
