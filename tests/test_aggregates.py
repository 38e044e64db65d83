import pytest

import panelry as p


def test_count_with_share(units):
    rows = p.count_by(units, "SG_UF", share=True).collect()
    assert [(r.SG_UF, r.escolas) for r in rows] == [("PE", 4), ("RS", 2), ("GO", 1)]
    assert sum(r.pct for r in rows) == pytest.approx(1)


def test_null_key_forms_no_group_and_no_share(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("b", 4)], "k string, v int")
    rows = p.count_by(df, "k", share=True).collect()
    assert [(r.k, r.escolas, round(r.pct, 4)) for r in rows] == [("a", 2, 0.6667), ("b", 1, 0.3333)]
    assert {r.k for r in p.sum_by(df, "k", ["v"]).collect()} == {"a", "b"}


def test_sum_keeps_null_where_the_overview_shows_zero(spark):
    df = spark.createDataFrame([("MG", None), ("SP", 5)], "SG_UF string, QT_MAT_BAS int")
    assert [tuple(r) for r in p.sum_by(df, "SG_UF").collect()] == [("MG", None), ("SP", 5)]
    assert {r.SG_UF: r.matriculas for r in p.overview_by_uf(df).collect()} == {"MG": 0, "SP": 5}


def test_sum_of_default_and_missing_columns(units):
    sums = {r.SG_UF: r.QT_MAT_BAS for r in p.sum_by(units, "SG_UF").collect()}
    assert sums["RS"] == 1630
    with pytest.raises(KeyError, match="QT_MAT_"):
        p.sum_by(units.drop("QT_MAT_BAS"), "SG_UF")


def test_rates_ignore_nulls(units):
    national = {r.indicador: r.taxa for r in p.rate(units).collect()}
    assert national == {"IN_INTERNET": pytest.approx(0.6), "IN_BIBLIOTECA": pytest.approx(0.8)}
    assert [r.indicador for r in p.rate(units).collect()] == ["IN_BIBLIOTECA", "IN_INTERNET"]
    grouped = {r.SG_UF: r.IN_INTERNET for r in p.rate_by(units, "SG_UF").collect()}
    assert grouped == {"PE": pytest.approx(2 / 3), "RS": 0.5, "GO": None}


def test_overview(units):
    rows = {r.SG_UF: r.asDict() for r in p.overview_by_uf(units).collect()}
    assert rows["PE"] == {
        "SG_UF": "PE", "escolas": 4, "matriculas": 1035, "docentes": 70, "regiao": "Nordeste",
        "matriculas_por_escola": 258.75,
    }
    assert "matriculas" not in p.overview_by_uf(units.drop("QT_MAT_BAS")).columns
    with pytest.raises(KeyError):
        p.overview_by_uf(units.drop("SG_UF"))


def test_overview_with_a_region_dimension(spark, units):
    regions = spark.createDataFrame([("PE", "x"), ("RS", "y")], "SG_UF string, NO_REGIAO string")
    rows = {r.SG_UF: r.regiao for r in p.overview_by_uf(units, regions=regions).collect()}
    assert rows == {"PE": "x", "RS": "y", "GO": None}


def test_distribution(units):
    overall = p.distribution(units).collect()
    assert {r.DS_DEPENDENCIA for r in overall} == {"Estadual", "Municipal", "Privada"}
    table = p.distribution(units, by="SG_UF")
    assert table.columns == ["SG_UF", "Estadual", "Municipal", "Privada"]
    assert {r.SG_UF: r.Municipal for r in table.collect()} == {
        "GO": 0.0, "PE": 0.5, "RS": 0.0,
    }


def test_distribution_drops_groups_without_labels(spark):
    df = spark.createDataFrame([("MG", 1), ("SP", 99), ("SP", None)], "SG_UF string, TP_DEPENDENCIA int")
    assert [tuple(r) for r in p.distribution(df, by="SG_UF").collect()] == [("MG", 1.0)]


def test_time_series(spark):
    df = spark.createDataFrame(
        [(2012, "PA", 7), (2012, "CE", 5), (2013, "PA", 9), (2013, "CE", None), (2018, "CE", None)],
        "NU_ANO_CENSO int, SG_UF string, QT_MAT_BAS int",
    )
    assert [tuple(r) for r in p.time_series(df).collect()] == [(2012, 12), (2013, 9), (2018, None)]
    split = {(r[0], r[1]): r[2] for r in p.time_series(df, by="SG_UF").collect()}
    assert len(split) == 5 and split[(2013, "PA")] == 9 and split[(2013, "CE")] is None


def test_top_areas(units):
    rows = p.top_areas(units, 2).collect()
    assert [(r.NO_MUNICIPIO, r.escolas, r.total) for r in rows] == [
        ("Porto Alegre", 2, 1630), ("Recife", 2, 685),
    ]


def test_labels_and_regions(spark, units):
    first = p.label(units).orderBy("CO_ENTIDADE").first()
    assert (first.DS_DEPENDENCIA, first.TP_DEPENDENCIA) == ("Estadual", 2)
    odd = spark.createDataFrame([(9,), (None,)], "TP_LOCALIZACAO int")
    assert [r.DS_LOCALIZACAO for r in p.label(odd).collect()] == [None, None]
    with pytest.raises(KeyError):
        p.label(units, "TP_NADA")
    with pytest.raises(KeyError):
        p.label(units, "CO_MUNICIPIO")
    regions = {r.SG_UF: r.NO_REGIAO for r in p.add_region(units).collect()}
    assert regions["GO"] == "Centro-Oeste"


def test_share_reuses_the_counts(units):
    df = p.count_by(units, "SG_UF", share=True)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "CartesianProduct" not in plan
