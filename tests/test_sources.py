import warnings

import pytest

import panelry as p
from panelry import fixed


@pytest.mark.parametrize(
    ("file", "matches"),
    [
        ("microdados_ed_basica_2017.csv", True),
        ("Tabela_Escola_2031_V4.csv", True),
        ("Escolas.csv", True),
        ("Tabela_Escola_2031.xlsx", False),
        ("Tabela_Turma_2031.csv", False),
        ("Tabela_Docente_2032_V3.csv", False),
        ("microdados_superior_2018.csv", False),
        ("leia_me.csv", False),
    ],
)
def test_file_names(spark, file, matches):
    listing = spark.createDataFrame([(f"/x/micro_2024/dados/{file}", 1)], "path string, length bigint")
    assert (p.discover_editions(listing).count() == 1) is matches


def test_largest_file_per_year(spark, edition_root):
    listing = spark.createDataFrame(
        [("/x/m_2016/ESCOLAS.CSV", 5), ("/x/m_2016/d/microdados_ed_basica_2016.csv", 9),
         ("/x/m_2024/outro.csv", 99), ("/x/Tabela_Escola_2025.csv", 1)],
        "path string, length bigint",
    )
    found = {r.ano: r.path for r in p.discover_editions(listing).collect()}
    assert found == {2016: "/x/m_2016/d/microdados_ed_basica_2016.csv", 2025: "/x/Tabela_Escola_2025.csv"}
    real = p.discover_editions(p.list_files(spark, str(edition_root)))
    assert sorted(r.ano for r in real.collect()) == [2014, 2015, 2016]


def test_text_scan_binds_by_name(editions):
    df = editions[2016].select("CO_ORGAO_REGIONAL", "NO_ENTIDADE").collect()
    assert [tuple(r) for r in df] == [("07X", "LICEU SÃO JOÃO"), ("08Y", "COLÉGIO ÉDEN")]
    assert editions[2015].collect()[1].IN_BIBLIOTECA is None


def test_text_scan_columns_and_tokens(spark, tmp_path):
    path = tmp_path / "e.csv"
    path.write_text('A;B;C\nNA;"x;y";null\n"";"say ""z""";0\n', encoding="latin-1")
    df = p.read_edition_text(spark, str(path), ["C", "B", "NOPE"])
    assert df.columns == ["C", "B"]
    assert [tuple(r) for r in df.collect()] == [(None, "x;y"), ("0", 'say "z"')]
    with pytest.raises(KeyError):
        p.read_edition_text(spark, str(path), ["NOPE"])


def test_tolerant_typing(spark):
    df = spark.createDataFrame(
        [("2611606", "07X", "88", "", "2016"), ("4314902", "00017", "7100", "0", "2016")],
        "CO_MUNICIPIO string, CO_X string, QT_MAT_BAS string, IN_INTERNET string, NU_ANO_CENSO string",
    )
    with pytest.warns(UserWarning, match="CO_X"):
        typed, textual = p.apply_prefix_types(df)
    assert textual == ["CO_X"]
    assert dict(typed.dtypes) == {
        "CO_MUNICIPIO": "bigint", "CO_X": "string", "QT_MAT_BAS": "int",
        "IN_INTERNET": "tinyint", "NU_ANO_CENSO": "int",
    }
    assert [tuple(r) for r in typed.collect()] == [
        (2611606, "07X", 88, None, 2016), (4314902, "00017", 7100, 0, 2016),
    ]


def test_values_widen_the_prefix(spark):
    df = spark.createDataFrame(
        [("300", "1.5", "00017", "007"), ("1", "2", "00023", "8")],
        "IN_X string, TP_Y string, CO_Z string, QT_W string",
    )
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        typed, textual = p.apply_prefix_types(df)
        eaten, _ = p.apply_prefix_types(df, keep_leading_zeros=False)
        by_profile, _ = p.apply_prefix_types(df, p.profile(df))
    assert dict(typed.dtypes) == {"IN_X": "smallint", "TP_Y": "double", "CO_Z": "string", "QT_W": "int"}
    assert [tuple(r) for r in typed.collect()] == [(300, 1.5, "00017", 7), (1, 2.0, "00023", 8)]
    assert dict(eaten.dtypes)["CO_Z"] == "bigint"
    assert dict(by_profile.dtypes)["QT_W"] == "string"


def test_columnar_copy(spark, editions, tmp_path):
    root = str(tmp_path / "copy")
    typed, _ = p.apply_prefix_types(editions[2016])
    assert not p.edition_exists(spark, root, 2016)
    p.write_edition(typed, root, 2016)
    p.write_edition(typed.limit(0), root, 2016)  # kept
    back = p.read_edition(spark, root, 2016)
    assert back.count() == 2 and dict(back.dtypes)[fixed.YEAR] == "int"
    p.write_edition(typed.limit(1), root, 2016, overwrite=True)
    assert p.read_edition(spark, root, 2016).count() == 1
    p.write_edition(p.apply_prefix_types(editions[2014])[0], root, 2014)
    assert p.read_edition(spark, root, 2016).count() == 1


def test_text_is_the_fallback_for_missing_columns(spark, editions, edition_root, tmp_path):
    root = str(tmp_path / "copy")
    csv = str(edition_root / "microdados_2016" / "dados" / "microdados_ed_basica_2016.csv")
    p.write_edition(editions[2016].select("CO_ENTIDADE", "NU_ANO_CENSO"), root, 2016)
    assert "NO_ENTIDADE" in p.open_edition(spark, root, 2016, csv, ["NO_ENTIDADE"]).columns
    assert "NO_ENTIDADE" not in p.open_edition(spark, root, 2016, csv, ["QT_NOPE"]).columns
    assert "NO_ENTIDADE" not in p.open_edition(spark, root, 2016, None, ["NO_ENTIDADE"]).columns


def test_load_edition(spark, units):
    df = units.selectExpr("*", "cast(1 + CO_ENTIDADE % 2 as tinyint) as TP_SITUACAO_FUNCIONAMENTO")
    loaded = p.load_edition(df)
    assert "IN_INTERNET" not in loaded.columns and "CO_UF" not in loaded.columns
    assert {r.CO_ENTIDADE for r in loaded.collect()} == {102, 104, 106}
    assert p.load_edition(df, ["CO_ENTIDADE"]).count() == 7
    assert p.load_edition(df, uf="PE", active_only=False).count() == 4
    assert p.load_edition(df, uf=["PE", "GO"]).count() == 2
    with pytest.raises(KeyError):
        p.load_edition(df, ["CO_ENTIDADE"], uf="PE")
    with pytest.raises(KeyError):
        p.load_edition(df, ["NOPE"])
    with pytest.raises(KeyError):
        p.load_edition(df, ["CO_ENTIDADE"], strict=True)


def test_stack_promotes_before_the_union(spark):
    one = spark.createDataFrame([(2014, 23, 640)], "NU_ANO_CENSO int, CO_X bigint, QT_Y int")
    two = spark.createDataFrame([("2016", "07X", "a")], "NU_ANO_CENSO string, CO_X string, NO_Z string")
    panel = p.stack_editions({2016: two, 2014: one})
    assert panel.dtypes == [
        ("NU_ANO_CENSO", "int"), ("CO_X", "string"), ("QT_Y", "int"), ("NO_Z", "string"),
    ]
    assert {tuple(r) for r in panel.collect()} == {
        (2014, "23", 640, None), (2016, "07X", None, "a"),
    }


def test_stack_text_editions_by_dictionary(spark, editions, tmp_path):
    dictionary = p.data_dictionary(editions, common_only=False)
    panel = p.stack_editions(editions, dictionary)
    types = dict(panel.dtypes)
    assert (types["CO_ORGAO_REGIONAL"], types["QT_MAT_BAS"], types["NU_ANO_CENSO"]) == (
        "string", "int", "int",
    )
    rows = panel.filter("NU_ANO_CENSO = 2016").collect()
    assert {r.CO_ORGAO_REGIONAL for r in rows} == {"07X", "08Y"}
    assert {r.QT_MAT_BAS for r in rows} == {None}
    series = [tuple(r) for r in p.time_series(panel).collect()]
    assert series == [(2014, 3354), (2015, 70239), (2016, None)]
    saved, common = p.prepare_panel(editions, str(tmp_path / "dic"))
    assert "QT_MAT_BAS" not in common.columns and common.count() == 8
    assert saved.count() == len(common.columns)


def test_load_panel(spark, units):
    panel = p.load_panel({2016: units, 2024: units.drop("QT_DOC_BAS")}, uf="RS")
    assert panel.count() == 4 and "QT_DOC_BAS" not in p.load_edition(units.drop("QT_DOC_BAS")).columns


def test_enrich(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "CO_ENTIDADE int, x string")
    mat = spark.createDataFrame([(1, 10, "z"), (None, 5, "z")], "CO_ENTIDADE int, QT_MAT int, x string")
    doc = spark.createDataFrame([(2, 3)], "CO_ENTIDADE int, QT_DOC int")
    out = p.enrich_edition(base, [mat, doc])
    assert out.columns == ["CO_ENTIDADE", "x", "QT_MAT", "QT_DOC"]
    assert {tuple(r) for r in out.collect()} == {
        (1, "a", 10, None), (2, "b", None, 3), (None, "c", None, None),
    }
    with pytest.raises(Exception, match="repeated key"):
        p.enrich_edition(base, [mat.union(mat)]).collect()


def test_upsert(spark):
    old = spark.createDataFrame([("v", "u", 1), ("w", None, 2)], "variavel string, url string, n int")
    new = spark.createDataFrame(
        [("v", "u", 3), ("w", None, 4), ("k", "u", 5), ("k", "u", 6)],
        "variavel string, url string, n int",
    )
    out = p.upsert_by_key(old, new, ["variavel", "url"], newest="n")
    assert sorted(r.n for r in out.collect()) == [3, 4, 6]


MESH = (
    '{"type":"%s","features":['
    '{"type":"Feature","properties":{"codarea":"R7"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0]]]}},'
    '{"type":"Feature","properties":{},"geometry":{"type":"MultiPolygon","coordinates":[[[[0.5,-1]]]]}}]}'
)


def test_mesh_scan_and_geojson(spark, tmp_path):
    import json

    path = tmp_path / "m.json"
    path.write_text(MESH % "FeatureCollection")
    mesh = p.read_mesh(spark, str(path))
    assert [(r.posicao, r.codarea) for r in mesh.collect()] == [(0, "R7"), (1, "")]
    areas = spark.createDataFrame(
        [(2016, "R7", 'São "P"', None, 3), (2024, "R7", "x", 1.234, 4)],
        "ano int, codarea string, nome string, valor double, escolas bigint",
    )
    features, _ = p.join_mesh(mesh, areas)
    p.write_geojson_features(features, str(tmp_path / "out"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    full = {f["properties"]["codarea"]: f for f in lines}
    assert full["R7"]["properties"]["valores"] == {"2016": None, "2024": 1.23}
    assert full["R7"]["properties"]["nome"] == 'São "P"'
    assert full[""]["geometry"]["type"] == "MultiPolygon" and full[""]["type"] == "Feature"
    wrong = tmp_path / "w.json"
    wrong.write_text(MESH % "Topology")
    with pytest.raises(Exception, match="FeatureCollection"):
        p.read_mesh(spark, str(wrong)).collect()


def test_sample_sink(spark, tmp_path):
    df = spark.createDataFrame([("a;b", "é")], "A string, B string")
    p.write_sample(df, str(tmp_path / "s"))
    assert tuple(spark.read.csv(str(tmp_path / "s"), sep=";", header=True).first()) == ("a;b", "é")
