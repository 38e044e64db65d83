"""Samples, records, partitioned copies, meshes in texts, dominant categories, published maps."""

import json

import pytest
from pyspark.sql import functions as F

import panelry as p
from panelry import fixed


# -- samples ---------------------------------------------------------------------


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Five files of twenty lines, by name in another order than by size."""
    root = tmp_path_factory.mktemp("parts")
    for k in range(5):
        lines = ["CO_ENTIDADE;NO_ENTIDADE;SG_UF"] + [
            f"{100 * k + i};{'ESCOLA' if i % 5 else 'NÚCLEO'} {'x' * (5 - k)};{'AC' if k < 3 else 'ES'}" for i in range(20)]
        (root / f"part-{k}.csv").write_text("\n".join(lines) + "\n", encoding="latin-1")
    return p.read_edition_text(spark, str(root))


def test_a_common_sample_reads_the_first_file_only(parts):
    found = p.sample_scan(parts, 7)
    assert [r.CO_ENTIDADE for r in found.rows.collect()] == [str(i) for i in range(7)]
    assert len(found.files) == 1 and found.files[0].endswith("part-0.csv") and 7 <= found.scanned <= 20


def test_files_are_taken_in_order_until_there_are_enough(parts):
    found = p.sample_scan(parts, 10, ["CO_ENTIDADE"], contains={"NO_ENTIDADE": "núcleo"})
    assert [int(r.CO_ENTIDADE) for r in found.rows.collect()] == [100 * k + i for k in range(3) for i in (0, 5, 10, 15)][:10]
    assert len(found.files) == 3 and found.scanned == 60
    assert found.rows.columns == ["CO_ENTIDADE", "NO_ENTIDADE"]


def test_a_rare_sample_scans_everything(parts):
    found = p.sample_scan(parts, 100, equals={"SG_UF": "es"}, contains={"CO_ENTIDADE": "41"})
    assert [r.CO_ENTIDADE for r in found.rows.collect()] == [str(410 + i) for i in range(10)]
    assert len(found.files) == 5 and found.scanned == 100
    with pytest.raises(p.NoRows, match="100 rows scanned"):
        p.sample_scan(parts, 5, equals={"SG_UF": "ZZ"})


def test_a_written_sample_keeps_its_order(spark, parts, tmp_path):
    found = p.sample_scan(parts, 50, contains={"NO_ENTIDADE": "escola"})
    p.write_sample(found.rows, str(tmp_path / "s"))
    back = spark.read.csv(str(tmp_path / "s"), sep=";", header=True).collect()
    assert [tuple(r) for r in back] == [tuple(r) for r in found.rows.collect()] and len(back) == 50
    with pytest.raises(ValueError, match="at most 10"):
        p.write_sample(found.rows, str(tmp_path / "t"), most=10)


# -- records ---------------------------------------------------------------------


def test_records(spark):
    lines = ['1;"a;""b""";NA', "2;x", "3;y;z;w", '4;"two\nlines";', "", "5; pad ;N/A"]
    df = spark.createDataFrame(list(enumerate(lines)), "n int, value string")
    rows = p.parse_records(df, "CO_A;NO_B;TP_C").orderBy("n").collect()
    assert [tuple(r)[1:4] for r in rows][:2] == [("1", 'a;"b"', None), ("2", "x", None)]
    assert [r.linha_ruim for r in rows] == [None, "2;x", "3;y;z;w", None, None, None]
    assert rows[3].NO_B == "two\nlines" and rows[3].TP_C is None and rows[4].CO_A is None and rows[5].NO_B == " pad "
    some = p.parse_records(df, ["CO_A", "NO_B", "TP_C"], columns=["TP_C", "NOPE"])
    assert some.columns == ["n", "TP_C", "linha_ruim"]
    with pytest.raises(KeyError):
        p.parse_records(df, "CO_A", columns=["NOPE"])


def test_records_there_and_back(spark):
    rows = [("a;b", 'say "x"', None), ("line\nbreak", "é", "z")]
    df = spark.createDataFrame(rows, "A string, B string, C string")
    lines = df.select(p.to_record(["A", "B", "C"]).alias("value"))
    assert [tuple(r)[:3] for r in p.parse_records(lines, "A;B;C").collect()] == rows
    for token in fixed.NA_TOKENS:
        line = spark.createDataFrame([(f"{token};{token}x",)], "value string")
        assert tuple(p.parse_records(line, "A;B").first())[:2] == (None, f"{token}x" if f"{token}x" not in fixed.NA_TOKENS else None)


# -- copies by year --------------------------------------------------------------


def test_one_year_is_replaced_and_others_stay(spark, tmp_path):
    root = str(tmp_path / "copy")
    rows = spark.createDataFrame([(2001, 1, "a"), (2002, 2, "b"), (2003, 3, "c")], "NU_ANO_CENSO int, CO_X int, NO_X string")
    p.write_editions(rows, root)
    p.write_editions(rows.filter("NU_ANO_CENSO = 2002").withColumn("CO_X", F.lit(20)).withColumn("IN_NEW", F.lit(1)), root)
    back = p.read_editions(spark, root)
    assert sorted((r.NU_ANO_CENSO, r.CO_X, r.IN_NEW) for r in back.collect()) == [(2001, 1, None), (2002, 20, 1), (2003, 3, None)]
    some = p.read_editions(spark, root, [2002], ["CO_X", "NOPE"])
    assert [r.CO_X for r in some.collect()] == [20]
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(NU_ANO_CENSO" in plan and "ReadSchema: struct<CO_X:int>" in plan
    with pytest.raises(FileNotFoundError, match="2009"):
        p.read_editions(spark, root, [2002, 2009])
    with pytest.raises(KeyError):
        p.read_editions(spark, root, [2002], ["NOPE"])


def test_headers_alone_tell_the_columns(editions):
    """No scan in the plan, no job but the collection of the headers themselves."""
    matrix = p.presence_matrix(p.edition_catalog(editions))
    assert "Scan csv" not in matrix._jdf.queryExecution().executedPlan().toString()
    assert {r.coluna for r in matrix.collect()} >= {"CO_ENTIDADE", "NU_ANO_CENSO"}


# -- meshes ----------------------------------------------------------------------


def test_meshes_in_texts(spark):
    good = ('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"codarea":"31","x":1},'
            '"geometry":{"type":"Point","coordinates":[1,2.50]}},{"type":"Feature","properties":{},"geometry":null}]}')
    df = spark.createDataFrame([("m1", good), ("m2", '{"type":"FeatureCollection","features":[]}')], "malha string, conteudo string")
    rows = p.parse_meshes(df).collect()
    assert [(r.malha, r.posicao, r.codarea) for r in rows] == [("m1", 0, "31"), ("m1", 1, "")]
    assert json.loads(rows[0].geometry) == {"type": "Point", "coordinates": [1, 2.5]}
    for bad in ('{"type":"Topology"}', "no json", None):
        with pytest.raises(Exception, match="FeatureCollection"):
            p.parse_meshes(spark.createDataFrame([("m", bad)], "malha string, conteudo string")).collect()


# -- dominant category -----------------------------------------------------------


def test_dominant_category(spark, units):
    rows = [(2015, 26, "Recife", code, 1) for code in (2, 3, 3, 2, 4)] + [(2015, 26, "Recife", 3, 2), (2015, 26, "Olinda", None, 1)]
    rows += [(2015, 43, "POA", 4, 1), (2016, 43, "POA", None, 1)]
    panel = spark.createDataFrame(
        rows, "NU_ANO_CENSO int, CO_UF int, NO_UF string, TP_DEPENDENCIA tinyint, TP_SITUACAO_FUNCIONAMENTO tinyint")
    got = {(r.ano, r.codarea): r for r in p.dominant_category(panel, "TP_DEPENDENCIA", p.Cut.of("uf")).collect()}
    assert set(got) == {(2015, "26"), (2015, "43")}
    first, alone = got[2015, "26"], got[2015, "43"]
    assert (first.categoria, first.rotulo, first.escolas, first.com_codigo, first.margem) == (2, "Estadual", 2, 5, 0)
    assert first.pct == pytest.approx(40) and (alone.rotulo, alone.pct, alone.margem) == ("Privada", 100, 100)
    with pytest.raises(p.InvalidQuery, match="no category"):
        p.dominant_category(panel, "QT_MAT_BAS", p.Cut.of("uf"))


# -- published maps --------------------------------------------------------------


def test_a_published_map_is_whole_and_scans_the_panel_once(spark, tmp_path):
    rows = [(2015, 26, "PE", 10, 1, i) for i in range(4)] + [(2015, 43, "RS", 7, 1, 9), (2015, 52, "GO", 1, 1, 11)]
    schema = "NU_ANO_CENSO int, CO_UF int, NO_UF string, QT_MAT_BAS int, TP_SITUACAO_FUNCIONAMENTO int, CO_ENTIDADE int"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "panel"))
    reads = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def seen(x):
        reads.add(1)
        return x

    panel = spark.read.parquet(str(tmp_path / "panel")).withColumn("QT_MAT_BAS", seen.asNondeterministic()("QT_MAT_BAS"))
    catalog = p.edition_catalog({2015: panel})
    mesh = spark.createDataFrame([("26", "{}"), ("43", "{}"), ("11", "{}")], "codarea string, geometry string")
    texts = spark.createDataFrame([("QT_MAT_BAS", 2015, 1, "Enrolled", "", "", "")],
                                  "coluna string, ano int, row_idx int, descricao string, tipo_inep string, tamanho_inep string, categorias string")
    out = str(tmp_path / "maps")
    meta = p.write_map(panel, catalog, mesh, "qt_mat_bas", p.Cut.of("uf"), out, descriptions=texts)
    assert reads.value == len(rows)
    assert meta["descricao"] == "Enrolled" and meta["cobertura"]["areas_na_malha"] == 3
    assert meta["avisos"] == ["1 polygon(s) without data", "1 area code(s) without polygon"]
    back = p.read_map(spark, out, meta["slug"])
    assert back["meta"] == meta and back["areas"].count() == 3 and back["features"].count() == 3
    # a later map replaces it for readers, a failed one does not
    with pytest.raises(p.InvalidQuery):
        p.write_map(panel.limit(0), catalog, mesh, "QT_MAT_BAS", p.Cut.of("uf"), out)
    assert p.read_map(spark, out, meta["slug"])["areas"].count() == 3
    p.write_map(panel.filter("CO_UF = 26"), catalog, mesh, "QT_MAT_BAS", p.Cut.of("uf"), out)
    assert p.read_map(spark, out, meta["slug"])["areas"].count() == 1
