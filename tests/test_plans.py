"""Cleaning, extracts, upserts and sources on literal rows."""

import pytest
from pyspark.sql import functions as F

from comarca import fixed, schemas
from comarca.operators import analytics, cleaning
from comarca.plans import etl
from comarca.sources import readers, writers

GOLDEN = [
    (0, "62054554", "1324", "31", " Londrina Tech Software ME ", "4781400", " Principal ", "758", " Centro ", "Londrina"),
    (1, "62054554", "1324", "31", "Duplicate Entry", "4781400", "Test Street", "123", "Test District", "Londrina"),
    (2, "15926986", "7764", "94", None, "9529199", " Principal ", "167", " Centro ", "Ibiporã"),
    (3, "81851270", "6027", "78", "", "4711301", " Principal ", "482", " Centro ", "Apucarana"),
]
COLUMNS = """seq int, cnpj_basico string, cnpj_ordem string, cnpj_dv string, nome_fantasia string, cnae_fiscal_principal string,
    logradouro string, numero string, bairro string, municipio string"""


def test_clean_golden(spark):
    df = spark.createDataFrame(GOLDEN, COLUMNS).repartition(3)
    got = cleaning.clean(df, "seq").orderBy("seq").select("seq", "nome_fantasia", "logradouro", "bairro").collect()
    assert [tuple(r) for r in got] == [
        (0, "Londrina Tech Software ME", "Principal", "Centro"),
        (2, "Sin nombre fantasía", "Principal", "Centro"),
        (3, "Sin nombre fantasía", "Principal", "Centro"),
    ]
    assert tuple(cleaning.quality_report(df).first()) == (4, 1, 3, 25.0)


def test_invalid_first_copy_wins_unless_asked(spark):
    rows = [(0, "1", "1", "1", "a", "4711301", "", "", "", ""), (1, " 1", "1", "1", "b", "4711301", "", "", "", "Londrina")]
    df = spark.createDataFrame(rows, COLUMNS)
    assert cleaning.clean(df, "seq").count() == 0
    assert [r.seq for r in cleaning.clean(df, "seq", validate_first=True).collect()] == [1]


def raw(spark, tmp_path, rows):
    lines = []
    for r in rows:
        lines.append(";".join('"' + r.get(c, "") + '"' for c in fixed.RAW_COLUMNS))
    path = tmp_path / "raw.csv"
    path.write_bytes("\n".join(lines).encode("latin-1"))
    return readers.read_registry_csv(spark, str(path))


def test_extracts(spark, tmp_path):
    base = {"cnpj_basico": "00000012", "cnpj_ordem": "0001", "cnpj_dv": "07", "situacao_cadastral": "02", "codigo_municipio": "4113700.0",
            "cnae_fiscal_principal": "62.01-5/01", "municipio": "Cambé", "nome_fantasia": "Á; B"}
    rows = [base, base | {"codigo_municipio": " 4103701 ", "cnae_fiscal_principal": "9511800"}, base | {"situacao_cadastral": "2d"},
            base | {"codigo_municipio": ""}, base | {"cnae_fiscal_principal": "6411100"}]
    df = raw(spark, tmp_path, rows)
    assert df.first().nome_fantasia == "Á; B" and df.first().cnpj_basico == "00000012"
    tech = etl.etl_file(df, etl.TECH).select("business_type", "cnpj_completo", "municipio").collect()
    assert sorted(map(tuple, tech)) == [("repairs", "00000012000107", "Cambé"), ("tech", "00000012000107", "Cambé")]
    broad = etl.etl_file(df).collect()
    assert [r.business_type for r in broad] == ["tech"] and "uf" not in broad[0].asDict()


def test_one_scan_no_shuffle(spark, tmp_path):
    df = etl.etl_file(raw(spark, tmp_path, [{}]), etl.TECH)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_json_array(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('[{"cnpj_basico": "1", "numero": 758, "nome_fantasia": null}, {"cnpj_basico": "2", "municipio": "Cambé"}]')
    rows = readers.read_business_json(spark, str(path)).orderBy("cnpj_basico").collect()
    assert (rows[0].numero, rows[0].nome_fantasia, rows[1].municipio) == ("758", None, "Cambé")


def test_first_non_empty(spark):
    empty, full = spark.range(0), spark.range(2)
    assert readers.first_non_empty([lambda: spark.table("nowhere"), lambda: empty, lambda: full]).count() == 2
    assert readers.first_non_empty([lambda: empty]) is None


def test_upsert_keeps_other_columns(spark):
    target = spark.createDataFrame([("a", "old", "x"), ("b", "old", "y")], "k string, v string, w string")
    source = spark.createDataFrame([("a", "1", "n", 1), ("a", "2", "n", 2), ("c", "3", "n", 1)], "k string, v string, w string, seq int")
    got = writers.upsert(target, source, ["k"], ["v"], order="seq")
    assert sorted(map(tuple, got.collect())) == [("a", "2", "x"), ("b", "old", "y"), ("c", "3", "n")]


def test_schemas_parse(spark):
    for text in (schemas.RAW_ESTAB, schemas.BUSINESS_JSON, schemas.ESTAB, schemas.SEGMENT, schemas.VISIT, schemas.VISIT_ITEM,
                 schemas.ROUTE, schemas.SEGMENT_DENSITY):
        assert spark.createDataFrame([], text).columns


def test_feature_collection_is_bounded(spark):
    features = spark.range(5).select(F.struct("id").alias("feature"))
    assert len(writers.feature_collection(features).first().document.features) == 5
    with pytest.raises(ValueError):
        writers.feature_collection(features, most=4)


def test_empty_summary(spark):
    df = spark.createDataFrame([], "cluster_id int, total_lojas long")
    assert tuple(analytics.cluster_summary(df).first()) == (0, 0, "N/A")


def test_repartitioning_changes_nothing(spark):
    rows = [(f"Rua {i % 7}", str(4700000 + 1000000 * (i % 3)), ["01", "3", "05"][i % 3]) for i in range(300)]
    df = spark.createDataFrame(rows, "logradouro string, cnae_fiscal_principal string, porte_empresa string")
    once = analytics.top_streets(df.repartition(1), 3).collect()
    assert once == analytics.top_streets(df.repartition(7), 3).collect()


def test_upsert_refuses_repeated_keys(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    twice = spark.createDataFrame([(1, "b"), (1, "c"), (None, "d"), (None, "e")], "k int, v string")
    with pytest.raises(Exception, match="give an order"):
        writers.upsert(target, twice, ["k"], ["v"]).collect()
    once = writers.upsert(target, twice.where("v <> 'c'"), ["k"], ["v"]).collect()
    assert sorted((r.k or 0, r.v) for r in once) == [(0, "d"), (0, "e"), (1, "b")]


@pytest.mark.parametrize("n", [0, 1, 12_000])
def test_collection_of_any_size(spark, tmp_path, n):
    import json

    features = spark.range(n).repartition(3).selectExpr("struct('Feature' as type, struct(id) as properties) as feature", "id")
    writers.write_collection(features, str(tmp_path / "out"), ["id"], {"total": n})
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part-"))
    document = json.loads("".join(p.read_text() for p in parts))
    assert [f["properties"]["id"] for f in document["features"]] == list(range(n)) and document["metadata"] == {"total": n}
