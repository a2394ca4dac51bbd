"""Column functions against plain Python on literal and generated values."""

import hashlib

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
import pytest

from comarca.functions import geo, labels, text
from comarca.operators import filters

SOME = settings(max_examples=5, deadline=None)


def values(spark, rows, column, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, v {kind}")
    return [r[0] for r in df.select(column.alias("o"), "i").orderBy("i").select("o").collect()]


@SOME
@given(st.lists(st.text(max_size=20), min_size=1, max_size=50))
def test_hash_digits(spark, rows):
    want = [int(hashlib.md5(r.encode()).hexdigest(), 16) % 10**6 for r in rows]
    assert values(spark, rows, geo.hash_digits("v")) == want


@SOME
@given(st.lists(st.text(st.characters(max_codepoint=0x2FF), max_size=12), min_size=1, max_size=50))
def test_repair_text(spark, rows):
    def repaired(v):
        try:
            return v.encode("latin-1").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            return v

    rows = [r.encode("utf-8").decode("latin-1") for r in rows] + rows
    assert values(spark, rows, text.repair_text("v")) == [repaired(r) for r in rows]


def test_strip(spark):
    rows = ["\t a b ", " x\n", "", " ", None, "\x1fy\x1c"]
    assert values(spark, rows, text.strip("v")) == ["a b", "x", "", "", None, "y"]


def test_numbers(spark):
    rows = ["4113700.0", " 2 ", "2d", "", None, "1e3", "-.5", "0x1", "NaN", "12345678901234567890123"]
    assert values(spark, rows, text.to_number("v")) == [4113700.0, 2.0, None, None, None, 1000.0, -0.5, None, None, 1.2345678901234568e22]
    assert values(spark, rows[:7], text.to_whole("v")) == [4113700, 2, None, None, None, 1000, 0]


def test_pad_keeps_long_text(spark):
    assert values(spark, ["123456789", " 7 ", None, ""], text.pad("v", 8)) == ["123456789", "00000007", "00000000", "00000000"]


def test_clean_code(spark):
    assert values(spark, ["62.01-5/01", " 6202 300"], text.clean_code("v")) == ["6201501", "6202300"]


def test_city_names(spark):
    rows = ["CAMBE", " cambe ", "IbiporÃ£", "FOZ DO IGUACU", None, " "]
    assert values(spark, rows, text.city_name("v")) == ["Cambé", "Cambé", "Ibiporã", "Foz Do Iguacu", "Unknown", "Unknown"]


def test_centroid_order_and_accents(spark):
    rows = [(i, c) for i, c in enumerate(["Cambira", "Cambé", "Rolândia", "Nova Jatai", "x Apucarana", "Londrina", None])]
    df = spark.createDataFrame(rows, "i int, v string")
    found = [r.clng for r in geo.with_centroid(df, "v").orderBy("i").collect()]
    assert found == [-51.5778, -51.2782, -51.3897, -51.6447, -51.4614, None, None]
    plain = [r.clng for r in geo.with_centroid(df, "v", fold=False).orderBy("i").collect()]
    assert plain[2] is None


def test_synthetic_point(spark):
    company, kind = "62054554132431", "tech"
    h = int(hashlib.md5(company.encode()).hexdigest(), 16)
    hub = [3, 2, 1, 5, 4][h % 5]
    centre = {1: (-51.161, -23.311), 2: (-51.189, -23.331), 3: (-51.167, -23.322), 4: (-51.148, -23.272), 5: (-51.155, -23.318)}[hub]
    fx, fy = (h % 1000 - 500) / 500.0, (h // 1000 % 1000 - 500) / 500.0
    df = spark.createDataFrame([(company, kind, "Londrina")], "c string, k string, m string")
    row = geo.with_synthetic_point(df, "c", "k", "m").first()
    assert row.lon == pytest.approx(centre[0] + fx**3 * 0.0075, abs=1e-12)
    assert row.lat == pytest.approx(centre[1] + fy**3 * 0.0075, abs=1e-12)


def test_instants(spark):
    rows = ["2026-05-30T10:00:00Z", "2026-05-30T10:00:00.25-03:00", "2026-05-30", "soon", None]
    want = ["2026-05-30T10:00:00", "2026-05-30T13:00:00.250000", "2026-05-30T00:00:00", None, None]
    assert values(spark, rows, text.iso(text.instant("v"))) == want


def test_types_overlap(spark):
    rows = ["9511800", "4751201", "9521500", "4711301", "5611201", "0"]
    assert values(spark, rows, labels.business_type("v")) == ["tech", "tech", "repairs", "retail", "gastronomy", "gastronomy"]
    assert values(spark, rows[:1], labels.business_type("v", "tech")) == ["repairs"]


def test_wkt(spark):
    rows = ["LINESTRING(-51.1 -23.2, 3 4)", "POINT(1 2)", None, "linestring (1 2,3 4 , 5 6)"]
    got = values(spark, rows, F.transform(geo.parse_line("v"), lambda p: F.array(p["x"], p["y"])))
    assert got == [[[-51.1, -23.2], [3.0, 4.0]], None, None, [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]]


def test_boxes():
    assert geo.parse_box("3,4,1,2") == (1.0, 2.0, 3.0, 4.0)
    for bad in ("1,2,3", "a,b,c,d", ""):
        with pytest.raises(ValueError):
            geo.parse_box(bad)


@SOME
@given(st.lists(st.tuples(*[st.integers(-4, 4)] * 4), min_size=1, max_size=60))
def test_line_hits_box(spark, lines):
    """Against clipping of the line to the box."""

    def clipped(ax, ay, bx, by, box=(-1, -2, 2, 1)):
        lo, hi = 0.0, 1.0
        for p, d, a, b in ((ax, bx - ax, box[0], box[2]), (ay, by - ay, box[1], box[3])):
            if d == 0:
                if not a <= p <= b:
                    return False
                continue
            s, e = sorted(((a - p) / d, (b - p) / d))
            lo, hi = max(lo, s), min(hi, e)
        return lo <= hi + 1e-12

    df = spark.createDataFrame([(i, [(float(a), float(b)), (float(c), float(d))]) for i, (a, b, c, d) in enumerate(lines)],
                               "i int, geom array<struct<x:double,y:double>>")
    got = [r[0] for r in df.orderBy("i").select(geo.line_hits_box("geom", -1, -2, 2, 1)).collect()]
    assert got == [clipped(*line) for line in lines]


def test_cluster_search(spark):
    df = spark.createDataFrame([(1,), (3,), (13,), (20,)], "cluster_id int")
    ids = lambda q: sorted(r[0] for r in filters.find_clusters(df, q).collect())
    assert ids("polo 3") == [3, 13] and ids("3") == [3, 13] and ids("centro") == [1, 3, 13, 20] and ids(" ") == [1, 3, 13, 20]


def test_density_label(spark):
    assert values(spark, [0, 4], labels.density_label("v", "software"), "bigint") == [
        "Sin comercios activos detectados en esta zona.",
        "Desarrollo de Software en funcionamiento: 4 empresas de desarrollo de software activas.",
    ]


def test_instants_are_strict_and_free_of_the_session_zone(spark):
    from comarca.functions.text import instant, iso

    rows = [
        ("2026-05-30T10:00:00Z", "2026-05-30T10:00:00"), ("2026-05-30 10:00:00.25", "2026-05-30T10:00:00.250000"),
        ("2026-05-30T10:00:00-03:00", "2026-05-30T13:00:00"), ("2026-05-30", "2026-05-30T00:00:00"), ("10:00", None),
        ("2026", None), ("2026-05", None), (" 2026-05-30 ", None), ("2026-13-01", None), ("", None), (None, None),
    ]
    df = spark.createDataFrame(rows, "t string, want string")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for name in ("UTC", "America/Sao_Paulo"):
            spark.conf.set("spark.sql.session.timeZone", name)
            assert all(r.got == r.want for r in df.select(iso(instant("t")).alias("got"), "want").collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_registry_csv_equals_pandas(spark, tmp_path):
    import csv

    import pandas as pd

    from comarca import schemas
    from comarca.sources.readers import first_non_empty, read_registry_csv

    width = len(spark.createDataFrame([], schemas.RAW_ESTAB).columns)
    rows = [["1", 'LOJA ""BOA"" LTDA', "a;b", "C:\\"], ["2", "x", "\\", '""']]
    path = tmp_path / "estab.csv"
    text = "\n".join(";".join(f'"{v}"' for v in [*r, *["é"] * (width - 4)]) for r in rows) + "\n"
    path.write_bytes(text.encode("latin-1"))
    want = pd.read_csv(path, sep=";", header=None, dtype=str, encoding="latin-1", quoting=csv.QUOTE_MINIMAL)
    got = read_registry_csv(spark, str(path)).collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want.itertuples(index=False)]

    down = lambda: spark.read.jdbc("jdbc:none://nowhere/db", "t")
    assert first_non_empty([down, lambda: read_registry_csv(spark, str(path))]).count() == 2


def test_keys_stay_visible_to_filters(spark, tmp_path):
    from comarca.sources.writers import keep_last

    path = str(tmp_path / "t")
    spark.createDataFrame([("u", 1, "a"), ("u", 2, "b")], "k string, seq long, v string").write.parquet(path)
    last = keep_last(spark.read.parquet(path), ["k"], "seq").where("k = 'u'")
    assert [tuple(r) for r in last.collect()] == [("u", 2, "b")]
    assert "EqualTo(k,u)" in last._jdf.queryExecution().executedPlan().toString()
