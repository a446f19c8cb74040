import json

import pytest
from pyspark.sql import functions as F

from basketry.sources import records as S
from basketry.streaming import flows


def run(stream, sink, mode="append"):
    q = stream.writeStream.format("memory").queryName(sink).outputMode(mode).trigger(availableNow=True).start()
    assert q.awaitTermination(90)
    return stream.sparkSession.table(sink)


def test_scans_are_suppressed_from_the_last_accepted_one(spark, tmp_path):
    first = [("a", 1000), ("a", 2499), ("b", 2600), ("", 2700), (None, 2800), ("c", None)]
    for i, rows in enumerate([first, [("a", 2500), ("a", 3999), ("b", 4099), ("b", 9000)]]):
        spark.createDataFrame(rows, "code string, at long").coalesce(1).write.mode("append").json(str(tmp_path / "in" / str(i)))
        got = flows.accepted_scans(spark.readStream.schema("code string, at long").json(str(tmp_path / "in" / "*")))
        q = got.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        assert q.awaitTermination(90)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect())) == [("a", 1000), ("a", 2500), ("b", 2600), ("b", 9000)]


def test_import_is_idempotent(spark, tmp_path):
    rows = [("x", "2024-01-01 00:00:00"), ("x", "2024-01-01 00:00:00"), ("x", "2024-01-01 01:00:00"), ("y", "2024-01-01 00:00:00")]
    spark.createDataFrame(rows, "k string, t string").select("k", F.to_timestamp("t").alias("ts")).write.parquet(str(tmp_path / "in"))
    got = run(flows.imported_once(spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in")), ["k"]), "imported")
    assert got.count() == 3


@pytest.mark.parametrize("compact", [1, 2, 20])
def test_latest_row_stays_though_rows_come_late(spark, tmp_path, compact):
    merge = flows.keep_latest(spark, str(tmp_path), ["k"], "at", compact)
    for i, rows in enumerate([[("a", 5, 1.0), ("b", 1, 1.0)], [("a", 4, 2.0), ("b", 1, 3.0), ("c", 1, 4.0)], [("c", 0, 9.0)]]):
        merge(spark.createDataFrame(rows, "k string, at long, v double"), i)
        merge(spark.createDataFrame(rows, "k string, at long, v double"), i)
    assert sorted(map(tuple, flows.latest(spark, str(tmp_path), ["k"], "at").collect())) == [("a", 5, 1.0), ("b", 1, 3.0), ("c", 1, 4.0)]


def test_strict_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"a, ""b"""\n2,c\n')
    assert [tuple(r) for r in S.strict_csv(spark, str(tmp_path / "a.csv"), "id long, name string", "id", 2).orderBy("id").collect()] == [(1, 'a, "b"'), (2, "c")]
    for schema, key, least in (("id long, other string", None, 1), ("id long, name string", None, 3)):
        with pytest.raises(ValueError):
            S.strict_csv(spark, str(tmp_path / "a.csv"), schema, key, least)
    (tmp_path / "b.csv").write_text("id,name\n1,a\n1,c\n")
    with pytest.raises(ValueError):
        S.strict_csv(spark, str(tmp_path / "b.csv"), "id long, name string", "id")


@pytest.mark.parametrize("body", ["id,name\n1,a,b\n", "id,name\n1\n", "id,name\nx,a\n", 'id,name\n1,"a\n2,b\n', "n,id\n1,a\n"])
def test_strict_csv_refuses(spark, tmp_path, body):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id,name\n7,z\n")
    assert S.strict_csv(spark, str(tmp_path / "in"), "id long, name string").count() == 1
    (tmp_path / "in" / "b.csv").write_text(body)
    with pytest.raises(ValueError):
        S.strict_csv(spark, str(tmp_path / "in"), "id long, name string")


def test_annotated_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("#group,false\nt,v\n1,2\nt,v\n3,4\n5\n6,7,8\n")
    assert sorted(map(tuple, S.annotated_csv(spark, str(tmp_path / "a.csv"), ["t", "v"]).collect())) == [("1", "2"), ("3", "4")]


def test_objects_in_json_and_html(spark):
    doc = json.dumps({"a": [{"code": 1, "name": "x", "in": {"code": 2, "name": "y"}}, {"code": 3}]})
    html = '<script type="application/ld+json">{"@graph": [{"@type": ["Recipe", "Thing"], "n": 1}]}</script><script type="application/ld+json">{bad</script><script id="__NEXT_DATA__">{"p": {"q": 7}}</script>'
    row = spark.createDataFrame([(doc, html), ("no json", None), (None, "")], "doc string, html string").select(S.objects_with(F.col("doc"), "code", "name").alias("o"), S.embedded_objects(F.col("html"), "Recipe").alias("r"), S.page_data(F.col("html"), "p struct<q long>")["p"]["q"].alias("q"), S.first_of(F.col("doc"), "$.x", "$.a[0].name").alias("f")).collect()
    assert [[json.loads(x)["code"] for x in r.o] for r in row] == [[1, 2], [], []]
    assert [len(r.r) for r in row] == [1, 0, 0] and [r.q for r in row] == [7, None, None] and [r.f for r in row] == ["x", None, None]


def test_xml_and_recognised_lines(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<r xmlns:m="urn:x"><m:store><m:id>1</m:id><m:name>A</m:name></m:store><m:store><m:id>2</m:id></m:store></r>')
    assert sorted((r.id, r.name) for r in S.xml_rows(spark, str(tmp_path / "a.xml"), "store", "id long, name string").collect()) == [(1, "A"), (2, None)]
    pages = spark.createDataFrame([(1, [([(["a", " "],), (["b"],)],), ([],)])], "page long, blocks array<struct<paragraphs array<struct<lines array<string>>>>>")
    assert [tuple(r) for r in S.recognised_lines(pages).collect()] == [(1, 0, "a"), (1, 1, "b")]
