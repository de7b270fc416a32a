"""Reading XML by placement, into maps and wrapped arrays, and back from what is written."""

import json as js

import pytest
from pyspark.sql import functions as F

from rowwarden import rules as R
from rowwarden.operators.encode import encode_xml
from rowwarden.rules import SchemaError
from rowwarden.schema import ArrayOf, Field, MapOf, Schema
from rowwarden.sources import xml

AT = Schema("at", [Field("unit", "string", xml="attribute", optional=True), Field("value", "double", [R.positive], xml="text")])
BOX = Schema("box", [Field("id", "long", xml="attribute"), Field("name", "string"), Field("at", AT, optional=True), Field("codes", "array<long>", xml="wrapped", optional=True), Field("marks", ArrayOf(AT), optional=True), Field("limits", MapOf("long"), optional=True), Field("places", MapOf(AT), optional=True), Field("boxes", ArrayOf(AT), xml="wrapped", optional=True)], keys="snake")


def _read(spark, docs):
    rows = xml.decode(spark.createDataFrame(list(enumerate(docs)), "k int, doc string"), BOX, "doc").orderBy("k").collect()
    return [r.value.asDict(True) if r.value else sorted(f"{i['path']}:{i['code']}" for i in r["_issues"]) for r in rows]


def test_placement(spark):
    got = _read(spark, [
        '<b id="1"><id>2</id><name>n</name><at unit="m">7</at><codes><item>1</item><item>2</item></codes></b>', '<b name="n"><id>2</id><at>1.5</at><codes/></b>',
        '<b id="1"><name>a</name><name>b</name><marks>1</marks><marks unit="x">2</marks><limits><entry key="k"><value>1</value></entry><entry key="k"><value>3</value></entry></limits></b>',
        '<b id="x"><name>n</name><at unit="m">-7</at><marks>1</marks><marks>y</marks><limits><entry key="k"><value>z</value></entry></limits></b>',
        '<b id="1" id="2"><name>n</name></b>', '<b id="1"><name>n</name><places><entry key="p"><value unit="u">4</value></entry></places><boxes><item>1</item></boxes></b>',
    ])
    none = dict.fromkeys(("at", "codes", "marks", "limits", "places", "boxes"))
    assert got[0] == none | {"id": 1, "name": "n", "at": {"unit": "m", "value": 7.0}, "codes": [1, 2]}
    assert got[1] == none | {"id": 2, "name": "n", "at": {"unit": None, "value": 1.5}, "codes": []}
    assert got[2] == none | {"id": 1, "name": "b", "marks": [{"unit": None, "value": 1.0}, {"unit": "x", "value": 2.0}], "limits": {"k": 3}}
    assert got[3] == ["at.value:not_positive", "id:type_mismatch", "limits.k:type_mismatch", "marks[1].value:type_mismatch"]
    assert got[4] == [":duplicate_key"]
    assert got[5] == none | {"id": 1, "name": "n", "places": {"p": {"unit": "u", "value": 4.0}}, "boxes": [{"unit": None, "value": 1.0}]}


def test_round_trip(spark):
    at = lambda v: F.struct(F.when(F.col("id") % 2 == 0, F.lit("<m>")).alias("unit"), v.alias("value"))
    k = F.col("id")
    rows = spark.range(1, 30).select(
        "id", F.concat(F.lit("n & é "), k).alias("name"), F.when(k % 3 != 0, at(k / 4)).alias("at"), F.when(k % 4 != 0, F.slice(F.array(k, k + 1), F.lit(1), (k % 3).cast("int"))).alias("codes"), F.when(k % 5 != 0, F.array(at(k + 0.5), at(k * 2.0))).alias("marks"),
        F.when(k % 2 == 0, F.create_map(F.lit("a\"<"), k, F.lit("b"), -k)).alias("limits"), F.when(k % 7 == 0, F.create_map(F.lit("p"), at(k * 1.0))).alias("places"), F.when(k % 3 == 1, F.array(at(k * 3.0))).alias("boxes"),
    )
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    written = spark.createDataFrame([(r.xml,) for r in encode_xml(rows, BOX).select("xml").collect()], "xml string")
    back = xml.decode(written, BOX, "xml").select("_issues", "value").collect()
    assert not any(r["_issues"] for r in back)
    by_id = lambda found: {r["id"]: r.asDict(True) for r in found}
    assert by_id(r["value"] for r in back) == by_id(rows.collect())


def test_projection(spark):
    docs = ['<a x="1">t<b>2</b><b y="3">4</b><c/><n:d xmlns:n="u">5</n:d></a>', "<a>only</a>", "<a>", None, "<!DOCTYPE a><a/>", "<a>" * 80 + "</a>" * 80, "<a>007</a>"]
    got = xml.project(spark.createDataFrame(list(enumerate(docs)), "k int, doc string"), "doc").orderBy("k").select(F.to_json("value").alias("v")).collect()
    assert js.loads(got[0].v) == {"x": "1", "": "t", "b": ["2", {"y": "3", "": "4"}], "c": "", "d": "5"}
    assert [r.v for r in got[1:]] == ['"only"', None, None, None, None, '"007"']


def test_what_xml_cannot_hold(spark):
    df = spark.createDataFrame([("<a/>",)], "doc string")
    for fields in ([Field("v", "variant")], [Field("m", "map<string,variant>")], [Field("m", "map<string,variant>", extras=True)]):
        with pytest.raises(SchemaError):
            xml.decode(df, Schema("s", fields), "doc")
