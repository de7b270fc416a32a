"""Rows as XML: placement, escaping, nesting, and decoding what was written."""

import pytest
from pyspark.sql import functions as F

from rowwarden.operators.encode import encode_xml
from rowwarden.rules import SchemaError
from rowwarden.schema import Field, MapOf, Schema
from rowwarden.sources import xml


def test_escaping_by_place_and_absence(spark):
    schema = Schema("r", [Field("a", "string", xml="attribute", optional=True), Field("t", "string", optional=True), Field("m", MapOf("long"), optional=True)])
    rows = spark.createDataFrame([(1, 'x"<&>\n', "a\r\x01\"<&>", {"k\"": 1, "b": 2}), (2, None, None, None), (3, "", "", {})], "id int, a string, t string, m map<string,bigint>")
    got = {r.id: r.xml for r in encode_xml(rows, schema).collect()}
    assert got[1] == '<r a="x&quot;&lt;&amp;&gt;&#10;"><t>a&#13;"&lt;&amp;&gt;</t><m><entry key="b"><value>2</value></entry><entry key="k&quot;"><value>1</value></entry></m></r>'
    assert got[2] == "<r></r>" and got[3] == '<r a=""><t></t><m></m></r>'


def test_round_trip(spark):
    inner = Schema("inner", [Field("x", "long"), Field("y", "array<string>")])
    schema = Schema("row", [Field("id", "long", xml="attribute"), Field("name", "string"), Field("price", "double"), Field("ok", "boolean"), Field("in", inner)])
    rows = spark.range(1, 40).select("id", F.concat(F.lit("n <&> é "), F.col("id")).alias("name"), (F.col("id") / 4).alias("price"), (F.col("id") % 2 == 0).alias("ok"), F.struct((F.col("id") * 3).alias("x"), F.array(F.lit("p"), F.lit("q")).alias("y")).alias("in"))
    written = spark.createDataFrame([tuple(r) for r in encode_xml(rows, schema, declaration=True).select("id", "xml").collect()], "id long, xml string")
    back = xml.decode(written, schema, "xml").select("_issues", "value").collect()
    assert not any(r["_issues"] for r in back)
    assert sorted(r["value"] for r in back) == sorted(tuple(r) for r in rows.collect())


@pytest.mark.parametrize("fields", [[Field("a", "array<long>", xml="attribute")], [Field("a", "long", xml="wrapped")], [Field("a", "long", xml="text"), Field("b", "long", xml="text")], [Field("a", "long", xml="below")]])
def test_placement_that_means_nothing(fields):
    with pytest.raises(SchemaError):
        Schema("s", fields)
