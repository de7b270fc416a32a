"""YAML and XML documents on small fixtures."""

import pytest

from rowwarden import rules as R
from rowwarden.operators import encode
from rowwarden.rules import SchemaError
from rowwarden.schema import Field, Schema
from rowwarden.sources import xml

DATABASE = Schema("database", [Field("url", "string"), Field("poolSize", "long", default=5)], keys="snake")
CONFIG = Schema("config", [Field("serviceName", "string"), Field("port", "long", [R.range_(1, 65535)]), Field("workers", "long", default=4), Field("database", DATABASE), Field("features", "array<string>", default=[])], keys="snake")


def _codes(df):
    return [[i["code"] for i in r["_issues"]] for r in df.orderBy("k").collect()]


def test_xml(spark):
    docs = [
        "<c><service_name>api</service_name><port>8080</port><database url='u'><pool_size>9</pool_size></database><features>a</features><features>b</features></c>",
        "<c><service_name>api</service_name><port>0</port><database><url>u</url></database></c>", "<c><port>x</port></c>", "<c><port>", "<c><port>1</port></c><d/>", "plain", None,
        "<?xml version='1.0'?><q:c xmlns:q='urn:z'><q:service_name>007</q:service_name><q:port>1</q:port><q:database url='u'/></q:c>",
    ]
    df = xml.decode(spark.createDataFrame(list(enumerate(docs)), "k int, doc string"), CONFIG, "doc")
    assert _codes(df) == [[], ["not_in_range"], ["missing", "type_mismatch", "missing"], *[["malformed_document"]] * 4, []]
    rows = df.orderBy("k").collect()
    assert rows[0].value.asDict(True) == {"serviceName": "api", "port": 8080, "workers": 4, "database": {"url": "u", "poolSize": 9}, "features": ["a", "b"]}
    assert rows[7].value.serviceName == "007"
    with pytest.raises(SchemaError):
        xml.decode(df, Schema("s", [Field("m", "map<string,variant>")]), "doc")


def test_yaml(spark):
    pytest.importorskip("yaml")
    from rowwarden.sources import yaml

    docs = [
        "service_name: api\nport: 8080\ndatabase: {url: u, pool_size: 0x10}\nfeatures:\n- yes\n- 'no'\n", "base: &b {url: u}\nservice_name: '1'\nport: 70000\ndatabase:\n  <<: *b\n  pool_size: 2\n",
        "service_name: 1\nport: '1'\ndatabase: ~\n", "a: [", "a: 1\n---\nb: 2\n", "", None, "? [x]\n: 1\n", "[" * 80 + "]" * 80,
    ]
    source = spark.createDataFrame(list(enumerate(docs)), "k int, doc string")
    df = yaml.decode(source, CONFIG, "doc")
    assert _codes(df) == [[], ["not_in_range"], ["type_mismatch"] * 3, *[["malformed_document"]] * 6]
    first = df.orderBy("k").first().value
    assert first.database.poolSize == 16 and first.features == ["yes", "no"]
    each = yaml.decode_all(source.where("k = 4"), Schema("s", [Field("a", "long", optional=True)]), "doc").orderBy("_document").collect()
    assert [r.value.a for r in each] == [1, None]


def test_yaml_round_trip(spark):
    pytest.importorskip("yaml")
    from rowwarden.sources import yaml

    schema = Schema("s", [Field("a", "string"), Field("n", "long"), Field("t", "array<string>"), Field("o", "string", optional=True)])
    rows = [("yes", 1, ["~", "1", "0o7", "1e3", "a: b", "x\ny"], None), ("", -5, [], "é"), ("TRUE", 2, ["null", ".5"], "- x")]
    df = spark.createDataFrame(rows, "a string, n long, t array<string>, o string")
    text = encode.encode_json(df, schema).select(yaml.encode(encode.F.col("json")).alias("doc"))
    back = yaml.decode(text, schema, "doc").select("value.*")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)
