"""Places of issues: what lies between their bytes, lines and columns, and excerpts with carets."""

import json as js
import random

import pytest
from pyspark.sql import functions as F

from rowwarden import rules as R
from rowwarden.operators import locate, render
from rowwarden.schema import ArrayOf, Field, MapOf, Schema
from rowwarden.sources import json, xml

TARGET = Schema("target", [Field("a", "long"), Field("port", "long"), Field("b", "long")])


def _located(spark, docs, schema, kind="json", **options):
    source = spark.createDataFrame(list(enumerate(docs)), "k int, doc " + ("binary" if any(isinstance(d, bytes) for d in docs) else "string"))
    decoded = (json if kind == "json" else xml).decode(source, schema, "doc")
    return locate.locate(decoded, "doc", kind=kind, **options).orderBy("k").collect()


def test_carets(spark):
    doc = '{\n"a": 1,\n"port": "x",\n"b": 2\n}'
    row = _located(spark, [doc], TARGET, excerpts=True)[0]
    want = 'test.json:3:9: error: port must be an integer, found "x"\n  1 │ {\n  2 │ "a": 1,\n  3 │ "port": "x",\n    │         ^^^\n  4 │ "b": 2\n\n1 error\n'
    assert render.plain("test.json", row["_issues"]) == want
    crlf = _located(spark, [doc.replace("\n", "\r\n")], TARGET, excerpts=True)[0]["_issues"][0]
    assert "\r" not in crlf["excerpt"] and crlf["line"] == 3


def test_order_and_absence(spark):
    rows = _located(spark, ['{\n"b": "y",\n"a": "x",\n"port": 1\n}', "{}", '{"a":1,"port":2,"b":3}'], TARGET, excerpts=True)
    assert [(i["path"], i["line"], i["column"]) for i in rows[0]["_issues"]] == [("b", 2, 6), ("a", 3, 6)]
    assert all(i["offset"] is None for i in rows[1]["_issues"]) and "3 errors" in render.plain("e", rows[1]["_issues"]) and "│" not in render.plain("e", rows[1]["_issues"])
    assert rows[2]["_issues"] == [] and render.plain("e", []) == ""


def test_columns_say_the_same(spark):
    docs = ['{\n"b": "y",\n"a": "é",\n"port": 1.5}', "{}", "[1]", '{"a":1,"port":2,"b":3}', '{"a" 1}']
    source = spark.createDataFrame(list(enumerate(docs)), "k int, doc string")
    df = locate.locate(json.decode(source, TARGET, "doc"), "doc", excerpts=True)
    for r in df.select("_issues", render.plain_column("s", F.col("_issues")).alias("text"), render.report("s", F.col("_issues"), located=True).alias("json")).collect():
        assert r.text == render.plain("s", r["_issues"])
        assert [(x.get("offset"), x.get("line")) for x in js.loads(r.json)["issues"]] == [(i["offset"], i["line"]) for i in r["_issues"]]


def test_nested_paths_and_bytes(spark):
    inner = Schema("inner", [Field("x", "array<long>"), Field("é \"k\"", "long", optional=True)])
    schema = Schema("outer", [Field("a", ArrayOf(inner)), Field("m", MapOf(inner))])
    doc = '{"ü": "é", "a": [ {"x": [1, "bad"]}, 7 ],\n "m": {"k": {"x": {"y": 1}}}}'
    found = {i["path"]: doc.encode()[i["offset"] : i["offset"] + i["length"]].decode() for i in _located(spark, [doc], schema)[0]["_issues"]}
    assert found == {"a[0].x[1]": '"bad"', "a[1]": "7", "m.k.x": '{"y": 1}'}


@pytest.mark.parametrize(
    ("doc", "stop"),
    [("{", 1), ('{"a": 1} x', 9), ('{"a": tru}', 6), ("", 0), ('{"a": 1,}', 8), ('{"a" 1}', 5), ("[1, 2", 5), ('{"a": 1', 7), ('{"a": 01}', 6), ("{]", 1), ("x", 0), ('{"a": "b', 6)],
)
def test_where_documents_stop(spark, doc, stop):
    assert locate.json_places(doc.encode())[1] == stop
    issue = _located(spark, [doc], TARGET)[0]["_issues"][0]
    assert issue["path"] == "" and issue["offset"] == stop


def test_invalid_utf8_and_depth(spark):
    bad = '{"a": "é'.encode() + b'\xff"}'
    deep = b'{"a": ' + b"[" * 70 + b"]" * 70 + b"}"
    rows = _located(spark, [bad, deep, None], TARGET)
    assert [(r["_issues"][0]["code"], r["_issues"][0]["offset"]) for r in rows] == [("invalid_utf8", 9), ("depth_exceeded", 69), ("malformed_document", 0)]


def test_every_value_is_found():
    rng = random.Random(1)

    def made(depth):
        kind = rng.randrange(7 if depth < 4 else 4)
        if kind < 4:
            return rng.choice([None, True, -1.5e3, 7, "é\n\"\\", ""])
        if kind < 6:
            return {rng.choice(["a", "b", "é", "x y", ""]): made(depth + 1) for _ in range(rng.randrange(4))}
        return [made(depth + 1) for _ in range(rng.randrange(4))]

    def paths(value, path):
        yield path, value
        for k, v in value.items() if isinstance(value, dict) else ():
            yield from paths(v, f"{path}.{k}" if path else k)
        for k, v in enumerate(value) if isinstance(value, list) else ():
            yield from paths(v, f"{path}[{k}]")

    for _ in range(300):
        value = {"r": made(0)}
        doc = js.dumps(value, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])).encode()
        found, stop = locate.json_places(doc)
        want = list(paths(value, ""))
        assert stop is None and all(js.loads(doc[slice(*found[p])]) == v for p, v in dict(want).items() if list(dict(want)).count(p) == 1 and "" not in p.split("."))


def test_xml_places(spark):
    schema = Schema("deploy", [Field("name", "string", [R.min_(3)]), Field("replicas", "long", [R.range_(1, 100)]), Field("tag", "array<long>", optional=True), Field("db", Schema("db", [Field("size", "long")]), optional=True)])
    docs = ["<d name='x'>\n <replicas> 0 </replicas>\n <tag>1</tag><tag>no</tag><!-- <tag>z</tag> --><db size=\"big\"/></d>", "<d><name>api</name><replicas>nope</replicas></d>"]
    rows = _located(spark, docs, schema, "xml")
    under = [{i["path"]: docs[r["k"]].encode()[i["offset"] : i["offset"] + i["length"]].decode() for i in r["_issues"] if i["offset"] is not None} for r in rows]
    assert under == [{"name": "x", "replicas": "0", "tag[1]": "no", "db.size": "big"}, {"replicas": "nope"}]
