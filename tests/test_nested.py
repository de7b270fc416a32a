"""Rules, checks, keys and encoding within arrays, maps and nested schemas, and that what is encoded reads back."""

import json as js

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rowwarden import rules as R
from rowwarden.functions import dates
from rowwarden.operators import encode, validate
from rowwarden.schema import ArrayOf, Check, Field, MapOf, Schema
from rowwarden.sources import json

ORDER = Check("hi", lambda r: F.when(r["hi"] < r["lo"], "is below lo"), code="order")
SPAN = Schema("span", [Field("lo", "long", [R.min_(0)]), Field("hi", "long"), Field("note", "string", [R.not_empty], optional=True)], checks=[ORDER])
DEEP = Schema("deep", [Field("spans", ArrayOf(SPAN), [R.count(0, 2)]), Field("byName", MapOf(SPAN), optional=True), Field("one", SPAN, optional=True), Field("rows", ArrayOf(ArrayOf(SPAN)), optional=True)], keys="snake")

ROWS = [
    (1, {"spans": [{"lo": 1, "hi": 2}], "by_name": {"x": {"lo": 0, "hi": 0}}, "one": None, "rows": None}, []),
    (2, {"spans": [{"lo": -1, "hi": 2, "note": ""}, {"lo": 3, "hi": 2}], "by_name": {"x": {"lo": 5, "hi": 4}}, "one": {"lo": -5, "hi": -6}, "rows": [[], [{"lo": -2, "hi": 0}]]},
     ["spans[0].lo:too_small", "spans[0].note:empty", "spans[1].hi:order", "by_name.x.hi:order", "one.lo:too_small", "one.hi:order", "rows[1][0].lo:too_small"]),
    (3, {"spans": [{"lo": 1, "hi": 2}] * 3}, ["spans:wrong_count"]),
]


def _codes(found):
    return sorted(f"{i['path']}:{i['code']}" for i in found)


def test_decoding_and_validation_reach_every_level(spark):
    docs = spark.createDataFrame([(k, js.dumps(d)) for k, d, _ in ROWS], "k int, doc string")
    decoded = {r.k: r for r in json.decode(docs, DEEP, "doc").collect()}
    for k, _, want in ROWS:
        assert _codes(decoded[k]["_issues"]) == sorted(want) and (decoded[k].value is None) == bool(want)
    shape = DEEP.to_struct_type()
    rows = spark.createDataFrame([(k, d["spans"], d.get("by_name"), d.get("one"), d.get("rows")) for k, d, _ in ROWS], f"k int, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in shape)}")
    marked = {r.k: _codes(r["_issues"]) for r in validate.annotate(rows, DEEP).collect()}
    assert marked == {k: sorted(want) for k, _, want in ROWS}
    assert all(r.truncated for r in validate.issues(rows.where("k = 2"), DEEP, "k", max_issues=2).collect())


def test_nulls_within(spark):
    rows = spark.createDataFrame([(1, [None, {"lo": None, "hi": 1}], {"x": None}, None, [None, [None]])], "k int, spans array<struct<lo:long,hi:long,note:string>>, byName map<string,struct<lo:long,hi:long,note:string>>, one struct<lo:long,hi:long,note:string>, rows array<array<struct<lo:long,hi:long,note:string>>>")
    assert _codes(validate.annotate(rows, DEEP).first()["_issues"]) == ["by_name.x:missing", "rows[0]:missing", "rows[1][0]:missing", "spans[0]:missing", "spans[1].lo:missing"]


ITEM = Schema("item", [Field("itemName", "string"), Field("unitPrice", "double", optional=True), Field("at", "timestamp", optional=True, dates=(dates.unix_millis,)), Field("kind", "string", cases=("a", "b"), enum="open", optional=True), Field("more", "map<string,variant>", extras=True, optional=True)], keys="snake", unknown="collect")
BOX = Schema("box", [Field("theItems", ArrayOf(ITEM)), Field("byKey", MapOf(ITEM)), Field("numbers", "array<double>"), Field("days", "array<timestamp>", optional=True), Field("matrix", "array<array<double>>", optional=True)], keys="snake")


def test_encoding_reaches_every_level(spark):
    item = "struct(string(n) AS itemName, double(p) AS unitPrice, timestamp_seconds(86400) AS at, k AS kind, map('z', parse_json('[1]'), 'a', parse_json('{\"b\":null}'), 'kind', parse_json('1')) AS more)"
    rows = spark.sql(f"""SELECT 1 AS k_, array(i, null) AS theItems, map('q"', i, 'b', i) AS byKey, array(1D, 1e20D, double('NaN'), null, -0.5D, 3e15D) AS numbers, array(timestamp_seconds(0), null) AS days,
        array(array(1D, double('Infinity')), array(), null) AS matrix FROM (SELECT {item} AS i FROM (SELECT 'é"' AS n, 2D AS p, 'a' AS k))""")
    got = encode.encode_json(rows, BOX).first()
    one = '{"item_name":"é\\"","unit_price":2,"at":86400000,"kind":"a","a":{"b":null},"z":[1]}'
    assert got.json == f'{{"the_items":[{one},null],"by_key":{{"b":{one},"q\\"":{one}}},"numbers":[1,1.0E20,null,null,-0.5,3000000000000000],"days":["1970-01-01T00:00:00Z",null],"matrix":[[1,null],[],null]}}'
    assert _codes(got.json_issues) == ["by_key.b.kind:extras_key_collision", 'by_key.q".kind:extras_key_collision', "matrix[0][1]:not_representable", "numbers[2]:not_representable", "the_items[0].kind:extras_key_collision"]
    pretty = encode.encode_json(rows, BOX, pretty=True).first().json
    assert js.loads(pretty) == js.loads(got.json) and pretty.startswith('{\n  "the_items": [\n    {\n      "item_name": ')
    bad = rows.withColumn("theItems", F.transform("theItems", lambda i: F.when(i.isNotNull(), i.withField("kind", F.lit("zz")))))
    refused = encode.encode_json(bad, BOX).first()
    assert refused.json is None and "the_items[0].kind:unknown_variant" in _codes(refused.json_issues)


def test_any_key_and_repeated_keys(spark):
    names = ["é", 'a"b', "q?", "it's", '"\'', "x.y", "[0]", " ", "日本", "back\\slash", "$"]
    schema = Schema("keys", [Field(f"f{k}", "long", key=n) for k, n in enumerate(names)])
    docs = [js.dumps(dict(zip(names, range(len(names)), strict=True)), ensure_ascii=e) for e in (True, False)] + ["{}"]
    rows = json.decode(spark.createDataFrame(list(enumerate(docs)), "k int, doc string"), schema, "doc").orderBy("k").collect()
    assert [list(r.value) for r in rows[:2]] == [list(range(len(names)))] * 2 and [i["path"] for i in rows[2]["_issues"]] == names
    again = Schema("again", [Field("a", "long"), Field("m", MapOf("long")), Field("v", "variant", optional=True)])
    docs = ['{"a": "x", "m": {"k": 1, "k": 2}, "a": 3}', '{"a": 1, "m": {}, "v": {"b": [{"c": 1, "c": 2}]}}', '{"a": 1, "m": {"a": 1}}', None, "{"]
    df = spark.createDataFrame(list(enumerate(docs)), "k int, doc string")
    rows = json.decode(df, again, "doc").orderBy("k").collect()
    assert rows[0].value.a == 3 and rows[0].value.m == {"k": 2}
    found = json.repeated_keys(df, "doc").orderBy("k").collect()
    assert [[(i["code"], i["path"], i["received"]) for i in r["_repeated"]] for r in found] == [[("duplicate_key", "m.k", "k"), ("duplicate_key", "a", "a")], [("duplicate_key", "v.b[0].c", "c")], [], [], []]


def test_unknown_keys_have_hints_where_they_are(spark):
    inner = Schema("inner", [Field("timeout", "long", optional=True)], unknown="reject")
    schema = Schema("outer", [Field("m", MapOf(inner)), Field("a", ArrayOf(ArrayOf(inner)), optional=True)], unknown="warn")
    doc = '{"m": {"x": {"tiemout": 1}}, "a": [[{"timeot": 2, "zzz": 1}]], "mm": 1}'
    df = json.decode(spark.createDataFrame([(1, doc)], "k int, doc string"), schema, "doc")
    row = df.first()
    hint = lambda i: (i["path"], i["received"], i["params"]["didYouMean"])
    assert sorted(map(hint, row["_issues"])) == [("a[0][0].timeot", "timeot", "timeout"), ("a[0][0].zzz", "zzz", None), ("m.x.tiemout", "tiemout", "timeout")]
    assert [hint(i) for i in row["_warnings"]] == [("mm", "mm", "m")]
    names = json.suggest(df.select(F.explode("_issues").alias("i")).select("i.*"), schema).collect()
    assert {r.path: r.did_you_mean for r in names} == {"a[0][0].timeot": "timeout", "a[0][0].zzz": None, "m.x.tiemout": "timeout"}


def _random_schema(rng, depth=0):
    def kind(depth):
        pick = rng.randrange(9 if depth < 2 else 5)
        if pick < 5:
            return ("string", "long", "double", "boolean", "timestamp")[pick]
        if pick < 7:
            return (ArrayOf, MapOf)[pick - 5](kind(depth + 1))
        return _random_schema(rng, depth + 1)

    return Schema(f"s{rng.randrange(10**6)}", [Field(f"fieldNo{k}", kind(depth), optional=rng.random() < 0.4) for k in range(rng.randint(1, 2))], keys=rng.choice(["camel", "snake", "kebab"]))


def _random_value(rng, type_):
    if isinstance(type_, Schema):
        return {f.name: None if f.optional and rng.random() < 0.3 else _random_value(rng, f.type) for f in type_.fields}
    if isinstance(type_, ArrayOf):
        return [_random_value(rng, type_.of) for _ in range(rng.randrange(3))]
    if isinstance(type_, MapOf):
        return {rng.choice(["k", "é", 'q"', "x.y", "", "a b"]): _random_value(rng, type_.of) for _ in range(rng.randrange(3))}
    return {"string": lambda: rng.choice(["", "é\n", '"\\', "\x01", "日本", "x" * 40]), "long": lambda: rng.choice([0, -1, 2**63 - 1, -(2**63), rng.getrandbits(40)]), "double": lambda: rng.choice([0.0, 0.1, -3.0, 1e300, 5e-324, 2.0**60, rng.gauss(0, 1e6)]), "boolean": lambda: rng.random() < 0.5, "timestamp": lambda: datetime(1970, 1, 1) + timedelta(seconds=rng.randint(-(10**9), 3 * 10**9))}[type_]()


@pytest.mark.parametrize("seed", range(3))
def test_what_is_encoded_reads_back(spark, seed):
    rng = random.Random(seed)
    schema = _random_schema(rng)
    rows = spark.createDataFrame([_random_value(rng, schema) for _ in range(30)], schema.to_struct_type())
    text = encode.encode_json(rows, schema)
    back = json.decode(text.select("json"), schema, "json")
    assert back.where(F.size("_issues") > 0).count() == 0 and text.where(F.size("json_issues") > 0).count() == 0
    assert sorted(map(str, back.select("value.*").collect())) == sorted(map(str, rows.collect()))

