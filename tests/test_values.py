"""Reading values without a schema."""

from pyspark.sql import functions as F

from rowwarden.sources import values as V


def test_paths_types_and_repeated_keys(spark):
    docs = ['{"a": [1, 2.0, "3", null, true, {"b": 9223372036854775807}], "k": 1, "o": {"x y": [], "x y": {"é": 1}}, "k": "two"}', "[]", "{", None, '{"a": {"0": 1}}']
    df = V.parse(spark.createDataFrame(list(enumerate(docs)), "k int, doc string"), "doc", "v")
    v, a = F.col("v"), lambda k: V.at(F.col("v"), "a", k)
    row = df.orderBy("k").select(
        F.array(*[V.kind(a(k)) for k in range(7)]).alias("kinds"), F.array(*[V.as_int(a(k)) for k in range(6)]).alias("ints"), F.array(*[V.as_double(a(k)) for k in range(6)]).alias("doubles"),
        V.as_string(a(2)).alias("s"), V.as_bool(a(4)).alias("b"), V.is_null(a(3)).alias("n"), V.is_null(a(9)).alias("gone"), V.as_int(V.at(v, "a", 5, "b")).alias("deep"), V.as_int(a(-1)).alias("back"), F.size(V.items(V.at(v, "a"))).alias("size"),
        F.map_keys(V.members(V.at(v, "o"))).alias("keys"), F.transform(V.all_of(F.col("doc"), "", "k"), V.kind).alias("every"), F.transform(V.all_of(F.col("doc"), "o", "x y"), V.kind).alias("below"), V.as_int(V.at(v, "a", 0)).alias("none"),
    ).collect()
    first = row[0]
    assert first.kinds == ["int", "double", "string", "null", "bool", "object", None]
    assert first.ints[0] == 1 and first.ints[2:5] == [None] * 3 and first.doubles[:2] == [1.0, 2.0] and first.doubles[2] is None
    assert (first.s, first.b, first.n, first.gone, first.deep, first.back, first["size"]) == ("3", True, True, False, 2**63 - 1, None, 6)
    assert first["keys"] == ["x y"] and first.every == ["int", "string"] and first.below == ["array", "object"]
    assert [r.every for r in row[1:]] == [None, None, None, []] and row[4].none is None
