"""Schemas as data, batches with limits, and places in bytes and dates."""

import pytest
from pyspark.sql import functions as F

from rowwarden import manifest, rules as R
from rowwarden.functions import dates
from rowwarden.functions.text import invalid_utf8_at
from rowwarden.operators import validate
from rowwarden.rules import SchemaError
from rowwarden.schema import ArrayOf, Check, Field, MapOf, Schema
from rowwarden.sources import columnar, json

INNER = Schema("inner", [Field("x", "long", [R.range_(1, 9)], default=3), Field("t", "string", [R.all_(R.not_empty, R.max_(5).or_("short")), R.regex("^a")], optional=True, preprocess=("trim",))], keys="kebab", unknown="reject")
WHOLE = Schema(
    "whole",
    [Field("id", "long", key="ID", aliases=("no",)), Field("tags", "array<string>", [R.count(0, 3), R.each(R.email), R.unique], default=[]), Field("at", "timestamp", [R.after("2000-01-01T00:00:00Z")], dates=(dates.iso8601, dates.pattern("dd/MM/yyyy"), dates.unix_seconds), optional=True),
     Field("in", ArrayOf(INNER)), Field("by", MapOf(ArrayOf(INNER)), optional=True), Field("kind", "string", cases=("a", "b"), enum="open", fallback="a"), Field("rest", "map<string,variant>", extras=True, optional=True), Field("gone", "string", ignore=True), Field("w", "array<long>", xml="wrapped", optional=True)],
    unknown="collect", coerce=True,
)
DOCS = ['{"ID": "1", "in": [{"x": 20, "t": " b"}], "tags": ["x"], "kind": 5, "z": 1}', '{"no": 2, "in": [], "at": "01/02/1999", "by": {"k": [{"t": "abcdefg", "q": 1}]}}', "{}"]


def test_a_manifest_decodes_alike(spark):
    again = manifest.loads(manifest.dumps(WHOLE))
    assert manifest.dumps(again) == manifest.dumps(WHOLE) and manifest.changes(WHOLE, again) == []
    docs = spark.createDataFrame([(d,) for d in DOCS], "doc string")
    shown = lambda schema: sorted(str((F_row["_issues"], F_row["_warnings"], F_row["value"] and F_row["value"].id)) for F_row in json.decode(docs, schema, "doc").collect())
    assert shown(WHOLE) == shown(again) and any("message='short'" in x or "'short'" in x for x in shown(again))


def test_tables_carry_their_contract(spark, tmp_path):
    schema = Schema("row", [Field("id", "long", [R.positive]), Field("name", "string", [R.min_(2)])], keys="snake")
    manifest.attach(spark.range(-2, 3).select("id", F.lit("x").alias("name"), F.lit(1).alias("other")), schema).write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    assert manifest.dumps(manifest.attached(read)) == manifest.dumps(schema) and manifest.attached(read.select("other")) is None
    assert validate.issues(read, manifest.attached(read)).count() == 3 + 5


def test_what_changed_and_what_is_code():
    new = Schema("whole", [*[f for f in WHOLE.fields if f.name not in ("tags", "in")], Field("in", ArrayOf(Schema("inner", [Field("x", "long", [R.range_(1, 10)], default=3), INNER.fields[1]], keys="kebab", unknown="reject"))), Field("more", "double")], unknown="collect", coerce=True)
    found = [(path, what) for path, what, _, _ in manifest.changes(WHOLE, new)]
    assert found == [("tags", "removed"), ("in", "type"), ("more", "added")] or ("more", "added") in found and ("tags", "removed") in found
    coded = Schema("s", [Field("a", "long", transform=lambda c: c + 1)], checks=[Check("a", lambda r: None)])
    data = manifest.encode(coded)
    with pytest.raises(SchemaError):
        manifest.decode(data)
    assert manifest.decode(data, checks=tuple(coded.checks), code={("a", "transform"): coded.fields[0].transform}).fields[0].transform is coded.fields[0].transform
    for bad in ({**data, "version": 9}, {"version": 1, "name": "s", "keys": "camel", "unknown": "ignore", "coerce": False, "fields": [{"name": "a", "type": "long", "rules": [{"rule": "nope"}]}]}):
        with pytest.raises(SchemaError):
            manifest.decode(bad)


def test_batches_have_limits_of_each_kind(spark):
    schema = Schema("s", [Field("a", "long", [R.min_(3), R.min_(5)])])
    rows = spark.range(100).select("id", (F.col("id") % 7).alias("a")).repartition(7)
    marked = validate.annotate(rows, schema).withColumn("_w", F.when(F.col("id") % 10 == 0, F.col("_issues")).otherwise(F.slice("_issues", 1, 0)))
    want = [(r.id, s, m) for r in marked.orderBy("id").collect() for s, m in enumerate(i["params"]["minimum"] for i in r["_issues"])]
    warned = [(i, s, m) for i, s, m in want if i % 10 == 0]
    for most, few in ((10, 3), (1, 100), (500, 0)):
        got = validate.collect_batch(marked, "id", warnings="_w", max_issues=most, max_warnings=few)
        shown = lambda found: [(r["id"], r["seq"], r["params"]["minimum"]) for r in found]
        assert shown(got.issues) == want[:most] and shown(got.warnings) == warned[:few]
        assert (got.n_rows, got.n_issues, got.n_warnings, got.n_failed) == (100, len(want), len(warned), len({i for i, _, _ in want}))
        assert got.issues_truncated == (len(want) > most) and got.warnings_truncated == (len(warned) > few)
    empty = validate.collect_batch(marked.limit(0), "id")
    assert (empty.issues, empty.n_rows, empty.n_issues, empty.issues_truncated) == ([], 0, 0, False)


def test_first_invalid_byte(spark):
    cases = [(b"", None), (b"abc\xc3\xa9", None), (b"a\xff", 1), (b"\xc0\x80", 0), (b"ab\xed\xa0\x80", 2), (b"a\xf4\x90\x80\x80", 1), (b"\xe2\x82", 0), (None, None)]
    df = spark.createDataFrame([(k, bytearray(b) if b is not None else None) for k, (b, _) in enumerate(cases)], "k int, b binary")
    assert [r[1] for r in sorted(df.select("k", invalid_utf8_at(F.col("b"))).collect())] == [w for _, w in cases]


def test_reasons_of_dates(spark):
    cases = [("2026-08-06T12:00:00Z", None, None), ("2026-02-29T00:00:00Z", 8, "day 29 is out of range for 2026-02"), ("2026-13-01T00:00:00Z", 5, "month 13 is out of range"), ("2026-01-01T24:00:00Z", 11, "hour 24 is out of range"), ("2026-01-01T00:60:00Z", 14, "minute 60 is out of range"), ("2026-01-01T00:00:61Z", 17, "second 61 is out of range"), ("2026-01-01T00:00:00+24:00", 20, "the zone is out of range"), ("2026-01-01T00:00:00", 19, "expected a zone"), ("2026-01-01T00:00:00Zx", 20, "expected the end"), ("", 0, "expected a year of 4 digits"), ("2026x", 4, "expected -"), (None, None, None)]
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(cases)], "k int, t string")
    assert [(r[1], r[2]) for r in sorted(df.select("k", *dates.iso_stop(F.col("t"))).collect(), key=lambda r: r[0])] == [c[1:] for c in cases]
    leap = spark.createDataFrame([("2016-12-31T23:59:60Z",), ("0000-01-01T00:00:00Z",), ("9999-12-31T23:59:59.5+00:00",)], "t string")
    assert [r[0] for r in leap.select(dates.iso8601(F.col("t"))).collect()] == [1483228800.0, -62167219200.0, 253402300799.5]
    issue = json.decode(spark.createDataFrame([('{"at": "2026-13-01T00:00:00Z"}',)], "doc string"), Schema("s", [Field("at", "timestamp")]), "doc").first()["_issues"][0]
    assert issue["code"] == "invalid_date" and issue["params"]["reason"] == "month 13 is out of range" and issue["params"]["offset"] == "5"


def test_bound_tables_preprocess_and_transform(spark):
    schema = Schema("row", [Field("name", "string", [R.max_(2)], preprocess=("trim", "lowercase"), transform=lambda c: F.concat(c, F.lit("!")))])
    values, _ = columnar.batch(spark.createDataFrame([(" X ",), ("LONG",)], "name string"), schema)
    assert sorted((r.name, len(r["_issues"])) for r in values.collect()) == [("long!", 1), ("x!", 0)]
