"""Engine queries against DuckDB on the smallest tables, and declarations, formats and streams on small fixtures."""

from collections import Counter

import pytest

from rowwarden import rules as R
from rowwarden.functions import dates, formats
from rowwarden.functions.text import KEY_STYLES, nearest_name
from rowwarden.operators import validate
from rowwarden.plans.queries import ORACLE_SQL, QUERIES
from rowwarden.rules import SchemaError
from rowwarden.schema import Check, Field, Schema
from rowwarden.sources import columnar, json

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _bag(rows):
    shown = lambda v: "nan" if v != v else round(v, 6) if isinstance(v, float) else v
    return Counter(tuple(map(shown, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    found = duck.execute(ORACLE_SQL[name])
    own = [d[0] for d in found.description]
    assert sorted(own) == cols
    at = [own.index(c) for c in cols]
    assert _bag(df.select(*cols).collect()) == _bag(tuple(r[k] for k in at) for r in found.fetchall())


def test_declarations_that_mean_nothing_are_refused():
    for make in (
        lambda: Schema("s", [Field("a", "strin")]), lambda: Schema("s", [Field("a", "long"), Field("b", "long", key="a")]), lambda: Schema("s", [Field("a", "long", [R.email])]),
        lambda: Schema("s", [Field("a", "long")], unknown="collect"), lambda: Schema("s", [Field("a", "long")], checks=[Check("b", lambda r: None)]), lambda: R.regex("("), lambda: R.before("soon"),
        lambda: Schema("s", [Field(f"f{k}", "long") for k in range(65)]), lambda: Schema("s", [Field("a", "long", preprocess=["trim"])]),
    ):
        with pytest.raises(SchemaError):
            make()


def test_key_styles_and_nearest_names():
    assert KEY_STYLES["snake"]("avatarURL") == "avatar_url" and KEY_STYLES["snake"]("userID") == "user_id" and KEY_STYLES["kebab"]("loginCount") == "login-count"
    assert nearest_name("tiemout", ["retries", "timeout"]) == "timeout" and nearest_name("zz", ["timeout"]) is None and nearest_name("timeout", ["timeout"]) is None


def test_email_table(spark):
    good = ["a@example.com", "first.last@sub.example.co", "x+tag@example.io"]
    bad = ["plain", "@example.com", "a@", "a@local", "a..b@example.com", ".a@example.com", "a@-x.com", "a@1.2.3.4", "x" * 65 + "@example.com", "a@example.com\n"]
    df = spark.createDataFrame([(x,) for x in good + bad], "e string")
    found = {r[0] for r in df.where(formats.is_email(df.e)).collect()}
    assert found == set(good)


def test_golden_date(spark):
    df = spark.createDataFrame([("2026-08-06T12:00:00Z",), ("2026-08-06",), ("2026-02-30T00:00:00Z",), ("2026-08-06T12:00:00",)], "t string")
    assert [r[0] for r in df.select(dates.iso8601(df.t)).collect()] == [1786017600.0, None, None, None]


def test_signup_reports_every_issue(spark):
    schema = Schema("signup", [
        Field("username", "string", [R.min_(3), R.max_(20), R.regex("^[a-z]+$")]), Field("email", "string", [R.email]), Field("password", "string", [R.min_(12).or_("too weak")]),
        Field("age", "long", [R.range_(13, 120)]), Field("recipients", "array<string>", [R.count(1, 10), R.each(R.email)]),
    ])
    doc = '{"username": "A", "email": "x", "password": "p", "age": 5, "recipients": ["y"]}'
    row = json.decode(spark.createDataFrame([(doc,)], "doc string"), schema, "doc").first()
    assert row["value"] is None and len(row["_issues"]) == 6
    assert [i["path"] for i in row["_issues"]] == ["username", "username", "email", "password", "age", "recipients[0]"]


def test_documents_that_cannot_be_read(spark):
    schema = Schema("s", [Field("a", "long")])
    texts = [None, "", "{", '{"a": 1} {"a": 2}', "[1]", '{"a": ' + "[" * 80 + "]" * 80 + "}", '{"a": 1}', '{"a": 1.5}', '{"a": null}', "{}"]
    rows = json.decode(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, doc string"), schema, "doc").orderBy("k").collect()
    assert [[i["code"] for i in r["_issues"]] for r in rows] == [["malformed_document"]] * 3 + [["trailing_content"], ["malformed_document"], ["depth_exceeded"], [], ["type_mismatch"], ["type_mismatch"], ["missing"]]


def test_missing_column_is_one_issue(spark):
    schema = Schema("row", [Field("id", "long"), Field("name", "string")])
    values, found = columnar.batch(spark.range(1000), schema)
    assert values.count() == 0 and [f["path"] for f in found] == ["name"]


def test_split_and_cap(spark):
    schema = Schema("booking", [Field("start", "long"), Field("end", "long"), Field("guests", "long", [R.min_(1)])], checks=[Check("end", lambda r: R.F.when(r["end"] <= r["start"], "end before start"), code="order")])
    df = spark.range(500).selectExpr("id", "id AS start", "id - 1 AS end", "0L AS guests")
    good, bad = validate.split(df, schema)
    assert good.count() == 0 and bad.count() == 500
    rows, more = validate.capped(validate.issues(df, schema, "id"), "id", max_issues=10)
    assert rows.count() == 10 and more
    with pytest.raises(validate.InvalidRows):
        validate.assert_valid(df, schema, "id")


def test_stream_is_split_once(spark, tmp_path):
    from rowwarden.streaming import split_stream

    spark.range(20).selectExpr("id", "id % 4 AS v").write.parquet(str(tmp_path / "in"))
    schema = Schema("row", [Field("id", "long"), Field("v", "long", [R.positive])])
    for _ in range(2):
        stream = spark.readStream.schema("id long, v long").parquet(str(tmp_path / "in"))
        split_stream(stream, schema, str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "good")).count() == 15 and spark.read.parquet(str(tmp_path / "bad")).count() == 5
