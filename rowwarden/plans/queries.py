"""Each query validates, decodes or encodes a whole table; ``ORACLE_SQL`` says the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import manifest
from .. import rules as R
from ..functions import coerce, dates
from ..functions.text import PREPROCESS, graphemes, invalid_utf8_at
from ..operators import encode, locate, render, validate
from ..schema import ArrayOf, Check, Field, MapOf, Schema
from ..sources import columnar, json, values, xml

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def found(df: DataFrame, key: str, *fields: Field, checks=()) -> DataFrame:
    """Key, path and code of every issue."""
    rows = df.select(key, *[f.name for f in fields if f.name != key])
    return validate.issues(rows, Schema("row", fields, checks=checks), key).select(key, "path", "code")


def codes(source: str, key: str, *tests: tuple[str, str, str]) -> str:
    """The SQL of :func:`found`: one select for each violation."""
    return " UNION ALL ".join(f"SELECT {key}, '{path}' AS path, '{code}' AS code FROM {source} WHERE {test}" for path, code, test in tests)


@query(codes("orders", "o_orderkey", ("o_totalprice", "not_in_range", "o_totalprice NOT BETWEEN 1000 AND 400000"), ("o_orderstatus", "not_one_of", "o_orderstatus NOT IN ('O', 'F')"), ("o_orderdate", "date_not_between", "o_orderdate NOT BETWEEN TIMESTAMP '1993-01-01' AND TIMESTAMP '1997-12-31'")))
def validate_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(table(spark, sf_dir, "orders"), "o_orderkey", Field("o_totalprice", "double", [R.range_(1000, 400000)]), Field("o_orderstatus", "string", [R.one_of("O", "F")]), Field("o_orderdate", "timestamp", [R.between("1993-01-01T00:00:00Z", "1997-12-31T00:00:00Z")]))


@query("SELECT l_orderkey, l_linenumber, 'l_discount' AS path, 'not_in_range' AS code FROM lineitem WHERE l_discount NOT BETWEEN 0.02 AND 0.08")
def rule_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    return validate.issues(rows, Schema("line", [Field("l_discount", "double", [R.range_(0.02, 0.08)])]), "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "path", "code")


@query(codes("orders", "o_orderkey", ("o_orderpriority", "not_one_of", "o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")))
def rule_one_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(table(spark, sf_dir, "orders"), "o_orderkey", Field("o_orderpriority", "string", [R.one_of("1-URGENT", "2-HIGH")]))


@query(codes("customer", "c_custkey", ("c_name", "pattern_mismatch", "NOT regexp_matches(c_name, '[02468]$')")))
def rule_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(table(spark, sf_dir, "customer"), "c_custkey", Field("c_name", "string", [R.regex(r"[02468]\z")]))


@query(codes("part", "p_partkey", ("p_name", "missing_prefix", "NOT starts_with(p_name, 'Part')"), ("p_name", "missing_suffix", "NOT ends_with(p_name, '7')"), ("p_type", "missing_substring", "NOT contains(p_type, 'E')")))
def rule_prefix_suffix_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(table(spark, sf_dir, "part"), "p_partkey", Field("p_name", "string", [R.prefix("Part"), R.suffix("7")]), Field("p_type", "string", [R.contains("E")]))


#: A line break of two characters is one cluster; the function of the SQL counts two in ASCII texts.
_ONE_BREAK = "replace(text, chr(13) || chr(10), chr(10))"


@query(codes(f"(SELECT doc_id, {_ONE_BREAK} AS text FROM documents)", "doc_id", ("text", "too_small", "length_grapheme(text) < 300"), ("text", "too_large", "length_grapheme(text) > 4000"), ("text", "wrong_length", "length_grapheme(text) <> 1000")))
def rule_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    return found(rows, "doc_id", Field("text", "string", [R.min_(300), R.max_(4000), R.length(1000)], optional=True))


@query(codes("pages", "page_id", ("url", "invalid_url", r"NOT regexp_full_match(url || CASE WHEN page_id % 7 = 0 THEN ' x' ELSE '' END, '[A-Za-z][A-Za-z0-9+.-]*:[^\x00-\x20\x7F]+')")))
def rule_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", F.concat("url", F.when(F.col("page_id") % 7 == 0, " x").otherwise("")).alias("url"))
    return found(rows, "page_id", Field("url", "string", [R.url]))


_HOST = "CASE c_custkey % 5 WHEN 0 THEN 'a-' || c_custkey || '.example.org' WHEN 1 THEN '-x.org' WHEN 2 THEN '1.2.3.' || (c_custkey % 200) WHEN 3 THEN 'ok.' ELSE 'a..b' END"
_HOST_OK = "len(list_filter(string_split(rtrim(h, '.'), '.'), lambda x: NOT regexp_full_match(x, '[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?'))) = 0 AND NOT regexp_matches(h, '(^|[.])[0-9]+[.]?$')"


def _hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", F.expr(_HOST).alias("h"))


@query(codes(f"(SELECT c_custkey, {_HOST} AS h FROM customer)", "c_custkey", ("h", "invalid_hostname", f"NOT ({_HOST_OK})")))
def rule_hostname(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(_hosts(spark, sf_dir), "c_custkey", Field("h", "string", [R.hostname]))


@query(codes(f"(SELECT c_custkey, {_HOST} AS h, CASE WHEN c_custkey % 3 = 0 THEN 'a..b' ELSE 'x+' || c_custkey END || '@' || {_HOST} AS e FROM customer)", "c_custkey", ("e", "invalid_email", f"NOT ({_HOST_OK}) OR c_custkey % 3 = 0 OR NOT contains(rtrim(h, '.'), '.')")))
def rule_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _hosts(spark, sf_dir).select("c_custkey", F.concat(F.when(F.col("c_custkey") % 3 == 0, "a..b").otherwise(F.concat(F.lit("x+"), F.col("c_custkey").cast("string"))), F.lit("@"), F.col("h")).alias("e"))
    return found(rows, "c_custkey", Field("e", "string", [R.email]))


_UUID = "substr(md5(c_name), 1, 8) || '-' || substr(md5(c_name), 9, 4) || '-' || substr(md5(c_name), 13, 4) || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '-' END || substr(md5(c_name), 17, 4) || '-' || substr(md5(c_name), 21, 12)"


@query(codes(f"(SELECT c_custkey, {_UUID} AS u FROM customer)", "c_custkey", ("u", "invalid_uuid", "NOT regexp_full_match(u, '[0-9A-Fa-f]{8}-([0-9A-Fa-f]{4}-){3}[0-9A-Fa-f]{12}')")))
def rule_uuid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(table(spark, sf_dir, "customer").select("c_custkey", F.expr(_UUID).alias("u")), "c_custkey", Field("u", "string", [R.uuid]))


@query(codes("documents", "doc_id", ("text", "not_ascii", r"NOT regexp_full_match(text, '[\x00-\x7F]*')"), ("text", "not_trimmed", r"regexp_matches(text, '^[ \t\n\r]|[ \t\n\r]$')"), ("text", "not_lowercased", "text <> lower(text)")))
def rule_text_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(table(spark, sf_dir, "documents"), "doc_id", Field("text", "string", [R.ascii_, R.trimmed, R.lowercased], optional=True))


_NUMBERS = "(SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN CAST('NaN' AS DOUBLE) WHEN c_custkey % 13 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE c_acctbal END AS b FROM customer)"


@query(codes(_NUMBERS, "c_custkey", ("b", "not_positive", "isnan(b) OR NOT b > 0"), ("b", "not_negative", "isnan(b) OR NOT b < 0"), ("b", "negative", "NOT isnan(b) AND b < 0"), ("b", "not_finite", "NOT isfinite(b)"), ("b", "too_large", "NOT isnan(b) AND b > 5000")))
def rule_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = F.when(F.col("c_custkey") % 11 == 0, float("nan")).when(F.col("c_custkey") % 13 == 0, float("inf")).otherwise(F.col("c_acctbal"))
    return found(table(spark, sf_dir, "customer").select("c_custkey", b.alias("b")), "c_custkey", Field("b", "double", [R.positive, R.negative, R.non_negative, R.finite, R.max_(5000)]))


@query("SELECT l_orderkey, l_linenumber, 'l_quantity' AS path, 'not_multiple' AS code FROM lineitem WHERE l_quantity % 7 <> 0")
def rule_multiple_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return validate.issues(rows, Schema("line", [Field("l_quantity", "double", [R.multiple_of(7)])]), "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "path", "code")


_WHOLE = "(SELECT doc_id, string_split(text, ' ') AS w FROM documents WHERE text IS NOT NULL)"


@query(codes(_WHOLE, "doc_id", ("w", "wrong_count", "len(w) NOT BETWEEN 20 AND 400"), ("w", "not_unique", "len(list_distinct(w)) <> len(w)")) + f" UNION ALL SELECT doc_id, 'w[' || (i - 1) || ']' AS path, 'too_small' AS code FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM {_WHOLE}) WHERE length_grapheme(w[i]) < 2")
def rule_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w"))
    schema = Schema("row", [Field("w", "array<string>", [R.count(20, 400), R.unique, R.each(R.min_(2))], optional=True)])
    every = validate.annotate(rows, schema, max_issues=2**31 - 1)  # a text can have an issue for every word
    return every.select("doc_id", F.explode("_issues").alias("i")).select("doc_id", "i.path", "i.code")


@query(codes("(SELECT l_orderkey * 10 + l_linenumber AS k, l_shipdate FROM lineitem)", "k", ("l_shipdate", "date_not_before", "NOT l_shipdate < TIMESTAMP '1997-01-01'"), ("l_shipdate", "date_not_after", "NOT l_shipdate > TIMESTAMP '1994-01-01'")))
def rule_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_shipdate")
    return found(rows, "k", Field("l_shipdate", "timestamp", [R.before("1997-01-01T00:00:00Z"), R.after("1994-01-01T00:00:00Z")]))


_PROPS = Schema("props", [Field("k", "long", [R.range_(10, 90)])])


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 10 AND 90 THEN 0 ELSE 1 END AS n_issues FROM events")
def decode_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of all documents, decoded once, and the issues of their rules."""
    rows = json.decode(table(spark, sf_dir, "events").select("event_id", "props"), Schema("props", [Field("k", "long")]), "props")
    marked = validate.annotate(rows.select("event_id", "value.k"), _PROPS)
    return marked.select("event_id", "k", F.size("_issues").alias("n_issues"))


_MADE = """CASE c_custkey % 6 WHEN 0 THEN '{"name": "' || c_name || '"}' WHEN 1 THEN '{"name": "' || c_name || '", "age": null}' WHEN 2 THEN '{"name": 7, "age": 3}'
 WHEN 3 THEN '{"age": 200, "nmae": "x"}' WHEN 4 THEN '{"name": "' || c_name || '", "age": "5"} x' ELSE '{"name": "' || c_name || '", "age": 5}' END"""


@query(f"""SELECT c_custkey, unnest(CASE c_custkey % 6 WHEN 0 THEN ['age:missing'] WHEN 1 THEN ['age:type_mismatch'] WHEN 2 THEN ['name:type_mismatch']
 WHEN 3 THEN ['name:missing', 'age:too_large', 'nmae:unknown_key'] WHEN 4 THEN [':trailing_content'] ELSE [] END) AS found FROM (SELECT *, {_MADE} AS doc FROM customer)""")
def presence_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = Schema("person", [Field("name", "string"), Field("age", "long", [R.max_(150)])], unknown="reject")
    rows = json.decode(table(spark, sf_dir, "customer").select("c_custkey", F.expr(_MADE).alias("doc")), schema, "doc")
    return rows.select("c_custkey", F.explode(F.transform("_issues", lambda i: F.concat(i["path"], F.lit(":"), i["code"]))).alias("found"))


@query("SELECT c_custkey, CAST(CASE c_custkey % 6 WHEN 2 THEN 3 WHEN 4 THEN NULL WHEN 5 THEN 5 ELSE 18 END AS BIGINT) AS age, c_custkey % 6 <> 4 AS accepted, c_custkey % 6 IN (0, 1, 3) AS fell_back FROM customer")
def defaults_and_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An absent, null or too large age falls back with a warning; a broken document has neither."""
    schema = Schema("person", [Field("age", "long", [R.max_(150)], default=18, fallback=18)])
    rows = json.decode(table(spark, sf_dir, "customer").select("c_custkey", F.expr(_MADE).alias("doc")), schema, "doc")
    fell_back = F.exists("_warnings", lambda w: w["code"] == "fallback_applied")
    return rows.select("c_custkey", "value.age", (F.size("_issues") == 0).alias("accepted"), fell_back.alias("fell_back"))


@query("SELECT event_type || 'x' AS path, event_type AS did_you_mean, count(*) AS n FROM events GROUP BY 1, 2")
def did_you_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["signup", "purchase", "view", "click", "error"]
    schema = Schema("event", [Field(n, "long", optional=True) for n in names], unknown="reject")
    docs = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{"'), F.col("event_type"), F.lit('x": 1}')).alias("doc"))
    bad = json.decode(docs, schema, "doc").select("event_id", F.explode("_issues").alias("i")).select("event_id", "i.*")
    return json.suggest(bad, schema).groupBy("path", "did_you_mean").agg(F.count(F.lit(1)).alias("n"))


_TEXTS = "CASE c_custkey % 7 WHEN 0 THEN '+' || c_custkey WHEN 1 THEN ' ' || c_custkey WHEN 2 THEN 'Yes' WHEN 3 THEN 'off' WHEN 4 THEN c_acctbal || '' WHEN 5 THEN '1e3' ELSE 't' END"


@query(f"""SELECT c_custkey, CASE WHEN regexp_full_match(t, '[+-]?[0-9]+') THEN TRY_CAST(t AS BIGINT) END AS l,
 CASE WHEN regexp_full_match(t, '[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(t AS DOUBLE) END AS d,
 CASE WHEN t IN ('true','True','TRUE','yes','Yes','YES','on','On','ON','1') THEN true WHEN t IN ('false','False','FALSE','no','No','NO','off','Off','OFF','0') THEN false END AS b
 FROM (SELECT c_custkey, {_TEXTS} AS t FROM customer)""")
def coerce_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_TEXTS.replace("c_acctbal || ''", "cast(c_acctbal as string)")).alias("t"))
    return rows.select("c_custkey", coerce.to_long(F.col("t")).alias("l"), coerce.to_double(F.col("t")).alias("d"), coerce.to_bool(F.col("t")).alias("b"))


@query("SELECT o_orderkey, epoch(o_orderdate) + CASE WHEN o_orderkey % 3 = 0 THEN -7200.0 ELSE 0.0 END AS iso, o_orderkey % 5 <> 0 AS ok FROM orders")
def dates_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    text = F.concat(at, F.when(F.col("o_orderkey") % 3 == 0, "+02:00").otherwise("z"))
    broken = F.when(F.col("o_orderkey") % 5 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(text)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"), broken.alias("broken"))
    return rows.select("o_orderkey", dates.iso8601(F.col("text")).alias("iso"), dates.iso8601(F.col("broken")).isNotNull().alias("ok"))


@query("SELECT o_orderkey, CAST(epoch(o_orderdate) AS DOUBLE) AS at, o_orderkey % 4 <> 0 AS late FROM orders")
def dates_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, F.date_format("o_orderdate", "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).when(k == 2, F.unix_seconds(F.col("o_orderdate").cast("timestamp")).cast("string")).otherwise(F.date_format("o_orderdate", "dd/MM/yyyy HH:mm:ss"))
    value, late = dates.chain(F.col("text"), (dates.iso8601, dates.http_date, dates.unix_seconds, dates.pattern("dd/MM/yyyy HH:mm:ss")))
    return table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text")).select("o_orderkey", value.alias("at"), late.alias("late"))


@query(r"SELECT conv_id, turn, translate(regexp_replace(regexp_replace('  ' || text || chr(10), '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g'), '[ \t\n\r]+', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM conversations")
def preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.concat(F.lit("  "), F.col("text"), F.lit("\n"))
    for step in ("trim", "collapse", "lowercase"):
        c = PREPROCESS[step](c)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", c.alias("text"))


@query("SELECT l_orderkey, l_linenumber, 'l_tax' AS path, 'tax_above_discount' AS code FROM lineitem WHERE l_tax > l_discount")
def check_cross_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    check = Check("l_tax", lambda r: F.when(r["l_tax"] > r["l_discount"], "tax is above the discount"), code="tax_above_discount")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_discount")
    return validate.issues(rows, Schema("line", [Field("l_tax", "double"), Field("l_discount", "double")], checks=[check]), "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber", "path", "code")


@query("SELECT o_orderkey, 'unknown_customer' AS code FROM orders o WHERE o_totalprice >= 50000 AND NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal > 0)")
def lookup_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = validate.split(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), Schema("order", [Field("o_totalprice", "double", [R.min_(50000)])]))
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey")
    return validate.lookup_check(good, known, F.col("o_custkey") == F.col("c_custkey"), taken=False, code="unknown_customer", path="o_custkey").select("o_orderkey", "issue.code")


@query("SELECT path, code, count(*) AS n FROM (SELECT 'l_quantity' AS path, 'not_in_range' AS code FROM lineitem WHERE l_quantity NOT BETWEEN 5 AND 45 UNION ALL SELECT 'l_tax', 'too_large' FROM lineitem WHERE l_tax > 0.05 UNION ALL SELECT 'l_returnflag', 'not_one_of' FROM lineitem WHERE l_returnflag NOT IN ('A', 'N') UNION ALL SELECT 'l_shipdate', 'date_not_after' FROM lineitem WHERE NOT l_shipdate > TIMESTAMP '1993-01-01' UNION ALL SELECT 'l_extendedprice', 'too_small' FROM lineitem WHERE l_extendedprice < 2000) GROUP BY 1, 2")
def validate_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = Schema("line", [Field("l_quantity", "double", [R.range_(5, 45)]), Field("l_tax", "double", [R.max_(0.05)]), Field("l_returnflag", "string", [R.one_of("A", "N")]), Field("l_linestatus", "string", [R.not_empty]), Field("l_shipdate", "timestamp", [R.after("1993-01-01T00:00:00Z")]), Field("l_extendedprice", "double", [R.min_(2000)])])
    rows = table(spark, sf_dir, "lineitem").select(*[f.name for f in schema.fields])
    return validate.counts(validate.issues(rows, schema))


@query("SELECT c_custkey AS id, c_name AS name, coalesce(CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_acctbal AS BIGINT) END, -1) AS balance, CASE WHEN coalesce(CASE WHEN c_custkey % 4 <> 0 THEN CAST(c_acctbal AS BIGINT) END, -1) < 0 THEN 1 ELSE 0 END AS n FROM customer WHERE c_custkey % 9 <> 0")
def columnar_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = Schema("account", [Field("id", "long", key="c_custkey"), Field("name", "string", key="c_name"), Field("balance", "long", [R.non_negative], default=-1), Field("note", "string", optional=True)])
    balance = F.when(F.col("c_custkey") % 4 != 0, F.rint("c_acctbal").cast("long"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_name")).alias("c_name"), balance.alias("balance"))
    values, _ = columnar.batch(rows, schema)
    return values.select("id", "name", "balance", F.size("_issues").alias("n"))


@query("SELECT c_custkey, c_name AS name, c_acctbal AS balance, c_custkey % 5 = 0 AS absent FROM customer")
def encode_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = Schema("account", [Field("accountName", "string"), Field("openBalance", "double"), Field("note", "string", optional=True)], keys="snake")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("accountName"), F.col("c_acctbal").alias("openBalance"), F.when(F.col("c_custkey") % 5 != 0, "n").alias("note"))
    text = encode.encode_json(rows, schema)
    back = json.decode(text.select("c_custkey", "json"), schema, "json")
    return back.select("c_custkey", F.col("value.accountName").alias("name"), F.col("value.openBalance").alias("balance"), F.col("value.note").isNull().alias("absent"))


_SAID = [("o_totalprice > 400000", "must be at most 400000"), ("o_totalprice < 1000", "must be at least 1000"), ("o_orderstatus NOT IN ('O', 'F')", "must be one of \"O\", \"F\""), ("NOT ends_with(o_orderpriority, 'H')", "must end with H"), ("NOT contains(o_orderpriority, '-')", "must contain -"), ("o_custkey % 2 <> 0", "must be a multiple of 2")]


@query(" UNION ALL ".join(f"SELECT o_orderkey, '{text}' AS message FROM orders WHERE {test}" for test, text in _SAID))
def render_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence of every issue, parameters filled in."""
    schema = Schema("order", [Field("o_totalprice", "double", [R.max_(400000), R.min_(1000)]), Field("o_orderstatus", "string", [R.one_of("O", "F")]), Field("o_orderpriority", "string", [R.suffix("H"), R.contains("-")]), Field("o_custkey", "long", [R.multiple_of(2)])])
    rows = validate.annotate(table(spark, sf_dir, "orders").select("o_orderkey", *[f.name for f in schema.fields]), schema)
    return rows.select("o_orderkey", F.explode("_issues").alias("i")).select("o_orderkey", render.message_column(F.col("i")).alias("message"))


@query(f"SELECT doc_id, CAST(length_grapheme({_ONE_BREAK}) AS BIGINT) AS n FROM documents")
def grapheme_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", graphemes(F.col("text")).cast("long").alias("n"))


_NESTED = """CASE c_custkey % 5 WHEN 0 THEN '{"a": [{"x": [1, 2]}, {"x": [3]}], "m": {"k": {"x": [4]}}}' WHEN 1 THEN '{"a": [{"x": [1, "b"]}, 7], "m": {"k": {}}}'
 WHEN 2 THEN '{"a": ' || repeat('[', 70) || repeat(']', 70) || ', "m": {}}' WHEN 3 THEN '{"a": [' || repeat('{"x": []},', 80) || '{"x": [' || c_custkey || ']}], "m": {}}' ELSE '{"a": [], "m": {}}' || repeat(' }', CAST(c_custkey % 2 AS INT)) END"""


@query(f"""SELECT c_custkey, unnest(CASE c_custkey % 5 WHEN 1 THEN ['a[0].x[1]:type_mismatch', 'a[1]:type_mismatch', 'm.k.x:missing'] WHEN 2 THEN [':depth_exceeded']
 WHEN 4 THEN (CASE WHEN c_custkey % 2 = 1 THEN [':trailing_content'] ELSE ['none'] END) ELSE ['none'] END) AS found FROM (SELECT *, {_NESTED.replace('CAST(c_custkey % 2 AS INT)', 'c_custkey % 2')} AS doc FROM customer)""")
def decode_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of schemas with arrays, maps of schemas, nesting and trailing content: every issue with its path."""
    inner = Schema("inner", [Field("x", "array<long>")])
    schema = Schema("outer", [Field("a", ArrayOf(inner)), Field("m", MapOf(inner))])
    rows = json.decode(table(spark, sf_dir, "customer").select("c_custkey", F.expr(_NESTED).alias("doc")), schema, "doc")
    found = F.transform("_issues", lambda i: F.concat(i["path"], F.lit(":"), i["code"]))
    return rows.select("c_custkey", F.explode(F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("none")))).alias("found"))


@query("SELECT event_id, event_type AS path, CASE event_type WHEN 'clikc' THEN 'click' WHEN 'vew' THEN 'view' END AS hint FROM (SELECT event_id, CASE WHEN event_type = 'click' THEN 'clikc' WHEN event_type = 'view' THEN 'vew' ELSE event_type END AS event_type FROM events) WHERE event_type NOT IN ('signup', 'click', 'view')")
def enum_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts outside a closed enum, with the nearest case."""
    text = F.when(F.col("event_type") == "click", "clikc").when(F.col("event_type") == "view", "vew").otherwise(F.col("event_type"))
    schema = Schema("event", [Field("t", "string", cases=("signup", "click", "view"))])
    rows = validate.issues(table(spark, sf_dir, "events").select("event_id", text.alias("t")), schema, "event_id")
    return rows.select("event_id", F.col("received").alias("path"), F.try_element_at("params", F.lit("didYouMean")).alias("hint"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 <> 1 THEN '{"account_name":"' || c_name || '","kind":"' || CASE c_custkey % 3 WHEN 0 THEN 'a' ELSE 'b' END || '","note":' || CASE WHEN c_custkey % 2 = 0 THEN '"n"' ELSE 'null' END || '}' END AS json,
 CASE WHEN c_custkey % 3 = 1 THEN 'kind:unknown_variant' ELSE '' END AS found FROM customer""")
def encode_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The very text of encoded rows: order and style of keys, null for what is absent, an open enum that doesn't round-trip."""
    schema = Schema("account", [Field("accountName", "string"), Field("kind", "string", cases=("a", "b"), enum="open"), Field("note", "string", optional=True)], keys="snake")
    kind = F.element_at(F.array(F.lit("a"), F.lit("z"), F.lit("b")), (F.col("c_custkey") % 3 + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("accountName"), kind.alias("kind"), F.when(F.col("c_custkey") % 2 == 0, "n").alias("note"))
    done = encode.encode_json(rows, schema)
    return done.select("c_custkey", "json", F.array_join(F.transform("json_issues", lambda i: F.concat(i["path"], F.lit(":"), i["code"])), ",").alias("found"))


@query("SELECT c_custkey, '[' || c_custkey || '].c_name' AS path, 'missing' AS code FROM customer WHERE c_custkey % 9 = 0 UNION ALL SELECT c_custkey, '[' || c_custkey || '].c_acctbal', 'missing' FROM customer WHERE c_acctbal <> trunc(c_acctbal)")
def row_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that a bound table lacks or that don't narrow exactly, by row."""
    schema = Schema("account", [Field("name", "string", key="c_name"), Field("balance", "long", key="c_acctbal")])
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 != 0, F.col("c_name")).alias("c_name"), "c_acctbal")
    return columnar.missing_values(rows, schema, "c_custkey").select("c_custkey", "path", "code")


@query("SELECT o_orderkey, CAST(epoch(o_orderdate) AS DOUBLE) AS old, CAST(epoch(o_orderdate) AS DOUBLE) AS asc, CAST(epoch(o_orderdate) AS DOUBLE) AS millis, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM orders")
def dates_other_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RFC 850, asctime and milliseconds back to the same instant, and its ISO text."""
    at = F.col("o_orderdate").cast("timestamp")
    old, asc = F.date_format(at, "EEEE, dd-MMM-yy HH:mm:ss 'GMT'"), F.concat(F.date_format(at, "EEE MMM "), F.lpad(F.date_format(at, "d"), 2, " "), F.date_format(at, " HH:mm:ss yyyy"))
    millis = (F.unix_seconds(at) * 1000).cast("string")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", old.alias("old"), asc.alias("asc"), millis.alias("millis"), dates.iso_text(F.unix_seconds(at)).alias("iso"))
    return rows.select("o_orderkey", dates.http_date(F.col("old")).alias("old"), dates.http_date(F.col("asc")).alias("asc"), dates.unix_millis(F.col("millis")).alias("millis"), "iso")


@query("SELECT c_custkey, unnest(list_filter(['a:empty', CASE WHEN c_custkey % 2 = 0 THEN 'b:too_small' END, CASE WHEN c_custkey % 2 = 0 THEN 'b:wrong_length' END], lambda x: x IS NOT NULL AND (x <> 'a:empty' OR c_custkey % 4 = 0))) AS found FROM customer")
def rule_composed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emptiness, and a conjunction of rules."""
    schema = Schema("row", [Field("a", "string", [R.not_empty]), Field("b", "string", [R.all_(R.min_(3), R.length(3))])])
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 4 == 0, "").otherwise("x").alias("a"), F.when(k % 2 == 0, "yz").otherwise("xyz").alias("b"))
    return validate.issues(rows, schema, "c_custkey").select("c_custkey", F.concat("path", F.lit(":"), "code").alias("found"))


@query("""SELECT c_custkey, '<account id="' || c_custkey || '"><name>' || replace(replace(replace(c_name || t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</name>' || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE '<note>n</note>' END
 || CASE WHEN c_custkey % 2 = 0 THEN '<tag>a</tag><tag>b</tag>' ELSE '' END || '<codes><item>1</item><item>2</item></codes><at unit="m">7</at></account>' AS xml FROM (SELECT *, CASE WHEN c_custkey % 5 = 0 THEN ' <&> "q"' ELSE '' END AS t FROM customer)""")
def encode_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of rows as XML: attributes, elements, repeated siblings, wrapped items, content beside attributes; absent ones left out."""
    at = Schema("at", [Field("unit", "string", xml="attribute"), Field("value", "long", xml="text")])
    schema = Schema("account", [Field("id", "long", xml="attribute"), Field("name", "string"), Field("note", "string", optional=True), Field("tag", "array<string>"), Field("codes", "array<long>", xml="wrapped"), Field("at", at)])
    k = F.col("c_custkey")
    name = F.concat("c_name", F.when(k % 5 == 0, ' <&> "q"').otherwise(""))
    tags = F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", k.alias("id"), name.alias("name"), F.when(k % 3 != 0, "n").alias("note"), tags.alias("tag"), F.array(F.lit(1), F.lit(2)).alias("codes"), F.struct(F.lit("m").alias("unit"), F.lit(7).alias("value")).alias("at"))
    return encode.encode_xml(rows, schema).select("c_custkey", "xml")


@query("""SELECT o_orderkey, '{"source":"orders","valid":' || CASE WHEN o_totalprice > 300000 THEN 'false' ELSE 'true' END || ',"issues":[' || CASE WHEN o_totalprice > 300000 THEN '{"path":"o_totalprice","code":"too_large","message":"must be at most 300000","params":{"maximum":"300000"},"received":"' || CAST(o_totalprice AS VARCHAR) || '"}' ELSE '' END || '],"warnings":[]}' AS report FROM orders""")
def render_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The issues of each row as one JSON text."""
    schema = Schema("order", [Field("o_totalprice", "double", [R.max_(300000)])])
    rows = validate.annotate(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), schema)
    return rows.select("o_orderkey", render.report("orders", F.col("_issues")).alias("report"))


_ORDER = """'{"note": "é", "key": ' || o_orderkey || ', "cust":  ' || o_custkey || ',@"priority": "' || o_orderpriority || '"}'"""
_ORDER_SCHEMA = Schema("order", [Field("priority", "string", [R.one_of("1-URGENT", "2-HIGH")]), Field("key", "long"), Field("cust", "long", [R.range_(1, 700)])])


@query(f"""SELECT o_orderkey, 'cust' AS path, 'not_in_range' AS code, CAST(strlen(substr(doc, 1, instr(doc, ':  ') + 2)) AS BIGINT) AS "offset", CAST(strlen(CAST(o_custkey AS VARCHAR)) AS BIGINT) AS length FROM (SELECT *, {_ORDER.replace('@', ' ')} AS doc FROM orders) WHERE o_custkey NOT BETWEEN 1 AND 700
 UNION ALL SELECT o_orderkey, 'priority', 'not_one_of', CAST(strlen(substr(doc, 1, instr(doc, 'priority": ') + 10)) AS BIGINT), CAST(strlen(o_orderpriority) + 2 AS BIGINT) FROM (SELECT *, {_ORDER.replace('@', ' ')} AS doc FROM orders) WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')""")
def issue_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of the value that each issue is about."""
    rows = json.decode(table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_ORDER.replace("@", " ")).alias("doc")), _ORDER_SCHEMA, "doc")
    return locate.locate(rows, "doc").select("o_orderkey", F.explode("_issues").alias("i")).select("o_orderkey", "i.path", "i.code", "i.offset", "i.length")


_LINES = _ORDER.replace("@", "' || chr(10) || '")


@query(f"""WITH d AS (SELECT *, {_LINES} AS doc FROM orders),
i AS (SELECT o_orderkey, 'cust' AS path, 1 AS line, strlen(substr(doc, 1, instr(doc, ':  ') + 2)) + 1 AS col, '  1 │ ' || string_split(doc, chr(10))[1] || chr(10) || '    │ ' || repeat(' ', CAST(strlen(substr(doc, 1, instr(doc, ':  ') + 2)) AS INT)) || repeat('^', CAST(strlen(CAST(o_custkey AS VARCHAR)) AS INT)) || chr(10) || '  2 │ ' || string_split(doc, chr(10))[2] AS excerpt FROM d WHERE o_custkey NOT BETWEEN 1 AND 700
 UNION ALL SELECT o_orderkey, 'priority', 2, 13, '  1 │ ' || string_split(doc, chr(10))[1] || chr(10) || '  2 │ ' || string_split(doc, chr(10))[2] || chr(10) || '    │ ' || repeat(' ', 12) || repeat('^', CAST(strlen(o_orderpriority) + 2 AS INT)) FROM d WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH'))
SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY line) - 1 AS INT) AS seq, path, CAST(line AS BIGINT) AS line, CAST(col AS BIGINT) AS "column", excerpt FROM i""")
def issue_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines, columns and excerpts of issues, in order of position and not of declaration."""
    rows = json.decode(table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_LINES.replace("chr(10)", "char(10)")).alias("doc")), _ORDER_SCHEMA, "doc")
    found = locate.locate(rows, "doc", excerpts=True).select("o_orderkey", F.posexplode("_issues").alias("seq", "i"))
    return found.select("o_orderkey", "seq", "i.path", "i.line", "i.column", "i.excerpt")


_LINE = Schema("line", [Field("lineNumber", "long"), Field("quantity", "double", [R.range_(5, 45)]), Field("discount", "double", [R.max_(0.08)]), Field("tax", "double")], keys="snake", checks=[Check("tax", lambda r: F.when(r["tax"] > r["discount"], "is above the discount"), code="above_discount")])
_LINES_OF = Schema("order", [Field("orderKey", "long"), Field("orderLines", ArrayOf(_LINE), [R.count(1, 6)]), Field("byNumber", MapOf(_LINE))], keys="snake")


def _order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines in an array in order of number, and in a map by number."""
    line = F.struct(F.col("l_linenumber").cast("long").alias("lineNumber"), F.col("l_quantity").cast("double").alias("quantity"), F.col("l_discount").cast("double").alias("discount"), F.col("l_tax").cast("double").alias("tax"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("long").alias("orderKey")).agg(F.sort_array(F.collect_list(line)).alias("orderLines"))
    firsts = F.array_distinct(F.transform("orderLines", lambda x: x["lineNumber"]))
    return rows.withColumn("byNumber", F.map_from_arrays(F.transform(firsts, lambda n: F.concat(F.lit("n"), n.cast("string"))), F.transform(firsts, lambda n: F.get(F.filter("orderLines", lambda x: x["lineNumber"] == n), F.lit(0)))))


_NUMBERED = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_discount, l_tax) - 1 AS k, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_quantity, l_discount, l_tax) AS again FROM lineitem)"
_PLACED = f"(SELECT *, 'order_lines[' || k || ']' AS spot FROM {_NUMBERED} UNION ALL SELECT *, 'by_number.n' || l_linenumber FROM {_NUMBERED} WHERE again = 1)"


@query(f"""SELECT l_orderkey AS order_key, spot || '.quantity' AS path, 'not_in_range' AS code FROM {_PLACED} WHERE l_quantity NOT BETWEEN 5 AND 45 UNION ALL SELECT l_orderkey, spot || '.discount', 'too_large' FROM {_PLACED} WHERE l_discount > 0.08
 UNION ALL SELECT l_orderkey, spot || '.tax', 'above_discount' FROM {_PLACED} WHERE l_tax > l_discount UNION ALL SELECT l_orderkey, 'order_lines', 'wrong_count' FROM lineitem GROUP BY l_orderkey HAVING count(*) > 6""")
def validate_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and checks of the lines of every order, in an array and in a map."""
    found = validate.issues(_order_lines(spark, sf_dir), _LINES_OF, "orderKey", max_issues=2**31 - 1)
    return found.select(F.col("orderKey").alias("order_key"), "path", "code")


_SHOWN = "'{\"line_number\":' || l_linenumber || ',\"quantity\":' || CAST(l_quantity AS BIGINT) || ',\"discount\":' || CASE WHEN l_discount = 0 THEN '0' ELSE CAST(l_discount AS VARCHAR) END || ',\"tax\":' || CASE WHEN l_tax = 0 THEN '0' ELSE CAST(l_tax AS VARCHAR) END || '}'"


@query(f"""SELECT l_orderkey AS order_key, '{{"order_key":' || l_orderkey || ',"order_lines":[' || string_agg({_SHOWN}, ',' ORDER BY k) || '],"by_number":{{' || string_agg('"n' || l_linenumber || '":' || {_SHOWN}, ',' ORDER BY 'n' || l_linenumber) FILTER (WHERE again = 1) || '}}}}' AS json FROM {_NUMBERED} GROUP BY l_orderkey""")
def encode_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The JSON text of orders with their lines: keys, numbers and order of maps at every level."""
    return encode.encode_json(_order_lines(spark, sf_dir), _LINES_OF).select(F.col("orderKey").alias("order_key"), "json")


@query("SELECT count(DISTINCT l_orderkey) AS n, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS made, CAST(0 AS BIGINT) AS refused FROM lineitem")
def roundtrip_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is encoded reads back: orders that don't come back, and orders that come back changed."""
    loose = Schema("order", [Field("orderKey", "long"), Field("orderLines", ArrayOf(Schema("line", [Field(f.name, f.type) for f in _LINE.fields], keys="snake"))), Field("byNumber", MapOf(Schema("line", [Field(f.name, f.type) for f in _LINE.fields], keys="snake")))], keys="snake")
    rows = encode.encode_json(_order_lines(spark, sf_dir), loose)
    return _compared(json.decode(rows, loose, "json"))


def _compared(read: DataFrame) -> DataFrame:
    """How many rows came back, were lost, made and refused, for orders beside the ``value`` that was read of each.

    Rows that equal what was read of them come off both sides alike; only others are counted as sets with repeats.
    """
    entries = lambda m: F.array_sort(F.map_entries(m))
    side = lambda key, lines, named: F.struct(F.col(key).alias("orderKey"), F.col(lines).alias("orderLines"), entries(named).alias("entries"))
    both = read.select(F.when(F.size("_issues") > 0, 1).otherwise(0).alias("refused"), side("orderKey", "orderLines", "byNumber").alias("sent"), side("value.orderKey", "value.orderLines", "value.byNumber").alias("got"))
    part = lambda side, n, refused, row: F.struct(F.lit(side).alias("side"), F.lit(n).alias("back"), refused.alias("refused"), row.alias("row"))
    none, refused, sent, got = F.lit(0), F.col("refused"), F.col("sent"), F.col("got")
    alike = F.array(part(0, 1, refused, F.when(F.lit(False), sent)))
    parts = both.select(F.explode(F.when(sent.eqNullSafe(got), alike).otherwise(F.array(part(1, 0, none, sent), part(-1, 1, refused, got)))).alias("p")).select("p.*")
    over = parts.groupBy("row").agg(F.sum("side").alias("over"), F.sum("back").alias("back"), F.sum("refused").alias("refused"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return over.agg(total("back").alias("n"), total(F.greatest("over", F.lit(0))).alias("lost"), total(F.greatest(-F.col("over"), F.lit(0))).alias("made"), total("refused").alias("refused"))


_KEYS = """'{"é": ' || c_custkey || ', "a\\\\"b": "' || c_name || '", "m": {"k": 1, "x": ' || c_nationkey || ', "k": ' || c_nationkey || '}, "é": ' || (c_custkey + 1) || CASE WHEN c_custkey % 3 = 0 THEN '}' ELSE ', "q?": [' || c_custkey || ', ' || c_custkey || '.5]}' END"""


@query("SELECT c_custkey, CAST(c_custkey + 1 AS BIGINT) AS e, c_name AS quoted, CAST(c_nationkey AS BIGINT) AS k, CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey + 0.5 AS DOUBLE) END AS q FROM customer")
def decode_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of any characters, and the last value of those that repeat, in structs and in maps."""
    schema = Schema("keys", [Field("e", "long", key="é"), Field("quoted", "string", key='a"b'), Field("m", MapOf("long")), Field("q", "array<double>", key="q?", optional=True)])
    rows = json.decode(table(spark, sf_dir, "customer").select("c_custkey", F.expr(_KEYS).alias("doc")), schema, "doc")
    return rows.select("c_custkey", "value.e", "value.quoted", F.element_at("value.m", "k").alias("k"), F.get("value.q", F.lit(1)).alias("q"))


@query("SELECT c_custkey, unnest(['m.k', 'é']) AS path, unnest(['k', 'é']) AS received FROM customer")
def decode_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every key that its object repeats."""
    rows = json.repeated_keys(table(spark, sf_dir, "customer").select("c_custkey", F.expr(_KEYS).alias("doc")), "doc")
    return rows.select("c_custkey", F.explode("_repeated").alias("i")).select("c_custkey", "i.path", "i.received")


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, 'int' AS kind, CAST(NULL AS VARCHAR) AS text, CAST(NULL AS BIGINT) AS whole, event_id + 0.5 AS half, event_type AS second, event_id || ',2' AS every, event_id % 2 = 0 AS absent FROM events""")
def value_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed reading along paths of keys and indexes: no integer from a double, no text from a number, all values of a repeated key."""
    made = F.expr("""'{"p": ' || props || ', "a": [' || event_id || '.5, {"b": [null, "' || event_type || '"]}], "r": ' || event_id || ', "r": 2' || CASE WHEN event_id % 2 = 0 THEN '}' ELSE ', "z": null}' END""")
    rows = table(spark, sf_dir, "events").select("event_id", made.alias("doc"))
    v = F.col("v")
    half = values.at(v, "a", 0)
    return values.parse(rows, "doc", "v").select(
        "event_id", values.as_int(values.at(v, "p", "k")).alias("k"), values.kind(values.at(v, "p", "k")).alias("kind"), values.as_string(values.at(v, "r")).alias("text"), values.as_int(half).alias("whole"), values.as_double(half).alias("half"),
        values.as_string(values.at(v, "a", 1, "b", 1)).alias("second"), F.array_join(F.transform(values.all_of(F.col("doc"), "", "r"), values.as_int), ",").alias("every"), (~values.is_null(values.at(v, "z"))).alias("absent"),
    )


_BOX = Schema("order", [Field("id", "long", xml="attribute"), Field("status", "string", [R.one_of("O", "F")]), Field("total", Schema("total", [Field("unit", "string", xml="attribute"), Field("cents", "long", xml="text")])), Field("keys", "array<long>", xml="wrapped"), Field("tag", "array<string>"), Field("byName", MapOf("long"))], keys="snake")


@query("""SELECT o_orderkey AS id, o_orderstatus AS status, CAST(round(o_totalprice) AS BIGINT) AS cents, 'u' AS unit, o_custkey || ',' || o_orderkey AS keys, CASE WHEN o_orderkey % 2 = 0 THEN 'a,b' ELSE '' END AS tags, CAST(o_custkey AS BIGINT) AS named, o_orderkey % 5 = 0 AS refused
 FROM (SELECT * REPLACE (CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus END AS o_orderstatus) FROM orders WHERE o_orderstatus IN ('O', 'F'))""")
def decode_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as XML and read back by placement; every fifth has its status where no field is."""
    k = F.col("o_orderkey").cast("long")
    total = F.struct(F.lit("u").alias("unit"), F.expr("cast(round(o_totalprice) as bigint)").alias("cents"))
    rows = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "F")).select(
        k.alias("id"), F.col("o_orderstatus").alias("status"), total.alias("total"), F.array(F.col("o_custkey").cast("long"), k).alias("keys"),
        F.when(k % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("tag"), F.create_map(F.lit("n"), F.col("o_custkey").cast("long")).alias("byName"),
    )
    text = encode.encode_xml(rows, _BOX).select("id", F.when(F.col("id") % 5 == 0, F.replace("xml", F.lit("status>"), F.lit("state>"))).otherwise(F.col("xml")).alias("xml"))
    loose = Schema("order", [replace(f, optional=True, rules=()) if f.name == "status" else replace(f, default=[]) if f.name == "tag" else f for f in _BOX.fields], keys="snake")
    v = xml.decode(text, loose, "xml").select("value.*")
    return v.select("id", "status", "total.cents", "total.unit", F.array_join("keys", ",").alias("keys"), F.array_join("tag", ",").alias("tags"), F.col("byName")["n"].alias("named"), F.col("status").isNull().alias("refused"))


@query(codes("lineitem", "l_orderkey", ("l_quantity", "not_in_range", "l_quantity NOT BETWEEN 5 AND 45"), ("l_returnflag", "not_one_of", "l_returnflag NOT IN ('A', 'N')"), ("l_shipdate", "date_not_after", "NOT l_shipdate > TIMESTAMP '1993-01-01'"), ("l_tax", "too_large", "l_tax > 0.05")))
def manifest_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines validated by the contract that their table's own columns carry, read back from text."""
    schema = Schema("line", [Field("l_quantity", "double", [R.range_(5, 45)]), Field("l_returnflag", "string", [R.one_of("A", "N")]), Field("l_shipdate", "timestamp", [R.all_(R.after("1993-01-01T00:00:00Z"))]), Field("l_tax", "double", [R.max_(0.05).or_("is too high")], default=0.0)])
    rows = manifest.attach(table(spark, sf_dir, "lineitem"), manifest.loads(manifest.dumps(schema)))
    return validate.issues(rows, manifest.attached(rows), "l_orderkey").select("l_orderkey", "path", "code")


@query("""WITH i AS (SELECT o_orderkey, 'o_totalprice' AS path, 0 AS f FROM orders WHERE o_totalprice < 50000 UNION ALL SELECT o_orderkey, 'o_custkey', 1 FROM orders WHERE o_custkey % 2 = 0)
SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY f) - 1 AS INT) AS seq, path, (SELECT count(*) FROM i) AS n_issues, (SELECT count(*) FROM orders) AS n_rows, (SELECT count(DISTINCT o_orderkey) FROM i) AS n_failed, (SELECT count(*) FROM i) > 50 AS truncated FROM i ORDER BY o_orderkey, f LIMIT 50""")
def issues_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty issues of the table in order of its keys (the limit is the feature), with the counts of all of them."""
    schema = Schema("order", [Field("o_totalprice", "double", [R.min_(50000)]), Field("o_custkey", "long", [R.multiple_of(2).or_("odd")])])
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") + 1).alias("o_custkey"))
    found = validate.collect_batch(validate.annotate(rows, schema), "o_orderkey", max_issues=50)
    listed = spark.createDataFrame([(r["o_orderkey"], r["seq"], r["path"]) for r in found.issues], "o_orderkey bigint, seq int, path string")
    return listed.select("*", F.lit(found.n_issues).cast("long").alias("n_issues"), F.lit(found.n_rows).cast("long").alias("n_rows"), F.lit(found.n_failed).cast("long").alias("n_failed"), F.lit(found.issues_truncated).alias("truncated"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN CAST(strlen(text[1:length(text) // 2]) AS BIGINT) END AS at FROM documents WHERE text IS NOT NULL")
def utf8_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first byte that isn't UTF-8, in texts broken in the middle; every third is whole."""
    half = F.floor(F.length("text") / 2).cast("int")
    bad = F.when(F.col("doc_id") % 3 == 1, F.lit(b"\xff")).when(F.col("doc_id") % 3 == 2, F.lit(b"\xed\xa0\x80")).otherwise(F.lit(b""))
    data = F.concat(F.substring("text", F.lit(1), half).cast("binary"), bad, F.substring("text", half + 1, F.length("text")).cast("binary"))
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", invalid_utf8_at(data).alias("at"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 10 WHEN 2 THEN 5 WHEN 3 THEN 8 WHEN 4 THEN 19 ELSE 2 END AS place,
 CASE o_orderkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'expected T' WHEN 2 THEN 'month 13 is out of range' WHEN 3 THEN 'day 32 is out of range for ' || strftime(o_orderdate, '%Y-%m') WHEN 4 THEN 'expected a zone' ELSE 'expected a year of 4 digits' END AS reason FROM orders""")
def date_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where and why a text isn't a time in ISO 8601."""
    at = lambda form: F.date_format("o_orderdate", form)
    forms = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd", "yyyy-'13'-dd'T'HH:mm:ss'Z'", "yyyy-MM-'32T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss", "dd/MM/yyyy"]
    text = F.element_at(F.array(*map(at, forms)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    place, reason = dates.iso_stop(text)
    return table(spark, sf_dir, "orders").select("o_orderkey", place.alias("place"), reason.alias("reason"))
