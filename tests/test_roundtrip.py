"""Parts of the round trip of nested documents."""

from rowwarden.plans import queries


def test_only_rows_that_differ_from_what_was_read_are_counted_as_sets(spark):
    """Rows that changed places come off each other; one is lost, one made, and one refused is both lost and made as nothing."""
    line = [(1, 1.0)]
    rows = [(1, line, {"a": (1, float("nan"))}, (1, line, {"a": (1, float("nan"))}), 0), (2, line, {}, (3, line, {}), 0), (3, line, {}, (2, line, {}), 0), (4, line, {}, (4, [(1, 2.0)], {}), 0), (5, [], {}, None, 1)]
    kind = "array<struct<n:long,q:double>>"
    df = spark.createDataFrame([(k, lines, m, v, [None] * bad) for k, lines, m, v, bad in rows], f"orderKey long, orderLines {kind}, byNumber map<string,struct<n:long,q:double>>, value struct<orderKey:long,orderLines:{kind},byNumber:map<string,struct<n:long,q:double>>>, _issues array<string>")
    assert tuple(queries._compared(df).first()) == (5, 2, 2, 1)
    assert tuple(queries._compared(df.where("orderKey = 1")).first()) == (1, 0, 0, 0)
