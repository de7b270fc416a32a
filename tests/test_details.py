"""Patterns, zones, enums of numbers and fields that are never read."""

import pytest
from pyspark.sql import functions as F

from rowwarden import rules as R
from rowwarden.functions import dates
from rowwarden.rules import SchemaError
from rowwarden.schema import Field, Schema
from rowwarden.sources import json


def test_patterns_are_those_of_the_engine_that_runs_them(spark):
    for bad in ("(?P<n>x)", "[a", "x{2,1}"):
        with pytest.raises(SchemaError):
            R.regex(bad)
    assert R.regex(r"\p{Lu}\z").params == (("pattern", r"\p{Lu}\z"),)


def test_zones_in_patterns(spark):
    parse = dates.pattern("yyyy/MM/dd HH:mm:ss Z")
    cases = [("2026/08/06 12:00:00 Z", 1786017600.0), ("2026/08/06 12:00:00 +02:30", 1786008600.0), ("2026/08/06 12:00:00 -0030", 1786019400.0), ("2026/08/06 12:00:00 +02", None), ("2026/08/06 12:00:00 +24:00", None), ("2026/08/06 12:00:00", None), ("2026/02/30 12:00:00 z", None)]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "k int, t string")
    assert [r[1] for r in sorted(df.select("k", parse(F.col("t"))).collect())] == [w for _, w in cases]


def test_enums_of_numbers_and_fields_never_read(spark):
    schema = Schema("s", [Field("level", "long", cases=(1, 2, 3)), Field("made", "string", ignore=True, default="here"), Field("gone", "string", ignore=True)])
    rows = json.decode(spark.createDataFrame([('{"level": 2, "made": "x"}',), ('{"level": 4}',)], "doc string"), schema, "doc").collect()
    assert rows[0].value.asDict() == {"level": 2, "made": "here"}
    assert [(i["code"], i["params"]["options"]) for i in rows[1]["_issues"]] == [("unknown_variant", "1, 2, 3")]
    for bad in (Field("a", "long", cases=("x",)), Field("a", "string", cases=(1,)), Field("a", "long", cases=(1,), enum="open"), Field("a", "double", cases=(1,))):
        with pytest.raises(SchemaError):
            Schema("s", [bad])
