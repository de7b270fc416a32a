"""Queries that take whole texts and all rows."""

from pyspark.sql import functions as F

from rowwarden.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_words_after_the_sixtieth_character_are_checked(spark, tmp_path):
    words = [f"word{k}" for k in range(30)]
    rows = [(1, " ".join(words)), (2, " ".join([*words, "a"])), (3, " ".join([*words, "word29"])), (4, " ".join(words[:19]))]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in QUERIES["rule_collections"](spark, str(tmp_path)).collect()}
    assert got == {(2, "w[30]", "too_small"), (3, "w", "not_unique"), (4, "w", "wrong_count")}


def test_every_customer_is_decoded(spark):
    got = QUERIES["defaults_and_fallbacks"](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/customer.parquet").count()
    assert got.where(~F.col("accepted")).where("c_custkey % 6 <> 4").isEmpty()
