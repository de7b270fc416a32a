"""The queries of this subpackage: each operator with its production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, embdedup, filteraudit, htmltext, langid, mixing, neardup, pii, prefixtrie, secrets, substrdedup, suffixdedup, toxicity
from .oracles import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(divisor))


def held_out(doc_id: Column, divisor: int, at: int) -> Column:
    return F.coalesce(remainder(doc_id, divisor) == at, F.lit(False))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def n_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.annotate(docs, read(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    items = F.array_sort(F.array_distinct(F.transform(c.matches, lambda m: m["item_id"])))
    return found.select("doc_id", c.n_words.alias("n_words"), c.n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), sha(F.array_join(items, ",")).alias("items_sha256"), c.contaminated.alias("contaminated"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.annotate(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select("doc_id", *[n_of(base, k).alias(f"n_{k}") for k in ("assign", "access", "hex")], sha(span_text(base)).alias("base_sha256"), span_text(F.col("secrets")).alias("spans"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read(spark, sf_dir, "labels").where(remainder(F.col("doc_id"), 5) != 0)
    model = toxicity.train(docs, labels)
    scored = toxicity.annotate(docs, model, into="score")
    return scored.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = htmltext.extract(read(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def language_model(docs: DataFrame) -> langid.ByteNet:
    return langid.train(docs.where(remainder(F.col("doc_id"), 4) != 2), text="text", label="lang", key=F.col("doc_id"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.annotate(docs.select("doc_id", "text"), language_model(docs))
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(read(spark, sf_dir, "documents").select("doc_id", "text"), words=2)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.annotate(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["kind"].isin(*[k.name for k in pii.BASE_KINDS]))
    return found.select("doc_id", *[n_of(base, k.name).alias(f"n_{k.name}") for k in pii.BASE_KINDS], sha(span_text(base)).alias("base_sha256"), span_text(F.col("pii")).alias("spans"))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrdedup.summary(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.link(read(spark, sf_dir, "embeddings"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"))
    return mixing.mix(docs, size=F.col("words")).select("doc_id", "source", "mix.*")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.build(read(spark, sf_dir, "conversations"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.summary(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return filteraudit.audit(filteraudit.masks(docs, read(spark, sf_dir, "labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_secrets, op3_toxicity, op4_main_text, op5_language, op6_neardup, op7_pii, op8_passages, op9_embeddings, op10_mixing, op11_prefix_trie, op12_suffix_dedup, op13_filter_audit)
}
