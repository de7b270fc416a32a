"""From raw documents to a training mix: identify languages, drop near duplicates, benchmark leaks and secrets, mix sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowwarden.llm import decontaminate, langid, mixing, neardup, secrets
from rowwarden.llm._shared import bound_batches, free_name, materialize
from rowwarden.llm.queries import language_model, read


# In all stages a null or empty text has no language and goes in the first; a stage given one keeps it otherwise. Texts
# are read whole, however long, and go to Python in batches of bounded bytes. Other columns pass through, whatever
# their names. An empty table stays one.


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without an identified language: texts that are null or have no letter. Repeated rows go or stay alike."""
    bound_batches(spark)
    return langid.keep_identified(docs, language_model(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that is linked by five-word shingles at a similarity of 0.8: that with the smallest id.

    Documents without words or without an id are linked with nothing and stay; rows that repeat an id and a
    text stay or go alike.
    """
    bound_batches(spark)
    return neardup.keep_first(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of which benchmark windows cover a twentieth or more; one without words stays."""
    bound_batches(spark)
    return decontaminate.remove_contaminated(docs, read(spark, sf_dir, "benchmark"))


def drop_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a secret of a known form or of high entropy; one without text stays."""
    bound_batches(spark)
    return secrets.remove(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the mix takes words of, with ``size``, ``source_size``, ``target`` and ``taken``, repeats counted.

    A column that has one of these names already keeps it, and the new one gets an underscore before it.
    """
    mix = free_name(docs, "mix")
    mixed = mixing.mix(docs, into=mix).where(F.col(f"{mix}.taken") > 0)
    return mixed.select(*docs.columns, *[F.col(f"{mix}.{c}").alias(free_name(docs, c)) for c in ("size", "source_size", "target", "taken")])


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("contamination", drop_contaminated),
    ("secrets", drop_secrets),
    ("mixing", mix_sources),
]

#: The first two stages are a trained network and a randomised join: no SQL says the same.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on the written result of the one before."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
