"""Mixing sources to target weights by cutting hash-ordered documents at each source's budget.

Every document gets a random key from a hash. Within a source the documents are in order of the key; a
prefix sum of their sizes along that order tells which part of a document lies below the budget. Keys are
uniform, so the ranges of the sort are runs of leading hex digits, in two levels: each fine range is summed
on its own, fine ranges within their coarse range, coarse ranges within their source. No step holds more
than a few hundred rows of one source, or a few ten thousand ranges, however large the source is.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import free_name, if_small, materialize

#: Rows that one range of keys should hold.
RANGE_ROWS = 256


def word_count(text: Column) -> Column:
    """Number of words that white space separates; null has none."""
    pieces = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.size(F.array_remove(pieces, "")).cast("long")


def targets(totals: DataFrame, *, weights: Sequence[float], share: float, repeat: float) -> DataFrame:
    """Budgets of sources from a table ``(source, total)``: adds ``weight`` and ``target``.

    Sources in order of code point, null last, take ``weights`` in turn. ``share`` times the sum of totals is
    dealt by weight; a source stops at ``repeat`` times its total and its excess goes to the others by weight,
    until none is above. That is the level at which the caps of the sources that stop and the level times the
    weights of the others make up the whole: sources stop in order of cap by weight.

    There is one row per source, so a single window over them is small.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))))
    capped = totals.withColumn("weight", weight).withColumn("_cap", F.lit(float(repeat)) * F.col("total"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    budget = F.lit(float(share)) * F.sum("total").over(everything)
    level = (budget - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    # Before the first source that doesn't stop, all do; from it on, its level holds.
    stops = capped.withColumn("_level", level).withColumn("_stops", F.col("_cap") < F.col("_level") * F.col("weight"))
    final = F.min(F.when(~F.col("_stops"), F.struct((F.col("_cap") / F.col("weight")).alias("r"), F.col("_level").alias("level"))))
    return stops.withColumn("_final", final.over(everything)["level"]).select(
        "source", "total", "weight", F.when(F.col("_stops"), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_final") * F.col("weight"))).alias("target")
    )


def mix(docs: DataFrame, *, source: str = "source", size: Column | None = None, key: Column | None = None, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, repeat: float = 2.0, range_rows: int = RANGE_ROWS, into: str = "mix") -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target`` and ``taken`` in a struct column ``into``, which replaces one of that name.

    ``size`` defaults to the words of ``text``, ``key`` to the MD5 of ``doc_id`` (null as empty). Documents are
    taken in order of key until their source's budget is spent: whole epochs first, then the part below the
    rest, the last document in part. ``taken`` never exceeds ``repeat`` times ``size`` and adds up to the whole
    part of the target. Equal keys are ordered by size; rows that agree in both are taken alike, so that of m
    rows at the cut fewer than m words are left. A null text has no words and a null source is a source like
    the others. Without rows, or with no words, nothing is taken.

    Only sums move: per range of keys, and in each source's range at the cut per key and size. The documents
    themselves meet one row per source and aren't shuffled as long as that table is small.
    """
    size = word_count(F.col("text")) if size is None else size
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) if key is None else key
    s, k, src, plan_ = (free_name(docs, x) for x in ("_size", "_key", "_source", "_plan"))
    # Null is a source like the others; a struct compares equal where a null wouldn't.
    named = lambda c: F.struct(c.isNull().alias("absent"), F.coalesce(c, F.lit("")).alias("name"))
    narrow = docs.select(named(F.col(source)).alias("s"), size.cast("long").alias("n"), key.alias("k"))
    rows = narrow.count()
    digits = 1 if rows <= range_rows else min(16, ceil(log(rows / range_rows, 16)))
    narrow = narrow.withColumn("r", F.substring("k", 1, digits))
    ranges = narrow.groupBy("s", "r").agg(F.sum("n").alias("sum")).withColumn("c", F.substring("r", 1, (digits + 1) // 2))
    ranges = materialize(ranges, "ranges")
    below = Window.unboundedPreceding, -1
    zero = F.lit(0).cast("long")
    coarse = ranges.groupBy("s", "c").agg(F.sum("sum").alias("csum"))
    totals = coarse.groupBy("s").agg(F.sum("csum").alias("total"))
    coarse = coarse.select("s", "c", F.coalesce(F.sum("csum").over(Window.partitionBy("s").orderBy("c").rowsBetween(*below)), zero).alias("cbefore"))
    fine = F.coalesce(F.sum("sum").over(Window.partitionBy("s", "c").orderBy("r").rowsBetween(*below)), zero)
    ranges = ranges.withColumn("fine", fine).join(coarse, ["s", "c"]).withColumn("before", F.col("cbefore") + F.col("fine"))
    budgets = targets(totals.select(F.when(~F.col("s.absent"), F.col("s.name")).alias("source"), "total"), weights=weights, share=share, repeat=repeat)
    whole = F.floor("target").cast("long")
    epochs = F.when(F.col("total") > 0, F.floor(whole / F.col("total"))).otherwise(0).cast("long")
    budgets = budgets.select(named(F.col("source")).alias("s"), "total", "target", epochs.alias("epochs"), (whole - epochs * F.col("total")).alias("rest"))
    budgets = materialize(budgets, "budgets")
    n_sources = budgets.count()
    cut = ranges.join(if_small(budgets, n_sources), "s").where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("sum"))).select("s", "r", "before", "rest")
    cut = materialize(cut, "cuts")
    at_cut = narrow.join(if_small(cut, n_sources), ["s", "r"]).groupBy("s", "k", "n", "before", "rest").agg(F.count(F.lit(1)).alias("m"))
    start = F.col("before") + F.sum(F.col("n") * F.col("m")).over(Window.partitionBy("s").orderBy("k", "n").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n") * F.col("m")
    last = at_cut.withColumn("start", start).where((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("start") + F.col("n") * F.col("m")))
    last = last.select("s", F.struct("k", "n").alias("last"), F.floor((F.col("rest") - F.col("start")) / F.col("m")).cast("long").alias("part"))
    plan = materialize(budgets.join(last, "s", "left").select(F.col("s").alias(src), F.struct("total", "target", "epochs", "last", "part").alias(plan_)), "plan")
    sized = docs.withColumn(s, size.cast("long")).withColumn(k, key).withColumn(src, named(F.col(source))).join(if_small(plan, n_sources), src)
    p, own = F.col(plan_), F.struct(F.col(k).alias("k"), F.col(s).alias("n"))
    rest = F.when(own < p["last"], F.col(s)).when(own == p["last"], p["part"]).otherwise(zero)
    result = F.struct(F.col(s).alias("size"), p["total"].alias("source_size"), p["target"].alias("target"), (p["epochs"] * F.col(s) + rest).alias("taken"))
    kept = [c for c in docs.columns if c.lower() != into.lower()]
    return sized.select(*kept, result.alias(into))
