"""Audit of how filters interact, from signed parity sums of failure masks.

A document's failures are a mask of one bit per filter. For each set S of filters, the sum over documents of
+1 or -1, by the parity of the failures within S, is one coefficient of the Walsh-Hadamard transform of the
counts per mask. These sums are all that is aggregated: one row per part and class of label, with partial sums
before the shuffle. The transform is its own inverse but for a factor, so the counts of all masks come back
exactly, and from those the effect of every order of the filters follows without looking at a document again.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import if_small, materialize

#: White space between words.
SPACE = r"[\x20\x09-\x0D]+"
FILTERS = "ABCDE"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def failures(text: Column, repeated: Column) -> Column:
    """The mask of a text: bit 0 is A, under 200 words; bit 1 is B, under half of the words distinct; bit 2 is C, over
    3 % of the characters A-Z; bit 3 is D, one of ``#$%&*|``; bit 4 is E, ``repeated``. Null is empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, SPACE), "")
    n = F.size(words)
    tests = (
        n < 200,
        100 * F.size(F.array_distinct(words)).cast("long") < 50 * n.cast("long"),
        100 * (F.length(text) - F.length(F.translate(text, UPPER, ""))).cast("long") > 3 * F.length(text).cast("long"),
        text.rlike(r"[#$%&*|]"),
        repeated,
    )
    return reduce(lambda a, b: a + b, [F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)]).cast("int")


def masks(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``part``, ``mask``, ``good`` and ``toxic`` of every row of ``docs``.

    A text repeats if a smaller id has the same one, as told by SHA-256; a null text is empty, and a row without an
    id repeats nothing and has no labels. Several labels of an id count as one that is 1 if any is. Only digests,
    ids and masks move; a text that very many rows hold is one group of partial minima.
    """
    d, f, m = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256), "first", "mask"
    bare = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), d.alias("same"), failures(F.col(text), F.lit(False)).alias(m))
    bare = materialize(bare, "masks")
    first = bare.groupBy("same").agg(F.min("doc_id").alias(f), F.max("doc_id").alias("last")).where("first < last").select("same", f)
    first = materialize(first, "firsts")
    marked = bare.join(if_small(first, first.count()), "same", "left")
    mask = F.col(m) + F.when(F.col("doc_id") > F.col(f), 1 << (len(FILTERS) - 1)).otherwise(0)
    flags = labels.groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    flags = materialize(flags.where("doc_id is not null and (good or toxic)"), "labels")
    out = marked.select("doc_id", "part", mask.alias(m)).join(if_small(flags, flags.count()), "doc_id", "left")
    return out.select("part", m, F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def parity_sums(rows: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """For each part and class of labels, the signed sums of all sets of filters, in an array by the bits of the set."""
    sign = lambda s: F.lit(1) - 2 * (F.bit_count(F.col("mask").bitwiseAND(F.lit(s))) % 2)
    sums = [F.sum(sign(s)).alias(f"s{s}") for s in range(1 << filters)]
    return rows.groupBy("part", "good", "toxic").agg(*sums).select("part", "good", "toxic", F.array(*[f"s{s}" for s in range(1 << filters)]).alias("sums"))


def _inverse(sums: Column, filters: int) -> Column:
    """Counts per mask: the signed sums of the signed sums, by the number of sets."""
    n = 1 << filters
    cell = lambda m: F.aggregate(F.transform(sums, lambda w, s: F.when(F.bit_count(s.bitwiseAND(m)) % 2 == 0, w).otherwise(-w)), F.lit(0).cast("long"), lambda a, x: a + x)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda m: F.shiftright(cell(m), filters))


def cells(sums: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """One row per part: arrays ``every``, ``good`` and ``toxic`` of document counts by mask."""
    n = 1 << filters
    total = lambda keep: F.array(*[F.sum(F.when(keep, F.col("sums")[s]).otherwise(F.lit(0).cast("long"))) for s in range(n)])
    by_part = sums.groupBy("part").agg(total(F.lit(True)).alias("every"), total(F.col("good")).alias("good"), total(F.col("toxic")).alias("toxic"))
    return by_part.select("part", *[_inverse(F.col(c), filters).alias(c) for c in ("every", "good", "toxic")])


def audit(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, order of ``filters`` and step, of rows with ``part``, ``mask``, ``good`` and ``toxic``.

    ``kept``, ``removed``, ``redundant``, ``unique_fails``, ``good_lost``, ``toxic_lost`` count documents; ``shapley``
    is the filter's ``removed`` summed over all orders: of k filters that a document fails, each is the first in
    one of k orders. Parts are the values in ``rows``; without rows there are none.
    """
    width = len(filters)
    steps = []
    for order in permutations(range(width)):
        before = 0
        for k, f in enumerate(order):
            steps.append((("".join(filters[x] for x in order)), k + 1, 1 << f, before))
            before |= 1 << f
    table = materialize(cells(parity_sums(rows, width), width), "cells")
    listed = F.from_json(F.lit(_json(steps)), "array<struct<o:string,k:int,bit:int,before:int>>")
    each = table.select("*", F.explode(listed).alias("s"))
    bit, before = F.col("s.bit"), F.col("s.before")
    fails, earlier = lambda m: m.bitwiseAND(bit) != 0, lambda m: m.bitwiseAND(before) != 0

    def count(counts: str, test, weight=lambda n, m: n) -> Column:
        return F.aggregate(F.transform(F.col(counts), lambda n, m: F.when(test(m), weight(n, m)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)

    shares = F.array(*[F.lit(0 if k == 0 else factorial(width) // k).cast("long") for k in range(width + 1)])
    first = lambda m: fails(m) & ~earlier(m)
    return each.select(
        "part", F.col("s.o").alias("filter_order"), F.col("s.k").alias("step"),
        count("every", lambda m: ~fails(m) & ~earlier(m)).alias("kept"), count("every", first).alias("removed"), count("every", lambda m: fails(m) & earlier(m)).alias("redundant"),
        F.element_at("every", bit + 1).alias("unique_fails"), count("good", first).alias("good_lost"), count("toxic", first).alias("toxic_lost"),
        count("every", fails, lambda n, m: n * F.element_at(shares, F.bit_count(m) + 1)).alias("shapley"),
    )


def _json(steps: Sequence[tuple]) -> str:
    return json.dumps([{"o": o, "k": k, "bit": b, "before": f} for o, k, b, f in steps])
