"""Toxicity scores from a classifier with a counterfactual penalty.

Features are the presence of words and of the beginnings of words. A logistic model with an L1 penalty is
fitted to a bounded sample of labelled texts. For every labelled sentence that names a group, the name is
swapped for the others of its kind, one name at a time; the squared change of the model's logit between the two versions is a
penalty beside the loss, so that naming one group rather than another doesn't move a score. Names of groups
are also inserted into sentences without any, so that neutral mention as such doesn't move it either.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._sampling import sample_per_label
from ._text import ALNUM, FOLD, hash_spans, lists, slabs, word_spans

# Names of groups, by kind; a name is swapped for others of its kind.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "blind", "deaf", "old", "young"),
)
#: Labelled documents of each label that the model is fitted to.
SAMPLE_DOCS = 5000
#: Features kept for fitting, and the least number of sampled texts that have one.
FEATURES = 500
SUPPORT = 4
PREFIXES = (4, 5)
_BITMAP = 1 << 22


def features(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and word beginnings of some texts, and for each its text."""
    folded = FOLD[buf]
    starts, ends, first = word_spans(folded, offs, ALNUM)
    doc = np.searchsorted(first, np.arange(len(starts)), "right") - 1
    found, of = [hash_spans(folded, starts, ends)], [doc]
    for n in PREFIXES:
        longer = ends - starts > n
        found.append(hash_spans(folded, starts[longer], starts[longer] + n) ^ np.uint64(n))
        of.append(doc[longer])
    return np.concatenate(found), np.concatenate(of)


def feature_lists(texts: pa.Array) -> pa.Array:
    """For each text the ascending distinct hashes of its features."""
    out = []
    for lo, hi, buf, offs in slabs(texts):
        h, doc = features(buf, offs)
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        out.append(lists(h[new].view(np.int64), np.bincount(doc[new], minlength=hi - lo), pa.int64()))
    return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.int64()))


def counterfactuals(texts: Sequence[str], terms: Sequence[Sequence[str]] = IDENTITY_TERMS, inserted: int = 200) -> list[tuple[str, str]]:
    """Pairs of sentences that differ in a group they name: swaps of each name, and insertions into ``inserted`` sentences without one."""
    kind = {t: group for group in terms for t in group}
    named = re.compile(r"\b(" + "|".join(sorted(kind, key=len, reverse=True)) + r")\b", re.IGNORECASE) if kind else None
    pairs: list[tuple[str, str]] = []
    if named is None:
        return pairs
    flat, bare = [t for group in terms for t in group], 0
    for text in texts:
        for sentence in re.split(r"[.!?\n]+", text):
            found = list(named.finditer(sentence))
            for m in found:
                own = m.group().lower()
                pairs += [(sentence, sentence[: m.start()] + t + sentence[m.end() :]) for t in kind[own] if t != own]
            if not found and bare < inserted and sentence.strip():
                pairs.append((sentence, f"{sentence} {flat[bare % len(flat)]}"))
                bare += 1
    return pairs


class ToxicityModel:
    """Weights of hashed features, and a bias."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        order = np.argsort(keys)
        self.keys, self.weights, self.bias = keys[order], weights[order], float(bias)
        self.bitmap = np.zeros(_BITMAP, dtype=bool)
        self.bitmap[(self.keys % np.uint64(_BITMAP)).astype(np.int64)] = True

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = []
        for lo, hi, buf, offs in slabs(texts):
            h, doc = features(buf, offs)
            maybe = self.bitmap[(h % np.uint64(_BITMAP)).astype(np.int64)]
            h, doc = h[maybe], doc[maybe]
            z = np.full(hi - lo, self.bias)
            if len(self.keys) and len(h):
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                same = self.keys[at] == h
                pair = np.unique(doc[same] * len(self.keys) + at[same])
                z += np.bincount(pair // len(self.keys), weights=self.weights[pair % len(self.keys)], minlength=hi - lo)
            out.append(1 / (1 + np.exp(-np.clip(z, -40, 40))))
        return np.concatenate(out) if out else np.zeros(0)


def fit(hashes: Sequence[np.ndarray], y: np.ndarray, pairs: Sequence[tuple[np.ndarray, np.ndarray]] = (), *, penalty: float = 1.0, l1: float = 2e-4, rounds: int = 250) -> ToxicityModel:
    """A model of the lists of feature hashes ``hashes`` with labels ``y``, and of pairs that should score alike."""
    none = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    if not len(y):
        return none
    if y.min() == y.max():
        return ToxicityModel(none.keys, none.weights, 4.0 if y[0] else -4.0)
    every = np.concatenate([*hashes, np.zeros(0, np.uint64)])
    label = np.repeat(y, [len(h) for h in hashes])
    keys, which = np.unique(every, return_inverse=True)
    n1, n = y.sum(), len(y)
    pos = np.bincount(which, weights=label, minlength=len(keys))
    total = np.bincount(which, minlength=len(keys))
    expected = total * n1 / n
    z = np.abs(pos - expected) / np.sqrt(expected * (1 - n1 / n) + 1)
    z[total < min(SUPPORT, n)] = 0
    chosen = np.argsort(-z, kind="stable")[:FEATURES]
    chosen = np.sort(chosen[z[chosen] > 0])
    keys = keys[chosen]
    if not len(keys):
        return ToxicityModel(keys, np.zeros(0), np.log(n1 / (n - n1)))

    def dense(rows: Sequence[np.ndarray]) -> np.ndarray:
        x = np.zeros((len(rows), len(keys)), dtype=np.float32)
        for k, h in enumerate(rows):
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            x[k, at[keys[at] == h]] = 1
        return x

    x = np.hstack([dense(hashes), np.ones((n, 1), np.float32)])
    swap = dense([a for a, _ in pairs]) - dense([b for _, b in pairs]) if len(pairs) else np.zeros((0, len(keys)), np.float32)
    swap = swap[np.abs(swap).sum(axis=1) > 0]
    swap = np.hstack([swap, np.zeros((len(swap), 1), np.float32)])
    # Accelerated proximal gradient; both labels weigh alike, and the bias in the last place has no L1 penalty.
    sample = np.where(y == 1, 0.5 / n1, 0.5 / (n - n1)).astype(np.float32)
    pull = 2 * penalty / max(len(swap), 1)
    step = 1.0 / (0.25 * _largest(x, sample) + pull * _largest(swap, np.ones(len(swap), np.float32)) + 1e-6)
    shrink = np.full(len(keys) + 1, step * l1)
    shrink[-1] = 0
    w = at = np.zeros(len(keys) + 1, dtype=np.float32)
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -40, 40)))
        grad = x.T @ (sample * (p - y)) + pull * (swap.T @ (swap @ at))
        new = at - step * grad
        new = (np.sign(new) * np.maximum(np.abs(new) - shrink, 0)).astype(np.float32)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at = (new + (t - 1) / t_new * (new - w)).astype(np.float32)
        w, t = new, t_new
    used = np.flatnonzero(w[:-1])
    return ToxicityModel(keys[used], w[used].astype(np.float64), w[-1])


def _largest(x: np.ndarray, weight: np.ndarray) -> float:
    """Largest eigenvalue of ``x' diag(weight) x``, by power iteration, and a little more."""
    v = np.ones(x.shape[1], dtype=np.float32)
    norm = 0.0
    for _ in range(20):
        v = x.T @ (weight * (x @ v))
        norm = float(np.linalg.norm(v))
        if norm == 0:
            break
        v /= norm
    return 1.1 * norm


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample_docs: int = SAMPLE_DOCS, terms: Sequence[Sequence[str]] = IDENTITY_TERMS, penalty: float = 1.0) -> ToxicityModel:
    """A model fitted to the texts of about ``sample_docs`` rows of ``labels`` of each label.

    The sample is drawn from the labels alone, so its size is bounded before it meets a text: it is broadcast
    to the texts, which stay in place. Rows whose label or id is null teach nothing.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("k"), F.col(label).cast("int").alias("l"))
    sample = sample_per_label(known, "l", F.col("k"), sample_docs)
    texts = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("k"), F.col(text).alias("t"))
    drawn = texts.join(F.broadcast(sample), "k")

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield feature_lists(texts)

    named = "(?i)\\b(" + "|".join(t for group in terms for t in group) + ")\\b"
    # Whole texts of the sample come along where they name a group, and one in fifty of the others for insertions.
    carried = F.when(F.col("t").rlike(named) | (F.pmod(F.xxhash64("k"), F.lit(50)) == 0), F.col("t"))
    got = drawn.select("l", "k", F.arrow_udf(run, "array<long>")(F.col("t")).alias("h"), carried.alias("t")).toArrow().sort_by([("k", "ascending"), ("l", "ascending")])
    h = got["h"].combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int64()))
    hashes = [np.asarray(x.values).view(np.uint64) if x.is_valid else np.zeros(0, np.uint64) for x in h]
    pairs = counterfactuals([t for t in got["t"].to_pylist() if t], terms)
    sides = [[np.asarray(x.values).view(np.uint64) for x in feature_lists(pa.array([p[s] for p in pairs], pa.string()))] for s in (0, 1)]
    return fit(hashes, np.array(got["l"].to_pylist(), dtype=np.int64), list(zip(*sides, strict=True)), penalty=penalty)


def annotate(docs: DataFrame, model: ToxicityModel, *, text: str = "text", into: str = "toxicity") -> DataFrame:
    """Add ``into``: the score from 0 to 1 of the whole of every text.

    A null or empty text has no features and gets the score of the bias alone. Rows are independent: nothing
    is shuffled, repeated rows get equal scores.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((model.keys, model.weights, model.bias))  # at most FEATURES rows

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = ToxicityModel(*shipped.value)
        for texts in batches:
            yield pa.array(own.scores(texts), pa.float64())

    return docs.withColumn(into, F.arrow_udf(run, "double").asNondeterministic()(F.col(text)))
