"""Language identification with a byte convolutional network.

Text is read as bytes in 64 symbols (case folded). Filters of several widths run over windows of fixed
length, each filter's maximum over a window is kept, and a softmax over those maxima gives the language of
the window. The network is trained in numpy on a bounded sample of labelled texts. A text's prediction is
the mean over all of its windows, weighted by the letters in each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._sampling import sample_per_label
from ._shared import free_name
from ._text import buffers, slabs

LENGTH = 128
WIDTHS = (2, 3, 4)
FILTERS = 8
SYMBOLS = 64
#: Labelled documents of each language, and windows of each, that the network is fitted to.
SAMPLE_DOCS = 300
SAMPLE_WINDOWS = 24
UNKNOWN = "und"

#: Symbol of each byte: a-z, white space, digits, other ASCII, bytes inside multi-byte characters by their low bits, first bytes.
SYMBOL = np.full(256, 28, dtype=np.uint8)
SYMBOL[97:123] = SYMBOL[65:91] = np.arange(26)
SYMBOL[[9, 10, 11, 12, 13, 32]] = 26
SYMBOL[48:58] = 27
SYMBOL[128:192] = 29 + np.arange(64) % 32
SYMBOL[192:] = 61 + np.arange(64) % 3
_PAD = 26
#: Bytes that start a letter, or may do so above ASCII.
LETTER = np.zeros(256, dtype=bool)
LETTER[65:91] = LETTER[97:123] = LETTER[194:245] = True


def windows(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of some texts as rows of symbols, the text of each, and its number of letters."""
    size = np.diff(offs)
    count = -(-size // LENGTH)
    doc = np.repeat(np.arange(len(size)), count)
    first = np.cumsum(count) - count
    place = np.repeat(first * LENGTH, size) + np.arange(len(buf)) - np.repeat(offs[:-1], size)
    rows = np.full(int(count.sum()) * LENGTH, _PAD, dtype=np.uint8)
    rows[place] = SYMBOL[buf]
    letters = np.bincount(place // LENGTH, weights=LETTER[buf], minlength=len(doc)) if len(buf) else np.zeros(0)
    return rows.reshape(-1, LENGTH), doc, letters


class ByteNet:
    """Filters of each width over symbols, max pooling, softmax."""

    def __init__(self, labels: list[str], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.labels = labels
        self.filters = [rng.normal(0, 0.1, (w, SYMBOLS, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.out = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(labels))).astype(np.float32)
        self.bias = np.zeros(len(labels), dtype=np.float32)

    def _conv(self, columns: np.ndarray, k: int) -> np.ndarray:
        """Outputs ``[place, window, filter]`` of the filters of one width, from tables of pairs of symbols.

        ``columns`` has a window per column, so that a maximum over places runs along memory.
        """
        f, w = self.filters[k], WIDTHS[k]
        total = None
        for j in range(0, w - 1, 2):
            table = (f[j][:, None, :] + f[j + 1][None, :, :]).reshape(SYMBOLS * SYMBOLS, FILTERS)
            pair = columns[j : LENGTH - w + 1 + j].astype(np.intp) * SYMBOLS + columns[j + 1 : LENGTH - w + 2 + j]
            part = np.take(table, pair, axis=0)
            total = part if total is None else np.add(total, part, out=total)
        if w % 2:
            total += np.take(f[w - 1], columns[w - 1 : LENGTH], axis=0)
        return total

    def features(self, rows: np.ndarray, step: int = 128) -> np.ndarray:
        out = np.empty((len(rows), FILTERS * len(WIDTHS)), dtype=np.float32)
        for a in range(0, len(rows), step):
            columns = np.ascontiguousarray(rows[a : a + step].T)
            for k in range(len(WIDTHS)):
                out[a : a + step, k * FILTERS : (k + 1) * FILTERS] = self._conv(columns, k).max(axis=0)
        return out

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        z = self.features(rows) @ self.out + self.bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def fit(self, rows: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 128, rate: float = 0.01, seed: int = 1) -> ByteNet:
        rng = np.random.default_rng(seed)
        params = [*self.filters, self.out, self.bias]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for a in range(0, len(rows), batch):
                x, target = rows[order[a : a + batch]], y[order[a : a + batch]]
                maps = [self._conv(np.ascontiguousarray(x.T), k) for k in range(len(WIDTHS))]
                peak = [c.argmax(axis=0) for c in maps]
                pooled = np.concatenate([np.take_along_axis(c, p[None], 0)[0] for c, p in zip(maps, peak, strict=True)], axis=1)
                z = pooled @ self.out + self.bias
                z = np.exp(z - z.max(axis=1, keepdims=True))
                z /= z.sum(axis=1, keepdims=True)
                z[np.arange(len(x)), target] -= 1
                z /= len(x)
                back = z @ self.out.T
                grads = []
                for k, w in enumerate(WIDTHS):
                    g = np.zeros_like(self.filters[k])
                    for j in range(w):
                        symbol = np.take_along_axis(x, peak[k] + j, 1)
                        np.add.at(g[j], (symbol, np.arange(FILTERS)[None, :]), back[:, k * FILTERS : (k + 1) * FILTERS])
                    grads.append(g)
                grads += [pooled.T @ z, z.sum(axis=0)]
                t += 1
                for p, g, mm, vv in zip(params, grads, m, v, strict=True):
                    mm += 0.1 * (g - mm)
                    vv += 0.001 * (g * g - vv)
                    p -= rate * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-8)
        return self


def train(rows: DataFrame, *, text: str, label: str, key: Column, sample_docs: int = SAMPLE_DOCS, sample_windows: int = SAMPLE_WINDOWS) -> ByteNet:
    """A network fitted to about ``sample_docs`` texts of each label, and at most ``sample_windows`` windows of each text."""
    known = rows.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.col(text).alias("t"), F.col(label).alias("l"), key.alias("k"))
    drawn = sample_per_label(known, "l", F.col("k"), sample_docs).orderBy("k", "t").toArrow()
    labels = sorted(set(drawn["l"].to_pylist()))
    net = ByteNet(labels)
    if not labels:
        return net
    buf, offs = buffers(drawn["t"])
    rng = np.random.default_rng(7)
    xs, ys = [], []
    for k, name in enumerate(drawn["l"].to_pylist()):
        x, _, letters = windows(buf[offs[k] : offs[k + 1]], np.array([0, offs[k + 1] - offs[k]]))
        x = x[letters >= LENGTH // 4]
        x = x[rng.permutation(len(x))[:sample_windows]]
        xs.append(x)
        ys.append(np.full(len(x), labels.index(name)))
    x, y = np.concatenate(xs), np.concatenate(ys)
    return net.fit(x, y) if len(x) else net


def predict(texts: pa.Array, net: ByteNet) -> tuple[list[str], np.ndarray]:
    names, scores = [], []
    for lo, hi, buf, offs in slabs(texts):
        rows, doc, letters = windows(buf, offs)
        total = np.bincount(doc, weights=letters, minlength=hi - lo)
        p = net.probabilities(rows) if net.labels and len(rows) else np.zeros((len(rows), len(net.labels)))
        mean = np.stack([np.bincount(doc, weights=letters * p[:, k], minlength=hi - lo) for k in range(len(net.labels))], axis=1) if net.labels else np.zeros((hi - lo, 0))
        ascii_ = np.bincount(doc, weights=_ascii_letters(rows), minlength=hi - lo) if len(rows) else np.zeros(hi - lo)
        for k in range(hi - lo):
            has = total[k] > 0 and (ascii_[k] > 0 or any(c.isalpha() for c in texts[lo + k].as_py()))
            if not has or not net.labels:
                names.append(UNKNOWN)
                scores.append(0.0)
            else:
                best = int(mean[k].argmax())
                names.append(net.labels[best])
                scores.append(min(1.0, float(mean[k, best] / total[k])))
    return names, np.array(scores)


def _ascii_letters(rows: np.ndarray) -> np.ndarray:
    return (rows < 26).sum(axis=1)


def annotate(docs: DataFrame, net: ByteNet, *, text: str = "text", into: str = "language") -> DataFrame:
    """Add ``into``: a struct of ``lang`` and ``score`` (0 to 1) for the whole of every text.

    A text that is null or has no letter gets ``und`` with score 0, as does every text if no language was
    learned. Rows are independent: nothing is shuffled, repeated rows get equal results.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(net)  # some hundred KB, whatever the input

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            names, scores = predict(texts, shipped.value)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    return docs.withColumn(into, F.arrow_udf(run, "lang string, score double").asNondeterministic()(F.col(text)))


def keep_identified(docs: DataFrame, net: ByteNet, *, text: str = "text", min_score: float = 0.3) -> DataFrame:
    """``docs`` without the rows whose text has no identified language of at least ``min_score``."""
    found = free_name(docs, "_language")
    return annotate(docs, net, text=text, into=found).where((F.col(found).lang != UNKNOWN) & (F.col(found).score >= min_score)).drop(found)
