"""Words and windows whose polynomial hashes would be equal, through all that compares by hash."""

import numpy as np
import pyarrow as pa
import pytest

from rowwarden.llm import _text, decontaminate, neardup, substrdedup


def _thue_morse(n, a, b):
    return [(a, b)[bin(k).count("1") % 2] for k in range(n)]


def _pair(n):
    return "".join(_thue_morse(n, "a", "b")), "".join(_thue_morse(n, "b", "a"))


@pytest.mark.parametrize("n", [16, 64, 128, 1024, 4096, 1 << 16])
def test_words_differ(spark, n):
    x, y = _pair(n)
    df = spark.createDataFrame([(1, " ".join([x] * 60)), (2, " ".join([y] * 60)), (3, x), (4, y), (5, f"{x} z"), (6, f"{y} z")], "doc_id long, text string")
    linked = {r.doc_id: r.component_id for r in neardup.link(df, words=2).collect()}
    assert linked == {k: k for k in range(1, 7)}
    assert all(r.n_removed == 0 for r in substrdedup.summary(df).collect())
    items = spark.createDataFrame([("i", x)], "item_id string, text string")
    hit = {r.doc_id for r in decontaminate.annotate(df, items).where("contamination.n_hit > 0").collect()}
    assert hit == {1, 3, 5}


@pytest.mark.parametrize("width", [1, 2, 3, 50, 1024, 5000])
def test_windows_differ(width):
    h = _text.hash_spans(np.frombuffer(b"ab", np.uint8), np.array([0, 1]), np.array([1, 2]))
    x = h[np.array(_thue_morse(width, 0, 1))]
    y = h[np.array(_thue_morse(width, 1, 0))]
    assert _text.window_hashes(x, width) != _text.window_hashes(y, width)
    both = np.concatenate((x, y, x))
    assert list(_text.window_hashes(both, width, np.array([0, width, 2 * width]))) == [_text.window_hashes(z, width)[0] for z in (x, y, x)]
    assert len(_text.window_hashes(x[: width - 1], width)) == 0


def test_seeds_and_lengths():
    text = pa.array(["a", "aa", "aaa", "", "x" * 64, "x" * 65, "x" * 65, "x" * 200_000])
    buf, offs = _text.buffers(text)
    one, two = (_text.hash_spans(buf, offs[:-1], offs[1:], seed) for seed in (0, 1))
    assert len(set(one)) == 7 and one[5] == one[6] and not set(one[one != 0]) & set(two[two != 0])
