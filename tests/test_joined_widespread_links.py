"""Texts put together, most widespread values and links, against plain versions."""

import random
from collections import Counter, defaultdict

import pytest

from tidemark.functions.html import links, tags
from tidemark.operators.joined import joined_texts
from tidemark.operators.links import page_links
from tidemark.operators.widespread import Summary, most_widespread


@pytest.mark.parametrize("limits", [{}, {"run_rows": 7, "sampled_per_run": 4}])
@pytest.mark.parametrize("piece", [10_000, 5])
def test_joined_texts(spark, limits, piece):
    rng = random.Random(3)
    rows = [(k, i, rng.choice(["a", "b\n", "", None, "é"])) for k, n in ((1, 90), (2, 1), (3, 12), (None, 6)) for i in range(n)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id bigint, turn bigint, line string, piece int").repartition(4)
    got = {(r.conv_id, r.piece): (r.rows, r.text) for r in joined_texts(df, ["conv_id"], ["turn"], "line", piece_rows=piece, **limits).collect()}
    expected = {}
    for k in (1, 2, 3, None):
        lines = [t or "" for _, _, t in sorted((r for r in rows if r[0] == k), key=lambda r: r[1])]
        for p in range(0, len(lines), piece):
            expected[k, p // piece] = (len(lines[p : p + piece]), "\n".join(lines[p : p + piece]))
    assert got == expected
    assert joined_texts(df.limit(0), ["conv_id"], ["turn"], "line", **limits).count() == 0


@pytest.mark.parametrize("counters", [20_000, 12, 1])
def test_most_widespread(spark, counters):
    """Also where summaries drop most values, and where they must be made again with more."""
    rng = random.Random(counters)
    rows = [(rng.choice(["en", "de", None]), sorted({f"w{int(rng.paretovariate(0.7)) % 400}" for _ in range(rng.choice([0, 3, 25]))})) for _ in range(400)] + [("xx", ["a", "b"]), ("xx", ["b", None]), ("yy", None), ("yy", [])]
    counts = defaultdict(Counter)
    for g, values in rows:
        counts[g].update(v for v in values or [] if v is not None)
    expected = sorted(((g, v, n, p) for g, c in counts.items() for p, (v, n) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:5], 1)), key=repr)
    df = spark.createDataFrame(rows, "lang string, words array<string>").repartition(6)
    assert sorted((tuple(r) for r in most_widespread(df, "lang", "words", 5, counters).collect()), key=repr) == expected
    assert most_widespread(df.limit(0), "lang", "words", 5, counters).count() == 0


def test_summary_bounds():
    rng = random.Random(1)
    values = [f"v{int(rng.paretovariate(1)) % 3000}" for _ in range(20_000)]
    true, s = Counter(values), Summary(40)
    for i in range(0, len(values), 50):
        s.add(values[i : i + 50])
    assert 0 < s.lost <= len(values) / 40 and len(s.counts) <= 80
    assert all(s.counts[v] <= n <= s.counts[v] + s.lost for v, n in true.items())


PAGE = """<!DOCTYPE html><base href="http://b.org/dir/"><base href="http://no.org/">
<!-- <a href="/comment"> --><!--><a href=plain?x=1&amp;y=2>one</a><A HREF='Single "q".html' href="/second">
<script>var t = "<a href='/script'>"; </scripty></SCRIPT ><style><a href="/style"></style>
<a
 class=x   href = "/spaced
line"  >< a href="/nottag"></a href="/end"><?a href="/php"?><p href="/p"><area href="//other.net/x"><a/href=/slash/>
<a href="#top"><a href=""><a name=none><a href="http://[bad"><a =odd href="/odd"><a href="mailto:x@y.z"><title><a href="/title"></title>
<a href="/unclosed"""


def test_links_of_malformed_pages():
    got = links(PAGE, "https://own.org/p/q.html?r#s")
    assert got == [
        ("plain?x=1&y=2", "http://b.org/dir/plain?x=1&y=2"), ('Single "q".html', 'http://b.org/dir/Single "q".html'), ("/spaced\nline", "http://b.org/spacedline"),
        ("//other.net/x", "http://other.net/x"), ("/slash/", "http://b.org/slash/"), ("#top", "http://b.org/dir/#top"), ("", "http://b.org/dir/"), ("http://[bad", None),
        ("/odd", "http://b.org/odd"), ("mailto:x@y.z", "mailto:x@y.z"),
    ]
    assert links("", "http://a.b") == links("<", "x") == links("<!--", "x") == links("<a href", "x") == links("<script>", "x") == []
    assert links('<a href="?q">', "https://own.org/p/q.html?r#s") == [("?q", "https://own.org/p/q.html?q")]
    assert [name for name, _ in tags("<b><i/><br /></b><3><>")] == ["b", "i", "br"]


def test_reading_any_page_ends():
    rng = random.Random(5)
    for _ in range(3000):
        links("".join(rng.choices(["<", ">", "a", " ", "href", "=", '"', "'", "/", "!--", "--", "script", "\n", "é", "&amp;"], k=40)), "http://x.y/")


def test_page_links(spark):
    rows = [(1, "http://x.y/a/b", '<a href="c">', 0), (1, "http://x.y/a/b", '<a href="c"><a href="/d">', 1), (2, None, '<a href="/e">', 0), (3, "http://x.y", None, 0), (None, "http://x.y", "<a href=z>", 0), (4, "u", "", 0)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, place int").repartition(2)
    got = sorted((tuple(r) for r in page_links(df).collect()), key=repr)
    assert got == sorted([(1, 0, "c", "http://x.y/a/c"), (1, 0, "c", "http://x.y/a/c"), (1, 1, "/d", "http://x.y/d"), (2, 0, "/e", "/e"), (None, 0, "z", "http://x.y/z")], key=repr)
    assert page_links(df.limit(0)).count() == 0
