import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from listingloom.llm import html_extraction as h

SCHEMA = "page_id long, url string, html string, host string, text string"


def lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14))
def test_longest_common_subsequence(a, b):
    found = sorted(h.common(a, b))
    rest = iter(b)
    assert len(found) == lcs(a, b) and all(any(a[i] == y for y in rest) for i in found)


def page(body, chrome=True):
    extra = (
        "<nav><a href=/>Home</a></nav><header>Site</header><div class='cookie-notice'>We use cookies</div>"
        "<form>Mail <input></form><aside>Related</aside>"
        if chrome
        else ""
    )
    return f"<html><head><title>T</title><style>p{{}}</style></head><body>{extra}<script>var t='</p>';</script>{body}<footer>&copy; x</footer></body></html>"


def test_what_markup_tells():
    body = "<article><h1>A &amp; B</h1><p>one\n  two<br>three<p>four <b>bold</b><div class=ad>buy</div><section id=comments><p>first!</section></article>"
    assert h.main_lines(h.lines_of(page(body)), []) == ["A & B", "one two three", "four bold"]
    assert h.main_lines(h.lines_of("<p>a<p>b &lt;x&gt; &eacute;"), []) == ["a", "b <x> é"]
    assert h.main_lines(h.lines_of("<ul><li>a<li>b</ul><p hidden>no</p>c"), []) == ["a", "b", "c"]
    assert h.main_lines(h.lines_of(None), []) == [] and h.main_lines(h.lines_of("<nav>only</nav>"), []) == []
    header = "<article><header class='entry-header'><h1>T</h1></header><p>x</p></article>"
    assert h.main_lines(h.lines_of(header), []) == ["T", "x"]


def pages():
    rows = []
    for i in range(60):
        own = f"<div><p>Own {i} words</p><p>More of {i}</p></div>"
        template = "<div>Welcome to our site</div>"
        rows.append((i, f"http://h{i % 2}.example/en/{i:03d}?q=1", page(template + own + "<div>Call us</div>", False), "x", "y"))
    return rows


def test_lines_shared_with_the_nearest_page_go(spark):
    rows = pages()
    random.Random(1).shuffle(rows)
    got = h.extracted(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    assert {r.page_id: r.text for r in got} == {i: f"Own {i} words\nMore of {i}" for i in range(60)}
    assert all(r.n_chars == len(r.text) for r in got)


def test_nearest_by_path_and_copies(spark):
    near = [
        (1, "http://a.example/news/1", page("<p>news bar</p><p>n1</p>", False)),
        (2, "http://a.example/news/2", page("<p>news bar</p><p>n2</p>", False)),
        (3, "http://a.example/shop/1", page("<p>shop bar</p><p>s1</p>", False)),
        (4, "http://a.example/shop/1/b", page("<p>shop bar</p><p>s1</p>", False)),
        (5, "http://alone.example/", page("<p>kept</p>", False)),
    ]
    got = {r.page_id: r.text for r in h.extracted(spark.createDataFrame(near, "page_id long, url string, html string")).collect()}
    assert got[1] == "n1" and got[2] == "n2" and got[5] == "kept"
    assert got[3] == got[4] == "shop bar\ns1"


def test_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "http://[bad", "<p>x", None, None), (None, None, "", None, None)]
    rows += [(7, "http://a/b", "<p>same</p>" + "<p>long</p>" * 5000, None, None)] * 2 + [(7, "http://a/b", "<p>other", None, None)]
    got = h.extracted(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows) and sorted(r.text[:4] for r in got) == ["", "", "othe", "same", "same", "x"]
    assert h.extracted(spark.createDataFrame([], SCHEMA)).count() == 0
    assert h.extracted(spark.createDataFrame(rows, SCHEMA)).where(F.col("n_chars") > 20000).count() == 2
