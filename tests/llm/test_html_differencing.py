import random

from test_html_extraction import SCHEMA, page

from listingloom.llm import html_extraction as h


def texts(spark, rows):
    return {r.page_id: r.text for r in h.extracted(spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA)).collect()}


def test_differencing_decides_beside_articles_and_not_inside(spark):
    a = [(i, f"http://a.example/{i}", page(f"<main><p>Join us</p><p>own {i}</p></main>", False)) for i in range(4)]
    b = [(10 + i, f"http://b.example/{i}", page(f"<div>Welcome</div><div>body {i}</div><article>teaser {i}</article>", False)) for i in range(4)]
    two = [(20 + i, f"http://c.example/{i}", page(f"<article><p>quoted</p><p>own {i}</p></article>", False)) for i in range(2)]
    got = texts(spark, a + b + two)
    assert all(got[i] == f"Join us\nown {i}" for i in range(4))  # lines of an article stay
    assert all(got[10 + i] == f"body {i}\nteaser {i}" for i in range(4))
    assert all(got[20 + i] == f"quoted\nown {i}" for i in range(2))  # a passage of two articles


def test_copies_beside_each_other_meet_a_page_that_differs(spark):
    copies = [(i, f"http://a.example/shop/{i}", page("<p>shop bar</p><p>s1</p>", False)) for i in range(5)]
    other = [(9, "http://a.example/shop/9", page("<p>shop bar</p><p>s9</p>", False))]
    assert texts(spark, copies + other) == {**dict.fromkeys(range(5), "s1"), 9: "s9"}


def test_pages_without_a_host_are_never_compared(spark):
    urls = [None, None, "/a/1", "/a/2", "http://[bad", "http://[bad/2"]
    rows = [(i, u, page(f"<p>same line</p><p>own {i}</p>", False)) for i, u in enumerate(urls)]
    assert texts(spark, rows) == {i: f"same line\nown {i}" for i in range(6)}


def test_pages_match_brute_force(spark):
    """Lines and zones as they were written, neighbours and common lines by trying all."""
    rnd = random.Random(6)
    rows, read = [], {}
    for i in range(40):
        host, path = f"h{rnd.randrange(3)}.example", f"/{rnd.choice('ab')}/{i:02d}"
        lines = [(rnd.choice(["bar", "menu", "join", f"own {i}"]) + f" {rnd.randrange(3)}", rnd.random() < 0.3) for _ in range(rnd.randrange(7))]
        html = "".join(f"<article><p>{t}</p></article>" if a else f"<div>{t}</div>" for t, a in lines)
        rows.append((i, f"http://{host}{path}", page(html, False)))
        read[i] = host, path, lines

    def alike(a, b):
        return next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))

    expected = {}
    for i, (host, path, lines) in read.items():
        # Footers are lines too, the same on each page, and are shared without changing the rest.
        texts_of = lambda k: [t for t, _ in read[k][2]] + ["footer"]
        first = {}
        for k in sorted((k for k in read if read[k][0] == host), key=lambda k: read[k][1]):
            first.setdefault(tuple(texts_of(k)), k)
        order = list(first.values())
        at = order.index(first[tuple(texts_of(i))])
        path = read[order[at]][1]
        before, after = order[:at][::-1][:2], order[at + 1 :][:2]
        near = [after[0], before[0]] if before and after else [*after, *before]
        near.sort(key=lambda k: -alike(path, read[k][1]))
        choices = []
        for k in [*near, None]:
            shared = h.common(list(map(hash, texts_of(i))), list(map(hash, texts_of(k)))) if k is not None else set()
            choices.append([t for n, (t, a) in enumerate(lines) if a or n not in shared])
        expected[i] = "\n".join(next(filter(None, choices), []))
    assert texts(spark, rows) == expected


def test_lines_of_pages_are_moved_once_and_not_stored(spark, monkeypatch):
    kept, stored = [], h.stored
    monkeypatch.setattr(h, "stored", lambda df, purpose, *rest: kept.append((purpose, df.columns)) or stored(df, purpose, *rest))
    rows = [(i, f"http://a.example/{i}", page(f"<p>shop bar</p><p>s{i}</p>", False)) for i in range(4)]
    found = h.extracted(spark.createDataFrame([(*r, None, None) for r in rows], SCHEMA))
    assert {r.page_id: r.text for r in found.collect()} == {i: f"s{i}" for i in range(4)}
    assert kept == [("texts", ["host", "digest", "path", "hashes", "range"])]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") and plan.count("ResolvedHint") + plan.count("broadcast") > 0
