"""Url models, wrappers and neighbours against their definitions."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from paneltide.llm import html_text, url_filter
from paneltide.llm.neighbours import nearest

BLOCK, ALLOW = ("net/", "example.com/de/"), ("example.net/en/", "org/fr/")


def judged(spark, urls):
    rows = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)],
                                 "page_id long, url string, host string")
    return {r.page_id: r for r in url_filter.judge_urls(rows, BLOCK, ALLOW).collect()}


def test_hosts_paths_and_rules(spark):
    cases = {"http://A.Example.NET/en/1?x#y": ("a.example.net", "/en/1", "example.net/en/", "allow"),
             "ftp://x.net/EN/": ("x.net", "/EN/", "net/", "block"),
             "http://net": ("net", "", None, None), "http://net/": ("net", "/", "net/", "block"),
             "http://mynet/": ("mynet", "/", None, None),
             "a://b.example.com/de/?://c": ("b.example.com", "/de/", "example.com/de/", "block"),
             "http://É.org/fr/": ("É.org", "/fr/", "org/fr/", "allow"),
             "no scheme": ("", "", None, None), "": ("", "", None, "allow"),
             None: ("", "", None, "allow"), "x://?q": ("", "", None, None)}
    got = judged(spark, list(cases))
    assert len(got) == len(cases)
    for r, (host, path, rule, verdict) in zip((got[i] for i in range(len(cases))), cases.values()):
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == verdict or verdict is None and r.verdict in ("allow", "block")
    assert judged(spark, []) == {}
    big = spark.createDataFrame([(2 ** 62 + 1, "http://a.net/"), (None, "http://a.net/")],
                                "page_id long, url string")
    assert {r.page_id for r in url_filter.judge_urls(big, BLOCK, ALLOW).collect()} == {2 ** 62 + 1, None}
    assert judged(spark, ["http://a.net/", "http://b.com/"])[1].verdict == "allow"


def test_models_tell_spam_from_news(spark):
    r = random.Random(2)
    word = lambda of: "".join(r.choice(of) for _ in range(8))
    good = [f"http://{word('aeiort')}.org/fr/{word('aeiort')}" for _ in range(300)]
    bad = [f"http://{word('qxzvkw')}.net/{word('qxzvkw')}" for _ in range(300)]
    new = [f"http://{word(s)}.com/{word(s)}" for s in ("aeiort", "qxzvkw") * 20]
    got = judged(spark, good + bad + new)
    verdicts = [got[600 + i].verdict for i in range(40)]
    assert verdicts == ["allow", "block"] * 20


def test_probabilities_follow_counts():
    urls = ["abab", "abac", "b"]
    counts = np.zeros((2, 2, url_filter.ORDERS, 1 << url_filter.CELL_BITS), dtype=np.float32)
    data, (_, place) = url_filter._positions(urls)
    for order, (pair, context) in enumerate(url_filter._cells(data, place)):
        np.add.at(counts[1, 0, order], pair, 1)
        np.add.at(counts[1, 1, order], context, 1)
    text, expected = "aba", 0.0
    for i, c in enumerate(text):
        p = 1 / 256
        for order in range(url_filter.ORDERS):
            before = ("\0" * 5 + text)[5 + i - order:5 + i] if order else ""
            padded = ["\0" * 5 + u for u in urls]
            total = sum(u[j - order:j] == before for u in padded for j in range(5, len(u)))
            seen = sum(u[j - order:j + 1] == before + c for u in padded for j in range(5, len(u)))
            p = (seen + url_filter.SMOOTHING * p) / (total + url_filter.SMOOTHING)
        expected += math.log(p) - math.log(1 / 256)
    assert abs(url_filter.log_ratio([text], counts)[0] - expected / 3) < 1e-6


def page(body, title="t"):
    return f"<html><head><title>{title}</title><style>p{{}}</style></head><body>{body}</body></html>"


PAGES = [
    ("<nav><ul><li>Home<li>About</ul></nav><article><h1>Big&amp;&lt;x&gt; </h1><p>One <b>bold</b>\n"
     "  word<p>Two<br>three</article><footer>&copy;</footer>", "Big&<x>\nOne bold word\nTwo\nthree"),
    ("<div class='ad'>Buy</div><main><p>Text 1 < 2 </p><form>Mail <input></form><script>var a='</p>'"
     "</script><!-- no --><aside>x</aside><div id=comments>me too</div></main>", "Text 1 < 2"),
    ("<div class=\"content\">plain <div class='cookie-notice'>ok?</div> more</div>", "plain\nmore"),
    ("", ""), ("<article><p>cut off &eacute", "cut off é"),
]


def test_main_text_of_pages(spark):
    rows = [(i, f"http://h{i}.com/", page(b)) for i, (b, _) in enumerate(PAGES)]
    rows += [(90, None, None), (91, "http://h.com/", ""), rows[0], (None, "x", page("<p>id</p>"))]
    got = html_text.extract_text(spark.createDataFrame(
        [(*r, "w") for r in rows], "page_id long, url string, html string, wrapper string")).collect()
    assert len(got) == len(rows)
    expected = {i: t for i, (_, t) in enumerate(PAGES)} | {90: "", 91: "", None: "id"}
    for r in got:
        assert r.text == expected[r.page_id] and r.n_chars == len(r.text)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_text.extract_text(empty).collect() == []


def test_wrapper_finds_what_the_host_repeats(spark):
    rows = [(i, "http://host.com/a", page(f"<div><p>Our daily news site</p></div>"
                                          f"<div><h1>Story {i}</h1>" + f"<p>Line {i}</p>" * (1 + i % 3)
                                          + "</div>" + "<div><p>Extra</p></div>" * (i % 2)))
            for i in range(8)]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    for r in got.collect():
        assert r.text.startswith(f"Story {r.page_id}\nLine {r.page_id}")


def test_alignment_makes_optional_and_repeated_groups():
    a = page("<h1>x</h1><p>1</p><hr><p>2</p><ul><li>k</ul>")
    b = page("<h1>x</h1><div>new</div><p>1</p>")
    items = html_text.infer_wrapper([a, b])
    assert [(i.repeated, i.optional) for i in items] == [
        (False, False), (False, True), (True, False), (False, True)]
    assert items[0].texts == ("x",) and items[2].texts == (None,)


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 24)).astype(np.float32)
    x[100:140] = x[5]                                         # copies
    x[7] *= 30                                                # a long one
    rows = [(i, [float(v) for v in x[i]], 1) for i in range(len(x))]
    odd = [(5000, None, 1), (5020, [0.0] * 24, 1), (5040, [1.0] * 3, 1), (None, rows[1][1], 1),
           (5060, [float("nan")] + [1.0] * 23, 1), (5080, [None] + [1.0] * 23, 1), rows[20]]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, rank int")
    got = nearest(table, F.col("vec_id") % 20 == 0, 10).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append(r)
    assert set(found) == set(range(0, 3000, 20))
    wide, hits = x.astype(np.float64), 0
    for q, answer in found.items():
        score = (wide * wide[q]).sum(axis=1)
        score[q] = -np.inf
        best = np.lexsort((np.arange(len(x)), -score))[:10]
        hits += len(set(best) & {r.vec_id for r in answer})
        answer.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in answer] == list(range(1, 11))
        assert [(r.score, -r.vec_id) for r in answer] == sorted(
            ((r.score, -r.vec_id) for r in answer), reverse=True)
        assert all(abs(r.score - score[r.vec_id]) < 1e-12 for r in answer)
    assert hits >= 0.9 * 10 * len(found)


def test_few_vectors_give_all(spark):
    rows = [(i, [float(i + 1), 1.0]) for i in range(5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nearest(table, F.col("vec_id") == 0, 20).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [4, 3, 2, 1]
    assert nearest(table.limit(0), F.lit(True), 3).collect() == []
    assert nearest(table.where("vec_id = 0"), F.lit(True), 3).collect() == []


def article(inside, n=0):
    return (f"<html><body><nav><a>menu {n}</a></nav><article><h1>Same title</h1>{inside}<p>Own words {n}.</p>"
            f"<p>The same ending.</p></article><footer>foot</footer></body></html>")


def test_what_pages_share_inside_the_article_stays():
    pages = [article("<blockquote>A quote that all pages share</blockquote>", n) for n in range(8)]
    wrapper = html_text.infer_wrapper(pages)
    for n, page in enumerate(pages):
        assert html_text.extract(page, wrapper) == (
            f"Same title\nA quote that all pages share\nOwn words {n}.\nThe same ending.")
    copies = [article("<p>x</p>")] * 8
    assert html_text.extract(copies[0], html_text.infer_wrapper(copies)).startswith("Same title\nx\nOwn words 0.")


def test_topics_inside_the_article_are_not_its_frame():
    inside = ('<section class="social-science"><p>A topic</p></section><div id="search"><p>On search</p></div>'
              '<div class="share"><p>Share me</p></div><div class="ad box"><p>Buy</p></div>')
    page = article(inside)
    assert html_text.extract(page, []) == "Same title\nA topic\nOn search\nOwn words 0.\nThe same ending."


def test_without_an_article_the_wrapper_finds_the_hosts_lines_at_any_length():
    def page(n, blocks):
        body = "".join(f"<p class=c{i % 9}>Text {n} {i}</p><h{i % 5 + 1}>Head {n} {i}</h{i % 5 + 1}>" for i in range(blocks))
        return f"<body><div>The line of the host</div>{body}<div>Another one</div></body>"

    for blocks in (3, 700):
        pages = [page(n, blocks) for n in range(6)]
        wrapper = html_text.infer_wrapper(pages)
        got = html_text.extract(pages[5], wrapper).split("\n")
        assert len(got) == 2 * blocks and got[0] == "Text 5 0" and "The line of the host" not in got


def test_long_odd_pages_take_linear_time():
    import time

    start = time.perf_counter()
    for page in ("<a " * 300_000, '<a "' * 200_000, "<a '\"<" * 100_000 + ">", "<!-- " * 100_000,
                 "<div>" * 100_000 + "</foo>" * 100_000 + "<p>end"):
        html_text.extract(page, html_text.infer_wrapper([page]))
    assert time.perf_counter() - start < 20


def test_alignment_pairs_equal_groups_in_order():
    left, right = ([(x,) for x in text] for text in ("abXcdeYfg", "abcZdefWg"))
    pairs = html_text._aligned(left, right)
    assert all(left[i] == right[j] for i, j in pairs)
    assert [left[i][0] for i, _ in pairs] == list("abcdefg")
    assert html_text._aligned([("a",)] * 3, [("a",)] * 2) == [(0, 0), (1, 1)]


def test_wrappers_come_from_all_pages_however_they_are_dealt(spark, monkeypatch):
    """A line that only one of 200 pages words otherwise is no line of the host's own."""
    def page(i):
        note = "Differs" if i == 117 else "Same line"
        return f"<body><h1>T{i}</h1>{'<pre>x</pre>' * (i % 3)}{'<ul><li>a<li>b</ul>' * (i % 2)}<p>{note}</p></body>"

    rows = [(i, "http://a.org/x", page(i), "a.org") for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    monkeypatch.setattr(html_text, "ALIGNED_AT_ONCE", 2)
    found = {html_text.wrappers(df.repartition(n)).first()["wrapper"] for n in (1, 7)}
    assert len(found) == 1
    items = html_text._decoded(found.pop())
    assert max(x.pages for x in items) == 200
    assert not any(t == "Same line" for x in items for t in x.texts)
