import html
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from raremill.llm import catalog, main_text

PAGES = "page_id long, url string, html string, text string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "other", 3) for r in rows], PAGES)


def texts(df):
    rows = df.select("page_id", "url", "text", "n_chars").collect()
    assert all(r.n_chars == len(r.text) for r in rows)
    return {r.page_id: r.text for r in rows}


def brute_article(page):
    """The article of the given tables' pages, by their fixed form."""
    inside = re.search(r"<article>(.*?)(</article>|$)", page, re.S).group(1)
    parts = re.split(r"</?(?:h1|p)>", inside)
    lines = (" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in parts)
    return "\n".join(x for x in lines if x)


def test_query_equals_brute_force(spark, folder):
    table = spark.read.parquet(f"{folder}/pages.parquet").collect()
    got = texts(catalog.QUERIES["op11_main_text"](spark, folder))
    assert got == {r.page_id: brute_article(r.html) for r in table}


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14), st.sampled_from([1, 9, 1 << 28]))
def test_common_lines(a, b, most):
    got = main_text.common_lines(a, b, most)
    assert got == sorted(set(got)) and len(got) == longest(a, b)
    rest = iter(b)
    assert all(a[i] in rest for i in got)


def test_many_lines_are_aligned():
    a, b = [k % 97 for k in range(20_000)], [k % 89 for k in range(20_000)]
    whole, parts = main_text.common_lines(a, b, 1 << 40), main_text.common_lines(a, b, 1 << 22)
    assert len(whole) == len(parts) > 1000


def lines(page, kind=main_text.ARTICLE):
    return [x for x, k in main_text.page_lines(page) if k == kind]


def test_markup():
    page = """<!DOCTYPE html><html><head><title>a < b</title><style>p{}</style></head><body class="has-sidebar">
      <header><h1>Site</h1></header><div class='cookie-notice'><p>We use cookies</div>
      <!-- <article>no</article> --><div id="layout" class="with-sidebar"><article><header><h1>Title &amp; more</h1></header>
      <p>One<br>two &nbsp; three <b>four</b>ty<p title="a > b">Next &lt;p&gt; &am; &amp x
      <script>var t="</p>";</script><div class="ad-slot">Buy</div><ul><li>first<li>second</ul>
      <form>Name <input> <button>Go</button></form><footer>by</footer><p hidden>no</p><span class=share>tweet</span> tail</article>
      <section class="comments"><article class="comment"><p>nice</p></article></section></div><aside>side</aside></body>"""
    assert lines(page) == ["Title & more", "One two three fourty", "Next <p> &am; & x", "first", "second", "tail"]
    assert main_text.page_lines(None) == main_text.page_lines("") == main_text.page_lines("<p></p>") == []
    assert main_text.page_lines("no <markup") == [("no", 0)] and lines("a < b & c", 0) == ["a < b & c"]
    assert lines("<main><script>x", 1) == [] and lines("<main>a<!-- b", 1) == ["a"]
    assert len(lines("<main>" + "<p>x " * 50_000)) == 50_000 and len(lines("<div " * 100_000, 0)) == 0


def test_urls():
    of = main_text.place_of
    assert of("http://A.example/x/1.html?q=2#f") == ("a.example", "/x/1") == of("//a.example/x/1/")
    assert of("https://u:p@b.example") == ("b.example", "/") and of("/x") == of(None) == of("") == (None, None)


def plain(k, body, menu="Home News Sport Shop About us"):
    items = "".join(f"<div>{x}</div>" for x in menu.split())
    return f"<body>{items}<div>Today: number {k}</div>{body}<div>Imprint and terms</div><div>All rights kept</div>"


def body(k, n=4):
    return "".join(f"<p>Story {k} goes on with its own line {j}.</p>" for j in range(n))


def want(k, n=4):
    return "\n".join([f"Today: number {k}", *(f"Story {k} goes on with its own line {j}." for j in range(n))])


def test_differencing_over_many_pages(spark):
    """Unmarked pages of a large host, beyond one block, beside copies of them and another host."""
    rows = [(k, f"http://big.example/a/{k:04d}?x=1", plain(k, body(k))) for k in range(300)]
    rows += [(1000 + k, f"http://big.example/a/{k:04d}.html#top", plain(k, body(k))) for k in range(0, 300, 7)]
    rows += [(2000 + k, f"http://big.example/a/0150-copy-{k}", plain(150, body(150))) for k in range(5)]
    rows += [(3000 + k, f"http://small.example/{k}", plain(k, body(k, 2), "One Two Three")) for k in range(2)]
    rows += [(4000, "http://alone.example/x", plain(1, body(1)))]
    got = texts(main_text.main_texts(frame(spark, rows), block=32))
    expected = {k: want(k) for k in range(300)} | {1000 + k: want(k) for k in range(0, 300, 7)}
    expected |= {2000 + k: want(150) for k in range(5)} | {3000 + k: want(k, 2) for k in range(2)}
    assert {k: v for k, v in got.items() if k != 4000} == expected
    assert got[4000].startswith("Home\nNews") and len(got) == len(rows)


def test_odd_rows(spark):
    twice = (7, "http://h.example/1", "<main>x</main>")
    rows = [(None, None, None), (1, "http://h.example/0", ""), (2, None, plain(1, "<p>a</p>")), twice, twice,
            (3, "http://h.example/2", "<div>" + "long " * 200_000), (4, "http://h.example/3", "<nav>only</nav>")]
    df = main_text.main_texts(frame(spark, rows))
    got = sorted((r.page_id or -1, r.text[:4], r.n_chars) for r in df.collect())
    assert got == [(-1, "", 0), (1, "", 0), (2, "Home", 81), (3, "long", 999_999), (4, "", 0), (7, "x", 1), (7, "x", 1)]
    assert main_text.main_texts(frame(spark, [])).count() == 0


def marked(k, footer="<footer>{}</footer></article>"):
    return f"<body><article><p>Number {k}</p>{body(k)}<p>The end.</p>" + footer.format("<p>Imprint and terms</p>")


def test_pages_that_mark_their_article_are_differenced(spark):
    """A stray of the template goes, a line that other articles have too stays."""
    rows = [(k, f"http://h.example/{k:02d}", marked(k, "{}</article>") if k % 10 == 5 else marked(k)) for k in range(40)]
    rows += [(100, "http://alone.example/", marked(100, "{}</article>")), (101, None, marked(101))]
    got = texts(main_text.main_texts(frame(spark, rows), block=16))
    line = lambda k: "\nImprint and terms" if k == 100 else ""
    assert got == {k: want(k).replace("Today: n", "N") + "\nThe end." + line(k) for k, _, _ in rows}


def test_few_neighbours_tell_too(spark):
    """On a host of few pages what an article that is not closed takes in goes, a title in the menus of others stays."""
    head = lambda k, n: "".join(f"<nav>Number {j}</nav>" for j in range(n) if j != k)
    rows = [
        (10 * n + k, f"http://h{n}.example/{k}", head(k, n) + (marked(k, "{}</article>") if k == 1 else marked(k)))
        for n in (2, 3, 4) for k in range(n)
    ]
    rows += [(60 + k, f"http://other.example/{k}", f"<article><p>Only {k}</p></article><nav>Only {1 - k}</nav>") for k in range(2)]
    rows += [(70 + k, f"http://own.example/{k}", marked(k, "<p>Thanks {}</p></article>")) for k in range(3)]
    got = texts(main_text.main_texts(frame(spark, rows)))
    text = lambda k: want(k).replace("Today: n", "N") + "\nThe end."
    expected = {10 * n + k: text(k) for n in (2, 3, 4) for k in range(n)} | {60: "Only 0", 61: "Only 1"}
    assert got == expected | {70 + k: text(k) + "\nThanks\nImprint and terms" for k in range(3)}


def test_marked_page_among_unmarked_ones(spark):
    rows = [(k, f"http://h.example/{k}", plain(k, body(k))) for k in range(9)]
    rows[4] = (4, "http://h.example/4", f"<article>{plain(4, body(4))}</article>")
    assert texts(main_text.main_texts(frame(spark, rows))) == {k: want(k) for k in range(9)}


def test_pages_that_are_mostly_template(spark):
    """All neighbours share most of the text: short pages, and one of many copies."""
    menu = " ".join(f"entry-{j}-of-a-long-menu" for j in range(40))
    rows = [(k, f"http://short.example/{k:02d}", plain(k, body(k, 1), menu)) for k in range(30)]
    rows += [(100 + k, f"http://copies.example/{k:02d}", plain(*((50, body(50)) if 20 <= k < 60 else (k, body(k))))) for k in range(120)]
    rows += [(300 + k, f"http://two.example/{k}", plain(k, body(k, 1), menu)) for k in range(2)]
    got = texts(main_text.main_texts(frame(spark, rows).repartition(3), block=16))
    expected = {k: want(k, 1) for k in range(30)} | {100 + k: want(50 if 20 <= k < 60 else k) for k in range(120)}
    assert {k: v for k, v in got.items() if k < 300} == expected
    assert all(got[k].startswith("entry-0-") for k in (300, 301))


def test_pages_of_one_path(spark, monkeypatch):
    """Very many pages of one path are dealt to several tasks and differenced with other paths."""
    monkeypatch.setattr(main_text, "_MOST", 50)
    rows = [(k, f"http://h.example/view?id={k}", plain(k, body(k))) for k in range(300)]
    rows += [(1000 + k, f"http://h.example/z{k}", plain(1000 + k, body(1000 + k))) for k in range(3)]
    got = texts(main_text.main_texts(frame(spark, rows).repartition(3), block=2))
    assert got == {k: want(k) for k in (*range(300), *range(1000, 1003))}
