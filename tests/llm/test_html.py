import html as entities
import json
import re

from geoloom.llm import html

PAGES = "page_id long, url string, html string"


def test_table_pages(spark):
    """Pages of the table have one article each, so it can be cut out by hand."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html.main_text(rows).collect()}
    for p in rows.collect():
        article = p.html[p.html.find("<article>") + 9 : p.html.rfind("</article>")]
        plain = re.sub(r"</?b>", "", re.sub(r"</?(p|br|h1)>", " ", article))
        assert got[p.page_id] == " ".join(entities.unescape(plain).split())


def blog(k, words, extra="", comments=2):
    lines = "".join(f"<p>{w} text of page {k}.</p>" for w in words)
    notes = "".join(f"<li>reader {i} says hello {k}</li>" for i in range(comments))
    return f"""<html><head><title>T {k}</title></head><body><div class="site-header"><h2>My site</h2></div>
    <div id="cookie-notice">We use cookies</div><div class="nav"><a href=/>Home</a> <a href=/a>About</a></div>
    <div class="wrap"><div class="body-{k}"><h1>Title {k}</h1>{lines}{extra}</div></div>
    <div class="sidebar"><p>Fixed words in the sidebar, many of them, on every page of the site.</p></div>
    <form><input><label>Search</label></form><div class="comments"><ul>{notes}</ul></div>
    <div class="footer">(c) us</div><script>var x = "<p>no</p>";</script></body></html>"""


def test_a_site_without_article_tags(spark):
    words = ["one", "two &amp; three", "four<br>five", "six <b>se</b>ven", "eight", "nine"]
    rows = [(k, f"https://blog.example.com/{k}", blog(k, words[: 2 + k % 5], "<ul><li>a</li><li>b</li></ul>" * (k % 2), k % 4)) for k in range(12)]
    got = {r.page_id: r for r in html.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    for k, _, _ in rows:
        lines = " ".join(f"{entities.unescape(w.replace('<br>', ' ').replace('<b>', '').replace('</b>', ''))} text of page {k}." for w in words[: 2 + k % 5])
        assert got[k].text == f"Title {k} {lines}" + " a b" * (k % 2)
        assert got[k].n_chars == len(got[k].text)


def test_wrappers_have_repeats_and_options():
    pages = ["<ul><li>a</li><li>b</li></ul><p>x</p>", "<ul><li>c</li></ul><p>y</p><i>z</i>"]
    nodes = json.loads(html.infer(pages))["nodes"]
    keys = [(n[0], n[3] is not None) for n in nodes]
    assert keys == [("<ul>", False), ("(<li>#</li>)+", False), ("</ul>", False), ("<p>", False), ("#", False), ("</p>", False), ("<i>", True), ("#", True), ("</i>", True)]
    for page in [*pages, "<ul><li>1</li><li>2</li><li>3</li></ul><p>q</p>"]:
        toks = html.tokens(page)
        keys = [toks[i][0] for i in html._stream(toks)]
        assert html._match(nodes, keys, 0, []) == len(keys)


def test_article_with_parts_that_are_not_text():
    page = "<main><h1>A</h1><aside>no</aside><p>B&nbsp;C</p><div class='advert'>no</div><!-- <p>no</p> --><style>p{}</style><nav>no</nav><p>D</p></main><p>no</p>"
    assert html.extract(page, html.infer([page])) == "A B C D"


def test_odd_rows(spark):
    rows = [(1, None, None), (1, "x", ""), (2, "x", "just text"), (2, "x", "just text"), (None, "http://h.example.org", "<p>a</p" + "<" * 5000), (3, "http://h.example.org", "<p>" + "w " * 200_000)]
    df = spark.createDataFrame(rows, PAGES)
    got = html.main_text(df).collect()
    assert len(got) == len(rows)
    assert [r.text for r in got if r.page_id == 1] == ["", ""]
    assert all(r.n_chars == len(r.text) for r in got)
    assert html.main_text(spark.createDataFrame([], PAGES)).count() == 0
    named = df.selectExpr("*", "1 AS id", "2 AS t", "3 AS host", "4 AS wrapper", "5 AS class", "6 AS page")
    assert html.main_text(named).columns == ["page_id", "url", "text", "n_chars"]


def test_every_page_of_a_host_counts(spark):
    """A rare template without telling names, and a two-page host, are told apart by all their pages."""

    def page(k, box):
        return f'<html><body><div class="top"><p>Notice of the house, the same on every page of it</p></div><div class="{box}"><h1>T {k}</h1><p>Words of page {k} only, {k * k} of them.</p></div></body></html>'

    rows = [(k, "http://many.example.org/x", page(k, "rare" if k % 50 == 7 else "usual")) for k in range(200)]
    rows += [(1000 + 2 * h + i, f"http://h{h}.example.org/", page(h + i, "usual")) for h in range(24) for i in range(2)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, PAGES)).collect()}
    for i, _, p in rows:
        k = int(re.search("<h1>T ([0-9]+)", p)[1])
        assert got[i] == f"T {k} Words of page {k} only, {k * k} of them.", i


def test_repeats_of_any_period():
    row = "".join(f"<i class='c{chr(97 + k)}'>{{}}</i>" for k in range(12))
    nodes = html.page_nodes("<p>x</p>" + (row * 3).format(*range(36)) + "<p>y</p>")
    assert [n.key[0] for n in nodes] == list("<#<(<#<")
    assert len(nodes[3].body) == 36 and all(n.text is None for n in nodes[3].body if n.key == "#")
