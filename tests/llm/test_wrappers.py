import random

import pytest

from cubegraph.llm import html_tree as t
from cubegraph.llm import wrappers as w
from tests.llm import cases

SCHEMA = "page_id long, url string, html string"


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in w.extracted(spark.createDataFrame(rows, SCHEMA)).collect()}


def one(page):
    return w.content(page, None, None, numbered(page))


def numbered(page):
    found = t.read_page(page)
    t.written(found.root)
    return found


@pytest.mark.parametrize("page, text", [
    ("", ""),
    ("plain", "plain"),
    ("<p>a <b>b</b><p>c<br>d", "a b\n\nc d"),
    ("<p>x &amp; y&nbsp;&eacute; &lt;p&gt; &ampz", "x & y é <p> &z"),
    ("<ul><li>one<li>two</ul>three", "one\n\ntwo\n\nthree"),
    ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2\n\n3"),
    ("a<!-- <p>no</p> -->b<!-->c<style>p>q</style><script>'</p>'</SCRIPT >d", "abcd"),
    ("<div class=\"x\" title='a>b'>in</div>", "in"),
    ("<a href='never closed>x</p>", "x"),
    ("<nav>n</nav><header>h</header><aside>s</aside><form>f<input value=1></form><footer>f</footer><p>text", "text"),
    ("<article><header><h1>T</h1></header><p>x</p><footer>by</footer></article><p>outside", "T\n\nx"),
    ("<div class='post has-sidebar'>in</div><div class='sidebarLeft'>no</div><div id=cookie-bar>no</div>", "in"),
    ("<article class='comments-open post'>a</article><article class=comment>no</article>", "a"),
    ("<main><p>a</p><section class='comments'><p>no</p></section></main>", "a"),
    ("<div itemprop='articleBody'>a</div><div>b</div>", "a"),
    ("<p>1 < 2 </ > <3", "1 < 2 <3"),
    ("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after", "deep\n\nafter"),
    ("<b>" * 5000 + "<li>x" * 50, "\n\n".join("x" * 50)),
])
def test_a_page_alone(page, text):
    assert one(page) == text


def test_folding_and_matching():
    layout = lambda page: t.written(t.read_page(page).root)
    assert layout("<ul>" + "<li>x" * 9 + "</ul>") == "#page(ul(li))"
    assert layout("<h2>a</h2><p>b</p>" * 7) == "#page(h2 p)"
    assert layout("<div><p>a</p></div><div><h2>b</h2><p>c</p></div>") == "#page(div(h2 p))"
    a, b = "#page(div.a(p) h1 div.b(p ul(li)))", "#page(h1 div.b(ul(li) form))"
    assert t.match_size(t.parsed(a), t.parsed(b)) == 5
    union = w.united([a, b])
    assert union == "#page(div.a(p) h1 div.b(p ul(li) form))"
    names = [n.label for n in t.nodes_of(t.parsed(union))]
    for layout_text in (a, b):
        tree = t.parsed(layout_text)
        places = t.aligned(tree, t.parsed(union))
        assert [names[i] for i in places] == [n.label for n in t.nodes_of(tree)]


def site(r, n, host):
    """Pages of one layout without telling names: a notice and a closing line that never change, links, and an article."""
    rows, truth = [], {}
    for k in range(n):
        paragraphs = [cases.prose(r.randint(5, 40), r.random()) for _ in range(r.randint(1, 9))]
        links = "".join(f"<li><a href='/{x}'>{x}</a></li>" for x in (cases.prose(1, r.random()) for _ in range(r.randint(2, 6))))
        extra = "<div class='k2'>once in a while</div>" if r.random() < 0.5 else ""
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        page = f"<html><body><div>We hope you like it here.</div><ul>{links}</ul>{extra}<div class='c1'><h1>Title {k}</h1>{body}</div><div>All rights kept.</div>"
        rows.append((host * 1000 + k, f"http://h{host}.example.org/{k}", page))
        truth[host * 1000 + k] = "\n\n".join([f"Title {k}", *paragraphs])
    return rows, truth


def test_wrappers_tell_template_and_menus_from_slots(spark, monkeypatch):
    monkeypatch.setattr(w, "TOGETHER", 2)  # several rounds
    r = random.Random(2)
    rows, truth = [], {}
    for host in (1, 2):
        some, expect = site(r, 30, host)
        rows, truth = rows + some, truth | expect
    assert texts(spark, rows) == truth


def test_copies_are_no_template(spark):
    page = "<html><body><div class='x'><p>The same article everywhere.</p></div></body></html>"
    rows = [(i, f"http://a.example.org/{i}", page) for i in range(40)]
    assert set(texts(spark, rows).values()) == {"The same article everywhere."}


def test_odd_rows(spark):
    rows = [(1, None, "<p>a"), (1, None, "<p>a"), (None, "not an address", "<p>b"), (2, "http://x.org/", None), (3, "http://x.org/", ""), (4, "http://[bad", "<p>c")]
    got = sorted((tuple(r) for r in w.extracted(spark.createDataFrame(rows, SCHEMA)).collect()), key=repr)
    expect = [(1, None, "a", 1), (1, None, "a", 1), (None, "not an address", "b", 1), (2, "http://x.org/", "", 0), (3, "http://x.org/", "", 0), (4, "http://[bad", "c", 1)]
    assert got == sorted(expect, key=repr)
    assert w.extracted(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_page_and_clashing_columns(spark):
    from pyspark.sql import functions as F

    long = "".join(f"<p>{cases.prose(6, k)}</p><h2>{k}</h2>" for k in range(5000))
    docs = spark.createDataFrame([(1, "http://x.org/", long)], SCHEMA)
    for c in ("host", "layout", "slots", "wrapper", "text", "template", "n_chars", "places", "node"):
        docs = docs.withColumn(c, F.lit("x"))
    (row,) = w.extracted(docs).collect()
    assert row["text"].count("\n\n") == 9999 and row["n_chars"] == len(row["text"])
