import random
import re
from html import unescape

import pytest

from lodestar.llm import registry
from lodestar.llm import wrappers as w


def page(i, body=None, **more):
    """A page of a host without any telling names: what is the same on all pages is template."""
    own = body or f"<h2>Title {i}</h2><div><p>Text {i} of it.<p>And <b>more {i}</div>"
    return f"<html><body><div>Our fine site</div><div id=x1><div>Today's saying</div></div><div id=m><a href=/>Home</a> <a href=/b>Topics {i}</a></div><div id=c>{own}</div><table><tr><td>All rights kept<td>in 2024</table>"


def test_constant_nodes_are_template_and_varying_ones_content():
    texts = w.extract([page(i) for i in range(6)])
    assert texts == [f"Title {i}\n\nText {i} of it.\n\nAnd more {i}" for i in range(6)]


def test_copies_of_a_page_make_no_template():
    texts = w.extract([page(0)] * 20 + [page(1)])
    assert "Title 0" in texts[0] and texts[0] == texts[19] and "Title 1" in texts[20]


def test_a_page_alone_goes_by_names_and_links():
    html = """<!DOCTYPE html><title>no</title><header>Site</header><nav>Menu</nav><div class="cookie-notice">We use</div><div class=sidebar-left>Side</div>
    <main class="has-sidebar"><header><h1>Head &amp; title</h1></header><p>One<br>two&nbsp;three<p>Four <script>var x="</p>";</script><i>five</i><!-- six --><style>p{}</style>
    <div class="ad">Buy</div><aside>Aside</aside><form><input value=x><button>Go</button>Search</form><ul><li>a<li>b <ul><li>c</ul></ul><select><option>o</select>
    <section id="comments"><p>First!</section><div class="social-share">Like</div></main><footer>Foot</footer>"""
    assert w.extract([html]) == ["Head & title\n\nOne two three\n\nFour five\n\na\n\nb\n\nc"]
    assert w.extract(["<form id=aspnet><div class=nav>N</div><article>Words</article><div>else</div></form>"]) == ["Words"]


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""), ("  \n", ""), ("plain &lt;b&gt; text &#x41;&amp;", "plain <b> text A&"), ("a < b <3 > c", "a < b <3 > c"), ("<p", ""), ("<p>x<", "x<"), ("<!-- open", ""), ("<script>x", ""), ("<p>x</q></p></p>y", "x\n\ny"),
        ("<article>a<p>b", "a\n\nb"), ("<div>" * 3000 + "deep" + "</div>" * 3000 + "<p>after", "deep\n\nafter"), ("<p a='>'>x<p a=\"y", "x"), ("<p a=it's>x's", "x's"), ("<title>t</title>body", "body"), ("<head><p>x", "x"), ("<b><p>x</b>y", "xy"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2\n\n3"), ("<div hidden class=''>x</div>", "x"), ("<article class=comment>no</article>yes", "yes"),
    ],
)
def test_odd_markup(html, text):
    assert w.extract([html]) == [text]


def tree(pick, depth):
    node = w.Node("div", pick.choice("ab"), "")
    node.parts = [tree(pick, depth - 1) for _ in range(pick.randrange(4))] if depth else []
    return node


def laid(node):
    """A wrapper's node as one page makes it."""
    out = w.Wrapper(node.label, "")
    w.lay(out, [node], True)
    return out


def brute(children, runs):
    """The most pairs of two lists, over all choices of partners that keep order."""
    if not children or not runs:
        return 0
    best = max(brute(children[1:], runs), brute(children, runs[1:]))
    if children[0].label == runs[0][0]:
        best = max(best, 1 + brute(children[0].children, w._runs(runs[0][1][0])) + brute(children[1:], runs[1:]))
    return best


def test_matching_weighs_most(monkeypatch):
    pick = random.Random(2)
    for _ in range(300):
        a, b = laid(tree(pick, 2)), w._runs(tree(pick, 2))
        weight, pairs = w.match(a.children, b, {})
        assert weight == brute(a.children, b)
        assert all(a.children[i].label == b[j][0] for i, j in pairs) and pairs == sorted(pairs) and len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
        monkeypatch.setattr(w, "MOST_PAIRS", 0)
        plain = w.match(a.children, b, {})[1]
        monkeypatch.undo()
        assert all(a.children[i].label == b[j][0] for i, j in plain) and plain == sorted(plain)


def test_long_lists_are_matched_as_short_ones(monkeypatch):
    """The same pairs whatever the size, and by weight: a list that the first partner of a label would miss."""
    pick = random.Random(5)
    for depth, most in ((1, 40), (2, 12), (3, 6)):
        for _ in range(100):
            one, two = (w.Node("div", "a", "") for _ in range(2))
            for n in (one, two):
                n.parts = [tree(pick, pick.randrange(depth)) for _ in range(pick.randrange(1, most))]
            a, b = laid(one), w._runs(two)
            short = w.match(a.children, b, {})
            monkeypatch.setattr(w, "MOST_PAIRS", 0)
            assert w.match(a.children, b, {}) == short
            monkeypatch.undo()
    labels = ["x"] + ["a", "b"] * 400
    children = [w.Wrapper(label, "") for label in labels[1:] + ["x"]]
    assert len(children) ** 2 > w.MOST_PAIRS
    assert w.match(children, [(label, [w.Node("div", label, "")]) for label in labels], {})[0] == 800


def test_long_pages():
    many = "<article>" + "".join(f"<p>{i}<h3>x</h3>" for i in range(3000)) + "</article>"
    one, two = w.extract([many, many.replace("<p>7<", "<p>seven<")])
    assert one.count("\n\n") == 5999 and two.split("\n\n")[14] == "seven"
    assert w.extract(["<p>" + "word " * 400_000]) == [("word " * 400_000).strip()]


SCHEMA = "page_id long, url string, html string, text string, host string, n_chars long"


def test_odd_rows_and_a_host_of_many_pages(spark):
    rows = [(i, f"http://u@Big.example:80/{i}", page(i)) for i in range(150)] + [(None, None, None), (1, "not a url", "x"), (1, "not a url", "x"), (2, "https://b.example/?", "")]
    df = spark.createDataFrame([(*r, "t", "h", 5) for r in rows], SCHEMA).repartition(3)
    got = w.main_text(df).collect()
    assert sorted([(r.page_id, r.url) for r in got], key=str) == sorted([r[:2] for r in rows], key=str)
    texts = {r.url: r.text for r in got}
    assert all(texts[f"http://u@Big.example:80/{i}"].startswith(f"Title {i}\n\nText") and "rights" not in texts[f"http://u@Big.example:80/{i}"] for i in range(150))
    assert (texts[None], texts["not a url"], texts["https://b.example/?"]) == ("", "x", "") and all(r.n_chars == len(r.text) for r in got)
    assert w.main_text(df.limit(0)).collect() == []


def test_whole_table(spark, sf):
    """Against the articles of the table, cut out by their tags."""
    got = {r.page_id: r.text for r in registry.op13_main_text(spark, sf).collect()}
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        blocks = re.split("</?(?:p|h1)>", re.search("<article>(.*?)</article>", p.html, re.S)[1])
        assert got[p.page_id] == "\n\n".join(b for b in (" ".join(unescape(re.sub("<[^>]*>", " ", x)).split()) for x in blocks) if b)
