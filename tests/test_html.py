"""HTML rules against an independent tree walk (stdlib html.parser)."""
import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from conftest import SF_SMALL, one
from readaloud.functions import html as H
from readaloud.operators.extract import structural_text
from readaloud.operators.readability import readable_part


class _Texts(HTMLParser):
    """Collects text nodes outside script/style; adjacent data events form one node."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.buf, self.skip = [], [], 0

    def _flush(self):
        if self.buf and not self.skip:
            self.parts.append("".join(self.buf))
        self.buf = []

    def handle_starttag(self, tag, attrs):
        self._flush()
        if tag in ("script", "style", "template"):
            self.skip += 1

    def handle_startendtag(self, tag, attrs):
        self._flush()

    def handle_endtag(self, tag):
        self._flush()
        if tag in ("script", "style", "template") and self.skip:
            self.skip -= 1

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    def handle_pi(self, data):
        self._flush()

    def handle_data(self, data):
        self.buf.append(data)

    def close(self):
        super().close()
        self._flush()


def walk_text(html):
    p = _Texts()
    p.feed(html)
    p.close()
    return "\n".join(p.parts)


def test_html_to_text_matches_tree_walk_on_pages(spark):
    df = spark.read.parquet(f"{SF_SMALL}/pages.parquet").select("page_id", "html")
    rows = df.select("page_id", "html", H.html_to_text(F.col("html")).alias("t")).collect()
    assert rows
    for r in rows:
        assert r.t == walk_text(r.html), r.page_id


def test_entities_single_pass(spark):
    assert one(spark, H.decode_entities, ["a &amp;lt; b &copy; &#233;&#x41; &bogus; &amp"]) == \
        ["a &lt; b © éA &bogus; &"]


def test_title_rules(spark):
    got = one(spark, H.page_title, ["<title>A &amp; B</title>", "<title></title>", "<p>no title</p>", None])
    assert got == ["A & B", None, None, None]


def test_structural_pick_order(spark):
    pages = [
        "<nav>menu</nav><article><p>Main</p></article><main>other</main>",
        "<div><main>M<div>x</div>y</main></div>",
        "<div id='Content-1'><div>a</div><div>b</div></div><p>tail</p>",
        "<body><p>all</p><footer>f</footer></body>",
        "",
    ]
    got = one(spark, structural_text, pages)
    assert got == ["Main", "M\nx\ny", "a\nb", "all", ""]


def test_nested_same_name_element(spark):
    got = one(spark, lambda c: H.element_inner(c, "article"), ["<article>a<article>b</article>c</article>d"])
    assert got == ["a<article>b</article>c"]


def test_long_markup_does_not_overflow_the_regex_stack(spark):
    # a long attribute, an unclosed tag, and a long run of adjacent tags: each used
    # to recurse once per character / tag inside java.util.regex
    pages = ['<p title="' + "y" * 100_000 + '">t</p>', "<a " + "x" * 100_000, "<br>" * 50_000 + "end",
             "<script>" + "z" * 100_000]
    got = one(spark, H.html_to_text, pages)
    assert got[0] == "t" and got[2] == "end" and got[3] == ""
    assert got[1] == walk_text(pages[1])


def test_quoted_markup_and_control_characters(spark):
    pages = ['<p title="a > b <nav>">t</p><nav>q</nav>', "a\x03b\x02c", "<p>\x02</p>\x03<b>x\x02\x03</b>",
             "<article title='</article>'>x<a href='>'>y</a></article>z", "<div id=\"x'content'\">in</div>out", "a < b <p>c</p> < d"]
    assert one(spark, structural_text, pages) == ["t", "a\x03b\x02c", "\x02\n\x03\nx\x02\x03", "x\ny", "in", "a < b \nc\n < d"]


class _Tree(HTMLParser):
    """Elements as (name, parent's name) in document order, closed by the nearest end tag of their name."""

    def __init__(self):
        super().__init__()
        self.open, self.nodes = [], []

    def handle_starttag(self, tag, attrs):
        if tag not in H._VOID:
            self.nodes.append((tag, self.open[-1] if self.open else None))
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass


def test_tree_nests_as_a_tree_builder_does(spark):
    """Random tags, more than one chunk of them; intervals nest, names and parents agree with a stack walk."""
    rng = random.Random(3)
    page = "".join(rng.choice(["<{0}>", "</{0}>", "<{0} a='>'>", "t", "<br>"]).format(rng.choice("a b div p ul li".split())) for _ in range(2000))
    nodes, n = spark.createDataFrame([(page,)], "h string").select(H.parsed(F.col("h")).alias("p")).select("p.nodes", F.size("p.tokens")).first()
    walk = _Tree()
    walk.feed(page)
    names = {x.pos: x.name for x in nodes}
    assert [(x.name, names.get(x.parent)) for x in nodes] == walk.nodes
    spans = {x.pos: x.stop for x in nodes}
    assert all(x.pos < x.stop <= n + 1 and (x.parent == 0 or x.stop <= spans[x.parent]) for x in nodes)
    assert all(x.parent in (0, *names) and (x.grand == 0 or x.parent) for x in nodes)


def test_implied_paragraph_ends(spark):
    """A block's start tag ends an open paragraph, but not from inside a table cell."""
    page = "<div><p>a<b>c<p>d<table><tr><td><p>e</p></td></tr></table><ul><li>f</ul></div>"
    got = spark.createDataFrame([(page,)], "h string").select(H.tree(H.tokens(F.col("h")), implied=True).alias("n")).first().n
    names = {x.pos: x.name for x in got} | {0: None}
    assert [(x.name, names[x.parent], names[x.grand]) for x in got] == [
        ("div", None, None), ("p", "div", None), ("b", "p", "div"), ("p", "div", None), ("table", "div", None), ("tr", "table", "div"),
        ("td", "tr", "table"), ("p", "td", "tr"), ("ul", "div", None), ("li", "ul", "div")]


def test_readability_scores(spark):
    para = "word " * 30
    page = (f"<body><div class=sidebar><p>{para}</p></div><div><section><p>{para}, a, b</p><p>too short</p><p>{para}</p></section></div>"
            f"<ul><li><p><a href=x>{para}</a></p></li></ul></body>")
    got = spark.createDataFrame([(page,), ("<p>short</p>",), ("",), (None,)], "h string").select(readable_part(H.tokens(F.col("h"))).alias("r")).collect()
    # 1 + 2 commas + 1 hundred, and 1 + 1 hundred: the section has 6; the div half of that and 5 for its name: 8
    assert (got[0].r.name, got[0].r.score) == ("div", 8.0) and got[0].r.text.startswith("word") and "too short" in got[0].r.text
    assert [r.r for r in got[1:]] == [None, None, None]
