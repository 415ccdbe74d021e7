"""The tree of a page's elements against a parser that builds nodes, and selections on it."""

import random
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F
from rosterlane.operators import elements as el
from rosterlane.operators import extract as x

VOID = {"br", "img", "hr", "input"}


class Plain(HTMLParser):
    """(tag, attributes, parent, text) of a page whose elements are all closed, by a node for each."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.nodes, self.open = [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        first = {}
        for k, v in attrs:
            first.setdefault(k, v or "")
        self.nodes.append([tag, first, self.open[-1] if self.open else -1, ""])
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        for i in self.open:
            if self.nodes[self.open[-1]][0] not in ("script", "style"):
                self.nodes[i][3] += data


def ours(page):
    p = el.parsed(page)
    text = "".join(p.pieces)
    return [[t, a, up, text[s:e].replace(el.BREAK, "")] for t, a, up, s, e in zip(p.tags, p.attributes, p.parents, p.starts, p.ends, strict=True)]


def random_page(rng, depth=0):
    out = []
    for _ in range(rng.randint(0, 4)):
        out.append(rng.choice(["", "a ", "Monday 9:00 &amp; more ", "x &lt; y ", "\n é ", "<!-- <div> -->", "<br>", "<img src=a.png alt='x>y'>", "<script>if (a < b) '</div>'</script>"]))
        if depth < 6 and rng.random() < 0.7:
            tag = rng.choice(["div", "div", "section", "span", "b", "a", "ul"])
            attributes = rng.choice(["", " class=hours", " class='office-hours main' id=\"a>b\"", ' data-x="&quot;q&quot;"', " href=/a/b?c=d&e", " CLASS=one class=two", " hidden"])
            if tag == "ul":
                inside = "".join(f"<li>{random_page(rng, depth + 1)}</li>" for _ in range(2))
            else:
                inside = random_page(rng, depth + 1)
            out.append(f"<{tag.upper() if rng.random() < 0.2 else tag}{attributes}>{inside}</{tag} >")
    return "".join(out)


def test_closed_pages_against_a_node_parser():
    rng = random.Random(8)
    pages = [random_page(rng) for _ in range(600)]
    assert max(len(ours(p)) for p in pages) > 40
    for page in pages:
        assert ours(page) == Plain(page).nodes


@pytest.mark.parametrize(
    ("page", "told"),
    [
        ("<ul><li>a<li>b<ul><li>c</ul>d<li>e</ul>f", ["ul:abcde", "li:a", "li:bcd", "ul:c", "li:c", "li:e"]),
        ("<table><tr><td>a<td>b<table><tr><td>c</table>d<tr><th>e</table>", ["table:abcde", "tr:abcd", "td:a", "td:bcd", "table:c", "tr:c", "td:c", "tr:e", "th:e"]),
        ("<p>a<p>b<div>c</div>d", ["p:a", "p:b", "div:c"]),
        ("<dl><dt>a<dd>b<dt>c</dl>", ["dl:abc", "dt:a", "dd:b", "dt:c"]),
        ("<div>a</span>b</p></div></div>c", ["div:ab"]),
        ("<div><span>a<div>b</span>c</div></div>d", ["div:abc", "span:abc", "div:bc"]),
        ("<div>a<table><tr><td>b</div>c</td></tr></table>d</div>e", ["div:abcd", "table:bc", "tr:bc", "td:bc"]),
        ("<div class=a", []),
        ("a < b <3 <div>c", ["div:c"]),
        ("<div a='1>2\" b=c>x</div>' d>y", ["div:y"]),
        ("<textarea><div>&lt;</textarea><title>t</title>", ["textarea:<div><", "title:t"]),
        ("<!-->a<b>c<!-- <i> ", ["b:c"]),
        ("<div/>a", ["div:a"]),
        ("", []),
    ],
)
def test_unclosed_void_and_misplaced_tags(page, told):
    assert [f"{t}:{text}" for t, _, _, text in ours(page)] == told


def test_unclosed_tags_take_time_in_proportion():
    def seconds(n):
        began = time.process_time()
        el.parsed("<div class=hours>Monday <span> <b>x</i> <li>y <td " * n)
        return time.process_time() - began

    seconds(1000)
    assert seconds(16000) < 40 * max(seconds(1000), 0.005)


def test_columns_select_as_a_dom_does(spark):
    page = "<table id=t><tr><td>a<td><table><tr><td>b<br>c</table></table><ol><li>d<ul><li>e</ul></ol><li>out"
    df = spark.createDataFrame([(1, page, "kept"), (2, None, "kept"), (3, "", None)], "page_id int, html string, note string")
    tree = el.element_tree(df)
    assert tree.columns == ["page_id", "note", "page_text", "elements"]
    texts = lambda c: F.transform(c, el.text_of)
    rows = {r.page_id: r for r in tree.select("page_id", texts(el.inside(("ul", "ol"), "li")).alias("items"), texts(el.inside(("table",), "tr")).alias("rows"), F.transform(el.below(F.get("elements", F.lit(0)), "td"), el.lines_of).alias("cells"), F.transform(el.children(F.get("elements", F.lit(0)), "tr"), el.text_of).alias("own")).collect()}
    assert rows[1].items == ["de", "e"] and rows[1].rows == ["abc", "bc"] and rows[1].cells == ["a", "b\nc", "b\nc"] and rows[1].own == ["abc"]
    assert rows[2].items == [] and rows[2].cells is None and rows[3].items == []
    assert el.element_tree(df.limit(0)).count() == 0


def test_timings_of_nested_blocks_tables_and_lists(spark):
    page = "<div class=office-hours><div>Monday 9:00 am</div><div><b>Tuesday</b> closed</div></div><table><tr><td>Hours<td><table><tr><td>Sunday<td>10:30</table></table><dl><div><dt>Friday</dt><dd>no child</dd></div><dt>Saturday<dd>8:00</dl>"
    got = {(r.day, r.slots, r.status, r.source) for r in x.timings_from_pages(spark.createDataFrame([(1, page)], "page_id int, html string")).collect()}
    assert got == {("Monday", "9:00 am", "CLOSED", "selector"), ("Monday", "9:00 am", "OPEN", "div"), ("Sunday", "10:30", "OPEN", "table"), ("Saturday", "8:00", "OPEN", "definition-list")}


def test_affiliations_and_links_of_unquoted_attributes(spark):
    pages = spark.createDataFrame([(1, "HEALTHGRADES", "Austin", "TX", "<section class=hospital-list><div>Oak <i>Hospital</i></div></section><a title=x href=/physician/dr-1>b</a>")], "provider_id int, source string, city string, state string, html string")
    assert [(r.name, r.location) for r in x.source_affiliations(pages).collect()] == [("Oak Hospital", "Austin, TX")]
    assert [r.profile_url for r in x.source_profiles(pages.withColumnRenamed("provider_id", "page_id")).collect()] == ["https://www.healthgrades.com/physician/dr-1"]
