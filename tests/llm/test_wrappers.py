import html
import random
import re
import time

import pytest

from orbitweave.llm import wrappers
from orbitweave.llm.wrappers import Aligner, blocks_of, extract, main_text, match, shape, size_of


def text_of(page):
    return main_text(page, "", frozenset(), Aligner())


def test_simple_tree_matching():
    a = ("r", (("x", ()), ("y", (("z", ()),)), ("w", ())))
    b = ("r", (("y", (("z", ()), ("q", ()))), ("x", ()), ("w", ())))
    size, pairs = match(a, b)
    assert size == 4 and ((1, 0), (0, 0)) in pairs and ((2,), (2,)) in pairs
    assert match(("a", ()), ("b", ())) == (0, [])


def test_runs_of_equal_children_are_one():
    root, texts = blocks_of("<div><p>a<p>b<p>c</div><ul><li>1<li>2</ul>")
    places = {}
    s = shape(root, places)
    assert s == ("", (("div", (("p", (("#", ()),)),)), ("ul", (("li", (("#", ()),)),))))
    assert {places[id(leaf)] for leaf, _ in texts} == {(0, 0, 0), (1, 0, 0)}


def test_odd_markup():
    assert text_of("") == "" and text_of("just text") == "just text"
    assert text_of("<p>a &amp; b&nbsp;c &#233;&lt;x") == "a & b c é<x"
    assert text_of("<p><b>One.<br><p>Two <i>it</i>alic") == "One.\nTwo italic"
    assert text_of('<div title="a > b">x</div><script>if (1 < 2) "</p>"</script><p>y<!-- <p>no --><textarea>t</textarea>') == "x\ny"
    assert text_of("<p>kept</p><div") == "kept" and text_of("a < b and 1<2") == "a < b and 1<2"
    page = """<html><head><title>T</title></head><body><header><h1>Site</h1></header><nav>menu</nav><div class="cookie-notice">we use</div>
    <article><header><h1>Head</h1></header><p>One <a href=x>link</a>.</p><aside>more</aside><form><p>mail</p></form><span class="ad">buy</span><p>Two.</p>
    <section id="comments"><p>first!</p></section></article><div class="sidebar">side</div><footer>foot</footer></body></html>"""
    assert text_of(page) == "Head\nOne link.\nTwo."
    assert text_of("<body><div><p>no article here</p></div><div role=navigation>x</div></body>") == "no article here"
    assert text_of("<p>" * 3000 + "deep") == "deep" and text_of("<div>" * 30000 + "deep") == "deep"


def site(n=40):
    rng = random.Random(1)
    words = lambda k: " ".join(rng.choice(["alpha", "beta", "gamma", "rest"]) + str(rng.randrange(99)) for _ in range(k))
    rows, want = [], {}
    for i in range(n):
        paragraphs = [words(12) for _ in range(rng.randint(1, 6))]
        body = "".join(f"<p>{html.escape(p)}" for p in paragraphs)
        rows.append((i, f"http://a.example.org/{i}", f"<body><div><p>Welcome to our pages</p></div><div><h2>{words(4)}</h2>{body}<p>Read more of this on our site.</p></div><div>All rights kept</div>", "x"))
        title = re.search("<h2>(.*?)</h2>", rows[-1][2])[1]
        want[i] = "\n".join([title, *paragraphs])
    return rows, want


def test_template_is_what_most_pages_share(spark):
    rows, want = site()
    copies = [(1000 + i, "http://b.example.org/", "<body><div><p>same text on all copies</p></div></body>", "x") for i in range(30)]
    odd = [(2000, None, None, "x"), (2001, "not a url", "<p>t</p>", "x"), (None, "http://c.example/", "<p>n</p>", "x"), (0, rows[0][1], rows[0][2], "x")]
    df = spark.createDataFrame(rows + copies + odd, "page_id long, url string, html string, text string").repartition(4)
    got = {r.page_id: r for r in extract(df).collect()}
    assert all(got[i].text == want[i] for i in want)
    assert got[1000].text == "same text on all copies" and got[2000].text == "" and got[2000].n_chars == 0
    assert got[2001].text == "t" and got[None].text == "n" and extract(df).count() == len(rows) + 34
    assert extract(df.limit(0)).collect() == []


def test_pages_of_the_test_data(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    page = {r.page_id: r.html for r in pages.collect()}
    for r in extract(pages).collect():
        article = re.search("<article>(.*?)</article>", page[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?p>|</?h1>", article))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_pages_of_equal_texts_count_once_whatever_their_markup(spark):
    page = lambda i, body: f'<body data-nonce="{i}"><div>{body}</div><div><p>Our constant notice</p></div></body>'
    rows = [(i, "http://l.example/", page(i, "<p>Log in</p>")) for i in range(50)] + [(100 + i, "http://l.example/", page(i, f"<p>Text {i} of its own</p>")) for i in range(50)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "Log in" for i in range(50)} | {100 + i: f"Text {i} of its own" for i in range(50)}


def test_content_with_a_marked_word_in_its_class_stays():
    page = '<body><div class="site-footer">foot</div><div class="commentList">said</div><p class="share-prices">Shares rose.</p><div class="legal-history">Old laws.</div><div id="related-work">Others.</div><div class="ad-slot-3">Buy</div></body>'
    assert main_text(page, "", frozenset(), Aligner()) == "Shares rose.\nOld laws.\nOthers."


def test_matching_long_tables_is_quick_and_exact():
    row = lambda i: ("tr", (("td", (("#", ()),)),) * (1 + i % 2))
    long, cut = ("table", tuple(row(i) for i in range(5000))), ("table", tuple(row(i) for i in range(4990)) + (("tr", ()),))
    began = time.time()
    n, pairs = match(long, cut)
    assert time.time() - began < 5 and n == len(pairs) and len({a for a, _ in pairs}) == len({b for _, b in pairs}) == n
    assert match(long, long)[0] == size_of(long)


def plain_match(a, b):
    if a[0] != b[0]:
        return 0
    table = [[0] * (len(b[1]) + 1) for _ in range(len(a[1]) + 1)]
    for i, x in enumerate(a[1]):
        for j, y in enumerate(b[1]):
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + plain_match(x, y))
    return 1 + table[-1][-1]


def test_matches_are_the_largest():
    rng = random.Random(3)
    grow = lambda d: (rng.choice("ab"), tuple(grow(d - 1) for _ in range(rng.randint(0, 4))) if d else ())
    for _ in range(150):
        a, b = ("r", grow(3)[1]), ("r", grow(3)[1])
        n, pairs = match(a, b)
        assert n == plain_match(a, b) == len(pairs)


def test_the_template_decides_where_pages_have_no_marks(spark):
    page = lambda i: f"<html><body><div><div>Home</div><div>Imprint</div></div><div><div>Text {i} of this site.</div><div>More {i}.</div></div><div>All rights reserved</div></body></html>"
    rows = [(i, f"http://one.example/{i}", page(i)) for i in range(20)] + [(100 + i, f"http://few{i}.example/", page(i)) for i in range(3)]
    found = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert all(found[i] == f"Text {i} of this site.\nMore {i}." for i in range(20))
    assert found[100].split("\n")[0] == "Home"  # one page tells nothing of its template


#: The rule of tags as one pattern, which takes quadratic time on tags that never end.
TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(wrappers.RAW) + r")(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>(?:.*?</(?P=raw)\s*>|.*\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>",
    re.S | re.I,
)


def test_tags_are_those_of_the_pattern():
    rng = random.Random(12)
    bits = ["<", ">", "/", "\"", "'", "<!--", "-->", "<script", "</script>", "<SCRIPT >", "</script ", "<p", "<p>", "</p>", "<a href=", "<!x", "<?", "</", " ", "x", "=", "<title/>", "</title>", "<b-1:c", "-", "\n"]
    for _ in range(20_000):
        page = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        want = [(m.start(), m.end(), bool(m["end"]), (m["tag"] or "").lower(), m["attrs"] or "") for m in TAG.finditer(page)]
        assert list(wrappers.tags(page)) == want, page


@pytest.mark.parametrize("bit", ["<script ", "<a href=\"", "<b ", "<p x='", "</", "</p ", "<!", "<!--", "<", "<script>", "<div>", "\"<p", "&amp;<i title=\"'>"])
def test_malformed_pages_take_linear_time(bit):
    page = bit * (1_000_000 // len(bit))
    began = time.time()
    assert sum(1 for _ in wrappers.tags(page)) >= 0
    assert time.time() - began < 5
