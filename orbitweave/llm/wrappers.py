"""Main text of web pages by wrapper induction (operator 4).

The block tree of each page is aligned with that of a reference page of its host by simple tree matching. Text that
stands at the same place on most of a host's distinct pages belongs to the template; what varies is content, apart from
parts that their tags, roles or class names mark as navigation, notices, forms, adverts or comments.
"""

from __future__ import annotations

import html as markup
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orbitweave.session import durable

#: A text is template where it stands at one place on this share of a host's distinct pages, and on this many.
TEMPLATE_SHARE, TEMPLATE_PAGES = 0.6, 5
#: Wrappers are sent to all executors up to this many bytes, otherwise joined by host.
BROADCAST_BYTES = 4_000_000
SALTS = 16
#: Levels of a block tree; what is nested deeper counts as text of the last level.
DEEPEST = 100

# Elements by their part in a page, and words of class names, ids and roles.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split())
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "title")
NOT_TEXT = frozenset("head title nav menu aside footer form fieldset button select option label input dialog".split())
OUTER_ONLY = frozenset(["header"])
MARKS = frozenset("ad ads adbox adsense advert adverts advertisement advertising banner sponsor sponsored promo promotion sidebar side nav navbar navigation menu breadcrumb breadcrumbs masthead footer cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments reply replies disqus discussion widget toolbar pagination pager copyright disclaimer legal skip hidden".split())
#: Words that leave the meaning of a mark beside them as it is, as in site-footer or comment-list.
NEUTRAL = frozenset("site page main top bottom left right box list bar wrap wrapper container block section area inner outer content slot unit links item items panel primary secondary header head global js".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: An open element of the key is closed by the start of one of the value.
CLOSES = {"p": BLOCKS, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]), "head": frozenset(["body"])}

OPEN = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][a-zA-Z0-9:-]*)|[!?/])")
ENDS = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in RAW}
SPECIAL = re.compile("[>\"']")
ATTRIBUTE = re.compile(r"([^\s=/]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s]+)|([^\s=/]+)")
WORD = re.compile(r"[a-z]+|[0-9]+")


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, whether it closes, name, attributes) of a page's tags; what is no text otherwise, with what raw elements hold, has no name.

    One pass forward: where a tag that begins outside of quotes ends is known beforehand for each place, from the last
    to the first, so that tags that never end cost nothing. A tag without an end is text.
    """
    places = [m.start() for m in SPECIAL.finditer(page)]
    ends, after = [-1] * (len(places) + 1), {}
    for k in range(len(places) - 1, -1, -1):
        c = page[places[k]]
        if c == ">":
            ends[k] = places[k] + 1
        else:
            ends[k] = ends[after[c] + 1] if c in after else -1
            after[c] = k
    last, at = page.rfind(">"), 0
    while m := OPEN.search(page, at):
        start, stop = m.span()
        at = start + 1
        if m[1]:
            found = page.find("-->", stop)
            at = found + 3 if found >= 0 else len(page)
            yield start, at, False, "", ""
        elif m[3] and (end := ends[bisect_left(places, stop)]) >= 0:
            tag, at = m[3].lower(), end
            if not m[2] and tag in ENDS and (page[stop] in "/>" or page[stop].isspace()):
                closing = ENDS[tag].search(page, end)
                at = closing.end() if closing else len(page)
                yield start, at, False, "", ""
            else:
                yield start, at, bool(m[2]), tag, page[stop : end - 1]
        elif (m[2] or not m[3]) and start + 2 <= last:
            at = page.find(">", start + 2) + 1
            yield start, at, False, "", ""


class Node:
    """An element of the block tree; inline elements leave their text to the block around them."""

    __slots__ = ("label", "tag", "parent", "children", "barred", "inside", "depth", "home")

    def __init__(self, label: str, tag: str, parent: Node | None, barred: bool, inside: bool):
        self.label, self.tag, self.parent, self.children = label, tag, parent, []
        self.barred, self.inside = barred, inside  # boilerplate by its marks; in an article
        self.depth = parent.depth + 1 if parent else 0
        self.home = self if self.depth <= DEEPEST else parent.home  # the node of the tree that holds its text


def _is_barred(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    if tag in NOT_TEXT or (tag in OUTER_ONLY and not inside) or attrs.get("role", "").lower() in ROLES:
        return True
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    names = [set(WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())) for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split()]
    if tag == "article":
        return any({"comment", "comments", "reply"} & words for words in names)
    # A name marks its element where all its words do, or but neutral ones and numbers; share-prices isn't a share box.
    return tag not in ("html", "body", "main") and any(words & MARKS and all(w in MARKS or w in NEUTRAL or w.isdigit() for w in words) for words in names)


def blocks_of(page: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The root of a page's block tree, and its texts in order with the block that each stands in."""
    root = Node("", "", None, False, False)
    at, texts, parts, place = root, [], [], 0
    barred_inline: list[str] = []

    def flush() -> None:
        text = " ".join("".join(parts).split())
        parts.clear()
        if text:
            leaf = Node("#", "#", at, at.barred, at.inside)
            at.home.children.append(leaf)
            texts.append((leaf, text))

    for start, end, closes, tag, inner in tags(page):
        if place < start and not barred_inline:
            parts.append(markup.unescape(page[place:start]))
        place = end
        if not tag:
            continue
        if tag == "br":
            parts.append(" ")
        elif tag not in BLOCKS:
            if barred_inline:
                if tag == barred_inline[0]:
                    barred_inline.append(tag) if not closes else barred_inline.pop()
            elif not closes and tag not in VOID:
                attrs = _attributes(inner)
                if _is_barred(tag, attrs, at.inside):
                    barred_inline.append(tag)
        else:
            barred_inline.clear()
            flush()
            if closes:
                up = at
                while up is not root and up.tag != tag:
                    up = up.parent
                if up is not root:
                    at = up.parent
            else:
                while at is not root and tag in CLOSES.get(at.tag, ()):
                    at = at.parent
                attrs = _attributes(inner) if inner else {}
                name = " ".join(x for x in (attrs.get("class", ""), attrs.get("id", "")) if x)
                inside = at.inside or tag in ("article", "main") or attrs.get("role", "").lower() == "main"
                node = Node(f"{tag}.{name}" if name else tag, tag, at, at.barred or _is_barred(tag, attrs, at.inside), inside)
                if node.home is node:
                    at.children.append(node)
                if tag != "hr":
                    at = node
    if place < len(page) and not barred_inline:
        rest = page[place:]
        cut = re.search(r"<[a-zA-Z/!?]", rest)  # a tag that the page's end cuts off
        parts.append(markup.unescape(rest[: cut.start()] if cut else rest))
    flush()
    return root, texts


def _attributes(text: str) -> dict[str, str]:
    return {(m[1] or m[3]).lower(): markup.unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(text)}


Shape = tuple[str, tuple]  # label, shapes of the children


def shape(node: Node, nodes: dict[int, tuple[int, ...]], path: tuple[int, ...] = ()) -> Shape:
    """A tree's shape, with runs of children of equal shape as one; ``nodes`` gets the place of each node in it."""
    out: list[Shape] = []
    for child in node.children:
        nodes[id(child)] = (*path, len(out))
        s = shape(child, nodes, (*path, len(out)))
        if out and out[-1] == s:
            _place(child, nodes, (*path, len(out) - 1))
        else:
            out.append(s)
    return node.label, tuple(out)


def _place(node: Node, nodes: dict[int, tuple[int, ...]], path: tuple[int, ...]) -> None:
    """Moves a node and what is below it to ``path``."""
    old = nodes[id(node)]
    stack = [node]
    while stack:
        n = stack.pop()
        nodes[id(n)] = path + nodes[id(n)][len(old) :]
        stack.extend(n.children)


Pairs = list[tuple[tuple[int, ...], tuple[int, ...]]]


def size_of(s: Shape) -> int:
    return 1 + sum(map(size_of, s[1]))


def identity(s: Shape, path: tuple[int, ...] = ()) -> Iterator[tuple[int, ...]]:
    """The places of a tree."""
    yield path
    for i, child in enumerate(s[1]):
        yield from identity(child, (*path, i))


def match(a: Shape, b: Shape, known: dict[tuple[Shape, Shape], tuple[int, Pairs]] | None = None) -> tuple[int, Pairs]:
    """Simple tree matching: the size of the largest order-keeping match of two trees, and the pairs of places.

    Equal subtrees are matched as they are: equal trees, and equal children at the begin and at the end, which some largest
    match pairs. The table is over the children between them; pairs of children that come again are matched once.
    """
    if a[0] != b[0]:
        return 0, []
    if a == b:
        return size_of(a), [(p, p) for p in identity(a)]
    known = {} if known is None else known
    x, y = a[1], b[1]
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    pairs: Pairs = [((), ())]
    total = 1
    for i, j in [(i, i) for i in range(head)] + [(len(x) - k, len(y) - k) for k in range(1, tail + 1)]:
        total += size_of(x[i])
        pairs += [((i, *p), (j, *p)) for p in identity(x[i])]
    x, y = x[head : len(x) - tail], y[head : len(y) - tail]
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    inner = {}
    for i, p in enumerate(x):
        for j, q in enumerate(y):
            if p[0] == q[0]:
                if (p, q) not in known:
                    known[p, q] = match(p, q, known)
                inner[i, j] = known[p, q]
            table[i + 1][j + 1] = max(table[i][j + 1], table[i + 1][j], table[i][j] + (inner[i, j][0] if (i, j) in inner else 0))
    i, j = len(x), len(y)
    while i and j:
        w, below = inner.get((i - 1, j - 1), (0, []))
        if w and table[i][j] == table[i - 1][j - 1] + w:
            pairs += [((head + i - 1, *p), (head + j - 1, *q)) for p, q in below]
            i, j = i - 1, j - 1
        elif table[i][j] == table[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return total + table[-1][-1], pairs


def read_shape(text: str) -> Shape:
    def shaped(x: list) -> Shape:
        return x[0], tuple(shaped(c) for c in x[1])

    return shaped(json.loads(text)) if text else ("", ())


def write_shape(s: Shape) -> str:
    return json.dumps(s)


class Aligner:
    """Aligns pages with their host's reference tree; equal shapes are aligned once."""

    def __init__(self, most: int = 4096):
        self.references: dict[str, Shape] = {}
        self.known: dict[tuple[str, Shape], dict[tuple[int, ...], str]] = {}
        self.most = most

    def slots(self, page: str, reference: str) -> list[tuple[str, Node, str]]:
        """(slot, leaf, text) by text: its place in the reference tree, or in the page's own where nothing matches."""
        root, texts = blocks_of(page)
        places: dict[int, tuple[int, ...]] = {}
        own = shape(root, places)
        key = reference, own
        if key not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
                self.references.clear()
            if reference not in self.references:
                self.references[reference] = read_shape(reference)
            _, pairs = match(own, self.references[reference])
            self.known[key] = {p: "/".join(map(str, q)) for p, q in pairs}
        to = self.known[key]
        return [(to.get(places[id(leaf)], "own:" + "/".join(map(str, places[id(leaf)]))), leaf, text) for leaf, text in texts]


def _key(slot: str, text: str) -> int:
    return xxhash.xxh64_intdigest(f"{slot}\0{text}") - (1 << 63)


def host_of(url: Column) -> Column:
    """The host of an address, in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _references(pages: DataFrame) -> DataFrame:
    """(host, reference): the shape of each host's page of smallest id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shapes = [write_shape(shape(blocks_of(h or "")[0], {})) for h in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(shapes, pa.string())], ["host", "reference"])

    first = pages.groupBy("host").agg(F.min_by("html", F.struct("page_id", F.xxhash64("html"))).alias("html"))
    return first.mapInArrow(run, "host string, reference string")


def _with_wrapper(pages: DataFrame, wrappers: DataFrame, names: list[str], size: int) -> DataFrame:
    """``pages`` with their host's wrapper: sent to all executors where small, otherwise by a join on salted hosts."""
    if size <= BROADCAST_BYTES:
        return pages.join(F.broadcast(wrappers), "host", "left").select(*names)
    salted = wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left").select(*names)


def induce(pages: DataFrame, share: float = TEMPLATE_SHARE, least: int = TEMPLATE_PAGES) -> tuple[DataFrame, int]:
    """(host, reference, template): each host's wrapper, template the keys of its constant texts; and their size in bytes."""
    references = durable(_references(pages))
    size = references.agg(F.coalesce(F.sum(F.length("reference") + F.length("host")), F.lit(0))).first()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner()
        for b in batches:
            hosts, keys, marks = [], [], []
            for host, page, reference in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = aligner.slots(page or "", reference or "")
                mark = xxhash.xxh64_intdigest("\0".join(t for _, _, t in found)) - (1 << 63)
                mine = {None} | {_key(slot, text) for slot, _, text in found}  # None counts the page itself
                hosts += [host] * len(mine)
                keys += mine
                marks += [mark] * len(mine)
            yield pa.record_batch([pa.array(hosts, pa.string()), pa.array(keys, pa.int64()), pa.array(marks, pa.int64())], ["host", "key", "mark"])

    seen = _with_wrapper(pages, references, ["host", "html", "reference"], size).mapInArrow(run, "host string, key long, mark long")
    counts = durable(seen.groupBy("host", "key").agg(F.count_distinct("mark").alias("n")).filter((F.col("n") >= least) | F.col("key").isNull()))
    total = counts.filter("key IS NULL").select("host", F.col("n").alias("pages"))
    constant = counts.filter("key IS NOT NULL").join(total, "host").filter(F.col("n") >= share * F.col("pages")).groupBy("host").agg(F.sort_array(F.collect_list("key")).alias("template"))
    wrappers = durable(references.join(constant, "host", "left"))
    size = wrappers.agg(F.coalesce(F.sum(F.length("reference") + F.length("host") + 8 * F.greatest(F.size("template"), F.lit(0))), F.lit(0))).first()[0]
    return wrappers, size


def main_text(page: str, reference: str, template: frozenset[int], aligner: Aligner) -> str:
    """The texts of a page that are neither template nor barred; those in an article, where it has one with text."""
    rest = [(leaf, text) for slot, leaf, text in aligner.slots(page, reference) if not leaf.barred and _key(slot, text) not in template]
    inside = [text for leaf, text in rest if leaf.inside]
    return "\n".join(inside or [text for _, text in rest])


def extract(pages: DataFrame, share: float = TEMPLATE_SHARE, least: int = TEMPLATE_PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) by row of ``pages`` (page_id, url, html; other columns are not read).

    Null html counts as empty and gives an empty text. Pages without a host form a host of their own. Pages of equal
    texts count once towards its template, so that copies don't make content constant. Repeated rows and null ids pass
    through; an empty table gives no rows.
    """
    cut = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    wrappers, size = induce(cut, share, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner()
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("html", "reference", "template")), strict=True)
            texts = [main_text(h or "", r or "", frozenset(t or ()), aligner) for h, r, t in rows]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    found = _with_wrapper(cut, wrappers, ["page_id", "url", "html", "reference", "template"], size).mapInArrow(run, f"page_id {kind}, url string, text string")
    return found.withColumn("n_chars", F.length("text").cast("long"))
