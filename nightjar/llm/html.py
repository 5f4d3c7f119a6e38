"""HTML extraction (operator 9) with site template removal.

Elements that say what they are (menus, headers, footers, sidebars, notices, adverts, forms,
scripts, reader comments) are deleted by tag, role or class name. Every other element is hashed
with all that is below it (tags and text). Spark counts on how many different pages of a host,
and of a section of it (the first folder of the path), each hash occurs; a subtree that recurs on
many of them is a template of the site and is deleted. What is left of the article is the text.

Pages are told apart by what they hold besides the subtree, so copies of one page, however
many, count once and never turn their own text into a template. A template stands on
``MIN_PAGES`` different pages at least and on ``SHARE`` of its host's or section's, or is a
container outside the article on ``MANY`` of them, whatever the share (a notice on some pages
of a large host).

Paragraphs of an article may recur too (a quote, a licence line); they are content. So inside
``<article>`` or ``<main>`` only subtrees of container elements count as templates, by their share.

Defined results: null or empty html gives an empty text; a page with a null or odd url
belongs to the host ``""``; broken markup (unclosed elements, unfinished tags) is read as a
browser would, as far as tags go; repeated rows are extracted alike and count as one page;
empty tables give empty results. Extra columns travel in ``row``.
"""
from __future__ import annotations

import functools
import hashlib
import re
from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MIN_PAGES = 5           # a template is on so many different pages of its host or section at least,
SHARE = 0.3             # and on this share of them;
MANY = 20               # a container outside the article on so many is one at any share
BROADCAST = 200_000     # templates (site and hash, some 40 bytes each) that may be broadcast

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select "
    "summary table tbody td tfoot th thead title tr ul".split())
CONTAINERS = frozenset("div section ul ol dl table figure details menu".split())
DROPPED = frozenset(
    "head script style noscript template iframe object svg canvas audio video nav footer aside form button select "
    "input textarea label dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Parts of class names and ids that mark an element as no part of the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation "
    "menu breadcrumb breadcrumbs header masthead footer sidebar notice notices cookie cookies consent gdpr alert popup "
    "modal overlay newsletter subscribe subscription signup login comment comments disqus replies respond share "
    "sharing social related recommended teaser widget pagination pager toolbar".split())
#: End tags that a start tag implies: an open element of the values is closed first.
CLOSES = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"},
          "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
CLOSES |= {t: {"p"} for t in BLOCKS - set(CLOSES) - {"html", "body"}}
#: An implied end tag does not reach out of these.
SCOPES = frozenset("article aside blockquote body div footer form header main nav section table td th ul ol dl".split())


class Node:
    __slots__ = ("tag", "marks", "role", "children", "hash", "sum")

    def __init__(self, tag, attrs=()):
        self.tag, self.children, self.hash, self.sum = tag, [], None, 0
        named = dict(attrs)
        self.role = (named.get("role") or "").lower()
        self.marks = frozenset(re.split(r"[^a-z]+", f"{named.get('class') or ''} {named.get('id') or ''}".lower())) \
            if "class" in named or "id" in named else frozenset()


class Tree(HTMLParser):
    """The element tree of a page; text nodes are strings."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = Node("#top")
        self.open = [self.top]

    def handle_starttag(self, tag, attrs):
        ends = CLOSES.get(tag)
        if ends:
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in ends:
                    del self.open[i:]
                    break
                if self.open[i].tag in SCOPES:
                    break
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        self.open[-1].children.append(data)


UNFINISHED = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")


def tree(html: str) -> Node:
    parser = Tree()
    parser.feed(UNFINISHED.sub("", html))
    parser.close()
    return parser.top


def walk(node):
    """All elements, without recursion: pages may nest deeply."""
    stack = [node]
    while stack:
        n = stack.pop()
        yield n
        stack.extend(c for c in reversed(n.children) if type(c) is Node)


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "big", signed=True)


def hash_all(top) -> None:
    """Hashes every subtree: its tag, texts (white space normalised) and children in order.
    ``sum`` adds up the hashes of its texts."""
    for n in reversed(list(walk(top))):
        parts, n.sum = [n.tag.encode()], 0
        for c in n.children:
            if type(c) is Node:
                parts.append(b"\x01" + c.hash.to_bytes(8, "big", signed=True))
                n.sum += c.sum
            elif s := c.split():
                parts.append(b"\x02" + " ".join(s).encode("utf-8", "surrogatepass"))
                n.sum += _hash(parts[-1])
        n.hash = _hash(b"\x00".join(parts))


def boilerplate(node, inside: bool) -> bool:
    """Whether an element says that it is no part of the article. A ``<header>`` inside the
    article holds its title."""
    if node.tag in DROPPED or node.role in ROLES or (node.tag == "header" and not inside):
        return True
    marks = MARKS - {"header"} if inside else MARKS
    return bool(node.marks & marks) and node.tag not in ("html", "body", "article", "main") \
        or node.tag == "article" and bool(node.marks & {"comment", "comments", "teaser", "related", "ad"})


def prune(top) -> None:
    """Deletes boilerplate from the tree."""
    stack = [(top, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag in ("article", "main")
        node.children = [c for c in node.children if type(c) is str or not boilerplate(c, inside)]
        stack.extend((c, inside) for c in node.children if type(c) is Node)


def candidates(top):
    """The elements that may be templates, with their parents and whether they lie inside the
    article."""
    stack = [(top, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag in ("article", "main")
        for c in node.children:
            if type(c) is Node:
                if c.tag not in ("article", "main", "body", "html") and (c.tag in CONTAINERS or not inside):
                    yield c, node, inside
                stack.append((c, inside))


def main_parts(top) -> list[Node]:
    """The outermost articles; else the main element; else the whole page."""
    for tag in ("article", "main"):
        found, stack = [], [top]
        while stack:
            n = stack.pop()
            if n.tag == tag:
                found.append(n)
            else:
                stack.extend(c for c in reversed(n.children) if type(c) is Node)
        if found:
            return found
    return [top]


def blocks(node) -> list[str]:
    """Texts of the blocks in page order, white space inside one as a single space."""
    out, now, stack = [], [], [node]

    def flush():
        if text := " ".join("".join(now).split()):
            out.append(text)
        now.clear()

    while stack:
        n = stack.pop()
        if n is None:
            flush()
        elif type(n) is str:
            now.append(n)
        elif n.tag == "br":
            now.append("\n")
        else:
            block = n.tag in BLOCKS
            if block:
                flush()
                stack.append(None)
            stack.extend(reversed(n.children))
    flush()
    return out


def subtrees(html: str) -> tuple[int, list[dict]]:
    """The hash of a page's texts, and its distinct subtrees with text that could be templates:
    hash, hash of the texts besides it, and whether it is a container outside the article."""
    top = tree(html)
    prune(top)
    hash_all(top)
    found = {}
    for c, _, inside in candidates(top):
        if c.sum:
            box = c.tag in CONTAINERS and not inside
            found.setdefault(c.hash, {"hash": c.hash, "rest": _signed(top.sum - c.sum), "container": box})
    return _signed(top.sum), list(found.values())


def _signed(n: int) -> int:
    return (n + 2 ** 63) % 2 ** 64 - 2 ** 63


def extract(html: str, templates=frozenset()) -> str:
    """Main text of a page, without the templates of its host."""
    if not html:
        return ""
    top = tree(html)
    prune(top)
    if templates:
        hash_all(top)
        for c, parent, _ in list(candidates(top)):
            if c.hash in templates:
                parent.children = [x for x in parent.children if x is not c]
    return "\n\n".join(b for part in main_parts(top) for b in blocks(part))


def host_of(url: str = "url") -> Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def section_of(url: str = "url") -> Column:
    """The host and the first folder of the path; null for pages outside any folder."""
    folder = F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^/?#]+)/", 1)
    return F.when(folder != "", F.concat(host_of(url), F.lit("/"), folder))


def templates(pages: DataFrame, url: str = "url", html: str = "html", min_pages: int = MIN_PAGES,
              share: float = SHARE, many: int = MANY) -> DataFrame:
    """``(site, hash)`` of the templates; a site is a host or a section of one."""
    hashed = common.materialise(common.add_columns(
        pages.select(F.array_compact(F.array(host_of(url), section_of(url))).alias("sites"), F.col(html).alias("html")),
        {"html": common.text_of("html")}, lambda texts: [list(x) for x in zip(*map(subtrees, texts))] or [[], []],
        [common.field("page", T.LongType()), common.field("found", T.ArrayType(T.StructType([
            common.field("hash", T.LongType()), common.field("rest", T.LongType()), common.field("container", T.BooleanType())])))],
        carry=["sites"]).select(F.explode("row.sites").alias("site"), "page", "found"), "subtrees")
    # different pages of each subtree, then their number: a common subtree's pages are spread
    counted = hashed.select("site", F.explode("found").alias("x")).select("site", "x.*").distinct() \
        .groupBy("site", "hash").agg(F.count(F.lit(1)).alias("n"), F.bool_and("container").alias("container")) \
        .where(F.col("n") >= min_pages)
    size = hashed.select("site", "page").distinct().groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    recurring = (F.col("n") >= share * F.col("pages")) | (F.col("container") & (F.col("n") >= many))
    return counted.join(size, "site").where(recurring).select("site", "hash")


@functools.lru_cache(maxsize=256)
def _known(of_host: tuple, of_section: tuple) -> frozenset:
    return frozenset(of_host + of_section)


def main_text(pages: DataFrame, url: str = "url", html: str = "html", carry: list[str] | None = None) -> DataFrame:
    """``row`` and ``main``, the main text of each whole page.

    The templates of a site are at most (subtrees of a page) / ``SHARE`` and the containers on
    ``MANY`` pages, far fewer than its pages. Their lists are broadcast if they are few enough;
    else they are joined by site, where Spark splits a site that has many pages."""
    found = common.materialise(templates(pages, url, html), "templates")
    lists = found.groupBy("site").agg(F.sort_array(F.collect_set("hash")).alias("hashes"))
    if found.limit(BROADCAST + 1).count() <= BROADCAST:
        lists = F.broadcast(lists)
    row = F.struct(*[F.col(f"`{c}`") for c in carry or pages.columns]).alias("row")
    joined = pages.select(row, F.col(html).alias("html"), host_of(url).alias("host"), section_of(url).alias("section"))
    for of, name in (("host", "of_host"), ("section", "of_section")):
        joined = joined.join(lists.select(F.col("site").alias(of), F.col("hashes").alias(name)), of, "left")

    def run(texts, of_host, of_section):
        return [[extract(t, _known(tuple(a or ()), tuple(b or ()))) for t, a, b in zip(texts, of_host, of_section)]]

    out = common.add_columns(joined, {"html": common.text_of("html"), "of_host": F.col("of_host"),
                                      "of_section": F.col("of_section")}, run,
                             [common.field("main", T.StringType())], carry=["row"])
    return out.select("row.row", "main")


def op9_html(spark, sf_dir: str) -> DataFrame:
    found = main_text(common.table(spark, sf_dir, "pages"), carry=["page_id", "url"])
    return found.select("row.page_id", "row.url", F.col("main").alias("text"),
                        F.length("main").cast("long").alias("n_chars"))
