"""HTML extraction: composite text density.

The page becomes a tree of elements. Each node knows, for its subtree, its characters C, tags T, link characters LC and
link tags LT, and has the link-adjusted composite density

    D = C/T * log_base(C/LC * T/LT),  base = ln(C * LC / nonlink + C * LC_body / C_body + e)

(zeros taken as one). A node's density sum is the sum of its children's densities. The node of the greatest sum is the
core; the least density on the path from it up to ``body`` is the threshold.

Boilerplate counts nothing and is left out: elements that never hold article text (navigation, forms, scripts, ...),
hidden ones, elements whose class, id or role names advertising, notices, comments and so on, and outside articles lists
of links. A name decides only if it is made of such words ("comment-list", not "no-sidebar" or "related-work"), and never on
headings, on an element that holds the page's heading or an article, or, unless it names comments or the page has an
article elsewhere, on one that holds most of the text there is.

The path from the core is followed up to the ``article`` or ``main`` around it, or else up to ``body``: a node beside it
stays if its density reaches the threshold, or if it is a heading, paragraph, list, table, figure or the like and not
mostly links; inside an ``article`` or ``main`` only what is mostly links goes.

Defined results: null, empty and tag-only pages give an empty text; text without any tag is one block; markup that is
cut short or badly nested is read as far as it goes (an unclosed script or style runs to the end); very long pages and
nesting of any depth take linear time, without recursion; of equal density sums the first in page order is the core;
repeated rows get equal results; an empty table gives no rows; extra columns, whatever their names, are ignored.
"""

from __future__ import annotations

import html
import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .support import decode, per_text

# Element names by role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg canvas audio video select noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
MATHS = frozenset("annotation maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover none semantics".split())
NEVER = frozenset("head nav header footer aside form button menu dialog fieldset input option".split()) | RAW
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSERS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "table tr"), "th": ("td th", "table tr"), "option": ("option", "select"), "tbody": ("tbody thead tfoot", "table"), "thead": ("tbody thead tfoot", "table"), "tfoot": ("tbody thead tfoot", "table")}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = HEADINGS | frozenset("p ul ol dl pre blockquote table figure section article main hgroup details".split())
LISTS = frozenset("ul ol dl table".split())
# Words of class, id and role names that mark boilerplate, and words that may stand beside them.
ROLES = frozenset(
    "ad ads adsbygoogle advert adverts advertisement advertisements advertising banner banners sponsor sponsored promo promos promotion breadcrumb breadcrumbs comment comments disqus replies respond cookie cookies consent gdpr notice notices newsletter subscribe subscription popup modal overlay share sharing social sidebar rail related recommended recommendations menu nav navbar navigation toolbar pagination pager header footer masthead copyright login signup search widget widgets skip contentinfo complementary dialog alert toc discussion".split()
)
BESIDE = frozenset(
    "site page post posts entry article articles story stories main global user users reader readers google top bottom left right primary secondary mobile desktop sticky list lists section container wrapper wrap inner outer area box block item items form bar button buttons link links icon icons media thread slot unit content body row col title law info embed mc".split()
)

TOKEN = re.compile(r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']|"[^"]*"|'[^']*')*+)(/?)>?""", re.S)
ATTRIBUTE = re.compile(r"""(?i)(?<![\w-])(class|id|role|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
COMMENTS = re.compile(r"(?i)comment|disqus|repl(?:y|ies)|respond|discussion")
RAW_END = {tag: re.compile(rf"(?i)</{tag}\b[^>]*>") for tag in RAW}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent", "chars", "tags", "link_chars", "link_tags", "density", "total", "dropped", "in_article", "holds_heading")

    def __init__(self, tag: str, attrs: str = "", parent: Node | None = None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.chars = self.link_chars = self.link_tags = 0
        self.tags = 1
        self.density = self.total = 0.0
        self.dropped = self.holds_heading = False
        self.in_article = parent is not None and (parent.in_article or parent.tag in ("article", "main"))


def parse(page: str) -> Node:
    """The element tree; end tags that open nothing are skipped, missing ones implied."""
    root = Node("#root")
    stack = [root]
    places: dict[str, list[int]] = {}  # of each open element name, where on the stack
    endless: set[str] = set()  # raw elements that no end tag follows any more
    at, end = 0, len(page)

    def place(tags: str) -> int:
        return max((places[t][-1] for t in tags.split() if places.get(t)), default=-1)

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            places[stack.pop().tag].pop()

    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if places.get(tag):
                close_to(places[tag][-1])
            elif tag == "br":
                stack[-1].children.append(Node("br", parent=stack[-1]))
            continue
        closes, barrier = CLOSERS.get(tag, ("p", "table td th button object") if tag in CLOSES_P else ("", ""))
        if closes and (inner := place(closes)) > place(barrier):
            close_to(inner)
        child = Node(tag, m[3], stack[-1])
        stack[-1].children.append(child)
        if tag in VOID or tag in MATHS and m[3].endswith("/"):  # a slash closes no element of HTML itself
            continue
        if tag in RAW:
            close = None if tag in endless else RAW_END[tag].search(page, at)
            if close:
                at = close.end()
            else:
                endless.add(tag)
                at = end if tag in ("script", "style") else at
        else:
            places.setdefault(tag, []).append(len(stack))
            stack.append(child)
    return root


def names_boilerplate(node: Node) -> bool:
    """Whether a class, id or role of the element is made of boilerplate words and words that may stand beside them."""
    if not node.attrs or node.tag in HEADINGS or node.tag in ("body", "html", "main"):
        return False
    for m in ATTRIBUTE.finditer(node.attrs):
        name = m[1].lower()
        if name in ("class", "role") or name == "id" and not node.in_article:
            for one in (m[2] or m[3] or m[4] or "").lower().split():
                words = {w for w in re.split(r"[-_]+", one) if w.isalpha()}
                if words & ROLES and words <= ROLES | BESIDE:
                    return True
    return False


def is_hidden(node: Node) -> bool:
    for m in ATTRIBUTE.finditer(node.attrs) if node.attrs else ():
        value, name = (m[2] or m[3] or m[4] or "").lower(), m[1].lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


def never_text(node: Node) -> bool:
    if node.tag == "header":  # an article's own header is part of it
        return not node.in_article
    return node.tag in NEVER or is_hidden(node)


def document_order(root: Node) -> list[Node]:
    """Nodes that may hold text, parents first; subtrees that never do are dropped."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        if node is not root and never_text(node):
            node.dropped = True
            continue
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return order


def measure(order: list[Node]) -> None:
    """Fill in the counts of what is not dropped."""
    for node in reversed(order):
        node.chars = node.link_chars = node.link_tags = 0
        node.tags = 1
        node.holds_heading = node.tag in ("h1", "article", "main")
        for c in () if node.dropped else node.children:
            if isinstance(c, str):
                node.chars += len(c) - c.count(" ") - c.count("\n")
            elif not c.dropped:
                node.chars += c.chars
                node.tags += c.tags
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags
                node.holds_heading |= c.holds_heading
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1


def drop_boilerplate(order: list[Node]) -> None:
    """Named boilerplate and, outside articles, lists of links; what holds the heading, or all the text, stays."""
    everything, articles = order[0].chars, any(n.tag in ("article", "main") and n.chars and not n.dropped for n in order)
    for n in order:
        if n.parent is not None and n.parent.dropped:
            n.dropped = True
        elif not n.dropped and n.chars:
            most = 2 * n.chars > everything and (n.in_article or not articles)
            own_article = (n.holds_heading or most) and not COMMENTS.search(n.attrs)
            linked = n.tag in LISTS and n.link_tags >= 2 and n.link_chars > 0.8 * n.chars and not n.in_article
            n.dropped = n.chars < everything and (linked or names_boilerplate(n) and not own_article)


def composite_density(node: Node, body: Node) -> float:
    if not node.chars:
        return 0.0
    c, t, lc, lt = node.chars, node.tags, max(1, node.link_chars), max(1, node.link_tags)
    base = math.log(c * lc / max(1, c - node.link_chars) + c * max(1, body.link_chars) / max(1, body.chars) + math.e)
    return c / t * max(0.0, math.log(max(1.0, c / lc * t / lt)) / math.log(max(base, 1.0001)) + 1e-9)


def find_core(root: Node, order: list[Node]) -> Node:
    """The element to read out, with what does not belong to the article dropped below it."""
    body = next((n for n in order if n.tag == "body"), root)
    for n in order:
        if not n.dropped:
            n.density = composite_density(n, body)
            if n.parent is not None and n.tag not in INLINE:
                n.parent.total += n.density
    core = max((n for n in order if not n.dropped and n.tag not in INLINE), key=lambda n: n.total, default=root)
    if not core.total:
        return body
    path = [core]
    while path[-1].tag not in ("article", "main") and path[-1] is not body and path[-1].parent is not None:
        path.append(path[-1].parent)
    article = path[-1].tag in ("article", "main")
    threshold = min((n.density for n in path if n.tag not in ("html", "#root")), default=0.0)
    for inner, outer in zip(path, path[1:], strict=False):
        for c in outer.children:
            if isinstance(c, Node) and c is not inner and c.tag not in INLINE and c.density < threshold:
                linked = c.link_chars * 2 > c.chars
                c.dropped |= linked and c.tag not in PROSE if article else linked or c.tag not in PROSE
    for c in core.children:
        if isinstance(c, Node) and c.tag not in INLINE and c.tag not in PROSE and c.density < threshold and c.link_chars * 2 > c.chars:
            c.dropped = True
    return path[-1]


def blocks_of(core: Node) -> list[str]:
    """Texts between block boundaries, character references decoded, white space collapsed, in page order."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            block = " ".join(html.unescape("".join(run)).split())
            run.clear()
            if block:
                out.append(block)

    todo: list[Node | str | None] = [core]
    while todo:
        item = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            run.append(item)
        elif not item.dropped:
            if item.tag in INLINE or item.tag in MATHS:
                todo += reversed(item.children)
            else:
                flush()
                todo.append(None)
                todo += reversed(item.children)
    flush()
    return out


def extract(page: str) -> str:
    root = parse(page)
    order = document_order(root)
    measure(order)
    drop_boilerplate(order)
    measure(order)
    return " ".join(blocks_of(find_core(root, order)))


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""

    def make():
        def work(texts: list[bytes]) -> list[list]:
            found = [extract(decode(t)) for t in texts]
            return [found, list(map(len, found))]

        return work

    keyed = pages.select(F.struct("page_id", "url").alias("key"), "html")
    return per_text(keyed, "key", "html", [("text", T.StringType()), ("n_chars", T.LongType())], make).select("key.page_id", "key.url", "text", "n_chars")
