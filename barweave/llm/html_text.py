"""Main text of HTML pages by tree scoring.

A page becomes an element tree under the usual rules for implied end tags.
Clutter (menus, page headers and footers, sidebars, notices, adverts, forms,
comments, hidden parts) is cut by element, role and class words.  Each block
of text passes points, one and more for length and commas, to its ancestors: in full to the
parent, half to the next, and less above; points are discounted by the share of
link text.  The best container is kept whole, with siblings that score like it.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import arrow_type

# Element kinds of HTML and the class words of page furniture.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe template textarea title svg math canvas object select button noembed noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_ITSELF = {
    "li": ("li", ("ul", "ol", "menu", "dir")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
}
CUT_TAGS = frozenset("nav aside footer form head dialog menu fieldset".split())
CUT_ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog form menu menubar toolbar".split())
CUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner sponsor sponsored promo promotion cookie cookies consent "
    "gdpr notice notices notification alert nav navbar navigation menu menus breadcrumb breadcrumbs sidebar sidebars aside footer header "
    "masthead topbar comment comments commentlist respond disqus reply replies discussion share sharing social related recommended "
    "recommendations newsletter subscribe subscription signup login popup modal overlay widget widgets toolbar pager pagination "
    "copyright disclaimer paywall skip search outbrain taboola".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist respond disqus reply replies discussion".split())
HOLDS_WORDS = frozenset("article content entry hentry main story".split())
POINTS = {"article": 25, "main": 20, "section": 3, "div": 5, "pre": 3, "td": 3, "blockquote": 3}
POINTS |= dict.fromkeys("address ol ul dl dd dt li form th".split(), -3)
GOOD_WORDS = frozenset("article body content entry hentry main post story text blog".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")


class Node:
    __slots__ = ("tag", "words", "roles", "hidden", "parent", "kids", "size", "linked", "marked", "named", "points", "cut")

    def __init__(self, tag: str, parent: "Node | None" = None):
        self.tag, self.parent, self.kids = tag, parent, []
        self.words, self.roles, self.hidden = frozenset(), frozenset(), False
        self.size = self.linked = 0
        self.points = 0.0
        self.marked = self.named = self.cut = False

    def attributes(self, text: str) -> None:
        for name, value in _ATTR.findall(text):
            name, value = name.lower(), value.strip("\"'")
            if name in ("class", "id"):
                self.words |= {w.lower() for w in _WORD.findall(value)} | set(value.lower().split())
            elif name == "role":
                self.roles = frozenset(value.lower().split())
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                self.hidden = True
            elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                self.hidden = True


def _tag_end(page: str, at: int) -> int:
    """Place of the ``>`` that ends a tag, outside quotes if they close before the next tag; every character is seen once."""
    end, seen = page.find(">", at), at
    double = single = 0
    while end >= 0:
        double += page.count('"', seen, end)
        single += page.count("'", seen, end)
        if double % 2 == 0 and single % 2 == 0 or page.find("<", max(seen, at + 1), end) >= 0:
            return end
        seen, nxt = end, page.find(">", end + 1)
        if nxt < 0 or page.find("<", end + 1, nxt) >= 0:
            return end
        end = nxt
    return end


def parse(page: str) -> Node:
    """The element tree; unclosed, misnested and cut-off markup gives some tree, never an error."""
    root = Node("#root")
    stack, opened = [root], {}

    def pop() -> None:
        opened[stack.pop().tag] -= 1

    def close(names, until=()) -> None:
        """Close the innermost open element of ``names`` unless one of ``until`` stands between."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                while len(stack) > i:
                    pop()
                return
            if stack[i].tag in until:
                return

    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            stack[-1].kids.append(page[at:lt])
        if lt >= n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        nxt = page[lt + 1 : lt + 2]
        if nxt in ("!", "?"):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        closing = nxt == "/"
        name = _NAME.match(page, lt + 1 + closing)
        if not name:
            if closing:
                end = page.find(">", lt)
                at = n if end < 0 else end + 1
            else:
                stack[-1].kids.append("<")
                at = lt + 1
            continue
        tag = name[0].lower()
        end = _tag_end(page, name.end())
        if end < 0:
            break  # a tag cut off at the end of the page
        at = end + 1
        if closing:
            if opened.get(tag):
                close((tag,), ("table",) if tag not in ("table", "html", "body") and opened.get("table") else ())
            continue
        if tag in BLOCK and opened.get("p"):
            close(("p",), ("button", "table", "td", "th", "caption"))
        if tag in CLOSES_ITSELF:
            names, until = CLOSES_ITSELF[tag]
            close(names.split(), until)
        node = Node(tag, stack[-1])
        attrs = page[name.end() : end]
        if "=" in attrs or "hidden" in attrs:
            node.attributes(attrs)
        stack[-1].kids.append(node)
        if tag in RAW:
            if not attrs.endswith("/"):
                low = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
                end = page.find(">", low.end()) if low else -1
                at = n if end < 0 else end + 1
            continue
        if tag not in VOID and not (attrs.endswith("/") and tag not in BLOCK):
            stack.append(node)
            opened[tag] = opened.get(tag, 0) + 1
    return root


def _in_order(root: Node) -> list[Node]:
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [k for k in node.kids if isinstance(k, Node)]
    return out


def _measure(nodes: list[Node]) -> None:
    """Sizes of text and link text, and which elements hold an article, a main part or a first heading; from the leaves up."""
    for node in nodes:
        node.size = node.linked = 0
        clean = not node.words & CUT_WORDS
        node.marked = node.tag in ("main", "h1", "body") or node.tag == "article" and clean
        node.named = node.marked or clean and bool(node.words & HOLDS_WORDS)
    for node in reversed(nodes):
        own = sum(len(k.strip()) for k in node.kids if isinstance(k, str))
        if node.tag in RAW:
            own = 0
        node.size += own
        if node.tag == "a":
            node.linked = node.size
        if node.parent is not None and not node.cut:
            node.parent.size += node.size
            node.parent.linked += node.linked
            node.parent.marked |= node.marked
            node.parent.named |= node.named


def _furniture(node: Node, in_article: bool) -> bool:
    """Whether an element is page furniture.  A wrapper of the article is none, whatever its class."""
    if node.tag in RAW or node.hidden or node.tag in CUT_TAGS and node.tag != "form":
        return True
    if node.tag in ("html", "body", "main", "#root"):
        return False
    if node.tag == "article":
        return bool(node.words & {"comment", "comments", "related", "ad", "advert", "promo", "teaser"})
    kids = [k for k in node.kids if isinstance(k, Node)]
    if node.tag == "header":
        return node.size > 0 and node.linked > node.size / 2 if in_article else not any(k.tag in ("article", "main") for k in kids)
    if node.words & COMMENT_WORDS:
        return not any(k.marked for k in kids)
    if node.tag == "form" or node.roles & CUT_ROLES or node.words & CUT_WORDS:
        return not any(k.named for k in kids)
    return False


def _cut(root: Node) -> None:
    todo = [(root, False)]
    while todo:
        node, inside = todo.pop()
        inside |= node.tag in ("article", "main")
        for k in node.kids:
            if isinstance(k, Node):
                k.cut = _furniture(k, inside)
                if not k.cut:
                    todo.append((k, inside))


def _blocks(root: Node):
    """``(element, text)`` of the blocks under an element, in page order."""
    out: list[tuple[Node, str]] = []
    held: list[str] = []

    def flush(owner: Node) -> None:
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((owner, text))

    todo: list[tuple[Node, Node, int]] = [(root, root, 0)]
    while todo:
        node, owner, i = todo.pop()
        while i < len(node.kids):
            k = node.kids[i]
            i += 1
            if isinstance(k, str):
                held.append(k)
            elif k.cut:
                if k.tag in BLOCK:
                    flush(owner)
                else:
                    held.append(" ")
            elif k.tag == "br":
                held.append(" ")
            else:
                todo.append((node, owner, i))
                if k.tag in BLOCK:
                    flush(owner)
                    todo.append((k, k, 0))
                else:
                    todo.append((k, owner, 0))
                break
        else:
            if node.tag in BLOCK:
                flush(owner)
    flush(root)
    return out


def _score(root: Node, nodes: list[Node]) -> None:
    for node in nodes:
        node.points = POINTS.get(node.tag, 0) + (25 if node.words & GOOD_WORDS else 0)
    for owner, text in _blocks(root):
        if owner.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            continue
        gain = 1 + text.count(",") + min(len(text) / 100, 3)
        up, level = (owner.parent if owner.tag in ("p", "pre", "li", "td") else owner), 0
        while up is not None and level < 5:
            up.points += gain / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up, level = up.parent, level + 1


def _worth(node: Node) -> float:
    return node.points * (1 - node.linked / node.size) if node.size else float("-inf")


def _keep(root: Node, nodes: list[Node]) -> list[Node]:
    """The best container, raised to the article or main part around it, and siblings like it."""
    live = [x for x in nodes if x.tag in BLOCK and x.tag not in ("p", "html", "body", "li", "tr", "ul", "ol") and x.size]
    if not live:
        body = [x for x in nodes if x.tag == "body"]
        return body[:1] or [root]
    best = max(live, key=_worth)
    up = best.parent
    while up is not None:
        if up.tag in ("article", "main"):
            best = up
            if up.tag == "article":
                break
        up = up.parent
    if best.parent is None:
        return [best]
    least = max(10.0, 0.2 * _worth(best))
    out = []
    for k in best.parent.kids:
        if not isinstance(k, Node) or k.cut or not k.size:
            continue
        density = k.linked / k.size
        same = bool(best.words & k.words) and best.tag == k.tag
        if k is best or (k.tag in BLOCK and _worth(k) + (0.2 * _worth(best) if same else 0) >= least) or k.tag == "p" and k.size > 80 and density < 0.25:
            out.append(k)
        elif k.tag == "h1" and density < 0.5:
            out.append(k)
    return out


def _link_lists(nodes: list[Node]) -> None:
    """Lists and boxes that are mostly links are menus."""
    for node in nodes:
        if node.tag in ("ul", "ol", "div", "section", "table", "dl") and node.size and node.linked / node.size > 0.6 and not node.marked:
            if sum(isinstance(k, Node) for k in node.kids) >= 3:
                node.cut = True


def main_text(page: str | None) -> str:
    """Blocks of the main text, joined by a line end; empty for a null, empty or textless page."""
    if not page:
        return ""
    root = parse(page)
    nodes = _in_order(root)
    _measure(nodes)
    _cut(root)
    _link_lists(nodes)
    live, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.cut:
            live.append(node)
            todo += [k for k in node.kids if isinstance(k, Node)]
    _measure(live)
    _score(root, live)
    return "\n".join(text for part in _keep(root, live) for _, text in _blocks(part))


EXTRACTED = "page_id long, url string, text string, n_chars long"


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page; null and empty pages give an empty text.

    Pages are independent: no shuffle, repeated rows stay, other columns are
    left behind.  Parsing is linear in the page.
    """

    def work(batches):
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column("html")]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), sizes], schema=arrow_type(EXTRACTED)
            )

    narrow = df.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    return narrow.mapInArrow(work, EXTRACTED)
