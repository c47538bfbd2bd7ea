"""Main text of web pages by scoring the containers of a tree."""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm._base import read

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=/\"'>]+)")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark picture q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
#: Elements that never hold an article's text.
ASIDE = frozenset("nav footer aside form button select option datalist script style noscript template iframe object svg canvas math audio video map dialog menu title textarea input xmp noembed noframes".split())
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog form toolbar tablist".split())
#: Words of a class or id that mark what surrounds an article.
NAMES = frozenset(
    "ad ads adv advert advertisement advertising advertorial adsense adslot sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification alert popup modal overlay "
    "newsletter subscribe subscription signup share sharing social sidebar sidenav aside menu nav navbar navigation navi breadcrumb breadcrumbs masthead topbar toolbar footer foot comment comments commentlist "
    "disqus reply replies respond responses discussion related recommended recirc widget login paywall pagination pager skip search tags copyright disclaimer legal".split()
)
#: Words that may stand beside one of NAMES without telling of anything else.
BESIDE = frozenset(
    "a area article articles bar block blocks body bottom box btn button buttons by center column container content cols entry form group header holder icons in inner item items left link links list "
    "main module outer page panel policy post posts primary reader region right row secondary section side site slot small stories story text title to top unit user wrap wrapper you your".split()
)
#: Classes and ids that mark the head of a site, not that of an article.
HEADS = frozenset("header site-header page-header global-header main-header top-header header-bar header-wrapper".split())
#: Elements that a start tag closes where one is open, up to the element that bounds it.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset(("p", "pre", "blockquote", *HEADINGS))
PAGE = frozenset(("#page", "html", "body"))
UP = 5  # generations that a paragraph passes points to
LOWERED = 0.1  # of its points stay with a container that a class or id names as furniture, and pass on from it
BONUS = 1.5  # for containers inside an article or main element
BELONGS = 0.2  # of the best score that a neighbour of its own needs


class Node:
    """``block`` is the nearest element that is not inline, ``chars`` and ``linked`` the text below it, ``prose`` its unlinked part in paragraphs."""

    __slots__ = ("block", "chars", "children", "gone", "linked", "named", "parent", "points", "prose", "tag", "weight")

    def __init__(self, tag: str, parent: Node | None, gone: bool = False, named: bool = False):
        self.tag, self.parent, self.gone, self.named = tag, parent, gone, named
        self.block = self if parent is None or tag not in INLINE else parent.block
        self.children: list = []
        self.points, self.chars, self.linked, self.prose = 0.0, 0, 0, 0
        self.weight = 1.0 if parent is None else parent.weight
        if named:
            self.weight *= LOWERED
        if tag in ("article", "main") and self.weight < BONUS:
            self.weight *= BONUS


def _is_name(value: str) -> bool:
    """Whether a class or id says nothing but names of furniture: each word of one of its parts is one of NAMES or stands beside one."""
    for one in re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value).lower().split():
        words = [w for w in re.split(r"[^a-z]+", one) if w]
        if one in HEADS or (any(w in NAMES for w in words) and all(w in NAMES or w in BESIDE for w in words)):
            return True
    return False


def _named(tag: str, rest: str) -> bool:
    if not rest or rest.isspace() or tag in ("html", "body", "article", "main"):
        return False
    return any((m[1] or m[5]).lower() in ("class", "id") and _is_name(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(rest))


def _surrounds(tag: str, rest: str, in_article: bool) -> bool:
    if tag in ASIDE:
        return True
    if tag == "header" and not in_article:
        return True
    if not rest or rest.isspace():
        return False
    if tag in ("html", "body", "article", "main"):
        return False
    for m in ATTRIBUTE.finditer(rest):
        name = (m[1] or m[5]).lower()
        value = (m[2] or m[3] or m[4] or "").lower()
        if (name == "role" and value in ROLES) or name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


class _Open:
    """The open elements, with where those of each tag and the blocks among them lie, so that none has to be searched for."""

    def __init__(self, root: Node):
        self.stack, self.where, self.blocks = [root], {}, [0]

    def push(self, node: Node) -> None:
        self.where.setdefault(node.tag, []).append(len(self.stack))
        if node.tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append(node)

    def last(self, tags) -> int:
        """Where the innermost element of one of the tags lies; 0 if there is none."""
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=0)

    def close(self, at: int) -> None:
        """Close the element at this place and all that are open inside it."""
        while len(self.stack) > at:
            node = self.stack.pop()
            self.where[node.tag].pop()
            if node.tag not in INLINE:
                self.blocks.pop()


def parse(html: str) -> tuple[Node, list[Node]]:
    """A tree of the page and its nodes in page order; unclosed and misnested tags are closed as browsers roughly do.

    Each tag costs the same however deep it stands.
    """
    root = Node("#page", None)
    opened, at, n = _Open(root), 0, len(html)
    nodes, stack = [root], opened.stack

    def text(piece: str) -> None:
        if piece:
            stack[-1].children.append(unescape(piece))

    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            text(html[at:])
            break
        m = TOKEN.match(html, lt) or LOOSE.match(html, lt)
        if not m:
            text(html[at : lt + 1])
            at = lt + 1
            continue
        text(html[at:lt])
        at = m.end()
        if not m.lastindex:
            continue
        tag, rest = m[2].lower(), m[3]
        if m[1]:
            k = opened.last((tag,))
            if k and (tag not in INLINE or k > opened.blocks[-1]):  # no end of an inline element goes beyond its block
                opened.close(k)
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            at = n if end is None else (html.find(">", end.end()) + 1 or n)
            continue
        if tag not in INLINE:
            k = opened.blocks[-1]
            if stack[k].tag == "p" or (tag in HEADINGS and stack[k].tag in HEADINGS):
                opened.close(k)
            if tag in CLOSES:
                shut, bound = CLOSES[tag]
                while (k := opened.last(shut)) > opened.last(bound):
                    opened.close(k)
                    if tag != "tr":
                        break
        if tag in ("html", "body") and opened.last((tag,)):
            continue
        gone = stack[-1].gone or _surrounds(tag, rest, opened.last(("article", "main")) > 0)
        node = Node(tag, stack[-1], gone, not gone and _named(tag, rest))
        nodes.append(node)
        stack[-1].children.append(node)
        if tag not in VOID and not (tag in ("svg", "math") and rest.endswith("/")):
            opened.push(node)
    return root, nodes


def _walk(top: Node):
    """(event, item, nearest block) in page order: text, open and close of elements that are kept."""
    todo: list = [iter(top.children)]
    path = [top]
    while todo:
        for child in todo[-1]:
            if isinstance(child, str):
                yield "text", child, path[-1]
            elif not child.gone:
                yield "open", child, path[-1]
                todo.append(iter(child.children))
                path.append(child)
                break
        else:
            todo.pop()
            node = path.pop()
            if todo:
                yield "close", node, path[-1]


def _score(root: Node, nodes: list[Node]) -> None:
    """Give points to the ancestors of each block of text, for its length and commas, less where it is linked."""
    buffer: list[str] = []
    link_depth, linked = 0, 0

    def flush(block: Node) -> None:
        nonlocal linked
        words = " ".join("".join(buffer).split())
        buffer.clear()
        n, links = len(words), min(linked, len(words))
        linked = 0
        if not n:
            return
        block.chars += n
        block.linked += links
        if block.tag in PROSE:
            block.prose += n - links
        if block.tag in HEADINGS:
            return
        points = (1 + min(sum(map(words.count, ",،、，")), n / 20) + min(n / 100, 3)) * (1 - links / n)
        below = block if block.tag in ("p", "pre", "blockquote", "li", "td") and block.parent is not None else None
        up, share = (block.parent, LOWERED if block.named else 1.0) if below else (block, 1.0)
        for step in range(1, UP + 1):
            if up is None:
                break
            up.points += points * share / step
            if up.named:
                share *= LOWERED
            up = up.parent

    for event, item, under in _walk(root):
        if event == "text":
            buffer.append(item)
            if link_depth:
                linked += len(item)
            continue
        if item.tag == "a":
            link_depth += 1 if event == "open" else -1
        elif item.tag == "br":
            buffer.append(" ")
        elif item.tag not in INLINE:
            flush((under if event == "open" else item).block)
    flush(root)
    for node in reversed(nodes):  # children come after their parents
        if node.parent is not None and not node.gone:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
            if not node.named:
                node.parent.prose += node.prose


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _rank(node: Node) -> float:
    return node.points * (1 - _density(node)) * node.weight


def _belongs(x: Node, within: Node, best: float) -> bool:
    """Whether what stands beside the best container or beside one around it is part of the text.

    Names of furniture and mostly linked elements are not. Directly in the
    page an element needs paragraphs or a score, inside a container any text will do.
    """
    if x.gone or x.named or (_density(x) > 0.5 and x.tag not in HEADINGS):
        return False
    return within.tag not in PAGE or x.tag in INLINE or x.prose > 0 or _rank(x) >= BELONGS * best


def _text(root: Node, best: Node) -> list[str]:
    """The blocks of the best container and of what belongs to it, in page order."""
    above, node = set(), best.parent
    while node is not None:
        above.add(id(node))
        node = node.parent
    score, whole = _rank(best), best.tag not in PAGE
    out: list[str] = []
    buffer: list[str] = []

    def flush() -> None:
        words = " ".join("".join(buffer).split())
        buffer.clear()
        if words:
            out.append(words)

    todo = [(root, iter(root.children))]
    while todo:
        node, rest = todo[-1]
        for child in rest:
            if isinstance(child, str):
                buffer.append(child)
                continue
            if child is not best and id(child) not in above:
                if id(node) in above or (node is best and not whole):
                    if not _belongs(child, node if whole else best, score if whole else 0.0):
                        continue
                elif child.gone or child.named:
                    continue
            if child.tag == "br":
                buffer.append(" ")
            elif child.tag not in INLINE:
                flush()
            todo.append((child, iter(child.children)))
            break
        else:
            todo.pop()
            if node.tag not in INLINE:
                flush()
    flush()
    return out


def main_text(html: str | None) -> str:
    """Blocks of the best container and of what belongs to it, joined by blank lines.

    Containers are scored first. Names in a class or id lower a score; they
    and link density decide only about elements beside or inside the best
    container, never about one that it stands in, and link density not inside it.
    """
    if not html:
        return ""
    root, nodes = parse(html)
    _score(root, nodes)
    best, most = root, 0.0
    for node in nodes:
        if not node.gone and node.block is node and (r := _rank(node)) > most:
            best, most = node, r
    return "\n\n".join(_text(root, best))


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    Null and empty pages have an empty text, and so has a page whose text is
    all menus, notices and the like. Text without markup is one block. Whole
    pages are read, unclosed markup included. Repeated rows and null page_ids
    are kept as they come; an empty table gives no rows; other columns are
    ignored.
    """

    def run(batches):
        for b in batches:
            html = b.column(2).to_pylist()
            for i in range(0, len(html), 500):
                some = [main_text(h) for h in html[i : i + 500]]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, 500), b.column(1).slice(i, 500), pa.array(some, pa.string()), pa.array(map(len, some), pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
