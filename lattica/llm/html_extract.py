"""Main text of HTML pages by tree scoring.

A page is parsed into a tree that closes open paragraphs and list items as browsers do. Subtrees that never are content
(menus, headers and footers of the page, forms, scripts, notices, adverts, comments) are left out, but not those that
wrap the page: what holds the longest <article> or <main>, or most of the page's text outside of links, stays, and if
hardly any text would be left, so do the others. A <header> inside an article or section is its heading. Where a name only
hints (teaser, related, disclaimer-text), the link density decides.

Each paragraph has points: one, one more for each comma, and up to three for its length; its parent gets them whole, its
grandparent half and ancestors further up a share that falls with the distance. A container's points are discounted by its
link density. The best container is kept, and of what stands beside it, loose text and lists and headings included, all
but what is mostly links; so on for its ancestors, as long as these lie in an <article> or <main> or are one. Further up,
siblings stay whose points come near the best ones or that have hardly any links and are prose, a heading, or an element
like the one kept. No element is kept for its name alone, and of what is kept nothing but skipped subtrees is left out.

Cases: null or empty html, and pages without any text, give an empty text; markup that is broken or nested without end
is parsed all the same (no recursion); long pages are extracted whole; of containers with equal points the first on the page
is the best; repeated rows are extracted one by one; empty tables give empty results; other columns pass through, but
columns named text or n_chars, which are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The HTML standard's element groups.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - frozenset("br caption dd dt body head html legend li noscript optgroup option select summary tbody td textarea tfoot th thead title tr".split())
#: A start tag closes an open element of these names, unless one of the fences lies between.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "option": (("option",), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "thead": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
}
#: Never content, whatever they hold.
HIDDEN = frozenset("annotation annotation-xml canvas embed iframe input script select style svg template textarea title".split())
#: No content unless they wrap it, as elements with a class or id of BOILERPLATE.
DROPPED = frozenset("aside button dialog footer form head header menu nav noscript search".split())
#: Of those, what never wraps a page.
ENDS = frozenset("button dialog footer menu nav noscript search".split())
#: A header of these is part of the text.
SECTIONS = frozenset("article main section".split())
BOILERPLATE = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adsense|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|footer|gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notification|pagination|pager|popup|promo\w*|replies|respond|share|sharing|shoutbox|sidebar|signup|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.IGNORECASE,
)
NOTICE = re.compile(r"(?:^|\s)disclaimer(?:$|\s)", re.IGNORECASE)
#: No content if there are many links in them.
HINT = re.compile(r"(?:^|[\s_-])(?:disclaimer|recommend\w*|related|teaser)(?:$|[\s_-])", re.IGNORECASE)
#: Other people's words: they may outweigh the page's own text, so their share does not make them content.
APART = re.compile(r"(?:^|(?<=[\s_-]))(?<!has.)(?<!no.)(?<!with.)(?<!without.)(?:comments?|commentlist|disqus|replies|respond)(?![a-z]|[_-](?:open|closed))", re.IGNORECASE)
#: Less than one part in so many of the page's text is hardly any.
LITTLE = 20
GOOD = re.compile(r"article|body|content|entry|hentry|main|page|post|text|blog|story", re.IGNORECASE)
ROLES = frozenset("banner navigation complementary contentinfo search dialog alertdialog menu menubar form".split())
PARAGRAPHS = frozenset("p pre td blockquote li dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Link densities: of what is mostly links, and the most of what hardly has any.
LINKS, FEW_LINKS = 2 / 3, 1 / 4
PROSE_CHARS = 80
START = {"div": 5, "article": 10, "main": 10, "section": 2, "pre": 3, "td": 3, "blockquote": 3, "ul": -3, "ol": -3, "dl": -3, "form": -3, "li": -3}


class Node:
    __slots__ = ("tag", "parent", "parts", "skip", "hidden", "apart", "hint", "links", "chars", "points", "bonus")

    def __init__(self, tag: str, parent: Node | None, skip: bool, hidden: bool, apart: bool, bonus: int):
        self.tag, self.parent, self.skip, self.hidden, self.apart, self.bonus = tag, parent, skip, hidden, apart, bonus
        self.parts: list = []
        self.hint = False
        self.links = self.chars = 0
        self.points: float | None = None


class _Tree(HTMLParser):
    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", None, False, False, False, 0)
        self.open: dict[str, int] = {}
        self.skipped = self.hinted = False

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P and self.open.get("p"):
            self._close(("p",), ("table", "article", "section", "main", "td"))
        elif tag in CLOSES:
            self._close(*CLOSES[tag])
        hidden, skip, apart, hint = self.at.hidden or tag in HIDDEN, tag in DROPPED, self.at.apart, False
        if tag == "header" and any(self.open.get(x) for x in SECTIONS):
            skip = False
        bonus = START.get(tag, 0)
        for k, v in attrs:
            if k in ("class", "id") and v:
                if tag not in ("body", "html", "main") and APART.search(v):
                    apart = True
                if tag not in ("body", "html", "article", "main") and (BOILERPLATE.search(v) or NOTICE.search(v)):
                    skip = True
                elif HINT.search(v):
                    hint = True
                elif GOOD.search(v):
                    bonus += 25
            elif k == "hidden":
                hidden = True
            elif k == "role" and v in ROLES or k == "aria-hidden" and v == "true":
                skip = True
        if tag in VOID:
            if tag in BLOCK:
                self.at.parts.append(" ")
            return
        self.skipped = self.skipped or skip
        node = Node(tag, self.at, skip or hidden, hidden, apart, bonus)
        node.hint = hint
        self.hinted = self.hinted or hint
        self.at.parts.append(node)
        self.at = node
        self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # as browsers: the slash means nothing outside of void elements

    def handle_endtag(self, tag):
        if tag == "br":
            self.at.parts.append(" ")
        elif self.open.get(tag):
            self._close((tag,), ())

    def _close(self, names, fences):
        node = self.at
        while node.parent is not None and node.tag not in names:
            if node.tag in fences:
                return
            node = node.parent
        if node.parent is None:
            return
        while True:
            done, self.at = self.at, self.at.parent
            self.open[done.tag] -= 1
            if done is node:
                break
        if node.tag in names[1:] or len(names) > 1:
            self._close(names, fences)

    def handle_data(self, data):
        if not self.at.hidden:
            self.at.parts.append(data)

    def unknown_decl(self, data):
        if data.startswith("CDATA["):
            self.handle_data(data[6:])


def _walk(root: Node, skipped: bool = False) -> list[Node]:
    """Kept nodes in page order, parents first; with the skipped ones, but for those that are hidden."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [x for x in reversed(node.parts) if isinstance(x, Node) and not (x.hidden if skipped else x.skip)]
    return out


def _measure(nodes: list[Node], skipped: bool = False) -> None:
    """Sets the characters of each node, and those of links."""
    for node in reversed(nodes):  # children first
        chars = sum(len(x.strip()) for x in node.parts if isinstance(x, str))
        links = chars if node.tag == "a" else 0
        for x in node.parts:
            if isinstance(x, Node) and not (x.hidden if skipped else x.skip):
                chars += x.chars
                links += x.chars if node.tag == "a" else x.links
        node.chars, node.links = chars, links


def _unwrap(root: Node) -> None:
    """Takes skip from elements that wrap the page's text."""
    nodes = _walk(root, skipped=True)
    _measure(nodes, skipped=True)
    prose = {n: n.chars - n.links for n in nodes}
    total = prose[root]
    if not total:
        return
    own = total - sum(prose[n] for n in nodes if n.apart and not n.parent.apart)
    alone = own * LITTLE < total  # hardly any text but comments
    found, done = False, set()
    for tag in ("main", "article"):
        held = [n for n in nodes if n.tag == tag and prose[n] and (alone or not n.apart)]
        most = max((prose[n] for n in held), default=0)
        for up in (n for n in held if 2 * prose[n] >= most):
            found = True
            seen = up.parent
            while seen is not None and seen not in done:
                done.add(seen)
                seen.skip = False
                seen = seen.parent
    if found:
        return
    for n in nodes:
        if n.skip and n.tag not in ENDS and 2 * prose[n] > total and (alone or not n.apart):
            n.skip = False
    for apart in (False, True):
        kept = _walk(root)
        outer = [x for n in kept for x in n.parts if isinstance(x, Node) and x.skip and not x.hidden]
        left = total - sum(prose[x] for x in outer)
        if left * LITTLE < total if not apart else not left:
            for x in outer:
                x.skip = x.skip and x.apart and not apart


def _text(*parts: Node | str) -> str:
    """Blocks in page order, white space inside each as one space."""
    out: list[str] = []
    todo: list = list(reversed(parts))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
        elif not x.skip:
            if x.tag in BLOCK:
                out.append(" ")
                todo.append(" ")
            todo.extend(reversed(x.parts))
    return " ".join("".join(out).split())


def _runs(node: Node) -> Iterator[list[Node | str]]:
    """The children of a node: each block by itself, and runs of text and inline elements."""
    run: list[Node | str] = []
    for x in node.parts:
        if isinstance(x, Node) and (x.tag in BLOCK or x.points is not None):
            if run:
                yield run
            yield [x]
            run = []
        else:
            run.append(x)
    if run:
        yield run


def _selected(best: Node, final: dict[Node, float]) -> list[Node | str]:
    """The best container with what belongs to it, in page order."""
    bar = max(10.0, 0.2 * final[best])
    top = ("#root", "html", "body")
    if best.tag in top:  # there is no container inside of which all belongs to it
        kept: list[Node | str] = []
        near, node = True, None
    else:
        kept, near, node = [best], True, best

    def belongs(run: list[Node | str]) -> bool:
        chars = sum(len(x.strip()) if isinstance(x, str) else 0 if x.skip else x.chars for x in run)
        links = sum(0 if isinstance(x, str) or x.skip else x.chars if x.tag == "a" else x.links for x in run)
        if not chars:
            return False
        x, density = run[0], links / chars
        if isinstance(x, Node) and final.get(x, 0.0) >= bar or near and density < LINKS:
            return True
        like = isinstance(x, Node) and (x.tag in HEADINGS or node is not None and x.tag == node.tag)
        return density < FEW_LINKS and (like or chars >= PROSE_CHARS)

    up = best if node is None else best.parent
    while up is not None:
        before: list[Node | str] = []
        after: list[Node | str] = []
        into = before
        for run in _runs(up):
            if node is not None and run[0] is node:
                into = after
            elif belongs(run):
                into += [" ", *run, " "]
        kept = [*before, " ", *kept, " ", *after]
        # as long as an <article> or <main> lies further up, or this is one, all is near
        inside = up.parent
        while inside is not None and inside.tag not in ("article", "main"):
            inside = inside.parent
        near = inside is not None
        node, up = up, up.parent
    return kept


def _points(node: Node, text: str) -> float:
    return 1 + text.count(",") + text.count("、") + text.count("，") + min(len(text) // 100, 3)


def main_text(html: str) -> str:
    if not html or not html.strip():
        return ""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    if tree.skipped:
        _unwrap(tree.root)
    nodes = _walk(tree.root)
    _measure(nodes)
    if tree.hinted:
        for node in nodes:
            node.skip = node.skip or node.hint and node.links > FEW_LINKS * node.chars
        nodes = _walk(tree.root)
        _measure(nodes)
    scored: list[Node] = []
    for node in nodes:
        inline = [x for x in node.parts if isinstance(x, Node) and not x.skip and x.tag in BLOCK]
        if node.tag in PARAGRAPHS and node.chars:
            text = _text(node) if not inline else ""
        elif not inline or any(isinstance(x, str) and len(x.strip()) > 1 for x in node.parts):
            text = " ".join(x.strip() if isinstance(x, str) else _text(x) for x in node.parts if isinstance(x, str) or not x.skip and x.tag not in BLOCK).strip() if node.tag in BLOCK and node.tag not in HEADINGS else ""
        else:
            text = ""
        if not text:
            continue
        p, share = _points(node, text), 1.0
        up, depth = (node.parent if node.tag in PARAGRAPHS or node.parent is not None and not inline else node), 0
        while up is not None and depth < 6:
            if up.points is None:
                up.points = float(up.bonus)
                scored.append(up)
            up.points += p * share
            depth += 1
            share = 0.5 if depth == 1 else 1 / (3 * depth)
            up = up.parent
    if not scored:
        return _text(tree.root)
    order = {n: i for i, n in enumerate(nodes)}
    final = {n: n.points * (1 - n.links / max(1, n.chars)) for n in scored}
    best = max(scored, key=lambda n: (final[n], -order[n]))
    return _text(*_selected(best, final))


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without html_col, with text (the main text, empty if none) and n_chars (its code points). One page at a
    time is held as a tree; nothing is shuffled."""
    names = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    rest = [pages.schema[c] for c in names]
    out = T.StructType([*rest, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "") for x in batch.column(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=out.names)

    return pages.select(*names, F.col(html_col)).mapInArrow(run, out)
