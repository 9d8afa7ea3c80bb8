"""Web pages as elements: a forgiving tree, filters for navigation, and a walk that yields blocks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.schemas import ELEMENTS, FIELDS
from folioflow.shared import arrow_schema, record_batch, slices

MODES = ("none", "explicit", "standard", "aggressive")
#: Tags without content of their own, tags that are skipped, block tags, and names that mark navigation.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("script style noscript template svg math iframe object embed".split())
BLOCKS = frozenset("div p ul ol table h1 h2 h3 h4 h5 h6 blockquote pre article section main header footer nav aside".split())
SPACED = frozenset("p div li h1 h2 h3 h4 h5 h6 tr".split())
NAVIGATION = re.compile(
    r"(^|[^a-z])(nav|navbar|navigation|menu|topnav|sidenav|breadcrumb|breadcrumbs|site-header|page-header|masthead|banner|footer|site-footer|page-footer"
    r"|colophon|sidebar|widget-area|widget|aside)([^a-z]|$)",
    re.IGNORECASE,
)
LINK_SHARE, LINKS = 0.6, 4
#: What a start tag ends if it is open: HTML's implied end tags.
ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "thead": {"tbody", "tr", "td", "th"},
    **{t: {"p"} for t in BLOCKS | {"hr", "form", "dl", "figure", "address", "fieldset"}},
}
#: Where the search for something to end stops.
WALLS = {"li": {"ul", "ol"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "thead": {"table"}, "dt": {"dl"}, "dd": {"dl"}}


@dataclass
class Node:
    tag: str
    attrs: dict = field(default_factory=dict)
    parent: Node | None = None
    kids: list = field(default_factory=list)

    def nodes(self) -> Iterator[Node]:
        return (k for k in self.kids if isinstance(k, Node))


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        ends, walls = ENDS.get(tag, set()), WALLS.get(tag, {"table", "td", "th", "button", "#root"})
        n = self.at
        while ends and n.parent is not None and n.tag not in walls:
            if n.tag in ends:
                self.at = n.parent
                if n.tag == "p" or tag == "li":
                    break
            n = n.parent
        new = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.kids.append(new)
        if tag not in VOID:
            self.at = new

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.kids.append(data)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def find(node: Node, tag: str) -> Node | None:
    stack = [node]
    while stack:
        n = stack.pop()
        if n.tag == tag:
            return n
        stack += reversed(list(n.nodes()))
    return None


def text_of(node: Node) -> str:
    """All text below: a line feed for br, a space after blocks, nothing of scripts and the like."""
    out: list[str] = []
    stack: list = [node]
    while stack:
        n = stack.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.tag not in SKIPPED:
            if n.tag == "br":
                out.append("\n")
            if n.tag in SPACED:
                stack.append(" ")
            stack += reversed(n.kids)
    return "".join(out).strip()


def _own_text(item: Node) -> str:
    blocks = {"ul", "ol", "div", "p", "table", "blockquote"}
    return "".join(k if isinstance(k, str) else "" if k.tag in blocks else text_of(k) for k in item.kids).strip()


def _letters(node: Node, links: bool) -> tuple[int, int]:
    """Bytes of trimmed text, and links; with ``links`` only text inside links."""
    size = count = 0
    stack = [(node, False)]
    while stack:
        n, inside = stack.pop()
        if isinstance(n, str):
            size += len(n.strip().encode()) if inside or not links else 0
        else:
            count += n.tag == "a"
            stack += [(k, inside or n.tag == "a") for k in n.kids]
    return size, count


def link_density(node: Node) -> float:
    total = _letters(node, False)[0]
    return _letters(node, True)[0] / total if total else 0.0


class Filter:
    """What a mode leaves out: nothing; navigation by tag and role; by class and id, too; by links, too."""

    def __init__(self, body: Node, mode: str):
        self.rank, self.body = MODES.index(mode), body
        inner = [n for n in body.nodes() if n.tag not in ("script", "style", "noscript", "template")]
        self.wrapper = inner[0] if len(inner) == 1 and inner[0].tag in ("div", "main") else None

    def drops(self, n: Node) -> bool:
        if self.rank == 0:
            return False
        outer = n.parent is self.body or (self.wrapper is not None and n.parent is self.wrapper)
        role = n.attrs.get("role", "")
        if n.tag in ("nav", "aside") or role in ("navigation", "complementary"):
            return True
        if role in ("banner", "contentinfo"):
            return outer
        if n.tag in ("header", "footer"):
            if outer:
                return True
        if self.rank >= 2 and any(NAVIGATION.search(n.attrs.get(a, "")) for a in ("class", "id")):
            return True
        return self.rank >= 3 and n.tag in ("div", "section", "ul", "ol") and _letters(n, False)[1] >= LINKS and link_density(n) > LINK_SHARE


def _table(node: Node) -> list[list[dict]]:
    rows: list[tuple[Node, bool]] = []
    for part in node.nodes():
        if part.tag == "tr":
            rows.append((part, False))
        elif part.tag in ("thead", "tbody"):
            rows += [(r, part.tag == "thead") for r in part.nodes() if r.tag == "tr"]
    span = lambda c, a: int(m[0]) if (m := re.match(r"\s*\d+", c.attrs.get(a, ""))) else 1
    cells = [
        [
            {"text": text_of(c), "row_span": span(c, "rowspan"), "col_span": span(c, "colspan"), "is_header": head or c.tag == "th"}
            for c in r.nodes()
            if c.tag in ("td", "th")
        ]
        for r, head in rows
    ]
    return [r for r in cells if r]


class Walk:
    """Blocks of a body in document order."""

    def __init__(self, body: Node, mode: str):
        self.filter, self.out = Filter(body, mode), []
        self.items: list[dict] | None = None
        self.ordered, self.level = False, 0
        self.visit(body)
        self.end_list()

    def add(self, kind: str, **values) -> None:
        self.out.append({"type": kind, **values})

    def end_list(self) -> None:
        if self.items:
            self.add("list", items=self.items, ordered=self.ordered)
        self.items = None

    def all(self, n: Node) -> None:
        for k in n.nodes():
            self.visit(k)

    def visit(self, n: Node) -> None:
        if n.tag in SKIPPED or self.filter.drops(n):
            return
        if re.fullmatch("h[1-6]", n.tag):
            if self.items:
                self.end_list()
            if t := text_of(n):
                self.add("heading", text=t, level=int(n.tag[1]))
        elif n.tag in ("p", "div"):
            if n.tag == "p" and self.items:
                self.end_list()
            t = text_of(n)
            if t and not any(k.tag in BLOCKS for k in n.nodes()):
                self.add("paragraph", text=t)
            else:
                self.all(n)
        elif n.tag in ("ul", "ol"):
            self.list(n)
        elif n.tag == "li":
            if self.items is not None:
                self.item(n)
        elif n.tag == "table":
            if self.items:
                self.end_list()
            if rows := _table(n):
                self.add("table", rows=rows)
        elif n.tag in ("pre", "code", "blockquote"):
            if t := text_of(n):
                self.add("code" if n.tag != "blockquote" else "blockquote", text=t)
        elif n.tag not in ("br", "hr"):
            self.all(n)

    def list(self, n: Node) -> None:
        outer, before = self.items is None, (self.ordered, self.level)
        if self.items and self.level == 0:
            self.end_list()
            self.items = []
        self.ordered = n.tag == "ol"
        if outer:
            self.items, self.level = [], 0
        self.all(n)
        if outer:
            self.end_list()
        self.ordered, self.level = before

    def item(self, n: Node) -> None:
        if t := _own_text(n):
            self.items.append({"text": t, "level": self.level, "bullet": ""})
        self.level += 1
        for k in n.nodes():
            if k.tag in ("ul", "ol"):
                self.visit(k)
        self.level -= 1


def head(html: str) -> dict:
    """Title, and the content of meta tags by name or property; the last one counts."""
    root = tree(html)
    top = find(root, "head")
    if top is None:
        return {"title": "", "meta": {}}
    title, meta, stack = find(top, "title"), {}, [top]
    while stack:
        n = stack.pop()
        if n.tag == "meta" and (k := n.attrs.get("name") or n.attrs.get("property")):
            meta[k] = n.attrs.get("content", "")
        stack += reversed(list(n.nodes()))
    out = {"title": text_of(title) if title else "", "meta": meta}
    release(root)
    return out


def release(root: Node) -> None:
    """Take a tree apart. Its nodes know their parents, so without this they would stay until Python looks for cycles."""
    stack = [root]
    while stack:
        n = stack.pop()
        stack += n.nodes()
        n.parent, n.kids = None, []


def as_written(html: str) -> str:
    """A page in which only the references &lt;, &gt; and &amp; stand for their characters; all others are text as they are written."""
    return re.sub("&(?!(?:lt|gt|amp);)", "&amp;", html)


def elements_of(html: str, mode: str = "standard") -> list[dict]:
    root = tree(html or "")
    out = Walk(find(root, "body") or root, mode).out
    release(root)
    return out


def _rows(key: str, column: str, mode: str, references: bool):
    schema = arrow_schema(ELEMENTS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, pages in slices(batches, key, column):
            rows = []
            for doc, html in zip(keys, pages, strict=True):
                for pos, e in enumerate(elements_of(html if references else as_written(html), mode)):
                    rows.append((doc, *(({"page": 1, "pos": pos} | e).get(f) for f in FIELDS)))
            yield record_batch(rows, schema)

    return run


def parse_html(pages: DataFrame, mode: str = "standard", key: str = "page_id", column: str = "html", references: bool = True) -> DataFrame:
    """Elements of web pages; a page is a document of one page. Without ``references``, character references are as ``as_written`` says."""
    own = pages.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(column), F.lit("")).alias(column))
    return own.mapInArrow(_rows(key, column, mode, references), ELEMENTS)


def html_head(pages: DataFrame, key: str = "page_id", column: str = "html", references: bool = True) -> DataFrame:
    """doc_id, title and meta (map) of web pages. Without ``references``, character references are as ``as_written`` says."""
    kind = "doc_id long, title string, meta map<string,string>"
    schema = arrow_schema(kind)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, found in slices(batches, key, column):
            heads = [head((h or "") if references else as_written(h or "")) for h in found]
            yield record_batch([(k, h["title"], list(h["meta"].items())) for k, h in zip(keys, heads, strict=True)], schema)

    return pages.select(F.col(key).cast("long").alias(key), column).mapInArrow(run, kind)
