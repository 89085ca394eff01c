"""HTML bodies as one struct per page: title, headings, tables, links, main text. One light tree per page, built once."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.session import ship_package, spread

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# Elements and class names of a page's surroundings and of its navigation.
CHROME_TAGS = {"nav", "header", "footer", "aside", "script", "style", "noscript", "form"}
CHROME_CLASS = re.compile(r"(^|[\s_-])(nav|navbar|menu|megamenu|header|footer|breadcrumbs?|cookie|consent|banner|sidebar|subnav|topbar|skip-link|social|share)([\s_-]|$)", re.I)
NAV_CLASS = re.compile(r"(^|[\s_-])(nav|navbar|navigation|menu|megamenu|mega-menu)", re.I)
CLOSES = {"li": {"li"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "p": {"p"}, "option": {"option"}}
PAGE = (
    "struct<title string, h1 string, description string, image string, headings array<string>, has_product boolean, pdf_links int, text_length int, main_text string, "
    "tables array<struct<heading string, grid array<array<string>>>>, links array<struct<href string, text string, trail array<string>, region string>>>"
)


class Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        """This node's elements in document order, itself left out; no recursion, so depth is no limit."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def text(self, skip: frozenset = frozenset(("script", "style", "template"))) -> str:
        out, todo = [], [self]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                out.append(node)
            elif node.tag not in skip:
                todo.extend(reversed(node.children))
        return " ".join(" ".join(out).split())

    def up(self):
        node = self.parent
        while node is not None:
            yield node
            node = node.parent


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#", {}, None)

    def handle_starttag(self, tag, attrs):
        gone = CLOSES.get(tag)
        if gone:
            node = self.at
            while node is not None and node.tag not in ("table", "ul", "ol", "dl", "body", "div", "section", "article", "main", "#"):
                if node.tag in gone:
                    self.at = node.parent
                    if tag != "tr":
                        break
                node = node.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        if data.strip():
            self.at.children.append(data)


def tree(source: str) -> Node:
    builder = _Builder()
    builder.feed(source)
    builder.close()
    return builder.root


def _grid(table: Node) -> list[list[str]]:
    """Rows of cells in document order, padded to one width; rows of nested tables belong to those."""
    rows = []
    for node in table.walk():
        if node.tag == "tr" and next((u for u in node.up() if u.tag == "table"), None) is table:
            cells = [c.text() for c in node.children if isinstance(c, Node) and c.tag in ("td", "th")]
            if cells:
                rows.append(cells)
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def _definitions(node: Node) -> list[list[str]]:
    """The terms of a definition list with the description that follows each, under a blank header row; blank ones are left
    out, and fewer than two pairs are no grid."""
    items = [n for n in node.walk() if n.tag in ("dt", "dd")]
    pairs = [[a.text(), b.text()] for a, b in zip(items, items[1:]) if (a.tag, b.tag) == ("dt", "dd")]
    filled = [p for p in pairs if all(p)]
    return [["", ""], *filled] if len(filled) > 1 else []


def _is_nav(node: Node) -> bool:
    return node.tag in ("nav", "header", "footer") or node.attrs.get("role", "").lower() == "navigation" or bool(NAV_CLASS.search(f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}"))


def _is_chrome(node: Node) -> bool:
    return node.tag in CHROME_TAGS or bool(CHROME_CLASS.search(f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}"))


def _item_label(item: Node) -> str:
    """What a menu item is called, without its submenu."""
    for child in item.children:
        if isinstance(child, str):
            if child.strip():
                return " ".join(child.split())
        elif child.tag not in ("ul", "ol") and (text := child.text()):
            return text if len(text) <= 60 else ""
    return ""


def _links(root: Node, base: str) -> list[tuple]:
    """(absolute address, text, labels of the enclosing menu items, region) of every link; region: nav, footer or body."""
    out = []
    for a in root.walk():
        href = a.attrs.get("href", "").strip()
        if a.tag != "a" or not href or href.startswith(("#", "mailto:", "tel:", "javascript:")):
            continue
        above = list(a.up())
        inside = [n for n in above if _is_nav(n)]
        region = "body" if not inside else "footer" if any(n.tag == "footer" for n in above) else "nav"
        text = a.text() or a.attrs.get("title", "").strip() or a.attrs.get("aria-label", "").strip()
        labels = []
        if inside:
            for item in [n for n in above[: above.index(inside[-1])] if n.tag == "li"][1:]:
                label = _item_label(item)
                if label and label != text and (not labels or labels[-1] != label):
                    labels.append(label)
        try:
            out.append((urljoin(base or "", href), text, labels[::-1][-3:], region))
        except ValueError:
            continue
    return out


def _main_text(root: Node) -> str:
    """The text of main, article or the body without surroundings; an element with over 40 % of the text is no
    surroundings, and if under 30 % is left, nothing is taken out."""
    top = next((n for tag in ("main", "article", "body") for n in root.walk() if n.tag == tag), root)
    whole = top.text()
    if not whole:
        return ""
    out, todo = [], [top]
    while todo:
        node = todo.pop()
        if isinstance(node, str):
            out.append(node)
        elif node.tag in ("script", "style", "template"):
            continue
        elif node is not top and _is_chrome(node) and (node.tag in ("script", "style", "noscript") or len(node.text()) <= 0.4 * len(whole)):
            continue
        else:
            todo.extend(reversed(node.children))
    kept = " ".join(" ".join(out).split())
    return kept if len(kept) >= 0.3 * len(whole) else whole


def _is_product(root: Node) -> bool:
    for node in root.walk():
        if node.tag == "script" and node.attrs.get("type", "").lower() == "application/ld+json":
            try:
                data = json.loads("".join(c for c in node.children if isinstance(c, str)))
            except ValueError:
                continue
            if any(isinstance(x, dict) and "product" in str(x.get("@type", "")).lower() for x in (data if isinstance(data, list) else [data])):
                return True
    return False


def parse_page(source: str, url: str = "") -> tuple:
    """The fields of PAGE. Unclosed and stray tags are taken as they come."""
    root = tree(source)
    nodes = list(root.walk())
    first = lambda tag: next((n for n in nodes if n.tag == tag), None)
    text_of = lambda n: n.text() if n is not None else ""
    meta = {(n.attrs.get("name") or n.attrs.get("property") or "").lower(): n.attrs.get("content", "").strip() for n in reversed(nodes) if n.tag == "meta"}
    headings = [t for level in ("h1", "h2", "h3") for n in nodes if n.tag == level and (t := n.text())]
    tables, heading = [], ""
    for n in nodes:
        if n.tag in ("h1", "h2", "h3", "h4"):
            heading = n.text()
        elif n.tag in ("table", "dl"):
            grid = _grid(n) if n.tag == "table" else _definitions(n)
            if grid:
                tables.append((heading, grid))
    body = first("body")
    links = _links(root, url)
    pdfs = sum(bool(re.search(r"\.pdf(\?|$)", n.attrs.get("href", ""), re.I)) for n in nodes if n.tag == "a")
    return (text_of(first("title")), text_of(first("h1")), meta.get("description") or meta.get("og:description", ""), meta.get("og:image", ""), headings, _is_product(root), pdfs, len(text_of(body)), _main_text(root), tables, links)


FIELDS = ["title", "h1", "description", "image", "headings", "has_product", "pdf_links", "text_length", "main_text", "tables", "links"]


def with_page(df: DataFrame, source: str, url: str | None = None) -> DataFrame:
    """Adds parsed (PAGE); null bodies have a null. Drop the body's column afterwards: nothing else needs it."""
    ship_package(df.sparkSession)

    def parse(bodies: pd.Series, addresses: pd.Series) -> pd.DataFrame:
        out = []
        for b, u in zip(bodies, addresses):
            got = parse_page(b, u or "") if b is not None else (None,) * len(FIELDS)
            if b is not None:
                tables = [{"heading": h, "grid": g} for h, g in got[9]]
                links = [dict(zip(("href", "text", "trail", "region"), x)) for x in got[10]]
                got = (*got[:9], tables, links)
            out.append(got)
        return pd.DataFrame(out, columns=FIELDS, index=bodies.index)

    return spread(df).withColumn("parsed", F.pandas_udf(parse, PAGE)(source, url if url else F.lit("")))
