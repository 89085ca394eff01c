"""Pages as lines: which block and element each line of a stored body belongs to, and what it looks like.

One pass over the markup. Elements are hashed as subtrees: the hash of a block is that of its normalised text, the hash
of an outer element that of its children's hashes, so that the same menu has the same hash on every page.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import lru_cache

import xxhash

_TOKEN = re.compile(r"<!--.*?-->|<(script|style|template|svg)\b[^>]*>.*?</\1\s*>|<!?/?[A-Za-z][^<>]*>", re.S | re.I)
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)([^<>]*)>", re.S)
_ATTR = re.compile(r"""(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
# Elements that begin a new block of text, and elements without an end tag.
BLOCKS = set("address article aside blockquote body br caption center dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section table tbody td th thead tr ul title option select small".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CELLS = {"td", "th", "dt", "dd"}
FLAGS = {**{f"h{n}": 1 for n in range(1, 7)}, "li": 2, "b": 4, "strong": 4, **{t: 8 for t in CELLS}}
CHROME_TAGS = {"nav", "header", "footer", "aside", "noscript", "dialog", "form", "button", "select", "iframe"}
MAIN_TAGS = {"main", "article"}
CHROME_NAME = re.compile(r"(?:^|[\s_-])(?:nav\w*|menu\w*|mega|breadcrumbs?|crumbs?|cookie\w*|consent\w*|cb|dialog|overlay|banner|footer|header|sidebar|side|aside|teasers?|related|social|share|newsletter|promo|toolbar|topbar|nv)(?:$|[\s_-])", re.I)
CRUMB = re.compile(r"^(?:[^.!?:;<>]{1,40}?(?:\s*[>»›]\s*|\s[/→]\s))+[^.!?:;]{0,60}$")
_LINKS = re.compile(r"^[^.!?:;]{1,30}(?:\s(?:[|·•/-])\s[^.!?:;]{1,30}){2,}$")
_SENTENCE = re.compile(r"[.!?…。:;]['\"”’»)]?\s*$")
_GAP = re.compile(r"(?<=\S)(?: {2,}|\t)(?=\S)")
_DIGITS = re.compile(r"\d+")
_BULLET = re.compile(r"^\s*[•*·‣▪–-]\s+")


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


@dataclass(slots=True)
class Line:
    no: int
    text: str = ""
    zone: str = ""  # x: not shown, c: surroundings, m: main, "": unknown
    block: int = 0
    heading: bool = False
    cell: bool = False
    item: bool = False
    linked: int = 0
    pieces: int = 0  # texts of inline elements and list items
    gaps: int = 0  # wide gaps inside a plain line
    hash: int = 0
    shape: str = ""  # s: sentence, v: label and value, b: way to the page, l: row of links, n: name or other short text


@dataclass
class Page:
    lines: list[Line]
    title: str = ""
    markup: bool = True
    trees: list[tuple[int, int, int]] = field(default_factory=list)  # (hash, first line, last line) of elements of two or more lines


def normal(text: str) -> str:
    """Lower case, white space collapsed, numbers alike."""
    return _DIGITS.sub("#", " ".join(text.lower().split()))


@lru_cache(maxsize=131072)
def hash_of(text: str) -> int:
    """The hash of a block: that of its text without a bullet, in lower case, numbers alike. Menu lines recur, so it is kept."""
    return digest(normal(_BULLET.sub("", text)))


@lru_cache(maxsize=131072)
def shape_of(text: str, cell: bool) -> str:
    words = text.split()
    if cell:
        return "v"
    if CRUMB.match(text) and len(words) <= 14:
        return "b"
    if _LINKS.match(text):
        return "l"
    if re.match(r"^[^.!?:]{2,48}: \S", text) and len(words) <= 16 and not _SENTENCE.search(text[-1:]):
        return "v"
    if len(text) > 70 or len(words) >= 5 and _SENTENCE.search(text):
        return "s"
    return "n"


def read_page(source: str) -> Page:
    """The lines of a body, counted from 1 at each newline sign."""
    count = source.count("\n") + 1
    lines = [Line(i + 1) for i in range(count)]
    page = Page(lines, markup="<" in source and bool(re.search(r"</?[a-z][^<>]*>", source, re.I)))
    if not page.markup:
        for block, (line, text) in enumerate(zip(lines, source.split("\n"))):
            line.text = " ".join(text.split())
            line.block = block
            line.gaps = len(_GAP.findall(text))
            line.item = bool(_BULLET.match(text))
        _finish(page)
        return page
    stack: list[tuple] = []  # (tag, zone, first line, what it and its ancestors are: 1 heading, 2 list item, 4 bold)
    at, no, block, zone = 0, 1, 0, ""
    parts: dict[int, list[str]] = {}
    linked = bold = 0
    spans = [*_TOKEN.finditer(source), None]
    for span in spans:
        text = source[at : span.start() if span else len(source)]
        if text:
            for k, piece in enumerate(text.split("\n")):
                if k:
                    no += 1
                if piece.strip():
                    line = lines[no - 1]
                    if zone == "x":
                        line.zone = line.zone or "x"
                    else:
                        if no not in parts:
                            line.block, line.zone = block, zone
                        elif line.zone == "x":
                            line.zone = zone
                        parts.setdefault(no, []).append(piece)
                        if linked:
                            line.linked += len(piece.strip())
                        line.pieces += bool(stack) and stack[-1][0] in ("a", "li", "span") and len(piece.split()) <= 4
                        is_ = stack[-1][3] if stack else 0
                        line.heading |= bool(is_ & 1) or bool(is_ & 4 and bold)
                        line.item |= bool(is_ & 2)
                        line.cell |= bool(is_ & 8) and any(s[2] == no and s[0] in CELLS for s in stack)
        if span is None:
            break
        token = span[0]
        at = span.end()
        breaks = token.count("\n")
        if token.startswith("<!") or span[1]:
            no += breaks
            continue
        m = _TAG.match(token)
        no += breaks
        if not m:
            continue
        closing, tag, rest = m[1], m[2].lower(), m[3]
        if tag in BLOCKS:
            block += 1
            if no in parts and parts[no] and parts[no][-1] != "\t":
                parts[no].append("\t")
        if tag == "a":
            linked = 0 if closing else 1
        if tag in ("b", "strong"):
            bold = 0 if closing else 1
        if closing:
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    for gone in reversed(stack[depth:]):
                        _close(page, gone, no, stack)
                    del stack[depth:]
                    break
            zone = stack[-1][1] if stack else ""
        elif tag not in VOID and not rest.rstrip().endswith("/"):
            names = " ".join(x[1].strip("\"'") for x in _ATTR.findall(rest)) if "=" in rest else ""
            if tag in ("head", "title"):
                zone = "x"
            elif zone not in ("x", "c"):
                around = tag in CHROME_TAGS and not (tag == "header" and zone == "m") or (names and CHROME_NAME.search(names))
                zone = "c" if around else "m" if tag in MAIN_TAGS else zone
            if tag == "p" and stack and stack[-1][0] == "p" or tag == "li" and stack and stack[-1][0] == "li":
                _close(page, stack.pop(), no, stack)
            flags = (stack[-1][3] if stack else 0) | FLAGS.get(tag, 0)
            stack.append((tag, zone, no, flags))
    for no, pieces in parts.items():
        text = "".join(pieces)
        lines[no - 1].text = " ".join((html.unescape(text) if "&" in text else text).split())
    title = re.search(r"<title[^>]*>(.*?)</title>", source, re.S | re.I)
    page.title = " ".join(html.unescape(title[1]).split()) if title else ""
    _finish(page)
    return page


def _close(page: Page, element: tuple, last: int, stack: list) -> None:
    if last > element[2] and element[0] not in ("html", "body"):
        page.trees.append((0, element[2], last))


def _finish(page: Page) -> None:
    """Shapes, block hashes (lines of one block share the hash of its whole text) and subtree hashes."""
    groups: dict[int, list[Line]] = {}
    for line in page.lines:
        if line.text and line.zone != "x":
            groups.setdefault(line.block, []).append(line)
    for group in groups.values():
        whole = " ".join(x.text for x in group)
        number = hash_of(whole)
        linked = sum(x.linked for x in group) * 2 > len(whole)
        shape = shape_of(_BULLET.sub("", whole), group[0].cell)
        if sum(x.pieces for x in group) >= 3 and shape in "sn" and len(whole) < 40 * sum(x.pieces for x in group):
            shape = "l"
        if group[0].gaps >= 2 and len(whole.split()) <= 14:
            shape = "l"
        for line in group:
            line.hash, line.shape = number, "l" if linked and shape in "nb" else shape
    prefix = {}
    running = []
    for line in page.lines:
        prefix[line.no] = len(running)
        if line.hash:
            running.append(line.hash)
    prefix[len(page.lines) + 1] = len(running)
    trees = []
    for _, first, last in page.trees:
        own = running[prefix[first] : prefix[min(last + 1, len(page.lines) + 1)]]
        if len(own) >= 2:
            trees.append((digest(",".join(map(str, own))), first, last))
    page.trees = list(dict.fromkeys(trees))
