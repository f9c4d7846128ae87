"""Main text of pages by wrappers inferred per host.

A wrapper is a union-free regular expression over nested tokens: tags in order,
of which some are optional or repeated, with constant texts and text slots in
between. It is inferred by aligning the token streams of some pages of a host,
one after another:

* runs of equal siblings in a stream become repeated groups;
* where two streams disagree about a tag, the tags that only one of them has
  become optional groups (a longest common subsequence tells which);
* where they disagree about a text, the text becomes a slot.

Pages of a host with the same groups share a layout, and a layout has a wrapper.
The wrapper says which group holds the article: the outermost group that names
itself one, or else the innermost group with most of the text outside menus,
forms and the like. The texts of a page inside that group are kept. A page of
which that leaves out most is judged on its own.

Inside the article, what a host's pages share decides. A line is constant if more
than half of the pages that have its group have the same line there, in at least
``least`` different pages. Constant lines of ``words`` words or more are dropped:
shorter ones, such as subheadings and list items, can recur in articles. In a
group whose name is none of article text, constant lines of any length are
dropped and others kept; the name alone decides only for groups on fewer pages.

All pages shape the wrappers: tasks align theirs, and what they found is aligned
once more by host and layout. Wrappers are joined by host and layout; their side
is broadcast only if it is small, and otherwise adaptive execution splits hot
layouts.

Pages are scanned in linear time however broken they are, and groups nested
deeper than ``DEEPEST`` are put beside each other.

A null or blank html gives an empty text. Pages without a host share one
wrapper. Repeated rows get equal results, extra columns are ignored, and an
empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Collection, Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sumtrail.llm.common import arrow_schema, map_arrow, small
from sumtrail.llm.url_filter import host
from sumtrail.session import written

#: Tags without content, tags inside a line, tags whose content is no page text.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "del", "dfn", "em", "font", "i", "img", "ins", "kbd",
    "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
RAW = ["script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "math"]
#: A tag that opens closes these open ones.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "body": {"head"},
}
#: Tags that end the search for an open tag to close.
WALLS = {"html", "body", "table", "ul", "ol", "dl", "article", "section", "div", "main", "nav", "aside", "footer", "header", "form", "blockquote"}

#: Tags and parts of class, id and role names that are not article text, and that are.
NOT_TEXT = {"head", "nav", "footer", "aside", "form", "button", "select", "header", "menu", "dialog", "fieldset", "input"}
NOT_NAMES = re.compile(
    r"(?:^|[^a-z])(?:ads?|adverts?|advertisement|advertising|banner|sponsor(?:ed)?|promo(?:tion)?s?|menu|nav|navbar|navigation|navi|"
    r"breadcrumbs?|sidebar|side|widgets?|footer|foot|masthead|header|topbar|toolbar|cookies?|consent|gdpr|notices?|alert|popup|modal|"
    r"overlay|newsletter|subscribe|subscription|signup|login|search|share|sharing|social|related|recommended|comments?|commentlist|"
    r"respond|replies|reply|disqus|reviews?|pagination|pager|tags?|meta|byline|copyright|legal|disclaimer|hidden|skip)(?:$|[^a-z])")
TEXT_NAMES = re.compile(r"(?:^|[^a-z])(?:article|content|post|entry|story|main|text|maintext|body)(?:$|[^a-z])")

#: A tag whose attributes hold no angle brackets, which is nearly every one.
_PLAIN = re.compile(r"""<(/?)([a-zA-Z][^\s/><]*)((?:[^<>"']|"[^"<>]*"|'[^'<>]*')*+)>""")
_START = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_QUOTE_OR_END = re.compile(r"""["'>]""")
_RAW_ENDS = {tag: re.compile(rf"</{tag}\s*>", re.IGNORECASE) for tag in RAW}
_NAME = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.IGNORECASE)


@dataclass(slots=True)
class Node:
    """A group: its key, the tags and texts inside; in a wrapper also how often it comes and what it held."""

    key: str
    children: list[Node] = field(default_factory=list)
    text: str | None = None  # of a text node; None in a wrapper: a slot
    optional: bool = False
    repeated: bool = False
    chars: int = 0
    linked: int = 0
    pages: int = 1

    @property
    def tag(self) -> str:
        return self.key.split(" ", 1)[0]


TEXT = "#text"


def key_of(tag: str, attributes: str) -> str:
    """Tag with its class, id and role, digits left out."""
    names = [re.sub(r"[0-9]+", "", v.strip("\"'").lower()).strip() for _, v in _NAME.findall(attributes)] if attributes else []
    return " ".join([tag, *[n for n in names if n]])


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", text, ""), ("open", tag, attributes) and ("close", tag, "") in order; comments and raw content are left out.

    Time is linear in the page, however broken it is: every search either moves
    on to what it found or is not made again.
    """
    at, size = 0, len(page)
    last = page.rfind(">")
    dead: set[int] = set()  # quotes after which no tag ends any more
    while at < size:
        if page[at] != "<":
            end = page.find("<", at)
            end = size if end < 0 else end
            yield "text", page[at:end], ""
            at = end
            continue
        m = _PLAIN.match(page, at)
        if m is None:
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                at = size if end < 0 else end + 3
                continue
            if at > last:
                # Nothing ends a tag any more.
                yield "text", page[at:], ""
                return
            if page[at + 1] in "!?":
                at = page.find(">", at) + 1
                continue
            m = _START.match(page, at)
            if m is None:
                yield "text", "<", ""
                at += 1
                continue
            end = _tag_end(page, m.end(), dead)
            slash, tag, attributes = m[1], m[2].lower(), page[m.end() : end]
            at = end + 1
        else:
            slash, tag, attributes = m[1], m[2].lower(), m[3]
            at = m.end()
        if slash:
            yield "close", tag, ""
        elif tag in _RAW_ENDS:
            found = _RAW_ENDS[tag].search(page, at)
            at = size if found is None else found.end()
        else:
            yield "open", tag, attributes


def _tag_end(page: str, at: int, dead: set[int]) -> int:
    """Place of the bracket that ends a tag, outside quotes if there is one, else the first."""
    first, tried = page.find(">", at), []
    while (m := _QUOTE_OR_END.search(page, at)) and m.start() not in dead:
        if m[0] == ">":
            return m.start()
        tried.append(m.start())
        close = page.find(m[0], m.end())
        if close < 0:
            break
        at = close + 1
    dead.update(tried)
    return first


#: Groups nested deeper are put beside each other, as browsers do.
DEEPEST = 200


def parsed(page: str) -> Node:
    """The token stream nested by its tags; tags left open close where HTML closes them."""
    root = Node("html")
    stack = [root]
    beyond: dict[str, int] = {}  # open tags that were too deep to nest
    for kind, tag, attributes in tokens(page):
        if kind == "text":
            stack[-1].children.append(Node(TEXT, text=entities.unescape(tag) if "&" in tag else tag))
            continue
        if kind == "close":
            if beyond.get(tag):
                beyond[tag] -= 1
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if stack[k].tag in WALLS and tag not in WALLS:
                    break
            continue
        closes = CLOSES.get(tag) if tag in INLINE or tag in VOID else _CLOSES_P.get(tag, _P)
        if closes:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in closes:
                    del stack[k:]
                    break
                if stack[k].tag in WALLS:
                    break
        if tag == "html":
            continue
        node = Node(key_of(tag, attributes))
        stack[-1].children.append(node)
        if tag not in VOID and not attributes.endswith("/"):
            if len(stack) < DEEPEST:
                stack.append(node)
            else:
                beyond[tag] = beyond.get(tag, 0) + 1
    return root


_P = {"p"}
_CLOSES_P = {tag: closes | _P for tag, closes in CLOSES.items()}


# -- wrappers -----------------------------------------------------------------


def folded(node: Node, in_link: bool = False) -> Node:
    """A page's node as a wrapper: runs of equal siblings become one repeated group."""
    if node.key == TEXT:
        text = " ".join(node.text.split())
        return Node(TEXT, text=text, chars=len(text), linked=len(text) if in_link else 0)
    out = Node(node.key)
    in_link = in_link or node.tag == "a"
    for child in node.children:
        if child.key == TEXT and (not child.text or child.text.isspace()):
            continue
        new = folded(child, in_link)
        if out.children and out.children[-1].key == new.key:
            last = merged(out.children[-1], new, together=True)
            last.repeated = True
            out.children[-1] = last
        else:
            out.children.append(new)
    out.chars = sum(c.chars for c in out.children)
    out.linked = sum(c.linked for c in out.children)
    return out


def merged(a: Node, b: Node, together: bool = False) -> Node:
    """The wrapper that fits both: mismatching tags become optional, mismatching texts a slot."""
    out = Node(a.key, optional=a.optional or b.optional, repeated=a.repeated or b.repeated, chars=a.chars + b.chars,
               linked=a.linked + b.linked, pages=a.pages if together else a.pages + b.pages)
    if a.key == TEXT:
        out.text = a.text if a.text == b.text else None
        return out
    for x, y in _aligned(a.children, b.children):
        if x and y:
            out.children.append(merged(x, y, together))
        else:
            lone = x or y
            lone.optional = True
            out.children.append(lone)
    return out


def _aligned(a: list[Node], b: list[Node]) -> list[tuple[Node | None, Node | None]]:
    """Pairs of a longest common subsequence by key, the rest alone, in order."""
    n, m = len(a), len(b)
    if n == m and all(x.key == y.key for x, y in zip(a, b)):
        return list(zip(a, b))
    head = 0
    while head < min(n, m) and a[head].key == b[head].key:
        head += 1
    tail = 0
    while tail < min(n, m) - head and a[n - 1 - tail].key == b[m - 1 - tail].key:
        tail += 1
    x, y = a[head : n - tail], b[head : m - tail]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i].key == y[j].key else max(best[i + 1][j], best[i][j + 1])
    pairs: list[tuple[Node | None, Node | None]] = list(zip(a[:head], b[:head]))
    i = j = 0
    while i < len(x) or j < len(y):
        if i < len(x) and j < len(y) and x[i].key == y[j].key:
            pairs.append((x[i], y[j]))
            i, j = i + 1, j + 1
        elif j == len(y) or i < len(x) and best[i + 1][j] >= best[i][j + 1]:
            pairs.append((x[i], None))
            i += 1
        else:
            pairs.append((None, y[j]))
            j += 1
    return pairs + list(zip(a[n - tail :], b[m - tail :])) if tail else pairs


def not_text(key: str) -> bool:
    tag, _, names = key.partition(" ")
    return tag in NOT_TEXT or bool(names and NOT_NAMES.search(names) and not (tag in ("article", "main", "body", "html")))


def is_menu(node: Node) -> bool:
    """Lists and blocks that are nearly all links."""
    return node.tag in ("ul", "ol", "div", "section", "table", "p") and node.chars > 0 and node.linked > 0.8 * node.chars


def wrapper(pages: list[str]) -> Node:
    """Align pages one after another."""
    out: Node | None = None
    for page in pages:
        new = folded(parsed(page))
        out = new if out is None else merged(out, new)
    return out or Node("html")


def text_chars(node: Node, slots: bool = False) -> int:
    """Characters outside of what is no article text; with ``slots`` without the texts that several pages share."""
    if node.key == TEXT:
        return 0 if slots and node.text is not None and node.pages > 2 else node.chars - node.linked
    if not_text(node.key) or is_menu(node):
        return 0
    return sum(text_chars(c, slots) for c in node.children)


def article(root: Node) -> list[str]:
    """Keys of the groups that lead to the article's group."""
    slots = text_chars(root, True) > 0  # copies of one page have none
    total = text_chars(root, slots)
    named: list[tuple[int, int, list[str]]] = []

    def walk(node: Node, way: list[str]) -> None:
        if node.key == TEXT or not_text(node.key) or is_menu(node):
            return
        tag, _, names = node.key.partition(" ")
        if tag in ("article", "main") or names and TEXT_NAMES.search(names):
            named.append((text_chars(node, slots), len(way), way))
        for c in node.children:
            walk(c, [*way, c.key])

    walk(root, [])
    # The outermost of those that hold about as much as the best; what is no article is left out inside it.
    good = [n for n in named if n[0] >= 0.3 * total and n[0] > 0]
    if good:
        most = max(n[0] for n in good)
        return min((n for n in good if n[0] >= 0.9 * most), key=lambda n: n[1])[2]
    way, node = [], root
    while True:
        inside = [c for c in node.children if c.key != TEXT and c.tag not in INLINE and c.tag not in ("p", "h1", "h2", "h3", "ul", "ol", "li", "table")]
        best = max(inside, key=lambda c: text_chars(c, slots), default=None)
        if best is None or text_chars(best, slots) < 0.75 * max(1, total):
            return way
        way.append(best.key)
        node = best


def stored(root: Node) -> str:
    """What extraction needs of a wrapper: the way to the article, and groups to leave out inside it."""
    menus: list[str] = []

    def walk(node: Node, way: str) -> None:
        for c in node.children:
            if c.key != TEXT:
                here = f"{way}/{c.key}"
                if is_menu(c) and not c.repeated and c.tag != "p" and c.pages > 1:
                    menus.append(here)
                walk(c, here)

    walk(root, "")
    return json.dumps({"way": article(root), "menus": sorted(set(menus)), "pattern": pattern(root)}, ensure_ascii=False)


def pattern(node: Node, limit: int = 6) -> str:
    """The wrapper as a union-free regular expression, for reading; nested deeper than ``limit`` it is cut to dots."""
    if node.key == TEXT:
        body = "#" if node.text is None else "#c"
    else:
        inner = "".join(pattern(c, limit - 1) for c in node.children) if limit else "..."
        body = f"<{node.key}>{inner}"
    mark = ("*" if node.optional else "+") if node.repeated else "?" if node.optional else ""
    return f"({body}){mark}" if mark else body


# -- extraction ---------------------------------------------------------------


def chosen(root: Node, way: list[str]) -> list[str]:
    """The layout's way, or the page's own if that one leads past most of the page's text."""
    page = folded(root)

    def held(by: list[str]) -> int:
        return sum(text_chars(node) for node, _ in _reach(page, by))

    found = held(way)
    if found > 0 and found >= 0.5 * text_chars(page):
        return way
    own = article(page)
    return own if held(own) > found or not _reach(page, way) else way


def extracted(page: str | None, spec: dict) -> str:
    """Texts of the page inside the article's group, blocks joined by a blank line."""
    if not page or not page.strip():
        return ""
    root = parsed(page)
    way = chosen(root, spec["way"])
    known, constant = spec.get("known", ()), spec.get("constant", ())
    found = []
    for place, at in _reach(root, way):
        inside = any(k.split(" ")[0] in ("article", "main") for k in way)
        found += [text for _, text in lines(place, at, inside, set(spec["menus"]), known, constant)]
    return "\n\n".join(found)


def hashed(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def line_key(way: str, text: str) -> int:
    return hashed(f"{way}\n{text}")


def lines(place: Node, at: str, inside: bool = False, menus: Collection[str] = (), known: Collection[int] | None = (),
          constant: Collection[int] = (), words: int = 4) -> list[tuple[str, str]]:
    """(way, text) of the blocks of a group; None for ``known`` enters groups whatever their names."""
    found: list[tuple[str, str]] = []
    line: list[str] = []

    def flush(way: str, named: bool) -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text and not (constant and (named or text.count(" ") >= words - 1) and line_key(way, text) in constant):
            found.append((way, text))

    def walk(node: Node, way: str, inside: bool, named: bool) -> None:
        # The way of a line is that of the block around it.
        for c in node.children:
            if c.key == TEXT:
                line.append(c.text)
                continue
            here = f"{way}/{c.key}"
            block = c.tag not in INLINE
            if block:
                flush(blocks[-1], named)
                blocks.append(here)
            elif c.tag == "br":
                line.append(" ")
            out = not_text(c.key)
            titles = inside and c.tag == "header" and _has_title(c)
            judged = out and c.tag not in NOT_TEXT and (known is None or bool(known) and hashed(here) in known)
            if (titles or not out or judged) and here not in menus:
                walk(c, here, inside or c.tag in ("article", "main"), named or judged)
            if block:
                flush(here, named or judged)
                blocks.pop()

    blocks = [at]
    walk(place, at, inside, False)
    flush(at, False)
    return found


def named_ways(root: Node) -> set[str]:
    """Ways to the groups whose names are those of no article text."""
    out: set[str] = set()
    stack = [(root, "")]
    while stack:
        node, way = stack.pop()
        for c in node.children:
            if c.key != TEXT and c.tag not in NOT_TEXT:
                here = f"{way}/{c.key}"
                if not_text(c.key):
                    out.add(here)
                stack.append((c, here))
    return out


def _has_title(node: Node) -> bool:
    """A header inside the article that holds a title is part of it."""
    stack = [node]
    while stack:
        inner = stack.pop()
        if inner.tag in ("h1", "h2", "h3"):
            return True
        stack += inner.children
    return False


def _reach(root: Node, way: list[str]) -> list[tuple[Node, str]]:
    """All groups of a page that the way leads to."""
    now = [(root, "")]
    for key in way:
        now = [(c, f"{w}/{key}") for node, w in now for c in node.children if c.key == key]
    return now


@dataclass(frozen=True)
class Settings:
    """Layouts whose wrappers may be broadcast, wrappers that a task holds before it passes them on, pages that show a constant."""

    broadcast_layouts: int = 30_000
    held: int = 1_000
    least: int = 3


SETTINGS = Settings()

#: Tags that differ between pages of one layout.
FLOW = INLINE | {"p", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "li", "dl", "dt", "dd", "table", "thead", "tbody", "tr", "td", "th",
                 "blockquote", "pre", "hr", "figure", "figcaption"}


def layout(page: Node) -> int:
    """Hash of the ways to a page's groups, however often each comes, but for those of running text."""
    ways: set[str] = set()
    stack = [(page, "")]
    while stack:
        node, way = stack.pop()
        for c in node.children:
            if c.key != TEXT and c.tag not in FLOW:
                ways.add(here := f"{way}/{c.key}")
                stack.append((c, here))
    return hashed("\n".join(sorted(ways)))


def with_hashes(root: Node) -> Node:
    """The tree itself, with hashes in place of its texts."""
    stack = [root]
    while stack:
        n = stack.pop()
        if n.text:
            n.text = blake2b(n.text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()
        stack += n.children
    return root


def packed(root: Node) -> str:
    """A wrapper as a list of its nodes with their depths; texts are hashes."""
    out, stack = [], [(0, root)]
    while stack:
        depth, n = stack.pop()
        out.append([depth, n.key, n.text, n.optional, n.repeated, n.chars, n.linked, n.pages])
        stack += [(depth + 1, c) for c in reversed(n.children)]
    return json.dumps(out)


def unpacked(text: str) -> Node:
    way: list[Node] = []
    for depth, key, words, optional, repeated, chars, linked, pages in json.loads(text):
        node = Node(key, [], words, optional, repeated, chars, linked, pages)
        del way[depth:]
        if way:
            way[-1].children.append(node)
        way.append(node)
    return way[0]


def wrappers(pages: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """(host, layout, wrapper, known, constant) of every layout of a host; wrapper is JSON.

    ``known`` are the named groups that enough of the host's pages have, and
    ``constant`` the lines that its pages share, both as hashes. A template has
    a bounded number of either.
    """
    schema = "host string, layout long, part string, way long, line long, page long"

    target = pa.schema([("host", pa.string()), ("layout", pa.int64()), ("part", pa.string()), *((c, pa.int64()) for c in ("way", "line", "page"))])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], Node] = {}
        seen: list[tuple[str, int, int | None, int]] = []

        def passed() -> pa.RecordBatch:
            rows = [(name, key, packed(n), None, None, None) for (name, key), n in held.items()]
            rows += [(name, None, None, way, text, page) for name, way, text, page in seen]
            held.clear()
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(target)], schema=target)

        for batch in batches:
            for name, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                if not page or not page.strip():
                    continue
                root, copy = parsed(page), hashed(page)
                seen += {(name, hashed(w), line_key(w, text), copy) for w, text in lines(root, "", known=None)}
                seen += {(name, hashed(w), None, copy) for w in named_ways(root)}
                new = with_hashes(folded(root))
                key = (name, layout(root))
                held[key] = merged(held[key], new) if key in held else new
                if len(held) >= settings.held or len(seen) >= 100 * settings.held:
                    yield passed()
        yield passed()

    def infer(group: pd.DataFrame) -> pd.DataFrame:
        root = None
        for part in sorted(group["part"]):
            root = unpacked(part) if root is None else merged(root, unpacked(part))
        return pd.DataFrame({"host": [group["host"].iloc[0]], "layout": [group["layout"].iloc[0]], "wrapper": [stored(root)]})

    parts = map_arrow(pages.select(host(F.col("url")).alias("host"), "html"), fold, schema)
    parts = written(parts)
    inferred = parts.where("part is not null").select("host", "layout", "part").groupBy("host", "layout").applyInPandas(
        infer, "host string, layout long, wrapper string")
    # Copies of a page count once.
    seen = written(parts.where("part is null").select("host", "way", "line", "page").distinct())
    ways = seen.select("host", "way", "page").distinct().groupBy("host", "way").agg(F.count("*").alias("pages"))
    ways = written(ways.where(F.col("pages") >= settings.least))
    shared = seen.where("line is not null").groupBy("host", "way", "line").agg(F.count("*").alias("n")).where(F.col("n") >= settings.least)
    constant = shared.join(ways, ["host", "way"]).where("2 * n > pages").groupBy("host").agg(F.collect_set("line").alias("constant"))
    named = seen.where("line is null").select("host", "way").distinct().join(ways, ["host", "way"])
    known = named.groupBy("host").agg(F.collect_set("way").alias("known"))
    return written(inferred.join(known, "host", "left").join(constant, "host", "left"))


def texts(pages: DataFrame, settings: Settings = SETTINGS) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    known = small(wrappers(pages, settings).select(F.col("host").alias("h"), F.col("layout").alias("l"), "wrapper", "known", "constant"), settings.broadcast_layouts)
    keyed = T.StructType([*(pages.schema[c] for c in ("page_id", "url", "html")), T.StructField("layout", T.LongType())])
    keyed_target = arrow_schema(keyed)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [layout(parsed(page)) if page and page.strip() else None for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "html")), pa.array(keys, pa.int64())], schema=keyed_target)

    joined = map_arrow(pages.select("page_id", "url", "html"), key, keyed).withColumn("host", host(F.col("url"))).join(
        known, (F.col("host") == F.col("h")) & (F.col("layout") == F.col("l")), "left")
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    target = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        specs: dict[tuple, dict] = {}
        for batch in batches:
            found = []
            columns = (batch.column(c).to_pylist() for c in ("html", "h", "l", "wrapper", "known", "constant"))
            for page, name, key, spec, known, constant in zip(*columns):
                if (name, key) not in specs:
                    if len(specs) > 1_000:
                        specs.clear()
                    base = json.loads(spec) if spec else {"way": [], "menus": []}
                    specs[name, key] = base | {"known": set(known or ()), "constant": set(constant or ())}
                found.append(extracted(page, specs[name, key]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())],
                schema=target)

    return joined.select("page_id", "url", "html", "h", "l", "wrapper", "known", "constant").transform(map_arrow, run, schema)
