"""Main text of HTML pages by wrapper induction.

The distinct layouts (trees without texts) of *all* pages of a host are merged, by simple tree matching, into
partial templates, dealt by hash so that a hot host is spread over ``salts`` tasks, and those into the host's
template tree: every layout has its nodes in it, whatever the partitioning. Then all pages of the host are
aligned with that template and the texts found at its nodes are counted, once for each distinct html of the host,
pre-aggregated in each task. A node whose most frequent text is on at least ``constant`` of the distinct pages
that have the node, and on two at least, is template; nodes that vary are slots, and slots hold content. Elements that
say what they are (menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts)
are left out on every page.

Where a page marks its article (``article``, else ``main``), only the article is content. Its nodes are aligned and
counted too, each distinct text of articles once, but the mark is a hint: a node in there is template only if its
text is on ``constant`` of the distinct pages that have the *article*, since few pages have the last nodes of a long
one. Where such nodes hold more than half of the characters of a host's distinct articles, the articles are near
copies of each other, and nothing in them is template.

Defined results: null or empty html gives an empty text. A page cut short gives what is there: an
unfinished tag or comment is no text. The blocks of elements nested deeper than ``_DEPTH`` are blocks of the element at that depth.
Pages with a null or odd url share one host. Rows that repeat a page_id are separate pages.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import materialize, ship

# Tags as HTML's tokenizer takes them: a quote opens a value only after "=", and ">" outside of such a value ends the
# tag. What is possessive isn't tried again, so that a tag without an end reaches the end of the page (no fourth group).
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(/?)([a-zA-Z][^ \t\n\f\r/>]*+)"
    r"((?:[ \t\n\f\r/]++|[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:\"[^\"]*+\"?+|'[^']*+'?+|[^ \t\n\f\r>\"'][^ \t\n\f\r>]*+)?+)?+)*+)(>?)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^ \t\n\f\r/>][^ \t\n\f\r/>=]*+)(?:[ \t\n\f\r]*+=[ \t\n\f\r]*+(?:\"([^\"]*)\"|'([^']*)'|([^ \t\n\f\r>\"'][^ \t\n\f\r>]*))?)?+")
_RAW = frozenset("script style textarea title noscript xmp iframe noembed noframes template".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var audio canvas map object picture video math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
_BLOCK_START_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul dd dt".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody")}
_WALLS = frozenset("html body article section div main nav aside footer header table ul ol dl td th blockquote form figure button".split())
_BOILER_TAGS = frozenset("nav footer aside form button select option dialog menu search svg head".split())
_BOILER_NAMES = re.compile(r"(?:^|[-_\s])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed|s)?|promos?|banner|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|side-?bar|menus?|nav|navbar|navigation|breadcrumbs?|footer|masthead|site-?header|page-?header|topbar|toolbar|comments?|respond|replies|disqus|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|pagination|pager|skip-?link|widget)(?:$|[-_\s])", re.I)
#: Inside a marked article only names of what the page's frame is made of; a share price or a search result may be content.
_FRAME_NAMES = re.compile(r"(?:^|[-_\s])(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed|s)?|promos?|cookies?|consent|gdpr|notices?|side-?bar|menus?|nav|navbar|navigation|breadcrumbs?|footer|masthead|site-?header|page-?header|comments?|respond|replies|disqus)(?:$|[-_\s])", re.I)
_BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
_DEPTH = 120


class Node:
    __slots__ = ("tag", "name", "boiler", "content")

    def __init__(self, tag: str, name: str = "", boiler: bool = False):
        self.tag, self.name, self.boiler, self.content = tag, name, boiler, []

    @property
    def children(self) -> list[Node]:
        return [c for c in self.content if not isinstance(c, str)]


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(text)}


def _is_boiler(tag: str, attributes: dict[str, str], inside: bool = False) -> bool:
    if tag in _BOILER_TAGS or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return True
    if attributes.get("role", "").lower() in _BOILER_ROLES or re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I):
        return True
    return tag not in ("body", "html", "main") and bool((_FRAME_NAMES if inside else _BOILER_NAMES).search(f"{attributes.get('class', '')} {attributes.get('id', '')}"))


def parse(html: str) -> Node:
    """The tree of block elements and marked inline elements; plain inline elements leave no node.

    Below ``_DEPTH`` an element is open as any other, but its content goes to the last node above, set off by
    rules; what is left out keeps a node of its own there.
    """
    root = Node("#root")
    stack, at, n = [root], 0, len(html)
    opened: Counter[str] = Counter()
    find = _TOKEN.search

    def close(upto: int) -> None:
        deep = len(stack) > _DEPTH
        opened.subtract(x.tag for x in stack[upto:])
        del stack[upto:]
        if deep:
            stack[-1].content.append(Node("hr"))

    def open_place(tags: tuple[str, ...] | frozenset, walls: frozenset) -> int:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                return k
            if stack[k].tag in walls:
                return 0
        return 0

    while at < n:
        m = find(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text:
            stack[-1].content.append(text)
        if not m or m[2] and not m[4]:
            break
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if not opened[tag]:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    close(k)
                    break
            continue
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = end.end() if end else n
            stack[-1].content.append(" ")
            continue
        if tag in _VOID:
            stack[-1].content.append(Node("hr") if tag == "hr" else " " if tag == "br" else "")
            continue
        attributes = _attributes(m[3]) if m[3] else {}
        boiler = _is_boiler(tag, attributes, bool(opened["article"] or opened["main"]))
        if tag in _INLINE and not boiler:
            continue
        if tag in _BLOCK_START_CLOSES_P and (k := open_place(("p",), _WALLS)):
            close(k)
        if tag in _CLOSES and (k := open_place(_CLOSES[tag], frozenset(("ul", "ol", "dl", "table", "select")))):
            close(k)
        node = Node(tag, attributes.get("class", ""), boiler)
        if len(stack) >= _DEPTH and (not boiler or len(stack) > _DEPTH and stack[-1].boiler):
            stack[-1].content.append(Node("hr"))
            node.content, node.boiler = stack[-1].content, len(stack) > _DEPTH and stack[-1].boiler
        else:
            stack[-1].content.append(node)
        if m[3].endswith("/") and tag in ("svg", "path"):
            continue
        stack.append(node)
        opened[tag] += 1
    return root


# --- simple tree matching ---


def _key(a) -> tuple[str, str]:
    return a.tag, a.name


def match(a, b) -> tuple[int, list]:
    """The size of the greatest top-down, order-preserving match of two trees and its pairs of nodes."""
    if _key(a) != _key(b):
        return 0, []
    x, y = a.children, b.children
    if x and y:  # what has no counterpart of its kind can't be matched
        kinds, others = {_key(c) for c in x}, {_key(c) for c in y}
        if kinds != others:
            x, y = [c for c in x if _key(c) in others], [c for c in y if _key(c) in kinds]
    if not x or not y:
        return 1, [(a, b)]
    if len(x) == len(y) and all(_key(p) == _key(q) and not p.children and not q.children for p, q in zip(x, y)):
        return 1 + len(x), [(a, b), *zip(x, y)]
    # Leaves of one kind at both ends match each other; the middle is left to the table.
    lead = 0
    while lead < min(len(x), len(y)) and _key(x[lead]) == _key(y[lead]) and not x[lead].children and not y[lead].children:
        lead += 1
    pairs, size = [(a, b), *zip(x[:lead], y[:lead])], 1 + lead
    x, y = x[lead:], y[lead:]
    tail = 0
    while tail < min(len(x), len(y)) and _key(x[-1 - tail]) == _key(y[-1 - tail]) and not x[-1 - tail].children and not y[-1 - tail].children:
        tail += 1
    pairs += zip(x[len(x) - tail :], y[len(y) - tail :])
    size += tail
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    if x and y:
        weight = [[match(p, q) for q in y] for p in x]
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(1, len(x) + 1):
            row, above = table[i], table[i - 1]
            for j in range(1, len(y) + 1):
                row[j] = max(above[j], row[j - 1], above[j - 1] + weight[i - 1][j - 1][0])
        size += table[-1][-1]
        i, j = len(x), len(y)
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                pairs += weight[i - 1][j - 1][1]
                i, j = i - 1, j - 1
    return size, pairs


class Slot:
    """A node of a template tree."""

    __slots__ = ("tag", "name", "children", "number")

    def __init__(self, node):
        self.tag, self.name, self.number = node.tag, node.name, -1
        self.children = [Slot(c) for c in node.children]


def merge(template: Slot, page: Node) -> None:
    """Adds to the template what the page has beside it, at the place where it is on the page."""
    paired = {id(q): p for p, q in match(template, page)[1]}

    def add(into: Slot, node: Node) -> None:
        place = 0
        for c in node.children:
            if (known := paired.get(id(c))) is not None:
                place = into.children.index(known) + 1
                add(known, c)
            else:
                into.children.insert(place, Slot(c))
                place += 1

    if id(page) in paired:
        add(template, page)


def numbered(template: Slot) -> Slot:
    todo, number = [template], 0
    while todo:
        slot = todo.pop()
        slot.number = number
        number += 1
        todo += reversed(slot.children)
    return template


def induce(pages: list[str]) -> Slot:
    template = None
    for p in pages:
        tree = parse(p)
        if template is None:
            template = Slot(tree)
        else:
            merge(template, tree)
    return numbered(template)


def layout(node) -> str:
    """A tree of nodes or slots without its texts; ``from_layout`` reads it."""

    def nested(x) -> list:
        return [x.tag, x.name, *map(nested, x.children)]

    return json.dumps(nested(node), separators=(",", ":"))


def from_layout(text: str) -> Slot:
    def slot(x: list) -> Slot:
        out = Slot(Node(x[0], x[1]))
        out.children = [slot(c) for c in x[2:]]
        return out

    return slot(json.loads(text))


def _clean(parts: list[str]) -> str:
    return " ".join(entities.unescape("".join(parts)).split())


def _own(node: Node) -> str:
    return _clean([c if isinstance(c, str) else "\n" for c in node.content])


def _digest(text: str) -> int:
    data = text.encode("utf-8", "replace")
    return zlib.crc32(data) << 31 ^ zlib.adler32(data)


def _articles(root: Node) -> list[Node]:
    for tag in ("article", "main"):
        found, todo = [], [root]
        while todo:
            node = todo.pop()
            if node.boiler:
                continue
            if node.tag == tag:
                found.append(node)
            else:
                todo += reversed(node.children)
        if found:
            return found
    return []


def _within(top: Node) -> list[Node]:
    found, todo = [], [top]
    while todo:
        node = todo.pop()
        found.append(node)
        todo += [c for c in node.children if not c.boiler]
    return found


def _aligned(template: Slot, root: Node, articles: list[Node]) -> list[tuple[int, int, Node]]:
    """(slot, slot of the article around it or -1, node) for the page's nodes that align with the template."""
    pairs = match(template, root)[1]
    numbers = {id(q): p.number for p, q in pairs}
    around = {id(q): numbers[id(a)] for a in articles if id(a) in numbers for q in _within(a)}
    outside = {id(q) for a in articles if id(a) not in numbers for q in _within(a)}
    return [(p.number, around.get(id(q), -1), q) for p, q in pairs if id(q) not in outside]


#: Digest of the row that says that a page has an article, and how long its text is.
_HERE = -1


def slots_seen(template: Slot, html: str) -> tuple[str, list[tuple[int, int, int, int]]]:
    """A key of the page's content, and (slot, slot of the article around it, digest and length of its own text) for its nodes that align."""
    root = parse(html)
    articles = _articles(root)
    content = "\n\n".join(_blocks(articles, True, frozenset())) if articles else html
    out = [(n, a, _digest(text), len(text)) for n, a, q in _aligned(template, root, articles) if (text := _own(q))]
    sizes: dict[int, int] = {}
    for _, a, _, size in out:
        if a >= 0:
            sizes[a] = sizes.get(a, 0) + size
    out += [(a, a, _HERE, size) for a, size in sorted(sizes.items())]
    return hashlib.blake2b(content.encode("utf-8", "replace"), digest_size=16).hexdigest(), out


def _blocks(tops: list[Node], articles: bool, fixed: frozenset[int] | set[int]) -> list[str]:
    """Blocks of text below ``tops``, without the own text of the ``fixed`` nodes."""
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        if held:
            if text := _clean(held):
                blocks.append(text)
            held.clear()

    def walk(node: Node) -> None:
        mine = id(node) not in fixed
        for c in node.content:
            if isinstance(c, str):
                if mine:
                    held.append(c)
            elif c.boiler or (c.tag == "header" and not articles):
                if c.tag not in _INLINE:
                    flush()
            elif c.tag in _INLINE:
                walk(c)
            else:
                flush()
                walk(c)
                flush()

    for top in tops:
        walk(top)
        flush()
    return blocks


def extract(html: str | None, template: Slot | None = None, constant: frozenset[tuple[int, int, int]] = frozenset()) -> str:
    """Blocks of the main text in page order, joined by an empty line."""
    if not html:
        return ""
    root = parse(html)
    articles = _articles(root)
    fixed: set[int] = set()
    if template is not None and constant:
        fixed = {id(q) for n, a, q in _aligned(template, root, articles) if (n, a, _digest(_own(q))) in constant}
    return "\n\n".join(_blocks(articles or [root], bool(articles), fixed))


# --- DataFrame operator ---


def main_text(pages: DataFrame, salts: int = 64, constant: float = 0.5, broadcast_bytes: int = 8 << 20, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    ship(pages.sparkSession)
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url_col), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"), host.alias("host"))

    def layouts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[str, str]] = set()
        for b in batches:
            seen.update((h, layout(parse(html))) for h, html in zip(b["host"], b["html"]))
            if len(seen) > 20_000:
                yield pd.DataFrame(sorted(seen), columns=["host", "layout"])
                seen.clear()
        if seen:
            yield pd.DataFrame(sorted(seen), columns=["host", "layout"])

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One template of each run of rows with equal host and salt."""
        key, template = None, None
        for b in batches:
            for h, salt, text in zip(b["host"], b["salt"], b["layout"]):
                if key == (h, salt):
                    merge(template, from_layout(text))
                    continue
                if key is not None:
                    yield pd.DataFrame({"host": [key[0]], "salt": [0], "layout": [layout(template)]})
                key, template = (h, salt), from_layout(text)
        if key is not None:
            yield pd.DataFrame({"host": [key[0]], "salt": [0], "layout": [layout(template)]})

    found = rows.select("host", "html").mapInPandas(layouts, "host string, layout string").distinct()
    for n in (salts, 1):
        dealt = found.select("host", F.pmod(F.xxhash64("layout"), F.lit(n)).cast("int").alias("salt"), "layout").repartition("host", "salt").sortWithinPartitions("host", "salt", "layout")
        found = dealt.mapInPandas(merged, "host string, salt int, layout string")
    templates = materialize(found.select("host", F.col("layout").alias("template")), "templates")
    bytes_of = templates.agg(F.sum(F.octet_length("template"))).first()[0] or 0
    near = F.broadcast if bytes_of <= broadcast_bytes else lambda df: df

    def load(held: dict[str, Slot], host: str, data: str) -> Slot:
        if host not in held:
            if len(held) > 500:
                held.clear()
            held[host] = numbered(from_layout(data))
        return held[host]

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Slot] = {}
        for b in batches:
            pages, seen = [], []
            for h, html, data in zip(b["host"], b["html"], b["template"]):
                key, nodes = slots_seen(load(held, h, data), html)
                pages.append(key)
                seen.append([dict(zip(("slot", "article", "digest", "size"), x)) for x in nodes])
            yield pd.DataFrame({"host": b["host"], "page": pages, "seen": seen})

    pages = rows.select("host", "html").join(near(templates), "host").mapInPandas(count, "host string, page string, seen array<struct<slot int, article int, digest long, size int>>")
    pages = pages.groupBy("host", "page").agg(F.min("seen").alias("seen"))  # copies count once
    texts = pages.select("host", F.inline("seen")).groupBy("host", "slot", "article", "digest").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"))
    here = F.col("digest") == _HERE
    slots = texts.groupBy("host", "article", "slot").agg(
        F.sum(F.when(~here, F.col("n"))).alias("pages"), F.max(F.when(~here, F.struct("n", "digest", "size"))).alias("top"), F.max(F.when(here, F.struct("n", "size"))).alias("articles")
    )
    slots = materialize(slots, "slots")
    marked = slots.where("articles is not null").select("host", "article", F.col("articles.n").alias("of"), F.col("articles.size").alias("size"))
    slots = slots.select("host", "article", "slot", "pages", "top").join(marked, ["host", "article"], "left").where((F.col("top.n") > 1) & (F.col("top.n") >= constant * F.coalesce("of", "pages")))
    copied = slots.groupBy("host", "article").agg((2 * F.sum("top.size") > F.max("size")).alias("copied")).where("copied")
    slots = slots.join(copied, ["host", "article"], "left_anti")
    fixed = slots.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("slot", "article", F.col("top.digest").alias("digest")))).alias("fixed"))
    known = materialize(templates.join(fixed, "host", "left"), "wrappers")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, Slot] = {}
        sets: dict[str, frozenset] = {}
        for b in batches:
            texts = []
            for h, html, data, pairs in zip(b["host"], b["html"], b["template"], b["fixed"]):
                template = load(held, h, data)
                if pairs is not None and h not in sets:
                    if len(sets) > 500:
                        sets.clear()
                    sets[h] = frozenset((p["slot"], p["article"], p["digest"]) for p in pairs)
                texts.append(extract(html, template, sets.get(h, frozenset()) if pairs is not None else frozenset()))
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts})

    return rows.join(near(known), "host", "left").mapInPandas(run, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("bigint"))
