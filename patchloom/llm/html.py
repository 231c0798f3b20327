"""HTML extraction by tree scoring.

The page becomes a tree of elements. Paragraphs give points, for their length and their commas, to the elements above
them, less with each level and less the more of their text lies in links. The best element is the container; it and those
of its siblings that score well enough are kept, with all their blocks except what is no text of the article by its tag
or by its class and id.

Null and empty pages give an empty text. Repeated rows are extracted alike. Broken markup is read as browsers roughly do:
end tags without start are skipped, paragraphs and list items end where the next one begins. An empty table gives an
empty result; other columns are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from patchloom.llm.tables import arrow_pass

# Markup that the tree is read by (fixed values of the HTML standard).
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript template svg math object audio video canvas".split())
NO_TEXT = frozenset("head title script style noscript template iframe noembed noframes svg math object audio video canvas nav aside footer button select option textarea menu dialog search map frameset xmp datalist".split())
ENDS_PARAGRAPH = BLOCKS - {"button", "option", "optgroup", "head", "html", "body", "tbody", "thead", "tfoot", "tr", "td", "th", "caption", "legend"}
#: What a start tag closes, and what it never closes beyond.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
# Words of class and id that mark what is no article (fixed values).
OTHER = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|banner|breadcrumbs?|captcha|comments?|commentlist|cookies?|consent|disqus|disclaimer|footer|foot|gdpr|header|login|masthead|menu|modal|nav\w*|newsletter|notice|overlay|pager|pagination|popup|promo\w*|recommend\w*|related|remarks?|replies|share|sharing|shoutbox|sidebar|signup|skyscraper|social|sponsor\w*|subscribe|tags?|toolbar|topbar|widgets?|alert)(?=$|[\s_-])", re.I)
ROLES = frozenset("navigation banner complementary contentinfo search form alert alertdialog dialog menu menubar toolbar".split())

#: Siblings of the container: tags that stay with few links, the share of links that is few, and what other elements must
#: be worth, of a mean block of the container.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 hgroup blockquote pre ul ol dl table figure".split())
SIBLING_LINKS, SIBLING_SHARE = 0.3, 0.5

TOKEN = re.compile(r"<!--(?:>|->|.*?--!?>|.*\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
#: Words that say what a page has, not what the element is; and words of what readers add, which may outgrow the article.
LAYOUT = re.compile(r"(?:(?<=[\s_-])|^)(?:has|no|with|without)[_-]\S+|(?<=\w)-widgets?(?=[\s_-]|$)", re.I)
READERS = re.compile(r"comment|disqus|remark|replies|shoutbox", re.I)
#: The share of the page's points above which an element named as no article is the page's wrapper all the same.
MOST, NEARLY_ALL = 0.5, 0.9
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
SPACE = re.compile(r"\s+")
COMMAS = re.compile(r"[,،、，;]")


class Node:
    """An element: its children (nodes and texts), whether it is left out, the share of the page from which its name does
    not count (0: not named), and its points."""

    __slots__ = ("above", "children", "link", "named", "other", "points", "tag")

    def __init__(self, tag: str, above: Node | None, other: bool, named: float = 0.0):
        self.tag, self.above, self.other, self.named = tag, above, other, named
        self.children: list[Node | str] = []
        self.points, self.link = 0.0, tag == "a" or bool(above and above.link)


def attributes_of(text: str) -> dict[str, str]:
    """Names (lower case) and values of a start tag's attributes; of repeated names the first holds."""
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def is_other(tag: str, attributes: dict[str, str], inside: bool) -> bool:
    """Whether an element is no text of an article. ``inside`` an article, a plain header is its heading."""
    if tag in NO_TEXT or tag == "header" and not inside:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    role = attributes.get("role", "").lower()
    return "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or bool(HIDDEN.search(attributes.get("style", ""))) or role in ROLES and role != "form"


def named_other(tag: str, attributes: dict[str, str], inside: bool) -> float:
    """The share of the page that an element must hold to stay although its class, id or tag says it is no article, or 0.
    Headings, and what is ``inside`` an article, may be called header."""
    if tag in ("html", "body", "article", "main"):
        return 0.0
    names = [m[0] for x in ("class", "id") for m in OTHER.finditer(LAYOUT.sub(" ", attributes.get(x, "")))] if attributes else []
    if inside or tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
        names = [x for x in names if x.strip(" _-").lower() != "header"]
    if names:
        return NEARLY_ALL if any(READERS.search(x) for x in names) else MOST
    return MOST if tag == "form" or attributes.get("role", "").lower() == "form" else 0.0


def discount(root: Node) -> None:
    """Leave out the elements named as no article. Those that hold most of the page's points
    stay, as wrappers of the page, unless an article stands outside them."""
    held: dict[int, tuple[Node, float]] = {}
    total = 0.0
    article = False
    for node, text, linked in blocks(root):
        points, names, inside = worth(text, linked), 0, False
        total += points
        while node is not None:
            inside = inside or node.tag in ("article", "main")
            if node.named:
                names += 1
                held[id(node)] = node, held.get(id(node), (node, 0.0))[1] + points
            node = node.above
        article = article or inside and not names
    for node, points in held.values():
        if points > node.named * total and (not article or _inside(node)):
            node.named = 0.0
    todo = [root]
    while todo:
        node = todo.pop()
        node.other = node.other or node.named > 0
        todo += [x for x in node.children if isinstance(x, Node) and not node.other]


def tree(html: str) -> Node:
    root = Node("html", None, False)
    at, here, n = 0, root, len(html)
    while at < n:
        m = TOKEN.search(html, at)
        if not m:
            here.children.append(html[at:])
            break
        if m.start() > at:
            here.children.append(html[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            node = here
            while node is not None and node.tag != tag:
                if tag not in BLOCKS and node.tag in BLOCKS:  # an inline end tag does not close blocks
                    node = None
                    break
                node = node.above
            if node is not None and node.above is not None:
                here = node.above
            elif tag == "br":
                here.children.append(" ")
            continue
        if tag == "html":
            continue
        if tag in ENDS_PARAGRAPH:
            node = here
            while node.above is not None and node.tag != "p" and (node.tag not in BLOCKS):
                node = node.above
            if node.tag == "p":
                here = node.above
        if tag in CLOSES:
            ends, stop = CLOSES[tag]
            node = here
            while node.above is not None and node.tag not in stop:
                if node.tag in ends:
                    here = node.above
                node = node.above
        if tag == "body":
            while here.above is not None:
                here = here.above
        if tag in VOID:
            here.children.append(" " if tag in ("br", "wbr") and tag == "br" else Node(tag, here, False) if tag == "hr" else "")
            continue
        attributes = attributes_of(m[3]) if m[3] else {}
        inside = _inside(here)
        node = Node(tag, here, here.other or is_other(tag, attributes, inside), named_other(tag, attributes, inside))
        here.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            if end or tag in ("script", "style"):
                at = end.end() if end else n
                continue
        if not (m[3].endswith("/") and tag not in BLOCKS and tag not in RAW and tag not in ("a", "b", "i", "span", "em", "strong")):
            here = node
    return root


def _inside(node: Node | None) -> bool:
    while node is not None:
        if node.tag in ("article", "main"):
            return True
        node = node.above
    return False


def blocks(top: Node) -> Iterator[tuple[Node, str, int]]:
    """(element, text, length of text in links) of the blocks below, in page order, white space made one space."""
    text: list[str] = []
    linked = 0
    owner = top

    def flush():
        nonlocal linked
        whole, found = SPACE.sub(" ", unescape("".join(text))).strip(" "), linked
        text.clear()
        linked = 0
        return (owner, whole, min(found, len(whole))) if whole else None

    todo: list[tuple[Node, int]] = [(top, 0)]
    while todo:
        node, i = todo.pop()
        if i == 0 and node.tag in BLOCKS:
            if out := flush():
                yield out
            owner = node
        while i < len(node.children):
            x = node.children[i]
            i += 1
            if isinstance(x, str):
                text.append(x)
                linked += len(x) if node.link else 0
            elif not x.other:
                todo += [(node, i), (x, 0)]
                break
            elif x.tag in BLOCKS:
                if out := flush():
                    yield out
        else:
            if node.tag in BLOCKS:
                if out := flush():
                    yield out
                owner = node.above or node
                while owner.tag not in BLOCKS and owner.above is not None:
                    owner = owner.above
    if out := flush():
        yield out


def worth(text: str, linked: int) -> float:
    """Points of a block: for its length and commas, less the more of it lies in links."""
    return (1 + len(COMMAS.findall(text)) + min(len(text) / 100, 3)) * (1 - linked / len(text))


def good_siblings(best: Node, found: list[tuple[Node, str, int]]) -> set[int]:
    """The numbers of the blocks of the container and of its good siblings, by the siblings' own text: paragraphs, headings
    and bare text with few links; other elements that are worth half a mean block of the container, too."""
    parts: dict[int, tuple[Node, list[int]]] = {}
    for i, (node, _, _) in enumerate(found):
        part = node
        while part is not best.above and part.above is not best.above and part.above is not None:
            part = part.above
        if part is best.above or part.above is best.above:  # bare text is a part by itself
            parts.setdefault(i if node is best.above else -id(part), (part, []))[1].append(i)
    own = [worth(*found[i][1:]) for i in parts.get(-id(best), (best, []))[1]]
    floor = SIBLING_SHARE * sum(own) / len(own) if own else 0.0
    kept = set()
    for part, rows in parts.values():
        few = sum(found[i][2] for i in rows) <= SIBLING_LINKS * sum(len(found[i][1]) for i in rows)
        plain = part.tag in PROSE or part is best.above
        if part is best or few and (plain or sum(worth(*found[i][1:]) for i in rows) >= floor):
            kept |= set(rows)
    return kept


def main_text(html: str | None) -> str:
    """The blocks of the best container and of its good siblings, joined by one space."""
    root = tree(html or "")
    discount(root)
    found = list(blocks(root))
    if not found:
        return ""
    candidates: dict[int, Node] = {}
    for node, text, linked in found:
        points = worth(text, linked)
        level, above = 0, node if node.tag in ("body", "html", "article", "main", "section", "div", "td") else node.above
        while above is not None:
            above.points += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            candidates[id(above)] = above
            above, level = above.above, level + 1
    for node in candidates.values():
        node.points *= 1.5 if node.tag in ("article", "main") else 1.0
    best = max(candidates.values(), key=lambda x: x.points) if candidates else root
    article = best
    while article is not None and article.tag not in ("article", "main"):
        article = article.above
    best = article or best  # a container inside an article stands for the whole article
    if best.above is None:
        return " ".join(text for _, text, _ in found)
    kept = good_siblings(best, found)
    return " ".join(text for i, (_, text, _) in enumerate(found) if i in kept)


def extracted(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    rows = pages.select("page_id", "url", pages["html"].cast("string").alias("html"))
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield {"page_id": part.column(0), "url": part.column(1), "text": texts, "n_chars": [len(x) for x in texts]}

    return arrow_pass(rows, schema, work)
