"""Main text of web pages by composite text density.

A page is read into a tree of elements. Elements that never belong to an
article (menus, footers, sidebars, scripts and the like, by tag or role) are set
aside. A form, and an element whose class or id is named like one of these, is
set aside too, unless nothing would remain. On a page with no ``article`` or
``main`` outside of such elements, those around the densest element stay: there
a name may be that of a wrapper. A name counts as a whole (words of the list and
of layout); headings, elements of code, and the ids of sections of an article
with a heading are not looked at. For every other element the composite text density is
computed: its characters per tag, adjusted by the characters and tags of links
in it. The element whose children have the largest sum of densities is the
main one, whatever its tag; of equal sums an ``article`` or ``main`` element
goes first. The smallest density on its path to ``body``, in the page as it is
shown (menus and the like included), is a threshold, and what stands beside
that path is kept if its density reaches it, as are first- and second-level
headings, and prose: at least ``PROSE`` unlinked characters a tag, few of them
in links. Without the last a second section with shorter paragraphs than the
main one would be lost on a page that has no menus.

Character references are decoded, white space within a block becomes one
space, and blocks are joined by a line end in page order. A line break element
is white space.

Nulls: a null or empty html has the empty text; null ids and urls are kept.
Repeated rows each give a row. Markup that ends within a tag is read as far as
it goes. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter

from pyspark.sql import DataFrame

from .common import in_runs

#: fixed HTML vocabulary
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg canvas audio video math textarea select title xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: a start tag of the key closes an open one of the values, but not beyond the second set
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}), "option": ({"option"}, {"select"}),
}
BARRIERS = frozenset("table td th caption button html body".split())
ASIDE_TAGS = frozenset("nav footer aside form button dialog menu head".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
ASIDE_WORDS = (
    "ad|ads|adv|advert|adverts|advertisement|advertising|adsbygoogle|banner|sponsor|sponsored|promo|promotion|nav|navbar|navigation|menu|breadcrumb|breadcrumbs|"
    "sidebar|aside|footer|header|masthead|cookie|cookies|consent|notice|notices|gdpr|alert|popup|modal|overlay|newsletter|subscribe|signup|login|search|share|"
    "sharing|social|related|recommended|comment|comments|disqus|respond|reply|replies|widget|toolbar|pagination|pager|skip|disclaimer"
)
#: words that stand beside those in the name of a class, and say nothing of their own
LAYOUT_WORDS = (
    "area|bar|block|body|bottom|box|button|buttons|center|col|column|container|content|element|form|group|icon|icons|inner|item|items|left|link|links|list|main|"
    "outer|page|panel|primary|recent|right|row|secondary|section|site|text|title|top|wrap|wrapper"
)
ASIDE_CLASS = re.compile(rf"(?<!\S)(?:(?:{LAYOUT_WORDS})[-_]+)*(?:{ASIDE_WORDS})(?:[-_]+(?:{ASIDE_WORDS}|{LAYOUT_WORDS}))*(?!\S)", re.I)
TAG = re.compile(r"<!--.*?(?:-->|\Z)|</?[a-zA-Z](?:[^\"'<>]|\"[^\"<]*\"|'[^'<]*')*+>|</?[a-zA-Z][^>]*>|<[!?/][^>]*>", re.S)
CUT_OFF = re.compile(r"<[a-zA-Z/!][^>]*\Z")
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
MARKED = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
#: unlinked characters a tag of what is prose
PROSE = 80
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
ENDS = {name: re.compile(rf"</{name}\b[^>]*>", re.I) for name in RAW}


class Page:
    """Elements in page order, and the events (element, text or None for a block's edge) between them."""

    def __init__(self, source: str):
        self.tag, self.parent, self.aside, self.soft, self.unseen, self.named = ["#root"], [-1], [False], [False], [False], [""]
        self.events: list[tuple[int, str | None]] = []
        self.open: Counter[str] = Counter()  # open elements by tag
        self._read(source)
        n = len(self.tag)
        self.last = list(range(n))  # last element below each
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            self.last[p] = max(self.last[p], self.last[i])

    def _open(self, name: str, token: str, stack: list[int]) -> int:
        inside, code = self.open["article"] > 0, self.open["pre"] + self.open["code"] > 0
        hard = name in RAW or name in ASIDE_TAGS and name != "form" or name == "header" and not inside
        soft, unseen, named = False, False, "form" if name == "form" else ""
        if name not in ("html", "body", "article", "main") and len(token) > len(name) + 2:
            for key, value in MARKED.findall(token):
                key, value = key.lower(), value.strip("\"'")
                if key in ("class", "id"):
                    if name not in HEADINGS and not (inside and name == "header") and not code and ASIDE_CLASS.search(value):
                        named = key if named in ("", "id") else named
                elif key == "role":
                    soft = soft or value.lower() in ASIDE_ROLES
                elif key == "style":
                    unseen = unseen or bool(INVISIBLE.search(value))
                elif key == "aria-hidden":
                    unseen = unseen or value.lower() == "true"
                elif token[token.lower().find("hidden") - 1].isspace():
                    unseen = True
        elif name == "article" and inside:
            named = "class" if ASIDE_CLASS.search(" ".join(v.strip("\"'") for k, v in MARKED.findall(token) if k.lower() in ("class", "id"))) else ""
        self.tag.append(name)
        self.parent.append(stack[-1])
        self.aside.append(hard or unseen)
        self.soft.append(soft)
        self.named.append(named)
        self.unseen.append(unseen or name == "head")
        return len(self.tag) - 1

    def _close_to(self, stack: list[int], depth: int) -> None:
        while len(stack) > depth:
            i = stack.pop()
            self.open[self.tag[i]] -= 1
            if self.tag[i] in BLOCKS:
                self.events.append((i, None))

    def _read(self, source: str) -> None:
        stack, at = [0], 0
        stop = source.rfind(">") + 1
        while at < len(source):
            m = TAG.search(source, at, stop) if at < stop else None
            piece = source[at : m.start()] if m else CUT_OFF.sub("", source[at:])
            if piece:
                self.events.append((stack[-1], piece))
            if not m:
                break
            at = m.end()
            token = m[0]
            if token[1] in "!?":
                continue
            found = NAME.match(token)
            if not found:
                continue
            name = found[1].lower()
            if token[1] == "/":
                if self.open[name] and name not in ("html", "body"):
                    self._close_to(stack, next(d for d in range(len(stack) - 1, 0, -1) if self.tag[stack[d]] == name))
                continue
            if name in VOID:
                self.events.append((stack[-1], None if name == "hr" else " " if name == "br" else ""))
                continue
            if name in BLOCKS and self.open["p"]:
                for d in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[d]] in BARRIERS:
                        break
                    if self.tag[stack[d]] == "p":
                        self._close_to(stack, d)
                        break
            if name in CLOSES and any(self.open[x] for x in CLOSES[name][0]):
                closed, beyond = CLOSES[name]
                depth = 0
                for d in range(len(stack) - 1, 0, -1):
                    if self.tag[stack[d]] in beyond:
                        break
                    if self.tag[stack[d]] in closed:
                        depth = d
                if depth:
                    self._close_to(stack, depth)
            if name == "body" and self.open["head"]:
                head = next((d for d in range(1, len(stack)) if self.tag[stack[d]] == "head"), 0)
                if head:
                    self._close_to(stack, head)
            i = self._open(name, token, stack)
            if name in BLOCKS:
                self.events.append((i, None))
            if name in RAW:
                if token.endswith("/>") and name in ("svg", "object", "canvas", "math"):
                    continue
                end = ENDS[name].search(source, at)
                at = end.end() if end else len(source)
            else:
                stack.append(i)
                self.open[name] += 1
        self._close_to(stack, 1)


def set_aside(page: Page) -> list[bool]:
    """Elements that are no part of any article, with all that is in them."""
    roots = [i for i, t in enumerate(page.tag) if t in ("article", "main")]
    out = [False] * len(page.tag)
    for i in range(1, len(page.tag)):
        own = page.aside[i] or page.soft[i] and not any(i < r <= page.last[i] for r in roots)
        out[i] = own or out[page.parent[i]]
    return out


def hidden(page: Page) -> list[bool]:
    """Elements that a reader does not see, with all that is in them."""
    out = [False] * len(page.tag)
    for i in range(1, len(page.tag)):
        out[i] = page.unseen[i] or out[page.parent[i]]
    return out


def densities(page: Page, aside: list[bool]) -> tuple[list[float], list[float], list[int], list[int], list[int]]:
    """Composite text density of each element, sum of it over its children (own text as one), characters, those in links, and tags."""
    n = len(page.tag)
    chars, links, tags, link_tags, own = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    linked = [False] * n
    for i in range(1, n):
        linked[i] = linked[page.parent[i]] or page.tag[i] == "a"
    for i, text in page.events:
        if text and not aside[i]:
            size = len(" ".join(text.split()))
            chars[i] += size
            own[i] += size
            if linked[i]:
                links[i] += size
    for i in range(n - 1, 0, -1):
        if not aside[i]:
            p = page.parent[i]
            chars[p] += chars[i]
            links[p] += links[i]
            tags[p] += tags[i] + 1
            link_tags[p] += link_tags[i] + (page.tag[i] == "a")
    body = next((i for i, t in enumerate(page.tag) if t == "body"), 0)
    share = links[body] / max(chars[body], 1)
    density = [0.0] * n
    for i in range(n):
        if aside[i] or not chars[i]:
            continue
        c, t, lc, lt = chars[i], max(tags[i], 1), max(links[i], 1), max(link_tags[i], 1)
        base = math.log(c / max(c - links[i], 1) * links[i] + share * c + math.e)
        density[i] = c / t * math.log(max(c / lc * t / lt, 1.0)) / math.log(max(base, 1.0 + 1e-9)) if base > 1 else c / t * math.log(max(c / lc * t / lt, 1.0))
    sums = [float(x) for x in own]
    for i in range(1, n):
        sums[page.parent[i]] += density[i]
    return density, sums, chars, links, tags


def densest(page: Page, sums: list[float], chars: list[int], aside: list[bool]) -> int | None:
    """The element of the largest sum; of equal ones an article or main element, then the first."""
    choice = [i for i in range(len(page.tag)) if not aside[i] and chars[i]]
    return max(choice, key=lambda i: (sums[i], page.tag[i] in ("article", "main"), -i)) if choice else None


def path_of(page: Page, i: int) -> list[int]:
    """The element and those around it, up to the root."""
    path = [i]
    while page.parent[path[-1]] >= 0:
        path.append(page.parent[path[-1]])
    return path


def threshold_of(page: Page, path: list[int], density: list[float]) -> float:
    """The smallest density on a path, up to body."""
    upto = next((k for k, i in enumerate(path) if page.tag[i] == "body"), len(path) - 1)
    return min(density[i] for i in path[: upto + 1])


def suspects(page: Page, aside: list[bool], chars: list[int], path: set[int]) -> list[bool] | None:
    """``aside`` and the elements named like what is no article, but for those on the path; None if there are none or nothing would remain.

    Within an ``article`` a section with a heading keeps its id: such ids are made of headings.
    """
    headed, n = set(), len(page.tag)
    for i, name in enumerate(page.tag):
        if name in HEADINGS:
            p = page.parent[i]
            while p >= 0 and p not in headed:
                headed.add(p)
                p = page.parent[p]
    out, left, some, inside = list(aside), chars[0], False, [False] * n
    for i in range(1, n):
        inside[i] = inside[page.parent[i]] or page.tag[page.parent[i]] == "article"
        if out[page.parent[i]]:
            out[i] = True
        elif page.named[i] and chars[i] and not out[i] and i not in path:
            if not (page.named[i] == "id" and page.tag[i] == "section" and inside[i] and i in headed):
                out[i] = some = True
                left -= chars[i]
    return out if some and left else None


def has_article(page: Page, chars: list[int]) -> bool:
    """Whether an ``article`` or ``main`` element with text stands in nothing that is named like what is no article."""
    named = [False] * len(page.tag)
    for i in range(1, len(page.tag)):
        named[i] = named[page.parent[i]] or page.named[i] != ""
    return any(t in ("article", "main") and chars[i] and not named[i] for i, t in enumerate(page.tag))


def kept(page: Page) -> list[bool]:
    """Elements whose text is the main text."""
    n = len(page.tag)
    shown = densities(page, hidden(page))[0]
    aside = set_aside(page)
    found = densities(page, aside)
    best = densest(page, *found[1:3], aside)
    if best is None:
        return [False] * n
    spared = set() if has_article(page, found[2]) else set(path_of(page, best))
    named = suspects(page, aside, found[2], spared)
    path = path_of(page, best)
    if named is not None:
        aside = named
        found = densities(page, aside)
        best = densest(page, *found[1:3], aside)
        path = path_of(page, best)
    density, sums, chars, links, tags = found
    threshold = threshold_of(page, path, shown)
    beside = set(path[1:])
    titled = {page.parent[i] for i in range(n) if page.tag[i] in ("h1", "h2") and page.tag[page.parent[i]] in ("header", "hgroup")}
    out = [False] * n
    out[best : page.last[best] + 1] = [True] * (page.last[best] + 1 - best)
    for i in range(1, n):
        if page.parent[i] in beside and i not in beside and i != best and chars[i]:
            prose = chars[i] - links[i] >= PROSE * max(tags[i], 1) and 4 * links[i] <= chars[i]
            if density[i] >= threshold or prose or page.tag[i] in ("h1", "h2") or i in titled:
                out[i : page.last[i] + 1] = [True] * (page.last[i] + 1 - i)
    for i in path[1:]:
        out[i] = True  # text that stands directly in the path
    return [a and not b for a, b in zip(out, aside)]


def main_text(source: str) -> str:
    """The main text of one page."""
    page = Page(source)
    keep = kept(page)
    blocks, parts = [], []
    for i, text in page.events:
        if text is None:
            if parts:
                blocks.append(" ".join("".join(parts).split()))
                parts = []
        elif keep[i]:
            parts.append(references.unescape(text))
    if parts:
        blocks.append(" ".join("".join(parts).split()))
    return "\n".join(b for b in blocks if b)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of all ``pages`` (page_id, url, html)."""

    def read(batches):
        import pyarrow as pa

        for run in in_runs(batches, text="html"):
            texts = [main_text(x) if x else "" for x in run.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [run.column("page_id"), run.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
