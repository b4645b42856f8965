"""Block trees of HTML pages, and simple tree matching between them.

A page becomes a tree of its block elements; inline elements belong to their block's text.  Equal
siblings that follow each other are one node (a repeated record), and so are their children in turn,
so a tree has the size of a page's layout, not of its text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import xxhash

# Element and role names of HTML, and words that mark page furniture in class and id.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg select datalist button object audio video canvas".split())
#: Without an end tag, these hide what follows them; of the others only the tag goes.
ENDLESS = frozenset("script style textarea title iframe".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FURNITURE = frozenset("nav footer aside form menu head dialog search".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
#: A name marks furniture if each of its parts is one of these words or a neutral one, and one is of these.
HINTS = frozenset("ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promos promotion promotions banner banners cookie cookies consent gdpr notice notices alert alerts sidebar widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs footer comment comments disqus reply replies respond share sharing social related recommended newsletter subscribe subscription popup modal pagination pager masthead toolbar skip".split())
NEUTRAL = frozenset("area articles bar block body bottom box button buttons container content form group header icon icons inner item items left link links list lower main media message outer panel posts right row section signup site slot text title to top unit upper wrap wrapper".split())
MAIN = frozenset("article-body articlebody article-content post-content post-body entry-content main-content story-body".split())
#: An opened element closes these if one is open.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "thead": {"tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPE = frozenset("table ul ol dl body html article section div main".split())

# A quote means something after an equals sign only; an unclosed one is a character like any other.
_TAG = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)?)*+)>|<[!?/][^>]*>?", re.S)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*))")
#: Cells of an alignment of children that are held at once; larger ones are halved first.
CELLS = 1 << 24


#: What names tell of a node: it is furniture or inside such, in an article or main element, in a header; it is the article or main element, a heading.
NAMED, INSIDE, HEADER, MARK, HEADING = 1, 2, 4, 8, 16


@dataclass
class Page:
    """A page's nodes in the order of their first appearance, and its text pieces in page order."""

    label: list[str] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    children: list[list[int]] = field(default_factory=list)
    flags: list[int] = field(default_factory=list)
    pieces: list[tuple[int, str, int]] = field(default_factory=list)  # (node, text, characters inside links)

    def add(self, label: str, parent: int, flags: int) -> int:
        n = len(self.label)
        self.label.append(label)
        self.parent.append(parent)
        self.children.append([])
        self.flags.append(flags)
        if parent >= 0:
            self.children[parent].append(n)
        return n

    def digests(self) -> list[int]:
        """A hash of each node's own text; 0 for none."""
        texts: dict[int, list[str]] = {}
        for node, text, _ in self.pieces:
            texts.setdefault(node, []).append(text)
        return [xxhash.xxh64_intdigest("\n".join(texts[n]).encode(), 1) >> 1 if n in texts else 0 for n in range(len(self.label))]


def _attributes(raw: str) -> tuple[str, str, str]:
    """(class, id, role and itemprop)."""
    found = {a.lower(): html.unescape(x or y or z or "") for a, x, y, z in _ATTRIBUTE.findall(raw)} if raw and "=" in raw else {}
    return found.get("class", ""), found.get("id", ""), f"{found.get('role', '')} {found.get('itemprop', '')}".strip()


@lru_cache(4096)
def hinted(names: str) -> bool:
    """Whether one of the names says that its element is furniture; a name of an article's text overrules."""
    words = names.split()
    if any(w.lower() in MAIN for w in words):
        return False
    parts = [[x.lower() for x in _PART.findall(w)] for w in words]
    return any(not HINTS.isdisjoint(p) and all(x in HINTS or x in NEUTRAL or len(x) == 1 for x in p) for p in parts)


def parse(text: str) -> Page:
    """The block tree of a page."""
    page = Page()
    root = page.add("#", -1, 0)
    # (tag, node, children met in this appearance, label of the last child)
    stack: list[list] = [["#", root, 0, -1]]
    opened: Counter = Counter()  # tags on the stack
    words: list[str] = []
    linked = links = 0
    hidden: str | None = None
    endless: set[str] = set()  # elements that have no further end tag
    muted: list = []  # an inline element that is furniture: its tag, and how deep in elements of this tag

    def flush() -> None:
        nonlocal linked
        if words:
            found = " ".join("".join(words).split())
            if found:
                page.pieces.append((stack[-1][1], found, min(linked, len(found))))
            words.clear()
        linked = 0
        muted.clear()

    def close(tags: frozenset | set, scope: frozenset | set) -> None:
        if not any(opened[t] for t in tags):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in tags:
                flush()
                opened.subtract(e[0] for e in stack[i:])
                del stack[i:]
                return
            if stack[i][0] in scope:
                return

    at = 0
    lower = None
    while True:
        if hidden:  # to the end tag of an element whose content is not text
            lower = text.lower() if lower is None else lower
            if hidden in endless:
                end = -1
            elif len(lower) != len(text):  # lower-casing changed lengths; search the text itself
                m = re.compile(f"</{hidden}", re.I).search(text, at)
                end = m.start() if m else -1
            else:
                end = lower.find(f"</{hidden}", at)
            if end < 0:
                if hidden in ENDLESS:
                    break
                endless.add(hidden)
            else:
                at = end
            hidden = None
        m = _TAG.search(text, at)
        segment = text[at : m.start() if m else len(text)]
        if segment and not muted:
            if "&" in segment:
                segment = html.unescape(segment)
            words.append(segment)
            if links:
                linked += len(segment)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            if muted and tag == muted[0]:
                muted[1] -= 1
                if not muted[1]:
                    muted.clear()
            if tag == "a":
                links = max(0, links - 1)
            elif tag in BLOCK:
                close({tag}, frozenset({"table", "body"}) if tag not in ("table", "body", "html") else frozenset())
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/"):
                hidden = tag
            continue
        if tag == "br":
            words.append(" ")
        elif tag == "a":
            links += 1
        if tag not in BLOCK:
            if tag in VOID:
                continue
            if muted:
                muted[1] += tag == muted[0]
            elif "=" in m[3]:
                css, name, role = _attributes(m[3])
                if hinted(f"{css} {name}"):
                    muted[:] = [tag, 1]
                    words.append(" ")
            continue
        flush()
        links = 0
        close({"p"}, SCOPE - {"div"} if tag == "p" else SCOPE)
        if tag in CLOSES:
            close(CLOSES[tag], SCOPE - CLOSES[tag])
        if tag == "hr":
            continue
        css, name, role = _attributes(m[3])
        up = stack[-1]
        parent, siblings = up[1], page.children[up[1]]
        above = page.flags[parent]
        hint = hinted(f"{css} {name}") and tag not in ("body", "html", "article", "main")
        label = (f"{tag}.{css.split()[0]}" if css.strip() else f"{tag}#{name}" if name else tag) + "!" * hint
        if up[3] >= 0 and page.label[siblings[up[3]]] == label:
            node = siblings[up[3]]  # one more of the same record
        else:
            place = next((i for i in range(up[2], len(siblings)) if page.label[siblings[i]] == label), len(siblings))
            if place == len(siblings):
                named = hint or tag in FURNITURE or any(r in ROLES for r in role.lower().split()) or tag == "header" and not above & INSIDE
                mark = tag in ("article", "main") or "main" in role.lower().split() or "articleBody" in role or any(c.lower() in MAIN for c in css.split())
                flags = above & (NAMED | INSIDE | HEADER) | NAMED * named | (INSIDE | MARK) * mark | HEADER * (tag == "header") | HEADING * (tag in HEADINGS)
                page.add(label, parent, flags)
            up[2], up[3] = place + 1, place
            node = siblings[place]
        stack.append([tag, node, 0, -1])
        opened[tag] += 1
    flush()
    return page


class _Kinds:
    """Distinct subtrees of both trees, by number, and the sizes of the largest alignments of pairs of them."""

    def __init__(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.label: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.weight: list[int] = []
        self.made: dict[tuple[int, int], int] = {}

    def of(self, labels: list[str], children: list[list[int]]) -> list[int]:
        """The kind of each node; children have larger numbers than their parents."""
        out = [0] * len(labels)
        for n in range(len(labels) - 1, -1, -1):
            kids = tuple(out[c] for c in children[n])
            k = out[n] = self.ids.setdefault((labels[n], kids), len(self.label))
            if k == len(self.label):
                self.label.append(labels[n])
                self.kids.append(kids)
                self.weight.append(1 + sum(self.weight[c] for c in kids))
        return out

    def size(self, x: int, y: int) -> int | None:
        """The largest alignment of two kinds; None where it is not made yet."""
        if x == y:
            return self.weight[x]
        if self.label[x] != self.label[y]:
            return 0
        return self.made.get((x, y)) if self.kids[x] and self.kids[y] else 1

    def ends(self, x: int, y: int) -> tuple[int, int]:
        """How many children are equal from the start, and then from the end: some largest alignment pairs these."""
        p, q = self.kids[x], self.kids[y]
        n = min(len(p), len(q))
        a = next((i for i in range(n) if p[i] != q[i]), n)
        return a, next((i for i in range(n - a) if p[-1 - i] != q[-1 - i]), n - a)

    def middle(self, x: int, y: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
        a, b = self.ends(x, y)
        return self.kids[x][a : len(self.kids[x]) - b], self.kids[y][a : len(self.kids[y]) - b]

    def solve(self, x: int, y: int) -> None:
        """Make the size of (x, y) and of all pairs below it, without recursion."""
        todo = [(x, y)]
        while todo:
            x, y = todo[-1]
            if self.size(x, y) is not None:
                todo.pop()
                continue
            p, q = self.middle(x, y)
            by_label: dict[str, list[int]] = {}
            for v in set(q):
                by_label.setdefault(self.label[v], []).append(v)
            wait = [(u, v) for u in set(p) for v in by_label.get(self.label[u], ()) if self.size(u, v) is None]
            if wait:
                todo += wait
                continue
            equal = sum(self.weight[k] for k in self.kids[x]) - sum(self.weight[k] for k in p)
            self.made[x, y] = 1 + equal + int(self.rows(p, q)[-1][-1])
            todo.pop()

    def rows(self, p: tuple[int, ...], q: tuple[int, ...], keep: bool = False) -> list[np.ndarray]:
        """Rows of the table of best sizes over starts of p and q: all, or the last one."""
        places: dict[str, list[int]] = {}
        for j, v in enumerate(q):
            places.setdefault(self.label[v], []).append(j)
        gains: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        out = [np.zeros(len(q) + 1, np.int32)]
        for u in p:
            if u not in gains:
                at = places.get(self.label[u], [])
                gains[u] = np.array(at, np.int64), np.array([self.size(u, q[j]) for j in at], np.int32)
            at, gain = gains[u]
            row = out[-1].copy()
            row[at + 1] = np.maximum(row[at + 1], out[-1][at] + gain)
            row = np.maximum.accumulate(row)
            if not keep:
                out.clear()
            out.append(row)
        return out

    def align(self, p: tuple[int, ...], q: tuple[int, ...]) -> list[tuple[int, int]]:
        """Places of p and q that a largest alignment pairs."""
        pairs, todo = [], [(0, len(p), 0, len(q))]
        while todo:
            a, b, c, d = todo.pop()
            if (b - a) * (d - c) > CELLS and b - a > 1:
                mid = (a + b) // 2
                k = c + int(np.argmax(self.rows(p[a:mid], q[c:d])[-1] + self.rows(p[mid:b][::-1], q[c:d][::-1])[-1][::-1]))
                todo += [(a, mid, c, k), (mid, b, k, d)]
                continue
            best, i, j = self.rows(p[a:b], q[c:d], True), b - a, d - c
            while i and j:
                gain = self.size(p[a + i - 1], q[c + j - 1])
                if gain and best[i][j] == best[i - 1][j - 1] + gain:
                    i, j = i - 1, j - 1
                    pairs.append((a + i, c + j))
                elif best[i][j] == best[i - 1][j]:
                    i -= 1
                else:
                    j -= 1
        return pairs


def match(a: tuple[list[str], list[list[int]]], b: tuple[list[str], list[list[int]]]) -> dict[int, int]:
    """Simple tree matching: the largest alignment of two trees that keeps labels, parents and order.

    Trees are (labels, children); the result takes nodes of a to nodes of b.
    """
    kinds = _Kinds()
    ka, kb = kinds.of(*a), kinds.of(*b)
    out: dict[int, int] = {}
    todo = [(0, 0)] if a[0][0] == b[0][0] else []
    while todo:
        x, y = todo.pop()
        out[x] = y
        p, q, (i, j) = a[1][x], b[1][y], kinds.ends(ka[x], kb[y])
        todo += zip(p[:i], q[:i])
        todo += zip(p[len(p) - j :], q[len(q) - j :])
        if i + j < min(len(p), len(q)):
            kinds.solve(ka[x], kb[y])
            todo += [(p[i + m], q[i + n]) for m, n in kinds.align(*kinds.middle(ka[x], kb[y]))]
    return out
