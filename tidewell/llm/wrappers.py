"""Main text of web pages by wrappers inferred per host.

A page becomes a tree of regions, elements with their first class or id, and text slots. Runs of like siblings fold
into a repeated group. Pages of a host are aligned one after the other, sequence by sequence; where they mismatch, a
region becomes optional, and where one repeats what the other has once, a group. The result is a regular expression
without alternatives whose slots, each at its place, carry what fills them: on how many pages, with always the same
text or not, how much of it link text.

That decides what is content. A slot with one text on pages that differ otherwise is the template's. Names such as
``nav`` or ``sidebar`` propose furniture, and a region that holds the main text overrules them; a doubtful name counts
only with statistics that agree. Of the rest, content is what lies in article or main elements if these hold a fair
share of it, or else the region that most of it is in, without slots filled by links. Each page is aligned to its
host's wrapper and gives the texts of the content slots.
"""

from __future__ import annotations

import html as _html
import json
import math
import re
from collections.abc import Iterable, Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_small, settle
from .urls import host_of

#: A comment, a declaration, a tag with quoted attributes, any other tag, text, a lone bracket.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^<>]*)>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp"}
RAW_END = {name: re.compile(rf"</{name}\b[^>]*>?", re.I) for name in RAW}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that only format what they hold: they make no region and don't end a block.
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that hold text rather than regions: any two siblings of these are alike.
TEXTUAL = set("p li dt dd td th tr h1 h2 h3 h4 h5 h6 pre figcaption caption option".split())
CONTAINERS = set("html body div section main article center table tbody tr td form header span".split())
#: Elements that propose furniture, and those of them that the main text may overrule.
FURNITURE = set("head nav header footer aside form button select option dialog menu script style noscript template iframe svg canvas object video audio title textarea".split())
OVERRULED = {"form", "header"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
KNOWN = INLINE | TEXTUAL | CONTAINERS | FURNITURE | VOID | set("address blockquote dl details summary fieldset figure hgroup legend map ol ul picture search tfoot thead colgroup optgroup frameset frame noframes center dir".split())
#: Words in class, id or role that mark furniture, and the kind of each.
MARKS = {
    word: kind
    for kind, words in {
        "advert": "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored sponsors promo promos promotion promoted",
        "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup paywall toolbar",
        "comment": "comment comments commentlist disqus respond replies reply discussion",
        "side": "sidebar sidebars aside widget widgets related recommended recommendations share sharing social complementary",
        "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager skip topbar tabs",
        "frame": "header masthead footer foot copyright banner contentinfo colophon",
    }.items()
    for word in words.split()
}
#: Words that leave a mark as sure as it is; any other word beside it makes it doubtful.
PLAIN_WORDS = set("area bar block bottom box buttons container first group inner item items last left link links list nav panel primary right row secondary section site slot text top unit wrap wrapper".split())
#: An element of the first closes the open ones of the second when it begins.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Levels below which only furniture and articles are told apart, and below which a chain of one key is one region.
LEVELS, CHAIN = 150, 32
#: Cells of an alignment's table from which it is filled by rows of arrays, with the same pairs.
CELLS = 2048
#: Different wrappers that one task aligns.
ALIGNED = 256
#: Bytes of all hosts' wrappers that every task gets; beyond them pages travel to the wrapper of their host, PART bytes of
#: one host to a task. Bytes of wrappers that a task keeps built.
SENT, PART, BUILT = 16 << 20, 128 << 20, 4 << 20
#: Pages of different main text on which a slot's one text makes it the template's.
DIFFERENT = 3
#: Share of link text from which a slot outside articles is a menu.
LINKS = 0.5
#: Of all prose, what must be left outside a region for its name to stand; what articles must hold; what a region must hold to be gone into.
OUTSIDE, ARTICLE, MOST = 0.2, 0.3, 0.8


def mark_of(attributes: str) -> tuple[str, str]:
    """The first id or class (numbers out), and the kind of furniture that id, class or role propose, with ? if in doubt."""
    name, sure, doubt = "", "", ""
    for m in ATTRIBUTE.finditer(attributes):
        for token in (m[2] or m[3] or m[4] or "").lower().split():
            words = re.findall(r"[a-z]+", token)
            if not name and m[1].lower() != "role":
                name = "-".join(words)[:40]
            if marked := [MARKS[w] for w in words if w in MARKS]:
                if all(w in MARKS or w in PLAIN_WORDS for w in words):
                    sure = sure or marked[0]
                else:
                    doubt = doubt or marked[0] + "?"
    return name, sure or doubt


class Region:
    __slots__ = ("key", "kids", "level", "name", "parent")

    def __init__(self, name: str, key: str, parent: Region | None) -> None:
        self.name, self.key, self.parent, self.kids = name, key, parent, []
        self.level = parent.level + 1 if parent else 0


class Text:
    __slots__ = ("linked", "text")

    def __init__(self, text: str, linked: int) -> None:
        self.text, self.linked = text, linked


def parsed(page: str) -> tuple[Region, list[Text]]:
    """A page's tree of regions and its text blocks in order.

    A region's key is its element's name, ``.`` and the first id or class, ``!`` and the kind of furniture proposed.
    """
    root = here = Region("", "", None)
    out: list[Text] = []
    stack: list[tuple[str, Region | None, Region]] = []  # element, its region if it makes one, the region within it
    solid: list[int] = []  # places in the stack of elements that aren't inline
    count: dict[str, int] = {}  # of open elements
    text: list[str] = []
    linked, at, size = 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if text:
            joined = " ".join(_html.unescape("".join(text)).split())
            if joined:
                block = Text(joined, min(linked, len(joined)))
                out.append(block)
                here.kids.append(block)
            text.clear()
        linked = 0

    def close(depth: int) -> None:
        nonlocal here
        if any(r for _, r, _ in stack[depth:]):
            flush()
        for e, _, _ in stack[depth:]:
            count[e] -= 1
        del stack[depth:]
        while solid and solid[-1] >= depth:
            solid.pop()
        here = stack[-1][2] if stack else root

    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            piece = m[0]
            if piece[0] != "<" or piece == "<":
                text.append(piece)
                if count.get("a"):
                    linked += len(piece.strip())
            continue
        name = name.lower()
        if m[1] or m[4]:
            if count.get(name):
                close(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            elif name == "p":
                flush()
            continue
        if name in RAW:  # dropped with all they hold; they don't end a block
            end = RAW_END[name].search(page, at)
            at = end.end() if end else size
            continue
        attributes = m[3] or m[6] or ""
        own, kind = mark_of(attributes) if attributes else ("", "")
        makes = name not in INLINE or bool(kind)
        if name == "br":
            text.append(" ")
        elif makes:
            flush()
        if makes and name not in VOID:
            closes = CLOSES.get(name, ()) if name in CLOSES else {"p"} if name not in INLINE else ()
            if solid and (stack[solid[-1]][0] in closes or (stack[solid[-1]][0] == "p" and name not in INLINE)):
                close(solid[-1])
        if name in VOID or attributes.rstrip().endswith("/"):
            continue
        count[name] = count.get(name, 0) + 1
        region = None
        if makes:
            tag = name if name in KNOWN else "x-"
            key = tag + (f".{own}" if own else "") + (f"!{kind}" if kind else "")
            telling = tag in ("article", "main") or tag in FURNITURE or kind
            if not (here.level > CHAIN and here.key == key and not here.kids and tag not in TEXTUAL) and (here.level < LEVELS or (telling and here.level < 2 * LEVELS)):
                region = Region(tag, key, here)  # a chain of one key is one region
                here.kids.append(region)
                here = region
            else:
                region = here
        if name not in INLINE:
            solid.append(len(stack))
        stack.append((name, region, here))
    flush()
    return root, out


# A wrapper's node is [key, optional, repeated, pages, children], and its slot
# ["", optional, repeated, pages, text or None, length, link length, digests of pages]. A page's nodes end with its blocks' numbers.


def tree_of(page: str) -> tuple[list, list[Text]]:
    """A page's regular expression, runs of like siblings folded, and its blocks."""
    root, found = parsed(page)
    number = {id(b): i for i, b in enumerate(found)}
    main = sorted((b.text for b in found), key=lambda t: (-len(t), t))[:2]
    digest = [crc32("\n".join(main).encode("utf-8", "surrogatepass"))]

    def built(region: Region) -> list:
        out = []
        for x in region.kids:
            if isinstance(x, Text):
                out.append(["", False, False, 1, x.text if len(x.text) <= 80 else f"{crc32(x.text.encode('utf-8', 'surrogatepass')):08x}:{len(x.text)}:{x.text[:60]}", len(x.text), x.linked, digest, [number[id(x)]]])
            elif kids := built(x):
                out.append([x.key, False, False, 1, kids])
        return folded(out)

    return built(root), found


def shape(node: list) -> str:
    """A region's structure without its texts; a slot of links differs from one of text."""
    return "@" if not node[0] and node[6] >= LINKS * node[5] else "#" if not node[0] else f"<{node[0]}{'|'.join(map(shape, node[4]))}>"


def merged(a: list, b: list, within: bool) -> list:
    """Two nodes of one key, or two slots, as one; ``within`` a page."""
    flags = [a[0], a[1] or b[1], a[2] or b[2], max(a[3], b[3]) if within else a[3] + b[3]]
    if a[0]:
        return [*flags, aligned(a[4], b[4], within)]
    digests = a[7] if a[7] == b[7] else sorted({*a[7], *b[7]})[:DIFFERENT]
    numbers = []
    if len(a) > 8:
        a[8].extend(b[8])  # nothing else has ``a``, so that a long run is folded in one pass
        numbers = [a[8]]
    return [*flags, a[4] if a[4] == b[4] else None, a[5] + b[5], a[6] + b[6], digests, *numbers]


def folded(nodes: list) -> list:
    """Adjacent like siblings become a repeated group: of one key, and for regions that hold regions of one shape."""
    out: list = []
    for node in nodes:
        if out and out[-1][0] == node[0] and (not node[0] or _tag(node[0]) in TEXTUAL or shape(out[-1]) == shape(node)):
            out[-1] = merged(out[-1], node, True)
            out[-1][2] = True
        else:
            out.append(node)
    return out


def _tag(key: str) -> str:
    return re.split(r"[.!]", key, maxsplit=1)[0]


def pairs(a: list, b: list) -> list[tuple[int, int]]:
    """Which nodes of two sequences stand for each other: a longest common subsequence of keys, like shapes counting more."""
    n, m = len(a), len(b)
    if [x[0] for x in a] == [x[0] for x in b]:
        return list(zip(range(n), range(n), strict=True))
    kids = [[_traits(x) for x in side] for side in (a, b)]
    if n * m > CELLS:
        return _long_pairs([x[0] for x in a], [x[0] for x in b], *kids)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = max(below[j], row[j + 1], below[j + 1] + _alike(kids[0][i], kids[1][j]) if a[i][0] == b[j][0] else 0)
    out, i, j = [], 0, 0
    while i < n and j < m:
        if a[i][0] == b[j][0] and best[i][j] == best[i + 1][j + 1] + _alike(kids[0][i], kids[1][j]):
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return out


def _long_pairs(a: list[str], b: list[str], left: list[frozenset], right: list[frozenset]) -> list[tuple[int, int]]:
    """``pairs`` of long sequences by their keys and traits, a row of the table at a time.

    Only each k-th row is kept, and the rows between are made again as the path goes through them, so that memory is
    that of 2 * sqrt(n) rows.
    """
    n, m = len(a), len(b)
    begin = 0  # what stands first or last in both and is wholly alike, belongs together in a best alignment
    while begin < min(n, m) and a[begin] == b[begin] and left[begin] == right[begin]:
        begin += 1
    head = list(zip(range(begin), range(begin), strict=True))
    n, m = n - begin, m - begin
    if not n or not m:
        return head
    at_key: dict[str, list[int]] = {}
    at_trait: dict[str, list[int]] = {}
    for j in range(m):
        at_key.setdefault(b[begin + j], []).append(j)
        for t in right[begin + j]:
            at_trait.setdefault(t, []).append(j)
    by_key, by_trait = ({k: np.array(v) for k, v in d.items()} for d in (at_key, at_trait))
    held = np.array([len(x) for x in right[begin:]])
    known: dict[tuple[str, frozenset], tuple[np.ndarray, np.ndarray]] = {}

    def weights(i: int) -> tuple[np.ndarray, np.ndarray] | None:
        """The places of ``b`` with the key of a[i], and what a match there counts."""
        key, own = a[begin + i], left[begin + i]
        places = by_key.get(key)
        if places is None:
            return None
        if (key, own) in known:
            return known[key, own]
        both = np.zeros(m, dtype=np.int32)
        for t in own:
            if t in by_trait:
                both[by_trait[t]] += 1
        both = both[places]
        union = len(own) + held[places] - both
        out = places, np.where(union > 0, 4 + 4 * both // np.maximum(union, 1), 8).astype(np.int32)
        if len(known) < 64:
            known[key, own] = out
        return out

    def row(i: int, below: np.ndarray) -> np.ndarray:
        found = weights(i)
        if found is None:
            return below
        out = below.copy()
        places, gain = found
        out[places] = np.maximum(out[places], below[places + 1] + gain)
        return np.maximum.accumulate(out[::-1])[::-1]

    step = max(1, math.isqrt(n))
    kept = {n: np.zeros(m + 1, dtype=np.int32)}
    now = kept[n]
    for i in range(n - 1, -1, -1):
        now = row(i, now)
        if i % step == 0:
            kept[i] = now
    out, i, j, rows = [], 0, 0, {}
    while i < n and j < m:
        if i not in rows or i + 1 not in rows:
            end = min(n, i + step - i % step)
            rows = {end: kept[end]}
            for k in range(end - 1, i - 1, -1):
                rows[k] = row(k, rows[k + 1])
        gain = 0
        if a[begin + i] == b[begin + j]:
            gain = _alike(left[begin + i], right[begin + j])
        if gain and rows[i][j] == rows[i + 1][j + 1] + gain:
            out.append((begin + i, begin + j))
            i, j = i + 1, j + 1
        elif rows[i][j] == rows[i + 1][j]:
            i += 1
        else:
            j += 1
    return head + out


def _traits(x: list) -> frozenset:
    """What tells nodes of one key apart: what they hold, and their first texts as far as these are always the same."""
    out: list[str] = []
    todo = [x]
    while todo and len(out) < 8:
        node = todo.pop(0)
        if not node[0]:
            out += [shape(node)] + (["=" + node[4]] if node[4] is not None else [])
        else:
            out += [k[0] for k in node[4][: 8 - len(out)] if k[0]]
            todo += node[4][:8]
    return frozenset(out)


def _alike(a: frozenset, b: frozenset) -> int:
    return 4 + (4 * len(a & b) // len(a | b) if a or b else 4)


def aligned(a: list, b: list, within: bool = False) -> list:
    """Two sequences as one: what stands for each other merges, what only one has becomes optional."""
    out, i, j = [], 0, 0
    for x, y in [*pairs(a, b), (len(a), len(b))]:
        out += [[n[0], True, *n[2:]] for n in (*a[i:x], *b[j:y])]
        if x < len(a):
            out.append(merged(a[x], b[y], within))
        i, j = x + 1, y + 1
    return out


def expression(nodes: list) -> str:
    """The wrapper as text, for reading and tests."""
    parts = []
    for x in nodes:
        inner = "#text" if not x[0] else f"<{x[0]}>{expression(x[4])}</>"
        parts.append(f"({inner}){'*' if x[1] and x[2] else '+' if x[2] else '?' if x[1] else ''}" if x[1] or x[2] else inner)
    return "".join(parts)


class Wrapper:
    """Which slots of a host's expression hold content: ``content`` has the ids of its slot nodes."""

    def __init__(self, nodes: list) -> None:
        self.nodes = nodes
        self.prose: dict[int, float] = {}  # characters of a node that are neither links nor the template's
        self.links: dict[int, tuple[int, int]] = {}
        self.total = sum(self._measure(x) for x in nodes)
        self.pages = max((x[3] for x in nodes), default=0)
        self.furniture: set[int] = set()
        self.articles: list[list] = []
        for x in nodes:
            self._judge(x, False)
        held = sum(self._left(x) for x in self.articles)
        self.in_article = held > 0 and held >= ARTICLE * sum(self._left(x) for x in nodes)
        self.regions = self.articles if self.in_article else [self._densest(nodes)]
        self.content: set[int] = set()
        for x in self.regions:
            self._collect(x, self.in_article)
        if not self.content:  # nothing but links or the template: what no name speaks against
            for x in nodes:
                self._collect(x, True, True)

    def _template(self, slot: list) -> bool:
        return slot[4] is not None and len(slot[7]) >= DIFFERENT

    def _measure(self, x: list) -> float:
        if x[0]:
            own = sum(self._measure(k) for k in x[4])
            self.links[id(x)] = tuple(map(sum, zip(*[self.links[id(k)] for k in x[4]], strict=True)))
        else:
            own = 0 if self._template(x) else x[5] - x[6]
            self.links[id(x)] = (x[5], x[6])
        self.prose[id(x)] = own
        return own

    def _left(self, x: list) -> float:
        """Prose of a node without what is furniture in it."""
        if id(x) in self.furniture:
            return 0
        return sum(self._left(k) for k in x[4]) if x[0] else self.prose[id(x)]

    def _holds(self, x: list, tags: tuple[str, ...]) -> bool:
        return bool(x[0]) and (_tag(x[0]) in tags or any(self._holds(k, tags) for k in x[4]))

    def _linked(self, x: list) -> bool:
        size, linked = self.links[id(x)]
        return linked >= LINKS * max(1, size)

    def _proposed(self, x: list, inside: bool) -> bool:
        """Whether a region is furniture, by its name and what speaks against it."""
        tag, _, kind = x[0].partition("!")
        tag = _tag(tag)
        if tag == "article" and inside and kind == "comment":
            return True
        if tag in ("html", "body", "article", "main") or (tag == "x-" and not kind):
            return False
        main = self.prose[id(x)] > (1 - OUTSIDE) * self.total and not self._linked(x) and self.prose[id(x)] >= 200 * max(1, x[3])
        if tag in FURNITURE and not (tag in OVERRULED and (main or self._holds(x, ("article", "main")))):
            return True
        if not kind or main or self._holds(x, ("article", "main")):
            return False
        if not kind.endswith("?"):
            return True
        rare = x[1] and self.pages >= 4 and x[3] <= self.pages / 2  # a notice or advert that some pages have
        return self._linked(x) or self.prose[id(x)] == 0 or (rare and not inside)

    def _judge(self, x: list, inside: bool) -> None:
        if not x[0]:
            return
        tag = _tag(x[0].partition("!")[0])
        if self._proposed(x, inside):
            if inside and (tag == "header" or x[0].rstrip("?").endswith("!frame")) and self._holds(x, tuple(HEADINGS)):
                self._headings_only(x)  # an article's own header
            else:
                self.furniture.add(id(x))
            return
        if tag in ("article", "main") and not inside:
            self.articles.append(x)
        for k in x[4]:
            self._judge(k, inside or tag in ("article", "main"))

    def _headings_only(self, x: list) -> None:
        for k in x[4]:
            if k[0] and _tag(k[0]) in HEADINGS:
                continue
            if self._holds(k, tuple(HEADINGS)):
                self._headings_only(k)
            else:
                self.furniture.add(id(k))

    def _densest(self, nodes: list) -> list:
        """The innermost region that holds most of the prose, not one that only holds text.

        It isn't gone into past a heading, nor past text known to differ from page to page.
        """
        here = ["()", False, False, 1, nodes]
        least = MOST * sum(self._left(k) for k in nodes)
        while True:
            inner = [k for k in here[4] if k[0] and not k[2] and _tag(k[0].partition("!")[0]) in CONTAINERS and any(y[0] for y in k[4]) and self._left(k) >= least > 0]
            if not inner or any(self._tells(k) for k in here[4] if k is not inner[0]):
                return here
            here = inner[0]

    def _tells(self, x: list) -> bool:
        """Whether a node has a heading, or a slot without links whose text isn't the template's on as many pages as it takes."""
        if id(x) in self.furniture or not self._left(x):
            return False
        if x[0]:
            return _tag(x[0]) in HEADINGS or (not self._linked(x) and any(self._tells(k) for k in x[4]))
        return x[4] is None and len(x[7]) >= DIFFERENT and not self._linked(x)

    def _collect(self, x: list, links_stay: bool, all_stay: bool = False) -> None:
        if id(x) in self.furniture:
            return
        if x[0]:
            # a list of links is judged as a whole: one paragraph may well be a link
            if links_stay or any(x is r for r in self.regions) or not self._linked(x):
                for k in x[4]:
                    self._collect(k, links_stay, all_stay)
        elif all_stay or not (self._template(x) or (self._linked(x) and not links_stay)):
            self.content.add(id(x))

    def blocks(self, page: list) -> list[int]:
        """The numbers of a page's blocks that stand in content slots."""
        out: list[int] = []
        self._match(page, self.nodes, out)
        return sorted(out)

    def _match(self, page: list, wrapper: list, out: list[int]) -> None:
        for i, j in pairs(page, wrapper):
            x, w = page[i], wrapper[j]
            if x[0]:
                self._match(x[4], w[4], out)
            elif id(w) in self.content:
                out += x[8]


def text_of(page: str, wrapper: Wrapper) -> str:
    """A page's main text; a page that fills none of its host's content slots is judged alone."""
    tree, found = tree_of(page)
    chosen = wrapper.blocks(tree)
    if not chosen and found:
        chosen = Wrapper(tree).blocks(tree)
    return "\n".join(found[i].text for i in chosen)


def _plain(nodes: list) -> list:
    """A page's expression without the numbers of its blocks."""
    return [[*x[:4], _plain(x[4])] if x[0] else x[:8] for x in nodes]


def _dump(nodes: list) -> str:
    return json.dumps(nodes, separators=(",", ":"), ensure_ascii=False)


def _same(a: list, b: list) -> list:
    """Two expressions of one structure as one; in any order the result is the same."""
    return [[*x[:3], x[3] + y[3], _same(x[4], y[4])] if x[0] else merged(x, y, False) for x, y in zip(a, b, strict=True)]


def skeleton(nodes: list) -> str:
    """An expression's structure with its flags, without statistics: expressions of one skeleton merge slot by slot."""
    return "".join(f"{x[0] or '#'}{'?' * x[1]}{'+' * x[2]}" + (f"({skeleton(x[4])})" if x[0] else " ") for x in nodes)


def wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper (JSON): the expression inferred from all pages of each host.

    Pages of one structure add up first, in any order: per task, per salted group, per structure. Then the different
    structures of a host are aligned in the order of their skeletons, ALIGNED of them in a task, in parts that follow
    from hashes of the skeletons, and the parts likewise until one is left. So the result doesn't depend on how pages
    are partitioned, and no task has a whole host unless that is small.
    """
    schema = T.StructType([T.StructField("host", T.StringType()), T.StructField("skeleton", T.StringType()), T.StructField("wrapper", T.StringType())])

    def add(rows: Iterable[tuple[str, str, list]]) -> list[tuple[str, str, list]]:
        known: dict[tuple[str, str], list] = {}
        for host, name, tree in rows:
            old = known.get((host, name))
            known[host, name] = tree if old is None else _same(old, tree)
        return [(*k, w) for k, w in known.items()]

    def infer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            trees = ((host, _plain(tree_of(page.as_py() or "")[0])) for host, page in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True))
            out = add((host, skeleton(t), t) for host, t in trees)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.string()), pa.array([_dump(r[2]) for r in out], pa.string())], names=schema.names)

    def total(part: pd.DataFrame) -> pd.DataFrame:
        [(host, name, tree)] = add((h, s, json.loads(w)) for h, s, w in zip(part["host"], part["skeleton"], part["wrapper"], strict=True))
        return pd.DataFrame({"host": [host], "skeleton": [name], "wrapper": [_dump(tree)]})

    def align(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["skeleton", "wrapper"])
        both = None
        for w in part["wrapper"]:
            both = json.loads(w) if both is None else aligned(both, json.loads(w))
        return pd.DataFrame({"host": part["host"].iloc[:1], "skeleton": [skeleton(both)], "wrapper": [_dump(both)]})

    now = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(infer, schema)
    now = now.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(64))).groupBy("host", "skeleton", "salt").applyInPandas(total, schema).groupBy("host", "skeleton").applyInPandas(total, schema)
    now = settle(now, "structures")
    while True:
        hosts = settle(now.groupBy("host").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ALIGNED), "hosts")
        if hosts.isEmpty():
            break
        parts = F.coalesce(2 * F.ceil(F.col("n") / ALIGNED), F.lit(1))
        dealt = join_small(now, hosts, "host", "left", width="host").withColumn("part", F.pmod(F.xxhash64("skeleton"), parts))
        now = settle(dealt.groupBy("host", "part").applyInPandas(align, schema), "aligned")
    return now.groupBy("host").applyInPandas(align, schema).select("host", "wrapper")


def _chosen(wrapper: str, built: dict[str, Wrapper]) -> Wrapper:
    """The wrapper of a JSON text, built once while BUILT bytes of them last."""
    if wrapper not in built:
        if sum(map(len, built)) + len(wrapper) > BUILT:
            built.clear()
        built[wrapper] = Wrapper(json.loads(wrapper))
    return built[wrapper]


def _rows(batch: pa.RecordBatch, texts: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def _beside(own: DataFrame, known: DataFrame) -> DataFrame:
    """Pages sorted behind their host's wrapper, which is one row in each part of the host."""
    sizes = own.groupBy("host").agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0))).alias("bytes")).where(F.col("bytes") > PART)
    large = settle(sizes.select("host", F.ceil(F.col("bytes") / PART).cast("int").alias("parts")), "large")
    parts, none = F.coalesce("parts", F.lit(1)), F.lit(None)
    pages = join_small(own, large, "host", "left", width="host").select("host", F.pmod(F.xxhash64("page_id", "url", "html"), parts).cast("int").alias("part"), "page_id", "url", "html", none.cast("string").alias("wrapper"))
    heads = join_small(known, large, "host", "left", width="host").select("host", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), "wrapper")
    return pages.unionByName(heads, allowMissingColumns=True).repartition("host", "part").sortWithinPartitions("host", "part", F.col("wrapper").isNull())


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    A null or empty html has no text; a page without a host (null url) is one of the host ''; repeated pages give equal
    rows; a page of any length or depth is read whole; further columns, whatever their names, are not read. Pages are
    parsed twice, to infer and to extract. Wrappers go to every task once if they were counted and all of them fit SENT
    bytes; else pages are sorted behind the wrapper of their host, a large host in parts.
    """
    known = settle(wrappers(pages), "wrappers")
    own = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    schema = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    size = known.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host") + 64)).first()[0] or 0
    if size > SENT:

        def follow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = None
            for batch in batches:
                texts = []
                for page, wrapper in zip(batch.column("html"), batch.column("wrapper"), strict=True):
                    if wrapper.is_valid:
                        now = Wrapper(json.loads(wrapper.as_py()))
                    else:
                        texts.append(text_of(page.as_py() or "", now))
                yield _rows(batch.filter(batch.column("wrapper").is_null()), texts)

        return _beside(own, known).mapInArrow(follow, schema)
    held = pages.sparkSession.sparkContext.broadcast({r.host: r.wrapper for r in known.toLocalIterator()})

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built: dict[str, Wrapper] = {}
        for batch in batches:
            yield _rows(batch, [text_of(page.as_py() or "", _chosen(held.value[host], built)) for page, host in zip(batch.column("html"), batch.column("host").to_pylist(), strict=True)])

    return own.mapInArrow(run, schema)
