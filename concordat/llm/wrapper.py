"""Main text of web pages by wrapper induction (operator 2).

Pages of a host are aligned with a reference tree, that of the host's most
usual shape, by simple tree matching: trees of block elements, in which runs of
like siblings count as one repeated slot.  A slot's text that half of the
host's pages with this slot share, two at least, is template; slots that vary
are content.  What is counted is the whole host, however many pages it has.

The main text is the region in which the host's varying text stands: going down
from the root, the slots that hold half of it or more.  Of these the deepest
article or main element is taken, if there is one, else the deepest slot with a
varying heading.  Template slots in it are left out, and so are the parts whose
element, class or id says that they are a menu, header, footer, sidebar,
notice, advert, form or comment: readers' comments and adverts vary as the
article does, so no alignment can tell them from it.

Copies of an article count once, as their text would look constant: pages with
the same longest text are one page to the counts.  Texts that half of the pages
share don't make pages equal, unless there is next to nothing beside them.

Scale: pages are parsed once, into a table of trees.  Only narrow rows (slot and
text hashes) are grouped; a host's wrapper is one narrow row, joined with its
pages by a join whose skewed side Spark splits.  A task holds one page at a
time and a bounded number of wrappers.
"""

from __future__ import annotations

import json
import re
from array import array
from collections import Counter
from collections.abc import Callable, Iterator, Set
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices

# Elements by what they are in HTML, and words of class and id names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var wbr br img".split())
SILENT = frozenset("script style noscript template iframe object svg canvas audio video select textarea button title".split())
#: Silent elements that a start or end of a block ends, where their own end tag was left out.
ENDED_BY_BLOCKS = frozenset("button title select".split())
SIDE = frozenset("nav footer aside form dialog menu".split())
SIDE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert".split())
SIDE_WORDS = frozenset(
    "nav navbar navigation menu sidebar side footer header masthead breadcrumb breadcrumbs cookie cookies consent gdpr notice banner ad ads advert advertisement adsense sponsor sponsored promo promotion share sharing social related recommended newsletter subscribe signup popup modal overlay comment comments reply replies respond disqus widget pagination pager toolbar login search form".split()
)
#: Words that also have other meanings: as a part of a longer name they say nothing.
WHOLE_NAMES = frozenset("side header notice banner share sharing social related recommended comment reply respond search form promotion overlay".split())
#: Elements of running text, whose names say nothing of where they stand.
RUNNING = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption li dd dt td th tr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: A start of one of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote body center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table ul".split())
LIKE_ENDS_LIKE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
#: What a node is, as bits.
IS_SIDE, IS_HEADING, IS_ARTICLE, IS_HEADER = 1, 2, 4, 8
#: Weights of pairs of shapes that are held at once, beside the last one; others are computed again.
SHAPE_PAIRS = 4_000_000
#: Cells of a table of matched children that are held at once.
CELLS = 4_000_000
#: Slots of a tree, and characters of an element's names, up to which what follows from them is kept for the next page.
KEPT_SLOTS, KEPT_NAMES = 512, 256


class Page:
    """The block elements of a page in page order: labels, parents and kinds by node, and the texts.

    ``texts`` are [node, text, in a link] in page order; a text of None marks
    where a child element begins.
    """

    def __init__(self, labels: list[str], parents: list[int], kinds: list[int], texts: list):
        self.labels, self.parents, self.kinds, self.texts = labels, parents, kinds, texts

    def dump(self) -> str:
        names = {n: i for i, n in enumerate(dict.fromkeys(self.labels))}
        return json.dumps([list(names), [names[n] for n in self.labels], self.parents, self.kinds, self.texts], ensure_ascii=False, separators=(",", ":"))

    @classmethod
    def load(cls, text: str) -> Page:
        names, labels, parents, kinds, texts = json.loads(text)
        return cls([names[i] for i in labels], parents, kinds, texts)


def _spaced(text: str) -> str:
    """The text with white space inside as one space, and none around."""
    return " ".join(text.split())


def _element(tag: str, names: str, role: str, hidden: bool) -> tuple[str, int]:
    """An element's label and what it is."""
    words = frozenset(re.split(r"[\s_-]+", names)) - {""}
    named = frozenset(names.split()) & SIDE_WORDS or words & (SIDE_WORDS - WHOLE_NAMES)
    side = tag in SIDE or role in SIDE_ROLES or hidden or bool(named and tag not in RUNNING)
    article = tag in ("article", "main") or role in ("article", "main") or bool(words & {"article", "post", "entry"})
    return " ".join([tag, *sorted(words)]), IS_SIDE * side | IS_HEADING * (tag in HEADINGS) | IS_ARTICLE * (article and not side) | IS_HEADER * (tag == "header")


_kept_element = lru_cache(maxsize=4096)(_element)


class _Builder(HTMLParser):
    """Builds a page; inline elements dissolve into their text."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.page = Page(["html"], [-1], [0], [])
        self.tags = ["html"]
        self.at = 0
        self.open: Counter[str] = Counter()
        self.silent: list[str] = []
        self.links = 0

    def updatepos(self, i, j):
        return j  # line numbers are not asked for

    def handle_starttag(self, tag, attrs):
        if self.silent and self.silent[-1] in ENDED_BY_BLOCKS and (tag in ENDS_P or tag == "body"):
            self.silent.clear()
        if tag in SILENT:
            self.silent.append(tag)
            return
        if self.silent or tag in ("html", "head", "body"):
            return
        if tag in INLINE:
            if tag == "a":
                self.links += 1
            elif tag == "br":
                self.page.texts.append([self.at, " ", False])
            return
        if tag in ENDS_P:
            self._close("p", stop=frozenset(("article", "section", "div", "td", "blockquote", "li", "aside", "footer", "nav", "main", "header", "form")))
        if tag in LIKE_ENDS_LIKE:
            self._close(tag, stop=LIKE_ENDS_LIKE[tag])
        if tag in VOID:
            return
        self._add(tag, dict(attrs))

    def _add(self, tag, attrs):
        names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}".lower()
        role = (attrs.get("role") or "").lower()
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "")
        label, kind = (_kept_element if len(tag) + len(names) + len(role) <= KEPT_NAMES else _element)(tag, names, role, hidden)
        page = self.page
        page.labels.append(label)
        page.parents.append(self.at)
        page.kinds.append(kind)
        self.tags.append(tag)
        self.at = len(page.labels) - 1
        self.open[tag] += 1
        page.texts.append([self.at, None, False])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.silent and tag in self.silent:
            while self.silent.pop() != tag:
                pass
            return
        if self.silent and self.silent[-1] in ENDED_BY_BLOCKS and tag in ENDS_P:
            self.silent.clear()
        if self.silent:
            return
        if tag == "a":
            self.links = max(0, self.links - 1)
        elif tag not in INLINE and tag not in ("html", "head", "body"):
            self._close(tag, stop=frozenset())

    def _close(self, tag, stop):
        if not self.open[tag]:
            return
        node, parents, tags = self.at, self.page.parents, self.tags
        while node and tags[node] != tag:
            if tags[node] in stop:
                return
            node = parents[node]
        if node:
            while self.at != parents[node]:
                self.open[tags[self.at]] -= 1
                self.at = parents[self.at]
            self.links = 0

    def handle_data(self, data):
        if not self.silent:
            self.page.texts.append([self.at, data, self.links > 0])


def parse(html: str) -> Page:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.page


class Slots:
    """A page's tree with runs of like siblings as one slot: labels, parents and children by slot, each parent before its children."""

    def __init__(self, labels: list[str], parents: list[int]):
        self.labels, self.parents = labels, parents
        self.children: list[list[int]] = [[] for _ in labels]
        for i, p in enumerate(parents):
            if p >= 0:
                self.children[p].append(i)
        self.shape = [0] * len(labels)
        for i in range(len(labels) - 1, -1, -1):
            below = array("Q", [self.shape[c] for c in self.children[i]]).tobytes()
            self.shape[i] = xxhash.xxh3_64_intdigest(labels[i].encode("utf-8", "surrogatepass") + b"\0" + below)

    @classmethod
    def of(cls, page: Page) -> tuple[Slots, list[int]]:
        """The slots, and each node's slot."""
        below: list[list[int]] = [[] for _ in page.labels]
        for i, p in enumerate(page.parents):
            if p >= 0:
                below[p].append(i)
        names = page.labels
        labels, parents, nodes, slot_of = [names[0]], [-1], [[0]], [0] * len(names)
        at = 0
        while at < len(nodes):
            last = None
            for n in nodes[at]:
                for c in below[n]:
                    if names[c] != last:
                        last = names[c]
                        labels.append(last)
                        parents.append(at)
                        nodes.append([])
                    nodes[-1].append(c)
                    slot_of[c] = len(nodes) - 1
            at += 1
        return (_kept_slots(tuple(labels), tuple(parents)) if len(labels) <= KEPT_SLOTS else cls(labels, parents)), slot_of

    def dump(self) -> str:
        return json.dumps([self.labels, self.parents], ensure_ascii=False, separators=(",", ":"))

    @classmethod
    def load(cls, text: str) -> Slots:
        return cls(*json.loads(text))


@lru_cache(maxsize=256)
def _kept_slots(labels: tuple[str, ...], parents: tuple[int, ...]) -> Slots:
    """Slots that pages of one form share; nobody changes them."""
    return Slots(list(labels), list(parents))


class Matching:
    """Simple tree matching of two trees of slots: the largest match that keeps parents and the order of siblings.

    Matched slots stand equally deep.  So the weights of a slot of ``a`` are
    those with the different shapes of ``b`` at its depth, found for all of
    these at once: the children of shapes with the slot's label lie behind one
    another in one row of running totals.
    """

    def __init__(self, a: Slots, b: Slots):
        self.a, self.b = a, b
        self.depth, depth_b = _depths(a), _depths(b)
        self.shapes: list[dict[int, int]] = [{} for _ in range(max(depth_b) + 1)]
        self.number = [0] * len(b.labels)
        self.like: dict[tuple[int, str], list[int]] = {}
        for j, d in enumerate(depth_b):
            shapes = self.shapes[d]
            if b.shape[j] not in shapes:
                shapes[b.shape[j]] = len(shapes)
                self.like.setdefault((d, b.labels[j]), []).append(j)
            self.number[j] = shapes[b.shape[j]]
        self.laid: dict[tuple[int, str], tuple] = {}
        # Known rows of weights; forgotten ones are computed again, so what is held bounds memory and nothing else.
        self.rows: dict[tuple[int, int], np.ndarray] = {}
        self.held = 0

    def _lay(self, depth: int, label: str) -> tuple:
        """Of the shapes of ``b`` with a label at a depth: their numbers, the children's numbers, where totals start, and where they end."""
        key = depth, label
        if key not in self.laid:
            heads = self.like[key]
            none = len(self.shapes[depth + 1]) if depth + 1 < len(self.shapes) else 0  # a weight of nothing, at the head of each shape's children
            inner = [x for j in heads for x in (none, *[self.number[c] for c in self.b.children[j]])]
            sizes = np.array([len(self.b.children[j]) + 1 for j in heads], np.int64)
            # Each shape's totals start above all that the one before it can reach.
            start = np.arange(len(heads), dtype=np.int64) * (len(self.a.labels) + 1)
            self.laid[key] = np.array([self.number[j] for j in heads], np.int64), np.array(inner, np.int64), start, np.repeat(start, sizes), np.cumsum(sizes) - 1
        return self.laid[key]

    def row(self, x: int) -> np.ndarray:
        """The sizes of the largest matches of the subtree of ``a`` at ``x`` with every shape of ``b`` at its depth, the roots matched; 0 for roots of different labels, and a 0 behind them."""
        a = self.a
        stack, got = [[x, 0, None]], None
        while stack:
            frame = stack[-1]
            i, k, totals = frame
            d, label = self.depth[i], a.labels[i]
            if got is None and k == 0:
                got = self.rows.get((d, a.shape[i]))
                if got is not None:
                    stack.pop()
                    if not stack:
                        break
                    continue
            if (d, label) not in self.like:
                stack.pop()
                got = np.zeros((len(self.shapes[d]) if d < len(self.shapes) else 0) + 1, np.int64)
                continue
            numbers, inner, start, fresh, ends = self._lay(d, label)
            if got is not None:
                if totals is None:
                    totals = frame[2] = fresh.copy()
                if len(got) > 1:
                    totals[1:] = np.maximum(totals[1:], totals[:-1] + got[inner[1:]])
                    np.maximum.accumulate(totals, out=totals)
                got = None
                k = frame[1] = k + 1
            if k < len(a.children[i]):
                stack.append([a.children[i][k], 0, None])
                continue
            stack.pop()
            got = np.zeros(len(self.shapes[d]) + 1, np.int64)
            got[numbers] = 1 if totals is None else 1 + totals[ends] - start
            if self.held + len(got) > SHAPE_PAIRS:
                self.rows.clear()
                self.held = 0
            self.rows[d, a.shape[i]] = got
            self.held += len(got)
        return got

    def weight(self, x: int, y: int) -> int:
        """The size of the largest match of two subtrees, equally deep, whose roots are matched; 0 for roots of different labels."""
        return int(self.row(x)[self.number[y]])

    def pairs(self) -> list[tuple[int, int]]:
        """The matched slots (of a, of b), the roots first."""
        a, b = self.a, self.b
        if a.labels[0] != b.labels[0]:
            return []
        out, stack = [], [(0, 0)]
        while stack:
            i, j = stack.pop()
            out.append((i, j))
            left, right = a.children[i], b.children[j]
            if a.shape[i] == b.shape[j]:
                stack += zip(left, right, strict=True)
            elif left and right:
                columns = np.array([self.number[c] for c in right], np.int64)
                stack += [(left[x], right[y]) for x, y in _ordered(left, columns, self.row)]
        return out


def _depths(slots: Slots) -> list[int]:
    out = [0] * len(slots.labels)
    for i, p in enumerate(slots.parents):
        out[i] = out[p] + 1 if p >= 0 else 0
    return out


def _last_row(rows: list[int], columns: np.ndarray, weights: Callable[[int], np.ndarray]) -> np.ndarray:
    """Best totals of all rows with each number of columns."""
    best = np.zeros(len(columns) + 1, np.int64)
    for r in rows:
        best[1:] = np.maximum(best[1:], best[:-1] + weights(r)[columns])
        np.maximum.accumulate(best, out=best)
    return best


def _ordered(rows: list[int], columns: np.ndarray, weights: Callable[[int], np.ndarray]) -> list[tuple[int, int]]:
    """The pairs of a heaviest match in order; large tables are split in halves, so that memory is bounded."""
    out, stack = [], [(0, len(rows), 0, len(columns))]
    while stack:
        top, bottom, first, last = stack.pop()
        n, m = bottom - top, last - first
        if not n or not m:
            continue
        own, other = rows[top:bottom], columns[first:last]
        if n > 1 and n * m > CELLS:
            half = n // 2
            ahead, behind = _last_row(own[:half], other, weights), _last_row(own[half:][::-1], other[::-1], weights)[::-1]
            cut = int((ahead + behind).argmax())
            stack += [(top, top + half, first, first + cut), (top + half, bottom, first + cut, last)]
            continue
        best = np.zeros((n + 1, m + 1), np.int64)
        for k, r in enumerate(own):
            best[k + 1, 1:] = np.maximum(best[k, 1:], best[k, :-1] + weights(r)[other])
            np.maximum.accumulate(best[k + 1], out=best[k + 1])
        i, j = n, m
        while i and j:
            if best[i, j] == best[i - 1, j]:
                i -= 1
            elif best[i, j] == best[i, j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                out.append((top + i, first + j))
    return out


def _under(kinds: list[int], parents: list[int], bit: int) -> list[bool]:
    """For each node, whether it or a node above it is of the kind."""
    out = [False] * len(kinds)
    for i, p in enumerate(parents):
        out[i] = bool(kinds[i] & bit) or (p >= 0 and out[p])
    return out


def _side(page: Page) -> list[bool]:
    """Whether each node is in a side part; a side part that isn't one by its element doesn't hold an article."""
    holds = [bool(k & IS_ARTICLE) for k in page.kinds]
    for i in range(len(holds) - 1, 0, -1):
        if holds[i]:
            holds[page.parents[i]] = True
    own = [k & ~IS_SIDE if holds[i] and page.labels[i].split(" ")[0] not in SIDE and not {"comment", "comments", "reply", "replies", "related"} & set(page.labels[i].split(" ")) else k for i, k in enumerate(page.kinds)]
    return _under(own, page.parents, IS_SIDE)


def _placed(slots: Slots, reference: Slots | None) -> tuple[list[int], dict[int, int]]:
    """Each slot's key, that of its match or, for one that matches none of the reference, one of its path; and the reference's slots with their matches."""
    matched = {} if reference is None else dict(Matching(reference, slots).pairs())
    at = {j: i for i, j in matched.items()}
    keys, path = [], []
    for i, p in enumerate(slots.parents):
        path.append(xxhash.xxh3_64_intdigest(slots.labels[i].encode("utf-8", "surrogatepass"), path[p] if p >= 0 else 0))
        keys.append(at[i] if i in at else -(path[i] >> 2) - 1)
    return keys, matched


class Aligned:
    """A page laid over its host's reference: keys, texts and weights of its slots."""

    def __init__(self, page: Page, reference: Slots | None, cache: dict):
        self.page = page
        self.slots, self.slot_of = Slots.of(page)
        self.side = _side(page)
        n = len(self.slots.labels)
        key = reference and reference.shape[0], self.slots.shape[0]
        if key not in cache:
            if len(cache) > 500:
                cache.clear()
            cache[key] = _placed(self.slots, reference)
        self.keys, self.matched = cache[key]
        texts: list[list[str]] = [[] for _ in range(n)]
        self.weight = [0] * n
        last = None
        for node, text, linked in page.texts:
            if text is not None and not text.isspace():
                s = self.slot_of[node]
                texts[s].append(text if last == node else f"\n{text}")
                if not linked and not self.side[node]:
                    self.weight[s] += len(text.strip())
            last = node
        self.texts = [_spaced("".join(t)) if t else "" for t in texts]
        self.hashes = [xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) - 2**63 if t else None for t in self.texts]

    def whole(self) -> int:
        """A hash of all texts."""
        return xxhash.xxh3_64_intdigest(np.array([h or 0 for h in self.hashes], np.int64).tobytes()) - 2**63


def region(slots: Slots, weight: list[int], article: list[bool], heading: list[bool]) -> int | None:
    """The slot that holds the varying text of ``weight`` by slot."""
    total, titled = list(weight), [h and w > 0 for h, w in zip(heading, weight, strict=True)]
    for i in range(len(total) - 1, 0, -1):
        p = slots.parents[i]
        total[p] += total[i]
        titled[p] = titled[p] or titled[i]
    if not total or not total[0]:
        return None
    chain = [0]
    while True:
        heavy = [c for c in slots.children[chain[-1]] if 2 * total[c] >= total[0]]
        if not heavy:
            break
        chain.append(heavy[0])
    for i in reversed(chain):
        if article[i]:
            return i
    inner = [i for i in chain if 2 * weight[i] < total[i]] or chain[:1]
    return next((i for i in reversed(inner) if titled[i]), inner[-1])


def _words(slots: Slots, names: frozenset | set) -> list[bool]:
    return [bool(names & set(label.split(" "))) for label in slots.labels]


_ARTICLES = {"article", "main", "post", "entry"}


class Wrapper:
    """What was induced for a host: the reference, its template texts and its region."""

    def __init__(self, reference: Slots, template: set[tuple[int, int]], weight: dict[int, int]):
        self.reference, self.template = reference, template
        side = _words(reference, SIDE | SIDE_WORDS)
        self.region = region(reference, [weight.get(i, 0) for i in range(len(reference.labels))], [a and not s for a, s in zip(_words(reference, _ARTICLES), side, strict=True)], _words(reference, HEADINGS))


def main_text(found: Aligned, wrapper: Wrapper | None, rare: Set[tuple[int, int]] = frozenset()) -> str:
    """The main text of an aligned page; without a wrapper, by the page alone.  ``rare`` is template that its wrapper doesn't hold."""
    page, slots = found.page, found.slots
    template = [wrapper is not None and h is not None and ((k, h) in wrapper.template or (k, h) in rare) for k, h in zip(found.keys, found.hashes, strict=True)]
    own = [0 if t else w for t, w in zip(template, found.weight, strict=True)]
    inside = list(own)
    for i in range(len(inside) - 1, 0, -1):
        inside[slots.parents[i]] += inside[i]
    place = found.matched.get(wrapper.region) if wrapper is not None and wrapper.region is not None else None
    if place is None or 5 * inside[place] < inside[0]:
        # This page's text stands elsewhere than that of its host.
        place = region(slots, own, [a and not s for a, s in zip(_words(slots, _ARTICLES), _words(slots, SIDE | SIDE_WORDS), strict=True)], _words(slots, HEADINGS))
    if place is None:
        return ""
    tops = [n for n in range(len(page.labels)) if found.slot_of[n] == place]
    article = bool(page.kinds[tops[0]] & IS_ARTICLE)
    blocks = [_blocks(found, top, template, article) for top in tops]
    if article and len(blocks) > 1:
        # Of several articles the longest is the main one.
        blocks = [max(blocks, key=lambda b: sum(map(len, b)))]
    return "\n".join(t for b in blocks for t in b)


def _blocks(found: Aligned, top: int, template: list[bool], article: bool) -> list[str]:
    """The content blocks under a node in page order."""
    page = found.page
    skip: dict[int, bool] = {top: False}
    out: list[str] = []
    text, linked, total, last = [], 0, 0, None

    def flush():
        nonlocal text, linked, total
        joined = _spaced("".join(text))
        # Outside of an article, blocks that are mostly links are menus.
        if joined and (article or 2 * linked < total):
            out.append(joined)
        text, linked, total = [], 0, 0

    for node in range(top + 1, len(page.labels)):
        p = page.parents[node]
        if p not in skip:
            break  # nodes are in page order: the first one outside ends the subtree
        kind = page.kinds[node]
        under_header = page.kinds[p] & IS_HEADER and p != top
        skip[node] = skip[p] or bool(kind & IS_SIDE) or (article and page.labels[node].split(" ")[0] == "article") or bool(under_header and not (article and kind & IS_HEADING)) or bool(kind & IS_HEADER and not article)
    for node, piece, in_link in page.texts:
        if node not in skip:
            if last is not None:
                flush()
                last = None
            continue
        if node != last or piece is None:
            flush()
            last = node
        if piece is not None and not skip[node] and not template[found.slot_of[node]] and not (page.kinds[node] & IS_HEADER and node != top):
            text.append(piece)
            n = len(piece.strip())
            total += n
            linked += n * in_link
    flush()
    return out


_TREE = "page_id long, url string, host string, shape long, page long, skeleton string, tree string"
_SLOT = "host string, page long, slot long, text long, weight long"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices([batch], rows=64, column="html"):
            rows = []
            for html in part.column("html").to_pylist():
                found = Aligned(parse(html), None, {})
                rows.append((found.slots.shape[0] - 2**63, found.whole(), found.slots.dump(), found.page.dump()))
            shape, whole, skeleton, tree = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), part.column("host"), pa.array(shape, pa.int64()), pa.array(whole, pa.int64()), pa.array(skeleton, pa.string()), pa.array(tree, pa.string())],
                [c.split()[0] for c in _TREE.split(", ")],
            )


def _slot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    references, cache = {}, {}
    for batch in batches:
        for part in slices([batch], rows=64, column="tree"):
            rows = []
            for host, whole, skeleton, tree in zip(*[part.column(c).to_pylist() for c in ("host", "page", "reference", "tree")], strict=True):
                if skeleton not in references:
                    if len(references) > 500:
                        references.clear()
                    references[skeleton] = Slots.load(skeleton)
                found = Aligned(Page.load(tree), references[skeleton], cache)
                rows += [(host, whole, k, h, w) for k, h, w in zip(found.keys, found.hashes, found.weight, strict=True) if h is not None]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], [c.split()[0] for c in _SLOT.split(", ")])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    wrappers: dict[tuple, Wrapper] = {}
    cache: dict = {}
    for batch in batches:
        for part in slices([batch], rows=64, column="tree"):
            texts = []
            for host, skeleton, template, weight, rare, tree in zip(*[part.column(c).to_pylist() for c in ("host", "reference", "template", "weights", "rare", "tree")], strict=True):
                if host not in wrappers:
                    if len(wrappers) > 100:
                        wrappers.clear()
                    wrappers[host] = Wrapper(Slots.load(skeleton), {(t["slot"], t["text"]) for t in template or ()}, {w["slot"]: w["weight"] for w in weight or ()})
                wrapper = wrappers[host]
                texts.append(main_text(Aligned(Page.load(tree), wrapper.reference, cache), wrapper, {(t["slot"], t["text"]) for t in rare or ()}))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def _constant(counted: DataFrame) -> DataFrame:
    """Of (host, slot, text, n) the texts that two pages and half of those with the slot share; adds ``of``, the slot's pages."""
    of = counted.groupBy("host", "slot").agg(F.sum("n").alias("of"))
    # At most two texts of a slot can be shared by half of its pages.
    return counted.where("n > 1").join(of, ["host", "slot"]).where("2 * n >= of")


def extract(pages: DataFrame, induce: bool = True) -> DataFrame:
    """(page_id, url, text) of the main text of every row of ``pages`` (page_id, url, html).

    Blocks of text are joined in page order by one line feed, with white space
    inside a block turned into one space.  A null or empty html, or one
    without main text, gives "".  A null url, or one without a host, belongs
    to a host of its own.  page_id is passed through, nulls and repeats too;
    other columns are not looked at.  Without ``induce`` every page stands
    alone, as on a host of one page.

    Trees of all sizes are matched by the same rule; no page is cut.
    """
    scratch = Scratch(pages.sparkSession, "wrapper")
    host = F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), (host if induce else F.uuid()).alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    trees = scratch.save(narrow.mapInArrow(_parsed, _TREE), "trees")

    shapes = trees.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.min("skeleton").alias("skeleton"))
    references = scratch.save(shapes.groupBy("host").agg(F.max_by("skeleton", F.struct("n", "shape")).alias("reference")), "references")
    held = trees.join(references, "host")
    slots = held.select("host", "page", "reference", "tree").mapInArrow(_slot_rows, _SLOT)
    # Slots that match none of the reference may have several texts on a page.
    loose = F.collect_set(F.when(F.col("slot") < 0, F.col("text"))).alias("texts")
    rows = scratch.save(slots.groupBy("host", "page", "slot").agg(F.min(F.struct("text", "weight")).alias("s"), loose).select("host", "page", "slot", "s.*", "texts"), "slots")
    # Which pages are copies: by their longest text, of those that aren't shared all over the host if they make up a tenth of the page.
    shared = _constant(rows.groupBy("host", "slot", "text").agg(F.count(F.lit(1)).alias("n"))).select("host", "slot", "text", F.lit(True).alias("shared"))
    flagged = rows.join(shared, ["host", "slot", "text"], "left").withColumn("own", F.when(F.col("shared").isNull(), F.struct("weight", "text")))
    judged = flagged.groupBy("host", "page").agg(F.max("own").alias("own"), F.max(F.struct("weight", "text")).alias("any"), F.sum("weight").alias("all"))
    articles = judged.select("host", "page", F.when((F.col("own.weight") > 0) & (10 * F.col("own.weight") >= F.col("all")), F.col("own.text")).otherwise(F.col("any.text")).alias("article"))
    once = rows.join(articles, ["host", "page"]).groupBy("host", "article", "slot").agg(F.min(F.struct("text", "weight")).alias("s"))
    counted = scratch.save(once.groupBy("host", "slot", "s.text").agg(F.count(F.lit(1)).alias("n"), F.sum("s.weight").alias("weight")), "texts")
    constant = scratch.save(_constant(counted), "constant")
    # Template of slots that stand on less than a hundredth of the pages goes to these pages alone, which bounds a wrapper.
    pages_of = once.groupBy("host").agg(F.count_distinct("article").alias("pages"))
    placed = constant.join(pages_of, "host").withColumn("wide", F.expr("slot >= 0 or 100 * of >= pages"))
    template = placed.where("wide").groupBy("host").agg(F.collect_list(F.struct("slot", "text")).alias("template"))
    held_by = rows.where("slot < 0").select("host", "page", "slot", F.explode("texts").alias("text"))
    rare = held_by.join(placed.where("not wide").select("host", "slot", "text"), ["host", "slot", "text"], "left_semi").groupBy("host", "page").agg(F.collect_list(F.struct("slot", "text")).alias("rare"))
    gone = constant.groupBy("host", "slot").agg(F.sum("weight").alias("gone"))
    varying = counted.where("slot >= 0").groupBy("host", "slot").agg(F.sum("weight").alias("all"))
    weights = varying.join(gone, ["host", "slot"], "left").select("host", "slot", (F.col("all") - F.coalesce("gone", F.lit(0))).alias("weight")).where("weight > 0").groupBy("host").agg(F.collect_list(F.struct("slot", "weight")).alias("weights"))
    wrappers = scratch.save(references.join(template, "host", "left").join(weights, "host", "left"), "wrappers")
    found = trees.select("page_id", "url", "host", "page", "tree").join(wrappers, "host").join(scratch.save(rare, "rare"), ["host", "page"], "left")
    return found.select("page_id", "url", "host", "reference", "template", "weights", "rare", "tree").mapInArrow(_texts, "page_id long, url string, text string")
