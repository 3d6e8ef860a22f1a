"""Main-text extraction by wrapper induction over same-host pages.

Pages of one host with the same kind of skeleton (which landmarks and page parts they have) form a
cluster. Each is aligned with the cluster's reference tree by simple tree matching: the largest
order-preserving matching of two DOM trees whose matched nodes have equal labels and matched
parents. Reference nodes whose text stays the same on the aligned pages are template; where it varies
they are slots. The wrapper is the reference node that holds the varying text; content of a page is
what lies under the nodes that match it, without template (units of text, that is a paragraph, list
or table as a whole, else the text of one block, that say the same on nearly all aligned pages) and
without page parts that are never main text. Those are told by element and ARIA role; a class or id
names one outside landmarks, and inside them only if it can mean nothing else or if the node it stands
on is part of the template, that is, if it is matched on at least half of the aligned pages.
Near copies of the reference tell nothing about template and give no statistics. Statistics come
from all pages of a cluster, summed up per partition first.

Matchings depend on the shapes of trees alone, so each distinct pair of shapes is matched once per
worker. Sibling lists are cut at runs of equal shapes, and where more than ``CELLS`` pairs are left,
by position, so that wide pages take time in proportion to their width. Reference pages are
broadcast only while they are small in sum; else pages and wrappers meet in a shuffle join by cluster.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideweave.llm.common import materialize, table

#: Bytes of reference pages, in sum, up to which they are broadcast.
BROADCAST_BYTES = 32 << 20
#: Share of the varying text that a child must hold to be the wrapper in its parent's stead.
SHARE = 0.99
#: Share of the pages matched at a reference node that must carry its text for it to be template, and how many pages that takes.
CONSTANT, LEAST_PAGES = 0.9, 2
#: The same inside landmarks: how many pages it takes there.
LEAST_INSIDE = 5
#: Share of the reference's text that a page may repeat before it counts as a copy of it, and share of pages that confirm a named page part.
COPY, PART = 0.8, 0.5
MATCHES, DEPTH = 4096, 128
#: Pairs of siblings that one matching of two lists looks at, at most; more are cut into shorter lists first.
CELLS = 100_000
#: What tells kinds of pages of one host apart: which of these they have, and whether there are several articles.
SKELETON = "article|main|nav|aside|header|footer|form"

_RAW = "script|style|noscript|template|iframe|textarea|select|title"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<({_RAW})(?=[\s/>])[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)|[^>]*)>|([^<]+)|<",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|$)", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = _BLOCK - {"html", "body", "head", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
#: A start tag ends an open element of these, up to the nearest of the second set.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "option": ({"option"}, {"select"})}
_ROLE_TAGS = frozenset("nav footer aside form button dialog menu search head".split())
_ROLE_ATTRIBUTE = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
#: Words of a class or id that name a page part, if all its words are these or say nothing.
_PART_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar footer comment comments disqus reply replies cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended pagination pager search toolbar masthead topbar skip".split()
)
_PLAIN_PARTS = frozenset("area article articles bar block bottom box btn button buttons col column container content form global group heading icon icons inner item items left link links list main module outer page panel post posts primary right row secondary section site stories story text thread title top widget wrap wrapper".split())
#: Class names that mean a page part anywhere, and ids that do on a block that is no heading.
_CERTAIN = frozenset("ad ads advert adverts advertisement advertising sponsored comments commentlist comment-list comments-area cookie-notice cookie-banner newsletter breadcrumbs share-buttons social-share pagination navbar sidebar".split())
_CERTAIN_IDS = frozenset("comments disqus_thread respond".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LANDMARKS = frozenset(("article", "main"))
#: Blocks that are read as a whole: one varying item makes all of a list content.
_UNITS = frozenset("p ul ol dl table pre blockquote figure h1 h2 h3 h4 h5 h6".split())
_PLAIN_WORDS = re.compile(r"[a-z]+")


class Page:
    """Elements in document order with their labels, parents and ends, and the text between tags.

    Elements nested deeper than DEPTH are dissolved: their text belongs to the deepest kept one.
    """

    __slots__ = ("tags", "labels", "parents", "ends", "role", "inside", "hints", "texts", "shape", "deep")

    def __init__(self, source: str):
        self.tags, self.labels, self.parents, self.role, self.inside = ["#root"], ["#root"], [-1], [False], [False]
        self.hints: list[int] = []  # elements in landmarks whose class or id may name a page part
        self.ends: list[int] = [0]
        self.texts: list[tuple[int, str | None]] = []  # None: a block begins or ends here
        self.deep: dict[str, int] = defaultdict(int)  # start tags beyond DEPTH, which open no element
        opened = [0]
        add = self.texts.append
        for m in _TOKEN.finditer(source):
            _, close, tag, attributes, text = m.groups()
            if text is not None:
                add((opened[-1], entities.unescape(text) if "&" in text else text))
            elif tag is None:
                if m.group() == "<":
                    add((opened[-1], "<"))
            elif close:
                self._close(tag.lower(), opened)
            else:
                self._open(tag.lower(), attributes, opened)
        while opened:
            self.ends[opened.pop()] = len(self.tags)
        self.shape = None

    def _pop(self, opened: list[int], to: int) -> None:
        while len(opened) > to:
            at = opened.pop()
            self.ends[at] = len(self.tags)
            if self.tags[at] in _BLOCK:
                self.texts.append((opened[-1], None))

    def _close(self, tag: str, opened: list[int]) -> None:
        if tag == "br":
            self.texts.append((opened[-1], " "))
        if self.deep and self.deep[tag]:
            self.deep[tag] -= 1
            self.texts.append((opened[-1], None if tag in _BLOCK else ""))
            return
        for i in range(len(opened) - 1, 0, -1):
            own = self.tags[opened[i]]
            if own == tag:
                self._pop(opened, i)
                return
            if own in _BLOCK and tag not in _BLOCK:
                return  # an inline end tag does not end a block

    def _open(self, tag: str, attributes: str, opened: list[int]) -> None:
        if tag in _ENDS:
            ends, stop = _ENDS[tag]
            for i in range(len(opened) - 1, 0, -1):
                own = self.tags[opened[i]]
                if own in ends:
                    self._pop(opened, i)
                    break
                if own in stop:
                    break
        if tag in _CLOSES_P:
            for i in range(len(opened) - 1, 0, -1):
                own = self.tags[opened[i]]
                if own == "p":
                    self._pop(opened, i)
                    break
                if own in _BLOCK:
                    break
        if len(opened) > DEPTH and tag not in _VOID:
            self.deep[tag] += 1
            self.texts.append((opened[-1], None if tag in _BLOCK else ""))
            return
        at, inside, hint = len(self.tags), self.inside[opened[-1]], False
        label, role = tag, tag in _ROLE_TAGS
        if attributes and len(attributes) > 1:
            for name, *values in _ATTRIBUTE.findall(attributes):
                value, name = next((v for v in values if v), "").lower(), name.lower()
                if name in ("class", "id"):
                    tokens = value.split()
                    if name == "class":
                        label = f"{tag}.{value}"
                        role |= not _CERTAIN.isdisjoint(tokens)
                    if tag not in _HEADINGS:
                        role |= name == "id" and tag in _BLOCK and value in _CERTAIN_IDS
                        hint |= any(names_part(t) for t in tokens)
                elif name == "role":
                    role |= value in _ROLE_ATTRIBUTE
                elif name == "style":
                    role |= "display:none" in value.replace(" ", "")
                else:
                    role |= name == "hidden" or value == "true"
        if tag in ("html", "body", *_LANDMARKS):
            role = hint = False
        elif hint and inside and not role:
            self.hints.append(at)
        role |= hint and not inside
        self.tags.append(tag)
        self.labels.append(label)
        self.parents.append(opened[-1])
        self.role.append(role or self.role[opened[-1]] or tag == "header" and not inside)
        self.inside.append(inside or tag in _LANDMARKS)
        self.ends.append(at + 1)
        if tag in _BLOCK:
            self.texts.append((at, None))
        if tag in _VOID:
            self.texts.append((opened[-1], " " if tag == "br" else None if tag == "hr" else ""))
        else:
            opened.append(at)

    def own_text(self) -> dict[int, str]:
        out: dict[int, list[str]] = defaultdict(list)
        for at, text in self.texts:
            if text:
                out[at].append(text)
        return {at: " ".join("".join(x).split()) for at, x in out.items()}

    def text(self, wanted: list[int], gone: frozenset[int] = frozenset()) -> str:
        """Blocks under the wanted elements, without those of page parts and the own text of the elements gone."""
        under = bytearray(len(self.tags))
        for w in wanted:
            under[w : self.ends[w]] = b"\1" * (self.ends[w] - w)
        lines, line = [], []
        for at, text in self.texts:
            if text is None:
                if line:
                    lines.append(" ".join("".join(line).split()))
                    line = []
            elif under[at] and not self.role[at] and at not in gone:
                line.append(text)
        lines.append(" ".join("".join(line).split()))
        return "\n".join(x for x in lines if x)


@lru_cache(65536)
def names_part(token: str) -> bool:
    """Whether a class or id can name a page part: it has such a word, and no word beside it that says anything else."""
    words = _PLAIN_WORDS.findall(token)
    return not _PART_WORDS.isdisjoint(words) and all(w in _PART_WORDS or w in _PLAIN_PARTS for w in words)


class Matcher:
    """Simple tree matching; equal shapes are one number, and pairs of shapes are matched once."""

    def __init__(self):
        self.number: dict[tuple, int] = {}
        self.kinds: list[tuple[str, tuple[int, ...], int]] = []
        self.weights: dict[tuple[int, int], int] = {}
        self.matches: dict[tuple[int, int], dict[int, int]] = {}

    def shape(self, page: Page) -> int:
        """Numbers of all subtrees; page.shape[i] is that of element i."""
        children: list[list[int]] = [[] for _ in page.tags]
        out = [0] * len(page.tags)
        for i in range(len(page.tags) - 1, -1, -1):
            key = (page.labels[i], tuple(reversed(children[i])))
            at = self.number.get(key)
            if at is None:
                at = self.number[key] = len(self.kinds)
                self.kinds.append((*key, 1 + sum(self.kinds[c][2] for c in key[1])))
            out[i] = at
            if i:
                children[page.parents[i]].append(at)
        page.shape = out
        return out[0]

    def _trim(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, int]:
        """Lengths of the common prefix and suffix: equal shapes match whole, so no matching is larger without them."""
        n, head = min(len(a), len(b)), 0
        while head < n and a[head] == b[head]:
            head += 1
        tail = 0
        while tail < n - head and a[-1 - tail] == b[-1 - tail]:
            tail += 1
        return head, tail

    def _cut(self, a: tuple[int, ...], b: tuple[int, ...]) -> list[tuple[int, int, int, int]]:
        """Runs (a from, a to, b from, b to) in order that are matched on their own: all of both lists if they are short.

        Longer lists are cut at shapes that each of them has once, as far as these come in the same order,
        and what is still long by position.
        """
        if len(a) * len(b) <= CELLS:
            return [(0, len(a), 0, len(b))]
        once_a, once_b = ({x for x, n in Counter(side).items() if n == 1} for side in (a, b))
        at_b = {x: j for j, x in enumerate(b) if x in once_b}
        pairs = [(i, at_b[x]) for i, x in enumerate(a) if x in once_a and x in at_b]
        tops, back = [], []  # longest increasing run of positions in b
        for n, (_, j) in enumerate(pairs):
            k = bisect_left(tops, (j, -1))
            back.append(tops[k - 1][1] if k else -1)
            tops[k : k + 1] = [(j, n)]
        held, n = [], tops[-1][1] if tops else -1
        while n >= 0:
            held.append(pairs[n])
            n = back[n]
        runs, i, j = [], 0, 0
        for x, y in [*reversed(held), (len(a), len(b))]:
            n_a, n_b = x - i, y - j
            parts = max(1, -(-n_a * n_b * (len(held) + 1) // CELLS)) if n_a * n_b > CELLS // (len(held) + 1) else 1
            parts = min(parts, max(n_a, n_b, 1))
            runs += [(i + n_a * p // parts, i + n_a * (p + 1) // parts, j + n_b * p // parts, j + n_b * (p + 1) // parts) for p in range(parts)]
            if x < len(a):
                runs.append((x, x + 1, y, y + 1))
            i, j = x + 1, y + 1
        return [r for r in runs if r[0] < r[1] and r[2] < r[3]]

    def _table(self, a: tuple[int, ...], b: tuple[int, ...]) -> list[list[int]]:
        before = [0] * (len(b) + 1)
        rows = [before]
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(max(before[j + 1], row[j], before[j] + self.weight(x, y)))
            rows.append(row)
            before = row
        return rows

    def weight(self, x: int, y: int) -> int:
        """How many pairs of elements the largest matching of two shapes has."""
        if x == y:
            return self.kinds[x][2]
        key = (x, y)
        out = self.weights.get(key)
        if out is None:
            (label, a, _), (other, b, _) = self.kinds[x], self.kinds[y]
            if label != other:
                out = 0
            else:
                head, tail = self._trim(a, b)
                own, other = a[head : len(a) - tail], b[head : len(b) - tail]
                out = 1 + sum(self.kinds[c][2] for c in a[:head] + a[len(a) - tail :]) + sum(self._table(own[i:j], other[k:m])[-1][-1] for i, j, k, m in self._cut(own, other))
            self.weights[key] = out
        return out

    def match(self, page: Page, reference: Page) -> dict[int, int]:
        """Element of the reference for each matched element of the page."""
        key = (page.shape[0], reference.shape[0])
        out = self.matches.get(key)
        if out is None:
            if len(self.matches) > MATCHES:
                self.matches.clear()
            out = self.matches[key] = self._pairs(page, reference)
        return out

    def _pairs(self, page: Page, reference: Page) -> dict[int, int]:
        kids, others = _children(page), _children(reference)
        out, todo = {}, [(0, 0)]
        while todo:
            x, y = todo.pop()
            out[x] = y
            a, b = kids[x], others[y]
            sa, sb = tuple(page.shape[i] for i in a), tuple(reference.shape[i] for i in b)
            head, tail = self._trim(sa, sb)
            todo += zip(a[:head], b[:head])
            todo += zip(a[len(a) - tail :], b[len(b) - tail :])
            a, b, sa, sb = a[head : len(a) - tail], b[head : len(b) - tail], sa[head : len(a) - tail], sb[head : len(b) - tail]
            for s, e, t, f in self._cut(sa, sb):
                rows = self._table(sa[s:e], sb[t:f])
                i, j = e - s, f - t
                while i and j:
                    w = self.weight(sa[s + i - 1], sb[t + j - 1])
                    if w and rows[i][j] == rows[i - 1][j - 1] + w:
                        todo.append((a[s + i - 1], b[t + j - 1]))
                        i, j = i - 1, j - 1
                    elif rows[i][j] == rows[i - 1][j]:
                        i -= 1
                    else:
                        j -= 1
        return out


def _children(page: Page) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in page.tags]
    for i in range(1, len(page.tags)):
        out[page.parents[i]].append(i)
    return out


class Aligner:
    """Pages aligned with their host's reference, which is parsed once."""

    def __init__(self):
        self.matcher, self.held = Matcher(), {}

    def __call__(self, source: str, reference: str) -> tuple[Page, Page, dict[int, int]]:
        if len(self.held) > 256 or len(self.matcher.kinds) > 200_000 or len(self.matcher.weights) > 2_000_000:
            self.__init__()
        ref = self.held.get(reference)
        if ref is None:
            ref = self.held[reference] = Page(reference)
            self.matcher.shape(ref)
        page = Page(source)
        self.matcher.shape(page)
        return page, ref, self.matcher.match(page, ref)


def is_copy(page: Page, ref: Page, match: dict[int, int]) -> bool:
    """Whether the page repeats nearly all of the reference's text."""
    mine, back = page.own_text(), {y: x for x, y in match.items()}
    same = whole = 0
    for y, text in ref.own_text().items():
        if not ref.role[y]:
            whole += len(text)
            same += len(text) if y in back and mine.get(back[y]) == text else 0
    return same > COPY * whole


def varying_text(page: Page, ref: Page, match: dict[int, int]) -> dict[int, int]:
    """Characters outside boilerplate that differ from the reference, under its nearest matched element."""
    mine, theirs = page.own_text(), ref.own_text()
    out: dict[int, int] = defaultdict(int)
    for at, text in mine.items():
        if text and not page.role[at]:
            to = match.get(at)
            if to is None or theirs.get(to) != text:
                up = at
                while up not in match:
                    up = page.parents[up]
                out[match[up]] += len(text)
    return out


def unit(page: Page, at: int) -> int:
    """The element whose text is judged as one with that of element at: the outermost of _UNITS, else the nearest block."""
    near, outer = 0, 0
    while at > 0:
        near = near or (at if page.tags[at] in _BLOCK else 0)
        outer = at if page.tags[at] in _UNITS else outer
        at = page.parents[at]
    return outer or near


def units_seen(page: Page, ref: Page, match: dict[int, int]) -> tuple[set[int], set[int]]:
    """Units of the reference with text that the page matches, and those of them where its text is another."""
    mine, theirs = page.own_text(), ref.own_text()
    back = {y: x for x, y in match.items()}
    seen, changed = set(), set()
    for y, text in theirs.items():
        if text and not ref.role[y]:
            of = unit(ref, y)
            if of in back:
                seen.add(of)
                if y not in back or mine.get(back[y], "") != text:
                    changed.add(of)
    for x, text in mine.items():
        if text and not theirs.get(match.get(x, -1)):  # text where the reference has none
            of = match.get(unit(page, x))
            if of in seen:
                changed.add(of)
    return seen, changed


def template_units(ref: Page, node: int, seen: dict[int, int], changed: dict[int, int]) -> list[int]:
    """Units beside and under the wrapper node that say the same on nearly all pages; headings inside landmarks are no template."""
    top, out = max(ref.parents[node], 0), []
    for at, n in seen.items():
        if ref.inside[at] and (ref.tags[at] in _HEADINGS or ref.tags[at] in _LANDMARKS):
            continue
        if top <= at < ref.ends[top] and n >= (LEAST_INSIDE if ref.inside[at] else LEAST_PAGES) and n - changed.get(at, 0) >= CONSTANT * n:
            out.append(at)
    return sorted(out)


def wrapper_node(ref: Page, varying: dict[int, int], share: float = SHARE) -> int:
    """The reference element that holds the varying text: an article, or the deepest with nearly all of it (of a main part, only if that leads to an article)."""
    own = [0] * len(ref.tags)
    for at, n in (varying or {at: len(t) for at, t in ref.own_text().items() if not ref.role[at]}).items():
        own[at] += n
    leads = [t == "article" for t in ref.tags]
    for i in range(len(own) - 1, 0, -1):
        own[ref.parents[i]] += own[i]
        leads[ref.parents[i]] |= leads[i]
    kids, at, in_main = _children(ref), 0, False
    while ref.tags[at] != "article":
        in_main |= ref.tags[at] == "main"
        held = [c for c in kids[at] if own[c] > 0 and own[c] >= share * own[at] and ref.tags[c] in _BLOCK and ref.tags[c] != "p" and (leads[c] or not in_main)]
        if not held:
            break
        at = held[0]
    while in_main and at and ref.tags[at] not in _LANDMARKS:
        at = ref.parents[at]  # no article after all
    return at


def parts_matched(page: Page, ref: Page, match: dict[int, int]) -> list[int]:
    """The root, and the reference's elements that may be named page parts and are matched."""
    if not ref.hints:
        return [0]
    held = set(match.values())
    return [0, *(y for y in ref.hints if y in held)]


def template_elements(page: Page, ref: Page, match: dict[int, int], units: list[int], parts: list[int]) -> frozenset[int]:
    """Elements of the page that are template: confirmed page parts with all they hold, and units that say what the reference says."""
    out: set[int] = set()
    if parts and page.hints:
        named, labels = set(parts), {ref.labels[y] for y in parts}
        for x in page.hints:
            if match.get(x) in named or page.labels[x] in labels:
                out.update(range(x, page.ends[x]))
    if units:
        same = set(units) - units_seen(page, ref, match)[1]
        for x, y in match.items():
            if y in same:
                out.update(i for i in range(x, page.ends[x]) if unit(page, i) == x)
    return frozenset(out)


def content(page: Page, match: dict[int, int], node: int, template: frozenset[int] = frozenset()) -> str:
    """Text of what matches the wrapper node and of its like-labelled siblings; else of the page's own landmarks, else all. Without template."""
    wanted = [x for x, y in match.items() if y == node]
    if wanted and wanted[0]:
        like = (page.parents[wanted[0]], page.labels[wanted[0]])
        wanted = [i for i in range(1, len(page.tags)) if (page.parents[i], page.labels[i]) == like]
    if not wanted or not wanted[0]:
        wanted = [i for i, t in enumerate(page.tags) if t in _LANDMARKS and not page.role[i]] or [0]
    return page.text(wanted, template)


def alone(source: str) -> str:
    """Content of a page that belongs to no host: its wrapper is where its own text is."""
    page = Page(source)
    return content(page, {i: i for i in range(len(page.tags))}, wrapper_node(page, {}))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", *, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """id_col, url_col, text, n_chars for every row of pages.

    Null html counts as empty and gives the empty text. Pages without a host in their url, and those that
    are alone in their cluster, get their wrapper from their own text. Repeated rows give equal rows; no
    rows give no rows. Texts and pages of any length and width are taken whole; elements nested deeper
    than ``DEPTH`` are dissolved into their parents, with their text. Other columns of pages are not read.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col).cast("string"), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html"))
    found = F.transform(F.regexp_extract_all("html", F.lit(rf"(?i)<({SKELETON})(?=[\s>])"), 1), F.lower)
    kind = F.concat_ws(" ", F.array_sort(F.array_distinct(found)), F.when(F.size(F.filter(found, lambda t: t == "article")) > 1, "several").otherwise(""))
    hosted = rows.where("host <> ''").withColumn("host", F.concat_ws(" ", "host", kind))
    refs = materialize(hosted.where(F.length("html") > 0).groupBy("host").agg(F.min_by("html", F.struct(F.xxhash64("html"), F.length("html"))).alias("ref")), "references")
    small = (refs.agg(F.sum(F.octet_length("ref"))).first()[0] or 0) <= broadcast_bytes
    near = F.broadcast if small else (lambda df: df)
    counts = ["n", "seen", "changed", "matched"]

    def statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, sums = Aligner(), defaultdict(lambda: [0, 0, 0, 0])
        for b in batches:
            for h, source, ref in zip(*(b.column(c).to_pylist() for c in ("host", "html", "ref"))):
                if source != ref:  # equal pages tell nothing
                    aligned = align(source, ref)
                    if is_copy(*aligned):
                        continue
                    for at, n in varying_text(*aligned).items():
                        sums[h, at][0] += n
                    for i, elements in enumerate((*units_seen(*aligned), parts_matched(*aligned)), 1):
                        for at in elements:
                            sums[h, at][i] += 1
        keys = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), *(pa.array([x[i] for x in sums.values()], pa.int64()) for i in range(4))], ["host", "at", *counts])

    seen = hosted.join(near(refs), "host").select("host", "html", "ref").mapInArrow(statistics, "host string, at int, n long, seen long, changed long, matched long").groupBy("host", "at").agg(*[F.sum(c).alias(c) for c in counts])
    varying = seen.groupBy("host").agg(F.collect_list(F.struct("at", *counts)).alias("varying"))  # an entry per reference element at most

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, templates, parts = [], [], []
            for source, v in zip(b.column("ref").to_pylist(), b.column("varying").to_pylist()):
                ref, v = Page(source), {x["at"]: x for x in v or []}
                nodes.append(wrapper_node(ref, {at: x["n"] for at, x in v.items() if x["n"]}))
                templates.append(template_units(ref, nodes[-1], {at: x["seen"] for at, x in v.items() if x["seen"]}, {at: x["changed"] for at, x in v.items()}))
                pages = v[0]["matched"] if 0 in v else 0
                parts.append([at for at in ref.hints if pages >= LEAST_PAGES and at in v and v[at]["matched"] >= PART * pages])
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("ref"), pa.array(nodes, pa.int32()), *(pa.array(x, pa.list_(pa.int32())) for x in (templates, parts))], ["host", "ref", "node", "template", "parts"])

    wrappers = materialize(refs.join(varying, "host", "left").mapInArrow(chosen, "host string, ref string, node int, template array<int>, parts array<int>"), "wrappers")

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = Aligner()
        for b in batches:
            out = []
            for source, ref, node, units, parts in zip(*(b.column(c).to_pylist() for c in ("html", "ref", "node", "template", "parts"))):
                if ref is None:
                    out.append(alone(source))
                    continue
                page, held, match = align(source, ref)
                out.append(content(page, match, node, template_elements(page, held, match, units, parts)))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["id", "url", "text", "n_chars"])

    schema = T.StructType([rows.schema["id"], T.StructField("url", T.StringType()), T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    columns = ["id", "url", "html", "ref", "node", "template", "parts"]
    lone = rows.where("host = ''").select("id", "url", "html", *(F.lit(None).cast(wrappers.schema[c].dataType).alias(c) for c in columns[3:]))
    joined = hosted.join(near(wrappers), "host", "left").select(*columns)
    out = joined.mapInArrow(extracted, schema).unionAll(lone.mapInArrow(extracted, schema))
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
