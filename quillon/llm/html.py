"""Main text of web pages by wrapper induction.

Outlines. Each page's DOM is reduced to an outline: a tree of the block elements that hold text, like siblings folded into one node,
named by tag and classes (digits in class names count as one sign). Pages of a host with equal outlines are aligned already.
Alignment. The host's most frequent outline (exact counts of its different pages) is its wrapper; every other outline of the host is
aligned with it once by simple tree matching: tags equal and order kept, by the greatest worth.
A matched node is the wrapper's slot; an unmatched one is a slot of its own path.
Template. Exactly and over all its pages, a host counts how many pages have a slot, how many have a text in it, and how many have
the same set of texts in it. A text that most pages with its slot have is template; a slot whose whole set of texts is the same on most pages is constant.
Content. What varies is content: the wrapper's region is its smallest element that holds most of the varying text (the article or main
element around it, if there is one). Blocks outside the region go, and so do template texts; inside an article only constant slots do
(a line that many articles share stays).

The counts are Spark aggregations by host, slot and hash, so a host with a third of all pages is no hot group; what a task holds is one page
or two outlines. A host's template has at most 1 / CONSTANT_SHARE texts for each of a slot's pages' texts; a row carries it as hashes. (A template for each
outline alone was tried: where most pages have an outline of their own, dealing it out took 5.4 times the input on disk, not 1.2.)

Elements that by their tag or role, or by a class or id all of whose words are such (site-footer, but not no-sidebar), are navigation,
header, footer, sidebar, notice, advert, form, script, style or comments go everywhere. Hosts with fewer than LEAST_PAGES different pages
have no wrapper, and pages with nothing in the region do not fit it: there the article or main element is the content if it holds at least half of
what is left; a smaller one is a teaser or an item, and all that is left is kept.

Defined results: null and empty pages have the empty text; null urls form one host; very long and very deep pages are handled whole;
broken markup, missing end tags and cut pages are closed at their end; repeated rows give repeated results and, like all pages of a host with
equal blocks, count as one page; pages that differ in some block are different pages, so what near copies share is template; an empty table
gives an empty one; other columns are kept, those that clash with text and n_chars are replaced.
"""

from __future__ import annotations

import collections
import html as entities
import re
import tempfile
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import persist

# Elements by role, and the words in classes, ids and roles that mark what is not content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "select", "object", "canvas"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "label"}
CLOSES_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead"}}
SCOPE = {"ul", "ol", "dl", "table", "div", "section", "article", "body", "html", "main", "blockquote"}
OUTSIDE = {"nav", "footer", "aside", "form", "button", "dialog", "menu"} | RAW
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = {
    "ad", "ads", "adv", "advert", "advertisement", "adverts", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "notification",
    "alert", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "aside", "footer", "masthead", "share", "sharing", "social", "comment", "comments", "disqus", "respond",
    "replies", "newsletter", "subscribe", "subscription", "signup", "related", "recommended", "popup", "modal", "overlay", "pagination", "pager", "login", "toolbar",
    "contentinfo", "complementary", "dialog", "disclaimer", "copyright", "search", "skip", "widget",
}
# Words that may stand beside such a word in one name.
BESIDE = set("area bar block bottom box btn button buttons col column container first form global icons inner item items last left link links list main message outer page panel posts primary reader right row secondary section site slot stories text thread to top unit user widgets wrap wrapper".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORDS = re.compile(r"[a-z]+")
DIGITS = re.compile(r"[0-9]+")
SPACE = re.compile(r"\s+")

#: The share of a slot's pages that makes a text template or a slot constant, the least different pages of a slot and of a wrapper,
#: and the share of the varying text that the region holds.
CONSTANT_SHARE, LEAST_PAGES, REGION_SHARE = 0.6, 4, 0.7


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: "Node | None"):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def names(self) -> list[list[str]]:
        """The words of each class, id and role."""
        return [WORDS.findall(x) for x in " ".join(self.attrs.get(k, "") for k in ("class", "id", "role")).lower().split()]

    def key(self) -> str:
        """Tag and classes; numbers in class names (of pages, posts, places) count as one sign."""
        classes = DIGITS.sub("0", self.attrs.get("class", "").lower()).split()
        return " ".join([self.tag, *sorted(set(classes))])


def parse(page: str) -> Node:
    """The DOM; children are nodes and strings (decoded)."""
    root = Node("#root", {}, None)
    here, at = root, 0
    for m in TOKEN.finditer(page):
        if m.start() < at:
            continue  # inside a raw element
        if m.start() > at:
            here.children.append(entities.unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            up = here
            while up is not root and up.tag != tag and not (up.tag in ("article", "main", "body") and tag not in ("body", "html", "main", "article")):
                up = up.parent
            if up.tag == tag:
                here = up.parent
            continue
        if tag in CLOSES_P or tag in CLOSES:
            ends = CLOSES.get(tag, {"p"}) | ({"p"} if tag in CLOSES_P else set())
            up = here
            while up is not root and up.tag not in ends and up.tag not in SCOPE:
                up = up.parent
            if up.tag in ends:
                here = up.parent
        attrs = {a[0].lower(): entities.unescape(a[1] or a[2] or a[3]) for a in ATTRIBUTE.findall(m[3])} if m[3].strip(" /\n\t") else {}
        node = Node(tag, attrs, here)
        here.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
        elif tag not in VOID and not m[3].endswith("/"):
            here = node
        elif tag not in VOID and tag not in INLINE:
            here = node if tag in ("p", "div", "section", "article") else here
    if at < len(page):
        here.children.append(entities.unescape(re.sub(r"<[a-zA-Z/!][^>]*\Z", "", page[at:])))
    return root


def _hash(*parts: str) -> int:
    return int.from_bytes(blake2b("\0".join(parts).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def text_hash(text: str) -> int:
    return _hash("text", text)


def set_hash(texts: set[int]) -> int:
    return _hash("set", *map(str, sorted(texts)))


def is_outside(node: Node, in_article: bool) -> bool:
    """Whether an element is, by what it says of itself, not content."""
    if node.tag in OUTSIDE or "hidden" in node.attrs or node.attrs.get("aria-hidden") == "true" or "display:none" in node.attrs.get("style", "").replace(" ", "").lower():
        return True
    if node.tag == "header" and not in_article:
        return True
    if node.tag in ("body", "html", "article", "main", "head", "#root"):
        return node.tag == "head"
    roles = ROLES if in_article else ROLES | {"header"}
    return any(words and not roles.isdisjoint(words) and all(w in roles or w in BESIDE for w in words) for words in node.names())


class Outline:
    """A page's tree of block elements, like siblings folded. parents: of each node, -1 at the root; keys: their tags and classes; article:
    whether a node is, or lies in, an article or main element."""

    def __init__(self, parents: list[int], keys: list[str], article: list[bool]):
        self.parents, self.keys, self.article = parents, keys, article

    def dump(self) -> str:
        return "\n".join(f"{p} {int(a)} {k}" for p, a, k in zip(self.parents, self.article, self.keys))

    @staticmethod
    def load(text: str) -> "Outline":
        rows = [x.split(" ", 2) for x in text.split("\n")]
        return Outline([int(x[0]) for x in rows], [x[2] for x in rows], [x[1] == "1" for x in rows])

    def slots(self) -> list[int]:
        """Each node's path, hashed: parents stand before their children."""
        out: list[int] = []
        for p, k in zip(self.parents, self.keys):
            out.append(_hash(str(out[p]) if p >= 0 else "", k))
        return out

    def children(self) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in self.parents]
        for i, p in enumerate(self.parents):
            if p >= 0:
                out[p].append(i)
        return out


def outlined(root: Node) -> tuple[Outline, list[tuple[str, int]]]:
    """The page's outline and its blocks (text, node) in page order, without what is outside, however deep they are."""
    parents, keys, article, below = [-1], [root.key()], [False], [{}]
    found: list[tuple[str, int]] = []

    def flush(parts: list[str], node: int):
        text = SPACE.sub(" ", "".join(parts)).strip()
        parts.clear()
        if text:
            found.append((text, node))

    stack = [(iter(root.children), 0, [], True)]  # the last: whether the element is a block and ends its text
    while stack:
        rest, node, parts, block = stack[-1]
        c = next(rest, None)
        if c is None:
            stack.pop()
            if block:
                flush(parts, node)
        elif isinstance(c, str):
            parts.append(c)
        elif c.tag in ("br", "td", "th", "wbr"):
            parts.append(" " if c.tag != "wbr" else "")
            stack.append((iter(c.children), node, parts, False))
        elif is_outside(c, article[node]):
            continue
        elif c.tag in INLINE:
            stack.append((iter(c.children), node, parts, False))
        else:
            flush(parts, node)
            key = c.key()
            if (child := below[node].get(key)) is None:
                child = below[node][key] = len(parents)
                parents.append(node)
                keys.append(key)
                article.append(article[node] or c.tag in ("article", "main") or c.attrs.get("role") == "main")
                below.append({})
            stack.append((iter(c.children), child, [], True))
    # Elements that hold no text are no part of the outline.
    used = [False] * len(parents)
    for _, node in found:
        used[node] = True
    for i in range(len(parents) - 1, 0, -1):
        if used[i]:
            used[parents[i]] = True
    new, at = [], 0
    for u in used:
        new.append(at if u else -1)
        at += u
    kept = [i for i, u in enumerate(used) if u]
    outline = Outline([new[parents[i]] if parents[i] >= 0 else -1 for i in kept], [keys[i] for i in kept], [article[i] for i in kept])
    return outline, [(text, new[node]) for text, node in found]


def affinity(a: str, b: str) -> float:
    """What matching two nodes of one tag is worth: 1, and up to 1 / 2 more for classes that they share."""
    x, y = set(a.split(" ")[1:]), set(b.split(" ")[1:])
    return 1 + 0.5 * (len(x & y) / len(x | y) if x or y else 1.0)


#: Worths are counted in steps of 1 / STEPS, so that sums are exact.
STEPS = 1 << 20
#: Bytes of the choices of one alignment that stay in memory; what is more lies in a temporary file.
CHOICES = 1 << 26


class Level:
    """The nodes of one depth of an outline, siblings side by side. first: the places of first siblings; shelf: for each node the number of its group of
    siblings, times more than any alignment is worth; parents, lasts: the places, in the level above, of nodes with children, and here of their last children."""

    def __init__(self, keys: list[str], above: list[int], most: int):
        parents = np.array(above, dtype=np.int64)
        first = np.ones(len(above), dtype=bool)
        first[1:] = parents[1:] != parents[:-1]
        self.first, self.shelf = np.flatnonzero(first), (np.cumsum(first) - 1) * most
        self.parents, self.lasts = parents[self.first], np.append(self.first[1:], len(above)) - 1
        self.tags, places = {}, collections.defaultdict(list)
        classes = [set(k.split(" ")[1:]) for k in keys]
        for tag in {k.split(" ", 1)[0] for k in keys}:
            self.tags[tag] = np.array([k.split(" ", 1)[0] == tag for k in keys])
        for i, names in enumerate(classes):
            for name in names or {""}:
                places[name].append(i)
        self.places = {name: np.array(at, dtype=np.int64) for name, at in places.items()}
        self.sizes = np.array([len(x) for x in classes], dtype=np.int64)

    def worth(self, key: str) -> np.ndarray:
        """The affinity() of a key to each node, in steps; 0 where tags differ."""
        tag, *names = key.split(" ")
        out = np.zeros(len(self.sizes), dtype=np.int64)
        if (same := self.tags.get(tag)) is None:
            return out
        out[same] = STEPS
        shared = [self.places[name] for name in set(names) or {""} if name in self.places]
        if shared:
            at, both = np.unique(np.concatenate(shared), return_counts=True)
            at, both = at[same[at]], both[same[at]]
            out[at] += np.rint(STEPS / 2 * (both / (len(set(names)) + self.sizes[at] - both) if names else 1.0)).astype(np.int64)
        return out

    def folded(self, table: np.ndarray, worth: np.ndarray) -> np.ndarray:
        """The next row of the tables of all siblings at once: one more node of the other outline, worth so much with each node here."""
        one = worth.copy()
        one[1:] += table[:-1]
        one[self.first] = worth[self.first]
        return np.maximum.accumulate(np.maximum(table, one) + self.shelf) - self.shelf


def tree_matching(a: Outline, b: Outline) -> dict[int, int]:
    """Simple tree matching: a mapping of nodes of a to nodes of b in which roots match, parents of matched nodes match, tags are equal and
    the order of siblings is kept, of the greatest worth, whatever the number of siblings. Nodes of a are taken depth first and each meets all nodes of b of its depth at once, so that memory grows with b;
    what was chosen is two bits a pair of nodes of one depth, for the way back."""
    if not a.keys or not b.keys or a.keys[0].split(" ", 1)[0] != b.keys[0].split(" ", 1)[0]:
        return {}
    ca, cb = a.children(), b.children()
    nodes, levels, place = [[0]], [Level([b.keys[0]], [0], 0)], {0: 0}
    most = 2 * STEPS * (min(len(a.keys), len(b.keys)) + 1)
    while below := [(k, c) for k, j in enumerate(nodes[-1]) for c in cb[j]]:
        nodes.append([c for _, c in below])
        place.update((c, k) for k, c in enumerate(nodes[-1]))
        levels.append(Level([b.keys[c] for c in nodes[-1]], [k for k, _ in below], most))
    wide = [-(-len(x) // 8) for x in nodes]
    offsets: dict[int, int] = {}
    with tempfile.SpooledTemporaryFile(CHOICES) as choices:
        # Of each open node of a: its children still to come, and the table of those before them with the children of every node of b of its depth.
        open_ = [(0, iter(ca[0]), np.zeros(len(nodes[1]) if len(nodes) > 1 else 0, dtype=np.int64))]
        while open_:
            i, rest, table = open_[-1]
            depth = len(open_)
            c = next(rest, None) if depth < len(nodes) else None
            if c is not None:
                open_.append((c, iter(ca[c]), np.zeros(len(nodes[depth + 1]) if depth + 1 < len(nodes) else 0, dtype=np.int64)))
                continue
            open_.pop()
            if not open_:
                break
            here = levels[depth - 1]
            worth = here.worth(a.keys[i])
            if ca[i] and depth < len(nodes):
                deeper = levels[depth]
                worth[deeper.parents] += np.where(worth[deeper.parents] > 0, table[deeper.lasts], 0)
            up, more, before = open_[-1]
            after = here.folded(before, worth)
            left = np.zeros(len(after), dtype=bool)
            left[1:] = after[1:] == after[:-1]
            left[here.first] = after[here.first] == 0
            offsets[i] = choices.tell()
            choices.write(np.packbits(after == before).tobytes() + np.packbits(left).tobytes())
            open_[-1] = (up, more, after)
        out, walk = {}, [(0, 0, 0)]
        while walk:
            i, j, depth = walk.pop()
            out[i] = j
            r, m, low = len(ca[i]), len(cb[j]), place[cb[j][0]] if cb[j] else 0
            while r and m:
                c, k = ca[i][r - 1], low // 8
                size = (low + m - 1) // 8 + 1 - k
                choices.seek(offsets[c] + k)
                skipped = choices.read(size)
                choices.seek(offsets[c] + wide[depth + 1] + k)
                behind, r = choices.read(size), r - 1
                while m:
                    byte, bit = divmod(low + m - 1 - 8 * k, 8)
                    if skipped[byte] & (128 >> bit):
                        break
                    m -= 1
                    if not behind[byte] & (128 >> bit):
                        walk.append((c, cb[j][m], depth + 1))
                        break
    return out


def align(outline: Outline, wrapper: Outline) -> tuple[list[int], list[int]]:
    """(slots, anchors) of the outline's nodes: a matched node's are the wrapper's slot; an unmatched one has its own path's slot, and
    its nearest matched ancestor's anchor (0: none)."""
    own, theirs = outline.slots(), wrapper.slots()
    matched = dict(enumerate(range(len(own)))) if own == theirs else tree_matching(outline, wrapper)
    slots, anchors = [], []
    for i, p in enumerate(outline.parents):
        slots.append(theirs[matched[i]] if i in matched else own[i])
        anchors.append(slots[i] if i in matched else anchors[p] if p >= 0 else 0)
    return slots, anchors


def region(wrapper: Outline, mass: dict[int, float]) -> set[int]:
    """The slots of the smallest element that holds most of the varying text (mass: slot -> characters): a block of text is no element by
    itself, and an article or main element around it is taken whole."""
    slots, below = wrapper.slots(), wrapper.children()
    total = [mass.get(s, 0.0) for s in slots]
    for i in range(len(slots) - 1, 0, -1):
        total[wrapper.parents[i]] += total[i]
    if not total or total[0] <= 0:
        return set()
    here = 0
    while (next_ := max(below[here], key=lambda c: total[c], default=None)) is not None and below[next_] and total[next_] >= REGION_SHARE * total[0]:
        here = next_
    while wrapper.parents[here] >= 0 and wrapper.article[wrapper.parents[here]]:
        here = wrapper.parents[here]
    if not wrapper.article[here] and next_ is not None and wrapper.article[next_] and total[next_] >= REGION_SHARE * total[0]:
        here = next_  # an article that holds its text itself
    inside = [False] * len(slots)
    inside[here] = True
    for i in range(here + 1, len(slots)):
        inside[i] = inside[wrapper.parents[i]]
    return {s for s, x in zip(slots, inside) if x}


class Wrapper:
    """A host's template (hashes of slot and text, and of slot and set of texts) and its region (slots)."""

    def __init__(self, known: set[int], area: set[int]):
        self.known, self.area = known, area


def content(found: list[tuple[str, int]], article: list[bool], slots: list[int], anchors: list[int], hashes: list[int], wrapper: Wrapper | None) -> list[str]:
    """The texts of a page's content blocks. slots, anchors and article are by node, hashes by block."""
    kept = list(zip(found, hashes))
    if wrapper is not None:
        sets: dict[int, set[int]] = {}
        for (_, node), h in kept:
            sets.setdefault(slots[node], set()).add(h)
        whole = {slot: set_hash(x) for slot, x in sets.items()}
        kept = [(b, h) for b, h in kept if _hash(str(slots[b[1]]), str(whole[slots[b[1]]] if article[b[1]] else h)) not in wrapper.known]
        area = [(b, h) for b, h in kept if anchors[b[1]] in wrapper.area]
        if area:
            kept = area
    inside = [text for (text, node), _ in kept if article[node]]
    every = [text for (text, _), _ in kept]
    return inside if 2 * sum(map(len, inside)) >= sum(map(len, every)) else every


def entries(found: list[tuple[str, int]], slots: list[int], hashes: list[int]) -> list[tuple[int, int]]:
    """(slot, hash) of each different text of a page's slots, of each slot's set of texts, and (slot, 0) of each slot."""
    sets: dict[int, set[int]] = {}
    for (_, node), h in zip(found, hashes):
        sets.setdefault(slots[node], set()).add(h)
    return [(slot, x) for slot, texts in sets.items() for x in (0, *texts, set_hash(texts))]


def main_text(page: str | None, wrapper: Wrapper | None = None, reference: Outline | None = None) -> str:
    """The page's content blocks, joined by one line feed; reference: the wrapper's outline."""
    outline, found = outlined(parse(page or ""))
    slots, anchors = align(outline, reference) if reference is not None else (outline.slots(), [0] * len(outline.parents))
    return "\n".join(content(found, outline.article, slots, anchors, [text_hash(t) for t, _ in found], wrapper))


def wrapper_of(pages: list[str]) -> tuple[Wrapper | None, Outline | None]:
    """The wrapper of one host's pages and its outline: what induce() counts in Spark, for a few pages at hand."""
    seen = {}
    for page in pages:
        outline, found = outlined(parse(page))
        if found:
            seen[tuple((t, outline.slots()[n]) for t, n in found)] = (outline, found)
    if len(seen) < LEAST_PAGES:
        return None, None
    frequent = collections.Counter(o.dump() for o, _ in seen.values())
    reference = Outline.load(max(frequent, key=lambda k: (frequent[k], _hash(k))))
    counts, mass = collections.Counter(), collections.Counter()
    placed = [(o, f, *align(o, reference), [text_hash(t) for t, _ in f]) for o, f in seen.values()]
    for _, found, slots, _, hashes in placed:
        counts.update(entries(found, slots, hashes))
    known = {_hash(str(slot), str(h)) for (slot, h), n in counts.items() if h and counts[slot, 0] >= LEAST_PAGES and n >= CONSTANT_SHARE * counts[slot, 0]}
    for _, found, slots, anchors, hashes in placed:
        for (text, node), h in zip(found, hashes):
            if _hash(str(slots[node]), str(h)) not in known:
                mass[anchors[node]] += len(text)
    return Wrapper(known, region(reference, mass)), reference


def _host(url) -> "F.Column":
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1)), F.lit(""))


OUTLINES = "__host string, __page bigint, __outline bigint, __shape string, __nodes array<int>, __hashes array<bigint>, __texts array<string>"


def _arrays(schema: T.StructType) -> list:
    from pyspark.sql.pandas.types import to_arrow_type

    return [to_arrow_type(f.dataType) for f in schema]


def _parsed(pages: DataFrame, keep: list[str], url: str, html: str) -> DataFrame:
    """The kept columns, and of every page its host, the hash of its blocks, its outline (hash; dumped once a task, else null) and its
    blocks: nodes, hashes and texts. Pages are parsed here and nowhere else."""
    source = pages.select(*[F.col(f"`{c}`") for c in keep], _host(F.col(f"`{url}`")).alias("__host"), F.col(f"`{html}`").cast("string").alias("__html"))
    schema = T.StructType([*[source.schema[c] for c in keep], *T.StructType.fromDDL(OUTLINES)])
    kinds = _arrays(schema)[len(keep) :]

    def run(batches):
        shown = set()
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part, rows = batch.slice(k, 500), []
                for host, page in zip(part.column(len(keep)).to_pylist(), part.column(len(keep) + 1).to_pylist()):
                    outline, found = outlined(parse(page)) if page else (None, [])
                    if not found:
                        rows.append((host, None, None, None, [], [], []))
                        continue
                    shape, paths = outline.dump(), outline.slots()
                    name = _hash("outline", shape)
                    rows.append((host, _hash(*(x for text, node in found for x in (str(paths[node]), text))), name, shape if name not in shown else None, [n for _, n in found], [text_hash(t) for t, _ in found], [t for t, _ in found]))
                    shown.add(name)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *[pa.array(c, t) for c, t in zip(zip(*rows), kinds)]], names=schema.names)

    return source.mapInArrow(run, schema)


def induce(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(maps, wrappers) of the pages of _parsed(): host, outline, slots, anchors and article of every outline of a host with a wrapper,
    and host, known and area of every wrapper."""
    rows = parsed.where("__page is not null").select(F.col("__host").alias("host"), F.col("__page").alias("page"), F.col("__outline").alias("outline"), F.col("__nodes").alias("nodes"), F.col("__hashes").alias("hashes"), F.transform("__texts", lambda t: F.length(t)).alias("sizes"))
    different = persist(rows.dropDuplicates(["host", "page"]), "different")
    shapes = persist(parsed.where("__shape is not null").groupBy(F.col("__outline").alias("outline")).agg(F.min("__shape").alias("shape")), "shapes")
    each = persist(different.groupBy("host", "outline").agg(F.count("*").alias("n")), "each")
    frequent = each.groupBy("host").agg(F.max_by("outline", F.struct("n", "outline")).alias("reference"), F.sum("n").alias("pages")).where(f"pages >= {LEAST_PAGES}").select("host", "reference")
    pairs = each.select("host", "outline").join(frequent, "host").join(shapes, "outline").join(shapes.select(F.col("outline").alias("reference"), F.col("shape").alias("ideal")), "reference")

    def aligned(batches):
        for batch in batches:
            out = []
            for host, outline, shape, ideal in zip(*(batch.column(i).to_pylist() for i in range(4))):
                tree = Outline.load(shape)
                out.append((host, outline, *align(tree, Outline.load(ideal)), tree.article))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.bool_())))], names=["host", "outline", "slots", "anchors", "article"])

    maps = persist(pairs.select("host", "outline", "shape", "ideal").mapInArrow(aligned, "host string, outline bigint, slots array<bigint>, anchors array<bigint>, article array<boolean>"), "maps")

    def counted(batches):
        """One row for each slot, text and set of a page: hash 0 for the slot; characters and anchor for texts."""
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                out = []
                for host, nodes, hashes, sizes, slots, anchors in zip(*(batch.column(i).slice(k, 500).to_pylist() for i in range(6))):
                    found = list(zip([""] * len(nodes), nodes))
                    size = {(slots[n], h): (z, anchors[n]) for n, h, z in zip(nodes, hashes, sizes)}
                    times = collections.Counter((slots[n], h) for n, h in zip(nodes, hashes))
                    out += [(host, slot, h, size.get((slot, h), (0, 0))[0] * times.get((slot, h), 0), size.get((slot, h), (0, 0))[1]) for slot, h in entries(found, slots, hashes)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))], names=["host", "slot", "hash", "chars", "anchor"])

    held = different.join(maps, ["host", "outline"]).select("host", "nodes", "hashes", "sizes", "slots", "anchors").mapInArrow(counted, "host string, slot bigint, hash bigint, chars bigint, anchor bigint")
    counts = persist(held.groupBy("host", "slot", "hash").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"), F.max("anchor").alias("anchor")), "slots")
    slots = counts.where("hash = 0").select("host", "slot", F.col("n").alias("pages"))
    judged = counts.where("hash <> 0").join(slots, ["host", "slot"]).withColumn("fixed", (F.col("pages") >= LEAST_PAGES) & (F.col("n") >= CONSTANT_SHARE * F.col("pages")))
    masses = judged.where("not fixed and chars > 0 and anchor <> 0").groupBy("host", "anchor").agg(F.sum("chars").alias("mass")).groupBy("host").agg(F.collect_list("anchor").alias("anchors"), F.collect_list("mass").alias("masses"))
    fixed = judged.where("fixed").groupBy("host").agg(F.collect_list("slot").alias("slots"), F.collect_list("hash").alias("hashes"))
    hosts = frequent.join(shapes.withColumnRenamed("outline", "reference"), "reference").join(masses, "host", "left").join(fixed, "host", "left").select("host", "shape", "anchors", "masses", "slots", "hashes")

    def wrapped(batches):
        for batch in batches:
            out = []
            for host, shape, anchors, masses_, slots_, hashes in zip(*(batch.column(i).to_pylist() for i in range(6))):
                area = region(Outline.load(shape), dict(zip(anchors or [], masses_ or [])))
                out.append((host, sorted(_hash(str(s), str(h)) for s, h in zip(slots_ or [], hashes or [])), sorted(area)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())))], names=["host", "known", "area"])

    return maps, persist(hosts.mapInArrow(wrapped, "host string, known array<bigint>, area array<bigint>"), "wrappers")


def extract(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Adds text and n_chars to the pages; the html column goes."""
    keep = [c for c in pages.columns if c not in ("text", "n_chars", html)]
    parsed = persist(_parsed(pages, keep, url, html), "parsed")
    maps, wrappers = induce(parsed)
    shapes = parsed.where("__shape is not null").groupBy(F.col("__outline").alias("outline")).agg(F.min("__shape").alias("shape"))
    source = parsed.join(maps, (parsed["__host"] == maps["host"]) & (parsed["__outline"] == maps["outline"]), "left").drop("host", "outline").join(wrappers, F.col("__host") == wrappers["host"], "left")
    source = source.join(shapes, (F.col("__outline") == shapes["outline"]) & F.col("slots").isNull(), "left")  # hosts without a wrapper
    source = source.select(*[F.col(f"`{c}`") for c in keep], "__nodes", "__hashes", "__texts", "slots", "anchors", "article", "shape", "known", "area")
    schema = T.StructType([*[source.schema[c] for c in keep], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part, texts = batch.slice(k, 500), []
                for nodes, hashes, blocks, slots, anchors, article, shape, known, area in zip(*(c.to_pylist() for c in part.columns[len(keep) :])):
                    wrapper = Wrapper(set(known or []), set(area or [])) if slots is not None else None
                    if wrapper is None and shape is not None:
                        article = Outline.load(shape).article
                    texts.append("\n".join(content(list(zip(blocks, nodes)), article, slots, anchors, hashes, wrapper)) if nodes else "")
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return source.mapInArrow(run, schema)
