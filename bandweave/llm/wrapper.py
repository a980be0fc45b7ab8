"""HTML extraction: wrapper induction over the pages of a host, and the text of the slots that hold its articles.

Each page becomes a tree of its block elements, labelled by tag, class and id. All different pages of a host and layout (the
containers they are made of; layouts of too few pages count as one) are aligned with one of them, the exemplar, by simple
tree matching. Of each node it is then known on how many pages it is, on how many with the exemplar's text, and how much
text and how much of it in links its slot holds. That makes the wrapper (`wrapped`): going down from the root, the content is
the smallest container that holds nearly all of the prose (text that varies and isn't in links). What lies outside it is
template: menus, adverts, footers, whatever they are called. In it, nodes whose text is constant and slots of links
are template too. Every page is aligned with the wrapper again, and its blocks in content slots are its text.

Names and kinds of elements have the last word alone: within the content, what is marked as navigation, form, advert,
reader comment and the like isn't text either (names with other meanings count where an element is mostly links). Pages
without a wrapper (of hosts with fewer than LEAST_PAGES different pages or without a host, or pages on which the content
slot isn't found) are judged by those marks, content elements and link density.

Trees of all pages count: those of a host meet in sums per node, dealt out by host and salt, so that one host may have any
share of the pages. Copies of one page count once. Wrappers are broadcast while they are few and small, and joined by host
and salt beyond that. Null and empty html give an empty text. Whole pages are read, whatever their length or depth; repeated rows are rows like others.
Columns other than page_id, url and html aren't read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandweave.llm.common import arrow_pass, discard, salt_copies, salted, written

LEAST_PAGES, SHARE, SALTS = 5, 0.9, 16
#: The content holds at least so much of the prose around it; a slot with so much of its text in links is template.
DOMINANT, LINKS = 0.7, 0.8
#: A container beside the content that holds less than this of the prose is template.
MINOR = 0.1
#: Wrappers of up to so many nodes together are broadcast.
FEW_NODES = 500_000
#: So many cells of a matching table are kept at once; larger ones are halved (Hirschberg), with the same result.
CELLS = 4_000_000

# Kinds of HTML elements, and names of page parts that aren't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe title xmp noembed noframes".split())
UNSEEN = RAW | frozenset("head select option button svg canvas object audio video map math".split())
BLOCK = frozenset("html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
NOT_ARTICLE = frozenset("nav aside footer form menu dialog search".split())
NOT_ARTICLE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar status".split())
NOT_ARTICLE_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsors sponsored promo promos banner banners sidebar
    sidebars nav navbar navigation menu menus breadcrumb breadcrumbs footer masthead comment comments commentlist disqus
    cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login
    share sharing toolbar pagination pager""".split()
)
#: Names that parts of an article have as well: within one they count where an element is mostly links.
MAYBE_NAMES = frozenset("reply replies respond discussion notice notices alert alerts promotion social related recommended recommendations widget widgets skip hidden".split())
CONTENT_NAMES = frozenset("article content post entry story main articlebody postcontent entrycontent maincontent".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "summary", "legend"}
STOPS = frozenset("ul ol dl table div article section main aside nav footer header form body html blockquote".split())

MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)", re.S)
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
BARE = re.compile(r"=\s*[^\s\"']+\Z")  # a value without quotes, to which a slash at the end belongs
JUNK = re.compile(r"<[/a-zA-Z][^<>]*(?:>|\Z)")
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=/\"'>]+)")
CAMEL = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


class Node:
    __slots__ = ("tag", "attrs", "parent", "parts")

    def __init__(self, tag: str, attrs: str, parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.parts: list[Node | str] = []

    def given(self) -> dict[str, str]:
        return given(self.attrs)


@lru_cache(4096)
def given(attrs: str) -> dict[str, str]:
    return {(a or e).lower(): unescape(b or c or d or "") for a, b, c, d, e in ATTRIBUTE.findall(attrs)} if attrs.strip() else {}


def parsed(html: str) -> Node:
    """The tree of a page; what is left open is closed as browsers do, in the main. Text is kept as it is written."""
    root = Node("html", "", None)
    at, node, end, last = 0, root, len(html), html.rfind(">")
    opened: dict[str, int] = {"html": 1}  # elements of each tag from the root to the node
    body = False

    def left(to: Node) -> Node:
        up = node
        while up is not to:
            opened[up.tag] -= 1
            up = up.parent  # type: ignore[assignment]
        return to

    while at < end:
        if html[at] != "<":
            stop = html.find("<", at)
            stop = end if stop < 0 else stop
            node.parts.append(html[at:stop])
            at = stop
            continue
        if m := MARKUP.match(html, at):
            at = m.end()
            continue
        m = TAG.match(html, at) if at < last else None
        if m is None:
            if m := JUNK.match(html, at):
                at = m.end()
            else:
                node.parts.append("<")
                at += 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:
            if opened.get(tag):
                up = node
                while up.tag != tag and not (tag not in STOPS and up.tag in STOPS):
                    up = up.parent  # type: ignore[assignment]
                if up.tag == tag and up.parent is not None:
                    node = left(up.parent)
            continue
        if tag in ("html", "body"):
            if tag == "html" or body:
                continue
            body, node = True, left(root)
        if tag in CLOSES_P or tag in CLOSED_BY:
            ends = CLOSED_BY.get(tag, set()) | ({"p"} if tag in CLOSES_P else set())
            while any(opened.get(x) for x in ends):
                up = node
                while up.tag not in ends and up.tag not in STOPS:
                    up = up.parent  # type: ignore[assignment]
                if up.tag not in ends:
                    break
                node = left(up.parent)  # type: ignore[arg-type]
        new = Node(tag, m[3], node)
        node.parts.append(new)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK and not BARE.search(m[3]):
            continue
        if tag in RAW:
            close = re.compile(f"</{re.escape(tag)}(?![^\\s/>])", re.I).search(html, at)
            new.parts.append(html[at : close.start() if close else end])
            at = html.find(">", close.start()) + 1 or end if close else end
            continue
        node = new
        opened[tag] = opened.get(tag, 0) + 1
    return root


@lru_cache(4096)
def names_of(classes: str, ident: str) -> frozenset[str]:
    found: set[str] = set()
    for value in (classes, ident):
        for word in re.split(r"[\s_-]+", value):
            found.update(p.lower() for p in CAMEL.findall(word))
            found.add(word.lower())
    return frozenset(found)


def mostly_links(top: Node) -> bool:
    """Whether half of an element's text or more stands in links."""
    text = linked = 0
    todo = [(top, top.tag == "a")]
    while todo:
        node, link = todo.pop()
        for x in node.parts:
            if isinstance(x, str):
                text += (n := len(x.strip()))
                linked += n * link
            elif x.tag not in UNSEEN:
                todo.append((x, link or x.tag == "a"))
    return 2 * linked >= text


def outside(node: Node, in_article: bool) -> bool:
    """Whether an element isn't part of an article, by its kind, role or names."""
    if node.tag in UNSEEN or node.tag in NOT_ARTICLE or node.tag == "header" and not in_article:
        return True
    if not node.attrs:
        return False
    own = node.given()
    if "hidden" in own or own.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", own.get("style", ""), re.I):
        return True
    names = names_of(own.get("class", ""), own.get("id", ""))
    if node.tag in ("body", "html", "main", "article"):
        return bool(names & {"comment", "comments", "reply", "ad", "advert"})
    if own.get("role", "").lower() in NOT_ARTICLE_ROLES or names & NOT_ARTICLE_NAMES:
        return True
    return bool(names & MAYBE_NAMES) and (not in_article or mostly_links(node))


def text_of(raw: str) -> str:
    return " ".join((unescape(raw) if "&" in raw else raw).split())


class Block:
    __slots__ = ("text", "owner", "linked")

    def __init__(self, text: str, owner: Node, linked: int) -> None:
        self.text, self.owner, self.linked = text, owner, linked


def blocks_of(top: Node, in_article: bool, all_of_it: bool = False) -> list[Block]:
    """The blocks of text under an element in page order: white space made one, nothing empty. all_of_it: outside parts too."""
    out: list[Block] = []
    now: list[str] = []
    linked: list[str] = []

    def flush(owner: Node) -> None:
        if now:
            if text := text_of("".join(now)):
                out.append(Block(text, owner, len(text_of("".join(linked))) if linked else 0))
            now.clear()
            linked.clear()

    # element, part to go on with, whether in an article and in a link, the block element that holds it
    todo: list[tuple[Node, int, bool, bool, Node]] = [(top, 0, in_article, False, top)]
    while todo:
        node, k, inside, in_link, owner = todo.pop()
        if k == 0 and node.tag in BLOCK:
            flush(owner)
            owner = node
        parts = node.parts
        stepped = False
        while k < len(parts):
            x = parts[k]
            k += 1
            if isinstance(x, str):
                now.append(x)
                if in_link:
                    linked.append(x)
            elif x.tag in ("br", "hr"):
                now.append(" ")
            elif x.tag in UNSEEN or not all_of_it and outside(x, inside):
                if x.tag in BLOCK:
                    flush(owner)
            elif x.parts:
                todo.append((node, k, inside, in_link, owner))
                todo.append((x, 0, inside or x.tag in ("article", "main"), in_link or x.tag == "a", owner))
                stepped = True
                break
            elif x.tag in BLOCK:
                flush(owner)
        if not stepped and node.tag in BLOCK:
            flush(node)
    flush(top)
    return out


def roots_of(page: Node) -> tuple[list[Node], bool]:
    """The elements that hold the article, and whether they are content elements rather than the body."""
    kinds: tuple[list[Node], list[Node], list[Node]] = ([], [], [])
    todo: list[tuple[Node, tuple[bool, bool, bool]]] = [(page, (False, False, False))]
    while todo:
        node, within = todo.pop()
        given = node.given() if node.attrs else {}
        which = (node.tag == "article" or given.get("role") == "article", node.tag == "main" or given.get("role", "").lower() == "main", node.tag in ("div", "section", "td") and bool({n.lower() for n in re.split(r"[\s]+", given.get("class", "") + " " + given.get("id", ""))} & CONTENT_NAMES or {re.sub("[^a-z]", "", n.lower()) for n in (given.get("class", "") + " " + given.get("id", "")).split()} & CONTENT_NAMES))
        for own, is_in, found in zip(which, within, kinds):
            if own and not is_in:
                found.append(node)
        within = tuple(a or b for a, b in zip(which, within))
        todo += [(x, within) for x in reversed(node.parts) if isinstance(x, Node) and x.parts and not outside(x, any(within))]
    size = lambda nodes: sum(len(b.text) for n in nodes for b in blocks_of(n, True))
    for found in kinds:
        if found and (n := size(found)) and all(2 * n >= size(other) for other in kinds if other and other is not found):
            return found, True
    return [page], False


def marked(page: Node) -> str:
    """The main text by marks, content elements and link density alone."""
    roots, sure = roots_of(page)
    blocks = [b for r in roots for b in blocks_of(r, sure)]
    if not sure:
        blocks = [b for b in blocks if 2 * b.linked < len(b.text)]
    return "\n".join(b.text for b in blocks)


#: A node of a tree: depth, label, hash of the text that stands directly in it, that text's length, and how much of it is in links.
Shape = list[tuple[int, str, int, int, int]]


@lru_cache(65536)
def label_of(tag: str, attrs: str) -> str:
    own = given(attrs)
    names = sorted({n for n in re.split(r"[\s0-9]+", f"{own.get('class', '')} {own.get('id', '')} {own.get('role', '')}".lower()) if n})
    return f"{tag}#{zlib.crc32(' '.join(names).encode()):x}" if names else tag


def shaped(page: Node) -> tuple[list[Node], Shape]:
    """A page's block elements in preorder, and its tree."""
    nodes: list[Node] = []
    depths: list[int] = []
    todo: list[tuple[Node, int]] = [(page, 0)]
    while todo:
        node, depth = todo.pop()
        if node.tag in UNSEEN:
            continue
        if node.tag in BLOCK:
            nodes.append(node)
            depths.append(depth)
            depth += 1
        todo += [(x, depth) for x in reversed(node.parts) if isinstance(x, Node)]
    held: dict[int, tuple[int, int, int]] = {}
    for b in blocks_of(page, False, all_of_it=True):
        h, n, linked = held.get(id(b.owner), (0, 0, 0))
        held[id(b.owner)] = zlib.crc32(b.text.encode(), h), n + len(b.text), linked + b.linked
    return nodes, [(d, label_of(x.tag, x.attrs) if x.attrs else x.tag, *held.get(id(x), (0, 0, 0))) for x, d in zip(nodes, depths)]


def shape_of(html: str | None) -> Shape:
    return shaped(parsed(html or ""))[1]


def parents_of(shape: Shape) -> list[int]:
    out: list[int] = []
    path: list[int] = []
    for k, (depth, *_) in enumerate(shape):
        del path[depth:]
        out.append(path[-1] if path else -1)
        path.append(k)
    return out


def children_of(shape: Shape) -> list[list[int]]:
    kids: list[list[int]] = [[] for _ in shape]
    for k, up in enumerate(parents_of(shape)):
        if up >= 0:
            kids[up].append(k)
    return kids


def best_pairs(rows: np.ndarray, columns: np.ndarray, weight: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (i, j), ascending in both, of the largest sum of weight[rows[i], columns[j]]; pairs of weight 0 aren't taken."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(rows), 0, len(columns))]
    while todo:
        a, b, c, d = todo.pop()
        if a == b or c == d:
            continue
        if (b - a) * (d - c) > CELLS and b - a > 1:  # halves: where the best way crosses the middle row
            mid = (a + b) // 2
            for upper in _rows_of(rows[a:mid], columns[c:d], weight):
                pass
            for lower in _rows_of(rows[mid:b][::-1], columns[c:d][::-1], weight):
                pass
            cut = c + int(np.argmax(upper + lower[::-1]))
            todo += [(a, mid, c, cut), (mid, b, cut, d)]
            continue
        table = [*_rows_of(rows[a:b], columns[c:d], weight)]
        i, j = b - a, d - c
        while i and j:
            if table[i][j] == table[i][j - 1]:
                j -= 1
            elif table[i][j] == table[i - 1][j]:
                i -= 1
            else:
                i, j = i - 1, j - 1
                out.append((a + i, c + j))
    return sorted(out)


def _rows_of(rows: np.ndarray, columns: np.ndarray, weight: np.ndarray) -> Iterator[np.ndarray]:
    row = np.zeros(len(columns) + 1, np.int64)
    yield row
    for r in rows:
        w = weight[r][columns]
        best = np.maximum(row[1:], np.where(w > 0, row[:-1] + w, 0))
        row = np.concatenate([[0], np.maximum.accumulate(best)])
        yield row


class Matcher:
    """Simple tree matching. Subtrees of equal labels throughout are of one kind, and kinds are matched once."""

    def __init__(self) -> None:
        self.kinds: dict[tuple, int] = {}
        self.label: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.size: dict[tuple[int, int], int] = {}

    def kinds_of(self, shape: Shape, kids: list[list[int]]) -> list[int]:
        out = [0] * len(shape)
        for k in range(len(shape) - 1, -1, -1):
            key = (shape[k][1], tuple(out[c] for c in kids[k]))
            if (kind := self.kinds.get(key)) is None:
                kind = self.kinds[key] = len(self.label)
                self.label.append(key[0])
                self.kids.append(key[1])
            out[k] = kind
        return out

    def weights(self, x: tuple[int, ...] | list[int], y: tuple[int, ...] | list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int]]]:
        """The kinds of x and y by number, the sizes of their matches, and what sizes are missing."""
        ones, rows = np.unique(np.array(x), return_inverse=True)
        twos, columns = np.unique(np.array(y), return_inverse=True)
        weight, missing = np.zeros((len(ones), len(twos)), np.int64), []
        by_label: dict[str, list[int]] = {}
        for j, q in enumerate(twos.tolist()):
            by_label.setdefault(self.label[q], []).append(j)
        for i, p in enumerate(ones.tolist()):
            for j in by_label.get(self.label[p], ()):
                q = int(twos[j])
                if not self.kids[p] or not self.kids[q]:
                    weight[i, j] = 1
                elif (n := self.size.get((p, q))) is None:
                    missing.append((p, q))
                else:
                    weight[i, j] = n
        return rows, columns, weight, missing

    def sized(self, p: int, q: int) -> None:
        """Works out the size of the match of two kinds of equal label, and of what it needs."""
        todo = [(p, q)]
        while todo:
            p, q = todo[-1]
            if (p, q) in self.size:
                todo.pop()
                continue
            if p == q:
                n, down = 0, [p]
                while down:
                    n += 1
                    down += self.kids[down.pop()]
                self.size[(p, q)] = n
                continue
            rows, columns, weight, missing = self.weights(self.kids[p], self.kids[q])
            if missing:
                todo += missing
                continue
            for row in _rows_of(rows, columns, weight):
                pass
            self.size[(p, q)] = 1 + int(row[-1])

    def pairs(self, x: list[int], y: list[int]) -> list[tuple[int, int]]:
        """Places in two lists of kinds that are matched. Equal kinds at either end match whole, so no other match is larger."""
        n, m, end = len(x), len(y), min(len(x), len(y))
        first = 0
        while first < end and x[first] == y[first]:
            first += 1
        last = 0
        while last < end - first and x[n - 1 - last] == y[m - 1 - last]:
            last += 1
        out = [(k, k) for k in range(first)]
        x, y = x[first : n - last], y[first : m - last]
        if x and y:
            labels = [self.label[k] for k in x]
            if len(set(labels)) == len(labels) and labels == [self.label[k] for k in y]:  # each has one partner alone
                out += [(first + k, first + k) for k in range(len(x))]
            else:
                rows, columns, weight, missing = self.weights(x, y)
                for p, q in missing:
                    self.sized(p, q)
                if missing:
                    rows, columns, weight, _ = self.weights(x, y)
                out += [(first + i, first + j) for i, j in best_pairs(rows, columns, weight)]
        return out + [(n - k, m - k) for k in range(last, 0, -1)]


def aligned(one: Shape, two: Shape) -> list[tuple[int, int]]:
    """Simple tree matching: the largest set of pairs of nodes of equal label that keeps parents and order."""
    if not one or not two or one[0][1] != two[0][1]:
        return []
    matcher, kids_one, kids_two = Matcher(), children_of(one), children_of(two)
    kind_one, kind_two = matcher.kinds_of(one, kids_one), matcher.kinds_of(two, kids_two)
    out, todo = [], [(0, 0)]
    while todo:
        a, b = todo.pop()
        out.append((a, b))
        x, y = kids_one[a], kids_two[b]
        if x and y:
            todo += [(x[i], y[j]) for i, j in matcher.pairs([kind_one[k] for k in x], [kind_two[k] for k in y])]
    return out


def counted(exemplar: Shape, shape: Shape) -> dict[int, tuple[int, int, int, int, int, int]]:
    """For the exemplar's nodes that a page has: 1, whether the text is the same, the length of text and what of it is in
    links, and both for the nodes below that the exemplar hasn't."""
    pairs = aligned(exemplar, shape)
    of = {b: a for a, b in pairs}
    out = {a: [1, int(exemplar[a][2] == shape[b][2]), shape[b][3], shape[b][4], 0, 0] for a, b in pairs}
    up = parents_of(shape)
    near: list[int] = []
    for k, p in enumerate(up):
        near.append(of.get(k, near[p] if p >= 0 else -1))
        if k not in of and near[k] >= 0:
            out[near[k]][4] += shape[k][3]
            out[near[k]][5] += shape[k][4]
    return {a: tuple(x) for a, x in out.items()}  # type: ignore[misc]


HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())


def wrapped(exemplar: Shape, sums: dict[int, tuple[int, ...]], pages: int) -> tuple[int, list[bool]] | None:
    """The wrapper of pages: the exemplar's node that holds the content, and for each node whether it is a content slot; None
    if no slot holds prose. sums: per node what counted() tells, added up over all pages."""
    size = len(exemplar)
    kids, up = children_of(exemplar), parents_of(exemplar)
    stats = [tuple(sums.get(k, (0,) * 6)) for k in range(size)]
    constant = [n >= max(LEAST_PAGES, 0.3 * pages) and same >= SHARE * n and text > 0 for n, same, text, *_ in stats]
    own = [0 if constant[k] else max(0, s[2] - s[3]) for k, s in enumerate(stats)]
    whole = [own[k] + max(0, s[4] - s[5]) for k, s in enumerate(stats)]
    text, linked = [s[2] + s[4] for s in stats], [s[3] + s[5] for s in stats]
    for k in range(size - 1, 0, -1):
        for x in (whole, text, linked):
            x[up[k]] += x[k]
    if not whole[0]:
        return None
    top = 0
    while True:
        best = max(kids[top], key=whole.__getitem__, default=None)
        dominant = best is not None and whole[best] >= DOMINANT * whole[top] and 2 * own[best] < whole[best]
        titled = any(exemplar[c][1].split("#")[0] in HEADING and whole[c] for c in kids[top] if c != best)
        if not dominant or titled:
            break
        top = best
    keep = [False] * size
    keep[top] = not constant[top]
    for k in range(top + 1, size):
        if exemplar[k][0] <= exemplar[top][0]:
            break
        dense = text[k] > 0 and linked[k] >= LINKS * text[k] and 2 * stats[k][0] >= pages
        minor = dominant and up[k] == top and k != best and kids[k] + [1] * (exemplar[k][1].split("#")[0] not in HEADING | {"p"}) and whole[k] < MINOR * whole[top]
        keep[k] = (keep[up[k]] or constant[up[k]]) and not constant[k] and not dense and not minor
    return top, keep


def extracted(html: str | None, wrapper: tuple[Shape, int, list[bool]] | None = None) -> str:
    """The main text: blocks joined by line feeds. wrapper: an exemplar and what wrapped() says of it."""
    if not html:
        return ""
    page = parsed(html)
    if wrapper is None:
        return marked(page)
    exemplar, top, keep = wrapper
    nodes, shape = shaped(page)
    of = {b: a for a, b in aligned(exemplar, shape)}
    content = next((b for b, a in of.items() if a == top), None)
    if content is None:
        return marked(page)
    kept: dict[int, bool] = {}
    state: list[bool] = []
    for k, p in enumerate(parents_of(shape)):
        state.append(keep[of[k]] if k in of else p >= 0 and state[p])
        kept[id(nodes[k])] = state[k]
    return "\n".join(b.text for b in blocks_of(nodes[content], nodes[content].tag not in ("html", "body")) if kept[id(b.owner)])


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
#: What a layout is made of.
CONTAINER = r"(?i)<(?:nav|header|main|article|section|aside|footer|div|form|table|ul)(?:\s[^>]*)?>"
SUMS = ("n", "same", "text", "linked", "more", "more_linked")


def with_host(pages: DataFrame) -> DataFrame:
    """page_id (if there), url and html with host and layout: a hash of the different containers' tags in turn."""
    layout = F.xxhash64(F.array_distinct(F.transform(F.expr(f"regexp_extract_all(coalesce(html, ''), r'{CONTAINER}', 0)"), lambda x: F.regexp_replace(F.lower(x), "[0-9]+", ""))))
    some = [c for c in ("page_id", "url", "html") if c in pages.columns]
    return pages.select(*some, F.when(F.col("url").rlike(HOST), F.lower(F.regexp_extract("url", HOST, 1))).alias("host"), layout.alias("layout"))


def _said(shape: Shape) -> str:
    return "\n".join(f"{d} {t} {h} {n} {linked}" for d, t, h, n, linked in shape)


def _shape(said: str) -> Shape:
    rows = (x.split(" ") for x in said.split("\n"))
    return [(int(d), t, int(h), int(n), int(linked)) for d, t, h, n, linked in rows]


def wrappers(pages: DataFrame, least: int = LEAST_PAGES) -> tuple[DataFrame, DataFrame]:
    """host, layout and kind: which wrapper pages of a layout have (its own, or 0: that of all layouts of too few pages); and
    host, kind, exemplar, top and keep of each wrapper."""

    def shapes(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for p in parts:
            yield {"host": p["host"], "layout": p["layout"], "digest": p["digest"], "shape": [_said(shape_of(h)) for h in p["html"]]}

    def sums(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for p in parts:
            found: dict[tuple[str, int, int], list[int]] = {}
            ready: dict[tuple[str, int], Shape] = {}
            for host, kind, shape, ex in zip(p["host"], p["kind"], p["shape"], p["exemplar"]):
                if (host, kind) not in ready:
                    ready[(host, kind)] = _shape(ex)
                for node, x in counted(ready[(host, kind)], _shape(shape)).items():
                    have = found.setdefault((host, kind, node), [0] * len(SUMS))
                    for k, v in enumerate(x):
                        have[k] += v
            yield {"host": [k[0] for k in found], "kind": [k[1] for k in found], "node": [k[2] for k in found], **{n: [v[k] for v in found.values()] for k, n in enumerate(SUMS)}}

    def made(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for p in parts:
            out: dict[str, list] = {n: [] for n in ("host", "kind", "exemplar", "top", "keep")}
            for host, kind, n, ex, nodes in zip(*(p[c] for c in ("host", "kind", "pages", "exemplar", "nodes"))):
                if (found := wrapped(_shape(ex), {x["node"]: tuple(x[c] for c in SUMS) for x in nodes}, n)) is not None:
                    top, keep = found
                    for name, x in zip(out, (host, kind, ex, top, "".join("01"[k] for k in keep))):
                        out[name].append(x)
            yield out

    hosted = with_host(pages.select("url", "html")).filter("host is not null").select("host", "layout", "html", F.xxhash64(F.coalesce("html", F.lit(""))).alias("digest"))
    trees = arrow_pass(hosted, shapes, "host string, layout bigint, digest bigint, shape string", 500)
    trees = written(trees.groupBy("host", "layout", "digest").agg(F.any_value("shape").alias("shape")), "shapes")
    groups = trees.groupBy("host", "layout").agg(F.count("*").alias("pages"), F.min("digest").alias("digest"))
    groups = written(groups.withColumn("kind", F.when(F.col("pages") >= least, F.col("layout")).otherwise(0)), "layouts")
    kinds = groups.groupBy("host", "kind").agg(F.sum("pages").alias("pages"), F.min(F.struct("digest", "layout")).alias("first")).filter(F.col("pages") >= least)
    kinds = kinds.select("host", "kind", "pages", "first.digest", "first.layout")
    exemplars = kinds.join(trees, ["host", "layout", "digest"]).select("host", "kind", "pages", F.col("shape").alias("exemplar"))
    exemplars = written(exemplars, "exemplars")
    # one row for each layout, with its kind's exemplar: pages meet it by host, layout and salt
    meet = groups.select("host", "layout", "kind").join(exemplars.drop("pages"), ["host", "kind"])
    pairs = salted(trees, SALTS).join(salt_copies(meet, SALTS), ["host", "layout", "_salt"]).select("host", "kind", "shape", "exemplar")
    schema = "host string, kind bigint, node int, " + ", ".join(f"{n} bigint" for n in SUMS)
    told = arrow_pass(pairs, sums, schema, 500).groupBy("host", "kind", "node").agg(*(F.sum(n).alias(n) for n in SUMS))
    told = told.groupBy("host", "kind").agg(F.collect_list(F.struct("node", *SUMS)).alias("nodes"))  # one exemplar's nodes
    ready = arrow_pass(told.join(exemplars, ["host", "kind"]).select("host", "kind", "pages", "exemplar", "nodes"), made, "host string, kind bigint, exemplar string, top int, keep string", 100)
    ready = written(ready, "wrappers")
    discard(trees, exemplars)
    return groups.select("host", "layout", "kind"), ready


def extract(pages: DataFrame, found: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """page_id, url and text of every page. found: wrappers(), made of the pages themselves if not given."""
    layouts, ready = wrappers(pages) if found is None else found
    known = layouts.join(ready, ["host", "kind"]).drop("kind")
    rows = with_host(pages)
    if (known.agg(F.sum(F.length("keep"))).first()[0] or 0) <= FEW_NODES:
        rows = rows.join(F.broadcast(known), ["host", "layout"], "left")
    else:
        rows = salted(rows, SALTS).join(salt_copies(known, SALTS), ["host", "layout", "_salt"], "left")

    def work(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for p in parts:
            held: dict[tuple[str, int], tuple[Shape, int, list[bool]]] = {}
            texts = []
            for html, host, layout, ex, top, keep in zip(*(p[n] for n in ("html", "host", "layout", "exemplar", "top", "keep"))):
                if ex is not None and (host, layout) not in held:
                    held[(host, layout)] = _shape(ex), top, [k == "1" for k in keep]
                texts.append(extracted(html, held.get((host, layout)) if ex is not None else None))
            yield {"page_id": p["page_id"], "url": p["url"], "text": texts}

    return arrow_pass(rows.select("page_id", "url", "html", "host", "layout", "exemplar", "top", "keep"), work, "page_id bigint, url string, text string", 500)
