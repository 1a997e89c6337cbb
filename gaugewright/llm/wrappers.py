"""HTML extraction by union-free regular-expression inference.

Pages of one host share templates. A host's wrapper is a regular expression without unions over tags and text: it starts
as one page and is aligned with one page after another. Where strings differ, a text slot takes their place; where tags
differ, what only one side has becomes optional, and what repeats side by side becomes a repeated group. The expression
is kept as a tree, since its tags nest: a node has a tag, its names (of class, id and role), how often it may occur, and
aligned children; children are aligned by their longest common subsequence. Strings that stand on every page of a host,
wherever they stand, are kept as its constants. No depth, width or length changes what is inferred.

Wrappers are inferred from every page: each task folds its pages into one wrapper per host, and these are merged in a
tree of steps, so no task gets all pages of a host, and what is merged has the size of templates, not of pages. A wrapper
tells where a host's articles are: in the heaviest ``article`` or ``main`` that holds text slots, or else in the innermost
element that holds all variable text which is no furniture; where that is the page's body, its children that are the same
on all pages are left out. Extraction aligns a page with its wrapper and returns the text below that place without
furniture (menus, headers, footers, side columns, notices, adverts, forms, comments). Being the same on all pages tells
nothing of a block by itself, since headings and closing lines are that too: a constant of the wrapper is left out only if it
also reads, as a whole, like a notice (NOTICE) and is no heading, whatever the number of pages. Within an article only
furniture's tags, and containers with a whole name of it, are left out besides; outside, no element that holds the article or
most of the text is furniture for a part of its name.

Text: character references are decoded, white space becomes one space within a block, and blocks are joined by one space.

Defined results: a null or empty html gives an empty text; a url without a host belongs to the host ''; broken or cut-off
html is read as far as it goes, at any depth; very long pages are read whole; a page that its wrapper does not match is
read by the same rules without it; repeated rows are each extracted; an empty table gives no rows; other columns, also
ones named like the result's (``text``, ``n_chars``, ``host``), are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
import sys
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_LIMIT, mapped, removed, spread, written

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)(?:>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
_SPLIT = re.compile(r"[^a-z0-9]+")
_DIGITS = re.compile(r"[0-9]+")
#: Elements without content, elements whose content is not markup, and elements that do not part blocks (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements, and words of class, id and role, that are furniture (fixed values).
FURNITURE_TAGS = frozenset("head nav footer aside form script style noscript template iframe svg button select textarea input dialog object menu".split())
FURNITURE_WORDS = frozenset(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer masthead menu modal nav navbar navigation newsletter notice notices popup promo promotion related reply replies share sharing sidebar social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Words that with one of those make up a whole name of furniture (``share-bar``, ``site-nav``); elements that such a name
#: makes furniture also within an article (fixed values).
PLAIN_WORDS = frozenset("area bar block bottom box button buttons container icons inner links list main page post site slot top wrap wrapper".split())
CONTAINERS = frozenset("div section header ul ol dl table".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open element of the same kind (fixed values).
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul p".split())
#: What a notice, an advert's mark or a call to the reader reads like as a whole, in one sentence (fixed values).
NOTICE = re.compile(
    r"(?:advertisement|advertorial|sponsored(?: content| post)?|(?:\(c\)|\u00a9|copyright)[^.!?]*(?:\. ?all rights reserved)?|all rights reserved"
    r"|(?:please )?(?:subscribe|sign up|sign in|log in|register|follow us|share this|like us|join our)\b[^.!?]*|(?:we|this (?:web ?)?site) uses? cookies\b[^.!?]*)[.!]?",
    re.I,
)
_SCOPE = frozenset("ul ol dl table article section div body html main".split())


class Node:
    """An element: tag, names (of class, id and role), children (nodes and strings)."""

    __slots__ = ("children", "names", "tag")

    def __init__(self, tag: str, names: frozenset[str] = frozenset()):
        self.tag, self.names, self.children = tag, names, []

    def signature(self) -> tuple[str, ...]:
        """What is compared in alignment: tag and names. Numbers in names, and names of headings and inline elements
        (which often name one page's part), tell nothing."""
        return (self.tag, *sorted({_DIGITS.sub("0", n) for n in self.names})) if self.names and self.tag not in INLINE | HEADINGS else (self.tag,)


def names_of(attributes: str) -> frozenset[str]:
    if "=" not in attributes:
        return frozenset()
    return frozenset(w for m in _NAMED.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").lower().split())


def tree(html: str) -> Node:
    """The elements of a page, as far as it can be read."""
    root = Node("")
    stack, scopes, places = [root], [0], defaultdict(list)  # places: where in the stack each tag is open

    def close(depth: int) -> None:
        while len(stack) > depth:
            places[stack.pop().tag].pop()
            if scopes[-1] == len(stack):
                scopes.pop()

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            stack[-1].children.append(html[at:])
            break
        if m.start() > at:
            stack[-1].children.append(html[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if places[tag] and (tag not in INLINE or places[tag][-1] > scopes[-1]):
                close(places[tag][-1])
            continue
        if tag in _ENDS_P or tag in CLOSES:
            ends = CLOSES.get(tag, set()) | ({"p"} if tag in _ENDS_P else set())
            last = max(places[t][-1] if places[t] else 0 for t in ends)
            if last > scopes[-1]:
                close(last)
        node = Node(tag, names_of(m[3]))
        stack[-1].children.append(node)
        if tag in VOID:  # a slash at a tag's end tells nothing: it may belong to an attribute
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(html, at)
            node.children.append(html[at : end.start() if end else n])
            at = end.end() if end else n
            continue
        places[tag].append(len(stack))
        if tag in _SCOPE:
            scopes.append(len(stack))
        stack.append(node)
    return root


@lru_cache(1 << 14)
def words_of(name: str) -> frozenset[str]:
    return frozenset(w for w in _SPLIT.split(name) if w)


def looks(tag: str, names: frozenset[str], inside: bool) -> int:
    """0: no furniture; 1: furniture unless it holds the article or most of the text; 2: furniture by its tag or by a whole
    name. Within an article only the latter counts, and its own ``header`` holds its title and stays."""
    if tag in FURNITURE_TAGS:
        return 1 if tag == "form" and not inside else 2
    if tag == "header" and not inside:
        return 2
    if not names or tag in ("html", "body", "article", "main"):
        return 0
    hits = [w for w in map(words_of, names) if w & FURNITURE_WORDS]
    if tag in CONTAINERS and any(w <= FURNITURE_WORDS | PLAIN_WORDS for w in hits):
        return 2
    return 1 if hits and not inside and tag not in HEADINGS else 0


def _element(x) -> tuple:
    """Tag, names and children of an element of a page or a wrapper."""
    return (x.tag, x.names, x.children) if isinstance(x, Node) else (x["g"], frozenset(x["w"]), x["k"])


def _size(x) -> int | None:
    """Characters of a text of a page or a wrapper; None for elements."""
    return len(x.strip()) if isinstance(x, str) else x["c"] if isinstance(x, dict) and "t" in x else None


def opened(root) -> set[int]:
    """Elements outside articles that look like furniture, but are none (by ``id``): those whose name only in part is
    furniture's, and that hold an article or most of the text; and, where no article (on pages without any: no text) lies
    outside furniture, the heaviest that holds what there is."""
    order, size, rest, holds, at = [root], {}, {}, {}, 0  # rest: characters outside what is furniture by tag or whole name
    while at < len(order):
        order += [c for c in _element(order[at])[2] if _size(c) is None and _element(c)[0] not in RAW and _element(c)[0] not in ("head", "svg")]
        at += 1
    for x in reversed(order):
        tag, _, children = _element(x)
        inner = [c for c in children if id(c) in size]
        size[id(x)] = sum(_size(c) or 0 for c in children) + sum(size[id(c)] for c in inner)
        rest[id(x)] = sum(_size(c) or 0 for c in children) + sum(rest[id(c)] for c in inner if looks(*_element(c)[:2], False) < 2)
        holds[id(x)] = tag in ("article", "main") or any(holds[id(c)] for c in inner)
    out: set[int] = set()
    start, semantic = root, holds[id(root)]
    while start is not None:
        todo, wholly, reached = [start], [], False
        start = None
        while todo:
            x = todo.pop()
            for c in _element(x)[2]:
                if (n := _size(c)) is not None:
                    reached |= bool(n) and not semantic
                elif id(c) in size:
                    tag, names, _ = _element(c)
                    seems = looks(tag, names, False)
                    if tag in ("article", "main"):
                        reached = True
                    elif seems == 0 or (seems == 1 and (holds[id(c)] or 2 * rest[id(c)] > rest[id(root)])):
                        if seems:
                            out.add(id(c))
                        todo.append(c)
                    elif seems == 2 and (holds[id(c)] if semantic else size[id(c)] and tag in CONTAINERS - {"header"}):
                        wholly.append(c)
        if not reached and wholly:
            start = max(wholly, key=lambda c: size[id(c)])
            out.add(id(start))
    return out


def blocks_of(node: Node, inside: bool = True, without: frozenset[tuple] = frozenset(), every: bool = False) -> list[str]:
    """Texts of :func:`marked_blocks`."""
    return [text for text, _ in marked_blocks(node, inside, without, every)]


def marked_blocks(node: Node, inside: bool = True, without: frozenset[tuple] = frozenset(), every: bool = False) -> list[tuple[str, bool]]:
    """Blocks of text of an element without furniture, each with whether it is a heading's; ``inside``: it lies in an article, or is one; outside, an element
    with text of its own is as an article to what it holds. ``without``: signatures of its children that are left out;
    ``every``: furniture stays."""
    parts: list[str | bool | None] = []  # None parts blocks, True stands at a heading's beginning
    kept = frozenset() if inside or every else opened(node)
    todo: list[tuple[Iterator, Node, bool]] = []

    def enter(x: Node, inside: bool) -> None:
        if x.tag not in INLINE:
            parts.append(None)
        if x.tag in HEADINGS:
            parts.append(True)
        todo.append((iter(x.children), x, inside))

    enter(node, inside)
    while todo:
        rest, x, inside = todo[-1]
        for c in rest:
            if isinstance(c, str):
                parts.append(entities.unescape(c) if "&" in c else c)
            elif (c.tag not in RAW if every else not looks(c.tag, c.names, inside) or id(c) in kept) and not (without and x is node and c.signature() in without):
                enter(c, inside or c.tag in ("article", "main") or (c.tag not in PAGE and any(k.strip() if isinstance(k, str) else k.tag in OWN for k in c.children)))
                break
            elif c.tag not in INLINE and c.tag not in RAW:  # what is left out parts blocks as well
                parts.append(None)
        else:
            todo.pop()
            if x.tag not in INLINE:
                parts.append(None)
    out, at = [], 0
    for i, p in enumerate([*parts, None]):
        if p is None:
            heading = i > at and parts[at] is True
            if i > at + heading and (text := _SPACE.sub(" ", "".join(parts[at + heading : i])).strip()):
                out.append((text, heading))
            at = i + 1
    return out


def digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


# --- wrappers -------------------------------------------------------------------------------------------------------
# An item of a wrapper: a text {"t": digest of a string, or null for a slot, "n": pages, "c": characters} or an element
# {"g": tag, "w": names, "s": signature, "k": children, "n": pages, "o": optional, "r": repeated}; the root has "e" too,
# digests of the blocks that stand on every page. Functions recurse as deep as pages nest, in Python frames only.
sys.setrecursionlimit(max(sys.getrecursionlimit(), 1_000_000))


def signature(item: dict) -> tuple:
    return ("#",) if "t" in item else tuple(item["s"])


def wrapper_of(root: Node) -> dict:
    """The wrapper of one page."""
    return started(root) | {"e": sorted(set(map(digest, blocks_of(root, every=True))))}


def started(node: Node) -> dict:
    """The wrapper of one page's element: its own repeated siblings are folded into groups."""
    children: list[dict] = []
    for c in node.children:
        if isinstance(c, str):
            if s := _SPACE.sub(" ", c).strip():
                children.append({"t": digest(s), "n": 1, "c": len(s)})
        elif c.tag not in ("script", "style"):
            children.append(started(c))
    return {"g": node.tag, "w": sorted(node.names), "s": list(node.signature()), "k": folded(children), "n": 1, "o": False, "r": False}


def folded(children: list[dict]) -> list[dict]:
    """Adjacent equal groups of siblings (one to three elements wide) become one repeated group."""
    if len(children) < 2:
        return children
    for width in (1, 2, 3):
        out: list[dict] = []
        for c in children:
            out.append(c)
            while len(out) >= 2 * width and not all("t" in x for x in out[-width:]) and [signature(x) for x in out[-width:]] == [signature(x) for x in out[-2 * width : -width]]:
                later = out[-width:]
                del out[-width:]
                for i in range(width):
                    merged = aligned(out[i - width], later[i])
                    merged["n"] = max(out[i - width]["n"], later[i]["n"])
                    if "g" in merged:
                        merged["r"] = True
                    out[i - width] = merged
        children = out
    return children


def common(x: list, y: list, every: int = 256) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, by a row of bits for each of x's items (Hyyro, 2004). Only each ``every``th
    row is kept, the others are made again on the way back."""
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    a, b = x[head : len(x) - tail], y[head : len(y) - tail]
    ends = [(i, i) for i in range(head)], [(len(x) - i, len(y) - i) for i in range(tail, 0, -1)]
    places: dict = {}
    for j, v in enumerate(b):
        places[v] = places.get(v, 0) | 1 << j
    full = (1 << len(b)) - 1

    def step(row: int, v) -> int:
        met = row & places.get(v, 0)
        return ((row + met) | (row - met)) & full

    marks, row = [full], full
    for i, v in enumerate(a):
        row = step(row, v)
        if (i + 1) % every == 0:
            marks.append(row)
    pairs, i, j = [], len(a), len(b)
    first, rows = len(a) + 1, []  # rows first, first + 1, ... are at hand

    def at(i: int) -> int:
        nonlocal first, rows
        if i < first:
            first = i // every * every
            rows = [marks[i // every]]
            for v in a[first : first + every]:
                rows.append(step(rows[-1], v))
        return rows[i - first]

    while i and j:
        if at(i) >> (j - 1) & 1:
            j -= 1
        elif i > 1 and not at(i - 1) >> (j - 1) & 1:
            i -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((head + i, head + j))
    return [*ends[0], *pairs[::-1], *ends[1]]


def aligned(a: dict, b: dict) -> dict:
    """One wrapper for two with the same signature: differing strings become slots, unmatched elements optional."""
    if "t" in a:
        return {"t": a["t"] if a["t"] == b["t"] else None, "n": a["n"] + b["n"], "c": a["c"] + b["c"]}
    names = a["w"] if a["w"] == b["w"] else sorted({*a["w"]} & {*b["w"]})
    out = {"g": a["g"], "w": names, "s": a["s"], "n": a["n"] + b["n"], "o": a["o"] or b["o"], "r": a["r"] or b["r"]}
    if "e" in a and "e" in b:
        out["e"] = sorted({*a["e"]} & {*b["e"]})
    x, y = a["k"], b["k"]
    sx, sy = [signature(i) for i in x], [signature(i) for i in y]
    if sx == sy:
        out["k"] = [aligned(i, j) for i, j in zip(x, y, strict=True)]
        return out
    merged: list[dict] = []
    i = j = 0
    for p, q in [*common(sx, sy), (len(x), len(y))]:
        merged += [c if "t" in c else c | {"o": True} for c in (*x[i:p], *y[j:q])]
        if p < len(x):
            merged.append(aligned(x[p], y[q]))
        i, j = p + 1, q + 1
    out["k"] = folded(merged)
    return out


def flat(wrapper: dict) -> str:
    """A wrapper as JSON, its elements in a row with their number of children, so that no depth is too much."""
    out, todo = [], [wrapper]
    while todo:
        item = todo.pop()
        if "g" in item:
            out.append({**item, "k": len(item["k"])})
            todo += reversed(item["k"])
        else:
            out.append(item)
    return json.dumps(out)


def unflat(data: str) -> dict:
    items = json.loads(data)
    todo: list[list] = [[1, []]]  # children still to come, and those that came
    top = todo[0][1]
    for item in items:
        while not todo[-1][0]:
            todo.pop()
        todo[-1][0] -= 1
        todo[-1][1].append(item)
        if "g" in item:
            n, item["k"] = item["k"], []
            todo.append([n, item["k"]])
    return top[0]


def expression(item: dict) -> str:
    """The wrapper as a regular expression."""
    if "t" in item:
        return "#TEXT" if item["t"] is None else f"#{item['t']}"
    inner = " ".join(map(expression, item["k"]))
    body = f"<{item['g']}{'.' if item['w'] else ''}{'.'.join(item['w'])}> {inner} </{item['g']}>"
    mark = ("*" if item["o"] else "+") if item["r"] else "?" if item["o"] else ""
    return f"( {body} ){mark}" if mark else body


def variable_text(item: dict) -> int:
    """Characters of a text slot; a constant has none, unless only one page tells."""
    return item["c"] if item["t"] is None or item["n"] == 1 else 0


#: Elements that hold whole pages, and children that make up an element's own text (fixed values).
PAGE = frozenset(("", "html", "body"))
OWN = INLINE | HEADINGS | {"p", "blockquote", "pre", "ul", "ol", "table", "figure"}


def place(wrapper: dict) -> dict:
    """Where a host's articles are: ``path`` of signatures from the root, whether that is ``inside`` an article,
    ``without``, the signatures of the path's last element's children that are the same on all pages, and ``same``, the
    host's constants.

    The heaviest ``article``, or else the heaviest ``main``; on hosts without them the innermost element that holds all
    variable text which is no furniture."""
    same_text = wrapper["e"]
    kept = opened(wrapper)
    found: list[tuple[tuple, tuple]] = []

    def left(c: dict, inside: bool) -> bool:
        return "t" in c or id(c) in kept or not looks(c["g"], frozenset(c["w"]), inside)

    weights: dict[int, int] = {}  # of elements in an article, by id; those below come first

    def weigh(item: dict) -> int:
        total = 0
        for c in item["k"]:
            if "t" in c:
                total += variable_text(c)
            else:
                below = weigh(c)
                total += 0 if looks(c["g"], frozenset(c["w"]), True) else below
        weights[id(item)] = total
        return total

    def walk(item: dict, path: tuple | None, depth: int, inside: bool) -> None:
        for c in item["k"]:
            if "g" in c and left(c, inside):
                at = (path, signature(c))
                semantic = 2 if c["g"] == "article" or _named(c, "articlebody", "article-body") else 1 if c["g"] == "main" or _named(c, "main", "main-content") else 0
                if semantic and weights[id(c)]:
                    found.append(((semantic, weights[id(c)], -depth), at))
                walk(c, at, depth + 1, inside or c["g"] in ("article", "main"))

    weigh(wrapper)
    walk(wrapper, None, 0, False)
    if found:
        at, path = max(found, key=lambda f: f[0])[1], []
        while at:
            path.append(list(at[1]))
            at = at[0]
        return {"path": path[::-1], "inside": True, "without": [], "same": same_text}

    told: dict[int, int] = {}

    def weight(c: dict) -> int:
        if "t" in c:
            return variable_text(c)
        if id(c) not in told:
            inside, total = c["g"] not in PAGE and own(c), 0
            for k in c["k"]:
                if left(k, inside):
                    total += weight(k)
            told[id(c)] = total
        return told[id(c)]

    def own(item: dict) -> bool:
        for c in item["k"]:
            if variable_text(c) if "t" in c else c["g"] in OWN and left(c, False) and weights[id(c)]:
                return True
        return False

    item, path = wrapper, []
    while not own(item):
        holding = [c for c in item["k"] if left(c, False) and weight(c)]
        if len(holding) != 1:
            break
        item = holding[0]
        path.append(list(signature(item)))
    same = [c for c in item["k"] if item["g"] in PAGE and "g" in c and c["g"] not in OWN and c["n"] > 1 and not weight(c)] if weight(item) else []
    return {"path": path, "inside": item["g"] not in PAGE and own(item), "without": [list(signature(c)) for c in same], "same": same_text}


def _named(item: dict, *names: str) -> bool:
    return item["g"] in ("div", "section", "td") and any(n in item["w"] for n in names)


def _at(root: Node, path: list) -> list[Node]:
    hits = [root]
    for step in path:
        want = tuple(step)
        hits = [c for h in hits for c in h.children if not isinstance(c, str) and c.signature() == want]
    return hits


def extract(html: str | None, where: dict | None) -> str:
    """The article's text of a page, at a wrapper's place; without one, or off it, where the same rules find it."""
    if not html:
        return ""
    root = tree(html)
    hits = _at(root, where["path"]) if where else []
    if not hits:
        where = place(wrapper_of(root))
        hits = _at(root, where["path"])
    without, same = frozenset(map(tuple, where["without"])), frozenset(where["same"])
    blocks = [b for h in hits for b in marked_blocks(h, where["inside"], without)]
    return " ".join(text for text, heading in blocks if heading or not NOTICE.fullmatch(text) or digest(text) not in same)


# --- Spark ----------------------------------------------------------------------------------------------------------
#: Wrappers that a task holds at once while it folds pages.
HELD = 2000
#: Wrappers of a host that are merged in one step, about.
FAN = 64


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]*)", 1))


def _folding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, dict] = {}

    def out() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([flat(w) for w in held.values()], pa.string())], ["host", "wrapper"])
        held.clear()
        return made

    for b in batches:
        for at, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if page:
                new = wrapper_of(tree(page))
                held[at] = aligned(held[at], new) if at in held else new
        if len(held) >= HELD:
            yield out()
    yield out()


def _merging(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, wrapper, host) sorted by host and part: one wrapper at a time."""
    now = wrapper = host = None
    for b in batches:
        done: list[tuple[str, dict]] = []
        for at, text, of in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            new = unflat(text)
            if at == now:
                wrapper = aligned(wrapper, new)
                continue
            if wrapper is not None:
                done.append((host, wrapper))
            now, wrapper, host = at, new, of
        yield _wrapped(done)
    yield _wrapped([(host, wrapper)] if wrapper is not None else [])


def _wrapped(done: list[tuple[str, dict]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([h for h, _ in done], pa.string()), pa.array([flat(w) for _, w in done], pa.string())], ["host", "wrapper"])


def infer(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """(host, wrapper as JSON) of every host, from all its pages."""
    slim = spread(pages.select(host(F.col(url_column)).alias("host"), F.col(html_column).cast("string").alias("html")))
    parts, path = written(mapped(slim, _folding, "host string, wrapper string"), "wrappers")
    while (most := parts.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        salt = F.pmod(F.xxhash64("wrapper"), F.lit(-(-most // FAN)))
        rows = parts.withColumn("salt", salt).repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper")
        parts, after = written(mapped(rows.select(F.concat_ws("/", "host", "salt").alias("part"), "wrapper", "host"), _merging, "host string, wrapper string"), "wrappers")
        removed(pages.sparkSession, path)
        path = after
    return parts


def _placing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        paths = [json.dumps(place(unflat(w))) for w in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(paths, pa.string())], ["host", "path"])


def places(wrappers: DataFrame) -> DataFrame:
    """(host, path as JSON): where a host's articles are."""
    return mapped(wrappers, _placing, "host string, path string")


def _extracting(box):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = box.value if box else None
        read: dict[str, list] = {}
        for b in batches:
            out = []
            where = b.column(3).to_pylist()
            for at, page in zip(where, b.column(2).to_pylist(), strict=True):
                text = (known.get(at) if known is not None else at) or "null"
                if text not in read:
                    if len(read) > 10_000:
                        read.clear()
                    read[text] = json.loads(text)
                out.append(extract(page, read[text]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return run


_OUT = "page_id long, url string, text string, n_chars long"


def extracted(pages: DataFrame, limit: int = BROADCAST_LIMIT) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages (page_id, url, html).

    The places of all hosts are sent to the tasks if their measured size is within ``limit``; beyond it pages are joined
    to them by host, where Spark splits a host that holds too many rows.
    """
    spark = pages.sparkSession
    where, _ = written(places(infer(pages)), "wrappers")
    size = where.agg(F.coalesce(F.sum(F.length("host") + F.length("path") + 150), F.lit(0))).first()[0]
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host(F.col("url")).alias("host"))
    if size <= limit:
        table = where.toArrow()
        box = spark.sparkContext.broadcast(dict(zip(table["host"].to_pylist(), table["path"].to_pylist(), strict=True)))
        return mapped(spread(rows), _extracting(box), _OUT)
    joined = rows.join(where, "host", "left").select("page_id", "url", "html", "path")
    return mapped(joined, _extracting(None), _OUT)
