"""HTML extraction by wrapper induction.

Pages become DOM trees. For each host a template tree is induced: trees are aligned by simple tree matching (the largest
order-preserving mapping of equal nodes) and unmatched nodes are added. Every template node keeps what was seen of it: on
which distinct pages (up to SUPPORT of them, which is all that is asked), whether its text and its own text were always
the same, and how many characters stood in it, in links and outside. Runs of equal leaves, and long runs of other
equal siblings, are one folded node. Tasks
induce partial templates, which are merged by the same matching in two steps, so that a host that holds a third of all
pages costs each task only its own part.

The wrapper of a host is read off its template. A node whose text was the same on SUPPORT or more distinct pages is
constant, and so template, unless it holds nine tenths of the host's text. The other nodes are slots; a slot weighs as much
varying text as it holds outside links. From the root the wrapper goes down as long as a container has no paragraphs of
its own, and leaves out what is template beside the rest: constants, lists of links, parts that names mark, and containers of another
kind than the heaviest that weigh less than a quarter of it. A container with paragraphs of its own is kept whole but for
constants, what names mark and what HTML itself defines as no part of the text (scripts, navigation, footers and so on).
An article element, and a container with a heading of its own, is an article: no part of it goes because it is small.
Names and roles only break ties: they make a container lighter or heavier, and a marked part goes where it is the smaller.

Every page is then aligned with its host's wrapper, and its kept slots are written out. Nodes that the wrapper does not
know are kept unless they are links, marked or no text. A page of which nothing is kept gets the wrapper of its own tree.

Defined results: null, empty or text-free html gives an empty text; a null or odd url has the host ""; copies of a page
count as one page where constants are concerned; nesting beyond DEPTH is flattened; broken markup is closed as browsers
do; a host of fewer than SUPPORT distinct pages has no constants; a template keeps the NODES nodes met most often, and
others count as unknown to it; words of an id count only if it is short and they are known names (others tell pages or
sections apart, not places); extra columns are dropped.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from html.parser import HTMLParser
from zlib import crc32

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

DEPTH = 120
#: Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe svg math object canvas audio video select option button textarea input label fieldset legend datalist".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
CLOSES_P = BLOCKS - {"body", "html", "li", "dd", "dt", "tr", "tbody", "thead", "tfoot", "caption", "legend"}
IMPLIED = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "tbody", "thead"}, {"table"}), "option": ({"option"}, {"select"})}
APART = frozenset("nav header footer aside script style head title dialog menu".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog form menu menubar alertdialog".split())
NAMES = frozenset("ad ads advert adverts advertisement advertising banner promo promotion sponsor sponsored sidebar side menu nav navbar navigation breadcrumb breadcrumbs header masthead footer cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login share sharing social related recommended recommendations comment comments respond reply replies disqus pagination pager widget widgets toolbar tags tagcloud skip".split())
MAIN_NAMES = frozenset("article content main post entry story body text".split())
#: Element names whose text stands for itself, and those that only hold others.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 hgroup blockquote pre ul ol dl figure".split())
TABLES = frozenset("table thead tbody tfoot tr td th caption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())

#: Distinct pages that must agree before a node is constant.
SUPPORT = 3
#: Equal siblings that hold other elements are nodes of their own, up to so many in a row; longer runs, and runs of leaves, are one.
FEW = 8
NODES = 4_000
#: Nodes of all templates that a task keeps at once.
TASK_NODES = 400_000


class Node:
    __slots__ = ("tag", "names", "role", "parts", "holds")

    def __init__(self, tag: str, names: tuple[str, ...] = (), role: str = ""):
        self.tag, self.names, self.role = tag, names, role
        self.parts: list[Node | str] = []
        self.holds = False  # an inline element around block elements

    @property
    def sign(self) -> str:
        """Tag, role and names; numbers in names tell pages apart, not places."""
        return _sign(self.tag, self.role, self.names)


_NUMBER = re.compile("[0-9]+")
#: What is known of element signs is kept; a task meets few.
KNOWN_SIGNS = 20_000


@lru_cache(KNOWN_SIGNS)
def _sign(tag: str, role: str, names: tuple[str, ...]) -> str:
    return f"{tag}#{role}." + ".".join(_NUMBER.sub("0", n) for n in names)


def known_words(name: str) -> tuple[str, ...]:
    """The words of an id that name a place on any page; none of a long id, which is some title."""
    words = [w for w in re.split("[-_\\s]+", name.lower()) if w]
    return tuple(w for w in words if w in NAMES or w in MAIN_NAMES) if len(words) <= 2 else ()


INLINE_ALIKE = frozenset("a b i em strong span u s small sub sup code mark q cite abbr time br wbr font tt kbd var ins del img".split())


class TreeBuilder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]
        self.flat: Counter = Counter()  # elements below DEPTH that are open, but have no node of their own

    def close_from(self, k: int) -> None:
        del self.open[k:]
        self.flat.clear()

    def shut(self, tags: frozenset | set, stop: frozenset | set) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.open[k].tag
            if tag in stop:
                return
            if tag in tags:
                self.close_from(k)
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES_P:
            self.shut({"p"}, {"table", "td", "th", "button", "article", "section", "div"})
        if tag in IMPLIED:
            self.shut(*IMPLIED[tag])
        names: tuple[str, ...] = ()
        role = ""
        for key, value in attrs:
            if key == "class" and value:
                names += tuple(value.lower().split())
            elif key == "id" and value:
                names += known_words(value)
            elif key == "role" and value:
                role = value.lower()
            elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and value and re.search(r"display\s*:\s*none", value)):
                role = "hidden"
        node = Node(tag, names, role)
        if tag in BLOCKS:
            for outer in reversed(self.open):
                if outer.tag not in INLINE_ALIKE:
                    break
                outer.holds = True
        self.open[-1].parts.append(node)
        if tag in VOID:
            return
        if len(self.open) < DEPTH:
            self.open.append(node)
        else:
            self.flat[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math", "iframe") and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        if self.flat[tag] > 0:
            self.flat[tag] -= 1
            return
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                self.close_from(k)
                return
            if tag not in BLOCKS and self.open[k].tag in BLOCKS:
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].parts.append(data)


def parse(html: str) -> Node:
    builder = TreeBuilder()
    try:
        builder.feed(html)
        builder.close()
    except AssertionError:  # the parser's own check on hopeless markup: what was read so far stands
        pass
    return builder.root


class Slot:
    """A node of a template, or of one page's folded tree."""

    __slots__ = ("sign", "pages", "seen", "text", "same", "own", "varied", "chars", "links", "kids", "runs")

    def __init__(self, sign: str, pages: int, seen: tuple[int, ...], text: int, same: bool, own: int, varied: bool, chars: int, links: int, kids: list[Slot]):
        self.sign, self.pages, self.seen, self.text, self.same, self.own, self.varied = sign, pages, seen, text, same, own, varied
        self.chars, self.links, self.kids = chars, links, kids
        self.runs: list[list[tuple[Node, Slot]]] = []  # of a page's own tree: what each child slot stands for

    def plain(self) -> list:
        return [self.sign, self.pages, self.seen, self.text, self.same, self.own, self.varied, self.chars, self.links, [k.plain() for k in self.kids]]

    @staticmethod
    def of(x: list) -> Slot:
        return Slot(x[0], x[1], tuple(x[2]), *x[3:9], [Slot.of(k) for k in x[9]])

    def nodes(self) -> int:
        return 1 + sum(k.nodes() for k in self.kids)


def inline(node: Node, linked: bool) -> Iterator[tuple[str, bool]]:
    for part in node.parts:
        if isinstance(part, str):
            yield part, linked
        elif part.tag in INLINE_ALIKE and not part.holds:
            yield from inline(part, linked or part.tag == "a")


def fold(node: Node, page: int) -> Slot:
    """A node's template form, with the run of siblings that each child slot stands for. Inline elements count as text."""
    out = Slot(node.sign, 1, (page,), 0, True, 0, False, 0, 0, [])
    own: list[str] = []
    linked = 0
    for part in node.parts:
        if isinstance(part, str):
            own.append(part)
        elif part.tag in INLINE_ALIKE and not part.holds:
            for text, link in inline(part, part.tag == "a"):
                own.append(text)
                linked += len(text.strip()) if link else 0
        else:
            slot = fold(part, page)
            if out.runs and out.runs[-1][0][1].sign == slot.sign:
                out.runs[-1].append((part, slot))
            else:
                out.runs.append([(part, slot)])
    out.runs = [r for run in out.runs for r in ([run] if len(run) > FEW or not any(slot.kids for _, slot in run) else [[x] for x in run])]
    text = " ".join("".join(own).split())
    out.own = crc32(text.encode("utf-8", "replace"))
    if node.tag == "a":
        linked = len(text)
    out.chars, out.links = max(0, len(text) - linked), min(linked, len(text))
    for run in out.runs:
        merged = run[0][1]
        if len(run) > 1:
            merged = Slot(merged.sign, 1, merged.seen, merged.text, True, merged.own, False, merged.chars, merged.links, list(merged.kids))
            for _, slot in run[1:]:
                merged = beside(merged, slot)
        out.kids.append(merged)
    out.text = crc32(",".join([str(out.own), *(str(k.text) for k in out.kids)]).encode())
    return out


def beside(a: Slot, b: Slot) -> Slot:
    """Two siblings of one page as one slot."""
    out = Slot(a.sign, 1, a.seen, crc32(f"{a.text} {b.text}".encode()), True, crc32(f"{a.own} {b.own}".encode()), False, a.chars + b.chars, a.links + b.links, a.kids)
    if b.kids:
        out.kids = aligned(a.kids, b.kids, beside)
    return out


def match(a: list[Slot], b: list[Slot]) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two child lists: the size of the largest mapping, and its pairs of positions."""
    if [x.sign for x in a] == [x.sign for x in b]:  # the usual case: equal lists map one to one
        return sum(1 + match(x.kids, y.kids)[0] for x, y in zip(a, b, strict=True)), [(k, k) for k in range(len(a))]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    gain = {}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            g = 1 + match(x.kids, y.kids)[0] if x.sign == y.sign else 0
            gain[i, j] = g
            best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + g)
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if gain[i - 1, j - 1] and best[i][j] == best[i - 1][j - 1] + gain[i - 1, j - 1]:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
        elif best[i][j] == best[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return best[-1][-1], pairs[::-1]


def aligned(a: list[Slot], b: list[Slot], join: Callable[[Slot, Slot], Slot]) -> list[Slot]:
    """a with b aligned into it: matched nodes joined, nodes of b alone inserted in order."""
    kids: list[Slot] = []
    i = j = 0
    for p, q in [*match(a, b)[1], (len(a), len(b))]:
        kids += a[i:p] + b[j:q]
        if p < len(a) and q < len(b):
            kids.append(join(a[p], b[q]))
        i, j = p + 1, q + 1
    return kids


def blend(a: Slot, b: Slot) -> Slot:
    """A template with another page, or another template, in it."""
    a.same = a.same and b.same and a.text == b.text
    a.varied = a.varied or b.varied or a.own != b.own
    a.pages += b.pages
    if len(a.seen) < SUPPORT:
        a.seen = tuple(sorted({*a.seen, *b.seen})[:SUPPORT])
    a.chars += b.chars
    a.links += b.links
    if b.kids:
        a.kids = aligned(a.kids, b.kids, blend)
    return a


def pruned(t: Slot) -> Slot:
    """The template with its NODES most frequent nodes; what it loses counts as unknown."""
    if t.nodes() <= NODES:
        return t
    counts: list[int] = []

    def count(slot: Slot) -> None:
        counts.append(slot.pages)
        for k in slot.kids:
            count(k)

    def cut(slot: Slot, least: int) -> None:
        slot.kids = [k for k in slot.kids if k.pages > least]
        for k in slot.kids:
            cut(k, least)

    count(t)
    cut(t, sorted(counts, reverse=True)[NODES])
    return t


def _induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    templates: dict[str, Slot] = {}
    salt = TaskContext.get().partitionId() % SALTS
    nodes = 0

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(templates), pa.string()), pa.array([salt] * len(templates), pa.int32()), pa.array([json.dumps(t.plain()).encode() for t in templates.values()], pa.binary())], ["host", "salt", "template"])
        templates.clear()
        return out

    for batch in common.slices(batches, "html"):
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            if html:
                slot = fold(parse(html), crc32(html.encode("utf-8", "replace")))
                before = templates[host].nodes() if host in templates else 0
                templates[host] = pruned(blend(templates[host], slot)) if host in templates else slot
                nodes += templates[host].nodes() - before
        if nodes > TASK_NODES:
            yield flush()
            nodes = 0
    if templates:
        yield flush()


def _merge(final: bool) -> Callable[[pa.Table], pa.Table]:
    """Partial templates of a host as one; at last as the wrapper."""

    def run(group: pa.Table) -> pa.Table:
        merged = None
        for x in sorted(group.column("template").to_pylist()):
            slot = Slot.of(json.loads(x))
            merged = slot if merged is None else pruned(blend(merged, slot))
        out = wrapper_of(merged) if final else merged.plain()
        return pa.table({"host": group.column("host")[:1], "template": pa.array([json.dumps(out).encode()], pa.binary())})

    return run


#: Partial templates of a host are merged in so many groups first.
SALTS = 64


@lru_cache(KNOWN_SIGNS)
def tag_of(sign: str) -> str:
    return sign[: sign.index("#", 1)]


@lru_cache(KNOWN_SIGNS)
def never(sign: str) -> bool:
    """Elements that HTML defines as no part of the text around them."""
    role = sign[sign.index("#", 1) + 1 :].split(".", 1)[0]
    return tag_of(sign) in APART or role in ROLES or role == "hidden"


def names_of(sign: str) -> set[str]:
    return {word for name in sign[sign.index("#", 1) + 1 :].split(".")[1:] for word in (name, *re.split("[-_]+", name))}


@lru_cache(KNOWN_SIGNS)
def marked(sign: str) -> bool:
    """Does a name (or a form) mark the element as no part of an article?"""
    return tag_of(sign) == "form" or (tag_of(sign) not in ("body", "html", "main", "article") and not NAMES.isdisjoint(names_of(sign)))


def holds(slot: Slot) -> bool:
    """Is the node a container? A table is one if it lays out other elements."""
    tag = tag_of(slot.sign)
    return any(tag_of(k.sign) not in TABLES or holds(k) for k in slot.kids) if tag in TABLES else tag not in TEXTUAL


@lru_cache(KNOWN_SIGNS)
def leaning(sign: str) -> float:
    """What names break ties with."""
    if marked(sign):
        return 0.1
    return 4.0 if tag_of(sign) in ("article", "main") or "#main." in sign else 2.0 if not MAIN_NAMES.isdisjoint(names_of(sign)) else 1.0


PATH, KEPT, DROPPED, CONSTANT = range(4)


def wrapper_of(template: Slot) -> list:
    """What is done with each node: [sign, decision, text of a constant, children]. A kept node lists its children only
    if something in it is dropped."""
    every: dict[int, tuple[int, int, int]] = {}

    def volumes(s: Slot) -> tuple[int, int, int]:
        """(varying characters outside links, all outside links, in links) of the subtree."""
        varying, plain, linked = s.chars if s.varied or len(s.seen) < SUPPORT else 0, s.chars, s.links
        for k in s.kids:
            own = volumes(k)
            if not never(k.sign):
                varying, plain, linked = varying + own[0], plain + own[1], linked + own[2]
        every[id(s)] = varying, plain, linked
        return every[id(s)]

    _, whole, _ = volumes(template)

    def constant(s: Slot) -> bool:
        return s.same and len(s.seen) >= SUPPORT and 10 * every[id(s)][1] <= 9 * whole

    none_varies = every[id(template)][0] == 0

    def weight(s: Slot) -> float:
        varying, plain, linked = every[id(s)]
        text = plain if none_varies or (s.same and not constant(s)) else varying
        return text * text / max(1, text + linked)

    def kept(s: Slot) -> list:
        """Everything in s, but constants, what is never text, and small parts that names mark."""
        out, whole_of = [], weight(s)
        for k in s.kids:
            if never(k.sign) or (marked(k.sign) and 2 * weight(k) < whole_of):
                out.append([k.sign, DROPPED, 0, []])
            elif constant(k) and k.text:
                out.append([k.sign, CONSTANT, k.text, []])
            else:
                out.append(kept(k))
        if all(k[1] == KEPT and not k[3] and not marked(k[0]) for k in out):
            out = []
        return [s.sign, KEPT, 0, out]

    def template_part(k: Slot, beside: float) -> bool:
        """Is k, with so much weight beside it, no part of an article: never text, constant, marked, or links?"""
        _, plain, linked = every[id(k)]
        return never(k.sign) or constant(k) or (marked(k.sign) and leaning(k.sign) * weight(k) < beside) or (linked > 0 and linked >= 2 * plain)

    def stands_for_article(sign: str) -> bool:
        return leaning(sign) >= 4

    def alike(a: Slot, b: Slot) -> bool:
        """Are both the same kind of part, such as two sections?"""
        return a.sign == b.sign and not {tag_of(k.sign) for k in a.kids}.isdisjoint(tag_of(k.sign) for k in b.kids)

    def select(s: Slot, inside: bool = False) -> list:
        """inside: s is part of an article, so nothing goes because it is lighter than what stands beside it."""
        whole_of = sum(weight(k) for k in s.kids if not never(k.sign))
        live = [k for k in s.kids if not template_part(k, whole_of - weight(k))]
        holders = [k for k in live if holds(k) and weight(k)]
        best = max(holders, key=lambda k: weight(k) * leaning(k.sign), default=None)
        loose = (s.chars if s.varied or len(s.seen) < SUPPORT else 0) + sum(weight(k) for k in live if not holds(k) and tag_of(k.sign) not in HEADINGS)
        nested = any(stands_for_article(k.sign) for k in holders)
        if best is None or loose:
            return kept(s)
        inside = inside or (not nested and (stands_for_article(s.sign) or any(tag_of(k.sign) in HEADINGS and weight(k) for k in live)))
        out = []
        for k in s.kids:
            if k not in live:
                out.append([k.sign, DROPPED, 0, []])
            elif k not in holders:
                out.append(kept(k))
            elif inside or alike(k, best) or leaning(k.sign) > 1 or 4 * weight(k) >= weight(best) * leaning(best.sign):
                out.append(select(k, inside))
            else:
                out.append(mains(k) or [k.sign, DROPPED, 0, []])
        return [s.sign, PATH, 0, out]

    def mains(s: Slot) -> list | None:
        """The elements that stand for an article inside a container that is not kept itself."""
        out = []
        for k in s.kids:
            if template_part(k, 0):
                out.append(None)
            else:
                out.append(select(k) if stands_for_article(k.sign) and weight(k) else mains(k))
        if all(x is None for x in out):
            return None
        return [s.sign, PATH, 0, [x or [k.sign, DROPPED, 0, []] for x, k in zip(out, s.kids, strict=True)]]

    return select(template)


class Wrapper:
    """A wrapper as a tree that pages are aligned with."""

    __slots__ = ("sign", "decision", "text", "kids")

    def __init__(self, x: list):
        self.sign, self.decision, self.text, self.kids = x[0], x[1], x[2], [Wrapper(k) for k in x[3]]


class Extraction:
    """One page under one wrapper: the elements kept, in page order, and those left out inside them."""

    def __init__(self, wrapper: Wrapper, slot: Slot, root: Node):
        self.chosen: list[Node] = []
        self.left_out: set[int] = set()
        self.spared: set[int] = set()  # kept although names mark them
        self.found = 0
        if wrapper.decision == KEPT:
            self.chosen.append(root)
            self.inside(wrapper, slot)
            self.found = volume(slot)
        else:
            self.along(wrapper, slot)

    def pairs(self, wrapper: Wrapper, slot: Slot) -> list[tuple[Wrapper | None, int]]:
        known = dict((q, wrapper.kids[p]) for p, q in match(wrapper.kids, slot.kids)[1])
        return [(known.get(q), q) for q in range(len(slot.kids))]

    def along(self, wrapper: Wrapper, slot: Slot) -> None:
        for known, q in self.pairs(wrapper, slot):
            kid = slot.kids[q]
            if known is None:
                if not (never(kid.sign) or marked(kid.sign) or links(kid) > volume(kid)):
                    self.chosen += [node for node, _ in slot.runs[q]]
                    self.found += volume(kid)
                continue
            if known.decision == DROPPED or (known.decision == CONSTANT and known.text == kid.text):
                continue
            for node, own in slot.runs[q]:
                if known.decision == PATH:
                    self.along(known, own)
                else:
                    self.chosen.append(node)
                    self.inside(known, own)
                    self.found += volume(own)

    def inside(self, wrapper: Wrapper, slot: Slot) -> None:
        if not wrapper.kids:
            return
        for known, q in self.pairs(wrapper, slot):
            run = slot.runs[q]
            if known is None:
                continue
            if known.decision == DROPPED or (known.decision == CONSTANT and known.text == slot.kids[q].text):
                self.left_out.update(id(node) for node, _ in run)
            elif known.decision == KEPT:
                if marked(known.sign):
                    self.spared.update(id(node) for node, _ in run)
                for _, own in run:
                    self.inside(known, own)

    def text(self) -> str:
        out: list[str] = []
        for node in self.chosen:
            self.blocks(node, out)
        return "\n".join(out)

    def apart(self, node: Node) -> bool:
        return id(node) in self.left_out or never(node.sign) or (id(node) not in self.spared and marked(node.sign))

    def blocks(self, node: Node, out: list[str]) -> None:
        """Appends the node's blocks: runs of inline content between block borders, white space collapsed."""
        pending: list[str] = []

        def close() -> None:
            if text := " ".join("".join(pending).split()):
                out.append(text)
            pending.clear()

        def walk(one: Node) -> None:
            for part in one.parts:
                if isinstance(part, str):
                    pending.append(part)
                elif part.tag == "br" or part.tag == "wbr":
                    pending.append(" " if part.tag == "br" else "")
                elif self.apart(part):
                    if part.tag in BLOCKS:
                        close()
                elif part.tag in BLOCKS:
                    close()
                    walk(part)
                    close()
                else:
                    if part.tag in ("td", "th"):
                        pending.append(" ")
                    walk(part)

        walk(node)
        close()


def volume(slot: Slot) -> int:
    return slot.chars + sum(volume(k) for k in slot.kids if not never(k.sign))


def links(slot: Slot) -> int:
    return slot.links + sum(links(k) for k in slot.kids if not never(k.sign))


def extracted(html: str, wrapper: Wrapper | None) -> str:
    """The main text of a page under the wrapper of its host; without one, or where it does not fit, under its own."""
    root = parse(html)
    slot = fold(root, 0)
    done = Extraction(wrapper, slot, root) if wrapper is not None else None
    if done is None or not done.found:
        done = Extraction(Wrapper(wrapper_of(slot)), slot, root)
    return done.text()


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[bytes, Wrapper] = {}
    for batch in common.slices(batches, "html"):
        texts = []
        for html, template in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist(), strict=True):
            if len(known) > 2_000:
                known.clear()
            if template and template not in known:
                known[template] = Wrapper(json.loads(template))
            texts.append(extracted(html, known.get(template)) if html else "")
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, "://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def extract_pages(df: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text (blocks of the article in page order, joined by a line feed)."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = common.small_batches(df).select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    partial = rows.select("host", "html").mapInArrow(_induce, "host string, salt int, template binary")
    partial = partial.groupBy("host", "salt").applyInArrow(_merge(False), "host string, template binary")
    templates = common.staged(partial.groupBy("host").applyInArrow(_merge(True), "host string, template binary"), "page-wrappers")
    out = rows.join(templates, "host", "left").select("id", "url", "html", "template").mapInArrow(_extract, f"id {kind}, url string, text string")
    return out.withColumnsRenamed({"id": id_col, "url": url_col})
