"""Main text of web pages by wrappers: union-free regular expressions inferred for each host.

A page becomes a tree of block elements with text slots. The wrapper of a host is a tree of the same kind whose
members are single, optional or repeated: equal neighbours collapse into a repeated group, and where a page and
the wrapper disagree, the members that only one of them has become optional. Text that differs between pages is
a slot, text that is the same on all of them stays a constant. Wrappers of parts of a host merge like pages, so
they are folded in the scan, repeated results are dropped, and the rest meet in one small group for each host.

The wrapper chooses the region with the main text on every page: from the page down to the innermost single
element that holds most of the text that varies. A single ``article`` or ``main`` element is a hint and counts
``HINT`` times its text; a repeated or optional one is no hint. A page without its host's region, or of a host
with fewer than ``MIN_PAGES`` pages, is its own wrapper. An article below the region is a card or a reader comment:
inside an article it always goes, elsewhere as ``without_cards`` says. Menus, headers, footers, asides, forms, adverts,
notices, comments and scripts are left out by their element, class, id or role, and outside an article also the
host's constants (one text in one place on three pages or more). A class or id counts by its last part, so
``content has-related`` is no mark; an ``article`` or ``main`` element never falls for its own class or id, and a
marked element stays if it is its host's main region.

Neighbours that recur as a run of up to four labels fold into a repeated group; more than ``MAX_MEMBERS`` members
fold their recurring labels into one group, and very wide members align by label. So merging takes time in
proportion to a page.

Scale: wrappers are folded in the scan, merged in two rounds and reduced to a path and constants. Those are
broadcast if they measure up to ``BROADCAST_BYTES``; else both sides meet by (host, salt), so that a host with a
third of all pages is spread.

Result: blocks in page order joined by two line ends; character references decoded, white space in a block
turned into one space. Defined results: a null or empty page, or one without main text, gives an empty text; a
null url, or one without ``://``, belongs to the host without a name; markup cut off anywhere is read as far as
it goes; repeated rows are extracted each; extra columns are ignored; nesting beyond ``MAX_DEPTH`` elements
shares the path of the last one, its text is kept.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.tables import written
from rankloom.llm.url_filter import with_parts

MAX_DEPTH, MAX_MEMBERS, MAX_CELLS = 40, 64, 40_000
MIN_PAGES, HINT, SHARE = 3, 2, 0.7
BROADCAST_BYTES, SALTS = 64 << 20, 32
CONTAINERS = frozenset("html body div section article main center table tbody tr td".split())
PLAIN = frozenset(["article", "main", "body", "html"])
# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img br".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
             "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
# Elements that hold no main text; no standard fixes the words of classes, ids and roles below, they are a list of this module.
LEFT_OUT = frozenset(
    "head nav aside footer form menu dialog button select script style noscript template iframe svg object canvas "
    "textarea title audio video math".split())
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promotion promoted "
    "banner banners nav navbar navigation menu menus sidebar sidebars aside rail footer masthead topbar cookie cookies "
    "consent gdpr notice notices alert alerts comment comments commentlist disqus respond reply replies discussion "
    "related recommended recommendations share sharing social newsletter subscribe subscription signup login search "
    "breadcrumb breadcrumbs pagination pager popup modal overlay toolbar widget widgets complementary contentinfo "
    "skip hidden form".split())
# Parts that only say where or how a marked element is held, and parts that speak of another element.
HOLDERS = frozenset(
    "area container wrapper wrap box bar block list link links button buttons section inner outer holder content left right top bottom main".split())
OF_OTHERS = frozenset("no not has have with without".split())
TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


def last_part(token: str) -> str:
    """What a class, id or role names: the whole of it or its last part, without the words for a mere holder."""
    if token.lower() in MARKS:
        return token.lower()
    parts = [w.lower() for w in WORD.findall(token)]
    if OF_OTHERS.intersection(parts):
        return ""
    while len(parts) > 1 and parts[-1] in HOLDERS:
        parts.pop()
    return parts[-1] if parts else ""


def label_marked(label: str) -> bool:
    """Whether the classes of a wrapper's label mark it as left out."""
    name, *classes = label.split(".")
    return name not in ("article", "main", "body", "html") and any(last_part(c) in MARKS for c in classes)


class Element:
    """An open element. inside is 2 in an article, 1 in a main element, else 0; out marks what is left out, and
    sure what is left out by more than a class, id or role."""

    __slots__ = ("name", "label", "out", "sure", "inside", "path", "chain")

    def __init__(self, name: str, attributes: str, parent: Element | None) -> None:
        words: list[str] = []
        ends: set[str] = set()
        shown = []
        if attributes:
            for kind, *values in ATTRIBUTE.findall(attributes):
                value = next((v for v in values if v), "")
                words += [w.lower() for w in WORD.findall(value)]
                if name not in ("article", "main") or kind.lower() == "role":
                    ends.update(map(last_part, value.split()))
                if kind.lower() == "class" and value and name not in PLAIN:
                    shown = sorted(re.sub(r"\d+", "0", value.lower()).split())
        self.name = name
        self.label = ".".join([name, *shown])
        own = 2 if name == "article" else 1 if name == "main" or ("main" in words and name in ("div", "section")) else 0
        self.inside = max(own, parent.inside if parent is not None else 0)
        sure = name in LEFT_OUT or bool(attributes and HIDDEN.search(attributes)) or (name == "header" and not self.inside)
        left = sure or bool(MARKS.intersection(ends)) or ("header" in ends and not self.inside)
        if name in ("body", "html"):
            left = sure = False
        self.out = left or (parent is not None and parent.out)
        self.sure = sure or (parent is not None and parent.sure)
        if parent is None or len(parent.path) < MAX_DEPTH:
            self.path = (*(parent.path if parent else ()), self.label)
            self.chain = (*(parent.chain if parent else ()), self)
        else:
            self.path, self.chain = parent.path, parent.chain


class Block(NamedTuple):
    """Text of one block and the innermost element around it."""

    at: Element
    text: str


def blocks_of(page: str | None) -> list[Block]:
    """Every block with text, in page order."""
    found: list[Block] = []
    root = Element("#page", "", None)
    stack = [root]
    pieces: list[str] = []

    def flush() -> None:
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            pieces.clear()
            if text:
                found.append(Block(stack[-1], text))

    def close(name: str) -> None:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name == name:
                flush()
                del stack[k:]
                return

    page = page or ""
    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None:
            pieces.append(page[at:])
            break
        if m.start() > at:
            pieces.append(page[at:m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = m[1] or m[4], m[3] or m[6] or ""
        if name in INLINE:
            if name == "br":
                pieces.append(" ")
            elif attributes and not closing and Element(name, attributes, None).out:
                at = _skip_inline(page, at, name)
            continue
        if closing:
            if name == "p" and not any(e.name == "p" for e in stack):
                flush()
            close(name)
            continue
        if name in CLOSES_P and stack[-1].name == "p":
            close("p")
        for other in CLOSED_BY.get(name, ()):
            if stack[-1].name == other:
                close(other)
        flush()
        if name in VOID:
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if not attributes.rstrip().endswith("/") or name not in ("path", "use"):
            stack.append(Element(name, attributes, stack[-1]))
    flush()
    return found


def _skip_inline(page: str, at: int, name: str) -> int:
    """End of an inline element whose class marks it as left out."""
    depth = 1
    for m in re.finditer(rf"<(/?){re.escape(name)}\b[^>]*>", page[at:], re.I):
        depth += -1 if m[1] else 1
        if not depth:
            return at + m.end()
    return at


# A wrapper is [label, kind, members]; kind is "1", "?", "+" or "*". A text slot is ["#text", kind, constant or
# None, characters].


def wrapper_of(blocks: list[Block]) -> list:
    root: list = ["#page", "1", []]
    trail: list[list] = [root]
    last: tuple[Element, ...] = blocks[0].at.chain[:1] if blocks else ()
    for at, text in blocks:
        same = 1
        while same < min(len(at.chain), len(last)) and at.chain[same] is last[same]:
            same += 1
        del trail[same:]
        for element in at.chain[same:]:
            node = [element.label, "1", []]
            trail[-1][2].append(node)
            trail.append(node)
        trail[-1][2].append(["#text", "1", text, len(text)])
        last = at.chain
    return _collapsed(root)


def _more(kind: str, other: str, optional: bool = False, repeated: bool = False) -> str:
    many = repeated or "+" in kind + other or "*" in kind + other
    maybe = optional or "?" in kind + other or "*" in kind + other
    return ("*" if maybe else "+") if many else ("?" if maybe else "1")


def _collapsed(node: list) -> list:
    """Equal neighbours become one repeated member, recurring runs of members a repeated group."""
    if node[0] == "#text":
        return node
    members: list[list] = []
    for member in map(_collapsed, node[2]):
        if members and members[-1][0] == member[0]:
            members[-1] = merged(members[-1], member, repeated=True)
        else:
            members.append(member)
    return [node[0], node[1], _bounded(_runs(members))]


def _group(members: list[list]) -> list:
    return ["#(" + " ".join(m[0] for m in members) + ")", "+", members]


def _runs(members: list[list]) -> list[list]:
    """Runs of two to four members that stand twice or more in a row become one group."""
    labels = [m[0] for m in members]
    out, i = [], 0
    while i < len(members):
        for period in (2, 3, 4):
            first, end = labels[i:i + period], i + period
            while len(first) == period and labels[end:end + period] == first:
                end += period
            if end > i + period:
                held = members[i:i + period]
                for k in range(i + period, end):
                    held[(k - i) % period] = merged(held[(k - i) % period], members[k])
                out.append(_group(held))
                i = end
                break
        else:
            out.append(members[i])
            i += 1
    return out


def _bounded(members: list[list]) -> list[list]:
    """More than MAX_MEMBERS members: the labels that recur between two others become one group of optional members."""
    if len(members) <= MAX_MEMBERS:
        return members
    uses = Counter(m[0] for m in members)
    out: list[list] = []
    held: dict[str, list] = {}

    def close() -> None:
        if held:
            out.append(_group([held[k] for k in sorted(held)]) if len(held) > 1 else next(iter(held.values())))
            held.clear()

    for m in members:
        if uses[m[0]] == 1:
            close()
            out.append(m)
        else:
            held[m[0]] = merged(held[m[0]], m, repeated=True) if m[0] in held else _optional(m)
    close()
    return out


def merged(a: list, b: list, repeated: bool = False) -> list:
    """The wrapper that fits whatever either fits; both have the same label."""
    kind = _more(a[1], b[1], repeated=repeated)
    if a[0] == "#text":
        return ["#text", kind, a[2] if a[2] == b[2] else None, a[3] + b[3]]
    left, right = a[2], b[2]
    if [m[0] for m in left] == [m[0] for m in right]:
        return [a[0], kind, [merged(x, y) for x, y in zip(left, right, strict=True)]]
    members = _aligned(left, right) if len(left) * len(right) <= MAX_CELLS else _by_label(left, right)
    joined: list[list] = []
    for m in members:
        if joined and joined[-1][0] == m[0]:
            joined[-1] = merged(joined[-1], m, repeated=True)
        else:
            joined.append(m)
    return [a[0], kind, joined]


def _by_label(left: list[list], right: list[list]) -> list[list]:
    """Members in the order of their first appearance; what one side lacks is optional."""
    mine, theirs = ({}, {})
    for side, members in ((mine, left), (theirs, right)):
        for m in members:
            side[m[0]] = merged(side[m[0]], m, repeated=True) if m[0] in side else m
    return [merged(mine[k], theirs[k]) if k in mine and k in theirs else _optional(mine.get(k) or theirs[k]) for k in {**mine, **theirs}]


def _aligned(left: list[list], right: list[list]) -> list[list]:
    """Longest common run of labels; members of one side only become optional."""
    size = [[0] * (len(right) + 1) for _ in range(len(left) + 1)]
    for i in range(len(left) - 1, -1, -1):
        for j in range(len(right) - 1, -1, -1):
            size[i][j] = size[i + 1][j + 1] + 1 if left[i][0] == right[j][0] else max(size[i + 1][j], size[i][j + 1])
    members, i, j = [], 0, 0
    while i < len(left) or j < len(right):
        if i < len(left) and j < len(right) and left[i][0] == right[j][0]:
            members.append(merged(left[i], right[j]))
            i, j = i + 1, j + 1
        elif j == len(right) or (i < len(left) and size[i + 1][j] >= size[i][j + 1]):
            members.append(_optional(left[i]))
            i += 1
        else:
            members.append(_optional(right[j]))
            j += 1
    return members


def _optional(node: list) -> list:
    return [node[0], _more(node[1], "1", optional=True), *node[2:]]


def expression(node: list) -> str:
    """The wrapper in writing: a union-free regular expression over elements and text."""
    mark = {"1": "", "?": "?", "+": "+", "*": "*"}[node[1]]
    if node[0] == "#text":
        return ("#TEXT" if node[2] is None else repr(node[2])) + mark
    inner = " ".join(map(expression, node[2]))
    if node[0].startswith("#("):
        return f"({inner}){mark}"
    return f"({node[0]}: {inner}){mark}" if mark else f"{node[0]}: {inner}"


def region_of(wrapper: list, fixed: set[str] | None = None) -> tuple[tuple[str, ...], set[str]]:
    """Path of the element with the main text, and the constants of the host.

    ``fixed`` is for a page that is its own wrapper: its texts count as varying but for these.
    """
    constants: set[str] = set()

    def gather(node: list) -> None:
        if node[0] == "#text":
            if node[2] and node[3] >= MIN_PAGES * len(node[2]):
                constants.add(node[2])
        else:
            for m in node[2]:
                gather(m)

    if fixed is None:
        gather(wrapper)
    same = constants if fixed is None else fixed

    def mass(node: list, marked_too: bool, constant_too: bool) -> int:
        if node[0] == "#text":
            return node[3] if node[2] is None or constant_too or (not marked_too and node[2] not in same) else 0
        if node[0].split(".")[0] in LEFT_OUT or (not marked_too and label_marked(node[0])):
            return 0
        return (HINT if _hint(node) else 1) * sum(mass(m, marked_too, constant_too) for m in node[2])

    # A marked element is the main region only where no other text varies and its own text differs between pages.
    for how in ((False, False), (True, False), (False, True)) if fixed is None else ((False, False), (False, True)):
        total = mass(wrapper, *how)
        if total:
            break
    path, node = (wrapper[0],), wrapper
    while total:
        inner = [m for m in node[2] if holds_blocks(m[0]) and "+" not in m[1] and "*" not in m[1]]
        # The hint of an element weighs against its siblings, not against what it holds.
        weight = {id(m): mass(m, *how) for m in node[2]}
        best = next((m for m in inner if weight[id(m)] and weight[id(m)] >= SHARE * sum(weight.values())), None)
        if best is None:
            break
        node = best
        path = (*path, node[0])
        if _hint(node) and node[0] == "article":
            break
    return path, set() if how[1] else constants


def holds_blocks(label: str) -> bool:
    """Elements that can be a region; a long paragraph is not one, for its title stands beside it."""
    name = label.split(".")[0]
    return name in CONTAINERS or ("-" in name and name[0] != "#")


def _hint(node: list) -> bool:
    return node[0] in ("article", "main") and node[1] == "1"


def main_text(blocks: list[Block], region: tuple[str, ...] | None = None, constants: set[str] = frozenset()) -> str:
    """Text of the region; without one, or where the page lacks it, the page is its own wrapper."""
    found = _in_region(blocks, region, constants) if region else []
    if not found and blocks:
        own, _ = region_of(wrapper_of(blocks), set(constants))
        found = _in_region(blocks, own, constants) or _in_region(blocks, own, frozenset())
    return "\n\n".join(b.text for b in found)


def _in_region(blocks: list[Block], region: tuple[str, ...], constants: set[str]) -> list[Block]:
    inside = [b for b in blocks if b.at.path[:len(region)] == region]
    kept = [b for b in inside if not b.at.out]
    if not kept and any(map(label_marked, region)):
        kept = [b for b in inside if not b.at.sure]
    if not kept:
        # An article or main element under a class that marks it is better than nothing.
        kept = [b for b in inside if b.at.inside and not b.at.sure]
    if not {"article", "main"}.intersection(region):
        kept = [b for b in kept if b.text not in constants]
    return without_cards(kept, region)


def without_cards(kept: list[Block], region: tuple[str, ...]) -> list[Block]:
    """The region without its articles, if it is an article, or if they are cards next to the main text.

    One article with more text than all the rest is the main text. Otherwise articles are cards, unless the
    rest has less than a quarter of their text: then they make up the page and stay, without articles nested in them.
    """
    def articles(b: Block) -> list[Element]:
        return [e for e in b.at.chain[len(region):] if e.name == "article"]

    held = [(b, articles(b)) for b in kept]
    rest = [b for b, cards in held if not cards]
    if len(rest) == len(kept):
        return kept
    if "article" in region and rest:
        return rest
    outer = [b for b, cards in held if len(cards) == 1]
    of_cards, of_rest = (sum(len(b.text) for b in side) for side in (outer, rest))
    if of_cards > of_rest and len({id(cards[0]) for _, cards in held if cards}) == 1:
        return outer or kept
    if 4 * of_rest >= of_cards and rest:
        return rest
    return [b for b, cards in held if len(cards) < 2]


def wrappers(pages: DataFrame, page: str = "html") -> DataFrame:
    """(host, wrapper): one JSON wrapper for each host, from all its pages, with the number of pages."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[str, list] = {}
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = wrapper_of(blocks_of(text))
                held[host] = [merged(held[host][0], own), held[host][1] + 1] if host in held else [own, 1]
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([json.dumps(w) for w, _ in held.values()], pa.string()),
                                              pa.array([n for _, n in held.values()], pa.int64())], names=["host", "wrapper", "pages"])

    def merge(group: pa.Table) -> pa.Table:
        parts = sorted(zip(group.column("wrapper").to_pylist(), group.column("pages").to_pylist(), strict=True))
        whole = json.loads(parts[0][0])
        for text, _ in parts[1:]:
            whole = merged(whole, json.loads(text))
        return pa.table([[group.column("host")[0].as_py()], [json.dumps(whole)], [sum(n for _, n in parts)]],
                        schema=pa.schema([("host", pa.string()), ("wrapper", pa.string()), ("pages", pa.int64())]))

    schema = "host string, wrapper string, pages long"
    parts = pages.select("host", page).mapInArrow(fold, schema)
    # Two rounds: a host with very many parts is merged in pieces first.
    some = parts.withColumn("_piece", F.pmod(F.xxhash64("wrapper"), F.lit(16))).groupBy("host", "_piece").applyInArrow(
        lambda key, group: merge(group), schema)
    return some.groupBy("host").applyInArrow(merge, schema)


def regions(pages: DataFrame, page: str = "html") -> DataFrame:
    """(_host, region, constants) of the hosts with at least MIN_PAGES pages."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [region_of(json.loads(w)) for w in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([list(p) for p, _ in found], pa.list_(pa.string())),
                                              pa.array([sorted(c) for _, c in found], pa.list_(pa.string()))], names=["_host", "region", "constants"])

    learned = wrappers(pages, page).where(F.col("pages") >= MIN_PAGES).select("host", "wrapper")
    return learned.mapInArrow(run, "_host string, region array<string>, constants array<string>")


def extract(pages: DataFrame, url: str = "url", page: str = "html", page_id: str = "page_id",
            broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """page_id, url, text, n_chars."""
    rows = with_parts(pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(page).alias("html")))
    learned = written(regions(rows))
    size = learned.agg(F.coalesce(F.sum(F.length("_host") + F.length(F.array_join("region", "")) + F.length(F.array_join("constants", ""))
                                        + 16 * F.size("constants") + 64), F.lit(0))).first()[0] * 4
    if size <= broadcast_bytes:
        joined = rows.join(F.broadcast(learned), rows["host"] == learned["_host"], "left")
    else:
        salted = learned.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        own_salt = rows.withColumn("_own", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("int"))
        joined = own_salt.join(salted, (own_salt["host"] == salted["_host"]) & (own_salt["_own"] == salted["_salt"]), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[tuple[str, ...] | None, set[str]]] = {}
        for batch in batches:
            texts = []
            for k, (source, host) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                if host not in known:
                    if len(known) >= 256:
                        known.clear()
                    path, fixed = batch.column(4)[k].as_py(), batch.column(5)[k].as_py()
                    known[host] = tuple(path) if path else None, set(fixed or ())
                texts.append(main_text(blocks_of(source), *known[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    columns = joined.select("page_id", "url", "html", "host", "region", "constants")
    return columns.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html"))
