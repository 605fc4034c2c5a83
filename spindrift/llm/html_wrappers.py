"""Main text of web pages by wrappers: union-free regular expressions inferred from the pages of each host.

A page is a stream of tags and texts. Aligning it with its host's wrapper so far resolves every mismatch: a tag that
one side lacks starts an optional group, neighbours with the same tag become a repeated group, and texts that differ
become a text slot. Tasks fold the pages they read into one wrapper for each host; those are folded further by host, in
rounds of bounded groups.

The finished wrapper decides by fields. Where the host marks articles, the fields in them are main text; where it does not,
those that are slots and not mostly links are, and texts that all its pages share are the template's. What stands in elements for
navigation, headers, footers, asides and forms is not. Class names are a hint: what they call an advert, a notice or reader comments is left
out, but an article never is, and names that would leave out most of a host's text are not believed. Each page is then
matched against the wrapper, child by child, so that a field is known by its place in the expression and not by its tags alone.

Elements nested more than ``DEEPEST`` deep are told apart by their use alone (main, aside, dropped); their texts are kept or left out like others.
Null and empty html gives empty text; a null url belongs to the host of none. Repeated rows are extracted each. An empty table
gives an empty one, and other columns are not looked at.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindrift.llm.common import dealt_join, shared_dir, text_or_empty, text_parts, written

#: A tag; quotes count after an equals sign only. Without them it ends at the first angle bracket.
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]|=\s*+"[^"]*"|=\s*+'[^']*'|=)*+)>""")
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
RAW = {name: re.compile(rf"</{name}\s*>|\Z", re.I) for name in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "xmp")}
TAG_NAME = re.compile(r"[^.!*^]+")
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: A start tag of the key ends an open element of the value.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that end an open paragraph.
BREAKS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
DROPPED = frozenset("head nav header footer aside form script style noscript template iframe svg canvas object embed select button textarea dialog menu title xmp".split())
MAIN = frozenset(("article", "main"))
HEADING = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
ASIDE_NAMES = re.compile(
    r"(?:^|[-_\s])(?:ad|ads|adv|advert\w*|adsense|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscri\w*|sidebar|side|menu\w*|nav|navbar|navigation|breadcrumbs?"
    r"|masthead|topbar|header|footer|share|sharing|social|related|recommend\w*|widgets?|pagination|pager|toolbar|login|signup|search\w*|skip|hidden)(?:[-_\s]|$)", re.I,
)
COMMENT_NAMES = re.compile(r"(?:^|[-_\s])(?:comments?|commentlist|respond|replies|disqus)(?:[-_\s]|$)", re.I)
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
MAIN_NAMES = re.compile(r"(?:^|[-_\s])(?:article|article-?body|post-?content|entry-?content|main-?content|story-?body|content-?body)(?:[-_\s]|$)", re.I)

DEEPEST = 150
DEEPEST_OF_USE = 250

#: A node of a wrapper: [signature, quantifier, children]; a text field: ["#", quantifier, [checksum or None, characters, characters in links]].
Node = list


def host_of(url_col: str) -> Column:
    """Lower-case host of an address, empty for none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def signature(name: str, attributes: str) -> str:
    """Tag and what its attributes say about its use: ``tag!`` for an aside, ``tag^`` for comments, ``tag*`` for main text; else the class name follows."""
    if not attributes:
        return name
    values = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)}
    names = f"{values.get('class', '')} {values.get('id', '')}".strip()
    role = values.get("role", "").lower()
    hidden = "hidden" in values or values.get("aria-hidden", "").lower() == "true" or "display:none" in values.get("style", "").replace(" ", "").lower()
    if hidden or role in ASIDE_ROLES:
        return f"{name}!"
    if role == "main" or "articlebody" in values.get("itemprop", "").lower() or (names and MAIN_NAMES.search(names)):
        return f"{name}*"
    if names and name not in MAIN and name not in ("html", "body"):
        if COMMENT_NAMES.search(names):
            return f"{name}^"
        if ASIDE_NAMES.search(names):
            return f"{name}!"
    return f"{name}.{re.sub(r'[0-9!*^]+', '', values['class'].split()[0])}" if values.get("class", "").strip() else name


def tag_of(name: str) -> str:
    return TAG_NAME.match(name)[0]


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """("#", text, ""), ("<", name, attributes) and ("/", name, ""), in linear time; contents of raw elements, comments and declarations are left out."""
    at, end, tag = 0, len(html), TAG
    while at < end:
        start = html.find("<", at)
        if start < 0:
            yield "#", html[at:], ""
            return
        if start > at:
            yield "#", html[at:start], ""
        follow = html[start + 1 : start + 2]
        if follow in ("!", "?"):
            stop = html.find("-->", start + 4) + 2 if html.startswith("<!--", start) else html.find(">", start)
            at = end if stop < start + 2 else stop + 1
            continue
        m = tag.match(html, start)
        if m is None and tag is TAG and (follow == "/" or follow.isalpha()):
            if (m := PLAIN_TAG.match(html, start)) is not None:
                tag = PLAIN_TAG  # a quote is left open to the end: from here on quotes don't count
        if m is None:
            if follow.isascii() and follow.isalpha() and html.find(">", start) < 0:
                return  # the page ends inside a tag
            yield "#", "<", ""
            at = start + 1
            continue
        at, name = m.end(), m[2].lower()
        if m[1]:
            yield "/", name, ""
            continue
        yield "<", name, m[3]
        if name in RAW:
            at = RAW[name].search(html, at).end()


def events(html: str) -> Iterator[tuple[str, str]]:
    """("<", signature), (">", ""), ("#", text) or ("br", "") in page order, with every element closed."""
    stack: list[str] = []

    def close(upto: int) -> Iterator[tuple[str, str]]:
        while len(stack) > upto:
            stack.pop()
            yield ">", ""

    known: dict[tuple[str, str], str] = {}
    deeper: dict[str, int] = defaultdict(int)  # open elements below DEEPEST that say nothing about their use
    for kind, name, attributes in tokens(html):
        if kind == "#":
            yield "#", name
            continue
        if kind == "/":
            if deeper[name]:
                deeper[name] -= 1
                yield "br", ""
            elif name in stack:
                yield from close(len(stack) - 1 - stack[::-1].index(name))
            elif name in ("p", "br"):
                yield "br", ""
            continue
        if name in ("br", "hr"):
            if name == "hr" and "p" in stack:
                yield from close(stack.index("p"))
            yield "br", ""
            continue
        if name in VOID or name in RAW:
            continue
        if name in BREAKS_P and "p" in stack:
            yield from close(len(stack) - 1 - stack[::-1].index("p"))
        for other in ENDS.get(name, ()):
            if other in stack and not {"ul", "ol", "dl", "table", "select"} & set(stack[len(stack) - stack[::-1].index(other) :]):
                yield from close(len(stack) - 1 - stack[::-1].index(other))
        if (key := (name, attributes)) not in known:
            known[key] = signature(name, attributes.rstrip("/"))
        of_use = name in DROPPED or name in MAIN or known[key][-1] in "!^*"
        empty = attributes.endswith("/") and (len(attributes) == 1 or attributes[-2] in " \t\n\r\f\"'")  # and no value's own slash
        if len(stack) >= (DEEPEST_OF_USE if of_use else DEEPEST):
            deeper[name] += not empty
            yield "br", ""
            continue
        stack.append(name)
        yield "<", known[key]
        if empty and name not in BREAKS_P:
            yield from close(len(stack) - 1)
    yield from close(0)


def parsed(html: str) -> list:
    """The page as nested nodes [signature, children]; texts are ["#", text], breaks ["br", ""]."""
    root: list = []
    open_ = [root]
    for kind, value in events(html):
        if kind == "<":
            node: list = [value, []]
            open_[-1].append(node)
            open_.append(node[1])
        elif kind == ">":
            open_.pop()
        else:
            open_[-1].append([kind, value])
    return root


def add(children: list[Node], node: Node) -> None:
    """Append a node; neighbours of one signature become a repeated group."""
    if children and children[-1][0] == node[0]:
        children[-1] = merge(children[-1], node)
        if node[0] != "#":
            children[-1][1] = "*" if children[-1][1] in "?*" else "+"
    else:
        children.append(node)


def tree(html: str) -> list[Node]:
    """The page as a wrapper of its own."""

    def wrapped(nodes: list, linked: bool) -> list[Node]:
        out: list[Node] = []
        for name, inner in nodes:
            if name == "#":
                if text := " ".join(inner.split()):
                    add(out, ["#", "1", [zlib.crc32(text.encode("utf-8", "replace")), len(text), len(text) if linked else 0]])
            elif name != "br":
                add(out, [name, "1", wrapped(inner, linked or tag_of(name) == "a")])
        return out

    return wrapped(parsed(html), False)


def merge(a: Node, b: Node) -> Node:
    """Align two nodes of one signature."""
    quantifier = a[1] if a[1] == b[1] else "*" if {a[1], b[1]} & {"*"} or {a[1], b[1]} == {"+", "?"} else "+" if "+" in (a[1], b[1]) else "?"
    if a[0] == "#":
        return ["#", quantifier, [a[2][0] if a[2][0] == b[2][0] else None, a[2][1] + b[2][1], a[2][2] + b[2][2]]]
    return [a[0], quantifier, align(a[2], b[2])]


#: Pairs of equal signatures up to which two sequences are compared in full; places that a greedy match looks ahead.
PAIRS = 50_000
AHEAD = 64


def matching(left: Sequence[str], right: Sequence[str]) -> list[tuple[int, int, int]]:
    """Blocks (i, k, n) of equal signatures in both sequences, in order, with bounded work.

    Short sequences are compared in full. Of long ones the common ends match; then what occurs once in both, as far as its order agrees, parts
    them; gaps are short now, or are matched greedily, each signature with its next place within ``AHEAD``.
    """
    if len(left) * len(right) <= PAIRS or pairs_of(left, right) <= PAIRS:
        return [x for x in SequenceMatcher(None, left, right, autojunk=False).get_matching_blocks() if x[2]]
    found: list[tuple[int, int]] = []  # pairs of places
    gaps = [(0, len(left), 0, len(right))]
    while gaps:
        a, b, c, d = gaps.pop()
        while a < b and c < d and left[a] == right[c]:
            found.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and left[b - 1] == right[d - 1]:
            b, d = b - 1, d - 1
            found.append((b, d))
        if a == b or c == d:
            continue
        if (b - a) * (d - c) <= PAIRS or pairs_of(left[a:b], right[c:d]) <= PAIRS:
            found += [(a + i + x, c + k + x) for i, k, n in SequenceMatcher(None, left[a:b], right[c:d], autojunk=False).get_matching_blocks() for x in range(n)]
            continue
        anchors = unique_pairs(left, right, a, b, c, d)
        if anchors:
            for (i, k), (j, m) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)], strict=True):
                gaps.append((i + 1, j, k + 1, m))
            found += anchors
        else:
            found += greedy(left, right, a, b, c, d)
    blocks: list[tuple[int, int, int]] = []
    for i, k in sorted(found):
        if blocks and (i, k) == (blocks[-1][0] + blocks[-1][2], blocks[-1][1] + blocks[-1][2]):
            blocks[-1] = (*blocks[-1][:2], blocks[-1][2] + 1)
        else:
            blocks.append((i, k, 1))
    return blocks


def pairs_of(left: Sequence[str], right: Sequence[str]) -> int:
    there = Counter(right)
    return sum(n * there[x] for x, n in Counter(left).items())


def unique_pairs(left: Sequence[str], right: Sequence[str], a: int, b: int, c: int, d: int) -> list[tuple[int, int]]:
    """Places of what occurs once in both stretches, the longest sequence of them that ascends in both."""
    here, there = Counter(left[a:b]), Counter(right[c:d])
    at = {right[k]: k for k in range(c, d) if there[right[k]] == 1}
    pairs = [(i, at[left[i]]) for i in range(a, b) if here[left[i]] == 1 and left[i] in at]
    tops: list[int] = []  # the least last place of an ascending sequence of each length
    ends: list[int] = []
    before: list[int] = []
    for n, (_, k) in enumerate(pairs):
        x = bisect_left(tops, k)
        before.append(ends[x - 1] if x else -1)
        tops[x : x + 1], ends[x : x + 1] = [k], [n]
    out, n = [], ends[-1] if ends else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def greedy(left: Sequence[str], right: Sequence[str], a: int, b: int, c: int, d: int) -> list[tuple[int, int]]:
    places: dict[str, list[int]] = {}
    for k in range(c, d):
        places.setdefault(right[k], []).append(k)
    out, at = [], c
    for i in range(a, b):
        known = places.get(left[i], [])
        x = bisect_left(known, at)
        if x < len(known) and known[x] < at + AHEAD:
            out.append((i, known[x]))
            at = known[x] + 1
    return out


def align(a: list[Node], b: list[Node]) -> list[Node]:
    """Align two sequences: what both have is merged, what one lacks becomes optional."""
    left, right = [x[0] for x in a], [x[0] for x in b]
    if left == right:
        return [merge(x, y) for x, y in zip(a, b, strict=True)]
    out: list[Node] = []
    optional = lambda nodes: [[n[0], {"1": "?", "+": "*"}.get(n[1], n[1]), n[2]] for n in nodes]
    i = k = 0
    for j, m, n in [*matching(left, right), (len(a), len(b), 0)]:
        for part in (*optional(a[i:j]), *optional(b[k:m]), *(merge(x, y) for x, y in zip(a[j : j + n], b[m : m + n], strict=True))):
            add(out, part)
        i, k = j + n, m + n
    return out


def main_fields(wrapper: list[Node], pages: int, most_linked: float = 0.5, least_pages: int = 3, least_left: float = 0.25) -> list:
    """The wrapper's groups that lead to main text: [signature, groups, what it has no field for], and ["#", 1] for a field of main text; others are ["#", 0]."""
    varies = pages >= least_pages and any_slot(wrapper)  # copies of one page alone share all

    def label(nodes: list[Node], believed: bool, marked: bool, aside: bool, main: bool, heading: bool, chars: Counter, most_linked: float = most_linked) -> list:
        out = []
        for name, _, inner in nodes:
            if name == "#":
                checksum, n, linked = inner
                keep = not aside and (main or not marked) and (main or marked or not ((checksum is not None and varies) or linked > most_linked * n))
                chars["kept" if keep else "left"] += n
                chars["main"] += n * (main and not aside)
                out.append(["#", int(keep)])
                continue
            tag, use = tag_of(name), name[-1]
            if tag in MAIN and use != "!":
                out.append(group(name, label(inner, believed, marked, aside == "comments", aside != "comments", False, chars, most_linked), aside != "comments", marked, aside == "comments"))
                continue
            off = aside
            if use == "^":
                off = "comments"
            elif not off and ((use == "!" and believed) or (tag in DROPPED and not (tag == "header" and main))):
                off = "aside"
            lead = heading or (tag == "header" and main and not off)
            if lead and not off and tag not in HEADING and tag != "header" and tag not in INLINE and not has_heading(inner):
                off = "aside"  # what a header holds beside the heading
            inside = main or (use == "*" and not off)
            out.append(group(name, label(inner, believed, marked, off, inside, lead and tag not in HEADING, chars, most_linked), inside, marked, off))
        return out

    def group(name: str, inner: list, main: bool, marked: bool, off: bool | str) -> list:
        """A group also says whether what it has no field for is main text: in an article, or where other texts of it are."""
        return [name, inner, int(not off and (main or (not marked and any(x[0] == "#" and x[1] for x in inner))))]

    believed: Counter = Counter()
    label(wrapper, True, False, "", False, False, believed)
    marked = believed["main"] > 0
    with_hints, without_hints = Counter(), Counter()
    found = label(wrapper, True, marked, "", False, False, with_hints)
    if not marked:
        other = label(wrapper, False, False, "", False, False, without_hints)
        if with_hints["kept"] < least_left * without_hints["kept"]:
            return other
        if not with_hints["kept"]:  # all text is in links, so links are no sign of a menu here
            return label(wrapper, True, False, "", False, False, Counter(), 1.0)
    return found


def any_slot(nodes: list[Node]) -> bool:
    return any(inner[0] is None if name == "#" else any_slot(inner) for name, _, inner in nodes)


def has_heading(nodes: list[Node]) -> bool:
    return any(name != "#" and (tag_of(name) in HEADING or has_heading(inner)) for name, _, inner in nodes)


def placed(left: tuple[str, ...], right: tuple[str, ...]) -> list[int]:
    """For each child of a page its place in the wrapper's sequence, -1 for none."""
    if left == right:
        return list(range(len(left)))
    out = [-1] * len(left)
    for i, k, n in matching(left, right):
        out[i : i + n] = range(k, k + n)
    first: dict[str, int] = {}
    for k, name in enumerate(right):
        first.setdefault(name, k)
    return [first.get(left[i], -1) if k < 0 else k for i, k in enumerate(out)]  # a child out of order has the first place of its kind


class Wrapper:
    """A host's labelled wrapper, to match pages with."""

    def __init__(self, fields: list) -> None:
        self.fields = fields
        self.known: dict[tuple[int, tuple[str, ...]], list[int]] = {}

    def main_text(self, html: str) -> str:
        """Texts of the main fields: character references decoded, blocks and white space parted by one space."""
        out: list[str] = []

        def match(nodes: list, groups: list, others: int) -> None:
            runs: list[int] = []  # neighbours of one signature are one repeated group
            names: list[str] = []
            for name, inner in nodes:
                if name != "br" and not (name == "#" and not inner.strip()) and (not names or names[-1] != name):
                    names.append(name)
                runs.append(len(names) - 1)
            key = id(groups), tuple(names)
            if key not in self.known:
                if len(self.known) > 10_000:
                    self.known.clear()
                self.known[key] = placed(tuple(names), tuple(g[0] for g in groups))
            places = self.known[key]
            for (name, inner), run in zip(nodes, runs, strict=True):
                if name == "br":
                    out.append(" ")
                    continue
                group = groups[places[run]] if run >= 0 and places[run] >= 0 else None
                if name == "#":
                    if inner.strip():
                        if group[1] if group is not None and group[0] == "#" else others:
                            out.append(unescape(inner))
                    else:
                        out.append(" ")
                    continue
                block = tag_of(name) not in INLINE
                if block:
                    out.append(" ")
                if group is not None:
                    match(inner, group[1], group[2])
                else:
                    match(inner, NOTHING, others and not (tag_of(name) in DROPPED or name[-1] in "!^"))
                if block:
                    out.append(" ")

        match(parsed(html), self.fields, 0)
        return " ".join("".join(out).split())


NOTHING: list = []


FOLDED = "host string, part long, pages long, wrapper string"


def fold(rows: Iterator[tuple[str, list[Node], int]]) -> dict[str, tuple[list[Node], int]]:
    found: dict[str, tuple[list[Node], int]] = {}
    for host, nodes, pages in rows:
        if host in found:
            before, n = found[host]
            found[host] = align(before, nodes), n + pages
        else:
            found[host] = nodes, pages
    return found


def infer(pages: DataFrame, fan_in: int = 64) -> DataFrame:
    """Return host, pages, wrapper (JSON) per host of rows (host, html)."""

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        found: dict[str, tuple[list[Node], int]] = {}
        for rows, htmls in text_parts(batches, "html"):
            for host, html in zip(rows.column("host").to_pylist(), htmls, strict=True):
                before = found.get(host)
                nodes = tree(html)
                found[host] = (align(before[0], nodes), before[1] + 1) if before else (nodes, 1)
            if len(found) > 10_000:  # many hosts: hand on what there is
                yield rows_of(found, part)
                found = {}
        yield rows_of(found, part)

    def rows_of(found: dict[str, tuple[list[Node], int]], part: int) -> pa.RecordBatch:
        columns = [pa.array(list(found), pa.string()), pa.array([part] * len(found), pa.int64()), pa.array([n for _, n in found.values()], pa.int64()), pa.array([json.dumps(w, separators=(",", ":")) for w, _ in found.values()], pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["host", "part", "pages", "wrapper"])

    def further(table: pa.Table) -> pa.Table:
        rows = zip(table.column("host").to_pylist(), map(json.loads, table.column("wrapper").to_pylist()), table.column("pages").to_pylist(), strict=True)
        found = fold(rows)
        return pa.Table.from_batches([rows_of(found, int(table.column("part")[0].as_py()))])

    folded = pages.mapInArrow(start, FOLDED)
    parts = pages.rdd.getNumPartitions()
    while parts > 1:
        parts = -(-parts // fan_in)
        folded = folded.withColumn("part", F.expr(f"part div {fan_in}")).groupBy("host", "part").applyInArrow(further, FOLDED)
    return folded.select("host", "pages", "wrapper")


#: Labelled wrappers are broadcast only while they take up no more than this; beyond, pages are joined to them by host, those of large hosts dealt out.
BROADCAST_BYTES = 32 << 20


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most_linked: float = 0.5, least_pages: int = 3) -> DataFrame:
    """Return ``id_col``, ``url_col``, text, n_chars per row of ``pages``."""
    rows = pages.select(F.col(id_col).alias("key"), F.col(url_col).alias("address"), host_of(url_col).alias("host"), text_or_empty(html_col).alias("html"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = [json.dumps(main_fields(json.loads(w), n, most_linked, least_pages), separators=(",", ":")) for w, n in zip(batch.column("wrapper").to_pylist(), batch.column("pages").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("pages"), pa.array(fields, pa.string())], ["host", "pages", "fields"])

    labelled = written(infer(rows.select("host", "html")).mapInArrow(label, "host string, pages long, fields string"), f"{shared_dir(pages.sparkSession)}/wrappers")
    size, total = labelled.agg(F.sum(F.octet_length("fields") + F.octet_length("host") + 64), F.sum("pages")).first()
    small = (size or 0) <= BROADCAST_BYTES
    joined = rows.join(F.broadcast(labelled.drop("pages")), "host", "left") if small else dealt_join(rows, labelled, ["host"], "pages", total, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Wrapper] = {}
        for part, htmls in text_parts(batches, "html"):
            texts = []
            for html, fields in zip(htmls, part.column("fields").to_pylist(), strict=True):
                if fields not in known:
                    if len(known) > 200:
                        known = {}
                    known[fields] = Wrapper(json.loads(fields or "[]"))
                texts.append(known[fields].main_text(html))
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("address"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["key", "address", "text", "n_chars"])

    kind = rows.schema["key"].dataType.simpleString()
    out = joined.select("key", "address", "html", "fields").mapInArrow(run, f"key {kind}, address string, text string, n_chars long")
    return out.withColumnsRenamed({"key": id_col, "address": url_col})
