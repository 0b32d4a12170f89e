"""Main text of web pages by wrappers, union-free regular expressions inferred for each host.

A page is a stream of tags and texts. Its elements are labelled by tag, class and id (digits aside;
nameless containers also by the kinds of their children), and the streams of a host are aligned at
equal labels under equal parents. Where they differ, the wrapper gets an optional group (an element
that some pages lack), a repeated group (one that occurs again under its parent) or a text slot
(text that is not the same on every page). The alignment is a sum: each task folds its pages into
one count per host and element, and the counts of the tasks are added, so every page of a host takes
part however many there are, and a host with a third of all pages is as many rows as any other.

In the wrapper, elements that are menus, headers, footers and so on by tag, role or class are set
aside with all below them. The main part is the article or main element if there is one, and else the
smallest element that holds most of the host's text that varies. A page's main text is then read off
the slots of that part. A page of a rarer template, whose own article or main element holds more text
than its share of that part, has the text of that element as well. On a page without any, the text is
read off all slots that are not set aside.

Defined cases: a null or empty html gives an empty text; a null url, or one without a host, belongs to
a host of its own kind (""); unclosed and stray tags are tolerated; rows that repeat a page give a row
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.storage import stage
from tidemark.llm.words import map_batches

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^<>]*)>", re.S)
NAMES = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
RAW = {"script", "style", "xmp", "noembed", "noframes"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("html head body title main article section nav header footer aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption form fieldset legend address details summary hgroup center menu dialog select option optgroup textarea button noscript template iframe object svg math canvas video audio map".split())
ASIDE = set("head title nav footer aside form fieldset menu dialog select option optgroup textarea button noscript template iframe object svg math canvas video audio map".split())
ROLES = set("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
ASIDE_WORDS = set("nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert warning popup modal overlay newsletter subscribe subscription signup login social share sharing related recommended recommendations more comment comments disqus respond reply replies discussion pagination pager toolbar search copyright legal disclaimer skip tags".split())
MAIN_WORDS = set("content article post entry story main body text".split())
LEAVES = set("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote td th figcaption caption".split())
NAMELESS = {"div", "section", "td", "center"}
#: What an opening tag ends: the element, if it is open inside the nearest of the others.
ENDS = {"li": ("li", {"ul", "ol", "menu"}), "dt": ("dd", {"dl"}), "dd": ("dt", {"dl"}), "tr": ("tr", {"table"}), "td": ("td", {"tr", "table"}), "th": ("th", {"tr", "table"}), "option": ("option", {"select"})}


class Element:
    __slots__ = ("tag", "names", "aside", "main", "kids", "inline")

    def __init__(self, tag: str, names: str = "", aside: int = 0, main: bool = False, inline: bool = False):
        self.tag, self.names, self.aside, self.main, self.inline = tag, names, aside, main, inline
        self.kids: list = []  # elements, and (text, whether it is a link) in order

    def label(self) -> str:
        if self.names or self.tag not in NAMELESS:
            return self.tag + self.names
        return f"{self.tag}[{','.join(sorted({k.tag if isinstance(k, Element) else '#' for k in self.kids}))}]"


_described: dict[tuple[str, str], tuple[str, int, bool]] = {}


def describe(tag: str, attributes: str) -> tuple[str, int, bool]:
    """Names for the label; 2 if the tag sets it aside, 1 if a class or role does; whether it says main."""
    if (tag, attributes) in _described:
        return _described[tag, attributes]
    names, words, aside, main = [], set(), 2 * (tag in ASIDE), tag in ("article", "main")
    for m in NAMES.finditer(attributes):
        key, value = m[1].lower(), entities.unescape(m[2] or m[3] or m[4] or "")
        if key in ("class", "id"):
            names += [("." if key == "class" else "#") + re.sub(r"\d+", "N", x) for x in value.split()]
            words |= {x.lower() for x in PART.findall(value)}
        elif key == "role":
            aside, main = max(aside, value.lower() in ROLES), main or value.lower() in ("main", "article")
        elif key == "itemprop":
            main = main or value.lower() == "articlebody"
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            aside = 2
    if words & ASIDE_WORDS and tag not in ("html", "body", "main", "article"):
        aside = max(aside, 1)
    if tag == "article" and words & {"comment", "reply", "teaser", "related", "promo"}:
        aside, main = 2, False
    if len(_described) > 50_000:
        _described.clear()
    out = _described[tag, attributes] = ("".join(sorted(names)), aside, main)
    return out


def parse(html: str) -> Element:
    """The tree of a page; inline tags are left out but for those set aside."""
    root = Element("page")
    stack, at, link, end = [root], 0, False, len(html)
    lower = None

    def text(a: int, b: int) -> None:
        if b > a:
            stack[-1].kids.append((html[a:b], link))

    while m := TOKEN.search(html, at):
        text(at, m.start())
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closes, attributes = tag.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closes:
            if tag == "a":
                link = False
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    link = link and tag not in BLOCKS
                    break
                if tag not in BLOCKS and not stack[k].inline:
                    break
            else:
                if tag == "p":
                    stack[-1].kids.append(Element("p"))
            continue
        if tag in RAW:
            lower = lower or html.lower()
            k = lower.find("</" + tag, at)
            at = end if k < 0 else k
            continue
        if tag in VOID:
            if tag in ("br", "hr"):
                stack[-1].kids.append((" ", link))
            continue
        names, aside, main = describe(tag, attributes)
        if tag not in BLOCKS:
            link = link or tag == "a"
            if aside and not attributes.rstrip().endswith("/"):
                stack[-1].kids.append(e := Element(tag, names, aside, main, inline=True))
                stack.append(e)
            continue
        link = False
        while stack[-1].inline:
            stack.pop()
        if stack[-1].tag == "p":
            stack.pop()
        if tag in ENDS:
            other, bounds = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in bounds:
                    break
                if stack[k].tag in (tag, other):
                    del stack[k:]
                    break
        stack[-1].kids.append(e := Element(tag, names, aside, main))
        if not attributes.rstrip().endswith("/") or tag not in ("svg", "iframe"):
            stack.append(e)
    text(at, end)
    return root


_ids: dict[tuple[int, str], int] = {}


def child_id(parent: int, label: str) -> int:
    key = (parent, label)
    if key not in _ids:
        if len(_ids) > 200_000:
            _ids.clear()
        _ids[key] = int.from_bytes(blake2b(f"{parent}/{label}".encode(), digest_size=8).digest(), "big", signed=True)
    return _ids[key]


def slots(root: Element) -> Iterator[tuple[int, int, Element, str]]:
    """Number, parent's number, element and label of every element, in page order."""
    todo = [(root, 0, 0)]
    while todo:
        e, number, parent = todo.pop()
        yield number, parent, e, e.label()
        todo += [(k, child_id(number, k.label()), number) for k in reversed(e.kids) if isinstance(k, Element)]


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))


NODES = "host string, node long, parent long, label string, tag string, aside int, main boolean, pages long, repeated boolean, size long, links long, low long, high long, place double"


def elements(pages: DataFrame) -> DataFrame:
    """The wrapper's elements: one row per host and element, from all pages of the host."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], list] = {}
        for batch in batches:
            for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own: dict[int, list] = {}
                for place, (number, parent, e, label) in enumerate(slots(parse(html or ""))):
                    size = linked = check = 0
                    for k in e.kids:
                        if not isinstance(k, Element) and (n := len(k[0].strip())):
                            size += n
                            linked += n * k[1]
                            check = zlib.crc32(k[0].encode("utf-8", "replace"), check)
                    if number in own:
                        x = own[number]
                        x[6] = True
                        x[7] += size
                        x[8] += linked
                        x[9], x[10] = min(x[9], check), max(x[10], check)
                    else:
                        own[number] = [parent, label, e.tag, e.aside, e.main, 1, False, size, linked, check, check, float(place)]
                for number, x in own.items():
                    if y := seen.get((host, number)):
                        y[5] += 1
                        y[6] |= x[6]
                        y[7] += x[7]
                        y[8] += x[8]
                        y[9], y[10], y[11] = min(y[9], x[9]), max(y[10], x[10]), y[11] + x[11]
                    else:
                        seen[host, number] = x
                if len(seen) > 50_000:
                    yield rows(seen)
                    seen = {}
        yield rows(seen)

    def rows(seen: dict) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        columns = list(zip(*((*k, *v) for k, v in seen.items()), strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [x.split()[0] for x in NODES.split(", ")])

    made = map_batches(pages.select("host", "html"), run, NODES)
    first = [F.first(c).alias(c) for c in ("parent", "label", "tag", "aside", "main")]
    sums = [F.sum("pages").alias("pages"), F.bool_or("repeated").alias("repeated"), F.sum("size").alias("size"), F.sum("links").alias("links"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("place").alias("place")]
    return made.groupBy("host", "node").agg(*first, *sums)


def wrapper(nodes: pd.DataFrame) -> dict[str, set[int]]:
    """Of a host's elements: those of the main part, all that are not set aside, and of these those of fixed text."""
    by = {r.node: r for r in nodes.itertuples()}
    kids: dict[int, list[int]] = {}
    for r in by.values():
        if r.node:
            kids.setdefault(r.parent, []).append(r.node)
    order, todo = [], [0]
    while todo:
        n = todo.pop()
        order.append(n)
        todo += kids.get(n, [])
    all_pages = by[0].pages if 0 in by else 0

    def fixed(r) -> bool:
        return all_pages >= 3 and r.pages >= 3 and r.low == r.high and not r.repeated

    def weight(r) -> float:  # text that varies; what every page has alike is the template's
        return 0.0 if fixed(r) else float(r.size - r.links)

    def below(off: set[int]) -> dict[int, float]:
        held = {n: 0.0 if n in off else weight(by[n]) for n in order}
        for n in reversed(order):
            if n and by[n].parent in held and n not in off:
                held[by[n].parent] += held[n]
        return held

    def spread(start: set[int]) -> set[int]:
        off: set[int] = set()
        for n in order:
            if n in start or n and by[n].parent in off:
                off.add(n)
        return off

    by_tag = {n for n in order if by[n].aside == 2}
    held = below(spread(by_tag))
    most = held.get(0, 0.0)
    # a class does not set aside what holds most of the text; a header is part of an article
    start = by_tag | {n for n in order if by[n].aside == 1 and held[n] <= 0.6 * most}
    mains = {n for n in order if by[n].main}
    inside: set[int] = set()
    for n in order:
        if n and (by[n].parent in mains or by[n].parent in inside):
            inside.add(n)
    start |= {n for n in order if by[n].tag == "header" and n not in inside}
    off = spread(start)
    held = below(off)
    most = held.get(0, 0.0)
    roots: set[int] = set()
    for tags in (("article",), ("main",), ()):
        found = [n for n in order if by[n].main and n not in off and (not tags or by[n].tag in tags) and held[n] > 0]
        if found:
            top = max(held[n] for n in found)
            if top >= 0.2 * most:
                roots = {n for n in found if held[n] >= 0.2 * top}
                break
    if not roots and order:
        n = 0
        while by[n].tag not in LEAVES:
            best = max((k for k in kids.get(n, []) if k not in off), key=lambda k: held[k], default=None)
            if best is None or held[best] < 0.6 * held[n] or by[best].tag in LEAVES:
                break
            n = best
        roots = {n}
    main: set[int] = set()
    for n in order:
        if n not in off and (n in roots or n and by[n].parent in main):
            main.add(n)
    plain = {n for n in order if n not in off}
    return {"main": main, "plain": plain, "fixed": {n for n in plain if fixed(by[n]) and by[n].size}}


def expression(nodes: pd.DataFrame) -> str:
    """A host's wrapper as a union-free regular expression over tags; #text is a slot, (...)? optional, (...)+ repeated."""
    by = {r.node: r for r in nodes.itertuples()}
    kids: dict[int, list] = {}
    for r in sorted(by.values(), key=lambda r: (r.place / r.pages, r.node)):
        if r.node:
            kids.setdefault(r.parent, []).append(r)

    out: list[str] = []
    todo: list = [by[0]] if 0 in by else []
    while todo:
        r = todo.pop()
        if isinstance(r, str):
            out.append(r)
            continue
        mark = "+" * bool(r.repeated) + "?" * bool(r.node and r.pages < by[r.parent].pages)
        before, after = {"": ("", ""), "+": ("(", ")+"), "?": ("(", ")?"), "+?": ("(", ")*")}[mark]
        out.append(f"{before}<{r.label}>" + ("#text" if r.low != r.high or r.pages < 2 else "#fixed") * bool(r.size))
        todo += [f"</{r.tag}>{after}", *reversed(kids.get(r.node, []))]
    return "".join(out)


def wrappers(pages: DataFrame) -> DataFrame:
    """host, main, plain and fixed (numbers of the elements), wrapper (the expression)."""

    def infer(nodes: pd.DataFrame) -> pd.DataFrame:
        w = wrapper(nodes)
        return pd.DataFrame({"host": [nodes.host.iloc[0]], "main": [sorted(w["main"])], "plain": [sorted(w["plain"])], "fixed": [sorted(w["fixed"])], "wrapper": [expression(nodes)]})

    return elements(pages).groupBy("host").applyInPandas(infer, "host string, main array<long>, plain array<long>, fixed array<long>, wrapper string")


def own_main(root: Element, main: frozenset[int], plain: frozenset[int], fixed: frozenset[int]) -> set[int]:
    """The elements of a page's own article or main element, if it holds more text than what the page has of main."""
    found: list = []  # element, its number, place of its parent
    todo: list = [(root, 0, -1)]
    while todo:
        e, number, up = todo.pop()
        if number in plain:
            found.append((e, number, up))
            todo += [(k, child_id(number, k.label()), len(found) - 1) for k in e.kids if isinstance(k, Element)]
    flagged = [k for k, (e, _, _) in enumerate(found) if e.main]
    if all(found[k][1] in main for k in flagged):
        return set()
    held, known = [0] * len(found), 0
    for k in range(len(found) - 1, -1, -1):
        e, number, up = found[k]
        own = 0 if number in fixed else sum(len(x[0].strip()) for x in e.kids if not isinstance(x, Element) and not x[1])
        known += own * (number in main)
        held[k] += own
        if k:
            held[up] += held[k]
    for tags in (("article",), ("main",), ()):
        share: dict[int, int] = {}
        for k in flagged:
            if not tags or found[k][0].tag in tags:
                share[found[k][1]] = share.get(found[k][1], 0) + held[k]
        top = max(share.values(), default=0)
        if top and top >= 0.2 * held[0]:
            if top <= known:
                return set()
            roots = {n for n, x in share.items() if x >= 0.2 * top}
            inside = [False] * len(found)
            for k, (_, number, up) in enumerate(found):
                inside[k] = number in roots or k > 0 and inside[up]
            return {number for k, (_, number, _) in enumerate(found) if inside[k]}
    return set()


def read_off(root: Element, main: frozenset[int], plain: frozenset[int], fixed: frozenset[int] = frozenset()) -> str:
    """The text in the main elements, block by block; in all plain ones where that is empty."""
    for wanted in (main | own_main(root, main, plain, fixed), plain):
        parts: list[str] = []
        todo: list = [(root, 0)]
        while todo:
            x = todo.pop()
            if isinstance(x, str):
                parts.append(x)
                continue
            e, number = x
            own = number in wanted
            more: list = []
            for k in e.kids:
                if isinstance(k, Element):
                    edge = [] if k.inline else [" "]
                    more += [*edge, (k, child_id(number, k.label())), *edge]
                elif own:
                    more.append(k[0])
            todo += reversed(more)
        if out := " ".join(entities.unescape("".join(parts)).split()):
            return out
    return ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    The wrappers, one row per host, are joined to the pages; Spark broadcasts them where their size
    allows and else joins by host, splitting hosts that are too large.
    """
    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    known = stage(wrappers(rows).select("host", "main", "plain", "fixed"), "wrappers")
    joined = rows.join(known, "host").select("page_id", "url", "html", "main", "plain", "fixed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, sets = [], {}
            for html, *own in zip(batch.column(2).to_pylist(), batch.column(3), batch.column(4), batch.column(5), strict=True):
                key = tuple(x.values.to_numpy().tobytes() for x in own)
                if key not in sets:
                    sets[key] = tuple(frozenset(x.as_py()) for x in own)
                texts.append(read_off(parse(html or ""), *sets[key]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return map_batches(joined, run, f"page_id {kind}, url string, text string, n_chars long")
