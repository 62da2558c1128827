"""Main text of web pages by wrappers that are inferred from all pages of a host.

A wrapper is a union-free regular expression over block tags and texts. Each page
is one already: runs of equal siblings, and of equal groups of up to four
siblings, fold into repeated groups. Two wrappers align sibling by sibling;
what only one side has becomes optional, what either side repeats becomes
repeated, and texts that differ become slots. Siblings beyond SIBLINGS become one
repeated group of optional ones, each kind once, so a wrapper does not grow with the
pages. Pages of one task are aligned first, then the partial wrappers of each host
in rounds, dealt by host and salt, FAN at a time, so that no task gets more of a
large host.

In the finished wrapper the main region is chosen once for the host: an article
element, else the main element, else a block that is named as content, else the
block with most slot text outside of links. Below it, menus, footers, sidebars,
forms and scripts go by their tags, and elements whose whole class or id says so.
Names that an article may use too (related, share, notice, a word of a longer name)
count only where the wrapper agrees: a text that is the same on all of three or more
pages, one that is mostly links, or, for whole names, one that is optional or
repeated. Paragraphs and headings never go by name. Outside of a region,
where the whole page is searched, texts that are the same on most of three or more
pages go too.

Texts of blocks: references decoded, white space to one space, trimmed; blocks in
page order, joined by a newline. Null html and pages without text give an empty
text. Pages of a null or unreadable url share the host ''. Repeated rows stay.
Elements may be nested as deep as they like; of very deep ones the wrapper has the
first DEPTH, and below these those with names. Columns other than page_id, url and
html are not read.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections.abc import Iterator
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import stored

FAN = 64  # wrappers of a host that one task aligns
SIBLINGS = 24  # siblings of a wrapper before they become one repeated group
KINDS = 64  # kinds of siblings in such a group before their names no longer count
DEPTH = 64
SAME_ON = 3  # pages of which a text that never differs belongs to the template
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>", re.S)
_NAMED = re.compile(r"\b(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_NUMBER = re.compile(r"[0-9]+")

# HTML element classes
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_SCOPES = frozenset("ul ol dl table div article section main body".split())

# what is never main text: elements, and names that say so alone or with evidence
_NEVER = frozenset("head nav footer aside form script style noscript template iframe object svg canvas audio video button select textarea input dialog menu".split())
_SURE = frozenset(
    "nav navbar navigation menu sidebar footer masthead cookie cookies gdpr ad ads adv advert adverts advertisement advertising adsense sponsored comment comments commentlist disqus "
    "breadcrumb breadcrumbs pagination pager newsletter popup".split()
)
_LIKELY = frozenset("banner consent notice notices alert sponsor promo promotion reply replies respond discussion share sharing social related recommend recommended recommendations subscribe subscription modal overlay toolbar widget login signup".split())
_READERS = frozenset("comment comments disqus".split())
_CONTENT_WORDS = frozenset("article articlebody post entry content story text body".split())
_TEXTS = frozenset("p h1 h2 h3 h4 h5 h6".split())


def _key(tag: str, attributes: str) -> str:
    """Tag with its classes, ids, roles and itemprops, without digits; paragraphs and headings have no names."""
    if "=" not in attributes or tag in _TEXTS:
        return tag
    names = {n for m in _NAMED.finditer(attributes) for n in _NUMBER.sub("", (m[2] or m[3] or m[4] or "").lower()).split()}
    return ".".join([tag, *sorted(names)]) if names else tag


def _names(key: str) -> set[str]:
    return set(key.split(".")[1:])


def _words(key: str) -> set[str]:
    return set(_WORD.findall(key.partition(".")[2]))


def _tag(key: str) -> str:
    return key.partition(".")[0]


def _never(key: str, inside: bool) -> bool:
    """Whether an element is never main text, whatever the wrapper says; outside of a region each word of a name counts."""
    tag = _tag(key)
    if tag in _NEVER or (tag == "header" and not inside):
        return True
    if tag in ("html", "body", "main") or "." not in key:
        return False
    if inside:
        return bool(_names(key) & _SURE or _words(key) & _READERS)
    words = _words(key)
    return bool(words & (_SURE | _LIKELY)) or "header" in words


def _doubtful(key: str) -> bool:
    """Whether an element inside a region goes if the wrapper agrees."""
    return "." in key and bool(_words(key) & (_SURE | _LIKELY))


def blocks(page: str) -> tuple[list[tuple[tuple[str, ...], str, int, tuple[int, ...]]], set[tuple[str, ...]]]:
    """(path, text, signs inside links, numbers of the elements of the path) of each block of text, in page order, and the paths of all blocks that the page opens."""
    stack: list[tuple[str, tuple[str, ...], tuple[int, ...]]] = []
    standing: dict[str, int] = {}  # how many elements of a tag are open
    out: list[tuple[tuple[str, ...], str, int, tuple[int, ...]]] = []
    opened: set[tuple[str, ...]] = set()
    parts: list[str] = []
    linked = link = 0
    path: tuple[str, ...] = ()
    numbers: tuple[int, ...] = ()

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append((path, text, min(linked, len(text)), numbers))
            parts.clear()
        linked = 0

    def close(tags: tuple[str, ...], scopes: frozenset[str]) -> None:
        nonlocal path, numbers
        if not any(standing.get(t) for t in tags):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                for x in stack[k:]:
                    standing[x[0]] -= 1
                del stack[k:]
                break
            if stack[k][0] in scopes:
                break
        path, numbers = stack[-1][1:] if stack else ((), ())

    at = 0
    while m := _TAG.search(page, at):
        if m.start() > at:
            parts.append(page[at : m.start()])
            if link:
                linked += m.start() - at
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                link = 0
            if tag in _INLINE:
                continue
            flush()
            close((tag,), frozenset())
        elif tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if tag == "textarea" or tag in ("noscript", "iframe", "title"):
                flush()
            at = end.end() if end else len(page)
        elif tag in _INLINE:
            if tag == "a":
                link = 1
            elif tag == "br":
                parts.append(" ")
        else:
            flush()
            link = 0
            if tag in _CLOSES:
                close(_CLOSES[tag], _SCOPES)
            close(("p",), frozenset(_SCOPES - {"p"}))
            key = _key(tag, m[3])
            if tag in _VOID or m[3].endswith("/") and tag not in _SCOPES:
                continue
            if len(path) < DEPTH or len(path) < 2 * DEPTH and ("." in key or tag in _NEVER):
                path, numbers = (*path, key), (*numbers, m.start())
                opened.add(path)
            stack.append((tag, path, numbers))
            standing[tag] = standing.get(tag, 0) + 1
    if at < len(page):
        parts.append(page[at:])
    flush()
    return out, opened


# A wrapper node is [key, mark, children, pages that have it, signs, signs in links, text]; mark is "", "?", "+" or "*"; key "#" is a text, "()" a group.
# text: checksum of a text that has always been the same; None for a slot.


def page_wrapper(page: str) -> list:
    """The union-free expression of one page."""
    root = ["", "", [], 1, 0, 0, None]
    trail, numbers = [root], ()
    for path, text, linked, elements in blocks(page)[0]:
        k = 0
        while k < min(len(elements), len(numbers)) and elements[k] == numbers[k]:
            k += 1
        del trail[k + 1 :]
        numbers = elements
        for key in path[k:]:
            node = [key, "", [], 1, 0, 0, None]
            trail[-1][2].append(node)
            trail.append(node)
        trail[-1][2].append(["#", "", [], 1, len(text), linked, crc32(text.encode())])
    return _fold(root)


def _fold(node: list) -> list:
    node[2] = _fold_run([_fold(c) for c in node[2]])
    return node


def _fold_run(items: list[list]) -> list[list]:
    """Collapses neighbouring equal siblings, then neighbouring equal groups of two to four."""
    for size in (1, 2, 3, 4):
        out: list[list] = []
        k = 0
        while k < len(items):
            group = items[k : k + size]
            keys, times = [x[0] for x in group], 1
            while len(group) == size and [x[0] for x in items[k + times * size : k + (times + 1) * size]] == keys:
                times += 1
            if times > 1:
                merged = [group]
                for t in range(1, times):
                    merged = [[_union(a, b) for a, b in zip(merged[0], items[k + t * size : k + (t + 1) * size])]]
                if size == 1:
                    merged[0][0][1] = _repeat(merged[0][0][1])
                    out += merged[0]
                else:
                    out.append(["()", "+", merged[0], 1, 0, 0, None])
                k += times * size
            else:
                out.append(items[k])
                k += 1
        items = out
    return items if len(items) <= SIBLINGS else [_bag(items)]


def _bag(items: list[list]) -> list:
    """Siblings as one repeated group that has each kind of them once, all optional; beyond KINDS, kinds are tags."""
    kinds: dict[str, list] = {}
    loose = [c for x in items for c in (x[2] if x[0] == "()" else [x])]
    for name in (lambda k: k, _tag):
        kinds.clear()
        for c in loose:
            key = name(c[0])
            kinds[key] = _union(kinds[key], [key, *c[1:]]) if key in kinds else [key, *c[1:]]
        if len(kinds) <= KINDS:
            break
    return ["()", "*", [[k, _option(n[1]), *n[2:]] for k, n in sorted(kinds.items())], max(x[3] for x in items), 0, 0, None]


def _repeat(mark: str) -> str:
    return "*" if mark in ("?", "*") else "+"


def _option(mark: str) -> str:
    return "*" if mark in ("+", "*") else "?"


def _union(a: list, b: list, other_pages: bool = False) -> list:
    """Two nodes of one key as one, of one page or of different pages; their texts and children aligned."""
    mark = a[1] if a[1] == b[1] else "*" if {"*"} & {a[1], b[1]} or {a[1], b[1]} == {"?", "+"} else max(a[1], b[1])
    return [a[0], mark, align(a[2], b[2], other_pages), a[3] + b[3] if other_pages else max(a[3], b[3]), a[4] + b[4], a[5] + b[5], a[6] if a[6] == b[6] else None]


def align(a: list[list], b: list[list], other_pages: bool = False) -> list[list]:
    """Aligns two lists of siblings by a longest common subsequence of keys; the rest becomes optional."""
    keys = [[(x[0], x[1] == "*" or [c[0] for c in x[2]]) if x[0] == "()" else x[0] for x in side] for side in (a, b)]
    if keys[0] == keys[1]:
        return _fold_run([_union(x, y, other_pages) for x, y in zip(a, b)])
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below, key = best[i], best[i + 1], keys[0][i]
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if key == keys[1][j] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and keys[0][i] == keys[1][j]:
            out.append(_union(a[i], b[j], other_pages))
            i, j = i + 1, j + 1
        elif j == len(b) or i < len(a) and best[i + 1][j] >= best[i][j + 1]:
            out.append([a[i][0], _option(a[i][1]), *a[i][2:]])
            i += 1
        else:
            out.append([b[j][0], _option(b[j][1]), *b[j][2:]])
            j += 1
    return _fold_run(out)


def merge(a: list, b: list) -> list:
    """The wrapper of both sides' pages."""
    return _union(a, b, other_pages=True)


def expression(node: list) -> str:
    """A wrapper written as a regular expression, for people to read."""
    inner = " ".join(expression(c) for c in node[2])
    text = {"#": "#text" if node[6] is None else "#fixed", "()": f"({inner})", "": inner}.get(node[0], f"<{node[0]}>{inner}</>")
    return f"({text}){node[1]}" if node[1] and node[0] != "()" else text + node[1]


def elements(wrapper: list) -> Iterator[tuple[tuple[str, ...], list]]:
    """Path and node of every element of a wrapper, outer ones first."""
    stack: list[tuple[tuple[str, ...], list]] = [((), wrapper)]
    while stack:
        path, node = stack.pop()
        for c in reversed(node[2]):
            if c[0] == "()":
                stack.append((path, c))
            elif c[0] != "#":
                yield (*path, c[0]), c
                stack.append(((*path, c[0]), c))


def main_paths(wrapper: list) -> list[list[str]]:
    """The paths of the main region; blocks below them count as main text unless something on the way is left out."""

    def holds(node: list, tags: tuple[str, ...]) -> bool:
        return any(_tag(p[-1]) in tags and not _never(p[-1], True) for p, _ in elements(node))

    def plain(node: list) -> float:
        """Signs of slot text outside of links, with what lies in paragraphs counted whole and deeper blocks half."""
        total = 0.0
        for c in node[2]:
            if c[0] == "#":
                total += max(0, c[4] - c[5]) * (0.2 if c[6] is not None else 1)
            elif c[0] == "()":
                total += plain(c)
            elif not _never(c[0], True):
                total += plain(c) * (1 if _tag(c[0]) in ("p", "h1", "h2", "h3", "h4", "ul", "ol", "li", "blockquote", "pre", "table", "tbody", "tr", "td") else 0.5)
        return total

    out: set[tuple[str, ...]] = set()  # elements that are left out, unless they hold the region
    nodes = []
    for path, node in elements(wrapper):
        if path[:-1] in out or _never(path[-1], False) and (_tag(path[-1]) in _NEVER or not holds(node, ("article", "main"))):
            out.add(path)
        else:
            nodes.append((path, node))
    outermost = lambda paths: [list(p) for p in sorted(set(paths)) if not any(p != q and p[: len(q)] == q for q in paths)]
    for test in (lambda k: _tag(k) == "article" and not _never(k, True), lambda k: _tag(k) == "main" or "main" in _names(k)):
        found = [p for p, n in nodes if test(p[-1]) and plain(n) > 0]
        if found:
            return outermost(found)
    named = [(plain(n), p) for p, n in nodes if _words(p[-1]) & _CONTENT_WORDS]
    ranked = max(named or [(plain(n), p) for p, n in nodes], default=None)
    return [list(ranked[1])] if ranked and ranked[0] > 0 else [[]]


def _texts(node: list) -> tuple[bool, int, int]:
    """Whether all texts of a node are fixed, their signs, and those in links."""
    fixed, signs, linked, stack = True, 0, 0, [node]
    while stack:
        for c in stack.pop()[2]:
            if c[0] == "#":
                fixed &= c[6] is not None
                signs, linked = signs + c[4], linked + c[5]
            else:
                stack.append(c)
    return fixed, signs, linked


def template_paths(wrapper: list, roots: list[list[str]]) -> list[list[str]]:
    """Paths inside the region that the wrapper tells to be template: doubtful names with evidence, and same texts where there is no region."""
    found: dict[tuple[str, ...], bool] = {}
    inside = [tuple(r) for r in roots]
    for path, node in elements(wrapper):
        root = next((r for r in inside if path[: len(r)] == r and len(path) > len(r)), None)
        if root is None:
            continue
        fixed, signs, linked = _texts(node)
        same = fixed and node[3] >= SAME_ON
        if _doubtful(path[-1]):
            gone = same or 2 * linked > signs or bool(_names(path[-1]) & _LIKELY) and node[1] != ""
        else:
            gone = not root and same and 2 * node[3] > wrapper[3]
        found[path] = found.get(path, True) and gone
    return [list(p) for p, gone in found.items() if gone]


def main_text(page: str | None, paths: list[list[str]], template: frozenset[tuple[str, ...]] = frozenset()) -> str:
    """The main text of a page by its host's paths; a page without that region is judged by its own wrapper."""
    if not page:
        return ""
    found, opened = blocks(page)
    roots = [tuple(p) for p in paths]
    if not any(r in opened or not r for r in roots):
        own = page_wrapper(page)
        roots = [tuple(p) for p in main_paths(own)]
        template = frozenset(map(tuple, template_paths(own, [list(r) for r in roots])))
    judged: dict[tuple[str, ...], bool] = {}

    def counts(path: tuple[str, ...]) -> bool:
        return any(path[: len(r)] == r and not any(_never(path[k], bool(r)) or path[: k + 1] in template for k in range(len(r), len(path))) for r in roots)

    out = []
    for path, text, _, _ in found:
        if (keep := judged.get(path)) is None:
            keep = judged[path] = counts(path)
        if keep:
            out.append(text)
    return "\n".join(out)


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper): one wrapper a host, from all its pages; the wrapper as JSON."""
    read = pages.select(_host().alias("host"), F.col("html").alias("html"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, list] = {}
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if page:
                    w = page_wrapper(page)
                    found[host] = merge(found[host], w) if host in found else w
            yield pa.RecordBatch.from_pydict({"host": pa.array(list(found), pa.string()), "wrapper": pa.array([json.dumps(w) for w in found.values()], pa.string())})

    def unite(rows: pd.DataFrame) -> pd.DataFrame:
        first, *rest = [json.loads(w) for w in sorted(rows["wrapper"])]
        for w in rest:
            first = merge(first, w)
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "wrapper": [json.dumps(first)]})

    parts = stored(read.mapInArrow(partial, "host string, wrapper string"), "html-partial-wrappers")
    while True:
        most = parts.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        if most <= FAN:
            return parts.groupBy("host").applyInPandas(unite, "host string, wrapper string")
        sizes = parts.groupBy("host").agg(F.ceil(F.count("*") / FAN).alias("salts"))
        salted = parts.join(sizes, "host").withColumn("salt", F.pmod(F.xxhash64("wrapper", F.monotonically_increasing_id()), F.col("salts")))
        parts = stored(salted.groupBy("host", "salt").applyInPandas(unite, "host string, wrapper string"), "html-partial-wrappers")


def _host() -> Column:
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page row."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = []
            for w in map(json.loads, batch.column(1).to_pylist()):
                roots = main_paths(w)
                paths.append(json.dumps([roots, template_paths(w, roots)]))
            yield pa.RecordBatch.from_pydict({"host": batch.column(0), "paths": pa.array(paths, pa.string())})

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = {None: ([], frozenset())}
            for p in set(batch.column(3).to_pylist()) - {None}:
                roots, template = json.loads(p)
                known[p] = roots, frozenset(map(tuple, template))
            texts = [main_text(h, *known[p]) for h, p in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    chosen = stored(infer_wrappers(pages).mapInArrow(choose, "host string, paths string"), "html-wrappers")
    joined = pages.select("page_id", "url", "html", _host().alias("host")).join(chosen, "host", "left").select("page_id", "url", "html", "paths")
    ids = joined.schema["page_id"].dataType.simpleString()
    return joined.mapInArrow(extract, f"page_id {ids}, url string, text string, n_chars long")
