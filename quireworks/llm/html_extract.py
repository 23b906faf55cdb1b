"""Main text of web pages by wrappers: union-free regular expressions inferred from all pages of a host."""

from __future__ import annotations

import bisect
import functools
import html as html_module
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quireworks.llm.common import join_sized, prepare, stage

#: Elements whose text is never main text
SKIPPED = frozenset(
    "head title nav header footer aside form script style noscript template iframe object svg math canvas audio video button select "
    "option textarea dialog menu".split()
)
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that do not end a block
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt ruby s samp small span strike "
    "strong sub sup time tt u var".split()
)
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dd dt figcaption caption".split())
#: An open element on the left ends where one of those on the right begins
CLOSED_BY = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "option": frozenset(["option"]), "head": frozenset(["body"]),
}
#: Words that mark, in a class, id or role, what is not main text, and words that may stand beside them in one name
NOISE = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promos promotion banner cookie cookies "
    "consent gdpr notice notices alert popup modal overlay dialog newsletter subscribe signup sidebar aside widget comment comments commentlist "
    "disqus replies respond share sharing social related recommended breadcrumb breadcrumbs menu nav navbar navigation pagination pager "
    "masthead header footer copyright complementary contentinfo search".split()
)
BESIDE = frozenset(
    "site page top bottom left right global primary secondary mobile desktop fixed sticky box block bar list area container wrapper wrap inner "
    "outer slot unit link links posts articles button buttons form user reader readers".split()
)
#: Parts of what readers say: all names made of one of the first and one of the second
SAID, SAID_OF = frozenset("comment comments reply replies".split()), frozenset("body content text item entry thread author meta date count section".split())
#: Words that are noise as names of layout, but inside an article are as well the id of a section or the class of a table
LAYOUT = frozenset(
    "search header footer menu nav navigation notice notices alert dialog overlay banner related share sharing social copyright widget respond replies "
    "masthead pager pagination breadcrumb breadcrumbs aside sponsor promo promotion consent modal popup".split()
)
TABULAR = frozenset("table thead tbody tfoot tr td th caption dl dt dd pre blockquote figure figcaption".split())
#: Elements that a name never makes noise: what holds the page or the article, headings and paragraphs
NAMED_FREELY = frozenset("html body main article h1 h2 h3 h4 h5 h6 p".split())
#: Wrappers go down so many levels; what lies deeper counts as text there.  Pages are read at any depth.
LEVELS = 150
_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>|<(?P<close>/?)(?P<name>[A-Za-z][\w:-]*)(?P<attrs>(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>|</?[A-Za-z][^>]*+>|(?P<text>[^<]+|<)",
    re.DOTALL,
)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.IGNORECASE) for name in RAW}
#: An attribute: its whole name, then its value; what is inside a value is never read as a name
_ATTR = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[A-Z]?[^\W\d_A-Z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)


@functools.lru_cache(10_000)
def _noise(name: str) -> bool:
    """Whether all parts of one class, id or role mark noise or may stand beside such a part."""
    if re.sub(r"[\d_-]", "", name).lower() in NOISE:
        return True
    parts = [p.lower() for p in _PART.findall(name)]
    if any(p in SAID for p in parts) and all(p in SAID or p in SAID_OF or p in BESIDE or p.isdigit() for p in parts):
        return True
    return any(p in NOISE for p in parts) and all(p in NOISE or p in BESIDE or p.isdigit() for p in parts)


@functools.lru_cache(10_000)
def _layout(name: str) -> bool:
    """Whether a name is noise by words of layout alone."""
    return all(p.lower() in LAYOUT or p.lower() in BESIDE or p.isdigit() for p in _PART.findall(name))


def _named_noise(element: str, attrs: dict[str, str], inside: bool) -> bool:
    """Whether an element's role, class or id makes it noise; inside an article, words of layout do not count in an id,
    nor in a class of a part of a table, a list of terms or a quotation."""
    if element in NAMED_FREELY:
        return False
    for a in ("role", "class", "id"):
        for x in attrs.get(a, "").split():
            if _noise(x) and not (inside and (a == "id" or element in TABULAR) and _layout(x)):
                return True
    return False


def parse(page: str) -> list:
    """The page as a tree of [key, skipped, children]; a child is another element, or the text of a block (string)."""
    root: list = ["", False, []]
    stack, names, text = [root], [""], []
    at = 0

    def end_block() -> None:
        if text:
            words = " ".join("".join(text).split())
            text.clear()
            if words:
                stack[-1][2].append(words)

    def pop(n: int) -> None:
        end_block()
        del stack[n:], names[n:]

    while m := _TOKEN.match(page, at):
        at = m.end()
        name = m["name"]
        if name is None:
            if m["text"] is not None:
                text.append(html_module.unescape(m["text"]))
            elif m["cdata"]:
                text.append(m["cdata"])
            continue
        name = name.lower()
        if m["close"]:
            if name in INLINE:
                continue
            if name == "br":
                text.append(" ")
            elif name in names:
                pop(len(names) - 1 - names[::-1].index(name))
            else:
                end_block()
            continue
        if name == "br" or name == "wbr":
            text.append(" " if name == "br" else "")
            continue
        attrs: dict[str, str] = {}
        for a, b, c, d in _ATTR.findall(m["attrs"] or ""):
            attrs.setdefault(a.lower(), b or c or d)
        hidden = "hidden" in attrs or attrs.get("aria-hidden") == "true" or bool(_HIDDEN.search(attrs.get("style", "")))
        noisy = hidden or bool(attrs) and _named_noise(name, attrs, "article" in names or "main" in names)
        if name in RAW and not m[0].endswith("/>"):
            over = _RAW_END[name].search(page, at)
            at = over.end() if over else len(page)
            continue
        if name in INLINE and not noisy:
            continue
        if name in VOID:
            if name == "hr":
                end_block()
            continue
        if name in INLINE:
            # a noisy inline element: drop it with what it holds
            depth = 1
            for tag in re.compile(rf"<(/?){name}(?![\w:-])[^>]*>", re.IGNORECASE).finditer(page, at):
                depth += -1 if tag[1] else 1
                if not depth:
                    at = tag.end()
                    break
            continue
        end_block()
        while len(names) > 1 and name in CLOSED_BY.get(names[-1], ()):
            pop(len(names) - 1)
        classes = re.sub(r"\d+", "#", ".".join(sorted(set(attrs.get("class", "").split()))))
        node = [f"{name}.{classes}" if classes else name, noisy or name in SKIPPED, []]
        stack[-1][2].append(node)
        if not m[0].endswith("/>"):
            stack.append(node)
            names.append(name)
    end_block()
    return root


# A wrapper is a list of items [quantifier, node]; quantifiers are "1", "?", "+" and "*".  A node is ["t", text or None (a
# slot), characters seen], ["e", key, skipped, items] or ["g", items], a group whose items are optional and that repeats.
# No two items of a list, groups opened, have the same key: what recurs is a repeated item or part of a repeated group.


def _key(node: list) -> str:
    return ("!" if node[2] else "") + node[1] if node[0] == "e" else "#"


def _chars(children: list) -> int:
    """Characters of all texts below that are not skipped."""
    total, left = 0, list(children)
    while left:
        c = left.pop()
        if isinstance(c, str):
            total += len(c)
        elif not c[1]:
            left += c[2]
    return total


def wrapper_of(children: list, level: int = 0) -> list:
    """The wrapper of one page's children: what recurs becomes a repeated item or group."""
    if level == LEVELS:
        return [["1", ["t", None, _chars(children)]]] if children else []
    items = [["1", ["t", c, len(c)] if isinstance(c, str) else ["e", c[0], c[1], wrapper_of(c[2], level + 1)]] for c in children]
    return _settled(items, [])


def _either(a: str, b: str) -> str:
    optional, repeats = a in "?*" or b in "?*", a in "+*" or b in "+*"
    return "*" if optional and repeats else "?" if optional else "+" if repeats else "1"


def _merged(a: list, b: list) -> list:
    if a[0] == "t":
        return ["t", a[1] if a[1] == b[1] else None, a[2] + b[2]]
    return ["e", a[1], a[2], align(a[3], b[3])]


def _settled(items: list, ranges: list[tuple[int, int]]) -> list:
    """A wrapper of items and ranges (first, last) that repeat as groups: a key that recurs opens a range of its own."""
    keys = [_key(n) for _, n in items]
    last = {k: i for i, k in enumerate(keys)}
    first: dict[str, int] = {}
    for i, k in enumerate(keys):
        first.setdefault(k, i)
    spans = sorted([r for r in ranges] + [(first[k], last[k]) for k in first if first[k] < last[k]])
    out, at = [], 0
    while spans or at < len(items):
        if not spans or at < spans[0][0]:
            out.append(items[at])
            at += 1
            continue
        end = spans[0][1]
        while spans and spans[0][0] <= end:
            end = max(end, spans.pop(0)[1])
        inside: dict[str, list] = {}
        for (q, node), k in zip(items[at : end + 1], keys[at : end + 1], strict=True):
            inside[k] = [_either(inside[k][0], q), _merged(inside[k][1], node)] if k in inside else [q, node]
        if len(inside) == 1:
            q, node = next(iter(inside.values()))
            out.append(["*" if q in "?*" else "+", node])
        else:
            out.append(["*", ["g", [[_either(q, "?"), node] for q, node in inside.values()]]])
        at = end + 1
    return out


def _opened(items: list) -> tuple[list, list[int]]:
    """Items with groups opened, and for each the number of its group (-1: none)."""
    flat, group = [], []
    for i, (q, node) in enumerate(items):
        if node[0] == "g":
            flat += node[1]
            group += [i] * len(node[1])
        else:
            flat.append([q, node])
            group.append(-1)
    return flat, group


def align(a: list, b: list) -> list:
    """The wrapper that generates what both generate: items in the same order merge, others become optional, and those
    that change places become a repeated group.  Keys are distinct, so the longest common order takes n log n steps."""
    fa, ga = _opened(a)
    fb, gb = _opened(b)
    ka, kb = [_key(n) for _, n in fa], [_key(n) for _, n in fb]
    if ka == kb:
        flat, chain = [[_either(x[0], y[0]), _merged(x[1], y[1])] for x, y in zip(fa, fb, strict=True)], []
        place_a = place_b = list(range(len(fa)))
    else:
        where = {k: j for j, k in enumerate(kb)}
        tails, tops, before = [], [], {}
        for i, k in enumerate(ka):
            j = where.get(k)
            if j is None:
                continue
            n = bisect.bisect_left(tails, j)
            before[i] = tops[n - 1] if n else None
            tails[n : n + 1], tops[n : n + 1] = [j], [i]
        chain, i = [], tops[-1] if tops else None
        while i is not None:
            chain.append((i, where[ka[i]]))
            i = before[i]
        flat, place_a, place_b, i, j = [], [0] * len(fa), [0] * len(fb), 0, 0
        for x, y in [*reversed(chain), (len(fa), len(fb))]:
            for i in range(i, x):
                place_a[i] = len(flat)
                flat.append([_either(fa[i][0], "?"), fa[i][1]])
            for j in range(j, y):
                place_b[j] = len(flat)
                flat.append([_either(fb[j][0], "?"), fb[j][1]])
            if x < len(fa):
                place_a[x] = place_b[y] = len(flat)
                flat.append([_either(fa[x][0], fb[y][0]), _merged(fa[x][1], fb[y][1])])
            i, j = x + 1, y + 1
    ranges: dict[tuple[int, int], tuple[int, int]] = {}
    for side, (groups, place) in enumerate(((ga, place_a), (gb, place_b))):
        for g, at in zip(groups, place, strict=True):
            if g >= 0:
                lo, hi = ranges.get((side, g), (at, at))
                ranges[side, g] = min(lo, at), max(hi, at)
    return _settled(flat, list(ranges.values()))


def _elements(items: list, path: tuple = ()) -> Iterator[tuple[tuple, list]]:
    """Every element that is not skipped, with its path."""
    for _, node in items:
        if node[0] == "g":
            yield from _elements(node[1], path)
        elif node[0] == "e" and not node[2]:
            yield (*path, node[1]), node[3]
            yield from _elements(node[3], (*path, node[1]))


def _mass(items: list, slots: bool) -> int:
    """Characters of the texts below that are not skipped; only of those that differ between places, if slots."""
    return sum(
        (0 if slots and n[1] is not None else n[2]) if n[0] == "t" else _mass(n[1], slots) if n[0] == "g" else 0 if n[2] else _mass(n[3], slots)
        for _, n in items
    )


def rule_of(items: list) -> list[str]:
    """The path of the host's main region, as its wrapper shows it.

    It is the deepest element that holds most of the text that differs (from page to page, or along a page), together with
    a heading of the first level, one whose text differs if there is one; within an article or main element it is the whole of that, and where
    a page has such an element elsewhere, its author's word stands: the one with the most text is the region.
    """
    found = list(_elements(items))
    name = lambda path: path[-1].partition(".")[0]
    slots = _mass(items, True) > 0
    for wanted in ("article", "main"):
        some = [(path, inner) for path, inner in found if name(path) == wanted and not any(p.partition(".")[0] == wanted for p in path[:-1])]
        if some:
            return list(max(some, key=lambda x: (_mass(x[1], slots), _mass(x[1], False)))[0])
    total = _mass(items, slots)
    titles = [(path, inner) for path, inner in found if name(path) == "h1"]
    titles = [path for path, _ in [x for x in titles if _mass(x[1], True)] or titles]
    region: tuple = ()
    for path, inner in found:
        if len(path) > len(region) and name(path) not in CONTENT and _mass(inner, slots) > 0.6 * total and all(t[: len(path)] == path for t in titles):
            region = path
    return list(region)


def extract(root: list, region: list[str]) -> str:
    """Texts of the region in page order, joined by one space."""
    out: list[str] = []

    def texts(node: list) -> None:
        left = [node]
        while left:
            c = left.pop()
            if isinstance(c, str):
                out.append(c)
            elif c is node or not c[1]:
                left += reversed(c[2])

    def seek(node: list, depth: int) -> None:
        if depth == len(region):
            texts(node)
            return
        for c in node[2]:
            if not isinstance(c, str) and c[0] == region[depth] and not c[1]:
                seek(c, depth + 1)

    seek(root, 0)
    return " ".join(out)


def page_text(page: str, region: list[str] | None) -> str:
    root = parse(page)
    if region is None or not _has(root, region):
        region = rule_of(wrapper_of(root[2]))
    return extract(root, region)


def _has(node: list, region: list) -> bool:
    if not region:
        return True
    return any(not isinstance(c, str) and c[0] == region[0] and not c[1] and _has(c, region[1:]) for c in node[2])


def host(url: Column) -> Column:
    """Lower-case host of a URL; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _infer(batches: Iterator[pa.RecordBatch], most: int = 2000) -> Iterator[pa.RecordBatch]:
    """One wrapper per host from this task's pages; at most so many are held, then they are sent and begun anew."""
    held: dict[str, list] = {}
    salt = TaskContext.get().partitionId() % 32

    def out() -> pa.RecordBatch:
        rows = [pa.array(list(held)), pa.array([salt] * len(held), pa.int32()), pa.array([json.dumps(w) for w in held.values()])]
        held.clear()
        return pa.RecordBatch.from_arrays(rows, ["host", "salt", "wrapper"])

    for batch in batches:
        for own, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
            items = wrapper_of(parse(page or "")[2])
            held[own] = align(held[own], items) if own in held else items
        if len(held) >= most:
            yield out()
    if held:
        yield out()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Align the wrappers of each key; rows come sorted by it, and one wrapper is held at a time."""
    key, items = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]]), pa.array([key[1]], pa.int32()), pa.array([json.dumps(items)])], ["host", "salt", "wrapper"])

    for batch in batches:
        for h, s, w in zip(*[batch.column(c).to_pylist() for c in ("host", "salt", "wrapper")], strict=True):
            if key != (h, s):
                if key is not None:
                    yield out()
                key, items = (h, s), json.loads(w)
            else:
                items = align(items, json.loads(w))
    if key is not None:
        yield out()


WRAPPER = "host string, salt int, wrapper string"


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """A wrapper per host: host, wrapper (JSON).

    Every task aligns its own pages, so a host with very many pages is not gathered anywhere; wrappers, whose size is
    that of the template, are then aligned in two rounds, first 32 parts of each host, then the parts.
    """
    prepare(pages.sparkSession)
    local = pages.select(host(F.col("url")).alias("host"), "html").mapInArrow(_infer, WRAPPER)
    parts = local.repartition("host", "salt").sortWithinPartitions("host", "salt", "wrapper").mapInArrow(_merge, WRAPPER)
    whole = parts.withColumn("salt", F.lit(0)).repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(_merge, WRAPPER)
    return whole.select("host", "wrapper")


def _rules(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rules = [json.dumps(rule_of(json.loads(w))) for w in batch.column("wrapper").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(rules, pa.string())], ["host", "rule"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str, list[str] | None] = {}
    for batch in batches:
        texts = []
        for page, rule in zip(batch.column("html").to_pylist(), batch.column("rule").to_pylist(), strict=True):
            if rule not in known:
                if len(known) > 10_000:
                    known.clear()
                known[rule] = json.loads(rule) if rule else None
            texts.append(page_text(page or "", known[rule]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def main_text(pages: DataFrame) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars.

    The wrapper of the page's host tells where the main region is: an article or main element where the pages have one,
    else the deepest element with most of the text that differs between pages (see rule_of).  How many pages a host has,
    and whether pages are copies of each other, changes nothing else.  Blocks of the region are read whole, at any depth,
    without navigation, headers, footers, asides, forms, scripts, hidden elements and what a class, id or role names as an
    advert, notice, sidebar or comment; character references are decoded, white space in a block is one space, and blocks
    are joined by one.  A page without the host's region is read by its own.  A null or empty html has
    an empty text; pages with a null or odd url share a host of their own; null ids and repeated rows pass through; extra
    columns are ignored; an empty table gives an empty result.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rules, _ = stage(infer_wrappers(rows).mapInArrow(_rules, "host string, rule string"), "rules")
    keyed = join_sized(rows.withColumn("host", host(F.col("url"))), rules, "host", "left", bound=100_000)
    return keyed.select("page_id", "url", "html", "rule").mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
