"""Operator 5, HTML extraction: site template removal.

Pages are read into blocks of text, each with the hashes of the element
subtrees it lies in: every element outside head and scripts, menus, adverts and
footers and what surrounds an article included. Hashes are counted per host,
once for all pages with the same own text, as copies of a page make no template.
A subtree that recurs on many different pages of its host is template, and its
blocks go. The number asked for doesn't grow with the host, so the box of one
section of a large host goes too. What holds an article is never template, and
where all of an article would go, all of it stays. Near copies of a page whose
words differ count as different pages.

Paragraphs and headings that stand in the article's own flow, and the items and
cells of its lists and tables, are no template however often they recur;
containers (div, section, whole lists and tables and the like) can be.

Rules by tag, class and article element help only with what differs from page
to page and so can't be counted: what names itself page furniture (menus,
headers and footers outside the article, sidebars, forms, notices, adverts,
comments) goes, and where a page has an article or main element, its text alone
is kept. A class, id or role says so only if each of its words names furniture or
layout (``cookie-notice``, ``ad-slot``, not ``side-effects``); inside an article one
of them must also be unmistakable (INSIDE). Formulas are read as text, without
their annotations.

Null, empty and blank pages have an empty text. Broken markup is read as far as
it makes sense: unclosed elements end with their parents, an unclosed script or
comment takes the rest, a tag that never ends is text. Time and memory grow with a
page's length, however its tags nest or break, as each subtree names only the one
around it. Repeated rows are counted once and returned each.
Null hosts are a host of their own. Further columns are dropped.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfscope.llm.tables import stored
from shelfscope.llm.words import slices, texts_of

#: A subtree is template if it is on so many pages of its host that differ in their own text.
LEAST_PAGES = 5
#: Template subtrees that are handed to every task as an array; beyond it they are joined.
SHARED_KEYS = 4_000_000
MARKS = re.compile("[>\"']")
NAME = re.compile(r"[A-Za-z][^\s/>\"']*")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
HEADING = re.compile("h[1-6]")
TOKEN = re.compile(r"[a-z0-9]+")
BLANKS = re.compile(r"\s+")
# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template noscript iframe svg annotation annotation-xml object audio video canvas textarea title".split())
FURNITURE = frozenset("nav aside form footer dialog menu button select head".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr "
    "math semantics mrow mi mn mo ms mtext mspace msup msub msubsup mfrac msqrt mroot mover munder munderover mmultiscripts mprescripts "
    "mtable mtr mtd mlabeledtr mstyle mpadded mphantom menclose mfenced merror maction none".split()
)
FLOW = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre article main body html br hr li dt dd tr td th thead tbody tfoot caption figcaption".split())
#: Elements that end an open paragraph.
ENDS_P = frozenset(
    "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
ENDS_SELF = {"li": "li", "dt": "dd dt", "dd": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}
#: What a name of class, id or role must also hold to mark furniture inside an article.
INSIDE = frozenset("ad ads advert adverts advertisement advertising sponsored cookie cookies comment comments commentlist disqus share sharing newsletter related".split())
#: Words that say where or how something stands, and change nothing about what it is.
LAYOUT = frozenset(
    "site page main top bottom left right upper lower inner outer primary secondary global local mobile desktop sticky fixed wrapper wrap container content "
    "box block area section region zone slot unit row col column bar panel list item items link links button buttons form field thread post posts article articles "
    "stories text icon icons overlay modal message wide small large count toggle".split()
)
#: Words of class, id and role that mark page furniture.
MARKED = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices alert popup modal "
    "newsletter subscribe subscription signup login share sharing social related recommended sidebar side widget nav navbar navigation menu menubar "
    "breadcrumb breadcrumbs toolbar masthead header footer copyright comment comments commentlist respond reply replies disqus pagination pager "
    "search skip contentinfo complementary".split()
)


class _Node:
    __slots__ = ("name", "furniture", "in_furniture", "in_article", "holds_article", "parts", "label")

    def __init__(self, name: str, label: str, furniture: bool, in_furniture: bool, in_article: bool):
        self.name, self.label, self.furniture, self.in_article, self.holds_article = name, label, furniture, in_article, False
        self.in_furniture = furniture or in_furniture
        self.parts: list[object] = []


class _TagEnds:
    """Where tags end: the first ``>`` outside quotes. Each mark of the page is looked at once, whatever asks."""

    def __init__(self, page: str):
        found = list(MARKS.finditer(page))
        self.places, self.kinds = [m.start() for m in found], [m[0] for m in found]
        #: Of a quote, the number of the next one of its kind.
        self.pairs = [-1] * len(found)
        following = {}
        for k in range(len(found) - 1, -1, -1):
            if (kind := self.kinds[k]) != ">":
                self.pairs[k] = following.get(kind, -1)
                following[kind] = k
        self.ends: dict[int, int] = {}

    def after(self, at: int) -> int:
        """The place of that ``>``, or -1."""
        k, way = bisect_left(self.places, at), []
        while True:
            if k >= len(self.places):
                end = -1
            elif k in self.ends:
                end = self.ends[k]
            elif self.kinds[k] == ">":
                end = self.places[k]
            else:
                way.append(k)
                k = self.pairs[k] + 1 or len(self.places)
                continue
            for passed in way:
                self.ends[passed] = end
            return end


def _marks(names: str, inside: bool) -> bool:
    for name in names.split():
        words = TOKEN.findall(name)
        if all(w in MARKED or w in INSIDE or w in LAYOUT or w.isdigit() for w in words) and any(w in (INSIDE if inside else MARKED) for w in words):
            return True
    return False


def _furniture(name: str, names: str, hidden: bool, in_article: bool) -> bool:
    if name in FURNITURE or hidden:
        return True
    if name == "header" and not in_article:
        return True
    if in_article:  # words of a line name themselves comments where code is coloured
        return name not in INLINE and not HEADING.fullmatch(name) and _marks(names, True)
    return name not in ("article", "main", "body", "html") and _marks(names, False)


class _Open:
    """The open elements, and where those of each name stand."""

    def __init__(self, root: _Node):
        self.nodes, self.places = [root], defaultdict(list)

    def push(self, node: _Node) -> None:
        self.places[node.name].append(len(self.nodes))
        self.nodes.append(node)

    def innermost(self, names: Iterable[str]) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def close(self, names: Iterable[str], within: Iterable[str] = ()) -> None:
        """Close the innermost element of these names, if one is open and none of ``within`` lies further in."""
        place = self.innermost(names)
        if place and place >= self.innermost(within):
            for node in self.nodes[place:]:
                self.places[node.name].pop()
            del self.nodes[place:]


def _raw_end(page: str, name: str, at: int) -> int:
    for match in re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).finditer(page, at):
        return page.find(">", match.end()) + 1 or len(page)
    return len(page)


def _tree(page: str) -> tuple[_Node, bool]:
    """The page's elements and texts, and whether it has an article or main element."""
    root = _Node("html", "", False, False, False)
    opened, ends, at, seen, has_article = _Open(root), _TagEnds(page), 0, 0, False
    add = lambda part: opened.nodes[-1].parts.append(part)

    def text(end: int) -> None:
        if at < end:
            add(html.unescape(page[at:end]))

    while (start := page.find("<", seen)) >= 0:
        seen = start + 1
        if page.startswith(("<!", "<?"), start):
            text(start)
            cdata = page.startswith("<![CDATA[", start)
            begin, mark = (start + 9, "]]>") if cdata else (start + 4, "-->") if page.startswith("<!--", start) else (start, ">")
            stop = page.find(mark, begin)
            if cdata:
                add(page[begin : stop if stop >= 0 else len(page)])
            at = seen = stop + len(mark) if stop >= 0 else len(page)
            continue
        closing = page.startswith("/", seen)
        begin = seen + closing
        if not page[begin : begin + 1].isascii() or not page[begin : begin + 1].isalpha() or (stop := ends.after(begin)) < 0:
            continue
        text(start)
        at = seen = stop + 1
        match = NAME.match(page, begin, stop)
        name, rest = match[0].lower(), page[match.end() : stop]
        if closing:
            opened.close((name,))
            continue
        if name in RAW:
            if not rest.rstrip().endswith("/") or name in ("script", "style"):
                at = seen = _raw_end(page, name, at)
            add(" " if name == "svg" else "" if name.startswith("annotation") else None)
            continue
        if name in ENDS_P:
            opened.close(("p",), ("div", "section", "article", "main", "td", "th", "li", "blockquote", "body", "figure"))
        if name in ENDS_SELF:
            opened.close(ENDS_SELF[name].split(), ("ul", "ol", "dl", "table", "select"))
        if name in VOID:
            add(None if name in ("br", "hr") else "")
            continue
        found = {a.lower(): (x or y or z or "") for a, x, y, z in ATTRIBUTE.findall(rest)}
        names = " ".join(found.get(k, "") for k in ("class", "id", "role")).lower()
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
        around = opened.nodes[-1]
        main = name in ("article", "main")
        label = " ".join([name, *TOKEN.findall(names)])
        node = _Node(name, label, _furniture(name, names, hidden, around.in_article), around.in_furniture, around.in_article or main)
        if main and not around.in_furniture:
            has_article = True
            for holder in reversed(opened.nodes):
                if holder.holds_article:  # and so do those around it
                    break
                holder.holds_article = True
        add(node)
        if not rest.endswith("/") or name not in INLINE:
            opened.push(node)
    text(len(page))
    return root, has_article


def _hash(node: _Node, seen: dict[int, int]) -> int:
    """Of a subtree: its label, its texts in single blanks, and its children's hashes. Iterative, as pages nest as they like."""
    order, todo = [], [node]
    while todo:
        order.append(current := todo.pop())
        todo.extend(p for p in current.parts if isinstance(p, _Node))
    for current in reversed(order):
        state = xxhash.xxh64(current.label)
        for part in current.parts:
            if isinstance(part, _Node):
                state.update(seen[id(part)].to_bytes(8, "little"))
            elif part and (text := BLANKS.sub(" ", part).strip()):
                state.update(b"\0" + text.encode("utf-8", "surrogatepass"))
        seen[id(current)] = state.intdigest()
    return seen[id(node)]


class Blocks(NamedTuple):
    """A page's own text blocks, those that go by rule, and the subtrees around them.

    ``at`` and ``ruled`` hold, of each block, the number of the subtree it lies in
    (-1: none); ``outer`` that of the subtree around each subtree, always a lower one.
    """

    texts: list[str]
    at: list[int]
    ruled: list[int]
    hashes: list[int]
    outer: list[int]
    own: int  # a hash of all own text (of the page, if it has none)
    article: bool


def blocks(page: str) -> Blocks:
    root, only_article = _tree(page)
    seen: dict[int, int] = {}
    whole = _hash(root, seen)
    texts, ats, ruled, hashes, outer = [], [], [], [], []
    pieces: list[str] = []

    def flush(inside: int, by_rule: bool) -> None:
        if text := BLANKS.sub(" ", "".join(pieces)).strip():
            if by_rule:
                ruled.append(inside)
            else:
                texts.append(text)
                ats.append(inside)
        pieces.clear()

    # Each entry: a node, the place in its parts, the number of the subtree it lies in, whether it lies in furniture.
    stack: list[list] = [[root, 0, -1, False]]
    while stack:
        node, at, inside, furniture = stack[-1]
        by_rule = furniture or (only_article and not node.in_article)
        if at == len(node.parts):
            stack.pop()
            if node.name not in INLINE:
                flush(inside, by_rule)
            continue
        stack[-1][1] += 1
        part = node.parts[at]
        if part is None:
            flush(inside, by_rule)
        elif isinstance(part, str):
            pieces.append(part)
        elif part.name == "head" or (part.furniture and part.name in INLINE):
            continue
        else:
            if part.name not in INLINE:
                flush(inside, by_rule)
            own_flow = part.in_article and not (furniture or part.furniture) and part.name in FLOW
            if part.name not in INLINE and part.name not in ("body", "html") and not part.holds_article and not own_flow:
                hashes.append(seen[id(part)])
                outer.append(inside)
                inside = len(hashes) - 1
            stack.append([part, 0, inside, furniture or part.furniture])
    flush(-1, only_article)
    own = xxhash.xxh64_intdigest("\n".join(texts).encode("utf-8", "surrogatepass")) if texts else whole
    return Blocks(texts, ats, ruled, hashes, outer, own, only_article)


_PAGES = "page_id long, url string, texts array<string>, at array<int>, ruled array<int>, hashes array<bigint>, outer array<int>, own bigint, article boolean"
_KINDS = {"texts": pa.list_(pa.string()), "at": pa.list_(pa.int32()), "ruled": pa.list_(pa.int32()), "hashes": pa.list_(pa.int64()), "outer": pa.list_(pa.int32()), "own": pa.int64(), "article": pa.bool_()}


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashes are mixed with the host's, so that equal ones are of one host."""
    for batch in batches:
        for part in slices(batch, "html"):
            found = []
            for host, page in zip(part.column("host").to_pylist(), texts_of(part, "html").to_pylist(), strict=True):
                site = xxhash.xxh64_intdigest(host.encode("utf-8", "surrogatepass"))
                read = blocks(page)
                found.append(read._replace(hashes=[(h ^ site) - (1 << 63) for h in read.hashes], own=read.own - (1 << 63)))
            arrays = [pa.array([getattr(b, c) for b in found], kind) for c, kind in _KINDS.items()]
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), *arrays], names=["page_id", "url", *_KINDS])


_MARKED = "page_id long, url string, texts array<string>, article boolean, own_hit array<boolean>, n_ruled int"


def _marker(keys):
    """Marks the own blocks that lie in template, and counts those that go by rule anyway.

    Template are the sorted ``keys`` (a broadcast), or each page's own ``gone`` where they are joined.
    """

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own_hit, n_ruled = [], []
            for row in range(batch.num_rows):
                values = np.asarray(batch.column("hashes")[row].values, dtype=np.int64)
                if keys is not None:
                    template = keys.value
                else:
                    template = np.sort(np.array(batch.column("gone")[row].as_py() or [], dtype=np.int64))
                hit = [False] * len(values)
                if len(template) and len(values):
                    hit = (template[np.minimum(np.searchsorted(template, values), len(template) - 1)] == values).tolist()
                for k, around in enumerate(batch.column("outer")[row].as_py()):
                    hit[k] = hit[k] or (around >= 0 and hit[around])
                hit.append(False)  # of what lies in no subtree, -1
                own_hit.append([hit[k] for k in batch.column("at")[row].as_py()])
                n_ruled.append(sum(hit[k] for k in batch.column("ruled")[row].as_py()))
            arrays = [pa.array(own_hit, pa.list_(pa.bool_())), pa.array(n_ruled, pa.int32())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "texts", "article")), *arrays], names=["page_id", "url", "texts", "article", "own_hit", "n_ruled"])

    return marked


def host_of(url: str = "url"):
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"://([^/?#]*)", 1))


def extracted(pages: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """A row per page: page_id, url, text, n_chars, n_template (blocks that went as template)."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host_of().alias("host"), F.col("html").cast("string").alias("html")
    )
    read = stored(rows.mapInArrow(_read, _PAGES).withColumn("row", F.monotonically_increasing_id()), "blocks")
    inside = read.select("row", "own", F.explode(F.array_distinct("hashes")).alias("hash"))
    often = inside.select("hash", "own").distinct().groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    template = stored(often.where(F.col("n") >= least_pages).select("hash"), "template")
    if template.count() <= SHARED_KEYS:
        keys = read.sparkSession.sparkContext.broadcast(np.sort(template.toArrow()["hash"].to_numpy()))
        marked = read.mapInArrow(_marker(keys), _MARKED)
    else:
        gone = inside.join(template, "hash").groupBy("row").agg(F.collect_set("hash").alias("gone"))
        marked = read.join(gone, "row", "left").mapInArrow(_marker(None), _MARKED)
    left = F.transform(F.filter(F.arrays_zip("texts", "own_hit"), lambda b: ~b["own_hit"]), lambda b: b["texts"])
    kept = F.when(F.col("article") & (F.size(left) == 0), F.col("texts")).otherwise(left)
    return (
        marked.withColumn("kept", kept)
        .withColumn("text", F.array_join("kept", "\n"))
        .select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), (F.size("texts") - F.size("kept") + F.col("n_ruled")).cast("long").alias("n_template"))
    )
