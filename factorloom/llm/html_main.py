"""Main text of web pages: site templates are found by counting element subtrees per host, and removed.

A first pass hashes every block element's subtree (tag, class, text, children) of every page; Spark counts in how
many distinct pages of a host each occurs. A second pass deletes the subtrees that recur across many pages of the host,
takes the article of what is left, drops elements in it that say what they are (menus, notices, adverts, forms, comments)
and joins its text blocks.

Passages recur in articles as well. So a subtree has one of three levels, by the number of pages that have it: beside an
article it goes at the first; a container in an article, or in a page that has no article, at the second; a paragraph or
heading of a page that has no article at the third, and those of an article stay whatever their count. A page counts once
for each article it shows, so copies of a page are no template, and an element that holds an article is none.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom.llm.url_cascade import host_of
from factorloom.plans.joins import lookup_join
from factorloom.plans.runtime import ship_with_tasks, stage

# Element and class names of HTML pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
                  "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search "
                  "section summary table tbody td tfoot th thead tr ul caption".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
GONE = frozenset("nav header footer aside form menu dialog search button select option optgroup datalist fieldset svg "
                 "math canvas audio video object embed head".split())
GONE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
GONE_NAMES = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar "
                       "navigation menu breadcrumb breadcrumbs sidebar header footer masthead cookie cookies consent gdpr "
                       "notice notices newsletter subscribe subscription signup popup modal overlay comment comments disqus "
                       "replies respond share sharing social related recommended pagination pager widget toolbar".split())
ARTICLE_NAMES = frozenset("article entry post story".split())
#: An open element of the first kind ends where one of the second begins.
ENDS = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"},
        "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"},
        "option": {"option", "optgroup"}}
ENDED_BY = {tag: [old for old, new in ENDS.items() if tag in new] for tag in set().union(*ENDS.values())}
FENCES = frozenset("table ul ol dl select td th article section main body".split())

_TAG = re.compile(r"<(?:!--|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>\"'<]++|\"[^\"<]*\"|'[^'<]*')*+)>|([^>]*)>))")
_ATTR = re.compile(r"\b(class|id|role|hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_NAME = re.compile(r"[a-z0-9]+")


class Node:
    __slots__ = ("tag", "names", "gone", "parent", "children", "hash", "size")

    def __init__(self, tag: str, parent: "Node | None", attributes: str = ""):
        self.tag, self.parent, self.children = tag, parent, []
        self.names, self.gone = "", tag in GONE
        self.hash = self.size = 0
        if attributes and ("class" in attributes or "id" in attributes or "role" in attributes or "CLASS" in attributes):
            self._read(attributes)

    def _read(self, attributes: str) -> None:
        for key, value in _ATTR.findall(attributes):
            value = value.strip("\"'").lower()
            key = key.lower()
            if key == "role":
                self.gone |= value in GONE_ROLES
            elif key in ("class", "id"):
                if key == "class":
                    self.names = value
                for name in value.split():
                    words = set(_NAME.findall(name))
                    found = words & GONE_NAMES
                    if words & ARTICLE_NAMES:
                        found -= {"header", "banner"}
                    self.gone |= bool(found) and self.tag not in ("html", "body", "main", "article")
        if self.tag == "article" and set(_NAME.findall(self.names)) & {"comment", "comments", "reply"}:
            self.gone = True


def parse(page: str) -> Node:
    """The element tree; text nodes are str. Tolerant: open elements end where HTML ends them or with the page, and
    what is cut off inside a tag, a comment or a script is dropped."""
    root = here = Node("#root", None)
    at, last = 0, page.rfind(">") + 1
    open_now: Counter[str] = Counter()  # so that a tag whose partner is not open costs no walk up the tree
    while True:
        m = _TAG.search(page, at, last)
        if m is None:
            tail = page[at:]
            cut = re.search(r"<[a-zA-Z/!?]", tail)
            here.children.append(tail[:cut.start()] if cut else tail)
            return root
        if m.start() > at:
            here.children.append(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            if page.startswith("<!--", m.start()):
                at = page.find("-->", m.end()) + 3
                if at < 3:
                    return root
            continue
        tag = m[2].lower()
        if m[1]:
            if open_now[tag]:
                while here.tag != tag:
                    open_now[here.tag] -= 1
                    here = here.parent
                open_now[tag] -= 1
                here = here.parent
            elif tag == "p":
                here.children.append(" ")
            continue
        attributes = m[3] if m[3] is not None else m[4]
        if tag in RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                if end is None:
                    return root
                at = end.end()
            continue
        if any(open_now[t] for t in ENDED_BY.get(tag, ())):
            # the last element this one ends, within the innermost fence
            node, ended = here, None
            while node is not root and (node.tag not in FENCES or tag in ENDS.get(node.tag, ())):
                if tag in ENDS.get(node.tag, ()):
                    ended = node
                node = node.parent
            while ended is not None and here is not ended.parent:
                open_now[here.tag] -= 1
                here = here.parent
        new = Node(tag, here, attributes)
        here.children.append(new)
        if tag not in VOID and not attributes.endswith("/"):
            here = new
            open_now[tag] += 1


def _walk(root: Node):
    """Nodes, children before their parents, without recursion: pages may be nested deeply."""
    stack, order = [root], []
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [c for c in node.children if not isinstance(c, str)]
    return reversed(order)


def measure(root: Node) -> None:
    """Sets hash and size (characters of text) of every subtree."""
    digest = xxhash.xxh64_intdigest
    for node in _walk(root):
        parts, size = [node.tag, node.names], 0
        for c in node.children:
            if isinstance(c, str):
                words = " ".join(c.split())
                parts.append(words)
                size += len(words)
            else:
                parts.append(str(c.hash))
                size += c.size
        node.hash, node.size = digest("\x1f".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63), size


#: Levels of a recurring subtree: beside an article; a container of the content; a paragraph or heading of the content.
BESIDE, CONTAINER, PASSAGE = 1, 2, 3


def subtrees(root: Node) -> list[int]:
    """Distinct hashes of the block subtrees that hold text and no article, of a measured tree."""
    holds: set[int] = set()
    found = set()
    for node in _walk(root):
        article = node.tag == "article" or id(node) in holds
        if article:
            holds.add(id(node.parent))
        if node.tag in BLOCK and node.size and not article:
            found.add(node.hash)
    return sorted(found)


def content_of(page: str | None) -> tuple[int, list[int]]:
    """What a page counts as, its article or else all of it, and its subtrees."""
    if not page:
        return 0, []
    root = parse(page)
    measure(root)
    main, in_article = _main(root)
    whole = xxhash.xxh64_intdigest(page.encode("utf-8", "surrogatepass")) - (1 << 63)
    return (main.hash if in_article and main.size else whole), subtrees(root)


def main_text(page: str | None, recurring: dict[int, int] | None = None) -> tuple[str, int]:
    """The article's text, blocks joined by one space, white space inside them made one space; and how many characters of
    the page stood in subtrees deleted as recurring. `recurring`: the levels of subtrees by their hash."""
    if not page:
        return "", 0
    recurring = recurring or {}
    root = parse(page)
    measure(root)
    main, in_article = _main(root)
    deleted = _deleted(root, main, in_article, recurring) if recurring else set()
    out: list[str] = []
    stack: list = [(main, False)]
    while stack:
        node, only_headings = stack.pop()
        if isinstance(node, str):
            if not only_headings:
                out.append(node)
            continue
        block = node.tag in BLOCK or node.tag == "br"
        headings = only_headings and node.tag not in HEADINGS
        if node is not main:
            if node.gone and not (node.tag == "header" and in_article):
                continue
            if id(node) in deleted:
                continue
            headings = headings or node.tag == "header"
        if block:
            out.append(" ")
            stack.append((" ", False))
        stack += [(c, headings) for c in reversed(node.children)]
    size = sum(n.size for n in _walk(root) if id(n) in deleted) if deleted else 0
    return " ".join(entities.unescape("".join(out)).split()), size


def _deleted(root: Node, main: Node, in_article: bool, recurring: dict[int, int]) -> set[int]:
    """The topmost nodes that go as recurring."""
    found, stack = set(), [(root, not in_article)]
    while stack:
        node, content = stack.pop()
        if node.tag in BLOCK and node is not main:
            level = recurring.get(node.hash, 0)
            if not content:
                goes = level >= BESIDE
            elif node.tag in PROSE:
                goes = level >= PASSAGE and not in_article
            else:
                goes = level >= CONTAINER
            if goes:
                found.add(id(node))
                continue
        content = content or node is main
        stack += [(c, content) for c in node.children if not isinstance(c, str)]
    return found


def _main(root: Node) -> tuple[Node, bool]:
    """The article element with the most text, else the main element, else the whole page; is it an article? Elements
    inside removed ones do not count."""
    best, kind = root, 0
    stack = [root]
    while stack:
        node = stack.pop()
        rank = {"article": 2, "main": 1}.get(node.tag, 0)
        if node is not root and (rank > kind or rank == kind > 0 and node.size > best.size):
            best, kind = node, rank
        if node.tag != "article":
            stack += [c for c in reversed(node.children) if not isinstance(c, str) and not c.gone]
    return best, kind == 2


def recurring_subtrees(found: DataFrame, min_pages: int = 5, min_share: float = 0.05, prose_share: float = 0.3) -> DataFrame:
    """(host, h, level): the subtrees that recur on a host, of a table (host, copy, hashes) of its pages. Of the pages
    that count apart, level 1 takes `min_pages` and the logarithm to base 2 of their number, level 2 twice `min_pages`
    and `min_share` of them, level 3 twice `min_pages` and `prose_share`."""
    # hash 0 of each page counts the page itself, so one pass gives both counts
    each = found.select("host", "copy", F.explode(F.concat(F.array(F.lit(0).cast("long")), "hashes")).alias("h"))
    counts = each.distinct().groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"))
    counts = stage(counts.filter((F.col("n") >= min_pages) | (F.col("h") == 0)), "subtrees")
    total = counts.filter("h = 0").select("host", F.col("n").alias("pages"))
    share, many = F.col("n") / F.col("pages"), F.col("n") >= 2 * min_pages
    level = (F.when(many & (share >= prose_share), PASSAGE).when(many & (share >= min_share), CONTAINER)
             .when(F.col("n") >= F.log2(F.col("pages").cast("double")), BESIDE))
    rows = counts.filter("h <> 0").join(total, "host").select("host", "h", level.alias("level"))
    return rows.filter("level IS NOT NULL")


def _scan(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(page, host, copy, hashes), a row a page; page: a digest of host and html, equal for equal pages only."""
    def run(batches):
        for batch in batches:
            hosts, raw = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keys = [_page_key(h, p) for h, p in zip(hosts, raw)]
            seen = [content_of(p) for p in raw]
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(hosts, pa.string()), pa.array([c for c, _ in seen], pa.int64()),
                 pa.array([h for _, h in seen], pa.list_(pa.int64()))], names=["page", "host", "copy", "hashes"])

    ship_with_tasks(__name__)
    return pages.select(host_of(url).alias("host"), F.col(html).alias("html")).mapInArrow(
        run, "page binary, host string, copy bigint, hashes array<bigint>")


def _page_key(host: str, page: str | None) -> bytes:
    """Host and page in 16 bytes; null is unlike the empty page."""
    parts = f"{len(host)}:{host}" + ("-" if page is None else "=" + page)
    return xxhash.xxh3_128_digest(parts.encode("utf-8", "surrogatepass"))


def _keyed(rows: DataFrame) -> DataFrame:
    """`rows` with the page column of `_scan`."""
    def run(batches):
        for batch in batches:
            keys = [_page_key(h, p) for h, p in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist())]
            yield batch.append_column("page", pa.array(keys, pa.binary()))

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("page", T.BinaryType())]))


def extract(pages: DataFrame, url: str = "url", html: str = "html", id_col: str = "page_id", broadcast_bytes: int = 8 << 20,
            **limits) -> DataFrame:
    """(id_col, url, text, template_chars) for every row; other columns are not read. template_chars: the characters in
    deleted recurring subtrees, white space made one. Null and empty pages have an empty text. Pages with a null
    or malformed url are of the host ''. Repeated rows are extracted as often as they come; an empty table gives no rows. The
    recurring subtrees are broadcast if they measure at most `broadcast_bytes`, else joined to the subtrees of each page."""
    spark = pages.sparkSession
    kind = pages.schema[id_col].dataType
    rows = pages.select(F.col(id_col).alias("id"), F.col(url).alias("url"), F.col(html).alias("html"), host_of(url).alias("host"))
    found = stage(_scan(pages, url, html), "pages")
    often = stage(recurring_subtrees(found, **limits), "templates")
    size = often.agg(F.sum(F.octet_length("host") + 32)).first()[0] or 0
    held = None
    if size <= broadcast_bytes:
        lists: dict[str, dict[int, int]] = {}
        for r in often.collect():
            lists.setdefault(r["host"], {})[r["h"]] = r["level"]
        held = spark.sparkContext.broadcast(lists)
        rows = rows.withColumn("known", F.lit(None).cast("map<bigint,int>"))
    else:
        each = found.dropDuplicates(["page"]).select("page", "host", F.explode("hashes").alias("h"))
        hit = lookup_join(each, often, ["host", "h"], size, "inner")
        known = hit.groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("h", "level"))).alias("known"))
        rows = lookup_join(_keyed(rows), known, ["page"], 1 << 62, "left").drop("page")

    def run(batches):
        lists = None if held is None else held.value  # by host; else each row brings its own
        for batch in batches:
            done = []
            for page, host, known in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                done.append(main_text(page, dict(known or ()) if lists is None else lists.get(host)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([t for t, _ in done], pa.string()),
                 pa.array([n for _, n in done], pa.int64())], names=[id_col, url, "text", "template_chars"])

    ship_with_tasks(__name__)
    return rows.select("id", "url", "html", "host", "known").mapInArrow(
        run, f"`{id_col}` {kind.simpleString()}, `{url}` string, text string, template_chars bigint")
