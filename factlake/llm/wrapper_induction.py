"""Main text of web pages by wrapper induction over the pages of a host.

Every page is parsed to a tree of its block elements. A slot is the path of an
element (tags and classes, digits in classes folded) with the text it holds. Over
all distinct pages of a host it is counted on how many pages a path occurs and on
how many a slot does. Slots with one text on most of the pages that have their
path, on LEAST pages or more, are the host's template; those that vary hold
content. The same is decided among the pages of one layout (the containers a page
has), so that a template of a few pages is found beside a large one. The wrapper
of a layout is the list of its template slots. A page's article is every block
that is neither a template slot nor part of an element that is marked as a menu,
a header or footer of the page, a sidebar, a form, a hidden part and the like: by
its tag, role or hidden attribute, or, for elements that hold other blocks, by a
class or id that as a whole is a name of such a part. A page of which nothing
would be left, or of a host with fewer pages, is judged by the marks alone.

Null html is an empty page; an empty page has an empty text. Null urls are one
host. Repeated ids and rows each keep their row. Markup that ends in the middle
of a tag or element counts as closed there. Pages are never cut. Extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factlake.session import materialize

# Pages with the same text in a slot that make a template.
LEAST = 3
# Levels of containers that tell layouts apart.
LEVELS = 4

# Elements by their role, and names of parts that are no article.
_RAW = "script|style|noscript|template|textarea|iframe|svg|select|title"
_BLOCK = set(
    "html head body div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd article section main nav aside header footer form "
    "table thead tbody tfoot tr td th caption blockquote pre figure figcaption fieldset address details summary "
    "center dialog menu hr".split()
)
_VOID = {"hr", "br", "img", "meta", "link", "input", "col", "area", "base", "embed", "source", "track", "wbr"}
# Elements that are text themselves: names do not mark them.
_LEAF = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "td", "th", "blockquote", "pre", "figcaption",
         "figure", "caption", "details", "summary", "hr"}
_NO_ARTICLE = {"nav", "aside", "footer", "form", "head", "menu", "dialog", "fieldset"}
_NAME = re.compile(
    r"(?:(?:site|page|main|top|bottom|left|right|global|primary|secondary|post|entry|cookie|gdpr|email|user)[_-]?)?"
    r"(?:ads?|adv|adverts?|advertisements?|sponsor|sponsored|promo|banner|cookies?|consent|gdpr|notices?|alert|popup|"
    r"modal|newsletter|subscribe|signup|login|sidebar|related|recommended|share|sharing|social|menu|nav|navbar|"
    r"navigation|breadcrumbs?|pagination|pager|footer|masthead|topbar|comments?|reply|replies|respond|disqus|search|"
    r"site-header|page-header|widget)"
    r"(?:[_-]?(?:bar|box|list|section|area|block|wrap|wrapper|container|widget|left|right|top|bottom|links?|form|"
    r"notice|banner|buttons?|icons?|posts?|articles?|thread|slot|unit))?", re.I
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + _RAW + r")\b[^>]*(?:>.*?(?:</\1\s*>|\Z)|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_DIGITS = re.compile(r"[0-9]+")
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert"}
_CLOSES_P = _BLOCK - {"html", "head", "body"}


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


@lru_cache(maxsize=65536)
def _below(path: int, sign: str) -> int:
    """The hash of the path one element further down."""
    return _hash(f"{path}/{sign}")


class Node:
    __slots__ = ("tag", "path", "dropped", "parent", "level")

    def __init__(self, tag, path, dropped, parent):
        self.tag, self.path, self.dropped, self.parent = tag, path, dropped, parent
        self.level = parent.level + 1 if parent else 0


def parse(page: str) -> tuple[int, list[tuple[Node, str]]]:
    """The layout, and the page's text blocks in order with their element."""
    at = Node("", 0, False, None)
    containers: set[int] = set()
    blocks: list[tuple[Node, str]] = []
    run: list[str] = []
    place = 0

    def flush():
        if run:
            text = " ".join(entities.unescape("".join(run)).split())
            run.clear()
            if text:
                blocks.append((at, text))

    for token in _TOKEN.finditer(page):
        if token.start() > place:
            run.append(page[place:token.start()])
        place = token.end()
        tag = token.group(3)
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            run.append(" ")
        if tag not in _BLOCK:
            continue
        flush()
        if token.group(2):
            node = at
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None and node.parent is not None:
                at = node.parent
            continue
        if tag in _CLOSES_P:
            # A paragraph ends where another block begins; so do items, rows and cells.
            ends = {"p"} | ({tag} if tag in ("li", "dt", "dd", "tr", "td", "th") else set())
            if at.tag in ends:
                at = at.parent
        classes, dropped = [], at.dropped or tag in _NO_ARTICLE
        for name, value in _ATTRIBUTE.findall(token.group(4)) if token.group(4) else ():
            name, value = name.lower(), value.strip("\"'")
            if name == "role":
                dropped = dropped or value.lower() in _ROLES
            elif name in ("class", "id") and tag not in _LEAF and tag not in ("html", "body", "article", "main"):
                dropped = dropped or any(map(_NAME.fullmatch, value.split()))
            elif tag not in ("html", "body"):
                dropped = dropped or name == "hidden" or (name == "style" and bool(_UNSEEN.search(value)))
            if name == "class":
                classes = sorted(value.split())
        if tag == "header":
            # The head of an article belongs to it, the head of the page does not.
            node = at
            while node is not None and node.tag not in ("article", "main"):
                node = node.parent
            dropped = dropped or node is None
        child = Node(tag, _below(at.path, _DIGITS.sub("0", ".".join([tag, *classes]))), dropped, at)
        if child.level <= LEVELS and not dropped and tag not in _LEAF:
            containers.add(child.path)
        if tag not in _VOID:
            at = child
    if place < len(page):
        run.append(page[place:])
    flush()
    return _hash(str(sorted(containers))), blocks


def slot_of(node: Node, text: str) -> int:
    return _hash(f"{node.path}:{text}")


def main_text(page: str | None, template: set[int]) -> str:
    """The article's blocks, two line feeds between them."""
    if not page:
        return ""
    marked = [(node, text) for node, text in parse(page)[1] if not node.dropped]
    kept = [text for node, text in marked if slot_of(node, text) not in template] if template else ()
    return "\n\n".join(kept or [text for _, text in marked])


def _slots(batches):
    """A row per page and path, without slot, and per page and slot; both once per page."""
    for batch in batches:
        rows = []
        for host, key, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if not page:
                continue
            layout, blocks = parse(page)
            slots = {(node.path, slot_of(node, text)) for node, text in blocks if not node.dropped}
            rows += [(host, layout, path, slot, key) for path, slot in slots]
            rows += [(host, layout, path, None, key) for path in {path for path, _ in slots}]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(column, type=pa.int64()) for column in zip(*rows, strict=True)],
                ["host", "layout", "path", "slot", "key"],
            )


def _layouts(batches):
    """The pages with the hash of their layout."""
    for batch in batches:
        layouts = [parse(page)[0] if page else 0 for page in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(layouts, type=pa.int64())], ["host", "page_id", "url", "html", "layout"]
        )


def _extract(batches):
    for batch in batches:
        texts = [
            main_text(page, set(template or ()))
            for page, template in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
        ]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, type=pa.string()),
             pa.array([len(t) for t in texts], type=pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )


def host_wrappers(pages: DataFrame) -> DataFrame:
    """``host, layout, template``: the template slots of each layout, from all pages."""
    rows = pages.select("host", F.xxhash64("html").alias("key"), "html").mapInArrow(
        _slots, "host long, layout long, path long, slot long, key long"
    )
    # Copies of a page have one key and count once; the key is part of the first grouping, so that no
    # task holds all slots of a host.
    counted = materialize(
        rows.distinct().groupBy("host", "layout", "path", "slot").agg(F.count(F.lit(1)).alias("n")), "slots"
    )
    texts = counted.filter("slot is not null")

    def constant(*group):
        of_path = counted.filter("slot is null").groupBy(*group, "path").agg(F.sum("n").alias("pages"))
        return (
            texts.groupBy(*group, "path", "slot").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST)
            .join(of_path, [*group, "path"]).filter("2 * n > pages").select(*group, "slot")
        )

    of_host = texts.select("host", "layout", "slot").join(constant("host"), ["host", "slot"], "left_semi")
    return of_host.unionByName(constant("host", "layout")).groupBy("host", "layout").agg(
        F.collect_set("slot").alias("template")
    )


def extract_main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages``."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    named = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
    ).select(F.xxhash64(host).alias("host"), "page_id", "url", "html")
    # Written, so that the planner knows how few they are and pages of a large host stay where they are.
    wrappers = materialize(host_wrappers(named), "wrappers")
    laid_out = named.mapInArrow(_layouts, "host long, page_id long, url string, html string, layout long")
    return laid_out.join(wrappers, ["host", "layout"], "left").select("page_id", "url", "html", "template").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long"
    )
