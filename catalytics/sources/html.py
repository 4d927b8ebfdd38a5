"""HTML pages -> tables.

Python only reads a page into its nodes, elements and texts in document order:
``page_nodes`` adds one array of node structs per page, without recursion, so any
nesting depth works. A node knows its parent and where its subtree ends (``last``), so a subtree is a
slice of the array. Cards, fields and links are chosen from those arrays by
built-in functions: filters of slices, no joins and no shuffle, as a page's nodes
never leave its row. One bad page never fails the job: it has no nodes.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import reduce
from html.parser import HTMLParser
from operator import and_, or_
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed

NODES = ("array<struct<node int, parent int, last int, tag string, id string, classes array<string>, href string, src string, "
         "title string, link string, text string>>")
NODE_TYPES = [("node", pa.int32()), ("parent", pa.int32()), ("last", pa.int32()), ("tag", pa.string()), ("id", pa.string()),
              ("classes", pa.list_(pa.string())), ("href", pa.string()), ("src", pa.string()), ("title", pa.string()),
              ("link", pa.string()), ("text", pa.string())]
#: Nodes after which a task hands on the pages read so far.
BATCH_NODES = 1 << 15
#: What the original's text trimming takes as white space.
SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


# --- pages -> nodes ------------------------------------------------------------------------

class _Reader(HTMLParser):
    """Nodes of one page as rows in the order of ``NODE_TYPES``; a text has no tag, row 0 is the page itself."""

    def __init__(self, html: str, url: str | None):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = [[0, -1, 0, "#root", *[None] * 7]]
        self._url, self._open, self._count = url, [0], Counter()
        self.feed(html)
        self.close()
        for i in self._open:
            self.rows[i][2] = len(self.rows)

    def _add(self, tag, attrs=(), text=None):
        got = {k: v or "" for k, v in reversed(attrs)}  # the first of repeated attributes holds
        link = _joined(self._url, got["href"]) if got.get("href") else None
        n = len(self.rows)
        self.rows.append([n, self._open[-1], n + 1, tag, got.get("id"), got.get("class", "").split(), got.get("href"), got.get("src"),
                          got.get("title"), link, text])

    def handle_starttag(self, tag, attrs):
        self._add(tag, attrs)
        if tag not in fixed.VOID_ELEMENTS:
            self._open.append(len(self.rows) - 1)
            self._count[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self._add(tag, attrs)

    def handle_endtag(self, tag):
        while self._count[tag]:
            row = self.rows[self._open.pop()]
            self._count[row[3]] -= 1
            row[2] = len(self.rows)
            if row[3] == tag:
                return

    def handle_data(self, data):
        self._add(None, text=data)


def _joined(url, href):
    try:
        return urljoin(url or "", href)
    except ValueError:  # not an address, e.g. an open bracket in its host
        return href


def _rows(html, url) -> list[list] | None:
    try:
        return None if html is None else _Reader(html, url).rows
    except Exception:  # noqa: BLE001 - the parser gives up on some broken markup: no nodes
        return None


def page_nodes(pages: DataFrame, keys: list[str], html_col: str = "html", url_col: str | None = None) -> DataFrame:
    """``keys`` and ``nodes`` of every page; ``link`` of a node is its href resolved against ``url_col``.

    ``nodes`` is null for null pages and for those beyond parsing.
    """
    def run(batches):
        for batch in batches:
            found, start, size = [], 0, 0
            urls = batch.column(len(keys) + 1).to_pylist() if url_col else [None] * batch.num_rows
            for i in range(batch.num_rows):
                found.append(_rows(batch.column(len(keys))[i].as_py(), urls[i]))
                size += len(found[-1] or ())
                if size > BATCH_NODES or i == batch.num_rows - 1:
                    yield _with_nodes(batch.slice(start, len(found)), keys, found)
                    found, start, size = [], i + 1, 0

    types = dict(pages.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + f", nodes {NODES}"
    return pages.select(*keys, F.col(html_col).alias("_html"), *([F.col(url_col).alias("_url")] if url_col else [])).mapInArrow(run, schema)


def _with_nodes(batch, keys, found):
    rows = [row for page in found for row in page or ()]
    columns = list(zip(*rows)) if rows else [()] * len(NODE_TYPES)
    nodes = pa.StructArray.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, NODE_TYPES)], names=[n for n, _ in NODE_TYPES])
    offsets = [0]
    for page in found:
        offsets.append(offsets[-1] + len(page or ()))
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), nodes, mask=pa.array([page is None for page in found]))
    return pa.RecordBatch.from_arrays([*batch.columns[:len(keys)], lists], [*keys, "nodes"])


# --- choosing nodes ------------------------------------------------------------------------

Test = Callable[[Column], Column]


def element(tag: str | None = None, classes: str = "", id: str | None = None, whole: str | None = None,
            parts: tuple[str, ...] = ()) -> Test:
    """Test of a node: its tag, classes it has among others, its id, all its classes in order, a part of any of its classes."""
    def test(x):
        checks = [x["tag"] == tag if tag else x["tag"].isNotNull()]
        checks += [x["id"] == id] if id else []
        checks += [F.array_contains(x["classes"], c) for c in classes.split()]
        checks += [F.array_join(x["classes"], " ") == whole] if whole else []
        if parts:
            names = F.array_join(x["classes"], " ")
            checks.append(reduce(or_, [F.contains(names, F.lit(p)) for p in parts]))
        return reduce(and_, checks)
    return test


def subtree(nodes: Column, at: Column) -> Column:
    """What is inside element ``at`` of ``nodes``, a page's or those of a subtree."""
    return F.slice(nodes, at["node"] - F.get(nodes, F.lit(0))["node"] + 2, at["last"] - at["node"] - 1)


def find_all(nodes: Column, test: Test) -> Column:
    return F.filter(nodes, test)


def find(nodes: Column, test: Test) -> Column:
    """First node that passes, null if none."""
    return F.get(F.filter(nodes, test), F.lit(0))


def find_inside(nodes: Column, outer: Test, inner: Test) -> Column:
    """All nodes that pass ``inner`` at any depth inside one that passes ``outer``, each once.

    Only outermost ``outer`` nodes are searched: their subtrees are disjoint, so the work is linear in the nodes.
    """
    tops = F.aggregate(F.filter(nodes, outer), F.slice(nodes, 1, 0), lambda done, x: F.when(
        x["node"] >= F.coalesce(F.get(done, F.size(done) - 1)["last"], F.lit(0)), F.concat(done, F.array(x))).otherwise(done))
    return F.flatten(F.transform(tops, lambda top: F.filter(subtree(nodes, top), inner)))


def either(first: Column, second: Column) -> Column:
    """Nodes of two lists in document order, each once (the number is a node's first field)."""
    return F.array_sort(F.array_distinct(F.concat(first, second)))


def strip(text: Column) -> Column:
    return F.trim(text, F.lit(SPACES))


def strings(nodes: Column) -> Column:
    return F.transform(F.filter(nodes, lambda x: x["tag"].isNull()), lambda x: x["text"])


def text_in(nodes: Column) -> Column:
    return strip(F.array_join(strings(nodes), ""))


def text_of(nodes: Column, at: Column) -> Column:
    return text_in(subtree(nodes, at))


# --- E1-E8: cards of a result page ----------------------------------------------------------

CARD_COLUMNS = ["url", "name", "price", "original_price", "discount_percentage", "rating", "sales_info", "image_url", "additional_badges"]


def _absolute(address: Column, base: str) -> Column:
    return (F.when(address.startswith("//"), F.concat(F.lit("https:"), address))
            .when(address.startswith("/"), F.concat(F.lit(base), address)).otherwise(address))


def _amount(inside: Column) -> Column:
    """Currency and number from their spans (a fourth one, after a dot, holds decimals), else all text pieces."""
    spans = F.transform(find_all(inside, element("span")), lambda x: text_of(inside, x))
    decimals = F.when((F.size(spans) == 4) & (F.get(spans, F.lit(2)) == "."), F.concat(F.lit("."), F.get(spans, F.lit(3)))).otherwise("")
    pieces = F.filter(F.transform(strings(inside), strip), lambda s: s != "")
    return F.when(F.size(spans) >= 2, F.concat(F.array_join(F.slice(spans, 1, 2), " "), decimals)) \
        .otherwise(F.replace(F.array_join(pieces, " "), F.lit(" . "), F.lit(".")))


def _badges(inside: Column) -> Column:
    """Distinct badge texts in sorted order (the original's order is that of a set: undefined), null if none."""
    holder, label, block, picture, caption = (element(*e) for e in fixed.CARD_BADGES)
    holders = find_all(inside, holder)
    labels = F.flatten(F.transform(holders, lambda h: F.transform(
        F.filter(subtree(inside, h), lambda x: label(x) & (x["parent"] == h["node"])), lambda x: text_of(inside, x))))

    def of_block(at):
        own = subtree(inside, at)
        title = find(own, picture)["title"]
        captions = F.array_join(F.transform(strings(subtree(own, find(own, caption))), strip), "")
        return F.when(title != "", strip(title)).otherwise(captions)

    blocks = F.filter(F.transform(find_all(inside, block), of_block), lambda s: s.isNotNull())
    found = F.array_sort(F.array_union(F.filter(labels, lambda s: s != ""), blocks))
    return F.when(F.size(found) > 0, F.array_join(found, " | "))


def extract_cards(pages: DataFrame, base: str = fixed.MARKETPLACE_BASE, page_col: str = "page_number",
                  html_col: str = "html") -> DataFrame:
    """S11 (E1-E8): one listing row per card that is a direct child of the container.

    ``position`` is the card's index on its page, so (page, position) is the
    file order of the original CSV. Pages without a container, null pages and
    pages beyond parsing give no rows.
    """
    container, card = element("div", id=fixed.CARD_CONTAINER), element("div", whole=fixed.CARD_CLASSES)
    inside, parsed = F.col("inside"), page_nodes(pages, [page_col], html_col).withColumn("container", find(F.col("nodes"), container))
    cards = F.transform(F.filter(subtree(F.col("nodes"), F.col("container")), lambda x: card(x) & (x["parent"] == F.col("container.node"))),
                        lambda x: subtree(F.col("nodes"), x))
    rows = parsed.select(F.col(page_col).cast("int").alias("page_number"), F.posexplode(cards).alias("position", "inside"))

    # elements first, then their subtrees, then the values: columns that are used more than once are worked out once
    at = {field: F.col(f"_{field}") for field in fixed.CARD_ELEMENTS}
    rows = rows.withColumns({f"_{field}": find(inside, element(*e)) for field, e in fixed.CARD_ELEMENTS.items()})
    rows = rows.withColumn("_amount", subtree(inside, at["price"]))
    values = {field: F.when(x.isNotNull(), text_of(inside, x)) for field, x in at.items()}
    values["sales_info"] = F.ltrim(values["sales_info"], F.lit(fixed.SALES_LEAD))
    values["price"] = F.when(at["price"].isNotNull(), _amount(F.col("_amount")))
    values["url"] = _absolute(at["url"]["href"], base)
    values["image_url"] = _absolute(at["image_url"]["src"], base)
    values["additional_badges"] = _badges(inside)
    return rows.select("page_number", "position", *[F.coalesce(values[c], F.lit(fixed.SENTINEL)).alias(c) for c in CARD_COLUMNS])


# --- E9-E12: one retail detail page ---------------------------------------------------------

DETAIL_COLUMNS = ["name", "price", "rating", "reviews_count"]


def _name(inside: Column, style: str) -> Column:
    """Primary and alternative product name, inside the title heading, in the form of the source."""
    primary, other = (F.coalesce(text_in(subtree(inside, find(inside, element(*e)))), F.lit("")) for e in fixed.DETAIL_NAME_PARTS)
    if style == "paren":
        full = F.when(other != "", F.concat(primary, F.lit(" ("), other, F.lit(")"))).otherwise(primary)
    else:
        full = F.concat_ws(" ", F.nullif(primary, F.lit("")), F.nullif(other, F.lit("")))
    return F.when(inside.isNotNull(), F.when(full == "", F.lit(fixed.DETAIL_NO_NAME)).otherwise(full))


def _price_span(inside: Column, style: str) -> Column:
    """The wanted span of a price block, or its first."""
    first = find(inside, element("span"))
    return F.coalesce(find(inside, element("span", parts=fixed.DETAIL_PRICE_PARTS)), first) if style == "joined" else first


def _reviews_at(nodes: Column, style: str) -> Column:
    """The number in either review block: the first of the page (joined form) or the first block's."""
    first, other = (find_inside(nodes, *(element(*e) for e in place)) for place in fixed.DETAIL_REVIEWS)
    return F.get(either(first, other) if style == "joined" else F.concat(first, other), F.lit(0))


def extract_details(pages: DataFrame, style: str = "joined", url_col: str = "url",
                    html_col: str = "html") -> DataFrame:
    """One record per page, in one of the two sources' forms.

    ``joined`` -> "primary alt", ``paren`` -> "primary (alt)". A page that did not load (null) or that is beyond parsing
    has the form's marker as its name.
    """
    nodes, price, label = F.col("nodes"), F.col("_price_text"), F.col("_tax")
    read = page_nodes(pages, [url_col], html_col).withColumns({
        "_title": subtree(nodes, find(nodes, element("h1", id=fixed.DETAIL_TITLE))),
        "_price": subtree(nodes, F.get(find_inside(nodes, *(element(*e) for e in fixed.DETAIL_PRICE)), F.lit(0))),
        "_rating": text_in(subtree(nodes, find(nodes, element(*fixed.DETAIL_RATING)))),
        "_reviews": text_in(subtree(nodes, _reviews_at(nodes, style))),
        "_label": text_in(subtree(nodes, find(nodes, element(*fixed.DETAIL_REVIEWS_LABEL)))) if style == "joined" else F.lit(None).cast("string")})
    read = read.withColumns({"_price_text": text_in(subtree(F.col("_price"), _price_span(F.col("_price"), style))),
                             "_tax": text_in(subtree(F.col("_price"), find(F.col("_price"), element(*fixed.DETAIL_TAX_LABEL))))})
    values = {
        "name": F.coalesce(_name(F.col("_title"), style), F.when(nodes.isNotNull(), F.lit(fixed.DETAIL_NO_H1)).otherwise(fixed.DETAIL_ERROR_NAMES[style])),
        "price": F.when(label.isNotNull() & (price != fixed.SENTINEL), F.concat(price, F.lit(" ("), label, F.lit(")"))).otherwise(price),
        "rating": F.col("_rating"),
        "reviews_count": F.translate(F.coalesce("_reviews", F.when(F.contains(F.lower("_label"), F.lit(fixed.REVIEW_WORD)), F.col("_label"))), "()", ""),
    }
    return read.select(F.col(url_col).alias("url"), *[F.coalesce(values[c], F.lit(fixed.SENTINEL)).alias(c) for c in DETAIL_COLUMNS])


# --- E13: link lists --------------------------------------------------------------------------

def product_cards(nodes: Column) -> Column:
    """The product cards of a retail listing page, of both sources."""
    return either(*(find_inside(nodes, *(element(*e) for e in place)) for place in fixed.PRODUCT_CARDS))


def page_links(pages: DataFrame, cards: Callable[[Column], Column] | None = None, link: tuple[str, ...] = ("a",), cap: int | None = None,
               id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Each page's links, resolved against its address, distinct, in document order.

    With ``cards`` (e.g. ``product_cards``) one link per card, the first element that fits ``link``; without,
    every link of the page. ``cap`` keeps the first so many of a page (the
    original's limit is ``fixed.MAX_LINKS``; None, the default, keeps all).
    """
    nodes = F.col("nodes")
    found = find_all(nodes, element(*link)) if cards is None else \
        F.transform(cards(nodes), lambda card: find(subtree(nodes, card), element(*link)))
    links = F.array_distinct(F.filter(F.transform(found, lambda x: x["link"]), lambda x: x.isNotNull()))
    links = links if cap is None else F.slice(links, 1, cap)
    rows = page_nodes(pages, [id_col], html_col, url_col).select(id_col, F.posexplode(links).alias("_at", "link"))
    return rows.select(id_col, (F.col("_at") + 1).alias("rank"), "link")
