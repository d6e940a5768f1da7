"""Main text of web pages by wrapper induction.

Pages of one host share a layout. Every page is read into a tree of block elements with runs of like siblings folded; equal
trees are one layout. The layouts of a host are aligned by simple tree matching and united into its wrapper, in
rounds of bounded groups until one tree is left. All pages' texts are then counted at the wrapper's
nodes: a node with one and the same text throughout is template, a node of links is a menu, and the other ones are slots. What a page
has in its slots, outside of elements that by kind or name are not the article, is its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubegraph.llm import html_tree as tree
from cubegraph.llm.base import read, register, store

#: Layouts united in one task and round.
TOGETHER = 64
#: A node is template if at least so many different pages have it and so large a share of its texts are one text.
TEMPLATE_PAGES, TEMPLATE_SHARE = 8, 0.9
#: A node is a menu if so large a share of its characters are in links.
MENU_SHARE = 0.7


def host_of(url: Column) -> Column:
    """The host in lower case; null where the address has none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def layouts_of(pages: DataFrame) -> DataFrame:
    """host, layout, slots (node, digest of the text, characters, characters in links): a row per page that has a host."""
    slot = pa.struct([("node", pa.int32()), ("value", pa.int64()), ("chars", pa.int64()), ("linked", pa.int64())])

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            layouts, slots = [], []
            for page in b.column(1).to_pylist():
                found = tree.read_page(page)
                layouts.append(tree.written(found.root))
                slots.append([
                    (x.node.known().number, int.from_bytes(hashlib.blake2b(x.text.encode(), digest_size=8).digest(), "little", signed=True), len(x.text), x.linked)
                    for x in found.blocks
                ])
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(layouts, pa.string()), pa.array(slots, pa.list_(slot))], names=["host", "layout", "slots"]
            )

    given = pages.select(host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html")).filter(F.col("host").isNotNull())
    return given.mapInArrow(
        described, "host string, layout string, slots array<struct<node:int,value:long,chars:long,linked:long>>"
    )


def united(layouts: list[str]) -> str:
    """One tree that all layouts align with, the first one's order leading."""
    root = tree.parsed(layouts[0])
    for layout in layouts[1:]:
        tree.unite(root, tree.parsed(layout))
    return tree.written(root)


def host_wrappers(layouts: DataFrame) -> DataFrame:
    """host, layout: the wrapper of each host, united from its layouts (host, layout, pages)."""

    def unite(group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values(["pages", "layout"], ascending=[False, True])
        return pd.DataFrame({"host": rows["host"].iloc[:1], "layout": [united(rows["layout"].tolist())], "pages": [rows["pages"].sum()]})

    left = layouts
    while True:
        many = left.groupBy("host").agg(F.count("*").alias("n"))
        most = many.agg(F.max("n")).first()[0]
        if most is None or most == 1:
            return left.select("host", "layout")
        groups = left.join(many, "host").withColumn(
            "part", F.pmod(F.xxhash64("layout"), F.ceil(F.col("n") / TOGETHER))
        )
        left = store(
            groups.select("host", "part", "layout", "pages").groupBy("host", "part").applyInPandas(unite, "host string, layout string, pages long"),
            "wrappers",
        )


def places_in(layouts: DataFrame, wrappers: DataFrame) -> DataFrame:
    """host, layout, places: for every node of a layout its node in the host's wrapper."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = [tree.aligned(tree.parsed(x), tree.parsed(w)) for x, w in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(places, pa.list_(pa.int32()))], names=["host", "layout", "places"]
            )

    both = layouts.select("host", "layout").join(wrappers.withColumnRenamed("layout", "wrapper"), "host")
    return both.mapInArrow(align, "host string, layout string, places array<int>")


def induced(pages: DataFrame) -> DataFrame:
    """host, wrapper, template, menus: a wrapper per host and the numbers of its nodes that are not slots.

    Pages of one layout and equal texts count once, so copies of one article do not make it template.
    """
    found = store(layouts_of(pages), "page-layouts")
    layouts = store(found.groupBy("host", "layout").agg(F.count("*").alias("pages")), "layouts")
    wrappers = host_wrappers(layouts)
    different = found.groupBy("host", "layout", "slots").agg(F.lit(1).alias("one"))
    placed = different.join(places_in(layouts, wrappers), ["host", "layout"])
    # Per page and node; a node that a page repeats has as many texts there.
    texts = placed.select("host", F.xxhash64("layout", "slots").alias("page"), "places", F.explode("slots").alias("slot")).select(
        "host", "page", F.element_at("places", F.col("slot.node") + 1).alias("node"), "slot.value", "slot.chars", "slot.linked"
    )
    by_value = texts.groupBy("host", "node", "value").agg(
        F.count("*").alias("n"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked")
    )
    nodes = by_value.groupBy("host", "node").agg(
        F.sum("n").alias("n"), F.max("n").alias("top"), F.sum("chars").alias("chars"), F.sum("linked").alias("linked")
    )
    listed = nodes.groupBy("host").agg(
        F.sort_array(F.collect_list(F.when((F.col("top") >= TEMPLATE_PAGES) & (F.col("top") >= TEMPLATE_SHARE * F.col("n")), F.col("node")))).alias("template"),
        F.sort_array(F.collect_list(F.when(F.col("linked") >= MENU_SHARE * F.col("chars"), F.col("node")))).alias("menus"),
    )  # bounded by the wrapper's nodes
    return store(wrappers.withColumnRenamed("layout", "wrapper").join(listed, "host", "left"), "host-wrappers")


def content(page: str, kinds: dict[int, str] | None, places: list[int] | None, found: tree.Page) -> str:
    """The texts of a page's slots in page order, with an empty line between two."""
    path: dict[int, list[str]] = {}

    def visit(node: tree.Node, above: list[str]) -> None:
        path[node.number] = [*above, node.label]
        for child in node.children:
            visit(child, path[node.number])

    visit(found.root, [])
    kept = []
    for block in found.blocks:
        number = block.node.known().number
        labels = path[number]
        if tree.is_noise(labels):
            continue
        within = any(map(tree.is_article, labels))
        kind = kinds.get(places[number], "") if kinds and places else ""
        heading = labels[-1].split(".")[0] in ("h1", "h2", "h3", "h4", "h5", "h6")
        if (kind == "template" and not (within and heading)) or (kind == "menu" and not within):
            continue
        kept.append((within, block.text))
    if any(within for within, _ in kept):
        kept = [x for x in kept if x[0]]
    return "\n\n".join(text for _, text in kept)


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page.

    If a page has blocks in an article or main element, only those are its text. Pages without a host, and hosts of
    few pages, have no template: only the kinds and names of elements tell. A null or empty page has an empty text. Rows
    that repeat, or that share or lack a page_id, are read each on its own. An empty table gives an empty result. Only
    page_id, url and html are read, so other columns may have any name.
    """
    wrappers = induced(pages)
    given = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    both = given.join(wrappers, "host", "left").select("page_id", "url", "html", "wrapper", "template", "menus")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, str], list[int]] = {}
        for b in batches:
            texts = []
            for page, wrapper, template, menus in zip(*(b.column(k).to_pylist() for k in range(2, 6))):
                found = tree.read_page(page)
                layout = tree.written(found.root)
                kinds = places = None
                if wrapper is not None:
                    kinds = {**dict.fromkeys(menus or [], "menu"), **dict.fromkeys(template or [], "template")}
                    if (layout, wrapper) not in known:
                        if len(known) >= 10_000:  # only saves time; starts again when large
                            known.clear()
                        known[layout, wrapper] = tree.aligned(tree.parsed(layout), tree.parsed(wrapper))
                    places = known[layout, wrapper]
                texts.append(content(page, kinds, places, found))
            text = pa.array(texts, pa.string())
            size = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), text, size], names=["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return both.mapInArrow(extract, f"page_id {kind}, url string, text string, n_chars long")


@register(
    r"""
WITH a AS (SELECT page_id, url, regexp_extract(COALESCE(html, ''), '<article>(.*)</article>', 1, 's') AS body FROM pages),
b AS (SELECT page_id, url, [trim(regexp_replace(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '<[^>]*>', '', 'g'), '\s+', ' ', 'g'))
    FOR x IN regexp_split_to_array(body, '</?(?:h1|p)>')] AS x FROM a),
t AS (SELECT page_id, url, array_to_string([x FOR x IN x IF x <> ''], chr(10) || chr(10)) AS t FROM b),
u AS (SELECT page_id, url, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'),
    '&gt;?', '>', 'g'), '&amp;?', '&', 'g') AS text FROM t)
SELECT page_id, url, text, length(text) AS n_chars FROM u"""
)
def op12_html_extraction(spark, sf_dir):
    return extracted(read(spark, sf_dir, "pages"))
