"""Text functions over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from cubegraph.functions import numbers, text
from cubegraph.plans.registered.base import Query, registrar

QUERIES: dict[str, Query] = {}
query = registrar(QUERIES)


@query("SELECT doc_id FROM documents WHERE CONTAINS(strip_accents(LOWER(text)), 'eleme')")
def search_insensitive(c):
    """Documents holding the term whatever its accents and case."""
    return c.table("documents").filter(text.contains_folded(F.col("text"), " ÉLÈME ")).select("doc_id")


@query("SELECT page_id, url_encode(url) AS segment, md5(url_encode(html)) AS html FROM pages")
def iri_encode(c):
    return c.table("pages").select(
        "page_id",
        text.iri_segment(F.col("url")).alias("segment"),
        F.md5(text.iri_segment(F.col("html"))).alias("html"),
    )


@query("""
SELECT page_id, CASE WHEN regexp_extract(url, '[/#]([^/#]+)$', 1) <> '' THEN regexp_extract(url, '[/#]([^/#]+)$', 1) ELSE url END AS segment
FROM pages""")
def iri_last_segment(c):
    return c.table("pages").select("page_id", text.last_segment(F.col("url")).alias("segment"))


_SPACE = "".join(f"\\x{{{ord(ch):X}}}" for ch in text._SPACES)


@query(rf"""
SELECT doc_id, md5(UPPER(REPLACE(TRIM(regexp_replace(regexp_replace(text, '[^\p{{L}}\p{{N}}{_SPACE}.\-()]', ' ', 'g'), '[{_SPACE}]+', ' ', 'g')), 'ß', 'SS'))) AS label
FROM documents""")
def label_clean(c):
    """The SQL spells out the upper case of the sharp s, which its engine keeps as one letter."""
    return c.table("documents").select(
        "doc_id", F.md5(text.clean_label(F.col("text"))).alias("label")
    )


@query("""
SELECT conv_id, turn, CASE WHEN LENGTH(text) > 30 THEN RTRIM(SUBSTR(text, 1, 29), ' ' || chr(10) || chr(9) || chr(13)) || '…' ELSE text END AS corto
FROM conversations""")
def ellipsis(c):
    return c.table("conversations").select("conv_id", "turn", text.ellipsis(F.col("text")).alias("corto"))


@query("""
SELECT o_orderkey, regexp_replace(printf('%,.2f', ROUND(CAST(o_totalprice AS DECIMAL(18,2)), 2)), '\\.?0+$', '') AS importe,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' WHEN '5-LOW' THEN 'Baja' ELSE o_orderpriority END AS etiqueta,
  'Pedido ' || o_orderkey || ' de {nadie}: ' || o_orderstatus AS frase FROM orders""")
def labels_and_numbers(c):
    """Number text, translated labels with fallbacks and filled placeholders."""
    labels = {"es": {"1-URGENT": "Urgente", "5-LOW": "Baja"}, "en": {"1-URGENT": "Urgent"}}
    template = F.lit("Pedido {clave} de {nadie}: {estado}")
    values = {"clave": F.col("o_orderkey"), "estado": F.col("o_orderstatus")}
    return c.table("orders").select(
        "o_orderkey",
        numbers.number_text(F.col("o_totalprice")).alias("importe"),
        text.translate_label(F.col("o_orderpriority"), "en", labels).alias("etiqueta"),
        text.fill_placeholders(template, values).alias("frase"),
    )
