"""Licences of documents: TF-IDF cosine to templates, then inheritance from the nearest directory; Spark expressions only.

Texts are cut into units (lines, and the sentences of a line): a notice is looked for in a line or sentence of its own. A unit and a template are vectors of
terms weighted by frequency and by how rare the term is among all documents, counted for every term of a unit; the licence of a text is that of the
template most similar to one of its units, from ``LEAST`` on. By Cauchy-Schwarz such a unit holds one of a template's heavy
terms, so texts and units without any are passed over before terms are taken; nothing that could match is lost.

A licence file speaks for its directory and what lies below. Directories, not documents, are joined with
their ancestors; each takes the licence of the nearest one that has a licence file.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubegraph.llm.base import join_on, read, register, store, text_of

LEAST = 0.6
UNIT_BREAK = r"\n|[.!?;]+[ \t]+"
TERM_BREAK = r"[^a-z0-9]+"
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice)[^/]*$"

#: Names and notices of public licences.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work, CC0"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)


def template_terms() -> list[tuple[int, str, str, int]]:
    """(template, licence, term, times)."""
    out = []
    for k, (name, text) in enumerate(TEMPLATES):
        terms = [t for t in "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split() if t]
        out += [(k, name, t, terms.count(t)) for t in sorted(set(terms))]
    return out


def terms_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), TERM_BREAK), "")


def rarity(docs: DataFrame) -> tuple[int, dict[str, float]]:
    """Number of documents, and for each term of a template its inverse document frequency over all of them."""
    words = sorted({t for _, _, t, _ in template_terms()})
    known = F.array(*[F.lit(w) for w in words])
    found = docs.select(F.explode(F.array_intersect(terms_of(text_of(docs)), known)).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    total = docs.count()
    holds = {r["term"]: r["n"] for r in found.collect()}  # at most one row per template term
    return total, {w: math.log((1 + total) / (1 + holds.get(w, 0))) + 1 for w in words}


def term_rarity(docs: DataFrame, terms: DataFrame, total: int) -> DataFrame:
    """(term, idf) of the distinct ``terms``, from the number of documents that hold each."""
    held = docs.select(F.explode(F.array_distinct(terms_of(text_of(docs)))).alias("term"))
    found = held.groupBy("term").agg(F.count("*").alias("n"))  # first, so that a common term shrinks in the map tasks
    n = F.coalesce(F.col("n"), F.lit(0))
    return terms.join(found, "term", "left").select("term", (F.log((1 + F.lit(total)) / (1 + n)) + 1).alias("idf"))


def heavy_terms(idf: dict[str, float], least: float = LEAST) -> list[str]:
    """Terms such that a unit without any of them has a cosine below ``least`` to every template."""
    vectors: dict[int, list[tuple[float, str]]] = {}
    for k, _, term, times in template_terms():
        vectors.setdefault(k, []).append((times * idf[term], term))
    needed = set()
    for weights in vectors.values():
        weights.sort()
        room = (least * 0.999) ** 2 * sum(w * w for w, _ in weights)
        for w, term in weights:
            room -= w * w
            if room <= 0:
                needed.add(term)
    return sorted(needed)


def own_licences(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, place, licence, similarity) of the texts with a similar unit; ``place`` is a hash of the text."""
    spark = docs.sparkSession
    total, idf = rarity(docs)
    pattern = "(?i)(?<![A-Za-z0-9])(" + "|".join(heavy_terms(idf, least)) + ")(?![A-Za-z0-9])"
    text = text_of(docs)
    likely = docs.select("doc_id", text.alias("text")).filter(F.col("text").rlike(pattern))
    units = likely.select(
        "doc_id", F.xxhash64("text").alias("place"), F.explode(F.array_distinct(F.filter(F.split("text", UNIT_BREAK), lambda u: u.rlike(pattern)))).alias("unit")
    )
    # The same notice stands in many texts: each distinct unit is compared once, and goes by its digest, as units may be long.
    units = store(units.withColumn("key", F.md5("unit")).distinct(), "licence-units")
    terms = units.dropDuplicates(["key"]).select("key", terms_of(F.col("unit")).alias("terms")).select("key", F.explode("terms").alias("term"))
    weighted = terms.groupBy("key", "term").agg(F.count("*").alias("times"))
    rare = spark.createDataFrame([(w, float(x)) for w, x in idf.items()], "term string, idf double")
    templates = spark.createDataFrame(template_terms(), "template int, licence string, term string, t_times int").join(F.broadcast(rare), "term").select(
        "template", "licence", "term", (F.col("t_times") * F.col("idf")).alias("t_weight")
    )
    weighted = store(weighted, "licence-terms")
    known = store(term_rarity(docs, weighted.select("term").distinct(), total), "licence-rarity")
    weighted = store(weighted.join(known, "term").select("key", "term", (F.col("times") * F.col("idf")).alias("weight")), "licence-weights")
    norms = weighted.groupBy("key").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    t_norms = templates.groupBy("template").agg(F.sqrt(F.sum(F.col("t_weight") * F.col("t_weight"))).alias("t_norm"))
    dots = weighted.join(F.broadcast(templates), "term").groupBy("key", "template", "licence").agg(
        F.sum(F.col("weight") * F.col("t_weight")).alias("dot")
    )
    cosine = F.round(F.col("dot") / (F.col("norm") * F.col("t_norm")), 6)
    scores = (
        dots.join(F.broadcast(t_norms), "template").join(norms, "key").select("key", "licence", cosine.alias("similarity")).filter(F.col("similarity") >= least)
    )
    best = scores.groupBy("key").agg(F.min(F.struct((-F.col("similarity")).alias("order"), "licence")).alias("best"))
    scored = store(best.select("key", "best"), "licence-scores")
    return store(
        units.select("doc_id", "place", "key").join(scored, "key").groupBy("doc_id", "place").agg(F.min("best").alias("best"))
        .select("doc_id", "place", F.col("best.licence").alias("licence"), (-F.col("best.order")).alias("similarity")),
        "own-licences",
    )


def parent(path: Column) -> Column:
    """The directory of a path, "" for a file at the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(directory: Column) -> Column:
    """The directory itself and all above it, with their depths; the top is "" at depth 0."""
    parts = F.filter(F.split(directory, "/"), lambda p: p != "")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("above"))
    )


def licensed(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, path, licence, similarity, origin, licence_doc of documents (doc_id, text, path).

    ``origin`` is "own" where a unit of the text matches, "directory" where the nearest ancestor directory with a licence file gives
    its licence (``licence_doc`` is that file's doc_id), else null. Of several licence files in a directory, the first by path, then
    by doc_id speaks. A null or empty text has no licence of its own; a null path inherits nothing. Repeated
    rows give repeated results, an empty table an empty result. Only doc_id, text and path are read.
    """
    own = own_licences(docs, least)
    rows = docs.select("doc_id", F.xxhash64(text_of(docs)).alias("place"), "path")
    found = store(join_on(rows, own, ["doc_id", "place"], "left").withColumn("directory", parent(F.col("path"))), "licence-rows")
    files = found.filter(F.col("licence").isNotNull() & F.col("path").rlike(LICENCE_FILE)).groupBy(F.col("directory").alias("above")).agg(
        F.min(F.struct("path", F.col("doc_id").isNull().alias("none"), "doc_id", "licence")).alias("file")
    )
    files = store(files.select("above", F.col("file.doc_id").alias("licence_doc"), F.col("file.licence").alias("inherited")), "licence-files")
    directories = found.filter(F.col("directory").isNotNull()).select("directory").distinct()
    near = directories.select("directory", F.explode(ancestors(F.col("directory"))).alias("a")).select("directory", "a.depth", "a.above")
    nearest = near.join(files, "above").groupBy("directory").agg(F.max(F.struct("depth", "licence_doc", "inherited")).alias("from"))
    nearest = store(nearest.select("directory", "from.licence_doc", "from.inherited"), "directory-licences")
    has = F.col("licence").isNotNull()
    return found.join(nearest, "directory", "left").select(
        "doc_id", "path", F.coalesce("licence", "inherited").alias("licence"), "similarity",
        F.when(has, "own").when(F.col("inherited").isNotNull(), "directory").alias("origin"),
        F.when(~has, F.col("licence_doc")).alias("licence_doc"),
    )


def with_paths(docs: DataFrame) -> DataFrame:
    """Documents with a path in a tree that their ids make: directories of a hundred within a thousand; each tenth is a licence file."""
    top, low = F.concat(F.lit("r"), F.expr("doc_id div 1000")), F.concat(F.lit("/d"), F.expr("doc_id div 100 % 10"))
    path = (
        F.when(F.col("doc_id") % 50 == 7, F.concat(top, F.lit("/COPYING-"), "doc_id"))
        .when(F.col("doc_id") % 10 == 0, F.concat(top, low, F.lit("/LICENSE-"), "doc_id"))
        .otherwise(F.concat(top, low, F.lit("/"), "doc_id", F.lit(".txt")))
    )
    return docs.select("doc_id", "text", path.alias("path"))


def _sql() -> str:
    rows = ", ".join(f"({k}, '{n}', '{t}', {c})" for k, n, t, c in template_terms())
    return rf"""
WITH p AS MATERIALIZED (SELECT doc_id, COALESCE(text, '') AS t, CASE WHEN doc_id % 50 = 7 THEN 'r' || doc_id // 1000
    WHEN TRUE THEN 'r' || doc_id // 1000 || '/d' || doc_id // 100 % 10 END AS dir,
  CASE WHEN doc_id % 50 = 7 THEN '/COPYING-' || doc_id WHEN doc_id % 10 = 0 THEN '/LICENSE-' || doc_id ELSE '/' || doc_id || '.txt' END AS name FROM documents),
tt(template, licence, term, times) AS (VALUES {rows}),
u AS MATERIALIZED (SELECT doc_id, k, UNNEST(regexp_split_to_array(lower(unit), '[^a-z0-9]+')) AS term
  FROM (SELECT doc_id, unit, row_number() OVER () AS k FROM (SELECT doc_id, UNNEST(regexp_split_to_array(t, '\n|[.!?;]+[ \t]+')) AS unit FROM p))),
f AS MATERIALIZED (SELECT term, ln((1 + (SELECT COUNT(*) FROM p)) / (1 + COUNT(DISTINCT doc_id))) + 1 AS idf FROM (SELECT term FROM tt UNION SELECT term FROM u) LEFT JOIN u USING (term) GROUP BY term),
w AS MATERIALIZED (SELECT doc_id, k, term, COUNT(*) * MAX(idf) AS weight FROM u JOIN f USING (term) WHERE term <> '' GROUP BY doc_id, k, term),
n AS MATERIALIZED (SELECT k, SQRT(SUM(weight * weight)) AS norm FROM w GROUP BY k),
tw AS MATERIALIZED (SELECT template, licence, term, times * idf AS weight FROM tt JOIN f USING (term)),
tn AS (SELECT template, SQRT(SUM(weight * weight)) AS norm FROM tw GROUP BY template),
s AS (SELECT doc_id, licence, ROUND(dot / (n.norm * tn.norm), 6) AS similarity
  FROM (SELECT doc_id, k, template, licence, SUM(w.weight * tw.weight) AS dot FROM w JOIN tw USING (term) GROUP BY ALL) JOIN n USING (k) JOIN tn USING (template)),
o AS MATERIALIZED (SELECT doc_id, licence, similarity FROM s WHERE similarity >= {LEAST} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY similarity DESC, licence) = 1),
l AS MATERIALIZED (SELECT dir AS above, doc_id AS licence_doc, licence AS inherited FROM p JOIN o USING (doc_id)
  WHERE regexp_matches(name, '^/(LICENSE|COPYING)') QUALIFY row_number() OVER (PARTITION BY dir ORDER BY dir || name, doc_id) = 1)
SELECT p.doc_id, p.dir || p.name AS path, COALESCE(o.licence, l1.inherited, l2.inherited) AS licence, o.similarity,
  CASE WHEN o.licence IS NOT NULL THEN 'own' WHEN COALESCE(l1.inherited, l2.inherited) IS NOT NULL THEN 'directory' END AS origin,
  CASE WHEN o.licence IS NULL THEN COALESCE(l1.licence_doc, l2.licence_doc) END AS licence_doc
FROM p LEFT JOIN o USING (doc_id) LEFT JOIN l l1 ON l1.above = p.dir LEFT JOIN l l2 ON l2.above = split_part(p.dir, '/', 1)"""


@register(_sql())
def op6_licence_scan(spark, sf_dir):
    return licensed(with_paths(read(spark, sf_dir, "documents")))
