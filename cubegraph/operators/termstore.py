"""Graphs as numbers: a dictionary of terms, and triples bucketed by subject within each predicate.

A term's number is a 64-bit digest of its text. The dictionary holds every term once, so terms whose digests meet
are known; all but one of them get other numbers, which a small table remembers. Triples are then
(subject, object) numbers with the value of numeric literals beside them: stars over one subject join bucket by bucket
without an exchange, sums need no look-up, and texts are fetched for the few rows of a result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cubegraph.session import end_table, materialise_buckets, materialise_table, sized
from cubegraph.sources.vocabulary import iri

NUMBER = "decimal(28,6)"
NUMERIC = [iri(t) for t in ("xsd:decimal", "xsd:integer", "xsd:gYear")]
#: What a term is made of; ``form`` is node, text or number.
TERM = ["form", "text", "datatype", "lang"]
#: Terms per bucket, and the most buckets of a graph.
BUCKET_TERMS, MOST_BUCKETS = 100_000, 4096
#: Triples are exchanged in parts of about so many, in so many parts at most.
PART_TRIPLES, MOST_PARTS = 5_000_000, 8


def _form(kind: Column, datatype: Column) -> Column:
    return F.when(kind != "literal", "node").when(datatype.isin(NUMERIC), "number").otherwise("text")


def _value(kind: Column, datatype: Column, text: Column) -> Column:
    return F.when((kind == "literal") & datatype.isin(NUMERIC), text.try_cast(NUMBER))


def digest(form: Column, text: Column, datatype: Column, lang: Column, attempt: int = 0) -> Column:
    """The number of a term at an attempt; absent parts count as empty."""
    return F.xxhash64(F.lit(attempt), form, text, F.coalesce(datatype, F.lit("")), F.coalesce(lang, F.lit("")))


class TextGraph:
    """A graph whose terms are their texts: a DataFrame of triples behind the interface of ``StoredGraph``."""

    def __init__(self, triples: DataFrame):
        self.frame = triples
        self.spark = triples.sparkSession

    def rows(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        """s, p, o, ``node`` (the object is no literal) and ``number`` (of a numeric literal) of the triples asked for."""
        out = self.frame
        if p is not None:
            out = out.filter(F.col("p") == iri(p))
        if s is not None:
            out = out.filter(F.col("s") == iri(s))
        if o is not None:
            out = out.filter((F.col("o") == iri(o)) & (F.col("o_kind") != "literal"))
        kind, datatype = F.col("o_kind"), F.col("datatype")
        return out.select("s", "p", "o", (kind != "literal").alias("node"), _value(kind, datatype, F.col("o")).alias("number"))

    def node(self, name: str | Column) -> Column:
        """What stands for an IRI in the columns s and o."""
        return F.lit(iri(name)) if isinstance(name, str) else name

    def texts(self, df: DataFrame, *columns: str, form: str = "node") -> DataFrame:
        """``df`` with the terms of some columns as text."""
        return df

    def star(self, predicates: list[str]) -> DataFrame | None:
        """Subjects with a triple under each predicate: s, and per predicate, numbered, a column of o, ``node`` and ``number``. None: to be joined."""
        return None


class MappedGraph(TextGraph):
    """A graph whose triples are made when a pattern asks for them: of the maps only those that state its predicate are read.

    ``make`` gives the triples under some predicates, or with None all. Nothing of the graph is stored, so a pattern costs
    what the tables behind its predicate cost, however many triples the others have. ``read_star`` gives what several predicates say
    of one subject, where the rows of single maps tell (``triples.mapped_star``).
    """

    def __init__(
        self, spark: SparkSession, make: Callable[[set[str] | None], DataFrame],
        read_star: Callable[[list[str]], DataFrame | None] = lambda predicates: None,
    ):
        self.spark, self.make, self.read_star = spark, make, read_star

    def star(self, predicates: list[str]) -> DataFrame | None:
        found = self.read_star([iri(p) for p in predicates])
        if found is None:
            return None

        def seen(t: str) -> Column:
            kind, datatype, o = (F.col(f"{t}.{f}") for f in ("o_kind", "datatype", "o"))
            return F.struct(o.alias("o"), (kind != "literal").alias("node"), _value(kind, datatype, o).alias("number")).alias(t)

        return found.select("s", *[seen(f"t{i}") for i in range(len(predicates))])

    @property
    def frame(self) -> DataFrame:
        return self.make(None)

    def rows(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        asked = self.make(None if p is None else {iri(p)})
        return TextGraph(asked).rows(s, p, o)


@dataclass(frozen=True)
class StoredGraph:
    triples: DataFrame
    terms: DataFrame
    moved: DataFrame | None

    @property
    def spark(self):
        return self.triples.sparkSession

    def rows(self, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
        out = self.triples
        if p is not None:
            out = out.filter(F.col("p") == iri(p))
        if s is not None:
            out = out.filter(F.col("s") == self.node(s))
        if o is not None:
            out = out.filter(F.col("o") == self.node(o))
        return out

    def star(self, predicates: list[str]) -> DataFrame | None:
        return None  # bucketed by subject: joined without an exchange

    def node(self, name: str | Column) -> Column:
        if isinstance(name, str):
            name = iri(name)
            if self.moved is not None:
                row = self.moved.filter((F.col("form") == "node") & (F.col("text") == name)).first()
                if row:
                    return F.lit(row["id"])
            name = F.lit(name)
        return digest(F.lit("node"), name, F.lit(None), F.lit(None))

    def numbered(self, df: DataFrame, column: str, form: str = "node", datatype: str | None = None) -> DataFrame:
        """``df`` with the numbers of a column's terms, which are all of one form and datatype and in this graph's dictionary."""
        number = digest(F.lit(form), F.col(column), F.lit(datatype).cast("string"), F.lit(None).cast("string"))
        if self.moved is None:
            return df.withColumn(column, number)
        same = (F.col("__form") == form) & (F.col("__text") == F.col(column)) & F.col("__datatype").eqNullSafe(F.lit(datatype).cast("string"))
        other = self.moved.filter("lang IS NULL").select(
            F.col("form").alias("__form"), F.col("text").alias("__text"), F.col("datatype").alias("__datatype"), F.col("id").alias("__id")
        )
        return df.join(other, same, "left").select(*[F.coalesce("__id", number).alias(c) if c == column else c for c in df.columns])

    def texts(self, df: DataFrame, *columns: str, form: str = "node") -> DataFrame:
        for c in columns:
            names = self.terms.filter(F.col("form") == form).select(F.col("id").alias(c), F.col("text").alias("__text"))
            df = df.join(names, c, "left").drop(c).withColumnRenamed("__text", c)
        return df

    def frame(self) -> DataFrame:
        """The triples in full: s, p, o, o_kind, datatype, lang."""
        subjects = self.terms.filter(F.col("form") == "node").select(F.col("id").alias("s"), F.col("text").alias("subject"))
        objects = self.terms.select(F.col("id").alias("o"), F.col("text").alias("object"), "form", "datatype", "lang")
        kind = F.when(F.col("form") != "node", "literal").when(F.col("object").startswith("_:"), "bnode").otherwise("iri")
        return self.triples.join(subjects, "s").join(objects, "o").select(
            F.col("subject").alias("s"), "p", F.col("object").alias("o"), kind.alias("o_kind"), "datatype", "lang"
        )

    def encoded(self, triples: DataFrame) -> DataFrame:
        """Other triples by this graph's numbers; terms that it lacks have numbers too, which may then belong to no term or to another."""
        return _encoded(triples, self.moved)


Graph = TextGraph | StoredGraph


def as_graph(g: DataFrame | Graph) -> Graph:
    return TextGraph(g) if isinstance(g, DataFrame) else g


def _subject_and_object(triples: DataFrame) -> tuple[DataFrame, DataFrame]:
    nothing = F.lit(None).cast("string")
    subjects = triples.select(F.lit("node").alias("form"), F.col("s").alias("text"), nothing.alias("datatype"), nothing.alias("lang"))
    literal = F.col("o_kind") == "literal"
    objects = triples.select(
        _form(F.col("o_kind"), F.col("datatype")).alias("form"), F.col("o").alias("text"),
        F.when(literal, F.col("datatype")).alias("datatype"), F.when(literal, F.col("lang")).alias("lang"),
    )
    return subjects, objects


def numbered_terms(terms: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(distinct terms with ``id``, those whose number is not their first digest, or None if there are none)."""
    parts = [F.col(c) for c in TERM]
    numbered = materialise_table(terms.select(*TERM, digest(*parts).alias("id")), "terms", partition_by="form")
    moved = None
    attempt = 0
    while True:
        met = numbered.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
        if met.isEmpty():
            return numbered, moved
        attempt += 1
        # The first in order keeps the number; a number's terms are few.
        keepers = numbered.join(met, "id").groupBy("id").agg(F.min(F.struct(*parts)).alias("keeper"))
        again = numbered.join(keepers, "id", "left").select(
            *TERM, "id", (F.col("keeper").isNotNull() & ~F.struct(*parts).eqNullSafe(F.col("keeper"))).alias("moves")
        )
        met_in = numbered
        numbered = materialise_table(
            again.select(*TERM, F.when(F.col("moves"), digest(*parts, attempt=attempt)).otherwise(F.col("id")).alias("id")),
            "terms", partition_by="form",
        )
        end_table(met_in)
        moved = sized(numbered.filter(F.col("id") != digest(*parts)).select(*TERM, "id"), "moved-terms")


def _encoded(triples: DataFrame, moved: DataFrame | None) -> DataFrame:
    nothing = F.lit(None).cast("string")
    literal = F.col("o_kind") == "literal"
    form = _form(F.col("o_kind"), F.col("datatype"))
    datatype, lang = F.when(literal, F.col("datatype")), F.when(literal, F.col("lang"))
    if moved is None:
        s, o = digest(F.lit("node"), F.col("s"), nothing, nothing), digest(form, F.col("o"), datatype, lang)
    else:
        for side, parts in (("s", (F.lit("node"), F.col("s"), nothing, nothing)), ("o", (form, F.col("o"), datatype, lang))):
            other = moved.select(*[F.col(c).alias(f"{side}_{c}") for c in TERM], F.col("id").alias(f"{side}_moved"))
            same = F.lit(True)
            for c, part in zip(TERM, parts):
                same = same & F.col(f"{side}_{c}").eqNullSafe(part)
            triples = triples.join(other, same, "left")
        s = F.coalesce("s_moved", digest(F.lit("node"), F.col("s"), nothing, nothing))
        o = F.coalesce("o_moved", digest(form, F.col("o"), datatype, lang))
    return triples.select(
        s.alias("s"), "p", o.alias("o"), (~literal).alias("node"), _value(F.col("o_kind"), F.col("datatype"), F.col("o")).alias("number")
    )


def store_terms(graph: DataFrame, label: str = "graph", also: DataFrame | None = None) -> StoredGraph:
    """A graph of texts as numbers, stored by predicate and bucketed by subject.

    The dictionary holds the terms of the triples ``also`` too, which are not stored. The texts of the triples end with their encoding.
    """
    texts = materialise_table(graph, f"{label}-texts")  # texts are made once, for the dictionary and for the triples
    subjects, objects = _subject_and_object(texts if also is None else texts.unionByName(also))
    terms, moved = numbered_terms(subjects.unionByName(objects).distinct())
    buckets = min(max(-(-terms.count() // BUCKET_TERMS), 1), MOST_BUCKETS)
    parts = min(max(-(-texts.count() // PART_TRIPLES), 1), MOST_PARTS)
    triples = materialise_buckets(_encoded(texts, moved), label, "s", buckets, partition_by="p", parts=parts)
    end_table(texts)
    return StoredGraph(triples.select("s", "p", "o", "node", "number"), terms, moved)


def count_by_predicate(triples: DataFrame) -> DataFrame:
    """p, n, subjects, objects: triples and distinct terms per predicate of numbered triples.

    Subjects are counted bucket by bucket; objects, of which a few are in most triples, shrink before they are exchanged.
    """
    subjects = (
        triples.groupBy("p", "s").agg(F.count("*").alias("n"))
        .groupBy("p").agg(F.sum("n").alias("n"), F.count("*").alias("subjects"))
    )
    objects = triples.groupBy("p", "o").agg(F.lit(1).alias("one")).groupBy("p").agg(F.count("*").alias("objects"))
    return subjects.join(objects, "p")


def union_parts(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What ``union`` puts together, apart: all of ``a``, and what ``b`` adds. Of bucketed triples each part is grouped without an exchange."""
    names = ["s", "p", "o"]
    return a.select(*names), b.select(*names).join(a.select(*names), names, "left_anti")


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """s, p, o of two sets of numbered triples under one dictionary; what both hold once."""
    first, added = union_parts(a, b)
    return first.unionByName(added)
