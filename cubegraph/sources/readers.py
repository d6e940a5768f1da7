"""Readers: delimited text, databases, JSON documents, polygons and triples."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cubegraph.functions.text import first_present, is_missing, unescape_literal
from cubegraph.session import materialise_table, sized
from cubegraph.sources.schemas import MART_DOCUMENT, POLYGON_NAMES

NULL_TOKENS = ("", "NA")
_NEVER = "\u0001"  # a null marker no file contains


def _text_schema(names: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# A quote inside a quoted field is doubled; a backslash is an ordinary character.
DIALECT = {"quote": '"', "escape": '"'}


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, null_token: str = "NA", multiline: bool = False
) -> DataFrame:
    """Delimited text with a header, columns by position, one null token.

    Values are read as text and cast, so that the token, and only the token or a
    bare empty field, becomes null; a malformed number fails the load, and so does a row with too few or too many fields,
    whatever columns are read. With ``multiline`` quoted fields may hold line breaks; a file
    is then read by one task.
    """
    raw = (
        spark.read.schema(_text_schema(schema.names))
        .option("header", True)
        .option("nullValue", _NEVER)
        .option("enforceSchema", True)
        .option("mode", "FAILFAST")
        .option("columnPruning", False)  # every field is parsed, so a ragged row fails whatever columns are asked for
        .option("multiLine", multiline)
        .options(**DIALECT)
        .csv(path)
    )
    token = F.lit(null_token)
    return raw.select(
        *[F.nullif(F.col(f.name), token).cast(f.dataType).alias(f.name) for f in schema]
    )


def _quotes(text: Column) -> Column:
    return F.length(text) - F.length(F.translate(text, DIALECT["quote"], ""))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of delimited text (file, value), whose quoted fields may hold line breaks; every split of a file is a task of its own.

    A line begins a record if an even number of quotes lies before it in its file. Quotes are counted per split, the counts of earlier
    splits are added up, and each split then tells its records' first lines. Records of one line, nearly all of them, stay
    where they are; only lines of longer ones meet, also across splits.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value", _quotes(F.col("value")).alias("quotes")
    )
    counts = sized(lines.groupBy("file", "split").agg(F.sum("quotes").alias("quotes")), "csv-splits")
    before = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)  # one row per split
    splits = sized(counts.select("file", "split", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).cast("int").alias("odd")), "csv-parity")
    numbered = lines.join(splits, ["file", "split"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple[str, int], tuple[int, int, int]] = {}  # split -> quotes so far, lines, last first line
        for b in batches:
            file, split, quotes, odd = (b.column(b.schema.get_field_index(c)).to_pylist() for c in ("file", "split", "quotes", "odd"))
            line, first, single = [], [], []
            for f, at, q, o in zip(file, split, quotes, odd):
                parity, n, begun = state.get((f, at), (o, 0, -1))
                begun = n if parity == 0 else begun
                after = (parity + q) % 2
                line.append(n)
                first.append(begun)
                single.append(parity == 0 and after == 0)
                state[f, at] = (after, n + 1, begun)
            kept = [b.column(b.schema.get_field_index(c)) for c in ("file", "split", "value")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(line, pa.int64()), pa.array(first, pa.int64()), pa.array(single, pa.bool_())],
                names=["file", "split", "value", "line", "first", "single"],
            )

    told = numbered.mapInArrow(placed, "file string, split long, value string, line long, first long, single boolean")
    parts = materialise_table(told.filter(~F.col("single")), "csv-parts")
    # A split's first lines may go on with the last record begun in an earlier split.
    begun = parts.filter("first >= 0").groupBy("file", "split").agg(F.max("first").alias("last"))
    known = splits.join(begun, ["file", "split"], "left")
    mark = F.when(F.col("last").isNotNull(), F.struct(F.col("split").alias("from_split"), F.col("last").alias("from_first")))
    carried = sized(known.select("file", "split", F.last(mark, ignorenulls=True).over(before).alias("open")), "csv-open")
    keyed = parts.join(carried, ["file", "split"]).select(
        "file", "split", "line", "value",
        F.when(F.col("first") >= 0, F.col("split")).otherwise(F.col("open.from_split")).alias("r_split"),
        F.when(F.col("first") >= 0, F.col("first")).otherwise(F.col("open.from_first")).alias("r_first"),
    )
    long = keyed.groupBy("file", "r_split", "r_first").agg(F.sort_array(F.collect_list(F.struct("split", "line", "value"))).alias("lines"))
    joined = long.select("file", F.col("r_split").alias("split"), F.col("r_first").alias("line"), F.array_join("lines.value", "\n").alias("value"))
    records = told.filter("single").select("file", "split", "line", "value").unionByName(joined)
    return records.select("file", "split", "line", F.regexp_replace("value", "\r$", "").alias("value"))


def read_csv_records(spark: SparkSession, path: str, schema: T.StructType, null_token: str = "NA") -> DataFrame:
    """What ``read_csv`` reads with ``multiline``, a file being read by as many tasks as it has splits.

    The first record of every file is its header; empty lines are none. Text in UTF-8.
    """
    records = csv_records(spark, path).filter((F.col("split") + F.col("line") > 0) & (F.col("value") != ""))
    options = {**DIALECT, "mode": "FAILFAST", "nullValue": _NEVER, "multiLine": "true"}
    text = _text_schema(schema.names).simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
    raw = records.select(F.from_csv("value", text, options).alias("r")).select("r.*")
    token = F.lit(null_token)
    return raw.select(*[F.nullif(F.col(f.name), token).cast(f.dataType).alias(f.name) for f in schema])


def read_csv_text(
    spark: SparkSession, path: str, null_tokens: Sequence[str] = NULL_TOKENS, multiline: bool = False
) -> DataFrame:
    """All columns as text under their header names; padded tokens become null.

    Undecodable bytes are replaced, not refused.
    """
    raw = (
        spark.read.option("header", True).option("encoding", "UTF-8").option("multiLine", multiline).options(**DIALECT).csv(path)
    )
    return raw.select(
        *[
            F.when(~is_missing(F.col(f"`{c}`"), tuple(null_tokens)), F.col(f"`{c}`")).alias(c)
            for c in raw.columns
        ]
    )


def read_csv_coerced(
    spark: SparkSession, path: str, types: dict[str, str], multiline: bool = False
) -> DataFrame:
    """Text columns with the named ones cast; what does not parse becomes null."""
    raw = spark.read.option("header", True).option("multiLine", multiline).options(**DIALECT).csv(path)
    return raw.select(
        *[
            F.col(f"`{c}`").try_cast(types[c]).alias(c) if c in types else F.col(f"`{c}`")
            for c in raw.columns
        ]
    )


def read_jdbc(
    spark: SparkSession,
    url: str,
    query: str,
    properties: dict[str, str] | None = None,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
    fetch_size: int = 10_000,
) -> DataFrame:
    """Table or query of a database; with a partition column it is read in parallel."""
    reader = (
        spark.read.format("jdbc").option("url", url).option("fetchsize", fetch_size)
    )
    if partition_column and bounds:
        reader = (
            reader.option("dbtable", f"({query}) AS source")
            .option("partitionColumn", partition_column)
            .option("lowerBound", bounds[0])
            .option("upperBound", bounds[1])
            .option("numPartitions", partitions)
        )
    else:
        reader = reader.option("query", query)
    return reader.options(**(properties or {})).load()


def read_mart_document(spark: SparkSession, path: str) -> DataFrame:
    """The nested export document, one row per file.

    One JSON object cannot be split, so a file is parsed by one task; large
    marts are exchanged as JSON lines (:func:`read_mart_rows`).
    """
    return spark.read.schema(MART_DOCUMENT).option("multiLine", True).json(path)


def read_mart_json(spark: SparkSession, path: str, part: str = "consumo_colonia") -> DataFrame:
    """Rows of one array of the nested document."""
    document = read_mart_document(spark, path)
    return document.select(F.explode(part).alias("row")).select("row.*")


def read_mart_rows(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines, one row per line; splittable."""
    return spark.read.schema(schema).json(path)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features as (nombre, geometry): first non-empty name attribute, geometry untouched.

    One document cannot be split, so a file is parsed by one task.
    """
    features = T.StructType(
        [
            T.StructField(
                "features",
                T.ArrayType(
                    T.StructType(
                        [
                            T.StructField("properties", T.MapType(T.StringType(), T.StringType())),
                            T.StructField("geometry", T.StringType()),
                        ]
                    )
                ),
            )
        ]
    )
    rows = (
        spark.read.schema(features)
        .option("multiLine", True)
        .json(path)
        .select(F.explode("features").alias("f"))
    )
    attribute = [F.try_element_at("f.properties", F.lit(n)) for n in POLYGON_NAMES]
    return rows.select(
        first_present(*attribute).alias("nombre"), F.col("f.geometry").alias("geometry")
    )


_TERM = r'(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z0-9-]+)?)'
_LINE = rf"^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+{_TERM}\s*\.\s*(?:#.*)?$"


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """Line-based triples; blank and comment lines are skipped, others must parse."""
    lines = spark.read.text(path).filter(~F.col("value").rlike(r"^\s*(#.*)?$"))
    term = F.regexp_extract("value", _LINE, 3)
    subject = F.regexp_extract("value", _LINE, 1)
    quoted = term.startswith('"')
    body = F.regexp_extract(term, r'^"((?:[^"\\]|\\.)*)"', 1)
    bare = F.when(term.startswith("<"), F.regexp_extract(term, r"^<([^>]*)>$", 1)).otherwise(term)
    parsed = F.when(F.col("value").rlike(_LINE), F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("not a triple: "), F.col("value"))).cast("boolean")
    )
    return lines.filter(parsed).select(
        F.when(subject.startswith("<"), F.regexp_extract(subject, r"^<([^>]*)>$", 1))
        .otherwise(subject)
        .alias("s"),
        F.regexp_extract("value", _LINE, 2).alias("p"),
        F.when(quoted, unescape_literal(body)).otherwise(bare).alias("o"),
        F.when(quoted, "literal").when(term.startswith("_:"), "bnode").otherwise("iri").alias("o_kind"),
        F.nullif(F.regexp_extract(term, r'"\^\^<([^>]*)>$', 1), F.lit("")).alias("datatype"),
        F.nullif(F.regexp_extract(term, r'"@([A-Za-z0-9-]+)$', 1), F.lit("")).alias("lang"),
    )
