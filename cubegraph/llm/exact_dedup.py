"""Exact duplicates by composable polynomial fingerprints, confirmed chunk by chunk.

The fingerprint of a text is the polynomial ``sum(byte[j] * B**j)`` over its UTF-8
bytes modulo two primes. A text is cut into chunks that are hashed independently;
the hash of the chunk that starts at byte ``s`` is shifted by ``B**s``, after which
chunks combine by addition, in any order and on any machine. So a huge text costs
one sum over its chunks, and no task has to hold more than one chunk's products.

Equal fingerprints only nominate. The texts of a group are then compared with its
representative chunk by chunk; texts that differ form the next round's groups, until none is left.
A group is split by a salt, so its size bounds no task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubegraph.llm.base import bounded, join_on, keyed, read, register, store, superseded

CHUNK_BYTES = 1 << 18
MODULI = (2147483647, 2147483629)
BASE = 1000003
SALT_ROWS = 256


def powers(base: int, modulus: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo ``modulus`` (below 2**31), by doubling."""
    out = np.ones(1, np.uint64)
    while len(out) < n:
        step = np.uint64(pow(base, len(out), modulus))
        out = np.concatenate([out, out * step % np.uint64(modulus)])
    return out[:n]


def chunk_hashes(
    chunks: pa.BinaryArray, numbers: np.ndarray, size: int, moduli: tuple[int, ...]
) -> list[np.ndarray]:
    """Hash of each chunk, shifted to the place of its number, modulo each prime."""
    offsets = np.frombuffer(chunks.buffers()[1], np.int32)[chunks.offset : chunks.offset + len(chunks) + 1]
    data = chunks.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    longest = int(np.diff(offsets).max()) if len(chunks) else 0
    weights = [powers(BASE, m, longest) for m in moduli]
    out = [np.zeros(len(chunks), np.int64) for _ in moduli]
    for i, (a, b, number) in enumerate(zip(offsets[:-1], offsets[1:], numbers)):
        piece = data[a:b].astype(np.uint64) + np.uint64(1)
        for h, w, m in zip(out, weights, moduli):
            value = int((piece * w[: b - a]).sum()) % m
            h[i] = value * pow(BASE, int(number) * size, m) % m if number else value
    return out


def chunked(df: DataFrame, size: int) -> DataFrame:
    """A row per chunk: the columns without ``text``, the chunk's number and bytes."""
    rest = [c for c in df.columns if c != "text"]
    data = df.select(*rest, F.col("text").cast("binary").alias("data"))
    last = F.greatest(F.ceil(F.octet_length("data") / size).cast("int"), F.lit(1)) - 1
    numbers = data.select(*rest, "data", F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
    cut = F.substring(F.col("data"), F.col("chunk_no") * size + 1, F.lit(size))
    return numbers.select(*rest, "chunk_no", cut.alias("chunk"))


def fingerprints(
    docs: DataFrame, size: int = CHUNK_BYTES, moduli: tuple[int, int] = MODULI
) -> DataFrame:
    """doc_id, sha, n_bytes, h1, h2, n_rows: one row for each distinct (doc_id, text)."""
    k = keyed(docs)
    chunks = chunked(k.withColumn("n_bytes", F.octet_length("text").cast("long")), size)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            numbers = col["chunk_no"].to_numpy(zero_copy_only=False)
            h1, h2 = chunk_hashes(col["chunk"], numbers, size, moduli)
            yield pa.RecordBatch.from_arrays(
                [col["doc_id"], col["sha"], col["n_bytes"], pa.array(numbers == 0).cast(pa.int64()), pa.array(h1), pa.array(h2)],
                names=["doc_id", "sha", "n_bytes", "first", "h1", "h2"],
            )

    ids = k.schema["doc_id"].dataType.simpleString()
    parts = chunks.mapInArrow(
        hashed, f"doc_id {ids}, sha string, n_bytes long, first long, h1 long, h2 long"
    )
    n = F.sum("first")
    # Repeated rows add the same unreduced sums once more each, so the division is exact.
    return parts.groupBy("doc_id", "sha", "n_bytes").agg(
        n.alias("n_rows"),
        F.expr("sum(h1) div sum(first)").alias("s1"),
        F.expr("sum(h2) div sum(first)").alias("s2"),
    ).select(
        "doc_id", "sha", "n_bytes", (F.col("s1") % moduli[0]).alias("h1"), (F.col("s2") % moduli[1]).alias("h2"), "n_rows"
    )


GROUP = ["h1", "h2", "n_bytes"]


def nominated(prints: DataFrame) -> DataFrame:
    """Rows whose fingerprint others share, with the representative: the largest (doc_id, sha)."""
    groups = (
        prints.groupBy(*GROUP)
        .agg(F.max(F.struct("doc_id", "sha")).alias("rep"), F.count("*").alias("members"))
        .filter("members > 1")
    )
    groups = store(groups.select(*GROUP, "members", F.col("rep.doc_id").alias("rep_id"), F.col("rep.sha").alias("rep_sha")), "fingerprint-groups")
    return store(prints.join(groups, GROUP), "fingerprint-members")


def compared(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """The stored doc_id, sha and whether every chunk equals the representative's."""
    k = keyed(docs)
    wanted = members.select("doc_id", "sha", *GROUP, "members", "rep_id", "rep_sha")
    # Few members find their texts without an exchange of all others. Read for members and for representatives.
    rows = store(join_on(k, bounded(wanted), ["doc_id", "sha"]), "member-texts")
    is_rep = F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("sha") == F.col("rep_sha"))
    salts = F.ceil(F.col("members") / SALT_ROWS).cast("int")
    mine = chunked(
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "sha"), salts).cast("int")), size
    )
    theirs = chunked(rows.filter(is_rep).dropDuplicates(["doc_id", "sha"]), size)
    theirs = theirs.select(
        *GROUP, "chunk_no", F.col("chunk").alias("rep_chunk"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")
    )
    pairs = mine.join(theirs, [*GROUP, "chunk_no", "salt"])
    equal = pairs.groupBy("doc_id", "sha").agg(F.bool_and(F.col("chunk") == F.col("rep_chunk")).alias("equal"))
    return superseded(store(equal, "compared"), rows)


def duplicate_classes(
    docs: DataFrame, prints: DataFrame, size: int = CHUNK_BYTES
) -> DataFrame:
    """doc_id, sha, rep_id, rep_sha, n_rows of every row whose text another (doc_id, text) repeats."""
    found, todo = None, prints
    while True:
        members = nominated(todo)
        if found is not None and members.isEmpty():
            return found
        verdict = compared(docs, members, size)
        judged = join_on(members, verdict, ["doc_id", "sha"])
        classes = judged.filter("equal").select("doc_id", "sha", "rep_id", "rep_sha", "n_rows")
        found = classes if found is None else found.unionByName(classes)
        differing = judged.filter(~F.col("equal"))
        if differing.isEmpty():
            return found
        todo = store(differing.select(*prints.columns), "differing")


def exact_duplicates(
    docs: DataFrame, size: int = CHUNK_BYTES, moduli: tuple[int, int] = MODULI
) -> DataFrame:
    """Each row's group of equal texts: doc_id, keep_id, group_size, kept, text_sha256.

    The row with the largest doc_id stays; a null id is smaller than any other. Of
    rows repeated with id and text, one stays and each is counted. A null text equals the empty text. An empty
    table gives an empty result; other columns of ``docs`` are not read.
    """
    prints = store(fingerprints(docs, size, moduli), "fingerprints")
    classes = store(duplicate_classes(docs, prints, size), "duplicates")
    sizes = store(
        classes.groupBy("rep_id", "rep_sha").agg(F.sum("n_rows").alias("group_size")), "duplicate-sizes"
    )
    grouped = join_on(classes.drop("n_rows"), sizes, ["rep_id", "rep_sha"])
    joined = join_on(prints, grouped.withColumn("grouped", F.lit(True)), ["doc_id", "sha"], "left")
    alone = F.col("grouped").isNull()
    is_rep = alone | (F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("sha") == F.col("rep_sha")))
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("rep_id")).alias("keep_id"),
        F.when(alone, F.col("n_rows")).otherwise(F.col("group_size")).cast("long").alias("group_size"),
        is_rep.alias("is_rep"),
        F.col("sha").alias("text_sha256"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))).alias("copy_no"),
    ).select("doc_id", "keep_id", "group_size", (F.col("is_rep") & (F.col("copy_no") == 1)).alias("kept"), "text_sha256")


def without_duplicates(
    docs: DataFrame, size: int = CHUNK_BYTES, moduli: tuple[int, int] = MODULI
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever these are called.

    Of rows that repeat id and text but differ in other columns, any one stays.
    """
    prints = store(fingerprints(docs, size, moduli), "fingerprints")
    classes = duplicate_classes(docs, prints, size)
    dropped = store(
        classes.filter(~(F.col("doc_id").eqNullSafe(F.col("rep_id")) & (F.col("sha") == F.col("rep_sha"))))
        .select(F.col("doc_id").alias("__id"), F.col("sha").alias("__sha")),
        "dropped",
    )
    repeated = store(
        prints.filter("n_rows > 1").select(F.col("doc_id").alias("__id"), F.col("sha").alias("__sha")), "repeated"
    )
    cols = docs.columns
    rows = docs.withColumn("__key", F.sha2(F.coalesce(docs["text"], F.lit("")), 256))
    dropped, repeated = bounded(dropped), bounded(repeated)
    match = lambda other: rows["doc_id"].eqNullSafe(other["__id"]) & (rows["__key"] == other["__sha"])
    stay = rows.join(dropped, match(dropped), "left_anti")
    if repeated.isEmpty():
        return stay.select(*cols)
    once = stay.join(repeated, match(repeated), "left_anti")
    many = stay.join(repeated, match(repeated), "left_semi").dropDuplicates(["doc_id", "__key"])
    return once.unionByName(many).select(*cols)


@register(
    """
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, t, MAX(doc_id) OVER (PARTITION BY t) AS keep_id, COUNT(*) OVER (PARTITION BY t) AS group_size
  FROM (SELECT doc_id, COALESCE(text, '') AS t FROM documents))"""
)
def op1_exact_dedup(spark, sf_dir):
    return exact_duplicates(read(spark, sf_dir, "documents"))
