"""Best-fit packing of documents into sequences, with greedy matching of large pieces.

Which bins are best depends only on how many pieces there are of each length, and lengths are
bounded by the capacity. So the plan is made on that histogram (at most ``capacity``
counts, whatever the corpus): pieces above a third of the capacity are matched
greedily, at most two to a bin; smaller ones go, longest first, into the tightest gap left. Equal
bins are planned once with a count. Spark then ranks the pieces of each length and
hands every piece the place of its rank; no bin is ever built in one place.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cubegraph.llm.base import read, register, store, text_of
from cubegraph.llm.tokens import word_tokenizer

CAPACITY = 2048
END_ID = 0


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the token ids of each text and an end id, cut at ``capacity``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(vocabulary)
        end = np.uint32(END_ID).tobytes()
        for b in batches:
            rows, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(b.column(1).to_pylist()):
                ids = memoryview(tokenizer.ids(text) + end)
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append(i)
                    piece.append(k)
                    start.append(at // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(rows, pa.int64())),
                    pa.array(piece, pa.int32()),
                    *(pa.array(x, pa.int64()) for x in (start, length, crc)),
                ],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(
        cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long"
    )


Bins = tuple[int, list[tuple[int, int]]]


def plan(counts: dict[int, int], capacity: int) -> list[Bins]:
    """(how many equal bins, [(length, pieces of it in each bin), ...]) for a histogram of lengths."""
    left = {n: c for n, c in counts.items() if c > 0}
    open_bins: dict[int, list[Bins]] = {}
    large = sorted(n for n in left if 3 * n > capacity)

    def put(gap: int, bins: Bins) -> None:
        open_bins.setdefault(gap, []).append(bins)

    while large:
        a = large[-1]
        at = bisect_left(large, capacity - a + 1) - 1
        b = large[at] if at >= 0 else None
        if b is None:
            put(capacity - a, (left.pop(a), [(a, 1)]))
            large.pop()
            continue
        n = min(left[a], left[b]) if a != b else left[a] // 2
        if n == 0:  # one piece of the length that would pair with itself
            smaller = at - 1
            if smaller >= 0:
                b, n = large[smaller], 1
            else:
                put(capacity - a, (left.pop(a), [(a, 1)]))
                large.pop()
                continue
        put(capacity - a - b, (n, [(a, 1), (b, 1)] if a != b else [(a, 2)]))
        for x in (a, b):
            left[x] -= n
        large = [x for x in large if left.get(x, 0) > 0]
    gaps = sorted(open_bins)
    for size in sorted((n for n in left if 3 * n <= capacity and left[n] > 0), reverse=True):
        n = left[size]
        while n:
            at = bisect_left(gaps, size)
            if at < len(gaps):
                gap = gaps[at]
                bins, inside = open_bins[gap].pop()
                if not open_bins[gap]:
                    del open_bins[gap], gaps[at]
            else:
                gap, inside = capacity, []
                bins = -(-n // (capacity // size))
            each = min(gap // size, n)
            filled = min(bins, n // each)
            for many, pieces in ((filled, each), (1 if filled < bins and n % each else 0, n - filled * each)):
                many = many if pieces else 0
                if many:
                    rest = gap - pieces * size
                    if rest not in open_bins:
                        insort(gaps, rest)
                    put(rest, (many, [*inside, (size, pieces)]))
                    bins -= many
                    n -= many * pieces
            if bins and inside:
                if gap not in open_bins:
                    insort(gaps, gap)
                put(gap, (bins, inside))
    return [b for gap in sorted(open_bins) for b in open_bins[gap]]


def places(bins: list[Bins]) -> dict[int, tuple[np.ndarray, ...]]:
    """length -> (first rank, first sequence, pieces in a bin, offset) of its runs of equal bins."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    first = 0
    for many, inside in bins:
        offset = 0
        for length, pieces in inside:
            at = ranks.get(length, 0)
            runs.setdefault(length, []).append((at, first, pieces, offset))
            ranks[length] = at + many * pieces
            offset += length * pieces
        first += many
    return {n: tuple(np.array(x, np.int64) for x in zip(*r)) for n, r in runs.items()}


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (stored, with doc_id, piece, length, ids_crc32) with sequence_id and offset."""
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    at = places(plan(counts, capacity))
    # Parts of about the square root of the commonest length's count: neither a part nor the list of a length's parts grows with it alone.
    parts = math.ceil(math.sqrt(max(counts.values(), default=1)))
    part = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).alias("part")
    dealt = pieces.select("*", part)
    sizes = dealt.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = store(
        sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "piece-ranks"
    )
    own = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.join(offsets, ["length", "part"]).withColumn(
        "rank", F.col("before") + F.row_number().over(own) - 1
    )

    names = pieces.columns

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rank = b.column(b.schema.get_field_index("rank")).to_numpy(zero_copy_only=False)
            length = b.column(b.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                mine = length == n
                first_rank, first_bin, each, begin = at[int(n)]
                run = np.searchsorted(first_rank, rank[mine], side="right") - 1
                into = rank[mine] - first_rank[run]
                sequence[mine] = first_bin[run] + into // each[run]
                offset[mine] = begin[run] + into % each[run] * n
            kept = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(placed, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row per piece.

    A null or empty text is one piece, its end id. Rows that repeat, or that share or lack a
    doc_id, are packed each on its own. An empty table gives an empty result. Only
    doc_id and text are read, so other columns may have any name.
    """
    return pack_pieces(store(token_pieces(docs, capacity, vocabulary), "pieces"), capacity)


@register()
def op10_best_fit_packing(spark, sf_dir):
    return pack_documents(read(spark, sf_dir, "documents"))
