"""Alignment of two tokenizers' tokens by interval coalescing.

Both token sequences of a text tile its bytes. All tokens are sorted by start, the running maximum of their ends is
taken, and a group ends where the next start reaches it; within the groups every pair of
overlapping tokens is a link. Links are counted over the corpus by id pair.

Counting moves no tokens. A task cuts its documents into blocks; a block has one dictionary of the id pairs that
occur in it, and a document names its pairs by their places there. Only dictionaries are summed over the
corpus and joined with the sums; the answers return to their block, where the documents add them up.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cubegraph.llm.base import read, register, store, text_of

A_FILE, A_RANKS, B_FILE = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: A block ends after so many distinct links of its documents, or so many documents.
BLOCK_LINKS, BLOCK_ROWS = 4_000_000, 20_000
#: Characters of text aligned in one sweep; a longer text is swept on its own.
SWEEP = 1 << 20
#: For letters beyond these the two encoders of A may follow different editions of the character classes.
PLAIN = re.compile(r"[\x00-ɏ]*")


@dataclass(frozen=True)
class Vocabulary:
    """Bytes of every id, their number, and the id as text before each separator."""

    pieces: np.ndarray
    lengths: np.ndarray
    inside: np.ndarray
    last: np.ndarray

    @classmethod
    def of(cls, pieces: list[bytes], last: str) -> Vocabulary:
        def column(values) -> np.ndarray:
            out = np.empty(len(pieces), object)
            out[:] = list(values)
            return out

        lengths = np.array([len(p) for p in pieces], np.int64)
        ids = range(len(pieces))
        return cls(column(pieces), lengths, column(f"{i}," for i in ids), column(f"{i}{last}" for i in ids))


def byte_of_letters() -> dict[str, int]:
    """The letters of a byte-level vocabulary -> the bytes they stand for."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return {chr(b) if b in plain else chr(next(spare)): b for b in range(256)}


def piece_bytes(piece: str) -> bytes:
    """UTF-8 of a piece, its mark read as a space; a byte piece is its byte."""
    byte = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
    return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()


class Encoders:
    """Tokenizer A in its two libraries (the faster one for plain letters) and tokenizer B."""

    def __init__(self, a_file: str | None = None, a_ranks: str | None = None, b_file: str | None = None):
        self.whole = Tokenizer.from_file(a_file or public_tokenizers.path(A_FILE))
        self.whole.encode_special_tokens = True
        with open(a_ranks or public_tokenizers.path(A_RANKS), "rb") as lines:
            ranks = {base64.b64decode(t): int(i) for t, i in map(bytes.split, lines)}
        self.plain = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.other = sentencepiece.SentencePieceProcessor(model_file=b_file or public_tokenizers.path(B_FILE))
        byte_of = byte_of_letters()
        a = [b""] * self.whole.get_vocab_size()
        for token, i in self.whole.get_vocab().items():
            a[i] = bytes(byte_of[c] for c in token)
        self.a = Vocabulary.of(a, "|")
        self.b = Vocabulary.of([piece_bytes(self.other.id_to_piece(i)) for i in range(self.other.get_piece_size())], ";")

    def a_ids(self, text: str) -> list[int]:
        """Ids of A of a space and the text; both libraries give the same ones."""
        if PLAIN.fullmatch(text):
            return self.plain.encode_ordinary(" " + text)
        return self.whole.encode(" " + text, add_special_tokens=False).ids

    def ids(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and of B; none where either sequence does not spell a space and the text."""
        if text:
            spelt = (" " + text).encode()
            a = np.array(self.a_ids(text), np.int64)
            b = np.array(self.other.encode(text, num_threads=1), np.int64)
            if b"".join(self.a.pieces[a].tolist()) == spelt == b"".join(self.b.pieces[b].tolist()):
                return a, b
        return np.zeros(0, np.int64), np.zeros(0, np.int64)


def coalesced(start: np.ndarray, end: np.ndarray, other_start: np.ndarray, other_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Group number of every interval of either side; a group ends where a start reaches the running maximum of ends."""
    starts, ends = np.concatenate([start, other_start]), np.concatenate([end, other_end])
    order = np.lexsort((starts,))
    reach = np.maximum.accumulate(ends[order])
    fresh = np.ones(len(order), bool)
    fresh[1:] = starts[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    return group[: len(start)], group[len(start) :]


def overlaps(start: np.ndarray, end: np.ndarray, other_start: np.ndarray, other_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (own, other) of all overlapping pairs of two tilings."""
    first = np.searchsorted(other_end, start, side="right")
    many = np.searchsorted(other_start, end, side="left") - first
    own = np.repeat(np.arange(len(start)), many)
    within = np.arange(len(own)) - np.repeat(np.cumsum(many) - many, many)
    return own, np.repeat(first, many) + within


@dataclass(frozen=True)
class Aligned:
    """The documents of one sweep: tokens, groups and links of each, and its groups as text."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    groups: list[str]
    link_doc: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def align(texts: list[str], encoders: Encoders) -> Aligned:
    """All texts in one sweep, laid end to end: both sides end with a text, so no group crosses into the next."""
    found = [encoders.ids(t) for t in texts]
    n_a, n_b = (np.array([len(f[side]) for f in found], np.int64) for side in (0, 1))
    a, b = (np.concatenate([f[side] for f in found] or [np.zeros(0, np.int64)]) for side in (0, 1))
    a_end, b_end = np.cumsum(encoders.a.lengths[a]), np.cumsum(encoders.b.lengths[b])
    a_start, b_start = a_end - encoders.a.lengths[a], b_end - encoders.b.lengths[b]
    a_group, b_group = coalesced(a_start, a_end, b_start, b_end)
    own, other = overlaps(a_start, a_end, b_start, b_end)
    doc_of = np.repeat(np.arange(len(texts)), n_a)
    total = int(a_group[-1]) + 1 if len(a_group) else 0
    first_a, first_b = np.searchsorted(a_group, np.arange(total + 1)), np.searchsorted(b_group, np.arange(total + 1))
    # A group is written as its A ids, then its B ids: every token's place is its own plus the other side's before it.
    parts = np.empty(len(a) + len(b), object)
    a_last, b_last = np.append(a_group[1:] != a_group[:-1], True)[: len(a)], np.append(b_group[1:] != b_group[:-1], True)[: len(b)]
    parts[np.arange(len(a)) + first_b[a_group]] = np.where(a_last, encoders.a.last[a], encoders.a.inside[a])
    parts[np.arange(len(b)) + first_a[b_group + 1]] = np.where(b_last, encoders.b.last[b], encoders.b.inside[b])
    ends = np.cumsum(n_a + n_b)
    written = ["".join(parts[e - n : e].tolist())[:-1] for e, n in zip(ends.tolist(), (n_a + n_b).tolist())]
    group_doc = doc_of[first_a[:-1]] if total else np.zeros(0, np.int64)
    n_groups = np.bincount(group_doc, minlength=len(texts)).astype(np.int64)
    return Aligned(n_a, n_b, n_groups, written, doc_of[own], a[own], b[other])


def sweeps(texts: list[str]) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts of about ``SWEEP`` characters."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= SWEEP:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def varints(values: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Non-negative numbers in bytes of seven bits each, low ones first; and the offsets at which each number begins."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1 << 7 * k)
    begin = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        here = size > k
        more = np.where(size[here] > k + 1, 0x80, 0).astype(np.uint8)
        out[begin[here] + k] = ((values[here] >> np.uint64(7 * k)) & np.uint64(0x7F)).astype(np.uint8) | more
    return out.tobytes(), np.append(begin, len(out))


def from_varints(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    last = np.flatnonzero(raw < 0x80)
    begin = np.append(0, last[:-1] + 1) if len(last) else last
    place = np.arange(len(raw)) - np.repeat(begin, last - begin + 1)
    return np.add.reduceat((raw & 0x7F).astype(np.int64) << 7 * place, begin) if len(last) else np.zeros(0, np.int64)


class Block:
    """Documents whose links share one dictionary of id pairs."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.doc: list[np.ndarray] = []
        self.pair: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: list, found: Aligned, pair: np.ndarray, span: int) -> None:
        key, times = np.unique(found.link_doc * span + pair, return_counts=True)
        self.doc.append(key // span + len(self.rows))
        self.pair.append(key % span)
        self.times.append(times)
        self.size += len(key)
        links = np.bincount(found.link_doc, minlength=len(ids))
        for row in zip(ids, found.n_a.tolist(), found.n_b.tolist(), found.n_groups.tolist(), links.tolist(), found.groups):
            self.rows.append((*row[:5], hashlib.sha256(row[5].encode()).hexdigest() if row[1] else ""))

    @property
    def full(self) -> bool:
        return self.size >= BLOCK_LINKS or len(self.rows) >= BLOCK_ROWS

    def batch(self, number: int, schema: pa.Schema) -> pa.RecordBatch:
        """A row per document and one, without a document, for the dictionary."""
        doc, pair, times = (np.concatenate(x or [np.zeros(0, np.int64)]) for x in (self.doc, self.pair, self.times))
        pairs, place = np.unique(pair, return_inverse=True)
        total = np.bincount(place, times, len(pairs)).astype(np.int64)
        bounds = np.searchsorted(doc, np.arange(len(self.rows) + 1))
        step = np.diff(place, prepend=0)
        inner = bounds[:-1][bounds[:-1] < bounds[1:]]
        step[inner] = place[inner]
        (steps, at), (counts, of) = varints(step), varints(times)
        columns = list(zip(*self.rows))
        names = schema.names
        data = {"block": [number] * (len(self.rows) + 1)}
        for n, values in zip(names[1:7], columns):
            data[n] = [*values, None]
        data["places"] = [*(steps[at[i] : at[j]] for i, j in zip(bounds, bounds[1:])), None]
        data["times"] = [*(counts[of[i] : of[j]] for i, j in zip(bounds, bounds[1:])), None]
        data["pairs"] = [*[None] * len(self.rows), varints(np.diff(pairs, prepend=0))[0]]
        data["totals"] = [*[None] * len(self.rows), varints(total)[0]]
        return pa.RecordBatch.from_arrays([pa.array(data[f.name], f.type) for f in schema], schema=schema)


def arrow_type(docs: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema["doc_id"].dataType)


DOC_COLUMNS = ("n_a", "n_b", "n_groups", "n_links")


def blocks(docs: DataFrame, files: tuple[str | None, ...] = (None, None, None)) -> DataFrame:
    """A row per document (digest of its groups, places and times of its pairs) and per block (its pairs and their totals)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = pa.schema(
        [("block", pa.int64()), ("doc_id", arrow_type(docs)), *((n, pa.int64()) for n in DOC_COLUMNS), ("groups_sha256", pa.string())]
        + [(n, pa.binary()) for n in ("places", "times", "pairs", "totals")]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = Encoders(*files)
        width = len(encoders.b.pieces)
        number, block = TaskContext.get().partitionId() << 32, Block()
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for first, end in sweeps(texts):
                found = align(texts[first:end], encoders)
                block.add(ids[first:end], found, found.link_a * width + found.link_b, width * len(encoders.a.pieces))
                if block.full:
                    yield block.batch(number, schema)
                    number, block = number + 1, Block()
        if block.rows:
            yield block.batch(number, schema)

    fields = f"block long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(
        cut, f"{fields}, places binary, times binary, pairs binary, totals binary"
    )


def dictionaries(cut: DataFrame) -> DataFrame:
    """block, pair, n: the links of a pair in a block."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, pairs, totals in zip(*(c.to_pylist() for c in b.columns)):
                pair = np.cumsum(from_varints(pairs))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(pair), block, np.int64)), pa.array(pair), pa.array(from_varints(totals))],
                    names=["block", "pair", "n"],
                )

    rows = cut.filter(F.col("pairs").isNotNull()).select("block", "pairs", "totals")
    return rows.mapInArrow(spread, "block long, pair long, n long")


def pair_counts(inside: DataFrame, width: int) -> DataFrame:
    """pair, count, best: links of an id pair in the corpus, and whether no other pair of its B id has more."""
    counts = store(inside.groupBy("pair").agg(F.sum("n").alias("count")), "link-counts")
    highest = counts.groupBy((F.col("pair") % width).alias("b")).agg(F.max("count").alias("highest"))
    return counts.join(highest, F.col("pair") % width == F.col("b")).select(
        "pair", "count", (F.col("count") == F.col("highest")).alias("best")
    )


def aligned(docs: DataFrame, files: tuple[str | None, ...] = (None, None, None)) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: a row per row of ``docs``.

    A null or empty text, and one that either tokenizer does not spell byte for byte, has no tokens: zeros and an
    empty digest. Rows that repeat, or that share or lack a doc_id, are aligned and counted each on its own. An
    empty table gives an empty result. Only doc_id and text are read, so other columns may have any
    name. ``files`` are the vocabulary files of A (both forms) and B.
    """
    width = sentencepiece.SentencePieceProcessor(model_file=files[2] or public_tokenizers.path(B_FILE)).get_piece_size()
    cut = store(blocks(docs, files), "token-links")
    inside = dictionaries(cut)
    answers = inside.select("block", "pair").join(pair_counts(inside, width), "pair").select("block", "pair", "count", "best")
    schema = pa.schema(
        [("doc_id", arrow_type(docs)), *((n, pa.int64()) for n in (*DOC_COLUMNS, "n_best", "count_sum")), ("groups_sha256", pa.string())]
    )

    def summed(documents: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("pair")
        count = answers["count"].to_numpy()
        best = answers["best"].to_numpy(zero_copy_only=False)
        n_best, count_sum = [], []
        for places, times in zip(documents["places"].to_pylist(), documents["times"].to_pylist()):
            at, n = np.cumsum(from_varints(places)), from_varints(times)
            n_best.append(int(n[best[at]].sum()))
            count_sum.append(int((n * count[at]).sum()))
        whole = documents.select([f.name for f in schema if f.name not in ("n_best", "count_sum")])
        whole = whole.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))
        return whole.select(schema.names).cast(schema)

    kept = cut.filter(F.col("pairs").isNull()).drop("pairs", "totals")
    kind = docs.schema["doc_id"].dataType.simpleString()
    longs = ", ".join(f"{n} long" for n in (*DOC_COLUMNS, "n_best", "count_sum"))
    return kept.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        summed, f"doc_id {kind}, {longs}, groups_sha256 string"
    )


def token_groups(docs: DataFrame, files: tuple[str | None, ...] = (None, None, None)) -> DataFrame:
    """doc_id and ``groups``, the aligned groups of the text as ``a1,a2|b1;a3|b2,b3``; empty without tokens."""

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = Encoders(*files)
        for b in batches:
            texts = b.column(1).to_pylist()
            groups = [g for first, end in sweeps(texts) for g in align(texts[first:end], encoders).groups]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(groups, pa.string())], names=["doc_id", "groups"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(written, f"doc_id {kind}, groups string")


@register()
def op13_token_alignment(spark, sf_dir):
    return aligned(read(spark, sf_dir, "documents"))
