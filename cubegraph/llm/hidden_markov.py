"""A hidden Markov language model trained by Baum-Welch counts that partitions sum up.

Words are tied into ``CLASSES`` classes by a hash, so emissions per state have a fixed size at any
vocabulary: p(word | state) = p(class | state) * p(word | class). The second factor comes from
the corpus's word counts and leaves room for words not seen; the first and the moves between states are
trained. The probability of a text is the scaled forward recursion over all its tokens.

The corpus is read once into blocks of bounded size: word numbers of a block's texts, and its distinct words.
Words are counted by a shuffle of each block's distinct words, never of all tokens; every round of
training runs over the blocks where they lie and returns (state, class) sums; for scoring,
each block meets the counts of its own words. Nothing that grows with the vocabulary is
broadcast or collected.

In the recursion texts are cut into segments. A segment's product of transition and emission matrices
does not depend on what comes before, so all segments of a block advance together, one token
at a time, and each text's products are then multiplied in order: the same sum over paths.
"""

from __future__ import annotations

import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubegraph.llm.base import fold_of, read, register, store, text_of

STATES, CLASSES, ROUNDS = 4, 4096, 3
FOLDS, HELD_OUT = 7, 2
BLOCK_BYTES = 12 << 20
SEGMENT, LANES = 256, 2048
END = 0  # the number and the class of the end token
SMOOTH = 0.01


# ---- blocks ----------------------------------------------------------------------------------


def word_class(word: bytes) -> int:
    return 1 + zlib.crc32(word) % (CLASSES - 1)


class Block:
    """Texts as numbers of words; numbers count from 1 within the block, 0 is the end token."""

    def __init__(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = lambda: len(self.numbers) + 1
        self.ids, self.held, self.texts, self.size = [], [], [], 0

    def add(self, doc_id: pa.Scalar, held: bool, text: bytes) -> None:
        # bytes.lower and bytes.split know ASCII only: A-Z, and the six breaks of a word
        words = text.lower().split()
        numbers = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
        self.ids.append(doc_id)
        self.held.append(held)
        self.texts.append(np.append(numbers, np.int32(END)))
        self.size += len(text) + 16

    def rows(self, id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
        """One row that holds the texts, then a row for each distinct word."""
        block = uuid.uuid4().int >> 65
        tokens = np.concatenate(self.texts)
        lengths = np.array([len(t) for t in self.texts], np.int32)
        train = np.repeat(~np.array(self.held, bool), lengths)
        seen = np.bincount(tokens[train], minlength=len(self.numbers) + 1)
        words = list(self.numbers)
        classes = np.array([END, *map(word_class, words)], np.uint16)
        body = {
            "block": pa.array([block], pa.int64()),
            "doc_ids": pa.array([self.ids], pa.list_(id_type)),
            "held": pa.array([self.held], pa.list_(pa.bool_())),
            "lengths": pa.array([lengths], pa.list_(pa.int32())),
            "low": pa.array([(tokens & 0xFFFF).astype("<u2").tobytes()], pa.binary()),
            "high": pa.array([(tokens >> 16).astype("<u2").tobytes()], pa.binary()),
            "classes": pa.array([classes.tobytes()], pa.binary()),
        }
        yield filled(body, id_type)
        for k in range(0, len(words), 50_000):
            part = slice(k + 1, min(k + 50_000, len(words)) + 1)
            yield filled(
                {
                    "block": pa.array(np.full(part.stop - part.start, block), pa.int64()),
                    "number": pa.array(np.arange(part.start, part.stop), pa.int32()),
                    "word": pa.array([w.decode() for w in words[k : k + 50_000]], pa.string()),
                    "seen": pa.array(seen[part], pa.int64()),
                },
                id_type,
            )


def schema_of(id_type: pa.DataType) -> pa.Schema:
    return pa.schema(
        [
            ("block", pa.int64()), ("doc_ids", pa.list_(id_type)), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int32())),
            ("low", pa.binary()), ("high", pa.binary()), ("classes", pa.binary()), ("number", pa.int32()), ("word", pa.string()), ("seen", pa.int64()),
        ]
    )


def filled(columns: dict[str, pa.Array], id_type: pa.DataType) -> pa.RecordBatch:
    n, schema = len(columns["block"]), schema_of(id_type)
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)


def blocked(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The stored blocks: rows with ``doc_ids`` hold texts, rows with ``word`` a block's words.

    A block is written whole by one task attempt, so its number may be random.
    """
    held = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    rows = docs.select("doc_id", held.alias("held"), text_of(docs).cast("binary").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, kind = Block(), None
        for b in batches:
            kind = b.column(0).type
            for doc_id, out, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                block.add(doc_id, out, text)
                if block.size >= block_bytes:
                    yield from block.rows(kind)
                    block = Block()
        if block.ids:
            yield from block.rows(kind)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return store(
        rows.mapInArrow(
            cut,
            f"block long, doc_ids array<{kind}>, held array<boolean>, lengths array<int>, low binary, high binary, "
            "classes binary, number int, word string, seen long",
        ),
        "hmm-blocks",
    )


def tokens_of(low: bytes, high: bytes) -> np.ndarray:
    return np.frombuffer(low, "<u2").astype(np.int32) | np.frombuffer(high, "<u2").astype(np.int32) << 16


# ---- the model -------------------------------------------------------------------------------


@dataclass
class Hmm:
    start: np.ndarray  # (states,)
    moves: np.ndarray  # (states, states)
    emits: np.ndarray  # (states, classes)


def first_model(class_counts: np.ndarray, states: int = STATES) -> Hmm:
    """Sticky moves; emissions are the corpus's class shares, bent per state by a fixed noise."""
    noise = np.random.default_rng(7).uniform(0.3, 1.7, (states, CLASSES))
    emits = (class_counts + SMOOTH)[None, :] * noise
    moves = np.full((states, states), 0.1 / max(states - 1, 1)) + np.eye(states) * (0.9 - 0.1 / max(states - 1, 1))
    if states == 1:
        moves = np.ones((1, 1))
    return Hmm(np.full(states, 1 / states), moves / moves.sum(1, keepdims=True), emits / emits.sum(1, keepdims=True))


def segments(tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, begin, size) of each segment of at most ``SEGMENT`` tokens, texts in order."""
    parts = -(-lengths // SEGMENT)
    owner = np.repeat(np.arange(len(lengths)), parts)
    within = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(np.cumsum(lengths) - lengths, parts) + within * SEGMENT
    return owner, begin, np.minimum(SEGMENT, np.repeat(lengths, parts) - within * SEGMENT)


def counts_of(model: Hmm, classes: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected starts, moves and emissions (Baum-Welch) over texts of class numbers; a segment is a sequence here."""
    states = len(model.start)
    starts, moves, emits = np.zeros(states), np.zeros((states, states)), np.zeros((states, CLASSES))
    _, begin, size = segments(classes, lengths)
    order = np.argsort(-size, kind="stable")
    table = np.ascontiguousarray(model.emits.T)
    for k in range(0, len(order), LANES):
        lane = order[k : k + LANES]
        b, n = begin[lane], size[lane]
        steps = int(n[0])
        live = (np.arange(steps)[:, None] < n[None, :]).sum(1)  # lanes are sorted by size, so live ones come first
        alpha, scale = np.zeros((steps, len(lane), states)), np.ones((steps, len(lane)))
        tokens = np.zeros((steps, len(lane)), np.int64)
        for t in range(steps):
            m = live[t]
            tokens[t, :m] = classes[b[:m] + t]
            a = (np.broadcast_to(model.start, (m, states)) if t == 0 else alpha[t - 1, :m] @ model.moves) * table[tokens[t, :m]]
            total = a.sum(1)
            alpha[t, :m], scale[t, :m] = a / total[:, None], total
        beta = np.ones((len(lane), states))
        for t in range(steps - 1, -1, -1):
            m = live[t]
            if t + 1 < steps and live[t + 1]:
                q = live[t + 1]
                back = beta[:q] * table[tokens[t + 1, :q]] / scale[t + 1, :q, None]
                moves += alpha[t, :q].T @ back
                beta[:q] = back @ model.moves.T
            alpha[t, :m] *= beta[:m]  # now the share of each state
        starts += alpha[0].sum(0)
        inside = np.arange(steps)[:, None] < n[None, :]
        flat = tokens[inside]
        for s in range(states):
            emits[s] += np.bincount(flat, alpha[:, :, s][inside], CLASSES)
    return starts, moves * model.moves, emits


def log_likelihood(model: Hmm, classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 of the probability of each text's classes, over all state paths."""
    states = len(model.start)
    owner, begin, size = segments(classes, lengths)
    order = np.argsort(-size, kind="stable")
    table = np.ascontiguousarray(model.emits.T)
    head = np.cumsum(lengths) - lengths
    product, logs = np.zeros((len(owner), states, states)), np.zeros(len(owner))
    for k in range(0, len(order), LANES):
        lane = order[k : k + LANES]
        b, n = begin[lane], size[lane]
        live = (np.arange(int(n[0]))[:, None] < n[None, :]).sum(1)
        # a text begins with ``start``, whatever the state before; other segments move on from each state
        opening = begin[lane] == head[owner[lane]]
        p, log = np.where(opening[:, None, None], model.start[None, None, :], model.moves[None]), np.zeros(len(lane))
        for t, m in enumerate(live):
            step = p[:m] if t == 0 else (p[:m].reshape(-1, states) @ model.moves).reshape(m, states, states)
            step = step * table[classes[b[:m] + t]][:, None, :]
            total = step.sum((1, 2))
            p[:m] = step / total[:, None, None]
            log[:m] += np.log10(total)
        product[lane], logs[lane] = p, log
    out = np.zeros(len(lengths))
    alpha = np.tile(np.eye(states)[0], (len(lengths), 1))
    parts = -(-lengths // SEGMENT)
    at = np.cumsum(parts) - parts
    for i in range(int(parts.max()) if len(parts) else 0):
        some = np.flatnonzero(parts > i)
        alpha[some] = np.einsum("ni,nij->nj", alpha[some], product[at[some] + i])
        total = alpha[some].sum(1)
        alpha[some] /= total[:, None]
        out[some] += np.log10(total) + logs[at[some] + i]
    return out


def trained(blocks: DataFrame, class_counts: np.ndarray, rounds: int = ROUNDS, states: int = STATES) -> Hmm:
    """Baum-Welch over the training texts of all blocks; each round brings (states x classes) sums to the driver."""
    model = first_model(class_counts, states)
    texts = blocks.filter("doc_ids IS NOT NULL").select("held", "lengths", "low", "high", "classes")
    width = states + states * states + states * CLASSES
    for _ in range(rounds):
        current = model

        def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(width)
            for b in batches:
                for i in range(b.num_rows):
                    held, lengths, low, high, classes = (b.column(c)[i].as_py() for c in range(5))
                    lengths, train = np.array(lengths, np.int64), ~np.array(held, bool)
                    tokens = np.frombuffer(classes, np.uint16)[tokens_of(low, high)][np.repeat(train, lengths)]
                    sums += np.concatenate([x.reshape(-1) for x in counts_of(current, tokens, lengths[train])])
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(sums[at])], names=["at", "value"])

        rows = texts.mapInArrow(expected, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
        sums = np.zeros(width)
        for r in rows:
            sums[r["at"]] = r["value"]
        starts, moves, emits = np.split(sums, [states, states + states * states])
        emits = emits.reshape(states, CLASSES) + SMOOTH
        moves = moves.reshape(states, states) + SMOOTH
        starts = starts + SMOOTH
        model = Hmm(starts / starts.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(1, keepdims=True))
    return model


# ---- scores ----------------------------------------------------------------------------------


def scored(docs: DataFrame, rounds: int = ROUNDS, states: int = STATES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row per row of ``docs``.

    A null text counts as empty: its only token is the end. A null doc_id is never held out. Repeated rows train and
    are scored each on its own. Without training texts every count is 0 and the base score 0. An empty table gives an
    empty result. Only doc_id and text are read.
    """
    blocks = blocked(docs, block_bytes)
    # A word has a row per block. The rows of a frequent one shrink in the map tasks to its sum, which is then joined back.
    words = blocks.filter("word IS NOT NULL").select("block", "number", "word", "seen")
    totals = store(words.groupBy("word").agg(F.sum("seen").alias("c")), "hmm-words")
    counted = store(words.join(totals, "word").select("block", "number", "c"), "hmm-counts")
    by_class = totals.filter("c > 0").groupBy((F.crc32(F.col("word").cast("binary")) % (CLASSES - 1) + 1).cast("int").alias("class")).agg(
        F.sum("c").alias("n"), F.count("*").alias("v")
    ).collect()
    ends = blocks.filter("doc_ids IS NOT NULL").select(
        F.sum(F.size(F.filter("held", lambda h: ~h))).alias("n")
    ).first()["n"] or 0
    class_n, class_v = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
    for r in by_class:
        class_n[r["class"]], class_v[r["class"]] = r["n"], r["v"]
    class_n[END], class_v[END] = ends, int(ends > 0)
    n, v = int(class_n.sum()), int(class_v.sum())
    model = trained(blocks, class_n.astype(float), rounds, states)

    def score(texts: pa.Table, counts: pa.Table) -> pa.Table:
        out = []
        for i in range(texts.num_rows):
            held, lengths = (texts.column(c)[i].as_py() for c in ("held", "lengths"))
            classes = np.frombuffer(texts.column("classes")[i].as_py(), np.uint16)
            tokens = tokens_of(texts.column("low")[i].as_py(), texts.column("high")[i].as_py())
            lengths = np.array(lengths, np.int64)
            c = np.zeros(len(classes), np.int64)
            c[END] = ends
            c[counts.column("number").to_numpy()] = counts.column("c").to_numpy()
            base = np.log10((c + 1) / (n + v + 1))
            in_class = np.log10((c + 1) / (class_n[classes] + class_v[classes] + 1))
            in_class[END] = 0.0
            at = np.cumsum(lengths) - lengths
            total = lambda values: np.add.reduceat(values[tokens], at)
            out.append(
                pa.Table.from_arrays(
                    [
                        texts.column("doc_ids")[i].values,
                        pa.array(held, pa.bool_()), pa.array(lengths), pa.array(total((c > 0).astype(np.int64))),
                        pa.array(np.full(len(lengths), n, np.int64)), pa.array(total(base)),
                        pa.array(log_likelihood(model, classes[tokens], lengths) + total(in_class)),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
            )
        return pa.concat_tables(out)

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = blocks.filter("doc_ids IS NOT NULL").select("block", "doc_ids", "held", "lengths", "low", "high", "classes")
    return (
        texts.groupBy("block")
        .cogroup(counted.select("block", "number", "c").groupBy("block"))
        .applyInArrow(
            score,
            f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double",
        )
    )


@register()
def op4_hidden_markov(spark, sf_dir):
    return scored(read(spark, sf_dir, "documents"))
