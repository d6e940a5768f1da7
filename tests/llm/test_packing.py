import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cubegraph.llm import packing as k
from cubegraph.llm.tokens import WordTokenizer
from tests.llm import cases

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("capacity", [1, 2, 3, 10, 64, 2048])
def test_plans_hold_every_piece_once(capacity):
    r = random.Random(capacity)
    for _ in range(60):
        lengths = [r.choice([r.randint(1, capacity), max(1, capacity // 2), max(1, capacity // 3), capacity]) for _ in range(r.randint(0, 200))]
        held = Counter()
        bins = k.plan(Counter(lengths), capacity)
        for many, inside in bins:
            assert many > 0 and sum(n * c for n, c in inside) <= capacity
            assert sum(c for n, c in inside if 3 * n > capacity) <= 2
            for n, c in inside:
                held[n] += many * c
        assert held == Counter(lengths)


def test_plans_are_tight():
    r = random.Random(1)
    lengths = [r.randint(1, 2048) if r.random() < 0.3 else r.randint(1, 600) for _ in range(5000)]
    assert sum(m for m, _ in k.plan(Counter(lengths), 2048)) <= 1.02 * sum(lengths) / 2048 + 1


def test_ids_are_the_librarys():
    own, whole = WordTokenizer(PATH), Tokenizer.from_file(PATH)
    r = random.Random(4)
    texts = [t or "" for _, t, *_ in cases.ROWS] + ["".join(chr(r.choice([32, 10, *range(33, 0x250)])) for _ in range(80)) for _ in range(500)]
    texts += ["e ́x", "don't 'S I'LL", "ΣΑΣ σ", "a\tb\x0bc\x85d\xa0e　f", "नमस्ते दुनिया", "<|startoftext|>x"]
    for t in texts:
        assert np.frombuffer(own.ids(t), "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("capacity", [16, 2048])
def test_pieces_rebuild_every_document(spark, capacity):
    whole = Tokenizer.from_file(PATH)
    got = [r.asDict() for r in k.pack_documents(cases.clashing(spark), capacity).collect()]
    expect = Counter()
    for doc_id, text, *_ in cases.ROWS:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for n, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            expect[(doc_id, n, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expect
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    assert len(sequences) <= 1.1 * sum(r["length"] for r in got) / capacity + 2


def test_empty_table(spark):
    assert k.pack_documents(cases.none(spark)).collect() == []
