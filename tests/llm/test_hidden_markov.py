import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from cubegraph.llm import hidden_markov as h
from tests.llm import cases


def some_model(states, classes):
    r = np.random.default_rng(1)
    emits = np.full((states, h.CLASSES), 1e-9)
    emits[:, :classes] = r.dirichlet(np.ones(classes), states)
    return h.Hmm(r.dirichlet(np.ones(states)), r.dirichlet(np.ones(states), states), emits)


def test_forward_sums_all_paths():
    m = some_model(3, 4)
    text = np.array([0, 3, 1, 2])
    total = sum(
        m.start[p[0]] * m.emits[p[0], text[0]] * math.prod(m.moves[a, b] * m.emits[b, c] for a, b, c in zip(p, p[1:], text[1:]))
        for p in itertools.product(range(3), repeat=4)
    )
    assert h.log_likelihood(m, text, np.array([4]))[0] == pytest.approx(math.log10(total))


def test_segments_do_not_change_the_likelihood(monkeypatch):
    m = some_model(3, 20)
    text = np.random.default_rng(2).integers(0, 20, 1400)
    sizes = np.array([1, 600, 3, 796])
    whole = h.log_likelihood(m, text, sizes)
    monkeypatch.setattr(h, "SEGMENT", 7)
    assert h.log_likelihood(m, text, sizes) == pytest.approx(whole)


def test_baum_welch_raises_the_likelihood():
    text = np.random.default_rng(3).integers(0, 30, 2000)
    sizes, last = np.full(40, 50), -math.inf
    m = h.first_model(np.bincount(text, minlength=h.CLASSES).astype(float), 3)
    for _ in range(4):
        now = h.log_likelihood(m, text, sizes).sum()
        assert now > last
        last = now
        starts, moves, emits = h.counts_of(m, text, sizes)
        assert starts.sum() == pytest.approx(40) and moves.sum() == pytest.approx(1960) and emits.sum() == pytest.approx(2000)
        m = h.Hmm(starts / starts.sum(), moves / moves.sum(1, keepdims=True), emits / emits.sum(1, keepdims=True))


def base(rows):
    words = lambda t: (t or "").encode().lower().split()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    train = Counter()
    for i, t, *_ in rows:
        if not held(i):
            train.update([*words(t), None])
    n, v = sum(train.values()), len(train)
    out = []
    for i, t, *_ in rows:
        tokens = [*words(t), None]
        out.append((i, held(i), len(tokens), sum(train[x] > 0 for x in tokens), n, round(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in tokens), 4)))
    return sorted(out, key=repr)


def test_scores(spark):
    got = h.scored(cases.clashing(spark), rounds=1, block_bytes=5000).collect()
    assert sorted(((*r[:5], round(r[5], 4)) for r in got), key=repr) == base(cases.ROWS)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert h.scored(cases.none(spark)).collect() == []


def test_states_help_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rate = {}
    for states in (1, 4):
        rows = h.scored(docs, states=states).filter("held_out").collect()
        rate[states] = sum(r["score"] for r in rows) / sum(r["n_tokens"] for r in rows)
    assert rate[4] > rate[1]
