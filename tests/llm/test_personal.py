import hashlib
import random
import re

from cubegraph.llm import personal as p
from tests.llm import cases

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and p.luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return p.in_order(out)


def test_base_spans_are_the_patterns():
    r = random.Random(3)
    for _ in range(5000):
        text = "".join(r.choice("01245 9.-+()@ab%\né") for _ in range(r.randint(0, 60)))
        assert p.base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    for run in ("1" * 200_000, "a" * 200_000 + "@", "+1" + " " * 200_000, "1.1" * 60_000, "@" * 100_000):
        p.base_spans(run)


def test_field_finds_unseen_sentences_and_leaves_decoys():
    field = p.train(p.labelled_table())
    table = p.labelled_table(300, seed=99)
    found = p.added_spans(field, [t for t, _ in table], [[] for _ in table])
    truth = {(i, s) for i, (_, spans) in enumerate(table) for s in spans}
    got = {(i, s) for i, spans in enumerate(found) for s in spans}
    assert len(truth & got) > 0.95 * len(truth) and len(got - truth) < 0.05 * len(truth)


def test_viterbi_is_the_best_path():
    field = p.train(p.labelled_table(60), epochs=5)
    import itertools

    for text in ("call 555-1 now", "a (at) b"):
        for s in p.sequences(text):
            import numpy as np

            e = field.emissions(p.features(s), np.array(s.fixed))
            best = max(
                itertools.product(range(len(p.LABELS)), repeat=len(s.tokens)) if len(s.tokens) <= 5 else [tuple(field.decode([s])[0])],
                key=lambda y: p.START[y[0]] + sum(e[i, k] for i, k in enumerate(y)) + sum(field.moves[a, b] for a, b in zip(y, y[1:])),
            )
            score = lambda y: p.START[y[0]] + sum(e[i, k] for i, k in enumerate(y)) + sum(field.moves[a, b] for a, b in zip(y, y[1:]))
            assert score(tuple(field.decode([s])[0])) == score(best)


def test_every_row_has_its_spans(spark):
    got = p.personal_data(cases.clashing(spark)).collect()
    assert len(got) == len(cases.ROWS)
    expect = sorted(((i, p.spelled(plain(t or ""))) for i, t, *_ in cases.ROWS), key=repr)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted(((r["doc_id"], r["base_sha256"]) for r in got), key=repr) == sorted(((i, digest(s)) for i, s in expect), key=repr)
    for r in got:
        assert r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"] + r["n_added"] == len([s for s in r["spans"].split(",") if s])
    assert p.personal_data(cases.none(spark)).collect() == []
