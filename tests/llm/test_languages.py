import zlib

import numpy as np

from cubegraph.llm import languages as g
from tests.llm import cases


def test_automaton_holds_exactly_the_stretches():
    codes = [1, 2, 1, 1, 2, 3, 1]
    table = g.suffix_automaton(codes, 4)
    stretches = {tuple(codes[a:b]) for a in range(8) for b in range(a, 8)}
    import itertools

    for n in range(1, 5):
        for word in itertools.product((1, 2, 3), repeat=n):
            state = 0
            for c in word:
                state = table[state, c] if state >= 0 else -1
            assert (state >= 0) == (word in stretches)


def greedy(train: str, text: str) -> int:
    phrases, at = 0, 0
    while at < len(text):
        end = at + 1
        while end <= len(text) and text[at:end] in train:
            end += 1
        phrases += 1
        at = max(end - 1, at + 1)
    return phrases


def test_phrases_are_the_greedy_parse(monkeypatch):
    monkeypatch.setattr(g, "SEGMENT", 10_000)
    train, texts = "the cat sat on the mat and the dog", ["the dog sat", "zebra and cat", "a", "xyz", "mat mat  mat"]
    model = g.train([("en", train)])
    counts, sizes = model.phrases(texts)
    for text, n in zip(texts, counts[:, 0]):
        known = "".join(c if c in train else "\0" for c in " ".join(text.split()))
        assert abs(n - greedy(" " + train, known)) <= 1


def plain(text, known):
    """Letters in lower case, runs of others as one space, letters that no training text has as one mark."""
    out = ""
    for c in text:
        c = (c.lower() if c.lower() in known else "\0") if c.isalpha() else " "
        out += "" if c == " " and out.endswith(" ") else c
    return out


def segments_parsed(train, text):
    """Phrases of a text in segments, letter by letter: each segment begins one, and each letter that ends a match the next."""
    count = 0
    for at in range(0, len(text), g.SEGMENT):
        count, match = count + 1, ""
        for c in text[at : at + g.SEGMENT]:
            if match + c in train:
                match += c
            else:
                count, match = count + 1, c if c in train else ""
    return count


def test_own_parse_and_predictions_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sample = g.training_sample(docs)
    model = g.train(sample)
    by_lang = {}
    for lang, text in sample:
        letters = "".join(c if c.isalpha() else " " for c in text.lower())
        by_lang[lang] = by_lang.get(lang, "") + " " + " ".join(letters.split())
    known = {c for t in by_lang.values() for c in t if c != " "}
    texts = [r["text"] for r in docs.orderBy("doc_id").limit(40).collect()] + ["x", "ab  ab", "Ωmega 12 ab" * 90]
    counts, sizes = model.phrases(texts)
    for text, row, size in zip(texts, counts, sizes):
        read = plain(text, known)
        assert (row.tolist(), size) == ([segments_parsed(" " + by_lang[k], read) for k in model.languages], len(read))
    need = counts * np.log2(np.array([len(by_lang[k]) for k in model.languages]) + 2) / sizes[:, None]
    assert model.predict(texts)["lang_pred"].tolist() == [model.languages[k] for k in need.argmin(axis=1)]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in g.identified(docs).collect()}
    held = [r for r in docs.select("doc_id", "lang").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(got[r["doc_id"]]["held_out"] for r in held) and sum(r["held_out"] for r in got.values()) == len(held)
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_odd_rows(spark):
    got = g.identified(cases.clashing(spark)).collect()
    assert len(got) == len(cases.ROWS)
    und = sorted((r["doc_id"] for r in got if r["lang_pred"] == "und"), key=repr)
    assert und == sorted([3, 4, 5, 10], key=repr)
    df = cases.clashing(spark)
    kept = g.with_known_language(df)
    assert kept.columns == df.columns and kept.count() == len(cases.ROWS) - 4


def test_without_rows_or_labels(spark):
    assert g.identified(cases.none(spark)).collect() == []
    bare = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [tuple(r)[2:] for r in g.identified(bare).collect()] == [("und", 0.0)]
