import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cubegraph.llm import alignment as m
from tests.llm import cases

ODD = ["a▁b", "<unk> </s> <0x41> <|endoftext|>", " lead  and trail ", "\x00x", "tab\tline\nend", "日本語 text", "é x", "x" * 300, "''s 's", "ǅ ß ﬁ"]


@pytest.fixture(scope="module")
def encoders():
    return m.Encoders()


def brute(rows):
    """Straight from the definitions, token by token."""
    a_model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = m.byte_of_letters()
    linked, counts = [], Counter()
    for _, text in rows:
        a = a_model.encode(" " + (text or ""), add_special_tokens=False) if text else None
        a_ids = a.ids if a else []
        b_ids = b_model.encode(text) if text else []
        a_bytes = [bytes(letters[c] for c in t) for t in (a.tokens if a else [])]
        b_bytes = [m.piece_bytes(b_model.id_to_piece(i)) for i in b_ids]
        spelt = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes) != spelt or b"".join(b_bytes) != spelt:
            linked.append(([], [], [], ""))
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (a_bytes, b_bytes)]
        shared = sorted(set(ends[0]) & set(ends[1]))
        groups, low = [], 0
        for high in shared:
            one = [",".join(str(i) for i, e in zip(ids, es) if low < e <= high) for ids, es in zip((a_ids, b_ids), ends)]
            groups.append("|".join(one))
            low = high
        spans = [[(e - len(x), e) for e, x in zip(es, side)] for es, side in zip(ends, (a_bytes, b_bytes))]
        links = []
        passed = 0
        for (s, e), i in zip(spans[0], a_ids):
            for (u, v), j in zip(spans[1][passed:], b_ids[passed:]):
                if s < v and u < e:
                    links.append((i, j))
                elif u >= e:
                    break
                else:
                    passed += 1
        counts.update(links)
        linked.append((a_ids, b_ids, links, ";".join(groups)))
    highest = Counter()
    for (_, j), n in counts.items():
        highest[j] = max(highest[j], n)
    out = []
    for (doc_id, _), (a_ids, b_ids, links, groups) in zip(rows, linked):
        out.append((
            doc_id, len(a_ids), len(b_ids), groups.count(";") + 1 if groups else 0, len(links),
            sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links),
            hashlib.sha256(groups.encode()).hexdigest() if groups else "",
        ))
    return out


def short_rows():
    rows = [(r[0], r[1][:4000] if r[1] else r[1]) for r in cases.ROWS]
    return rows + [(100 + k, t) for k, t in enumerate(ODD)]


def test_against_brute_force(spark):
    rows = short_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in m.aligned(docs).collect()), key=repr)
    assert got == sorted(brute(rows), key=repr)


def test_given_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert sorted(map(tuple, m.aligned(docs).collect())) == sorted(brute(rows))


def test_both_libraries_of_a_agree(encoders):
    r = random.Random(5)
    letters = [chr(c) for c in range(0x250)]
    texts = ["".join(r.choice(letters) for _ in range(60)) for _ in range(2000)]
    texts += ["".join(r.choice(" \n\t\r'astr1\x85\xa0é") for _ in range(40)) for _ in range(2000)]
    for t in texts:
        assert encoders.a_ids(t) == encoders.whole.encode(" " + t, add_special_tokens=False).ids


def test_varints_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 1000):
        v = np.concatenate([r.integers(0, 1 << k, n) for k in (1, 7, 14, 31, 62)])
        data, at = m.varints(v)
        assert m.from_varints(data).tolist() == v.tolist() and len(at) == len(v) + 1


def test_blocks_hold_every_link(encoders):
    """A block's documents, decoded again, have the links that were put in."""
    rows = short_rows()
    found = m.align([t or "" for _, t in rows], encoders)
    width = len(encoders.b.pieces)
    block = m.Block()
    block.add([i for i, _ in rows], found, found.link_a * width + found.link_b, width * len(encoders.a.pieces))
    names = ["block", "doc_id", *m.DOC_COLUMNS]
    schema = pa.schema([(n, pa.int64()) for n in names] + [("groups_sha256", pa.string())] + [(n, pa.binary()) for n in ("places", "times", "pairs", "totals")])
    batch = block.batch(7, schema).to_pylist()
    pairs = np.cumsum(m.from_varints(batch[-1]["pairs"]))
    totals = Counter()
    for k, row in enumerate(batch[:-1]):
        mine = found.link_doc == k
        links = Counter((found.link_a * width + found.link_b)[mine].tolist())
        at = np.cumsum(m.from_varints(row["places"]))
        assert dict(zip(pairs[at].tolist(), m.from_varints(row["times"]).tolist())) == links
        totals += links
    assert dict(zip(pairs.tolist(), m.from_varints(batch[-1]["totals"]).tolist())) == totals


def test_groups_spell_the_text(spark, encoders):
    for r in m.token_groups(cases.clashing(spark)).collect():
        a = [int(i) for g in r["groups"].split(";") if g for i in g.split("|")[0].split(",")]
        if a:
            spelt = b"".join(encoders.a.pieces[np.array(a)].tolist()).decode()
            assert spelt[1:] in {t for _, t, *_ in cases.ROWS}


def test_clashing_columns_and_empty_table(spark):
    assert m.aligned(cases.clashing(spark)).count() == len(cases.ROWS)
    assert m.aligned(cases.none(spark)).collect() == []
