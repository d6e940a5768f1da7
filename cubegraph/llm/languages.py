"""Language identification by cross-parsing with suffix automata.

For each language a suffix automaton is built over labelled text. A text is parsed against it
greedily: the longest stretch that occurs in the training text is a phrase, then the next one begins.
The number of phrases, times the logarithm of the training length, over the letters read is an
estimate of the cross entropy, and the language that needs least wins.

The automata are kept as dense tables (state x letter) with the restart folded in, so a
step of the parse is one gather, taken for all segments of a batch at once. A text is parsed in segments of
``SEGMENT`` letters, each beginning a phrase of its own; the whole text is read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cubegraph.llm.base import fold_of, read, register, store

#: Bounds of the training sample: texts per language (about; twice as many at most), characters of each, and languages.
SAMPLE_DOCS, SAMPLE_CHARS, MOST_LANGUAGES = 80, 200, 500
FOLDS, HELD_OUT = 5, 0
SEGMENT = 256
UNKNOWN_LANGUAGE = "und"
BATCH_LETTERS = 1 << 21


def suffix_automaton(codes: list[int], letters: int) -> np.ndarray:
    """Transitions (state, letter) -> state, -1 where there is none; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in codes:
        cur = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = cur
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    table = np.full((len(step), letters), -1, np.int64)
    for s, to in enumerate(step):
        if to:
            table[s, list(to)] = list(to.values())
    return table


def restarting(table: np.ndarray) -> np.ndarray:
    """The table with ~(state after the restart) where a phrase ends; a last column, padding, changes nothing."""
    begin = np.where(table[0] >= 0, table[0], 0)
    full = np.where(table >= 0, table, ~begin[None, :])
    kind = np.int16 if len(table) <= 1 << 15 else np.int32
    return np.hstack([full, np.zeros((len(full), 1), full.dtype)]).astype(kind)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    tables: list[np.ndarray]
    train_lengths: list[int]
    code_of: np.ndarray  # code point below 2**16 -> letter class; 0 is anything but a letter

    @property
    def unknown(self) -> int:
        return self.tables[0].shape[1] - 2

    def codes(self, text: str) -> np.ndarray:
        """Letter classes of a whole text, runs of other characters as one break."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.code_of[np.minimum(points, 0xFFFF)]
        if len(codes):
            codes = codes[(codes != 0) | np.append(True, codes[:-1] != 0)]
        return codes

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases by text and language, letters by text)."""
        counts, sizes = np.zeros((len(texts), len(self.languages)), np.int64), np.zeros(len(texts), np.int64)
        begin, pending, room = 0, [], BATCH_LETTERS
        for i, text in enumerate(texts):
            pending.append(self.codes(text))
            sizes[i] = len(pending[-1])
            room -= sizes[i]
            if room <= 0 or i == len(texts) - 1:
                counts[begin : i + 1] = self._parse(pending)
                begin, pending, room = i + 1, [], BATCH_LETTERS
        return counts, sizes

    def _parse(self, texts: list[np.ndarray]) -> np.ndarray:
        owner = np.repeat(np.arange(len(texts)), [-(-len(t) // SEGMENT) for t in texts])
        width = self.tables[0].shape[1]
        lanes = np.full((len(owner), SEGMENT), width - 1, np.uint8 if width < 256 else np.uint16)
        at = 0
        for t in texts:
            n = -(-len(t) // SEGMENT)
            lanes[at : at + n].reshape(-1)[: len(t)] = t
            at += n
        steps = np.ascontiguousarray(lanes.T)
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        for k, table in enumerate(self.tables):
            flat = table.reshape(-1)
            state = np.zeros(len(owner), np.int64)
            ends = np.ones(len(owner), np.int32)
            for column in steps:
                state *= width
                state += column
                got = flat[state]
                bad = got < 0
                ends += bad
                state = np.where(bad, ~got, got).astype(np.int64)
            out[:, k] = np.bincount(owner, ends, len(texts))
        return out

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        counts, sizes = self.phrases([t or "" for t in texts])
        need = counts * np.log2(np.array(self.train_lengths) + 2)[None, :] / np.maximum(sizes, 1)[:, None]
        best = need.argmin(axis=1)
        first = need[np.arange(len(need)), best]
        rest = need.copy()
        rest[np.arange(len(need)), best] = np.inf
        second = rest.min(axis=1) if len(self.languages) > 1 else np.full(len(need), np.inf)
        lettered = np.array([any(map(str.isalpha, t or "")) for t in texts], bool)
        ok = lettered & (sizes > 0)
        with np.errstate(invalid="ignore"):
            score = np.where(ok, 1 - np.where(np.isinf(second), 0, first / second), 0.0)
        names = np.array(self.languages, object)[best]
        return pd.DataFrame({"lang_pred": np.where(ok, names, UNKNOWN_LANGUAGE), "score": score.clip(0, 1)})


def train(sample: list[tuple[str, str]]) -> LanguageModel | None:
    """A model of (language, text) rows; None where no row has a letter."""
    text_by: dict[str, str] = {}
    for lang, text in sample:
        plain = "".join(c if c.isalpha() else " " for c in text.lower())
        text_by[lang] = text_by.get(lang, "") + " " + " ".join(plain.split())
    text_by = {k: v for k, v in sorted(text_by.items()) if v.strip()}
    if not text_by:
        return None
    letters = sorted({c for t in text_by.values() for c in t if c != " "})
    index = {c: i + 1 for i, c in enumerate(letters)}
    width = len(letters) + 2
    code_of = np.zeros(1 << 16, np.uint16 if width > 254 else np.uint8)
    for point in range(1 << 16):
        if 0xD800 <= point < 0xE000:
            continue
        c = chr(point)
        if c.isalpha():
            code_of[point] = index.get(c.lower(), width - 1)
    code_of[0xFFFF] = width - 1  # stands for all beyond it
    tables = [
        restarting(suffix_automaton([0, *[index.get(c, 0) for c in t]], width)) for t in text_by.values()
    ]
    return LanguageModel(list(text_by), tables, [len(t) for t in text_by.values()], code_of)


def training_sample(docs: DataFrame, docs_per_lang: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """(lang, stretch) of about ``docs_per_lang`` labelled texts of each language: at a hashed place of texts chosen by a hash.

    Only documents outside the held-out fold serve, and a text that repeats serves once. Of more than ``MOST_LANGUAGES``
    values of lang the commonest serve. The driver gets at most twice the nominal number of stretches.
    """
    held = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    rows = docs.select("doc_id", "lang", "text").filter(~held & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
    known = store(sizes.select("lang", (F.lit(float(docs_per_lang)) / F.col("n")).alias("share")), "languages")
    languages = known.count()
    if not languages:
        return []
    spot = F.pmod(F.xxhash64("text"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    place = F.pmod(F.xxhash64("text", F.lit(1)), F.greatest(F.length("text") - chars, F.lit(0)) + 1) + 1
    chosen = (
        rows.join(F.broadcast(known), "lang").filter(spot < F.col("share"))
        .select("lang", F.substr("text", place.cast("int"), F.lit(chars)).alias("text"), spot.alias("spot"))
        .filter(F.col("text").rlike(r"\p{L}"))
        .dropDuplicates(["lang", "spot", "text"])
        .orderBy("spot", "lang", "text")
        .limit(2 * docs_per_lang * languages)
    )
    return [(r["lang"], r["text"]) for r in chosen.collect()]


def predictor(model: LanguageModel | None):
    """A column function text -> struct(lang_pred, score)."""

    @F.pandas_udf("lang_pred string, score double")
    def predicted(text: pd.Series) -> pd.DataFrame:
        if model is None:
            return pd.DataFrame({"lang_pred": [UNKNOWN_LANGUAGE] * len(text), "score": [0.0] * len(text)})
        return model.predict([t if isinstance(t, str) else None for t in text])

    return predicted


def language_of(docs: DataFrame) -> Column:
    """struct(lang_pred, score) of ``text``, learned from the labelled documents among ``docs``."""
    return predictor(train(training_sample(docs)))(F.col("text"))


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: a row per row of ``docs``.

    ``und`` with score 0 where the text is null, empty or has no letter, or where no
    document is labelled. The score is the share of phrases saved against the second language. A null
    doc_id belongs to the training fold. Equal needs go to the first language by name. An empty
    table gives an empty result.
    """
    held = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return docs.select("doc_id", held.alias("held_out"), language_of(docs).alias("found")).select(
        "doc_id", "held_out", "found.lang_pred", "found.score"
    )


def with_known_language(docs: DataFrame) -> DataFrame:
    """The rows whose language could be told, with all their columns; ``und`` goes."""
    found = language_of(docs)["lang_pred"]
    return docs.withColumn("__lang", found).filter(F.col("__lang") != UNKNOWN_LANGUAGE).drop("__lang")


@register()
def op7_language_id(spark, sf_dir):
    return identified(read(spark, sf_dir, "documents"))
