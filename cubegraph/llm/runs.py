"""Maximal periodic runs of words by a harmonic grid and longest common extensions over a difference cover.

Texts of a batch are laid end to end, every text with word numbers of its own, so nothing matches across texts. A
run of period q and length L matches itself q words on over L - q words in a row; so a grid of
spacing max(SHORTEST - q, 2 q) has a point in every run looked for. All points of all periods are
(n log n) / 2; where a point matches, the run's ends are the longest common extensions to either side.

An extension compares at most ``COVER_MODULUS`` words one by one: by then both places are of the difference cover.
From there the answer is a range minimum over the common prefixes of neighbours in the sorted order of
the cover's suffixes, which are the only ones sorted.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubegraph.llm.base import read, register, text_of

#: Least length of a run in words, and in periods.
SHORTEST, REPEATS = 24, 3
#: A run has at least so many matching words in a row, whatever its period q: SHORTEST - q and (REPEATS - 1) * q both.
NEAR = SHORTEST - SHORTEST // REPEATS
#: Every difference modulo 21 occurs between two of these residues.
COVER_MODULUS, COVER = 21, (0, 1, 4, 14, 16)
#: Words of texts searched at once (a longer text is searched on its own), and extensions taken at once.
SWEEP_WORDS, SWEEP_POINTS = 200_000, 1_000_000


def shifts() -> np.ndarray:
    """[i mod m, j mod m] -> the least step that brings both places into the cover."""
    inside = np.zeros(2 * COVER_MODULUS, bool)
    inside[list(COVER)] = True
    inside[COVER_MODULUS:] = inside[:COVER_MODULUS]
    table = np.zeros((COVER_MODULUS, COVER_MODULUS), np.int64)
    for i in range(COVER_MODULUS):
        for j in range(COVER_MODULUS):
            both = inside[i : i + COVER_MODULUS] & inside[j : j + COVER_MODULUS]
            table[i, j] = int(both.argmax())
    return table


SHIFTS = shifts()


class CommonExtensions:
    """Longest common extensions to the right of pairs of places in a sequence of numbers."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        # Past the end stand numbers that occur nowhere else, so an extension stops there.
        self.words = np.append(words.astype(np.int64) + 1, np.zeros(2 * COVER_MODULUS, np.int64))
        self._sort()

    def _sort(self) -> None:
        """Ranks of the cover's suffixes: by their first words, then by doubling; and the neighbours' common prefixes."""
        w, m = self.words, COVER_MODULUS
        place = np.arange(self.n)
        covered = np.isin(place % m, COVER)
        at = place[covered]
        self.number = np.cumsum(covered) - 1  # place -> number in ``at``; only read at covered places
        top = int(w.max()) + 1
        together = 2 if max(top, len(at)) * top * top < 1 << 63 else 1  # words that fit into one key beside a rank
        rank = w[at]
        for k in range(1, m, together):
            for ahead in range(k, k + together):
                rank = rank * top + w[at + ahead]
            rank = np.unique(rank, return_inverse=True)[1]
        levels, step = [rank], m
        while len(rank) and rank.max() + 1 < len(rank):
            ahead = at + step
            there = np.where(ahead < self.n, rank[self.number[np.minimum(ahead, self.n - 1)]] + 1, 0)
            rank = np.unique(rank * (len(rank) + 1) + there, return_inverse=True)[1]
            levels.append(rank)
            step *= 2
        self.rank = rank
        order = np.empty(len(rank), np.int64)
        order[rank] = np.arange(len(rank))
        left, right = at[order[:-1]], at[order[1:]]
        common = np.zeros(max(len(order) - 1, 0), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            i, j = left + common, right + common
            inside = (i < self.n) & (j < self.n)
            i, j = np.minimum(i, self.n - 1), np.minimum(j, self.n - 1)
            level = levels[k]
            same = inside & (level[self.number[i]] == level[self.number[j]])
            common += np.where(same, m << k, 0)
        common += self._near(left + common, right + common, np.full(len(common), m))
        self.minima = [common]
        while 2 << len(self.minima) - 1 <= len(common):
            half, last = 1 << len(self.minima) - 1, self.minima[-1]
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def _near(self, i: np.ndarray, j: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Matching words from i and j on, word by word, up to ``limit``; places past the end match nothing."""
        got = np.zeros(len(i), np.int64)
        live = np.flatnonzero((limit > 0) & (i < self.n) & (j < self.n))
        while len(live):
            a, b = i[live] + got[live], j[live] + got[live]
            live = live[(self.words[a] == self.words[b]) & (a < self.n) & (b < self.n)]
            got[live] += 1
            live = live[got[live] < limit[live]]
        return got

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that match from i and from j on, for i < j."""
        limit = SHIFTS[i % COVER_MODULUS, j % COVER_MODULUS]
        got = self._near(i, j, limit)
        far = np.flatnonzero((got == limit) & (j + limit < self.n))
        if len(far):
            a, b = self.rank[self.number[i[far] + limit[far]]], self.rank[self.number[j[far] + limit[far]]]
            low, high = np.minimum(a, b), np.maximum(a, b)
            level = np.log2(high - low).astype(np.int64)
            for k in np.unique(level):
                here = level == k
                table = self.minima[k]
                got[far[here]] += np.minimum(table[low[here]], table[high[here] - (1 << k)])
        return got


def grid_points(words: np.ndarray, longest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, periods) of the grid's points that match their word a period on, some at a time."""
    places, periods, size = [], [], 0
    for q in range(1, longest // REPEATS + 1):
        spacing = max(SHORTEST - q, (REPEATS - 1) * q)
        hit = np.flatnonzero(words[: len(words) - q : spacing] == words[q::spacing])
        if len(hit):
            places.append(hit * spacing)
            periods.append(np.full(len(hit), q))
            size += len(hit)
        if size >= SWEEP_POINTS:
            yield np.concatenate(places), np.concatenate(periods)
            places, periods, size = [], [], 0
    if size:
        yield np.concatenate(places), np.concatenate(periods)


def runs_of(words: np.ndarray, longest: int) -> np.ndarray:
    """(start, length, period) of all runs, by start and period, in words that never match across texts.

    ``longest`` is the length of the longest text. Of equal stretches the least period is the run's: other
    periods of it are its multiples.
    """
    found = []
    ahead = back = None
    for place, period in grid_points(words, longest):
        # Most matches are of common words alone; few words on either side show that without any suffix.
        place, period = worthwhile(words, place, period)
        if not len(place):
            continue
        if ahead is None:
            ahead, back = CommonExtensions(words), CommonExtensions(words[::-1])
        end = place + ahead.right(place, place + period)
        mirror = len(words) - 1
        begin = place + 1 - back.right(mirror - place - period, mirror - place)
        length = end + period - begin
        kept = length >= np.maximum(SHORTEST, REPEATS * period)
        found.append(np.unique(np.column_stack([begin[kept], length[kept], period[kept]]), axis=0))
    if not found:
        return np.zeros((0, 3), np.int64)
    rows = np.unique(np.concatenate(found), axis=0)
    first = np.append(True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1))[: len(rows)]
    rows = rows[first]
    return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def worthwhile(words: np.ndarray, place: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points with ``NEAR`` matches in a row around them."""
    n = len(words)
    total = np.ones(len(place), np.int64)
    for sign in (1, -1):
        live = np.arange(len(place))
        for k in range(1, NEAR):
            a = place[live] + sign * k
            b = a + period[live]
            inside = (a >= 0) & (b < n)
            same = inside & (words[np.where(inside, a, 0)] == words[np.where(inside, b, 0)])
            live = live[same]
            if not len(live):
                break
            total[live] += 1
    kept = total >= NEAR
    return place[kept], period[kept]


@dataclass(frozen=True)
class Runs:
    """The runs of one text, (start, length, period) by start and period, and which words stay when they collapse."""

    runs: np.ndarray
    kept: np.ndarray

    @property
    def strongest(self) -> tuple[int, int, int] | None:
        """The run of greatest length over period; of ties the least start, then period."""
        return min(map(tuple, self.runs.tolist()), key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def split_words(text: str) -> list[bytes]:
    """Words between ASCII white space, in UTF-8."""
    return text.encode().split()


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words, for a tenth of the ids rewritten periodically from some word on; without an id they stay."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def runs_of_texts(texts: list[list[bytes]]) -> list[Runs]:
    """Runs of every text, searched together."""
    numbers, base = [], 0
    for words in texts:
        own: dict[bytes, int] = {}
        numbers.extend([own.setdefault(w, base + len(own)) for w in words])
        base += len(own)
    sizes = np.array([len(w) for w in texts], np.int64)
    bounds = np.append(0, np.cumsum(sizes))
    rows = runs_of(np.array(numbers, np.int32), int(sizes.max(initial=0)))
    cover = np.zeros(int(bounds[-1]) + 1, np.int64)
    np.add.at(cover, rows[:, 0] + rows[:, 2], 1)
    np.add.at(cover, rows[:, 0] + rows[:, 1], -1)
    stays = np.cumsum(cover)[:-1] == 0
    cuts = np.searchsorted(rows[:, 0], bounds)
    return [
        Runs(rows[i:j] - [first, 0, 0], stays[first:end])
        for i, j, first, end in zip(cuts, cuts[1:], bounds, bounds[1:])
    ]


def sweeps(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts of about ``SWEEP_WORDS`` words."""
    first = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > SWEEP_WORDS:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


RUN_LIST = "array<struct<start:long,length:long,period:long>>"
ARROW = {
    "long": pa.int64(),
    "string": pa.string(),
    RUN_LIST: pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])),
}


def searched(docs: DataFrame, fields: str, describe, prepare=lambda doc_id, words: words) -> DataFrame:
    """doc_id and the columns that ``describe(words, runs)`` gives for each text."""
    names, kinds = zip(*(f.split() for f in fields.split(", ")))
    types = [ARROW[k] for k in kinds]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_pylist()
            texts = [prepare(i, split_words(t)) for i, t in zip(ids, b.column(1).to_pylist())]
            out = []
            for first, end in sweeps([len(w) for w in texts]):
                out += [describe(w, r) for w, r in zip(texts[first:end], runs_of_texts(texts[first:end]))]
            columns = [pa.array([row[k] for row in out], kind) for k, kind in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(search, f"doc_id {kind}, {fields}")


def collapsed(docs: DataFrame) -> DataFrame:
    """doc_id, runs and ``collapsed``: the text's words without the later repeats of its runs, joined by a space.

    ``runs`` lists (start, length, period) by start, then period, in word numbers from 0. A null or empty text has none and
    collapses to an empty text. Rows that repeat are searched each on its own; a null doc_id is handed through. An
    empty table gives an empty result. Only doc_id and text are read, so other columns may have any name.
    """

    def describe(words: list[bytes], found: Runs) -> tuple:
        runs = [dict(zip(("start", "length", "period"), r)) for r in found.runs.tolist()]
        return runs, b" ".join([w for w, k in zip(words, found.kept.tolist()) if k]).decode()

    return searched(docs, f"runs {RUN_LIST}, collapsed string", describe)


def digest(words: list[bytes], found: Runs) -> tuple:
    """n_runs, the strongest run, and digests of all runs and of the collapsed text."""
    best = found.strongest
    start, length, period = best or (None, None, None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in found.runs.tolist())
    if best is None:
        text = b" ".join(words)
    else:
        text = b" ".join([w for w, k in zip(words, found.kept.tolist()) if k])
    exponent = 1000 * length // period if best else None
    return len(found.runs), start, length, period, exponent, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(text).hexdigest()


DIGEST = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


@register(
    r"""
WITH crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS steps),
d AS MATERIALIZED (SELECT doc_id, w, len(w) AS n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: xor(steps[xor(c, b) % 256 + 1], c // 256)), CAST(4294967295 AS BIGINT)) AS h
  FROM (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents), crc),
e AS MATERIALIZED (SELECT doc_id, w, n, h % 10 = 0 AND n > 0 AS rewritten, (h // 10) % GREATEST(n, 1) AS a, 1 + (n - (h // 10) % GREATEST(n, 1)) // (3 + (h // 10) % 8) AS p FROM d),
words AS MATERIALIZED (SELECT doc_id, n, i, w[CASE WHEN rewritten AND i >= a THEN a + (i - a) % p ELSE i END + 1] AS x FROM (SELECT *, UNNEST(range(n)) AS i FROM e)),
alike AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.x = y.x AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
found AS (SELECT doc_id, q, MIN(i) AS s, COUNT(*) + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM alike)
  GROUP BY doc_id, q, k HAVING COUNT(*) + q >= GREATEST(24, 3 * q)),
runs AS MATERIALIZED (SELECT doc_id, s, len, MIN(q) AS q FROM found GROUP BY doc_id, s, len),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CAST(len AS DOUBLE) / q DESC, s, q) = 1),
listed AS (SELECT doc_id, COUNT(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM runs GROUP BY doc_id),
dropped AS (SELECT DISTINCT doc_id, UNNEST(range(s + q, s + len)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, COALESCE(n_runs, 0) AS n_runs, s AS start, len AS length, q AS period, 1000 * len // q AS exponent_milli,
  sha256(COALESCE(listed.t, '')) AS runs_sha256, sha256(COALESCE(kept.t, '')) AS collapsed_sha256
FROM d LEFT JOIN listed USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)"""
)
def op11_periodic_runs(spark, sf_dir):
    return searched(read(spark, sf_dir, "documents"), DIGEST, digest, planted)
