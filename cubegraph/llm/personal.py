"""Personal data: exact patterns, and a linear-chain conditional random field that adds to them.

Base spans come from four patterns with checks. The field labels tokens (runs of digits, runs of
letters, single marks) with begin/inside tags of the four kinds by word-shape features of the token and its
neighbours. It is trained by gradient ascent on a small labelled table and decoded by
Viterbi, many sequences at a time in numpy.

Words without a digit, an @ or a spelt-out mark such as "(at)" are fixed to "outside", in training as in
decoding, unless they stand beside such a spelt-out mark. Fixed words cut the chain, so the runs of
other words (with a word of context on either side) are exact sequences of their own: the whole
text is searched, and only those runs cost a decoding.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubegraph.llm.base import read, register, text_of

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
Span = tuple[str, int, int]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Each @ with the local characters before it, back to the last match, and a domain after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and text[begin - 1] in LOCAL:
            begin -= 1
        domain = DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            end = domain.end()
            yield "email", begin, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns in code points, sorted by start, then kind."""
    found = list(emails(text))
    first = DIGIT.search(text)
    if first:
        begin = first.start()
        for m in IP.finditer(text, begin):
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
                found.append(("ip", *m.span()))
        for m in CARD.finditer(text, begin):
            if m.end() - m.start() >= 12:
                digits = re.sub("[ -]", "", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", *m.span()))
        for m in PHONE.finditer(text, max(begin - 1, 0)):
            if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                found.append(("phone", *m.span()))
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ---- sequences -------------------------------------------------------------------------------

MARKED = re.compile(r"[0-9@]")
SPELT = re.compile(r"[\[({](?:at|dot)[\])}]", re.IGNORECASE)
WORD_END = re.compile(r"\S*")
TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S", re.UNICODE)


def marked_words(text: str) -> list[tuple[int, int]]:
    """(start, end) of the words that are not fixed to outside, in order."""
    spots = [m.start() for m in MARKED.finditer(text)]
    spelt = [m.start() for m in SPELT.finditer(text)]
    words, end = [], 0
    for at in sorted(spots + spelt):
        if at < end:
            continue
        begin = at
        while begin > end and not text[begin - 1].isspace():
            begin -= 1
        end = WORD_END.match(text, at).end()
        words.append((begin, end))
    if spelt:  # their neighbours are open too
        beside = {w for at in spelt for w in neighbours(text, at)}
        words = sorted({*words, *beside})
    return words


def word_before(text: str, at: int) -> tuple[int, int] | None:
    end = at
    while end > 0 and text[end - 1].isspace():
        end -= 1
    begin = end
    while begin > 0 and not text[begin - 1].isspace():
        begin -= 1
    return (begin, end) if begin < end else None


def word_after(text: str, at: int) -> tuple[int, int] | None:
    begin = at
    while begin < len(text) and text[begin].isspace():
        begin += 1
    end = WORD_END.match(text, begin).end()
    return (begin, end) if begin < end else None


def neighbours(text: str, at: int) -> Iterator[tuple[int, int]]:
    begin = at
    while begin > 0 and not text[begin - 1].isspace():
        begin -= 1
    before, after = word_before(text, begin), word_after(text, WORD_END.match(text, at).end())
    yield from (w for w in (before, after) if w)


@dataclass
class Sequence:
    """Tokens of a run of open words; ``fixed`` ones, the context on either side, must be outside."""

    tokens: list[tuple[int, int]]
    words: list[str]
    fixed: list[bool]


def sequences(text: str) -> list[Sequence]:
    out: list[Sequence] = []
    run: list[tuple[int, int]] = []

    def close() -> None:
        if run:
            before, after = word_before(text, run[0][0]), word_after(text, run[-1][1])
            tokens, fixed = [], []
            for begin, end, outside in (
                *([(*before, True)] if before else []), *((*w, False) for w in run), *([(*after, True)] if after else [])
            ):
                for m in TOKEN.finditer(text, begin, end):
                    tokens.append(m.span())
                    fixed.append(outside)
            out.append(Sequence(tokens, [text[a:b] for a, b in tokens], fixed))
            run.clear()

    for word in marked_words(text):
        if run and text[run[-1][1] : word[0]].strip():
            close()
        run.append(word)
    close()
    return out


# ---- features --------------------------------------------------------------------------------

BUCKETS = 1 << 13


def shape(token: str) -> str:
    """Digits as d and their number, letters as their case and a length class, marks as themselves."""
    if token[0].isdigit():
        return f"d{min(len(token), 20)}"
    if token.isalpha():
        case = "u" if token.isupper() else "c" if token[0].isupper() else "l"
        return case + ("1" if len(token) == 1 else "3" if len(token) < 4 else "+")
    return token


#: Words that speak of a kind; other words count by shape alone.
CUES = frozenset(
    "at dot com org net mail email call phone tel telephone mobile fax cell number card visa credit ip address server host "
    "version page room order invoice chapter section isbn date year total price code".split()
)


def features(s: Sequence) -> np.ndarray:
    """(tokens, features) bucket numbers."""
    shapes = [shape(w) for w in s.words]
    cue = [w.lower() if w.lower() in CUES else "" for w in s.words]
    glued = [i > 0 and s.tokens[i - 1][1] == s.tokens[i][0] for i in range(len(shapes))]
    at = lambda x, i: x[i] if 0 <= i < len(x) else "#"
    rows = []
    for i, (w, sh) in enumerate(zip(s.words, shapes)):
        before, after, before2, after2 = at(shapes, i - 1), at(shapes, i + 1), at(shapes, i - 2), at(shapes, i + 2)
        j0, j1 = ("g" if glued[i] else "s"), ("g" if i + 1 < len(shapes) and glued[i + 1] else "s")
        check = "luhn" if w.isdigit() and 12 <= len(w) <= 19 and luhn(w) else ""
        octet = "oct" if w.isdigit() and len(w) <= 3 and int(w) <= 255 else ""
        rows.append(
            (
                f"0{sh}", f"1{cue[i]}{check}{octet}", f"2{before}{j0}{sh}", f"3{sh}{j1}{after}", f"4{before2}|{before}{j0}{sh}",
                f"5{sh}{j1}{after}|{after2}", f"6{before}{j0}{sh}{j1}{after}", f"7{at(cue, i - 1)}", f"8{at(cue, i + 1)}",
                f"9{at(cue, i - 2)}{before}{j0}", f"a{before2}|{before}{j0}{sh}{j1}{after}|{after2}", f"b{at(shapes, i - 3)}|{before2}|{before}{j0}{sh}",
            )
        )
    return np.array([[zlib.crc32(f.encode()) % BUCKETS for f in row] for row in rows], np.int64)


# ---- the field -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    weights: np.ndarray  # (BUCKETS, labels)
    moves: np.ndarray  # (labels, labels)

    def emissions(self, feats: np.ndarray, fixed: np.ndarray) -> np.ndarray:
        e = self.weights[feats].sum(axis=1)
        e[fixed, 1:] = -np.inf
        return e

    def decode(self, seqs: list[Sequence]) -> list[np.ndarray]:
        """The best labels of each sequence; sequences of similar length share a batch."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(seqs)
        order = sorted((i for i, s in enumerate(seqs) if s.tokens), key=lambda i: len(seqs[i].tokens))
        begin = 0
        while begin < len(order):
            longest, end = len(seqs[order[begin]].tokens), begin
            while end < len(order) and len(seqs[order[end]].tokens) <= 2 * longest and end - begin < 512:
                end += 1
            part = order[begin:end]
            for i, labels in zip(part, self._viterbi([seqs[i] for i in part])):
                out[i] = labels
            begin = end
        return out

    def _viterbi(self, seqs: list[Sequence]) -> list[np.ndarray]:
        sizes = np.array([len(s.tokens) for s in seqs])
        n, steps, k = len(seqs), int(sizes.max()), len(LABELS)
        e = np.zeros((n, steps, k))
        for i, s in enumerate(seqs):
            e[i, : sizes[i]] = self.emissions(features(s), np.array(s.fixed))
        score, back = e[:, 0] + START[None, :], np.zeros((n, steps, k), np.int8)
        ends = np.zeros((n, k))
        ends[sizes == 1] = score[sizes == 1]
        for t in range(1, steps):
            paths = score[:, :, None] + self.moves[None]
            back[:, t] = paths.argmax(axis=1)
            score = paths.max(axis=1) + e[:, t]
            ends[sizes == t + 1] = score[sizes == t + 1]
        out = []
        for i in range(n):
            labels = np.zeros(sizes[i], np.int64)
            labels[-1] = ends[i].argmax()
            for t in range(sizes[i] - 1, 0, -1):
                labels[t - 1] = back[i, t, labels[t]]
            out.append(labels)
        return out


def allowed_moves() -> np.ndarray:
    """0 where one label may follow another, else -inf: inside follows begin or inside of its kind."""
    moves = np.zeros((len(LABELS), len(LABELS)))
    for a, before in enumerate(LABELS):
        for b, label in enumerate(LABELS):
            if label[0] == "I" and (before == "O" or before[2:] != label[2:]):
                moves[a, b] = -np.inf
    return moves


START = np.where([label[0] == "I" for label in LABELS], -np.inf, 0.0)


def gold(s: Sequence, spans: list[Span]) -> np.ndarray:
    labels = np.zeros(len(s.tokens), np.int64)
    for i, (a, b) in enumerate(s.tokens):
        for kind, begin, end in spans:
            if begin <= a and b <= end and not s.fixed[i]:
                labels[i] = 1 + 2 * KINDS.index(kind) + (a > begin)
    return labels


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


class Batch:
    """Labelled sequences of similar length, padded to the longest."""

    def __init__(self, rows: list[tuple[Sequence, np.ndarray]]):
        self.sizes = np.array([len(s.tokens) for s, _ in rows])
        self.n, self.steps = len(rows), int(self.sizes.max())
        self.feats = np.zeros((self.n, self.steps, features(rows[0][0]).shape[1]), np.int64)
        self.truth = np.zeros((self.n, self.steps), np.int64)
        self.fixed = np.zeros((self.n, self.steps), bool)
        for i, (s, labels) in enumerate(rows):
            size = self.sizes[i]
            self.feats[i, :size], self.truth[i, :size], self.fixed[i, :size] = features(s), labels, s.fixed
        self.live = np.arange(self.steps)[None, :] < self.sizes[:, None]

    def gradient(self, weights: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Observed less expected counts of (bucket, label) and of (label, label)."""
        n, steps, k = self.n, self.steps, len(LABELS)
        e = weights[self.feats].sum(axis=2)
        e[self.fixed, 1:] = -np.inf
        alpha, beta = np.zeros((n, steps, k)), np.zeros((n, steps, k))
        alpha[:, 0] = e[:, 0] + START
        for t in range(1, steps):
            alpha[:, t] = log_sum(alpha[:, t - 1][:, :, None] + step[None], 1) + e[:, t]
        for t in range(steps - 2, -1, -1):
            after = log_sum(step[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(self.live[:, t + 1][:, None], after, 0.0)
        total = log_sum(alpha[np.arange(n), self.sizes - 1], 1)
        error = -np.exp(alpha + beta - total[:, None, None])
        error[np.arange(n)[:, None], np.arange(steps)[None, :], self.truth] += 1
        flat = self.feats[self.live]
        each = np.repeat(error[self.live], flat.shape[1], axis=0)
        grad = np.stack([np.bincount(flat.reshape(-1), each[:, c], BUCKETS) for c in range(k)], axis=1)
        both = self.live[:, 1:]
        seen = np.bincount(self.truth[:, :-1][both] * k + self.truth[:, 1:][both], minlength=k * k).reshape(k, k)
        edge = alpha[:, :-1, :, None] + step[None, None] + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None]
        return grad, seen - np.exp(edge[both]).sum(axis=0)


def train(table: list[tuple[str, list[Span]]], epochs: int = 40, rate: float = 0.3, decay: float = 1e-4) -> Field:
    """Weights that maximise the penalised log likelihood of the labelled rows (AdaGrad over all rows)."""
    rows = [(s, gold(s, spans)) for text, spans in table for s in sequences(text) if s.tokens]
    rows.sort(key=lambda r: len(r[0].tokens))
    k, n = len(LABELS), len(rows)
    batches = [Batch(rows[i : i + 64]) for i in range(0, n, 64)]
    weights, moves, allowed = np.zeros((BUCKETS, k)), np.zeros((k, k)), allowed_moves()
    sums_w, sums_m = np.full((BUCKETS, k), 1e-8), np.full((k, k), 1e-8)
    for _ in range(epochs if rows else 0):
        parts = [b.gradient(weights, moves + allowed) for b in batches]
        grad_w = sum(g for g, _ in parts) / n - decay * weights
        grad_m = sum(g for _, g in parts) / n - decay * moves
        sums_w += grad_w**2
        sums_m += grad_m**2
        weights += rate * grad_w / np.sqrt(sums_w)
        moves += rate * grad_m / np.sqrt(sums_m)
    return Field(weights, moves + allowed)


# ---- the labelled table ----------------------------------------------------------------------

#: Sentences of the labelled table. {kind} marks a value to find; other braces are filled with values to leave.
TEMPLATES = (
    "please write to {email} for details", "contact {email}, or {email}", "mail {email}.", "reach me at {email} or call {phone}",
    "call {phone} today", "phone: {phone}", "tel {phone}, ext", "my number is {phone}.", "fax {phone} and mobile {phone}",
    "the server {ip} did not answer", "host {ip}: refused", "from {ip} to {ip}", "card {card} expired", "pay with {card}.", "visa {card}, thanks",
    "on {date} we met", "version {version} was out", "it cost {price} in all", "order {order} has shipped", "at {time} sharp",
    "pages {range} of the book", "section {version}, page {small}", "isbn {isbn} in print", "{small} of {small} people", "in {year} and {year}, too",
    "a total of {large} units", "room {small}, floor {small}", "by {price} or {percent}", "he said it (at) last and left", "see {ref} and {ref}", "score {score}",
    "between {year} - {year} there were {large}", "{word}@ and {word} were typed", "tag @{word} and {small}",
    "{word} token = \"{hex}\" {word}", "key {hex}.", "id {uuid}", "number {decoy} {word}", "{word} {decoy}.", "{decoy} {decoy} {word}", "account {decoy} and {card}",
    "{card} {card} {word}", "{phone} {ip} {word}", "{word} {ip} {phone}", "{word} {card} {ip}", "{word} {phone} {card}",
)


def filler(kind: str, r: random.Random) -> str:
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda: "".join(r.choice("abcdefghijklmnoprstuvwy") for _ in range(r.randint(2, 9)))
    if kind == "email":
        name, host, top = r.choice([w(), f"{w()}.{d(2)}", f"{w()}_{w()}"]), w(), r.choice(["com", "org", "net", "de", "fr"])
        at, dot = r.choice([("@", ".")] * 2 + [(" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", ".")])
        return f"{name}{at}{host}{dot}{top}"
    if kind == "phone":
        area, mid, end = f"{r.randint(2, 9)}{d(2)}", d(3), d(4)
        return r.choice(
            [f"+{r.randint(1, 99)} ({area}) {mid}-{end}", f"({area}) {mid}-{end}", f"{area}-{mid}-{end}", f"{area}.{mid}.{end}", f"+{r.randint(1, 99)} {area} {mid} {end}"]
        )
    if kind == "ip":
        return ".".join(str(r.randint(0, 255)) for _ in range(4))
    if kind == "card":
        body = r.choice("3456") + d(14)
        digits = next(body + c for c in "0123456789" if luhn(body + c))
        return r.choice([digits, " ".join(digits[i : i + 4] for i in range(0, 16, 4)), "-".join(digits[i : i + 4] for i in range(0, 16, 4))])
    return {
        "date": lambda: r.choice([f"{r.randint(1900, 2030)}-{d(2)}-{d(2)}", f"{r.randint(1, 31)}.{r.randint(1, 12)}.{r.randint(1900, 2030)}", f"{d(2)}/{d(2)}/{d(4)}"]),
        "version": lambda: r.choice([f"{d(1)}.{d(1)}", f"{d(1)}.{d(2)}.{d(1)}", f"{d(1)}.0."]),
        "price": lambda: r.choice([f"${r.randint(1, 999)}.{d(2)}", f"{r.randint(1, 99)},{d(3)}.{d(2)}"]),
        "order": lambda: r.choice([f"#{d(6)}", f"A{d(5)}-{d(2)}", d(8), f"{d(5)}-{d(5)}"]),
        "time": lambda: f"{d(2)}:{d(2)}",
        "range": lambda: f"{r.randint(1, 200)}-{r.randint(200, 999)}",
        "small": lambda: str(r.randint(0, 999)),
        "year": lambda: str(r.randint(1900, 2030)),
        "large": lambda: r.choice([d(5), d(7), d(11), f"{d(3)} {d(3)}", f"{r.randint(1, 9)},{d(3)},{d(3)}"]),
        "isbn": lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}",
        "percent": lambda: f"{d(2)}.{d(1)}%",
        "ref": lambda: f"[{d(2)}]",
        "score": lambda: f"{d(1)}-{d(1)}",
        "word": w,
        "hex": lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([12, 20, 32, 40, 64]))),
        "uuid": lambda: "-".join("".join(r.choice("0123456789abcdef") for _ in range(n)) for n in (8, 4, 4, 4, 12)),
        "decoy": lambda: next(x for x in iter(lambda: d(r.choice([12, 14, 15, 16, 16, 16, 16, 19])), "") if not luhn(x)),
    }[kind]()


def labelled_table(rows: int = 900, seed: int = 11) -> list[tuple[str, list[Span]]]:
    """The small labelled table: (text, spans), ``rows`` sentences drawn from the templates."""
    r, out = random.Random(seed), []
    for i in range(rows):
        text, spans = "", []
        for k, piece in enumerate(re.split(r"\{(\w+)\}", TEMPLATES[i % len(TEMPLATES)])):
            value = filler(piece, r) if k % 2 else piece
            if k % 2 and piece in KINDS:
                spans.append((piece, len(text), len(text) + len(value)))
            text += value
        out.append((text, spans))
    return out


# ---- spans of whole texts --------------------------------------------------------------------


def added_spans(field: Field, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
    """For each text the spans that the field finds and no base span touches."""
    seqs = [sequences(t) for t in texts]
    labels = iter(field.decode([s for own in seqs for s in own]))
    out = []
    for own, known in zip(seqs, base):
        found: list[Span] = []
        for s in own:
            current: Span | None = None
            for (a, b), label in zip(s.tokens, next(labels)):
                tag = LABELS[label]
                if tag[0] == "I" and current:
                    current = (current[0], current[1], b)
                    continue
                if current:
                    found.append(current)
                current = (tag[2:], a, b) if tag[0] == "B" else None
            if current:
                found.append(current)
        out.append([f for f in found if not any(f[1] < e and b < f[2] for _, b, e in known)])
    return out


def personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), n_added, base_sha256, spans: a row per row.

    A null text counts as empty; a text without spans has counts of 0, the digest of the empty
    string and empty ``spans``. Repeated rows give repeated results, a null doc_id is handed through, an
    empty table gives an empty result. Only doc_id and text are read.
    """
    field = field or train(labelled_table())

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            base = [base_spans(t) for t in texts]
            extra = added_spans(field, texts, base)
            counts = [pa.array([sum(s[0] == k for s in own) for own in base], pa.int64()) for k in KINDS]
            digests = [hashlib.sha256(spelled(own).encode()).hexdigest() for own in base]
            every = [spelled(in_order(own + more)) for own, more in zip(base, extra)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *counts, pa.array(list(map(len, extra)), pa.int64()), pa.array(digests, pa.string()), pa.array(every, pa.string())],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "n_added", "base_sha256", "spans"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(
        found, f"doc_id {kind}, {counts}, n_added long, base_sha256 string, spans string"
    )


@register()
def op2_personal_data(spark, sf_dir):
    return personal_data(read(spark, sf_dir, "documents"))
