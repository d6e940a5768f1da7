"""Token ids of whole texts by a public vocabulary, with a cache of the words met.

The vocabulary's normaliser and splitter treat what white space separates on its own, so a
text's ids are its words' ids one after another. Words of letters up to U+012F need
no normalising but lower case and go to the vocabulary's model directly; all others
pass through the library's whole encoder. Both give the ids of ``Tokenizer.encode``.
"""

from __future__ import annotations

from array import array

import public_tokenizers
import regex
from tokenizers import Tokenizer

DEFAULT_VOCABULARY = "word_bpe_49k.json"
#: Fixed value: the splitter of the vocabulary file.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Control characters, white space beyond the plain space, and letters whose case or composition is not plain.
UNUSUAL = regex.compile(r"[\x00-\x20\x7f-\xa0İ-\U0010ffff]|<\|")
MOST_CACHED = 400_000


def byte_letters() -> dict[int, str]:
    """Code point -> the letters that stand for its UTF-8 bytes in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    letter = {b: chr(b) if b in plain else chr(next(spare)) for b in range(256)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0x130)}


class WordTokenizer:
    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = byte_letters()
        self.words: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            tokens = self.model.tokenize(piece.translate(self.letters))
            ids = self.pieces[piece] = array("I", [t.id for t in tokens]).tobytes()
        return ids

    def _word(self, word: str) -> bytes:
        if UNUSUAL.search(word):
            return array("I", self.whole.encode(word, add_special_tokens=False).ids).tobytes()
        word = word.lower()
        if word.isalpha():
            return self._piece(word)
        return b"".join(map(self._piece, PIECES.findall(word)))

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the whole text."""
        words = text.replace("\n", " ").split(" ")
        known = self.words
        if len(known) > MOST_CACHED:  # the caches only save time; they start again when large
            known.clear()
            self.pieces.clear()
            known[""] = b""
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            for w in words:
                if w not in known:
                    known[w] = self._word(w)
            return b"".join([known[w] for w in words])


_LOADED: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str | None = None) -> WordTokenizer:
    """The tokenizer of a vocabulary file, loaded once per Python worker."""
    path = path or public_tokenizers.path(DEFAULT_VOCABULARY)
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]
