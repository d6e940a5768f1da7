"""Text expressions: folding, cleaning, IRIs, literals and labels."""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as white space around and inside labels.
_SPACE_CODES = [0x20, 0xA0, 0x1680, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]
_SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x2000, 0x200B), *_SPACE_CODES]))
_SPACE_CLASS = "".join(rf"\x{{{ord(c):X}}}" for c in _SPACES)
_MARKS = range(0x0300, 0x0370)
MISSING_TEXT = "—"


@lru_cache(maxsize=None)
def _fold_table() -> tuple[str, str]:
    """Base letter for every accented letter, by canonical decomposition.

    Combining marks come last, without a counterpart, so they are removed.
    """
    accented, base = [], []
    for code in range(0xC0, 0xD800):
        letter = chr(code)
        kept = [c for c in unicodedata.normalize("NFD", letter) if ord(c) not in _MARKS]
        if len(kept) == 1 and kept[0] != letter:
            accented.append(letter)
            base.append(kept[0])
    return "".join(accented) + "".join(map(chr, _MARKS)), "".join(base)


def trim_spaces(text: Column) -> Column:
    return F.btrim(text, F.lit(_SPACES))


def strip_marks(text: Column) -> Column:
    accented, base = _fold_table()
    return F.translate(text, accented, base)


def fold(text: Column) -> Column:
    """Trimmed, lower-case, accent-free form; null folds to the empty text."""
    return strip_marks(F.lower(trim_spaces(F.coalesce(text, F.lit("")))))


def same_name(a: Column, b: Column) -> Column:
    """Equality that ignores accents, case and surrounding space."""
    return fold(a) == fold(b)


def contains_folded(text: Column, term: str) -> Column:
    return F.contains(fold(text), fold(F.lit(term)))


def rlike(text: Column, pattern: str) -> Column:
    return text.rlike(pattern)


def is_missing(text: Column, tokens: tuple[str, ...] = ("", "NA")) -> Column:
    return text.isNull() | trim_spaces(text).isin(*tokens)


def is_present(text: Column) -> Column:
    """True for a non-null, non-empty value; never null."""
    return F.coalesce(text != F.lit(""), F.lit(False))


def is_member(text: Column, names: list[str]) -> Column:
    """Membership in a closed list, by cleaned and folded name."""
    wanted = [fold(clean_label(F.lit(n))) for n in names]
    return fold(clean_label(text)).isin(*wanted)


def clean_label(text: Column) -> Column:
    """Letters, digits and ``. - ( )`` kept, runs of space collapsed, upper case."""
    kept = F.regexp_replace(
        F.coalesce(text, F.lit("")), rf"[^\p{{L}}\p{{N}}{_SPACE_CLASS}.\-()]", " "
    )
    return F.upper(trim_spaces(F.regexp_replace(kept, rf"[{_SPACE_CLASS}]+", " ")))


def iri_segment(text: Column) -> Column:
    """Percent-encoded UTF-8 path segment; only ``A-Z a-z 0-9 - . _ ~`` stay bare."""
    encoded = F.url_encode(F.coalesce(text, F.lit("")))
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(found), F.lit(wanted))
    return encoded


def uri_component(text: Column) -> Column:
    """Query-string flavour of the encoding: ``! ' ( ) *`` stay bare as well."""
    encoded = iri_segment(text)
    for found, wanted in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%2A", "*")):
        encoded = F.replace(encoded, F.lit(found), F.lit(wanted))
    return encoded


def expand(template: str, segments: dict[str, Column]) -> Column:
    """IRI from a template with ``{name}`` slots; null where a segment is null.

    Segments are text as it shall appear, encoded by :func:`iri_segment` if need be.
    """
    parts, rest = [], template
    while "{" in rest:
        head, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        parts += [F.lit(head), segments[name]]
    return F.concat(*parts, F.lit(rest)) if rest else F.concat(*parts)


def last_segment(iri: Column) -> Column:
    """Text after the last ``/`` or ``#``; the whole IRI where there is none."""
    tail = F.regexp_extract(iri, r"[/#]([^/#]+)$", 1)
    return F.when(tail != "", tail).otherwise(iri)


# Escapes of the line-based triple syntax.
_ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))


def escape_literal(text: Column) -> Column:
    return reduce(
        lambda acc, pair: F.replace(acc, F.lit(pair[0]), F.lit(pair[1])), _ESCAPES, text
    )


def unescape_literal(text: Column) -> Column:
    """Inverse of :func:`escape_literal`; also reads ``\\uXXXX`` code points."""
    hold = "\u0000"
    out = F.replace(text, F.lit("\\\\"), F.lit(hold))
    pieces = F.split(out, r"(?=\\u[0-9A-Fa-f]{4})")
    decoded = F.transform(
        pieces,
        lambda t: F.when(
            t.rlike(r"^\\u[0-9A-Fa-f]{4}"),
            F.concat(
                F.decode(F.unhex(F.substring(t, 3, 4)), "UTF-16BE"),
                F.substring(t, 7, 2_000_000_000),
            ),
        ).otherwise(t),
    )
    out = F.when(out.contains("\\u"), F.array_join(decoded, "")).otherwise(out)
    for plain, escaped in _ESCAPES[1:]:
        out = F.replace(out, F.lit(escaped), F.lit(plain))
    return F.replace(out, F.lit(hold), F.lit("\\"))


def first_present(*columns: Column) -> Column:
    """First value that is neither null nor empty, else the empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


# Display names of the development levels by language.
LEVEL_LABELS = {
    "es": {"ALTO": "ALTO", "MEDIO": "MEDIO", "BAJO": "BAJO", "POPULAR": "POPULAR"},
    "en": {"ALTO": "HIGH", "MEDIO": "MEDIUM", "BAJO": "LOW", "POPULAR": "POPULAR"},
}


def translate_label(
    key: Column, lang: str, labels: dict[str, dict[str, str]] | None = None, fallback: str = "es"
) -> Column:
    """Label in ``lang``, else in the fallback language, else the raw value; dash if empty."""
    labels = labels or LEVEL_LABELS
    merged = {**labels.get(fallback, {}), **labels.get(lang, {})}
    entries = [F.lit(v) for item in merged.items() for v in item]
    found = F.try_element_at(F.create_map(*entries), F.upper(key)) if entries else F.lit(None)
    return F.when(is_present(key), F.coalesce(found, key)).otherwise(F.lit(MISSING_TEXT))


def fill_placeholders(template: Column, values: dict[str, Column]) -> Column:
    """Replace ``{name}`` by its value in one pass; unknown names stay as written."""
    entries = []
    for name, value in values.items():
        entries += [F.lit("{" + name + "}"), value.cast("string")]
    table = F.create_map(*entries)
    tokens = F.split(template, r"(?=\{\w+\})|(?<=\})")
    return F.array_join(
        F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), t)), ""
    )


def ellipsis(text: Column, n: int = 30) -> Column:
    """Text of at most ``n`` characters, the last one an ellipsis when shortened."""
    cut = F.rtrim(F.substring(text, 1, n - 1), F.lit(_SPACES))
    return F.when(F.length(text) > n, F.concat(cut, F.lit("…"))).otherwise(text)
