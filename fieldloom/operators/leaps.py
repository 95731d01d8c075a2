"""Candidates of fields in plain texts, from one place where a value can stand to the next.

A pattern of extract.py is tried at every character of a text; here only at the places where one of its words is found. A plain text has
one byte for each character, of an alphabet on which the classes of Java's and of Python's patterns agree; for any other text the finders
give null, and extract.py applies its patterns in full."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text

ENCODING = "latin-1"
_LETTERS = "".join(chr(i) for i in range(0xC0, 0x100) if chr(i) not in "×÷")
#: Printed ASCII with blanks, and what of Latin-1 is letter or sign to both; collapsed texts have no other white space.
ALPHABET = "".join(map(chr, range(0x20, 0x7F))) + "¡¢£¤¥¦§¨©«¬®¯°±´¶·¸»¿ºª×÷" + _LETTERS
_PLAIN = ALPHABET.encode(ENCODING)
#: \p{L} of that alphabet, for Python's patterns.
_LETTER = f"[a-zA-Zªº{_LETTERS}]"

Finder = Callable[[str, bytes], list[str]]


def _table(pairs: dict[str, str]) -> bytes:
    return bytes(ord(pairs.get(c := chr(i), c)) for i in range(256))


def folding(letter: Callable[[str], str]) -> bytes:
    """A table that puts letters for all that count as them; letter(c) is their class as a pattern."""
    return _table({c: k for k in "abcdefghijklmnopqrstuvwxyz" for c in letter(k)[1:-1] if ord(c) < 256})


#: What strip_accents and lower case make of the characters.
_HINTS = _table({c: (dict(zip(text.LATIN_FROM, text.LATIN_TO)).get(c, c)).lower() for c in ALPHABET})


def compiled(pattern: str) -> re.Pattern:
    return re.compile(pattern.replace(r"\p{L}", _LETTER))


def _forms(phrases: tuple[str, ...]) -> list[bytes]:
    """Folded spellings of phrases, full stops or none; of those that begin with another one only that."""
    out: set[str] = set()
    for phrase in phrases:
        some = [""]
        for c in text.bare(phrase).lower():
            some = [s + d for s in some for d in ((c, "") if c == "." else (c,))]
        out.update(some)
    return sorted(f.encode(ENCODING) for f in out)


def places(folded: bytes, forms: list[bytes], ends: bool = False) -> list[int]:
    """Where forms begin, or end, in order."""
    out = []
    for form in forms:
        at = folded.find(form)
        while at >= 0:
            out.append(at + len(form) if ends else at)
            at = folded.find(form, at + 1)
    return sorted(set(out)) if len(forms) > 1 else out


def _taken(x: str, starts: list[int], match: Callable[[str, int], re.Match | None]) -> list[str]:
    """Group 1 of the leftmost matches that don't overlap, first occurrences only."""
    out, free = [], 0
    for at in starts:
        if at >= free and (m := match(x, at)):
            out.append(m[1])
            free = max(m.end(), at + 1)
    return list(dict.fromkeys(out)) if len(out) > 1 else out


def from_words(pattern: str, phrases: tuple[str, ...]) -> Finder:
    """A pattern that begins with one of the phrases."""
    match, all_forms = compiled(pattern).match, _forms(phrases)
    forms = [f for f in all_forms if not any(f != g and f.startswith(g) for g in all_forms)]
    return lambda x, folded: _taken(x, places(folded, forms), match)


def behind_words(shape: str, phrases: tuple[str, ...]) -> Finder:
    """A shape that begins with a digit, behind one of the phrases: a match is the shape alone."""
    match, forms = compiled(rf"\s?:?\s?({shape})").match, _forms(phrases)

    def find(x: str, folded: bytes) -> list[str]:
        found = [m for at in places(folded, forms, ends=True) if (m := match(x, at))]
        at = {m.start(1): m for m in found}
        return _taken(x, sorted(at), lambda _, k: at[k])

    return find


def number_before(pattern: str, word: str) -> Finder:
    """A pattern of up to three digits, none but a blank after them, and a word."""
    match, forms = compiled(pattern).match, _forms((word,))

    def start(folded: bytes, at: int) -> int:
        at -= folded[at - 1 : at] == b" "
        return at - len(folded[max(0, at - 3) : at]) + len(folded[max(0, at - 3) : at].rstrip(b"0123456789"))

    return lambda x, folded: _taken(x, [start(folded, at) for at in places(folded, forms)], match)


def tokens_by_dash(pattern: str, longest: int) -> Callable[[str, bytes], Iterator[re.Match]]:
    """Matches of a pattern of at most so many characters before its dash, and a blank and a sign after it."""
    search = compiled(pattern).search

    def find(x: str, folded: bytes) -> Iterator[re.Match]:
        free = 0
        for at in places(folded, [b"-"]):
            if at >= free and (m := search(x, max(free, at - longest), at + 4)):
                free = m.end()
                yield m

    return find


def by_context(matches: Callable[[str, bytes], Iterator[re.Match]], width: int, hints: dict[str, str]) -> Callable[[str, bytes], list[dict]]:
    """Tokens with their kind: the first of hints (kind: pattern) that is found in so many characters before a token."""
    kinds = [(kind, re.compile(pattern.encode(ENCODING)).search) for kind, pattern in hints.items()]

    def find(x: str, folded: bytes) -> list[dict]:
        out = []
        for m in matches(x, folded):
            near = x[max(0, m.start() - width) : m.start()].encode(ENCODING).translate(_HINTS)
            out.append({"kind": next((kind for kind, search in kinds if search(near)), None), "token": m[0]})
        return out

    return find


def finder(x: Column, finders: dict[str, tuple[Finder, T.DataType]], fold: bytes) -> Column:
    """struct with what each finder gives for a collapsed text: null, all of them, if the text isn't plain."""
    kinds = T.StructType([T.StructField(name, kind) for name, (_, kind) in finders.items()])
    arrow = {T.ArrayType(T.StringType()): pa.list_(pa.string())}
    types = [arrow.get(kind) or pa.list_(pa.struct([("kind", pa.string()), ("token", pa.string())])) for _, kind in finders.values()]
    each = [f for f, _ in finders.values()]

    @F.arrow_udf(kinds)
    def run(texts: pa.Array) -> pa.Array:
        columns: list[list] = [[] for _ in each]
        for x in texts.to_pylist():
            try:
                folded = x.encode(ENCODING)
                plain = not folded.translate(None, _PLAIN)
            except UnicodeEncodeError:
                plain = False
            if plain:
                folded = folded.translate(fold)
            for out, find in zip(columns, each):
                out.append(find(x, folded) if plain else None)
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], fields=[pa.field(n, t) for n, t in zip(finders, types)])

    return run(x)
