"""Field extraction from plain text.

A vocabulary says what stands before a field's value and what ends it; shapes say what a value looks like; patterns are composed of
both. A field compiles to one expression, so that extraction is a projection without a shuffle. extract() has candidates found by
leaps.py first; where it gives none, for texts of an unusual alphabet, the patterns are applied in full.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import leaps
from ..functions import dates, identifiers, numbers, text
from ..functions.identifiers import let
from ..schema import FIELD_TYPES, FIELDS, OWN, RUT_CONTEXT

# Words that stand before a value, as a label or in a sentence, and words that end it; hints of whose tax number it is.
LABELS = {
    "ppu": ("placa patente única", "placa patente", "patente única", "patente", "PPU"),
    "marca": ("marca",),
    "modelo": ("modelo",),
    "ano": ("año",),
    "razon_social": ("razón social", "R. social"),
    "giro": ("giro",),
    "domicilio": ("domicilio",),
    "nombre_representante": ("representante legal", "rep. legal"),
    "fecha_inicio": ("fecha de inicio", "inicio", "empieza el", "desde el", "a contar del"),
    "fecha_termino": ("fecha de término", "término", "termina el", "hasta el", "vence el"),
    "valor_cuota": ("renta mensual", "valor cuota", "canon mensual"),
    "numero_pagare": ("pagaré",),
}
ENDS = {
    "marca": ("modelo",),
    "modelo": ("año",),
    "razon_social": ("RUT", "R.U.T"),
    "giro": ("domicilio",),
    "domicilio": ("representante legal", "rep. legal"),
    "nombre_representante": ("C.I", "RUT", "cédula"),
}
SENTENCES = {
    "marca": (("vehículo",), ("modelo",)),
    "modelo": (("modelo",), ("fabricado",)),
    "razon_social": (("es",), ("RUT",)),
    "giro": (("dedicado a", "dedicada a"), ("con oficinas",)),
    "domicilio": (("con oficinas en",), ("que actúa",)),
    "nombre_representante": (("su representante",), ("cédula",)),
}
NUMBER_SIGNS = ("N°", "Nº", "Nro.", "número")
PERSON_HINTS = ("cedula", "c.i", "carnet", "rep. legal", "rep legal", "representante")
COMPANY_HINTS = ("rut emp", "rut empresa", "r.u.t", "rut")

#: Letters are spelled in both cases (letter()), so that characters of a text need not be folded.
_FLAGS = "(?U)"
#: The longest free text that is taken for a value.
LONGEST = 120
_MARKED = {"a": "aá", "e": "eé", "i": "ií", "o": "oó", "u": "uúü", "n": "nñ"}
#: Characters besides its two cases that are the same letter when case is folded.
_ALSO_FOLDED = {"i": "İı", "k": "\u212a", "s": "ſ"}


def letter(c: str, marked: bool = True) -> str:
    """A lower-case letter as a class of all characters that count as it in any case, with or without marks."""
    forms = _MARKED.get(c, c) if marked else c
    return f"[{forms}{forms.upper()}{_ALSO_FOLDED.get(c, '')}]" if c.isalpha() else re.escape(c)


def spelling(words: str) -> str:
    """A phrase as a pattern: any white space between words, letters with or without marks, full stops or none."""
    return "".join(r"\s+" if c == " " else r"\.?" if c == "." else letter(c) for c in text.bare(words).lower())


def any_of(phrases: tuple[str, ...]) -> str:
    return f"(?:{'|'.join(map(spelling, phrases))})"


def ahead(phrases: tuple[str, ...]) -> str:
    """Looks for the first letter of a phrase, so that most places of a text cost one comparison."""
    first = "".join(dict.fromkeys(c for p in phrases for c in letter(text.bare(p).lower()[0])[1:-1]))
    return f"(?=[{first}])"


def labelled(field: str, shape: str, between: str = "") -> str:
    """A shape right behind one of the field's labels."""
    return rf"{ahead(LABELS[field])}{any_of(LABELS[field])}\s*:?\s*{between}({shape})"


def behind_label(field: str, shape: str) -> str:
    """The same for shapes that begin with a digit and labels that begin with many letters: the shape is looked for first, then the
    label before it. White space is single in a collapsed text."""
    label = any_of(LABELS[field]).replace(r"\s+", r"\s")
    return rf"(?={shape})(?<={label}\s?:?\s?)({shape})"


def up_to_end(field: str) -> str:
    """Free text between a label of the field and a word that ends it; what a vehicle is called holds no comma."""
    inside = "[^,]" if field in ("marca", "modelo") else "."
    return rf"{ahead(LABELS[field])}\b{any_of(LABELS[field])}\s*:?\s+(\S{inside}{{0,{LONGEST}}}?)\s+{any_of(ENDS[field])}\b"


def in_sentence(field: str) -> str:
    """Free text between the words before it and, after a comma, those that follow."""
    before, after = SENTENCES[field]
    return rf"{ahead(before)}\b{any_of(before)}\s+(\S.{{0,{LONGEST}}}?)\s*,\s*{any_of(after)}\b"


# Shapes of values.
PLATE = r"\p{L}{4}\s?[·.-]?\s?\d\d(?!\w)"
YEAR = r"(?:19|20)\d\d(?!\d)"
DAY = r"\d{1,2}\s*[./-]\s*\d{1,2}\s*[./-]\s*\d{4}"
_DE = letter("d", False) + letter("e", False)
DAY_IN_WORDS = rf"\d{{1,2}}\s+{_DE}\s+\p{{L}}+\s+{_DE}{letter('l', False)}?\s+\d{{4}}"
AMOUNT = rf"\$?\s*{numbers.GROUPED}"
MONTHS = rf"(?=\d)(?<!\w)(\d{{1,3}})\s*{spelling('meses')}\b"
NOTE = r"\d{4,}"


@dataclass(frozen=True)
class Rule:
    patterns: tuple[str, ...]
    canon: Callable[[Column], Column]
    own: bool = False


def _free(field: str, own: bool = False) -> Rule:
    return Rule((up_to_end(field), in_sentence(field)), text.clean, own)


def _date(field: str) -> Rule:
    return Rule((behind_label(field, DAY), behind_label(field, DAY_IN_WORDS)), dates.parse_date)


#: Patterns of a field in order of preference, its canonical form, and whether the own party's value is passed over.
RULES = {
    "ppu": Rule((labelled("ppu", PLATE),), identifiers.checked_plate),
    "marca": _free("marca"),
    "modelo": _free("modelo"),
    "ano": Rule((labelled("ano", YEAR),), numbers.parse_int),
    "razon_social": _free("razon_social", own=True),
    "giro": _free("giro", own=True),
    "domicilio": _free("domicilio", own=True),
    "nombre_representante": _free("nombre_representante", own=True),
    "fecha_inicio": _date("fecha_inicio"),
    "fecha_termino": _date("fecha_termino"),
    "plazo_meses": Rule((MONTHS,), numbers.parse_int),
    "valor_cuota": Rule((labelled("valor_cuota", AMOUNT, rf"(?:{_DE}\s+)?"), rf"{spelling('pesos')}\s*\(\s*({AMOUNT})\s*\)"), numbers.parse_money),
    "numero_pagare": Rule((labelled("numero_pagare", NOTE, rf"(?:{any_of(NUMBER_SIGNS)}\s*:?\s*)?"),), text.clean),
}

#: A tax number in running text: seven digits or more, or groups of three after the first group, then a dash and the check sign.
RUT_TOKEN = r"(?U)(?=\d)(?<!\w)(?:\d{7,9}|\d{1,3}(?:[.\s]\d{3}){1,3})\s*[—-]\s*[\dKk](?!\w)"
#: Its longest body and a blank.
RUT_LONGEST = 16


def _finders() -> dict[str, leaps.Finder]:
    """The finder of each pattern, named by field and number."""
    out = {}
    for name, rule in RULES.items():
        if name in SENTENCES:
            made = [leaps.from_words(rule.patterns[0], LABELS[name]), leaps.from_words(rule.patterns[1], SENTENCES[name][0])]
        elif rule.canon is dates.parse_date:
            made = [leaps.behind_words(shape, LABELS[name]) for shape in (DAY, DAY_IN_WORDS)]
        elif name == "plazo_meses":
            made = [leaps.number_before(MONTHS, "meses")]
        else:
            made = [leaps.from_words(p, words) for p, words in zip(rule.patterns, (LABELS[name], ("pesos",)))]
        out |= {_finder(name, k): f for k, f in enumerate(made)}
    tokens = leaps.tokens_by_dash(RUT_TOKEN.removeprefix(_FLAGS), RUT_LONGEST)
    return out | {"ruts": leaps.by_context(tokens, RUT_CONTEXT, {"person": _hint(PERSON_HINTS), "company": _hint(COMPANY_HINTS)})}


def _finder(name: str, k: int) -> str:
    return f"{name}_{k}"


_TEXTS = T.ArrayType(T.StringType())
_TOKENS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("token", T.StringType())]))


def found(x: Column, fields: tuple[str, ...] = FIELDS) -> Column:
    """struct of candidates by pattern, and ruts, of a collapsed text as leaps.py finds them."""
    names = [_finder(f, k) for f in fields if f in RULES for k in range(len(RULES[f].patterns))]
    wanted = {n: _TEXTS for n in names} | ({"ruts": _TOKENS} if set(fields) - set(RULES) else {})
    made = _finders()
    return leaps.finder(x, {n: (made[n], kind) for n, kind in wanted.items()}, leaps.folding(letter))


def tokens_found(x: Column, leapt: Column) -> Column:
    """rut_tokens() of a text by what found() gives for it."""
    return F.coalesce(leapt["ruts"], rut_tokens(x))


def candidates_found(name: str, x: Column, leapt: Column) -> Column:
    """candidates() of all patterns of a field by what found() gives for the text."""
    patterns = RULES[name].patterns
    return F.coalesce(F.array_distinct(F.concat(*[leapt[_finder(name, k)] for k in range(len(patterns))])), candidates(x, patterns))


def candidates(x: Column, patterns: tuple[str, ...]) -> Column:
    """Everything the patterns capture, pattern by pattern, first occurrences only."""
    found = [F.regexp_extract_all(x, F.lit(_FLAGS + p), F.lit(1)) for p in patterns]
    return F.array_distinct(F.concat(*found) if len(found) > 1 else found[0])


def choose(found: Column, canon: Callable[[Column], Column], own: str | None = None) -> Column:
    """The first candidate with a canonical form that isn't the own party's; null if there is none."""
    forms = F.transform(found, canon)
    if own is None:
        return F.get(F.filter(forms, lambda v: v.isNotNull() & (v.cast("string") != "")), 0)
    same = text.lax(F.lit(own))
    return F.get(F.filter(forms, lambda v: v.isNotNull() & (v != "") & (text.lax(v) != same)), 0)


#: As many tokens, each of seven characters at least, always fill a context.
_BEFORE = -(-RUT_CONTEXT // 7)


def rut_tokens(x: Column) -> Column:
    """array of struct(kind: company, person or null; token), in order, by what stands in the RUT_CONTEXT characters before a token;
    person hints are looked for first. A context is put together from the gap before the token and a bounded number of gaps and tokens
    before that, so the work is linear in tokens."""
    gaps, tokens = F.split(x, RUT_TOKEN), F.regexp_extract_all(x, F.lit(RUT_TOKEN), F.lit(0))

    def classify(pairs: Column, p: Column, i: Column) -> Column:
        n = F.least(i, F.lit(_BEFORE))
        before = F.array_join(F.transform(F.slice(pairs, i - n + 1, n), lambda q: F.concat(q["gap"], q["token"])), "")
        context = F.when(F.length(p["gap"]) >= RUT_CONTEXT, p["gap"]).otherwise(F.concat(before, p["gap"]))
        near = let(context, lambda t: F.lower(text.strip_accents(F.right(t, F.lit(RUT_CONTEXT)))))
        kind = let(near, lambda t: F.when(t.rlike(_hint(PERSON_HINTS)), "person").when(t.rlike(_hint(COMPANY_HINTS)), "company"))
        return F.struct(kind.alias("kind"), p["token"].alias("token"))

    placed = let(F.arrays_zip(gaps.alias("gap"), tokens.alias("token")), lambda pairs: F.transform(pairs, lambda p, i: classify(pairs, p, i)))
    return F.filter(placed, lambda p: p["token"].isNotNull())


def _hint(words: tuple[str, ...]) -> str:
    return "|".join(re.escape(w) for w in words)


def ruts_of(tokens: Column, kind: str) -> Column:
    """Tokens of a kind, in order."""
    return F.transform(F.filter(tokens, lambda p: p["kind"] == kind), lambda p: p["token"])


def field(name: str, x: Column, ruts: Column | None = None, repair: Column | bool = False, leapt: Column | None = None) -> Column:
    """One field of a collapsed text, null if it isn't found. repair: whether a text was recognised, so that letters that recognition
    puts for digits of a tax number are read as those. leapt: what found() gives for the text."""
    if name in ("rut_empresa", "rut_representante"):
        found = ruts_of(rut_tokens(x) if ruts is None else ruts, "company" if name == "rut_empresa" else "person")
        read = lambda fix: choose(found, lambda v: identifiers.checked_rut(v, fix), OWN[name])
        return read(repair) if isinstance(repair, bool) else F.when(repair, read(True)).otherwise(read(False))
    rule = RULES[name]
    own = OWN[name] if rule.own else None
    # Pattern by pattern: a text is searched for the next one only if none of this one's candidates will do.
    tried = [candidates(x, (p,)) for p in rule.patterns]
    if leapt is not None:
        tried = [F.coalesce(leapt[_finder(name, k)], c) for k, c in enumerate(tried)]
    return F.coalesce(*[choose(c, rule.canon, own) for c in tried]).cast(FIELD_TYPES[name])


def extract(docs: DataFrame, text_col: str = "texto", fields: tuple[str, ...] = FIELDS, repair: Column | bool = False) -> DataFrame:
    """docs with a typed column for each field (null: not read). The text is collapsed first, as every source does; classified
    tax numbers are computed once."""
    x, ruts, leapt = "_collapsed", "_ruts", "_found"
    out = docs.withColumn(x, text.collapse(F.col(text_col)))
    out = out.withColumn(leapt, found(F.col(x), fields))
    if {"rut_empresa", "rut_representante"} & set(fields):
        out = out.withColumn(ruts, tokens_found(F.col(x), F.col(leapt)))
    return out.withColumns({f: field(f, F.col(x), F.col(ruts), repair, F.col(leapt)) for f in fields}).drop(x, ruts, leapt)


def campos(fields: tuple[str, ...] = FIELDS) -> Column:
    """The fields as the map of a record: text, empty for what wasn't read."""
    # Of create_map Spark takes single values out, so that a query which asks for some fields doesn't pay for the others.
    return F.create_map(*[c for f in fields for c in (F.lit(f), F.coalesce(F.col(f).cast("string"), F.lit("")))])


NATIVE = "nativo"


def predictions(docs: DataFrame, text_col: str = "texto", metodo: str = NATIVE, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """docs (ord, id_documento, texto, and where they are known path, metodo, segundos) -> prediction records. Texts that weren't
    embedded in their file are read with repair. A query that needs some fields names them, and others aren't searched. segundos is what the source took, 0 if it wasn't measured: extraction itself is
    part of one plan and has no time of its own."""
    optional = {"metodo": F.lit(metodo), "path": F.concat("id_documento", F.lit(".pdf")), "segundos": F.lit(0.0)}
    rows = docs.select("ord", "id_documento", text_col, *[(F.col(c) if c in docs.columns else v).alias(c) for c, v in optional.items()])
    read = extract(rows, text_col, fields, F.col("metodo") != NATIVE if "metodo" in docs.columns else metodo != NATIVE)
    return read.select(
        "ord", "id_documento", F.substring_index("path", "/", -1).alias("origen"), "metodo", F.round("segundos", 4).alias("segundos"),
        F.length(text.collapse(F.col(text_col))).alias("caracteres"), campos(fields).alias("campos"),
    )
