"""The contracts of synth.py and their texts in DuckDB's SQL, for checking queries on another engine."""

from __future__ import annotations

import re

from .. import schema as S
from ..functions import numbers as N
from .render import LAYOUTS


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def words(values) -> str:
    return "[" + ", ".join(text(v) if isinstance(v, str) else str(v) for v in values) + "]"


def pick(values, nth: str) -> str:
    return f"{words(values)}[(({nth}) % {len(values)} + 1)::INT]"


def check_digit(body: str) -> str:
    """Over a text of digits."""
    total = f"list_sum([substr(reverse({body}), k::INT, 1)::INT * (2 + (k - 1) % 6) FOR k IN range(1, length({body}) + 1)])"
    return f"substr('0123456789K', ((11 - {total} % 11) % 11 + 1)::INT, 1)"


def dotted(n: str) -> str:
    return f"replace(printf('%,d', ({n})::BIGINT), ',', '.')"


def rut(body: str) -> str:
    return f"{dotted(body)} || '-' || {check_digit(f'({body})::VARCHAR')}"


def number_words(n: str) -> str:
    """Hundreds, tens and units are looked up one by one, not in the table that the other engine uses."""
    def below_1000(x: str) -> str:
        ten = f"CASE WHEN ({x}) % 100 < 30 THEN {words(N.BELOW_30)}[(({x}) % 100 + 1)::INT] ELSE concat_ws(' y ', {words(N.TENS)}[(({x}) % 100 // 10 - 2)::INT], CASE WHEN ({x}) % 10 > 0 THEN {words(N.BELOW_30)}[(({x}) % 10 + 1)::INT] END) END"
        return f"CASE WHEN ({x}) = 100 THEN 'cien' ELSE concat_ws(' ', CASE WHEN ({x}) >= 100 THEN {words(N.HUNDREDS)}[(({x}) // 100)::INT] END, CASE WHEN ({x}) % 100 > 0 OR ({x}) = 0 THEN {ten} END) END"

    many = f"regexp_replace(regexp_replace({below_1000(f'({n}) // 1000')}, 'veintiuno$', 'veintiún'), 'uno$', 'un')"
    head = f"CASE WHEN ({n}) >= 2000 THEN {many} || ' mil' WHEN ({n}) >= 1000 THEN 'mil' END"
    return f"concat_ws(' ', {head}, CASE WHEN ({n}) % 1000 > 0 OR ({n}) = 0 THEN {below_1000(f'({n}) % 1000')} END)"


def draw(k: int, *keys: str) -> str:
    return f"(('0x' || substr(md5({" || '|' || ".join(f"({x})::VARCHAR" for x in keys)}), 1, 15))::BIGINT % {k})"


def drawn(n: int, seed: int) -> str:
    """A SELECT with the columns of synth.drawn(n, seed, profile=mixto)."""
    own = lambda what, k: draw(k, str(seed), "id", f"'{what}'")
    layout, low = "CASE", 0.0
    for name, share in S.LAYOUTS.items():
        low += share
        layout += f" WHEN {own('layout', 1_000_000)} < {round(low * 1_000_000)} THEN '{name}'"
    keys = f"SELECT id, {own('contract', 1_749_600)} AS i, {own('company', 999_998)} AS c FROM range({n}) r(id)"
    replaced = f"id + 1 AS ord, printf('SINT-%04d', id + 1) AS id_documento, {layout} END AS plantilla, {pick(tuple(S.PROFILES), own('profile', 3))} AS perfil_escaneo"
    return f"SELECT * EXCLUDE (id) REPLACE ({replaced}) FROM ({contracts(keys).replace('SELECT i + 1 AS ord', 'SELECT id, i + 1 AS ord', 1)})"


def contracts(keys: str = "SELECT o_orderkey AS i, o_custkey AS c FROM orders") -> str:
    """A SELECT with the columns of synth.contracts over keys (i, c), fields typed."""
    brands = tuple(S.BRANDS)
    models = "[" + ", ".join(words(S.BRANDS[b]) for b in brands) + "]"
    first = f"((i // 7) % {len(S.SURNAMES)})"
    term = pick(S.TERMS, "i")
    start = f"(DATE '{S.START_MIN}' + (i % 1642)::INT)"
    return f"""SELECT i + 1 AS ord, printf('SINT-%04d', i + 1) AS id_documento,
    CASE WHEN i % 10 < 4 THEN 'formal' WHEN i % 10 < 7 THEN 'tabular' ELSE 'compacta' END AS plantilla,
    {pick((S.NO_PROFILE, *S.PROFILES), "i // 10")} AS perfil_escaneo, {pick(S.CITIES, "i")} AS ciudad,
    {pick(S.PLATE_FIRST_LETTERS, "i")} || {pick(S.PLATE_LETTERS, "i // 3")} || {pick(S.PLATE_LETTERS, "i // 54")} || {pick(S.PLATE_LETTERS, "i // 972")}
        || lpad((i % 100)::VARCHAR, 2, '0') AS ppu,
    {pick(brands, "i")} AS marca, {models}[(i % {len(brands)} + 1)::INT][((i // {len(brands)}) % 3 + 1)::INT] AS modelo, ({S.FIRST_YEAR} + i % 10)::INT AS ano,
    {pick(S.COMPANY_CORES, "c")} || ' ' || {pick(S.COMPANY_TRADES, "c // 16")} || ' ' || {pick(S.COMPANY_SUFFIXES, "c")} AS razon_social,
    {rut(f"{S.RUT_COMPANY_FIRST + 2} + (c * 7919 + 13) % 999998")} AS rut_empresa, {pick(S.TRADES, "c * 3 + 1")} AS giro,
    {pick(S.STREET_TYPES, "c")} || ' ' || {pick(S.STREETS, "c // 3")} || ' ' || (100 + (c * 37) % 9900)::VARCHAR
        || CASE WHEN c % 20 < 7 THEN ', oficina ' || (2 + c % 179)::VARCHAR ELSE '' END || ', ' || {pick(S.COMMUNES, "c * 7")} AS domicilio,
    {pick(S.FIRST_NAMES, "i * 5 + 1")} || ' ' || {pick(S.SURNAMES, first)} || ' ' || {pick(S.SURNAMES, f"{first} + 1 + (i // 3) % {len(S.SURNAMES) - 1}")} AS nombre_representante,
    {rut(f"{S.RUT_PERSON_FIRST + 2} + (i * 104729 + 7) % 9999998")} AS rut_representante,
    strftime({start}, '%Y-%m-%d') AS fecha_inicio, strftime({start} + to_months(({term})::INT), '%Y-%m-%d') AS fecha_termino, ({term})::INT AS plazo_meses,
    ({S.FEE_MIN} + (i % 155) * {S.FEE_STEP})::BIGINT AS valor_cuota, ({S.NOTE_MIN} + (i * 31) % 900000)::VARCHAR AS numero_pagare
FROM ({keys})"""


def with_contracts(query: str) -> str:
    return f"WITH t AS ({contracts()}) {query}"


def in_words(day: str) -> str:
    return f"day({day})::VARCHAR || ' de ' || {words(S.MONTHS)}[month({day})::INT] || ' de ' || year({day})::VARCHAR"


def rendered(layout: str) -> str:
    """The layout's text over the columns of contracts()."""
    start, end = "fecha_inicio::DATE", "fecha_termino::DATE"
    plate = lambda mark: f"substr(ppu, 1, 4) || '{mark}' || substr(ppu, 5)"
    digits = lambda day, mark: f"strftime({day}, '%d{mark}%m{mark}%Y')"
    money = f"'$' || {dotted('valor_cuota')}"
    printed = {
        "formal": {"start": in_words(start), "end": in_words(end), "amount": f"{number_words('valor_cuota')} || ' pesos (' || {money} || ')'", "plate": plate("·")},
        "tabular": {"start": digits(start, "/"), "end": digits(end, "/"), "amount": money, "plate": plate("-")},
        "compacta": {"start": digits(start, "-"), "end": digits(end, "-"), "amount": f"{money} || '.-'", "plate": "ppu"},
    }[layout]
    own = {f"own_{k}": text(v) for k, v in S.OWN.items()}
    parts = []
    for literal, name in re.findall(r"([^{}]*)(?:\{(\w+)\})?", LAYOUTS[layout]):
        if literal:
            parts.append(text(literal))
        if name:
            parts.append(f"({(own | printed).get(name, f'{name}::VARCHAR')})")
    return " || ".join(parts)


def any_rendered() -> str:
    """The text of whichever layout a contract has."""
    return "CASE plantilla " + " ".join(f"WHEN '{name}' THEN {rendered(name)}" for name in LAYOUTS) + " END"
