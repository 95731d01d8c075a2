"""Text expressions."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Python's str.split() has it: Unicode white space and U+001C to U+001F.
SPACES = r"(?U)[\s\x1c-\x1f]+"
#: The same without single blanks, which stay as they are; a place that holds a printed ASCII character costs one comparison.
_ODD_SPACES = r"(?U)(?=[^!-~])(?: [\s\x1c-\x1f]+|[\s\x1c-\x1f&&[^ ]][\s\x1c-\x1f]*)"
#: Printed ASCII, blanks and Latin letters one by one: a class of single characters of one byte is the fastest that there is.
_USUAL = "\\A(?>[" + "".join(f"\\x{i:02x}" for i in (*range(0x20, 0x7F), *range(0xA1, 0x100))) + "]*)\\z"
#: Edges that a cleaned text loses.
EDGES = " ,;:|-"


def collapse(x: Column) -> Column:
    """Runs of white space become one space, edges are trimmed, null becomes empty. Texts of usual characters with single blanks stay
    as they are."""
    done = x.rlike(_USUAL) & ~x.contains("  ") & ~x.startswith(" ") & ~x.endswith(" ")
    return F.when(done, x).otherwise(F.btrim(F.regexp_replace(F.coalesce(x, F.lit("")), _ODD_SPACES, " ")))


def clean(x: Column) -> Column:
    """Collapsed, without loose punctuation at the edges."""
    return F.btrim(collapse(x), F.lit(EDGES))


def useful(x: Column, least: int = 200) -> Column:
    """Whether an embedded text is long enough to be used."""
    return F.length(F.coalesce(x, F.lit(""))) >= least


def bare(c: str) -> str:
    """A text without marks, in Python."""
    return "".join(d for d in unicodedata.normalize("NFKD", c) if not unicodedata.combining(d))


def _latin() -> tuple[str, str]:
    """Latin letters that decompose to one other character, and those; combining marks come last, to be deleted."""
    ranges = [range(0xAA, 0x250), range(0x1E00, 0x1F00)]
    pairs = [(chr(i), bare(chr(i))) for r in ranges for i in r]
    pairs = [(a, b) for a, b in pairs if a != b and len(b) == 1]
    marks = "".join(chr(i) for i in range(0x300, 0x370) if unicodedata.combining(chr(i)))
    return "".join(a for a, _ in pairs) + marks, "".join(b for _, b in pairs)


LATIN_FROM, LATIN_TO = _latin()


def strip_accents(x: Column) -> Column:
    """Compatibility decomposition without combining marks, for Latin letters, in the JVM."""
    return F.translate(F.coalesce(x, F.lit("")), LATIN_FROM, LATIN_TO)


@F.arrow_udf(T.StringType())
def strip_accents_any(x: pa.Array) -> pa.Array:
    """The same for every script."""
    return pa.array([bare(s or "") for s in x.to_pylist()], pa.string())


def lax(x: Column) -> Column:
    """Form in which two texts count as the same: no accents, lower case, letters and digits only."""
    return F.regexp_replace(F.lower(strip_accents(x)), "[^a-z0-9]", "")


@F.arrow_udf(T.DoubleType())
def similarity(expected: pa.Array, got: pa.Array) -> pa.Array:
    """Ratcliff-Obershelp ratio, rounded to 4 places. Null if either side is null, so that callers can spare rows."""
    out = []
    for a, b in zip(expected.to_pylist(), got.to_pylist(), strict=True):
        out.append(None if a is None or b is None else round(SequenceMatcher(None, a, b).ratio(), 4))
    return pa.array(out, pa.float64())


def ellipsis(x: Column, width: int = 46) -> Column:
    x = F.when(F.coalesce(x, F.lit("")) == "", "(vacio)").otherwise(x)
    return F.when(F.length(x) > width, F.concat(F.substring(x, 1, width - 1), F.lit("…"))).otherwise(x)


def percent(x: Column) -> Column:
    return F.format_string("%6.1f%%", x * 100)
