"""Quality rule on repetition by a suffix array over words.

Suffixes of all texts of a batch are sorted by prefix doubling (only suffixes that still tie are sorted again; texts never
mix, as ranks start from the pair of text and word). The common prefix of neighbours in the array comes from the ranks of the
doubling steps. The deepest LCP interval that holds a suffix is the longer of its two common prefixes: that is the longest
repeated substring starting there, and maximal repeats are such intervals that can't be extended to the left. The union of
their spans, from min_words words on, gives the covered fraction; the deepest interval of all gives the longest repeat.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, lean, pick, small_batches

#: Production parameters. A repeat is a substring of at least MIN_WORDS words that the text holds twice or more (overlaps count).
MIN_WORDS = 8
MAX_COVERED_PERCENT = 40
MAX_REPEAT_WORDS = 150
#: Words per suffix array; one text may exceed it and then has its own.
BLOCK_WORDS = 200_000

_FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat"]
SCHEMA = ", ".join(f"{f} long" for f in _FIELDS)


def deepest_repeats(word: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each position the length in words of the longest substring that starts there and occurs elsewhere in the same text.
    word: ids; text: non-decreasing ids of texts."""
    n = len(word)
    if not n:
        return np.zeros(0, np.int64)
    end = np.searchsorted(text, text, side="right")  # where each position's text ends
    key = text.astype(np.int64) * (int(word.max()) + 1) + word
    suffixes = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)

    def regroup(slots: np.ndarray, members: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Rank = first slot of the run of equals; returns which members still tie."""
        start = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        rank[members] = start
        return np.append(~new[1:], False) | ~new

    sorted_key = key[suffixes]
    new = np.ones(n, bool)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    tied = regroup(np.arange(n), suffixes, new)
    slots, active = np.flatnonzero(tied), suffixes[tied]
    steps, h = [rank.copy()], 1
    while len(active):
        ahead = active + h
        follow = np.where(ahead < end[active], rank[np.minimum(ahead, n - 1)] + 1, 0)
        first = rank[active]
        order = np.lexsort((follow, first))
        active, first, follow = active[order], first[order], follow[order]
        suffixes[slots] = active
        new = np.ones(len(active), bool)
        new[1:] = (first[1:] != first[:-1]) | (follow[1:] != follow[:-1])
        tied = regroup(slots, active, new)
        slots, active = slots[tied], active[tied]
        h *= 2
        steps.append(rank.copy())
    a, b = suffixes[:-1], suffixes[1:]
    near = np.flatnonzero(steps[0][a] == steps[0][b])
    a, b = a[near], b[near]
    common = np.zeros(len(near), np.int64)
    for k in range(len(steps) - 1, -1, -1):
        x, y = a + common, b + common
        inside = (x < end[a]) & (y < end[b])
        same = inside & (steps[k][np.minimum(x, n - 1)] == steps[k][np.minimum(y, n - 1)])
        common += same * (1 << k)
    lcp = np.zeros(n + 1, np.int64)  # lcp[i]: of the suffixes in slots i - 1 and i
    lcp[near + 1] = common
    deepest = np.empty(n, np.int64)
    deepest[suffixes] = np.maximum(lcp[:-1], lcp[1:])
    return deepest


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Mask of the positions in the union of spans [start, end)."""
    reach = np.zeros(n, np.int64)
    reach[starts] = ends
    return np.maximum.accumulate(reach) > np.arange(n) if n else np.zeros(0, bool)


def _block(texts: list[list[bytes]], min_words: int) -> list[tuple[int, int, int]]:
    """For each text (its words): repeated words in 3-word windows, words in long repeats, longest repeat."""
    sizes = np.array([len(t) for t in texts])
    ids: defaultdict[bytes, int] = defaultdict(count().__next__)
    flat = np.array([ids[w] for t in texts for w in t], np.int64)
    of = np.repeat(np.arange(len(texts)), sizes)
    deepest = deepest_repeats(flat, of)
    n = len(flat)
    three = np.flatnonzero(deepest >= 3)
    long_ = np.flatnonzero(deepest >= min_words)
    marks = [covered(three, three + 3, n), covered(long_, long_ + deepest[long_], n)]
    sums = [np.bincount(of, weights=m, minlength=len(texts)).astype(int).tolist() for m in marks]
    longest = np.zeros(len(texts), np.int64)
    np.maximum.at(longest, of, deepest)
    return list(zip(*sums, longest.tolist(), strict=True))


def measure(texts: list[str | None], min_words: int = MIN_WORDS) -> list[tuple[int, ...]]:
    """The fields of SCHEMA for each text."""
    out, pending, size = [], [], 0

    def flush() -> None:
        nonlocal pending, size
        out.extend(base + more for (base, _), more in zip(pending, _block([w for _, w in pending], min_words) if pending else [], strict=True))
        pending, size = [], 0

    for text in texts:
        raw = (text or "").encode()
        words = raw.split()
        squeezed = raw.translate(None, b" \t\n\r\x0b\x0c")
        lines = [x for x in raw.split(b"\n") if x.strip()] if b"\n" in raw else []
        base = (len(words), len(squeezed.decode()), len(raw) - len(raw.translate(None, b"#*$%&|<>")), len(lines) - len(set(lines)))
        if size and size + len(words) > BLOCK_WORDS:
            flush()
        pending.append((base, words))
        size += len(words)
    flush()
    return out


def repetition(text: Column, min_words: int = MIN_WORDS) -> Column:
    """struct of SCHEMA for a text column."""

    @F.arrow_udf(SCHEMA)
    @lean("repetition")
    def f(texts: pa.Array) -> pa.Array:
        rows = measure(texts.to_pylist(), min_words)
        return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(_FIELDS))], _FIELDS)

    return f(text)


def base_failed(x: Column) -> Column:
    return (x["n_words"] < 50) | (100 * x["n_repeat_words"] > 50 * x["n_words"])


def kept(x: Column, max_percent: int = MAX_COVERED_PERCENT, max_repeat: int = MAX_REPEAT_WORDS) -> Column:
    return ~base_failed(x) & (100 * x["covered_words"] <= max_percent * x["n_words"]) & (x["longest_repeat"] <= max_repeat)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, the fields of SCHEMA, base_failed and kept.

    Edge cases: a null or empty text has no words, so base_failed is true; repeated rows, null ids and ties stay as they are; an
    empty table gives an empty one; other columns are left out whatever their names; texts of any length are measured whole."""
    small_batches(docs.sparkSession)
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").select("doc_id", repetition(F.col("text")).alias("x"))
    return rows.select("doc_id", *[f"x.{f}" for f in _FIELDS], base_failed(F.col("x")).alias("base_failed"), kept(F.col("x")).alias("kept"))


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs that the rule keeps, with all their columns. Null texts go, as they have no words."""
    small_batches(docs.sparkSession)
    x = free_name(docs, "_repetition")
    return docs.withColumn(x, repetition(docs[text_col])).where(kept(F.col(x))).drop(x)
