"""Byte-level BPE with a contiguous rank array.

A pre-token of n bytes starts as n parts. Its row holds the part boundaries and, between neighbours, the rank of their merge.
Again and again the row is scanned for its smallest rank (the first one on ties), that boundary is deleted, and the ranks on
both sides of the merged part are looked up anew, until no rank is left. Rows of one length form a matrix, so numpy scans
thousands of pre-tokens at once. Words over SHORT bytes, for which repeated scans would be quadratic, use a heap with the same
order of merges.
"""

from __future__ import annotations

import heapq
import json
from collections import Counter
from itertools import chain

import numpy as np
import regex

from .common import Vocabulary, kept, vocabulary

#: Fixed value: the published pre-token pattern of byte_bpe_50k.json; its library reads \s as White_Space.
PRE_TOKEN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
SHORT = 48
NO_RANK = np.int32(2**31 - 1)
#: White space other than the space, a superset of what the pattern takes for it.
SPACES = [c for c in map(chr, range(1, 0x3001)) if c.isspace() and c != " "]


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a vocabulary file: printable Latin-1 stands for itself, every other
    byte for the next character from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Encodes and decodes with one vocabulary file. Pre-tokens and white-space-free pieces that were met before are kept, up to
    bounds of number and of length that don't touch results."""

    kept, kept_chars = 250_000, 40

    def __init__(self, source: str | Vocabulary):
        path = source if isinstance(source, str) else source.name
        spec = json.loads(vocabulary(source).data)
        model = spec["model"]
        pre = spec.get("pre_tokenizer") or {}
        plain = (
            model["type"] == "BPE"
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and not spec.get("normalizer")
            and not model.get("ignore_merges")
            and not model.get("continuing_subword_prefix")
            and not model.get("end_of_word_suffix")
        )
        if not plain:
            raise ValueError(f"{path} isn't a plain byte-level BPE vocabulary")
        of_byte = byte_alphabet()
        vocab = model["vocab"]
        self.pieces = {i: bytes(of_byte[c] for c in piece) for piece, i in vocab.items()}
        for added in spec.get("added_tokens", ()):
            if added["single_word"] or added["lstrip"] or added["rstrip"]:
                raise ValueError("added tokens that take in their surroundings aren't supported")
            self.pieces[added["id"]] = added["content"].encode()
        self.special = {a["content"]: a["id"] for a in spec.get("added_tokens", ())}
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.ints = list(range(max(self.pieces) + 1))  # one int object per id, so that kept tuples share them
        byte_id = np.zeros(256, np.int32)
        for c, b in of_byte.items():
            byte_id[b] = vocab[c]
        self.byte_id = byte_id
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.base = np.int64(max(vocab.values()) + 1)
        key = left * self.base + right
        order = np.argsort(key, kind="stable")
        self.pair_key, self.pair_rank = key[order], order.astype(np.int32)
        both = np.arange(256)
        self.byte_pair = self._rank(byte_id[np.repeat(both, 256)], byte_id[np.tile(both, 256)]).reshape(256, 256)
        self.pattern = regex.compile(PRE_TOKEN)
        self.of_word: dict[str, tuple[int, ...]] = {}
        self.of_piece: dict[str, tuple[int, ...]] = {}
        self.stale = False

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) * self.base + right
        at = np.searchsorted(self.pair_key, key)
        at[at == len(self.pair_key)] = 0
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NO_RANK)

    def _merged(self, words: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
        """For words of n bytes each the parts that are left, in front, and their number."""
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(-1, n)
        part = self.byte_id[raw]  # the part that starts at each boundary still held
        rank = np.full(raw.shape, NO_RANK, np.int32)  # of the part with its right neighbour; the last has none
        rank[:, :-1] = self.byte_pair[raw[:, :-1], raw[:, 1:]]
        held = np.full(len(words), n)
        live = np.arange(len(words))
        column = np.arange(n)
        while n > 1 and len(live):
            r = rank[live]
            at = r.argmin(axis=1)
            low = r[np.arange(len(live)), at]
            more = low != NO_RANK
            live, at, low, r = live[more], at[more], low[more], r[more]
            if not len(live):
                break
            here = np.arange(len(live))
            source = np.minimum(column + (column > at[:, None]), n - 1)  # drops the boundary after the first part of the pair
            p = np.take_along_axis(part[live], source, axis=1)
            r = np.take_along_axis(r, source, axis=1)
            p[here, at] = self.merged[low]
            count = held[live] - 1
            held[live] = count
            r[here, count - 1] = NO_RANK
            has_right = at + 1 < count
            x = here[has_right]
            r[x, at[has_right]] = self._rank(p[x, at[has_right]], p[x, at[has_right] + 1])
            has_left = at > 0
            x = here[has_left]
            r[x, at[has_left] - 1] = self._rank(p[x, at[has_left] - 1], p[x, at[has_left]])
            part[live], rank[live] = p, r
        return part, held

    def _short(self, words: list[bytes], n: int) -> list[tuple[int, ...]]:
        """Ids of words of n bytes each."""
        part, held = self._merged(words, n)
        ints = self.ints.__getitem__
        return [tuple(map(ints, row[:k])) for row, k in zip(part.tolist(), held.tolist(), strict=True)]

    def lengths(self, words: list[str]) -> np.ndarray:
        """Number of ids of each distinct pre-token; short ones' ids are never built."""
        out = np.zeros(len(words), np.int64)
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        for n in np.unique(size).tolist():
            at = np.flatnonzero(size == n)
            if n > SHORT:
                out[at] = [len(self._long(raw[i])) for i in at.tolist()]
            else:
                for k in range(0, len(at), 8192):
                    some = at[k : k + 8192]
                    out[some] = self._merged([raw[i] for i in some.tolist()], n)[1]
        return out

    def _long(self, word: bytes) -> tuple[int, ...]:
        part = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(part)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        ids = np.array(part)
        ranks = self._rank(ids[:-1], ids[1:])
        heap = [(r, i, part[i], part[i + 1]) for i, r in enumerate(ranks.tolist()) if r != NO_RANK]
        heapq.heapify(heap)
        gone = bytearray(n)

        def push(i: int, j: int) -> None:
            r = int(self._rank(np.array([part[i]]), np.array([part[j]]))[0])
            if r != NO_RANK:
                heapq.heappush(heap, (r, i, part[i], part[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or part[i] != a or part[j] != b:
                continue
            part[i] = int(self.merged[r])
            gone[j] = 1
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                push(i, k)
            if (h := before[i]) >= 0:
                push(h, i)
        return tuple([self.ints[p] for p, g in zip(part, gone, strict=True) if not g])

    def words(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """The ids of each distinct pre-token."""
        out: dict[str, tuple[int, ...]] = {}
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w.encode()), []).append(w)
        for n, group in by_length.items():
            if n > SHORT:
                out.update((w, self._long(w.encode())) for w in group)
            else:
                for k in range(0, len(group), 8192):
                    some = group[k : k + 8192]
                    out.update(zip(some, self._short([w.encode() for w in some], n), strict=True))
        return out

    @staticmethod
    def _cut(text: str) -> list[str]:
        """Pieces of a text such that no pre-token crosses from one to the next: cuts stand before single spaces between words.
        Every piece but the first lost the space in front of it."""
        cut = text.split(" ")
        if "" not in cut and not any(f"{c} " in text or f" {c}" in text for c in SPACES if c in text):
            return cut
        out, open_ = [cut[0]], not cut[0] or cut[0][-1].isspace()
        for p in cut[1:]:
            if open_ or not p or p[0].isspace():
                out[-1] = f"{out[-1]} {p}"  # this space has white space beside it
            else:
                out.append(p)
            open_ = not p or p[-1].isspace()
        return out

    def learn(self, pieces: set[str]) -> dict[str, tuple[int, ...]]:
        """Ids of those pieces (each after a space) that weren't kept before; the others are in of_piece."""
        if self.stale:
            self.of_piece.clear()
            self.of_word.clear()
        lack = [p for p in pieces if p not in self.of_piece]
        cut = [self.pattern.findall(f" {p}") for p in lack]
        known = self.of_word
        fresh = self.words([w for w in set(chain.from_iterable(cut)) if w not in known])
        if len(known) + len(fresh) <= self.kept:
            known.update((w, i) for w, i in fresh.items() if len(w) <= self.kept_chars)
        ids = {p: (known.get(ws[0]) or fresh[ws[0]]) if len(ws) == 1 else tuple([i for w in ws for i in known.get(w) or fresh[w]]) for p, ws in zip(lack, cut, strict=True)}
        if len(self.of_piece) + len(ids) > self.kept:
            self.stale = len(lack) * 2 > len(pieces)  # another kind of text: what was kept no longer helps
        else:
            self.of_piece.update((p, i) for p, i in ids.items() if len(p) <= self.kept_chars)
            self.stale = False
        return ids

    def parts(self, text: str | None) -> list[tuple[list[str], list[str], str | None]]:
        """Runs of plain text, each followed by a special string or none: pre-tokens of the run's first piece, the other pieces."""
        runs = self.special_cut.split(text) if text and self.special_cut else [text or ""]
        out = []
        for k in range(0, len(runs), 2):
            first, *rest = self._cut(runs[k])
            out.append((self.pattern.findall(first), rest, runs[k + 1] if k + 1 < len(runs) else None))
        return out

    def encode_each(self, texts: list[str | None]):
        """For each text the list of id tuples of its pieces, in order; a missing text has none."""
        rows = [self.parts(text) for text in texts]
        pieces: set[str] = set()
        firsts: set[str] = set()
        for row in rows:
            for first, rest, _ in row:
                pieces.update(rest)
                firsts.update(first)
        fresh, old = self.learn(pieces), self.of_piece
        head = self.words(list(firsts))
        for row in rows:
            out = []
            for first, rest, special in row:
                out += [head[w] for w in first]
                out += [old.get(p) or fresh[p] for p in rest]
                if special is not None:
                    out.append((self.special[special],))
            yield out

    def count_each(self, texts: list[str | None]):
        """For each text its number of tokens: every distinct piece is counted once for all texts, then joined to the text's
        piece frequencies; ids of a text are never built."""
        rows = [self.parts(text) for text in texts]
        freq = [(Counter(chain.from_iterable(rest for _, rest, _ in row)), Counter(chain.from_iterable(first for first, _, _ in row)), sum(s is not None for *_, s in row)) for row in rows]
        fresh, old = self.learn(set().union(*[f for f, _, _ in freq])), self.of_piece
        head = self.words(list(set().union(*[f for _, f, _ in freq])))
        for rest, first, special in freq:
            yield sum([n * len(old.get(p) or fresh[p]) for p, n in rest.items()]) + sum([n * len(head[w]) for w, n in first.items()]) + special

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(next(self.encode_each([text]))))

    def decode(self, ids) -> str:
        """The text of these ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


def encoder(of: Vocabulary) -> Encoder:
    """One per worker process and vocabulary, until the process runs another operator."""
    encoders = kept("bpe")
    if of.key not in encoders:
        encoders[of.key] = Encoder(of)
    return encoders[of.key]
