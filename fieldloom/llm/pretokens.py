"""Pre-tokens of the public vocabularies: parts of a text that are tokenised independently of each other.

Every class has split(texts) -> Found and lengths(words) -> number of tokens of each pre-token. A text's tokens are the others plus
the sum over its pre-tokens."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np

from .bpe import Encoder
from .common import Vocabulary


@dataclass
class Found:
    """Distinct pre-tokens of a block of texts; text, pre-token (both by number) and frequency of each pair; and the number of other
    tokens of each text."""

    words: list[str]
    text: np.ndarray
    word: np.ndarray
    freq: np.ndarray
    other: np.ndarray


def _integers(values, n: int) -> np.ndarray:
    return np.fromiter(values, np.int64, n)


def _found(counters: list[Counter], other: list[int]) -> Found:
    ids = {w: i for i, w in enumerate(set().union(*counters))}
    sizes = [len(c) for c in counters]
    word = _integers(chain.from_iterable(map(ids.__getitem__, c) for c in counters), sum(sizes))
    freq = _integers(chain.from_iterable(c.values() for c in counters), sum(sizes))
    return Found(list(ids), np.repeat(np.arange(len(sizes)), sizes), word, freq, np.array(other, np.int64))


class ByteLevel:
    """Byte-level BPE; the merges are bpe.Encoder's. Pieces between single spaces are counted first; every distinct one is cut once."""

    def __init__(self, of: Vocabulary):
        self.encoder = Encoder(of)
        self.lengths = self.encoder.lengths

    def split(self, texts: list[str]) -> Found:
        rows = [self.encoder.parts(t) for t in texts]
        pieces = _found([Counter(chain.from_iterable(rest for _, rest, _ in row)) for row in rows], [sum(s is not None for *_, s in row) for row in rows])
        find = self.encoder.pattern.findall
        cuts = [[f" {p}"] if p.isalpha() else find(f" {p}") for p in pieces.words]
        heads = [list(chain.from_iterable(first for first, _, _ in row)) for row in rows]
        ids: dict[str, int] = {}
        flat = _integers((ids.setdefault(w, len(ids)) for w in chain.from_iterable(cuts)), sum(map(len, cuts)))
        head = _integers((ids.setdefault(w, len(ids)) for w in chain.from_iterable(heads)), sum(map(len, heads)))
        size = _integers(map(len, cuts), len(cuts))
        each = size[pieces.word]  # pre-tokens of the piece of each pair
        start = np.repeat((np.cumsum(size) - size)[pieces.word] - (np.cumsum(each) - each), each)
        word = np.concatenate([flat[start + np.arange(len(start))], head])
        text = np.concatenate([np.repeat(pieces.text, each), np.repeat(np.arange(len(texts)), _integers(map(len, heads), len(heads)))])
        freq = np.concatenate([np.repeat(pieces.freq, each), np.ones(len(head), np.int64)])
        key, inverse = np.unique(text * max(1, len(ids)) + word, return_inverse=True)
        total = np.bincount(inverse, weights=freq.astype(float), minlength=len(key)).astype(np.int64)
        return Found(list(ids), key // max(1, len(ids)), key % max(1, len(ids)), total, pieces.other)


class Library:
    """Any other vocabulary of the tokenizers library: its own normaliser and pre-tokeniser cut, its model tokenises a pre-token."""

    def __init__(self, of: Vocabulary):
        from tokenizers import Tokenizer

        t = Tokenizer.from_str(of.data.decode())
        added = t.get_added_tokens_decoder().values()
        if t.pre_tokenizer is None or any(a.single_word or a.lstrip or a.rstrip or (a.normalized and t.normalizer is not None) for a in added):
            raise ValueError(f"{of.name} has no pre-tokens of its own")
        self.norm = t.normalizer.normalize_str if t.normalizer else str
        self.cut, self.model = t.pre_tokenizer.pre_tokenize_str, t.model
        names = sorted((a.content for a in added), key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, names)) + ")") if names else None

    def split(self, texts: list[str]) -> Found:
        runs = [self.special.split(t) if self.special else [t] for t in texts]
        return _found([Counter(w for run in r[::2] for w, _ in self.cut(self.norm(run))) for r in runs], [len(r) // 2 for r in runs])

    def lengths(self, words: list[str]) -> np.ndarray:
        return np.array([len(self.model.tokenize(w)) for w in words], np.int64)


class Pieces:
    """A sentencepiece model whose pieces hold the sign of a space in front only: a run of spaces with what follows it is a
    pre-token, as no piece reaches into the next one."""

    _UNIT = re.compile("▁+[^▁]*")

    def __init__(self, of: Vocabulary):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_proto=of.data)
        names = map(m.id_to_piece, range(m.get_piece_size()))
        if any("▁" in p.lstrip("▁") for p in names) or m.normalize("  a  b ") != "▁▁▁a▁▁b▁":
            raise ValueError(f"{of.name} joins words or drops spaces")

    def split(self, texts: list[str]) -> Found:
        return _found([Counter(self._UNIT.findall(self.model.normalize(t))) for t in texts], [0] * len(texts))

    def lengths(self, words: list[str]) -> np.ndarray:
        """Behind another word, as the model puts a sign of a space before the first one."""
        before, *ids = self.model.encode(["x", *[f"x{w}" for w in words]], num_threads=1)
        return np.array([len(i) - len(before) for i in ids], np.int64)


class Whole:
    """A vocabulary without pre-tokens: its library counts whole texts."""

    def __init__(self, of: Vocabulary):
        if of.name.endswith(".model"):
            import sentencepiece

            m = sentencepiece.SentencePieceProcessor(model_proto=of.data)
            self.count = lambda t: len(m.encode(t))
        else:
            from tokenizers import Tokenizer

            t = Tokenizer.from_str(of.data.decode())
            t.no_truncation()
            t.no_padding()
            self.count = lambda x: len(t.encode(x, add_special_tokens=False).ids)

    def split(self, texts: list[str]) -> Found:
        return _found([Counter() for _ in texts], [self.count(t) for t in texts])

    def lengths(self, words: list[str]) -> np.ndarray:
        return np.zeros(len(words), np.int64)


_open: dict[str, ByteLevel | Library | Pieces | Whole] = {}


def pretokens(of: Vocabulary):
    """The first class that fits; one per worker process and vocabulary."""
    if of.key not in _open:
        for kind in (Pieces, Whole) if of.name.endswith(".model") else (ByteLevel, Library, Whole):
            try:
                _open[of.key] = kind(of)
                break
            except ValueError:
                continue
    return _open[of.key]
