"""BPE encoding and decoding of whole texts (the merge loop is in bpe.py)."""

from __future__ import annotations

import hashlib
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import Vocabulary, lean, pick, small_batches, vocabulary


def encode(text: Column, path: str | Vocabulary) -> Column:
    """array<int> of token ids as the vocabulary's own library gives them without added special tokens; strings of special
    tokens inside a text become their ids. Null counts as empty; an empty text has no ids."""

    of = vocabulary(path)

    @F.arrow_udf("array<int>")
    @lean("bpe")
    def ids(texts: pa.Array) -> pa.Array:
        return pa.array([list(chain.from_iterable(x)) for x in encoder(of).encode_each(texts.to_pylist())], pa.list_(pa.int32()))

    return ids(text)


def decode(ids: Column, path: str | Vocabulary) -> Column:
    """The text of an array of ids, special tokens included; null counts as no ids."""

    of = vocabulary(path)

    @F.arrow_udf("string")
    @lean("bpe")
    def text(rows: pa.Array) -> pa.Array:
        return pa.array([encoder(of).decode(x or ()) for x in rows.to_pylist()], pa.string())

    return text(ids)


def digests(text: Column, path: str | Vocabulary) -> Column:
    """struct<n_tokens, ids_sha256, decoded_sha256>: encodes, decodes the ids again, and keeps only digests of both, so that
    token lists never leave the worker."""

    of = vocabulary(path)

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    @lean("bpe")
    def f(texts: pa.Array) -> pa.Array:
        e = encoder(of)
        out = []
        for row in e.encode_each(texts.to_pylist()):
            ids = list(chain.from_iterable(row))
            out.append((len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(e.decode(ids).encode()).hexdigest()))
        n, a, b = zip(*out, strict=True) if out else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return f(text)


def round_trip(docs: DataFrame, path: str | Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_tokens, ids_sha256, decoded_sha256.

    Edge cases: a null text counts as empty (0 tokens, digests of the empty string); ties, repeated rows and null ids are kept
    as they are; an empty table gives an empty one; other columns, whatever their names, are left out. Texts of any length are
    encoded whole: words over a bound merge by a heap, so that cost stays near linear."""
    small_batches(docs.sparkSession)
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    return rows.select("doc_id", digests(F.col("text"), path).alias("x")).select("doc_id", "x.n_tokens", "x.ids_sha256", "x.decoded_sha256")
