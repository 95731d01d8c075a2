"""Token counts: the tokens of each distinct pre-token are counted once, joined to every document's pre-token frequencies and
summed. Ids are never built.

1. A block of documents is cut into pre-tokens. Those that HOT documents of the block hold are the hot keys of the join: they are
   few, and their counts are kept in the worker, so no task receives them from everywhere. For all others the block sends its words
   and their postings (document of the block, frequency) to the word's bucket.
2. A bucket owns its words: each is counted once for the whole corpus, and the counts are joined to the postings and summed for
   each document of a block.
3. The sums of a block come back together and make its rows. Two shuffles carry words, postings and sums, never texts.

Documents are known by their place in the block; so that a recomputed task gives the same blocks, docs should be a stored table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Vocabulary, partitions, pick, small_batches, vocabulary
from .pretokens import pretokens

#: Documents and characters of a block (a longer text is a block of its own), documents that make a word hot, words kept by a worker.
BLOCK_DOCS, BLOCK_CHARS, HOT, KEPT, KEPT_CHARS = 2000, 8 << 20, 24, 200_000, 40


class _Counts:
    """Tokens of words, kept up to a bound that doesn't touch results."""

    def __init__(self, of: Vocabulary):
        self.lengths, self.known = pretokens(of).lengths, {}

    def __call__(self, words: list[str]) -> np.ndarray:
        known = self.known
        fresh = [w for w in words if w not in known]
        more = dict(zip(fresh, self.lengths(fresh).tolist(), strict=True))
        out = np.fromiter((known[w] if w in known else more[w] for w in words), np.int64, len(words))
        if len(known) + len(fresh) > KEPT:
            known.clear()
        if len(fresh) <= KEPT:
            known.update((w, n) for w, n in more.items() if len(w) <= KEPT_CHARS)
        return out


def _block(texts: list[str], of: Vocabulary, counts: _Counts, buckets: int) -> tuple[np.ndarray, list[tuple]]:
    """Tokens that are known in place for each document; and for each bucket its words, postings for each word, documents of the
    postings and frequencies."""
    found = pretokens(of).split(texts)
    words, word, freq, doc, here = found.words, found.word, found.freq, found.text, found.other
    if not words:
        return here, []
    hot = np.bincount(word, minlength=len(words)) >= HOT
    tokens = np.zeros(len(words), np.int64)
    tokens[hot] = counts([w for w, h in zip(words, hot.tolist(), strict=True) if h])
    here = here + np.bincount(doc, weights=(freq * tokens[word]).astype(float), minlength=len(texts)).astype(np.int64)
    cold = ~hot[word]
    word, freq, doc = word[cold], freq[cold], doc[cold]
    bucket = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) % buckets for w in words), np.int64, len(words))
    order = np.lexsort((doc, word, bucket[word]))
    word, freq, doc = word[order], freq[order], doc[order]
    edges = np.flatnonzero(np.diff(bucket[word], prepend=-1))
    out = []
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(word)], strict=True):
        own, n = np.unique(word[a:b], return_counts=True)
        out.append((int(bucket[word[a]]), [words[i] for i in own.tolist()], n.astype("<u4").tobytes(), doc[a:b].astype("<u4").tobytes(), freq[a:b].astype("<u4").tobytes()))
    return here, out


def token_counts(docs: DataFrame, path: str | Vocabulary, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    Edge cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows, ties and null ids stay as they are; an empty
    table gives an empty one; other columns are left out whatever their names; long texts are counted whole."""
    spark = docs.sparkSession
    small_batches(spark)
    of, buckets = vocabulary(path), partitions(spark)
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    head = f"block long, ids array<{id_type}>, n_bytes array<long>, here array<long>"
    sent = T.StructType.fromDDL(f"bucket int, {head}, words array<string>, n binary, doc binary, freq binary")
    back = T.StructType.fromDDL(f"{head}, doc binary, tokens binary")
    out = T.StructType.fromDDL(f"doc_id {id_type}, n_bytes long, n_tokens long")
    kinds = [pa.int32(), pa.int64(), None, pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary(), pa.binary(), pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, task, nth = _Counts(of), TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def flush() -> pa.RecordBatch:
            nonlocal nth
            ids = pa.concat_arrays([b.column(0) for b in held])
            texts = pa.concat_arrays([b.column(1) for b in held])
            here, parts = _block([t or "" for t in texts.to_pylist()], of, counts, buckets)
            block = task << 32 | nth
            nth += 1
            n_bytes = pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64())
            heads = [nth % buckets, block, ids, n_bytes, pa.array(here), None, None, None, None]
            more = [(b, block, None, None, None, *part) for b, *part in parts]
            columns = []
            for k, (name, kind) in enumerate(zip(sent.names, kinds, strict=True)):
                if name in ("ids", "n_bytes", "here"):
                    offsets = pa.array([0, len(ids)] + [len(ids)] * len(more), pa.int32())
                    columns.append(pa.ListArray.from_arrays(offsets, heads[k], mask=pa.array([False] + [True] * len(more))))
                else:
                    columns.append(pa.array([heads[k], *(r[k] for r in more)], kind))
            return pa.RecordBatch.from_arrays(columns, sent.names)

        size = 0
        for batch in batches:
            if not len(batch):
                continue
            if held and size + batch.nbytes > BLOCK_CHARS:
                yield flush()
                held, size = [], 0
            held.append(batch)
            size += batch.nbytes
            if size > BLOCK_CHARS or sum(map(len, held)) >= BLOCK_DOCS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(of)
        for batch in batches:
            words = batch.column("words")
            distinct = words.flatten().dictionary_encode()
            each = counts(distinct.dictionary.to_pylist())[distinct.indices.to_numpy(zero_copy_only=False)]
            ends = np.cumsum(pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
            docs_, tokens = [], []
            for end, n, doc, freq in zip(ends.tolist(), *(batch.column(c).to_pylist() for c in ("n", "doc", "freq")), strict=True):
                if n is None:
                    docs_.append(None)
                    tokens.append(None)
                    continue
                n = np.frombuffer(n, "<u4")
                at, inverse = np.unique(np.frombuffer(doc, "<u4"), return_inverse=True)
                docs_.append(at.tobytes())
                sums = np.bincount(inverse, weights=(np.repeat(each[end - len(n) : end], n) * np.frombuffer(freq, "<u4")).astype(float))
                tokens.append(sums.astype("<i8").tobytes())
            kept = [batch.column(c) for c in ("block", "ids", "n_bytes", "here")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(docs_, pa.binary()), pa.array(tokens, pa.binary())], back.names)

    def gather(block: pa.Table) -> pa.Table:
        head = pc.index(pc.is_valid(block["here"]), True).as_py()
        ids, n_bytes = block["ids"][head].values, block["n_bytes"][head].values
        total = np.array(block["here"][head].as_py(), np.int64)
        for doc, tokens in zip(block["doc"].to_pylist(), block["tokens"].to_pylist(), strict=True):
            if doc is not None:
                total[np.frombuffer(doc, "<u4")] += np.frombuffer(tokens, "<i8")
        return pa.table([ids, n_bytes, pa.array(total)], names=["doc_id", "n_bytes", "n_tokens"])

    parts = rows.mapInArrow(cut, sent).repartitionById(buckets, F.col("bucket")).mapInArrow(own, back)
    counted = parts.groupBy("block").applyInArrow(gather, out)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
