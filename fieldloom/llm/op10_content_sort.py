"""Exact dedup by sorting contents.

1. Map side: every task combines equal texts within a window of bounded bytes, comparing whole normalised bytes, so that a hot
   group of copies leaves a task a few times only.
2. Splitters from a bounded sample range-partition what is left by its first bytes and, among texts with the same start, by
   their SHA-256, so that splitters stay short and no shared header makes a hot range.
3. Each range is sorted by the normalised bytes (Spark's external sort spills); equal texts are then adjacent and neighbours are
   compared in full while the range streams by. A run of equals leaves one row: its best row and its size.
4. Where every row must learn its fate, rows are joined to the runs by digest; rows there are small, and adaptive execution
   splits a hot digest.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, give_back, kept, partitions, pick, small_batches, squeezed

#: Bytes of a normalised text that take part in its range key, splitters sampled for each range, bytes combined on the map side.
PREFIX, PER_RANGE, WINDOW = 64, 64, 24 << 20
_WS = b" \t\n\r\x0b\x0c"


def _key(norm: bytes) -> tuple[bytes, bytes]:
    return norm[:PREFIX], hashlib.sha256(norm).digest()


def _splitters(docs: DataFrame, text: str, ranges: int) -> list[tuple[bytes, bytes]]:
    """Up to ranges - 1 keys from a sample of about PER_RANGE rows a range; more or fewer only shift the load."""
    n = docs.count()
    if ranges < 2 or not n:
        return []
    share = min(1.0, PER_RANGE * ranges / n)
    norm = squeezed(col(text)).cast("binary")
    sample = docs.select(col(text)).sample(share, seed=7).select(F.substring(norm, 1, PREFIX).alias("p"), F.unhex(F.sha2(norm, 256)).alias("d"))
    keys = sorted((bytes(r.p), bytes(r.d)) for r in sample.collect())
    return sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)}) if keys else []


def _better(chars: int, row_id: int | None) -> tuple[int, bool, int]:
    """Sorts rows of a group: most code points, then smallest id, null ids last."""
    return -chars, row_id is None, row_id or 0


def distinct_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None) -> DataFrame:
    """One row per distinct normalised text: digest (hex of SHA-256), keep_id, keep_chars, group_size, and for the row that
    stays the columns of carry (struct row)."""
    spark = docs.sparkSession
    small_batches(spark)
    carry = list(carry or [])
    ranges = partitions(spark)
    splitters = _splitters(docs, text_col, ranges)
    base = docs.select(
        col(text_col).cast("string").alias("text"), col(id_col).cast("long").alias("id"),
        *([F.struct(*[col(c) for c in carry]).alias("row")] if carry else []),
    )
    extra = [T.StructField("range", T.IntegerType()), T.StructField("digest", T.BinaryType()), T.StructField("chars", T.LongType()), T.StructField("n", T.LongType())]
    combined = T.StructType([*base.schema.fields, *extra])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("content sort")
        held: list[pa.RecordBatch] = []
        best: dict[bytes, list] = {}  # normalised text -> [order, number of batch, row, rows so far]
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rows: list[list] = [[] for _ in held]
            for norm, (order, b, i, n) in best.items():
                prefix, digest = key = _key(norm)
                rows[b].append((i, bisect_right(splitters, key), digest, -order[0], n))
            for batch, own in zip(held, rows, strict=True):
                if own:
                    at, *more = zip(*own, strict=True)
                    picked = batch.take(pa.array(at, pa.int64()))
                    kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([*picked.columns, *map(pa.array, more, kinds)], names=[*picked.schema.names, *(f.name for f in extra)])

        for batch in batches:
            for i, (text, row_id) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                text = text or ""
                norm = text.encode().translate(None, _WS)
                order = _better(len(text), row_id)
                if (x := best.get(norm)) is None:
                    best[norm] = [order, len(held), i, 1]
                    size += 2 * len(norm) + 200
                else:
                    x[3] += 1
                    if order < x[0]:
                        x[:3] = order, len(held), i
            held.append(batch)
            size += batch.nbytes // 2
            if size > WINDOW:
                yield from flush()
                held, best, size = [], {}, 0
                give_back()
        yield from flush()
        held, best, batch = [], {}, None
        give_back()

    sorted_ = (
        base.mapInArrow(combine, combined)
        .repartitionById(ranges, F.col("range"))
        .withColumn("norm", squeezed(F.col("text")).cast("binary"))
        .sortWithinPartitions("norm")
    )
    runs = T.StructType(
        [T.StructField("digest", T.StringType()), T.StructField("keep_id", T.LongType()), T.StructField("keep_chars", T.LongType()), T.StructField("group_size", T.LongType())]
        + [f for f in base.schema.fields if f.name == "row"]
    )
    names = ["norm", "digest", "id", "chars", "n", *(["row"] if carry else [])]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept("content sort")
        run = None  # of equal texts: norm, digest, order, id, rows, batch and place of the best row

        def out(closed: list[tuple]) -> pa.RecordBatch:
            _, digests, orders, ids, ns, places = zip(*closed, strict=True)
            columns = [pa.array([d.hex() for d in digests], pa.string()), pa.array(ids, pa.int64()), pa.array([-o[0] for o in orders], pa.int64()), pa.array(ns, pa.int64())]
            if carry:
                columns.append(pa.concat_arrays([b.column(5).take(pa.array([i], pa.int64())) if not isinstance(b, pa.Array) else b for b, i in places]))
            return pa.RecordBatch.from_arrays(columns, names=[f.name for f in runs.fields])

        for batch in batches:
            closed = []
            lists = [c.to_pylist() for c in batch.columns[:5]]
            for i, (norm, digest, row_id, chars, n) in enumerate(zip(*lists, strict=True)):
                order = _better(chars, row_id)
                if run is not None and run[0] == norm:
                    best = run if run[2] <= order else (norm, digest, order, row_id, 0, (batch, i))
                    run = (*best[:4], run[4] + n, best[5])
                else:
                    if run is not None:
                        closed.append(run)
                    run = (norm, digest, order, row_id, n, (batch, i))
            if closed:
                yield out(closed)
            if carry and not isinstance(run[5][0], pa.Array):  # let go of the batch
                b, i = run[5]
                run = (*run[:5], (b.column(5).take(pa.array([i], pa.int64())), 0))
        if run is not None:
            yield out([run])
        run = batch = lists = None
        give_back()

    return sorted_.select(*names).mapInArrow(compare, runs)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id (the row of its group that stays: most code points, then smallest id), group_size,
    kept, text_sha256 (hex, normalised text).

    Texts are equal when identical after deleting white space. Edge cases: a null text counts as empty, and all empty texts are
    one group; null ids come last among ties; of rows that agree in text, length and id exactly one is kept; an empty table gives
    an empty one; other columns are left out whatever their names; very long texts are compared whole."""
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    rows = rows.select("doc_id", F.length(text).cast("long").alias("chars"), F.sha2(squeezed(text).cast("binary"), 256).alias("text_sha256"))
    same = Window.partitionBy("text_sha256", "doc_id").orderBy(F.desc("chars"))
    rows = rows.withColumn("nth", F.row_number().over(same))
    groups = distinct_texts(docs, id_col, text_col).withColumnRenamed("digest", "text_sha256")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)
    return rows.join(groups, "text_sha256").select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of equal texts the row that stays, with all its columns. Rows travel once, through the sort."""
    x = distinct_texts(docs, id_col, text_col, carry=docs.columns)
    return x.select(*[F.col("row")[c].alias(c) for c in docs.columns])
