"""Training-order materialisation: token sequences of a fixed length in fixed-stride shards.

1. Documents are dealt out and sorted by a hash of id and text, so that a sequence's place depends on its document alone, not on
   files or splits. Texts are encoded and cut into sequences of `length` ids; a range numbers its sequences as it goes. The ids are
   stored once.
2. Sums of the ranges give every sequence its global index. A keyed Feistel network over the smallest even power of two that holds
   all indices permutes them; an index that lands outside the table is walked through the network again until it lands inside,
   so slots 0 to n - 1 are each taken once.
3. Slots are range-partitioned into shards of a fixed number of slots (all ranges are equal, as slots are a permutation, so no
   sampling is needed), sorted, and written by Spark's own committer: a lost executor leaves no half shard. A task writes a group of
   neighbouring shards, so that shuffle partitions don't grow with shards. Record k of a shard starts at byte k * stride, so a
   reader can start at any slot.

A record is doc_id (int64), number in its document (int32), number of ids (int32), the ids (uint16 or uint32, padded) and a line
feed, little-endian.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Vocabulary, partitions, pick, remove, shared_dir, small_batches, until_exit, vocabulary

LENGTH, KEY, ROUNDS, SHARD_BYTES, WAVES = 256, 0x5EED, 4, 8 << 20, 4
HEADER = [("doc_id", "<i8"), ("seq", "<i4"), ("n", "<i4")]

MANIFEST = "n long, length int, wide boolean, stride int, slots int, key long, per_wave int, per_task int"

_encodings: dict = {}


def ranks_of(of: Vocabulary) -> dict[bytes, int]:
    """The rank table of a .tiktoken file."""
    import base64

    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, of.data.splitlines())}


def _encoding(ranks: str | Vocabulary, pattern: str):
    """The encoding of a rank table, and the number of its ids."""
    of = vocabulary(ranks)
    if (of.key, pattern) not in _encodings:
        import tiktoken

        table = ranks_of(of)
        _encodings[of.key, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={}), max(table.values(), default=-1) + 1
    return _encodings[of.key, pattern]


def record(length: int, wide: bool) -> np.dtype:
    """Layout of a record."""
    return np.dtype([*HEADER, ("ids", "<u4" if wide else "<u2", (length,)), ("end", "S1")])


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, n: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """A bijection of 0 to n - 1."""
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    bits, mask = np.uint64(half), np.uint64((1 << half) - 1)
    keys = [int(k) for k in _mix(np.arange(1, rounds + 1, dtype=np.uint64), (key * 0x9E3779B97F4A7C15) % (1 << 64))]
    x = index.astype(np.uint64)
    outside = np.ones(len(x), bool)
    while outside.any():
        left, right = x[outside] >> bits, x[outside] & mask
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & mask)
        x[outside] = left << bits | right
        outside = x >= n
    return x.astype(np.int64)


def sequences(docs: DataFrame, path: str, ranks: str | Vocabulary, pattern: str, wide: bool, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, stored under path, per row of docs: range, first (number of its first sequence within the range), doc_id, n_ids, ids
    (binary). Ranges of hashes follow each other, and rows within one are sorted, so ranges one after the other are in the same
    order for any number of them."""
    small_batches(docs.sparkSession)
    of, ranges = vocabulary(ranks), partitions(docs.sparkSession)
    rows = pick(docs, id_col, text_col).toDF("doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1))
    rows = rows.withColumn("range", F.shiftright(F.shiftright("h", 32) * ranges, 31).cast("int"))
    dealt = rows.repartitionById(ranges, F.col("range")).sortWithinPartitions("h", "doc_id", "text").select("range", "doc_id", "text")
    kind = np.uint32 if wide else np.uint16

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, _ = _encoding(of, pattern)
        first = 0
        for batch in batches:
            out = []
            for number, doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.array(e.encode_ordinary(text or ""), kind)
                out.append((number, first, doc_id, len(ids), ids.tobytes()))
                first += -(-len(ids) // length)
            columns = zip(*out, strict=True) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["range", "first", "doc_id", "n_ids", "ids"])

    out = dealt.mapInArrow(encode, "range int, first long, doc_id long, n_ids long, ids binary")
    out.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def materialise(docs: DataFrame, ranks: str | Vocabulary, pattern: str, path: str, length: int = LENGTH, key: int = KEY, shard_bytes: int = SHARD_BYTES, pad: int | None = None, waves: int = WAVES, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Write all sequences of docs as shards under path and return the manifest: n, length, wide, stride, slots (per shard), key,
    per_wave (shards in a folder wave=K), per_task (shards that a task writes). Shards are written range after range of slots, so
    that only one wave's share of the shuffle is on disk at a time. pad fills the last record of a document; by default it's the
    first id that the table leaves free. Ids take two bytes where table and pad fit.

    Edge cases: null and empty texts have no sequences; null ids are written as the smallest int64; repeated rows are written as
    often as they are there (in any order among themselves, as they are equal); an empty table writes no record; other columns are
    left out whatever their names; a long text has as many sequences as it needs."""
    spark = docs.sparkSession
    of = vocabulary(ranks)
    size = max(ranks_of(of).values(), default=-1) + 1
    pad = size if pad is None else pad
    wide = max(size, pad + 1) > 1 << 16
    layout = record(length, wide)
    staged = shared_dir(spark, "token-ids")
    until_exit(spark, staged)
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")  # a job's shuffle files go with the job
    try:
        stored = sequences(docs, staged, of, pattern, wide, length, id_col, text_col)
        # One number for each range, of which there are as many as shuffle partitions.
        sums = {r["range"]: r["n"] for r in stored.groupBy("range").agg(F.max(F.col("first") + F.ceil(F.col("n_ids") / length)).alias("n")).collect()}
        sizes = np.array([sums.get(k, 0) for k in range(max(sums, default=-1) + 1)], np.int64)
        bases, n = np.cumsum(sizes) - sizes, int(sizes.sum())
        slots = max(1, shard_bytes // layout.itemsize)
        shards = -(-n // slots)
        per_wave = max(1, -(-shards // waves))
        per_task = -(-per_wave // partitions(spark))

        def place(batches: Iterator[pa.RecordBatch], low: int, high: int) -> Iterator[pa.RecordBatch]:
            """Records of the shards from low to high."""
            kind = layout["ids"].base
            for batch in batches:
                number, first, doc_id, n_ids, raw = (c.to_pylist() for c in batch.columns)
                for k in range(0, len(number), 64):
                    own = slice(k, k + 64)
                    sizes = np.array(n_ids[own], np.int64)
                    counts = -(-sizes // length)
                    row = np.repeat(np.arange(len(sizes)), counts)
                    seq = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                    slot = permute((bases[number[own]] + np.array(first[own], np.int64))[row] + seq, n, key)
                    now = (low * slots <= slot) & (slot < high * slots)
                    if not now.any():
                        continue
                    row, seq, slot = row[now], seq[now], slot[now]
                    out = np.zeros(len(row), layout)
                    out["doc_id"] = np.array([np.iinfo(np.int64).min if d is None else d for d in doc_id[own]], np.int64)[row]
                    out["seq"], out["n"] = seq, np.minimum(sizes[row] - seq * length, length)
                    flat = np.concatenate([np.frombuffer(x, kind) for x in raw[own]])
                    at = ((np.cumsum(sizes) - sizes)[row] + seq * length)[:, None] + np.arange(length)
                    out["ids"] = np.where(np.arange(length) < out["n"][:, None], flat[np.minimum(at, len(flat) - 1)], pad)
                    body = np.ascontiguousarray(out.view(np.uint8).reshape(len(slot), layout.itemsize)[:, :-1])  # the writer adds the line feed
                    bytes_ = pa.Array.from_buffers(pa.binary(layout.itemsize - 1), len(slot), [None, pa.py_buffer(body)])
                    group = (slot // slots - low) // per_task
                    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(group.astype(np.int32)), bytes_.cast(pa.binary())], ["slot", "group", "record"])

        for wave, low in enumerate(range(0, max(1, shards), per_wave)):
            high = max(1, min(low + per_wave, shards))
            placed = stored.mapInArrow(lambda batches, low=low, high=high: place(batches, low, high), "slot long, group int, record binary")
            ranges = placed.repartitionById(-(-(high - low) // per_task), F.col("group")).sortWithinPartitions("slot")
            lines = ranges.select(F.col("record").cast("string").alias("value"))  # a text is any bytes here
            lines.write.option("lineSep", "\n").option("maxRecordsPerFile", slots).text(f"{path}/wave={wave}")
    finally:
        spark.conf.set(cleanup, before)
        remove(spark, staged)
    manifest = {"n": n, "length": length, "wide": wide, "stride": layout.itemsize, "slots": slots, "key": key, "per_wave": per_wave, "per_task": per_task}
    spark.createDataFrame([tuple(manifest.values())], MANIFEST).coalesce(1).write.json(f"{path}-manifest")
    return manifest


def read_slots(spark: SparkSession, path: str, first: int = 0, stop: int | None = None) -> DataFrame:
    """Records of slots first to stop (exclusive) of shards under path: slot, doc_id, seq, n_tokens, ids (array<int>). Shards
    outside are not opened, so reading resumes at any slot."""
    m = spark.read.schema(MANIFEST).json(f"{path}-manifest").first()
    stop = m.n if stop is None else min(stop, m.n)
    layout, slots = record(m.length, m.wide), m.slots
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    part = lambda k: F.regexp_extract("path", r"/wave=(\d+)/part-(\d+)-[^/]*?-c(\d+)[^/-]*\z", k).cast("int")
    shard = part(1) * m.per_wave + part(2) * m.per_task + part(3)
    wanted = files.where((shard >= first // slots) & (shard * slots < stop)).select(shard.alias("shard"), "content")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = np.frombuffer(content.as_buffer(), layout)
                if (rows["end"] != b"\n").any():
                    raise ValueError(f"shard {number} doesn't have records of {layout.itemsize} bytes")
                slot = number * slots + np.arange(len(rows), dtype=np.int64)
                for k in range(0, len(rows), 4096):
                    own, at = rows[k : k + 4096], slot[k : k + 4096]
                    use = (at >= first) & (at < stop)
                    own, at = own[use], at[use]
                    n = own["n"]
                    flat = own["ids"][np.arange(m.length) < n[:, None]].astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own["doc_id"].astype(np.int64)), pa.array(own["seq"].astype(np.int32)), pa.array(n.astype(np.int32)), ids], ["slot", "doc_id", "seq", "n_tokens", "ids"])

    small_batches(spark)
    return wanted.mapInArrow(cut, "slot long, doc_id long, seq int, n_tokens int, ids array<int>")
