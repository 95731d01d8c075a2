"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import functools
import hashlib
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract here: space and U+0009 to U+000D. bytes.split() cuts at the same six bytes.
WS_CLASS = r"[\x20\x09-\x0D]"
NON_WS_CLASS = r"[^\x20\x09-\x0D]"
ARROW_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Python workers receive by rows and bytes, unless the session already bounds them lower."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= ARROW_ROWS:
        spark.conf.set(key, ARROW_ROWS)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, str(2**31 - 1)).rstrip("bB")) > 16 << 20:
        spark.conf.set(key, 16 << 20)


_kept: dict[str, dict] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if os.name == "posix" else None  # glibc has it


def kept(owner: str) -> dict:
    """What an operator keeps in a worker process from batch to batch. Processes outlive stages, so what another operator kept goes."""
    if owner not in _kept:
        _kept.clear()
        _kept[owner] = {}
    return _kept[owner]


def give_back() -> None:
    """Return free memory of this process to the system; the allocators hold on to it, in idle workers as well."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def lean(owner: str) -> Callable:
    """For the function of an Arrow UDF: its worker keeps nothing of other operators, and no free memory after a batch."""

    def wrap(f: Callable) -> Callable:
        @functools.wraps(f)
        def batch(*columns: pa.Array) -> pa.Array:
            kept(owner)
            try:
                return f(*columns)
            finally:
                give_back()

        return batch

    return wrap


def free_name(df: DataFrame, wish: str) -> str:
    """A column name that df doesn't have; Spark compares names without case."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def col(name: str) -> Column:
    """The column of exactly this name, dots included."""
    return F.col(f"`{name.replace('`', '``')}`")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns."""
    return df.select(*[col(n).alias(n) for n in names])


def word_count(text: Column) -> Column:
    """Number of words in a text; null has none. Counting white-space-to-word steps keeps words out of memory."""
    gaps = F.regexp_replace(F.coalesce(text, F.lit("")), f"{NON_WS_CLASS}+", "w")
    return F.length(F.regexp_replace(gaps, f"{WS_CLASS}+", "")).cast("long")


def squeezed(text: Column) -> Column:
    """The text without white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{WS_CLASS}+", "")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new path in the folder that all machines of the cluster share, as spark.checkpoint.dir names it. Where that is unset
    (tests on one machine) the warehouse folder serves; on a cluster a warehouse on a local disk is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
        one_machine = spark.sparkContext.master.split("[")[0] == "local"
        if not one_machine and (":" not in base or base.startswith("file:")):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    return f"{base.rstrip('/')}/fieldloom/{what}-{uuid.uuid4().hex}"


_paths: dict[int, tuple[DataFrame, str]] = {}


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: it cuts the lineage and survives lost executors. It goes with let_go, or else
    when the session's process ends."""
    path = shared_dir(df.sparkSession, what)
    until_exit(df.sparkSession, path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _paths[id(out)] = out, path
    return out


def let_go(*tables: DataFrame) -> None:
    """Remove tables of written() that nothing will read again."""
    for t in tables:
        if (known := _paths.pop(id(t), None)) is not None:
            remove(t.sparkSession, known[1])


def until_exit(spark: SparkSession, path: str) -> None:
    """Have a path removed when the session's process ends."""
    files, at = _located(spark, path)
    files.deleteOnExit(at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of any Hadoop file system."""
    files, at = _located(spark, path)
    files.delete(at, True)


def _located(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies: FIELDLOOM_TOKENIZERS names a folder, else the installed package knows."""
    if folder := os.environ.get("FIELDLOOM_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass(frozen=True)
class Vocabulary:
    """A vocabulary file by its contents (a few megabytes), so that executors need no file of the driver's."""

    name: str
    data: bytes = field(repr=False)
    key: str

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as f:
            data = f.read()
        return cls(os.path.basename(path), data, hashlib.sha256(data).hexdigest())


def vocabulary(source: str | Vocabulary) -> Vocabulary:
    """From a path, read on the driver, or as it is."""
    return source if isinstance(source, Vocabulary) else Vocabulary.read(source)
