"""Records as JSON lines: manifests, predictions, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schema import COMPARISON, FIELDS, PREDICTION, TRUTH

#: A line that isn't a record is an error, not a record of nulls.
_STRICT = {"mode": "FAILFAST"}


def as_json(records: DataFrame) -> DataFrame:
    """One JSON text (linea) per record."""
    return records.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("linea"))


def parse_records(lines: DataFrame, schema: StructType) -> DataFrame:
    """Records of JSON texts; blank lines are passed over, malformed ones are an error."""
    return lines.where(F.trim("linea") != "").select(F.from_json("linea", schema, _STRICT).alias("r")).select("r.*")


def read_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A JSON Lines file; ord, where it is missing, is the place of the line within the file. Blank lines are passed over, malformed
    ones are an error."""
    lines = spark.read.text(path).select(F.col("value").alias("linea"), F.monotonically_increasing_id().alias("_n"))
    parsed = lines.where(F.trim("linea") != "").select(F.from_json("linea", schema, _STRICT).alias("r"), "_n")
    return parsed.select(*[F.coalesce("r.ord", "_n").alias("ord") if f.name == "ord" else F.col(f"r.{f.name}") for f in schema.fields])


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, TRUTH)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, PREDICTION)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path, COMPARISON)


def write_lines(records: DataFrame, path: str, one_file: bool = False) -> None:
    """JSON Lines, replacing what is there. One file only for small results."""
    (records.coalesce(1) if one_file else records).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_by_document(records: DataFrame, path: str) -> None:
    """One folder per document."""
    records.withColumn("_id", F.col("id_documento")).write.mode("overwrite").partitionBy("_id").json(path)


def missing_fields(campos: Column) -> Column:
    """Sorted fields that a record lacks."""
    return F.sort_array(F.array_except(F.array(*map(F.lit, FIELDS)), F.map_keys(campos)))


def validated(records: DataFrame) -> DataFrame:
    """records; a record without all fields is an error when it is read."""
    lack = missing_fields(F.col("campos"))
    message = F.concat(F.lit("missing fields: "), F.array_join(lack, ", "))
    return records.withColumn("campos", F.when(F.size(lack) > 0, F.raise_error(message)).otherwise(F.col("campos")))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder, on any Hadoop file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def clean(spark: SparkSession, folder: str, names: tuple[str, ...]) -> int:
    """Delete the files right below these subfolders of a folder, and nothing else: the subfolders stay, and so do hidden files and
    whatever lies deeper. Returns how many files went."""
    gone = 0
    for name in names:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{name}")
        files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(at):
            continue
        for status in files.listStatus(at):
            if status.isFile() and not status.getPath().getName().startswith("."):
                gone += bool(files.delete(status.getPath(), False))
    return gone
