"""Extraction and evaluation over a stream of texts (JSON lines with ord, id_documento, texto, ts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import extract

TEXTS = "ord long, id_documento string, texto string, ts timestamp"


def texts(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """New files of a folder, as they come."""
    return spark.readStream.schema(TEXTS).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def predictions(stream: DataFrame) -> DataFrame:
    """The same projection as for a table; documents seen again within a day are dropped."""
    once = stream.withWatermark("ts", "1 day").dropDuplicatesWithinWatermark(["id_documento"])
    return extract.predictions(once)


def blanks_by_hour(stream: DataFrame) -> DataFrame:
    """Documents and unread fields by hour of arrival, with late data up to an hour."""
    read = extract.extract(stream.withWatermark("ts", "1 hour"))
    blank = sum((F.col(f).isNull().cast("int") for f in extract.FIELDS), F.lit(0))
    return read.groupBy(F.window("ts", "1 hour").alias("hora")).agg(F.count("*").alias("documentos"), F.sum(blank).alias("en_blanco"))


def write(records: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append records as JSON lines, exactly once, until all that is there is done."""
    return records.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
