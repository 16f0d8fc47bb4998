"""Files of triples as a stream: each new file is parsed and appended, repeats within the watermark are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.ntriples import parse_lines


def read_stream(spark: SparkSession, folder: str, watermark: str = "1 hour") -> DataFrame:
    lines = spark.readStream.option("maxFilesPerTrigger", 100).text(folder)
    parsed = parse_lines(lines).where(F.col("s").isNotNull()).withColumn("seen", F.current_timestamp())
    return parsed.withWatermark("seen", watermark).dropDuplicatesWithinWatermark(["s", "p", "o"]).select("s", "p", "o")


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a store by predicate; ends when what is there is read."""
    return stream.writeStream.partitionBy("p").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
