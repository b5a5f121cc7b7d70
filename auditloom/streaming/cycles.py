"""Streams of registry events.

Each function takes a streaming DataFrame and runs it to the end of what is there (trigger availableNow), with its checkpoint
in the shared folder; `every` runs it on and on instead. Sinks are written so that a batch that is replayed changes nothing.
"""

import sys
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType, TimestampType

from auditloom.sources.work import shared_dir, ship_package


def read_stream(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """The Parquet files of a folder as a stream; of a path that is a file, that one file."""
    ship_package(spark)
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_batch)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


def _place(spark: SparkSession, name: str) -> tuple[str, str]:
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    return f"{base}/out", f"{base}/checkpoint"


def _run(writer, every: str | None) -> None:
    started = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    if not every:
        started.awaitTermination()


def record_cycles(stream: DataFrame, every: str | None = None) -> DataFrame:
    """Counts of a batch per cycle (day) and event type, one folder per batch that a replay overwrites; read back summed over batches.

    stream: ts, event_type. NULL times fall into the cycle NULL.
    """
    spark = stream.sparkSession
    out, checkpoint = _place(spark, "cycles")

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy(F.to_date("ts").alias("cycle"), "event_type").agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    _run(stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), every)
    return spark.read.parquet(out).groupBy("cycle", "event_type").agg(F.sum("n").alias("n"))


def windowed_counts(stream: DataFrame, every: str | None = None) -> DataFrame:
    """Event counts per hour and type in event time, of all rows however late: counts of a batch, one folder per batch that a replay overwrites; read back summed over batches.

    stream: ts, event_type. NULL times fall into the hour NULL.
    """
    spark = stream.sparkSession
    out, checkpoint = _place(spark, "windows")
    schema = "hour timestamp, event_type string, n long"
    spark.createDataFrame([], schema).write.parquet(f"{out}/batch=-1")  # so that a stream without rows can be read back

    def write(batch: DataFrame, batch_id: int) -> None:
        hour = F.timestamp_seconds(F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600) * 3600)
        counts = batch.groupBy(hour.alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    _run(stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), every)
    return spark.read.schema(schema).parquet(out).groupBy("hour", "event_type").agg(F.sum("n").alias("n"))


def first_alerts(stream: DataFrame, every: str | None = None) -> DataFrame:
    """The first row of each subject and rule over the life of the stream: subject, rule_id. The state holds one row per pair."""
    spark = stream.sparkSession
    out, checkpoint = _place(spark, "alerts")
    _run(stream.select("subject", "rule_id").dropDuplicates(["subject", "rule_id"]).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint), every)
    return spark.read.schema(stream.select("subject", "rule_id").schema).parquet(out)


_BREAK = StructType(
    [StructField("package_name", StringType()), StructField("property_key", StringType()), StructField("observed_at", TimestampType()), StructField("old_value", StringType()), StructField("new_value", StringType()), StructField("stable_for_n", LongType()), StructField("weight", DoubleType())]
)


class PropertyMachine(StatefulProcessor):
    """Per package and property the value and for how many further observations it held; a change after `floor` of them comes out."""

    def __init__(self, floor: int = 10):
        self.floor = floor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("property", StructType([StructField("value", StringType()), StructField("n", IntegerType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        value, n = held if held is not None else (None, -1)
        out = []
        seen = pd.concat(list(rows)).sort_values(["observed_at", "obs_id"])
        for at, v in zip(seen["observed_at"], seen["v"]):
            if n < 0 or v != value:
                if n >= self.floor:
                    out.append((*key, at, value, v, n, round(min(1.0, 1 - 1 / (1 + (n - self.floor + 1) ** 0.7)), 6)))
                value, n = v, 0
            else:
                n += 1
        self.state.update((value, n))
        if out:
            yield pd.DataFrame(out, columns=_BREAK.names)

    def close(self) -> None:
        pass


def property_breaks(stream: DataFrame, floor: int = 10, every: str | None = None) -> DataFrame:
    """Breaks of long-stable properties as they come: package_name, property_key, observed_at, old and new value, stable_for_n, weight.

    stream: package_name, property_key, obs_id, observed_at, v (the value's identity, not NULL). Within a batch rows are taken by
    time, then obs_id; a row that comes in a later batch is later. A batch holds `maxFilesPerTrigger` files, which bounds a key's rows.
    """
    spark = stream.sparkSession
    out, checkpoint = _place(spark, "breaks")
    # The stream starts a Python process of its own that sees no files of the application: the machine's class travels whole.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = stream.select("package_name", "property_key", "obs_id", F.col("observed_at").cast("timestamp").alias("observed_at"), "v")
    found = rows.groupBy("package_name", "property_key").transformWithStateInPandas(statefulProcessor=PropertyMachine(floor), outputStructType=_BREAK, outputMode="Append", timeMode="None")
    _run(found.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint), every)
    return spark.read.schema(_BREAK).parquet(out)
