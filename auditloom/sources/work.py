"""Intermediate tables in the folder that all executors share.

A written table cuts the lineage and survives the loss of an executor. The folder is the one named by
spark.checkpoint.dir; only where that is unset (tests, a single machine) a temporary folder is made and removed at exit.
"""

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_KNOWN: set[str] = set()
_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give this package to the executors' Python workers, once per application; the driver serves the file to them."""
    app = spark.sparkContext.applicationId
    package = Path(__file__).resolve().parents[1]
    if app in _SHIPPED or not package.is_dir():
        return
    _SHIPPED.add(app)
    folder = tempfile.mkdtemp(prefix="auditloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/auditloom.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    spark.sparkContext.addPyFile(f"{folder}/auditloom.zip")


def shared_dir(spark: SparkSession) -> str:
    """This application's own folder within the shared one. Where it is a local folder it is removed at exit, else by clear_work()."""
    app = spark.sparkContext.applicationId
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = f"file://{tempfile.gettempdir()}"
    own = f"{named.rstrip('/')}/auditloom-{app}"
    if own not in _KNOWN:
        _KNOWN.add(own)
        local = own.removeprefix("file://") if own.startswith(("file://", "/")) else None
        if local:
            atexit.register(shutil.rmtree, local, ignore_errors=True)
    return own


def clear_work(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application; results that were not written or collected yet are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage_table(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: one evaluation, whatever reads it afterwards."""
    spark = df.sparkSession
    ship_package(spark)
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    writer = df.write
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let the driver notice what it no longer needs of steps that are done: shuffle files, broadcasts, its own memory.

    These go when their handles are collected, and a driver that only plans may collect its old garbage rarely and late.
    """
    spark._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores, for steps that cost far more than moving their input.

    Only inputs of fewer files than cores are moved; anything larger stays as it was read.
    """
    ship_package(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def slices(texts: pa.Array, most_bytes: int) -> Iterator[tuple[int, int]]:
    """Ranges of a batch's rows with at most so many bytes of text each, or one row."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if i > start and size + (n or 0) > most_bytes:
            yield start, i
            start, size = i, 0
        size += n or 0
    if start < len(texts):
        yield start, len(texts)


def rows_of_texts(kinds: dict[str, pa.DataType], rows_of: Callable[[str], list[tuple]], id_column: str, most_rows: int = 10_000, most_bytes: int = 8_000_000):
    """A function for mapInArrow over (id, text): the rows that each text gives, under its id.

    Texts are taken out of Arrow at most so many bytes at once, and rows are put back about so many at once, however many a text gives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for a, b in slices(batch.column(1), most_bytes):
                places, rows = [], []
                for i in range(a, b):
                    own = rows_of(batch.column(1)[i].as_py())
                    places += [i] * len(own)
                    rows += own
                    if len(rows) >= most_rows or i == b - 1:
                        for at in range(0, len(rows), most_rows):
                            part = rows[at : at + most_rows]
                            columns = (pa.array(c, k) for c, k in zip(zip(*part), kinds.values()))
                            yield pa.RecordBatch.from_arrays([ids.take(pa.array(places[at : at + most_rows])), *columns], names=[id_column, *kinds])
                        places, rows = [], []

    return run
