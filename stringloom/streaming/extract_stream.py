"""Keep a string catalog up to date while source files arrive.

The store has two tables, both with a folder per batch: ``found`` holds the occurrences, ``files`` the
paths that the batch brought. The newest batch of a path is its state; older ones count no more.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.extract import occurrences, scan_files, unique_strings
from ..plans.staging import delete_folder


def start_extract(files: DataFrame, store: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Extract from a stream of (path, content) into ``store``. A null content says that a file is gone.

    Extraction is stateless. A repeated batch replaces its own folders, so the store stays exact, and a
    batch counts once its paths are written, which is done last; before a repeated batch is written, its
    paths are taken away. Rows of one path in one batch are parts of one file.
    """

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        delete_folder(batch.sparkSession, f"{store}/files/batch={batch_id}")
        found = occurrences(scan_files(batch.where(F.col("content").isNotNull())))
        found.write.mode("overwrite").parquet(f"{store}/found/batch={batch_id}")
        batch.select("path").distinct().write.parquet(f"{store}/files/batch={batch_id}")

    writer = files.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def read_occurrences(spark: SparkSession, store: str) -> DataFrame:
    """The occurrences in the newest version of every file, as ``extract.occurrences`` gives them."""
    newest = spark.read.parquet(f"{store}/files").groupBy("path").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{store}/found").join(newest, ["path", "batch"]).drop("batch")


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """The strings of all files so far, as ``extract.unique_strings`` gives them."""
    return unique_strings(read_occurrences(spark, store))


def compact_store(spark: SparkSession, store: str, target: str) -> None:
    """Write the newest version of every file to ``target``, under the number of the last batch.

    A stopped stream goes on with ``target`` and its old checkpoint: its next batch has a higher number.
    """
    files = spark.read.parquet(f"{store}/files")
    last = files.agg(F.max("batch")).first()[0]
    if last is None:
        raise ValueError(f"no batch in {store}")
    read_occurrences(spark, store).write.parquet(f"{target}/found/batch={last}")
    files.select("path").distinct().write.parquet(f"{target}/files/batch={last}")
