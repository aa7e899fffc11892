"""Intake of new files as a stream.

The stream only delivers new files. Changed and removed ones come from
``operators.catalog.snapshot_actions``, which compares two snapshots.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docquarry.operators.chunking import chunk_documents
from docquarry.sources.files import described, load_texts


def intake(spark: SparkSession, folder: str, out: str, checkpoint: str, *, files_per_batch: int = 64) -> StreamingQuery:
    """Chunks of every new document in ``folder`` appended to ``out``, a batch of files at a time, until there are no more.

    Each batch is written to a folder named by its number, replacing what a
    failed try may have left, so a batch that runs again after a restart adds
    nothing twice. Documents are numbered by the hash of path and content.
    """
    spec = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(spec).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", str(files_per_batch)).load(folder)

    def write(batch: DataFrame, number: int) -> None:
        texts = load_texts(described(batch, folder)).withColumn("doc_id", F.xxhash64("source", "sha256"))
        cut = chunk_documents(texts.select("doc_id", "text")).join(texts.drop("text"), "doc_id")
        cut.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
