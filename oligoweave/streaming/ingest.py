"""Drop folders as streams: the file sources, run incrementally.

The record cut and the field parsing are those of the batch sources; what a stream
cannot give is a position within the whole file, so sequences arrive without an index.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from oligoweave.sources.alignments import fasta_fields


def stream_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, name, seq) of FASTA files as they land in a folder; file is the whole path."""
    records = spark.readStream.text(path, lineSep="\n>").select(
        F.col("_metadata.file_path").alias("file"), F.col("value")
    )
    fields = fasta_fields(F.col("value"))
    return records.where(F.trim("value") != "").select(
        "file", fields["name"].alias("name"), fields["seq"].alias("seq")
    )


def append_batches(
    stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Hand every micro-batch and its number to a batch sink; stops when the folder has been read.

    A batch may come again after a failure, under the same number: a sink that writes by
    it, such as ``append_run_log``, has its rows once.
    """
    return (
        stream.writeStream.foreachBatch(sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
