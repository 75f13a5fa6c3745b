"""New alignment files as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from genolith.operators import ingest
from genolith.sources import readers


def stream_tables(spark: SparkSession, folder: str, root: str, checkpoint: str, min_length: int = 0, outgroup: bool = False, once: bool = True):
    """Starts a query that analyses files as they come and appends to align, indel and snp below ``root``.

    A block's rows carry its file's hash, and each micro-batch overwrites its own partition, so one that is run
    again after a failure leaves no repeats.
    """
    blocks = readers.blocked_fasta(spark, folder, min_length, streaming=True)

    def write(batch: DataFrame, number: int) -> None:
        done = ingest.analyzed(readers.valid_alignments(batch, outgroup), outgroup).persist()
        for name, df in (("align", ingest.align_table(done, outgroup)), ("indel", ingest.indel_table(done)), ("snp", ingest.snp_table(done))):
            df.write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
        done.unpersist()

    writer = blocks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
