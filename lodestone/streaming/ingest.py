"""Documents that arrive as files, taken through the stage chain a slice of files at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lodestone.plans.chain import Chain

FILES_A_SLICE = 100


def ingest_arrivals(spark: SparkSession, folder: str, schema: str, chain: Chain, checkpoint: str, files_a_slice: int = FILES_A_SLICE) -> StreamingQuery:
    """Take what has arrived in ``folder``, Parquet files of ``schema`` with document_id and content_fp, through ``chain``; ends when all is taken.

    A slice is written under its batch's number before the chain runs over it. A batch that is replayed, after a kill at
    any point, writes the same folder again and finds in the chain's ledger what it has done already. Documents that a
    slice left behind, by a provider's limit, are taken up with the next one.
    """
    arrivals = f"{chain.root}/_arrivals"

    def take(batch: DataFrame, number: int) -> None:
        batch.dropDuplicates(["document_id"]).write.mode("overwrite").parquet(f"{arrivals}/batch={number:06d}")
        chain.advance(held_arrivals(spark, chain, schema))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_slice).parquet(folder)
    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def held_arrivals(spark: SparkSession, chain: Chain, schema: str) -> DataFrame:
    """Every document that has arrived, as it came last."""
    rows = spark.read.schema(f"{schema}, batch int").parquet(f"{chain.root}/_arrivals")
    last = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("batch")))
    return rows.withColumn("_last", last).where("_last = 1").drop("_last", "batch")
