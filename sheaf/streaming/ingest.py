"""A folder of papers taken in as it grows: a stream of its files, a ledger of its batches, counters observed on the way.

A micro-batch's texts and chunks are written to folders of the batch's own, and then its row in the
ledger, in one file. What readers see is what the ledger names. So a batch that is run again after
a stop writes the same folders anew if it has no row yet, and does nothing if it has one. A row
also has a fingerprint of the batch's files; a batch of a number that the ledger has with other
files is an error, for then the stream's checkpoint does not belong to the target.

Papers that an earlier batch took are skipped, by their ids. Files that fail are kept with their
failure, have no chunks, and count as failed; files without a byte are none to Spark. The counters are observed while the batch is
written, without a pass of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import CHUNK_BYTES
from ..operators.corpus import not_ingested
from ..session import observed
from ..sources.corpora import file_texts, local_papers, plain_chunks

LEDGER = "batch_id long, fingerprint decimal(38,0), n_files long, n_skipped long, n_failed long, n_texts long, n_chunks long"
TEXTS = "paper_id string, title string, text string, failure string"
CHUNKS = "paper_id string, section string, chunk_index int, content string"


class FolderIngest:
    """The files under a folder, taken to a target folder by one stream at a time; both may be in any store."""

    def __init__(self, spark: SparkSession, folder: str, target: str, chunk_bytes: int = CHUNK_BYTES):
        self.spark, self.folder, self.target, self.chunk_bytes = spark, folder, target.rstrip("/"), chunk_bytes

    def exists(self, path: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def ledger(self) -> DataFrame:
        """A row for each batch that is done, with its counters."""
        path = f"{self.target}/ledger"
        return self.spark.read.schema(LEDGER).parquet(path) if self.exists(path) else self.spark.createDataFrame([], LEDGER)

    def taken(self, kind: str) -> DataFrame:
        """The `texts` or `chunks` of all batches that are done."""
        schema = TEXTS if kind == "texts" else CHUNKS
        done = [r["batch_id"] for r in self.ledger().select("batch_id").collect()]  # a number for each micro-batch
        return self.spark.read.schema(schema).parquet(*(self.place(kind, b) for b in sorted(done))) if done else self.spark.createDataFrame([], schema)

    def place(self, kind: str, batch_id: int) -> str:
        return f"{self.target}/{kind}/batch-{batch_id:08d}"

    def take(self, files: DataFrame, batch_id: int) -> None:
        """One micro-batch of binary files; for foreachBatch."""
        of_file = F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")
        fingerprint = files.agg(F.coalesce(F.sum(of_file), F.lit(0)).cast("decimal(38,0)")).first()[0]
        before = self.ledger().filter(F.col("batch_id") == batch_id).first()
        if before is not None:
            if before["fingerprint"] != fingerprint:
                raise ValueError(f"batch {batch_id} of {self.target} was of other files: the checkpoint belongs to another ingest")
            return
        seen, read, cut = Observation(), Observation(), Observation()
        papers = local_papers(files, self.folder).observe(seen, F.count(F.lit(1)).alias("n"))
        new = not_ingested(papers, self.taken("texts").select("paper_id"))
        self.titled(new).observe(read, F.count(F.lit(1)).alias("n"), F.count_if(F.col("failure").isNotNull()).alias("failed")).write.mode("overwrite").parquet(self.place("texts", batch_id))
        written = self.spark.read.schema(TEXTS).parquet(self.place("texts", batch_id))
        chunks = plain_chunks(written.filter("failure IS NULL").select("paper_id", "text"), self.chunk_bytes)
        chunks.observe(cut, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(self.place("chunks", batch_id))
        n_seen, n_read, n_failed, n_chunks = observed(seen), observed(read), observed(read, "failed"), observed(cut)
        row = (batch_id, fingerprint, n_seen, n_seen - n_read, n_failed, n_read - n_failed, n_chunks)
        self.spark.createDataFrame([row], LEDGER).coalesce(1).write.mode("append").parquet(f"{self.target}/ledger")

    def titled(self, papers: DataFrame) -> DataFrame:
        """(paper_id, title, text, failure) of papers; the title is the file's name, which the id ends with."""
        return file_texts(papers).select("paper_id", F.element_at(F.split(F.regexp_replace("paper_id", "^local:", ""), "/"), -1).alias("title"), "text", "failure")

    def run(self, checkpoint: str, files_per_batch: int = 1000) -> None:
        """Take all files that are there now and were not taken, some a batch, and stop."""
        files = self.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch).load(self.folder)
        self.start(files, checkpoint).awaitTermination()

    def start(self, files: DataFrame, checkpoint: str):
        return files.writeStream.foreachBatch(self.take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
