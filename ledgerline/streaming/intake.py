"""Continuous intake of filings: each content once for ever, with its chunks, risks, status and log rows.

Uniqueness has no time limit, so there is no watermark: the stored table is the state. It lies in 256 parts by content hash; a
batch collects the parts that its hashes are in, 256 numbers at most, and reads only these. All tables are kept by deltas, so
that reading doesn't grow with the number of batches; a batch that runs again replaces its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import squeezed
from ..operators.maintain import audit_rows
from ..operators.text import chunks, page_array, tag_risks, with_default_risk
from ..sources.scratch import staged
from .deltas import Deltas

TABLES = {
    "stored": "doc_id long, file_hash string, n_bytes long, status string",
    "chunks": "document_id long, company_id long, chunk_index int, page_start int, page_end int, content string",
    "risks": "document_id long, risk string, description string, page_number int, n int",
    "logs": "document_id long, stage string, status string, message string",
}
STORED_PARTS, PARTS = 256, 16


def unreadable(text: Column) -> Column:
    """Whether a text is what is left of a file that wasn't decoded: it has NUL characters."""
    return F.contains(text, F.lit("\x00"))


def tables(spark: SparkSession, folder: str) -> dict[str, Deltas]:
    """The tables under a folder. Of a content the last row counts: one that failed is taken in again when it comes again."""
    last = lambda rows: rows.groupBy("file_hash").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "file_hash")), F.struct("batch", "doc_id")).alias("r")).select("r.doc_id", "file_hash", "r.n_bytes", "r.status", "r.batch")
    out = {"stored": Deltas(spark, f"{folder}/stored", TABLES["stored"], F.col("file_hash"), STORED_PARTS, last)}
    return out | {name: Deltas(spark, f"{folder}/{name}", TABLES[name], F.col("document_id"), PARTS) for name in ("chunks", "risks", "logs")}


def new_contents(batch: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Of a batch (doc_id, text), the least doc_id of each content that isn't stored, with its text and status; a null text is empty."""
    text = F.coalesce("text", F.lit(""))
    rows = batch.where("doc_id is not null").select("doc_id", text.alias("text"), F.sha2(text.cast("binary"), 256).alias("file_hash"))
    keys = rows.groupBy("file_hash").agg(F.min("doc_id").alias("doc_id"))
    if stored is not None:
        keys = keys.join(stored.select("file_hash"), "file_hash", "left_anti")
    out = rows.join(keys, ["doc_id", "file_hash"]).dropDuplicates(["file_hash"])
    status = F.when(unreadable(F.col("text")), "failed").otherwise("processed")
    return out.select("doc_id", "file_hash", F.octet_length("text").cast("long").alias("n_bytes"), status.alias("status"), "text")


def paged(contents: DataFrame) -> DataFrame:
    """contents with their pages in place of the text; one that failed has none.

    The squeezed text is a column of its own: written into the expression for the pages, it would be squeezed again for every page.
    """
    rest = [c for c in contents.columns if c != "text"]
    pages = F.when(F.col("status") == "processed", page_array(F.col("text")))
    return contents.withColumn("text", squeezed(F.col("text"))).select(*rest, pages.alias("pages"))


def stored_before(state: Deltas, batch: DataFrame, number: int) -> DataFrame:
    """What earlier batches have processed, of the parts that the batch's contents are in."""
    text = F.coalesce("text", F.lit(""))
    parts = state.parts_of(batch.select(F.sha2(text.cast("binary"), 256).alias("file_hash")))
    return state.rows(parts).where((F.col("batch") < number) & (F.col("status") == "processed"))


def failures(documents: DataFrame) -> DataFrame:
    """A log row for each document (doc_id, status) that failed."""
    row = [F.lit("pipeline_error").alias("stage"), F.lit("failed").alias("status"), F.lit("The text could not be read").alias("message")]
    return documents.where("status = 'failed'").select(F.col("doc_id").alias("document_id"), *row)


def run_intake(spark: SparkSession, source: str, schema: T.StructType, folder: str, files: str = "*", files_per_batch: int = 64) -> dict[str, DataFrame]:
    """Take in all files of the folder `source` (or of its folder named `files`) that haven't been, batch by batch, and give the tables.

    Checkpoint and tables live under `folder`, so a later call goes on where this one ended. A document that can't be read is
    stored as failed, with a log row and neither chunks nor risks; the others of its batch aren't held up.
    """

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        to = tables(session, folder)
        new = staged(paged(new_contents(batch, stored_before(to["stored"], batch, number))), "arrived")
        pages = new.where("status = 'processed'").select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 100).alias("company_id"), "pages")
        cut = staged(chunks(pages), "arrived-chunks")
        found = staged(tag_risks(pages.select("document_id", F.inline_outer("pages"))), "arrived-risks")
        found = with_default_risk(found, pages.select("document_id", F.concat(F.lit("T"), "company_id").alias("ticker")))
        count = lambda rows, name: rows.groupBy("document_id").agg(F.count("*").alias(name))
        counts = count(cut, "n_chunks").join(count(found, "n_risks"), "document_id", "full").fillna(0).withColumn("n_metrics", F.lit(0).cast("long"))
        named = new.select(F.col("doc_id").alias("id"), F.concat(F.lit("doc_"), "doc_id").alias("file_name"), "file_hash", "status")
        to["chunks"].append(cut, number)
        to["risks"].append(found, number)
        to["logs"].append(audit_rows(named, counts).unionByName(failures(new)), number)
        to["stored"].append(new.drop("pages"), number)  # last, so that what is stored is complete

    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{source}/{files}")
    whole = files != "*" and path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    stream = reader.parquet(f"{source}/{files}") if whole else reader.option("pathGlobFilter", files).parquet(source)
    stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    out = tables(spark, folder)
    for table in out.values():
        table.compact()
    return {name: table.read() for name, table in out.items()}
