"""Incremental ingest of raw documents: rows, vectors and index by micro-batch, kept in step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.context import materialize
from corvane.functions.terms import fingerprint, source_type, terms
from corvane.operators import dense
from corvane.operators.chunking import ChunkOptions, chunk_documents
from corvane.operators.dedup import exact_duplicates
from corvane.sources.loaders import load_sections

#: A drop; strategy is fixed, structural or semantic (structural where null), dedupe true where null.
RAW = "filename string, workspace string, content string, strategy string, dedupe boolean"
STRATEGIES = ("structural", "fixed", "semantic")


def chunk_batch(raw: DataFrame, options: ChunkOptions | None = None, embedder: Callable | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, chunks) of raw documents (RAW) with ids made of workspace, file and place, so that a batch that is run
    again gives the same rows. Of drops of one file in a batch, one stands for all. A document of unknown type or
    without text has no chunks."""
    named = raw.withColumn("document_id", F.sha2(F.concat_ws("\u0000", "workspace", "filename"), 256)).withColumn("source_type", source_type(F.col("filename")))
    wanted = F.when(F.col("strategy").isin(*STRATEGIES), F.col("strategy")).otherwise(STRATEGIES[0])
    documents = materialize(named.select("document_id", "workspace", "filename", "source_type", "content", wanted.alias("strategy"), F.coalesce("dedupe", F.lit(True)).alias("dedupe")).dropDuplicates(["document_id"]), "ingest")
    sections = load_sections(documents.filter("source_type is not null"), "document_id", "content", "source_type")
    sections = sections.join(documents.select(F.col("document_id").alias("key"), F.col("strategy").alias("_s")), "key")
    parts = [chunk_documents(sections.filter(F.col("_s") == s), "key", "sections", s, options, embedder) for s in STRATEGIES]
    chunks = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumnRenamed("key", "document_id")
    chunks = chunks.join(documents.select("document_id", "workspace", "filename", "dedupe"), "document_id").withColumn("content_hash", fingerprint(F.col("text")))
    return documents, chunks.withColumn("id", F.sha2(F.concat_ws(":", "document_id", "chunk_index"), 256))


def ingest_batch(raw: DataFrame, target: str, number: int, options: ChunkOptions | None = None, embedder: Callable | None = None) -> None:
    """Writes a batch below ``target``: chunks, vectors, postings and, last, documents, each in a folder of the batch that is
    overwritten when it is run again. A chunk whose text another document of the workspace has, or an earlier chunk of its
    own, is left out, but for documents with dedupe false. A document left without chunks is 'failed'."""
    spark = raw.sparkSession
    documents, chunks = chunk_batch(raw, options, embedder)
    chunks = materialize(chunks, "ingest-chunks")
    asked = chunks.filter("dedupe")
    before = current(spark, target, "chunks", below=number)
    repeated = exact_duplicates(asked, "id", "workspace", order=["document_id", "chunk_index"]).select(F.col("key").alias("id"))
    if before is not None:
        known = before.select("workspace", "content_hash", F.col("document_id").alias("_other")).distinct()
        found = asked.join(known, ["workspace", "content_hash"]).filter("_other <> document_id").select("id")
        # a document of this batch replaces its earlier chunks
        repeated = repeated.unionByName(found).distinct()
    kept = materialize(chunks.join(repeated, "id", "left_anti").withColumn("batch", F.lit(number)), "ingest-kept")
    write = lambda df, name: df.write.mode("overwrite").parquet(f"{target}/{name}/run={number}")
    write(kept.select("id", "document_id", "workspace", "filename", "chunk_index", "page", "heading", "text", "strategy", "char_count", "content_hash", "batch"), "chunks")
    write(dense.embed(kept.select("id", "document_id", "workspace", "batch", "text"), "text", embedder or dense.hashing_embedder(), keep=["id", "document_id", "workspace", "batch"]), "vectors")
    told = kept.select("id", "document_id", "workspace", "batch", F.concat_ws(" ", "heading", "text").alias("_t"))
    write(terms(told, F.col("_t")).groupBy("id", "document_id", "workspace", "batch", "term").agg(F.count(F.lit(1)).alias("tf")), "postings")
    counts = kept.groupBy("document_id").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"), F.first("strategy").alias("chunk_strategy"))
    total = chunks.groupBy("document_id").agg(F.count(F.lit(1)).cast("int").alias("_all"))
    rows = documents.drop("content", "strategy", "dedupe").join(counts, "document_id", "left").join(total, "document_id", "left")
    count = F.coalesce("chunk_count", F.lit(0))
    write(rows.select("document_id", "workspace", "filename", "source_type", "chunk_strategy", count.alias("chunk_count"), (F.coalesce("_all", F.lit(0)) - count).alias("duplicate_chunks"), F.when(count > 0, "ready").otherwise("failed").alias("status"), F.lit(number).alias("batch")), "documents")


def current(spark: SparkSession, target: str, name: str, below: int | None = None) -> DataFrame | None:
    """The rows of a table that count: those of each document's last batch, as its row in documents tells. A batch that broke
    off before that row was written doesn't count. None where nothing has been written."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{target}/documents/run=*/_SUCCESS")
    if not pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern):
        return None
    documents = spark.read.parquet(f"{target}/documents").drop("run")
    if below is not None:
        documents = documents.filter(F.col("batch") < below)
    last = documents.groupBy("document_id").agg(F.max("batch").alias("batch"))
    table = documents if name == "documents" else spark.read.parquet(f"{target}/{name}").drop("run")
    return table.join(last, ["document_id", "batch"], "left_semi")


def ingest_stream(spark: SparkSession, folder: str, target: str, checkpoint: str, options: ChunkOptions | None = None, embedder: Callable | None = None):
    """A query that takes in JSON drops (RAW) batch by batch, as ``ingest_batch`` does."""
    write = lambda batch, number: ingest_batch(batch, target, number, options, embedder)
    return spark.readStream.schema(RAW).json(folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
