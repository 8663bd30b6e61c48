"""Listings, histories and changes of stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def last_turns(messages: DataFrame, n: int = 12, cut: int = 2000) -> DataFrame:
    """The newest ``n`` messages (chat_id, created_at, id, role, content) of each chat, of which user's and assistant's
    are kept, contents cut. The limit comes before the filter; Spark keeps n rows a chat before the shuffle."""
    w = Window.partitionBy("chat_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    newest = messages.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n)
    return newest.filter("role in ('user', 'assistant')").select("chat_id", "back", "id", "role", F.substring("content", 1, cut).alias("content"))


def short_title(title, most: int = 48):
    """The first characters of a title, with a mark where it is longer."""
    return F.when(F.length(title) > most, F.concat(F.substring(title, 1, most), F.lit("…"))).otherwise(title)


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` in place of those of ``old`` with the same key; columns that only one has are null in the other."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def patched(old: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``old`` with the non-null values of ``changes``."""
    names = [c for c in changes.columns if c != key]
    side = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in names])
    return old.join(side, key, "left").select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in names else F.col(c) for c in old.columns])


def without_documents(gone: DataFrame, documents: DataFrame, chunks: DataFrame, chats: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents and chunks without those of ``gone`` (id), and chats whose document_id is set to null where it is gone."""
    ids = gone.select("id").distinct()
    kept_chunks = chunks.join(ids.withColumnRenamed("id", "document_id"), "document_id", "left_anti")
    marked = chats.join(ids.select(F.col("id").alias("_gone")), F.col("document_id") == F.col("_gone"), "left")
    return documents.join(ids, "id", "left_anti"), kept_chunks, marked.withColumn("document_id", F.when(F.col("_gone").isNull(), F.col("document_id"))).drop("_gone")


def missing_ids(asked: DataFrame, documents: DataFrame) -> DataFrame:
    """The asked ids that no document has."""
    return asked.select("id").distinct().join(documents.select("id"), "id", "left_anti")


def totals(documents: DataFrame, by: str) -> DataFrame:
    return documents.groupBy(by).agg(F.count(F.lit(1)).alias("documents"), F.sum("chunk_count").alias("chunks"), F.sum("duplicate_chunks").alias("duplicates"))


def without_chats(gone: DataFrame, chats: DataFrame, messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chats and messages without the chats of ``gone`` (id)."""
    ids = gone.select("id").distinct()
    return chats.join(ids, "id", "left_anti"), messages.join(ids.withColumnRenamed("id", "chat_id"), "chat_id", "left_anti")


def scope_checked(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """Requests (request, workspace, document_ids ARRAY<STRING>) with missing, the asked documents that their workspace
    doesn't have, and accepted: whether there are none. A null list asks for none."""
    asked = requests.select("request", F.col("workspace").alias("_w"), F.explode(F.array_distinct("document_ids")).alias("_d"))
    known = documents.select(F.col("guest_id").alias("_w"), F.col("id").alias("_d")).distinct()
    lacking = asked.join(known, ["_w", "_d"], "left_anti").groupBy("request").agg(F.array_sort(F.collect_list("_d")).alias("missing"))
    rows = requests.join(lacking, "request", "left").withColumn("missing", F.coalesce("missing", F.array().cast("array<string>")))
    return rows.withColumn("accepted", F.size("missing") == 0)


def in_workspace(rows: DataFrame, workspace: str, ready: bool = False) -> DataFrame:
    """The rows of a workspace; only those that are ready on request."""
    kept = rows.filter(F.col("guest_id") == workspace)
    return kept.filter(F.col("status") == "ready") if ready else kept


def found_or_missing(rows: DataFrame, key: str, workspace: str) -> DataFrame:
    """The one row of an id in a workspace, with status 200, or a row of nulls with status 404."""
    one = rows.filter((F.col("id") == key) & (F.col("guest_id") == workspace)).limit(1)
    marked = rows.sparkSession.range(1).select(F.lit(1).alias("_one")).join(one.withColumn("_one", F.lit(1)), "_one", "left")
    return marked.select(*rows.columns, F.when(F.col("id").isNull(), 404).otherwise(200).alias("http_status"))


def with_file_flag(documents: DataFrame) -> DataFrame:
    """has_file: whether the original is stored, as a path or as bytes."""
    return documents.withColumn("has_file", F.col("storage_path").isNotNull() | F.col("file_bytes").isNotNull())


#: The content type of each source type.
CONTENT_TYPES = {"pdf": "application/pdf", "markdown": "text/markdown; charset=utf-8", "html": "text/html; charset=utf-8", "text": "text/plain; charset=utf-8"}


def stored_file(documents: DataFrame) -> DataFrame:
    """id, filename, content_type and content (BINARY, from file_bytes in base64) of documents with bytes."""
    kind = F.lit("application/octet-stream")
    for name, value in CONTENT_TYPES.items():
        kind = F.when(F.col("source_type") == name, value).otherwise(kind)
    return documents.filter("file_bytes is not null").select("id", "filename", kind.alias("content_type"), F.unbase64("file_bytes").alias("content"))


def new_chats(requests: DataFrame) -> DataFrame:
    """Chat rows of requests (id, guest_id, title, document_id, document_ids): the list as given, else the one document,
    else empty; the first is the primary one; the default title where there is none."""
    ids = F.coalesce(F.col("document_ids"), F.when(F.col("document_id").isNotNull(), F.array("document_id")), F.array().cast("array<string>"))
    return requests.select("id", "guest_id", short_title(F.coalesce("title", F.lit("New chat"))).alias("title"), F.get(ids, F.lit(0)).alias("document_id"), ids.alias("document_ids"))


def conforming(rows: DataFrame, schema: str) -> DataFrame:
    """The rows with exactly the columns of a schema, in its order: new columns null, others left out, types cast."""
    want = rows.sparkSession.createDataFrame([], schema).schema
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want.fields])


def with_dimension(vectors: DataFrame, size: int, column: str = "vector") -> DataFrame:
    """The vectors, each of which must have ``size`` places: others raise an error when they are read."""
    wrong = F.col(column).isNotNull() & (F.size(column) != size)
    return vectors.withColumn(column, F.when(wrong, F.raise_error(F.concat(F.lit(f"a vector has not {size} places but "), F.size(column).cast("string")))).otherwise(F.col(column)))


def without_vectors(vectors: DataFrame, documents: DataFrame) -> DataFrame:
    """The vectors (document_id) without those of the documents (id)."""
    return vectors.join(documents.select(F.col("id").alias("document_id")).distinct(), "document_id", "left_anti")


def health(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, n and ok (whether it can be read and isn't empty) of each table."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n", (F.col("n") > 0).alias("ok")) for name, df in tables.items()]
    out = counts[0]
    for one in counts[1:]:
        out = out.unionByName(one)
    return out


def append_runs(runs: DataFrame, path: str) -> None:
    """Adds rows of evaluation runs to a table of them."""
    runs.write.mode("append").parquet(path)


def golden_cases(files: DataFrame) -> DataFrame:
    """The cases of golden-set files, read by ``spark.read.json(multiLine=True)`` with GOLDEN: a row for each case with the
    version and corpus of its file."""
    return files.select("version", "corpus", F.explode("cases").alias("c")).select("version", "corpus", F.col("c.id").alias("id"), F.col("c.type").alias("case_type"), "c.question", "c.answer", F.col("c.expectedSources").alias("expected_sources"), F.col("c.mustInclude").alias("must_include"), F.coalesce("c.expectAbstain", F.lit(False)).alias("expect_abstain"), F.coalesce("c.expectClarification", F.lit(False)).alias("expect_clarification"))


GOLDEN = "version int, corpus string, notes string, cases array<struct<id:string,type:string,question:string,answer:string,expectedSources:array<string>,mustInclude:array<string>,expectAbstain:boolean,expectClarification:boolean>>"
