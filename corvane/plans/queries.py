"""Queries over the test tables, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.context import materialize, table
from corvane.functions import terms as t
from corvane.functions.text import clean_role
from corvane.operators import chunking, dedup, dense, evaluation, fusion, nested, quality, retrieval, sparse, store
from corvane.operators.deliveries import latest_deliveries
from corvane.plans.oracles import ORACLES  # noqa: F401
from corvane.sources import loaders
from corvane.streaming.rate import limit_requests

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _messages(name: str, make: Callable[[DataFrame], DataFrame]) -> None:
    QUERIES[name] = lambda spark, folder: make(table(spark, folder, "messages"))


_messages("p4_found", nested.cited_sources)
_messages("p4_sources", lambda m: nested.sources(m).drop("pre", "post"))
_messages("p4_retrievers", nested.retrievers)
_messages("p4_verdicts", lambda m: nested.verdicts(m).drop("pre", "post"))
_messages("p4_cited", lambda m: nested.verdict_numbers(m, "citations"))
_messages("p4_supporting", lambda m: nested.verdict_numbers(m, "supported_by"))
_messages("p4_supporting_sources", lambda m: nested.cited_sources(m, "supported_by"))
_messages("p4_invalid", lambda m: nested.report_numbers(m, "invalid_citations"))
_messages("p4_unused", lambda m: nested.report_numbers(m, "unused_sources"))
_messages("p4_reasons", nested.reasons)
_messages("p4_statistics", lambda m: nested.objects(m, "retrieval_stats", nested.STAT_FIELDS))
_messages("p4_reports", lambda m: nested.objects(m, "citations", nested.REPORT_FIELDS))
_messages("p4_nodes", lambda m: nested.all_nodes(m, "citations"))
_messages("p4_confidences", lambda m: nested.objects(m, "confidence", nested.CONFIDENCE_FIELDS))


def _asked(spark: SparkSession, folder: str) -> DataFrame:
    """The golden questions, each once."""
    return table(spark, folder, "questions").select("id", "question").distinct()


def _index(spark: SparkSession, folder: str) -> sparse.SparseIndex:
    return sparse.SparseIndex(table(spark, folder, "documents"), "doc_id", F.col("text"))


# retrieval


@query
def bm25_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder).search(_asked(spark, folder), "id", F.col("question")).select(F.col("query").alias("question_id"), F.col("doc").alias("doc_id"), "rank", "score", "matched")


@query
def term_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder).coverage(_asked(spark, folder), "id", F.col("question")).select(F.col("query").alias("question_id"), "n_terms", "coverage")


@query
def token_df(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder).vocabulary.select("term", F.col("df").alias("doc_count"))


@query
def index_stats(spark: SparkSession, folder: str) -> DataFrame:
    return _index(spark, folder).stats.select(F.col("n").alias("docs"), t.rounded(F.col("avgdl"), 6).alias("avgdl"))


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"), F.col("label").alias("scope"))


def _vector_queries(spark: SparkSession, folder: str) -> DataFrame:
    return _vectors(spark, folder).filter("doc % 100 = 0").withColumnRenamed("doc", "query")


@query
def knn_topk(spark: SparkSession, folder: str) -> DataFrame:
    return dense.top_k(_vector_queries(spark, folder).drop("scope"), _vectors(spark, folder).drop("scope"), 10)


@query
def knn_exclude_own(spark: SparkSession, folder: str) -> DataFrame:
    return dense.top_k(_vector_queries(spark, folder), _vectors(spark, folder), 5)


@query
def near_dupe_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.near_duplicates(_vectors(spark, folder), 0.4)


@query
def vector_pad_trim(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    return e.select("vec_id", dense.pad_or_trim(F.col("embedding"), 80).alias("padded"), dense.pad_or_trim(F.col("embedding"), 8).alias("trimmed"))


def _dense_list(spark: SparkSession, folder: str, k: int) -> DataFrame:
    """The documents most similar to each question by their letters."""
    profile = dense.letter_profile
    documents = table(spark, folder, "documents").select(F.col("doc_id").alias("doc"), profile(F.col("text")).alias("vector"))
    return dense.top_k(_asked(spark, folder).select(F.col("id").alias("query"), profile(F.col("question")).alias("vector")), documents, k)


def _two_rankings(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    by_term = _index(spark, folder).search(_asked(spark, folder), "id", F.col("question"), 20)
    return _dense_list(spark, folder, 20), by_term.select("query", "doc", "rank", "score")


@query
def rrf_fusion(spark: SparkSession, folder: str) -> DataFrame:
    d, s = _two_rankings(spark, folder)
    fused = fusion.weighted_rrf(d, s, fusion.normalize_weights("hybrid", 0.7, 0.3), 10)
    return fused.select(F.col("query").alias("question_id"), F.col("doc").alias("doc_id"), "rank", t.rounded(F.col("fused_score"), 6).alias("fused_score"), "retrieved_by")


@query
def mode_overlap(spark: SparkSession, folder: str) -> DataFrame:
    d, s = _two_rankings(spark, folder)
    runs = d.filter("rank <= 10").select(F.lit("dense").alias("mode"), "query", "doc").unionByName(s.filter("rank <= 10").select(F.lit("sparse").alias("mode"), "query", "doc"))
    return fusion.mode_overlap(materialize(runs, "runs")).withColumnRenamed("query", "question_id")


@query
def lexical_rerank(spark: SparkSession, folder: str) -> DataFrame:
    asked, index = _asked(spark, folder), _index(spark, folder)
    pool = materialize(index.search(asked, "id", F.col("question"), 20).select("query", "doc", "rank"), "pool")
    return sparse.lexical_rerank(pool, asked, "id", F.col("question"), index.postings).select(F.col("query").alias("question_id"), F.col("doc").alias("doc_id"), "rank", "rerank_score")


def _passages(spark: SparkSession, folder: str) -> retrieval.Passages:
    return retrieval.passages_of(table(spark, folder, "chunks"), table(spark, folder, "documents"))


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    return _asked(spark, folder).select(F.col("id").alias("query"), F.col("question").alias("text"), dense.letter_profile(F.col("question")).alias("vector"))


def _sources(found: DataFrame, *more: str) -> DataFrame:
    return found.select(F.col("query").alias("question_id"), *more, "citation", F.col("chunk").alias("chunk_id"), "score", "dense_score", "sparse_score", "rerank_score", "retrieved_by")


@query
def hybrid_search(spark: SparkSession, folder: str) -> DataFrame:
    """Every question over all chunks: both lists, fused, reranked by their terms, with neighbours."""
    return _sources(retrieval.retrieve(_passages(spark, folder), _questions(spark, folder))[0])


@query
def retrieval_stats(spark: SparkSession, folder: str) -> DataFrame:
    return retrieval.retrieve(_passages(spark, folder), _questions(spark, folder))[1].withColumnRenamed("query", "question_id")


@query
def mode_comparison(spark: SparkSession, folder: str) -> DataFrame:
    found = retrieval.compare_modes(_passages(spark, folder), _questions(spark, folder))
    return _sources(found, "mode", F.length("text").alias("shown"))


@query
def bm25_scoped(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of the documents whose files a question expects, or of all where it expects none; counts stay those of
    the whole index."""
    cases = table(spark, folder, "questions").select("id", "question", "expected_sources").distinct()
    files = table(spark, folder, "documents").select("id", "filename")
    wanted = cases.select("id", F.explode("expected_sources").alias("filename")).distinct().join(files.withColumnRenamed("id", "document"), "filename").groupBy("id").agg(F.collect_set("document").alias("found"))
    some = F.size(F.coalesce("expected_sources", F.array().cast("array<string>"))) > 0
    asked = cases.join(wanted, "id", "left").select("id", "question", F.when(some, F.coalesce("found", F.array().cast("array<string>"))).alias("allowed"))
    index = _passages(spark, folder).index
    return index.search(asked, "id", F.col("question"), 5).select(F.col("query").alias("question_id"), F.col("doc").alias("chunk_id"), "rank", "score", "matched")


@query
def neighbor_expansion(spark: SparkSession, folder: str) -> DataFrame:
    """The three best chunks around every chunk, which is a query of its own."""
    chunks = table(spark, folder, "chunks").select("id", "document_id", "page", "chunk_index").distinct()
    primary = chunks.select(F.col("id").alias("query"), F.lit(1).alias("rank"), F.col("document_id").alias("document"), F.col("chunk_index").alias("idx"))
    found = fusion.neighbours(primary, chunks.select(F.col("id").alias("passage"), F.col("document_id").alias("document"), "page", F.col("chunk_index").alias("idx")), 3)
    return found.select(F.col("query").alias("chunk_id"), F.col("passage").alias("neighbour_id"), "place")


# texts


@query
def source_types(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", t.source_type(F.col("filename")).alias("kind"))


@query
def normalized_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", t.normalize_text(F.col("text")).alias("normal"))


@query
def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "chunks").filter("text is not null").select("id", F.sha2(F.col("text"), 256).alias("raw_hash"), t.fingerprint(F.col("text")).alias("fingerprint")).distinct()


@query
def sentence_counts(spark: SparkSession, folder: str) -> DataFrame:
    units = t.sentences(table(spark, folder, "documents").select("doc_id", F.regexp_replace("text", "\r\n?", "\n").alias("text")), F.col("text"))
    return units.groupBy("doc_id").agg(F.count(F.lit(1)).alias("units"), F.max(F.length("unit")).alias("longest"))


def _html_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The documents that are HTML by their source_type or hold a tag anywhere."""
    return table(spark, folder, "documents").filter((F.col("source_type") == "html") | F.col("text").rlike("</?[A-Za-z][^>]*>"))


@query
def html_text(spark: SparkSession, folder: str) -> DataFrame:
    return _html_pages(spark, folder).select("doc_id", t.html_to_text(F.col("text")).alias("plain"))


@query
def html_section_rows(spark: SparkSession, folder: str) -> DataFrame:
    return loaders.html_sections(_html_pages(spark, folder), "doc_id", "text").withColumnRenamed("key", "doc_id")


@query
def document_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Every document by its source type (text where it is unknown); the text of a pdf was extracted before."""
    kind = F.when(F.col("source_type").isin("pdf", "markdown", "html"), F.col("source_type")).otherwise("text")
    rows = table(spark, folder, "documents").select("doc_id", "text", kind.alias("kind"))
    return loaders.load_sections(rows, "doc_id", "text", "kind").select(F.col("key").alias("doc_id"), F.inline("sections"))


def _chunked(strategy: str) -> Query:
    embedder = dense.hashing_embedder() if strategy == "semantic" else None
    return lambda spark, folder: chunking.chunk_documents(table(spark, folder, "documents"), "doc_id", "processed_sections", strategy, embedder=embedder).withColumnRenamed("key", "doc_id")


for _strategy in ("fixed", "structural", "semantic"):
    QUERIES[f"chunk_{_strategy}"] = _chunked(_strategy)


@query
def exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """By arrival: of equal chunks of a workspace the first in batch_no, created_at and chunk_index is kept."""
    chunks = table(spark, folder, "chunks").select("id", "guest_id", "text", "batch_no", "created_at", "chunk_index").distinct()
    return dedup.exact_duplicates(chunks, "id", "guest_id", order=["batch_no", "created_at", "chunk_index"])


@query
def near_dupe_hashed(spark: SparkSession, folder: str) -> DataFrame:
    """Near duplicates of chunks of other documents by their letters, from candidates in shared buckets."""
    chunks = table(spark, folder, "chunks").select("id", "document_id", "text").distinct()
    vectors = chunks.filter("text is not null").select(F.col("id").alias("doc"), dense.letter_profile(F.col("text")).alias("vector"), F.col("document_id").alias("scope"))
    return dedup.near_duplicates_hashed(vectors, 0.999)


@query
def duplicate_totals(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "chunks").select("id", "guest_id", "document_id", "text").distinct()
    found = dedup.exact_duplicates(chunks, "id", "guest_id").select(F.col("key").alias("id"), F.lit(1).alias("dup"))
    return chunks.join(found, "id", "left").groupBy("document_id").agg(F.count(F.lit(1)).alias("chunks"), F.count("dup").alias("duplicates"))


# answers


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    return latest_deliveries(table(spark, folder, "messages").select("id", "received_at", clean_role(F.col("role")).alias("role"), "content"), ["role", "content"]).filter("role = 'assistant' and content is not null")


@query
def extract_citations(spark: SparkSession, folder: str) -> DataFrame:
    return _answers(spark, folder).select("id", F.array_join(quality.citation_numbers(F.col("content")).cast("array<string>"), ",").alias("numbers"), quality.strip_citations(F.col("content")).alias("bare"))


@query
def claim_rows(spark: SparkSession, folder: str) -> DataFrame:
    return quality.claims(_answers(spark, folder), "id", "content").select("key", "claim_no", "claim", F.array_join(F.col("citations").cast("array<string>"), ",").alias("citations"))


@query
def citation_reports(spark: SparkSession, folder: str) -> DataFrame:
    answers = _answers(spark, folder)
    counts = nested.sources(table(spark, folder, "messages")).groupBy(F.col("message_id").alias("key")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    sources = answers.select(F.col("id").alias("key")).join(counts, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n_sources"))
    return quality.citation_report(quality.claims(answers, "id", "content"), sources)


@query
def confidence_scores(spark: SparkSession, folder: str) -> DataFrame:
    stats = nested.objects(table(spark, folder, "messages"), "retrieval_stats", nested.STAT_FIELDS)
    scored = stats.withColumn("retrieval", quality.retrieval_confidence())
    return scored.select("message_id", "retrieval", (F.col("retrieval") < quality.ABSTAIN_BELOW).alias("abstain"), quality.band(F.col("retrieval")).alias("band"))


def _verdicts(spark: SparkSession, folder: str) -> DataFrame:
    return nested.verdict_lists(table(spark, folder, "messages")).select(F.col("message_id").alias("key"), F.col("verdict_no").alias("claim_no"), "status", "citations", "supported_by")


@query
def judged_claims(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judged_claims(_verdicts(spark, folder)).select("key", "claim_no", "status", F.size("citations").alias("cited"), F.size("supported_by").alias("supporting"))


@query
def verdict_reports(spark: SparkSession, folder: str) -> DataFrame:
    return quality.verdict_report(_verdicts(spark, folder))


def _scored(spark: SparkSession, folder: str) -> DataFrame:
    """Statistics, report and scores of every message that has statistics."""
    m = table(spark, folder, "messages")
    stats = nested.objects(m, "retrieval_stats", nested.STAT_FIELDS).withColumn("retrieval", quality.retrieval_confidence())
    report = quality.verdict_report(_verdicts(spark, folder)).withColumnRenamed("key", "message_id")
    invalid = nested.report_numbers(m, "invalid_citations").filter("number is not null").groupBy("message_id").agg(F.array_sort(F.collect_list("number")).alias("invalid_citations"))
    flags = nested.objects(m, "citations", {"verified": "boolean"})
    rows = stats.join(report, "message_id", "left").join(invalid, "message_id", "left").join(flags, "message_id", "left")
    rows = rows.withColumn("invalid_citations", F.coalesce("invalid_citations", F.array().cast("array<bigint>"))).withColumn("verified", F.coalesce("verified", F.lit(False)))
    count = lambda c: F.coalesce(c, F.lit(0))
    citation = quality.citation_score(F.col("verified"), count("total_claims"), count("cited_claims"), count("supported_claims"), count("miscited_claims"), F.size("invalid_citations"))
    return rows.withColumn("completeness", quality.completeness(F.lit(0), F.lit(0), count("total_claims"))).withColumn("citation", citation)


@query
def answer_scores(spark: SparkSession, folder: str) -> DataFrame:
    rows = _scored(spark, folder).withColumn("score", quality.composite(F.col("retrieval"), F.col("citation"), F.col("completeness")))
    return rows.select("message_id", "retrieval", t.rounded(F.col("citation")).alias("citation_coverage"), "completeness", "score", quality.band(F.col("score")).alias("band"))


@query
def score_reasons(spark: SparkSession, folder: str) -> DataFrame:
    return _scored(spark, folder).select("message_id", F.array_join(quality.score_reasons(), "\n").alias("reasons"))


def _source_lists(spark: SparkSession, folder: str) -> DataFrame:
    """The sources of each message in order."""
    rows = nested.sources(table(spark, folder, "messages"))
    one = F.struct("source_no", F.coalesce("citation", F.col("source_no") + 1).alias("citation"), F.coalesce("filename", F.lit("document")).alias("filename"), "heading", F.coalesce("page", F.lit(1)).alias("page"), "text")
    return rows.groupBy("message_id").agg(F.array_sort(F.collect_list(one)).alias("sources"))


@query
def abstain_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The text in place of an answer for each message whose retrieval doesn't carry one."""
    rows = _scored(spark, folder).join(_source_lists(spark, folder), "message_id", "left")
    kept = rows.filter(quality.abstains(F.when(F.col("sources").isNotNull(), F.size("sources")), F.col("retrieval")))
    return kept.select("message_id", quality.abstain_text(F.col("sources"), F.col("retrieval"), F.coalesce("keyword_coverage", F.lit(0.0))).alias("answer"))


@query
def prompts(spark: SparkSession, folder: str) -> DataFrame:
    """The prompt of each message with sources, with its content as the question."""
    rows = _source_lists(spark, folder).join(latest_deliveries(table(spark, folder, "messages").select("id", "received_at", "content"), ["content"]).select(F.col("id").alias("message_id"), "content"), "message_id")
    return rows.select("message_id", quality.prompt_text(F.col("content"), F.col("sources")).alias("prompt"))


@query
def linked_markers(spark: SparkSession, folder: str) -> DataFrame:
    return _answers(spark, folder).select("id", quality.linked_markers(F.col("content")).alias("linked"))


@query
def source_status(spark: SparkSession, folder: str) -> DataFrame:
    m = table(spark, folder, "messages")
    judged = nested.cited_sources(m).join(nested.verdicts(m).select("message_id", "verdict_no", "status"), ["message_id", "verdict_no"])
    return quality.source_status(judged, nested.sources(m))


# evaluation


@query
def retrieval_metrics(spark: SparkSession, folder: str) -> DataFrame:
    cases = table(spark, folder, "questions").select(F.col("id").alias("query"), F.col("expected_sources").alias("expected")).distinct()
    passages = _index(spark, folder).search(_asked(spark, folder), "id", F.col("question")).select("query", "rank", F.col("doc").alias("doc_id")).join(table(spark, folder, "documents").select("doc_id", "filename"), "doc_id")
    return evaluation.retrieval_metrics(passages, cases).withColumnRenamed("query", "question_id")


@query
def must_include(spark: SparkSession, folder: str) -> DataFrame:
    q = table(spark, folder, "questions").select("id", "answer", "must_include").distinct()
    return q.select("id", evaluation.must_include(F.col("answer"), F.col("must_include")).alias("complete"))


@query
def metrics_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.aggregated(table(spark, folder, "eval_runs"), ["chunk_strategy", "retrieval_mode"])


@query
def strategy_comparison(spark: SparkSession, folder: str) -> DataFrame:
    return evaluation.comparison(table(spark, folder, "eval_runs"), "chunk_strategy")


# stored tables


@query
def workspace_totals(spark: SparkSession, folder: str) -> DataFrame:
    return store.totals(table(spark, folder, "documents"), "guest_id")


@query
def recent_chats(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 chats changed last, with short titles."""
    chats = table(spark, folder, "chats").select("id", "title", "updated_at").distinct()
    return chats.orderBy(F.col("updated_at").desc(), "id").limit(50).select("id", store.short_title(F.col("title")).alias("title"))


def _chat_messages(spark: SparkSession, folder: str) -> DataFrame:
    return latest_deliveries(table(spark, folder, "messages").select("id", "received_at", "chat_id", "created_at", clean_role(F.col("role")).alias("role"), "content"), ["chat_id", "created_at", "role", "content"]).filter("chat_id is not null")


@query
def chat_history(spark: SparkSession, folder: str) -> DataFrame:
    return store.last_turns(_chat_messages(spark, folder))


@query
def chat_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Each chat's first document with its file name, 'document' where it is unknown."""
    chats = table(spark, folder, "chats").select("id", F.coalesce(F.get("document_ids", F.lit(0)), F.col("document_id")).alias("document_id")).distinct()
    names = table(spark, folder, "documents").select(F.col("id").alias("document_id"), "filename")
    return chats.join(names, "document_id", "left").select("id", "document_id", F.coalesce("filename", F.lit("document")).alias("filename"))


@query
def delete_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Rows left, by table, when the documents without chunks in their listing are deleted."""
    documents, chunks, chats = (table(spark, folder, x) for x in ("documents", "chunks", "chats"))
    left = store.without_documents(documents.filter("status = 'failed'"), documents, chunks, chats)
    count = lambda name, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
    return count("documents", left[0]).unionByName(count("chunks", left[1])).unionByName(count("chats with document", left[2].filter("document_id is not null")))


@query
def orphan_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return store.missing_ids(table(spark, folder, "chunks").select(F.col("document_id").alias("id")), table(spark, folder, "documents"))


@query
def rate_limit(spark: SparkSession, folder: str) -> DataFrame:
    return limit_requests(table(spark, folder, "events"), "user_id", "ts", "event_id", limit=2, window_seconds=3600).select(F.col("key").alias("user_id"), F.col("request").alias("event_id"), "allowed")


