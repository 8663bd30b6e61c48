"""Hybrid retrieval for a batch of questions: dense and sparse lists, fusion, rerank, neighbours, sources and statistics."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.context import materialize
from corvane.functions.terms import rounded
from corvane.operators import dense, fusion, sparse

#: Passages that are reranked, and characters of each that a scorer sees.
RERANKED, SHOWN = 20, 1200
MODES = ("hybrid", "dense", "sparse")

#: A function from a question and its passages to scores by place; places it leaves out score 0.
Scorer = Callable[[str, list[str]], dict[int, float]]


@dataclass(frozen=True)
class RetrieveOptions:
    mode: str = "hybrid"
    top_k: int = 8
    dense_weight: float | None = 0.7
    sparse_weight: float | None = 0.3
    rerank: bool = True
    expand: bool = True
    pool: int | None = None

    def __post_init__(self) -> None:
        if self.mode not in MODES or not 1 <= self.top_k <= 12:
            raise ValueError("mode is one of hybrid, dense, sparse, top_k from 1 to 12")


@dataclass(frozen=True)
class Passages:
    """The chunks (chunk, document, idx, page, heading, text, filename) with their index and their vectors (doc, vector,
    document)."""

    chunks: DataFrame
    index: sparse.SparseIndex
    vectors: DataFrame


def passages_of(chunks: DataFrame, documents: DataFrame, embed: Callable = dense.letter_profile) -> Passages:
    """Passages of chunks (id, document_id, chunk_index, page, heading, text), each id once, with the file names of
    documents (id, filename). Heading and text are indexed together. A missing page is 1, a missing place 0, an unknown
    file 'document'."""
    rows = chunks.select("id", "document_id", "chunk_index", "page", "heading", "text").dropDuplicates(["id"])
    names = documents.select(F.col("id").alias("document_id"), "filename").dropDuplicates(["document_id"])
    joined = rows.join(names, "document_id", "left").select(
        F.col("id").alias("chunk"), F.col("document_id").alias("document"), F.coalesce("chunk_index", F.lit(0)).alias("idx"), F.coalesce("page", F.lit(1)).alias("page"), "heading", "text", F.coalesce("filename", F.lit("document")).alias("filename")
    )
    kept = materialize(joined, "passages")
    index = sparse.SparseIndex(kept, "chunk", F.concat_ws(" ", "heading", "text"), scope="document")
    return Passages(kept, index, kept.select(F.col("chunk").alias("doc"), embed(F.col("text")).alias("vector"), "document"))


def rerank(pool: DataFrame, queries: DataFrame, scorer: Scorer | None = None, index: sparse.SparseIndex | None = None) -> DataFrame:
    """Pools (query, doc, rank, text) in a new order: query, doc, rank, rerank_score and backend.

    The first ``RERANKED`` of a pool are scored by ``scorer`` ('model'), clamped to 0..1; where there is none, or it fails
    or gives nothing, by their terms ('lexical'). A pool of one stays as it is ('none'). queries: query, text.
    """
    first = pool.filter(F.col("rank") <= RERANKED).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("query")))
    alone = first.filter("_n = 1").select("query", "doc", "rank", F.lit(None).cast("double").alias("rerank_score"), F.lit("none").alias("backend"))
    several = first.filter("_n > 1").drop("_n")
    if scorer is None:
        return sparse.lexical_rerank(several, queries, "query", F.col("text"), index.postings if index else None).withColumn("backend", F.lit("lexical")).unionByName(alone)
    kinds = f"query {pool.schema['query'].dataType.simpleString()}, doc {pool.schema['doc'].dataType.simpleString()}, rank int, rerank_score double"

    def score(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank").reset_index(drop=True)
        try:
            given = scorer(group["question"].iloc[0] or "", [(t or "")[:SHOWN] for t in group["text"]])
        except Exception:  # a scorer that fails must not fail the batch
            given = {}
        if not given:
            return group.iloc[:0].assign(rerank_score=0.0)[["query", "doc", "rank", "rerank_score"]]
        group["rerank_score"] = [min(1.0, max(0.0, float(given.get(n, 0.0)))) for n in range(len(group))]
        group = group.sort_values("rerank_score", ascending=False, kind="stable").reset_index(drop=True)
        return group.assign(rank=range(1, len(group) + 1))[["query", "doc", "rank", "rerank_score"]]

    asked = queries.select("query", F.col("text").alias("question"))
    scored = materialize(several.select("query", "doc", "rank", "text").join(asked, "query").groupBy("query").applyInPandas(score, kinds), "reranked")
    rest = several.join(scored.select("query").distinct(), "query", "left_anti")
    lexical = sparse.lexical_rerank(rest, queries, "query", F.col("text"), index.postings if index else None).withColumn("backend", F.lit("lexical"))
    return scored.withColumn("backend", F.lit("model")).unionByName(lexical).unionByName(alone)


def retrieve(passages: Passages, queries: DataFrame, options: RetrieveOptions | None = None, scorer: Scorer | None = None) -> tuple[DataFrame, DataFrame]:
    """(sources, statistics) of queries (query, text, vector and, if wanted, allowed ARRAY<STRING>: the documents a query
    may use; null all, empty none).

    sources: query, citation (from 1), chunk, document, filename, page, heading, text, score, dense_score, sparse_score,
    rerank_score, retrieved_by: the best ``top_k`` by rank, then their neighbours. statistics: one row for each query,
    also one that finds nothing.
    """
    each, asked = _each_once(queries)
    sources, stats = _retrieve(passages, asked, options or RetrieveOptions(), scorer, _rankings(passages, asked))
    return _to_all(sources, each), _to_all(stats, each)


def _each_once(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query, asked) and the queries that differ in text, vector or what is allowed, by the first query that has them:
    what equal ones find is the same, so it is found once."""
    same = [c for c in ("text", "vector", "allowed") if c in queries.columns]
    kept = materialize(queries.select("query", *same), "queries")
    marked = kept.withColumn("_same", F.struct(*same))
    first = materialize(marked.groupBy("_same").agg(F.min("query").alias("query")).select("query", "_same.*"), "asked")
    named = first.select(F.col("query").alias("asked"), F.struct(*same).alias("_first"))
    return materialize(marked.join(named, F.col("_same").eqNullSafe(F.col("_first"))).select("query", "asked"), "each"), first


def _to_all(found: DataFrame, each: DataFrame) -> DataFrame:
    return each.join(found.withColumnRenamed("query", "asked"), "asked").select("query", *[c for c in found.columns if c != "query"])


def _rankings(passages: Passages, queries: DataFrame) -> Callable[[str, int], DataFrame]:
    """The rankings of queries by vector and by term to a limit, each made and written once when it is first asked for."""
    made: dict[tuple[str, int], DataFrame] = {}

    def ranking(side: str, limit: int) -> DataFrame:
        if (side, limit) not in made:
            found = dense.top_k(queries.drop("text"), passages.vectors, limit) if side == "dense" else passages.index.search(queries, "query", F.col("text"), limit)
            made[side, limit] = materialize(found.select("query", "doc", "score", "rank"), "ranking")
        return made[side, limit]

    return ranking


def _retrieve(passages: Passages, queries: DataFrame, o: RetrieveOptions, scorer: Scorer | None, ranking: Callable[[str, int], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``retrieve`` for queries of which no two are equal."""
    size = o.pool or max(20, 3 * o.top_k)
    limit = max(size, 10)
    weights = fusion.normalize_weights(o.mode, o.dense_weight, o.sparse_weight)
    kinds = f"query {queries.schema['query'].dataType.simpleString()}, doc {passages.chunks.schema['chunk'].dataType.simpleString()}, score double, rank int"
    nothing = passages.chunks.sparkSession.createDataFrame([], kinds)
    by_vector = ranking("dense", limit) if o.mode != "sparse" else nothing
    by_term = ranking("sparse", limit) if o.mode != "dense" else nothing
    fused = fusion.weighted_rrf(by_vector, by_term, weights, size)
    if o.mode == "hybrid":
        spare = by_vector.filter(F.col("rank") <= size).join(fused.select("query").distinct(), "query", "left_anti")
        fused = fused.withColumn("score", rounded(F.col("fused_score"))).unionByName(spare.select("query", "doc", "rank", F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score"), rounded(F.col("score")).alias("score"), F.lit("dense").alias("retrieved_by")), allowMissingColumns=True)
    else:
        fused = fused.withColumn("score", rounded(F.coalesce("dense_score", "sparse_score")))
    fused = materialize(fused.select("query", "doc", "rank", "score", "dense_score", "sparse_score", "retrieved_by"), "fused")
    if o.rerank:
        texts = passages.chunks.select(F.col("chunk").alias("doc"), F.concat_ws(" ", "heading", "text").alias("text"))
        pool = fused.select("query", "doc", "rank") if scorer is None else fused.select("query", "doc", "rank").join(texts, "doc")
        order = rerank(pool, queries, scorer, passages.index)
        primary = fused.drop("rank").join(order, ["query", "doc"]).filter(F.col("rank") <= o.top_k)
    else:
        primary = fused.filter(F.col("rank") <= o.top_k).withColumn("rerank_score", F.lit(None).cast("double")).withColumn("backend", F.lit("none"))
    primary = materialize(primary, "primary")
    place = passages.chunks.select(F.col("chunk").alias("doc"), "document", "idx")
    found = primary.select("query", "doc", "rank", "score", "dense_score", "sparse_score", "rerank_score", "retrieved_by", F.lit(0).alias("part"))
    if o.expand:
        around = fusion.neighbours(primary.select("query", "doc", "rank", "score").join(place, "doc"), passages.chunks.select(F.col("chunk").alias("passage"), "document", "page", "idx"), max(2, math.ceil(o.top_k / 2)))
        around = around.select("query", F.col("passage").alias("doc"), F.col("place").alias("rank"), F.col("anchor_score").alias("score"), F.lit("neighbor").alias("retrieved_by"), F.lit(1).alias("part"))
        found = found.unionByName(around, allowMissingColumns=True)
    numbered = found.withColumn("citation", F.row_number().over(Window.partitionBy("query").orderBy("part", "rank", "doc")))
    sources = materialize(
        numbered.join(passages.chunks.withColumnRenamed("chunk", "doc"), "doc").select(
            "query", "citation", F.col("doc").alias("chunk"), "document", "filename", "page", "heading", "text", rounded(F.col("score")).alias("score"), rounded(F.col("dense_score")).alias("dense_score"), rounded(F.col("sparse_score")).alias("sparse_score"), rounded(F.col("rerank_score")).alias("rerank_score"), "retrieved_by"
        ), "sources",
    )
    return sources, _statistics(passages, queries, o, weights, by_vector, by_term, fused, primary, sources)


def _statistics(passages: Passages, queries: DataFrame, o: RetrieveOptions, weights: tuple[float, float], by_vector: DataFrame, by_term: DataFrame, fused: DataFrame, primary: DataFrame, sources: DataFrame) -> DataFrame:
    """One row for each query: mode, weights, hits of each list, fused candidates, rerank, best dense score, mean rerank
    score, keyword coverage, documents searched and passages returned. All counts come from one union."""
    null = F.lit(None).cast("double")
    fact = lambda df, what, value=null, name=F.lit(None).cast("string"): df.select("query", F.lit(what).alias("what"), value.alias("value"), name.alias("name"))
    facts = fact(by_vector, "dense", F.col("score")).unionByName(fact(by_term, "sparse")).unionByName(fact(fused, "fused")).unionByName(fact(primary, "primary", F.col("rerank_score"), F.col("backend"))).unionByName(fact(sources, "source"))
    n = lambda what: F.count_if(F.col("what") == what)
    counted = facts.groupBy("query").agg(
        n("dense").alias("dense_hits"), n("sparse").alias("sparse_hits"), n("fused").alias("fused_candidates"), n("source").alias("passages_returned"),
        F.max(F.when(F.col("what") == "dense", F.col("value"))).alias("top"), F.avg(F.when(F.col("what") == "primary", F.col("value"))).alias("mean"), F.max("name").alias("backend"),
    )
    files = passages.chunks.select("document").distinct().count()
    limited = F.col("allowed") if "allowed" in queries.columns else F.lit(None).cast("array<string>")
    searched = F.when(limited.isNotNull(), F.size(limited)).otherwise(F.lit(files))
    covered = passages.index.coverage(queries, "query", F.col("text"))
    rows = queries.select("query", searched.cast("long").alias("documents_searched")).join(covered, "query", "left").join(counted, "query", "left")
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    backend = F.coalesce("backend", F.lit("none"))
    return rows.select(
        "query", F.lit(o.mode).alias("mode"), F.lit(weights[0]).alias("dense_weight"), F.lit(weights[1]).alias("sparse_weight"), count("dense_hits"), count("sparse_hits"), count("fused_candidates"), (backend != "none").alias("rerank_used"), backend.alias("rerank_backend"),
        rounded(F.greatest(F.lit(0.0), F.coalesce("top", F.lit(0.0)))).alias("top_dense_score"), rounded(F.col("mean")).alias("mean_rerank_score"), rounded(F.coalesce("coverage", F.lit(0.0))).alias("keyword_coverage"), "documents_searched", count("passages_returned"),
    )


def compare_modes(passages: Passages, queries: DataFrame, options: RetrieveOptions | None = None, shown: int = 600) -> DataFrame:
    """The sources of each mode without neighbours, with the mode and texts cut to ``shown`` characters."""
    o = options or RetrieveOptions()
    each, asked = _each_once(queries)
    ranking = _rankings(passages, asked)
    runs = [_retrieve(passages, asked, RetrieveOptions(m, o.top_k, o.dense_weight, o.sparse_weight, o.rerank, False, o.pool), None, ranking)[0].withColumn("mode", F.lit(m)) for m in MODES]
    return _to_all(runs[0].unionByName(runs[1]).unionByName(runs[2]).withColumn("text", F.substring("text", 1, shown)), each)
