"""Fusion of rankings, comparison of modes, neighbours and source lists."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.terms import rounded

RRF_K, RADIUS = 60, 2


def normalize_weights(mode: str, dense: float | None = 0.7, sparse: float | None = 0.3) -> tuple[float, float]:
    """Weights that sum to 1, to 3 digits; the modes dense and sparse force their side."""
    if mode in ("dense", "sparse"):
        return (1.0, 0.0) if mode == "dense" else (0.0, 1.0)
    d, s = (default if x is None or math.isnan(x) else max(0.0, x) for x, default in ((dense, 0.7), (sparse, 0.3)))
    if d + s == 0:
        return 0.5, 0.5
    return math.floor(d / (d + s) * 1000 + 0.5) / 1000, math.floor(s / (d + s) * 1000 + 0.5) / 1000


def weighted_rrf(dense: DataFrame, sparse: DataFrame, weights: tuple[float, float], limit: int) -> DataFrame:
    """Two rankings (query, doc, rank, score) of each query as one: rank, fused_score, both ranks and scores and
    retrieved_by. A list of weight 0 is left out. Ties keep the dense order, then the sparse one."""
    d = dense.select("query", "doc", F.col("rank").alias("dense_rank"), F.col("score").alias("dense_score")).filter(F.lit(weights[0] > 0))
    s = sparse.select("query", "doc", F.col("rank").alias("sparse_rank"), F.col("score").alias("sparse_score")).filter(F.lit(weights[1] > 0))
    both = d.join(s, ["query", "doc"], "full_outer")
    part = lambda w, r: F.coalesce(F.lit(w) / (RRF_K + F.col(r)), F.lit(0.0))
    fused = both.withColumn("fused_score", part(weights[0], "dense_rank") + part(weights[1], "sparse_rank")).withColumn("retrieved_by", F.concat_ws(",", F.when(F.col("dense_rank").isNotNull(), "dense"), F.when(F.col("sparse_rank").isNotNull(), "sparse")))
    w = Window.partitionBy("query").orderBy(F.round(F.col("fused_score"), 12).desc(), F.col("dense_rank").asc_nulls_last(), F.col("sparse_rank").asc_nulls_last(), F.col("doc"))
    return fused.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def mode_overlap(runs: DataFrame) -> DataFrame:
    """For each pair of modes of runs (mode, query, doc) and each query of any mode: shared documents and their share of
    the union (3 digits); 0 where a mode found nothing."""
    items = runs.select("mode", "query", "doc").distinct()
    every = items.select("mode").distinct().crossJoin(items.select("query").distinct())  # a few modes
    sizes = every.join(items.groupBy("mode", "query").agg(F.count(F.lit(1)).alias("n")), ["mode", "query"], "left").select("mode", "query", F.coalesce("n", F.lit(0)).alias("n"))
    a, b = sizes.select(F.col("mode").alias("mode_a"), "query", F.col("n").alias("n_a")), sizes.select(F.col("mode").alias("mode_b"), "query", F.col("n").alias("n_b"))
    shared = items.select(F.col("mode").alias("mode_a"), "query", "doc").join(items.select(F.col("mode").alias("mode_b"), "query", "doc"), ["query", "doc"]).filter("mode_a < mode_b").groupBy("mode_a", "mode_b", "query").agg(F.count(F.lit(1)).alias("shared"))
    pairs = a.join(b, "query").filter("mode_a < mode_b").join(shared, ["mode_a", "mode_b", "query"], "left").withColumn("shared", F.coalesce("shared", F.lit(0)))
    return pairs.select("query", "mode_a", "mode_b", "shared", F.coalesce(rounded(F.try_divide("shared", F.col("n_a") + F.col("n_b") - F.col("shared"))), F.lit(0.0)).alias("jaccard"))


def neighbours(primary: DataFrame, passages: DataFrame, budget: int, radius: int = RADIUS) -> DataFrame:
    """Passages at most ``radius`` places from a primary one in its document: query, passage, anchor_rank, anchor_score and
    place in the list of at most ``budget``. primary: query, rank, document, idx and, if there is one, score; passages:
    passage, document, page, idx. A passage belongs to its best-ranked primary; places of primaries are left out.
    Joined on document and place, so a long document is spread over its places."""
    scored = primary if "score" in primary.columns else primary.withColumn("score", F.lit(None).cast("double"))
    around = scored.select("query", "rank", "score", "document", F.explode(F.sequence(F.col("idx") - radius, F.col("idx") + radius)).alias("idx"))
    near = around.groupBy("query", "document", "idx").agg(F.min("rank").alias("anchor_rank"), F.min_by("score", "rank").alias("anchor_score"))
    near = near.join(primary.select("query", "document", "idx"), ["query", "document", "idx"], "left_anti")
    w = Window.partitionBy("query").orderBy("anchor_rank", "page", "idx", "passage")
    found = near.join(passages.select("passage", "document", "page", "idx"), ["document", "idx"])
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= budget).select("query", "passage", "anchor_rank", "anchor_score", "place")
