"""Exact and near duplicates of chunks within a workspace."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.context import materialize
from corvane.functions.terms import fingerprint, rounded
from corvane.operators.dense import _units, top_k

NEAR = 0.95
#: Vectors in a box at most, and from which on a further box pays; rows that settle where boxes are cut.
CELL, LEAST_CELL, SAMPLE = 131072, 8192, 4096


def exact_duplicates(docs: DataFrame, key: str, scope: str, text: str = "text", order: list[str] | None = None) -> DataFrame:
    """key, kept_key of every row whose fingerprint an earlier row of its scope has: earlier by ``order`` (columns such as
    the arrival, nulls first), then by key. The first row of each fingerprint comes from a map-side minimum and goes
    back to its copies by a join, so a fingerprint of any number of copies is in no window. Null texts are no
    duplicates."""
    place = F.struct(*[F.col(c).alias(f"o{n}") for n, c in enumerate(order or [])], F.col(key).alias("k"))
    marked = docs.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(scope).alias("scope"), fingerprint(F.col(text)).alias("hash"), place.alias("place"))
    first = marked.groupBy("scope", "hash").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("scope", "hash", F.col("first.k").alias("kept_key"))
    known = first.withColumnsRenamed({"scope": "its_scope", "hash": "its_hash"})
    return marked.join(known, (F.col("hash") == F.col("its_hash")) & F.col("scope").eqNullSafe(F.col("its_scope"))).filter("key <> kept_key").select("key", "kept_key")


def near_duplicates(vectors: DataFrame, threshold: float = NEAR) -> DataFrame:
    """query, doc and score: each vector's most similar vector of another scope, if the cosine is ``threshold`` or more.
    Exact: every pair of blocks is multiplied, which is for sets of some ten thousand vectors; beyond, take
    ``near_duplicates_hashed``."""
    return top_k(vectors.select(F.col("doc").alias("query"), "vector", "scope"), vectors, 1, least=threshold).select("query", "doc", "score")


def near_duplicates_hashed(vectors: DataFrame, threshold: float = NEAR, block: int = 128) -> DataFrame:
    """As ``near_duplicates`` and as exact, from candidates that share a cell of the space; vectors are of one length.

    Vectors at cosine ``threshold`` are, at length 1, no farther apart than a fixed radius. The space, turned to its
    main axes, is cut into boxes at medians (of some thousand rows, which settle only where the cuts lie). A vector is at
    home in the box it lies in and a guest in each earlier box within the radius, so a pair meets once. A box is cut on
    into leaves of ``block`` vectors at most; only leaves within the radius are multiplied, in single precision first.
    Equal vectors of a scope are one row, so copies make no hot box.
    """
    spark, doc = vectors.sparkSession, vectors.schema["doc"].dataType.simpleString()
    kept = materialize(vectors.filter("vector is not null").select("doc", F.col("vector").cast("array<double>").alias("vector"), F.col("scope").cast("string").alias("scope")), "vectors")
    n, some = kept.count(), kept.orderBy(F.xxhash64("doc"), "doc").limit(SAMPLE).select("vector").toPandas()["vector"]
    if not n:
        return kept.select(F.col("doc").alias("query"), "doc", F.lit(0.0).alias("score"))
    # a score that rounds to the threshold counts; the rest of the margin is for the error of sums
    least = threshold - 0.5e-6
    radius2 = max(0.0, 2 - 2 * least) + 1e-9
    points = _units(some)
    points = points[np.isfinite(points).all(axis=1)]
    axes = np.linalg.eigh(np.cov(points.T).reshape(points.shape[1], -1) if len(points) > 1 else np.eye(points.shape[1]))[1][:, ::-1]
    low, high = _boxes(points @ axes, max(n / CELL, min(n / LEAST_CELL, spark.sparkContext.defaultParallelism)))
    cut = np.flatnonzero(np.isfinite(low).any(axis=0) | np.isfinite(high).any(axis=0))
    firsts = kept.groupBy("scope", "vector").agg(F.min("doc").alias("doc"))

    def deal(batches):
        for b in batches:
            if not b.num_rows:
                continue
            place = (_units_of(b.column("vector")) @ axes)[:, cut]
            home = np.full(len(place), -1, np.int32)
            for c in range(len(low)):
                home[((low[c, cut] <= place) & (place < high[c, cut])).all(axis=1)] = c
            for c in range(len(low)):
                out = np.maximum(np.maximum(low[c, cut] - place, place - high[c, cut]), 0.0)
                rows = np.flatnonzero((home >= c) & ((out * out).sum(axis=1) <= radius2))
                if len(rows):
                    t = b.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), c, np.int32)), pa.array(home[rows] == c), t.column("doc"), t.column("scope"), t.column("vector")], ["cell", "home", "doc", "scope", "vector"])

    def compare(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        units, home = _units_of(t.column("vector")), t.column("home").to_numpy()
        docs = np.unique(t.column("doc").to_numpy(), return_inverse=True)[1]
        scopes = pd.factorize(t.column("scope").to_numpy())[0]
        a, b, s = _close(units, units @ axes, home, block, radius2, threshold, least, docs, scopes)
        of = t.take(pa.array(a))
        return pa.table({"scope": of.column("scope"), "vector": of.column("vector"), "doc": t.column("doc").take(pa.array(b)), "score": s})

    placed = firsts.select("doc", "scope", "vector").mapInArrow(deal, f"cell int, home boolean, doc {doc}, scope string, vector array<double>")
    found = placed.groupBy("cell").applyInArrow(compare, f"scope string, vector array<double>, doc {doc}, score double")
    # a copy has the partner of its first row
    best = found.groupBy(F.col("scope").alias("its_scope"), F.col("vector").alias("its_vector")).agg(F.min(F.struct((-F.col("score")).alias("less"), "doc")).alias("b"))
    found = best.select("its_scope", "its_vector", F.col("b.doc").alias("partner"), (-F.col("b.less")).alias("score"))
    return kept.join(found, (F.col("vector") == F.col("its_vector")) & F.col("scope").eqNullSafe(F.col("its_scope"))).select(F.col("doc").alias("query"), F.col("partner").alias("doc"), "score")


def _close(units: np.ndarray, place: np.ndarray, home: np.ndarray, block: int, radius2: float, threshold: float, least: float, docs: np.ndarray, scopes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row that has one: the row, its best partner and the score, of pairs with a row at home."""
    narrow = place[:, :8].copy()
    mine, guests = _leaves(narrow, np.flatnonzero(home), block), _leaves(narrow, np.flatnonzero(~home), block)
    other = mine + guests
    order = np.concatenate(other) if other else np.empty(0, int)
    single, ends = units[order].astype(np.float32), np.cumsum([0] + [len(x) for x in other])
    lo, hi = (np.array([f(place[x], axis=0) for x in other]) for f in (np.min, np.max))
    found = [(np.empty(0, int), np.empty(0, int), np.empty(0))]
    for k in range(len(mine)):
        gap = np.maximum(np.maximum(lo[k:] - hi[k], lo[k] - hi[k:]), 0.0)
        near = k + np.flatnonzero(np.einsum("ij,ij->i", gap, gap) <= radius2)
        for at in range(0, len(near), 64):
            rows = np.concatenate([np.arange(ends[x], ends[x + 1]) for x in near[at : at + 64]])
            flat = np.flatnonzero(single[ends[k] : ends[k + 1]] @ single[rows].T >= np.float32(least - 3e-6))
            a, b = order[ends[k] + flat // len(rows)], order[rows[flat % len(rows)]]
            good = (docs[a] != docs[b]) & ((scopes[a] != scopes[b]) | (scopes[a] < 0))
            a, b = a[good], b[good]
            s = np.floor(np.einsum("ij,ij->i", units[a], units[b]) * 1e6 + 0.5) / 1e6
            a, b, s = a[s >= threshold], b[s >= threshold], s[s >= threshold]
            found.append(_firsts(np.r_[a, b], np.r_[b, a], np.r_[s, s], docs))
    return _firsts(*(np.concatenate(x) for x in zip(*found)), docs)


def _firsts(a: np.ndarray, b: np.ndarray, s: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best of each a, ties to the first document."""
    order = np.lexsort((docs[b], -s, a))
    a, b, s = a[order], b[order], s[order]
    new = np.flatnonzero(np.r_[True, a[1:] != a[:-1]][: len(a)])
    return a[new], b[new], s[new]


def _units_of(vectors) -> np.ndarray:
    """The vectors of an Arrow column at length 1."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    sizes = np.unique(vectors.value_lengths().to_numpy(zero_copy_only=False))
    if len(sizes) > 1:
        raise ValueError("vectors must be of one length")
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _boxes(points: np.ndarray, wanted: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of ``wanted`` or more boxes (a power of two) that fill the space, cut at medians of points
    across the axis of the widest spread."""
    size = points.shape[1]
    boxes = [(np.full(size, -np.inf), np.full(size, np.inf), points)]
    while len(boxes) < wanted:
        new = []
        for lo, hi, own in boxes:
            axis = int(own.std(axis=0).argmax()) if len(own) else 0
            at = float(np.median(own[:, axis])) if len(own) else min(max(0.0, lo[axis]), hi[axis])
            up, down = lo.copy(), hi.copy()
            up[axis] = down[axis] = at
            new += [(lo, down, own[own[:, axis] < at]), (up, hi, own[own[:, axis] >= at])]
        boxes = new
    return np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])


def _leaves(points: np.ndarray, rows: np.ndarray, size: int) -> list[np.ndarray]:
    """The rows in groups of at most ``size`` that lie together."""
    todo, out = [rows] if len(rows) else [], []
    while todo:
        own = todo.pop()
        if len(own) <= size:
            out.append(own)
            continue
        axis = int(points[own].std(axis=0).argmax())
        order = own[np.argpartition(points[own, axis], len(own) // 2)]
        todo += [order[: len(own) // 2], order[len(own) // 2 :]]
    return out


def dedupe_batch(batch: DataFrame, existing: DataFrame, corpus: DataFrame, threshold: float = NEAR, enabled: bool = True) -> tuple[DataFrame, DataFrame]:
    """(kept, skipped) of the chunks of incoming documents.

    batch: document, chunk_index, page, hash, vector; existing: hash (of the workspace's other documents); corpus: doc,
    vector, scope (their vectors). A chunk is skipped as 'exact' (similarity 1) if its hash exists or an earlier chunk of
    its document has it; else as 'near' if its nearest vector of another document reaches ``threshold`` (matched_chunk), or
    the first earlier kept chunk of its own document that does. kept: document, chunk_index (dense from 0), old_index,
    hash, vector; skipped: document, chunk_index, page, reason, similarity, matched_chunk. With ``enabled`` false all are
    kept. Documents go one by one through the last step, which depends on the order of their chunks.
    """
    data = batch.select("document", "chunk_index", "page", "hash", "vector")
    if not enabled:
        return renumbered(data.withColumn("old_index", F.col("chunk_index")), "document", "old_index").drop("chunk_index").withColumnRenamed("new_index", "chunk_index").select("document", "chunk_index", "old_index", "hash", "vector"), data.select("document", "chunk_index", "page", F.lit("").alias("reason"), F.lit(0.0).alias("similarity"), F.lit(None).cast("string").alias("matched_chunk")).filter("false")
    again = Window.partitionBy("document", "hash").orderBy("chunk_index")
    marked = data.withColumn("_n", F.row_number().over(again)).join(existing.select("hash").distinct().withColumn("_known", F.lit(True)), "hash", "left")
    exact = F.col("_known").isNotNull() | (F.col("_n") > 1)
    marked = marked.withColumn("exact", exact).drop("_n", "_known")
    asked = marked.filter("not exact").select(F.concat_ws("#", "document", "chunk_index").alias("query"), "vector", F.col("document").alias("scope"))
    near = top_k(asked, corpus.select(F.col("doc").cast("string").alias("doc"), "vector", "scope"), 1, least=threshold).select("query", F.col("doc").alias("matched_chunk"), F.col("score").alias("best"))
    joined = marked.withColumn("query", F.concat_ws("#", "document", "chunk_index")).join(near, "query", "left").drop("query")
    kind = batch.schema["document"].dataType.simpleString()
    schema = f"document {kind}, chunk_index int, page int, hash string, vector array<double>, reason string, similarity double, matched_chunk string"

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk_index", ignore_index=True)
        reasons, similar, kept = [], [], []
        for row, exact, best in zip(group["vector"], group["exact"], group["best"]):
            reason, value = None, None
            if exact:
                reason, value = "exact", 1.0
            elif best == best and best is not None:
                reason, value = "near", float(best)
            elif row is not None:
                v = np.asarray(row, np.float64)
                v = v / (np.linalg.norm(v) or 1.0)
                close = np.flatnonzero(np.array(kept) @ v >= threshold) if kept else []
                if len(close):
                    reason, value = "near", float(kept[close[0]] @ v)
                else:
                    kept.append(v)
            reasons.append(reason)
            similar.append(value)
        return group.assign(reason=reasons, similarity=similar)[["document", "chunk_index", "page", "hash", "vector", "reason", "similarity", "matched_chunk"]]

    judged = joined.groupBy("document").applyInPandas(one, schema)
    kept = renumbered(judged.filter("reason is null").withColumnRenamed("chunk_index", "old_index"), "document", "old_index")
    return kept.select("document", F.col("new_index").alias("chunk_index"), "old_index", "hash", "vector"), judged.filter("reason is not null").select("document", "chunk_index", "page", "reason", rounded(F.col("similarity")).alias("similarity"), "matched_chunk")


def renumbered(kept: DataFrame, document: str, order: str) -> DataFrame:
    """Kept chunks with dense numbers from 0 in their document."""
    return kept.withColumn("new_index", F.row_number().over(Window.partitionBy(document).orderBy(order)) - 1)
