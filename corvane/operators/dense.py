"""Exact vector search in blocks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType

from corvane.context import materialize
from corvane.operators.sparse import ranked

#: Rows in a piece of a block, and queries that meet it at once; how far below the least score single precision may err.
BLOCK, PIECE, MARGIN = 4096, 1024, 5e-6


def pad_or_trim(vector: Column, size: int) -> Column:
    """The vector with exactly ``size`` places, filled with zeros."""
    return F.slice(F.concat(vector.cast("array<double>"), F.array_repeat(F.lit(0.0), size)), 1, size)


def cosine_column(a: Column, b: Column) -> Column:
    """Cosine of two array columns; 0 where a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def _units(vectors: pd.Series) -> np.ndarray:
    m = np.array(vectors.tolist(), np.float64)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def _cosines(left: pd.Series, right: pd.Series) -> np.ndarray:
    """All cosines of two lists of vectors; those of unequal length are compared over the shorter one's places."""
    sizes = [v.map(len).to_numpy() for v in (left, right)]
    if len(set(sizes[0]) | set(sizes[1])) == 1:
        return _units(left) @ _units(right).T
    out = np.zeros((len(left), len(right)))
    for a in set(sizes[0]):
        for b in set(sizes[1]):
            rows, columns, n = np.flatnonzero(sizes[0] == a), np.flatnonzero(sizes[1] == b), min(a, b)
            if n:
                cut = lambda v, at, n=n: v.iloc[at].map(lambda x: x[:n])
                out[np.ix_(rows, columns)] = _units(cut(left, rows)) @ _units(cut(right, columns)).T
    return out


def top_k(queries: DataFrame, rows: DataFrame, k: int, least: float | None = None, block: int = BLOCK) -> DataFrame:
    """query, doc, rank and score (6 digits) of the ``k`` most similar rows of each query, by cosine, ties by doc.

    ``queries`` has query, vector and, like ``rows`` (doc, vector), a scope; rows of the query's scope are left out where
    both have one (own documents); a null scope is none. Where ``queries`` has a column allowed (ARRAY<STRING>) that
    isn't null, only rows whose document it holds are given. Null vectors match nothing; a zero vector has cosine 0;
    vectors of unequal length are compared over the shorter one's places. Every query meets every row, in blocks: rows
    are dealt by a hash into about as many blocks as there are cores, queries into as few as memory allows, since each
    pair of blocks sends k rows a query to the shuffle. A task multiplies its pair piece by piece (``block`` rows),
    in single precision first; what may be among the best k is computed again in double precision. Nothing is broadcast
    or collected.
    """
    scoped = "scope" in queries.columns and "scope" in rows.columns
    limited = "allowed" in queries.columns and "document" in rows.columns
    text = lambda there, name: (F.col(name) if there else F.lit(None)).cast("string").alias(name)
    keep = lambda df, key, *more: df.filter("vector is not null").select(key, F.col("vector").cast("array<double>").alias("vector"), text(scoped, "scope"), *more)
    q = materialize(keep(queries, "query", (F.col("allowed") if limited else F.lit(None)).cast("array<string>").alias("allowed")), "asked-vectors")
    r = materialize(keep(rows, "doc", text(limited, "document")), "vectors")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    n_q, n_r = max(1, math.ceil(q.count() / (16 * block))), r.count()
    n_r = max(1, math.ceil(n_r / (64 * block)), min(math.ceil(n_r / block), cores))
    q = q.withColumn("qb", F.pmod(F.xxhash64("query"), F.lit(n_q))).withColumn("rb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_r - 1).cast("bigint"))))
    r = r.withColumn("rb", F.pmod(F.xxhash64("doc"), F.lit(n_r))).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_q - 1).cast("bigint"))))
    kinds = [("query", q.schema["query"].dataType), ("doc", r.schema["doc"].dataType), ("score", DoubleType())]
    columns = pa.schema([(name, to_arrow_type(kind)) for name, kind in kinds])

    def pair(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return columns.empty_table()
        left, right = left.combine_chunks(), right.sort_by("doc").combine_chunks()
        same = one_length(left.column("vector"), right.column("vector"))
        u, v = (rows_of(x.column("vector"), same) for x in (left, right))
        scopes = pd.factorize(np.concatenate([x.column("scope").to_numpy() for x in (left, right)]))[0] if scoped else None
        allowed = [(n, a) for n, a in enumerate(left.column("allowed").to_pylist()) if a is not None] if limited else []
        documents = right.column("document").to_pandas() if allowed else None
        query, match, value = [], [], []
        for start in range(0, len(u), PIECE):
            own, mine = u[start : start + PIECE], [(n - start, a) for n, a in allowed if start <= n < start + PIECE]
            floor = np.full(len(own), -1.5 if least is None else max(-1.5, least - MARGIN))
            a, b, s = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
            for at in range(0, len(v), block):
                other = v[at : at + block]
                score = own.astype(np.float32) @ other.T.astype(np.float32) if same else _cosines(pd.Series(list(own)), pd.Series(list(other)))
                if scoped:
                    mark = scopes[start : start + len(own)]
                    score[(mark[:, None] == scopes[None, len(u) + at : len(u) + at + len(other)]) & (mark >= 0)[:, None]] = -2
                for n, names in mine:
                    score[n, ~documents.iloc[at : at + block].isin(set(names)).to_numpy()] = -2
                short = np.flatnonzero(np.bincount(a, minlength=len(own)) < k)
                limit = floor.copy()
                if len(short) and len(other) > k:
                    limit[short] = np.maximum(limit[short], np.partition(score[short], -k, axis=1)[:, -k] - MARGIN)
                x, y = np.nonzero(score >= limit[:, None].astype(score.dtype))
                exact = np.einsum("ij,ij->i", own[x], other[y]) if same else score[x, y]
                exact = np.floor(exact * 1e6 + 0.5) / 1e6
                good = slice(None) if least is None else exact >= least
                a, b, s = np.concatenate([a, x[good]]), np.concatenate([b, y[good] + at]), np.concatenate([s, exact[good]])
                order = np.lexsort((b, -s, a))
                a, b, s = a[order], b[order], s[order]
                place = np.arange(len(a)) - np.searchsorted(a, a)
                a, b, s, last = a[place < k], b[place < k], s[place < k], place[place < k] == k - 1
                floor[a[last]] = np.maximum(floor[a[last]], s[last] - MARGIN)
            query, match, value = query + [a + start], match + [b], value + [s]
        at = lambda x: pa.array(np.concatenate(x))
        return pa.table([left.column("query").take(at(query)), right.column("doc").take(at(match)), at(value)], names=columns.names).cast(columns)

    schema = ", ".join(f"{name} {kind.simpleString()}" for name, kind in kinds)
    return ranked(q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInArrow(pair, schema), k)


def one_length(*vectors: pa.ChunkedArray) -> bool:
    """Whether all vectors of the columns have the same length."""
    return len(set().union(*(pc.unique(pc.list_value_length(v)).to_pylist() for v in vectors))) == 1


def rows_of(vectors: pa.ChunkedArray | pa.Array, same: bool = True) -> np.ndarray:
    """The vectors of an Arrow column, at length 1 if they have the same number of places, else as they are."""
    if not same:
        out = np.empty(len(vectors), object)
        out[:] = [np.asarray(v, np.float64) for v in vectors.to_pylist()]
        return out
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    m = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


@F.arrow_udf(returnType=ArrayType(DoubleType()))
def _letters(lower: pa.Array) -> pa.Array:
    text = lower.cast(pa.large_binary())
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    counts, at = np.zeros((len(text), 26)), 0
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + (1 << 22), "right")) - 1)
        letter = data[ends[at] : ends[to]] - 97  # wraps round, so other bytes are 26 or more
        row = np.repeat(np.arange(to - at), np.diff(ends[at : to + 1]))
        counts[at:to] = np.bincount((row * 26 + letter)[letter < 26], minlength=(to - at) * 26).reshape(-1, 26)
        at = to
    return pa.ListArray.from_arrays(pa.array(np.arange(len(text) + 1, dtype=np.int32) * 26), pa.array(counts.ravel()), mask=text.is_null() if text.null_count else None)


def letter_profile(text: Column) -> Column:
    """How often each letter from a to z comes in a text, in lower case: a vector that needs no model. Null for null.
    Counted in one pass over the bytes, which no other letter of UTF-8 shares."""
    return _letters(F.lower(text))


def embed(df: DataFrame, text: str, embedder, out: str = "vector", keep: list[str] | None = None) -> DataFrame:
    """Vectors of texts by a given function from a list of texts to a list of vectors, a batch at a time; a null text is
    embedded as the empty one."""
    kept = keep or [c for c in df.columns if c != text]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*kept).schema.fields) + f", {out} array<double>"

    def run(batches):
        for b in batches:
            yield b[kept].assign(**{out: [list(map(float, v)) for v in embedder([t or "" for t in b["_text"]])]})

    return df.select(*kept, F.col(text).alias("_text")).mapInPandas(run, schema)


def hashing_embedder(size: int = 64):
    """A fixed embedder without a model: signed counts of hashed words."""

    def of(texts: list[str]) -> list[list[float]]:
        import xxhash

        out = []
        for t in texts:
            v = [0.0] * size
            for w in t.lower().split():
                h = xxhash.xxh3_64_intdigest(w)
                v[h % size] += 1.0 if h >> 63 else -1.0
            out.append(v)
        return out

    return of


