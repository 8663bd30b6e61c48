"""BM25 over an inverted index held as tables."""

from __future__ import annotations

import math
from copy import copy

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.context import materialize
from corvane.functions.terms import rounded, terms

K1, B = 1.5, 0.75
#: Queries and documents in a block, and the documents from which on a further block pays.
BLOCK, LEAST_BLOCK = 4096, 1024


class SparseIndex:
    """postings (doc, term, tf), lengths (doc, dl), vocabulary (term, df) and stats (n, avgdl; one row).

    Texts are cut into terms once, and the postings are written to the shared folder. Documents without terms are in
    none of the tables. ``scope`` names a column of the documents (such as their file's id) to which queries may be
    restricted; counts and statistics stay those of the whole index.
    """

    def __init__(self, docs: DataFrame, doc: str, text: Column, scope: str | None = None) -> None:
        self.columns = (doc, text, scope)
        self._hold(self._named(docs), materialize(self._counted(docs).sortWithinPartitions("doc"), "postings"))

    def _named(self, docs: DataFrame) -> DataFrame:
        doc, _, scope = self.columns
        return docs.select(F.col(doc).alias("doc"), (F.col(scope) if scope else F.lit(None)).cast("string").alias("scope"))

    def _counted(self, docs: DataFrame) -> DataFrame:
        doc, text, _ = self.columns
        # dealt by doc before they are cut, so the counts need no shuffle of their own, which would be wider than the texts
        texts = docs.select(F.col(doc).alias("doc"), text.alias("_text")).repartition("doc")
        return terms(texts, F.col("_text")).groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))

    def refreshed(self, changed: DataFrame, gone: DataFrame | None = None) -> SparseIndex:
        """The index with the documents of ``changed`` (the columns it was made of) in place of theirs, and without those of
        ``gone`` (doc). Only the changed texts are cut into terms."""
        new = self._named(changed)
        out = new.select("doc") if gone is None else new.select("doc").unionByName(gone.select("doc"))
        kept = lambda df: df.join(out.distinct(), "doc", "left_anti")
        other = copy(self)
        other._hold(materialize(kept(self.docs).unionByName(new), "indexed"), materialize(kept(self.postings).unionByName(self._counted(changed)), "postings"))
        return other

    def _hold(self, docs: DataFrame, postings: DataFrame) -> None:
        self.docs, self.postings, self.scoped = docs, postings, self.columns[2] is not None
        self.lengths = self.postings.groupBy("doc").agg(F.sum("tf").alias("dl"))
        self.vocabulary = self.postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        self.stats = self.lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))

    def search(self, queries: DataFrame, query: str, text: Column, limit: int = 10) -> DataFrame:
        """The best ``limit`` documents of each query: query, doc, rank, score (6 digits), matched; ties by doc. Repeated
        query terms count once. Where ``queries`` has a column allowed (ARRAY<STRING>) that isn't null, only documents
        whose scope it holds are given; an empty one gives none.

        Queries and documents are dealt into blocks by a hash. A block of documents holds their postings of asked terms
        and their lengths; one task scores a block of queries against it, and only the best ``limit`` of each leave it, so
        no row is ever made for a query and a posting, and a common term is spread over all blocks.
        """
        allowed = F.col("allowed") if "allowed" in queries.columns else F.lit(None).cast("array<string>")
        every = queries.select(F.col(query).alias("query"), text.alias("_text"), allowed.alias("allowed"))
        words = terms(every.select("query", "_text"), F.col("_text")).select("query", "term").distinct()
        asked = materialize(words, "asked-terms")
        known = asked.select("term").distinct()
        n, avgdl = self.stats.first() or (0, None)
        # few blocks of queries, since each moves all postings once, and no more of documents than there are cores or a
        # task can hold, since each sends the best of every query
        n_q = max(1, math.ceil(every.count() / (16 * BLOCK)))
        n_d = max(1, math.ceil(n / (4 * BLOCK)), min(math.ceil(n / LEAST_BLOCK), self.postings.sparkSession.sparkContext.defaultParallelism))
        idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weighted = asked.join(self.vocabulary.join(known, "term", "left_semi"), "term").select("query", "term", idf.alias("idf"))
        scopes = every.select("query", "allowed").filter("allowed is not null").withColumn("term", F.lit(None).cast("string")).withColumn("idf", F.lit(None).cast("double"))
        left = weighted.withColumn("allowed", F.lit(None).cast("array<string>")).unionByName(scopes)
        deal = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
        every_block = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = left.withColumn("qb", deal("query", n_q)).withColumn("db", every_block(n_d))
        of_doc = self.lengths.join(self.docs.filter("scope is not null").distinct(), "doc", "left") if self.scoped else self.lengths.withColumn("scope", F.lit(None).cast("string"))
        right = self.postings.select("doc", "term", "tf", F.lit(None).cast("string").alias("scope")).unionByName(of_doc.select("doc", F.lit(None).cast("string").alias("term"), F.col("dl").alias("tf"), "scope"))
        right = right.withColumn("db", deal("doc", n_d)).withColumn("qb", every_block(n_q))
        mean = float(avgdl or 1.0)
        columns = ["query", "doc", "score", "matched"]

        def block(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
            nothing = pd.DataFrame({c: [] for c in columns})
            if q.empty or d.empty:
                return nothing
            whole, hits = d[d["term"].isna()].sort_values("doc", kind="stable"), d[d["term"].isin(q["term"].dropna().unique())]
            docs, lengths = whole["doc"].to_numpy(), whole["tf"].to_numpy(np.float64)
            place = pd.Index(docs).get_indexer(hits["doc"])
            tf = hits["tf"].to_numpy(np.float64)
            part = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[place] / mean))
            of, names = pd.factorize(hits["term"])
            order = np.lexsort((place, of))
            place, part, ends = place[order], part[order], np.searchsorted(of[order], np.arange(len(names) + 1))
            number = {name: i for i, name in enumerate(names)}
            limits = {k: set(a) for k, a in zip(q["query"], q["allowed"]) if a is not None and not np.isscalar(a)} if q["allowed"].notna().any() else {}
            found = []
            for k, own in q[q["term"].notna()].groupby("query", sort=False):
                spans = [(number[t], w) for t, w in sorted(zip(own["term"], own["idf"])) if t in number]
                if not spans:
                    continue
                at = np.concatenate([place[ends[i] : ends[i + 1]] for i, _ in spans])
                scores = np.bincount(at, weights=np.concatenate([w * part[ends[i] : ends[i + 1]] for i, w in spans]), minlength=len(docs))
                if k in limits:
                    scores[~whole["scope"].isin(limits[k]).to_numpy()] = 0
                # the greatest of some stretches bound the last of the best from below; a document with a term scores above 0
                least = 0.0
                if len(docs) >= 64 * limit:
                    tops = scores[: len(docs) // 32 * 32].reshape(-1, 32).max(axis=1)
                    least = np.partition(tops, -limit)[-limit] - 2e-6
                rows = np.flatnonzero(scores >= least) if least > 0 else np.flatnonzero(scores)
                value = np.floor(scores[rows] * 1e6 + 0.5) / 1e6
                best = np.argsort(-value, kind="stable")[:limit]
                rows, value = rows[best], value[best]
                matched = np.zeros(len(rows), np.int64)
                for i, _ in spans:
                    held = place[ends[i] : ends[i + 1]]
                    spot = np.minimum(np.searchsorted(held, rows), len(held) - 1)
                    matched += held[spot] == rows
                found.append((k, rows, value, matched))
            if not found:
                return nothing
            names, rows, value, matched = zip(*found)
            rows = np.concatenate(rows)
            return pd.DataFrame({"query": np.repeat(np.array(names, object), [len(x) for x in value]), "doc": docs[rows], "score": np.concatenate(value), "matched": np.concatenate(matched)})

        schema = f"query {left.schema['query'].dataType.simpleString()}, doc {right.schema['doc'].dataType.simpleString()}, score double, matched long"
        return ranked(left.groupBy("qb", "db").cogroup(right.groupBy("qb", "db")).applyInPandas(lambda q, d: block(q, d)[columns], schema), limit)

    def coverage(self, queries: DataFrame, query: str, text: Column) -> DataFrame:
        """query, n_terms and coverage: the share of a query's distinct whole terms that the index has, or, where the
        column allowed isn't null, that a document of these scopes has; 0 without terms."""
        every = queries.select(F.col(query).alias("query"), text.alias("_text"))
        asked = terms(every, F.col("_text"), expand=False).select("query", "term").distinct()
        found = asked.join(self.vocabulary.select("term", F.lit(1).alias("hit")), "term", "left")
        if "allowed" in queries.columns:
            within = queries.filter("allowed is not null").select(F.col(query).alias("query"), "allowed")
            pairs = within.select("query", F.explode("allowed").alias("scope")).distinct()
            by_scope = self.postings.join(asked.select("term").distinct(), "term", "left_semi").join(self.docs, "doc").select("scope", "term").distinct()
            seen = asked.join(pairs, "query").join(by_scope, ["scope", "term"], "left_semi").select("query", "term").distinct().withColumn("inside", F.lit(1))
            limited = within.select("query", F.lit(1).alias("limited")).distinct()
            found = found.join(limited, "query", "left").join(seen, ["query", "term"], "left").withColumn("hit", F.when(F.col("limited").isNull(), F.col("hit")).otherwise(F.col("inside")))
        found = found.groupBy("query").agg(F.count(F.lit(1)).alias("n_terms"), F.count("hit").alias("hits"))
        return every.select("query").distinct().join(found, "query", "left").select("query", F.coalesce("n_terms", F.lit(0)).alias("n_terms"), rounded(F.coalesce(F.col("hits") / F.col("n_terms"), F.lit(0.0)), 6).alias("coverage"))


def ranked(scored: DataFrame, limit: int, score: str = "score") -> DataFrame:
    """The best rows of each query by ``score``, then doc, with rank from 1."""
    w = Window.partitionBy("query").orderBy(F.col(score).desc(), F.col("doc"))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def lexical_rerank(pool: DataFrame, queries: DataFrame, query: str, text: Column, postings: DataFrame | None = None) -> DataFrame:
    """Pools (query, doc, rank, and text and, if there is one, heading) ordered anew: query, doc, rank, rerank_score.

    A term weighs the more the fewer documents of the query's pool have it. Equal scores keep the order of the pool;
    pools of queries without terms stay as they are, without scores. ``postings`` (doc, term) of an index spare the
    texts; else each document is cut into terms once, however many pools it is in. Null texts have no terms.
    """
    asked = terms(queries.select(F.col(query).alias("query"), text.alias("_text")), F.col("_text")).select("query", "term").distinct()
    if postings is None:
        told = F.concat_ws(" ", *(["heading"] if "heading" in pool.columns else []), "text")
        postings = terms(pool.select("doc", told.alias("_told")).dropDuplicates(["doc"]), F.col("_told"))
    wide = asked.groupBy("query").agg(F.count(F.lit(1)).alias("q"))
    of_query = Window.partitionBy("query")
    sized = pool.select("query", "doc", "rank").withColumn("p", F.count(F.lit(1)).over(of_query))
    has = sized.join(asked, "query").join(postings.select("doc", "term").distinct(), ["doc", "term"], "left_semi")
    weighed = has.withColumn("df", F.count(F.lit(1)).over(Window.partitionBy("query", "term")))
    sums = weighed.groupBy("query", "doc").agg(F.sum(F.log(1 + F.col("p") / F.col("df"))).alias("s"))
    full = sized.join(wide, "query", "left").join(sums, ["query", "doc"], "left")
    score = rounded(F.least(F.lit(1.0), F.coalesce(F.col("s") / (F.col("q") * F.log(1 + F.col("p"))), F.lit(0.0))), 6)
    scored = full.select("query", "doc", F.col("rank").alias("_prior"), F.when(F.col("q").isNotNull(), score).alias("rerank_score"))
    w = of_query.orderBy(F.col("rerank_score").desc_nulls_last(), "_prior", "doc")
    return scored.withColumn("rank", F.row_number().over(w)).select("query", "doc", "rank", "rerank_score")
