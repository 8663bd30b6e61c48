import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import dedup, dense, fusion, retrieval, sparse

CHUNKS = "id string, document_id string, chunk_index int, page int, heading string, text string, note string"


@pytest.fixture(scope="module")
def passages(spark):
    rows = [(f"c{k}", "d1", k, 1, "Cache", text, "x") for k, text in enumerate(["the cache keeps a lock", "the broker drains the queue", "a quiet queue waits", "the ledger counts rows", "rows leave the ledger", None, ""])]
    rows += [("e0", "d2", 0, None, None, "a lock on the ledger", "x"), ("e0", "d2", 0, None, None, "a lock on the ledger", "x"), ("f0", "d3", None, 2, "Queue", "zebra", "x")]
    return retrieval.passages_of(spark.createDataFrame(rows, CHUNKS), spark.createDataFrame([("d1", "one.md"), ("d2", "two.md")], "id string, filename string"))


def questions(spark, rows):
    df = spark.createDataFrame([(q, t, a) for q, t, a in rows], "query string, text string, allowed array<string>")
    return df.withColumn("vector", dense.letter_profile(F.col("text")))


def test_hybrid_sources_and_statistics(spark, passages):
    asked = questions(spark, [("q1", "lock of the ledger", None), ("q2", "the", None), ("q3", "lock ledger", ["d2"]), ("q4", "lock ledger", []), ("q5", None, None)])
    sources, stats = retrieval.retrieve(passages, asked, retrieval.RetrieveOptions(top_k=2))
    found = {(r["query"], r.citation): r for r in sources.collect()}
    assert found["q1", 1].chunk == "e0" and found["q1", 1].filename == "two.md" and found["q1", 1].page == 1 and found["q1", 1].retrieved_by == "dense,sparse"
    assert {r.chunk for (q, _), r in found.items() if q == "q3"} == {"e0"} and not [k for k in found if k[0] in ("q4", "q5")]
    near = [r for (q, _), r in found.items() if q == "q1" and r.retrieved_by == "neighbor"]
    assert 0 < len(near) <= 2 and all(r.rerank_score is None and r.score is not None for r in near)
    rows = {r["query"]: r for r in stats.collect()}
    assert set(rows) == {"q1", "q2", "q3", "q4", "q5"} and rows["q1"].keyword_coverage == 1.0 and rows["q2"].keyword_coverage == 0.0 and rows["q2"].mean_rerank_score is None and rows["q2"].rerank_used
    assert rows["q3"].documents_searched == 1 and rows["q4"].documents_searched == 0 and rows["q1"].documents_searched == 3 and rows["q4"].passages_returned == 0 and rows["q4"].keyword_coverage == 0.0
    only = retrieval.retrieve(passages, asked, retrieval.RetrieveOptions("sparse", 2, rerank=False, expand=False))[0].filter("query = 'q1'").collect()
    assert [r.retrieved_by for r in only] == ["sparse"] * 2 and all(r.dense_score is None for r in only)
    modes = {r["mode"] for r in retrieval.compare_modes(passages, asked.filter("query = 'q1'"), retrieval.RetrieveOptions(top_k=2)).collect()}
    assert modes == {"hybrid", "dense", "sparse"}
    with pytest.raises(ValueError):
        retrieval.RetrieveOptions(top_k=13)


def test_rerank_by_a_scorer(spark):
    pool = spark.createDataFrame([("q", "a", 1, "x"), ("q", "b", 2, "lock"), ("bad", "a", 1, "x"), ("bad", "b", 2, "lock"), ("one", "a", 1, "x")], "query string, doc string, rank int, text string")
    asked = spark.createDataFrame([("q", "go"), ("bad", "fail lock"), ("one", "go")], "query string, text string")

    def scorer(question, passages):
        if "fail" in question:
            raise RuntimeError("no model")
        return {1: 1.7}

    got = {(r["query"], r.doc): (r["rank"], r.rerank_score, r.backend) for r in retrieval.rerank(pool, asked, scorer).collect()}
    assert got["q", "b"] == (1, 1.0, "model") and got["q", "a"] == (2, 0.0, "model") and got["one", "a"] == (1, None, "none")
    assert got["bad", "b"][0] == 1 and got["bad", "b"][2] == "lexical"


def test_lexical_rerank_keeps_pools_without_terms(spark):
    pool = spark.createDataFrame([("q", "a", 1, "H lock", "one"), ("q", "b", 2, None, "lock lock"), ("q", "c", 3, None, None), ("w", "b", 1, None, "x"), ("w", "a", 2, None, "y")], "query string, doc string, rank int, heading string, text string")
    asked = spark.createDataFrame([("q", "the lock"), ("w", "the of")], "query string, text string")
    rows = [(r["query"], r.doc, r.rerank_score) for r in sparse.lexical_rerank(pool, asked, "query", F.col("text")).orderBy("query", "rank").collect()]
    assert [(q, d) for q, d, _ in rows] == [("q", "a"), ("q", "b"), ("q", "c"), ("w", "b"), ("w", "a")] and rows[0][2] == rows[1][2] > rows[2][2] == 0.0 and rows[3][2] is None


def test_search_in_blocks_is_search_in_one(spark, monkeypatch):
    rng = np.random.default_rng(3)
    words = [f"w{n}" for n in range(60)]
    docs = [(n, " ".join(rng.choice(words, rng.integers(1, 40))) if n % 9 else None) for n in range(150)]
    df = spark.createDataFrame(docs, "doc int, text string")
    asked = spark.createDataFrame([(q, " ".join(rng.choice(words, 4))) for q in range(12)], "q int, text string")
    index = sparse.SparseIndex(df, "doc", F.col("text"))
    run = lambda: sorted(map(tuple, index.search(asked, "q", F.col("text"), 7).select("query", "doc", "rank", "score", "matched").collect()))
    whole = run()
    monkeypatch.setattr(sparse, "BLOCK", 5)
    assert run() == whole and len(whole) == 12 * 7
    assert index.search(asked.limit(0), "q", F.col("text")).count() == 0 and sparse.SparseIndex(df.limit(0), "doc", F.col("text")).search(asked, "q", F.col("text")).count() == 0


def test_refreshed_index_is_a_new_one(spark):
    df = lambda *rows: spark.createDataFrame(list(rows), "doc int, text string")
    asked = spark.createDataFrame([("q", "alpha beta gamma")], "q string, text string")
    run = lambda index: sorted(map(tuple, index.search(asked, "q", F.col("text")).collect()))
    old = sparse.SparseIndex(df((1, "alpha"), (2, "beta beta"), (3, "gamma")), "doc", F.col("text"))
    new = old.refreshed(df((2, "alpha beta"), (4, "gamma delta")), df((3, None)).select("doc"))
    assert run(new) == run(sparse.SparseIndex(df((1, "alpha"), (2, "alpha beta"), (4, "gamma delta")), "doc", F.col("text"))) != run(old)


def test_files_by_name(spark, tmp_path):
    from corvane.sources import loaders

    for name in ("b.md", "a.txt", "c.exe"):
        (tmp_path / name).write_text(name * 3)
    assert [(r.filename, bytes(r.content)) for r in loaders.read_files(spark, str(tmp_path)).collect()] == [("a.txt", b"a.txt" * 3), ("b.md", b"b.md" * 3)]
    assert loaders.read_files(spark, str(tmp_path), most_bytes=3).count() == 0


def test_vectors_of_unequal_length_and_scopes(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0, 5.0], None), (2, [0.0, 1.0], None), (3, [1.0], "s"), (4, None, "s"), (5, [0.0, 0.0], "s")], "doc int, vector array<double>, scope string")
    asked = spark.createDataFrame([(9, [1.0, 0.0], None), (8, [1.0, 0.0], "s")], "query int, vector array<double>, scope string")
    got = {(r["query"], r.doc): r.score for r in dense.top_k(asked, rows, 9).collect()}
    assert got == {(9, 1): 1.0, (9, 2): 0.0, (9, 3): 1.0, (9, 5): 0.0, (8, 1): 1.0, (8, 2): 0.0}
    inside = rows.drop("scope").withColumn("document", F.concat(F.lit("d"), "doc"))
    limited = spark.createDataFrame([(9, [1.0, 0.0], ["d2"]), (8, [1.0, 0.0], []), (7, [1.0, 0.0], None)], "query int, vector array<double>, allowed array<string>")
    assert sorted((r["query"], r.doc) for r in dense.top_k(limited, inside, 9).collect()) == [(7, 1), (7, 2), (7, 3), (7, 5), (9, 2)]


def test_overlap_with_an_empty_mode(spark):
    runs = spark.createDataFrame([("d", "q", 1), ("d", "q", 2), ("s", "q", 2), ("d", "r", 3)], "mode string, query string, doc int")
    assert {(r["query"], r.shared, r.jaccard) for r in fusion.mode_overlap(runs).collect()} == {("q", 1, 0.5), ("r", 0, 0.0)}


def test_hashed_near_duplicates_recall(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 16))
    rows = [(3 * n + k, [float(x) for x in v + (k > 0) * rng.normal(size=16) * 0.02], k) for n, v in enumerate(base) for k in range(3)] + [(900 + k, [1.0] * 16, 7) for k in range(40)] + [(999, None, 1), (998, [1.0] * 16, 8)]
    df = spark.createDataFrame(rows, "doc int, vector array<double>, scope int")
    exact = {r["query"]: (r.doc, r.score) for r in dedup.near_duplicates(df, 0.95).collect()}
    hashed = {r["query"]: (r.doc, r.score) for r in dedup.near_duplicates_hashed(df, 0.95, block=8).collect()}
    assert len(exact) >= 200 and set(hashed) <= set(exact) and sum(hashed.get(k) == v for k, v in exact.items()) >= 0.9 * len(exact)
    assert dedup.near_duplicates_hashed(df.limit(0)).count() == 0


def test_dedupe_of_a_batch(spark):
    v = lambda x, y: [float(x), float(y)]
    rows = [("d", 0, 1, "h0", v(1, 0)), ("d", 1, 1, "known", v(0, 1)), ("d", 2, 1, "h0", v(5, 5)), ("d", 3, 2, "h3", v(1, 0.01)), ("d", 4, 2, "h4", v(0.02, 1)), ("d", 5, 2, "h5", v(1, 1)), ("d", 6, 2, "h6", None), ("z", 0, 1, "z0", v(1, 0))]
    batch = spark.createDataFrame(rows, "document string, chunk_index int, page int, hash string, vector array<double>")
    existing = spark.createDataFrame([("known",)], "hash string")
    corpus = spark.createDataFrame([("far", v(0, 1), "other"), ("own", v(1, 1), "d")], "doc string, vector array<double>, scope string")
    kept, skipped = dedup.dedupe_batch(batch, existing, corpus)
    assert sorted((r.document, r.chunk_index, r.old_index) for r in kept.collect()) == [("d", 0, 0), ("d", 1, 5), ("d", 2, 6), ("z", 0, 0)]
    assert sorted((r.chunk_index, r.reason, r.matched_chunk) for r in skipped.collect()) == [(1, "exact", None), (2, "exact", None), (3, "near", None), (4, "near", "far")]
    kept, skipped = dedup.dedupe_batch(batch, existing, corpus, enabled=False)
    assert kept.count() == 8 and skipped.count() == 0
    order = spark.createDataFrame([("b", "w", "T", 1), ("a", "w", "t", 2)], "id string, w string, text string, at int")
    assert [tuple(r) for r in dedup.exact_duplicates(order, "id", "w", order=["at"]).collect()] == [("a", "b")]


def shuffled(spark) -> int:
    return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()


def test_hashed_near_duplicates_moves_little_and_misses_none(spark):
    rng = np.random.default_rng(6)
    v = 1 + 0.2 * rng.normal(size=(1500, 26))
    rows = [(n, [float(x) for x in v[n % 1500] + (n >= 1500) * 0.02 * rng.normal(size=26)], n % 7) for n in range(3000)]
    df = spark.createDataFrame(rows, "doc int, vector array<double>, scope int").cache()
    for threshold in (0.999, 0.97):
        exact = {tuple(r) for r in dedup.near_duplicates(df, threshold).collect()}
        before = shuffled(spark)
        assert {tuple(r) for r in dedup.near_duplicates_hashed(df, threshold).collect()} == exact and len(exact) > 1000
        assert shuffled(spark) - before < 8 * 3000 * 26 * 8


def test_modes_share_rankings_and_equal_questions_are_asked_once(spark, passages, monkeypatch):
    asked = questions(spark, [("q1", "lock of the ledger", None), ("q2", "lock of the ledger", None), ("q3", "lock of the ledger", ["d2"]), ("q4", None, None)])
    seen = []
    for where, name in ((dense, "top_k"), (sparse.SparseIndex, "search")):
        real = getattr(where, name)
        monkeypatch.setattr(where, name, lambda *a, real=real, name=name: (seen.append((name, a[0 if name == "top_k" else 1].count())), real(*a))[1])
    found = {}
    for r in retrieval.compare_modes(passages, asked, retrieval.RetrieveOptions(top_k=2)).collect():
        found.setdefault(r["query"], set()).add((r["mode"], r.citation, r.chunk, r.score))
    assert sorted(seen) == [("search", 3), ("top_k", 3)]
    assert found["q1"] == found["q2"] != found["q3"] and "q4" not in found


def test_vector_search_moves_little(spark):
    rng = np.random.default_rng(8)
    q, v = rng.normal(size=(300, 26)), rng.normal(size=(3000, 26))
    frame = lambda m, key: spark.createDataFrame([(n, [float(x) for x in row]) for n, row in enumerate(m)], f"{key} int, vector array<double>").cache()
    left, right = frame(q, "query"), frame(v, "doc")
    left.count(), right.count()
    before = shuffled(spark)
    got = {(r["query"], r["rank"]): (r.doc, round(r.score, 6)) for r in dense.top_k(left, right, 10, block=64).collect()}
    assert shuffled(spark) - before < 3_000_000
    score = np.floor((q / np.linalg.norm(q, axis=1, keepdims=True)) @ (v / np.linalg.norm(v, axis=1, keepdims=True)).T * 1e6 + 0.5) / 1e6
    best = np.argsort(-score, axis=1, kind="stable")[:, :10]
    assert got == {(n, k + 1): (int(d), round(float(score[n, d]), 6)) for n, row in enumerate(best) for k, d in enumerate(row)}


def test_term_search_moves_postings_once(spark):
    rng = np.random.default_rng(9)
    words = [f"word{n}x" for n in range(60)]
    docs = spark.createDataFrame([(n, " ".join(rng.choice(words, 12))) for n in range(1500)], "doc int, text string")
    index = sparse.SparseIndex(docs, "doc", F.col("text"))
    asked = spark.createDataFrame([(n, " ".join(words[(n + k * 7) % 60] for k in range(4))) for n in range(60)], "query int, text string")
    got = {(r["query"], r["rank"]): (r.doc, r.score, r.matched) for r in index.search(asked, "query", F.col("text"), 10).collect()}
    held = {}
    for r in index.postings.collect():
        held.setdefault(r.term, {})[r.doc] = r.tf
    n, mean = 1500, 12.0
    for r in asked.collect():
        score, hits = {}, {}
        for t in sorted(set(r.text.split())):
            df = len(held[t])
            for d, tf in held[t].items():
                score[d] = score.get(d, 0) + np.log(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * 12 / mean)))
                hits[d] = hits.get(d, 0) + 1
        best = sorted(((-np.floor(s * 1e6 + 0.5) / 1e6, d) for d, s in score.items()))[:10]
        assert [got[r["query"], k + 1] for k in range(10)] == [(d, -s, hits[d]) for s, d in best]
