import math

import pytest
from pyspark.sql import functions as F

from corvane.functions import terms as t
from corvane.functions.text import clean_role, is_seen
from corvane.operators import chunking, dedup, dense, evaluation, fusion, nested, quality, sparse, store
from corvane.operators.deliveries import latest_deliveries
from corvane.sources import loaders


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"n int, x {kind}")
    return [r[0] for r in df.select(make(F.col("x")), "n").orderBy("n").collect()]


def test_roles_and_seen(spark):
    assert column(spark, [" User ", "BOT", "tool", "?", None, ""], clean_role) == ["user", "assistant", "other", "unknown", "unknown", "unknown"]
    assert column(spark, ["a", "", None, "​﻿ 　", "。"], is_seen) == [True, False, False, False, True]


def test_terms_and_stems(spark):
    df = spark.createDataFrame([(1, "The NIM_PDF_STORAGE caches, i.e. db.apply of E1042"), (2, None), (3, "")], "id int, text string")
    got = [r.term for r in t.terms(df, F.col("text")).filter("id = 1").collect()]
    assert sorted(got) == sorted(["nim_pdf_storage", "nim", "pdf", "storage", "cach", "i.e", "db.apply", "db", "apply", "e1042"])
    assert t.terms(df, F.col("text")).filter("id > 1").count() == 0
    assert column(spark, ["bus", "class", "policies", "boxes", "cats", "a.bs", "his"], t.stem) == ["bus", "class", "policy", "box", "cat", "a.bs", "his"]


def test_text_forms(spark):
    assert column(spark, ["a\r\nb  c\n\n\n\nd ", None], t.normalize_text) == ["a\nb c\n\nd", None]
    assert column(spark, ["<p>one</p><p>two</p>", "<script>x</script>a&amp;lt;b &copy;"], t.html_to_text) == ["one\n\ntwo", "a<b &copy;"]
    assert column(spark, ["x.PDF", "a.mdx", "b.htm", "c.log", "d.docx", "none", None], t.source_type) == ["pdf", "markdown", "html", "text", None, None, None]
    a, b = column(spark, ["One  Two\n", "one two"], t.fingerprint)
    assert a == b
    units = t.sentences(spark.createDataFrame([("- bullet. Not cut. " * 6 + "\n" + "It is long enough to be cut into its sentences. This is the second one, and more.\n\n",)], "x string"), F.col("x"))
    assert [r.unit for r in units.orderBy("line_no", "unit_no").collect()][1:] == ["It is long enough to be cut into its sentences.", "This is the second one, and more."]


def test_deliveries(spark):
    rows = [("a", 1, "old"), ("a", 2, "new"), ("b", None, "x"), (None, 1, "n1"), (None, 1, "n2"), (None, 1, "n2")]
    df = spark.createDataFrame(rows, "id string, received_at int, content string").withColumn("_k", F.lit(1)).withColumn("_row", F.lit(2))
    got = sorted(tuple(r) for r in latest_deliveries(df, ["content"]).fillna("-").collect())
    assert got == [("-", "n1"), ("-", "n2"), ("a", "new"), ("b", "x")]
    assert latest_deliveries(df.limit(0), ["content"]).count() == 0


def test_bm25_against_brute_force(spark):
    docs = {1: "alpha beta beta", 2: "beta gamma", 3: None, 4: "", 5: "delta alpha alpha alpha"}
    df = spark.createDataFrame(list(docs.items()), "doc int, text string")
    index = sparse.SparseIndex(df, "doc", F.col("text"))
    q = spark.createDataFrame([("q1", "alpha beta alpha"), ("q2", "the"), ("q3", None)], "id string, text string")
    got = {(r["query"], r["doc"]): r["score"] for r in index.search(q, "id", F.col("text")).collect()}
    bags = {k: v.split() for k, v in docs.items() if v}
    n, avg = len(bags), sum(map(len, bags.values())) / len(bags)
    expected = {}
    for k, bag in bags.items():
        s = 0.0
        for term in ("alpha", "beta"):
            tf, df_ = bag.count(term), sum(term in b for b in bags.values())
            if tf:
                s += math.log(1 + (n - df_ + 0.5) / (df_ + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(bag) / avg))
        if s:
            expected["q1", k] = s
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-6 for k in got)
    assert {r["query"]: r["coverage"] for r in index.coverage(q.union(spark.createDataFrame([("q4", "alpha omega")], "id string, text string")), "id", F.col("text")).collect()} == {"q1": 1.0, "q2": 0.0, "q3": 0.0, "q4": 0.5}


def test_knn_blocks_match_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    vectors = [[float(x) for x in rng.normal(size=4)] for _ in range(57)] + [[0.0] * 4, None]
    rows = spark.createDataFrame(list(enumerate(vectors)), "doc int, vector array<double>")
    got = dense.top_k(rows.withColumnRenamed("doc", "query"), rows, 3, block=10).collect()
    unit = np.array([v for v in vectors if v is not None])
    unit = unit / np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
    full = np.floor(unit @ unit.T * 1e6 + 0.5) / 1e6
    for q in range(57):
        best = sorted(range(58), key=lambda d: (-full[q, d], d))[:3]
        assert [r.doc for r in sorted((r for r in got if r["query"] == q), key=lambda r: r["rank"])] == best


def test_fusion_and_overlap(spark):
    assert fusion.normalize_weights("hybrid", 3, 1) == (0.75, 0.25) and fusion.normalize_weights("hybrid", 0, 0) == (0.5, 0.5) and fusion.normalize_weights("sparse") == (0.0, 1.0) and fusion.normalize_weights("hybrid", float("nan"), None) == (0.7, 0.3)
    d = spark.createDataFrame([("q", "a", 1, 0.9), ("q", "b", 2, 0.8)], "query string, doc string, rank int, score double")
    s = spark.createDataFrame([("q", "b", 1, 9.0), ("q", "c", 2, 8.0)], "query string, doc string, rank int, score double")
    fused = fusion.weighted_rrf(d, s, (0.5, 0.5), 10).orderBy("rank").collect()
    assert [r.doc for r in fused] == ["b", "a", "c"] and fused[0].retrieved_by == "dense,sparse"
    assert [r.doc for r in fusion.weighted_rrf(d, s, (1.0, 0.0), 10).orderBy("rank").collect()] == ["a", "b"]
    runs = d.select(F.lit("d").alias("mode"), "query", "doc").union(s.select(F.lit("s"), "query", "doc"))
    assert fusion.mode_overlap(runs).first().jaccard == 0.333


def test_neighbours(spark):
    passages = spark.createDataFrame([(f"d{k}", "d", 1, k) for k in range(8)], "passage string, document string, page int, idx int")
    primary = spark.createDataFrame([("q", 1, "d", 3), ("q", 2, "d", 4)], "query string, rank int, document string, idx int")
    assert [(r.passage, r.anchor_rank) for r in fusion.neighbours(primary, passages, 3).orderBy("place").collect()] == [("d1", 1), ("d2", 1), ("d5", 1)]


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "w", "Same  text"), (2, "w", "same text"), (3, "v", "same text"), (4, "w", None), (5, None, "x"), (6, None, "X")], "id int, w string, text string")
    assert sorted(map(tuple, dedup.exact_duplicates(df, "id", "w").collect())) == [(2, 1), (6, 5)]
    v = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [0.99, 0.1], 2), (3, [0.0, 1.0], 3)], "doc int, vector array<double>, scope int")
    assert {(r["query"], r["doc"]) for r in dedup.near_duplicates(v, 0.95).collect()} == {(1, 2), (2, 1)}


def test_window_gap_and_lossless():
    text = "x" * 429 + "\n" + "y" * 900
    o = chunking.ChunkOptions()
    assert chunking.window_spans(text, o)[:2] == [(0, 430), (550, 1330)]
    spans = chunking.window_spans(text, chunking.ChunkOptions(lossless=True))
    assert all(b[0] <= a[1] for a, b in zip(spans, spans[1:]))
    assert chunking.nearest_rank([0.1, 0.2, 0.3, 0.4], 50) == 0.2 and chunking.nearest_rank([], 50) == math.inf
    with pytest.raises(ValueError):
        chunking.ChunkOptions(size=10, overlap=10)


def test_recursive_split_keeps_words_and_size():
    text = " ".join(f"Sentence number {n} has some words." for n in range(200))
    parts = chunking.recursive_split(text, 200, 40)
    assert all(len(p) <= 200 for p in parts) and set(" ".join(parts).split()) == set(text.split())
    assert chunking.recursive_split("", 10, 2) == [] and all(len(p) <= 10 for p in chunking.recursive_split("z" * 35, 10, 2))


def test_chunk_strategies(spark):
    rows = [(1, [(1, "A › B", "B\nshort"), (2, None, "word " * 400)]), (2, None), (3, []), (4, [(1, "h", "  ")])]
    df = spark.createDataFrame(rows, "k int, s array<struct<page:int,heading:string,text:string>>")
    for strategy in ("fixed", "structural", "semantic"):
        got = chunking.chunk_documents(df, "k", "s", strategy, embedder=dense.hashing_embedder(8)).orderBy("key", "chunk_index").collect()
        assert {r.key for r in got} == {1} and [r.chunk_index for r in got] == list(range(len(got))) and all(r.char_count == len(r.text) for r in got)


def test_loaders(spark):
    md = loaders.markdown_sections("intro\n\n# A\ntext\n```\n# no\n```\nB\n===\n### C\nend")
    assert [(s["heading"], s["text"]) for s in md] == [(None, "intro"), ("A", "text\n```\n# no\n```"), ("B › C", "end")]
    assert loaders.plain_sections("") == [] and len(loaders.plain_sections("\n\n".join(["p" * 1000] * 4))) == 2
    pages = spark.createDataFrame([(1, "<title>T</title><body>pre<h1>A</h1>x<h2>B</h2>y</body>"), (2, ""), (3, None)], "k int, html string")
    assert [tuple(r)[1:] for r in loaders.html_sections(pages, "k", "html").orderBy("key", "page").collect()] == [(1, "T", "pre"), (2, "A", "A\n\nx"), (3, "A › B", "B\n\ny")]


def test_citations_and_claims(spark):
    assert column(spark, ["a [2, 4] b [1] [1-3] [2]", "none", None], quality.citation_numbers, "string") == [[1, 2, 4], [], None]
    answer = "# Title\n- The cache keeps four items [1].\nShort one.\nIt holds the lock for long [2]. Is that so?\n```\ncode is not a claim\n```\n**Label:**"
    got = quality.claims(spark.createDataFrame([("a", answer), ("b", None), ("c", "")], "id string, x string"), "id", "x").orderBy("claim_no").collect()
    assert [(r.claim, r.citations) for r in got] == [("The cache keeps four items .", [1]), ("It holds the lock for long .", [2])]
    report = quality.citation_report(spark.createDataFrame([("a", 1, "x", [1, 7]), ("a", 2, "y", [])], "key string, claim_no int, claim string, citations array<int>"), spark.createDataFrame([("a", 3), ("z", 0)], "key string, n_sources int"))
    rows = {r.key: r for r in report.collect()}
    assert rows["a"].invalid_citations == [7] and rows["a"].unused_sources == [2, 3] and rows["a"].cited_claims == 1 and rows["z"].total_claims == 0 and rows["z"].unused_sources == []


def test_scores(spark):
    lit = [F.lit(x) for x in (True, 4, 4, 4, 0, 0)]
    one = lambda *x: spark.range(1).select(quality.citation_score(*map(F.lit, x))).first()[0]
    assert spark.range(1).select(quality.citation_score(*lit)).first()[0] == 1.0
    assert one(False, 4, 4, 0, 0, 0) == 0.6 and abs(one(True, 4, 4, 4, 0, 1) - 0.85) < 1e-9 and abs(one(True, 4, 4, 4, 2, 0) - 0.85) < 1e-9 and one(True, 0, 0, 0, 0, 0) == 0.0
    cases = spark.createDataFrame([("a", ["f"]), ("b", []), ("c", None), ("d", ["g"])], "query string, expected array<string>")
    passages = spark.createDataFrame([("a", 1, "x"), ("a", 2, "f"), ("a", 3, "f")], "query string, rank int, filename string")
    assert {r["query"]: (r.hit, r.reciprocal_rank) for r in evaluation.retrieval_metrics(passages, cases).collect()} == {"a": (1, 0.5), "b": (None, None), "c": (None, None), "d": (0, 0.0)}
    assert column(spark, [0.8, 0.5, 0.1], evaluation.snapped, "double") == [1.0, 0.5, 0.0]


def test_store_changes(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id int, t string, u string")
    assert sorted(map(tuple, store.upserted(old, spark.createDataFrame([(2, "c"), (3, "d")], "id int, t string"), "id").collect())) == [(1, "a", "x"), (2, "c", None), (3, "d", None)]
    assert sorted(map(tuple, store.patched(old, spark.createDataFrame([(1, None, "z")], "id int, t string, u string"), "id").collect())) == [(1, "a", "z"), (2, "b", "y")]
    documents = spark.createDataFrame([("d1",), ("d2",)], "id string")
    chunks = spark.createDataFrame([("c1", "d1"), ("c2", "d2")], "id string, document_id string")
    chats = spark.createDataFrame([("x", "d1"), ("y", None)], "id string, document_id string")
    left = store.without_documents(documents.filter("id = 'd1'"), documents, chunks, chats)
    assert [df.count() for df in left] == [1, 1, 2] and left[2].filter("document_id is not null").count() == 0


def test_rate_limit(spark):
    from corvane.streaming.rate import limit_requests

    rows = [("k", s, n) for n, s in enumerate(["00:00:00", "00:00:10", "00:00:20", "00:01:00", "00:01:59", "00:02:00"])]
    df = spark.createDataFrame(rows, "key string, s string, r int").withColumn("at", F.to_timestamp(F.concat(F.lit("2025-01-01 "), "s")))
    got = {r.request: r.allowed for r in limit_requests(df, "key", "at", "r", limit=2, window_seconds=60).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: True}


def test_ingest_keeps_tables_in_step(spark, tmp_path):
    import json

    from corvane.streaming import ingest

    text = lambda tag: "\n\n".join(f"{tag} paragraph {n} of the page about locks." for n in range(3))
    drops = [
        [dict(filename="a.md", workspace="w", content="# H\n" + text("first")), dict(filename="b.bin", workspace="w", content="x"), dict(filename="c.html", workspace="w", content="<h1>T</h1><p>body of the page</p>", strategy="fixed"), dict(filename="a.md", workspace="v", content="# H\n" + text("first"))],
        [dict(filename="copy.md", workspace="w", content="# H\n" + text("first")), dict(filename="keep.md", workspace="w", content="# H\n" + text("first"), dedupe=False), dict(filename="a.md", workspace="w", content="now shorter")],
    ]
    (tmp_path / "in").mkdir()
    run = lambda: ingest.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    now = lambda name: ingest.current(spark, str(tmp_path / "out"), name)
    assert now("chunks") is None
    for n, rows in enumerate(drops):
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(map(json.dumps, rows)))
        run()
        status = {(r.workspace, r.filename): (r.status, r.chunk_count, r.duplicate_chunks) for r in now("documents").collect()}
        ids = {r.id for r in now("chunks").collect()}
        assert ids == {r.id for r in now("vectors").collect()} == {r.id for r in now("postings").collect()}
        if n == 0:
            assert status == {("w", "a.md"): ("ready", 1, 0), ("w", "b.bin"): ("failed", 0, 0), ("w", "c.html"): ("ready", 1, 0), ("v", "a.md"): ("ready", 1, 0)}
    assert status[("w", "copy.md")] == ("failed", 0, 1) and status[("w", "keep.md")] == ("ready", 1, 0) and status[("w", "a.md")] == ("ready", 1, 0)
    assert {r.text for r in now("chunks").filter("workspace = 'w' and filename = 'a.md'").collect()} == {"now shorter"}
    # a batch that broke off before its documents were written doesn't count
    now("chunks").limit(1).withColumn("batch", F.lit(9)).write.parquet(str(tmp_path / "out" / "chunks" / "run=9"))
    assert {r.id for r in now("chunks").collect()} == ids


def test_rate_limit_of_a_stream(spark, tmp_path):
    from corvane.streaming.rate import limit_stream

    (tmp_path / "in").mkdir()
    rows = ["00:00:20", "00:00:00", "00:00:10", "00:01:00"]
    (tmp_path / "in" / "a.json").write_text("\n".join(f'{{"key": "k", "at": "2025-01-01T{s}", "request": "r{n}"}}' for n, s in enumerate(rows)))
    stream = spark.readStream.schema("key string, at timestamp, request string").json(str(tmp_path / "in"))
    limit_stream(stream, 2, 60).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert {r.request: r.allowed for r in spark.table("limited").collect()} == {"r1": True, "r2": True, "r0": False, "r3": True}


def test_shared_folder_and_release(spark, monkeypatch):
    from corvane import context

    kept = context.materialize(spark.range(3), "probe")
    assert kept.count() == 3 and context.release(spark) > 0 and context.release(spark) == 0

    class Cluster:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}

    class Session:
        conf, sparkContext = {}, Cluster()

    if not spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        with pytest.raises(ValueError):
            context.shared_folder(Session())


MESSAGES = "id string, received_at int, citations string, sources string, confidence string, retrieval_stats string"


def test_nested_tables(spark):
    verdicts = '{"Verdicts": {"claim": "c", "citations": "[1, \\"2\\", 2]", "supportedBy": 3}, "invalid_citations": 9}'
    rows = [
        ("m1", 1, "broken {", None, None, None), ("m1", 2, verdicts, '[{"text": "{}"}, null, {"citation": "2"}, {"citation": 3.0, "retrievedBy": "dense"}]', '"{\\"reasons\\": [\\"r\\"]}"', '{"denseHits": "4", "mode": null}'),
        ("m2", 1, None, "", "[1]", "NaN"), ("m3", 1, '"\\"{}\\""', "[]", "null", "{}"), ("m4", 1, '{"verdicts": [null, {"citations": [1]}]}', '{"filename": "f"}', None, None), (None, 1, "{}", "[]", None, None),
    ]
    df = spark.createDataFrame(rows, MESSAGES).withColumn("nodes", F.lit("clash")).withColumn("message_id", F.lit("clash"))
    assert sorted(map(tuple, nested.cited_sources(df).collect())) == [("m1", 0, 0), ("m1", 0, 2), ("m4", 1, 0)]
    assert sorted(map(tuple, nested.cited_sources(df, "supported_by").collect())) == [("m1", 0, 3)]
    assert [(r.source_no, r.citation, r.text) for r in nested.sources(df).filter("message_id = 'm1'").orderBy("source_no").collect()] == [(0, None, "{}"), (2, 2, None), (3, 3, None)]
    assert [tuple(r) for r in nested.retrievers(df).collect()] == [("m1", 3, 0, "dense")]
    assert [tuple(r) for r in nested.report_numbers(df, "invalid_citations").collect()] == [("m1", 0, 9)]
    assert [tuple(r) for r in nested.reasons(df).collect()] == [("m1", 0, "r")]
    stats = {r.message_id: r for r in nested.objects(df, "retrieval_stats", nested.STAT_FIELDS).collect()}
    assert set(stats) == {"m1", "m3"} and stats["m1"].dense_hits == 4 and stats["m1"]["mode"] is None
    assert nested.cited_sources(df.limit(0)).count() == 0


def test_interval_labels_are_nested():
    nodes = nested.label([("a", {"b": [1, {"c": [2]}], "d": 3})], frozenset(), None)
    spans = {n["path"]: (n["pre"], n["post"]) for n in nodes}
    assert spans["a"][0] < spans["a.b"][0] < spans["a.b[].c"][0] and spans["a.b[].c"][1] < spans["a.b"][1] < spans["a"][1]
    deep = "[" * 900 + "]" * 900
    assert len(nested.label([("x", nested.parse(deep)[1])], frozenset(), None)) == 900


def test_entry_lists_queries():
    import __spark_entry__ as e

    assert "bm25_topk" in e.queries() and set(e.oracle_sql()) <= set(e.queries())


def test_html_pages_that_begin_otherwise(spark, tmp_path):
    from corvane.plans.queries import QUERIES

    rows = [(1, "html", "<h1>A</h1>x"), (2, "text", "<li><a href='u'>one</a></li>"), (3, "html", "before <p>two</p>"), (4, "html", "bare"), (5, "text", "1 < 2 and 3 > 2"), (6, "text", None)]
    spark.createDataFrame(rows, "doc_id int, source_type string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    sections = {(r.doc_id, r.text) for r in QUERIES["html_section_rows"](spark, str(tmp_path)).collect()}
    assert sections == {(1, "A\n\nx"), (2, "one"), (3, "before\ntwo"), (4, "bare")}
    assert {r.doc_id: r.plain for r in QUERIES["html_text"](spark, str(tmp_path)).collect()} == {1: "A\n\nx", 2: "one", 3: "before\ntwo", 4: "bare"}


def test_full_chat_history(spark, tmp_path):
    from corvane.plans.queries import QUERIES

    rows = [(f"m{n:02d}", "c", "user", "x" * 3000, n, 1) for n in range(14)]
    df = spark.createDataFrame(rows, "id string, chat_id string, role string, content string, at int, received_at int")
    df.withColumn("created_at", F.timestamp_seconds("at")).write.parquet(f"{tmp_path}/messages.parquet")
    got = QUERIES["chat_history"](spark, str(tmp_path)).collect()
    assert sorted(r.id for r in got) == [f"m{n:02d}" for n in range(2, 14)] and {len(r.content) for r in got} == {2000}
