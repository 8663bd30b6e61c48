import json

import pytest
from pyspark.sql import functions as F

from corvane.operators import evaluation, nested, quality, store
from corvane.sources import loaders
from corvane.streaming import calls


def value(spark, column, **given):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()]) if given else spark.range(1)
    return row.select(column).first()[0]


def test_verdict_reports(spark):
    rows = [("a", 0, "Supported", [1], [1]), ("a", 1, "supported", [2], [1, 0]), ("a", 2, "partially_supported", [3], []), ("a", 3, "unsupported", None, None), ("a", 4, None, [1], [1]), ("a", 30, "supported", [1], [1])]
    df = spark.createDataFrame(rows, "key string, claim_no int, status string, citations array<int>, supported_by array<int>").withColumn("cited_claims", F.lit(9))
    assert [r.status for r in quality.judged_claims(df).orderBy("claim_no").collect()] == ["supported", "partial", "partial", "unsupported", "unverified", "unverified"]
    r = quality.verdict_report(df).first()
    assert (r.total_claims, r.cited_claims, r.supported_claims, r.unsupported_claims, r.grounded_claims, r.miscited_claims) == (6, 5, 1, 1, 3, 1)
    assert quality.verdict_report(df.limit(0)).count() == 0
    done = lambda *x: value(spark, quality.completeness(*map(F.lit, x)))
    assert (done(1, 2, 3), done(0, 0, 3), done(0, 0, 0), done(1, 2, 3, True, True), done(1, 2, 3, False, False)) == (0.5, 1.0, 0.0, 0.5, 1.0)
    report = quality.unverified_report(spark.createDataFrame([("a", 2)], "key string, total_claims int")).first()
    assert not report.verified and report.supported_claims == 0


def test_judge_and_json_reply(spark):
    df = spark.createDataFrame([("a", "q?", ["one", "two"], ["s"]), ("b", "bad", ["one"], None), ("c", None, None, [])], "key string, question string, claims array<string>, sources array<string>")

    def judge(question, claims, sources):
        if question == "bad":
            raise RuntimeError("no model")
        return [{"id": 1, "status": "supported", "supportedBy": ["1"], "reason": "r" * 300}]

    got = {(r.key, r.claim_no): r for r in quality.judge(df, judge).collect()}
    assert set(got) == {("a", 0), ("a", 1), ("b", 0)} and got["a", 1].supported_by == [1] and len(got["a", 1].reason) == 240 and got["b", 0].status is None
    assert value(spark, quality.json_reply(F.lit('```json\n{"x": 3}\n```'), "x int")).x == 3


def test_score_reasons(spark):
    base = dict(mode="hybrid", dense_hits=3, sparse_hits=2, rerank_used=True, rerank_backend="model", top_dense_score=0.625, keyword_coverage=0.5, verified=True, total_claims=4, unsupported_claims=0, miscited_claims=0, retrieval=0.8, completeness=1.0)
    said = lambda **x: spark.range(1).select(*[F.lit(v).alias(k) for k, v in (base | x).items() if k != "invalid"], F.array(*[F.lit(n) for n in x.get("invalid", [])]).cast("array<int>").alias("invalid_citations")).select(quality.score_reasons()).first()[0]
    assert said() == ["All claims verified against retrieved sources."]
    assert said(retrieval=0.2, dense_hits=0) == ["Weak retrieval signal (top similarity 0.63, keyword coverage 50%).", "Only one retriever returned results (0 dense, 2 sparse)."]
    assert said(rerank_used=False, verified=False, completeness=0.5) == ["Reranking was skipped, so passage ordering is unfiltered.", "Citations were not verified against the sources.", "Part of the question appears unanswered."]
    assert said(unsupported_claims=1, miscited_claims=2, invalid=[7, 9], rerank_backend="lexical") == ["LLM reranker was unavailable; lexical fallback was used.", "1 of 4 claims were not supported by any retrieved source.", "2 claims cited the wrong source number.", "Answer referenced non-existent sources: [7], [9]."]


def test_abstain_prompt_and_links(spark):
    kind = "sources array<struct<citation:int,filename:string,heading:string,page:int,text:string>>"
    df = spark.createDataFrame([([(1, "a.md", "H", 1, "x " * 100), (2, "b.md", None, 4, None), (3, "b.md", None, 4, None)],), ([],), (None,)], kind)
    texts = [r[0] for r in df.select(quality.abstain_text(F.col("sources"), F.lit(0.2), F.lit(0.4))).collect()]
    assert "a.md › H — " in texts[0] and texts[0].count("b.md · page 4") == 1 and "…" in texts[0] and "(threshold 35%)" in texts[0] and "coverage 40%" in texts[0] and texts[0].count("- b.md") == 2
    assert "- Nothing above the relevance threshold." in texts[1] and "manually" not in texts[1] and texts[1] == texts[2]
    prompt = [r[0] for r in df.select(quality.prompt_text(F.lit("why?"), F.col("sources"))).collect()]
    assert prompt[0].startswith("CONTEXT\n[1] a.md › H\n") and "[2] b.md · page 4\n" in prompt[0] and prompt[1].startswith("CONTEXT\n(no sources retrieved)\n\nQUESTION\nwhy?") and prompt[2] == prompt[1]
    assert value(spark, quality.linked_markers(F.lit("a [1] `b [2]` c [2, 4]\n```\n[3]\n```\n[3]"))) == "a [1](#source-1) `b [2]` c [2](#source-2) [4](#source-4)\n```\n[3]\n```\n[3](#source-3)"
    assert value(spark, quality.abstains(F.lit(0), F.lit(0.9))) and not value(spark, quality.abstains(F.lit(2), F.lit(0.35)))


def test_node_table(spark):
    df = spark.createDataFrame([("m", 1, json.dumps({"verdicts": [{"citations": [1, 2]}, {"claim": "x"}]}))], "id string, received_at int, citations string")
    rows = nested.all_nodes(df, "citations").collect()
    by = {r.pre: r for r in rows}
    assert len(rows) == 7 and [r.path for r in rows if r.parent_pre is None] == ["citations"]
    assert all(r.pre < r.post and (r.parent_pre is None or (by[r.parent_pre].pre < r.pre and r.post < by[r.parent_pre].post)) for r in rows)
    assert [by[r.parent_pre].path for r in rows if r.path == "citations.verdicts[].citations[]"] == ["citations.verdicts[].citations"] * 2


def test_case_results_and_summary(spark):
    cases = spark.createDataFrame([("a", "lookup", False, ["lock"]), ("b", "no-answer", True, None), ("c", "lookup", None, None), ("d", "lookup", False, None)], "id string, case_type string, expect_abstain boolean, must_include array<string>")
    answers = spark.createDataFrame([("a", "the Lock", False, 0.8, 0.9, 10, None), ("b", "no", True, 0.2, 0.1, 20, None), ("c", None, None, None, None, 5, "failed")], "id string, answer string, abstained boolean, judged double, confidence double, duration_ms int, error string")
    reports = spark.createDataFrame([("a", True, 4, 3, 2, 1), ("b", True, 4, 3, 2, 1)], "id string, verified boolean, total_claims int, grounded_claims int, cited_claims int, supported_claims int")
    retrieval = spark.createDataFrame([("a", 1, 0.5)], "id string, hit int, reciprocal_rank double")
    results = evaluation.case_results(cases, answers, reports, retrieval)
    rows = {r.id: r for r in results.collect()}
    assert (rows["a"].correctness, rows["a"].faithfulness, rows["a"].citation_accuracy, rows["a"].complete, rows["a"].abstain_correct) == (1.0, 0.75, 0.5, True, True)
    assert rows["b"].faithfulness is None and rows["b"].abstain_correct and rows["c"].error == "failed" and not rows["c"].abstain_correct and rows["d"].correctness == 0.0
    summary = {r.case_type: r for r in evaluation.run_summary(results).collect()}
    assert summary[None].cases == 4 and summary[None].correctness == 0.25 and summary["no-answer"].faithfulness == 0.0 and summary[None].duration_ms == 9
    assert sorted(r.id for r in evaluation.needs_attention(results).collect()) == ["b", "c", "d"]


def test_reuse_config_and_comparison(spark):
    corpus = spark.createDataFrame([("a.md",), ("b.md",)], "filename string")
    docs = lambda *rows: spark.createDataFrame([(n, s, "fixed", "m") for n, s in rows], "filename string, status string, chunk_strategy string, embedding_model string")
    reuse = lambda d, c=corpus, s="fixed": evaluation.can_reuse(c, d, s, "m").first().reuse
    assert reuse(docs(("a.md", "ready"), ("b.md", "ready"))) and not reuse(docs(("a.md", "ready"))) and not reuse(docs(("a.md", "ready"), ("b.md", "failed"))) and not reuse(docs(("a.md", "ready"), ("b.md", "ready")), s="semantic")
    assert not reuse(docs(("a.md", "ready"), ("b.md", "ready"), ("c.md", "ready"))) and not reuse(docs(), corpus.limit(0))
    assert evaluation.run_config(["--top-k", "8", "--rerank", "off", "--dense-weight=0.7", "--force"]) == {"topK": 8, "rerank": False, "denseWeight": 0.7, "force": True, "sparseWeight": 0.3}
    runs = spark.createDataFrame([("x", 0.5, 90.0), ("y", 0.7, 120.0)], "label string, correctness double, duration_ms double")
    compared = evaluation.comparison(runs, "label", ("correctness", "duration_ms"))
    assert {(r.metric, r.label) for r in compared.filter("best").collect()} == {("correctness", "y"), ("duration_ms", "x")}
    assert [r.line for r in evaluation.comparison_markdown(compared).orderBy("line_no").collect()] == ["| metric | x | y |", "| --- | --- | --- |", "| correctness | 0.5 | **0.7** |", "| duration_ms | **90.0** | 120.0 |"]


def test_store_of_chats_files_and_scopes(spark, tmp_path):
    documents = spark.createDataFrame([("d1", "g", "ready", "f.pdf", "pdf", None, "aGk="), ("d2", "g", "failed", "g.md", "markdown", None, None), ("d3", "h", "ready", "h.md", "markdown", "/x", None)], "id string, guest_id string, status string, filename string, source_type string, storage_path string, file_bytes string")
    assert [store.in_workspace(documents, "g", r).count() for r in (False, True)] == [2, 1]
    assert store.found_or_missing(documents, "d1", "g").first().http_status == 200 and store.found_or_missing(documents, "d1", "h").first().http_status == 404
    assert {r.id: r.has_file for r in store.with_file_flag(documents).collect()} == {"d1": True, "d2": False, "d3": True}
    file = store.stored_file(documents).first()
    assert bytes(file.content) == b"hi" and file.content_type == "application/pdf"
    asked = spark.createDataFrame([(1, "g", ["d1", "d3"]), (2, "g", ["d1"]), (3, "g", None)], "request int, workspace string, document_ids array<string>")
    assert {r.request: (r.accepted, r.missing) for r in store.scope_checked(asked, documents).collect()} == {1: (False, ["d3"]), 2: (True, []), 3: (True, [])}
    chats, messages = spark.createDataFrame([("c",), ("k",)], "id string"), spark.createDataFrame([("m", "c"), ("n", "k")], "id string, chat_id string")
    left = store.without_chats(chats.filter("id = 'c'"), chats, messages)
    assert [[r.id for r in df.collect()] for df in left] == [["k"], ["n"]]
    new = spark.createDataFrame([("a", "g", None, "d", None), ("b", "g", "t" * 60, None, ["x", "y"]), ("c", "g", "t", None, None)], "id string, guest_id string, title string, document_id string, document_ids array<string>")
    assert [(r.document_id, r.document_ids) for r in store.new_chats(new).orderBy("id").collect()] == [("d", ["d"]), ("x", ["x", "y"]), (None, [])]
    assert store.conforming(new.limit(1), "id string, extra int").columns == ["id", "extra"]
    vectors = spark.createDataFrame([("d1", [1.0, 2.0])], "document_id string, vector array<double>")
    assert store.with_dimension(vectors, 2).count() == 1 and store.without_vectors(vectors, documents).count() == 0
    with pytest.raises(Exception, match="has not 3 places"):
        store.with_dimension(vectors, 3).collect()
    assert {r.table_name: (r.n, r.ok) for r in store.health({"documents": documents, "none": documents.limit(0)}).collect()} == {"documents": (3, True), "none": (0, False)}
    (tmp_path / "g.json").write_text(json.dumps({"version": 1, "corpus": "c", "cases": [{"id": "q1", "type": "lookup", "question": "?", "answer": "a", "expectedSources": ["f"]}, {"id": "q2", "type": "no-answer", "question": "?", "answer": "", "expectedSources": [], "expectAbstain": True}]}, indent=1))
    cases = store.golden_cases(spark.read.schema(store.GOLDEN).json(str(tmp_path / "g.json"), multiLine=True)).orderBy("id").collect()
    assert [(r.id, r.case_type, r.expect_abstain) for r in cases] == [("q1", "lookup", False), ("q2", "no-answer", True)]
    for _ in range(2):
        store.append_runs(cases and spark.createDataFrame([("r", 0.5)], "id string, correctness double"), str(tmp_path / "runs"))
    assert spark.read.parquet(str(tmp_path / "runs")).count() == 2


def test_calls_and_events(spark):
    errors = ['{"error": {"code": 429}}', "RESOURCE_EXHAUSTED", "Too Many Requests", "bad 4290", None, 'wait "retryDelay": "29.5s"']
    df = spark.createDataFrame([(n, e) for n, e in enumerate(errors)], "n int, e string").orderBy("n")
    assert [tuple(r) for r in df.select(calls.is_quota_error(F.col("e")), calls.retry_after_ms(F.col("e"))).collect()] == [(True, None), (True, None), (True, None), (False, None), (False, None), (False, 29500)]
    now = [0.0]
    pool = calls.KeyPool(["a", " b ", "a", "", "c"], lambda: now[0])
    assert pool.order() == ["a", "b", "c"] and pool.order("x") == ["x", "a", "b", "c"]
    pool.exhausted("a")
    assert pool.order() == ["b", "c", "a"] and pool.order("a") == ["b", "c", "a"]
    now[0] = 61.0
    assert pool.order() == ["a", "b", "c"]

    def make(key):
        if key != "c":
            raise RuntimeError("429")
        return key

    assert pool.call(make, lambda e: "429" in str(e)) == "c" and pool.order()[0] == "c"
    with pytest.raises(RuntimeError):
        pool.call(lambda k: make("a"), lambda e: False)
    waits = []
    assert calls.retried(lambda: 1 / 0, sleep=waits.append) == calls.CANNED and waits == [2.0, 2.0]
    answers = spark.createDataFrame([("a", "m", ["x", "y"], "v", "c", None), ("b", "m", None, None, None, "e")], "key string, meta string, deltas array<string>, verification string, confidence string, error string")
    got = [(r.key, r.seq, r.type) for r in calls.answer_events(answers).orderBy("key", "seq").collect()]
    assert got == [("a", 0, "meta"), ("a", 1, "delta"), ("a", 2, "delta"), ("a", 3, "verification"), ("a", 4, "confidence"), ("a", 5, "done"), ("b", 0, "meta"), ("b", 1, "error")]
    pieces = spark.createDataFrame([("k", 2, '": "x"}\n{"type": "do'), ("k", 1, '{"type": "delta", "text'), ("k", 3, 'ne"}\n\n')], "key string, piece_no int, text string")
    assert [tuple(r.event) for r in calls.ndjson_events(pieces).orderBy("line_no").collect()] == [("delta", "x"), ("done", None)]


def test_loading_by_type(spark):
    page = "<title>T</title><body>pre<h1>A</h1>x &#8217; &amp;#65; &#0;<h3>C</h3>z<h2>B</h2>y</body>"
    rows = [(1, page, "html"), (2, "First line\nbody", "pdf"), (3, "# H\ntext", "markdown"), (4, "plain", "text"), (5, "x", "exe"), (6, None, "html"), (7, "", "text")]
    df = spark.createDataFrame(rows, "k int, c string, t string").withColumn("sections", F.lit("clash"))
    got = {r.key: [(s.page, s.heading, s.text) for s in r.sections] for r in loaders.load_sections(df, "k", "c", "t").collect()}
    assert got[1] == [(1, "T", "pre"), (2, "A", "A\n\nx ’ A &#0;"), (3, "A › C", "C\n\nz"), (4, "A › B", "B\n\ny")]
    assert got[2] == [(1, "First line", "First line\nbody")] and got[3] == [(1, "H", "text")] and got[4] == [(1, None, "plain")] and got[5] == got[6] == got[7] == []
    for n in (5, 7):
        with pytest.raises(Exception, match="unsupported type|without text"):
            loaders.load_sections(df.filter(f"k = {n}"), "k", "c", "t", strict=True).collect()
    pages = loaders.pdf_sections(["Title\nx", " ", "A sentence that has a good many more than twelve words in it, which ends.\ny"])
    assert [(p["page"], p["heading"]) for p in pages] == [(1, "Title"), (3, None)]
    twice = loaders.html_sections(spark.createDataFrame([(1, "<h1>A</h1>a"), (1, "<h1>A</h1>b")], "k int, html string"), "k", "html").collect()
    assert sorted(r.text for r in twice) == ["A\n\na", "A\n\nb"]
