"""Citations, claims and confidence of answers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.terms import SENTENCE_BREAK, rounded

# Markers, weights and thresholds.
CITATION = r"\[(\d+(?:\s*,\s*\d+)*)\]"
WEIGHTS = (0.4, 0.35, 0.25)
DENSE_LOW, DENSE_HIGH = 0.55, 0.85
ABSTAIN_BELOW = 0.35


def citation_numbers(text: Column) -> Column:
    """Sorted distinct numbers of the markers [1] and [2, 4]; ranges are none."""
    numbers = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(CITATION), 1), lambda m: F.split(m, r"\s*,\s*")))
    return F.array_sort(F.array_distinct(F.transform(numbers, lambda n: n.cast("int"))))


def strip_citations(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, CITATION, ""), r"(?U)\s{2,}", " "), r"(?U)^\s+|\s+$", "")


def claims(answers: DataFrame, key: str, answer: str) -> DataFrame:
    """key, claim_no (from 1), claim and citations of the factual claims of each answer. Code, headings and rules are left
    out; a list item is one claim, prose is cut into sentences; questions, labels and fragments under four words are
    none. Null answers have no claims."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    lines = answers.select(F.col(key).alias("key"), F.posexplode(F.split(F.regexp_replace(answer, r"(?s)```.*?```", " "), "\n")).alias("l", "_l")).withColumn("_l", strip(F.col("_l")))
    lines = lines.filter((F.col("_l") != "") & ~F.col("_l").rlike(r"^#{1,6}\s") & ~F.col("_l").rlike(r"^([-*_]\s*){3,}$"))
    body = lines.withColumn("_b", strip(F.regexp_replace("_l", r"^([-*+]|\d+[.)])\s+", ""))).filter("_b <> ''")
    units = body.select("key", "l", F.posexplode(F.when(F.col("_b") != F.col("_l"), F.array("_b")).otherwise(F.split("_b", SENTENCE_BREAK))).alias("u", "_u")).withColumn("_u", strip(F.col("_u")))
    bare = strip_citations(F.col("_u"))
    words = F.size(F.filter(F.split(bare, r"\s+"), lambda w: w != ""))
    good = (bare != "") & ~bare.endswith("?") & ~(bare.endswith(":") & (words <= 8)) & ~bare.rlike(r"^\*\*[^*]+\*\*:?$") & bare.rlike("[a-zA-Z]") & (words >= 4)
    w = Window.partitionBy("key").orderBy("l", "u")
    return units.filter(good).select("key", F.row_number().over(w).alias("claim_no"), bare.alias("claim"), citation_numbers(F.col("_u")).alias("citations"))


def citation_report(parsed: DataFrame, sources: DataFrame) -> DataFrame:
    """Counts for each key of ``sources`` (key, n_sources): claims, cited claims, cited, invalid and unused numbers."""
    own = parsed.groupBy("key").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.size("citations") > 0).alias("cited"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("citations")))).alias("numbers"))
    numbers = F.coalesce("numbers", F.array().cast("array<int>"))
    every = F.when(F.col("n_sources") > 0, F.sequence(F.lit(1), F.col("n_sources"))).otherwise(F.array().cast("array<int>"))
    return sources.join(own, "key", "left").select(
        "key", F.coalesce("total", F.lit(0)).alias("total_claims"), F.coalesce("cited", F.lit(0)).alias("cited_claims"), numbers.alias("cited_numbers"),
        F.filter(numbers, lambda n: (n < 1) | (n > F.col("n_sources"))).alias("invalid_citations"), F.array_except(every, numbers).alias("unused_sources"),
    )


def clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def retrieval_confidence(stats: dict[str, Column] | None = None) -> Column:
    """Confidence from mode, top_dense_score, mean_rerank_score, keyword_coverage, passages_returned, fused_candidates."""
    c = stats or {n: F.col(n) for n in ("mode", "top_dense_score", "mean_rerank_score", "keyword_coverage", "passages_returned", "fused_candidates")}
    d, k, r = clamp((c["top_dense_score"] - DENSE_LOW) / (DENSE_HIGH - DENSE_LOW)), clamp(c["keyword_coverage"]), clamp(c["mean_rerank_score"])
    sparse, none = c["mode"] == "sparse", c["mean_rerank_score"].isNull()
    value = F.when(none & sparse, k).when(none, 0.65 * d + 0.35 * k).when(sparse, 0.7 * r + 0.3 * k).otherwise(0.55 * r + 0.3 * d + 0.15 * k)
    return F.when((F.coalesce(c["passages_returned"], F.lit(0)) == 0) & (F.coalesce(c["fused_candidates"], F.lit(0)) == 0), 0.0).otherwise(rounded(clamp(value)))


def citation_score(verified: Column, total: Column, cited: Column, supported: Column, miscited: Column, invalid: Column) -> Column:
    """Share of supported claims less penalties; of cited ones at 0.6 where nothing was verified; 0 without claims."""
    checked = supported / total - F.when(invalid > 0, 0.15).otherwise(0.0) - 0.3 * miscited / total
    return F.when(F.coalesce(total, F.lit(0)) == 0, 0.0).when(verified, clamp(checked)).otherwise(clamp(0.6 * cited / total))


def composite(retrieval: Column, citation: Column, completeness: Column) -> Column:
    return rounded(clamp(WEIGHTS[0] * retrieval + WEIGHTS[1] * citation + WEIGHTS[2] * clamp(completeness)))


def band(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.45, "medium").otherwise("low")


def source_status(verdicts: DataFrame, sources: DataFrame) -> DataFrame:
    """message_id, source_no and status: the worst verdict that cites the source (unsupported, partial, supported), or unused."""
    severity = F.when(F.col("status") == "unsupported", 3).when(F.col("status") == "partial", 2).when(F.col("status") == "supported", 1)
    worst = verdicts.groupBy("message_id", "source_no").agg(F.max(severity).alias("s"))
    name = F.when(F.col("s") == 3, "unsupported").when(F.col("s") == 2, "partial").when(F.col("s") == 1, "supported").otherwise("unused")
    return sources.select("message_id", "source_no").join(worst, ["message_id", "source_no"], "left").select("message_id", "source_no", name.alias("status"))


# The wording of reports to users, and what a judge may be given.
MOST_CLAIMS, REASON_CHARS, SNIPPET_CHARS = 24, 240, 120
NO_SOURCES = "(no sources retrieved)"
PROMPT_END = "Answer the question using only the CONTEXT above. End every factual sentence with its bracketed source number(s)."
ABSTAIN_START = "I could not answer this from the indexed documents with enough confidence to be useful, so I am not going to guess."
ABSTAIN_END = "You can raise topK in Settings, select a different document scope, or index the source that should contain this answer."
NOTHING_FOUND = "- Nothing above the relevance threshold."
NOT_TIED = "The terms appear in the corpus, but no passage ties them together well enough to answer confidently."


def normal_status(status: Column) -> Column:
    """A judge's word for a claim: supported, partial, unsupported, or unverified for anything else."""
    s = F.lower(F.coalesce(status, F.lit("")))
    return F.when(s.isin("supported", "unsupported"), s).when(s.isin("partial", "partially_supported"), "partial").otherwise("unverified")


def judged_claims(verdicts: DataFrame, most: int = MOST_CLAIMS) -> DataFrame:
    """``verdicts`` (key, claim_no from 0, citations, supported_by, status; a null status for a claim without a judge's
    word) with the final status: what is supported but cites other sources only is partial; claims beyond ``most`` are
    unverified. supported_by keeps whole numbers from 1. Null lists are empty."""
    cites, supports = (F.coalesce(c, F.array().cast("array<int>")) for c in ("citations", "supported_by"))
    supports = F.filter(supports, lambda n: n > 0)
    status = normal_status(F.col("status"))
    beyond = F.col("claim_no") >= most
    wrong = (status == "supported") & (F.size(cites) > 0) & ~F.arrays_overlap(cites, supports)
    return verdicts.withColumn("status", F.when(beyond, "unverified").when(wrong, "partial").otherwise(status)).withColumn("citations", cites).withColumn("supported_by", F.when(beyond, F.array().cast("array<int>")).otherwise(supports))


def verdict_report(verdicts: DataFrame, most: int = MOST_CLAIMS) -> DataFrame:
    """One row for each key of ``verdicts`` (as ``judged_claims`` takes them): total_claims, cited_claims,
    supported_claims (cited and supported), unsupported_claims, grounded_claims (supported or partial) and
    miscited_claims (partial, with sources that support but none of them cited)."""
    status, cited = F.col("status"), F.size("citations") > 0
    miscited = cited & (status == "partial") & (F.size("supported_by") > 0) & ~F.arrays_overlap("citations", "supported_by")
    return judged_claims(verdicts, most).groupBy("key").agg(
        F.count(F.lit(1)).alias("total_claims"), F.count_if(cited).alias("cited_claims"), F.count_if(cited & (status == "supported")).alias("supported_claims"), F.count_if(status == "unsupported").alias("unsupported_claims"),
        F.count_if(status.isin("supported", "partial")).alias("grounded_claims"), F.count_if(miscited).alias("miscited_claims"),
    )


def unverified_report(report: DataFrame) -> DataFrame:
    """A ``citation_report`` as the report of an answer that no judge has seen: nothing is supported, grounded or miscited."""
    zero = F.lit(0).cast("long")
    return report.withColumns({"verified": F.lit(False), "supported_claims": zero, "unsupported_claims": zero, "grounded_claims": zero, "miscited_claims": zero})


def completeness(addressed: Column, total: Column, claims: Column, verified: Column | None = None, failed: Column | None = None) -> Column:
    """The share of a question's parts that are addressed; without parts 1 if there are claims, else 0. 0.5 where the
    judge failed."""
    verified, failed = F.lit(True) if verified is None else verified, F.lit(False) if failed is None else failed
    share = F.when(verified & (F.coalesce(total, F.lit(0)) > 0), addressed / total).otherwise(F.when(F.coalesce(claims, F.lit(0)) > 0, 1.0).otherwise(0.0))
    return rounded(F.when(failed, 0.5).otherwise(share))


def judge(answers: DataFrame, judge_fn, most: int = MOST_CLAIMS, shown: int = 1400) -> DataFrame:
    """key, claim_no, status, supported_by and reason of the first ``most`` claims of each answer, by a given function from
    a question, claims and sources (cut to ``shown``) to a list of {id, status, supportedBy, reason}; a function that
    fails leaves the claims without a word. answers: key, question, claims ARRAY<STRING>, sources ARRAY<STRING>."""
    kind = answers.schema["key"].dataType.simpleString()

    def run(batches):
        for b in batches:
            out = []
            for k, q, claims, sources in zip(b["key"], b["question"], b["claims"], b["sources"]):
                claims = list(claims if claims is not None else [])[:most]
                try:
                    said = {int(v["id"]): v for v in judge_fn(q or "", claims, [(s or "")[:shown] for s in (sources if sources is not None else [])])} if claims else {}
                except Exception:  # a judge that fails must not fail the batch
                    said = {}
                for n in range(len(claims)):
                    v = said.get(n, {})
                    out.append((k, n, v.get("status"), [int(x) for x in v.get("supportedBy") or []], (v.get("reason") or "")[:REASON_CHARS] or None))
            yield pd.DataFrame(out, columns=["key", "claim_no", "status", "supported_by", "reason"])

    return answers.select("key", "question", "claims", "sources").mapInPandas(run, f"key {kind}, claim_no int, status string, supported_by array<int>, reason string")


def json_reply(text: Column, schema: str) -> Column:
    """The JSON of a model's reply, without the code fence around it."""
    bare = F.regexp_replace(F.trim(text), r"(?is)^```(?:json)?\s*|\s*```$", "")
    return F.from_json(bare, schema)


def percent(x: Column) -> Column:
    return F.concat(F.floor(x * 100 + 0.5).cast("string"), F.lit("%"))


def score_reasons() -> Column:
    """Why an answer scores as it does, in order, from the columns of its statistics (mode, dense_hits, sparse_hits,
    rerank_used, rerank_backend, top_dense_score, keyword_coverage), its report (verified, total_claims,
    unsupported_claims, miscited_claims, invalid_citations) and its scores (retrieval, completeness)."""
    c = F.col
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    number = lambda name: F.coalesce(c(name), F.lit(0)).cast("string")
    has = lambda name: F.coalesce(c(name), F.lit(0)) > 0
    two = F.format_string("%.2f", F.floor(F.coalesce("top_dense_score", F.lit(0.0)) * 100 + 0.5) / 100)
    invalid = F.array_join(F.transform("invalid_citations", lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))), ", ")
    said = (
        (c("retrieval") < 0.5, text("Weak retrieval signal (top similarity ", two, ", keyword coverage ", percent(F.coalesce("keyword_coverage", F.lit(0.0))), ").")),
        ((c("mode") == "hybrid") & (~has("dense_hits") | ~has("sparse_hits")), text("Only one retriever returned results (", number("dense_hits"), " dense, ", number("sparse_hits"), " sparse).")),
        (~F.coalesce("rerank_used", F.lit(False)), text("Reranking was skipped, so passage ordering is unfiltered.")),
        (c("rerank_used") & (c("rerank_backend") == "lexical"), text("LLM reranker was unavailable; lexical fallback was used.")),
        (~F.coalesce("verified", F.lit(False)), text("Citations were not verified against the sources.")),
        (c("verified") & has("unsupported_claims"), text(number("unsupported_claims"), " of ", number("total_claims"), " claims were not supported by any retrieved source.")),
        (c("verified") & has("miscited_claims"), text(number("miscited_claims"), " claims cited the wrong source number.")),
        (c("verified") & (F.size("invalid_citations") > 0), text("Answer referenced non-existent sources: ", invalid, ".")),
        (c("completeness") < 0.75, text("Part of the question appears unanswered.")),
    )
    found = F.filter(F.array(*[F.when(condition, reason) for condition, reason in said]), lambda r: r.isNotNull())
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("All claims verified against retrieved sources.")))


def abstains(sources: Column, retrieval: Column, threshold: float = ABSTAIN_BELOW) -> Column:
    """Whether a question isn't answered: no sources, or too little confidence in them."""
    return (F.coalesce(sources, F.lit(0)) == 0) | (F.coalesce(retrieval, F.lit(0.0)) < threshold)


def _located(s: Column) -> Column:
    """file › heading, or file · page n."""
    return F.when(s["heading"].isNotNull() & (s["heading"] != ""), F.concat(s["filename"], F.lit(" › "), s["heading"])).otherwise(F.concat(s["filename"], F.lit(" · page "), s["page"].cast("string")))


def abstain_text(sources: Column, retrieval: Column, coverage: Column, threshold: float = ABSTAIN_BELOW) -> Column:
    """The answer in place of a guess, from the sources in order (ARRAY of STRUCT with filename, heading, page, text): what
    was found (the first five, each once), what is missing, and up to five files to look at."""

    def described(s: Column) -> Column:
        clean = F.regexp_replace(F.regexp_replace(F.coalesce(s["text"], F.lit("")), r"(?U)\s+", " "), "^ +| +$", "")
        return F.concat(_located(s), F.lit(" — "), F.when(F.length(clean) > SNIPPET_CHARS, F.concat(F.substring(clean, 1, SNIPPET_CHARS), F.lit("…"))).otherwise(clean))

    bullets = lambda items: F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")
    none = F.array().cast("array<string>")
    topics = F.coalesce(F.array_distinct(F.transform(F.slice(sources, 1, 5), described)), none)
    files = F.coalesce(F.slice(F.array_distinct(F.transform(sources, lambda s: s["filename"])), 1, 5), none)
    missing = F.when(coverage < 0.5, F.concat(F.lit("Several terms from your question do not appear anywhere in the indexed text (keyword coverage "), percent(coverage), F.lit(")."))).otherwise(NOT_TIED)
    files_part = F.when(F.size(files) > 0, F.concat(F.lit("\n\n**Worth checking manually**\n"), bullets(files))).otherwise("")
    return F.concat(
        F.lit(f"{ABSTAIN_START}\n\n**Retrieval confidence** "), percent(retrieval), F.lit(" (threshold "), percent(F.lit(threshold)), F.lit(")\n\n**What I did find**\n"),
        F.when(F.size(topics) > 0, bullets(topics)).otherwise(NOTHING_FOUND), F.lit("\n\n**What is missing**\n"), missing, files_part, F.lit(f"\n\n{ABSTAIN_END}"),
    )


def prompt_text(question: Column, sources: Column) -> Column:
    """The prompt of a question and its sources in order (ARRAY of STRUCT with citation, filename, heading, page, text)."""
    block = lambda s: F.concat(F.lit("["), s["citation"].cast("string"), F.lit("] "), _located(s), F.lit("\n"), F.coalesce(s["text"], F.lit("")))
    context = F.when(F.coalesce(F.size(sources), F.lit(0)) > 0, F.array_join(F.transform(sources, block), "\n\n")).otherwise(NO_SOURCES)
    return F.concat(F.lit("CONTEXT\n"), context, F.lit("\n\nQUESTION\n"), F.coalesce(question, F.lit("")), F.lit(f"\n\n{PROMPT_END}"))


def linked_markers(answer: Column) -> Column:
    """The answer with [2, 4] as [2](#source-2) [4](#source-4), but not in code."""
    one = lambda m: F.regexp_replace(m, r"(\d+)", r"[$1](#source-$1)")
    numbers = F.regexp_extract_all(answer, F.lit(CITATION), 1)
    linked = lambda text: F.aggregate(F.array_distinct(numbers), text, lambda so_far, m: F.replace(so_far, F.concat(F.lit("["), m, F.lit("]")), F.regexp_replace(one(m), r"\s*,\s*", " ")))
    # odd pieces of an alternation of fences lie inside code
    fences = F.split(answer, "```", -1)
    inline = lambda part: F.array_join(F.transform(F.split(part, "`", -1), lambda x, n: F.when(n % 2 == 0, linked(x)).otherwise(x)), "`")
    return F.array_join(F.transform(fences, lambda part, n: F.when(n % 2 == 0, inline(part)).otherwise(part)), "```")
