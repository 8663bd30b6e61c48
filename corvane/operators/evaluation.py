"""Metrics of evaluation runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.terms import rounded

METRICS = ("correctness", "faithfulness", "retrieval_recall", "citation_accuracy")


def retrieval_metrics(passages: DataFrame, cases: DataFrame) -> DataFrame:
    """query, hit and reciprocal_rank: whether and where the first expected file stands among the passages (query, rank,
    filename) of a case (query, expected ARRAY<STRING>); null where nothing is expected, 0 where nothing is found."""
    asked = cases.select("query", F.explode(F.array_distinct("expected")).alias("filename"))
    best = passages.join(asked, ["query", "filename"]).groupBy("query").agg(F.min("rank").alias("best"))
    expected = F.size(F.coalesce("expected", F.array().cast("array<string>"))) > 0
    return cases.select("query", expected.alias("any")).join(best, "query", "left").select("query", F.when(F.col("any"), F.when(F.col("best").isNull(), 0).otherwise(1)).alias("hit"), F.when(F.col("any"), F.coalesce(rounded(1 / F.col("best"), 6), F.lit(0.0))).alias("reciprocal_rank"))


def must_include(answer: Column, needles: Column) -> Column:
    """Whether all needles are in the answer, without regard to case; null without needles."""
    return F.when(F.size(needles) > 0, F.forall(needles, lambda n: F.contains(F.lower(answer), F.lower(n))))


def snapped(score: Column) -> Column:
    """A judge's score as 0, 0.5 or 1."""
    return F.when(score >= 0.75, 1.0).when(score >= 0.25, 0.5).otherwise(0.0)


def aggregated(results: DataFrame, by: list[str], metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Counts and means (3 digits, nulls skipped, 0 for none) for all subtotals of ``by``."""
    means = [F.coalesce(rounded(F.avg(m)), F.lit(0.0)).alias(m) for m in metrics]
    return results.rollup(*by).agg(F.count(F.lit(1)).alias("runs"), *means)


def comparison(runs: DataFrame, label: str, metrics: tuple[str, ...] = METRICS, lowest: tuple[str, ...] = ("duration_ms",)) -> DataFrame:
    """metric, label, value and whether it is the best of its metric: the greatest, or the least for those in ``lowest``."""
    long = runs.select(F.col(label).alias("label"), F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])).alias("x")).groupBy("label", "x.metric").agg(rounded(F.avg("x.value")).alias("value"))
    w = Window.partitionBy("metric")
    best = F.when(F.col("metric").isin(*lowest), F.min("value").over(w)).otherwise(F.max("value").over(w)) if lowest else F.max("value").over(w)
    return long.withColumn("best", F.coalesce(F.col("value") == best, F.lit(False))).select("metric", "label", "value", "best")


def comparison_markdown(compared: DataFrame) -> DataFrame:
    """One row (line_no, line) for each line of the comparison as a Markdown table, the best cells in bold. Labels and
    metrics are few, so the table is one small group."""
    cell = F.when(F.col("best"), F.concat(F.lit("**"), F.col("value").cast("string"), F.lit("**"))).otherwise(F.coalesce(F.col("value").cast("string"), F.lit("–")))
    rows = compared.groupBy("metric").agg(F.array_sort(F.collect_list(F.struct("label", cell.alias("cell")))).alias("cells"))
    line = lambda first, cells: F.concat(F.lit("| "), F.concat_ws(" | ", first, cells), F.lit(" |"))
    head = compared.agg(F.array_sort(F.collect_set("label")).alias("labels")).select(F.lit(0).alias("line_no"), line(F.lit("metric"), F.col("labels")).alias("line"), F.size("labels").alias("n"))
    rule = head.select(F.lit(1).alias("line_no"), F.concat(F.lit("| --- |"), F.repeat(F.lit(" --- |"), F.col("n"))).alias("line"))
    body = rows.select((F.row_number().over(Window.orderBy("metric")) + 1).alias("line_no"), line(F.col("metric"), F.transform("cells", lambda c: c["cell"])).alias("line"))
    return head.drop("n").unionByName(rule).unionByName(body)


def abstain_correct(expected: Column, abstained: Column) -> Column:
    """Whether the gate fired exactly where it should."""
    return F.coalesce(expected, F.lit(False)) == F.coalesce(abstained, F.lit(False))


def case_results(cases: DataFrame, answers: DataFrame, reports: DataFrame, retrieval: DataFrame) -> DataFrame:
    """One row for each case (id, case_type, expect_abstain, must_include) with its metrics.

    answers: id, answer, abstained, judged (a judge's score), confidence, duration_ms, error; reports: id, verified,
    total_claims, grounded_claims, cited_claims, supported_claims; retrieval: id, hit, reciprocal_rank. faithfulness is the
    share of grounded claims and citation_accuracy that of supported among cited ones, both null unless verified and
    counted, or where the answer abstains; must_include is null then, too. A case without an answer, or with an error, is
    a row of zeros and nulls.
    """
    joined = cases.select("id", "case_type", "expect_abstain", "must_include").join(answers, "id", "left").join(reports, "id", "left").join(retrieval.select("id", "hit", "reciprocal_rank"), "id", "left")
    ran, speaks = F.col("error").isNull() & F.col("answer").isNotNull(), ~F.coalesce("abstained", F.lit(False))
    share = lambda a, b: F.when(ran & speaks & F.coalesce("verified", F.lit(False)), F.try_divide(a, b))
    zero = lambda c: F.when(ran, F.coalesce(c, F.lit(0.0))).otherwise(0.0)
    return joined.select(
        "id", "case_type", F.when(ran, snapped(F.coalesce("judged", F.lit(0.0)))).otherwise(0.0).alias("correctness"), share("grounded_claims", "total_claims").alias("faithfulness"), share("supported_claims", "cited_claims").alias("citation_accuracy"),
        F.when(ran, F.col("hit")).alias("hit"), F.when(ran, F.col("reciprocal_rank")).alias("reciprocal_rank"), F.when(ran & speaks, must_include(F.col("answer"), F.col("must_include"))).alias("complete"),
        F.when(ran, abstain_correct(F.col("expect_abstain"), F.col("abstained"))).otherwise(False).alias("abstain_correct"), zero("confidence").alias("confidence"), F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"), "error",
    )


def run_summary(results: DataFrame) -> DataFrame:
    """Of ``case_results`` the means over all cases and by case type (null type for all): cases, correctness, faithfulness,
    citation_accuracy, hit, reciprocal_rank, complete, abstain_correct (3 digits, nulls skipped, 0 for none) and the
    mean duration as a whole number."""
    number = lambda c: F.col(c).cast("double")
    mean = lambda c: F.coalesce(rounded(F.avg(number(c))), F.lit(0.0)).alias(c)
    names = ("correctness", "faithfulness", "citation_accuracy", "hit", "reciprocal_rank", "complete", "abstain_correct")
    return results.rollup("case_type").agg(F.count(F.lit(1)).alias("cases"), *[mean(c) for c in names], F.floor(F.avg("duration_ms") + 0.5).cast("long").alias("duration_ms"))


def needs_attention(results: DataFrame) -> DataFrame:
    """The cases that aren't fully correct, or whose gate was wrong."""
    return results.filter((F.coalesce("correctness", F.lit(0.0)) < 1) | ~F.coalesce("abstain_correct", F.lit(False)))


def can_reuse(corpus: DataFrame, documents: DataFrame, strategy: str, model: str) -> DataFrame:
    """One row (reuse): whether the indexed documents (filename, status, chunk_strategy, embedding_model) are exactly the
    files of the corpus (filename), all ready and made by this strategy and model. An empty corpus is never reused."""
    good = (F.col("status") == "ready") & (F.col("chunk_strategy") == strategy) & (F.col("embedding_model") == model)
    files = corpus.select("filename", F.lit(1).alias("wanted"), F.lit(0).alias("have"), F.lit(0).alias("bad"))
    own = documents.select("filename", F.lit(0).alias("wanted"), F.lit(1).alias("have"), F.when(F.coalesce(good, F.lit(False)), 0).otherwise(1).alias("bad"))
    by_file = files.unionByName(own).groupBy("filename").agg(F.sum("wanted").alias("wanted"), F.sum("have").alias("have"), F.sum("bad").alias("bad"))
    return by_file.agg((F.coalesce(F.sum("wanted"), F.lit(0)) > 0).alias("any"), F.coalesce(F.min((F.col("wanted") == F.col("have")) & (F.col("bad") == 0)), F.lit(False)).alias("same")).select((F.col("any") & F.col("same")).alias("reuse"))


def run_config(flags: list[str]) -> dict[str, object]:
    """A run's configuration from flags such as --top-k 8, --rerank off or --dense-weight=0.7: names in camel case, numbers
    and on/off read, and the sparse weight what is missing to 1 (2 digits) unless given."""
    out: dict[str, object] = {}
    words = iter([part for flag in flags for part in (flag.split("=", 1) if flag.startswith("--") else [flag])])
    name = None
    for word in [*words, None]:
        if word is None or word.startswith("--"):
            if name is not None:
                out[name] = True
            if word is None:
                break
            head, *rest = word[2:].split("-")
            name = head + "".join(part.capitalize() for part in rest)
        elif name is not None:
            value: object = {"on": True, "true": True, "off": False, "false": False}.get(word.lower(), word)
            if isinstance(value, str):
                try:
                    value = float(value) if "." in value else int(value)
                except ValueError:
                    pass
            out[name], name = value, None
    if "denseWeight" in out and "sparseWeight" not in out:
        out["sparseWeight"] = round(1 - float(out["denseWeight"]), 2)
    return out
