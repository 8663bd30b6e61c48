"""Terms, sentences and normal forms of texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Stop words and patterns.
STOPWORDS = "a an and are as at be but by can did do does for from had has have how i if in into is it its of on or our that the their then there these they this to was were what when where which who why will with you your".split()
RAW_TOKEN = "([a-z0-9][a-z0-9_./-]*[a-z0-9]|[a-z0-9]+)"
SENTENCE_BREAK = "(?<=[.!?])\\s+(?=[A-Z(“\"'\\d])"
KEPT_WHOLE = "^([-*+•]|\\d+[.)]|\\||#{1,6}\\s)"
BLOCK_TAGS = "address|article|aside|blockquote|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul"
SOURCE_TYPES = {"pdf": ("pdf",), "markdown": ("md", "markdown", "mdx"), "html": ("html", "htm", "xhtml"), "text": ("txt", "text", "log")}


def stem(token: Column) -> Column:
    """Plural endings only; short tokens and identifiers stay."""
    cut = lambda n: F.substring(token, F.lit(1), F.length(token) - n)
    return (
        F.when((F.length(token) <= 3) | token.rlike("[._/-]") | token.rlike("(ss|us|is|as|os)$"), token)
        .when(token.endswith("ies"), F.concat(cut(3), F.lit("y")))
        .when(token.rlike("(ches|shes|xes|ses|zes)$"), cut(2))
        .when(token.endswith("s"), cut(1))
        .otherwise(token)
    )


def normal_term(token: Column) -> Column:
    """The term of a raw token; null for single letters, stop words and the empty token."""
    return F.when((token == "") | token.rlike("^[a-z]$") | token.isin(*STOPWORDS), F.lit(None).cast("string")).otherwise(stem(token))


def terms(df: DataFrame, text: Column, expand: bool = True) -> DataFrame:
    """One row for each term occurrence of ``text``: the columns of ``df`` and term. With ``expand`` the parts of
    identifiers come besides the whole. Null texts have no terms."""
    raw = df.withColumn("_t", F.explode(F.regexp_extract_all(F.lower(text), F.lit(RAW_TOKEN), 1)))
    if not expand:
        return raw.withColumn("term", normal_term(F.col("_t"))).filter("term is not null").drop("_t")
    parts = F.when(F.col("_t").rlike("[._/-]"), F.concat(F.array("_t"), F.split("_t", "[._/-]+"))).otherwise(F.array("_t"))
    each = raw.select("*", F.posexplode(parts).alias("_n", "_p")).withColumn("term", normal_term(F.col("_p")))
    whole = normal_term(F.col("_t"))
    return each.filter(F.col("term").isNotNull() & ((F.col("_n") == 0) | whole.isNull() | (F.col("term") != whole))).drop("_t", "_n", "_p")


def normalize_text(raw: Column) -> Column:
    """Line ends, blanks and empty lines in one form, trimmed."""
    text = F.regexp_replace(raw, "\r\n?", "\n")
    text = F.regexp_replace(text, "\u00a0", " ")
    text = F.regexp_replace(text, "[ \t]+\n", "\n")
    text = F.regexp_replace(text, "[ \t]{2,}", " ")
    text = F.regexp_replace(text, "\n{3,}", "\n\n")
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def fingerprint(text: Column) -> Column:
    """SHA-256 of the text in lower case with single spaces."""
    return F.sha2(F.trim(F.regexp_replace(F.lower(text), "(?U)\\s+", " ")), 256)


def _decimal_references(text: Column) -> Column:
    """The text with decimal references (&#8217;) read; those of no character stay as they are."""

    def read(part: Column) -> Column:
        number = F.regexp_extract(part, r"^(\d{1,7});", 1).try_cast("bigint")
        good = number.between(1, 0xD7FF) | number.between(0xE000, 0xFFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(number), 4, "0")), "UTF-16BE")
        return F.when(good, F.concat(char, F.regexp_replace(part, r"^\d+;", ""))).otherwise(F.concat(F.lit("&#"), part))

    parts = F.split(text, "&#", -1)
    read_all = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), read), ""))
    return F.when(F.contains(text, F.lit("&#")), read_all).otherwise(text)


def html_to_text(raw: Column) -> Column:
    """Visible text of HTML; blocks become lines, six named entities and decimal references are read."""
    steps = (
        (r"(?s)<!--.*?-->", " "), (r"(?is)<(script|style|noscript|template).*?</\1>", " "), (r"(?i)<br\s*/?>", "\n"), (f"(?i)</(?:{BLOCK_TAGS})>", "\n\n"), (f"(?i)<(?:{BLOCK_TAGS})\\b[^>]*>", "\n"), ("<[^>]+>", " "),
        ("(?i)&nbsp;", " "), ("(?i)&amp;", "&"), ("(?i)&lt;", "<"), ("(?i)&gt;", ">"), ("(?i)&quot;", "\""), ("(?i)&#39;|&apos;", "'"),
    )
    for pattern, new in steps:
        raw = F.regexp_replace(raw, pattern, new)
    return normalize_text(_decimal_references(raw))


def source_type(filename: Column) -> Column:
    """pdf, markdown, html or text by the extension; null for others."""
    extension = F.regexp_extract(F.lower(filename), r"\.([a-z0-9]+)$", 1)
    kind = F.lit(None).cast("string")
    for name, endings in SOURCE_TYPES.items():
        kind = F.when(extension.isin(*endings), name).otherwise(kind)
    return kind


def sentences(df: DataFrame, text: Column) -> DataFrame:
    """One row for each sentence unit of each line: the columns of ``df``, line_no, unit_no (from 0) and unit. Bullets,
    table rows, headings and lines under 80 characters stay whole."""
    lines = df.select("*", F.posexplode(F.split(text, "\n")).alias("line_no", "_l")).withColumn("_l", F.regexp_replace("_l", "^\\s+|\\s+$", "")).filter("_l <> ''")
    units = F.when(F.col("_l").rlike(KEPT_WHOLE) | (F.length("_l") < 80), F.array("_l")).otherwise(F.split("_l", SENTENCE_BREAK))
    return lines.select("*", F.posexplode(units).alias("unit_no", "_u")).withColumn("unit", F.regexp_replace("_u", "^\\s+|\\s+$", "")).filter("unit <> ''").drop("_l", "_u")


def rounded(x: Column, digits: int = 3) -> Column:
    """Half up, also below zero."""
    return F.floor(x * 10**digits + 0.5) / 10**digits
