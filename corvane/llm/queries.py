"""Queries of the training-data operators, and SQL where SQL can tell the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.context import table
from corvane.llm import conversations, history, packing, pairs, spam, splitting, tokens


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    found = history.repeated_chunks(table(spark, folder, "chunks"))
    return found.select(F.least("case_id", "kept_id").alias("id_a"), F.greatest("case_id", "kept_id").alias("id_b"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return splitting.oversized_items(table(spark, folder, "documents"), table(spark, folder, "chunks"), with_text=False).select("item_id", "cut")


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    items = splitting.oversized_items(table(spark, folder, "documents"), table(spark, folder, "chunks"))
    return items.select("item_id", "heading", F.inline("pieces"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.defective_pairs(table(spark, folder, "questions"), table(spark, folder, "messages"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.chat_verdicts(table(spark, folder, "chats"), table(spark, folder, "messages")).filter("not kept").select("chat_id")


def p5_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.conversations(table(spark, folder, "chats"), table(spark, folder, "messages"))


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.encode_texts(table(spark, folder, "documents"), keep=["doc_id"])


def p6_decoded(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.decode_ids(p6_ids(spark, folder), keep=["doc_id"])


def p7_containers(spark: SparkSession, folder: str) -> DataFrame:
    sized = tokens.encode_texts(table(spark, folder, "documents"), keep=["doc_id"], counts=True)
    return packing.pack(sized, "doc_id")


def p7_instructions(spark: SparkSession, folder: str) -> DataFrame:
    """Prompt and response pairs under three limits: tokens, segments and loss-bearing tokens (those of the response)."""
    data = pairs.question_pairs(table(spark, folder, "questions")).unionByName(pairs.message_pairs(table(spark, folder, "messages")))
    return packing.pack(packing.instruction_items(data), "pair_id", loss="n_loss", max_segments=16, max_loss=1536)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return spam.spam_pages(table(spark, folder, "documents")).select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p2_found, p2_pieces, p3_found, p5_found, p5_conversations, p6_ids, p6_decoded, p7_containers, p7_instructions, p8_found)}

_WHITE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ROLE = f"lower(regexp_replace(role, '^({_WHITE}|\\x{{feff}})+|({_WHITE}|\\x{{feff}})+$', '', 'g'))"
_LATEST = "SELECT * FROM messages QUALIFY row_number() OVER (PARTITION BY id ORDER BY received_at DESC NULLS LAST) = 1"

ORACLES: dict[str, str] = {
    "p2_found": f"""
        WITH items AS (
            SELECT id AS item_id, text FROM chunks
            UNION
            SELECT d.id || '#' || (s.place - 1) AS item_id, d.processed_sections[s.place].text AS text
            FROM documents d, LATERAL (SELECT unnest(range(1, len(d.processed_sections) + 1)) AS place) s
        ), stripped AS (SELECT item_id, regexp_replace(text, '^{_WHITE}+|{_WHITE}+$', '', 'g') AS t FROM items)
        SELECT item_id, CASE WHEN list_max(list_transform(regexp_split_to_array(t, '{_WHITE}|[。！？]'), lambda x: length(x))) > 850 THEN 'forced' ELSE 'boundary' END AS cut
        FROM stripped WHERE length(t) > 850""",
    "p5_found": f"""
        WITH turns AS (
            SELECT chat_id, created_at, coalesce(regexp_matches(content, '[^\\p{{Z}}\\p{{C}}]'), false) AS seen,
                CASE WHEN {_ROLE} IN ('user', 'human') THEN 'u' WHEN {_ROLE} IN ('assistant', 'ai', 'bot', 'model') THEN 'a' WHEN {_ROLE} IN ('system', 'tool') THEN 's' ELSE 'x' END AS r
            FROM ({_LATEST}) WHERE chat_id IS NOT NULL
        ), sequences AS (
            SELECT chat_id, string_agg(r, '' ORDER BY created_at, CASE r WHEN 'u' THEN 0 ELSE 1 END) AS s, bool_and(seen) AS seen FROM turns WHERE r <> 's' GROUP BY chat_id
        ), kept AS (SELECT chat_id FROM sequences WHERE seen AND regexp_full_match(s, '(ua)+') AND chat_id IN (SELECT id FROM chats))
        SELECT DISTINCT chat_id FROM (SELECT id AS chat_id FROM chats WHERE id IS NOT NULL UNION SELECT chat_id FROM turns) WHERE chat_id NOT IN (SELECT chat_id FROM kept)""",
    # as p5_found, with Otsu's threshold over a histogram of the logarithms of all pauses as the gap
    "p5_conversations": f"""
        WITH turns AS (
            SELECT id, chat_id, created_at, regexp_replace(content, '^({_WHITE}|\\x{{feff}})+|({_WHITE}|\\x{{feff}})+$', '', 'g') AS content, coalesce(regexp_matches(content, '[^\\p{{Z}}\\p{{C}}]'), false) AS seen,
                CASE WHEN {_ROLE} IN ('user', 'human') THEN 'u' WHEN {_ROLE} IN ('assistant', 'ai', 'bot', 'model') THEN 'a' WHEN {_ROLE} IN ('system', 'tool') THEN 's' ELSE 'x' END AS r
            FROM ({_LATEST}) WHERE chat_id IS NOT NULL
        ), sequences AS (
            SELECT chat_id, string_agg(r, '' ORDER BY created_at, CASE r WHEN 'u' THEN 0 ELSE 1 END) AS s, bool_and(seen) AS seen FROM turns WHERE r <> 's' GROUP BY chat_id
        ), kept AS (SELECT chat_id FROM sequences WHERE seen AND regexp_full_match(s, '(ua)+') AND chat_id IN (SELECT id FROM chats)),
        instants AS (SELECT chat_id, created_at, min(CASE r WHEN 'u' THEN 0 ELSE 1 END) AS first FROM turns WHERE r <> 's' AND created_at IS NOT NULL GROUP BY 1, 2),
        paused AS (SELECT *, epoch_us(created_at) / 1e6 - lag(epoch_us(created_at) / 1e6) OVER (PARTITION BY chat_id ORDER BY created_at) AS pause FROM instants),
        bins AS (SELECT floor(ln(pause) / ln(2) * 4)::INT AS b, count(*) AS n FROM paused WHERE pause > 0 GROUP BY 1),
        sums AS (SELECT sum(n) AS total, sum(b * n) / sum(n) AS mean, sum(b * b * n) / sum(n) - (sum(b * n) / sum(n)) ** 2 AS variance FROM bins),
        steps AS (SELECT b, lead(b) OVER (ORDER BY b) AS following, sum(n) OVER (ORDER BY b) AS weight, sum(b * n) OVER (ORDER BY b) AS low FROM bins),
        apart AS (SELECT b, following, weight * (total - weight) / (total * total) * (low / weight - (mean * total - low) / (total - weight)) ** 2 AS between_them, variance FROM steps, sums WHERE following IS NOT NULL),
        gap AS (SELECT coalesce((SELECT CASE WHEN between_them >= 0.5 * variance THEN 2.0 ** ((b + 1 + following) / 2.0 / 4) END FROM apart ORDER BY between_them DESC, b LIMIT 1), 'infinity'::DOUBLE) AS seconds),
        numbered AS (SELECT chat_id, created_at, 1 + sum(CASE WHEN first = 0 AND pause > seconds THEN 1 ELSE 0 END) OVER (PARTITION BY chat_id ORDER BY created_at) AS session_no FROM paused, gap)
        SELECT t.chat_id, n.session_no::BIGINT AS session_no, row_number() OVER (PARTITION BY t.chat_id ORDER BY t.created_at, CASE r WHEN 'u' THEN 0 ELSE 1 END) AS turn_no, CASE r WHEN 'u' THEN 'user' ELSE 'assistant' END AS role, content, t.created_at, id AS message_id
        FROM turns t JOIN numbered n ON t.chat_id = n.chat_id AND t.created_at = n.created_at WHERE r IN ('u', 'a') AND t.chat_id IN (SELECT chat_id FROM kept)""",
    "p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
