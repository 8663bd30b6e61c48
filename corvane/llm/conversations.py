"""Conversations rebuilt from message rows.

Rows are sessionized: the turns of a channel (chat) are sorted by time, split where a user comes back after an
inactivity gap calibrated from all pauses, given roles, and sessions without reciprocal replies are dropped.

A channel may hold a third of all rows, so no step gathers a channel: turns are summed up by instant with a map-side
aggregate, instants are ordered within a channel's *slots* (a fixed width of time), and slots are joined up in order.
Each step passes on what the next needs of the ends: first and last speaker, time, counts and faults.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.context import materialize
from corvane.functions.text import clean_role, is_seen, strip_white
from corvane.operators.deliveries import latest_deliveries

SLOT_SECONDS = 3600
#: Bins of the pauses' histogram for each doubling, and the least share of the variance that two groups of pauses must
#: explain to be told apart; with less, nothing is split.
BINS, LEAST_APART = 4, 0.5


def slot_of(at: Column, seconds: int = SLOT_SECONDS) -> Column:
    """Number of the slot of a TIMESTAMP_NTZ or TIMESTAMP; -1 for null (before all others)."""
    return F.coalesce(F.floor(F.unix_micros(at.cast("timestamp")) / (seconds * 1_000_000)), F.lit(-1)).cast("long")


def turns_of(messages: DataFrame, content: bool = False) -> DataFrame:
    """The latest deliveries with a channel, as id, chat_id, role (clean), seen, created_at and, on request, the clean content."""
    kept = messages.select("id", "chat_id", "created_at", "received_at", clean_role(F.col("role")).alias("role"), is_seen(F.col("content")).alias("seen"), *([strip_white(F.col("content")).alias("content")] if content else []))
    return latest_deliveries(kept, ["chat_id", "created_at", "role", "seen", *(["content"] if content else [])]).filter("chat_id is not null")


def _instants(turns: DataFrame) -> DataFrame:
    """One row for each channel and instant. ok: at most one user and one assistant turn, the user first, nothing unknown or unseen."""
    n = lambda role: F.sum(F.when(F.col("role") == role, 1).otherwise(0))
    return (
        turns.filter("role <> 'other'")
        .groupBy("chat_id", "created_at")
        .agg(n("user").alias("u"), n("assistant").alias("a"), n("unknown").alias("x"), F.sum(F.when(F.col("seen"), 0).otherwise(1)).alias("b"))
        .select(
            "chat_id", (F.unix_micros(F.col("created_at").cast("timestamp")) / 1e6).alias("at"), slot_of(F.col("created_at")).alias("slot"), (F.col("u") + F.col("a") + F.col("x")).alias("n"),
            ((F.col("u") <= 1) & (F.col("a") <= 1) & (F.col("x") == 0) & (F.col("b") == 0) & F.col("created_at").isNotNull()).alias("ok"),
            F.when(F.col("u") > 0, "user").otherwise("assistant").alias("first"), F.when(F.col("a") > 0, "assistant").otherwise("user").alias("last"),
        )
    )


def pause_histogram(instants: DataFrame) -> DataFrame:
    """(bin, n): how many pauses between neighbouring instants of a channel lie in each quarter of a doubling of seconds."""
    own = instants.withColumn("pause", F.col("at") - F.lag("at").over(Window.partitionBy("chat_id", "slot").orderBy("at")))
    ends = instants.groupBy("chat_id", "slot").agg(F.min("at").alias("from"), F.max("at").alias("to"))
    between = ends.select((F.col("from") - F.lag("to").over(Window.partitionBy("chat_id").orderBy("slot"))).alias("pause"))
    pauses = own.select("pause").unionByName(between).filter("pause > 0")
    return pauses.groupBy(F.floor(F.log2("pause") * BINS).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def calibrated_gap(instants: DataFrame) -> float:
    """The inactivity gap in seconds: the threshold that parts all pauses best into short ones (within a session) and
    long ones, that is with the greatest variance between the two groups of logarithms (Otsu's method). The histogram
    has a few hundred bins at most, whatever the data. Infinity where pauses make one group only."""
    bins = sorted((int(r.bin), int(r.n)) for r in pause_histogram(instants).collect())
    total = sum(n for _, n in bins)
    if total == 0:
        return math.inf
    mean = sum(b * n for b, n in bins) / total
    variance = sum(n * (b - mean) ** 2 for b, n in bins) / total
    best, gap, low, weight = 0.0, math.inf, 0.0, 0
    for (b, n), (following, _) in zip(bins, bins[1:]):
        weight, low = weight + n, low + b * n
        rest = total - weight
        between = weight * rest / total**2 * (low / weight - (mean * total - low) / rest) ** 2
        if between > best:
            # the middle of the empty stretch after the bin
            best, gap = between, 2.0 ** ((b + 1 + following) / 2 / BINS)
    return gap if best >= LEAST_APART * variance else math.inf


def _numbered(instants: DataFrame, gap: float) -> DataFrame:
    """The instants with session_no (from 1): a new session begins where a user speaks more than ``gap`` seconds after
    the instant before. A pause before a reply is waiting, not inactivity."""
    w, by = Window.partitionBy("chat_id", "slot").orderBy("at"), Window.partitionBy("chat_id").orderBy("slot")
    cut = lambda pause: F.when((F.col("first") == "user") & (pause > gap), 1).otherwise(0)
    inner = instants.withColumn("cut", cut(F.col("at") - F.lag("at").over(w))).withColumn("cuts", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = inner.groupBy("chat_id", "slot").agg(F.sum("cut").alias("c"), F.min("at").alias("from"), F.max("at").alias("to"), F.min_by("first", "at").alias("first"))
    ends = ends.withColumn("c0", cut(F.col("from") - F.lag("to").over(by)))
    ends = ends.select("chat_id", "slot", (F.coalesce(F.sum(F.col("c") + F.col("c0")).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("c0") + 1).alias("s0"))
    return inner.join(ends, ["chat_id", "slot"]).withColumn("session_no", (F.col("s0") + F.col("cuts")).cast("long")).drop("s0", "cuts", "cut")


def _joined_up(parts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Parts in order become one row for each of ``keys``: ok if every part is and no speaker follows himself."""
    w = Window.partitionBy(*keys).orderBy(order)
    return (
        parts.withColumn("_before", F.lag("last").over(w))
        .withColumn("ok", F.col("ok") & (F.col("_before").isNull() | (F.col("_before") != F.col("first"))))
        .groupBy(*keys)
        .agg(F.sum("n").alias("n"), F.min("ok").alias("ok"), F.min_by("first", order).alias("first"), F.max_by("last", order).alias("last"), F.min("at").alias("at"))
    )


def sessions_of(instants: DataFrame, gap: float) -> DataFrame:
    """(chat_id, session_no, turns, reciprocal) of all sessions. reciprocal: user and assistant take turns, from the
    user to the assistant, at least one of each, with no unknown role, no unseen content and no turn without a time."""
    slots = _joined_up(_numbered(instants, gap), ["chat_id", "session_no", "slot"], "at")
    whole = _joined_up(slots, ["chat_id", "session_no"], "slot")
    return whole.select("chat_id", "session_no", F.col("n").alias("turns"), (F.col("ok") & (F.col("first") == "user") & (F.col("last") == "assistant") & (F.col("n") >= 2)).alias("reciprocal"))


def chat_verdicts(chats: DataFrame, messages: DataFrame, gap_seconds: float | None = None) -> DataFrame:
    """One row (chat_id, kept BOOLEAN, turns LONG, sessions LONG) for each id in ``chats`` and each non-null chat_id in
    the messages' latest deliveries.

    Kept: the id is in ``chats`` and all of its sessions are reciprocal, which is so exactly if its turns by created_at,
    the user first at equal times, alternate from the user to the assistant and end with the assistant, with no unknown
    role and no unseen content: sessions begin at a user's turn only, so whole sessions end to end make such a chat,
    whatever the gap. Roles are told by their spellings; where that doesn't tell, none is inferred here, as a chat with
    an unknown role isn't kept. A turn without created_at has no place, so its chat isn't kept. Chats without turns (or
    with system and tool rows only) aren't kept. Repeated rows of chats count once, null ids not at all; empty tables
    give no rows.
    """
    turns = turns_of(messages)
    instants = materialize(_instants(turns), "conversations-instants")
    gap = calibrated_gap(instants) if gap_seconds is None else gap_seconds
    judged = sessions_of(instants, gap).groupBy("chat_id").agg(F.sum("turns").alias("turns"), F.count(F.lit(1)).alias("sessions"), F.min("reciprocal").alias("good"))
    row = lambda df, name, listed: df.select(F.col(name).alias("chat_id"), F.lit(0).cast("long").alias("turns"), F.lit(0).cast("long").alias("sessions"), F.lit(False).alias("good"), F.lit(listed).alias("listed"))
    return (
        judged.withColumn("listed", F.lit(False))
        .unionByName(row(turns.filter("role = 'other'"), "chat_id", False))
        .unionByName(row(chats.filter("id is not null"), "id", True))
        .groupBy("chat_id")
        .agg(F.max("turns").alias("turns"), F.max("sessions").alias("sessions"), F.max("good").alias("good"), F.max("listed").alias("listed"))
        .select("chat_id", (F.col("good") & F.col("listed")).alias("kept"), "turns", "sessions")
    )


def inferred_roles(turns: DataFrame) -> DataFrame:
    """``turns`` with role_guess: the role, or for an unknown one the speaker who would take turns with the known one
    before it in its channel, else with the one after it in its slot, else with a user at the start. Places and last
    known speakers are carried from slot to slot."""
    slot = slot_of(F.col("created_at"))
    w = Window.partitionBy("chat_id", "_slot").orderBy(F.col("created_at"), F.when(F.col("role") == "user", 0).otherwise(1), F.col("id"))
    data = turns.withColumn("_slot", slot).withColumn("_turn", F.when(F.col("role") != "other", 1).otherwise(0)).withColumn("_place", F.sum("_turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    data = data.withColumn("_known", F.when(F.col("role").isin("user", "assistant"), F.struct("role", F.col("_place").alias("place"))))
    ends = data.groupBy("chat_id", "_slot").agg(F.sum("_turn").alias("n"), F.max_by("_known", F.when(F.col("_known").isNotNull(), F.col("_place"))).alias("known"))
    before = Window.partitionBy("chat_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_n0", F.coalesce(F.sum("n").over(before), F.lit(0)))
    ends = ends.withColumn("_carried", F.last(F.when(F.col("known").isNotNull(), F.struct(F.col("known.role").alias("role"), (F.col("_n0") + F.col("known.place")).alias("place"))), ignorenulls=True).over(before)).select("chat_id", "_slot", "_n0", "_carried")
    inner = data.withColumn("_before", F.last("_known", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_after", F.first("_known", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    placed = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(f"{c}.role").alias("role"), (F.col("_n0") + F.col(f"{c}.place")).alias("place")))
    start = F.struct(F.lit("user").alias("role"), F.lit(1).cast("long").alias("place"))
    joined = inner.join(ends, ["chat_id", "_slot"]).withColumn("_from", F.coalesce(placed("_before"), F.col("_carried"), placed("_after"), start))
    other = F.when(F.col("_from.role") == "user", "assistant").otherwise("user")
    guess = F.when((F.col("_n0") + F.col("_place") - F.col("_from.place")) % 2 == 0, F.col("_from.role")).otherwise(other)
    return joined.select(*[F.col(c) for c in turns.columns], F.when(F.col("role") == "unknown", guess).otherwise(F.col("role")).alias("role_guess"))


def conversations(chats: DataFrame, messages: DataFrame, gap_seconds: float | None = None, whole_chats: bool = True) -> DataFrame:
    """Ordered turns of conversations: chat_id, session_no (from 1), turn_no (from 1, through the chat), role, content,
    created_at, message_id.

    With ``whole_chats`` a chat is the unit, and those that ``chat_verdicts`` keeps come out. Without, a session is:
    unknown roles are inferred by alternation, sessions that aren't reciprocal are dropped and the others of their chat
    stay, whether it is listed in ``chats`` or not. Numbers come from sums over slots, not from gathering a chat.
    """
    turns = turns_of(messages, content=True)
    if not whole_chats:
        turns = inferred_roles(turns).drop("role").withColumnRenamed("role_guess", "role")
    turns = materialize(turns, "conversations-turns")
    instants = materialize(_instants(turns), "conversations-instants")
    gap = calibrated_gap(instants) if gap_seconds is None else gap_seconds
    numbered = materialize(_numbered(instants, gap), "conversations-sessions")
    slots = _joined_up(numbered, ["chat_id", "session_no", "slot"], "at")
    judged = _joined_up(slots, ["chat_id", "session_no"], "slot").select("chat_id", "session_no", (F.col("ok") & (F.col("first") == "user") & (F.col("last") == "assistant") & (F.col("n") >= 2)).alias("good"))
    if whole_chats:
        good = judged.groupBy("chat_id").agg(F.min("good").alias("good")).filter("good").select("chat_id").join(chats.select(F.col("id").alias("chat_id")), "chat_id", "left_semi")
        kept = numbered.join(good, "chat_id", "left_semi")
    else:
        kept = numbered.join(judged.filter("good").select("chat_id", "session_no"), ["chat_id", "session_no"], "left_semi")
    by = Window.partitionBy("chat_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    ends = kept.groupBy("chat_id", "slot").agg(F.sum("n").alias("n")).select("chat_id", "slot", F.coalesce(F.sum("n").over(by), F.lit(0)).alias("n0"))
    rows = turns.filter("role in ('user', 'assistant')").withColumn("at", F.unix_micros(F.col("created_at").cast("timestamp")) / 1e6).join(kept.select("chat_id", "at", "slot", "session_no"), ["chat_id", "at"])
    order = Window.partitionBy("chat_id", "slot").orderBy("at", F.when(F.col("role") == "user", 0).otherwise(1))
    placed = rows.withColumn("no", F.row_number().over(order)).join(ends, ["chat_id", "slot"])
    return placed.select("chat_id", "session_no", (F.col("n0") + F.col("no")).cast("long").alias("turn_no"), "role", "content", "created_at", F.col("id").alias("message_id"))
