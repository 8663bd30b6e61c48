"""Calls of model services: keys, quota errors, retries, and the events of an answer."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The marks of quota errors, the cooldown in seconds, the order of an answer's events.
QUOTA = r"(?i)resource_exhausted|exceeded your current quota|quota exceeded|too many requests|\"code\":\s?429|\b429\b|rate limit"
COOLDOWN = 60.0
EVENTS = ("meta", "delta", "verification", "confidence", "done", "error")
CANNED = "The service is busy. Please try again in a moment."


def is_quota_error(message: Column) -> Column:
    """Whether an error says that a key's quota is used up; false for null."""
    return F.coalesce(message.rlike(QUOTA), F.lit(False))


def retry_after_ms(message: Column) -> Column:
    """The wait that an error asks for ("retryDelay": "29s") in milliseconds; null if it asks for none."""
    seconds = F.regexp_extract(message, r'"retryDelay"\s*:\s*"(\d+(?:\.\d+)?)s"', 1)
    return F.when(seconds != "", F.floor(seconds.try_cast("double") * 1000 + 0.5).cast("long"))


class KeyPool:
    """Keys in the order to try them: the caller's first, those that cool down last, none left out. State of one process."""

    def __init__(self, keys: list[str], clock: Callable[[], float] = time.time) -> None:
        self.keys, self.clock, self.until = list(dict.fromkeys(k.strip() for k in keys if k and k.strip())), clock, {}

    def order(self, preferred: str | None = None) -> list[str]:
        first = (preferred or "").strip()
        keys = [first, *(k for k in self.keys if k != first)] if first else self.keys
        return sorted(keys, key=self.cooling)

    def cooling(self, key: str) -> bool:
        return self.until.get(key, 0.0) > self.clock()

    def exhausted(self, key: str, wait: float | None = None) -> None:
        self.until[key] = self.clock() + (wait if wait and wait > 0 else COOLDOWN)

    def call(self, make: Callable[[str], object], is_quota: Callable[[Exception], bool], preferred: str | None = None) -> object:
        """``make`` with one key after the other until one isn't exhausted; other errors, and the last one, are raised."""
        failed: Exception | None = None
        for key in self.order(preferred):
            try:
                return make(key)
            except Exception as error:
                if not is_quota(error):
                    raise
                self.exhausted(key)
                failed = error
        raise failed or ValueError("no key")


def retried(make: Callable[[], str], tries: int = 3, wait: float = 2.0, sleep: Callable[[float], None] = time.sleep, canned: str = CANNED) -> str:
    """The result of ``make``, tried a few times; the canned text if it fails each time."""
    for n in range(tries):
        try:
            return make()
        except Exception:
            if n + 1 < tries:
                sleep(wait)
    return canned


def answer_events(answers: DataFrame) -> DataFrame:
    """The ordered events of each answer (key, meta, deltas ARRAY<STRING>, verification, confidence, error; JSON texts): key,
    seq (from 0), type and payload. meta comes first, each delta in its order, then verification and confidence, and
    done, or error in place of all that had not come by then."""
    event = lambda kind, payload: F.struct(F.lit(kind).alias("type"), payload.cast("string").alias("payload"))
    own = F.array(event("meta", F.col("meta")))
    deltas = F.transform(F.coalesce("deltas", F.array().cast("array<string>")), lambda d: event("delta", d))
    closing = F.when(F.col("error").isNull(), F.array(event("verification", F.col("verification")), event("confidence", F.col("confidence")), event("done", F.lit(None)))).otherwise(F.array(event("error", F.col("error"))))
    every = F.filter(F.concat(own, deltas, closing), lambda e: e["payload"].isNotNull() | e["type"].isin("done"))
    return answers.select("key", F.posexplode(every).alias("seq", "e")).select("key", "seq", "e.type", "e.payload")


def ndjson_events(pieces: DataFrame, schema: str = "type string, text string") -> DataFrame:
    """Events of NDJSON that came in pieces (key, piece_no, text), cut anywhere: the pieces of a key are joined in order and
    cut at line ends; key, line_no (from 0) and event. Blank lines and lines that are no JSON give none."""
    whole = pieces.groupBy("key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "text"))), lambda p: p["text"]), "").alias("all"))
    lines = whole.select("key", F.posexplode(F.filter(F.split("all", "\n"), lambda x: F.trim(x) != "")).alias("line_no", "line"))
    return lines.select("key", "line_no", F.from_json("line", schema).alias("event")).filter("event is not null")
