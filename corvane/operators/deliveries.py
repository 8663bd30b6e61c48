"""Latest delivery of each message."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_deliveries(df: DataFrame, keep: list[str], key: str = "id", at: str = "received_at") -> DataFrame:
    """One row of ``key`` and ``keep`` for each ``key``: that with the greatest ``at``.

    Nulls: a null ``at`` is earlier than any other; rows with a null ``key`` can't be recognised as repetitions and
    each stays a message of its own, but for rows equal in all kept columns. Ties in ``at`` go to the greatest hash
    of the kept columns, the same on every run. The aggregate combines before the shuffle, so a message that is
    delivered very often is no hot group.
    """
    kept = [F.col(c) for c in keep]
    unnamed = F.when(F.col(key).isNull(), F.xxhash64(*kept, F.col(at)))
    return (
        df.select(F.col(key).alias("_k"), unnamed.alias("_u"), F.struct(*kept).alias("_row"), F.struct(F.col(at), F.xxhash64(*kept)).alias("_at"))
        .groupBy("_k", "_u")
        .agg(F.max_by("_row", "_at").alias("_row"))
        .select(F.col("_k").alias(key), "_row.*")
    )
