"""Filling containers of fixed capacity: vector bin packing by the dot-product heuristic."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.context import materialize
from corvane.llm.tokens import BYTE_BPE, encode_texts

#: Items packed together, and the share of a container's room below which it stays open for the second round.
GROUP_ITEMS, CLOSED = 5_000, 0.995
#: Cells by which the items of a group are looked through, and the steps of their first two sizes.
CELLS, STEPS = 2048, (64, 32)
LEANINGS = (0.1, 0.15, 0.2, 0.3, 0.4)


def binding(sizes: np.ndarray, limits: np.ndarray) -> list[int]:
    """The dimensions that can decide: all but those whose share of the limit is for every item within that of one
    other dimension, as a container that keeps the other's limit keeps theirs."""
    parts, kept = sizes / limits, list(range(len(limits)))
    for d in reversed(range(len(limits))):
        if any(o != d and (parts[:, d] <= parts[:, o]).all() for o in kept):
            kept.remove(d)
    return kept


def _cells(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items in an order by cell, largest first in each, and where each cell begins. A cell holds equal items where
    there are few kinds of them, else items close to each other in their first two sizes."""
    kinds, of = np.unique(sizes, axis=0, return_inverse=True)
    of = of.reshape(-1)
    if len(kinds) > CELLS:
        of = np.zeros(len(sizes), np.int64)
        for d, steps in enumerate(STEPS[: sizes.shape[1]]):
            edges = np.unique(np.quantile(sizes[:, d], np.linspace(0, 1, steps + 1)[1:-1]))
            of = of * steps + np.searchsorted(edges, sizes[:, d], side="right")
        of = np.unique(of, return_inverse=True)[1].reshape(-1)
    order = np.lexsort((*-sizes.T[::-1], of))
    return order, np.searchsorted(of[order], np.arange(of.max() + 2))


def fill(sizes: np.ndarray, limits: np.ndarray) -> np.ndarray:
    """The container number of each item. ``sizes`` is items x dimensions, every row within ``limits``, else ValueError.

    Only dimensions that can decide are looked at. The best of a few fillings counts: with one dimension those with and
    without pairs, with more those that lean more or less to large items.
    """
    sizes, limits = np.asarray(sizes, np.int64), np.asarray(limits, np.int64)
    if not len(sizes):
        return np.empty(0, np.int64)
    if (sizes > limits).any() or (sizes < 0).any():
        raise ValueError("an item is above a limit")
    kept = binding(sizes, limits)
    sizes, limits = sizes[:, kept], limits[kept]
    ways = [(True, None), (False, None)] if len(kept) == 1 else [(False, lean) for lean in LEANINGS]
    return min((_fill(sizes, limits, *way) for way in ways), key=lambda x: x.max())


def _fill(sizes: np.ndarray, limits: np.ndarray, pairs: bool, lean: float | None) -> np.ndarray:
    """The container number of each item, by the dot-product heuristic.

    One container is open at a time. It gets the item with the greatest dot product of its size and the room left, both
    as parts of the limits and weighted by how scarce a dimension is, among the items that fit; when none fits, the next
    one opens. A cell of items is one candidate, its largest item left, so a step costs the number of cells and not of
    items. With ``lean``, all but a container's first item are taken by the direction of their size alone, but for its
    length to that power: an item parallel to the room left fills all dimensions alike. With ``pairs``, for one
    dimension, two sizes that fill the rest exactly go first.
    """
    number = np.full(len(sizes), -1, np.int64)
    order, starts = _cells(sizes)
    at, stop = starts[:-1].copy(), starts[1:]
    never = limits + 1
    head = sizes[order[at]]
    weights = (sizes / limits).sum(axis=0)
    weights = weights / max(weights.sum(), 1e-12) / limits
    room, bin_no, empty, left = limits.copy(), 0, True, len(sizes)
    single = {int(k[0]): i for i, k in enumerate(head)} if pairs else {}

    def take(k: int) -> None:
        nonlocal left, empty
        number[order[at[k]]] = bin_no
        room[:] -= head[k]
        at[k] += 1
        left -= 1
        empty = False
        head[k] = sizes[order[at[k]]] if at[k] < stop[k] else never

    while left:
        fits = np.flatnonzero((head <= room).all(axis=1))
        if not len(fits):
            bin_no, room, empty = bin_no + 1, limits.copy(), True
            continue
        candidates = head[fits]
        if lean is not None and not empty:
            lengths = candidates @ weights
            score = candidates @ (weights * room / limits) / np.sqrt(candidates**2 @ (weights / limits)) * lengths**lean
        else:
            score = candidates @ (weights * room / limits)
        best = int(fits[np.argmax(score)])
        if pairs and not empty and head[best][0] < room[0]:
            # no single item fills the room: look for two that do
            have = np.zeros(int(room[0]) + 1, bool)
            have[head[fits, 0]] = True
            for s in np.flatnonzero(have & have[::-1])[::-1]:
                a, b = single[int(s)], single[int(room[0] - s)]
                if a != b or stop[a] - at[a] > 1:
                    take(a)
                    take(b)
                    break
            else:
                take(best)
            continue
        take(best)
    return number


def pack(items: DataFrame, key: str, tokens: str = "n_tokens", loss: str | None = None, capacity: int = 2048, max_segments: int = 2048, max_loss: int | None = None, group_items: int = GROUP_ITEMS) -> DataFrame:
    """Rows (container_id STRING, ``key``, piece_no, start_token, n_tokens) of items put into containers.

    A container holds at most ``capacity`` tokens, ``max_segments`` pieces and ``max_loss`` loss-bearing tokens (the
    column ``loss``; all tokens bear loss where it isn't named). Only items above the capacity are split: into full
    containers and a rest, whose loss-bearing tokens are those left after the full pieces took theirs in proportion.
    Items of null or no tokens take no room and have one row with a null container. An item whose loss alone is above
    ``max_loss`` has its loss counted as ``max_loss``. Repeated keys are items of their own; null keys are kept.

    Items are dealt to groups of about ``group_items`` by a hash of their row, so no key, source or size makes a hot
    group, and each group is packed by one task. What lies in containers with room to spare is dealt anew to fewer groups
    and packed once more, so that only these few groups end in a container that isn't full.
    """
    max_loss = capacity if max_loss is None else max_loss
    sized = materialize(
        items.select(F.col(key).alias("item"), F.coalesce(F.col(tokens), F.lit(0)).cast("int").alias("n"), F.coalesce(F.col(loss if loss else tokens), F.lit(0)).cast("int").alias("l"), F.monotonically_increasing_id().alias("row")),
        "packing-sizes",
    )
    groups = max(1, math.ceil(sized.count() / group_items))
    whole = F.floor(F.col("n") / capacity).cast("int")
    kind = sized.schema["item"].dataType.simpleString()
    none = sized.filter("n <= 0").select(F.lit(None).cast("string").alias("container_id"), "item", F.lit(0).alias("piece_no"), F.lit(0).alias("start_token"), F.lit(0).alias("n_tokens"))
    full = (
        sized.filter(F.col("n") >= capacity)
        .select("item", "row", F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece_no"))
        .select(F.concat(F.lit("f"), F.col("row"), F.lit("-"), F.col("piece_no")).alias("container_id"), "item", "piece_no", (F.col("piece_no") * capacity).cast("int").alias("start_token"), F.lit(capacity).alias("n_tokens"))
    )
    rest = sized.filter(F.col("n") > 0).withColumn("size", (F.col("n") % capacity).cast("int")).filter("size > 0")
    rest = rest.select(
        F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int").alias("part"), "item", whole.alias("piece_no"), (whole * capacity).cast("int").alias("start_token"), F.col("size").alias("n_tokens"),
        F.least(F.lit(max_loss), F.greatest(F.lit(0), F.when(F.col("n") <= capacity, F.col("l")).otherwise(F.ceil(F.col("l") * F.col("size") / F.col("n"))))).cast("int").alias("l"), "row",
    )
    limits = np.array([capacity, max_segments, max_loss], np.int64)

    def packer(prefix: str, last: bool):
        def one(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(["n_tokens", "l", "row"]).reset_index(drop=True)
            sizes = np.stack([group["n_tokens"].to_numpy(np.int64), np.ones(len(group), np.int64), group["l"].to_numpy(np.int64)], axis=1)
            bins = fill(sizes, limits)
            used = np.stack([np.bincount(bins, weights=sizes[:, d]) for d in range(3)], axis=1) / limits
            closed = last | (used.max(axis=1) >= CLOSED)[bins]
            name = f"{prefix}{int(group['part'].iloc[0])}-"
            return group.assign(container_id=[name + str(x) if c else None for x, c in zip(bins, closed)])[columns]

        return one

    columns = ["container_id", "item", "piece_no", "start_token", "n_tokens", "l", "row"]
    schema = f"container_id string, item {kind}, piece_no int, start_token int, n_tokens int, l int, row long"
    first = materialize(rest.groupBy("part").applyInPandas(packer("g", False), schema), "packing-first")
    spare = first.filter("container_id is null")
    again = max(1, math.ceil(spare.count() / group_items))
    second = spare.withColumn("part", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(again)).cast("int")).groupBy("part").applyInPandas(packer("s", True), schema)
    packed = first.filter("container_id is not null").unionByName(second).drop("l", "row")
    return packed.unionByName(full).unionByName(none).withColumnRenamed("item", key)


def instruction_items(pairs: DataFrame, path: str = BYTE_BPE) -> DataFrame:
    """pair_id, n_tokens and n_loss of prompt and response pairs (pair_id, question, answer): all tokens of both, and
    those of the answer, which alone bear loss. Null texts have no tokens."""
    asked = encode_texts(pairs, "question", ["pair_id", "answer"], path, counts=True, out="n_question")
    said = encode_texts(asked, "answer", ["pair_id", "n_question"], path, counts=True, out="n_loss")
    return said.select("pair_id", (F.col("n_question") + F.col("n_loss")).alias("n_tokens"), "n_loss")
