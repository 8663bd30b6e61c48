"""Cutting oversized texts at natural boundaries by recursive bisection."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT, OVERLAP = 850, 150
#: A boundary's place is the end of the match. Strongest first: paragraph, line, sentence, clause, word.
BOUNDARIES = tuple(map(re.compile, (r"\n\s*\n\s*", r"\s*\n\s*", r"[.!?][\"'”’)\]]*\s+|[。！？]+[」』）]?\s*", r"[;:,、；，]\s+", r"\s+")))
_UNBROKEN = r"[^\s。！？]"


def _nearest(places: list[int], low: int, high: int, middle: int) -> int | None:
    """The place nearest to ``middle`` with low < place < high."""
    i, j = bisect_right(places, low), bisect_left(places, high)
    if i >= j:
        return None
    k = bisect_left(places, middle, i, j)
    return min(places[max(i, k - 1) : min(j, k + 1)] or places[i:j], key=lambda p: (abs(p - middle), p))


def cut_places(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[int], int]:
    """The places at which a text is cut, and how many of them lie in an unbroken stretch.

    A range longer than limit - overlap is cut at the strongest boundary in its middle half, else at the boundary
    nearest to its middle, and both halves are cut again. A range without any boundary stays whole up to the limit and
    is cut in the middle beyond it.
    """
    if len(text) <= limit:
        return [], 0
    core, levels, cuts, forced = limit - overlap, [[m.end() for m in b.finditer(text)] for b in BOUNDARIES], [], 0
    todo = [(0, len(text))]
    while todo:
        low, high = todo.pop()
        size = high - low
        if size <= core:
            continue
        middle, quarter = (low + high) // 2, size // 4
        at = next((p for places in levels if (p := _nearest(places, low + quarter, high - quarter, middle)) is not None), None)
        if at is None:
            found = [p for places in levels if (p := _nearest(places, low, high, middle)) is not None]
            at = min(found, key=lambda p: (abs(p - middle), p)) if found else None
        if at is None:
            if size <= limit:
                continue
            at, forced = middle, forced + 1
        cuts.append(at)
        todo += [(low, at), (at, high)]
    return sorted(cuts), forced


def pieces_of(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[tuple[int, int, int]], int]:
    """Spans (start with overlap, start of the new part, end) of the pieces of a text, and the forced cuts.

    A piece begins with the last ``overlap`` characters of the piece before, less a word cut off at their start; where
    an unbroken stretch of more than limit - overlap characters follows, with as much of them as fits.
    """
    cuts, forced = cut_places(text, limit, overlap)
    spans, begin = [], 0
    for low, high in zip([0, *cuts], [*cuts, len(text)]):
        start = low
        if low:
            start = max(begin, low - overlap, high - limit)
            if start > begin and not text[start - 1].isspace() and not text[start].isspace() and text[start - 1] not in "。！？":
                gap = re.compile(r"\s|[。！？]").search(text, start, low)
                start = gap.end() if gap else low
            while start < low and text[start].isspace():
                start += 1
        spans.append((start, low, high))
        begin = start
    return spans, forced


def split_texts(df: DataFrame, text: str, keep: list[str], heading: str | None = None, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """One row for each text longer than ``limit`` without outer white space: ``keep``, n_chars, cut ('forced' if it
    holds a stretch of more than ``limit`` characters with neither white space nor one of 。！？, else 'boundary') and
    pieces ARRAY<STRUCT<piece_no, start, fresh, stop, text>>.

    start, fresh and stop count characters of the stripped text; the parts from fresh to stop, put together, are that
    text. ``with_text=False`` leaves the pieces' texts null. A heading travels in ``keep``. Null, blank and short texts
    give no row; repeated rows stay. Map-only; only rows that can be long leave the JVM.
    """
    kept = [*keep, *([heading] if heading else [])]
    data = df.select(*kept, F.col(text).alias("__text")).filter(F.length("__text") > limit)
    piece = T.StructType([T.StructField(n, T.IntegerType()) for n in ("piece_no", "start", "fresh", "stop")] + [T.StructField("text", T.StringType())])
    schema = T.StructType([*(f for f in data.schema.fields if f.name != "__text"), T.StructField("n_chars", T.IntegerType()), T.StructField("cut", T.StringType()), T.StructField("pieces", T.ArrayType(piece))])
    piece_type = pa.list_(pa.struct([(n, pa.int32()) for n in ("piece_no", "start", "fresh", "stop")] + [("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long = re.compile(_UNBROKEN + "{%d}" % (limit + 1))
        for b in batches:
            rows, sizes, cuts, found = [], [], [], []
            for n, raw in enumerate(b.column(b.num_columns - 1).to_pylist()):
                own = raw.strip()
                if len(own) <= limit:
                    continue
                spans, forced = pieces_of(own, limit, overlap)
                rows.append(n)
                sizes.append(len(own))
                # a stretch that ends in one of 。！？ may be cut by force though it is within the limit
                cuts.append("forced" if forced and long.search(own) else "boundary")
                found.append([{"piece_no": k, "start": s, "fresh": f, "stop": e, "text": own[s:e] if with_text else None} for k, (s, f, e) in enumerate(spans)])
            if rows:
                part = pa.Table.from_batches([b]).take(pa.array(rows)).combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(b.num_columns - 1)), pa.array(sizes, pa.int32()), pa.array(cuts, pa.string()), pa.array(found, piece_type)], names=schema.names)

    return data.mapInArrow(run, schema)


def text_items(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """item_id, heading and text of every section (documents.id, '#', place from 0) and every chunk; chunks delivered
    twice stay twice."""
    sections = documents.select("id", F.posexplode("processed_sections").alias("place", "s")).select(F.concat(F.col("id"), F.lit("#"), F.col("place")).alias("item_id"), F.col("s.heading").alias("heading"), F.col("s.text").alias("text"))
    return sections.unionByName(chunks.select(F.col("id").alias("item_id"), "heading", "text"))


def oversized_items(documents: DataFrame, chunks: DataFrame, **parameters) -> DataFrame:
    """The split of every oversized section and chunk. Rows delivered twice come out once: they are equal, so any
    one stands for all; an id is compared, not its text, so the shuffle is small without the pieces' texts."""
    return split_texts(text_items(documents, chunks), "text", ["item_id", "heading"], **parameters).dropDuplicates(["item_id"])
