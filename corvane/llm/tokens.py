"""Encoding of whole corpora with a public byte-level tokenizer, and its exact reversal."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The folder of the vocabularies, on every executor.
BYTE_BPE = os.path.join(os.environ.get("CORVANE_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.json")
#: Characters handed to the tokenizer at once, which bounds a worker's memory.
SLICE_CHARS = 400_000


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True  # the special tokens' strings in a text are ordinary text
    made.no_truncation()
    made.no_padding()
    return made


@lru_cache(maxsize=1)
def byte_chars() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary. Fixed values of the format: the bytes
    33-126, 161-172 and 174-255 stand for themselves, the others for the code points from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b) if b in shown else chr(next(spare)) for b in range(256)}


@cache
def _pieces(path: str) -> dict[int, bytes]:
    """The bytes of every id of the vocabulary."""
    back = {c: b for b, c in byte_chars().items()}
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    return {i: bytes(back[c] for c in token) if all(c in back for c in token) else token.encode() for token, i in vocabulary.items()}


def decode(ids: list[int], path: str = BYTE_BPE) -> str:
    """The text of ids: their bytes are joined before they are read as UTF-8, as a character may be split over ids.
    Bytes that make no character (ids cut inside one) come out as U+FFFD."""
    pieces = _pieces(path)
    return b"".join(pieces[i] for i in ids).decode("utf-8", errors="replace")


def char_offsets(text: str, ids: list[int], path: str = BYTE_BPE) -> list[tuple[int, int]]:
    """For each id the span of characters (start, end) that its bytes touch. Ids that share a split character have
    that character in common."""
    pieces, starts = _pieces(path), []
    for n, c in enumerate(text):
        starts += [n] * len(c.encode("utf-8", errors="surrogatepass"))
    spans, at = [], 0
    for i in ids:
        end = at + len(pieces[i])
        spans.append((starts[at], starts[end - 1] + 1))
        at = end
    return spans


def _sliced(texts: list[str]) -> Iterator[list[str]]:
    own, size = [], 0
    for t in texts:
        own.append(t)
        size += len(t)
        if size >= SLICE_CHARS or len(own) >= 1024:
            yield own
            own, size = [], 0
    if own:
        yield own


def encode_texts(df: DataFrame, text: str = "text", keep: list[str] | None = None, path: str = BYTE_BPE, counts: bool = False, out: str | None = None) -> DataFrame:
    """The columns ``keep`` with ``ids`` (or, with ``counts``, ``n_tokens``) of the whole text of each row.

    Null and empty texts have the empty list (0 tokens). No special tokens are added. Rows, repeated ones included,
    stay as they are; only ``keep`` and the text are read, so other columns, whatever their names, don't matter.
    Map-only: no shuffle.
    """
    keep = keep if keep is not None else [c for c in df.columns if c != text]
    name = out or ("n_tokens" if counts else "ids")
    kind = T.IntegerType() if counts else T.ArrayType(T.IntegerType())
    data = df.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*(f for f in data.schema.fields if f.name != "__text"), T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(path)
        fast = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch)
        for b in batches:
            texts, at = [t or "" for t in b.column(b.num_columns - 1).to_pylist()], 0
            for part in _sliced(texts):
                encoded = fast(part, add_special_tokens=False)
                values = pa.array([len(e) for e in encoded], pa.int32()) if counts else pa.array([e.ids for e in encoded], pa.list_(pa.int32()))
                rest = [b.column(i).slice(at, len(part)) for i in range(b.num_columns - 1)]
                at += len(part)
                yield pa.RecordBatch.from_arrays([*rest, values], names=schema.names)

    return data.mapInArrow(run, schema)


def decode_ids(df: DataFrame, ids: str = "ids", keep: list[str] | None = None, path: str = BYTE_BPE, out: str = "text") -> DataFrame:
    """The text of each row's ids; null ids give the empty text."""
    keep = keep if keep is not None else [c for c in df.columns if c != ids]
    data = df.select(*keep, F.col(ids).alias("__ids"))
    schema = T.StructType([*(f for f in data.schema.fields if f.name != "__ids"), T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = pa.array([decode(x or [], path) for x in b.column(b.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 1)), texts], names=schema.names)

    return data.mapInArrow(run, schema)
