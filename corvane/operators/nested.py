"""Deeply nested records turned into related flat tables by interval labels.

A depth-first walk gives every node of a record a number when it is entered (pre) and when it is left (post), from one
counter for all of the record's columns. Node x lies below node y exactly if y.pre < x.pre and x.post < y.post, so the
tables of the node types need no other link than these labels and the record's key.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.deliveries import latest_deliveries

#: The arrays of the message payloads. A lone value in such a place counts as an array of one.
MESSAGE_ARRAYS = ("sources", "sources[].retrieved_by", "citations.verdicts", "citations.verdicts[].citations", "citations.verdicts[].supported_by", "citations.invalid_citations", "citations.unused_sources", "confidence.reasons")
SOURCE_FIELDS = {"text": "string", "page": "int", "filename": "string", "document_id": "string", "citation": "long", "chunk_id": "string", "heading": "string", "score": "double", "dense_score": "double", "sparse_score": "double", "rerank_score": "double"}
STAT_FIELDS = {"mode": "string", "dense_weight": "double", "sparse_weight": "double", "dense_hits": "long", "sparse_hits": "long", "fused_candidates": "long", "rerank_used": "boolean", "rerank_backend": "string", "top_dense_score": "double", "mean_rerank_score": "double", "keyword_coverage": "double", "documents_searched": "long", "passages_returned": "long", "duration_ms": "long"}
REPORT_FIELDS = {"verified": "boolean", "total_claims": "long", "cited_claims": "long", "supported_claims": "long", "unsupported_claims": "long", "grounded_claims": "long", "miscited_claims": "long"}
CONFIDENCE_FIELDS = {"score": "double", "band": "string", "retrieval": "double", "citation_coverage": "double", "completeness": "double"}

_NODE = "array<struct<path:string,place:bigint,pre:bigint,post:bigint,value:string,fields:array<struct<name:string,value:string>>>>"
_NODE_TYPE = pa.list_(pa.struct([("path", pa.string()), ("place", pa.int64()), ("pre", pa.int64()), ("post", pa.int64()), ("value", pa.string()), ("fields", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())])))]))
_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|[\s\-]+")


@lru_cache(maxsize=4096)
def canonical(name: str) -> str:
    """supportedBy, supported-by and Supported_By are supported_by."""
    return _HUMP.sub("_", name.strip()).lower()


def _refused(name: str) -> None:
    raise ValueError(name)


def parse(text: str | None) -> tuple[bool, object]:
    """(True, value) of a JSON text, unwrapped as often as the value is a JSON string again; (False, None) if it isn't
    valid. NaN and Infinity are no JSON."""
    if text is None:
        return False, None
    try:
        value = json.loads(text, parse_constant=_refused)
    except (ValueError, RecursionError):
        return False, None
    while isinstance(value, str):
        try:
            value = json.loads(value, parse_constant=_refused)
        except (ValueError, RecursionError):
            return False, None
    return True, value


def _unwrapped(value: object) -> object:
    """The value that a JSON string holds, else the value itself."""
    if isinstance(value, str):
        good, inner = parse(value)
        return inner if good else value
    return value


def _shown(value: object) -> str | None:
    return None if value is None else value if isinstance(value, str) else ("true" if value else "false") if isinstance(value, bool) else json.dumps(value)


def label(columns: list[tuple[str, object]], arrays: frozenset[str], wanted: frozenset[str] | None, named: frozenset[str] | None = None) -> list[dict]:
    """Nodes of the values of a record's columns in depth-first order. Objects carry their scalars in ``fields``;
    arrays, objects, elements of arrays and the roots are nodes. ``wanted`` keeps nodes of these paths, ``named`` fields of these names only."""
    nodes: list[dict] = []
    clock = 0
    stack: list[tuple] = [(name, None, value, None) for name, value in reversed(columns)]
    while stack:
        path, place, value, node = stack.pop()
        clock += 1
        if node is not None:
            node["post"] = clock
            continue
        if path in arrays:
            value = _unwrapped(value)
            if value is not None and not isinstance(value, list):
                value = [value]
        elif place is not None and path[:-2] in arrays and isinstance(value, str) and value[:1] in "{[\"" and value:
            value = _unwrapped(value)
        here = {"path": path, "place": place, "pre": clock, "post": None, "value": None, "fields": None}
        if wanted is None or path in wanted:
            nodes.append(here)
        stack.append((path, place, None, here))
        if isinstance(value, dict):
            own = {canonical(k): v for k, v in value.items()}
            below = [(f"{path}.{k}", None, v, None) for k, v in own.items() if isinstance(v, (dict, list)) or f"{path}.{k}" in arrays]
            inner = {p for p, *_ in below}
            here["fields"] = [{"name": k, "value": _shown(v)} for k, v in own.items() if f"{path}.{k}" not in inner and (named is None or k in named)]
            stack += reversed(below)
        elif isinstance(value, list):
            stack += [(f"{path}[]", n, v, None) for n, v in reversed(list(enumerate(value)))]
        else:
            here["value"] = _shown(value)
    return nodes


def labelled(df: DataFrame, columns: list[str], keep: list[str], arrays: tuple[str, ...] = MESSAGE_ARRAYS, wanted: tuple[str, ...] | None = None, named: tuple[str, ...] | None = None) -> DataFrame:
    """``keep`` and ``nodes`` of each row: the labelled nodes of its JSON ``columns``. A column that is null or no valid
    JSON has no nodes. Map-only. Walked without recursion, so any depth that the parser takes is fine."""
    known, asked, fields = frozenset(arrays), None if wanted is None else frozenset(wanted), None if named is None else frozenset(named)
    data = df.select(*[F.col(c) for c in keep], *[F.col(c).alias(f"__json{n}") for n, c in enumerate(columns)])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in data.schema.fields[: len(keep)]) + f", nodes {_NODE}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):  # nodes take far more room than their text
                part = b.slice(at, 500)
                found = []
                for row in zip(*(part.column(len(keep) + n).to_pylist() for n in range(len(columns)))):
                    parsed = [(name, parse(text)) for name, text in zip(columns, row)]
                    found.append(label([(name, value) for name, (good, value) in parsed if good], known, asked, fields))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in range(len(keep))), pa.array(found, _NODE_TYPE)], names=[*keep, "nodes"])

    return data.mapInArrow(run, schema)


def message_nodes(messages: DataFrame, columns: list[str], wanted: tuple[str, ...] | None = None, named: tuple[str, ...] | None = None) -> DataFrame:
    """message_id and nodes of the latest delivery of every message. Nodes are made before the deliveries are compared,
    so the shuffle carries what a table needs instead of the JSON texts."""
    return latest_deliveries(labelled(messages, columns, ["id", "received_at"], wanted=wanted, named=named), ["nodes"]).select(F.col("id").alias("message_id"), "nodes")


def of_path(nodes: Column, path: str) -> Column:
    return F.filter(nodes, lambda n: n["path"] == path)


def below(nodes: Column, path: str, parent: Column) -> Column:
    """The nodes of a path that lie in the interval of ``parent``."""
    return F.filter(nodes, lambda n: (n["path"] == path) & (n["pre"] > parent["pre"]) & (n["post"] < parent["post"]))


def field(node: Column, name: str) -> Column:
    return F.get(F.transform(F.filter(node["fields"], lambda f: f["name"] == name), lambda f: f["value"]), F.lit(0))


def whole_number(text: Column) -> Column:
    """The number of '4', ' 4 ', '4.0' or 4e0; null for anything else."""
    number = F.trim(text).try_cast("double")
    return F.when((number == F.floor(number)) & (F.abs(number) < 1e15), number.cast("long"))


def _one(messages: DataFrame, column: str, path: str) -> DataFrame:
    return message_nodes(messages, [column], (path,)).select("message_id", F.explode(of_path(F.col("nodes"), path)).alias("n"))


def _typed(fields: dict[str, str]) -> list[Column]:
    return [(whole_number(field(F.col("n"), k)) if t == "long" else field(F.col("n"), k).try_cast(t)).alias(k) for k, t in fields.items()]


def sources(messages: DataFrame) -> DataFrame:
    """message_id, source_no (place from 0), labels and fields of each object in messages.sources."""
    return _one(messages, "sources", "sources[]").filter("n.fields is not null").select("message_id", F.col("n.place").alias("source_no"), F.col("n.pre").alias("pre"), F.col("n.post").alias("post"), *_typed(SOURCE_FIELDS))


def _children(messages: DataFrame, column: str, parent: str, child: str, number: str) -> DataFrame:
    nodes = message_nodes(messages, [column], (parent, child)).select("message_id", "nodes", F.explode(of_path(F.col("nodes"), parent)).alias("p"))
    return nodes.select("message_id", F.col("p.place").alias(number), F.explode(below(F.col("nodes"), child, F.col("p"))).alias("n"))


def retrievers(messages: DataFrame) -> DataFrame:
    """message_id, source_no, place and retriever of each entry of a source's retrieved_by."""
    return _children(messages, "sources", "sources[]", "sources[].retrieved_by[]", "source_no").select("message_id", "source_no", F.col("n.place").alias("place"), F.col("n.value").alias("retriever"))


def verdicts(messages: DataFrame) -> DataFrame:
    """message_id, verdict_no (place from 0), labels, claim, status and reason of each verdict."""
    fields = {"claim": "string", "status": "string", "reason": "string"}
    return _one(messages, "citations", "citations.verdicts[]").filter("n.fields is not null").select("message_id", F.col("n.place").alias("verdict_no"), F.col("n.pre").alias("pre"), F.col("n.post").alias("post"), *_typed(fields))


def verdict_lists(messages: DataFrame) -> DataFrame:
    """message_id, verdict_no, status, citations and supported_by (ARRAY<INT>, entries that are no whole numbers left out)
    of each verdict."""
    verdict = "citations.verdicts[]"
    paths = [f"{verdict}.{which}[]" for which in ("citations", "supported_by")]
    rows = message_nodes(messages, ["citations"], (verdict, *paths), ("status",)).select("message_id", "nodes", F.explode(of_path(F.col("nodes"), verdict)).alias("v")).filter("v.fields is not null")
    numbers = lambda path: F.filter(F.transform(below(F.col("nodes"), path, F.col("v")), lambda n: whole_number(n["value"]).cast("int")), lambda n: n.isNotNull())
    return rows.select("message_id", F.col("v.place").alias("verdict_no"), field(F.col("v"), "status").alias("status"), numbers(paths[0]).alias("citations"), numbers(paths[1]).alias("supported_by"))


def all_nodes(messages: DataFrame, column: str) -> DataFrame:
    """message_id, path, place, pre and post of every node of a column, with parent_pre, the label of the innermost node
    that holds it (null for the root): the intervals of a record are nested, so that is the latest one still open."""
    rows = message_nodes(messages, [column]).select("message_id", F.explode("nodes").alias("n"), "nodes")
    around = F.array_max(F.transform(F.filter("nodes", lambda p: (p["pre"] < F.col("n.pre")) & (p["post"] > F.col("n.post"))), lambda p: p["pre"]))
    return rows.select("message_id", "n.path", "n.place", "n.pre", "n.post", around.alias("parent_pre"))


def verdict_numbers(messages: DataFrame, which: str) -> DataFrame:
    """message_id, verdict_no, place and number of each entry of a verdict's ``which`` (citations or supported_by); the
    number is null if the entry is no whole number."""
    return _children(messages, "citations", "citations.verdicts[]", f"citations.verdicts[].{which}[]", "verdict_no").select("message_id", "verdict_no", F.col("n.place").alias("place"), whole_number(F.col("n.value")).alias("number"))


def report_numbers(messages: DataFrame, which: str) -> DataFrame:
    """message_id, place and number of each entry of ``which`` (invalid_citations or unused_sources)."""
    return _one(messages, "citations", f"citations.{which}[]").select("message_id", F.col("n.place").alias("place"), whole_number(F.col("n.value")).alias("number"))


def reasons(messages: DataFrame) -> DataFrame:
    """message_id, place and reason of each reason of a confidence."""
    return _one(messages, "confidence", "confidence.reasons[]").select("message_id", F.col("n.place").alias("place"), F.col("n.value").alias("reason"))


def objects(messages: DataFrame, column: str, fields: dict[str, str]) -> DataFrame:
    """message_id and the fields of a column that holds one object (retrieval_stats, citations, confidence); values
    that aren't of a field's type are null."""
    return _one(messages, column, column).filter("n.fields is not null").select("message_id", *_typed(fields))


def cited_sources(messages: DataFrame, which: str = "citations") -> DataFrame:
    """message_id, verdict_no, source_no: each verdict with each source of its message whose number stands in the
    verdict's ``which``, once each. A source's number is its citation, or its place from 1 when it has none.

    The numbers of a verdict are those in its interval; verdicts and sources meet inside their message's row, so the
    only shuffle is that of the deliveries.
    """
    verdict, number, source = "citations.verdicts[]", f"citations.verdicts[].{which}[]", "sources[]"
    nodes = F.col("nodes")
    rows = message_nodes(messages, ["citations", "sources"], (verdict, number, source), ("citation",)).filter(F.exists(nodes, lambda n: n["path"] == number) & F.exists(nodes, lambda n: n["path"] == source))
    at = F.transform(F.filter(nodes, lambda n: (n["path"] == source) & n["fields"].isNotNull()), lambda n: F.named_struct(F.lit("source_no"), n["place"], F.lit("number"), F.coalesce(whole_number(field(n, "citation")), n["place"] + 1)))
    each = rows.select("message_id", "nodes", at.alias("at"), F.explode(of_path(nodes, verdict)).alias("v"))
    numbers = F.transform(below(nodes, number, F.col("v")), lambda n: whole_number(n["value"]))
    found = each.select("message_id", F.col("v.place").alias("verdict_no"), F.array_distinct(numbers).alias("numbers"), "at")
    return found.select("message_id", "verdict_no", F.explode(F.filter("at", lambda s: F.array_contains(F.col("numbers"), s["number"]))).alias("s")).select("message_id", "verdict_no", F.col("s.source_no").alias("source_no"))
