"""New batches checked for duplicates and near-duplicates against everything accepted before.

Multi-key sorted neighbourhood over persisted runs. A text's words become one character each; texts of equal words in
one workspace are a class, kept once. Every class has several sort keys (workspace and two minima of hashed word
triples), and the keys of the accepted classes lie in sorted runs. A batch is sorted and merged into these key ranges;
only windows around new records are compared, by exact word edit distance. Runs are merged into one from time to time.

A key's window is as wide as its block (the records of equal key). A block wider than ``WINDOW`` is cut: its records
are compared with ``WINDOW`` neighbours first, those that turn out to be repetitions leave, and the rest is merged and
compared again, until it fits or nothing more leaves; what then remains is compared in tiles, block by block, and at
last the repetitions with the accepted records of their blocks. So no link of a repetition to an accepted record that
shares a key with it is lost, and no block is gathered in one task or compared all at once.
"""

from __future__ import annotations

import json
import math
import re
import secrets
import uuid
from collections import deque
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from corvane.context import materialize, shared_folder

KEYS, GRAM, WINDOW, MAX_RUNS, AT_ONCE = 10, 3, 32, 6, 4
#: Parts of the workspaces by which the base is laid out.
PARTS = 8
#: Entries of a bucket, some 24 bytes each.
BUCKET_ENTRIES = 2_000_000
#: Words per allowed edit.
PART = 10
_WORDS = re.compile(r"[^\W_]+")
#: Characters for words: the assigned plane without controls and surrogates.
_LOW, _GAP, _CODES = 0x100, 0xD800, 0xFDEF - 0x100 - 0x800
#: Bits of a sketch: parity of hashed words, then whether the record is fresh, then the word count up to its largest.
_PARITY, _FRESH, _MOST = 52, 1 << 11, (1 << 11) - 1


def code_of(words: list[str], memory: dict[str, str]) -> str:
    """One character for each word."""
    out = []
    for w in words:
        c = memory.get(w)
        if c is None:
            if len(memory) > 500_000:
                memory.clear()
            x = _LOW + xxhash.xxh3_64_intdigest(w) % _CODES
            c = memory[w] = chr(x if x < _GAP else x + 0x800)
        out.append(c)
    return "".join(out)


def _named(chunks: DataFrame) -> DataFrame:
    return chunks.filter("id is not null and guest_id is not null and text is not null").select(
        "id", "guest_id", F.coalesce(F.col("batch_no"), F.lit(0)).cast("int").alias("batch_no"), F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(-(2**62))).alias("at"), F.coalesce(F.col("chunk_index"), F.lit(-1)).cast("int").alias("chunk_index"), "text"
    )


def word_features(chunks: DataFrame) -> DataFrame:
    """id, guest_id, the order columns, h (hash of workspace and words), n (words) and code of every chunk with words.
    Null ids can't be named and null workspaces have no others, so these rows are left out. Nulls in the order columns
    come first."""
    schema = "id string, guest_id string, batch_no int, at long, chunk_index int, h long, n int, code string"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, str] = {}
        for b in batches:
            keep, hashes, found = [], [], []
            for k, (guest, text) in enumerate(zip(b.column(1).to_pylist(), b.column(5).to_pylist())):
                words = _WORDS.findall(text.lower())
                if words:
                    keep.append(k)
                    hashes.append(xxhash.xxh3_64_intdigest("\0".join([guest, *words]).encode("utf-8", "surrogatepass")))
                    found.append(code_of(words, memory))
            if keep:
                rows = pa.array(keep)
                values = [pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array([len(c) for c in found], pa.int32()), pa.array(found, pa.string())]
                yield pa.RecordBatch.from_arrays([*(b.column(i).take(rows) for i in range(5)), *values], names=names)

    return _named(chunks).mapInArrow(run, schema)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed)) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


_SEEDS = [xxhash.xxh3_64_intdigest(f"key {k}") for k in range(64)]


def sort_keys(codes: list[str], guests: list[str], keys: int = KEYS, gram: int = GRAM) -> np.ndarray:
    """A row of ``keys`` sort keys for each code of ``gram`` characters or more."""
    sizes = np.array([len(c) for c in codes])
    flat = np.frombuffer("".join(codes).encode("utf-16-le"), np.uint16).astype(np.uint64)
    total = len(flat) - gram + 1
    grams = np.zeros(total, np.uint64)
    for g in range(gram):
        grams = _mix(grams ^ flat[g : g + total], _SEEDS[-1 - g])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    # grams that reach into the next text count for none
    inside = np.ones(total, bool)
    for g in range(1, gram):
        bad = starts[1:] - g
        inside[bad[bad < total]] = False
    grams, offsets = grams[inside], np.concatenate([[0], np.cumsum(sizes - gram + 1)[:-1]])
    guest = np.array([xxhash.xxh3_64_intdigest(g) for g in guests], np.uint64)
    out = np.empty((len(codes), keys), np.int64)
    for k in range(keys):
        low = [np.minimum.reduceat(_mix(grams, _SEEDS[2 * k + part]), offsets) for part in (0, 1)]
        out[:, k] = _mix(_mix(guest ^ low[0], _SEEDS[40 + k]) ^ low[1], _SEEDS[50]).view(np.int64)
    return out


def sketches(codes: list[str]) -> np.ndarray:
    """For each code the parity of its hashed words over 52 places, and its length, in one number. An edit flips two
    places at most, so texts d edits apart differ in at most 2 d places."""
    sizes = np.array([len(c) for c in codes])
    flat = np.frombuffer("".join(codes).encode("utf-16-le"), np.uint16).astype(np.uint64)
    bits = np.uint64(1) << (_mix(flat, _SEEDS[60]) % np.uint64(_PARITY))
    parity = np.bitwise_xor.reduceat(bits, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
    return ((parity << np.uint64(12)) | np.minimum(sizes, _MOST).astype(np.uint64)).view(np.int64)


def key_entries(classes: DataFrame) -> DataFrame:
    """(key, h, sketch, part) for every sort key of the classes with words enough for an edit, or one fewer, as an edit may
    add the missing one, marked as fresh."""
    data = classes.filter(F.col("n") >= PART - 1).select("h", "guest_id", "code", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            codes = b.column(2).to_pylist()
            found = sort_keys(codes, b.column(1).to_pylist())
            rows = np.repeat(np.arange(b.num_rows), found.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(found.reshape(-1)), b.column(0).take(pa.array(rows)), pa.array((sketches(codes) | _FRESH)[rows]), b.column(3).take(pa.array(rows))], names=["key", "h", "sketch", "part"])

    return data.mapInArrow(run, "key long, h long, sketch long, part int")


def _may_repeat(a: int, b: int) -> bool:
    """Whether the sketches of two records allow for a tenth of edits."""
    n, m = a & _MOST, b & _MOST
    longest = max(n, m)
    if longest == _MOST:
        return True
    edits = longest // PART
    return abs(n - m) <= edits and (((a ^ b) >> 12) & ((1 << _PARITY) - 1)).bit_count() <= 2 * edits


def _scan(run_sorted: DataFrame, window: int) -> DataFrame:
    """Neighbours among sorted entries: (fresh, other, old, key) for two classes of one key at most ``window`` apart whose
    sketches allow a repetition, the first of them fresh, old telling whether the second isn't; (null, null, edge, key)
    for a key with more records and, with edge, for the first and last key of each sorted stretch (of a partition, and
    of each file that it reads, told by ``src``), as a block may go on in another one."""
    names = ["fresh", "other", "old", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, block, size, source = None, deque(maxlen=window), 0, None
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(keys):
                continue
            out: tuple[list, list, list, list] = ([], [], [], [])

            def say(*row: object, out: tuple = out) -> None:
                for column, value in zip(out, row):
                    column.append(value)

            # rows alone with their key in this batch, but for the first and last of it and of a file, need no look
            sources = batch.column(3).to_numpy(zero_copy_only=False)
            look = (keys[1:] == keys[:-1]) | (sources[1:] != sources[:-1])
            rows = np.flatnonzero(np.concatenate([[True], look]) | np.concatenate([look, [True]]))
            for k, h, s, x in zip(keys[rows].tolist(), *(batch.column(n).to_numpy(zero_copy_only=False)[rows].tolist() for n in (1, 2)), sources[rows].tolist()):
                if x != source:
                    say(None, None, True, k)
                    if key is not None:
                        say(None, None, True, key)
                    key, source = None, x
                if k != key:
                    key, size = k, 0
                    block.clear()
                for g, t in block:
                    if (s | t) & _FRESH and g != h and _may_repeat(s, t):
                        old = not (s & t & _FRESH)
                        say(*((h, g) if s & _FRESH else (g, h)), old, k)
                block.append((h, s))
                size += 1
                if size == window + 2:
                    say(None, None, False, k)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.bool_()), pa.array(out[3], pa.int64())], names=names)
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.int64()), pa.array([True]), pa.array([key], pa.int64())], names=names)

    return run_sorted.select("key", "h", "sketch", "src").mapInArrow(run, "fresh long, other long, old boolean, key long")


def _part() -> Column:
    return F.pmod(F.xxhash64("guest_id"), F.lit(PARTS)).cast("int").alias("part")


def _order(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in ("batch_no", "at", "chunk_index", "rep")])


def _counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """As ``materialize``, with the number of rows, which is counted in writing."""
    seen = Observation()
    kept = materialize(df.observe(seen, F.count(F.lit(1)).alias("n")), label)
    return kept, int(seen.get["n"])


def _verified(pairs: DataFrame, batch: DataFrame, history: list[DataFrame]) -> DataFrame:
    """LINKS of the (fresh, other, old) pairs whose words differ by few enough edits. The tables are bucketed by h, so only
    the pairs move."""
    columns = ["guest_id", "n", "code", "batch_no", "at", "chunk_index", "rep"]

    def side(table: DataFrame, name: str, key: str) -> DataFrame:
        return table.select(F.col("h").alias(key), *[F.col(c).alias(f"{name}_{c}") for c in columns])

    def near(found: DataFrame) -> DataFrame:
        most = "cast(greatest(a_n, b_n) / %d as int)" % PART
        # not an equality, which would become a join key and cost the tables their buckets
        return found.filter(f"not (a_guest_id < b_guest_id or a_guest_id > b_guest_id) and abs(a_n - b_n) <= {most} and levenshtein(a_code, b_code, {most}) >= 0")

    def links(found: DataFrame, first: Column, old: bool) -> DataFrame:
        pick = lambda a, b: F.when(first, a).otherwise(b)
        ends = [(pick(F.col("other"), F.col("fresh")), _order("b_"), _order("a_")), (pick(F.col("fresh"), F.col("other")), _order("a_"), _order("b_"))]
        (late, b_late, a_late), (early, a_early, b_early) = ends
        return found.select(late.alias("late"), early.alias("early"), F.lit(old).alias("old"), pick(b_late, a_late).alias("late_at"), pick(a_early, b_early).alias("early_at"))

    left = pairs.join(side(batch, "a", "fresh"), "fresh")
    out = links(near(left.filter("not old").join(side(batch, "b", "other"), "other")), _order("a_") < _order("b_"), False)
    for classes in history:
        out = out.unionByName(links(near(left.filter("old").join(side(classes, "b", "other"), "other")), F.lit(False), True))
    return out


def _repetitions(links: DataFrame, n: int, keep: Callable[[DataFrame], str]) -> list[str]:
    """Tables, written by ``keep``, of the h of the classes that aren't accepted: those with a link to an accepted
    earlier class; what is old is accepted. ``n`` is the number of links.

    In each round, what has no link to something earlier is accepted, what has a link to it is a repetition, and both
    leave, with the links to repetitions. The rounds are as many as the longest chain of decisions, commonly two.
    """
    spark, done = links.sparkSession, []
    links = links.select("late", "early", "old")
    while n:
        late = links.select(F.col("late").alias("early")).distinct()
        cases = links.filter("old").select("late").unionByName(links.filter("not old").join(late, "early", "left_anti").select("late")).distinct()
        done.append(keep(cases.select(F.col("late").alias("h"))))
        cases = spark.read.schema("h long").parquet(done[-1]).select(F.col("h").alias("late"))
        rest = links.join(cases, "late", "left_anti").filter("not old").join(cases.select(F.col("late").alias("early")), "early", "left_anti")
        links, n = _counted(rest.select("late", "early", "old"), "history-links")
    return done


def _near_sketches(a: str, b: str) -> Column:
    """Whether the sketches in two columns allow for a tenth of edits, as ``_may_repeat`` tells."""
    n, m = (F.col(c).bitwiseAND(F.lit(_MOST)) for c in (a, b))
    longest = F.greatest(n, m)
    edits = F.floor(longest / PART)
    apart = F.bit_count(F.shiftrightunsigned(F.col(a).bitwiseXOR(F.col(b)), 12))
    return (longest == _MOST) | ((F.abs(n - m) <= edits) & (apart <= 2 * edits))


def _tiles(own: DataFrame, others: DataFrame, tile: int) -> DataFrame:
    """All pairs (fresh, other, old) of an entry of ``own``, all fresh, and one of ``others`` of the same key whose
    sketches allow a repetition, by tiles of a block, each pair of tiles in its own group."""

    def parts(entries: DataFrame, name: str) -> DataFrame:
        return entries.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias(name))

    counts = parts(own, "t").join(parts(others, "u"), "key")
    place = lambda n: F.pmod(F.xxhash64("h"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows = own.join(counts, "key").select("key", place("t").alias("i"), every("u").alias("j"), F.col("h").alias("fresh"), F.col("sketch").alias("s"))
    columns = others.join(counts, "key").select("key", every("t").alias("i"), place("u").alias("j"), F.col("h").alias("other"), F.col("sketch").alias("o"), (F.col("sketch").bitwiseAND(F.lit(_FRESH)) == 0).alias("old"))
    return rows.join(columns, ["key", "i", "j"]).filter((F.col("fresh") != F.col("other")) & _near_sketches("s", "o")).select("fresh", "other", "old").distinct()


def _cases(features: DataFrame, verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """(case_id, kept_id): the members of the classes with what they repeat."""
    members = features.select("id", *keys, F.struct("batch_no", "at", "chunk_index", F.col("id").alias("rep")).alias("at_id"))
    found = members.join(verdicts, keys).filter("id <> kept_id and (kept_at is null or at_id > kept_at)")
    return found.select(F.col("id").alias("case_id"), "kept_id").distinct()


class _Tables:
    """Rows of one kind in a folder: a base, laid out by the workspaces' part and bucketed by a key, and runs appended
    to it, bucketed alike, so that neither moves in a join by that key. Both are registered only while a batch is
    taken in; ``run`` tells which rows are committed."""

    def __init__(self, spark: SparkSession, folder: str, kind: str, key: str, state: dict) -> None:
        self.spark, self.folder, self.kind, self.key, self.state = spark, folder, kind, key, state
        self.names: dict[str, str] = {}

    def _path(self, which: str) -> str:
        return f"{self.folder}/{self.kind}-{which}-{self.state['version']}"

    def _named(self, which: str, schema: str) -> str:
        """The name under which the files of the base or the runs stand in the catalog."""
        if which not in self.names:
            name = f"corvane_{self.kind}_{which}_{uuid.uuid4().hex}"
            parts = "PARTITIONED BY (part)" if which == "base" else ""
            self.spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet OPTIONS (compression 'zstd') {parts} CLUSTERED BY ({self.key}) SORTED BY ({self.key}) INTO {self.state['buckets']} BUCKETS LOCATION '{self._path(which)}'")
            self.names[which] = name
            if which == "base" and self.state["runs"]:
                self.spark.sql(f"MSCK REPAIR TABLE {name}")
        return self.names[which]

    def append(self, rows: DataFrame, run: int) -> DataFrame:
        """Appends ``rows`` (with part) as a run, to the base if there is none yet, and gives them as they are stored."""
        which = "runs" if self.state["runs"] else "base"
        stored = rows.repartition(self.state["buckets"], self.key).withColumn("run", F.lit(run).cast("long"))
        columns = [c for c in stored.columns if c != "part"] + ["part"]
        schema = ", ".join(f"{c} {stored.schema[c].dataType.simpleString()}" for c in columns)
        self.state.setdefault("schemas", {})[self.kind] = schema
        name = self._named(which, schema)
        stored.select(*columns).write.mode("append").format("parquet").insertInto(name)
        self.spark.catalog.refreshTable(name)
        return self.spark.table(name).filter(F.col("run") == run)

    def frames(self, parts: list[int] | None = None) -> list[DataFrame]:
        """The committed rows of the base and of the runs that lie in the given parts. Of the base, no other part is read."""
        if not self.state["runs"]:
            return []
        schema = self.state["schemas"][self.kind]
        out = []
        for which, runs in (("base", self.state["runs"][:1]), ("runs", self.state["runs"][1:])):
            if runs:
                df = self.spark.table(self._named(which, schema)).filter(F.col("run").isin(runs))
                out.append(df if parts is None else df.filter(F.col("part").isin(parts)))
        return out

    def close(self) -> None:
        """Takes the names out of the catalog; the files stay."""
        for name in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names = {}


class AcceptedHistory:
    """Accepted classes and the sorted runs of their keys, in a folder that all executors share.

    A batch adds a run of class rows and a run of key entries and reads of the history only what meets it: of the base
    the parts of its workspaces, there the blocks with a key of its own. Neither base nor runs are written, sorted or
    shuffled again for it. Classes that turned out to be repetitions are listed apart, left out in reading and dropped
    when runs are merged, which happens once there are more than ``max_runs``. What counts is told by a manifest in the
    folder, written last, so that a batch that broke off leaves nothing, and a new object on the folder goes on.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, window: int = WINDOW, max_runs: int = MAX_RUNS) -> None:
        self.spark, self.window, self.max_runs = spark, window, max_runs
        self.folder = folder or f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
        self.state = self._opened() or {"version": 0, "number": 0, "buckets": 0, "runs": [], "gone": []}
        self._tables()

    def _tables(self) -> None:
        self.classes, self.entries = _Tables(self.spark, self.folder, "classes", "h", self.state), _Tables(self.spark, self.folder, "entries", "key", self.state)

    def _hadoop(self, path: str) -> tuple:
        made = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return made, made.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _opened(self) -> dict | None:
        """The state of the last manifest."""
        pattern, files = self._hadoop(f"{self.folder}/manifest-*.json")
        names = sorted(str(f.getPath().toString()) for f in files.globStatus(pattern) or [])
        return json.loads(self.spark.read.text(names[-1], wholetext=True).first()[0]) if names else None

    def _commit(self) -> None:
        """Writes the manifest under another name first, so that it is there as a whole or not at all."""
        self.state["number"] += 1
        final, files = self._hadoop(f"{self.folder}/manifest-{self.state['number']:09d}.json")
        part, _ = self._hadoop(f"{self.folder}/_{uuid.uuid4().hex}")
        out = files.create(part)
        out.write(bytearray(json.dumps(self.state).encode()))
        out.close()
        if not files.rename(part, final):
            raise OSError(f"cannot write {final}")

    def _keep(self, df: DataFrame, kind: str) -> str:
        path = f"{self.folder}/{kind}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def _listed(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema("h long").parquet(*paths) if paths else self.spark.createDataFrame([], "h long")

    def _gone(self) -> DataFrame | None:
        """The h of the classes that are repetitions but still stand in base or runs."""
        return self._listed(self.state["gone"]) if self.state["gone"] else None

    def accepted(self, parts: list[int] | None = None) -> list[DataFrame]:
        """The class rows of base and runs that aren't copies of an accepted class; those in ``_gone`` aren't accepted."""
        return [df.filter("kept_id is null").drop("kept_id", "many") for df in self.classes.frames(parts)]

    @staticmethod
    def _sorted(entries: DataFrame) -> DataFrame:
        return entries.repartitionByRange("key", "h").sortWithinPartitions("key", "h")

    def _buckets(self, chunks: int) -> int:
        """Buckets for a base of so many chunks: a core for each, or more where these would hold over ``BUCKET_ENTRIES``, up
        to the session's shuffle partitions."""
        most = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return max(1, min(most, max(self.spark.sparkContext.defaultParallelism, math.ceil(chunks * KEYS / BUCKET_ENTRIES))))

    def compact(self) -> None:
        """Merges base and runs into a new base, without repetitions and copies."""
        if len(self.state["runs"]) < 2 and not self.state["gone"]:
            return
        gone, run = self._gone(), secrets.randbits(62)
        whole = lambda frames: reduce(DataFrame.unionByName, frames).drop("run")
        old = self.state
        classes, entries = whole([df.filter("kept_id is null") for df in self.classes.frames()]), whole(self.entries.frames())
        if gone is not None:
            classes, entries = classes.join(gone, "h", "left_anti"), entries.join(gone, "h", "left_anti")
        closing = (self.classes, self.entries)
        self.state = {"version": old["version"] + 1, "number": old["number"], "buckets": self._buckets(sum(df.count() for df in self.classes.frames())), "runs": [], "gone": []}
        self._tables()
        self.classes.append(classes, run)
        self.entries.append(entries.withColumn("sketch", F.col("sketch").bitwiseAND(F.lit(~_FRESH))), run)
        self.state["runs"] = [run]
        for tables in (*closing, self.classes, self.entries):
            tables.close()
        self._commit()

    def add(self, chunks: DataFrame) -> DataFrame:
        """Takes in a batch (or several, in the order of batch_no, created_at, chunk_index, id) and gives (case_id,
        kept_id): every chunk that repeats an accepted one with that chunk.

        Chunk B repeats A if both have one guest_id and words and a word edit distance of at most a tenth of the longer
        one's words. Empty batches, blank texts and rows with a null id, guest_id or text give no case. Rows of one id
        and text are one chunk. Copies of a text are judged once, as a class (a 64-bit hash of workspace and words): no
        pair of copies is ever formed, but each copy comes out with what its class repeats of the chunks accepted before
        the copy, or with the class's first chunk.
        """
        return self.add_features(materialize(word_features(chunks), "history-features"))

    def add_features(self, features: DataFrame) -> DataFrame:
        """As ``add``, for the ``word_features`` of a batch, which are read several times."""
        parts = [r[0] for r in features.select(_part()).distinct().collect()]  # not more than PARTS numbers
        return _cases(features, self.spark.read.parquet(self._judged(features, parts)), ["h"])

    def _judged(self, features: DataFrame, parts: list[int]) -> str:
        """Takes in a batch and gives the table (h, kept_id, kept_at) of what its classes repeat; kept_at is the place from
        which on a copy repeats that, null for all."""
        first = F.min(F.struct("batch_no", "at", "chunk_index", F.col("id").alias("rep"))).alias("o")
        grouped = features.groupBy("h").agg(first, F.max("id").alias("top"), F.min("id").alias("bottom"), F.first("guest_id").alias("guest_id"), F.first("n").alias("n"), F.first("code").alias("code"))
        batch = grouped.select("h", "o.*", (F.col("top") != F.col("bottom")).alias("many"), "guest_id", "n", "code", _part())
        run, gone = secrets.randbits(62), self._gone()
        if not self.state["runs"]:
            self.state["buckets"] = self._buckets(features.count())
        history = self.accepted(parts)
        kept_id = F.lit(None).cast("string")
        for n, classes in enumerate(history):
            known = classes.select("h", F.col("rep").alias(f"_rep{n}"))
            batch = batch.join(known if gone is None else known.join(gone, "h", "left_anti"), "h", "left")
            kept_id = F.coalesce(F.col(f"_rep{n}"), kept_id)
        batch = batch.withColumn("kept_id", kept_id).drop(*[f"_rep{n}" for n in range(len(history))])
        before = self.entries.frames(parts)
        batch = self.classes.append(batch, run).drop("run")
        new = batch.filter("kept_id is null")
        fresh = self.entries.append(key_entries(new), run).select("key", "h", "sketch")
        links, gone_now = self._compared(self._merged(fresh, before, gone), new, history)
        verdicts = batch.filter("kept_id is not null").select("h", "kept_id", F.lit(None).cast(links.schema["late_at"].dataType).alias("kept_at"))
        repetitions = self._listed(gone_now)
        # of a link both ends' fates: the later one of a repetition and what it repeats, if that is accepted
        fates = links.join(repetitions.select(F.col("h").alias("late"), F.lit(True).alias("late_gone")), "late", "left").join(repetitions.select(F.col("h").alias("early"), F.lit(True).alias("early_gone")), "early", "left").filter("late_gone is null or early_gone is null")
        named = fates.filter("late_gone is not null").select(F.col("late").alias("h"), F.col("early_at.rep").alias("kept_id"), F.when(~F.col("old"), F.col("early_at")).alias("kept_at"))
        # what was accepted after the first member of a rejected class: its later members repeat that, too
        renamed = fates.filter("early_gone is not null and not old").select(F.col("early").alias("h"), F.col("late_at.rep").alias("kept_id"), F.col("late_at").alias("kept_at"))
        copies = new.filter("many").join(repetitions, "h", "left_anti").select("h", F.col("rep").alias("kept_id"), _order().alias("kept_at"))
        path = self._keep(verdicts.unionByName(copies).unionByName(named).unionByName(renamed), "verdicts")
        self.state["gone"] += gone_now
        self.state["runs"].append(run)
        self.classes.close()
        self.entries.close()
        self._commit()
        if len(self.state["runs"]) > self.max_runs:
            self.compact()
        return path

    def _merged(self, fresh: DataFrame, before: list[DataFrame], gone: DataFrame | None) -> DataFrame:
        """The entries of all blocks (records of one key) that hold a fresh record and another one, in the order of their
        keys. Entries of base and runs meet the fresh ones bucket by bucket; only what such blocks hold is sorted."""
        keys = fresh.select("key")
        matched = [df.join(keys, "key", "left_semi").select("key", "h", F.col("sketch").bitwiseAND(F.lit(~_FRESH)).alias("sketch")) for df in before]
        several = fresh.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("key")
        if not matched:
            return materialize(self._sorted(fresh.join(several, "key", "left_semi")), "history-merged")
        old = reduce(DataFrame.unionByName, matched)
        old = materialize(old if gone is None else old.join(gone, "h", "left_anti"), "history-matched")
        live = fresh.join(several.unionByName(old.select("key")).distinct(), "key", "left_semi")
        return materialize(self._sorted(live.unionByName(old)), "history-merged")

    def _compared(self, merged: DataFrame, new: DataFrame, history: list[DataFrame]) -> tuple[DataFrame, list[str]]:
        """Links (late, early, old) between similar classes, and the tables of the h of the classes that are repetitions."""
        is_fresh = F.col("sketch").bitwiseAND(F.lit(_FRESH)) != 0
        keep = lambda df: self._keep(df, "gone")

        def checked(pairs: DataFrame) -> DataFrame:
            one_way = lambda pick, c: F.when(F.col("old"), F.col(c)).otherwise(pick("fresh", "other")).alias(c)
            return _verified(pairs.select(one_way(F.greatest, "fresh"), one_way(F.least, "other"), "old").distinct(), new, history)

        found = materialize(_scan(merged.withColumn("src", F.xxhash64("_metadata.file_path")), self.window), "history-windows")
        links, n = _counted(checked(found.filter("fresh is not null")), "history-links")
        listed = _repetitions(links, n, keep)
        wide = self._cut(found)
        if wide is None:
            return links, listed
        # blocks wider than a window: again with what is accepted now, which any of them may hold, until nothing changes
        merged = materialize(merged.join(wide, "key", "left_semi").select("key", "h", "sketch"), "history-wide")
        while True:
            left = materialize(merged.filter(is_fresh).join(self._listed(listed), "h", "left_anti").unionByName(merged.filter(~is_fresh)), "history-wide")
            found = materialize(_scan(self._sorted(left).withColumn("src", F.lit(0).cast("long")), self.window), "history-windows")
            more, extra = _counted(checked(found.filter("fresh is not null")).join(links, ["late", "early"], "left_anti"), "history-links")
            if not extra:
                cut = self._cut(found)
                if cut is None:
                    break
                rest = left.join(cut, "key", "left_semi")
                pairs = _tiles(rest.filter(is_fresh), rest, 8 * self.window).filter("old or fresh < other")
                more, extra = _counted(checked(pairs).join(links, ["late", "early"], "left_anti"), "history-links")
                if not extra:
                    break
            links, n = links.unionByName(more.select(links.columns)), n + extra
            listed = _repetitions(links, n, keep)
        # a repetition left before it met all of its block: now with everything accepted there, which changes no verdict
        cases = merged.filter(is_fresh).join(self._listed(listed), "h", "left_semi")
        more = materialize(checked(_tiles(cases, left, 8 * self.window)).join(links, ["late", "early"], "left_anti"), "history-links")
        return links.unionByName(more.select(links.columns)), listed

    def _cut(self, found: DataFrame) -> DataFrame | None:
        marks = found.filter("fresh is null")
        wide = marks.filter("not old").select("key")
        split = marks.filter("old").groupBy("key").count().filter("count > 1").select("key")
        keys = wide.unionByName(split).distinct()
        return None if keys.isEmpty() else materialize(keys, "history-cut")


def repeated_chunks(chunks: DataFrame, window: int = WINDOW, max_runs: int = MAX_RUNS, at_once: int = AT_ONCE) -> DataFrame:
    """(case_id, kept_id) over all batches: batch 0 founds the history, the later ones are added in order, ``at_once`` of
    them in one go, which gives the same as one by one. The words of all chunks are read once and laid down by batch, so
    each batch reads its own rows only."""
    spark = chunks.sparkSession
    history = AcceptedHistory(spark, window=window, max_runs=max_runs)
    path = f"{history.folder}/batches"
    features = word_features(chunks).withColumn("_batch", F.greatest(F.col("batch_no"), F.lit(0)))
    features.write.partitionBy("_batch").option("compression", "zstd").parquet(path)
    rows = spark.read.schema(features.schema).parquet(path)
    # a number of each batch and, with it, at most PARTS others
    parts: dict[int, list[int]] = {}
    for r in rows.select("_batch", _part()).distinct().collect():
        parts.setdefault(r[0], []).append(r[1])
    founding = [n for n in sorted(parts) if n == 0]
    later = [n for n in sorted(parts) if n > 0]
    groups = [g for g in (founding, *(later[i : i + at_once] for i in range(0, len(later), at_once))) if g]
    tables = []
    for group in groups:
        touched = sorted(set().union(*(parts[n] for n in group)))
        tables.append((group, history._judged(rows.filter(F.col("_batch").isin(group)).drop("_batch"), touched)))
    if not tables:
        return spark.createDataFrame([], "case_id string, kept_id string")
    number = F.lit(None).cast("int")
    for k, (group, _) in enumerate(tables):
        number = F.when(F.col("_batch").isin(group), k).otherwise(number)
    verdicts = reduce(DataFrame.unionByName, [spark.read.parquet(table).withColumn("_group", F.lit(k)) for k, (_, table) in enumerate(tables)])
    return _cases(rows.withColumn("_group", number), verdicts, ["_group", "h"])
