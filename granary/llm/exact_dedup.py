"""Exact dedup with a log-structured merge index of digests.

Memtables: every task fills a table of digests with the bytes they stand for, and flushes it as a
sorted run; equal texts in a memtable are compared byte by byte and leave as one entry with the ids
of all rows. A run is cut into segments by ranges of digests, each with a filter and its least and
greatest digest, and every range has an index of its own. Index: a segment's digests are looked up in
the runs of the index whose filter may hold them; a hit keeps the smallest identifier, that is the
rank of the preferred row, and the rest becomes a run of level 0. A level with FAN_IN runs is
compacted into one run of the next. Verification: digests that several entries have are hits. Their
texts are fetched, through a filter as large as the hits need or by a shuffle beyond FILTER_BYTES,
and grouped by their bytes, so a digest never decides alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.bigrams import bundle, unbundle
from granary.llm.common import frugal, kept_rows, partitions_for, text_of, written

MEMTABLE_ROWS = 50_000
MEMTABLE_BYTES = 48 << 20
SEGMENT_ROWS = 1 << 20  # entries that an index is planned for
FAN_IN = 8  # runs of a level that one compaction merges
BITS = 16  # of a filter, for each key
FILTER_BYTES = 16 << 20  # of the largest filter of hits that is broadcast; beyond it texts are shuffled by digest
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_ID = -(1 << 63)  # the rank of a null id, behind every other

RUN_TYPE = "run long, slot int, digest binary, ident long, n long, members array<long>"
RUNS = pa.schema([("run", pa.int64()), ("slot", pa.int32()), ("digest", pa.binary()), ("ident", pa.int64()), ("n", pa.int64()), ("members", pa.list_(pa.int64()))])


def flush_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (id, normal text as bytes) to the entries of sorted runs."""
    task = TaskContext.get()
    number = (task.partitionId() if task else 0) << 24
    table: dict[bytes, list[tuple[bytes, list]]] = {}
    rows = size = 0

    def run() -> Iterator[pa.RecordBatch]:
        entries = []
        for digest in sorted(table):
            for slot, (_, members) in enumerate(table[digest]):
                members.sort(key=lambda i: NO_ID if i is None else i, reverse=True)
                entries.append((number, slot, digest, NO_ID if members[0] is None else members[0], len(members), members))
        for a in range(0, len(entries), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*entries[a : a + 10_000], strict=True), RUNS.types, strict=True)], schema=RUNS)

    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            slots = table.setdefault(hashlib.sha256(text).digest(), [])
            found = next((members for held, members in slots if held == text), None)
            if found is None:
                slots.append((text, [i]))
                size += len(text)
            else:
                found.append(i)
            rows += 1
            if rows >= MEMTABLE_ROWS or size >= MEMTABLE_BYTES:
                yield from run()
                table.clear()
                rows = size = 0
                number += 1
    yield from run()


def slots(digests: np.ndarray, size: int) -> np.ndarray:
    """Two places of each digest (32 bytes) in a filter of ``size`` bits."""
    return digests.view(">u8").reshape(-1, 4)[:, 1:3].astype(np.uint64) % np.uint64(size)


def filter_of(digests: np.ndarray) -> bytes:
    bits = np.zeros(max(64, BITS * len(digests)), bool)
    bits[slots(digests, len(bits)).reshape(-1)] = True
    return np.packbits(bits).tobytes()


def segments(shards: int):
    """Entries (run, digest, ident), sorted by digest in each run, to segments with filters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, ident = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            digest = np.array(batch.column(1).to_pylist(), "S32")
            shard = (((digest.view(">u8").reshape(-1, 4)[:, 0].astype(np.uint64) >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)
            by = np.lexsort((digest, shard, runs))
            heads = np.flatnonzero(np.append(True, (np.diff(shard[by]) != 0) | (np.diff(runs[by]) != 0))) if len(by) else by
            rows = []
            for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(by)], strict=True) if len(by) else ():
                own = digest[by[a:b]]
                rows.append((int(shard[by[a]]), bundle(own.tobytes(), ident[by[a:b]].tobytes(), filter_of(own))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["shard", "body"])

    return frugal(run)


class Run:
    """Sorted distinct digests with the smallest identifier (the largest id) and the entries of each, and a filter."""

    def __init__(self, digests: np.ndarray, idents: np.ndarray, hits: np.ndarray, bits: bytes | None = None) -> None:
        self.digests, self.idents, self.hits = digests, idents, hits
        self.bits = np.unpackbits(np.frombuffer(filter_of(digests) if bits is None else bits, np.uint8)).astype(bool)

    @staticmethod
    def merged(digests: np.ndarray, idents: np.ndarray, hits: np.ndarray, bits: bytes | None = None) -> Run:
        digests, at = np.unique(digests, return_inverse=True)
        best, total = np.full(len(digests), NO_ID), np.zeros(len(digests), np.int64)
        np.maximum.at(best, at, idents)
        np.add.at(total, at, hits)
        return Run(digests, best, total, bits)

    def find(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the digests are here, and where."""
        some = np.flatnonzero((digests >= self.digests[0]) & (digests <= self.digests[-1]))
        some = some[self.bits[slots(digests[some], len(self.bits))].all(axis=1)]
        at = np.searchsorted(self.digests, digests[some])
        same = self.digests[at] == digests[some]
        return some[same], at[same]


class Index:
    """Levels of runs; a digest is in one run only."""

    def __init__(self) -> None:
        self.levels: list[list[Run]] = [[]]

    def add(self, new: Run) -> None:
        left = np.ones(len(new.digests), bool)
        for run in (r for level in self.levels for r in level):
            which, at = run.find(new.digests)
            run.idents[at] = np.maximum(run.idents[at], new.idents[which])
            run.hits[at] += new.hits[which]
            left[which] = False
        if left.any():
            self.levels[0].append(Run(new.digests[left], new.idents[left], new.hits[left]))
        for i in range(len(self.levels)):
            if len(self.levels[i]) >= FAN_IN:
                self.compact(i)

    def compact(self, i: int) -> None:
        """Merges the runs of a level into one of the next."""
        if i + 1 == len(self.levels):
            self.levels.append([])
        runs, self.levels[i] = self.levels[i], []
        self.levels[i + 1].append(Run.merged(*(np.concatenate([getattr(r, k) for r in runs]) for k in ("digests", "idents", "hits"))))


def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of one shard to the digests that several entries have, with the smallest identifier and the entries."""
    table = Index()
    for batch in batches:
        for body in batch.column(1):
            digests, idents, bits = unbundle(body.as_py())
            digests = np.frombuffer(digests, "S32")
            table.add(Run.merged(digests, np.frombuffer(idents, np.int64), np.ones(len(digests), np.int64), bits))
    for run in (r for level in table.levels for r in level):
        several = np.flatnonzero(run.hits > 1)
        whole = run.digests[several].tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([whole[i : i + 32] for i in range(0, len(whole), 32)], pa.binary()), pa.array(run.idents[several]), pa.array(run.hits[several])], names=["digest", "ident", "hits"])


def bits_of(keys: DataFrame, n: int) -> np.ndarray:
    """A filter of ``n`` keys (column key), BITS bits each, in 64-bit words; ``n`` is bounded by FILTER_BYTES."""
    words = np.zeros(max(64, BITS * n // 64), np.uint64)
    places = keys.select(F.explode(F.array("key", F.xxhash64("key"))).alias("h")).select(F.pmod(F.shiftright("h", 6), F.lit(len(words))).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(63).cast("int")).alias("bit"))
    for row in places.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        words[row.word] = np.uint64(row.bits & 0xFFFFFFFFFFFFFFFF)
    return words


def passing(bits: np.ndarray):
    """Keeps rows whose hashes (last two columns) are set in the filter."""

    def hit(h: np.ndarray) -> np.ndarray:
        word = (h >> 6) % len(bits)
        return (bits[word] >> (h & 63).astype(np.uint64)) & np.uint64(1) == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = hit(batch.column(3).to_numpy()) & hit(batch.column(4).to_numpy())
            yield batch.select([0, 1, 2]).filter(pa.array(ok))

    return frugal(run)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept and digest (binary).

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. Of equal texts
    the row with the largest id stays; ids that are null come last, and of rows that also share the
    id exactly one stays. Groups of any size cost each task one entry per memtable. An empty table
    gives no rows; other columns are ignored whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.translate(text_of(text_col), UPPER, LOWER).cast("binary").alias("text"))
    runs = written(rows.mapInArrow(frugal(flush_runs), RUN_TYPE))
    shards = partitions_for(spark, runs.count(), SEGMENT_ROWS)
    dealt = runs.select("run", "digest", "ident").mapInArrow(segments(shards), "shard int, body binary").repartitionById(shards, F.col("shard"))
    hits = dealt.mapInArrow(frugal(index), "digest binary, ident long, hits long")
    reps = written(runs.join(hits.select("digest"), "digest", "left_semi").select("run", "slot", "digest", "ident", "n"))

    key, n = F.xxhash64("digest", "ident"), reps.count()
    texts = rows.select(F.unhex(F.sha2("text", 256)).alias("digest"), F.coalesce("id", F.lit(NO_ID)).alias("ident"), "text")
    if n * BITS // 8 <= FILTER_BYTES:
        hashed = texts.withColumn("h1", key).withColumn("h2", F.xxhash64("h1"))
        fetched = hashed.mapInArrow(passing(bits_of(reps.select(key.alias("key")), n)), "digest binary, ident long, text binary")
    else:
        fetched = texts.join(reps.select("digest", "ident"), ["digest", "ident"], "left_semi")
    fetched = fetched.dropDuplicates(["digest", "ident", "text"])
    checked = reps.join(fetched, ["digest", "ident"])
    classes = checked.groupBy("digest", "text").agg(F.max(F.struct("ident", "run", "slot")).alias("best"), F.sum("n").alias("size"))
    verdict = checked.join(classes, ["digest", "text"]).select("run", "slot", "digest", "best", "size")

    best = F.coalesce("best", F.struct("ident", "run", "slot"))
    entries = runs.join(verdict, ["digest", "run", "slot"], "left").select("run", "slot", "digest", "members", best.alias("best"), F.coalesce("size", "n").alias("size"))
    flat = entries.select("run", "slot", "digest", "best", "size", F.posexplode("members").alias("pos", "id"))
    kept = (F.col("best.run") == F.col("run")) & (F.col("best.slot") == F.col("slot")) & (F.col("pos") == 0)
    keep_id = F.when(F.col("best.ident") != NO_ID, F.col("best.ident"))
    return flat.select(F.col("id").alias(id_col), keep_id.alias("keep_id"), F.col("size").alias("group_size"), kept.alias("kept"), "digest")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns, whatever those are called. Rows that share id and text stay once."""
    groups = exact_groups(docs, id_col, text_col).select(F.coalesce(F.col(id_col), F.lit(NO_ID)).alias("id"), "digest", "kept")
    small = written(groups.groupBy("id", "digest").agg(F.count(F.lit(1)).alias("n_rows"), F.max("kept").alias("kept")).filter("kept").drop("kept"))
    keys = {"id": F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)), "digest": F.unhex(F.sha2(F.translate(text_of(text_col), UPPER, LOWER).cast("binary"), 256))}
    return kept_rows(docs, small, keys)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


ORACLE_SQL = """
with n as (
  select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
)
select doc_id, max(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size,
  doc_id = max(doc_id) over (partition by t) as kept, sha256(t) as text_sha256
from n
"""
