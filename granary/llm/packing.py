"""Best-fit packing of tokenised documents into sequences.

Best-fit decreasing depends on piece lengths only, and there are at most ``capacity`` of those. So
tasks tokenise and count, the driver packs the histogram (never the pieces), and tasks give every
piece its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import frugal, text_of, written

CAPACITY = 2048
END = 0  # the id after each document
TOKENIZER = "byte_bpe_50k.json"

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("part", pa.int64()), ("local", pa.int64())])
PIECE_TYPE = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, local long"


class Capacities:
    """A segment tree over remaining capacities that finds the tightest open one."""

    def __init__(self, most: int) -> None:
        self.size = 1 << most.bit_length()
        self.open = np.zeros(2 * self.size, bool)

    def set(self, at: int, value: bool) -> None:
        at += self.size
        self.open[at] = value
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        """The smallest open capacity that is at least ``least``."""
        at = least + self.size
        if self.open[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> dict[int, list[tuple[int, int, int, int]]]:
    """Best-fit decreasing over a histogram of lengths.

    Returns for each length its groups of places: pieces, pieces in each bin, first bin, offset.
    Bins with the same remaining capacity are alike, so each step fills as many of them as it can.
    """
    tree, bins, places, fresh = Capacities(capacity), {}, {}, 0

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            if not bins.setdefault(room, []):
                tree.set(room, True)
            bins[room].append((first, n))

    for length in sorted(counts, reverse=True):
        left, own = counts[length], places.setdefault(length, [])
        while left:
            room = tree.tightest(length)
            if room is None:
                room, per = capacity, capacity // length
                first, n = fresh, max(1, left // per)
                fresh += n
            else:
                per = room // length
                first, n = bins[room].pop()
                use = max(1, min(n, left // per))
                if use < n:
                    bins[room].append((first + use, n - use))
                elif not bins[room]:
                    tree.set(room, False)
                n = use
            per = min(per, left)
            own.append((n * per, per, first, capacity - room))
            left -= n * per
            leave(room - per * length, first, n)
    return places


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids; only the first may be shorter than the capacity."""
    first = n % capacity or capacity
    return [(0, first), *((a, capacity) for a in range(first, n, capacity))]


def encoder(path: str) -> tiktoken.Encoding:
    """A byte-level BPE read from a tokenizer's JSON file; ids equal those of the tokenizers library."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space") or not spec["pre_tokenizer"].get("use_regex", True):
        raise ValueError(f"{path} asks for more than a byte-level split")
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    words = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    return tiktoken.Encoding("pack", pat_str=words, mergeable_ranks=ranks, special_tokens=special)


def tokenise(tokenizer: str | None, capacity: int):
    """Rows (id, text) to pieces, with each piece's rank among those of its length in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encoding = encoder(tokenizer or public_tokenizers.path(TOKENIZER))
        task = TaskContext.get()
        part = task.partitionId() if task else 0
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encoding.encode(text.as_py().decode("utf-8", "replace"), allowed_special="all"), END], "<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc, piece, start, length, zlib.crc32(ids[start : start + length].tobytes()), part, int(seen[length])))
                    seen[length] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), PIECES.types, strict=True)], schema=PIECES)

    return run


def place(places: dict[int, list[tuple[int, int, int, int]]]):
    """Adds bin and offset to pieces, from their rank among all pieces of their length (last column)."""
    tables = {length: np.array(groups, np.int64) for length, groups in places.items()}
    ends = {length: np.cumsum(t[:, 0]) for length, t in tables.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for value in np.unique(length).tolist():
                rows = np.flatnonzero(length == value)
                table, end = tables[value], ends[value]
                group = np.searchsorted(end, rank[rows], "right")
                within = rank[rows] - (end[group] - table[group, 0])
                sequence[rows] = table[group, 2] + within // table[group, 1]
                offset[rows] = table[group, 3] + within % table[group, 1] * value
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """Packs documents into sequences of at most ``capacity`` ids; one row per piece.

    A document is its ids and then id 0; null text is empty, so a document of one id. Longer ones
    are cut from their end into full pieces, the first piece may be shorter. ``tokenizer`` is the
    path of a byte-level BPE's JSON file on every machine. Repeated rows and rows that share an id
    or have none are packed each. Texts of any length are encoded whole. Pieces of one length are alike,
    so ties between them do not change the packing. An empty table gives no rows; other columns are
    ignored whatever their names.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset. The driver holds the
    histogram of lengths and the packing plan over it, whose sizes depend on ``capacity`` alone.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    pieces = written(rows.mapInArrow(frugal(tokenise(tokenizer, capacity)), PIECE_TYPE))
    counts = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    plan = best_fit({r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local")).alias("rank"))
    return ranked.mapInArrow(frugal(place(plan)), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("doc_id", id_col)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
