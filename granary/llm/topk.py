"""Exact top-k search by tiled matrix products.

Vectors are packed into shards and queries into tiles. Every tile meets every shard as one matrix
product; per query only the best of a product are kept, lists are merged along the shards of a
task, and the tasks' lists are merged in a tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from granary.llm.common import frugal, partitions

SHARD = 8192  # vectors of a shard
TILE = 4096  # queries of a tile
BLOCK = 256  # queries of a tile that are multiplied at once
STRIDE = 7919  # slots between the shards of one task; a task's first shard has the slot of the task's number
FAN_IN = 16  # lists that one step of the merge tree joins
EXACT = 1 << 53  # integers up to here are exact in a double

PACKED = pa.schema([("pack", pa.int64()), ("dim", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary())])
FOUND = pa.schema([("slot", pa.int32()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def integers(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component, which is a whole number held as a double."""
    return F.transform(F.col(f"`{vector}`"), lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))


def usable(vector: str) -> Column:
    c = F.col(f"`{vector}`")
    return c.isNotNull() & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf"))))


def pack(most: int):
    """Rows (id, components) to packs of at most ``most`` vectors of one length, ordered by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        number = (task.partitionId() if task else 0) << 32
        held: dict[int, list] = {}

        def send(dim: int) -> pa.RecordBatch:
            nonlocal number
            rows = sorted(held.pop(dim), key=lambda r: r[0])
            number += 1
            matrix = np.array([v for _, v in rows], np.float64).reshape(len(rows), dim)
            return pa.RecordBatch.from_arrays([pa.array([number - 1], pa.int64()), pa.array([dim], pa.int32()), pa.array([np.array([i for i, _ in rows], np.int64).tobytes()], pa.binary()), pa.array([matrix.tobytes()], pa.binary())], schema=PACKED)

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                v = v.values.to_numpy()
                held.setdefault(len(v), []).append((i, v))
                if len(held[len(v)]) >= most:
                    yield send(len(v))
        for dim in list(held):
            yield send(dim)

    return run


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to smaller ids; ``ids`` ascends. The row of the query itself is left out."""
    ok = ids != own
    scores, ids = scores[ok], ids[ok]
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        above = np.flatnonzero(scores > least)
        pick = np.concatenate([above, np.flatnonzero(scores == least)[: k - len(above)]])
        scores, ids = scores[pick], ids[pick]
    by = np.lexsort((ids, -scores))
    return scores[by], ids[by]


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers: in doubles where they stay exact, else in integers without bound."""
    if not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < EXACT:
        return (a @ b.T).astype(np.int64)
    big = [[int(x) for x in row] for row in b]
    limit = (1 << 63) - 1
    return np.array([[max(-limit, min(limit, sum(int(x) * y for x, y in zip(row, other, strict=True)))) for other in big] for row in a], np.int64).reshape(len(a), len(b))


def multiply(k: int):
    """Pairs of tile and shard, sorted by tile, to each query's best list over this task's shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, slot, queries = None, 0, np.zeros(0, np.int64)
        lists: list[tuple[np.ndarray, np.ndarray]] = []

        def emit() -> Iterator[pa.RecordBatch]:
            if now is not None:
                sizes = [len(s) for s, _ in lists]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(sum(sizes), slot, np.int32)), pa.array(np.repeat(queries, sizes)), pa.array(np.concatenate([i for _, i in lists])), pa.array(np.concatenate([s for s, _ in lists]))], schema=FOUND)

        for batch in batches:
            for at, tile, dim, q_ids, q_vectors, ids, vectors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (tile, at) != now:
                    yield from emit()
                    now, slot, queries = (tile, at), at, np.frombuffer(q_ids, np.int64)
                    lists = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)
                own = np.frombuffer(ids, np.int64)
                a, b = np.frombuffer(q_vectors, np.float64).reshape(len(queries), dim), np.frombuffer(vectors, np.float64).reshape(len(own), dim)
                for x in range(0, len(queries), BLOCK):
                    scores = product(a[x : x + BLOCK], b)
                    for y, row in enumerate(scores, x):
                        s, i = best(row, own, queries[y], k)
                        if len(lists[y][0]):
                            s, i = np.concatenate([lists[y][0], s]), np.concatenate([lists[y][1], i])
                            by = np.lexsort((i, -s))[:k]
                            s, i = s[by], i[by]
                        lists[y] = (s, i)
        yield from emit()

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """For each query the ``k`` rows with the highest inner product: query_id, rank, vec_id, score.

    Components become floor(scale * x); scores are exact integers (held at the limits of a long).
    Ties go to the smaller id. Rows with the query's own id are no candidates. Vectors that are null
    or hold null or non-finite components, and rows without an id, take no part; vectors of another
    length than the query's are no candidates. Repeated rows are candidates each. Components whose
    scaled value is beyond a long are held at its limits. An empty table, or a query without candidates,
    gives no rows; other columns are ignored whatever their names.

    Shards are dealt to slots in turn, and tiles to every slot, of which there are as many as partitions
    but no more than shards.
    """
    n = max(1, min(partitions(vectors.sparkSession), -(-vectors.count() // SHARD)))

    def packed(df: DataFrame, most: int) -> DataFrame:
        rows = df.filter(F.col(f"`{id_col}`").isNotNull() & usable(vector_col)).select(F.col(f"`{id_col}`").cast("long").alias("id"), integers(vector_col, scale).alias("v"))
        return rows.mapInArrow(frugal(pack(most)), "pack long, dim int, ids binary, vectors binary")

    shards = packed(vectors, SHARD).withColumn("slot", F.pmod(F.shiftright("pack", 32) + F.col("pack").bitwiseAND(0xFFFFFFFF) * F.lit(STRIDE), F.lit(n)).cast("int"))
    tiles = packed(queries, TILE).select(F.col("pack").alias("tile"), "dim", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("slot"))
    pairs = tiles.join(shards, ["slot", "dim"]).select("slot", "tile", "dim", "q_ids", "q_vectors", "ids", "vectors")
    found = pairs.sortWithinPartitions("tile", "slot").mapInArrow(frugal(multiply(k)), "slot int, query_id long, vec_id long, score long")
    order = (F.col("score").desc(), F.col("vec_id"))
    while n > 1:
        n = -(-n // FAN_IN)
        found = found.withColumn("slot", F.pmod(F.col("slot"), F.lit(n)).cast("int"))
        if n > 1:
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "slot").orderBy(*order))).filter(F.col("rank") <= k).drop("rank")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, vectors.filter("vec_id % 50 = 0"))


ORACLE_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where embedding is not null and vec_id is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
)
select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score
from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
"""
