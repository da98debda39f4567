"""N-gram Jaccard join: MinHash banding for candidates, full n-gram sets for the verdict.

Texts with one n-gram set collapse to a representative. Band hashes link representatives to the
smallest one in their bucket, never to each other, and components of those links are the candidate
groups. A candidate group is cut into blocks of bounded size, every pair of blocks is one cell, and
a cell compares all its pairs by one product of their n-gram sets; it returns sums per document and
a spanning forest, not pairs. So each similar pair in a group is found whatever band found the group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.common import frugal, kept_rows, text_of, written
from granary.llm.components import components
from granary.llm.superwindows import BASE, hashes, mixed, squeeze, word_bounds

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.99999  # of pairs just at the similarity, by banding
ROWS = 5
BLOCK_DOCS = 128
BLOCK_GRAMS = 1 << 20
COLUMNS = 1 << 14  # n-grams that a cell's matrix holds at once
CHUNK = 1 << 20

SIGN = bytes(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\t\r\n\x0b\x0c")
TO_SPACE = bytes.maketrans(SIGN, b" " * len(SIGN))


def bands_for(similarity: float, rows: int, recall: float) -> int:
    """Bands of ``rows`` hashes that find a pair of that similarity with at least that probability."""
    return int(np.ceil(np.log1p(-recall) / np.log1p(-(similarity**rows))))


def plain(text: bytes) -> bytes:
    """Lower-case words joined by one space; ASCII punctuation separates words like white space."""
    return b" ".join(text.decode("utf-8", "replace").lower().encode().translate(TO_SPACE).split())


def grams(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of each plain text, and where each text's begin. A shorter text is one gram."""
    owners, values = [], []
    held, first = [], 0

    def deal() -> None:
        raw = np.frombuffer(b" ".join(held), np.uint8)
        starts, stops = word_bounds(raw)
        own = hashes(raw, starts, stops)
        counts = np.array([t.count(b" ") + 1 for t in held], np.int64)
        stop = np.cumsum(counts)
        n = np.maximum(1, counts - words + 1)
        at = np.repeat(stop - counts, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        end = np.minimum(at + words, np.repeat(stop, n))
        gram = np.zeros(len(at), np.uint64)
        for i in range(words):
            inside = at + i < end
            gram = np.where(inside, gram * np.uint64(BASE) + own[np.minimum(at + i, len(own) - 1)], gram)
        owner = np.repeat(np.arange(len(held)), n)
        gram = mixed(gram)
        by = np.lexsort((gram, owner))
        gram, owner = gram[by], owner[by]
        fresh = np.ones(len(gram), bool)
        fresh[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
        values.append(gram[fresh])
        owners.append(np.array(where, np.int64)[owner[fresh]])

    where: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        if t:
            held.append(t)
            where.append(i)
            size += len(t)
            if size >= CHUNK:
                deal()
                held, where, size = [], [], 0
    if held:
        deal()
    if not values:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    owner = np.concatenate(owners)
    return np.concatenate(values), np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])


def signatures(words: int, rows: int, bands: int):
    """Rows (id, tag, text) to the digest and size of their n-gram set and its band hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(20)
        a = rng.integers(1, 1 << 63, rows * bands, np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 1 << 63, rows * bands, np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                values, cuts = grams([plain(t.as_py()) for t in part.column(2)], words)
                size = np.diff(cuts)
                some = np.flatnonzero(size)
                low = np.empty((rows * bands, len(some)), np.uint64)
                for x in range(0, len(some), 64):
                    own = some[x : x + 64]
                    piece = values[cuts[own[0]] : cuts[own[-1] + 1]]
                    heads = cuts[own] - cuts[own[0]]
                    for k in range(rows * bands):
                        low[k, x : x + len(own)] = np.minimum.reduceat((piece * a[k] + b[k]) >> np.uint64(1), heads)
                hashed = np.zeros((bands, len(some)), np.uint64)
                for k in range(rows):
                    hashed = mixed(hashed * np.uint64(BASE) + low[k * bands : (k + 1) * bands])
                hashed = mixed(hashed + np.arange(1, bands + 1, dtype=np.uint64)[:, None] * np.uint64(BASE)).view(np.int64).T
                found = dict(zip(some.tolist(), hashed, strict=True))
                digest = [hashlib.blake2b(values[cuts[i] : cuts[i + 1]].tobytes(), digest_size=16).digest() for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(digest, pa.binary()), pa.array(size, pa.int64()), pa.array([found.get(i) for i in range(part.num_rows)], pa.list_(pa.int64()))], names=["id", "tag", "digest", "size", "bands"])

    return run


def overlaps(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of 0/1 matrices."""
    n = len(cuts) - 1
    row = np.repeat(np.arange(n), np.diff(cuts))
    _, column = np.unique(values, return_inverse=True)
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    out = np.zeros((n, n), np.float64)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [a, a + COLUMNS])
        matrix = np.zeros((n, min(COLUMNS, int(column[-1]) + 1 - a)), np.float32)
        matrix[row[lo:hi], column[lo:hi] - a] = 1
        out += matrix @ matrix.T
    return out


def compare(words: int, similarity: float):
    """Cells (component, lo, hi, block, id, tag, n, text), sorted by cell, to each member's links and root there."""

    def cell(rows: list[tuple]) -> Iterator[tuple[int, int, int]]:
        z = zstandard.ZstdDecompressor()
        rows = sorted({r[1:3]: r for r in rows}.values(), key=lambda r: r[1:3])
        block, ids, weight = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.int64), np.array([r[3] for r in rows], np.int64)
        values, cuts = grams([plain(z.decompress(r[4])) for r in rows], words)
        size = np.diff(cuts)
        shared = overlaps(values, cuts)
        linked = shared / np.maximum(1, size[:, None] + size[None, :] - shared) >= similarity
        if block.min() != block.max():
            linked &= block[:, None] != block[None, :]
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))  # of the texts of each id
        linked = np.logical_or.reduceat(linked, first, axis=0)
        linked[np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ids)))), np.arange(len(ids))] = False
        links = linked @ weight
        linked = np.logical_or.reduceat(linked, first, axis=1)
        nodes, root = ids[first], np.arange(len(first))
        for start in range(len(nodes)):  # the smallest id of a part reaches it first
            if root[start] == start and linked[start].any():
                front = [start]
                while front:
                    x = front.pop()
                    for y in np.flatnonzero(linked[x]).tolist():
                        if root[y] == y and y != start:
                            root[y] = start
                            front.append(y)
        return zip(nodes.tolist(), links.tolist(), nodes[root].tolist(), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []
        names, kinds = ["id", "links", "root"], [pa.int64()] * 3
        for batch in batches:
            for comp, lo, hi, *row, text in zip(*(c.to_pylist() for c in batch.columns[:-1]), batch.column(7), strict=True):
                if (comp, lo, hi) != now:
                    if held:
                        out.extend(cell(held))
                    now, held = (comp, lo, hi), []
                held.append((*row, text.as_py()))
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                out = []
        if held:
            out.extend(cell(held))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return run


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """One row per input row: id, class_id, n_links, and tag (the hash of its text).

    Two documents are linked when the Jaccard similarity of their sets of ``words``-word n-grams is
    at least ``similarity``; words are lower-cased, and ASCII punctuation and white space separate
    them. class_id is the smallest id of a connected class; n_links counts all other rows that are
    linked, equal texts included. A text of fewer words is one n-gram. Texts without words, null
    texts, and rows with a null id have no links and are their own class. Rows that share an id with
    different texts count as one node, which is linked as any of its texts is. Pairs just at the
    similarity are linked. Texts of any length are compared whole. An empty table gives no rows; other
    columns are ignored whatever their names.
    """
    bands = bands_for(similarity, rows, recall)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text_of(text_col)).alias("tag"), text_of(text_col).cast("binary").alias("text"))
    sigs = written(texts.mapInArrow(frugal(signatures(words, rows, bands)), "id long, tag long, digest binary, size long, bands array<long>"))
    some = sigs.filter("size > 0 and id is not null")
    reps = written(some.groupBy("digest").agg(F.min(F.struct("id", "tag")).alias("rep"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("bands").alias("bands")).select("digest", "rep.id", "rep.tag", "n", "size", "bands"))

    keys = reps.select("id", F.explode("bands").alias("band"))
    heads = keys.groupBy("band").agg(F.min("id").alias("head"), F.max("id").alias("last")).filter("head <> last").select("band", "head")
    groups = components(keys.join(heads, "band").select(F.col("id").alias("u"), F.col("head").alias("v")))

    members = reps.join(groups, F.col("id") == F.col("node")).select(F.col("root").alias("comp"), "id", "tag", "n", "size")
    sizes = members.groupBy("comp").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_DOCS), F.ceil(F.sum("size") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    blocked = members.join(sizes, "comp").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    small = texts.filter("id is not null").mapInArrow(frugal(squeeze), "doc long, tag long, text binary").withColumnRenamed("doc", "id")
    fetched = small.join(blocked, ["id", "tag"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = fetched.select("comp", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "id", "tag", "n", "text")
    dealt = cells.repartition("comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi")
    found = written(dealt.mapInArrow(frugal(compare(words, similarity)), "id long, links long, root long").filter("links > 0"))

    roots = components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    verdict = reps.select("digest", "id", "n").join(links, "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left")
    by_digest = verdict.select("digest", F.coalesce("root", "id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    own = sigs.select("id", "tag", F.when((F.col("size") > 0) & F.col("id").isNotNull(), F.col("digest")).alias("digest"))
    out = own.filter("digest is not null").join(by_digest, "digest").select("id", "class_id", "n_links", "tag")
    alone = own.filter("digest is null").select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "tag")
    return out.unionAll(alone).withColumnRenamed("id", id_col)


def similar_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class, that with the class's id, with all its columns, whatever those are called. Rows with a null id stay."""
    groups = similar_groups(docs, id_col, text_col, **options).select(F.col(id_col).alias("id"), "tag", "class_id").filter("id = class_id")
    least = groups.groupBy("id").agg(F.min("tag").alias("tag"))  # rows of one id and one class may have several texts
    stay = written(groups.join(least, ["id", "tag"], "left_semi").groupBy("id", "tag").agg(F.count(F.lit(1)).alias("n_rows")))
    out = kept_rows(docs, stay, {"id": F.col(f"`{id_col}`").cast("long"), "tag": F.xxhash64(text_of(text_col))})
    return out.unionByName(docs.filter(F.col(f"`{id_col}`").isNull()))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links")


#: All pairs that share an n-gram, without banding; classes by the least id that is reached.
ORACLE_SQL = r"""
with recursive t as (
  select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x09-\x0D\x20-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]+') as words from documents
),
g as (
  select distinct doc_id, hash(list_slice(words, i, i + 4)) as gram from t, unnest(range(1, greatest(len(words) - 4, 1) + 1)) r(i) where len(words) > 0
),
n as (select doc_id, count(*) as n from g group by doc_id),
pair as (select a.doc_id as a, b.doc_id as b, count(*) as shared from g a join g b on a.gram = b.gram and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
link as (
  select a, b from pair join n x on x.doc_id = a join n y on y.doc_id = b where shared / (x.n + y.n - shared) >= 0.8
),
reach(a, b) as (select a, b from link union select reach.a, link.b from reach join link on reach.b = link.a),
links as (select a, count(*) as n from link group by a),
least_id as (select a, min(b) as least from reach group by a)
select doc_id, least(doc_id, coalesce(least, doc_id)) as class_id, cast(coalesce(links.n, 0) as bigint) as n_links
from t left join links on links.a = doc_id left join least_id on least_id.a = doc_id
"""
