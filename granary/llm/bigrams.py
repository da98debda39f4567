"""Interpolated modified Kneser-Ney over word bigrams, counted, joined and looked up in shards.

Words are 64-bit hashes. Numbers travel as packed bodies: sorted columns whose differences compress.

Counting: tasks send the distinct bigrams of a chunk to the shard of the first word, whose range of
hashes that is. A shard adds them up; it then knows everything about its contexts, and tells the shard
of each second word how many contexts the word follows. Joining: that shard gets the word's own
probability from it and answers; the first shard combines it with the bigram's counts into the
bigram's gain. Looking up: gains are dealt by a hash of the n-gram. Chunks of documents ask each of
those shards for their n-grams and get sums per document back. The most frequent n-grams, in a table
of fixed size, are answered where they are asked, so no shard gets one question a document for them.
"""

from __future__ import annotations

import hashlib
import math
import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import discard, frugal, partitions_for, text_of, written
from granary.llm.spelling import chunked, coded, hash_words, repeats, spans, spelling_costs, symbols, trigrams, words_of
from granary.llm.superwindows import BASE, mixed

PASSES = 2  # shards are asked in so many parts one after the other, which divides the disk that shuffles hold
JOINED = 4  # and joined in so many
CHUNK = 1 << 23  # characters whose bigrams are counted at once
ASKED_CHUNK = 1 << 22  # characters whose n-grams are looked up at once
SHARD = 64 << 20  # bytes of text whose n-grams a shard is planned for
HOT = 1 << 19  # words, and bigrams, at most that are answered from a table beside the join
FINGERPRINT = 48  # bits that tell n-grams of a shard apart: with a million there, one in 10**8 unknown n-grams is mistaken; shards do not grow with the input
LEVELS = 512  # of counts, eight for each doubling
BEGIN = 0x5851F42D4C957F2D  # stands for a word before the text

PAIRS, TYPES, SPELLED, WORD, LOWER, VALUE, HEADER, ASKED, TALLY = range(9)
PACKED_TYPE = "bucket int, kind int, source int, n long, body binary"
PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("source", pa.int32()), ("n", pa.int64()), ("body", pa.binary())])
SENT = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), ("body", pa.binary())])
ANSWERS = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("body", pa.binary())])

Batches = Iterator[pa.RecordBatch]
Row = tuple[int, int, int, int, bytes]


def shrink(values: np.ndarray) -> bytes:
    """Numbers byte by byte, so that equal high bytes compress."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes())


def grow(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, len(flat) // size).T).reshape(-1).view(kind)


def shrink_sorted(values: np.ndarray) -> bytes:
    return shrink(np.diff(values, prepend=np.uint64(0)))


def grow_sorted(raw: bytes) -> np.ndarray:
    return np.cumsum(grow(raw, np.uint64), dtype=np.uint64)


def bundle(*parts: bytes) -> bytes:
    return struct.pack(f"<{len(parts) + 1}I", len(parts), *map(len, parts)) + b"".join(parts)


def unbundle(raw: bytes) -> list[bytes]:
    n = struct.unpack_from("<I", raw)[0]
    stops = np.cumsum(struct.unpack_from(f"<{n}I", raw, 4)) + 4 * (n + 1)
    return [raw[a:b] for a, b in zip([4 * (n + 1), *stops], stops, strict=False)]


def gram_hashes(words: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of n-grams, whose words are given place by place."""
    out = np.full(len(words[0]), len(words), np.uint64)
    for w in words:
        out = mixed(out * np.uint64(BASE) + w)
    return out


def level_of(n: np.ndarray) -> np.ndarray:
    return np.minimum(LEVELS - 1, np.floor(np.log2(n) * 8)).astype(np.int64)


def dropped_bits(shards: int) -> np.uint64:
    """Low bits of a hash that gains and questions leave out: FINGERPRINT bits tell the n-grams of a shard apart."""
    return np.uint64(max(0, 64 - FINGERPRINT - math.ceil(math.log2(shards))))


def shard_of(values: np.ndarray, shards: int, dropped: int = 0) -> np.ndarray:
    """Shards are ranges of hashes, which may lack their low bits."""
    return (((values << np.uint64(dropped)) >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def by_shard(values: np.ndarray, shards: int, dropped: int = 0) -> Iterator[tuple[int, int, int]]:
    """Of sorted hashes, each shard that has some, and where they begin and end."""
    own = shard_of(values, shards, dropped)
    if not len(own):
        return
    heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(own)], strict=True):
        yield int(own[a]), a, b


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def sent(rows: Iterator[Row], most: int = 8 << 20) -> Batches:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[4])
        if size >= most:
            yield batch_of(held, PACKED)
            held, size = [], 0
    if held:
        yield batch_of(held, PACKED)


def read(batches: Batches) -> Iterator[Row]:
    for batch in batches:
        for *row, body in zip(*(c.to_pylist() for c in batch.columns[:4]), batch.column(4), strict=True):
            yield *row, body.as_py()


def pack_pairs(first: np.ndarray, second: np.ndarray, n: np.ndarray) -> bytes:
    """Distinct bigrams sorted by first word."""
    heads = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
    return bundle(shrink_sorted(first[heads]), shrink(np.diff(np.append(heads, len(first))).astype(np.uint32)), shrink(second), shrink(n.astype(np.uint32)))


def unpack_pairs(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first, each, second, n = unbundle(body)
    return np.repeat(grow_sorted(first), grow(each, np.uint32)), grow(second, np.uint64), grow(n, np.uint32).astype(np.int64)


def added(first: np.ndarray, second: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct bigrams, sorted, with their counts added up."""
    by = np.lexsort((second, first))
    first, second, n = first[by], second[by], n[by]
    heads = np.flatnonzero(np.append(True, (first[1:] != first[:-1]) | (second[1:] != second[:-1]))[: len(first)])
    return first[heads], second[heads], np.add.reduceat(n, heads) if len(heads) else n


def tallies(kind: int, start: int, counts: np.ndarray) -> Iterator[Row]:
    for i in np.flatnonzero(counts).tolist():
        yield start + i, TALLY, kind, int(counts[i]), b""


def count(cost: np.ndarray, shards: int):
    """Texts (squeezed, in the only column) to the bigrams of each chunk, and its words with their spelling costs."""

    def rows(batches: Batches) -> Iterator[Row]:
        table = symbols()
        for _, texts in chunked(batches, 0, True, CHUNK):
            firsts, seconds, words, prices = [], [], [], []
            for some in spans(texts):
                flat, counts = words_of(some)
                codes, starts, lengths = coded(flat)
                own = hash_words(codes, starts, lengths)
                before = np.empty_like(own)
                before[1:] = own[:-1]
                before[np.cumsum(counts) - counts] = BEGIN
                firsts.append(before)
                seconds.append(own)
                word, at = np.unique(own, return_index=True)
                words.append(word)
                prices.append(spelling_costs(starts, lengths, trigrams(codes, table), cost)[at].astype(np.float32))
            first, second, n = added(np.concatenate(firsts), np.concatenate(seconds), np.ones(sum(map(len, firsts)), np.int64))
            for shard, a, b in by_shard(first, shards):
                yield shard, PAIRS, 0, 0, pack_pairs(first[a:b], second[a:b], n[a:b])
            word, at = np.unique(np.concatenate(words), return_index=True)
            price = np.concatenate(prices)[at]
            for shard, a, b in by_shard(word, shards):
                yield shard, SPELLED, 0, 0, bundle(shrink_sorted(word[a:b]), shrink(price[a:b]))

    return lambda batches: sent(rows(batches))


def merge(shards: int):
    """A shard's bigrams and spelled words added up; each second word's contexts for the word's shard; counts of counts."""

    def rows(batches: Batches) -> Iterator[Row]:
        pairs, words, own = [], [], 0
        for bucket, kind, _, _, body in read(batches):
            own = bucket
            if kind == PAIRS:
                pairs.append(unpack_pairs(body))
            else:
                word, price = unbundle(body)
                words.append((grow_sorted(word), grow(price, np.float32)))
        if words:
            word, at = np.unique(np.concatenate([w for w, _ in words]), return_index=True)
            yield own, SPELLED, own, 0, bundle(shrink_sorted(word), shrink(np.concatenate([p for _, p in words])[at]))
        if not pairs:
            return
        first, second, n = added(*(np.concatenate(c) for c in zip(*pairs, strict=True)))
        del pairs, words
        yield own, PAIRS, own, 0, pack_pairs(first, second, n)
        yield from tallies(PAIRS, 0, np.bincount(n[n < 5], minlength=5))
        yield from tallies(PAIRS, 8, np.bincount(level_of(n), minlength=LEVELS))
        by = np.argsort(second)
        second, n = second[by], n[by]
        heads = np.flatnonzero(np.append(True, second[1:] != second[:-1]))
        types, total, second = np.diff(np.append(heads, len(second))), np.add.reduceat(n, heads), second[heads]
        for shard, a, b in by_shard(second, shards):
            yield shard, TYPES, own, 0, bundle(shrink_sorted(second[a:b]), shrink(types[a:b].astype(np.uint32)), shrink(total[a:b]))

    return lambda batches: sent(rows(batches))


def words_known(batches: Batches) -> Batches:
    """A shard's words: contexts they follow, occurrences, spelling cost; and counts of these."""

    def rows() -> Iterator[Row]:
        asked, priced, own = [], [], 0
        for bucket, kind, _, _, body in read(batches):
            own = bucket
            if kind == TYPES:
                word, types, total = unbundle(body)
                asked.append((grow_sorted(word), grow(types, np.uint32).astype(np.int64), grow(total, np.int64)))
            else:
                word, price = unbundle(body)
                priced.append((grow_sorted(word), grow(price, np.float32)))
        if not asked:
            return
        word, at = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
        types, total = (np.bincount(at, np.concatenate([a[i] for a in asked]), len(word)).astype(np.int64) for i in (1, 2))
        names, price = priced[0]
        yield own, WORD, own, 0, bundle(shrink_sorted(word), shrink(types), shrink(price[np.searchsorted(names, word)]), shrink(total))
        yield from tallies(WORD, 0, np.bincount(types[types < 5], minlength=5))
        yield from tallies(WORD, 5, np.array([types.sum(), (types >= 3).sum()]))
        yield from tallies(WORD, 8, np.bincount(level_of(total), minlength=LEVELS))

    return sent(rows())


def packed_gains(grams: np.ndarray, gains: np.ndarray, often: np.ndarray, shards: int) -> Iterator[Row]:
    """Gains by the shard of the n-gram; those of frequent n-grams for shard -1."""
    by = np.argsort(grams)
    grams, gains, often = grams[by], gains[by].astype(np.float32), often[by]
    if often.any():
        yield -1, VALUE, 0, 0, bundle(shrink_sorted(grams[often]), shrink(gains[often]))
    drop = dropped_bits(shards)
    grams, gains = grams[~often] >> drop, gains[~often]
    for shard, a, b in by_shard(grams, shards, int(drop)):
        yield shard, VALUE, 0, 0, bundle(shrink_sorted(grams[a:b]), shrink(gains[a:b]))


def lower(discounts: list[float], total: int, rest: float, hot: int, shards: int):
    """Words with their log probabilities: gains of single words, and an answer to each shard that has the word behind a context."""

    def rows(batches: Batches) -> Iterator[Row]:
        known, asked = None, []
        for bucket, kind, source, _, body in read(batches):
            if kind == WORD:
                known = unbundle(body)
            else:
                asked.append((source, unbundle(body)[0]))
        if known is None:
            return
        word, types, price, n = grow_sorted(known[0]), grow(known[1], np.int64), grow(known[2], np.float32).astype(float), grow(known[3], np.int64)
        p = np.log((types - np.array(discounts)[np.minimum(types, 3) - 1]) / total + np.exp(rest - price))
        yield from packed_gains(gram_hashes([word]), p - rest + price, level_of(n) >= hot, shards)
        for source, body in asked:
            yield source, LOWER, 0, 0, bundle(body, shrink(p[np.searchsorted(word, grow_sorted(body))].astype(np.float32)))

    return lambda batches: sent(rows(batches))


def upper(discounts: list[float], hot_words: int, hot_pairs: int, shards: int):
    """A shard's bigrams with the answers about their second words: gains of bigrams and of contexts."""

    def rows(batches: Batches) -> Iterator[Row]:
        pairs, answers = None, []
        for _, kind, _, _, body in read(batches):
            if kind == PAIRS:
                pairs = body
            else:
                word, p = unbundle(body)
                answers.append((grow_sorted(word), grow(p, np.float32)))
        if pairs is None:
            return
        first, second, n = unpack_pairs(pairs)
        word = np.concatenate([w for w, _ in answers])
        by = np.argsort(word)
        below = np.concatenate([p for _, p in answers])[by][np.searchsorted(word[by], second)].astype(float)
        del answers, word, by
        heads = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
        cut = np.array(discounts)[np.minimum(n, 3) - 1]
        total = np.add.reduceat(n, heads)
        rest = np.log(np.add.reduceat(cut, heads) / total)
        each = np.diff(np.append(heads, len(n)))
        weight = np.repeat(rest, each) + below
        gain = np.log((n - cut) / np.repeat(total, each) + np.exp(weight)) - weight
        yield from packed_gains(gram_hashes([first[heads]]), rest, level_of(total) >= hot_words, shards)
        yield from packed_gains(gram_hashes([first, second]), gain, level_of(n) >= hot_pairs, shards)

    return lambda batches: sent(rows(batches))


def discounts_of(counts: dict[int, int]) -> list[float]:
    """The three discounts of modified Kneser-Ney, from the counts of counts 1 to 4."""
    n1, n2, n3, n4 = (float(counts.get(i, 0)) for i in range(1, 5))
    if not (n1 and n2):
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.1), i + 0.9) for i, d in enumerate(raw)]


def least_hot(counts: dict[int, int]) -> int:
    """The level from which on there are at most HOT n-grams."""
    total, least = 0, LEVELS
    while least > 0 and total + counts.get(7 + least, 0) <= HOT:
        least -= 1
        total += counts.get(8 + least, 0)
    return least


@dataclass
class Model:
    """Spelling costs, tables of packed gains, hashes and gains of frequent n-grams, the log weight of the spelling, and the number of shards."""

    cost: np.ndarray
    gains: list[DataFrame]
    frequent: tuple[np.ndarray, np.ndarray]
    rest: float
    shards: int


def train(trusted: DataFrame, cost: np.ndarray, size: int) -> Model:
    """The model of texts (squeezed, in the only column of a table that ``written`` returned, which is deleted).

    ``size`` is the bytes of all texts that will be scored, which sets the number of shards.
    """
    shards = partitions_for(trusted.sparkSession, size, SHARD)

    def dealt(rows: DataFrame, run: Callable[[Batches], Batches]) -> DataFrame:
        return rows.repartitionById(shards, F.col("bucket")).mapInArrow(frugal(run), PACKED_TYPE)

    def counted(table: DataFrame) -> dict[int, int]:  # at most LEVELS + 8 rows
        return {r.bucket: r.n for r in table.filter(F.col("kind") == TALLY).groupBy("bucket").agg(F.sum("n").alias("n")).collect()}

    def of(table: DataFrame, *kinds: int) -> DataFrame:
        return table.filter(F.col("kind").isin(list(kinds)))

    counts = written(dealt(trusted.mapInArrow(frugal(count(cost, shards)), PACKED_TYPE), merge(shards)))
    discard(trusted)
    words = written(dealt(of(counts, TYPES, SPELLED), words_known))
    tally, word_tally = counted(counts), counted(words)
    d1, d2 = discounts_of(word_tally), discounts_of(tally)
    total, several = word_tally[5], word_tally.get(6, 0)
    rest = math.log((d1[0] * word_tally.get(1, 0) + d1[1] * word_tally.get(2, 0) + d1[2] * several) / total)
    hot_words, hot_pairs = least_hot(word_tally), least_hot(tally)
    joined = written(dealt(of(words, WORD).unionAll(of(counts, TYPES)), lower(d1, total, rest, hot_words, shards)))
    gains = [written(of(joined, VALUE))]
    discard(words)
    for i in range(JOINED):
        part = (F.col("bucket") % JOINED) == i
        gains.append(written(dealt(of(counts, PAIRS).unionAll(of(joined, LOWER)).filter(part), upper(d2, hot_words, hot_pairs, shards))))
    discard(counts, joined)
    found = [unbundle(x.as_py()) for g in gains for x in g.filter("bucket < 0").select("body").toArrow().column(0)]  # at most HOT words, twice, and HOT bigrams
    if not found:
        return Model(cost, gains, (np.zeros(0, np.uint64), np.zeros(0, np.float32)), rest, shards)
    grams, at = np.unique(np.concatenate([grow_sorted(g) for g, _ in found]), return_inverse=True)
    values = np.bincount(at, np.concatenate([grow(v, np.float32) for _, v in found]), len(grams)).astype(np.float32)
    return Model(cost, gains, (grams, values), rest, shards)


class Frequent:
    """Gains of frequent n-grams by direct address: what finds its slot taken goes to the next, smaller table."""

    def __init__(self, grams: np.ndarray, values: np.ndarray) -> None:
        self.tables = []
        while len(grams):
            bits = max(8, len(grams).bit_length())
            slot = self.slot(grams, bits, len(self.tables))
            _, first = np.unique(slot, return_index=True)
            known, value = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.float32)
            known[slot[first]], value[slot[first]] = grams[first], values[first]
            self.tables.append((bits, known, value))
            left = np.ones(len(grams), bool)
            left[first] = False
            grams, values = grams[left], values[left]

    def slot(self, grams: np.ndarray, bits: int, table: int) -> np.ndarray:
        return ((grams * np.uint64(BASE + 2 * table)) >> np.uint64(64 - bits)).view(np.int64)

    def gains(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each n-gram is here, and its gain or 0."""
        hit, out = np.zeros(len(grams), bool), np.zeros(len(grams), np.float32)
        left = None
        for i, (bits, known, value) in enumerate(self.tables):
            own = grams if left is None else grams[left]
            slot = self.slot(own, bits, i)
            same = known.take(slot) == own
            found = np.flatnonzero(same)
            where = found if left is None else left[found]
            hit[where], out[where] = True, value.take(slot[found])
            left = np.flatnonzero(~same) if left is None else left[~same]
        return hit, out


def chunk_key(part: int, at: int, texts: pa.Array) -> int:
    """A number for a chunk that depends on its texts, so that parts of different scans never mix."""
    digest = hashlib.blake2b(f"{part} {at}".encode(), digest_size=8)
    for text in texts:
        digest.update(text.as_buffer())
    return int.from_bytes(digest.digest(), "little", signed=True)


def stream(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return zstandard.ZstdCompressor(level=1).compress(sink.getvalue().to_pybytes())


def ask(cost: np.ndarray, rest: float, shards: int, frequent: tuple[np.ndarray, np.ndarray], low: int, high: int):
    """Texts to packed n-grams for shards from ``low`` to before ``high``.

    If ``low`` is 0, also to a header: the rows' other columns, their costs but for what shards will answer,
    and how many shards are asked in all scans.
    """

    def run(batches: Batches) -> Batches:
        table, often = symbols(), Frequent(*frequent)
        drop = dropped_bits(shards)
        part = TaskContext.get().partitionId()
        for at, (batch, texts) in enumerate(chunked(batches, 0, False, ASKED_CHUNK)):
            chunk = chunk_key(part, at, batch.column(0))
            grams, owners, sizes, bases, shares = [], [], [], [], []
            asks = np.zeros(shards, bool)
            done = 0
            for some in spans(texts):
                flat, counts = words_of(some)
                codes, starts, lengths = coded(flat)
                own = hash_words(codes, starts, lengths)
                heads = np.cumsum(counts) - counts
                if not low:
                    sizes.append(np.add.reduceat(lengths + 1, heads))
                    shares.append(repeats(own, counts))
                    base = np.add.reduceat(spelling_costs(starts, lengths, trigrams(codes, table), cost), heads) - rest * counts
                doc = np.arange(len(counts), dtype=np.uint32)
                each = np.repeat(doc, counts)
                before = np.empty_like(own)
                before[1:] = own[:-1]
                before[heads] = BEGIN
                for words, owner in ([[np.append(own, np.full(len(doc), BEGIN, np.uint64))], np.append(each, doc)], [[before, own], each]):
                    gram = gram_hashes(words)
                    hit, gain = often.gains(gram)
                    if not low:
                        base -= np.bincount(owner[hit], gain[hit], len(doc))
                    gram, owner = gram[~hit] >> drop, owner[~hit] + np.uint32(done)
                    shard = shard_of(gram, shards, int(drop)).astype(np.int64)
                    asks[shard] = True
                    mine = np.flatnonzero((shard >= low) & (shard < high))
                    grams.append(gram[mine])
                    owners.append(owner[mine])
                if not low:
                    bases.append(base)
                done += len(some)
            gram, owner = np.concatenate(grams), np.concatenate(owners)
            grams, owners = [], []
            by = np.lexsort((owner, gram))
            gram, owner = gram[by], owner[by]
            new = np.append(True, gram[1:] != gram[:-1])[: len(gram)]
            pair = new | np.append(True, owner[1:] != owner[:-1])[: len(gram)]
            heads = np.flatnonzero(pair)
            times = np.diff(np.append(heads, len(gram)))
            gram, owner, new = gram[heads], owner[heads], new[heads]
            narrow = np.uint8 if len(texts) <= 256 else np.uint16 if len(texts) <= 65536 else np.uint32
            out = []
            if not low:
                columns = [shrink(np.concatenate(x)) for x in (bases, sizes, shares)]
                out.append((chunk % high, HEADER, chunk, bundle(stream(batch.select(batch.schema.names[1:])), *columns, struct.pack("<I", int(asks.sum())))))
            for shard, lo, hi in by_shard(gram, shards, int(drop)):
                own = np.flatnonzero(new[lo:hi])
                each = np.diff(np.append(own, hi - lo))
                out.append((shard, ASKED, chunk, bundle(shrink_sorted(gram[lo:hi][own]), shrink(each.astype(np.uint32)), shrink(owner[lo:hi].astype(narrow)), shrink(times[lo:hi].astype(np.uint32)), bytes([np.dtype(narrow).itemsize]))))
            if out:
                yield batch_of(out, SENT)

    return run


def answer(batches: Batches) -> Batches:
    """In a shard, its gains come first; then every chunk's n-grams give sums per document."""
    now, grams, values, held = None, np.zeros(0, np.uint64), np.zeros(0), []
    for batch in batches:
        out = []
        for bucket, kind, chunk, body in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
            body = body.as_py()
            if bucket != now:
                now, held, grams, values = bucket, [], np.zeros(0, np.uint64), np.zeros(0)
            if kind == VALUE:
                held.append(body)
                continue
            if held:
                pairs = [unbundle(x) for x in held]
                grams, at = np.unique(np.concatenate([grow_sorted(g) for g, _ in pairs]), return_inverse=True)
                values = np.bincount(at, np.concatenate([grow(v, np.float32) for _, v in pairs]), len(grams))
                held, pairs, at = [], [], None
            if kind == HEADER:
                out.append((chunk, 0, body))
                continue
            asked, each, owner, times, size = unbundle(body)
            asked = grow_sorted(asked)
            total = np.zeros(0)
            if len(grams):
                at = np.minimum(np.searchsorted(grams, asked), len(grams) - 1)
                gain = np.where(grams[at] == asked, values[at], 0.0)
                owner = grow(owner, {1: np.uint8, 2: np.uint16, 4: np.uint32}[size[0]])
                total = np.bincount(owner, np.repeat(gain, grow(each, np.uint32)) * grow(times, np.uint32))
            some = np.flatnonzero(total)
            out.append((chunk, 1, bundle(shrink(some.astype(np.uint32)), shrink(total[some].astype(np.float32)))))
        if out:
            yield batch_of(out, ANSWERS)


def tally(batches: Batches) -> Batches:
    """Rows sorted by chunk and kind: a header, then sums. Returns the header's rows with symbols, cost and share of repeats."""
    now, head, base, size, share, due = None, None, np.zeros(0), np.zeros(0), np.zeros(0), 0
    changed = "a second scan returned other rows than the first; write the documents to a table before scoring"

    def done() -> pa.RecordBatch:
        if due:
            raise RuntimeError(changed)
        return pa.RecordBatch.from_arrays([*head.columns, pa.array(size.astype(np.int64)), pa.array(base), pa.array(share)], names=[*head.schema.names, "n_symbols", "cost", "repeated"])

    for batch in batches:
        for chunk, kind, body in zip(*(c.to_pylist() for c in batch.columns[:2]), batch.column(2), strict=True):
            body = body.as_py()
            if kind == 0:
                if now is not None:
                    yield done()
                rows, base, size, share, asked = unbundle(body)
                head = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(rows)).read_next_batch()
                now, base, size, share, due = chunk, grow(base, np.float64).copy(), grow(size, np.int64), grow(share, np.float64), struct.unpack("<I", asked)[0]
            else:
                if chunk != now:
                    raise RuntimeError(changed)
                which, total = unbundle(body)
                np.subtract.at(base, grow(which, np.uint32), grow(total, np.float32))
                due -= 1
    if now is not None:
        yield done()


def costs(docs: DataFrame, model: Model, keep: list[Column], text_col: str) -> DataFrame:
    """``keep`` with each text's symbols, its negative log probability and its share of repeated words.

    ``docs`` is scanned once for each pass. Chunks are known by their texts, so a scan that returns other rows
    than the one before, as a frame without an order may after a lost executor, is an error and not a wrong
    sum; tables and files always return the same. The model's gains are deleted at the end.
    """
    rows = docs.select(text_of(text_col).cast("binary").alias("the text"), *keep)
    schema = rows.drop("the text").schema.add("n_symbols", "long").add("cost", "double").add("repeated", "double")
    known = reduce(DataFrame.unionAll, model.gains).filter("bucket >= 0").select("bucket", "kind", F.lit(0).cast("long").alias("chunk"), "body")
    sums = []
    for i in range(PASSES):
        low, high = model.shards * i // PASSES, model.shards * (i + 1) // PASSES
        if low == high:
            continue
        asked = rows.mapInArrow(frugal(ask(model.cost, model.rest, model.shards, model.frequent, low, high)), "bucket int, kind int, chunk long, body binary")
        met = known.filter((F.col("bucket") >= low) & (F.col("bucket") < high)).unionAll(asked).repartitionById(model.shards, F.col("bucket")).sortWithinPartitions("bucket", "kind")
        sums.append(written(met.mapInArrow(frugal(answer), "chunk long, kind int, body binary")))
    discard(*model.gains)
    out = written(reduce(DataFrame.unionAll, sums).repartition(model.shards, "chunk").sortWithinPartitions("chunk", "kind").mapInArrow(frugal(tally), schema))
    discard(*sums)
    return out
