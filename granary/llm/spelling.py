"""Words and their spelling: a Kneser-Ney model of folded characters, and the hashes of words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import frugal
from granary.llm.superwindows import hashes, mixed

ALPHABET = 80  # symbols at most: the spelling has ALPHABET ** 3 entries
CHUNK = 1 << 23  # characters that are counted at once
SPAN = 1 << 18  # characters that are split and spelled at once
WORDS = 10  # words without repeats that every text is given for its share of repeated words

START, OTHER, LETTER, UPPER, DIGIT, SPACE, BREAK = range(7)
SIGNS = ".,;:!?'\"-()|/@#$%&*=+_<>[]{}\\^~`"
FOLDED = "abcdefghijklmnopqrstuvwxyzßàáâäæçèéêëìíîïñòóôöùúûü"


def symbols() -> np.ndarray:
    """The symbol of each code point below 0x250; the last entry is for all others."""
    out = np.full(0x251, LETTER, np.uint32)
    for c in range(0x250):
        ch = chr(c)
        out[c] = UPPER if ch.isupper() else DIGIT if ch.isdigit() else LETTER if ch.isalpha() else BREAK if ch in "\r\n" else SPACE if ch.isspace() else OTHER
    free = 7
    for ch in FOLDED:
        out[ord(ch)] = free
        free += 1
    for ch in SIGNS:
        if free < ALPHABET:
            out[ord(ch)] = free
            free += 1
    return out


def words_of(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The words of all texts in one list, each text closed by an empty word, and the words in each."""
    flat: list[str] = []
    counts = []
    for t in texts:
        own = (t.replace("\ufffe", " ") if "\ufffe" in t else t).split()
        flat += own
        flat.append("")
        counts.append(len(own) + 1)
    return flat, np.array(counts, np.int64)


def coded(flat: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, and each word's start there and its length. Every word follows two starts, and the start behind it is its end."""
    codes = np.frombuffer(("\ufffe\ufffe" + "\ufffe\ufffe".join(flat) + "\ufffe").encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, flat), np.int64, len(flat))
    return codes, np.cumsum(lengths + 2) - lengths, lengths


def trigrams(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The character trigram that ends at each code."""
    s = table[np.minimum(codes, 0x250)]
    s[codes == 0xFFFE] = START
    number = np.zeros(len(s), np.uint32)
    number[2:] = (s[:-2] * np.uint32(ALPHABET) + s[1:-1]) * np.uint32(ALPHABET) + s[2:]
    return number


def spelling_costs(starts: np.ndarray, lengths: np.ndarray, number: np.ndarray, cost: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(cost[number], dtype=np.float64)])
    return total[starts + lengths + 1] - total[starts]


def spans(texts: list[str]) -> Iterator[list[str]]:
    """The texts in runs of about SPAN characters, whose arrays stay small."""
    at, size = 0, 0
    for i, t in enumerate(texts, 1):
        size += len(t)
        if size >= SPAN or i == len(texts):
            yield texts[at:i]
            at, size = i, 0


def hash_words(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return mixed(hashes(codes, starts, starts + lengths))


def repeats(own: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each text's share of words that equal the word before them, from the hashes of its words."""
    first = np.cumsum(counts) - counts
    same = np.zeros(len(own), np.int64)
    same[1:] = own[1:] == own[:-1]
    same[first] = 0
    return np.add.reduceat(same, first) / (counts - 1 + WORDS)


def chunked(batches: Iterator[pa.RecordBatch], column: int, squeezed: bool, most: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    z = zstandard.ZstdDecompressor()
    for batch in batches:
        at, size = 0, 0
        texts: list[str] = []
        for i in range(batch.num_rows):
            raw = batch.column(column)[i].as_py()
            texts.append((z.decompress(raw) if squeezed else raw).decode("utf-8", "replace"))
            size += len(texts[-1])
            if size >= most:
                yield batch.slice(at, i + 1 - at), texts
                at, size, texts = i + 1, 0, []
        if texts:
            yield batch.slice(at), texts


def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([z.compress(t.as_py()) for t in batch.column(1)], pa.binary())], names=["id", "text"])


def count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, table = np.zeros(ALPHABET**3, np.int64), symbols()
    for _, texts in chunked(batches, 0, True, CHUNK):
        for some in spans(texts):
            codes, starts, _ = coded(words_of(some)[0])
            number = trigrams(codes, table)
            event = np.ones(len(number), bool)
            event[:2] = event[starts - 1] = False
            total += np.bincount(number[event], minlength=len(total))
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], names=["gram", "n"])


def discounts(counts: DataFrame) -> list[float]:
    """The three discounts of modified Kneser-Ney, from the counts of counts 1 to 4."""
    row = counts.agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5)]).first()
    n1, n2, n3, n4 = (float(row[i] or 0) for i in range(4))
    if not (n1 and n2):
        return [0.5, 0.75, 0.9]
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.1), i + 0.9) for i, d in enumerate(raw)]


def discounted(counts: DataFrame, context: Column) -> tuple[DataFrame, DataFrame]:
    """Joins n-gram counts with the totals of their contexts: each n-gram's own share, and each context's share for the order below."""
    d = discounts(counts)
    cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
    keyed = counts.withColumn("context", context)
    totals = keyed.groupBy("context").agg(F.sum("n").alias("total"), F.sum(cut).alias("cut"))
    own = keyed.join(totals, "context").select("gram", ((F.col("n") - cut) / F.col("total")).alias("p"))
    return own, totals.select(F.col("context").alias("gram"), (F.col("cut") / F.col("total")).alias("p"))


def dense(rows: DataFrame, size: int, otherwise: float) -> np.ndarray:
    """A table by n-gram number; at most ``size`` rows reach the driver."""
    out = np.full(size, otherwise)
    table = rows.select("gram", "p").toArrow()
    out[table["gram"].to_numpy()] = table["p"].to_numpy()
    return out


def spelling(trusted: DataFrame) -> np.ndarray:
    """Negative log probability of every character trigram, from texts (squeezed, in the only column)."""
    a = ALPHABET
    counts = trusted.mapInArrow(frugal(count_trigrams), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).persist()
    two = counts.groupBy((F.col("gram") % (a * a)).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    one = two.groupBy((F.col("gram") % a).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
    p = np.full(a, 1.0 / a)
    for order, table in enumerate((one, two, counts), 1):
        own, rest = discounted(table, F.floor(F.col("gram") / a))
        lower = np.tile(p, a) if order > 1 else p
        weight = dense(rest, max(1, a ** (order - 1)), 1.0)
        p = dense(own, a**order, 0.0) + np.repeat(weight, a) * lower
    counts.unpersist()
    return -np.log(p).astype(np.float32)
