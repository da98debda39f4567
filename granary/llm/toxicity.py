"""Toxicity of texts after noisy-channel deobfuscation.

A text is a lattice of characters. A letter stands for itself, a run of one letter for one or two of
it; a sign or digit stands for letters it resembles, for nothing, or for the end of a word; a space
ends a word or is dropped at a price. Viterbi decoding under a character model of all documents finds
the cheapest reading. Restored words are scored by a logistic regression.

A score depends only on the words that the regression weighs. So a part of a text is decoded where its
letters, in one of four coarse readings (digits and signs each as letters or as nothing), spell such a
word with toxic weight, wherever its spaces are; the rest of the text cannot change the score.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from granary.llm.common import discard, frugal, text_of, written

KNOWN = 20_000  # most words of the labelled rows that the channel knows as words, beside the candidates
LEAST_DOCS = 3  # labelled documents that such a word is in, at least
EVIDENCE = 15.1  # of the likelihood ratio test that a word and the label are related: one unrelated word in ten thousand passes
EFFECT = 3.0  # log odds of the label that such a word shifts at least, up or down
PENALTIES = (0.01, 0.1, 1.0, 10.0)  # of how far weights are from the words' own log odds; cross-validation inside the training rows chooses
PARTS = 3  # of that cross-validation
FOLDS = 5  # rows whose crc32 of the id is a multiple of this are held out

# Letters that a character may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou", "#": "h", "&": "a", "%": "o",
}
SWAP, DROP, STAR = 0.7, 0.7, 1.6  # costs of reading a character as a letter, of dropping it, of a wild card
DIGIT = 1.7  # what dropping a digit costs beyond that
JOIN = 2.5  # cost of dropping white space
KEEP_DOUBLE, HALVE, COLLAPSE = 0.0, 1.5, 0.3  # costs of reading a run of a letter as two, two as one, more as one
WORD = re.compile(r"[^\W\d_]+")
SIGNS = re.compile(r"[0-9@$!|+(<*#&%]")

LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâäæçèéêëìíîïñòóôöùúûü"
EDGE, OTHER = 0, 1  # the symbols of a word's edge and of all other letters
SYMBOL = {c: i + 2 for i, c in enumerate(LETTERS)}
SIZE = len(LETTERS) + 2
ORDER = 4  # symbols of the character model
CHUNK = 2 << 20  # characters that are counted at once
BUFFER = 1 << 20  # bytes of text whose coarse readings are searched at once


def symbols() -> np.ndarray:
    """The symbol of each code point below 0x250; the last entry is for all others."""
    out = np.full(0x251, OTHER, np.uint32)
    for c in range(0x250):
        ch = chr(c)
        out[c] = SYMBOL.get(ch.lower(), OTHER) if ch.isalpha() else EDGE
    return out


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of symbol n-grams inside the words of all texts (the only column)."""
    table, total = symbols(), np.zeros(SIZE**ORDER, np.int64)
    held, size = [], 0

    def add() -> None:
        codes = np.frombuffer(("\n" * (ORDER - 1) + ("\n" * (ORDER - 1)).join(held) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        s = table[np.minimum(codes, 0x250)]
        s = s[np.append(True, (s[1:] != EDGE) | (s[:-1] != EDGE))]  # one edge between words
        at = np.flatnonzero(s == EDGE)
        s = np.insert(s, np.repeat(at, ORDER - 2), EDGE)  # as many as a context holds
        number = np.zeros(len(s) - ORDER + 1, np.uint32)
        for i in range(ORDER):
            number = number * np.uint32(SIZE) + s[i : len(s) - ORDER + 1 + i]
        number = number[(s[ORDER - 1 :] != EDGE) | (s[ORDER - 2 : -1] != EDGE)]
        np.add(total, np.bincount(number, minlength=len(total)), out=total)

    for batch in batches:
        for text in batch.column(0):
            held.append(text.as_py().decode("utf-8", "replace"))
            size += len(held[-1])
            if size >= CHUNK:
                add()
                held, size = [], 0
    if held:
        add()
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], names=["gram", "n"])


class CharacterModel:
    """Interpolated character n-grams (Witten-Bell) as costs, that is negative log probabilities."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray) -> None:
        p = np.full(SIZE, 1.0 / SIZE)
        for order in range(1, ORDER + 1):
            table = np.bincount(grams % SIZE**order, counts, SIZE**order).reshape(-1, SIZE)
            kinds = np.maximum(1, (table > 0).sum(axis=1, keepdims=True))
            lower = np.tile(p.reshape(-1, SIZE), (len(table) // (len(p) // SIZE), 1))
            p = ((table + kinds * lower) / (table.sum(axis=1, keepdims=True) + kinds)).reshape(-1)
        self.costs = (-np.log(p)).astype(np.float16)

    @staticmethod
    def of_words(words: dict[str, int]) -> CharacterModel:
        """A model of words with their counts."""
        grams, counts = [], []
        for word, n in words.items():
            s = [EDGE] * (ORDER - 1) + [SYMBOL.get(c, OTHER) for c in word] + [EDGE]
            for i in range(len(s) - ORDER + 1):
                grams.append(int(sum(x * SIZE ** (ORDER - 1 - j) for j, x in enumerate(s[i : i + ORDER]))))
                counts.append(n)
        return CharacterModel(np.array(grams, np.int64), np.array(counts, float))

    def cost(self, context: int, symbol: int) -> float:
        return float(self.costs[context * SIZE + symbol])


def arcs(text: str, i: int) -> list[tuple[int, str, float]]:
    """From a place in a lower-case text: next place, what is read, cost. A space is the end of a word."""
    ch = text[i]
    if ch.isalpha():
        stop = i + 1
        while stop < len(text) and text[stop] == ch:
            stop += 1
        if stop - i == 1:
            return [(stop, ch, 0.0)]
        if stop - i == 2:
            return [(stop, ch + ch, KEEP_DOUBLE), (stop, ch, HALVE)]
        return [(stop, ch, COLLAPSE), (stop, ch + ch, COLLAPSE + 0.5)]
    if ch.isspace():
        stop = i + 1
        while stop < len(text) and text[stop].isspace():
            stop += 1
        return [(stop, " ", 0.0), (stop, "", JOIN)]
    out = [(i + 1, letter, STAR if ch == "*" else SWAP) for letter in LEET.get(ch, "")]
    less = DROP + DIGIT * ch.isdigit()
    return [*out, (i + 1, "", less), (i + 1, " ", less if out else 0.0)]


class WordModel:
    """A trie of known words with their costs; all other words have those of their characters."""

    def __init__(self, counts: dict[str, int], characters: CharacterModel) -> None:
        self.characters = characters
        self.next: list[dict[str, int]] = [{}]
        self.context, self.spelled, self.whole = [0], [0.0], [math.inf]
        total = sum(counts.values()) or 1
        keep = SIZE ** (ORDER - 2)
        for word, n in counts.items():
            node = 0
            for ch in word:
                to = self.next[node].get(ch)
                if to is None:
                    s = SYMBOL.get(ch, OTHER)
                    to = self.next[node][ch] = len(self.next)
                    self.next.append({})
                    self.spelled.append(self.spelled[node] + characters.cost(self.context[node], s))
                    self.context.append(self.context[node] % keep * SIZE + s)
                    self.whole.append(math.inf)
                node = to
            self.whole[node] = -math.log(n / total / 2)  # half of all words are known ones

    def end(self, context: int, node: int) -> float:
        """Cost of ending a word, beyond that of its characters so far."""
        spelled = self.characters.cost(context, EDGE) + math.log(2)
        return min(spelled, self.whole[node] - self.spelled[node]) if node > 0 else spelled


def decode(text: str, words: WordModel) -> str:
    """The cheapest reading of a lower-case text: the best path through its lattice under the model."""
    keep = SIZE ** (ORDER - 2)
    best: list[dict[tuple[int, int], tuple]] = [{} for _ in range(len(text) + 1)]
    best[0][0, 0] = (0.0, 0, (0, 0), "")  # by context and place in the trie: cost, place and state before, what was read
    for i in range(len(text)):
        if not best[i]:
            continue
        ways = arcs(text, i)
        for state, (cost, *_) in best[i].items():
            for stop, read, price in ways:
                now, (to, node) = cost + price, state
                for ch in read:
                    if ch != " ":
                        s = SYMBOL.get(ch, OTHER)
                        now += words.characters.cost(to, s)
                        to = to % keep * SIZE + s
                        node = words.next[node].get(ch, -1) if node >= 0 else -1
                    elif to:
                        now += words.end(to, node)
                        to = node = 0
                old = best[stop].get((to, node))
                if old is None or now < old[0]:
                    best[stop][to, node] = (now, i, state, read)
    ends = [(cost + (words.end(*state) if state[0] else 0.0), state) for state, (cost, *_) in best[-1].items()]
    at, state, out = len(text), min(ends)[1], []
    while at:
        _, at, state, read = best[at][state]
        out.append(read)
    return " ".join("".join(reversed(out)).split())


# Coarse readings: letters that one character may stand for are one class; a class of 0 is left out.
CLASSES = ["il1!|", "o0%", "e3", "a4@&", "s5$", "t7+", "gb689", "z2", "h#", "c(<", "*"]
CLASS = {c: ord(own[0]) for own in CLASSES for c in own} | {c: ord(c) for c in "dfjkmnpqruvwxy"}
BETWEEN = 1  # stands between texts
FOUND = "the words"  # column of the numbers of the candidate words in a text


def coarse(digits: bool, signs: bool) -> np.ndarray:
    """The class of each byte, with digits and signs as letters or as nothing."""
    out = np.zeros(256, np.uint8)
    out[0], out[128:] = BETWEEN, np.arange(128, 256)
    for ch, own in CLASS.items():
        if ch.isalpha() or (digits if ch.isdigit() else signs):
            out[ord(ch)] = own
    return out


PLAIN = coarse(False, False)
READINGS = [coarse(True, True), coarse(True, False), coarse(False, True)]


def squeezed(raw: np.ndarray, table: np.ndarray) -> tuple[str, np.ndarray]:
    """A coarse reading of bytes, runs of a class as one, and the place of each of its characters."""
    own = table[raw]
    at = np.flatnonzero(own)
    own = own[at]
    new = np.append(True, own[1:] != own[:-1])[: len(own)] | (own == BETWEEN)
    return own[new].tobytes().decode("latin-1"), at[new]


def patterns(word: str) -> set[str]:
    """Coarse readings of a word, with any of its vowels as a wild card."""
    forms = [""]
    for ch in word:
        forms = [f + c for f in forms for c in ([ch, "*"] if ch in "aeiou" and len(forms) < 64 else [ch])]
    out = set()
    for f in forms:
        text, _ = squeezed(np.frombuffer(f.encode(), np.uint8), READINGS[0])
        out.add(text)
    return out - {""}


class Restorer:
    """Finds where texts may hold one of the wanted words in disguise, and restores those places."""

    def __init__(self, wanted: set[str], words: WordModel) -> None:
        self.words = words
        self.found: dict[bytes, bytes] = {}
        self.search = ahocorasick.Automaton()
        for word in wanted:
            for p in patterns(word):
                self.search.add_word(p, len(p))
        if len(self.search):
            self.search.make_automaton()

    def region(self, part: bytes) -> bytes:
        """A part of a text restored; equal parts are decoded once a task."""
        new = self.found.get(part)
        if new is None:
            text = part.decode("utf-8", "replace")
            new = part if text.isalpha() and not any(a == b for a, b in zip(text, text[1:], strict=False)) else decode(text, self.words).encode()
            if len(self.found) > 200_000:
                self.found.clear()
            self.found[part] = new
        return new

    def places(self, buffer: bytes, table: np.ndarray) -> set[tuple[int, int]]:
        """Stretches between white space that hold a wanted word in a coarse reading."""
        text, at = squeezed(np.frombuffer(buffer, np.uint8), table)
        out = set()
        for end, n in self.search.iter(text):
            a, b = int(at[end - n + 1]), int(at[end])
            while a and buffer[a - 1] not in b" \t\n\r\x0b\x0c\0":
                a -= 1
            while b < len(buffer) and buffer[b] not in b" \t\n\r\x0b\x0c\0":
                b += 1
            out.add((a, b))
        return out

    def restored(self, texts: list[str]) -> list[str]:
        """Each text in lower case, with disguised words restored."""
        texts = [t.replace("\0", " ").lower() for t in texts]
        if not len(self.search):
            return texts
        out = list(texts)
        for some, tables in (([i for i, t in enumerate(texts) if not SIGNS.search(t)], [PLAIN]), ([i for i, t in enumerate(texts) if SIGNS.search(t)], [PLAIN, *READINGS])):
            buffer = "\0".join(texts[i] for i in some).encode("utf-8", "replace")
            if not buffer:
                continue
            spans: list[list[int]] = []
            for a, b in sorted(set().union(*(self.places(buffer, t) for t in tables))):
                if spans and a < spans[-1][1]:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            pieces, done = [], 0
            for a, b in spans:
                pieces += [buffer[done:a], self.region(buffer[a:b])]
                done = b
            new = b"".join([*pieces, buffer[done:]]).decode("utf-8", "replace").split("\0")
            for i, t in zip(some, new, strict=True):
                out[i] = t
        return out


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


class Bags:
    """Rows as the numbers of the words they hold, each with one more, the intercept's."""

    def __init__(self, words: pa.ListArray, d: int) -> None:
        sizes = np.diff(words.offsets.to_numpy())
        self.n, self.d = len(words), d
        self.row = np.repeat(np.arange(self.n), sizes + 1)
        self.col = np.insert(words.flatten().to_numpy().astype(np.int64), np.cumsum(sizes), d)

    def margins(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def sums(self, v: np.ndarray) -> np.ndarray:
        """For each word the sum of the values of the rows that hold it."""
        return np.bincount(self.col, v[self.row], self.d + 1)

    def solved(self, curve: np.ndarray, shrink: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """Conjugate gradients for a Newton step; the matrix of all pairs of words is never built."""
        scale = self.sums(curve) + shrink
        out, rest = np.zeros(len(goal)), goal.copy()
        way = rest / scale
        size = enough = rest @ way
        for _ in range(2 * len(goal)):
            if size <= 1e-12 * enough:
                break
            turned = self.sums(curve * self.margins(way)) + shrink * way
            far = size / (way @ turned)
            out, rest = out + far * way, rest - far * turned
            before, size = size, rest @ (rest / scale)
            way = rest / scale + size / before * way
        return out


def regression(x: Bags, y: np.ndarray, times: np.ndarray, penalty: float, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression, the intercept last, by Newton's method.

    The penalty is on the squares of what a weight differs from the word's own log odds: toxic texts hold
    several words, so that a penalty on the weights alone would leave too little for a text with one.
    """
    shrink = np.append(np.full(x.d, penalty), 0.0)
    bad, good = times @ y, times @ (1 - y)
    goal = np.log((x.sums(times * y) + 0.5) / (bad + 1)) - np.log((x.sums(times * (1 - y)) + 0.5) / (good + 1))
    goal[-1] = math.log((bad + 0.5) / (good + 0.5))
    w = goal.copy()

    def loss(w: np.ndarray) -> float:
        z = x.margins(w)
        return float(times @ (np.logaddexp(0, z) - y * z) + (shrink * (w - goal) ** 2).sum() / 2)

    now = loss(w)
    for _ in range(steps):
        p = logistic(x.margins(w))
        gradient = x.sums(times * (p - y)) + shrink * (w - goal)
        step = x.solved(times * p * (1 - p), shrink + 1e-6, gradient)
        size = 1.0
        while loss(w - size * step) > now and size > 1e-3:
            size /= 2
        w = w - size * step
        before, now = now, loss(w)
        if before - now < 1e-6 * before:
            break
    return w


def chosen_penalty(x: Bags, y: np.ndarray, times: np.ndarray, fold: np.ndarray) -> float:
    """The penalty whose models lose least on the training rows they were not fitted on."""
    losses = []
    for penalty in PENALTIES:
        loss = 0.0
        for f in range(PARTS):
            own = fold != f
            if own.all() or not own.any():
                continue
            w = regression(x, y, times * own, penalty)
            p = np.clip(logistic(x.margins(w)), 1e-9, 1 - 1e-9)
            loss -= float((times * ~own * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())
        losses.append(loss)
    return PENALTIES[int(np.argmin(losses))]


class Vocabulary:
    """Candidate words, those of them that toxic texts rather have, known words with their counts, and the character model."""

    def __init__(self, wanted: list[str], toxic: set[str], known: dict[str, int], characters: CharacterModel) -> None:
        self.wanted, self.toxic, self.known, self.characters = wanted, toxic, known, characters

    def restorer(self) -> Restorer:
        return Restorer(self.toxic, WordModel(self.known, self.characters))


class ToxicityModel:
    """Words with their weights, the log odds of a text without any, and the vocabulary that restores texts."""

    def __init__(self, weights: dict[str, float], prior: float, vocabulary: Vocabulary) -> None:
        self.weights, self.prior, self.vocabulary = weights, prior, vocabulary

    def restorer(self) -> Restorer:
        return self.vocabulary.restorer()

    def total(self, found: set[str]) -> float:
        return float(logistic(np.float64(self.prior + sum(sorted(self.weights[w] for w in found)))))

    def score(self, restored: str) -> float:
        return self.total({w for w in WORD.findall(restored) if w in self.weights})


def held_out(id_col: str):
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def character_model(docs: DataFrame, text_col: str) -> CharacterModel:
    """Counts over all documents; the table has SIZE ** ORDER entries at most, however many documents there are."""
    texts = docs.select(text_of(text_col).cast("binary").alias("text"))
    counts = texts.mapInArrow(frugal(count_grams), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    return CharacterModel(counts["gram"].to_numpy(), counts["n"].to_numpy())


def present(vocabulary: Vocabulary):
    """Adds to the columns after the text the numbers of the candidate words that it holds, after restoring."""
    number = {w: i for i, w in enumerate(vocabulary.wanted)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = vocabulary.restorer()
        for batch in batches:
            words, held, size = [], [], 0
            for i, t in enumerate(batch.column(0), 1):
                held.append(t.as_py().decode("utf-8", "replace"))
                size += len(held[-1])
                if size >= BUFFER or i == batch.num_rows:
                    words += [sorted({number[w] for w in WORD.findall(x) if w in number}) for x in own.restored(held)]
                    held, size = [], 0
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(words, pa.list_(pa.int32()))], names=[*batch.schema.names[1:], FOUND])

    return run


def usable(labels: DataFrame) -> DataFrame:
    """Every labelled id outside the held-out fold, with its label and its part of the cross-validation."""
    rows = labels.filter("doc_id is not null and toxic is not null").filter(~held_out("doc_id"))
    own = rows.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("toxic")).filter("toxic in (0, 1)")
    return own.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(PARTS)).cast("int"))


def vocabulary_of(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> Vocabulary | None:
    """Words that all labelled rows outside the held-out fold relate to a label, by a test over them; none without rows of both labels."""
    texts = docs.filter(~held_out(id_col)).select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(text_col).alias("t")).withColumn("digest", F.xxhash64(F.lower("t")))
    own = written(texts.select("id", "digest").join(usable(labels), "id").groupBy("digest").agg(F.max("toxic").alias("toxic"), F.min("id").alias("id")))  # copies are no evidence of their own
    found = {r.toxic: r.n for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = float(found.get(1, 0)), float(found.get(0, 0))
    if not bad or not good:
        discard(own)
        return None
    distinct = texts.join(own.hint("merge"), ["id", "digest"]).dropDuplicates(["id", "digest"])  # on the order of the join; texts are shuffled once, whatever the size
    words = distinct.select("toxic", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("t"), F.lit(r"([\p{L}]+)"), F.lit(1)))).alias("word"))
    counts = written(words.groupBy("word").agg(F.sum("toxic").cast("double").alias("a"), F.count(F.lit(1)).cast("double").alias("n")).filter(F.col("n") >= LEAST_DOCS))
    rows = bad + good
    cells = [(F.col("a"), F.col("n") * bad / rows), (F.col("n") - F.col("a"), F.col("n") * good / rows), (bad - F.col("a"), (rows - F.col("n")) * bad / rows), (good - F.col("n") + F.col("a"), (rows - F.col("n")) * good / rows)]
    odds = F.log((F.col("a") + 0.5) / (bad + 1)) - F.log((F.col("n") - F.col("a") + 0.5) / (good + 1))
    test = sum((F.when((o > 0) & (e > 0), 2 * o * F.log(o / e)).otherwise(0.0) for o, e in cells), F.lit(0.0))
    related = counts.withColumn("test", test).filter((F.col("test") >= EVIDENCE) & (F.abs(odds) >= EFFECT)).orderBy(F.col("test").desc(), "word").collect()
    least, more = math.inf, 0  # how often a known word is seen at least
    for r in sorted(counts.groupBy("n").count().collect(), reverse=True):
        more += r["count"]
        if more > KNOWN:
            break
        least = r.n
    known = {r.word: int(r.n) for r in counts.filter(F.col("n") >= least).collect()} | {r.word: int(r.n) for r in related}
    discard(own, counts)
    return Vocabulary([r.word for r in related], {r.word for r in related if r.a / r.n > bad / rows}, known, character_model(docs, text_col))


def found_words(docs: DataFrame, vocabulary: Vocabulary, id_col: str, text_col: str) -> DataFrame:
    """One row per input row: id, held_out and the numbers of the candidate words in its restored text, as a table."""
    rows = docs.select(text_of(text_col).cast("binary").alias("the text"), F.col(f"`{id_col}`").alias(id_col), held_out(id_col).alias("held_out"))
    return written(rows.mapInArrow(frugal(present(vocabulary)), rows.drop("the text").schema.add(FOUND, ArrayType(IntegerType()))))


def fitted(found: DataFrame, vocabulary: Vocabulary, labels: DataFrame, id_col: str) -> ToxicityModel:
    """The regression over all labelled rows outside the held-out fold.

    Rows with the same words, label and part are counted together; the driver gets these counts, whose
    number grows with the sets of candidate words that texts hold and not with the texts.
    """
    rows = found.filter("not held_out").select(F.col(f"`{id_col}`").cast("long").alias("id"), FOUND).join(usable(labels), "id")
    table = rows.groupBy(FOUND, "toxic", "fold").agg(F.count(F.lit(1)).alias("n")).select(FOUND, "toxic", "fold", "n").toArrow().combine_chunks()
    x = Bags(pa.concat_arrays(table[FOUND].chunks), len(vocabulary.wanted))
    y, fold, times = (table[c].to_numpy().astype(float) for c in ("toxic", "fold", "n"))
    *weights, prior = regression(x, y, times, chosen_penalty(x, y, times, fold))
    return ToxicityModel({word: float(v) for word, v in zip(vocabulary.wanted, weights, strict=True)}, float(prior), vocabulary)


def unlabelled() -> ToxicityModel:
    """No text is toxic."""
    return ToxicityModel({}, -10.0, Vocabulary([], set(), {}, CharacterModel.of_words({})))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Fits on every labelled row outside the held-out fold.

    Every choice (candidate words, penalty) is made inside these rows. The character model is counted on all
    documents, without labels.
    """
    vocabulary = vocabulary_of(docs, labels, id_col, text_col)
    if vocabulary is None:
        return unlabelled()
    found = found_words(docs.filter(~held_out(id_col)), vocabulary, id_col, text_col)
    model = fitted(found, vocabulary, labels, id_col)
    discard(found)
    return model


def scorer(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = model.vocabulary.wanted
        for batch in batches:
            scores = [model.total({weights[i] for i in words.as_py()}) for words in batch.column(0)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64())], names=[*batch.schema.names[1:], "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, held_out, score and predicted.

    A score uses the text only, whole and of any length. Null texts are empty, and an empty text has the
    prior's score, as has every text without a weighed word, so ties are common. Rows with a null id are
    scored like others. Without labelled rows of both kinds no text is toxic. Repeated rows get the same
    score; an empty table gives no rows; other columns are ignored whatever their names. Texts are restored
    once: the regression and the scores use the same table of the words found in them.
    """
    vocabulary = vocabulary_of(docs, labels, id_col, text_col)
    model = unlabelled()
    found = found_words(docs, vocabulary or model.vocabulary, id_col, text_col)
    if vocabulary is not None:
        model = fitted(found, vocabulary, labels, id_col)
    scored = found.select(FOUND, F.col(f"`{id_col}`"), "held_out")
    out = scored.mapInArrow(frugal(scorer(model)), scored.drop(FOUND).schema.add("score", "double"))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "held_out", "score", "predicted")
