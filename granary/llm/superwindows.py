"""Windows of every text, dealt to partitions as packed strings, and the repeats among them.

A window is ``width`` consecutive symbols of one text: bytes, or words joined by one space. Its
minimiser is the smallest hash among its grams. Consecutive windows with one minimiser travel as
one packed string to the partition of that minimiser, so equal windows always meet and a text moves
about three times instead of ``width`` times. A partition is cut into slices of minimisers, and one
slice at a time is sorted.

Packed strings are combined wherever they meet: in a map task before they are sent, and in a
partition whenever those it holds grow. Of equal strings only the places in the smallest document
go on; at all other places the whole string is known to be covered. So a string that a third of all
documents have reaches its partition once a task, not once a document. In a slice, the windows of
distinct strings are sorted, and each learns the smallest document in which it starts. Equality is
always decided by an exact sort, which the caller gives; fingerprints only leave out what is unique.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import frugal, partitions_for, text_bytes, text_of, written

CHUNK = 1 << 18  # bytes of text that are hashed at once
FLUSH = 12 << 20  # bytes of text that a task holds before it sends their packed strings
LONGEST = 64  # windows of a packed string at most; a longer run is cut there
PARTITION = 80 << 20  # bytes of packed strings that a partition is planned for
SLICE = 3 << 19  # bytes of packed strings that are sorted at once
GROWN = 96 << 20  # bytes of packed strings that a partition holds before it combines them
EXPANSION = 3.5  # bytes of packed strings for a byte of text, about
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
MIX = 0xD6E8FEB86659FD93
LEVEL = 6

BLOBS = pa.schema([("bucket", pa.int32()), ("known", pa.bool_()), ("meta", pa.binary()), ("body", pa.binary())])
SPANS = pa.schema([("doc", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])

Spans = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


@dataclass(frozen=True)
class Shape:
    """``words``: symbols are words, else bytes; ``gram``: symbols hashed together; ``width``: symbols of a window."""

    words: bool
    gram: int
    width: int


#: From a buffer and the bytes that each string covers: an order, and along it a number that equal strings share.
Exact = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def normal(text: bytes, words: bool) -> bytes:
    """Words are what white space (space, tab to carriage return) separates; bytes stay as they are."""
    return b" ".join(text.split()) if words else text


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(MIX)
    x ^= x >> np.uint64(32)
    x *= np.uint64(MIX)
    x ^= x >> np.uint64(29)
    return x


HELD = 1 << 20  # powers of a base that are kept for the next call
_held: dict[int, np.ndarray] = {}


def powers(n: int, base: int) -> np.ndarray:
    """The first ``n`` powers; callers do not write to them."""
    if n <= HELD:
        if len(_held.get(base, ())) < n:
            _held[base] = raised(min(HELD, 2 * n), base)
        return _held[base][:n]
    return raised(n, base)


def raised(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each raw[start:stop], by one prefix sum over the buffer."""
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(len(raw), BASE), out=total[1:])
    return (total[stops] - total[starts]) * powers(len(raw) + 1, INVERSE)[starts]


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words in a buffer in which single spaces separate them."""
    spaces = np.flatnonzero(raw == 32)
    return np.concatenate([[0], spaces + 1]), np.concatenate([spaces, [len(raw)]])


def eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as a number, but for the last seven places."""
    return np.ndarray(shape=(max(0, len(raw) - 7),), dtype="<u8", buffer=raw, strides=(1,))


def segments(text: bytes, shape: Shape) -> Iterator[tuple[int, bytes, int]]:
    """Parts of a normal text with all its windows, each in one part: first symbol, bytes, symbols."""
    over = shape.width - 1
    if not shape.words:
        for i in range(0, len(text) - over, CHUNK):
            part = text[i : i + CHUNK + over]
            yield i, part, len(part)
    elif len(text) <= CHUNK:
        if text and (n := text.count(b" ") + 1) > over:
            yield 0, text, n
    else:
        starts, stops = word_bounds(np.frombuffer(text, np.uint8))
        step = max(1, len(starts) * CHUNK // len(text))
        for i in range(0, len(starts) - over, step):
            last = min(i + step + over, len(starts))
            yield i, text[starts[i] : stops[last - 1]], last - i


def runs(parts: list[bytes], counts: list[int], shape: Shape) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimiser: buffer, part, first symbol in it, windows, byte range, minimiser."""
    buffer = (b" " if shape.words else b"").join(parts)
    raw = np.frombuffer(buffer, np.uint8)
    if shape.words:
        starts, stops = word_bounds(raw)
        own = hashes(raw, starts, stops)
        n = len(starts)
        gram = np.zeros(n - shape.gram + 1, np.uint64)
        for i in range(shape.gram):
            gram = gram * np.uint64(BASE) + own[i : n - shape.gram + 1 + i]
    else:
        n = len(raw)
        eight = eights(raw)
        gram = eight[: n - shape.gram + 1] * np.uint64(BASE) + eight[shape.gram - 8 :] * np.uint64(MIX)
    least = mixed(gram)
    span, done = shape.width - shape.gram + 1, 1
    while done < span:
        step = min(done, span - done)
        least = np.minimum(least[:-step], least[step:])
        done += step
    stop = np.cumsum(counts)
    start = stop - counts
    fresh = np.ones(len(least), bool)
    fresh[1:] = least[1:] != least[:-1]
    fresh[start] = True
    beyond = stop - shape.width + 1
    fresh[beyond[beyond < len(least)]] = True
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, len(least)))
    if len(count) and count.max() > LONGEST:
        pieces = -(-count // LONGEST)
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = np.repeat(first, pieces) + nth * LONGEST
        count = np.minimum(LONGEST, np.repeat(count, pieces) - nth * LONGEST)
    part = np.searchsorted(start, first, "right") - 1
    keep = first < beyond[part]
    first, count, part = first[keep], count[keep], part[keep]
    last = first + count + shape.width - 2
    lo, hi = (starts[first], stops[last]) if shape.words else (first, last + 1)
    return buffer, part, first - start[part], count, lo, hi, least[first]


def repeats(values: np.ndarray) -> np.ndarray:
    """Indexes of values that may occur twice; two bit tables drop most of the unique ones."""
    found = np.arange(len(values))
    for shift in (0, 32):
        if not len(found):
            break
        bits = max(10, int(len(found)).bit_length() + 2)
        slot = ((values[found] >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        found = found[np.bincount(slot, minlength=1 << bits)[slot] > 1]
    return found


@dataclass
class Strings:
    """Packed strings in a buffer, and the places they come from.

    ``at`` is the string of each place; ``doc``, ``tag`` and ``pos`` are its document and first symbol.
    ``slot`` is the partition and slice of a string, where it is still to be dealt.
    """

    raw: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    windows: np.ndarray
    at: np.ndarray
    doc: np.ndarray
    tag: np.ndarray
    pos: np.ndarray
    slot: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def combine(self, shape: Shape, exact: Exact) -> tuple[Strings, np.ndarray, Spans]:
        """Equal strings as one with its places in its smallest document, that document, and the ranges at all other places."""
        n = len(self.lo)
        eight = eights(np.concatenate([self.raw, np.zeros(8, np.uint8)]))
        length = self.hi - self.lo
        print_ = length.astype(np.uint64)
        for x in (self.lo, self.lo + length // 2, np.maximum(self.lo, self.hi - 8)):
            print_ = mixed(print_ * np.uint64(BASE) + eight[x])
        some = repeats(print_)
        one = np.arange(n)
        if len(some):
            order, group = exact(self.raw, self.lo[some], self.hi[some])
            head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            least = np.minimum.reduceat(some[order], head)
            one[some[order]] = least[group]
        low = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(low, one[self.at], self.doc)
        mine = one[self.at]
        late = self.doc > low[mine]
        spans = (self.doc[late], self.tag[late], self.pos[late], self.pos[late] + self.windows[mine[late]] + shape.width - 1)
        stay = np.flatnonzero(one == np.arange(n))
        new = np.empty(n, np.int64)
        new[stay] = np.arange(len(stay))
        on = ~late
        out = Strings(self.raw, self.lo[stay], self.hi[stay], self.windows[stay], new[mine[on]], self.doc[on], self.tag[on], self.pos[on], self.slot[stay] if len(self.slot) else self.slot)
        return out, low[stay], spans

    def covered(self, low: np.ndarray, shape: Shape, exact: Exact) -> Spans:
        """Ranges of distinct strings, at their places in document ``low``, that windows of an earlier document cover."""
        n = len(self.lo)
        windows = self.windows.astype(np.int64)
        first = np.cumsum(windows) - windows
        owner = np.repeat(np.arange(n), windows)
        nth = np.arange(len(owner)) - first[owner]
        if shape.words:
            starts, stops = word_bounds(self.raw)
            symbol = np.searchsorted(starts, self.lo)[owner] + nth
            lo, hi = starts[symbol], stops[symbol + shape.width - 1]
            prints = hashes(self.raw, lo, hi)
        else:
            lo = self.lo[owner] + nth
            hi = lo + shape.width
            eight = eights(self.raw)
            whole = np.zeros(len(self.raw) - shape.width + 1, np.uint64)
            for a in [*range(0, shape.width - 8, 8), shape.width - 8]:
                whole *= np.uint64(BASE)
                whole += eight[a : a + len(whole)]
            prints = mixed(whole)[lo]
        found = repeats(prints)
        if len(found):
            prints = prints[found]
            by = np.argsort(prints)
            head = np.flatnonzero(np.append(True, prints[by][1:] != prints[by][:-1]))
            own = low[owner[found[by]]]
            size = np.diff(np.append(head, len(by)))
            several = np.minimum.reduceat(own, head) < np.maximum.reduceat(own, head)
            found = found[by[np.repeat(several, size)]]
        empty = np.zeros(0, np.int64)
        if not len(found):
            return empty, empty, empty, empty
        order, group = exact(self.raw, lo[found], hi[found])
        found = found[order]
        head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        least = np.minimum.reduceat(low[owner[found]], head)[group]
        found = np.sort(found[least < low[owner[found]]])
        if not len(found):
            return empty, empty, empty, empty
        own = owner[found]
        a = np.flatnonzero(np.append(True, (np.diff(found) != 1) | (np.diff(own) != 0)))
        b = np.append(a[1:], len(found)) - 1
        of, begin, end = own[a], nth[found[a]], nth[found[b]] + shape.width
        ranges = np.bincount(of, minlength=n)
        offset = np.cumsum(ranges) - ranges
        rows = np.flatnonzero(ranges[self.at] > 0)
        times = ranges[self.at[rows]]
        row = np.repeat(rows, times)
        pick = np.repeat(offset[self.at[rows]], times) + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
        return self.doc[row], self.tag[row], self.pos[row] + begin[pick], self.pos[row] + end[pick]


def planes(*columns: np.ndarray) -> bytes:
    """Columns of numbers byte by byte, so that equal high bytes compress."""
    return b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns)


def unplanes(raw: bytes, at: int, kinds: list[tuple[type, int]]) -> list[np.ndarray]:
    out = []
    for kind, n in kinds:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T).reshape(-1).view(kind))
        at += n * size
    return out


def encode(strings: Strings, slices: np.ndarray, bodies: list[bytes], gap: bytes) -> tuple[bytes, bytes]:
    """Strings sorted by slice, with their places, as two compressed blobs."""
    z = zstandard.ZstdCompressor(level=LEVEL)
    by = np.argsort(strings.at, kind="stable")
    pairs, which = np.unique(np.stack([strings.doc[by], strings.tag[by]], axis=1), axis=0, return_inverse=True) if len(by) else (np.zeros((0, 2), np.int64), by)
    each = np.bincount(strings.at, minlength=len(slices)).astype(np.uint32)
    sizes = np.array([len(slices), len(by), len(pairs)], np.int64)
    columns = (slices.astype(np.uint16), (strings.hi - strings.lo).astype(np.uint32), strings.windows.astype(np.uint32), each, np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1]), which.reshape(-1).astype(np.uint32), strings.pos[by].astype(np.uint32))
    return z.compress(sizes.tobytes() + planes(*columns)), z.compress(gap.join([*bodies, b""]))


@dataclass
class Blob:
    """What ``encode`` made, decoded: columns by string, then by place."""

    body: bytes
    slice: np.ndarray
    length: np.ndarray
    windows: np.ndarray
    each: np.ndarray
    doc: np.ndarray
    tag: np.ndarray
    pos: np.ndarray
    stops: np.ndarray
    places: np.ndarray

    @staticmethod
    def decode(meta: bytes, body: bytes, gap: int) -> Blob:
        z = zstandard.ZstdDecompressor()
        raw = z.decompress(meta)
        n, m, k = np.frombuffer(raw, np.int64, 3).tolist()
        own, length, windows, each, docs, tags, which, pos = unplanes(raw, 24, [(np.uint16, n), (np.uint32, n), (np.uint32, n), (np.uint32, n), (np.int64, k), (np.int64, k), (np.uint32, m), (np.uint32, m)])
        return Blob(z.decompress(body), own, length, windows, each, docs[which], tags[which], pos, np.append(0, np.cumsum(length.astype(np.int64) + gap)), np.append(0, np.cumsum(each.astype(np.int64))))

    def part(self, lo: int, hi: int) -> tuple[int, int, bytes]:
        """The strings of slices from ``lo`` to before ``hi``."""
        a, b = np.searchsorted(self.slice, [lo, hi]).tolist()
        return a, b, self.body[self.stops[a] : self.stops[b]]


def gathered(blobs: list[Blob], lo: int, hi: int, gap: int) -> Strings:
    """The strings of some slices of a partition, from all its blobs."""
    parts = [(b, *b.part(lo, hi)) for b in blobs]
    column = lambda name, kind, ends: np.concatenate([getattr(b, name)[ends(b, x, y)] for b, x, y, _ in parts]).astype(kind)
    own, place = lambda b, x, y: slice(x, y), lambda b, x, y: slice(b.places[x], b.places[y])
    length = column("length", np.int64, own)
    start = np.cumsum(length + gap) - length - gap
    at = np.repeat(np.arange(len(length)), column("each", np.int64, own))
    body = b"".join(p[3] for p in parts)
    raw = np.frombuffer(body[:-1] if gap and body else body, np.uint8)
    return Strings(raw, start, start + length, column("windows", np.int64, own), at, column("doc", np.int64, place), column("tag", np.int64, place), column("pos", np.int64, place), column("slice", np.int64, own))


def span_batches(spans: Spans) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(spans[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 100_000], t) for c, t in zip(spans, SPANS.types, strict=True)], schema=SPANS)


def pack(shape: Shape, exact: Exact, buckets: int, slices: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Map side: texts (doc, tag, text) to blobs of distinct strings by partition, and ranges that are known already."""
    gap = b" " if shape.words else b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        turn = task.partitionId() if task else 0
        held: list[tuple] = []

        def deal(parts: list[tuple[int, int, int, bytes, int]]) -> None:
            buffer, part, at, count, lo, hi, least = runs([p[3] for p in parts], [p[4] for p in parts], shape)
            slot = ((least * np.uint64(BASE)) >> np.uint64(24)) % np.uint64(buckets * slices)
            doc, tag, base = (np.array([p[i] for p in parts], np.int64)[part] for i in range(3))
            held.append((buffer, lo, hi, count, doc, tag, base + at, slot.astype(np.int64)))

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal turn
            if not held:
                return
            shift = np.cumsum([0, *(len(h[0]) + len(gap) for h in held)])[:-1]
            buffer = gap.join(h[0] for h in held)
            lo, hi = (np.concatenate([h[i] + s for h, s in zip(held, shift, strict=True)]) for i in (1, 2))
            count, doc, tag, pos, slot = (np.concatenate([h[i] for h in held]) for i in range(3, 8))
            held.clear()
            strings, _, spans = Strings(np.frombuffer(buffer, np.uint8), lo, hi, count, np.arange(len(lo)), doc, tag, pos, slot).combine(shape, exact)
            del lo, hi, count, doc, tag, pos, slot
            rows, weight = [], 0
            if len(spans[0]):
                turn += 1
                z = zstandard.ZstdCompressor(level=LEVEL)
                rows.append((turn % buckets, True, z.compress(planes(*spans)), b""))
            by = np.argsort(strings.slot, kind="stable")
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by))
            place = np.argsort(rank[strings.at], kind="stable")
            ends = np.searchsorted(rank[strings.at][place], np.arange(len(by) + 1))
            bucket = strings.slot[by] // slices
            cuts = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(by)).tolist()
            for a, b in zip(cuts, cuts[1:], strict=False):
                own, its = by[a:b], place[ends[a] : ends[b]]
                some = Strings(strings.raw, strings.lo[own], strings.hi[own], strings.windows[own], rank[strings.at[its]] - a, strings.doc[its], strings.tag[its], strings.pos[its])
                bodies = [buffer[x:y] for x, y in zip(some.lo.tolist(), some.hi.tolist(), strict=True)]
                rows.append((int(bucket[a]), False, *encode(some, strings.slot[own] % slices, bodies, gap)))
                weight += len(rows[-1][3])
                if weight > 2 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), BLOBS.types, strict=True)], schema=BLOBS)
                    rows, weight = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), BLOBS.types, strict=True)], schema=BLOBS)

        parts, weight, size = [], 0, 0
        for batch in batches:
            docs, tags, texts = (batch.column(i) for i in range(3))
            for doc, tag, text in zip(docs.to_pylist(), tags.to_pylist(), texts, strict=True):
                if doc is None:
                    continue
                for at, piece, n in segments(normal(text.as_py(), shape.words), shape):
                    parts.append((doc, tag, at, piece, n))
                    weight += len(piece)
                    if weight >= CHUNK:
                        deal(parts)
                        size += weight
                        parts, weight = [], 0
                        if size >= FLUSH:
                            yield from flush()
                            size = 0
        if parts:
            deal(parts)
        yield from flush()

    return frugal(run)


def unpack(shape: Shape, exact: Exact, slices: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Reduce side: a partition's blobs to covered ranges."""
    gap = b" " if shape.words else b""

    def combined(blobs: list[Blob]) -> Iterator[pa.RecordBatch | Blob]:
        """One blob with the distinct strings of many, after the ranges that this makes known."""
        metas = []
        for lo, hi in steps(blobs):
            strings, _, spans = gathered(blobs, lo, hi, len(gap)).combine(shape, exact)
            yield from span_batches(spans)
            by = np.argsort(strings.slot, kind="stable")
            rank = np.empty(len(by), np.int64)
            rank[by] = np.arange(len(by))
            raw = strings.raw.tobytes()
            some = Strings(strings.raw, strings.lo[by], strings.hi[by], strings.windows[by], rank[strings.at], strings.doc, strings.tag, strings.pos)
            bodies = [raw[x:y] for x, y in zip(some.lo.tolist(), some.hi.tolist(), strict=True)]
            metas.append(Blob.decode(*encode(some, strings.slot[by], bodies, gap), len(gap)))
        yield from metas

    def steps(blobs: list[Blob]) -> Iterator[tuple[int, int]]:
        """Runs of slices with about SLICE bytes."""
        size = np.zeros(slices + 1, np.int64)
        for b in blobs:
            size[:slices] += np.bincount(b.slice, b.length, minlength=slices).astype(np.int64)
        lo = total = 0
        for i in range(slices):
            total += size[i]
            if total >= SLICE or i == slices - 1:
                if total:
                    yield lo, i + 1
                lo, total = i + 1, 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[Blob] = []
        size, limit = 0, GROWN
        for batch in batches:
            for known, meta, body in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if known:
                    raw = zstandard.ZstdDecompressor().decompress(meta.as_py())
                    yield from span_batches(tuple(unplanes(raw, 0, [(np.int64, len(raw) // 32)] * 4)))
                    continue
                blobs.append(Blob.decode(meta.as_py(), body.as_py(), len(gap)))
                size += len(blobs[-1].body)
                if size >= limit:
                    found = list(combined(blobs))
                    yield from (x for x in found if not isinstance(x, Blob))
                    blobs = [x for x in found if isinstance(x, Blob)]
                    size = sum(len(b.body) for b in blobs)
                    limit = max(GROWN, 2 * size)
        for lo, hi in steps(blobs):
            strings, low, spans = gathered(blobs, lo, hi, len(gap)).combine(shape, exact)
            yield from span_batches(spans)
            yield from span_batches(strings.covered(low, shape, exact))

    return frugal(run)


def covered(texts: DataFrame, shape: Shape, exact: Exact, size: int) -> DataFrame:
    """Ranges of symbols that windows with an earlier document cover: doc, tag, start, stop.

    ``texts`` has doc (long), tag (long) and text (binary), ``size`` bytes in all. Ranges may touch or overlap.
    """
    packed = int(size * EXPANSION)
    n = partitions_for(texts.sparkSession, packed, PARTITION)
    slices = max(1, min(1 << 14, 4 * packed // n // SLICE))
    blobs = texts.mapInArrow(pack(shape, exact, n, slices), "bucket int, known boolean, meta binary, body binary")
    return blobs.repartitionById(n, F.col("bucket")).mapInArrow(unpack(shape, exact, slices), "doc long, tag long, start long, stop long")


def merged(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal ranges of a union of ranges; ranges that touch become one."""
    by = np.argsort(starts, kind="stable")
    starts, reach = starts[by], np.maximum.accumulate(stops[by])
    fresh = np.append(True, starts[1:] > reach[:-1])
    heads = np.flatnonzero(fresh)
    return starts[heads], reach[np.append(heads[1:], len(starts)) - 1]


def without(text: bytes, starts: np.ndarray, stops: np.ndarray, words: bool) -> tuple[bytes, int]:
    """What maximal ranges leave of a normal text, and its symbols."""
    if words:
        symbols = text.split(b" ") if text else []
        if not len(starts):
            return text, len(symbols)
        edges = zip([0, *stops.tolist()], [*starts.tolist(), len(symbols)], strict=True)
        return b" ".join(w for a, b in edges for w in symbols[a:b]), len(symbols)
    edges = zip([0, *stops.tolist()], [*starts.tolist(), len(text)], strict=True)
    return b"".join(text[a:b] for a, b in edges), len(text)


def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compresses each text, so that fewer bytes are shuffled."""
    z = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([z.compress(t.as_py()) for t in batch.column(2)], pa.binary())], names=["doc", "tag", "text"])


def remove(docs: DataFrame, shape: Shape, exact: Exact, id_col: str, text_col: str) -> DataFrame:
    """Every row's text without the covered symbols.

    Columns: the id, kept (binary), spans (array of start, stop in symbols of the input, maximal),
    n_symbols and n_removed. A null text is empty. A row with a null id keeps its text and is no
    one's earlier document; rows that share an id do not cut each other. Ranges are gathered once for
    each distinct id and text, however many rows share them, and written before texts are shuffled.
    """
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc"), F.xxhash64(text_of(text_col)).alias("tag"), text_of(text_col).cast("binary").alias("text"))
    ranges = written(covered(texts, shape, exact, text_bytes(docs, text_col)))
    spans = ranges.groupBy("doc", "tag").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            kept, runs_, total, gone = [], [], [], []
            for text, found in zip(batch.column(1), batch.column(2), strict=True):
                plain = normal(z.decompress(text.as_py()), shape.words)
                starts = stops = np.zeros(0, np.int64)
                if found.is_valid and len(found.values):
                    starts, stops = merged(found.values.field(0).to_numpy(), found.values.field(1).to_numpy())
                rest, n = without(plain, starts, stops, shape.words)
                kept.append(rest)
                runs_.append([{"start": a, "stop": b} for a, b in zip(starts.tolist(), stops.tolist(), strict=True)])
                total.append(n)
                gone.append(int((stops - starts).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.binary()), pa.array(runs_, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(total, pa.int64()), pa.array(gone, pa.int64())], names=["doc", "kept", "spans", "n_symbols", "n_removed"])

    small = texts.mapInArrow(frugal(squeeze), "doc long, tag long, text binary")
    joined = small.join(spans, ["doc", "tag"], "left").select("doc", "text", "spans")
    out = joined.mapInArrow(frugal(apply), "doc long, kept binary, spans array<struct<start: long, stop: long>>, n_symbols long, n_removed long")
    return out.withColumnRenamed("doc", id_col)
