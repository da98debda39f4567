"""Every operator against brute force, and on null, empty, long, tied, repeated and clashing input."""

import collections
import hashlib
import math
import random
import time
import zlib
from html.parser import HTMLParser

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.llm import html_text, registry, topk
from granary.llm.exact_dedup import Index, Run, exact_dedup, exact_groups
from granary.llm.kneser_ney import quality_filter, quality_scores
from granary.llm.mixing import mix
from granary.llm.ngram_join import bands_for, plain, similar_dedup, similar_groups
from granary.llm.packing import Capacities, best_fit, cut, encoder, pack_documents
from granary.llm.substring_dedup import substring_dedup
from granary.llm.suffix_dedup import suffix_dedup
from granary.llm.suffix_sort import deep_shallow
from granary.llm.toxicity import ORDER, SIZE, SYMBOL, Bags, CharacterModel, Restorer, WordModel, arcs, decode, fit, logistic, regression, toxicity

SF = "/root/testdata/sf0.001"
# Columns beyond the id and the text have names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tag long, digest string, `group` string"
LABELS = "doc_id long, quality int, toxic int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src0", 0, 7, "x", "g") for i, t in rows], SCHEMA)


def texts(seed=1, n=30):
    rng = random.Random(seed)
    words = ["ab", "c", "the", "of", "é", "zz", "Tion"]
    passage = " ".join(rng.choice(words) for _ in range(70))
    out = []
    for i in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.randrange(0, 120)))
        if i % 3 == 0:
            t = t[:40] + passage[rng.randrange(20) :] + t[40:]
        out.append((i, t))
    long = " ".join(f"w{rng.randrange(9)}" for _ in range(30_000))
    return [*out, (100, None), (101, ""), (102, out[5][1]), (103, out[5][1].upper()), (104, "a" * 500), (105, "a" * 300), (106, long), (107, long + " x"), (108, " \t\n ")]


def removed(rows, width, split, join):
    first = {}
    parts = [(i, split((t or "").encode())) for i, t in rows]
    for i, s in parts:
        for p in range(len(s) - width + 1):
            k = tuple(s[p : p + width])
            first[k] = min(first.get(k, i), i)
    out = collections.Counter()
    for i, s in parts:
        gone = [False] * len(s)
        for p in range(len(s) - width + 1):
            if first[tuple(s[p : p + width])] < i:
                gone[p : p + width] = [True] * width
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out[i, join([x for x, g in zip(s, gone, strict=True) if not g]), len(s), sum(gone), spans] += 1
    return out


@pytest.mark.parametrize(("f", "split", "join"), [(suffix_dedup, list, bytes), (substring_dedup, bytes.split, b" ".join)], ids=["suffix", "substring"])
def test_repeats(spark, f, split, join):
    rows = [(i, t[:3000] if t else t) for i, t in texts()]
    rows += [rows[3], (5, "other text with the id five " * 9)]
    got = collections.Counter((r.doc_id, bytes(r.kept), r.n_symbols, r.n_removed, len(r.spans)) for r in f(frame(spark, rows)).collect())
    assert got == removed(rows, 50, split, join)
    assert f(frame(spark, [])).count() == 0
    nameless = f(frame(spark, [(None, rows[0][1]), (0, rows[0][1])])).collect()
    assert all(r.n_removed == 0 for r in nameless)


def test_long_texts_are_cut_nowhere(spark, monkeypatch):
    from granary.llm import superwindows

    for name, value in (("CHUNK", 400), ("FLUSH", 3000), ("SLICE", 2000), ("GROWN", 5000), ("PARTITION", 9000)):
        monkeypatch.setattr(superwindows, name, value)
    rows = [(i, t[:5000] if t else t) for i, t in texts(2, 12)]
    for f, split, join in ((suffix_dedup, list, bytes), (substring_dedup, bytes.split, b" ".join)):
        got = collections.Counter((r.doc_id, bytes(r.kept), r.n_symbols, r.n_removed, len(r.spans)) for r in f(frame(spark, rows)).collect())
        assert got == removed(rows, 50, split, join)


def test_deep_shallow():
    rng = np.random.default_rng(3)
    for symbols, width, shallow in ((2, 50, 16), (3, 30, 8), (2, 9, 16), (1, 50, 16), (256, 70, 16)):
        data = rng.integers(0, symbols, 900, np.uint8).tobytes()
        data += data[100:400] * 2
        starts = rng.integers(0, len(data) - width, 700)
        for stops in (starts + width, starts + rng.integers(0, width, 700)):
            order, group = deep_shallow(data, starts, stops, shallow)
            found = [data[a:b] for a, b in zip(starts[order], stops[order], strict=True)]
            assert found == sorted(found)
            assert all((g == h) == (a == b) for a, b, g, h in zip(found, found[1:], group, group[1:], strict=False))


def test_exact(spark):
    rows = [*texts(), (200, None), (None, ""), (None, "only here"), (9, "Same"), (9, "Same"), (8, "sAME"), (1, "ÉÀ"), (2, "éà")]
    low = lambda t: (t or "").encode().lower()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    got = exact_groups(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = collections.Counter((r.doc_id, r.keep_id, r.group_size, bytes(r.digest)) for r in got)
    want = collections.Counter((i, max((x for x in groups[low(t)] if x is not None), default=None), len(groups[low(t)]), hashlib.sha256(low(t)).digest()) for i, t in rows)
    assert by == want
    assert collections.Counter(bytes(r.digest) for r in got if r.kept) == {hashlib.sha256(t).digest(): 1 for t in groups}
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    docs = frame(spark, rows)
    kept = exact_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_groups(frame(spark, [])).count() == 0 and exact_dedup(frame(spark, [])).count() == 0


def test_exact_beyond_the_filter_and_over_many_runs(spark, monkeypatch):
    from granary.llm import exact_dedup as module

    rng = random.Random(12)
    rows = [(i, f"text {rng.randrange(90)}" * rng.randrange(1, 3)) for i in range(2000)]
    want = {}
    for i, t in rows:
        want[t] = max(i, want.get(t, i))
    for size in (0, 1 << 20):
        for name, value in (("MEMTABLE_ROWS", 11), ("SEGMENT_ROWS", 40), ("FAN_IN", 3), ("FILTER_BYTES", size)):
            monkeypatch.setattr(module, name, value)
        got = exact_groups(frame(spark, rows).repartition(5)).collect()
        assert {r.doc_id: r.keep_id for r in got} == {i: want[t] for i, t in rows}


def test_index_of_digests():
    rng = np.random.default_rng(9)
    table, want = Index(), {}
    for _ in range(200):
        digests = np.array([hashlib.sha256(bytes([x])).digest() for x in rng.integers(0, 250, 9)], "S32")
        idents = rng.integers(0, 1000, 9)
        for d, i in zip(digests.tolist(), idents.tolist(), strict=True):
            best, n = want.get(d, (i, 0))
            want[d] = (max(best, i), n + 1)
        table.add(Run.merged(digests, idents, np.ones(9, np.int64)))
    runs = [r for level in table.levels for r in level]
    assert {d: (i, n) for r in runs for d, i, n in zip(r.digests.tolist(), r.idents.tolist(), r.hits.tolist(), strict=True)} == want
    assert sum(len(r.digests) for r in runs) == len(want) and len(table.levels) > 1


def links_of(rows):
    sets = collections.defaultdict(set)
    for i, t in rows:
        w = plain((t or "").encode()).split()
        sets[i] = {tuple(w)} if 0 < len(w) < 5 else {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    ids, links, root = sorted(sets), collections.Counter(), {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                links[a] += 1
                links[b] += 1
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: (top(i), links[i]) for i in ids}


def near_copies(n=300):
    rng = random.Random(4)
    base = [f"word{rng.randrange(5000)}" for _ in range(120)]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(99)}"
        out.append((1000 + i, " ".join(w)))
    return out


def test_similar(spark, monkeypatch):
    from granary.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 64)
    rows = [(i, t[:4000] if t else t) for i, t in texts()] + near_copies()
    docs = frame(spark, [*rows, (None, rows[0][1])])
    got = similar_groups(docs).collect()
    want = links_of(rows)
    assert {r.doc_id: (r.class_id, r.n_links) for r in got if r.doc_id is not None} == want
    kept = similar_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, (c, _) in want.items() if i == c)
    twice = similar_dedup(frame(spark, [(1, "one two three four five six"), (1, "one two three four five six")]))
    assert twice.count() == 1
    words = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    several = [(5, " ".join(words)), (5, "another text of the id five that no one else has"), (7, " ".join(words) + " more"), (9, "another text of the id five that no one else has ever")]
    assert {(r.doc_id, r.class_id) for r in similar_groups(frame(spark, several)).collect()} == {(5, 5), (7, 5), (9, 5)}
    assert similar_groups(frame(spark, [])).count() == 0
    b = bands_for(0.8, 5, 0.99999)
    assert 1 - (1 - 0.8**5) ** b >= 0.99999


def test_mixing(spark):
    rows = [(i, f"t{i}", "en", f"s{i % 3 if i % 2 else 0}", 1, 1, "d", "g") for i in range(4000)]
    docs = spark.createDataFrame([*rows, (None, None, None, None, None, None, None, None)], SCHEMA)
    out = mix(docs, {"s0": 0.2, "s1": 0.5, "s2": 0.3, "none": 0.4}, epochs=2.0)
    n = collections.Counter(r.source for r in out.collect())
    assert out.columns == docs.columns
    others = n.pop(None, 0)
    assert others == mix(docs.filter("source is null"), {}, epochs=2.0).count()
    unlisted = mix(docs, {"s1": 1.0}, epochs=3.0).groupBy("source").count().collect()
    assert all(abs(r["count"] / (3 * sum(x[3] == r.source for x in rows)) - 1) < 0.1 for r in unlisted if r.source)
    total = sum(n.values())
    assert abs(total - 8000) < 400 and all(abs(n[s] / total - w) < 0.03 for s, w in (("s0", 0.2), ("s1", 0.5), ("s2", 0.3)))
    rare = mix(docs.filter("source = 's1' or doc_id = 0"), {"s0": 0.5, "s1": 0.5})
    assert 200 < rare.filter("source = 's0'").count() < 500  # a mean far above one part
    assert mix(frame(spark, [])).count() == 0


def brute_top(vectors, k=5):
    rows = [(i, [int(np.floor(256.0 * float(np.float32(x)))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for q, a in [r for r in rows if r[0] % 50 == 0]:
        scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in rows if i != q and len(a) == len(b))
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)}
    return out


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD", 30)
    monkeypatch.setattr(topk, "BLOCK", 2)
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-3, 4, 8).astype(float).tolist()) for i in range(400)]
    rows += [(450, None), (500, [1.0, None]), (550, [float("nan")] * 8), (600, [float("inf")] * 8), (None, [1.0] * 8), (650, [1.0, 2.0]), (700, [2.0, 1.0]), (750, [])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = {tuple(r) for r in topk.top_k(df, df.filter("vec_id % 50 = 0")).collect()}
    assert got == brute_top(rows)
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    assert topk.product(np.array([[2.0**40]]), np.array([[2.0**20]])).tolist() == [[1 << 60]]


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, other = encoder(path), Tokenizer.from_file(path)
    for t in ("", "a  b\n\n c", "<|endoftext|>x", "don't é 漢字 123  \t", "x" * 3000, "   y"):
        assert own.encode(t, allowed_special="all") == other.encode(t, add_special_tokens=False).ids
    rows = [*texts(), (5, "again"), (None, "nameless")]
    got = pack_documents(frame(spark, rows)).collect()
    ids = collections.defaultdict(list)
    for i, t in rows:
        ids[i].append(other.encode(t or "", add_special_tokens=False).ids + [0])
    want = collections.Counter((i, p, a, n, zlib.crc32(np.array(x[a : a + n], "<u4").tobytes())) for i, xs in ids.items() for x in xs for p, (a, n) in enumerate(cut(len(x))))
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = collections.defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert pack_documents(frame(spark, [])).count() == 0


def test_best_fit_equals_one_by_one():
    rng = random.Random(6)
    for _ in range(30):
        lengths = [rng.randrange(1, 41) for _ in range(rng.randrange(1, 300))]
        rooms = []
        for n in sorted(lengths, reverse=True):
            fit = [x for x in rooms if x >= n]
            if fit:
                rooms.remove(min(fit))
            rooms.append((min(fit) if fit else 40) - n)
        places = best_fit(collections.Counter(lengths), 40)
        used = {first + j for groups in places.values() for n, per, first, _ in groups for j in range(-(-n // per))}
        assert len(used) == len(rooms)
        assert {n: sum(g[0] for g in groups) for n, groups in places.items()} == collections.Counter(lengths)
    tree = Capacities(10)
    tree.set(7, True)
    assert tree.tightest(3) == 7 and tree.tightest(8) is None


def test_quality(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    odd = docs.limit(0).unionByName(spark.createDataFrame([(9001, None, None, None, None), (9002, "", "xx", "s", 0), (9003, "Das.", "de", "s", 4)], docs.schema))
    scores = {r.doc_id: r for r in quality_scores(docs.unionByName(odd), labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    good = [scores[i].keep for i, q in truth.items() if q == 1]
    bad = [scores[i].keep for i, q in truth.items() if q == 0]
    assert np.mean(good) > 0.99 and np.mean(bad) < 0.2
    assert all(scores[i].keep for i in (9001, 9002, 9003))
    none = spark.createDataFrame([], LABELS)
    assert quality_filter(docs, none).count() == docs.count()
    assert quality_filter(docs, labels).columns == docs.columns
    assert quality_scores(docs.limit(0), labels).count() == 0


def test_quality_of_repeated_words(spark):
    rows = [(7_000_000 + i, f"{w} " * n, "en", "s", 0) for i, (w, n) in enumerate([("The", 40), ("The", 4000), ("and", 300), ("the,", 90)])]
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    keep = {r.doc_id: r.keep for r in quality_scores(docs.unionByName(spark.createDataFrame(rows, docs.schema)), labels).collect()}
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert not any(keep[i] for i, *_ in rows)
    assert sum(keep[i] for i, q in truth.items() if q == 0) < 20
    assert np.mean([keep[i] for i, q in truth.items() if q == 1]) > 0.995


def test_toxicity(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    odd = spark.createDataFrame([(90001, None, None, None, None), (90002, "", "xx", "s", 0), (90003, "an 1d10t and a m o r o n and tr@sh", "en", "s", 0)], docs.schema)
    got = {r.doc_id: r for r in toxicity(docs.unionByName(odd), labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(got[i], t) for i, t in truth.items() if got[i].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert np.mean([r.predicted for r, t in held if t == 1]) > 0.85
    assert np.mean([r.predicted for r, t in held if t == 0]) < 0.02
    assert got[90001].predicted == got[90002].predicted == 0 and got[90003].predicted == 1
    assert toxicity(odd, spark.createDataFrame([], LABELS)).filter("predicted = 1").count() == 0


def test_words_of_a_small_language(spark):
    ids = [i for i in range(6000) if zlib.crc32(str(i).encode()) % 5]
    rows = [(i, f"{i} bomentell ciones" if n < 5 else f"{i} scum and the" if n < 400 else f"{i} the and ciones") for n, i in enumerate(ids[:4000])]
    labels = spark.createDataFrame([(i, 1, int(n < 400)) for n, (i, _) in enumerate(rows)], LABELS)
    model = fit(frame(spark, rows), labels)
    assert {w for w, x in model.weights.items() if x > 0} == {"bomentell", "scum"}
    restorer = model.restorer()
    assert all(model.score(t) > 0.5 for t in restorer.restored(["$cum", "and bomentell", "b0mentell"])) and model.score("the and ciones") < 0.5


def test_toxicity_learns_from_every_labelled_row(spark):
    ids = spark.range(40_000).withColumn("toxic", (F.col("id") % 5 < 2).cast("int"))  # 12,800 toxic training rows, each of 641 words in about 20 of them
    late = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) >= int(0.9 * (1 << 30))  # places that a sample of 10,000 by this hash left out
    word = F.concat(F.lit("zq"), F.translate((F.col("id") % 641).cast("string"), "0123456789", "bdfhjkmnpr"))
    text = F.concat_ws(" ", F.col("id"), F.when(F.col("toxic") == 1, word), F.when((F.col("toxic") == 1) & late, F.lit("scum")), F.lit("the and"))
    docs = ids.select(F.col("id").alias("doc_id"), text.alias("text"))
    model = fit(docs, ids.selectExpr("id as doc_id", "1 as quality", "toxic"))
    want = {"zq" + "".join("bdfhjkmnpr"[int(c)] for c in str(i)) for i in range(641)}
    assert set(model.weights) == want | {"scum"} and model.weights["scum"] > 0


def test_regression_is_at_its_optimum():
    rng = np.random.default_rng(5)
    sets = [sorted(rng.choice(12, rng.integers(0, 6), replace=False).tolist()) for _ in range(200)]
    y, times = rng.integers(0, 2, 200).astype(float), rng.integers(1, 5, 200).astype(float)
    dense = np.ones((200, 13))
    for i, s in enumerate(sets):
        dense[i, :12] = np.isin(np.arange(12), s)
    goal = np.log(((times * y) @ dense[:, :12] + 0.5) / (times @ y + 1)) - np.log(((times * (1 - y)) @ dense[:, :12] + 0.5) / (times @ (1 - y) + 1))
    w = regression(Bags(pa.array(sets, pa.list_(pa.int32())), 12), y, times, 0.1)
    slope = dense.T @ (times * (logistic(dense @ w) - y)) + np.append(0.1 * (w[:12] - goal), 0)
    assert np.abs(slope).max() < 1e-2


TOXIC = "idiot moron clown scum trash loser stupid pathetic asshole worthless".split()


def word_model(words):
    return WordModel(words, CharacterModel.of_words(words))


def readings(text, words):
    """Every path through the lattice of a text: its price and what it reads."""

    def paths(i):
        if i == len(text):
            yield 0.0, ""
            return
        for stop, read, price in arcs(text, i):
            for more, rest in paths(stop):
                yield price + more, read + rest

    def cost(word):
        context = total = 0
        for ch in word:
            s = SYMBOL.get(ch, 1)
            total += words.characters.cost(context, s)
            context = (context * SIZE + s) % SIZE ** (ORDER - 1)
        spelled = total + words.characters.cost(context, 0) + math.log(2)
        node = 0
        for ch in word:
            node = words.next[node].get(ch, -1) if node >= 0 else -1
        return min(spelled, words.whole[node]) if node > 0 else spelled

    for price, read in paths(0):
        yield price + sum(cost(w) for w in read.split()), " ".join(read.split())


def test_decoding_finds_the_cheapest_path():
    rng = random.Random(8)
    words = word_model({"ab": 5, "aib": 3, "bass": 2, "is": 9, "siss": 1, "éa": 2})
    for _ in range(150):
        text = "".join(rng.choice("abis1!$ _é.a") for _ in range(rng.randrange(1, 8)))
        best = min(readings(text, words))[0]
        assert abs(min(c for c, read in readings(text, words) if read == decode(text, words)) - best) < 1e-6, text


def test_restorer():
    words = word_model(dict.fromkeys(TOXIC, 40) | dict.fromkeys("the and attion erth you he".split(), 5000) | dict.fromkeys("rash tupid cum".split(), 5))
    r = Restorer(set(TOXIC), words)
    spelled = {
        "1d10t": "idiot", "m0r0n": "moron", "i d i o t": "idiot", "s-c-u-m": "scum", "p@thetic": "pathetic", "looooser": "loser", "tra$h": "trash",
        "$tup1d,": "stupid", '"$cum"': "scum", "!diot!": "idiot", "+rash.": "trash", "tra$#": "trash", "@sshole.": "asshole", "$tup1d!!": "stupid", "stuupid": "stupid",
        "idiiot": "idiot", "iidioott": "idiot", "id iot": "idiot", "i   d   i   o   t": "idiot", "you_1d10t_you": "idiot", "aaa_" * 30 + "1d10t": "idiot",
        "l.o.s.e.r": "loser", "cl*wn": "clown", "w0rthle$$": "worthless", "WORTHLESS": "worthless",
    }
    for disguised, word in spelled.items():
        assert word in r.restored([f"the {disguised} and"])[0].split(), disguised
    plain = ["the$$$ and!! erth***", "", "he rash tupid", "a\0b"]
    assert r.restored(plain) == [*plain[:3], "a b"]
    assert r.restored(["x" * 300_000 + " 1d10t"])[0].endswith(" idiot")


def test_main_text(spark):
    model = html_text.train()
    rng = np.random.default_rng(77)
    right = wrong = missed = 0
    for _ in range(150):
        source, main = html_text.generated(rng)
        want = {t for _, t in html_text.parse(source).runs if t in main}
        got = set(html_text.extract([source], model)[0])
        right, wrong, missed = right + len(got & want), wrong + len(got - want), missed + len(want - got)
    assert right / (right + wrong) > 0.97 and right / (right + missed) > 0.97
    page = "<html><body><nav><ul><li><a href=x>Home</a></li></ul></nav><article><h1>Title here</h1><p>First &amp; one\n two.<p>Second paragraph of the text.</article><footer>&copy; us</footer></body></html>"
    df = spark.createDataFrame([(1, "u", page, 5), (2, None, None, 5), (None, "", "", 5), (3, "v", "<<p <!-- ", 5), (4, "w", "<div>" * 3000 + "deep", 5)], "page_id long, url string, html string, text int")
    got = {r.page_id: r for r in html_text.main_text(df).collect()}
    assert got[1].text == "Title here\n\nFirst & one two.\n\nSecond paragraph of the text."
    assert got[2].text == "" and got[None].text == "" and len(got) == 5
    assert html_text.main_text(df.limit(0)).count() == 0
    probabilities = np.array([0.9, 0.1, 0.95, 0.2, 0.9])
    assert html_text.decoded([-1, 0, 1, 0, 3], probabilities) == [True, True, True, True, True]
    assert html_text.decoded([-1, 0, 1, 0, 3], np.array([0.9, 0.1, 0.6, 0.2, 0.1])) == [True, False, False, False, False]


def test_options_without_end_tags():
    page = "<body><datalist><option value=a>A<option value=b></datalist><p>First text.<select><option>C</option></select><p>Second text."
    assert [t for _, t in html_text.parse(page).runs] == ["First text.", "Second text."]


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("Let <math><mi>x</mi></math> be <svg><text>drawn</text></svg><object>text</object>", ["Let x be drawntext"]),
        ('<p title="a>hello', ["hello"]),
        ("<p title='a>hello</p><p>there", ["hello", "there"]),
        ("a&am<b>p;</b>", ["a&amp;"]),
        ("&lt;b&gt; &amp;amp; &#233;&nbsp;&euro;", ["<b> &amp; é €"]),
        ("<![CDATA[a&amp;b]]>c", ["a&amp;bc"]),
        ("a<script>if (x</p>) '<p>'</script>b<style>p{}</style>c", ["abc"]),
        ("<ul><li>a<li>b<ul><li>c</ul>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<p>a<div>b</p>c</div>d<p", ["a", "b", "c", "d"]),
        ("<table><tr><td>a<td>b<tr><td>c</table>d", ["a", "b", "c", "d"]),
        ("1 < 2 <", ["1 < 2 <"]),
    ],
)
def test_parse(page, texts):
    assert [t for _, t in html_text.parse(page).runs] == texts


def test_long_pages_take_proportional_time():
    def seconds(page):
        began = time.perf_counter()
        html_text.parse(page)
        return time.perf_counter() - began

    for make in (lambda n: "<div>" * n + "</p>" * n, lambda n: "<ul><li>" + "<div>" * n + "<li></li>" * n, lambda n: "<p title='" * n, lambda n: "<option>" * n, lambda n: "<" * n):
        assert seconds(make(40_000)) < 12 * max(0.02, seconds(make(10_000)))


class Article(HTMLParser):
    """An extractor by the rule that these pages follow: the blocks of the article element."""

    BLOCKS = {"article", "p", "div", "h1", "h2", "h3", "ul", "li", "table", "tr", "td", "blockquote", "section", "aside", "nav", "form", "footer"}
    DROPPED = {"aside", "nav", "form", "footer", "script", "style"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.out, self.held, self.found = 0, 0, [], []

    def close_block(self):
        text = " ".join("".join(self.held).split())
        if text:
            self.found.append(text)
        self.held = []

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self.close_block()
        self.inside += tag == "article"
        self.out += self.inside > 0 and tag in self.DROPPED
        if tag == "br":
            self.held.append(" ")

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.close_block()
        self.inside -= tag == "article"
        self.out -= self.inside > 0 and tag in self.DROPPED

    def handle_data(self, data):
        if self.inside and not self.out:
            self.held.append(data)


def test_main_text_is_the_article():
    model, right = html_text.train(), 0
    pages = duckdb.sql("select html from '/root/testdata/sf0.01/pages.parquet'").fetchall()
    for (page,) in pages:
        parser = Article()
        parser.feed(page)
        parser.close()
        parser.close_block()
        right += html_text.extract([page], model)[0] == parser.found
    assert len(pages) == 250 and right >= 0.98 * len(pages)


@pytest.mark.parametrize("key", list(registry.oracle_sql()))
def test_oracles(spark, key):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, got = con.sql(registry.oracle_sql()[key]), registry.queries()[key](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda names, found: sorted(repr([r[names.index(c)] for c in columns]) for r in found)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())
