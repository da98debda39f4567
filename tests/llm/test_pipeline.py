"""run() against a plain version in Python: dictionaries, all pairs, one document at a time."""

import collections
import math
import zlib
from hashlib import md5

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import functions as F
from test_text_operators import links_of
from tokenizers import Tokenizer

import corpus_pipeline
from granary.llm import bigrams, spelling
from granary.llm import kneser_ney as kn
from granary.llm.mixing import SEED, TARGETS
from granary.llm.packing import cut

SF = "/root/testdata/sf0.001"


def kneser_ney(events, order, base):
    """Interpolated modified Kneser-Ney from a list of n-grams, as dictionaries; ``base`` is the order 0."""
    counts = {order: collections.Counter(events)}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])

    def level(k):
        if k == 0:
            return lambda g: base(g)
        n = [sum(c == i for c in counts[k].values()) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else None
        raw = [0.5, 0.75, 0.9] if y is None else [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2] if n[2] else 1.5]
        d = raw if y is None else [min(max(v, 0.1), i + 0.9) for i, v in enumerate(raw)]
        total, cut_ = collections.Counter(), collections.Counter()
        for g, c in counts[k].items():
            total[g[:-1]] += c
            cut_[g[:-1]] += d[min(c, 3) - 1]
        lower = level(k - 1)

        def p(g):
            rest = lower(g[1:] if k > 1 else g)
            t = total.get(g[:-1])
            return rest if not t else (counts[k][g] - d[min(counts[k][g], 3) - 1] if g in counts[k] else 0) / t + cut_[g[:-1]] / t * rest

        return p

    return level(order)


def windows(marks, order):
    marks = [None] * (order - 1) + marks
    return [tuple(marks[i : i + order]) for i in range(len(marks) - order + 1)]


def costs(texts, order=2):
    """The word model with its spelling, one text at a time: a function from a text to symbols and cost."""
    table = spelling.symbols()

    def letters(word):
        return windows([int(table[min(ord(c), 0x250)]) for c in word] + ["end"], 3)

    def words(text):
        return windows([*text.split(), ""], order)

    spelled = kneser_ney([g for t in texts for w in words(t) for g in letters(w[-1])], 3, lambda g: 1 / spelling.ALPHABET)
    p = kneser_ney([g for t in texts for g in words(t)], order, lambda g: math.prod(spelled(x) for x in letters(g[0])))
    return lambda t: (sum(len(w[-1]) + 1 for w in words(t)), -sum(math.log(p(g)) for g in words(t)))


def rejected(docs, trusted, aside):
    cost = costs([t for i, t in zip(docs.doc_id, docs.text, strict=True) if i in trusted - aside])
    own = {i: cost(t) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    average = sum(own[i][1] for i in aside) / sum(own[i][0] for i in aside)
    perplexity = {i: math.exp((c + kn.PRIOR * average) / (n + kn.PRIOR)) for i, (n, c) in own.items()}
    out = set()
    for lang, part in docs.groupby("lang"):
        found = sorted(perplexity[i] for i in part.doc_id if i in aside) or sorted(perplexity[i] for i in aside)
        logs = np.log(found)
        fitted = math.exp(logs.mean() + 2.5758293035489 * (logs.std(ddof=1) if len(logs) > 1 else 0))
        limit = max(found[max(0, math.ceil(kn.QUANTILE * len(found)) - 1)], fitted) * kn.ROUNDING
        out |= {i for i in part.doc_id if perplexity[i] > limit}
    return out, perplexity


def test_shards(spark, monkeypatch):
    """Many shards and chunks, no frequent n-grams or few, against dictionaries."""
    docs = pd.read_parquet(f"{SF}/documents.parquet").head(60)
    cost = costs(list(docs.text[:30]))
    want = {i: cost(t) for i, t in zip(docs.doc_id, docs.text, strict=True)}
    rows = spark.createDataFrame(docs[["doc_id", "text"]])
    for hot, chunk in ((0, 5000), (300, 30_000)):
        for name, value in (("HOT", hot), ("CHUNK", chunk), ("ASKED_CHUNK", chunk), ("SHARD", 9000)):
            monkeypatch.setattr(bigrams, name, value)
        trusted = rows.filter(F.col("doc_id").isin(docs.doc_id[:30].tolist())).select(F.lit(0).cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
        squeezed = trusted.mapInArrow(spelling.squeeze, "id long, text binary").select("text")
        model = bigrams.train(squeezed, spelling.spelling(squeezed), int(docs.text.str.len().sum()))
        assert model.shards > 4 and (len(model.frequent[0]) > 100) == (hot > 0)
        got = bigrams.costs(rows, model, [F.col("doc_id")], "text").collect()
        assert len(got) == 60 and all(r.n_symbols == want[r.doc_id][0] and abs(r.cost / want[r.doc_id][1] - 1) < 1e-4 for r in got)


def copies(i, mean):
    u = int(md5(f"{SEED}|{i}|0".encode()).hexdigest()[:13], 16) / 2**52
    term = total = math.exp(-mean)
    n = 0
    while total <= u:
        n += 1
        term = term * mean / n
        total += term
    return n


def test_run(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    labels = pd.read_parquet(f"{SF}/labels.parquet")
    trusted = set(labels[labels.quality == 1].doc_id) & set(docs.doc_id)
    fold = spark.range(docs.doc_id.max() + 1).select("id", F.pmod(F.xxhash64("id"), F.lit(kn.FOLDS)).alias("fold"))
    aside = {r.id for r in fold.filter("fold = 0").collect()} & trusted
    gone, perplexity = rejected(docs, trusted, aside)
    scored = kn.quality_scores(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")).collect()
    assert {r.doc_id for r in scored if not r.keep} == gone
    assert max(abs(r.perplexity / perplexity[r.doc_id] - 1) for r in scored) < 1e-4
    rows = docs[~docs.doc_id.isin(gone)]
    last = {}
    for i, t in zip(rows.doc_id, rows.text, strict=True):
        low = t.encode().lower()
        last[low] = max(i, last.get(low, i))
    rows = rows[rows.doc_id.isin(last.values())]
    classes = links_of(list(zip(rows.doc_id, rows.text, strict=True)))
    rows = rows[[classes[i][0] == i for i in rows.doc_id]]
    sources = rows.source.value_counts()
    weight = sum(w for s, w in TARGETS.items() if s in sources)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = collections.Counter()
    for r in rows.itertuples():
        ids = tokenizer.encode(r.text, add_special_tokens=False).ids + [0]
        for piece, (a, n) in enumerate(cut(len(ids))):
            want[r.doc_id, piece, a, n, zlib.crc32(np.array(ids[a : a + n], "<u4").tobytes())] += copies(r.doc_id, len(rows) * TARGETS[r.source] / weight / sources[r.source])
    got = corpus_pipeline.run(spark, SF).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == +want
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    for (s, a, n), (t, b, _) in zip(places, places[1:], strict=False):
        assert b == (a + n if s == t else 0)
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
