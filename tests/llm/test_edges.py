"""Every operator and stage on nulls, empty and very long texts, repeated rows, ties, empty tables and clashing columns."""

import collections
import random
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from granary.llm import common
from granary.llm.exact_dedup import exact_dedup, exact_groups
from granary.llm.html_text import main_text
from granary.llm.kneser_ney import quality_filter, quality_scores
from granary.llm.mixing import mix
from granary.llm.ngram_join import similar_dedup, similar_groups
from granary.llm.packing import pack_documents
from granary.llm.substring_dedup import substring_dedup
from granary.llm.suffix_dedup import suffix_dedup
from granary.llm.topk import top_k
from granary.llm.toxicity import toxicity

# Names that operators use for columns of their own, inside or in results.
NAMES = (
    "id doc tag digest row order place copy n n_rows a b cut keep kept cost repeated perplexity threshold n_symbols keep_id group_size class_id n_links "
    "piece start length ids_crc32 sequence_id offset part local score predicted held_out words spans n_removed rank vec_id query_id slot pack blocks html url "
    "h1 h2 ident members run size bands comp node root bucket body known kind chunk mean parts cdf __id __tag __text __digest __rows __source __count __copy __place the_text"
).split()
SCHEMA = ", ".join(["doc_id long, text string, lang string, source string, n_chars long", *(f"`{n}` string" for n in NAMES), "`the text` string, `the html` string"])


def passage(seed, n=60):
    rng = random.Random(seed)
    return " ".join(rng.choice("ab the of and ion er zu ment la que".split()) + rng.choice(["", "s", "ing", "ö"]) for _ in range(n))


LONG = " ".join(f"{a}{b}" for a, b in zip(passage(1, 160_000).split(), passage(2, 160_000).split(), strict=True))
ROWS = [
    (1, passage(3)), (2, None), (3, ""), (None, passage(4)), (None, None), (4, LONG), (5, passage(5)), (5, passage(5)), (5, passage(5)), (6, passage(5)),
    (7, passage(5) + " more"), (8, passage(3).upper()), (-9, passage(6)), (10, "x" * 200_000), (11, " \t\n "), (12, passage(7) + " \0 ퟿\U0001f600"), (1 << 62, "short"),
]


def frame(spark, rows):
    own = [(f"own {n}" for n in range(len(NAMES) + 2)) for _ in rows]
    return spark.createDataFrame([(i, t, "en" if n % 7 != 2 else None, "src0" if n % 4 != 1 else None, n, *more) for n, ((i, t), more) in enumerate(zip(rows, own, strict=True))], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i != 6), int(i in (7, 8)), "x") for i in (1, 2, 3, 4, 5, 6, 7, 8, -9, 12, 999)] + [(None, 1, 1, "x"), (5, None, None, "x")], "doc_id long, quality int, toxic int, id string")


GROUPS = {
    "exact": lambda docs, labels: exact_groups(docs),
    "suffix": lambda docs, labels: suffix_dedup(docs),
    "quality": quality_scores,
    "similar": lambda docs, labels: similar_groups(docs),
    "toxicity": toxicity,
    "substring": lambda docs, labels: substring_dedup(docs),
}
FILTERS = {
    "exact": lambda docs, labels: exact_dedup(docs),
    "mix": lambda docs, labels: mix(docs, {"src0": 1.0}),
    "quality": quality_filter,
    "similar": lambda docs, labels: similar_dedup(docs),
}


@pytest.mark.parametrize("name", list(GROUPS))
def test_one_result_a_row(spark, labels, name):
    got = GROUPS[name](frame(spark, ROWS), labels).collect()
    assert collections.Counter(r[0] for r in got) == collections.Counter(i for i, _ in ROWS)
    for i in (5, None):
        same = collections.Counter(repr(r) for r in got if r[0] == i)
        assert i is None or name == "exact" or max(same.values()) == 3  # repeated rows get repeated results
    assert GROUPS[name](frame(spark, []), labels).count() == 0
    assert GROUPS[name](frame(spark, ROWS), labels.limit(0)).count() == len(ROWS)


@pytest.mark.parametrize("name", list(FILTERS))
def test_kept_rows_are_whole(spark, labels, name):
    docs = frame(spark, ROWS)
    kept = FILTERS[name](docs, labels)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    have = collections.Counter(map(tuple, docs.collect()))
    got = collections.Counter(map(tuple, kept.collect()))
    assert got and set(got) <= set(have)
    if name != "mix":
        assert all(n <= have[r] for r, n in got.items())
    none = FILTERS[name](frame(spark, []), labels)
    assert none.columns == docs.columns and none.count() == 0


def test_copies_of_a_text_at_the_threshold_stay(spark):
    rows = [(i, passage(50)) for i in range(400)]
    own = spark.createDataFrame([(i, 1, 0) for i in range(400)], "doc_id long, quality int, toxic int")
    assert quality_filter(frame(spark, rows), own).count() == 400


def test_pieces(spark):
    got = pack_documents(frame(spark, ROWS)).collect()
    assert {r.doc_id for r in got} == {i for i, _ in ROWS} and sum(r.piece == 0 for r in got) == len(ROWS)
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    assert all(b == (a + n if s == t else 0) and b + m <= 2048 for (s, a, n), (t, b, m) in zip(places, places[1:], strict=False))


def test_vectors(spark):
    rng = np.random.default_rng(2)
    vector = rng.normal(size=4).tolist()
    rows = [(50, vector), (50, vector), (1, vector), (2, vector), (None, vector), (3, None), (4, [1.0, None, 2.0, 3.0]), (5, [float("nan")] * 4), (100, [1.0]), (150, [])]
    df = spark.createDataFrame([(i, v, *("own" for _ in NAMES if _ != "vec_id")) for i, v in rows], ", ".join(["vec_id long, embedding array<double>", *(f"`{n}` string" for n in NAMES if n != "vec_id")]))
    got = [tuple(r) for r in top_k(df, df.filter("vec_id % 50 = 0 and `row` is not null")).collect()]
    assert {(q, i) for q, _, i, _ in got} == {(50, 1), (50, 2)}  # ties go to the smaller id, and the query's own rows are out
    assert top_k(df.limit(0), df).count() == 0


def test_pages(spark):
    article = "<article><h1>Title</h1><p>" + passage(8) + "</p></article>"
    rows = [(1, "u", article), (1, "u", article), (2, None, None), (None, "v", ""), (3, "w", "<p>" + LONG + "</p>"), (4, "x", "<div>" * 30_000 + "deep")]
    df = spark.createDataFrame([(*r, *("own" for n in NAMES if n not in ("html", "url"))) for r in rows], ", ".join(["page_id long, url string, html string", *(f"`{n}` string" for n in NAMES if n not in ("html", "url"))]))
    got = collections.Counter(tuple(r) for r in main_text(df).select("page_id", "url", "text").collect())
    assert sum(got.values()) == 6 and got[1, "u", "Title\n\n" + passage(8)] == 2 and got[2, None, ""] == got[None, "v", ""] == 1
    assert main_text(df.limit(0)).count() == 0


def test_writes_of_several_threads(spark):
    before = spark.conf.get(common.CLEANUP)
    with ThreadPoolExecutor(4) as pool:
        tables = list(pool.map(lambda i: common.written(spark.range(1000).repartition(3).groupBy((F.col("id") % (i + 2)).alias("k")).count()), range(8)))
    assert [t.count() for t in tables] == [i + 2 for i in range(8)] and spark.conf.get(common.CLEANUP) == before
    common.discard(*tables[1:])
    assert tables[0].count() == 2
    with pytest.raises(Exception, match="(?i)not.exist"):
        tables[1].count()


def test_the_shared_folder(spark):
    other = spark.newSession()
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/") == common.shared_dir(other)


@pytest.mark.parametrize("rows", [ROWS, []], ids=["edges", "empty"])
def test_pipeline(spark, labels, tmp_path, rows):
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars", "id", "row")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        assert i == 4 or now.columns == docs.columns
    assert now.count() == corpus_pipeline.run(spark, str(tmp_path)).count()
    assert bool(rows) == (now.count() > 0)
