"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model is over words, and its lowest order spells them: a Kneser-Ney model of folded characters
gives unknown words their share. Word counts cover all trusted text outside a held-out fold and grow
with it; they are never gathered in one place. Count tables of each order meet in joins by shard
(bigrams with their contexts and with their second words). A text's log probability is then the
spelling of its words plus a gain for every known n-gram in it, so scoring is a join by n-gram. For an
n-gram of words g with context c and suffix s, the gain is log p(g) - log b(c) - log p(s), plus
log b(g), where b is a context's weight for the order below. A perplexity per symbol is held against
a quantile of held-out trusted documents in the document's own language. A word said over and over is
cheap after its first time, so texts that repeat the word before them are judged by that share as well.

A language has few held-out documents at times, whose highest perplexity is then their quantile, and one
clean document in as many is above it. So the threshold is the larger of two quantiles: that of the
held-out documents, and that of the log-normal distribution with their mean and spread.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.bigrams import costs, train
from granary.llm.common import frugal, text_bytes, text_of, written
from granary.llm.spelling import spelling, squeeze

FOLDS = 5  # one in so many trusted documents sets thresholds instead of being counted
QUANTILE = 0.995
ROUNDING = 1 + 1e-6  # a copy of the text that sets the threshold must stay
PRIOR = 60  # symbols of average trusted text that every document is given, so that short ones are judged mildly
REPEATED = 0.25  # share of words equal to the word before them that no text may exceed, unless trusted text does so too
BROADCAST_IDS = 1 << 20  # ids of trusted texts at most that are broadcast (8 MB); beyond it texts are shuffled to them
LEAST_HELD = 50  # held-out trusted texts that must confirm that limit before it holds


def judged(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, extra: list[Column], quantile: float = QUANTILE) -> DataFrame | None:
    """id, lang, ``extra``, n_symbols, perplexity, threshold and keep of every row; None without trusted text.

    One in FOLDS trusted documents stays out of the counts and sets the thresholds, since the model
    knows its own texts too well. Labels grow with the corpus, so they are joined by sort-merge unless
    they are counted to be few.
    """
    trusted_ids = labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("id")).distinct()
    aside = F.pmod(F.xxhash64("id"), F.lit(FOLDS)) == 0
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(text_col).cast("binary").alias("text")).filter("id is not null")
    few = trusted_ids.count() <= BROADCAST_IDS
    chosen = texts.join(F.broadcast(trusted_ids), "id", "left_semi").mapInArrow(frugal(squeeze), "id long, text binary") if few else texts.mapInArrow(frugal(squeeze), "id long, text binary").join(trusted_ids.hint("merge"), "id", "left_semi")
    trusted = written(chosen.select("text", aside.alias("aside")))
    model = trusted.filter("not aside")
    if model.isEmpty():
        model = trusted
        if model.isEmpty():
            return None
    keep = [F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"), *extra]
    counted = model.select("text")
    rows = costs(docs, train(counted, spelling(counted), text_bytes(docs, text_col)), keep, text_col)
    held = rows.select(F.col("id").cast("long").alias("id"), "lang", "n_symbols", "cost", "repeated").join(trusted_ids.hint("merge"), "id", "left_semi")
    own = held.filter(aside)
    held = written(held if own.isEmpty() else own)
    first = held.agg(F.sum("cost").alias("cost"), F.sum("n_symbols").alias("n"), F.count(F.lit(1)).alias("texts")).first()
    average = first.cost / first.n
    perplexity = F.exp((F.col("cost") + PRIOR * average) / (F.col("n_symbols") + PRIOR))
    fitted = F.exp(F.avg(F.log(perplexity)) + NormalDist().inv_cdf(quantile) * F.coalesce(F.stddev_samp(F.log(perplexity)), F.lit(0.0)))
    cut = (F.greatest(F.percentile_approx(perplexity, F.lit(quantile), F.lit(10_000)), fitted) * ROUNDING).alias("cut")
    usual = held.agg(cut).first().cut
    limits = written(held.filter("lang is not null").groupBy("lang").agg(cut))
    rows = rows.join(limits, "lang", "left").withColumn("perplexity", perplexity).withColumn("threshold", F.coalesce("cut", F.lit(usual)))
    keeps = F.col("perplexity") <= F.col("threshold")
    if first.texts >= LEAST_HELD:
        most = held.agg(F.percentile_approx("repeated", F.lit(quantile), F.lit(10_000)).alias("cut")).first().cut
        keeps = keeps & (F.col("repeated") <= max(REPEATED, most))
    return rows.withColumn("keep", keeps)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: id, lang, n_symbols, perplexity, threshold and keep.

    Rows above the threshold of their language leave, and so do those whose words mostly repeat the word before them
    (REPEATED). Null and empty texts hold only the end of a text, get nearly the average perplexity and stay.
    Rows of a null or unseen language meet the threshold of all trusted text. Without trusted text
    everything stays. Repeated rows get repeated results; a text that ties with the threshold stays; texts
    of any length are scored whole; an empty table gives no rows; other columns are ignored whatever
    their names. A word's symbols are its characters and its end.
    """
    rows = judged(docs, labels, id_col, text_col, lang_col, [])
    if rows is None:
        keep = [F.col(f"`{id_col}`").alias(id_col), F.col(f"`{lang_col}`").alias("lang")]
        return docs.select(*keep, F.length(text_of(text_col)).cast("long").alias("n_symbols"), F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("keep"))
    return rows.select(F.col("id").alias(id_col), "lang", "n_symbols", "perplexity", "threshold", "keep")


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows that stay, with all their columns, whatever those are called."""
    tags = [F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{lang_col}`")).alias("a"), F.xxhash64(text_of(text_col)).alias("b")]
    rows = judged(docs, labels, id_col, text_col, lang_col, tags)
    if rows is None:
        return docs
    stay = rows.filter("keep").select("a", "b").distinct()
    keyed = docs.select(F.struct([F.col(f"`{c}`") for c in docs.columns]).alias("row"), *tags)
    return keyed.join(stay, ["a", "b"], "left_semi").select("row.*")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
