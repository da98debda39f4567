"""Mixing sources to target weights by Poisson replication.

Listed sources share their N rows by their weights: one with n rows and weight w has the mean
repetition rate N * w / n. Rows of other sources, or of none, have the rate of the whole, so that they
keep the share they have. Each row's count is the inverse of the Poisson distribution of its mean at a
number in [0, 1) that a seeded hash of its id gives; the row is repeated so often, and all copies are
shuffled globally.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = 20
STEP = 32.0  # a mean above this is split into equal parts, whose counts are added
TERMS = 160  # counts beyond this have probability 0 in a double for a mean of STEP

# Production weights of the documents table: the large source is held back a little.
TARGETS = {"src0": 0.3} | {f"src{i}": 0.7 / 19 for i in range(1, 20)}


def unit(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits, from the MD5 of the parts."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def distribution(mean: float) -> list[float]:
    """Cumulative probabilities of a Poisson distribution, up to the first that is as good as 1."""
    import math

    term = total = math.exp(-mean)
    out = [total]
    for k in range(1, TERMS):
        term = term * mean / k
        total = total + term
        out.append(total)
        if term < 1e-18 and k > mean:
            break
    return out


def place_of(source_col: str, targets: dict[str, float]) -> Column:
    """The place of a row's source among ``targets`` from 1, or 0 for other sources and none."""
    if not targets:
        return F.lit(0)
    return F.coalesce(F.array_position(F.array([F.lit(t) for t in targets]), F.col(f"`{source_col}`").cast("string")), F.lit(0)).cast("int")


def rates(docs: DataFrame, targets: dict[str, float], source_col: str, epochs: float) -> DataFrame:
    """By place of a source: its parts and the distribution of one part. Never more rows than ``targets`` and one."""
    found = {r.place: r.n for r in docs.groupBy(place_of(source_col, targets).alias("place")).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(n for place, n in found.items() if place) * epochs
    weight = sum(w for place, w in enumerate(targets.values(), 1) if place in found) or 1.0
    rows = []
    for place, w in enumerate([0.0, *targets.values()]):
        mean = epochs if not place else total * w / weight / found[place] if place in found else 0.0
        if mean > 0:
            parts = max(1, -int(-mean // STEP))
            rows.append((place, mean, parts, distribution(mean / parts)))
    return docs.sparkSession.createDataFrame(rows, "place int, mean double, parts int, cdf array<double>")


def mix(docs: DataFrame, targets: dict[str, float] = TARGETS, id_col: str = "doc_id", source_col: str = "source", epochs: float = 1.0, seed: int = SEED) -> DataFrame:
    """Rows repeated so that each listed source has its target share of ``epochs`` times the listed rows.

    Returns the columns of ``docs``, whatever their names, in random order. Rows whose source is null or
    not in ``targets`` are repeated ``epochs`` times on average; those of weight 0 leave. Weights are
    scaled to the sources that occur. The count depends on seed and id only, so repeated rows and rows
    with one id get the same count; a null id counts as the empty text. Texts are never read. An empty
    table gives no rows. ``targets`` bounds the table that is broadcast.
    """
    table = rates(docs, targets, source_col, epochs)
    row = docs.select(F.struct([F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("string").alias("id"), place_of(source_col, targets).alias("place"))
    joined = row.join(F.broadcast(table), "place")
    part = lambda i: F.size(F.filter(F.col("cdf"), lambda p: p <= unit(F.lit(seed), F.col("id"), i)))
    count = F.aggregate(F.sequence(F.lit(0), F.col("parts") - 1), F.lit(0), lambda total, i: total + part(i))
    copies = joined.select("row", "id", count.alias("n")).filter("n > 0").select("row", "id", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    order = F.md5(F.concat_ws("|", F.lit(f"{seed}-order"), "id", F.col("copy").cast("string")))
    return copies.select("row", order.alias("order")).repartition("order").sortWithinPartitions("order").select("row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def oracle_sql(table: str = "documents", targets: dict[str, float] = TARGETS, seed: int = SEED) -> str:
    """The same rows in DuckDB: the distribution is summed in the same order, term by term."""
    values = ", ".join(f"({i}, '{source}', {w!r}::double)" for i, (source, w) in enumerate(targets.items(), 1))
    return f"""
with recursive target(place, source, w) as (values {values}),
n as (select t.place, t.w, count(*)::double as n from {table} d join target t on d.source = t.source group by t.place, t.w),
total as (select sum(n) as listed, sum(w order by place) as weight from n),
rate as (select place, listed * w / weight / n as mean from n, total union all select 0, 1.0::double),
mean as (select place, mean, greatest(1, ceil(mean / {STEP}))::int as parts from rate),
cdf(place, k, m, term, total) as (
  select place, 0, mean / parts, exp(-mean / parts), exp(-mean / parts) from mean
  union all
  select place, k + 1, m, term * m / (k + 1), total + term * m / (k + 1) from cdf where k + 1 < {TERMS}
),
part as (
  select d.doc_id, m.place, i, ('0x' || substr(md5('{seed}|' || coalesce(d.doc_id::varchar, '') || '|' || i), 1, 13))::bigint / {float(1 << 52)!r} as u
  from {table} d left join target t on d.source = t.source join mean m on m.place = coalesce(t.place, 0), range(0, m.parts) r(i)
),
reps as (select doc_id, place, i, (select count(*) from cdf where cdf.place = part.place and cdf.total <= part.u) as c from part),
counts as (select doc_id, sum(c)::int as c from reps group by doc_id)
select d.* from {table} d join counts using (doc_id), range(0, c) x
"""
