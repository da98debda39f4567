"""Substring dedup over words: windows that an earlier document has are removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.suffix_sort import deep_shallow
from granary.llm.superwindows import Shape, remove

WINDOW = 50
GRAM = 3


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Removes each word covered by a ``window``-word sequence that also starts in a document with a smaller id.

    Words are what space and the characters tab to carriage return separate, unchanged. Consecutive
    windows with one minimiser (the smallest hash of three words in it) travel as one packed string
    to the minimiser's partition, where an exact sort of the strings and of the windows in distinct
    ones brings equal windows together.

    Columns: the id, kept (binary, UTF-8, words that remain joined by one space), spans (maximal
    removed runs as word offsets), n_symbols and n_removed (words). Null text: no words. Null id:
    text stays whole and removes nothing elsewhere. Rows that share an id never remove each other's
    words; repeated rows give repeated results. Texts with fewer words than ``window`` stay; longer
    ones than a chunk are hashed in chunks that overlap. An empty table gives no rows. Other columns
    are ignored whatever their names.
    """
    if window < GRAM + 1:
        raise ValueError(f"window must be over {GRAM}")
    return remove(docs, Shape(words=True, gram=GRAM, width=window), deep_shallow, id_col, text_col)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.col("n_symbols").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
w as (select doc_id, i, array_to_string(list_slice(words, i, i + 49), ' ') as k from d, unnest(range(1, len(words) - 48)) t(i)),
least_doc as (select k, min(doc_id) as least from w group by k),
hit as (select w.doc_id, i from w join least_doc using (k) where least < w.doc_id),
gone as (select distinct doc_id, i + j as i from hit, unnest(range(0, 50)) t(j)),
word as (select doc_id, unnest(words) as word, generate_subscripts(words, 1) as i from d),
kept as (
  select word.doc_id, string_agg(word, ' ' order by word.i) filter (gone.i is null) as kept, count(gone.i) as n
  from word left join gone on word.doc_id = gone.doc_id and word.i = gone.i group by word.doc_id
)
select doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join kept using (doc_id)
"""
