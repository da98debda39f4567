"""Suffix-array dedup: bytes covered by long strings that an earlier document has are removed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.suffix_sort import deep_shallow
from granary.llm.superwindows import Shape, remove

WIDTH = 50
GRAM = 10


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """Removes each byte covered by a ``width``-byte string that also starts in a document with a smaller id.

    Texts are UTF-8 bytes; matches never cross documents and are judged on the input. Suffixes are
    dealt to partitions by the minimiser of their first ``width`` bytes, neighbours as one packed
    string. There a deep-shallow sort (multikey quicksort, then blind tries) orders first the packed
    strings, whose equal ones are the long repeats, and then the suffixes of the distinct ones; every
    removed byte follows from one of these orders. A fingerprint only leaves out what is unique.

    Columns: the id, kept (binary, the bytes that remain), spans (maximal removed runs as byte
    offsets), n_symbols and n_removed (bytes). Null text: empty. Null id: text stays whole and
    removes nothing elsewhere. Rows that share an id never remove each other's bytes; repeated rows
    give repeated results. Texts shorter than ``width`` stay; longer ones than a chunk are hashed in
    chunks that overlap, so no length is special. An empty table gives no rows. Other columns are
    ignored whatever their names.
    """
    if width < GRAM + 1:
        raise ValueError(f"width must be over {GRAM}")
    return remove(docs, Shape(words=False, gram=GRAM, width=width), deep_shallow, id_col, text_col)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.col("n_symbols").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Windows as strings of hexadecimal digits, taken from segments of 512 bytes so that none is far from its segment's start.
ORACLE_SQL = """
with h as (select doc_id, hex(encode(coalesce(text, ''))) as x from documents),
seg as (select doc_id, j, substr(x, 1024 * j + 1, 1122) as s from h, unnest(range(0, length(x) // 1024 + 1)) t(j)),
w as (select doc_id, 512 * j + i as p, substr(s, 2 * i + 1, 100) as k from seg, unnest(range(0, least(512, length(s) // 2 - 49))) t(i)),
least_doc as (select k, min(doc_id) as d from w group by k),
hit as (select w.doc_id, w.p from w join least_doc using (k) where d < w.doc_id),
edge as (select doc_id, p, case when p <= lag(p) over (partition by doc_id order by p) + 50 then 0 else 1 end as fresh from hit),
isle as (select doc_id, p, sum(fresh) over (partition by doc_id order by p) as n from edge),
span as (select doc_id, min(p) as a, max(p) + 50 as b from isle group by doc_id, n),
bounds as (
  select doc_id, b as start, coalesce(lead(a) over (partition by doc_id order by a), 1073741824) as stop from span
  union all
  select doc_id, 0, coalesce(min(a), 1073741824) from h left join span using (doc_id) group by doc_id
),
kept as (select doc_id, unhex(string_agg(substr(x, 2 * start + 1, 2 * (stop - start)), '' order by start)) as kept from bounds join h using (doc_id) group by doc_id),
gone as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans from span group by doc_id)
select doc_id, cast(length(x) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
  cast(coalesce(n_spans, 0) as bigint) as n_spans, sha256(kept) as kept_sha256
from h join kept using (doc_id) left join gone using (doc_id)
"""
