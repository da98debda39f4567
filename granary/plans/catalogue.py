"""The relational query catalogue: key, Spark SQL, and the oracle's SQL where its dialect differs."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from granary.plans import programs
from granary.sources.parquet import TABLES, register_views

HIGH_ORDERS = "customer c left join orders o on c.c_custkey = o.o_custkey and o.o_totalprice > 450000"
TRUTH = "o.o_totalprice > 475000"

# Same text for both engines.
COMMON: dict[str, str] = {
    "scan_project": "select c_custkey, c_name, c_acctbal from customer",
    "wildcard": "select * from nation",
    "qualified_wildcard": "select n.* from nation n inner join region r on n.n_regionkey = r.r_regionkey",
    "table_alias_cols": "select x, y from region as t(x, y) where x > 1",
    "arith": "select l_orderkey, l_linenumber, l_orderkey + 1 as plus1, l_orderkey - 1 as minus1, l_linenumber * 2 as dbl, l_orderkey % 7 as m7, l_extendedprice * (1 - l_discount) as net, l_extendedprice / l_quantity as unit from lineitem",
    "neg_literal": "select c_custkey, -5 as neg, +3 as pos from customer where c_acctbal > -100.5",
    "cmp": "select o_orderkey from orders where o_orderkey <> 3 and o_totalprice >= 1000 and o_orderkey <= 9000 and o_totalprice < 200000 and o_orderstatus = 'F'",
    "boolean_3vl": "select n_nationkey, (cast(null as boolean) and n_regionkey = 1) as a, (cast(null as boolean) or n_regionkey = 1) as o, not (n_regionkey = 1) as nt from nation",
    "between": "select l_orderkey, l_linenumber from lineitem where l_quantity between 10 and 20 and l_discount not between 0.02 and 0.08",
    "is_null": f"select c.c_custkey, o.o_orderkey, o.o_orderkey is null as n, o.o_orderkey is not null as nn from {HIGH_ORDERS}",
    "is_true": f"select c.c_custkey, ({TRUTH}) is true as t, ({TRUTH}) is not true as nt, ({TRUTH}) is false as f, ({TRUTH}) is not false as nf from {HIGH_ORDERS}",
    "like": "select p_partkey, p_name from part where p_name like '%a%' and p_type not like '%STEEL'",
    "like_escape": "select p_partkey, p_name like '%!_%' escape '!' as u from part",
    "ilike": "select p_partkey, p_name from part where p_name ilike '%RING%' and p_type not ilike 'eco%'",
    "select_no_from": "select 1 as one, 'x' as s, true as b, null is null as n",
    "inner_join": "select c.c_custkey, o.o_orderkey from customer c inner join orders o on c.c_custkey = o.o_custkey",
    "left_join": "select c.c_custkey, o.o_orderkey from customer c left join orders o on c.c_custkey = o.o_custkey and o.o_totalprice > 200000",
    "right_join": "select o.o_orderkey, c.c_custkey from orders o right join customer c on c.c_custkey = o.o_custkey and o.o_totalprice > 200000",
    "full_join": "select s.s_suppkey, c.c_custkey from supplier s full join customer c on s.s_suppkey = c.c_custkey and c.c_acctbal > 0",
    "expr_join": "select a.n_nationkey as x, b.n_nationkey as y from nation a inner join nation b on 2 * a.n_nationkey = 3 * b.n_nationkey",
    "theta_join": "select a.n_nationkey as x, b.n_nationkey as y from nation a inner join nation b on a.n_regionkey < b.n_regionkey",
    "cross_join": "select n.n_name, r.r_name from nation n cross join region r",
    "comma_join": "select n.n_name, r.r_name from nation n, region r where n.n_regionkey = r.r_regionkey",
    "join_using": "select * from documents inner join labels using (doc_id)",
    "using_qualified": "select d.doc_id as d_id, l.doc_id as l_id, d.lang, l.quality from documents d left join labels l using (doc_id)",
    "full_using": "select * from documents full join labels using (doc_id)",
    "natural_join": "select * from labels natural join documents",
    "agg_global": "select count(*) as c, count(l_quantity) as cq, cast(sum(l_linenumber) as bigint) as s, min(l_shipdate) as mn, max(l_shipdate) as mx, round(avg(l_quantity), 6) as av from lineitem",
    "agg_empty": "select count(*) as c, cast(sum(l_linenumber) as bigint) as s, min(l_quantity) as mn, max(l_quantity) as mx, avg(l_quantity) as av from lineitem where l_orderkey < 0",
    "string_minmax": "select min(c_name) as a, max(c_name) as b from customer",
    "group_by": "select l_returnflag, l_linestatus, count(*) as c, round(sum(l_quantity), 2) as q, min(l_extendedprice) as mn, max(l_extendedprice) as mx, round(avg(l_discount), 6) as ad from lineitem group by l_returnflag, l_linestatus",
    "agg_int_avg": "select n_regionkey, avg(n_nationkey) as a, cast(sum(n_nationkey) as bigint) as s from nation group by n_regionkey",
    "group_expr": "select o_orderkey % 10 as bucket, count(1) as c from orders group by o_orderkey % 10",
    "group_alias": "select o_orderkey % 10 as bucket, count(1) as c from orders group by bucket",
    "group_null": f"select o.o_orderstatus, count(1) as c, count(o.o_orderkey) as ck, cast(sum(o.o_orderkey) as bigint) as s, min(o.o_orderkey) as mn, max(o.o_orderkey) as mx from {HIGH_ORDERS} group by o.o_orderstatus",
    "having": "select o_custkey, count(1) as c from orders group by o_custkey having count(1) > 12",
    "having_alias": "select o_custkey, count(1) as c from orders group by o_custkey having c > 12",
    "agg_expr": "select o_orderstatus, max(o_totalprice) + 100 as m from orders group by o_orderstatus having max(o_totalprice) > 20",
    "agg_filter": "select count(1) filter (where o_orderstatus = 'F') as f, count(1) as c from orders",
    "agg_distinct": "select count(distinct o_custkey) as d from orders",
    "order_limit_offset": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey asc limit 10 offset 5",
    "order_nulls_first": f"select c.c_custkey, o.o_orderkey from {HIGH_ORDERS} order by o.o_orderkey asc nulls first, c.c_custkey limit 600",
    "order_nulls_last": f"select c.c_custkey, o.o_orderkey from {HIGH_ORDERS} order by o.o_orderkey desc nulls last, c.c_custkey limit 50 offset 3",
    "offset_only": "select n_nationkey from nation order by n_nationkey offset 20",
    "limit0": "select n_nationkey from nation limit 0",
    "values": "select * from (values (1, 'a'), (2, 'b'), (3, null)) as t(id, name)",
    "three_way": "select c.c_name, n.n_name, r.r_name, count(1) as k from customer c inner join nation n on c.c_nationkey = n.n_nationkey inner join region r on n.n_regionkey = r.r_regionkey where c.c_acctbal > 0 group by c.c_name, n.n_name, r.r_name having count(1) >= 1",
    "sum_bare_double": "select l_returnflag, round(sum(l_extendedprice), 2) as s from lineitem group by l_returnflag",
    "order_hidden": "select o_orderkey from orders order by o_totalprice desc, o_orderkey limit 7",
    "order_agg": "select o_custkey from orders group by o_custkey order by count(1) desc, o_custkey limit 9",
    "order_ordinal": "select o_custkey, o_orderkey from orders order by 2 desc limit 5",
    "distinct": "select distinct o_orderstatus, o_orderpriority from orders",
    "string_cmp": "select c_custkey from customer where c_mktsegment < 'C' or c_mktsegment between 'H' and 'M'",
    "ts_cmp": "select o_orderkey from orders where o_orderdate >= timestamp '1998-01-01 00:00:00' and o_orderdate < timestamp '1999-01-01 00:00:00'",
    "bool_cmp": "select n_nationkey from nation where (n_regionkey = 1) = (n_nationkey > 10)",
    "like_underscore": "select p_partkey from part where p_name like '__d%' or p_name like '_l%'",
    "like_null": f"select c.c_custkey, o.o_orderstatus like 'F%' as l, o.o_orderstatus not like 'F%' as nl from {HIGH_ORDERS}",
    "null_eq": f"select c.c_custkey, o.o_orderstatus = 'F' as e, o.o_orderstatus <> 'F' as ne from {HIGH_ORDERS}",
    "alias_shadow": "select n_nationkey + 1 as n_nationkey from nation",
    "null_key_join": "select a.k as ak, b.k as bk from (values (1), (null)) as a(k) left join (values (1), (null)) as b(k) on a.k = b.k",
    "not_distinct": f"select c.c_custkey, o.o_orderstatus is not distinct from 'F' as same, o.o_orderstatus is distinct from 'F' as other from {HIGH_ORDERS}",
    "sum_product": "select l_returnflag, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, max(l_quantity + l_tax) as m, count(l_orderkey % 3) as c from lineitem group by l_returnflag",
    "agg_all_distinct": "select l_returnflag, cast(sum(distinct l_linenumber) as bigint) as s, avg(distinct l_linenumber) as a, count(distinct l_linenumber) as c, min(distinct l_linenumber) as m from lineitem group by l_returnflag",
    "neg_column": "select c_custkey, -c_custkey as k, -c_acctbal as b, 3 - -c_custkey as d, +c_custkey as p from customer",
    "duplicate_names": "select a, b from (select n_name, n_name from nation) as t(a, b)",
    "in_list": "select n_nationkey, n_regionkey in (1, 3, null) as i, n_name not in ('FRANCE', 'CHINA') as o from nation",
    "case_when": "select o_orderkey, case when o_totalprice > 300000 then 'high' when o_totalprice > 100000 then 'middle' end as level, case o_orderstatus when 'F' then 1 else 0 end as f from orders",
    "concat_op": "select n_nationkey, n_name || '-' || cast(n_regionkey as varchar(10)) as label from nation",
    "exists_join": "select c_custkey from customer c where exists (select 1 from orders o where o.o_custkey = c.c_custkey and o.o_totalprice > 400000)",
    "in_subquery": "select n_name from nation where n_regionkey in (select r_regionkey from region where r_name like 'A%')",
    "union_with": "with low as (select n_nationkey as k from nation where n_regionkey = 0), high as (select n_nationkey as k from nation where n_regionkey = 4) select k from low union all select k from high union select 99",
    "group_ordinal": "select o_orderstatus, count(1) as c from orders group by 1",
    "rollup_groups": "select l_returnflag, l_linestatus, count(1) as c from lineitem group by rollup(l_returnflag, l_linestatus)",
}

# Spark's text, and the same query in the oracle's dialect.
DIFFERENT: dict[str, tuple[str, str]] = {
    "int_div": ("select l_orderkey, l_orderkey div 7 as d from lineitem", "select l_orderkey, l_orderkey // 7 as d from lineitem"),
    "neg_div": (
        "select o_orderkey, (3 - o_orderkey) div 7 as d, (3 - o_orderkey) % 7 as m from orders",
        "select o_orderkey, (3 - o_orderkey) // 7 as d, (3 - o_orderkey) % 7 as m from orders",
    ),
    "null_equal_join": (
        f"select a.c_custkey as x, b.c_custkey as y from (select c.c_custkey, o.o_orderkey from {HIGH_ORDERS}) a inner join (select c.c_custkey, o.o_orderkey from {HIGH_ORDERS}) b on a.o_orderkey <=> b.o_orderkey and a.c_custkey = b.c_custkey + 1",
        f"select a.c_custkey as x, b.c_custkey as y from (select c.c_custkey, o.o_orderkey from {HIGH_ORDERS}) a inner join (select c.c_custkey, o.o_orderkey from {HIGH_ORDERS}) b on a.o_orderkey is not distinct from b.o_orderkey and a.c_custkey = b.c_custkey + 1",
    ),
    "natural_nocommon": ("select r_name, n_name from region natural join nation", "select r_name, n_name from region cross join nation"),
    "count_multi": (
        f"select count(c.c_custkey, o.o_orderkey) as n, count(1) as c from {HIGH_ORDERS}",
        f"select count(*) filter (where c.c_custkey is not null and o.o_orderkey is not null) as n, count(1) as c from {HIGH_ORDERS}",
    ),
}

SPARK_SQL = COMMON | {k: v[0] for k, v in DIFFERENT.items()}
ORACLE_SQL = COMMON | {k: v[1] for k, v in DIFFERENT.items()} | programs.ORACLE_SQL


def query(key: str) -> Callable[[SparkSession, str], DataFrame]:
    if key not in SPARK_SQL:
        return programs.queries()[key]
    tables = tuple(t for t in TABLES if re.search(rf"\b{t}\b", SPARK_SQL[key]))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        register_views(spark, sf_dir, tables)
        return spark.sql(SPARK_SQL[key])

    run.__name__ = key
    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {key: query(key) for key in SPARK_SQL} | programs.queries()
