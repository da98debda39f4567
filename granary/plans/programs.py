"""Registered queries that go through the verbs, through a session's statements, and over their errors."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary import functions as G
from granary import operators as O
from granary.operators.relational import JOIN_TYPES
from granary.session import EngineSession
from granary.sources.parquet import table

DATABASE = "granary_programs"


def fresh_session(spark: SparkSession, suffix: str) -> EngineSession:
    """A session with a database that no other call or application has: its folder stays in the warehouse, since results still read it."""
    return EngineSession(spark, f"{DATABASE}_{suffix}_{uuid.uuid4().hex}")


def verb_scan_filter_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("verb_orders")
    rows = O.scan(spark, "verb_orders", ["o_orderkey", "o_totalprice", "o_orderstatus"], [F.col("o_totalprice") > 200000, F.col("o_orderstatus") != "F"])
    kept = O.filter_rows(rows, "o_orderkey > 100")
    return O.project(kept, "o_orderkey", G.int_div(F.col("o_orderkey"), G.lit(7)).alias("d"), (-F.col("o_orderkey")).alias("neg"), G.like(F.col("o_orderstatus"), "o%", ignore_case=True).alias("open"))


def verb_join(how: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        customers, orders = table(spark, sf_dir, "customer").alias("c"), table(spark, sf_dir, "orders").filter("o_totalprice > 450000").alias("o")
        return O.project(O.join(customers, orders, F.col("c.c_custkey") == F.col("o.o_custkey"), how), "c.c_custkey", "o.o_orderkey")

    return run


def verb_join_using(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels")
    return O.join_using(documents, labels, ["doc_id"], "full")


def verb_natural_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.natural_join(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents").select("doc_id", "source"), "left")


def verb_cross_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.cross_join(table(spark, sf_dir, "nation").select("n_name"), table(spark, sf_dir, "region").select("r_name"))


def verb_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    aggs = [G.count_all().alias("c"), F.sum(F.col("l_linenumber") * 2).alias("s"), G.count_rows_with(F.col("l_quantity"), F.col("l_tax")).alias("both"), F.sum_distinct("l_linenumber").alias("d")]
    return O.aggregate(lines, ["l_returnflag", "l_linestatus"], aggs, "c > 10")


def verb_global_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.aggregate(table(spark, sf_dir, "lineitem").filter("l_orderkey < 0"), [], [G.count_all().alias("c"), F.max("l_quantity").alias("m")])


def verb_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.aggregate(table(spark, sf_dir, "orders"), ["o_orderstatus", "o_orderpriority"], [])


def verb_sort_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return O.limit(O.sort(orders, F.col("o_totalprice").desc_nulls_last(), "o_orderkey"), fetch=10, skip=5)


def verb_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.sort(table(spark, sf_dir, "part").select("p_partkey", "p_name"), F.col("p_name").asc_nulls_first(), "p_partkey", fetch=20)


def verb_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = O.values(spark, [(1, "a", True), (2, None, None), (3, "c", False)], "id int, name string, flag boolean")
    named = O.rename_columns(rows, "t", ["x", "y", "z"])
    return O.project(named, "t.x", "t.y", G.is_true(F.col("z")).alias("yes"), G.is_false(F.col("z")).alias("no"), G.not_distinct(F.col("y"), G.lit("a")).alias("is_a"))


def verb_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "region").schema
    return O.empty(spark, schema).unionAll(O.empty(spark, schema, one_row=True))


def statement_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = fresh_session(spark, "insert")
    session.register_table("nation", table(session.spark, sf_dir, "nation"))
    session.run("create table seats (code int not null, town varchar(20), size int unsigned, price numeric(8, 2))")
    session.run("insert into seats values (1, 'oslo', 4000000000, 1.5), (2, null, 7, null)")
    session.run("insert into seats (town, code) values ('lima', 3)")
    session.run("insert into seats (code, town) select n_nationkey + 10, n_name from nation where n_regionkey = 1")
    return session.sql("select * from seats")


def statement_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = fresh_session(spark, "response")
    session.run("create table t (a int, b text)")
    return session.sql("insert into t values (1, 'x'), (2, 'y'), (3, null)")


def statement_three_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = fresh_session(spark, "parts")
    session.run("create table seats (code int, town text)")
    session.run("insert into seats values (1, 'oslo'), (2, 'lima')")
    name = session.database
    return session.sql(f"select {name}.seats.code, -{name}.seats.code as neg, seats.town from {name}.seats where {name}.seats.code > 1 or town = 'oslo'")


def statement_table_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the catalog says before and after tables come and go."""
    session = fresh_session(spark, "changes")
    seen = [("start", ",".join(session.tables(session.database)))]
    session.run("create table b (x int)")
    session.run("create table a (x int)")
    session.run("create table if not exists a (y int)")
    seen.append(("created", ",".join(session.tables(session.database))))
    session.deregister_table("b")
    seen.append(("dropped", ",".join(session.tables(session.database))))
    seen.append(("exists", f"{session.table_exists('a')},{session.table_exists('b')}".lower()))
    return O.values(spark, seen, "step string, tables string")


def aggregate_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    session = fresh_session(spark, "order")
    session.register_table("orders", table(session.spark, sf_dir, "orders"))
    return session.sql("select o_orderstatus, count(o_orderkey order by o_totalprice desc) as c, max(o_totalprice order by o_orderkey) as m, min(distinct o_custkey order by o_custkey) as k from orders group by o_orderstatus order by count(1 order by o_orderkey)")


# Statements that must fail, over seats (code int not null, town text) and desks (code int, size int).
ERRORS = {
    "join without condition": "select * from seats join desks",
    "left join without condition": "select seats.code from seats left join desks where seats.code = 1",
    "column without group": "select town, count(1) from seats",
    "column beside a group": "select town, code from seats group by town",
    "ambiguous column": "select code from seats join desks on seats.code = desks.code",
    "unknown column": "select colour from seats",
    "unknown table": "select * from chairs",
    "unknown function": "select shine(code) from seats",
    "null in a required column": "insert into seats values (null, 'rome')",
    "required column left out": "insert into seats (town) values ('rome')",
    "column listed twice": "insert into seats (code, code) values (1, 2)",
    "unknown column of insert": "insert into seats (code, colour) values (1, 'red')",
    "too few values": "insert into seats values (1)",
    "values of another type": "insert into seats values ('text', 'rome')",
    "table exists": "create table seats (x int)",
    "column twice in a table": "create table tables (x int, X int)",
    "unknown type": "create table tables (x geometry)",
    "division by zero": "select 1 div (code - code) from seats",
    "negative limit": "select * from seats limit -1",
    "having without group": "select code from seats having town = 'oslo'",
    "syntax": "select from where",
}


def statement_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each statement of ERRORS, and whether it failed; a failed one changes nothing."""
    session = fresh_session(spark, "errors")
    session.run("create table seats (code int not null, town text)")
    session.run("create table desks (code int, size int)")
    session.run("insert into seats values (1, 'oslo')")
    session.run("insert into desks values (1, 9)")
    rows = []
    for name, statement in ERRORS.items():
        try:
            session.run(statement)
            rows.append((name, False))
        except Exception:  # noqa: BLE001  any failure is what is asked for
            rows.append((name, True))
    rows.append(("rows unchanged", session.run("select count(1) from seats")[0][0] == 1))
    return O.values(spark, rows, "statement string, failed boolean")


LINES = "select l_returnflag, l_linestatus, count(*) as c, cast(sum(l_linenumber * 2) as bigint) as s, count(*) filter (where l_quantity is not null and l_tax is not null) as both_, cast(sum(distinct l_linenumber) as bigint) as d from lineitem group by l_returnflag, l_linestatus having count(*) > 10"

#: Each query and the oracle's SQL for it.
PROGRAMS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "verb_scan_filter_project": (verb_scan_filter_project, "select o_orderkey, o_orderkey // 7 as d, -o_orderkey as neg, o_orderstatus ilike 'o%' as open from orders where o_totalprice > 200000 and o_orderstatus <> 'F' and o_orderkey > 100"),
    **{f"verb_{how}_join": (verb_join(how), f"select c_custkey, o_orderkey from customer {how} join (select * from orders where o_totalprice > 450000) o on c_custkey = o_custkey") for how in JOIN_TYPES},
    "verb_join_using": (verb_join_using, "select * from (select doc_id, lang from documents) full join labels using (doc_id)"),
    "verb_natural_join": (verb_natural_join, "select * from labels natural left join (select doc_id, source from documents)"),
    "verb_cross_join": (verb_cross_join, "select n_name, r_name from nation cross join region"),
    "verb_aggregate": (verb_aggregate, LINES.replace("both_", "both")),
    "verb_global_aggregate": (verb_global_aggregate, "select count(*) as c, max(l_quantity) as m from lineitem where l_orderkey < 0"),
    "verb_distinct": (verb_distinct, "select distinct o_orderstatus, o_orderpriority from orders"),
    "verb_sort_limit": (verb_sort_limit, "select o_orderkey, o_totalprice from orders order by o_totalprice desc nulls last, o_orderkey limit 10 offset 5"),
    "verb_top": (verb_top, "select p_partkey, p_name from part order by p_name nulls first, p_partkey limit 20"),
    "verb_values": (verb_values, "select x, y, z is true as yes, z is false as no, y is not distinct from 'a' as is_a from (values (1, 'a', true), (2, null, null), (3, 'c', false)) t(x, y, z)"),
    "verb_empty": (verb_empty, "select * from region where false union all select null, null"),
    "statement_insert": (
        statement_insert,
        "select * from (values (1, 'oslo', 4000000000, 1.5::double), (2, null, 7, null), (3, 'lima', null, null)) t(code, town, size, price) union all select n_nationkey + 10, n_name, null, null from nation where n_regionkey = 1",
    ),
    "statement_response": (statement_response, "select 0::smallint as header, 3::bigint as affected_rows, 0::bigint as last_insert_id, 0 as warnings, '' as info, '' as session_state_info"),
    "statement_three_parts": (statement_three_parts, "select code, -code as neg, town from (values (1, 'oslo'), (2, 'lima')) t(code, town)"),
    "statement_table_changes": (statement_table_changes, "select * from (values ('start', ''), ('created', 'a,b'), ('dropped', 'a'), ('exists', 'true,false')) t(step, tables)"),
    "aggregate_order": (aggregate_order, "select o_orderstatus, count(o_orderkey) as c, max(o_totalprice) as m, min(o_custkey) as k from orders group by o_orderstatus"),
    "statement_errors": (statement_errors, f"select * from (values {', '.join(repr((name, True)) for name in [*ERRORS, 'rows unchanged'])}) t(statement, failed)"),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {key: run for key, (run, _) in PROGRAMS.items()}


ORACLE_SQL = {key: sql for key, (_, sql) in PROGRAMS.items()}
