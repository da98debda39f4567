from pathlib import Path

import pytest

from granary.cli import loop, respond
from granary.session import EngineSession
from granary.slt import run_file
from granary.sql_text import JoinWithoutCondition, check_joins, without_aggregate_order
from granary.types import UnknownType, spark_type

FILES = sorted((Path(__file__).parent / "slt").glob("*.slt"))


@pytest.fixture
def session(spark):
    s = EngineSession(spark, "session_test")
    yield s
    s.spark.sql("USE default")
    s.spark.sql("DROP DATABASE session_test CASCADE")


@pytest.mark.parametrize("path", FILES, ids=lambda p: p.stem)
def test_logic_files(session, path):
    assert run_file(session, path) > 0


def test_catalog(session):
    session.register_table("v", session.spark.range(3))
    assert "v" in session.tables() and session.table_exists("v") and session.table("v").count() == 3
    session.deregister_table("v")
    assert not session.table_exists("v")
    session.run("create table k (a int)")
    assert session.tables("session_test") == ["k"]
    session.deregister_table("k")
    assert session.tables("session_test") == []
    assert "session_test" in session.databases()
    assert "Scan" in session.explain("select * from range(3) where id > 1") or "Range" in session.explain("select * from range(3)")


def test_types():
    assert spark_type("varchar(10)").simpleString() == "string"
    assert spark_type("int unsigned").simpleString() == "bigint"
    assert spark_type("NUMERIC(10, 2)").simpleString() == "double"
    with pytest.raises(UnknownType):
        spark_type("geometry")


def test_prompt(session):
    """Errors, results of no rows, NULLs and several tables in one sitting."""
    said = []
    session_lines = [
        "show tables",
        "create table moons (planet text not null, moon text, km double);",
        "insert into moons values ('mars', 'phobos', 22.5), ('mars', 'deimos', null)",
        "insert into moons (moon) values ('io')",
        "select moon, km from moons where km is null",
        "select moon from moons join moons",
        "   ",
        "HELP ME",
        "create table probes (name text)",
        "SHOW TABLES;",
        "select count(*) as n, sum(km) as km from moons where planet = 'pluto'",
        "select * from probes",
        "exit",
        "select 'never'",
    ]
    loop(session, session_lines, said.append)
    assert said[0] == "no tables"
    assert said[1] == "Empty ResultSet" and said[2] == "rows affected 2"
    assert said[3].startswith("error: NULL in column planet")
    assert said[4] == "moon|km\ndeimos|NULL"
    assert said[5] == "error: JOIN needs ON or USING; write CROSS JOIN for all pairs" and said[6].startswith("error:")
    assert said[8] == "moons\nprobes" and said[9] == "n|km\n0|NULL" and said[10] == "Empty ResultSet" and len(said) == 11
    assert "quit" in respond(session, "?") and respond(session, "quit;") is None


def test_statement_text():
    for bad in ("select * from a join b", "select 1 from a left join b where x", "select * from (select 1 from a join b) t join c on true", "select * from a join b join c on a.x = b.x"):
        with pytest.raises(JoinWithoutCondition):
            check_joins(bad)
    for good in ("select * from a join b on a.x = b.x join c using (y)", "select * from a cross join b", "select * from a natural left join b, c", "select 'x join y' from a -- join b", "select left(x, 2) from a join (select 1 from b join c on true) t on (true)", "select * from a join b join c on c.x = b.x on a.x = b.x"):
        check_joins(good)
    assert without_aggregate_order("select sum(a order by f(b) desc), x, count(distinct (c) order by 1) from t order by min(d order by e)") == "select sum(a), x, count(distinct (c)) from t order by min(d)"
    assert without_aggregate_order("select rank() over (order by x), 'max(a order by b)' from t") == "select rank() over (order by x), 'max(a order by b)' from t"
