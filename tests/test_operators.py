import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary import functions as G
from granary import operators as O


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def t(spark):
    return spark.createDataFrame([(1, "a", 2.0), (2, None, 3.0), (None, "b", None)], "id int, name string, x double")


def test_verbs_equal_sql(spark, t):
    t.createOrReplaceTempView("t")
    u = spark.createDataFrame([(1, "p"), (3, "q")], "id int, w string")
    u.createOrReplaceTempView("u")
    pairs = [
        (O.scan(spark, "t", ["name"], [F.col("id") > 1]), "select name from t where id > 1"),
        (O.filter_rows(t, "id is null"), "select * from t where id is null"),
        (O.join_using(t, u, ["id"], "full"), "select * from t full join u using (id)"),
        (O.natural_join(t, u), "select * from t natural join u"),
        (O.join(t.alias("t"), u.alias("u"), F.col("t.id") < F.col("u.id"), "left"), "select * from t left join u on t.id < u.id"),
        (O.aggregate(t, ["name"], [G.count_all().alias("c")], "c > 0"), "select name, count(*) c from t group by name having c > 0"),
        (O.aggregate(t, [], [G.count_rows_with(F.col("id"), F.col("name")).alias("c")]), "select count(id, name) c from t"),
        (O.aggregate(t, ["name"], []), "select distinct name from t"),
        (O.limit(O.sort(t, F.col("x").desc_nulls_last()), 1, 1), "select * from t order by x desc nulls last limit 1 offset 1"),
        (O.sort(t, F.col("x").asc_nulls_first(), fetch=1), "select * from t order by x nulls first limit 1"),
        (O.cross_join(t.select("id"), u.select("w")), "select t.id, u.w from t cross join u"),
        (O.rename_columns(u, "v", ["a", "b"]).select("v.a"), "select id from u"),
        (O.project(t, G.int_div(F.lit(-7), F.lit(2)).alias("d")), "select -7 div 2 as d from t"),
        (O.project(t, G.like(F.col("name"), "A%", ignore_case=True).alias("l")), "select name ilike 'A%' as l from t"),
        (O.project(t, G.is_true(F.col("x") > 2), G.is_false(F.col("x") > 2)), "select (x > 2) is true, (x > 2) is false from t"),
        (O.project(t, G.not_distinct(F.col("name"), F.lit("a"))), "select name <=> 'a' from t"),
    ]
    for df, sql in pairs:
        assert got(df) == got(spark.sql(sql)), sql


def test_natural_join_without_common_names(spark):
    a, b = spark.range(2).toDF("a"), spark.range(3).toDF("b")
    assert O.natural_join(a, b).count() == 6


def test_empty_and_values(spark):
    schema = T.StructType([T.StructField("a", T.IntegerType(), False)])
    assert O.empty(spark, schema).count() == 0
    assert O.empty(spark, schema, one_row=True).collect()[0].a is None
    assert O.empty(spark, one_row=True).select(F.lit(1).alias("x")).collect()[0].x == 1
    assert got(O.values(spark, [(1,), (2,)], "a int")) == [(1,), (2,)]
    for bad in (lambda: O.values(spark, [], "a int"), lambda: O.limit(spark.range(1), -1), lambda: O.aggregate(spark.range(1), [], []), lambda: O.join(spark.range(1), spark.range(1), F.lit(True), "semi"), lambda: O.rename_columns(spark.range(1), "a", ["x", "y"])):
        with pytest.raises(ValueError):
            bad()
