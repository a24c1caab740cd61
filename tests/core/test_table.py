"""Edge cases of table operators with values worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import table as t


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_construction_pads_and_sorts(spark):
    assert t.from_columns(spark, {"b": [1, 2], "a": ["x", "y"]}).columns == ["a", "b"]
    assert rows(t.from_rows(spark, ["a", "b"], [(1, 2), (3,), (4, 5, 6)])) == [(1, 2), (3, None), (4, 5)]
    with pytest.raises(ValueError, match="length"):
        t.from_columns(spark, {"a": [1], "b": []})


def test_text_becomes_number_by_its_prefix(spark):
    df = spark.createDataFrame([("3abc",), (" 2.5x",), ("",), ("no",), (None,), ("-1e2",)], "s string")
    assert [r.s for r in t.astype(df, "s", "double").collect()] == [3.0, 2.5, 0.0, 0.0, None, -100.0]
    words = spark.createDataFrame([("true", "1"), ("False", "2x")], "b string, n string")
    assert dict(t.convert_dtypes(words).dtypes) == {"b": "boolean", "n": "double"}
    assert t.dtypes(spark.createDataFrame([(None, 1)], "e string, i int")) == {"e": "empty", "i": "int"}


def test_null_keys_join_and_all_sides(spark):
    a = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "k int, x string")
    b = spark.createDataFrame([(1, "p"), (None, "q"), (3, "r")], "k int, y string")
    assert rows(t.merge(a, b, ["k"])) == [(1, "a", "p"), (None, "b", "q")]
    assert len(rows(t.merge(a, b, ["k"], "outer"))) == 4
    assert rows(t.merge(a, b, ["k"], "right"))[1] == (3, None, "r")
    assert rows(t.merge(a, b, ["k"], "anti")) == [(2, "c")]
    with pytest.raises(ValueError, match="unknown join"):
        t.merge(a, b, ["k"], "cross")


def test_keys_do_not_collide(spark):
    df = spark.createDataFrame([("a|b", "c", 1.0), ("a", "b|c", 2.0)], "k1 string, k2 string, v double")
    assert t.group_agg(df, ["k1", "k2"], {"v": ["sum"]}).count() == 2


def test_group_null_policies(spark):
    df = spark.createDataFrame([("g", 1.0), ("g", None), ("h", None)], "g string, v double")
    compat = {r.g: r for r in t.group_agg(df, ["g"], {"v": ["mean", "std"]}, compat=True).collect()}
    assert compat["g"].v_mean == 0.5 and compat["h"].v_std == 0.0
    assert {r.g: r.v_mean for r in t.group_agg(df, ["g"], {"v": ["mean"]}).collect()} == {"g": 1.0, "h": None}


def test_degenerate_totals_are_zero(spark):
    none = spark.createDataFrame([], "v double")
    assert tuple(t.totals(none, "v").first()) == (0, 0, 0, 0, 0, 0, 0, 0)
    one = spark.createDataFrame([(4.0, 1.0), (4.0, 2.0)], "x double, y double")
    assert t.corr_matrix(one).filter("column = 'x'").first().y == 0.0


def test_duplicates_nulls_and_replacement(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None)], "i int, s string")
    assert rows(t.drop_duplicates(df, "i")) == [(1, "a"), (3, None)]
    assert [r.duplicated for r in t.duplicated(df, "i").orderBy("i").collect()] == [False, True, False, True]
    nan = spark.createDataFrame([(math.nan,), (None,)], "v double")
    assert t.dropna(nan).count() == 1
    assert [r.s for r in t.replace(df, "a", "z").orderBy("i").collect()] == ["z", "z", None, None]
    assert t.nunique(df).first().s == 2


def test_shapes(spark):
    df = spark.createDataFrame([("r", "x", 1.0), ("r", "y", 2.0), ("s", "x", 3.0)], "i string, c string, v double")
    assert rows(t.pivot_table(df, "i", "c", "v")) == [("r", 1.0, 2.0), ("s", 3.0, 0.0)]
    assert rows(t.melt(t.pivot_table(df, "i", "c", "v"), ["i"], ["x", "y"]))[0] == ("r", "x", 1.0)
    assert [tuple(r) for r in t.transpose(df.select("i", "c"), "i", "c").collect()] == [("r", "r", "s"), ("x", "y", "x")]
    assert rows(t.where(df.select("i", "c"), F.col("i") == "r", "o"))[0] == ("o", "o")
    placed = t.assign_values(df, "n", [10, 20, 30], "i", "c")
    assert [r.n for r in placed.orderBy("i", "c").collect()] == [10, 20, 30]


def test_sample_is_exact_and_seeded(spark):
    df = spark.range(1000)
    a = rows(t.sample(df, 10, 1, "id"))
    assert len(a) == 10 and a == rows(t.sample(df.repartition(5), 10, 1, "id")) and a != rows(t.sample(df, 10, 2, "id"))
