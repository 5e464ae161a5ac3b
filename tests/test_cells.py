import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom import schema
from factorloom.operators import cells as cx
from factorloom.operators import encode as en


def table(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def report(df):
    return {r["rule"]: r["violations"] for r in df.collect()}


def test_points_and_targets(cells):
    points = {r["row_id"]: (r["target"], [(e["col"], e["val"]) for e in r["features"]])
              for r in cx.assemble_points(cells).collect()}
    assert points == {1: (5.0, [(0, 1.0), (2, 1.0), (4, 0.5)]), 2: (3.0, [(0, 1.0), (3, 1.0), (4, 0.25)]),
                      3: (4.0, [(1, 1.0), (2, 1.0), (4, 1.0)])}
    assert table(cx.split_target(cells), "row_id", "target", "top") == [(1, 5.0, 5), (2, 3.0, 5), (3, 4.0, 5)]
    assert cx.feature_dim(cells).first()[0] == 5


def test_blocks_over_all_rows(cells):
    assert table(cx.block_metadata(cells), "category", "begin", "end") == [
        ("context_numerical", 4, 4), ("item", 2, 3), ("label", 5, 5), ("user", 0, 1)]


def test_positive_and_nonzero(make_cells):
    cells = make_cells({(1, 4): -0.5, (2, 4): 0.0})
    assert cx.positive_only(cells).count() == 10
    assert cx.positive_only(cells, "nonzero").count() == 11
    with pytest.raises(ValueError):
        cx.positive_only(cells, "all")
    kept = cx.assemble_points(cells, "nonzero").filter("row_id = 1").first()["features"]
    assert (4, -0.5) in [(e["col"], e["val"]) for e in kept]


def test_nan_is_no_feature(make_cells):
    cells = make_cells({(1, 4): float("nan")})
    assert cx.positive_only(cells).count() == 11
    assert cx.positive_only(cells, "nonzero").count() == 11


def test_select_columns(model):
    assert [r["col"] for r in cx.select_columns(model.factors, [3, 0]).collect()] == [0, 3]
    assert [r["col"] for r in cx.select_columns(model.factors, start=1, end=3).collect()] == [1, 2, 3]
    with pytest.raises(ValueError):
        cx.select_columns(model.factors)
    with pytest.raises(ValueError):
        cx.select_columns(model.factors, start=1)


def test_lookup_and_densify(spark):
    points = spark.createDataFrame([(1, [(4, 0.5), (0, 1.0), (4, 9.0)])],
                                   "row_id bigint, features array<struct<col:bigint,val:double>>")
    f = F.col("features")
    got = points.select(cx.lookup(f, F.lit(4)).alias("a"), cx.lookup(f, F.lit(2)).alias("b"),
                        cx.sort_entries(f)[0]["col"].alias("c")).first()
    assert (got["a"], got["b"], got["c"]) == (0.5, 0.0, 0)
    unique = points.withColumn("features", F.slice(f, 1, 2))
    assert unique.select(cx.densify(F.col("features"), 5)).first()[0] == [1.0, 0.0, 0.0, 0.0, 0.5]
    arrays = cx.sparse_arrays(unique, 5).first()
    assert (arrays["indexes"], arrays["values"], arrays["entries"], arrays["length"]) == ([4, 0], [0.5, 1.0], 2, 5)


def test_check_is_silent_on_clean_cells(cells):
    assert set(report(cx.check_cells(cells, 5)).values()) == {0}


@pytest.mark.parametrize("rule, changes, extra, given", [
    ("missing_target", {(2, 5): None}, [], 5),
    ("duplicate_cell", {}, [(1, 0, "user", 1.0)], 5),
    ("binary_values", {(1, 0): 0.7}, [], 5),
    ("negative_lost", {(1, 4): -0.5}, [], 5),
    ("num_attribute", {}, [], 6),
    ("overlapping_blocks", {}, [(2, 1, "item", 1.0)], 5),
])
def test_each_rule_fires(make_cells, rule, changes, extra, given):
    found = report(cx.check_cells(make_cells(changes, extra), given))
    assert found.pop(rule) >= 1
    assert set(found.values()) == {0}


def test_set_rule_fires(spark):
    lines = [(1, 0, "context_categorical_set", 0.5), (1, 1, "context_categorical_set", 0.4), (1, 2, "label", 1.0),
             (2, 0, "context_categorical_set", 0.5), (2, 1, "context_categorical_set", 0.5), (2, 2, "label", 1.0)]
    assert report(cx.check_cells(spark.createDataFrame(lines, "row_id bigint, col bigint, cat string, val double")))["set_sum"] == 1


def test_build_cells_layout_is_dense(spark):
    raw = spark.createDataFrame([(1, "a", "x", 0.5, "m", 3.0), (2, "b", "x", 0.0, "n", 4.0), (3, "a", "y", None, "m", 5.0)],
                                "id bigint, u string, i string, n double, c string, y double")
    sets = spark.createDataFrame([(1, "p", 3.0), (1, "q", 1.0), (2, "q", 2.0), (1, "p", 0.0)], "id bigint, k string, w double")
    cells, dictionary = en.build_cells(raw, "id", users=["u"], items=["i"], ctx_num=["n"], ctx_cat=["c"],
                                       ctx_set={"s": (sets, "id", "k", "w")}, target="y")
    assert sorted(r["col"] for r in dictionary.collect()) == list(range(10))
    blocks = {r["category"]: (r["begin"], r["end"]) for r in cx.block_metadata(cells).collect()}
    assert blocks == {"user": (0, 1), "item": (2, 3), "context_numerical": (4, 4), "context_categorical": (5, 6),
                      "context_categorical_set": (7, 8), "label": (9, 9)}
    weights = sorted(r["val"] for r in cells.filter("cat = 'context_categorical_set'").collect())
    assert weights == [0.25, 0.75, 1.0]
    assert cells.filter("cat = 'context_numerical'").count() == 2
    layout = en.Layout(("u",), ("i",), ("n",), ("c",), ("s",), "y")
    new = spark.createDataFrame([(9, "b", "unknown")], "id bigint, u string, i string")
    encoded = en.encode_rows(new, "id", layout, dictionary, ["u", "i"]).collect()
    # An unknown key is a cell without a column: no feature, but its row stays.
    assert {(r["row_id"], r["cat"], r["col"] is None) for r in encoded} == {(9, "user", False), (9, None, True)}


def test_same_columns_whatever_the_partitioning(spark):
    raw = spark.range(500).selectExpr("id", "concat('u', id % 97) as u", "cast(id as double) as y")
    one = en.build_cells(raw.repartition(1), "id", users=["u"], target="y")[1]
    many = en.build_cells(raw.repartition(13), "id", users=["u"], target="y")[1]
    assert table(one, "key", "col") == table(many, "key", "col")


def test_two_sets_in_a_row_are_valid(spark):
    lines = [(1, 0, "context_categorical_set", 0.5), (1, 1, "context_categorical_set", 0.5), (1, 2, "context_categorical_set", 1.0),
             (1, 3, "label", 2.0), (2, 0, "context_categorical_set", 0.7), (2, 2, "context_categorical_set", 1.3), (2, 3, "label", 1.0)]
    cells = spark.createDataFrame(lines, schema.CELLS)
    dictionary = spark.createDataFrame([(0, 0), (0, 1), (1, 2)], "block int, col long")

    def found(**kw):
        return {r["rule"]: r["violations"] for r in cx.check_cells(cells, **kw).collect()}

    assert found()["set_sum"] == 0 and found(dictionary=dictionary)["set_sum"] == 2
    assert found()["not_a_number"] == 0


def test_rules_on_rows_exchange_the_cells_once(spark, monkeypatch):
    """By ranges, so that a row with most of all cells is dealt to several tasks; its report is that of brute force."""
    rng = np.random.default_rng(4)
    lines = [(0, int(c), "context_categorical_set", 0.001) for c in rng.permutation(3000)]
    lines += [(r, int(c), "user", 1.0) for r in range(1, 400) for c in rng.integers(0, 3000, 3)] + [(r, 3000, "label", 1.0) for r in range(390)]
    cells = spark.createDataFrame(lines, schema.CELLS).repartition(7)
    got = report(cx.check_cells(cells))
    pairs = Counter((r, c) for r, c, *_ in lines)
    assert got["duplicate_cell"] == sum(n > 1 for n in pairs.values())
    assert got["missing_target"] == 10 and got["set_sum"] == 0
    plan = cx.check_cells(cells)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning(row_id") == 1 and "hashpartitioning(row_id#" in plan
    assert not re.search(r"hashpartitioning\(row_id#\d+L?, col#", plan)
