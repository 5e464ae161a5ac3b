import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom.functions import matrices as mx
from factorloom.functions import vectors as vx
from factorloom.functions.random import gaussian_col, uniform_col

A, B = [1.0, -2.0, 3.0], [0.5, 4.0, -1.0]


@pytest.fixture(scope="module")
def pair(spark):
    return spark.createDataFrame([(1, A, B, [1.0], None)],
                                 "id bigint, a array<double>, b array<double>, short array<double>, gone array<double>")


def value(df, column):
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("op, expected", [
    (lambda a, b: vx.vec_add(a, b), [1.5, 2.0, 2.0]),
    (lambda a, b: vx.vec_sub(a, b), [0.5, -6.0, 4.0]),
    (lambda a, b: vx.vec_scale(a, 2), [2.0, -4.0, 6.0]),
    (lambda a, b: vx.vec_div(a, 2), [0.5, -1.0, 1.5]),
    (lambda a, b: vx.vec_neg(a), [-1.0, 2.0, -3.0]),
    (lambda a, b: vx.vec_dot(a, b), -10.5),
    (lambda a, b: vx.vec_plus_dot(a, b, b), -10.5 + 17.25),
    (lambda a, b: vx.vec_sum(a), 2.0),
    (lambda a, b: vx.vec_sq_dist(a, b), 52.25),
    (lambda a, b: vx.vec_dist(a, b), 52.25 ** 0.5),
])
def test_vector_functions(pair, op, expected):
    assert value(pair, op(F.col("a"), F.col("b"))) == pytest.approx(expected)


@pytest.mark.parametrize("op", [vx.vec_add, vx.vec_sub, vx.vec_dot, vx.vec_sq_dist, vx.vec_dist])
def test_lengths_must_match(pair, op):
    with pytest.raises(Exception, match="vector lengths differ"):
        value(pair, op(F.col("a"), F.col("short")))
    assert value(pair, op(F.col("a"), F.col("gone"))) is None


def test_sum_of_nothing_is_an_error(pair):
    with pytest.raises(Exception, match="empty vector"):
        value(pair, vx.vec_sum(F.expr("cast(array() as array<double>)")))


def test_accumulate_and_combine(spark):
    table = spark.createDataFrame([(1, "x", [1.0, 2.0]), (2, "x", [3.0, 5.0]), (3, "y", [7.0, 8.0])],
                                  "id bigint, g string, vec array<double>")
    assert {r["g"]: r["vec"] for r in vx.vec_accumulate(table, "g").collect()} == {"x": [4.0, 7.0], "y": [7.0, 8.0]}
    assert {r["g"]: r["vec"] for r in vx.vec_accumulate(table, "g", "mean").collect()}["x"] == [2.0, 3.5]
    both = vx.combine(table, table, vx.vec_add).filter("id = 2").first()
    assert both["vec"] == [6.0, 10.0]
    with pytest.raises(ValueError):
        vx.vec_accumulate(table, "g", "median")


def test_nearest(spark):
    table = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(6)], "id bigint, vec array<double>")
    got = vx.nearest_vectors(table.filter("id = 2"), table, 3).orderBy("rank").collect()
    assert [(r["neighbour"], r["score"]) for r in got] == [(2, 0.0), (1, 1.0), (3, 1.0)]
    dot = vx.nearest_vectors(table.filter("id = 2"), table, 2, "dot").orderBy("rank").collect()
    assert [(r["neighbour"], r["score"]) for r in dot] == [(5, 10.0), (4, 8.0)]
    with pytest.raises(ValueError):
        vx.nearest_vectors(table, table, 2, "cosine")


def dense(df):
    rows = df.collect()
    out = np.full((max(r["i"] for r in rows) + 1, max(r["j"] for r in rows) + 1), np.nan)
    for r in rows:
        out[r["i"], r["j"]] = r["value"]
    return out


def test_matrix_algebra(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(3, 4)), rng.normal(size=(3, 4))

    def make(z):
        return mx.Matrix.of(mx.mat_from_rows(spark.createDataFrame(
            [(i, r.tolist()) for i, r in enumerate(z)], "i bigint, vec array<double>")))

    a, b = make(x), make(y)
    assert (a.rows, a.cols) == (3, 4)
    assert np.allclose(dense((a + b).entries), x + y)
    assert np.allclose(dense((a - b).entries), x - y)
    assert np.allclose(dense((a * 2.0).entries), x * 2)
    assert np.allclose(dense(a.entries), x)
    assert {r["i"]: r["vec"] for r in mx.mat_rows(a.entries, [2]).collect()} == {2: x[2].tolist()}
    patched = dense(mx.mat_patch(a.entries, spark.createDataFrame([(1, 2, 9.0)], "i bigint, j bigint, value double")))
    assert patched[1, 2] == 9.0 and patched[0, 0] == x[0, 0]
    with pytest.raises(ValueError, match="sizes differ"):
        a + mx.Matrix(b.entries, 4, 4)
    filled = dense(mx.mat_fill(spark, 2, 3, 1.5))
    assert filled.shape == (2, 3) and (filled == 1.5).all()


def test_random_columns(spark):
    df = spark.range(0, 20000, 1, 4).select(uniform_col(1).alias("u"), gaussian_col(2.0, 3.0, 1).alias("g"),
                                            gaussian_col(2.0, 0.0).alias("c"), gaussian_col(1.0, float("nan")).alias("n"))
    r = df.agg(F.avg("u"), F.min("u"), F.max("u"), F.avg("g"), F.stddev("g"), F.min("c"), F.max("c"), F.max("n")).first()
    assert abs(r[0] - 0.5) < 0.02 and 0 <= r[1] and r[2] < 1
    assert abs(r[3] - 2) < 0.1 and abs(r[4] - 3) < 0.1
    assert (r[5], r[6], r[7]) == (2.0, 2.0, 1.0)


def test_accumulate_wants_equal_lengths(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [1.0])], "g int, vec array<double>")
    with pytest.raises(Exception, match="differ in length"):
        vx.vec_accumulate(df, "g").collect()


def test_rows_with_gaps_are_dense(spark):
    entries = spark.createDataFrame([(0, 0, 1.0), (0, 2, 3.0), (2, 1, 5.0)], "i long, j long, value double")
    rows = {r["i"]: r["vec"] for r in mx.mat_rows(entries).collect()}
    assert rows == {0: [1.0, 0.0, 3.0], 2: [0.0, 5.0, 0.0]}
    again = {(r["i"], r["j"]): r["value"] for r in mx.mat_from_rows(mx.mat_rows(entries)).collect()}
    assert again[0, 2] == 3.0 and again[0, 1] == 0.0
