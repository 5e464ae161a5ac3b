"""Element-wise and scalar functions on array<double> columns, and operators on tables (id, vec)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorloom.plans.topk import best_matches, top_k


def _same_length(a: Column, b: Column, value: Column) -> Column:
    """The value, or an error when the vectors differ in length. Null stays null."""
    error = F.raise_error(F.concat(F.lit("vector lengths differ: "), F.size(a), F.lit(" and "), F.size(b)))
    return (F.when(F.size(a) == F.size(b), value)
            .when(a.isNull() | b.isNull(), F.lit(None)).otherwise(error))


def vec_add(a: Column, b: Column) -> Column:
    return _same_length(a, b, F.zip_with(a, b, lambda x, y: x + y))


def vec_sub(a: Column, b: Column) -> Column:
    return _same_length(a, b, F.zip_with(a, b, lambda x, y: x - y))


def _fold(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def vec_dot(a: Column, b: Column) -> Column:
    return _same_length(a, b, _fold(F.zip_with(a, b, lambda x, y: x * y)))


def vec_plus_dot(a: Column, plus: Column, b: Column) -> Column:
    """(a + plus) . b"""
    return vec_dot(vec_add(a, plus), b)


def vec_scale(a: Column, k) -> Column:
    factor = k if isinstance(k, Column) else F.lit(float(k))
    return F.transform(a, lambda x: x * factor)


def vec_div(a: Column, d) -> Column:
    """Times 1/d."""
    divisor = d if isinstance(d, Column) else F.lit(float(d))
    return vec_scale(a, F.lit(1.0) / divisor)


def vec_neg(a: Column) -> Column:
    return F.transform(a, lambda x: -x)


def vec_sum(a: Column) -> Column:
    """Total of the elements; an empty vector is an error."""
    return F.when(F.size(a) > 0, _fold(a)).when(a.isNull(), F.lit(None)).otherwise(
        F.raise_error(F.lit("sum of an empty vector")))


def vec_sq_dist(a: Column, b: Column) -> Column:
    return _same_length(a, b, _fold(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def vec_dist(a: Column, b: Column) -> Column:
    return F.sqrt(vec_sq_dist(a, b))


def combine(left: DataFrame, right: DataFrame, op: Callable[[Column, Column], Column], on: str = "id",
            out: str = "vec") -> DataFrame:
    """Join two vector tables (on, vec) and combine their vectors."""
    pair = left.select(on, F.col("vec").alias("_a")).join(right.select(on, F.col("vec").alias("_b")), on)
    return pair.select(on, op(F.col("_a"), F.col("_b")).alias(out))


def vec_accumulate(table: DataFrame, group: str, how: str = "sum") -> DataFrame:
    """Element-wise sum or mean of the vectors per group: (group, vec). Adds up per position, so a
    hot group is combined before the shuffle. Vectors of different lengths in a group are an error."""
    if how not in ("sum", "mean"):
        raise ValueError(f"how must be 'sum' or 'mean', not {how!r}")
    reduce = F.sum if how == "sum" else F.avg
    by_position = (table.select(group, F.posexplode("vec").alias("pos", "x"))
                   .groupBy(group, "pos").agg(reduce("x").alias("x"), F.count(F.lit(1)).alias("n")))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "x")))
    found = by_position.groupBy(group).agg(F.transform(ordered, lambda e: e["x"]).alias("vec"),
                                           (F.min("n") == F.max("n")).alias("even"))
    wrong = F.raise_error(F.lit("vectors of a group differ in length")).cast("array<double>")
    return found.select(group, F.when(F.col("even"), F.col("vec")).otherwise(wrong).alias("vec"))


def nearest_vectors(queries: DataFrame, table: DataFrame, k: int, how: str = "distance",
                    on: str = "id") -> DataFrame:
    """The k nearest rows of table(on, vec) for each of queries(on, vec), by Euclidean distance or by
    dot product: (query, rank, neighbour, score). Ties go to the smaller id."""
    if how not in ("distance", "dot"):
        raise ValueError(f"how must be 'distance' or 'dot', not {how!r}")
    left = queries.select(F.col(on).alias("qid"), F.col("vec").alias("qvec"), F.lit(0.0).alias("base"))
    right = table.select(F.col(on).alias("item"), "vec", F.lit(0.0).alias("bias"))
    found = best_matches(left, right, k, how)
    best = top_k(found, ["qid"], [F.desc("score"), F.asc("item")], k, "item")
    score = F.col("score") if how == "dot" else F.lit(0.0) - F.col("score")
    return best.select(F.col("qid").alias("query"), "rank", F.col("item").alias("neighbour"), score.alias("score"))
