"""Model equation on tables: join the weights, sum per row, put the parts together."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.model import Model, pack
from factorloom.operators.cells import kept, to_cells
from factorloom.plans.joins import broadcast_limit, lookup_join
from factorloom.plans.runtime import is_stored, shuffle_width, stage
from factorloom.functions.random import hashed_gaussian

_ROWS_PER_TASK = 250_000
# Models of more factors are summed in blocks of so many, a line each: the width of the plan does not grow with them, and
# the sums stay in generated code.
_NAMED_FACTORS = 32
# Cells of a part on average at most, where weights are sent to the parts.
_CELLS_PER_PART = 1_000_000


def init_model(spark: SparkSession, num_attribute: int, num_factor: int, mean: float, stdev: float,
               seed: int = 0) -> Model:
    """c = 0, v = 0, every factor drawn on its own from a hash of (seed, factor, column), so that draws are independent
    and the same seed gives the same model on every cluster."""
    tasks = max(1, -(-num_attribute // _ROWS_PER_TASK))
    cols = spark.range(0, num_attribute, 1, tasks).withColumnRenamed("id", "col")
    draws = [hashed_gaussian(mean, stdev, F.lit(seed), F.lit(f), F.col("col")).alias(f"m{f}") for f in range(num_factor)]
    return Model(0.0, pack(cols.select("col", F.lit(0.0).alias("v"), *draws), num_factor),
                 num_attribute, num_factor)


def total(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts) if parts else F.lit(0.0)


def join_model(cells: DataFrame, model: Model) -> DataFrame:
    """Attach v, m0..mK-1 to each entry. Columns without weights (the target) get nulls."""
    return lookup_join(cells, model.wide(), ["col"], model.bytes(), "left")


def _value(model: Model, keep: str) -> Column:
    """The feature value; 0 for what is no feature: target cells, dropped values, empty rows."""
    inside = (F.col("col") < model.num_attribute) & kept(F.col("val"), keep)
    return F.when(inside, F.col("val")).otherwise(0.0)


def _square(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, y: s + y * y)


def _in_parts(entries: DataFrame, model: Model, keys: list[str]) -> DataFrame:
    """Entries with (part, v, m), those of a row in one partition: a cell is smaller than the sums of a wide model. Weights too big to broadcast are sent once to each part
    that uses their column, as for training, so that sums of a row need no shuffle."""
    spark = entries.sparkSession
    if model.bytes() <= broadcast_limit(spark):
        return entries.repartition(*keys).join(F.broadcast(model.factors), "col", "left").withColumn("part", F.lit(0))
    entries = entries if is_stored(entries) else stage(entries, "facts")
    width = max(shuffle_width(spark), -(-entries.count() // _CELLS_PER_PART))
    entries = entries.withColumn("part", F.pmod(F.hash(*keys), F.lit(width)))
    routes = entries.filter(F.col("col").isNotNull()).select("part", "col").distinct()
    sent = routes.join(model.factors, "col").repartitionById(width, F.col("part"))
    return entries.repartitionById(width, F.col("part")).join(sent.hint("shuffle_hash"), ["part", "col"], "left")


def _block_sums(entries: DataFrame, model: Model, keys: list[str], keep: str, squares: bool, extra: list[Column]) -> DataFrame:
    """Per key: linear sum, the array s of all factor sums, and the array q of the sums of squares if `squares`, else their
    total; `extra` are maxima. Rows without weights have zeros. Factors are summed in blocks of _NAMED_FACTORS, a line each,
    the last one filled up with zeros; the linear weight stands in block 0."""
    x, width = _value(model, keep), _NAMED_FACTORS
    joined = _in_parts(entries, model, keys)
    count = max(1, -(-model.num_factor // width))
    pieces = F.array(*[F.slice(F.coalesce("m", F.array().cast("array<double>")), 1 + b * width, width) for b in range(count)])
    lines = joined.select(*[c for c in joined.columns if c != "m"], F.posexplode(pieces).alias("block", "_m"))
    ds = [F.coalesce(F.get("_m", F.lit(f)), F.lit(0.0)) * x for f in range(width)]
    linear = F.when(F.col("block") == 0, F.coalesce(F.col("v"), F.lit(0.0))).otherwise(0.0) * x
    aggs = [F.sum(linear).alias("linear"), *[F.sum(d).alias(f"s{f}") for f, d in enumerate(ds)]]
    aggs += [F.sum(d * d).alias(f"q{f}") for f, d in enumerate(ds)] if squares else [F.sum(total([d * d for d in ds])).alias("squares")]
    lines = lines.groupBy("part", *keys, "block").agg(*aggs, *extra)
    known = {"part", *keys, "block", "linear", "squares", *(f"{a}{f}" for a in "sq" for f in range(width))}
    names = [c for c in lines.columns if c not in known]

    def whole(name: str) -> Column:
        parts = F.array_sort(F.collect_list(F.struct("block", F.array(*[F.col(f"{name}{f}") for f in range(width)]).alias("part"))))
        found = F.flatten(F.transform(parts, lambda p: p["part"]))
        return F.slice(F.concat(found, F.array_repeat(F.lit(0.0), model.num_factor)), 1, model.num_factor).alias(name)

    sums = [whole("s"), whole("q")] if squares else [whole("s"), F.sum("squares").alias("squares")]
    return lines.groupBy("part", *keys).agg(F.sum("linear").alias("linear"), *sums, *[F.max(c).alias(c) for c in names]).drop("part")


def factor_vectors(data: DataFrame, model: Model, keep: str = "positive") -> DataFrame:
    """Per row: linear sum, and the sums s_f and sums of squares q_f of all factors as two arrays, for any number of
    factors. A row without features has zeros; repeated entries count each."""
    return _block_sums(to_cells(data), model, ["row_id"], keep, True, [])


def factor_sums(data: DataFrame, model: Model, keep: str = "positive") -> DataFrame:
    """Per row: linear sum, and for every factor f the sum s_f and the sum of squares q_f. `factor_vectors` has the
    same sums in two arrays."""
    x = _value(model, keep)
    aggs = [F.sum(F.coalesce(F.col("v"), F.lit(0.0)) * x).alias("linear")]
    for f in range(model.num_factor):
        d = F.coalesce(F.col(f"m{f}"), F.lit(0.0)) * x
        aggs += [F.sum(d).alias(f"s{f}"), F.sum(d * d).alias(f"q{f}")]
    return join_model(to_cells(data), model).groupBy("row_id").agg(*aggs)


def row_parts(data: DataFrame, model: Model, keep: str = "positive", extra: list[Column] = ()) -> DataFrame:
    """Per row: linear sum, the factor sums, and one sum of squares over all factors. K + 2 partial sums. The factor
    sums are columns s0..sK-1 up to _NAMED_FACTORS factors, and one array s beyond; `factor_vector` reads both. `extra`
    are maxima."""
    # Exploded points may carry their target; cells need no category.
    exploded = {"col", "_point"} <= set(data.columns)
    entries = data if exploded else to_cells(data if "col" in data.columns else numbered_points(data))
    keys = ["row_id", *(["_point"] if "_point" in entries.columns else [])]
    if model.num_factor > _NAMED_FACTORS:
        return _block_sums(entries, model, keys, keep, False, list(extra)).drop("_point")
    x = _value(model, keep)
    ms = [F.coalesce(F.col(f"m{f}"), F.lit(0.0)) for f in range(model.num_factor)]
    aggs = [F.sum(F.coalesce(F.col("v"), F.lit(0.0)) * x).alias("linear")]
    aggs += [F.sum(m * x).alias(f"s{f}") for f, m in enumerate(ms)]
    aggs.append(F.sum(x * x * total([m * m for m in ms])).alias("squares"))
    return join_model(entries, model).groupBy(*keys).agg(*aggs, *extra).drop("_point")


def factor_vector(num_factor: int) -> Column:
    """The factor sums of `row_parts` as one array."""
    return F.col("s") if num_factor > _NAMED_FACTORS else F.array(*[F.col(f"s{f}") for f in range(num_factor)])


def row_value(model: Model, k0: bool = True, k1: bool = True) -> Column:
    """The model equation over the columns of `row_parts`."""
    if model.num_factor <= _NAMED_FACTORS:
        return equation(model.c, model.num_factor, k0, k1)
    pair = F.lit(0.5) * (_square(F.col("s")) - F.col("squares"))
    return F.lit(float(model.c) if k0 else 0.0) + (F.col("linear") if k1 else F.lit(0.0)) + pair


def numbered_points(data: DataFrame) -> DataFrame:
    """Points and dense rows with a number each, so that two with one row_id are two requests."""
    if "features" not in data.columns or "_point" in data.columns:
        return data
    return data.withColumn("_point", F.monotonically_increasing_id())


def equation(c: Column | float, num_factor: int, k0: bool = True, k1: bool = True) -> Column:
    """[k0] c + [k1] linear + 1/2 (sum_f s_f^2 - squares)"""
    pair = F.lit(0.5) * (total([F.col(f"s{f}") * F.col(f"s{f}") for f in range(num_factor)]) - F.col("squares"))
    bias = (c if isinstance(c, Column) else F.lit(float(c))) if k0 else F.lit(0.0)
    return bias + (F.col("linear") if k1 else F.lit(0.0)) + pair


def predict_linear_parts(data: DataFrame, model: Model, k0: bool = True, k1: bool = True,
                         keep: str = "positive") -> DataFrame:
    """Bias and linear contribution of every row under the flags."""
    parts = row_parts(data, model.with_(num_factor=0), keep)
    return parts.select("row_id", F.lit(float(model.c) if k0 else 0.0).alias("bias"),
                        (F.col("linear") if k1 else F.lit(0.0)).alias("linear"))


def predict(data: DataFrame, model: Model, k0: bool = True, k1: bool = True,
            keep: str = "positive") -> DataFrame:
    """(row_id, prediction) for cells, points, or rows with a dense `features` array. Target cells
    may be present and are ignored; a row without any feature predicts c."""
    parts = row_parts(data, model, keep)
    return parts.select("row_id", row_value(model, k0, k1).alias("prediction"))


def predict_with(data: DataFrame, model: Model) -> DataFrame:
    """Predict under the flags stored with the model."""
    flags = {k: str(model.params.get(k, "true")).lower() == "true" for k in ("k0", "k1")}
    return predict(data, model, **flags, keep=str(model.params.get("keep", "positive")))


def _has_target() -> Column:
    """NaN is no target, as in training."""
    return F.col("target").isNotNull() & ~F.isnan("target")


def scored_rows(cells: DataFrame, model: Model, k0: bool = True, k1: bool = True,
                keep: str = "positive") -> DataFrame:
    """(row_id, prediction, target): one aggregate over the cells. Rows without a target, or with NaN, are left out."""
    is_target = F.col("col") == model.num_attribute
    parts = row_parts(cells, model, keep, [F.max(F.when(is_target, F.col("val"))).alias("target")])
    return (parts.filter(_has_target())
            .select("row_id", row_value(model, k0, k1).alias("prediction"), "target"))


def rmse_of(scored: DataFrame) -> DataFrame:
    miss = F.col("prediction") - F.col("target")
    return scored.agg(F.sqrt(F.avg(miss * miss)).alias("rmse"))


def rmse(data: DataFrame, model: Model, k0: bool = True, k1: bool = True, keep: str = "positive") -> DataFrame:
    """One row: root mean squared error over cells or points. Empty input gives null."""
    if "features" in data.columns:
        entries = (numbered_points(data).select("row_id", "_point", "target", F.explode_outer("features").alias("e"))
                   .select("row_id", "_point", "target", F.col("e.col").alias("col"), F.col("e.val").alias("val")))
        parts = row_parts(entries, model, keep, [F.max("target").alias("target")])
        return rmse_of(parts.filter(_has_target()).select(row_value(model, k0, k1).alias("prediction"), "target"))
    return rmse_of(scored_rows(data, model, k0, k1, keep))
