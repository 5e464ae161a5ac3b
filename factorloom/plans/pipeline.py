"""The two user-facing jobs: train and register a model, and score with a registered one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.model import Model
from factorloom.operators.cells import block_metadata, choose_columns
from factorloom.operators.predict import predict_with, rmse
from factorloom.operators.similarity import column_similarities, similar_columns, similar_nested, similar_to, similars_json
from factorloom.plans.topk import top_k
from factorloom.operators.train import TRAINERS
from factorloom.params import FMParams
from factorloom.plans.runtime import cut_lineage, stage
from factorloom.sources import stores


def train_model(spark: SparkSession, cells: DataFrame, params: FMParams | dict, base: str, uid: str,
                trainer: str = "gd", similarity_threshold: float | None = None,
                with_similarity: bool = True, similarity_total: int = 100, holdout: DataFrame | None = None, **options) -> Model:
    """Check the parameters, train, measure RMSE (on `holdout` cells if given), store and register the
    model and its similarity table: the `similarity_total` most similar columns of every column, or all pairs of
    at least `similarity_threshold` if that is given."""
    if isinstance(params, dict):
        params = FMParams.from_map(params)
    model = TRAINERS[trainer](cells, params, **options)
    measured = cells if holdout is None else holdout
    if options.get("on_duplicate") == "max":  # what it was trained on
        measured = measured.groupBy("row_id", "col").agg(F.max("val").alias("val"))
    error = rmse(measured, model, params.k0, params.k1, params.keep).first()["rmse"]
    model = model.with_(rmse=error, blocks=cut_lineage(block_metadata(cells)), params=params.to_map())
    version = stores.now_millis()
    path = stores.save_model(model, base, params.name, version)
    stores.register(spark, base, uid, params.name, stores.MODEL, path, version)
    if with_similarity:
        if similarity_threshold is not None:
            sim = column_similarities(model.factors, similarity_threshold)
            limit = {"total": 0, "model": path}
        else:
            best = similar_columns(model.factors, similarity_total, start=0, end=model.num_attribute)
            sim = best.select(F.col("col").alias("i"), F.col("other").alias("j"), "score")
            limit = {"total": similarity_total, "model": path}
        path = stores.save_similarity(sim, base, params.name, version, **limit)
        stores.register(spark, base, uid, params.name, stores.MATRIX, path, version)
    return model


def score(spark: SparkSession, data: DataFrame, base: str, uid: str, name: str) -> DataFrame:
    """Predictions of the newest registered model for cells, points or dense rows."""
    model = stores.load_model(spark, stores.resolve(spark, base, uid, name, stores.MODEL))
    return predict_with(data, model)


def similar(spark: SparkSession, base: str, uid: str, name: str, total: int, columns: list[int] | None = None,
            start: int | None = None, end: int | None = None) -> DataFrame:
    """(col, json): the `total` most similar columns of the selected ones, from the newest stored similarity table,
    or from its model's factors where more are asked for than the table has for a column. Raises if none is registered or no column is selected."""
    path = stores.resolve(spark, base, uid, name, stores.MATRIX)
    if columns is None and (start is None or end is None):
        raise ValueError("No columns are selected: give a list of columns, or start and end.")
    limit = stores.similarity_limit(spark, path)
    factors = None if limit is None or total <= limit[0] else stores.load_model(spark, limit[1]).factors
    if factors is not None and limit[0] > 0:
        return similars_json(similar_nested(similar_columns(factors, total, columns, start, end)))
    found = stores.load_similarity(spark, path, columns, start, end).select(F.col("i").alias("col"), F.col("j").alias("other"), "score")
    best = top_k(found, ["col"], [F.desc("score"), F.asc("other")], total, "other")
    if factors is not None:
        # Of a table above a threshold, columns with enough partners are answered; the others are searched.
        best = stage(best, "stored")
        whole = best.filter(F.col("rank") == total).select("col")
        others = choose_columns(factors.select("col", "m"), columns, start, end).join(whole, "col", "left_anti")
        best = best.join(whole, "col", "left_semi").unionByName(similar_to(others, factors, total), allowMissingColumns=True)
    return similars_json(similar_nested(best))
