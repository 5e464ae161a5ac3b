"""Context-aware top-k recommendation with a trained model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.model import Model
from factorloom.operators.predict import factor_vector, row_parts, row_value
from factorloom.plans.runtime import cut_lineage
from factorloom.plans.topk import best_matches, top_k


def recommend_items(query_cells: DataFrame, items: DataFrame, model: Model, k: int, k0: bool = True,
                    k1: bool = True, seen: DataFrame | None = None) -> DataFrame:
    """The k best items for every query row: (row_id, rank, item, score).

    query_cells hold user and context cells without an item; items(col) are the item columns. For a
    one-hot item i the score is y(query) + v_i + sum_f s_f m_fi, so each query is reduced to one
    number and one vector first, which are written once. `seen`(row_id, col) pairs are left out
    where they would be scored. A query that has seen all items has no answer."""
    parts = row_parts(query_cells, model)
    queries = parts.select(F.col("row_id").alias("qid"), factor_vector(model.num_factor).alias("qvec"),
                           row_value(model, k0, k1).alias("base"))
    candidates = model.factors.join(items.select("col").distinct(), "col", "left_semi").select(
        F.col("col").alias("item"), F.col("m").alias("vec"), (F.col("v") if k1 else F.lit(0.0)).alias("bias"))
    pairs = None if seen is None else seen.select(F.col("row_id").alias("qid"), F.col("col").alias("item"))
    found = best_matches(cut_lineage(queries), candidates, k, seen=pairs)
    best = top_k(found, ["qid"], [F.desc("score"), F.asc("item")], k, "item")
    return best.select(F.col("qid").alias("row_id"), "rank", "item", "score")


def predict_concepts(profile_cells: DataFrame, concepts: DataFrame, model: Model, k: int) -> DataFrame:
    """The k concepts that fit best to each document profile: (row_id, rank, concept, score).
    profile_cells hold the weighted terms; concepts(col, key) are the concept columns."""
    best = recommend_items(profile_cells, concepts, model, k)
    names = concepts.select(F.col("col").alias("item"), F.col("key").alias("concept"))
    return best.join(names, "item").select("row_id", "rank", "concept", "score")
