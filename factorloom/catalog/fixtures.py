"""The engine's data model on the provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.model import Model, pack
from factorloom.operators.encode import Layout, build_cells
from factorloom.params import FMParams
from factorloom.plans.runtime import stage

EVENTS = Layout(users=("user_id",), items=("event_type",), ctx_num=("k",), ctx_cat=("hour",), target="y")
RATINGS = Layout(users=("o_custkey",), items=("l_partkey",), ctx_num=("discount",),
                 ctx_cat=("o_orderpriority",), target="y")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), "user_id", "event_type", F.hour("ts").alias("hour"),
        (F.get_json_object("props", "$.k").cast("double") / 100).alias("k"), (F.col("value") / 500).alias("y"))


def event_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return build_cells(event_rows(spark, sf_dir), "row_id", **_args(EVENTS))


def rating_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per customer, part and order priority."""
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_discount")
    parts = read(spark, sf_dir, "part").agg((F.max("p_partkey") + 1).alias("n")).first()["n"]
    priority = F.substring("o_orderpriority", 1, 1).cast("bigint") - 1
    row_id = (F.col("o_custkey") * F.lit(parts) + F.col("l_partkey")) * 5 + priority
    return (lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
            .groupBy("o_custkey", "l_partkey", "o_orderpriority")
            .agg(F.avg("l_discount").alias("discount"), (F.avg("l_quantity") / 50).alias("y"))
            .withColumn("row_id", row_id))


def rating_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The join and the grouping run once; the keys and the cells are read from their result."""
    return build_cells(stage(rating_rows(spark, sf_dir), "ratings"), "row_id", **_args(RATINGS))


def profile_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers with the priorities of their orders as a weighted set."""
    customers = read(spark, sf_dir, "customer").withColumn("y", F.col("c_acctbal") / 10000)
    orders = read(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", F.lit(1.0).alias("weight"))
    return build_cells(customers, "c_custkey", users=["c_custkey"], ctx_cat=["c_mktsegment"],
                       ctx_set={"priorities": (orders, "o_custkey", "o_orderpriority", "weight")}, target="y")


def _args(layout: Layout) -> dict:
    return {"users": layout.users, "items": layout.items, "ctx_num": layout.ctx_num,
            "ctx_cat": layout.ctx_cat, "target": layout.target}


def width(dictionary: DataFrame) -> int:
    """The number of feature columns, which is also the label's column."""
    return dictionary.agg(F.max("col")).first()[0]


def lattice_model(spark: SparkSession, num_attribute: int, num_factor: int = 2) -> Model:
    """A fixed model any SQL engine can compute as well: weights from integer arithmetic on the column.
    The odd divisors keep results away from decimal ties, where engines round differently."""
    col = F.col("col")
    ms = [((((col * 7919 + 104729 * f + 13) % 101) - 50) / F.lit(103.0)).alias(f"m{f}") for f in range(num_factor)]
    wide = spark.range(num_attribute).withColumnRenamed("id", "col").select(
        "col", (((col * 31) % 17 - 8) / F.lit(97.0)).alias("v"), *ms)
    return Model(0.1, pack(wide, num_factor), num_attribute, num_factor, params={"k0": "true", "k1": "true"})


def params(**changes) -> FMParams:
    base = dict(name="ratings", init_mean=0.0, init_stdev=0.1, num_partitions=8, num_attribute=None, num_factor=2,
                num_iter=1, learn_rate=0.1, k0=True, k1=True, reg_c=0.01, reg_v=0.02, reg_m=0.03)
    return FMParams(**{**base, **changes})


def latest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per customer the priority of the newest order: the context of a recommendation."""
    return read(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("o_orderpriority")).withColumn(
        "row_id", F.col("o_custkey"))


def document_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, term, weight): every word of the whole text, in letters of any script, counts once per occurrence."""
    words = F.explode(F.split(F.lower("text"), r"[^\p{L}]+"))
    return (read(spark, sf_dir, "documents").select("doc_id", words.alias("term"))
            .filter(F.col("term") != "").withColumn("weight", F.lit(1.0)))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<double>").alias("vec"),
        F.col("label").cast("bigint").alias("label"))


def shifted(table: DataFrame) -> DataFrame:
    """The same vectors under the next id, as a second operand."""
    return table.select((F.col("id") + 1).alias("id"), "vec")
