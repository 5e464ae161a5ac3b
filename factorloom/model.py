"""The factorization-machine model: a bias, and one row of weights per feature column."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom import schema


@dataclass(frozen=True)
class Model:
    """`factors` has one row (col, v, m array) per feature column. Only scalars live on the driver."""

    c: float
    factors: DataFrame
    num_attribute: int
    num_factor: int
    blocks: DataFrame | None = None
    rmse: float | None = None
    params: dict = field(default_factory=dict)

    def header(self, spark: SparkSession) -> DataFrame:
        row = (float(self.c), self.rmse, int(self.num_attribute), int(self.num_factor), dict(self.params))
        return spark.createDataFrame([row], schema.HEADER)

    def with_(self, **changes) -> "Model":
        return replace(self, **changes)

    def wide(self) -> DataFrame:
        """Factors with one double column per latent factor, so sums stay in generated code."""
        ms = [F.col("m")[f].alias(f"m{f}") for f in range(self.num_factor)]
        return self.factors.select("col", "v", *ms)

    def bytes(self) -> int:
        """Upper estimate of the in-memory size of the wide factor table."""
        return int(self.num_attribute + 1) * (24 + 8 * (2 + self.num_factor))


def pack(wide: DataFrame, num_factor: int) -> DataFrame:
    """Wide factor columns back to (col, v, m array)."""
    return wide.select("col", "v", F.array(*[F.col(f"m{f}") for f in range(num_factor)]).alias("m"))
