"""Algebra on matrices kept as coordinate tables (i, j, value)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Matrix:
    """Entries (i, j, value) of a rows x cols matrix. Operators give new matrices."""

    entries: DataFrame
    rows: int
    cols: int

    @classmethod
    def of(cls, entries: DataFrame) -> "Matrix":
        dims = mat_dims(entries).first()
        return cls(entries, dims["rows"], dims["cols"])

    def _check(self, other: "Matrix") -> None:
        if (self.rows, self.cols) != (other.rows, other.cols):
            raise ValueError(f"matrix sizes differ: {self.rows}x{self.cols} and {other.rows}x{other.cols}")

    def __add__(self, other: "Matrix") -> "Matrix":
        self._check(other)
        return Matrix(mat_add(self.entries, other.entries), self.rows, self.cols)

    def __sub__(self, other: "Matrix") -> "Matrix":
        self._check(other)
        return Matrix(mat_sub(self.entries, other.entries), self.rows, self.cols)

    def __mul__(self, k: float) -> "Matrix":
        return Matrix(mat_scale(self.entries, k), self.rows, self.cols)


def mat_fill(spark: SparkSession, rows: int, cols: int, value: float = 0.0) -> DataFrame:
    """All cells of a rows x cols matrix with one value."""
    cell = spark.range(rows * cols)
    return cell.select(F.floor(F.col("id") / cols).cast("bigint").alias("i"), (F.col("id") % cols).alias("j"),
                       F.lit(float(value)).alias("value"))


def mat_from_rows(table: DataFrame, row: str = "i", vec: str = "vec") -> DataFrame:
    """(row, array) to coordinates."""
    return table.select(F.col(row).cast("bigint").alias("i"), F.posexplode(vec).alias("pos", "value")).select(
        "i", F.col("pos").cast("bigint").alias("j"), F.col("value").cast("double").alias("value"))


def mat_rows(entries: DataFrame, selected: list[int] | None = None, cols: int | None = None) -> DataFrame:
    """Coordinates to one dense array per row (i, vec), as wide as the matrix: missing entries are 0. All rows that
    have an entry, or the selected ones."""
    if cols is None:
        cols = mat_dims(entries).first()["cols"] or 0
    if selected is not None:
        entries = entries.filter(F.col("i").isin([int(i) for i in selected]))
    at = F.map_from_entries(F.collect_list(F.struct("j", "value")))
    places = F.sequence(F.lit(0).cast("bigint"), F.lit(max(cols - 1, 0)).cast("bigint"))
    return entries.groupBy("i").agg(at.alias("at")).select(
        "i", F.transform(places, lambda j: F.coalesce(F.try_element_at("at", j), F.lit(0.0))).alias("vec"))


def mat_add(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("i", "j").agg(F.sum("value").alias("value"))


def mat_sub(a: DataFrame, b: DataFrame) -> DataFrame:
    return mat_add(a, mat_scale(b, -1.0))


def mat_scale(a: DataFrame, k: float) -> DataFrame:
    return a.select("i", "j", (F.col("value") * F.lit(float(k))).alias("value"))


def mat_dims(entries: DataFrame) -> DataFrame:
    """One row: number of rows and columns."""
    return entries.agg((F.max("i") + 1).alias("rows"), (F.max("j") + 1).alias("cols"))


def mat_patch(entries: DataFrame, patch: DataFrame) -> DataFrame:
    """Overwrite cells from a patch table; cells only the patch has are added."""
    new = patch.select("i", "j", F.col("value").alias("_new"))
    return entries.join(new, ["i", "j"], "full").select("i", "j", F.coalesce("_new", "value").alias("value"))
