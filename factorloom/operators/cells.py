"""Operators on cells (row_id, col, cat, val) and points (row_id, target, features)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factorloom import schema
from factorloom.plans.joins import lookup_join, measured_bytes
from factorloom.plans.runtime import as_stored, cut_lineage, is_stored

_ONE_HOT = [schema.USER, schema.ITEM, schema.CATEGORICAL]


def kept(val: Column, keep: str = "positive") -> Column:
    """Which values count as features: "positive" (the default) or "nonzero". NaN never does; Spark
    would order it above all numbers."""
    if keep == "positive":
        return (val > 0) & ~F.isnan(val)
    if keep == "nonzero":
        return (val != 0) & ~F.isnan(val)
    raise ValueError(f"keep must be 'positive' or 'nonzero', not {keep!r}")


def positive_only(cells: DataFrame, keep: str = "positive") -> DataFrame:
    return cells.filter(kept(F.col("val"), keep))


def sparsify(values: Column, keep: str = "positive") -> Column:
    """Dense array to sparse entries array<struct<col, val>>."""
    entries = F.transform(values, lambda x, i: F.struct(i.cast("bigint").alias("col"), x.cast("double").alias("val")))
    return F.filter(entries, lambda e: kept(e["val"], keep))


def choose_columns(columns: DataFrame, explicit: list[int] | None = None, start: int | None = None,
                   end: int | None = None) -> DataFrame:
    """Rows of a table with a `col`, chosen by list or by inclusive range, in no order."""
    if explicit is not None:
        return columns.filter(F.col("col").isin([int(c) for c in explicit]))
    if start is not None and end is not None:
        return columns.filter(F.col("col").between(int(start), int(end)))
    raise ValueError("No columns are selected: give a list of columns, or start and end.")


def select_columns(columns: DataFrame, explicit: list[int] | None = None, start: int | None = None,
                   end: int | None = None) -> DataFrame:
    """The chosen rows in ascending order."""
    return choose_columns(columns, explicit, start, end).orderBy("col")


def feature_dim(cells: DataFrame) -> DataFrame:
    """One row: the highest column, which is the vector length and the target's column."""
    return cells.agg(F.max("col").alias("num_attribute"))


def num_attribute(cells: DataFrame, given: int | None = None, with_size: bool = False):
    """The vector length as a number, checked against a given one; on request with the cell count."""
    found = cells.agg(F.max("col").alias("top"), F.count(F.lit(1)).alias("size")).first()
    if found["top"] is None:
        raise ValueError("The cell table is empty.")
    if given is not None and int(given) != found["top"]:
        raise ValueError(f"num_attribute is {given}, but the highest column is {found['top']}.")
    return (int(found["top"]), int(found["size"])) if with_size else int(found["top"])


def split_target(cells: DataFrame) -> DataFrame:
    """Per row: the target (value at the row's highest column) and that column."""
    return cells.groupBy("row_id").agg(F.max_by("val", "col").alias("target"), F.max("col").alias("top"))


def assemble_points(cells: DataFrame, keep: str = "positive") -> DataFrame:
    """Points (row_id, target, features). A row's entries become one sparse vector, sorted by column.
    Training and scoring work on the cells and do not need this form."""
    return topped_points(cells, keep).drop("top")


def topped_points(cells: DataFrame, keep: str = "positive") -> DataFrame:
    """Points with the highest column of their row, `top`."""
    entry = F.struct(F.col("col").alias("col"), F.col("val").alias("val"))
    rows = cells.groupBy("row_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"))
    last = F.element_at("entries", -1)
    return rows.select(
        "row_id", last["val"].alias("target"),
        F.filter("entries", lambda e: (e["col"] < last["col"]) & kept(e["val"], keep)).alias("features"),
        last["col"].alias("top"))


def sort_entries(features: Column) -> Column:
    return F.array_sort(features)


def lookup(features: Column | str, index: int | Column) -> Column:
    """Value at an index, 0.0 if absent; the first entry wins on duplicates."""
    found = F.filter(features, lambda e: e["col"] == index)
    return F.when(F.size(found) > 0, F.get(found, F.lit(0))["val"]).otherwise(F.lit(0.0))


def sparse_vector(entries: DataFrame, on: str) -> DataFrame:
    """(on, col, val) rows to one sparse vector per key, sorted by column."""
    entry = F.struct(F.col("col").alias("col"), F.col("val").alias("val"))
    return entries.groupBy(on).agg(F.array_sort(F.collect_list(entry)).alias("features"))


def sparse_arrays(points: DataFrame, length: int) -> DataFrame:
    """Index list, value list, number of stored entries and logical length of each sparse vector."""
    others = [c for c in points.columns if c != "features"]
    return points.select(
        *others, F.transform("features", lambda e: e["col"]).alias("indexes"),
        F.transform("features", lambda e: e["val"]).alias("values"),
        F.size("features").cast("bigint").alias("entries"), F.lit(length).cast("bigint").alias("length"))


def densify(features: Column | str, length: int) -> Column:
    """Sparse entries to a dense array of a known length."""
    table = F.map_from_entries(F.array_distinct(features))
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)),
                       lambda i: F.coalesce(F.try_element_at(table, i.cast("bigint")), F.lit(0.0)))


def block_metadata(cells: DataFrame) -> DataFrame:
    """Column range per category, over all rows."""
    return cells.groupBy(F.col("cat").alias("category")).agg(
        F.min("col").alias("begin"), F.max("col").alias("end"))


def check_cells(cells: DataFrame, given_num_attribute: int | None = None, tolerance: float = 1e-6,
                dictionary: DataFrame | None = None) -> DataFrame:
    """Data-quality report (rule, violations), one row per rule. With a `dictionary` (block, col) the weights of every
    set of a row must sum to 1. Cells alone do not tell one set from another: then a row's sum must be a whole number.

    One aggregate by category gives the rules on cells and blocks. The rules on rows need one exchange of the cells, by
    ranges of (row_id, col): equal cells meet, a row is whole but for the ends of ranges, and a row as wide as many tasks is
    dealt to them. What is exchanged after it is one line for a row (or set) and task. An empty table breaks no rule."""
    n = F.count_if
    cat, val, col = F.col("cat"), F.col("val"), F.col("col")
    by_cat = cut_lineage(cells.groupBy("cat").agg(
        F.min("col").alias("begin"), F.max("col").alias("end"),
        n(cat.isin(_ONE_HOT) & ~val.isin(0.0, 1.0)).alias("binary_values"),
        n(F.isnan(val)).alias("not_a_number")))
    top = by_cat.agg(F.max("end")).first()[0]
    wrong_top = given_num_attribute is not None and top is not None and top != int(given_num_attribute)
    # A handful of categories: a window without keys is fine here.
    before = Window.orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    cellwise = by_cat.withColumn("reach", F.max("end").over(before)).agg(
        F.lit(int(wrong_top)).cast("bigint").alias("num_attribute"), F.sum("binary_values").alias("binary_values"),
        F.sum("not_a_number").alias("not_a_number"), n(F.col("reach") >= F.col("begin")).alias("overlapping_blocks"))

    in_set = cat == schema.CATEGORICAL_SET
    tagged = cells.select("row_id", "col", F.when(in_set, val).alias("_set"), ((val < 0) & (col < F.lit(top))).alias("_lost"))
    keys, tags = ["row_id"], []
    if dictionary is not None:
        names = dictionary.select("col", "block")
        tagged = lookup_join(tagged, names, ["col"], measured_bytes(names), "left")
        # Cells outside of sets share one line of their row.
        tagged = tagged.withColumn("block", F.when(F.col("_set").isNotNull(), F.col("block")))
        keys, tags = ["row_id", "block"], [F.first("block", ignorenulls=True).alias("block")]
    ranged = tagged.repartitionByRange("row_id", "col")
    distinct = ranged.groupBy("row_id", "col").agg(
        F.count(F.lit(1)).alias("copies"), F.sum("_set").alias("_set"), n("_lost").alias("_lost"), *tags)
    lines = distinct.groupBy(*keys).agg(
        F.max("col").alias("top"), F.sum("_set").alias("_set"), F.sum("_lost").alias("_lost"),
        n(F.col("copies") > 1).alias("duplicates"))
    total = F.col("_set")
    if dictionary is None:
        bad_set = (F.abs(total - F.round(total)) > tolerance) | (total < 0.5)
    else:
        bad_set = F.col("block").isNotNull() & (F.abs(total - 1) > tolerance)
    lines = lines.withColumn("_bad", F.coalesce(bad_set, F.lit(False)).cast("int"))
    if dictionary is not None:
        lines = lines.groupBy("row_id").agg(*[F.max("top").alias("top"), *[F.sum(c).alias(c) for c in ("_lost", "duplicates", "_bad")]])
    rowwise = lines.agg(n(F.col("top") < F.lit(top)).alias("missing_target"), F.sum("_bad").alias("set_sum"),
                        F.sum("_lost").alias("negative_lost"), F.sum("duplicates").alias("duplicate_cell"))

    report = None
    for part in (cellwise, rowwise):
        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.coalesce(F.col(c), F.lit(0)).cast("bigint")
                                             .alias("violations")) for c in part.columns])).alias("r")
        found = part.select(pairs).select("r.*")
        report = found if report is None else report.unionByName(found)
    return report


def to_cells(data: DataFrame) -> DataFrame:
    """Feature entries (row_id, col, val) of cells, points or rows of dense arrays. Rows without
    entries stay, with a null column."""
    kinds = {f.name: f.dataType for f in data.schema.fields}
    if "col" in kinds and "val" in kinds:
        cells = data.select("row_id", "col", "val")
        return as_stored(cells) if is_stored(data) else cells
    if "features" not in kinds:
        raise ValueError("Features are missing: expected cells (col, val) or a 'features' column.")
    if not isinstance(kinds["features"].elementType, T.StructType):
        data = data.withColumn("features", sparsify(F.col("features")))
    keys = ["row_id", *(["_point"] if "_point" in kinds else [])]
    return (data.select(*keys, F.explode_outer("features").alias("e"))
            .select(*keys, F.col("e.col").alias("col"), F.col("e.val").alias("val")))
