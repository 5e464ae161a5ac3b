"""Encoders from raw tables to cells: one-hot, numeric and set blocks, the label, and all together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factorloom import schema
from factorloom.plans.joins import broadcast_limit, heaviest, lookup_join, measured_bytes
from factorloom.plans.runtime import as_stored, cut_lineage, is_stored, stage

# Keys are numbered inside 4096 buckets (three hex digits of the key's md5), then each bucket gets its
# offset. No task ever numbers all keys, and the numbers do not depend on partitioning or retries.
_BUCKET_DIGITS = 3
# Blocks of one column.
_ONE_COLUMN = (schema.NUMERICAL, schema.LABEL)


def number_keys(entries: DataFrame, offset: int = 0) -> DataFrame:
    """Give the distinct (block, cat, key) of `entries` gap-free columns from `offset`, block by block."""
    return _numbered(_counted_keys(entries), offset)


def _counted_keys(entries: DataFrame) -> DataFrame:
    """The distinct (block, cat, key) and their `rows`, stored."""
    return cut_lineage(entries.groupBy("block", "cat", "key").agg(F.count(F.lit(1)).alias("rows")))


def _numbered(keys: DataFrame, offset: int = 0) -> DataFrame:
    bucketed = keys.withColumn("bucket", F.substring(F.md5("key"), 1, _BUCKET_DIGITS))
    within = Window.partitionBy("block", "bucket").orderBy("key")
    numbered = bucketed.withColumn("pos", F.row_number().over(within).cast("bigint"))
    # At most 4096 rows per block, whatever the number of keys.
    sizes = bucketed.groupBy("block", "bucket").agg(F.count(F.lit(1)).alias("size"))
    before = Window.orderBy("block", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("block", "bucket", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    return (numbered.join(F.broadcast(bases), ["block", "bucket"])
            .select("block", "cat", "key", (F.lit(offset) + F.col("base") + F.col("pos") - 1).alias("col")))


def _encode(entries: DataFrame, dictionary: DataFrame, how: str = "inner") -> DataFrame:
    """Entries (row_id, block, key, val) to cells, by one join with the dictionary."""
    return _cells(lookup_join(entries, dictionary, ["block", "key"], measured_bytes(dictionary), how))


def _cells(joined: DataFrame) -> DataFrame:
    return joined.select("row_id", "col", "cat", F.col("val").cast("double").alias("val"))


def one_hot_block(df: DataFrame, row_id: str, key: str, cat: str, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """One column per distinct key, value 1.0. Returns (cells, dictionary(cat, key, col))."""
    entries = df.select(F.col(row_id).cast("bigint").alias("row_id"), F.lit(0).alias("block"),
                        F.lit(cat).alias("cat"), F.col(key).cast("string").alias("key"),
                        F.lit(1.0).alias("val")).filter(F.col("key").isNotNull())
    dictionary = cut_lineage(number_keys(entries, offset))
    return _encode(entries.drop("cat"), dictionary), dictionary.select("cat", "key", "col")


def numeric_block(df: DataFrame, row_id: str, value: str, offset: int = 0) -> DataFrame:
    """One column holding the numeric context. Null values make no cell."""
    return df.select(F.col(row_id).cast("bigint").alias("row_id"), F.lit(offset).cast("bigint").alias("col"),
                     F.lit(schema.NUMERICAL).alias("cat"),
                     F.col(value).cast("double").alias("val")).filter(F.col("val").isNotNull())


def set_weights(members: DataFrame, row_id: str, key: str, weight: str) -> DataFrame:
    """Add up the weights per (row, key), then scale every row to sum 1. The totals come by a join, not
    by a window, so that the members of one huge row can be split over tasks."""
    summed = (members.filter(F.col(key).isNotNull())
              .groupBy(F.col(row_id).cast("bigint").alias("row_id"), F.col(key).cast("string").alias("key"))
              .agg(F.sum(F.col(weight).cast("double")).alias("weight")))
    totals = summed.groupBy("row_id").agg(F.sum("weight").alias("total"))
    return summed.join(totals, "row_id").select("row_id", "key", (F.col("weight") / F.col("total")).alias("val"))


def set_block(members: DataFrame, row_id: str, key: str, weight: str, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """Multi-valued context from a long table (row, key, weight). Returns (cells, dictionary)."""
    entries = set_weights(members, row_id, key, weight).select(
        "row_id", F.lit(0).alias("block"), F.lit(schema.CATEGORICAL_SET).alias("cat"), "key", "val")
    dictionary = cut_lineage(number_keys(entries, offset))
    return _encode(entries.drop("cat"), dictionary), dictionary.select("cat", "key", "col")


def target_cells(df: DataFrame, row_id: str, target: str, width: int) -> DataFrame:
    """The target as the cell in the column after all features."""
    return df.select(F.col(row_id).cast("bigint").alias("row_id"), F.lit(width).cast("bigint").alias("col"),
                     F.lit(schema.LABEL).alias("cat"),
                     F.col(target).cast("double").alias("val")).filter(F.col("val").isNotNull())


@dataclass(frozen=True)
class Layout:
    """Which columns of a raw table make which blocks. The order of the blocks is fixed."""

    users: tuple = ()
    items: tuple = ()
    ctx_num: tuple = ()
    ctx_cat: tuple = ()
    ctx_set: tuple = ()
    target: str | None = None

    def blocks(self) -> list[tuple[int, str, str]]:
        """(block number, category, column)"""
        named = [(schema.USER, c) for c in self.users] + [(schema.ITEM, c) for c in self.items]
        named += [(schema.NUMERICAL, c) for c in self.ctx_num] + [(schema.CATEGORICAL, c) for c in self.ctx_cat]
        named += [(schema.CATEGORICAL_SET, c) for c in self.ctx_set]
        named += [(schema.LABEL, self.target)] if self.target is not None else []
        return [(number, cat, name) for number, (cat, name) in enumerate(named)]


def _raw(df: DataFrame, row_id: str, layout: Layout, only: list[str] | None = None) -> DataFrame:
    """(row_id, b0, b1 ...): what a raw table gives to its blocks, other than sets."""
    parts = [F.col(name).cast("double" if cat in _ONE_COLUMN else "string").alias(f"b{block}")
             for block, cat, name in layout.blocks() if _taken(cat, name, only)]
    return df.select(F.col(row_id).cast("bigint").alias("row_id"), *parts)


def _taken(cat: str, name: str, only: list[str] | None) -> bool:
    return cat != schema.CATEGORICAL_SET and (only is None or name in only)


def _members(layout: Layout, ctx_set: dict, only: list[str] | None = None) -> DataFrame | None:
    """(row_id, block, cat, key, val): the members of all sets."""
    out = None
    for block, cat, name in layout.blocks():
        if cat == schema.CATEGORICAL_SET and (only is None or name in only):
            members, member_row, key, weight = ctx_set[name]
            part = set_weights(members, member_row, key, weight).select(
                "row_id", F.lit(block).alias("block"), F.lit(cat).alias("cat"), "key", "val")
            out = part if out is None else out.unionByName(part)
    return out


def _entries(raw: DataFrame, layout: Layout, members: DataFrame | None, only: list[str] | None = None) -> DataFrame:
    """(row_id, block, cat, key, val): all entries of a raw row from one scan, plus the set members."""
    made = [F.struct(
        F.lit(block).alias("block"), F.lit(cat).alias("cat"),
        (F.lit(name) if cat in _ONE_COLUMN else F.col(f"b{block}")).alias("key"),
        (F.col(f"b{block}") if cat in _ONE_COLUMN else F.lit(1.0)).alias("val"))
        for block, cat, name in layout.blocks() if _taken(cat, name, only)]
    entries = (raw.select("row_id", F.explode(F.array(*made)).alias("e"))
               .select("row_id", "e.block", "e.cat", "e.key", "e.val")
               .filter(F.col("key").isNotNull() & F.col("val").isNotNull())) if made else None
    if members is not None:
        entries = members if entries is None else entries.unionByName(members)
    return entries


def build_cells(df: DataFrame, row_id: str, users=(), items=(), ctx_num=(), ctx_cat=(), ctx_set=None,
                target: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Encode a raw table into one dense, gap-free layout: (cells, dictionary(block, cat, key, col)).

    `ctx_set` maps a name to a long table (members, row, key, weight); the members are stored. The raw table is scanned
    once for the keys and once for the cells: every row gives all its entries, and one join numbers them. With a dictionary
    too big to broadcast the raw columns are stored, if they are not, and so are the cells."""
    layout = Layout(tuple(users), tuple(items), tuple(ctx_num), tuple(ctx_cat), tuple(ctx_set or {}), target)
    raw, members = _raw(df, row_id, layout), _members(layout, ctx_set or {})
    members = None if members is None else stage(members, "members")
    entries = _entries(raw, layout, members)
    keys = _counted_keys(entries)
    dictionary = cut_lineage(_numbered(keys))
    size = measured_bytes(dictionary)
    if size <= broadcast_limit(df.sparkSession):
        return _encode(entries.drop("cat"), dictionary), dictionary
    if not is_stored(df):
        entries = _entries(stage(raw, "raw"), layout, members)
    on = ["block", "key"]
    joined = lookup_join(as_stored(entries.drop("cat")), dictionary, on, size, "inner", heaviest(keys, on))
    return stage(_cells(joined), "cells"), dictionary


def encode_rows(df: DataFrame, row_id: str, layout: Layout, dictionary: DataFrame, only: list[str] | None = None,
                ctx_set: dict | None = None) -> DataFrame:
    """Encode new raw rows with an existing dictionary. `only` names the columns to use. A key the
    dictionary does not know gives a cell with a null column, which counts as no feature: the row stays."""
    entries = _entries(_raw(df, row_id, layout, only), layout, _members(layout, ctx_set or {}, only), only)
    return _encode(entries.drop("cat"), dictionary, "left")
