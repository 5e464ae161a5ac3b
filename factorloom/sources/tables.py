"""Reading cell tables and text points, field specs, and random splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom.operators.cells import sparsify

# The default field spec (logical name, type, physical name).
DEFAULT_FIELDS = [
    ("row", "long", "row"),
    ("col", "long", "col"),
    ("val", "double", "value"),
    ("cat", "string", "type"),
]

_LOGICAL = {"row": "row_id", "col": "col", "cat": "cat", "val": "val"}
_TYPES = {"long": "bigint", "double": "double", "string": "string", "int": "int"}
_SPEC_SCHEMA = "name string, datatype string, value string"


def field_spec(spark: SparkSession, spec_path: str | None = None) -> DataFrame:
    """(name, datatype, value): the registered spec (JSON lines) over the default one. Unknown names or
    types, or a name given twice, raise."""
    default = spark.createDataFrame(DEFAULT_FIELDS, _SPEC_SCHEMA)
    if spec_path is None:
        return default
    given = spark.read.schema(_SPEC_SCHEMA).json(spec_path)
    return merge_spec(default, given)


def _checked(lines: list) -> list:
    names = [r[0] for r in lines]
    bad = [name for name, datatype, _ in lines if name not in _LOGICAL or datatype not in (None, *_TYPES)]
    if bad or len(set(names)) != len(names):
        raise ValueError(f"Bad field spec: {names}")
    return lines


def register_fields(spark: SparkSession, fields: list[tuple[str, str, str]], path: str) -> None:
    """Store a spec: (logical name, type, physical name) for some or all of row, col, val, cat."""
    spark.createDataFrame(_checked(fields), _SPEC_SCHEMA).coalesce(1).write.json(path)


def merge_spec(default: DataFrame, given: DataFrame) -> DataFrame:
    _checked([tuple(r) for r in given.limit(len(_LOGICAL) + 1).collect()])
    chosen = given.select("name", F.col("datatype").alias("_t"), F.col("value").alias("_v"))
    return default.join(F.broadcast(chosen), "name", "left").select(
        "name", F.coalesce("_t", "datatype").alias("datatype"), F.coalesce("_v", "value").alias("value"))


def mapping_of(spec: DataFrame) -> dict[str, tuple[str, str]]:
    """Logical name -> (physical name, type). Four lines at most."""
    return {r["name"]: (r["value"], r["datatype"]) for r in spec.collect()}


def as_cells(raw: DataFrame, spec: DataFrame | None = None) -> DataFrame:
    """Project a raw table to the logical cell schema, with casts."""
    spec = spec if spec is not None else field_spec(raw.sparkSession)
    fields = mapping_of(spec)
    return raw.select(*[F.col(fields[name][0]).cast(_TYPES[fields[name][1]]).alias(logical)
                        for name, logical in _LOGICAL.items()])


def load_cells(spark: SparkSession, path: str, fmt: str = "parquet", spec: DataFrame | None = None,
               **options) -> DataFrame:
    """Read a table in any format Spark knows as cells. Only the mapped columns are read."""
    return as_cells(spark.read.format(fmt).options(**options).load(path), spec)


def parse_points(lines: DataFrame, line: Column, row_id: Column) -> DataFrame:
    """Lines `target,f0 f1 f2 ...` to points; what follows a second comma is ignored."""
    parts = F.split(line, ",")
    numbers = F.transform(F.split(F.trim(F.get(parts, F.lit(1))), " "), lambda x: x.cast("double"))
    return lines.select(row_id.alias("row_id"), F.get(parts, F.lit(0)).cast("double").alias("target"),
                        sparsify(numbers).alias("features"))


def read_points_text(spark: SparkSession, path: str) -> DataFrame:
    """Points of a text file. row_id is made from the line's position in its file split."""
    lines = spark.read.text(path).filter(F.trim("value") != "").withColumn("_id", F.monotonically_increasing_id())
    return parse_points(lines, F.col("value"), F.col("_id"))


def split_rows(df: DataFrame, n: int, seed: int = 0, key: list[str] | None = None) -> DataFrame:
    """Add a part number in [0, n). With a unique key the part comes from its hash, so it never
    changes; else it is drawn with a seed while the rows are read."""
    if n < 1:
        raise ValueError("n must be at least 1.")
    part = (F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(n)) if key
            else F.least(F.floor(F.rand(seed) * n), F.lit(n - 1)))
    return df.withColumn("part", part.cast("bigint"))


def write_parts(split: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write all parts in one job, one folder per part."""
    split.write.partitionBy("part").format(fmt).save(path)


def append_cells(new: DataFrame, path: str) -> None:
    """Append new feature records to a stored cell table."""
    new.select("row_id", "col", "cat", "val").write.mode("append").parquet(path)
