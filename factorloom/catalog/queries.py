"""One query per operator on the provided tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factorloom import schema
from factorloom.catalog import fixtures as fx
from factorloom.catalog import oracle_parts as sql
from factorloom.functions import matrices as mx
from factorloom.functions import vectors as vx
from factorloom.functions.random import gaussian_col, uniform_col
from factorloom.model import Model
from factorloom.operators import cells as cx
from factorloom.operators import encode as en
from factorloom.operators import gradient as gr
from factorloom.operators import predict as pr
from factorloom.operators import recommend as rc
from factorloom.operators import similarity as si
from factorloom.operators import train as tr
from factorloom.plans import pipeline
from factorloom.plans.runtime import stage, work_path
from factorloom.plans.topk import top_k
from factorloom.sources import stores, tables
from factorloom.streaming import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(check: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if check is not None:
            ORACLE[fn.__name__] = check
        return fn
    return add


def near(column: Column | str, digits: int = 6) -> Column:
    """Rounded for comparing, without minus zero."""
    return F.round(F.col(column) if isinstance(column, str) else column, digits) + F.lit(0.0)


def weight_lines(model: Model, digits: int = 6) -> DataFrame:
    """(col, part, value) lines of a model; the bias has column -1."""
    spark = model.factors.sparkSession
    names = [F.lit("v")] + [F.lit(f"m{f}") for f in range(model.num_factor)]
    values = [F.col("v")] + [F.col(f"m{f}") for f in range(model.num_factor)]
    pairs = F.array(*[F.struct(n.alias("part"), near(v, digits).alias("value")) for n, v in zip(names, values)])
    lines = model.wide().select("col", F.explode(pairs).alias("p")).select("col", "p.part", "p.value")
    bias = spark.range(1).select(F.lit(-1).cast("bigint").alias("col"), F.lit("c").alias("part"),
                                 near(F.lit(float(model.c)), digits).alias("value"))
    return bias.unionByName(lines)


def event_setup(spark, sf_dir, k: int = 2) -> tuple[DataFrame, DataFrame, Model]:
    cells, dictionary = fx.event_cells(spark, sf_dir)
    return cells, dictionary, fx.lattice_model(spark, fx.width(dictionary), k)


def rating_setup(spark, sf_dir, k: int = 2) -> tuple[DataFrame, DataFrame, Model]:
    cells, dictionary = fx.rating_cells(spark, sf_dir)
    return cells, dictionary, fx.lattice_model(spark, fx.width(dictionary), k)


# --- sources and sinks ---------------------------------------------------------------------------

_LINE_SPEC = [("row", "long", "l_orderkey"), ("col", "long", "l_partkey"), ("val", "double", "l_quantity"),
              ("cat", "string", "l_returnflag")]
_LINE_CELLS = """SELECT l_orderkey AS row_id, l_partkey AS col, l_returnflag AS cat, l_quantity AS val FROM lineitem"""


def _line_spec(spark) -> DataFrame:
    return spark.createDataFrame(_LINE_SPEC, "name string, datatype string, value string")


@query(_LINE_CELLS)
def load_cells(spark, sf_dir):
    return tables.load_cells(spark, f"{sf_dir}/lineitem.parquet", spec=_line_spec(spark))


@query(_LINE_CELLS)
def load_cells_csv(spark, sf_dir):
    path = work_path(spark, "csv")
    fx.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag").write.csv(
        path, header=True)
    return tables.load_cells(spark, path, "csv", _line_spec(spark), header=True)


@query(_LINE_CELLS)
def load_cells_json(spark, sf_dir):
    path = work_path(spark, "json")
    fx.read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_returnflag").write.json(path)
    return tables.load_cells(spark, path, "json", _line_spec(spark))


@query("""SELECT 'row' AS name, 'long' AS datatype, 'l_orderkey' AS value, count(l_orderkey) AS filled FROM lineitem
UNION ALL SELECT 'col', 'long', 'l_partkey', count(l_partkey) FROM lineitem
UNION ALL SELECT 'val', 'double', 'l_quantity', count(l_quantity) FROM lineitem
UNION ALL SELECT 'cat', 'string', 'l_returnflag', count(l_returnflag) FROM lineitem""")
def field_spec(spark, sf_dir):
    """A registered spec over the default one, and how many rows fill each mapped column."""
    path = work_path(spark, "spec")
    tables.register_fields(spark, _LINE_SPEC, path)
    spec = tables.field_spec(spark, path)
    lines = fx.read(spark, sf_dir, "lineitem")
    names = [value for value, _ in tables.mapping_of(spec).values()]
    counts = lines.agg(*[F.count(n).alias(n) for n in names])
    filled = counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("value"), F.col(n).alias("filled"))
                                               for n in names])).alias("f")).select("f.*")
    return spec.join(F.broadcast(filled), "value").select("name", "datatype", "value", "filled")


def _text_points(spark, sf_dir) -> str:
    path = work_path(spark, "points")
    line = F.concat_ws(",", F.col("l_quantity").cast("string"),
                       F.concat_ws(" ", F.col("l_discount").cast("string"), F.col("l_tax").cast("string")))
    fx.read(spark, sf_dir, "lineitem").select(line.alias("value")).write.text(path)
    return path


@query("""SELECT l_quantity AS target, CAST(0 AS BIGINT) AS col, l_discount AS val FROM lineitem WHERE l_discount > 0
UNION ALL SELECT l_quantity, CAST(1 AS BIGINT), l_tax FROM lineitem WHERE l_tax > 0""")
def read_points_text(spark, sf_dir):
    points = tables.read_points_text(spark, _text_points(spark, sf_dir))
    return points.select("target", F.explode("features").alias("e")).select("target", "e.col", "e.val")


@query("""SELECT count(*) AS rows, CAST(8 AS BIGINT) AS parts, count(DISTINCT event_id) AS ids,
CAST(sum(event_id) AS BIGINT) AS total FROM events""")
def split_rows(spark, sf_dir):
    path = work_path(spark, "parts")
    tables.write_parts(tables.split_rows(fx.read(spark, sf_dir, "events"), 8, 42, ["event_id"]), path)
    return spark.read.parquet(path).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("part").alias("parts"),
        F.countDistinct("event_id").alias("ids"), F.sum("event_id").alias("total"))


@query()
def split_rows_random(spark, sf_dir):
    split = tables.split_rows(fx.read(spark, sf_dir, "lineitem"), 8, 42)
    return split.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT part, true AS fair FROM (SELECT unnest(range(8)) AS part)")
def split_rows_random_shares(spark, sf_dir):
    """Every part of a random split within 5 standard deviations of its share."""
    lines = fx.read(spark, sf_dir, "lineitem")
    n = lines.count()
    sizes = tables.split_rows(lines, 8, 42).groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    fair = F.abs(F.col("rows") - n / 8) < 5 * (n * 7 / 64) ** 0.5
    return sizes.select(F.col("part").cast("bigint").alias("part"), fair.alias("fair"))


_EVENT_CELL_SUMS = sql.EVENTS_BASE + """
SELECT cat, count(*) AS cells, round(sum(val), 6) AS total FROM cells GROUP BY cat"""


def _cell_sums(cells: DataFrame) -> DataFrame:
    return cells.groupBy("cat").agg(F.count(F.lit(1)).alias("cells"), near(F.sum("val")).alias("total"))


@query(_EVENT_CELL_SUMS)
def append_cells(spark, sf_dir):
    cells, _ = fx.event_cells(spark, sf_dir)
    path = work_path(spark, "cells")
    label = F.col("cat") == schema.LABEL
    tables.append_cells(cells.filter(~label), path)
    tables.append_cells(cells.filter(label), path)
    return _cell_sums(spark.read.parquet(path))


@query(_EVENT_CELL_SUMS)
def append_cells_stream(spark, sf_dir):
    cells, _ = fx.event_cells(spark, sf_dir)
    arrivals, path = work_path(spark, "arrivals"), work_path(spark, "cells")
    cells.select("row_id", "col", "cat", "val").write.parquet(arrivals)
    jobs.append_stream(jobs.cell_stream(spark, arrivals), path, work_path(spark, "offsets")).awaitTermination()
    return _cell_sums(spark.read.parquet(path))


@query(_EVENT_CELL_SUMS)
def append_cells_stream_twice(spark, sf_dir):
    """All records are sent twice, to two runs of the stream, and stored once."""
    cells, _ = fx.event_cells(spark, sf_dir)
    times = fx.read(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), F.col("ts").cast("timestamp").alias("sent"))
    arrivals, path = work_path(spark, "arrivals"), work_path(spark, "cells")
    sent = stage(cells.join(times, "row_id").select("row_id", "col", "cat", "val", "sent"), "sent")
    offsets = work_path(spark, "offsets")
    for _ in range(2):
        sent.write.mode("append").parquet(arrivals)
        stream = jobs.cell_stream(spark, arrivals, event_time="sent")
        jobs.append_stream(stream, path, offsets, "sent", "3650 days").awaitTermination()
    return _cell_sums(spark.read.parquet(path))


@query(sql.EVENTS_BASE + """
SELECT 0.1e0 AS c, (SELECT n FROM dim) AS num_attribute, 2 AS num_factor, cat AS category, min(col) AS "begin", max(col) AS "end"
FROM cells GROUP BY cat""")
def save_model(spark, sf_dir):
    """Header and blocks as found on disk."""
    cells, _, model = event_setup(spark, sf_dir)
    model = model.with_(blocks=cx.block_metadata(cells))
    path = stores.save_model(model, work_path(spark, "store"), "events", 1)
    header = spark.read.parquet(f"{path}/header").first()
    return spark.read.parquet(f"{path}/blocks").select(
        F.lit(header["c"]).alias("c"), F.lit(header["num_attribute"]).cast("bigint").alias("num_attribute"),
        F.lit(header["num_factor"]).alias("num_factor"), "category", "begin", "end")


@query(f"{sql.RATINGS_BASE}, {sql.factors()}" + sql.weight_lines("factors", "0.1e0"))
def load_model(spark, sf_dir):
    _, _, model = rating_setup(spark, sf_dir)
    return weight_lines(stores.load_model(spark, stores.save_model(model, work_path(spark, "store"), "ratings", 1)))


_COSINE = ("(CASE WHEN {0}.m0 * {0}.m0 + {0}.m1 * {0}.m1 = 0 OR {1}.m0 * {1}.m0 + {1}.m1 * {1}.m1 = 0 THEN 0 ELSE "
           "({0}.m0 * {1}.m0 + {0}.m1 * {1}.m1) / (sqrt({0}.m0 * {0}.m0 + {0}.m1 * {0}.m1) "
           "* sqrt({1}.m0 * {1}.m0 + {1}.m1 * {1}.m1)) END)")
_EVENT_PAIRS = f"""{sql.EVENTS_BASE}, {sql.factors()},
sim AS (SELECT a.col AS i, b.col AS j, round({_COSINE.format("a", "b")}, 9) AS score FROM factors a JOIN factors b ON a.col < b.col)"""


@query(_EVENT_PAIRS + " SELECT i, count(*) AS others, round(sum(score), 6) + 0.0 AS total FROM sim GROUP BY i")
def save_similarity(spark, sf_dir):
    _, _, model = event_setup(spark, sf_dir)
    path = stores.save_similarity(si.column_similarities(model.factors), work_path(spark, "store"), "events", 1)
    return spark.read.parquet(path).groupBy("i").agg(F.count(F.lit(1)).alias("others"), near(F.sum("score")).alias("total"))


@query(_EVENT_PAIRS + " SELECT i, j, round(score, 6) + 0.0 AS score FROM sim WHERE i IN (0, 3, 64, 100)"
       + " UNION ALL SELECT j, i, round(score, 6) + 0.0 FROM sim WHERE j IN (0, 3, 64, 100)")
def load_similarity(spark, sf_dir):
    _, _, model = event_setup(spark, sf_dir)
    path = stores.save_similarity(si.column_similarities(model.factors), work_path(spark, "store"), "events", 1)
    return stores.load_similarity(spark, path, [0, 3, 64, 100]).select("i", "j", near("score").alias("score"))


@query("""SELECT CAST(o_custkey AS VARCHAR) AS uid, o_orderpriority AS name, 'model' AS kind,
arg_max('models/' || CAST(o_orderkey AS VARCHAR), o_orderkey) AS path, max(o_orderkey) AS created
FROM orders GROUP BY o_custkey, o_orderpriority""")
def model_registry(spark, sf_dir):
    """The newest entry per key of a registry as large as the orders table."""
    base = work_path(spark, "store")
    fx.read(spark, sf_dir, "orders").select(
        F.col("o_custkey").cast("string").alias("uid"), F.col("o_orderpriority").alias("name"),
        F.lit("model").alias("kind"), F.concat(F.lit("models/"), F.col("o_orderkey").cast("string")).alias("path"),
        F.col("o_orderkey").alias("created")).write.parquet(f"{base}/registry")
    return stores.newest(stores.registry(spark, base))


# --- encoders ------------------------------------------------------------------------------------

_ONE_HOT = """entries AS (SELECT event_id AS row_id, 0 AS block, 'user' AS cat, CAST(user_id AS VARCHAR) AS key, 1e0 AS val FROM events)"""


@query(f"WITH {_ONE_HOT}, {sql.DICT} SELECT row_id, col + 10 AS col, cat, val FROM cells")
def one_hot_block(spark, sf_dir):
    return en.one_hot_block(fx.read(spark, sf_dir, "events"), "event_id", "user_id", schema.USER, 10)[0]


@query("""SELECT event_id AS row_id, CAST(7 AS BIGINT) AS col, 'context_numerical' AS cat, value AS val
FROM events WHERE value IS NOT NULL""")
def numeric_block(spark, sf_dir):
    return en.numeric_block(fx.read(spark, sf_dir, "events"), "event_id", "value", 7)


@query(f"WITH {sql.SET_WEIGHTS}, entries AS (SELECT row_id, 0 AS block, 'context_categorical_set' AS cat, key, val FROM sw), "
       f"{sql.DICT} SELECT row_id, col, cat, round(val, 9) AS val FROM cells")
def set_block(spark, sf_dir):
    orders = fx.read(spark, sf_dir, "orders").withColumn("weight", F.lit(1.0))
    cells, _ = en.set_block(orders, "o_custkey", "o_orderpriority", "weight")
    return cells.withColumn("val", near("val", 9))


@query("SELECT event_id AS row_id, CAST(180 AS BIGINT) AS col, 'label' AS cat, value AS val FROM events WHERE value IS NOT NULL")
def target_cells(spark, sf_dir):
    return en.target_cells(fx.read(spark, sf_dir, "events"), "event_id", "value", 180)


_CELLS = " SELECT row_id, col, cat, round(val, 9) + 0.0 AS val FROM cells"


@query(sql.EVENTS_BASE + _CELLS)
def build_cells(spark, sf_dir):
    return fx.event_cells(spark, sf_dir)[0].withColumn("val", near("val", 9))


@query(sql.RATINGS_BASE + _CELLS)
def build_cells_ratings(spark, sf_dir):
    return fx.rating_cells(spark, sf_dir)[0].withColumn("val", near("val", 9))


@query(sql.PROFILE_BASE + _CELLS)
def build_cells_profiles(spark, sf_dir):
    return fx.profile_cells(spark, sf_dir)[0].withColumn("val", near("val", 9))


@query(sql.RATINGS_BASE + " SELECT cat, key, col FROM dict")
def build_dictionary(spark, sf_dir):
    return fx.rating_cells(spark, sf_dir)[1].select("cat", "key", "col")


# --- projections, filters, checks ----------------------------------------------------------------

_BALANCES = "SELECT c_custkey AS row_id, CAST(0 AS BIGINT) AS col, 'context_numerical' AS cat, c_acctbal AS val FROM customer"


def _balances(spark, sf_dir):
    return en.numeric_block(fx.read(spark, sf_dir, "customer"), "c_custkey", "c_acctbal")


@query(f"{_BALANCES} WHERE c_acctbal > 0")
def positive_only(spark, sf_dir):
    return cx.positive_only(_balances(spark, sf_dir))


@query(f"{_BALANCES} WHERE c_acctbal <> 0")
def nonzero_only(spark, sf_dir):
    return cx.positive_only(_balances(spark, sf_dir), "nonzero")


_FACTOR_LINES = "SELECT col, round(v, 6) + 0.0 AS v, round(m0, 6) + 0.0 AS m0, round(m1, 6) + 0.0 AS m1 FROM factors"


def _factor_lines(factors: DataFrame) -> DataFrame:
    return factors.select("col", near("v").alias("v"), near(F.col("m")[0]).alias("m0"), near(F.col("m")[1]).alias("m1"))


@query(f"{sql.RATINGS_BASE}, {sql.factors()} {_FACTOR_LINES} WHERE col BETWEEN 100 AND (SELECT n FROM dim) - 100")
def select_columns_range(spark, sf_dir):
    _, _, model = rating_setup(spark, sf_dir)
    return _factor_lines(cx.select_columns(model.factors, start=100, end=model.num_attribute - 100))


@query(f"{sql.RATINGS_BASE}, {sql.factors()} {_FACTOR_LINES} WHERE col IN (0, 5, 17, 1200)")
def select_columns_list(spark, sf_dir):
    _, _, model = rating_setup(spark, sf_dir)
    return _factor_lines(cx.select_columns(model.factors, [17, 0, 1200, 5]))


@query(sql.RATINGS_BASE + " SELECT row_id, round(arg_max(val, col), 9) AS target, max(col) AS top FROM cells GROUP BY row_id")
def split_target(spark, sf_dir):
    cells, _ = fx.rating_cells(spark, sf_dir)
    return cx.split_target(cells).withColumn("target", near("target", 9))


_NUMERIC_COL = "(SELECT col FROM dict WHERE cat = 'context_numerical')"


@query(sql.EVENTS_BASE + f""" SELECT row_id, round(coalesce(max(CASE WHEN col = {_NUMERIC_COL} AND val > 0 THEN val END), 0), 9) AS val
FROM cells GROUP BY row_id""")
def lookup(spark, sf_dir):
    cells, dictionary = fx.event_cells(spark, sf_dir)
    col = dictionary.filter(F.col("cat") == schema.NUMERICAL).first()["col"]
    return cx.assemble_points(cells).select("row_id", near(cx.lookup(F.col("features"), F.lit(col)), 9).alias("val"))


@query(sql.EVENTS_BASE + """, f AS (SELECT row_id, col, val, row_number() OVER (PARTITION BY row_id ORDER BY col) - 1 AS pos,
count(*) OVER (PARTITION BY row_id) AS entries FROM cells WHERE col < (SELECT n FROM dim) AND val > 0)
SELECT row_id, entries, (SELECT n FROM dim) AS length, pos, col AS "index", round(val, 9) AS value FROM f""")
def sparse_arrays(spark, sf_dir):
    cells, dictionary = fx.event_cells(spark, sf_dir)
    arrays = cx.sparse_arrays(cx.assemble_points(cells), fx.width(dictionary))
    return arrays.select("row_id", "entries", "length", F.posexplode(F.arrays_zip("indexes", "values")).alias("pos", "e")).select(
        "row_id", "entries", "length", F.col("pos").cast("bigint").alias("pos"), F.col("e.indexes").alias("index"),
        near(F.col("e.values"), 9).alias("value"))


@query("""SELECT event_id AS row_id, CAST(unnest([0, 1, 2]) AS BIGINT) AS pos,
unnest([round(value / 500, 9), hour(ts) / 23e0, 0e0]) AS val FROM events""".replace("hour(ts) / 23e0", "round(hour(ts) / 23e0, 9)"))
def densify(spark, sf_dir):
    """Two numbers per event, kept as a sparse vector of length 3, made dense again."""
    dense = F.array(F.col("value") / 500, F.hour("ts") / F.lit(23.0), F.lit(0.0))
    rows = fx.read(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), cx.sparsify(dense).alias("features"))
    return rows.select("row_id", F.posexplode(cx.densify(F.col("features"), 3)).alias("pos", "val")).select(
        "row_id", F.col("pos").cast("bigint").alias("pos"), near("val", 9).alias("val"))


_FAULTY = """WITH raw AS (
  SELECT l_orderkey AS row_id, CAST(l_linenumber AS BIGINT) AS col, round(l_discount * 10 - 0.1, 3) AS val,
         CASE WHEN l_linenumber = 1 THEN 'user' WHEN l_linenumber = 2 THEN 'item'
              WHEN l_linenumber IN (3, 5) THEN 'context_categorical_set' WHEN l_linenumber = 4 THEN 'context_numerical'
              WHEN l_linenumber = 6 THEN 'context_categorical' ELSE 'label' END AS cat FROM lineitem),
top AS (SELECT max(col) AS n FROM raw),
blocks AS (SELECT cat, min(col) AS b, max(col) AS e FROM raw GROUP BY cat),
per_row AS (SELECT row_id, max(col) AS top, sum(CASE WHEN cat = 'context_categorical_set' THEN val END) AS s FROM raw GROUP BY row_id)
SELECT 'num_attribute' AS rule, CAST(CASE WHEN (SELECT n FROM top) <> 6 THEN 1 ELSE 0 END AS BIGINT) AS violations
UNION ALL SELECT 'binary_values', count(*) FROM raw WHERE cat IN ('user', 'item', 'context_categorical') AND val NOT IN (0, 1)
UNION ALL SELECT 'negative_lost', count(*) FROM raw WHERE val < 0 AND col < (SELECT n FROM top)
UNION ALL SELECT 'missing_target', count(*) FROM per_row WHERE top < (SELECT n FROM top)
UNION ALL SELECT 'not_a_number', count(*) FROM raw WHERE isnan(val)
UNION ALL SELECT 'set_sum', count(*) FROM per_row WHERE abs(s - round(s)) > 1e-6 OR s < 0.5
UNION ALL SELECT 'duplicate_cell', count(*) FROM (SELECT 1 FROM raw GROUP BY row_id, col HAVING count(*) > 1)
UNION ALL SELECT 'overlapping_blocks', count(*) FROM blocks x WHERE EXISTS (
  SELECT 1 FROM blocks y WHERE (y.b < x.b OR (y.b = x.b AND y.e < x.e)) AND y.e >= x.b)"""


@query(_FAULTY)
def check_cells(spark, sf_dir):
    """Line items read as cells, which breaks most rules."""
    line = F.col("l_linenumber")
    cat = (F.when(line == 1, schema.USER).when(line == 2, schema.ITEM).when(line.isin(3, 5), schema.CATEGORICAL_SET)
           .when(line == 4, schema.NUMERICAL).when(line == 6, schema.CATEGORICAL).otherwise(schema.LABEL))
    cells = fx.read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("row_id"), line.cast("bigint").alias("col"), cat.alias("cat"),
        F.round(F.col("l_discount") * 10 - 0.1, 3).alias("val"))
    return cx.check_cells(cells, 6)


# --- joins and aggregates ------------------------------------------------------------------------

@query(f"""{sql.RATINGS_BASE}, {sql.factors()}
SELECT row_id, c.col, round(val, 9) + 0.0 AS val, round(v, 6) + 0.0 AS v, round(m0, 6) + 0.0 AS m0, round(m1, 6) + 0.0 AS m1
FROM cells c LEFT JOIN factors f ON c.col = f.col""")
def join_model(spark, sf_dir):
    cells, _, model = rating_setup(spark, sf_dir)
    return pr.join_model(cells.select("row_id", "col", "val"), model).select(
        "row_id", "col", near("val", 9).alias("val"), near("v").alias("v"), near("m0").alias("m0"), near("m1").alias("m1"))


@query(sql.RATINGS_BASE + " SELECT n AS num_attribute FROM dim")
def feature_dim(spark, sf_dir):
    return cx.feature_dim(fx.rating_cells(spark, sf_dir)[0])


@query(sql.EVENTS_BASE + """ SELECT c.row_id, round(t.val, 9) AS target, c.col, round(c.val, 9) AS val
FROM cells c JOIN cells t ON c.row_id = t.row_id AND t.col = (SELECT n FROM dim) WHERE c.col < (SELECT n FROM dim) AND c.val > 0""")
def assemble_points(spark, sf_dir):
    points = cx.assemble_points(fx.event_cells(spark, sf_dir)[0])
    return points.select("row_id", near("target", 9).alias("target"), F.explode("features").alias("e")).select(
        "row_id", "target", "e.col", near(F.col("e.val"), 9).alias("val"))


@query(sql.RATINGS_BASE + ' SELECT cat AS category, min(col) AS "begin", max(col) AS "end" FROM cells GROUP BY cat')
def block_metadata(spark, sf_dir):
    return cx.block_metadata(fx.rating_cells(spark, sf_dir)[0])


_RATED = f"""{sql.RATINGS_BASE}, {sql.factors()}, {sql.row_parts()},
tgt AS (SELECT row_id, val AS target FROM cells WHERE col = (SELECT n FROM dim))"""


@query(f"{_RATED} SELECT round(sqrt(avg(pow({sql.equation()} - target, 2))), 6) AS rmse FROM parts JOIN tgt USING (row_id)")
def rmse(spark, sf_dir):
    cells, _, model = rating_setup(spark, sf_dir)
    return pr.rmse(cells, model).select(near("rmse").alias("rmse"))


@query(f"""WITH lines AS (SELECT row_number() OVER () AS row_id, l_quantity, l_discount, l_tax FROM lineitem),
cells AS (SELECT row_id, CAST(0 AS BIGINT) AS col, l_discount AS val FROM lines UNION ALL SELECT row_id, CAST(1 AS BIGINT), l_tax FROM lines),
{sql.factors(2, "2")}, {sql.row_parts(2, "cells", "2")}
SELECT round(sqrt(avg(pow({sql.equation()} - l_quantity, 2))), 6) AS rmse FROM parts JOIN lines USING (row_id)""")
def rmse_text(spark, sf_dir):
    points = tables.read_points_text(spark, _text_points(spark, sf_dir))
    return pr.rmse(points, fx.lattice_model(spark, 2)).select(near("rmse").alias("rmse"))


@query(f"""{sql.RATINGS_BASE}, {sql.factors()}, {sql.row_parts()}
SELECT row_id, round(linear, 6) + 0.0 AS linear, round(s0, 6) + 0.0 AS s0, round(q0, 6) + 0.0 AS q0, round(s1, 6) + 0.0 AS s1, round(q1, 6) + 0.0 AS q1 FROM parts""")
def factor_sums(spark, sf_dir):
    cells, _, model = rating_setup(spark, sf_dir)
    sums = pr.factor_sums(cells, model)
    return sums.select("row_id", *[near(c).alias(c) for c in sums.columns if c != "row_id"])


@query(f"""{sql.EVENTS_BASE}, {sql.factors(64)}, {sql.row_parts(64)}
SELECT row_id, round(linear, 6) + 0.0 AS linear, round(s0, 6) + 0.0 AS s0, round(q0, 6) + 0.0 AS q0, round(s63, 6) + 0.0 AS s63, round(q63, 6) + 0.0 AS q63 FROM parts""")
def factor_vectors(spark, sf_dir):
    """Sums of 64 factors as vectors; the first and the last are shown."""
    cells, dictionary = fx.event_cells(spark, sf_dir)
    sums = pr.factor_vectors(cells, fx.lattice_model(spark, fx.width(dictionary), 64))
    shown = [F.col(c)[f].alias(f"{c}{f}") for f in (0, 63) for c in ("s", "q")]
    sums = sums.select("row_id", "linear", *shown)
    return sums.select("row_id", *[near(c).alias(c) for c in sums.columns if c != "row_id"])


# --- model ---------------------------------------------------------------------------------------

@query(f"{sql.RATINGS_BASE}, {sql.factors()} SELECT col, 0e0 AS v, 0.25e0 AS m0, 0.25e0 AS m1 FROM factors")
def init_model_constant(spark, sf_dir):
    _, dictionary = fx.rating_cells(spark, sf_dir)
    return pr.init_model(spark, fx.width(dictionary), 2, 0.25, 0.0).wide()


def _drawn(seed: int, factors: int, mean: float, stdev: float) -> str:
    """SQL of the hashed normal draws of all factors of column c."""
    u = "((('0x' || substr(md5(concat_ws(':', '{s}', '{f}', CAST(c AS VARCHAR), '{x}')), 1, 13))::BIGINT + 0.5e0) / 4503599627370496e0)"
    at = lambda f, x: u.format(s=seed, f=f, x=x)
    return " ".join(f"UNION ALL SELECT c, 'm{f}', round({mean}e0 + {stdev}e0 * sqrt(-2 * ln({at(f, 'r')})) * cos(2 * pi() * {at(f, 'a')}), 6) "
                    "+ 0.0 FROM cs" for f in range(factors))


@query(f"{sql.RATINGS_BASE}, cs AS (SELECT unnest(range((SELECT n FROM dim))) AS c) SELECT CAST(-1 AS BIGINT) AS col, 'c' AS part, 0e0 AS value "
       f"UNION ALL SELECT c, 'v', 0e0 FROM cs {_drawn(7, 2, 0.0, 0.1)}")
def init_model(spark, sf_dir):
    _, dictionary = fx.rating_cells(spark, sf_dir)
    return weight_lines(pr.init_model(spark, fx.width(dictionary), 2, 0.0, 0.1, seed=7))


@query(f"{sql.EVENTS_BASE}, {sql.factors()}, {sql.row_parts()} SELECT row_id, 0.1e0 AS bias, round(linear, 6) + 0.0 AS linear FROM parts")
def predict_linear_parts(spark, sf_dir):
    cells, _, model = event_setup(spark, sf_dir)
    return pr.predict_linear_parts(cells, model).select("row_id", "bias", near("linear").alias("linear"))


def _predictions(df: DataFrame) -> DataFrame:
    return df.select("row_id", near("prediction").alias("prediction"))


_EVENT_PREDICTIONS = (f"{sql.EVENTS_BASE}, {sql.factors()}, {sql.row_parts()} "
                      f"SELECT row_id, round({sql.equation()}, 6) + 0.0 AS prediction FROM parts")


@query(f"{sql.EVENTS_BASE}, {sql.factors(64)}, {sql.row_parts(64)} SELECT row_id, round({sql.equation(64)}, 6) + 0.0 AS prediction FROM parts")
def predict_many_factors(spark, sf_dir):
    """A model of 64 factors."""
    cells, dictionary = fx.event_cells(spark, sf_dir)
    return _predictions(pr.predict(cells, fx.lattice_model(spark, fx.width(dictionary), 64)))


@query(_EVENT_PREDICTIONS)
def predict_events(spark, sf_dir):
    cells, _, model = event_setup(spark, sf_dir)
    return _predictions(pr.predict(cells, model))


@query(_EVENT_PREDICTIONS)
def predict_points(spark, sf_dir):
    cells, _, model = event_setup(spark, sf_dir)
    return _predictions(pr.predict(cx.assemble_points(cells), model))


@query(f"{_RATED} SELECT row_id, round({sql.equation()}, 6) + 0.0 AS prediction FROM parts")
def predict(spark, sf_dir):
    cells, _, model = rating_setup(spark, sf_dir)
    return _predictions(pr.predict(cells, model))


@query(f"{sql.EVENTS_BASE}, {sql.factors()}, {sql.row_parts()} "
       f"SELECT row_id % 7 AS row_id, round({sql.equation()}, 6) + 0.0 AS prediction FROM parts")
def predict_repeated_ids(spark, sf_dir):
    """Seven ids for all points: each point is scored on its own."""
    cells, _, model = event_setup(spark, sf_dir)
    points = cx.assemble_points(cells).withColumn("row_id", F.col("row_id") % 7)
    return _predictions(pr.predict(points, model))


@query(f"{sql.RATINGS_BASE}, {sql.factors()} SELECT c_custkey AS row_id, round(0.1e0 + coalesce(v, 0), 6) + 0.0 AS prediction "
       "FROM customer LEFT JOIN dict d ON d.block = 0 AND d.key = CAST(c_custkey AS VARCHAR) LEFT JOIN factors f ON f.col = d.col")
def predict_unknown_keys(spark, sf_dir):
    """All customers by their key alone; those who never ordered get the bias."""
    _, dictionary, model = rating_setup(spark, sf_dir)
    rows = fx.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("row_id"), F.col("c_custkey").alias("o_custkey"))
    return _predictions(pr.predict(en.encode_rows(rows, "row_id", fx.RATINGS, dictionary, ["o_custkey"]), model))


@query(f"{_RATED} SELECT row_id, round({sql.equation(2, '0e0', '0e0')}, 6) + 0.0 AS prediction FROM parts")
def predict_pairs_only(spark, sf_dir):
    cells, _, model = rating_setup(spark, sf_dir)
    return _predictions(pr.predict(cells, model, k0=False, k1=False))


@query(f"""WITH cells AS (SELECT vec_id AS row_id, CAST(unnest(range(64)) AS BIGINT) AS col, CAST(unnest(embedding) AS DOUBLE) AS val FROM embeddings),
{sql.factors(2, "64")}, {sql.row_parts(2, "cells", "64")}
SELECT row_id, round({sql.equation()}, 6) + 0.0 AS prediction FROM parts""")
def predict_dense(spark, sf_dir):
    """Raw dense arrays: only their positive entries count."""
    rows = fx.vectors(spark, sf_dir).select(F.col("id").alias("row_id"), F.col("vec").alias("features"))
    return _predictions(pr.predict(rows, fx.lattice_model(spark, 64)))


@query(f"""{sql.descent(sql.EVENTS_BASE, 1)}
SELECT row_id, col, round(e, 6) + 0.0 AS error, round(e * x, 6) + 0.0 AS gv, round(e * (s0 * x - m0 * x * x), 6) + 0.0 AS g0,
round(e * (s1 * x - m1 * x * x), 6) + 0.0 AS g1 FROM feat JOIN w0 USING (col) JOIN e0 USING (row_id)
UNION ALL SELECT row_id, (SELECT n FROM dim), round(e, 6) + 0.0, round(e, 6) + 0.0, 0e0, 0e0 FROM e0""")
def sample_gradient(spark, sf_dir):
    cells, _, model = event_setup(spark, sf_dir)
    return gr.sample_gradient(cells, model).select(
        "row_id", "col", near("error").alias("error"), near("gv").alias("gv"),
        near(F.col("gm")[0]).alias("g0"), near(F.col("gm")[1]).alias("g1"))


_IS_ITEM = "col IN (SELECT col FROM dict WHERE cat = 'item')"


@query(f"{sql.RATINGS_BASE}, {sql.factors()}, moved AS (SELECT col, CASE WHEN {_IS_ITEM} THEN v + 0.5e0 ELSE v END AS v, "
       f"CASE WHEN {_IS_ITEM} THEN m0 + 1 ELSE m0 END AS m0, CASE WHEN {_IS_ITEM} THEN m1 - 1 ELSE m1 END AS m1 FROM factors)"
       + sql.weight_lines("moved", "0.35e0"))
def apply_update(spark, sf_dir):
    """Element by element: the item columns move, the others have no delta."""
    _, dictionary, model = rating_setup(spark, sf_dir)
    delta = dictionary.filter(F.col("cat") == schema.ITEM).select(
        "col", F.lit(0.5).alias("v"), F.array(F.lit(1.0), F.lit(-1.0)).alias("m"))
    return weight_lines(gr.add_delta(model, delta, 0.25))


@query(sql.descent(sql.RATINGS_BASE, 1) + sql.weight_lines("w1", "(SELECT c FROM c1)"))
def train_gd(spark, sf_dir):
    cells, _, model = rating_setup(spark, sf_dir)
    return weight_lines(tr.train_gd(cells, fx.params(), model))


@query(sql.descent(sql.EVENTS_BASE, 3) + sql.weight_lines("w3", "(SELECT c FROM c3)"))
def train_gd_three_steps(spark, sf_dir):
    cells, _, model = event_setup(spark, sf_dir)
    return weight_lines(tr.train_gd(cells, fx.params(num_iter=3), model))


@query()
def train_gd_minibatch(spark, sf_dir):
    cells, _, model = event_setup(spark, sf_dir)
    return weight_lines(tr.train_gd(cells, fx.params(num_iter=2), model, seed=3, batch_fraction=0.5))


@query()
def train_psgd(spark, sf_dir):
    cells, _, model = rating_setup(spark, sf_dir)
    return weight_lines(tr.train_psgd(cells, fx.params(num_partitions=spark.sparkContext.defaultParallelism), model))


@query()
def train_ml(spark, sf_dir):
    cells, _ = fx.rating_cells(spark, sf_dir)
    return weight_lines(tr.train_ml(cells, fx.params(num_iter=3)))


def _soundness(model: Model, better: bool) -> DataFrame:
    """What must hold for any trained model: every column once, only numbers, a smaller error than at the start."""
    fine = ~F.isnan("v") & F.forall("m", lambda x: ~F.isnan(x))
    return model.factors.agg(F.count(F.lit(1)).alias("weights"), F.countDistinct("col").alias("columns"),
                             F.bool_and(fine).alias("numbers"), F.lit(bool(better)).alias("better"))


def _gains(cells: DataFrame, model: Model, start: Model) -> bool:
    return pr.rmse(cells, model).first()["rmse"] < pr.rmse(cells, start).first()["rmse"]


@query(sql.EVENTS_BASE + " SELECT n AS weights, n AS columns, true AS numbers, true AS better FROM dim")
def train_gd_minibatch_sound(spark, sf_dir):
    cells, _, start = event_setup(spark, sf_dir)
    model = tr.train_gd(cells, fx.params(num_iter=2), start, seed=3, batch_fraction=0.5)
    return _soundness(model, _gains(cells, model, start))


@query(sql.RATINGS_BASE + " SELECT n AS weights, n AS columns, true AS numbers, true AS better FROM dim")
def train_psgd_sound(spark, sf_dir):
    cells, _, start = rating_setup(spark, sf_dir)
    model = tr.train_psgd(cells, fx.params(num_partitions=spark.sparkContext.defaultParallelism), start)
    return _soundness(model, _gains(cells, model, start))


@query(sql.RATINGS_BASE + " SELECT n AS weights, n AS columns, true AS numbers, true AS better FROM dim")
def train_ml_sound(spark, sf_dir):
    """Better here: than the prediction 0 for every row."""
    cells, dictionary = fx.rating_cells(spark, sf_dir)
    model = tr.train_ml(cells, fx.params(num_iter=3))
    return _soundness(model, _gains(cells, model, pr.init_model(spark, fx.width(dictionary), 2, 0.0, 0.0)))


@query(sql.descent(sql.EVENTS_BASE, 2) + sql.weight_lines("w1", "(SELECT c FROM c1)")
       + " UNION ALL SELECT CAST(-2 AS BIGINT), 'rmse', round(sqrt(avg(e * e)), 6) FROM e1"
       + " UNION ALL SELECT CAST(-3 AS BIGINT), 'pairs', (n * least(100, n - 1)) + 0e0 FROM dim")
def train_model(spark, sf_dir):
    """The whole pipeline: train, measure, store, register; then what the store gives back."""
    cells, _, start = event_setup(spark, sf_dir)
    base = work_path(spark, "store")
    pipeline.train_model(spark, cells, fx.params(name="events"), base, "u1", start=start)
    stored = stores.load_model(spark, stores.resolve(spark, base, "u1", "events", stores.MODEL))
    sim = stores.load_similarity(spark, stores.resolve(spark, base, "u1", "events", stores.MATRIX))
    pairs = sim.agg(F.lit(-3).cast("bigint").alias("col"), F.lit("pairs").alias("part"),
                    F.count(F.lit(1)).cast("double").alias("value"))
    error = spark.range(1).select(F.lit(-2).cast("bigint").alias("col"), F.lit("rmse").alias("part"),
                                  near(F.lit(stored.rmse)).alias("value"))
    return weight_lines(stored).unionByName(error).unionByName(pairs)


_SHIFTED_BASE = sql.EVENTS_BASE.replace("/ 100 AS k", "/ 100 - 0.5e0 AS k")


@query((sql.descent(_SHIFTED_BASE, 2) + sql.weight_lines("w1", "(SELECT c FROM c1)")
        + " UNION ALL SELECT CAST(-2 AS BIGINT), 'rmse', round(sqrt(avg(e * e)), 6) FROM e1").replace("c.val > 0", "c.val <> 0"))
def train_model_nonzero(spark, sf_dir):
    """Training, measuring and the stored parameters with values below 0 among the features."""
    rows = fx.event_rows(spark, sf_dir).withColumn("k", F.col("k") - 0.5)
    cells, dictionary = en.build_cells(rows, "row_id", **fx._args(fx.EVENTS))
    start, base = fx.lattice_model(spark, fx.width(dictionary)), work_path(spark, "store")
    pipeline.train_model(spark, cells, fx.params(name="events", keep="nonzero"), base, "u1", with_similarity=False, start=start)
    stored = stores.load_model(spark, stores.resolve(spark, base, "u1", "events", stores.MODEL))
    scored = pipeline.score(spark, cells, base, "u1", "events")
    target = cells.filter(F.col("cat") == schema.LABEL).select("row_id", F.col("val").alias("target"))
    error = pr.rmse_of(scored.join(target, "row_id")).select(
        F.lit(-2).cast("bigint").alias("col"), F.lit("rmse").alias("part"), near("rmse").alias("value"))
    return weight_lines(stored).unionByName(error)


@query(f"{_RATED} SELECT row_id, round({sql.equation()}, 6) + 0.0 AS prediction FROM parts")
def score(spark, sf_dir):
    cells, _, model = rating_setup(spark, sf_dir)
    base = work_path(spark, "store")
    stores.register(spark, base, "u1", "ratings", stores.MODEL, stores.save_model(model, base, "ratings", 1), 1)
    return _predictions(pipeline.score(spark, cells, base, "u1", "ratings"))


@query(_EVENT_PREDICTIONS)
def score_stream(spark, sf_dir):
    cells, _, model = event_setup(spark, sf_dir)
    arrivals, path = work_path(spark, "arrivals"), work_path(spark, "scored")
    cx.assemble_points(cells).select("row_id", "features").write.parquet(arrivals)
    rows = spark.readStream.schema(spark.read.parquet(arrivals).schema).parquet(arrivals)
    jobs.score_stream(rows, model, path, work_path(spark, "offsets")).awaitTermination()
    return _predictions(spark.read.parquet(path))


# --- similarity ----------------------------------------------------------------------------------

@query(_EVENT_PAIRS + " SELECT i, j, round(score, 6) + 0.0 AS score FROM sim")
def column_similarities(spark, sf_dir):
    _, _, model = event_setup(spark, sf_dir)
    return si.column_similarities(model.factors).select("i", "j", near("score").alias("score"))


@query("""SELECT a.vec_id AS i, b.vec_id AS j,
round(round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9), 6) + 0.0 AS score
FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
WHERE round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) >= 0.3""")
def column_similarities_threshold(spark, sf_dir):
    """Vectors as factor columns; only pairs at or above a cosine of 0.3."""
    factors = fx.vectors(spark, sf_dir).select(F.col("id").alias("col"), F.col("vec").alias("m"))
    return si.column_similarities(factors, 0.3).select("i", "j", near("score").alias("score"))


@query(_EVENT_PAIRS + " SELECT i, j, round(score, 6) + 0.0 AS score FROM sim UNION ALL SELECT j, i, round(score, 6) + 0.0 FROM sim")
def symmetric_similarity(spark, sf_dir):
    _, _, model = event_setup(spark, sf_dir)
    return si.symmetric_similarity(si.column_similarities(model.factors)).select("i", "j", near("score").alias("score"))


def _ranked(base: str, selected: str, others: str, total: int) -> str:
    return f"""{base}, {sql.factors()},
pairs AS (SELECT a.col AS col, b.col AS other, round({_COSINE.format("a", "b")}, 9) + 0.0 AS score
  FROM factors a JOIN factors b ON a.col <> b.col WHERE {selected} AND {others}),
ranked AS (SELECT col, row_number() OVER (PARTITION BY col ORDER BY score DESC, other) AS rank, other, round(score, 6) + 0.0 AS score FROM pairs),
best AS (SELECT * FROM ranked WHERE rank <= {total})"""


@query(_ranked(sql.EVENTS_BASE, "true", "true", 5) + " SELECT col, rank, other, score FROM best")
def similar_columns(spark, sf_dir):
    _, _, model = event_setup(spark, sf_dir)
    return si.similar_columns(model.factors, 5, start=0, end=model.num_attribute).withColumn("score", near("score"))


@query(_ranked(sql.RATINGS_BASE, "a.col IN (0, 3, 1700, 2500)", "true", 10) + " SELECT col, rank, other, score FROM best")
def similar_columns_list(spark, sf_dir):
    _, _, model = rating_setup(spark, sf_dir)
    return si.similar_columns(model.factors, 10, [2500, 3, 0, 1700]).withColumn("score", near("score"))


@query(_ranked(sql.EVENTS_BASE, "true", "true", 3) + " SELECT col, rank, other, score FROM best")
def similar_nested(spark, sf_dir):
    _, _, model = event_setup(spark, sf_dir)
    nested = si.similar_nested(si.similar_columns(model.factors, 3, start=0, end=model.num_attribute))
    return nested.select("col", F.posexplode("items").alias("pos", "e")).select(
        "col", (F.col("pos") + 1).cast("bigint").alias("rank"), F.col("e.col").alias("other"), near(F.col("e.score")).alias("score"))


@query(_ranked(sql.EVENTS_BASE, "true", "true", 3) + " SELECT col, rank, other, score FROM best")
def similars_json(spark, sf_dir):
    """To JSON text and back."""
    _, _, model = event_setup(spark, sf_dir)
    nested = si.similar_nested(si.similar_columns(model.factors, 3, start=0, end=model.num_attribute))
    return si.parse_similars(si.similars_json(nested)).withColumn("score", near("score"))


@query(_ranked(sql.RATINGS_BASE, "a.col IN (SELECT col FROM dict WHERE cat = 'user')", "b.col IN (SELECT col FROM dict WHERE cat = 'user')", 3)
       + " SELECT x.key AS key, rank, y.key AS other_key, score FROM best JOIN dict x ON best.col = x.col JOIN dict y ON other = y.col")
def similar_in_block(spark, sf_dir):
    """Users like this user, for all users."""
    cells, dictionary, model = rating_setup(spark, sf_dir)
    return si.similar_in_block(model.factors, cx.block_metadata(cells), dictionary, schema.USER, 3).withColumn("score", near("score"))


@query(_ranked(sql.EVENTS_BASE, "a.col IN (0, 3, 64, 100)", "true", 5) + " SELECT col, rank, other, score FROM best")
def similar_request(spark, sf_dir):
    """From the stored table of a registered model to JSON, and back."""
    _, _, model = event_setup(spark, sf_dir)
    base = work_path(spark, "store")
    path = stores.save_similarity(si.column_similarities(model.factors), base, "events", 1)
    stores.register(spark, base, "u1", "events", stores.MATRIX, path, 1)
    found = pipeline.similar(spark, base, "u1", "events", 5, [0, 3, 64, 100])
    return si.parse_similars(found).withColumn("score", near("score"))


@query(_ranked(sql.EVENTS_BASE, "a.col IN (0, 3, 64, 100)", "true", 5) + " SELECT col, rank, other, score FROM best")
def similar_request_threshold(spark, sf_dir):
    """The same from a table of the pairs above a threshold: columns with too few of them are searched in the model."""
    _, _, model = event_setup(spark, sf_dir)
    base = work_path(spark, "store")
    where = stores.save_model(model, base, "events", 1)
    path = stores.save_similarity(si.column_similarities(model.factors, 0.99), base, "events", 1, 0, where)
    stores.register(spark, base, "u1", "events", stores.MATRIX, path, 1)
    found = pipeline.similar(spark, base, "u1", "events", 5, [0, 3, 64, 100])
    return si.parse_similars(found).withColumn("score", near("score"))


@query("""WITH g AS (SELECT l_orderkey AS i, l_linenumber - 1 AS j, sum(l_quantity) AS value FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
w AS (SELECT max(j) + 1 AS n FROM g)
SELECT r.i, p.pos, coalesce(g.value, 0) + 0e0 AS value FROM (SELECT DISTINCT i FROM g) r, (SELECT unnest(range((SELECT n FROM w))) AS pos) p
LEFT JOIN g ON g.i = r.i AND g.j = p.pos""")
def mat_rows_gaps(spark, sf_dir):
    """Rows of a matrix with missing entries are dense and equally long."""
    line = fx.read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'")
    entries = line.groupBy(F.col("l_orderkey").cast("bigint").alias("i"), (F.col("l_linenumber") - 1).cast("bigint").alias("j")).agg(
        F.sum("l_quantity").cast("double").alias("value"))
    return mx.mat_rows(entries).select("i", F.posexplode("vec").alias("pos", "value")).select("i", F.col("pos").cast("bigint").alias("pos"), "value")


# --- recommendation ------------------------------------------------------------------------------

_LATEST = """latest AS (SELECT o_custkey AS row_id, CAST(o_custkey AS VARCHAR) AS u,
  arg_max(o_orderpriority, {'d': o_orderdate, 'k': o_orderkey}) AS p FROM orders GROUP BY o_custkey),
qcells AS (SELECT row_id, d.col, 1e0 AS val FROM latest JOIN dict d ON d.cat = 'user' AND d.key = u
  UNION ALL SELECT row_id, d.col, 1e0 FROM latest JOIN dict d ON d.cat = 'context_categorical' AND d.key = p)"""


def _recommended(seen: str, k: int) -> str:
    return f"""{sql.RATINGS_BASE}, {sql.factors()}, {_LATEST}, {sql.row_parts(2, "qcells")},
scored AS (SELECT row_id, f.col AS item, round({sql.equation()} + v + s0 * m0 + s1 * m1, 9) + 0.0 AS score
  FROM parts, factors f WHERE f.col IN (SELECT col FROM dict WHERE cat = 'item')),
ranked AS (SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, item) AS rank, item, score FROM scored{seen})
SELECT row_id, rank, item, round(score, 6) + 0.0 AS score FROM ranked WHERE rank <= {k}"""


def _recommend(spark, sf_dir, k, exclude):
    cells, dictionary, model = rating_setup(spark, sf_dir)
    queries = en.encode_rows(fx.latest_orders(spark, sf_dir), "row_id", fx.RATINGS, dictionary,
                             ["o_custkey", "o_orderpriority"])
    items = dictionary.filter(F.col("cat") == schema.ITEM).select("col")
    seen = None
    if exclude:
        bought = fx.rating_rows(spark, sf_dir).select(F.col("o_custkey").alias("row_id"), "l_partkey")
        seen = en.encode_rows(bought, "row_id", fx.RATINGS, dictionary, ["l_partkey"]).select("row_id", "col")
    return rc.recommend_items(queries, items, model, k, seen=seen).withColumn("score", near("score"))


@query(_recommended("", 3))
def recommend_items(spark, sf_dir):
    """Three items for every customer in the context of the customer's latest order."""
    return _recommend(spark, sf_dir, 3, False)


@query(_recommended(""" s WHERE NOT EXISTS (SELECT 1 FROM ra JOIN dict d ON d.cat = 'item' AND d.key = CAST(ra.l_partkey AS VARCHAR)
  WHERE ra.o_custkey = s.row_id AND d.col = s.item)""", 3))
def recommend_unseen_items(spark, sf_dir):
    return _recommend(spark, sf_dir, 3, True)


@query(f"""WITH {sql.TERM_ENTRIES}, {sql.DICT_NO_LABEL}, {sql.factors()},
pcells AS (SELECT row_id, col, val FROM cells WHERE cat = 'context_categorical_set'), {sql.row_parts(2, "pcells")},
scored AS (SELECT row_id, d.key AS concept, f.col AS item, round({sql.equation()} + v + s0 * m0 + s1 * m1, 9) + 0.0 AS score
  FROM parts, factors f JOIN dict d ON d.col = f.col AND d.cat = 'item'),
ranked AS (SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, item) AS rank, concept, score FROM scored)
SELECT row_id, rank, concept, round(score, 6) + 0.0 AS score FROM ranked WHERE rank <= 3""")
def predict_concepts(spark, sf_dir):
    """The three sources that fit best to each document's words."""
    terms = fx.document_terms(spark, sf_dir)
    cells, dictionary = en.build_cells(fx.read(spark, sf_dir, "documents"), "doc_id", items=["source"],
                                       ctx_set={"terms": (terms, "doc_id", "term", "weight")})
    model = fx.lattice_model(spark, fx.width(dictionary) + 1)
    profiles = cells.filter(F.col("cat") == schema.CATEGORICAL_SET)
    concepts = dictionary.filter(F.col("cat") == schema.ITEM).select("col", "key")
    return rc.predict_concepts(profiles, concepts, model, 3).withColumn("score", near("score"))


# --- sorts and top-k -----------------------------------------------------------------------------

@query("""WITH o AS (SELECT l_orderkey AS row_id, l_partkey AS col, max(l_quantity) AS val FROM lineitem GROUP BY 1, 2)
SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY col) - 1 AS pos, col, val FROM o""")
def sort_entries(spark, sf_dir):
    lines = fx.read(spark, sf_dir, "lineitem").groupBy(
        F.col("l_orderkey").alias("row_id"), F.col("l_partkey").alias("col")).agg(F.max("l_quantity").alias("val"))
    rows = cx.sparse_vector(lines, "row_id").select("row_id", F.posexplode(cx.sort_entries(F.col("features"))).alias("pos", "e"))
    return rows.select("row_id", F.col("pos").cast("bigint").alias("pos"), "e.col", "e.val")


@query("""SELECT user_id, rank, event_id, value FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank,
event_id, value FROM events) WHERE rank <= 5""")
def top_scores(spark, sf_dir):
    events = fx.read(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return top_k(events, ["user_id"], [F.desc("value"), F.asc("event_id")], 5, "event_id").select(
        "user_id", "rank", "event_id", "value")


@query(f"{sql.RATINGS_BASE}, {sql.factors()} SELECT row_number() OVER (ORDER BY col) - 1 AS place, col FROM factors WHERE col IN (3, 9, 40, 800, 1999)")
def selected_column_order(spark, sf_dir):
    """The answer lists the selected columns in ascending order, however they were given."""
    _, _, model = rating_setup(spark, sf_dir)
    chosen = cx.select_columns(model.factors, [1999, 3, 800, 9, 40]).select("col")
    # Five columns were asked for, so one task can hold the answer.
    return chosen.coalesce(1).select(F.monotonically_increasing_id().alias("place"), "col")


# --- vector tables -------------------------------------------------------------------------------

_PAIR = """WITH a AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
b AS (SELECT vec_id + 1 AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
p AS (SELECT a.id, a.vec AS x, b.vec AS y FROM a JOIN b ON a.id = b.id)"""


def _elements(df: DataFrame, key: str = "id") -> DataFrame:
    return df.select(key, F.posexplode("vec").alias("pos", "x")).select(
        key, F.col("pos").cast("bigint").alias("pos"), near("x").alias("x"))


def _element_sql(base: str, expression: str) -> str:
    return f"""{base}, e AS (SELECT id, unnest(range(len(x))) AS i, x, y FROM p)
SELECT id, CAST(i AS BIGINT) AS pos, round({expression}, 6) + 0.0 AS x FROM e"""


def _pair(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    left = fx.vectors(spark, sf_dir).select("id", "vec")
    return left, fx.shifted(left)


def _number(spark, sf_dir, op) -> DataFrame:
    return vx.combine(*_pair(spark, sf_dir), op, out="x").select("id", near("x").alias("x"))


def _single(spark, sf_dir, op) -> DataFrame:
    return fx.vectors(spark, sf_dir).select("id", op(F.col("vec")).alias("vec"))


@query(_element_sql(_PAIR, "x[i + 1] + y[i + 1]"))
def vec_add(spark, sf_dir):
    return _elements(vx.combine(*_pair(spark, sf_dir), vx.vec_add))


@query(_element_sql(_PAIR, "x[i + 1] - y[i + 1]"))
def vec_sub(spark, sf_dir):
    return _elements(vx.combine(*_pair(spark, sf_dir), vx.vec_sub))


@query(f"{_PAIR} SELECT id, round(list_dot_product(x, y), 6) + 0.0 AS x FROM p")
def vec_dot(spark, sf_dir):
    return _number(spark, sf_dir, vx.vec_dot)


@query(f"{_PAIR} SELECT id, round(list_dot_product(x, y) + list_dot_product(y, y), 6) + 0.0 AS x FROM p")
def vec_plus_dot(spark, sf_dir):
    return _number(spark, sf_dir, lambda a, b: vx.vec_plus_dot(a, b, b))


@query(_element_sql(_PAIR.replace("vec_id + 1 AS id", "vec_id AS id"), "x[i + 1] * 2.5"))
def vec_scale(spark, sf_dir):
    return _elements(_single(spark, sf_dir, lambda a: vx.vec_scale(a, 2.5)))


@query(_element_sql(_PAIR.replace("vec_id + 1 AS id", "vec_id AS id"), "x[i + 1] / 4"))
def vec_div(spark, sf_dir):
    return _elements(_single(spark, sf_dir, lambda a: vx.vec_div(a, 4.0)))


@query(_element_sql(_PAIR.replace("vec_id + 1 AS id", "vec_id AS id"), "-x[i + 1]"))
def vec_neg(spark, sf_dir):
    return _elements(_single(spark, sf_dir, vx.vec_neg))


@query("SELECT vec_id AS id, round(list_sum(CAST(embedding AS DOUBLE[])), 6) + 0.0 AS x FROM embeddings")
def vec_sum(spark, sf_dir):
    return fx.vectors(spark, sf_dir).select("id", near(vx.vec_sum(F.col("vec"))).alias("x"))


@query(f"{_PAIR} SELECT id, round(pow(list_distance(x, y), 2), 6) + 0.0 AS x FROM p")
def vec_sq_dist(spark, sf_dir):
    return _number(spark, sf_dir, vx.vec_sq_dist)


@query(f"{_PAIR} SELECT id, round(list_distance(x, y), 6) + 0.0 AS x FROM p")
def vec_dist(spark, sf_dir):
    return _number(spark, sf_dir, vx.vec_dist)


def _accumulated(how: str) -> str:
    return f"""SELECT label, pos, round({how}(x), 6) + 0.0 AS x FROM (SELECT CAST(label AS BIGINT) AS label,
CAST(unnest(range(64)) AS BIGINT) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY label, pos"""


@query(_accumulated("sum"))
def vec_accumulate(spark, sf_dir):
    return _elements(vx.vec_accumulate(fx.vectors(spark, sf_dir), "label"), "label")


@query(_accumulated("avg"))
def vec_mean(spark, sf_dir):
    return _elements(vx.vec_accumulate(fx.vectors(spark, sf_dir), "label", "mean"), "label")


def _nearest(measure: str, order: str, sign: str) -> str:
    return f"""WITH a AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
s AS (SELECT q.id AS query, t.id AS neighbour, round({measure}(q.vec, t.vec), 9) + 0.0 AS score FROM a q, a t),
r AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY score {order}, neighbour) AS rank, neighbour, score FROM s)
SELECT query, rank, neighbour, round(score, 6) + 0.0 AS score FROM r WHERE rank <= 5"""


@query(_nearest("list_distance", "ASC", "-"))
def nearest_vectors(spark, sf_dir):
    """The five nearest vectors of every vector, itself included."""
    table = fx.vectors(spark, sf_dir)
    return vx.nearest_vectors(table, table, 5).withColumn("score", near("score"))


@query(_nearest("list_dot_product", "DESC", ""))
def nearest_vectors_dot(spark, sf_dir):
    table = fx.vectors(spark, sf_dir)
    return vx.nearest_vectors(table, table, 5, "dot").withColumn("score", near("score"))


# --- matrices ------------------------------------------------------------------------------------

_MATRICES = """WITH a AS (SELECT l_suppkey AS i, CAST(l_linenumber AS BIGINT) AS j, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2),
b AS (SELECT l_suppkey AS i, CAST(l_linenumber AS BIGINT) AS j, sum(l_tax) AS value FROM lineitem GROUP BY 1, 2)"""


def _matrix(spark, sf_dir, column: str) -> DataFrame:
    return fx.read(spark, sf_dir, "lineitem").groupBy(
        F.col("l_suppkey").alias("i"), F.col("l_linenumber").cast("bigint").alias("j")).agg(F.sum(column).alias("value"))


def _entries(entries: DataFrame) -> DataFrame:
    return entries.select("i", "j", near("value").alias("value"))


@query("""SELECT i, j, 1.5e0 AS value FROM (SELECT unnest(range((SELECT max(l_suppkey) + 1 FROM lineitem))) AS i),
(SELECT unnest(range((SELECT max(l_linenumber) + 1 FROM lineitem))) AS j)""")
def mat_fill(spark, sf_dir):
    dims = mx.mat_dims(_matrix(spark, sf_dir, "l_quantity")).first()
    return mx.mat_fill(spark, dims["rows"], dims["cols"], 1.5)


@query("""SELECT vec_id AS i, CAST(unnest(range(64)) AS BIGINT) AS j, round(CAST(unnest(embedding) AS DOUBLE), 6) + 0.0 AS value FROM embeddings""")
def mat_from_rows(spark, sf_dir):
    return _entries(mx.mat_from_rows(fx.vectors(spark, sf_dir), "id"))


@query(_MATRICES + """, w AS (SELECT max(j) + 1 AS n FROM a)
SELECT r.i AS i, p.pos, round(coalesce(a.value, 0), 6) + 0.0 AS x FROM (SELECT DISTINCT i FROM a) r,
(SELECT unnest(range((SELECT n FROM w))) AS pos) p LEFT JOIN a ON a.i = r.i AND a.j = p.pos""")
def mat_rows(spark, sf_dir):
    return _elements(mx.mat_rows(_matrix(spark, sf_dir, "l_quantity")), "i")


@query(_MATRICES + """ SELECT i, j, round(a.value + b.value, 6) + 0.0 AS value FROM a JOIN b USING (i, j)""")
def mat_add(spark, sf_dir):
    a, b = (mx.Matrix.of(_matrix(spark, sf_dir, c)) for c in ("l_quantity", "l_tax"))
    return _entries((a + b).entries)


@query(_MATRICES + """ SELECT i, j, round(a.value - b.value, 6) + 0.0 AS value FROM a JOIN b USING (i, j)""")
def mat_sub(spark, sf_dir):
    a, b = (mx.Matrix.of(_matrix(spark, sf_dir, c)) for c in ("l_quantity", "l_tax"))
    return _entries((a - b).entries)


@query(_MATRICES + """ SELECT i, j, round(a.value * 0.5, 6) + 0.0 AS value FROM a""")
def mat_scale(spark, sf_dir):
    return _entries((mx.Matrix.of(_matrix(spark, sf_dir, "l_quantity")) * 0.5).entries)


@query(_MATRICES + """ SELECT max(i) + 1 AS rows, max(j) + 1 AS cols FROM a""")
def mat_dims(spark, sf_dir):
    return mx.mat_dims(_matrix(spark, sf_dir, "l_quantity"))


@query(_MATRICES + """, r AS (SELECT l_suppkey AS i, CAST(l_linenumber AS BIGINT) AS j, sum(l_quantity) AS value
FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
SELECT a.i, a.j, round(coalesce(r.value, b.value), 6) + 0.0 AS value FROM a JOIN b USING (i, j) LEFT JOIN r ON a.i = r.i AND a.j = r.j""")
def mat_patch(spark, sf_dir):
    """Cells with returned lines are overwritten by the returned quantity."""
    lines = fx.read(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == "R")
    patch = lines.groupBy(F.col("l_suppkey").alias("i"), F.col("l_linenumber").cast("bigint").alias("j")).agg(
        F.sum("l_quantity").alias("value"))
    return _entries(mx.mat_patch(_matrix(spark, sf_dir, "l_tax"), patch))


# --- random columns ------------------------------------------------------------------------------

@query()
def uniform_column(spark, sf_dir):
    return fx.read(spark, sf_dir, "orders").select("o_orderkey", uniform_col(11).alias("x"))


@query()
def gaussian_column(spark, sf_dir):
    return fx.read(spark, sf_dir, "orders").select("o_orderkey", gaussian_col(2.0, 0.5, 11).alias("x"))


@query("SELECT o_orderkey, 2e0 AS x FROM orders")
def gaussian_column_constant(spark, sf_dir):
    return fx.read(spark, sf_dir, "orders").select("o_orderkey", gaussian_col(2.0, 0.0).alias("x"))


_MOMENTS = "SELECT count(*) AS n, true AS range, true AS mean, true AS spread FROM orders"


def _moments(x: DataFrame, mean: float, stdev: float, within) -> DataFrame:
    """Range, and mean and spread within 5 standard errors."""
    n = F.count(F.lit(1))
    return x.agg(n.alias("n"), F.bool_and(within).alias("range"),
                 (F.abs(F.avg("x") - mean) < 5 * stdev / F.sqrt(n)).alias("mean"),
                 (F.abs(F.stddev("x") - stdev) < 5 * stdev / F.sqrt(n)).alias("spread"))


@query(_MOMENTS)
def uniform_column_moments(spark, sf_dir):
    return _moments(uniform_column(spark, sf_dir), 0.5, 12 ** -0.5, F.col("x").between(0, 1))


@query(_MOMENTS)
def gaussian_column_moments(spark, sf_dir):
    return _moments(gaussian_column(spark, sf_dir), 2.0, 0.5, F.abs(F.col("x") - 2.0) < 4.0)
