import re

import pytest
from conftest import tiny_lines
from pyspark.sql import functions as F

from factorloom import FMParams, schema
from factorloom.operators import cells as cx
from factorloom.operators import predict as pr
from factorloom.operators import similarity
from factorloom.plans import pipeline, runtime
from factorloom.sources import stores, tables
from factorloom.streaming import jobs

PARAMS = FMParams("tiny", 0.0, 0.1, 2, 5, 2, 2, 0.05, True, True, 0.0, 0.0, 0.0)


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("fmt, options", [("parquet", {}), ("csv", {"header": True}), ("json", {}), ("orc", {})])
def test_load_cells_with_default_names(spark, tmp_path, fmt, options):
    path = str(tmp_path / "cells")
    raw = spark.createDataFrame(tiny_lines(), "row bigint, col bigint, type string, value double")
    raw.withColumn("unused", F.lit(1)).write.format(fmt).options(**options).save(path)
    cells = tables.load_cells(spark, path, fmt, **options)
    assert cells.schema == schema.CELLS or [f.dataType for f in cells.schema] == [f.dataType for f in schema.CELLS]
    assert rows(cells) == sorted(tiny_lines())


def test_only_mapped_columns_are_read(spark, tmp_path):
    path = str(tmp_path / "cells")
    spark.createDataFrame(tiny_lines(), "row bigint, col bigint, type string, value double").withColumn(
        "unused", F.lit(1)).write.parquet(path)
    plan = tables.load_cells(spark, path).filter("col = 4")._jdf.queryExecution().executedPlan().toString()
    assert "unused" not in plan and "PushedFilters: [IsNotNull(col), EqualTo(col,4)]" in plan


def test_field_spec(spark, tmp_path):
    def spec(lines):
        path = str(tmp_path / f"spec{len(list(tmp_path.iterdir()))}")
        spark.createDataFrame(lines, "name string, datatype string, value string").write.json(path)
        return tables.field_spec(spark, path)

    assert tables.mapping_of(tables.field_spec(spark))["val"] == ("value", "double")
    assert tables.mapping_of(spec([("val", "double", "rating")])) == {
        "row": ("row", "long"), "col": ("col", "long"), "val": ("rating", "double"), "cat": ("type", "string")}
    path = str(tmp_path / "registered")
    tables.register_fields(spark, [("cat", "string", "kind"), ("row", "long", "id")], path)
    assert tables.mapping_of(tables.field_spec(spark, path))["cat"] == ("kind", "string")
    with pytest.raises(ValueError, match="Bad field spec"):
        tables.register_fields(spark, [("label", "long", "x")], path)
    for bad in ([("value", "double", "x")], [("val", "date", "x")], [("val", "double", "x"), ("val", "double", "y")]):
        with pytest.raises(ValueError, match="Bad field spec"):
            spec(bad)


def test_read_points_text(spark, tmp_path, model):
    path = str(tmp_path / "points")
    lines = ["5.0,1 0 1 0 0.5", "3.0,1 0 0 1 0.25,ignored", "4.0, 0 1 1 0 1 "]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    points = tables.read_points_text(spark, path)
    got = sorted((r["target"], [(e["col"], e["val"]) for e in r["features"]]) for r in points.collect())
    assert got[2] == (5.0, [(0, 1.0), (2, 1.0), (4, 0.5)])
    assert got[0] == (3.0, [(0, 1.0), (3, 1.0), (4, 0.25)])
    assert pr.rmse(points, model).first()["rmse"] == pytest.approx(3.7846138619, abs=1e-9)


def test_split_covers_every_row_once(spark, tmp_path):
    df = spark.range(10000).withColumn("x", F.col("id") * 2)
    for name, split in (("key", tables.split_rows(df, 5, 1, ["id"])), ("rand", tables.split_rows(df, 5, 1))):
        path = str(tmp_path / name)
        tables.write_parts(split, path)
        back = spark.read.parquet(path)
        assert back.select("id").distinct().count() == back.count() == 10000
        sizes = [r["count"] for r in back.groupBy("part").count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) < 400
    with pytest.raises(ValueError):
        tables.split_rows(df, 0)


def test_model_round_trip(spark, tmp_path, cells, model):
    model = model.with_(blocks=cx.block_metadata(cells), rmse=1.5, params=PARAMS.to_map())
    path = stores.save_model(model, str(tmp_path), "tiny", 7)
    assert path.endswith("/model/tiny/7")
    back = stores.load_model(spark, path)
    assert (back.c, back.rmse, back.num_attribute, back.num_factor) == (0.1, 1.5, 5, 2)
    assert FMParams.from_map(back.params) == PARAMS
    assert rows(back.factors) == rows(model.factors)
    assert rows(back.blocks) == rows(model.blocks)


def test_similarity_round_trip(spark, tmp_path):
    sim = spark.range(300).selectExpr("id % 100 as i", "id as j", "id / 300.0D as score")
    path = stores.save_similarity(sim, str(tmp_path), "tiny", 1)
    assert rows(stores.load_similarity(spark, path)) == rows(sim)
    some = stores.load_similarity(spark, path, [3, 40])
    assert rows(some) == rows(sim.filter("i in (3, 40)"))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "PushedFilters: [In(i" in plan


def test_registry_gives_the_newest(spark, tmp_path):
    base = str(tmp_path)
    assert not stores.exists(spark, base, "u", "m", "model")
    for created in (5, 9, 7):
        stores.register(spark, base, "u", "m", stores.MODEL, f"p{created}", created)
    stores.register(spark, base, "u", "other", stores.MODEL, "q", 99)
    assert stores.resolve(spark, base, "u", "m", "model") == "p9"
    assert not stores.exists(spark, base, "u", "m", "matrix")
    with pytest.raises(LookupError, match="is registered"):
        stores.resolve(spark, base, "nobody", "m", "model")
    with pytest.raises(ValueError):
        stores.register(spark, base, "u", "m", "table", "p")


@pytest.mark.parametrize("trainer", ["gd", "psgd", "ml"])
def test_train_and_score(spark, tmp_path, cells, trainer):
    base = str(tmp_path)
    model = pipeline.train_model(spark, cells, PARAMS.to_map(), base, "u1", trainer=trainer)
    assert model.rmse == pytest.approx(pr.rmse(cells, model).first()["rmse"])
    direct = rows(pr.predict(cells, model))
    scored = rows(pipeline.score(spark, cells, base, "u1", "tiny"))
    assert [r[0] for r in direct] == [r[0] for r in scored]
    assert [r[1] for r in direct] == pytest.approx([r[1] for r in scored])
    sim = stores.load_similarity(spark, stores.resolve(spark, base, "u1", "tiny", stores.MATRIX))
    assert sim.count() == 20  # every column with its four others
    assert stores.load_model(spark, stores.resolve(spark, base, "u1", "tiny", "model")).blocks.count() == 4


def test_similar_beyond_the_stored_total(spark, tmp_path, cells):
    for uid, limit in (("few", {"similarity_total": 2}), ("all", {"similarity_threshold": -2.0})):
        pipeline.train_model(spark, cells, PARAMS.to_map(), str(tmp_path / uid), uid, **limit)
    for total in (1, 2, 3, 4):
        few, every = (rows(pipeline.similar(spark, str(tmp_path / uid), uid, "tiny", total, [0, 3])) for uid in ("few", "all"))
        assert [r[0] for r in few] == [0, 3]
        for a, b in zip(few, every):
            a, b = (sorted(map(tuple, similarity.parse_similars(spark.createDataFrame([r], "col long, json string")).collect())) for r in (a, b))
            assert [x[:3] for x in a] == [x[:3] for x in b] and len(a) == total
            assert [x[3] for x in a] == pytest.approx([x[3] for x in b])


def test_errors_of_train_and_score(spark, tmp_path, cells):
    with pytest.raises(ValueError, match="missing"):
        pipeline.train_model(spark, cells, {"name": "x"}, str(tmp_path), "u")
    with pytest.raises(LookupError):
        pipeline.score(spark, cells, str(tmp_path), "u", "x")
    with pytest.raises(ValueError, match="Features are missing"):
        pr.predict(cells.select("row_id"), pr.init_model(spark, 5, 2, 0.0, 0.1))


def test_flags_are_stored_with_the_model(spark, tmp_path, cells, model):
    path = stores.save_model(model.with_(params={"k0": "false", "k1": "true"}), str(tmp_path), "tiny", 1)
    stores.register(spark, str(tmp_path), "u", "tiny", "model", path, 1)
    got = [r["prediction"] for r in pipeline.score(spark, cells, str(tmp_path), "u", "tiny").orderBy("row_id").collect()]
    assert got == pytest.approx([0.055, 0.4525, 0.225])


def test_append_batch_and_stream(spark, tmp_path, cells):
    store, arrivals, target = (str(tmp_path / x) for x in ("store", "arrivals", "target"))
    tables.append_cells(cells.filter("row_id = 1"), store)
    tables.append_cells(cells.filter("row_id > 1"), store)
    assert rows(spark.read.parquet(store)) == rows(cells)
    for batch in (1, 2):
        cells.filter(f"row_id % 2 = {batch % 2}").write.mode("append").parquet(arrivals)
        jobs.append_stream(jobs.cell_stream(spark, arrivals, 1), target, str(tmp_path / "offsets")).awaitTermination()
    assert rows(spark.read.parquet(target)) == rows(cells)


def test_stream_scores_like_the_table(spark, tmp_path, cells, model):
    points = cx.assemble_points(cells).select("row_id", "features")
    arrivals, out = str(tmp_path / "arrivals"), str(tmp_path / "out")
    for row in (1, 2, 3):
        points.filter(f"row_id = {row}").coalesce(1).write.mode("append").parquet(arrivals)
    stream = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(arrivals)
    jobs.score_stream(stream, model, out, str(tmp_path / "offsets")).awaitTermination()
    got = {r["row_id"]: r["prediction"] for r in spark.read.parquet(out).collect()}
    assert got == pytest.approx({1: 0.155, 2: 0.5525, 3: 0.325})


def test_a_column_is_read_from_one_folder_of_each_copy(spark, tmp_path):
    """Both sides of a pair are found by pruned folders, a range is no list, and two scores of a pair give one partner."""
    pairs = [(i, j, round(1 / (i + j), 9)) for i in range(40) for j in range(i + 1, 40)] + [(9, 3, 0.083333334)]
    sim = spark.createDataFrame(pairs, "i bigint, j bigint, score double")
    path = stores.save_similarity(sim, str(tmp_path), "tiny", 1)
    some = stores.load_similarity(spark, path, [3])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"PartitionFilters: \[[^\]]*bucket#\d+ = 3", plan)) == 2
    assert len(some.collect()) == 39 and some.filter("j = 9").first()["score"] == 0.083333334
    ranged = stores.load_similarity(spark, path, start=2, end=3)
    assert rows(ranged) == rows(stores.load_similarity(spark, path, [2, 3]))
    assert len(str(stores.load_similarity(spark, path, start=0, end=10 ** 9)._jdf.queryExecution())) < 20_000


def test_all_pairs_are_stored_once_and_as_they_come(spark, tmp_path):
    """Tiles of all pairs are written without a shuffle of the pairs and without a second copy; other pairs are dealt once."""
    factors = spark.range(200).selectExpr("id AS col", "array(cos(id * 1.0D), sin(id * 1.0D)) AS m")
    sim = similarity.column_similarities(factors)
    assert runtime.is_tiled(sim) and not runtime.is_tiled(sim.filter("score > 0.5"))
    path = stores.save_similarity(sim, str(tmp_path), "tiny", 1)
    assert [p.name for p in (tmp_path / "matrix" / "tiny").iterdir()] == ["1"]
    assert spark.read.parquet(path).count() == 200 * 199 // 2
    assert rows(stores.load_similarity(spark, path)) == rows(sim)
    assert stores.load_similarity(spark, path, [7, 64]).count() == 2 * 199
    dealt = stores.save_similarity(sim.filter("score > 0.5"), str(tmp_path), "some", 1)
    assert rows(stores.load_similarity(spark, dealt)) == rows(sim.filter("score > 0.5"))


def test_records_sent_again_are_stored_once(spark, tmp_path, cells):
    arrivals, target = str(tmp_path / "arrivals"), str(tmp_path / "target")
    at = cells.withColumn("sent", F.timestamp_seconds(F.col("row_id") * 60))
    for batch in ("row_id < 3", "row_id > 1", "row_id = 1"):
        again = at.filter(batch)
        again.unionByName(again).write.mode("append").parquet(arrivals)
        stream = jobs.cell_stream(spark, arrivals, event_time="sent")
        jobs.append_stream(stream, target, str(tmp_path / "offsets"), "sent", "1 hour").awaitTermination()
    assert rows(spark.read.parquet(target)) == rows(cells)


def test_parameters_keep_their_rule_of_values():
    values = {"name": "t", "init_mean": "0", "init_stdev": "1", "num_partitions": "1", "num_attribute": "", "num_factor": "2",
              "num_iter": "1", "learn_rate": "0.1", "k0": "true", "k1": "true", "reg_c": "0", "reg_v": "0", "reg_m": "0"}
    assert FMParams.from_map(values).keep == "positive"
    assert FMParams.from_map(FMParams.from_map({**values, "keep": "nonzero"}).to_map() | {"num_attribute": ""}).keep == "nonzero"
