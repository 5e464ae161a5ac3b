import dataclasses
import math

import numpy as np
import pandas as pd
import pytest
from conftest import M, V, tiny_lines
from pyspark.sql import functions as F

from factorloom import FMParams, Model, schema
from factorloom.operators import cells as cx
from factorloom.operators import encode as en
from factorloom.operators import gradient as gr
from factorloom.operators import predict as pr
from factorloom.operators import train as tr
from factorloom.plans import joins
from factorloom.plans.runtime import stage

PARAMS = FMParams("t", 0.0, 0.1, 1, 5, 2, 1, 0.01, True, True, 0.1, 0.2, 0.2)


def predictions(df):
    return [r["prediction"] for r in df.orderBy("row_id").collect()]


def weights(model):
    rows = sorted((r["col"], r["v"], list(r["m"])) for r in model.factors.collect())
    return [r[1] for r in rows], [[r[2][f] for r in rows] for f in range(model.num_factor)]


def assert_weights(model, c, v, m0, m1):
    got_v, got_m = weights(model)
    assert model.c == pytest.approx(c, abs=1e-9)
    assert got_v == pytest.approx(v, abs=1e-9)
    assert got_m[0] == pytest.approx(m0, abs=1e-9)
    assert got_m[1] == pytest.approx(m1, abs=1e-9)


BATCH = (0.1364583333333, [0.1241083333333, 0.21185, -0.0714, 0.3075583333333, 0.0722645833333],
         [0.1043348958333, 0.2038875, 0.30448125, -0.0988821875, 0.059255],
         [0.2024554166667, -0.101025, 0.09774, 0.40042375, -0.19595375])
EPOCH = (0.206699861, [0.1710694509, 0.2340134944, -0.0159337094, 0.3216154555, 0.1148928569],
         [0.1130968019, 0.2116336212, 0.3133470097, -0.0963472687, 0.0771920575],
         [0.2070226968, -0.1023589435, 0.0940847593, 0.4011520883, -0.1878889276])
ONE = (0.14835, [0.14825, 0.1996, -0.05135, 0.2994, 0.074125], [0.11554625, 0.1996, 0.30545625, -0.0998, 0.05959],
       [0.1996, -0.0998, 0.104645, 0.3992, -0.1923325])


@pytest.mark.parametrize("k0, k1, expected", [
    (True, True, [0.155, 0.5525, 0.325]), (True, False, [0.13, 0.14, 0.175]),
    (False, True, [0.055, 0.4525, 0.225]), (False, False, [0.03, 0.04, 0.075])])
def test_golden_predictions(cells, model, k0, k1, expected):
    assert predictions(pr.predict(cells, model, k0, k1)) == pytest.approx(expected, abs=1e-12)
    assert predictions(pr.predict(cx.assemble_points(cells), model, k0, k1)) == pytest.approx(expected, abs=1e-12)


def test_dense_rows_and_empty_rows(spark, model):
    rows = spark.createDataFrame([(1, [1.0, 0.0, 1.0, 0.0, 0.5]), (2, [-1.0, 0.0, 0.0, 0.0, -2.0]), (3, [])],
                                 "row_id bigint, features array<double>")
    assert predictions(pr.predict(rows, model)) == pytest.approx([0.155, 0.1, 0.1])


def test_pair_term_equals_explicit_pairs(cells, model):
    got = predictions(pr.predict(cells, model, False, False))
    m = np.array(M)
    for point, value in zip(cx.assemble_points(cells).orderBy("row_id").collect(), got):
        f = [(e["col"], e["val"]) for e in point["features"]]
        pairs = sum(m[:, i] @ m[:, j] * x * y for a, (i, x) in enumerate(f) for j, y in f[a + 1:])
        assert value == pytest.approx(pairs, abs=1e-12)


def test_factor_sums_and_linear_parts(cells, model):
    sums = pr.factor_sums(cells, model).filter("row_id = 1").first()
    assert (sums["linear"], sums["s0"], sums["q0"]) == pytest.approx((0.025, 0.425, 0.100625))
    parts = pr.predict_linear_parts(cells, model, k0=False).filter("row_id = 1").first()
    assert (parts["bias"], parts["linear"]) == pytest.approx((0.0, 0.025))


def test_rmse(cells, model, spark):
    assert pr.rmse(cells, model).first()["rmse"] == pytest.approx(3.7846138619, abs=1e-9)
    assert pr.rmse(cx.assemble_points(cells), model).first()["rmse"] == pytest.approx(3.7846138619, abs=1e-9)
    assert pr.rmse(cells.limit(0), model).first()["rmse"] is None


def test_single_update(make_cells, model):
    data = gr.prepare(make_cells().filter("row_id = 1"), 5)
    assert_weights(tr.train_gd(data, PARAMS, model), *ONE)


def test_sample_gradient(cells, model):
    lines = {(r["row_id"], r["col"]): r for r in gr.sample_gradient(cells, model).collect()}
    assert lines[1, 0]["error"] == pytest.approx(-4.845)
    assert lines[1, 4]["gv"] == pytest.approx(-4.845 * 0.5)
    assert lines[1, 5]["gv"] == pytest.approx(-4.845)
    assert list(lines[1, 5]["gm"]) == [0.0, 0.0]
    assert list(lines[1, 4]["gm"]) == pytest.approx([-4.845 * (0.425 * 0.5 - 0.05 * 0.25), -4.845 * (0.2 * 0.5 + 0.2 * 0.25)])


def test_full_batch_step(cells, model):
    assert_weights(tr.train_gd(cells, PARAMS, model), *BATCH)


def test_epoch_of_one_part_is_the_serial_sequence(cells, model):
    assert_weights(tr.train_psgd(cells, PARAMS, model), *EPOCH)


def serial(points, c, v, m, p, k0=True, k1=True):
    """Plain per-sample updates over the full length, as the textbook has them."""
    v, m = np.array(v, float), np.array(m, float)
    for target, x in points:
        s = m @ x
        e = k0 * c + k1 * (v @ x) + 0.5 * (s @ s - ((m * x) ** 2).sum()) - target
        dm = -p.learn_rate * (e * (np.outer(s, x) - m * x * x) + p.reg_m * m)
        dc = -p.learn_rate * (e + p.reg_c * c) if k0 else 0.0
        dv = -p.learn_rate * (e * x + p.reg_v * v) if k1 else 0.0
        c, v, m = c + dc, v + dv, m + dm
    return c, v, m


@pytest.mark.parametrize("k0, k1", [(True, True), (False, True), (True, False)])
def test_psgd_averages_serial_parts(spark, k0, k1):
    rng = np.random.default_rng(1)
    n, dim, k = 60, 12, 3
    lines, points = [], {}
    for r in range(n):
        x = np.zeros(dim)
        x[rng.choice(dim, rng.integers(0, 4), replace=False)] = rng.uniform(0.2, 1.0)
        points[r] = (float(rng.normal()), x)
        lines += [(r, c, "item", float(x[c])) for c in np.flatnonzero(x).tolist()] + [(r, dim, "label", points[r][0])]
    cells = spark.createDataFrame(lines, schema.CELLS)
    v, m = rng.normal(size=dim), rng.normal(size=(k, dim)) * 0.3
    start = Model(0.4, spark.createDataFrame([(i, float(v[i]), m[:, i].tolist()) for i in range(dim)], schema.FACTORS), dim, k)
    p = FMParams("t", 0, 0.1, 3, dim, k, 1, 0.05, k0, k1, 0.01, 0.1, 0.3)
    got = tr.train_psgd(cells, p, start)
    part = {r["id"]: r["p"] for r in spark.range(n).selectExpr("id", "pmod(hash(id), 3) as p").collect()}
    c_mean, v_mean, m_mean = 0.0, np.zeros(dim), np.zeros((k, dim))
    for q in set(part.values()):
        mine = [points[r] for r in range(n) if part[r] == q]
        c1, v1, m1 = serial(mine, 0.4, v, m, p, k0, k1)
        c_mean, v_mean, m_mean = c_mean + c1 * len(mine) / n, v_mean + v1 * len(mine) / n, m_mean + m1 * len(mine) / n
    got_v, got_m = weights(got)
    assert got.c == pytest.approx(c_mean, abs=1e-9)
    assert got_v == pytest.approx(v_mean, abs=1e-9)
    assert np.allclose(got_m, m_mean, atol=1e-9)


def test_order_and_partitions_do_not_matter(cells, model):
    shuffled = cells.orderBy(F.desc("col")).repartition(5)
    assert_weights(tr.train_gd(shuffled, PARAMS, model), *BATCH)
    assert_weights(tr.train_psgd(shuffled, PARAMS, model), *EPOCH)


def own_exchanges(df):
    """What the plan shuffles, without the plans of persisted tables."""
    out, hidden = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        if hidden is not None and depth > hidden:
            continue
        hidden = depth if "InMemoryRelation" in line else None
        if "Initial Plan" in line:
            break
        if "Exchange" in line and "ReusedExchange" not in line:
            out.append(line.split("Exchange", 1)[1].strip())
    return out


@pytest.mark.parametrize("wide", [1_000_000, 3])
def test_a_step_beyond_the_broadcast_limit_moves_no_cell(spark, cells, model, monkeypatch, wide):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(gr, "_WIDE_ROW", wide)
    try:
        data = gr.with_routes(gr.prepare(cells, 5), 1)
        assert (data.wide is not None) == (wide == 3)
        step = gr.mean_gradient(data, gr.weights_of(model), model.num_factor, True, True)
        moved = own_exchanges(step)
        if wide > 3:  # weights by column, weights to the parts that use them, sums by column
            assert not [m for m in moved if "row_id" in m], moved
            assert sum(m.startswith("shufflepartitionidpassthrough") for m in moved) == 1
        assert_weights(tr.train_gd(data, PARAMS, model), *BATCH)
        data.release()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_the_salted_join_computes_facts_once(spark, monkeypatch):
    monkeypatch.setattr(joins, "_HOT_KEYS", 2)
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    facts = spark.range(3000).selectExpr("id", "IF(id % 3 = 0, 7, IF(id % 50 = 1, NULL, id % 40)) AS k").mapInPandas(count, "id long, k long")
    table = spark.range(39).selectExpr("id AS k", "id * 2 AS v")
    hot = spark.createDataFrame([(7,)], "k long")
    for given in (None, hot):
        before = seen.value
        got = joins.lookup_join(facts, table, ["k"], 1 << 60, "left", given).collect()
        assert seen.value - before == 3000 and len(got) == 3000
        assert all(r["v"] == (None if r["k"] is None or r["k"] > 38 else 2 * r["k"]) for r in got)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_facts_of_hot_keys_are_not_shuffled(spark, monkeypatch, how):
    monkeypatch.setattr(joins, "_FACTS_PER_TASK", 100)
    facts = stage(spark.range(3000).selectExpr("id", "IF(id % 3 = 0, 7, IF(id % 50 = 1, NULL, id % 40)) AS k"), "facts")
    table = spark.range(39).selectExpr("id AS k", "id * 2 AS v")
    hot = spark.createDataFrame([(7,), (39,)], "k long")
    joined = joins.lookup_join(facts, table, ["k"], 1 << 60, how, hot)
    got = sorted((r["id"], -1 if r["k"] is None else r["k"], r["v"]) for r in joined.collect())
    want = sorted((r["id"], -1 if r["k"] is None else r["k"], None if r["k"] is None or r["k"] > 38 else 2 * r["k"])
                  for r in facts.collect())
    assert joined.columns == ["k", "id", "v"]
    assert got == (want if how == "left" else [w for w in want if w[2] is not None])
    # Only the other facts move, to as many tasks as their number asks for.
    moved = [m for m in own_exchanges(joined) if m.startswith("hashpartitioning")]
    assert len(moved) == 2 and all(", 30)" in m for m in moved), moved


@pytest.mark.parametrize("limit", ["-1", "10m"])
def test_sums_of_a_wide_model_are_not_shuffled(spark, limit):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    cells = spark.range(400).selectExpr("IF(id % 9 = 0, NULL, id % 90) AS row_id", "IF(id % 13 = 0, NULL, id % 31) AS col",
                                        "'user' AS cat", "id % 5 - 1.0D AS val")
    wide = pr.init_model(spark, 30, 40, 0.1, 0.3, 4)
    ms = np.array([r["m"] for r in wide.factors.orderBy("col").collect()])
    s, q = {}, {}
    for r in cells.collect():
        known = r["col"] is not None and r["col"] < 30 and r["val"] > 0
        d = ms[r["col"]] * r["val"] if known else np.zeros(40)
        s[r["row_id"]] = s.get(r["row_id"], 0) + d
        q[r["row_id"]] = q.get(r["row_id"], 0) + d * d
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        found = pr.factor_vectors(cells, wide)
        moved = own_exchanges(found)
        rows, scores = found.collect(), dict(pr.predict(cells, wide).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert not [m for m in moved if "block" in m] and (limit == "-1" or len([m for m in moved if "row_id" in m]) == 1), moved
    assert len(rows) == len(s) == len(scores)
    for r in rows:
        assert np.allclose(r["s"], s[r["row_id"]], atol=1e-9) and np.allclose(r["q"], q[r["row_id"]], atol=1e-9)
        assert scores[r["row_id"]] == pytest.approx(0.5 * (s[r["row_id"]] ** 2 - q[r["row_id"]]).sum(), abs=1e-9)


def test_vectors_for_spark_ml_need_one_shuffle(spark, make_cells, monkeypatch):
    from pyspark.sql import DataFrame

    cells = make_cells({}, [(9, 0, "user", 1.0), (None, 5, "label", 2.0)])
    joins_made, join = [], DataFrame.join
    monkeypatch.setattr(type(cells), "join", lambda self, *a, **kw: joins_made.append(a) or join(self, *a, **kw))
    got = {}
    monkeypatch.setattr(tr.FMRegressor, "fit", lambda self, data: got.update(rows=data.collect()) or (_ for _ in ()).throw(KeyError("stop")))
    with pytest.raises(KeyError):
        tr.train_ml(cells, PARAMS)
    assert not joins_made
    # Row 9 has no label, and the other new cell no row.
    assert sorted((r["row_id"], r["label"], r["features"].numNonzeros()) for r in got["rows"]) == [(1, 5.0, 3), (2, 3.0, 3), (3, 4.0, 3)]


def test_cells_of_a_big_dictionary_are_stored(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    raw = spark.range(600).selectExpr("id", "IF(id % 7 = 3, NULL, concat('u', id % 97)) AS u", "'x' AS i",
                                      "IF(id % 5 = 0, NULL, id / 600) AS n", "id % 3 + 0.5D AS y")
    sets = spark.range(900).selectExpr("id % 300 AS id", "concat('t', id % 11) AS t", "1.0D AS w")
    made = {"users": ["u"], "items": ["i"], "ctx_num": ["n"], "ctx_set": {"s": (sets, "id", "t", "w")}, "target": "y"}
    one = en.build_cells(raw, "id", **made)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cells, dictionary = en.build_cells(raw, "id", **made)
        assert not own_exchanges(cells)
        assert sorted(map(tuple, cells.collect())) == sorted(map(tuple, one[0].collect()))
        assert sorted(map(tuple, dictionary.collect())) == sorted(map(tuple, one[1].collect()))
        dim = cells.agg({"col": "max"}).first()[0]
        shifted = pr.predict(cells, pr.init_model(spark, dim, 2, 0.1, 0.3, 4)).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plain = pr.predict(one[0], pr.init_model(spark, dim, 2, 0.1, 0.3, 4)).collect()
    assert len(shifted) == 600 and dict(shifted) == pytest.approx(dict(plain), abs=1e-12)


def test_without_any_broadcast_by_size(spark, cells, model, monkeypatch):
    """Weights too big to broadcast: each is sent once to the parts that use it."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    real = joins.heavy_keys

    def from_two(facts, on, floor=1):
        return real(facts, on, floor if on == ["row_id"] else 1)

    monkeypatch.setattr(joins, "heavy_keys", from_two)
    monkeypatch.setattr(gr, "heavy_keys", from_two)
    try:
        assert predictions(pr.predict(cells, model)) == pytest.approx([0.155, 0.5525, 0.325], abs=1e-12)
        assert_weights(tr.train_gd(cells, PARAMS, model), *BATCH)
        assert_weights(tr.train_psgd(cells, PARAMS, model), *EPOCH)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("null_id", [False, True])
def test_psgd_weights_beyond_a_broadcast_are_merged_without_a_hash_table(spark, model, null_id, monkeypatch):
    """Cells stay where they are and as they are sorted; a column's weights come with its first cell of a part."""
    lines = [line for r in range(12) for line in tiny_lines() if line[0] == 1 + r % 3 for line in [(r, *line[1:])]]
    lines += [(None, 0, "user", 1.0), (None, 3, "item", 0.5), (None, 5, "label", 2.0)] if null_id else []
    cells = spark.createDataFrame(lines, schema.CELLS)
    params = dataclasses.replace(PARAMS, num_partitions=3, num_iter=2)
    want = tr.train_psgd(cells, params, model)
    plans, weighted, run = [], [], type(cells).mapInPandas

    def seen(df, *args, **kw):
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].split("InMemoryRelation")[0])
        weighted.append(df.groupBy("part", "col").agg(F.count("v").alias("n")).filter("n <> 1").count())
        return run(df, *args, **kw)

    monkeypatch.setattr(type(cells), "mapInPandas", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = tr.train_psgd(cells, params, model)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    (v, m) = weights(want)
    assert_weights(got, want.c, v, *m)
    assert weighted == [0, 0] and len(plans) == 2
    for plan in plans:
        assert "ShuffledHashJoin" not in plan and "SortMergeJoin" in plan
        tail = plan[plan.index("SortMergeJoin"):]
        assert null_id or plan[:plan.index("SortMergeJoin")].count("Sort [") == 0 and tail.split("TableCacheQueryStage")[0].split("InMemoryTableScan")[0].count("Sort [") == 0, plan


@pytest.mark.parametrize("batch", [1, 2, 3, 5])
def test_rows_that_span_arrow_batches(spark, cells, model, batch):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        assert_weights(tr.train_psgd(cells, PARAMS, model), *EPOCH)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_a_task_of_psgd_keeps_little_per_column():
    import tracemalloc

    from factorloom.operators.sgd_tasks import sgd_pass

    n, width = 200_000, 4
    cfg = {"k": 2, "dim": n, "lr": 0.01, "reg_c": 0.1, "reg_v": 0.2, "reg_m": 0.2, "k0": True, "k1": True, "rows": n // width}

    def batches():
        for low in range(0, n, 8000):
            rows = np.arange(low // width, (low + 8000) // width)
            cols = np.c_[np.arange(low, low + 8000).reshape(-1, width), np.full(len(rows), n)].ravel()
            yield pd.DataFrame({"part": 0, "row_id": np.repeat(rows, width + 1), "col": cols, "val": 1.0, "v": 0.1,
                                "m0": 0.2, "m1": 0.3})

    tracemalloc.start()
    lines = sum(len(out) for out in sgd_pass(cfg)(batches()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert lines == n + 1
    assert peak < 110 * n, peak / n  # 24 bytes of weights, 4 of its number, the batches and what leaves at a time


def test_weights_of_a_task_of_psgd_lie_in_a_file_beyond_a_size(monkeypatch):
    from factorloom.operators import sgd_tasks

    cfg = {"k": 2, "dim": 500, "lr": 0.05, "reg_c": 0.1, "reg_v": 0.2, "reg_m": 0.2, "k0": True, "k1": True, "rows": 400}
    rng = np.random.default_rng(4)
    cols = np.array([[*np.sort(rng.choice(500, 3, replace=False)), 500] for _ in range(400)])
    rows = pd.DataFrame({"part": 0, "row_id": np.repeat(np.arange(400), 4), "col": cols.ravel(), "val": 0.5, "v": 0.1, "m0": 0.2, "m1": 0.3})

    def learnt(most):
        monkeypatch.setattr(sgd_tasks, "_MAPPED_BYTES", most)
        task = sgd_tasks.PartitionSGD(0, cfg)
        for low in range(0, 1600, 80):
            task.learn(rows.iloc[low:low + 80])
        return task, pd.concat(task.changes())

    (held, want), (mapped, got) = learnt(1 << 30), learnt(1000)
    assert held.file is None and mapped.file is not None and not mapped.scaled.flags.owndata
    pd.testing.assert_frame_equal(got, want)


def test_psgd_on_a_set_prepared_for_other_parts(cells, model):
    data = gr.prepare(cells, 5)
    assert data.width != PARAMS.num_partitions
    assert_weights(tr.train_psgd(data, PARAMS, model), *EPOCH)
    data.release()


@pytest.mark.parametrize("wide,hot", [(2, 1), (2, 4096), (4, 1)])
def test_no_size_changes_what_is_learnt(make_cells, model, monkeypatch, wide, hot):
    from factorloom.plans import joins

    cells = make_cells({}, [(1, 1, "user", 0.0), (1, 3, "item", 0.0)])
    monkeypatch.setattr(gr, "_WIDE_ROW", wide)
    monkeypatch.setattr(joins, "_HOT_KEYS", hot)
    data = gr.prepare(cells, 5)
    assert data.num_rows == 3 and (data.wide is not None or wide == 4)
    assert_weights(tr.train_gd(data, PARAMS, model), *BATCH)
    assert_weights(tr.train_psgd(data, PARAMS, model), *EPOCH)
    data.release()


def test_factors_are_independent_and_free_of_partitions(spark, monkeypatch):
    def draws():
        rows = pr.init_model(spark, 4000, 3, 0.0, 1.0, seed=5).factors.orderBy("col").collect()
        return np.array([r["m"] for r in rows])

    one = draws()
    monkeypatch.setattr(pr, "_ROWS_PER_TASK", 300)
    many = draws()
    assert (one == many).all() and len(np.unique(one)) == one.size
    for a in range(3):
        for b in range(3):
            for lag in (0, 300, 1000, 2000):
                if a != b or lag:
                    x, y = one[:4000 - lag, a], one[lag:, b]
                    assert abs(np.corrcoef(x, y)[0, 1]) < 0.08
    assert abs(one.mean()) < 0.03 and abs(one.std() - 1) < 0.03


def test_rows_without_target_are_left_out(make_cells, model):
    cells = make_cells({}, [(9, 0, "user", 1.0)])
    assert_weights(tr.train_gd(cells, PARAMS, model), *BATCH)
    assert pr.rmse(cells, model).first()["rmse"] == pytest.approx(3.7846138619, abs=1e-9)


def test_duplicates(make_cells, model):
    cells = make_cells({}, [(1, 0, "user", 1.0)])
    with pytest.raises(ValueError, match="Duplicate"):
        tr.train_gd(cells, PARAMS, model)
    assert_weights(tr.train_gd(cells, PARAMS, model, on_duplicate="max"), *BATCH)


def test_a_row_of_many_copies_is_found_before_the_shuffle(spark, cells, model):
    copies = spark.range(5000).selectExpr("2 as row_id", "0 as col", "'user' as cat", "1.0D as val")
    with pytest.raises(ValueError, match="Duplicate"):
        gr.prepare(cells.unionByName(copies.select(*[F.col(c).cast(f.dataType).alias(c) for c, f in
                                                     zip(copies.columns, schema.CELLS)])))


def test_wrong_width_is_an_error(cells):
    with pytest.raises(ValueError, match="num_attribute"):
        gr.prepare(cells, 6)


def test_init_draws_every_factor_on_its_own(spark):
    model = pr.init_model(spark, 200, 3, 1.0, 0.5, seed=4)
    m = np.array([r["m"] for r in model.factors.orderBy("col").collect()])
    assert m.shape == (200, 3) and len(np.unique(m)) == 600
    assert abs(m.mean() - 1.0) < 0.1 and abs(m.std() - 0.5) < 0.1
    again = np.array([r["m"] for r in pr.init_model(spark, 200, 3, 1.0, 0.5, seed=4).factors.orderBy("col").collect()])
    assert (m == again).all()
    assert {tuple(r["m"]) for r in pr.init_model(spark, 5, 2, 0.5, 0.0).factors.collect()} == {(0.5, 0.5)}


def planted(spark, n=1500, users=20, items=15, k=2):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(users + items, k))
    lines = []
    for r in range(n):
        u, i = int(rng.integers(users)), users + int(rng.integers(items))
        lines += [(r, u, "user", 1.0), (r, i, "item", 1.0), (r, users + items, "label", float(1.0 + m[u] @ m[i]))]
    return spark.createDataFrame(lines, schema.CELLS).cache()


@pytest.mark.parametrize("solver, k0, k1", [("adamW", True, True), ("gd", False, True), ("adamW", True, False)])
def test_ml_on_tables_gives_what_spark_ml_gives(spark, solver, k0, k1, monkeypatch):
    """A model beyond a broadcast is not held by the driver; start, steps and result are those of FMRegressor."""
    cells = planted(spark)
    p = FMParams("p", 0.0, 0.3, 2, None, 3, 4, 0.1, k0, k1, 0.0, 0.0, 0.05)
    want = tr.train_ml(cells, p, solver=solver, seed=7)
    monkeypatch.setattr(tr.FMRegressor, "fit", lambda *a: pytest.fail("the driver holds the model"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = tr.train_ml(cells, p, solver=solver, seed=7)
        with pytest.raises(ValueError, match="Labels"):
            tr.train_ml(cells.withColumn("val", F.when(F.col("cat") == "label", float("nan")).otherwise(F.col("val"))), p)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert (got.num_attribute, got.num_factor) == (want.num_attribute, want.num_factor)
    assert got.c == pytest.approx(want.c, abs=1e-7)
    assert all(np.allclose(a, b, atol=1e-7) for a, b in zip(weights(got), weights(want)))


@pytest.mark.parametrize("draws", [8, 1 << 16])
def test_gaussians_of_java_in_blocks(spark, draws, monkeypatch):
    from factorloom.functions import random

    monkeypatch.setattr(random, "_DRAWS", draws)
    java = spark._jvm.java.util.Random(5)
    want = [[java.nextGaussian() for _ in range(3)] for _ in range(50)]
    rows = random.java_gaussians(spark, 50, ["a", "b", "c"], 5).orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(50)) and np.allclose([r[1:] for r in rows], want, atol=1e-13)


def test_trainers_learn_planted_factors(spark):
    cells = planted(spark)
    base = dict(name="p", init_mean=0.0, init_stdev=0.3, num_partitions=2, num_attribute=None, num_factor=2,
                k0=True, k1=True, reg_c=0.0, reg_v=0.0, reg_m=0.0)
    start = pr.init_model(spark, 35, 2, 0.0, 0.3, 1)
    before = pr.rmse(cells, start).first()[0]
    gd = tr.train_gd(cells, FMParams(num_iter=8, learn_rate=0.8, **base), start)
    psgd = tr.train_psgd(cells, FMParams(num_iter=8, learn_rate=0.1, **base), start)
    ml = tr.train_ml(cells, FMParams(num_iter=60, learn_rate=0.1, **base), seed=1)
    errors = [pr.rmse(cells, x).first()[0] for x in (gd, psgd, ml)]
    assert errors[0] < before and errors[1] < 0.7 * before and errors[2] < before
    some = tr.train_gd(cells, FMParams(num_iter=3, learn_rate=0.5, **base), start, seed=2, batch_fraction=0.5)
    same = tr.train_gd(cells, FMParams(num_iter=3, learn_rate=0.5, **base), start, seed=2, batch_fraction=0.5)
    assert pr.rmse(cells, some).first()[0] < before
    assert np.allclose(weights(some)[1], weights(same)[1])


def test_add_delta(spark, model):
    delta = spark.createDataFrame([(1, 0.5, [1.0, -1.0])], schema.FACTORS)
    v, m = weights(gr.add_delta(model, delta, 0.2))
    assert v == pytest.approx([0.1, 0.7, -0.1, 0.3, 0.05])
    assert m[1] == pytest.approx([0.2, -1.1, 0.1, 0.4, -0.2])


def test_params():
    values = PARAMS.to_map()
    assert FMParams.from_map(values) == PARAMS
    values.pop("reg_m")
    values.pop("k0")
    with pytest.raises(ValueError, match="k0, reg_m"):
        FMParams.from_map(values)
    with pytest.raises(ValueError):
        FMParams.from_map({**PARAMS.to_map(), "k0": "maybe"})


def test_vectors_give_the_named_sums(spark, cells, model, monkeypatch):
    """The same predictions and errors with the factors in blocks of one, and no column a factor in the plan."""
    named = {r["row_id"]: r for r in pr.factor_sums(cells, model).collect()}
    for r in pr.factor_vectors(cells, model).collect():
        n = named[r["row_id"]]
        assert [r["linear"], *r["s"], *r["q"]] == pytest.approx([n["linear"], n["s0"], n["s1"], n["q0"], n["q1"]], abs=1e-12)
    lonely = pr.factor_vectors(cells.filter("col = 5"), model).filter("row_id = 1").first()
    assert (list(lonely["s"]), list(lonely["q"]), lonely["linear"]) == ([0.0, 0.0], [0.0, 0.0], 0.0)
    negative = cells.withColumn("val", F.when(F.col("col") == 4, -F.col("val")).otherwise(F.col("val")))
    want = {keep: (pr.predict(negative, model, keep=keep).collect(), pr.rmse(negative, model, keep=keep).first()[0])
            for keep in ("positive", "nonzero")}
    monkeypatch.setattr(pr, "_NAMED_FACTORS", 1)
    for keep, (rows, error) in want.items():
        got = {r["row_id"]: r["prediction"] for r in pr.predict(negative, model, keep=keep).collect()}
        assert got == pytest.approx({r["row_id"]: r["prediction"] for r in rows}, abs=1e-12)
        assert pr.rmse(negative, model, keep=keep).first()[0] == pytest.approx(error, abs=1e-12)
    plan = pr.predict(cells, model)._jdf.queryExecution().executedPlan().toString()
    assert "s0#" in plan and "s1#" not in plan and "m1#" not in plan and "partial_sum" in plan


def test_a_target_that_is_no_number_is_left_out_of_the_error(spark, cells, model):
    bad = cells.withColumn("val", F.when((F.col("row_id") == 2) & (F.col("col") == 5), float("nan")).otherwise(F.col("val")))
    without = pr.rmse(cells.filter("row_id <> 2"), model).first()[0]
    assert pr.rmse(bad, model).first()[0] == pytest.approx(without, abs=1e-12)
