import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from factorloom import Model, schema
from factorloom.operators import cells as cx
from factorloom.operators import predict as pr
from factorloom.operators import recommend as rc
from factorloom.operators import similarity as si
from factorloom.plans import topk

COSINES = {(0, 1): 0, (0, 2): 0.7071067812, (0, 3): 0.7592566024, (0, 4): -0.7592566024, (1, 2): 0.7071067812,
           (1, 3): -0.6507913735, (1, 4): 0.6507913735, (2, 3): 0.0766964989, (2, 4): -0.0766964989, (3, 4): -1}


def triples(df):
    return {(r["i"], r["j"]): r["score"] for r in df.collect()}


def test_golden_cosines(model):
    got = triples(si.column_similarities(model.factors))
    assert got == pytest.approx(COSINES, abs=1e-9)
    some = triples(si.column_similarities(model.factors, 0.7))
    assert set(some) == {(0, 2), (0, 3), (1, 2)}


def test_same_as_the_built_in(spark, model):
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import RowMatrix
    m = np.array([r["m"] for r in model.factors.orderBy("col").collect()])
    built_in = RowMatrix(spark.sparkContext.parallelize([Vectors.dense(row) for row in m.T])).columnSimilarities()
    got = triples(si.column_similarities(model.factors))
    for e in built_in.entries.collect():
        assert got[e.i, e.j] == pytest.approx(e.value, abs=1e-9)


def test_symmetric(model):
    got = triples(si.symmetric_similarity(si.column_similarities(model.factors)))
    assert len(got) == 20
    assert all(got[j, i] == s and -1 <= s <= 1 and i != j for (i, j), s in got.items())


def test_golden_similar_columns(model):
    got = [(r["col"], r["rank"], r["other"], round(r["score"], 9))
           for r in si.similar_columns(model.factors, 2, [0, 2]).orderBy("col", "rank").collect()]
    assert got == [(0, 1, 3, 0.759256602), (0, 2, 2, 0.707106781), (2, 1, 0, 0.707106781), (2, 2, 1, 0.707106781)]
    within = model.factors.filter("col < 2").select("col")
    few = si.similar_columns(model.factors, 5, start=2, end=2, within=within).collect()
    assert [(r["other"], r["rank"]) for r in sorted(few, key=lambda r: r["rank"])] == [(0, 1), (1, 2)]


def test_zero_vector_is_similar_to_nothing(spark):
    factors = spark.createDataFrame([(0, 0.0, [0.0, 0.0]), (1, 0.0, [1.0, 0.0])], schema.FACTORS)
    assert triples(si.column_similarities(factors)) == {(0, 1): 0.0}


def test_nested_and_json(model):
    flat = si.similar_columns(model.factors, 2, [0, 2])
    nested = si.similar_nested(flat)
    text = {r["col"]: r["json"] for r in si.similars_json(nested).collect()}
    assert json.loads(text[0])["items"][0]["col"] == 0
    assert [x["col"] for x in json.loads(text[2])["items"][0]["items"]] == [0, 1]
    back = si.parse_similars(si.similars_json(nested))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, flat.collect()))


def test_in_block_with_keys(spark, cells, model):
    dictionary = spark.createDataFrame([(0, "user", "ann", 0), (0, "user", "bob", 1), (1, "item", "x", 2)],
                                       "block int, cat string, key string, col bigint")
    got = si.similar_in_block(model.factors, cx.block_metadata(cells), dictionary, "user", 3).collect()
    assert sorted((r["key"], r["rank"], r["other_key"]) for r in got) == [("ann", 1, "bob"), ("bob", 1, "ann")]
    with pytest.raises(ValueError):
        si.similar_in_block(model.factors, cx.block_metadata(cells), dictionary, "nothing", 3)


def brute(queries, items, k, measure):
    out = []
    for q, vec in enumerate(queries):
        ranked = sorted(range(len(items)), key=lambda i: (-round(measure(vec, items[i]), 9), i))[:k]
        out += [(q, r + 1, i, round(measure(vec, items[i]), 9)) for r, i in enumerate(ranked)]
    return out


@pytest.mark.parametrize("how", ["dot", "distance"])
def test_best_matches_against_brute_force(spark, how, monkeypatch):
    """Chunks small enough that queries and items meet in many tasks; many exact ties."""
    monkeypatch.setattr(topk, "_CHUNK_BYTES", 8 * 6 * 7)
    monkeypatch.setattr(topk, "_SCORE_BYTES", 8 * 20)
    monkeypatch.setattr(topk, "_SLAB", 3)
    rng = np.random.default_rng(5)
    q, items = rng.integers(-2, 3, (23, 3)).astype(float), rng.integers(-2, 3, (41, 3)).astype(float)
    left = spark.createDataFrame([(i, v.tolist(), 0.0) for i, v in enumerate(q)], "qid bigint, qvec array<double>, base double")
    right = spark.createDataFrame([(i, v.tolist(), 0.0) for i, v in enumerate(items)], "item bigint, vec array<double>, bias double")
    found = topk.best_matches(left, right, 4, how)
    best = topk.top_k(found, ["qid"], [F.desc("score"), F.asc("item")], 4, "item")
    got = sorted((r["qid"], r["rank"], r["item"], r["score"]) for r in best.collect())
    measure = (lambda a, b: float(a @ b)) if how == "dot" else (lambda a, b: -float(np.sqrt(((a - b) ** 2).sum())))
    assert got == brute(q, items, 4, measure)


@pytest.mark.parametrize("how", ["dot", "distance"])
def test_early_end_of_a_chunk_changes_nothing(how, monkeypatch):
    monkeypatch.setattr(topk, "_SLAB", 5)
    rng = np.random.default_rng(7)
    for trial in range(40):
        n, nq = int(rng.integers(1, 60)), int(rng.integers(1, 8))
        vecs = rng.integers(-3, 4, (n, 2)) * rng.choice([0.1, 1.0, 10.0], (n, 1))
        bias, ids = rng.integers(-2, 3, n).astype(float), rng.permutation(n)
        q, base = rng.integers(-2, 3, (nq, 2)).astype(float), rng.normal(size=nq)
        take = np.minimum(rng.integers(1, 9, nq), n)
        order = np.argsort(-np.linalg.norm(vecs, axis=1))
        got = list(zip(*topk._best_in_chunk(q, base, take, ids[order], vecs[order], bias[order], how, 9)))
        want = []
        for j in range(nq):
            raw = vecs @ q[j] if how == "dot" else -np.sqrt(((vecs - q[j]) ** 2).sum(axis=1))
            total = np.round(raw + bias + base[j], 9) + 0.0
            want += [(j, ids[x], total[x]) for x in sorted(range(n), key=lambda x: (-total[x], ids[x]))[:take[j]]]
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want])


def test_pairs_over_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(topk, "_CHUNK_BYTES", 8 * 5 * 4)
    rng = np.random.default_rng(6)
    vecs = rng.normal(size=(30, 2))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "item bigint, vec array<double>")
    got = triples(topk.pair_scores(table))
    assert got == pytest.approx({(i, j): round(float(vecs[i] @ vecs[j]), 9) for i in range(30) for j in range(i + 1, 30)}, abs=2e-9)


def test_pairs_of_skewed_ids_come_in_bounded_chunks_and_in_a_row(spark, monkeypatch):
    """Ids of one remainder are dealt to several chunks; pairs of a vector follow each other, in both directions."""
    monkeypatch.setattr(topk, "_PAIR_ROWS", 16)
    ids = [64 * k - 640 for k in range(100)] + [5, 7]
    vecs = np.random.default_rng(3).normal(size=(len(ids), 2))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, vecs)], "item bigint, vec array<double>")
    found = topk.pair_scores(table)
    at = dict(zip(ids, vecs))
    want = {(i, j): round(float(at[i] @ at[j]), 9) for i in ids for j in ids if i < j}
    assert triples(found) == pytest.approx(want, abs=2e-9)
    assert max(r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()) < 40 * 40
    both = si.symmetric_similarity(found)
    assert triples(both) == pytest.approx({**want, **{(j, i): s for (i, j), s in want.items()}}, abs=2e-9)
    lines = both.collect()
    turns = sum(a["i"] != b["i"] and a["j"] != b["j"] for a, b in zip(lines, lines[1:]))
    assert turns < len(lines) / 4


def test_top_k_beyond_the_pruned_rank(spark):
    df = spark.range(5000).selectExpr("id % 2 as g", "id", "cast(id % 7 as double) as s")
    order = [F.desc("s"), F.asc("id")]
    small = topk.top_k(df, ["g"], order, 30, "id")
    large = topk.top_k(df, ["g"], order, 1500, "id")
    assert large.count() == 3000
    assert sorted(map(tuple, large.filter("rank <= 30").collect())) == sorted(map(tuple, small.collect()))
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def full_score(model, cells, spark, row, item):
    extra = spark.createDataFrame([(row, item, "item", 1.0)], schema.CELLS)
    return pr.predict(cells.filter(F.col("row_id") == row).unionByName(extra), model).first()["prediction"]


def test_recommendation_is_the_model_score(spark, cells, model):
    queries = cells.filter("cat not in ('item', 'label')")
    items = cells.filter("cat = 'item'").select("col").distinct()
    got = rc.recommend_items(queries, items, model, 2).collect()
    assert len(got) == 6
    for r in got:
        assert r["score"] == pytest.approx(full_score(model, queries, spark, r["row_id"], r["item"]), abs=1e-9)
    by_row = {row: [r["score"] for r in sorted(got, key=lambda r: r["rank"]) if r["row_id"] == row] for row in (1, 2, 3)}
    assert all(s == sorted(s, reverse=True) for s in by_row.values())


def test_seen_items_are_left_out_without_losing_answers(spark):
    rng = np.random.default_rng(8)
    m = rng.normal(size=(30, 2))
    model = Model(0.1, spark.createDataFrame([(i, 0.0, m[i].tolist()) for i in range(30)], schema.FACTORS), 30, 2)
    queries = spark.createDataFrame([(r, r, "user", 1.0) for r in range(5)], schema.CELLS)
    items = spark.range(5, 30).withColumnRenamed("id", "col")
    # User 0 has seen nearly all.
    pairs = [(0, i) for i in range(5, 28)] + [(1, 5), (1, 6)]
    seen = spark.createDataFrame(pairs, "row_id bigint, col bigint")
    got = {}
    for r in rc.recommend_items(queries, items, model, 4, seen=seen).collect():
        got.setdefault(r["row_id"], []).append((r["rank"], r["item"]))
    for u in range(5):
        free = [i for i in range(5, 30) if (u, i) not in set(pairs)]
        best = sorted(free, key=lambda i: -float(m[u] @ m[i]))[:4]
        assert [i for _, i in sorted(got[u])] == best


def clustered(n, clusters, dims=6, seed=3):
    rng = np.random.default_rng(seed)
    return rng.normal(0, 1, (clusters, dims))[rng.integers(0, clusters, n)] + rng.normal(0, 0.03, (n, dims))


@pytest.mark.parametrize("threshold,rows", [(0.95, 40), (0.3, 40), (1.0, 7)])
def test_threshold_pairs_against_brute_force(spark, monkeypatch, threshold, rows):
    monkeypatch.setattr(topk, "_BALL_ROWS", rows)
    monkeypatch.setattr(topk, "_PAIR_ROWS", 50)
    vecs = clustered(400, 12)
    vecs[5] = vecs[9] = 0  # zero vectors reach no threshold
    vecs[20] = vecs[21]
    factors = spark.createDataFrame([(i, 0.0, v.tolist()) for i, v in enumerate(vecs)], "col long, v double, m array<double>")
    norms = np.linalg.norm(vecs, axis=1)
    units = vecs / np.where(norms > 0, norms, 1)[:, None]
    table = np.round(units @ units.T, 9)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(table >= threshold, 1)))}
    got = {(r["i"], r["j"]) for r in si.column_similarities(factors, threshold).collect()}
    assert got == want and len(want) > 0


@pytest.mark.parametrize("rows,seed", [(64, 4), (1 << 14, 5)])
def test_threshold_pairs_send_a_vector_once_a_chunk(spark, monkeypatch, rows, seed):
    """Many small balls that all meet: a vector is sent as often as there are chunks, not balls; nulls and equal ids pair with
    nothing, and a ball of more rows than a chunk is dealt to several."""
    monkeypatch.setattr(topk, "_BALL_ROWS", 10)
    monkeypatch.setattr(topk, "_MET_ROWS", rows)
    vecs = np.random.default_rng(seed).normal(0, 1, (500, 6))
    vecs[:150] = vecs[0]
    units = vecs / np.linalg.norm(vecs, axis=1)[:, None]
    lines = [(i, v.tolist()) for i, v in enumerate(units)]
    df = spark.createDataFrame([*lines, lines[7], (None, lines[7][1])], "item long, vec array<double>")
    table = np.round(units @ units.T, 9)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(table >= 0.2, 1)))}
    sent, plain = [], type(df).sortWithinPartitions
    monkeypatch.setattr(type(df), "sortWithinPartitions", lambda self, *by: sent.append(self) or plain(self, *by))
    found = topk.close_pairs(df, 0.2)
    got = [(r["i"], r["j"]) for r in found.collect()]
    assert set(got) == want and len(got) == len(want) + sum(7 in p for p in want)  # item 7 is there twice
    assert sent[0].count() <= 501 * max(-(-501 // 64) * 2, 20)
    balls = sent[0].select("ball").distinct().count()
    assert balls > 30 and sent[0].count() < 501 * balls / 2


def test_far_balls_never_meet(spark, monkeypatch):
    monkeypatch.setattr(topk, "_BALL_ROWS", 20)
    vecs = clustered(600, 15)
    units = vecs / np.linalg.norm(vecs, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(units)], "item long, vec array<double>")
    dealt, centres, radii = topk.balls(df, "item", "vec")
    sizes = {r["ball"]: r["count"] for r in dealt.groupBy("ball").count().collect()}
    meets = np.triu(topk._gaps(centres, radii) <= np.sqrt(2 - 2 * 0.99))
    scored = sum(sizes.get(a, 0) * sizes.get(b, 0) / (2 if a == b else 1) for a, b in zip(*np.nonzero(meets)))
    assert sum(sizes.values()) == 600 and scored < 0.35 * 600 * 599 / 2


def test_nearest_by_distance_skips_far_balls():
    vecs, q = clustered(3000, 30), clustered(40, 30, seed=3)
    take, zeros = np.full(len(q), 5), np.zeros
    topk.VISITED[:] = [0, 0]
    line, item, score = topk._nearest_in_chunk(q, take, np.arange(len(vecs)), vecs, zeros(len(vecs)), zeros(len(q)), 9)
    exact = np.round(-np.sqrt(((q[:, None] - vecs[None]) ** 2).sum(2)), 9) + 0.0
    for k in range(len(q)):
        order = np.lexsort((np.arange(len(vecs)), -exact[k]))[:5]
        assert item[line == k].tolist() == order.tolist() and score[line == k].tolist() == exact[k][order].tolist()
    assert topk.VISITED[0] < topk.VISITED[1]


def test_seen_items_are_met_in_the_tasks_that_score_them(spark, monkeypatch):
    """One user has seen 100,000 of 100,003 items, ids beyond 2^53 stay exact, and a chunk sends at most k rows a query."""
    monkeypatch.setattr(topk, "_CHUNK_BYTES", 8 * 5 * 20_000)
    monkeypatch.setattr(topk, "_SEEN_PAIRS", 30_000)
    n, user, other = 100_003, (1 << 60) + 1, (1 << 60) + 2
    items = spark.range(n).select(F.col("id").alias("item"), F.array((F.col("id") % 977).cast("double"), F.lit(1.0)).alias("vec"),
                                  F.lit(0.0).alias("bias"))
    queries = spark.createDataFrame([(user, [1.0, 0.0], 0.5), (other, [1.0, 0.0], 0.5), (7, [-1.0, 0.0], 0.0)],
                                    "qid bigint, qvec array<double>, base double")
    pairs = spark.range(3, n).select(F.lit(user).cast("bigint").alias("qid"), F.col("id").alias("item"))
    odd = spark.createDataFrame([(user, None), (None, 1), (5, 2), (7, 0), (user, -4), (user, 50)], "qid bigint, item bigint")
    found = topk.best_matches(queries, items, 2, seen=pairs.unionByName(odd)).collect()
    chunks = -(-n // (topk._CHUNK_BYTES // (8 * 5)))
    assert len(found) <= 3 * 2 * chunks
    best = {}
    for r in sorted(found, key=lambda r: (-r["score"], r["item"])):
        best.setdefault(r["qid"], []).append((r["item"], r["score"]))
    assert best[user] == [(2, 2.5), (1, 1.5), (0, 0.5)][:len(best[user])] and len(best[user]) >= 2
    assert best[other][:2] == [(976, 976.5), (1953, 976.5)]
    assert best[7][:2] == [(977, 0.0), (1954, 0.0)]
    with pytest.raises(ValueError):
        topk.best_matches(queries, items, 2, "distance", seen=pairs)


def test_query_that_has_seen_everything_has_no_answer(spark, model, cells):
    queries = cells.filter("cat not in ('item', 'label')")
    items = cells.filter("cat = 'item'").select("col").distinct()
    seen = items.select(F.lit(1).cast("bigint").alias("row_id"), "col")
    got = rc.recommend_items(queries, items, model, 2, seen=seen).collect()
    assert {r["row_id"] for r in got} == {2, 3} and len(got) == 4
