"""Top-k per key, and best matches between two vector tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factorloom.plans.runtime import as_tiled, ship_with_tasks, stage

ship_with_tasks(__name__)

# Spark prunes every map task to k rows per key before the shuffle for ranks up to this value
# (spark.sql.optimizer.windowGroupLimitThreshold, default 1000).
_PRUNED_RANK = 1000
_SALTS = 64
# Vectors of one chunk, and the scores computed at a time, in bytes.
_CHUNK_BYTES = 16 << 20
# Shuffle partitions at most: beyond it a task takes several pairs of chunks, one after the other.
_MAX_WIDTH = 20_000
# A pair of chunks in `pair_scores` gives at most the square of this in pairs, about 64 MB; a task that has several sorts them in memory.
_PAIR_ROWS = 1650
# Its chunks hold ids of one remainder by this number, or by a power of two below it if there are few chunks.
_CLASSES = 16
# Vectors of a chunk in `close_pairs` at most: a task gives its pairs as it finds them.
_MET_ROWS = 1 << 14
_SCORE_BYTES = 32 << 20
_SLAB = 4096
# Items of a leaf and queries of a block at most, and pairs whose distance is taken at a time.
_LEAF, _QUERIES, _PAIRS = 512, 256, 1 << 16
# Pairs to be left out that a task of `best_matches` meets on average at most, about 64 MB.
_SEEN_PAIRS = 4_000_000
# Pairs of one list on average.
_SEEN_LIST = 512


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int | Column, tie: str) -> DataFrame:
    """The first k rows per key with their `rank`. No key is ever sorted whole in one task: small
    k relies on Spark's rank pruning before the shuffle, other k ranks salted slices first."""
    if not (isinstance(k, int) and k <= _PRUNED_RANK):
        sliced = df.withColumn("_slice", F.pmod(F.xxhash64(tie), F.lit(_SALTS)))
        first = Window.partitionBy(*keys, "_slice").orderBy(*order)
        df = (sliced.withColumn("_rank", F.row_number().over(first))
              .filter(F.col("_rank") <= k).drop("_rank", "_slice"))
    final = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(final).cast("bigint")).filter(F.col("rank") <= k)


def _matrix(values: pd.Series) -> np.ndarray:
    return np.stack(values.to_numpy()).astype(float) if len(values) else np.zeros((0, 0))


def _rows(vectors: pa.ChunkedArray) -> np.ndarray:
    """A column of arrays of one length as a matrix, without a Python object per row."""
    lengths = pc.unique(pc.list_value_length(vectors)).to_pylist()
    if len(lengths) != 1 or lengths[0] is None:
        raise ValueError(f"vectors must have one length, not {lengths}")
    return pc.list_flatten(vectors).to_numpy().astype(float).reshape(len(vectors), lengths[0])


#: Pairs of a query and a leaf that were compared, and those there are; read by tests.
VISITED = [0, 0]


def _split(points: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): the lines of `points` in leaves of at most `most` lines, by halving at the median of the widest
    coordinate; `starts` has the end as well."""
    order, starts, stack = np.arange(len(points)), [], [(0, len(points))]
    while stack:
        low, high = stack.pop()
        if high - low <= most:
            starts.append(low)
            continue
        part = points[order[low:high]]
        values = part[:, np.ptp(part, axis=0).argmax()] if part.shape[1] else np.zeros(high - low)
        middle = (high - low) // 2
        order[low:high] = order[low:high][np.argpartition(values, middle)]
        stack += [(low + middle, high), (low, low + middle)]
    return order, np.array([*starts, len(points)])


def _first_of_equals(ids: np.ndarray, vecs: np.ndarray, bias: np.ndarray, most: int) -> np.ndarray:
    """The lines of the `most` smallest ids among items of one vector and bias: as these tie for every query, the others
    are no answers."""
    order = np.lexsort((ids, bias, *vecs.T))
    same = (np.diff(vecs[order], axis=0) == 0).all(axis=1) & (np.diff(bias[order]) == 0)
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    rank = np.arange(len(ids)) - np.repeat(first, np.diff([*first, len(ids)]))
    return order[rank < most]


class _Leaves:
    """The items of a chunk in leaves of near ones, made once a task. A leaf says how much any of its items can score for
    a query: a dot product by its box and by its ball, a distance by its ball."""

    def __init__(self, ids: np.ndarray, vecs: np.ndarray, bias: np.ndarray, how: str, answers: int):
        kept = _first_of_equals(ids, vecs, bias, answers)
        order, self.starts = _split(np.column_stack([vecs, bias])[kept], max(1, min(_LEAF, _SLAB, 32 + int(len(kept) ** 0.5))))
        self.places = kept[order]  # where the items stood
        self.ids, self.vecs, self.bias, self.how = ids[self.places], vecs[self.places], bias[self.places], how
        at = self.starts[:-1]
        self.low, self.high = np.minimum.reduceat(self.vecs, at), np.maximum.reduceat(self.vecs, at)
        self.centres = (self.low + self.high) / 2
        sizes = np.diff(self.starts)
        self.radii = np.maximum.reduceat(np.linalg.norm(self.vecs - np.repeat(self.centres, sizes, axis=0), axis=1), at)
        self.top = np.maximum.reduceat(self.bias, at)
        self.squares = (self.vecs ** 2).sum(1)
        self.reach = np.sqrt(self.squares.max())

    def slip(self, q: np.ndarray) -> np.ndarray:
        """What rounding may cost a bound, per query; distances are taken from an expanded square, which cancels."""
        lengths = np.linalg.norm(q, axis=1)
        if self.how == "dot":
            return 1e-8 * (1 + lengths * self.reach + np.abs(self.bias).max())
        return 1e-6 * (1 + lengths + self.reach) * (1 + q.shape[1]) ** 0.5

    def limits(self, q: np.ndarray, base: np.ndarray, slip: np.ndarray, digits: int) -> np.ndarray:
        """(query, leaf): no item of the leaf scores more."""
        if self.how == "dot":
            box = np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T
            ball = q @ self.centres.T + np.linalg.norm(q, axis=1)[:, None] * self.radii[None, :]
            most = np.minimum(box, ball)
        else:
            square = (q ** 2).sum(1)[:, None] + (self.centres ** 2).sum(1)[None, :] - 2 * q @ self.centres.T
            most = -np.maximum(np.sqrt(np.maximum(square, 0)) - self.radii[None, :], 0)
        return most + self.top[None, :] + (base + slip * (1 + np.abs(base)) + 10.0 ** -digits)[:, None]

    def scores(self, leaf: slice, q: np.ndarray, base: np.ndarray, slip: np.ndarray, last: np.ndarray, digits: int) -> np.ndarray:
        """(query, item of the leaf), rounded; by distance -inf for items that cannot reach the query's last place."""
        if self.how == "dot":
            return np.round(q @ self.vecs[leaf].T + self.bias[leaf] + base[:, None], digits) + 0.0
        square = (q ** 2).sum(1)[:, None] + self.squares[leaf][None, :] - 2 * q @ self.vecs[leaf].T
        rough = -np.sqrt(np.maximum(square, 0)) + self.bias[leaf] + base[:, None]
        line, col = np.nonzero(rough + (slip * (1 + np.abs(base)))[:, None] + 10.0 ** -digits >= last[:, None])
        table = np.full(rough.shape, -np.inf)
        for at in range(0, len(line), _PAIRS):
            x, y = line[at:at + _PAIRS], col[at:at + _PAIRS]
            far = -np.sqrt(((q[x] - self.vecs[leaf][y]) ** 2).sum(axis=1))
            table[x, y] = np.round(far + self.bias[leaf][y] + base[x], digits) + 0.0
        return table


def _best_of_leaves(q, base, take, leaves, digits, gone=None):
    """(query line, item, score) of the best `take` items per query. Every query meets its most promising leaf first,
    so that its last place is known soon; then all leaves that can hold an item for that place. `gone`: (query lines, places in
    the leaves' order), sorted by place, of pairs that are no answers."""
    gone_lines, gone_places = (np.zeros(0, int), np.zeros(0, int)) if gone is None else gone
    slip, starts = leaves.slip(q), leaves.starts
    limit = leaves.limits(q, base, slip, digits)
    most = int(take.max())
    best, last = np.full((len(q), most), -np.inf), np.full(len(q), -np.inf)
    lines, items, scores = [np.zeros(0, int)], [leaves.ids[:0]], [np.zeros(0)]
    VISITED[1] += limit.size

    def visit(b: int, rows: np.ndarray) -> None:
        VISITED[0] += len(rows)
        leaf = slice(starts[b], starts[b + 1])
        table = leaves.scores(leaf, q[rows], base[rows], slip[rows], last[rows], digits)
        first, end = np.searchsorted(gone_places, [starts[b], starts[b + 1]])
        if first < end:
            row_of = np.full(len(q), -1)
            row_of[rows] = np.arange(len(rows))
            met = row_of[gone_lines[first:end]]
            table[met[met >= 0], gone_places[first:end][met >= 0] - starts[b]] = -np.inf
        both = np.concatenate([best[rows], table], axis=1)
        best[rows] = -np.partition(-both, most - 1, axis=1)[:, :most]
        last[rows] = best[rows].min(axis=1)
        line, col = np.nonzero((table >= last[rows][:, None]) & (table > -np.inf))
        lines.append(rows[line])
        items.append(leaves.ids[leaf][col])
        scores.append(table[line, col])
        limit[rows, b] = -np.inf

    hope = limit.argmax(axis=1)
    for b in np.unique(hope):
        visit(b, np.flatnonzero(hope == b))
    todo = np.argsort(-limit.max(axis=0), kind="stable")
    while len(todo):
        for b in todo[:16]:
            rows = np.flatnonzero((limit[:, b] >= last) & (limit[:, b] > -np.inf))
            if len(rows):
                visit(b, rows)
        todo = todo[16:]
        todo = todo[(limit[:, todo] >= last[:, None]).any(axis=0)]
    line, item, score = np.concatenate(lines), np.concatenate(items), np.concatenate(scores)
    reaches = score >= last[line]
    line, item, score = line[reaches], item[reaches], score[reaches]
    order = np.lexsort((item, -score, line))
    line, item, score = line[order], item[order], score[order]
    rank = np.arange(len(line)) - np.searchsorted(line, np.arange(len(q)))[line]
    first = rank < take[line]
    return line[first], item[first], score[first]


def _best_in_chunk(q, base, take, ids, vecs, bias, how, digits, gone=None):
    """(query line, item, score) of the best `take` items per query among all items of a chunk, exactly. Queries are met
    in blocks of near ones. `gone`: (query lines, places of items) of pairs that are no answers."""
    gone_lines, gone_places = (np.zeros(0, int), np.zeros(0, int)) if gone is None else gone
    spared = int(np.bincount(gone_lines).max()) if len(gone_lines) else 0
    leaves = _Leaves(ids, vecs, bias, how, int(take.max()) + spared)
    place = np.full(len(ids), -1)
    place[leaves.places] = np.arange(len(leaves.places))
    gone_places = place[gone_places]
    known = gone_places >= 0
    by_line = np.argsort(gone_lines[known], kind="stable")
    gone_lines, gone_places = gone_lines[known][by_line], gone_places[known][by_line]
    block, starts = _split(q, max(1, min(_QUERIES, _SCORE_BYTES // (8 * max(1, len(leaves.starts))))))
    found = [(np.zeros(0, int), ids[:0], np.zeros(0))]
    for low, high in zip(starts[:-1], starts[1:]):
        some = np.sort(block[low:high])
        mine = None
        if len(gone_lines):
            first, end = np.searchsorted(gone_lines, some), np.searchsorted(gone_lines, some, "right")
            at = np.concatenate([np.arange(x, y) for x, y in zip(first, end)])
            at = at[np.argsort(gone_places[at], kind="stable")]
            mine = np.searchsorted(some, gone_lines[at]), gone_places[at]
        line, item, score = _best_of_leaves(q[some], base[some], take[some], leaves, digits, mine)
        found.append((some[line], item, score))
    line, item, score = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(line, kind="stable")
    return line[order], item[order], score[order]


def _nearest_in_chunk(q, take, ids, vecs, bias, base, digits):
    """The same by distance."""
    return _best_in_chunk(q, base, take, ids, vecs, bias, "distance", digits)


def _chunk_rows(vectors: DataFrame) -> tuple[int, int]:
    """Number of vectors, and how many of them fit into one chunk."""
    sizes = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dims")).first()
    return sizes["n"], max(1, _CHUNK_BYTES // (8 * ((sizes["dims"] or 1) + 3)))


def _blocks(queries: DataFrame, items: DataFrame, seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Cut both sides into chunks of bounded bytes and copy each chunk once per chunk of the other
    side. Chunks are big, so there are few copies. A pair of `seen`(qid, item) goes to the one task that scores it,
    among the items, with its `qid`; queries are cut so fine that a task meets _SEEN_PAIRS of them on average at most."""
    cores = queries.sparkSession.sparkContext.defaultParallelism
    n_items, rows = _chunk_rows(items)
    n_queries = queries.count()
    item_chunks = max(1, -(-n_items // rows))
    # Small inputs are cut finer, to give every core something to do.
    query_chunks = max(1, -(-n_queries // rows), min(-(-n_queries // 64), -(-2 * cores // item_chunks)))
    if seen is not None:
        n_seen = seen.count()
        query_chunks = max(query_chunks, -(-n_seen // (_SEEN_PAIRS * item_chunks)))
    groups = min(_MAX_WIDTH, item_chunks * query_chunks)

    def copies(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    def none(kind: str) -> Column:
        return F.array().cast(kind)

    query_chunk = F.pmod(F.xxhash64("qid"), F.lit(query_chunks))
    item_chunk = F.pmod(F.xxhash64("item"), F.lit(item_chunks))
    left = queries.withColumn("_qc", query_chunk).withColumn("_ic", copies(item_chunks))
    right = items.withColumn("_ic", item_chunk).withColumn("_qc", copies(query_chunks))
    if seen is not None:
        # Pairs come in lists of some hundred, as a row each costs far more than its numbers on the way to Python.
        pairs = (seen.filter("item IS NOT NULL AND qid IS NOT NULL")
                 .select(F.struct("qid", "item").alias("p"), item_chunk.alias("_ic"), query_chunk.alias("_qc"),
                         F.pmod(F.xxhash64("item", "qid"), F.lit(max(1, n_seen // (_SEEN_LIST * groups)))).alias("_list"))
                 .groupBy("_ic", "_qc", "_list").agg(F.collect_list("p").alias("p"))
                 .select("_ic", "_qc", F.col("p.qid").alias("qids"), F.col("p.item").alias("gone"), none("array<double>").alias("vec")))
        # Empty arrays, not nulls: one Arrow batch holds a whole group, and takes a time quadratic in nulls of an array column.
        right = right.withColumn("qids", none("array<bigint>")).withColumn("gone", none("array<bigint>")).unionByName(
            pairs, allowMissingColumns=True)
    # The explicit width keeps small inputs from being merged into one task.
    return left.repartition(groups, "_qc", "_ic"), right.repartition(groups, "_qc", "_ic")


def _gone(qids: np.ndarray, ids: np.ndarray, seen: dict[str, pa.ChunkedArray]) -> tuple[np.ndarray, np.ndarray]:
    """(query lines, places in ids) of the pairs seen(qid, item), sorted by place. Equal qids are all met; pairs of
    unknown queries or items are none."""
    order = np.argsort(ids, kind="stable")
    at = np.minimum(np.searchsorted(ids[order], seen["item"].to_numpy()), len(ids) - 1)
    known = ids[order][at] == seen["item"].to_numpy()
    places, wanted = order[at[known]], seen["qid"].to_numpy()[known]
    by_qid = np.argsort(qids, kind="stable")
    first, last = (np.searchsorted(qids[by_qid], wanted, side) for side in ("left", "right"))
    times = last - first
    steps = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    lines, places = by_qid[np.repeat(first, times) + steps], np.repeat(places, times)
    by_place = np.argsort(places, kind="stable")
    return lines[by_place], places[by_place]


def _slice(n_items: int) -> int:
    """How many queries to score at a time."""
    return max(1, _SCORE_BYTES // max(1, 8 * n_items))


def best_matches(queries: DataFrame, items: DataFrame, k: int, how: str = "dot",
                 digits: int = 9, seen: DataFrame | None = None) -> DataFrame:
    """For every query the k best items by base + bias + <qvec, vec> (how="dot") or by minus the
    Euclidean distance (how="distance"). Exact.

    queries(qid, qvec, base) and items(item, vec, bias). Both sides are cut into chunks of
    bounded size; a task meets one chunk of each, and keeps only the best k per query, so
    pairs are never written out. A task puts its items into leaves once; leaves that cannot hold an item for a query's
    last place are not scored. Pairs of
    `seen`(qid, item) are no answers: the task that would score them leaves them out, so a chunk sends k rows a query
    however many it has seen. Scores are rounded to `digits`, ties go to the smaller item."""
    if seen is not None and how != "dot":
        raise ValueError("Pairs that were seen can be left out for how='dot' only.")

    def kernel(q: pa.Table, i: pa.Table) -> pa.Table:
        known = None
        if "gone" in i.column_names:
            listed = pc.greater(pc.list_value_length(i["gone"]), 0)
            lists, i = i.filter(listed), i.filter(pc.invert(listed))
            known = {"qid": pc.list_flatten(lists["qids"]), "item": pc.list_flatten(lists["gone"])}
        line, item, score = np.zeros(0, int), np.zeros(0, "int64"), np.zeros(0)
        if len(q) and len(i):
            ids, gone = i["item"].to_numpy(), None
            if known is not None and len(known["item"]):
                named = np.flatnonzero(q["qid"].is_valid().to_numpy())
                lines, places = _gone(q["qid"].drop_null().to_numpy(), ids, known)
                gone = named[lines], places
            line, item, score = _best_in_chunk(_rows(q["qvec"]), q["base"].to_numpy(), np.full(len(q), min(k, len(ids))),
                                               ids, _rows(i["vec"]), i["bias"].to_numpy(), how, digits, gone)
        return pa.table({"qid": q["qid"].take(pa.array(line)), "item": pa.array(item, pa.int64(), from_pandas=True),
                         "score": pa.array(score)})

    left, right = _blocks(queries.select("qid", "qvec", "base"), items.select("item", "vec", "bias"), seen)
    return (left.groupBy("_qc", "_ic").cogroup(right.groupBy("_qc", "_ic"))
            .applyInArrow(kernel, "qid bigint, item bigint, score double"))


# Balls of the index: about this many vectors each, and at most this many centres.
_BALL_ROWS, _MAX_BALLS = 1024, 4096


def balls(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(vectors with their `ball`, centres, radii): every vector belongs to the nearest of some centres; a ball's radius
    is the distance of its farthest member. Centres are vectors drawn by hash, at most _MAX_BALLS. They say only which
    pairs of balls can be skipped; by the triangle inequality no pair in reach is lost."""
    n = vectors.count()
    wanted = max(1, min(_MAX_BALLS, n // _BALL_ROWS, int(4 * n ** 0.5)))
    drawn = vectors.select(id_col, vec_col).orderBy(F.xxhash64(id_col), id_col).limit(wanted)
    centres = _matrix(pd.Series([r[vec_col] for r in drawn.collect()]))
    held = vectors.sparkSession.sparkContext.broadcast(centres)
    kinds = {f.name: f.dataType.simpleString() for f in vectors.schema.fields}

    def near(parts):
        for pdf in parts:
            out = []
            for at in range(0, len(pdf), 1024):
                vecs, centres = _matrix(pdf[vec_col].iloc[at:at + 1024]), held.value
                square = (vecs ** 2).sum(1)[:, None] + (centres ** 2).sum(1)[None, :] - 2 * vecs @ centres.T
                ball = square.argmin(1)
                # the distance itself is taken anew, as the expanded square cancels for close vectors
                out.append(np.stack([ball, np.linalg.norm(vecs - centres[ball], axis=1)]))
            found = np.concatenate([np.zeros((2, 0)), *out], axis=1)
            yield pdf.assign(ball=found[0].astype(int), _far=found[1])

    ddl = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + ", ball int, _far double"
    dealt = stage(vectors.mapInPandas(near, ddl), "balls")
    radii = np.zeros(len(centres))
    for r in dealt.groupBy("ball").agg(F.max("_far").alias("far")).collect():  # one number a ball
        radii[r["ball"]] = r["far"]
    return dealt.drop("_far"), centres, radii


def _gaps(centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """The least distance that members of two balls can have."""
    square = (centres ** 2).sum(1)
    between = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * centres @ centres.T, 0))
    slip = 1e-6 * (1 + np.sqrt(square).max(initial=0.0))  # what rounding may cost
    return np.maximum(between - radii[:, None] - radii[None, :] - slip, 0)


def close_pairs(vectors: DataFrame, threshold: float, digits: int = 9) -> DataFrame:
    """(i, j, score), i < j, of the pairs of unit or zero vectors(item, vec) with a dot product of at least
    `threshold` > 0. Only balls that can hold such a pair meet: vectors of length 1 with that product are at most
    sqrt(2 - 2 threshold) apart. Zero vectors have no such pair."""
    some = stage(vectors, "vectors").filter(F.col("item").isNotNull() & F.exists("vec", lambda x: x != 0))
    dealt, centres, radii = balls(some, "item", "vec")
    reach = float(np.sqrt(max(0.0, 2 - 2 * (threshold - 10.0 ** -digits)))) + 1e-9
    return _pairs_of_balls(dealt, _gaps(centres, radii) <= reach, _split(centres, 1)[0], threshold, digits)


def _ball_chunks(sizes: dict[int, int], order: list[int], rows: int) -> tuple[dict[int, tuple[int, int]], int]:
    """({ball: (its first chunk, its chunks)}, number of chunks): balls next to each other in `order` share a chunk of at most
    `rows` vectors; a bigger ball is dealt to chunks of its own."""
    place, chunk, filled = {}, 0, 0
    for ball in order:
        if ball in sizes:
            if filled and filled + sizes[ball] > rows:
                chunk, filled = chunk + 1, 0
            parts = -(-sizes[ball] // rows)
            place[ball] = chunk, parts
            chunk, filled = (chunk + parts, 0) if parts > 1 else (chunk, filled + sizes[ball])
    return place, chunk + (filled > 0)


def _pairs_of_balls(dealt: DataFrame, meets: np.ndarray, order: np.ndarray, threshold: float, digits: int) -> DataFrame:
    """The pairs of vectors whose balls meet. Balls come in chunks of bounded bytes, near ones together, and a vector is sent
    once to each chunk that has a ball it can reach: at most as often as there are chunks. A task holds one chunk, reads
    the other by batches, and gives its pairs as it finds them."""
    spark, ddl = dealt.sparkSession, "i bigint, j bigint, score double"
    n, rows = _chunk_rows(dealt)
    # Small inputs are cut finer, to give every core something to do.
    rows = min(rows, _MET_ROWS, max(64, -(-n // int((4 * spark.sparkContext.defaultParallelism) ** 0.5))))
    sizes = {r["ball"]: r["count"] for r in dealt.groupBy("ball").count().collect()}  # one number a ball
    place, chunks = _ball_chunks(sizes, order.tolist(), rows)
    if not meets.any():
        return spark.createDataFrame([], ddl)
    inside = np.zeros((len(meets), chunks), np.float32)
    for ball, (first, parts) in place.items():
        inside[ball, first:first + parts] = 1
    near = meets.astype(np.float32) @ inside > 0
    groups = int(np.triu(inside.T @ near > 0).sum())
    plan = spark.createDataFrame([(ball, *at, np.flatnonzero(near[ball]).tolist()) for ball, at in place.items()],
                                 "ball int, _first int, _parts int, _near array<int>")
    own = F.col("_first") + F.pmod(F.xxhash64("item"), F.col("_parts")).cast("int")
    sent = dealt.join(F.broadcast(plan), "ball").select("item", "vec", "ball", own.alias("_own"), F.explode("_near").alias("_with"))
    # Of two chunks the one with the greater number is held.
    sides = sent.select(F.least("_own", "_with").alias("_a"), F.greatest("_own", "_with").alias("_b"),
                        (F.col("_own") >= F.col("_with")).alias("_held"), "ball", "item", "vec")
    bits = spark.sparkContext.broadcast(np.packbits(meets, axis=1))

    def run(batches):
        met = np.unpackbits(bits.value, axis=1).view(bool)

        def pairs(mine: tuple, other: tuple, same: bool):
            (ids, vecs, balls), (all_ids, all_vecs, all_balls) = mine, other
            edges = [0, *(np.flatnonzero(np.diff(balls)) + 1).tolist(), len(balls)]
            for low, high in zip(edges[:-1], edges[1:]):
                reached = met[balls[low]][all_balls]
                their_ids, their_vecs = (all_ids, all_vecs) if reached.all() else (all_ids[reached], all_vecs[reached])
                step = _slice(len(their_ids))
                for start in range(low, high, step):
                    end = min(start + step, high)
                    table = np.round(vecs[start:end] @ their_vecs.T, digits) + 0.0
                    line, col = np.nonzero(table >= threshold)
                    x, y, scores = ids[start:end][line], their_ids[col], table[line, col]
                    once = x < y if same else x != y
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)[once], pa.int64()), pa.array(np.maximum(x, y)[once], pa.int64()),
                                                      pa.array(scores[once])], names=["i", "j", "score"])

        def joined(parts: list[tuple]) -> tuple:
            return tuple(np.concatenate(column) for column in zip(*parts))

        key, parts, held = None, [], None
        for batch in batches:
            a, b, first, balls, ids = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            new = (np.diff(a) != 0) | (np.diff(b) != 0) | (np.diff(first.astype(np.int8)) != 0)
            edges = [0, *(np.flatnonzero(new) + 1).tolist(), len(a)] if len(a) else []
            for low, high in zip(edges[:-1], edges[1:]):
                if key != (a[low], b[low]):
                    if parts and key[0] == key[1]:
                        held = joined(parts)
                        yield from pairs(held, held, True)
                    key, parts, held = (a[low], b[low]), [], None
                stretch = ids[low:high], _rows(pa.chunked_array([batch.column(5).slice(low, high - low)])), balls[low:high]
                if first[low]:
                    parts.append(stretch)
                elif parts or held is not None:
                    held, parts = joined(parts) if held is None else held, []
                    yield from pairs(stretch, held, False)
        if parts and key[0] == key[1]:
            held = joined(parts)
            yield from pairs(held, held, True)

    dealt_pairs = sides.repartition(min(_MAX_WIDTH, max(1, groups)), "_a", "_b").sortWithinPartitions("_a", "_b", F.desc("_held"), "ball")
    return dealt_pairs.mapInArrow(run, ddl)


def pair_scores(vectors: DataFrame, threshold: float | None = None, digits: int = 9) -> DataFrame:
    """Dot products of all pairs i < j of vectors(item, vec); with a threshold only those at or
    above it. Every two chunks meet once, in one task; ids of a chunk have one remainder, and pairs of one vector come in a
    row, by the other's id. The full result has N(N-1)/2 rows by definition, so give a threshold when there are many vectors."""

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        firsts, seconds, scores = [np.zeros(0, "int64")], [np.zeros(0, "int64")], [np.zeros(0)]
        if len(left) and len(right):
            same = left["_a"][0] == left["_b"][0]
            left, right = left.sort_by("item"), right.sort_by("other")
            ids, vecs = right["other"].to_numpy(), _rows(right["other_vec"])
            step = _slice(len(ids))
            for start in range(0, len(left), step):
                part = left.slice(start, step)
                mine = part["item"].to_numpy()
                table = np.round(_rows(part["vec"]) @ vecs.T, digits) + 0.0
                keep = mine[:, None] < ids[None, :] if same else np.ones(table.shape, bool)
                if threshold is not None:
                    keep &= table >= threshold
                at_mine, at_ids = np.nonzero(keep)
                firsts.append(np.minimum(mine[at_mine], ids[at_ids]))
                seconds.append(np.maximum(mine[at_mine], ids[at_ids]))
                scores.append(table[at_mine, at_ids])
        return pa.table({"i": np.concatenate(firsts), "j": np.concatenate(seconds), "score": np.concatenate(scores)})

    remainder = F.coalesce(F.pmod(F.col("item"), F.lit(_CLASSES)), F.lit(0)).cast("int")
    found = vectors.groupBy(remainder.alias("r")).agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dims")).collect()
    n = sum(r["n"] for r in found)
    rows = min(_PAIR_ROWS, max(1, _CHUNK_BYTES // (8 * (max((r["dims"] or 1 for r in found), default=1) + 3))))
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    # Small inputs are cut finer, to give every core something to do.
    wanted = max(1, -(-n // rows), min(-(-n // 64), int((4 * cores) ** 0.5)))
    classes = min(_CLASSES, 1 << wanted.bit_length() - 1)
    sizes = [sum(r["n"] for r in found if r["r"] % classes == c) for c in range(classes)]
    # A class that is too big is dealt to several chunks.
    parts = [max(1, -(-size // rows)) for size in sizes]
    firsts = np.cumsum([0, *parts[:-1]]).tolist()
    chunks = sum(parts)
    groups = min(_MAX_WIDTH, chunks * (chunks + 1) // 2)

    def of_class(numbers: list[int]) -> Column:
        return F.array(*[F.lit(x).cast("bigint") for x in numbers])[(remainder % classes)]

    chunk = of_class(firsts) + F.pmod(F.xxhash64("item"), of_class(parts))
    first, last = F.lit(0).cast("bigint"), F.lit(chunks - 1).cast("bigint")
    left = vectors.select("item", "vec", chunk.alias("_a")).withColumn("_b", F.explode(F.sequence("_a", last)))
    # The second side gets names of its own, so that no column stands for both sides.
    right = (vectors.select(F.col("item").alias("other"), F.col("vec").alias("other_vec"), chunk.alias("_b"))
             .withColumn("_a", F.explode(F.sequence(first, "_b"))))
    return as_tiled(left.repartition(groups, "_a", "_b").groupBy("_a", "_b")
                    .cogroup(right.repartition(groups, "_a", "_b").groupBy("_a", "_b"))
                    .applyInArrow(kernel, "i bigint, j bigint, score double"))
