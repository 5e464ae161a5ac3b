"""Document quality by random-indexing word vectors and a small calibrated network.

Every word has a random sparse index vector, given by its hash. A word's context vector is the sum of the index
vectors around all its occurrences in the corpus: each task adds them up in a table of fixed size, and Spark sums the
tables. A document is pooled from the vectors of its words; a two-layer network in numpy scores it, and a temperature
fitted on documents it was not trained on makes its scores probabilities.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factorloom.llm.common import cut_at_zeros, split_tokens, training_labels
from factorloom.plans.runtime import ship_with_tasks, stage

#: Word buckets (16-bit ids, 0 stands between documents), dimensions, and entries that are not 0 in an index vector.
BUCKETS, DIMS, ONES = 1 << 15, 32, 4
#: Words on each side that count as context.
WINDOW = 2


def index_vectors(seed: int = 7) -> np.ndarray:
    """BUCKETS x DIMS, -1, 0 and 1; row 0 is 0."""
    rng = np.random.default_rng(seed)
    place = rng.random((BUCKETS, DIMS)).argsort(axis=1)[:, :ONES]
    out = np.zeros((BUCKETS, DIMS), np.int8)
    np.put_along_axis(out, place, rng.choice(np.array([-1, 1], np.int8), (BUCKETS, ONES)), axis=1)
    out[0] = 0
    return out


def _bucket(word: str) -> int:
    return 1 + zlib.crc32(word.encode("utf-8", "surrogatepass")) % (BUCKETS - 1)


class Words:
    """Texts as bucket ids, with a bounded memory of tokens. A token gives one id for each run of letters, digits and
    signs in it, and one more if the letters are capitals."""

    def __init__(self, keep: int = 500_000):
        self.known: dict[str, bytes] = {}
        self.keep = keep

    def _learn(self, tokens: list[str]) -> None:
        capitals, ids = _bucket("\x01capitals"), []
        for part in split_tokens(tokens):
            if part == "\n":
                ids.append(0)
            else:
                ids.append(_bucket(part.lower()))
                if part.isupper() and len(part) > 1:
                    ids.append(capitals)
        self.known.update(zip(tokens, cut_at_zeros(np.array(ids, np.uint16))))

    def ids(self, text: str | None) -> np.ndarray:
        tokens = (text or "").split()
        if len(self.known) > self.keep:
            self.known = {}
        new = list(set(tokens).difference(self.known))
        if new:
            self._learn(new)
        return np.frombuffer(b"".join(map(self.known.__getitem__, tokens)), np.uint16)


def context_sums(docs: DataFrame, text: str = "text") -> DataFrame:
    """(bucket, n, v0, v1, ...): occurrences of each bucket and the sum of the index vectors within WINDOW words of
    them, over all rows. A task keeps one table of BUCKETS x DIMS numbers and sends it once."""
    names = ["n", *(f"v{d}" for d in range(DIMS))]

    def run(batches):
        vectors, words = index_vectors().astype(np.int16), Words()
        table = np.zeros((BUCKETS, DIMS + 1), np.int64)
        gap = np.zeros(WINDOW, np.uint16)
        held: list[np.ndarray] = [gap]

        def add():
            ids = np.concatenate(held)
            near = vectors[ids]
            around = np.zeros_like(near)
            for k in range(1, WINDOW + 1):
                around[k:] += near[:-k]
                around[:-k] += near[k:]
            order = np.argsort(ids, kind="stable")
            found, starts = np.unique(ids[order], return_index=True)
            table[found, 1:] += np.add.reduceat(around[order], starts, axis=0, dtype=np.int64)
            table[found, 0] += np.diff(np.append(starts, len(ids)))
            held[:] = [gap]

        size = 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                ids = words.ids(t)
                held += [ids, gap]
                size += len(ids)
                if size > 1 << 17:
                    add()
                    size = 0
        add()
        used = np.flatnonzero(table[:, 0] > 0)
        used = used[used > 0]
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32))] + [pa.array(c) for c in table[used].T.copy()],
                                         names=["bucket", *names])

    ship_with_tasks(__name__)
    ddl = "bucket int, " + ", ".join(f"{n} bigint" for n in names)
    return docs.select(text).mapInArrow(run, ddl).groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names))


def word_vectors(sums: DataFrame) -> np.ndarray:
    """BUCKETS x 2 DIMS: unit context vectors, centred, and index vectors. At most BUCKETS rows reach the driver."""
    found = np.array(sums.orderBy("bucket").toPandas(), np.float64).reshape(-1, DIMS + 2)
    context = np.zeros((BUCKETS, DIMS), np.float32)
    if len(found):
        at, n = found[:, 0].astype(int), found[:, 1:2]
        mean = found[:, 2:].sum(0) / n.sum()
        rows = found[:, 2:] / n - mean
        context[at] = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    return np.hstack([context, index_vectors().astype(np.float32) / math.sqrt(ONES)])


def pooled(ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """A document's features: its mean vector over all words and over distinct ones, the length, and the share of
    distinct words. Counts per bucket first, so any length takes the same memory."""
    counts = np.bincount(ids, minlength=1).astype(np.float32)
    used = np.flatnonzero(counts)
    if not len(used):
        return np.zeros(2 * vectors.shape[1] + 3, np.float32)
    rows, n = vectors[used], counts[used]
    total = float(n.sum())
    mean, flat = n @ rows / total, rows.mean(0)
    return np.concatenate([mean, flat, [math.log1p(total), len(used) / total, n.max() / total]]).astype(np.float32)


@dataclass(frozen=True)
class QualityModel:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1)
        return hidden @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def train_network(x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 60, rate: float = 3e-3,
                  decay: float = 1e-4, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Two layers by Adam on the logistic loss; the same weights for the same rows."""
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden),
         rng.normal(0, 1 / math.sqrt(hidden), hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 128):
            rows = order[at:at + 128]
            a, t = x[rows], y[rows]
            h = np.tanh(a @ p[0] + p[1])
            error = (_sigmoid(h @ p[2] + p[3][0]) - t) / len(rows)
            back = np.outer(error, p[2]) * (1 - h * h)
            grads = [a.T @ back + decay * p[0], back.sum(0), h.T @ error + decay * p[2], np.array([error.sum()])]
            step += 1
            for k, g in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return p[0], p[1], p[2], float(p[3][0])


def best_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of the smallest logistic loss, on a fixed grid."""
    grid = np.exp(np.linspace(math.log(0.25), math.log(8), 61))
    losses = [np.mean(np.logaddexp(0, logits / t) - y * logits / t) for t in grid]
    return float(grid[int(np.argmin(losses))])


def _features(docs: DataFrame, vectors: np.ndarray, text: str, keep: list[str], finish, ddl: str) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        words = Words()
        for batch in batches:
            x = [pooled(words.ids(t), held.value) for t in batch.column(0).to_pylist()]
            if x:
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], finish(np.array(x))], names=[*keep, "found"])

    ship_with_tasks(__name__)
    return docs.select(text, *keep).mapInArrow(run, ddl)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", id_col: str = "doc_id", label: str = "quality",
        max_documents: int = 20_000) -> QualityModel:
    """Word vectors come from all rows of `docs`. The network is fitted on at most `max_documents` labelled rows that
    are not held out, equal texts once: their pooled vectors (under 600 bytes each) come to the driver. A fifth of
    them is left out to fit the temperature."""
    vectors = word_vectors(context_sums(docs, text))
    sample = training_labels(labels, label, max_documents)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(sample), "doc_id").groupBy("text").agg(F.max("label").alias("label"), F.min("doc_id").alias("at"))
    found = _features(stage(rows, "labelled"), vectors, "text", ["label", "at"], lambda x: pa.array(list(x), pa.list_(pa.float32())),
                      "label int, at bigint, found array<float>").orderBy("at").collect()
    x = np.array([r["found"] for r in found], np.float64)
    y = np.array([float(r["label"] > 0) for r in found])
    if len(set(y.tolist())) < 2:  # nothing to tell apart: every document gets the share of label 1
        width = 2 * vectors.shape[1] + 3
        share = float(y.mean()) if len(y) else 0.5
        odds = math.log((share + 1e-3) / (1 - share + 1e-3))
        return QualityModel(vectors, np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), odds, 1.0)
    mean, scale = x.mean(0), x.std(0) + 1e-3
    left_out = np.arange(len(x)) % 5 == 4
    w1, b1, w2, b2 = train_network((x[~left_out] - mean) / scale, y[~left_out])
    model = QualityModel(vectors, mean, scale, w1, b1, w2, b2, 1.0)
    temperature = best_temperature(model.logits(x[left_out]), y[left_out]) if left_out.any() else 1.0
    return QualityModel(vectors, mean, scale, w1, b1, w2, b2, temperature)


def score(docs: DataFrame, model: QualityModel, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id_col, score) for every row, 0 to 1. Null, empty and wordless texts get the score of a document without
    words; repeated rows equal scores. Other columns are not read."""
    kind = docs.schema[id_col].dataType
    small = QualityModel(np.zeros((0, 0)), model.mean, model.scale, model.w1, model.b1, model.w2, model.b2, model.temperature)
    found = _features(docs, model.vectors, text, [id_col], lambda x: pa.array(small.scores(x), pa.float64()),
                      f"`{id_col}` {kind.simpleString()}, found double")
    return found.withColumnRenamed("found", "score")
