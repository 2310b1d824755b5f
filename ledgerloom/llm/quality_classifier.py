"""Quality classifier: random-indexing word vectors and a small calibrated network.

Every token has a fixed sparse random index vector; a token's *context vector* is the sum of
the index vectors of its neighbours over the whole corpus. Tokens are hashed into a fixed
number of buckets, so the table of context vectors has one size at any corpus size: tasks
add up their own part, parts are added up bucket block by bucket block, and the table
(BUCKETS x DIMENSIONS) is broadcast. A document is pooled from its tokens' vectors, and a
two-layer network, fitted on a bounded sample of labelled rows and calibrated by a
temperature on rows it was not fitted on, gives the probability of label 1.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, known_labels, rows_of, whole_text, width, with_text

BUCKETS, DIMENSIONS, NONZERO, BLOCK = 1 << 14, 64, 4, 256
#: The fit takes at most so many labelled rows, those with the smallest hash of their id.
TRAIN_ROWS, HIDDEN, EPOCHS, HOLD = 8_000, 32, 60, 5
CUT = 0.3
TOKEN = re.compile(r"\w+|[^\w\s]+")


class _Ids(dict):
    """Token to bucket, remembered for a while."""

    def __missing__(self, token: str) -> int:
        if len(self) > 50_000:
            self.clear()
        self[token] = bucket = zlib.crc32(token.encode("utf-8", "surrogatepass")) % BUCKETS
        return bucket


def tokens(text: str, ids: _Ids) -> np.ndarray:
    found = TOKEN.findall(text)
    return np.fromiter(map(ids.__getitem__, found), np.int64, len(found))


def index_vectors(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each bucket's NONZERO entries."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, DIMENSIONS, (BUCKETS, NONZERO)), rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def _contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One task's part of the table, as blocks of whole numbers."""
    places, signs = index_vectors()
    table, ids = np.zeros(BUCKETS * DIMENSIONS), _Ids()
    for batch in batches:
        held, size = [], 0
        for text in [*batch["text"], None]:
            if text is not None:
                held.append(tokens(text, ids))
                size += len(held[-1])
            if held and (text is None or size > 1 << 18):
                row = np.concatenate(held)
                doc = np.repeat(np.arange(len(held)), [len(x) for x in held])
                near = doc[1:] == doc[:-1]
                left, right = row[:-1][near], row[1:][near]
                for a, b in ((left, right), (right, left)):
                    for k in range(NONZERO):
                        table += np.bincount(a * DIMENSIONS + places[b, k], signs[b, k], len(table))
                held, size = [], 0
    blocks = table.reshape(-1, BLOCK * DIMENSIONS)
    used = np.flatnonzero(np.abs(blocks).sum(1))
    yield pd.DataFrame({"block": used.astype("int32"), "part": [blocks[i].astype("<i8").tobytes() for i in used]})


def _added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Parts of the same blocks, added up as they come."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, part in zip(batch["block"], batch["part"]):
            sums[block] = sums.get(block, 0) + np.frombuffer(part, "<i8")
    yield pd.DataFrame({"block": np.array(list(sums), dtype="int32"), "part": [x.tobytes() for x in sums.values()]})


def word_vectors(texts: DataFrame) -> np.ndarray:
    """The context vectors of all buckets at length 1, from every document of ``texts``."""
    schema, n = "block int, part binary", BUCKETS // BLOCK
    parts = in_small_batches(texts).mapInPandas(_contexts, schema)
    if (lanes := width(texts) // n) > 1:  # on a large cluster each block is added up in several lanes first
        lane = F.pmod(F.spark_partition_id(), F.lit(lanes))
        parts = parts.repartition(lanes * n, "block", lane).mapInPandas(_added, schema)
    blocks = parts.repartition(min(width(texts), n), "block").mapInPandas(_added, schema).collect()  # n rows
    table = np.zeros((BUCKETS // BLOCK, BLOCK * DIMENSIONS))
    for row in blocks:
        table[row["block"]] = np.frombuffer(row["part"], "<i8")
    table = table.reshape(BUCKETS, DIMENSIONS)
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype("float32")


def pooled(texts: pd.Series, vectors: np.ndarray, ids: _Ids) -> np.ndarray:
    """Mean and spread of a text's word vectors, its length and its share of distinct tokens."""
    out = np.zeros((len(texts), 2 * DIMENSIONS + 2), dtype="float32")
    for i, text in enumerate(texts):
        row = tokens(text, ids)
        if len(row):
            count = np.bincount(row, minlength=0)
            kinds = np.flatnonzero(count)
            weight = (count[kinds] / len(row)).astype("float32")
            own = vectors[kinds]
            mean = weight @ own
            out[i, :DIMENSIONS] = mean
            out[i, DIMENSIONS:-2] = np.sqrt(np.maximum(weight @ (own * own) - mean * mean, 0))
            out[i, -2:] = np.log1p(len(row)), len(kinds) / len(row)
    return out


def fit(x: np.ndarray, y: np.ndarray, seed: int = 11) -> dict:
    """A tanh layer and a logistic one, by Adam; every HOLD-th row sets the temperature.

    Without rows of both labels the model is the share of label 1, or a half.
    """
    if len(set(y.tolist())) < 2:
        return {"constant": float(y.mean()) if len(y) else 0.5}
    mean, scale = x.mean(0), x.std(0) + 1e-3
    x, y, rng = (x - mean) / scale, y.astype(float), np.random.default_rng(seed)
    held = np.arange(len(y)) % HOLD == 0
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held[:] = False
    tx, ty = x[~held], y[~held]
    p = {"a": rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)), "b": np.zeros(HIDDEN), "c": rng.normal(0, HIDDEN**-0.5, HIDDEN), "d": np.zeros(1)}
    m, v, step = {k: 0 * w for k, w in p.items()}, {k: 0 * w for k, w in p.items()}, 0
    for _ in range(max(EPOCHS, 2000 // max(1, len(ty) // 256))):
        for rows in np.array_split(rng.permutation(len(ty)), max(1, len(ty) // 256)):
            h = np.tanh(tx[rows] @ p["a"] + p["b"])
            e = (1 / (1 + np.exp(-(h @ p["c"] + p["d"]))) - ty[rows]) / len(rows)
            g = np.outer(e, p["c"]) * (1 - h * h)
            grad = {"a": tx[rows].T @ g + 1e-3 * p["a"], "b": g.sum(0), "c": h.T @ e + 1e-3 * p["c"], "d": e.sum(keepdims=True)}
            step += 1
            for k in p:
                m[k], v[k] = 0.9 * m[k] + 0.1 * grad[k], 0.999 * v[k] + 0.001 * grad[k] ** 2
                p[k] = p[k] - 3e-3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model = p | {"mean": mean, "scale": scale, "temperature": 1.0}
    if held.any():
        logits = np.log(1e-12 + (s := predict(model, x[held] * scale + mean))) - np.log(1e-12 + 1 - s)
        loss = lambda t: np.logaddexp(0, np.where(y[held] > 0, -logits, logits) / t).mean()
        model["temperature"] = min(np.geomspace(0.25, 8, 61), key=loss)
    return model


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    if "constant" in model:
        return np.full(len(x), model["constant"])
    h = np.tanh((x - model["mean"]) / model["scale"] @ model["a"] + model["b"])
    return 1 / (1 + np.exp(-np.clip((h @ model["c"] + model["d"]) / model["temperature"], -60, 60)))


def train(docs: DataFrame, labels: DataFrame, vectors, label: str = "quality") -> dict:
    """Fit on at most TRAIN_ROWS labelled documents, none of them held out; rows that repeat an id count once, with the smallest text."""
    sample = known_labels(labels, label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS)
    texts = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(sample), "doc_id")
    texts = texts.groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def pool(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = _Ids()
        for batch in batches:
            x = pooled(batch["text"], vectors.value, ids)
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "x": [row.tobytes() for row in x]})

    rows = sorted(map(tuple, texts.mapInPandas(pool, "doc_id long, y int, x binary").collect()))
    x = np.array([np.frombuffer(r[2], "float32") for r in rows], dtype=float).reshape(len(rows), 2 * DIMENSIONS + 2)
    return fit(x, np.array([r[1] for r in rows], dtype=int))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", cut: float = CUT) -> DataFrame:
    """``docs`` with ``score`` (probability of label 1) and ``predicted`` added.

    Every text is scored whole, however long; null counts as empty, and empty texts get the network's
    score for a text without tokens. Equal texts score alike, an empty table gives an
    empty result. Columns of ``docs`` are handed on in a struct ``row``, so that none
    can clash; only text and, for the labels, ``doc_id`` are looked at.
    """
    context = docs.sparkSession.sparkContext
    vectors = context.broadcast(word_vectors(docs.select(whole_text().alias("text"))))
    model = context.broadcast(train(docs, labels, vectors, label))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids = _Ids()
        for batch in batches:
            yield batch.drop(columns="text").assign(score=predict(model.value, pooled(batch["text"], vectors.value, ids)))

    scored = with_text(docs).mapInPandas(score, with_text(docs).drop("text").schema.add("score", "double"))
    return scored.select(rows_of(docs), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
