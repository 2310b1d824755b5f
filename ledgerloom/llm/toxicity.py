"""Toxic spans by a linear-chain conditional random field.

Tokens are labelled from labelled documents: in a toxic document, a token is toxic when
its word or one of its prefixes occurs almost only in toxic documents. A two-state chain
over hashed word and prefix features is fitted to these tags on a bounded sample. Its
forward-backward marginals tag the tokens of every whole text; their largest value and
their sum give the document's score, by a logistic curve fitted on the same sample.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, in_small_batches, known_labels, rows_of, whole_text, with_text

#: The fit takes at most so many toxic and clean documents, those with the smallest hash of their id, and so many bytes of text.
TOXIC_ROWS, CLEAN_ROWS, TRAIN_BYTES = 1_000, 3_000, 16 << 20
EPOCHS, FEATURES, PART = 30, 1 << 17, 1 << 18
PREFIXES, LEAST_DOCS, PURE = (4, 5, 6, 7, 8), 3, 0.8
CUT = 0.5
TOKEN = re.compile(r"\w+")


def parts(word: str) -> list[str]:
    """A word's features: itself, and the beginnings that it continues."""
    return ["=" + word, *[word[:n] for n in PREFIXES if len(word) > n]]


def places(word: str) -> list[int]:
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) % FEATURES for x in parts(word)]


class Chains:
    """Token sequences of any lengths, one after the other, worked on in blocks at once.

    A message is a pair of weights (clean, toxic) up to a factor, and each token is a
    matrix of two by two that hands it on; the first token of a sequence forgets what was
    before. So all sequences are one chain of matrices: it is cut into about as many
    blocks as a block has steps, the blocks' products are taken side by side, handed on
    from block to block, and the messages inside the blocks follow side by side.
    """

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths
        total = int(lengths.sum())
        self.starts = np.zeros(total, bool)
        self.starts[(np.cumsum(lengths) - lengths)[lengths > 0]] = True

    def _along(self, m: np.ndarray) -> np.ndarray:
        """Weights (2, n) after each matrix of ``m`` (2, 2, n), from equal weights on."""
        n = m.shape[2]
        steps = max(1, int(np.sqrt(n)))
        blocks = -(-n // steps)
        padded = np.zeros((2, 2, blocks * steps))
        padded[0, 0], padded[1, 1] = 1, 1
        padded[:, :, :n] = m
        (a, b), (c, d) = np.ascontiguousarray(padded.reshape(2, 2, blocks, steps).transpose(0, 1, 3, 2))

        one, none = np.ones(blocks), np.zeros(blocks)
        x, y, u, v = one, none, none, one  # the blocks' products, column by column
        for k in range(steps):
            x, y, u, v = a[k] * x + b[k] * y, c[k] * x + d[k] * y, a[k] * u + b[k] * v, c[k] * u + d[k] * v
            if k % 4 == 3:  # weights grow by less than exp(61) a step
                scale = 1 / (x + y + u + v)
                x, y, u, v = x * scale, y * scale, u * scale, v * scale
        start, now = np.empty((2, blocks)), (0.5, 0.5)
        for i, (p, q, r, t) in enumerate(zip(x.tolist(), y.tolist(), u.tolist(), v.tolist())):
            start[:, i] = now
            on, off = p * now[0] + r * now[1], q * now[0] + t * now[1]
            now = on / (on + off), off / (on + off)
        out = np.empty((2, steps, blocks))
        x, y = start
        for k in range(steps):
            x, y = a[k] * x + b[k] * y, c[k] * x + d[k] * y
            if k % 4 == 3:
                scale = 1 / (x + y)
                x, y = x * scale, y * scale
            out[0, k], out[1, k] = x, y
        return out.transpose(0, 2, 1).reshape(2, -1)[:, :n]

    def messages(self, e: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log ratios (toxic to clean) of the forward and the backward messages, in parts of about PART tokens."""
        ahead, back = np.empty(len(e)), np.empty(len(e))
        begins = np.flatnonzero(self.starts)
        cuts = np.unique(begins[np.minimum(np.searchsorted(begins, np.arange(0, len(e), PART)), len(begins) - 1)]) if len(e) else []
        for start, stop in zip(cuts, [*cuts[1:], len(e)]):
            ahead[start:stop], back[start:stop] = self._messages(e[start:stop], t, self.starts[start:stop])
        return ahead, back

    def _messages(self, e: np.ndarray, t: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, t = np.exp(np.clip(e, -60, 60)), np.exp(t)
        m = np.empty((2, 2, len(e)))
        m[0, 0], m[0, 1] = np.where(starts, 1, t[0, 0]), np.where(starts, 1, t[1, 0])
        m[1, 0], m[1, 1] = np.where(starts, w, w * t[0, 1]), np.where(starts, w, w * t[1, 1])
        ahead = self._along(m)
        # Backwards: the token after hands its weights on by the transposed matrix; behind the last one they are equal.
        back = np.full((2, len(e)), 0.5)
        if len(e) > 1:
            back[:, :-1] = self._along(m.transpose(1, 0, 2)[:, :, :0:-1])[:, ::-1]
        with np.errstate(divide="ignore"):
            return tuple(np.clip(np.log(x[1]) - np.log(x[0]), -500, 500) for x in (ahead, back))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def telling_words(docs: list[np.ndarray], toxic: np.ndarray, words: list[str], share: float) -> np.ndarray:
    """True for each word that has a part (itself or a beginning) found almost only in toxic documents.

    Counts are carried over to the true ``share`` of toxic documents.
    """
    bad, clean = Counter(), Counter()
    for own, y in zip(docs, toxic):
        (bad if y else clean).update({x for w in np.unique(own) for x in parts(words[w])})
    scale = toxic.mean() / (1 - toxic.mean()) * (1 - share) / share  # a clean document of the sample stands for so many
    telling = {x for x, n in bad.items() if n >= LEAST_DOCS and (n + share) / (n + scale * clean[x] + 1) >= PURE}
    return np.array([any(x in telling for x in parts(w)) for w in words], bool)


def fit(texts: list[str], toxic: np.ndarray, share: float | None = None) -> dict:
    """Weights, transitions and the score's curve. Without rows of both labels all scores are their share, or 0.

    ``share`` is the share of toxic documents among all labelled ones (default: in the
    sample); purity of words and the curve are carried over to it.
    """
    if len(set(toxic.tolist())) < 2:
        return {"constant": float(toxic.mean()) if len(toxic) else 0.0}
    ids: dict[str, int] = {}
    share = float(toxic.mean()) if share is None else share
    docs = [np.array([ids.setdefault(w.lower(), len(ids)) for w in TOKEN.findall(t)], np.int32) for t in texts]
    words, token = list(ids), np.concatenate(docs)
    lengths = np.array([len(d) for d in docs])
    y = np.repeat(toxic, lengths) * telling_words(docs, toxic, words, share)[token]
    row = np.repeat(np.arange(len(words)), [len(parts(w)) for w in words])  # features of the distinct words alone
    col = np.fromiter((i for w in words for i in places(w)), np.int64, len(row))
    emissions = lambda p: (p["bias"] + np.bincount(row, p["w"][col], len(words)))[token]
    chains, inner = Chains(lengths), np.ones(len(y), bool)
    inner[np.cumsum(lengths)[lengths > 0] - 1] = False  # tokens with a next one
    now = np.flatnonzero(inner)
    tags = y.astype(int)
    seen = np.bincount(2 * tags[now] + tags[now + 1], minlength=4).reshape(2, 2)
    p = {"w": np.zeros(FEATURES), "bias": np.full(1, -3.0), "t": np.zeros((2, 2))}
    m, v = {k: 0 * x for k, x in p.items()}, {k: 0 * x for k, x in p.items()}
    for step in range(1, EPOCHS + 1):
        e = emissions(p)
        ahead, back = chains.messages(e, p["t"])
        wrong = y - _sigmoid(ahead + back)
        t, pairs = p["t"], np.zeros(4)
        for at in np.array_split(now, len(now) // 200_000 + 1):
            a, b = ahead[at], e[at + 1] + back[at + 1]
            pair = [np.full(len(at), t[0, 0]), t[0, 1] + b, a + t[1, 0], a + t[1, 1] + b]
            norm = np.logaddexp(np.logaddexp(pair[0], pair[1]), np.logaddexp(pair[2], pair[3]))
            pairs += [np.exp(x - norm).sum() for x in pair]
        grad = {
            "w": np.bincount(col, np.bincount(token, wrong, len(words))[row], FEATURES) - 0.1 * p["w"],
            "bias": wrong.sum(keepdims=True),
            "t": seen - pairs.reshape(2, 2) - 0.1 * t,
        }
        for k in p:
            m[k], v[k] = 0.9 * m[k] + 0.1 * grad[k], 0.99 * v[k] + 0.01 * grad[k] ** 2
            p[k] = p[k] + 0.3 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    model = {"w": p["w"], "bias": float(p["bias"][0]), "t": p["t"], "curve": np.array([-2.0, 0.5, 0.0])}
    top, total = document_measures(chains, marginal_logits(chains, emissions(p), p["t"]))
    x = np.stack([np.ones(len(toxic)), top, total], 1)
    curve = model["curve"]
    for _ in range(200):  # Newton steps with a little ridge
        q = _sigmoid(x @ curve)
        h = (x * (q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(3)
        curve = curve + np.linalg.solve(h, x.T @ (toxic - q) - 1e-2 * curve) * 0.5
    curve[0] += np.log(share / (1 - share)) - np.log(toxic.mean() / (1 - toxic.mean()))
    return model | {"curve": curve}


def marginal_logits(chains: Chains, e: np.ndarray, t: np.ndarray) -> np.ndarray:
    ahead, back = chains.messages(e, t)
    return ahead + back


def document_measures(chains: Chains, logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest marginal of each sequence on the logit scale, within 12, and the logarithm of their sum."""
    top, total = np.full(len(chains.lengths), -12.0), np.zeros(len(chains.lengths))
    full = chains.lengths > 0
    if full.any():
        at = (np.cumsum(chains.lengths) - chains.lengths)[full]
        top[full] = np.clip(np.maximum.reduceat(logits, at), -12, 12)
        total[full] = np.log1p(np.add.reduceat(_sigmoid(logits), at))
    return top, total


class _Scores(dict):
    """Word to its emission score, remembered for a while."""

    def __init__(self, model: dict):
        super().__init__()
        self.w, self.bias = model["w"], model["bias"]

    def __missing__(self, word: str) -> float:
        if len(self) > 200_000:
            self.clear()
        self[word] = score = self.bias + float(self.w[places(word)].sum())
        return score


def tag_texts(texts: list[str], model: dict, scores: _Scores | None = None) -> tuple[np.ndarray, list[str]]:
    """Scores of whole texts and the places of their toxic tokens (start:stop, comma-joined), in code points."""
    if "constant" in model:
        return np.full(len(texts), model["constant"]), [""] * len(texts)
    scores = _Scores(model) if scores is None else scores
    rows = [np.fromiter((scores[m[0].lower()] for m in TOKEN.finditer(text)), float) for text in texts]
    chains = Chains(np.array([len(r) for r in rows], dtype=int))
    logits = marginal_logits(chains, np.concatenate(rows) if rows else np.zeros(0), model["t"])
    top, total = document_measures(chains, logits)
    score = _sigmoid(np.stack([np.ones(len(top)), top, total], 1) @ model["curve"])
    spans, start = [], 0
    for text, n, high in zip(texts, chains.lengths, top):
        own, start = logits[start : start + n], start + n
        spans.append(",".join(f"{m.start()}:{m.end()}" for m, x in zip(TOKEN.finditer(text), own) if x > 0) if high > 0 else "")
    return score, spans


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> dict:
    """Fit on at most TOXIC_ROWS and CLEAN_ROWS documents of TRAIN_BYTES together, none of them held out.

    Documents are taken by the hash of their id; one that would exceed the bytes is left
    out. Rows that repeat an id count once, with the smallest text. The class shares of
    all labels that may be learnt from are counted.
    """
    known = checkpointed(known_labels(labels, label))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    sample = known.where("y = 1").orderBy(*order).limit(TOXIC_ROWS).unionByName(known.where("y = 0").orderBy(*order).limit(CLEAN_ROWS))
    rows = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(sample), "doc_id")
    sizes = rows.groupBy("doc_id").agg(F.min(F.octet_length("text")).alias("n"), F.min(F.xxhash64("doc_id")).alias("h")).collect()  # short rows of the sample
    taken, left = [], TRAIN_BYTES
    for row in sorted(sizes, key=lambda r: (r["h"], r["doc_id"])):
        if row["n"] <= left:
            taken.append((row["doc_id"], row["n"]))
            left -= row["n"]
    some = docs.sparkSession.createDataFrame(taken, "doc_id long, n int")
    rows = rows.join(F.broadcast(some), "doc_id").where(F.octet_length("text") == F.col("n")).groupBy("doc_id", "y").agg(F.min("text").alias("text")).collect()
    rows = sorted(map(tuple, rows))
    share = counts[1] / sum(counts.values()) if len(counts) == 2 else None
    return fit([r[2] for r in rows], np.array([r[1] for r in rows], dtype=float), share)


def tag(docs: DataFrame, labels: DataFrame, label: str = "toxic", cut: float = CUT) -> DataFrame:
    """``row`` (the columns of ``docs``), ``score``, ``predicted`` and ``spans`` of each row.

    Null counts as empty; a text without tokens gets the score of no toxic token. Equal
    texts score alike, texts of any length are tagged whole, an empty table gives an
    empty result, and other columns are handed on, not looked at. ``spans`` are offsets
    of code points in the text.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scores = None if "constant" in model.value else _Scores(model.value)
        for batch in batches:
            found, spans = tag_texts(batch["text"].tolist(), model.value, scores)
            yield batch.drop(columns="text").assign(score=found, spans=spans)

    texts = in_small_batches(with_text(docs))
    scored = texts.mapInPandas(score, texts.drop("text").schema.add("score", "double").add("spans", "string"))
    return scored.select(rows_of(docs), "score", (F.col("score") >= cut).cast("int").alias("predicted"), "spans")
