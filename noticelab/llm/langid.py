"""Language of a text by a bidirectional gated recurrent network over bytes.

Two gated recurrent layers read a text's bytes, one from each end; a softmax
over both states labels every byte position, and the mean of the positions'
probabilities is the document's.  The network is small (HIDDEN units a side)
and is trained in numpy by backpropagation through time on cuts of SPAN bytes,
every position of which has its document's language as target.

At prediction a whole text is read as spans of SPAN bytes in a batch; the
arrays are laid out with the batch last, so that one step of thousands of
spans is a few vectorized operations.

Cases: a null text or one without a letter is `und` with score 0; without any
labelled row every text is `und`; rows that repeat are predicted each; columns
named lang_pred or score are replaced, others are kept as they are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared

SPAN = 96
BATCH = 4096
UNDETERMINED = "und"


@dataclass(frozen=True)
class Settings:
    hidden: int = 8
    max_rows: int = 6000  #: bound of the sample of labelled rows
    cuts: int = 3  #: spans that each sampled row gives
    steps: int = 700
    batch: int = 192
    rate: float = 0.02
    seed: int = 3


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(np.minimum(x, 60, out=x), out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _tanh(x: np.ndarray) -> np.ndarray:
    x *= 2
    x = _sigmoid(x)
    x *= 2
    x -= 1
    return x


def _start(h: int, classes: int, rng) -> dict[str, np.ndarray]:
    p = {}
    for side in "fb":
        p[f"x{side}"] = rng.normal(0, 0.3, (3 * h, 257))  # input weights and biases of the gates, by byte; 256 is padding
        p[f"u{side}"] = rng.normal(0, 0.5 / np.sqrt(h), (3 * h, h))
    p["o"] = rng.normal(0, 0.3, (classes, 2 * h))
    p["c"] = np.zeros((classes, 1))
    return {k: v.astype(np.float32) for k, v in p.items()}


def _layer(x: np.ndarray, u: np.ndarray, data: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (time x hidden x batch) of one layer over data (time x batch)."""
    h, (steps, n) = u.shape[1], data.shape
    states, last = np.empty((steps, h, n), np.float32), np.zeros((h, n), np.float32)
    for t in range(steps):
        a = np.take(x, data[t], axis=1)
        b = u @ last
        gates = _sigmoid(a[: 2 * h] + b[: 2 * h])
        reset, update = gates[:h], gates[h:]
        new = _tanh(a[2 * h :] + reset * b[2 * h :])
        if keep is not None:
            keep.append((last, reset, update, new, b[2 * h :]))
        last = new + update * (last - new)
        states[t] = last
    return states


def positions(p: dict, data: np.ndarray) -> np.ndarray:
    """Probabilities (time x classes x batch) of every position."""
    both = np.concatenate([_layer(p["xf"], p["uf"], data), _layer(p["xb"], p["ub"], data[::-1])[::-1]], 1)
    z = np.matmul(p["o"], both) + p["c"]
    z -= z.max(1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(1, keepdims=True)
    return z


def _back(x, u, data, keep, grad, gx, gu) -> None:
    """Backpropagation through time of one layer; grad is that of its states."""
    h, carry = u.shape[1], 0.0
    for t in range(len(data) - 1, -1, -1):
        last, reset, update, new, b = keep[t]
        g = grad[t] + carry
        d_new = g * (1 - update) * (1 - new * new)
        d_update = g * (last - new) * update * (1 - update)
        d_reset = d_new * b * reset * (1 - reset)
        da = np.concatenate([d_reset, d_update, d_new])
        db = np.concatenate([d_reset, d_update, d_new * reset])
        gu += db @ last.T
        for k in range(3 * h):
            gx[k] += np.bincount(data[t], da[k], 257)
        carry = g * update + u.T @ db


def train(spans: np.ndarray, labels: np.ndarray, classes: int, s: Settings = Settings()) -> dict[str, np.ndarray]:
    """Fit to spans (rows of SPAN bytes, 256 as padding) by Adam."""
    rng = np.random.default_rng(s.seed)
    p = _start(s.hidden, classes, rng)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(x) for k, x in p.items()}
    h = s.hidden
    for step in range(1, s.steps + 1):
        pick = rng.integers(0, len(spans), s.batch)
        data, want = spans[pick].T.astype(np.int64), labels[pick]
        keep_f, keep_b = [], []
        back = data[::-1]
        both = np.concatenate([_layer(p["xf"], p["uf"], data, keep_f), _layer(p["xb"], p["ub"], back, keep_b)[::-1]], 1)
        z = np.matmul(p["o"], both) + p["c"]
        z -= z.max(1, keepdims=True)
        z = np.exp(z)
        z /= z.sum(1, keepdims=True)
        z[:, want, np.arange(len(want))] -= 1
        z *= (data < 256)[:, None, :] / max(1, (data < 256).sum())
        g = {k: np.zeros_like(x) for k, x in p.items()}
        g["o"] = np.einsum("tcb,thb->ch", z, both)
        g["c"] = z.sum((0, 2))[:, None]
        d = np.matmul(p["o"].T, z)
        _back(p["xf"], p["uf"], data, keep_f, d[:, :h], g["xf"], g["uf"])
        _back(p["xb"], p["ub"], back, keep_b, d[::-1, h:], g["xb"], g["ub"])
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        rate = s.rate * min(1.0, step / 20) * (1 - 0.9 * step / s.steps)
        for k in p:
            x = g[k] * min(1.0, 1.0 / (norm + 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.999 * v[k] + 0.001 * x * x
            p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return p


def _letters(text) -> bool:
    """Whether a text has a letter; superscripts and fractions are none."""
    return isinstance(text, str) and any(m[0].isalpha() for m in re.finditer(r"[^\W\d_]", text))


def predict(texts, model: dict | None) -> tuple[list[str], np.ndarray]:
    """Language and score of each whole text."""
    found, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    of = [i for i, t in enumerate(texts) if _letters(t)]
    if model is None or not of:
        return found, scores
    raw = [texts[i].encode("utf-8", "surrogatepass") for i in of]
    total, names = np.zeros((len(of), len(model["names"]))), model["names"]
    for owner, data in _spans(raw):
        got = positions(model["weights"], data)
        got *= (data < 256)[:, None, :]
        sums = got.sum(0)
        for c in range(len(names)):
            total[:, c] += np.bincount(owner, sums[c], len(of))
    total /= total.sum(1, keepdims=True)
    best = total.argmax(1)
    for k, i in enumerate(of):
        found[i], scores[i] = names[best[k]], total[k, best[k]]
    return found, scores


def _spans(raw: list[bytes]):
    """(owner of each span, bytes: time x batch) for batches of spans of all texts."""
    owners, parts, size = [], [], 0
    for i, data in enumerate(raw):
        for at in range(0, len(data), SPAN * BATCH):
            cut = np.frombuffer(data, np.uint8, min(SPAN * BATCH, len(data) - at), at)
            n = -(-len(cut) // SPAN)
            padded = np.full(n * SPAN, 256, np.int16)
            padded[: len(cut)] = cut
            parts.append(padded.reshape(n, SPAN))
            owners.append(np.full(n, i))
            size += n
            if size >= BATCH:
                yield np.concatenate(owners), np.ascontiguousarray(np.concatenate(parts).T)
                owners, parts, size = [], [], 0
    if size:
        yield np.concatenate(owners), np.ascontiguousarray(np.concatenate(parts).T)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, s: Settings = Settings()) -> dict | None:
    """Train on labelled rows that are not held out, a sample of at most max_rows."""
    learn = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    n = learn.count()
    if not n:
        return None
    share = min(1.0, s.max_rows / n)
    part = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1 << 20)) < int(share * (1 << 20)) if share < 1 else F.lit(True)
    rng = np.random.default_rng(s.seed)
    spans, labels = [], []
    # cuts are made where the rows are: each gives a few spans to the driver
    size = SPAN * 4
    places = F.array(
        *[
            F.floor(
                F.pmod(F.xxhash64("doc_id", F.lit(k)), F.lit(1000)) / 1000 * F.greatest(F.length("text") - SPAN, F.lit(1))
            ) for k in range(s.cuts)
        ]
    )
    drawn = learn.where(part).withColumn("_place", F.xxhash64("doc_id", "text", F.lit(18)))
    cuts = drawn.select(
        "_place",
        "lang",
        F.posexplode(F.transform(places, lambda i: F.substring("text", i.cast("int") + 1, F.lit(size)))).alias("_k", "cut"),
    )
    cuts = cuts.orderBy("_place", "lang", "_k", "cut").limit(s.max_rows * s.cuts).select("lang", "cut")
    for lang, cut in cuts.collect():
        if _letters(cut):
            data = np.frombuffer(cut.encode("utf-8", "surrogatepass")[:SPAN], np.uint8)
            spans.append(np.concatenate([data, np.full(SPAN - len(data), 256)]))
            labels.append(lang)
    if not spans:
        return None
    names = sorted(set(labels))
    order = rng.permutation(len(spans))
    codes = np.array([names.index(x) for x in labels])
    return {"names": names, "weights": train(np.stack(spans)[order], codes[order], len(names), s)}


def apply(docs: DataFrame, model: dict | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with lang_pred and score; rows stay where they are, no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    return _shared.with_columns(docs, text, lambda texts: predict(texts, held.value), "lang_pred string, score double", keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _shared.table(spark, sf_dir, "documents")
    return apply(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), fit(docs), keep=["doc_id", "held_out"])
