"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic texts (P) and unlabelled texts (U) train small numpy
classifiers with the class-prior-corrected risk

    prior * E_P[l(+f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)])

where the second term, the risk of the negatives, may not fall below zero
(Kiryo et al. 2017): where it would, its gradient is turned round.  A text's
features are the presence of words and word beginnings.  Features enter only
if their posterior by the same correction, prior * P(feature | P) /
P(feature | U), is high and if confirmed texts hold them so much more often
than unlabelled ones that chance does not explain it; so the many ordinary
words of a long text cannot add up to a verdict, nor can rare words that a few
confirmed texts happen to share.

The two samples are the only bound, and they bound labelled rows; every feature
that the confirmed ones hold is looked at, and every text is scored in whole.

Cases: a null or empty text has no features and gets the score of the bias;
repeated rows are scored alike (and ties of labels of one id count as toxic);
without a confirmed toxic text every score is 0; columns named score or
predicted are replaced, others are kept as they are and never looked at.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared, _words

#: Word beginnings, in bytes, beside whole words (0).
BEGINNINGS = (0, 4, 5, 6, 7)
THRESHOLD = 0.7
SAMPLE_PARTS = 24  #: tasks that read a sample


@dataclass(frozen=True)
class Settings:
    max_positives: int = 6000  #: bound of the sample of confirmed toxic texts
    max_unlabelled: int = 16_000  #: bound of the sample of unlabelled texts
    min_support: int = 2  #: positives that must hold a feature
    min_posterior: float = 0.5
    max_chance: float = 1e-3  #: at most, of as many positives holding a feature that has nothing to do with the class
    members: int = 3
    epochs: int = 60
    rate: float = 0.05
    decay: float = 1e-4
    seed: int = 11


def _features(hasher: _words.Hasher, texts):
    """(first text, number of texts, index of the text, feature) per chunk; pairs may repeat."""
    for first, counts, starts, ends, stretch in hasher.chunks(texts):
        owner = np.repeat(np.arange(len(counts)), counts)
        long = ends - starts >= 3
        starts, ends, owner = starts[long], ends[long], owner[long]
        rows, codes = [], []
        for k, n in enumerate(BEGINNINGS):
            full = ends if n == 0 else starts + n
            use = np.ones(len(starts), bool) if n == 0 else full <= ends
            codes.append(stretch(starts[use], full[use]) ^ np.uint64(k * 0x0851F42D4C957F2D))
            rows.append(owner[use])
        yield first, len(counts), np.concatenate(rows), np.concatenate(codes)


def _hasher() -> _words.Hasher:
    return _words.Hasher(_words.non_letters(), lower_ascii=True)


def _lowered(texts) -> list:
    return [t.lower() if isinstance(t, str) else "" for t in texts]


def _distinct(rows: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((rows, codes))
    rows, codes = rows[order], codes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (codes[1:] != codes[:-1])
    return rows[new], codes[new]


def _bags(texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs of all texts, by feature."""
    rows, codes = [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)]
    for first, _, r, c in _features(_hasher(), _lowered(texts)):
        r, c = _distinct(r, c)
        rows.append((r + first).astype(np.int32))
        codes.append(c)
    return _distinct(np.concatenate(rows), np.concatenate(codes))


def train(positive: list[str], unlabelled: list[str], prior: float, s: Settings = Settings()) -> dict:
    """The model from texts at hand: sorted feature codes, one row of weights per member, biases."""
    (pr, pc), (ur, uc) = _bags(positive), _bags(unlabelled)
    codes = np.unique(pc)
    sides = []
    for r, c in ((pr, pc), (ur, uc)):
        k = np.minimum(np.searchsorted(codes, c), max(len(codes) - 1, 0))
        hit = codes[k] == c if len(codes) else np.zeros(len(c), bool)
        sides.append((r[hit], k[hit]))
    held, in_u = (np.bincount(k, minlength=len(codes)) for _, k in sides)
    kept = select(held, len(positive), in_u, len(unlabelled), prior, s)
    place = np.full(len(codes) + 1, -1)
    place[kept] = np.arange(len(kept))
    hits = [(r[place[k] >= 0], place[k][place[k] >= 0]) for r, k in sides]
    return learn(codes[kept], hits[0], len(positive), hits[1], len(unlabelled), prior, s)


def select(held: np.ndarray, n_p: int, in_u: np.ndarray, n_u: int, prior: float, s: Settings = Settings()) -> np.ndarray:
    """Places of the features whose posterior is high, from the numbers of
    confirmed and of unlabelled texts that hold each."""
    if not n_p or not n_u:
        return np.zeros(0, int)
    mean = n_p * np.maximum(in_u, 1) / n_u
    with np.errstate(divide="ignore", invalid="ignore"):
        # a bound of the Poisson distribution's upper tail
        chance = np.where(held > mean, held - mean - held * np.log(held / mean), 0.0)
    keep = (held >= s.min_support) & (prior * held / mean >= s.min_posterior) & (chance <= np.log(s.max_chance))
    return np.flatnonzero(keep)


def learn(codes: np.ndarray, p: tuple, n_p: int, u: tuple, n_u: int, prior: float, s: Settings = Settings()) -> dict:
    """The model from the distinct (row, place in codes) pairs of n_p confirmed and n_u unlabelled texts."""
    if not n_p or not n_u or not len(codes):
        return {
            "codes": np.zeros(0, np.uint64),
            "weights": np.zeros((0, s.members), np.float32),
            "bias": np.full(s.members, -20.0, np.float32),
        }
    prior, sides = min(max(prior, 1e-6), 1 - 1e-6), []
    for (rows, k), n in ((p, n_p), (u, n_u)):
        order = np.argsort(rows, kind="stable")
        sides.append((k[order], np.searchsorted(rows[order], np.arange(n + 1))))
    weights, bias = [], []
    for m in range(s.members):
        w, b = _descend(sides, len(codes), prior, s, np.random.default_rng(s.seed + m))
        weights.append(w)
        bias.append(b)
    w, b = np.stack(weights, 1), np.array(bias)
    zp, zu = (
        np.stack([_sums(side, w[:, j], np.arange(n))[0] + b[j] for j in range(s.members)], 1).mean(1) for side, n in zip(sides, (n_p, n_u))
    )
    scale = 4.0
    b = scale * (b - _cut(zp, zu, prior)) + np.log(THRESHOLD / (1 - THRESHOLD))
    return {"codes": codes, "weights": (scale * w).astype(np.float32), "bias": b.astype(np.float32)}


def _cut(zp: np.ndarray, zu: np.ndarray, prior: float) -> float:
    """The margin with the least risk by the same estimator under the 0-1 loss,
    half-way to the next lower margin that occurs."""
    at = np.unique(np.concatenate([zp, zu]))
    above_p = 1 - np.searchsorted(np.sort(zp), at) / len(zp)
    above_u = 1 - np.searchsorted(np.sort(zu), at) / len(zu)
    risk = prior * (1 - above_p) + np.maximum(0, above_u - prior * above_p)
    best = int(np.argmin(risk))
    return float((at[best] + at[max(best - 1, 0)]) / 2)


def _sums(side, w, rows):
    """The summed weights of each row's features, those features, and their rows' places."""
    feats, limits = side
    n = limits[rows + 1] - limits[rows]
    place = np.repeat(np.arange(len(rows)), n)
    flat = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(limits[rows], n)
    f = feats[flat]
    return np.bincount(place, w[f], len(rows)), f, place


def _descend(sides, size, prior, s, rng):
    """Adam on the non-negative risk with the logistic loss."""
    (p, u) = sides
    np_, nu = len(p[1]) - 1, len(u[1]) - 1
    w, b = np.full(size, 0.1), -2.0
    m, v, t = np.zeros(size + 1), np.zeros(size + 1), 0
    steps = max(1, min(8, nu // 64))
    for _ in range(s.epochs):
        ps, us = np.array_split(rng.permutation(np_), steps), np.array_split(rng.permutation(nu), steps)
        for rp, ru in zip(ps, us):
            if not len(rp):
                rp = rng.integers(0, np_, 8)
            zp, fp, ap = _sums(p, w, rp)
            zu, fu, au = _sums(u, w, ru)
            zp, zu = zp + b, zu + b
            sp, su = 1 / (1 + np.exp(-np.clip(zp, -60, 60))), 1 / (1 + np.exp(-np.clip(zu, -60, 60)))
            loss = lambda z: np.logaddexp(0, z)  # noqa: E731  of calling z negative
            negative = loss(zu).mean() - prior * loss(zp).mean()
            gp, gu = -prior * sp / len(rp), su / len(ru)  # of the negatives' risk
            if negative < 0:
                dp, du = -gp, -gu
            else:
                dp, du = prior * (sp - 1) / len(rp) + gp, gu
            g = np.bincount(fp, dp[ap], size) + np.bincount(fu, du[au], size) + s.decay * w
            g = np.append(g, dp.sum() + du.sum())
            t += 1
            m = 0.9 * m + 0.1 * g
            v = 0.999 * v + 0.001 * g * g
            step = s.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = np.maximum(w - step[:-1], 0), b - step[-1]
    return w, b


def score(texts, model: dict) -> np.ndarray:
    """The probability at the members' mean margin, from 0 to 1, over whole texts."""
    texts = _lowered(texts)
    codes, out = model["codes"], np.zeros((len(texts), len(model["bias"])))
    if len(codes):
        seen = np.zeros(1 << 16, bool)
        seen[codes >> np.uint64(48)] = True
        for first, _, rows, found in _features(_hasher(), texts):
            may = seen[found >> np.uint64(48)]
            rows, found = rows[may], found[may]
            k = np.minimum(np.searchsorted(codes, found), len(codes) - 1)
            hit = codes[k] == found
            pairs = np.unique(np.stack([rows[hit], k[hit]]), axis=1)
            for j in range(out.shape[1]):
                out[:, j] += np.bincount(pairs[0] + first, model["weights"][pairs[1], j], len(texts))
    return 1 / (1 + np.exp(-np.clip((out + model["bias"]).mean(1), -60, 60)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> dict:
    """Train on rows that are not held out.  The samples are bounded by
    max_positives and max_unlabelled; the class prior is the toxic share of all
    labelled rows that are not held out."""
    known = labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = known.agg(F.count("*"), F.sum(F.expr("int(toxic = 1)"))).first()
    nothing = (np.zeros(0, int), np.zeros(0, int))
    if not n_toxic:
        return learn(np.zeros(0, np.uint64), nothing, 0, nothing, 0, 0.5, s)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    # the first ids by a hash: at most max_positives, so they may be broadcast
    toxic = known.where("toxic = 1").select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(s.max_positives)
    positive = texts.join(F.broadcast(toxic), "doc_id", "left_semi").select("text")
    n_texts = texts.count()
    drawn = texts.select("text")
    if n_texts > s.max_unlabelled:  # rows that repeat are drawn each for themselves
        place = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(2)), F.lit(1 << 30))
        drawn = drawn.where(place < int(s.max_unlabelled / n_texts * (1 << 30)))
    positive, drawn = (_shared.written(x.repartition(SAMPLE_PARTS), "sample") for x in (positive, drawn))
    n_p, n_u = positive.count(), drawn.count()
    counts = _shared.map_frames(positive, _counted, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    counts = counts.where(F.col("n") >= s.min_support).toArrow()
    codes, of_p = counts.column("code").to_numpy().view(np.uint64), counts.column("n").to_numpy()
    order = np.argsort(codes)
    codes, of_p = codes[order], of_p[order]
    seen = (
        _shared.map_frames(drawn, _places(docs.sparkSession, codes, True), "place int, n long")
        .groupBy("place")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    of_u = np.zeros(len(codes), np.int64)
    of_u[seen.column("place").to_numpy()] = seen.column("n").to_numpy()
    codes = codes[select(of_p, n_p, of_u, n_u, n_toxic / n, s)]
    find = _places(docs.sparkSession, codes, False)

    def gathered(rows: DataFrame) -> tuple:
        got = [np.frombuffer(r[0], "<i4") for r in _shared.map_frames(rows, find, "places binary").collect()]
        return np.repeat(np.arange(len(got)), [len(x) for x in got]), np.concatenate([*got, np.zeros(0, "<i4")]).astype(int)

    model = learn(codes, gathered(positive), n_p, gathered(drawn), n_u, n_toxic / n, s)
    for sample in (positive, drawn):
        _shared.remove(sample)
    return model


def _places(spark: SparkSession, codes: np.ndarray, count: bool):
    """A function that finds the places of texts' features in sorted codes: for
    each text, or counted over a task."""
    held = spark.sparkContext.broadcast(codes)

    def found(frames):
        codes = held.value
        total = np.zeros(len(codes), np.int64)
        for pdf in frames:
            for a in range(0, len(pdf), 256):
                texts = pdf["text"].iloc[a : a + 256].tolist()
                rows, got = _bags(texts)
                k = np.minimum(np.searchsorted(codes, got), max(len(codes) - 1, 0))
                hit = codes[k] == got if len(codes) else np.zeros(len(got), bool)
                rows, k = rows[hit], k[hit]
                if count:
                    total += np.bincount(k, minlength=len(codes))
                else:
                    order = np.argsort(rows, kind="stable")
                    parts = np.split(k[order].astype("<i4"), np.searchsorted(rows[order], np.arange(1, len(texts))))
                    yield pd.DataFrame({"places": [x.tobytes() for x in parts]})
        if count:
            some = np.flatnonzero(total)
            yield pd.DataFrame({"place": some.astype(np.int32), "n": total[some]})

    return found


def _counted(frames):
    """How many of a task's texts hold each feature."""
    held, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for pdf in frames:
        for a in range(0, len(pdf), 256):
            found, times = np.unique(_bags(pdf["text"].iloc[a : a + 256].tolist())[1], return_counts=True)
            both = np.concatenate([held, found])
            held, at = np.unique(both, return_inverse=True)
            n = np.bincount(at, np.concatenate([n, times])).astype(np.int64)
    yield pd.DataFrame({"code": held.view(np.int64), "n": n})


def apply(docs: DataFrame, model: dict, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with score and predicted; rows stay where they are, no shuffle."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def scored(texts):
        got = score(texts, held.value)
        return got, (got >= THRESHOLD).astype(np.int32)

    return _shared.with_columns(docs, text, scored, "score double, predicted int", keep)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _shared.table(spark, sf_dir, "documents")
    model = fit(docs, _shared.table(spark, sf_dir, "labels"))
    return apply(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model, keep=["doc_id", "held_out"])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the documents that are predicted toxic."""
    held = spark.sparkContext.broadcast(fit(docs, _shared.table(spark, sf_dir, "labels")))
    rejected = lambda texts: (score(texts, held.value) >= THRESHOLD,)
    return _shared.with_columns(docs, "text", rejected, "_toxic boolean").where("not _toxic").drop("_toxic")
