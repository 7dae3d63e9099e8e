"""Passages of a benchmark inside documents, up to a few edited words.

Texts are sequences of words (lower-cased, without punctuation).  The CGK
random walk (Chakraborty, Goldenberg, Koucky 2016) writes a sequence x as
another one of fixed length: step j writes x[i] and moves i on by a random bit
of (j, x[i]).  Two sequences at edit distance k so become two at a Hamming
distance that k bounds.  Bit sampling then hashes the window at every word of
a document, as long as the item it is held against: each repetition draws a
walk and some steps, and a window is a candidate for the items that wrote the
same words at those steps.  The number of repetitions follows from the recall
that is asked for, by the collision rate of edited copies of the items, for
each band of item lengths by itself.  The items of a band that Settings.most
repetitions do not bring there are searched without walks: each stretch that
has enough of an item's word pairs is a candidate, which misses none.
Candidates are confirmed by the exact edit distance of the item to the best
stretch of the text around the window.

An exact short cut keeps this cheap and loses no match: an edit breaks two
pairs of neighbouring words at most, so a window with fewer of the benchmark's
word pairs than that leaves is never walked, and a candidate with fewer of its
item's pairs is never aligned.

Cases: null and empty items match nothing, like null and empty texts; items of
fewer than five words, which allow no edit, are matched word for word, and one
of a single word wherever it stands (the stage asks for Settings.min_words, as
such words occur by chance); repeated rows give repeated results, repeated
items one result for each item id; of equal matches in a text the first counts;
rows without an id are searched and reported without one, and leave the stage if
they leak; other columns, whatever their names, are ignored by the query and
kept by the stage.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared, _words

BAND, DRAWN = 1.5, 400  #: items whose lengths differ by less than this factor share a recall, measured on so many copies
BLOCK_ITEMS, BLOCK_CHARS = 20_000, 32 << 20  #: items that are sent to the executors at once; more are searched block by block


@dataclass(frozen=True)
class Settings:
    max_edits: float = 0.2  #: edited words, as a share of the item's words
    recall: float = 0.99
    sampled: int = 3  #: steps that a repetition compares
    most: int = 48  #: repetitions at most; a band of lengths that needs more is searched by its word pairs
    seed: int = 5
    min_words: int = 1  #: items of fewer words are left out


#: A passage of fewer words says little about where a document comes from.
STAGE_MIN_WORDS = 4


def _hasher() -> _words.Hasher:
    breaks = _words.non_letters()
    breaks[48:58] = False
    return _words.Hasher(breaks, lower_ascii=True, chunk=1 << 21)


def _sequences(texts):
    for first, counts, starts, ends, stretch in _hasher().chunks([t.lower() if isinstance(t, str) else "" for t in texts]):
        yield first, counts, stretch(starts, ends)


def _plan(lengths: np.ndarray, s: Settings) -> list[dict]:
    """The repetitions: a random walk each, and sampled steps as shares of an item's own walk."""
    rng = np.random.default_rng(s.seed)
    deepest = int(lengths.max()) * 2
    return [
        {"salts": [int(x) | 1 for x in rng.integers(1, 1 << 62, deepest)], "shares": np.sort(rng.random(s.sampled))} for _ in range(s.most)
    ]


def _keys(words, starts, ends, lengths, rep) -> np.ndarray:
    """One hash of the words that the walk from each start writes at its sampled
    steps, in a window of the given length (0 is written beyond its end).  A
    walk has 1.6 steps a word, so that it seldom comes to its window's end."""
    steps = (rep["shares"][None, :] * 1.6 * lengths[:, None]).astype(int)
    at, ends, key = starts.copy(), np.minimum(ends, starts + lengths), lengths.astype(np.uint64)
    deepest = int(steps.max(initial=-1)) + 1
    due = [np.argsort(steps[:, k], kind="stable") for k in range(steps.shape[1])]
    cuts = [np.searchsorted(steps[o, k], np.arange(deepest + 1)) for k, o in enumerate(due)]
    for j in range(deepest):
        word = np.where(at < ends, words[np.minimum(at, len(words) - 1)], np.uint64(0))
        for o, c in zip(due, cuts):
            if c[j] < c[j + 1]:
                rows = o[c[j] : c[j + 1]]
                key[rows] = _words.mix(key[rows] * np.uint64(0xD6E8FEB86659FD93) + word[rows])
        at += (((word ^ (word >> np.uint64(29))) * np.uint64(rep["salts"][j])) >> np.uint64(63)).astype(np.int64)
    return key


def _edited(words: np.ndarray, edits: int, rng) -> np.ndarray:
    x = words.tolist()
    for _ in range(edits):
        k, i = rng.integers(0, 3), int(rng.integers(0, len(x)))
        if k == 0:
            x[i] = int(rng.integers(1, 1 << 62))
        elif k == 1 and len(x) > 1:
            x.pop(i)
        else:
            x.insert(i, int(rng.integers(1, 1 << 62)))
    return np.array(x, np.uint64)


def index(items: list[tuple[int, str]], s: Settings = Settings()) -> dict | None:
    """The benchmark's side: sequences, vocabulary and the keys of each repetition."""
    ids, seqs = [], []
    for first, counts, words in _sequences([t for _, t in items]):
        at = np.concatenate([[0], np.cumsum(counts)])
        for i in range(len(counts)):
            if counts[i] >= max(s.min_words, 1):
                ids.append(items[first + i][0])
                seqs.append(words[at[i] : at[i + 1]])
    if not seqs:
        return None
    lengths = np.array([len(x) for x in seqs])
    words, ends = np.concatenate(seqs), np.cumsum(lengths)
    starts = ends - lengths
    reps, rng = _plan(lengths, s), np.random.default_rng(s.seed + 1)
    bands = np.floor(np.log(lengths) / np.log(BAND)).astype(int)
    drawn = np.concatenate([rng.choice(np.flatnonzero(bands == b), DRAWN) for b in np.unique(bands)])
    foreign = lambda n: rng.integers(1, 1 << 62, n).astype(np.uint64)
    slack = (s.max_edits * lengths[drawn]).astype(int)
    copies = [np.concatenate([foreign(1), _edited(seqs[i], k, rng), foreign(k + lengths[i])]) for i, k in zip(drawn, slack)]
    c_words, c_ends = np.concatenate(copies), np.cumsum([len(x) for x in copies])
    c_starts = c_ends - np.array([len(x) for x in copies]) + 1
    missed, kept, open_ = np.ones(len(drawn), bool), [], np.unique(bands)
    for rep in reps:
        items = np.flatnonzero(np.isin(bands, open_))
        rep["lengths"] = np.unique(lengths[items])
        keys = np.zeros(len(seqs), np.uint64)
        keys[items] = _keys(words, starts[items], ends[items], lengths[items], rep)
        order = np.argsort(keys[items], kind="stable")
        rep["order"], rep["keys"] = items[order], keys[items][order]
        kept.append(rep)
        tried = np.flatnonzero(missed & np.isin(bands[drawn], open_))
        met = np.zeros(len(tried), bool)
        for shift in (-1, 0, 1):  # every word of a document starts a window
            met |= _keys(c_words, c_starts[tried] + shift, c_ends[tried], lengths[drawn[tried]], rep) == keys[drawn[tried]]
        missed[tried[met]] = False
        open_ = np.array([b for b in open_ if missed[bands[drawn] == b].mean() > 1 - s.recall], int)
        if not len(open_):
            break
    direct = np.flatnonzero(np.isin(bands, open_))
    expected = {int(b): 1.0 if b in open_ else float(1 - missed[bands[drawn] == b].mean()) for b in np.unique(bands)}
    if min(expected.values()) < s.recall:
        raise ValueError(f"a recall of {min(expected.values()):.3f} was planned where {s.recall} is asked for")
    single = np.flatnonzero(lengths == 1)
    order = np.argsort(words[starts[single]], kind="stable")
    singles = {"words": words[starts[single]][order], "items": single[order]}
    return {
        "singles": singles,
        "ids": ids,
        "seqs": seqs,
        "lengths": lengths,
        **_pair_table(seqs, lengths),
        "direct": _direct_table(seqs, lengths, direct),
        "reps": kept,
        "expected": min(expected.values()),
        "max_edits": s.max_edits,
    }


def _pairs(words: np.ndarray) -> np.ndarray:
    return _words.mix(words[:-1] * np.uint64(0xD6E8FEB86659FD93) + words[1:])


def _pair_table(seqs: list[np.ndarray], lengths: np.ndarray) -> dict:
    """Each pair of neighbouring words with the lengths of the items that have it."""
    pairs = np.concatenate([np.zeros(0, np.uint64), *[_pairs(x) for x in seqs if len(x) > 1]])
    rows = np.unique(np.stack([pairs, np.repeat(lengths, lengths - 1).astype(np.uint64)], 1), axis=0)
    pairs, first = np.unique(rows[:, 0], return_index=True)
    return {"pairs": pairs, "pair_first": np.append(first, len(rows)), "pair_lengths": rows[:, 1].astype(int)}


def _direct_table(seqs: list[np.ndarray], lengths: np.ndarray, items: np.ndarray) -> dict | None:
    """The word pairs of the items that are searched without walks, each with the items that have it."""
    if not len(items):
        return None
    rows = np.unique(
        np.stack([np.concatenate([_pairs(seqs[i]) for i in items]), np.repeat(items, lengths[items] - 1).astype(np.uint64)], 1),
        axis=0,
    )
    pairs, first = np.unique(rows[:, 0], return_index=True)
    return {"pairs": pairs, "first": np.append(first, len(rows)), "items": rows[:, 1].astype(int), "lengths": np.unique(lengths[items])}


def _direct(words: np.ndarray, limits: np.ndarray, idx: dict, begin: np.ndarray, size: np.ndarray):
    """(start, end, item) of all stretches with pairs enough for an item that is searched without walks."""
    table, share = idx["direct"], idx["max_edits"]
    wanted = np.isin(size, table["lengths"]) if table else np.zeros(len(begin), bool)
    if not wanted.any():
        return
    begin, size = begin[wanted], size[wanted]
    cover = np.zeros(len(words) + 1, int)
    np.add.at(cover, begin, 1)
    np.add.at(cover, np.minimum(begin + size + (share * size).astype(int), len(words)), -1)
    at = np.flatnonzero(np.cumsum(cover)[:-2] > 0)
    own = _pairs(words)[at]
    k = np.minimum(np.searchsorted(table["pairs"], own), len(table["pairs"]) - 1)
    text = np.searchsorted(limits, at, "right") - 1
    good = (table["pairs"][k] == own) & (at + 1 < limits[text + 1])
    at, k, text = at[good], k[good], text[good]
    for t in np.unique(text):
        here = text == t
        places, which = at[here], k[here]
        times = table["first"][which + 1] - table["first"][which]
        flat = np.repeat(table["first"][which], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        item, place = table["items"][flat], np.repeat(places, times)
        order = np.lexsort((place, item))
        item, place = item[order], place[order]
        for rows in np.split(np.arange(len(item)), np.flatnonzero(np.diff(item)) + 1):
            one = int(item[rows[0]])
            n, spots = int(idx["lengths"][one]), place[rows]
            slack = int(share * n)
            need = max(n - 1 - 2 * slack, 1)
            hit = np.flatnonzero(spots[need - 1 :] + 2 - spots[: len(spots) - need + 1] <= n + slack) if len(spots) >= need else []
            last = None
            for h in hit:  # stretches that meet are aligned at once
                a, b = max(int(limits[t]), int(spots[h + need - 1]) + 2 - n - slack), min(int(limits[t + 1]), int(spots[h]) + n + slack)
                if last and a <= last[1]:
                    last = (last[0], max(last[1], b))
                else:
                    if last:
                        yield *last, one
                    last = (a, b)
            if last:
                yield *last, one


def _live(words: np.ndarray, limits: np.ndarray, idx: dict) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of the windows with pairs enough for an item of that length."""
    pairs, share = idx["pairs"], idx["max_edits"]
    if not len(pairs) or len(words) < 2:
        return np.zeros(0, int), np.zeros(0, int)
    table = np.zeros(1 << 18, bool)
    table[pairs >> np.uint64(46)] = True
    own = _pairs(words)
    at = np.flatnonzero(table[own >> np.uint64(46)])
    k = np.minimum(np.searchsorted(pairs, own[at]), len(pairs) - 1)
    at, k = at[pairs[k] == own[at]], k[pairs[k] == own[at]]
    text = np.searchsorted(limits, at, "right") - 1
    whole = at + 1 < limits[text + 1]  # not from one text to the next
    at, k, text = at[whole], k[whole], text[whole]
    times = idx["pair_first"][k + 1] - idx["pair_first"][k]
    flat = np.repeat(idx["pair_first"][k], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    of, at, text = idx["pair_lengths"][flat], np.repeat(at, times), np.repeat(text, times)
    order = np.lexsort((at, of))
    of, at, text = of[order], at[order], text[order]
    slack = (share * of).astype(int)
    last = np.arange(len(of)) + of - 1 - 2 * slack - 1  # the pair that makes the number full
    ok = last < len(of)
    here, last = np.flatnonzero(ok), last[ok]
    ok = (of[last] == of[here]) & (text[last] == text[here]) & (at[last] + 2 - at[here] <= of[here] + slack[here])
    here, last = here[ok], last[ok]
    low = np.maximum(at[last] + 2 - of[here] - slack[here], limits[text[here]])
    times = at[here] - low + 1
    begin = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    both = np.unique(begin * (1 << 20) + np.repeat(of[here], times))
    return both >> 20, both & ((1 << 20) - 1)


def candidates(words: np.ndarray, limits: np.ndarray, idx: dict) -> np.ndarray:
    """Distinct (start, item) rows; limits holds where each text begins, and the end."""
    return _candidates(limits, words, idx, *_live(words, limits, idx))


def _candidates(limits: np.ndarray, words: np.ndarray, idx: dict, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    ends = limits[np.searchsorted(limits, begin, "right")] if len(begin) else begin
    found = [np.zeros((0, 2), int)]
    for rep in idx["reps"]:
        mine = np.isin(size, rep["lengths"])
        at = begin[mine]
        keys = _keys(words, at, ends[mine], size[mine], rep) if len(at) else np.zeros(0, np.uint64)
        low, high = np.searchsorted(rep["keys"], keys, "left"), np.searchsorted(rep["keys"], keys, "right")
        times = high - low
        place = np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        found.append(np.stack([np.repeat(at, times), rep["order"][place]], 1))
    return np.unique(np.concatenate(found), axis=0)


def fit_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """The least edit distance of item to any stretch of text, and the first
    such stretch's start and end."""
    n, m = len(item), len(text)
    cost, begin = np.zeros(m + 1, int), np.arange(m + 1)
    for i in range(n):
        diagonal, up = cost[:-1] + (text != item[i]), cost[1:] + 1
        new, origin = np.empty(m + 1, int), np.empty(m + 1, int)
        new[0], origin[0] = cost[0] + 1, begin[0]
        take = diagonal <= up
        new[1:], origin[1:] = np.where(take, diagonal, up), np.where(take, begin[:-1], begin[1:])
        # an extra word of the text: the least of what stands before, one edit a word
        ahead = np.minimum.accumulate(new - np.arange(m + 1))
        source = np.maximum.accumulate(np.where(new - np.arange(m + 1) == ahead, np.arange(m + 1), 0))
        cost, begin = ahead + np.arange(m + 1), origin[source]
    end = int(np.argmin(cost))
    return int(cost[end]), int(begin[end]), end


def matches(texts, idx: dict):
    """(text, item, start word, words, edits) of the best match of each text and item."""
    for first, counts, words in _sequences(texts):
        if not len(words):
            continue
        limits = np.concatenate([[0], np.cumsum(counts)])
        best: dict[tuple[int, int], tuple] = {}
        seen: dict[tuple[int, int], int] = {}
        single = idx["singles"]
        low, high = (np.searchsorted(single["words"], words, side) for side in ("left", "right"))
        for at in np.flatnonzero(low < high):
            doc = int(np.searchsorted(limits, at, "right")) - 1
            for k in single["items"][low[at] : high[at]].tolist():
                best.setdefault((doc, k), (0, int(at - limits[doc]), 1))
        begin, size = _live(words, limits, idx)
        for a, b, k in _direct(words, limits, idx, begin, size):
            edits, first_word, end = fit_distance(idx["seqs"][k], words[a:b])
            if edits <= int(idx["max_edits"] * len(idx["seqs"][k])):
                doc = int(np.searchsorted(limits, a, "right")) - 1
                got = (edits, int(a + first_word - limits[doc]), end - first_word)
                best[doc, k] = min(best.get((doc, k), got), got)
        for start, k in _candidates(limits, words, idx, begin, size):
            item, doc = idx["seqs"][k], int(np.searchsorted(limits, start, "right")) - 1
            slack = int(idx["max_edits"] * len(item))
            if seen.get((doc, k), -1) >= start:  # beside an exact copy just confirmed
                continue
            a, b = max(limits[doc], start - 2 * slack), min(limits[doc + 1], start + len(item) + 2 * slack)
            if np.isin(_pairs(item), _pairs(words[a:b])).sum() < len(item) - 1 - 2 * slack:
                continue
            edits, begin, end = fit_distance(item, words[a:b])
            if edits <= slack:
                if not edits:
                    seen[doc, k] = int(a + begin) + slack
                got = (edits, int(a + begin - limits[doc]), end - begin)
                best[doc, k] = min(best.get((doc, k), got), got)
        for (doc, k), (edits, begin, size) in sorted(best.items()):
            yield first + doc, k, begin, size, edits


def indexes(benchmark: DataFrame, s: Settings):
    """The index of each block of at most BLOCK_ITEMS items and about BLOCK_CHARS characters."""
    n, chars = benchmark.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    parts = max(1, -(-n // BLOCK_ITEMS), -(-chars // BLOCK_CHARS))
    for part in range(parts):
        block = benchmark if parts == 1 else benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        idx = index([(r[0], r[1]) for r in block.select("item_id", "text").orderBy("item_id", "text").collect()], s)
        if idx is not None:
            yield idx


def leaks(docs: DataFrame, benchmark: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, edits, item_words) for each text
    and item that match; one pass over the texts without a shuffle for each
    block of items."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, start_word long, n_words int, edits int, item_words int"
    names = [x.split()[0] for x in schema.split(", ")]
    found = None
    for idx in indexes(benchmark, s):
        held = spark.sparkContext.broadcast(idx)

        def search(frames, held=held):
            for pdf in frames:
                idx, ids = held.value, [None if x is pd.NA else x for x in pdf["doc_id"]]
                rows = [
                    (
                        ids[d],
                        idx["ids"][k],
                        begin,
                        size,
                        edits,
                        len(idx["seqs"][k]),
                    ) for d, k, begin, size, edits in matches(pdf["text"], idx)
                ]
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64", "item_id": "Int64"})

        got = _shared.map_frames(docs.select(F.col("doc_id").cast("long"), "text"), search, schema)
        found = got if found is None else found.unionByName(got)
    return spark.createDataFrame([], schema) if found is None else found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(_shared.table(spark, sf_dir, "documents"), _shared.table(spark, sf_dir, "benchmark"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out the rows whose text holds a benchmark passage; each row is judged by its own text."""
    for idx in indexes(_shared.table(spark, sf_dir, "benchmark"), Settings(min_words=STAGE_MIN_WORDS)):
        held = spark.sparkContext.broadcast(idx)

        def leaking(texts, held=held):
            found = np.zeros(len(texts), bool)
            found[[d for d, *_ in matches(texts, held.value)]] = True
            return (found,)

        docs = _shared.with_columns(docs, "text", leaking, "_leak boolean").where("not _leak").drop("_leak")
    return docs
