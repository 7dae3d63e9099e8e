"""Event types by weighted markers, and the quorum of several classifiers."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_
from re import _parser as regex

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .. import vocabulary as v


def marker_hits(docs: DataFrame, column: str, markers: list[tuple] = v.MARKERS) -> DataFrame:
    """(doc_id, event_type, ordinal, weight, definitional) of the markers that a
    text holds; the vocabulary is folded into one expression, not joined."""
    whens = [
        F.when(
            _holds(F.col("_n"), p),
            F.struct(
                F.lit(t).alias("event_type"),
                F.lit(i).alias("ordinal"),
                F.lit(w).cast("decimal(4,2)").alias("weight"),
                F.lit(d).alias("definitional"),
            ),
        ) for i, (t, p, w, d) in enumerate(markers)
    ]
    rows = docs.select("doc_id", text.normalize(F.col(column)).alias("_n"))
    return rows.select("doc_id", F.explode(F.array_compact(F.array(*whens))).alias("h")).select("doc_id", "h.*")


def marker_scores(docs: DataFrame, column: str, markers: list[tuple] = v.MARKERS) -> DataFrame:
    """Summed weights by event type; a marker counts once however often it occurs."""
    return (
        marker_hits(docs, column, markers)
        .groupBy("doc_id", "event_type")
        .agg(F.sum("weight").cast("decimal(8,2)").alias("score"), F.min("ordinal").alias("ordinal"))
    )


def _found(normal: Column, markers: list[tuple]) -> Column:
    """Places of the markers that a text in normal form holds.  Both are in
    small letters, so that case need not be folded again."""
    return F.array_compact(F.array(*[F.when(_holds(normal, p), F.lit(i)) for i, (_, p, _, _) in enumerate(markers)]))


def _holds(normal: Column, marker: str) -> Column:
    """Whether a text in normal form holds a marker; its pattern is tried only
    where one of the words stands that it cannot match without."""
    found, words = normal.rlike(_pattern(marker)), _words(_parsed(marker))
    return reduce(or_, [normal.contains(w) for w in words]) & found if words else found


def _parsed(marker: str) -> list:
    try:
        return list(regex.parse(text.spaced_pattern(marker).removeprefix("(?i)"))) if marker == marker.lower() else []
    except re.error:
        return []


def _words(parsed: list) -> list[str]:
    """Strings one of which is in every text that a parsed pattern matches; none, if that is not known."""
    run, best = "", []
    for kind, x in [*parsed, (None, None)]:
        if kind is regex.LITERAL and not chr(x).isspace():
            run += chr(x)
            continue
        if kind is regex.AT:
            continue
        choices = [[run]] if run else []
        if kind is regex.BRANCH:
            sides = [_words(list(side)) for side in x[1]]
            choices.append([w for side in sides for w in side] if all(sides) else [])
        elif kind is regex.SUBPATTERN:
            choices.append(_words(list(x[3])))
        elif kind in (regex.MAX_REPEAT, regex.MIN_REPEAT) and x[0] > 0:
            choices.append(_words(list(x[2])))
        best, run = max([best, *choices], key=lambda words: min(map(len, words), default=0)), ""
    return best


def _pattern(marker: str) -> str:
    pattern = text.spaced_pattern(marker)
    return pattern.removeprefix("(?i)") if marker == marker.lower() else pattern


def _also(found: Column, normal: Column, markers: list[tuple]) -> Column:
    """Of markers found in a text those that a part of it holds: others need not be tried."""
    patterns = F.array(*[F.lit(_pattern(p)) for _, p, _, _ in markers])
    return F.filter(found, lambda i: F.regexp_like(normal, F.element_at(patterns, i + 1)))


def _ranked(found: Column, markers: list[tuple]) -> Column:
    """array(struct(event_type, score)) of markers by place, best first, ties in the vocabulary's order."""
    types = list(dict.fromkeys(t for t, *_ in markers))
    zero = F.lit(0).cast("decimal(8,2)")
    weights = F.array(*[F.lit(w).cast("decimal(8,2)") for _, _, w, _ in markers])
    add = lambda total, i: (total + F.element_at(weights, i + 1)).cast("decimal(8,2)")

    def one(k: int, name: str) -> Column:
        own = [i for i, (t, *_) in enumerate(markers) if t == name]
        score = F.aggregate(F.filter(found, lambda i: i.isin(*own)), zero, add)
        return F.struct((-score).alias("down"), F.lit(k).alias("ordinal"), F.lit(name).alias("event_type"))

    best = F.array_sort(F.filter(F.array(*[one(k, name) for k, name in enumerate(types)]), lambda x: x["down"] < 0))
    return F.transform(best, lambda x: F.struct(x["event_type"].alias("event_type"), (-x["down"]).cast("decimal(8,2)").alias("score")))


def ranked(normal: Column, markers: list[tuple] = v.MARKERS) -> Column:
    """array(struct(event_type, score)) of a text in normal form, best first; types
    without a marker are left out."""
    return text.let(_found(normal, markers), lambda found: _ranked(found, markers))


def priors(docs: DataFrame, column: str, markers: list[tuple] = v.MARKERS, most: int = 12) -> DataFrame:
    """(doc_id, ranked, hits, whole_prior, title_prior, body_prior, conflict) of each
    text: rows stay where they are, a text is folded once, and
    a part is asked for the markers of the whole only.  hits are defining markers."""
    folded = F.col("_folded")
    rows = docs.select("doc_id", F.col(column).alias("_text"), text.fold_accents(F.col(column)).alias("_folded"))
    rows = rows.select("doc_id", "_folded", text.title_lines(F.col("_text"), folded).alias("_n"))
    parts = {"_whole": folded, "_title": text.first_lines(folded, F.col("_n")), "_body": text.further_lines(folded, F.col("_n"))}
    rows = rows.select("doc_id", *[text.collapse(c).alias(n) for n, c in parts.items()])
    rows = rows.select("doc_id", "_title", "_body", _found(F.col("_whole"), markers).alias("whole"))
    rows = rows.select("doc_id", "whole", *[_also(F.col("whole"), F.col(f"_{n}"), markers).alias(n) for n in ("title", "body")])
    defining = [i for i, (*_, defines) in enumerate(markers) if defines]
    names = F.array(*[F.lit(p) for _, p, _, _ in markers])
    hits = F.slice(F.transform(F.filter("whole", lambda i: i.isin(*defining)), lambda i: F.element_at(names, i + 1)), 1, most)
    rows = rows.select("doc_id", hits.alias("hits"), *[_ranked(F.col(n), markers).alias(n) for n in ("whole", "title", "body")])
    top = {n: F.get(F.col(n), F.lit(0))["event_type"] for n in ("whole", "title", "body")}
    conflict = F.coalesce(top["title"] != top["body"], F.lit(False))
    return rows.select(
        "doc_id",
        F.col("whole").alias("ranked"),
        "hits",
        *[c.alias(f"{n}_prior") for n, c in top.items()],
        conflict.alias("conflict"),
    )


def prior(docs: DataFrame, column: str, markers: list[tuple] = v.MARKERS) -> DataFrame:
    """The best type of the whole text, its title and its body, and whether the
    last two differ.  Ties go to the type that comes first in the vocabulary."""
    return priors(docs, column, markers).select("doc_id", "whole_prior", "title_prior", "body_prior", "conflict")


def consensus(votes: DataFrame, priors: DataFrame) -> DataFrame:
    """The type most usable votes name; ties go to the prior if it is among
    them, else to the first modality.  No usable vote gives `outro`."""
    usable = votes.where("available and event_type is not null")
    counts = usable.groupBy("doc_id", "event_type").agg(F.count("*").alias("n"), F.min("modality_ord").alias("modality_ord"))
    counts = counts.join(priors.select("doc_id", "prior"), "doc_id", "left")
    best = Window.partitionBy("doc_id").orderBy(
        F.col("n").desc(),
        F.coalesce(F.col("event_type") == F.col("prior"), F.lit(False)).desc(),
        "modality_ord",
    )
    won = (
        counts.withColumn("_n", F.row_number().over(best))
        .withColumn("types", F.count("*").over(Window.partitionBy("doc_id")))
        .where("_n = 1")
    )
    out = (
        votes.groupBy("doc_id")
        .agg(F.sum(F.expr("bigint(available)")).alias("n_available"))
        .join(won.select("doc_id", "event_type", "types"), "doc_id", "left")
        .join(priors.select("doc_id", "prior"), "doc_id", "left")
    )
    unanimous = F.coalesce(F.col("types") == 1, F.lit(False))
    agrees = unanimous | F.col("prior").isNull() | F.coalesce(F.col("prior") == F.col("event_type"), F.lit(False))
    return out.select(
        "doc_id",
        F.coalesce("event_type", F.lit("outro")).alias("event_type"),
        unanimous.alias("unanimous"),
        agrees.alias("agrees_with_prior"),
        "n_available",
    )
