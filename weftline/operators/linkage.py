"""Record linkage: comparison features, Fellegi-Sunter scores, decisions and evaluation."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.expr import first_match


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; -1 where a side is null or blank."""
    longest = F.greatest(F.length(a), F.length(b))
    missing = (F.coalesce(F.trim(a), F.lit("")) == "") | (F.coalesce(F.trim(b), F.lit("")) == "")
    return F.when(missing, F.lit(-1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def exact(a: Column, b: Column) -> Column:
    """1.0 where both values are the same, 0.0 where they differ; -1 where a side is null or blank."""
    missing = (F.coalesce(F.trim(a), F.lit("")) == "") | (F.coalesce(F.trim(b), F.lit("")) == "")
    return F.when(missing, F.lit(-1.0)).otherwise((a == b).cast("double"))


def token_cosine(a: Column, b: Column) -> Column:
    """Cosine of the sets of words of two names; -1 where a side is missing."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.trim(c)), r"\s+"), lambda w: w != ""))
    x, y = words(a), words(b)
    cosine = F.size(F.array_intersect(x, y)) / F.sqrt(F.size(x).cast("double") * F.size(y))
    return F.when(a.isNull() | b.isNull() | (F.trim(a) == "") | (F.trim(b) == ""), F.lit(-1.0)).otherwise(cosine)


def level(score: Column, exact: float = 0.95, close: float = 0.80) -> Column:
    """Agreement level: 0 missing (negative, null or NaN), 1 exact, 2 close, 3 otherwise."""
    missing = score.isNull() | F.isnan(score) | (score < 0)
    return first_match([(missing, 0), (score >= exact, 1), (score >= close, 2)], 3).cast("int")


def agreement(a: Column, b: Column) -> Column:
    """level(similarity(a, b)), with edits of values under 20 characters counted only as far as they are close (a fifth of the longer one)."""
    longest = F.greatest(F.length(a), F.length(b))
    missing = (F.coalesce(F.trim(a), F.lit("")) == "") | (F.coalesce(F.trim(b), F.lit("")) == "")
    near = F.call_function("levenshtein", a, b, F.floor(longest / 5).cast("int")) >= 0
    short = F.when(near, F.lit(2)).otherwise(F.lit(3))
    return F.when(missing, F.lit(0)).when(a == b, F.lit(1)).when(longest < 20, short).otherwise(level(similarity(a, b)))


def fit_weights(pairs: DataFrame, features: Sequence[str], label: str, alpha: float = 0.5, levels: int = 4, weight: str | None = None) -> DataFrame:
    """(feature, level, m, u, weight): smoothed log2 ratios of levels among matches and others.

    m = (n_match(level) + alpha) / (n_match + alpha * levels), u alike for non-matches. One row per
    feature and level, seen or not. With weight, a row counts as so many pairs.
    """
    one = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("level")) for f in features]))
    counted = pairs.select(label, one.alias("__n"), cells.alias("c")).groupBy("c.feature", "c.level")
    seen = counted.agg(*[F.sum(F.when(x, F.col("__n")).otherwise(0)).alias(n) for x, n in ((F.col(label) == 1, "nm"), (F.col(label) != 1, "nu"))])
    totals = seen.groupBy("feature").agg(F.sum("nm").alias("tm"), F.sum("nu").alias("tu"))
    grid = totals.select("feature", "tm", "tu", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    full = grid.join(seen, ["feature", "level"], "left")
    m = (F.coalesce("nm", F.lit(0)) + alpha) / (F.col("tm") + alpha * levels)
    u = (F.coalesce("nu", F.lit(0)) + alpha) / (F.col("tu") + alpha * levels)
    return full.select("feature", "level", m.alias("m"), u.alias("u"), F.log2(m / u).alias("weight"))


def score_pairs(pairs: DataFrame, features: Sequence[str], weights: DataFrame, prior: Column | float) -> DataFrame:
    """pairs with match_weight and match_probability = 1 / (1 + 2^-W), W cut to +-50.

    Weights are one row per feature and level: they become one small map, not a join per feature.
    """
    table = _as_map(weights)
    total = prior if isinstance(prior, Column) else F.lit(float(prior))
    for f in features:
        total = total + F.coalesce(F.try_element_at(table, F.concat(F.lit(f"{f}:"), F.col(f).cast("string"))), F.lit(0.0))
    w = F.greatest(F.lit(-50.0), F.least(F.lit(50.0), total))
    return pairs.withColumn("match_weight", total).withColumn("match_probability", 1 / (1 + F.pow(F.lit(2.0), -w)))


def weigh(pairs: DataFrame, features: Sequence[str], weights: DataFrame) -> DataFrame:
    """pairs with w_<feature>, the weight of each feature's level; a level without a weight counts 0."""
    table = _as_map(weights)
    return pairs.select("*", *[F.coalesce(F.try_element_at(table, F.concat(F.lit(f"{f}:"), F.col(f).cast("string"))), F.lit(0.0)).alias(f"w_{f}") for f in features])


def _as_map(weights: DataFrame) -> Column:
    entry = F.struct(F.concat_ws(":", "feature", F.col("level").cast("string")), F.col("weight"))
    return weights.agg(F.map_from_entries(F.collect_list(entry)).alias("m")).select("m").scalar()


def level_shares(pairs: DataFrame, features: Sequence[str], levels: int = 4, alpha: float = 0.5) -> dict[str, list[float]]:
    """Smoothed share of each level of each feature among pairs: at random pairs, the chance of agreeing by accident."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("level")) for f in features]))
    counts = {(r.feature, r.level): r.n for r in pairs.select(cells.alias("c")).groupBy("c.feature", "c.level").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = {f: sum(counts.get((f, i), 0) for i in range(levels)) for f in features}
    return {f: [(counts.get((f, i), 0) + alpha) / (total[f] + alpha * levels) for i in range(levels)] for f in features}


def with_name_match(pairs: DataFrame, left: str, right: str, cutoff: float) -> DataFrame:
    """pairs with name_score and name_good: for each word of the left name the best ratio of matching blocks to a word of the right one.

    The score is their mean, good means that each reaches the cutoff. A name without words scores 0 and isn't good. Ratios of word
    pairs are kept within a batch, as words repeat.
    """
    schema = T.StructType([T.StructField("name_score", T.DoubleType()), T.StructField("name_good", T.BooleanType())])

    @F.pandas_udf(schema)
    def match(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        from difflib import SequenceMatcher

        known: dict[tuple[str, str], float] = {}

        def ratio(x: str, y: str) -> float:
            if (x, y) not in known:
                known[x, y] = 1.0 if x == y else SequenceMatcher(None, x, y).ratio()
            return known[x, y]

        out = []
        for l, r in zip(a, b):
            mine, theirs = (l or "").upper().split(), (r or "").upper().split()
            best = [max(ratio(x, y) for y in theirs) for x in mine] if mine and theirs else []
            out.append((sum(best) / len(best) if best else 0.0, bool(best) and min(best) >= cutoff))
        return pd.DataFrame(out, columns=["name_score", "name_good"])

    return pairs.withColumn("__m", match.asNondeterministic()(F.col(left), F.col(right))).select(*pairs.columns, "__m.name_score", "__m.name_good")


def log_prior(pairs: DataFrame, label: str, weight: str | None = None) -> Column:
    """log2(p / (1 - p)) of the share of matches, as a scalar; with weight, a row counts as so many pairs."""
    match = (F.col(label) == 1).cast("double")
    p = F.avg(match) if weight is None else F.sum(match * F.col(weight)) / F.sum(weight)
    return pairs.select(F.log2(p / (1 - p))).scalar()


def pair_prior(n_true: int, n_records: int) -> float:
    """True pairs over all possible pairs, cut to [1e-6, 0.5]."""
    possible = n_records * (n_records - 1) / 2
    return min(0.5, max(1e-6, n_true / possible)) if possible else 1e-6


def em_weights(
    pairs: DataFrame, features: Sequence[str], u: Mapping[str, Sequence[float]] | None = None, prior: float = 0.1, rounds: int = 50, levels: int = 4, weight: str | None = None
) -> dict:
    """Unsupervised m, u and prior by expectation-maximisation over comparison vectors.

    Pairs are reduced to counts of distinct vectors (at most levels ** features, usually far fewer) and
    only those come to the driver. u may be given, as from random pairs, and then stays fixed. With weight, a row counts as so many pairs.
    Returns {'prior', 'm': {feature: [..]}, 'u': {feature: [..]}, 'rounds'}.
    """
    counted = pairs.groupBy(*features).agg((F.count(F.lit(1)) if weight is None else F.sum(weight)).alias("n"))
    table = counted.toArrow()
    vectors = np.column_stack([table[f].to_numpy() for f in features]).astype(int)
    order = np.lexsort(vectors.T[::-1])  # sums don't depend on the order in which the rows come
    vectors, n = vectors[order], table["n"].to_numpy()[order].astype(float)
    m = {f: np.array([0.25] + [0.6, 0.1] + [0.05] * (levels - 3)) for f in features}
    given = u is not None
    u = {f: np.array((u or {}).get(f, [0.25, 0.05, 0.1] + [0.6] * (levels - 3)), float) for f in features}
    total, done = n.sum() or 1, 0
    for done in range(1, rounds + 1):
        a = math.log(prior) + sum(np.log(m[f])[vectors[:, i]] for i, f in enumerate(features))
        b = math.log(1 - prior) + sum(np.log(u[f])[vectors[:, i]] for i, f in enumerate(features))
        post = 1 / (1 + np.exp(np.minimum(500.0, b - a)))
        matched = (post * n).sum()
        new_prior = min(1 - 1e-9, max(1e-9, matched / total))
        for i, f in enumerate(features):
            inside = lambda p: np.bincount(vectors[:, i], weights=p * n, minlength=levels)  # noqa: B023, E731
            m[f] = (inside(post) + 1e-6) / (matched + levels * 1e-6)
            if not given:
                u[f] = (inside(1 - post) + 1e-6) / (total - matched + levels * 1e-6)
        moved, prior = abs(new_prior - prior), new_prior
        if moved < 1e-9:
            break
    return {"prior": float(prior), "m": {f: x.tolist() for f, x in m.items()}, "u": {f: x.tolist() for f, x in u.items()}, "rounds": done}


def decide(strong: Column, score: Column, evidence: Column, accept: float = 0.98, review: float = 0.8, least_evidence: int = 2, conflict: Column | None = None) -> Column:
    """Tiered decision, first match: conflict, accept with a strong id, accept by score, review where
    evidence is thin or the score middling, reject. Null conditions aren't taken."""
    cases: list[tuple[Column, str]] = [] if conflict is None else [(conflict, "review_conflict")]
    cases += [
        ((strong == 1) & (score >= review), "accept_strong"),
        ((score >= accept) & (evidence >= least_evidence), "accept_score"),
        (score >= accept, "review_thin"),
        (score >= review, "review"),
    ]
    return first_match(cases, "reject")


def date_relation(a: Column, b: Column) -> Column:
    """exact, digit_flip (one digit differs), near (within 6 months of 31 days), n/a or differs,
    for dates as yyyy-MM-dd text; blank is n/a."""
    a, b = (F.nullif(F.trim(c), F.lit("")) for c in (a, b))
    chars = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    off = F.aggregate(chars, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(1)))
    days = F.abs(F.date_diff(F.try_to_date(a, "yyyy-MM-dd"), F.try_to_date(b, "yyyy-MM-dd")))
    return first_match([(a.isNull() | b.isNull(), "n/a"), (a == b, "exact"), ((F.length(a) == F.length(b)) & (off == 1), "digit_flip"), (days <= 186, "near")], "differs")


def miss_reason(expected: Column, returned: Column, same_person: Column) -> Column:
    """Where the expected id came out: rank_1, lower_rank, other_id (same person), absent."""
    at = F.array_position(returned, expected)
    return first_match([(at == 1, "rank_1"), (at > 1, "lower_rank"), (F.size(F.array_intersect(returned, same_person)) > 0, "other_id")], "absent")


def to_records(pairs: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Both sides of pairs (<field>_1, <field>_2) as distinct records."""
    side = lambda i: pairs.select(*[F.col(f"{f}_{i}").alias(f) for f in fields])
    return side(1).unionByName(side(2)).distinct()
