"""Vectors counted within tasks are those of the pairs made one by one; edits at their limits."""

import itertools
import random

from pyspark.sql import functions as F

from weftline.operators import joins, linkage, vectors
from weftline.plans import linkages


def _value(rng):
    """Texts at the limits of the levels: short and long, near copies, letters of several bytes, blanks, signs that padding could hide."""
    kind = rng.randrange(10)
    if kind == 0:
        return rng.choice([None, "", "  ", "\t", " A", "A", "A ", "\x00", "A\x00"])
    base = rng.choice(["Bo", "Ann", "Šimić", "😀mira", "Roswyn", "Pelandre", "A820346169", "921-03-5493", "Quintera-Lund", "x" * 19, "de la Quintera y Morska", "abcdefghij" * 4, "long" * 16, "long" * 16 + "r", "word " * 18])
    text = list(base)
    for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
        at = rng.randrange(len(text) + 1)
        text[at : at + rng.randrange(2)] = rng.choice(["", "a", "9", "é", "ab"])
    return "".join(text)


def test_edits(spark):
    rng = random.Random(1)
    texts = [t for t in (_value(rng) for _ in range(400)) if t and t.strip(" ")]
    pairs = list(zip(texts, texts[::-1])) + [(a, b) for a, b in itertools.islice(itertools.combinations(texts, 2), 3000)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    want = {r.i: (r.d, r.level) for r in df.select("i", F.levenshtein("a", "b").alias("d"), linkage.agreement(F.col("a"), F.col("b")).alias("level")).collect()}
    values = vectors.Values(vectors.pa.array([t for p in pairs for t in p]))
    x, y = values.codes[::2], values.codes[1::2]
    found = values.levels(x, y)
    short = [i for i, (a, b) in enumerate(pairs) if max(len(a), len(b)) <= vectors.WORD]
    quick = dict(zip(short, values._edits(x[short], y[short])))
    for i, (a, b) in enumerate(pairs):
        assert (vectors.edits(a, b), found[i]) == want[i], (a, b)
        assert quick.get(i, want[i][0]) == want[i][0], (a, b)


def test_vectors_of_small_whole_and_split_blocks(spark):
    rng = random.Random(2)
    blocks = [("big", "1")] * 300 + [("middle", "1")] * 150 + [("middle", "2")] * 90 + [("alone", "1"), (None, "1"), ("big", None)] + [(f"b{i // 7}", "1") for i in range(150)]
    data = [(f"P{i}", *b, *[_value(rng) for _ in range(3)]) for i, b in enumerate(rng.sample(blocks, len(blocks)))]
    df = spark.createDataFrame(data, "id string, k string, l string, x string, y string, z string")
    levels = [linkage.agreement(F.col(f"{c}_1"), F.col(f"{c}_2")).alias(f"v_{c}") for c in "xyz"]
    want = sorted(tuple(r) for r in joins.pairs_within(df, ["k", "l"]).groupBy(*levels).count().collect())
    assert sum(r[-1] for r in want) == sum(n * (n - 1) // 2 for n in (300, 150, 90, 3, *[7] * 21))
    for part_rows in (70, 2000):
        counts = vectors.vector_counts(df, ["k", "l"], "id", {f"v_{c}": c for c in "xyz"}, part_rows)
        assert sorted(tuple(r) for r in counts.collect()) == want
    fitted = linkage.em_weights(counts, ["v_x", "v_y"], weight="n")
    plain = linkage.em_weights(joins.pairs_within(df, ["k", "l"]).select(*levels), ["v_x", "v_y"])
    assert fitted == plain


def test_unsupervised_weights_without_a_row_per_pair(spark, sf, monkeypatch):
    def none(*_):
        raise AssertionError("pairs made one by one")

    monkeypatch.setattr(joins, "pairs_within", none)
    got = linkages.QUERIES["fs_unsupervised"](spark, sf).collect()
    assert {(r.feature, r.level) for r in got} == {(f, i) for f in linkages.LEVELS for i in range(4)}
    for f in linkages.LEVELS:
        assert abs(sum(r.m for r in got if r.feature == f) - 1) < 1e-6


def test_unsupervised_weights_of_empty_tables_and_of_nulls(spark, empty_dir, null_dir):
    for d in (empty_dir, null_dir):
        assert linkages.QUERIES["fs_unsupervised"](spark, d).count() == 4 * len(linkages.LEVELS)
