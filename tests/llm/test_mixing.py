import random

import pytest

from weftline.llm import mixing


def run(spark, docs, targets):
    sizes = mixing.with_hash(spark.createDataFrame(docs, "doc_id long, source string, n_tokens long"), "doc_id", 8).cache()
    t = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    shares = mixing.budgets(sizes, t)
    mixing.find_thresholds(sizes, shares)
    chosen = mixing.select(sizes, shares, spark)
    return {r.doc_id: r.copies for r in chosen.collect()}, {r.source: r for r in mixing.report(chosen, shares, spark).collect()}


def test_shares_caps_and_missing_sources(spark):
    rng = random.Random(2)
    docs = [(i, rng.choice(["a"] * 6 + ["b", "c", "x", None]), rng.randrange(1, 60)) for i in range(6000)] + [(9000 + i, "a", 0) for i in range(5)]
    targets = [("a", 0.3, 1), ("b", 0.3, 3), ("c", 0.2, 2), ("gone", 0.2, 5)]
    copies, shares = run(spark, docs, targets)
    source = {i: s for i, s, _ in docs}
    cap = {s: c for s, _, c in targets}
    assert all(c <= cap[source[i]] for i, c in copies.items())
    assert not any(i >= 9000 for i in copies) and not any(source[i] in ("x", None) for i in copies)
    for s, share, _ in targets[:3]:
        assert abs(shares[s].reached_share - share / 0.8) < 0.001
    assert shares["gone"].selected_tokens == 0
    # the scarcest source is used up
    assert max(shares[s].selected_tokens / (cap[s] * shares[s].available_tokens) for s in "abc") == pytest.approx(1)


def test_one_text_each(spark):
    copies, shares = run(spark, [(1, "a", 100), (2, "b", 7)], [("a", 0.5, 1), ("b", 0.5, 20)])
    assert copies[2] <= 20 and shares["a"].selected_tokens == 100


def test_long_texts_at_the_boundary(spark):
    docs = [(i, "a", 1000 if i % 50 == 0 else 3) for i in range(2000)] + [(5000, "b", 10_001)]
    _, shares = run(spark, docs, [("a", 0.5, 1), ("b", 0.5, 1)])
    assert abs(shares["a"].selected_tokens - 10_001) <= 10


def test_the_same_texts_of_every_length_serve_once_more(spark):
    """Length has no part in the choice: at equal hashes other lengths give a run of the circle, too."""
    docs = [(i, "a", 1 + i % 7) for i in range(3000)] + [(5000, "b", 5000)]
    copies, shares = run(spark, docs, [("a", 0.5, 1), ("b", 0.5, 1)])
    assert abs(shares["a"].selected_tokens - 5000) <= 3
    sizes = mixing.with_hash(spark.createDataFrame(docs, "doc_id long, source string, n_tokens long"), "doc_id", 8).filter("source = 'a'").orderBy("h").collect()
    taken = [r.doc_id in copies for r in sizes]
    assert sum(x != y for x, y in zip(taken, taken[1:] + taken[:1])) == 2


def test_nothing_to_mix(spark):
    copies, shares = run(spark, [(1, "z", 5)], [("a", 1.0, 1)])
    assert copies == {} and shares["a"].reached_share == 0
    copies, shares = run(spark, [(1, "a", 5)], [("a", 1.0, 0)])
    assert copies == {}
