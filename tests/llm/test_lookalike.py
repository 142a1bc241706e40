import itertools
import random

import pytest

from weftline.llm.lookalike import canonical, keyed, look, look_classes, look_pairs

SAME = [
    ("wheelchair fits", "wheelcһаir ﬁts"), ("Ref 12", "Ｒｅｆ　１２"), ("número é", "número é"), ("a b", "a b"), ("a b", "a b"), ("ab", "a​b"), ("ab", "a­b﻿"),
    ("No... well", "No… well"), ("отсутствует", "отcутcтвyeт"), ("επιστροφή", "επιστρoφή"), ("ệ", "ệ"), ("a\r\nb", "a\nb"), ("  a ", "a"), ("ｶﾞ", "ガ"), ("ΝΟΡ", "NOP"),
]
DIFFERENT = [("Ref", "ref"), ("person", "peRson"), ("é", "e"), ("x²", "x2"), ("①", "1"), ("it's", "it’s"), ("O", "0"), ("l", "1"), ("a b", "ab"), ("a\nb", "a b"), ("й", "и"), ("ы", "bl"), ("½", "1/2"), ("a.b", "a,b"), ("ñ", "n"), ("👩‍⚕", "👩⚕")]


@pytest.mark.parametrize("a,b", SAME)
def test_same_look(a, b):
    assert look(a) == look(b) and canonical(a) == canonical(b)


@pytest.mark.parametrize("a,b", DIFFERENT)
def test_different_look(a, b):
    assert look(a) != look(b)


def test_canonical_folds_case_and_compatibility():
    assert canonical("STRASSE ① ﬁ") == canonical("straße 1 FI") == "strasse 1 fi"
    assert canonical("Тест") == "тест"  # letters of their own script stay
    assert canonical(canonical("Ｔеst ① é")) == canonical("Ｔеst ① é")


def test_equal_look_gives_equal_canonical_form():
    rng = random.Random(4)
    letters = "aеcо А Тt́ﬁé１½ ​\t\nxЖλο"
    for _ in range(3000):
        t = "".join(rng.choice(letters) for _ in range(6))
        assert look(look(t)) == look(t)
        assert canonical(look(t)) == canonical(t)


def pairs(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {tuple(r) for r in look_pairs(keyed(df, "doc_id", "text"), **kw).collect()}


def test_pairs_leave_out_copies_and_the_invisible(spark):
    texts = ["ab c", "ab c", "ab c", "аb c", None, "", "​", " ", "AB C"]
    assert pairs(spark, texts) == {(0, 1), (1, 2), (0, 3), (1, 3), (2, 3)}


def test_wide_class_keeps_every_document_linked(spark):
    texts = ["same text"] * 300 + ["ѕame text"] * 3 + ["same text"] * 2
    full, star = pairs(spark, texts), pairs(spark, texts, max_class_pairs=10)
    assert star <= full and len(star) <= len(texts)
    assert {x for p in star for x in p} == set(range(len(texts)))
    assert len(full) == sum(texts[a] != texts[b] for a, b in itertools.combinations(range(len(texts)), 2))


def test_classes(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "a b")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n) for r in look_classes(keyed(df, "doc_id", "text")).collect()) == [(1, 2), (2, 1)]


def test_all_pairs_of_a_large_class(spark, monkeypatch):
    texts = ["same text", "ѕame text", "sаme text"] * 60
    want = {(a, b) for a, b in itertools.combinations(range(len(texts)), 2) if texts[a] != texts[b]}
    assert pairs(spark, texts) == want
    monkeypatch.setattr("weftline.llm.lookalike.PART_PAIRS", 2)  # salted
    assert pairs(spark, texts) == want


def test_other_scripts_letter_by_letter():
    from weftline.llm import lookalike as la

    for letters in (la.GREEK, la.CYRILLIC, la.ARMENIAN, la.CHEROKEE):
        for far, near in letters.items():
            assert la.look(f"x{far}x") == la.look(f"x{near}x") and la.canonical(f"x{far}x") == la.canonical(f"x{near}x")


def test_words_of_other_scripts_stay_in_theirs():
    from weftline.llm.lookalike import canonical

    for word in ("αλήθεια", "ρυθμός", "утро", "ветер", "հայերեն", "ᏣᎳᎩ"):
        assert canonical(word) == canonical(canonical(word))
        assert not any(c.isascii() and c.isalpha() for c in canonical(word))
    assert canonical("ветер") == "ветер" and canonical("αλήθεια") == "αλήθεια"
