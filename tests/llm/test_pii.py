import pytest

from weftline.llm import pii

GAZ = pii.Gazetteer.of(["joren", "maren", "brook", "sage", "thesi", "fenni", "mary-wyn"], ["lundlow", "kestfeld", "quillow", "o'branick", "van der moorn", "dunmere", "jaskdale"], ["brook", "sage"])


@pytest.fixture(scope="module")
def model():
    texts = [
        "Pt states neighbour Joren can open door", "per Maren Lundlow pt refuses wheelchair", "ask for Thesi", "report given to Kestfeld, Joren, RN", "Sage green cot cover, brook side entrance",
        "unit 7 staged at Dunmere, ETA 0930", "call son Joren at (834) 555-0191 on arrival", "auth no. 7771991346 on file, expires 05/26", "trip #88760034 rescheduled from 0238",
        "claim 9782-6069 paid; no balance", "SSN: 903-08-4770 per face sheet", "pt Maren Lundlow MRN#48213795", "verified A912-345-678 with son", "lives at 9288 Upper Jaskdale Ct, stairs x2", "p/u PO Box 55, Dunmere",
        "wound vac to sacrum, stage 5 ulcer Dr. Lundlow signed PCS, office 555-0119", "email forms to m.lundlow@mail.example.org", "cc joren at inbox dot example dot org", "no answer x2 at 551.555.0192",
        "text five five five zero one six four when outside", "Mr. O'Branick re sepsis", "lot 7598-11-6902 blood product en route",
    ]
    counts: dict = {}
    for t in texts * 20:
        for k, _, _, v in pii.candidates(t, GAZ):
            v = pii.with_contexts(k, v, [-1] * 4, {})
            counts[k, v] = counts.get((k, v), 0) + 1
    return pii.fit([(k, v, n) for (k, v), n in counts.items()], {})


def items(model, text):
    return [(k, text[a:b]) for k, a, b in model.items(text, GAZ)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Pt states neighbour Joren can open door", [("name", "Joren")]),
        ("report given to Kestfeld, Joren, RN", [("name", "Kestfeld, Joren")]),
        ("per T. Quillow pt refuses wheelchair", [("name", "T. Quillow")]),
        ("pt maren j. van der moorn ssn 943 04 4923", [("name", "maren j. van der moorn"), ("id_number", "943 04 4923")]),
        ("Sage green cot cover, brook side entrance", []),
        ("UNIT 7 STAGED AT DUNMERE, ETA 0930", []),
        ("auth no. 7771991346 on file, expires 05/26", []),
        ("trip #88760034 rescheduled; claim 9782-6069 paid", []),
        ("call son Joren at (834) 555-0191 on arrival", [("name", "Joren"), ("phone", "(834) 555-0191")]),
        ("text +1 206 555 0174 when outside", [("phone", "+1 206 555 0174")]),
        ("text five five five zero one six four when outside", [("phone", "five five five zero one six four")]),
        ("verified A#857190546 with son", [("id_number", "A#857190546")]),
        ("lives at 9288 Upper Jaskdale Ct, stairs x2", [("address", "9288 Upper Jaskdale Ct")]),
        ("stage 5 ulcer Dr. Lundlow signed PCS, office 555-0119", [("name", "Lundlow"), ("phone", "555-0119")]),
        ("cc joren at inbox dot example dot org", [("email", "joren at inbox dot example dot org")]),
        ("", []),
    ],
)
def test_items(model, text, want):
    assert items(model, text) == want


def test_redaction_keeps_the_rest(model):
    assert model.redact("call son Joren at (834) 555-0191 on arrival\r\nfall risk", GAZ) == "call son [NAME] at [PHONE] on arrival\r\nfall risk"


def test_very_long_text(model):
    import time

    long = "fall risk, no acute change; " * 20_000
    t = time.time()
    assert items(model, long + "ask for Thesi") == [("name", "Thesi")]
    assert time.time() - t < 60


def test_tables(spark, model):
    df = spark.createDataFrame([(1, "ask for Thesi", None), (2, None, ""), (3, "  ", "call 555-0119 for Maren")], "row_id long, a string, b string")
    words = spark.createDataFrame(list(GAZ.words.items()), "word string, bits int")
    texts = pii.with_known(df, "row_id", ["a", "b"], words)
    spans = pii.find_spans(texts)
    got = sorted(tuple(r) for r in pii.found(spans, model).collect())
    assert (1, "a", "name", 9) in got and {r[0] for r in got} <= {1, 3}
    red = {r.row_id: (r.a, r.b) for r in pii.redact(texts, model).collect()}
    assert red[1] == ("ask for [NAME]", None) and red[2] == (None, "")


def test_em_finds_the_reliable_votes():
    import numpy as np

    patterns, counts = ["+++", "++0", "000", "0-0", "+-0"], np.array([500.0, 200, 900, 300, 20])
    post = pii.em(patterns, counts)
    assert post[0] > 0.9 and post[1] > 0.9 and post[3] < 0.1 and post[0] > post[2] > post[3]


def test_names_outside_the_gazetteer_are_candidates_in_context():
    from weftline.llm.pii import Gazetteer, candidates

    def names(t):
        return [t[a:b] for k, a, b, _ in candidates(t, Gazetteer.of([], [])) if k == "name"]

    assert names("seen by Dr. Ostquist, wife Wexick Brandal aware. POA Nordale") == ["Ostquist", "Wexick Brandal", "Nordale"]
    assert names("ask for the driver. Zbigniew Kowalczyk rode along, Joren Ostquist too") == ["Zbigniew Kowalczyk", "Joren Ostquist"]
    assert names("case manager PICC line, Dr. Office at Mill Road, pt stable") == []


def test_known_words_by_column_give_the_same(spark):
    texts = [(1, "ask for Thesi", "DR. LUNDLOW re sepsis"), (2, None, "seen by Quillow, Joren, RN"), (3, "no one", ""), (4, "brook side entrance O’Branick", "x")]
    df = spark.createDataFrame(texts, "row_id long, a string, b string")
    words = spark.createDataFrame(list(GAZ.words.items()), "word string, bits int")
    one, other = (pii.with_known(df, "row_id", ["a", "b"], words, limit) for limit in (1000, 0))
    assert one.gaz is not None and other.gaz is None
    flat = lambda t: sorted(map(repr, pii.find_spans(t).collect()))
    assert flat(one) == flat(other) != []


def test_rare_names_are_known_and_common_words_marked(spark):
    texts = spark.createDataFrame([("Odd Wexick sits by the green door", "A door, a green one"), ("GREEN", None), ("joren.k@x.example Joren and joren@y.example", "")], "a string, b string")
    names = spark.createDataFrame([("Joren", None, "van der Wexick"), ("green", "UNKNOWN", None), ("xx", None, "NoName")], "g string, m string, s string")
    hollow = spark.createDataFrame([("s", "noname")], "field_name string, placeholder string")
    got = {r.word: r.bits for r in pii.known_words(texts, ["a", "b"], names, ["g", "m"], ["s"], hollow).collect()}
    assert got["joren"] == pii.GIVEN and got["wexick"] == pii.SUR and got["green"] == pii.GIVEN | pii.COMMON and got["door"] == pii.COMMON
    assert not {"unknown", "noname", "odd", "xx"} & set(got)


def test_contexts_vote_by_seeds_and_by_variety():
    sums = [
        ("name", 1, 1, 500, 200, 500, 8), ("name", 1, 2, 500, 0, 500, 400), ("name", 1, 3, 500, 0, 400, 9), ("name", 1, 4, 3, 0, 3, 3), ("name", 1, 7, 500, 0, 100, 1),
        ("phone", 1, 5, 300, 280, 0, 0), ("phone", 1, 6, 300, 0, 0, 0),
    ]
    assert pii.context_votes(sums) == {("name", 1, 1): "+", ("name", 1, 2): "-", ("name", 1, 3): "+", ("name", 1, 7): "-", ("phone", 1, 5): "+", ("phone", 1, 6): "-"}
