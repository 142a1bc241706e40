import random
from difflib import SequenceMatcher

from weftline.operators import text
from weftline.plans import relations


def test_best_of_all_options(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ABCDE") for _ in range(rng.randint(1, 7)))
    options, asked = [word() for _ in range(60)], [word() for _ in range(150)] + ["É", "", None]
    got = text.fuzzy_best_of(spark.createDataFrame([(a,) for a in asked], "name string"), "name", options, 0.72).collect()
    for r in got:
        ratios = [(-SequenceMatcher(None, r.name, o).ratio(), o) for o in options] if r.name is not None else []
        want = min((x for x in ratios if -x[0] >= 0.72), default=None)
        assert (r.best, r.ratio) == ((want[1], -want[0]) if want else (None, None))


def test_misspelt_beginnings_and_shares(spark, tmp_path):
    names = ["Quilton"] * 6000 + ["Falenby"] * 6000 + ["Qquilton", "Flenby"] + ["Tolenr"] * 5
    spark.createDataFrame([(n,) for n in names], "lastName string").write.parquet(str(tmp_path / "rpt_bronze_party.parquet"))
    got = {r.name: r.best for r in relations.QUERIES["fuzzy_lookup"](spark, str(tmp_path)).collect()}
    assert got == {"QUILTON": "QUILTON", "FALENBY": "FALENBY", "QQUILTON": "QUILTON", "FLENBY": "FALENBY", "TOLENR": None}
