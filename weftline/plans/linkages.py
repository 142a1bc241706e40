"""Record linkage and graphs of matched pairs: labelled pairs, features, scores, scenarios, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import aggregates, graph, joins, linkage, vectors, windows
from weftline.plans.registry import Registry
from weftline.runtime import Stage, load

R = Registry()

ATTRIBUTES = ["firstName", "middleName", "lastName", "dob", "cob", "anumber", "ssn", "fin", "driversLicense", "passport", "i94", "travel_doc"]
IDS = {"anum": "anumber", "ssn": "ssn", "fin": "fin", "dl": "driversLicense", "passport": "passport", "i94": "i94", "travel_doc": "travel_doc"}
STRONG = ["anum", "ssn", "fin"]
#: Which identifiers each scenario may use; names, date and country of birth always count.
SCENARIOS = {
    "baseline": STRONG,
    "no_ssn": ["anum", "fin"],
    "no_strong_id": [],
    "with_dl": [*STRONG, "dl"],
    "with_dl_no_strong_id": ["dl"],
    "with_other_ids": [*STRONG, "dl", "passport", "i94", "travel_doc"],
    "other_ids_no_strong": ["dl", "passport", "i94", "travel_doc"],
    "all_ids": list(IDS),
}
LEVELS = {"first": "firstName", "last": "lastName", "dob": "dob", "cob": "cob", **IDS}
ALWAYS = ["first", "last", "dob", "cob"]

# ---------------------------------------------------------------- inputs


def links(spark: SparkSession, d: str) -> DataFrame:
    """(pr1, pr2): distinct linked pairs as delivered, ids in capitals."""
    df = load(spark, d, "anm_training_data_matches").filter("label = 1")
    return df.select(F.upper(F.trim("pr1")).alias("pr1"), F.upper(F.trim("pr2")).alias("pr2")).filter("pr1 <> pr2").distinct()


def person(spark: SparkSession, d: str) -> DataFrame:
    """One row per party, the smallest value of each attribute."""
    return load(spark, d, "rpt_bronze_party").filter("party_id is not null").groupBy("party_id").agg(*[F.min(c).alias(c) for c in ATTRIBUTES])


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """(id_1, id_2, label, attributes _1 and _2): all linked pairs of known parties, and as others those that
    share surname, country and decade of birth without a link."""
    p = person(spark, d)
    both = links(spark, d).select(F.least("pr1", "pr2").alias("id_1"), F.greatest("pr1", "pr2").alias("id_2")).distinct()
    known = p.select(F.col("party_id").alias("__id"))
    true = both
    for side in ("id_1", "id_2"):
        true = true.join(known, F.col(side) == F.col("__id"), "left_semi")
    for side in ("1", "2"):
        true = true.join(joins.suffixed(p, f"_{side}"), F.col(f"id_{side}") == F.col(f"party_id_{side}"))
    block = F.concat_ws("\x1f", "lastName", "cob", F.substring("dob", 1, 3))
    # a row brings its attributes and the ids it is linked to, so the pairs, which are far more, are neither joined nor shuffled again
    linked = both.groupBy(F.col("id_1").alias("__of")).agg(F.collect_list("id_2").alias("linked"))
    rows = p.filter("lastName is not null and cob is not null and dob is not null").join(linked, F.col("party_id") == F.col("__of"), "left")
    near = joins.pairs_within(rows.select(F.col("party_id").alias("id"), block.alias("block"), "linked", *ATTRIBUTES), ["block"])
    near = near.filter("linked_1 is null or not array_contains(linked_1, id_2)")
    columns = ["id_1", "id_2", "label", *[f"{c}_{side}" for side in ("1", "2") for c in ATTRIBUTES]]
    return true.withColumn("label", F.lit(1)).select(columns).unionByName(near.withColumn("label", F.lit(0)).select(columns))


LINKS = "links AS (SELECT DISTINCT upper(trim(pr1)) AS pr1, upper(trim(pr2)) AS pr2 FROM anm_training_data_matches WHERE label = 1 AND upper(trim(pr1)) <> upper(trim(pr2)))"
PERSON = "person AS (SELECT party_id, " + ", ".join(f"min({c}) AS {c}" for c in ATTRIBUTES) + " FROM rpt_bronze_party WHERE party_id IS NOT NULL GROUP BY 1)"
_BOTH_SIDES = ", ".join(f"a.{c} AS {c}_1, b.{c} AS {c}_2" for c in ATTRIBUTES)
LAB = f"""{LINKS}, {PERSON}, both_ways AS (SELECT DISTINCT least(pr1, pr2) AS id_1, greatest(pr1, pr2) AS id_2 FROM links),
    near AS (SELECT a.party_id AS id_1, b.party_id AS id_2 FROM person a JOIN person b ON a.lastName = b.lastName AND a.cob = b.cob AND substr(a.dob, 1, 3) = substr(b.dob, 1, 3) AND a.party_id < b.party_id),
    lab AS (SELECT id_1, id_2, label, {_BOTH_SIDES} FROM (SELECT *, 1 AS label FROM both_ways UNION ALL SELECT *, 0 FROM near ANTI JOIN both_ways USING (id_1, id_2)) JOIN person a ON id_1 = a.party_id JOIN person b ON id_2 = b.party_id)"""

# The engine of the SQL counts edits in bytes: letters beyond ASCII are put on unused signs first.
_FAR = [chr(c) for c in range(0xC0, 0x100)] + list("šćčžŠĆ")
_NEAR = [chr(c) for c in [*range(1, 32), *(c for c in range(33, 65) if c not in (39, 45, 46)), *range(91, 97), *range(123, 127)]]


def _bytes(c: str) -> str:
    return f"translate({c}, '{''.join(_FAR)}', '{''.join(_NEAR)}')"


def _sim(c: str) -> str:
    a, b = f"{c}_1", f"{c}_2"
    return f"CASE WHEN trim(coalesce({a}, '')) = '' OR trim(coalesce({b}, '')) = '' THEN -1.0 ELSE 1 - levenshtein({_bytes(a)}, {_bytes(b)}) * 1.0 / greatest(length({a}), length({b})) END"


LVL = LAB + ", sim AS (SELECT *, " + ", ".join(f"{_sim(c)} AS s_{f}" for f, c in LEVELS.items()) + " FROM lab), lvl AS (SELECT *, " + ", ".join(
    f"CASE WHEN s_{f} < 0 THEN 0 WHEN s_{f} >= 0.95 THEN 1 WHEN s_{f} >= 0.8 THEN 2 ELSE 3 END AS {f}" for f in LEVELS
) + ", coalesce(try_cast(substr(id_1, 2) AS BIGINT), 0) * 31 + coalesce(try_cast(substr(id_2, 2) AS BIGINT), 0) AS k FROM sim)"


def levels(spark: SparkSession, d: str) -> DataFrame:
    """labelled pairs with a level (0 missing, 1 same, 2 close, 3 else) per feature and k, a number of the pair."""
    number = lambda c: F.coalesce(F.substring(c, 2, 20).try_cast("long"), F.lit(0))
    level = [linkage.agreement(F.col(f"{c}_1"), F.col(f"{c}_2")).alias(f) for f, c in LEVELS.items()]
    return labelled(spark, d).select("*", *level, (number("id_1") * 31 + number("id_2")).alias("k"))


# ---------------------------------------------------------------- features and scores


@R.query(f"WITH {LVL} SELECT id_1, id_2, label, dob, first, ssn FROM lvl")
def comparison_levels(spark: SparkSession, d: str) -> DataFrame:
    return levels(spark, d).select("id_1", "id_2", "label", "dob", "first", "ssn")


_WORDS = lambda s: f"list_distinct(list_filter(string_split_regex(lower(trim(concat_ws(' ', firstName_{s}, middleName_{s}, lastName_{s}))), '\\s+'), lambda w: w <> ''))"


@R.query(f"""WITH {LAB}, w AS (SELECT *, {_WORDS(1)} AS x, {_WORDS(2)} AS y FROM lab) SELECT id_1, id_2,
    {", ".join(f"round(CAST({_sim(c)} AS DOUBLE), 6) AS f_{f}" for f, c in [("dob", "dob"), *IDS.items()])},
    CAST(CASE WHEN trim(coalesce(cob_1, '')) = '' OR trim(coalesce(cob_2, '')) = '' THEN -1 WHEN cob_1 = cob_2 THEN 1 ELSE 0 END AS DOUBLE) AS f_cob,
    round(CASE WHEN len(x) = 0 OR len(y) = 0 THEN -1.0 ELSE len(list_intersect(x, y)) / sqrt(len(x) * len(y)) END, 6) AS f_name, round(CAST({_sim("firstName")} AS DOUBLE), 6) AS f_first FROM w""")
def similarity_features(spark: SparkSession, d: str) -> DataFrame:
    """All comparison features of the labelled pairs, -1 where a side is missing."""
    full = lambda s: F.concat_ws(" ", *[f"{c}_{s}" for c in ("firstName", "middleName", "lastName")])
    sims = [F.round(linkage.similarity(F.col(f"{c}_1"), F.col(f"{c}_2")), 6).alias(f"f_{f}") for f, c in [("dob", "dob"), *IDS.items(), ("first", "firstName")]]
    return labelled(spark, d).select(
        "id_1", "id_2", *sims, linkage.exact(F.col("cob_1"), F.col("cob_2")).alias("f_cob"), F.round(linkage.token_cosine(full(1), full(2)), 6).alias("f_name")
    )


_WEIGHTS = """c AS (SELECT label, unnest([{names}]) AS feature, unnest([{cols}]) AS level FROM {rows}),
    t AS (SELECT feature, count(*) FILTER (label = 1) AS tm, count(*) FILTER (label <> 1) AS tu FROM c GROUP BY 1), g AS (SELECT feature, CAST(unnest([0, 1, 2, 3]) AS INTEGER) AS level, tm, tu FROM t),
    s AS (SELECT feature, level, count(*) FILTER (label = 1) AS nm, count(*) FILTER (label <> 1) AS nu FROM c GROUP BY 1, 2),
    w AS (SELECT feature, level, (coalesce(nm, 0) + 0.5) / (tm + 2.0) AS m, (coalesce(nu, 0) + 0.5) / (tu + 2.0) AS u FROM g LEFT JOIN s USING (feature, level))"""


def _weights(features: list[str], rows: str) -> str:
    return _WEIGHTS.format(names=", ".join(f"'{f}'" for f in features), cols=", ".join(features), rows=rows)


@R.query(f"WITH {LVL}, {_weights(['dob', 'ssn'], 'lvl')} SELECT feature, level, round(m, 9) AS m, round(u, 9) AS u, round(log2(m / u), 6) AS weight FROM w")
def fs_supervised(spark: SparkSession, d: str) -> DataFrame:
    w = linkage.fit_weights(levels(spark, d), ["dob", "ssn"], "label")
    return w.select("feature", "level", F.round("m", 9).alias("m"), F.round("u", 9).alias("u"), F.round("weight", 6).alias("weight"))


_H = "(((k % 1000003) * 7919 + 12345) % 1000003 * 6007 + 31) % 1000003"
_SPLIT = f"""r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_H}, k) AS __r, count(*) OVER (PARTITION BY label) AS __n FROM lvl),
    train AS (SELECT * FROM r WHERE __r <= floor(__n * 0.75)), test AS (SELECT * FROM r WHERE __r > floor(__n * 0.75))"""


def _lookup(feature: str) -> str:
    return f"(SELECT log2(m / u) FROM w WHERE feature = '{feature}' AND level = test.{feature})"


def _auc_sql(rows: str, by: str) -> str:
    """AUC and average precision of (by, s, label) rows."""
    key = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""SELECT {key}CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(q) AS BIGINT) AS n_neg,
        round(sum(q * (pu - p / 2.0)) / nullif(CAST(sum(p) AS DOUBLE) * sum(q), 0), 6) AS auc, round(sum(CAST(p AS DOUBLE) * pu / (pu + qu)) / nullif(sum(p), 0), 6) AS ap
        FROM (SELECT *, sum(p) OVER ({part}ORDER BY s DESC) AS pu, sum(q) OVER ({part}ORDER BY s DESC) AS qu
              FROM (SELECT {key}s, count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS q FROM {rows} GROUP BY ALL)) {"GROUP BY " + by if by else ""}"""


@R.query(f"""WITH {LVL}, {_SPLIT}, {_weights(["dob", "first", "ssn"], "train")}, prior AS (SELECT avg(label) AS p FROM train),
    scored AS (SELECT label, round(log2(p / (1 - p)) + {" + ".join(_lookup(f) for f in ("dob", "first", "ssn"))}, 9) AS s FROM test, prior) {_auc_sql("scored", "")}""")
def fs_scored_auc(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the held-out quarter of the pairs under weights from the rest, and their AUC."""
    train, test = _halves(Stage(spark, "fs").write(levels(spark, d).select("k", "label", "dob", "first", "ssn"), "pairs"))
    w = linkage.fit_weights(train, ["dob", "first", "ssn"], "label")
    scored = linkage.score_pairs(test, ["dob", "first", "ssn"], w, linkage.log_prior(train, "label"))
    return aggregates.auc_ap(scored.withColumn("s", F.round("match_weight", 9)), "s", "label")


def _halves(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    split = windows.stratified_split(pairs, "k", "label", 0.75)
    return split.filter("split = 'train'").drop("split"), split.filter("split = 'test'").drop("split")


#: Keys of which one equal pair makes two records a candidate.
RULES = {
    "first+dob": ("firstName", "dob"), "last+dob": ("lastName", "dob"), "first+last": ("firstName", "lastName"),
    "last3+dob": ("substr(lastName, 1, 3)", "dob"), "last+year": ("lastName", "substr(dob, 1, 4)"), "first+year": ("firstName", "substr(dob, 1, 4)"),
}


def _same(keys: tuple[str, ...]) -> str:
    """SQL of both engines: the keys of both sides are equal; a missing one never is."""
    one = lambda k, s: k.replace("lastName", f"lastName_{s}").replace("firstName", f"firstName_{s}").replace("dob", f"dob_{s}")
    return "coalesce(" + " AND ".join(f"{one(k, 1)} = {one(k, 2)}" for k in keys) + ", false)"


_ANY_RULE = "(" + " OR ".join(_same(k) for k in RULES.values()) + ")"
_ID_HIT = {f: f"coalesce({c}_1 = {c}_2, false)" for f, c in IDS.items()}


@R.query(f"""WITH {LAB}, h AS (SELECT label, unnest([{", ".join(f"'{r}'" for r in RULES)}, 'any']) AS rule, unnest([{", ".join(_same(k) for k in RULES.values())}, {_ANY_RULE}]) AS hit FROM lab)
    SELECT rule, round(avg(CAST(hit AS INTEGER)) FILTER (label = 1), 6) AS recall, count(*) FILTER (hit) AS candidates FROM h GROUP BY 1""")
def blocking_recall(spark: SparkSession, d: str) -> DataFrame:
    """Share of all true pairs that each rule, or any of them, makes a candidate, and the labelled pairs it hits."""
    hits = labelled(spark, d).select("label", *[F.expr(_same(k)).alias(r) for r, k in RULES.items()], F.expr(_ANY_RULE).alias("any"))
    long = hits.unpivot(["label"], [*RULES, "any"], "rule", "hit")
    return long.groupBy("rule").agg(F.round(F.avg(F.when(F.col("label") == 1, F.col("hit").cast("int"))), 6).alias("recall"), F.count_if("hit").alias("candidates"))


def _grid_sql() -> str:
    usable = " OR ".join(f"({f} > 0)" for f in STRONG)
    scored = " UNION ALL ".join(
        f"SELECT '{n}' AS scenario, label, no_strong, {_ANY_RULE}{''.join(' OR ' + _ID_HIT[f] for f in ids)} AS hit, round({' + '.join(f'w_{f}' for f in [*ALWAYS, *ids])}, 9) AS s FROM weighed" for n, ids in SCENARIOS.items()
    )
    return f"""WITH {LVL}, {_SPLIT}, {_weights(list(LEVELS), "train")},
        weighed AS (SELECT *, NOT ({usable}) AS no_strong, {", ".join(f"{_lookup(f)} AS w_{f}" for f in LEVELS)} FROM test),
        each AS ({scored}), sliced AS (SELECT *, 'all' AS slice FROM each UNION ALL SELECT *, 'no_strong_id' FROM each WHERE no_strong),
        recall AS (SELECT scenario, slice, round(avg(CAST(hit AS INTEGER)) FILTER (label = 1), 6) AS blocking_recall FROM sliced GROUP BY ALL),
        auc AS ({_auc_sql("sliced", "scenario, slice")})
        SELECT * FROM auc JOIN recall USING (scenario, slice)"""


@R.query(_grid_sql())
def scenario_slices(spark: SparkSession, d: str) -> DataFrame:
    """Eight scenarios of usable identifiers, on all held-out pairs and on those without a strong id on both sides.

    Weights come from the other pairs; a feature's weights don't depend on the scenario, so all of them are scored in one pass.
    """
    wide = levels(spark, d).select("k", "label", *LEVELS, F.expr(_ANY_RULE).alias("any"), *[F.expr(x).alias(f"hit_{f}") for f, x in _ID_HIT.items()])
    train, test = _halves(Stage(spark, "slices").write(wide, "levels"))
    weighed = linkage.weigh(test, list(LEVELS), linkage.fit_weights(train, list(LEVELS), "label"))
    no_strong = F.greatest(*STRONG) == 0
    each = F.explode(
        F.array(*[
            F.struct(
                F.lit(n).alias("scenario"), F.greatest("any", *[f"hit_{f}" for f in ids]).alias("hit") if ids else F.col("any").alias("hit"),
                F.round(sum((F.col(f"w_{f}") for f in [*ALWAYS[1:], *ids]), F.col(f"w_{ALWAYS[0]}")), 9).alias("s"),
            )
            for n, ids in SCENARIOS.items()
        ])
    )
    slices = F.explode(F.when(no_strong, F.array(F.lit("all"), F.lit("no_strong_id"))).otherwise(F.array(F.lit("all")))).alias("slice")
    rows = weighed.select("label", slices, *[f"w_{f}" for f in LEVELS], "any", *[f"hit_{f}" for f in IDS]).select("label", "slice", each.alias("e")).select("label", "slice", "e.*")
    recall = rows.groupBy("scenario", "slice").agg(F.round(F.avg(F.when(F.col("label") == 1, F.col("hit").cast("int"))), 6).alias("blocking_recall"))
    return aggregates.auc_by(rows, ["scenario", "slice"], "s", "label").join(recall, ["scenario", "slice"])


@R.query(f"""WITH {LVL}, f AS (SELECT label, unnest(['dob', 'first', 'ssn']) AS feature, unnest([dob, first, ssn]) AS s FROM lvl), a AS ({_auc_sql("f", "feature")})
    SELECT feature, greatest(auc, 1 - auc) AS auc FROM a""")
def leakage_auc(spark: SparkSession, d: str) -> DataFrame:
    """max(auc, 1 - auc) of each feature alone: a value near 1 says the label leaks into it."""
    long = levels(spark, d).select("label", "dob", "first", "ssn").unpivot(["label"], ["dob", "first", "ssn"], "feature", "s")
    return aggregates.auc_by(long, ["feature"], "s", "label").select("feature", F.greatest(F.col("auc"), 1 - F.col("auc")).alias("auc"))


@R.query()
def fs_unsupervised(spark: SparkSession, d: str) -> DataFrame:
    """m by expectation-maximisation over two blockings, u from random pairs of records, the prior from the share of true pairs.

    No SQL: the estimates are iterative. A feature that a blocking equates takes no part in its pass; m is the mean of its passes.
    """
    stage, p = Stage(spark, "em"), person(spark, d)
    people = stage.write(p.select("party_id", *LEVELS.values()), "people")
    n = people.count()
    compared = lambda pairs: pairs.select(*[linkage.agreement(F.col(f"{c}_1"), F.col(f"{c}_2")).alias(f) for f, c in LEVELS.items()])
    u = linkage.level_shares(compared(joins.random_pairs(people, "party_id", n)), list(LEVELS))
    prior = linkage.pair_prior(links(spark, d).select(F.least("pr1", "pr2").alias("a"), F.greatest("pr1", "pr2").alias("b")).distinct().count(), n)
    passes: dict[str, list] = {f: [] for f in LEVELS}
    for keys in (["firstName", "lastName"], ["dob"]):
        free = [f for f, c in LEVELS.items() if c not in keys]
        # the pairs grow with the square of a block, so they are counted by vector where they are compared
        counts = vectors.vector_counts(people, keys, "party_id", {f: LEVELS[f] for f in free})
        fitted = linkage.em_weights(counts, free, u=u, weight="n")
        for f in free:
            passes[f].append(fitted["m"][f])
    rows = [(f, i, sum(m[i] for m in ms) / len(ms), u[f][i], prior) for f, ms in passes.items() for i in range(4)]
    return spark.createDataFrame([(f, i, float(m), float(x), float(q)) for f, i, m, x, q in rows], "feature string, level int, m double, u double, prior double")


@R.query()
def supervised_model(spark: SparkSession, d: str) -> DataFrame:
    """A family of models over one-hot levels, their metrics on the held-out quarter: linear, boosted trees, and Fellegi-Sunter weights.

    No SQL: models are fitted iteratively.
    """
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    features = ["dob", "first", "ssn"]
    split = windows.stratified_split(Stage(spark, "model").write(levels(spark, d).select("k", "label", *features), "levels"), "k", "label", 0.75)
    # a pair is one of few combinations of levels: the models are fitted to these, weighted by their pairs
    counts = Stage(spark, "model").write(split.groupBy("split", "label", *features).agg(F.count(F.lit(1)).cast("double").alias("pairs")), "counts")
    train, test = counts.filter("split = 'train'"), counts.filter("split = 'test'")
    hot = {f"{f}_{i}": (F.col(f) == i).cast("double") for f in features for i in range(4)}
    assemble = VectorAssembler(inputCols=list(hot), outputCol="features")
    fit, held = (assemble.transform(x.select("label", "pairs", *features, *[c.alias(n) for n, c in hot.items()])) for x in (train, test))
    # variances of weighted rows have another divisor than those of the pairs, and the penalty is in units of them
    n, squares = train.agg(F.sum("pairs"), F.sum(F.col("pairs") ** 2)).first()
    linear = LogisticRegression(labelCol="label", weightCol="pairs", maxIter=20, regParam=0.01 * (n - squares / n) / (n - 1)).fit(fit)
    # the fitted weights as one expression: the score stays in generated code
    z = sum((F.col(c) * float(w) for c, w in zip(hot, linear.coefficients)), F.lit(float(linear.intercept)))
    trees = GBTClassifier(labelCol="label", weightCol="pairs", maxIter=8, maxDepth=3, seed=7).fit(fit)
    weighed = linkage.score_pairs(held, features, linkage.fit_weights(train, features, "label", weight="pairs"), linkage.log_prior(train, "label", "pairs"))
    scored = [
        held.select("label", "pairs", F.lit("linear").alias("model"), (1 / (1 + F.exp(-z))).alias("s")),
        trees.transform(held).select("label", "pairs", F.lit("boosted").alias("model"), vector_to_array("probability")[1].alias("s")),
        weighed.select("label", "pairs", F.lit("weights").alias("model"), F.col("match_probability").alias("s")),
    ]
    return aggregates.auc_by(scored[0].unionByName(scored[1]).unionByName(scored[2]), ["model"], "s", "label", "pairs")


@R.query(f"""WITH {LAB}, c AS (SELECT 'dob' AS field, dob_1 AS l, dob_2 AS r FROM lab UNION ALL SELECT 'firstName', firstName_1, firstName_2 FROM lab), k AS (SELECT * FROM c WHERE l IS NOT NULL AND r IS NOT NULL),
             t AS (SELECT field, l FROM k WHERE l = r GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY field ORDER BY count(*) DESC, l) = 1)
             SELECT field, count(*) AS comparable, count(*) FILTER (k.l = k.r) AS agreeing, round(count(*) FILTER (k.l = k.r) / count(*), 6) AS rate, any_value(t.l) AS top_shared FROM k LEFT JOIN t USING (field) GROUP BY field""")
def field_agreement(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.field_agreement(labelled(spark, d), {"dob": ("dob_1", "dob_2"), "firstName": ("firstName_1", "firstName_2")})


@R.query(f"""WITH {LAB}, r AS (SELECT id_1 AS party_id, dob_1 AS dob FROM lab UNION SELECT id_2, dob_2 FROM lab) SELECT party_id, dob FROM r""")
def pairs_to_records(spark: SparkSession, d: str) -> DataFrame:
    """The distinct records of both sides of the labelled pairs."""
    wide = labelled(spark, d).select(F.col("id_1").alias("party_id_1"), "dob_1", F.col("id_2").alias("party_id_2"), "dob_2")
    return linkage.to_records(wide, ["party_id", "dob"])


@R.query()
def name_yardstick(spark: SparkSession, d: str) -> DataFrame:
    """Linked pairs by whether every part of one name has a like one in the other, and how the dates of birth relate.

    No SQL: the ratio is that of matching blocks.
    """
    full = lambda s: F.concat_ws(" ", *[F.trim(f"{c}_{s}") for c in ("firstName", "middleName", "lastName")])
    pairs = labelled(spark, d).filter("label = 1").select(full(1).alias("a"), full(2).alias("b"), linkage.date_relation(F.col("dob_1"), F.col("dob_2")).alias("dob"))
    named = linkage.with_name_match(pairs, "a", "b", 0.85)
    good = F.col("name_good") & F.col("dob").isin("exact", "digit_flip", "n/a")
    return named.groupBy("name_good", "dob", good.alias("good")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("name_score"), 4).alias("mean_score"))


# ---------------------------------------------------------------- graph

_CC = f"""{LINKS}, ends AS (SELECT pr1 AS a, pr2 AS b FROM links UNION SELECT pr2, pr1 FROM links),
    cc(id, component) USING KEY (id) AS (SELECT a, min(least(a, b)) FROM ends GROUP BY a
      UNION SELECT e.b, min(cc.component) FROM cc JOIN ends e ON cc.id = e.a JOIN recurring.cc r ON r.id = e.b WHERE cc.component < r.component GROUP BY e.b)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_list(links(spark, d), "pr1", "pr2")


@R.query(f"WITH RECURSIVE {_CC} SELECT id, component FROM cc")
def components_min_label(spark: SparkSession, d: str) -> DataFrame:
    return graph.components(_edges(spark, d), Stage(spark, "graph"))


_STATS = "count(*) AS clusters, CAST(sum(size) AS BIGINT) AS members, max(size) AS largest, round(avg(size), 6) AS mean_size, round(quantile_cont(size, 0.99), 6) AS p99_size, count(*) FILTER (size >= 30) AS giants"


@R.query(f"WITH RECURSIVE {_CC}, sizes AS (SELECT component, count(*) AS size FROM cc GROUP BY 1) SELECT {_STATS} FROM sizes")
def cluster_stats(spark: SparkSession, d: str) -> DataFrame:
    stage = Stage(spark, "stats")
    return graph.cluster_stats(stage.write(graph.components(_edges(spark, d), stage), "labels"))


@R.query(f"""WITH RECURSIVE {_CC}, member AS (SELECT DISTINCT party_id AS id, identity_id AS entity FROM mv_es_party_identity WHERE party_id IS NOT NULL AND identity_id IS NOT NULL),
    sizes AS (SELECT component, count(*) AS size FROM cc GROUP BY 1), inside AS (SELECT component, entity, count(*) AS held FROM cc JOIN member USING (id) GROUP BY ALL),
    top AS (SELECT * FROM inside QUALIFY row_number() OVER (PARTITION BY component ORDER BY held DESC, entity) = 1), total AS (SELECT entity, count(*) AS total FROM member GROUP BY 1),
    g AS (SELECT component, size, entity AS dominant, coalesce(held, 0) AS held, size - coalesce(held, 0) - (coalesce(total, 0) - coalesce(held, 0)) AS gain
          FROM sizes LEFT JOIN top USING (component) LEFT JOIN total USING (entity))
    SELECT *, CASE WHEN gain < -10 THEN 'large loss' WHEN gain < 0 THEN 'loss' WHEN gain <= 5 THEN 'small gain' WHEN gain <= 15 THEN 'gain' WHEN gain <= 30 THEN 'large gain' ELSE 'very large gain' END AS category FROM g""")
def net_gain(spark: SparkSession, d: str) -> DataFrame:
    stage = Stage(spark, "gain")
    return graph.net_gain(stage.write(graph.components(_edges(spark, d), stage), "labels"), load(spark, d, "mv_es_party_identity"), "party_id", "identity_id")


def _sweep_sql(thresholds: list[float]) -> str:
    parts, rows = [], []
    for i, t in enumerate(thresholds):
        parts.append(f"""e{i} AS (SELECT a, b FROM scored WHERE score >= {t} UNION SELECT b, a FROM scored WHERE score >= {t}),
            c{i}(id, component) USING KEY (id) AS (SELECT a, min(least(a, b)) FROM e{i} GROUP BY a
              UNION SELECT e.b, min(c.component) FROM c{i} c JOIN e{i} e ON c.id = e.a JOIN recurring.c{i} r ON r.id = e.b WHERE c.component < r.component GROUP BY e.b),
            z{i} AS (SELECT component, count(*) AS size FROM c{i} GROUP BY 1)""")
        rows.append(f"SELECT CAST({t} AS DOUBLE) AS threshold, {_STATS} FROM z{i}")
    return f"""WITH RECURSIVE scored AS (SELECT upper(trim(pr1)) AS a, upper(trim(pr2)) AS b, count(*) / 4.0 AS score FROM anm_training_data_matches
        WHERE label = 1 AND upper(trim(pr1)) <> upper(trim(pr2)) GROUP BY ALL), {", ".join(parts)} {" UNION ALL ".join(rows)}"""


@R.query(_sweep_sql([0.25, 0.5, 0.75]))
def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Component figures as weaker links (rarer pairs) are let in."""
    stage = Stage(spark, "sweep")
    df = load(spark, d, "anm_training_data_matches").filter("label = 1").groupBy(F.upper(F.trim("pr1")).alias("pr1"), F.upper(F.trim("pr2")).alias("pr2")).agg((F.count(F.lit(1)) / 4.0).alias("score"))
    return graph.threshold_sweep(stage.write(df, "scored"), "pr1", "pr2", "score", [0.25, 0.5, 0.75], stage)


QUERIES, SQL = R.QUERIES, R.SQL
