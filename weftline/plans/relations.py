"""Joins, pairs, set operations, linkage, graph, JSON, text functions, mapping and sources."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import expr
from weftline.operators import joins, linkage, mapping, schema, text, windows
from weftline.plans.linkages import LINKS, PERSON, links, person
from weftline.plans.problems import docs_sql, strict_sql
from weftline.plans.registry import Registry
from weftline.plans.reports import hash_sql
from weftline.runtime import Stage, load, spread
from weftline.sources import io

R = Registry()

# ---------------------------------------------------------------- joins


_AGREED = f"""{LINKS}, {PERSON}, j AS (SELECT l.pr1, l.pr2, CASE WHEN a.dob IS NULL OR b.dob IS NULL THEN NULL ELSE CAST(a.dob = b.dob AS INTEGER) END AS agree_dob,
    CASE WHEN a.ssn IS NULL OR b.ssn IS NULL THEN NULL ELSE CAST(a.ssn = b.ssn AS INTEGER) END AS agree_ssn, CASE WHEN a.cob IS NULL OR b.cob IS NULL THEN NULL ELSE CAST(a.cob = b.cob AS INTEGER) END AS agree_cob
    FROM links l LEFT JOIN person a ON l.pr1 = a.party_id LEFT JOIN person b ON l.pr2 = b.party_id)"""


def _agreed(spark: SparkSession, d: str) -> DataFrame:
    j = joins.two_sided(links(spark, d), person(spark, d).select("party_id", "dob", "ssn", "cob"), "party_id", "pr1", "pr2")
    return j.select("pr1", "pr2", *[expr.agree(F.col(f"{c}_l"), F.col(f"{c}_r")).alias(f"agree_{c}") for c in ("dob", "ssn", "cob")])


@R.query(f"WITH {_AGREED} SELECT * FROM j")
def two_sided_join_agree(spark: SparkSession, d: str) -> DataFrame:
    return _agreed(spark, d)


@R.query(f"WITH {_AGREED} SELECT round(avg(agree_dob), 6) AS dob, round(avg(agree_ssn), 6) AS ssn, round(avg(agree_cob), 6) AS cob, count(*) AS n FROM j")
def agreement_rates(spark: SparkSession, d: str) -> DataFrame:
    return _agreed(spark, d).agg(*[F.round(F.avg(f"agree_{c}"), 6).alias(c) for c in ("dob", "ssn", "cob")], F.count(F.lit(1)).alias("n"))


@R.query(f"""WITH {_AGREED}, p AS (SELECT concat_ws('+', CASE WHEN agree_dob = 1 THEN 'dob' END, CASE WHEN agree_ssn = 1 THEN 'ssn' END, CASE WHEN agree_cob = 1 THEN 'cob' END) AS s FROM j)
             SELECT CASE WHEN s = '' THEN 'none' ELSE s END AS pattern, count(*) AS n FROM p GROUP BY 1""")
def pattern_counts(spark: SparkSession, d: str) -> DataFrame:
    s = expr.pattern_string({c: F.col(f"agree_{c}") == 1 for c in ("dob", "ssn", "cob")})
    return _agreed(spark, d).groupBy(s.alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


@R.query(f"""WITH {_AGREED}, s AS (SELECT *, (coalesce(agree_dob, 0) + coalesce(agree_ssn, 0) + coalesce(agree_cob, 0)) / 3.0 AS score, coalesce(agree_dob, 0) + coalesce(agree_ssn, 0) + coalesce(agree_cob, 0) AS ev FROM j)
             SELECT CASE WHEN agree_dob = 0 AND agree_cob = 0 THEN 'review_conflict' WHEN agree_ssn = 1 AND score >= 0.6 THEN 'accept_strong' WHEN score >= 0.98 AND ev >= 2 THEN 'accept_score'
                    WHEN score >= 0.98 THEN 'review_thin' WHEN score >= 0.6 THEN 'review' ELSE 'reject' END AS decision, count(*) AS n FROM s GROUP BY 1""")
def tiered_decision(spark: SparkSession, d: str) -> DataFrame:
    ev = sum((F.coalesce(f"agree_{c}", F.lit(0)) for c in ("dob", "ssn", "cob")), F.lit(0))
    df = _agreed(spark, d).withColumn("ev", ev).withColumn("score", F.col("ev") / 3.0)
    conflict = (F.col("agree_dob") == 0) & (F.col("agree_cob") == 0)
    return df.groupBy(linkage.decide(F.col("agree_ssn"), F.col("score"), F.col("ev"), 0.98, 0.6, 2, conflict).alias("decision")).agg(F.count(F.lit(1)).alias("n"))


@R.query("SELECT c_custkey, c_name FROM customer SEMI JOIN orders ON c_custkey = o_custkey")
def semi_reduced_join(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").join(load(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@R.query("""WITH m AS (SELECT DISTINCT identity_id, party_id FROM mv_es_party_identity WHERE party_id IS NOT NULL), k AS (SELECT identity_id FROM m GROUP BY 1 HAVING count(*) BETWEEN 2 AND 10)
            SELECT identity_id, a.party_id AS id_1, b.party_id AS id_2 FROM m a JOIN m b USING (identity_id) SEMI JOIN k USING (identity_id) WHERE a.party_id < b.party_id""")
def within_group_pairs(spark: SparkSession, d: str) -> DataFrame:
    return joins.within_group_pairs(load(spark, d, "mv_es_party_identity").filter("party_id is not null"), "identity_id", "party_id")


@R.query("""WITH m AS (SELECT DISTINCT identity_id, party_id FROM mv_es_party_identity WHERE party_id IS NOT NULL AND identity_id IS NOT NULL), a AS (SELECT identity_id, min(party_id) AS anchor FROM m GROUP BY 1)
            SELECT identity_id, anchor, party_id AS member FROM m JOIN a USING (identity_id) WHERE party_id <> anchor""")
def star_pairs(spark: SparkSession, d: str) -> DataFrame:
    return joins.star_pairs(load(spark, d, "mv_es_party_identity").filter("party_id is not null"), "identity_id", "party_id")


_SAMPLED = f"(SELECT * FROM supplier ORDER BY {hash_sql('s_suppkey', 0)}, s_suppkey LIMIT 1000)"


@R.query(f"SELECT a.s_suppkey AS id_1, b.s_suppkey AS id_2 FROM {_SAMPLED} a JOIN {_SAMPLED} b ON a.s_suppkey < b.s_suppkey AND a.s_nationkey <> b.s_nationkey")
def theta_negatives(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of different groups within a sample of a thousand: the operator is one on samples, as its work is quadratic."""
    return joins.negatives(windows.random_sample(load(spark, d, "supplier"), "s_suppkey", 1000), "s_suppkey", "s_nationkey")


@R.query("""SELECT a.p_partkey AS id_1, b.p_partkey AS id_2, upper(substr(a.p_type, 1, 4)) || a.p_size AS block FROM part a JOIN part b
            ON upper(substr(a.p_type, 1, 4)) || a.p_size = upper(substr(b.p_type, 1, 4)) || b.p_size AND a.p_partkey < b.p_partkey AND a.p_brand <> b.p_brand""")
def blocked_negatives(spark: SparkSession, d: str) -> DataFrame:
    block = F.concat(F.upper(F.substring("p_type", 1, 4)), F.col("p_size").cast("string"))
    return joins.blocked_negatives(load(spark, d, "part"), "p_partkey", "p_brand", block)


@R.query("""WITH r AS (SELECT a.c_custkey AS id_1, b.c_custkey AS id_2, 'name' AS rule, 1 AS o FROM customer a JOIN customer b ON a.c_name = b.c_name AND a.c_custkey < b.c_custkey
            UNION ALL SELECT a.c_custkey, b.c_custkey, 'place', 2 FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND floor(a.c_acctbal / 100) = floor(b.c_acctbal / 100) AND a.c_custkey < b.c_custkey)
            SELECT id_1, id_2, string_agg(rule, '+' ORDER BY o) AS rules FROM r GROUP BY 1, 2""")
def multi_rule_blocking(spark: SparkSession, d: str) -> DataFrame:
    rules = {"name": [F.col("c_name")], "place": [F.col("c_nationkey"), F.col("c_mktsegment"), F.floor(F.col("c_acctbal") / 100)]}
    return joins.blocking_pairs(load(spark, d, "customer"), "c_custkey", rules)


_RULES = """rules AS (SELECT s_suppkey AS rule_id, CASE WHEN s_suppkey % 3 <> 0 THEN CAST(s_suppkey % 50 + 1 AS INTEGER) END AS r_size, CASE WHEN s_suppkey % 4 <> 0 THEN 'Brand#' || (s_suppkey % 5 + 1) || (s_suppkey % 4 + 1) END AS r_brand FROM supplier)"""


@R.query(f"""WITH {_RULES} SELECT p_partkey, arg_min(rule_id, ROW(-sc, rule_id)) AS rule_id, CAST(max(sc) AS INTEGER) AS match_score FROM (
             SELECT p_partkey, rule_id, CASE WHEN rule_id IS NULL THEN NULL ELSE CAST(r_size IS NOT NULL AS INTEGER) + CAST(r_brand IS NOT NULL AS INTEGER) END AS sc
             FROM part LEFT JOIN rules ON (r_size IS NULL OR r_size = p_size) AND (r_brand IS NULL OR r_brand = p_brand)) GROUP BY p_partkey""")
def best_match_lateral(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "supplier")
    rules = s.select(
        F.col("s_suppkey").alias("rule_id"),
        F.when(F.col("s_suppkey") % 3 != 0, (F.col("s_suppkey") % 50 + 1).cast("int")).alias("r_size"),
        F.when(F.col("s_suppkey") % 4 != 0, F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 5 + 1).cast("string"), (F.col("s_suppkey") % 4 + 1).cast("string"))).alias("r_brand"),
    )
    out = joins.best_match(load(spark, d, "part"), "p_partkey", rules, [("p_size", "r_size"), ("p_brand", "r_brand")], "rule_id")
    return out.select("p_partkey", "rule_id", "match_score")


@R.query("""WITH e AS (SELECT party_id, min(lastName) AS v FROM rpt_bronze_party WHERE load_id <= 3 GROUP BY 1), a AS (SELECT party_id, min(lastName) AS v FROM rpt_bronze_party WHERE load_id > 3 GROUP BY 1)
            SELECT party_id, e.v AS name_exp, a.v AS name_act, CASE WHEN a.party_id IS NULL THEN 'missing' WHEN e.party_id IS NULL THEN 'extra' WHEN e.v IS NOT DISTINCT FROM a.v THEN 'equal' ELSE 'differs' END AS status
            FROM e FULL JOIN a USING (party_id)""")
def full_outer_compare(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "rpt_bronze_party")
    side = lambda c: df.filter(c).groupBy("party_id").agg(F.min("lastName").alias("name"))
    return joins.compare_full(side("load_id <= 3"), side("load_id > 3"), ["party_id"], "name")


@R.query("SELECT party_id, arg_min(lastName, record_id) AS lastName FROM rpt_bronze_party WHERE party_id IS NOT NULL AND lastName IS NOT NULL GROUP BY 1")
def lookup_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return joins.lookup_first(load(spark, d, "rpt_bronze_party").filter("lastName is not null"), "party_id", "lastName", "record_id")


@R.query("""WITH t AS (SELECT TripRequestId, TripLegId, load_id, substr(lower(LevelOfService), 1, 3) AS v FROM tripmaster QUALIFY row_number() OVER (PARTITION BY TripRequestId, TripLegId, load_id ORDER BY row_id) = 1)
            SELECT a.TripRequestId, a.TripLegId, a.v = b.v AS same FROM t a JOIN t b ON a.TripRequestId = b.TripRequestId AND a.TripLegId = b.TripLegId AND b.load_id = a.load_id + 1""")
def composite_key_compare(spark: SparkSession, d: str) -> DataFrame:
    v = F.substring(F.lower("LevelOfService"), 1, 3)
    t = load(spark, d, "tripmaster").groupBy("TripRequestId", "TripLegId", "load_id").agg(F.min_by(v, "row_id").alias("v"))
    a, b = t.alias("a"), t.alias("b")
    on = (F.col("a.TripRequestId") == F.col("b.TripRequestId")) & (F.col("a.TripLegId") == F.col("b.TripLegId")) & (F.col("b.load_id") == F.col("a.load_id") + 1)
    return a.join(b, on).select("a.TripRequestId", "a.TripLegId", (F.col("a.v") == F.col("b.v")).alias("same"))


@R.query("""WITH p AS (SELECT least(upper(trim(pr1)), upper(trim(pr2))) AS lo, greatest(upper(trim(pr1)), upper(trim(pr2))) AS hi, label FROM anm_training_data_matches WHERE pr1 IS NOT NULL AND pr2 IS NOT NULL)
            SELECT lo, hi, count(*) AS n, max(label) AS best_label FROM p GROUP BY 1, 2""")
def order_free_pair_key(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "anm_training_data_matches").filter("pr1 is not null and pr2 is not null")
    k = joins.pair_key(F.upper(F.trim("pr1")), F.upper(F.trim("pr2")))
    return df.groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.max("label").alias("best_label")).select("k.lo", "k.hi", "n", "best_label")


@R.query("""WITH t AS (SELECT o_orderkey AS k, CAST(o_orderkey % 7 AS BIGINT) AS target FROM orders), r AS (SELECT l_orderkey AS k, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS i, count(*) OVER (PARTITION BY l_orderkey) AS m FROM lineitem),
            p AS (SELECT k, target, unnest(range(1, target + 1)) AS position FROM t WHERE target > 0)
            SELECT r.k AS l_orderkey, l_linenumber, position FROM p JOIN r ON p.k = r.k AND (position - 1) % m + 1 = i""")
def count_aligned(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderkey") % 7).alias("target"))
    rows = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber")
    return joins.count_aligned(rows, t, "l_orderkey", "l_linenumber", "target").select("l_orderkey", "l_linenumber", "position")


@R.query("""SELECT o_orderkey, o_totalprice FROM orders ANTI JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity >= 49) x ON o_orderkey = l_orderkey
            UNION ALL SELECT l_orderkey, sum(l_extendedprice) FROM lineitem WHERE l_quantity >= 49 GROUP BY 1""")
def replace_failed_keys(spark: SparkSession, d: str) -> DataFrame:
    new = load(spark, d, "lineitem").filter("l_quantity >= 49").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("o_totalprice"))
    return joins.replace_keys(load(spark, d, "orders").select("o_orderkey", "o_totalprice"), new, "o_orderkey")


@R.query("""WITH a AS (SELECT o_custkey, sum(o_totalprice) AS actual FROM orders WHERE date_trunc('year', o_orderdate) = DATE '1995-01-01' GROUP BY 1), e AS (SELECT o_custkey, avg(o_totalprice) AS expected FROM orders WHERE date_trunc('year', o_orderdate) = DATE '1994-01-01' GROUP BY 1)
            SELECT o_custkey, round(actual, 2) AS actual, round(expected, 2) AS expected FROM a JOIN e USING (o_custkey)""")
def period_bound_join(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "orders")
    year = F.year("o_orderdate")
    a = df.filter(year == 1995).groupBy("o_custkey").agg(F.sum("o_totalprice").alias("actual"))
    e = df.filter(year == 1994).groupBy("o_custkey").agg(F.avg("o_totalprice").alias("expected"))
    return a.join(e, "o_custkey").select("o_custkey", F.round("actual", 2).alias("actual"), F.round("expected", 2).alias("expected"))


#: A surname is common if it has at least one in so many of the records; so there are no more common ones than that.
COMMON_SHARE = 2000


@R.query()
def fuzzy_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Surnames against all common surnames."""
    names = load(spark, d, "rpt_bronze_party").select(F.upper(F.trim("lastName")).alias("name")).filter("length(name) > 2").groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    total = names.select(F.sum("n")).scalar()
    common = [r.name for r in names.filter(F.col("n") * COMMON_SHARE >= total).select("name").collect()]  # at most COMMON_SHARE rows
    asked = names.select("name").repartition(spark.sparkContext.defaultParallelism, "name")
    return text.fuzzy_best_of(asked, "name", common, 0.72).select("name", "best", F.round("ratio", 6).alias("ratio"))


# ---------------------------------------------------------------- sets


@R.query("""SELECT coalesce(a.k, b.k) AS party_id, CASE WHEN b.k IS NULL THEN 'only_a' WHEN a.k IS NULL THEN 'only_b' ELSE 'both' END AS side, coalesce(na, 0) AS n_a, coalesce(nb, 0) AS n_b
            FROM (SELECT party_id AS k, count(*) AS na FROM rpt_bronze_party GROUP BY 1) a FULL JOIN (SELECT party_id AS k, count(*) AS nb FROM mv_es_party_identity GROUP BY 1) b ON a.k IS NOT DISTINCT FROM b.k""")
def key_diff(spark: SparkSession, d: str) -> DataFrame:
    return joins.set_difference(load(spark, d, "rpt_bronze_party"), load(spark, d, "mv_es_party_identity"), ["party_id"])


@R.query("""WITH a AS (SELECT l_orderkey AS k, list(DISTINCT l_suppkey % 20) AS x FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1), b AS (SELECT l_orderkey AS k, list(DISTINCT l_suppkey % 20) AS y FROM lineitem WHERE l_linenumber > 2 GROUP BY 1)
            SELECT k AS l_orderkey, round(len(list_intersect(x, y)) * 1.0 / len(list_distinct(list_concat(x, y))), 6) AS overlap FROM a JOIN b USING (k)""")
def set_overlap(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem")
    side = lambda c, n: li.filter(c).groupBy("l_orderkey").agg(F.collect_set(F.col("l_suppkey") % 20).alias(n))
    return side("l_linenumber <= 3", "x").join(side("l_linenumber > 2", "y"), "l_orderkey").select("l_orderkey", F.round(joins.overlap(F.col("x"), F.col("y")), 6).alias("overlap"))


@R.query("""SELECT 'a' AS tag, o_orderkey AS k, o_totalprice AS v, NULL AS extra FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'b', l_orderkey, l_extendedprice, l_returnflag FROM lineitem WHERE l_quantity = 50""")
def union_by_name_tagged(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.lit("a").alias("tag"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    b = load(spark, d, "lineitem").filter("l_quantity = 50").select(F.lit("b").alias("tag"), F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("v"), F.col("l_returnflag").alias("extra"))
    return a.unionByName(b, allowMissingColumns=True)


@R.query("SELECT DISTINCT k FROM (SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def union_distinct(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select(F.col("o_custkey").alias("k")).union(load(spark, d, "customer").filter("c_acctbal < 0").select("c_custkey")).distinct()


# ---------------------------------------------------------------- ranked results

_RES = """res AS (SELECT o_custkey, list(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS ids, min(o_orderkey) AS expected FROM orders GROUP BY 1)"""


def _results(spark: SparkSession, d: str, k: int) -> DataFrame:
    """(o_custkey, ids, expected): the k dearest orders of each customer in order, and the one looked for."""
    orders = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    top = windows.top_n(orders, "o_custkey", [F.desc("o_totalprice"), F.col("o_orderkey")], k)
    # at most k rows per customer
    ids = top.groupBy("o_custkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "o_orderkey"))), lambda s: s["o_orderkey"]).alias("ids"))
    return orders.groupBy("o_custkey").agg(F.min("o_orderkey").alias("expected")).join(ids, "o_custkey")


@R.query(f"WITH {_RES} SELECT o_custkey, CAST(nullif(list_position(ids[1:10], expected), 0) AS BIGINT) AS rank FROM res")
def expected_rank(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d, 10).select("o_custkey", text.rank_of(F.col("expected"), F.col("ids")).alias("rank"))


@R.query(f"WITH {_RES}, r AS (SELECT nullif(list_position(ids[1:10], expected), 0) AS rank FROM res) SELECT count(*) AS n, count(rank) AS found, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS top1, round(avg(rank), 6) AS mean_rank FROM r")
def rank_summary(spark: SparkSession, d: str) -> DataFrame:
    r = _results(spark, d, 10).select(text.rank_of(F.col("expected"), F.col("ids")).alias("rank"))
    return r.agg(F.count(F.lit(1)).alias("n"), F.count("rank").alias("found"), F.round(F.avg(F.when(F.col("rank") == 1, 1.0).otherwise(0.0)), 6).alias("top1"), F.round(F.avg("rank"), 6).alias("mean_rank"))


@R.query(f"""WITH {_RES} SELECT CASE WHEN list_position(ids[1:3], expected) = 1 THEN 'rank_1' WHEN list_position(ids[1:3], expected) > 1 THEN 'lower_rank' WHEN list_has_any(ids[1:3], [expected + 1, expected - 1]) THEN 'other_id' ELSE 'absent' END AS reason, count(*) AS n FROM res GROUP BY 1""")
def miss_reasons(spark: SparkSession, d: str) -> DataFrame:
    reason = linkage.miss_reason(F.col("expected"), F.col("ids"), F.array(F.col("expected") + 1, F.col("expected") - 1))
    return _results(spark, d, 3).groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@R.query("""WITH p AS (SELECT o_custkey AS k, o_orderpriority AS path, max(o_orderkey) AS top FROM orders GROUP BY 1, 2)
            SELECT a.path AS path_a, b.path AS path_b, count(*) AS n, round(avg(CAST(a.top % 2 = b.top % 2 AS INTEGER)), 6) AS agreement FROM p a JOIN p b ON a.k = b.k AND a.path < b.path GROUP BY 1, 2""")
def path_agreement(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("path")).agg(F.max("o_orderkey").alias("top"))
    a, b = joins.suffixed(p, "_a", ["k"]), joins.suffixed(p, "_b", ["k"])
    same = (F.col("top_a") % 2 == F.col("top_b") % 2).cast("int")
    return a.join(b, "k").filter("path_a < path_b").groupBy("path_a", "path_b").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(same), 6).alias("agreement"))


@R.query("""SELECT c_custkey, CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN 10000 ELSE 0 END + CASE WHEN c_acctbal > 5000 THEN 1000 ELSE 0 END + CASE WHEN c_nationkey < 5 THEN 100 ELSE 0 END + least(c_custkey % 50, 99) AS BIGINT) AS score FROM customer ORDER BY score DESC, c_custkey LIMIT 40""")
def tiered_scores(spark: SparkSession, d: str) -> DataFrame:
    s = text.tiered_score([(F.col("c_mktsegment") == "BUILDING", 10000), (F.col("c_acctbal") > 5000, 1000), (F.col("c_nationkey") < 5, 100)], F.col("c_custkey") % 50)
    return load(spark, d, "customer").select("c_custkey", s.cast("long").alias("score")).orderBy(F.desc("score"), "c_custkey").limit(40)


# ---------------------------------------------------------------- dates

_DATE_REL = """CASE WHEN a.dob IS NULL OR b.dob IS NULL THEN 'n/a' WHEN a.dob = b.dob THEN 'exact' WHEN length(a.dob) = length(b.dob) AND hamming(CASE WHEN length(a.dob) = length(b.dob) THEN a.dob ELSE '' END, CASE WHEN length(a.dob) = length(b.dob) THEN b.dob ELSE '' END) = 1 THEN 'digit_flip'
    WHEN abs(date_diff('day', try_strptime(a.dob, '%Y-%m-%d'), try_strptime(b.dob, '%Y-%m-%d'))) <= 186 THEN 'near' ELSE 'differs' END"""


@R.query(f"""WITH {LINKS}, p AS (SELECT party_id, nullif(trim(min(dob)), '') AS dob FROM rpt_bronze_party GROUP BY 1)
             SELECT {_DATE_REL} AS relation, count(*) AS n FROM links l JOIN p a ON l.pr1 = a.party_id JOIN p b ON l.pr2 = b.party_id GROUP BY 1""")
def date_relations(spark: SparkSession, d: str) -> DataFrame:
    p = person(spark, d).select("party_id", "dob")
    j = links(spark, d).join(joins.suffixed(p, "_1"), F.col("pr1") == F.col("party_id_1")).join(joins.suffixed(p, "_2"), F.col("pr2") == F.col("party_id_2"))
    return j.groupBy(linkage.date_relation(F.col("dob_1"), F.col("dob_2")).alias("relation")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- JSON


@R.query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS doc_k FROM events")
def json_flatten(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "events").select("event_id", "props")
    return schema.flatten(schema.parse_json(df, "props", schema.infer_json_ddl(df, "props")).drop("props"))


_FLAT = {"partySource_partyId": "partySource.partyId", "partySource_system": "partySource.system", "birth_place_city": "birth.place.city", "birth_place_country": "birth.place.country", "matching_run": "matching.run", "recordStatus": "recordStatus"}


@R.query(f"""WITH ok AS (SELECT row_id, CASE WHEN {strict_sql("_source")} AND json_type(_source) = 'OBJECT' THEN _source END AS j FROM elasticdump_parties)
             SELECT row_id, {", ".join(f"json_extract_string(j, '$.{p}') AS doc_{c}" for c, p in _FLAT.items())} FROM ok""")
def json_flatten_nested(spark: SparkSession, d: str) -> DataFrame:
    """Party documents flattened by the schema of all of them; some of the columns that come out."""
    df = load(spark, d, "elasticdump_parties").select("row_id", "_source")
    flat = schema.flatten(schema.parse_json(df, "_source", schema.infer_json_ddl(df, "_source")).drop("_source"))
    return flat.select("row_id", *[F.col(f"doc_{c}").cast("string") if f"doc_{c}" in flat.columns else F.lit(None).cast("string").alias(f"doc_{c}") for c in _FLAT])


@R.query("SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.missing') AS missing FROM events")
def json_path(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.missing").alias("missing"))


@R.query(f"""WITH ok AS (SELECT row_id, CAST(_source AS JSON) AS j FROM elasticdump_parties WHERE {strict_sql("_source")} AND json_type(_source) = 'OBJECT'),
             c AS (SELECT row_id, json_extract_string(j, '$.matching.run') AS run, unnest(json_extract(j, '$.matching.candidates[*]')) AS x FROM ok WHERE json_type(j, '$.matching.candidates') = 'ARRAY')
             SELECT row_id, run AS doc_matching_run, json_extract_string(x, '$.candidatePartyId') AS doc_matching_candidates_candidatePartyId, TRY_CAST(json_extract_string(x, '$.score') AS DOUBLE) AS doc_matching_candidates_score
             FROM c WHERE TRY_CAST(json_extract_string(x, '$.score') AS DOUBLE) IS NOT NULL""")
def json_scores_exploded(spark: SparkSession, d: str) -> DataFrame:
    """One row per scored candidate: only the array that leads to a score is exploded."""
    df = load(spark, d, "elasticdump_parties").select("row_id", "_source")
    ddl = "STRUCT<matching: STRUCT<run: STRING, candidates: ARRAY<STRUCT<candidatePartyId: STRING, score: STRING>>>, names: ARRAY<STRUCT<firstName: STRING, lastName: STRING>>>"
    rows = schema.explode_for(schema.parse_json(df, "_source", ddl).drop("_source"), "score").drop("doc_names")
    return rows.withColumn("doc_matching_candidates_score", F.col("doc_matching_candidates_score").try_cast("double")).filter("doc_matching_candidates_score is not null")


@R.query(f"""WITH {docs_sql("tripmaster", "LosQuestions")},
    o AS (SELECT row_id, t.id, CAST(t.value AS JSON) AS v FROM docs, json_tree(j) t WHERE t.type = 'OBJECT'),
    q AS (SELECT row_id, id, CASE WHEN json_type(v, '$.questionText') = 'VARCHAR' THEN json_extract_string(v, '$.questionText') WHEN json_type(v, '$.q') = 'VARCHAR' THEN json_extract_string(v, '$.q') END AS question,
                 CASE WHEN json_exists(v, '$.answer') THEN json_extract(v, '$.answer') ELSE json_extract(v, '$.a') END AS a FROM o),
    k AS (SELECT *, coalesce(json_type(a), 'NULL') AS kind, first_value(coalesce(json_type(a), 'NULL')) OVER w AS first_kind, row_number() OVER w AS i FROM q WHERE question IS NOT NULL WINDOW w AS (PARTITION BY row_id, question ORDER BY id)),
    r AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY row_id, question ORDER BY CASE WHEN first_kind IN ('BOOLEAN', 'NULL') AND kind NOT IN ('BOOLEAN', 'NULL', 'OBJECT', 'ARRAY') THEN 0 ELSE 1 END, i) = 1),
    f AS (SELECT row_id, question, CASE WHEN kind = 'NULL' THEN NULL WHEN kind = 'VARCHAR' THEN json_extract_string(a, '$') ELSE CAST(a AS VARCHAR) END AS answer FROM r)
    SELECT row_id, question, answer, answer IS NOT NULL AND lower(trim(answer)) NOT IN ({", ".join(f"'{x}'" for x in sorted(text.EMPTY_ANSWERS))}) AS answered FROM f""")
def qa_recursive(spark: SparkSession, d: str) -> DataFrame:
    df = spread(load(spark, d, "tripmaster").select("row_id", "LosQuestions"), "row_id")
    qa = text.question_answers(df, "LosQuestions", ["questionText", "q"], ["answer", "a"])
    return qa.select("row_id", F.explode("qa").alias("x")).select("row_id", "x.*")


# ---------------------------------------------------------------- scalar functions


_CAP = lambda w: f"upper({w}[1]) || lower({w}[2:])"


@R.query(f"""WITH n AS (SELECT record_id, trim(regexp_replace(coalesce(CASE WHEN record_id % 2 = 0 THEN lastName || ', ' || firstName ELSE firstName || ' ' || lastName END, ''), '\\s+', ' ', 'g')) AS t FROM rpt_bronze_party),
            w AS (SELECT record_id, string_split(CASE WHEN contains(t, ',') THEN trim(concat_ws(' ', trim(string_split(t, ',')[-1]), trim(string_split(t, ',')[1]))) ELSE t END, ' ') AS w FROM n)
            SELECT record_id, {_CAP("w[1]")} AS first, CASE WHEN len(w) > 1 THEN {_CAP("w[-1]")} ELSE '' END AS last FROM w""")
def name_split(spark: SparkSession, d: str) -> DataFrame:
    full = F.when(F.col("record_id") % 2 == 0, F.concat("lastName", F.lit(", "), "firstName")).otherwise(F.concat("firstName", F.lit(" "), "lastName"))
    first, last = expr.split_name(full)
    return load(spark, d, "rpt_bronze_party").select("record_id", first.alias("first"), last.alias("last"))


@R.query("""SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN printf('%.2f', c_acctbal) ELSE printf('%.2f', c_acctbal) END AS amount FROM customer""")
def money_text(spark: SparkSession, d: str) -> DataFrame:
    b = F.col("c_acctbal")
    written = F.when(b < 0, F.concat(F.lit("($"), F.format_number(-b, 2), F.lit(")"))).otherwise(F.concat(F.lit("$ "), F.format_number(b, 2)))
    return load(spark, d, "customer").select("c_custkey", expr.money_text(written).alias("amount"))


@R.query("""SELECT p_partkey, CAST(CASE WHEN p_partkey % 4 = 0 THEN p_size WHEN p_partkey % 4 = 1 THEN floor(p_size / 12.0) WHEN p_partkey % 4 = 2 THEN floor(p_size / 365.0) ELSE 0 END AS INTEGER) AS age FROM part""")
def age_text(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 4
    t = F.when(k == 0, F.concat(n, F.lit(" y/o male"))).when(k == 1, F.concat(F.lit("age "), n, F.lit(" months"))).when(k == 2, F.concat(n, F.lit(" days"))).otherwise(F.lit("Newborn"))
    return load(spark, d, "part").select("p_partkey", expr.age_years(t).alias("age"))


_LAYOUTS = {"\\d{4}-\\d{2}-\\d{2}": "%Y-%m-%d", "\\d{2}/\\d{2}/\\d{4}": "%m/%d/%Y", "\\d{8}": "%Y%m%d", "\\d{2}-(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)-\\d{4}": "%d-%b-%Y"}


@R.query("SELECT record_id, coalesce(strftime(CASE " + " ".join(f"WHEN regexp_full_match(trim(dob), '{p}') THEN try_strptime(trim(dob), '{f}')" for p, f in _LAYOUTS.items()) + " END, '%m/%d/%Y'), '') AS dob_text FROM rpt_bronze_party")
def lenient_dates(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "rpt_bronze_party").select("record_id", expr.us_date_text(F.col("dob")).alias("dob_text"))


@R.query("""SELECT record_id, regexp_replace(ssn, '\\d', '*', 'g') AS hidden,
            array_to_string(list_transform(range(1, length(ssn) + 1), lambda i: CASE WHEN regexp_matches(ssn[i], '\\d') AND length(regexp_replace(ssn[i + 1:], '\\D', '', 'g')) >= 4 THEN '*' ELSE ssn[i] END), '') AS masked FROM rpt_bronze_party""")
def mask_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Every digit hidden, and all but the last four."""
    return load(spark, d, "rpt_bronze_party").select("record_id", expr.mask_digits(F.col("ssn"), 0).alias("hidden"), expr.mask_digits(F.col("ssn")).alias("masked"))


@R.query("""SELECT record_id, regexp_replace(concat_ws(' ', firstName, middleName, lastName), '(\\p{L})\\p{L}+', '\\1.', 'g') AS masked FROM rpt_bronze_party""")
def mask_names(spark: SparkSession, d: str) -> DataFrame:
    """Names as initials."""
    return load(spark, d, "rpt_bronze_party").select("record_id", expr.mask_name(F.concat_ws(" ", "firstName", "middleName", "lastName")).alias("masked"))


@R.query("SELECT row_id, round((epoch_us(load_ts) - epoch_us(RequestDateTime)) / 6e7, 4) AS minutes FROM tripmaster")
def elapsed_between(spark: SparkSession, d: str) -> DataFrame:
    """Minutes from the request to its load."""
    at = lambda c: F.col(c).cast("timestamp")
    return load(spark, d, "tripmaster").select("row_id", F.round(expr.minutes_between(at("RequestDateTime"), at("load_ts")), 4).alias("minutes"))


@R.query("""SELECT lastName AS name, regexp_replace(regexp_replace(regexp_replace(strip_accents(lastName), '[A-Z]+', 'A', 'g'), '[a-z]+', 'a', 'g'), '[0-9]+', '9', 'g') AS shape, count(*) AS n FROM rpt_bronze_party GROUP BY 1, 2""")
def name_shapes(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "rpt_bronze_party")
    return df.groupBy(F.col("lastName").alias("name"), expr.token_shape(expr.strip_accents(F.col("lastName"))).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


@R.query("SELECT p_partkey, CASE WHEN p_brand LIKE 'Brand#1%' AND p_brand LIKE 'Brand#11%' THEN 'eleven' WHEN p_brand LIKE 'Brand#1%' THEN 'one' WHEN p_brand LIKE 'Brand#%' THEN 'brand' END AS carrier FROM part")
def longest_prefix(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select("p_partkey", expr.longest_prefix(F.col("p_brand"), {"Brand#": "brand", "Brand#1": "one", "Brand#11": "eleven"}).alias("carrier"))


@R.query("SELECT row_id, concat_ws('', CASE WHEN trim(ClinicalData) <> '' THEN 'C' END, CASE WHEN trim(SpecialNeeds) <> '' THEN 'S' END, CASE WHEN trim(LosQuestions) <> '' THEN 'Q' END) AS code FROM tripmaster")
def presence_codes(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "tripmaster").select("row_id", expr.presence_code({"C": F.col("ClinicalData"), "S": F.col("SpecialNeeds"), "Q": F.col("LosQuestions")}).alias("code"))


@R.query("SELECT c_custkey, replace(replace('Dear {name}, segment {segment}', '{name}', c_name), '{segment}', c_mktsegment) AS letter FROM customer")
def template_fill(spark: SparkSession, d: str) -> DataFrame:
    tokens = F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"))
    return load(spark, d, "customer").select("c_custkey", expr.fill_template(F.lit("Dear {name}, segment {segment}"), tokens).alias("letter"))


@R.query("SELECT row_id, regexp_replace(ClinicalData, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]', '', 'g') AS ClinicalData FROM tripmaster")
def control_sanitized(spark: SparkSession, d: str) -> DataFrame:
    return io.sanitized(load(spark, d, "tripmaster").select("row_id", "ClinicalData"))


@R.query("SELECT substr(md5(concat_ws(',', o_orderstatus, o_orderpriority)), 1, 12) AS signature, count(*) AS n FROM orders GROUP BY 1")
def hash_signature(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").groupBy(F.substring(F.md5(F.concat_ws(",", "o_orderstatus", "o_orderpriority")), 1, 12).alias("signature")).agg(F.count(F.lit(1)).alias("n"))


@R.query("""SELECT row_id, lower(trim(FacilityType)) AS kind, CASE WHEN ContractId IN (4100, 4121) AND lower(coalesce(RequesterFacility, '')) LIKE '%hospice%' THEN 1 ELSE 0 END AS in_scope FROM tripmaster WHERE NOT regexp_matches(coalesce(RequestType, ''), '^Will')""")
def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "tripmaster").filter(~F.coalesce("RequestType", F.lit("")).rlike("^Will"))
    scope = F.col("ContractId").isin(4100, 4121) & F.lower(F.coalesce("RequesterFacility", F.lit(""))).contains("hospice")
    return df.select("row_id", F.lower(F.trim("FacilityType")).alias("kind"), F.when(scope, 1).otherwise(0).alias("in_scope"))


@R.query("SELECT record_id, concat_ws(',', CASE WHEN coalesce(trim(firstName), '') = '' THEN 'firstName' END, CASE WHEN coalesce(trim(dob), '') = '' THEN 'dob' END, CASE WHEN coalesce(trim(ssn), '') = '' THEN 'ssn' END) AS problem FROM rpt_bronze_party")
def quarantine(spark: SparkSession, d: str) -> DataFrame:
    return mapping.quarantine(load(spark, d, "rpt_bronze_party"), ["firstName", "dob", "ssn"]).select("record_id", "problem")


# ---------------------------------------------------------------- mapping and enrichment


@R.query("""SELECT CAST(c_custkey AS VARCHAR) AS id, 'P' AS kind, c_mktsegment AS segment, printf('%.2f', c_acctbal) AS balance, '' AS note, '' AS gone FROM customer""")
def column_rules(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "customer").withColumn("bal", F.format_string("%.2f", "c_acctbal"))
    return mapping.column_rules(df, {"id": ("copy", "c_custkey"), "kind": ("const", "P"), "segment": ("copy", "c_mktsegment"), "balance": ("money", "bal"), "note": ("blank", None), "gone": ("copy", "no_such_column")})


@R.query("""SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y') AS paid, strftime(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH, '%m/%d/%Y') AS due FROM orders""")
def column_rule_dates(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    rules = mapping.column_rules(df, {"o_orderkey": ("copy", "o_orderkey"), "paid": ("date_mmddyyyy", "day"), "due": ("date_plus_1m_mmddyyyy", "day")})
    return rules.withColumn("o_orderkey", F.col("o_orderkey").cast("long"))


@R.query("""SELECT p_partkey, CASE WHEN p_type = 'ECONOMY ANODIZED TIN' THEN 'a' WHEN p_type LIKE '%STEEL%' THEN 'steel' WHEN p_type LIKE '%TIN%' THEN 'tin' END AS target,
            CASE WHEN p_type = 'ECONOMY ANODIZED TIN' THEN 'exact' WHEN p_type LIKE '%STEEL%' OR p_type LIKE '%TIN%' THEN 'keyword' END AS matched_by FROM part""")
def lookup_precedence(spark: SparkSession, d: str) -> DataFrame:
    table = spark.createDataFrame([("economy anodized tin", "a"), ("steel", "steel"), ("tin", "tin"), ("9z", "code")], "key string, target string")
    return mapping.lookup_precedence(load(spark, d, "part"), "p_type", r"\((\w+)\)", table).select("p_partkey", "target", "matched_by")


@R.query("SELECT o_orderkey, o_totalprice * 0.5 AS net, o_orderstatus || '-' || substr(o_orderpriority, 1, 1) AS code FROM orders")
def pandas_udf_struct(spark: SparkSession, d: str) -> DataFrame:
    @F.pandas_udf("net double, code string")
    def price(p: pd.Series, s: pd.Series, o: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"net": p * 0.5, "code": s + "-" + o.str[:1]})

    r = load(spark, d, "orders").select("o_orderkey", price.asNondeterministic()("o_totalprice", "o_orderstatus", "o_orderpriority").alias("r"))
    return r.select("o_orderkey", "r.net", "r.code")


@R.query("SELECT p_partkey, CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_size * 2 END AS answer, CASE WHEN p_size % 10 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN p_size % 10 = 0 THEN 2 ELSE 1 END AS attempts FROM part")
def enrichment(spark: SparkSession, d: str) -> DataFrame:
    """A call per row through the injected-callable operator, here a local stand-in that fails on some rows."""

    def call(row: dict) -> dict:
        if row["p_size"] % 10 == 0:
            raise ValueError("refused")
        return {"answer": int(row["p_size"]) * 2}

    return mapping.enrich(spread(load(spark, d, "part").select("p_partkey", "p_size"), "p_partkey"), ["p_size"], call, "answer int", retries=2).select("p_partkey", "answer", "status", "attempts")


# ---------------------------------------------------------------- sources and sinks


@R.query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, c_mktsegment FROM customer")
def csv_all_string(spark: SparkSession, d: str) -> DataFrame:
    path = f"{Stage(spark, 'csv').path}/customer"
    load(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment").write.csv(path, header=True)
    return io.read_text_csv(spark, path)


@R.query("SELECT n_nationkey, CAST(c AS INTEGER) AS copy FROM nation, range(3) r(c)")
def row_replication(spark: SparkSession, d: str) -> DataFrame:
    return io.replicate(load(spark, d, "nation").select("n_nationkey"), 3)


@R.query("SELECT i AS id, CASE (i * 7919 + 104729) % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS kind FROM range(1000) r(i)")
def synthetic_pool(spark: SparkSession, d: str) -> DataFrame:
    return io.synthetic(spark, 1000, 1, {"kind": ["a", "b", "c"]})


@R.query("""SELECT o_orderstatus, '{"load_id":"' || o_orderstatus || '","results":[' || string_agg('{"o_orderpriority":"' || o_orderpriority || '","n":' || n || '}', ',' ORDER BY o_orderpriority) || ']}' AS payload
            FROM (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1""")
def json_envelope(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return io.json_envelope(n, "o_orderstatus", ["o_orderpriority", "n"])


@R.query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def resume_by_key(spark: SparkSession, d: str) -> DataFrame:
    """One key is done first, the run then resumes with the rest, and both are read together."""
    path = f"{Stage(spark, 'resume').path}/done"
    work = load(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    io.checkpoint_keys(work.filter("o_orderstatus = 'F'"), path, "o_orderstatus")
    io.checkpoint_keys(io.resume(work, path, "o_orderstatus"), path, "o_orderstatus")
    return spark.read.schema("n long, o_orderstatus string").parquet(path).select("o_orderstatus", "n")


QUERIES, SQL = R.QUERIES, R.SQL
