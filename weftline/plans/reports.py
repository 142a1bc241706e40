"""Profiles, shares, crosstabs, percentiles, KPI blocks, metrics, time series and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import expr
from weftline.operators import aggregates, joins, windows
from weftline.plans.registry import Registry
from weftline.runtime import load

R = Registry()


@R.query("""SELECT 'text' AS "column", count(*) AS n, count(*) FILTER (trim(text) <> '') AS filled, round(count(*) FILTER (trim(text) <> '') / count(*), 6) AS fill_rate FROM documents
            UNION ALL SELECT 'lang', count(*), count(*) FILTER (trim(lang) <> ''), round(count(*) FILTER (trim(lang) <> '') / count(*), 6) FROM documents
            UNION ALL SELECT 'source', count(*), count(*) FILTER (trim(source) <> ''), round(count(*) FILTER (trim(source) <> '') / count(*), 6) FROM documents
            UNION ALL SELECT 'created_at', count(*), count(created_at), round(count(created_at) / count(*), 6) FROM documents""")
def fill_rate_profile(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.fill_rates(load(spark, d, "documents"), ["text", "lang", "source", "created_at"])


@R.query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) AS n, count(*) FILTER ({c} IS NULL) AS nulls, count(DISTINCT {c}) AS "distinct" FROM customer""" for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")))
def column_profile(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.column_profile(load(spark, d, "customer"), ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])


@R.query()
def column_profile_approx(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.column_profile(load(spark, d, "customer"), ["c_custkey", "c_name", "c_nationkey"], approximate=True)


@R.query("""SELECT CASE WHEN o_totalprice >= 300000 THEN '1_high' WHEN o_totalprice >= 150000 THEN '2_mid' WHEN o_totalprice >= 50000 THEN '3_low' ELSE '4_rest' END AS band,
            count(*) AS n FROM orders GROUP BY 1""")
def price_band(spark: SparkSession, d: str) -> DataFrame:
    b = expr.band(F.col("o_totalprice"), [(300000, "1_high"), (150000, "2_mid"), (50000, "3_low")], "4_rest")
    return load(spark, d, "orders").groupBy(b.alias("band")).agg(F.count(F.lit(1)).alias("n"))


@R.query("""SELECT source_system, count(*) AS n, count(*) FILTER (upper(trim(middleName)) NOT IN ('NMN', 'N/A', 'NONE') AND trim(middleName) <> '') AS kept,
            count(middleName) AS present FROM rpt_bronze_party GROUP BY 1""")
def sentinel_null_rate(spark: SparkSession, d: str) -> DataFrame:
    kept = expr.null_if_sentinel(F.col("middleName"), ["NMN", "N/A", "NONE"])
    return load(spark, d, "rpt_bronze_party").groupBy("source_system").agg(F.count(F.lit(1)).alias("n"), F.count(kept).alias("kept"), F.count("middleName").alias("present"))


@R.query("""SELECT coalesce(seg, 'OVERALL') AS c_mktsegment, n, revenue, share_open FROM (
            SELECT c_mktsegment AS seg, count(*) AS n, round(sum(o_totalprice), 2) AS revenue, round(avg(CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END), 6) AS share_open
            FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY ROLLUP (c_mktsegment))""")
def kpi_by_segment_with_total(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "orders").join(load(spark, d, "customer").select("c_custkey", "c_mktsegment"), F.col("c_custkey") == F.col("o_custkey"))
    return aggregates.with_total(df, "c_mktsegment", [F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.round(F.avg(F.when(F.col("o_orderstatus") == "O", 1.0).otherwise(0.0)), 6).alias("share_open")])


@R.query("""SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'Total' ELSE o_orderpriority END AS o_orderpriority,
            CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS "F", CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS "O",
            CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS BIGINT) AS "P", count(*) AS "Total" FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def pivot_status_priority(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.crosstab_margins(load(spark, d, "orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"])


@R.query("""WITH c AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2)
            SELECT l_returnflag, l_linestatus, n, round(n / sum(n) OVER (PARTITION BY l_returnflag), 6) AS share FROM c""")
def percent_of_row(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.share_within(load(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@R.query("""SELECT event_type, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1""")
def percentile_linear(spark: SparkSession, d: str) -> DataFrame:
    q = aggregates.quantiles(load(spark, d, "events"), ["event_type"], "value", {"median": 0.5, "p95": 0.95, "p99": 0.99})
    return q.select("event_type", *[F.round(c, 6).alias(c) for c in ("median", "p95", "p99")])


@R.query("""WITH s AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
            SELECT event_type, max(CASE WHEN r = least(n, greatest(1, CAST(round_even(0.5 * n + 0.5, 0) AS BIGINT))) THEN value END) AS p50,
                   max(CASE WHEN r = least(n, greatest(1, CAST(round_even(0.95 * n + 0.5, 0) AS BIGINT))) THEN value END) AS p95 FROM s GROUP BY 1""")
def percentile_nearest(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.nearest_rank(load(spark, d, "events"), ["event_type"], "value", [50, 95])


@R.query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def percentile_approx(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles from a bounded summary. They are values of the data, off by at most a ten-thousandth of the rank: in groups of
    fewer rows than that the SQL's exact ones."""
    p = F.percentile_approx("value", [0.5, 0.95], 10_000)
    return load(spark, d, "events").groupBy("event_type").agg(p.alias("p")).select("event_type", F.get("p", F.lit(0)).alias("p50"), F.get("p", F.lit(1)).alias("p95"))


@R.query("""SELECT user_id, arg_min(event_type, ROW(ts, event_id)) AS first_type, max(value) AS top_value, max(ts) AS last_seen, bool_or(event_type = 'purchase') AS bought FROM events GROUP BY 1""")
def entity_rollup_first_max(spark: SparkSession, d: str) -> DataFrame:
    at = F.when(F.col("event_type").isNotNull(), F.struct("ts", "event_id"))
    return load(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", at).alias("first_type"), F.max("value").alias("top_value"), F.max("ts").alias("last_seen"), F.bool_or(F.col("event_type") == "purchase").alias("bought"))


@R.query("""WITH t AS (SELECT l_orderkey, sum(l_extendedprice) AS total FROM lineitem GROUP BY 1)
            SELECT l_orderkey, l_linenumber, round_even(total, 2) AS group_total, round_even(greatest(total, 50000), 2) AS expected, round_even(l_extendedprice - greatest(total, 50000), 2) AS variance
            FROM lineitem JOIN t USING (l_orderkey) WHERE l_linenumber = 1""")
def prorated_charge_variance(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return aggregates.anchored_totals(df, ["l_orderkey"], "l_extendedprice", F.col("l_linenumber") == 1, 50000.0).drop("l_extendedprice")


@R.query("""WITH x AS (SELECT l_discount * 10 + l_tax AS score, CAST(l_returnflag = 'R' AS INTEGER) AS label FROM lineitem),
            t AS (SELECT unnest([0.1, 0.3, 0.5, 0.7, 0.9]) AS threshold),
            c AS (SELECT CAST(threshold AS DOUBLE) AS threshold, count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label = 0) AS fp,
                  count(*) FILTER (score < threshold AND label = 1) AS fn FROM x, t GROUP BY 1)
            SELECT threshold, tp, fp, fn, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def threshold_metrics(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "lineitem").select((F.col("l_discount") * 10 + F.col("l_tax")).alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return aggregates.threshold_metrics(df, "score", "label", [0.1, 0.3, 0.5, 0.7, 0.9])


@R.query("""WITH c AS (SELECT CAST(l_quantity AS INTEGER) AS s, count(*) FILTER (l_returnflag = 'R') AS p, count(*) FILTER (l_returnflag <> 'R') AS q FROM lineitem GROUP BY 1),
            r AS (SELECT *, sum(p) OVER (ORDER BY s DESC) AS pu, sum(q) OVER (ORDER BY s DESC) AS qu FROM c)
            SELECT CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(q) AS BIGINT) AS n_neg, round(sum(q * (pu - p / 2.0)) / (CAST(sum(p) AS DOUBLE) * sum(q)), 6) AS auc,
                   round(sum(CAST(p AS DOUBLE) * pu / (pu + qu)) / sum(p), 6) AS ap FROM r""")
def auc_ap(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "lineitem").select(F.col("l_quantity").cast("int").alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    return aggregates.auc_ap(df, "score", "label")


@R.query("""WITH c AS (SELECT c_mktsegment, count(*) AS n, count(*) FILTER (c_acctbal > 0) AS k FROM customer GROUP BY 1)
            SELECT c_mktsegment, n, k, round((k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS lo,
            round((k / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS hi FROM c""")
def wilson_ci(spark: SparkSession, d: str) -> DataFrame:
    c = load(spark, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("k"))
    lo, hi = expr.wilson(F.col("k"), F.col("n"))
    return c.select("c_mktsegment", "n", "k", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@R.query("""WITH g AS (SELECT i / 20.0 AS t FROM range(1, 20) r(i)), x AS (SELECT l_discount * 10 AS s, l_returnflag = 'R' AS y FROM lineitem),
            f AS (SELECT t, 2.0 * count(*) FILTER (s >= t AND y) / (2 * count(*) FILTER (s >= t AND y) + count(*) FILTER (s >= t AND NOT y) + count(*) FILTER (s < t AND y)) AS f1 FROM x, g GROUP BY 1)
            SELECT CAST(t AS DOUBLE) AS best_threshold, round(f1, 6) AS best_f1 FROM f ORDER BY round(f1, 6) DESC, t LIMIT 1""")
def best_f1_threshold(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("score"), (F.col("l_returnflag") == "R").cast("int").alias("label"))
    m = aggregates.threshold_metrics(df, "score", "label", [i / 20.0 for i in range(1, 20)])
    return m.agg(F.max(F.struct("f1", (-F.col("threshold")).alias("t"))).alias("m")).select((-F.col("m.t")).alias("best_threshold"), F.col("m.f1").alias("best_f1"))


@R.query("""SELECT o_custkey, o_orderkey, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE)) AS INTEGER) AS wave FROM orders""")
def wave_rank(spark: SparkSession, d: str) -> DataFrame:
    return windows.dense_ranks(load(spark, d, "orders"), "o_custkey", F.to_date("o_orderdate")).select("o_custkey", "o_orderkey", "wave")


@R.query("""WITH f AS (SELECT o_custkey, arg_min(o_totalprice, ROW(o_orderdate, o_orderkey)) AS first_value, arg_max(o_totalprice, ROW(o_orderdate, o_orderkey)) AS last_value FROM orders GROUP BY 1)
            SELECT *, round((last_value - first_value) / nullif(first_value, 0) * 100, 4) AS pct_change FROM f""")
def first_last_pct_drop(spark: SparkSession, d: str) -> DataFrame:
    return windows.first_last_change(load(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "o_totalprice")


@R.query("""WITH w AS (SELECT o_custkey, o_totalprice, dense_rank() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE)) AS wave FROM orders)
            SELECT o_custkey, max(CASE WHEN wave = 1 THEN o_totalprice END) AS wave_1, max(CASE WHEN wave = 2 THEN o_totalprice END) AS wave_2, max(CASE WHEN wave = 3 THEN o_totalprice END) AS wave_3 FROM w GROUP BY 1""")
def wave_pivot(spark: SparkSession, d: str) -> DataFrame:
    df = windows.dense_ranks(load(spark, d, "orders"), "o_custkey", F.to_date("o_orderdate"))
    return df.groupBy("o_custkey").agg(*[F.max(F.when(F.col("wave") == i, F.col("o_totalprice"))).alias(f"wave_{i}") for i in (1, 2, 3)])


@R.query("""SELECT lang, doc_id, n_chars, CAST(r AS INTEGER) AS rank FROM (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 5""")
def top_n_per_group(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "documents").select("lang", "doc_id", "n_chars")
    return windows.top_n(df, "lang", [F.desc("n_chars"), F.col("doc_id")], 5).select("lang", "doc_id", "n_chars", "rank")


@R.query("""SELECT TripLegId, row_id, load_id, RequestDateTime FROM tripmaster QUALIFY row_number() OVER (PARTITION BY TripLegId ORDER BY RequestDateTime NULLS LAST, row_id) = 1""")
def keep_first(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "tripmaster").select("TripLegId", "row_id", "load_id", "RequestDateTime")
    return windows.keep_first(df, ["TripLegId"], ["RequestDateTime", "row_id"])


@R.query("""WITH p AS (SELECT o_custkey, o_orderkey, CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 9 END AS pr FROM orders)
            SELECT o_custkey, o_orderkey, pr AS priority FROM p WHERE pr < 9 QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY pr, o_orderkey) <= 3""")
def stable_priority_top(spark: SparkSession, d: str) -> DataFrame:
    pr = expr.first_match([(F.col("o_orderstatus") == "P", 0), (F.col("o_orderstatus") == "O", 1)], 9)
    df = load(spark, d, "orders").select("o_custkey", "o_orderkey", pr.alias("priority")).filter("priority < 9")
    return windows.top_n(df, "o_custkey", [F.col("priority"), F.col("o_orderkey")], 3).drop("rank")


def hash_sql(key: str, seed: int) -> str:
    return f"((({key} % 1000003) * 7919 + {seed * 104729 + 12345}) % 1000003 * 6007 + 31) % 1000003"


@R.query(f"SELECT o_orderkey FROM orders WHERE {hash_sql('o_orderkey', 3)} < {int(0.1 * 1_000_003)}")
def portable_hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return windows.hash_sample(load(spark, d, "orders"), "o_orderkey", 0.1, 3).select("o_orderkey")


@R.query(f"""WITH r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {hash_sql('o_orderkey', 0)}, o_orderkey) AS r,
             count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
             SELECT o_orderkey, o_orderstatus, CASE WHEN r <= floor(n * 0.75) THEN 'train' ELSE 'test' END AS split FROM r""")
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    return windows.stratified_split(load(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus", 0.75)


@R.query(f"""SELECT o_orderkey, o_orderpriority FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY {hash_sql('o_orderkey', 5)}, o_orderkey) <= 20""")
def stratified_sample_exact(spark: SparkSession, d: str) -> DataFrame:
    return windows.stratified_sample(load(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", "o_orderpriority", 20, 5)


@R.query()
def native_sample(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").sample(0.1, 42).union(load(spark, d, "orders").sampleBy("o_orderstatus", {"P": 0.5}, 42))


@R.query("""WITH c AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period, count(*) AS n FROM orders GROUP BY 1),
            m AS (SELECT CAST(unnest(generate_series((SELECT min(period) FROM c)::TIMESTAMP, (SELECT max(period) FROM c)::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS period)
            SELECT period, coalesce(n, 0) AS n FROM m LEFT JOIN c USING (period)""")
def monthly_zero_filled(spark: SparkSession, d: str) -> DataFrame:
    return windows.monthly(load(spark, d, "orders"), "o_orderdate")


@R.query("""WITH c AS (SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2)
            SELECT quarter, o_orderstatus, n, round(n / sum(n) OVER (PARTITION BY quarter), 6) AS share FROM c""")
def quarterly_mix(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.share_within(load(spark, d, "orders").withColumn("quarter", F.date_trunc("quarter", "o_orderdate").cast("date")), "quarter", "o_orderstatus")


@R.query("SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter, round(median(o_totalprice), 6) AS median_price FROM orders GROUP BY 1")
def quarterly_median(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "orders").select(F.date_trunc("quarter", "o_orderdate").cast("date").alias("quarter"), "o_totalprice")
    return aggregates.quantiles(df, ["quarter"], "o_totalprice", {"m": 0.5}).select("quarter", F.round("m", 6).alias("median_price"))


@R.query("""SELECT o_orderpriority, count(*) AS n, count(DISTINCT date_trunc('month', o_orderdate)) AS months, round(count(*) * 12.0 / count(DISTINCT date_trunc('month', o_orderdate)), 4) AS per_year FROM orders GROUP BY 1""")
def annualized(spark: SparkSession, d: str) -> DataFrame:
    return windows.annualized(load(spark, d, "orders"), "o_orderpriority", "o_orderdate")


@R.query("""WITH k AS (SELECT l AS o_orderstatus, CAST(m AS INTEGER) AS month FROM (SELECT unnest(['F', 'O', 'P', 'X']) AS l), range(1, 13) r(m))
            SELECT o_orderstatus, month, coalesce(n, 0) AS n FROM k LEFT JOIN (SELECT o_orderstatus, CAST(month(o_orderdate) AS INTEGER) AS month, count(*) AS n FROM orders GROUP BY 1, 2) USING (o_orderstatus, month)""")
def reindexed_months(spark: SparkSession, d: str) -> DataFrame:
    return windows.reindexed(load(spark, d, "orders").select("o_orderstatus", F.month("o_orderdate").alias("month")), "o_orderstatus", "month", ["F", "O", "P", "X"], list(range(1, 13)))


@R.query("""WITH a AS (SELECT (SELECT min(ts) FROM events) AS t0), b AS (SELECT event_type, CAST(floor((epoch_us(ts) - epoch_us(t0)) / 21600e6) AS BIGINT) AS slot, value FROM events, a)
            SELECT event_type, slot, count(*) AS n, round(avg(value), 6) AS mean FROM b GROUP BY 1, 2""")
def fixed_windows(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "events")
    start = df.select(F.min("ts")).scalar()
    slot = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(21600e6)).alias("slot")
    return df.select("event_type", slot, "value").groupBy("event_type", "slot").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))


_SLOTS = """a AS (SELECT (SELECT min(ts) FROM events) AS t0), b AS (SELECT event_type, CAST(floor((epoch_us(ts) - epoch_us(t0)) / 86400e6) AS BIGINT) AS slot, avg(value) AS mean, count(*) AS n FROM events, a GROUP BY 1, 2),
            o AS (SELECT event_type, avg(value) AS overall FROM events GROUP BY 1), s AS (SELECT b.event_type, slot, n, mean <= overall * 1.02 AS ok FROM b JOIN o USING (event_type))"""


def _daily(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "events")
    start = df.select(F.min("ts")).scalar()
    slot = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / F.lit(86400e6)).alias("slot")
    daily = df.select("event_type", slot, "value").groupBy("event_type", "slot").agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))
    overall = df.groupBy("event_type").agg(F.avg("value").alias("overall"))
    return daily.join(overall, "event_type").select("event_type", "slot", "n", (F.col("mean") <= F.col("overall") * 1.02).alias("ok"))


@R.query(f"""WITH {_SLOTS}, g AS (SELECT event_type, slot, slot - row_number() OVER (PARTITION BY event_type ORDER BY slot) AS island FROM s WHERE ok),
             r AS (SELECT event_type, island, min(slot) AS start, count(*) AS length FROM g GROUP BY 1, 2)
             SELECT e.event_type, min(start) FILTER (length >= 3) AS recovered_slot FROM (SELECT DISTINCT event_type FROM s) e LEFT JOIN r USING (event_type) GROUP BY 1""")
def recovery_streak(spark: SparkSession, d: str) -> DataFrame:
    return windows.recovery(_daily(spark, d), "event_type", "slot", "ok", 3)


@R.query(f"""WITH {_SLOTS}, f AS (SELECT event_type, min(slot) FILTER (NOT ok) AS bad FROM s GROUP BY 1)
             SELECT f.event_type, max(n) FILTER (bad IS NULL OR slot < bad) AS knee FROM f JOIN s USING (event_type) GROUP BY 1""")
def knee_rate(spark: SparkSession, d: str) -> DataFrame:
    return windows.knee(_daily(spark, d), "event_type", "slot", "n", "ok")


@R.query("""SELECT count(*) AS all_lines, count(*) FILTER (l_quantity >= 10) AS big, count(*) FILTER (l_quantity >= 10 AND l_discount BETWEEN 0.03 AND 1e9) AS discounted,
            count(*) FILTER (l_quantity >= 10 AND l_discount BETWEEN 0.03 AND 1e9 AND l_returnflag = 'R') AS returned, true AS monotone FROM lineitem""")
def funnel_monotone(spark: SparkSession, d: str) -> DataFrame:
    s1 = F.col("l_quantity") >= 10
    s2 = s1 & F.coalesce(F.col("l_discount").between(0.03, 1e9), F.lit(False))
    s3 = s2 & (F.col("l_returnflag") == "R")
    f = load(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("all_lines"), F.count_if(s1).alias("big"), F.count_if(s2).alias("discounted"), F.count_if(s3).alias("returned"))
    return f.withColumn("monotone", F.expr("all_lines >= big and big >= discounted and discounted >= returned"))


@R.query("""WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2)
            SELECT o_custkey, o_orderpriority, n FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1""")
def majority_value(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.modal_value(load(spark, d, "orders"), ["o_custkey"], "o_orderpriority")


@R.query("""WITH c AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS first_seen FROM orders GROUP BY 1, 2)
            SELECT o_custkey, o_orderpriority, n FROM c QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, first_seen) = 1""")
def majority_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """As majority_value, ties to the value seen first."""
    return aggregates.modal_value(load(spark, d, "orders"), ["o_custkey"], "o_orderpriority", "o_orderkey")


@R.query(f"SELECT o_orderkey FROM orders ORDER BY {hash_sql('o_orderkey', 5)}, o_orderkey LIMIT 500")
def random_sample_exact(spark: SparkSession, d: str) -> DataFrame:
    """Exactly 500 orders, by hash order."""
    return windows.random_sample(load(spark, d, "orders"), "o_orderkey", 500, 5).select("o_orderkey")


@R.query("""WITH rates AS (SELECT c_custkey, CAST(c_custkey % 7 AS DOUBLE) / 10 AS per_order, 1.0 + c_custkey % 3 AS per_item, 20.0 AS least FROM customer WHERE c_custkey % 5 <> 0),
            o AS (SELECT o_orderkey, o_custkey, count(l_orderkey) AS items FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)
            SELECT o_orderkey, CASE WHEN per_order IS NOT NULL THEN round(greatest(per_order + items * per_item, least), 2) END AS charge, per_order IS NULL AS no_rate FROM o LEFT JOIN rates ON o_custkey = c_custkey""")
def rate_card(spark: SparkSession, d: str) -> DataFrame:
    """Charge of each order by a card of rates per customer; orders without a rate have none and are marked."""
    k = F.col("c_custkey")
    card = load(spark, d, "customer").filter(k % 5 != 0).select("c_custkey", ((k % 7).cast("double") / 10).alias("per_order"), (k % 3 + 1.0).alias("per_item"), F.lit(20.0).alias("least"))
    items = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("items"))
    orders = load(spark, d, "orders").select("o_orderkey", "o_custkey").join(items, "o_orderkey", "left").withColumn("items", F.coalesce("items", F.lit(0)))
    rated = joins.rated(orders, card, "o_custkey", "c_custkey")
    # greatest passes over nulls, a charge without a rate must stay null
    charge = F.when(~F.col("no_rate"), F.round(F.greatest(F.col("per_order") + F.col("items") * F.col("per_item"), "least"), 2))
    return rated.select("o_orderkey", charge.alias("charge"), "no_rate")

@R.query("SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS statuses, count(DISTINCT o_orderpriority) AS priorities FROM orders GROUP BY 1")
def set_to_text(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").groupBy("o_custkey").agg(F.array_join(F.sort_array(F.collect_set("o_orderstatus")), ",").alias("statuses"), F.count_distinct("o_orderpriority").alias("priorities"))


@R.query("""WITH k AS (SELECT o_custkey, count(DISTINCT o_orderstatus) AS s FROM orders GROUP BY 1) SELECT round(avg(CASE WHEN s > 1 THEN 1.0 ELSE 0.0 END), 6) AS share_many, count(*) AS keys FROM k""")
def two_level_distinct(spark: SparkSession, d: str) -> DataFrame:
    k = load(spark, d, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderstatus").alias("s"))
    return k.agg(F.round(F.avg(F.when(F.col("s") > 1, 1.0).otherwise(0.0)), 6).alias("share_many"), F.count(F.lit(1)).alias("keys"))


@R.query("""WITH h AS (SELECT o_orderpriority, avg(o_totalprice) FILTER (o_orderdate >= TIMESTAMP '1995-01-01') AS now, avg(o_totalprice) FILTER (o_orderdate < TIMESTAMP '1995-01-01') AS before FROM orders GROUP BY 1)
            SELECT o_orderpriority, CASE WHEN (now - before) / nullif(abs(before), 0) IS NULL THEN 'not comparable' WHEN abs((now - before) / abs(before)) <= 0.01 THEN 'unchanged' WHEN now > before THEN 'improved' ELSE 'regressed' END AS verdict FROM h""")
def metric_movement(spark: SparkSession, d: str) -> DataFrame:
    new = F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz")
    h = load(spark, d, "orders").groupBy("o_orderpriority").agg(F.avg(F.when(new, F.col("o_totalprice"))).alias("now"), F.avg(F.when(~new, F.col("o_totalprice"))).alias("before"))
    return h.select("o_orderpriority", expr.movement(F.col("now"), F.col("before"), True, 0.01).alias("verdict"))


@R.query("""SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN '(total)' ELSE o_orderpriority END AS o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers,
            count(*) FILTER (o_totalprice < 10000) AS under FROM orders GROUP BY ROLLUP (o_orderpriority)""")
def scorecard_with_total(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.with_total(load(spark, d, "orders"), "o_orderpriority", [F.count_distinct("o_custkey").alias("customers"), F.count_if(F.col("o_totalprice") < 10000).alias("under")], "(total)")


@R.query("""WITH w AS (SELECT p_brand, p_size, count(*) AS weight, max(p_retailprice) > 1500 AS hit FROM part GROUP BY 1, 2)
            SELECT p_brand, round(avg(CAST(hit AS INTEGER)), 6) AS plain, round(sum(CASE WHEN hit THEN weight ELSE 0 END) / sum(weight), 6) AS weighted FROM w GROUP BY 1""")
def hit_rate_weighted(spark: SparkSession, d: str) -> DataFrame:
    w = load(spark, d, "part").groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("weight"), (F.max("p_retailprice") > 1500).alias("hit"))
    return w.groupBy("p_brand").agg(F.round(F.avg(F.col("hit").cast("int")), 6).alias("plain"), F.round(F.sum(F.when(F.col("hit"), F.col("weight")).otherwise(0)) / F.sum("weight"), 6).alias("weighted"))


@R.query("""SELECT c_mktsegment, round((max(c_acctbal) - min(c_acctbal)) / avg(c_acctbal) * 100, 4) AS spread_pct FROM customer GROUP BY 1""")
def spread_pct(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").groupBy("c_mktsegment").agg(F.round((F.max("c_acctbal") - F.min("c_acctbal")) / F.avg("c_acctbal") * 100, 4).alias("spread_pct"))


@R.query("""WITH t AS (SELECT l_partkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, l_partkey LIMIT 12)
            SELECT l_partkey, l_returnflag, round(avg(l_quantity), 6) AS mean_quantity FROM lineitem SEMI JOIN t USING (l_partkey) GROUP BY 1, 2""")
def top_groups_matrix(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "lineitem").select("l_partkey", "l_returnflag", "l_quantity")
    top = df.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l_partkey").limit(12)
    return df.join(F.broadcast(top), "l_partkey", "left_semi").groupBy("l_partkey", "l_returnflag").agg(F.round(F.avg("l_quantity"), 6).alias("mean_quantity"))


@R.query("""WITH p AS (SELECT l_orderkey, concat_ws(' + ', CASE WHEN bool_or(l_quantity > 45) THEN 'bulk' END, CASE WHEN bool_or(l_discount > 0.08) THEN 'discount' END, CASE WHEN bool_or(l_returnflag = 'R') THEN 'returned' END) AS c FROM lineitem GROUP BY 1)
            SELECT CASE WHEN c = '' THEN 'None documented' ELSE c END AS combination, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM p GROUP BY 1""")
def reason_combinations(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_quantity") > 45).alias("a"), F.bool_or(F.col("l_discount") > 0.08).alias("b"), F.bool_or(F.col("l_returnflag") == "R").alias("c"))
    named = F.array_join(F.array_compact(F.array(*[F.when(F.col(k), F.lit(v)) for k, v in (("a", "bulk"), ("b", "discount"), ("c", "returned"))])), " + ")
    return aggregates.count_share(p.select(F.when(named == "", "None documented").otherwise(named).alias("combination")), ["combination"])


@R.query("""WITH t AS (SELECT p_type, p_brand FROM part), c AS (SELECT p_brand, count(*) FILTER (p_type LIKE 'ECONOMY%') AS ECONOMY, count(*) FILTER (p_type LIKE 'LARGE%') AS LARGE, count(*) FILTER (p_type LIKE 'SMALL%') AS SMALL, count(*) AS total FROM t GROUP BY 1)
            SELECT p_brand, ECONOMY, LARGE, SMALL, total, round((CAST(ECONOMY > 0 AS INTEGER) + CAST(LARGE > 0 AS INTEGER) + CAST(SMALL > 0 AS INTEGER)) / 3, 6) AS completeness, total < (SELECT median(total) / 2 FROM c) AS low FROM c""")
def coverage_matrix(spark: SparkSession, d: str) -> DataFrame:
    from weftline.operators import mapping

    df = load(spark, d, "part").select("p_brand", F.substring_index("p_type", " ", 1).alias("kind"))
    return mapping.coverage(df, "p_brand", "kind", ["ECONOMY", "LARGE", "SMALL"])


@R.query("""SELECT event_type, CASE WHEN event_type = 'error' THEN 'failed' WHEN value IS NULL THEN 'empty' WHEN value < 20 THEN 'fast' WHEN value < 60 THEN 'normal' ELSE 'slow' END AS outcome, count(*) AS n FROM events GROUP BY 1, 2""")
def outcome_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    o = expr.first_match([(F.col("event_type") == "error", "failed"), (v.isNull(), "empty"), (v < 20, "fast"), (v < 60, "normal")], "slow")
    return load(spark, d, "events").groupBy("event_type", o.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@R.query("""WITH m AS (SELECT median(value) AS m FROM events) SELECT event_id, round(CASE WHEN m < 3 THEN value * 1440 ELSE value END, 6) AS minutes FROM events, m""")
def unit_fix(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "events")
    m = aggregates.quantiles(df, [], "value", {"m": 0.5}).select("m").scalar()
    return df.select("event_id", F.round(F.when(m < 3, F.col("value") * 1440).otherwise(F.col("value")), 6).alias("minutes"))


QUERIES, SQL = R.QUERIES, R.SQL
