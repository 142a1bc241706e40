"""Text scoring queries: concepts, axes, classes, buckets, evidence, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import expr
from weftline.operators import aggregates, text
from weftline.operators.text import Rule
from weftline.plans.registry import Registry
from weftline.runtime import load, spread

R = Registry()

RULES = [
    Rule("wheelchair", r"\bwheel ?chair\b", "mobility", 2),
    Rule("stretcher", r"\bstretcher\b", "mobility", 3),
    Rule("bedbound", r"\b(bedbound|sit upright)\b", "mobility", 3),
    Rule("oxygen", r"\b(oxygen|o2)\b", "monitoring", 3),
    Rule("cardiac", r"\bcardiac\b", "monitoring", 2),
    Rule("dialysis", r"\bdialysis\b", "condition", 2),
    Rule("sepsis", r"\b(sepsis|mrsa)\b", "condition", 3),
    Rule("fever", r"\bfever\b", "condition", 1),
]
NAMED = ["dialysis", "sepsis"]
AXES = ["mobility", "monitoring", "condition"]
REASON, FILLER = r"\b(dialysis|sepsis|oxygen|fever|quadriplegia)\b", r"\b(as far as we know|most likely|unless stated otherwise|in this case)\b"

_T = "lower(coalesce(text, ''))"
_HITS = ", ".join(f"CAST(regexp_matches({_T}, '{r.pattern}') AS INTEGER) AS hit_{r.name}" for r in RULES)
_AXIS = {a: " + ".join(f"hit_{r.name} * {r.weight}" for r in RULES if r.axis == a) for a in AXES}
_NAMED = " + ".join(f"hit_{r.name} * {r.weight}" for r in RULES if r.name in NAMED)
_SCORED = f"""hits AS (SELECT doc_id, source, lang, text, {_HITS} FROM documents),
    axes AS (SELECT *, {", ".join(f"{e} AS score_{a}" for a, e in _AXIS.items())}, {_NAMED} AS named_score FROM hits),
    scored AS (SELECT *, score_mobility + score_monitoring + score_condition + named_score AS total_score FROM axes)"""
_CLASS = "CASE WHEN total_score >= 8 THEN 'strong' WHEN total_score >= 4 THEN 'moderate' WHEN total_score > 0 THEN 'weak' ELSE 'none' END"


def scored(spark: SparkSession, d: str) -> DataFrame:
    return text.rule_scores(spread(load(spark, d, "documents").select("doc_id", "source", "lang", "text"), "doc_id"), "text", RULES, NAMED)


@R.query(f"WITH {_SCORED} SELECT doc_id, {', '.join('hit_' + r.name for r in RULES)}, score_mobility, score_monitoring, score_condition, named_score, total_score, {_CLASS} AS class FROM scored")
def text_rule_scores(spark: SparkSession, d: str) -> DataFrame:
    df = scored(spark, d)
    return df.withColumn("class", text.classify_total(F.col("total_score"), 8, 4)).drop("source", "lang", "text")


@R.query(f"""WITH {_SCORED} SELECT {_CLASS} AS class, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM scored GROUP BY 1""")
def text_class_share(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.count_share(scored(spark, d).select(text.classify_total(F.col("total_score"), 8, 4).alias("class")), ["class"])


@R.query(f"""WITH {_SCORED} SELECT CASE WHEN greatest(score_mobility, score_monitoring, score_condition) >= 3 THEN 'clear'
             WHEN greatest(score_mobility, score_monitoring, score_condition) > 0 THEN 'partial' ELSE 'none' END AS class,
             count(*) AS n, min(total_score) AS least, max(total_score) AS most, round(avg(total_score), 6) AS mean FROM scored GROUP BY 1""")
def text_axis_classes(spark: SparkSession, d: str) -> DataFrame:
    c = text.classify_axes([F.col(f"score_{a}") for a in AXES], 3).alias("class")
    return scored(spark, d).groupBy(c).agg(F.count(F.lit(1)).alias("n"), F.min("total_score").alias("least"), F.max("total_score").alias("most"), F.round(F.avg("total_score"), 6).alias("mean"))


@R.query(f"WITH {_SCORED} SELECT count(*) FILTER (score_mobility + score_monitoring + score_condition + named_score <> total_score) AS bad_rows, count(*) AS n FROM scored")
def text_score_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    parts = sum((F.col(f"score_{a}") for a in AXES), F.lit(0)) + F.col("named_score")
    return scored(spark, d).agg(F.count_if(parts != F.col("total_score")).alias("bad_rows"), F.count(F.lit(1)).alias("n"))


_BUCKET = f"""CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty'
    WHEN regexp_matches({_T}, '{REASON}') AND regexp_matches({_T}, '{FILLER}') THEN 'reason+filler'
    WHEN regexp_matches({_T}, '{REASON}') THEN 'reason' WHEN regexp_matches({_T}, '{FILLER}') THEN 'filler only' ELSE 'unrecognised' END"""


@R.query(f"""SELECT lower(lang) AS lang, {_BUCKET} AS bucket, count(*) AS n, round(100.0 * avg(CASE WHEN n_chars < 200 THEN 1.0 ELSE 0.0 END), 4) AS short_pct
             FROM documents GROUP BY 1, 2 HAVING count(*) >= 5""")
def text_buckets_by_lang(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "documents")
    return (
        df.groupBy(F.lower("lang").alias("lang"), text.text_bucket(F.col("text"), REASON, FILLER).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"), F.round(100.0 * F.avg(F.when(F.col("n_chars") < 200, 1.0).otherwise(0.0)), 4).alias("short_pct"))
        .filter("n >= 5")
    )


@R.query(f"""WITH {_SCORED}, cells AS (UNPIVOT (SELECT doc_id, {', '.join('hit_' + r.name for r in RULES)} FROM scored) ON {', '.join('hit_' + r.name for r in RULES)} INTO NAME rule VALUE hit)
             SELECT rule, count(*) AS docs FROM cells WHERE hit = 1 GROUP BY rule""")
def rule_unpivot(spark: SparkSession, d: str) -> DataFrame:
    hits = [f"hit_{r.name}" for r in RULES]
    return scored(spark, d).unpivot(["doc_id"], hits, "rule", "hit").filter("hit = 1").groupBy("rule").agg(F.count(F.lit(1)).alias("docs"))


_EVIDENCE = ", ".join(f"CASE WHEN regexp_extract(lower(text), '{r.pattern}') <> '' THEN '{r.name}[' || regexp_extract(lower(text), '{r.pattern}') || ']' END" for r in RULES)


@R.query(f"SELECT doc_id, concat_ws('; ', {_EVIDENCE}) AS evidence FROM documents")
def rule_evidence(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", expr.evidence(F.lower("text"), {r.name: r.pattern for r in RULES}).alias("evidence"))


@R.query(f"""WITH {_SCORED}, cls AS (SELECT doc_id, total_score >= 4 AS a, score_mobility + score_monitoring >= 3 AS b FROM scored)
             SELECT a AS by_total, b AS by_axis, count(*) AS n, round(avg(CASE WHEN a = b THEN 1.0 ELSE 0.0 END), 6) AS agreement FROM cls GROUP BY 1, 2""")
def class_confusion(spark: SparkSession, d: str) -> DataFrame:
    a, b = F.col("total_score") >= 4, F.col("score_mobility") + F.col("score_monitoring") >= 3
    return scored(spark, d).groupBy(a.alias("by_total"), b.alias("by_axis")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(a == b, 1.0).otherwise(0.0)), 6).alias("agreement"))


@R.query(f"""WITH {_SCORED} SELECT source, round(100 * avg(CASE WHEN score_mobility > 0 THEN 1.0 ELSE 0 END), 1) AS mobility_pct,
             round(100 * avg(CASE WHEN score_monitoring > 0 THEN 1.0 ELSE 0 END), 1) AS monitoring_pct,
             round(100 * avg(CASE WHEN score_mobility > 0 AND score_condition > 0 THEN 1.0 ELSE 0 END), 1) AS core_pct FROM scored GROUP BY source""")
def standard_pass_rates(spark: SparkSession, d: str) -> DataFrame:
    rate = lambda c: F.round(100 * F.avg(F.when(c, 1.0).otherwise(0.0)), 1)
    return scored(spark, d).groupBy("source").agg(
        rate(F.col("score_mobility") > 0).alias("mobility_pct"), rate(F.col("score_monitoring") > 0).alias("monitoring_pct"),
        rate((F.col("score_mobility") > 0) & (F.col("score_condition") > 0)).alias("core_pct"),
    )


@R.query("""SELECT CASE WHEN length(trim(coalesce(text, ''))) = 0 THEN 'none' WHEN length(trim(coalesce(text, ''))) < 20 THEN 'short'
            WHEN length(trim(coalesce(text, ''))) < 150 THEN 'medium' WHEN length(trim(coalesce(text, ''))) < 600 THEN 'long' ELSE 'very long' END AS quality,
            count(*) AS n FROM documents GROUP BY 1""")
def length_quality(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").groupBy(text.length_class(F.col("text")).alias("quality")).agg(F.count(F.lit(1)).alias("n"))


LEXICON = {"breathing": ["oxygen", "o2", "bipap"], "pain": ["pain", "ache"], "money": ["copay", "deductible", "coinsurance"], "identity": ["surname", "passport", "filing"]}
_LEX = ", ".join(f"CASE WHEN {' OR '.join(f'contains({_T}, {chr(39)}{w}{chr(39)})' for w in ws)} THEN '{n}' END" for n, ws in LEXICON.items())


@R.query(f"SELECT doc_id, concat_ws(',', {_LEX}) AS tags, CAST(contains({_T}, 'caller') AS INTEGER) + CAST(contains({_T}, 'nurse') AS INTEGER) + CAST(contains({_T}, 'desk') AS INTEGER) AS markers FROM documents")
def lexicon_tags(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.array_join(expr.lexicon_tags(F.col("text"), LEXICON), ",").alias("tags"), expr.count_markers(F.col("text"), ["caller", "nurse", "desk"]).alias("markers"))


@R.query(f"""WITH {_SCORED}, g AS (SELECT source, total_score, hit_oxygen = 0 AND hit_cardiac = 0 AS gap FROM scored)
             SELECT source, count(*) AS n, round(avg(CAST(gap AS INTEGER)), 6) AS gap_rate,
                    CASE WHEN count(*) FILTER (gap) >= 30 AND count(*) FILTER (NOT gap) >= 30
                         THEN round((avg(total_score) FILTER (NOT gap) - avg(total_score) FILTER (gap)) * avg(CAST(gap AS INTEGER)), 6) END AS expected_gain
             FROM g GROUP BY source""")
def gap_expected_gain(spark: SparkSession, d: str) -> DataFrame:
    gap = (F.col("hit_oxygen") == 0) & (F.col("hit_cardiac") == 0)
    a = scored(spark, d).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.avg(gap.cast("int")).alias("rate"), F.count_if(gap).alias("with"), F.count_if(~gap).alias("without"),
        F.avg(F.when(~gap, F.col("total_score"))).alias("a"), F.avg(F.when(gap, F.col("total_score"))).alias("b"),
    )
    gain = F.when((F.col("with") >= 30) & (F.col("without") >= 30), F.round((F.col("a") - F.col("b")) * F.col("rate"), 6))
    return a.select("source", "n", F.round("rate", 6).alias("gap_rate"), gain.alias("expected_gain"))


@R.query("""WITH t AS (SELECT doc_id, unnest(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+')) AS token FROM documents),
            tf AS (SELECT doc_id, token, count(*) AS tf FROM t WHERE token <> '' GROUP BY 1, 2),
            len AS (SELECT doc_id, sum(tf) AS len FROM tf GROUP BY 1),
            st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(len) FROM len) * 1.0 / (SELECT count(*) FROM documents) AS a),
            d AS (SELECT token, count(*) AS df FROM tf WHERE token IN ('dialysis', 'oxygen', 'stretcher') GROUP BY 1)
            SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))), 6) AS score
            FROM tf JOIN d USING (token) JOIN len USING (doc_id), st GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 25""")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return text.bm25(spread(load(spark, d, "documents").select("doc_id", "text"), "doc_id"), "doc_id", "text", ["dialysis", "oxygen", "stretcher"], 25)


@R.query("""SELECT count(*) AS n, count(*) FILTER (contains(lower(coalesce(text, '')), 'dialysis') AND NOT coalesce(starts_with(source, 'search'), false)) AS matched,
            CAST(0 AS BIGINT) AS unsupported FROM documents""")
def boolean_template(spark: SparkSession, d: str) -> DataFrame:
    template = {"must": [("text_l", "contains", "word"), ("lang", "eq", "missing")], "must_not": [("source", "prefix", "kind")]}
    df = load(spark, d, "documents").withColumn("text_l", F.lower(F.coalesce("text", F.lit(""))))
    p = text.predicate(template, {"word": F.lit("dialysis"), "missing": None, "kind": F.lit("search")})
    none = text.predicate({"must": [("lang", "eq", "missing")]}, {"missing": None})
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(p).alias("matched"), F.count_if(none).alias("unsupported"))


@R.query("""WITH p AS (SELECT doc_id, unnest(list_filter(string_split_regex(replace(coalesce(text, ''), chr(13), ''), '\\n+'), lambda x: x <> '')) AS line FROM documents)
            SELECT doc_id, count(*) AS segments, count(*) FILTER (regexp_matches(line, '^[A-Za-z ]+: ')) AS turns FROM p GROUP BY doc_id""")
def turn_segments(spark: SparkSession, d: str) -> DataFrame:
    lines = F.filter(F.split(F.replace(F.col("text"), F.lit("\r"), F.lit("")), "\n+"), lambda x: x != "")
    parts = load(spark, d, "documents").select("doc_id", F.explode(lines).alias("line"))
    return parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("segments"), F.count_if(F.col("line").rlike("^[A-Za-z ]+: ")).alias("turns"))


@R.query("""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '(ERROR|WARN) [^\\n]*')) AS record FROM documents WHERE source = 'search_log')
            SELECT doc_id, record,
                   coalesce(nullif(regexp_extract(record, '(?i)\\bretry (\\d+)', 1), ''), 'none') AS retry FROM r""")
def log_line_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "documents").filter("source = 'search_log'").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(?:ERROR|WARN) [^\n]*"), F.lit(0))).alias("record"))
    retry = F.coalesce(F.nullif(F.regexp_extract("record", r"(?i)\bretry (\d+)", 1), F.lit("")), F.lit("none"))
    return rows.select("doc_id", "record", retry.alias("retry"))


QUERIES, SQL = R.QUERIES, R.SQL
