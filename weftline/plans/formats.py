"""Files by kind, headers and sheets, databases, logs, blocks of lines, answers of models, templates and cached rules."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import expr
from weftline.operators import joins, mapping, text
from weftline.plans.linkages import LINKS, PERSON, links, person
from weftline.plans.registry import Registry
from weftline.runtime import Stage, load, spread
from weftline.sources import io

R = Registry()

# ---------------------------------------------------------------- files and databases


@R.query("SELECT kind, n_nationkey, n_name FROM nation, (SELECT unnest(['csv', 'json', 'orc', 'parquet', 'tsv']) AS kind)")
def read_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """One table written in five formats, each read back by what its name ends in."""
    folder, df = Stage(spark, "kinds").path, load(spark, d, "nation").select("n_nationkey", "n_name")
    df.write.csv(f"{folder}/t.csv", header=True)
    df.write.csv(f"{folder}/t.tsv", header=True, sep="\t")
    for kind in ("json", "orc", "parquet"):
        df.write.format(kind).save(f"{folder}/t.{kind}")
    out = None
    for kind in ("csv", "json", "orc", "parquet", "tsv"):
        one = io.read_any(spark, f"{folder}/t.{kind}").select(F.lit(kind).alias("kind"), F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name")
        out = one if out is None else out.unionByName(one)
    return out


@R.query("SELECT o_orderkey, CAST(strftime(o_orderdate, '%Y') AS VARCHAR) AS period FROM orders WHERE o_orderstatus = 'P'")
def union_files_tagged(spark: SparkSession, d: str) -> DataFrame:
    """One folder per year, read together, the year taken from the file's path."""
    path = Stage(spark, "files").path
    years = load(spark, d, "orders").filter("o_orderstatus = 'P'").select("o_orderkey", F.date_format("o_orderdate", "yyyy").alias("y"))
    years.write.partitionBy("y").parquet(path)
    read = spark.read.schema("o_orderkey long").option("recursiveFileLookup", "true").parquet(path)
    return io.tag_from_name(read, r"y=(\d{4})", part="file_path").select("o_orderkey", "period")


@R.query("SELECT n_nationkey, 'order' AS order_key, n_name AS order_name FROM nation UNION ALL SELECT NULL, 'order', NULL UNION ALL SELECT NULL, 'key', 'name'")
def two_row_header(spark: SparkSession, d: str) -> DataFrame:
    """A file with two header rows, among whose data rows both occur again."""
    path = Stage(spark, "header").path
    rows = load(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("a"), F.lit("order").alias("b"), F.col("n_name").alias("c"), F.col("n_nationkey").alias("o"))
    head = spark.createDataFrame([("", "order", "", -2), ("nation", "key", "name", -1), ("", "order", "", 98), ("nation", "key", "name", 99)], "a string, b string, c string, o int")
    rows.unionByName(head).repartition(1).sortWithinPartitions("o").drop("o").write.csv(path, header=False, emptyValue="")
    read = io.read_two_row_header(spark, path)
    return read.select(F.col("nation").try_cast("int").alias("n_nationkey"), "order_key", F.nullif(F.col("order_name"), F.lit("")).alias("order_name"))


@R.query("""SELECT sheet, resolved, CAST(round(score, 4) AS DOUBLE) AS score FROM (SELECT 'documents' AS sheet, 3 AS resolved, 3 + 5 + 0.0001 * (SELECT count(*) FROM documents) AS score
            UNION ALL SELECT 'orders', 0, 0.0001 * (SELECT count(*) FROM orders) UNION ALL SELECT 'elasticdump_parties', 1, 1 + 0.0001 * (SELECT count(*) FROM elasticdump_parties))""")
def best_sheet(spark: SparkSession, d: str) -> DataFrame:
    """Several tables of one delivery by how well they answer the wanted fields."""
    wanted = {"id": ["doc_id"], "body": ["text"], "origin": ["source", "_source"]}
    scores = io.best_sheet({n: load(spark, d, n) for n in ("documents", "orders", "elasticdump_parties")}, wanted, ["body"])
    return spark.createDataFrame(scores, "sheet string, resolved int, score double")


@R.query("SELECT c_mktsegment AS SEGMENT, count(*) AS N, CAST(2 AS BIGINT) AS LOADS FROM customer GROUP BY 1")
def database_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Two loads into a database table, all rows or none each, read back in ranges.

    The database is an embedded one, which lives in the driver's JVM and its files on the driver's disk: on a cluster its rows go through the driver.
    """
    folder = tempfile.mkdtemp(prefix="weftline-db-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    url = f"jdbc:derby:{folder}/db;create=true"
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows = load(spark, d, "customer").select(F.col("c_custkey").alias("ID"), F.col("c_mktsegment").alias("SEGMENT")).repartition(3)
    for number in (1, 2):
        io.write_jdbc(rows.withColumn("LOAD_NO", F.lit(number)), url, "CUSTOMERS", **options)
    read = io.read_jdbc(spark, url, "SELECT ID, SEGMENT, LOAD_NO FROM CUSTOMERS", "ID", (1, 1000), 3, **options)
    return read.groupBy("SEGMENT").agg(F.count_distinct("ID").alias("N"), F.count_distinct("LOAD_NO").alias("LOADS"))


# ---------------------------------------------------------------- logs and blocks

_LOG = r"[^\n]*CONSUMER=[^\n]*"
_KEYS = ("consumer", "template", "took", "hits", "path")


def _value_sql(key: str) -> str:
    return f"coalesce(nullif(regexp_extract(line, '(?i)\\b{key}\\s*[=:]\\s*\"?([^\\s,\"}}]*)', 1), ''), 'none') AS {key}"


@R.query(f"WITH l AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_LOG}')) AS line FROM documents WHERE source = 'search_log') SELECT doc_id, {', '.join(map(_value_sql, _KEYS))} FROM l")
def log_key_values(spark: SparkSession, d: str) -> DataFrame:
    """Values by key of every request line in the search logs."""
    rows = load(spark, d, "documents").filter("source = 'search_log'").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(_LOG), F.lit(0))).alias("line"))
    return rows.select("doc_id", *[expr.key_value(F.col("line"), k, "none").alias(k) for k in _KEYS])


@R.query("""WITH s AS (SELECT doc_id, string_split(replace(text, chr(13), ''), chr(10)) AS l FROM documents WHERE source = 'search_log'),
    a AS (SELECT doc_id, l, unnest(list_filter(range(len(l)), lambda i: regexp_matches(l[i + 1], '^ERROR'))) AS i FROM s),
    f AS (SELECT doc_id, len(l) AS n, i, l[i] AS p1, CASE WHEN i >= 2 THEN l[i - 1] END AS p2, CASE WHEN i >= 3 THEN l[i - 2] END AS p3 FROM a),
    h AS (SELECT doc_id, n, i, i >= 1 AND starts_with(p1, 'query ') AS h1, i >= 1 AND starts_with(p1, 'WARN ') AS g1, coalesce(starts_with(p2, 'query '), false) AS h2, coalesce(starts_with(p2, 'WARN '), false) AS g2,
                 coalesce(starts_with(p3, 'query '), false) AS h3, coalesce(starts_with(p3, 'WARN '), false) AS g3 FROM f),
    b AS (SELECT doc_id, n, i, CASE WHEN h1 THEN i - 1 WHEN NOT g1 THEN i WHEN h2 THEN i - 2 WHEN NOT g2 THEN i - 1 WHEN h3 OR g3 THEN i - 3 ELSE i - 2 END AS first_line FROM h)
    SELECT doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS block, CAST(first_line AS INTEGER) AS first_line, CAST(coalesce(lead(first_line) OVER w, n) - 1 AS INTEGER) AS last_line FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY i)""")
def error_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of the search logs that each end in an error line, with the query before it up to three lines back."""
    docs = load(spark, d, "documents").filter("source = 'search_log'").select("doc_id", "text")
    return text.segment_blocks(docs, "text", "^ERROR", "query ", "WARN ").select("doc_id", "block", "first_line", "last_line")


# ---------------------------------------------------------------- answers, templates, rules


@R.query("SELECT event_id, CASE WHEN event_id % 5 <> 4 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k, event_id % 5 <> 4 AS readable FROM events")
def fenced_answers(spark: SparkSession, d: str) -> DataFrame:
    """JSON out of answers that wrap it in fences or words, or break off."""
    i, p = F.col("event_id") % 5, F.col("props")
    answer = (
        F.when(i == 0, p).when(i == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(i == 2, F.concat(F.lit("Sure:\n```\n"), p, F.lit("\n```\nAnything else?")))
        .when(i == 3, F.concat(F.lit("The answer is "), p, F.lit(" as asked."))).otherwise(F.concat(F.lit("```json\n"), F.substring(p, 1, 4)))
    )
    found = load(spark, d, "events").select("event_id", expr.fenced_json(answer).alias("j"))
    return found.select("event_id", F.get_json_object("j", "$.k").cast("long").alias("k"), F.col("j").isNotNull().alias("readable"))


@R.query("""SELECT p_partkey, CASE WHEN p_size % 10 IN (0, 5) THEN NULL ELSE p_size * 2 END AS answer, CASE WHEN p_size % 10 = 0 THEN 'failed' WHEN p_size % 10 = 5 THEN 'invalid' ELSE 'ok' END AS status,
            CASE WHEN p_size % 10 IN (0, 5) THEN 2 ELSE 1 END AS attempts, CASE WHEN p_size % 10 = 0 THEN 'ValueError: refused' WHEN p_size % 10 = 5 THEN 'answer is odd' END AS error FROM part""")
def validated_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """A call per row whose answer is checked, here a local stand-in that fails on some rows and answers wrongly on others."""

    def call(row: dict) -> dict:
        if row["p_size"] % 10 == 0:
            raise ValueError("refused")
        return {"answer": int(row["p_size"]) * 2 + (row["p_size"] % 10 == 5)}

    df = spread(load(spark, d, "part").select("p_partkey", "p_size"), "p_partkey")
    return mapping.enrich(df, ["p_size"], call, "answer int", 2, valid=lambda a: "answer is odd" if a["answer"] % 2 else None).select("p_partkey", "answer", "status", "attempts", "error")


@R.query("""WITH t AS (SELECT l_orderkey AS id, l_returnflag AS tier, arg_max(CAST(l_quantity AS BIGINT), ROW(l_linenumber, l_quantity, l_linestatus)) AS q, arg_max(l_linestatus, ROW(l_linenumber, l_quantity, l_linestatus)) AS s FROM lineitem GROUP BY 1, 2)
            SELECT id, tier, CASE WHEN id % 3 = 0 THEN '=' ELSE 'Take {qty} of {status}{none}' END AS template, CASE WHEN id % 3 = 0 THEN 'as is: ' || s ELSE 'Take ' || q || ' of ' || s || '{none}' END AS filled FROM t""")
def token_templates(spark: SparkSession, d: str) -> DataFrame:
    """Templates per order and flag filled with the values of its last line; some are to be copied as they are."""
    li = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("tier"), F.struct("l_linenumber", "l_quantity", "l_linestatus").alias("seq"), "l_quantity", "l_linestatus")
    pairs = F.array(*[F.struct(F.lit(t).alias("token"), v.alias("value")) for t, v in (("qty", F.col("l_quantity").cast("long").cast("string")), ("status", F.col("l_linestatus")), ("none", F.lit(None).cast("string")))])
    tokens = li.select("id", "tier", "seq", F.concat(F.lit("as is: "), "l_linestatus").alias("source"), F.explode(pairs).alias("p")).select("id", "tier", "seq", "source", "p.*")
    templates = li.select("id", "tier").distinct().withColumn("template", F.when(F.col("id") % 3 == 0, "=").otherwise("Take {qty} of {status}{none}"))
    return mapping.fill_tokens(templates, tokens, ["id", "tier"])


@R.query("""SELECT CAST(c_custkey AS VARCHAR) AS id, upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) AS first, 'Smith' AS last, CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_acctbal < 0 THEN '-1' ELSE '1' END AS members FROM customer""")
def column_rule_names(spark: SparkSession, d: str) -> DataFrame:
    """Name parts and the member flag of an amount by declarative rules."""
    amount = F.when(F.col("c_custkey") % 4 == 0, F.lit(" ")).when(F.col("c_acctbal") < 0, F.concat(F.lit("($"), F.format_number(-F.col("c_acctbal"), 2), F.lit(")"))).otherwise(F.format_number("c_acctbal", 2))
    df = load(spark, d, "customer").select("c_custkey", F.concat(F.lit("SMITH, "), "c_mktsegment").alias("full"), amount.alias("amount"))
    return mapping.column_rules(df, {"id": ("copy", "c_custkey"), "first": ("name_first", "full"), "last": ("name_last", "full"), "members": ("member_count", "amount")})


@R.query("SELECT tag, CAST(k AS VARCHAR) AS id, v AS name, CAST(1 AS BIGINT) AS built FROM (SELECT 'a' AS tag, n_nationkey AS k, n_name AS v FROM nation UNION ALL SELECT 'b', r_regionkey, r_name FROM region)")
def cached_rules(spark: SparkSession, d: str) -> DataFrame:
    """Two deliveries with the same header but for case and blanks: the rules are built for the first and read for the second."""
    cache = mapping.RuleCache(spark, f"{Stage(spark, 'rules').path}/cache")
    a = load(spark, d, "nation").select(F.col("n_nationkey").alias("Key"), F.col("n_name").alias("Name"))
    b = load(spark, d, "region").select(F.col("r_regionkey").alias("KEY "), F.col("r_name").alias("name"))
    out = None
    for tag, df in (("a", a), ("b", b)):
        rules = cache.rules(df.columns, lambda columns: {"id": ("copy", "key"), "name": ("copy", "name")})
        bound = df.toDF(*[c.strip().lower() for c in df.columns])
        one = mapping.column_rules(bound, rules).select(F.lit(tag).alias("tag"), "*")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("built", F.lit(cache.built).cast("long"))


@R.query(f"WITH {LINKS}, {PERSON} SELECT pr1, pr2, a.dob AS dob_l, b.dob AS dob_r FROM links LEFT JOIN person a ON pr1 = a.party_id LEFT JOIN person b ON pr2 = b.party_id")
def two_sided_broadcast(spark: SparkSession, d: str) -> DataFrame:
    """The two-sided join with attributes broadcast while they are few, by shuffle beyond."""
    return joins.two_sided(links(spark, d), person(spark, d).select("party_id", "dob"), "party_id", "pr1", "pr2", broadcast_rows=100_000)


QUERIES, SQL = R.QUERIES, R.SQL
