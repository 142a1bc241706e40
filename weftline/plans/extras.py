"""Remaining operators: discovery, disagreement, attribution, files, catalog, models, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import expr
from weftline.operators import aggregates, joins, linkage, mapping, nested, schema, text, windows
from weftline.plans.problems import docs_sql
from weftline.plans.registry import Registry
from weftline.plans.linkages import links, person
from weftline.runtime import Stage, load, spread
from weftline.sources import io
from weftline.streaming import windows as streams

R = Registry()


@R.query("""WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, 'F-\\d+[A-Z]?')) AS code FROM documents) SELECT code, count(*) AS uses, count(DISTINCT doc_id) AS docs FROM c WHERE code NOT IN ('F-77', 'F-110') GROUP BY 1""")
def target_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Codes found in the texts that no known target covers."""
    codes = load(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"F-\d+[A-Z]?"), F.lit(0))).alias("code"))
    known = spark.createDataFrame([("F-77",), ("F-110",)], "code string")
    return codes.join(F.broadcast(known), "code", "left_anti").groupBy("code").agg(F.count(F.lit(1)).alias("uses"), F.count_distinct("doc_id").alias("docs"))


@R.query("""SELECT record_id, len(list_distinct(list_filter([upper(trim(firstName)), upper(trim(middleName)), upper(trim(lastName))], lambda x: x IS NOT NULL))) > 1 AS disagree FROM rpt_bronze_party""")
def variant_disagreement(spark: SparkSession, d: str) -> DataFrame:
    v = F.array_distinct(F.array_compact(F.array(*[F.upper(F.trim(c)) for c in ("firstName", "middleName", "lastName")])))
    return load(spark, d, "rpt_bronze_party").select("record_id", (F.size(v) > 1).alias("disagree"))


@R.query("""WITH a AS (SELECT event_type, count(*) AS n, count(*) FILTER (value > 80) AS slow, count(*) FILTER (value < 5) AS fast, avg(value) AS m FROM events GROUP BY 1)
            SELECT event_type, CASE WHEN slow * 4 > n THEN 'server' WHEN fast * 4 > n THEN 'client' WHEN m > 50 THEN 'queue' ELSE 'none' END AS bottleneck FROM a""")
def bottleneck(spark: SparkSession, d: str) -> DataFrame:
    a = load(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 80).alias("slow"), F.count_if(F.col("value") < 5).alias("fast"), F.avg("value").alias("m"))
    return a.select("event_type", expr.first_match([(F.col("slow") * 4 > F.col("n"), "server"), (F.col("fast") * 4 > F.col("n"), "client"), (F.col("m") > 50, "queue")], "none").alias("bottleneck"))


@R.query(f"""WITH {docs_sql("tripmaster", "LosQuestions")},
    t AS (SELECT row_id, t.type, t.value FROM docs, json_tree(j) t)
    SELECT row_id, count(*) FILTER (type = 'OBJECT') AS objects, count(*) FILTER (type NOT IN ('OBJECT', 'ARRAY')) AS leaves,
           coalesce(round(sum(CASE WHEN type IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE) END), 6), 0) AS number_sum FROM t GROUP BY 1 HAVING objects + leaves > 0""")
def json_leaf_counts(spark: SparkSession, d: str) -> DataFrame:
    """Objects and scalar leaves of each document, at any depth, and the sum of the leaves that are numbers."""
    notes = spread(load(spark, d, "tripmaster").select("row_id", "LosQuestions"), "row_id")
    nodes = nested.emit_nodes(notes, "tripmaster", "row_id", "LosQuestions")
    values = F.from_json("payload", "map<string,string>")
    leaves = F.coalesce(values, F.create_map().cast("map<string,string>"))
    # as text a number and a string that looks like one are alike, so quoted strings are taken out first
    bare = F.regexp_replace("payload", r'"(?:[^"\\\\]|\\\\.)*"', "")
    numbers = F.aggregate(F.regexp_extract_all(bare, F.lit(r"[-+.eE0-9]*[0-9][-+.eE0-9]*"), F.lit(0)), F.lit(0.0), lambda s, x: s + F.coalesce(x.try_cast("double"), F.lit(0.0)))
    counts = nodes.select("row_id", F.col("kind"), F.size(F.map_keys(leaves)).alias("leaves"), numbers.alias("number"))
    return counts.groupBy("row_id").agg(F.count_if(F.col("kind") != "value").alias("objects"), F.sum("leaves").alias("leaves"), F.round(F.sum("number"), 6).alias("number_sum"))


@R.query("""SELECT o_orderpriority, CAST(r AS DOUBLE) AS rate, CAST(count(*) * r AS DOUBLE) AS converted FROM orders, (SELECT unnest([0.05, 0.1, 0.2]) AS r) GROUP BY o_orderpriority, r""")
def conversion_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    n = load(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    rates = n.select("o_orderpriority", "n", F.explode(F.array(*[F.lit(x) for x in (0.05, 0.1, 0.2)])).alias("rate"))
    return rates.select("o_orderpriority", "rate", F.round(F.col("n") * F.col("rate"), 2).alias("converted"))


@R.query("""SELECT p_partkey, CAST(CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN p_size * 60 + 30 ELSE p_size * 60 + 30.5 END AS DOUBLE) AS minutes FROM part""")
def elapsed_minutes(spark: SparkSession, d: str) -> DataFrame:
    s, k = F.col("p_size").cast("string"), F.col("p_partkey") % 3
    t = F.when(k == 0, s).when(k == 1, F.concat(s, F.lit(":30"))).otherwise(F.concat(s, F.lit(":30:30")))
    return load(spark, d, "part").select("p_partkey", expr.minutes(t).alias("minutes"))


@R.query("""SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'Texas' WHEN n_nationkey % 3 = 1 THEN 'Saint ' || upper(n_name[1]) || lower(split_part(n_name, ' ', 1)[2:]) ELSE upper(n_name[1]) || lower(split_part(n_name, ' ', 1)[2:]) END AS place FROM nation""")
def place_names(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("n_nationkey") % 3, F.substring_index("n_name", " ", 1)
    raw = F.when(k == 0, F.lit(" tx ")).when(k == 1, F.concat(F.lit("ST. "), n)).otherwise(F.concat(n, F.lit(" County")))
    return load(spark, d, "nation").select("n_nationkey", expr.title_place(raw, {"tx": "Texas"}).alias("place"))


@R.query("""WITH f AS (SELECT row_id, regexp_matches(lower(coalesce(ClinicalData, '')), 'bedbound|sit upright') AS a, regexp_matches(lower(coalesce(ClinicalData, '')), 'walker|wheelchair acceptable') AS b, length(coalesce(ClinicalData, '')) > 100 AS c FROM tripmaster)
            SELECT row_id, CASE WHEN a AND NOT b THEN 'supported' WHEN a AND b THEN 'conflicting' WHEN b THEN 'not supported' ELSE 'undetermined' END AS determination,
                   CAST(greatest(0.05, least(0.99, 0.5 + CASE WHEN a THEN 0.3 ELSE 0 END - CASE WHEN b THEN 0.3 ELSE 0 END + CASE WHEN c THEN 0.2 ELSE 0 END)) AS DOUBLE) AS confidence FROM f""")
def determination(spark: SparkSession, d: str) -> DataFrame:
    t = F.lower(F.coalesce("ClinicalData", F.lit("")))
    a, b, c = t.rlike("bedbound|sit upright"), t.rlike("walker|wheelchair acceptable"), F.length(F.coalesce("ClinicalData", F.lit(""))) > 100
    verdict = expr.first_match([(a & ~b, "supported"), (a & b, "conflicting"), (b, "not supported")], "undetermined")
    score = F.lit("0.5").cast("decimal(4,2)") + F.when(a, F.lit("0.3").cast("decimal(4,2)")).otherwise(0) - F.when(b, F.lit("0.3").cast("decimal(4,2)")).otherwise(0) + F.when(c, F.lit("0.2").cast("decimal(4,2)")).otherwise(0)
    clamp = F.greatest(F.lit("0.05").cast("decimal(4,2)"), F.least(F.lit("0.99").cast("decimal(4,2)"), score))
    return load(spark, d, "tripmaster").select("row_id", verdict.alias("determination"), clamp.cast("double").alias("confidence"))


@R.query("""WITH links AS (SELECT DISTINCT upper(trim(pr1)) AS pr1, upper(trim(pr2)) AS pr2 FROM anm_training_data_matches WHERE label = 1 AND upper(trim(pr1)) <> upper(trim(pr2))),
            p AS (SELECT party_id, min(dob) AS dob, min(lastName) AS lastName FROM rpt_bronze_party GROUP BY 1)
            SELECT pr1, pr2, a.dob AS dob_1, a.lastName AS lastName_1, b.dob AS dob_2, b.lastName AS lastName_2 FROM links JOIN p a ON pr1 = a.party_id JOIN p b ON pr2 = b.party_id""")
def pair_assembly(spark: SparkSession, d: str) -> DataFrame:
    p = person(spark, d).select("party_id", "dob", "lastName")
    j = links(spark, d).join(joins.suffixed(p, "_1"), F.col("pr1") == F.col("party_id_1")).join(joins.suffixed(p, "_2"), F.col("pr2") == F.col("party_id_2"))
    return j.drop("party_id_1", "party_id_2")


@R.query("SELECT * EXCLUDE (c_acctbal) FROM customer")
def star_except(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "customer").drop("c_acctbal")


@R.query("SELECT o_orderkey, unnest(x) AS x FROM (SELECT l_orderkey AS o_orderkey, list(l_linenumber) AS x FROM lineitem GROUP BY 1)")
def explode_arrays(spark: SparkSession, d: str) -> DataFrame:
    lists = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list("l_linenumber").alias("x"))
    return schema.explode_all(lists)


_NINE = "regexp_matches({c}, '^\\s*\\d{{9,10}}\\s*$')"


@R.query(f"""WITH s AS (SELECT {", ".join(f"avg(CAST({_NINE.format(c=c)} AS INTEGER)) AS {c}" for c in ("cob", "fin", "lastName"))} FROM rpt_bronze_party),
            u AS (SELECT unnest(['cob', 'fin', 'lastName']) AS physical, unnest([cob, fin, lastName]) AS share FROM s)
            SELECT 'party_id' AS logical, 'party_id' AS physical UNION ALL SELECT 'birth', 'dob' UNION ALL SELECT 'licence', 'driversLicense' UNION ALL SELECT 'eye_colour', NULL
            UNION ALL SELECT 'nine_digits', (SELECT physical FROM u WHERE share > 0 ORDER BY share DESC LIMIT 1)""")
def column_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Columns found by name, and one by what its values look like."""
    df = load(spark, d, "rpt_bronze_party")
    names = {"party_id": ["party_id"], "birth": ["date_of_birth", "DOB"], "licence": ["drivers_license"], "eye_colour": ["eye"]}
    rows = list(schema.resolve(df.columns, names).items()) + [("nine_digits", schema.by_content(df, ["cob", "fin", "lastName"], r"^\s*\d{9,10}\s*$"))]
    return spark.createDataFrame(rows, "logical string, physical string")


@R.query("""SELECT l_orderkey, round(sum(l_extendedprice), 2) AS total, round(sum(l_extendedprice) + CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END, 2) AS subtotal, l_orderkey % 5 <> 0 AS ok FROM lineitem GROUP BY l_orderkey""")
def block_reconciliation(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").select("l_orderkey", F.col("l_extendedprice").alias("amount"), F.lit(False).alias("is_sub"))
    sub = li.groupBy("l_orderkey").agg((F.sum("amount") + F.when(F.col("l_orderkey") % 5 == 0, 1.0).otherwise(0.0)).alias("amount")).withColumn("is_sub", F.lit(True))
    out = text.reconcile_blocks(li.unionByName(sub), "l_orderkey", "amount", F.col("is_sub"))
    return out.select("l_orderkey", F.round("total", 2).alias("total"), F.round("subtotal", 2).alias("subtotal"), "ok")


@R.query("SELECT 'new' AS version, count(*) AS n FROM nation")
def newest_file(spark: SparkSession, d: str) -> DataFrame:
    path = Stage(spark, "newest").path
    df = load(spark, d, "nation").coalesce(1)
    for version in ("old", "new"):
        df.withColumn("version", F.lit(version)).write.mode("append").parquet(f"{path}/{version}")
    found = io.newest_file(spark, f"{path}/*", "*.parquet")
    return spark.read.parquet(found).groupBy("version").agg(F.count(F.lit(1)).alias("n"))


@R.query("SELECT doc_id, count(*) AS records FROM (SELECT doc_id, unnest(regexp_extract_all(replace(text, chr(13), ''), '(ERROR|WARN|baseline) ')) FROM documents WHERE source = 'search_log') GROUP BY 1")
def log_records(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents").filter("source = 'search_log'").select("doc_id", F.replace("text", F.lit("\r"), F.lit("")).alias("text"))
    return text.log_records(docs, "text", "(?:ERROR|WARN|baseline) ").groupBy("doc_id").agg(F.count(F.lit(1)).alias("records"))


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "rpt_bronze_party", "mv_es_party_identity", "tripmaster")


@R.query(f"""SELECT table_name, column_name FROM information_schema.columns WHERE table_name IN ({", ".join(f"'{t}'" for t in _TABLES)}) AND regexp_matches(lower(column_name), 'date|_at$|_id$')""")
def metadata_scan(spark: SparkSession, d: str) -> DataFrame:
    """Columns of the catalog by what their names hold, over all tables."""
    views = {f"weft_scan_{t}": t for t in _TABLES}
    for view, t in views.items():
        load(spark, d, t).createOrReplaceTempView(view)
    rows = [(views[v], c) for v, c, _ in io.find_columns(spark, "date|_at$|_id$") if v in views]
    for view in views:
        spark.catalog.dropTempView(view)
    return spark.createDataFrame(rows, "table_name string, column_name string")


@R.query("SELECT o_orderstatus, o_totalprice, o_orderkey FROM orders WHERE o_totalprice > 400000")
def materialized_reuse(spark: SparkSession, d: str) -> DataFrame:
    """The second request for the same columns reads the copy written by the first."""
    folder, columns = Stage(spark, "cache").path, ["o_orderkey", "o_orderstatus", "o_totalprice"]
    for _ in range(2):
        df = io.materialized(load(spark, d, "orders"), folder, columns, f"{d}/orders")
    return df.filter("o_totalprice > 400000")


@R.query("SELECT 'nation' AS artefact, count(*) AS n_rows FROM nation UNION ALL SELECT 'region', count(*) FROM region")
def csv_manifest(spark: SparkSession, d: str) -> DataFrame:
    frames = {n: load(spark, d, n) for n in ("nation", "region")}
    return io.write_csv_with_manifest(frames, Stage(spark, "manifest").path).select("artefact", "n_rows")


@R.query("SELECT seed, count(*) AS n, count(extra) AS with_extra FROM (SELECT 1 AS seed, NULL AS extra FROM region UNION ALL SELECT 2, r_name FROM region) GROUP BY 1")
def append_evolving(spark: SparkSession, d: str) -> DataFrame:
    path = Stage(spark, "append").path
    region = load(spark, d, "region")
    io.append_evolving(region, path, "2025-01-01 00:00:00", 1)
    io.append_evolving(region.withColumn("extra", F.col("r_name")), path, "2025-01-02 00:00:00", 2)
    return spark.read.option("mergeSchema", "true").parquet(path).groupBy("seed").agg(F.count(F.lit(1)).alias("n"), F.count("extra").alias("with_extra"))


@R.query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Hourly windows of the events as a stream: file source, watermark, checkpoint, Parquet sink."""
    stage = Stage(spark, "stream")
    source = load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    src, out = f"{stage.path}/source", f"{stage.path}/out"
    source.write.parquet(src)
    events = spark.readStream.schema(source.schema).parquet(src)
    counted = streams.windowed(events, "ts", "event_type", "value", "1 hour", "10 minutes")

    def sink(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    streams.run_available(counted, sink, f"{stage.path}/checkpoint", "complete").awaitTermination()
    done = spark.read.parquet(out)
    return done.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("mean", 6).alias("mean"))


@R.query("SELECT p_brand, count(*) AS n, round(sum(p_retailprice), 2) AS price FROM part GROUP BY 1")
def map_in_pandas(spark: SparkSession, d: str) -> DataFrame:
    """Partial sums per batch in pandas, merged in the JVM."""

    def partial(b):
        return b.groupby("p_brand", as_index=False).agg(n=("p_retailprice", "size"), price=("p_retailprice", "sum"))

    parts = mapping.map_partitions(load(spark, d, "part").select("p_brand", "p_retailprice"), partial, "p_brand string, n long, price double")
    return parts.groupBy("p_brand").agg(F.sum("n").alias("n"), F.round(F.sum("price"), 2).alias("price"))


QUERIES, SQL = R.QUERIES, R.SQL
