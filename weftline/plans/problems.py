"""The pN_ queries of the general problems (1, 3, 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import keyed, nested, profile
from weftline.runtime import Stage, load, spread

P1_FIELDS = ["dateOfBirth", "aNumber", "ssn", "countryOfBirth", "receiptNumber", "recordStatus"]
P1_FORMS = [f for f in P1_FIELDS if f != "recordStatus"]
NOTES = "ClinicalData"


def _cells(spark: SparkSession, d: str, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """(party documents with their top-level keys, cells of both tables)."""
    docs = profile.json_fields(spread(load(spark, d, "elasticdump_parties").select("row_id", "load_id", "load_ts", "_source"), "row_id"), "_source", P1_FIELDS, ["row_id", "load_id", "load_ts"])
    docs = stage.write(docs, "fields")
    keys = ["row_id", "load_id", "load_ts"]
    cells = profile.unpivot(docs.filter("state = 'read'"), "elasticdump_parties", keys, P1_FIELDS)
    notes = profile.unpivot(load(spark, d, "tripmaster"), "tripmaster", keys, [NOTES])
    return docs, cells.unionByName(notes)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    stage = Stage(spark, "p1")
    docs, cells = _cells(spark, d, stage)
    counts = stage.write(profile.value_counts(cells, [NOTES]), "counts")
    totals = stage.write(profile.load_totals(counts), "totals")
    modal = stage.write(profile.modal_forms(counts, P1_FORMS), "modal")
    fields = cells.filter(F.col("src_table") == "elasticdump_parties")

    def items(df: DataFrame, finding: str) -> DataFrame:
        return df.select("src_table", "field_name", F.lit(finding).alias("finding"), F.col("row_id").cast("string").alias("item_key"))

    unreadable = docs.filter("state = 'unreadable'").select(F.lit("elasticdump_parties").alias("src_table"), F.lit("_source").alias("field_name"), "row_id")
    controls = cells.filter((F.col("field_name") == NOTES) & profile.is_filled(F.col("value")) & F.col("value").rlike(profile.CONTROL))
    mixes = profile.by_value(counts.filter(F.col("field_name").isin("recordStatus", "countryOfBirth")), ["src_table", "field_name", "value", "filled"])
    loads = profile.load_findings(totals, profile.drift(mixes, totals), ["recordStatus", "countryOfBirth"], [NOTES])
    return (
        items(unreadable, "unreadable")
        .unionByName(items(profile.form_cases(fields, modal), "form"))
        .unionByName(items(controls, "form"))
        .unionByName(items(profile.date_range_cases(fields, modal, "dateOfBirth", "1900-01-01"), "range"))
        .unionByName(loads.select("src_table", "field_name", "finding", F.col("load_id").cast("string").alias("item_key")))
    )


def p1_profile(spark: SparkSession, d: str) -> DataFrame:
    """Every field and load: all fields found in _source, at any depth, and the notes."""
    stage = Stage(spark, "p1")
    docs = spread(load(spark, d, "elasticdump_parties").select("row_id", "load_id", "_source"), "row_id")
    parties = profile.with_absent(stage.write(profile.json_counts(docs, "elasticdump_parties", "_source", P1_FIELDS), "values"), stage.write)
    notes = profile.value_counts(profile.unpivot(load(spark, d, "tripmaster"), "tripmaster", ["row_id", "load_id", "load_ts"], [NOTES]), [NOTES])
    notes = stage.write(profile.by_value(notes, ["src_table", "field_name", "value", "filled", "chars", "control"]), "notes")
    return profile.profile(parties.unionByName(notes.withColumn("nested", F.lit(False)), allowMissingColumns=True), [NOTES], stage.write)


def _nodes(spark: SparkSession, d: str, with_payload: bool) -> DataFrame:
    stage = Stage(spark, "p3")
    parties = nested.emit_nodes(spread(load(spark, d, "elasticdump_parties").select("row_id", "_source"), "row_id"), "elasticdump_parties", "row_id", "_source", with_payload)
    trips = nested.emit_nodes(spread(load(spark, d, "tripmaster").select("row_id", "LosQuestions"), "row_id"), "tripmaster", "row_id", "LosQuestions", with_payload)
    return nested.settle(stage.write(parties.unionByName(trips), "nodes"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d, False).filter("kind = 'element'").select("src_table", "row_id", "node_path", "parent_path")


def p3_tables(spark: SparkSession, d: str) -> DataFrame:
    """Every object with its table (tag), keys and scalar values, and every scalar in a list (kind 'value')."""
    return _nodes(spark, d, True)


def _flat(spark: SparkSession, d: str, table: str, tag: str, fields: dict[str, str]) -> DataFrame:
    """All flat tables written by tag, one of them read back with its schema."""
    path = f"{Stage(spark, 'p3').path}/tables"
    nested.write_tables(_nodes(spark, d, True), path)
    return nested.read_table(spark, path, table, tag, fields)


def p3_receipts(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of the receipts in the party documents."""
    return _flat(spark, d, "elasticdump_parties", "receipts", {"receiptNumber": "string", "form": "string"})


def p3_issuances(spark: SparkSession, d: str) -> DataFrame:
    """The flat table two lists down, each row with the path of the identifier it belongs to."""
    return _flat(spark, d, "elasticdump_parties", "identifiers.issuances", {"date": "date"}).withColumnRenamed("date", "issued")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    def heavy(table: str, key: str) -> DataFrame:
        return keyed.heavy_keys(load(spark, d, table), key).select(F.lit(table).alias("src_table"), "key_value")

    return heavy("mv_es_party_identity", "identity_id").unionByName(heavy("anm_training_data_matches", "identityid"))


def p4_identity_summary(spark: SparkSession, d: str) -> DataFrame:
    return keyed.key_summary(load(spark, d, "mv_es_party_identity"), "identity_id", ["party_id"], "linked_at")


def p4_latest_matches(spark: SparkSession, d: str) -> DataFrame:
    """The three latest distinct matches of each identity, hot identities included."""
    matches = load(spark, d, "anm_training_data_matches")
    rows = matches.filter("identityid is not null").distinct()
    order = [F.col("matched_at").desc_nulls_last(), F.col("pr1").asc_nulls_last(), F.col("pr2").asc_nulls_last(), F.col("label").asc_nulls_last()]
    return keyed.top_per_key(rows, "identityid", order, 3, matches.count()).select("identityid", "rank", "pr1", "pr2", "label", "matched_at")


QUERIES = {
    "p1_found": p1_found,
    "p1_profile": p1_profile,
    "p3_found": p3_found,
    "p3_tables": p3_tables,
    "p3_receipts": p3_receipts,
    "p3_issuances": p3_issuances,
    "p4_found": p4_found,
    "p4_identity_summary": p4_identity_summary,
    "p4_latest_matches": p4_latest_matches,
}

#: A value without white space around it.
_TRIMMED = "regexp_replace(value, '^[\\s\\p{Z}\\x1c-\\x1f\\x{85}]+|[\\s\\p{Z}\\x1c-\\x1f\\x{85}]+$', '', 'g')"

def strict_sql(s: str) -> str:
    """Well-formed JSON: the engine lets trailing commas and NaN pass, so they are looked for outside of strings."""
    return rf"""(json_valid({s}) AND NOT regexp_matches(regexp_replace({s}, '"(\\.|[^"\\])*"', '""', 'g'), '(?i),\s*[\]}}]|nan|inf'))"""


def docs_sql(table: str, column: str, carry: str = "row_id") -> str:
    """CTE docs (carry, j): the well-formed JSON of a column; text inside a JSON string counts as that JSON."""
    inner = "CASE WHEN json_type(s) = 'VARCHAR' THEN json_extract_string(s, '$') ELSE s END"
    return f"""t0 AS (SELECT {carry}, {column} AS s FROM {table} WHERE {strict_sql(column)}),
    t1 AS (SELECT * REPLACE (CASE WHEN json_type(s) = 'VARCHAR' AND {strict_sql("json_extract_string(s, '$')")} THEN {inner} ELSE s END AS s) FROM t0),
    t2 AS (SELECT * REPLACE (CASE WHEN json_type(s) = 'VARCHAR' AND {strict_sql("json_extract_string(s, '$')")} THEN {inner} ELSE s END AS s) FROM t1),
    docs AS (SELECT {carry}, CAST(s AS JSON) AS j FROM t2)"""


_DOCS = docs_sql("elasticdump_parties", "_source")


def _elements(holder: str, path: str, key: str, parent: str) -> str:
    """Elements that are objects in the list, or the lone object, under a key of holder's column j."""
    return f"""SELECT row_id, {path} || '.{key}[' || i || ']' AS node_path, {parent} AS parent_path, x AS j FROM (
      SELECT *, CASE WHEN json_type(l) = 'OBJECT' THEN l ELSE json_extract(l, '$[' || i || ']') END AS x FROM (
        SELECT *, unnest(range(CAST(CASE json_type(l) WHEN 'ARRAY' THEN json_array_length(l) WHEN 'OBJECT' THEN 1 ELSE 0 END AS BIGINT))) AS i
        FROM (SELECT *, json_extract(j, '$.{key}') AS l FROM {holder}))) WHERE json_type(x) = 'OBJECT'"""


def _p3_sql(whole: bool) -> str:
    """Elements of lists by two walks: one finds the places that hold lists of objects, one writes the paths. whole: all
    objects and scalars in lists, with payloads."""
    inner = "json_extract_string(s, '$')"
    unwrap = f"CASE WHEN json_type(s) = 'VARCHAR' AND {strict_sql(inner)} THEN {inner} ELSE s END"
    keys = "CASE json_type(j) WHEN 'OBJECT' THEN json_keys(j) WHEN 'ARRAY' THEN list_transform(range(CAST(json_array_length(j) AS BIGINT)), lambda i: CAST(i AS VARCHAR)) ELSE [] END"
    at = "json_extract(j, '$.\"' || k || '\"')"
    kids, child = f"unnest({keys}) AS k", f"CASE WHEN json_type(j) = 'OBJECT' THEN {at} ELSE json_extract(j, '$[' || k || ']') END AS x"
    keyed_by = "json_type(j) = 'OBJECT'"
    tag = f"CASE WHEN {keyed_by} AND k <> last_key THEN (CASE WHEN tag = '' THEN k ELSE tag || '.' || k END) ELSE tag END"
    last = f"CASE WHEN {keyed_by} THEN k ELSE last_key END"
    scalars = "list_filter(json_keys(j), lambda k: json_type(json_extract(j, '$.\"' || k || '\"')) NOT IN ('OBJECT', 'ARRAY'))"
    payload = f"""CASE WHEN json_type(j) = 'OBJECT' THEN '{{' || array_to_string(list_transform({scalars}, lambda k: '"' || k || '":' || CAST({at} AS VARCHAR)), ',') || '}}' ELSE '{{"value":' || CAST(j AS VARCHAR) || '}}' END"""
    also = " OR (NOT is_key AND json_type(x) NOT IN ('OBJECT', 'ARRAY'))" if whole else ""
    kind = "CASE WHEN json_type(j) NOT IN ('OBJECT', 'ARRAY') THEN 'value' WHEN root THEN 'root' WHEN element THEN 'element' ELSE 'object' END"
    out = (
        f"SELECT src_table, row_id, tag || CASE WHEN json_type(j) NOT IN ('OBJECT', 'ARRAY') AND NOT root THEN '[]' ELSE '' END AS tag, {kind} AS kind, path AS node_path, parent AS parent_path, {payload} AS payload FROM nodes WHERE json_type(j) <> 'ARRAY'"
        if whole else "SELECT src_table, row_id, path AS node_path, parent AS parent_path FROM nodes WHERE element"
    )
    return f"""WITH RECURSIVE t0 AS (SELECT 'elasticdump_parties' AS src_table, row_id, _source AS s FROM elasticdump_parties WHERE {strict_sql("_source")}
            UNION ALL SELECT 'tripmaster', row_id, LosQuestions FROM tripmaster WHERE {strict_sql("LosQuestions")}),
        docs AS (SELECT src_table, row_id, CAST({unwrap} AS JSON) AS j FROM (SELECT src_table, row_id, {unwrap} AS s FROM t0)),
        walk AS (SELECT src_table, row_id, j, '' AS tag, '' AS last_key, 'root' AS place FROM docs
            UNION ALL SELECT src_table, row_id, x, {tag}, {last}, CASE WHEN {keyed_by} THEN 'key' ELSE 'list' END
            FROM (SELECT *, {child} FROM (SELECT *, {kids} FROM walk)) WHERE json_type(x) IN ('OBJECT', 'ARRAY')),
        tags AS (SELECT DISTINCT src_table, tag FROM walk WHERE place = 'list' AND json_type(j) = 'OBJECT'),
        nodes AS (SELECT src_table, row_id, j, '' AS tag, '' AS last_key, '$' AS path, '$' AS parent, '$' AS holder, false AS element, true AS root FROM docs
            UNION ALL SELECT src_table, row_id, x, new_tag, new_last, CASE WHEN element AND is_key THEN p || '[0]' ELSE p END, holder,
                             CASE WHEN element AND is_key THEN p || '[0]' WHEN element THEN p ELSE holder END, element, false
            FROM (SELECT c.*, p, json_type(x) = 'OBJECT' AND (NOT is_key OR t.tag IS NOT NULL) AS element
                  FROM (SELECT src_table, row_id, x, holder, {keyed_by} AS is_key, {tag} AS new_tag, {last} AS new_last, path || CASE WHEN {keyed_by} THEN '.' || k ELSE '[' || k || ']' END AS p
                        FROM (SELECT *, {child} FROM (SELECT *, {kids} FROM nodes))) c
                  LEFT JOIN tags t ON t.src_table = c.src_table AND t.tag = c.new_tag WHERE json_type(x) IN ('OBJECT', 'ARRAY'){also}))
        {out}"""


def _p1_profile_sql() -> str:
    """The profile from a walk over all containers; distributions are compared on the grid of loads and values."""
    kids = "unnest(CASE json_type(v) WHEN 'OBJECT' THEN json_keys(v) WHEN 'ARRAY' THEN list_transform(range(CAST(json_array_length(v) AS BIGINT)), lambda i: CAST(i AS VARCHAR)) ELSE [] END) AS k"
    child = "CASE WHEN obj THEN json_extract(v, '$.\"' || k || '\"') ELSE json_extract(v, '$[' || k || ']') END AS x, CASE WHEN place = '' THEN k ELSE place || '.' || k END AS f"
    children = f"(SELECT *, json_type(x) IN ('OBJECT', 'ARRAY') AS nested FROM (SELECT *, {child} FROM (SELECT *, json_type(v) = 'OBJECT' AS obj, {kids} FROM box)))"
    text = "CASE json_type(x) WHEN 'NULL' THEN NULL WHEN 'VARCHAR' THEN json_extract_string(x, '$') ELSE CAST(x AS VARCHAR) END"
    plain = ", ".join(f"'{f}'" for f in P1_FIELDS)
    form = "regexp_replace(regexp_replace(regexp_replace(value, '\\p{Nd}', '9', 'g'), '\\p{Lu}', 'A', 'g'), '\\p{Ll}', 'a', 'g')"
    return f"""WITH RECURSIVE {docs_sql("elasticdump_parties", "_source", "row_id, load_id")},
        box AS (SELECT load_id, j AS v, CASE WHEN json_type(j) = 'OBJECT' THEN '' ELSE '$' END AS place, '' AS last_key, '$[]' AS name FROM docs WHERE json_type(j) IN ('OBJECT', 'ARRAY')
            UNION ALL SELECT load_id, x, CASE WHEN obj AND k <> last_key THEN f ELSE place END, CASE WHEN obj THEN k ELSE last_key END,
                             CASE WHEN obj THEN f || '[]' WHEN json_type(x) = 'ARRAY' THEN name || '[]' ELSE name END FROM {children} WHERE nested),
        held AS (SELECT load_id, holder, count(*) AS n FROM (SELECT load_id, '' AS holder FROM docs UNION ALL SELECT load_id, place FROM box WHERE json_type(v) = 'OBJECT' AND place <> ''
            UNION ALL SELECT load_id, name FROM {children} WHERE NOT obj AND NOT nested) GROUP BY ALL),
        found AS (SELECT load_id, '' AS holder, '$' AS field_name, {text} AS value, json_type(x) = 'ARRAY' AS nested FROM (SELECT load_id, j AS x FROM docs) WHERE json_type(x) <> 'OBJECT'
            UNION ALL SELECT load_id, place, f, {text}, nested AND f NOT IN ({plain}) FROM {children} WHERE obj
            UNION ALL SELECT load_id, name, name, {text}, false FROM {children} WHERE NOT obj AND NOT nested),
        whole_rows AS (SELECT 'elasticdump_parties' AS src_table, field_name, load_id, n AS n_rows FROM (SELECT DISTINCT holder, field_name FROM found) JOIN held USING (holder)
            UNION ALL SELECT 'tripmaster', 'ClinicalData', load_id, count(*) FROM tripmaster GROUP BY load_id),
        cells AS (SELECT 'elasticdump_parties' AS src_table, field_name, load_id, value, nested, length(value) AS chars, CAST(NULL AS BOOLEAN) AS control FROM found WHERE {_TRIMMED} <> ''
            UNION ALL SELECT 'tripmaster', 'ClinicalData', load_id, sha256(value), false, length(value), regexp_matches(value, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{{9f}}\\x{{fffd}}]')
            FROM (SELECT load_id, ClinicalData AS value FROM tripmaster) WHERE {_TRIMMED} <> ''),
        vals AS (SELECT src_table, field_name, load_id, value, nested, any_value(chars) AS chars, count(*) AS c, count(control) AS marked, count(*) FILTER (control) AS controls FROM cells GROUP BY ALL),
        figures AS (SELECT src_table, field_name, load_id, sum(c) AS f, count(DISTINCT value) AS d, min(value) FILTER (NOT nested) AS lo, max(value) FILTER (NOT nested) AS hi, min(chars) AS lo_c, max(chars) AS hi_c, sum(chars * c) AS chars, max(c) AS top,
                           CASE WHEN sum(marked) > 0 THEN sum(controls) END AS controls FROM vals GROUP BY ALL),
        shapes AS (SELECT src_table, field_name, load_id, {form} AS form, sum(c) AS c FROM vals WHERE NOT nested AND src_table <> 'tripmaster' GROUP BY ALL),
        modal AS (SELECT src_table, field_name, form AS modal_form FROM (SELECT src_table, field_name, form, sum(c) AS c FROM shapes GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY src_table, field_name ORDER BY c DESC, form) = 1),
        shaped AS (SELECT src_table, field_name, load_id, c AS n_in_form FROM shapes JOIN modal USING (src_table, field_name) WHERE form = modal_form),
        overall AS (SELECT src_table, field_name, value, sum(c) AS a FROM vals GROUP BY ALL), filled AS (SELECT src_table, field_name, sum(a) AS n FROM overall GROUP BY ALL),
        counted AS (SELECT src_table, field_name, load_id, value, sum(c) AS c FROM vals GROUP BY ALL),
        moved AS (SELECT g.src_table, g.field_name, g.load_id, sum(abs(coalesce(c.c, 0) / g.f - o.a / n.n)) / 2 AS tv,
                         sum((coalesce(c.c, 0) - o.a * g.f / n.n) ** 2 / (o.a * g.f / n.n)) AS chi2,
                         sum(((coalesce(c.c, 0) + 0.5) / (g.f + 0.5) - (o.a + 0.5) / (n.n + 0.5)) * ln(((coalesce(c.c, 0) + 0.5) / (g.f + 0.5)) / ((o.a + 0.5) / (n.n + 0.5)))) AS psi
                  FROM figures g JOIN filled n USING (src_table, field_name) JOIN overall o USING (src_table, field_name)
                  LEFT JOIN counted c ON c.src_table = g.src_table AND c.field_name = g.field_name AND c.load_id = g.load_id AND c.value = o.value GROUP BY ALL)
        SELECT src_table, field_name, load_id, n_rows, CAST(coalesce(f, 0) AS BIGINT) AS n_filled, round(1 - coalesce(f, 0) / n_rows, 6) AS null_rate, coalesce(d, 0) AS n_distinct, lo AS min_value, hi AS max_value, lo_c AS min_chars, hi_c AS max_chars,
               round(chars / f, 6) AS mean_chars, top AS n_most_frequent, CAST(controls AS BIGINT) AS n_control, modal_form, CAST(coalesce(n_in_form, 0) AS BIGINT) AS n_in_form, round(tv, 6) AS total_variation, round(psi, 6) AS psi, round(chi2, 6) AS chi2
        FROM whole_rows LEFT JOIN figures USING (src_table, field_name, load_id) LEFT JOIN moved USING (src_table, field_name, load_id) LEFT JOIN shaped USING (src_table, field_name, load_id) LEFT JOIN modal USING (src_table, field_name)"""


SQL = {
    "p1_found": f"""
        WITH {docs_sql("elasticdump_parties", "_source", "row_id, load_id, load_ts")},
        raw AS (SELECT 'elasticdump_parties' AS src_table, row_id, load_id, load_ts, unnest([{", ".join(f"'{f}'" for f in P1_FIELDS)}]) AS field_name,
                       unnest([{", ".join(f"json_extract_string(j, '$.{f}')" for f in P1_FIELDS)}]) AS value FROM docs
                UNION ALL SELECT 'tripmaster', row_id, load_id, load_ts, 'ClinicalData', ClinicalData FROM tripmaster),
        cells AS (SELECT *, coalesce({_TRIMMED} <> '', false) AS filled FROM raw),
        shaped AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(value, '\\p{{Nd}}', '9', 'g'), '\\p{{Lu}}', 'A', 'g'), '\\p{{Ll}}', 'a', 'g') AS form FROM cells WHERE filled AND src_table = 'elasticdump_parties' AND field_name <> 'recordStatus'),
        modal AS (SELECT field_name, form AS modal FROM shaped GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY field_name ORDER BY count(*) DESC, form) = 1),
        loads AS (SELECT src_table, field_name, load_id, count(*) AS n, count(*) FILTER (filled) AS f, coalesce(sum(length(value)) FILTER (filled), 0) AS c FROM cells GROUP BY ALL),
        whole AS (SELECT src_table, field_name, sum(n) AS na, sum(f) AS fa, sum(c) AS ca FROM loads GROUP BY ALL),
        both_of AS (SELECT * FROM loads JOIN whole USING (src_table, field_name)),
        vals AS (SELECT src_table, field_name, value, load_id, count(*) AS k FROM cells WHERE filled AND field_name IN ('recordStatus', 'countryOfBirth') GROUP BY ALL),
        all_vals AS (SELECT src_table, field_name, value, sum(k) AS ka FROM vals GROUP BY ALL),
        mix AS (SELECT b.src_table, b.field_name, b.load_id FROM both_of b JOIN all_vals a USING (src_table, field_name) LEFT JOIN vals v ON v.field_name = a.field_name AND v.value = a.value AND v.load_id = b.load_id
                WHERE b.f > 0 GROUP BY ALL HAVING 2 * sum(abs(coalesce(v.k, 0) * b.fa - a.ka * b.f)) > any_value(b.f * b.fa))
        SELECT 'elasticdump_parties' AS src_table, '_source' AS field_name, 'unreadable' AS finding, CAST(row_id AS VARCHAR) AS item_key FROM elasticdump_parties WHERE _source IS NOT NULL AND NOT coalesce({strict_sql("_source")}, false)
        UNION ALL SELECT src_table, field_name, 'form', CAST(row_id AS VARCHAR) FROM shaped JOIN modal USING (field_name) WHERE form <> modal
        UNION ALL SELECT src_table, field_name, 'form', CAST(row_id AS VARCHAR) FROM cells WHERE src_table = 'tripmaster' AND filled AND regexp_matches(value, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{{9f}}\\x{{fffd}}]')
        UNION ALL SELECT src_table, field_name, 'range', CAST(row_id AS VARCHAR) FROM shaped JOIN modal USING (field_name) WHERE field_name = 'dateOfBirth' AND form = modal AND modal = '9999-99-99'
          AND (try_cast(value AS DATE) IS NULL OR try_cast(value AS DATE) < DATE '1900-01-01' OR try_cast(value AS DATE) > CAST(load_ts AS DATE))
        UNION ALL SELECT src_table, field_name, 'null_rate', CAST(load_id AS VARCHAR) FROM both_of WHERE 5 * abs(f * na - fa * n) > n * na
        UNION ALL SELECT src_table, field_name, 'mean_length', CAST(load_id AS VARCHAR) FROM both_of WHERE src_table = 'tripmaster' AND f > 0 AND 4 * abs(c * fa - ca * f) > ca * f
        UNION ALL SELECT src_table, field_name, 'mix', CAST(load_id AS VARCHAR) FROM mix""",
    "p1_profile": _p1_profile_sql(),
    "p3_found": _p3_sql(False),
    "p3_tables": _p3_sql(True),
    "p3_receipts": f"""WITH {_DOCS}, r AS ({_elements("docs", "'$'", "receipts", "'$'")})
        SELECT row_id, node_path, parent_path, json_extract_string(j, '$.receiptNumber') AS receiptNumber, json_extract_string(j, '$.form') AS form FROM r""",
    "p3_issuances": f"""WITH {_DOCS}, i AS ({_elements("docs", "'$'", "identifiers", "'$'")}), e AS ({_elements("i", "node_path", "issuances", "node_path")})
        SELECT row_id, node_path, parent_path, TRY_CAST(json_extract_string(j, '$.date') AS DATE) AS issued FROM e""",
    "p4_found": """
        SELECT 'mv_es_party_identity' AS src_table, identity_id AS key_value FROM mv_es_party_identity
        WHERE identity_id IS NOT NULL GROUP BY identity_id
        HAVING count(*) * 50 >= (SELECT count(*) FROM mv_es_party_identity)
        UNION ALL
        SELECT 'anm_training_data_matches', identityid FROM anm_training_data_matches
        WHERE identityid IS NOT NULL GROUP BY identityid
        HAVING count(*) * 50 >= (SELECT count(*) FROM anm_training_data_matches)""",
    "p4_identity_summary": """
        SELECT identity_id, count(*) AS n_rows, min(linked_at) AS first_seen, max(linked_at) AS last_seen,
               count(DISTINCT party_id) AS n_party_id
        FROM mv_es_party_identity WHERE identity_id IS NOT NULL GROUP BY identity_id""",
    "p4_latest_matches": """
        SELECT identityid, rank, pr1, pr2, label, matched_at FROM (
          SELECT *, CAST(row_number() OVER (PARTITION BY identityid ORDER BY matched_at DESC NULLS LAST, pr1 ASC NULLS LAST,
                    pr2 ASC NULLS LAST, label ASC NULLS LAST) AS INTEGER) AS rank
          FROM (SELECT DISTINCT identityid, pr1, pr2, label, matched_at FROM anm_training_data_matches WHERE identityid IS NOT NULL))
        WHERE rank <= 3""",
}
