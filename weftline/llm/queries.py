"""The pN_ queries of the problems on training data (2, 5 to 9) and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import bpe, components, lookalike, mixing, pii, survivor
from weftline.functions.tables import small
from weftline.runtime import Stage, load, spread

P5_FIELDS = ["firstName", "middleName", "lastName", "dob", "cob", "anumber", "ssn", "fin", "driversLicense", "passport", "i94", "travel_doc"]


P2_FIELDS = ["ClinicalData", "SpecialNeeds"]


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return spread(load(spark, d, "tripmaster").select("row_id", *P2_FIELDS), "row_id")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(load(spark, d, "documents").select("doc_id", "text"), "doc_id")


def _p2_model(spark: SparkSession, d: str) -> tuple[pii.Texts, DataFrame, pii.Model]:
    stage, notes = Stage(spark, "p2"), _notes(spark, d)
    words = stage.write(pii.known_words(notes, P2_FIELDS, load(spark, d, "rpt_bronze_party"), ["firstName", "middleName"], ["lastName"], load(spark, d, "placeholder_values")), "words")
    texts = pii.with_known(notes, "row_id", P2_FIELDS, words)
    spans = stage.write(pii.find_spans(texts), "spans")
    return texts, spans, pii.fit_on(spans)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(*_p2_model(spark, d)[1:])


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    texts, _, model = _p2_model(spark, d)
    return pii.redact(texts, model)


def _p5_rows(spark: SparkSession, d: str) -> tuple[DataFrame, Column]:
    """Long rows of all records that have an identity, and the last day of the records."""
    records = load(spark, d, "rpt_bronze_party")
    wide = survivor.member_records(records, load(spark, d, "mv_es_party_identity"), load(spark, d, "source_trust"), P5_FIELDS)
    return survivor.long_rows(wide, load(spark, d, "placeholder_values"), P5_FIELDS), records.select(F.max(F.to_date("updated_at"))).scalar()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    best = survivor.best_records(*_p5_rows(spark, d))
    return best.filter("n_records >= 2 and dominates").select("identity_id", "record_id")


def p5_golden(spark: SparkSession, d: str) -> DataFrame:
    rows, last_day = _p5_rows(spark, d)
    return survivor.golden(rows, P5_FIELDS, last_day)


def _p6_labels(spark: SparkSession, d: str) -> DataFrame:
    links = load(spark, d, "anm_training_data_matches").filter("label = 1")
    return components.components(components.clean_edges(links, "pr1", "pr2"), Stage(spark, "p6"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _p6_labels(spark, d).select(F.col("vertex").alias("party_id"), F.col("component").alias("group_id"))


def p6_identity_span(spark: SparkSession, d: str) -> DataFrame:
    """Groups and the identities they reach: group_id, parties, identities among them."""
    labels = p6_found(spark, d)
    member = load(spark, d, "mv_es_party_identity").filter("identity_id is not null").select(F.upper(F.trim("party_id")).alias("party_id"), "identity_id").distinct()
    reached = labels.join(member, "party_id").select("group_id", "identity_id").distinct().groupBy("group_id").agg(F.count(F.lit(1)).alias("n_identities"))
    sizes = labels.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_parties"))
    return sizes.join(reached, "group_id", "left").select("group_id", "n_parties", F.coalesce("n_identities", F.lit(0)).alias("n_identities"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode(_texts(spark, d), "doc_id", "text", bpe.vocabulary(spark))


def _p8_mix(spark: SparkSession, d: str) -> tuple[DataFrame, list[mixing.Share]]:
    targets = load(spark, d, "mix_targets")
    docs = spread(load(spark, d, "documents").select("doc_id", "source", "text"), "doc_id").join(small(targets.select("source").distinct()), "source", "left_semi")
    sizes = mixing.with_hash(bpe.count_tokens(docs, "text", bpe.vocabulary(spark)), "doc_id", 8)
    sizes = Stage(spark, "p8").write(sizes, "sizes")
    shares = mixing.budgets(sizes, targets)
    mixing.find_thresholds(sizes, shares)
    return mixing.select(sizes, shares, spark), shares


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    return _p8_mix(spark, d)[0].select("doc_id", "source", "n_tokens", "copies")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    chosen, shares = _p8_mix(spark, d)
    return mixing.report(chosen, shares, spark)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    keys = Stage(spark, "p9").write(lookalike.keyed(_texts(spark, d), "doc_id", "text"), "keys")
    return lookalike.look_pairs(keys)


def p9_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every document in which something is seen, with the smallest document of the same look."""
    keys = Stage(spark, "p9").write(lookalike.keyed(_texts(spark, d), "doc_id", "text"), "keys")
    first = keys.groupBy("look").agg(F.min("doc_id").alias("class_id"))
    return keys.join(first, "look").select("doc_id", "class_id")


def p9_canonical(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", lookalike.canonical_form("text").alias("canonical"))


QUERIES = {
    "p2_found": p2_found,
    "p2_redacted": p2_redacted,
    "p5_found": p5_found,
    "p5_golden": p5_golden,
    "p6_found": p6_found,
    "p6_identity_span": p6_identity_span,
    "p7_ids": p7_ids,
    "p8_selection": p8_selection,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
    "p9_classes": p9_classes,
    "p9_canonical": p9_canonical,
}

_ENDS = r"^[\s\p{Z}\x1c-\x1f\x{85}]+|[\s\p{Z}\x1c-\x1f\x{85}]+$"
_trim = lambda c: f"regexp_replace({c}, '{_ENDS}', '', 'g')"

_P5_ROWS = f"""
    trust AS (SELECT source_system, min(trust_rank) AS trust_rank FROM source_trust GROUP BY source_system),
    hollow AS (SELECT DISTINCT field_name, upper({_trim("placeholder")}) AS p FROM placeholder_values),
    cells AS (""" + " UNION ALL ".join(
    f"SELECT record_id, party_id, updated_at, source_system, '{f}' AS field, {_trim(f)} AS value FROM rpt_bronze_party" for f in P5_FIELDS
) + f"""),
    long_rows AS (
      SELECT record_id, party_id, updated_at, coalesce(trust_rank, {survivor.NO_RANK}) AS trust_rank, field, value,
             CASE WHEN value <> '' AND h.p IS NULL THEN upper(value) END AS norm
      FROM cells LEFT JOIN trust USING (source_system) LEFT JOIN hollow h ON field = h.field_name AND upper(value) = h.p),
    member AS (SELECT DISTINCT identity_id, party_id FROM mv_es_party_identity WHERE identity_id IS NOT NULL AND party_id IS NOT NULL)"""

_P6_LABELS = f"""
    ends0 AS (SELECT upper({_trim("pr1")}) AS x, upper({_trim("pr2")}) AS y FROM anm_training_data_matches WHERE label = 1),
    ends AS (SELECT x AS a, y AS b FROM ends0 WHERE x <> '' AND y <> '' AND x <> y UNION SELECT y, x FROM ends0 WHERE x <> '' AND y <> '' AND x <> y),
    labels(party_id, group_id) USING KEY (party_id) AS (SELECT a, min(least(a, b)) FROM ends GROUP BY a
      UNION SELECT e.b, min(l.group_id) FROM labels l JOIN ends e ON l.party_id = e.a JOIN recurring.labels r ON r.party_id = e.b WHERE l.group_id < r.group_id GROUP BY e.b)"""

SQL = {
    "p6_found": f"WITH RECURSIVE {_P6_LABELS} SELECT party_id, group_id FROM labels",
    "p6_identity_span": f"""
        WITH RECURSIVE {_P6_LABELS},
        member AS (SELECT DISTINCT upper(trim(party_id)) AS party_id, identity_id FROM mv_es_party_identity WHERE identity_id IS NOT NULL),
        reached AS (SELECT group_id, count(DISTINCT identity_id) AS n_identities FROM labels JOIN member USING (party_id) GROUP BY 1),
        sizes AS (SELECT group_id, count(*) AS n_parties FROM labels GROUP BY 1)
        SELECT group_id, n_parties, coalesce(n_identities, 0) AS n_identities FROM sizes LEFT JOIN reached USING (group_id)""",
    "p5_found": f"""
        WITH {_P5_ROWS},
        rec AS (SELECT record_id, party_id, coalesce(updated_at, TIMESTAMP '0001-01-01') AS upd, trust_rank, count(norm) AS filled
                FROM long_rows GROUP BY ALL),
        mine AS (SELECT identity_id, rec.* FROM member JOIN rec USING (party_id)),
        best AS (SELECT identity_id, max(filled) AS f, max(upd) AS a, min(trust_rank) AS t, count(*) AS n FROM mine GROUP BY identity_id)
        SELECT identity_id, min(record_id) AS record_id FROM mine JOIN best USING (identity_id)
        WHERE n >= 2 AND filled = f AND upd = a AND trust_rank = t GROUP BY identity_id""",
    "p5_golden": f"""
        WITH {_P5_ROWS},
        last_day AS (SELECT max(CAST(updated_at AS DATE)) AS day FROM rpt_bronze_party),
        votes AS (SELECT identity_id, field, norm, value, coalesce(updated_at, TIMESTAMP '0001-01-01') AS upd,
                  {1_000_000 * survivor.HALF_AGE} // ((least(trust_rank, 99) + 1) * (CASE WHEN updated_at IS NULL THEN {survivor.UNKNOWN_AGE} ELSE greatest(date_diff('day', CAST(updated_at AS DATE), day), 0) END + {survivor.HALF_AGE})) AS w
                  FROM long_rows JOIN member USING (party_id), last_day WHERE norm IS NOT NULL),
        vals AS (SELECT identity_id, field, norm, sum(w) AS w, count(*) AS n, max(ROW(upd, CASE WHEN value = norm THEN '' ELSE value END)) AS s FROM votes GROUP BY ALL),
        won AS (SELECT identity_id, field, CASE WHEN s[2] = '' THEN norm ELSE s[2] END AS value FROM vals
                QUALIFY row_number() OVER (PARTITION BY identity_id, field ORDER BY w DESC, n DESC, norm DESC) = 1)
        SELECT identity_id, """
    + ", ".join(f"max(CASE WHEN field = '{f}' THEN value END) AS {f}" for f in P5_FIELDS)
    + " FROM won GROUP BY identity_id",
}
