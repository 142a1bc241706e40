"""Declarative column rules, lookup precedence, quarantine and enrichment."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import expr
from weftline.operators.aggregates import quantiles


def column_rules(df: DataFrame, rules: Mapping[str, tuple[str, str | None]]) -> DataFrame:
    """One output column per rule (operation, source), all text, compiled to one projection.

    Operations: copy, const (source is the value), date_mmddyyyy, date_plus_1m_mmddyyyy,
    name_first, name_last, money, member_count (0 becomes 1), blank. An unknown operation or a
    missing source column gives ''.
    """

    def text(name: str | None) -> Column:
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))

    def build(op: str, source: str | None) -> Column:
        if op == "const":
            return F.lit(source or "")
        if op == "blank" or source not in df.columns:
            return F.lit("")
        c = text(source)
        if op == "copy":
            return c
        if op == "date_mmddyyyy":
            return expr.us_date_text(F.substring(c, 1, 10))
        if op == "date_plus_1m_mmddyyyy":
            return F.coalesce(F.date_format(F.add_months(expr.lenient_date(F.substring(c, 1, 10)), 1), "MM/dd/yyyy"), F.lit(""))
        if op == "name_first":
            return expr.split_name(c)[0]
        if op == "name_last":
            return expr.split_name(c)[1]
        if op == "money":
            return expr.money_text(c)
        if op == "member_count":
            amount = expr.money(c)
            return F.when(F.trim(c) == "", F.lit("")).when(amount == 0, F.lit("1")).otherwise(F.coalesce(F.sign(amount).cast("int").cast("string"), F.lit("")))
        return F.lit("")

    return df.select(*[build(op, source).alias(name) for name, (op, source) in rules.items()])


def header_signature(columns: Sequence[str]) -> str:
    """Twelve characters that stand for a header, whatever its case and the blanks around its names."""
    return hashlib.sha1("|".join(c.strip().lower() for c in columns).encode(), usedforsecurity=False).hexdigest()[:12]


class RuleCache:
    """Rule sets by header signature, kept as files in a shared folder: a header seen before costs no new building.

    A file is written whole under another name and then moved, so a reader never sees half of one; of two builders at once one wins.
    """

    def __init__(self, spark: SparkSession, folder: str):
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        self._fs = self._path("x").getFileSystem(conf)
        self.built = 0

    def rules(self, columns: Sequence[str], build: Callable[[Sequence[str]], Mapping[str, tuple[str, str | None]]]) -> dict[str, tuple[str, str | None]]:
        at = self._path(f"{header_signature(columns)}.json")
        if self._fs.exists(at):
            stream = self._fs.open(at)
            text = bytes(stream.readAllBytes()).decode()
            stream.close()
        else:
            self.built += 1
            text = json.dumps(build(columns))
            part = self._path(f".{header_signature(columns)}-{uuid.uuid4().hex}")
            stream = self._fs.create(part)
            stream.write(bytearray(text.encode()))
            stream.close()
            if not self._fs.rename(part, at):
                self._fs.delete(part, False)
        return {k: tuple(v) for k, v in json.loads(text).items()}


def fill_tokens(templates: DataFrame, tokens: DataFrame, keys: Sequence[str], copy: str = "=") -> DataFrame:
    """(keys, template, filled): each template with its key's tokens put in.

    tokens has keys, seq, token, value and, as source, the text of the row; the value with the highest seq wins, a null one leaves the token
    in place. Where the template is the copy sign, the filled text is the row's source as it is. Templates without tokens stay.
    """
    last = tokens.groupBy(*keys, "token").agg(F.max_by("value", "seq").alias("v"), F.max_by("source", "seq").alias("s"))
    entry = F.when(F.col("v").isNotNull(), F.struct(F.col("token"), F.col("v")))
    per = last.groupBy(*keys).agg(F.map_from_entries(F.array_compact(F.sort_array(F.collect_list(entry)))).alias("__t"), F.max("s").alias("__s"))
    joined = templates.join(per, list(keys), "left")
    filled = F.when(F.col("template") == copy, F.col("__s")).when(F.col("__t").isNull(), F.col("template")).otherwise(expr.fill_template(F.col("template"), F.col("__t")))
    return joined.select(*keys, "template", filled.alias("filled"))


def lookup_precedence(df: DataFrame, text: str, code_pattern: str, lookup: DataFrame) -> DataFrame:
    """df with (target, matched_by) from a lookup (key, target): the code in the text, then the exact
    name, the longest name followed by '.', the longest keyword contained.

    lookup is a small table of settings, with unique lower-case keys.
    """
    t = F.lower(F.trim(F.col(text)))
    code = F.lower(F.regexp_extract(F.col(text), code_pattern, 1))
    entries = lookup.agg(F.sort_array(F.collect_list(F.struct((-F.length("key")).alias("n"), F.col("key").alias("k"), F.col("target").alias("v")))).alias("e")).select("e").scalar()

    df = df.withColumn("__entries", entries)

    def pick(test: Callable[[Column], Column]) -> Column:
        return F.try_element_at(F.filter("__entries", test), F.lit(1))["v"]

    found = [
        ("code", F.when(code != "", pick(lambda e: e["k"] == code))),
        ("exact", pick(lambda e: e["k"] == t)),
        ("prefix", pick(lambda e: F.startswith(t, F.concat(e["k"], F.lit("."))))),
        ("keyword", pick(lambda e: F.contains(t, e["k"]))),
    ]
    marked = df.select("*", *[c.alias(f"__{n}") for n, c in found])
    how = expr.first_match([(F.col(f"__{n}").isNotNull(), n) for n, _ in found])
    return marked.select(*[c for c in df.columns if c != "__entries"], F.coalesce(*[F.col(f"__{n}") for n, _ in found]).alias("target"), how.alias("matched_by"))


def quarantine(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """df with problem: the required fields that are null or blank, '' where the row is valid."""
    return df.withColumn("problem", F.concat_ws(",", *[F.when(~expr.filled(F.col(f"`{c}`").cast("string")), F.lit(c)) for c in required]))


def coverage(df: DataFrame, entity: str, category: str, categories: Sequence[str]) -> DataFrame:
    """Rows per entity and category as columns, completeness, and whether below half the median."""
    counts = df.groupBy(entity).agg(*[F.count_if(F.col(category) == c).alias(c) for c in categories], F.count(F.lit(1)).alias("total"))
    have = sum(((F.col(f"`{c}`") > 0).cast("int") for c in categories), F.lit(0))
    half = quantiles(counts, [], "total", {"m": 0.5}).select(F.col("m") / 2).scalar()
    return counts.select("*", F.round(have / len(categories), 6).alias("completeness"), (F.col("total") < half).alias("low"))


def map_partitions(df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str, partitions: int | None = None) -> DataFrame:
    """A function of pandas batches over df, spread over partitions."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield function(b)

    return (df.repartition(partitions) if partitions else df).mapInPandas(run, schema)


def enrich(df: DataFrame, inputs: Sequence[str], call: Callable[[dict], dict], schema: str, retries: int = 3, workers: int = 16, valid: Callable[[dict], str | None] | None = None) -> DataFrame:
    """df with the answer fields of an injected call per row, and status, attempts, error.

    Calls of a batch run in a bounded pool of threads; a call that raises is retried with growing
    pauses and then reported in status and error, never as a failed job. valid names what is wrong with an
    answer, or None; a wrong answer is asked for again and in the end has status invalid and no fields.
    Rows to be asked again wait together, outside the pool: a batch pauses once an attempt, however many of its rows fail.
    """
    fields = T._parse_datatype_string(schema) if hasattr(T, "_parse_datatype_string") else T.StructType.fromDDL(schema)
    extra = [T.StructField("status", T.StringType()), T.StructField("attempts", T.IntegerType()), T.StructField("error", T.StringType())]
    out = T.StructType(df.schema.fields + fields.fields + extra)
    names = [f.name for f in fields.fields]

    def one(row: dict, attempt: int) -> list:
        try:
            answer = call(row)
            error, status = valid(answer) if valid else None, "invalid"
            if error is None:
                return [answer.get(n) for n in names] + ["ok", attempt, None]
        except Exception as e:  # noqa: BLE001 - any failure of the injected call is data here
            error, status = f"{type(e).__name__}: {e}", "failed"
        return [None] * len(names) + [status, attempt, error]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(workers) as pool:
            for b in batches:
                asked = b[list(inputs)].to_dict("records")
                answers: list = [[None] * len(names) + ["failed", retries, None]] * len(asked)
                left = list(range(len(asked)))
                for attempt in range(1, retries + 1):
                    for i, answer in zip(left, pool.map(lambda i: one(asked[i], attempt), left)):  # noqa: B023 - all are answered within the round
                        answers[i] = answer
                    left = [i for i in left if answers[i][-3] != "ok"]
                    if not left:
                        break
                    if attempt < retries:
                        time.sleep(0.05 * 2**attempt)
                yield pd.concat([b.reset_index(drop=True), pd.DataFrame(answers, columns=[*names, "status", "attempts", "error"])], axis=1)

    return df.mapInPandas(run, out)
