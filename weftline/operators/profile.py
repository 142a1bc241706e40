"""Column profile of large tables, compared between loads.

The exact profile comes from unpivoted column-value counts: one row per (table, field, load,
value) with its frequency. All figures of the profile (fill rates, distinct values, ranges,
forms, drift between loads) are aggregates of that table, so the data are read once however
many figures are asked for. Free text is counted by a digest of the value with its length, so
that long texts never travel.

The fields of a JSON column are discovered from the data, nested ones by their path without list
positions (``names.first``); each is profiled over the objects that could hold it.

Nulls, blanks: a value is filled if it is neither null nor white space only. A field that no row
fills has rates but no distribution. A NULL load is a load of its own. Ties for the most frequent
form go to the form that sorts first. An empty table gives an empty profile.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from json.encoder import encode_basestring as _quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.jsontext import as_text, clean, dump, parse_unwrapped
from weftline.functions.tables import small, trimmed

CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\x{FFFD}]"
DECIMAL = T.DecimalType(38, 0)


_ASCII = "0123456789" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "abcdefghijklmnopqrstuvwxyz"
_ASCII_FORM = "9" * 10 + "A" * 26 + "a" * 26


def is_filled(c: Column) -> Column:
    return F.coalesce(trimmed(c) != "", F.lit(False))


def form_of(c: Column) -> Column:
    """Text with each decimal digit as 9, upper-case letter as A, lower-case letter as a."""
    plain = F.translate(c, _ASCII, _ASCII_FORM)
    other = F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"\p{Nd}", "9"), r"\p{Lu}", "A"), r"\p{Ll}", "a")
    return F.when(F.octet_length(c) == F.char_length(c), plain).otherwise(other)


def json_fields(df: DataFrame, source: str, fields: Sequence[str], carry: Sequence[str]) -> DataFrame:
    """Top-level keys of a JSON text column as text columns, with ``state``.

    state is 'null', 'unreadable' (not null, no well-formed JSON) or 'read'. Keys absent or null
    give NULL; numbers come as written, objects and lists as compact JSON. A JSON text whose
    root is no object is read, with every field NULL. Runs in Arrow batches.
    """
    picked = df.select(*carry, F.col(source).alias("__json"))
    n_carry = len(carry)
    schema = T.StructType(
        picked.schema.fields[:n_carry]
        + [T.StructField("state", T.StringType(), False)]
        + [T.StructField(f, T.StringType()) for f in fields]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            states, cols = [], [[] for _ in fields]
            for text in b.column(n_carry).to_pylist():
                value = None
                if text is None:
                    states.append("null")
                else:
                    try:
                        value = parse_unwrapped(text)
                        states.append("read")
                    except ValueError:
                        states.append("unreadable")
                if isinstance(value, dict):
                    for out, f in zip(cols, fields):
                        out.append(as_text(value.get(f)))
                else:
                    for out in cols:
                        out.append(None)
            arrays = [b.column(i) for i in range(n_carry)] + [pa.array(states, pa.string())] + [pa.array(c, pa.string()) for c in cols]
            yield pa.RecordBatch.from_arrays(arrays, names=[*carry, "state", *fields])

    return picked.mapInArrow(read, schema)


_MARKS = re.compile(r"[\\.\[]|^\$?$")


@lru_cache(1 << 16)
def _field(place: str, key: str) -> str:
    own = _MARKS.sub(r"\\\g<0>", key)
    return f"{place}.{own}" if place else own


def json_cells(value) -> Iterator[tuple[str, str | None, str | None, bool]]:
    """(holder, field, text, nested) of every field in a parsed JSON value, at any depth.

    holder is the place of the object or list that holds the field: '' for the root. Scalar elements of a list
    are the field ``list[]``, a root that is no object is the field ``$``. A row with field None stands for one
    object or scalar element at that place, so that absent keys can be counted. Repeats of a recursive key count
    as one place; ``.``, ``[`` and backslash within a key, an empty key and ``$`` are escaped. Texts are as in
    ``json_fields``. No recursion: depth is bounded by the text alone.
    """
    yield "", None, None, False
    if not isinstance(value, (dict, list)):
        yield "", "$", as_text(value), False
        return
    root = isinstance(value, dict)
    # container, place of its objects, last key, field of its scalar elements
    found: list = [(value, "" if root else "$", None, "$[]")]
    for v, place, last, name in found:
        if isinstance(v, dict):
            for k, x in v.items():
                if isinstance(x, (dict, list)):
                    path = _field(place, k)
                    found.append((x, place if k == last else path, k, f"{path}[]"))
        else:
            found.extend((x, place, last, f"{name}[]" if isinstance(x, list) else name) for x in v if isinstance(x, (dict, list)))
    texts: dict[int, str] = {}  # of containers, those within others first

    def text(x) -> str:
        return _quote(x) if type(x) is str else texts[id(x)] if isinstance(x, (dict, list)) else dump(x)

    for v, *_ in reversed(found):
        if type(v) is dict:
            texts[id(v)] = "{" + ",".join([f"{_quote(k)}:{text(x)}" for k, x in v.items()]) + "}"
        else:
            texts[id(v)] = "[" + ",".join([text(x) for x in v]) + "]"
    if not root:
        yield "", "$", clean(texts[id(value)]), True
    for v, place, _, name in found:
        if type(v) is dict:
            if place:
                yield place, None, None, False
            for k, x in v.items():
                if type(x) is str:
                    yield place, _field(place, k), clean(x), False
                elif isinstance(x, (dict, list)):
                    yield place, _field(place, k), clean(texts[id(x)]), True
                else:
                    yield place, _field(place, k), as_text(x), False
        else:
            for x in v:
                if not isinstance(x, (dict, list)):
                    yield name, None, None, False
                    yield name, name, as_text(x), False


def json_counts(df: DataFrame, table: str, source: str, plain: Sequence[str] = ()) -> DataFrame:
    """Frequencies as of ``value_counts`` for all fields in a JSON text column, found in one pass.

    Objects and lists (nested) go by digest and length, but for the fields in ``plain``. n counts the cells of
    a field: one for each object at its holder's place, whether it has the key or not, in every load in which
    that place occurs. Texts that are null or unreadable count nowhere. Equal cells of a batch are counted in it.
    """
    schema = T.StructType(
        [T.StructField("load_id", df.schema["load_id"].dataType)]
        + [T.StructField(c, T.StringType()) for c in ("holder", "field_name", "value")]
        + [T.StructField("nested", T.BooleanType()), T.StructField("chars", T.LongType()), T.StructField("n", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: Counter = Counter()
            for load, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text is None:
                    continue
                try:
                    value = parse_unwrapped(text)
                except ValueError:
                    continue
                for holder, field, cell, nested in json_cells(value):
                    chars = None if cell is None else len(cell)
                    nested = nested and field not in plain
                    if nested:
                        cell = hashlib.blake2b(cell.encode(), digest_size=16).hexdigest()
                    seen[load, clean(holder), field and clean(field), cell, nested, chars] += 1
            cols = list(zip(*seen)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], b.column(0).type), *(pa.array(c, pa.string()) for c in cols[1:4]), pa.array(cols[4], pa.bool_()), pa.array(cols[5], pa.int64()), pa.array(list(seen.values()), pa.int64())],
                names=schema.names,
            )

    cells = df.select("load_id", F.col(source).alias("text")).mapInArrow(run, schema)
    filled = is_filled(F.col("value"))
    keys = ["holder", "field_name", "value", "filled", "chars", "nested"]
    cells = (
        cells.withColumn("filled", filled).withColumn("value", F.when(filled, F.col("value"))).withColumn("chars", F.when(filled, F.col("chars")))
        # one shuffle for both groupings: rows are combined by batch before it
        .repartition("holder", "field_name", "value")
        .groupBy(*keys, "load_id").agg(F.sum("n").alias("n"))
    )
    return by_value(cells, keys).withColumn("src_table", F.lit(table))


def by_value(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """counts (keys and load_id unique) with c_all, the value's frequency in all loads, and is_first, true in one
    row per value, so that later steps need no further shuffle of the values."""
    same = W.partitionBy(*keys)
    return counts.withColumn("c_all", F.sum("n").over(same)).withColumn("is_first", F.row_number().over(same.orderBy("load_id")) == 1)


def with_absent(values: DataFrame, keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> DataFrame:
    """Values of ``json_counts`` without the rows for objects, and with one row for the cells of each field and
    load that no object of the place has: in loads that never hold the key, all of them. keep writes those few rows
    (``Stage.write``)."""
    key = ["src_table", "holder"]
    held = values.filter("field_name is null").groupBy(*key, "load_id").agg(F.sum("n").alias("n_held"))
    cells = values.filter("field_name is not null")
    there = cells.groupBy(*key, "field_name", "load_id").agg(F.sum("n").alias("n_there"))
    fields = there.select(*key, "field_name").distinct()
    due = fields.join(held, key).alias("d")
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"t.{c}")) for c in (*key, "field_name", "load_id")]
    absent = due.join(there.alias("t"), same, "left").select("d.*", (F.col("n_held") - F.coalesce("n_there", F.lit(0))).alias("n")).filter("n > 0")
    no = F.lit(False)
    empty = absent.select(
        "src_table", "field_name", F.lit(None).cast("string").alias("value"), no.alias("filled"), F.lit(None).cast("long").alias("chars"), no.alias("nested"),
        "load_id", "n", F.col("n").alias("c_all"), no.alias("is_first"),
    )
    return cells.drop("holder").unionByName(keep(empty, "absent"))


def unpivot(df: DataFrame, table: str, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(src_table, *keys, field_name, value): one row per row and field, empty ones too."""
    stacked = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").cast("string").alias("value")) for f in fields]))
    return df.select(F.lit(table).alias("src_table"), *keys, stacked.alias("__fv")).select("src_table", *keys, "__fv.field_name", "__fv.value")


def value_counts(cells: DataFrame, free_text: Sequence[str] = ()) -> DataFrame:
    """Frequencies of (src_table, field_name, load_id, value).

    Columns: value (NULL for cells that aren't filled; the digest for free text), filled, n (cells),
    chars (characters in each such cell), control (free text: whether it has control characters).
    """
    filled = is_filled(F.col("value"))
    free = F.col("field_name").isin(*free_text) if free_text else F.lit(False)
    return (
        cells.withColumn("filled", filled)
        .withColumn("chars", F.when(filled, F.char_length("value").cast("long")))
        .withColumn("control", F.when(filled & free, F.col("value").rlike(CONTROL)))
        .withColumn("value", F.when(filled & free, F.sha2("value", 256)).when(filled, F.col("value")))
        .groupBy("src_table", "field_name", "load_id", "value", "filled", "chars", "control")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _sums() -> list[Column]:
    return [
        F.sum("n").cast(DECIMAL).alias("n_rows"),
        F.sum(F.when(F.col("filled"), F.col("n")).otherwise(0)).cast(DECIMAL).alias("n_filled"),
        F.sum(F.coalesce(F.col("chars") * F.col("n"), F.lit(0))).cast(DECIMAL).alias("n_chars"),
    ]


def with_overall(by_load: DataFrame) -> DataFrame:
    overall = by_load.groupBy("src_table", "field_name").agg(
        *[F.sum(c).cast(DECIMAL).alias(f"all_{c[2:]}") for c in ("n_rows", "n_filled", "n_chars")]
    )
    return by_load.join(overall, ["src_table", "field_name"])


def load_totals(counts: DataFrame) -> DataFrame:
    """Cells, filled cells and characters by field and load, with those over all loads beside."""
    return with_overall(counts.groupBy("src_table", "field_name", "load_id").agg(*_sums()))


def drift(values: DataFrame, totals: DataFrame) -> DataFrame:
    """Each load's distribution of filled values (as of ``by_value``) against that of all loads.

    tv_twice_scaled / (n_filled * all_filled) is twice the total variation, kept as an exact
    integer; chi2 the statistic of the load's counts against those expected from all loads; psi the
    population stability index, sum of (p - q) ln(p / q) over every value of the field, where
    p = (count in the load + 0.5) / (filled in the load + 0.5) and q alike over all loads. A value
    that the load lacks counts with p = 0.5 / (filled + 0.5): its term falls apart into sums over
    the field, so no load is paired with values it doesn't have.
    """
    key = ["src_table", "field_name"]
    per_load = small(totals.select(*key, "load_id", "n_filled", "all_filled"))
    per_field = small(totals.select(*key, "all_filled").distinct())
    filled = values.filter("filled")
    share = lambda c, n: (F.col(c).cast("double") + 0.5) / (F.col(n).cast("double") + 0.5)
    q, lnq = F.col("q"), F.ln("q")
    over_field = (
        filled.filter("is_first").join(per_field, key).select(*key, share("c_all", "all_filled").alias("q")).groupBy(*key)
        .agg(F.count(F.lit(1)).alias("v_all"), F.sum(q).alias("q_all"), F.sum(lnq).alias("l_all"), F.sum(q * lnq).alias("e_all"))
    )
    each = filled.select(*key, "load_id", "n", "c_all").alias("e")
    same = [F.col(f"e.{k}") == F.col(f"t.{k}") for k in key] + [F.col("e.load_id").eqNullSafe(F.col("t.load_id"))]
    joined = each.join(per_load.alias("t"), same).select("e.*", "t.n_filled", "t.all_filled")
    joined = joined.withColumnRenamed("n", "c").withColumn("p", share("c", "n_filled")).withColumn("q", share("c_all", "all_filled"))
    c, total, n, n_all = (F.col(x).cast(DECIMAL) for x in ("c", "c_all", "n_filled", "all_filled"))
    cd, ad, nd, nad = (F.col(x).cast("double") for x in ("c", "c_all", "n_filled", "all_filled"))
    expected = ad * nd / nad
    here = joined.groupBy(*key, "load_id", "n_filled", "all_filled").agg(
        (F.sum(F.abs(c * n_all - total * n).cast(DECIMAL)) + (F.first(n_all) - F.sum(total)) * F.first(n)).cast(DECIMAL).alias("tv_twice_scaled"),
        F.count(F.lit(1)).alias("n_distinct"),
        F.sum((F.col("p") - q) * F.ln(F.col("p") / q)).alias("psi_here"), F.sum(q).alias("q_here"), F.sum(lnq).alias("l_here"), F.sum(q * lnq).alias("e_here"),
        (F.sum((cd - expected) * (cd - expected) / expected) + (F.first(nad) - F.sum(ad)) * F.first(nd) / F.first(nad)).alias("chi2"),
    )
    p0 = F.lit(0.5) / (F.col("n_filled").cast("double") + 0.5)
    gone = lambda x: F.col(f"{x}_all") - F.col(f"{x}_here")
    lacking = (F.col("v_all") - F.col("n_distinct")) * p0 * F.ln(p0) - p0 * gone("l") - F.ln(p0) * gone("q") + gone("e")
    psi = F.col("psi_here") + F.when(F.col("v_all") > F.col("n_distinct"), lacking).otherwise(0.0)
    return here.join(over_field, key).select(*key, "load_id", "n_filled", "all_filled", "tv_twice_scaled", "n_distinct", psi.alias("psi"), "chi2")


def modal_forms(counts: DataFrame, fields: Sequence[str] | None) -> DataFrame:
    """(src_table, field_name, modal_form, n_modal): the most frequent form of each field (None: of all)."""
    return _most_frequent(_forms(counts.filter(F.lit(True) if fields is None else F.col("field_name").isin(*fields))))


def _forms(counts: DataFrame) -> DataFrame:
    return counts.filter("filled").groupBy("src_table", "field_name", form_of(F.col("value")).alias("form")).agg(F.sum("n").alias("n"))


def _most_frequent(forms: DataFrame) -> DataFrame:
    # a minimum over (-n, form): ties go to the form that sorts first
    top = forms.groupBy("src_table", "field_name").agg(F.min(F.struct((-F.col("n")).alias("neg"), "form")).alias("t"))
    return top.select("src_table", "field_name", F.col("t.form").alias("modal_form"), (-F.col("t.neg")).alias("n_modal"))


def profile(values: DataFrame, free_text: Sequence[str] = (), keep: Callable[[DataFrame, str], DataFrame] = lambda df, _: df) -> DataFrame:
    """One row per field and load: the full exact profile, from the values alone (as of ``by_value``).

    keep writes the small tables that several figures need (``Stage.write``).

    Values that are objects or lists (``nested``) have no range and no form, free text has no form.
    """
    key = ["src_table", "field_name", "load_id"]
    free = F.col("field_name").isin(*free_text) if free_text else F.lit(False)
    plain = F.when(~F.col("nested"), F.col("value"))
    filled_n = F.when(F.col("filled"), F.col("n"))
    # one pass over the values, to a row per field, load and form; NULL is the form of values without one
    shape = F.when(F.col("filled") & ~F.col("nested") & ~free, form_of(F.col("value")))
    shaped = keep(values.withColumn("form", shape).groupBy(*key, "form").agg(
        *_sums(),
        F.min(plain).alias("min_value"), F.max(plain).alias("max_value"), F.min("chars").alias("min_chars"), F.max("chars").alias("max_chars"),
        F.sum(F.when(F.col("control").isNotNull(), F.col("n") * F.col("control").cast("long"))).alias("n_control"), F.max(filled_n).alias("n_most_frequent"),
    ), "shaped")
    figures = shaped.groupBy(*key).agg(
        *[F.sum(c).cast(DECIMAL).alias(c) for c in ("n_rows", "n_filled", "n_chars")], *[F.min(c).alias(c) for c in ("min_value", "min_chars")],
        *[F.max(c).alias(c) for c in ("max_value", "max_chars", "n_most_frequent")], F.sum("n_control").alias("n_control"),
    )
    totals = keep(with_overall(figures), "totals")
    forms = shaped.filter("form is not null").select(*key, "form", F.col("n_filled").cast("long").alias("n"))
    modal = _most_frequent(forms.groupBy("src_table", "field_name", "form").agg(F.sum("n").alias("n"))).drop("n_modal")
    in_form = forms.join(modal, ["src_table", "field_name"]).filter("form = modal_form").select(*key, F.col("n").alias("n_in_form"))

    def join(a: DataFrame, b: DataFrame) -> DataFrame:
        b = b.select(*[F.col(c).alias(f"__{c}") if c in key else F.col(c) for c in b.columns])
        on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in key]
        return a.join(b, on, "left").drop(*[f"__{c}" for c in key])

    out = join(join(totals, drift(values, totals).drop("n_filled", "all_filled")), in_form).join(modal, ["src_table", "field_name"], "left")
    n_rows, n_filled = F.col("n_rows").cast("double"), F.col("n_filled").cast("double")
    return out.select(
        *key,
        F.col("n_rows").cast("long").alias("n_rows"),
        F.col("n_filled").cast("long").alias("n_filled"),
        F.round(1 - n_filled / n_rows, 6).alias("null_rate"),
        F.coalesce("n_distinct", F.lit(0)).cast("long").alias("n_distinct"),
        "min_value", "max_value", "min_chars", "max_chars",
        F.round(F.col("n_chars").cast("double") / F.when(n_filled > 0, n_filled), 6).alias("mean_chars"),
        "n_most_frequent", "n_control", "modal_form", F.coalesce("n_in_form", F.lit(0)).alias("n_in_form"),
        F.round(F.col("tv_twice_scaled").cast("double") / 2 / n_filled / F.col("all_filled").cast("double"), 6).alias("total_variation"),
        F.round("psi", 6).alias("psi"), F.round("chi2", 6).alias("chi2"),
    )


#: Layouts of dates by form; a modal form without a layout gives no range findings.
DATE_LAYOUTS = {
    "9999-99-99": "yyyy-MM-dd",
    "9999/99/99": "yyyy/MM/dd",
    "99/99/9999": "MM/dd/yyyy",
    "99999999": "yyyyMMdd",
}


def form_cases(cells: DataFrame, modal: DataFrame) -> DataFrame:
    """Filled cells whose form is not the field's most frequent one."""
    return (
        cells.filter(is_filled(F.col("value")))
        .join(F.broadcast(modal), ["src_table", "field_name"])  # one row per field
        .filter(form_of(F.col("value")) != F.col("modal_form"))
    )


def date_range_cases(cells: DataFrame, modal: DataFrame, field: str, first_day: str) -> DataFrame:
    """Cells of a date field in its most frequent form that are no calendar day, lie before
    first_day, or after the day of ``load_ts`` (a missing load_ts sets no upper end)."""
    day = F.lit(None).cast("date")
    for form, layout in DATE_LAYOUTS.items():
        day = F.when(F.col("modal_form") == form, F.try_to_date(F.col("value"), layout)).otherwise(day)
    out_of_range = day.isNull() | (day < F.lit(first_day).cast("date")) | F.coalesce(day > F.to_date("load_ts"), F.lit(False))
    return (
        cells.filter((F.col("field_name") == field) & is_filled(F.col("value")))
        .join(F.broadcast(modal), ["src_table", "field_name"])
        .filter((form_of(F.col("value")) == F.col("modal_form")) & F.col("modal_form").isin(*DATE_LAYOUTS) & out_of_range)
    )


def load_findings(totals: DataFrame, moved: DataFrame, mix_fields: Sequence[str], length_fields: Sequence[str]) -> DataFrame:
    """(src_table, field_name, finding, load_id) of loads that differ from all loads together.

    null_rate: by more than 0.2. mean_length: by more than a quarter. mix: total variation above
    0.25. All three compare integers, so a load exactly at a limit is no case.
    """
    n, f, s = (F.col(x) for x in ("n_rows", "n_filled", "n_chars"))
    na, fa, sa = (F.col(x) for x in ("all_rows", "all_filled", "all_chars"))
    key = ["src_table", "field_name"]
    wide = lambda e: e.cast(T.DecimalType(38, 0))
    nulls = totals.filter(wide(5 * F.abs(wide(f * na) - wide(fa * n))) > wide(n * na)).select(*key, F.lit("null_rate").alias("finding"), "load_id")
    lengths = totals.filter(F.col("field_name").isin(*length_fields) & (f > 0)).filter(wide(4 * F.abs(wide(s * fa) - wide(sa * f))) > wide(sa * f))
    mixes = moved.filter(F.col("field_name").isin(*mix_fields)).filter(wide(2 * F.col("tv_twice_scaled")) > wide(f * fa))
    return nulls.unionByName(lengths.select(*key, F.lit("mean_length").alias("finding"), "load_id")).unionByName(
        mixes.select(*key, F.lit("mix").alias("finding"), "load_id")
    )
