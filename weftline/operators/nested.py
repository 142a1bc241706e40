"""Nested records into related flat tables, in one pass with tagged emission.

A depth-first visitor walks each JSON text once and emits one row per object: the tag of the
table it belongs to (its key path without list positions, repeats of a recursive key folded), its
own path, the path of its parent, and its scalar values as a payload. Each tag is one flat table;
``write_tables`` writes the rows partitioned by tag, ``read_table`` applies the schema of a tag.

An object that stands alone where other rows hold a list cannot be judged from its own row. The
visitor leaves a mark in the path at such places; the set of tags seen as lists, one entry per
place in the schema, settles the marks afterwards in the JVM.

Null, blank and broken texts give no rows. All elements count in positions. Without payloads,
elements that are no objects give no row. An empty list gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.jsontext import clean, dump, parse_unwrapped
from weftline.operators.schema import infer_json_ddl

#: Around the tag of an object that stands alone, within a path that isn't settled yet.
OPEN, CLOSE = "\x01", "\x02"

NODES = T.StructType(
    [
        T.StructField("src_table", T.StringType(), False),
        T.StructField("row_id", T.LongType()),
        T.StructField("tag", T.StringType(), False),
        T.StructField("kind", T.StringType(), False),  # root, element, alone, value
        T.StructField("path", T.StringType(), False),
        T.StructField("open_tags", T.ArrayType(T.StringType())),
        T.StructField("parents", T.ArrayType(T.StructType([T.StructField("path", T.StringType()), T.StructField("tag", T.StringType())]))),
        T.StructField("payload", T.StringType()),
    ]
)
_ARROW = pa.schema(
    [
        ("src_table", pa.string()), ("row_id", pa.int64()), ("tag", pa.string()), ("kind", pa.string()), ("path", pa.string()),
        ("open_tags", pa.list_(pa.string())), ("parents", pa.list_(pa.struct([("path", pa.string()), ("tag", pa.string())]))), ("payload", pa.string()),
    ]
)


def visit(value, with_payload: bool = True) -> Iterator[tuple]:
    """(tag, kind, path, open_tags, parents, payload) of every object in a parsed JSON value and,
    with payloads, of every scalar that no object holds under a key.

    parents runs from the nearest enclosing object to the first that is an element for certain,
    or the root; its tag is set where that object stands alone. No recursion: depth is bounded by
    the text alone.
    """
    # path, keys of the path, value, inside a list, tags left open, chain of parents
    stack: list = [("$", (), value, None, (), ())]
    while stack:
        path, keys, v, place, open_tags, chain = stack.pop()
        if isinstance(v, dict):
            tag = ".".join(keys)
            if place is None:
                kind, below = "root", ()
            elif place == "list":
                kind, below = "element", ((path, None),)
            else:
                kind = "alone"
                path, open_tags = f"{path}{OPEN}{tag}{CLOSE}", (*open_tags, tag)
                below = ((path, tag), *chain)
            payload = None
            if with_payload:
                payload = "{" + ",".join(f"{dump(k)}:{dump(x)}" for k, x in v.items() if not isinstance(x, (dict, list))) + "}"
            yield tag, kind, path, open_tags, chain, payload
            for k, x in reversed(v.items()):
                if isinstance(x, (dict, list)):
                    stack.append((f"{path}.{k}", keys if keys and keys[-1] == k else (*keys, k), x, "key", open_tags, below))
        elif isinstance(v, list):
            for i in range(len(v) - 1, -1, -1):
                if with_payload or isinstance(v[i], (dict, list)):
                    stack.append((f"{path}[{i}]", keys, v[i], "list", open_tags, chain))
        elif with_payload:
            yield ".".join(keys) + "[]" * (place == "list"), "value", path, open_tags, chain, f'{{"value":{dump(v)}}}'


def emit_nodes(df: DataFrame, table: str, row_id: str, source: str, with_payload: bool = True) -> DataFrame:
    """All objects of a JSON text column, with payloads also the scalars in lists, one row each
    (schema NODES), in a single pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text is None:
                    continue
                try:
                    value = parse_unwrapped(text)
                except ValueError:
                    continue
                for tag, kind, path, open_tags, chain, payload in visit(value, with_payload):
                    out.append(
                        (table, row, clean(tag), kind, clean(path), [clean(t) for t in open_tags] or None, [(clean(p), t and clean(t)) for p, t in chain] or None, payload and clean(payload))
                    )
                if len(out) >= 20_000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    return df.select(F.col(row_id).cast("long").alias("row_id"), F.col(source).alias("text")).mapInArrow(run, NODES)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    cols[6] = [None if c is None else [{"path": p, "tag": t} for p, t in c] for c in cols[6]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ARROW)], schema=_ARROW)


def list_tags(nodes: DataFrame) -> DataFrame:
    """(src_table, tag) of the places that hold a list of objects in some row."""
    return nodes.filter("kind = 'element'").select("src_table", "tag").distinct()


def settle(nodes: DataFrame, max_tags: int = 300) -> DataFrame:
    """Nodes with final node_path and parent_path; objects that stand alone in no list are
    marked by kind 'object' and belong to their parent's row.

    The set of list tags has one entry per place in the schema, not per record. It travels as
    an array with each task; its size is checked, and texts with more places than ``max_tags``
    (keys that are data) go by a join instead.
    """
    tags = list_tags(nodes)
    keyed = tags.select(F.concat_ws(":", "src_table", "tag").alias("k"))
    seen = [r.k for r in keyed.limit(max_tags + 1).collect()]
    if len(seen) <= max_tags:
        known = F.array(*map(F.lit, seen)).cast("array<string>") if seen else F.array().cast("array<string>")
        marked = nodes.withColumn("__lists", known)
    else:
        marked = _lists_by_join(nodes, tags)
    prefix = lambda t: F.concat_ws(":", F.col("src_table"), t)
    is_list = lambda t: F.array_contains(F.col("__lists"), prefix(t))

    def final(path: Column, tags_left: Column) -> Column:
        put = F.aggregate(tags_left, path, lambda p, t: F.replace(p, F.concat(F.lit(OPEN), t, F.lit(CLOSE)), F.when(is_list(t), F.lit("[0]")).otherwise(F.lit(""))))
        return F.when(tags_left.isNull(), path).otherwise(put)

    parent = F.try_element_at(F.filter("parents", lambda c: c["tag"].isNull() | is_list(c["tag"])), F.lit(1))
    parent_path = F.when(F.col("parents").isNull(), F.lit("$")).otherwise(F.coalesce(parent["path"], F.lit("$")))
    open_tags = F.col("open_tags")
    kind = F.when((F.col("kind") == "alone") & is_list(F.col("tag")), F.lit("element")).when(F.col("kind") == "alone", F.lit("object")).otherwise(F.col("kind"))
    return marked.select(
        "src_table", "row_id", "tag", kind.alias("kind"),
        final(F.col("path"), open_tags).alias("node_path"),
        final(parent_path, open_tags).alias("parent_path"),
        "payload",
    )


def _lists_by_join(nodes: DataFrame, tags: DataFrame) -> DataFrame:
    """As the array of all list tags, but per row only those among the row's own open tags."""
    ids = nodes.select("src_table", F.explode("open_tags").alias("tag")).distinct()
    hits = ids.join(tags, ["src_table", "tag"], "left_semi")
    asked = nodes.filter("open_tags is not null").select("src_table", "row_id", "path", F.explode("open_tags").alias("tag"))
    lists = asked.join(hits, ["src_table", "tag"]).groupBy("src_table", "row_id", "path").agg(F.collect_set(F.concat_ws(":", "src_table", "tag")).alias("__lists"))
    return nodes.join(lists, ["src_table", "row_id", "path"], "left").withColumn("__lists", F.coalesce("__lists", F.array().cast("array<string>")))


ROOT = "_root"
_TABLES = "row_id long, kind string, node_path string, parent_path string, payload string, src_table string, tag string"


def write_tables(settled: DataFrame, path: str) -> None:
    """Write the flat tables, one folder per source table and tag (``_root`` for whole documents).

    Every task writes its own rows of each tag, so a tag with most rows needs no shuffle."""
    tag = F.when(F.col("tag") == "", F.lit(ROOT)).otherwise(F.col("tag"))
    settled.select("row_id", "kind", "node_path", "parent_path", "payload", "src_table", tag.alias("tag")).write.partitionBy("src_table", "tag").parquet(path)


def read_table(spark: SparkSession, path: str, table: str, tag: str, fields: Mapping[str, str] | None = None) -> DataFrame:
    """One flat table of those written, read by its folder alone: row_id, node_path, parent_path and a column per field.

    The schema comes from all payloads of the tag. With ``fields`` (name to type) exactly these columns come out, nulls where no
    payload has them or where a value doesn't fit the type. Objects and elements that hold no field are rows too.
    """
    rows = spark.read.schema(_TABLES).parquet(path).filter((F.col("src_table") == table) & (F.col("tag") == (tag or ROOT)))
    found = T._parse_datatype_string(infer_json_ddl(rows, "payload"))
    keys = ["row_id", "node_path", "parent_path"]
    if fields is None:
        wanted = found.fields
    else:
        wanted = [T.StructField(n, T.StringType()) for n in fields]
    parsed = rows.select(*keys, F.from_json("payload", T.StructType(wanted), {"mode": "PERMISSIVE"}).alias("__p"))
    own = {k.lower() for k in keys}
    column = lambda f: F.col("__p").getField(f.name)
    return parsed.select(
        *keys,
        *[(column(f) if fields is None else column(f).try_cast(fields[f.name])).alias(f"{f.name}_2" if f.name.lower() in own else f.name) for f in wanted],
    )
