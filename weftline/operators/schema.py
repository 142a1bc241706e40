"""Schemas: inference from JSON text, flattening, and finding columns by name or content."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of a variant schema: quoted names, and the types that from_json reads otherwise.
_PARTS = re.compile(r"`(?:[^`]|``)*`|OBJECT<>|\bOBJECT\b(?=<)|\bVOID\b(?![:`])|\bVARIANT\b(?!:)|\bDECIMAL\(\d+,[1-9]\d*\)")
_READ_AS = {"OBJECT<>": "STRING", "OBJECT": "STRUCT", "VOID": "STRING", "VARIANT": "STRING"}


def infer_json_ddl(df: DataFrame, source: str) -> str:
    """DDL of the merged structure of all JSON objects in a text column.

    One aggregate over all rows, merged on the map side, so a field is found however rare it is.
    Fields whose values are of different kinds, always null or always an empty object are text and
    keep their JSON. Null, blank and broken texts, roots that are no object, and objects that repeat
    a key add nothing; without any object the structure is empty.
    """
    objects = df.filter(F.ltrim(F.col(source)).startswith("{")).select(F.try_parse_json(source).alias("v"))
    seen = objects.agg(F.schema_of_variant_agg("v")).first()[0]
    if not seen or not seen.startswith("OBJECT<") or seen == "OBJECT<>":
        return "STRUCT<>"
    return _PARTS.sub(lambda m: m.group() if m.group()[0] == "`" else _READ_AS.get(m.group(), "DOUBLE"), seen)


def parse_json(df: DataFrame, source: str, ddl: str, alias: str = "doc") -> DataFrame:
    """df with the parsed text as a structure.

    A text that isn't well formed, or repeats a key, gives null, not the part before the fault; a value
    that doesn't fit its field gives null there.
    """
    return df.withColumn(alias, F.from_json(F.when(F.try_parse_json(source).isNotNull(), F.col(source)), ddl, {"mode": "PERMISSIVE"}))


Path = tuple[str, ...]


def leaf_paths(t: T.StructType, max_depth: int = 8) -> Iterator[tuple[Path, T.DataType]]:
    """Field paths of a structure down to values that are no structure, or to max_depth names below the root."""
    for f in t.fields:
        if isinstance(f.dataType, T.StructType) and max_depth > 0:
            for below, kind in leaf_paths(f.dataType, max_depth - 1):
                yield (f.name, *below), kind
        else:
            yield (f.name,), f.dataType


def _at(path: Path) -> Column:
    return F.col(".".join("`" + p.replace("`", "``") + "`" for p in path))


def _named(columns: Sequence[tuple[Column, str]]) -> list[Column]:
    """Columns under their names, repeats numbered from 2."""
    taken: set[str] = set()
    out = []
    for c, wanted in columns:
        name, i = wanted, 2
        while name.lower() in taken:
            name, i = f"{wanted}_{i}", i + 1
        taken.add(name.lower())
        out.append(c.alias(name))
    return out


def flatten(df: DataFrame, max_depth: int = 8) -> DataFrame:
    """Every field inside structures as a column parent_child, in one projection.

    Structures deeper than max_depth stay whole; arrays stay arrays. A name that occurs already gets a number.
    """
    return df.select(*_named([(_at(p), "_".join(p)) for p, _ in leaf_paths(df.schema, max_depth)]))


def route_to(t: T.StructType, leaf: str) -> list[Path] | None:
    """Way to the field whose name is, or else contains, ``leaf``: one path per array to pass, then that to the field.

    Among several the way through fewest names wins, then the first in the schema. None if there is no such field.
    """
    found: list[tuple[bool, int, list[Path]]] = []

    def walk(kind: T.DataType, done: list[Path], here: Path) -> None:
        if isinstance(kind, T.ArrayType):
            walk(kind.elementType, [*done, here], ())
        elif isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(f.dataType, done, (*here, f.name))
        elif here and leaf.lower() in here[-1].lower():
            way = [*done, here]
            found.append((here[-1].lower() != leaf.lower(), sum(map(len, way)), way))

    walk(t, [], ())
    return min(found, key=lambda x: x[:2])[2] if found else None


def explode_for(df: DataFrame, leaf: str) -> DataFrame:
    """Flat rows, one per element of the arrays on the way to ``leaf``; all other arrays stay whole.

    So no two arrays multiply each other. Rows without elements stay, with nulls. Names are as in
    ``flatten``, elements under the name of their array.
    """
    way = route_to(df.schema, leaf) or [()]
    kept: list[tuple[Column, str]] = []
    holder, kind, prefix = (), df.schema, ()
    for i, path in enumerate(way):
        inside = list(leaf_paths(kind)) if isinstance(kind, T.StructType) else [((), kind)]
        last = i == len(way) - 1
        kept += [(_at((*holder, *p)), "_".join((*prefix, *p))) for p, _ in inside if last or p != path]
        if last:
            return df.select(*_named(kept))
        element = F.explode_outer(_at((*holder, *path))).alias("__element")
        df = df.select(*_named(kept), element)
        kept = [(_at((c,)), c) for c in df.columns[:-1]]
        kind, holder, prefix = df.schema["__element"].dataType, ("__element",), (*prefix, *path)
    return df


def explode_all(df: DataFrame, first: int = 1) -> DataFrame:
    """Explode the first ``first`` array columns; several multiply rows."""
    for f in [f for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)][:first]:
        df = df.withColumn(f.name, F.explode_outer(f"`{f.name}`"))
    return df


def canonical_names(names: Sequence[str]) -> list[str]:
    """Lower case, other signs as single underscores; repeats get a number."""
    out: list[str] = []
    for n in names:
        base = re.sub(r"_+", "_", re.sub(r"\W+", "_", n)).strip("_").lower() or "column"
        name, i = base, 2
        while name in out:
            name, i = f"{base}_{i}", i + 1
        out.append(name)
    return out


def resolve(columns: Sequence[str], synonyms: Mapping[str, Sequence[str]], deny_short: int = 4) -> dict[str, str | None]:
    """Physical column per logical field: exact name, exact leaf, alphanumeric form, then substring.

    Synonyms shorter than deny_short are never matched as substrings.
    """
    bare = lambda s: re.sub(r"[^a-z0-9]", "", s.lower())
    out: dict[str, str | None] = {}
    for logical, names in synonyms.items():
        tests = (
            lambda c, n: c == n,
            lambda c, n: c.lower() == n.lower(),
            lambda c, n: re.split(r"[._]", c.lower())[-1] == n.lower(),
            lambda c, n: bare(c) == bare(n),
            lambda c, n: len(n) >= deny_short and bare(n) in bare(c),
        )
        out[logical] = next((c for test in tests for n in names for c in columns if test(c, n)), None)
    return out


def by_content(df: DataFrame, candidates: Sequence[str], pattern: str) -> str | None:
    """The candidate column with the highest share of values that match; first among equals."""
    shares = df.agg(*[F.avg(F.col(f"`{c}`").cast("string").rlike(pattern).cast("double")).alias(f"s{i}") for i, c in enumerate(candidates)]).first()
    best = max(range(len(candidates)), key=lambda i: (shares[i] or 0.0, -i), default=None)
    return None if best is None or not shares[best] else candidates[best]


def first_schema(columns: Sequence[str], alternatives: Mapping[str, Sequence[str]]) -> str | None:
    """Name of the first alternative whose columns are all there."""
    have = set(columns)
    return next((name for name, need in alternatives.items() if have.issuperset(need)), None)
