"""Text: rule scoring, token tables, BM25, ranked results, boolean templates, segments."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.expr import first_match, flags


@dataclass(frozen=True)
class Rule:
    """A named regex concept with a weight on one axis of the score."""

    name: str
    pattern: str
    axis: str
    weight: int


def rule_scores(df: DataFrame, text: str, rules: Sequence[Rule], named: Sequence[str] = ()) -> DataFrame:
    """df with hit_<rule>, one score per axis, named_score and total_score, in one projection.

    named lists concepts that count once more in the total, on top of their axis. Null text scores 0.
    """
    hits = flags(F.lower(F.col(text)), {r.name: r.pattern for r in rules})
    flagged = df.select("*", *[c.alias(f"hit_{n}") for n, c in hits.items()])
    axes = {a: sum((F.col(f"hit_{r.name}") * r.weight for r in rules if r.axis == a), F.lit(0)) for a in dict.fromkeys(r.axis for r in rules)}
    extra = sum((F.col(f"hit_{r.name}") * r.weight for r in rules if r.name in named), F.lit(0))
    return flagged.select("*", *[c.cast("int").alias(f"score_{a}") for a, c in axes.items()], extra.cast("int").alias("named_score"), (sum(axes.values(), F.lit(0)) + extra).cast("int").alias("total_score"))


def classify_total(total: Column, strong: int, moderate: int) -> Column:
    """Class by total score."""
    return first_match([(total >= strong, "strong"), (total >= moderate, "moderate"), (total > 0, "weak")], "none")


def classify_axes(axes: Sequence[Column], clear: int) -> Column:
    """Class by axis: clear if any axis reaches the limit alone, partial if any is above zero."""
    return first_match([(F.greatest(*axes) >= clear, "clear"), (F.greatest(*axes) > 0, "partial")], "none")


def text_bucket(text: Column, reason: str, filler: str) -> Column:
    """empty, reason+filler, reason, filler only or unrecognised."""
    t = F.lower(F.coalesce(F.trim(text), F.lit("")))
    has_reason, has_filler = t.rlike(reason), t.rlike(filler)
    return first_match([(t == "", "empty"), (has_reason & has_filler, "reason+filler"), (has_reason, "reason"), (has_filler, "filler only")], "unrecognised")


def length_class(text: Column) -> Column:
    """Quality by length of the trimmed text: none, short (<20), medium (<150), long (<600), very long."""
    n = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return first_match([(n == 0, "none"), (n < 20, "short"), (n < 150, "medium"), (n < 600, "long")], "very long")


def tokens(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, token, tf): words of lower-case letters and digits with their frequency."""
    words = F.explode(F.filter(F.split(F.lower(F.col(text)), "[^a-z0-9]+"), lambda w: w != ""))
    return df.select(id_col, words.alias("token")).groupBy(id_col, "token").agg(F.count(F.lit(1)).alias("tf"))


def bm25(df: DataFrame, id_col: str, text: str, query: Sequence[str], k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(id, score) of the k best documents: idf = ln(1 + (N - n + 0.5) / (n + 0.5)).

    Query terms count once. Only postings of the query's terms are shuffled; document length comes
    with each row, and the global figures are scalars. Ties go to the smaller id.
    """
    terms = sorted(set(query))
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")

    def count_of(term: str) -> Column:
        return F.size(F.filter("w", lambda x: x == term))

    docs = df.select(id_col, words.alias("w")).select(id_col, F.size("w").alias("len"), *[count_of(t).alias(f"tf{i}") for i, t in enumerate(terms)])
    one = docs.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    stats = one.select(F.struct("*")).scalar()
    joined = docs.filter(" or ".join(f"tf{i} > 0" for i in range(len(terms))) or "false").withColumn("g", stats)
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf, n_t = F.col(f"tf{i}").cast("double"), F.col(f"g.df{i}")
        idf = F.log1p((F.col("g.n") - n_t + 0.5) / (n_t + 0.5))
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("len") / F.col("g.avg")))
    return joined.select(id_col, F.round(score, 6).alias("score")).orderBy(F.desc("score"), id_col).limit(k)


def rank_of(expected: Column, returned: Column) -> Column:
    """Position of the expected id, from 1; NULL where it isn't returned."""
    return F.nullif(F.array_position(returned, expected), F.lit(0))


def predicate(template: Mapping, values: Mapping[str, Column | None], prune: Sequence[str] = ("must", "should")) -> Column:
    """Predicate of a boolean template {'must': [...], 'should': [...], 'filter': [...], 'must_not': [...]}.

    A clause is (column, operator, placeholder) or a template. Clauses whose placeholder has no value
    are pruned from the lists named in prune and can't match in the others; nodes left empty go. A
    template without a real clause matches nothing, not everything.
    """
    built = _node(template, values, prune)
    return F.lit(False) if built is None else built


_OPERATORS: dict[str, Callable[[Column, Column], Column]] = {
    "eq": lambda c, v: c == v,
    "prefix": lambda c, v: F.startswith(c, v),
    "contains": lambda c, v: F.contains(c, v),
    "ge": lambda c, v: c >= v,
    "le": lambda c, v: c <= v,
}


def _node(template: Mapping, values: Mapping[str, Column | None], prune: Sequence[str]) -> Column | None:
    def clauses(name: str) -> list[Column]:
        out = []
        for clause in template.get(name, ()):
            if isinstance(clause, Mapping):
                built = _node(clause, values, prune)
            else:
                column, op, placeholder = clause
                value = values.get(placeholder)
                built = None if value is None else F.coalesce(_OPERATORS[op](F.col(column), value), F.lit(False))
                if built is None and name not in prune:
                    built = F.lit(False)
            if built is not None:
                out.append(built)
        return out

    all_of = clauses("must") + clauses("filter")
    any_of, none_of = clauses("should"), clauses("must_not")
    if not (all_of or any_of):
        return None
    out = F.lit(True)
    for c in all_of:
        out = out & c
    if any_of and not all_of:
        some = F.lit(False)
        for c in any_of:
            some = some | c
        out = out & some
    for c in none_of:
        out = out & ~c
    return out


def tiered_score(tiers: Sequence[tuple[Column, int]], tie_break: Column) -> Column:
    """Sum of the boosts of the tiers that hold, plus a small tie-break: the highest tier dominates."""
    return sum((F.when(c, F.lit(boost)).otherwise(0) for c, boost in tiers), F.lit(0)) + F.least(tie_break, F.lit(99))


def log_records(df: DataFrame, text: str, start: str) -> DataFrame:
    """(position, record): a text split into records that each begin where ``start`` matches."""
    parts = F.filter(F.split(F.col(text), f"(?={start})"), lambda p: p.rlike(f"^(?:{start})"))
    return df.select("*", F.posexplode(parts).alias("position", "record"))


def segment_blocks(df: DataFrame, text: str, anchor: str, head: str, go_on: str, back: int = 3) -> DataFrame:
    """df with one row per line in which anchor occurs: block, first_line, last_line, lines (all counted from 0).

    A block begins at its anchor, or up to ``back`` lines before it: lines that begin with go_on are walked over, one that begins with
    head ends the walk and belongs to the block, any other ends it and doesn't. It ends where the next one begins. A text without an
    anchor gives no rows. A block may be empty if the next one begins at the same line.
    """
    lines = F.split(F.replace(F.col(text), F.lit("\r"), F.lit("")), "\n")
    at = lambda i: F.get("__lines", i)
    begins = lambda i, p: F.coalesce(at(i).rlike(f"^(?:{p})"), F.lit(False)) & (i >= 0)

    def start(i: Column) -> Column:
        out = i - back
        for k in range(back, 0, -1):
            line = i - k
            out = F.when(begins(line, head), line).when(begins(line, go_on), out if k < back else line).otherwise(i - (k - 1))
        return out

    split = df.withColumn("__lines", lines)
    anchors = F.filter(F.sequence(F.lit(0), F.size("__lines") - 1), lambda i: at(i).rlike(anchor))
    starts = split.withColumn("__anchors", anchors).filter(F.size("__anchors") > 0).withColumn("__starts", F.transform("__anchors", start))
    rows = starts.select(*df.columns, "__lines", "__starts", F.posexplode("__starts").alias("block", "first_line"))
    end = F.coalesce(F.get("__starts", F.col("block") + 1), F.size("__lines")) - 1
    return rows.withColumn("last_line", end).withColumn("lines", F.slice("__lines", F.col("first_line") + 1, F.greatest(end - F.col("first_line") + 1, F.lit(0)))).drop("__lines", "__starts")


def reconcile_blocks(lines: DataFrame, block: str, amount: str, subtotal: Column, tolerance: float = 0.01) -> DataFrame:
    """(block, total, subtotal, ok): line totals against the block's own subtotal line."""
    out = lines.groupBy(block).agg(F.sum(F.when(~subtotal, F.col(amount))).alias("total"), F.max(F.when(subtotal, F.col(amount))).alias("subtotal"))
    return out.withColumn("ok", F.coalesce(F.abs(F.col("total") - F.col("subtotal")) < tolerance, F.lit(False)))


def fuzzy_best_of(df: DataFrame, left: str, options: Sequence[str], cutoff: float) -> DataFrame:
    """df with best and ratio: the option most like the text. The list of options travels with each task.

    The ratio is that of matching blocks (Ratcliff and Obershelp). Below the cutoff both are NULL; ties go to the option that
    sorts first. No candidate is lost: only those are passed over whose letters in common, in any order, are too few
    for the cutoff or the best ratio so far.
    """
    schema = T.StructType([T.StructField("best", T.StringType()), T.StructField("ratio", T.DoubleType())])
    ordered = sorted(set(options))

    @F.pandas_udf(schema)
    def best(texts: pd.Series) -> pd.DataFrame:
        from collections import Counter
        from difflib import SequenceMatcher

        import numpy as np

        letters = {c: i for i, c in enumerate(sorted(set("".join(ordered))))}
        bags, lengths = np.zeros((len(ordered), len(letters)), dtype=np.int32), np.array([len(o) for o in ordered], dtype=np.int64)
        for row, option in zip(bags, ordered):
            for c, n in Counter(option).items():
                row[letters[c]] = n
        matchers = [SequenceMatcher(None, "", o) for o in ordered]
        known: dict = {None: (None, None)}
        for text in texts:
            if text in known:
                continue
            held = [(letters[c], n) for c, n in Counter(text).items() if c in letters]
            shared = np.minimum(bags[:, [i for i, _ in held]], [n for _, n in held]).sum(1) if held else np.zeros(len(ordered))
            bound = 2.0 * shared / np.maximum(lengths + len(text), 1)
            top = (None, None)
            for i in np.argsort(-bound, kind="stable"):
                if bound[i] < (cutoff if top[1] is None else top[1]):
                    break
                matchers[i].set_seq1(text)
                r = matchers[i].ratio()
                if r >= cutoff and (top[1] is None or r > top[1] or r == top[1] and ordered[i] < top[0]):
                    top = (ordered[i], r)
            known[text] = top
        return pd.DataFrame([known[t] for t in texts], columns=["best", "ratio"])

    return df.withColumn("__b", best.asNondeterministic()(F.col(left))).select(*df.columns, "__b.best", "__b.ratio")


QA = T.ArrayType(T.StructType([T.StructField("question", T.StringType()), T.StructField("answer", T.StringType()), T.StructField("answered", T.BooleanType())]))
#: Answers that say nothing.
EMPTY_ANSWERS = {"", "n/a", "na", "none", "null", "unknown", "not recorded", "not asked"}


def question_answers(df: DataFrame, source: str, question_keys: Sequence[str], answer_keys: Sequence[str]) -> DataFrame:
    """df with qa, the question-answer pairs at any depth of a JSON text, repeats dropped.

    A text answer beats a boolean one for the same question. An empty list comes from null, broken
    or question-free texts. Runs in Arrow batches.
    """
    from weftline.functions.jsontext import as_text, parse_unwrapped

    def walk(value) -> Iterator[tuple[str, object]]:
        stack = [value]
        while stack:
            v = stack.pop()
            if isinstance(v, dict):
                q = next((v[k] for k in question_keys if isinstance(v.get(k), str)), None)
                if q is not None:
                    yield q, next((v[k] for k in answer_keys if k in v), None)
                stack.extend(reversed(v.values()))
            elif isinstance(v, list):
                stack.extend(reversed(v))

    @F.pandas_udf(QA)
    def extract(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            found: dict[str, object] = {}
            if text is not None:
                try:
                    value = parse_unwrapped(text)
                except ValueError:
                    value = None
                for q, a in walk(value):
                    if q not in found or (isinstance(found[q], bool) or found[q] is None) and isinstance(a, str):
                        found[q] = a
            out.append([{"question": q, "answer": as_text(a), "answered": a is not None and str(as_text(a)).strip().lower() not in EMPTY_ANSWERS} for q, a in found.items()])
        return pd.Series(out)

    return df.withColumn("qa", extract(F.col(source)))
