"""Column expressions with defined rules for nulls, ties and rounding.

Lenient conversions use the try_ functions only: with ANSI mode on, a bad cast would fail the job.
Patterns are passed as literals of the DataFrame API and never pasted into SQL text, where a
backslash would be unescaped.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def filled(c: Column) -> Column:
    """Neither null nor blank; never null itself."""
    return F.coalesce(F.trim(c) != "", F.lit(False))


def band(c: Column, limits: Sequence[tuple[float, str]], below: str) -> Column:
    """Label of the first limit that c reaches, limits from high to low; null and rest give below."""
    out = F.lit(below)
    for limit, label in reversed(limits):
        out = F.when(c >= F.lit(limit), F.lit(label)).otherwise(out)
    return out


def first_match(cases: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """The value of the first true case, in the given order; a null condition isn't taken."""
    out = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    for condition, value in reversed(cases):
        out = F.when(condition, value if isinstance(value, Column) else F.lit(value)).otherwise(out)
    return out


def null_if_sentinel(c: Column, sentinels: Sequence[str]) -> Column:
    """NULL where the text, trimmed and in upper case, is one of the sentinels or blank."""
    folded = F.upper(F.trim(c))
    return F.when(folded.isin(*[s.upper() for s in sentinels]) | (folded == ""), None).otherwise(c)


def agree(left: Column, right: Column) -> Column:
    """1 where both sides are equal, 0 where they differ, NULL where one is null."""
    return F.when(left.isNull() | right.isNull(), None).otherwise((left == right).cast("int"))


def flags(text: Column, rules: Mapping[str, str]) -> dict[str, Column]:
    """One 0/1 column per named pattern; null text gives 0."""
    return {name: F.coalesce(text.rlike(pattern), F.lit(False)).cast("int") for name, pattern in rules.items()}


def evidence(text: Column, rules: Mapping[str, str]) -> Column:
    """``name[matched text]`` of every rule that fires, in order, joined by '; '; '' if none does."""
    parts = []
    for name, pattern in rules.items():
        hit = F.regexp_extract(text, pattern, 0)
        parts.append(F.when(hit != "", F.concat(F.lit(f"{name}["), hit, F.lit("]"))))
    return F.concat_ws("; ", *parts)


def pattern_string(parts: Mapping[str, Column], none: str = "none") -> Column:
    """Names of the true parts in order, joined by '+'; ``none`` where no part is true."""
    joined = F.concat_ws("+", *[F.when(F.coalesce(c.cast("boolean"), F.lit(False)), F.lit(n)) for n, c in parts.items()])
    return F.when(joined == "", F.lit(none)).otherwise(joined)


def presence_code(parts: Mapping[str, Column]) -> Column:
    """Codes of the filled inputs in fixed order, joined."""
    return F.concat_ws("", *[F.when(filled(c.cast("string")), F.lit(code)) for code, c in parts.items()])


def money(c: Column) -> Column:
    """Amount from text with $, thousands commas, (x) for negative or %; NULL where there is none.

    A percentage becomes a fraction.
    """
    t = F.trim(c)
    bare = F.regexp_replace(t, r"[$,%()\s]", "")
    value = bare.try_cast("decimal(18,4)")
    value = F.when(t.rlike(r"^\(.*\)$"), -value).otherwise(value)
    return F.when(t.endswith("%"), (value / 100).cast("decimal(18,4)")).otherwise(value)


def money_text(c: Column) -> Column:
    """Amount as text with two decimals; blank and unreadable stay ''."""
    amount = money(c)
    return F.when(amount.isNotNull(), F.format_string("%.2f", F.bround(amount, 2).cast("double"))).otherwise(F.lit(""))


def split_name(c: Column) -> tuple[Column, Column]:
    """(first, last) from 'Last, First' or 'First Last', in title case; '' where missing.

    After rotation the last word is the surname and the first word the given name; a single word
    is a given name.
    """
    t = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    comma = F.instr(t, ",") > 0
    after, before = F.trim(F.substring_index(t, ",", -1)), F.trim(F.substring_index(t, ",", 1))
    rotated = F.when(comma, F.trim(F.concat_ws(" ", after, before))).otherwise(t)
    words = F.split(rotated, " ")
    first = F.initcap(F.coalesce(F.try_element_at(words, F.lit(1)), F.lit("")))
    last = F.when(F.size(words) > 1, F.initcap(F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit("")))).otherwise(F.lit(""))
    return first, last


def lenient_date(c: Column, layouts: Sequence[str] = ("yyyy-MM-dd", "MM/dd/yyyy", "yyyyMMdd", "dd-MMM-yyyy")) -> Column:
    """Date by the first layout that fits, NULL if none does."""
    return F.coalesce(*[F.try_to_date(F.trim(c), layout) for layout in layouts])


def us_date_text(c: Column) -> Column:
    """MM/dd/yyyy of a lenient date; '' where it can't be read."""
    return F.coalesce(F.date_format(lenient_date(c), "MM/dd/yyyy"), F.lit(""))


def age_years(c: Column) -> Column:
    """Age in whole years from text; the first unit that matches decides; newborn is 0."""
    t = F.lower(c)

    def number(unit: str) -> Column:
        return F.nullif(F.regexp_extract(t, rf"(\d+)\s*(?:{unit})\b", 1), F.lit("")).try_cast("double")

    value = F.coalesce(
        number("years?|yrs?|y/?o|y"), number("months?|mos?") / 12, number("weeks?|wks?") / 52, number("days?|d") / 365,
        F.when(t.rlike("newborn"), F.lit(0.0)), F.trim(t).try_cast("double"),
    )
    return F.floor(value).cast("int")


def minutes(c: Column) -> Column:
    """Minutes from a number, H:MM or H:MM:SS; NULL where unreadable."""
    parts = F.split(F.trim(c), ":")
    at = lambda i: F.try_element_at(parts, F.lit(i)).try_cast("double")
    return F.when(F.size(parts) == 1, at(1)).when(F.size(parts).isin(2, 3), at(1) * 60 + at(2) + F.coalesce(at(3), F.lit(0.0)) / 60)


def minutes_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(6e7)


def mask_name(c: Column) -> Column:
    """Initial of each word."""
    return F.regexp_replace(c, r"(\p{L})\p{L}+", "$1.")


def mask_digits(c: Column, keep: int = 4) -> Column:
    """Every digit but the last ``keep`` as *."""
    return F.regexp_replace(c, rf"\d(?=(?:\D*\d){{{keep}}})", "*")


def _marked() -> dict[str, str]:
    """Latin letters with marks and the letters below them."""
    pairs = {chr(c): unicodedata.normalize("NFD", chr(c))[0] for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))}
    return {c: base for c, base in pairs.items() if base.isascii() and base.isalpha()}


def strip_accents(c: Column) -> Column:
    """Letters without their marks, be those part of a Latin letter or characters of their own."""
    marked = _marked()
    return F.regexp_replace(F.translate(c, "".join(marked), "".join(marked.values())), r"\p{Mn}+", "")


def token_shape(c: Column) -> Column:
    """Shape of a text: capitals A, small letters a, digits 9, runs folded."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[A-Z]+", "A"), "[a-z]+", "a"), "[0-9]+", "9")
    return t


def sanitize(c: Column) -> Column:
    """Text without control characters, tab and line ends kept."""
    return F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")


def key_value(text: Column, key: str, default: str = "") -> Column:
    """Value of ``key=value`` or ``key: value`` in a log line."""
    hit = F.regexp_extract(text, rf"(?i)\b{key}\s*[=:]\s*\"?([^\s,\"}}]*)", 1)
    return F.when(F.coalesce(hit, F.lit("")) == "", F.lit(default)).otherwise(hit)


def fenced_json(text: Column) -> Column:
    """The JSON in an answer: as it is, between code fences, or from the first bracket to the last; NULL where none is well formed."""
    t = F.trim(text)
    fenced = F.regexp_extract(t, r"(?s)```[A-Za-z]*\s*(.*?)\s*```", 1)
    inside = F.regexp_extract(t, r"(?s)(\{.*\}|\[.*\])", 1)
    good = lambda c: F.when(F.coalesce(c, F.lit("")).rlike(r"^\s*[\[{]") & F.try_parse_json(c).isNotNull(), c)
    return F.coalesce(good(t), good(fenced), good(inside))


def longest_prefix(c: Column, prefixes: Mapping[str, str]) -> Column:
    """Value of the longest prefix that c starts with."""
    return first_match([(c.startswith(p), v) for p, v in sorted(prefixes.items(), key=lambda kv: (-len(kv[0]), kv[0]))])


def title_place(c: Column, codes: Mapping[str, str]) -> Column:
    """Place name: two-letter codes spelled out, 'county' dropped, st. as Saint, title case."""
    t = F.trim(F.regexp_replace(F.lower(F.trim(c)), r"\s+county$", ""))
    t = F.regexp_replace(t, r"^st\.?\s+", "saint ")
    spelled = first_match([(t == k.lower(), v) for k, v in codes.items()])
    return F.coalesce(spelled, F.initcap(t))


def count_markers(text: Column, markers: Sequence[str]) -> Column:
    """How many of the markers occur in the text, case folded."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.contains(t, F.lit(m.lower())).cast("int") for m in markers), F.lit(0))


def lexicon_tags(text: Column, lexicon: Mapping[str, Sequence[str]]) -> Column:
    """Names of the lexicon entries of which a word occurs, in order."""
    t = F.lower(F.coalesce(text, F.lit("")))
    hits = []
    for name, words in lexicon.items():
        any_word = F.lit(False)
        for w in words:
            any_word = any_word | F.contains(t, F.lit(w.lower()))
        hits.append(F.when(any_word, F.lit(name)))
    return F.array_compact(F.array(*hits))


def fill_template(template: Column, tokens: Column) -> Column:
    """Template with each ``{token}`` of a map column replaced by its value."""
    return F.aggregate(F.map_entries(tokens), template, lambda acc, kv: F.replace(acc, F.concat(F.lit("{"), kv["key"], F.lit("}")), F.coalesce(kv["value"], F.lit(""))))


def wilson(successes: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval; NULL at n = 0."""
    n = F.when(n > 0, n.cast("double"))
    p = successes / n
    centre, width = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (centre - width) / (1 + z * z / n), (centre + width) / (1 + z * z / n)


def movement(now: Column, before: Column, higher_is_better: bool, tolerance: float = 0.05) -> Column:
    """unchanged within the tolerance, else improved or regressed; missing or zero before: not comparable."""
    change = F.try_divide(now - before, F.abs(before))
    good, bad = ("improved", "regressed") if higher_is_better else ("regressed", "improved")
    return first_match([(change.isNull(), "not comparable"), (F.abs(change) <= tolerance, "unchanged"), (change > 0, good)], bad)
