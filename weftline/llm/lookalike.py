"""One consistent form for texts that look the same but are made of other characters.

``canonical`` gives the form for comparisons: compatibility normalisation in composed form,
look-alike letters of other scripts resolved word by word, full case folding, every white space
as a space or line feed, and no default-ignorable characters. ``look`` keeps what a reader sees
(case, superscripts, signs) and drops only what no reader sees; it is the exact check that two
texts of one canonical form also look the same.

Both run on the distinct values of each Arrow batch. NULL stays NULL; an empty or invisible text
becomes an empty one, which looks like nothing and pairs with nothing.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters of other scripts that look like a Latin letter, and that letter.
CYRILLIC = dict(zip("АВЕЅІЈКМНОРСТХаеѕіјорсухһԁԛԝӏҮүѴѵԚԜ", "ABESIJKMHOPCTXaesijopcyxhdqwlYyVvQW"))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϳαιρυ", "ABEZHIKMNOPTYXovjaipu"))
ARMENIAN = dict(zip("ՕՍՏԼօոսհզցյ", "OUSLonuhqgj"))
CHEROKEE = dict(zip("ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ", "ABCDEGHJKLMPRSTVWZ"))
#: Each script with the ranges of its letters.
_SCRIPTS = (("Ͱ-Ͽἀ-῿", GREEK), ("Ѐ-ԯ", CYRILLIC), ("԰-֏", ARMENIAN), ("Ꭰ-᏿ꭰ-ꮿ", CHEROKEE))
_LATIN = {k: v for _, letters in _SCRIPTS for k, v in letters.items()}
_FOREIGN = re.compile(f"[{''.join(_LATIN)}]")
#: Back to a script; of two letters for one Latin letter the first in the list.
_BACK = [(re.compile(f"[{ranges}]"), str.maketrans({v: k for k, v in reversed(letters.items())})) for ranges, letters in _SCRIPTS]
_OTHER = re.compile(f"[{''.join(ranges for ranges, _ in _SCRIPTS)}]")
#: A word with its combining marks.
_WORD = re.compile(r"(?:[^\W\d_][̀-ͯ]*)+")
_BLANKS = re.compile(r" {2,}")
#: Line ends other than the line feed.
_LINES = "\r\x0b\x0c\x85\u2028\u2029"
_LINE_ENDS = re.compile(f"\r\n|[{_LINES}]")


@lru_cache(1)
def _ignorable() -> dict[int, None]:
    """Default-ignorable characters, by rule: format characters, variation selectors and fillers.

    The zero-width joiner is left to _joiners, as it binds emoji into one sign.
    """
    out = {c: None for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) == "Cf" and c != 0x200D}
    for a, b in ((0x34F, 0x34F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0000, 0xE0FFF)):
        out |= dict.fromkeys(range(a, b + 1))
    for c in (0x600, 0x601, 0x602, 0x603, 0x604, 0x605, 0x6DD, 0x70F):  # format characters that are seen
        out.pop(c, None)
    return out


@lru_cache(1)
def _unseen() -> dict[int, str | None]:
    """Characters whose compatibility form looks the same: widths, spaces, ligatures, digraphs."""
    out: dict[int, str | None] = {}
    for c in range(0x10000):
        ch = chr(c)
        kind, _, rest = unicodedata.decomposition(ch).partition("> ")
        if ch.isspace() and ch not in _LINES + "\n":
            out[c] = " "
        elif kind in ("<wide", "<narrow", "<noBreak"):
            out[c] = "".join(chr(int(x, 16)) for x in rest.split())
        elif kind == "<compat" and (0xFB00 <= c <= 0xFB06 or 0x2024 <= c <= 0x2026 or 0x1C4 <= c <= 0x1CC or 0x1F1 <= c <= 0x1F3 or 0x132 <= c <= 0x133 or 0x2160 <= c <= 0x217F):
            out[c] = unicodedata.normalize("NFKC", ch)
    return out | _ignorable()


_JOINER = re.compile("‍")


def _joiners(text: str) -> str:
    """Drop zero-width joiners that join no two pictographs."""

    def keep(m: re.Match) -> str:
        a, b = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        pictures = {"So", "Sk"}
        return "‍" if a and b and unicodedata.category(a) in pictures and unicodedata.category(b) in pictures else ""

    return _JOINER.sub(keep, text) if "‍" in text else text


def _blanks(text: str) -> str:
    text = _BLANKS.sub(" ", _LINE_ENDS.sub("\n", text))
    return text.replace(" \n", "\n").replace("\n ", "\n").strip(" \n")


@lru_cache(1)
def _unseen_letters() -> re.Pattern:
    """Class of the characters that _unseen maps, so that all others pass untouched."""
    marked = sorted(_unseen())
    ranges, start = [], None
    for i, c in enumerate(marked):
        start = c if start is None else start
        if i + 1 == len(marked) or marked[i + 1] != c + 1:
            ranges.append(f"\\U{start:08x}-\\U{c:08x}")
            start = None
    return re.compile("[" + "".join(ranges) + "]")


def _seen(text: str) -> str:
    table = _unseen()
    return _unseen_letters().sub(lambda m: table[ord(m.group())] or "", text)


def _skeleton(text: str) -> str:
    """Look-alike letters as Latin ones, accents composed."""
    if not _OTHER.search(text):
        return unicodedata.normalize("NFC", text)
    return unicodedata.normalize("NFC", _FOREIGN.sub(lambda m: _LATIN[m.group()], unicodedata.normalize("NFD", text)))


def _own_script(text: str) -> str:
    """Words that hold a letter of another script beyond the look-alikes go back to that script.

    The choice depends on the skeleton alone, so texts of one skeleton stay equal.
    """
    if not _OTHER.search(text):
        return text

    def back(m: re.Match) -> str:
        word = m.group()
        other = _OTHER.search(word)
        if not other:
            return word
        return word.translate(next(table for script, table in _BACK if script.match(other.group())))

    return unicodedata.normalize("NFC", _WORD.sub(back, unicodedata.normalize("NFD", text)))


def look(text: str) -> str:
    """What a reader sees of the text."""
    if text.isascii():
        return _blanks(text.replace("\t", " "))
    return _blanks(_skeleton(_joiners(_seen(text))))


def canonical(text: str) -> str:
    """The consistent form for comparisons."""
    if text.isascii():
        return _blanks(text.replace("\t", " ")).casefold()
    t = unicodedata.normalize("NFKC", _joiners(_seen(text)))
    return _blanks(unicodedata.normalize("NFKC", _own_script(_skeleton(t)).casefold()))


def _digest(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()


def _per_distinct(s: pd.Series, f) -> pd.Series:
    codes, values = pd.factorize(s, use_na_sentinel=True)
    done = [f(v) for v in values]
    return pd.Series([None if c < 0 else done[c] for c in codes], dtype=object)


@F.pandas_udf(T.StringType())
def canonical_form(s: pd.Series) -> pd.Series:
    return _per_distinct(s, canonical)


_KEYS = [("canon", pa.binary()), ("look", pa.binary()), ("chars", pa.binary())]


def keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, canon, look, chars) of the texts in which something is seen: digests of the canonical
    form, the look and the characters. One pass; repeated values of a batch are digested once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done: dict[str, tuple | None] = {}
            ids, rows = [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if text is None:
                    continue
                if text not in done:
                    seen = look(text)
                    done[text] = (_digest(canonical(text)), _digest(seen), _digest(text)) if seen else None
                if done[text]:
                    ids.append(i)
                    rows.append(done[text])
            cols = list(zip(*rows)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.column(0).type), *(pa.array(c, t) for c, (_, t) in zip(cols, _KEYS))], names=["doc_id", *(n for n, _ in _KEYS)])

    picked = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return picked.mapInArrow(run, T.StructType([picked.schema["doc_id"]] + [T.StructField(n, T.BinaryType()) for n, _ in _KEYS]))


def look_classes(keys: DataFrame) -> DataFrame:
    """(canon, look, chars, doc_id, n): each distinct text with its smallest id and copies."""
    return keys.groupBy("canon", "look", "chars").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))


#: Pairs that a salted part of a join is to hold, and the most parts of one key.
PART_PAIRS, MAX_PARTS = 1_000_000, 4096


def _all_pairs(keys: DataFrame) -> DataFrame:
    """Pairs of different texts of a look, each expanded to the pairs of their documents.

    Copies of a text never meet, so the work is that of the result. Both joins are salted by the
    number of pairs: one side is dealt to the parts, the other is copied to each.
    """
    parts = lambda n: F.least(F.ceil(n / PART_PAIRS), F.lit(MAX_PARTS)).cast("int")
    dealt = lambda c: F.pmod(F.xxhash64(c), F.col("parts")).cast("int").alias("salt")
    copied = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt")
    texts = look_classes(keys)
    classes = texts.groupBy("canon", "look").agg(F.count(F.lit(1)).alias("n_texts")).filter("n_texts > 1")
    texts = texts.join(classes.select("canon", "look", parts(F.col("n_texts") * F.col("n_texts")).alias("parts")), ["canon", "look"])
    side = lambda x, salt: texts.select("canon", "look", F.col("chars").alias(f"chars_{x}"), F.col("n").alias(f"n_{x}"), salt)
    pairs = side("a", dealt("chars")).join(side("b", copied), ["canon", "look", "salt"]).filter("chars_a < chars_b")
    pairs = pairs.select("chars_a", "chars_b", parts(F.col("n_a") * F.col("n_b")).alias("parts"))
    docs = lambda x: pairs.join(keys.select(F.col("chars").alias(f"chars_{x}"), F.col("doc_id").alias(x)), f"chars_{x}")
    a, b = docs("a").select("chars_a", "chars_b", "a", dealt("a")), docs("b").select("chars_a", "chars_b", "b", copied)
    return a.join(b, ["chars_a", "chars_b", "salt"]).select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"))


def look_pairs(keys: DataFrame, max_class_pairs: int | None = None) -> DataFrame:
    """(doc_id_a, doc_id_b) of texts that look the same but differ in characters, a < b.

    Candidates share the canonical form; the look decides. Copies of one text make no pair. All pairs
    come out, unless the caller sets max_class_pairs: then a class with more pairs of documents (a hot
    text with variants) isn't expanded, and each document of it is linked to the smallest document of
    another text of the class, which keeps every document linked at linear size.
    """
    if max_class_pairs is None:
        return _all_pairs(keys)
    texts = look_classes(keys)
    per_class = (
        texts.groupBy("canon", "look")
        .agg(F.count(F.lit(1)).alias("n_texts"), F.sum("n").alias("n_docs"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.min(F.struct("doc_id", "chars")).alias("first"))
        .filter("n_texts > 1")
        .withColumn("wide", (F.col("n_docs") * F.col("n_docs") - F.col("squares")) / 2 > max_class_pairs)
    )
    docs = keys.join(per_class.select("canon", "look", "wide", "first"), ["canon", "look"])
    a, b = (docs.filter("not wide").select("canon", "look", F.col("chars").alias(f"chars_{x}"), F.col("doc_id").alias(f"doc_id_{x}")) for x in "ab")
    full = a.join(b, ["canon", "look"]).filter("chars_a <> chars_b and doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b")
    second = (
        texts.join(per_class.filter("wide").select("canon", "look", "first"), ["canon", "look"])
        .filter("chars <> first.chars").groupBy("canon", "look").agg(F.min("doc_id").alias("second"))
    )
    star = docs.filter("wide").join(second, ["canon", "look"]).withColumn("to", F.when(F.col("chars") == F.col("first.chars"), F.col("second")).otherwise(F.col("first.doc_id")))
    star = star.select(F.least("doc_id", "to").alias("doc_id_a"), F.greatest("doc_id", "to").alias("doc_id_b")).distinct()
    return full.unionByName(star)

