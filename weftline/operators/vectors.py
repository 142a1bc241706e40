"""Agreement levels of all pairs within blocks, counted by comparison vector without a row per pair.

Pairs grow with the square of a block, their vectors don't: they are told apart and counted inside the tasks, which give one
row per vector. Every pair is counted, and its levels are those of ``linkage.agreement``. A task has the rows of a block, or of
two parts of a hot one, and compares their distinct values: a signature of the letters in a value rules out most pairs of
values, the edits of the others are counted bit by bit, many pairs at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.tables import small
from weftline.operators.joins import PART_ROWS

#: A vector is one number, two bits per feature, and each task has a counter for each possible one.
MOST_FEATURES = 11
#: Blocks of up to so many rows are compared by lists of pairs, larger ones as tables of rows against rows.
LISTED_ROWS = 128
#: Rows that are taken together, pairs of a list, pairs of a stretch of a table, pairs whose edits are counted at once, vectors kept until they are counted.
BATCH_ROWS, LIST, STRETCH, AT_ONCE, KEPT = 20_000, 1 << 18, 1 << 17, 1 << 14, 1 << 22
#: Letters by their number modulo CLASSES; a signature has RUN bits for each class, as many set as letters of it, at most all.
CLASSES, RUN = 17, 3
#: Characters of values that are compared bit by bit in one machine word.
WORD = 64


def edits(a: str, b: str) -> int:
    """Levenshtein distance of two non-empty texts of any length, by Myers' bit vectors in Hyyrö's form."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    all_bits, top, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    up, down = all_bits, 0
    for c in b:
        eq = where.get(c, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        rise, fall = down | ~(h | up) & all_bits, up & h
        score += bool(rise & top) - bool(fall & top)
        rise, fall = (rise << 1 | 1) & all_bits, fall << 1 & all_bits
        up, down = fall | ~(v | rise) & all_bits, rise & v
    return score


class Values:
    """The values of one feature in a batch of rows by code; 0 is a missing one, null or blank."""

    def __init__(self, column: pa.Array):
        coded = column.dictionary_encode()
        texts = coded.dictionary.to_pylist()
        filled = np.array([t.strip(" ") != "" for t in texts], bool)
        number = np.concatenate([[0], np.where(filled, np.cumsum(filled), 0)]).astype(np.int32)
        self.codes = number[pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False) + 1]
        self.texts = ["", *[t for t, there in zip(texts, filled) if there]]
        self.lengths = np.array([len(t) for t in self.texts], np.int64)
        self.there = np.where(self.lengths > 0, 3, 0).astype(np.uint8)
        # an edit changes the counts of at most two classes by one
        self.reach = np.minimum(2 * (self.lengths // 5), 250).astype(np.uint8)
        self.chars = self._characters()
        self.signs = self._signatures()

    def _characters(self) -> np.ndarray:
        """Row i has character i of every value, numbered from 1; 0 beyond its end. Of values longer than a word only the first characters."""
        width = max(1, min(WORD, int(self.lengths.max())))
        raw = np.array(self.texts, dtype=f"<U{width}").view(np.uint32).reshape(len(self.texts), width)
        signs, at = np.unique(raw, return_inverse=True)
        self.inside = np.arange(width)[:, None] < self.lengths[None, :]
        kind = np.uint8 if len(signs) < 255 else np.uint16 if len(signs) < 65_535 else np.uint32
        self.raw = raw
        return np.where(self.inside, at.reshape(raw.shape).T + 1, 0).astype(kind)

    def _signatures(self) -> np.ndarray:
        counts = np.zeros((len(self.texts), CLASSES), np.int64)
        every = np.arange(len(self.texts))
        for i, inside in enumerate(self.inside):
            counts[every, self.raw[:, i] % CLASSES] += inside
        for i in np.flatnonzero(self.lengths > WORD):
            counts[i] = np.bincount([ord(c) % CLASSES for c in self.texts[i]], minlength=CLASSES)
        del self.raw, self.inside
        bits = (1 << np.minimum(counts, RUN)) - 1
        return (bits << (RUN * np.arange(CLASSES))).sum(axis=1).astype(np.uint64)

    def levels(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """linkage.agreement of the values of codes x and y, of the shape to which both broadcast."""
        out = self.there[x] & self.there[y]
        near = np.bitwise_count(self.signs[x] ^ self.signs[y]) <= np.maximum(self.reach[x], self.reach[y])
        at = np.flatnonzero(near & (out != 0))
        if len(at):
            place = np.unravel_index(at, out.shape)
            out.reshape(-1)[at] = self._near(*(np.broadcast_to(c, out.shape)[place] for c in (x, y)))
        return out

    def _near(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        level = np.where(x == y, 1, 3).astype(np.uint8)
        longest = np.maximum(self.lengths[x], self.lengths[y])
        left = np.flatnonzero((x != y) & (np.abs(self.lengths[x] - self.lengths[y]) <= longest // 5))
        long = longest[left] > WORD
        for at in np.split(left[~long], range(AT_ONCE, len(left[~long]), AT_ONCE)):
            level[at] = self._graded(self._edits(x[at], y[at]), longest[at])
        for i in left[long]:
            level[i] = self._graded(np.array([edits(self.texts[x[i]], self.texts[y[i]])]), longest[i : i + 1])[0]
        return level

    @staticmethod
    def _graded(distance: np.ndarray, longest: np.ndarray) -> np.ndarray:
        alike = 1 - distance / longest
        return np.where((longest >= 20) & (alike >= 0.95), 1, np.where(distance <= longest // 5, 2, 3))

    def _edits(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """edits of many pairs of values, none longer than a word."""
        if not len(x):
            return np.zeros(0, np.int64)
        longest = int(max(self.lengths[x].max(), self.lengths[y].max()))
        kind = np.uint16 if longest <= 16 else np.uint64
        a, b = self.chars[:longest].take(x, axis=1), self.chars[:longest].take(y, axis=1)
        ends, score = self.lengths[y], self.lengths[x].astype(np.int16)
        top = kind(1) << (self.lengths[x] - 1).astype(kind)
        up, down, one = np.full(len(x), ~kind(0)), np.zeros(len(x), kind), kind(1)
        for j in range(longest):
            eq = np.zeros(len(x), kind)
            for i in range(longest):
                eq |= (a[i] == b[j]).astype(kind) << kind(i)
            v = eq | down
            h = (((eq & up) + up) ^ up) | eq
            rise, fall = down | ~(h | up), up & h
            score += (((rise & top) != 0).astype(np.int16) - ((fall & top) != 0)) * (j < ends)
            rise, fall = rise << one | one, fall << one
            up, down = fall | ~(v | rise), rise & v
        return score.astype(np.int64)


class Counter:
    """Vectors of pairs, counted when enough have come."""

    def __init__(self, features: int):
        self.counts, self.kept, self.waiting = np.zeros(4**features, np.int64), [], 0

    def add(self, vectors: np.ndarray) -> None:
        self.kept.append(vectors.reshape(-1))
        self.waiting += vectors.size
        if self.waiting >= KEPT:
            self.settle()

    def settle(self) -> np.ndarray:
        if self.kept:
            self.counts += np.bincount(np.concatenate(self.kept), minlength=len(self.counts))
        self.kept, self.waiting = [], 0
        return self.counts


def _listed(features: list[Values], starts: np.ndarray, sizes: np.ndarray, counter: Counter) -> None:
    """All pairs within small blocks: each row with those behind it in its block."""
    rows = np.concatenate([np.arange(s, s + n) for s, n in zip(starts, sizes)])
    behind = np.repeat(starts + sizes, sizes) - 1 - rows
    ends = np.cumsum(behind)
    cuts = np.unique(np.concatenate([[0], np.searchsorted(ends, np.arange(LIST, ends[-1], LIST), "right"), [len(rows)]]))
    for p, q in zip(cuts[:-1], cuts[1:]):
        i = np.repeat(rows[p:q], behind[p:q])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(behind[p:q]) - behind[p:q], behind[p:q])
        vectors = np.zeros(len(i), np.uint32)
        for f, values in enumerate(features):
            vectors |= values.levels(values.codes[i], values.codes[j]).astype(np.uint32) << np.uint32(2 * f)
        counter.add(vectors)


def _tabled(features: list[Values], a: np.ndarray, b: np.ndarray | None, counter: Counter) -> None:
    """All pairs of a row of a and one of b, or of two rows of a. Levels are found per pair of distinct values."""
    other = a if b is None else b
    step = max(1, STRETCH // len(other))
    stretches = [(at, min(at + step, len(a)), 0 if b is not None else at) for at in range(0, len(a), step)]
    vectors = np.zeros((len(a), len(other)), np.uint32)
    for f, values in enumerate(features):
        (x, i), (y, j) = (np.unique(values.codes[rows], return_inverse=True) for rows in (a, other))
        table = values.levels(x[:, None], y[None, :]).astype(np.uint32) << np.uint32(2 * f)
        for at, end, first in stretches:
            vectors[at:end, first:] |= table[i[at:end]].take(j[first:], axis=1)
    if b is not None:
        counter.add(vectors)
        return
    for at, end, _ in stretches:
        counter.add(vectors[at:end, end:])
        counter.add(vectors[at:end, at:end][np.triu_indices(end - at, 1)])


def _whole(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of equal keys from batches in which equal keys follow each other, with the first row of each group."""

    def firsts(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), bool)
        new[0] = True
        for k in keys:
            c = table.column(k).combine_chunks()
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
        return np.flatnonzero(new)

    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not len(batch):
            continue
        waiting.append(batch)
        if sum(map(len, waiting)) < BATCH_ROWS:
            continue
        table = pa.Table.from_batches(waiting)
        starts = firsts(table)
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts[:-1]
            table = table.slice(starts[-1])
        waiting = table.combine_chunks().to_batches()
    if waiting:
        table = pa.Table.from_batches(waiting)
        yield table, firsts(table)


def vector_counts(rows: DataFrame, keys: Sequence[str], id_col: str, features: Mapping[str, str], part_rows: int = PART_ROWS) -> DataFrame:
    """(features, n): how many pairs of rows that share the keys have these levels, one row per vector that occurs.

    features gives the text column of each feature; levels are those of linkage.agreement. Ids are unique, null keys pair
    with nothing. A block with more than part_rows rows is dealt to parts by a hash of the id, and every two parts meet in one group.
    """
    names = list(features)
    if len(names) > MOST_FEATURES:
        raise ValueError(f"at most {MOST_FEATURES} features: {names}")
    blocked = rows.select(F.col(id_col).alias("__id"), *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(f"__f{i}") for i, c in enumerate(features.values())])
    block = [f"__k{i}" for i in range(len(keys))]
    blocked = blocked.dropna(subset=block)
    hot = blocked.groupBy(*block).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > part_rows)
    parts = F.coalesce(F.ceil(F.col("__n") / part_rows), F.lit(1)).cast("int")
    dealt = blocked.join(small(hot), block, "left").withColumn("__parts", parts).withColumn("__part", F.pmod(F.xxhash64("__id"), F.col("__parts")).cast("int"))
    met = dealt.withColumn("__with", F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)))
    group = [*block, "__lo", "__hi"]
    sent = met.withColumns({"__lo": F.least("__part", "__with"), "__hi": F.greatest("__part", "__with"), "__second": F.col("__part") > F.col("__with")})
    sent = sent.select(*group, "__second", *[f"__f{i}" for i in range(len(names))])
    # the number of partitions is named, as rows are few where pairs are many and small partitions would be joined
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = sent.repartition(tasks, *group).sortWithinPartitions(*group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(len(names))
        for table, starts in _whole(batches, group):
            sizes = np.diff(np.append(starts, len(table)))
            table, sizes = table.filter(pa.array(np.repeat(sizes > 1, sizes))), sizes[sizes > 1]
            if not len(sizes):
                continue
            starts = np.cumsum(sizes) - sizes
            values = [Values(table.column(f"__f{i}").combine_chunks()) for i in range(len(names))]
            second = table.column("__second").to_numpy()
            split = (table.column("__lo").to_numpy() != table.column("__hi").to_numpy())[starts]
            listed = (sizes <= LISTED_ROWS) & ~split
            if listed.any():
                _listed(values, starts[listed], sizes[listed], counter)
            for s, n, two in zip(starts[~listed], sizes[~listed], split[~listed]):
                at = np.arange(s, s + n)
                a, b = (at[~second[at]], at[second[at]]) if two else (at, None)
                if len(a) and (b is None or len(b)):
                    _tabled(values, a, b, counter)
        counts = counter.settle()
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(counts[seen], pa.int64())], ["vector", "n"])

    total = sorted_rows.mapInArrow(run, "vector long, n long").groupBy("vector").agg(F.sum("n").alias("n"))
    return total.select(*[F.shiftright("vector", 2 * i).bitwiseAND(3).cast("int").alias(f) for i, f in enumerate(names)], "n")
