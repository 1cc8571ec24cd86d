"""Letter bigrams of the corpus in a table of fixed size.

Counts are kept in hashed buckets, so that the model has one size whatever alphabets the corpus holds; that bound is
what allows it to be sent to every worker. Counting is done where the rows are, on whole columns of characters at a
time; only one row per bucket and task leaves a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PAIR_BITS, LETTER_BITS = 17, 13
PAIRS, LETTERS = 1 << PAIR_BITS, 1 << LETTER_BITS
SMOOTHING, ALPHABET = 0.05, 400.0
MIX_A, MIX_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
EDGE = 32  # a space stands before and after a text


def _classes(fold: bool = True) -> np.ndarray:
    """The class of each code point: lower case, one class for digits, for spaces and for each block of ideographs.

    Without `fold` capitals are classes of their own.
    """
    table = np.arange(0x30000, dtype=np.uint32)
    for c in range(0x2000 if fold else 0):
        lower = chr(c).lower()
        if len(lower) == 1:
            table[c] = ord(lower)
    table[0x30:0x3A] = 0x30
    for space in (0x9, 0xA, 0xB, 0xC, 0xD, 0xA0, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000):
        table[space] = EDGE
    table[0x3400:0xA000] = 0x4E00
    table[0xAC00:0xD7A4] = 0xAC00
    table[0x20000:0x30000] = 0x4E00
    return table


CLASSES = _classes()
CASED = _classes(fold=False)


def codes(text: str, classes: np.ndarray = CLASSES) -> np.ndarray:
    """The classes of a text's characters, with an edge before and after."""
    points = np.frombuffer(f" {text} ".encode("utf-32-le", "replace"), dtype=np.uint32)
    return classes[np.minimum(points, 0x2FFFF)]


def buckets(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each pair and of its first letter."""
    x, y = a.astype(np.uint64), b.astype(np.uint64)
    pair = (x * MIX_A + y * MIX_B + (x ^ y)) * MIX_A
    return (pair >> np.uint64(64 - PAIR_BITS)).astype(np.int64), ((x * MIX_A) >> np.uint64(64 - LETTER_BITS)).astype(np.int64)


def count_pairs(cells: DataFrame, column: str) -> DataFrame:
    """Bigram counts of a text column: bucket (letters after the pairs), n. Nulls count nothing."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(PAIRS + LETTERS, dtype=np.int64)
        for batch in batches:
            values = [v for v in batch[column] if v]
            for start in range(0, len(values), 20_000):
                c = codes("  ".join(values[start : start + 20_000]))
                keep = ~((c[:-1] == EDGE) & (c[1:] == EDGE))
                pair, letter = buckets(c[:-1][keep], c[1:][keep])
                total[:PAIRS] += np.bincount(pair, minlength=PAIRS)
                total[PAIRS:] += np.bincount(letter, minlength=LETTERS)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": at.astype(np.int32), "n": total[at]})

    return cells.select(column).mapInPandas(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def attested_pairs(cells: DataFrame, source: str, column: str, n: str) -> DataFrame:
    """Bigram counts, capitals apart, of what more than one source writes: bucket, n.

    Of each bigram the counts of all sources but the one that has most of it: what a single source writes in a way of
    its own counts nothing. Where there is but one source, its counts. cells: distinct texts with their numbers.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str | None, np.ndarray] = {}

        def rows() -> Iterator[pd.DataFrame]:
            for name, total in totals.items():
                at = np.flatnonzero(total)
                yield pd.DataFrame({"source": [name] * len(at), "bucket": at.astype(np.int32), "n": total[at]})

        for batch in batches:
            for name, text, weight in zip(batch[source], batch[column], batch[n]):
                if name not in totals and len(totals) >= 64:  # a task may meet any number of sources
                    yield from rows()
                    totals.clear()
                total = totals.setdefault(name, np.zeros(PAIRS + LETTERS, dtype=np.int64))
                c = codes(text, CASED)
                pair, letter = buckets(c[:-1], c[1:])
                np.add.at(total, pair, weight)
                np.add.at(total, PAIRS + letter, weight)
        yield from rows()

    own = cells.select(source, column, n).mapInPandas(run, "source string, bucket int, n bigint").groupBy("source", "bucket").agg(F.sum("n").alias("n"))
    several = F.lit(bool(cells.select(source).distinct().limit(2).count() > 1))
    return own.groupBy("bucket").agg((F.sum("n") - F.when(several, F.max("n")).otherwise(0)).cast("bigint").alias("n")).where("n > 0")


class BigramModel:
    """Log probabilities of letter bigrams."""

    def __init__(self, counts: np.ndarray, classes: np.ndarray = CLASSES):
        self.pairs, self.letters, self.classes = counts[:PAIRS].astype(np.float64), counts[PAIRS:].astype(np.float64), classes

    @classmethod
    def of_rows(cls, rows: list, classes: np.ndarray = CLASSES) -> BigramModel:
        """The model of collected rows (bucket, n), of which there are at most PAIRS + LETTERS."""
        counts = np.zeros(PAIRS + LETTERS, dtype=np.int64)
        for row in rows:
            counts[row["bucket"]] = row["n"]
        return cls(counts, classes)

    @classmethod
    def train(cls, cells: DataFrame, column: str) -> BigramModel:
        """The model of a text column. At most PAIRS + LETTERS small rows reach the driver, at any size of the data."""
        return cls.of_rows(count_pairs(cells, column).collect())

    @classmethod
    def of_texts(cls, texts: list[str]) -> BigramModel:
        """The model of texts at hand."""
        counts = np.zeros(PAIRS + LETTERS, dtype=np.int64)
        c = codes("  ".join(t for t in texts if t))
        keep = ~((c[:-1] == EDGE) & (c[1:] == EDGE))
        pair, letter = buckets(c[:-1][keep], c[1:][keep])
        counts[:PAIRS] += np.bincount(pair, minlength=PAIRS)
        counts[PAIRS:] += np.bincount(letter, minlength=LETTERS)
        return cls(counts)

    def without(self, counts: dict[int, float]) -> BigramModel:
        """The model less some counts, by bucket."""
        left = np.concatenate([self.pairs, self.letters])
        at = np.fromiter(counts, dtype=np.int64, count=len(counts))
        left[at] = np.maximum(left[at] - np.fromiter(counts.values(), dtype=np.float64, count=len(counts)), 0.0)
        return BigramModel(left, self.classes)

    def log_pairs(self, c: np.ndarray) -> np.ndarray:
        """The log probability of each step of a sequence of classes."""
        pair, letter = buckets(c[:-1], c[1:])
        return np.log((self.pairs[pair] + SMOOTHING) / (self.letters[letter] + SMOOTHING * ALPHABET))

    def score(self, text: str) -> float:
        """The log probability of a text."""
        return float(self.log_pairs(codes(text, self.classes)).sum())

    def step(self, a: str, b: str) -> float:
        """The log probability that one character follows another."""
        return float(self.log_pairs(self.classes[np.minimum(np.array([ord(a), ord(b)], dtype=np.uint32), 0x2FFFF)])[0])

    def count_of(self, letter: str) -> float:
        """How often a character begins a bigram."""
        c = self.classes[np.minimum(np.array([ord(letter)], dtype=np.uint32), 0x2FFFF)]
        return float(self.letters[buckets(c, c)[1]][0])

    def pair_counts(self, points: np.ndarray) -> np.ndarray:
        """How often each of the characters is followed by each."""
        c = self.classes[np.minimum(points, 0x2FFFF)]
        a, b = np.repeat(c, len(c)), np.tile(c, len(c))
        return self.pairs[buckets(a, b)[0]].reshape(len(c), len(c))
