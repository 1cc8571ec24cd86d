"""Evaluation texts leaking into training text, found by q-gram lemma filtering.

Texts are reduced to their words. A passage of a test item that a document holds with at most e edits keeps at least
L - q + 1 - q*e of its q-grams, all of them within a narrow band of diagonals (position in the document less position in
the item). So the shared q-grams of a document are counted in overlapping diagonal bands, the regions that reach the
bound are kept, and each is verified by an alignment that stays within e diagonals. An exact check of the words follows
where passages must be verbatim. The index of the items is sent to every task if it is small, and otherwise block by
block, one at a time: a stated query set against all documents.
"""

from __future__ import annotations

import bisect
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import word_string
from shelfmark.session import checkpoint, scratch_path

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the table that tells at once that a q-gram is in no item.
SIEVE_BITS = 22
SEGMENT_BYTES = 4 << 20
#: Shared q-grams that are held at once; texts with more are looked at in halves.
MOST_HITS = 8_000_000


def qgram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """The hash of every run of q bytes."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(q):
        out *= MULTIPLIER
        out += data[j : j + n]
    out ^= out >> np.uint64(29)
    return out * MULTIPLIER


def reaches(a: bytes, b: bytes, i: int, j: int, step: int, edits: int) -> list[int]:
    """How much of `b` from j on, in the direction of `step`, aligns with `a` from i on within 0, 1, ... `edits` edits.

    Furthest-reaching alignment on the diagonals within `edits` of the first.
    """
    end_a, end_b = (len(a) - i, len(b) - j) if step > 0 else (i, j)
    offset = 0 if step > 0 else -1

    def slide(shift: int, covered: int) -> int:
        while covered < end_b and 0 <= covered + shift < end_a and a[i + step * (covered + shift) + offset] == b[j + step * covered + offset]:
            covered += 1
        return covered

    front = {0: slide(0, 0)}
    out = [front[0]]
    for _ in range(edits):
        after: dict[int, int] = {}
        for shift, covered in front.items():
            for to, more in ((shift, 1), (shift + 1, 0), (shift - 1, 1)):  # replaced, only in a, only in b
                if abs(to) <= edits and covered + more <= end_b and 0 <= covered + more + to <= end_a:
                    after[to] = max(after.get(to, 0), covered + more)
        front = {s: max(slide(s, c), front.get(s, 0)) for s, c in after.items()} or front
        out.append(max(out[-1], *front.values()))
    return out


@dataclass
class Item:
    id: int
    text: bytes
    starts: array
    ends: array
    least: int

    def passages(self) -> Iterator[bytes]:
        """Every passage of the item, made when it is asked for."""
        return (self.text[s:e] for s, e in zip(self.starts, self.ends))


class LeakIndex:
    """An inverted index of the q-grams of test items, with the bound that each item's passages must reach."""

    def __init__(self, items: list[tuple[int, str]], words: int = 12, edits: int = 1):
        self.words, self.edits, self.items = words, edits, []
        for item_id, text in items:
            data = text.encode()
            parts, at, spans = data.split(b" ") if data else [], 0, []
            for part in parts:
                spans.append((at, at + len(part)))
                at += len(part) + 1
            if len(spans) < words:
                continue
            starts = array("q", (spans[k][0] for k in range(len(spans) - words + 1)))
            ends = array("q", (spans[k + words - 1][1] for k in range(len(spans) - words + 1)))
            self.items.append(Item(item_id, data, starts, ends, min(e - s for s, e in zip(starts, ends))))
        shortest = min((i.least for i in self.items), default=0)
        self.q = max(1, min(16, (shortest + 1) // (edits + 2)))
        keys, owner, place = [], [], []
        for k, item in enumerate(self.items):
            h = qgram_hashes(np.frombuffer(item.text, dtype=np.uint8), self.q)
            keys.append(h)
            owner.append(np.full(len(h), k, dtype=np.int32))
            place.append(np.arange(len(h), dtype=np.int32))
        key = np.concatenate(keys) if keys else np.zeros(0, dtype=np.uint64)
        order = np.argsort(key, kind="stable")
        self.owner = (np.concatenate(owner) if owner else np.zeros(0, dtype=np.int32))[order]
        self.place = (np.concatenate(place) if place else np.zeros(0, dtype=np.int32))[order]
        self.unique, self.first, self.count = np.unique(key[order], return_index=True, return_counts=True)
        self.sieve = np.zeros(1 << SIEVE_BITS, dtype=bool)
        self.sieve[self.unique >> np.uint64(64 - SIEVE_BITS)] = True
        self.length = np.array([i.least for i in self.items], dtype=np.int64)
        self.bound = self.length - self.q + 1 - self.q * edits

    def _hits(self, texts: list[bytes]) -> tuple[np.ndarray, ...] | None:
        """Document, position, item, position in the item of every shared q-gram; None if that is too many at once."""
        out: list[tuple[np.ndarray, ...]] = []
        joined, starts, at = b"\xff".join(texts), [], 0
        for text in texts:
            starts.append(at)
            at += len(text) + 1
        begin = np.array(starts, dtype=np.int64)
        data = np.frombuffer(joined, dtype=np.uint8)
        total = 0
        for cut in range(0, max(1, len(data)), SEGMENT_BYTES):
            h = qgram_hashes(data[cut : cut + SEGMENT_BYTES + self.q - 1], self.q)
            near = np.flatnonzero(self.sieve[h >> np.uint64(64 - SIEVE_BITS)])
            slot = np.searchsorted(self.unique, h[near])
            slot[slot == len(self.unique)] = 0
            same = self.unique[slot] == h[near]
            near, slot = near[same], slot[same]
            n = self.count[slot]
            total += int(n.sum())
            if total > MOST_HITS and len(texts) > 1:
                return None
            posting = np.repeat(self.first[slot] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.zeros(0, dtype=np.int64)
            where = np.repeat(near + cut, n)
            doc = np.searchsorted(begin, where, side="right") - 1
            out.append((doc, where - begin[doc] if len(where) else where, self.owner[posting].astype(np.int64), self.place[posting].astype(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*out))

    def regions(self, texts: list[bytes]) -> Iterator[tuple[int, int, int, int]]:
        """The regions that reach the bound: document, item, position, position in the item of a q-gram within."""
        if not self.items or not any(texts):
            return
        hits = self._hits(texts)
        if hits is None:
            half = len(texts) // 2
            yield from self.regions(texts[:half])
            yield from ((doc + half, *rest) for doc, *rest in self.regions(texts[half:]))
            return
        doc, pos, item, place = hits
        width = max(1, 2 * self.edits)
        seen: set[tuple[int, int, int, int]] = set()
        for shift in (0, self.edits) if self.edits else (0,):
            band = (pos - place + shift) // width
            order = np.lexsort((pos, band, item, doc))
            d, i, b, p, t = doc[order], item[order], band[order], pos[order], place[order]
            fresh = np.ones(len(d), dtype=bool)
            fresh[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1]) | (b[1:] != b[:-1])
            group = np.cumsum(fresh) - 1
            last = np.arange(len(d)) + self.bound[i] - 1
            ok = last < len(d)
            last = np.where(ok, last, 0)
            ok &= (group[last] == group) & (p[last] - p <= self.length[i] - self.q + self.edits)
            at = np.flatnonzero(ok)
            # q-grams that follow each other on one diagonal are one exact run: its first stands for all of them
            diagonal = p - t
            at = at[np.lexsort((p[at], diagonal[at], group[at]))]
            run = np.ones(len(at), dtype=bool)
            run[1:] = (group[at[1:]] != group[at[:-1]]) | (diagonal[at[1:]] != diagonal[at[:-1]]) | (p[at[1:]] - p[at[:-1]] > 1)
            for k in at[run]:
                found = (int(d[k]), int(i[k]), int(p[k]), int(t[k]))
                if found not in seen:
                    seen.add(found)
                    yield found

    def verify(self, text: bytes, item: Item, pos: int, place: int) -> bool:
        """Whether an alignment through this q-gram covers a passage of the item within the edit budget."""
        left = reaches(text, item.text, pos, place, -1, self.edits)
        right = reaches(text, item.text, pos, place, 1, self.edits)
        for k in range(self.edits + 1):
            low, high = place - left[k], place + right[self.edits - k]
            w = bisect.bisect_left(item.starts, low)
            if w < len(item.starts) and item.ends[w] <= high:
                return True
        return False

    def leaks(self, texts: list[bytes], verbatim: bool) -> list[tuple[int, int]]:
        """Pairs of text number and item id, each once."""
        out: set[tuple[int, int]] = set()
        for doc, k, pos, place in self.regions(texts):
            item = self.items[k]
            if (doc, item.id) in out or not self.verify(texts[doc], item, pos, place):
                continue
            if verbatim:
                padded = b" " + texts[doc] + b" "
                if not any(b" " + w + b" " in padded for w in item.passages()):
                    continue
            out.add((doc, item.id))
        return sorted(out)


def find_leaks(
    documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, words: int = 12, edits: int = 1, verbatim: bool = True, block_bytes: int = 8 << 20
) -> DataFrame:
    """The pairs (doc_id, item_id), each once, of documents that hold a passage of `words` words of an item.

    edits: how many characters may differ within the passage to be kept as a region; with `verbatim` the words must
    then be equal one by one. Null and empty texts hold nothing, items of fewer words than a passage have none, null ids
    are dropped, ids that occur twice are one. Documents are never shuffled, only the pairs found are. Items are indexed
    in blocks of about `block_bytes` of text (more only for a single item that is itself longer), one pass over the
    documents for each block. With several blocks their pairs are written one block after the other, and no more than
    one block is ever in the driver or with the workers.
    """
    spark = documents.sparkSession
    plain = items.select(F.col(item_id).cast("bigint").alias("id"), word_string(F.col(item_text)).alias("t")).where("id is not null and t <> ''").distinct()
    total = plain.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    docs = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), word_string(F.col(text)).alias("t")).where("doc_id is not null and t <> ''")
    if blocks == 1:
        index = spark.sparkContext.broadcast(LeakIndex([(r["id"], r["t"]) for r in plain.toLocalIterator()], words, edits))
        return docs.mapInArrow(_finder(index, verbatim), PAIRS).distinct()
    # the items apart by block, so that each block is read alone
    place = scratch_path(spark, "items")
    plain.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).repartition("block").write.partitionBy("block").parquet(place)
    apart = spark.read.schema("id bigint, t string, block int").parquet(place)
    found = spark.createDataFrame([], PAIRS)
    for block in range(blocks):
        part = apart.where(F.col("block") == block).select("id", "t")
        index = spark.sparkContext.broadcast(LeakIndex([(r["id"], r["t"]) for r in part.toLocalIterator()], words, edits))
        found = found.unionByName(checkpoint(docs.mapInArrow(_finder(index, verbatim), PAIRS).distinct()))
        index.destroy()
    return found.distinct()


PAIRS = "doc_id bigint, item_id bigint"


def _finder(index, verbatim: bool):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t.encode() for t in batch.column(1).to_pylist()]
            rows, start = [], 0
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop]) < SEGMENT_BYTES):
                    size += len(texts[stop])
                    stop += 1
                rows += [(ids[start + d], i) for d, i in index.value.leaks(texts[start:stop], verbatim)]
                start = stop
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["doc_id", "item_id"])

    return find
