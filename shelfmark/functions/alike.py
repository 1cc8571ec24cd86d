"""Pairs of short texts of a high ratio of matching blocks, found block by block in arrays; no pair is lost.

The ratio of a pair is 2 M / T: M signs in matching blocks, T signs in both texts. M is at most the length of the longest
common subsequence, and that at most the number of signs that both texts have. The second bound is a product of matrices,
the first one runs bit-parallel over those pairs that are left, and only what passes both is compared in full.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

#: Rows of one product, pairs that wait for the next bounds, pairs of one bit-parallel run, pairs compared at once, classes of
#: signs, features of a text. Other values give the same pairs.
ROWS, WAITING, RUN, PAIRS, CLASSES, FEATURES = 256, 1 << 17, 1 << 15, 1 << 12, 64, 78
#: Texts beyond this length have no place in a word of bits; their pairs are taken one by one.
WORD = 64


def sign_classes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The class and code of each sign of all texts, the text it belongs to, and its place there. Frequent signs have their own
    class; others share one, which can only raise the bounds."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    counts = np.bincount(codes, minlength=1)
    order = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    classes = np.zeros(len(counts), np.uint8)
    classes[order] = np.arange(len(order)) % CLASSES
    owner = np.repeat(np.arange(len(texts)), lengths)
    return classes[codes], codes, owner, np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def shared_signs(signs: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Features whose products count what two texts share: (n, FEATURES) zeros and ones, and how many each text has beyond.

    A feature is a class and a number, held by a text with at least so many signs of the class. The most frequent ones
    are columns; of the others two texts share at most the lesser of their numbers, and so at most the mean.
    """
    order = np.lexsort((signs, owner))
    key = owner[order] * CLASSES + signs[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    nth = np.arange(len(key)) - np.repeat(starts, np.diff(np.r_[starts, len(key)]))
    feature = nth * CLASSES + signs[order]
    held = np.bincount(feature, minlength=1)
    best = np.argsort(-held, kind="stable")[:FEATURES]
    column = np.full(len(held), -1)
    column[best] = np.arange(len(best))
    column, text = column[feature], owner[order]
    matrix = np.zeros((n, FEATURES), np.float32)
    matrix[text[column >= 0], column[column >= 0]] = 1
    return matrix, np.bincount(text[column < 0], minlength=n)


def common_subsequence(a: str, b: str) -> int:
    """The length of the longest common subsequence, a bit for each sign of `a`."""
    masks, full = {}, (1 << len(a)) - 1
    for place, sign in enumerate(a):
        masks[sign] = masks.get(sign, 0) | 1 << place
    v = full
    for sign in b:
        u = v & masks.get(sign, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


class Texts:
    """Texts with their lengths, features, and for the short ones padded signs, as classes and as codes, and masks of the
    places of each class."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.n = np.fromiter(map(len, texts), np.int64, len(texts))
        signs, codes, owner, place = sign_classes(texts)
        self.features, self.beyond = shared_signs(signs, owner, len(texts))
        short = place < WORD
        signs, codes, owner, place = signs[short], codes[short], owner[short], place[short]
        shape = len(texts), int(min(self.n.max(initial=0), WORD))
        self.padded, self.codes = np.full(shape, CLASSES, np.uint8), np.full(shape, -1, np.int32)
        self.padded[owner, place], self.codes[owner, place] = signs, codes
        self.masks = np.zeros((len(texts), CLASSES + 1), np.uint64)
        np.bitwise_or.at(self.masks, (owner, signs), np.uint64(1) << place.astype(np.uint64))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The most signs that matching blocks of the pairs (a, b) can hold: the longest common subsequence, of short texts
        that of the classes."""
        out, short = np.zeros(len(a), np.int64), np.maximum(self.n[a], self.n[b]) <= WORD
        for k in np.flatnonzero(~short):
            out[k] = common_subsequence(self.texts[a[k]], self.texts[b[k]])
        for run in np.array_split(np.flatnonzero(short), len(a) // RUN + 1):
            x, y = a[run], b[run]
            v = np.full(len(run), ~np.uint64(0))
            for place in range(int(self.n[y].max(initial=0))):
                mask = self.masks[x, self.padded[y, place]]
                u = v & mask
                v = (v + u) | (v - u)
            out[run] = np.bitwise_count(~v)
        return out


def candidates(t: Texts, unit: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float):
    """Yield arrays (i, j) of the pairs of a left and a right text of one unit whose shared signs allow the ratio.

    Texts that are both are paired with what follows them by length only. `unit` and then the length must not decrease.
    """
    n, both = t.n, left & right
    wide = int(n.max(initial=0)) + 2
    rows, columns = np.flatnonzero(left), np.flatnonzero(right)
    at = unit[columns] * wide + n[columns]
    # the lesser length of a pair is at least threshold / (2 - threshold) of the greater
    least, most = np.ceil(n * threshold / (2 - threshold) - 1e-6), np.minimum(np.floor(n * (2 - threshold) / max(threshold, 1e-9) + 1e-6), wide - 1)
    low = np.searchsorted(at, unit[rows] * wide + np.where(both, n, least)[rows], "left")
    high = np.searchsorted(at, unit[rows] * wide + most[rows], "right")
    # the product is what is shared, less what the ratio asks for
    off = (t.beyond / 2 - threshold * n / 2).astype(np.float32)[:, None]
    one = np.ones_like(off)
    a, b = np.hstack([t.features[rows], off[rows], one[rows]]), np.hstack([t.features[columns], one[columns], off[columns]]).T
    for k in range(0, len(rows), ROWS):
        first, last = low[k : k + ROWS].min(), high[k : k + ROWS].max()
        if first >= last:
            continue
        block = a[k : k + ROWS] @ b[:, first:last]
        hits = np.flatnonzero(block.ravel() >= -1e-2)
        i, j = rows[k + hits // (last - first)], columns[first + hits % (last - first)]
        good = (unit[i] == unit[j]) & (~both[i] | (i < j)) & (2.0 * np.minimum(n[i], n[j]) >= threshold * (n[i] + n[j]) - 1e-6)
        yield i[good], j[good]


def window(signs: np.ndarray, row: np.ndarray, low: np.ndarray, high: np.ndarray, none: int) -> np.ndarray:
    """The signs from `low` to `high` of each row, padded by `none`."""
    at = low[:, None] + np.arange((high - low).max())
    return np.where(at < high[:, None], signs[row[:, None], np.minimum(at, signs.shape[1] - 1)], none)


def matched(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many signs are in the matching blocks of each pair of rows of `a` and `b`, which are padded by -1.

    As `SequenceMatcher` has them: the longest block, of several the one that ends first in `a`, then in `b`; and so on to
    the left and right of it. All pairs take each step together.
    """
    total = np.zeros(len(a), np.int64)
    pair, alo, ahi, blo, bhi = np.arange(len(a)), np.zeros(len(a), np.int64), (a >= 0).sum(axis=1), np.zeros(len(a), np.int64), (b >= 0).sum(axis=1)
    while len(pair):
        x, y = window(a, pair, alo, ahi, -1), window(b, pair, blo, bhi, -2)
        run, (size, enda, endb) = np.zeros((len(pair), y.shape[1] + 1), np.uint8), np.zeros((3, len(pair)), np.int64)
        for i in range(x.shape[1]):
            run[:, 1:] = (run[:, :-1] + 1) * (x[:, i, None] == y)
            first = run.argmax(axis=1)
            longest = run[np.arange(len(pair)), first]
            better = longest > size
            size[better], enda[better], endb[better] = longest[better], i + 1, first[better]
        np.add.at(total, pair, size)
        enda, endb = alo + enda, blo + endb
        more = [(size > 0) & (alo < enda - size) & (blo < endb - size), (size > 0) & (enda < ahi) & (endb < bhi)]
        pair, alo, ahi, blo, bhi = (np.concatenate([v[m] for v, m in zip(sides, more)]) for sides in ((pair, pair), (alo, enda), (enda - size, ahi), (blo, endb), (endb - size, bhi)))
    return total


def ratios(t: Texts, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The ratio of matching blocks of each pair (a, b), in this order."""
    out, total = np.zeros(len(a)), t.n[a] + t.n[b]
    short = np.maximum(t.n[a], t.n[b]) <= WORD
    for part in np.array_split(np.flatnonzero(short), len(a) // PAIRS + 1):
        out[part] = 2.0 * matched(t.codes[a[part]], t.codes[b[part]]) / total[part]
    for k in np.flatnonzero(~short):
        out[k] = SequenceMatcher(None, t.texts[a[k]], t.texts[b[k]]).ratio()
    return out


def alike(texts: list[str], unit: np.ndarray, left: np.ndarray, right: np.ndarray, ids: list, threshold: float):
    """Yield lists of (id, id, ratio) of the pairs of `candidates` with at least that ratio, the smaller id and its text first."""
    t, met, waiting = Texts(texts), [], 0
    rank = np.empty(len(ids), np.int64)
    rank[sorted(range(len(ids)), key=ids.__getitem__)] = np.arange(len(ids))

    def found():
        i, j = (np.concatenate(v) for v in zip(*met))
        good = 2.0 * t.common(i, j) >= threshold * (t.n[i] + t.n[j]) - 1e-6
        i, j = i[good], j[good]
        a, b = np.where(rank[i] < rank[j], i, j), np.where(rank[i] < rank[j], j, i)
        ratio = ratios(t, a, b)
        good = ratio >= threshold
        return [(ids[x], ids[y], r) for x, y, r in zip(a[good].tolist(), b[good].tolist(), ratio[good].tolist()) if ids[x] != ids[y]]

    for pair in candidates(t, unit, left, right, threshold):
        met.append(pair)
        waiting += len(pair[0])
        if waiting >= WAITING:
            yield found()
            met, waiting = [], 0
    if met:
        yield found()
