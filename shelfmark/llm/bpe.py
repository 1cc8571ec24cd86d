"""Encoding of a corpus with a public byte-level BPE vocabulary, by traversal of a trie of its distinct words.

The encoding of a prefix ends in one certain token, and what comes before that token is the encoding of a shorter
prefix. So each node of a trie of words needs no more than its last token and the ancestor at which that token begins;
both follow from the states of the ancestors, and prefixes that words share are worked out once. The last token is the
one token that ends here and stands its ground against the last token of the ancestor before it: when both are spelled
out and merged in the order of rank, no merge may cross the boundary between them.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed value: the pattern by which this vocabulary cuts a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FOREVER = 1 << 60
#: A word of more bytes is encoded by a rolling window of last-token states; as nodes of a trie it would fill the memory.
LONG_WORD = 1024
#: How many pairs of tokens are remembered as standing side by side or not.
MOST_PAIRS = 1_000_000
#: A vocabulary file larger than this is refused: it is sent to every worker.
MAX_VOCABULARY_BYTES = 16 << 20


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """The place of an installed vocabulary file."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to ids, from lines of base64 and rank."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class TrieEncoder:
    """Encodes words by ids of a vocabulary in which a token's id is its rank of merging.

    The trie grows with the words seen and is emptied when it has more than `max_nodes` nodes after a call; that bounds
    the memory and changes no result. Words of more than LONG_WORD bytes, which share no prefix worth keeping, pass
    through a window of states of fixed length.
    """

    def __init__(self, ranks: dict[bytes, int], max_nodes: int = 1_000_000):
        self.ranks, self.max_nodes = ranks, max_nodes
        self.text_of = {i: token for token, i in ranks.items()}
        #: every ending of every token: how far back it is worth looking
        self.tails = {token[i:] for token in ranks for i in range(len(token))}
        self.longest = max(map(len, ranks), default=1)
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.stands: dict[tuple[int, int], bool] = {}
        self._clear()

    def _clear(self) -> None:
        self.children: list[dict[int, int]] = [{}]
        self.last: list[int] = [-1]
        self.back: list[int] = [0]
        self.words: dict[str, list[int]] = {}

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one, None for a single byte."""
        if token not in self.halves:
            text = self.text_of[token]
            parts = [text[i : i + 1] for i in range(len(text))]
            while len(parts) > 2:
                best, at = FOREVER, -1
                for i in range(len(parts) - 1):
                    rank = self.ranks.get(parts[i] + parts[i + 1], FOREVER)
                    if rank < best:
                        best, at = rank, i
                if best >= token:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens that stand at one edge of `token` while it is being merged, each with the rank that ends it."""
        out, until = [], FOREVER
        while True:
            out.append((token, until))
            halves = self._split(token)
            if halves is None:
                return out
            token, until = halves[side], token

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of both tokens' text is just these two tokens."""
        pair = (left, right)
        if pair not in self.stands:
            self.stands[pair] = all(
                # at equal rank the merge further left comes first
                not (rank < until_x and rank <= until_y)
                for x, until_x in self._edge(left, 1)
                for y, until_y in self._edge(right, 0)
                if (rank := self.ranks.get(self.text_of[x] + self.text_of[y], FOREVER)) < FOREVER
            )
        return self.stands[pair]

    def _insert(self, words: Iterable[bytes]) -> list[tuple[int, bytes]]:
        """Put words into the trie; the node where each ends."""
        children, ends = self.children, []
        for word in words:
            node = 0
            for byte in word:
                after = children[node].get(byte)
                if after is None:
                    after = len(children)
                    children[node][byte] = after
                    children.append({})
                    self.last.append(-1)
                    self.back.append(0)
                node = after
            ends.append((node, word))
        return ends

    def _propagate(self, word: bytes) -> None:
        """Give every node on a word's path, from the root down, its last token and the node before that token."""
        path, node = [0], 0
        for depth, byte in enumerate(word, 1):
            node = self.children[node][byte]
            path.append(node)
            if self.last[node] >= 0:
                continue
            for length in range(self._reach(word, depth), 0, -1):
                token = self.ranks.get(word[depth - length : depth])
                if token is not None and (length == depth or self._compatible(self.last[path[depth - length]], token)):
                    self.last[node], self.back[node] = token, path[depth - length]
                    break

    def _reach(self, word: bytes, end: int) -> int:
        """How far back from `end` a token can begin."""
        reach = 1
        while reach < end and word[end - reach - 1 : end] in self.tails:
            reach += 1
        return reach

    def _encode_long(self, word: bytes, step: int = 1 << 16) -> array:
        """The ids of a long word. States are kept for the bytes since the last cut alone.

        Every `step` bytes the chains of last tokens from all positions that can still matter are followed back to
        where they meet; what lies before is settled.
        """
        out, base = array("i"), 0
        last, size = array("i", [-1]), array("i", [0])

        def settle(upto: int) -> None:
            nonlocal base, last, size
            ids, at = [], upto
            while at > base:
                ids.append(last[at - base])
                at -= size[at - base]
            out.extend(reversed(ids))
            last, size = last[upto - base :], size[upto - base :]
            base = upto

        for end in range(1, len(word) + 1):
            for length in range(self._reach(word, end), 0, -1):
                token = self.ranks.get(word[end - length : end])
                if token is not None and (length == end or self._compatible(last[end - length - base], token)):
                    last.append(token)
                    size.append(length)
                    break
            if end % step == 0 and end < len(word):
                fronts = set(range(max(base, end - self.longest), end + 1))
                while len(fronts) > 1 or max(fronts) > end - self.longest:
                    furthest = max(fronts)
                    if furthest <= base:
                        break
                    fronts.discard(furthest)
                    fronts.add(furthest - size[furthest - base])
                settle(max(fronts))
                if len(self.stands) > MOST_PAIRS:
                    self.stands.clear()
        settle(len(word))
        return out

    def _ids(self, node: int) -> list[int]:
        out = []
        while node:
            out.append(self.last[node])
            node = self.back[node]
        return out[::-1]

    def encode_words(self, words: set[str]) -> dict[str, list[int]]:
        """The ids of each word of usual length. Sorting makes the walk over the trie depth-first."""
        new = sorted(w.encode("utf-8", "replace") for w in words - self.words.keys())
        ends = self._insert(new)
        for _, word in ends:
            self._propagate(word)
        for node, word in ends:
            self.words[word.decode("utf-8")] = self._ids(node)
        return self.words

    def encode_texts(self, texts: list[str | None], pattern) -> list[list[list[int] | array]]:
        """The ids of each text, as the lists of its words."""
        cut = [pattern.findall(t) if t else [] for t in texts]
        distinct = {w for words in cut for w in words}
        long = {w for w in distinct if len(w) > LONG_WORD // 4 and len(w.encode("utf-8", "replace")) > LONG_WORD}
        table = self.encode_words(distinct - long)
        if long:
            table = table | {w: self._encode_long(w.encode("utf-8", "replace")) for w in long}
        out = [[table[w] for w in words] for words in cut]
        if len(self.children) > self.max_nodes:
            self._clear()
        if len(self.stands) > MOST_PAIRS:
            self.stands.clear()
        return out


_ENCODERS: dict[int, TrieEncoder] = {}


def encode_column(df: DataFrame, id_column: str, text_column: str, vocabulary: str | None = None, chunk: int = 512) -> DataFrame:
    """One row per row of `df`: the id column and ids, the array<bigint> of the text's token ids.

    Without special tokens: their spellings in a text are ordinary text. A null text and an empty one both give the
    empty array, white space is encoded as any text, a repeated row gives a repeated row. Whole texts are encoded,
    `chunk` of them at a time. No shuffle: each task encodes its rows, knowing the vocabulary (at most 16 MB; a larger
    file raises ValueError) and the words it has met.
    """
    with open(vocabulary or vocabulary_path(), "rb") as file:
        data = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(data) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"a vocabulary of more than {MAX_VOCABULARY_BYTES} bytes")
    shared = df.sparkSession.sparkContext.broadcast(data)
    out_type = pa.schema([(id_column, pa.int64()), ("ids", pa.list_(pa.int64()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import itertools

        import numpy as np
        import regex

        pattern = regex.compile(PATTERN)
        key = hash(shared.value)
        encoder = _ENCODERS.get(key)
        if encoder is None:
            encoder = _ENCODERS[key] = TrieEncoder(read_ranks(shared.value))
        for whole in batches:
            for start in range(0, whole.num_rows, chunk):
                batch = whole.slice(start, chunk)
                lists = encoder.encode_texts(batch.column(1).to_pylist(), pattern)
                flat = [np.fromiter(itertools.chain.from_iterable(words), dtype=np.int64) for words in lists]
                offsets = np.zeros(len(flat) + 1, dtype=np.int32)
                np.cumsum([len(x) for x in flat], out=offsets[1:])
                values = np.concatenate(flat) if flat else np.zeros(0, dtype=np.int64)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], schema=out_type)

    rows = df.select(df[id_column].cast("bigint").alias(id_column), df[text_column].cast("string").alias("_text"))
    return rows.mapInArrow(encode, f"`{id_column}` bigint, ids array<bigint>")
