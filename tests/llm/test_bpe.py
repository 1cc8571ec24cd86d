"""The trie encoder against a plain merge loop, and round trips."""

import random

import pytest

from shelfmark.llm.bpe import PATTERN, TrieEncoder, encode_column, read_ranks, vocabulary_path

regex = pytest.importorskip("regex")


@pytest.fixture(scope="module")
def ranks():
    with open(vocabulary_path(), "rb") as file:
        return read_ranks(file.read())


def merge_loop(word, ranks):
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        best = min(((ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 40, 0))
        if best[0] == 1 << 40:
            return [ranks[p] for p in parts]
        i = best[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


def test_words_against_merge_loop(ranks):
    r, encoder = random.Random(4), TrieEncoder(ranks, max_nodes=2000)
    tokens = list(ranks)
    words = {b"".join(r.choice(tokens) for _ in range(r.randint(1, 4))).decode("utf-8", "ignore")[:40] for _ in range(3000)}
    words |= {"a" * n for n in range(1, 60)} | {" " * n for n in range(1, 40)}
    words.discard("")
    table = encoder.encode_words(words)
    for w in words:
        assert table[w] == merge_loop(w.encode(), ranks), w


def test_long_words_in_a_window(ranks):
    r, encoder = random.Random(7), TrieEncoder(ranks)
    tokens = list(ranks)
    words = [b"ab" * 900, b"a" * 1500, bytes(r.choice(b"etaoin shrdlu") for _ in range(1500)), b"".join(r.choice(tokens) for _ in range(250))]
    for word in words:
        assert list(encoder._encode_long(word, step=200)) == merge_loop(word, ranks)
    decode = {i: t for t, i in ranks.items()}
    long = "schiff" * 20_000
    ids = [i for w in encoder.encode_texts([long], regex.compile(PATTERN))[0] for i in w]
    assert b"".join(decode[i] for i in ids).decode() == long
    assert len(encoder.children) < 10_000  # not in the trie


def test_texts(ranks):
    pattern, encoder = regex.compile(PATTERN), TrieEncoder(ranks)
    texts = ["Hello  world's\n\n end ", "", None, "<|endoftext|>", "東京 é 🎸", "x" * 20_000]
    decode = {i: t for t, i in ranks.items()}
    for text, words in zip(texts, encoder.encode_texts(texts, pattern)):
        ids = [i for w in words for i in w]
        assert b"".join(decode[i] for i in ids).decode() == (text or "")
        assert ids == [i for w in pattern.findall(text or "") for i in merge_loop(w.encode(), ranks)] if len(text or "") < 1000 else ids


def test_column(spark, ranks):
    rows = [(1, "the end", 0), (2, None, 1), (3, "", 2), (1, "the end", 3), (None, " ", 4)]
    df = spark.createDataFrame(rows, "doc bigint, ids string, _text int")
    out = encode_column(df, "doc", "ids")
    got = sorted(((r["doc"], r["ids"]) for r in out.collect()), key=repr)
    the_end = [ranks[b"the"], ranks[b" end"]]
    assert got == sorted([(1, the_end), (2, []), (3, []), (1, the_end), (None, [ranks[b" "]])], key=repr)
    assert encode_column(df.limit(0), "doc", "ids").count() == 0


def test_public_tokenizer_agrees(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    reference = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    r, pattern, encoder = random.Random(1), regex.compile(PATTERN), TrieEncoder(ranks)
    bits = ["a", " ", "  ", "the", "ing", "é", "ß", "東", "\n", "0", "12", "🎸", "\t", "'s", "=", "--", "​", "Zürich"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(1, 30))) for _ in range(2000)]
    for text, words in zip(texts, encoder.encode_texts(texts, pattern)):
        assert [i for w in words for i in w] == reference.encode_ordinary(text)
