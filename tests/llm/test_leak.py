"""Leaks against brute force, at several edit budgets."""

import random
import re

import pytest

from shelfmark.llm.leak import LeakIndex, find_leaks, reaches

WORDS = "the a of reel crate every third shelf is kept for tapes made before nobody saw it said was then under over two three numbers ledger keeper".split()


def sentence(r, n):
    return " ".join(r.choice(WORDS) + str(r.randint(0, 99)) * (r.random() < 0.1) for _ in range(n))


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(docs, items, n=12):
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - n + 1):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words(t)
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in windows.get(tuple(w[k : k + n]), ())}
    return out


@pytest.fixture(scope="module")
def material():
    r = random.Random(11)
    items = [(i, sentence(r, r.randint(5, 60))) for i in range(40)]
    docs = []
    for d in range(300):
        text = sentence(r, r.randint(0, 120))
        if d % 3 == 0:
            w = r.choice(items)[1].split()
            at, n = r.randrange(len(w)), r.randint(8, 20)
            part = w[at : at + n]
            if d % 2:
                part[len(part) // 2] += "x"
            text += r.choice([" ", "\n> ", " -- "]) + r.choice([", ", " ", "!! "]).join(part).upper() + " " + sentence(r, 10)
        docs.append((d, text))
    return docs + [(300, None), (301, ""), (302, "..."), (0, docs[0][1])], items


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_verbatim_equals_brute_force(spark, material, edits):
    docs, items = material
    d = spark.createDataFrame(docs, "doc_id bigint, t string")
    i = spark.createDataFrame(items + [(99, None), (98, "too short")], "item_id bigint, t string")
    got = {tuple(x) for x in find_leaks(d, "doc_id", "t", i, "item_id", "t", edits=edits).collect()}
    assert got == brute(docs, items)
    if edits == 1:
        blocks = {tuple(x) for x in find_leaks(d, "doc_id", "t", i, "item_id", "t", edits=1, block_bytes=500).collect()}
        assert blocks == got


def test_edited_passages_are_found_within_the_budget():
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    index = LeakIndex([(1, item)], 12, 1)
    near = b"so " + item.replace("theta", "thxta").encode() + b" end"
    far = b"so " + item.replace("epsilon", "xxxxxx").replace("iota", "yyyyyy").encode() + b" end"
    assert index.leaks([near, far], verbatim=False) == [(0, 1)] and index.leaks([near, far], verbatim=True) == []


def test_reaches():
    assert reaches(b"abcdef", b"abcdef", 0, 0, 1, 1) == [6, 6]
    assert reaches(b"abXdef", b"abcdef", 0, 0, 1, 1) == [2, 6]
    assert reaches(b"abdef", b"abcdef", 0, 0, 1, 1) == [2, 6]
    assert reaches(b"abcXdef", b"abcdef", 0, 0, 1, 1) == [3, 6]
    assert reaches(b"abXdef", b"abcdef", 6, 6, -1, 1) == [3, 6]


def test_no_items_and_long_texts(spark):
    d = spark.createDataFrame([(1, "w " * 300_000)], "doc_id bigint, t string")
    none = spark.createDataFrame([], "item_id bigint, t string")
    assert find_leaks(d, "doc_id", "t", none, "item_id", "t").count() == 0
    i = spark.createDataFrame([(1, "w " * 12), (2, "v " * 12)], "item_id bigint, t string")
    assert [tuple(x) for x in find_leaks(d, "doc_id", "t", i, "item_id", "t").collect()] == [(1, 1)]
