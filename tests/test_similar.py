"""Similar names against comparing all pairs."""

import random
from difflib import SequenceMatcher

import pytest

from shelfmark.operators.duplicates import similar_albums


@pytest.mark.parametrize("threshold", [0.85, 0.7])
def test_no_pair_is_lost(spark, threshold):
    r = random.Random(3)
    names = set()
    for _ in range(60):
        word = " ".join("".join(r.choice("abcde ") for _ in range(r.randint(1, 18))).split())
        names.add(word)
        for _ in range(3):
            s = list(word)
            for _ in range(r.randint(1, 3)):
                at = r.randrange(len(s) + 1)
                s[at : at + r.randint(0, 1)] = r.choice("abcde")
            names.add(" ".join("".join(s).split()))
    names = sorted(n for n in names if n)
    rows = [(i, "The Artist", n) for i, n in enumerate(names)] + [(1000, None, "x"), (1001, "Other", None), (1002, "Other", "x")]
    got = {(x["id_a"], x["id_b"]): x["ratio"] for x in similar_albums(spark.createDataFrame(rows, "dir_id long, artist string, album string"), threshold).collect()}
    want = {}
    for i, a in enumerate(names):
        for j in range(i + 1, len(names)):
            ratio = SequenceMatcher(None, a, names[j]).ratio()
            if ratio >= threshold:
                want[i, j] = ratio
    assert got == want


def test_loose_and_exact_names(spark):
    rows = [(1, "A", "Song (Live)"), (2, "a", "Song [Demo]"), (3, "B", "Same"), (4, "B", "same"), (5, "B", "Samee")]
    got = [tuple(r) for r in similar_albums(spark.createDataFrame(rows, "dir_id long, artist string, album string")).collect()]
    assert got == [(1, 2, 1.0)]


def test_large_artist_shuffles_names_not_pairs(spark):
    r = random.Random(7)
    names = sorted({"best of " + "".join(r.choice("bdgk") + r.choice("aeio") for _ in range(4)) for _ in range(1200)})
    dirs = spark.createDataFrame([(i, "Various", n) for i, n in enumerate(names)], "dir_id long, artist string, album string")
    context = spark.sparkContext

    def found(group, **settings):
        context.setJobGroup(group, "")
        rows = similar_albums(dirs, **settings).collect()
        store, status = context._jsc.sc().statusStore(), context.statusTracker()
        stages = [s for job in status.getJobIdsForGroup(group) for s in status.getJobInfo(job).stageIds]
        return rows, max(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)

    try:
        rows, written = found("large artist")
        assert written <= len(names) < len(rows)
        # in four parts, each of which meets all four
        parts, written = found("large artist in parts", most=300)
        assert written <= 4 * len(names) and sorted(parts) == sorted(rows)
    finally:
        context.setJobGroup(None, None)
    got = {(x["id_a"], x["id_b"]): x["ratio"] for x in rows}
    near = ((i, j) for j, b in enumerate(names) for i, a in enumerate(names[:j]) if sum(x != y for x, y in zip(a, b)) <= 3)
    assert len(got) == len(rows) and got.items() >= {(i, j): q for i, j in near if (q := SequenceMatcher(None, names[i], names[j]).ratio()) >= 0.85}.items()
    assert all(q == SequenceMatcher(None, names[i], names[j]).ratio() >= 0.85 for (i, j), q in r.sample(sorted(got.items()), 2000))


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh", "".join(map(chr, range(0x4E00, 0x4E00 + 300))), "a😀é "])
@pytest.mark.parametrize("most", [16, 1 << 14])
def test_blocks_of_pairs_against_all_pairs(spark, alphabet, most):
    r = random.Random(11)
    names = {"".join(r.choice(alphabet) for _ in range(r.choice([1, 2, 5, 12, 30, 64, 65, 90, 230]))) for _ in range(50)}
    for n in sorted(names):
        s = list(n)
        s[r.randrange(len(s))] = r.choice(alphabet)
        names.add("".join(s) + r.choice(["", alphabet[0]]))
    names = sorted({" ".join(n.split()) for n in names} - {""}, key=lambda n: r.random())
    rows = [(f"{i:03}", "A", n) for i, n in enumerate(names)] + [(f"x{i:03}", f"B{i}", n) for i, n in enumerate(names)]
    got = {(x["id_a"], x["id_b"]): x["ratio"] for x in similar_albums(spark.createDataFrame(rows, "dir_id string, artist string, album string"), most=most).collect()}
    pairs = {(f"{i:03}", f"{j:03}"): SequenceMatcher(None, a, b).ratio() for j, b in enumerate(names) for i, a in enumerate(names[:j])}
    assert got == {p: q for p, q in pairs.items() if q >= 0.85}
