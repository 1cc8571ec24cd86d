"""The ledger: equal to grouping at once however it is fed, and reopened as it was left."""

from collections import defaultdict

from pyspark.sql import functions as F

from shelfmark.llm.ledger import Ledger, ledger_of

FIELDS = ["a", "b", "c"]
ROWS = [
    (5, "The Song", "x", None, 1), (3, "x", "the-SONG!", "", 2), (9, "the song", None, "X", 2), (1, "Thé Song", "x", None, 1), (7, "Thé Song", "x", None, 1), (2, "thé song", "x", "", None),
    (4, None, None, None, 2), (6, "", "  ", "!!", 1), (8, "ΆΝΕΜΟΣ", "1", "2", 1), (10, "άνεμος", "2", "1", 2), (11, "x" * 50_000, "y", "z", 1), (12, "z", "X" * 50_000, "y", 2), (5, "The Song", "x", None, 1),
]
SCHEMA = "id bigint, a string, b string, c string, batch int"


def key(row):
    import unicodedata

    parts = ["".join(ch for ch in unicodedata.normalize("NFC", v or "") if ch.isalnum() or unicodedata.combining(ch)).upper().lower() for v in row[1:4]]
    return tuple(sorted(p.replace("ς", "σ") for p in parts))


def brute(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[key(row)].append(row[0])
    entries = sorted((min(v), len(v)) for v in groups.values())
    copies = sorted({(min(v), i) for v in groups.values() for i in v if i != min(v)})
    return entries, copies


def found(ledger):
    return sorted((r["first_id"], r["n_copies"]) for r in ledger.entries().collect())


def test_batches_give_what_one_pass_gives(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    entries, copies = brute(ROWS)
    for batch, size in ((F.col("batch"), 1_000_000), (F.lit(1), 3), (F.col("id") % 3, 2)):
        ledger, keyed = ledger_of(df, FIELDS, "id", batch, keys_a_bucket=size)
        assert found(ledger) == entries
        assert sorted(map(tuple, ledger.copies_of(keyed).collect())) == copies
        assert sorted(map(tuple, ledger.copies(df, FIELDS, "id").collect())) == copies
        if size < 10:
            assert ledger.buckets > 1


def test_reopened_ledger_goes_on(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    ledger = Ledger(spark)
    assert ledger.update(df.where("batch = 1"), FIELDS, "id", "one")
    again = Ledger.open(spark, ledger.path)
    assert not again.update(df.where("batch = 1"), FIELDS, "id", "one")  # replayed
    assert again.update(df.where("batch is distinct from 1"), FIELDS, "id", "rest")
    assert not again.update(df.where("batch = 1"), FIELDS, "id", "one")
    assert found(Ledger.open(spark, ledger.path)) == brute(ROWS)[0]
    again.clean()
    assert found(Ledger.open(spark, ledger.path)) == brute(ROWS)[0]


def test_a_batch_that_died_can_be_tried_again(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    ledger = Ledger(spark)
    ledger.update(df.where("batch = 1"), FIELDS, "id", "one")
    before = found(ledger)
    # what is left of a job that died while it wrote its data, and of one that died while it wrote its manifest
    df.write.parquet(f"{ledger.path}/data/0123")
    spark.createDataFrame([(99, "x")], "generation int, folder string").write.parquet(f"{ledger.path}/manifest/99-0123")
    from pathlib import Path

    for mark in Path(ledger.path.removeprefix("file:")).glob("manifest/99-0123/*_SUCCESS*"):
        mark.unlink()
    again = Ledger.open(spark, ledger.path)
    assert found(again) == before and again.batches == {"one"}
    again.update(df.where("batch is distinct from 1"), FIELDS, "id", "rest")
    assert found(again) == brute(ROWS)[0]
    again.clean()
    assert found(Ledger.open(spark, ledger.path)) == brute(ROWS)[0]


def test_empty_table_and_empty_batch(spark):
    empty = spark.createDataFrame([], SCHEMA)
    ledger, keyed = ledger_of(empty, FIELDS, "id", F.col("batch"))
    assert ledger.entries().count() == 0 and ledger.copies_of(keyed).count() == 0
    ledger.update(empty, FIELDS, "id")
    assert Ledger.open(spark, ledger.path).entries().count() == 0


def test_one_key_holding_a_third_of_all_rows(spark, monkeypatch):
    import shelfmark.llm.ledger as module

    monkeypatch.setattr(module, "RECORDS_A_TASK", 100)
    df = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 'Hot  Key' else concat('k', id) end as a", "cast(null as string) as b", "'z' as c", "cast(id % 2 as int) as batch")
    ledger, keyed = ledger_of(df, FIELDS, "id", F.col("batch"), keys_a_bucket=500)
    assert ledger.entries().count() == 2001 and ledger.buckets >= 4
    assert ledger.copies_of(keyed).count() == 999


def test_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, "A", "b", 0), (2, "a!", "B", 1)], "key bigint, bucket string, salt string, n_copies int")
    ledger, keyed = ledger_of(df, ["bucket", "salt"], "key", F.col("n_copies"))
    assert [tuple(r) for r in ledger.copies_of(keyed).collect()] == [(1, 2)]
