"""Duplicates hidden by formatting differences: an incremental ledger of canonical keys.

The ledger is a written table, split by bucket of the canonical key: per key the number of records and the earliest
representative. A batch is aggregated by key first (partly before the shuffle, so a key that a third of all records
share costs one row per task), then full-outer-joined with just those buckets of the ledger that it touches; counts add
up and the earlier representative stays. Touched buckets are written anew to a folder of this attempt, and a manifest,
which counts only once it is complete, names the folder of every bucket and the batches that have been added. A batch
that dies leaves nothing that counts and can be tried again; a batch that was added is not added twice. Buckets are as
many as the keys need: when they outgrow their size the ledger is split into more of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.normalize import composed
from shelfmark.functions.text import letters_digits
from shelfmark.session import is_complete, remove, scratch_path, subfolders

#: Keys that one bucket holds before the ledger is split further.
KEYS_A_BUCKET = 1_000_000
#: Records of one key that one task joins; a key with more is spread over several.
RECORDS_A_TASK = 200_000


def canonical_key(columns: list[str]) -> Column:
    """The fields of a record without formatting, in an order that does not depend on the columns.

    Letters, digits and accents count, case does not; a null field counts as an empty one.
    """
    return F.concat_ws("\x1f", F.array_sort(F.array(*(letters_digits(F.col(c)) for c in columns))))


def keyed_records(records: DataFrame, columns: list[str], id_column: str, batch: Column | None = None) -> DataFrame:
    """(id, key) of every record, and the batch it belongs to if that is told. One pass over the records."""
    names = [f"_k{i}" for i in range(len(columns))]
    extra = [] if batch is None else [batch.cast("string").alias("_batch")]
    plain = records.select(F.col(id_column).cast("bigint").alias("_id"), *(F.col(c).alias(n) for c, n in zip(columns, names)), *extra)
    return composed(plain, names).select(F.col("_id").alias("id"), canonical_key(names).alias("key"), *(["_batch"] if extra else []))


class Ledger:
    """Counts per canonical key with the earliest representative, kept as files under `path`.

    columns of the ledger: bucket, key, n_copies (bigint), first_id (bigint: the smallest id). Records of equal key are
    one entry; ids need not be unique, every row counts as a copy. Records whose fields are all null or empty share the
    empty key. A null id counts as a copy but never represents.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int = 1, keys_a_bucket: int = KEYS_A_BUCKET):
        self.spark, self.path, self.buckets, self.keys_a_bucket = spark, path or scratch_path(spark, "ledger"), buckets, keys_a_bucket
        self.generation = 0
        #: bucket -> (folder that counts, keys in it); never more entries than there are buckets
        self.current: dict[int, tuple[str, int]] = {}
        #: names of the batches that have been added
        self.batches: set[str] = set()

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Ledger:
        """The ledger that earlier batches left under `path`: that of the last complete manifest."""
        complete = [name for name in subfolders(spark, f"{path}/manifest") if is_complete(spark, f"{path}/manifest/{name}")]
        ledger = cls(spark, path)
        if complete:
            last = max(complete, key=lambda name: int(name.split("-")[0]))
            for row in spark.read.parquet(f"{path}/manifest/{last}").collect():
                ledger.generation, ledger.buckets, ledger.keys_a_bucket = row["generation"], row["buckets"], row["keys_a_bucket"]
                if row["bucket"] is not None:
                    ledger.current[row["bucket"]] = (row["folder"], row["n_keys"])
                if row["batch"] is not None:
                    ledger.batches.add(row["batch"])
        return ledger

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")

    def entries(self, buckets: list[int] | None = None) -> DataFrame:
        """The entries of the ledger, or of some of its buckets."""
        by_folder: dict[str, list[int]] = {}
        for bucket, (folder, _) in self.current.items():
            if buckets is None or bucket in buckets:
                by_folder.setdefault(folder, []).append(bucket)
        parts = self.spark.createDataFrame([], "bucket int, key string, n_copies bigint, first_id bigint")
        for folder, wanted in sorted(by_folder.items()):
            part = self.spark.read.parquet(f"{self.path}/data/{folder}").where(F.col("bucket").isin(wanted))
            parts = parts.unionByName(part.select("bucket", "key", "n_copies", "first_id"))
        return parts

    def update(self, batch: DataFrame, columns: list[str], id_column: str, name: str | None = None) -> bool:
        """Add a batch of records. False, and nothing done, if a batch of that name has been added before."""
        return self.add(keyed_records(batch, columns, id_column), name)

    def add(self, keyed: DataFrame, name: str | None = None) -> bool:
        """Add keyed records (id, key): aggregate, join with the buckets they touch, write those anew, then the manifest."""
        if name is not None and name in self.batches:
            return False
        attempt = uuid.uuid4().hex
        fresh_path = f"{self.path}/batch/{attempt}"
        summed = keyed.groupBy("key").agg(F.count("*").alias("n_copies"), F.min("id").alias("first_id"))
        summed.withColumn("bucket", self._bucket()).write.parquet(fresh_path)
        fresh = self.spark.read.parquet(fresh_path)
        sizes = {r["bucket"]: r["n"] for r in fresh.groupBy("bucket").agg(F.count("*").alias("n")).collect()}  # a row per bucket
        most = max((n + self.current.get(b, ("", 0))[1] for b, n in sizes.items()), default=0)
        old = self.entries(None if most > self.keys_a_bucket else sorted(sizes))
        if most > self.keys_a_bucket:
            self.buckets *= 1 << (most // self.keys_a_bucket).bit_length()
            self.current = {}
        if sizes:
            zero = F.lit(0).cast("bigint")
            both = fresh.select("key", "n_copies", "first_id").join(old.select("key", F.col("n_copies").alias("old_n"), F.col("first_id").alias("old_first")), "key", "full_outer")
            merged = both.select(
                self._bucket().alias("bucket"), "key", (F.coalesce("n_copies", zero) + F.coalesce("old_n", zero)).alias("n_copies"), F.least("first_id", "old_first").alias("first_id")
            )
            folder = f"{self.path}/data/{attempt}"
            merged.repartition(self.buckets, "bucket").sortWithinPartitions("bucket").write.partitionBy("bucket").parquet(folder)
            written = self.spark.read.parquet(folder).groupBy("bucket").agg(F.count("*").alias("n")).collect()  # a row per bucket
            self.current |= {r["bucket"]: (attempt, r["n"]) for r in written}
        self.generation += 1
        if name is not None:
            self.batches.add(name)
        head = (self.generation, self.buckets, self.keys_a_bucket)
        rows = [(*head, b, at, n, None) for b, (at, n) in self.current.items()] + [(*head, None, None, None, name) for name in sorted(self.batches)]
        manifest = self.spark.createDataFrame(rows or [(*head, None, None, None, None)], "generation int, buckets int, keys_a_bucket int, bucket int, folder string, n_keys bigint, batch string")
        manifest.coalesce(1).write.parquet(f"{self.path}/manifest/{self.generation}-{attempt}")
        remove(self.spark, fresh_path)
        return True

    def clean(self) -> None:
        """Delete what the last manifest no longer needs: folders of older generations and of batches that died.

        Results that were made from an older state must be written or read before.
        """
        held = {folder for folder, _ in self.current.values()}
        for name in subfolders(self.spark, f"{self.path}/data"):
            if name not in held:
                remove(self.spark, f"{self.path}/data/{name}")
        remove(self.spark, f"{self.path}/batch")
        for name in subfolders(self.spark, f"{self.path}/manifest"):
            if not name.startswith(f"{self.generation}-"):
                remove(self.spark, f"{self.path}/manifest/{name}")

    def copies(self, records: DataFrame, columns: list[str], id_column: str) -> DataFrame:
        """Every record that is a copy of an earlier one: first_id, copy_id, one row each."""
        return self.copies_of(keyed_records(records, columns, id_column))

    def copies_of(self, keyed: DataFrame) -> DataFrame:
        """`copies` of keyed records (id, key).

        An entry with very many copies is repeated once per RECORDS_A_TASK of them, and its records are spread over so
        many parts, so that those of one key are never gathered in one task; other entries are there once.
        """
        several = self.entries().where("n_copies > 1").select("key", "first_id", F.ceil(F.col("n_copies") / RECORDS_A_TASK).cast("int").alias("parts"))
        spread = several.where("parts > 1").select(F.col("key").alias("_hot"), "parts")
        part = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")
        salted = keyed.select("id", "key")
        if spread.limit(1).count():
            salted = salted.join(spread, F.col("key") == F.col("_hot"), "left").select("id", "key", part.alias("salt"))
        else:
            salted = salted.withColumn("salt", F.lit(0))
        placed = several.select("key", "first_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"))
        return salted.join(placed, ["key", "salt"]).where("id <> first_id").select("first_id", F.col("id").alias("copy_id")).distinct()


def ledger_of(df: DataFrame, columns: list[str], id_column: str, batch: Column, path: str | None = None, keys_a_bucket: int = KEYS_A_BUCKET) -> tuple[Ledger, DataFrame]:
    """A ledger of `df`, fed batch by batch in the order of `batch`, and the keyed records (id, key).

    `df` is read once: its keyed records are written, apart by batch, and every batch reads its own part. The result
    does not depend on how the batches are cut; records without a batch are the first one.
    """
    spark = df.sparkSession
    ledger = Ledger(spark, path, keys_a_bucket=keys_a_bucket)
    place = f"{ledger.path}/keyed-{uuid.uuid4().hex}"
    keyed_records(df, columns, id_column, batch).write.partitionBy("_batch").parquet(place)
    if not any(name.startswith("_batch=") for name in subfolders(spark, place)):
        return ledger, spark.createDataFrame([], "id bigint, key string")
    keyed = spark.read.schema("id bigint, key string, _batch string").parquet(place)
    names = sorted((r[0] for r in keyed.select("_batch").distinct().collect()), key=lambda v: (v is not None, v))  # one per batch
    for name in names:
        ledger.add(keyed.where(F.col("_batch").eqNullSafe(F.lit(name))), f"batch {name}")
    return ledger, keyed.select("id", "key")
