"""Integrity scans: what a decoder says about each file, tier and reason, resumed where an earlier scan broke off."""

from __future__ import annotations

import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.decode import LOST_SYNC, decode_tier
from shelfmark.operators.matching import remaining
from shelfmark.session import is_complete, subfolders

OUTPUTS = "path string, size bigint, code int, said string"
#: A decoder takes a path and gives its exit code and what it printed.
Decoder = Callable[[str], tuple[int, str]]


def command(*words: str, seconds: int = 600) -> Decoder:
    """A decoder that runs a program with the path as its last word; one that is missing or hangs gives code 127 or 124."""

    def run(path: str) -> tuple[int, str]:
        from shelfmark.sources.binary import decoded

        try:
            done = subprocess.run([*words, path], capture_output=True, timeout=seconds)
        except subprocess.TimeoutExpired:
            return 124, f"no answer within {seconds} seconds"
        except OSError as error:
            return 127, str(error)
        return done.returncode, decoded(done.stderr)

    return run


def decode_reason(code: Column, said: Column, declared: Column) -> Column:
    """Why a file has its tier, in words."""
    lines = F.filter(F.transform(F.split(F.coalesce(said, F.lit("")), r"\r?\n"), lambda x: F.trim(x)), lambda ln: ln != "")
    reached = F.regexp_extract(F.coalesce(said, F.lit("")), LOST_SYNC, 1).try_cast("bigint")
    n = F.size(lines)
    return (
        F.when((declared > 0) & (reached < declared), F.format_string("truncated: decoded %d of %d samples", reached, declared.cast("bigint")))
        .when(reached.isNotNull(), F.format_string("trailing data after %d samples (audio intact, not byte-clean)", reached))
        .when(code != 0, F.coalesce(F.try_element_at(lines, F.lit(1)), F.format_string("decoder exit code %d", code)))
        .when(n == 0, "decode ok")
        .when(decode_tier(code, said, declared) == "METADATA", "tag/benign decoder warnings only; audio decodes")
        .otherwise(F.concat(n.cast("string"), F.when(n == 1, " decoder warning").otherwise(" decoder warnings"), F.lit("; decoded to end")))
    )


def verdicts(outputs: DataFrame, declared: Column | None = None) -> DataFrame:
    """VERDICT rows of what decoders said (OUTPUTS): path, size, tier, reason. declared: the samples a file says it has."""
    samples = F.lit(None).cast("bigint") if declared is None else declared
    arguments = (F.col("code"), F.col("said"), samples)
    return outputs.select("path", "size", decode_tier(*arguments).alias("tier"), decode_reason(*arguments).alias("reason"))


def decode_files(files: DataFrame, decoder: Decoder) -> DataFrame:
    """OUTPUTS of a table (path, size); each file is decoded where its task runs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            said = [decoder(path) for path in batch["path"]]
            yield batch.assign(code=[c for c, _ in said], said=[s for _, s in said])[["path", "size", "code", "said"]]

    return files.select("path", "size").mapInPandas(run, OUTPUTS)


def scan(files: DataFrame, decoder: Decoder, state: str, slices: int = 25) -> DataFrame:
    """Decode what has no verdict yet and give all verdicts, old and new.

    state: a folder that all executors share. Verdicts are written there slice by slice, each whole or not at all, so a
    scan that breaks off loses no more than a slice and the next one goes on from there. A file is known by its path.
    """
    spark = files.sparkSession
    done = [name for name in subfolders(spark, state) if is_complete(spark, f"{state}/{name}")]
    known = spark.read.parquet(*(f"{state}/{name}" for name in done)) if done else spark.createDataFrame([], "path string, size bigint, tier string, reason string")
    todo = remaining(files.select("path", "size"), known, "path").withColumn("_slice", F.pmod(F.xxhash64("path"), F.lit(slices)))
    first = max((int(name.split("-")[1]) for name in done), default=-1) + 1
    for i in range(slices):
        part = todo.where(F.col("_slice") == i)
        verdicts(decode_files(part, decoder)).write.parquet(f"{state}/part-{first + i}")
    return spark.read.parquet(*(f"{state}/{name}" for name in subfolders(spark, state) if is_complete(spark, f"{state}/{name}")))


def tier_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("tier").agg(F.count("*").alias("n_files"))
