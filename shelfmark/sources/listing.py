"""Files in a tree, as rows."""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.schema import COVER_NAMES, LISTED, extension, is_audio
from shelfmark.session import ship


def as_roots(roots: str | Iterable[str]) -> list[str]:
    """Absolute roots, each once, in the order given; a leading tilde is the home folder."""
    given = [roots] if isinstance(roots, str) else list(roots)
    return list(dict.fromkeys(os.path.abspath(os.path.expanduser(r)) for r in given))


def walk(root: str, top: str, include_hidden: bool) -> Iterator[tuple]:
    """The files below `top` as LISTED rows. Hidden folders are pruned, hidden files are not; links are not followed."""
    for here, below, files in os.walk(top):
        if not include_hidden:
            below[:] = [d for d in below if not d.startswith(".")]
        below.sort()
        relative = os.path.relpath(here, root)
        for name in sorted(files):
            try:
                info = os.stat(os.path.join(here, name))
            except OSError:
                continue
            ext = os.path.splitext(name)[1].lower()
            yield root, "" if relative == "." else relative.replace(os.sep, "/"), name, ext, info.st_size, int(info.st_mtime)


def _files_here(root: str, folder: str) -> Iterator[tuple]:
    """The files directly in a folder, as LISTED rows."""
    relative = os.path.relpath(folder, root).replace(os.sep, "/")
    try:
        with os.scandir(folder) as entries:
            found = sorted((e.name, e.stat()) for e in entries if e.is_file())
    except OSError:
        return
    for name, info in found:
        yield root, "" if relative == "." else relative, name, os.path.splitext(name)[1].lower(), info.st_size, int(info.st_mtime)


def _folders_here(folder: str, include_hidden: bool) -> list[str]:
    try:
        with os.scandir(folder) as entries:
            return sorted(e.path for e in entries if e.is_dir(follow_symlinks=False) and (include_hidden or not e.name.startswith(".")))
    except OSError:
        return []


def list_files(spark: SparkSession, roots: str | Iterable[str], include_hidden: bool = False) -> DataFrame:
    """LISTED rows of all files below the roots; a folder or file that cannot be read is left out.

    The driver looks at the roots alone, a task at each folder below one, and every folder below that is walked by a task
    of its own. No folder is read twice but those two levels; the trees must be mounted where the executors run.
    """
    ship(spark)
    upper = [(root, folder) for root in as_roots(roots) for folder in (root, *_folders_here(root, include_hidden))]
    columns = [f.name for f in LISTED]

    def here(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for root, folder in batch.itertuples(index=False):
                yield pd.DataFrame(list(_files_here(root, folder)), columns=columns)

    def below(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for root, folder in batch.itertuples(index=False):
                if folder != root:
                    yield pd.DataFrame([(root, sub) for sub in _folders_here(folder, include_hidden)], columns=["root", "folder"])

    def deep(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            for root, folder in batch.itertuples(index=False):
                yield pd.DataFrame(list(walk(root, folder, include_hidden)), columns=columns)

    tasks = max(spark.sparkContext.defaultParallelism, 1)
    tops = spark.createDataFrame(upper, "root string, folder string").repartition(max(1, min(len(upper), 4 * tasks)))
    return tops.mapInPandas(here, LISTED).unionByName(tops.mapInPandas(below, "root string, folder string").repartition(4 * tasks).mapInPandas(deep, LISTED))


def audio_files(listing: DataFrame) -> DataFrame:
    return listing.where(is_audio(F.col("filename")))


def files_of(listing: DataFrame, *extensions: str) -> DataFrame:
    """The files with given extensions, in the order of their paths."""
    return listing.where(extension(F.col("filename")).isin(*extensions)).orderBy("root", "dir", "filename")


def cover_files(listing: DataFrame) -> DataFrame:
    """The cover file of each folder that has one: of several the first by name."""
    return listing.where(F.lower("filename").isin(*COVER_NAMES)).groupBy("root", "dir").agg(F.min("filename").alias("cover"))
