"""Sessions, tables and durable intermediate results."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Settings that any session of ours should have. They are set only where the caller left them open.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(app: str = "shelfmark", cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine; on a cluster, bring your own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = DEFAULTS | {
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Let the executors' Python import this package, once per context: it lies in the shared folder for them."""
    context = spark.sparkContext
    if getattr(context, "_shelfmark_shipped", False):
        return
    root, packed = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(packed, "w") as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, path.relative_to(root.parent))
    where = f"{scratch_path(spark, 'package')}/shelfmark.zip"
    target = context._jvm.org.apache.hadoop.fs.Path(where)
    stream = target.getFileSystem(context._jsc.hadoopConfiguration()).create(target)
    stream.write(packed.getvalue())
    stream.close()
    context.addPyFile(where)
    context._shelfmark_shipped = True


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of a data folder; a file and a directory of parts read alike."""
    ship(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as named in spark.checkpoint.dir.

    Only where that setting is absent and the session runs on one machine, as in tests, a temporary folder of our own is
    made and set; on a cluster RuntimeError is raised, because a folder of one machine is lost to all others.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if current.isEmpty():
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        context.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), f"shelfmark-{os.getpid()}"))
    return named or context._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write `df` to the shared folder and go on from there: what follows survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path for a written table in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """The names of what lies directly in a folder; none if there is no such folder."""
    target, system = _file_system(spark, path)
    return sorted(status.getPath().getName() for status in system.listStatus(target)) if system.exists(target) else []


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    target, system = _file_system(spark, f"{path}/_SUCCESS")
    return system.exists(target)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written table; one that is not there is no error."""
    target, system = _file_system(spark, path)
    system.delete(target, True)


def bounded_rows(df: DataFrame, bound: int, what: str) -> list:
    """Collect a reference table that must be small, refusing to collect one that is not.

    Raises ValueError when there are more than `bound` rows; at most `bound + 1` rows ever reach the driver.
    """
    rows = df.limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"{what} has more than {bound} rows; it is not the small reference table this operator needs")
    return rows
