"""Shared helpers: a scratch area that every executor sees, and small text expressions."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of the batches that Python workers get, and rows that a scan reads at once, where the session doesn't say:
#: texts are long, and 4,096 of them are arrays that a small heap grows for and keeps.
BATCH = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    "spark.sql.parquet.columnarReaderBatchSize": "512",
}
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROOT = str(Path(__file__).resolve().parents[2])


def prepare(spark: SparkSession) -> None:
    """Let this machine's Python workers find the package (on a cluster it is installed or sent with --py-files), and keep
    their batches small."""
    own = dict(spark.sparkContext.getConf().getAll())
    for key, value in BATCH.items():
        if key not in own:
            spark.conf.set(key, value)
    path = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if ROOT not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, path) if x)


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none, a temporary one is set in local mode; on a cluster,
    whose executors wouldn't see it, that is an error."""
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        root = context.getCheckpointDir()
        if not root:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="weftgraph-"))
            root = context.getCheckpointDir()
    return root.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; a lost executor never loses them."""

    def __init__(self, spark: SparkSession, name: str):
        prepare(spark)
        self.spark = spark
        self.root = f"{shared_root(spark)}/weft-{name}-{uuid.uuid4().hex}"
        self._names: list[str] = []

    def path(self, name: str) -> str:
        self._names.append(name)
        return f"{self.root}/{len(self._names):03d}-{name}"

    def table(self, frame: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        frame.write.parquet(path)
        return self.read(path, frame.schema)

    def read(self, path: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path)

    def last(self, name: str) -> str:
        """The folder of the latest table of that name."""
        return next(f"{self.root}/{i:03d}-{name}" for i in range(len(self._names), 0, -1) if self._names[i - 1] == name)

    def unused(self, name: str) -> str:
        """A name that no table has yet."""
        return f"{name}{len(self._names)}"

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        self._delete(i for i, n in enumerate(self._names) if n in names)

    def drop_older(self, name: str) -> None:
        """Delete all tables of that name but the latest."""
        self._delete([i for i, n in enumerate(self._names) if n == name][:-1])

    def _delete(self, places) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for i in places:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{i + 1:03d}-{self._names[i]}")
            path.getFileSystem(conf).delete(path, True)


def release() -> None:
    """Hand freed memory back to the system, where the C library can: workers outlive their tasks."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def trimmed(run):
    """A function of batches that releases memory after its last one."""

    def wrapped(batches):
        yield from run(batches)
        release()

    return wrapped


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty. Texts of ASCII alone take the quicker way."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def sha_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def fresh(frame: DataFrame, *names: str) -> list[str]:
    """Column names that clash with none of the frame's."""
    taken = {c.lower() for c in frame.columns}
    return [next(x for x in (f"_{n}" + "_" * i for i in range(99)) if x.lower() not in taken) for n in names]


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
