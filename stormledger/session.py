"""Session defaults and the materialised tables that cut the lineage of iterative jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(app: str, cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the local bench; on a cluster the submitter supplies the session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def work_folder(spark: SparkSession) -> str:
    """The shared folder for lineage-cutting tables.

    The cluster names it in spark.checkpoint.dir. Where that setting and the context's own
    checkpoint folder are both unset, a session that is one process, as in local tests, gets a
    private temporary folder; on a cluster each machine would write to its own, so that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"name a folder that all machines of {master} share in spark.checkpoint.dir")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


class WorkTables:
    """Parquet tables under the work folder, one per loop round.

    Writing a round and reading it back ends its lineage on storage that outlives executors, and
    gives the next plan true sizes, so that broadcast and skew decisions rest on measured bytes.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{work_folder(spark)}/{label}-{uuid.uuid4().hex}"
        self.paths: list[str] = []
        self.saved = 0

    def save(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{self.saved:05d}"
        df.write.parquet(path)
        self.saved += 1
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_counting(self, df: DataFrame, flag: str) -> tuple[DataFrame, int]:
        """Save, and count the rows with `flag` in the same job that writes them."""
        seen = Observation()
        saved = self.save(df.observe(seen, F.count_if(flag).alias("n")))
        return saved, seen.get["n"]

    def union(self, paths: list[str], schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths)

    def stored_bytes(self) -> int:
        """The size of the table saved last."""
        path = self._hadoop_path(self.paths[-1])
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()

    def keep_last(self) -> None:
        """At a loop's end: deletes all its tables but the one saved last."""
        for path in map(self._hadoop_path, self.paths[:-1]):
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.paths = self.paths[-1:]

    def drop(self) -> None:
        """Deletes all tables, once nothing reads them any more."""
        for path in map(self._hadoop_path, self.paths):
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self.paths = []

    def _hadoop_path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write `df` once and read it back."""
    return WorkTables(df.sparkSession, label).save(df)
