"""Session helpers: reading tables and cutting lineage through tables in the shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_LOCAL_ROOT: str | None = None


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory (``<dir>/<name>.parquet``, file or folder)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over at least half as many partitions as there are cores, for work that is heavy per row.

    Files that are small or unsplittable come as a few partitions, and the cores would idle; only
    then are the rows shuffled, by key. Large inputs have more splits than cores and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() * 2 <= cores else df


def one_machine(spark: SparkSession) -> bool:
    """Whether driver and tasks share one JVM."""
    master = spark.sparkContext.master
    return master.startswith("local") and not master.startswith("local-cluster")


def shared_root(spark: SparkSession) -> str:
    """Folder that all executors share, from ``spark.checkpoint.dir`` or the checkpoint folder set on the context.

    Only a local session that names none (tests, one machine) gets a folder of our own, set as the checkpoint folder as
    well; on a cluster it would be another disk on every machine, so there it raises.
    """
    global _LOCAL_ROOT
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not one_machine(spark):
        given = spark.sparkContext.getCheckpointDir()
        if given:
            return given.rstrip("/")
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if _LOCAL_ROOT is None:
        _LOCAL_ROOT = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, _LOCAL_ROOT, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_LOCAL_ROOT)
    return f"file://{_LOCAL_ROOT}"


_STAGES: set[Stage] = set()


def clean() -> None:
    """Delete the tables of all queries run so far. Their results can't be read any more afterwards; a long
    session calls this between queries, and the end of the interpreter does."""
    for stage in list(_STAGES):
        stage.close()


atexit.register(clean)


class Stage:
    """Intermediate tables of one query run, written as Parquet to the shared folder.

    A written table survives the loss of executors, is columnar and compressed, and ends the
    lineage: iterative operators would otherwise carry the plan of every round.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/weftline/{label}-{uuid.uuid4().hex[:12]}"
        self.n = 0
        _STAGES.add(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return it as read back."""
        self.n += 1
        path = f"{self.path}/{self.n:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._weftline_path = path
        return out

    def write_counting(self, df: DataFrame, name: str, condition: str) -> tuple[DataFrame, int]:
        """As write; also the number of rows that meet a condition, counted while writing."""
        seen = Observation()
        out = self.write(df.observe(seen, F.count_if(F.expr(condition)).alias("hits")), name)
        return out, seen.get["hits"]

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later step reads."""
        path = getattr(df, "_weftline_path", None)
        if path:
            self._delete(path)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        if jvm is None:
            return
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def close(self) -> None:
        """Delete all tables of the run; what was read from them can't be read again."""
        _STAGES.discard(self)
        try:
            self._delete(self.path)
        except Exception:  # the session may have ended before the interpreter does
            if self.path.startswith("file://"):
                shutil.rmtree(self.path[7:], ignore_errors=True)
