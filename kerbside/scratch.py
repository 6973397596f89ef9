"""Tables written between the steps of an operator.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``, the folder
that the cluster shares between driver and executors. The setting is read from
the session; only where it is unset and Spark runs in one process (tests) a folder is made.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from kerbside.ship import ship

#: Rows of a file, and files, of a table whose number of rows is known beforehand: a store holds a few files rather
#: than many of some rows each, and tasks make no file (a process each, on a local store) for next to nothing.
FILE_ROWS, LEAST_FILES = 50_000, 12


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; set once per session where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get() if held.isDefined() else None
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="kerbside-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


class Scratch:
    """One operator call's folder; removed when the driver process ends."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)  # the operators' functions run in the executors' Python
        self.spark = spark
        base = shared_dir(spark)
        self.root = f"{base if ':' in base else f'file://{base}'}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        jvm, path = spark.sparkContext._jvm, self.root
        conf = spark.sparkContext._jsc.hadoopConfiguration()

        def remove() -> None:
            try:
                p = jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(conf).delete(p, True)
            except Exception:  # the JVM may be gone when the process ends
                pass

        atexit.register(remove)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """Write ``df`` and read it back: a cut in the lineage that survives lost executors.

        Where it is known that ``df`` has about ``rows`` rows at most, it is written in a file for each
        ``FILE_ROWS`` of them, ``LEAST_FILES`` at least, if that is fewer than the session's shuffles make.
        """
        if rows is not None:
            files = max(LEAST_FILES, -(-rows // FILE_ROWS))
            if files < int(self.spark.conf.get("spark.sql.shuffle.partitions")):
                df = df.coalesce(files)
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
