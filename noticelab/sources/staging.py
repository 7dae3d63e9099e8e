"""Tables between the stages of a long plan."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The tables written by this driver and not yet released, oldest first.
MADE: list[str] = []


def release(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables staged since there were `since` of them; nothing that reads them may be used after."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in MADE[since:]:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    del MADE[since:]


def staged(df: DataFrame, label: str = "stage") -> DataFrame:
    """df written to the folder all executors share (spark.checkpoint.dir) and
    read again: the plan behind it ends here, and a lost executor costs nothing.
    A local session without that setting uses a temporary folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or getattr(sc, "_noticelab_staging", None)
    if not root:
        if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            root = tempfile.mkdtemp(prefix="noticelab-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
        else:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_staging"
        sc._noticelab_staging = root
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    MADE.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
