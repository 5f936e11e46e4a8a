"""Session helpers shared by the whole package."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers anywhere can import it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    here = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(here):  # this very code was imported from a shipped archive
        return
    path = os.path.join(tempfile.mkdtemp(), "strandlake_code.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for top, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    spark.sparkContext.addPyFile(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see; a temporary one only where it is unset."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        now = sc._jsc.sc().getCheckpointDir()
        if now.isDefined():
            return now.get().rstrip("/")
        path = "file://" + tempfile.mkdtemp(prefix="strandlake-shared-")
        sc.setCheckpointDir(path)
        return sc._jsc.sc().getCheckpointDir().get().rstrip("/")
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/strandlake-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of queries that ended. It acts when the JVM collects its garbage, and
    a query's last references go only a moment after its end, hence more than one collection."""
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.4)


def input_bytes(df: DataFrame) -> int:
    """What Catalyst takes the plan's output for, in bytes; where it knows no size, what the rows hold, counted."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 60:
        return size
    held = [F.octet_length(c).cast("long") if t in ("string", "binary") else F.lit(8) for c, t in df.dtypes]
    each = [F.coalesce(F.sum(x), F.lit(0)) for x in held]
    return int(sum(df.agg(*(x.alias(f"c{k}") for k, x in enumerate(each))).first()))


def partitions_for(df: DataFrame, mb: float) -> int:
    """So many partitions that each takes about mb of input, however large that is; never fewer than the session asks for."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-input_bytes(df) // int(mb * 1e6)))
