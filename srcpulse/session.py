"""Session defaults and the shared working folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "srcpulse", cores: str = "*", memory: str = "8g") -> SparkSession:
    """Session for tests and benchmarks. On a cluster the caller passes its own session."""
    partitions = "8" if cores == "*" else cores
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # Large column expressions are built with thousands of calls; do not record a stack trace for each.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", memory)
        .getOrCreate()
    )


#: Bytecodes of a method beyond which the JVM never compiles it.
JIT_LIMIT = 8000


def compiled_only(spark: SparkSession) -> None:
    """Let Spark fuse operators only as far as the JVM compiles the method that comes out.

    Spark fuses up to 65,535 bytecodes, but the JVM leaves a method of more than 8,000 to its interpreter. Wide expressions over one
    row give such methods; operators that are not fused split theirs. A limit that is lower already stays.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name)) > JIT_LIMIT:
        spark.conf.set(name, str(JIT_LIMIT))


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder every executor can reach, below the one that the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset and all runs in one process, as in tests, a temporary folder is made for the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith("local-cluster") or not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="srcpulse-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where several results come from one expensive frame. The table survives the loss of an
    executor, unlike cached blocks that would be recomputed.
    """
    path = shared_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
