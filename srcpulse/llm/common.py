"""What the operators share: input columns, the shared folder, lineage cuts."""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcpulse.session import shared_dir

#: Rows of one Arrow batch. Texts vary from nothing to megabytes, so a batch holds few rows; Spark ends it at 64 MB as well
#: (spark.sql.execution.arrow.maxBytesPerBatch). The setting stays with the session of the frame.
BATCH_ROWS = 500


#: Terms end at every ASCII character but letters and digits; A-Z count as a-z.
FOLDED = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Runs of letters, digits and non-ASCII characters of a text in UTF-8, A-Z as a-z."""
    return text.translate(FOLDED).split()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, id_col: str | None = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """`doc_id`, `text` of every row, null texts empty; all other columns but `more` are dropped, so none can clash."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return docs.select(
        (F.col(id_col) if id_col else F.lit(None)).cast("long").alias("doc_id"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        *more,
    )


def written(df: DataFrame, what: str, *partition_by: str, compression: str = "zstd") -> DataFrame:
    """The frame as a Parquet table in the shared folder, read back: later steps don't depend on executors that made it."""
    spark = df.sparkSession
    path = shared_dir(spark, f"llm/{what}")
    df.write.option("compression", compression).partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def kept[T](what: str, key: object, make: Callable[[], T]) -> T:
    """What a worker process makes once for all its tasks. Modules travel anew with each task, so it is kept beside them."""
    held = sys.__dict__.setdefault("_srcpulse_kept", {}).setdefault(what, {})
    if key not in held:
        held[key] = make()
    return held[key]


def removed(spark: SparkSession) -> None:
    """Delete what the operators left in the shared folder. For use when no result is read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark, "llm")).getParent()
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "llm")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
