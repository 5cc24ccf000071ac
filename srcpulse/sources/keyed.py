"""A table with one current state per key, kept in buckets of the key.

A batch is merged into the buckets that its keys fall into; only these are read and written again, as folders of a new version.
A manifest per version names the folder of each bucket, so a reader opens as many folders as there are buckets however many
batches there were, and never sees half a batch. A manifest also names the last batch of each source: a batch that comes again
changes nothing, and a batch that broke off before its manifest is merged anew over what it left. Folders that neither the
newest manifest nor the one before it names are removed.

One writer at a time, as a streaming query is; readers may read meanwhile.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from srcpulse.sources import folders

BUCKETS = 64
_BUCKET, _MANIFEST = "key_bucket", "_manifest"


def _manifests(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n) for n in folders.names(spark, f"{path}/{_MANIFEST}") if n.isdigit())


def _newest(spark: SparkSession, path: str) -> dict | None:
    versions = _manifests(spark, path)
    return json.loads(folders.read_text(spark, f"{path}/{_MANIFEST}/{versions[-1]:012}")) if versions else None


def _read(spark: SparkSession, path: str, manifest: dict, buckets: list[str]) -> DataFrame:
    schema = StructType.fromJson(manifest["schema"])
    named = [f"{path}/version={manifest['folders'][b]}/{_BUCKET}={b}" for b in buckets if b in manifest["folders"]]
    return spark.read.schema(schema).parquet(*named) if named else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest version."""
    manifest = _newest(spark, path)
    if manifest is None:
        raise FileNotFoundError(f"no version of a table in {path}")
    return _read(spark, path, manifest, list(manifest["folders"]))


def merge(
    batch: DataFrame, path: str, key: str, current: Callable[[DataFrame], DataFrame], source: str, number: int, buckets: int = BUCKETS
) -> bool:
    """Merge one batch; False where ``source`` has already brought a batch of this or a later ``number``.

    ``current`` gives the rows that stay among all rows of some keys; it must give the same in whatever steps rows arrive.
    """
    spark = batch.sparkSession
    manifest = _newest(spark, path) or {"version": 0, "buckets": buckets, "folders": {}, "sources": {}, "schema": batch.schema.jsonValue()}
    if manifest["sources"].get(source, -1) >= number:
        return False
    if batch.schema.jsonValue()["fields"] != manifest["schema"]["fields"]:
        raise ValueError(f"columns differ from those of the table in {path}")
    version = manifest["version"] + 1
    bucket = F.pmod(F.xxhash64(key), F.lit(manifest["buckets"])).cast("int")
    # What a batch brings of its own is cut down before it meets the table.
    news = current(batch).withColumn(_BUCKET, bucket).persist()
    try:
        touched = [str(r[0]) for r in news.select(_BUCKET).distinct().collect()]  # at most one per bucket
        held = _read(spark, path, manifest, touched).withColumn(_BUCKET, bucket)
        merged = current(held.unionByName(news).drop(_BUCKET)).withColumn(_BUCKET, bucket)
        if touched:
            merged.hint("rebalance", _BUCKET).write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{path}/version={version}")
    finally:
        news.unpersist()
    manifest |= {
        "version": version, "folders": manifest["folders"] | dict.fromkeys(touched, version), "sources": manifest["sources"] | {source: number},
    }
    folders.write_text(spark, f"{path}/{_MANIFEST}/{version:012}", json.dumps(manifest))
    _remove_old(spark, path)
    return True


def _remove_old(spark: SparkSession, path: str) -> None:
    versions = _manifests(spark, path)
    manifests = [json.loads(folders.read_text(spark, f"{path}/{_MANIFEST}/{m:012}")) for m in versions[-2:]]
    used = {f"version={v}/{_BUCKET}={b}" for m in manifests for b, v in m["folders"].items()}
    for name in folders.names(spark, path):
        if name.startswith("version=") and int(name.split("=")[1]) <= versions[-1]:
            inside = [f"{name}/{one}" for one in folders.names(spark, f"{path}/{name}") if one.startswith(f"{_BUCKET}=")]
            old = [one for one in inside if one not in used]
            for gone in [name] if len(old) == len(inside) else old:
                folders.remove(spark, f"{path}/{gone}")
    for old in versions[:-2]:
        folders.remove(spark, f"{path}/{_MANIFEST}/{old:012}")
